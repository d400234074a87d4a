"""Headers in the JVM, and decoders that yield to the next."""

import struct

import pytest

from inkflow.operators import convert, registry
from tests.pictures import png


def frame(spark, bodies):
    return spark.createDataFrame([(f"{i}.jpg", ".jpg", bytearray(b)) for i, b in enumerate(bodies)], "path string, ext string, content binary")


def found(frame, formats=None):
    return [(r["engine"], r["width"], r["height"]) for r in convert.identify(frame, formats).orderBy("path").collect()]


def segment(kind, body):
    return b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body


START = segment(0xC0, struct.pack(">BHH", 8, 480, 640) + b"\1\1\x11\0")


def test_jpeg_headers(spark):
    meta = b"".join(segment(0xE1, b"\xff\xc0" * 32000) for _ in range(17))
    assert len(meta) > 1 << 20
    bodies = [b"\xff\xd8" + START, b"\xff\xd8" + meta + START, b"\xff\xd8\xff\xff\xff\xd0\xff\x01" + segment(0xC4, b"x" * 30) + segment(0xFE, b"") + segment(0xC2, struct.pack(">BHH", 8, 7, 65500) + b"\1")]
    assert found(frame(spark, bodies)) == [("jpeg", 640, 480), ("jpeg", 640, 480), ("jpeg", 65500, 7)]
    assert [registry.Jpeg().size(b) for b in bodies] == [(640, 480), (640, 480), (65500, 7)]


@pytest.mark.parametrize("body", [b"\xff\xd8", b"\xff\xd8" + START[:8], b"\xff\xd8" + segment(0xC0, struct.pack(">BHH", 8, 0, 5) + b"\1"), b"\xff\xd8\x00\x00" + START, b"\xff\xd8" + b"\xff\xe0\xff\xff" + START, b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f\0\0"])
def test_damaged_headers(spark, body):
    with pytest.raises(Exception, match="unknown image"):
        found(frame(spark, [body]))


def test_webp_headers(spark):
    bodies = [
        b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 320, 0x8000 | 200), b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (319 | 16383 << 14 | 1 << 28).to_bytes(4, "little"),
        b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + (99_999).to_bytes(3, "little") + (49).to_bytes(3, "little"),
    ]
    assert found(frame(spark, bodies)) == [("webp", 320, 200), ("webp", 320, 16384), ("webp", 100_000, 50)] == [("webp", *registry.Webp().size(b)) for b in bodies]


class Picky(registry.Decoder):
    """Claims what PNG claims, and takes only pictures that are wider than high."""

    name, extensions, magic = "picky", (".png",), registry.Png.magic

    def size(self, content):
        w, h = registry.Png().size(content)
        return (w, h) if w > h else None


def formats(*decoders):
    built = registry.Registry()
    for d in decoders:
        built.register_decoder(d)
    return built


def test_a_refused_header_yields_to_the_next(spark):
    bodies = [png(9, 5), png(5, 9), b"\xff\xd8" + START]
    assert found(frame(spark, bodies), formats(Picky(), registry.Png(), registry.Jpeg())) == [("picky", 9, 5), ("png", 5, 9), ("jpeg", 640, 480)]
    assert found(frame(spark, bodies), formats(registry.Jpeg(), registry.Png(), Picky())) == [("png", 9, 5), ("png", 5, 9), ("jpeg", 640, 480)]
    with pytest.raises(Exception, match="1.jpg error, unknown image"):
        found(frame(spark, bodies), formats(Picky(), registry.Jpeg()))


class Late(Picky):
    name = "late"

    def size(self, content):
        raise AssertionError("what an earlier decoder took isn't asked about again")


def test_a_later_decoder_sees_only_what_is_open(spark):
    assert found(frame(spark, [png(9, 5), png(7, 3)]), formats(Picky(), Late())) == [("picky", 9, 5), ("picky", 7, 3)]
