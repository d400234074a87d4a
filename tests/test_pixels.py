"""Resampling on the JVM, lossless WebP, plugins with codecs of their own, passwords, watched folders."""

import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkflow.operators import convert, registry, resample
from inkflow.sources import archives
from inkflow.streaming.watch import latest, watch
from tests.pictures import archive, bmp, gradient, png


def pixels(row):
    p = row["picture"]
    return np.frombuffer(p["data"], dtype=np.uint8).reshape(p["height"], p["width"], 3)[:, :, ::-1]


@pytest.mark.parametrize("kernel", sorted(resample.SHAPES))
def test_the_jvm_resamples_as_numpy_does(spark, tmp_path, kernel):
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, (190, 1400, 3), dtype=np.uint8)
    entries = archives.zip_entries(spark, archive(tmp_path / "n.zip", {"a.png": png(1400, 190, noise)}))
    planned = convert.plan(convert.identify(entries)).withColumns({"target_w": F.lit(633), "target_h": F.lit(251), "do_resize": F.lit(True)})
    found = pixels(convert.resampled(convert.decoded(planned), kernel).first())
    assert np.abs(found.astype(int) - resample.resample(noise, 633, 251, kernel)).max() <= 1


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return bytes(sum(b << i for i, b in enumerate(self.bits[k : k + 8])) for k in range(0, len(self.bits), 8))


def put_code(out, alphabet, used):
    """A prefix code in which all `used` (a power of two) first symbols have one length."""
    n = used.bit_length() - 1
    out.put(0, 1)
    out.put(15, 4)  # all 19 lengths of the lengths' code
    for s in (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15):
        out.put(1 if s in (0, n) else 0, 3)
    out.put(0, 1)
    for s in range(alphabet):
        out.put((s < used) == (n > 0), 1)  # 0 comes first among symbols of one length


def put_symbol(out, s, n):
    out.bits += [s >> i & 1 for i in reversed(range(n))]


def put_entries(out, argb, main, cache=0, copies=False):
    """Literals, and (copies) runs of the pixel to the left, and (cache) cached colours."""
    out.put(bool(cache), 1)
    if cache:
        out.put(cache, 4)
    if main:
        out.put(0, 1)
    alphabet, more = 280 + (1 << cache if cache else 0), bool(cache or copies)
    put_wide(out, alphabet) if more else put_code(out, alphabet, 256)
    for _ in range(3):
        put_code(out, 256, 256)
    put_code(out, 40, 32)
    held, flat, i = {}, argb.reshape(-1), 0
    while i < len(flat):
        c = int(flat[i])
        n = 1
        while copies and i and i + n <= len(flat) and n < 4 and (flat[i : i + n] == flat[i - 1]).all():
            n += 1
        n -= 1
        place = (0x1E35A7BD * c & 0xFFFFFFFF) >> (32 - cache) if cache else 0
        if n >= 2:
            put_wide_symbol(out, 256 + n - 1, alphabet)
            put_symbol(out, 1, 5)  # the second of the near ones: one to the left
            i += n
            continue
        if cache and held.get(place) == c:
            put_wide_symbol(out, 280 + place, alphabet)
        else:
            put_wide_symbol(out, c >> 8 & 255, alphabet) if more else put_symbol(out, c >> 8 & 255, 8)
            for s in (16, 0, 24):
                put_symbol(out, c >> s & 255, 8)
        if cache:
            held[place] = c
        i += 1


def put_wide(out, alphabet):
    """A code for any alphabet of up to 512: the first symbols have eight bits, the others nine."""
    short = 512 - alphabet
    out.put(0, 1)
    out.put(15, 4)
    for s in (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15):
        out.put(1 if s in (8, 9) else 0, 3)
    out.put(0, 1)
    for s in range(alphabet):
        out.put(s >= short, 1)


def put_wide_symbol(out, s, alphabet):
    short = 512 - alphabet
    put_symbol(out, *((s, 8) if s < short else (2 * short + s - short, 9)))


def minus(a, b):
    return sum(((a >> s & 255) - (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))


def guess(mode, left, top, corner, right):
    part = lambda c: [c >> s & 255 for s in (0, 8, 16, 24)]
    whole = lambda parts: sum(p << s for p, s in zip(parts, (0, 8, 16, 24), strict=True))
    mean = lambda a, b: whole([(x + y) // 2 for x, y in zip(part(a), part(b), strict=True)])
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        guessed = [x + y - z for x, y, z in zip(part(left), part(top), part(corner), strict=True)]
        far = lambda c: sum(abs(g - x) for g, x in zip(guessed, part(c), strict=True))
        return left if far(left) < far(top) else top
    if mode == 12:
        return whole([clamp(x + y - z) for x, y, z in zip(part(left), part(top), part(corner), strict=True)])
    if mode == 13:
        return whole([clamp(x + int((x - z) / 2)) for x, z in zip(part(mean(left, top)), part(corner), strict=True)])
    return {1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right))}.get(mode, 0xFF000000)


def webp(image, alpha=None, steps=(), cache=0, copies=False, palette=None):
    """A lossless WebP file; steps: transforms in the order in which they are written."""
    h, w, _ = image.shape
    argb = (image.astype(np.int64) * [1 << 16, 1 << 8, 1]).sum(2) + ((np.full((h, w), 255) if alpha is None else alpha).astype(np.int64) << 24)
    out, rng = Bits(), random.Random(2)
    for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    for step in steps:
        out.put(1, 1)
        out.put({"predict": 0, "cross": 1, "green": 2, "palette": 3}[step], 2)
        a, r, g, b = (argb >> s & 255 for s in (24, 16, 8, 0))
        if step == "green":
            argb = a << 24 | (r - g & 255) << 16 | g << 8 | b - g & 255
        elif step == "palette":
            colours, index = np.unique(argb, return_inverse=True)
            index, n = index.reshape(h, w), len(colours)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            out.put(n - 1, 8)
            put_entries(out, np.array([int(colours[0]), *(minus(int(y), int(x)) for x, y in zip(colours[:-1], colours[1:], strict=True))]), False)
            width = (w + (1 << bits) - 1) >> bits
            packed = np.zeros((h, width), dtype=np.int64)
            for x in range(w):
                packed[:, x >> bits] |= index[:, x] << (x % (1 << bits)) * (8 >> bits)
            argb = packed << 8
        else:
            bits = 2
            across, down = (w + 3) >> 2, (h + 3) >> 2
            table = np.array([[rng.randrange(14) << 8 if step == "predict" else rng.getrandbits(24) for _ in range(across)] for _ in range(down)])
            out.put(bits - 2, 3)
            put_entries(out, table, False)
            coded = np.zeros_like(argb)
            flat = argb.reshape(-1)
            for y in range(h):
                for x in range(w):
                    i, part, c = y * w + x, int(table[y >> 2, x >> 2]), int(argb[y, x])
                    if step == "predict":
                        known = 0xFF000000 if i == 0 else int(flat[i - 1]) if y == 0 else int(flat[i - w]) if x == 0 else guess(part >> 8, *(int(flat[k]) for k in (i - 1, i - w, i - w - 1, i - w + 1)))
                        coded[y, x] = minus(c, known)
                    else:
                        byte = lambda v: (v & 255) - 256 if v & 128 else v & 255
                        red, grn, blue = c >> 16 & 255, c >> 8 & 255, c & 255
                        new_red = red - (byte(part) * byte(grn) >> 5) & 255
                        new_blue = blue - (byte(part >> 8) * byte(grn) >> 5) - (byte(part >> 16) * byte(red) >> 5) & 255
                        coded[y, x] = c & 0xFF00FF00 | new_red << 16 | new_blue
            argb = coded
    out.put(0, 1)
    put_entries(out, argb, True, cache, copies)
    body = out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def test_lossless_webp(spark, tmp_path):
    rng = np.random.default_rng(3)
    noise, few = rng.integers(0, 256, (21, 30, 3), dtype=np.uint8), (rng.integers(0, 2, (13, 19, 3)) * 200).astype(np.uint8)
    two = np.where(rng.random((9, 11, 1)) < 0.5, 10, 240).astype(np.uint8).repeat(3, axis=2)
    cases = {"plain": (noise, {}), "green": (noise, {"steps": ["green"]}), "predict": (gradient(37, 23), {"steps": ["predict"]}), "cross": (noise, {"steps": ["cross"]}), "all": (gradient(33, 17), {"steps": ["predict", "cross", "green"]})}
    cases |= {"copies": (few, {"copies": True}), "cache": (few, {"cache": 6}), "both": (np.repeat(noise, 3, axis=1), {"cache": 3, "copies": True}), "palette8": (few, {"steps": ["palette"]}), "palette2": (two, {"steps": ["palette"]}), "one": (noise[:1, :1], {})}
    source = archive(tmp_path / "w.zip", {f"{n}.webp": webp(image, **more) for n, (image, more) in cases.items()} | {"cut.webp": webp(noise)[:300]})
    entries = archives.zip_entries(spark, source)
    planned = convert.plan(convert.identify(entries))
    found = {r["path"][:-5]: pixels(r) for r in convert.decoded(planned.filter("path <> 'cut.webp'")).collect()}
    for name, (image, _) in cases.items():
        assert (found[name] == image).all(), name
    with pytest.raises(Exception, match="cut.webp error"):
        convert.decoded(planned.filter("path = 'cut.webp'")).collect()


def test_transparent_webp_lies_over_black(spark, tmp_path):
    image, alpha = gradient(20, 10), np.tile(np.arange(20) * 13, (10, 1))
    row = convert.decoded(convert.plan(convert.identify(archives.zip_entries(spark, archive(tmp_path / "a.zip", {"a.webp": webp(image, alpha)}))))).first()
    assert np.abs(pixels(row) - image * (alpha[:, :, None] / 255)).max() <= 0.5 + 1e-9


class Raw(registry.Decoder):
    """A format of its own: RAWP, width, height, bytes."""

    name, extensions, magic = "rawp", (".png",), b"RAWP"

    def size(self, content):
        return struct.unpack_from("<II", content, 4)

    def decode(self, content):
        w, h = self.size(content)
        return np.frombuffer(content, dtype=np.uint8, offset=12).reshape(h, w, 3)[:, :, ::-1]


class Text(registry.Encoder):
    name = ".txt"

    def encode(self, image, quality, progressive, optimize):
        return f"{image.shape[1]}x{image.shape[0]} {quality} {zlib.crc32(image.tobytes())}".encode()


def test_plugins_with_codecs_of_their_own(spark, tmp_path):
    formats = registry.Registry()
    for decoder in (registry.Png(), Raw()):
        formats.register_decoder(decoder)
    formats.register_encoder(Text())
    image = gradient(30, 20)
    source = archive(tmp_path / "p.zip", {"a.png": png(30, 20), "b.png": b"RAWP" + struct.pack("<II", 30, 20) + image.tobytes()})
    found = {r["out_path"]: bytes(r["out_content"]).decode() for r in convert.convert(archives.zip_entries(spark, source), formats=formats).collect()}
    assert found == {n: f"30x20 90 {zlib.crc32(image[:, :, ::-1].tobytes())}" for n in ("a.txt", "b.txt")}


def encrypted(path, name, content, password):
    """A zip whose one member has the traditional encryption."""
    table = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        table[i] = c
    keys = [0x12345678, 0x23456789, 0x34567890]

    def update(byte):
        keys[0] = keys[0] >> 8 ^ table[(keys[0] ^ byte) & 255]
        keys[1] = (keys[1] + (keys[0] & 255)) * 134775813 + 1 & 0xFFFFFFFF
        keys[2] = keys[2] >> 8 ^ table[(keys[2] ^ keys[1] >> 24) & 255]

    for byte in password.encode():
        update(byte)
    crc, out = zlib.crc32(content), bytearray()
    for byte in b"\0" * 11 + bytes([crc >> 24]) + content:
        k = keys[2] | 2
        out.append(byte ^ (k * (k ^ 1) >> 8 & 255))
        update(byte)
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 20, 1, 0, 0, 33, crc, len(out), len(content), len(name), 0) + name.encode() + bytes(out)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 20, 20, 1, 0, 0, 33, crc, len(out), len(content), len(name), 0, 0, 0, 0, 0, 0) + name.encode()
    path.write_bytes(local + central + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 1, 1, len(central), len(local), 0))
    return str(path)


def test_members_with_a_password(spark, tmp_path):
    source = encrypted(tmp_path / "s.zip", "a.png", png(7, 8), "geheim")
    assert bytes(archives.zip_entries(spark, source, password="geheim").first()["content"]) == png(7, 8)
    for wrong in (None, "other"):
        with pytest.raises(Exception, match="password|Bad"):
            archives.zip_entries(spark, source, password=wrong).collect()


def test_of_equal_names_the_last_one_counts(spark, tmp_path):
    with pytest.warns(UserWarning), zipfile.ZipFile(tmp_path / "e.zip", "w") as out:
        for content in (png(4, 4), bmp(5, 5), png(6, 6)):
            out.writestr("a.png", content)
    assert [bytes(r["content"]) for r in archives.zip_entries(spark, str(tmp_path / "e.zip")).collect()] == [png(6, 6)]


def test_workers():
    assert [archives.workers(n) for n in (1, 4, 5, 16)] == [4, 4, 4, 15]


def test_watched_members_keep_their_paths(spark, tmp_path):
    where = [str(tmp_path / n) for n in ("in", "out", "state")]
    for name, size in (("a/x.png", 20), ("b/x.png", 30), (".git/x.png", 5), ("a-b/x.png", 40)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(png(size, size))
    watch(spark, *where).awaitTermination()
    (tmp_path / "in/b/x.png").unlink()
    (tmp_path / "in/b/x.png").write_bytes(png(50, 50))
    watch(spark, *where).awaitTermination()
    found = [(r["path"], r["out_path"], r["width"]) for r in latest(spark, where[1]).collect()]
    assert [f[:2] for f in found] == [("a/x.png", "a/x.jpg"), ("a-b/x.png", "a-b/x.jpg"), ("b/x.png", "b/x.jpg")]
    assert found[2][2] in (30, 50)  # a stream takes a path once; where it takes it again, the later one counts
