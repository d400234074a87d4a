import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkflow.functions import magic, names, options, resizing
from inkflow.operators import registry, resample


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path, ext", [("a/B.JPG", ".jpg"), ("x.tar.PNG", ".png"), ("a.b/c", ""), (".png", ".png"), ("a", ""), ("a.png\n", "")])
def test_extension(spark, path, ext):
    assert one(spark, names.extension(F.lit(path))) == (ext if path != "a.png\n" else ".png\n")


@pytest.mark.parametrize("path, ext, out", [("A.JPG", ".jpg", "A.JPG.jpg"), ("a.png", ".png", "a.jpg"), ("d/b.jpeg", ".jpeg", "d/b.jpg")])
def test_renamed(spark, path, ext, out):
    assert one(spark, names.renamed(F.lit(path), F.lit(ext))) == out


@pytest.mark.parametrize("path, out", [("/d/x.zip", "/d/x_resize.zip"), ("/d/x.rar", "/d/x_resize.rar.zip"), ("/d/x", "/d/x_resize.zip"), ("/d.e/x", "/d.e/x_resize.zip")])
def test_default_output(spark, path, out):
    assert one(spark, names.default_output(F.lit(path))) == out


def test_walk_order(spark):
    rows = spark.createDataFrame([("a.png",), ("a-b/x.png",), ("a/x.png",)], "path string").orderBy(names.walk_key(F.col("path"))).collect()
    assert [r["path"] for r in rows] == ["a/x.png", "a-b/x.png", "a.png"]


@pytest.mark.parametrize("ratio, size, expected", [
    (70, (1600, 900), (1280, 720, True, False)), (70, (1280, 900), (1280, 900, False, False)), (70, (1281, 900), (1280, 899, True, False)),
    (70, (500, 800), (500, 800, False, True)), (70, (20000, 1000), (1280, 64, False, True)),
    (50, (1600, 900), (800, 450, True, False)), (50, (1001, 801), (501, 401, True, False)), (50, (900, 900), (450, 450, False, True)),
    (100, (10, 10), (10, 10, False, False)),
])
def test_plan(spark, ratio, size, expected):
    columns = resizing.plan(F.lit(size[0]), F.lit(size[1]), ratio)
    assert tuple(spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()) == expected


@pytest.mark.parametrize("content, engine", [
    (b"\xff\xd8rest", "jpeg"), (b"\x89PNG\r\n\x1a\nrest", "png"), (b"RIFFabcdWEBPVP8 ", "webp"), (b"RIFFabcdWEBPVP", None),
    (b"BMabcd\0\0\0\0rest", "bmp"), (b"BMabcd\0\0\0", None), (b"x", None), (b"", None), (None, None),
])
def test_engine(spark, content, engine):
    rows = spark.createDataFrame([(content,)], "c binary")
    assert rows.select(magic.engine(F.col("c"), registry.default().patterns())).first()[0] == engine


def test_options_give_null_for_what_is_refused(spark):
    assert [one(spark, options.percent(F.lit(t), 70)) for t in ("150", "-5", "+7", " 7 ", "x", "")] == [100, 70, 7, None, None, None]
    assert one(spark, options.charsets(F.lit("ja,ja-jp"))) == ["ShiftJIS", "ShiftJIS"]
    assert one(spark, options.charsets(F.lit("ja, zh"))) is None
    assert one(spark, options.kernel(F.lit("lanczos3"))) == "lanczos3" and one(spark, options.dct_method(F.lit("fast"))) is None


@given(st.integers(1, 300), st.integers(1, 300), st.sampled_from(sorted(resample.SHAPES)))
@settings(max_examples=60, deadline=None)
def test_weights_add_up_to_one(size, target, kernel):
    rows = resample.weights(size, target, kernel)
    assert len(rows) == target
    assert all(abs(sum(w for _, w in row) - 1) < 1e-9 and all(0 <= at < size for at, _ in row) for row in rows)


def test_registry():
    formats = registry.Registry()
    formats.register_decoder(registry.Png())
    with pytest.raises(registry.RegistryError):
        formats.register_decoder(registry.Png())
    with pytest.raises(registry.RegistryError):
        formats.encoder  # noqa: B018
    formats.register_encoder(registry.JpegEncoder())
    assert formats.encoder.name == ".jpg" and registry.default().extensions() == [".jpg", ".jpeg", ".bmp", ".png", ".webp"]


def test_webp_sizes():
    webp = registry.Webp()
    assert webp.size(b"RIFF....WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == (100, 50)
    assert webp.size(b"RIFF....WEBPVP8 " + b"\0" * 4 + b"\0\0\0\x9d\x01\x2a" + (320).to_bytes(2, "little") + (200).to_bytes(2, "little")) == (320, 200)
    assert webp.size(b"RIFF....WEBPVP8L" + b"\0" * 4 + b"\x2f" + (9 | 19 << 14).to_bytes(4, "little")) == (10, 20)
    assert webp.size(b"RIFF") is None
