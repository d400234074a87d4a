import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkflow.__main__ import main
from inkflow.config import Config, Jpeg
from inkflow.log import set_up
from inkflow.operators import convert, registry, resample
from inkflow.plans import conversion
from inkflow.sources import archives
from inkflow.streaming.watch import watch
from tests.pictures import archive, bmp, gradient, png


def sizes(path):
    with zipfile.ZipFile(path) as z:
        return [(i.filename, registry.Jpeg().size(z.read(i))) for i in z.infolist()]


def test_zip_to_zip(spark, tmp_path):
    wide = png(1600, 900)
    source = archive(tmp_path / "book.zip", {
        "a-b/x.png": png(600, 300), "a.png": wide, "a/x.PNG": png(10, 10), "b.bmp": bmp(700, 200), "notes.txt": b"no", "none": b"",
        ".git/i.png": png(3, 3), "x/.git/i.png": png(520, 110), "c.jpg": png(640, 480), "a.jpg": png(640, 200), "dir/": b"",
    })
    config = Config(source, jpeg=Jpeg(quality=80, optimize=True, progressive=True))
    assert conversion.run(spark, config) == 7
    assert config.output == str(tmp_path / "book_resize.zip")
    assert sizes(config.output) == [("a/x.PNG.jpg", (10, 10)), ("a-b/x.jpg", (600, 300)), ("a.jpg", (640, 200)), ("a.jpg", (1280, 720)), ("b.jpg", (700, 200)), ("c.jpg", (640, 480)), ("x/.git/i.jpg", (520, 110))]


def test_manifest_of_a_folder_equals_the_zip_s(spark, tmp_path):
    inside = {"p/q/a.png": png(1600, 900), "p/b c+d%.BMP": bmp(30, 20), "t.txt": b"x", ".git/z.png": b"junk"}
    for name, content in inside.items():
        (tmp_path / "folder" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "folder" / name).write_bytes(content)
    columns = ["path", "ext", "size", "engine", "width", "height", "target_w", "target_h", "do_resize", "warn_small", "out_path", "name_collision"]
    plan = lambda e: sorted(map(tuple, convert.manifest(e).select(*columns).collect()))
    from_zip = plan(archives.zip_entries(spark, archive(tmp_path / "f.zip", inside)))
    assert from_zip == plan(archives.folder_entries(spark, str(tmp_path / "folder")))
    assert from_zip == [("p/b c+d%.BMP", ".bmp", len(inside["p/b c+d%.BMP"]), "bmp", 30, 20, 30, 20, False, True, "p/b c+d%.BMP.jpg", False), ("p/q/a.png", ".png", len(inside["p/q/a.png"]), "png", 1600, 900, 1280, 720, True, False, "p/q/a.jpg", False)]


def test_collisions_are_flagged(spark, tmp_path):
    rows = archives.zip_entries(spark, archive(tmp_path / "c.zip", {"a.png": png(9, 9), "a.jpg": png(9, 9), "b.png": png(9, 9)})).transform(convert.manifest).collect()
    assert {r["path"]: r["name_collision"] for r in rows} == {"a.png": True, "a.jpg": True, "b.png": False}


@pytest.mark.parametrize("content", [b"just text", b"x", b""])
def test_an_unknown_picture_fails_and_leaves_nothing(spark, tmp_path, content):
    source = archive(tmp_path / "u.zip", {"ok.png": png(8, 8), "a.jpg": content})
    with pytest.raises(Exception, match="unknown image"):
        conversion.run(spark, Config(source))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["u.zip"]


def test_a_damaged_member_fails(spark, tmp_path):
    source = archive(tmp_path / "d.zip", {"a.png": png(64, 64)})
    raw = bytearray((tmp_path / "d.zip").read_bytes())
    raw[80] ^= 0xFF
    (tmp_path / "d.zip").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="a.png"):
        conversion.run(spark, Config(source))


def test_an_archive_without_pictures_gives_an_empty_zip(spark, tmp_path):
    config = Config(archive(tmp_path / "e.zip", {"a.txt": b"x"}))
    assert conversion.run(spark, config) == 0 and sizes(config.output) == []


def test_each_session_gets_its_codecs(spark, tmp_path):
    source = archive(tmp_path / "n.zip", {"a.png": png(8, 8)})
    for session in (spark, spark.newSession(), spark.newSession()):
        assert convert.convert(archives.zip_entries(session, source)).count() == 1
        assert len(bytes(convert.convert(archives.zip_entries(session, source)).first()["out_content"])) > 100


def test_one_archive_is_dealt_to_many_tasks(spark, tmp_path):
    source = archive(tmp_path / "m.zip", {f"{i:03}.png": png(4, 4) for i in range(60)})
    entries = archives.zip_entries(spark, source, partitions=4)
    assert entries.select(F.spark_partition_id()).distinct().count() == 4


def test_lossy_webp_is_recognised_but_not_decoded(spark, tmp_path):
    body = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    entries = archives.zip_entries(spark, archive(tmp_path / "w.zip", {"a.webp": body}))
    row = convert.identify(entries).first()
    assert (row["engine"], row["width"], row["height"]) == ("webp", 100, 50)
    with pytest.raises(Exception, match="a.webp error, no decoder for webp"):
        convert.convert(entries).collect()


def test_pixels_survive(spark, tmp_path):
    entries = archives.zip_entries(spark, archive(tmp_path / "p.zip", {"a.png": png(120, 80)}))
    picture = convert.decoded(convert.plan(convert.identify(entries))).first()["picture"]
    assert (np.frombuffer(picture["data"], dtype=np.uint8).reshape(80, 120, 3)[:, :, ::-1] == gradient(120, 80)).all()
    for progressive in (False, True):
        jpeg = convert.convert(entries, ratio=100, jpeg=Jpeg(quality=95, progressive=progressive)).first()["out_content"]
        back = archives.zip_entries(spark, archive(tmp_path / f"q{progressive}.zip", {"a.jpg": bytes(jpeg)}))
        again = convert.decoded(convert.plan(convert.identify(back))).first()["picture"]
        error = np.frombuffer(again["data"], dtype=np.uint8).astype(float) - np.frombuffer(picture["data"], dtype=np.uint8)
        assert 10 * np.log10(255**2 / (error**2).mean()) > 28


@pytest.mark.parametrize("kernel", sorted(resample.SHAPES))
def test_resampling(kernel):
    flat = np.full((30, 40, 3), 77, dtype=np.uint8)
    assert (resample.resample(flat, 13, 9, kernel) == 77).all()
    image = gradient(40, 30)
    assert (resample.resample(image, 40, 30, kernel) == image).all()
    assert resample.resample(image, 20, 15, kernel).shape == (15, 20, 3)


def test_command_line(spark, tmp_path, caplog):
    source = archive(tmp_path / "cli.zip", {"a.png": png(8, 8)})
    assert main([source, "-o", str(tmp_path / "new"), "-r", "50", "-q", "150", "--resize-mode", "bicubic", "--charset", "ko", "--show-time"]) == 0
    assert sizes(tmp_path / "new.zip") == [("a.jpg", (8, 8))]
    assert main([source, "-o", str(tmp_path / "new")]) == 1 and "exists" in caplog.text
    assert main([source, "--ratio", "abc"]) == 1 and "whole number" in caplog.text


def test_log_streams(capsys):
    log = set_up()
    log.info("low")
    log.warning("high")
    log.debug("none")
    found = capsys.readouterr()
    assert (found.out, found.err) == ("INFO low\n", "WARNING high\n")


def test_small_pictures_warn(spark, tmp_path, caplog):
    conversion.run(spark, Config(archive(tmp_path / "s.zip", {"small.png": png(8, 8), "wide.png": png(900, 300)})))
    assert [r.getMessage() for r in caplog.records if r.levelname == "WARNING"] == ["small.png is too small to be resampled"]


def test_delete_source(spark, tmp_path):
    source = archive(tmp_path / "x.zip", {"a.png": png(8, 8)})
    conversion.run(spark, Config(source, delete_source=True))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x_resize.zip"]


def test_watching_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where = [str(tmp_path / n) for n in ("in", "out", "state")]
    (tmp_path / "in/a.png").write_bytes(png(1600, 900))
    watch(spark, *where).awaitTermination()
    (tmp_path / "in/b.png").write_bytes(png(20, 20))
    watch(spark, *where).awaitTermination()
    rows = spark.read.parquet(where[1]).orderBy("path").collect()
    assert [(r["out_path"], registry.Jpeg().size(bytes(r["out_content"]))) for r in rows] == [("a.jpg", (1280, 720)), ("b.jpg", (20, 20))]


def test_rar_needs_its_module(spark, tmp_path):
    with pytest.raises(archives.ArchiveError, match="rarfile"):
        archives.rar_entries(spark, str(tmp_path))


def test_entries_read_stored_members(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.png", png(5, 6))
    (tmp_path / "s.zip").write_bytes(buffer.getvalue())
    assert bytes(archives.zip_entries(spark, str(tmp_path / "s.zip")).first()["content"]) == png(5, 6)
