"""Archives by ranges, filters below the reading, the zip sink by tasks, other file systems."""

import io
import os
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from inkflow.config import Config, OptionError
from inkflow.operators import convert
from inkflow.plans import conversion
from inkflow.sources import archives, files, zips
from tests.pictures import archive, png

GIB = 1 << 30


def entries(frame):
    return {r["path"]: bytes(r["content"]) for r in frame.collect()}


def bytes_read(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def sparse(path, places):
    """A stored archive whose members begin at the given places, with holes between them."""
    body = {f"{i:02}.png": png(4 + i, 4) for i in range(len(places))}
    with zipfile.ZipFile(path, "w") as out:
        for (name, content), at in zip(body.items(), places, strict=True):
            out.start_dir = at
            out.writestr(name, content)
    return body


@pytest.mark.parametrize("size", [3, 6])
def test_a_large_archive_is_read_by_many_tasks_without_the_rest(spark, tmp_path, size):
    body = sparse(tmp_path / "large.zip", [i * size * GIB // 12 for i in range(12)])
    assert (tmp_path / "large.zip").stat().st_size > size * GIB * 11 // 12
    before = bytes_read(spark)
    found = archives.zip_entries(spark, str(tmp_path / "large.zip"))
    assert entries(found) == body
    assert bytes_read(spark) - before < 1 << 20
    assert found.select(F.spark_partition_id()).distinct().count() >= 3


def test_no_content_crosses_a_shuffle_or_a_python_worker(spark, tmp_path):
    source = archive(tmp_path / "a.zip", {"a.png": png(4, 4)})
    for frame in (archives.zip_entries(spark, source), archives.folder_entries(spark, str(tmp_path)), convert.convert(archives.zip_entries(spark, source)), convert.manifest(archives.zip_entries(spark, source))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        below = plan[plan.index("inkflow_member") :] if "inkflow_member" in plan else plan
        assert "Exchange" in below and "content" not in below[below.index("Exchange") :]


def test_filters_go_below_the_reading(spark, tmp_path):
    noise = random.Random(1).randbytes(3 << 20)
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as out:
        for name in ("a.png", "big.png", "big.jpg", "notes.txt", ".git/x.png"):
            out.writestr(name, noise if "big" in name or name[0] in "n." else png(5, 5))
    raw = bytearray((tmp_path / "f.zip").read_bytes())
    at = raw.index(b"big.png") + 100
    raw[at] ^= 255  # reading that member would fail
    (tmp_path / "f.zip").write_bytes(bytes(raw))
    found = archives.zip_entries(spark, str(tmp_path / "f.zip")).filter("ext = '.png' and path not like 'big%'")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inkflow_member") < plan.index("big") and "(ext" not in plan
    before = bytes_read(spark)
    assert entries(found) == {"a.png": png(5, 5)}
    assert bytes_read(spark) - before < 1 << 18
    before = bytes_read(spark)
    assert archives.zip_entries(spark, str(tmp_path / "f.zip")).select("path", "size").count() == 3  # no content, nothing read
    assert bytes_read(spark) - before < 1 << 18
    with pytest.raises(Exception, match="big.png"):
        archives.zip_entries(spark, str(tmp_path / "f.zip")).collect()


def jpeg(width, height, before, behind):
    """A JPEG's headers behind `before` bytes of metadata, and bytes that stand for the picture."""
    segment = lambda kind, body: b"\xff" + bytes([kind]) + (len(body) + 2).to_bytes(2, "big") + body
    meta = b"".join(segment(0xE1, b"\xff\xc0" * 30000) for _ in range(before // 60000))
    return b"\xff\xd8" + meta + segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\1\1\x11\0") + behind


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2])
def test_a_preview_reads_headers_only(spark, tmp_path, method):
    noise = random.Random(4).randbytes(8 << 20)
    inside = {"a.jpg": jpeg(640, 480, 0, noise), "deep.jpg": jpeg(1600, 900, 1 << 20, noise), "p.png": png(30, 20)[:33] + noise, "b.bmp": png(9, 9), "short.jpg": b"\xff\xd8" + b"\xff\xc0\0\x0b\x08\0\5\0\6\1"}
    with zipfile.ZipFile(tmp_path / "h.zip", "w", method) as out:
        for name, content in inside.items():
            out.writestr(name, content)
            (tmp_path / "pages").mkdir(exist_ok=True)
            (tmp_path / "pages" / name).write_bytes(content)
    want = {("a.jpg", "jpeg", 640, 480), ("deep.jpg", "jpeg", 1600, 900), ("p.png", "png", 30, 20), ("b.bmp", "png", 9, 9), ("short.jpg", "jpeg", 6, 5)}
    for source in ("h.zip", "pages"):
        before = bytes_read(spark)
        found = conversion.preview(spark, Config(str(tmp_path / source))).collect()
        assert {(r["path"], r["engine"], r["width"], r["height"]) for r in found} == want
        if method != zipfile.ZIP_BZIP2:
            assert bytes_read(spark) - before < 4 << 20
        whole = convert.manifest(conversion.entries(spark, Config(str(tmp_path / source)))).collect()
        assert sorted(map(tuple, whole)) == sorted(map(tuple, found))
    (tmp_path / "pages" / "no.jpg").write_bytes(b"\xff\xd8\xff\xe0\xff\xff cut")
    with pytest.raises(Exception, match="no.jpg error, unknown image"):
        conversion.preview(spark, Config(str(tmp_path / "pages"))).collect()


def test_folders_are_no_rows(spark, tmp_path):
    """Root markers and folders, also such as are listed twice, give no rows; what lies in them does."""
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as out, pytest.warns(UserWarning):
        for name in ("/", "./", "d.png/", "d.png/a.png", "d.png/"):
            out.writestr(name, b"x" if name.endswith("a.png") else b"")
    assert [r["path"] for r in archives.zip_members(spark, str(tmp_path / "f.zip")).collect()] == ["d.png/a.png"]


def test_a_row_keeps_its_header_and_drops_its_content(spark, tmp_path):
    source = archive(tmp_path / "a.zip", {"a.png": png(30, 20), "b.png": png(10, 40)})
    converted = convert.convert(archives.zip_entries(spark, source))
    assert {"content", "picture"}.isdisjoint(converted.columns)
    assert {(r["path"], r["engine"], r["width"], r["height"]) for r in converted.collect()} == {("a.png", "png", 30, 20), ("b.png", "png", 10, 40)}


def test_git_of_a_folder_is_not_listed(spark, tmp_path):
    inside = {".git/a.png": b"x", ".git/deep/b.png": b"x", "x/.git/c.png": b"c", "_d/_e.png": b"e", ".f.png": b"f", "a:b/g h%20.png": b"g", "t.txt": b"t", "h.PNG": b"h", ".gitx/i.png": b"i", "[1]/j.png": b"j"}
    for name, content in inside.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    os.chmod(tmp_path / ".git", 0)
    try:
        listed = {r["path"] for r in archives.folder_members(spark, str(tmp_path)).collect()}
    finally:
        os.chmod(tmp_path / ".git", 0o755)
    assert listed == {n for n in inside if not n.startswith(".git/")}
    assert entries(archives.folder_entries(spark, str(tmp_path))) == {n: c for n, c in inside.items() if not n.startswith(".git/") and n != "t.txt"}
    (tmp_path / "empty").mkdir()
    assert archives.folder_entries(spark, str(tmp_path / "empty")).collect() == []


def test_every_packing_and_name(spark, tmp_path):
    body = png(40, 30)
    with zipfile.ZipFile(tmp_path / "book [1] _x%.zip", "w") as out:
        for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA):
            out.writestr(f"日本/{method}.png", body, method)
        out.writestr("empty.png", b"", zipfile.ZIP_DEFLATED)
        out.writestr("folder.png/", b"")
        with pytest.warns(UserWarning):
            out.writestr("empty.png", b"second")
        out.comment = b"PK\5\6 a comment"
    want = {f"日本/{m}.png": body for m in (0, 8, 12, 14)} | {"empty.png": b"second"}
    assert entries(archives.zip_entries(spark, str(tmp_path / "book [1] _x%.zip"))) == want
    # Behind other bytes, as in a program that unpacks itself; found by its folder, and by a pattern.
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/self.ZIP").write_bytes(b"#!" * 500 + (tmp_path / "book [1] _x%.zip").read_bytes())
    archive(tmp_path / "sub/other.zip", {"z.png": b"z"})
    assert entries(archives.zip_entries(spark, str(tmp_path / "sub"))) == want | {"z.png": b"z"}
    assert entries(archives.zip_entries(spark, str(tmp_path / "s*/*.zip"))) == {"z.png": b"z"}


@pytest.mark.parametrize("charset, codec, name", [("ShiftJIS", "cp932", "日本.png"), ("GB18030", "gb18030", "中国.png"), ("EUC-KR", "cp949", "한국.png")])
def test_names_in_other_charsets(spark, tmp_path, charset, codec, name):
    raw = name.encode(codec)
    content = archive(tmp_path / "n.zip", {"A" * (len(raw) - 4) + ".png": b"x"})
    patched = (tmp_path / "n.zip").read_bytes().replace(b"A" * (len(raw) - 4), raw[:-4])
    (tmp_path / "n.zip").write_bytes(patched)
    assert [r["path"] for r in archives.zip_members(spark, content, [charset]).collect()] == [name]


def test_a_name_that_no_charset_fits_fails(spark, tmp_path):
    content = archive(tmp_path / "n.zip", {"A.png": b"x"})
    (tmp_path / "n.zip").write_bytes((tmp_path / "n.zip").read_bytes().replace(b"A.png", b"\x85.png"))
    with pytest.raises(Exception, match="no charset"):
        archives.zip_members(spark, content, ["ShiftJIS"]).collect()


@pytest.mark.parametrize("damage, message", [(lambda b: b[:-30], "not a zip"), (lambda b: b"", "not a zip"), (lambda b: b[:60] + b"\0" * 4 + b[64:], "checksum|a.png"), (lambda b: b.replace(b"PK\3\4", b"PK\3\5"), "no local header"), (lambda b: b.replace(b"PK\1\2", b"PK\1\3"), "magic")])
def test_damaged_archives(spark, tmp_path, damage, message):
    source = archive(tmp_path / "d.zip", {"a.png": png(64, 64)})
    (tmp_path / "d.zip").write_bytes(damage((tmp_path / "d.zip").read_bytes()))
    with pytest.raises(Exception, match=message):
        archives.zip_entries(spark, source).collect()


def rows(spark, members):
    return spark.createDataFrame([(p, o, c, False) for p, o, c in members], "path string, out_path string, out_content binary, warn_small boolean").repartition(5)


def test_the_sink_equals_a_zip_written_in_walk_order(spark, tmp_path):
    rng = random.Random(3)
    members = [(p, f"{p}.jpg", rng.randbytes(rng.randint(0, 5000))) for p in [f"{a}{b}/{c}" for a in ("a", "a-b", "é", "a/b") for b in ("", "x") for c in range(30)]] + [("a.png", "same", b"1"), ("a.jpg", "same", b"2")]
    assert zips.write_zip(rows(spark, members), str(tmp_path / "out.zip")) == len(members)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as want, pytest.warns(UserWarning):
        for _, name, content in sorted(members, key=lambda m: m[0].split("/")):
            want.writestr(zipfile.ZipInfo(name), content)
    with zipfile.ZipFile(tmp_path / "out.zip") as got, zipfile.ZipFile(buffer) as want:
        assert got.testzip() is None
        facts = lambda z: [(i.filename, i.file_size, i.compress_size, i.CRC, i.date_time, i.external_attr, i.flag_bits, i.compress_type, i.create_system, i.extract_version, z.read(i)) for i in z.infolist()]
        assert facts(got) == facts(want)
    assert os.listdir(tmp_path) == ["out.zip"]
    assert entries(archives.zip_entries(spark, str(tmp_path / "out.zip"))) == {n: c for _, n, c in members if n != "same"}


def test_a_taken_name_stays_and_nothing_is_left(spark, tmp_path):
    (tmp_path / "out.zip").write_bytes(b"mine")
    with pytest.raises(FileExistsError):
        zips.write_zip(rows(spark, [("a", "a.jpg", b"x")]), str(tmp_path / "out.zip"))
    assert (tmp_path / "out.zip").read_bytes() == b"mine" and os.listdir(tmp_path) == ["out.zip"]


def test_a_failing_row_leaves_nothing(spark, tmp_path):
    broken = rows(spark, [(f"{i}", f"{i}.jpg", b"x" * 1000) for i in range(50)]).withColumn("out_content", F.when(F.col("path") == "37", F.raise_error(F.lit("no good"))).otherwise(F.col("out_content")))
    with pytest.raises(Exception, match="no good"):
        zips.write_zip(broken, str(tmp_path / "out.zip"))
    assert os.listdir(tmp_path) == []


def test_part_files_that_the_driver_does_not_see(spark, tmp_path):
    members = spark.createDataFrame([("a", "a.jpg", False, f"{tmp_path}/bodies-0", 0, 1, 0)], "path string, out_path string, warn_small boolean, file string, at long, size long, crc long")
    with pytest.raises(OSError, match="share the output's folder"):
        zips._finish(spark, members, str(tmp_path))


def test_an_output_over_4_gib(spark, tmp_path):
    """Part files as tasks leave them, with holes for contents of zeros; 70,000 members besides."""
    size, part, zeros, crc = 1_700_000_000, tmp_path / "parts" / "bodies-0", b"\0" * (1 << 24), 0
    part.parent.mkdir()
    for at in range(0, size, len(zeros)):
        crc = zlib.crc32(zeros[: size - at], crc)
    found, at = [], 0
    with open(part, "wb") as out:
        for i, (length, sum_) in enumerate([(size, crc)] * 3 + [(1, zlib.crc32(b"x"))] * 70_000):
            name = f"{i:05}.jpg"
            out.seek(at)
            out.write(b"PK\3\4\x14\0\0\0\0\0\0\0\x21\0" + sum_.to_bytes(4, "little") + length.to_bytes(4, "little") * 2 + len(name).to_bytes(2, "little") + b"\0\0" + name.encode() + (b"x" if length == 1 else b""))
            found.append((f"{i:05}.png", name, False, str(part), at, length, sum_))
            at += 30 + len(name) + length
        out.truncate(at)
    members = spark.createDataFrame(found, "path string, out_path string, warn_small boolean, file string, at long, size long, crc long")
    assert zips._finish(spark, members, str(part.parent)) == len(found)
    with zipfile.ZipFile(part.parent / "whole") as out:
        infos = out.infolist()
        assert [i.filename for i in infos] == [f[1] for f in found] and infos[-1].header_offset > 4 * GIB
        assert out.read(infos[3]) == out.read(infos[-1]) == b"x"
    assert archives.zip_members(spark, str(part.parent / "whole")).count() == len(found)


@pytest.fixture
def box(spark, tmp_path):
    """The folder by a scheme that only Hadoop's file systems know."""
    name = f"box{abs(hash(str(tmp_path)))}"
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./data", f"file:{tmp_path}")
    return f"viewfs://{name}/data"


def test_source_and_output_by_another_scheme(spark, tmp_path, box):
    inside = {"b/a.png": png(1600, 900), "a.png": png(600, 300), "t.txt": b"t"}
    archive(tmp_path / "book.zip", inside)
    config = Config(f"{box}/book.zip", delete_source=True)
    assert config.output == f"{box}/book_resize.zip"
    assert conversion.run(spark, config) == 2
    assert [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == ["book_resize.zip"]  # checksums of the local file system behind the scheme
    archive(tmp_path / "book.zip", inside)
    assert conversion.run(spark, Config(f"file://{tmp_path}/book.zip", output=f"file:{tmp_path}/local")) == 2
    with zipfile.ZipFile(tmp_path / "book_resize.zip") as a, zipfile.ZipFile(tmp_path / "local.zip") as b:
        assert a.namelist() == b.namelist() == ["a.jpg", "b/a.jpg"] and [a.read(n) for n in a.namelist()] == [b.read(n) for n in b.namelist()]
    with pytest.raises(OptionError, match="exists"):
        conversion.run(spark, Config(f"{box}/book.zip"))
    with pytest.raises(OptionError, match="does not exist"):
        conversion.run(spark, Config(f"{box}/none.zip"))
    with pytest.raises(FileExistsError):
        zips.write_zip(rows(spark, [("a", "a.jpg", b"x")]), f"{box}/book_resize.zip")
    for name, content in inside.items():
        (tmp_path / "pages" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "pages" / name).write_bytes(content)
    assert conversion.run(spark, Config(f"{box}/pages", delete_source=True)) == 2
    assert (tmp_path / "pages").exists()  # a folder with files in it isn't deleted, which is logged
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".part")]


def test_files(spark, tmp_path):
    (tmp_path / "a b%20[x]").write_bytes(b"Rar!xyz")
    path = str(tmp_path / "a b%20[x]")
    assert files.exists(spark, path) and not files.is_folder(spark, path) and files.head(spark, path, 4) == b"Rar!" and files.head(spark, path, 99) == b"Rar!xyz"
    assert files.is_folder(spark, str(tmp_path))
    files.delete(spark, path)
    assert not files.exists(spark, path)
    with pytest.raises(OSError):
        files.delete(spark, path)
