"""Archives that appear in a folder, with failures in the middle of one."""

import os

import pytest

from inkflow.operators import registry
from inkflow.streaming import watch
from tests.pictures import archive, png


class Fragile(registry.Png):
    """Decodes nothing as long as a file exists, but only for pictures of one width."""

    def __init__(self, stop):
        self.stop = str(stop)

    def size_column(self, content):
        return None

    def size(self, content):
        found = super().size(content)
        if found[0] == 77 and os.path.exists(self.stop):
            raise RuntimeError("lost")
        return found


def formats(stop):
    built = registry.Registry()
    built.register_decoder(Fragile(stop))
    built.register_encoder(registry.JpegEncoder())
    return built


def members(frame):
    return sorted((os.path.basename(r["archive"]), r["path"], registry.Jpeg().size(bytes(r["out_content"]))) for r in frame.collect())


def test_a_restart_in_the_middle_of_an_archive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where = [str(tmp_path / n) for n in ("in", "out", "state")]
    inside = {f"{i:02}.png": png(77 if i == 25 else 40, 30 + i) for i in range(40)}
    size = os.path.getsize(archive(tmp_path / "in/a.zip", inside))
    stop = tmp_path / "stop"
    stop.touch()
    run = lambda: watch.watch_archives(spark, *where, admitted=size // 6, formats=formats(stop)).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    batch = tmp_path / "out/batch=0"
    finished = {p.name: p.stat().st_mtime_ns for p in batch.glob("slice=*/_SUCCESS")} and {p.parent.name: p.stat().st_mtime_ns for p in batch.glob("slice=*/_SUCCESS")}
    assert 0 < len(finished) < 7
    stop.unlink()
    run()
    assert {k: (batch / k / "_SUCCESS").stat().st_mtime_ns for k in finished} == finished  # what was done wasn't done again
    rows = spark.read.parquet(where[1])
    assert members(rows) == sorted(("a.zip", n, (77 if n == "25.png" else 40, 30 + int(n[:2]))) for n in inside)
    archive(tmp_path / "in/b.ZIP", {"x/y.png": png(9, 8), "no.txt": b"no"})
    archive(tmp_path / "in/c.zip", {})
    run()
    assert members(watch.latest(spark, where[1]))[-1] == ("b.ZIP", "x/y.png", (9, 8)) and watch.latest(spark, where[1]).count() == 41
    run()
    assert spark.read.parquet(where[1]).count() == 41


def test_batches_admit_archives_by_their_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where = [str(tmp_path / n) for n in ("in", "out", "state")]
    sizes = [os.path.getsize(archive(tmp_path / f"in/{i}.zip", {f"{k}.png": png(20, 20) for k in range(5)})) for i in range(4)]
    watch.watch_archives(spark, *where, admitted=max(sizes) * 2 + 10).awaitTermination()
    batches = spark.read.parquet(where[1]).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in batches) == [10, 10]
