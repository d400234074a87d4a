"""The filter audit against a plain simulation of every order."""

import random
import re
from itertools import permutations

import duckdb
import pytest

from inkflow.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """Per row, the set of failing filters."""
    found = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        bad = set()
        if len(words) < 100:
            bad.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            bad.add("C")
        if re.search(r"[#$%&*|]", text):
            bad.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
            bad.add("E")
        found.append(bad)
    return found


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    result = {}
    bad = fails(rows)
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, b) for (i, _, lang), b in zip(rows, bad, strict=True) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = list(mine)
            for step, f in enumerate(order, 1):
                gone = [(i, b) for i, b in alive if f in b]
                alive = [(i, b) for i, b in alive if f not in b]
                shapley[f] += len(gone)
                redundant = sum(1 for _, b in mine if f in b) - len(gone)
                result[part, "".join(order), step] = [len(alive), len(gone), redundant, sum(1 for _, b in mine if b == {f}), sum(1 for i, _ in gone if i in good), sum(1 for i, _ in gone if i in toxic)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                result[part, "".join(order), step].append(shapley[f])
    return result


def found(frame):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in frame.collect()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, "x", 1) for i, t, lang in rows], "doc_id long, text string, lang string, mask string, run int")
    marks = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, n string")
    return found(audit.interactions(audit.counters(audit.masked(docs).cache(), marks)))


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [" ".join(word() for _ in range(n)) for n in (99, 100, 101, 150)] + ["w " * 120, "A" * 11 + "b" * 89, "A" * 10 + "b" * 90, "x # y", "", " \n", None, "é" * 90 + "B" * 10, "é" * 89 + "B" * 10]
    rows = [(rng.randrange(60), rng.choice(base) if rng.random() < 0.7 else base[3], rng.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [(None, base[3], "en"), (None, base[3], "en"), (None, None, None), (7, base[2], "fr"), (7, base[2], "fr")]
    labels = [(rng.randrange(80), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1)]
    return rows, labels


def test_every_order(spark, mixed):
    assert run(spark, *mixed) == brute(*mixed)


def test_few_rows_may_be_sent(spark, mixed, monkeypatch):
    monkeypatch.setattr(audit, "BROADCAST_ROWS", 0)
    assert run(spark, *mixed) == brute(*mixed)


def test_copies_over_many_ranges(spark):
    """A hot text is cut by doc_id, so its copies meet over the edges of tasks."""
    rows = [(i, "the same text", "en") for i in range(400)] + [(400 + i, f"text {i % 5}", "en") for i in range(100)]
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string, lang string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        masks = {r["doc_id"]: r["mask"] for r in audit.masked(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted(i for i, m in masks.items() if not m & audit.COPY) == [0, 400, 401, 402, 403, 404]


def test_equal_fingerprints_of_different_texts():
    """Texts are compared whole, and all texts of a task's first and last fingerprint are edges."""
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_pylist([{"print": p, "text": t, "doc_id": i, "part": ""} for p, t, i in rows])
    out = [r for b in audit._masks(3, iter([batch([(1, b"a", 1), (1, b"a", 2), (1, b"b", 1)]), batch([(1, b"b", 5), (2, b"c", 1), (3, b"d", 4), (3, b"d", None), (3, b"e", None)])])) for r in b.to_pylist()]
    rows, edges = [r for r in out if r["edge_text"] is None], [r for r in out if r["edge_text"] is not None]
    assert [(r["doc_id"], bool(r["mask"] & audit.COPY)) for r in rows] == [(1, False), (2, True), (1, False), (5, True), (1, False), (4, False), (None, False), (None, False)]
    assert [(e["edge_print"], e["edge_text"], e["doc_id"]) for e in edges] == [(1, b"a", 1), (1, b"b", 1), (3, b"d", 4), (3, b"e", None)]
    assert len({r["run"] for r in rows}) == 5 and {e["run"] for e in edges} <= {r["run"] for r in rows}


def test_no_rows(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.counters(audit.masked(no_docs), labels)).collect() == []


def test_the_query_equals_its_sql_on_odd_texts(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(8, 1, 0), (10, 1, 1), (10, 0, 1), (None, 1, 1), (21, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    frame = audit.op12_audit(spark, str(tmp_path))
    want = con.sql(audit.ORACLE)
    order = [want.columns.index(c) for c in frame.columns]
    assert sorted(tuple(r) for r in frame.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
