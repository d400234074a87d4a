"""Filter interaction audit: which of five filters removes what, in each of their orders.

Copies are found by sorting: rows are dealt by ranges of (fingerprint, doc_id), sorted by fingerprint, whole text and
doc_id, and each is compared with its predecessor. A text whose copies lie in several ranges belongs to the first or the last
fingerprint of each of them; a task gives these few texts away as edges, and a small second step compares them. Every row
becomes a mask of the filters that it fails; masks are counted by part, and all orders are read off these counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import lean, stage, table

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, b"#$%&*|"
#: Rows of a small side (labels, edges) sent to every executor at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
_UPPER, _FOLLOWING = bytes(range(ord("A"), ord("Z") + 1)), bytes(range(0x80, 0xC0))
COPY = 1 << LETTERS.index("E")
MASKED = "doc_id long, part string, mask int, run long, edge_print long, edge_text binary"


def mask_of(text: bytes) -> int:
    """The filters A to D that a text fails, a bit each. bytes.split() takes \\x20 and \\x09 to \\x0D as white space."""
    words = text.split()
    capitals, points = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _FOLLOWING))
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * points, any(c in text for c in SIGNS))
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def _masks(task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's rows, sorted by (print, text, doc_id, nulls last): MASKED rows, and edges (doc_id: the smallest of the run, part null).

    A run is a stretch of equal texts; its number is unique among all tasks.
    """
    first = now = text = least = None
    run, mask = task << 33, 0
    open_: list[tuple] = []  # the current fingerprint's runs
    for batch in batches:
        texts = batch.column("text")
        same = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_pylist() if len(texts) > 1 else []
        found: list[tuple] = []
        for i, (mark, doc_id, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("print", "doc_id", "part")), strict=True)):
            if mark != now:
                found += open_ if now is not None and now == first else []
                first, now, open_ = mark if first is None else first, mark, []
                fresh = True
            else:
                fresh = not same[i - 1] if i else texts[0].as_py() != text
            if fresh:
                text, least, run = texts[i].as_py(), doc_id, run + 1
                mask = mask_of(text)
                open_.append((least, None, None, run, mark, text))
            found.append((doc_id, part, mask | (COPY if doc_id is not None and least is not None and doc_id > least else 0), run, None, None))
        yield _batch(found)
    yield _batch(open_)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in MASKED.split(", ")])


def _few(side: DataFrame) -> bool:
    return side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask for each row of docs: bit i is set where the text fails filter LETTERS[i].

    A null text is empty, a null lang the part "". A text is a copy (E) where another row has the same text
    and a smaller doc_id; a row without doc_id is neither a copy nor an original, and rows that repeat with their doc_id aren't each other's copies.
    No rows give none. Each whole text crosses one shuffle; ranges split equal texts by doc_id, and their keys hold no text,
    since Spark samples keys on the driver.
    """
    # The cast to bytes keeps texts as they are stored; equal bytes are equal texts.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    dealt = rows.withColumn("print", F.xxhash64("text")).repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", F.asc_nulls_last("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _masks(TaskContext.get().partitionId(), batches)

    found = stage(dealt.mapInArrow(lean(run), MASKED))
    edges = found.filter("edge_text is not null").select("run", F.col("doc_id").alias("least"), "edge_print", "edge_text")
    # Of a text that several tasks hold, the smallest doc_id of all, for the runs that begin after it.
    overall = edges.filter("least is not null").groupBy("edge_print", "edge_text").agg(F.min("least").alias("overall"), F.count("*").alias("n")).filter("n > 1")
    later = stage(edges.join(overall, ["edge_print", "edge_text"]).filter("least > overall").select("run", "overall"))
    copy = F.when(F.col("doc_id") > F.col("overall"), COPY).otherwise(0)
    own = found.filter("edge_text is null").select("doc_id", "part", "mask", "run").join(F.broadcast(later) if _few(later) else later, "run", "left")
    return own.select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail, and those labelled quality 1, or toxic 1.

    rows: doc_id, part, mask; read twice. A doc_id that is labelled several times is good (toxic) where one of its labels
    says so. Counters of parts of the rows add up.
    """
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    marked = stage(labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(says("quality"), says("toxic")))
    if _few(marked):
        each, marked = rows.withColumn("n", F.lit(1)), F.broadcast(marked)
    else:  # rows of a frequent doc_id become one before they meet its label
        each = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    total = rows.groupBy("part", "mask").agg(F.count("*").alias("n"))
    good = each.join(marked, "doc_id").groupBy("part", "mask").agg(F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return total.join(good, ["part", "mask"], "left").fillna(0, ["good", "toxic"])


def interactions(counted: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and what happens there, for all orders and steps of each part of the counters.

    Of the orders in which a row with k failures stands, its failing filters remove it in an equal share: shapley counts
    120 / k of each.
    """
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 masks at most
    orders = ["".join(p) for p in permutations(LETTERS)]
    steps = parts.select("part", "masks", F.explode(F.array(*map(F.lit, orders))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(LETTERS[0]))
    before = F.aggregate(F.filter(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), lambda c: c != ""), F.lit(0), lambda bits, c: bits + bit(c))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    known = steps.select("part", "masks", "filter_order", "step", letter.alias("filter"), bit(letter).alias("own"), before.alias("before"))
    fails, earlier = lambda m: m["mask"].bitwiseAND(F.col("own")) != 0, lambda m: m["mask"].bitwiseAND(F.col("before")) != 0

    def total(which, amount=lambda m: m["n"]) -> Column:
        return F.aggregate(F.filter("masks", which), F.lit(0).cast("long"), lambda all_, m: all_ + amount(m))

    removed = lambda m: fails(m) & ~earlier(m)
    return known.select(
        "part", "filter_order", "step", "filter",
        total(lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & earlier(m)).alias("redundant"),
        total(lambda m: m["mask"] == F.col("own")).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"),
        total(removed, lambda m: m["toxic"]).alias("toxic_lost"),
        total(fails, lambda m: m["n"] * (F.lit(len(orders)) / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counters(stage(masked(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "labels"))
    return interactions(counted).drop("filter")


ORACLE = r"""
    with w as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
    ), f as (
        select doc_id, part, {
            'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
            'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) over (partition by text), false)
        } as fails from w
    ), l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
    d as (
        select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
            (case when fails['A'] then 'A' else '' end) || (case when fails['B'] then 'B' else '' end) || (case when fails['C'] then 'C' else '' end) || (case when fails['D'] then 'D' else '' end) || (case when fails['E'] then 'E' else '' end) as failed
        from f left join l using (doc_id)
    ), c as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from d group by all),
    letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    orders as (
        select a.x || b.x || c.x || d.x || e.x as o from letter a, letter b, letter c, letter d, letter e
        where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x
    ), steps as (select o, s::int as step, o[s:s] as x, o[1:s - 1] as before from orders, range(1, 6) r(s)),
    read as (
        select part, o as filter_order, step, n, good, toxic, failed, contains(failed, x) as fails, length(translate(failed, before, '')) < length(failed) as earlier, failed = x as alone from c, steps
    ), summed as (
        select part, filter_order, step, sum(case when not fails and not earlier then n else 0 end)::bigint as kept, sum(case when fails and not earlier then n else 0 end)::bigint as removed,
            sum(case when fails and earlier then n else 0 end)::bigint as redundant, sum(case when alone then n else 0 end)::bigint as unique_fails,
            sum(case when fails and not earlier then good else 0 end)::bigint as good_lost, sum(case when fails and not earlier then toxic else 0 end)::bigint as toxic_lost
        from read group by all
    )
    select *, sum(removed) over (partition by part, filter_order[step:step])::bigint as shapley from summed
"""
