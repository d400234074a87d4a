"""Language-model scores by online logistic context mixing, and a unigram base beside them.

The model's tables are counted over the training texts and have a fixed size (see
java/ContextMixing.java, which runs inside Spark's tasks). What grows with the corpus are anchors, hashes of five words in one of
16 places: where an anchor of a text stands in another training text too, what follows there is a further
predictor. Anchors meet in a shuffle, and only those that several texts share bring text along. Mixing weights are learned from all
training texts while these are counted, each read with the tables of those before it in its partition, and averaged over the partitions;
within each text they are refined decision by decision. The base needs every word's count: words are counted by their 64-bit hash, the
FREQUENT most frequent are sent to every executor, and the rest meet their counts in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.functions import jvm
from inkflow.llm.common import lean, rows_of, stage, table, texts, word_hashes

SOURCE = Path(__file__).parent / "java" / "ContextMixing.java"
#: Words whose counts are sent to every executor at most.
FREQUENT = 1_000_000
#: Words that a task holds before it hands on their counts.
HELD = 2_000_000
#: Bytes of shared passages that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
_LOG10_2 = float(np.log10(2.0))


def training() -> Column:
    """crc32 of doc_id as text, mod 10: 0 is held out; so is a row without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(False))


def _counts(docs: DataFrame) -> DataFrame:
    """h (a word's hash), n: how often each is in the texts."""

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in rows_of(batch):
                held.append(word_hashes(part.column("text").to_pylist())[0])
                if sum(map(len, held)) > HELD:
                    yield summed(held)
                    held.clear()
        if held:
            yield summed(held)

    return docs.select("text").mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _frequencies(words: DataFrame, most: int) -> tuple[int, int, int]:
    """How many words there are, how many different ones, and the smallest count that at most `most` of these reach."""
    # The number of different counts grows with the square root of the corpus at most.
    tokens, kinds, least = 0, 0, 1
    for n, of in words.groupBy("n").agg(F.count("*").alias("of")).orderBy(F.desc("n")).toLocalIterator():
        tokens += n * of
        kinds += of
        if kinds > most and least == 1:
            least = n + 1
    return tokens, kinds, least


def _call(java: JavaObject, name: str, rows: DataFrame) -> DataFrame:
    return DataFrame(jvm.call(rows.sparkSession, java, name, rows._jdf), rows.sparkSession)


def _passages(rows: DataFrame, found: DataFrame, java: JavaObject) -> DataFrame:
    """key, held_out, after: the anchors (h) of each text that another training text has too, and what follows there. rows: held_out, key, text;
    found: their anchors.

    A training text that shares an anchor with no other text has no such row. Of many texts with an anchor, those of the
    smallest and largest key stand for all.
    """
    source = F.when(F.col("trained"), F.col("key"))
    shared = found.groupBy("h").agg(F.count("*").alias("n"), F.count(source).alias("of"), F.min(source).alias("lo"), F.max(source).alias("hi")).filter("n > 1 and of > 0")
    # A training text that is alone with its key isn't its own source.
    src = F.when(F.col("lo") != F.col("key"), F.col("lo")).when(F.col("hi") != F.col("key"), F.col("hi")).when(~F.col("trained") | (F.col("of") > 1), F.col("lo"))
    wanted = stage(found.join(shared, "h").select("h", "key", (~F.col("trained")).alias("held_out"), src.alias("src")).filter("src is not null").distinct())
    asked = stage(wanted.groupBy("src").agg(F.collect_set("h").alias("hashes")))  # anchors of one text
    few = (asked.agg(F.sum(8 * F.size("hashes") + 32)).first()[0] or 0) <= BROADCAST_BYTES
    held = rows.select(F.col("key").alias("src"), "text").join(F.broadcast(asked) if few else asked, "src")
    passages = _call(java, "after", held.select("src", "hashes", "text")).dropDuplicates(["src", "h"])
    return wanted.join(passages, ["src", "h"]).groupBy("key", "held_out").agg(F.collect_list(F.struct("h", "after")).alias("after"))


def score(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs.

    Tokens are the words of the lower-cased text and one end. base_score: log10 of add-0.1 unigram
    probabilities from the training rows. score: log10 of the mixing model's probability of the
    lower-cased text with its white space collapsed, end included. A null or empty text is its
    end alone. Rows without doc_id are held out; rows that repeat count and score each by itself. Without
    training rows all counts are 0 and the model starts even (base: every token has the probability 1).
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("held_out", ~training()).select("doc_id", "held_out", F.xxhash64("text").alias("key"), "text")
    learned = rows.filter("not held_out").select("text")
    words = stage(_counts(learned))
    ends = learned.count()
    tokens, kinds, least = _frequencies(words, frequent)
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    java = jvm.load(spark, SOURCE)
    found = stage(_call(java, "anchors", rows.select((~F.col("held_out")).alias("trained"), "key", "text")))
    follow = found.filter("trained is null").groupBy("key").agg(F.sum("h").alias("n")).orderBy("key").toArrow()  # 2^21 rows at most
    histogram = np.stack([follow.column(x).to_numpy() for x in ("key", "n")], axis=1).astype("<i8")
    passages = stage(_passages(rows, found.filter("trained is not null"), java))
    few = (passages.agg(F.sum(F.aggregate("after", F.lit(0), lambda n, x: n + F.octet_length(x["after"]) + 32))).first()[0] or 0) <= BROADCAST_BYTES
    together = rows.join(F.broadcast(passages) if few else passages, ["key", "held_out"], "left").select("doc_id", "held_out", "after", "text")
    mixed = DataFrame(jvm.call(spark, java, "run", learned._jdf, together._jdf, bytearray(histogram.tobytes())), spark)

    hot = words.filter(F.col("n") >= least).toArrow()  # `frequent` rows at most
    keys, values = hot.column("h").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], values[order]))
    whole = tokens + 0.1 * (kinds + 1)

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the end and frequent words; other words, by hash, for the shuffle."""
        keys, values = shared.value
        end = np.log10((ends + 0.1) / whole)
        for batch in batches:
            for part in rows_of(batch):
                found, begins = word_hashes(part.column("text").to_pylist())
                distinct, inverse = np.unique(found, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
                known = keys[at] == distinct if len(keys) else np.zeros(len(distinct), dtype=bool)
                logs = np.where(known, np.log10((np.where(known, values[at] if len(keys) else 0, 0) + 0.1) / whole), 0.0)
                total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[inverse])))[begins])
                rare = ~known[inverse]
                offsets = np.concatenate(([0], np.cumsum(rare)))[begins]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), part.column("row"), part.column("bits"), part.column("bytes"), pa.array(np.diff(begins) + 1), pa.array(total(known.astype(np.int64)) + (ends > 0)), pa.array(total(logs) + end), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found[rare].view(np.int64)))],
                    ["doc_id", "held_out", "row", "bits", "bytes", "n_tokens", "n_known", "base_score", "rare"],
                )

    ids = rows.schema["doc_id"].dataType.simpleString()
    numbered = mixed.withColumn("row", F.monotonically_increasing_id())
    scored = numbered.mapInArrow(lean(base), f"doc_id {ids}, held_out boolean, row long, bits double, bytes long, n_tokens long, n_known long, base_score double, rare array<long>")
    unknown = float(np.log10(0.1 / whole)) if whole else 0.0
    if least > 1:
        scored = stage(scored)
        met = scored.select("row", F.explode("rare").alias("h")).join(words.filter(F.col("n") < least), "h")
        rest = met.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10((F.col("n") + 0.1) / whole)).alias("logs"))
        scored = scored.join(rest, "row", "left")
    else:
        scored = scored.withColumn("more", F.lit(0)).withColumn("logs", F.lit(0.0))
    more = F.coalesce("more", F.lit(0))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("logs", F.lit(0.0)) + (F.size("rare") - more) * unknown).alias("base_score"),
        (-F.col("bits") * _LOG10_2).alias("score"), (F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
