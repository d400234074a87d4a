"""Near duplicates at the pipeline's threshold."""

import random

import corpus_pipeline
from inkflow.llm import neardup
from inkflow.llm.common import table
from tests.llm.test_texts import shingles

SMALL = "/root/testdata/sf0.01"


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return {i: root(i) for i, _ in sets}


def test_bounds_follow_the_threshold():
    assert (neardup.least_shared(85, neardup.UNLISTED), neardup.least_shared(85, neardup.RULED_OUT)) == (18, 20)
    assert (neardup.least_shared(80, neardup.UNLISTED), neardup.least_shared(80, neardup.RULED_OUT)) == (15, 17)


def test_the_stage_drops_copies_from_an_index_of_80_on(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    at = {p: set(brute(rows, p).values()) for p in (80, 85)}
    assert at[80] < at[85]
    assert {r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, SMALL).collect()} == at[80]
    assert {r["doc_id"] for r in neardup.near_duplicates(docs).filter("kept").collect()} == at[85]


def test_edited_copies_at_80(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, base = [], [word() for _ in range(90)]
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(90)] = word()
        rows.append((i, " ".join(copy)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows, 80)
