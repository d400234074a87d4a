"""Near duplicates, toxicity, licences and secrets."""

import base64
import gzip
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from inkflow.llm import licences, neardup, registry, secrets, toxicity

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows, percent=85):
    """doc_id: (smallest doc_id reachable) over all pairs, rows of a doc_id being one document."""
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


def check_components(spark, rows):
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = brute_components(rows)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in found) == Counter((i, len(shingles(t))) for i, t in rows)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == wanted
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_odd_documents(spark, odd_docs, odd_texts, no_docs):
    check_components(spark, odd_texts)
    found = neardup.near_duplicates(odd_docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == brute_components(odd_texts)
    assert neardup.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("block", [3, 512])
def test_lists_of_many_components_are_met_in_blocks(spark, monkeypatch, block):
    """Copies of one text with edits of many sizes, so that its lists hold a large component, small ones, and single texts."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(300)], []
    for i in range(60):
        text = list(base)
        for at in rng.sample(range(300), rng.choice((0, 1, 2, 5, 6, 7, 8, 12))):
            text[at] = word()
        rows.append((i, " ".join(text)))
    assert len(set(brute_components(rows).values())) > 5
    check_components(spark, rows)


def test_near_duplicates_in_chains_and_around_the_threshold(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, base = [], [word() for _ in range(80)]
    for i in range(40):  # copies with edits of their own, most of them apart from each other
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(80)] = word()
        rows.append((1000 + i, " ".join(copy)))
    chain = [word() for _ in range(60)]
    for i in range(12):  # each like the next one only
        chain = [*chain[3:], *[word() for _ in range(3)]]
        rows.append((10 + i, " ".join(chain)))
    passage = [word() for _ in range(50)]
    rows += [(2000 + i, " ".join([word() for _ in range(rng.randint(5, 60))] + passage)) for i in range(40)]
    rows += [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(5)] + [(7, "a b c"), (8, "A  b\nc"), (8, "quite another text of this id here"), (9, "quite another text of this id here")]
    check_components(spark, rows)


def test_near_duplicates_of_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check_components(spark, rows)


def test_toxicity_learns_what_is_held_out(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        if toxic := i % 6 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("vile", "vilest", "grubby", "rotten")))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    weights = toxicity.train(docs, labels.filter(toxicity.fold() != 1))
    found = toxicity.score(docs, weights).join(labels, "doc_id").filter(toxicity.fold() == 1).collect()
    right = [r["predicted"] == r["toxic"] for r in found]
    assert len(found) > 300 and np.mean(right) > 0.97
    assert 0 < len(weights.cells) < 2000  # sparse
    clean = toxicity.accepted(docs, weights)
    assert clean.columns == docs.columns and clean.count() == toxicity.score(docs, weights).filter("predicted = 0").count()


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (7, 1), (7, 1)], "doc_id long, toxic int")
    weights = toxicity.train(odd_docs, labels)
    found = toxicity.score(odd_docs, weights).collect()
    assert len(found) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    nothing = toxicity.train(no_docs, labels)
    assert not len(nothing.cells) and toxicity.score(no_docs, nothing).collect() == []
    assert {r["score"] for r in toxicity.score(odd_docs, nothing).collect()} == {0.5}


def test_licences_equal_their_sql(spark, odd_docs, no_docs):
    texts = ["Released under the MIT License.", "x\nreleased UNDER the mit licence\n\nLicensed under the Apache License, version 2.0!", licences.TEMPLATES[5][1].replace(" IS", " is\n"), "the mit", None, "", "\n\n", licences.TEMPLATES[2][1] + "\n\n" + licences.TEMPLATES[3][1]]
    texts += [f"{a}\n{b}" for _, a in licences.TEMPLATES[::5] for _, b in licences.TEMPLATES[::7]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(tuple(r) for r in licences.licences(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    assert found == Counter((None if r[0] != r[0] else r[0], *r[1:]) for r in con.sql(licences.oracle()).fetchall())
    assert (0, "line", 0, "MIT", 1.0) in found and (None, "line", 0, "MIT", 1.0) in found
    assert licences.licences(odd_docs).collect() == [] and licences.licences(no_docs).collect() == []


def test_texts_without_anchors_cannot_match():
    least = licences.THRESHOLD / (2 - licences.THRESHOLD)
    words = set(licences.anchors())
    for _, text in licences.TEMPLATES:
        own = licences._bigrams(text)
        assert sum(not words & set(b.split()) for b in own) < least * len(own)


SECRET = "api_key = Zm9vYmFyYmF6cXV4"


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode(), mtime=0)).decode(),
    lambda s: base64.b64encode(zlib.compress(s.encode())).decode().rstrip("="),
    lambda s: "".join(f"%{b:02x}" for b in s.encode()),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: base64.b64encode(base64.b64encode(base64.b64encode(s.encode()))).decode(),
    lambda s: base64.b64encode("".join(f"%{b:02x}" for b in s.encode()).encode()).decode().replace("=", "%3D"),
])
def test_nested_secrets_map_back(wrap):
    hidden = wrap(SECRET)
    text = f"é before {hidden} after"
    own, every = secrets.scan(text)
    spans = {(a, b) for a, kind, b in every if kind == 0}
    start = text.index(hidden)
    assert any(start <= a and b <= start + len(hidden) and b - a > 1 for a, b in spans)
    assert set(own) <= set(every) and "after" in secrets.redact(text, every) and secrets.KINDS


def test_base_secrets():
    text = "token=short password: 'longenough' AKIA0123456789AB AKIA01 " + "0f" * 16 + " SECRET=token=abcdefgh ſecret=abcdefghi"
    own, every = secrets.scan(text)
    assert secrets.listed(own) == "assign:12:33,access:35:51,hex:59:91,assign:92:113" == secrets.listed(every)
    assert secrets.scan("password=token: abcdefghij")[0] == []  # the failing match uses its text up
    assert secrets.redact("a token=abcdefghij b", secrets.scan("a token=abcdefghij b")[1]) == "a <secret> b"
    assert secrets.redact("k " + "a" * 40, [(2, 0, 20), (10, 2, 42)]) == "k <secret>"


def test_spans_are_those_of_the_encoded_run():
    text = "%41 x " + "".join(f"%{b:02x}" for b in b"token=abcdefgh") + " %41 y token=plainplain"
    every = secrets.scan(text)[1]
    start = text.index("%74")
    assert every == [(start, 0, start + 3 * 14), (text.index("token="), 0, len(text))]
    twice = base64.b64encode(base64.b64encode(b"secret: 0123456789")).decode()
    assert secrets.scan(f"日本 {twice}.")[1] == [(3, 0, 3 + len(twice))]


def test_cycles_end():
    assert secrets.scan("%2525252525" * 50 + "%41" * 3)[1] == []


def test_secrets_of_odd_documents(spark, odd_docs, odd_texts, no_docs):
    found = secrets.secrets(odd_docs).collect()
    assert Counter((r["doc_id"], r["spans"]) for r in found) == Counter((i, secrets.listed(secrets.scan(t or "")[1])) for i, t in odd_texts)
    assert sum(r["n_assign"] for r in found) == 1 and secrets.secrets(no_docs).collect() == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(odd_docs).collect()}
    assert clean[1] is None and clean[11] == "<secret>' \x00 end" and clean[4] == "one"


def test_registered_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
