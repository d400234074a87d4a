"""Licences in files as they are: wrapped, commented, between a copyright line and code."""

import textwrap
from collections import Counter

import duckdb

from inkflow.llm import licences

TEXT = {name: body for name, body in licences.TEMPLATES if len(body) > 200}
CODE = "\n".join(f"def f{i}(x):\n    return x + {i}\n" for i in range(60))


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in licences.licences(docs).collect()]
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert Counter(found) == Counter(con.sql(licences.oracle()).fetchall())
    return found


def mit_file():
    body = TEXT["MIT"]
    a, b = body.index("The above copyright"), body.index("THE SOFTWARE IS PROVIDED")
    return "MIT License\n\nCopyright (c) 2024 Some One\n\n" + "\n\n".join(textwrap.fill(p, 76) for p in (body[:a], body[a:b], body[b:])) + "\n\n" + CODE


def test_a_whole_licence_above_code(spark):
    found = check(spark, [(1, mit_file()), (2, CODE), (3, mit_file())])
    assert {r[0] for r in found} == {1, 3}
    best = [r for r in found if r[0] == 1 and r[1] == "passage"]
    assert [(r[2], r[3]) for r in best] == [(4, "MIT")] and best[0][4] > 0.95


def test_every_long_notice_in_comments(spark):
    cases = [(name, prefix) for name in sorted(TEXT) for prefix in ("", "# ", " * ")]
    rows = [(i, f"#!/usr/bin/env x\n{prefix}Copyright 2020 The Authors\n" + "\n".join(prefix + line for line in textwrap.wrap(TEXT[name], 70)) + "\n" + CODE) for i, (name, prefix) in enumerate(cases)]
    found = {(r[0], r[3]) for r in check(spark, rows) if r[1] == "passage" and r[4] > 0.9}
    assert {(i, name) for i, (name, _) in enumerate(cases)} <= found


def test_passages_that_fall_short(spark):
    lines = textwrap.wrap(TEXT["MIT"], 76)
    half = "\n".join(lines[: len(lines) // 2])
    broken = "\n\n".join(line + "\nprint(some other code that belongs nowhere)" for line in lines)
    assert check(spark, [(1, half + "\n" + CODE), (2, broken + CODE)]) == []


def test_two_licences_in_one_file(spark):
    text = "\n\n".join("\n".join(textwrap.wrap(TEXT[n], 60)) + "\n\nand some words that stand between them\n" for n in ("ISC", "Apache-2.0", "ISC"))
    found = [r for r in check(spark, [(1, text)]) if r[1] == "passage"]
    assert sorted(r[3] for r in found) == ["Apache-2.0", "ISC", "ISC"]


def test_runs_may_be_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(licences, "BROADCAST_ROWS", 0)
    assert "passage" in {r[1] for r in check(spark, [(i, mit_file()) for i in range(5)])}


def test_no_python_worker(spark):
    docs = spark.createDataFrame([(1, mit_file())], "doc_id long, text string")
    plan = licences.licences(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
