"""Wrappers of hosts with more trees than one task merges."""

import random
import time

import pytest

from inkflow.llm import extraction


def page(i, rare):
    body = "".join(f"<{tag}>word{i} {k}</{tag}>" for k in range(7) for tag in (("p", "table")[i >> k & 1], "h2"))
    return f"<html><body><div>{body}</div>{'<blockquote>Said on each of them</blockquote>' if rare else ''}</body></html>"


@pytest.mark.parametrize("trees", [1, 3])
def test_layouts_of_rare_trees_count(spark, monkeypatch, trees):
    monkeypatch.setattr(extraction, "TREES", trees)
    rows = [(i, "http://a.example/", page(i, False)) for i in range(24)] + [(100 + i, "http://a.example/", page(i, False).replace("word", "term")) for i in range(8)]
    rows += [(200 + i, "http://a.example/", page(40 + i, True)) for i in range(12)] + [(300, "http://b.example/", page(3, True))]
    found = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == len(rows) and all("Said" not in found[200 + i] and f"word{40 + i} 6" in found[200 + i] for i in range(12))
    assert "Said" in found[300]


def test_every_node_of_every_tree_has_a_slot(spark, monkeypatch):
    monkeypatch.setattr(extraction, "TREES", 3)
    shapes = [extraction.numbered(extraction.parse(page(i, i % 3 == 0))[0]) for i in range(40)]
    trees = spark.createDataFrame([("h", i, s, 1) for i, s in enumerate(shapes)], "host string, shape_id long, shape string, pages long")
    [model] = extraction.models(trees).collect()
    wrapper = extraction.Wrapper.restored(extraction.json.loads(model["wrapper"]))
    for s in shapes:
        slots = extraction.align(wrapper, extraction.json.loads(s), grow=False)
        assert -1 not in slots and len(set(slots)) == len(slots)


def naive(a, b):
    """Simple tree matching by its definition."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + naive(x, y))
    return 1 + best[-1][-1]


def random_tree(rng, depth=3):
    return [rng.choice("abc"), [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4 if depth else 0))]]


@pytest.mark.parametrize("cells", [4, 1 << 22])
def test_alignment_pairs_as_many_nodes_as_brute_force(monkeypatch, cells):
    monkeypatch.setattr(extraction, "TABLE", cells)
    rng = random.Random(3)
    for _ in range(150):
        a, b = ["#", random_tree(rng)[1]], ["#", random_tree(rng)[1]]
        wrapper = extraction.Wrapper("#", iter(range(1000)))
        first = extraction.align(wrapper, a)
        second = extraction.align(extraction.Wrapper.restored(wrapper.saved()), b, grow=False)
        assert sorted(first) == list(range(len(first))) and sum(s >= 0 for s in second) == naive(a, b)
        grown = extraction.align(wrapper, b)
        assert len(set(grown)) == len(grown) and [s for s in second if s >= 0] == [s for s in grown if s < len(first)]


def test_wide_pages_are_aligned_in_time():
    rng = random.Random(4)
    wide = lambda: ["#", [["div", [[rng.choice(("p", "ul", "h2")), []] for _ in range(rng.randint(1, 3))]] for _ in range(2000)]]
    wrapper = extraction.Wrapper("#", iter(range(1 << 20)))
    extraction.align(wrapper, wide())
    began = time.perf_counter()
    slots = extraction.align(wrapper, wide(), grow=False)
    assert time.perf_counter() - began < 2 and sum(s >= 0 for s in slots) > 4000


SLOT = extraction.Slot


def test_the_region_is_the_smallest_container_of_the_varying_text():
    tree = ["#", [["body", [["div.x", []], ["div", [["div", [["h1", []], ["p", []], ["ul", [["li", []]]]]], ["div", []]]], ["div.y", []]]]]]
    # places: # 0, body 1, div.x 2, div 3, div 4, h1 5, p 6, ul 7, li 8, div 9, div.y 10
    slots = {2: SLOT(50, 1, False, 400.0), 5: SLOT(50, 50, True, 30.0), 6: SLOT(50, 50, True, 900.0), 8: SLOT(30, 30, True, 50.0), 9: SLOT(50, 50, True, 80.0), 10: SLOT(50, 40, True, 60.0)}
    assert extraction.content(tree, slots) == [5, 6, 8]
    assert extraction.content(tree, slots | {8: SLOT(30, 1, False, 50.0)}) == [5, 6]  # on all pages the same
    assert extraction.content(tree, slots | {8: SLOT(4, 1, False, 50.0)}) == [5, 6, 8]  # too few pages to tell
    assert extraction.content(tree, slots | {8: SLOT(30, 3, True, 50.0)}) == [5, 6]  # three texts that come back
    assert extraction.content(tree, {k: SLOT(50, 1, False, v.size) for k, v in slots.items()}) == [2, 5, 6, 8, 9, 10]  # nothing varies
    assert extraction.content(tree, slots | {9: SLOT(50, 50, True, 900.0)}) == [5, 6, 8, 9]  # two parts of one article
    assert extraction.content(tree, {}) == []


@pytest.mark.parametrize("known", [extraction.NAMES, extraction.Names(frozenset(), frozenset(), frozenset())])
def test_the_wrapper_finds_the_article_without_names(spark, known):
    body = "<nav><ul><li>menu {0}</ul></nav><div class='ad'>Advert of {1}</div><div class='x'><header><h1>Title {0}</h1></header><div class='y'>{2}</div></div><div>See also {0}</div><footer>foot {1}</footer>"
    words = lambda i: [" ".join(f"w{i}x{k}y{j}" for j in range(20)) for k in range(4)]
    rows = [(i, "http://a.example/", body.format(i, i % 3, "".join(f"<p>{w}" for w in words(i)))) for i in range(12)]
    rows += [(100 + i, "http://a.example/", f"<main><h2>Other {i}</h2>" + "".join(f"<table><tr><td>{w}</table>" for w in words(100 + i)) + "</main><div class=share>Share it</div>") for i in range(6)]
    found = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), known).collect()}
    assert all(found[i] == "\n\n".join([f"Title {i}", *words(i)]) for i in range(12))
    assert all(found[100 + i] == "\n\n".join([f"Other {i}", *words(100 + i)]) for i in range(6))
