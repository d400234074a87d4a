"""Main text of pages."""

from inkflow.llm import extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body class="with-sidebar">
<header class="top">Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div id="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<div class="wrap"><main><article><header><h1>Title {0} &amp; more</h1></header><p class="promo-free">One&nbsp;two <b>{0}</b><br>four<p>Five &lt;{0}<ul><li>a<li>b</ul>
<div class="ad">Buy</div><form><input>Send<textarea>x</textarea></form><section class="comments"><article><p>nice</p></article></section><p>Follow us</p></article></main><aside>Side</aside></div>
<footer>&copy; F</footer></body></html>"""


def test_marked_parts_are_left_out(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", PAGE.format("seven")), (2, None, None), (3, "http://b.example", ""), (None, "b", "<p>a<p>b &am"), (4, "http://c.example/", "plain  text\n")], "page_id long, url string, html string")
    found = {r["page_id"]: tuple(r)[1:] for r in extraction.extract(pages).collect()}
    text = "Title seven & more\n\nOne two seven four\n\nFive <seven\n\na\n\nb\n\nFollow us"
    assert found == {1: ("http://a.example/x", text, len(text)), 2: (None, "", 0), 3: ("http://b.example", "", 0), None: ("b", "a\n\nb &am", 8), 4: ("http://c.example/", "plain text", 10)}


def test_what_a_host_repeats_is_template(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(f"word{i}")) for i in range(6)]
    rows += [(10 + i, f"http://few.example/{i}", PAGE.format(f"word{i}")) for i in range(3)]
    rows += [(20 + i, "http://copies.example/", PAGE.format("same")) for i in range(9)]
    found = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": extraction.F.lit("x"), "text": extraction.F.lit("y")})).collect()}
    # The list and the last line of the six pages are the same, so they belong to the wrapper.
    assert found[0] == "Title word0 & more\n\nOne two word0 four\n\nFive <word0"
    assert "a\n\nb" in found[10] and found[10].endswith("Follow us") and found[20].startswith("Title same")


def test_trees_are_aligned_by_order_and_ancestry():
    wrapper = extraction.Wrapper("#", iter(range(100)))
    tree = ["#", [["div", [["p", []]]], ["ul", [["li", []]]]]]
    first = extraction.align(wrapper, tree)
    assert len(set(first)) == 5 and extraction.align(wrapper, tree) == first
    longer = extraction.align(wrapper, ["#", [["nav", []], ["div", [["h1", []], ["p", []]]], ["ul", [["li", []]]]]])
    assert [longer[i] for i in (0, 2, 4, 5, 6)] == first and not {longer[1], longer[3]} & set(first)


def test_trees_beyond_the_wrapper_s_are_aligned_too(spark, monkeypatch):
    monkeypatch.setattr(extraction, "TREES", 1)
    test_what_a_host_repeats_is_template(spark)
    wrapper = extraction.Wrapper("#", iter(range(100)))
    extraction.align(wrapper, ["#", [["div", []]]])
    again = extraction.Wrapper.restored(wrapper.saved())
    assert extraction.align(again, ["#", [["nav", [["ul", []]]], ["div", []]]], grow=False) == [0, -1, -1, 1] and again.saved() == wrapper.saved()


def test_broken_pages(spark):
    html = ["<", "</", "<p", "<p>x</div></p>y", "<table><tr><td>a<td>b<tr><td>c</table>", "<a href='x\">y</a> z", "<script>x", "a<!--b", "<p>" * 3000 + "deep", "<div>" * 5000 + "deep" + "</div>" * 5000, "\x00 &#0; &#xD800; &nosuch;"]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in extraction.extract(pages).collect()}
    assert len(found) == len(html) and found[3] == "x\n\ny" and found[4] == "a\n\nb\n\nc" and found[8] == "deep" and found[9] == "deep" and found[7] == "a"
    assert extraction.extract(pages.limit(0)).collect() == []
