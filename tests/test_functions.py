from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merchlake.functions import dom, numbers, text, urls
from merchlake.functions.markets import MARKETS

US, DE, FR = MARKETS["US"], MARKETS["DE"], MARKETS["FR"]


def one(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_localized_numbers(spark):
    us = ["1234", "1234.56", "$1,234.56", "1,234,567.89", "-5.5", "1.", "1.234,56", "12,34", "1,2345", "1.234", "1.2.3", "", "abc", None, "1,234.567"]
    assert [float(v) if v is not None else None for v in one(spark, us, lambda c: numbers.localized_number(c, US))] == [1234, 1234.56, 1234.56, 1234567.89, -5.5, 1, None, None, None, None, None, None, None, None, 1234.567]
    de = ["1.234,56 €", "1,234.56", "1,234", "1234,5", "12.34"]
    assert [float(v) if v is not None else None for v in one(spark, de, lambda c: numbers.localized_number(c, DE))] == [1234.56, None, None, 1234.5, None]
    fr = ["1 234,56 €", "1 234,5", "1.234,56"]
    assert [float(v) if v is not None else None for v in one(spark, fr, lambda c: numbers.localized_number(c, FR))] == [1234.56, 1234.5, None]


@settings(max_examples=15, deadline=None)
@given(cents=st.lists(st.integers(0, 10**9), min_size=1, max_size=40))
def test_money_round_trip(spark, cents):
    for m in (US, DE, FR):
        shown = [f"{c // 100:,}".replace(",", m.thousands) + m.decimal + f"{c % 100:02d} {m.symbols[0]}" for c in cents]
        assert one(spark, shown, lambda c, m=m: numbers.money(c, m)["minor"]) == cents


def test_first_money(spark):
    assert one(spark, ["$24.99$24.99", "from $1,234.56 to $2,000.00", "no price", "1.234,56", None], lambda c: numbers.first_money(c, US)) == [2499, 123456, None, None, None]
    assert one(spark, ["24,99 €24,99 €", "1 234,56 €"], lambda c: numbers.first_money(c, FR)) == [2499, 123456]


def test_counts_ratings_demand(spark):
    assert one(spark, ["1,820 ratings", "45K", "4.5K", "none", "4.5"], lambda c: numbers.count(c, US)) == [1820, 45000, 4500, None, None]
    assert one(spark, ["1.820", "1,2 Tsd."], lambda c: numbers.count(c, DE)) == [1820, 1200]
    assert one(spark, ["4.6 out of 5 stars", "9", "5.0", ""], lambda c: numbers.rating(c, US)) == [4.6, None, 5.0, None]
    assert one(spark, ["2K+ bought in past month", "1.5K+ bought", "50+ bought"], lambda c: numbers.demand(c, US)) == [2000, 1500, 50]


def test_rounding_and_changes(spark):
    rows = spark.sql("SELECT * FROM VALUES (2.345D, 2.35D), (-2.5D, -2.5D), (0.285D, 0.29D) AS t(x, want)")
    assert [r[0] for r in rows.select(numbers.half_up(F.col("x"), 2)).collect()] == [2.35, -2.5, 0.29]
    row = spark.range(1).select(numbers.half_up(F.lit(-2.5)).alias("h"), numbers.percent_change(F.lit(0.0), F.lit(1.0)).alias("z"), numbers.discount_percent(F.lit(24.99), F.lit(29.99)).alias("d"), numbers.rate(F.lit(1), F.lit(0)).alias("r")).first()
    assert (row.h, row.z, row.d, row.r) == (-3.0, None, 16.67, 0.0)


def test_texts(spark):
    assert one(spark, [" a  b\n", " ", None], text.clean_text) == ["a b", None, None]
    assert one(spark, ["Derzeit nicht verfügbar", "Auf Lager", "Nur noch 3", "?"], lambda c: text.availability_state(c, DE)) == ["OUT_OF_STOCK", "IN_STOCK", "LIMITED_STOCK", None]
    ranks = one(spark, ["Best Sellers Rank: #1,234 in Toys (See Top 100) #5 in Puzzles"], text.rank_lines)[0]
    assert [(r["rank"], r["category"]) for r in ranks] == [(1234, "Toys"), (5, "Puzzles")]
    assert one(spark, ["FREE delivery Monday, July 14 for members", "Lieferung Montag, 14. Juli", "soon"], text.delivery_date) == ["Monday, July 14", "Montag, 14. Juli", None]
    assert one(spark, ["color_name", "size"], text.humanize_dimension) == ["Color", "Size"]
    assert one(spark, ["https://x/I/71a._AC_SL1500_.jpg"], text.max_resolution) == ["https://x/I/71a.jpg"]
    assert one(spark, ["Sold by: Shop", "Shop", "Sold by："], lambda c: text.strip_label(c, ["Sold by", "Ships from and sold by"])) == ["Shop", "Shop", None]
    assert [(r["type"], r["percent"]) for r in one(spark, ["Save 20%", "Save $5", "Coupon"], lambda c: text.coupon(c, MARKETS["US"]))] == [("PERCENT", 20), ("AMOUNT", None), ("UNKNOWN", None)]


def test_urls(spark):
    host = US.host
    rows = spark.createDataFrame([(i, u) for i, u in enumerate([
        f"https://{host}/x/dp/b000000001?x=1", f"https://{host}/s?k=red+shoe", f"https://{host}/sp?seller=ABC123", f"https://{host}/zgbs/toys",
        f"https://{host}/b/?node=5", "https://example.org/dp/B000000001", "ftp://x", "nonsense", f"https://{host}/", None,
    ])], "i int, url string")
    got = [(r.u.type, r.u.item, r.u.keyword, r.u.reason) for r in urls.classify_urls(rows, "url", to="u").orderBy("i").collect()]
    assert got == [
        ("url", "B000000001", None, None), ("keyword", None, "red shoe", None), ("seller", None, None, None), ("bestsellers", None, None, None), ("category", None, None, None),
        (None, None, None, "MARKETPLACE_UNSUPPORTED"), (None, None, None, "URL_UNSUPPORTED"), (None, None, None, "URL_UNSUPPORTED"), (None, None, None, "URL_NO_ASIN"), (None, None, None, "URL_UNSUPPORTED"),
    ]


def test_dom():
    root = dom.parse('<div id="a" class="x y"><p>one<p>two<b>bold</p><ul><li>1<li>2</ul></div><input name="ASIN" value=" B0 "><table><tr><th>K:</th><td>v</td><tr><th>K2<td>v2</table><script>var t="</p>";</script>')
    assert [n.text() for n in root.select("p")] == ["one", "twobold"]
    assert [n.text() for n in root.select("li")] == ["1", "2"]
    assert root.first_attr("value", "#none", 'input[name="ASIN"]') == "B0"
    assert dom.key_values(root, "table") == {"K": "v", "K2": "v2"}
    assert len(root.select("#a p + p")) == 1 and len(root.select("div.x:not(.z) p:first-child")) == 1 and root.select("div.x:not(.y)") == []
    assert [n.tag for n in root.select("li:last-child, p:first-child")] == ["p", "li"]
    assert dom.json_blob('a = {"k": {"b": [1, "}"]}};', "k") == {"b": [1, "}"]} and dom.json_blob("k: {", "k") is None
    assert dom.json_ld(dom.parse('<script type="application/ld+json">[{"a": 1}]</script><script type="application/ld+json">{</script>')) == [{"a": 1}]


def test_references_without_semicolon():
    page = '<html lang="a&amp"><title>x &amp; y&amp</title><script>a &amp b</script><h1>&lt;&lt &#65;&#65 &&&amp;</h1></html>'
    read = lambda closed: (lambda r: (r.first_text("title"), r.first_text("h1"), r.first_attr("lang", "html"), r.first("script").script()))(dom.parse(page, closed))
    assert read(True) == ("x & y&amp", "<&lt A&#65 &&&", "a&amp", "a &amp b")
    assert read(False) == ("x & y&", "<< AA &&&", "a&", "a &amp b")


_BITS = ["<div>", "</div>", '<p class="a  b">', "</p>", "<br>", "<br/>", "<li title='x &amp; y' id=\"i\">", "<td hidden>", "<tr>", "<table>", "</table>", "text", " a &lt; b &copy c", "<", "&", "<!-- c -->", "<script>if (a < b) {x = '&amp;'}</script>", "<script>a</b></script>", "<script/>", "<title>t &amp; u</title>", "<title><b>", "<A HREF=x>", '<a href="?a=1&amp;b">', "</a >", "<x-y>", "<i a>", '<b a="1"c="2">', "<style>p > b {}</style>", "</span", "<textarea> q"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(_BITS), max_size=12))
def test_plain_pages_are_read_as_by_htmlparser(bits):
    def tree(root):
        return [(n.tag, n.attrs, n.order, n.end, n.text(), n.place, "".join(c for c in n.children if isinstance(c, str))) for n in root.page.nodes]

    page, slow = "".join(bits), dom._Builder()
    slow.feed(page)
    slow.close()
    slow.page.close()
    assert tree(dom.parse(page)) == tree(slow.root)
    for selector in ("p.a", "div p, .b", "#i", "li[title]", "table td", "[hidden]", ".a.b", "nothing p", "p, p", ":first-child"):
        assert [n.order for n in dom.parse(page).select(selector)] == [n.order for n in slow.page.nodes[1:] if any(dom._matches(n, steps, len(steps) - 1) for steps, _ in dom._compile(selector))]


def test_script_keys_that_are_not_on_the_page_are_not_searched_for(monkeypatch):
    from merchlake.functions import dom

    page = "<script>a = {data: [1]}; 'kind': 'x.y'</script>"
    assert dom.json_slice(page, "data") == "[1]" and dom.js_string(page, "kind") == "x.y"
    monkeypatch.setattr(dom.re, "search", None)
    assert dom.json_slice(page, "dat.a") is None and dom.js_string(page, "parentAsin") is None
