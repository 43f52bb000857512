import pyarrow as pa
from pyspark.sql import functions as F

from merchlake.functions import dom, numbers, plain
from merchlake.functions.markets import MARKETS
from merchlake.operators import details, extract

US = MARKETS["US"]
LINK = '<div id="aod-offer-soldBy"><a href="/sp?seller=%s">%s</a></div>'
PRICE = '<span class="a-price"><span class="a-offscreen">%s</span></span>'
PLAIN = [
    "", "text", None, '<div id="aod-offer"></div>', '<DIV ID="aod-offer">' + PRICE % " $1.00\n" + LINK % ("ABCDE&amp;x=1", "A &amp; B") + "<br><img src='x'/></DIV>tail",
    '<div id="aod-container"><div id="aod-offer">' + PRICE % " " + '<div class="b aod-information-block">' + PRICE % "$2.00" + LINK % ("ABCDEF", "é  x") + "</div>FREE<b> </b>Shipping</div></div>",
    '<div id="aod-offer"><div class="aod-offer-soldBy">&nbsp;</div><div class="aod-offer-soldBy">&am<b>p;</b></div></div><span id="aod-total-offer-count">3</span>',
]
ODD = [
    "<p>x", "<div>", "</div>", '<div id="aod-offer"><b>x</div></b>', '<!-- c --><div id="aod-offer">x</div>', "<div id='aod-offer' title='a>b'>1 < 2</div>", '<ul><li id="aod-offer">a<li>b</ul>',
    '<div id="aod-offer"><script>if (a) { b = "<b>"; }</script>y</div>', "<div id=aod-offer>x</div>", '<div id="aod-offer">a</div ></div>', "</br>", "<title>a<b>c</title>",
]


def test_cards_of_plain_pages_are_those_of_the_tree(spark):
    fields = {**details.OFFER_FIELDS, "own": (None, "id"), "some": ((".a-price",), extract.EXISTS), "any": (('div:not(.b) span, [href^="/sp"]',), None)}
    pages = [*PLAIN, *ODD, *PLAIN]
    reader = plain.Cards(details.OFFER, fields, details.OFFER_PAGE, extract.EXISTS)
    numbers_ = reader.read(pa.array(pages, pa.string()))[0].tolist()
    assert numbers_ == [k for k, page in enumerate(pages) if page not in ODD]
    frame = spark.createDataFrame(list(enumerate(pages)), "k int, html string").coalesce(1)
    got = {r.k: r for r in extract.card_lists(frame, details.OFFER, fields, unique=None, heads=details.OFFER_PAGE).collect()}
    for k, page in enumerate(pages):
        root = dom.parse(page or "")
        assert [got[k][h] for h in details.OFFER_PAGE] == [extract._field(root, *v) for v in details.OFFER_PAGE.values()]
        assert [c.asDict() for c in got[k].cards] == extract._cards(root, details.OFFER, fields, None, {}), page


def test_what_looks_beside_a_tag_is_left_to_the_tree():
    assert plain.Cards.fit("div", {"a": (("b c, d",), None)}, {})
    assert not plain.Cards.fit("div", {"a": (("b + c",), None)}, {}) and not plain.Cards.fit("div:first-child", {}, {}) and not plain.Cards.fit("div", {}, {"whole": (None, None)})


def test_offers_stay_on_the_row_of_their_page(spark):
    offer = '<div id="aod-offer">' + PRICE + LINK + "</div>"
    page = '<div id="aod-container">' + "".join(offer % o for o in [("$9.00", "ZZZZZ", "z"), ("$10.00", "AAAAA", "a"), ("$9", "ZZZZZ", "z"), ("none", "", ""), ("$9.00", "AAAAA", "a"), ("$10.00", "AAAAA", "a")]) + "</div>"
    found = details.offers(spark.createDataFrame([(k, page) for k in range(3)], "k int, html string"), US, "k", 2, [])
    assert [([(o.seller_id, o.price) for o in r["items"]], r.total, r.truncated, r.status) for r in found.collect()] == [([("ZZZZZ", 900), ("AAAAA", 1000)], 3, True, "EXTRACTED")] * 3
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_price_alone_is_read_as_within_a_text(spark):
    texts = ["$1", "$1,234.56", "1.234,56 €", "€1.234,5", "$ 1", "1 234,56 €", "1 234", "12,34", "$1.2345", "$1.234", "1,2345", "$1,23", "£5\n", "US$7.00", "USD7", "$$7", "$1.", ".5", "$1 $2", "‎$3", "1 234,00", "", "x", None, "$9" * 20, "9" * 40]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for market in MARKETS.values():
        rows = frame.select("t", numbers.price(F.col("t"), market).alias("a"), numbers.first_money(F.col("t"), market).alias("b")).collect()
        assert [(r.t, r.a) for r in rows] == [(r.t, r.b) for r in rows]
