from pyspark.sql import functions as F

from merchlake.functions.markets import MARKETS
from merchlake.operators import details, extract

US = MARKETS["US"]


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "k int, html string")


def offer(seller, price, more="", ident="aod-offer"):
    link = f'<div id="aod-offer-soldBy"><a href="/sp?seller={seller.upper()}12345&x=1">{seller}</a></div>' if seller else ""
    return f'<div id="{ident}"><div id="aod-offer-heading">Used - Good</div><span class="a-price"><span class="a-offscreen">{price}</span></span>{link}{more}</div>'


def test_offers(spark):
    ship = '<div id="aod-offer-shipping-price"><span class="a-offscreen">$3.00</span></div>'
    full = '<div id="aod-container"><span id="aod-filter-offer-count-string">5 options</span>' + offer("shop", "$10.00", ship) + offer("shop", "$10.00") + offer("other", "$12.00", "FREE Shipping Prime") + offer("last", "$9.00") + '<div class="aod-information-block"></div></div>'
    got = {r.k: r for r in details.offers(pages(spark, full, '<div id="aod-container"></div>', "<p>"), US, "k", 2, ["store"]).collect()}
    assert [(o.seller, o.seller_id, o.price, o.shipping, o.landed, o.condition, o.prime) for o in got[0]["items"]] == [("shop", "SHOP12345", 1000, 300, 1300, "USED", False), ("other", "OTHER12345", 1200, 0, 1200, "USED", True)]
    assert (got[0].total, got[0].truncated, got[0].status) == (5, True, "EXTRACTED")
    assert got[1].status == "NOT_PRESENT" and got[2].status == "PARSER_MISS" and got[2]["items"] == []


def test_buybox(spark):
    full = '<div id="buybox"><span id="price_inside_buybox">$5.00</span><div id="merchant-info"><a href="/x?seller=ABCDEFGHIJ">Sold by: Shop</a></div></div>'
    found = extract.extract_fields(pages(spark, full, '<div id="buybox"></div>', "<p>", '<div id="buybox"><i id="outOfStock"></i></div>'), details.BUYBOX_FIELDS)
    got = {r.k: r.buybox for r in details.buybox(found, US, ["store"]).collect()}
    assert (got[0].present, got[0].seller, got[0].sellerId, got[0].price, got[0].fulfillment) == (True, "Shop", "ABCDEFGHIJ", 500, "FBM")
    assert [got[i].status for i in range(4)] == ["EXTRACTED", "PARSER_MISS", "NOT_PRESENT", "NOT_PRESENT"]


def test_seller_profile(spark):
    html = """<h1 id="sellerName">Shop</h1><div id="seller-feedback-summary">94% positive in the last 12 months (1,234 ratings) (1,234)</div>
      <div data-feedback-window="30">90% positive 4% neutral 6% negative (50)</div>
      <div id="page-section-detail-seller-info"><ul><li><b>Business Name:</b> Shop Ltd</li><li><b>VAT number:</b> GB1</li><li><b>Business Address:</b> 1 Road</li></ul></div>"""
    got = {r.k: r for r in details.seller_profiles(pages(spark, html, "<p>"), US, "k").collect()}
    first = got[0]
    assert (first.sellerName, first.businessName, first.businessAddress, first.rating, first.feedbackCount, first.legalIdentifiers) == ("Shop", "Shop Ltd", "1 Road", 94.0, 1234, {"VAT number": "GB1"})
    assert first.feedback30Days.asDict() == {"positivePercent": 90.0, "neutralPercent": 4.0, "negativePercent": 6.0, "count": 50} and first.feedback90Days is None
    assert got[1].status == "PARSER_MISS"


def test_variants(spark):
    html = '<script>var d = {"dimensionValuesDisplayData": {"B000000002": ["Red", "M"], "B000000001": ["Blue", "S"], "bad": ["x"]}, "dimensionsDisplay": ["Color", "Size"]};</script>'
    odd = '<script>d = {"dimensionValuesDisplayData": {"B000000001": ["Blue", "S"]}, "dimensions": ["color_name"]};</script>'
    got = {r.k: r for r in details.variants(pages(spark, html, odd, '<div id="twister"></div>', "<p>"), "k", most=1).collect()}
    assert [(i.item, i.options) for i in got[0]["items"]] == [("B000000001", {"Color": "Blue", "Size": "S"})] and got[0].truncated
    assert got[1].dimensions == ["Color", "Option 2"] and got[2].status == "PARSER_MISS" and got[3].status == "NOT_PRESENT"
    assert details.variants(pages(spark, html), "k", mode="none").first().status == "NOT_APPLICABLE"


def test_swatches_stand_in_for_a_matrix(spark):
    drawn = '<div id="variation_color_name"><ul><li data-defaultasin="B000000009" title="Click to select Red &amp; Blue"></li></ul></div>'
    matrix = '<script>d = {"dimensionValuesDisplayData": {"B000000001": ["Blue"]}, "dimensionsDisplay": ["Color"]};</script>' + drawn
    got = {r.k: r for r in details.all_variants(pages(spark, drawn, matrix, "<p>", '<div id="twister"></div>'), "k").collect()}
    assert [(i.item, i.options) for i in got[0]["items"]] == [("B000000009", {"Color": "Red & Blue"})] and got[0].dimensions == ["Color"]
    assert [i.item for i in got[1]["items"]] == ["B000000001"] and [got[k].status for k in range(4)] == ["EXTRACTED", "EXTRACTED", "NOT_PRESENT", "PARSER_MISS"]


def test_media(spark):
    html = '<script>x = {"colorImages": {"initial": [{"hiRes": "https://i/a._SL1_.jpg"}, {"hiRes": null, "large": "https://i/b.jpg"}]}, "videos": [{"url": "https://v/1"}]};</script><div id="altImages"><ul><li><img src="https://i/a.jpg"></li></ul></div>'
    sizes = "<img id=\"landingImage\" src=\"https://i/z.jpg\" data-a-dynamic-image='{\"https://i/s.jpg\": [10, 10], \"https://i/l.jpg\": [90, 90]}'>"
    got = {r.k: r for r in details.media(pages(spark, html, sizes, "<p>"), "k").select("*", F.size("images").alias("n")).collect()}
    assert got[0].images == ["https://i/a.jpg", "https://i/b.jpg"] and got[0].videos == ["https://v/1"]
    assert got[1].images == ["https://i/l.jpg", "https://i/s.jpg", "https://i/z.jpg"] and got[2].status == "PARSER_MISS"


def test_deep_and_large_pages(spark):
    """Thousands of nested elements are answered, and a page of 170 KB takes its many selectors in a fraction of a second."""
    import time

    from merchlake.functions import dom
    from merchlake.operators import extract

    deep = dom.parse("<div>" * 5000 + '<p id="title">deep</p>')
    assert deep.first_text("div #title") == "deep" and len(deep.markup()) > 5000
    block = '<div class="a-row x%d" id="r%d"><span class="a-price"><span class="a-offscreen">$%d.99</span></span><ul><li>one</li><li>two <b>bold</b></li></ul><a href="/dp/B0%08d">item</a></div>'
    root = dom.parse("<html><body>" + "".join(block % (i, i, i, i) for i in range(900)) + "</body></html>")
    began = time.process_time()
    found = {k: extract._field(root, *v) for k, v in extract.PRODUCT_FIELDS.items()}
    assert time.process_time() - began < 0.5 and found["price"] is None
    assert [n.text() for n in root.select("li:last-child b")][:2] == ["bold", "bold"] and len(root.select(".a-row a[href^=\"/dp/\"], .a-offscreen")) == 1800
    assert [n.order for n in root.select("ul + a")] == sorted(n.order for n in root.select("a"))


def test_pages_are_parsed_once(spark):
    """Plans of offers, listing pages and swatches hold one page function each."""
    from pyspark.sql import functions as F

    from merchlake.functions.markets import MARKETS
    from merchlake.operators import details
    from merchlake.operators.plan import check_options
    from merchlake.plans import listing
    from merchlake.sources.tables import CAPTURES

    page = spark.range(3).select("id", F.lit("<p>").alias("html"))
    frames = [details.offers(page, MARKETS["US"], "id", 3, ["store"]), details.swatch_variants(page, "id"), listing.discover_items(spark.createDataFrame([], CAPTURES), check_options({}))]
    assert [f._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for f in frames] == [1, 1, 1]


def test_identity_of_titles_cut_within_a_reference(spark, tmp_path):
    from merchlake.plans import catalogue

    spark.createDataFrame([(1, "u", '<html lang="en"><title>a &amp; b&amp</title><h1>c&quot;&am</h1>')], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["html_identity"](spark, str(tmp_path)).collect()] == [(1, "a & b&amp", 'c"&am', "en")]


def test_pages_of_a_small_table_are_many_tasks(spark, tmp_path):
    from merchlake.plans import catalogue

    spark.range(40).selectExpr("id AS p_partkey", "'n' AS p_name", "'Brand#1' AS p_brand", "'t' AS p_type", "CAST(id % 50 AS INT) AS p_size", "900.0D AS p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("product_content", "product_pricing", "product_stock", "product_identity", "product_ratings", "drawn_variants", "media_pages", "buybox_pages", "variant_pages"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == wanted, name
