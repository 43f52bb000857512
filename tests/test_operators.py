import pytest
from pyspark.sql import functions as F

from merchlake.operators import compare, discover, enrich, extract, ledger, plan, quality
from merchlake.plans import listing
from merchlake.sources import tables
from merchlake.streaming import jobs

PAD = "<p>" + "x" * 9000 + "</p>"


def product(title="Thing", price="$24.99", stock="In Stock."):
    parts = [f'<span id="productTitle"> {title} </span>' if title else "", f'<div id="corePrice_feature_div"><span class="a-offscreen">{price}</span></div>' if price else "", f'<div id="availability"><span>{stock}</span></div>' if stock else ""]
    return "<html><body>" + "".join(parts) + '<div id="feature-bullets"><ul><li><span class="a-list-item">one</span></li><li class="aok-hidden"><span class="a-list-item">hidden</span></li><li><span class="a-list-item">one</span></li><li><span class="a-list-item">two</span></li><li><span class="a-list-item">x</span></li></ul></div>' + PAD + "</body></html>"


def captures(spark, rows):
    names = [f.name for f in tables.CAPTURES]
    return spark.createDataFrame([tuple({"label": "PRODUCT", "market": "US", "ok": True, "status_code": 200, **r}.get(n) for n in names) for r in rows], tables.CAPTURES)


def test_listing_settles_every_input(spark):
    asked = spark.createDataFrame([("B000000001", 1), ("B000000001", 2), ("B000000002", 3), ("B000000003", 4), ("B000000004", 5), ("B000000005", 6)], "item string, seq long")
    work = listing.plan_products(asked, "US")
    assert {(r.key, r.merged) for r in work.collect() if r.merged > 1} == {("US|B000000001|default", 2)}
    caps = captures(spark, [
        {"seq": 1, "lookup_key": "B000000001", "html": "<html></html>"}, {"seq": 2, "lookup_key": "B000000001", "html": product()},
        {"seq": 3, "lookup_key": "B000000002", "ok": False, "blocked": True}, {"seq": 4, "lookup_key": "B000000003", "ok": False, "not_found": True},
        {"seq": 5, "lookup_key": "B000000004", "html": product(price=None, stock="Currently unavailable.")},
    ])
    options = plan.check_options({"market": "US", "profile": "essential"})
    records = listing.product_records(work, caps, options).cache()
    got = {r.item: r for r in records.collect()}
    assert {k: r.status for k, r in got.items()} == {"B000000001": "SUCCESS", "B000000002": "BLOCKED", "B000000003": "PRODUCT_NOT_FOUND", "B000000004": "SUCCESS", "B000000005": "RUN_ABORTED"}
    first = got["B000000001"]
    assert (first.pricing.currentPrice, first.stock.state, first.bullets, first.title) == (2499, "IN_STOCK", ["one", "two", "x"], "Thing")
    assert got["B000000004"].pricing.status == "OUT_OF_STOCK"
    assert sum(r["items"] for r in listing.settle(work, records).collect()) == 5
    with pytest.raises(AssertionError):
        ledger.assert_settled(work, records.limit(2), "key")
    records.unpersist()


def test_full_records(spark):
    html = product().replace("</body>", '<div id="buybox"></div><div id="merchant-info"><a href="/x?seller=ABCDEFGHIJ">Sold by Shop</a></div><div id="SalesRank">Best Sellers Rank: #12 in Toys (See Top 100)</div>'
                             '<script>x = {"dimensionValuesDisplayData": {"B000000002": ["Red"]}, "dimensionsDisplay": ["Color"], "colorImages": {"initial": [{"hiRes": "https://i/a.jpg"}]}};</script></body>')  # fmt: skip
    caps = captures(spark, [{"seq": 1, "lookup_key": "B000000001", "html": html}])
    out = listing.full_records(caps, plan.check_options({"profile": "catalog"}), ("store",))
    assert len(out.columns) == 27
    r = out.first()
    assert (str(r.pricing.currentPrice.amount), r.availability.state, r.rankings.mainBSR, r.rankings.mainBSRCategory, r.buyBox.seller, r.buyBox.fulfillment) == ("24.99", "IN_STOCK", 12, "Toys", "Shop", "FBM")
    assert r.variants["items"][0].options == {"Color": "Red"} and r.media.mainImage == "https://i/a.jpg" and r.product.bullets == ["one", "two"] and r.offers.status == "NOT_APPLICABLE"
    short = listing.full_records(caps, plan.check_options({"profile": "essential"})).first()
    assert short.media.status == short.variants.status == "NOT_APPLICABLE" and short.pricing.status == "EXTRACTED" and short.retrieval.billingEvent == "product-essential"


def test_offers_and_sellers_of_a_record(spark):
    """The page of offers, or the buy box in its place; profiles of all sellers named, each once."""
    box = '<div id="buybox"><span id="price_inside_buybox">$24.99</span></div><div id="merchant-info"><a href="/x?seller=ABCDEFGHIJ">Sold by Shop</a></div></body>'
    offer = '<div id="aod-container"><div id="aod-offer"><div id="aod-offer-heading">Used - Good</div><span class="a-price"><span class="a-offscreen">$20.00</span></span><div id="aod-offer-soldBy"><a href="/sp?seller=KLMNOPQRST">Other</a></div></div></div>'
    seller = '<h1 id="sellerName">Shop</h1><div id="seller-feedback-summary">97% positive (1,234 ratings) (1,234)</div>'
    caps = captures(spark, [
        {"seq": 1, "lookup_key": "B000000001", "html": product().replace("</body>", box)}, {"seq": 2, "lookup_key": "B000000001", "label": "OFFERS", "html": offer},
        {"seq": 3, "lookup_key": "B000000002", "html": product().replace("</body>", box)}, {"seq": 4, "lookup_key": "ABCDEFGHIJ", "label": "SELLER", "html": seller}, {"seq": 5, "lookup_key": "B000000003", "html": product()},
    ])
    out = listing.full_records(caps, plan.check_options({"profile": "competitive"}), ("store",))
    got = {r.item: r for r in out.collect()}
    one, two, three = (got[f"B00000000{k}"] for k in (1, 2, 3))
    assert len(out.columns) == 27 and one.offers.status == "EXTRACTED" and one.offers["items"][0].condition == "USED" and str(one.offers["items"][0].itemPrice.amount) == "20.00" and one.offers["items"][0].landedPrice is None
    assert two.offers.status == "EXTRACTED" and two.offers["items"][0].sellerId == "ABCDEFGHIJ" and str(two.offers["items"][0].landedPrice.amount) == "24.99" and "OFFERS_FALLBACK_BUY_BOX" in two.quality.warnings
    assert three.offers.status == "PARSER_MISS" and three.sellerProfiles.status == "NOT_PRESENT"
    assert [(p.sellerId, p.sellerName, p.status) for p in one.sellerProfiles["items"]] == [("ABCDEFGHIJ", "Shop", "EXTRACTED"), ("KLMNOPQRST", None, "PARSER_MISS")] and one.sellerProfiles["items"][0].feedbackCount == 1234
    plan_text = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan_text.count("MapInArrow") <= 6


def test_monitor(spark):
    html = product().replace("</body>", '<div id="merchant-info"><a href="/x?seller=ABCDEFGHIJ">Shop</a></div><div id="buybox"></div><div id="SalesRank">Best Sellers Rank: #12 in Toys (See Top 100)</div><div id="acrPopover" title="4.5 out of 5 stars"></div><span id="acrCustomerReviewText">120 ratings</span></body>')
    later = html.replace("24.99", "25.99").replace("#12 in", "#24 in").replace("4.5 out", "4.4 out").replace("120 rat", "150 rat").replace("ABCDEFGHIJ", "KLMNOPQRST").replace("</body>", '<span id="couponTextpctch">Save $2.00</span></body>')
    options = plan.check_options({"profile": "catalog"})
    before, now = (listing.full_records(captures(spark, [{"seq": 1, "lookup_key": "B000000001", "html": h}]), options) for h in (html, later))
    r = listing.monitor(now, before, "d1").first().monitoring
    assert [c.type for c in r.changes] == ["PRICE_CHANGED", "COUPON_ADDED", "BUY_BOX_CHANGED", "BSR_CHANGED", "RATING_CHANGED", "REVIEW_COUNT_CHANGED"]
    assert (r.compared, r.changed, r.status, r.previousDatasetId, [c.percentChange for c in r.changes]) == (True, True, "EXTRACTED", "d1", [4.0, None, None, 100.0, -2.22, 25.0])
    euro = before.withColumn("pricing", F.col("pricing").withField("currentPrice.currency", F.lit("EUR")))
    r = listing.monitor(now, euro, "d1").first().monitoring
    assert "PRICE_CHANGED" not in [c.type for c in r.changes] and "COMPARISON_SUPPRESSED:pricing.currentPrice:CURRENCY_MISMATCH" in r.warnings
    r = listing.monitor(now, before.limit(0), "d1").first().monitoring
    assert (r.compared, r.changed, r.status) == (False, False, "NOT_PRESENT") and listing.monitoring_counts(listing.monitor(now, before, "d1")).first().asDict() == {"checked": 1, "compared": 1, "changed": 1}


def test_discovery(spark):
    def card(item, price, sponsored=False):
        return f'<div class="s-result-item" data-asin="{item}"><h2>T</h2><span class="a-price"><span class="a-offscreen">{price}</span></span>{"<span class=puis-sponsored-label-text>Sponsored</span>" if sponsored else ""}</div>'

    more = '<a class="s-pagination-next" href="#">Next</a>'
    page = [more + "".join([card("A000000001", "$10.00"), card("", "$1.00"), card("A000000002", "$20.00", True), card("A000000001", "$9.00")]), card("A000000003", "$30.00")]
    caps = captures(spark, [{"seq": i, "label": "SEARCH", "lookup_key": "kw", "page": i + 1, "html": h} for i, h in enumerate(page)])
    options = plan.check_options({"filters": {"max_price": 25, "sponsored": "exclude"}})
    got = {r.item: r for r in listing.discover_items(caps, options).collect()}
    assert {k: (r.position, r.organic_position, r.sponsored_position, r.reasons) for k, r in got.items()} == {
        "A000000001": (1, 1, None, []), "A000000002": (2, None, 1, ["SPONSORED_EXCLUDED"]), "A000000003": (3, 2, None, ["PRICE_ABOVE_MAX"]),
    }


def test_options():
    options = plan.check_options({"mode": "fast", "max_products": 0, "market": "DE"})
    assert options.numbers["max_products"] == 1 and options.warnings and options.blocks == ("pricing", "availability", "ratings")
    for bad in ({"mode": "x"}, {"market": "XX"}, {"mode": "monitor"}, {"mode": "fast", "profile": "catalog"}, {"filters": {"nope": 1}}, {"filters": {"min_price": 5, "max_price": 1}}, {"filters": {"min_rating": 9}}):
        with pytest.raises(ValueError):
            plan.check_options(bad)
    assert plan.resolve_blocks("custom", ["media", "pricing"], sellers=True) == ("pricing", "media", "sellerProfiles")


def test_filters_report_all_reasons(spark):
    cards = spark.createDataFrame([(5.0, None, 1, None, True, None, None)], "price double, rating double, reviews long, prime boolean, sponsored boolean, demand long, discount double")
    filters = {"min_price": 10, "min_rating": 4, "min_reviews": 5, "prime_only": True, "sponsored": "exclude", "min_demand": 1, "min_discount": 1}
    assert discover.filter_cards(cards, filters).first().reasons == ["PRICE_BELOW_MIN", "RATING_MISSING", "REVIEW_COUNT_BELOW_MIN", "NOT_PRIME", "SPONSORED_EXCLUDED", "DEMAND_MISSING", "DISCOUNT_MISSING"]
    assert discover.filter_cards(cards, {}).first().matches


def test_pages_read_stops(spark):
    pages = spark.createDataFrame([("s", 1, True, 3), ("s", 2, False, 2), ("s", 3, True, 5)], "source string, page int, has_next boolean, cards int")
    assert [r.page for r in discover.pages_read(pages, "source", "page", 9, F.col("has_next"), F.col("cards")).collect()] == [1, 2]


def test_compare_arms(spark):
    rows = spark.createDataFrame([("EXTRACTED", "EXTRACTED"), ("PARSER_MISS", "EXTRACTED"), ("EXTRACTED", None), ("EXTRACTED", "PARSER_MISS"), ("OUT_OF_STOCK", "EXTRACTED")], "now string, before string")
    assert [r[0] for r in rows.select(compare.suppression("pricing", F.col("now"), F.col("before"))).collect()] == [None, *(f"COMPARISON_SUPPRESSED:pricing:{x}" for x in ("CURRENT_PARSER_MISS", "PREVIOUS_STATUS_MISSING", "PREVIOUS_PARSER_MISS")), None]
    states = spark.createDataFrame([("IN_STOCK", "OUT_OF_STOCK"), ("OUT_OF_STOCK", "IN_STOCK"), ("OUT_OF_STOCK", "LIMITED_STOCK"), ("IN_STOCK", "IN_STOCK")], "a string, b string")
    assert [r[0] for r in states.select(compare.stock_change(F.col("a"), F.col("b"))).collect()] == ["OUT_OF_STOCK", "BACK_IN_STOCK", None, None]
    coupons = spark.createDataFrame([(None, "x"), ("x", None), ("x", "y"), (None, None)], "a string, b string")
    assert [r[0] for r in coupons.select(compare.coupon_change(F.col("a"), F.col("b"))).collect()] == ["COUPON_ADDED", "COUPON_REMOVED", "DISCOUNT_CHANGED", None]


def test_cap_and_health(spark):
    charges = spark.createDataFrame([("r", i, 3) for i in range(4)], "run string, seq int, units int")
    assert [(r.charged, r.outcome) for r in ledger.charge_with_cap(charges, "run", "seq", "units", 7).orderBy("seq").collect()] == [(3, "CHARGED"), (3, "CHARGED"), (1, "PARTIAL"), (0, "CAP_REACHED")]
    outcomes = spark.createDataFrame([("r", i, i < 9) for i in range(20)], "run string, seq int, blocked boolean")
    states = [(r.state, r.allowed) for r in ledger.trailing_health(outcomes, "run", "seq", F.col("blocked")).orderBy("seq").collect()]
    assert states[8] == ("HEALTHY", 8) and states[9] == ("ABORT", 0) and states[19] == ("DEGRADED", 4)
    assert ledger.select_event("detail", ["pricing"]) == "product-essential" and ledger.select_event("detail", ["media"]) == "product-detail"


def test_gate_and_projection(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    good, bad = quality.gate(rows, {"v": F.col("v") > 0})
    assert [r.k for r in good.collect()] == [1] and bad.first().violations == ["v"] and bad.first().reason == "OUTPUT_SCHEMA_VIOLATION"
    shaped = rows.select("k", F.struct("v", F.lit("EXTRACTED").alias("status")).alias("b"))
    assert quality.project_blocks(shaped, set(), ["b"]).first().b.asDict() == {"v": None, "status": "NOT_APPLICABLE"}


def test_warnings_of_options():
    found = plan.check_options({"schema_version": "1.4", "require_location": True}).warnings
    assert len(found) == 2 and "1.4" in found[0] and "postal" in found[1] and not plan.check_options({"require_location": True, "postal": "10001"}).warnings
    with pytest.raises(ValueError, match="needs blocks"):
        plan.check_options({"profile": "custom"})
    with pytest.raises(ValueError, match="no inputs"):
        plan.check_inputs({"items": [], "keywords": None})
    plan.check_inputs({"dataset": "d"})


def test_a_dataset_without_rows(spark):
    rows = spark.createDataFrame([], "n long, items array<string>")
    assert [tuple(r) for r in plan.ingest(rows, "items", "n", "ds").collect()] == [(None, None, None, "DATASET_EMPTY", "ds")]
    rows = spark.createDataFrame([(1, ["B000000001", "", None, "https://x"]), (2, []), (3, None), (4, ["nope"])], "n long, items array<string>")
    assert [(r.row, r.kind, r.reason) for r in plan.ingest(rows, "items", "n", "ds").orderBy("row", "kind").collect()] == [(1, "asin", None), (1, "url", None), (2, None, "DATASET_FIELD_MISSING"), (3, None, "DATASET_FIELD_MISSING"), (4, None, "ASIN_MALFORMED")]


def test_enrich(spark):
    offers = spark.createDataFrame([("a", s, p) for s, p in (("x", 3), ("y", 1), ("z", 2))], "k string, seller string, price int")
    block = enrich.offers_block(offers, "k", ["price", "seller"], ["seller"], 2)
    got = block.first()
    assert [o.seller for o in got["items"]] == ["y", "z"] and got.truncated


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 3, -1)], "k string, seq int, v int")
    bad = tables.append_records(rows, str(tmp_path / "out"), {"v": F.col("v") > 0}, ["k"], ["seq"])
    assert [(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 5)] and bad.count() == 1
    tables.write_summary(rows.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).first().n == 3
    assert tables.over_limit(rows, 2) and not tables.over_limit(rows, 3)


def test_broken_page_is_a_row(spark):
    pages = spark.createDataFrame([(1, None), (2, "<title>a &amp; b")], "i int, html string")
    assert [(r.i, r.title, r.parse_error) for r in extract.extract_fields(pages).orderBy("i").collect()] == [(1, None, None), (2, "a & b", None)]


def test_streams(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [("r", i, i < 12, at + datetime.timedelta(minutes=i)) for i in range(20)]
    spark.createDataFrame(rows + rows[:3], "run string, seq long, blocked boolean, ts timestamp").write.parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema("run string, seq long, blocked boolean, ts timestamp").parquet(str(tmp_path / "in"))

    def result(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(result(jobs.first_rows(stream(), ["run", "seq"], "ts"), "firsts", "append")) == 20
    windows = result(jobs.windowed_outcomes(stream(), "ts"), "windows", "complete")
    assert sum(r.outcomes for r in windows) == 23 and sum(r.blocked for r in windows) == 15
    last = result(jobs.health(stream()), "health", "update")[-1]
    assert (last.outcomes, last.state) == (23, "ABORT")
    assert len(result(jobs.changes_by_key(stream(), "run", "seq", "blocked"), "flips", "append")) == 1


def test_pages_are_parsed_in_all_parts(spark):
    """However little the rows weigh: adaptive execution joins small parts, and would have one task parse all pages."""
    rows = [{"seq": i, "lookup_key": f"B{i:09d}", "html": product()} for i in range(60)]
    records = listing.full_records(captures(spark, rows), plan.check_options({"profile": "essential"}))
    parts = records.select("item", F.spark_partition_id().alias("part")).collect()
    assert len(parts) == 60 and len({r.part for r in parts}) > 1
