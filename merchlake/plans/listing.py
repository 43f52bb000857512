"""Entry points over captured pages: product detail, discovery, monitoring.

Work is planned and deduplicated before any page is touched; captures are joined to it by market and key; pages are
parsed in one stage; products and failures come from one status expression, so every input settles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions.markets import MARKETS, Market
from merchlake.functions.numbers import count, demand, discount_percent, first_money, rating
from merchlake.functions.urls import dedupe_key
from merchlake.functions.text import brand_name
from merchlake.operators import compare, details, discover, enrich, extract, ledger, quality, records
from merchlake.operators.plan import Options


def plan_products(items: DataFrame, market: str, postal: str | None = None) -> DataFrame:
    """items(item, seq) as work: one row a key, with the number of inputs it stands for."""
    keyed = items.withColumn("key", dedupe_key(F.lit(market), F.col("item"), F.lit(postal).cast("string")))
    return keyed.groupBy("key").agg(F.min_by("item", "seq").alias("item"), F.min("seq").alias("seq"), F.count(F.lit(1)).alias("merged"))


def _status(product: Column) -> Column:
    return (
        F.when(F.col("ok").isNull(), "RUN_ABORTED")
        .when(F.coalesce(F.col("not_found"), F.lit(False)), "PRODUCT_NOT_FOUND")
        .when(F.coalesce(F.col("blocked"), F.lit(False)) & ~F.col("ok"), "BLOCKED")
        .when(~F.col("ok"), "FETCH_FAILED")
        .when(product, "SUCCESS")
        .otherwise("PARSER_ERROR")
    )


def _spread(pages: DataFrame, *keys: str) -> DataFrame:
    """pages dealt out by keys over all parts before they are parsed: adaptive execution joins parts by the size of rows, and small pages cost much.

    keys must differ from those that the pages are grouped or joined by, or Spark would take that exchange for this one and join its parts.
    """
    return pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def product_records(work: DataFrame, captures: DataFrame, options: Options, stub: int = 8000) -> DataFrame:
    """A row for each work key: its status and, for products, the typed blocks asked for and their completeness.

    Of several captures of a key the last by seq holds.
    """
    market: Market = MARKETS[options.market]
    pages = captures.where((F.col("label") == "PRODUCT") & (F.col("market") == options.market))
    last = compare.latest(pages.select("lookup_key", "seq", "ok", "html", "status_code", "blocked", "not_found"), ["lookup_key"], ["seq"]).drop("seq")
    joined = work.join(last, work["item"] == last["lookup_key"], "left").drop("lookup_key")
    fields = {k: v for k, v in extract.product_fields(options.blocks).items() if k != "item"}
    found = extract.extract_fields(_spread(joined, "key", "item").withColumn("chars", F.length("html")), fields, {"bullets": extract.CONTENT_LISTS["bullets"]}, linked="linked")
    typed = extract.product_blocks(found.withColumn("brand", brand_name(F.col("brand"))), market)
    blocks = {"pricing": "pricing", "availability": "stock", "ratings": "ratings"}
    typed = quality.project_blocks(typed, {blocks[b] for b in options.blocks if b in blocks}, list(blocks.values()))
    critical = quality.critical_ok(F.col("title"), F.lit(None).cast("string"), [F.col(f"{c}.status") for c in blocks.values()])
    whole = (F.coalesce(F.col("chars"), F.lit(0)) >= stub) & F.col("parse_error").isNull() & critical
    weights = quality.WEIGHTS["fast"]
    there = {"id": F.col("item").isNotNull(), "title": F.col("title").isNotNull(), "url": F.lit(True), "price": quality.present(F.col("pricing.status")), "ratings": quality.present(F.col("ratings.status"))}
    score, missing = quality.completeness({k: (weights[k], v) for k, v in there.items()})
    rows = typed.withColumn("status", _status(whole)).withColumns({"completeness": score, "missing": missing})
    return rows.select("key", "item", "merged", "status", "title", "brand", "pricing", "stock", "ratings", "bullets", "completeness", "missing", "parse_error")


def _money(minor: Column, market: Market, raw: Column) -> Column:
    return F.when(minor.isNotNull(), F.struct((minor / 100).cast("decimal(18,2)").alias("amount"), F.lit(market.currency).alias("currency"), raw.alias("raw")))


def full_records(captures: DataFrame, options: Options, own_names: tuple[str, ...] = ()) -> DataFrame:
    """The last capture of each product as a record of 27 columns, with the blocks of options; others are NOT_APPLICABLE.

    One page function finds the texts of all blocks that are asked for, and of no others. Offers and sellers come from the captures of
    their own pages (labels OFFERS by item, SELLER by seller); without offers a buy box stands in as the only one.
    """
    market = MARKETS[options.market]
    wanted = set(options.blocks)
    fields = extract.product_fields(wanted)
    lists, maps, blobs, boxes = dict(extract.STARS) if "ratings" in wanted else {}, {}, {}, {}
    if "rankings" in wanted:
        fields, boxes = fields | extract.RANK_FIELDS, extract.RANK_BOXES
    if "product" in wanted:
        fields, lists, maps = fields | extract.CONTENT_FIELDS, lists | extract.CONTENT_LISTS, extract.CONTENT_TABLES
    if wanted & {"buyBox", "offers", "sellerProfiles"}:
        fields = fields | details.BUYBOX_FIELDS
    cards = {}
    if "variants" in wanted:
        fields, blobs, cards = fields | details.VARIANT_FIELDS, blobs | details.VARIANT_BLOBS, details.VARIANT_CARDS
    if "media" in wanted:
        fields, lists, blobs = fields | details.MEDIA_FIELDS, lists | details.MEDIA_LISTS, blobs | details.MEDIA_BLOBS
    own = captures.where((F.col("market") == options.market) & F.col("ok"))
    last = compare.latest(own.where(F.col("label") == "PRODUCT").select("lookup_key", "seq", "received_at", "html"), ["lookup_key"], ["seq"])
    found = extract.extract_fields(_spread(last, "lookup_key", "seq"), fields, lists, maps, blobs, strings=extract.IDENTITY_STRINGS, linked="linked" if "pricing" in wanted else None, boxes=boxes, cards=cards)
    rows = extract.product_blocks(extract.identity(found), market)
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("deal_price", "buybox_price", "price", "list_price", "subscribe") if c not in rows.columns})
    now, listed = F.col("pricing.currentPrice"), F.col("pricing.listPrice")
    shown = F.when(F.col("pricing.priceSource") == "DEAL_PRICE", F.col("deal_price")).when(F.col("pricing.priceSource") == "BUY_BOX", F.col("buybox_price")).when(F.col("pricing.priceSource") == "CORE_PRICE_DISPLAY", F.col("price"))
    off, stock = F.col("pricing.coupon"), F.col("stock")
    warnings = [
        F.col("parse_error"), F.when(F.col("pricing.status") == "PARSER_MISS", "PRICE_PARSER_MISS") if "pricing" in wanted else None,
        F.when(F.col("pricing.priceSource") == "JSON_LD", "PRICE_FROM_JSON_LD"), F.when(stock["status"] == "PARSER_MISS", "AVAILABILITY_PARSER_MISS") if "availability" in wanted else None,
    ]
    made = {
        "scrapedAt": F.date_trunc("second", "received_at"), "marketplace": F.lit(options.market), "item": F.col("lookup_key"), "input": F.struct(F.lit("item").alias("type"), F.col("lookup_key").alias("value")),
        "canonicalUrl": F.concat(F.lit(f"https://{market.host}/dp/"), F.col("lookup_key")),
        "retrieval": F.struct(F.lit(options.profile).alias("profile"), F.array(*[F.lit(b) for b in options.blocks]).cast("array<string>").alias("requestedBlocks"), F.lit(ledger.select_event(options.mode, options.blocks)).alias("billingEvent")),
        "parentItem": F.col("parent_item"),
        "pricing": F.struct(_money(now, market, shown).alias("currentPrice"), _money(listed, market, F.col("list_price")).alias("listPrice"), _money(listed - now, market, F.lit(None).cast("string")).alias("discountAmount"),
                            _money(F.col("pricing.dealPrice"), market, F.col("deal_price")).alias("dealPrice"), _money(F.col("pricing.subscribeAndSave"), market, F.col("subscribe")).alias("subscribeAndSave"),
                            discount_percent(now, listed).alias("discountPercent"), F.col("pricing.dealType").alias("dealType"), F.col("pricing.unitPrice").alias("unitPrice"), F.col("pricing.priceSource").alias("priceSource"),
                            F.col("pricing.status").alias("status"), F.when(off.isNotNull(), F.struct(off["text"].alias("text"), off["type"].alias("type"), off["percent"].alias("percent"), _money(off["minor"], market, off["text"]).alias("amount"))).alias("coupon")),
        "availability": F.struct(stock["state"].alias("state"), stock["inStock"].alias("inStock"), stock["text"].alias("availabilityText"), *[stock[c].alias(c) for c in ("stockLeftText", "deliveryDate", "deliveryText")],
                                 _money(stock["shippingPrice"], market, F.col("shipping")).alias("shippingPrice") if "shipping" in rows.columns else F.lit(None).alias("shippingPrice"), *[stock[c].alias(c) for c in ("primeEligible", "shipsFrom", "soldBy", "status")]),
        "quality": F.struct(F.array_compact(F.array(*[w for w in warnings if w is not None])).alias("warnings"), F.lit("1").alias("parserVersion")),
    }
    if "rankings" in wanted:
        made["rankings"] = extract.rankings_block(market)
    if "product" in wanted:
        made["product"] = extract.content_block()
    if wanted & {"buyBox", "offers", "sellerProfiles"}:
        rows = details.buybox(rows, market, own_names)
        b = F.col("buybox")
        made["buyBox"] = F.struct(b["present"].alias("present"), b["seller"].alias("seller"), b["sellerId"].alias("sellerId"), _money(b["price"], market, F.col("box_price")).alias("price"), b["shipsFrom"].alias("shipsFrom"),
                                  b["fulfillment"].alias("fulfillment"), (b["fulfillment"] == "AMZ").alias("marketIsSeller"), b["status"].alias("status"))
    if "variants" in wanted:
        rows = details.variants_block(rows, options.numbers.get("max_variants", 50))
    if "media" in wanted:
        rows = details.media_block(rows)
    kept = [c for c in ("title", "brand", "ratings", "variants", "media") if c in rows.columns and c not in made]
    out = records.product_records(rows.select(*kept, *[v.alias(k) for k, v in made.items()]), tuple(wanted | ({"buyBox"} if wanted & {"offers", "sellerProfiles"} else set())))
    if "offers" in wanted:
        out = enrich.join_offers(out, _offers(own, market, options, own_names))
    if "sellerProfiles" in wanted:
        pages = compare.latest(own.where(F.col("label") == "SELLER").select("lookup_key", "seq", "html"), ["lookup_key"], ["seq"])
        out = enrich.join_sellers(out, details.seller_profiles(_spread(pages, "lookup_key", "seq"), market, "lookup_key"), f"https://{market.host}/sp?seller=")
    if wanted & {"offers", "sellerProfiles"} and "buyBox" not in wanted:
        out = out.withColumn("buyBox", records.empty_block("buyBox", "NOT_APPLICABLE"))
    return quality.scored(out, options.mode)


def _offers(captures: DataFrame, market: Market, options: Options, own_names) -> DataFrame:
    """item and the offers block of its last captured page of offers."""
    pages = compare.latest(captures.where(F.col("label") == "OFFERS").select("lookup_key", "seq", "html"), ["lookup_key"], ["seq"])
    found = details.offers(_spread(pages, "lookup_key", "seq"), market, "lookup_key", options.numbers.get("max_offers", 10), own_names)
    url = F.concat(F.lit(f"https://{market.host}/gp/product/ajax?asin="), F.col("lookup_key"))
    items = F.transform("items", lambda o: F.struct(
        o["seller_id"].alias("sellerId"), o["seller"].alias("sellerName"), o["condition"].alias("condition"), _money(o["price"], market, F.lit(None).cast("string")).alias("itemPrice"),
        _money(o["shipping"], market, F.lit(None).cast("string")).alias("shippingPrice"), _money(o["landed"], market, F.lit(None).cast("string")).alias("landedPrice"), o["prime"].alias("primeEligible"), o["fulfillment"].alias("fulfillment"),
        o["delivery"].alias("deliveryText"), o["seller_rating"].alias("sellerRating"), o["seller_feedback"].alias("sellerFeedbackCount"), url.alias("sourceUrl"), F.lit("EXTRACTED").alias("status")))
    return found.select(F.col("lookup_key").alias("item"), F.struct(F.lit(True).alias("requested"), F.col("total").alias("totalCount"), "truncated", "status", items.alias("items")).alias("block"))


def discover_items(captures: DataFrame, options: Options) -> DataFrame:
    """Cards of the captured search pages, typed, placed and judged by the filters; matches tells which go on.

    Pages after one that is empty or has no next page are not read. A page stays one row, with its cards as an array, until its place among the
    pages of its source is known; then they are unfolded.
    """
    market = MARKETS[options.market]
    pages = captures.where((F.col("label") == "SEARCH") & (F.col("market") == options.market) & F.col("ok")).where(F.col("page") <= options.numbers.get("max_pages", 5))
    lists = extract.card_lists(pages.select("lookup_key", "page", "html"), heads=extract.SEARCH_PAGE)
    read = discover.pages_read(lists, "lookup_key", "page", options.numbers.get("max_pages", 5), F.col("next").isNotNull(), F.size("cards"))
    placed = discover.place_cards(read, "lookup_key", "page", "cards", lambda c: c["sponsored"].isNotNull())
    price, listed = first_money(F.col("price"), market), first_money(F.col("list_price"), market)
    typed = placed.select(
        "lookup_key", "page", "place", "item", "title", (price / 100).alias("price"), (listed / 100).alias("list_price"), F.col("demand").alias("demand_text"), F.col("sponsored").isNotNull().alias("sponsored"), "badge", "thumbnail", "delivery",
        rating(F.col("rating"), market).alias("rating"), count(F.col("reviews"), market).alias("reviews"), demand(F.col("demand"), market).alias("demand"),
        discover.card_discount(price, listed, F.lit(market.currency), F.lit(market.currency)).alias("discount"), F.col("prime").isNotNull().alias("prime"),
        "page_position", "position", "sponsored_position", "organic_position",
    )
    return discover.filter_cards(typed, options.filters)


def card_records(cards: DataFrame, options: Options) -> DataFrame:
    """Records of 27 columns made from the cards of discover_items alone, for runs that read no product page.

    A card's prices, ratings, demand, thumbnail, delivery and prime mark fill their blocks; discounts stay null, the badge is the deal type, and what only a product
    page tells is NOT_PRESENT or NOT_APPLICABLE. Columns that cards lack are null. Completeness is that of the mode.
    """
    market = MARKETS[options.market]
    own = lambda c, kind="string": F.col(c).cast(kind) if c in cards.columns else F.lit(None).cast(kind)
    money = lambda c: F.when(own(c, "double").isNotNull(), F.struct(own(c, "decimal(18,2)").alias("amount"), F.lit(market.currency).alias("currency"), F.lit(None).cast("string").alias("raw")))
    priced, rated, shown = own("price").isNotNull(), own("rating").isNotNull() | own("reviews").isNotNull(), own("thumbnail").isNotNull()
    extracted = lambda there: F.when(there, "EXTRACTED").otherwise("NOT_PRESENT").alias("status")
    rows = cards.select(
        F.lit(options.market).alias("marketplace"), own("item").alias("item"), F.concat(F.lit(f"https://{market.host}/dp/"), own("item")).alias("canonicalUrl"), own("title").alias("title"), own("received_at", "timestamp").alias("scrapedAt"),
        F.struct(F.lit("keyword").alias("type"), own("lookup_key").alias("value")).alias("input"),
        F.struct(F.lit(options.profile).alias("profile"), F.array(*[F.lit(b) for b in options.blocks]).cast("array<string>").alias("requestedBlocks"), F.lit(ledger.select_event(options.mode, options.blocks)).alias("billingEvent")).alias("retrieval"),
        F.struct(money("price").alias("currentPrice"), money("list_price").alias("listPrice"), own("badge").alias("dealType"), F.when(priced, "SEARCH_CARD").alias("priceSource"), extracted(priced)).alias("pricing"),
        F.struct(F.lit("UNKNOWN").alias("state"), own("delivery").alias("deliveryText"), own("prime", "boolean").alias("primeEligible"), F.lit("NOT_PRESENT").alias("status")).alias("availability"),
        F.struct(own("demand_text").alias("boughtInPastMonthRaw"), own("demand", "bigint").alias("boughtInPastMonthMin"), F.lit("NOT_APPLICABLE").alias("status")).alias("rankings"),
        F.struct(own("rating", "double").alias("rating"), own("reviews", "bigint").alias("reviewCount"), extracted(rated)).alias("ratings"),
        F.struct(own("thumbnail").alias("mainImage"), F.array_compact(F.array(own("thumbnail"))).alias("images"), F.array().cast("array<string>").alias("videos"), extracted(shown)).alias("media"),
        *[records.empty_block(b, "NOT_APPLICABLE").alias(b) for b in ("buyBox", "variants", "product")],
        F.struct(F.lit("SEARCH").alias("pageType"), F.array(F.lit("FROM_SEARCH_CARD")).alias("warnings"), F.lit("1").alias("parserVersion")).alias("quality"),
        F.create_map(F.lit("priceStrategy"), F.when(priced, "SEARCH_CARD")).alias("sources"),
        F.array(F.struct(F.lit("keyword").alias("type"), own("lookup_key").alias("value"), *[own(c, "int").alias(n) for n, c in (("page", "page"), ("position", "position"), ("pagePosition", "page_position"))], own("sponsored", "boolean").alias("sponsored"),
                         own("organic_position", "int").alias("organicPosition"), own("sponsored_position", "int").alias("sponsoredPosition"))).alias("discoveredFrom"),
    )
    return quality.scored(records.product_records(rows, options.blocks), options.mode)


def monitor(records: DataFrame, baseline: DataFrame, dataset: str, keys: tuple[str, ...] = ("marketplace", "item")) -> DataFrame:
    """records (of the record schema) with their monitoring block: the changes of every block against the baseline's record, and why one was not compared.

    baseline holds one successful record a key (see sources.tables.read_baseline); the postal code belongs to the key.
    """
    blocks = [*compare.TRUSTED]
    place = lambda: F.coalesce(F.nullif(F.trim("location.resolvedPostalCode"), F.lit("")), F.lit("default")).alias("__place")
    kept = F.col("place").alias("__place") if "place" in baseline.columns else place()  # a bucketed baseline has it as a column, and is joined where it lies
    old = baseline.where("status = 'SUCCESS'").select(*keys, kept, F.col("scrapedAt").cast("string").alias("scrapedAt"), *blocks)
    joined = compare.snapshot_join(records.drop("monitoring").withColumn("__place", place()), old, [*keys, "__place"])
    joined = compare.product_changes(joined, lambda f: F.col(f), lambda f: F.col(f"prev_{f}"), F.col("compared"))
    block = F.struct(
        F.lit(True).alias("requested"), "compared", (F.size("__found") > 0).alias("changed"), F.lit(dataset).alias("previousDatasetId"), F.when(F.col("compared"), F.col("prev_scrapedAt")).alias("previousScrapedAt"),
        F.when(F.col("compared"), "EXTRACTED").otherwise("NOT_PRESENT").alias("status"),
        F.transform("__found", lambda c: F.struct(c["type"].alias("type"), c["field"].alias("field"), c["before"].alias("before"), c["after"].alias("after"), c["percent"].alias("percentChange"))).alias("changes"), F.col("__warned").alias("warnings"),
    )
    return joined.withColumn("monitoring", block).select(*[c for c in records.columns if c != "monitoring"], "monitoring")


def monitor_untyped(records: DataFrame, baseline: DataFrame, dataset: str, keys: tuple[str, ...] = ("marketplace", "item")) -> DataFrame:
    """records with their monitoring block against a baseline(keys, record VARIANT) whose records may be of any schema (see sources.tables.read_untyped_baseline).

    A status that an older schema lacks suppresses its block's comparison as PREVIOUS_STATUS_MISSING.
    """
    old = baseline.select(*keys, F.col("record").alias("__old"))
    joined = records.drop("monitoring").join(old, [*keys], "left").withColumn("compared", F.col("__old").isNotNull())
    joined = compare.product_changes(joined, lambda f: F.col(f), compare.untyped(F.col("__old")), F.col("compared"))
    block = F.struct(
        F.lit(True).alias("requested"), "compared", (F.size("__found") > 0).alias("changed"), F.lit(dataset).alias("previousDatasetId"), F.try_variant_get("__old", "$.scrapedAt", "string").alias("previousScrapedAt"),
        F.when(F.col("compared"), "EXTRACTED").otherwise("NOT_PRESENT").alias("status"),
        F.transform("__found", lambda c: F.struct(c["type"].alias("type"), c["field"].alias("field"), c["before"].alias("before"), c["after"].alias("after"), c["percent"].alias("percentChange"))).alias("changes"), F.col("__warned").alias("warnings"),
    )
    return joined.withColumn("monitoring", block).select(*[c for c in records.columns if c != "monitoring"], "monitoring")


def monitoring_counts(monitored: DataFrame) -> DataFrame:
    """One row: checked, compared, changed."""
    return monitored.agg(*[F.count_if(F.coalesce(F.col(f"monitoring.{c}"), F.lit(False))).alias(n) for n, c in (("checked", "requested"), ("compared", "compared"), ("changed", "changed"))])


def settle(work: DataFrame, records: DataFrame) -> DataFrame:
    """Counts by status, after checking that every key settled once."""
    ledger.assert_settled(work, records, "key")
    return ledger.status_counts(records)
