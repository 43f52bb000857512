"""Enrichment: offers, sellers, variants, the buy-box fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.sources.tables import settled


def offers_block(offers: DataFrame, key: str, order: list[str], fields: list[str], most: int) -> DataFrame:
    """For each key the first `most` offers in order, their total, and whether some were left out.

    A bounded buffer a key: candidates are ranked before they are gathered.
    """
    window = Window.partitionBy(key).orderBy(*order)
    ranked = offers.select(key, *dict.fromkeys([*order, *fields]), F.row_number().over(window).alias("__n"))
    totals = F.count(F.lit(1)).alias("total")
    kept = F.sort_array(F.collect_list(F.when(F.col("__n") <= most, F.struct("__n", *fields)))).alias("__items")
    out = ranked.groupBy(key).agg(totals, kept)
    return out.select(key, "total", F.transform("__items", lambda o: F.struct(*[o[f].alias(f) for f in fields])).alias("items"), (F.col("total") > most).alias("truncated"))


def join_offers(products: DataFrame, blocks: DataFrame) -> DataFrame:
    """product records with their offers from blocks(item, block); a page that is missing or has none lets the buy box stand in as the only offer.

    Without any offer the block is that of the page, or PARSER_MISS where there was no page.
    """
    kind = products.schema["offers"].dataType
    joined = products.join(blocks.select("item", F.col("block").alias("__block")), "item", "left")
    box, stock = F.col("buyBox"), F.col("availability")
    price, shipping = F.coalesce(box["price"], F.col("pricing.currentPrice")), stock["shippingPrice"]
    same = price.isNotNull() & (shipping.isNull() | (shipping["currency"] == price["currency"]))
    raw = F.when(shipping.isNull(), price["raw"]).otherwise(F.concat(price["raw"], F.lit(" + "), shipping["raw"]))
    landed = F.when(same, F.struct((price["amount"] + F.coalesce(shipping["amount"], F.lit(0))).cast("decimal(18,2)").alias("amount"), price["currency"].alias("currency"), raw.alias("raw")))
    one = F.struct(
        box["sellerId"].alias("sellerId"), box["seller"].alias("sellerName"), F.lit("NEW").alias("condition"), price.alias("itemPrice"), shipping.alias("shippingPrice"), landed.alias("landedPrice"),
        stock["primeEligible"].alias("primeEligible"), box["fulfillment"].alias("fulfillment"), stock["deliveryText"].alias("deliveryText"), F.lit(None).cast("double").alias("sellerRating"),
        F.lit(None).cast("bigint").alias("sellerFeedbackCount"), F.col("canonicalUrl").alias("sourceUrl"), F.lit("EXTRACTED").alias("status"),
    )
    fallback = F.struct(F.lit(True).alias("requested"), F.lit(1).cast("bigint").alias("totalCount"), F.lit(False).alias("truncated"), F.lit("EXTRACTED").alias("status"), F.array(one).alias("items"))
    none = F.struct(F.lit(True).alias("requested"), F.lit(None).cast("bigint").alias("totalCount"), F.lit(False).alias("truncated"), F.lit("PARSER_MISS").alias("status"), F.array().cast(kind["items"].dataType).alias("items"))
    stands_in = ~F.coalesce(F.col("__block.status") == "EXTRACTED", F.lit(False)) & F.coalesce(box["present"], F.lit(False)) & (price.isNotNull() | box["seller"].isNotNull())
    block = F.when(stands_in, fallback.cast(kind)).otherwise(F.coalesce(F.col("__block").cast(kind), none.cast(kind)))
    warned = F.col("quality").withField("warnings", F.when(stands_in, F.array_union(F.coalesce("quality.warnings", F.array().cast("array<string>")), F.array(F.lit("OFFERS_FALLBACK_BUY_BOX")))).otherwise(F.col("quality.warnings")))
    return joined.withColumns({"offers": block, "quality": warned}).select(*products.columns)


def join_sellers(products: DataFrame, profiles: DataFrame, url: str) -> DataFrame:
    """product records with the profiles of their sellers: the buy box's one first, then those of the offers, each once.

    Each profile is joined to the rows that name it; a seller whose page was not captured is PARSER_MISS. A record without any seller is NOT_PRESENT.
    """
    kind = products.schema["sellerProfiles"].dataType
    named = F.array_distinct(F.array_compact(F.concat(F.array("buyBox.sellerId"), F.transform(F.coalesce("offers.items", F.array().cast(products.schema["offers"].dataType["items"].dataType)), lambda o: o["sellerId"]))))
    asked = products.select("item", F.posexplode(named).alias("__at", "sellerId"))
    known = profiles.withColumnRenamed("lookup_key", "sellerId")
    found = asked.join(known, "sellerId", "left").withColumns({"sourceUrl": F.concat(F.lit(url), F.col("sellerId")), "status": F.coalesce("status", F.lit("PARSER_MISS"))})
    fields = kind["items"].dataType.elementType.names
    listed = found.groupBy("item").agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", F.to_json(F.struct(*fields)).alias("p")))), lambda x: F.from_json(x["p"], kind["items"].dataType.elementType.simpleString())).alias("__items"))
    joined = products.join(listed, "item", "left")
    some = F.exists(F.coalesce("__items", F.array().cast(kind["items"].dataType)), lambda p: p["status"] == "EXTRACTED")
    status = F.when(F.col("__items").isNull(), "NOT_PRESENT").when(some, "EXTRACTED").otherwise("PARSER_MISS")
    block = F.struct(F.lit(True).alias("requested"), status.alias("status"), F.coalesce("__items", F.array().cast(kind["items"].dataType)).alias("items"))
    return joined.withColumn("sellerProfiles", block.cast(kind)).select(*products.columns)


def seller_profiles(wanted: DataFrame, profiles: DataFrame, key: str, seller: str, order: str, most: int) -> DataFrame:
    """For each key the profiles of its first `most` distinct sellers in order.

    Sellers are made distinct before the join, so each profile is looked up once however many keys ask for it.
    """
    first = wanted.groupBy(key, seller).agg(F.min(order).alias("__at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__at", seller))
    asked = first.withColumn("__n", rank).where(F.col("__n") <= most)
    known = asked.select(seller).distinct().join(profiles, seller)
    return asked.join(known, seller).drop("__at").withColumnRenamed("__n", "seller_rank")


def top_variants(items: DataFrame, parent: str, item: str, most: int) -> DataFrame:
    """For each parent its variants in order of identifier, `most` at most: items array, total, truncated."""
    ranked = items.withColumn("__n", F.row_number().over(Window.partitionBy(parent).orderBy(item)))
    listed = ranked.groupBy(parent).agg(F.count(F.lit(1)).alias("total"), F.sort_array(F.collect_list(F.when(F.col("__n") <= most, F.col(item)))).alias("items"))
    return listed.withColumn("truncated", F.col("total") > most)


def variant_prices(items: DataFrame, captures: DataFrame, key: str, stopped: str | None = None) -> DataFrame:
    """items with the price and state of their own page; a page that failed gives UNKNOWN and PARSER_MISS.

    stopped names a column that tells the items whose turn came after the charge cap was reached: they are not looked up, and NOT_APPLICABLE.
    """
    joined = items.join(captures.select(key, "price", "availability"), key, "left")
    late = F.coalesce(F.col(stopped), F.lit(False)) if stopped else F.lit(False)
    miss = F.col("price").isNull() & F.col("availability").isNull()
    return joined.withColumns({
        "status": F.when(late, "NOT_APPLICABLE").when(miss, "PARSER_MISS").otherwise("EXTRACTED"), "price": F.when(~late, F.col("price")),
        "availability": F.when(late, F.lit(None).cast("string")).otherwise(F.coalesce("availability", F.lit("UNKNOWN"))),
    })


def promote_variants(products: DataFrame, children: DataFrame, key: str, child: str) -> DataFrame:
    """Children that are no product yet, each once, to be processed as products; keys only."""
    return children.select(F.col(child).alias(key)).distinct().join(products.select(key), key, "left_anti")


def promote_all(products: DataFrame, children: DataFrame, key: str, parent: str, child: str, ceiling: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Children of products become products, and theirs in turn, until no new key comes up.

    Returns known(key, round) with round 0 for the products given, and sources(key, source): every product that names a key, each once, a product that
    names itself too. A round joins only the keys of the round before with children(parent, child) and leaves out all known ones, and is written to the shared
    folder, so the rounds are as many as the graph is deep and a lost executor costs a reread. With a ceiling no more than that many products are known:
    of a round that would go beyond it, the smallest keys.
    """
    edges = settled(children.select(F.col(parent).alias("__parent"), F.col(child).alias(key)).where(F.col("__parent").isNotNull() & F.col(key).isNotNull()).distinct())
    known = settled(products.select(key).where(F.col(key).isNotNull()).distinct().withColumn("round", F.lit(0)))
    frontier, number = known, 0
    while True:
        number += 1
        found = edges.join(frontier.select(F.col(key).alias("__parent")), "__parent", "left_semi").select(key).distinct().join(known.select(key), key, "left_anti")
        if ceiling is not None:
            found = found.orderBy(key).limit(max(0, ceiling - known.count()))
        frontier = settled(found.withColumn("round", F.lit(number)))
        if frontier.isEmpty():
            break
        known = settled(known.unionByName(frontier))
    sources = edges.join(known.select(F.col(key).alias("__parent")), "__parent", "left_semi").join(known.select(key), key, "left_semi").withColumnRenamed("__parent", "source")
    return known, sources


def buybox_offer(present: Column, seller: Column, price: Column, shipping: Column) -> Column:
    """One NEW offer made from the buy box; unknown shipping counts as nothing. Null where there is no buy box."""
    landed = price + F.coalesce(shipping, F.lit(0).cast("decimal(18,2)"))
    return F.when(present, F.struct(seller.alias("seller"), F.lit("NEW").alias("condition"), price.alias("itemPrice"), landed.alias("landedPrice")))
