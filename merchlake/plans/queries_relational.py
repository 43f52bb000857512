"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from merchlake.functions.markets import MARKETS, market_table
from merchlake.functions.numbers import percent_change
from merchlake.functions.text import fulfillment
from merchlake.operators import compare, discover, enrich, ledger, plan, quality
from merchlake.plans.registry import query, table


def _cents(column):
    return F.round(F.col(column) * 100).cast("long")


# ---------------------------------------------------------------- planning


@query("plan_union", """WITH u AS (SELECT o_custkey AS key, o_orderkey AS seq, 0 AS source_rank FROM orders UNION ALL SELECT c_custkey, c_custkey, 1 FROM customer)
  SELECT key, source_rank, seq, merged FROM (SELECT *, count(*) OVER (PARTITION BY key) AS merged, row_number() OVER (PARTITION BY key ORDER BY source_rank, seq) AS n FROM u) WHERE n = 1""")
def plan_union(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("seq"))
    return plan.union_sources([asked, known], "key", "seq")


@query("dataset_ingest", """WITH f AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'https://shop.example.org/dp/B000000001' WHEN 1 THEN ' c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 2 THEN 'bad' WHEN 3 THEN NULL ELSE ' ' END AS v FROM customer)
  SELECT c_custkey AS row, trim(v) AS value, CASE c_custkey % 5 WHEN 0 THEN 'url' WHEN 1 THEN 'asin' END AS kind,
  CASE c_custkey % 5 WHEN 2 THEN 'ASIN_MALFORMED' WHEN 3 THEN 'DATASET_FIELD_MISSING' WHEN 4 THEN 'DATASET_FIELD_MISSING' END AS reason, 'ds#' || c_custkey || ':asin' AS ref FROM f""")
def dataset_ingest(spark, sf):
    k = F.col("c_custkey")
    value = F.when(k % 5 == 0, F.lit("https://shop.example.org/dp/B000000001")).when(k % 5 == 1, F.concat(F.lit(" c"), F.lpad(k.cast("string"), 9, "0"))).when(k % 5 == 2, "bad").when(k % 5 == 4, " ")
    return plan.ingest(table(spark, sf, "customer").select("c_custkey", value.alias("asin")), "asin", "c_custkey", "ds")


@query("dataset_lists", """WITH l AS (SELECT l_orderkey, list(CASE l_partkey % 4 WHEN 0 THEN 'https://shop.example.org/' || l_partkey WHEN 1 THEN ' b' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') WHEN 2 THEN 'bad' ELSE ' ' END) AS v FROM lineitem GROUP BY 1),
  e AS (SELECT o_orderkey, unnest(CASE WHEN len(list_filter(coalesce(v, []), lambda x: trim(x) <> '')) = 0 THEN [NULL] ELSE list_transform(list_filter(v, lambda x: trim(x) <> ''), lambda x: trim(x)) END) AS value FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
  SELECT o_orderkey AS row, value, CASE WHEN value LIKE 'https%' THEN 'url' WHEN value <> 'bad' THEN 'asin' END AS kind, CASE WHEN value IS NULL THEN 'DATASET_FIELD_MISSING' WHEN value = 'bad' THEN 'ASIN_MALFORMED' END AS reason, 'ds#' || o_orderkey || ':items' AS ref, count(*) AS n FROM e GROUP BY ALL""")
def dataset_lists(spark, sf):
    k, key = F.col("l_partkey") % 4, F.col("l_partkey").cast("string")
    value = F.when(k == 0, F.concat(F.lit("https://shop.example.org/"), key)).when(k == 1, F.concat(F.lit(" b"), F.lpad(key, 9, "0"))).when(k == 2, "bad").otherwise(" ")
    lists = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(value).alias("items"))
    rows = table(spark, sf, "orders").select("o_orderkey").join(lists, "o_orderkey", "left")
    return plan.ingest(rows, "items", "o_orderkey", "ds").groupBy("row", "value", "kind", "reason", "ref").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_limit", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row, c_name AS value FROM customer ORDER BY c_custkey LIMIT 100")
def dataset_limit(spark, sf):
    """The row limit of a stored dataset is the feature here."""
    return plan.ingest(table(spark, sf, "customer"), "c_name", "c_custkey", "ds", limit=100).select("row", "value")


@query("inline_items", r"SELECT p_partkey, i AS item FROM (SELECT p_partkey, unnest(string_split_regex(p_name, '[\s,;]+')) AS i FROM part) WHERE i <> ''")
def inline_items(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(plan.inline_items(F.col("p_name"))).alias("item"))


@query("dedupe_first_wins", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def dedupe_first_wins(spark, sf):
    return compare.earliest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("baseline_last_wins", """SELECT l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1""")
def baseline_last_wins(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return compare.latest(rows, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]).select("l_partkey", "l_suppkey", "l_extendedprice")


@query("provenance_merge", """WITH f AS (SELECT o_custkey, o_orderstatus, o_orderpriority, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2, 3)
  SELECT o_custkey, string_agg(o_orderstatus || '/' || o_orderpriority, '|' ORDER BY seq) AS discoveries, count(*) AS n FROM f GROUP BY o_custkey""")
def provenance_merge(spark, sf):
    merged = plan.merge_provenance(table(spark, sf, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    joined = F.array_join(F.transform("discoveries", lambda d: F.concat_ws("/", d["o_orderstatus"], d["o_orderpriority"])), "|")
    return merged.select("o_custkey", joined.alias("discoveries"), F.size("discoveries").cast("long").alias("n"))


@query("capacity_cutoff", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 1000 THEN 'SELECTED' ELSE 'RUN_ABORTED' END AS status FROM orders")
def capacity_cutoff(spark, sf):
    return plan.cut_at_capacity(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000)


# ---------------------------------------------------------------- discovery

FILTERS = {"min_price": 950, "max_price": 1800, "min_rating": 2, "min_reviews": 3, "prime_only": True, "sponsored": "exclude", "min_demand": 60, "min_discount": 5}
_CARDS = """cards AS (SELECT p.p_partkey, p.p_retailprice AS price, CAST(p.p_size % 6 AS DOUBLE) AS rating, e.reviews, p.p_size % 2 = 0 AS prime, p.p_size % 5 = 0 AS sponsored, e.demand, e.discount
  FROM part p LEFT JOIN (SELECT l_partkey, nullif(count(*) FILTER (year(l_shipdate) = 1996), 0) AS reviews, sum(l_quantity) FILTER (year(l_shipdate) = 1996) AS demand, max(l_discount) FILTER (year(l_shipdate) = 1996) * 100 AS discount FROM lineitem GROUP BY 1) e ON p.p_partkey = e.l_partkey),
judged AS (SELECT p_partkey, concat_ws(',', CASE WHEN price IS NULL THEN 'PRICE_MISSING' WHEN price < 950 THEN 'PRICE_BELOW_MIN' END, CASE WHEN price > 1800 THEN 'PRICE_ABOVE_MAX' END,
  CASE WHEN rating IS NULL THEN 'RATING_MISSING' WHEN rating < 2 THEN 'RATING_BELOW_MIN' END, CASE WHEN reviews IS NULL THEN 'REVIEW_COUNT_MISSING' WHEN reviews < 3 THEN 'REVIEW_COUNT_BELOW_MIN' END,
  CASE WHEN NOT prime THEN 'NOT_PRIME' END, CASE WHEN sponsored THEN 'SPONSORED_EXCLUDED' END, CASE WHEN demand IS NULL THEN 'DEMAND_MISSING' WHEN demand < 60 THEN 'DEMAND_BELOW_MIN' END,
  CASE WHEN discount IS NULL THEN 'DISCOUNT_MISSING' WHEN discount < 5 THEN 'DISCOUNT_BELOW_MIN' END) AS reasons FROM cards)"""


def _judged(spark, sf):
    lines, then = table(spark, sf, "lineitem"), F.year("l_shipdate") == 1996  # parts without a line of that year have no evidence
    evidence = lines.groupBy("l_partkey").agg(F.nullif(F.count_if(then), F.lit(0)).alias("reviews"), F.sum(F.when(then, F.col("l_quantity"))).alias("demand"), (F.max(F.when(then, F.col("l_discount"))) * 100).alias("discount"))
    part = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"), (F.col("p_size") % 6).cast("double").alias("rating"), (F.col("p_size") % 2 == 0).alias("prime"), (F.col("p_size") % 5 == 0).alias("sponsored"))
    return discover.filter_cards(part.join(evidence, part["p_partkey"] == evidence["l_partkey"], "left"), FILTERS)


@query("discovery_filter", f"WITH {_CARDS} SELECT p_partkey, reasons, reasons = '' AS matches FROM judged")
def discovery_filter(spark, sf):
    return _judged(spark, sf).select("p_partkey", F.array_join("reasons", ",").alias("reasons"), "matches")


@query("filter_histogram", f"WITH {_CARDS} SELECT reason, count(*) AS cards FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM judged) WHERE reason <> '' GROUP BY reason")
def filter_histogram(spark, sf):
    return discover.rejection_histogram(_judged(spark, sf))


@query("position_counters", """SELECT conv_id, turn, row_number() OVER page AS page_position, count(*) OVER run AS position, CASE WHEN role = 'user' THEN CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER run AS BIGINT) END AS sponsored_position,
  CASE WHEN role <> 'user' THEN CAST(sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END) OVER run AS BIGINT) END AS organic_position FROM conversations
  WINDOW page AS (PARTITION BY conv_id ORDER BY turn), run AS (PARTITION BY conv_id % 10 ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)""")
def position_counters(spark, sf):
    cards = table(spark, sf, "conversations").withColumn("source", F.col("conv_id") % 10)
    placed = discover.card_positions(cards, "source", "conv_id", "turn", F.col("role") == "user")
    return placed.select("conv_id", "turn", "page_position", "position", "sponsored_position", "organic_position")


@query("pages_read", """WITH p AS (SELECT conv_id % 10 AS source, conv_id AS page, count(*) AS cards FROM conversations GROUP BY 1, 2)
  SELECT source, page FROM (SELECT source, page, coalesce(sum(CASE WHEN cards > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM p) WHERE stops = 0 AND page <= 100""")
def pages_read(spark, sf):
    pages = table(spark, sf, "conversations").groupBy((F.col("conv_id") % 10).alias("source"), F.col("conv_id").alias("page")).agg(F.count(F.lit(1)).alias("cards"))
    return discover.pages_read(pages, "source", "page", 100, F.col("cards") <= 6, F.col("cards")).select("source", "page")


# ---------------------------------------------------------------- comparison

_SNAP = """snap AS (SELECT * FROM (SELECT l_partkey, year(l_shipdate) AS y, l_extendedprice AS price, l_discount AS discount, CASE l_returnflag WHEN 'R' THEN 'OUT_OF_STOCK' WHEN 'A' THEN 'IN_STOCK' ELSE 'LIMITED_STOCK' END AS stock, l_suppkey AS seller,
  row_number() OVER (PARTITION BY l_partkey, year(l_shipdate) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_suppkey DESC) AS n FROM lineitem WHERE year(l_shipdate) IN (1996, 1997)) WHERE n = 1),
cur AS (SELECT * FROM snap WHERE y = 1997), prev AS (SELECT * FROM snap WHERE y = 1996),
j AS (SELECT c.l_partkey, c.price, c.discount, c.stock, c.seller, p.price AS prev_price, p.discount AS prev_discount, p.stock AS prev_stock, p.seller AS prev_seller, p.l_partkey IS NOT NULL AS compared FROM cur c LEFT JOIN prev p USING (l_partkey))"""


def _snapshots(spark, sf):
    stock = F.when(F.col("l_returnflag") == "R", "OUT_OF_STOCK").when(F.col("l_returnflag") == "A", "IN_STOCK").otherwise("LIMITED_STOCK")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "price", "seller"]
    rows = table(spark, sf, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), stock.alias("stock"), F.col("l_suppkey").alias("seller"), "l_shipdate", "l_orderkey", "l_linenumber")
    now, before = (compare.latest(rows.where(F.year("l_shipdate") == y), ["l_partkey"], order).select("l_partkey", "price", "discount", "stock", "seller") for y in (1997, 1996))
    return compare.snapshot_join(now, before, ["l_partkey"])


@query("snapshot_join", f"WITH {_SNAP} SELECT l_partkey, price, prev_price, compared FROM j")
def snapshot_join(spark, sf):
    return _snapshots(spark, sf).select("l_partkey", "price", "prev_price", "compared")


@query("price_changes", f"""WITH {_SNAP} SELECT l_partkey, prev_price AS before, price AS after, floor((price - prev_price) * 100.0 / prev_price * CAST(1.0000000000000002220446049250313 AS DOUBLE) * 100 + 0.5) / 100 AS percent
  FROM j WHERE compared AND price IS DISTINCT FROM prev_price""")
def price_changes(spark, sf):
    changed = _snapshots(spark, sf).where(F.col("compared") & ~F.col("price").eqNullSafe(F.col("prev_price")))
    return changed.select("l_partkey", F.col("prev_price").alias("before"), F.col("price").alias("after"), percent_change(F.col("prev_price"), F.col("price")).alias("percent"))


@query("stock_transitions", """WITH s AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'OUT_OF_STOCK' WHEN 'purchase' THEN 'IN_STOCK' ELSE 'LIMITED_STOCK' END AS state FROM events),
  t AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
  SELECT event_id, CASE WHEN state = 'OUT_OF_STOCK' AND before <> 'OUT_OF_STOCK' THEN 'OUT_OF_STOCK' WHEN before = 'OUT_OF_STOCK' AND state = 'IN_STOCK' THEN 'BACK_IN_STOCK' END AS change FROM t""")
def stock_transitions(spark, sf):
    state = F.when(F.col("event_type") == "error", "OUT_OF_STOCK").when(F.col("event_type") == "purchase", "IN_STOCK").otherwise("LIMITED_STOCK")
    rows = table(spark, sf, "events").select("event_id", "user_id", state.alias("state"))
    before = F.lag("state").over(Window.partitionBy("user_id").orderBy("event_id"))
    return rows.withColumn("before", before).select("event_id", compare.stock_change(F.col("before"), F.col("state")).alias("change"))


@query("change_list", f"""WITH {_SNAP} SELECT l_partkey, CASE WHEN compared THEN concat_ws(',', CASE WHEN price IS DISTINCT FROM prev_price THEN 'PRICE_CHANGED' END, CASE WHEN discount IS DISTINCT FROM prev_discount THEN 'DISCOUNT_CHANGED' END,
  CASE WHEN stock = 'OUT_OF_STOCK' AND prev_stock <> 'OUT_OF_STOCK' THEN 'OUT_OF_STOCK' WHEN prev_stock = 'OUT_OF_STOCK' AND stock = 'IN_STOCK' THEN 'BACK_IN_STOCK' END,
  CASE WHEN seller IS DISTINCT FROM prev_seller THEN 'BUY_BOX_CHANGED' END) ELSE '' END AS changes, compared FROM j""")
def change_list(spark, sf):
    joined = _snapshots(spark, sf)
    both = F.col("compared")
    found = compare.changes(
        compare.value_change("PRICE_CHANGED", "pricing.currentPrice", F.col("prev_price"), F.col("price"), both)["type"],
        compare.value_change("DISCOUNT_CHANGED", "pricing.discountPercent", F.col("prev_discount"), F.col("discount"), both)["type"],
        F.when(both, compare.stock_change(F.col("prev_stock"), F.col("stock"))),
        compare.value_change("BUY_BOX_CHANGED", "buyBox.seller", F.col("prev_seller"), F.col("seller"), both)["type"],
    )
    return joined.select("l_partkey", F.array_join(found, ",").alias("changes"), "compared")


@query("suppressed_blocks", """SELECT d.doc_id, 'COMPARISON_SUPPRESSED:ratings:' || nullif(concat_ws(',', CASE WHEN d.n_chars < 500 THEN 'CURRENT_PARSER_MISS' END, CASE WHEN l.quality IS NULL THEN 'PREVIOUS_STATUS_MISSING' WHEN l.quality = 0 THEN 'PREVIOUS_PARSER_MISS' END), '') AS warning
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def suppressed_blocks(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    now = F.when(F.col("n_chars") < 500, "PARSER_MISS").otherwise("EXTRACTED")
    before = F.when(F.col("quality") == 0, "PARSER_MISS").when(F.col("quality") == 1, "NOT_PRESENT")
    return joined.select("doc_id", compare.suppression("ratings", now, before).alias("warning"))


# ---------------------------------------------------------------- enrichment


@query("offers_per_item", """WITH o AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_suppkey, l_orderkey, l_linenumber) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
  SELECT l_partkey, string_agg(CASE WHEN n <= 3 THEN CAST(l_suppkey AS VARCHAR) END, ',' ORDER BY n) AS sellers, count(*) AS total, count(*) > 3 AS truncated FROM o GROUP BY l_partkey""")
def offers_per_item(spark, sf):
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber").join(known, "l_suppkey")
    block = enrich.offers_block(lines, "l_partkey", ["l_extendedprice", "l_suppkey", "l_orderkey", "l_linenumber"], ["l_suppkey"], 3)
    return block.select("l_partkey", F.array_join(F.transform("items", lambda o: o["l_suppkey"].cast("string")), ",").alias("sellers"), "total", "truncated")


@query("seller_profiles", """WITH f AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_at FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY first_at, l_suppkey) AS n FROM f)
  SELECT l_partkey, l_suppkey, n AS seller_rank, s_name, n_name FROM r JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n <= 2""")
def seller_profiles(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    profiles = table(spark, sf, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "n_name")
    found = enrich.seller_profiles(table(spark, sf, "lineitem"), profiles, "l_partkey", "l_suppkey", "l_orderkey", 2)
    return found.select("l_partkey", "l_suppkey", F.col("seller_rank").cast("long").alias("seller_rank"), "s_name", "n_name")


@query("variant_topn", """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
  SELECT p_brand, count(*) AS total, string_agg(CASE WHEN n <= 5 THEN CAST(p_partkey AS VARCHAR) END, ',' ORDER BY n) AS items, count(*) > 5 AS truncated FROM r GROUP BY p_brand""")
def variant_topn(spark, sf):
    top = enrich.top_variants(table(spark, sf, "part"), "p_brand", "p_partkey", 5)
    return top.select("p_brand", "total", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), "truncated")


@query("variant_promotion", "SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def variant_promotion(spark, sf):
    products = table(spark, sf, "part").where("p_size < 25")
    return enrich.promote_variants(products, table(spark, sf, "lineitem").where("l_returnflag = 'R'"), "p_partkey", "l_partkey")


@query("variant_prices", """SELECT p_partkey, CASE WHEN price IS NULL THEN 'PARSER_MISS' ELSE 'EXTRACTED' END AS status, coalesce(availability, 'UNKNOWN') AS availability, price FROM part
  LEFT JOIN (SELECT *, CASE WHEN price IS NOT NULL THEN 'IN_STOCK' END AS availability FROM (SELECT l_partkey, max(l_extendedprice) FILTER (year(l_shipdate) = 1998) AS price FROM lineitem GROUP BY 1)) ON p_partkey = l_partkey""")
def variant_prices(spark, sf):
    captures = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.when(F.year("l_shipdate") == 1998, F.col("l_extendedprice"))).alias("price")).withColumn("availability", F.when(F.col("price").isNotNull(), "IN_STOCK"))
    return enrich.variant_prices(table(spark, sf, "part").select("p_partkey"), captures, "p_partkey").select("p_partkey", "status", "availability", "price")


@query("buybox_fallback", """WITH o AS (SELECT l_partkey, nullif(count(*) FILTER (year(l_shipdate) = 1998 AND l_returnflag = 'N' AND l_linenumber = 7), 0) AS n FROM lineitem GROUP BY 1)
  SELECT p_partkey, CASE WHEN n IS NOT NULL THEN 'EXTRACTED' WHEN p_size % 4 <> 0 THEN 'BUYBOX' END AS source,
  CAST(CASE WHEN n IS NULL AND p_size % 4 <> 0 THEN round(p_retailprice * 100) + CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END END AS BIGINT) AS landed FROM part LEFT JOIN o ON p_partkey = l_partkey""")
def buybox_fallback(spark, sf):
    offers = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.nullif(F.count_if((F.year("l_shipdate") == 1998) & (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7)), F.lit(0)).alias("n"))
    joined = table(spark, sf, "part").join(offers, F.col("p_partkey") == F.col("l_partkey"), "left")
    price = (_cents("p_retailprice") / 100).cast("decimal(18,2)")
    shipping = F.when(F.col("p_size") % 3 != 0, (F.col("p_size") / 100).cast("decimal(18,2)"))
    made = F.when(F.col("n").isNull(), enrich.buybox_offer(F.col("p_size") % 4 != 0, F.col("p_brand"), price, shipping))
    return joined.select("p_partkey", F.when(F.col("n").isNotNull(), "EXTRACTED").when(made.isNotNull(), "BUYBOX").alias("source"), (made["landedPrice"] * 100).cast("long").alias("landed"))


@query("fulfillment_class", """SELECT class, count(*) AS lines FROM (SELECT CASE WHEN l_linestatus <> 'F' AND l_suppkey % 7 = 0 THEN 'UNKNOWN' WHEN l_suppkey % 7 <> 0 AND contains(lower(s_name), '0001') THEN 'AMZ'
  WHEN l_linestatus = 'F' THEN 'FBA' ELSE 'FBM' END AS class FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY class""")
def fulfillment_class(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    shipper, seller = F.when(F.col("l_linestatus") == "F", F.lit("Depot 0001")), F.when(F.col("l_suppkey") % 7 != 0, F.col("s_name"))
    return joined.select(fulfillment(shipper, seller, ["0001"]).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("lines"))


@query("market_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def market_lookup(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    markets = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return table(spark, sf, "customer").join(markets, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


# ---------------------------------------------------------------- quality


@query("block_projection", "SELECT doc_id, n_chars AS content_chars, 'EXTRACTED' AS content_status, CAST(NULL AS INTEGER) AS quality, 'NOT_APPLICABLE' AS quality_status FROM documents LEFT JOIN labels USING (doc_id)")
def block_projection(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.struct(F.col("n_chars").alias("chars"), F.lit("EXTRACTED").alias("status")).alias("content"), F.struct("quality", F.lit("EXTRACTED").alias("status")).alias("score"))
    kept = quality.project_blocks(rows, {"content"}, ["content", "score"])
    return kept.select("doc_id", F.col("content.chars").alias("content_chars"), F.col("content.status").alias("content_status"), F.col("score.quality").alias("quality"), F.col("score.status").alias("quality_status"))


@query("completeness_score", """SELECT doc_id, CASE WHEN n_chars >= 500 THEN 25 ELSE 0 END + 25 + CASE WHEN source <> 'src0' THEN 10 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN coalesce(toxic, 1) = 0 THEN 15 ELSE 0 END AS score,
  concat_ws(',', CASE WHEN n_chars < 500 THEN 'id' END, CASE WHEN source = 'src0' THEN 'url' END, CASE WHEN quality IS NULL THEN 'price' END, CASE WHEN coalesce(toxic, 1) <> 0 THEN 'ratings' END) AS missing FROM documents LEFT JOIN labels USING (doc_id)""")
def completeness_score(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    weights = quality.WEIGHTS["fast"]
    there = {"id": F.col("n_chars") >= 500, "title": F.col("lang").isNotNull(), "url": F.col("source") != "src0", "price": F.col("quality").isNotNull(), "ratings": quality.present(F.when(F.col("toxic") == 0, "EXTRACTED").otherwise("PARSER_MISS"))}
    score, missing = quality.completeness({k: (weights[k], v) for k, v in there.items()})
    return rows.select("doc_id", score.alias("score"), F.array_join(missing, ",").alias("missing"))


_RULES = {"quantity": "l_quantity > 1", "discount": "l_discount BETWEEN 0 AND 0.09", "price": "l_extendedprice >= 1000", "flag": "l_returnflag IN ('A', 'N', 'R')"}


@query("schema_gate", "SELECT violations, count(*) AS lines FROM (SELECT concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({r}, FALSE) THEN '{n}' END" for n, r in _RULES.items()) + ") AS violations FROM lineitem) GROUP BY violations")
def schema_gate(spark, sf):
    good, bad = quality.gate(table(spark, sf, "lineitem"), {n: F.expr(r) for n, r in _RULES.items()})
    rows = good.select(F.lit("").alias("violations")).unionByName(bad.select(F.array_join("violations", ",").alias("violations")))
    return rows.groupBy("violations").agg(F.count(F.lit(1)).alias("lines"))


# ---------------------------------------------------------------- accounting


@query("pending_abort", "SELECT o_orderkey, 'RUN_ABORTED' AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_abort(spark, sf):
    settled = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return ledger.pending(table(spark, sf, "orders").select("o_orderkey"), settled, "o_orderkey")


def _events(spark, sf):
    return table(spark, sf, "events").withColumns({"run": F.date_format("ts", "yyyy-MM-dd"), "blocked": F.col("event_type") == "error"})


@query("trailing_block_rate", """WITH w AS (SELECT event_id, count(*) OVER h AS seen, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER h / count(*) OVER h AS rate FROM events WINDOW h AS (PARTITION BY CAST(ts AS DATE) ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
  SELECT event_id, round(CAST(rate AS DOUBLE), 6) AS block_rate, CASE WHEN seen < 10 THEN 'HEALTHY' WHEN rate >= 0.6 THEN 'ABORT' WHEN rate >= 0.35 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state,
  CASE WHEN seen < 10 THEN 8 WHEN rate >= 0.6 THEN 0 WHEN rate >= 0.35 THEN 4 ELSE 8 END AS allowed FROM w""")
def trailing_block_rate(spark, sf):
    return ledger.trailing_health(_events(spark, sf), "run", "event_id", F.col("blocked")).select("event_id", F.round("block_rate", 6).alias("block_rate"), "state", "allowed")


_CHARGES = """c AS (SELECT event_id, event_type, CAST(ts AS DATE) AS run, CAST(floor(value / 10) AS BIGINT) + 1 AS units FROM events WHERE event_type <> 'error'),
  d AS (SELECT *, greatest(0, least(units, 1000 - coalesce(sum(units) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS charged FROM c)"""


def _charged(spark, sf):
    charges = _events(spark, sf).where(~F.col("blocked")).withColumn("units", F.floor(F.col("value") / 10) + 1)
    return ledger.charge_with_cap(charges, "run", "event_id", "units", 1000)


@query("charge_cap", f"WITH {_CHARGES} SELECT event_id, CAST(charged AS BIGINT) AS charged, CASE WHEN charged = units THEN 'CHARGED' WHEN charged > 0 THEN 'PARTIAL' ELSE 'CAP_REACHED' END AS outcome FROM d")
def charge_cap(spark, sf):
    return _charged(spark, sf).select("event_id", "charged", "outcome")


@query("event_totals", f"WITH {_CHARGES} SELECT event_type, CAST(sum(charged) AS BIGINT) AS charged, CAST(sum(units - charged) AS BIGINT) AS refused FROM d GROUP BY event_type")
def event_totals(spark, sf):
    return ledger.event_totals(_charged(spark, sf), "event_type", "units")


@query("budget_gate", """SELECT event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER p, 0) < greatest(1, ceil(coalesce(count(*) OVER p, 0) * CAST(0.2 AS DOUBLE))) AS allowed
  FROM events WINDOW p AS (PARTITION BY CAST(ts AS DATE) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def budget_gate(spark, sf):
    rows = ledger.running_before(_events(spark, sf), "run", "event_id", {"used": F.when(F.col("blocked"), 1).otherwise(0), "requests": F.lit(1)})
    return rows.select("event_id", ledger.budget_allows(F.col("used"), F.col("requests"), 0.2).alias("allowed"))


@query("attempt_outcome", """SELECT user_id, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'SUCCESS' WHEN 'click' THEN 'PRODUCT_NOT_FOUND' ELSE CASE WHEN bool_or(event_type = 'error') THEN 'BLOCKED' ELSE 'FETCH_FAILED' END END AS status,
  CASE WHEN arg_max(event_type, event_id) <> 'purchase' THEN arg_max(event_type, event_id) END AS reason, count(*) AS attempts FROM events GROUP BY user_id""")
def attempt_outcome(spark, sf):
    attempts = _events(spark, sf).withColumns({"ok": F.col("event_type") == "purchase", "not_found": F.col("event_type") == "click", "reason": F.col("event_type")})
    return ledger.fetch_outcome(attempts, "user_id", "event_id").select("user_id", "status", "reason", "attempts")


@query("record_union", """SELECT o_orderkey AS key, 'SUCCESS' AS status, o_totalprice AS price, CAST(NULL AS VARCHAR) AS reason FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT o_orderkey, 'RUN_ABORTED', NULL, 'NO_LINES' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def record_union(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    good = orders.join(lines, "key", "left_semi").withColumn("status", F.lit("SUCCESS"))
    bad = ledger.pending(orders.select("key"), lines, "key").withColumn("reason", F.lit("NO_LINES"))
    return good.unionByName(bad, allowMissingColumns=True).select("key", "status", "price", "reason")


_SUMMARY = ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ledger.STATUSES)


@query("run_summary", f"""WITH r AS (SELECT CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'BLOCKED' ELSE 'FETCH_FAILED' END AS status FROM events)
  SELECT count(*) AS settled, {_SUMMARY}, count(*) AS attempts, count(*) FILTER (status = 'BLOCKED') AS blocked_attempts, round(count(*) FILTER (status = 'BLOCKED') / count(*), 4) AS block_rate FROM r""")
def run_summary(spark, sf):
    rows = _events(spark, sf)
    records = rows.select(F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("blocked"), "BLOCKED").otherwise("FETCH_FAILED").alias("status"))
    return ledger.run_summary(records, rows.select(F.col("blocked").alias("blocked_attempts")))


@query("windowed_health_batch", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS outcomes, count(*) FILTER (event_type = 'error') AS blocked FROM events GROUP BY 1")
def windowed_health_batch(spark, sf):
    windows = _events(spark, sf).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("outcomes"), F.count_if("blocked").alias("blocked"))
    return windows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "outcomes", "blocked")


@query("market_dimension", "SELECT code, currency, decimal, count(*) AS suppliers FROM (SELECT unnest(['US','UK','CA','DE','FR','IT','ES']) AS code, unnest(['USD','GBP','CAD','EUR','EUR','EUR','EUR']) AS currency, unnest(['.','.','.',',',',',',',',']) AS decimal, unnest(range(7)) AS i) JOIN supplier ON s_nationkey % 7 = i GROUP BY 1, 2, 3")
def market_dimension(spark, sf):
    codes = F.array(*[F.lit(c) for c in ("US", "UK", "CA", "DE", "FR", "IT", "ES")])
    suppliers = table(spark, sf, "supplier").select(F.get(codes, (F.col("s_nationkey") % 7).cast("int")).alias("code"))
    return suppliers.join(market_table(spark), "code").groupBy("code", "currency", "decimal").agg(F.count(F.lit(1)).alias("suppliers"))
