"""Queries of records, validation, monitoring, metering, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from merchlake.functions import numbers, text, urls
from merchlake.functions.markets import MARKETS, market_table
from merchlake.operators import compare, discover, ledger, plan, quality, records
from merchlake.plans import listing
from merchlake.plans.registry import query, table
from merchlake.sources import tables
from merchlake.streaming import jobs

US = MARKETS["US"]


def _folder(spark) -> str:
    """A new folder in the place that driver and executors share."""
    return f"{tables.shared_folder(spark)}/queries-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- records


@query("failure_rows", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FETCH_FAILED' ELSE 'BLOCKED' END AS status, 'R' || o_orderstatus AS reason, '1.5' AS version, false AS charged, 10 AS columns FROM orders")
def failure_rows(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("message"), F.when(F.col("o_orderstatus") == "F", "FETCH_FAILED").otherwise("BLOCKED").alias("status"), F.concat(F.lit("R"), F.col("o_orderstatus")).alias("reason"))
    made = records.failure_records(rows)
    return made.select(F.col("message").cast("long").alias("o_orderkey"), "status", "reason", F.col("schemaVersion").alias("version"), F.col("chargedProductEvent").alias("charged"), F.lit(len(made.columns)).alias("columns"))


@query("card_rows", f"""SELECT p_partkey, p_name AS title, CASE WHEN p_size % 3 > 0 THEN p_retailprice END AS price, CASE WHEN p_size % 3 > 0 THEN 'SEARCH_CARD' END AS source, CASE WHEN p_size % 3 > 0 THEN 'EXTRACTED' ELSE 'NOT_PRESENT' END AS pricing,
  CASE WHEN p_size % 2 = 0 THEN 'EXTRACTED' ELSE 'NOT_PRESENT' END AS ratings, p_type AS deal, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS images, p_size % 7 = 0 AS prime, CAST(p_size * 100 AS BIGINT) AS bought, 'NOT_APPLICABLE' AS variants, 'FROM_SEARCH_CARD' AS warning,
  'https://{US.host}/dp/' || p_partkey AS url, p_size % 4 AS page, 'product-basic' AS event, 100 AS score, 27 AS columns FROM part""")
def card_rows(spark, sf):
    part = table(spark, sf, "part")
    cards = part.select(
        F.col("p_partkey").alias("item"), F.col("p_brand").alias("lookup_key"), (F.col("p_size") % 4).alias("page"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice")).alias("price"), F.col("p_type").alias("badge"),
        F.when(F.col("p_size") % 2 == 0, 4.5).alias("rating"), F.when(F.col("p_size") % 5 == 0, F.lit("https://i.example/1.jpg")).alias("thumbnail"), (F.col("p_size") % 7 == 0).alias("prime"), (F.col("p_size") * 100).alias("demand"),
    )
    made = listing.card_records(cards, plan.check_options({"mode": "fast", "profile": "custom", "blocks": ["pricing", "availability", "ratings", "rankings", "media"]}))
    return made.select(
        F.col("item").cast("long").alias("p_partkey"), "title", F.col("pricing.currentPrice.amount").cast("double").alias("price"), F.col("pricing.priceSource").alias("source"), F.col("pricing.status").alias("pricing"), F.col("ratings.status").alias("ratings"),
        F.col("pricing.dealType").alias("deal"), F.size("media.images").alias("images"), F.col("availability.primeEligible").alias("prime"), F.col("rankings.boughtInPastMonthMin").alias("bought"), F.col("variants.status").alias("variants"), F.get("quality.warnings", 0).alias("warning"),
        F.col("canonicalUrl").alias("url"), F.get("discoveredFrom", 0)["page"].alias("page"), F.col("retrieval.billingEvent").alias("event"), F.col("quality.completenessScore").alias("score"), F.lit(len(made.columns)).alias("columns"))


@query("empty_blocks", "SELECT c_custkey, 'PARSER_MISS' AS pricing, 'NOT_PRESENT' AS rankings, 'NOT_APPLICABLE' AS offers, CAST(NULL AS VARCHAR) AS seller, 0 AS items, 27 AS columns FROM customer")
def empty_blocks(spark, sf):
    made = records.product_records(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("title")))
    return made.select(F.col("title").cast("long").alias("c_custkey"), F.col("pricing.status").alias("pricing"), F.col("rankings.status").alias("rankings"), F.col("offers.status").alias("offers"), F.col("buyBox.seller").alias("seller"), F.size("offers.items").alias("items"), F.lit(len(made.columns)).alias("columns"))


@query("first_strategy", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'OUT_OF_STOCK' WHEN l_linestatus = 'O' THEN 'EXTRACTED' WHEN l_returnflag = 'A' THEN 'PARSER_MISS' ELSE 'NOT_PRESENT' END AS status,
  CASE WHEN l_returnflag = 'R' THEN l_discount WHEN l_linestatus = 'O' THEN l_tax END AS value FROM lineitem""")
def first_strategy(spark, sf):
    first = F.when(F.col("l_returnflag") == "R", "OUT_OF_STOCK").when(F.col("l_returnflag") == "A", "PARSER_MISS").otherwise("NOT_PRESENT")
    second = F.when(F.col("l_linestatus") == "O", "EXTRACTED").otherwise("NOT_PRESENT")
    value, status = records.first_extracted([(F.col("l_discount"), first), (F.col("l_tax"), second)])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", status.alias("status"), value.alias("value"))


@query("location_blocks", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NOT_APPLICABLE' WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'EXTRACTED' ELSE 'REQUIRES_LOCATION' END AS status, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS postal,
  c_custkey % 3 = 1 AND c_custkey % 2 = 0 AS applied FROM customer""")
def location_blocks(spark, sf):
    code = F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    postal = F.when(F.col("c_custkey") % 3 != 0, code)
    shown = F.when((F.col("c_custkey") % 3 == 1) & (F.col("c_custkey") % 2 == 0), F.concat(F.lit("Deliver to Town "), code)).otherwise("Deliver to Elsewhere")
    applied = F.coalesce(text.location_verified(shown, postal), F.lit(False))
    block = quality.location_block(F.lit("US"), postal, F.when(applied, postal), applied, F.lit("ADDRESS_CHANGE"))
    return table(spark, sf, "customer").select("c_custkey", block.alias("b")).select("c_custkey", "b.status", F.col("b.requestedPostalCode").alias("postal"), "b.applied")


@query("location_required", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'READ' ELSE 'REQUIRES_LOCATION' END AS status, CASE WHEN o_orderstatus <> 'O' THEN 'LOCATION_NOT_APPLIED' END AS reason FROM orders")
def location_required(spark, sf):
    good, bad = quality.require_location(table(spark, sf, "orders").withColumn("location_applied", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O")), True)
    return good.withColumns({"status": F.lit("READ"), "reason": F.lit(None).cast("string")}).unionByName(bad).select("o_orderkey", "status", "reason")


@query("quality_blocks", """SELECT doc_id, CAST(CASE WHEN n_chars > 500 THEN 60 ELSE 20 END AS INTEGER) AS score, CASE WHEN n_chars > 500 THEN '' ELSE 'text' END AS missing, CASE WHEN lang = 'en' THEN 'EN_PAGE' ELSE 'UNKNOWN' END AS kind, 'NONE' AS tier, 0 AS attempts, false AS blocked,
  CASE WHEN source IS NULL THEN 'NO_SOURCE' ELSE 'S,T' END AS warnings FROM documents""")
def quality_blocks(spark, sf):
    score, missing = quality.completeness({"text": (40, F.col("n_chars") > 500), "id": (20, F.lit(True))})
    warned = quality.merge_warnings(F.when(F.col("source").isNull(), F.array(F.lit("NO_SOURCE"))).otherwise(F.array(F.lit("S"), F.lit("T"))), F.when(F.col("source").isNotNull(), F.array(F.lit("T"), F.lit("S"))).otherwise(F.array().cast("array<string>")))
    block = quality.quality_block(score, missing, kind=F.when(F.col("lang") == "en", "EN_PAGE"), warnings=warned)
    return table(spark, sf, "documents").select("doc_id", block.alias("q")).select(
        "doc_id", F.col("q.completenessScore").alias("score"), F.array_join("q.criticalFieldsMissing", ",").alias("missing"), F.col("q.pageType").alias("kind"), F.col("q.proxyTier").alias("tier"), F.col("q.fetchAttempts").alias("attempts"), F.col("q.blocked").alias("blocked"), F.array_join("q.warnings", ",").alias("warnings"))


@query("warning_union", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS warnings FROM events GROUP BY user_id")
def warning_union(spark, sf):
    kinds = lambda odd: F.collect_set(F.when(F.col("event_id") % 2 == odd, F.col("event_type")))  # noqa: E731  five event types
    both = table(spark, sf, "events").groupBy("user_id").agg(kinds(0).alias("a"), kinds(1).alias("b"))
    return both.select("user_id", F.array_join(F.array_sort(quality.merge_warnings(F.col("a"), F.col("b"))), ",").alias("warnings"))


@query("record_gate", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN 'SUCCESS' WHEN o_orderstatus = 'O' AND o_orderkey % 7 <> 0 THEN 'BLOCKED' ELSE 'PARSER_ERROR' END AS status,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'item' WHEN o_orderstatus = 'O' AND o_orderkey % 7 = 0 THEN 'reason' WHEN o_orderstatus = 'P' THEN 'status' ELSE '' END AS violations FROM orders""")
def record_gate(spark, sf):
    orders = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "BLOCKED").otherwise("OTHER")
    rows = orders.select(
        "o_orderkey", status.alias("status"), F.lit("1.5").alias("schemaVersion"), F.lit("US").alias("marketplace"), F.struct(F.lit("asin").alias("type"), F.lit("x").alias("value")).alias("input"),
        F.concat(F.lit("B"), F.lpad(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, 8).otherwise(9), F.lit("0"))).alias("item"), F.lit("https://x.example/dp/1").alias("canonicalUrl"), F.current_timestamp().alias("scrapedAt"),
        F.struct(F.lit("EXTRACTED").alias("status")).alias("pricing"), F.when(F.col("o_orderkey") % 7 != 0, "SLOW").alias("reason"), F.lit(False).alias("chargedProductEvent"),
    )
    good, bad = quality.record_gate(rows, ("pricing",), tuple(MARKETS))
    return good.withColumn("violations", F.array().cast("array<string>")).unionByName(bad).select("o_orderkey", "status", F.array_join("violations", ",").alias("violations"))


@query("critical_fields", "SELECT p_partkey, p_size % 3 > 0 AND (p_size % 2 = 0 OR p_size % 7 = 0) AS ok FROM part")
def critical_fields(spark, sf):
    title, item = F.when(F.col("p_size") % 3 == 1, F.col("p_name")), F.when(F.col("p_size") % 3 == 2, F.lit("B"))
    statuses = [F.when(F.col("p_size") % 2 == 0, "EXTRACTED").otherwise("PARSER_MISS"), F.when(F.col("p_size") % 7 == 0, "OUT_OF_STOCK")]
    return table(spark, sf, "part").select("p_partkey", quality.critical_ok(title, item, statuses).alias("ok"))


# ---------------------------------------------------------------- planning and validation


@query("integer_clamp", "SELECT o_orderkey, greatest(1, least(20, o_orderkey % 40 - 5)) AS pages, greatest(1, least(20, o_orderkey % 40 - 5)) <> o_orderkey % 40 - 5 AS warned FROM orders")
def integer_clamp(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", plan.clamped(F.col("o_orderkey") % 40 - 5, "max_pages").alias("c")).select("o_orderkey", F.col("c.value").alias("pages"), F.col("c.warned").alias("warned"))


@query("filter_bounds", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'min_price must be between 0 and 10000000' END AS price, CASE WHEN c_acctbal / 1000 NOT BETWEEN 0 AND 5 THEN 'min_rating must be between 0 and 5' END AS rating, CASE WHEN c_acctbal < 0 THEN 'min_reviews must be between 0 and 1000000000' WHEN c_acctbal <> floor(c_acctbal) THEN 'min_reviews must be a whole number' END AS reviews FROM customer")
def filter_bounds(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", plan.filter_error(b, "min_price").alias("price"), plan.filter_error(b / 1000, "min_rating").alias("rating"), plan.filter_error(b, "min_reviews").alias("reviews"))


@query("ordered_blocks", """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'pricing' END, CASE WHEN c_custkey % 3 = 0 THEN 'ratings' END, 'media') AS blocks, CASE WHEN c_custkey % 5 = 0 THEN 'product-basic' ELSE 'product-detail' END AS event FROM customer""")
def ordered_blocks(spark, sf):
    k = F.col("c_custkey")
    wanted = F.array_compact(F.array(F.lit("media"), F.when(k % 3 == 0, "ratings"), F.lit("unknown"), F.when(k % 2 == 0, "pricing"), F.lit("media")))
    blocks = plan.ordered_blocks(wanted)
    return table(spark, sf, "customer").select("c_custkey", F.array_join(blocks, ",").alias("blocks"), ledger.event_of(F.when(k % 5 == 0, "fast").otherwise("detail"), blocks).alias("event"))


@query("object_items", f"""WITH k AS (SELECT p_partkey, p_name, p_partkey % 9 AS k, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS item FROM part)
  SELECT p_partkey, CASE WHEN k IN (0, 3) THEN 'asin' WHEN k IN (1, 4, 5, 7) THEN 'url' WHEN k = 6 THEN 'keyword' END AS kind, CASE k WHEN 0 THEN item WHEN 1 THEN 'https://{US.host}/dp/' || item WHEN 3 THEN item WHEN 4 THEN 'https://x.example/' || p_partkey
  WHEN 5 THEN 'https://{MARKETS["DE"].host}/dp/' || item WHEN 6 THEN p_name WHEN 7 THEN 'https://{MARKETS["UK"].host}/s?k=' || replace(p_name, ' ', '+') END AS value, CASE k WHEN 2 THEN 'URL_UNSUPPORTED' WHEN 8 THEN 'MARKETPLACE_UNSUPPORTED' END AS reason FROM k""")
def object_items(spark, sf):
    item, name, k = F.concat(F.lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")), F.col("p_name"), F.col("p_partkey") % 9
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    row = (
        F.when(k == 0, F.lower(item)).when(k == 1, q(f"https://{US.host}/dp/", item)).when(k == 2, q('{"asin": "', item, '", "url": "https://x"}')).when(k == 3, q('{"asin": " ', item, ' ", "url": " "}'))
        .when(k == 4, q('{"url": "https://x.example/', F.col("p_partkey").cast("string"), '"}')).when(k == 5, q('{"asin": "', item, '", "marketplace": "de"}')).when(k == 6, q('{"keyword": "', name, '"}'))
        .when(k == 7, q('{"keyword": "', name, '", "marketplace": "UK"}')).otherwise(q('{"asin": "', item, '", "marketplace": "XX"}'))
    )
    return plan.object_items(table(spark, sf, "part").select("p_partkey", row.alias("raw")), "raw", "US").select("p_partkey", "kind", "value", "reason")


@query("bag_union", "SELECT o_custkey AS key, 0 AS source_rank, CAST(1 AS BIGINT) AS merged FROM orders UNION ALL SELECT c_custkey, 1, 1 FROM customer")
def bag_union(spark, sf):
    asked, known = (table(spark, sf, t).select(F.col(c).alias("key"), F.col(o).alias("seq")) for t, c, o in (("orders", "o_custkey", "o_orderkey"), ("customer", "c_custkey", "c_custkey")))
    return plan.union_sources([asked, known], "key", "seq", dedupe=False).select("key", "source_rank", "merged")


@query("direct_cards", "SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 4 = 0 OR l_quantity >= 20 AS matches FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_partkey % 2 = 0")
def direct_cards(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("even", (F.col("l_partkey") % 2).cast("int"))
    judged = lines.select("l_orderkey", "l_linenumber", "l_partkey", "even", F.when(F.col("l_quantity") < 20, F.array(F.lit("DEMAND_BELOW_MIN"))).otherwise(F.array().cast("array<string>")).alias("reasons")).withColumn("matches", F.size("reasons") == 0)
    wanted = table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("even"))
    return discover.direct_cards(judged, wanted, "l_orderkey", "even").select("l_orderkey", "l_linenumber", "l_partkey", "matches")


@query("truncation_notice", "SELECT CASE WHEN count(*) > 100 THEN 'only the first 100 rows are read' END AS small, CASE WHEN count(*) > 1000000000 THEN 'x' END AS large FROM orders")
def truncation_notice(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.agg(F.lit(tables.over_limit(orders, 100)).alias("small"), F.lit(tables.over_limit(orders, 1_000_000_000)).cast("string").alias("large"))


@query("market_rows", "SELECT code, host, c.n AS customers FROM (SELECT unnest(['US','UK','CA','DE','FR','IT','ES']) AS code, unnest([" + ",".join(f"'{MARKETS[c].host}'" for c in ("US", "UK", "CA", "DE", "FR", "IT", "ES")) + "]) AS host, unnest(range(7)) AS i) m JOIN (SELECT c_nationkey % 7 AS i, count(*) AS n FROM customer GROUP BY 1) c USING (i)")
def market_rows(spark, sf):
    codes = F.array(*[F.lit(c) for c in ("US", "UK", "CA", "DE", "FR", "IT", "ES")])
    counts = table(spark, sf, "customer").groupBy(F.get(codes, (F.col("c_nationkey") % 7).cast("int")).alias("code")).agg(F.count(F.lit(1)).alias("customers"))
    return counts.join(market_table(spark), "code").select("code", "host", "customers")


# ---------------------------------------------------------------- texts, numbers, addresses


@query("label_stripped", "SELECT s_suppkey, s_name AS plain FROM supplier")
def label_stripped(spark, sf):
    n = F.col("s_suppkey") % 3
    shown = F.when(n == 0, F.concat(F.lit(" SOLD BY:  "), F.col("s_name"))).when(n == 1, F.concat(F.lit("Ships from and sold by："), F.col("s_name"))).otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", text.strip_label(shown, ("Sold by", "Ships from and sold by")).alias("plain"))


@query("delivery_dates", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN dayname(o_orderdate) || ', ' || monthname(o_orderdate) || ' ' || day(o_orderdate) WHEN 1 THEN dayname(o_orderdate) || ', ' || day(o_orderdate) || ' ' || monthname(o_orderdate) END AS delivery FROM orders")
def delivery_dates(spark, sf):
    day, month, weekday = F.dayofmonth("o_orderdate").cast("string"), F.date_format("o_orderdate", "MMMM"), F.date_format("o_orderdate", "EEEE")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("FREE delivery "), weekday, F.lit(", "), month, F.lit(" "), day)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Arrives "), weekday, F.lit(", "), day, F.lit(" "), month)).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", text.delivery_date(shown).alias("delivery"))


@query("image_urls", "SELECT p_partkey, 'https://i.example/I/' || p_partkey || '.jpg' AS url FROM part")
def image_urls(spark, sf):
    small = F.concat(F.lit("https://i.example/I/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, "._AC_SX300_SY300_").otherwise(""), F.lit(".jpg"))
    return table(spark, sf, "part").select("p_partkey", text.max_resolution(small).alias("url"))


@query("seller_urls", f"""SELECT s_suppkey, 'https://{US.host}/sp?seller=A' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS profile, 'https://{US.host}/s?me=A' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS storefront, 'A' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS seller,
  'https://{US.host}/gp/product/ajax/ref=dp_aod_ALL_mbc?asin=A' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS offers FROM supplier""")
def seller_urls(spark, sf):
    seller, host = F.concat(F.lit("A"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")), F.lit(US.host)
    profile = urls.seller_url(host, seller)
    return table(spark, sf, "supplier").select("s_suppkey", profile.alias("profile"), urls.storefront_url(host, seller).alias("storefront"), urls.seller_id(profile).alias("seller"), F.substring_index(urls.offers_url(host, seller), "&", 1).alias("offers"))


@query("money_guards", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount * 100 = floor(l_discount * 100) THEN CAST(l_discount * 100 AS BIGINT) END AS minor, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) - l_linenumber END AS difference FROM lineitem")
def money_guards(spark, sf):
    made = numbers.whole_money(F.col("l_discount") * 100, F.lit("USD"))
    other = numbers.whole_money(F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", "USD").otherwise("EUR"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", made["minor"].alias("minor"), numbers.money_difference(numbers.whole_money(F.col("l_quantity"), F.lit("USD")), other).alias("difference"))


@query("location_helpers", """SELECT event_id, CAST(user_id AS VARCHAR) AS token, event_type <> 'error' AND event_id % 3 <> 1 AS accepted, CASE WHEN event_id % 2 = 0 THEN 'DE' END AS country, lpad(CAST(user_id AS VARCHAR), 5, '0') AS zip FROM events""")
def location_helpers(spark, sf):
    user, n = F.col("user_id").cast("string"), F.col("event_id")
    html = F.when(n % 2 == 0, F.concat(F.lit('<input name="anti-csrftoken-a2z" type="hidden" value="'), user, F.lit('">'))).otherwise(F.concat(F.lit("<script>csrfToken = '"), user, F.lit("';</script>")))
    body = F.when(n % 3 == 0, F.lit("<p>ok</p>")).when(n % 3 == 1, F.lit('{"success": 0}')).otherwise('{"isValidAddress": true}')
    form = text.location_payload(F.lpad(user, 5, "0"), F.when(n % 2 == 0, " de ").otherwise(" "))
    return table(spark, sf, "events").select("event_id", text.csrf_token(html).alias("token"), text.location_accepted(F.when(F.col("event_type") == "error", 503).otherwise(200), body).alias("accepted"), form["countryCode"].alias("country"), form["zipCode"].alias("zip"))


# ---------------------------------------------------------------- monitoring

_YEARS = """s AS (SELECT l_partkey, y, CAST(sum(l_extendedprice * 100) AS BIGINT) % 5000 / 100 AS price, count(DISTINCT l_suppkey) AS sellers, CAST(sum(l_quantity) AS BIGINT) AS reviews, min(l_linenumber) AS rank, max(l_suppkey) AS seller, max(CASE WHEN l_returnflag = 'R' THEN 'Save ' || l_linenumber || '%' END) AS coupon,
  CASE WHEN min(l_suppkey) % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN min(l_orderkey) % 5 = 0 THEN 'PARSER_MISS' ELSE 'EXTRACTED' END AS status FROM (SELECT *, year(l_shipdate) AS y, round(l_extendedprice, 2) AS p FROM lineitem) WHERE y IN (1996, 1997) GROUP BY 1, 2),
m AS (SELECT n.l_partkey, n.price, o.price AS old_price, n.sellers, o.sellers AS old_sellers, n.reviews, o.reviews AS old_reviews, n.rank, o.rank AS old_rank, n.seller, o.seller AS old_seller, n.coupon, o.coupon AS old_coupon, n.currency, o.currency AS old_currency, n.status, o.status AS old_status, o.l_partkey IS NOT NULL AS compared
  FROM (SELECT * FROM s WHERE y = 1997) n LEFT JOIN (SELECT * FROM s WHERE y = 1996) o USING (l_partkey))"""


def _monitored(spark, sf):
    """Records of 1997 against those of 1996, made from the lines of each part."""
    lines = table(spark, sf, "lineitem").withColumn("y", F.year("l_shipdate")).where("y IN (1996, 1997)")
    s = lines.groupBy("l_partkey", "y").agg(
        (F.sum(F.col("l_extendedprice") * 100).cast("decimal(38,6)")).alias("p"), F.count_distinct("l_suppkey").alias("sellers"), F.sum("l_quantity").cast("long").alias("reviews"), F.min("l_linenumber").cast("long").alias("rank"), F.max("l_suppkey").cast("string").alias("seller"),
        F.max(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Save "), F.col("l_linenumber").cast("string"), F.lit("%")))).alias("coupon"), F.when(F.min("l_suppkey") % 3 == 0, "EUR").otherwise("USD").alias("currency"), F.when(F.min("l_orderkey") % 5 == 0, "PARSER_MISS").otherwise("EXTRACTED").alias("status"),
    )
    status, off = F.col("status"), text.coupon(F.col("coupon"), US)
    rows = s.select(
        "y", F.col("l_partkey").cast("string").alias("item"), F.lit("US").alias("marketplace"),
        F.struct(F.struct((F.round("p").cast("long") % 5000 / 100).cast("decimal(18,2)").alias("amount"), F.col("currency").alias("currency"), F.lit(None).cast("string").alias("raw")).alias("currentPrice"), status.alias("status"), F.when(off.isNotNull(), F.struct(off["text"].alias("text"), off["type"].alias("type"), off["percent"].alias("percent"))).alias("coupon")).alias("pricing"),
        F.struct(F.lit("IN_STOCK").alias("state"), F.lit("EXTRACTED").alias("status")).alias("availability"), F.struct(F.col("seller").alias("sellerId"), F.lit("EXTRACTED").alias("status")).alias("buyBox"),
        F.struct(F.lit(True).alias("requested"), F.col("sellers").alias("totalCount"), status.alias("status")).alias("offers"), F.struct(F.col("rank").alias("mainBSR"), status.alias("status")).alias("rankings"), F.struct(F.col("reviews").alias("reviewCount"), status.alias("status")).alias("ratings"),
    )
    now, before = (records.product_records(rows.where(F.col("y") == y).drop("y")) for y in (1997, 1996))
    return listing.monitor(now, before, "d1996")


def _changes(spark, sf, kinds):
    """Changes of the kinds, a row each."""
    found = _monitored(spark, sf).select(F.col("item").cast("long").alias("l_partkey"), F.explode("monitoring.changes").alias("c"))
    return found.where(F.col("c.type").isin(*kinds)).select("l_partkey", F.col("c.type").alias("type"), F.col("c.before").alias("before"), F.col("c.after").alias("after"), F.col("c.percentChange").alias("percent"))


_FAIR = "compared AND status = 'EXTRACTED' AND old_status = 'EXTRACTED'"


def _moved(kind, column):
    percent = f"CASE WHEN old_{column} <> 0 THEN floor(({column} - old_{column}) * CAST(100 AS DOUBLE) / old_{column} * CAST(1.0000000000000002220446049250313 AS DOUBLE) * 100 + 0.5) / 100 END"
    return f"SELECT l_partkey, '{kind}' AS type, CAST(old_{column} AS VARCHAR) AS before, CAST({column} AS VARCHAR) AS after, {percent} AS percent FROM m WHERE {_FAIR} AND {column} IS DISTINCT FROM old_{column}"


@query("monitor_rank", f"WITH {_YEARS} {_moved('BSR_CHANGED', 'rank')}")
def monitor_rank(spark, sf):
    return _changes(spark, sf, ["BSR_CHANGED"])


@query("monitor_reviews", f"WITH {_YEARS} {_moved('REVIEW_COUNT_CHANGED', 'reviews')}")
def monitor_reviews(spark, sf):
    return _changes(spark, sf, ["REVIEW_COUNT_CHANGED"])


@query("monitor_sellers", f"WITH {_YEARS} {_moved('SELLER_COUNT_CHANGED', 'sellers')} UNION ALL SELECT l_partkey, 'BUY_BOX_CHANGED', CAST(old_seller AS VARCHAR), CAST(seller AS VARCHAR), NULL FROM m WHERE compared AND seller IS DISTINCT FROM old_seller")
def monitor_sellers(spark, sf):
    return _changes(spark, sf, ["SELLER_COUNT_CHANGED", "BUY_BOX_CHANGED"])


@query("monitor_coupon", f"WITH {_YEARS} SELECT l_partkey, CASE WHEN old_coupon IS NULL THEN 'COUPON_ADDED' WHEN coupon IS NULL THEN 'COUPON_REMOVED' ELSE 'DISCOUNT_CHANGED' END AS type FROM m WHERE {_FAIR} AND coupon IS DISTINCT FROM old_coupon")
def monitor_coupon(spark, sf):
    return _changes(spark, sf, ["COUPON_ADDED", "COUPON_REMOVED", "DISCOUNT_CHANGED"]).select("l_partkey", "type")


@query("monitor_currency", f"""WITH {_YEARS} SELECT l_partkey, concat_ws('|', CASE WHEN NOT compared THEN 'COMPARISON_NOT_AVAILABLE:NO_MATCHING_PREVIOUS_OBSERVATION' END,
  CASE WHEN compared THEN 'COMPARISON_SUPPRESSED:pricing:' || nullif(concat_ws(',', CASE WHEN status = 'PARSER_MISS' THEN 'CURRENT_PARSER_MISS' END, CASE WHEN old_status = 'PARSER_MISS' THEN 'PREVIOUS_PARSER_MISS' END), '') END,
  CASE WHEN {_FAIR} AND currency <> old_currency THEN 'COMPARISON_SUPPRESSED:pricing.currentPrice:CURRENCY_MISMATCH' END) AS warnings, coalesce({_FAIR} AND currency = old_currency AND price <> old_price, false) AS price_changed FROM m""")
def monitor_currency(spark, sf):
    m = F.col("monitoring")
    shown = F.filter(m["warnings"], lambda w: w.rlike("NOT_AVAILABLE|SUPPRESSED:pricing"))
    return _monitored(spark, sf).select(F.col("item").cast("long").alias("l_partkey"), F.array_join(shown, "|").alias("warnings"), F.exists(m["changes"], lambda c: c["type"] == "PRICE_CHANGED").alias("price_changed"))


@query("monitoring_counts", f"WITH {_YEARS} SELECT count(*) AS checked, count(*) FILTER (compared) AS compared, count(*) FILTER (compared AND (seller IS DISTINCT FROM old_seller OR ({_FAIR} AND (rank <> old_rank OR reviews <> old_reviews OR sellers <> old_sellers OR coupon IS DISTINCT FROM old_coupon OR (currency = old_currency AND price <> old_price))))) AS changed FROM m")
def monitoring_counts(spark, sf):
    return listing.monitoring_counts(_monitored(spark, sf))


# ---------------------------------------------------------------- metering and accounting


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("run", F.date_format("ts", "yyyy-MM-dd"))


@query("charge_outcomes", """WITH c AS (SELECT event_id, event_type, CAST(ts AS DATE) AS run, user_id % 4 + 1 AS units, CASE WHEN event_type = 'error' OR event_id % 10 = 3 THEN 0 ELSE user_id % 4 + 1 END AS asked FROM events),
  d AS (SELECT *, greatest(0, least(asked, 50 - coalesce(sum(asked) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS charged FROM c)
  SELECT event_id, CAST(charged AS BIGINT) AS charged, CASE WHEN event_type = 'error' THEN 'NOT_BILLABLE_STATUS' WHEN event_id % 10 = 3 THEN 'BACKEND_ERROR' WHEN charged = units THEN 'CHARGED' WHEN charged > 0 THEN 'PARTIAL' ELSE 'CAP_REACHED' END AS outcome, 'offer' AS event FROM d""")
def charge_outcomes(spark, sf):
    rows = _events(spark, sf).withColumns({"status": F.when(F.col("event_type") == "error", "BLOCKED").otherwise("SUCCESS"), "n": F.col("user_id") % 4 + 1})
    asked = ledger.charge_event(rows, "offer", F.col("n"))
    return ledger.charge_with_cap(asked.withColumn("units", F.col("n")), "run", "event_id", "units", 50, "status", F.col("event_id") % 10 == 3).select("event_id", "charged", "outcome", "event")


@query("record_charges", "SELECT c_custkey AS seq, 'product-detail' AS event, 1 AS units FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'offer', CAST(c_custkey % 4 AS INTEGER) FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 4 > 0")
def record_charges(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.struct(F.lit("EXTRACTED").alias("status"), F.transform(F.slice(F.array(*[F.lit(i) for i in range(3)]), F.lit(1), (F.col("c_custkey") % 4).cast("int")), lambda i: F.struct(i.cast("string").alias("sellerId"))).alias("items")).alias("offers"), F.col("c_custkey").cast("string").alias("title"))
    made = records.product_records(rows).withColumns({"seq": F.col("title").cast("long"), "status": F.when(F.col("title").cast("long") % 3 == 0, "BLOCKED").otherwise("SUCCESS")})
    return ledger_charges(made)


def ledger_charges(made):
    return records.charges(made, "product-detail").select("seq", "event", F.col("units").cast("int").alias("units"))


@query("search_outcomes", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'click') = 0 THEN 'PRODUCT_NOT_FOUND' ELSE 'SUCCESS' END AS status, CASE WHEN count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'click') = 0 THEN 'EMPTY_TEMPLATE' END AS reason FROM events GROUP BY user_id")
def search_outcomes(spark, sf):
    counted = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("pages"), F.count_if(F.col("event_type") == "click").alias("cards"))
    return counted.select("user_id", ledger.search_outcome(F.col("pages"), F.col("cards"), F.lit(None).cast("string")).alias("o")).select("user_id", "o.status", "o.reason")


@query("stop_reasons", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'RUN_ABORTED' WHEN o_orderkey % 100 >= 50 THEN 'MAX_PRODUCTS_REACHED' WHEN o_custkey % 7 = 0 THEN 'CHARGE_LIMIT_REACHED' WHEN o_custkey % 5 = 0 THEN 'BLOCK_RATE_ABORT' END AS reason FROM orders")
def stop_reasons(spark, sf):
    reason = ledger.stop_reason(F.col("o_orderstatus") == "P", F.col("o_orderkey") % 100, 50, F.col("o_custkey") % 7 == 0, F.when(F.col("o_custkey") % 5 == 0, "ABORT").otherwise("HEALTHY"))
    return table(spark, sf, "orders").select("o_orderkey", reason.alias("reason"))


@query("keyword_settles", "SELECT status, count(*) AS inputs FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'SUCCESS' ELSE 'BLOCKED' END AS status FROM orders UNION ALL SELECT CASE WHEN c_acctbal < 0 THEN 'PRODUCT_NOT_FOUND' ELSE 'SUCCESS' END FROM customer) GROUP BY status")
def keyword_settles(spark, sf):
    made = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("BLOCKED").alias("status"))
    searches = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), ledger.search_outcome(F.lit(1), F.when(F.col("c_acctbal") < 0, 0).otherwise(1), F.lit(None).cast("string"))["status"].alias("status"))
    return ledger.status_counts(ledger.settled_inputs(made, searches)).withColumnRenamed("items", "inputs")


@query("peak_concurrency", """WITH e AS (SELECT user_id % 5 AS run, event_id AS t, 1 AS step FROM events UNION ALL SELECT user_id % 5, event_id + user_id % 50 + 1, -1 FROM events), s AS (SELECT run, t, sum(step) AS step FROM e GROUP BY 1, 2)
  SELECT run, max(open) AS peak FROM (SELECT run, CAST(sum(step) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open FROM s) GROUP BY run""")
def peak_concurrency(spark, sf):
    spans = table(spark, sf, "events").select((F.col("user_id") % 5).alias("run"), F.col("event_id").alias("start"), (F.col("event_id") + F.col("user_id") % 50 + 1).alias("end"))
    return ledger.peak_concurrency(spans, "start", "end", "run")


@query("whole_summary", """SELECT (SELECT count(*) FROM orders) AS requested, (SELECT count(DISTINCT o_custkey) FROM orders) AS uniqueInputs, (SELECT count(*) - count(DISTINCT o_custkey) FROM orders) AS duplicatesMerged, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 4 > 0) AS success,
  (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 4 = 0) AS blocked, true AS accountingInvariantHolds, (SELECT count(*) FROM part WHERE p_size < 10) AS filteredOut, (SELECT count(*) FROM part WHERE p_size >= 10) AS discoveredProducts, (SELECT count(*) FROM part WHERE p_size < 10) AS tooSmall,
  (SELECT count(*) FILTER (event_type <> 'error' AND event_id % 3 = 1) FROM events) AS searchPagesFetched, (SELECT count(*) FILTER (event_id % 3 = 2) FROM events) AS primingRequests, (SELECT round(count(*) FILTER (event_type = 'error' AND event_id % 3 = 0) / count(*) FILTER (event_id % 3 = 0), 4) FROM events) AS blockRateProductPages,
  (SELECT count(*) FROM customer) AS monitoringChecked, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS monitoringChanged, (SELECT CAST(sum(s_nationkey) AS BIGINT) FROM supplier) AS successfulPaidEvents, false AS chargeCapReached, 'detail' AS mode, 37 AS fields""")
def whole_summary(spark, sf):
    orders, events = table(spark, sf, "orders"), table(spark, sf, "events")
    work = orders.groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("merged")).withColumn("market", F.lit("US"))
    settled = work.select("key", F.when(F.col("key") % 4 == 0, "BLOCKED").otherwise("SUCCESS").alias("status"))
    cards = table(spark, sf, "part").select(F.when(F.col("p_size") < 10, F.array(F.lit("SMALL"))).otherwise(F.array().cast("array<string>")).alias("reasons")).withColumn("matches", F.size("reasons") == 0)
    monitored = table(spark, sf, "customer").select(F.lit(True).alias("compared"), (F.col("c_acctbal") < 0).alias("changed"))
    kind = F.when(F.col("event_id") % 3 == 0, "PRODUCT").when(F.col("event_id") % 3 == 1, "SEARCH").otherwise("PRIMING")
    attempts = events.select(kind.alias("kind"), (F.col("event_type") == "error").alias("blocked"), F.lit(False).alias("residential"), F.col("event_id").alias("start"), (F.col("event_id") + 3).alias("end"))
    charges = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("charged"), F.lit("CHARGED").alias("outcome"))
    out = ledger.whole_summary(work, settled, cards, monitored, attempts, charges, "detail", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z", ("a", "a"))
    return out.select("requested", "uniqueInputs", "duplicatesMerged", "success", "blocked", "accountingInvariantHolds", "filteredOut", "discoveredProducts", F.col("filterRejections")["SMALL"].alias("tooSmall"), "searchPagesFetched", "primingRequests", "blockRateProductPages",
                      "monitoringChecked", "monitoringChanged", "successfulPaidEvents", "chargeCapReached", "mode", F.lit(len(out.columns)).alias("fields"))


# ---------------------------------------------------------------- sinks and streams


@query("append_twice", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey")
def append_twice(spark, sf):
    path, orders = _folder(spark), table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    firsts = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    for part in (orders.join(firsts, "o_custkey").where("o_orderkey % 2 = 0 OR first % 2 = 1").drop("first"), orders):  # the second append meets what the first one wrote
        tables.append_records(part.where("o_custkey IS NOT NULL"), path, {"price": F.col("o_totalprice") > 1000}, ["o_custkey"], ["o_orderkey"])
    return spark.read.parquet(path).select("o_custkey", "o_orderkey")


@query("export_round_trip", "SELECT form, c_custkey, c_name AS name, c_mktsegment AS segment FROM customer, (SELECT unnest(['json', 'csv', 'parquet']) AS form)")
def export_round_trip(spark, sf):
    rows, out = table(spark, sf, "customer").select("c_custkey", F.struct("c_name", "c_mktsegment").alias("who")), None
    for form in ("json", "csv", "parquet"):
        path = _folder(spark)
        tables.export(rows, path, form)
        back = spark.read.option("header", True).format(form).load(path)
        who = F.from_json("who", "c_name string, c_mktsegment string") if form == "csv" else F.col("who")
        part = back.select(F.lit(form).alias("form"), F.col("c_custkey").cast("long").alias("c_custkey"), who["c_name"].alias("name"), who["c_mktsegment"].alias("segment"))
        out = part if out is None else out.unionByName(part)
    return out


@query("summary_file", "SELECT count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders")
def summary_file(spark, sf):
    path = _folder(spark)
    tables.write_summary(table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_custkey").alias("keys")), path)
    return spark.read.json(path)


def _streamed(spark, sf, frame, job, form="append"):
    """What a stream over the rows of a frame leaves behind when all that there is has been processed."""
    source, sink = _folder(spark), _folder(spark)
    frame.write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    jobs.run_available(job(stream), f"{sink}/out", f"{sink}/state", mode=form).awaitTermination()
    return spark.read.parquet(f"{sink}/out")


@query("stream_first_rows", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_rows(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, sf, rows, lambda s: jobs.first_rows(s, ["user_id", "event_type"], "ts", "4000 days")).select("user_id", "event_type")


@query("stream_changes", "SELECT count(*) AS changes, count(DISTINCT user_id) AS users FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type <> before")
def stream_changes(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    found = _streamed(spark, sf, rows, lambda s: jobs.changes_by_key(s, "user_id", "event_id", "event_type"))
    return found.agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("key").alias("users"))


@query("late_sessions", """WITH e AS (SELECT *, CAST(ts AS TIMESTAMP) AS t FROM events), d AS (SELECT min(t) AS first FROM e),
  k AS (SELECT e.* FROM e, d WHERE NOT (event_id % 10 = 7 AND t < first + INTERVAL 8 DAY)),
  s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM k),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n FROM s)
  SELECT user_id, count(*) AS outcomes, epoch_us(max(t)) - epoch_us(min(t)) AS micros FROM g GROUP BY user_id, n""")
def late_sessions(spark, sf):
    """Sessions over batches out of order: rows a day late still join their session, rows ten days late are dropped."""
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    day = F.floor((F.unix_timestamp("ts") - rows.agg(F.unix_timestamp(F.min("ts"))).scalar()) / 86400)
    batch = F.when((F.col("event_id") % 10 == 7) & (day < 8), 2).when((F.col("event_id") % 10 == 3) & (day == 9), 1).otherwise(F.least(F.floor(day / 10), F.lit(2)))
    dealt = tables.settled(rows.withColumn("batch", batch))
    source, sink = _folder(spark), _folder(spark)
    for n in (0, 1, 2, 3):
        part = dealt.where(F.col("batch") == n) if n < 3 else dealt.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), "ts")  # a row far ahead closes all sessions
        part.select("user_id", "event_id", "ts").write.mode("append").parquet(source)
        stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(source)
        jobs.run_available(jobs.session_outcomes(stream, "user_id", "ts", "12 hours", "2 days"), f"{sink}/out", f"{sink}/state").awaitTermination()
    found = spark.read.parquet(f"{sink}/out")
    return found.select("user_id", "outcomes", (F.unix_micros("end") - F.unix_micros("start") - 43_200_000_000).alias("micros"))


@query("capture_source", "SELECT page, lookup_key, seq FROM (SELECT 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS lookup_key, CAST(p_partkey AS BIGINT) AS seq, CAST(p_size AS INTEGER) AS page FROM part WHERE p_partkey % 3 = 1 AND p_size % 2 = 0)")
def capture_source(spark, sf):
    """Captures of one market and label through the data source, which reads no other folder."""
    from merchlake.sources import captures

    captures.register(spark)
    part = table(spark, sf, "part")
    market = F.get(F.array(F.lit("US"), F.lit("DE"), F.lit("FR")), (F.col("p_partkey") % 3).cast("int"))
    rows = part.select(market.alias("market"), F.when(F.col("p_size") % 2 == 0, "PRODUCT").otherwise("OFFERS").alias("label"), F.col("p_partkey").alias("seq"), F.concat(F.lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("lookup_key"), F.col("p_size").cast("int").alias("page"), F.lit(True).alias("ok"))
    path = _folder(spark)
    rows.write.partitionBy("market", "label").json(path)
    return spark.read.format("captures").option("pushdown", "true").load(path).where((F.col("market") == "DE") & (F.col("label") == "PRODUCT")).select("page", "lookup_key", "seq")


@query("stream_health", """WITH e AS (SELECT CAST(user_id % 5 AS VARCHAR) AS run, event_type = 'error' AS blocked, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id DESC) AS back, count(*) OVER (PARTITION BY user_id % 5) AS outcomes FROM events),
  r AS (SELECT run, any_value(outcomes) AS outcomes, count(*) FILTER (blocked) AS bad, count(*) AS seen FROM e WHERE back <= 50 GROUP BY run)
  SELECT run, outcomes, bad / seen AS block_rate, CASE WHEN outcomes < 10 THEN 'HEALTHY' WHEN bad / seen >= 0.6 THEN 'ABORT' WHEN bad / seen >= 0.35 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state FROM r""")
def stream_health(spark, sf):
    """The breaker's state of each run after a stream of two batches."""
    rows = tables.settled(table(spark, sf, "events").select((F.col("user_id") % 5).alias("run"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("blocked")))
    # found once: a subquery in each of the two filters may find two middles, and rows between them would be lost or counted twice
    half = rows.agg(F.percentile_approx("seq", 0.5)).first()[0]
    source, sink = _folder(spark), _folder(spark)
    for part in (F.col("seq") <= half, F.col("seq") > half):
        rows.where(part).write.mode("append").parquet(source)
        stream = jobs.health(spark.readStream.schema(rows.schema).parquet(source))
        put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{sink}/out/batch={n}")
        stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{sink}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{sink}/out").groupBy("run").agg(F.max_by(F.struct("outcomes", "block_rate", "state"), "outcomes").alias("s"))
    return found.select("run", "s.outcomes", "s.block_rate", "s.state")
