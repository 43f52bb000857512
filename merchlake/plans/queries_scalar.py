"""Queries of the scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from merchlake.functions import numbers, text, urls
from merchlake.functions.markets import MARKETS
from merchlake.plans.registry import query, table

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("clean_text", r"""SELECT doc_id, nullif(trim(regexp_replace(text, '[\t\n\x0b\f\r \x{00a0}\x{2007}\x{2009}\x{202f}\x{2060}]+', ' ', 'g')), '') AS cleaned FROM documents""")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("label_match", """SELECT doc_id, CASE WHEN contains(lower(text), 'apache license') THEN 'Apache License' WHEN contains(lower(text), 'mit license') THEN 'MIT License'
  WHEN contains(lower(text), 'licensed under') THEN 'Licensed under' END AS label FROM documents""")
def label_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_label(F.col("text"), ["Apache License", "MIT License", "Licensed under"]).alias("label"))


_STOCK = ["Currently unavailable.", "Only 3 left in stock", "Pre-order now", "Usually ships within 2 days", "In Stock.", "Ask the seller", "Temporarily out of stock."]


@query("availability_class", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'OUT_OF_STOCK' WHEN 1 THEN 'LIMITED_STOCK' WHEN 2 THEN 'PREORDER' WHEN 3 THEN 'BACKORDER'
  WHEN 4 THEN 'IN_STOCK' WHEN 6 THEN 'OUT_OF_STOCK' END AS state FROM part""")
def availability_class(spark, sf):
    shown = F.element_at(F.array(*[F.lit(s) for s in _STOCK]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.availability_state(shown, MARKETS["US"]).alias("state"))


def _shown(cents, market, decimal=None, thousands=None):
    """A price as a market's page shows it."""
    decimal, thousands = decimal or market.decimal, thousands or market.thousands
    whole = F.floor(cents / 100)
    grouped = F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit(thousands), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    return F.concat(F.lit(market.symbols[0]), grouped, F.lit(decimal), F.lpad((cents % 100).cast("string"), 2, "0"))


def _cents(price):
    return F.round(price * 100).cast("long")


@query("localized_number_roundtrip", "SELECT p_partkey, m AS market, CAST(round(p_retailprice * 100) AS BIGINT) AS minor FROM part, (SELECT unnest(['US','UK','CA','DE','FR','IT','ES']) AS m)")
def localized_number_roundtrip(spark, sf):
    cents = _cents(F.col("p_retailprice"))
    return _per_market(table(spark, sf, "part"), lambda m: {"minor": numbers.money(_shown(cents, m), m)["minor"]}, ["p_partkey"])


def _per_market(rows, columns, keys):
    """rows once for each market: its expressions alone make a stage, so generated code stays small."""
    parts = [rows.select(*keys, F.lit(code).alias("market"), *[v.alias(k) for k, v in columns(m).items()]) for code, m in MARKETS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("number_refusal", "SELECT m AS market, count(*) AS refused FROM part, (SELECT unnest(['US','UK','CA','DE','FR','IT','ES']) AS m) GROUP BY m")
def number_refusal(spark, sf):
    cents = _cents(F.col("p_retailprice"))

    def refused(m):
        other = (",", ".") if m.decimal == "." else (".", ",")
        return {"value": numbers.localized_number(_shown(cents, m, *other), m)}

    return _per_market(table(spark, sf, "part"), refused, []).where("value IS NULL").groupBy("market").agg(F.count(F.lit(1)).alias("refused"))


@query("first_money", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS minor FROM lineitem")
def first_money(spark, sf):
    two = F.concat(F.lit("$"), F.format_number("l_extendedprice", 2), F.lit("$"), F.format_number(F.col("l_extendedprice") + 1, 2))
    return table(spark, sf, "lineitem").select(*LINE, numbers.first_money(two, MARKETS["US"]).alias("minor"))


@query("count_and_demand", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 5000 WHEN 3 THEN (o_orderkey % 9) * 1000 + 500 ELSE (o_orderkey % 90 + 1) * 1000 END AS counted,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 5000 WHEN 3 THEN (o_orderkey % 9) * 1000 + 500 ELSE (o_orderkey % 90 + 1) * 1000 END AS demanded FROM orders""")
def count_and_demand(spark, sf):
    k, kind = F.col("o_orderkey"), F.col("o_orderkey") % 4
    shown = (
        F.when(kind == 0, F.concat(F.regexp_replace(F.format_number(k % 5000, 0), "^$", "0"), F.lit(" ratings")))
        .when(kind == 1, F.concat((k % 90 + 1).cast("string"), F.lit("K")))
        .when(kind == 2, F.concat((k % 90 + 1).cast("string"), F.lit("K+ bought in past month")))
        .otherwise(F.concat((k % 9).cast("string"), F.lit(".5K")))
    )
    return table(spark, sf, "orders").select("o_orderkey", numbers.count(shown, MARKETS["US"]).alias("counted"), numbers.demand(shown, MARKETS["US"]).alias("demanded"))


@query("rating_parse", "SELECT d.doc_id, CAST(concat(l.quality * 3 + 1, '.', d.doc_id % 10) AS DOUBLE) AS rating FROM documents d JOIN labels l USING (doc_id)")
def rating_parse(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id")
    shown = F.concat((F.col("quality") * 3 + 1).cast("string"), F.lit(","), (F.col("doc_id") % 10).cast("string"), F.lit(" von 5 Sternen"))
    return joined.select("doc_id", numbers.rating(shown, MARKETS["DE"]).alias("rating"))


@query("round_half_up", "SELECT c_custkey, floor(c_acctbal * CAST(1.0000000000000002220446049250313 AS DOUBLE) * 10 + 0.5) / 10 AS rounded FROM customer")
def round_half_up(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numbers.half_up(F.col("c_acctbal"), 1).alias("rounded"))


@query("discount_percent", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_extendedprice > 0 AND l_extendedprice > l_extendedprice * (1 - l_discount) THEN
  floor((l_extendedprice - l_extendedprice * (1 - l_discount)) * CAST(100 AS DOUBLE) / l_extendedprice * CAST(1.0000000000000002220446049250313 AS DOUBLE) * 100 + 0.5) / 100 END AS percent FROM lineitem""")
def discount_percent(spark, sf):
    current = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf, "lineitem").select(*LINE, numbers.discount_percent(current, F.col("l_extendedprice")).alias("percent"))


@query("landed_price", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'R' THEN round(l_extendedprice * 100)
  WHEN l_linenumber % 3 = 0 THEN NULL ELSE round(l_extendedprice * 100) + round(l_tax * 1000) END AS BIGINT) AS landed FROM lineitem""")
def landed_price(spark, sf):
    shipping = F.when(F.col("l_linenumber") % 3 != 0, F.round(F.col("l_tax") * 1000).cast("long"))
    return table(spark, sf, "lineitem").select(*LINE, numbers.landed_price(_cents(F.col("l_extendedprice")), shipping, F.col("l_returnflag") == "R").alias("landed"))


@query("backoff_schedule", "SELECT event_id, CAST(least(5000, 250 * pow(2, event_id % 8)) AS BIGINT) AS wait_ms FROM events")
def backoff_schedule(spark, sf):
    return table(spark, sf, "events").select("event_id", numbers.backoff_ms(F.col("event_id") % 8 + 1).alias("wait_ms"))


_ID = "concat('B', lpad(CAST(p_partkey AS VARCHAR), 9, '0'))"


@query("url_classify", f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'url' WHEN 1 THEN 'url' WHEN 2 THEN 'seller' WHEN 3 THEN 'bestsellers' WHEN 4 THEN 'keyword' WHEN 5 THEN 'category' END AS type,
  CASE WHEN p_partkey % 8 < 2 THEN {_ID} END AS item, CASE WHEN p_partkey % 8 = 4 THEN p_name END AS keyword,
  CASE p_partkey % 8 WHEN 6 THEN 'MARKETPLACE_UNSUPPORTED' WHEN 7 THEN 'URL_UNSUPPORTED' END AS reason FROM part""")
def url_classify(spark, sf):
    item, host = F.concat(F.lit("b"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")), MARKETS["US"].host
    made = [
        F.concat(F.lit(f"https://{host}/Some-Name/dp/"), item, F.lit("/ref=x")), F.concat(F.lit(f"https://{host}/x?asin="), item),
        F.lit(f"https://{host}/sp?seller=A1B2C3D4E5F6"), F.lit(f"https://{host}/gp/bestsellers/toys"),
        F.concat(F.lit(f"https://{host}/s?k="), F.url_encode("p_name")), F.lit(f"https://{host}/b/?node=123"), F.lit("https://shop.example.org/dp/B000000001"), F.lit("not a url"),
    ]
    url = F.element_at(F.array(*made), (F.col("p_partkey") % 8 + 1).cast("int"))
    return urls.classify_urls(table(spark, sf, "part").select("p_partkey", url.alias("url")), "url", to="u").select("p_partkey", "u.type", "u.item", "u.keyword", "u.reason")


@query("page_url_parts", """SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def page_url_parts(spark, sf):
    part = [F.coalesce(F.try_parse_url("url", F.lit(p)), F.lit("")) for p in ("HOST", "PATH")]
    return table(spark, sf, "pages").select("page_id", part[0].alias("host"), part[1].alias("path"), F.try_parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"))


@query("page_url_next", """SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=[^&#]*') THEN regexp_replace(url, '([?&])page=[^&#]*', '\\1page=7')
  WHEN contains(url, '?') THEN url || '&page=7' ELSE url || '?page=7' END AS next_url FROM pages""")
def page_url_next(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.with_page(F.col("url"), F.lit(7)).alias("next_url"))


@query("url_build", f"""SELECT p_partkey, 'https://{MARKETS["DE"].host}/dp/' || {_ID} AS product, 'https://{MARKETS["DE"].host}/s?k=' || p_type || CASE WHEN p_size % 3 + 1 > 1 THEN '&page=' || CAST(p_size % 3 + 1 AS VARCHAR) ELSE '' END AS search FROM part""")
def url_build(spark, sf):
    item, host = F.concat(F.lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")), F.lit(MARKETS["DE"].host)
    return table(spark, sf, "part").select("p_partkey", urls.product_url(host, item).alias("product"), urls.search_url(host, F.col("p_type"), F.col("p_size") % 3 + 1).alias("search"))


@query("dimension_humanize", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM part")
def dimension_humanize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.humanize_dimension(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_name"))).alias("label"))


@query("json_field", """SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("rank_lines", "SELECT p_partkey, CAST(p_size AS BIGINT) AS main_rank, replace(p_brand, '#', ' ') AS main_category, p_partkey AS second_rank, p_type AS second_category FROM part")
def rank_lines(spark, sf):
    shown = F.concat(F.lit("#"), F.col("p_size").cast("string"), F.lit(" in "), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(" (See Top 100)  #"), F.format_number("p_partkey", 0), F.lit(" in "), F.col("p_type"))
    lines = text.rank_lines(shown)
    return table(spark, sf, "part").select("p_partkey", lines.alias("r")).select(
        "p_partkey", F.get("r", 0)["rank"].alias("main_rank"), F.get("r", 0)["category"].alias("main_category"), F.get("r", 1)["rank"].alias("second_rank"), F.get("r", 1)["category"].alias("second_category"))


@query("stable_index", "SELECT c_custkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % 97 AS slot FROM customer")
def stable_index(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numbers.stable_index(F.col("c_name"), 97).alias("slot"))


@query("offer_condition", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'USED' WHEN 2 THEN 'REFURBISHED' WHEN 3 THEN 'COLLECTIBLE' ELSE 'UNKNOWN' END AS condition FROM part")
def offer_condition(spark, sf):
    shown = F.element_at(F.array(*[F.lit(s) for s in ("Neu", "Usato - Buono", "Renewed (used)", "Collectible - New", "other")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.condition(shown).alias("condition"))


@query("positive_percent", "SELECT s_suppkey, CASE WHEN s_suppkey % 130 <= 100 THEN CAST(s_suppkey % 130 AS DOUBLE) END AS positive FROM supplier")
def positive_percent(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", numbers.percent(F.concat((F.col("s_suppkey") % 130).cast("string"), F.lit("% positive"))).alias("positive"))
