"""Queries of the operators that iterate, fold or keep state: schema gate, promotion, cut-off, attempts, streamed and untyped comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from merchlake.functions import json_schema, text
from merchlake.functions.markets import MARKETS
from merchlake.operators import enrich, ledger, records
from merchlake.plans import listing
from merchlake.plans.registry import query, table
from merchlake.sources import tables
from merchlake.streaming import jobs

# ---------------------------------------------------------------- schema gate

ORDER_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["kind", "id", "status", "total", "currency", "lines"],
    "properties": {
        "kind": {"const": "order"}, "id": {"type": "integer", "minimum": 0}, "status": {"$ref": "#/definitions/status"}, "total": {"type": "number", "minimum": 0}, "currency": {"type": "string", "minLength": 3, "maxLength": 3},
        "url": {"type": "string", "pattern": "^https://"}, "note": {"type": ["string", "null"]}, "tags": {"type": "array", "uniqueItems": True, "items": {"type": "string"}},
        "payment": {"oneOf": [{"type": "string"}, {"type": "object", "required": ["iban"]}]}, "shipped": {"type": "boolean"}, "attrs": {"type": "object", "additionalProperties": {"type": "integer"}},
        "lines": {"type": "array", "items": {"$ref": "#/definitions/line"}},
    },
    "definitions": {
        "status": {"type": "string", "enum": ["F", "O", "P"]},
        "line": {"type": "object", "required": ["n", "qty"], "additionalProperties": False, "properties": {"n": {"type": "integer"}, "qty": {"type": "number", "maximum": 45}, "flag": {"type": "string"}}},
    },
}


@query("json_schema_gate", """WITH l AS (SELECT l_orderkey, string_agg('/lines/' || (i - 1) || '/qty must be <= 45', '|' ORDER BY i) FILTER (l_quantity > 45) AS lines FROM
    (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem) GROUP BY 1),
  v AS (SELECT o_orderkey, o_orderkey % 17 AS k, o_custkey, lines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
  SELECT o_orderkey, CASE WHEN k = 12 THEN '/ must be JSON' ELSE concat_ws('|', CASE WHEN k = 4 THEN '/ must have required property ''currency''' END, CASE WHEN k = 16 THEN '/kind must be equal to constant' END,
    CASE WHEN k IN (2, 13) THEN '/id must be integer' END, CASE WHEN k = 1 THEN '/status must be equal to one of the allowed values' END, CASE WHEN k = 3 THEN '/total must be >= 0' END,
    CASE k WHEN 5 THEN '/currency must NOT have more than 3 characters' WHEN 11 THEN '/currency must NOT have fewer than 3 characters' END, CASE WHEN k = 6 THEN '/url must match pattern "^https://"' END, CASE WHEN k = 9 THEN '/note must be string,null' END,
    CASE k WHEN 8 THEN '/tags must NOT have duplicate items' WHEN 14 THEN '/tags must be array' END, CASE WHEN k = 10 THEN '/payment must be string|/payment must be object|/payment must match exactly one schema in oneOf' END,
    CASE WHEN k = 15 THEN '/shipped must be boolean' END, CASE WHEN o_custkey % 5 = 0 THEN '/attrs/b must be integer' END, lines, CASE WHEN k = 7 THEN '/ must NOT have additional properties: extra' END) END AS violations FROM v""")
def json_schema_gate(spark, sf):
    one = F.to_json(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", one.alias("j")))), lambda x: x["j"]), ",").alias("lines"))
    # lines are dealt by the key already; a broadcast of them would leave the judging to the splits of orders alone
    rows = table(spark, sf, "orders").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k, n = F.col("o_orderkey") % 17, F.col("o_orderkey").cast("string")

    def put(name, good, **bad):
        """A member of the record; bad (k5=...) stands in its place in orders of that remainder, None leaves it out."""
        value = good if not isinstance(good, str) else F.lit(good)
        member = F.concat(F.lit(f'"{name}": '), value)
        for at, other in bad.items():
            kind = F.lit(None).cast("string") if other is None else F.concat(F.lit(f'"{name}": '), other if not isinstance(other, str) else F.lit(other))
            member = F.when(k == int(at[1:]), kind).otherwise(member)
        return member

    members = [
        put("kind", '"order"', k16='"other"'), put("id", n, k2=F.concat(F.lit('"'), n, F.lit('"')), k13=F.concat(n, F.lit(".5"))), put("status", F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')), k1='"X"'),
        put("total", F.abs("o_totalprice").cast("decimal(18,2)").cast("string"), k3="-1.5"), put("currency", '"USD"', k4=None, k5='"USDX"', k11='"US"'), put("url", '"https://x.example"', k6='"http://x.example"'), put("note", "null", k9="5", k1='"text"'),
        put("tags", '["a", "b"]', k8='["a", "b", "a"]', k14='{"a": 1}'), put("payment", F.when(F.col("o_custkey") % 2 == 0, '"cash"').otherwise('{"iban": "X"}'), k10="5"), put("shipped", "true", k15='"yes"'),
        put("attrs", F.when(F.col("o_custkey") % 5 == 0, '{"a": 1, "b": "x"}').otherwise('{"a": 1}')), F.concat(F.lit('"lines": ['), F.coalesce("lines", F.lit("")), F.lit("]")), F.when(k == 7, '"extra": 1'),
    ]
    record = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ", "), F.when(k == 12, "").otherwise("}"))
    return json_schema.schema_judged(rows.select("o_orderkey", record.alias("record")), "record", ORDER_SCHEMA).select("o_orderkey", F.array_join("violations", "|").alias("violations"))


# ---------------------------------------------------------------- promotion to a fixed point


@query("promoted_parts", """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS parent, l_partkey * 2 + l_linenumber % 2 AS child FROM lineitem WHERE l_partkey * 2 + l_linenumber % 2 < (SELECT count(*) FROM part)),
  r AS (SELECT p_partkey AS key, 0 AS round FROM part WHERE p_size % 10 = 7 AND p_partkey < 100 UNION SELECT child, round + 1 FROM r JOIN e ON parent = key WHERE round < 24),
  k AS (SELECT key, min(round) AS round FROM r GROUP BY key)
  SELECT key, CAST(round AS INTEGER) AS round, (SELECT count(*) FROM e WHERE child = key AND parent IN (SELECT key FROM k)) AS sources FROM k""")
def promoted_parts(spark, sf):
    part, child = table(spark, sf, "part"), F.col("l_partkey") * 2 + F.col("l_linenumber") % 2
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("parent"), child.alias("child")).where(F.col("child") < part.agg(F.count(F.lit(1))).scalar())
    roots = part.where("p_size % 10 = 7 AND p_partkey < 100").select(F.col("p_partkey").alias("key"))
    known, sources = enrich.promote_all(roots, edges, "key", "parent", "child")
    counted = sources.groupBy("key").agg(F.count(F.lit(1)).alias("sources"))
    return known.join(counted, "key", "left").select("key", "round", F.coalesce("sources", F.lit(0)).alias("sources"))


# ---------------------------------------------------------------- dependent cut-off

CAP = 60


@query("dependent_cutoff", f"""WITH RECURSIVE e AS (SELECT CAST(ts AS DATE) AS run, event_id, user_id % 4 AS offers, user_id % 2 AS sellers, event_id % 97 = 5 AS failed, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS n FROM events),
  w AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST('' AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS base, CAST(0 AS BIGINT) AS offered, CAST(0 AS BIGINT) AS sold, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS stop FROM e
    UNION ALL SELECT run, n, event_id, CASE WHEN stop IS NULL THEN 'SUCCESS' ELSE 'RUN_ABORTED' END, stop, base, offered, sold, used + base + offered + sold,
      CASE WHEN stop IS NOT NULL THEN stop WHEN failed THEN 'BILLING_FAILED' WHEN used + base + offered + sold >= {CAP} THEN 'CHARGE_CAP_REACHED' END
    FROM (SELECT *, CASE WHEN asked THEN greatest(0, least(sellers, {CAP} - used - base - offered)) ELSE 0 END AS sold FROM (SELECT *, CASE WHEN asked THEN greatest(0, least(offers, {CAP} - used - base)) ELSE 0 END AS offered FROM
      (SELECT e.*, w.used, w.stop, w.stop IS NULL AND NOT failed AS asked, CASE WHEN w.stop IS NULL AND NOT failed THEN 1 ELSE 0 END AS base FROM w JOIN e ON e.run = w.run AND e.n = w.n + 1))))
  SELECT event_id, status, reason, base, offered AS offers, sold AS sellers FROM w WHERE n > 0""")
def dependent_cutoff(spark, sf):
    events = table(spark, sf, "events").withColumn("run", F.date_format("ts", "yyyy-MM-dd"))
    units = F.array(F.lit(1).cast("long"), F.col("user_id") % 4, F.col("user_id") % 2)
    charges = events.select("run", "event_id", (F.col("event_id") % 97 == 5).alias("failed"), F.posexplode(units).alias("part", "units"))
    done = ledger.commit_records(charges, "run", "event_id", "part", "units", CAP, F.col("failed"))
    parts = {"base": 0, "offers": 1, "sellers": 2}
    return done.groupBy("event_id").agg(F.max("status").alias("status"), F.max("reason").alias("reason"), *[F.sum(F.when(F.col("part") == k, F.col("charged")).otherwise(0)).alias(n) for n, k in parts.items()])


# ---------------------------------------------------------------- attempts as a fold


@query("attempt_fold", """WITH RECURSIVE a AS (SELECT user_id, event_id % 17 AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, '' AS done, 'DATACENTER' AS tier, 'DATACENTER' AS used, CAST(NULL AS VARCHAR) AS reason, false AS blocked FROM a
    UNION ALL SELECT f.user_id, a.n, CASE WHEN m = 12 THEN 'PRODUCT_NOT_FOUND' WHEN m = 13 THEN 'FETCH_FAILED' WHEN m > 13 THEN 'SUCCESS' ELSE '' END,
      CASE WHEN m < 8 AND tier = 'DATACENTER' AND f.user_id % 5 > 2 THEN 'RESIDENTIAL' ELSE tier END, tier,
      CASE WHEN m IN (8, 9) THEN 'TIMEOUT' WHEN m = 10 THEN 'REDIRECT_LOOP' WHEN m IN (11, 13) THEN 'HTTP_STATUS' WHEN m = 12 THEN 'DOG_PAGE' WHEN m > 13 THEN NULL WHEN tier = 'RESIDENTIAL' THEN 'BLOCKED_AFTER_FALLBACK'
        WHEN f.user_id % 5 = 0 THEN 'RESIDENTIAL_FALLBACK_DISABLED' WHEN f.user_id % 5 = 1 THEN 'BLOCKED_AFTER_FALLBACK' WHEN f.user_id % 5 = 2 THEN 'ESCALATION_BUDGET_EXHAUSTED' WHEN m % 2 = 0 THEN 'CHALLENGE_PAGE' ELSE 'EMPTY_TEMPLATE' END,
      CASE WHEN m < 8 THEN true WHEN m IN (12, 13) THEN false ELSE blocked END
    FROM f JOIN a ON a.user_id = f.user_id AND a.n = f.n + 1 WHERE done = '' AND f.n < 4)
  SELECT user_id, CASE WHEN done <> '' THEN done WHEN blocked THEN 'BLOCKED' ELSE 'FETCH_FAILED' END AS status, reason, CAST(n AS INTEGER) AS attempts, used AS tier, blocked FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM f WHERE n > 0) WHERE back = 1""")
def attempt_fold(spark, sf):
    m, user = F.col("event_id") % 17, F.col("user_id") % 5
    error = F.when(m.isin(8, 9), "connect ETIMEDOUT").when(m == 10, "Too many redirects").when(m == 11, "socket hang up")
    code = F.when(m == 12, 404).when(m == 13, 410).when(m < 4, 503).otherwise(200)
    reason = F.when(m >= 8, F.lit(None).cast("string")).when(m % 2 == 0, F.lit("CHALLENGE_PAGE")).otherwise("EMPTY_TEMPLATE")
    attempts = table(spark, sf, "events").select("user_id", "event_id", error.alias("error"), code.alias("status_code"), (m < 8).alias("blocked"), (m == 12).alias("not_found"), reason.alias("reason"))
    return ledger.fold_attempts(attempts, "user_id", "event_id", 4, user != 0, user != 1, user != 2).select("user_id", "status", "reason", "attempts", "tier", "blocked")


# ---------------------------------------------------------------- comparison by stream, and against records of other schemas

_BY_YEAR = """s AS (SELECT l_partkey, y, CAST(sum(l_extendedprice * 100) AS BIGINT) % 5000 / 100 AS price, count(DISTINCT l_suppkey) AS sellers, CAST(sum(l_quantity) AS BIGINT) AS reviews, min(l_linenumber) AS rank, max(l_suppkey) AS seller, max(CASE WHEN l_returnflag = 'R' THEN 'Save ' || l_linenumber || '%' END) AS coupon,
  CASE WHEN min(l_suppkey) % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN min(l_orderkey) % 5 = 0 THEN 'PARSER_MISS' ELSE 'EXTRACTED' END AS status FROM (SELECT *, year(l_shipdate) AS y FROM lineitem) GROUP BY 1, 2)"""


def _records(spark, sf):
    """Records of each part and year, with the year as y."""
    # dealt by part once, so that no step of the grouping with its distinct count moves lines again
    lines = table(spark, sf, "lineitem").withColumn("y", F.year("l_shipdate")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_partkey")
    s = lines.groupBy("l_partkey", "y").agg(
        (F.sum(F.col("l_extendedprice") * 100).cast("decimal(38,6)")).alias("p"), F.count_distinct("l_suppkey").alias("sellers"), F.sum("l_quantity").cast("long").alias("reviews"), F.min("l_linenumber").cast("long").alias("rank"), F.max("l_suppkey").cast("string").alias("seller"),
        F.max(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Save "), F.col("l_linenumber").cast("string"), F.lit("%")))).alias("coupon"), F.when(F.min("l_suppkey") % 3 == 0, "EUR").otherwise("USD").alias("currency"), F.when(F.min("l_orderkey") % 5 == 0, "PARSER_MISS").otherwise("EXTRACTED").alias("status"),
    )
    status, off = F.col("status"), text.coupon(F.col("coupon"), MARKETS["US"])
    rows = s.select(
        "y", F.col("l_partkey").cast("string").alias("item"), F.lit("US").alias("marketplace"),
        F.struct(F.struct((F.round("p").cast("long") % 5000 / 100).cast("decimal(18,2)").alias("amount"), F.col("currency").alias("currency"), F.lit(None).cast("string").alias("raw")).alias("currentPrice"), status.alias("status"), F.when(off.isNotNull(), F.struct(off["text"].alias("text"), off["type"].alias("type"), off["percent"].alias("percent"))).alias("coupon")).alias("pricing"),
        F.struct(F.lit("IN_STOCK").alias("state"), F.lit("EXTRACTED").alias("status")).alias("availability"), F.struct(F.col("seller").alias("sellerId"), F.lit("EXTRACTED").alias("status")).alias("buyBox"),
        F.struct(F.lit(True).alias("requested"), F.col("sellers").alias("totalCount"), status.alias("status")).alias("offers"), F.struct(F.col("rank").alias("mainBSR"), status.alias("status")).alias("rankings"), F.struct(F.col("reviews").alias("reviewCount"), status.alias("status")).alias("ratings"),
    )
    made = records.product_records(rows.withColumnRenamed("y", "title"))
    return made.withColumn("y", F.col("title").cast("int"))


def _kinds(fair: str, only: str = "true") -> str:
    """SQL: the changes of a row m against its old_ columns, a row each; `only` limits those of rank and reviews."""
    kinds = [
        ("PRICE_CHANGED", f"{fair} AND currency = old_currency AND price <> old_price"), ("BUY_BOX_CHANGED", "old_seller IS NOT NULL AND seller <> old_seller"), ("SELLER_COUNT_CHANGED", f"{fair} AND sellers <> old_sellers"),
        ("BSR_CHANGED", f"{fair} AND {only} AND rank <> old_rank"), ("REVIEW_COUNT_CHANGED", f"{fair} AND {only} AND reviews <> old_reviews"), ("COUPON_ADDED", f"{fair} AND old_coupon IS NULL AND coupon IS NOT NULL"),
        ("COUPON_REMOVED", f"{fair} AND old_coupon IS NOT NULL AND coupon IS NULL"), ("DISCOUNT_CHANGED", f"{fair} AND coupon <> old_coupon"),
    ]
    return " UNION ALL ".join(f"SELECT l_partkey, y, '{kind}' AS type FROM m WHERE {rule}" for kind, rule in kinds)


_OLD = ", ".join(f"lag({c}) OVER p AS old_{c}" for c in ("price", "sellers", "reviews", "rank", "seller", "coupon", "currency", "status"))


@query("stream_comparison", f"WITH {_BY_YEAR}, m AS (SELECT *, {_OLD} FROM s WINDOW p AS (PARTITION BY l_partkey ORDER BY y)) {_kinds('''status = 'EXTRACTED' AND old_status = 'EXTRACTED' ''')}")
def stream_comparison(spark, sf):
    place = f"{tables.shared_folder(spark)}/comparison-{uuid.uuid4().hex}"
    made = _records(spark, sf).select("marketplace", "item", "y", *[c for c in records.BLOCKS if c not in ("monitoring", "location")])
    made.write.parquet(f"{place}/made")  # records of mostly empty blocks: columns hold them in far less than rows
    made = spark.read.schema(made.schema).parquet(f"{place}/made")
    comparison = jobs.RecordComparison(f"{place}/out", ("marketplace", "item"), "y")
    for first, last in ((0, 1994), (1995, 1996), (1997, 9999)):  # three batches, as three runs of a schedule would find them
        batch = made.where(F.col("y").between(first, last))
        batch.write.mode("append").parquet(f"{place}/in")
        jobs.compare_records(spark.readStream.schema(made.schema).parquet(f"{place}/in"), comparison, f"{place}/checkpoint").awaitTermination()
    comparison(batch, 2)  # the last batch once more, as after a failure between its writes and its commit
    found = comparison.changes(spark).select(F.col("item").cast("long").alias("l_partkey"), F.col("y").cast("long").alias("y"), F.explode("changes").alias("c"))
    return found.select("l_partkey", "y", F.col("c.type").alias("type"))


@query("untyped_baseline", f"""WITH {_BY_YEAR}, n AS (SELECT * FROM s WHERE y = 1997), o AS (SELECT * FROM s WHERE y = 1996),
  m AS (SELECT n.*, {", ".join(f"o.{c} AS old_{c}" for c in ("price", "sellers", "reviews", "rank", "seller", "coupon", "currency", "status"))}, o.l_partkey IS NOT NULL AS compared FROM n LEFT JOIN o USING (l_partkey)),
  c AS ({_kinds('''status = 'EXTRACTED' AND old_status = 'EXTRACTED' ''', "l_partkey % 2 = 1")}), g AS (SELECT l_partkey, string_agg(type, ',' ORDER BY type) AS types FROM c GROUP BY 1)
  SELECT m.l_partkey, m.compared, coalesce(types, '') AS types, CAST(CASE WHEN m.compared AND m.l_partkey % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS missing FROM m LEFT JOIN g USING (l_partkey)""")
def untyped_baseline(spark, sf):
    made = _records(spark, sf)
    before = made.where("y = 1996").drop("y")
    # half of the stored records are of an older schema, without rankings and with ratings that bear no status
    older = before.where("item % 2 = 0").select(F.to_json(F.struct(*[c for c in before.columns if c not in ("rankings", "ratings")], F.struct(F.col("ratings.reviewCount").alias("reviewCount")).alias("ratings"))).alias("value"))
    newer = before.where("item % 2 = 1").select(F.to_json(F.struct(*before.columns)).alias("value"))
    place = f"{tables.shared_folder(spark)}/baseline-{uuid.uuid4().hex}"
    older.unionByName(newer).write.text(place)
    baseline = tables.read_untyped_baseline(spark, place, ["marketplace", "item"], "scrapedAt")
    m = F.col("monitoring")
    found = listing.monitor_untyped(made.where("y = 1997").drop("y"), baseline, "d1996")
    return found.select(F.col("item").cast("long").alias("l_partkey"), m["compared"].alias("compared"), F.array_join(F.array_sort(F.transform(m["changes"], lambda c: c["type"])), ",").alias("types"),
                        F.size(F.filter(m["warnings"], lambda w: F.contains(w, F.lit("PREVIOUS_STATUS_MISSING")))).alias("missing"))
