"""Schema gate, promotion, cut-off, attempts, streamed and untyped comparison, capture source, bucketed baseline."""

import json

import pytest
from pyspark.sql import functions as F

from merchlake.functions import json_schema
from merchlake.operators import enrich, ledger, quality, records
from merchlake.plans import listing
from merchlake.sources import captures, tables
from merchlake.streaming import jobs


def broken(spark, schema, *values):
    rows = spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "j string")
    return [r[0] for r in rows.select(json_schema.schema_violations(F.try_parse_json("j"), schema)).collect()]


def test_schema_keywords(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 2}, "tags": {"type": "array", "items": {"enum": ["a", 1, None]}}, "x": {"oneOf": [{"type": "number"}, {"type": "integer"}]}, "more": {"additionalProperties": {"$ref": "#/definitions/word"}}}, "definitions": {"word": {"type": "string", "minLength": 2}}}
    assert broken(spark, schema, {}, {"n": 4.0}, {"n": 1}, {"n": 2.5}, "[1]", "{") == [[], [], ["/n must be >= 2"], ["/n must be integer"], ["/ must be object"], ["/ must be JSON"]]
    assert broken(spark, schema, {"tags": ["a", "b", 1, None, 2]}) == [["/tags/1 must be equal to one of the allowed values", "/tags/4 must be equal to one of the allowed values"]]
    assert broken(spark, schema, {"x": 1.5}, {"x": 1}, {"x": "s"}) == [[], ["/x must match exactly one schema in oneOf"], ["/x must be number", "/x must be integer", "/x must match exactly one schema in oneOf"]]
    assert broken(spark, schema, {"more": {"k": "ok", "l": "a", "m": 3}}) == [["/more/l must NOT have fewer than 2 characters", "/more/m must be string"]]
    with pytest.raises(ValueError, match="not compiled"):
        json_schema.schema_violations(F.lit(None).cast("variant"), {"dependencies": {}})
    with pytest.raises(ValueError, match="without end"):
        json_schema.schema_violations(F.lit(None).cast("variant"), {"properties": {"a": {"$ref": "#"}}} | {"definitions": {"a": {"properties": {"b": {"$ref": "#/definitions/a"}}}}, "properties": {"a": {"$ref": "#/definitions/a"}}})


def test_gate_splits_rows(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"]}}}
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": null}'), (3, "{}"), (4, '{"a": "x"}'), (5, None), (6, "")], "k int, j string")
    good, bad = json_schema.schema_gate(rows, "j", schema)
    assert good.columns == ["k", "j"] and sorted(r.k for r in good.collect()) == [1, 2]
    said = {r.k: (r.violations, r.status, r.reason) for r in bad.collect()}
    assert {k: v[0] for k, v in said.items()} == {3: ["/ must have required property 'a'"], 4: ["/a must be integer,null"], 5: ["/ must be JSON"], 6: ["/ must be JSON"]}
    assert {v[1:] for v in said.values()} == {("PARSER_ERROR", "OUTPUT_SCHEMA_VIOLATION")}


def test_a_record_is_parsed_once(spark):
    """One parse a record in the plan, no type of a whole object asked for, and a null member is a value of a wrong type, not one that is missing."""
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": ["object", "null"]}}}}
    rows = spark.createDataFrame([('{"a": null, "b": [null, {}, 1]}',), ('{"b": {}}',), ("[]",), ("{",)], "j string").repartition(1)
    judged = json_schema.schema_judged(rows, "j", schema)
    assert judged._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert sorted(r.violations for r in judged.collect()) == [["/ must be JSON"], ["/ must be object"], ["/ must have required property 'a'", "/b must be array"], ["/a must be string", "/b/2 must be object,null"]]


def test_golden_gate(spark):
    plain = spark.range(8).select(
        F.col("id").cast("string").alias("title"), F.concat(F.lit("B00000000"), F.col("id").cast("string")).alias("item"), F.lit("US").alias("marketplace"), F.lit("https://x.example/dp/1").alias("canonicalUrl"), F.timestamp_seconds(F.lit(86400)).alias("scrapedAt"),
        F.struct(F.lit("item").alias("type"), F.lit("x").alias("value")).alias("input"), F.struct(F.lit("catalog").alias("profile"), F.array(F.lit("pricing")).alias("requestedBlocks"), F.lit("product-detail").alias("billingEvent")).alias("retrieval"), F.struct(F.lit(5).alias("completenessScore")).alias("quality"),
    )
    rows = records.product_records(plain)
    n = F.col("title")
    rows = rows.withColumns({
        "scrapedAt": F.when(n == 1, None).otherwise(F.col("scrapedAt")), "location": F.when(n == 2, None).otherwise(F.col("location")), "status": F.when(n == 3, "BLOCKED").otherwise(F.col("status")),
        "pricing": F.when(n == 4, F.col("pricing").withField("status", F.lit("MAYBE"))).otherwise(F.col("pricing")), "item": F.when(n == 5, "short").otherwise(F.col("item")),
        "ratings": F.when(n == 6, F.col("ratings").withField("rating", F.lit(7.5))).otherwise(F.col("ratings")), "marketplace": F.when(n == 7, "XX").otherwise(F.col("marketplace")),
    })
    good, bad = quality.golden_gate(rows)
    assert [r.title for r in good.collect()] == ["0"]
    told = {r.title: r.violations for r in bad.collect()}
    for k, part in {"1": "/scrapedAt must be string", "2": "/location must be object", "3": "/status must be equal to constant", "4": "/pricing/status must be equal to one of", "5": "/item must match pattern", "6": "/ratings/rating must be <= 5", "7": "/marketplace must be equal"}.items():
        assert any(v.startswith(part) for v in told[k]) and told[k][-1] == "/ must match exactly one schema in oneOf", told[k]
    failed = records.failure_records(spark.range(2).select(F.lit("US").alias("marketplace"), F.struct(F.lit("item").alias("type"), F.lit("x").alias("value")).alias("input"), F.when(F.col("id") == 0, "BLOCKED").otherwise("SUCCESS").alias("status"), F.lit("CHALLENGE_PAGE").alias("reason")))
    good, bad = quality.golden_gate(failed)
    assert [r.status for r in good.collect()] == ["BLOCKED"] and bad.count() == 1


def test_promotion(spark):
    products = spark.createDataFrame([(1,), (1,), (10,), (None,)], "k long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (2, 4), (10, 2), (99, 100), (5, None), (None, 5), (1, 2)], "p long, c long")
    known, sources = enrich.promote_all(products, edges, "k", "p", "c")
    assert sorted(map(tuple, known.collect())) == [(1, 0), (2, 1), (3, 2), (4, 2), (10, 0)]
    assert sorted(map(tuple, sources.select("source", "k").collect())) == [(1, 2), (2, 3), (2, 4), (3, 1), (3, 4), (4, 4), (10, 2)]
    known, _ = enrich.promote_all(products, edges, "k", "p", "c", ceiling=4)
    assert sorted(r.k for r in known.collect()) == [1, 2, 3, 10]
    assert enrich.promote_all(products.limit(0), edges, "k", "p", "c")[0].count() == 0


def plain_commits(rows, cap):
    out, used, stop = [], 0, None
    for seq, failed, units in rows:
        if stop:
            out += [(seq, p, "RUN_ABORTED", stop, 0) for p in range(len(units))]
            continue
        for p, u in enumerate(units):
            got = 0 if failed else min(u, cap - used)
            used += got
            out.append((seq, p, "SUCCESS", None, got))
        stop = "BILLING_FAILED" if failed else "CHARGE_CAP_REACHED" if used >= cap else None
    return sorted(out, key=str)


@pytest.mark.parametrize("cap", [1, 7, 100, 10**6])
def test_dependent_cutoff(spark, monkeypatch, cap):
    monkeypatch.setattr(ledger, "RANGE_ROWS", 20)
    runs = {r: [(s, (s * 7 + r) % 53 == 11, [1, s % 4, s % 3]) for s in range(150)] for r in (1, 2)}
    rows = spark.createDataFrame([(r, s, p, u, f) for r, v in runs.items() for s, f, us in v for p, u in enumerate(us)], "run long, seq long, part int, units long, bad boolean")
    done = ledger.commit_records(rows, "run", "seq", "part", "units", cap, F.col("bad"))
    for r, v in runs.items():
        assert sorted((tuple(x) for x in done.where(F.col("run") == r).select("seq", "part", "status", "reason", "charged").collect()), key=str) == plain_commits(v, cap)


def test_attempts_of_a_hot_key(spark):
    """Thousands of attempts of one key are cut to the few that count before they are gathered."""
    rows = spark.range(5000).select(F.lit("hot").alias("k"), "id", F.lit(None).cast("string").alias("error"), F.lit(503).alias("status_code"), F.lit(True).alias("blocked"), F.lit(False).alias("not_found"), F.lit("CHALLENGE_PAGE").alias("reason"))
    got = ledger.fold_attempts(rows, "k", "id", 3).first()
    assert (got.status, got.reason, got.attempts, got.tier, got.status_code) == ("BLOCKED", "BLOCKED_AFTER_FALLBACK", 3, "RESIDENTIAL", 503)
    late = rows.where("id = 0").unionByName(rows.where("id = 1").withColumns({"blocked": F.lit(False), "status_code": F.lit(200)}))
    assert ledger.fold_attempts(late, "k", "id", 3).first().status == "SUCCESS" and ledger.fold_attempts(late, "k", "id", 3).first().tier == "RESIDENTIAL"


def record(spark, *values):
    """Records of (item, seq, price)."""
    rows = spark.createDataFrame(list(values), "item string, seq long, price double")
    made = records.product_records(rows.select("item", F.lit("US").alias("marketplace"), F.col("seq").cast("string").alias("title"), F.struct(F.struct(F.col("price").cast("decimal(18,2)").alias("amount"), F.lit("USD").alias("currency")).alias("currentPrice"), F.lit("EXTRACTED").alias("status")).alias("pricing")))
    return made.withColumn("seq", F.col("title").cast("long"))


def test_a_repeated_batch_has_one_outcome(spark, tmp_path):
    compared = jobs.RecordComparison(str(tmp_path), ("marketplace", "item"), "seq")
    first, second, third = record(spark, ("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)), record(spark, ("a", 3, 3.0), ("c", 1, 1.0)), record(spark, ("b", 2, 6.0), ("a", 4, 3.0))
    for n, batch in ((0, first), (1, second), (1, second), (2, third), (2, third)):
        compared(batch, n)
    rows = compared.changes(spark).select("item", "seq", "compared", F.transform("changes", lambda c: F.concat_ws(">", c["before"], c["after"])).alias("c")).collect()
    assert sorted((r.item, r.seq, r.compared, *r.c) for r in rows) == [("a", 1, False), ("a", 2, True, "1.00>2.00"), ("a", 3, True, "2.00>3.00"), ("a", 4, True), ("b", 1, False), ("b", 2, True, "5.00>6.00"), ("c", 1, False)]
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["batch=1", "batch=2"]


def test_state_keeps_only_what_is_compared(spark, tmp_path):
    """The state of a comparison holds no column that no comparison reads; a state of whole records is read as well."""
    compared = jobs.RecordComparison(str(tmp_path), ("marketplace", "item"), "seq")
    first = record(spark, ("a", 1, 1.0), ("b", 1, 5.0))
    first.write.parquet(str(tmp_path / "state" / "batch=0"))
    compared(record(spark, ("a", 2, 2.0), ("a", 3, 2.5)), 1)
    kept = spark.read.parquet(str(tmp_path / "state" / "batch=1"))
    assert kept.columns == ["marketplace", "item", "seq", "seen"] and sorted((r.item, r.seq) for r in kept.collect()) == [("a", 3), ("b", 1)]
    assert sorted((r.item, r.seq, r.compared, len(r.changes)) for r in compared.changes(spark).collect()) == [("a", 2, True, 1), ("a", 3, True, 1)]
    assert spark.conf.get(jobs.METHOD_LIMIT) != "8000"


def test_baseline_of_mixed_schemas(spark, tmp_path):
    old = ['{"status": "SUCCESS", "marketplace": "US", "item": "a", "scrapedAt": "1", "pricing": {"currentPrice": {"amount": 1, "currency": "USD"}, "status": "EXTRACTED"}}', '{"status": "SUCCESS", "marketplace": "US", "item": "a", "scrapedAt": "2", "pricing": {"currentPrice": {"amount": 2.5, "currency": "USD"}, "status": "EXTRACTED"}}',
           '{"status": "SUCCESS", "marketplace": "US", "item": "b", "scrapedAt": "1", "pricing": {"price": 3}}', '{"status": "BLOCKED", "marketplace": "US", "item": "c"}', "no json", '{"status": "SUCCESS", "marketplace": "US"}']
    spark.createDataFrame([(x,) for x in old], "value string").write.text(str(tmp_path / "b"))
    baseline = tables.read_untyped_baseline(spark, str(tmp_path / "b"), ["marketplace", "item"], "scrapedAt")
    got = {r.item: r.monitoring for r in listing.monitor_untyped(record(spark, ("a", 1, 3.0), ("b", 1, 3.0), ("c", 1, 1.0)).drop("seq"), baseline, "d").collect()}
    assert [(c.type, c.before, c.after, c.percentChange) for c in got["a"].changes] == [("PRICE_CHANGED", "2.50", "3.00", 20.0)] and got["a"].previousScrapedAt == "2"
    assert got["b"].compared and not got["b"].changes and "COMPARISON_SUPPRESSED:pricing:PREVIOUS_STATUS_MISSING" in got["b"].warnings and not got["c"].compared


def test_capture_source(spark, tmp_path):
    """A batch and a stream read of one folder give the same rows; market and label are pushed down to the folders; a broken line is a row of nulls."""
    captures.register(spark)
    rows = [(k, "US" if k % 2 else "DE", "PRODUCT" if k % 3 else "OFFERS", f"B{k:09d}", k % 5 == 0, "<p>é</p>") for k in range(40)]
    path = str(tmp_path / "caps")
    spark.createDataFrame(rows, "seq long, market string, label string, lookup_key string, ok boolean, html string").repartition(3).write.partitionBy("market", "label").json(path)
    (tmp_path / "caps" / "market=US" / "label=OFFERS" / "z-broken.json").write_text('{"seq": "x", "ok": 1}\nnot json\n')
    whole = spark.read.format("captures").load(path)
    assert whole.count() == 42 and whole.where("seq IS NULL").count() == 2
    picked = spark.read.format("captures").option("pushdown", "true").load(path).where("market = 'US' AND label = 'PRODUCT' AND ok")
    assert sorted(r.seq for r in picked.collect()) == [k for k, m, t, _, ok, _ in rows if m == "US" and t == "PRODUCT" and ok]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "market" in plan and "Filter" in plan and "(market" not in plan.split("Filter", 1)[1].split("\n", 1)[0].replace("isnotnull(market", "")
    assert {(r.market, r.label) for r in spark.read.format("captures").option("market", "DE,FR").option("label", "OFFERS").load(path).collect()} == {("DE", "OFFERS")}
    assert whole.where("market = 'US'").count() + whole.where("market = 'DE'").count() == whole.count() == 42
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = spark.readStream.format("captures").load(path)
    jobs.run_available(stream, out, state).awaitTermination()
    assert sorted(map(str, spark.read.schema(whole.schema).parquet(out).collect())) == sorted(map(str, whole.collect()))


def test_bucketed_baseline_is_not_moved(spark, tmp_path):
    """Monitoring joins a bucketed baseline where it lies: no exchange stands above its scan."""
    name = "baseline_of_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for n, made in enumerate([record(spark, ("a", 1, 1.0), ("b", 1, 2.0)), record(spark, ("a", 2, 3.0), ("b", 2, 2.0))]):  # read back, as constants are no join keys
            made.drop("seq").write.parquet(str(tmp_path / str(n)))
        old, new = (spark.read.schema(records.product_schema()).parquet(str(tmp_path / n)) for n in "01")
        tables.write_bucketed_baseline(old, name, buckets=4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = listing.monitor(new, spark.table(name), "d")
        lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
        at = next(k for k, line in enumerate(lines) if f"{name}[" in line or f".{name}" in line)
        sort = max(k for k in range(at) if "Sort [" in lines[k])  # the baseline's branch of the join, from its sort down to the scan
        assert "SortMergeJoin" in "".join(lines[:sort]) and not any("Exchange" in line for line in lines[sort:at]) and "Bucketed: true" in lines[at], "\n".join(lines)
        assert {r.item: r.monitoring.changed for r in found.collect()} == {"a": True, "b": False}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_stream_health_parts_its_rows_once(spark, tmp_path, monkeypatch):
    from merchlake.plans import catalogue, queries_records

    spark.range(400).selectExpr("id AS event_id", "id % 10 AS user_id", "CASE WHEN id % 3 = 0 THEN 'error' ELSE 'view' END AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    # a middle that no two evaluations agree on, as that of large tables
    monkeypatch.setattr(queries_records.F, "percentile_approx", lambda c, share: F.max(c) * 0 + F.java_method(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long") % 400)
    got = {r.run: r.outcomes for r in catalogue.QUERIES["stream_health"](spark, str(tmp_path)).collect()}
    assert got == {str(k): 80 for k in range(5)}
