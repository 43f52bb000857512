"""Accounting: statuses, the invariant, metering with a cap, health of fetches, the run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.functions.numbers import rate

#: Record statuses, the health thresholds.
STATUSES = ("SUCCESS", "INVALID_INPUT", "PRODUCT_NOT_FOUND", "BLOCKED", "FETCH_FAILED", "PARSER_ERROR", "GEO_RESTRICTED", "REQUIRES_LOCATION", "RUN_ABORTED")
WINDOW, LEAST_OUTCOMES, ABORT_RATE, DEGRADED_RATE = 50, 10, 0.6, 0.35


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("items"))


def assert_settled(work: DataFrame, settled: DataFrame, key: str) -> None:
    """Every key of work is settled once and no other is, or an error that names up to 50 of them."""
    open_ = work.join(settled, key, "left_anti").select(key).union(settled.join(work, key, "left_anti").select(key))
    twice = settled.groupBy(key).count().where("count > 1").select(key)
    if wrong := [r[0] for r in open_.union(twice).limit(50).collect()]:
        raise AssertionError(f"unaccounted keys: {wrong}")


def pending(work: DataFrame, settled: DataFrame, key: str) -> DataFrame:
    """Work that nothing settled, as RUN_ABORTED."""
    return work.join(settled.select(key), key, "left_anti").withColumn("status", F.lit("RUN_ABORTED"))


#: Rows of a run that are put in order together.
RANGE_ROWS = 100_000


def _ranges(rows: DataFrame, run: str, order: str) -> DataFrame:
    """rows with __range: consecutive pieces of each run in order, of about RANGE_ROWS rows, so that a long run is no single task.

    Borders are approximate quantiles of the order, which only say where a run is cut.
    """
    counts = rows.groupBy(run).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(order, [k / 256 for k in range(1, 256)], 2000).alias("__q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(256 * RANGE_ROWS) / F.col("__n"))).cast("int")
    borders = F.when(F.col("__n") > RANGE_ROWS, F.filter("__q", lambda x, i: (i + 1) % step == 0)).otherwise(F.slice("__q", 1, 0))
    cut = counts.select(F.col(run).alias("__of"), borders.alias("__borders"))
    joined = rows.join(cut, rows[run].eqNullSafe(cut["__of"]))
    return joined.withColumn("__range", F.size(F.filter("__borders", lambda x: x < F.col(order)))).drop("__of", "__borders")


def running_before(rows: DataFrame, run: str, order: str, values: dict[str, Column]) -> DataFrame:
    """rows with, for each name, the sum of its value over the rows of the run before this one (order is unique within a run)."""
    cut = _ranges(rows.withColumns({f"__v_{k}": v for k, v in values.items()}), run, order)
    sums = cut.groupBy(run, "__range").agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in values])
    ahead = Window.partitionBy(run).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sums.select(F.col(run).alias("__r"), F.col("__range").alias("__k"), *[F.coalesce(F.sum(f"__s_{k}").over(ahead), F.lit(0)).alias(f"__o_{k}") for k in values])
    inside = Window.partitionBy(run, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumns({f"__i_{k}": F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in values})
    joined = own.join(offsets, own[run].eqNullSafe(offsets["__r"]) & (own["__range"] == offsets["__k"]))
    return joined.withColumns({k: F.col(f"__o_{k}") + F.col(f"__i_{k}") for k in values}).drop("__range", "__r", "__k", *[f"__{x}_{k}" for k in values for x in "vio"])


def trailing_health(outcomes: DataFrame, run: str, order: str, blocked: Column, limit: int = 8) -> DataFrame:
    """outcomes with block_rate over the last WINDOW of the run, the state it means, and the workers then allowed.

    A range of a run needs only the WINDOW - 1 rows before it, which the range before hands over.
    """
    cut = _ranges(outcomes.withColumn("__b", F.when(blocked, 1).otherwise(0)), run, order)
    back = F.row_number().over(Window.partitionBy(run, "__range").orderBy(F.col(order).desc()))
    # borders are hundreds of rows apart at least, so no window reaches over a whole range
    tails = cut.withColumn("__back", back).where(F.col("__back") < WINDOW).select(run, "__range", order, "__b")
    handed = tails.withColumns({"__range": F.col("__range") + 1, "__own": F.lit(False)})
    rows = cut.withColumn("__own", F.lit(True)).unionByName(handed, allowMissingColumns=True)
    window = Window.partitionBy(run, "__range").orderBy(order).rowsBetween(1 - WINDOW, 0)
    seen = F.count(F.lit(1)).over(window)
    rows = rows.withColumns({"seen": seen, "block_rate": F.sum("__b").over(window) / seen}).where("__own").drop("__own", "__b", "__range")
    state = F.when(F.col("seen") < LEAST_OUTCOMES, "HEALTHY").when(F.col("block_rate") >= ABORT_RATE, "ABORT").when(F.col("block_rate") >= DEGRADED_RATE, "DEGRADED").otherwise("HEALTHY")
    allowed = F.when(F.col("state") == "ABORT", 0).when(F.col("state") == "DEGRADED", max(1, limit // 2)).otherwise(limit)
    return rows.withColumn("state", state).withColumn("allowed", allowed)


def charge_with_cap(charges: DataFrame, run: str, order: str, units: str, cap: int, status: str | None = None, failed: Column | None = None) -> DataFrame:
    """charges with `charged`: units accepted in order until the run's cap, partly at the border; and the outcome.

    With a status, rows that are not billable ask for nothing (NOT_BILLABLE_STATUS); rows whose backend failed are not charged (BACKEND_ERROR).
    """
    billable = F.lit(True) if status is None else F.coalesce(F.col(status) == "SUCCESS", F.lit(False))
    sound = F.lit(True) if failed is None else ~F.coalesce(failed, F.lit(False))
    asked = F.when(billable & sound, F.col(units)).otherwise(0)
    rows = running_before(charges, run, order, {"__before": asked}).withColumn("charged", F.greatest(F.lit(0), F.least(asked, F.lit(cap) - F.col("__before"))).cast("long")).drop("__before")
    return rows.withColumn("outcome", F.when(~billable, "NOT_BILLABLE_STATUS").when(~sound, "BACKEND_ERROR").when(F.col("charged") == F.col(units), "CHARGED").when(F.col("charged") > 0, "PARTIAL").otherwise("CAP_REACHED"))


#: Events of one record at most.
PARTS = 16


def commit_records(charges: DataFrame, run: str, order: str, part: str, units: str, cap: int, failed: Column) -> DataFrame:
    """charges with the status and reason of their record, the units charged and their outcome.

    Records of a run commit in order, each with its base charge (part 0) and then the others. The record whose charges reach the cap is the last: it stays, its
    charges are cut at the cap. A base charge that fails lets its record stay, uncharged in all parts, and is the last too. Later records are RUN_ABORTED
    with CHARGE_CAP_REACHED or BILLING_FAILED, and charge nothing. Until a run's stop all that is asked is charged, so a prefix sum finds the stop, over
    ranges of a run; then what follows is voided.
    """
    of_record = Window.partitionBy(run, order)  # a few rows each
    base_failed = F.coalesce(F.max(F.when(F.col(part) == 0, F.coalesce(failed, F.lit(False)))).over(of_record), F.lit(False))
    rows = charges.withColumns({"__failed": base_failed, "__place": F.col(order).cast("long") * PARTS + F.col(part)})
    rows = rows.withColumn("__asked", F.when(F.col("__failed"), 0).otherwise(F.col(units)).cast("long"))
    rows = running_before(rows, run, "__place", {"__before": F.col("__asked")})
    stops = F.when(F.col("__failed") & (F.col(part) == 0), "BILLING_FAILED").when(F.col("__before") + F.col("__asked") >= cap, "CHARGE_CAP_REACHED")
    stop = rows.where(stops.isNotNull()).groupBy(F.col(run).alias("__run")).agg(F.min(F.struct(F.col("__place").alias("place"), F.col(order).alias("order"), stops.alias("reason"))).alias("__stop"))
    joined = rows.join(stop, rows[run].eqNullSafe(stop["__run"]), "left")
    late = F.coalesce(F.col(order) > F.col("__stop.order"), F.lit(False))
    charged = F.when(late, 0).otherwise(F.greatest(F.lit(0), F.least(F.col("__asked"), F.lit(cap) - F.col("__before")))).cast("long")
    outcome = F.when(late, "VOID").when(F.col("__failed") & (F.col(part) == 0), "BACKEND_ERROR").when(F.col("__failed"), "NOT_ASKED").when(F.col("charged") == F.col(units), "CHARGED").when(F.col("charged") > 0, "PARTIAL").otherwise("CAP_REACHED")
    out = joined.withColumns({"status": F.when(late, "RUN_ABORTED").otherwise("SUCCESS"), "reason": F.when(late, F.col("__stop.reason")), "charged": charged})
    return out.withColumn("outcome", outcome).drop("__failed", "__place", "__asked", "__before", "__run", "__stop")


#: The metered events.
EVENTS = ("product-basic", "product-essential", "product-detail", "variant-detail", "offer", "seller-detail", "product-check")


def charge_event(rows: DataFrame, event: str, units: Column | None = None) -> DataFrame:
    """rows(status) as charges of one of EVENTS: event, and units (1 by default; nothing for other statuses than SUCCESS)."""
    if event not in EVENTS:
        raise ValueError(f"unknown event {event}")
    return rows.withColumns({"event": F.lit(event), "units": F.when(F.col("status") == "SUCCESS", F.lit(1) if units is None else units).otherwise(0).cast("long")})


def event_totals(charges: DataFrame, event: str, units: str) -> DataFrame:
    return charges.groupBy(event).agg(F.sum("charged").cast("long").alias("charged"), F.sum(F.col(units) - F.col("charged")).cast("long").alias("refused"))


def select_event(mode: str, blocks) -> str:
    """The metered event of a run."""
    if mode == "fast":
        return "product-basic"
    if mode == "monitor":
        return "product-check"
    return "product-essential" if set(blocks) <= {"pricing", "availability", "ratings", "offers", "sellerProfiles"} else "product-detail"


def event_of(mode: Column, blocks: Column) -> Column:
    """The metered event by row: see select_event."""
    essential = F.array(*[F.lit(b) for b in ("pricing", "availability", "ratings", "offers", "sellerProfiles")])
    return F.when(mode == "fast", "product-basic").when(mode == "monitor", "product-check").when(F.size(F.array_except(blocks, essential)) == 0, "product-essential").otherwise("product-detail")


def budget_allows(used: Column, requests: Column, ratio: float) -> Column:
    return used < F.greatest(F.lit(1), F.ceil(requests * F.lit(ratio)))


def fetch_outcome(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key from its attempts: the last status code and reason, whether any was blocked, and the record status."""
    last = attempts.groupBy(key).agg(F.max_by(F.struct("ok", "not_found", "reason"), F.col(order)).alias("l"), F.bool_or("blocked").alias("blocked"), F.count(F.lit(1)).alias("attempts"))
    status = F.when(F.col("l.ok"), "SUCCESS").when(F.col("l.not_found"), "PRODUCT_NOT_FOUND").when(F.col("blocked"), "BLOCKED").otherwise("FETCH_FAILED")
    return last.select(key, status.alias("status"), F.when(~F.col("l.ok"), F.col("l.reason")).alias("reason"), "attempts", "blocked")


def transport_reason(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.rlike("timeout|etimedout|esockettimedout"), "TIMEOUT").when(low.rlike("redirect"), "REDIRECT_LOOP").otherwise("HTTP_STATUS")


#: Groups in which the rows of a key are cut first, so that a key of very many rows is no single task.
SALTS = 64


def first_of_key(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each key in order (unique within a key), cut in two levels."""
    near = rows.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(SALTS)))
    near = near.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__salt").orderBy(order))).where(F.col("__n") <= most)
    near = near.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= most)
    return near.drop("__salt", "__n")


def fold_attempts(attempts: DataFrame, key: str, order: str, most: int, allowed: Column | None = None, configured: Column | None = None, budget: Column | None = None) -> DataFrame:
    """One row a key from its attempts in order: status, reason, attempts used, tier, blocked, status_code.

    attempts hold error (text of a transport failure, else null), status_code, blocked, not_found and reason (of the page's class). At most `most` of them are
    made; a page, a not-found page or a client error ends them. A block on the datacenter tier moves to the residential one where the fallback is
    allowed, configured and within its budget, and else names what stood against it; a block on the residential tier is BLOCKED_AFTER_FALLBACK. A
    block is remembered to the end. The fold runs over an array of at most `most` attempts a key, whatever the key's rows are.
    """
    yes = F.lit(True)
    told = F.struct(
        F.col(order).alias("at"), "error", F.coalesce(F.col("status_code"), F.lit(200)).cast("int").alias("code"), F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("not_found", F.lit(False)).alias("not_found"), F.col("reason").cast("string").alias("reason"),
        *[F.coalesce(c if c is not None else yes, yes).alias(n) for n, c in (("allowed", allowed), ("configured", configured), ("budget", budget))],
    )
    listed = first_of_key(attempts.withColumn("__a", told).select(key, order, "__a"), key, order, most).groupBy(key).agg(F.sort_array(F.collect_list("__a")).alias("__all"))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit("").alias("done"), F.lit("DATACENTER").alias("tier"), F.lit("DATACENTER").alias("used"), none.alias("reason"), F.lit(False).alias("blocked"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("code"))

    def step(s: Column, a: Column) -> Column:
        failed, refused = a["error"].isNotNull(), a["blocked"]
        fallback = (s["tier"] == "DATACENTER") & a["allowed"] & a["configured"] & a["budget"]
        against = (
            F.when(s["tier"] != "DATACENTER", "BLOCKED_AFTER_FALLBACK").when(~a["allowed"], "RESIDENTIAL_FALLBACK_DISABLED").when(~a["configured"], "BLOCKED_AFTER_FALLBACK")
            .when(~a["budget"], "ESCALATION_BUDGET_EXHAUSTED").otherwise(F.coalesce(a["reason"], F.lit("CHALLENGE_PAGE")))
        )
        done = F.when(failed, "").when(a["not_found"], "PRODUCT_NOT_FOUND").when(refused, "").when(a["code"] >= 400, "FETCH_FAILED").otherwise("SUCCESS")
        reason = F.when(failed, transport_reason(a["error"])).when(a["not_found"], F.coalesce(a["reason"], F.lit("DOG_PAGE"))).when(refused, against).when(a["code"] >= 400, "HTTP_STATUS")
        next_ = F.struct(
            done.alias("done"), F.when(~failed & ~a["not_found"] & refused & fallback, "RESIDENTIAL").otherwise(s["tier"]).alias("tier"), s["tier"].alias("used"), reason.alias("reason"),
            F.when(failed, s["blocked"]).when(a["not_found"], False).when(refused, True).when(a["code"] >= 400, False).otherwise(s["blocked"]).alias("blocked"), (s["n"] + 1).alias("n"), F.when(failed, s["code"]).otherwise(a["code"]).alias("code"),
        )
        return F.when(s["done"] != "", s).otherwise(next_)

    folded = listed.withColumn("__s", F.aggregate("__all", start, step))
    s = F.col("__s")
    status = F.when(s["done"] != "", s["done"]).when(s["blocked"], "BLOCKED").otherwise("FETCH_FAILED")
    return folded.select(key, status.alias("status"), s["reason"].alias("reason"), s["n"].alias("attempts"), s["used"].alias("tier"), s["blocked"].alias("blocked"), s["code"].alias("status_code"))


def search_outcome(pages: Column, cards: Column, reason: Column) -> Column:
    """struct(status, reason) of a search: read pages without cards are PRODUCT_NOT_FOUND, filtered cards still succeed."""
    none = (pages > 0) & (cards == 0)
    return F.when(none, F.struct(F.lit("PRODUCT_NOT_FOUND").alias("status"), F.coalesce(reason, F.lit("EMPTY_TEMPLATE")).alias("reason"))).otherwise(
        F.struct(F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("reason"))
    )


def stop_reason(aborted: Column, done: Column, ceiling: int, capped: Column, state: Column) -> Column:
    """The first condition that holds: an earlier abort, the ceiling, the charge cap, the breaker."""
    return F.when(aborted, "RUN_ABORTED").when(done >= ceiling, "MAX_PRODUCTS_REACHED").when(capped, "CHARGE_LIMIT_REACHED").when(state == "ABORT", "BLOCK_RATE_ABORT")


def peak_concurrency(spans: DataFrame, start: str, end: str, run: str) -> DataFrame:
    """run and the most spans open at once (a span that ends when another begins is closed by then)."""
    edges = spans.select(run, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("e")).select(run, "e.*")
    steps = edges.groupBy(run, "at").agg(F.sum("step").alias("step"))
    open_ = running_before(steps, run, "at", {"__open": F.col("step")})
    return open_.groupBy(run).agg(F.max(F.col("__open") + F.col("step")).alias("peak"))


def settled_inputs(records: DataFrame, searches: DataFrame) -> DataFrame:
    """key, status of all inputs: products by their record, searches by their outcome, which settle without a record."""
    return records.select("key", "status").unionByName(searches.select("key", "status"))


def run_summary(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row from records(status) and attempts(blocked_attempts): counts of every status, of attempts and blocks, and their rate."""
    counts = records.agg(F.count(F.lit(1)).alias("settled"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
    seen, blocked = attempts.agg(F.count(F.lit(1))).scalar(), attempts.agg(F.count_if("blocked_attempts")).scalar()
    return counts.withColumns({"attempts": seen, "blocked_attempts": blocked}).withColumn("block_rate", rate(F.col("blocked_attempts"), F.col("attempts")))


#: Names of the counted statuses in a summary.
COUNTED = {"success": "SUCCESS", "productNotFound": "PRODUCT_NOT_FOUND", "blocked": "BLOCKED", "fetchFailed": "FETCH_FAILED", "parserError": "PARSER_ERROR", "geoRestricted": "GEO_RESTRICTED", "invalidInput": "INVALID_INPUT", "requiresLocation": "REQUIRES_LOCATION", "runAborted": "RUN_ABORTED"}


def whole_summary(work: DataFrame, settled: DataFrame, cards: DataFrame, monitored: DataFrame, attempts: DataFrame, charges: DataFrame, mode: str, started: str, finished: str, warnings: tuple[str, ...] = ()) -> DataFrame:
    """The one row of a run's summary, of 37 fields.

    work(key, merged, market), settled(key, status), cards(reasons, matches, page) of the searches, monitored(compared, changed), attempts(kind: PRODUCT,
    SEARCH or PRIMING, blocked, residential, start, end), charges(charged, outcome). Every part is one aggregation of its table.
    """
    out = settled.agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in COUNTED.items()], F.count(F.lit(1)).alias("accountedFor"))
    asked = work.agg(F.sum("merged").alias("requested"), F.count(F.lit(1)).alias("uniqueInputs"), F.sort_array(F.collect_set("market")).alias("marketplaces"))
    reasons = cards.select(F.explode("reasons").alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("r", "n")))).alias("filterRejections"))
    found = cards.agg(F.count_if(~F.col("matches")).alias("filteredOut"), F.count_if("matches").alias("discoveredProducts"))
    watched = monitored.agg(F.count(F.lit(1)).alias("monitoringChecked"), F.count_if("compared").alias("monitoringCompared"), F.count_if("changed").alias("monitoringChanged"))
    kinds = {k: F.col("kind") == k for k in ("PRODUCT", "SEARCH", "PRIMING")}
    fetched = attempts.agg(
        F.count_if(kinds["SEARCH"] & ~F.col("blocked")).alias("searchPagesFetched"), F.count_if(kinds["PRIMING"]).alias("primingRequests"), F.count_if("residential").alias("residentialEscalations"),
        rate(F.count_if(kinds["PRODUCT"] & F.col("blocked")), F.count_if(kinds["PRODUCT"])).alias("blockRateProductPages"), rate(F.count_if(kinds["SEARCH"] & F.col("blocked")), F.count_if(kinds["SEARCH"])).alias("blockRateSearchPages"),
    )
    peak = peak_concurrency(attempts.withColumn("__run", F.lit(1)), "start", "end", "__run").agg(F.max("peak").alias("peakConcurrency"))
    paid = charges.agg(F.coalesce(F.sum("charged"), F.lit(0)).alias("successfulPaidEvents"), F.count_if(F.col("outcome") == "BACKEND_ERROR").alias("failedPaidEvents"), F.coalesce(F.bool_or(F.col("outcome").isin("CAP_REACHED", "PARTIAL")), F.lit(False)).alias("chargeCapReached"))
    for part in (asked, reasons, found, watched, fetched, peak, paid):  # one row each
        out = out.withColumns({c: part.select(c).scalar() for c in part.columns})
    truncated = F.lit(False) if "truncated" not in cards.columns else F.coalesce(cards.agg(F.bool_or("truncated")).scalar(), F.lit(False))
    return out.withColumns({
        "schemaVersion": F.lit("1.5"), "runStartedAt": F.lit(started), "runFinishedAt": F.lit(finished), "mode": F.lit(mode), "accountingInvariantHolds": F.col("accountedFor") == F.col("uniqueInputs"),
        "duplicatesMerged": F.col("requested") - F.col("uniqueInputs"), "discoveryTruncated": truncated, "warnings": F.array(*[F.lit(w) for w in dict.fromkeys(warnings)]).cast("array<string>"), "parserVersion": F.lit("1"),
    })
