"""Quality: block projection, completeness, the output gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of each mode, in order; statuses that count as present.
WEIGHTS = {
    "fast": {"id": 25, "title": 25, "url": 10, "price": 25, "ratings": 15},
    "detail": {"id": 10, "title": 15, "url": 5, "price": 25, "availability": 15, "rank": 10, "ratings": 10, "buyBox": 5, "variants": 5},
    "intelligence": {"id": 10, "title": 10, "url": 5, "price": 25, "availability": 15, "rank": 10, "ratings": 10, "buyBox": 10, "variants": 5},
}
PRESENT = ("EXTRACTED", "NOT_PRESENT", "NOT_APPLICABLE", "OUT_OF_STOCK")


def present(status: Column) -> Column:
    return F.coalesce(status.isin(*PRESENT), F.lit(False))


def completeness(fields: dict[str, Column]) -> tuple[Column, Column]:
    """Score (sum of the weights of fields that are there) and the missing names, from name -> (weight, there)."""
    score = sum((F.when(there, weight).otherwise(0) for weight, there in fields.values()), F.lit(0))
    missing = F.array_compact(F.array(*[F.when(~there, name) for name, (_, there) in fields.items()]))
    return score.cast("int"), missing


def scored(records: DataFrame, mode: str) -> DataFrame:
    """records (of the record schema) with the completeness of their mode in the quality block: fast, intelligence, or detail for all others."""
    weights = WEIGHTS.get(mode, WEIGHTS["detail"])
    blocks = {"price": "pricing", "availability": "availability", "rank": "rankings", "ratings": "ratings", "buyBox": "buyBox", "variants": "variants"}
    there = {"id": F.col("item").isNotNull(), "title": F.col("title").isNotNull(), "url": F.col("canonicalUrl").isNotNull()} | {k: present(F.col(f"{b}.status")) for k, b in blocks.items()}
    score, missing = completeness({k: (w, there[k]) for k, w in weights.items()})
    return records.withColumn("quality", F.col("quality").withField("completenessScore", score).withField("criticalFieldsMissing", missing))


def project_blocks(rows: DataFrame, wanted, blocks) -> DataFrame:
    """Blocks that aren't wanted keep their shape, all null but for the status NOT_APPLICABLE.

    The placeholders are constants, so a block that nobody wants is never read.
    """
    out = {}
    for name in blocks:
        if name not in wanted:
            kind = rows.schema[name].dataType
            out[name] = F.struct(*[(F.lit("NOT_APPLICABLE") if f.name == "status" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    return rows.withColumns(out)


def location_status(requested: Column, applied: Column) -> Column:
    return F.when(requested.isNull(), "NOT_APPLICABLE").when(applied, "EXTRACTED").otherwise("REQUIRES_LOCATION")


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def gate(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others as failures with their violations; the former alone are published."""
    judged = rows.withColumn("violations", violations(rules))
    bad = judged.where(F.size("violations") > 0).withColumns({"status": F.lit("PARSER_ERROR"), "reason": F.lit("OUTPUT_SCHEMA_VIOLATION")})
    return judged.where(F.size("violations") == 0).drop("violations"), bad


#: Statuses of a failure record, statuses of a block.
FAILURES = ("INVALID_INPUT", "PRODUCT_NOT_FOUND", "BLOCKED", "FETCH_FAILED", "PARSER_ERROR", "GEO_RESTRICTED", "REQUIRES_LOCATION", "RUN_ABORTED")
BLOCK_STATUSES = ("EXTRACTED", "NOT_PRESENT", "NOT_APPLICABLE", "PARSER_MISS", "OUT_OF_STOCK", "GEO_RESTRICTED", "REQUIRES_LOCATION")


def record_violations(rows: DataFrame, blocks, markets) -> Column:
    """What keeps a row from being one of the two shapes, by its status: a product with an identity and known block statuses, or a failure with a reason that is not charged."""
    has = lambda c: F.col(c).isNotNull() if c in rows.columns else F.lit(False)
    shared = {"schemaVersion": has("schemaVersion"), "marketplace": F.col("marketplace").isin(*markets), "input": has("input")}
    product = shared | {"item": F.col("item").rlike("^[A-Z0-9]{10}$"), "canonicalUrl": F.startswith("canonicalUrl", F.lit("https://")), "scrapedAt": has("scrapedAt")}
    product |= {f"{b}.status": F.col(f"{b}.status").isin(*BLOCK_STATUSES) for b in blocks if b in rows.columns}
    failure = shared | {"reason": has("reason"), "chargedProductEvent": ~F.col("chargedProductEvent") if "chargedProductEvent" in rows.columns else F.lit(False)}
    status = F.col("status")
    return F.when(status == "SUCCESS", violations(product)).when(status.isin(*FAILURES), violations(failure)).otherwise(F.array(F.lit("status")))


def record_gate(rows: DataFrame, blocks, markets) -> tuple[DataFrame, DataFrame]:
    """Rows of one of the two shapes, and the others as failures of PARSER_ERROR with their violations; only the former are published."""
    judged = rows.withColumn("violations", record_violations(rows, blocks, markets))
    bad = judged.where(F.size("violations") > 0).withColumns({"status": F.lit("PARSER_ERROR"), "reason": F.lit("OUTPUT_SCHEMA_VIOLATION"), "chargedProductEvent": F.lit(False)})
    return judged.where(F.size("violations") == 0).drop("violations"), bad


#: What the fields of a record may hold beyond their types.
_STATUS = {"enum": list(BLOCK_STATUSES)}
_SHARE = {"minimum": 0, "maximum": 100}
RECORD_RULES = {
    "schemaVersion": {"const": "1.5"}, "scrapedAt": {"pattern": "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.000)?Z$"}, "canonicalUrl": {"pattern": "^https://"}, "item": {"pattern": "^[A-Z0-9]{10}$"}, "currency": {"minLength": 3, "maxLength": 3},
    "rating": {"minimum": 0, "maximum": 100}, "ratings.rating": {"minimum": 0, "maximum": 5}, "reviewCount": {"minimum": 0}, "mainBSR": {"minimum": 1}, "rank": {"minimum": 1}, "discountPercent": _SHARE, "positivePercent": _SHARE, "neutralPercent": _SHARE,
    "negativePercent": _SHARE, "sellerRating": _SHARE, "sellerFeedbackCount": {"minimum": 0}, "feedbackCount": {"minimum": 0}, "completenessScore": _SHARE, "fetchAttempts": {"minimum": 0}, "percent": _SHARE,
}
RECORD_NEEDS = frozenset(("schemaVersion", "scrapedAt", "input", "marketplace", "item", "canonicalUrl", "retrieval", "quality", "discoveredFrom", "retrieval.requestedBlocks"))


def golden_schema() -> dict:
    """The schema of a whole record: a product record or a failure, made from their columns' types and RECORD_RULES."""
    from merchlake.functions.json_schema import schema_of
    from merchlake.functions.markets import MARKETS
    from merchlake.operators.records import BLOCKS, failure_schema, product_schema

    rules = RECORD_RULES | {f"{b}.status": _STATUS for b in BLOCKS} | {"marketplace": {"enum": list(MARKETS)}}
    product = schema_of(product_schema(), rules | {"status": {"const": "SUCCESS"}} | {p: _STATUS for p in ("offers.items[].status", "sellerProfiles.items[].status", "variants.items[].status")}, required=RECORD_NEEDS | frozenset(BLOCKS))
    failure = schema_of(failure_schema(), rules | {"status": {"enum": list(FAILURES)}, "chargedProductEvent": {"const": False}, "item": {}}, required=frozenset(("schemaVersion", "input", "marketplace", "reason")))
    return {"oneOf": [product, failure]}


def golden_gate(rows: DataFrame, schema: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Records whose JSON keeps the golden schema, as they were, and the others as failures with their violations. A null in a failure's optional fields counts as null."""
    from merchlake.functions.json_schema import schema_violations

    record = F.try_parse_json(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}))
    judged = rows.withColumn("violations", schema_violations(record, schema or golden_schema()))
    bad = judged.where(F.size("violations") > 0).withColumns({"status": F.lit("PARSER_ERROR"), "reason": F.lit("OUTPUT_SCHEMA_VIOLATION")})
    return judged.where(F.size("violations") == 0).drop("violations"), bad


def location_block(country: Column, postal: Column, resolved: Column, applied: Column, method: Column) -> Column:
    return F.struct(country.alias("requestedCountry"), postal.alias("requestedPostalCode"), resolved.alias("resolvedPostalCode"), applied.alias("applied"), method.alias("method"), location_status(postal, applied).alias("status"))


def require_location(fetched: DataFrame, required: bool) -> tuple[DataFrame, DataFrame]:
    """Fetched pages that may be read, and the others as REQUIRES_LOCATION failures, where a run insists on its place."""
    lacking = F.lit(required) & ~F.coalesce(F.col("location_applied"), F.lit(False))
    return fetched.where(~lacking), fetched.where(lacking).withColumns({"status": F.lit("REQUIRES_LOCATION"), "reason": F.lit("LOCATION_NOT_APPLIED")})


def quality_block(score: Column, missing: Column, attempts: Column | None = None, tier: Column | None = None, kind: Column | None = None, blocked: Column | None = None, warnings: Column | None = None) -> Column:
    """The quality block; what isn't given has its default."""
    return F.struct(
        score.alias("completenessScore"), F.coalesce(attempts, F.lit(0)).alias("fetchAttempts") if attempts is not None else F.lit(0).alias("fetchAttempts"),
        (F.coalesce(tier, F.lit("NONE")) if tier is not None else F.lit("NONE")).alias("proxyTier"), (F.coalesce(kind, F.lit("UNKNOWN")) if kind is not None else F.lit("UNKNOWN")).alias("pageType"),
        (F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)).alias("blocked"), missing.alias("criticalFieldsMissing"),
        (F.array_distinct(warnings) if warnings is not None else F.array().cast("array<string>")).alias("warnings"), F.lit("1").alias("parserVersion"),
    )


def merge_warnings(*warnings: Column) -> Column:
    """All warnings, each once, in order of their first."""
    out = warnings[0]
    for w in warnings[1:]:
        out = F.array_union(out, w)
    return F.array_distinct(out)


def critical_ok(title: Column, item: Column, statuses: list[Column]) -> Column:
    """An identity, and at least one block that holds something."""
    some = [F.coalesce(s.isin("EXTRACTED", "OUT_OF_STOCK"), F.lit(False)) for s in statuses]
    any_ = some[0]
    for s in some[1:]:
        any_ = any_ | s
    return (title.isNotNull() | item.isNotNull()) & any_
