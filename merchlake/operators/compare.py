"""Snapshots: last row wins, left join with the one before, typed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions.numbers import percent_change

#: Statuses of a block that may be compared.
TRUSTED = {
    "pricing": ("EXTRACTED", "OUT_OF_STOCK"),
    "availability": ("EXTRACTED",),
    "buyBox": ("EXTRACTED", "NOT_PRESENT"),
    "offers": ("EXTRACTED", "NOT_PRESENT"),
    "rankings": ("EXTRACTED", "NOT_PRESENT"),
    "ratings": ("EXTRACTED", "NOT_PRESENT"),
}


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in order (unique within a key); combines on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def earliest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes first in order."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def snapshot_join(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """current with previous's other columns as prev_<name>, and compared: whether there was one."""
    old = previous.select(*keys, F.lit(True).alias("__had"), *[F.col(c).alias(f"prev_{c}") for c in previous.columns if c not in keys])
    return current.join(old, keys, "left").withColumn("compared", F.coalesce("__had", F.lit(False))).drop("__had")


def suppression(block: str, now: Column, before: Column) -> Column:
    """Why a block isn't compared (null: it is): the current status, then the previous one."""
    current = F.when(~F.coalesce(now.isin(*TRUSTED[block]), F.lit(False)), F.concat(F.lit("CURRENT_"), F.coalesce(now, F.lit("MISSING"))))
    previous = F.when(before.isNull(), "PREVIOUS_STATUS_MISSING").when(~before.isin(*TRUSTED[block]), F.concat(F.lit("PREVIOUS_"), before))
    return F.when(current.isNotNull() | previous.isNotNull(), F.concat(F.lit(f"COMPARISON_SUPPRESSED:{block}:"), F.concat_ws(",", current, previous)))


def value_change(kind: str, field: str, before: Column, after: Column, allowed: Column | None = None) -> Column:
    """struct(type, field, before, after, percent) where the values differ, else null."""
    differ = ~before.eqNullSafe(after) if allowed is None else allowed & ~before.eqNullSafe(after)
    numeric = percent_change(before.try_cast("double"), after.try_cast("double"))
    return F.when(differ, F.struct(F.lit(kind).alias("type"), F.lit(field).alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"), numeric.alias("percent")))


def stock_change(before: Column, after: Column) -> Column:
    """OUT_OF_STOCK from any other state, BACK_IN_STOCK only from out of stock to in stock."""
    return F.when((after == "OUT_OF_STOCK") & (before != "OUT_OF_STOCK"), "OUT_OF_STOCK").when((before == "OUT_OF_STOCK") & (after == "IN_STOCK"), "BACK_IN_STOCK")


def coupon_change(before: Column, after: Column) -> Column:
    return F.when(before.isNull() & after.isNotNull(), "COUPON_ADDED").when(before.isNotNull() & after.isNull(), "COUPON_REMOVED").when(~before.eqNullSafe(after), "DISCOUNT_CHANGED")


def product_changes(rows: DataFrame, now, before, compared: Column) -> DataFrame:
    """rows with the changes (__found) and warnings (__warned) of a record against the one before it. now and before give the column of a block's field, as in now("pricing.status").

    A block counts if both of its statuses may be trusted. Prices in unequal currencies are not compared; the buy box is known by its
    seller's identifier, else by its name; seller counts only where both runs asked for offers.
    """
    # each part is a column first: within one expression it would be found again wherever it is named
    asked = F.coalesce(now("offers.requested") & before("offers.requested"), F.lit(False))
    judged = {b: suppression(b, now(f"{b}.status"), before(f"{b}.status")) for b in TRUSTED}
    judged["offers"] = F.when(asked, judged["offers"])
    staged = rows.withColumns({f"__why_{b}": w for b, w in judged.items()})
    why = {b: F.col(f"__why_{b}") for b in TRUSTED}
    fair = {b: compared & w.isNull() for b, w in why.items()}
    fair["offers"] = fair["offers"] & asked
    amounts = [side("pricing.currentPrice.amount") for side in (before, now)]
    currencies = [side("pricing.currentPrice.currency") for side in (before, now)]
    mismatch = fair["pricing"] & amounts[0].isNotNull() & amounts[1].isNotNull() & ~currencies[0].eqNullSafe(currencies[1])

    def moved(kind, field, block, allowed=None, numeric=True, sides=None):
        old, new = sides or (before(field), now(field))
        out = value_change(kind, field, old, new, fair[block] if allowed is None else fair[block] & allowed)
        return out if numeric else F.when(out.isNotNull(), out.withField("percent", F.lit(None).cast("double")))

    coupons = [side("pricing.coupon") for side in (before, now)]
    shown = [F.to_json(c, {"ignoreNullFields": "false"}) for c in coupons]
    states = [side("availability.state") for side in (before, now)]
    sellers = [F.coalesce(side("buyBox.sellerId"), side("buyBox.seller")) for side in (before, now)]
    counts = [F.coalesce(side("offers.totalCount"), F.size(side("offers.items")).cast("long")) for side in (before, now)]
    coupon, stock = coupon_change(*coupons), stock_change(*states)
    as_change = lambda kind, field, old, new: F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.lit(field).alias("field"), old.alias("before"), new.alias("after"), F.lit(None).cast("double").alias("percent")))
    parts = [
        moved("PRICE_CHANGED", "pricing.currentPrice.amount", "pricing", ~mismatch),
        moved("DISCOUNT_CHANGED", "pricing.discountPercent", "pricing"),
        F.when(fair["pricing"], as_change(coupon, "pricing.coupon", *shown)),
        F.when(fair["availability"], as_change(stock, "availability.state", *states)),
        moved("BUY_BOX_CHANGED", "buyBox.seller", "buyBox", numeric=False, sides=sellers),
        moved("SELLER_COUNT_CHANGED", "offers.totalCount", "offers", sides=counts),
        moved("BSR_CHANGED", "rankings.mainBSR", "rankings"),
        moved("RATING_CHANGED", "ratings.rating", "ratings"),
        moved("REVIEW_COUNT_CHANGED", "ratings.reviewCount", "ratings"),
    ]
    staged = staged.withColumns({f"__part_{k}": part for k, part in enumerate(parts)} | {"__mismatch": F.when(mismatch, "COMPARISON_SUPPRESSED:pricing.currentPrice:CURRENCY_MISMATCH")})
    found = changes(*[F.col(f"__part_{k}") for k in range(len(parts))])
    warned = changes(why["pricing"], F.col("__mismatch"), *[w for b, w in why.items() if b != "pricing"])
    made = {"__found": F.when(compared, found).otherwise(F.array()), "__warned": F.when(compared, warned).otherwise(F.array(F.lit("COMPARISON_NOT_AVAILABLE:NO_MATCHING_PREVIOUS_OBSERVATION")))}
    return staged.withColumns(made).drop(*[f"__why_{b}" for b in TRUSTED], *[f"__part_{k}" for k in range(len(parts))], "__mismatch")


#: The fields of a record that product_changes reads.
COMPARED = (
    "pricing.status", "pricing.currentPrice.amount", "pricing.currentPrice.currency", "pricing.discountPercent", "pricing.coupon", "availability.status", "availability.state", "buyBox.status", "buyBox.sellerId", "buyBox.seller",
    "offers.status", "offers.requested", "offers.totalCount", "offers.items", "rankings.status", "rankings.mainBSR", "ratings.status", "ratings.rating", "ratings.reviewCount",
)
#: Types under which product_changes reads the fields of a record; what isn't named is text.
FIELD_TYPES = {
    "pricing.currentPrice.amount": "decimal(18,2)", "pricing.discountPercent": "double", "offers.requested": "boolean", "offers.totalCount": "bigint", "offers.items": "array<variant>",
    "rankings.mainBSR": "bigint", "ratings.rating": "double", "ratings.reviewCount": "bigint",
    "pricing.coupon": "struct<text:string,type:string,percent:int,amount:struct<amount:decimal(18,2),currency:string,raw:string>>",
}


def untyped(record: Column):
    """Access to the fields of a record held as VARIANT, for product_changes: what its schema lacks, or has under another type, is null."""

    def field(path: str) -> Column:
        kind = FIELD_TYPES.get(path, "string")
        if not kind.startswith("struct"):
            return F.try_variant_get(record, f"$.{path}", kind)
        # field by field, as a record of an older schema may lack some of them
        there = F.try_variant_get(record, f"$.{path}", "map<string,variant>").isNotNull()
        parts = [F.try_variant_get(record, f"$.{path}.{n}", k).alias(n) for n, k in (("text", "string"), ("type", "string"), ("percent", "int"))]
        amount = [F.try_variant_get(record, f"$.{path}.amount.{n}", k).alias(n) for n, k in (("amount", "decimal(18,2)"), ("currency", "string"), ("raw", "string"))]
        held = F.try_variant_get(record, f"$.{path}.amount", "map<string,variant>").isNotNull()
        return F.when(there, F.struct(*parts, F.when(held, F.struct(*amount)).alias("amount")))

    return field


def changes(*found: Column) -> Column:
    """The changes that there are, in the order given. Without a lambda, so that Spark compiles the whole."""
    return F.concat(*[F.when(c.isNotNull(), F.array(c)).otherwise(F.array()) for c in found])
