"""Listing cards: filters with reasons, positions, records from cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.functions.numbers import discount_percent


def rejection_reasons(filters: dict, columns: dict[str, Column] | None = None) -> Column:
    """array of all reasons why a card fails the filters, in fixed order; a value that is wanted but missing fails.

    Columns by name: price, rating, reviews, prime, sponsored, demand, discount.
    """
    c = {k: F.col(k) for k in ("price", "rating", "reviews", "prime", "sponsored", "demand", "discount")} | (columns or {})
    out = []

    def least(key, name, column):
        if key in filters:
            out.append(F.when(column.isNull(), f"{name}_MISSING").when(column < filters[key], f"{name}_BELOW_MIN"))

    if "min_price" in filters or "max_price" in filters:
        out.append(F.when(c["price"].isNull(), "PRICE_MISSING").when(c["price"] < filters.get("min_price", float("-inf")), "PRICE_BELOW_MIN"))
        out.append(F.when(c["price"] > filters.get("max_price", float("inf")), "PRICE_ABOVE_MAX"))
    least("min_rating", "RATING", c["rating"])
    least("min_reviews", "REVIEW_COUNT", c["reviews"])
    if filters.get("prime_only"):
        out.append(F.when(~F.coalesce(c["prime"], F.lit(False)), "NOT_PRIME"))
    if filters.get("sponsored") == "exclude":
        out.append(F.when(c["sponsored"], "SPONSORED_EXCLUDED"))
    if filters.get("sponsored") == "only":
        out.append(F.when(~F.coalesce(c["sponsored"], F.lit(False)), "ORGANIC_EXCLUDED"))
    least("min_demand", "DEMAND", c["demand"])
    least("min_discount", "DISCOUNT", c["discount"])
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def filter_cards(cards: DataFrame, filters: dict, columns: dict[str, Column] | None = None) -> DataFrame:
    """cards with reasons and matches; cards of directly asked items are told apart by the caller."""
    judged = cards.withColumn("reasons", rejection_reasons(filters, columns))
    return judged.withColumn("matches", F.size("reasons") == 0)


def rejection_histogram(judged: DataFrame) -> DataFrame:
    """reason and the number of cards it rejects (a card may count for several)."""
    return judged.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("cards"))


def card_positions(cards: DataFrame, source: str, page: str, order: str, sponsored: Column) -> DataFrame:
    """cards with page_position, position over all pages, and organic or sponsored position (null on the other kind).

    Counts of earlier pages are summed over one row a page, so only a page's own cards are sorted together.
    """
    inside = Window.partitionBy(source, page).orderBy(order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(sponsored, 1).otherwise(0)
    own = cards.withColumns({"page_position": F.row_number().over(inside).cast("long"), "__sponsored": F.sum(kind).over(running), "__kind": kind})
    pages = cards.groupBy(source, page).agg(F.count(F.lit(1)).alias("__n"), F.sum(kind).alias("__s"))
    before = Window.partitionBy(source).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pages.select(source, page, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__sbefore"))
    out = own.join(offsets, [source, page])
    paid = F.col("__sbefore") + F.col("__sponsored")
    total = F.col("__before") + F.col("page_position")
    return out.withColumns({
        "position": total,
        "sponsored_position": F.when(F.col("__kind") == 1, paid),
        "organic_position": F.when(F.col("__kind") == 0, total - paid),
    }).drop("__sponsored", "__kind", "__before", "__sbefore")


def place_cards(pages: DataFrame, source: str, page: str, cards: str, sponsored) -> DataFrame:
    """The cards of pages (one row a page, its cards an array) as rows, with their positions as in card_positions.

    Counts of earlier pages are summed over whole pages, so no card is sorted with those of other pages. sponsored tells it of a card.
    """
    before = Window.partitionBy(source).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    counted = pages.withColumns({"__n": F.size(cards).cast("long"), "__s": F.size(F.filter(cards, sponsored)).cast("long")})
    counted = counted.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__sbefore": F.coalesce(F.sum("__s").over(before), F.lit(0))})
    rows = counted.select(source, page, "__before", "__sbefore", F.posexplode(cards).alias("__at", "__card"))
    paid = F.count_if(sponsored(F.col("__card"))).over(Window.partitionBy(source, page).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"page_position": (F.col("__at") + 1).cast("long"), "__paid": F.col("__sbefore") + paid})
    total = F.col("__before") + F.col("page_position")
    kind = sponsored(F.col("__card"))
    return rows.select(source, page, "__card.*", "page_position", total.alias("position"), F.when(kind, F.col("__paid")).alias("sponsored_position"), F.when(~kind, total - F.col("__paid")).alias("organic_position"))


def pages_read(pages: DataFrame, source: str, page: str, limit: int, has_next: Column, cards: Column) -> DataFrame:
    """The pages that a reader in order gets to: up to limit, until one is empty or has no next page."""
    stop = F.when(~has_next | (cards == 0), 1).otherwise(0)
    before = Window.partitionBy(source).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("__stops", F.coalesce(F.sum(stop).over(before), F.lit(0))).where((F.col("__stops") == 0) & (F.col(page) <= limit)).drop("__stops")


def fixed_position(page: Column, place: Column, per_page: int = 16) -> Column:
    """Position of a card if every page before it were full."""
    return (place + (page - 1) * per_page).cast("long")


def direct_cards(cards: DataFrame, wanted: DataFrame, source: str, item: str) -> DataFrame:
    """judged cards of exact lookups: of a source in wanted(source, item) only the card of that item stays, and no filter rejects it."""
    asked = wanted.select(source, F.col(item).alias("__asked"))
    joined = cards.join(asked, source, "left")
    direct = F.col("__asked").isNotNull()
    kept = joined.where(~direct | (F.col(item) == F.col("__asked")))
    return kept.withColumns({"matches": direct | F.col("matches"), "reasons": F.when(direct, F.array().cast("array<string>")).otherwise(F.col("reasons"))}).drop("__asked")


def card_discount(price: Column, listed: Column, currency: Column, list_currency: Column) -> Column:
    return F.when(currency == list_currency, discount_percent(price, listed))
