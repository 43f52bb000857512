"""Work planning: options, sources of items, union, keyed dedupe with provenance, capacity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlake.functions.markets import MARKETS
from merchlake.functions.urls import item_id, product_url, search_url
from merchlake.operators.records import SCHEMA_VERSION

#: Blocks in canonical order, profiles, blocks of the fast mode, bounds of the numeric options.
BLOCKS = ("pricing", "availability", "ratings", "rankings", "buyBox", "variants", "product", "media", "offers", "sellerProfiles")
PROFILES = {"essential": BLOCKS[:3], "catalog": BLOCKS[:8], "competitive": BLOCKS}
FAST_BLOCKS = {"pricing", "availability", "ratings", "rankings", "media"}
BOUNDS = {"max_offers": (10, 1, 100), "max_products": (1000, 1, 1_000_000), "max_pages": (5, 1, 20), "max_variants": (50, 1, 500), "max_retries": (3, 0, 10)}
FILTER_BOUNDS = {"min_price": (0, 10_000_000), "max_price": (0, 10_000_000), "min_rating": (0, 5), "min_reviews": (0, 1_000_000_000), "min_demand": (0, 1_000_000_000), "min_discount": (0, 100)}


@dataclass(frozen=True)
class Options:
    """Checked options of a run; values out of bounds are clamped and noted in warnings."""

    mode: str = "detail"
    market: str = "US"
    profile: str = "catalog"
    blocks: tuple[str, ...] = ()
    variants: str = "discover"
    dedupe: bool = True
    numbers: dict[str, int] = field(default_factory=dict)
    filters: dict[str, float | str | bool] = field(default_factory=dict)
    baseline: str | None = None
    warnings: tuple[str, ...] = ()


def clamped(value: Column, name: str) -> Column:
    """struct(value, warned) of a numeric option by row: the default where it is missing, whole, within its bounds."""
    default, low, high = BOUNDS[name]
    whole = F.coalesce(value.cast("long"), F.lit(default).cast("long"))
    kept = F.least(F.greatest(whole, F.lit(low)), F.lit(high))
    return F.struct(kept.alias("value"), (kept != whole).alias("warned"))


def filter_error(value: Column, name: str) -> Column:
    """What is wrong with a numeric filter by row (null: nothing, or not given)."""
    low, high = FILTER_BOUNDS[name]
    wrong = F.when(~value.between(low, high), f"{name} must be between {low} and {high}")
    return wrong.when(value != F.floor(value), f"{name} must be a whole number") if name in ("min_reviews", "min_demand") else wrong


def ordered_blocks(wanted: Column) -> Column:
    """The known blocks of a list, each once, in canonical order."""
    return F.filter(F.array(*[F.lit(b) for b in BLOCKS]), lambda b: F.array_contains(wanted, b))


def resolve_blocks(profile: str, custom=(), offers: bool = False, sellers: bool = False) -> tuple[str, ...]:
    """Blocks of a profile (or the caller's own) in canonical order; flags add offers and sellers."""
    wanted = set(custom if profile == "custom" else PROFILES[profile])
    wanted |= {"offers"} if offers else set()
    wanted |= {"sellerProfiles"} if sellers else set()
    if unknown := wanted - set(BLOCKS):
        raise ValueError(f"unknown blocks: {sorted(unknown)}")
    return tuple(b for b in BLOCKS if b in wanted)


def check_filters(raw: dict) -> dict:
    """Discovery filters with known keys, numbers in bounds and min_price not above max_price."""
    for key, value in raw.items():
        if key in FILTER_BOUNDS:
            low, high = FILTER_BOUNDS[key]
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
                raise ValueError(f"{key} must be between {low} and {high}")
            if key in ("min_reviews", "min_demand") and value != int(value):
                raise ValueError(f"{key} must be a whole number")
        elif key == "sponsored":
            if value not in ("include", "exclude", "only"):
                raise ValueError("sponsored must be include, exclude or only")
        elif key != "prime_only":
            raise ValueError(f"unknown filter {key}")
    if raw.get("min_price", 0) > raw.get("max_price", float("inf")):
        raise ValueError("min_price is above max_price")
    return dict(raw)


def check_options(raw: dict) -> Options:
    """Options from a loose dictionary; wrong enumerations are errors."""
    warnings, numbers = [], {}
    mode, market = raw.get("mode", "detail"), raw.get("market", "US")
    if mode not in ("fast", "detail", "intelligence", "monitor"):
        raise ValueError(f"unknown mode {mode}")
    if market not in MARKETS:
        raise ValueError(f"unknown market {market}")
    if raw.get("variants", "discover") not in ("none", "discover", "price", "full"):
        raise ValueError("unknown variants mode")
    if mode == "monitor" and not raw.get("baseline"):
        raise ValueError("monitor needs a baseline")
    for name, (default, low, high) in BOUNDS.items():
        value = raw.get(name, default)
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"{name} must be a number")
        numbers[name] = min(max(int(value), low), high)
        if numbers[name] != int(value):
            warnings.append(f"{name} clamped to {numbers[name]}")
    if (version := raw.get("schema_version", SCHEMA_VERSION)) != SCHEMA_VERSION:
        warnings.append(f"schema version {version} is asked for, {SCHEMA_VERSION} is written")
    if raw.get("require_location") and not raw.get("postal"):
        warnings.append("a place is required but no postal code is given, so none is applied")
    profile = raw.get("profile", "essential" if mode == "fast" else "catalog")
    if profile == "custom" and not raw.get("blocks"):
        raise ValueError("the custom profile needs blocks")
    blocks = resolve_blocks(profile, raw.get("blocks", ()), raw.get("offers", False), raw.get("sellers", False))
    if mode == "fast" and (extra := set(blocks) - FAST_BLOCKS):
        raise ValueError(f"fast mode has no {sorted(extra)}")
    return Options(mode, market, profile, blocks, raw.get("variants", "discover"), raw.get("dedupe", True), numbers, check_filters(raw.get("filters", {})), raw.get("baseline"), tuple(warnings))


def check_inputs(raw: dict) -> None:
    """At least one of items, urls, keywords and dataset is given, and not empty."""
    if not any(raw.get(k) for k in ("items", "urls", "keywords", "dataset")):
        raise ValueError("no inputs: give at least one of items, urls, keywords, dataset")


def inline_items(text: Column, keywords: bool = False) -> Column:
    """array of the items of one delimited text; keywords part only at ; and line ends."""
    parts = F.split(text, "[;\\n]+" if keywords else "[\\s,;]+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def object_items(rows: DataFrame, field: str, market: str) -> DataFrame:
    """rows with kind, value and reason of a JSON item: a string, or an object with just one of asin, url and keyword.

    Strings are URLs if they begin as such, else identifiers. An object may name another market: its identifier or keyword is then
    a URL of that market. kind is null where reason says why the item was rejected.
    """
    text = F.trim(F.col(field))
    is_object = F.startswith(text, F.lit("{"))
    fields = {k: F.nullif(F.trim(F.get_json_object(text, f"$.{k}")), F.lit("")) for k in ("asin", "url", "keyword")}
    rows = rows.withColumns({f"__{k}": F.when(is_object, v) for k, v in fields.items()} | {"__market": F.when(is_object, F.coalesce(F.upper(F.get_json_object(text, "$.marketplace")), F.lit(market))).otherwise(F.lit(market)), "__plain": F.when(~is_object, F.regexp_replace(text, '^"|"$', ""))})
    asin, url, keyword, plain = (F.col(f"__{k}") for k in ("asin", "url", "keyword", "plain"))
    given = F.size(F.array_compact(F.array(asin, url, keyword)))
    hosts = F.create_map(*[F.lit(x) for m in MARKETS.values() for x in (m.code, m.host)])
    host, own = F.element_at(hosts, F.col("__market")), F.col("__market") == market
    web = plain.rlike("(?i)^https?://")
    reason = (
        F.when(plain.isNotNull(), F.when(~web & item_id(plain).isNull(), "ASIN_MALFORMED"))
        .when(is_object & (given != 1) | F.coalesce(text, F.lit("")).isin("", "null") | F.startswith(text, F.lit("[")), "URL_UNSUPPORTED")
        .when(host.isNull(), "MARKETPLACE_UNSUPPORTED")
        .when(asin.isNotNull() & item_id(asin).isNull(), "ASIN_MALFORMED")
    )
    value = (
        F.when(plain.isNotNull(), F.when(web, plain).otherwise(item_id(plain)))
        .when(url.isNotNull(), url)
        .when(keyword.isNotNull(), F.when(own, keyword).otherwise(search_url(host, keyword, F.lit(1))))
        .otherwise(F.when(own, item_id(asin)).otherwise(product_url(host, item_id(asin))))
    )
    kind = F.when(web | url.isNotNull() | (plain.isNull() & ~own), "url").when(keyword.isNotNull(), "keyword").otherwise("asin")
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.withColumns({"kind": F.when(ok, kind), "value": F.when(ok, value)}).drop("__asin", "__url", "__keyword", "__market", "__plain")


def ingest(rows: DataFrame, field: str, seq: str, dataset: str, limit: int | None = None) -> DataFrame:
    """Items of a stored dataset: value, kind (url or asin; null: rejected), reason, ref, row index by seq.

    The first `limit` rows by seq count. A field that is a list gives an item for each of its values that isn't blank. Values that are neither a
    URL nor an identifier are ASIN_MALFORMED; a row without any value is DATASET_FIELD_MISSING, a dataset without rows one row DATASET_EMPTY.
    """
    numbered = rows.orderBy(seq).limit(limit) if limit else rows
    index = F.row_number().over(Window.orderBy(seq)) - 1 if limit else F.col(seq)
    if isinstance(rows.schema[field].dataType, T.ArrayType):
        some = F.filter(F.transform(field, lambda v: F.trim(v.cast("string"))), lambda v: v != "")
        numbered = numbered.withColumn("__row", index.cast("long")).select("__row", F.explode_outer(some).alias("__value"))
    else:
        numbered = numbered.select(index.cast("long").alias("__row"), F.trim(F.col(field).cast("string")).alias("__value"))
    value = F.col("__value")
    is_url = F.lower(value).rlike("^https?://")
    kind = F.when(is_url, "url").when(item_id(value).isNotNull(), "asin")
    reason = F.when(F.coalesce(value, F.lit("")) == "", "DATASET_FIELD_MISSING").when(kind.isNull(), "ASIN_MALFORMED")
    items = numbered.select(F.col("__row").alias("row"), value.alias("value"), kind.alias("kind"), reason.alias("reason")).withColumn("ref", F.concat(F.lit(f"{dataset}#"), F.col("row").cast("string"), F.lit(f":{field}")))
    nothing = rows.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("kind"), F.lit("DATASET_EMPTY").alias("reason"), F.lit(dataset).alias("ref"))
    return items.unionByName(nothing)


def union_sources(sources: list[DataFrame], key: str, order: str, dedupe: bool = True) -> DataFrame:
    """Sources in order of rank, one row for each key: the first by (rank, order). With dedupe off every row stays.

    Adds source_rank and merged, the number of rows that the key had.
    """
    ranked = None
    for rank, part in enumerate(sources):
        part = part.withColumn("source_rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    if not dedupe:
        return ranked.withColumn("merged", F.lit(1).cast("long"))
    rest = [c for c in ranked.columns if c != key]
    # a minimum by struct combines on the map side, where a window would send every copy
    best = ranked.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("source_rank", order)).alias("r"), F.count(F.lit(1)).alias("merged"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest], "merged")


def merge_provenance(rows: DataFrame, key: str, seq: str, what: list[str]) -> DataFrame:
    """For each key the discoveries `what`, each once, in order of their first seq: key, discoveries array."""
    first = rows.groupBy(key, *what).agg(F.min(seq).alias("__seq"))
    listed = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__seq", *what))).alias("d"))
    return listed.select(key, F.transform("d", lambda d: F.struct(*[d[c].alias(c) for c in what])).alias("discoveries"))


def cut_at_capacity(rows: DataFrame, seq: str, cap: int) -> DataFrame:
    """status SELECTED for the first `cap` rows by seq (unique), RUN_ABORTED for the rest. No global sort of all rows."""
    edge = rows.select(seq).orderBy(seq).limit(cap).agg(F.max(seq)).scalar()
    return rows.withColumn("status", F.when(F.coalesce(F.col(seq) <= edge, F.lit(False)), "SELECTED").otherwise("RUN_ABORTED"))
