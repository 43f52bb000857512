"""Item identifiers and URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions.markets import MARKETS

#: Where an identifier stands in a path.
ID_PATHS = ("/dp/", "/gp/product/", "/gp/aw/d/", "/product/", "/dp/product/")


def item_id(text: Column) -> Column:
    """Ten letters or digits after trimming, in capitals, else null."""
    up = F.upper(F.trim(text))
    return F.when(up.rlike("^[A-Z0-9]{10}$"), up)


def location_key(postal: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(postal), F.lit("")), F.lit("default"))


def dedupe_key(market: Column, item: Column, postal: Column) -> Column:
    return F.concat_ws("|", market, item, location_key(postal))


def _query(url: Column, key: str) -> Column:
    return F.try_url_decode(F.replace(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)), F.lit("+"), F.lit(" ")))


def classify_urls(rows: DataFrame, url: str, hosts: dict[str, str] | None = None, to: str = "url_class") -> DataFrame:
    """rows with a struct(type, market, item, keyword, node, seller, reason) of a URL column; reason is set where type is null.

    Precedence: identifier in the query, identifier in the path, seller, best sellers, keyword, category.
    hosts maps host names to markets (default: the markets' own, with or without www). Parts that several rules read
    are made once, in a projection of their own.
    """
    hosts = hosts or {h: m.code for m in MARKETS.values() for h in (m.host, m.host.removeprefix("www."))}
    text = F.trim(F.col(url))
    scheme, host, path = (F.try_parse_url(text, F.lit(p)) for p in ("PROTOCOL", "HOST", "PATH"))
    market = F.element_at(F.create_map(*[F.lit(x) for kv in hosts.items() for x in kv]), F.lower(host))
    parts = {"__web": F.coalesce(F.lower(scheme).isin("http", "https"), F.lit(False)), "__market": market, "__path": F.coalesce(path, F.lit(""))}
    parts |= {f"__{k}": _query(text, k) for k in ("asin", "seller", "me", "k", "node", "rh")}
    rows = rows.withColumns(parts)
    in_path = F.coalesce(*[item_id(F.nullif(F.regexp_extract("__path", f"(?i){p}([A-Z0-9]{{10}})(?:[/?#]|$)", 1), F.lit(""))) for p in ID_PATHS])
    low = F.lower("__path")
    seller, keyword, node = F.coalesce("__seller", "__me"), F.col("__k"), F.col("__node")
    is_seller = (seller.isNotNull() & (seller != "")) | F.contains(low, F.lit("/stores/")) | (low == "/sp") | F.startswith(low, F.lit("/sp/"))
    best = F.contains(low, F.lit("/bestsellers")) | F.contains(low, F.lit("/zgbs"))
    search = (low == "/s") | F.startswith(low, F.lit("/s/")) | keyword.isNotNull()
    category = node.isNotNull() | F.contains(low, F.lit("/b/")) | F.contains(low, F.lit("/gp/browse"))
    rows = rows.withColumn("__item", F.coalesce(item_id(F.col("__asin")), in_path))
    kind = F.when(F.col("__item").isNotNull(), "url").when(is_seller, "seller").when(best, "bestsellers").when(search, "keyword").when(category, "category")
    rows = rows.withColumn("__kind", F.when(F.col("__web") & F.col("__market").isNotNull(), kind))
    kind = F.col("__kind")
    reason = F.when(~F.col("__web"), "URL_UNSUPPORTED").when(F.col("__market").isNull(), "MARKETPLACE_UNSUPPORTED").when(kind.isNull(), "URL_NO_ASIN")
    found = F.struct(
        kind.alias("type"), F.col("__market").alias("market"), F.when(kind == "url", F.col("__item")).alias("item"), F.when(kind == "keyword", keyword).alias("keyword"),
        F.when(kind.isin("keyword", "bestsellers", "category"), F.coalesce(F.when(kind == "keyword", F.col("__rh")), node)).alias("node"),
        F.when(kind == "seller", seller).alias("seller"), reason.alias("reason"),
    )
    return rows.withColumn(to, found).drop("__item", "__kind", *parts)


def product_url(host: Column, item: Column) -> Column:
    return F.concat(F.lit("https://"), host, F.lit("/dp/"), item)


def search_url(host: Column, keyword: Column, page: Column) -> Column:
    more = F.when(page > 1, F.concat(F.lit("&page="), page.cast("string"))).otherwise("")
    return F.concat(F.lit("https://"), host, F.lit("/s?k="), F.url_encode(keyword), more)


def with_page(url: Column, page: Column) -> Column:
    """url with its page parameter set; what is no URL stays."""
    value = F.concat(F.lit("page="), page.cast("string"))
    has = url.rlike("[?&]page=[^&#]*")
    there = F.regexp_replace(url, F.lit("([?&])page=[^&#]*"), F.concat(F.lit("$1"), value))
    added = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), value)
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNull(), url).when(has, there).otherwise(added)


def seller_url(host: Column, seller: Column) -> Column:
    return F.concat(F.lit("https://"), host, F.lit("/sp?seller="), seller)


def offers_url(host: Column, item: Column) -> Column:
    """The page of all offers of an item."""
    return F.concat(F.lit("https://"), host, F.lit("/gp/product/ajax/ref=dp_aod_ALL_mbc?asin="), item, F.lit("&m=&qid=&smid=&sourcecustomerorglistid=&sourcecustomerorglistitemid=&sr=&pc=dp&experienceId=aodAjaxMain"))


def storefront_url(host: Column, seller: Column) -> Column:
    """The listing of a seller's items, which a seller profile stands for when items are wanted."""
    return F.concat(F.lit("https://"), host, F.lit("/s?me="), seller)


def seller_id(link: Column, least: int = 5, most: int = 30) -> Column:
    return F.get(F.regexp_extract_all(link, F.lit(f"(?i)[?&](?:seller|me)=([A-Z0-9]{{{least},{most}}})(?:[&#]|$)"), F.lit(1)), 0)
