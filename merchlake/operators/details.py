"""Detail blocks of pages: buy box, offers, seller profiles, variants, media.

The page function finds texts, key tables and inline JSON; the rest is Column expressions over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions.markets import Market
from merchlake.functions.numbers import count, first_money, landed_price, percent, price
from merchlake.functions.text import condition, fulfillment, humanize_dimension, max_resolution, offer_fulfillment, strip_label
from merchlake.functions.urls import item_id, seller_id
from merchlake.operators import extract

#: Identifiers of the detail layouts, labels in several languages.
OFFER = '#aod-pinned-offer, #aod-offer, .aod-information-block, [data-csa-c-content-id="aod-offer"]'
OFFER_FIELDS = {
    "price": (("#aod-offer-price .a-offscreen", ".a-price .a-offscreen"), None),
    "shipping": (("#aod-offer-shipping-price .a-offscreen", ".aod-offer-shipping-price .a-offscreen"), None),
    "seller": (("#aod-offer-soldBy a", ".aod-offer-soldBy a", 'a[href*="seller="]', "#aod-offer-soldBy"), None),
    "link": (("#aod-offer-soldBy a", ".aod-offer-soldBy a", 'a[href*="seller="]'), "href"),
    "heading": (("#aod-offer-heading", ".aod-offer-heading"), None),
    "shipper": (("#aod-offer-shipsFrom", ".aod-offer-shipsFrom"), None),
    "feedback": (("#aod-offer-seller-rating", ".aod-offer-seller-rating"), None),
    "delivery": ((".aod-delivery-promise",), None),
    "whole": (None, None),
}
OFFER_PAGE = {"total": (("#aod-filter-offer-count-string", "#aod-total-offer-count"), None), "container": (("#aod-container", "#all-offers-display", "#aod-offer-list"), "id")}
FREE = "(?i)free shipping|livraison gratuite|spedizione gratuita|envío gratis|kostenlose lieferung"
BUYBOX_FIELDS = {
    "container": (("#buybox", "#desktop_buybox", "#tabular-buybox", "#addToCart_feature_div"), "id"),
    "box_price": (("#price_inside_buybox", "#corePrice_feature_div .a-offscreen"), None),
    "box_seller": (("#sellerProfileTriggerId", "#merchant-info a", "#merchant-info"), None),
    "box_link": (("#sellerProfileTriggerId", "#merchant-info a"), "href"),
    "box_shipper": (("#fulfillerInfoFeature_feature_div .offer-display-feature-text-message", "#tabular-buybox-truncate-0"), None),
    "sold_out": (("#outOfStock",), "id"),
}
SELLER_FIELDS = {
    "name": (("#sellerName", "#seller-profile-container h1"), None),
    "summary": (("#seller-feedback-summary", "#feedback-summary-table"), None),
    "days30": (('[data-feedback-window="30"]', "#feedback-30-days"), None),
    "days90": (('[data-feedback-window="90"]', "#feedback-90-days"), None),
    "days365": (('[data-feedback-window="365"]', "#feedback-365-days"), None),
}
SELLER_TABLES = ("#page-section-detail-seller-info", "#seller-profile-container")
BUSINESS_NAME = ("business name", "nom commercial", "unternehmensname", "ragione sociale", "nombre de empresa")
BUSINESS_ADDRESS = ("business address", "adresse commerciale", "geschäftsadresse", "indirizzo aziendale", "dirección empresarial")
LEGAL = "(?i)vat|ust-id|iva|tva|partita|registro|register|siret|nif|cif"
FEEDBACK = {"positive": "positiv|positif", "neutral": "neutr", "negative": "negativ|négatif"}
MAIN_IMAGE = ("#landingImage", "#imgTagWrapperId img", "#imgBlkFront")
#: A swatch of a twister: its item, its value, and the dimension it belongs to.
SWATCH = 'li[data-defaultasin], li[data-dp-url]'
SWATCH_FIELDS = {"child": (None, "data-defaultasin"), "link": (None, "data-dp-url"), "value": ((".a-button-text", ".swatch-title-text"), None), "hint": (None, "title")}
TWISTER = '#twister .a-row, #twister-plus-inline-twister .a-row, [id^="variation_"]'
TWISTER_FIELDS = {"ident": (None, "id"), "label": ((".a-form-label", ".twisterTextDiv", ".inline-twister-dim-title-value"), None)}
VARIANT_CARDS = {"twister_rows": (TWISTER, TWISTER_FIELDS, {"swatches": (SWATCH, SWATCH_FIELDS)})}
VARIANT_FIELDS = {"variant_parent": (("#twister", "#twister-plus-inline-twister", '[id^="variation_"]'), "id")}
MEDIA_FIELDS = {"sizes": (MAIN_IMAGE, "data-a-dynamic-image"), "src": (MAIN_IMAGE, "src")}
MEDIA_LISTS = {"thumbs": (("#altImages li img", "#imageBlockThumbs img"), "src")}
MEDIA_BLOBS = {"gallery": "colorImages", "films": "videos"}
VARIANT_BLOBS = {"matrix": "dimensionValuesDisplayData", "display": "dimensionsDisplay", "labels": "variationDisplayLabels", "dimensions": "dimensions"}


def offers(pages: DataFrame, market: Market, key: str, most: int, own_names) -> DataFrame:
    """key, items (the first `most` distinct offers in page order), total, truncated, status; a row for each page.

    Wrappers without a price and a seller are left out; of offers of one seller and price the first counts. An empty
    page is NOT_PRESENT if its container is known, else PARSER_MISS. A page stays one row throughout, so nothing is moved.
    """
    lists = extract.card_lists(pages.select(key, "html"), OFFER, OFFER_FIELDS, unique=None, heads=OFFER_PAGE)
    same, others = ["seller_id", "seller", "price"], ["condition", "shipping", "landed", "prime", "fulfillment", "delivery", "seller_rating", "seller_feedback"]
    told = F.transform("cards", lambda c: F.struct(seller_id(c["link"]).alias("seller_id"), c["seller"].alias("seller"), price(c["price"], market).alias("price"), c["place"].alias("place")))
    good = F.filter(told, lambda o: o["price"].isNotNull() | o["seller"].isNotNull())
    # in order of what makes offers the same and then of place, the first of each kind is the one that differs from the offer before it
    firsts = F.get(F.transform(F.array(F.sort_array(good)), lambda sorted_: F.filter(sorted_, lambda o, i: (i == 0) | ~_alike(o, F.get(sorted_, i - 1), same))), 0)
    placed = F.sort_array(F.transform(firsts, lambda o: F.struct(o["place"].alias("place"), *[o[f].alias(f) for f in same])))
    listed = lists.select(key, "cards", F.coalesce(placed, F.array()).alias("__all"), count(F.col("total"), market).alias("__told"), "container")

    def read(o: Column) -> Column:  # the other fields, of the offers that are listed
        c = F.get(F.col("cards"), o["place"] - 1)
        feedback = {"seller_rating": percent(c["feedback"]), "seller_feedback": count(F.regexp_extract(c["feedback"], "\\(([^)]*)\\)", 1), market)}
        found = {"condition": condition(c["heading"]), "shipping": price(c["shipping"], market), "prime": c["whole"].rlike("(?i)prime"), "fulfillment": offer_fulfillment(c["shipper"], c["seller"], own_names),
                 "delivery": c["delivery"], "free": c["whole"].rlike(FREE)}
        return F.struct(*[o[f].alias(f) for f in same], *[v.alias(f) for f, v in found.items()], *[F.when(c["feedback"].isNotNull(), v).alias(f) for f, v in feedback.items()])

    def summed(o: Column) -> Column:
        shipping = F.coalesce(o["shipping"], F.when(o["free"] & o["price"].isNotNull(), 0)).cast("long")
        made = {"shipping": shipping, "landed": landed_price(o["price"], shipping, o["free"])}
        return F.struct(*[(made[f] if f in made else o[f]).alias(f) for f in (*same, *others)])

    found = F.size("__all")
    total = F.coalesce("__told", F.when(found > 0, found.cast("long")))
    items = F.transform(F.transform(F.slice("__all", 1, most), read), summed)
    status = F.when(found > 0, "EXTRACTED").when(F.col("container").isNotNull(), "NOT_PRESENT").otherwise("PARSER_MISS")
    return listed.select(key, items.alias("items"), total.alias("total"), (F.coalesce(total, F.lit(0)) > F.least(found, F.lit(most))).alias("truncated"), status.alias("status"))


def _alike(one: Column, other: Column, fields) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & one[f].eqNullSafe(other[f])
    return out


def buybox(found: DataFrame, market: Market, own_names, labels=("Sold by", "Ships from and sold by")) -> DataFrame:
    """found (with BUYBOX_FIELDS) and a buybox struct: no container, or sold out with nothing, is NOT_PRESENT; a container with nothing PARSER_MISS."""
    price, seller = first_money(F.col("box_price"), market), strip_label(F.col("box_seller"), labels)
    nothing = price.isNull() & seller.isNull()
    status = F.when(F.col("container").isNull() | (F.col("sold_out").isNotNull() & nothing), "NOT_PRESENT").when(nothing, "PARSER_MISS").otherwise("EXTRACTED")
    there = status == "EXTRACTED"
    return found.withColumn("buybox", F.struct(
        there.alias("present"), F.when(there, seller).alias("seller"), F.when(status != "NOT_PRESENT", seller_id(F.col("box_link"), 10, 20)).alias("sellerId"), F.when(there, price).alias("price"),
        F.when(status != "NOT_PRESENT", F.col("box_shipper")).alias("shipsFrom"), F.when(there, fulfillment(F.col("box_shipper"), seller, own_names)).otherwise("UNKNOWN").alias("fulfillment"), status.alias("status"),
    ))


def _share(text: Column, words: str) -> Column:
    """The percentage that stands before (or after) one of the words."""
    before = F.regexp_extract(text, f"(?i)([0-9]{{1,3}}(?:[.,][0-9]*)?\\s*%)\\s*(?:{words})", 1)
    after = F.regexp_extract(text, f"(?i)(?:{words})\\p{{L}}*\\s*:?\\s*([0-9]{{1,3}}(?:[.,][0-9]*)?\\s*%)", 1)
    return percent(F.when(before != "", before).otherwise(after))


def _find(table: Column, labels) -> Column:
    """Value of the first key of a table that holds any of the labels."""
    def holds(entry):
        out = F.lit(False)
        for label in labels:
            out = out | F.contains(F.lower(entry["key"]), F.lit(label))
        return out

    return F.get(F.filter(F.map_entries(table), holds), 0)["value"]


def seller_profiles(pages: DataFrame, market: Market, key: str) -> DataFrame:
    """key and the profile of a seller's page: names, address, rating, counts, three windows, legal identifiers, status."""
    found = extract.extract_fields(pages.select(key, "html"), SELLER_FIELDS, maps={"info": SELLER_TABLES})
    number = lambda text: count(F.nullif(F.regexp_extract(text, "\\(([0-9.,\\s]+)\\)", 1), F.lit("")), market)

    def window(text):
        parts = [_share(text, words).alias(f"{name}Percent") for name, words in FEEDBACK.items()]
        return F.when(text.isNotNull(), F.struct(*parts, number(text).alias("count")))

    name, address, counted = _find(F.col("info"), BUSINESS_NAME), _find(F.col("info"), BUSINESS_ADDRESS), number(F.col("summary"))
    some = F.col("name").isNotNull() | name.isNotNull() | address.isNotNull() | counted.isNotNull()
    return found.select(
        key, F.col("name").alias("sellerName"), name.alias("businessName"), address.alias("businessAddress"), percent(F.col("summary")).alias("rating"), counted.alias("feedbackCount"),
        *[window(F.col(c)).alias(f"feedback{c.removeprefix('days')}Days") for c in ("days30", "days90", "days365")],
        F.map_filter("info", lambda k, v: k.rlike(LEGAL)).alias("legalIdentifiers"), F.when(some, "EXTRACTED").otherwise("PARSER_MISS").alias("status"),
    )


def variants(pages: DataFrame, key: str, mode: str = "discover", most: int = 50) -> DataFrame:
    """key, dimensions, items (identifier and options, in order of identifier), truncated, status.

    Labels count only if there are as many as options; missing ones are Option n. Mode none is NOT_APPLICABLE.
    """
    if mode == "none":
        empty = F.array().cast("array<struct<item:string,options:map<string,string>>>")
        return pages.select(key, F.array().cast("array<string>").alias("dimensions"), empty.alias("items"), F.lit(False).alias("truncated"), F.lit("NOT_APPLICABLE").alias("status"))
    found = extract.extract_fields(pages.select(key, "html"), VARIANT_FIELDS, blobs=VARIANT_BLOBS)
    return variants_block(found, most).select(key, "variants.*")


def all_variants(pages: DataFrame, key: str, mode: str = "discover", most: int = 50) -> DataFrame:
    """As variants; a page without a usable matrix that draws its items as swatches is EXTRACTED too."""
    if mode == "none":
        return variants(pages, key, mode, most)
    found = extract.extract_fields(pages.select(key, "html"), VARIANT_FIELDS, blobs=VARIANT_BLOBS, cards=VARIANT_CARDS)
    return variants_block(found, most).select(key, "variants.*")


def variants_block(found: DataFrame, most: int = 50) -> DataFrame:
    """found (with VARIANT_FIELDS and VARIANT_BLOBS) and a variants struct."""
    matrix = F.from_json("matrix", "map<string,array<string>>")
    rows = F.filter(F.map_entries(matrix), lambda e: e["key"].rlike("^[A-Z0-9]{10}$") & (F.size(e["value"]) > 0))
    raw = F.transform(F.from_json("dimensions", "array<string>"), lambda d: F.initcap(F.replace(F.regexp_replace(d, "_name$", ""), F.lit("_"), F.lit(" "))))
    named = F.coalesce(F.from_json("display", "array<string>"), F.when(F.startswith("labels", F.lit("[")), F.from_json("labels", "array<string>")), F.map_values(F.from_json("labels", "map<string,string>")), raw)
    found = found.withColumns({"__rows": F.array_sort(rows), "__named": F.coalesce(named, F.array().cast("array<string>"))})
    found = found.withColumn("__width", F.array_max(F.transform("__rows", lambda e: F.size(e["value"]))))
    label = F.transform(F.sequence(F.lit(1), F.greatest("__width", F.lit(1))), lambda i: F.coalesce(F.get(F.col("__named"), i - 1), F.concat(F.lit("Option "), i.cast("string"))))
    found = found.withColumn("__dims", F.when(F.col("__width").isNull(), F.array().cast("array<string>")).when(F.size("__named") == F.col("__width"), F.col("__named")).otherwise(label))
    items = F.transform(F.slice("__rows", 1, most), lambda e: F.struct(e["key"].alias("item"), F.map_from_arrays(F.slice(F.col("__dims"), F.lit(1), F.size(e["value"])), e["value"]).alias("options")))
    some = F.coalesce(F.size("__rows"), F.lit(0)) > 0
    dims, count = F.col("__dims"), F.coalesce(F.size("__rows"), F.lit(0))
    if "twister_rows" in found.columns:  # a layout without the matrix may draw its items as swatches
        found = found.withColumn("__drawn", _drawn_items(F.col("twister_rows")))
        drawn = ~some & (F.size("__drawn.items") > 0)
        items, dims, count = F.when(drawn, F.slice("__drawn.items", 1, most)).otherwise(items), F.when(drawn, F.col("__drawn.dimensions")).otherwise(dims), F.when(drawn, F.size("__drawn.items")).otherwise(count)
        some = some | drawn
    status = F.when(some, "EXTRACTED").when(F.col("variant_parent").isNotNull(), "PARSER_MISS").otherwise("NOT_PRESENT")
    block = F.struct(dims.alias("dimensions"), F.when(some, items).otherwise(F.array()).alias("items"), (some & (count > most)).alias("truncated"), status.alias("status"))
    return found.withColumn("variants", block).drop("__rows", "__named", "__width", "__dims", "__drawn")


def _swatch_name(row: Column) -> Column:
    """The dimension of a row of a twister: its label without the colon, else what its identifier says."""
    return F.coalesce(F.regexp_replace(row["label"], "[:\\uff1a]\\s*$", ""), F.when(F.startswith(row["ident"], F.lit("variation_")), humanize_dimension(F.regexp_replace(row["ident"], "^variation_", ""))))


def _swatch(card: Column) -> Column:
    item = F.coalesce(item_id(card["child"]), item_id(F.regexp_extract(card["link"], "/dp/([A-Za-z0-9]{10})", 1)))
    return F.struct(item.alias("item"), F.regexp_replace(F.coalesce(card["value"], card["hint"]), "^(?i)Click to select\\s*", "").alias("value"))


def _drawn_items(rows: Column) -> Column:
    """struct(dimensions, items) of the rows of a twister; of several values of an item's dimension the last holds."""
    named = F.filter(F.transform(rows, lambda r: F.struct(_swatch_name(r).alias("dimension"), F.filter(F.transform(r["swatches"], _swatch), lambda s: s["item"].isNotNull() & s["value"].isNotNull()).alias("swatches"))), lambda r: r["dimension"].isNotNull() & (F.size(r["swatches"]) > 0))
    flat = F.flatten(F.transform(named, lambda r: F.transform(r["swatches"], lambda s: F.struct(s["item"].alias("item"), r["dimension"].alias("dimension"), s["value"].alias("value")))))

    def listed(all_: Column) -> Column:
        def one(item: Column) -> Column:
            own = F.filter(all_, lambda s: s["item"] == item)
            names = F.array_distinct(F.transform(own, lambda s: s["dimension"]))
            return F.struct(item.alias("item"), F.map_from_arrays(names, F.transform(names, lambda d: F.element_at(F.filter(own, lambda s: s["dimension"] == d), -1)["value"])).alias("options"))

        items = F.transform(F.array_sort(F.array_distinct(F.transform(all_, lambda s: s["item"]))), one)
        return F.struct(F.array_distinct(F.transform(all_, lambda s: s["dimension"])).alias("dimensions"), items.alias("items"))

    return F.get(F.transform(F.array(flat), listed), 0)


def swatch_variants(pages: DataFrame, key: str, most: int = 50) -> DataFrame:
    """key, dimensions, items, truncated of twisters drawn as swatches, for layouts without the JSON matrix; a row only for pages that have some.

    A row of the twister is a dimension; its label stands before the swatches, else its identifier names it.
    """
    rows = extract.extract_cards(pages.select(key, "html"), TWISTER, TWISTER_FIELDS, unique=None, nested={"swatches": (SWATCH, SWATCH_FIELDS)})
    named = _swatch_name(F.struct("label", "ident"))
    swatches = rows.withColumn("dimension", named).where("dimension IS NOT NULL").select(key, F.col("place").alias("row"), "dimension", F.explode("swatches").alias("s"))
    found = swatches.select(key, "row", "dimension", _swatch(F.col("s")).alias("s")).select(key, "row", "dimension", "s.*").where("item IS NOT NULL AND value IS NOT NULL")
    # of several values of a dimension the last holds, as for its swatches in page order
    each = found.groupBy(key, "item", "dimension").agg(F.max_by("value", "row").alias("value"), F.min("row").alias("row"))
    items = each.groupBy(key, "item").agg(F.sort_array(F.collect_list(F.struct("row", "dimension", "value"))).alias("o"))
    options = F.map_from_entries(F.transform("o", lambda x: F.struct(x["dimension"], x["value"])))
    # maps have no order, so the list is put in order by item alone; rows and dimensions come out of the options
    by_item = F.array_sort(F.collect_list(F.struct("item", options.alias("options"))), lambda a, b: F.when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0))
    listed = items.groupBy(key).agg(by_item.alias("__items"), F.sort_array(F.flatten(F.collect_list(F.transform("o", lambda x: F.struct(x["row"], x["dimension"]))))).alias("__rows"))
    dimensions = F.array_distinct(F.transform("__rows", lambda x: x["dimension"]))
    return listed.select(key, dimensions.alias("dimensions"), F.slice("__items", 1, most).alias("items"), (F.size("__items") > most).alias("truncated"))


def media(pages: DataFrame, key: str) -> DataFrame:
    """key, mainImage, images, videos, status: the gallery's JSON, else the main image's sizes (widest first), its source, thumbnails."""
    found = extract.extract_fields(pages.select(key, "html"), MEDIA_FIELDS, MEDIA_LISTS, blobs=MEDIA_BLOBS)
    return media_block(found).select(key, "media.*")


def media_block(found: DataFrame) -> DataFrame:
    """found (with MEDIA_FIELDS, MEDIA_LISTS and MEDIA_BLOBS) and a media struct."""
    initial = F.from_json("gallery", "struct<initial:array<struct<hiRes:string,large:string,thumb:string>>>")["initial"]
    gallery = F.transform(initial, lambda e: F.coalesce(e["hiRes"], e["large"], e["thumb"]))
    sizes = F.map_entries(F.from_json("sizes", "map<string,array<int>>"))
    widest = F.transform(F.array_sort(sizes, lambda a, b: F.coalesce(F.get(b["value"], 0), F.lit(0)) - F.coalesce(F.get(a["value"], 0), F.lit(0))), lambda e: e["key"])
    web = lambda urls: F.filter(urls, lambda u: u.rlike("^https?://"))
    first = F.when(F.size(web(gallery)) > 0, web(gallery)).otherwise(F.coalesce(web(widest), F.array()))
    every = F.concat(first, web(F.array("src")), web(F.coalesce("thumbs", F.array())))
    images = F.array_distinct(F.transform(F.array_compact(every), max_resolution))
    films = F.array_distinct(F.coalesce(web(F.transform(F.from_json("films", "array<struct<url:string>>"), lambda v: v["url"])), F.array()))
    return found.withColumn("media", F.struct(F.get(images, 0).alias("mainImage"), images.alias("images"), films.alias("videos"), F.when(F.size(images) > 0, "EXTRACTED").otherwise("PARSER_MISS").alias("status")))
