"""Pages to structured blocks. A page is parsed once, in one Arrow stage, for all the fields asked for.

What the page function returns is text, as found by ordered selectors; numbers, states and statuses are made from
it by Column expressions. Selectors are data, so other layouts need no code.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import dom, plain
from merchlake.functions.markets import LABELS, Market
from merchlake.functions.numbers import count, demand, first_money, rating
from merchlake.functions.text import after_label, availability_state, brand_name, clean_text, coupon, delivery_date, first_label, lookup_label, rank_lines
from merchlake.functions.urls import item_id

#: In place of an attribute of a list: the texts of all selectors, one after the other, not of the first that has any.
ALL = "**"
#: In place of an attribute: whether there is such an element ("1" or null).
EXISTS = "?"
#: Field -> (selectors in order, attribute or None for text). Identifiers of the listing layout.
IDENTITY_FIELDS = {
    "title": (("#productTitle", "#title span", "h1#title", "#title", "h1"), None),
    "item": (("input#ASIN", 'input[name="ASIN"]', 'input[name="asin"]'), "value"),
    "item_data": (("#averageCustomerReviews[data-asin]",), "data-asin"),
    "parent_input": (("input#parentAsin", 'input[name="parentAsin"]'), "value"),
    "brand": (("#bylineInfo", "#brand", ".po-brand .po-break-word"), None),
}
PRICE_FIELDS = {
    "price": (("#corePriceDisplay_desktop_feature_div .priceToPay .a-offscreen", "#corePriceDisplay_desktop_feature_div span.aok-offscreen", "#corePriceDisplay_mobile_feature_div .priceToPay .a-offscreen",
               "#corePrice_feature_div .priceToPay .a-offscreen", "#corePrice_feature_div .a-price .a-offscreen", "#apex_desktop .priceToPay .a-offscreen", "#apex_desktop .a-price .a-offscreen",
               ".priceToPay .a-offscreen", "#corePrice_feature_div .a-offscreen"), None),
    "deal_price": (("#priceblock_dealprice", "#priceblock_saleprice", "#dealprice_feature_div .a-offscreen"), None),
    "buybox_price": (("#price_inside_buybox", "#newBuyBoxPrice", "#buybox .a-price .a-offscreen", "#priceblock_ourprice", "#tp_price_block_total_price_ww .a-offscreen"), None),
    "list_price": (("#corePriceDisplay_desktop_feature_div .basisPrice .a-offscreen", '#corePriceDisplay_desktop_feature_div span[data-a-strike="true"] .a-offscreen', "#corePrice_feature_div .basisPrice .a-offscreen",
                    '#apex_desktop span[data-a-strike="true"] .a-offscreen', '.a-price.a-text-price[data-a-strike="true"] .a-offscreen', "#listPrice", "#priceblock_listprice",
                    ".basisPrice .a-offscreen", ".a-text-price .a-offscreen"), None),
    "subscribe": (("#sns-base-price", "#snsPrice .a-offscreen", "#sns-tiered-price .a-offscreen"), None),
    "unit_price": (("#corePriceDisplay_desktop_feature_div .pricePerUnit", "#corePrice_feature_div .pricePerUnit", ".a-price + .a-size-small.a-color-price", "#per-unit-price"), None),
    "deal_badge": (("#dealBadge", ".dealBadge", "#deal_badge_inner_div", ".a-badge-label-inner .a-badge-text"), None),
    "coupon": (("#promoPriceBlockMessage .couponLabelText", "#couponTextpctch", "#couponBadgeRegularVpc", "#vpcButton .a-color-success", ".promoPriceBlockMessage .a-color-success", 'label[id^="couponText"]'), None),
}
RATING_FIELDS = {
    "rating": (("#acrPopover",), "title"),
    "rating_text": (("#acrPopover .a-size-base.a-color-base", 'span[data-hook="rating-out-of-text"]', "#averageCustomerReviews .a-icon-alt", "#acrPopover .a-icon-alt", ".reviewCountTextLinkedHistogram .a-icon-alt"), None),
    "reviews": (("#acrCustomerReviewText", '[data-hook="total-review-count"]', "#reviewsMedley .a-size-base"), None),
    "review_section": (("#averageCustomerReviews", "#acrPopover", "#reviewsMedley"), "id"),
}
#: Fields of each block of a product page, so that a run reads those it asks for.
STOCK_FIELDS = {
    "availability": (("#availability .a-color-success", "#availability .a-color-price", "#availability .a-color-state", "#availability span", "#availability", "#outOfStock .a-color-price",
                      "#exports_desktop_outOfStock_buybox_message_feature_div"), None),
    "sold_out_mark": (("#outOfStock",), EXISTS),
    "stock_box": (("#availability",), EXISTS),
    "offer_box": (("#buybox", "#corePriceDisplay_desktop_feature_div"), EXISTS),
    "stock_left": (("#availability .a-color-price", "#availability .a-color-state", "#availability span", "#availability"), None),
    "delivery": (("#mir-layout-DELIVERY_BLOCK-slot-PRIMARY_DELIVERY_MESSAGE_LARGE", "#deliveryBlockMessage .a-text-bold", "#deliveryBlockMessage", "#mir-layout-DELIVERY_BLOCK", "#delivery-block", "#ddmDeliveryMessage",
                  "[data-csa-c-delivery-time]"), None),
    "shipping": (("#deliveryBlockMessage .a-color-secondary", "#shippingMessageInsideBuyBox_feature_div", "#price-shipping-message"), None),
    "sold_by": (('#tabular-buybox .tabular-buybox-text[tabular-attribute-name="Sold by"]', '#tabular-buybox .tabular-buybox-text[tabular-attribute-name="Verkauft von"]', "#sellerProfileTriggerId", "#merchant-info"), None),
    "ships_from": (('#tabular-buybox .tabular-buybox-text[tabular-attribute-name="Ships from"]', '#tabular-buybox .tabular-buybox-text[tabular-attribute-name="Dispatches from"]',
                    '#tabular-buybox .tabular-buybox-text[tabular-attribute-name="Versand durch"]', "#fulfillerInfoFeature_feature_div .offer-display-feature-text-message"), None),
    "prime_badge": (("#primeSavingsBadge", "#isPrimeExclusive", ".a-icon-prime"), EXISTS),
    "delivery_box": (("#mir-layout-DELIVERY_BLOCK", "#deliveryBlockMessage"), EXISTS),
}
RANK_FIELDS = {"bought": (("#social-proofing-faceout-title-tk_bought", "#socialProofingAsinFaceout_feature_div", ".social-proofing-faceout-title-text", "#acrCustomerReviewText + span"), None)}
PRODUCT_FIELDS = {**IDENTITY_FIELDS, **PRICE_FIELDS, **STOCK_FIELDS, **RATING_FIELDS}
#: Boxes that may hold ranks, in order, and what each of them is called.
RANK_BOXES = {"rank_boxes": ("#productDetails_detailBullets_sections1", "#productDetails_db_sections", "#prodDetails", "#detailBulletsWrapper_feature_div", "#detailBullets_feature_div",
                             "#productDetails_feature_div", "#SalesRank", "#detail-bullets")}
RANK_SOURCES = ("PRODUCT_DETAILS_TABLE",) * 3 + ("DETAIL_BULLETS",) * 2 + ("PRODUCT_INFORMATION",) * 3
CONTENT_FIELDS = {
    "description": (("#productDescription p", "#productDescription", "#bookDescription_feature_div"), None),
    "rich": (("#aplus", "#aplus_feature_div", "#aplusBrandStory_feature_div"), EXISTS),
}
CONTENT_LISTS = {
    "bullets": (("#feature-bullets li:not(.aok-hidden) span.a-list-item", "#featurebullets_feature_div li span.a-list-item", "#productFactsDesktop_feature_div li span"), None),
    "breadcrumb": (("#wayfinding-breadcrumbs_feature_div li a, #nav-subnav .nav-a-content",), None),
    "badges": (("#climatePledgeFriendlyBadge", ".climate-pledge-friendly-badge", "#zeitgeistBadge_feature_div", ".badge-wrapper .a-badge-text"), ALL),
}
CONTENT_TABLES = {
    "specs": ("#productDetails_techSpec_section_1", "#productDetails_techSpec_section_2", "#technicalSpecifications_section_1", "#productDetails_detailBullets_sections1", "#detailBullets_feature_div",
              "#detailBulletsWrapper_feature_div", "#prodDetails table", "#poExpander table", "#productOverview_feature_div table"),
    "technical": ("#productDetails_techSpec_section_1", "#technicalSpecifications_section_1"),
}
CONTENT_LABELS = {
    "manufacturer": ("Manufacturer", "Hersteller"),
    "model": ("Item model number", "Model", "Modellnummer", "Modell"),
    "partNumber": ("Part Number", "Teilenummer", "Artikelnummer"),
    "productType": ("Product type", "Produkttyp"),
    "dimensions": ("Product Dimensions", "Produktabmessungen", "Item Dimensions"),
    "packageDimensions": ("Package Dimensions", "Verpackungsabmessungen"),
    "weight": ("Item Weight", "Artikelgewicht", "Weight", "Gewicht"),
    "dateFirstAvailable": ("Date First Available", "Im Angebot von Amazon.de seit", "Im Angebot seit"),
}
#: Rows of the star histogram, such as "5 star 61%"; strings of scripts.
STARS = {"stars": (("#histogramTable tr", '[data-hook="histogram-row"]', ".a-histogram-row"), None)}
IDENTITY_STRINGS = {"item_script": "currentAsin", "parent_script": "parentAsin"}
#: What tells the kinds of pages apart.
PAGE_ANCHORS = {
    "anchor": (("#productTitle", "#dp", "#ppd", "input#ASIN"), EXISTS), "gone": (("#outOfStock",), EXISTS), "buy_box": (("#buybox", "#addToCart_feature_div"), EXISTS),
    "twister": (("#twister", "#twister-plus-inline-twister", '[id^="variation_"]'), EXISTS), "book": (("#bookDescription_feature_div", "#ebooksProductTitle", "#mediaTabs_tabSet"), EXISTS),
    "results": (('[data-component-type="s-search-result"]', ".s-result-item[data-asin]", ".stores-widget-btf [data-asin]", '[data-testid="grid-container"] [data-asin]', ".ProductGridItem__itemOuter__KUtvv[data-asin]"), EXISTS),
}
CHALLENGE_MARKS = ("/errors/validatecaptcha", 'id="captchacharacters"', 'name="amzn-captcha-submit"')
NOT_FOUND_MARKS = ("dogs of amazon",)
PAGE_FIELDS = {"title": (("title",), None), "heading": (("h1",), None), "language": (("html",), "lang")}
CARD = ('[data-component-type="s-search-result"][data-asin], .s-result-item[data-asin]:not(.AdHolder), .stores-widget-btf [data-asin], '
        '[data-testid="grid-container"] [data-asin], .ProductGridItem__itemOuter__KUtvv[data-asin]')
SEARCH_PAGE = {"next": (("a.s-pagination-next:not(.s-pagination-disabled)", ".s-pagination-item.s-pagination-next:not(.s-pagination-disabled)"), EXISTS)}
CARD_FIELDS = {
    "item": (None, "data-asin"),
    "title": (("h2",), None),
    "price": ((".a-price .a-offscreen",), None),
    "list_price": ((".a-text-price .a-offscreen",), None),
    "rating": ((".a-icon-alt",), None),
    "reviews": ((".s-underline-text",), None),
    "sponsored": ((".puis-sponsored-label-text", ".s-sponsored-label-text", '[data-component-type="sp-sponsored-result"]'), EXISTS),
    "prime": ((".a-icon-prime", '[aria-label="Prime"]'), EXISTS),
    "badge": ((".a-badge-text",), None),
    "thumbnail": (("img.s-image",), "src"),
    "delivery": (('[data-cy="delivery-recipe"]', ".udm-primary-delivery-message"), None),
    "demand": ((".a-row .a-color-secondary",), None),
}


def _field(node, selectors, attribute):
    if selectors is None:  # of the node itself
        return (node.attrs.get(attribute) or "").strip() or None if attribute else dom.squeeze(node.text())
    if attribute == EXISTS:
        return "1" if any(node.select(s) for s in selectors) else None
    return node.first_attr(attribute, *selectors) if attribute else node.first_text(*selectors)


def _list(root, selectors, attribute):
    if attribute == ALL:
        return list(dict.fromkeys(t for s in selectors for n in root.select(s) if (t := dom.squeeze(n.text()))))
    for selector in selectors:
        values = [(n.attrs.get(attribute) or "").strip() if attribute else dom.squeeze(n.text()) for n in root.select(selector)]
        if values := list(dict.fromkeys(v for v in values if v)):
            return values
    return []


#: Pages whose fields a worker holds at a time, and bytes of pages whose cards it does.
PAGES_AT_ONCE, BYTES_AT_ONCE = 64, 1 << 21


def extract_fields(pages: DataFrame, fields: dict = PAGE_FIELDS, lists: dict | None = None, maps: dict | None = None, blobs: dict | None = None, html: str = "html", strings: dict | None = None, linked: str | None = None, boxes: dict | None = None, cards: dict | None = None, closed: bool = False) -> DataFrame:
    """pages without html, with a string column a field, an array column a list, and parse_error (null: parsed).

    maps (name -> selectors) gives key and value tables as map columns; blobs (name -> key) the JSON text behind a key of
    an inline script, strings (name -> key) the quoted text behind one; linked names a column for the page's linked-data
    objects, as the text of a JSON array; boxes (name -> selectors) gives the whole text of each selector's matches, null without any.
    cards (name -> (selector, fields, nested)) gives an array of cards as in card_lists. closed: only character references that end in a semicolon
    are read, so that one cut short stays as it is written. Unwanted fields are simply not asked for, so they cost nothing.
    """
    lists, maps, blobs, strings, boxes, cards = lists or {}, maps or {}, blobs or {}, strings or {}, boxes or {}, cards or {}
    card_types = {c: _card_type(within, nested) for c, (_, within, nested) in cards.items()}
    kept = [c for c in pages.columns if c != html]
    texts = [*fields, *blobs, *strings, *([linked] if linked else [])]

    def read(page: str) -> dict:
        root = dom.parse(page, closed)
        values = {k: _field(root, *v) for k, v in fields.items()} | {k: _list(root, *v) for k, v in lists.items()}
        values |= {k: list(dom.key_values(root, *v).items()) for k, v in maps.items()} | {k: dom.json_slice(page, v) for k, v in blobs.items()}
        values |= {k: dom.js_string(page, v) for k, v in strings.items()}
        values |= {k: _cards(root, selector, within, None, nested) for k, (selector, within, nested) in cards.items()}
        values |= {k: [dom.squeeze("".join(n.text() for n in root.select(s))) for s in v] for k, v in boxes.items()}
        return values | ({linked: json.dumps(dom.json_ld(root))} if linked else {})

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES_AT_ONCE):
                batch = whole.slice(at, PAGES_AT_ONCE)
                made = {c: [] for c in [*texts, *lists, *boxes, *cards, *maps, "parse_error"]}
                for page in batch.column(batch.schema.get_field_index(html)):
                    error, values = None, {}
                    try:
                        values = read(page.as_py() or "")
                    except Exception as e:  # a page that breaks the parser becomes a row that says so
                        error = f"PARSER_THREW:{type(e).__name__}"
                    for c in made:
                        made[c].append(error if c == "parse_error" else values.get(c))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                kinds = {c: pa.list_(pa.string()) for c in [*lists, *boxes]} | {c: pa.map_(pa.string(), pa.string()) for c in maps} | {c: pa.list_(t) for c, (_, t) in card_types.items()}
                columns += [pa.array(v, kinds.get(c, pa.string())) for c, v in made.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema] + [f"`{c}` string" for c in texts] + [f"`{c}` array<string>" for c in [*lists, *boxes]] + [f"`{c}` array<{d}>" for c, (d, _) in card_types.items()] + [f"`{c}` map<string,string>" for c in maps] + ["parse_error string"])
    return pages.mapInArrow(run, schema)


def _portions(whole: pa.RecordBatch, html: str):
    """Parts of a batch whose pages have about BYTES_AT_ONCE bytes."""
    passed = np.cumsum(pc.fill_null(pc.binary_length(whole.column(whole.schema.get_field_index(html))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < whole.num_rows:
        end = max(at + 1, int(np.searchsorted(passed, (passed[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
        yield whole.slice(at, end - at)
        at = end


def _cards(root, card: str, fields: dict, unique: str | None, nested: dict) -> list[dict]:
    found, seen = [], set()
    for node in root.select(card):
        values = {k: _field(node, *v) for k, v in fields.items()}
        if unique and (values[unique] is None or values[unique] in seen):
            continue
        seen.add(values.get(unique))
        inside = {k: _cards(node, selector, within, None, {}) for k, (selector, within) in nested.items()}
        found.append({"place": len(found) + 1, **values, **inside})
    return found


def _card_type(fields: dict, nested: dict) -> tuple[str, pa.DataType]:
    """The type of a card, for Spark and for Arrow."""
    inner = {k: _card_type(within, {}) for k, (_, within) in nested.items()}
    ddl = ",".join(["place:int", *[f"`{c}`:string" for c in fields], *[f"`{k}`:array<{d}>" for k, (d, _) in inner.items()]])
    return f"struct<{ddl}>", pa.struct([("place", pa.int32()), *[(c, pa.string()) for c in fields], *[(k, pa.list_(t)) for k, (_, t) in inner.items()]])


def card_lists(pages: DataFrame, card: str = CARD, fields: dict = CARD_FIELDS, html: str = "html", unique: str | None = "item", heads: dict | None = None, nested: dict | None = None) -> DataFrame:
    """pages without html, with the fields `heads` of the page itself and `cards`, an array of its cards: place (from 1) and fields of each.

    Cards of a page that share `unique` count once, those without it not at all. nested (name -> (selector, fields)) gives a card an array of cards of its
    own. A page is parsed once; its cards are unfolded on the JVM's side.
    """
    heads, nested = heads or {}, nested or {}
    kept = [c for c in pages.columns if c != html]
    ddl, arrow = _card_type(fields, nested)

    def run(batches):
        # plain pages are read together, the others one by one
        reader = plain.Cards(card, fields, heads, EXISTS) if not (unique or nested) and plain.Cards.fit(card, fields, heads) else None
        for whole in batches:
            for part in _portions(whole, html):
                texts, taken, made = part.column(part.schema.get_field_index(html)), [], []
                if reader:
                    taken, tops, sizes, values = reader.read(texts)
                    ends = np.cumsum(sizes)
                    places = pa.array(np.arange(1, sizes.sum() + 1) - np.repeat(ends - sizes, sizes), pa.int32())
                    found = pa.StructArray.from_arrays([places, *values.values()], fields=[*arrow])
                    made.append([*tops.values(), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), found, type=pa.list_(arrow))])
                if left := np.setdiff1d(np.arange(part.num_rows), taken).tolist():
                    rows = [([_field(root, *v) for v in heads.values()], _cards(root, card, fields, unique, nested)) for root in (dom.parse(texts[k].as_py() or "") for k in left)]
                    made.append([*[pa.array([top[k] for top, _ in rows], pa.string()) for k in range(len(heads))], pa.array([found for _, found in rows], pa.list_(arrow))])
                back = pa.array(np.argsort(np.concatenate((taken, left)), kind="stable"))
                columns = [made[0][k] if len(made) == 1 else pa.concat_arrays([m[k] for m in made]).take(back) for k in range(len(heads) + 1)]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], *columns], names=[*kept, *heads, "cards"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema] + [f"`{c}` string" for c in heads] + [f"cards array<{ddl}>"])
    return pages.mapInArrow(run, schema)


def extract_cards(pages: DataFrame, card: str = CARD, fields: dict = CARD_FIELDS, html: str = "html", unique: str | None = "item", heads: dict | None = None, nested: dict | None = None) -> DataFrame:
    """A row for each card of each page: its place in the page (from 1) and its fields; cards of a page that share `unique` count once.

    heads are fields of the page itself, on each of its rows; with them a page without cards has a row too, of no place.
    """
    lists = card_lists(pages, card, fields, html, unique, heads, nested)
    kept = [c for c in pages.columns if c != html]
    unfold = F.explode_outer if heads else F.explode
    rows = lists.select(*kept, *(heads or {}), unfold("cards").alias("__card"))
    return rows.select(*kept, *[F.col(f"__card.`{c}`").alias(c) for c in ["place", *fields, *(nested or {})]], *(heads or {}))


def page_marks(html: Column, challenge=(), not_found=(), no_results=()) -> Column:
    """struct(challenge, not_found, no_results, chars) of a page's text, made before the page function so that the text goes through it once."""
    low = F.lower(html)

    def holds(words):
        out = F.lit(False)
        for w in words:
            out = out | F.coalesce(F.contains(low, F.lit(w.lower())), F.lit(False))
        return out

    return F.struct(
        holds((*CHALLENGE_MARKS, *challenge)).alias("challenge"), holds((*NOT_FOUND_MARKS, *not_found)).alias("not_found"), holds(no_results).alias("no_results"),
        F.coalesce(F.length(html), F.lit(0)).alias("chars"), F.coalesce(F.length(F.trim(html)), F.lit(0)).alias("trimmed"),
    )


def page_class(marks: Column, status: Column, expected: Column, found: dict[str, Column], least: int = 8000) -> Column:
    """struct(type, blocked, not_found, reason) of a page: text and status rules in order, then the anchors that the page function found.

    marks: see page_marks. expected: PRODUCT, SEARCH or AUXILIARY (offers and seller pages, which have no anchors). found: whether there is each of
    PAGE_ANCHORS; one that isn't given isn't there. A product page below `least` characters is a template.
    """
    has = {k: F.coalesce(found[k], F.lit(False)) if k in found else F.lit(False) for k in PAGE_ANCHORS}

    def told(kind: str, blocked: bool = False, not_found: bool = False, reason: str | None = None) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(blocked).alias("blocked"), F.lit(not_found).alias("not_found"), F.lit(reason).cast("string").alias("reason"))

    template = told("UNKNOWN", True, reason="EMPTY_TEMPLATE")
    auxiliary, search = F.coalesce(expected == "AUXILIARY", F.lit(False)), F.coalesce(expected == "SEARCH", F.lit(False))
    return (
        F.when(marks["challenge"], told("CHALLENGE", True, reason="CHALLENGE_PAGE"))
        .when(marks["not_found"], told("NOT_FOUND", not_found=True, reason="DOG_PAGE"))
        .when(status == 404, told("NOT_FOUND", not_found=True, reason="HTTP_STATUS"))
        .when(status.isin(401, 403, 407, 429, 451) | (status >= 500), told("CHALLENGE", True, reason="HTTP_STATUS"))
        .when(status >= 400, told("UNKNOWN", reason="HTTP_STATUS"))
        .when(auxiliary, F.when(marks["trimmed"] >= 200, told("UNKNOWN")).otherwise(template))
        .when((expected == "PRODUCT") & (marks["chars"] < least), template)
        .when(search, F.when(has["results"], told("SEARCH")).when(marks["no_results"], told("SEARCH", not_found=True, reason="URL_NO_ASIN")).otherwise(template))
        .when(~has["anchor"], template)
        .when(has["gone"] & ~has["buy_box"], told("UNAVAILABLE"))
        .when(has["twister"], told("VARIATION_PARENT"))
        .when(has["book"], told("BOOK_OR_MEDIA"))
        .otherwise(told("STANDARD_PRODUCT"))
    )


def linked_price(linked: Column, market: Market) -> Column:
    """Minor units of the first offer of a page's linked data in the market's currency; such numbers have a decimal point in every market."""
    objects = F.from_json(linked, "array<struct<offers:string>>")
    offer = "struct<price:string,lowPrice:string,priceCurrency:string>"
    each = F.flatten(F.transform(F.filter(objects, lambda o: o["offers"].isNotNull()), lambda o: F.when(F.startswith(o["offers"], F.lit("[")), F.from_json(o["offers"], f"array<{offer}>")).otherwise(F.array(F.from_json(o["offers"], offer)))))
    own = F.filter(each, lambda o: F.coalesce(o["priceCurrency"], F.lit(market.currency)) == market.currency)
    minor = F.transform(own, lambda o: F.floor(F.replace(F.coalesce(o["price"], o["lowPrice"]), F.lit(","), F.lit("")).try_cast("decimal(30,6)") * 100 + F.lit(0.5).cast("decimal(2,1)")).cast("long"))
    return F.get(F.filter(minor, lambda v: v.isNotNull()), 0)


def star_shares(rows: Column) -> Column:
    """Star to percent from the texts of a histogram's rows, null without any; of rows for one star the last counts."""
    read = F.transform(rows, lambda t: F.struct(F.regexp_extract(t, "([1-5])", 1).alias("star"), F.regexp_extract(t, "([0-9]{1,3})\\s*%", 1).try_cast("long").alias("share")))
    good = F.filter(read, lambda x: (x["star"] != "") & x["share"].between(0, 100))
    last = F.transform(F.array(*[F.lit(str(k)) for k in range(1, 6)]), lambda star: F.element_at(F.concat(F.array(F.lit(None).cast("struct<star:string,share:bigint>")), F.filter(good, lambda x: x["star"] == star)), -1))
    return F.when(F.size(good) > 0, F.map_from_entries(F.filter(last, lambda x: x.isNotNull())))


def identity(found: DataFrame, html: str | None = None) -> DataFrame:
    """found (with the identity fields and IDENTITY_STRINGS) with item_id, parent_item (null if the item itself) and brand's bare name."""
    item = F.coalesce(*[item_id(F.col(c)) for c in ("item", "item_script", "item_data") if c in found.columns])
    parent = F.coalesce(*[item_id(F.col(c)) for c in ("parent_script", "parent_input") if c in found.columns])
    found = found.withColumns({"item_id": item, "parent_item": parent, "brand": brand_name(F.col("brand"))})
    return found.withColumn("parent_item", F.when(~F.col("parent_item").eqNullSafe(F.col("item_id")), F.col("parent_item")))


def stock_block(found: DataFrame, market: Market) -> Column:
    """The availability struct from STOCK_FIELDS (what wasn't asked for is null).

    A known text decides; an unknown one is PARSER_MISS. Without a text a sold-out mark is OUT_OF_STOCK, and a page with a buy box or price but no place for
    availability at all is IN_STOCK; the rest is PARSER_MISS. The last few of a stock are in stock too.
    """
    own = lambda c: F.col(c) if c in found.columns else F.lit(None).cast("string")
    text, known = own("availability"), availability_state(own("availability"), market)
    state = (
        F.when(text.isNotNull(), F.coalesce(known, F.lit("UNKNOWN")))
        .when(own("sold_out_mark").isNotNull(), "OUT_OF_STOCK")
        .when(own("stock_box").isNull() & own("offer_box").isNotNull(), "IN_STOCK")
        .otherwise("UNKNOWN")
    )
    labels = LABELS[market.code]
    return F.struct(
        state.alias("state"), F.when(state != "UNKNOWN", state.isin("IN_STOCK", "LIMITED_STOCK")).alias("inStock"), text.alias("text"), F.when(state == "LIMITED_STOCK", own("stock_left")).alias("stockLeftText"),
        delivery_date(own("delivery")).alias("deliveryDate"), own("delivery").alias("deliveryText"), first_money(own("shipping"), market).alias("shippingPrice"),
        F.when(own("prime_badge").isNotNull(), True).when(own("delivery_box").isNotNull(), False).alias("primeEligible"),
        after_label(own("ships_from"), labels["ships_from"]).alias("shipsFrom"), after_label(own("sold_by"), labels["sold_by"]).alias("soldBy"),
        F.when(state != "UNKNOWN", "EXTRACTED").otherwise("PARSER_MISS").alias("status"),
    )


def rankings_block(market: Market) -> Column:
    """The rankings struct from RANK_BOXES and RANK_FIELDS: the first box that bears a rank label and has readable ranks; a label without any is PARSER_MISS, no label NOT_PRESENT."""
    labels = LABELS[market.code]
    sources = F.array(*[F.lit(x) for x in RANK_SOURCES])
    boxes = F.transform("rank_boxes", lambda t, i: F.struct(rank_lines(t, market.rank_join).alias("lines"), F.coalesce(first_label(t, labels["rank"]).isNotNull(), F.lit(False)).alias("labelled"), F.get(sources, i).alias("source")))
    labelled = F.filter(boxes, lambda b: b["labelled"])
    hit = F.get(F.filter(labelled, lambda b: F.size(b["lines"]) > 0), 0)
    raw = F.when(first_label(F.col("bought"), labels["bought"]).isNotNull(), F.col("bought"))
    main = F.get(hit["lines"], 0)
    return F.struct(
        main["rank"].alias("mainBSR"), main["category"].alias("mainBSRCategory"), F.coalesce(hit["lines"], F.array()).alias("all"), raw.alias("boughtInPastMonthRaw"), demand(raw, market).alias("boughtInPastMonthMin"), hit["source"].alias("source"),
        F.when(hit.isNotNull(), "EXTRACTED").when(F.size(labelled) > 0, "PARSER_MISS").otherwise("NOT_PRESENT").alias("status"),
    )


def content_block() -> Column:
    """The content struct from CONTENT_FIELDS, CONTENT_LISTS and CONTENT_TABLES; bullets of one letter don't count."""
    bullets = F.filter("bullets", lambda b: F.length(b) > 1)
    some = (F.size(bullets) > 0) | F.col("description").isNotNull() | (F.size("specs") > 0) | (F.size("breadcrumb") > 0)
    return F.struct(
        bullets.alias("bullets"), "description", F.col("specs").alias("specifications"), F.col("technical").alias("technicalDetails"), *[lookup_label(F.col("specs"), v).alias(k) for k, v in CONTENT_LABELS.items()],
        "breadcrumb", F.col("rich").isNotNull().alias("richContent"), "badges", F.when(some, "EXTRACTED").otherwise("PARSER_MISS").alias("status"),
    )


def product_fields(blocks) -> dict:
    """The fields that some of the blocks pricing, availability and ratings need, beside those of the identity."""
    wanted, out = set(blocks), dict(IDENTITY_FIELDS)
    if "pricing" in wanted:
        out |= PRICE_FIELDS
    if wanted & {"pricing", "availability"}:  # a price that is missing is no miss where the item is sold out
        out |= STOCK_FIELDS
    return out | (RATING_FIELDS if "ratings" in wanted else {})


def product_blocks(found: DataFrame, market: Market) -> DataFrame:
    """Typed blocks from the texts of PRODUCT_FIELDS (also stars and linked, where they were asked for), each with its status.

    The price is the first that can be read of the displayed, the deal's, the buy box's and the linked data's one, and
    priceSource names it. Without any, pricing is OUT_OF_STOCK if the page says so, else PARSER_MISS; a list price counts only above the
    price. Availability: see stock_block. Ratings without a number are PARSER_MISS where the page has a section for them.
    """
    sources = {"CORE_PRICE_DISPLAY": "price", "DEAL_PRICE": "deal_price", "BUY_BOX": "buybox_price"}
    there = set(found.columns)
    own = lambda c, kind="string": F.col(c) if c in there else F.lit(None).cast(kind)
    texts = {"__listed": "list_price", "__subscribe": "subscribe"} | {f"__{k}": v for k, v in sources.items()}
    found = found.withColumns({k: first_money(F.col(v), market) if v in there else F.lit(None).cast("long") for k, v in texts.items()} | {
        "__JSON_LD": linked_price(F.col("linked"), market) if "linked" in there else F.lit(None).cast("long"),
        "stock": stock_block(found, market),
        "__scored": rating(F.coalesce(own("rating"), own("rating_text")), market), "__counted": count(own("reviews"), market),
    })
    names = [*sources, "JSON_LD"]
    found = found.withColumn("__hit", F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), F.struct(F.col(f"__{n}").alias("minor"), F.lit(n).alias("source"))) for n in names]))
    price, listed = F.col("__hit.minor"), F.col("__listed")
    above = F.when(listed > price, listed)
    sold_out = (F.col("stock.state") == "OUT_OF_STOCK") | own("sold_out_mark").isNotNull()
    section = F.coalesce(own("review_section"), own("rating")).isNotNull()
    scored, counted = F.col("__scored"), F.col("__counted")
    return found.withColumns({
        "title": clean_text(F.col("title")),
        "pricing": F.struct(
            price.alias("currentPrice"), F.coalesce(above, F.when(price.isNull(), listed)).alias("listPrice"), (above - price).alias("discountAmount"), F.lit(market.currency).alias("currency"),
            F.when(F.col("__hit.source") == "DEAL_PRICE", price).alias("dealPrice"), F.col("__subscribe").alias("subscribeAndSave"), own("deal_badge").alias("dealType"), own("unit_price").alias("unitPrice"),
            F.col("__hit.source").alias("priceSource"), coupon(own("coupon"), market).alias("coupon"),
            F.when(price.isNotNull(), "EXTRACTED").when(sold_out, "OUT_OF_STOCK").otherwise("PARSER_MISS").alias("status"),
        ),
        "ratings": F.struct(scored.alias("rating"), counted.alias("reviewCount"), (star_shares(F.col("stars")) if "stars" in there else F.lit(None).cast("map<string,bigint>")).alias("starDistribution"),
                            F.when(scored.isNotNull() | counted.isNotNull(), "EXTRACTED").when(section, "PARSER_MISS").otherwise("NOT_PRESENT").alias("status")),
    }).drop("__hit", "__listed", "__subscribe", "__scored", "__counted", *[f"__{n}" for n in names])
