"""Queries of the page operators: pages are written from table rows, parsed, typed, and held against the rows they came from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlake.functions.markets import MARKETS
from merchlake.operators import details, discover, extract, plan
from merchlake.plans import listing
from merchlake.plans.queries_scalar import _cents, _shown
from merchlake.plans.registry import query, table
from merchlake.sources.tables import CAPTURES

US = MARKETS["US"]
ITEM_SQL = "'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')"
CENTS_SQL = "CAST(round(p_retailprice * 100) AS BIGINT)"


def _item() -> Column:
    return F.concat(F.lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))


def _page(*parts) -> Column:
    """A page's markup; a part that is null leaves its element out."""
    return F.concat(F.lit("<html><body>"), *[F.coalesce(p if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts], F.lit("</body></html>"))


def _put(pattern: str, *values: Column) -> Column:
    """pattern with %s for the values; null if one is null."""
    filled, pieces = [], pattern.split("%s")
    for k, piece in enumerate(pieces):
        filled.append(F.lit(piece))
        if k < len(pieces) - 1:
            filled.append(values[k].cast("string"))
    return F.concat(*filled)


def _dealt(spark, sf, name, key):
    """Rows of a table dealt out by key: small rows become large pages, and a small file is one split, so that one task would read all pages.

    The number of parts is given, as adaptive execution would join parts by the size of the rows, not of the pages.
    """
    return table(spark, sf, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def _parts(spark, sf):
    cents = _cents(F.col("p_retailprice"))
    return _dealt(spark, sf, "part", "p_partkey").withColumns({"cents": cents, "kind": F.col("p_size") % 6, "shown": _shown(cents, US), "list_shown": _shown(cents + F.col("p_size") * 7 - 100, US)})


_CORE = '<div id="corePriceDisplay_desktop_feature_div"><span class="priceToPay"><span class="a-offscreen">%s</span></span></div>'
_LIST = '<div id="apex_desktop"><span data-a-strike="true"><span class="a-offscreen">%s</span></span></div>'


def _priced(spark, sf):
    k, shown = F.col("kind"), F.col("shown")
    number = F.format_string("%.2f", F.col("p_retailprice"))
    html = _page(
        F.when(k == 0, F.concat(_put(_CORE, shown), _put(_LIST, F.col("list_shown")))),
        F.when(k == 1, F.concat(_put('<span id="priceblock_dealprice">Deal: %s</span>', shown), F.lit('<span id="dealBadge">Lightning deal</span>'))),
        F.when(k == 2, F.concat(_put('<span id="price_inside_buybox">%s</span>', shown), _put('<label id="couponText1">Apply %s%% coupon</label>', F.col("p_size")))),
        F.when(k == 3, F.concat(_put('<script type="application/ld+json">[{"@type": "Thing"}, {"offers": [{"price": "1", "priceCurrency": "XXX"}, {"price": %s, "priceCurrency": "USD"}]}]</script>', number), _put('<span id="couponTextpctch">Save %s now</span>', F.col("list_shown")))),
        F.when(k == 4, F.lit('<div id="availability"><span>Currently unavailable.</span></div>')),
        F.when(k == 5, F.lit("<p>no price here, $5 off elsewhere</p>")),
    )
    found = extract.extract_fields(_parts(spark, sf).select("p_partkey", html.alias("html")), extract.product_fields(["pricing"]), linked="linked")
    return extract.product_blocks(found, US)


@query("product_pricing", f"""WITH p AS (SELECT p_partkey, p_size % 6 AS k, p_size, {CENTS_SQL} AS c FROM part)
  SELECT p_partkey, CASE WHEN k < 4 THEN c END AS minor, CASE WHEN k = 0 AND p_size * 7 > 100 THEN c + p_size * 7 - 100 END AS listed, CASE k WHEN 0 THEN 'CORE_PRICE_DISPLAY' WHEN 1 THEN 'DEAL_PRICE' WHEN 2 THEN 'BUY_BOX' WHEN 3 THEN 'JSON_LD' END AS source,
  CASE WHEN k = 1 THEN c END AS deal, CASE WHEN k = 1 THEN 'Lightning deal' END AS deal_type, CASE k WHEN 2 THEN 'PERCENT' WHEN 3 THEN 'AMOUNT' END AS coupon, CASE WHEN k = 2 THEN p_size END AS coupon_percent,
  CASE WHEN k = 3 THEN c + p_size * 7 - 100 END AS coupon_minor, CASE WHEN k < 4 THEN 'EXTRACTED' WHEN k = 4 THEN 'OUT_OF_STOCK' ELSE 'PARSER_MISS' END AS status FROM p""")
def product_pricing(spark, sf):
    p = F.col("pricing")
    return _priced(spark, sf).select("p_partkey", p["currentPrice"].alias("minor"), F.when(p["currentPrice"].isNotNull(), p["listPrice"]).alias("listed"), p["priceSource"].alias("source"), p["dealPrice"].alias("deal"), p["dealType"].alias("deal_type"),
                                     p["coupon"]["type"].alias("coupon"), p["coupon"]["percent"].alias("coupon_percent"), p["coupon"]["minor"].alias("coupon_minor"), p["status"].alias("status"))


@query("product_ratings", """SELECT p_partkey, CASE WHEN k < 2 THEN p_size % 5 + (p_partkey % 10) / 10.0 END AS rating, CASE WHEN k = 0 OR k = 2 THEN p_partkey * 7 END AS reviews, CASE WHEN k = 0 THEN CAST(p_size AS BIGINT) END AS five, CASE WHEN k = 0 THEN CAST(100 - p_size AS BIGINT) END AS one,
  CASE WHEN k < 3 THEN 'EXTRACTED' WHEN k = 3 THEN 'PARSER_MISS' ELSE 'NOT_PRESENT' END AS status FROM (SELECT *, p_size % 5 AS k FROM part)""")
def product_ratings(spark, sf):
    k, five = F.col("p_size") % 5, F.col("p_size")
    stars = F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))
    html = _page(
        F.when(k == 0, _put('<span id="acrPopover" title="%s out of 5 stars"></span>', stars)), F.when(k == 1, _put('<div id="averageCustomerReviews"><span class="a-icon-alt">%s out of 5</span></div>', stars)),
        F.when(k.isin(0, 2), _put('<span id="acrCustomerReviewText">%s ratings</span>', F.format_number(F.col("p_partkey") * 7, 0))),
        F.when(k == 0, _put('<table id="histogramTable"><tr><td>5 star</td><td>%s%%</td></tr><tr><td>1 star</td><td>%s%%</td></tr></table>'.replace("%%", "%"), five, 100 - five)), F.when(k == 3, F.lit('<div id="averageCustomerReviews">none yet</div>')),
    )
    found = extract.extract_fields(_dealt(spark, sf, "part", "p_partkey").select("p_partkey", html.alias("html")), extract.product_fields(["ratings"]), extract.STARS)
    r = F.col("ratings")
    return extract.product_blocks(found, US).select("p_partkey", r["rating"].alias("rating"), r["reviewCount"].alias("reviews"), r["starDistribution"]["5"].alias("five"), r["starDistribution"]["1"].alias("one"), r["status"].alias("status"))


@query("product_identity", f"""SELECT p_partkey, {ITEM_SQL} AS item, CASE WHEN p_size % 3 = 0 THEN 'P' || lpad(CAST(p_size AS VARCHAR), 9, '0') END AS parent, replace(p_brand, '#', ' ') AS brand, 'Part ' || p_name AS title FROM part""")
def product_identity(spark, sf):
    k, brand = F.col("p_size") % 3, F.replace(F.col("p_brand"), F.lit("#"), F.lit(" "))
    parent = F.concat(F.lit("P"), F.lpad(F.col("p_size").cast("string"), 9, "0"))
    html = _page(
        _put('<span id="productTitle">  Part %s </span>', F.col("p_name")), F.when(k == 0, _put('<a id="bylineInfo">Visit the %s Store</a>', brand)).when(k == 1, _put('<a id="bylineInfo">Brand: %s</a>', brand)).otherwise(_put('<span id="brand">%s</span>', brand)),
        F.when(k == 0, _put('<input id="ASIN" value="%s"><script>var x = {"parentAsin": "%s"};</script>', F.lower(_item()), parent)).when(k == 1, _put("<script>currentAsin = '%s'; parentAsin = '%s';</script>", _item(), _item())).otherwise(_put('<div id="averageCustomerReviews" data-asin="%s"></div>', _item())),
    )
    found = extract.extract_fields(_dealt(spark, sf, "part", "p_partkey").select("p_partkey", html.alias("html")), extract.IDENTITY_FIELDS, strings=extract.IDENTITY_STRINGS)
    return extract.identity(found).select("p_partkey", F.col("item_id").alias("item"), F.col("parent_item").alias("parent"), "brand", "title")


#: Of page k: what it holds, then state, in stock, text, status as the rules have them.
_STOCKS = [
    ('<div id="availability"><span>In  Stock.</span></div>', "IN_STOCK", True, "In Stock.", "EXTRACTED"),
    ('<div id="availability"><span class="a-color-price">Only 3 left in stock</span></div>', "LIMITED_STOCK", True, "Only 3 left in stock", "EXTRACTED"),
    ('<div id="availability">Ask the shop</div>', "UNKNOWN", None, "Ask the shop", "PARSER_MISS"),
    ('<div id="outOfStock"></div>', "OUT_OF_STOCK", False, None, "EXTRACTED"),
    ('<div id="buybox"></div>', "IN_STOCK", True, None, "EXTRACTED"),
    ('<div id="availability"> </div><div id="buybox"></div>', "UNKNOWN", None, None, "PARSER_MISS"),
    ("<p>nothing</p>", "UNKNOWN", None, None, "PARSER_MISS"),
    ('<div id="availability"><b class="a-color-state">Pre-order now</b> In Stock.</div>', "PREORDER", False, "Pre-order now", "EXTRACTED"),
    ('<div id="outOfStock"><span class="a-color-price">Currently unavailable.</span></div>', "OUT_OF_STOCK", False, "Currently unavailable.", "EXTRACTED"),
]


def _stock_sql(column: int) -> str:
    told = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'"
    return "CASE p_size % 9 " + " ".join(f"WHEN {k} THEN {told(row[column])}" for k, row in enumerate(_STOCKS)) + " END"


@query("product_stock", f"""SELECT p_partkey, {_stock_sql(1)} AS state, {_stock_sql(2)} AS in_stock, {_stock_sql(3)} AS text, {_stock_sql(4)} AS status, CASE WHEN p_size % 9 = 1 THEN 'Only 3 left in stock' END AS stock_left,
  CASE WHEN p_partkey % 3 = 0 THEN TRUE WHEN p_partkey % 3 = 1 THEN FALSE END AS prime, CASE WHEN p_partkey % 3 = 1 THEN 499 + p_size END AS shipping, CASE WHEN p_partkey % 3 = 1 THEN 'Monday, March ' || (1 + p_size % 28) END AS delivery_date,
  CASE WHEN p_partkey % 2 = 0 THEN 'Shop ' || p_size END AS sold_by, CASE WHEN p_partkey % 2 = 0 THEN 'Depot ' || p_brand END AS ships_from FROM part""")
def product_stock(spark, sf):
    part = _parts(spark, sf)
    shipping = _shown(499 + F.col("p_size"), US)
    html = _page(
        F.get(F.array(*[F.lit(row[0]) for row in _STOCKS]), F.col("p_size") % 9), F.when(F.col("p_partkey") % 3 == 0, F.lit('<i class="a-icon-prime"></i>')),
        F.when(F.col("p_partkey") % 3 == 1, _put('<div id="deliveryBlockMessage">Get it <span class="a-text-bold">Monday, March %s</span> <span class="a-color-secondary">Delivery %s</span></div>', 1 + F.col("p_size") % 28, shipping)),
        F.when(F.col("p_partkey") % 2 == 0, _put('<div id="merchant-info">Sold by: Shop %s</div><div id="tabular-buybox"><span class="tabular-buybox-text" tabular-attribute-name="Ships from">Ships from Depot %s</span></div>', F.col("p_size"), F.col("p_brand"))),
    )
    found = extract.extract_fields(part.select("p_partkey", html.alias("html")), extract.STOCK_FIELDS)
    s = F.col("stock")
    return found.withColumn("stock", extract.stock_block(found, US)).select(
        "p_partkey", s["state"].alias("state"), s["inStock"].alias("in_stock"), s["text"].alias("text"), s["status"].alias("status"), s["stockLeftText"].alias("stock_left"), s["primeEligible"].alias("prime"), s["shippingPrice"].alias("shipping"),
        s["deliveryDate"].alias("delivery_date"), s["soldBy"].alias("sold_by"), s["shipsFrom"].alias("ships_from"))


@query("product_rankings", """SELECT p_partkey, CASE WHEN k IN (0, 1) THEN CAST(p_partkey AS BIGINT) END AS rank, CASE WHEN k IN (0, 1) THEN p_type END AS category, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS ranks,
  CASE k WHEN 0 THEN 'DETAIL_BULLETS' WHEN 1 THEN 'PRODUCT_INFORMATION' END AS source, CASE WHEN k IN (0, 1) THEN 'EXTRACTED' WHEN k = 2 THEN 'PARSER_MISS' ELSE 'NOT_PRESENT' END AS status, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1000 END AS bought
  FROM (SELECT *, p_size % 5 AS k FROM part)""")
def product_rankings(spark, sf):
    k, n = F.col("p_size") % 5, F.format_number("p_partkey", 0)
    html = _page(
        F.when(k == 0, _put('<table id="productDetails_detailBullets_sections1"><tr><th>Weight</th><td>#7 in boxes</td></tr></table><div id="detailBullets_feature_div">Best Sellers Rank: #%s in %s (See Top 100) #5 in Parts</div>', n, F.col("p_type"))),
        F.when(k == 1, _put('<div id="detailBulletsWrapper_feature_div">Best Sellers Rank: none yet</div><div id="SalesRank">Amazon Best Sellers Rank #%s in %s (See Top 100)</div>', n, F.col("p_type"))),
        F.when(k == 2, F.lit('<div id="SalesRank">Best Sellers Rank: soon</div>')), F.when(k == 3, F.lit('<div id="SalesRank">#12 in Toys</div>')),
        F.when(F.col("p_partkey") % 2 == 0, _put('<span class="social-proofing-faceout-title-text">%sK+ bought in past month</span>', F.col("p_size"))).otherwise(F.lit('<span class="social-proofing-faceout-title-text">5K+ views</span>')),
    )
    found = extract.extract_fields(_dealt(spark, sf, "part", "p_partkey").select("p_partkey", html.alias("html")), extract.RANK_FIELDS, boxes=extract.RANK_BOXES)
    r = F.col("r")
    return found.withColumn("r", extract.rankings_block(US)).select("p_partkey", r["mainBSR"].alias("rank"), r["mainBSRCategory"].alias("category"), F.size(r["all"]).alias("ranks"), r["source"].alias("source"), r["status"].alias("status"), r["boughtInPastMonthMin"].cast("int").alias("bought"))


@query("product_content", """SELECT p_partkey, CASE WHEN k < 2 THEN 2 ELSE 0 END AS bullets, CASE WHEN k = 0 THEN p_name END AS description, CASE WHEN k < 2 THEN p_brand END AS manufacturer, CASE WHEN k < 2 THEN 'M' || p_size END AS model, CASE WHEN k < 2 THEN 'P' || p_partkey END AS part_number,
  CASE WHEN k < 2 THEN p_type END AS product_type, CASE WHEN k < 2 THEN p_name END AS dimensions, CASE WHEN k < 2 THEN 'box' END AS package, CASE WHEN k < 2 THEN p_size || ' g' END AS weight, CASE WHEN k < 2 THEN 'May 1' END AS first_available, CASE WHEN k < 2 THEN 8 ELSE 0 END AS technical,
  CASE WHEN k = 0 THEN 'Climate,Best' ELSE '' END AS badges, k = 0 AS rich, CASE WHEN k < 3 THEN 'EXTRACTED' ELSE 'PARSER_MISS' END AS status FROM (SELECT *, p_size % 4 AS k FROM part)""")
def product_content(spark, sf):
    k = F.col("p_size") % 4
    rows = "".join(f"<tr><th>{t}</th><td>%s</td></tr>" for t in ("Manufacturer", "Item model number", "Part Number", "Product type", "Product Dimensions", "Package Dimensions", "Item Weight", "Date First Available"))
    values = [F.col("p_brand"), F.concat(F.lit("M"), F.col("p_size")), F.concat(F.lit("P"), F.col("p_partkey")), F.col("p_type"), F.col("p_name"), F.lit("box"), F.concat(F.col("p_size").cast("string"), F.lit(" g")), F.lit("May 1")]
    html = _page(
        F.when(k < 2, _put('<div id="feature-bullets"><ul><li><span class="a-list-item">first</span></li><li><span class="a-list-item">x</span></li><li class="aok-hidden"><span class="a-list-item">hidden</span></li><li><span class="a-list-item">second</span></li></ul></div>'
                           f'<table id="productDetails_techSpec_section_1">{rows}</table>', *values)),
        F.when(k == 0, _put('<div id="productDescription"><p> </p><p>%s</p></div><div id="aplus"></div><div class="badge-wrapper"><i class="a-badge-text">Best</i></div><div id="climatePledgeFriendlyBadge">Climate</div>', F.col("p_name"))),
        F.when(k == 2, F.lit('<div id="wayfinding-breadcrumbs_feature_div"><ul><li><a>Home</a></li></ul></div>')),
    )
    found = extract.extract_fields(_dealt(spark, sf, "part", "p_partkey").select("p_partkey", html.alias("html")), extract.CONTENT_FIELDS, extract.CONTENT_LISTS, extract.CONTENT_TABLES)
    c = F.col("c")
    named = {"description": "description", "manufacturer": "manufacturer", "model": "model", "part_number": "partNumber", "product_type": "productType", "dimensions": "dimensions", "package": "packageDimensions", "weight": "weight", "first_available": "dateFirstAvailable", "rich": "richContent", "status": "status"}
    return found.withColumn("c", extract.content_block()).select("p_partkey", F.size(c["bullets"]).alias("bullets"), F.size(c["technicalDetails"]).alias("technical"), F.array_join(c["badges"], ",").alias("badges"), *[c[v].alias(n) for n, v in named.items()])


@query("buybox_pages", f"""SELECT p_partkey, k < 2 AS present, CASE WHEN k < 2 THEN p_mfgr_like END AS seller, CASE WHEN k < 2 THEN 'SELLER' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS seller_id, CASE WHEN k = 0 THEN {CENTS_SQL} END AS minor,
  CASE k WHEN 0 THEN 'FBA' WHEN 1 THEN 'FBM' ELSE 'UNKNOWN' END AS fulfillment, CASE WHEN k < 2 THEN 'EXTRACTED' WHEN k = 2 THEN 'PARSER_MISS' ELSE 'NOT_PRESENT' END AS status FROM (SELECT *, p_size % 4 AS k, 'Shop ' || p_size AS p_mfgr_like FROM part)""")
def buybox_pages(spark, sf):
    k = F.col("p_size") % 4
    seller = _put('<div id="merchant-info">Sold by <a href="/sp?seller=SELLER%s&x=1">Sold by: Shop %s</a></div>', F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.col("p_size"))
    html = _page(
        F.when(k < 3, F.lit('<div id="buybox">')), F.when(k == 0, _put('<span id="price_inside_buybox">%s</span>', F.col("shown"))), F.when(k < 2, seller),
        F.when(k == 0, F.lit('<div id="fulfillerInfoFeature_feature_div"><span class="offer-display-feature-text-message">Big Store</span></div>')), F.when(k < 3, F.lit("</div>")),
    )
    found = extract.extract_fields(_parts(spark, sf).select("p_partkey", html.alias("html")), details.BUYBOX_FIELDS)
    b = F.col("buybox")
    return details.buybox(found, US, ["big store"]).select("p_partkey", b["present"].alias("present"), b["seller"].alias("seller"), b["sellerId"].alias("seller_id"), b["price"].alias("minor"), b["fulfillment"].alias("fulfillment"), b["status"].alias("status"))


def _variant_item(n) -> Column:
    return F.concat(F.lit("V"), F.lpad(n.cast("string"), 9, "0"))


@query("variant_pages", """SELECT p_partkey, CASE WHEN k = 0 THEN 'Color|Size' WHEN k = 1 THEN 'Color|Option 2' ELSE '' END AS dimensions, CASE WHEN k < 2 THEN 'V' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS first_item,
  CASE WHEN k < 2 THEN p_type END AS first_value, CASE WHEN k < 2 THEN 1 ELSE 0 END AS items, k < 2 AS truncated, CASE WHEN k < 2 THEN 'EXTRACTED' WHEN k = 2 THEN 'PARSER_MISS' ELSE 'NOT_PRESENT' END AS status FROM (SELECT *, p_size % 4 AS k FROM part)""")
def variant_pages(spark, sf):
    k = F.col("p_size") % 4
    matrix = _put('{"%s": ["x", "S"], "%s": ["%s", "M"], "bad": ["y"]}', _variant_item(F.col("p_partkey") + 1), _variant_item(F.col("p_partkey")), F.col("p_type"))
    html = _page(
        F.when(k == 0, _put('<script>var d = {"dimensionValuesDisplayData": %s, "dimensionsDisplay": ["Color", "Size"]};</script>', matrix)),
        F.when(k == 1, _put('<script>d = {"dimensionValuesDisplayData": %s, "dimensions": ["color_name"]};</script>', matrix)), F.when(k == 2, F.lit('<div id="twister"></div>')),
    )
    found = details.variants(_dealt(spark, sf, "part", "p_partkey").select("p_partkey", html.alias("html")), "p_partkey", most=1)
    first = F.get("items", 0)
    return found.select("p_partkey", F.array_join("dimensions", "|").alias("dimensions"), first["item"].alias("first_item"), F.get(F.map_values(first["options"]), 0).alias("first_value"), F.size("items").alias("items"), "truncated", "status")


@query("variant_swatches", """SELECT p_partkey, 'Color,Size Name' AS dimensions, 2 AS items, 'V' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS first_item, p_type AS color, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_size % 2 = 0""")
def variant_swatches(spark, sf):
    one, two = _variant_item(F.col("p_partkey")), _variant_item(F.col("p_partkey") + 1)
    html = _page(F.when(F.col("p_size") % 2 == 0, _put(
        '<div id="variation_color_name"><label class="a-form-label">Color:</label><ul><li data-defaultasin="%s"><span class="a-button-text">%s</span></li><li data-defaultasin="%s" title="Click to select other"></li></ul></div>'
        '<div id="variation_size_name_x"><ul><li data-dp-url="/dp/%s/x" title="Click to select %s"></li><li data-defaultasin="bad" title="z"></li></ul></div>', one, F.col("p_type"), two, one, F.col("p_size"))))  # fmt: skip
    found = details.swatch_variants(_dealt(spark, sf, "part", "p_partkey").select("p_partkey", html.alias("html")), "p_partkey")
    first = F.get("items", 0)
    return found.select("p_partkey", F.array_join(F.transform("dimensions", lambda d: F.regexp_replace(d, " X$", "")), ",").alias("dimensions"), F.size("items").alias("items"), first["item"].alias("first_item"), first["options"]["Color"].alias("color"), first["options"]["Size Name X"].alias("size"))


@query("drawn_variants", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Color,Size Name' WHEN 1 THEN 'Color' ELSE '' END AS dimensions, CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS items, CASE WHEN p_size % 3 < 2 THEN 'V' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS first_item,
  CASE WHEN p_size % 3 < 2 THEN p_type END AS color, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS size, CASE p_size % 3 WHEN 2 THEN 'PARSER_MISS' ELSE 'EXTRACTED' END AS status FROM part""")
def drawn_variants(spark, sf):
    """Variants of both layouts through one page function: swatches, the matrix, and a twister without either."""
    one, two, k = _variant_item(F.col("p_partkey")), _variant_item(F.col("p_partkey") + 1), F.col("p_size") % 3
    html = _page(
        F.when(k == 0, _put('<div id="variation_color_name"><label class="a-form-label">Color:</label><ul><li data-defaultasin="%s"><span class="a-button-text">old</span></li><li data-defaultasin="%s"><span class="a-button-text">%s</span></li><li data-defaultasin="%s" title="Click to select other"></li></ul></div>'
                            '<div id="variation_size_name"><ul><li data-dp-url="/dp/%s/x" title="Click to select %s"></li><li data-defaultasin="bad" title="z"></li></ul></div>', one, one, F.col("p_type"), two, one, F.col("p_size"))),
        F.when(k == 1, _put('<script>d = {"dimensionValuesDisplayData": {"%s": ["%s"]}, "dimensionsDisplay": ["Color"]};</script><div id="variation_color"><ul><li data-defaultasin="%s" title="drawn"></li></ul></div>', one, F.col("p_type"), two)),
        F.when(k == 2, F.lit('<div id="twister"><div class="a-row"></div></div>')),
    )
    found = details.all_variants(_dealt(spark, sf, "part", "p_partkey").select("p_partkey", html.alias("html")), "p_partkey")
    first = F.get("items", 0)
    return found.select("p_partkey", F.array_join(F.transform("dimensions", lambda d: F.when(d == "Size", "Size Name").otherwise(d)), ",").alias("dimensions"), F.size("items").alias("items"), first["item"].alias("first_item"), F.try_element_at(first["options"], F.lit("Color")).alias("color"), F.try_element_at(first["options"], F.lit("Size")).alias("size"), "status")


@query("media_pages", """SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN NULL ELSE 'https://i.example/' || p_partkey || '.jpg' END AS main, CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS images, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS videos, CASE WHEN p_size % 4 < 3 THEN 'EXTRACTED' ELSE 'PARSER_MISS' END AS status FROM part""")
def media_pages(spark, sf):
    k, n = F.col("p_size") % 4, F.col("p_partkey")
    html = _page(
        F.when(k == 0, _put('<script>x = {"colorImages": {"initial": [{"hiRes": "https://i.example/%s._SL1500_.jpg"}, {"hiRes": null, "large": "https://i.example/b%s.jpg"}]}, "videos": [{"url": "https://v.example/%s"}]};</script>', n, n, n)),
        F.when(k == 1, _put("<img id=\"landingImage\" src=\"https://i.example/z%s.jpg\" data-a-dynamic-image='{\"https://i.example/s%s.jpg\": [10, 10], \"https://i.example/%s.jpg\": [90, 90]}'>", n, n, n)),
        F.when(k == 2, _put('<div id="altImages"><ul><li><img src="https://i.example/%s._AC_US40_.jpg"></li><li><img src="data:none"></li></ul></div>', n)),
    )
    return details.media(_dealt(spark, sf, "part", "p_partkey").select("p_partkey", html.alias("html")), "p_partkey").select("p_partkey", F.col("mainImage").alias("main"), F.size("images").alias("images"), F.size("videos").alias("videos"), "status")


_OFFERS_SQL = """o AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS minor, l_suppkey % 3 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, round(l_extendedprice * 100), l_partkey) AS place FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey, minor ORDER BY place) AS again FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS n, count(*) OVER (PARTITION BY l_orderkey) AS total FROM d WHERE again = 1)"""


@query("offer_pages", f"WITH {_OFFERS_SQL} SELECT l_orderkey, max(total) AS total, CAST(count(*) FILTER (n <= 3) AS INTEGER) AS items, max(total) > 3 AS truncated, max(CASE WHEN n = 1 THEN 'Shop ' || l_suppkey END) AS seller, max(CASE WHEN n = 1 THEN minor END) AS minor, max(CASE WHEN n = 1 THEN CASE k WHEN 0 THEN minor WHEN 1 THEN minor + 499 END END) AS landed, 'EXTRACTED' AS status FROM r GROUP BY l_orderkey")
def offer_pages(spark, sf):
    def one(line):  # written when the lines of a page are together, so that only numbers are gathered
        k = line["l_suppkey"] % 3
        more = F.when(k == 0, F.lit("FREE Shipping")).when(k == 1, F.lit('<div id="aod-offer-shipping-price"><span class="a-offscreen">$4.99</span></div>')).otherwise("")
        return _put('<div id="aod-offer"><div id="aod-offer-heading">New</div><span class="a-price"><span class="a-offscreen">%s</span></span><div id="aod-offer-soldBy"><a href="/sp?seller=SHOP%s">Shop %s</a></div>%s</div>', _shown(line["c"], US), F.lpad(line["l_suppkey"].cast("string"), 8, "0"), line["l_suppkey"], more)

    lines = F.collect_list(F.struct("l_linenumber", "l_suppkey", _cents(F.col("l_extendedprice")).alias("c"), "l_partkey"))
    listed = _dealt(spark, sf, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(lines), one), "").alias("all"))
    found = details.offers(listed.select("l_orderkey", _page('<div id="aod-container">', F.col("all"), "</div>").alias("html")), US, "l_orderkey", 3, ["big store"])
    first = F.get("items", 0)
    return found.select("l_orderkey", "total", F.size("items").alias("items"), "truncated", first["seller"].alias("seller"), first["price"].alias("minor"), first["landed"].alias("landed"), "status")


@query("seller_pages", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 4 THEN s_name END AS name, CASE WHEN s_suppkey % 5 < 4 THEN s_name || ' Ltd' END AS business, CASE WHEN s_suppkey % 5 < 4 THEN CAST(s_suppkey % 101 AS DOUBLE) END AS rating, CASE WHEN s_suppkey % 5 < 4 THEN s_suppkey * 11 END AS feedback,
  CASE WHEN s_suppkey % 5 < 4 THEN CAST(s_suppkey % 7 AS DOUBLE) END AS negative, CASE WHEN s_suppkey % 5 < 4 THEN 'V' || s_nationkey END AS vat, CASE WHEN s_suppkey % 5 < 4 THEN 'EXTRACTED' ELSE 'PARSER_MISS' END AS status FROM supplier""")
def seller_pages(spark, sf):
    s = F.col("s_suppkey")
    html = _page(F.when(s % 5 < 4, _put(
        '<h1 id="sellerName"> %s </h1><div id="seller-feedback-summary">%s% positive in the last 12 months (%s ratings) (%s)</div><div data-feedback-window="30">90% positive 4% neutral %s% negative (50)</div>'
        '<div id="page-section-detail-seller-info"><ul><li><b>Business Name:</b> %s Ltd</li><li><b>VAT number:</b> V%s</li></ul></div>',
        F.col("s_name"), s % 101, s, F.format_number(s * 11, 0), s % 7, F.col("s_name"), F.col("s_nationkey"))))
    found = details.seller_profiles(_dealt(spark, sf, "supplier", "s_suppkey").select("s_suppkey", html.alias("html")), US, "s_suppkey")
    return found.select("s_suppkey", F.col("sellerName").alias("name"), F.col("businessName").alias("business"), "rating", F.col("feedbackCount").alias("feedback"), F.col("feedback30Days.negativePercent").alias("negative"), F.get(F.map_values("legalIdentifiers"), 0).alias("vat"), "status")


def _captures(frame, **given):
    """frame's columns as captures, others as given or null."""
    return frame.select(*[(given[f.name] if f.name in given else F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CAPTURES])


@query("search_pages", """WITH c AS (SELECT p_partkey, p_size, p_brand, p_partkey % 9 AS page, row_number() OVER (PARTITION BY src, p_partkey % 9 ORDER BY p_partkey) AS place, CAST(round(p_retailprice * 100) AS BIGINT) / 100.0 AS price, src FROM (SELECT *, p_brand || ' ' || (p_partkey // 400) AS src FROM part)),
s AS (SELECT src, page, count(*) AS cards FROM c GROUP BY 1, 2), stop AS (SELECT src, page, coalesce(sum(CASE WHEN cards < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM s),
r AS (SELECT c.* FROM c JOIN stop USING (src, page) WHERE n = 0 AND page <= 5)
SELECT p_partkey, CAST(place AS INTEGER) AS place, count(*) OVER (PARTITION BY src ORDER BY page, place ROWS UNBOUNDED PRECEDING) AS position, price, p_size % 3 = 0 AS prime, CAST(place + (page - 1) * 16 AS BIGINT) AS fixed_position,
  concat_ws(',', CASE WHEN price > 1500 THEN 'PRICE_ABOVE_MAX' END, CASE WHEN p_size % 3 <> 0 THEN 'NOT_PRIME' END) AS reasons FROM r""")
def search_pages(spark, sf):
    part = _parts(spark, sf).withColumn("page", (F.col("p_partkey") % 9).cast("int"))
    card = _put('<div class="s-result-item" data-asin="%s"><h2>%s</h2><span class="a-price"><span class="a-offscreen">%s</span></span>%s</div>', _item(), F.col("p_name"), F.col("shown"), F.when(F.col("p_size") % 3 == 0, F.lit('<i aria-label="Prime"></i>')).otherwise(""))
    listed = part.groupBy(F.concat_ws(" ", "p_brand", F.floor(F.col("p_partkey") / 400)).alias("lookup_key"), "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", card.alias("c")))), lambda x: x["c"]), "").alias("cards"), F.count(F.lit(1)).alias("n"))
    caps = _captures(listed.withColumn("html", _page(F.col("cards"), F.when(F.col("n") >= 3, F.lit('<a class="s-pagination-next">Next</a>')).otherwise(F.lit('<a class="s-pagination-next s-pagination-disabled">Next</a>')))), label=F.lit("SEARCH"), market=F.lit("US"), ok=F.lit(True))
    found = listing.discover_items(caps, plan.check_options({"max_pages": 5, "filters": {"max_price": 1500, "prime_only": True}}))
    return found.select(F.substring("item", 2, 9).cast("long").alias("p_partkey"), "place", "position", "price", "prime", discover.fixed_position(F.col("page"), F.col("place")).alias("fixed_position"), F.array_join("reasons", ",").alias("reasons"))


def _full(spark, sf, profile="catalog"):
    k = F.col("p_size") % 2
    html = _page(_put('<span id="productTitle">%s</span>', F.col("p_name")), F.when(k == 0, _put(_CORE, F.col("shown"))), _put('<div id="SalesRank">Best Sellers Rank: #%s in %s (See Top 100)</div>', F.format_number("p_partkey", 0), F.col("p_type")), '<div id="availability"><span>In Stock.</span></div><div id="feature-bullets"><ul><li><span class="a-list-item">one</span></li><li><span class="a-list-item">two</span></li><li><span class="a-list-item">x</span></li></ul></div>')
    rows = _parts(spark, sf).select(_item().alias("lookup_key"), F.col("p_partkey").alias("seq"), html.alias("html"))
    return listing.full_records(_captures(rows, label=F.lit("PRODUCT"), market=F.lit("US"), ok=F.lit(True), received_at=F.timestamp_seconds(F.lit(86400))), plan.check_options({"profile": profile}), ("big store",))


@query("full_records", f"""SELECT {ITEM_SQL} AS item, p_name AS title, CASE WHEN p_size % 2 = 0 THEN CAST({CENTS_SQL} / 100 AS DOUBLE) END AS amount, CASE WHEN p_size % 2 = 0 THEN 'EXTRACTED' ELSE 'PARSER_MISS' END AS pricing, 'IN_STOCK' AS state, p_partkey AS rank, p_type AS category, 2 AS bullets,
  'PARSER_MISS' AS media, 'NOT_PRESENT' AS variants, 'NOT_APPLICABLE' AS offers, 'https://{US.host}/dp/' || {ITEM_SQL} AS url, 'product-detail' AS event, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'PRICE_PARSER_MISS' END AS warnings, CASE WHEN p_size % 2 = 0 THEN 100 ELSE 75 END AS score, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'price' END AS lacking FROM part""")
def full_records(spark, sf):
    return _full(spark, sf).select("item", "title", F.col("pricing.currentPrice.amount").cast("double").alias("amount"), F.col("pricing.status").alias("pricing"), F.col("availability.state").alias("state"), F.col("rankings.mainBSR").alias("rank"), F.col("rankings.mainBSRCategory").alias("category"),
                                   F.size("product.bullets").alias("bullets"), F.col("media.status").alias("media"), F.col("variants.status").alias("variants"), F.col("offers.status").alias("offers"), F.col("canonicalUrl").alias("url"), F.col("retrieval.billingEvent").alias("event"), F.array_join("quality.warnings", ",").alias("warnings"), F.col("quality.completenessScore").alias("score"), F.array_join("quality.criticalFieldsMissing", ",").alias("lacking"))


@query("profile_projection", "SELECT CASE WHEN p_size % 2 = 0 THEN 'EXTRACTED' ELSE 'PARSER_MISS' END AS pricing, 'NOT_APPLICABLE' AS media, 'NOT_APPLICABLE' AS rankings, count(*) AS items FROM part GROUP BY 1")
def profile_projection(spark, sf):
    return _full(spark, sf, "essential").groupBy(F.col("pricing.status").alias("pricing"), F.col("media.status").alias("media"), F.col("rankings.status").alias("rankings")).agg(F.count(F.lit(1)).alias("items"))


@query("script_values", "SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k, event_type AS kind, user_id % 3 AS linked FROM events")
def script_values(spark, sf):
    html = _page(_put("<script>var state = {data: %s, kind: '%s'};</script>", F.col("props"), F.col("event_type")), F.lit('<script type="application/ld+json">{broken</script>'),
                 F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < F.col("user_id") % 3, F.lit('<script type="application/ld+json">{"a": 1}</script>')).otherwise("")), ""))
    found = extract.extract_fields(_dealt(spark, sf, "events", "event_id").select("event_id", html.alias("html")), {}, blobs={"data": "data"}, strings={"kind": "kind"}, linked="ld")
    return found.select("event_id", F.get_json_object("data", "$.k").cast("long").alias("k"), "kind", F.size(F.from_json("ld", "array<map<string,string>>")).cast("long").alias("linked"))


@query("sanitized_pages", '''SELECT page_id, regexp_replace(regexp_replace(html, '[0-9]{5,}', 'N', 'g'), 'href="[^"]*"', 'href="#"', 'g') AS html FROM pages''')
def sanitized_pages(spark, sf):
    from merchlake.functions.text import sanitize_html

    return table(spark, sf, "pages").select("page_id", sanitize_html(F.col("html"), [("[0-9]{5,}", "N"), ('href="[^"]*"', 'href="#"')]).alias("html"))


@query("redacted_pages", """SELECT page_id, '<script>/* ue telemetry removed */</script><p>page ' || page_id || '</p>{"sessionId": "REDACTED", "keep": "k' || page_id || '"}<input name="csrfToken" type="hidden" value="REDACTED"><div data-csa-c-item-id="REDACTED" id="d' || page_id || '">REDACTED-SESSION-ID</div><span id="glow-ingress-line2">REDACTED LOCATION</span><a href="/dp/x?qid=REDACTED&tag=REDACTED&keep=' || page_id || '">' || url || '</a>' AS html FROM pages""")
def redacted_pages(spark, sf):
    from merchlake.functions.text import sanitize_html

    n = F.col("page_id")
    html = _put('<script type="x">var a = 1; ue_id = "X%s";</script><p>page %s</p>{"sessionId": "S%s", "keep": "k%s"}<input name="csrfToken" type="hidden" value="T%s"><div data-csa-c-item-id="I%s" id="d%s">123-1234567-%s</div><span id="glow-ingress-line2">Town %s</span><a href="/dp/x?qid=%s&tag=t%s&keep=%s">%s</a>',
                n, n, n, n, n, n, n, F.lpad(n.cast("string"), 7, "0"), n, n, n, n, F.col("url"))
    return table(spark, sf, "pages").select("page_id", sanitize_html(html).alias("html"))
