"""Output records: the fixed nested schema, empty blocks, product and failure rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.5"

MONEY = "struct<amount:decimal(18,2),currency:string,raw:string>"
_CHANGE = "struct<type:string,field:string,before:string,after:string,percentChange:double>"
_WINDOW = "struct<positivePercent:double,neutralPercent:double,negativePercent:double,count:bigint>"
_OFFER = (
    f"struct<sellerId:string,sellerName:string,condition:string,itemPrice:{MONEY},shippingPrice:{MONEY},landedPrice:{MONEY},primeEligible:boolean,"
    "fulfillment:string,deliveryText:string,sellerRating:double,sellerFeedbackCount:bigint,sourceUrl:string,status:string>"
)
_SELLER = (
    "struct<sellerId:string,sellerName:string,businessName:string,businessAddress:string,rating:double,feedbackCount:bigint,"
    f"feedback30Days:{_WINDOW},feedback90Days:{_WINDOW},feedback365Days:{_WINDOW},legalIdentifiers:map<string,string>,sourceUrl:string,status:string>"
)
#: The blocks of a record, each with the status of its empty form.
BLOCKS = {
    "pricing": (f"struct<currentPrice:{MONEY},listPrice:{MONEY},discountAmount:{MONEY},dealPrice:{MONEY},subscribeAndSave:{MONEY},discountPercent:double,dealType:string,"
                f"unitPrice:string,priceSource:string,status:string,coupon:struct<text:string,type:string,percent:int,amount:{MONEY}>>", "PARSER_MISS"),
    "availability": (f"struct<state:string,inStock:boolean,availabilityText:string,stockLeftText:string,deliveryDate:string,deliveryText:string,shippingPrice:{MONEY},"
                     "primeEligible:boolean,shipsFrom:string,soldBy:string,status:string>", "PARSER_MISS"),
    "rankings": ("struct<mainBSR:bigint,mainBSRCategory:string,all:array<struct<rank:bigint,category:string>>,boughtInPastMonthRaw:string,boughtInPastMonthMin:bigint,source:string,status:string>", "NOT_PRESENT"),
    "ratings": ("struct<rating:double,reviewCount:bigint,starDistribution:map<string,bigint>,status:string>", "NOT_PRESENT"),
    "buyBox": (f"struct<present:boolean,seller:string,sellerId:string,price:{MONEY},shipsFrom:string,fulfillment:string,marketIsSeller:boolean,status:string>", "NOT_PRESENT"),
    "variants": (f"struct<mode:string,dimensions:array<string>,truncated:boolean,truncatedAt:int,status:string,items:array<struct<item:string,options:map<string,string>,price:{MONEY},availability:string,status:string>>>", "NOT_PRESENT"),
    "product": ("struct<bullets:array<string>,description:string,specifications:map<string,string>,technicalDetails:map<string,string>,manufacturer:string,model:string,partNumber:string,productType:string,"
                "breadcrumb:array<string>,dimensions:string,packageDimensions:string,weight:string,dateFirstAvailable:string,richContent:boolean,badges:array<string>,status:string>", "PARSER_MISS"),
    "media": ("struct<mainImage:string,images:array<string>,videos:array<string>,status:string>", "PARSER_MISS"),
    "offers": (f"struct<requested:boolean,totalCount:bigint,truncated:boolean,status:string,items:array<{_OFFER}>>", "NOT_APPLICABLE"),
    "sellerProfiles": (f"struct<requested:boolean,status:string,items:array<{_SELLER}>>", "NOT_APPLICABLE"),
    "monitoring": (f"struct<requested:boolean,compared:boolean,changed:boolean,previousDatasetId:string,previousScrapedAt:string,status:string,changes:array<{_CHANGE}>,warnings:array<string>>", "NOT_APPLICABLE"),
    "location": ("struct<requestedCountry:string,requestedPostalCode:string,resolvedPostalCode:string,applied:boolean,method:string,status:string>", "NOT_APPLICABLE"),
}
PLAIN = {
    "schemaVersion": "string", "status": "string", "scrapedAt": "timestamp", "input": "struct<type:string,value:string>", "marketplace": "string", "item": "string",
    "parentItem": "string", "canonicalUrl": "string", "title": "string", "brand": "string", "retrieval": "struct<profile:string,requestedBlocks:array<string>,billingEvent:string>",
    "sources": "map<string,string>",
    "quality": "struct<completenessScore:int,fetchAttempts:int,proxyTier:string,pageType:string,blocked:boolean,criticalFieldsMissing:array<string>,warnings:array<string>,parserVersion:string>",
    "discoveredFrom": "array<struct<type:string,value:string,page:int,position:int,pagePosition:int,sponsored:boolean,organicPosition:int,sponsoredPosition:int>>",
    "deprecations": "array<string>",
}
FAILURE = {
    "schemaVersion": "string", "status": "string", "scrapedAt": "timestamp", "input": "struct<type:string,value:string>", "marketplace": "string", "item": "string",
    "reason": "string", "message": "string", "retriesUsed": "int", "chargedProductEvent": "boolean",
}


def _schema(fields: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in fields.items()))


def product_schema() -> T.StructType:
    """The 27 columns of a product record (Spark's parser reads it, so a session must be there)."""
    return _schema({**PLAIN, **{b: t for b, (t, _) in BLOCKS.items()}})


def failure_schema() -> T.StructType:
    return _schema(FAILURE)


def _empty(kind: T.DataType, status: str) -> Column:
    """A struct of nulls (arrays: empty) with the status given."""
    parts = []
    for f in kind.fields:
        value = F.lit(status) if f.name == "status" else F.array() if isinstance(f.dataType, T.ArrayType) else F.lit(None)
        parts.append(value.cast(f.dataType).alias(f.name))
    return F.struct(*parts)


def empty_block(name: str, status: str | None = None) -> Column:
    return _empty(product_schema()[name].dataType, status or BLOCKS[name][1])


def _shaped(column: Column, given: T.DataType, wanted: T.DataType) -> Column:
    """column brought to the fields of a wanted struct (or array of structs): known ones cast, missing ones null."""
    if isinstance(wanted, T.ArrayType) and isinstance(given, T.ArrayType) and isinstance(wanted.elementType, T.StructType):
        return F.transform(column, lambda e: _shaped(e, given.elementType, wanted.elementType))
    if not isinstance(wanted, T.StructType) or not isinstance(given, T.StructType):
        return column.cast(wanted)
    names = set(given.names)
    whole = F.struct(*[(_shaped(column[f.name], given[f.name].dataType, f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields])
    return F.when(column.isNotNull(), whole)


def product_records(rows: DataFrame, wanted: tuple[str, ...] = tuple(BLOCKS)) -> DataFrame:
    """rows under product_schema(): columns by their names, missing blocks empty, blocks not wanted NOT_APPLICABLE.

    A block that isn't wanted is a constant, so its columns are never read.
    """
    out = []
    for f in product_schema().fields:
        there = f.name in rows.columns
        if f.name in BLOCKS and f.name not in wanted and f.name not in ("monitoring", "location"):
            column = empty_block(f.name, "NOT_APPLICABLE")
        elif f.name in BLOCKS:
            column = F.coalesce(_shaped(F.col(f.name), rows.schema[f.name].dataType, f.dataType), empty_block(f.name)) if there else empty_block(f.name)
        elif f.name == "schemaVersion":
            column = F.lit(SCHEMA_VERSION)
        elif f.name == "status":
            column = F.lit("SUCCESS")
        elif there:
            column = _shaped(F.col(f.name), rows.schema[f.name].dataType, f.dataType)
        else:
            column = (F.array() if isinstance(f.dataType, T.ArrayType) else F.lit(None)).cast(f.dataType)
        out.append(column.alias(f.name))
    return rows.select(*out)


def failure_records(rows: DataFrame) -> DataFrame:
    """rows (with status and reason) under failure_schema(); a failure is never charged."""
    fixed = {"schemaVersion": F.lit(SCHEMA_VERSION), "chargedProductEvent": F.lit(False)}
    return rows.select(*[(fixed.get(f.name) if f.name in fixed else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in failure_schema().fields])


def dataset(products: DataFrame, failures: DataFrame) -> DataFrame:
    """Products and failures as one set, told apart by status."""
    return products.unionByName(failures, allowMissingColumns=True)


def first_extracted(outcomes: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """(value, status) of the first strategy that is EXTRACTED; a definite state (out of stock, location) stops the search, else any miss is PARSER_MISS."""
    final = ("EXTRACTED", "OUT_OF_STOCK", "GEO_RESTRICTED", "REQUIRES_LOCATION")
    value = F.coalesce(*[F.when(s.isin(*final), F.struct(v.alias("v"), s.alias("s"))) for v, s in outcomes])
    missed = outcomes[0][1] == "PARSER_MISS"
    for _, s in outcomes[1:]:
        missed = missed | (s == "PARSER_MISS")
    return value["v"], F.coalesce(value["s"], F.when(missed, "PARSER_MISS").otherwise("NOT_PRESENT"))


def charges(records: DataFrame, event: str) -> DataFrame:
    """seq, event, units of each successful record: its base event, then offers, seller profiles and priced variants."""
    priced = F.size(F.filter(F.coalesce("variants.items", F.array()), lambda v: v["status"] == "EXTRACTED"))
    parts = F.array(
        F.struct(F.lit(event).alias("event"), F.lit(1).alias("units")),
        F.struct(F.lit("offer").alias("event"), F.coalesce(F.size("offers.items"), F.lit(0)).alias("units")),
        F.struct(F.lit("seller-detail").alias("event"), F.coalesce(F.size("sellerProfiles.items"), F.lit(0)).alias("units")),
        F.struct(F.lit("variant-detail").alias("event"), F.when(F.col("variants.mode") == "price", priced).otherwise(0).alias("units")),
    )
    asked = records.where(F.col("status") == "SUCCESS").select("seq", F.posexplode(F.filter(parts, lambda p: p["units"] > 0)).alias("part", "c"))
    return asked.select("seq", "part", "c.event", "c.units")
