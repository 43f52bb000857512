from pyspark.sql import functions as F

from merchlake.functions.text import location_verified
from merchlake.operators import records


def test_product_record_has_the_whole_shape(spark):
    rows = spark.range(1).select(
        F.lit("US").alias("marketplace"), F.lit("B000000001").alias("item"), F.struct(F.lit(3.5).alias("rating"), F.lit("EXTRACTED").alias("status")).alias("ratings"),
        F.struct(F.lit("x").alias("mainImage"), F.lit("EXTRACTED").alias("status")).alias("media"))
    out = records.product_records(rows, ("ratings", "pricing"))
    assert out.columns == records.product_schema().names and len(out.columns) == 27
    assert [f.dataType.simpleString() for f in out.schema] == [f.dataType.simpleString() for f in records.product_schema()]
    r = out.first()
    assert (r.ratings.rating, r.ratings.status, r.pricing.status, r.media.status, r.media.images, r.media.mainImage, r.status) == (3.5, "EXTRACTED", "PARSER_MISS", "NOT_APPLICABLE", [], None, "SUCCESS")
    bad = records.failure_records(spark.createDataFrame([("BLOCKED", "x")], "status string, reason string"))
    both = records.dataset(out, bad)
    assert both.count() == 2 and both.where("status = 'BLOCKED'").first().chargedProductEvent is False


def test_first_extracted(spark):
    rows = spark.createDataFrame([("PARSER_MISS", "EXTRACTED"), ("OUT_OF_STOCK", "EXTRACTED"), ("NOT_PRESENT", "NOT_PRESENT"), ("NOT_PRESENT", "PARSER_MISS")], "a string, b string")
    value, status = records.first_extracted([(F.lit(1), F.col("a")), (F.lit(2), F.col("b"))])
    assert [tuple(r) for r in rows.select(value, status).collect()] == [(2, "EXTRACTED"), (1, "OUT_OF_STOCK"), (None, "NOT_PRESENT"), (None, "PARSER_MISS")]


def test_charges(spark):
    out = records.product_records(spark.range(1).select(
        F.struct(F.lit("price").alias("mode"), F.array(F.struct(F.lit("A").alias("item"), F.create_map(F.lit("a"), F.lit("b")).alias("options"), F.lit(None).cast(records.MONEY).alias("price"), F.lit("x").alias("availability"), F.lit("EXTRACTED").alias("status"))).alias("items")).alias("variants")))
    got = records.charges(out.withColumn("seq", F.lit(1)), "product-detail").orderBy("part").collect()
    assert [(r.event, r.units) for r in got] == [("product-detail", 1), ("variant-detail", 1)]


def test_location(spark):
    rows = spark.createDataFrame([("Deliver to 10001", "10001"), ("Deliver to 10001", "10001-1234"), ("SW1A", "SW1A 1AA"), (None, "1")], "a string, b string")
    assert [r[0] for r in rows.select(location_verified(F.col("a"), F.col("b"))).collect()] == [True, True, False, None]
