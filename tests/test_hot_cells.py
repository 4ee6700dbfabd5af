"""Cells with very many points: the pairs are the same, and many tasks make them."""

from pyspark.sql import functions as F

from corpuscle.operators import spatial, surface


def test_hot_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HOT_CELL", 300)
    monkeypatch.setattr(spatial, "PART", 100)
    points = spark.range(1200).select(F.lit("a").alias("path"), F.lit(0).alias("frame"), F.col("id").alias("idx"), F.lit("C").alias("element"), F.lit(1).alias("residue_id"), *(F.when(F.col("id") < 700, 0.5).otherwise((F.col("id") * k % 97) / 4.0).alias(c) for c, k in zip("xyz", (7, 13, 29))))
    points = points.union(points.limit(50).withColumn("path", F.lit("b"))).cache()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = points.select("path", "frame", "idx", "x", "y", "z")
        one, dealt = (spatial.cell_join(own, own, 2.0, condition=F.col("l_idx") < F.col("r_idx"), deal=d).cache() for d in (False, True))
        pairs = lambda df: df.select("path", "l_idx", "r_idx", "d2")
        assert one.count() == dealt.count() > 240_000 and pairs(one).exceptAll(pairs(dealt)).count() == 0
        tasks = lambda df: df.where("path = 'a' and l_idx < 700 and r_idx < 700").groupBy(F.spark_partition_id()).count().count()
        assert tasks(one) == 1 < tasks(dealt)
        far = points.where("idx > 900").select("path", "frame", "idx", "x", "y", "z")
        left = [spatial.cell_join(own, far, 1.0, how="left_anti", deal=d).select("path", "idx") for d in (False, True)]
        assert left[0].exceptAll(left[1]).count() == 0 == left[1].exceptAll(left[0]).count() and 0 < left[0].count() < points.count()
        areas = [r["area"] for r in surface.sasa(points.where("idx % 7 = 0"), points=12).orderBy("path", "idx").collect()]
        spark.conf.set(spatial.DEAL, "true")
        assert areas == [r["area"] for r in surface.sasa(points.where("idx % 7 = 0"), points=12).orderBy("path", "idx").collect()]
    finally:
        spark.conf.unset(spatial.DEAL)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
