"""Functions of SQL, and streams whose batches are split in any way."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import sql
from corpuscle.functions.selection import SelectionError, compile_selection
from corpuscle.operators import trajectory
from corpuscle.streaming import frames

SCHEMA = "frame int, idx bigint, type_id int, element string, x double, y double, z double, residue_id int, chain_id string, name string, resname string, id bigint"


@pytest.fixture(scope="module")
def system(spark):
    rng = random.Random(5)
    rows = [(f, i, i % 4, rng.choice(["C", "N", "cl", None]), rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(-5, 5), i // 3 if i % 7 else None, "AB"[i % 2], rng.choice(["CA", "N", "O'5", None]), rng.choice(["ALA", "HOH"]), i) for f in range(12) for i in range(9)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_selections_of_sql_equal_compiled_ones(spark, system):
    system.createOrReplaceTempView("atoms")
    for k, (text, dialect) in enumerate([("name == CA AND x > 0.5", "core"), ("NOT (element == C OR residue_id == 1) AND z <= 2", "core"), ("element == CL AND x == 1.77", "panel"), ("type == 2 OR chain_id != A", "core"), ("name == \"O'5\"", "core")]):
        used = sql.register_selection(spark, f"chosen_{k}", text, dialect)
        found = spark.sql(f"SELECT frame, idx FROM atoms WHERE chosen_{k}({', '.join(used)})")
        want = system.where(compile_selection(text, dialect=dialect)).select("frame", "idx")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    sql.register_selection(spark, "again", "named chosen", named={"chosen": F.col("y") > 1})
    assert spark.sql("SELECT again(y) AS a FROM VALUES (0.5D), (1.5D) AS t(y)").collect() == [(False,), (True,)]
    with pytest.raises(SelectionError):
        sql.register_selection(spark, "bad", "foobar == 1")
    with pytest.raises(ValueError, match="function name"):
        sql.register_selection(spark, "a b", "x > 1")


def test_aggregate_and_table_function(spark, system):
    sql.register(spark)
    system.createOrReplaceTempView("atoms")
    means = spark.sql("SELECT circular_mean(a) AS m FROM VALUES (1, 350D), (1, 20D), (2, 0D), (2, 180D), (3, NULL) AS t(k, a) GROUP BY k ORDER BY k").collect()
    assert means[0]["m"] == pytest.approx(5.0) and means[1]["m"] is None and means[2]["m"] is None
    shapes = spark.sql("SELECT * FROM frame_shape(TABLE (SELECT frame, x, y, z FROM atoms) PARTITION BY frame)").collect()
    assert len(shapes) == 12 and all(r["n"] == 9 and r["long"] >= r["middle"] >= r["short"] >= 0 and r["path"] is None for r in shapes)
    assert all(r["gyration"] ** 2 == pytest.approx(r["long"] ** 2 + r["middle"] ** 2 + r["short"] ** 2) for r in shapes)
    line = spark.sql("SELECT * FROM frame_shape(TABLE (SELECT 'a' AS path, 1 AS frame, v AS x, 0D AS y, 0D AS z FROM VALUES (-1D), (1D), (NULL) AS t(v)) PARTITION BY (path, frame))").first()
    assert (line["path"], line["n"], line["gyration"], line["long"], line["middle"]) == ("a", 2, 1.0, 1.0, 0.0)


def test_any_split_of_a_stream_gives_the_batch_result(spark, system, tmp_path):
    rows = system.select("frame", "residue_id", "idx", "x", "y", "z")
    schema = "frame int, residue_id int, idx bigint, x double, y double, z double"
    want = {r["idx"]: r["rmsf"] for r in trajectory.rmsf(rows).collect()}
    for name, cuts in (("one", [range(12)]), ("three", [range(5), range(5, 6), range(6, 12)])):
        source, out, kept = (f"{tmp_path}/{name}-{x}" for x in ("in", "out", "state"))
        for part in cuts:  # each start goes on from what the one before it kept
            rows.where(F.col("frame").isin(*part)).repartition(2, "frame").write.mode("append").parquet(source)
            frames.stream_rmsf(spark, source, schema, out, kept, files=1, once=True).awaitTermination()
        found = {r["idx"]: (r["frames"], r["rmsf"]) for r in frames.latest_rmsf(spark, out).collect()}
        assert found == {k: (12, pytest.approx(v)) for k, v in want.items()}
        per = {r["residue_id"]: r["rmsf"] for r in frames.latest_rmsf_per_residue(spark, out).collect()}
        assert per == {r["residue_id"]: pytest.approx(r["rmsf"]) for r in trajectory.rmsf_per_residue(rows).collect()}
