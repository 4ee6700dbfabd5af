"""Trajectories that arrive as files (an extension). Frame-wise operators are stateless, so each micro-batch is complete;
fluctuations keep the moments of each atom as the stream's state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle import model as m


def stream_frames(spark: SparkSession, path: str, schema: str, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that applies a frame-wise operator to each new batch of rows and appends its result to out."""
    rows = spark.readStream.schema(schema).parquet(path)

    def batch(df: DataFrame, epoch: int) -> None:
        # the batch's number names its folder, so a batch that is run again replaces itself
        operator(df).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def stream_rmsf(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, files: int | None = None, once: bool = False) -> StreamingQuery:
    """Starts a query that keeps the RMSF of each atom (and residue_id, where there is one) over all frames so far.

    The state of an atom is the count, mean and squares of its coordinates, which Spark merges, checkpoints and restores; a
    batch writes the atoms that it changed (update mode). files: files of a batch at most. once: stops when what is there is read.
    """
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    keys = [*m.system_keys(rows), *(c for c in ("residue_id",) if c in rows.columns), "idx"]
    moments = rows.groupBy(*keys).agg(F.count("*").alias("frames"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"))

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = moments.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_rmsf(spark: SparkSession, out: str) -> DataFrame:
    """Each atom's RMSF and number of frames as the last batch that changed it left them."""
    rows = spark.read.parquet(out)
    keys = [c for c in rows.columns if c not in ("frames", "rmsf", "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("frames", "rmsf"), "batch").alias("s"))
    return last.select(*keys, "s.frames", "s.rmsf")


def latest_rmsf_per_residue(spark: SparkSession, out: str) -> DataFrame:
    """The mean RMSF of each residue's atoms."""
    rows = latest_rmsf(spark, out).where("residue_id is not null")
    return rows.groupBy(*m.system_keys(rows), "residue_id").agg(F.avg("rmsf").alias("rmsf"))
