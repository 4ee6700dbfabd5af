"""Output files of external programs as rows: text lines, their order, and the last header above each.

Lines are numbered in a file (one file is one small report), so windows are as large as a report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def report_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n and value of every line of whole small files."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\r?\n").alias("lines"))
    return text.select("path", F.posexplode("lines").alias("n", "value"))


def propka(lines: DataFrame) -> DataFrame:
    """resname, residue_id, chain_id and pka from a summary of predictions."""
    row = r"^\s+([A-Z][A-Z0-9+-]{1,2})\s+(-?\d+)\s+(\S)\s+(-?\d+\.\d+)"
    inside = F.last(F.when(F.col("value").contains("SUMMARY OF THIS PREDICTION"), F.lit(1)), ignorenulls=True).over(Window.partitionBy("path").orderBy("n"))
    part = lambda k: F.regexp_extract("value", row, k)
    return lines.withColumn("inside", inside).where(F.col("inside").isNotNull() & F.col("value").rlike(row)).select("path", part(1).alias("resname"), part(2).cast("int").alias("residue_id"), part(3).alias("chain_id"), part(4).cast("double").alias("pka"))


def fpocket(lines: DataFrame) -> DataFrame:
    """pocket, score and volume from an info file."""
    pocket = F.when(F.col("value").rlike(r"^Pocket\s+\d+"), F.regexp_extract("value", r"^Pocket\s+(\d+)", 1).cast("int"))
    rows = lines.withColumn("pocket", F.last(pocket, ignorenulls=True).over(Window.partitionBy("path").orderBy("n"))).where("pocket is not null")
    value = lambda key: F.max(F.when(F.lower(F.regexp_extract("value", r"^\s*([^:]*?)\s*:", 1)) == key, F.regexp_extract("value", r":\s*(-?[\d.]+)", 1).cast("double")))
    return rows.groupBy("path", "pocket").agg(value("score").alias("score"), value("volume").alias("volume"))


def vina_scores(lines: DataFrame) -> DataFrame:
    """mode, affinity and distances from a docking program's table, whichever of its headers stands above."""
    row = r"^\s*(\d+)\s+(-?\d+\.?\d*)\s+(\d+\.?\d*)\s+(\d+\.?\d*)\s*$"
    part = lambda k: F.regexp_extract("value", row, k)
    return lines.where(F.col("value").rlike(row)).select("path", part(1).cast("int").alias("mode"), part(2).cast("double").alias("affinity"), part(3).cast("double").alias("rmsd_low"), part(4).cast("double").alias("rmsd_high"))


def cg_beads(lines: DataFrame) -> DataFrame:
    """Number of beads of a coarse-grained structure in PDB lines."""
    return lines.where(F.col("value").rlike("^(ATOM|HETATM)")).groupBy("path").agg(F.count("*").alias("n_beads"))
