"""Sharding by longest-processing-time scheduling.

Rows of one group (equal texts) stay together. Groups, longest first, go to the least-loaded shard through a heap (of equally
loaded ones the first). Groups of one size are alike, so the driver walks over sizes with the number of groups of each, not
over groups; of n groups of one size the heap would pop the n least starts (a shard's load and whole multiples of the
size above it), which are counted exactly, and the last of them popped. Sizes come to the driver partition by partition, and the schedule goes
out in parts: T bytes have at most sqrt(2 T) different sizes. Groups then get their shard by their number among those of
their size, and rows gapless slots in the shard; both numbers come from counts of hash buckets and a short window in each
bucket, so no group, size or shard meets in one task.

Null and empty texts are one group of size 1. Repeated rows count each, and tie arbitrarily among equal rows only. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import join_counted, materialize, narrow, new_path, text_key

#: Rows of a hash bucket that is numbered in one task, and buckets of a small table.
BUCKET_ROWS, BUCKETS = 100_000, 256
#: Entries of a table up to which it is broadcast; sizes of the schedule that the driver holds at once.
BROADCAST, PART = 2_000_000, 200_000


def below(loads: list[int], size: int, bound: int) -> list[int]:
    """How many starts of each shard (load, load + size, load + 2 size ...) lie below bound."""
    return [max(0, -(-(bound - x) // size)) for x in loads]


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """sizes: (size, groups), falling. For each size the number of its groups that each shard gets."""
    heap = [(0, s) for s in range(shards)]
    for size, n in sizes:
        counts = [0] * shards
        if n > shards:
            loads = [x for x, _ in sorted(heap, key=lambda h: h[1])]
            low, high = min(loads), min(loads) + size * n + 1  # the n least starts include all below low, not all below high
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if sum(below(loads, size, middle)) <= n else (low, middle)
            counts = below(loads, size, low)
            heap = [(x + c * size, s) for s, (x, c) in enumerate(zip(loads, counts, strict=True))]
            heapq.heapify(heap)
        for _ in range(n - sum(counts)):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            counts[s] += 1
        yield size, counts


def _planned(spark: SparkSession, sizes: DataFrame, shards: int) -> DataFrame:
    """total (the size) and ends: in each shard, the number of the first group of that size that isn't in it."""
    path, part = new_path(spark, "schedule"), []
    schema = "total long, ends array<long>"

    def write() -> None:
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        part.clear()

    falling = ((r["total"], r["n"]) for r in sizes.orderBy(F.desc("total")).toLocalIterator())
    for size, counts in schedule(falling, shards):
        ends, at = [], 0
        for c in counts:
            at += c
            ends.append(at)
        part.append((size, ends))
        if len(part) >= PART:
            write()
    write()
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, key: str, order: list[str], name: str, buckets: int, small: bool = False) -> DataFrame:
    """df with a gapless number from 0 for the rows of each key. small: keys x buckets are few enough to broadcast."""
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(key, "_bucket", (F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(F.broadcast(before) if small else before, [key, "_bucket"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_before", "_own")


def assign_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot and grown_shard (null: sizes decide, not keys)."""
    spark = df.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    key = text_key(F.col("text"))
    rows = materialize(narrow(df, doc_id=id_col, text=text_col).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key[0].alias("k0"), key[1].alias("k1")), "rows")
    groups = materialize(rows.groupBy("k0", "k1").agg(F.sum("size").alias("total"), F.count("*").alias("copies")), "groups")
    sizes = materialize(groups.groupBy("total").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")), "sizes")
    n_sizes, n_groups, n_rows = (x or 0 for x in sizes.agg(F.count("*"), F.sum("n"), F.sum("copies")).first())
    buckets = max(BUCKETS, -(-n_rows // BUCKET_ROWS))
    plan = _planned(spark, sizes.select("total", "n"), shards)
    plan = F.broadcast(plan) if n_sizes * shards <= BROADCAST else plan
    placed = numbered(groups, "total", ["k0", "k1"], "rank", max(BUCKETS, -(-n_groups // BUCKET_ROWS))).join(plan, "total")
    placed = materialize(placed.select("k0", "k1", "copies", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int").alias("shard")), "placed")
    rows = materialize(join_counted(rows, placed, ["k0", "k1"], "copies", n_rows).drop("k1", "copies"), "sharded")
    slots = numbered(rows, "shard", ["doc_id", "k0"], "slot", buckets, small=shards * buckets <= BROADCAST)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
