"""What the training-data operators share: the shared folder, narrow inputs and whole-text chunking."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode white space as the tokenizers' regular expressions have it, without the four separators that Python adds.
SPACES = "\t-\r \x85\xa0  -     　"
#: No tokenizer here joins a character that is not white space with white space after it, so texts may be cut there.
CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: Words as the rules and joins count them.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset a new local one (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark.sparkContext, "_llm_shared", None) or tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext._llm_shared = base
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and lost executors cost one stage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote of these tables, once nothing that is still to be run reads them."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, by new names: other columns of df can't clash with what an operator adds."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from all columns of df (whatever their case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: A key with at least one row in so many of all rows is hot; so there are no more hot keys than this.
HOT = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Inner join with right, which has one row for each key and in count_col the rows that left has of it, of total.

    The hot keys, HOT at most, are broadcast, so their rows stay where they are; all others are shuffled.
    """
    is_hot = F.col(count_col) * HOT >= total
    hot = right.where(is_hot)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(~is_hot), keys)
    return left.join(F.broadcast(hot), keys).unionByName(rest)


def text_key(text: Column) -> list[Column]:
    """120 bits that stand for a text wherever rows of equal text must meet."""
    h = F.md5(F.coalesce(text, F.lit("")))
    return [F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("long") for k in (0, 1)]


_HELD: dict[str, Callable[[], None]] = {}


def hold_cache(owner: str, clear: Callable[[], None]) -> None:
    """Python workers outlive a stage; whoever starts work in one clears the caches that another operator left there."""
    if owner not in _HELD:
        for other in _HELD.values():
            other()
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only glibc can be asked to give memory back
            ctypes.CDLL(None).malloc_trim(0)
        _HELD[owner] = clear


@contextlib.contextmanager
def no_collection() -> Iterator[None]:
    """No cycles are made here, and looking for some in the caches again and again takes a fifth of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def by_bytes(texts: Iterable[str | None], limit: int) -> Iterator[list[str]]:
    """Runs of whole texts with about limit characters each; null is the empty text."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run
