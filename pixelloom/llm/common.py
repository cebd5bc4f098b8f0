"""What the training-data operators share: shared scratch tables, checked broadcasts, Arrow batch bounds."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.session import ship

#: Bytes of one Arrow batch sent to a Python worker; keeps a worker's memory independent of row widths.
ARROW_BATCH_BYTES = 8 << 20

_own_dir: str | None = None
_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ships this package, and bounds the session's Arrow batches by bytes (a smaller bound of its own stays), so rows that hold whole texts or blocks never add up."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    if not own.isdigit() or not 0 < int(own) <= ARROW_BATCH_BYTES:
        spark.conf.set(name, str(ARROW_BATCH_BYTES))


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it is unset, a local session gets a folder of its own; a cluster has none that all executors share, so it is an error there."""
    global _own_dir
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="pixelloom-")
        base = f"file://{_own_dir}"
    path = f"{base.rstrip('/')}/pixelloom-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


@atexit.register
def remove_scratch() -> None:
    """Deletes all written tables of this process, at its end if the session still runs: results that haven't been read are lost."""
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None:
        return
    while _scratch:
        path = context._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, is computed once and survives lost executors."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, lazily or not, so their disk is free before the process ends."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _scratch.remove(table._scratch_path)


def give_back() -> None:
    """Returns a worker's freed memory to the system, where its allocators can: workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_blank = re.compile(r"[ \n\t\r]").search


def spans(text: str, size: int) -> Iterator[str]:
    """Parts of a text of about `size` characters or fewer, cut before blanks and line ends only."""
    at = 0
    while len(text) - at > size:
        cut = _blank(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint if df (a written table) has at most max_rows rows; else Spark's own choice of join."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df.hint("merge")


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], max_rows: int) -> DataFrame:
    """rows with the columns of found (a written table, one row a key), null where it has none. Beyond max_rows of found it is a shuffle, from which rows with a null key stay out: they would be one task's."""
    if found.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(found), keys, "left")
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    new = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields if f.name not in keys]
    return rows.where(some).join(found.hint("merge"), keys, "left").unionByName(rows.where(~some).select("*", *new))


def block_pairs(blocks: DataFrame, keys: list[str], column: str, parts: str, same: bool) -> DataFrame:
    """blocks (keys, parts, block, column) -> (keys, p, q): the column of every two blocks of a key, and with `same` of each block with itself.

    A key of n blocks is dealt into a grid of about n cells, each with the
    pairs of sqrt(n) blocks with sqrt(n) others, so a key with most of all
    blocks is spread out, at sqrt(n) copies of a block.
    """
    g = F.expr(f"cast(ceil(sqrt({parts})) as long)")
    cells = F.explode(F.sequence(F.lit(0).cast("long"), g - 1))
    one = blocks.select(*keys, F.col("block").alias("i"), F.col(column).alias("p"), F.expr("pmod(block, ceil(sqrt(%s)))" % parts).alias("row"), cells.alias("col"))
    two = blocks.select(*keys, F.col("block").alias("j"), F.col(column).alias("q"), F.expr("pmod(block, ceil(sqrt(%s)))" % parts).alias("col"), cells.alias("row"))
    return one.join(two.hint("merge"), [*keys, "row", "col"]).where("i <= j" if same else "i < j").select(*keys, "p", "q")
