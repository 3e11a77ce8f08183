"""Shared building blocks: scratch tables, exact distributed prefix sums, connected components.

Everything here is DataFrame code. Scratch tables are written below the folder that the session
names in ``spark.checkpoint.dir``, so any executor can read them after another one is lost.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes that count as white space in the contracts of this subpackage.
WS_CLASS = r"[\x20\x09-\x0D]"
NON_WS_RUN = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for scratch tables: below ``spark.checkpoint.dir``; an own folder where that is unset and all of Spark is one process (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if sc.applicationId not in _own_dirs:
            _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="brookmill-")
        base = "file://" + _own_dirs[sc.applicationId]
    root = f"{base.rstrip('/')}/brookmill/{sc.applicationId}"
    return root


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Hadoop's file system, whichever store it is in."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)


@atexit.register
def _clean_own() -> None:
    import shutil

    for path in _own_dirs.values():
        shutil.rmtree(path, ignore_errors=True)


#: A scratch table needs neither checksum files nor a success mark beside its data, in a folder on a mounted disk least of all:
#: there every file costs Hadoop a process of its own that sets its permissions.
SCRATCH_OPTIONS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


class Scratch:
    """A written table: ``.df`` reads it again, with its lineage cut; ``.drop()`` removes the files."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.options(**SCRATCH_OPTIONS).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_scratch(self.spark, self.path)


#: Bytes and rows of the batches that a Python worker gets, where the session keeps Spark's defaults (64 MB, 10 000).
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000
SPARK_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", BATCH_BYTES), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", BATCH_ROWS)}

#: Called in a worker when a task's rows are through, to empty what a module caches.
_caches: list[Callable[[], None]] = []


def cache_of_task(empty: Callable[[], None]) -> Callable[[], None]:
    """Has ``empty`` called at the end of every task: workers live on and would hold the cache beside the executor's heap."""
    _caches.append(empty)
    return empty


def _release() -> None:
    for empty in _caches:
        empty()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` in small batches, whose worker gives back its memory at the end of a task."""
    conf = df.sparkSession.conf
    for name, (default, own) in SPARK_BATCH.items():
        if conf.get(name) == default:
            conf.set(name, str(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)


def source_key(col: Column) -> Column:
    """A never-null key that sorts by code point with null last: '0' + source, or '1' for null."""
    return F.when(col.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col.cast("string")))


def hash32(*cols: Column, seed: str) -> Column:
    """The first 32 bits of an MD5 as a long in [0, 2**32): the same in any engine and on any rerun. A null counts as empty."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: Rows up to which a table with one row per key is broadcast; the count is taken from the written table.
BROADCAST_ROWS = 20_000
#: The same for tables of a few numbers a row, 10 MB at most.
IDS_MOST = 200_000


def small_or_plain(table: Scratch | DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table (or a filter of a written one), marked for broadcast only if it has at most ``most`` rows; else joins on it are ordinary ones."""
    df = table.df if isinstance(table, Scratch) else table
    return F.broadcast(df) if df.count() <= most else df


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    pos: str,
    order: list[Column],
    weight: Column,
    out: str,
    total: str,
    count: str,
    rows_per_cell: int = 1024,
    fan: int = 1024,
) -> DataFrame:
    """Adds for each row the sum of ``weight`` over the rows of its ``keys`` that stand before it (``out``), and the
    key's sum (``total``) and row number (``count``).

    Rows stand in the order of (``pos``, *order); ``pos`` is a long in [0, 2**32), spread about evenly. A key with any
    number of rows is cut by ``pos`` into cells of about ``rows_per_cell`` rows; the cells' sums are added up in runs
    of ``fan`` cells, then over the runs, so no task sees more than a cell, or ``fan`` sums. ``df`` is read three
    times and should be a written table.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), F.sum(weight).alias(total))
    sizes = sizes.withColumn("__bm_cells", F.ceil(F.col(count) / F.lit(rows_per_cell)).cast("long"))
    sizes = small_or_plain(Scratch(sizes, "prefix-sizes"))
    # pos * cells stays below 2**63 for up to 2**31 cells, which is 2e12 rows of a key.
    celled = df.join(sizes, keys).withColumn("__bm_cell", F.shiftright(F.col(pos) * F.col("__bm_cells"), 32))
    cell_keys = [*keys, "__bm_cell"]
    cells = celled.groupBy(*cell_keys).agg(F.sum(weight).alias("__bm_w")).withColumn("__bm_run", F.floor(F.col("__bm_cell") / F.lit(fan)).cast("long"))
    before = lambda w: F.coalesce(F.sum("__bm_w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cells.groupBy(*keys, "__bm_run").agg(F.sum("__bm_w").alias("__bm_w"))
    runs = runs.select(*keys, "__bm_run", before(Window.partitionBy(*keys).orderBy("__bm_run")).alias("__bm_base"))
    cells = cells.withColumn("__bm_off", before(Window.partitionBy(*keys, "__bm_run").orderBy("__bm_cell")))
    offsets = cells.join(runs, [*keys, "__bm_run"]).select(*cell_keys, (F.col("__bm_off") + F.col("__bm_base")).alias("__bm_base"))
    celled = celled.withColumn("__bm_w", weight)
    inner = Window.partitionBy(*cell_keys).orderBy(F.col(pos), *order)
    ranked = celled.withColumn("__bm_in", before(inner)).join(offsets, cell_keys)
    return ranked.withColumn(out, F.col("__bm_in") + F.col("__bm_base")).drop("__bm_in", "__bm_base", "__bm_w", "__bm_cell", "__bm_cells")


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> Scratch:
    """Components of an undirected graph with edges (a long, b long): a written table (node, component), where
    component is the smallest node. Nodes without an edge do not appear.

    Alternating star contraction: each round hangs every node and its smaller neighbours below the smallest of them,
    then shortens each pointer by one step; rounds grow with the logarithm of the longest path. Each round is a
    written table. Minimums are combined before the shuffle, and the joins are plain ones that adaptive execution can
    split where a node has very many neighbours.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = Scratch(edges.where(F.col("a") != F.col("b")).select(hi, lo).distinct(), name)
    mark = None
    for _ in range(max_rounds):
        e = now.df
        p = e.groupBy("hi").agg(F.min("lo").alias("p"))
        j = e.join(p, "hi")
        low = j.select(F.explode(F.array(F.struct("hi", F.col("p").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("p").alias("lo")))).alias("e")).select("e.*")
        low = low.where(F.col("hi") != F.col("lo")).distinct()
        up = p.select(F.col("hi").alias("lo"), F.col("p").alias("q"))
        nxt = Scratch(low.join(up, "lo", "left").select("hi", F.coalesce("q", "lo").alias("lo")).distinct(), name)
        row = nxt.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        now.drop()
        now = nxt
        if mark == tuple(row):
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.df.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("component")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("component")))).alias("e"))
    done = Scratch(roots.select("e.*").groupBy("node").agg(F.min("component").alias("component")), f"{name}-done")
    now.drop()
    return done


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
