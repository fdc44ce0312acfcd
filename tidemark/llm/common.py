"""Helpers shared by the training-data operators: staging, word hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch given to Python; texts can be long, so batches stay short.
ARROW_ROWS = 500
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: list[tuple[SparkSession, str]] = []
_LOCAL: dict[str, str] = {}
_LOCK = threading.Lock()
#: Writes under way that want CLEANUP, and what the session had before the first of them.
_CLEANING: list = [0, None]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where it is unset, a local session (tests) gets a temporary
    folder of its own; a cluster has none that all its machines see, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="tidemark-")
        _LOCAL[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _STAGED:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001, S112  the JVM has gone; the folder is the cluster's to clear
            continue


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}-{name}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The job's shuffle files go when it ends (where Spark can), so that peak disk is that of one step.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with _LOCK:
        if not _CLEANING[0]:
            _CLEANING[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _CLEANING[0] += 1
    try:
        df.write.parquet(path)
    finally:
        with _LOCK:
            _CLEANING[0] -= 1
            if not _CLEANING[0]:
                spark.conf.set(CLEANUP, _CLEANING[1]) if _CLEANING[1] is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        _remove(df.sparkSession, path)
        _STAGED[:] = [x for x in _STAGED if x[1] != path]


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """A worker's one large thing (automata, encoder): made once, and let go as soon as another operator needs its own.

    Workers live on from stage to stage, so what earlier stages remembered would otherwise add up.
    """
    if key not in _HELD:
        release()
        trim()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what earlier stages left in this worker."""
    if _HELD:
        _HELD.clear()
        gc.collect()


def trim() -> None:
    """Give memory that earlier stages have freed in this worker back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        return


def short_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits (any script)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def hashes(words: Column) -> Column:
    """64-bit hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list as (node, component); component is the smallest node id.

    Alternating large-star / small-star rounds. Smallest neighbours come from aggregations with map-side combining and
    are written before edges are joined with them, so adaptive execution sees both sides' sizes and can split the rows
    of a node with very many edges over tasks, or send the small side to them.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    e = stage(e, "edges")
    seen = None
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        big = stage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "big")
        least = stage(big.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = big.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        nxt = stage(small, "edges")
        sums = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        for x in (e, low, big, least):
            unstage(x)
        e, done = nxt, seen == (sums["n"], sums["h"])
        seen = (sums["n"], sums["h"])
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
