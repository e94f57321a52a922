"""Shared helpers: the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bits of the map that split_by() broadcasts: 16 bytes for each 64 of them, 4 MB at most.
MAP_BITS = 24


#: Rows of an Arrow batch of texts or images, and of narrow rows. Both sides hold a batch whole, so wide rows go in small ones.
WIDE_ROWS, NARROW_ROWS = 1_000, 10_000


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Arrow batches of the plans that run next hold this many rows; a setting that is neither of the two above is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) in (WIDE_ROWS, NARROW_ROWS):
        spark.conf.set(key, rows)


def sweep_shuffles(spark: SparkSession) -> None:
    """From now on the shuffle files of a plan are deleted when it has run, not when the driver next collects garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def lean(run: Callable) -> Callable:
    """An Arrow pass that gives freed memory back to the system when its partition is done, so that idle workers hold little."""

    def wrapped(batches: Iterable) -> Iterable:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, else (local masters, as in tests) a fresh local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tickspark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths of the shared folder that this process has made and not deleted.
MADE: list[str] = []


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, used once."""
    MADE.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return MADE[-1]


def forget(spark: SparkSession, before: Iterable[str], *kept: str) -> None:
    """Delete the paths made since `before` (a copy of MADE), but for those kept: what later plans read."""
    for path in [p for p in MADE if p not in set(before) | set(kept)]:
        remove(spark, path)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and computes each row once."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in MADE:
        MADE.remove(path)


def split_by(rows: DataFrame, key: Column, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among hits, rows whose key is not): rows stay where they stand.

    hits has one column, of hashes like key. Its hashes are folded into a map of 2 ** MAP_BITS bits, which is broadcast:
    a size that does not grow with the data. Every row whose key is a hit is in the first part; the more hits, the more
    other rows are there too, so the caller still joins that part exactly.
    """
    place = lambda c: F.pmod(c, F.lit(1 << MAP_BITS))
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (c % 64).cast("int"))
    found = hits.toDF("__hit").select(place(F.col("__hit")).alias("__at"))
    words = found.groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.bit_or(one(F.col("__at"))).alias("__bits"))
    asked = rows.withColumn("__at", place(key)).withColumn("__word", F.shiftright("__at", 6))
    told = asked.join(F.broadcast(words), "__word", "left").withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(one(F.col("__at"))) != 0, F.lit(False)))
    return tuple(told.filter(c).select(*rows.columns) for c in (F.col("__maybe"), ~F.col("__maybe")))


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or plain path; works on the driver and on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class UnionFind:
    """Disjoint sets over integer labels; the root is always the smallest label."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def join(self, a: int, b: int) -> bool:
        """False if a and b were already together."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(batches: Iterable) -> Iterable:
    """Spanning forest of one partition's edges (src, dst): the same components from at most one edge per vertex."""
    import pyarrow as pa

    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(a, b)
    keys = list(sets.up)
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([sets.find(x) for x in part], pa.int64())], names=["src", "dst"])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (src long, dst long); component is the smallest id reachable.

    Alternating large-star and small-star rounds over a written edge table: each round is two grouped minima
    with map-side combine and two joins, and the number of rounds grows as the logarithm of the longest chain.
    Neighbour lists are never gathered, so a hub costs a skewed join, which adaptive execution splits, and not a list.
    Each partition's edges are first reduced to a spanning forest. Loops and repeated edges are ignored.
    """
    spark, made = edges.sparkSession, list(MADE)
    # written first: what made the edges and the forest pass need not hold their workers at the same time
    now = (
        written(edges.select("src", "dst"), "links").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .filter("src > dst")
        .mapInArrow(forest, "src long, dst long")
    )
    path = shared_path(spark, "edges")
    now.write.parquet(path)
    forget(spark, made, path)
    before = None
    for _ in range(rounds):
        now = spark.read.schema("src long, dst long").parquet(path)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        star = _star(_star(now, larger=True), larger=False)
        following = shared_path(spark, "edges")
        star.write.parquet(following)
        forget(spark, made, following)
        path = following
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    now = spark.read.schema("src long, dst long").parquet(path)
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(now.select("dst", "dst").distinct())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step. Large: every neighbour above u is hung under u's smallest neighbour (or u). Small: those below."""
    if larger:
        both = edges.union(edges.select("dst", "src")).toDF("u", "v")
    else:
        both = edges.toDF("u", "v")
    # written, so that both sides of the join are plain exchanges, whose hot keys adaptive execution splits
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    hung = both.join(least, "u")
    if larger:
        out = hung.filter("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    else:
        out = hung.select(F.col("v").alias("src"), F.col("m").alias("dst")).union(least.select("u", "m"))
    return out.filter("src <> dst").distinct()
