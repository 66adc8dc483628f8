"""What the training-data operators share: words, tables, and the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java character class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of other than white space; an empty array for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


def let(value: Column, body) -> Column:
    """body(value), where value is computed once for a row, also inside lambda functions.

    A column that a lambda refers to can be inlined by the optimizer and would then be
    computed for every element; a lambda variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: Rows and bytes of a batch that crosses to Python; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to ours, so that a task holds little text at once."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    held = spark.conf.get(size).lower().removesuffix("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def lean(function):
    """function for mapInArrow, with Arrow's memory taken from and given back to the system when a task ends.

    Workers outlive tasks, and by default keep what their largest batch needed.
    """

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from function(batches)
        finally:
            pa.system_memory_pool().release_unused()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none is set."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='postmill-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


#: Scratch folders that were opened and not deleted yet, the newest last.
_open: list[Scratch] = []


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    Results read them when they are computed, so they stay until the result is written:
    see temporary. What is left is deleted when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/postmill-{uuid.uuid4().hex}"
        _open.append(self)

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        self._delete(f"{self.root}/{name}")

    def clean(self) -> None:
        """Deletes all tables."""
        self._delete(self.root)
        if self in _open:
            _open.remove(self)

    def _delete(self, where: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Deletes, at its end, the tables of all Scratch folders that were opened inside; results must be written by then."""
    before = list(_open)
    try:
        yield
    finally:
        for scratch in [x for x in _open if x not in before]:
            scratch.clean()


@atexit.register
def _clean_all() -> None:
    for scratch in list(_open):
        with contextlib.suppress(Exception):  # the session may have ended
            if scratch.spark.sparkContext._jsc is not None:
                scratch.clean()


def components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node of its component.

    Alternating large-star and small-star steps: every step keeps at most as many edges
    as it found and sends a node only to its least neighbour, so no component is ever
    gathered in one task. The least neighbours are combined before they are shuffled and
    written before they are joined, so the edges of a hub, dealt by that node, are the
    plain side of a join, which Spark can split. The number of steps grows with the
    logarithm of the component.
    """

    def least(pairs: DataFrame, part: str) -> DataFrame:
        return scratch.write(pairs.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{part}")

    directed = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current, step, before = scratch.write(directed, f"{name}-0"), 0, None
    while True:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = least(both, "near").select("u", F.least("u", "m").alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = scratch.write(large.where("u <> v").distinct(), f"{name}-down")
        near = least(down, "least")
        small = down.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = small.union(near.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        following = scratch.write(after, f"{name}-{step}")
        state = following.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        scratch.drop(f"{name}-{step - 1}")
        current = following
        if state == before:
            break
        before = state
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
