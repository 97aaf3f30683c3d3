"""What several operators of this subpackage need: words, lineage cuts, local
"let" bindings for higher-order functions, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the result contracts define it: space, and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; where it is not set, and
    driver and executors are one process, a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    The result no longer depends on earlier stages, so a lost executor costs one
    read, and a table that is used several times is computed once.
    """
    return written(df)


def cut_measured(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """cut(), and aggregates of the rows by name, taken while they are written."""
    seen = Observation()
    out = written(df.observe(seen, *measures))
    return out, seen.get


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that no later plan reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def tidy(run):
    """run, a function of an iterator of batches, that gives memory back to the system at its end:
    Python workers live on for later stages, and what their allocators hold counts for the executor."""

    def wrapped(parts):
        try:
            yield from run(parts)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it while df has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """body(value), with value computed once although body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The runs of non-white characters of text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS + "+")).cast("long")


def bucket_count(n_rows: int, per_bucket: int) -> int:
    return max(1, math.ceil(n_rows / per_bucket))


def numbered(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df with a column name: the rows' numbers from 0 in the order of by.

    Rows are dealt by range and numbered inside their part; only the parts'
    counts meet in one task."""
    whole = F.monotonically_increasing_id()
    parts = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("n_id", whole))
    part, place = F.shiftright("n_id", 33), F.col("n_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("n_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy(part.alias("n_part")).agg(F.count(F.lit(1)).alias("n")).select("n_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_base"))
    return parts.join(F.broadcast(base), part == F.col("n_part")).withColumn(name, place + F.col("n_base")).drop("n_id", "n_part", "n_base")


#: Edges up to which a node's edges may meet in one task; beyond it, joins are such that a hot node's are split.
FEW_EDGES = 10_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is
    the smallest node reachable.

    Alternating large-star and small-star rounds. Every step is a minimum per
    node and an equi-join, so no neighbourhood is ever collected in one task: a
    star with a third of all nodes is pre-aggregated on the map side, and beyond
    FEW_EDGES edges the minima are written before they are joined, so adaptive
    execution can split the star's partition. Each round is written to the
    shared folder, and the one before deleted. Null ends and self loops are
    ignored; an empty edge list gives an empty result.
    """

    def least(e: DataFrame, n: int) -> DataFrame:
        out = e.groupBy("u").agg(F.min("v").alias("m"))
        return cut(out) if n > FEW_EDGES else out

    def mark(e: DataFrame) -> tuple[DataFrame, tuple]:
        out, seen = cut_measured(e, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        return out, (seen["n"], seen["sum"])

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNull() | F.col(b).isNull()).alias("x"))
    e, seen = mark(e.where(~F.col("x") & (F.col("u") != F.col("v"))).select("u", "v").distinct())
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both, seen[0]).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large) if seen[0] > FEW_EDGES else large
        joined = large.join(least(large, seen[0]), "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        before, (e, now) = e, mark(small.select("p.u", "p.v").where("u <> v").distinct())
        discard(before, *([low, large] if seen[0] > FEW_EDGES else []))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
