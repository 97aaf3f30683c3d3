"""Mixing sources to target weights along a time-varying curriculum.

Native: DataFrame and SQL functions only.

Each source has a target amount of words and a weight schedule over training
time t in [0, 1], here linear: density 1 + s * (2t - 1), with slope s from -1
(early) to 1 (late). Its integral is the source's cumulative demand; inverting
that demand at the running word count of the source's document stream gives the
training position of every document copy, and sorting by position gives the
order of training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bucket_count, cut, cut_measured, numbered, word_count, words

#: Most copies of one document, as a multiple of its size.
MAX_REPEAT = 3
#: Base weights by rank of the source name, repeating.
WEIGHTS = (1, 2, 3)
#: Documents in one ordering bucket, on average; running sums are local to a bucket.
PER_BUCKET = 20_000


def sizes(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, source, size and a row's place in its source's stream; with keep, also doc: the whole row.

    Places are by the hash of doc_id, or of the text where that is null."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if keep else []
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(own).alias("rank"), F.xxhash64("text").alias("digest"), *row)


def targets(by_source: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, weight, target of each row of (source, source_size).

    Water filling: in each round the sources whose cap is below their share of
    what is left stop at it, until no more do. A round is one aggregate; sources
    are numbered by range, so they may be as many as hosts.
    """
    code = F.hex(F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    s = numbered(by_source.withColumn("no", F.col("source").isNull()).withColumn("code", code), "number", "no", "code")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    s = cut(s.select("source", "source_size", weight.alias("weight"), cap.alias("cap")))
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    full, n_full, level = F.lit(False), 0, None
    while True:
        capped, open_weight, n = s.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        if level is not None and n == n_full or not open_weight:
            break
        n_full, level = n, (float(total) - capped) / open_weight
        full = full | (F.col("cap") <= F.lit(level) * F.col("weight"))
    target = F.col("cap") if not open_weight else F.when(full, F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def position(done: Column, target: Column, slope: Column) -> Column:
    """The t at which a source's cumulative demand reaches the share done / target."""
    y = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(target > 0, done / target).otherwise(F.lit(0.0))))
    b = F.lit(1.0) - slope
    curved = (F.sqrt(b * b + F.lit(4.0) * slope * y) - b) / (F.lit(2.0) * slope)
    return F.when(F.abs(slope) < 1e-9, y).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), curved)))


def takes(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, per_bucket: int = PER_BUCKET, keep: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, rank, source_size, weight,
    target, done (words of its source's stream before it), whole (full copies),
    part (words of the last, incomplete pass), taken; with keep, also doc, the row itself.

    Every source repeats its whole stream floor(target / size) times and then
    takes the words of its stream once more until the target is reached; the
    document in which that happens is cut there, so a source misses its target
    by less than one word. Running sums are two-level: rows are dealt to buckets
    of about per_bucket rows by the leading digits of their hash, sums of
    buckets are accumulated in a table with one row per source and bucket, and
    only rows of one bucket are ordered together, so a source with a third of
    all rows is spread out.

    Null text has size 0; a null source is a source of its own, sorted last; a
    null doc_id is kept; equal rows are separate documents that may be ordered
    either way without changing the result; an empty table gives an empty
    result. Extra columns are ignored.
    """
    light, seen = cut_measured(sizes(docs), F.count(F.lit(1)).alias("n"))
    # a power of 16 of buckets, so that a bucket is a prefix of the hash
    digits = 0
    while 16**digits < bucket_count(seen["n"], per_bucket):
        digits += 1
    bucket = F.substring("rank", 1, digits) if digits else F.lit("")
    sums = light.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that its size is known before rows with their texts would be shuffled to join it
    sums = cut(sums.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_done")))
    shares = targets(cut(light.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, max_repeat).withColumnRenamed("source", "t_source")
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = (sizes(docs, True) if keep else light).withColumn("bucket", bucket)
    rows = rows.withColumn("in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")), "left")
    rows = rows.join(shares, F.col("source").eqNullSafe(F.col("t_source")), "left")
    done = F.coalesce("bucket_done", F.lit(0)) + F.col("in_bucket")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(ratio), F.lit(max_repeat)).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    rows = rows.withColumn("done", done).withColumn("whole", whole)
    part = F.when(F.col("whole") >= max_repeat, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), F.floor(rest + 1e-6) - F.col("done"))))
    rows = rows.withColumn("part", part.cast("long"))
    return rows.select("doc_id", "source", "size", "rank", "source_size", "weight", "target", "done", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), *(["doc"] if keep else []))


def placed(docs: DataFrame, slopes: dict | None = None, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, per_bucket: int = PER_BUCKET, keep: bool = False) -> DataFrame:
    """takes() and copies: of each document, in order of repeat, an array of
    (repeat from 0, n_words of the copy, position in [0, 1]); empty if none is taken.

    slopes gives a source's slope in [-1, 1]; by default heavier sources lean to
    the end of training: -0.5, 0, 0.5 for the weights 1, 2, 3. Documents without
    words are never taken.
    """
    t = takes(docs, weights, max_repeat, per_bucket, keep)
    slope = F.lit(0.0)
    for w, s in zip(weights, (-0.5, 0.0, 0.5), strict=False):
        slope = F.when(F.col("weight") == float(w), F.lit(s)).otherwise(slope)
    for name, s in (slopes or {}).items():
        slope = F.when(F.col("source") == name, F.lit(float(s))).otherwise(slope)
    t = t.withColumn("slope", slope)
    copies = F.col("whole").cast("int") + (F.col("part") > 0).cast("int")

    def copy(repeat: Column) -> Column:
        n = F.when(repeat < F.col("whole"), F.col("size")).otherwise(F.col("part"))
        at = repeat * F.col("source_size") + F.col("done") + n / F.lit(2.0)
        return F.struct(repeat.alias("repeat"), n.alias("n_words"), position(at, F.col("target"), F.col("slope")).alias("position"))

    some = F.when((F.col("taken") > 0) & (copies > 0), F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    return t.withColumn("copies", F.transform(some, copy)).drop("slope")


def curriculum(docs: DataFrame, slopes: dict | None = None, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, per_bucket: int = PER_BUCKET) -> DataFrame:
    """One row per document copy that the mix takes: doc_id, source, size, rank,
    repeat (from 0), n_words (of the copy), position in [0, 1]; options as in placed().
    """
    t = placed(docs, slopes, weights, max_repeat, per_bucket)
    return t.select("doc_id", "source", "size", "rank", F.explode("copies").alias("c")).select("doc_id", "source", "size", "rank", "c.repeat", "c.n_words", "c.position")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in training order, each as often as the mix takes it.

    A row travels with its copies, so every row has its own, and the words that
    are written are the words that takes() counts. The result is range-sorted by
    position. A copy that the end of the last pass cuts holds the first words of
    its text, joined by single spaces. Rows without words are left out. All
    columns of docs are kept, whatever their names, and no others are added.
    Nulls, repeated rows and empty tables as in takes().
    """
    t = placed(docs, keep=True, **options).select("doc", "doc_id", "size", F.explode("copies").alias("copy"))
    short = F.array_join(F.slice(words(F.col("doc.text")), 1, F.col("copy.n_words").cast("int")), " ")
    text = F.when(F.col("copy.n_words") < F.col("size"), short).otherwise(F.col("doc.text"))
    t = t.withColumn("new", text).orderBy("copy.position", "doc_id", "copy.repeat")
    return t.select(*[F.col("new").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


ORACLE_SQL = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as rank
  from documents),
s as (select source, sum(size)::bigint as source_size,
             [1.0::double, 2.0::double, 3.0::double][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::bigint] as weight
      from d group by source),
steps as (
  select 0 as step, source, source_size, weight, false as capped, (sum(source_size) over ())::double as remaining, sum(weight) over () as open_weight from s
  union all
  select step + 1, source, source_size, weight, f2,
         remaining - coalesce(sum(case when f2 and not capped then 3.0 * source_size end) over (), 0.0),
         open_weight - coalesce(sum(case when f2 and not capped then weight end) over (), 0.0)
  from (select *, capped or (3.0 * source_size <= remaining / nullif(open_weight, 0) * weight) as f2 from steps where step < 40)),
t as (select source, source_size, weight, case when capped then 3.0 * source_size else remaining / open_weight * weight end::double as target from steps where step = 40),
r as (
  select d.doc_id, d.size, t.source_size, t.weight, t.target,
         coalesce(sum(d.size) over (partition by d.source order by d.rank, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as done,
         case when t.source_size > 0 then least(floor(t.target / t.source_size), 3) else 0 end::bigint as whole
  from d join t on d.source is not distinct from t.source),
p as (
  select *, case when whole >= 3 then 0 else greatest(0, least(size, floor(target - whole * source_size + 1e-6) - done)) end::bigint as part from r),
m as (
  select *, case when size * whole + part > 0 then least(1.0::double, greatest(0.0::double, (done + case when whole > 0 then size else part end / 2.0::double) / target)) end as y,
         case weight when 1 then -0.5::double when 3 then 0.5::double else 0.0::double end as slope from p)
select doc_id, size, source_size, target, (size * whole + part)::bigint as taken,
       round(case when slope = 0 then y else (sqrt((1 - slope) * (1 - slope) + 4.0::double * slope * y) - (1 - slope)) / (2 * slope) end, 9) as position
from m
"""


def read(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def ordered(docs: DataFrame, **options) -> DataFrame:
    """One row per document, in the order in which training first meets them;
    taken sums the words of the document's copies, position is that of the first
    (null if there is none), documents never taken come last."""
    t = placed(docs, **options)
    first = F.array_min(F.transform("copies", lambda c: c["position"]))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["n_words"])
    t = t.select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("position"))
    return t.orderBy(F.col("position").asc_nulls_last(), "doc_id").withColumn("position", F.round("position", 9))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return ordered(read(spark, sf_dir))


def op7_curriculum_query(spark, sf_dir: str) -> DataFrame:
    """All copies in training order, with their positions."""
    return curriculum(read(spark, sf_dir)).orderBy("position", "doc_id", "repeat").select("doc_id", "source", "repeat", "n_words", "position")
