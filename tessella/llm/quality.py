"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target
and the raw corpus, after a base filter on simple counts.

Native: DataFrame and SQL functions only.

Tokens are lower-cased runs of word characters or of punctuation; unigrams and
bigrams are hashed into a fixed number of buckets. Two multinomials over the
buckets are estimated, with add-one smoothing: the raw one over every document,
the target one over trusted rows. A document's score is the mean over its
n-grams of log p_target - log p_raw, and it is kept if the score reaches the
threshold. Nothing is random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_CLASS, let, words

BUCKETS = 10_000
#: Trusted rows that the target is estimated from, at most: those with the smallest hash of their id.
MAX_TRUSTED = 50_000
#: Lowest mean log-likelihood ratio of a kept document, in nats per n-gram.
THRESHOLD = -0.25
SYMBOLS = "#*$%&|<>"
WINDOW = 8
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def covered_words(w: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of width words that the text has twice or more.

    Windows are hashed once each; their hashes and places are sorted inside the
    row, so the cost is that of a sort also for very long texts.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def marked(ws: Column) -> Column:
        placed = F.array_sort(F.transform(ws, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def again(s: Column) -> Column:
            hit = F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])), lambda p: p.isNotNull())
            return let(F.array_sort(hit), lambda q: F.aggregate(F.transform(q, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(q, i + 1) - p, F.lit(width)))), F.lit(0).cast("long"), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("long")).otherwise(let(placed, again))

    return F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), marked)))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null text counts as empty: all counts are 0 and the row fails the base filter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    w = words(F.col("text"))

    def measured(v: Column) -> Column:
        return F.struct(F.size(v).cast("long").alias("n_words"), F.length(F.array_join(v, "")).cast("long").alias("word_chars"), covered_words(v).alias("n_repeat_words"))

    out = docs.withColumns(
        {
            "q_w": let(w, measured),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    out = out.withColumns({c: F.col(f"q_w.{c}") for c in ("n_words", "word_chars", "n_repeat_words")}).drop("q_w")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's token unigrams and bigrams, from 0; the first
    bigram is that of the first token with the start of the text."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    cell = lambda x: F.pmod(x, F.lit(buckets)).cast("int")

    def both(h: Column) -> Column:
        return F.concat(F.transform(h, cell), F.transform(h, lambda x, i: cell(F.xxhash64(F.get(h, i - 1), x))))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), both)


def bucket_counts(docs: DataFrame, buckets: int) -> dict[int, int]:
    """Counts by bucket; at most `buckets` rows reach the driver."""
    exploded = docs.select(F.explode(ngram_buckets(F.col("text"), buckets)).alias("b"))
    return {r["b"]: r["n"] for r in exploded.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> list[float]:
    """The log-likelihood ratio of every bucket.

    trusted_ids has a column doc_id. The target is estimated from at most
    max_trusted of them, a proven bound that makes the broadcast safe; the raw
    counts cover every document. Without trusted rows all ratios are 0.
    """
    raw = bucket_counts(docs, buckets)
    chosen = trusted_ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    good = bucket_counts(docs.join(F.broadcast(chosen), "doc_id", "left_semi"), buckets)
    if not good:
        return [0.0] * buckets
    n_raw, n_good = sum(raw.values()) + buckets, sum(good.values()) + buckets
    return [math.log((good.get(b, 0) + 1) / n_good) - math.log((raw.get(b, 0) + 1) / n_raw) for b in range(buckets)]


def score(text: Column, ratios: list[float]) -> Column:
    """Mean ratio over the n-grams of text; 0 for a text without any."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    grams = ngram_buckets(text, len(ratios))
    return let(grams, lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size(g)))


def judge(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """docs with the base counts, base_failed, llr and kept, one row for each row.

    Null and empty texts have no n-grams and fail the base filter; equal rows
    get equal verdicts; null ids are judged like others (they are never
    trusted); an empty table gives an empty result; other columns pass through
    unless they carry one of the result's names, which then replaces them.
    """
    ratios = fit(docs, trusted_ids, buckets, max_trusted)
    out = base_counts(docs).withColumn("llr", score(F.col("text"), ratios))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return judge(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("llr", 6).alias("llr"), "kept")


BASE_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_query(spark, sf_dir: str) -> DataFrame:
    """The base filter's part of op9, which SQL can express."""
    return base_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(*BASE_COLUMNS)


BASE_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
c as (select doc_id, count(distinct i + k) as n from r, range(0, 8) t(k) group by doc_id),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w)
select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols,
       (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
       len(ws) < 20 or 100 * coalesce(c.n, 0) > 30 * len(ws) as base_failed
from w join l using (doc_id) left join c using (doc_id)
"""
