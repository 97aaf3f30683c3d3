"""Substring deduplication by hashing lines, sentences of lines, or paragraphs.

Units are normalised, their digests grouped over the whole corpus, the earliest
ranked occurrence of each kept and the others removed; what was removed is
reported with its offsets in the original text.

Short units repeat by chance. So every unit is hashed, but repeats are removed
in runs: neighbouring repeats that together have at least min_run words.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, discard

#: What a unit is. A unit has the white space after it, so that a text is its units one after the other.
UNITS = {
    "line": re.compile(r"[^\n]*+\n|[^\n]++"),
    "sentence": re.compile(r"(?:[^\n.!?]++|[.!?](?![ \t]))*+(?:\n|[.!?][ \t])|(?:[^\n.!?]++|[.!?](?![ \t]))++"),
    "paragraph": re.compile(r"(?:[^\n]++|\n(?![ \t]*+\n))*+\n(?:[ \t]*+\n)++|(?:[^\n]++|\n(?![ \t]*+\n))++\Z|\n"),
}
#: Least words of a run of neighbouring repeats that is removed: half of a passage of
#: fifty words, the sentences at whose ends may be cut.
MIN_RUN = 25
RESULT = ("n_units", "n_removed", "removed")


def units(docs: DataFrame, unit: str) -> DataFrame:
    """row_id, rank, seq, start, length, n_words and digest of every unit with a
    word; seq counts such units in their text, from 0, and start counts characters."""
    pattern = UNITS[unit]
    names = ["seq", "start", "length", "n_words", "digest"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def described(texts):
        of, cols = [], ([], [], [], [], [])
        for i, t in enumerate(texts):
            seq = 0
            for m in pattern.finditer(t or ""):
                w = m.group().encode("utf-8", "replace").lower().split()
                if w:
                    of.append(i)
                    row = (seq, m.start(), m.end() - m.start(), len(w), hashlib.md5(b" ".join(w)).digest())
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    seq += 1
        return pa.array(of, pa.int64()), [pa.array(c, k) for c, k in zip(cols, types, strict=True)]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                of, cols = described(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row_id").take(of), part.column("rank").take(of), *cols], ["row_id", "rank", *names])

    kind = docs.schema["rank"].dataType.simpleString()
    return docs.select("row_id", "rank", "text").mapInArrow(run, f"row_id long, rank {kind}, seq int, start long, length long, n_words int, digest binary")


def runs(found: DataFrame, min_run: int) -> DataFrame:
    """row_id and spans, an array of (start, length), of the repeats to remove."""
    order = F.struct(F.col("rank").isNull().alias("last"), "rank", "row_id", "seq")
    first = found.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written first, so that the join has two exchanges of its own and a hot digest's rows can be split
    first = cut(first.select("digest", F.col("first.row_id").alias("f_row"), F.col("first.seq").alias("f_seq")))
    again = found.join(first, "digest").where((F.col("row_id") != F.col("f_row")) | (F.col("seq") != F.col("f_seq")))
    again = again.select("row_id", "seq", "start", "length", "n_words").repartition("row_id")
    # neighbours agree in seq less their number among the row's repeats
    island = F.col("seq") - F.row_number().over(Window.partitionBy("row_id").orderBy("seq"))
    words = F.sum("n_words").over(Window.partitionBy("row_id", "island"))
    long = again.withColumn("island", island).withColumn("words", words).where(F.col("words") >= min_run)
    out = cut(long.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans")))
    discard(first)
    return out


def dedup_units(docs: DataFrame, unit: str = "line", min_run: int = 1, rank: str = "doc_id") -> DataFrame:
    """All columns of docs, text without repeated units, and n_units, n_removed,
    removed: an array of (start, length) in characters of the original text.

    Units are lines, sentences (parts of lines that end with . ! or ? before
    white space) or paragraphs (parted by empty lines), each with the white space
    after it. They are equal if they agree after lower-casing A to Z and
    squeezing ASCII white space. The first by (rank, row, place) stays; nulls of
    the rank column come last, and equal ranks are kept in the order of the rows
    as they are read. The others are removed where neighbours among them, units
    without words left aside, have min_run words in all.

    One row per row of docs. Null text stays null and has no units; a text
    without words stays as it is; of equal rows all but the first lose their
    units; an empty table gives an empty result; columns named like the result's
    are replaced, and any other names are allowed.
    """
    pattern = UNITS[unit]
    columns = [c for c in docs.columns if c not in RESULT]
    # row numbers hold from here on; the columns are kept apart from ours
    keyed = cut(docs.select(F.struct(*columns).alias("doc"), F.monotonically_increasing_id().alias("row_id"), F.col(rank).alias("rank")))
    found = cut(units(keyed.select("row_id", "rank", F.col("doc.text").alias("text")), unit))
    spans = runs(found, min_run)
    discard(found)

    @F.pandas_udf("text string, n_units long")
    def rest(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out, n = [], []
        for t, spans_ in zip(text, gone, strict=True):
            n.append(0 if t is None else sum(1 for _ in pattern.finditer(t)))
            if spans_ is not None:
                kept, at = [], 0
                for s in spans_:
                    kept.append(t[at : s["start"]])
                    at = s["start"] + s["length"]
                t = "".join([*kept, t[at:]])
            out.append(t)
        return pd.DataFrame({"text": pd.Series(out, dtype=object), "n_units": n})

    out = keyed.join(spans, "row_id", "left").select("doc", "spans", rest(F.col("doc.text"), F.col("spans")).alias("rest"))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    return out.select(
        *[F.col("rest.text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in columns],
        F.col("rest.n_units").alias("n_units"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_removed"),
        F.coalesce("spans", none).alias("removed"),
    )


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_units(docs, "sentence", MIN_RUN)
    return out.withColumn("removed", F.array_join(F.transform("removed", lambda r: F.concat_ws("+", r["start"], r["length"])), ","))


ORACLE_SQL = r"""
with p as (
  select doc_id, text, regexp_extract_all(coalesce(text, ''), '(?s)(?:.*?(?:\n|[.!?][ \t])|.+)') as x from documents),
u as (select doc_id, unnest(x) as x, generate_subscripts(x, 1) as place from p),
s as (
  select *, sum(length(x)) over (partition by doc_id order by place) - length(x) as start,
         regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from u),
k as (
  select *, row_number() over (partition by doc_id order by place) as seq,
         row_number() over (partition by array_to_string(w, ' ') order by doc_id, place) > 1 as again from s where len(w) > 0),
i as (select *, seq - row_number() over (partition by doc_id order by seq) as island from k where again),
g as (select * from (select doc_id, place, start, length(x) as n, sum(len(w)) over (partition by doc_id, island) as words from i) where words >= 25),
t as (
  select s.doc_id, string_agg(x, '' order by s.place) filter (g.place is null) as text, count(*) as n_units, count(g.place) as n_removed,
         string_agg(g.start::varchar || '+' || n::varchar, ',' order by s.place) filter (g.place is not null) as removed
  from s left join g on g.doc_id = s.doc_id and g.place = s.place group by s.doc_id)
select p.doc_id, case when p.text is null then null else coalesce(t.text, '') end as text, coalesce(n_units, 0)::bigint as n_units,
       coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed, '') as removed
from p left join t using (doc_id)
"""
