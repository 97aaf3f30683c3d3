"""Toxicity of texts that may be disguised: a noisy channel undoes the disguise,
then the restored text is scored.

Disguised spans (every word with a sign beside a letter, runs of single
characters, letters repeated three times and more) become lattices of the
characters that each sign may stand for; separators may also end a word. A Viterbi search finds the most likely reading under a character
trigram model that is counted over all documents. The restored text is scored
by a logistic model over words and word beginnings, fitted on labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, tidy, unused

# Letters of the model, and what a sign may stand for in a disguise.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
OTHER = 63
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c"}
#: Costs of the channel in nats: a sign for a letter, a dropped separator, a dropped sign, a run cut to one or two.
COST_SIGN, COST_GAP, COST_DROP, COST_RUN = 0.7, 0.3, 6.0, 0.4
#: A single separator that ends a word, in nats.
COST_WORD = 2.0

#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
MAX_LABELLED = 40_000
#: Features in the model, at most, and the least log-likelihood ratio statistic and count of one.
MAX_FEATURES, LEAST_G, LEAST_COUNT = 20_000, 11.0, 3

SIGNS = re.escape("".join(STANDS_FOR))
LETTER = r"[^\W\d_]"
WORD = re.compile(r"\S+")
#: Signs that are ordinary punctuation at the ends of a word.
PUNCTUATION = "!|(<"
#: Words for the lattice: a sign beside a letter, or only signs that are no amount; and letters three times and more.
MIXED = re.compile(rf"{LETTER}[{SIGNS}]|[{SIGNS}]{LETTER}|^(?![$€£]?[\d.,]+[$€£+]?$)(?=.*[@$])[{SIGNS}]{{3,}}$", re.S)
TRIPLE = re.compile(rf"({LETTER})\1\1")
#: Two and more single characters between separators, with punctuation before and after them.
SPACED = re.compile(rf"""(?<![^\s(\[{{"'«“‘¿¡<])(?:[^\W_]|[{SIGNS}])(?:(?:\s++[.\-_*]?\s*+|[.\-_*]\s*+)(?:[^\W_]|[{SIGNS}]))+(?=[^\w\s]*(?:\s|$))""")
READABLE = re.compile(rf"{LETTER}|[@$]")
SPACES = re.compile(r"\s+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: What is cut from a word's ends before the lattice: what is neither letter, digit nor sign.
PLAIN_EDGES = re.compile(rf"^(?:(?![{SIGNS}])[\W_])+|(?:(?![{SIGNS}])[\W_])+$")
RUN = re.compile(r"(.)\1*", re.S)


def table() -> np.ndarray:
    """Model index by code point: 0 for what is no letter."""
    out = np.zeros(0x250, np.int32)
    for i in range(0x250):
        if chr(i).isalpha():
            out[i] = OTHER
    for i, c in enumerate(LETTERS):
        out[ord(c)] = i + 1
    return out


TABLE = table()


def index(c: str) -> int:
    return int(TABLE[ord(c)]) if ord(c) < 0x250 else OTHER if c.isalpha() else 0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over every whole text; at most 64**3 rows reach the driver."""

    def run(parts):
        total = np.zeros(1 << 18, np.int64)
        for p in parts:
            for i in range(0, len(p), 100):
                text = " ".join(["", *p["text"].iloc[i : i + 100].dropna(), ""]).lower()
                x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                a = np.where(x < 0x250, TABLE[np.minimum(x, 0x24F)], OTHER).astype(np.int32)
                if len(a) > 2:
                    total += np.bincount((a[:-2] << 12) | (a[1:-1] << 6) | a[2:], minlength=1 << 18)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at.astype(np.int32), "n": total[at]})

    counts = docs.select("text").mapInPandas(tidy(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    got, out = counts.toArrow(), np.zeros(1 << 18)
    out[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), trigrams interpolated with bigrams and letters; shape (64, 64, 64)."""
    n = counts.reshape(64, 64, 64)
    one = (n.sum((0, 1)) + 1) / (n.sum() + 64)
    pair = n.sum(0)
    two = (pair + 5 * one) / (pair.sum(1, keepdims=True) + 5)
    return -np.log((n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each run of equal signs of a span, the readings (letters, cost).

    A separator is nothing or the end of a word, two white spaces rather the
    latter; punctuation at the span's ends may be just that.
    """
    out = []
    for m in RUN.finditer(span):
        c, n = m.group(1), len(m.group())
        if c.isspace() or c in ".-_*":
            out.append([("", COST_GAP), (" ", COST_GAP if c.isspace() and n > 1 else COST_WORD)])
        elif c.isalpha():
            out.append([(c * n, 0.0)] if n < 3 else [(c, COST_RUN), (c * 2, COST_RUN)])
        else:
            reads = [(x * k, COST_SIGN) for x in STANDS_FOR.get(c, "") for k in ((n,) if n < 3 else (1, 2))]
            edge = c in PUNCTUATION and (m.start() == 0 or m.end() == len(span))
            out.append([*reads, ("", COST_GAP if edge else COST_DROP)] if reads else [("", COST_DROP)])
    return out


def decode(span: str, model: np.ndarray) -> str:
    """The most likely reading of a span: Viterbi over its lattice, states being the last two letters."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for choices in lattice(span):
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in best.items():
            for letters, extra in choices:
                x, y, total = a, b, cost + extra
                for c in letters:
                    k = index(c)
                    total += float(model[x, y, k])
                    x, y = y, k
                if (x, y) not in new or total < new[(x, y)][0]:
                    new[(x, y)] = (total, text + letters)
        best = new
    return min((cost + float(model[a, b, 0]), text) for (a, b), (cost, text) in best.items())[1]


class Restorer:
    """Undoes disguises; remembers the readings of a bounded number of spans."""

    def __init__(self, model: np.ndarray):
        self.read = lru_cache(maxsize=20_000)(lambda span: decode(span, model))

    def words(self, text: str | None) -> tuple[set[str], int]:
        """The distinct restored words of a text, and how many of its spans have another reading than their own."""
        low = (text or "").lower()
        out, n = set(), 0
        for m in SPACED.finditer(low):
            if READABLE.search(m.group()):
                out.update(self.read(SPACES.sub(lambda x: " " if len(x.group()) == 1 else "  ", m.group())).split())
                n += 1
        triples = TRIPLE.search(low) is not None
        for w in set(low.split()):
            if w.isalpha():
                out.add(w)
                if triples and TRIPLE.search(w):
                    out.add(self.read(w))
                    n += 1
                continue
            bare = EDGES.sub("", w)
            if bare:
                out.add(bare)
            core = PLAIN_EDGES.sub("", w)
            if core and (MIXED.search(core) or triples and TRIPLE.search(core)):
                read = self.read(core)
                out.update(read.split())
                n += read != bare
        return out, n


def features(words: set[str]) -> set[str]:
    """Words, and the beginnings of longer ones."""
    out = set(words)
    for w in words:
        if len(w) > 5:
            out.add(w[:4] + "-")
            out.add(w[:5] + "-")
    return out


def held_out(doc_id):
    """Whether crc32 of the id as text is 0 modulo 5; a null id counts as empty text, so it is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def counted(docs: DataFrame, restorer: np.ndarray, only=None) -> dict[str, tuple[int, int]]:
    """feature -> (toxic rows, rows) over docs (text, toxic), of the features in only if given."""
    spark = docs.sparkSession
    model, wanted = spark.sparkContext.broadcast(restorer), spark.sparkContext.broadcast(only)

    def run(parts):
        r, keep = Restorer(model.value), wanted.value
        bad, all_ = Counter(), Counter()

        def flush():
            out = pd.DataFrame({"f": pd.Series(list(all_), dtype=object), "bad": [bad[k] for k in all_], "n": list(all_.values())})
            bad.clear()
            all_.clear()
            return out

        for p in parts:
            for text, toxic in zip(p["text"], p["toxic"], strict=True):
                f = features(r.words(text)[0])
                f = f & keep if keep is not None else f
                all_.update(f)
                if toxic:
                    bad.update(f)
            if len(all_) > 60_000:
                yield flush()
        if all_:
            yield flush()

    got = docs.select("text", "toxic").mapInPandas(tidy(run), "f string, bad long, n long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    # as Arrow: rows of Python objects would take many times the driver's memory
    table_ = got.where(F.col("bad") >= LEAST_COUNT).toArrow()
    out = dict(zip(table_.column("f").to_pylist(), zip(table_.column("bad").to_pylist(), table_.column("n").to_pylist(), strict=True), strict=True))
    model.destroy()
    wanted.destroy()
    return out


def ratio(bad: int, n: int, all_bad: int, rows: int) -> float:
    """The log-likelihood ratio statistic of a feature, positive if it leans to toxic rows."""
    table_ = ((bad, all_bad - bad), (n - bad, rows - all_bad - n + bad))
    g = 0.0
    for i in (0, 1):
        for j in (0, 1):
            e = sum(table_[i]) * (table_[0][j] + table_[1][j]) / max(rows, 1)
            if table_[i][j] > 0 and e > 0:
                g += 2 * table_[i][j] * math.log(table_[i][j] / e)
    return g if bad * rows > n * all_bad else -g


def logistic(at: np.ndarray, of: np.ndarray, y: np.ndarray, n: int, rounds: int = 400, rate: float = 2.0, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over sparse binary rows, by Adagrad on all rows: feature at[i] is active in row of[i]."""
    w, b, gw, gb = np.zeros(n), 0.0, np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(of, w[at], minlength=len(y))
        e = (1 / (1 + np.exp(-z)) - y) / max(1, len(y))
        g = np.bincount(at, e[of], minlength=n) + decay * w
        gw += g * g
        w -= rate * g / np.sqrt(gw) * 0.1
        gb += e.sum() ** 2
        b -= rate * e.sum() / math.sqrt(gb) * 0.1
    return w, b


class Model:
    """What scoring needs: the language model, features with weights, and the bias."""

    def __init__(self, language: np.ndarray, weights: dict[str, float], bias: float):
        self.language, self.weights, self.bias = language, weights, bias

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in features(words))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic).

    The character model is counted over every document. The classifier sees at
    most max_labelled labelled rows, and none whose crc32(doc_id) mod 5 is 0;
    equal texts are one row. Without labelled rows every score is 0.5 less a hair.
    """
    spark = docs.sparkSession
    language = language_model(trigram_counts(docs))
    train = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").where("text is not null")
    rows = cut(rows.groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), (F.avg("toxic") >= 0.5).alias("toxic")))
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0))).first()
    if not bad:
        return Model(language, {}, -1e-6)
    some = set(counted(rows.where("toxic"), language))
    g = {f: ratio(b, k, bad, n) for f, (b, k) in counted(rows, language, some).items()}
    chosen = sorted((f for f in g if g[f] >= LEAST_G), key=lambda f: (-g[f], f))[:MAX_FEATURES]
    place = {f: i for i, f in enumerate(chosen)}
    lm, where = spark.sparkContext.broadcast(language), spark.sparkContext.broadcast(place)

    def active(parts):
        r, at = Restorer(lm.value), where.value
        for p in parts:
            found = [sorted(at[f] for f in features(r.words(t)[0]) if f in at) for t in p["text"]]
            yield pd.DataFrame({"key": p["key"].astype(object), "toxic": p["toxic"], "at": found})

    got = rows.mapInPandas(tidy(active), "key string, toxic boolean, at array<int>").toArrow().sort_by("key").combine_chunks()
    lm.destroy()
    where.destroy()
    active_at = got.column("at").combine_chunks()
    sizes = np.asarray(pc.list_value_length(active_at).fill_null(0), np.int64)
    y = np.asarray(got.column("toxic").cast("int8").to_numpy(), float)
    w, b = logistic(np.asarray(active_at.flatten(), np.int64), np.repeat(np.arange(len(y)), sizes), y, len(chosen))
    return Model(language, {f: float(w[i]) for f, i in place.items()}, float(b))


def scorer(spark: SparkSession, model: Model):
    """A function of a text column to (score, n_restored)."""
    bc = spark.sparkContext.broadcast(model)

    def batches(parts):
        m = bc.value
        restorer = Restorer(m.language)
        for text in parts:
            out = []
            for t in text:  # one text's words at a time
                w, n = restorer.words(t)
                out.append((m.score(w), n))
            yield pd.DataFrame(out, columns=["score", "n_restored"]).astype({"score": "float64", "n_restored": "int64"})

    @F.pandas_udf("score double, n_restored long")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(batches)(parts)

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, predicted and n_restored, one row for each.

    Null and empty texts have no features and get the score of the bias; equal
    texts get equal scores; null ids make no difference; an empty table gives an
    empty result; columns named like the result's are replaced.
    """
    at = unused(docs, "t_scored")
    out = docs.withColumn(at, scorer(docs.sparkSession, model)("text"))
    columns = [c for c in docs.columns if c not in ("score", "predicted", "n_restored")]
    return out.select(*columns, F.col(f"{at}.score").alias("score"), (F.col(f"{at}.score") >= 0.5).cast("int").alias("predicted"), F.col(f"{at}.n_restored").alias("n_restored"))


def clean_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject; nulls, repeated rows and empty tables as in score(), any column names."""
    at = unused(docs, "t_scored")
    out = docs.withColumn(at, scorer(docs.sparkSession, model)("text")).where(F.col(f"{at}.score") < 0.5)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_restored")
