"""Packing documents into windows by non-negative least squares.

Every document becomes token ids and an end token. Whole windows are cut from
the front of long documents; what remains of each document, shorter than a
window, is one piece. Piece lengths are rounded up to a grid and counted;
shallow combinations of grid lengths that fill a window exactly are enumerated
(pairs, triples, and repeats of one length with one filler); non-negative least
squares finds how often to repeat each so as to use up the histogram; the
repeats are rounded down and pieces are dealt to them. The residual pieces are
packed greedily: laid end to end in one stream that is cut at window ends, its
last part at powers of two, which need no padding.

The plan depends on the histogram alone, which has a fixed number of cells, so
only that ever reaches the driver. Pieces get their place in it by their rank
among the pieces of their length, found from counts per partition.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import cut, tidy

WINDOW = 4096
#: Cells of the length grid; a piece wastes less than WINDOW / GRID tokens.
GRID = 256
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
END = np.array([END_ID], "<u4").tobytes()
#: Pieces of text whose ids a worker remembers, in each of two generations.
REMEMBERED = 200_000
#: Closing punctuation after a letter of ASCII or Latin-1 (without the signs of multiplication and division).
PUNCTUATION = rb"[.,;:!?#$%&*()+=~/-]"
STOP = re.compile(rb"(%b(?:(?<=[a-z].)|(?<=\xC3[\x80-\x96\x98-\xB6\xB8-\xBF].))%b*)(?=[\x20\x09-\x0D]|\Z)" % (PUNCTUATION, PUNCTUATION))
#: A special token, which the tokenizer takes out of a text before all else.
BETWEEN = "<|endoftext|>"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts, end token included.

    The tokenizer lower-cases, and treats runs of letters between ASCII white
    space or before closing punctuation one by one, so ids are remembered by
    such pieces, in two generations of bounded size. Unknown pieces are encoded
    together: those made of letters alone are told apart by the tokens that end
    a word, the others by a special token between them. Texts that may hold a
    special token themselves are encoded as they are.
    """

    def __init__(self, path: str):
        self.tok, self.new, self.old = tokenizer(path), {}, {}
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.between = vocabulary[BETWEEN]

    def learn(self, missing: list[bytes]) -> None:
        if len(self.new) + len(missing) > REMEMBERED:
            self.old, self.new = self.new, {}
        unknown = []
        for w in missing:
            ids = self.old.get(w)
            if ids is None:
                unknown.append(w)
            else:
                self.new[w] = ids
        plain, other = [], []
        for w in unknown:
            s = w.decode()
            (plain if s.isalpha() else other).append((w, s))
        for i in range(0, len(plain), 2000):
            other += self.learn_joined(plain[i : i + 2000], " ", False)
        alone = []
        for i in range(0, len(other), 2000):
            alone += self.learn_joined(other[i : i + 2000], BETWEEN, True)
        if alone:
            for (w, _), e in zip(alone, self.tok.encode_batch_fast([s for _, s in alone], add_special_tokens=False), strict=True):
                self.new[w] = np.array(e.ids, "<u4").tobytes()

    def learn_joined(self, part: list[tuple[bytes, str]], by: str, special: bool) -> list[tuple[bytes, str]]:
        """Encode pieces as one text; if its ids can't be told apart, return all of them."""
        ids = np.array(self.tok.encode_batch_fast([by.join([s for _, s in part] + [""] * special)], add_special_tokens=False)[0].ids, "<u4")
        stop = np.flatnonzero(ids == self.between if special else self.ends[ids]) * 4
        if len(stop) != len(part):
            return part
        raw, at, skip = ids.tobytes(), 0, 4 * special
        for (w, _), e in zip(part, (stop + 4 - skip).tolist(), strict=True):
            self.new[w] = raw[at:e]
            at = e + skip
        return []

    def __call__(self, texts) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        words = [[] if "<|" in t else STOP.sub(rb" \1", t.encode("utf-8", "replace").lower()).split() for t in texts]
        found = [list(map(self.new.get, w)) for w in words]
        missing = dict.fromkeys(x for w, ids in zip(words, found, strict=True) if None in ids for x, y in zip(w, ids, strict=True) if y is None)
        if missing:
            self.learn(list(missing))
        out, get = [], self.new.get
        for t, w, ids in zip(texts, words, found, strict=True):
            if "<|" in t:
                ids = [np.array(self.tok.encode(t.encode("utf-8", "replace").decode(), add_special_tokens=False).ids, "<u4").tobytes()]
            elif None in ids:
                ids = [get(x) if y is None else y for x, y in zip(w, ids, strict=True)]
            ids.append(END)
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, which so share what it remembers."""
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def combinations(grid: int = GRID) -> np.ndarray:
    """The shallow combinations that fill a window: rows of counts by cell (1 to grid)."""
    rows = set()
    for a in range(1, grid + 1):
        for k in range(1, grid // a + 1):
            rest = grid - k * a
            rows.add(((a, k),) if not rest else tuple(sorted(((a, k), (rest, 1)))) if rest != a else ((a, k + 1),))
        for b in range(a, grid):
            c = grid - a - b
            if c >= b:
                cells: dict[int, int] = {}
                for x in (a, b, c):
                    cells[x] = cells.get(x, 0) + 1
                rows.add(tuple(sorted(cells.items())))
    out = np.zeros((len(rows), grid), np.float64)
    for i, r in enumerate(sorted(rows)):
        for x, k in r:
            out[i, x - 1] = k
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds or 3 * a.shape[0]):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * scale:
            break
        active[j] = True
        while True:
            p = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[p] = s
                break
            low = s <= 0
            step = np.min(x[p][low] / np.maximum(x[p][low] - s[low], 1e-300))
            x[p] += step * (s - x[p])
            gone = p[x[p] <= 1e-12 * scale]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def solve(histogram: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """The combinations used and how often: rounded down and never more than there are pieces."""
    combos = combinations(grid)
    possible = (combos <= histogram).all(axis=1)
    combos = combos[possible]
    if not len(combos):
        return np.zeros((0, grid), int), np.zeros(0, int)
    x = nnls(combos.T, histogram.astype(float))
    used = np.flatnonzero(x >= 1)
    used = used[np.argsort(-x[used], kind="stable")]
    left, out, times = histogram.astype(int).copy(), [], []
    for u in used:
        c = combos[u].astype(int)
        n = min(int(x[u] + 1e-9), int((left[c > 0] // c[c > 0]).min()))
        if n > 0:
            left -= n * c
            out.append(c)
            times.append(n)
    return np.array(out, int).reshape(-1, grid), np.array(times, int)


def powers(n: int) -> list[int]:
    """n as a sum of different powers of two, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class Plan:
    """Where the piece of a given cell and rank goes; the size is that of the histogram."""

    def __init__(self, histogram: np.ndarray, grid: int = GRID):
        self.combos, self.times = solve(histogram, grid)
        self.first = np.concatenate([[0], np.cumsum(self.times)]).astype(np.int64)
        self.windows = int(self.first[-1])
        # for each cell: the ranks at which its combinations start
        self.users = [np.flatnonzero(self.combos[:, c]) if len(self.combos) else np.zeros(0, int) for c in range(grid)]
        self.starts = [np.concatenate([[0], np.cumsum(self.times[u] * self.combos[u, c])]).astype(np.int64) for c, u in enumerate(self.users)]

    def place(self, cell: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, slot) by rank; window -1 for residual pieces. cell counts from 0."""
        s, users = self.starts[cell], self.users[cell]
        window, slot = np.full(len(rank), -1, np.int64), np.zeros(len(rank), np.int64)
        ok = rank < s[-1]
        if ok.any():
            k = np.searchsorted(s, rank[ok], "right") - 1
            u = users[k]
            inside, each = rank[ok] - s[k], self.combos[u, cell]
            window[ok] = self.first[u] + inside // each
            before = np.array([int(self.combos[x, :cell].sum()) for x in u])
            slot[ok] = before + inside % each
        return window, slot


PIECE = "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def encoded(docs: DataFrame, path: str, window: int) -> DataFrame:
    """Each document's whole windows and its last, shorter piece."""

    names = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches):
        enc = encoder(path)
        for b in batches:
            out = []
            for i in range(0, b.num_rows, 64):  # so many texts are Python strings at once
                row_id, doc_id, text = (b.column(c).slice(i, 64).to_pylist() for c in ("row_id", "doc_id", "text"))
                for r, d, ids in zip(row_id, doc_id, enc(text), strict=True):
                    out += [(r, d, s, len(x), crc(x), len(ids)) for s in range(0, len(ids), window) for x in (ids[s : s + window],)]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select("row_id", "doc_id", "text").mapInArrow(tidy(run), PIECE)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, grid: int = GRID) -> DataFrame:
    """Pieces of documents with their places: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset; every id of every row lies in exactly one.

    Null and empty texts are one end token; rows with null or equal ids are
    packed like any others; an empty table gives an empty result; other columns
    are ignored. No document is held together with another: pieces travel as
    lengths and checksums, and only documents whose last piece is cut by the
    residual stream are tokenised twice.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    wide = window // grid
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(encoded(keyed, path, window).withColumn("part", F.spark_partition_id()))
    tails = F.col("length") < window
    cells = pieces.where(tails).groupBy("part", F.ceil(F.col("length") / wide).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    whole = pieces.where(~tails).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(grid, np.int64)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        histogram[r["cell"] - 1] = r["n"]
    plan = Plan(histogram, grid)

    # ranks: counts of earlier partitions, then the order inside the partition
    earlier = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.unionByName(whole.select("part", F.lit(0).alias("cell"), "n")).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # one number for each row, not a part's whole table
    cell_of = F.when(tails, F.ceil(F.col("length") / wide)).otherwise(0).cast("int")
    placed = pieces.withColumn("cell", cell_of).join(base.select("part", "cell", "base"), ["part", "cell"])
    fixed = spark.sparkContext.broadcast(plan)
    n_whole = whole.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    kept = [c.split()[0] for c in (PIECE + ", part int, win long, slot long").split(", ")]

    def rank(parts):
        seen: dict[tuple[int, int], int] = {}
        p = fixed.value
        for x in parts:
            cell, base_ = x["cell"].to_numpy(), x["base"].to_numpy()
            order = np.zeros(len(x), np.int64)
            win, slot = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
            part = x["part"].to_numpy()
            for q in np.unique(part):
                here = np.flatnonzero(part == q)
                for c in np.unique(cell[here]):
                    at = here[cell[here] == c]
                    n = seen.get((int(q), int(c)), 0)
                    order[at] = base_[at] + n + np.arange(len(at))
                    seen[(int(q), int(c))] = n + len(at)
                    if c:
                        win[at], slot[at] = p.place(int(c) - 1, order[at])
                    else:
                        win[at] = p.windows + order[at]
            yield x.assign(doc_id=x["doc_id"].astype("Int64"), win=win, slot=slot)[kept]

    # a partition's rows stay together and in one order: dealt by part, sorted by their key
    dealt = placed.repartition("part").sortWithinPartitions("part", "row_id", "doc_id", "start")
    placed = cut(dealt.mapInPandas(rank, PIECE + ", part int, win long, slot long"))
    planned = placed.where("win >= 0")
    inside = Window.partitionBy("win").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    one = planned.select(*columns, F.col("win").alias("sequence_id"), F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))

    rest = placed.where("win < 0")
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rest.groupBy("part").agg(F.sum("length").alias("total")).withColumn("ahead", F.coalesce(F.sum("total").over(ahead), F.lit(0)))
    total = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    inner = Window.partitionBy("part").orderBy("row_id", "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    stream = rest.join(totals.select("part", "ahead"), "part").withColumn("at", F.col("ahead") + F.coalesce(F.sum("length").over(inner), F.lit(0)))
    first = plan.windows + n_whole
    edges = [total - total % window]
    for s in powers(total % window):
        edges.append(edges[-1] + s)
    last = F.array(*[F.lit(int(e)) for e in edges])

    def end(at):
        """Where the sequence that holds stream position at ends."""
        tail = F.element_at(F.filter(last, lambda e: e > at), 1)
        return F.when(at < edges[0], (F.floor(at / window) + 1) * window).otherwise(tail).cast("long")

    stream = cut(stream.withColumn("end", end(F.col("at"))))
    uncut = stream.where("at + length <= end")
    split = stream.where("at + length > end")

    def sequence(at):
        tail = F.size(F.filter(last, lambda e: e <= at)) - 1
        return F.lit(first) + F.when(at < edges[0], F.floor(at / window)).otherwise(F.lit(edges[0] // window) + tail)

    def offset(at):
        begin = F.element_at(F.filter(last, lambda e: e <= at), -1)
        return F.when(at < edges[0], at % window).otherwise(at - begin).cast("long")

    two = uncut.select(*columns, sequence(F.col("at")).alias("sequence_id"), offset(F.col("at")).alias("offset"))
    three = recut(split, keyed, path, window, edges).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence(F.col("at")).alias("sequence_id"), offset(F.col("at")).alias("offset"))
    return one.unionByName(two).unionByName(three).select(*columns, F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def recut(split: DataFrame, keyed: DataFrame, path: str, window: int, edges: list[int]) -> DataFrame:
    """The parts of pieces that the residual stream cuts, with at, their stream position."""
    rows = split.select("row_id", "start", "length", "doc_tokens", "at")
    once = keyed.join(rows.select("row_id").distinct(), "row_id", "left_semi").groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    joined = rows.join(once, "row_id")

    def run(parts):
        enc = encoder(path)
        stops = np.array(edges, np.int64)
        for p in parts:
            out = []
            for x in p.itertuples():
                ids = enc([x.text])[0][x.start : x.start + x.length]
                done = 0
                while done < len(ids):
                    at = x.at + done
                    end = (at // window + 1) * window if at < edges[0] else int(stops[np.searchsorted(stops, at, "right")])
                    n = min(len(ids) - done, end - at)
                    part = ids[done : done + n]
                    out.append((None if pd.isna(x.doc_id) else int(x.doc_id), x.start + done, n, crc(part), x.doc_tokens, at))
                    done += n
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "at"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return joined.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, at long")


def op5_query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
