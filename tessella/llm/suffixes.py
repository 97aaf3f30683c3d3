"""Exact substring deduplication by external induced suffix sorting.

Bytes covered by a 200-byte string that also starts elsewhere are removed. Two
places of one string agree in its minimiser, the hash-least 40-byte seed inside
it, and in the seed's distance from the start. So the corpus is cut into shards
by seed: what lies around the places of one seed, up to a string's length to
either side, goes to one shard, and only seeds that occur twice matter.
Surroundings that are equal as a whole are found by hash and settled at once;
the different ones are suffix-sorted in their shard.

A shard is sorted by induction: its LMS suffixes are named and sorted, then all
suffixes are induced from them by queues, one for each first byte, in which
suffixes arrive in order. Queues hold batches of suffixes and spill to disk
beyond a bound. The common prefixes of neighbours in the sorted order, cut off at
200, give the classes of equal strings.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, discard

LENGTH, SEED = 200, 40
#: Bytes scanned at once, bytes of a shard sorted at once, bytes of a queue held in memory, and bytes compared at once.
CHUNK, SHARD, HELD, COMPARED = 1 << 20, 4 << 20, 8 << 20, 1 << 20
LOW = (1 << 22) - 1


def odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C15
POWERS = odd_powers(BASE, (CHUNK << 1) + 1)
INVERSES = odd_powers(pow(BASE, -1, 1 << 64), (CHUNK << 1) + 1)


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


class Rolling:
    """64-bit hashes of any substrings of a byte array, by sums of powers modulo 2**64."""

    def __init__(self, x: np.ndarray):
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * INVERSES[: len(x)], out=self.sums[1:])

    def __call__(self, lo, hi) -> np.ndarray:
        return scrambled((self.sums[hi] - self.sums[lo]) * POWERS[lo])


def minimisers(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, Rolling]:
    """Places of the least seed (the leftmost of equals) of every window that lies in one document."""
    roll = Rolling(x)
    n = len(x) - seed + 1
    width = length - seed + 1
    if n < width:
        return np.empty(0, np.int64), roll
    at = np.arange(n)
    key = (roll(at, at + seed) & ~np.uint64(LOW)) | at.astype(np.uint64)
    pad = np.concatenate([key, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(pad, 1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    ok = np.zeros(len(x) + 1, np.int32)
    whole = ends - starts >= length
    np.add.at(ok, starts[whole], 1)
    np.add.at(ok, ends[whole] - length + 1, -1)
    inside = np.cumsum(ok)[: len(least)] > 0
    return np.unique((least[inside] & np.uint64(LOW)).astype(np.int64)), roll


def around(pos, start, end, length: int = LENGTH, seed: int = SEED):
    """The surroundings of a seed: all windows of its document that hold it."""
    return np.maximum(start, pos + seed - length), np.minimum(end, pos + length)


def pieces(texts: list[bytes]):
    """(first text, offset in it, bytes array, starts, ends) of chunks of texts; longer texts are cut with overlap."""
    lot, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            if lot:
                yield first, 0, lot
            step = CHUNK - 2 * LENGTH
            for o in range(0, len(t), step):
                yield i, o, [t[o : o + CHUNK]]
                if o + CHUNK >= len(t):
                    break
            lot, size, first = [], 0, i + 1
            continue
        if size + len(t) > CHUNK:
            yield first, 0, lot
            lot, size, first = [], 0, i
        lot.append(t)
        size += len(t)
    if lot:
        yield first, 0, lot


def seeds_of(docs: DataFrame) -> DataFrame:
    """(seed, context, key, pos) of every minimiser; context is the hash of its surroundings."""

    def run(parts):
        for p in parts:
            for k in range(0, len(p), 256):
                q = p.iloc[k : k + 256]
                texts = [(t or "").encode("utf-8", "replace") for t in q["text"]]
                keys = q["key"].to_numpy()
                out = []
                for first, offset, lot in pieces(texts):
                    size = np.array([len(t) for t in lot], np.int64)
                    ends = np.cumsum(size)
                    starts = ends - size
                    x = np.frombuffer(b"".join(lot), np.uint8)
                    pos, roll = minimisers(x, starts, ends)
                    if not len(pos):
                        continue
                    d = np.searchsorted(ends, pos, "right")
                    if offset or offset + len(x) < len(texts[first]) and len(lot) == 1:
                        # a part of a long text: places near its inner ends belong to the neighbour, or miss surroundings
                        lo = offset + (LENGTH if offset else 0)
                        hi = offset + len(x) - (LENGTH if offset + len(x) < len(texts[first]) else 0)
                        keep = (pos + offset >= lo) & (pos + offset < hi)
                        pos, d = pos[keep], d[keep]
                        if not len(pos):
                            continue
                    a, b = around(pos, starts[d], ends[d])
                    out.append((roll(pos, pos + SEED).view(np.int64), (roll(a, b) + (pos - a).astype(np.uint64)).view(np.int64), keys[first + d], pos - starts[d] + offset))
                if out:
                    yield pd.DataFrame(dict(zip(("seed", "context", "key", "pos"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return docs.select("key", "text").mapInPandas(run, "seed long, context long, key long, pos int")


class Queue:
    """Suffixes in order of arrival, in batches; beyond HELD bytes in a temporary file."""

    def __init__(self):
        self.file, self.sizes = None, []
        self.batches: list[np.ndarray] = []

    def push(self, x: np.ndarray) -> None:
        if len(x):
            self.batches.append(x)
            self.sizes.append(len(x))
            if self.file is not None or sum(b.nbytes for b in self.batches) > HELD:
                self.file = self.file or tempfile.TemporaryFile()
                for b in self.batches:
                    self.file.write(b.tobytes())
                self.batches = []

    def take(self) -> np.ndarray:
        """All suffixes so far; the queue is empty after."""
        if self.file is not None:
            self.file.seek(0)
            held = [np.frombuffer(self.file.read(), np.int32)]
            self.file.close()
            self.file = None
        else:
            held = self.batches
        self.batches, self.sizes = [], []
        return np.concatenate(held) if held else np.empty(0, np.int32)


def dealt(s: np.ndarray, at: np.ndarray, queues: list[Queue]) -> None:
    """Push suffixes, in order, to the queues of their first signs."""
    if len(at):
        c = s[at]
        order = np.argsort(c, kind="stable")
        c, at = c[order], at[order]
        cut_ = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        for lo, hi in zip(cut_, np.r_[cut_[1:], len(c)], strict=True):
            queues[c[lo]].push(at[lo:hi])


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, signs: int) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in order. smaller: S-type."""
    stars, large, small = ([Queue() for _ in range(signs)] for _ in range(3))
    dealt(s, lms, stars)
    done: list[np.ndarray] = []
    for c in range(signs):
        here = []
        while len(x := large[c].take()):
            here.append(x)
            x = x[x > 0] - 1
            dealt(s, x[~smaller[x]], large)
        done.append(np.concatenate(here) if here else np.empty(0, np.int32))
        x = stars[c].take()
        x = x[x > 0] - 1
        dealt(s, x[~smaller[x]], large)
    out: list[np.ndarray] = []
    for c in range(signs - 1, -1, -1):
        here = []
        while len(x := small[c].take()):
            here.append(x)
            x = x[x > 0] - 1
            dealt(s, x[smaller[x]], small)
        x = done[c][::-1]
        out += [*here, x]
        x = x[x > 0] - 1
        dealt(s, x[smaller[x]], small)
    out.append(np.array([len(s) - 1], np.int32))  # the last sign is alone and least
    return np.concatenate(out)[::-1]


def types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is."""
    n = len(s)
    differs = np.r_[s[:-1] != s[1:], True]
    nxt = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    up = np.r_[s[:-1] < s[1:], True]
    return up[nxt]


def ranked(s: np.ndarray, depth: int) -> np.ndarray:
    """The order of a reduced text's suffixes by their first depth signs, by doubling."""
    rank, k = s.astype(np.int64), 1
    n = len(s)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key)
        key = key[order]
        name = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        rank, k = np.empty(n, np.int64), k * 2
        rank[order] = name
        if name[-1] == n - 1 or k >= depth or k >= n:
            return order


def suffix_array(s: np.ndarray, signs: int, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of s in order of their first depth signs; s ends with its only 0."""
    smaller = types(s)
    star = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    if len(star) < 2:
        return induce(s, smaller, star if len(star) else np.array([len(s) - 1], np.int32), signs)
    # order LMS substrings by a first induction, then name them
    order = induce(s, smaller, star, signs)
    is_star = np.zeros(len(s), bool)
    is_star[star] = True
    order = order[is_star[order]]
    end = np.empty(len(s), np.int64)
    end[star] = np.r_[star[1:], len(s) - 1] + 1
    roll = hashed(s)
    h = roll(order.astype(np.int64), end[order])
    length = end[order] - order
    name = np.cumsum(np.r_[False, (h[1:] != h[:-1]) | (length[1:] != length[:-1])])
    names = np.empty(len(s), np.int64)
    names[order] = name
    if name[-1] + 1 < len(star):
        star = star[ranked(names[star], depth // 2 + 2)]
    else:
        star = order
    return induce(s, smaller, star, signs)


def hashed(s: np.ndarray):
    sums = np.zeros(len(s) + 1, np.uint64)
    inverse, power = INVERSES, POWERS
    if len(s) >= len(INVERSES):
        inverse, power = odd_powers(pow(BASE, -1, 1 << 64), len(s) + 1), odd_powers(BASE, len(s) + 1)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * inverse[: len(s)], out=sums[1:])
    return lambda lo, hi: scrambled((sums[hi] - sums[lo]) * power[lo])


def alike(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the length signs from a equal those from b, sign by sign. Neighbours
    in the text mostly have neighbours as partners: such runs are compared once."""
    out = np.zeros(len(a), bool)
    by = np.argsort(a)
    a, b = a[by], b[by]
    heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)]) if len(a) else by
    sizes = np.diff(np.r_[heads, len(a)])
    spans = sizes + length - 1
    past = np.cumsum(spans)
    lo = 0
    while lo < len(heads):
        hi = max(lo + 1, int(np.searchsorted(past, past[lo] - spans[lo] + COMPARED, "right")))
        n, first = spans[lo:hi], heads[lo:hi]
        offset = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(offset, n)
        wrong = np.r_[0, np.cumsum(s[np.repeat(a[first], n) + step] != s[np.repeat(b[first], n) + step])]
        at = np.repeat(offset, sizes[lo:hi]) + np.arange(sizes[lo:hi].sum()) - np.repeat(first - first[0], sizes[lo:hi])
        out[by[first[0] : first[0] + len(at)]] = wrong[at + length] == wrong[at]
        lo = hi
    return out


def classes(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(class, start of each part in the joined text): for each place the class of
    the length-byte string that starts there, -1 where it leaves its part."""
    size = np.array([len(p) for p in parts], np.int64)
    # bytes count from 2; 1 ends a part and 0 the text
    text = np.frombuffer(b"\x00".join(parts), np.uint8).astype(np.int16) + 2
    ends = np.cumsum(size + 1) - 1
    text[ends[:-1]] = 1
    s = np.r_[text, 1, 0].astype(np.int16)
    starts = ends - size
    order = suffix_array(s, 258, length).astype(np.int64)
    room = np.zeros(len(s), np.int64)
    room[: len(text) + 1] = np.repeat(ends, size + 1)[: len(text) + 1] - np.arange(len(text) + 1)
    order = order[room[order] >= length]
    roll = hashed(s)
    h = roll(order, order + length)
    same = np.r_[False, h[1:] == h[:-1]]
    at = np.flatnonzero(same)
    same[at] = alike(s, order[at], order[at - 1], length)
    out = np.full(len(s), -1, np.int64)
    out[order] = np.cumsum(~same)
    return out, starts


def repeated(contexts: list[tuple[int, int, bytes]], length: int = LENGTH, seed: int = SEED) -> list[list[tuple[int, int]]]:
    """For (seed, place of the seed, surroundings): the spans of each that a string
    of another one with the same seed at the same distance covers."""
    cls, starts = classes([c for _, _, c in contexts], length)
    size = np.array([len(c) for _, _, c in contexts])
    lead = np.array([p for _, p, _ in contexts])
    _, group = np.unique(np.array([k for k, _, _ in contexts], np.int64), return_inverse=True)
    n = np.maximum(0, size - length + 1)
    of = np.repeat(np.arange(len(contexts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    # one number for seed, distance and class
    span, kinds = int(lead.max(initial=0)) + length, int(cls.max(initial=0)) + 1
    key = (group[of] * span + (lead[of] - at + length)) * kinds + cls[starts[of] + at]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    of, at = of[hit], at[hit]
    if len(of):
        new = np.r_[True, (of[1:] != of[:-1]) | (at[1:] - at[:-1] > length)]
        last = np.r_[new[1:], True]
        for i, a, b in zip(of[new].tolist(), at[new].tolist(), (at[last] + length).tolist(), strict=True):
            out[i].append((a, b))
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end
    in bytes) and kept (the remaining text bytes), one row for each row of docs.

    Null and empty texts have no bytes; equal rows remove each other's strings,
    so all of a text of 200 bytes and more; shorter texts are untouched; null
    ids make no difference; an empty table gives an empty result; other columns
    are ignored. Strings never cross documents.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    seeds = cut(seeds_of(keyed))
    kinds = seeds.groupBy("seed", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos")).alias("rep"))
    # only surroundings that occur twice are looked up again by their hash
    kinds = kinds.withColumn("context", F.when(F.col("n") > 1, F.col("context")))
    kinds = cut(kinds.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("seed"))).where("n > 1 or kinds > 1"))
    whole = seeds.join(kinds.where("n > 1").select("seed", "context"), ["seed", "context"]).select("key", "pos")
    # surroundings that differ from others of their seed go to a shard
    reps = kinds.where("kinds > 1").select("seed", "n", F.col("rep.key").alias("key"), F.col("rep.pos").alias("pos"))
    wanted = reps.groupBy("key").agg(F.collect_list(F.struct("seed", "pos", "n")).alias("at"))
    once = keyed.select("key", "text").join(wanted, "key")

    def fetch(parts):
        last = None
        for p in parts:
            for i in range(0, len(p), 64):
                out = []
                for key, text, at in zip(p["key"][i : i + 64], p["text"][i : i + 64], p["at"][i : i + 64], strict=True):
                    # the join brings equal rows in a run; of what is left of them the shard keeps one
                    if key == last:
                        continue
                    last = key
                    t = (text or "").encode("utf-8", "replace")
                    for r in at:
                        a, b = around(r["pos"], 0, len(t))
                        out.append((r["seed"], key, r["pos"], r["n"], int(a), t[int(a) : int(b)]))
                yield pd.DataFrame(out, columns=["seed", "key", "pos", "n", "start", "around"])

    schema = "seed long, key long, pos int, n long, start long, around binary"
    shards = once.mapInPandas(fetch, schema).repartition("seed").sortWithinPartitions("seed", "key", "pos")

    def sort(parts):
        lot: list[tuple] = []
        size, last = 0, (None,)

        def flush():
            spans = repeated([(x[0], x[2] - x[4], bytes(x[5])) for x in lot])
            out = [(x[1], x[4] + a, x[4] + b) for x, s in zip(lot, spans, strict=True) if x[3] == 1 for a, b in s]
            return pd.DataFrame(out, columns=["key", "a", "b"]).astype("int64")

        for p in parts:
            for x in p.itertuples(index=False, name=None):
                if x[:3] == last:
                    continue
                if x[0] != last[0] and size > SHARD:
                    yield flush()
                    lot, size = [], 0
                lot.append(x)
                size += len(x[5])
                last = x[:3]
        if lot:
            yield flush()

    ranges = shards.mapInPandas(sort, "key long, a long, b long").groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    places = whole.groupBy("key").agg(F.collect_set("pos").alias("places"))
    marks = cut(places.join(ranges, "key", "full"))
    discard(seeds, kinds)
    rows = keyed.join(marks, "key", "left").select("doc_id", "text", "places", "ranges")

    def remove(parts):
        for p in parts:
            for i in range(0, len(p), 64):
                out = []
                for d, text, places_, ranges_ in zip(*(p[c][i : i + 64] for c in ("doc_id", "text", "places", "ranges")), strict=True):
                    t = (text or "").encode("utf-8", "replace")
                    spans = [] if ranges_ is None else [(r["a"], r["b"]) for r in ranges_]
                    spans += [] if places_ is None else [tuple(map(int, around(x, 0, len(t)))) for x in places_]
                    spans = united(spans)
                    at, kept = 0, []
                    for a, b in spans:
                        kept.append(t[at:a])
                        at = b
                    kept_ = b"".join([*kept, t[at:]])
                    out.append((None if pd.isna(d) else int(d), len(t), len(t) - len(kept_), len(spans), hashlib.sha256(kept_).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept_))
                frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
                yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return rows.mapInPandas(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")


def op6_query(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
