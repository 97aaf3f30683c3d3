"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word pairs. Its sketch has M registers,
each the truncated, exponentially spaced minimum of a hash over the set:
K = floor(1 - log_B(h)), h exponentially distributed with rate A per element.
Registers of two sets merge by their maximum, and equal registers are the more
likely the more similar the sets are, so bands of registers are hashed to find
candidates. A candidate's similarity is first estimated jointly from the counts
of smaller, larger and equal registers by maximum likelihood; what the estimate
cannot rule out is verified on the full sets.

Documents with the same words in the same order are one class before anything
else. Classes that share a band are compared with a pivot of the band first;
where that leaves a band with more than one component, the classes outside the
band's largest component are compared with all the others of the band, block by
block, so no link between different texts that share a band is lost, and no
band is expanded into all its pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, cut, cut_measured, discard, tidy

BANDS, ROWS = 40, 6
M = BANDS * ROWS
#: Base, rate and last value of the registers: 16 bits each.
BASE, RATE, TOP = 1.001, 20.0, 65_534
THRESHOLD = 0.8
#: Estimates below this are ruled out: six standard errors under the threshold.
ESTIMATE = THRESHOLD - 6 * (THRESHOLD * (1 - THRESHOLD) / M) ** 0.5
#: Members of a band that one task compares with another block of it.
BLOCK = 256
#: Blocks that the partners of one leader are dealt to.
DEALT = 64
#: Rounds in which the members of a band are compared with one pivot each.
PIVOTS = 2
#: Words per shingle of the operator in general; the query asks for two.
SHINGLE = 5

def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def coefficients() -> tuple[np.ndarray, np.ndarray]:
    seed = (mixed(np.arange(1, 2 * M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return seed[:M] | np.uint32(1), seed[M:]


@lru_cache(maxsize=50_000)
def word_hash(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased and nothing else."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's k-word shingles, sorted."""
    w = split_words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hash, w), np.uint64, len(w))
    size = min(k, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(w) - size + 1 + i])
    return np.unique(out)


def minima(x: np.ndarray) -> np.ndarray:
    """The least value of each of M hash functions over the set x, in chunks of bounded memory."""
    a, c = coefficients()
    low = np.full(M, np.iinfo(np.uint32).max, np.uint32)
    short = (x >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 256):
        y = short[i : i + 256, None] * a
        y += c
        np.minimum(low, y.min(axis=0), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """SetSketch registers of minima of uniform 32-bit hashes."""
    u = (low.astype(np.float64) + 0.5) / 2.0**32
    k = np.floor(1.0 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    return np.clip(k, 0, TOP).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gt, lt = (a > b).sum(-1).astype(float), (a < b).sum(-1).astype(float)
    return gt, lt, a.shape[-1] - gt - lt


def slope(j, gt, lt, eq, na, nb) -> np.ndarray:
    """Derivative of the joint log-likelihood of the registers at similarity j.

    The log-likelihood n_gt log p(u - v J) + n_lt log p(v - u J) +
    n_eq log(1 - the two) is concave in J.
    """
    u, v = na / (na + nb), nb / (na + nb)
    s, ln = (BASE - 1) / BASE, np.log(BASE)
    x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    p, q = -np.log1p(-s * x) / ln, -np.log1p(-s * y) / ln
    dp, dq = -v * s / (1 - s * x) / ln, -u * s / (1 - s * y) / ln
    return gt * dp / np.maximum(p, 1e-300) + lt * dq / np.maximum(q, 1e-300) - eq * (dp + dq) / np.maximum(1 - p - q, 1e-300)


def sizes(n) -> np.ndarray:
    return np.maximum(np.asarray(n), 1).astype(float)


def estimate(a: np.ndarray, b: np.ndarray, na, nb) -> np.ndarray:
    """Maximum-likelihood similarity of each pair of rows of registers, by bisection."""
    c, na, nb = counts(a, b), sizes(na), sizes(nb)
    lo, hi = np.zeros(len(na)), np.minimum(na / nb, nb / na)
    for _ in range(40):
        j = (lo + hi) / 2
        up = slope(j, *c, na, nb) > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    return (lo + hi) / 2


def plausible(a: np.ndarray, b: np.ndarray, na, nb) -> np.ndarray:
    """Whether the estimate reaches ESTIMATE: the likelihood still rises there."""
    na, nb = sizes(na), sizes(nb)
    return (np.minimum(na / nb, nb / na) >= ESTIMATE) & (slope(ESTIMATE, *counts(a, b), na, nb) >= 0)


def sketch(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs without text, with n_shingles, text_key and registers of every row.

    text_key is a 128-bit digest of the words; it and the registers are null for an empty set."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in others]

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                n, keys, regs = [], [], []
                for t in b.column("text").to_pylist():
                    x = shingle_hashes(t, shingle)
                    n.append(len(x))
                    keys.append(xxhash.xxh3_128_digest(b" ".join(split_words(t))) if len(x) else None)
                    regs.append(registers(minima(x)).tobytes() if len(x) else None)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], [*names, "n_shingles", "text_key", "registers"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "n_shingles long, text_key binary, registers binary"])
    return docs.select(*names, "text").mapInArrow(tidy(run), schema)


def banded(reps: DataFrame) -> DataFrame:
    """(band, place, id) for every band of every row of (id, registers); place counts bands from 0."""

    def run(parts):
        for p in parts:
            if not len(p):
                continue
            r = np.frombuffer(b"".join(p["registers"]), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), r.shape[:2]).copy()
            for i in range(ROWS):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + r[:, :, i])
            place = np.tile(np.arange(BANDS, dtype=np.int32), len(p))
            yield pd.DataFrame({"band": h.ravel().view(np.int64), "place": place, "id": np.repeat(p["id"].to_numpy(), BANDS)})

    return reps.select("id", "registers").mapInPandas(run, "band long, place int, id long")


class Shingles:
    """Shingle sets of texts as sorted arrays of 64-bit numbers, one for each different shingle met so far."""

    def __init__(self, k: int):
        self.k, self.number, self.longer = k, {}, {}

    def intern(self, table: dict, keys) -> np.ndarray:
        # one count for words and longer sequences, so that codes of different lengths differ
        out = []
        for x in keys:
            i = table.get(x)
            if i is None:
                i = table[x] = len(self.number) + len(self.longer) + 1
            out.append(i)
        return np.array(out, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.intern(self.number, split_words(text))
        size = min(self.k, len(w))
        out = w[: len(w) - size + 1]
        for i in range(1, size):
            out = out << np.uint64(32) | w[i : len(w) - size + 1 + i]
            if i < size - 1:
                out = self.intern(self.longer, out.tolist())
        return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def stacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), M)


def grouped(parts, keys: list[str]):
    """Frames of whole groups: of each batch of rows sorted by keys, all but the
    last group, which waits for the next batch; with the groups' first rows."""
    kept = None
    for p in parts:
        p = p if kept is None else pd.concat([kept, p], ignore_index=True)
        new = np.ones(len(p), bool)
        new[1:] = (p[keys].to_numpy()[1:] != p[keys].to_numpy()[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        if len(first):
            kept = p.iloc[first[-1] :].reset_index(drop=True)
            if first[-1]:
                yield p.iloc[: first[-1]], first
    if kept is not None and len(kept):
        yield kept, np.array([0, len(kept)])


def verified(pairs: DataFrame, table: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. table: id, text, n, registers.

    Partners of an a are dealt to blocks, so a leader of very many partners is
    spread over tasks; a row of text travels once per pair.
    """
    ends = pairs.select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.lit(DEALT)).cast("int").alias("block"), F.lit(1).alias("role"))
    ends = ends.unionByName(ends.select(F.col("a").alias("id"), "a", "block", F.lit(0).alias("role")).distinct())
    rows = ends.join(table, "id").select("a", "block", "role", "id", "text", "n", "registers")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "role", "id")

    def run(parts):
        key = lead = None
        for p in parts:
            out = []
            regs, n = stacked(p["registers"]), p["n"].to_numpy()
            for i, (a, block, role, x, text) in enumerate(zip(p["a"], p["block"], p["role"], p["id"], p["text"], strict=True)):
                if role == 0:
                    key, lead = (a, block), (regs[i].copy(), n[i], text, [])
                elif (a, block) == key and plausible(lead[0][None], regs[i][None], lead[1], n[i])[0]:
                    if not lead[3]:
                        sets = Shingles(shingle)
                        lead[3].extend((sets, sets(lead[2])))
                    if similar(lead[3][1], lead[3][0](text), percent):
                        out.append((a, x))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(tidy(run), "a long, b long").distinct()


def crossing(p: pd.DataFrame, lo: int, mid: int, hi: int, regs: np.ndarray):
    """For each query lo to mid of a band, the targets mid to hi that may be similar to
    it, are of another component and share no earlier band with it."""
    ids, comp, n, aside = p["id"].to_numpy(), p["comp"].to_numpy(), p["n"].to_numpy(), p["aside"].to_numpy()
    here = int(p["place"].iloc[lo])
    bands = regs.reshape(len(regs), BANDS, ROWS)
    for x in range(lo, mid):
        y = np.arange(mid, hi)
        y = y[(comp[y] != comp[x]) & (~aside[y] | (ids[y] > ids[x]))]
        if len(y):
            y = y[plausible(regs[x][None], regs[y], n[x], n[y])]
        if len(y):
            y = y[~(bands[y, :here] == bands[x, :here]).all(-1).any(-1)]
            if len(y):
                yield x, y


def root(of: dict, x):
    while x in of:
        x = of[x]
    return x


def residual(members: DataFrame, table: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components which still share a band.

    members: band, place, id, comp. In each band, those outside its largest component
    are compared with all the others, block by block: first by registers alone,
    then, for what has a plausible partner, on the full sets. A pair counts in
    the first band that it shares, and is left out where links of the same block
    have joined it. A task holds two blocks and emits members or links, no pairs.
    """
    size = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("big"))
    size = cut(size.select("band", F.ceil(F.col("all") / BLOCK).cast("int").alias("tbs"), F.ceil((F.col("all") - F.col("big.n")) / BLOCK).cast("int").alias("qbs"), F.col("big.comp").alias("most")))
    one = members.join(size, "band").withColumn("aside", F.col("comp") != F.col("most"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    columns = ["band", "place", "id", "comp", "aside"]
    targets = one.select(*columns, F.lit(1).alias("role"), mine("tbs").alias("tb"), span("qbs").alias("qb"))
    queries = one.where("aside").select(*columns, F.lit(0).alias("role"), mine("qbs").alias("qb"), span("tbs").alias("tb")).select(*targets.columns)
    keys = ["band", "tb", "qb"]
    both = cut(targets.unionByName(queries))
    plain, kinds = both.columns, both.schema.simpleString()[len("struct<") : -1]
    dealt = lambda d: d.repartition(*keys).sortWithinPartitions(*keys, "role", "id")

    def blocks(parts):
        for p, first in grouped(parts, keys):
            regs, role = stacked(p["registers"]), p["role"].to_numpy()
            for lo, hi in zip(first[:-1], first[1:], strict=True):
                yield p, regs, lo, lo + int((role[lo:hi] == 0).sum()), hi

    def hopeful(parts):
        for p, regs, lo, mid, hi in blocks(parts):
            some = {i for x, y in crossing(p, lo, mid, hi, regs) for i in (x, *y)}
            yield p.iloc[sorted(some)][plain]

    def linked(parts):
        for p, regs, lo, mid, hi in blocks(parts):
            sets, of, out = Shingles(shingle), {}, []
            full: dict[int, np.ndarray] = {}
            ids, text = p["id"].to_numpy(), p["text"].to_numpy()
            comp = p["comp"].to_numpy()
            for x, ys in crossing(p, lo, mid, hi, regs):
                for y in ys:
                    a, b = root(of, comp[x]), root(of, comp[y])
                    if a == b:
                        continue
                    for k in (x, y):
                        if k not in full:
                            full[k] = sets(text[k])
                    if similar(full[x], full[y], percent):
                        of[a] = b
                        out.append((ids[x], ids[y]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    light = table.select("id", "n", "registers")
    some = cut(dealt(both.join(light, "id")).mapInPandas(tidy(hopeful), kinds))
    links = cut(dealt(some.join(table, "id")).mapInPandas(tidy(linked), "a long, b long").distinct())
    discard(size, both, some)
    return links


def relabelled(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, comp) of all linked nodes, from those so far and new links: only components that new links join are searched."""
    if comp is None:
        return cut(connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("comp")))
    at = lambda c: F.coalesce(c + "_comp", c)
    own = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(c + "_comp"))
    edges = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(at("a").alias("a"), at("b").alias("b"))
    found = cut(connected_components(edges))
    known = comp.join(found, F.col("comp") == F.col("node"), "left").select("id", F.coalesce("component", "comp").alias("comp"))
    fresh = found.select(F.col("node").alias("id"), F.col("component").alias("comp")).join(comp, "id", "left_anti")
    out = cut(known.unionByName(fresh))
    discard(found, comp)
    return out


def linked_rows(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Every row of docs (doc_id, text, more columns of any names but ours) without its text, with
    n_shingles, group (of rows linked through texts; null for empty sets) and low,
    the smallest doc_id of its group and of the groups that share a doc_id with it."""
    keyed = docs.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    rows = cut(sketch(keyed, shingle))
    own = ["doc_id", "h1", "h2"]
    classes = rows.where("text_key is not null").groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), *own)).alias("rep"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    bands = banded(classes)
    # what is joined to bands is written first, so that a hot band's rows can be split
    shared = cut(bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min_by("id", F.xxhash64("id")).alias("pivot")).where("size > 1").select("band", "pivot"))
    members = cut(bands.join(shared, "band"))
    active = classes.join(members.select("id").distinct(), "id", "left_semi")
    reps = cut(active.select("id", *[F.col(f"rep.{c}").alias(f"r_{c}") for c in own]))
    same = F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("h1") == F.col("r_h1")) & (F.col("h2") == F.col("r_h2"))
    # reps grow with the data: shuffled at every size
    texts = keyed.select(*own, "text").join(reps.hint("merge"), same).groupBy("id").agg(F.first("text").alias("text"))
    table = cut(texts.join(active.select("id", "n", "registers"), "id"))
    pairs = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    comp, done, left = None, None, ()
    for turn in range(PIVOTS):
        pairs = cut(pairs if done is None else pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b").dropDuplicates(["x", "y"]).join(done, ["x", "y"], "left_anti").select("a", "b"))
        done = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        comp = relabelled(comp, cut(verified(pairs, table, shingle, percent)))
        # open bands: those with members of more than one component
        known = members.join(comp, "id", "left").select("band", "place", "id", F.coalesce("comp", "id").alias("comp"))
        split = cut(known.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band"))
        open_, seen = cut_measured(known.join(split, "band", "left_semi"), F.count(F.lit(1)).alias("n"))
        left = (*left, open_)
        if not seen["n"]:
            break
        # the next pivot is of another component than the least
        other = open_.join(cut(open_.groupBy("band").agg(F.min("comp").alias("least"))), "band").where("comp <> least")
        pivot = cut(other.groupBy("band").agg(F.min_by(F.struct("id", "comp"), F.xxhash64("id", F.lit(turn))).alias("p")))
        pairs = open_.join(pivot, "band").where(F.col("comp") != F.col("p.comp")).select(F.col("p.id").alias("a"), F.col("id").alias("b"))
    else:
        comp = relabelled(comp, residual(open_, table, shingle, percent))
    named = classes.select("text_key", "id").join(comp, "id", "left").select("text_key", F.coalesce("comp", "id").alias("group"))
    out = rows.drop("registers", "h1", "h2").join(cut(named), "text_key", "left").drop("text_key")
    out = cut(out)
    # groups that share a doc_id have one smallest doc_id
    some = out.where("doc_id is not null and group is not null")
    twice, seen = cut_measured(some.groupBy("doc_id").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b"), F.count(F.lit(1)).alias("n"))
    low = some.groupBy("group").agg(F.min("doc_id").alias("low"))
    if seen["n"]:
        edges = some.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("group").alias("b"))
        over = cut(connected_components(edges))
        low = low.join(over, F.col("group") == F.col("node"), "left").select("group", F.coalesce("component", "group").alias("top"), "low")
        least = cut(low.groupBy("top").agg(F.min("low").alias("least")))
        low = low.join(least, "top").select("group", F.col("least").alias("low"))
    out = out.join(cut(low), "group", "left")
    discard(rows, classes, shared, members, reps, table, *left)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs.

    Two documents are linked if percent of the union of their shingle sets is
    shared; component_id is the smallest doc_id reachable, and kept marks the
    documents that are their own component. A document with fewer words than a
    shingle has its whole sequence as its one shingle; null and empty texts have
    none and are linked with nothing. Rows with one doc_id count as one node,
    with the links of all their texts. A null doc_id is reported with a null
    component and kept. An empty table gives an empty result; other columns are
    ignored.
    """
    out = linked_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, percent)
    named = F.when(F.col("doc_id").isNotNull(), F.least("doc_id", "low"))
    least = cut(out.select("doc_id", named.alias("c"))).where("doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("component_id"))
    out = out.select("doc_id", "n_shingles").join(cut(least), "doc_id", "left")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("component_id") == F.col("doc_id"))).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each group of near-duplicates: that with the smallest doc_id.

    Rows are linked through their texts alone, whatever their ids. Of a group's
    rows with the smallest doc_id (a null one is the greatest) that with the least
    hash of all its columns stays, so the choice is the same each time; rows that
    agree in all columns count as one. Null and empty texts are in no group and
    all stay. An empty table gives an empty result; extra columns are kept,
    whatever their names.
    """
    every = [F.isnull(F.col(f"`{c}`")) for c in docs.columns] + [F.col(f"`{c}`") for c in docs.columns]
    k1, k2 = F.xxhash64(*every), F.xxhash64(F.lit(1), *every)
    rows = linked_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", k1.alias("k1"), k2.alias("k2")), shingle, percent)
    first = rows.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k1", "k2")).alias("s"))
    wanted = cut(first.select(F.col("s.k1").alias("k1"), F.col("s.k2").alias("k2")))
    # nested, so that no name of docs can clash
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    kept = held.where("worded").join(wanted, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("doc")
    out = kept.unionByName(held.where("not worded").select("doc"))
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op2_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, list_distinct(case when len(ws) >= 2 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) else ws end) as ss from w),
e as (select doc_id, len(ss) as n, unnest(ss) as sh from s),
pairs as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.sh = b.sh and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reach as (
  select doc_id as id, doc_id as c from s
  union
  select l.b, r.c from reach r join links l on l.a = r.id),
comp as (select id, min(c) as c from reach group by id)
select s.doc_id, len(ss)::bigint as n_shingles, c as component_id, c = s.doc_id as kept from s join comp on comp.id = s.doc_id
"""
