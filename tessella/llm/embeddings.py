"""Near-duplicate embeddings by a random-projection tree forest.

Every tree splits the unit sphere recursively: a node projects the vectors on a
random direction and sends those below the median left and those above it
right; vectors within SPILL of the median go both ways. The trees are fitted on
a bounded sample, so they are small enough to be sent to every task; all vectors
are then routed through them. A leaf with too many vectors for a task is split
again, in rounds that find the median of all its vectors. Vectors are compared
within leaves in double precision, links are verified there, and components are
the union over trees.

A pair that meets in several leaves is counted only in the first of them: each
vector carries the list of its leaves, so a leaf can tell.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, cut, cut_measured, discard

TREES = 4
#: Half width of the band around a split whose vectors go both ways; unit vectors with
#: cosine 0.95 are 0.316 apart, and 0.04 of that, times sqrt(64 / dimensions), falls along a random direction.
SPILL = 0.02
#: Vectors that the trees are fitted on, at most; and sample vectors in a leaf, at most.
SAMPLE, LEAF = 20_000, 100
#: Vectors of one leaf that a task holds at once from either side: so many bytes of them in double
#: precision, but BLOCK vectors at least. Every vector is sent once to each pair of blocks it is in.
BLOCK, BLOCK_BYTES = 1_200, 5 << 20
#: Vectors of a leaf above which it is split again, by the median of all its vectors, and
#: bytes of the sample in double precision, at most.
MAX_LEAF, SAMPLE_BYTES = 20_000, 64 << 20
#: A leaf stays as it is if a child would hold more than this share of it.
LEAST_GAIN = 0.9
COSINE = 0.95
#: Vectors routed at once by a task.
ROUTED = 500
#: Pairs of a block's part up to which they are judged one by one.
FEW_HITS = 20_000


def padded(vectors, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of one matrix, zeros after shorter ones, and their lengths."""
    n = np.fromiter(map(len, vectors), np.int64, len(vectors))
    width = int(n.max(initial=0)) if dims is None else dims
    if len(n) and (n == width).all():
        return np.stack(vectors), n
    out = np.zeros((len(n), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out, n


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow or underflow."""
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Tree:
    """Directions and thresholds of the inner nodes, and where each child leads (leaves are negative)."""

    def __init__(self, sample: np.ndarray, seed: int, leaf: int = LEAF, spill: float = SPILL, code: int = 0):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.spill = spill * (64 / dims) ** 0.5
        self.directions, self.thresholds, self.children = [], [], []
        self.leaves = 0
        stack = [(sample, None)]
        while stack:
            rows, slot = stack.pop()
            if len(rows) <= leaf:
                here = -(self.leaves + 1)
                self.leaves += 1
            else:
                d = rng.standard_normal(dims)
                d /= np.linalg.norm(d)
                x = rows @ d
                t = float(np.median(x))
                if not (x <= t - self.spill).any() or not (x > t + self.spill).any():
                    here = -(self.leaves + 1)  # too tight to split
                    self.leaves += 1
                else:
                    here = len(self.thresholds)
                    self.directions.append(d)
                    self.thresholds.append(t)
                    self.children.append([0, 0])
                    stack += [(rows[x <= t], (here, 0)), (rows[x > t], (here, 1))]
            if slot is None:
                self.root = here
            else:
                self.children[slot[0]][slot[1]] = here

    def route(self, v: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of v in it) for every leaf that is reached."""
        out, stack = [], [(self.root, np.arange(len(v)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((-node - 1, rows))
                continue
            x = v[rows] @ self.directions[node] - self.thresholds[node]
            stack.append((self.children[node][0], rows[x <= self.spill]))
            stack.append((self.children[node][1], rows[x > -self.spill]))
        return out


def fit(vectors: DataFrame, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, spill: float = SPILL) -> list[Tree]:
    """A forest from the vectors with the smallest hash of their id, at most `sample` of them and SAMPLE_BYTES."""
    dims = vectors.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return []
    n = max(1, min(sample, SAMPLE_BYTES // (8 * dims)))
    rows = vectors.select("v_id", "v").orderBy(F.xxhash64("v_id"), "v_id").limit(n).select("v").toArrow()
    x = unit(padded([a.as_py() if a is None else np.asarray(a.values, np.float64) for a in rows.column("v")], dims)[0])
    return [Tree(x, seed, leaf, spill) for seed in range(trees)]


def clean(table: DataFrame) -> DataFrame:
    """table (vec_id, embedding) with usable: an id, no null and no non-finite component, not zero."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", (F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).alias("usable"))


def routed(reps: DataFrame, forest: list[Tree]) -> DataFrame:
    """(leaf, v_id, copies, v, leaves) for every leaf a vector reaches; leaves are numbered through the forest."""
    bc = reps.sparkSession.sparkContext.broadcast(forest)

    def run(parts):
        trees = bc.value
        base = np.concatenate([[0], np.cumsum([t.leaves for t in trees])])
        for p in (q.iloc[i : i + ROUTED] for q in parts for i in range(0, len(q), ROUTED)):
            v = unit(padded(p["v"].to_numpy(), len(trees[0].directions[0]) if trees[0].directions else None)[0])
            own: list[list[int]] = [[] for _ in range(len(p))]
            hits = []
            for k, t in enumerate(trees):
                for leaf, rows in t.route(v):
                    code = int(base[k] + leaf)
                    hits.append((code, rows))
                    for r in rows:
                        own[r].append(code)
            leaves = np.empty(len(p), object)
            leaves[:] = [sorted(x) for x in own]
            at = np.concatenate([r for _, r in hits])
            yield pd.DataFrame({"leaf": np.repeat([c for c, _ in hits], [len(r) for _, r in hits]), "v_id": p["v_id"].to_numpy()[at], "copies": p["copies"].to_numpy()[at], "v": p["v"].to_numpy()[at], "leaves": leaves[at]})

    return reps.mapInPandas(run, f"leaf long, v_id long, copies long, v {dict(reps.dtypes)['v']}, leaves array<bigint>")


def projected(table: DataFrame, dims: int) -> DataFrame:
    """table with x, the component of each vector along the direction that belongs to its leaf."""

    def run(parts):
        directions: dict[int, np.ndarray] = {}
        for p in parts:
            for i in range(0, len(p), ROUTED):
                q = p.iloc[i : i + ROUTED]
                v, x = unit(padded(q["v"].to_numpy(), dims)[0]), np.zeros(len(q))
                leaf = q["leaf"].to_numpy()
                for c in np.unique(leaf):
                    if c not in directions:
                        if len(directions) > 1000:
                            directions.clear()
                        d = np.random.default_rng(int(c) & (1 << 63) - 1).standard_normal(dims)
                        directions[c] = d / np.linalg.norm(d)
                    x[leaf == c] = v[leaf == c] @ directions[c]
                yield q.assign(x=x)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInPandas(run, kinds + ", x double")


def refined(table: DataFrame, dims: int, max_leaf: int, spill: float) -> DataFrame:
    """table with leaves of at most max_leaf vectors, but for those too dense to split.

    Each round projects the vectors of all larger leaves on a new direction,
    takes the median of each leaf, and sends vectors near it both ways."""
    columns, near = table.columns, spill * (64 / dims) ** 0.5
    done, work = [], table
    while True:
        large = work.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_leaf)
        large, seen = cut_measured(large, F.count(F.lit(1)).alias("rows"))
        if not seen["rows"]:
            break
        done.append(work.join(large, "leaf", "left_anti"))
        x = cut(projected(work.join(large, "leaf", "left_semi").select(*columns), dims))
        middle = cut(x.groupBy("leaf").agg(F.percentile_approx("x", 0.5, 1000).alias("t"), F.count(F.lit(1)).alias("n")))
        sides = F.array_compact(F.array(F.when(F.col("x") <= F.col("t") + near, 0), F.when(F.col("x") > F.col("t") - near, 1)))
        y = cut(x.join(middle, "leaf").select(*columns, "n", F.explode(sides).alias("side")))
        most = y.groupBy("leaf", "n", "side").agg(F.count(F.lit(1)).alias("m")).groupBy("leaf", "n").agg(F.max("m").alias("m"))
        split = cut(most.where(F.col("m") <= LEAST_GAIN * F.col("n")).select("leaf"))
        done.append(x.join(split, "leaf", "left_anti").select(*columns))
        work = cut(y.join(split, "leaf", "left_semi").withColumn("leaf", F.xxhash64("leaf", "side")).select(*columns))
    if not done:
        return table
    for d in done:
        work = work.unionByName(d)
    own = cut(work.groupBy("v_id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")))
    return work.drop("leaves").join(own, "v_id").select(*columns)


def met_before(left: list, right: list, leaf: int) -> np.ndarray:
    """Which vectors of two lists (of each vector's leaves) share a leaf earlier than leaf."""
    sets = [{int(c) for x in rows for c in x if c < leaf} for rows in (left, right)]
    codes, out = sorted(sets[0] & sets[1]), np.zeros((len(left), len(right)), bool)
    for s in range(0, len(codes), 1000):
        at = {c: k for k, c in enumerate(codes[s : s + 1000])}
        marks = []
        for rows in (left, right):
            m = np.zeros((len(rows), len(at)), np.float32)
            for i, x in enumerate(rows):
                m[i, [at[c] for c in x if c in at]] = 1
            marks.append(m)
        out |= marks[0] @ marks[1].T > 0
    return out


def components(n: int, ends: np.ndarray) -> np.ndarray:
    """The least node reachable from each of n nodes, given links as two rows of ends."""
    label = np.arange(n)
    if not ends.shape[1]:
        return label
    u, v = np.concatenate([ends, ends[::-1]], axis=1)
    order = np.argsort(u, kind="stable")
    u, v = u[order], v[order]
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    while True:
        new = label.copy()
        new[u[first]] = np.minimum(label[u[first]], np.minimum.reduceat(label[v], first))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(table: DataFrame, cosine: float, dims: int) -> DataFrame:
    """(v_id, n, low) from each pair of blocks of each leaf: the copies linked there
    first, and the least id of its component there."""
    size = table.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / max(BLOCK, BLOCK_BYTES // (8 * dims))).cast("int")
    t = table.join(size, "leaf").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("v_id"), "blocks").cast("int"))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    t = t.select("leaf", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "v_id", "copies", "v", "leaves")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = int(g["leaf"].iloc[0]), int(g["i"].iloc[0]), int(g["j"].iloc[0])
        g = g.sort_values("v_id")
        left, right = g[g["mine"] == i], g[g["mine"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"v_id": [], "n": [], "low": []}).astype("int64")
        both, lengths = padded([*left["v"], *right["v"]])
        both = unit(both)
        x, y, nx, ny = both[: len(left)], both[len(left) :], lengths[: len(left)], lengths[len(left) :]
        ragged = (lengths != lengths[0]).any()
        lists = (left["leaves"].tolist(), right["leaves"].tolist())
        earlier = functools.cache(lambda side, k: frozenset(c for c in lists[side][k] if c < leaf))
        ids = np.concatenate([left["v_id"].to_numpy(), right["v_id"].to_numpy() if i != j else []]).astype(np.int64)
        copies = np.concatenate([left["copies"].to_numpy(), right["copies"].to_numpy() if i != j else []]).astype(np.int64)
        shift = len(left) if i != j else 0
        n, ends = np.zeros(len(ids), np.int64), [np.zeros((2, 0), np.int32)]
        x4, y4 = x.astype(np.float32), y.astype(np.float32).T
        # single precision is off by less than this, so it only spares pairs that can't be linked
        slack = 1e-6 + 2.5e-7 * x.shape[1]
        for s in range(0, len(x), 512):
            off = 0 if shift else s  # pairs of one block are met once
            r, c = np.nonzero(x4[s : s + 512] @ y4[:, off:] >= cosine - slack)
            if len(r) <= FEW_HITS:
                good = np.einsum("ij,ij->i", x[s + r], y[off + c]) >= cosine
                r, c = r[good], c[good]
            else:
                r, c = np.nonzero(x[s : s + 512] @ y[off:].T >= cosine)
            r, c = r + s, c + off
            good = ids[r] != ids[shift + c] if shift else r < c
            if ragged:
                good &= nx[r] == ny[c]
            r, c = r[good], c[good]
            if not len(r):
                continue
            ends.append(np.stack([r, c + shift]).astype(np.int32))
            if len(r) <= FEW_HITS:
                new = np.fromiter((earlier(0, p).isdisjoint(earlier(1, q)) for p, q in zip(r.tolist(), c.tolist(), strict=True)), bool, len(r))
            else:
                new = ~met_before(lists[0][s : s + 512], lists[1], leaf)[r - s, c]
            r, c = r[new], c[new] + shift
            n += np.bincount(r, copies[c], len(n)).astype(np.int64) + np.bincount(c, copies[r], len(n)).astype(np.int64)
        low = components(len(ids), np.concatenate(ends, axis=1))
        got = np.flatnonzero((n > 0) | (low < np.arange(len(ids))) | np.isin(np.arange(len(ids)), low[low < np.arange(len(ids))]))
        return pd.DataFrame({"v_id": ids[got], "n": n[got], "low": ids[low[got]]})

    return t.groupBy("leaf", "i", "j").applyInPandas(run, "v_id long, n long, low long")


def near_duplicate_vectors(table: DataFrame, cosine: float = COSINE, max_leaf: int = MAX_LEAF, spill: float = SPILL, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding).

    Vectors are linked if their cosine in double precision is at least cosine;
    n_links counts the other rows linked directly, component_id is the smallest
    vec_id reachable, kept marks rows that are their own component. Exact copies
    are one class while trees are searched and count with all their rows after.
    Vectors of different lengths are never linked.

    Null, zero and non-finite vectors and null ids are linked with nothing: 0
    links and their own component (null for a null id, and kept), whatever other
    rows have their id. Rows are separate vectors, also where they share an id;
    rows that repeat an id and vector are each other's copies. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = clean(table)
    good = cut(rows.where("usable").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v")))
    classes = good.groupBy("v").agg(F.min("row_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumn("v_id", F.monotonically_increasing_id()))
    forest = fit(classes, spill=spill, **options)
    if not forest:
        found = cut(classes.select("v_id", F.lit(0).cast("long").alias("n"), F.col("v_id").alias("low")).limit(0))
    else:
        leaves = cut(routed(classes.drop("low"), forest))
        dims = classes.agg(F.max(F.size("v"))).first()[0]
        found = cut(linked(refined(leaves, dims, max_leaf, spill), cosine, dims))
        discard(leaves)
    per = cut(found.groupBy("v_id").agg(F.sum("n").alias("n")))
    edges = found.where("v_id <> low").select(F.col("v_id").alias("a"), F.col("low").alias("b"))
    component = cut(connected_components(edges))
    named = classes.select("v_id", "low", "copies").join(component, F.col("v_id") == F.col("node"), "left").select("v_id", "low", "copies", F.coalesce("component", "v_id").alias("c"))
    named = cut(named.join(per, "v_id", "left"))
    least = cut(named.groupBy("c").agg(F.min("low").alias("component_id")))
    named = cut(named.join(least, "c").select("v_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    at = cut(classes.select("v", "v_id").join(named, "v_id").select("v", "n_links", "component_id"))
    out = good.join(at, "v").select(F.col("row_id").alias("vec_id"), "n_links", "component_id")
    out = out.unionByName(rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id").isNull() | (F.col("component_id") == F.col("vec_id"))).alias("kept"))


def op8_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def planted_query(spark, sf_dir: str) -> DataFrame:
    """The operator over all embeddings and two partners of each, one above the
    limit and one below: the tables themselves hold no pair that reaches it."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    moved = lambda k, by: v.select((F.col("vec_id") + F.lit(k)).alias("vec_id"), F.transform("embedding", lambda x, i: x * F.when(i % 2 == 0, 1.0).otherwise(by)).alias("embedding"))
    return near_duplicate_vectors(v.unionByName(moved(1 << 40, 0.75)).unionByName(moved(1 << 41, 0.125)))


SQL = r"""
pairs as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (
  select vec_id as id, vec_id as c from v
  union
  select p.b, r.c from reach r join pairs p on p.a = r.id),
comp as (select id, min(c) as c from reach group by id)
select v.vec_id, (select count(*) from pairs where pairs.a = v.vec_id)::bigint as n_links, c as component_id, c = v.vec_id as kept
from v join comp on comp.id = v.vec_id
"""
ORACLE_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),""" + SQL
PLANTED_SQL = """
with recursive o as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
v as (
  select * from o
  union all select vec_id + 1099511627776, list_transform(e, lambda x, i: x * case when i % 2 = 1 then 1.0::double else 0.75::double end) from o
  union all select vec_id + 2199023255552, list_transform(e, lambda x, i: x * case when i % 2 = 1 then 1.0::double else 0.125::double end) from o),""" + SQL
