"""Candidate generation: capped equi-joins, rare and soft tokens, similarity retrieval.

Every blocker is a function of (queries, targets) to distinct (s1_id, cand_id).
Both sides are normalised records. A query meets the targets of its country; if
its country is blank or unknown among the targets it meets all of them. Routing
is part of the join key, in two unioned equi-joins, never a condition with OR.
Caps count the distinct targets of a key in the routed index and are applied to
the keys before the postings are joined, which also removes the hot keys.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler_at, jaro_winkler_of
from ..functions.text import GENERIC_WORDS, acronym, char_ngrams, is_non_ascii, locality, script_set, transliterate, word_ngrams
from ..sources.storage import landed
from .candidates import prune_legacy

EVERYWHERE = "*"


def routed(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """queries with route: their country if targets have it, else everywhere."""
    known = targets.where("country_norm <> ''").select(F.col("country_norm").alias("known")).distinct()
    out = queries.join(known, F.col("country_norm") == F.col("known"), "left")
    return out.withColumn("route", F.coalesce("known", F.lit(EVERYWHERE))).drop("known")


def both_routes(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Postings (country_norm, key, cand_id) under their country and everywhere, as far as queries have such a route."""
    routes = queries.select("route").distinct()
    return postings.select(F.explode(F.array("country_norm", F.lit(EVERYWHERE))).alias("route"), "key", "cand_id").join(routes, "route", "left_semi")


def capped(postings: DataFrame, cap: int | None) -> DataFrame:
    if cap is None:
        return postings
    small = postings.groupBy("route", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap).select("route", "key")
    return postings.join(small, ["route", "key"], "left_semi")


def keys_of(df: DataFrame, keys: Column, *more: str) -> DataFrame:
    """(entity_id, country_norm, ..., key) for every distinct non-empty key."""
    return df.select("entity_id", "country_norm", *more, F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))).alias("key"))


def key_join(queries: DataFrame, targets: DataFrame, query_keys: Column, target_keys: Column, cap: int | None = None) -> DataFrame:
    q = keys_of(routed(queries, targets), query_keys, "route").select(F.col("entity_id").alias("s1_id"), "route", "key")
    t = both_routes(keys_of(targets, target_keys).select("country_norm", "key", F.col("entity_id").alias("cand_id")), q)
    return q.join(capped(t, cap), ["route", "key"]).select("s1_id", "cand_id").distinct()


def tag(label: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(label + ":"), c))


def exact_names(queries, targets, parts=("clean", "core", "sorted")) -> DataFrame:
    k = F.array(*[tag(p, F.col("name_" + p)) for p in parts])
    return key_join(queries, targets, k, k)


PIN, NUM = "addr_pin", "addr_primary_num"


def with_pin(*parts: Column) -> Column:
    """A key from the postal code and more; null if any part is blank."""
    ok = F.col(PIN) != ""
    for p in parts:
        ok = ok & (p != "")
    return F.when(ok, F.concat_ws("_", F.col(PIN), *parts))


def by_pin(queries, targets, cap: int = 30) -> DataFrame:
    return key_join(queries, targets, F.array(with_pin()), F.array(with_pin()), cap)


def by_pin_number(queries, targets, cap: int = 30) -> DataFrame:
    k = F.array(with_pin(F.col(NUM)))
    return key_join(queries, targets, k, k, cap)


def by_pin_token(queries, targets, cap: int = 30) -> DataFrame:
    k = F.array(with_pin(F.coalesce(F.get("addr_tokens", F.lit(0)), F.lit(""))))
    return key_join(queries, targets, k, k, cap)


def by_locality_number(queries, targets, cap: int = 30) -> DataFrame:
    """Locality and number, where a postal code is missing on at least one side;
    targets with and without one have postings, and caps, of their own."""
    place = locality(F.col("addr_tokens"))
    full = (place != "") & (F.col(NUM) != "")
    key = lambda p: F.when(full, F.concat_ws("_", F.lit(p), place, NUM))
    has = F.col(PIN) != ""
    q = F.when(has, F.array(key("none"))).otherwise(F.array(key("none"), key("some")))
    return key_join(queries, targets, q, F.array(F.when(has, key("some")).otherwise(key("none"))), cap)


def by_address(queries, targets, cap: int = 30, pin=False, pin_number=True, pin_token=False, locality_number=True) -> DataFrame:
    parts = [f(queries, targets, cap) for f, on in ((by_pin, pin), (by_pin_number, pin_number), (by_pin_token, pin_token), (by_locality_number, locality_number)) if on]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def rare_candidates(df: DataFrame, min_length: int, *more: str) -> DataFrame:
    """(entity_id, country_norm, ..., token) for the tokens that may be rare."""
    some = F.filter("name_informative_tokens", lambda t: (F.length(t) >= min_length) & ~t.isin(*GENERIC_WORDS))
    return df.select("entity_id", "country_norm", *more, F.explode(F.array_distinct(some)).alias("token"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.countDistinct("entity_id").alias("df"))


def rarest(tokens: DataFrame, df: DataFrame, max_df: int, n: int) -> DataFrame:
    """The n tokens of lowest frequency of each record, among those that targets have and not too often."""
    by = Window.partitionBy("entity_id").orderBy("df", "token")
    ranked = tokens.join(df, "token").withColumn("rank", F.row_number().over(by))
    return ranked.where((F.col("rank") <= n) & (F.col("df") <= max_df))


def rare_tokens(queries, targets, max_df: int = 200, n: int = 2, min_length: int = 3, cap: int | None = 30) -> DataFrame:
    """Pairs that share a token which is among the n rarest of both."""
    t = rare_candidates(targets, min_length)
    df = document_frequency(t)
    q = rarest(rare_candidates(routed(queries, targets), min_length, "route"), df, max_df, n)
    post = both_routes(rarest(t, df, max_df, n).select("country_norm", F.col("token").alias("key"), F.col("entity_id").alias("cand_id")), routed(queries, targets))
    return q.select(F.col("entity_id").alias("s1_id"), "route", F.col("token").alias("key")).join(capped(post, cap), ["route", "key"]).select("s1_id", "cand_id").distinct()


def rare_by_percentile(queries, targets, percent: float = 0.25) -> DataFrame:
    """Pairs of one country that share an informative token whose frequency is in the lowest quarter."""
    t = rare_candidates(targets, 2)
    df = document_frequency(t)
    edge = df.agg(F.percentile("df", percent).alias("edge"))
    rare = df.crossJoin(F.broadcast(edge)).where("df <= edge").select("token")
    q = rare_candidates(queries, 2).select(F.col("entity_id").alias("s1_id"), "country_norm", "token")
    return t.join(rare, "token", "left_semi").withColumnRenamed("entity_id", "cand_id").join(q, ["country_norm", "token"]).select("s1_id", "cand_id").distinct()


#: Records of one key that meet as many of the other side in one task, at most.
BLOCK = 4_000


def token_intersection(queries, targets) -> DataFrame:
    """Pairs of one country that share any name token.

    A pair arises only at the first key it shares, the one of most pairs first, so
    pairs needn't be made distinct: each posting bears its record's keys before.
    Keys that one side lacks are dropped, and a key's pairs arise block by block."""

    def keyed(d, n):
        return d.where("country_norm is not null").select(F.col("entity_id").alias(n), "country_norm", F.explode("name_tokens").alias("token")).distinct()

    def counted(d, n):
        return d.groupBy("country_norm", "token").agg(F.count(F.lit(1)).alias(n))

    q, t = keyed(queries, "s1_id"), keyed(targets, "cand_id")
    keys = counted(q, "nq").join(counted(t, "nt"), ["country_norm", "token"])
    keys = landed(keys.select("country_norm", "token", F.monotonically_increasing_id().alias("k"), "nq", "nt"), "token-keys")

    def postings(d, n):
        by_pairs = F.struct((-F.col("nq") * F.col("nt")).alias("order"), "k", F.ceil(F.col("nq") / BLOCK).cast("int").alias("nl"), F.ceil(F.col("nt") / BLOCK).cast("int").alias("nr"))
        e = d.join(keys, ["country_norm", "token"]).groupBy(n).agg(F.array_sort(F.collect_list(by_pairs)).alias("keys"))
        e = e.select(n, "keys", F.posexplode("keys").alias("at", "key"))
        return e.select(n, F.slice("keys.k", F.lit(1), F.col("at")).alias(n + "_before"), "key.*")

    own = lambda id, n: F.pmod(F.xxhash64(id), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a number keeps few bytes that are many pairs in as many tasks
    dealt = lambda d: d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "i", "j")
    left = dealt(postings(q, "s1_id").select("k", own("s1_id", "nl").alias("i"), each("nr").alias("j"), "s1_id", "s1_id_before"))
    right = dealt(postings(t, "cand_id").select("k", each("nl").alias("i"), own("cand_id", "nr").alias("j"), "cand_id", "cand_id_before"))
    first = (F.size("s1_id_before") == 0) | (F.size("cand_id_before") == 0) | ~F.arrays_overlap("s1_id_before", "cand_id_before")
    return left.join(right, ["k", "i", "j"]).where(first).select("s1_id", "cand_id")


def best_by_jaccard(queries, targets, threshold: float = 0.85, denominator: str = "query_vocab") -> DataFrame:
    """The best target of each source for each query, if its Jaccard exceeds the threshold.

    With query_vocab, target tokens that no query has do not count; with
    country_vocab, as published, those that no query of their country has; with
    full, all count. Records with the same tokens are one class, and classes meet only if they share one of
    their rarest tokens: of so many that no pair above the threshold is missed.
    An id with several records has the tokens of all, repeats counted; such ids
    are compared token by token.
    """

    def tokens_of(d, n):
        counted = d.select(F.col("entity_id").alias(n), "country_norm", "name_tokens", F.count(F.lit(1)).over(Window.partitionBy("entity_id")).alias("rows"))
        return counted.select(n, "country_norm", F.explode(F.array_distinct("name_tokens")).alias("token"), "rows")

    q, t = tokens_of(queries, "s1_id"), tokens_of(targets, "cand_id")
    vocabulary = {"query_vocab": ["token"], "country_vocab": ["country_norm", "token"], "full": None}[denominator]
    if vocabulary:
        t = t.join(q.select(*vocabulary).distinct(), vocabulary, "left_semi")

    def plain(q, t):
        nq, nt = q.groupBy("s1_id").agg(F.count(F.lit(1)).alias("nq")), t.groupBy("cand_id").agg(F.count(F.lit(1)).alias("nt"))
        both = q.drop("rows").join(t.drop("rows"), ["country_norm", "token"]).groupBy("s1_id", "cand_id").agg(F.count(F.lit(1)).alias("n")).join(nq, "s1_id").join(nt, "cand_id")
        s = both.withColumn("score", F.col("n") / (F.col("nq") + F.col("nt") - F.col("n")))
        return s.where(F.col("score") > threshold).select("s1_id", "cand_id", F.substring("cand_id", 1, 2).alias("source"), "score")

    one, several = F.col("rows") == 1, F.col("rows") > 1
    sets = lambda d, n: d.where(one).groupBy(n, "country_norm").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    qs = sets(q, "s1_id")
    qc = qs.groupBy("country_norm", "tokens").agg(F.min("s1_id").alias("id"))
    tc = sets(t, "cand_id").groupBy("country_norm", F.substring("cand_id", 1, 2).alias("source"), "tokens").agg(F.min("cand_id").alias("id")).drop("source")
    df = tc.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def rarest_first(c, n):
        e = c.select("id", "country_norm", F.explode("tokens").alias("token")).join(df, "token", "left")
        e = e.groupBy("id", "country_norm").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")))["token"].alias(n + "_tokens"))
        size = F.size(n + "_tokens")
        # a pair above the threshold shares more than this many tokens; the subtrahend is for rounding
        least = F.greatest(F.lit(1), F.floor(F.lit(threshold) * size - 1e-9) + 1)
        return e.select(F.col("id").alias(n), "country_norm", n + "_tokens", F.explode(F.slice(n + "_tokens", F.lit(1), F.greatest(F.lit(1), size - least + 1).cast("int"))).alias("token"))

    n = F.size(F.array_intersect("q_tokens", "t_tokens"))
    s = rarest_first(qc, "q").join(rarest_first(tc, "t"), ["country_norm", "token"]).withColumn("score", n / (F.size("q_tokens") + F.size("t_tokens") - n))
    s = s.where(F.col("score") > threshold).select(F.col("q").alias("s1_id"), F.col("t").alias("cand_id"), F.substring("t", 1, 2).alias("source"), "score")
    first = Window.partitionBy("s1_id", "source").orderBy(F.desc("score"), "cand_id")
    best = lambda d: d.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    members = qs.join(qc, ["country_norm", "tokens"]).select("id", "s1_id")
    s = best(s).withColumnRenamed("s1_id", "id").join(members, "id").select("s1_id", "cand_id", "source", "score")
    return best(s.unionByName(plain(q.where(several), t)).unionByName(plain(q.where(one), t.where(several)))).select("s1_id", "cand_id", "source", "score")


# similarity retrieval


#: Records of one piece, and compared with at once, at most; and records that a piece is not dealt fewer than, up to LEAST_PARTS pieces of a route;
#: groups that the right side is dealt to alike, up to LEAST_RIGHT.
HEAVY, FEW, LEAST_PARTS, LEAST_RIGHT = 24_000, 2_000, 4, 3
#: Records of the left and of the right side that one task is sent as packed pieces, at most.
LEFT, RIGHT = 48_000, 192_000
#: Share of a task's targets from which a term counts as frequent; bytes of its frequent terms' weights, at most; queries compared at once.
FREQUENT, DENSE_BYTES, COMPARED = 0.03, 48 << 20, 64


def packed(t: pa.Table) -> pa.Table:
    """One row of the records (route, piece, id, main, grams) of a piece: its terms, in how many main records each
    is, the ids, and as bytes each record's number of terms and their codes and counts. main: in how many frequencies a record counts."""
    grams = t["grams"].combine_chunks()
    flat = grams.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(t)), pc.list_value_length(grams).to_numpy(zero_copy_only=False))
    n = max(1, len(flat.dictionary))
    pair, tf = np.unique(row * n + flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    row, code = pair // n, pair % n
    df = np.bincount(code, t["main"].to_numpy()[row], len(flat.dictionary)).astype(np.int64)
    body = zlib.compress(b"".join(x.astype(np.uint32).tobytes() for x in (np.bincount(row, minlength=len(t)), code, tf)), 1)
    return pa.table({"route": t["route"][:1], "piece": t["piece"][:1], "terms": [flat.dictionary.to_pylist()], "df": pa.array([df.tolist()], pa.list_(pa.int64())), "ids": [t["id"].to_pylist()], "body": pa.array([body], pa.binary())})


def unpacked(piece, sublinear: bool) -> pd.DataFrame:
    """(id, ks, ws) of a piece: tf-idf over the vocabulary, rows of length 1; other terms are dropped first, and records without terms."""
    numbers = np.frombuffer(zlib.decompress(piece.body), np.uint32)
    m = len(piece.ids)
    n = (len(numbers) - m) // 2
    row, code, tf = np.repeat(np.arange(m), numbers[:m]), numbers[m : m + n], numbers[m + n :].astype(float)
    k, idf = np.full(code.max(initial=0) + 1, -1), np.zeros(code.max(initial=0) + 1)
    at = np.asarray(piece.at, np.int64)
    k[at], idf[at] = piece.ks, piece.idfs
    known = k[code] >= 0
    row, code, tf = row[known], code[known], tf[known]
    w = (1 + np.log(tf) if sublinear else tf) * idf[code]
    w /= np.sqrt(np.bincount(row, w * w, m))[row]
    size = np.bincount(row, minlength=m)
    ends = np.cumsum(size)[:-1]
    out = pd.DataFrame({"id": np.asarray(piece.ids, object), "ks": pd.Series(np.split(k[code], ends), dtype=object), "ws": pd.Series(np.split(w, ends), dtype=object)})
    return out[size > 0]


def pieces(rows: DataFrame, ngrams, name: str) -> tuple[DataFrame, DataFrame]:
    """(route, piece, n_records, terms, df, ids, body): records (entity_id, route, name_clean) packed piece by piece; and (rep, id): copies.

    Records with one id have the terms of all; one of them is main. Ids of one record
    that have route and name in common are packed once, under the smallest, their rep."""
    n = F.col("n")
    each = rows.groupBy(F.col("entity_id").alias("id")).agg(F.collect_list("name_clean").alias("names"), F.collect_list("route").alias("routes"))
    alone = F.when(F.size("routes") > 1, F.col("id")).alias("alone")
    each = each.select("id", alone, "names", F.posexplode("routes").alias("at", "route"))
    classes = each.groupBy("route", "names", "alone").agg(F.min("id").alias("rep"), F.sum((F.col("at") == 0).cast("long")).alias("main"), F.count(F.lit(1)).alias("n"))
    classes = landed(classes, name + "-classes")
    many = classes.where((n > 1) & F.col("alone").isNull()).select("route", "names", "rep")
    copies = landed(each.where("alone is null").join(many, ["route", "names"]).select("rep", "id"), name + "-copies")
    size = classes.groupBy("route").agg(F.count(F.lit(1)).alias("n")).select("route", F.greatest(F.least(F.ceil(n / FEW), F.lit(LEAST_PARTS)), F.ceil(n / HEAVY)).cast("int").alias("n_pieces"))
    dealt = classes.drop("n").join(F.broadcast(landed(size, name + "-routes")), "route")
    dealt = dealt.select("route", F.pmod(F.xxhash64("rep"), "n_pieces").cast("int").alias("piece"), F.col("rep").alias("id"), "main", "names")
    # a number keeps few bytes that are much work in as many tasks
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "route", "piece")
    grams = dealt.select("route", "piece", "id", "main", F.flatten(F.transform("names", lambda x: ngrams(x))).alias("grams"))
    out = grams.groupBy("route", "piece").applyInArrow(packed, "route string, piece int, terms array<string>, df array<long>, ids array<string>, body binary")
    return landed(out, name), copies


def weighed(packs: DataFrame, vocabulary: DataFrame, name: str) -> DataFrame:
    """(route, piece, ids, body, at, ks, idfs): pieces with number and weight of those of their terms that the vocabulary (term, k, idf) has."""
    terms = packs.select("route", "piece", F.posexplode("terms").alias("at", "term")).join(vocabulary, "term")
    per = terms.groupBy("route", "piece").agg(F.collect_list(F.struct("at", "k", "idf")).alias("v"))
    return landed(packs.join(per, ["route", "piece"]).select("route", "piece", "ids", "body", F.col("v.at").alias("at"), F.col("v.k").alias("ks"), F.col("v.idf").alias("idfs")), name)


def best_of(left: pd.DataFrame, right: pd.DataFrame, k: int, least: float, back: int = 0) -> pd.DataFrame:
    """(way, l_id, r_id, score): for each left row (id, ks, ws) its k best right rows by dot product, at least `least`; ties go to the smaller id.
    With way 2 also each right row's `back` best left rows.

    Frequent terms are multiplied as a dense matrix, the postings of the others are added up."""
    if not len(left) or not len(right):
        return pd.DataFrame({"way": [], "l_id": [], "r_id": [], "score": []}).astype({"way": int, "l_id": str, "r_id": str, "score": float})
    right = right.sort_values("id")
    l_id, r_id, m = left["id"].to_numpy(), right["id"].to_numpy(), len(right)
    row = np.repeat(np.arange(m), right["ks"].map(len).to_numpy())
    terms, code = np.unique(np.concatenate(right["ks"].to_list()), return_inverse=True)
    w = np.concatenate(right["ws"].to_list())
    df = np.bincount(code, minlength=len(terms))
    often = np.argsort(-df, kind="stable")[: DENSE_BYTES // (8 * m)]
    often = often[df[often] > FREQUENT * m]
    column = np.full(len(terms), -1)
    column[often] = np.arange(len(often))
    at, dense = column[code], np.zeros((len(often), m))
    dense[at[at >= 0], row[at >= 0]] = w[at >= 0]
    rare = np.flatnonzero(at < 0)
    rare = rare[np.argsort(code[rare], kind="stable")]
    row, w = row[rare], w[rare]
    df[often] = 0
    start = np.cumsum(df) - df
    out_l, out_r, out_s = [], [], []
    place, edges, held, late = np.argsort(np.argsort(l_id)), np.full(m, least), [np.zeros(0, int), np.zeros(0, int), np.zeros(0)], []

    def reduced():
        """held and late: the `back` best left rows of each right row; edges: what a score must reach to be among them."""
        x = [np.concatenate(c) for c in zip(held, *late, strict=True)]
        order = np.lexsort((place[x[0]], -np.round(x[2], 9), x[1]))
        l, r, v = (c[order] for c in x)
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        edges[r[rank == back - 1]] = np.maximum(v[rank == back - 1] - 2e-9, least)
        return [c[rank < back] for c in (l, r, v)]

    for s in range(0, len(left), COMPARED):
        ks, ws = left["ks"].iloc[s : s + COMPARED].to_list(), left["ws"].iloc[s : s + COMPARED].to_list()
        many, rest = np.zeros((len(ks), len(often))), []
        for i, (x, v) in enumerate(zip(ks, ws, strict=True)):
            c = np.minimum(np.searchsorted(terms, x), len(terms) - 1)
            known = terms[c] == x
            c, v = c[known], v[known]
            dealt = column[c] >= 0
            many[i, column[c[dealt]]] = v[dealt]
            rest.append((c[~dealt], v[~dealt]))
        scores = many @ dense
        for i, (c, v) in enumerate(rest):
            n = df[c]
            total = int(n.sum())
            if total:
                take = np.repeat(start[c] - np.cumsum(n) + n, n) + np.arange(total)
                scores[i] += np.bincount(row[take], w[take] * np.repeat(v, n), m)
            if back:
                hit = np.flatnonzero(scores[i] >= edges)
                late.append((np.full(len(hit), s + i), hit, scores[i][hit]))
            hit = np.flatnonzero(scores[i] >= least)
            if len(hit) > k:
                x = np.round(scores[i][hit], 9)
                edge = np.partition(x, len(x) - k)[len(x) - k]
                above = hit[x > edge]
                hit = np.concatenate([above, hit[x == edge][: k - len(above)]])
            out_l.append(np.full(len(hit), s + i))
            out_r.append(hit)
            out_s.append(scores[i][hit])
        if back and (sum(len(x[1]) for x in late) > m or s + COMPARED >= len(left)):
            held, late = reduced(), []
    out_l, out_r, out_s = (np.concatenate([*x, y]) for x, y in zip((out_l, out_r, out_s), held, strict=True))
    way = np.repeat([1, 2], [len(out_l) - len(held[0]), len(held[0])])
    return pd.DataFrame({"way": way, "l_id": l_id[out_l], "r_id": r_id[out_r], "score": out_s})


def best_of_pieces(left: pd.DataFrame, right: pd.DataFrame, k: int, least: float, sublinear: bool, back: int = 0) -> pd.DataFrame:
    """best_of() for packed pieces; as many right rows as HEAVY are compared at once."""
    out = [best_of(left[:0], right[:0], k, least)]
    groups = (right["ids"].map(len).cumsum() - 1) // HEAVY
    for x in left.itertuples():
        mine, best = unpacked(x, sublinear), None
        for _, ys in right.groupby(groups):
            found = best_of(mine, pd.concat([unpacked(y, sublinear) for y in ys.itertuples()]), k, least, back)
            out.append(found[found["way"] == 2])
            found = found[found["way"] == 1]
            if best is not None:
                found = pd.concat([best, found])
                found = found.assign(x=found["score"].round(9)).sort_values(["x", "r_id"], ascending=[False, True]).groupby("l_id", sort=False).head(k).drop(columns="x")
            best = found
        if best is not None:
            out.append(best)
    return pd.concat(out)


def nearest(left: DataFrame, right: DataFrame, k: int, least: float, sublinear: bool, left_copies: DataFrame, right_copies: DataFrame, back: int = 0) -> DataFrame:
    """(way, l_id, r_id, score): the k best right records of each left record, of those with its route, from weighed pieces and the copies (rep, id) of
    their records; with way 2 also the `back` best left records of each right record, from the same comparison.

    Copies have the score of their rep, so only the best reps are spread to the
    smallest of their ids, and the best of those to the copies for which they are. Every group
    of left pieces meets every group of right pieces of its route in one task, which returns few
    rows for each record. Pieces stay packed until then, so that few bytes are sent to several tasks."""
    n = F.sum(F.size("ids"))
    lefts = F.greatest(F.least(F.ceil(n / FEW), F.lit(LEAST_PARTS)), F.ceil(n / LEFT)).cast("int")
    rights = F.greatest(F.least(F.ceil(n / FEW), F.lit(LEAST_RIGHT)), F.ceil(n / RIGHT)).cast("int")
    parts = left.groupBy("route").agg(lefts.alias("nl")).join(right.groupBy("route").agg(rights.alias("nr")), "route")
    parts = landed(parts, "blocks")
    own = lambda n: F.pmod("piece", n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = "ids", "body", "at", "ks", "idfs"
    x = left.join(F.broadcast(parts), "route").select("route", own("nl").alias("i"), each("nr").alias("j"), *columns)
    y = right.join(F.broadcast(parts), "route").select("route", each("nl").alias("i"), own("nr").alias("j"), *columns)
    run = lambda a, b: best_of_pieces(a, b, k, least, sublinear, back)
    found = x.groupBy("route", "i", "j").cogroup(y.groupBy("route", "i", "j")).applyInPandas(run, "way int, l_id string, r_id string, score double")
    forth = F.col("way") == 1
    found = found.select("way", F.when(forth, F.col("l_id")).otherwise(F.col("r_id")).alias("own"), F.when(forth, F.col("r_id")).otherwise(F.col("l_id")).alias("other"), F.round("score", 9).alias("score"))

    def first(d, by, *order):
        d = d.withColumn("r", F.row_number().over(Window.partitionBy("way", by).orderBy(*order)))
        return d.where((F.col("r") <= max(k, back)) & (F.col("r") <= F.when(forth, k).otherwise(back))).drop("r")

    best = lambda d: first(d, "own", F.desc("score"), "other")
    spread = lambda d, copies, at: d.join(copies.withColumnRenamed("rep", at), ["way", at], "left").withColumn(at, F.coalesce("id", at)).drop("id")
    both = lambda a, b: a.withColumn("way", F.lit(1)).unionByName(b.withColumn("way", F.lit(2))) if back else a.withColumn("way", F.lit(1))
    found = best(spread(best(found), first(both(right_copies, left_copies), "rep", "id"), "other"))
    found = spread(found, both(left_copies, right_copies), "own")
    return found.select("way", F.when(forth, F.col("own")).otherwise(F.col("other")).alias("l_id"), F.when(forth, F.col("other")).otherwise(F.col("own")).alias("r_id"), "score")


def retrieve(queries, targets, ngrams, k: int = 20, least: float = 0.25, min_df: int = 2, max_df: float = 0.9, reverse: int = 0, mode: str = "union", sublinear: bool = True) -> DataFrame:
    """(s1_id, cand_id, score): the k most similar targets of each query by cosine.

    ngrams maps a name column to its terms. reverse > 0 also finds each target's
    best queries; mode union adds them, mutual keeps pairs found both ways. Ties
    go to the smaller id. Frequencies are those of all targets. All queries meet
    all targets of their route, block by block; only the best leave a block.
    Records of one route and name are compared once, however many they are. Terms are moved once for each piece of records that has them, not for each record.
    """
    # targets without a country are met everywhere only, as "" is no route
    t, t_copies = pieces(targets.select("entity_id", F.coalesce("country_norm", F.lit("")).alias("route"), "name_clean"), ngrams, "target-pieces")
    n = targets.agg(F.count(F.lit(1)).alias("n"))
    df = t.select(F.inline(F.arrays_zip("terms", "df")).alias("term", "n")).groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(n))
    vocabulary = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    vocabulary = landed(vocabulary.select("term", F.monotonically_increasing_id().alias("k"), (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "vocabulary")
    wt = weighed(t, vocabulary, "target-vectors")
    q, q_copies = pieces(routed(queries, targets).select("entity_id", "route", "name_clean"), ngrams, "query-pieces")
    wq = weighed(q, vocabulary, "query-vectors")
    wt = wt.withColumn("route", F.explode(F.array_distinct(F.array("route", F.lit(EVERYWHERE))))).join(F.broadcast(wq.select("route").distinct()), "route", "left_semi")
    s = nearest(wq, wt, k, least, sublinear, q_copies, t_copies, reverse).select("way", F.col("l_id").alias("s1_id"), F.col("r_id").alias("cand_id"), "score")
    if not reverse:
        return s.drop("way")
    both = s.groupBy("s1_id", "cand_id").agg(F.max("score").alias("score"), F.sum("way").alias("ways"))
    return both.where(F.col("ways") == 3 if mode == "mutual" else F.lit(True)).drop("ways")


def char_retrieval(queries, targets, **options) -> DataFrame:
    return retrieve(queries, targets, char_ngrams, **options)


def word_retrieval(queries, targets, k: int = 15, least: float = 0.35, max_df: float = 0.8, **options) -> DataFrame:
    return retrieve(queries, targets, word_ngrams, k=k, least=least, max_df=max_df, **options)


# fuzzy and cross-script


#: Groups of three-letter beginnings that tasks are dealt, and tokens of one beginning that a task compares from either side; tokens compared at once;
#: query tokens whose pairs are made distinct together.
BEGINNINGS, ALIKE, AT_ONCE, TOGETHER = 96, 4_000, 512, 1_000


def letters_of(tokens: list[str]) -> np.ndarray:
    """(token, letter, repeat) as numbers: one row for every letter, repeat 0 for its first occurrence in the token."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    code = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(tokens)), size)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, int)
    return np.stack([row, code, np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))])


def near_tokens(left: pd.DataFrame, right: pd.DataFrame, least: float, gap: int = 3) -> pd.DataFrame:
    """(qt, key): different tokens (p, token) of one beginning p, lengths at most gap apart, Jaro-Winkler at least `least`.

    It is computed only where it can reach that if all letters that both have, with
    repeats, match in order; their number is a product of matrices of zeros and ones."""
    qt, key = [], []
    groups = dict(list(right.groupby("p")["token"]))
    for p, mine in left.groupby("p")["token"]:
        if p not in groups:
            continue
        mine, other = sorted(mine, key=len), sorted(groups[p], key=len)
        (row, code, nth), (row2, code2, nth2) = letters_of(mine), letters_of(other)
        kinds, kind = np.unique(np.r_[code, code2] << 20 | np.r_[nth, nth2], return_inverse=True)
        x, y = np.zeros((len(mine), len(kinds)), np.float32), np.zeros((len(other), len(kinds)), np.float32)
        x[row, kind[: len(row)]] = 1
        y[row2, kind[len(row) :]] = 1
        size, length = (np.fromiter(map(len, z), np.int64, len(z)) for z in (mine, other))
        fourth, fourth2 = (np.array([t[3:4] for t in z]) for z in (mine, other))
        at, at2 = [], []
        for n in np.unique(size):
            low, high = np.searchsorted(length, [n - gap, n + gap + 1])
            if low == high:
                continue
            # letters in common from which the limit can be reached, for every length, with and without the fourth letter
            shared = np.arange(n + 1)[:, None]
            jaro = (shared / n + shared / length[low:high] + 1) / 3
            without, with_it = ((jaro + w * (1 - jaro) < least - 1e-9).sum(0) for w in (0.3, 0.4))
            same = np.flatnonzero(size == n)
            for f in np.unique(fourth[same]):
                need = np.where(fourth2[low:high] == f, with_it, without).astype(np.float32)
                rows = same[fourth[same] == f]
                for s in range(0, len(rows), AT_ONCE):
                    i, j = np.nonzero(x[rows[s : s + AT_ONCE]] @ y[low:high].T >= need)
                    at.append(rows[s + i])
                    at2.append(low + j)
        if at:
            i, j = np.concatenate(at), np.concatenate(at2)
            both, long = np.zeros(len(i), bool), (size[i] > 64) | (length[j] > 64)
            both[~long] = jaro_winkler_at(mine, other, i[~long], j[~long], least)
            both[long] = [jaro_winkler_of(mine[a], other[b]) >= least for a, b in zip(i[long], j[long], strict=True)]
            mine, other = np.asarray(mine, object)[i[both]], np.asarray(other, object)[j[both]]
            different = mine != other
            qt.append(mine[different])
            key.append(other[different])
    return pd.DataFrame({"qt": np.concatenate([*qt, []]), "key": np.concatenate([*key, []])}, dtype=object)


def expanded(a: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in a, row): every row whose code is a's, for each place in a; code has every number of a."""
    order, n = np.argsort(code, kind="stable"), np.bincount(code)
    start, n = (np.cumsum(n) - n)[a], n[a]
    return np.repeat(np.arange(len(a)), n), order[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]


def near_pairs(left: pa.Table, right: pa.Table, least: float) -> pa.Table:
    """(bucket, body): distinct pairs of the postings (p, token, route, id, bucket) and (p, token, route, id) of one route whose tokens are near, packed by bucket."""
    x, y = left.select(["p", "token", "bucket"]).to_pandas(), right.select(["p", "token"]).to_pandas()
    near = near_tokens(x[["p", "token"]].drop_duplicates(), y.drop_duplicates(), least)
    routes = pa.chunked_array([*left["route"].chunks, *right["route"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
    (x_code, x_tokens), (y_code, y_tokens) = (pd.factorize(d["token"]) for d in (x, y))
    a, b = pd.Index(x_tokens).get_indexer(near["qt"]), pd.Index(y_tokens).get_indexer(near["key"])
    x_ids, y_ids = (t["id"].combine_chunks().dictionary_encode() for t in (left, right))
    x_id, y_id, n = x_ids.indices.to_numpy(), y_ids.indices.to_numpy().astype(np.int64), max(1, len(y_ids.dictionary))
    found = [np.zeros(0, np.int64)]
    for s in range(0, len(a), 100_000):
        at, i = expanded(a[s : s + 100_000], x_code)
        k, j = expanded(b[s : s + 100_000][at], y_code)
        same = routes[i[k]] == routes[len(x) + j]
        found.append(np.unique(x_id[i[k][same]] * n + y_id[j[same]]))
    pair = np.unique(np.concatenate(found))
    bucket = np.zeros(len(x_ids.dictionary), np.int64)
    bucket[x_id] = x["bucket"]
    pair = pair[np.argsort(bucket[pair // n], kind="stable")]
    of = bucket[pair // n]
    edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(pair) else np.zeros(1, int)
    bodies = []
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        out, part = pa.BufferOutputStream(), pa.table({"s1_id": x_ids.dictionary.take(pa.array(pair[s:e] // n)), "cand_id": y_ids.dictionary.take(pa.array(pair[s:e] % n))})
        with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(part)
        bodies.append(out.getvalue().to_pybytes())
    return pa.table({"bucket": pa.array(of[edges[:-1]], pa.int64()), "body": pa.array(bodies, pa.binary())})


def distinct_pairs(packs: pa.Table) -> pa.Table:
    """The distinct rows of packed tables."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for c in packs["body"].chunks for x in c]
    return pa.concat_tables(parts).group_by(["s1_id", "cand_id"]).aggregate([])


def soft_tokens(queries, targets, max_df: int = 100, min_length: int = 5, least: float = 0.9, cap: int = 30) -> DataFrame:
    """Pairs that share no token but one nearly so: same first three letters, lengths
    at most 3 apart, Jaro-Winkler at least `least`.

    Postings of one beginning meet block by block, and a block's tokens are compared once;
    its pairs are packed, and made distinct for some queries at a time."""
    some = lambda d, *more: d.select("entity_id", "country_norm", *more, F.explode(F.array_distinct(F.filter("name_informative_tokens", lambda t: (F.length(t) >= min_length) & t.rlike(r"^\p{L}+$")))).alias("token"))
    begun = lambda d, *more: d.select(F.substring("token", 1, 3).alias("p"), "token", "route", F.col("entity_id").alias("id"), *more).distinct()
    # all records of an id have its routes and tokens
    mine = routed(queries, targets).select("entity_id", "route").join(some(queries).select("entity_id", "token"), "entity_id")
    mine = landed(begun(mine), "query-tokens")
    t = some(targets)
    few = document_frequency(t).where(F.col("df") <= max_df).select(F.col("token").alias("key"))
    post = capped(both_routes(t.select("country_norm", F.col("token").alias("key"), F.col("entity_id").alias("cand_id")).join(few, "key", "left_semi"), mine), cap)
    post = landed(begun(post.select("route", F.col("key").alias("token"), F.col("cand_id").alias("entity_id"))), "target-tokens")
    # postings of a frequent query token are dealt to several tasks; a target token has few
    shares = mine.groupBy("p", "token").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("shares"))
    left_size = shares.groupBy("p").agg(F.ceil(F.sum("shares") / ALIKE).cast("int").alias("nl"), F.max("shares").alias("most"))
    right_size = post.select("p", "token").distinct().groupBy("p").agg(F.ceil(F.count(F.lit(1)) / ALIKE).cast("int").alias("nr"))
    parts = left_size.join(right_size, "p").select("p", F.greatest("nl", F.col("most").cast("int")).alias("nl"), "nr")
    parts = landed(parts, "beginnings")
    own = lambda n: F.pmod(F.xxhash64("token"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = F.pmod(F.xxhash64("p"), F.lit(BEGINNINGS)).alias("g")
    bucket = F.pmod(F.xxhash64("id"), F.lit(-(-mine.count() // TOGETHER) or 1)).alias("bucket")
    # a number keeps few bytes that are much work in as many tasks
    dealt = lambda d, *by: d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).groupBy(*by)
    by, columns = ("g", "i", "j"), ("p", "token", "route", "id")
    share = F.pmod(F.pmod(F.xxhash64("token"), "nl") + F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1))), "nl").cast("int").alias("i")
    often = shares.where("shares > 1").drop("p")
    left = dealt(mine.join(parts, "p").join(often, "token", "left").select(group, share, each("nr").alias("j"), *columns, bucket), *by)
    right = dealt(post.join(parts, "p").select(group, each("nl").alias("i"), own("nr").alias("j"), *columns), *by)
    packs = left.cogroup(right).applyInArrow(lambda a, b: near_pairs(a, b, least), "bucket long, body binary")
    return dealt(packs, "bucket").applyInArrow(distinct_pairs, "s1_id string, cand_id string")


def translit_names(queries, targets, max_df: int = 150, min_length: int = 4, cap: int = 30) -> DataFrame:
    """Latin readings of the targets whose names are not ASCII, met by whole name or by token."""
    t = targets.where(is_non_ascii(F.col("name_clean"))).withColumn("read", transliterate(F.col("name_clean")))
    q = queries.withColumn("read", transliterate(F.col("name_clean")))
    toks = F.array_distinct(F.filter(F.split("read", " "), lambda x: (F.length(x) >= min_length) & x.rlike("^[a-z]+$")))
    df = t.select("entity_id", F.explode(toks).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= max_df)
    keys = lambda d: d.select("entity_id", F.explode(toks).alias("token")).join(df, "token", "left_semi").groupBy("entity_id").agg(F.collect_set(F.concat(F.lit("t:"), "token")).alias("soft"))
    full = lambda d: d.join(keys(d), "entity_id", "left").withColumn("keys", F.concat(F.array(tag("n", F.col("read"))), F.coalesce("soft", F.array().cast("array<string>"))))
    return key_join(full(q), full(t), F.col("keys"), F.col("keys"), cap)


def hybrid(queries, targets, max_df: int = 100, cap: int = 15) -> DataFrame:
    """A rare name token together with a number or postal code of the address."""
    t = rare_candidates(targets, 3)
    df = document_frequency(t).where(F.col("df") <= max_df).select("token")

    def keyed(d):
        first = d.select("entity_id", F.posexplode(F.array_distinct("name_informative_tokens")).alias("at", "token")).where(F.length("token") >= 3).join(df, "token", "left_semi")
        two = first.groupBy("entity_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda s: s["token"]), 1, 2).alias("two"))
        numbers = F.array_distinct(F.concat(F.array(F.regexp_extract(NUM, r"^\d+", 0)), F.slice("addr_numbers", 1, 2)))
        a = F.flatten(F.transform("two", lambda x: F.transform(F.filter(numbers, lambda n: n != ""), lambda n: F.concat(F.lit("NUM_"), n, F.lit("#"), x))))
        b = F.when(F.col(PIN) != "", F.transform("two", lambda x: F.concat(F.lit("PIN_"), F.col(PIN), F.lit("#"), x))).otherwise(F.array().cast("array<string>"))
        return d.join(two, "entity_id").withColumn("keys", F.concat(a, b))

    return key_join(keyed(queries), keyed(targets), F.col("keys"), F.col("keys"), cap)


def acronyms(queries, targets) -> DataFrame:
    """Initials, or a short name of one word, with the postal code, either way round."""
    one = F.when((F.size("name_tokens") == 1) & F.length("name_clean").between(3, 6), F.col("name_clean"))
    k = F.array(*[F.when(F.col(PIN) != "", F.concat(x, F.lit("#"), F.col(PIN))) for x in (acronym(F.col("name_tokens")), one)])
    return key_join(queries, targets, k, k)


def cross_script_address(queries, targets, cap: int = 100) -> DataFrame:
    """Address pairs whose names are written in different sets of scripts."""
    pairs = by_address(queries, targets, cap)
    s = lambda d, k, n: d.select(F.col("entity_id").alias(k), script_set(F.col("name_clean")).alias(n))
    return pairs.join(s(queries, "s1_id", "x"), "s1_id").join(s(targets, "cand_id", "y"), "cand_id").where("x <> y").select("s1_id", "cand_id")


def bucket_diagnostics(targets: DataFrame, keys: Column, cap: int) -> DataFrame:
    n = keys_of(targets, keys).groupBy("key").agg(F.countDistinct("entity_id").alias("n"))
    return n.agg(F.count(F.lit(1)).alias("keys"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("largest"), F.sum((F.col("n") > cap).cast("long")).alias("oversized"))


def token_diagnostics(targets: DataFrame, min_length: int = 3) -> DataFrame:
    d = document_frequency(rare_candidates(targets, min_length))
    return d.agg(F.count(F.lit(1)).alias("tokens"), F.avg("df").alias("mean"), *[F.percentile("df", p).alias(n) for p, n in ((0.5, "median"), (0.95, "p95"), (0.99, "p99"))], F.max("df").alias("largest"))


def legacy_ab(queries, targets) -> DataFrame:
    same = lambda k: key_join(queries.withColumn("country_norm", F.lit("")), targets.withColumn("country_norm", F.lit("")), k, k)
    return same(F.array(tag("clean", F.col("name_clean")))).unionByName(same(F.array(with_pin(F.col(NUM))))).distinct()


def legacy_neighbours(queries, targets, k: int = 10, least: float = 0.5) -> DataFrame:
    """The k nearest targets of all countries by cosine, raw term counts, if near enough."""
    blank = lambda d: d.withColumn("country_norm", F.lit(""))
    return char_retrieval(blank(queries), blank(targets), k=k, least=least, sublinear=False)


def legacy_candidates(queries, targets, top_k: int = 20, max_cands: int = 50) -> DataFrame:
    """The first generation: names, addresses, rare tokens by percentile, ten neighbours by cosine; pruned to
    top_k for queries with more than max_cands."""
    knn = legacy_neighbours(queries, targets).select("s1_id", "cand_id")
    every = legacy_ab(queries, targets).unionByName(rare_by_percentile(queries, targets)).unionByName(knn).distinct()
    return prune_legacy(every, queries, targets, top_k, max_cands).select("s1_id", "cand_id")


def stats(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """One row about a blocker's result: sizes of both sides, queries with candidates, pairs, mean and most per query."""
    per = pairs.select("s1_id", "cand_id").distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    p = per.agg(F.count(F.lit(1)).alias("with_candidates"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.max("n").alias("largest"))
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return p.crossJoin(n(queries, "queries")).crossJoin(n(targets, "targets")).withColumn("mean", F.col("pairs") / F.col("queries"))

