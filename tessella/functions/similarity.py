"""Similarities of two records as column expressions, and the pair features.

Set and Levenshtein measures are native. Jaro-Winkler and the ratios over the
longest common subsequence have no native form; they run as Arrow functions over
batches, which compare a pair of strings once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import transliterate

# The features and their order.
FEATURES = [
    "name_exact", "name_core_exact", "name_sorted_exact", "name_lev", "name_jaro", "name_token_sort_ratio", "name_token_set_ratio", "name_wratio",
    "name_token_jaccard", "name_token_overlap", "name_rare_token_overlap", "name_token_count_diff", "name_length_ratio",
    "addr_lev", "addr_token_sort_ratio", "addr_token_jaccard", "addr_pin_match", "addr_num_match", "addr_length_ratio", "addr_either_missing",
    "name_translit_lev", "name_translit_exact", "country_match", "cross_name_addr", "name_high_addr_missing", "name_exact_addr_match",
    "prov_exact_name", "prov_address", "prov_rare_token", "prov_retrieval_reciprocal", "prov_transliteration", "prov_count",
]
PYTHON_FEATURES = ("name_jaro", "name_token_sort_ratio", "name_token_set_ratio", "name_wratio", "addr_token_sort_ratio", "name_translit_lev", "name_translit_exact")
NATIVE_FEATURES = [f for f in FEATURES if f not in PYTHON_FEATURES]


def ratio_of(a, b) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / n)


def jaccard(a: Column, b: Column) -> Column:
    return ratio_of(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    return ratio_of(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def length_ratio(a: Column, b: Column) -> Column:
    return ratio_of(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))


def jaro_winkler_of(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, u in zip(b, used, strict=True) if u]
    half = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler_at(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray, least: float, weight: float = 0.1) -> np.ndarray:
    """Whether jaro_winkler_of(a[i], b[j]) is at least `least`, for pairs of places of different texts of 1 to 64 letters.

    Places of a letter in a text are the bits of one number, so that many pairs are matched
    at once, letter by letter."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(i), bool)
    letters = {c: k for k, c in enumerate(sorted({c for x in a for c in x[:64]}))}
    n = len(letters) + 1  # the last is no letter
    codes = np.full((len(a), min(64, la.max(initial=0))), n - 1)
    for k, x in enumerate(a):
        codes[k, : len(x)] = [letters[c] for c in x[:64]]
    places = np.zeros((len(b), n), np.uint64)
    for k, x in enumerate(b):
        for at, c in enumerate(x[:64]):
            if c in letters:
                places[k, letters[c]] |= np.uint64(1 << at)
    places = places.ravel()
    head = np.array([[ord(c) for c in x[:4].ljust(4, "\0")] for x in (*a, *b)]).reshape(-1, 4)
    head_a, head_b = head[: len(a)], head[len(a) :]
    # bits that the letter at a place may match, by reach + 1
    windows = np.array([[sum(1 << at for at in range(max(0, k - r), min(64, k + r + 1))) for k in range(64)] for r in range(-1, 32)], np.uint64)
    zero, one = np.uint64(0), np.uint64(1)
    some = np.argsort(la[i], kind="stable")
    for s in range(0, len(some), 1 << 14):
        at = some[s : s + (1 << 14)]
        x, y = i[at], j[at]
        p, q = la[x], lb[y]
        reach = np.maximum(p, q) // 2
        prefix = np.logical_and.accumulate((head_a[x] == head_b[y]) & (head_a[x] > 0), axis=1).sum(1)

        def enough(m, half):
            jaro = np.divide(m / p + m / q + (m - half) / np.maximum(m, 1), 3)
            return (m > 0) & (np.where(jaro > 0.7, jaro + prefix * weight * (1 - jaro), jaro) >= least)

        used, m, hits, masks = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64), [], []
        for k in range(p.max()):
            mask = places[y * n + codes[x, k]]
            low = mask & windows[reach, k] & ~used
            low &= ~low + one
            used |= low
            hits.append(low != zero)
            masks.append(mask)
            m += hits[-1]
        keep = np.flatnonzero(enough(m, 0))
        at, p, q, prefix, m, used, wrong = at[keep], p[keep], q[keep], prefix[keep], m[keep], used[keep], np.zeros(len(keep), np.int64)
        for hit, mask in zip(hits, masks, strict=True):
            hit = hit[keep]
            low = used & (~used + one)
            wrong += hit & (low & mask[keep] == zero)
            used ^= np.where(hit, low, zero)
        out[at] = enough(m, wrong // 2)
    return out


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of rows at a time."""
    if len(a) > len(b):
        a, b = b, a
    mask: dict[str, int] = {}
    for i, c in enumerate(a):
        mask[c] = mask.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & mask.get(c, 0)
        s = (s + u) | (s - u)
    return len(a) - (s & full).bit_count()


def indel(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * common_subsequence(a, b) / n


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    return max(indel(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def token_sort(a: str, b: str, measure=indel) -> float:
    return measure(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = x & y, x - y, y - x
    if both and (not left or not right):
        return 100.0
    s = " ".join(sorted(both))
    p, q = " ".join([s, *sorted(left)]).strip(), " ".join([s, *sorted(right)]).strip()
    out = indel(p, q)
    return max(out, indel(s, p), indel(s, q)) if both else out


def partial_tokens(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(token_sort(a, b, partial), partial(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted(a: str, b: str) -> float:
    """The best of the ratios, each scaled by how much it forgives."""
    if not a or not b:
        return 0.0
    long = max(len(a), len(b)) / min(len(a), len(b))
    best = indel(a, b)
    if long < 1.5:
        return max(best, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if long <= 8 else 0.6
    return max(best, scale * partial(a, b), 0.95 * scale * partial_tokens(a, b))


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in PYTHON_FEATURES[:5]]))
def string_ratios(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
    names = {k: (jaro_winkler_of(*k), token_sort(*k) / 100, token_set(*k) / 100, weighted(*k) / 100) if all(k) else (0.0,) * 4 for k in set(zip(a, b, strict=True))}
    places = {k: token_sort(*k) / 100 if all(k) else 0.0 for k in set(zip(x, y, strict=True))}
    out = pd.DataFrame([names[k] for k in zip(a, b, strict=True)], columns=["name_jaro", "name_token_sort_ratio", "name_token_set_ratio", "name_wratio"], dtype="float64")
    return out.assign(addr_token_sort_ratio=[places[k] for k in zip(x, y, strict=True)])


def safe(c: Column) -> Column:
    """Trimmed text; nan and none, in any case, are empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin("nan", "none"), "").otherwise(t)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def pair_features(pairs: DataFrame, python: bool = True) -> DataFrame:
    """Features of pairs whose sides' columns carry the prefixes a_ and b_, with strategies (array).

    python=False leaves out the seven features that need Arrow functions.
    """
    side = lambda p: (safe(F.coalesce(F.nullif(F.col(p + "name_clean"), F.lit("")), F.col(p + "business_name"))), safe(F.coalesce(F.nullif(F.col(p + "addr_clean"), F.lit("")), F.col(p + "business_address"))))
    (na, aa), (nb, ab) = side("a_"), side("b_")
    d = pairs.withColumns({"f_na": na, "f_nb": nb, "f_aa": aa, "f_ab": ab})
    c = F.col
    named = (c("f_na") != "") & (c("f_nb") != "")
    missing = lambda p, t: c(p + "addr_is_missing") | (F.length(t) < 3)
    d = d.withColumn("f_both", ~(missing("a_", c("f_aa")) | missing("b_", c("f_ab"))))
    same = lambda x: flag((safe(c("a_" + x)) == safe(c("b_" + x))) & (safe(c("a_" + x)) != ""))
    when = lambda cond, x: F.when(cond, x).otherwise(F.lit(0.0))
    infa, infb = F.array_distinct("a_name_informative_tokens"), F.array_distinct("b_name_informative_tokens")
    ta, tb = F.size("a_name_tokens"), F.size("b_name_tokens")
    has = lambda *labels: flag(F.exists("strategies", lambda s: F.greatest(*[F.contains(s, F.lit(x)) for x in labels]) if len(labels) > 1 else F.contains(s, F.lit(labels[0]))))
    d = d.withColumns(
        {
            "name_exact": flag(named & (c("f_na") == c("f_nb"))),
            "name_core_exact": same("name_core"),
            "name_sorted_exact": same("name_sorted"),
            "name_lev": when(named, levenshtein_similarity(c("f_na"), c("f_nb"))),
            "name_token_jaccard": when(named, jaccard(c("a_name_tokens"), c("b_name_tokens"))),
            "name_token_overlap": when(named, overlap(c("a_name_tokens"), c("b_name_tokens"))),
            "name_rare_token_overlap": ratio_of(F.size(F.array_intersect(infa, infb)), F.greatest(F.size(infa), F.size(infb))),
            "name_token_count_diff": ratio_of(F.abs(ta - tb), F.greatest(ta, tb)),
            "name_length_ratio": length_ratio(c("f_na"), c("f_nb")),
            "addr_lev": when(c("f_both"), levenshtein_similarity(c("f_aa"), c("f_ab"))),
            "addr_token_jaccard": when(c("f_both"), jaccard(c("a_addr_tokens"), c("b_addr_tokens"))),
            "addr_pin_match": same("addr_pin"),
            "addr_num_match": same("addr_primary_num"),
            "addr_length_ratio": when(c("f_both"), length_ratio(c("f_aa"), c("f_ab"))),
            "addr_either_missing": flag(~c("f_both")),
            "country_match": flag((F.lower(safe(c("a_country"))) == F.lower(safe(c("b_country")))) & (safe(c("a_country")) != "")),
            "prov_exact_name": has("exact_name"),
            "prov_address": has("address"),
            "prov_rare_token": has("rare_token"),
            "prov_retrieval_reciprocal": has("char_retrieval", "reciprocal"),
            "prov_transliteration": has("transliteration"),
        }
    )
    d = d.withColumns(
        {
            "cross_name_addr": c("name_lev") * c("addr_lev"),
            "name_high_addr_missing": flag((c("name_lev") > 0.85) & (c("addr_either_missing") == 1)),
            "name_exact_addr_match": flag((c("name_exact") == 1) & (c("addr_lev") > 0.6)),
            "prov_count": c("prov_exact_name") + c("prov_address") + c("prov_rare_token") + c("prov_retrieval_reciprocal") + c("prov_transliteration"),
        }
    )
    if python:
        d = d.withColumn("f_r", string_ratios("f_na", "f_nb", F.when(c("f_both"), c("f_aa")).otherwise(""), F.when(c("f_both"), c("f_ab")).otherwise("")))
        d = d.withColumns({k: c("f_r." + k) for k in PYTHON_FEATURES[:5]}).withColumns({"f_ra": transliterate(c("f_na")), "f_rb": transliterate(c("f_nb"))})
        both = (c("f_ra") != "") & (c("f_rb") != "")
        d = d.withColumns({"name_translit_lev": when(both, levenshtein_similarity(c("f_ra"), c("f_rb"))), "name_translit_exact": flag(both & (c("f_ra") == c("f_rb")))})
    names = FEATURES if python else NATIVE_FEATURES
    return d.select("s1_id", "cand_id", *[x for x in ("label",) if x in pairs.columns], *names)


def side(records: DataFrame, prefix: str, key: str) -> DataFrame:
    return records.select(F.col("entity_id").alias(key), *[F.col(x).alias(prefix + x) for x in records.columns if x != "entity_id"])


def pair_records(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (s1_id, cand_id, ...) with both records' columns, by two equi-joins."""
    return pairs.join(side(left, "a_", "s1_id"), "s1_id").join(side(right, "b_", "cand_id"), "cand_id")
