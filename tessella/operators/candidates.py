"""Candidate sets: union with provenance, wide and long forms, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import jaccard


def union(parts: dict[str, DataFrame]) -> DataFrame:
    """(s1_id, cand_id, strategies): pairs of several blockers, with the sorted labels of those that found them."""
    out = None
    for label, pairs in parts.items():
        p = pairs.select("s1_id", "cand_id", F.lit(label).alias("strategy"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("s1_id", "cand_id").agg(F.sort_array(F.collect_set("strategy")).alias("strategies"))


def to_wide(pairs: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row per query with its sorted candidates, comma-joined; queries adds those without any."""
    wide = pairs.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("cand_id")), ",").alias("candidate_entity_ids")).withColumnRenamed("s1_id", "source1_entity_id")
    if queries is None:
        return wide
    return queries.select(F.col("entity_id").alias("source1_entity_id")).join(wide, "source1_entity_id", "left").withColumn("candidate_entity_ids", F.coalesce("candidate_entity_ids", F.lit("")))


def to_long(wide: DataFrame, ids: str = "candidate_entity_ids") -> DataFrame:
    parts = F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x != "")
    return wide.select(F.col("source1_entity_id").alias("s1_id"), F.explode(parts).alias("cand_id"))


def counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))


def pair_scores(pairs: DataFrame, queries: DataFrame, targets: DataFrame, name: str = "name_informative_tokens") -> DataFrame:
    """pairs with jn and ja, the Jaccard of names and of addresses; 0 for an unknown candidate."""
    side = lambda d, k, p: d.select(F.col("entity_id").alias(k), F.col(name).alias(p + "n"), F.col("addr_tokens").alias(p + "a"))
    d = pairs.join(side(queries, "s1_id", "q"), "s1_id").join(side(targets, "cand_id", "t"), "cand_id", "left")
    return d.withColumns({"jn": F.coalesce(jaccard(F.col("qn"), F.col("tn")), F.lit(0.0)), "ja": F.coalesce(jaccard(F.col("qa"), F.col("ta")), F.lit(0.0))}).drop("qn", "qa", "tn", "ta")


def prune_quota(pairs: DataFrame, queries: DataFrame, targets: DataFrame, max_cands: int = 50, top_k: int = 20, quota: int = 4) -> DataFrame:
    """Queries with more than max_cands keep the best `quota` of every strategy, filled up to top_k by score."""
    d = pair_scores(pairs, queries, targets).withColumn("score", F.round(F.col("jn") + 0.2 * F.col("ja"), 9))
    d = d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("s1_id")))
    best = F.row_number().over(Window.partitionBy("s1_id", "strategy").orderBy(F.desc("score"), "cand_id"))
    chosen = d.where(F.col("n") > max_cands).select("s1_id", "cand_id", "score", F.explode("strategies").alias("strategy")).withColumn("r", best).where(F.col("r") <= quota).select("s1_id", "cand_id").distinct().withColumn("sel", F.lit(1))
    d = d.join(chosen, ["s1_id", "cand_id"], "left").withColumn("sel", F.coalesce("sel", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("sel"), F.desc("score"), "cand_id"))
    return d.withColumn("r", rank).where((F.col("n") <= max_cands) | (F.col("sel") == 1) | (F.col("r") <= top_k)).select("s1_id", "cand_id", "strategies")


def prune_ranked(pairs: DataFrame, score, top_k: int = 20, max_cands: int = 50) -> DataFrame:
    d = pairs.withColumn("score", score).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("s1_id")))
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id"))
    return d.withColumn("r", rank).where((F.col("n") <= max_cands) | (F.col("r") <= top_k)).select("s1_id", "cand_id", "score")


def prune_legacy(pairs: DataFrame, queries: DataFrame, targets: DataFrame, top_k: int = 20, max_cands: int = 50) -> DataFrame:
    """Jaccard of core-name tokens, 0.2 for each shared address token, 0.5 for an equal postal code."""
    side = lambda d, k, p: d.select(F.col("entity_id").alias(k), F.split("name_core", " ").alias(p + "n"), F.col("addr_tokens").alias(p + "a"), F.col("addr_pin").alias(p + "p"))
    d = pairs.join(side(queries, "s1_id", "q"), "s1_id").join(side(targets, "cand_id", "t"), "cand_id")
    score = jaccard(F.col("qn"), F.col("tn")) + 0.2 * F.size(F.array_intersect("qa", "ta")) + F.when((F.col("qp") == F.col("tp")) & (F.col("qp") != ""), 0.5).otherwise(0.0)
    return prune_ranked(d, F.round(score, 9), top_k, max_cands)


def blocker_score(strategies):
    """10 for each strategy, and 5, 5, 3, 2 for exact name, address, rare token, retrieval."""
    has = lambda x, w: F.when(F.array_contains(strategies, x), w).otherwise(0)
    return 10 * F.size(strategies) + has("exact_name", 5) + has("address", 5) + has("rare_token", 3) + has("char_retrieval", 2)


def ablation(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """For each strategy: the pairs and true pairs that remain without it, from one pass."""
    labels = pairs.select(F.explode("strategies").alias("strategy")).distinct()
    d = pairs.join(truth.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left").crossJoin(F.broadcast(labels))
    rest = F.size(F.array_remove("strategies", F.col("strategy"))) > 0
    return d.groupBy("strategy").agg(F.sum(rest.cast("long")).alias("pairs_without"), F.coalesce(F.sum(F.when(rest, F.col("hit"))), F.lit(0)).alias("true_without"), F.coalesce(F.sum("hit"), F.lit(0)).alias("true_all"))


def overlap_matrix(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    d = pairs.join(truth.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    d = d.select("s1_id", "cand_id", "hit", F.explode("strategies").alias("a"), "strategies").select("*", F.explode("strategies").alias("b"))
    return d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"), F.coalesce(F.sum("hit"), F.lit(0)).alias("true_both"))
