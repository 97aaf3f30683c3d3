"""Blocking and matching evaluation, decisions, error analysis: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ratio_of
from ..functions.text import script_set


def per_entity(truth: DataFrame, predicted: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(s1_id, n_true, n_pred, n_hit) over the union of ids, or over the given entities."""
    t = truth.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1))
    p = predicted.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(1))
    d = t.join(p, ["s1_id", "cand_id"], "full").groupBy("s1_id").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n_true"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pred"), F.coalesce(F.sum(F.col("t") * F.col("p")), F.lit(0)).alias("n_hit"))
    if entities is None:
        return d
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entities.select(F.col("entity_id").alias("s1_id")).join(d, "s1_id", "left").select("s1_id", zero("n_true"), zero("n_pred"), zero("n_hit"))


def ratio_or(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def blocking_metrics(truth: DataFrame, candidates: DataFrame, entities: DataFrame, n_targets: int) -> DataFrame:
    """One row: pair recall, entity recovery, sizes with exact percentiles, reduction ratio; recalls are 1 without truth."""
    e = per_entity(truth, candidates, entities)
    matched = F.col("n_true") > 0
    total = F.sum("n_pred")
    one = lambda c: F.sum(c.cast("long"))
    return e.agg(
        F.count(F.lit(1)).alias("entities"),
        total.alias("candidates"),
        F.sum("n_true").alias("true_pairs"),
        ratio_or(F.sum("n_hit"), F.sum("n_true"), 1.0).alias("pair_recall"),
        ratio_or(one(matched & (F.col("n_hit") == F.col("n_true"))), one(matched), 1.0).alias("entity_recovery"),
        one(~matched).alias("singletons"),
        one(F.col("n_pred") == 0).alias("without_candidates"),
        F.avg("n_pred").alias("mean"),
        *[F.percentile("n_pred", p).alias(n) for p, n in ((0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999"))],
        F.max("n_pred").alias("largest"),
        (F.lit(1.0) - ratio_or(total, F.count(F.lit(1)) * F.lit(n_targets), 1.0)).alias("reduction_ratio"),
    )


def f_half(p: Column, r: Column) -> Column:
    return ratio_of(1.25 * p * r, 0.25 * p + r)


def precision_recall(e: DataFrame) -> DataFrame:
    t, p, i = F.col("n_true"), F.col("n_pred"), F.col("n_hit")
    both = (t == 0) & (p == 0)
    return e.withColumns({"precision": F.when(both, 1.0).otherwise(ratio_of(i, p)), "recall": F.when(both, 1.0).otherwise(ratio_of(i, t))})


def match_metrics(truth: DataFrame, predicted: DataFrame, entities: DataFrame) -> DataFrame:
    """One row with both macro F0.5: of the mean precision and recall, and the mean over entities."""
    e = precision_recall(per_entity(truth, predicted, entities)).withColumn("f", f_half(F.col("precision"), F.col("recall")))
    single = F.col("n_true") == 0
    d = e.agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f").alias("mean_f05"),
        ratio_or(F.sum((single & (F.col("n_pred") == 0)).cast("long")), F.sum(single.cast("long")), 1.0).alias("singleton_accuracy"),
        F.coalesce(F.avg(F.when(~single, F.col("recall"))), F.lit(1.0)).alias("matched_recall"),
        F.sum("n_hit").alias("tp"),
        F.sum(F.col("n_pred") - F.col("n_hit")).alias("fp"),
        F.sum(F.col("n_true") - F.col("n_hit")).alias("fn"),
    )
    return d.withColumn("f05_of_means", f_half(F.col("precision"), F.col("recall")))


def split_metrics(truth, candidates, entities) -> DataFrame:
    e = per_entity(truth, candidates, entities).withColumn("singleton", F.col("n_true") == 0)
    return e.groupBy("singleton").agg(F.count(F.lit(1)).alias("entities"), ratio_or(F.sum("n_hit"), F.sum("n_true"), 1.0).alias("pair_recall"), F.avg((F.col("n_pred") > 0).cast("double")).alias("with_candidates"))


def legacy_metrics(truth, candidates, entities, n_targets: int) -> DataFrame:
    e = per_entity(truth, candidates, entities)
    hit = (F.col("n_true") > 0) & (F.col("n_hit") == F.col("n_true"))
    return e.agg(ratio_or(F.sum(hit.cast("long")), F.sum((F.col("n_true") > 0).cast("long")), 1.0).alias("recall"), F.avg("n_pred").alias("mean"), F.percentile("n_pred", 0.5).alias("median"), F.percentile("n_pred", 0.95).alias("p95"), F.max("n_pred").alias("largest"), (1 - F.avg("n_pred") / n_targets).alias("reduction"))


def f05_ceiling(recall: Column) -> Column:
    """The F0.5 of perfect precision at a recall."""
    return ratio_of(1.25 * recall, 0.25 + recall)


def error_pairs(truth, candidates, predicted) -> DataFrame:
    """(s1_id, cand_id, kind): blocking_miss, classifier_fn or fp."""
    mark = lambda d, n: d.select("s1_id", "cand_id").distinct().withColumn(n, F.lit(True))
    d = mark(truth, "t").join(mark(candidates, "c"), ["s1_id", "cand_id"], "left").join(mark(predicted, "p"), ["s1_id", "cand_id"], "full")
    kind = F.when(F.col("t") & F.col("c").isNull(), "blocking_miss").when(F.col("t") & F.col("p").isNull(), "classifier_fn").when(F.col("t").isNull() & F.col("p"), "fp")
    return d.withColumn("kind", kind).where("kind is not null").select("s1_id", "cand_id", "kind")


def error_decomposition(truth, candidates, predicted) -> DataFrame:
    return error_pairs(truth, candidates, predicted).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("s1_id").alias("entities"))


def failure_class(p: str = "a_", q: str = "b_") -> Column:
    """Why blocking may have missed a true pair, by the first rule that fits; raw fields of both records."""
    field = lambda side, x: F.trim(F.coalesce(F.col(side + x), F.lit("")))
    (na, nb), (aa, ab), (ca, cb) = ([field(side, x) for side in (p, q)] for x in ("business_name", "business_address", "country"))
    scripts = [script_set(n) for n in (na, nb)]
    words = [F.filter(F.split(F.lower(n), r"\s+"), lambda x: x != "") for n in (na, nb)]
    numbers = [F.regexp_extract_all(F.concat(n, F.lit(" "), a), F.lit(r"\b\d+\b"), F.lit(0)) for n, a in ((na, aa), (nb, ab))]
    alike = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)
    return (
        F.when((ca != "") & (cb != "") & (F.upper(ca) != F.upper(cb)), "country_mismatch")
        .when((F.size(scripts[0]) > 0) & (F.size(scripts[1]) > 0) & (scripts[0] != scripts[1]), "cross_script")
        .when(F.lower(ab).isin("", "nan", "none"), "missing_address")
        .when(((F.length(na) <= 4) | (F.length(nb) <= 4)) & (F.lower(na) != F.lower(nb)), "abbreviation_acronym")
        .when(alike(*words) & (words[0] != words[1]), "reordered_tokens")
        .when((F.size(numbers[0]) > 0) & (F.size(numbers[1]) > 0) & ~F.arrays_overlap(*numbers), "numeric_mismatch")
        .otherwise("severe_lexical_mutation")
    )


# decisions over (s1_id, cand_id, score)


def decide_threshold(scores: DataFrame, tau: float, inclusive: bool = False) -> DataFrame:
    return scores.where((F.col("score") >= tau) if inclusive else (F.col("score") > tau))


def decide_entries(scores: DataFrame, tau: float, inclusive: bool = False) -> DataFrame:
    """decide_threshold as one row per scored query, also for those without a hit."""
    every = scores.select(F.col("s1_id").alias("entity_id")).distinct()
    return match_lists(decide_threshold(scores, tau, inclusive), every)


def decide_band(scores: DataFrame, low: float, high: float) -> DataFrame:
    """scores with band: accept, review or reject."""
    return scores.withColumn("band", F.when(F.col("score") >= high, "accept").when(F.col("score") >= low, "review").otherwise("reject"))


def decide_top1(scores: DataFrame, tau: float) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id"))
    return scores.withColumn("r", first).where((F.col("r") == 1) & (F.col("score") >= tau)).drop("r")


def decide_margin(scores: DataFrame, tau: float, margin: float, max_matches: int | None = None) -> DataFrame:
    w = Window.partitionBy("s1_id")
    d = scores.withColumn("top", F.max("score").over(w)).where((F.col("score") >= tau) & (F.col("score") >= F.col("top") - margin)).drop("top")
    if max_matches is None:
        return d
    return d.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "cand_id"))).where(F.col("r") <= max_matches).drop("r")


def match_lists(scores: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per entity with its matches by falling score, comma-joined."""
    best = scores.groupBy("s1_id", "cand_id").agg(F.max("score").alias("score"))
    lists = best.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cand_id"))), lambda x: x["cand_id"]), ",").alias("matched_entity_ids"))
    return entities.select(F.col("entity_id").alias("source1_entity_id")).join(lists.withColumnRenamed("s1_id", "source1_entity_id"), "source1_entity_id", "left").withColumn("matched_entity_ids", F.coalesce("matched_entity_ids", F.lit("")))


GRID = tuple(round(0.3 + 0.025 * i, 3) for i in range(27))


def tune(scores: DataFrame, truth: DataFrame, entities: DataFrame, grid=GRID, inclusive: bool = False) -> DataFrame:
    """(tau, precision, recall, f05) for every threshold of a grid, in one job."""
    spark = scores.sparkSession
    taus = F.broadcast(spark.createDataFrame([(float(t),) for t in grid], "tau double"))
    pairs = scores.join(truth.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "left")
    n_true = truth.select("s1_id", "cand_id").distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    got = pairs.crossJoin(taus).where(F.col("score") >= F.col("tau") if inclusive else F.col("score") > F.col("tau")).groupBy("s1_id", "tau").agg(F.count(F.lit(1)).alias("n_pred"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_hit"))
    base = entities.select(F.col("entity_id").alias("s1_id")).join(n_true, "s1_id", "left").crossJoin(taus)
    e = base.join(got, ["s1_id", "tau"], "left").na.fill(0, ["n_true", "n_pred", "n_hit"])
    m = precision_recall(e).groupBy("tau").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    return m.withColumn("f05", f_half(F.col("precision"), F.col("recall")))


def best_threshold(tuned: DataFrame) -> DataFrame:
    """The first strict maximum of f05."""
    return tuned.orderBy(F.desc(F.round("f05", 9)), "tau").limit(1)


HIGH = tuple(round(0.5 + 0.025 * i, 3) for i in range(19))
LOW = tuple(round(0.2 + 0.025 * i, 3) for i in range(17))


def tune_band(scores: DataFrame, truth: DataFrame, entities: DataFrame, high=HIGH, low=LOW) -> DataFrame:
    """(high, low, precision, recall, f05, review) for every pair of limits, low at most high.

    What lies between the limits is no match, so f05 depends on high alone;
    review is the number of pairs between them."""
    spark = scores.sparkSession
    edges = F.broadcast(spark.createDataFrame([(float(h), float(l)) for h in high for l in low if l <= h], "high double, low double"))
    accepted = tune(scores, truth, entities, tuple(high), inclusive=True).withColumnRenamed("tau", "high")
    held = scores.crossJoin(edges).where((F.col("score") >= F.col("low")) & (F.col("score") < F.col("high"))).groupBy("high", "low").agg(F.count(F.lit(1)).alias("review"))
    return edges.join(accepted, "high").join(held, ["high", "low"], "left").na.fill(0, ["review"])


def best_band(tuned: DataFrame) -> DataFrame:
    """The first strict maximum of f05, by high and then low."""
    return tuned.orderBy(F.desc(F.round("f05", 9)), "high", "low").limit(1)


def metrics_text(m, title: str = "Blocking evaluation") -> str:
    """One row of blocking_metrics as a report."""
    lines = [
        ("pair recall", f"{m['pair_recall']:.2%} of {m['true_pairs']:,} pairs"), ("entity recovery", f"{m['entity_recovery']:.2%}"), ("candidates", f"{m['candidates']:,}"),
        ("mean per entity", f"{m['mean']:.2f}"), *((f"percentile {p}", f"{m[c]:.0f}") for p, c in ((50, "median"), (90, "p90"), (95, "p95"), (99, "p99"), (99.9, "p999"))),
        ("largest", f"{m['largest']:,}"), ("reduction ratio", f"{m['reduction_ratio']:.4%}"), ("entities without candidates", f"{m['without_candidates']:,}"), ("singletons", f"{m['singletons']:,}"),
    ]
    return "\n".join([title, "=" * len(title), *(f"{k:<28}: {v}" for k, v in lines)])


def cross_script_recall(truth: DataFrame, candidates: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Of the true pairs whose names are written in different sets of scripts: how many, how many found, and their share (1 without any)."""
    side = lambda d, k, n: d.select(F.col("entity_id").alias(k), script_set(F.col("name_clean")).alias(n))
    p = truth.join(side(queries, "s1_id", "x"), "s1_id").join(side(targets, "cand_id", "y"), "cand_id").where("x <> y")
    p = p.join(candidates.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    n, found = F.count(F.lit(1)), F.count("hit")
    return p.agg(n.alias("pairs"), found.alias("found"), ratio_or(found, n, 1.0).alias("recall"))
