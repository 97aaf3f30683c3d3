import json
import math
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessella.functions import similarity as S
from tessella.functions import text as X
from tessella.operators import blocking as B
from tessella.operators import candidates as C
from tessella.operators import evaluation as E
from tessella.operators import learning as L
from tessella.operators import quality_checks as Q
from tessella.plans import queries as linkage
from tessella.plans.presets import PRESETS, Linkage
from tessella.sources import tables
from tessella.sources.tables import read_tsv


def records(spark, rows):
    return X.normalize(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name,field,value", [
    ("Nordwind Corp.", "name_core", "nordwind"),
    ("Nordwind Corporation", "name_core", "nordwind corporation"),
    ("Kaveri Textiles Pvt. Ltd.", "name_core", "kaveri textiles"),
    ("Kaveri Textiles Pvt. Ltd.", "name_suffix_norm", "kaveri textiles private limited"),
    ("Blue Harbour LLP", "name_core", "blue harbour"),
    ("Fromagerie du Lac SAS", "name_core", "fromagerie du lac"),
    ("www.quickparcel.co", "name_clean", "quickparcel"),
    ("Çelik & Fils S.A.R.L.", "name_clean", "çelik and fils s a r l"),
    ("ＺＥＴＡ", "name_clean", "zeta"),
])
def test_names(spark, name, field, value):
    assert records(spark, [("S1-1", name, "", "")]).first()[field] == value


def test_word_order_and_addresses(spark):
    a, b, c = records(spark, [("S1-1", "Zinc Amber", "14/2(8), M.G. Lane, 3rd Cross Street, Pune 411001", "in"), ("S1-2", "Amber Zinc", "", None), ("S1-3", None, "null", "")]).orderBy("entity_id").collect()
    assert a["name_sorted"] == b["name_sorted"] == "amber zinc"
    assert (a["addr_pin"], a["addr_numbers"], a["addr_primary_num"]) == ("411001", ["14", "2", "8", "411001"], "14/2")
    assert b["addr_is_missing"] and c["addr_is_missing"] and c["name_clean"] == ""


def test_grams(spark):
    r = spark.createDataFrame([("ab c",)], "x string").select(X.char_ngrams(F.col("x")).alias("c"), X.word_ngrams(F.lit("ab c de f gh")).alias("w")).first()
    assert sorted(r.c) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])
    assert sorted(r.w) == sorted(["ab", "de", "gh", "ab de", "de gh"])


def test_strings():
    assert S.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert S.common_subsequence("abcbdab", "bdcaba") == 4
    assert S.token_sort("b a", "a b") == 100 and S.token_set("a b", "a b c") == 100
    assert S.weighted("", "x") == 0


def test_cap_boundary_and_routes(spark):
    t = records(spark, [(f"S2-{i}", "x", "5 A St 10001" if i < 3 else "7 A St 10002", "fr") for i in range(7)])
    q = records(spark, [("S1-1", "y", "5 B St 10001", "FR"), ("S1-2", "y", "7 B St 10002", ""), ("S1-3", "y", "5 B St 10001", "us")])
    got = rows(B.by_pin_number(q, t, cap=3))
    assert got == {(f"S1-{i}", f"S2-{j}") for i in (1, 3) for j in range(3)}


def test_rare_token_needs_both_sides(spark):
    t = records(spark, [("S2-1", "aaa bbb ccc", "", ""), ("S2-2", "ccc ddd", "", "")])
    q = records(spark, [("S1-1", "ccc zzz", "", "")])
    assert rows(B.rare_tokens(q, t, n=1)) == set()
    assert rows(B.rare_tokens(q, t, n=3)) == {("S1-1", "S2-1"), ("S1-1", "S2-2")}


def test_retrieval_ties_and_reverse(spark):
    t = records(spark, [("S2-1", "alpha beta", "", ""), ("S2-2", "alpha beta", "", ""), ("S2-3", "gamma", "", "")])
    q = records(spark, [("S1-1", "alpha beta", "", ""), ("S1-2", "alpha betas", "", "")])
    one = B.char_retrieval(q, t, k=1, max_df=1.0, min_df=1)
    assert {(r.s1_id, r.cand_id) for r in one.collect()} == {("S1-1", "S2-1"), ("S1-2", "S2-1")}
    both = B.char_retrieval(q, t, k=1, max_df=1.0, min_df=1, reverse=1)
    assert ("S1-1", "S2-2") in {(r.s1_id, r.cand_id) for r in both.collect()}


def test_translit_is_one_sided(spark):
    t = records(spark, [("S2-1", "società", "", ""), ("S2-2", "societa", "", "")])
    q = records(spark, [("S1-1", "societa", "", "")])
    assert rows(B.translit_names(q, t)) == {("S1-1", "S2-1")}


def test_quota(spark):
    q = records(spark, [("S1-1", "q", "", "")])
    t = records(spark, [(f"S2-{i:02}", f"n{i}", "", "") for i in range(51)])
    pairs = spark.createDataFrame([("S1-1", f"S2-{i:02}", ["a"] if i < 40 else ["b"]) for i in range(51)], "s1_id string, cand_id string, strategies array<string>")
    got = C.prune_quota(pairs, q, t).collect()
    assert len(got) == 20 and sum(r.strategies == ["b"] for r in got) >= 4
    assert C.prune_quota(pairs.limit(50), q, t).count() == 50


def test_metrics(spark):
    pair = "s1_id string, cand_id string"
    ents = spark.createDataFrame([(f"S1-{i}",) for i in range(4)], "entity_id string")
    truth = spark.createDataFrame([("S1-0", "a"), ("S1-0", "b"), ("S1-1", "c")], pair)
    pred = spark.createDataFrame([("S1-0", "a"), ("S1-2", "x")], pair)
    m = E.match_metrics(truth, pred, ents).first()
    assert (m.precision, m.recall, m.singleton_accuracy, m.matched_recall) == (0.5, 0.375, 0.5, 0.25)
    assert m.mean_f05 == pytest.approx((1.25 * 0.5 / 0.75 + 1) / 4)
    assert E.blocking_metrics(truth.limit(0), pred, ents, 10).first().pair_recall == 1.0


def test_decisions(spark):
    s = spark.createDataFrame([("S1-1", "a", 0.95), ("S1-1", "b", 0.9), ("S1-1", "c", 0.86), ("S1-1", "d", 0.7)], "s1_id string, cand_id string, score double")
    assert E.decide_threshold(s, 0.9).count() == 1 and E.decide_threshold(s, 0.9, True).count() == 2
    assert E.decide_margin(s, 0.8, 0.1).count() == 3


def test_validation_and_splits(spark):
    ents = spark.createDataFrame([(f"S1-{i}",) for i in range(200)], "entity_id string")
    bad = spark.createDataFrame([("S1-0", "S2-1,S2-1"), ("S1-1", "S1-5"), ("S1-2", "X"), ("S1-3", ""), ("S1-3", ""), ("S1-999", "")], "source1_entity_id string, matched_entity_ids string")
    found = {r.finding for r in Q.validate(bad, ents).collect()}
    assert found == {"duplicate_in_list", "self_match", "bad_prefix", "duplicate_row", "missing_entity", "extra_entity"}
    p = Q.split(ents, {"train": 0.75, "valid": 0.15, "test": 0.1})
    assert p.count() == 200 and Q.leaked(p.where("part = 'train'"), p.where("part = 'test'")).count() == 0


def test_presets_round_trip():
    for p in PRESETS.values():
        assert Linkage.from_dict(p.to_dict()) == p


def test_read_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a ""b"""\t\t\n')
    assert tuple(read_tsv(spark, str(tmp_path / "a.tsv")).first()) == ("S1-1", 'a "b"', "", "")


def test_no_cartesian_products(spark):
    t = records(spark, [("S2-1", "alpha beta", "5 A St 10001", "fr")])
    for f in (B.exact_names, B.by_pin_number, B.rare_tokens, B.token_intersection):
        plan = f(t, t)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, accents, nulls and empty texts."""
    at = tmp_path_factory.mktemp("docs")
    base = ["société générale", "crédit lyonnais maritime", "straße zürich", "harbour timber trading", "señora mañana textiles", "northern copper works"]
    rows = []
    for i in range(1, 151):
        k = i // 5
        line = f"{base[k % 6]} place{chr(97 + k % 26)}ville number{'xyz'[k % 3]}{chr(97 + k // 7)} quarter"
        rows.append((i, f"{line} {'extra' * (i % 4 == 0)}\n{'tail' if i % 9 else 'other tail'} of it", "fr" if k % 2 else "en", f"s{i % 4}", 100 + k + (i % 5 == 4)))
    rows += [(151, None, "en", "s1", 3), (152, "", None, None, None), (None, "no id", "en", "s1", 5), (153, "x", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at)


CHECKED = ("norm_name", "norm_addr", "primary_script", "script_set", "translit_names", "char_ngrams", "scan_tsv", "sink_results", "sink_candidates", "block_exact", "block_rare", "block_loc_num", "block_soft", "block_hybrid",
           "block_acronym", "block_translit", "block_xscript_addr", "block_char", "legacy_candidates", "prune_quota", "tune_band", "validate", "failure_class", "xscript_recall", "features", "hnm_weights", "strat_sample", "sample_entities", "bundle_load")


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    got = linkage.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    have = sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=repr)
    run = con.execute(linkage.ORACLES[name])
    names = [c[0] for c in run.description]
    want = sorted((tuple(cell(r[names.index(c)]) for c in columns) for r in run.fetchall()), key=repr)
    assert have == want and have


def test_other_ratios(spark, folder):
    """The four ratios without SQL, against subsequences found by dynamic programming."""

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    ratio = lambda a, b: 2 * common(a, b) / (len(a) + len(b))
    ordered = lambda x: " ".join(sorted(x.split()))
    q, t = linkage.sides(spark, folder)
    names = {r.entity_id: (r.name_clean, r.addr_clean, r.addr_is_missing) for r in q.unionByName(t).collect()}
    rows_ = linkage.featured(spark, folder).collect()
    assert rows_
    for r in rows_:
        (na, aa, ma), (nb, ab, mb) = names[r.s1_id], names[r.cand_id]
        assert r.name_token_sort_ratio == pytest.approx(ratio(ordered(na), ordered(nb)))
        whole = not (ma or mb or len(aa) < 3 or len(ab) < 3)
        assert r.addr_token_sort_ratio == pytest.approx(ratio(ordered(aa), ordered(ab)) if whole else 0)
        x, y = set(na.split()), set(nb.split())
        both = ordered(" ".join(x & y))
        p, s = (f"{both} {ordered(' '.join(z))}".strip() for z in (x - y, y - x))
        want = 1 if x & y and (x <= y or y <= x) else max([ratio(p, s)] + ([ratio(both, p), ratio(both, s)] if both else []))
        assert r.name_token_set_ratio == pytest.approx(want) and r.name_wratio >= max(ratio(na, nb), 0.0) - 1e-9


def test_files(spark, tmp_path):
    d = records(spark, [("S1-1", "a", "", "")]).select("entity_id", "business_name", "business_address", "country")
    with pytest.raises(FileNotFoundError):
        tables.discover(spark, [str(tmp_path)])
    for n in tables.TEST:
        tables.write_tsv(d, f"{tmp_path}/{n}", None)
    got = tables.bundle(spark, tables.discover(spark, [f"{tmp_path}/none", str(tmp_path)], tables.TEST), tables.TEST)
    assert set(got) == {"test_source1", "test_source2", "test_source3"} and rows(got["test_source2"]) == {("S1-1", "a", "", "")}
    bad = spark.createDataFrame([(0, "Source1_Entity_ID\tx"), (1, "S1-1\t"), (2, "S1-2"), (3, "")], "place long, value string")
    assert rows(Q.file_findings(bad)) == {("bad_header", "Source1_Entity_ID\tx"), ("no_tab", "S1-2")}
    (tmp_path / "run.json").write_text(json.dumps(PRESETS["yaml"].to_dict()))
    assert Linkage.load(f"{tmp_path}/run.json") == PRESETS["yaml"]


def test_reports(spark):
    pair = "s1_id string, cand_id string"
    ents = spark.createDataFrame([(f"S1-{i}",) for i in range(4)], "entity_id string")
    truth, pred = spark.createDataFrame([("S1-0", "a"), ("S1-0", "b"), ("S1-1", "c")], pair), spark.createDataFrame([("S1-0", "a"), ("S1-2", "x")], pair)
    text = E.metrics_text(E.blocking_metrics(truth, pred, ents, 10).first())
    assert "33.33% of 3 pairs" in text and "0.50" in text
    cost = Q.projected_cost(lambda q: q, ents, 0.5)
    assert (cost["sample_size"], cost["full_size"], cost["projected_pairs"]) == (2, 4, 4)


def test_mining(spark):
    f = spark.createDataFrame([("S1-1", "a", 1), ("S1-1", "b", 0), ("S1-2", "a", 0), ("S1-2", "b", 0)], "s1_id string, cand_id string, label int")
    s = spark.createDataFrame([("S1-1", "b", 0.9), ("S1-2", "a", 0.4), ("S1-2", "b", 0.6)], "s1_id string, cand_id string, score double")
    total = {k: L.mined(f, s, k).agg({"weight": "sum"}).first()[0] for k in L.MINING}
    assert total == {"none": 4, "singleton_30_w3": 8, "singleton_50_w5": 8, "all_50_w2": 6, "all_50_w3": 8, "singleton_30_twice": 6, "all_50_twice": 6}


def test_heavy_terms(spark, monkeypatch):
    """Postings of frequent terms are split without changing the result."""
    t = records(spark, [(f"S2-{i}", f"common word{i % 5} end", "", "") for i in range(40)])
    q = records(spark, [(f"S1-{i}", f"common word{i} end", "", "") for i in range(5)])
    want = rows(B.char_retrieval(q, t, k=50))
    monkeypatch.setattr(B, "HEAVY", 3)
    assert rows(B.char_retrieval(q, t, k=50)) == want and len(want) >= 40


@pytest.mark.parametrize("kind", ["lr", "rf"])
def test_models_travel_without_the_session(spark, kind):
    """Scoring tasks are sent the model only: a session can't be sent once an observation has been made in it."""
    spark.range(3).observe(Observation(), F.count(F.lit(1)).alias("n")).collect()
    f = spark.range(60).select(F.col("id").cast("string").alias("s1_id"), F.col("id").cast("string").alias("cand_id"), F.rand(1).alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    assert len(L.score(L.train(f, kind, ["x"]), f).collect()) == 60


def test_out_of_fold_travels_without_the_session(spark):
    """Every pair is scored once, after an observation too, by the model that has not seen its fold."""
    spark.range(3).observe(Observation(), F.count(F.lit(1)).alias("n")).collect()
    f = spark.range(60).select(F.col("id").cast("string").alias("s1_id"), F.col("id").cast("string").alias("cand_id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    folds = f.select(F.col("s1_id").alias("entity_id"), (F.col("s1_id").cast("int") % 2).alias("fold"))
    d = f.join(folds.withColumnRenamed("entity_id", "s1_id"), "s1_id")
    want = set().union(*(rows(L.score(L.train(d.where(F.col("fold") != i), "lr", ["x"]), d.where(F.col("fold") == i))) for i in (0, 1)))
    got = L.out_of_fold(f, folds, "lr", ["x"], 2).collect()
    assert len(got) == 60 and {tuple(r) for r in got} == want


def test_best_of_a_block():
    """Frequent and rare terms, ties and unknown terms, against all products; only k rows leave a block for each query."""
    rng = np.random.default_rng(5)
    terms = [np.sort(rng.choice(60, 8, replace=False)) * (1 << 33) if i % 2 else np.sort(np.r_[0, rng.choice(np.arange(1, 3000), 7, replace=False)]) * (1 << 33) for i in range(500)]
    make = lambda rows, p: pd.DataFrame({"id": [f"{p}{i:03}" for i in range(len(rows))], "ks": rows, "ws": [np.full(8, 8**-0.5) for _ in rows]})
    left, right = make(terms[:100], "a"), make(terms[100:] + terms[100:150], "b")
    got = B.best_of(left, right, 3, 0.2)
    want = []
    for i, x in enumerate(left["ks"]):
        s = sorted((-len(np.intersect1d(x, y)) / 8, r) for r, y in zip(right["id"], right["ks"], strict=True))
        want += [(f"a{i:03}", r, -v) for v, r in s[:3] if -v >= 0.2]
    assert sorted(zip(got.l_id, got.r_id, got.score.round(9), strict=True)) == sorted(want) and len(want) > 100
    assert not len(B.best_of(left, right[:0], 3, 0.2))


def test_both_ways_from_one_comparison(spark, monkeypatch):
    """Each right row's best left rows, against all products; records are sent to be compared once for both ways."""
    monkeypatch.setattr(B, "COMPARED", 7)
    rng = np.random.default_rng(6)
    make = lambda n, p: pd.DataFrame({"id": [f"{p}{i:03}" for i in rng.permutation(n)], "ks": [np.sort(rng.choice(30, 6, replace=False)) for _ in range(n)], "ws": [np.full(6, 6**-0.5)] * n})
    left, right = make(90, "a"), make(70, "b")
    got = B.best_of(left, right, 3, 0.2, 2)
    want = set()
    for r, y in zip(right["id"], right["ks"], strict=True):
        s = sorted((-len(np.intersect1d(x, y)), a) for a, x in zip(left["id"], left["ks"], strict=True))
        want |= {(a, r) for v, a in s[:2] if -v / 6 >= 0.2}
    assert set(zip(got.l_id[got.way == 2], got.r_id[got.way == 2], strict=True)) == want and (got.way == 2).sum() == len(want) > 100
    assert got[got.way == 1].drop(columns="way").reset_index(drop=True).equals(B.best_of(left, right, 3, 0.2).drop(columns="way"))
    t = records(spark, [(f"S2-{i}", f"common word{i % 5} end", "", "") for i in range(40)])
    plan = B.char_retrieval(t, t, reverse=1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1


def test_retrieval_moves_no_pairs_of_terms(spark):
    """Pairs of records leave a task only if they are among the best of a query."""
    t = records(spark, [(f"S2-{i}", f"common word{i % 5} end", "", "") for i in range(40)])
    plan = B.char_retrieval(t, t)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "sum((w" not in plan


@pytest.mark.parametrize("find", [B.char_retrieval, B.legacy_neighbours, lambda q, t: B.char_retrieval(q, t, reverse=1)])
def test_retrieval_moves_packed_records(spark, monkeypatch, tmp_path, find):
    """A record takes few bytes of disk: its terms are written once for its piece, and its vector once for all routes."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 8)) for _ in range(300)]
    name = lambda: " ".join(rng.choice(words, 4))
    t = records(spark, [(f"S2-{i}", name(), "", "fr" if i % 2 else "en") for i in range(4000)])
    q = records(spark, [(f"S1-{i}", name(), "", "fr" if i % 9 else "") for i in range(40)])
    paths = []

    def landed(df, name):
        paths.append(tmp_path / f"{len(paths)}-{name}")
        df.write.parquet(str(paths[-1]))
        return df.sparkSession.read.parquet(str(paths[-1]))

    monkeypatch.setattr(B, "landed", landed)
    assert find(q, t).count() > 40
    assert sum(f.stat().st_size for p in paths for f in p.glob("*.parquet")) < 400 * 4000


def test_retrieval_with_repeated_ids(spark):
    """An id with two records has the terms of both, counts once in frequencies, and is met in both countries."""
    t = records(spark, [("S2-1", "amber zinc", "", "fr"), ("S2-1", "cobalt", "", "en"), ("S2-2", "amber", "", "fr"), ("S2-3", "cobalt zinc", "", None)])
    q = records(spark, [("S1-1", "amber cobalt", "", "fr"), ("S1-2", "cobalt", "", "en"), ("S1-3", "zinc", "", "xx"), ("S1-4", None, "", "fr")])
    got = rows(B.char_retrieval(q, t, least=0.1).select("s1_id", "cand_id"))
    assert got == {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-1"), ("S1-3", "S2-1"), ("S1-3", "S2-3")}


@pytest.mark.parametrize("find", [B.legacy_neighbours, lambda q, t, **o: B.char_retrieval(q, t, reverse=1, **o)], ids=["knn", "recip"])
def test_retrieval_packs_copies_once(spark, monkeypatch, tmp_path, find):
    """The same as if each record were compared, but records of one route and name are packed, and so sent, once."""
    names = [f"{a} {b}" for a in ("amber", "cobalt", "zinc trading") for b in ("lyon", "metz")]
    t = records(spark, [(f"S2-{(i * 37) % 211}", names[i % 6], "", ("fr", "en", "")[i % 3]) for i in range(200)] + [("S2-0", "cobalt", "", "de"), ("S2-0", "metz", "", "fr"), ("S2-300", None, "", "fr")])
    q = records(spark, [(f"S1-{(i * 11) % 97}", names[(i * i) % 6] + " co" * (i % 2), "", ("fr", "en", "xx")[i % 3]) for i in range(60)] + [("S1-0", "zinc", "", "en"), ("S1-99", "metz", "", "fr"), ("S1-99", "metz", "", "fr")])
    write, packs = B.landed, []

    def landed(df, name):
        out = write(df, name)
        if name.endswith("-pieces"):
            packs.append(out.agg(F.sum(F.size("ids"))).first()[0])
        return out

    monkeypatch.setattr(B, "landed", landed)
    got = [tuple(r) for r in find(q, t, k=5, least=0.1).select("s1_id", "cand_id").collect()]

    def vectors(d):
        out = {}
        for r in d.select("entity_id", X.char_ngrams(F.col("name_clean"))).collect():
            out.setdefault(r[0], Counter()).update(r[1] or ())
        return out

    tt, qq = vectors(t), vectors(q)
    df = Counter(g for v in tt.values() for g in v)
    n = t.count()
    idf = {g: math.log((1 + n) / (1 + x)) + 1 for g, x in df.items() if 2 <= x <= 0.9 * n}
    reciprocal = find is not B.legacy_neighbours

    def unit(v):
        w = {g: (1 + math.log(x) if reciprocal else x) * idf[g] for g, x in v.items() if g in idf}
        return {g: x / math.sqrt(sum(y * y for y in w.values())) for g, x in w.items()}

    tt, qq = ({e: unit(v) for e, v in d.items()} for d in (tt, qq))
    country = lambda d: {(r.entity_id, r.country_norm) for r in d.collect()}
    ct, cq = country(t), country(q)
    known = {c for _, c in ct if c}
    met = {(x, y) for x, c in cq for y, e in ct if not reciprocal or c not in known or c == e}
    score = {(x, y): round(sum(w * tt[y].get(g, 0) for g, w in qq[x].items()), 9) for x, y in met}
    score = {p: v for p, v in score.items() if v >= 0.1}
    want = {p for p, v in score.items() if sum((-w, o[1]) < (-v, p[1]) for o, w in score.items() if o[0] == p[0]) < 5}
    if reciprocal:
        want |= {p for p, v in score.items() if not any((-w, o[0]) < (-v, p[0]) for o, w in score.items() if o[1] == p[1])}
    assert sorted(got) == sorted(want) and len(want) > 200
    assert len(packs) == 2 and sum(packs) < 60


def test_best_by_jaccard_with_copies_and_repeated_ids(spark):
    """The same as every pair's score, and copies meet as one class only."""
    name = lambda i: " ".join(f"w{(i * k) % 7}" for k in range(1, 3 + i % 5))
    q = records(spark, [(f"S1-{i}", name(i), "", "fr" if i % 3 else "en") for i in range(60)] + [("S1-7", name(7), "", "fr")])
    t = records(spark, [(f"S{2 + i % 2}-{i}", name(i + 1), "", "fr" if i % 4 else "en") for i in range(80)] + [("S2-8", name(9), "", "en")])
    bag = lambda d: [(r.entity_id, r.country_norm, set(r.name_tokens)) for r in d.collect()]
    bq, bt = bag(q), bag(t)
    known = {w for *_, s in bq for w in s}
    total = lambda b, i: sum(len(s & known) for e, _, s in b if e == i)
    for threshold in (0.3, 0.5, 0.85):
        best = {}
        for x in {e for e, *_ in bq}:
            for y in {e for e, *_ in bt}:
                n = sum(len(s & z) for e, c, s in bq if e == x for f, d, z in bt if f == y and c == d)
                if n and n / (total(bq, x) + total(bt, y) - n) > threshold:
                    best.setdefault((x, y[:2]), []).append((-n / (total(bq, x) + total(bt, y) - n), y))
        want = {(x, min(v)[1], s, -min(v)[0]) for (x, s), v in best.items()}
        assert rows(B.best_by_jaccard(q, t, threshold)) == want and want


def test_best_by_jaccard_vocabularies(spark):
    """zz is a word of the queries, but not of those of its country; yy is no query's word."""
    q = records(spark, [("S1-1", "aa bb cc dd", "", "fr"), ("S1-2", "zz ww", "", "en")])
    t = records(spark, [("S2-1", "aa bb cc dd zz", "", "fr"), ("S3-1", "aa bb cc dd yy", "", "fr"), ("S3-2", "zz ww yy", "", "en")])
    best = lambda *how: {(r.s1_id, r.cand_id, r.score) for r in B.best_by_jaccard(q, t, 0.85, *how).collect()}
    first = {("S1-1", "S3-1", 1.0), ("S1-2", "S3-2", 1.0)}
    assert best("country_vocab") == first | {("S1-1", "S2-1", 1.0)}
    assert best() == best("query_vocab") == first and best("full") == set()


def test_shared_tokens_are_not_made_distinct(spark):
    """A pair arises once, whatever it shares, without a shuffle of pairs."""
    q = records(spark, [("S1-1", "aa bb cc", "", "fr"), ("S1-1", "bb dd", "", "en"), ("S1-2", "zz", "", "fr")])
    t = records(spark, [("S2-1", "cc bb", "", "fr"), ("S2-1", "dd bb", "", "en"), ("S2-2", "aa", "", "en")])
    got = B.token_intersection(q, t)
    assert [tuple(r) for r in got.collect()] == [("S1-1", "S2-1")]
    assert "Aggregate [s1_id" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_pairs_of_a_frequent_token_arise_in_several_tasks(spark, monkeypatch):
    """The same as all pairs, each once; a token that all records have is dealt to tasks in blocks."""
    monkeypatch.setattr(B, "BLOCK", 7, raising=False)
    name = lambda i: " ".join(["common"] * (i % 9 > 0) + [f"w{(i * k) % 11}" for k in range(1, 2 + i % 4)])
    q = records(spark, [(f"S1-{i}", name(i), "", "fr" if i % 8 else "en") for i in range(40)] + [("S1-3", "other zz", "", "en"), ("S1-99", "common", "", None)])
    t = records(spark, [(f"S2-{i}", name(i + 5), "", "fr" if i % 7 else "") for i in range(60)] + [("S2-3", "zz", "", "en"), ("S2-99", None, "", "fr")])
    bag = lambda d: [(r.entity_id, r.country_norm, set(r.name_tokens or ())) for r in d.collect()]
    want = {(x, y) for x, c, a in bag(q) for y, e, b in bag(t) if c is not None and c == e and a & b}
    got = B.token_intersection(q, t)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1000
    assert got.groupBy(F.spark_partition_id()).count().count() > 1


def test_near_tokens(monkeypatch):
    """All near tokens are found, and Jaro-Winkler is computed for few pairs only."""
    rng = np.random.default_rng(3)
    word = lambda: "and" + "".join(rng.choice(list("abcdefghijé"), rng.integers(2, 9)))
    a, b = sorted({word() for _ in range(150)}), sorted({word() for _ in range(200)})
    b += [x[:-1] + "z" for x in a[:40]]
    want = {(x, y) for x in a for y in b if x != y and abs(len(x) - len(y)) <= 3 and S.jaro_winkler_of(x, y) >= 0.9}
    calls = []
    monkeypatch.setattr(B, "jaro_winkler_of", lambda x, y: calls.append(1) or S.jaro_winkler_of(x, y))
    frame = lambda x: pd.DataFrame({"p": "and", "token": x})
    got = B.near_tokens(frame(a), frame(b), 0.9)
    assert set(zip(got.qt, got.key, strict=True)) == want and len(want) > 30
    assert len(calls) < len(a) * len(b) / 4
    assert not len(B.near_tokens(frame(a), frame([]), 0.9))


def test_near_tokens_are_compared_many_at_once(monkeypatch):
    """The same as one by one, repeats and letters beyond ASCII included; only texts of over 64 letters are compared singly."""
    rng = np.random.default_rng(5)
    word = lambda n: "and" + "".join(rng.choice(list("abcdéअ"), n))
    a, b = (sorted({word(rng.integers(2, 14)) for _ in range(300)} | {"and" + "ab" * 40, "and" + "ab" * 30 + "a"} | more) for more in ({"and" + "x" * 61}, {"and" + "x" * 60, "and" + "ab" * 40 + "b"}))
    want = {(x, y) for x in a for y in b if x != y and abs(len(x) - len(y)) <= 3 and S.jaro_winkler_of(x, y) >= 0.9}
    calls = []
    monkeypatch.setattr(B, "jaro_winkler_of", lambda x, y: calls.append((x, y)) or S.jaro_winkler_of(x, y))
    frame = lambda x: pd.DataFrame({"p": "and", "token": x})
    got = B.near_tokens(frame(a), frame(b), 0.9)
    assert sorted(zip(got.qt, got.key, strict=True)) == sorted(want) and len(want) > 100 and max(len(x) for x, _ in want) > 64
    assert all(len(x) > 64 or len(y) > 64 for x, y in calls)


def test_soft_pairs_arise_in_blocks(spark, monkeypatch):
    """The same as all pairs, each once, without a shuffle of pairs; a token that all queries have is dealt to several tasks."""
    monkeypatch.setattr(B, "ALIKE", 3)
    monkeypatch.setattr(B, "TOGETHER", 4, raising=False)
    word = lambda i: "harbou" + "rstuv"[i % 5] + "xyz"[i % 3]
    q = records(spark, [(f"S1-{i}", f"harbours {word(i)}", "", ("fr", "en", "")[i % 3]) for i in range(12)] + [("S1-3", "timbers", "", "en")])
    t = records(spark, [(f"S2-{i}", f"{word(i)} {word(i + 4)}", "", "fr" if i % 4 else "en") for i in range(20)] + [("S2-3", "timberz", "", "fr")])
    bag = lambda d: [(r.entity_id, r.country_norm, set(r.name_informative_tokens)) for r in d.collect()]
    bq, bt = bag(q), bag(t)
    route = [(e, c if c in {"FR", "EN"} else "*") for e, c, _ in bq]
    near = lambda x, y: x != y and x[:3] == y[:3] and abs(len(x) - len(y)) <= 3 and S.jaro_winkler_of(x, y) >= 0.9
    few = {(r, k) for r in ("FR", "EN", "*") for _, _, ks in bt for k in ks if sum(k in z and r in (c, "*") for _, c, z in bt) <= 8}
    want = {(e, f) for e, r in route for g, _, xs in bq if g == e for f, c, ys in bt for x in xs for y in ys if r in (c, "*") and (r, y) in few and near(x, y)}
    got = B.soft_tokens(q, t, cap=8)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
    assert "Aggregate [s1_id" not in got._jdf.queryExecution().optimizedPlan().toString()
