"""The linkage engine's registered queries, over records derived from whole
documents, and the SQL that DuckDB runs against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import blocking as B
from ..operators import candidates as C
from ..operators import evaluation as E
from ..operators import learning as L
from ..operators import quality_checks as Q
from ..sources import tables as T
from ..sources.storage import fresh_path, landed
from . import sql as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, more: dict[str, str] | None = None):
    """Register a query; sql selects from the tables of sql.py and those in more."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql if sql.lstrip().lower().startswith("with") else D.with_tables(more) + sql
        return f

    return add


# shared inputs

_LANDED: dict[tuple[str, str, str], DataFrame] = {}


def once(s, d, name: str, make) -> DataFrame:
    """make() written to the shared folder, once per session and input folder; inputs are taken not to change."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _LANDED:
        _LANDED[key] = landed(make(), name)
    return _LANDED[key]


def records(s, d) -> DataFrame:
    def make():
        r = T.records(s, d)
        n = s.sparkContext.defaultParallelism
        # a table that one task would read is dealt to all; long texts are much work for few bytes
        small = int(str(r._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < n << 25
        return r if not small else T.records(s, d, n)

    return once(s, d, "records", make)


def normal(s, d) -> DataFrame:
    return once(s, d, "normal", lambda: X.normalize(records(s, d)))


def sides(s, d):
    return T.sources(normal(s, d))


def cands(s, d) -> DataFrame:
    q, t = sides(s, d)
    return C.union({"exact_name": B.exact_names(q, t), "address": B.by_pin_number(q, t), "rare_token": B.rare_tokens(q, t)})


def scored(s, d) -> DataFrame:
    q, t = sides(s, d)
    x, y = (side.select(F.col("entity_id").alias(k), F.col("name_tokens").alias(n)) for side, k, n in ((q, "s1_id", "x"), (t, "cand_id", "y")))
    p = cands(s, d).join(x, "s1_id").join(y, "cand_id")
    return p.select("s1_id", "cand_id", "strategies", F.round(S.jaccard(F.col("x"), F.col("y")), 6).alias("score"))


def true_pairs(s, d) -> DataFrame:
    return T.truth(records(s, d))


def pairs_only(df: DataFrame) -> DataFrame:
    return df.select("s1_id", "cand_id")


def labelled(s, d) -> DataFrame:
    return cands(s, d).join(true_pairs(s, d).distinct().withColumn("label", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def featured(s, d) -> DataFrame:
    return once(s, d, "features", lambda: S.pair_features(S.pair_records(labelled(s, d), *sides(s, d))))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def number(c: str):
    """The number in an id."""
    return F.substring_index(c, "-", -1).cast("long")


NUM = "split_part({}, '-', 2)::bigint"


# normal forms


def col_query(name: str, sql: str, **columns) -> None:
    query(name, f"select entity_id, {sql} from norm")(lambda s, d: normal(s, d).select("entity_id", *[make().alias(k) for k, make in columns.items()]))


def same(*names: str) -> dict:
    return {n: (lambda n=n: F.col(n)) for n in names}


joined = lambda c: lambda: F.array_join(c, " ")
col_query("strip_web", D.folded("lower(business_name) || '.com www.' || country", [(p, "") for p in X.WEB_PARTS]) + " as v", v=lambda: X.strip_web(F.concat(F.lower("business_name"), F.lit(".com www."), "country")))
col_query("norm_unicode", "lower(trim(nfc_normalize(business_name))) as v", v=lambda: X.fold_unicode(F.col("business_name")))
col_query("norm_name", "name_clean, name_suffix_norm, name_core, name_sorted, array_to_string(inf, ' ') as informative", **same("name_clean", "name_suffix_norm", "name_core", "name_sorted"), informative=joined("name_informative_tokens"))
col_query("suffix_expand", "name_suffix_norm as v", v=lambda: F.col("name_suffix_norm"))
col_query("suffix_core", "name_core as v", v=lambda: F.col("name_core"))
col_query("informative_tokens", "array_to_string(inf, ' ') as v", v=joined("name_informative_tokens"))
col_query("token_sort", "name_sorted as v", v=lambda: F.col("name_sorted"))
col_query("norm_addr", "addr_clean, addr_pin, array_to_string(addr_numbers, ' ') as numbers, addr_primary_num, addr_is_missing", **same("addr_clean", "addr_pin", "addr_primary_num", "addr_is_missing"), numbers=joined("addr_numbers"))
col_query("addr_abbrev", "addr_clean as v", v=lambda: F.col("addr_clean"))
col_query("normalize_table", "country_norm, name_clean, name_core, name_sorted, addr_clean, addr_pin", **same("country_norm", "name_clean", "name_core", "name_sorted", "addr_clean", "addr_pin"))
col_query("is_non_ascii", r"regexp_matches(business_name, '[^\x00-\x7F]') as v", v=lambda: X.is_non_ascii(F.col("business_name")))
FIRST = r"regexp_extract(business_name, '[\p{Devanagari}\p{Tamil}\p{Latin}]')"
col_query("primary_script", rf"case when regexp_matches({FIRST}, '\p{{Devanagari}}') then 'Devanagari' when regexp_matches({FIRST}, '\p{{Tamil}}') then 'Tamil' else 'Latin' end as v", v=lambda: X.primary_script(F.col("business_name")))
col_query("script_set", f"array_to_string({D.scripts('business_name')}, ',') as v", v=lambda: F.array_join(X.script_set(F.col("business_name")), ","))
col_query("locality", "loc as v", v=lambda: X.locality(F.col("addr_tokens")))
col_query("acronym", "acr as v", v=lambda: X.acronym(F.col("name_tokens")))
col_query("noise_free_country", "country_norm as v", v=lambda: F.col("country_norm"))
col_query("word_ngrams", f"array_to_string(list_sort({D.word_grams()}), '|') as v", v=lambda: F.array_join(F.array_sort(X.word_ngrams(F.col("name_clean"))), "|"))
col_query("char_ngrams", f"array_to_string(list_sort({D.char_grams()}), '|') as v", v=lambda: F.array_join(F.array_sort(X.char_ngrams(F.col("name_clean"))), "|"))
col_query("translit_names", f"{D.reading('business_name')} as v", v=lambda: X.transliterate(F.col("business_name")))
col_query("safe_text", f"{D.safe('x')} as v from (select entity_id, case when num % 5 = 0 then ' NaN ' when num % 5 = 1 then 'None' else business_name end as x from norm) --", v=lambda: S.safe(F.when(number("entity_id") % 5 == 0, " NaN ").when(number("entity_id") % 5 == 1, "None").otherwise(F.col("business_name"))))


@query("list_serde", "select entity_id, array_to_string(name_tokens, ' ') as v, len(name_tokens)::int as n from norm")
def _(s, d):
    back = T.text_to_lists(T.lists_to_text(normal(s, d).select("entity_id", "name_tokens"), ["name_tokens"]), ["name_tokens"])
    return back.select("entity_id", F.array_join("name_tokens", " ").alias("v"), F.size("name_tokens").alias("n"))


@query("translit")
def _(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", X.transliterate(F.col("text")).alias("v"))


query("norm_baseline", rf"select entity_id, trim(regexp_replace(regexp_replace(lower(business_name), {D.WORDLESS}, ' ', 'g'), '\s+', ' ', 'g')) as name, lower(trim(country)) as country from rec")(lambda s, d: X.normalize_baseline(records(s, d)))

# scans and sinks

FIELDS = ("entity_id", "business_name", "business_address", "country")


def tsv(s, d, df: DataFrame, name: str, key: str | None) -> str:
    path = fresh_path(s, name)
    T.write_tsv(df, path, key)
    return path


query("scan_tsv", "select entity_id, business_name, business_address, country from rec")(lambda s, d: T.read_tsv(s, tsv(s, d, records(s, d).select(*FIELDS), "scan_tsv", None)))


@query("scan_bad_lines", "select entity_id, business_name, business_address, country from rec where num % 50 <> 3")
def _(s, d):
    path = fresh_path(s, "bad_lines")
    broken = F.when(number("entity_id") % 50 == 3, F.lit("a\tb")).otherwise(F.concat_ws("\t", *FIELDS))
    records(s, d).select(broken).write.text(path)
    return s.read.schema(T.RECORD).options(sep="\t", mode="DROPMALFORMED").csv(path).na.fill("")


query("scan_country", "select entity_id, business_name from rec where country = 'en'")(lambda s, d: records(s, d).where("country = 'en'").select("entity_id", "business_name"))
query("scan_pruned", "select entity_id, country from rec")(lambda s, d: records(s, d).select("entity_id", "country"))
query("scan_ids", "select entity_id, business_name from rec where entity_id in (select cand_id from truth)")(lambda s, d: T.only_ids(records(s, d).select("entity_id", "business_name"), true_pairs(s, d).select(F.col("cand_id").alias("entity_id"))))


@query("union_sources", "select entity_id, business_name from rec where entity_id not like 'S1-%'")
def _(s, d):
    r = records(s, d)
    return r.where("entity_id like 'S2-%'").unionByName(r.where("entity_id like 'S3-%'")).select("entity_id", "business_name")


@query("bundle_load", "select 'train_source' || substring(entity_id, 2, 1) as name, count(*)::bigint as n from rec group by 1 union all select 'train_ground_truth', count(*)::bigint from q")
def _(s, d):
    """A train set written, discovered among other folders and loaded."""
    at, r = fresh_path(s, "bundle"), records(s, d)
    for i in (1, 2, 3):
        T.write_tsv(r.where(F.col("entity_id").startswith(f"S{i}-")).select(*FIELDS), f"{at}/{T.TRAIN[i - 1]}", None)
    truth = E.match_lists(true_pairs(s, d).withColumn("score", F.lit(1.0)), sides(s, d)[0])
    T.write_tsv(truth, f"{at}/{T.TRAIN[3]}")
    out = None
    for name, df in T.bundle(s, T.discover(s, [at + "-none", at])).items():
        n = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


WIDE = "select q.entity_id as source1_entity_id, coalesce(string_agg(cand_id, ',' order by cand_id), '') as candidate_entity_ids from q left join cand on s1_id = q.entity_id group by q.entity_id"
query("long_to_wide", WIDE)(lambda s, d: C.to_wide(cands(s, d), sides(s, d)[0]))


def result_schema(ids: str):
    return T.T.StructType([T.T.StructField(n, T.T.StringType()) for n in ("source1_entity_id", ids)])


@query("sink_results", WIDE)
def _(s, d):
    """Written as a file in the order of source 1, and read again."""
    q = sides(s, d)[0]
    path = tsv(s, d, T.in_order_of(C.to_wide(cands(s, d), q), q), "results", None)
    return T.read_tsv(s, path, result_schema("candidate_entity_ids"))


@query("sink_candidates", "select s1_id, cand_id, array_to_string(strategies, ',') as strategies, wide.n from cand join (select s1_id, count(*)::int as n from cand group by s1_id) wide using (s1_id)")
def _(s, d):
    """Both files of a candidate set, read again and joined."""
    path = fresh_path(s, "candidates")
    T.write_candidates(C.to_wide(cands(s, d), sides(s, d)[0]), cands(s, d), path)
    wide = T.read_tsv(s, path + "/wide", result_schema("candidate_entity_ids"))
    long = s.read.schema("s1_id string, cand_id string, strategies string").options(sep="\t", header=True).csv(path + "/long")
    return long.join(wide.select(F.col("source1_entity_id").alias("s1_id"), F.size(F.split("candidate_entity_ids", ",")).alias("n")), "s1_id")


@query("append_log", "select country, count(*)::bigint * 2 as n from rec group by country")
def _(s, d):
    """Two runs appended to one log."""
    path = fresh_path(s, "log")
    for _ in range(2):
        T.append_log(records(s, d).select("entity_id", "country"), path)
    return s.read.parquet(path).groupBy("country").agg(F.count(F.lit(1)).alias("n"))


# blockers

BLOCKERS = (
    ("block_exact", B.exact_names, "exact", None),
    ("block_pin_num", B.by_pin_number, "pinnum", None),
    ("block_rare", B.rare_tokens, "rare", None),
    ("block_pin", B.by_pin, "(select distinct q.entity_id as s1_id, tr.entity_id as cand_id from q join tr on q.route = tr.route and q.addr_pin = tr.addr_pin and q.addr_pin <> '' where (tr.route, tr.addr_pin) in (select (route, addr_pin) from tr group by route, addr_pin having count(*) <= 30))", None),
    ("block_pin_tok", B.by_pin_token, "(select distinct q.entity_id as s1_id, tr.entity_id as cand_id from q join tr on q.route = tr.route and q.addr_pin = tr.addr_pin and q.addr_pin <> '' and q.addr_tokens[1] = tr.addr_tokens[1] where (tr.route, tr.addr_pin, tr.addr_tokens[1]) in (select (route, addr_pin, addr_tokens[1]) from tr group by route, addr_pin, addr_tokens[1] having count(*) <= 30))", None),
    ("block_token", B.token_intersection, "(select distinct a.s1_id, b.cand_id from (select entity_id as s1_id, country_norm as c, unnest(list_distinct(name_tokens)) as k from q) a join (select entity_id as cand_id, country_norm as c, unnest(list_distinct(name_tokens)) as k from t) b using (c, k))", None),
    ("block_rare_pct", B.rare_by_percentile, f"({D.RARE_PCT})", None),
    ("block_legacy_ab", B.legacy_ab, f"({D.LEGACY_AB})", None),
    ("block_loc_num", B.by_locality_number, "locnum", D.places()),
    ("block_address", B.by_address, "(select * from pinnum union select * from locnum)", D.places()),
    ("block_soft", B.soft_tokens, "soft", D.SOFT),
    ("block_hybrid", B.hybrid, "hybrid", D.HYBRID),
    ("block_acronym", B.acronyms, "acronyms", D.ACRONYMS),
    ("block_translit", B.translit_names, "translit", D.READINGS),
    ("block_char", B.char_retrieval, "found", D.retrieval(D.char_grams())),
    ("block_recip", lambda q, t: B.char_retrieval(q, t, reverse=1), "found", D.retrieval(D.char_grams(), reverse=1)),
    ("block_word", B.word_retrieval, "found", D.retrieval(D.word_grams(), 15, 0.35, 2, 0.8)),
    ("block_knn", B.legacy_neighbours, "found", D.retrieval(D.char_grams(), 10, 0.5, sublinear=False, routes=False)),
    ("legacy_candidates", B.legacy_candidates, "pruned", D.retrieval(D.char_grams(), 10, 0.5, sublinear=False, routes=False) | {"every": f"{D.LEGACY_AB} union {D.RARE_PCT} union select s1_id, cand_id from found", "pruned": D.legacy_pruned("every", 20, 50)}),
    ("block_xscript_addr", B.cross_script_address, f"(select p.* from (select * from wide_pins union select * from locnum) p join q a on a.entity_id = s1_id join t b on b.entity_id = cand_id where {D.scripts('a.name_clean')} <> {D.scripts('b.name_clean')})", D.places(100) | {"wide_pins": D.TABLES["pinnum"].replace("<= 30", "<= 100")}),
)
for _name, _f, _sql, _more in BLOCKERS:
    query(_name, f"select s1_id, cand_id from {_sql}", _more)(lambda s, d, f=_f: pairs_only(f(*sides(s, d))))

query("retrieval_scores", "select s1_id, cand_id, round(score, 6) as score from found", D.retrieval(D.char_grams()))(lambda s, d: rounded(B.char_retrieval(*sides(s, d)), "score"))
query("blocker_stats", "select (select count(*) from q)::bigint as queries, (select count(*) from t)::bigint as targets, count(distinct s1_id)::bigint as with_candidates, count(*)::bigint as pairs, (select max(n) from (select count(*)::bigint as n from exact group by s1_id)) as largest, count(*) / (select count(*) from q)::double as mean from exact")(lambda s, d: B.stats(B.exact_names(*sides(s, d)), *sides(s, d)))

BEST = {
    "jq": "select entity_id as s1_id, country_norm, unnest(list_distinct(name_tokens)) as k from q",
    "jt": "select entity_id as cand_id, country_norm, unnest(list_distinct(name_tokens)) as k from t where true",
    "ju": "select * from jt where k in (select k from jq)",
    "js": "select s1_id, cand_id, substring(cand_id, 1, 2) as source, n / (nq + nt - n)::double as score from (select s1_id, cand_id, count(*) as n from jq join ju using (country_norm, k) group by all) join (select s1_id, count(*) as nq from jq group by all) using (s1_id) join (select cand_id, count(*) as nt from ju group by all) using (cand_id)",
    "best": "select s1_id, cand_id, source, score from (select *, row_number() over (partition by s1_id, source order by score desc, cand_id) as r from js) where r = 1 and score > 0.85",
}
query("jaccard_best", "select s1_id, cand_id, source, round(score, 6) as score from best", BEST)(lambda s, d: rounded(B.best_by_jaccard(*sides(s, d)), "score"))
query("bucket_diag", "select count(*)::bigint as keys, avg(n) as mean, quantile_cont(n, 0.5)::double as median, quantile_cont(n, 0.95)::double as p95, max(n)::bigint as largest, coalesce(sum((n > 30)::int), 0)::bigint as oversized from (select addr_pin, count(*) as n from t where addr_pin <> '' group by addr_pin)")(lambda s, d: B.bucket_diagnostics(sides(s, d)[1], F.array(B.with_pin()), 30))
query("token_diag", "select count(*)::bigint as tokens, avg(df) as mean, quantile_cont(df, 0.5)::double as median, quantile_cont(df, 0.95)::double as p95, quantile_cont(df, 0.99)::double as p99, max(df)::bigint as largest from df")(lambda s, d: B.token_diagnostics(sides(s, d)[1]))

# relational operators

query("union_candidates", "select s1_id, cand_id, array_to_string(strategies, ',') as strategies from cand")(lambda s, d: cands(s, d).withColumn("strategies", F.array_join("strategies", ",")))
query("wide_to_long", "select s1_id, cand_id from cand")(lambda s, d: C.to_long(C.to_wide(cands(s, d))))
query("parse_idlist", "select s1_id, cand_id from truth")(lambda s, d: C.to_long(C.to_wide(true_pairs(s, d))))
query("explosion_top", "select s1_id, count(*)::bigint as n from cand group by s1_id order by n desc, s1_id limit 50")(lambda s, d: C.counts(cands(s, d)).orderBy(F.desc("n"), "s1_id").limit(50))
query("country_counts", "select country_norm, count(*)::bigint as n from norm group by country_norm")(lambda s, d: normal(s, d).groupBy("country_norm").agg(F.count(F.lit(1)).alias("n")))
query("semi_gt", "select entity_id from t where entity_id in (select cand_id from truth)")(lambda s, d: sides(s, d)[1].join(true_pairs(s, d).select(F.col("cand_id").alias("entity_id")), "entity_id", "left_semi").select("entity_id"))
query("anti_missed", "select s1_id, cand_id from truth except select s1_id, cand_id from cand")(lambda s, d: true_pairs(s, d).join(cands(s, d), ["s1_id", "cand_id"], "left_anti"))
query("gt_country", "select truth.s1_id, cand_id, country from truth join q on q.entity_id = s1_id")(lambda s, d: true_pairs(s, d).join(records(s, d).select(F.col("entity_id").alias("s1_id"), "country"), "s1_id"))
query("label_pairs", "select cand.s1_id, cand.cand_id, (truth.s1_id is not null)::int as label from cand left join truth on truth.s1_id = cand.s1_id and truth.cand_id = cand.cand_id")(lambda s, d: labelled(s, d).drop("strategies"))
query("dedup_ids", "select distinct cand_id from cand")(lambda s, d: cands(s, d).select("cand_id").dropDuplicates())
query("distractors", "select entity_id from t where entity_id not in (select cand_id from truth)")(lambda s, d: Q.distractors(sides(s, d)[1], true_pairs(s, d)).select("entity_id"))
query("distractor_cap", "select entity_id from t where entity_id not in (select cand_id from truth) order by entity_id limit 100")(lambda s, d: Q.distractors(sides(s, d)[1], true_pairs(s, d), 100).select("entity_id"))
query("pair_records", "select s1_id, cand_id, a.name_clean as a_name_clean, b.name_clean as b_name_clean from cand join q a on a.entity_id = s1_id join t b on b.entity_id = cand_id")(lambda s, d: S.pair_records(pairs_only(cands(s, d)), *sides(s, d)).select("s1_id", "cand_id", "a_name_clean", "b_name_clean"))

# decisions

query("scores", "select s1_id, cand_id, score from sc")(lambda s, d: scored(s, d).drop("strategies"))
query("threshold", "select s1_id, cand_id, score from sc where score >= 0.8")(lambda s, d: E.decide_threshold(scored(s, d), 0.8, True).drop("strategies"))
query("decide_threshold", "select s1_id, cand_id, score from sc where score > 0.8")(lambda s, d: E.decide_threshold(scored(s, d), 0.8).drop("strategies"))
query("decide_entries", "select sc.s1_id as source1_entity_id, coalesce(string_agg(cand_id, ',' order by score desc, cand_id) filter (score > 0.8), '') as matched_entity_ids from sc group by sc.s1_id")(lambda s, d: E.decide_entries(scored(s, d), 0.8))
query("decide_band", "select s1_id, cand_id, case when score >= 0.8 then 'accept' when score >= 0.5 then 'review' else 'reject' end as band from sc")(lambda s, d: E.decide_band(scored(s, d), 0.5, 0.8).select("s1_id", "cand_id", "band"))
query("decide_top1", "select s1_id, cand_id, score from (select *, row_number() over (partition by s1_id order by score desc, cand_id) as r from sc) where r = 1 and score >= 0.4")(lambda s, d: E.decide_top1(scored(s, d), 0.4).drop("strategies"))
query("decide_margin", "select s1_id, cand_id, score from (select *, max(score) over (partition by s1_id) as top from sc) where score >= 0.5 and score >= top - 0.05::double")(lambda s, d: E.decide_margin(scored(s, d), 0.5, 0.05).drop("strategies"))
MATCHES = "select q.entity_id as source1_entity_id, coalesce(string_agg(cand_id, ',' order by score desc, cand_id), '') as matched_entity_ids from q left join sc on s1_id = q.entity_id and score {} group by q.entity_id"
query("match_list", MATCHES.format(">= 0.8"))(lambda s, d: E.match_lists(scored(s, d).where("score >= 0.8"), sides(s, d)[0]))
query("prune_aware", "select s1_id, cand_id from (select *, 10 * len(strategies) + 5 * list_contains(strategies, 'exact_name')::int + 5 * list_contains(strategies, 'address')::int + 3 * list_contains(strategies, 'rare_token')::int as b, count(*) over (partition by s1_id) as n from cand) qualify n <= 1 or row_number() over (partition by s1_id order by b desc, cand_id) <= 1")(lambda s, d: pairs_only(C.prune_ranked(cands(s, d), C.blocker_score(F.col("strategies")), 1, 1)))
QUOTA = {
    "pq": f"select s1_id, cand_id, strategies, count(*) over (partition by s1_id) as n, round({D.jaccard('a.inf', 'b.inf')} + 0.2::double * {D.jaccard('a.addr_tokens', 'b.addr_tokens')}, 9) as score from cand join q a on a.entity_id = s1_id join t b on b.entity_id = cand_id",
    "chosen": "select distinct s1_id, cand_id from (select *, row_number() over (partition by s1_id, strategy order by score desc, cand_id) as r from (select *, unnest(strategies) as strategy from pq where n > 1)) where r <= 1",
    "quota": "select s1_id, cand_id from (select pq.*, (chosen.s1_id is not null)::int as sel, row_number() over (partition by pq.s1_id order by (chosen.s1_id is not null)::int desc, score desc, pq.cand_id) as r from pq left join chosen on chosen.s1_id = pq.s1_id and chosen.cand_id = pq.cand_id) where n <= 1 or sel = 1 or r <= 2",
}
query("prune_quota", "select s1_id, cand_id from quota", QUOTA)(lambda s, d: pairs_only(C.prune_quota(cands(s, d), *sides(s, d), 1, 2, 1)))
query("prune_legacy", D.legacy_pruned("cand", 1, 1))(lambda s, d: pairs_only(C.prune_legacy(cands(s, d), *sides(s, d), 1, 1)))
GRIDS = "round(precision, 6) as precision, round(recall, 6) as recall, round(f05, 6) as f05"
query("tune_grid", f"select tau, {GRIDS} from tuned", D.tuned(E.GRID))(lambda s, d: rounded(E.tune(scored(s, d), true_pairs(s, d), sides(s, d)[0]), "precision", "recall", "f05"))
query("tune_threshold", f"select tau, {GRIDS} from tuned order by round(tuned.f05, 9) desc, tau limit 1", D.tuned(E.GRID))(lambda s, d: rounded(E.best_threshold(E.tune(scored(s, d), true_pairs(s, d), sides(s, d)[0])), "precision", "recall", "f05"))
BAND = D.tuned(E.HIGH, ">=") | {
    "edges": "select h.tau as high, l.low from taus h, (values " + ", ".join(f"({x}::double)" for x in E.LOW) + ") l(low) where l.low <= h.tau",
    "held": "select high, low, count(*)::bigint as review from edges join sc on score >= low and score < high group by high, low",
    "bands": "select edges.high, edges.low, precision, recall, f05, coalesce(review, 0)::bigint as review from edges join tuned on tau = edges.high left join held on held.high = edges.high and held.low = edges.low",
}
query("tune_band", f"select high, low, {GRIDS}, review from bands", BAND)(lambda s, d: rounded(E.tune_band(scored(s, d), true_pairs(s, d), sides(s, d)[0]), "precision", "recall", "f05"))
query("best_band", f"select high, low, {GRIDS}, review from bands order by round(bands.f05, 9) desc, high, low limit 1", BAND)(lambda s, d: rounded(E.best_band(E.tune_band(scored(s, d), true_pairs(s, d), sides(s, d)[0])), "precision", "recall", "f05"))

# evaluation

query("eval_mean_f05", f"select round(avg(case when p + r = 0 then 0 else 1.25 * p * r / (0.25 * p + r) end), 6) as mean_f05 from (select {D.PR} from per)")(lambda s, d: E.match_metrics(true_pairs(s, d), scored(s, d), sides(s, d)[0]).select(F.round("mean_f05", 6).alias("mean_f05")))
query("eval_matches", f"select round(avg(p), 6) as precision, round(avg(r), 6) as recall, sum(n_hit)::bigint as tp, sum(n_pred - n_hit)::bigint as fp, sum(n_true - n_hit)::bigint as fn, round(coalesce(avg(case when n_true = 0 then (n_pred = 0)::int end), 1), 6) as singleton_accuracy, round(coalesce(avg(case when n_true > 0 then r end), 1), 6) as matched_recall, round(1.25 * avg(p) * avg(r) / (0.25 * avg(p) + avg(r)), 6) as f05_of_means from (select *, {D.PR} from per)")(
    lambda s, d: rounded(E.match_metrics(true_pairs(s, d), scored(s, d), sides(s, d)[0]).drop("mean_f05"), "precision", "recall", "singleton_accuracy", "matched_recall", "f05_of_means")
)
PERCENTILES = ", ".join(f"quantile_cont(n_pred, {p})::double as {n}" for p, n in ((0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999")))


@query("eval_blocking", f"select count(*)::bigint as entities, sum(n_pred)::bigint as candidates, sum(n_true)::bigint as true_pairs, round(sum(n_hit) / sum(n_true)::double, 6) as pair_recall, round(sum((n_true > 0 and n_hit = n_true)::int) / sum((n_true > 0)::int)::double, 6) as entity_recovery, sum((n_true = 0)::int)::bigint as singletons, sum((n_pred = 0)::int)::bigint as without_candidates, avg(n_pred) as mean, {PERCENTILES}, max(n_pred)::bigint as largest, round(1 - sum(n_pred) / (count(*) * (select count(*) from t))::double, 6) as reduction_ratio from per")
def _(s, d):
    q, t = sides(s, d)
    return rounded(E.blocking_metrics(true_pairs(s, d), cands(s, d), q, t.count()), "pair_recall", "entity_recovery", "reduction_ratio", "p999")


query("cand_recall", "select round(sum(n_hit) / sum(n_true)::double, 6) as recall from per")(lambda s, d: E.blocking_metrics(true_pairs(s, d), cands(s, d), sides(s, d)[0], 1).select(F.round("pair_recall", 6).alias("recall")))
query("eval_legacy", "select round(sum((n_true > 0 and n_hit = n_true)::int) / sum((n_true > 0)::int)::double, 6) as recall, round(avg(n_pred), 6) as mean, quantile_cont(n_pred, 0.5)::double as median, quantile_cont(n_pred, 0.95)::double as p95, max(n_pred)::bigint as largest, round(1 - avg(n_pred) / 1000, 6) as reduction from per")(lambda s, d: rounded(E.legacy_metrics(true_pairs(s, d), cands(s, d), sides(s, d)[0], 1000), "recall", "mean", "reduction"))
query("eval_split", "select n_true = 0 as singleton, count(*)::bigint as entities, round(avg((n_pred > 0)::int), 6) as with_candidates, round(coalesce(sum(n_hit) / nullif(sum(n_true), 0)::double, 1), 6) as pair_recall from per group by 1")(lambda s, d: rounded(E.split_metrics(true_pairs(s, d), cands(s, d), sides(s, d)[0]), "with_candidates", "pair_recall"))
query("f05_ceiling", "select entity_id, round(1.25 * len(inf) / 10.0::double / (0.25 + len(inf) / 10.0::double), 6) as v from norm where len(inf) > 0")(lambda s, d: normal(s, d).where(F.size("name_informative_tokens") > 0).select("entity_id", F.round(E.f05_ceiling(F.size("name_informative_tokens") / 10.0), 6).alias("v")))
query("error_decomp", "select kind, count(*)::bigint as pairs, count(distinct s1_id)::bigint as entities from (select s1_id, 'blocking_miss' as kind from (select s1_id, cand_id from truth except select s1_id, cand_id from cand) union all select s1_id, 'classifier_fn' from (select s1_id, cand_id from truth intersect select s1_id, cand_id from sc where score <= 0.8) union all select s1_id, 'fp' from (select s1_id, cand_id from sc where score > 0.8 except select s1_id, cand_id from truth)) group by kind")(lambda s, d: E.error_decomposition(true_pairs(s, d), cands(s, d), E.decide_threshold(scored(s, d), 0.8)))
_WORDS = lambda x: f"list_filter(string_split_regex(lower(trim({x}.business_name)), '\\s+'), lambda w: w <> '')"
_NUMBERS = lambda x: f"regexp_extract_all({x}.business_name || ' ' || {x}.business_address, '[0-9]+')"
FAILURE = f"""case when trim(a.country) <> '' and trim(b.country) <> '' and upper(trim(a.country)) <> upper(trim(b.country)) then 'country_mismatch'
  when len({D.scripts('a.business_name')}) > 0 and len({D.scripts('b.business_name')}) > 0 and {D.scripts('a.business_name')} <> {D.scripts('b.business_name')} then 'cross_script'
  when lower(trim(b.business_address)) in ('', 'nan', 'none') then 'missing_address'
  when (length(trim(a.business_name)) <= 4 or length(trim(b.business_name)) <= 4) and lower(trim(a.business_name)) <> lower(trim(b.business_name)) then 'abbreviation_acronym'
  when list_sort(list_distinct({_WORDS('a')})) = list_sort(list_distinct({_WORDS('b')})) and {_WORDS('a')} <> {_WORDS('b')} then 'reordered_tokens'
  when len({_NUMBERS('a')}) > 0 and len({_NUMBERS('b')}) > 0 and len(list_intersect({_NUMBERS('a')}, {_NUMBERS('b')})) = 0 then 'numeric_mismatch' else 'severe_lexical_mutation' end"""
query("failure_class", f"select {FAILURE} as reason, count(*)::bigint as count from (select * from truth union all select s1_id, cand_id from cand) join q a on a.entity_id = s1_id join t b on b.entity_id = cand_id group by 1")(lambda s, d: S.pair_records(true_pairs(s, d).unionByName(pairs_only(cands(s, d))), *sides(s, d)).groupBy(E.failure_class().alias("reason")).count())
query("xscript_recall", f"select count(*)::bigint as pairs, count(cand.s1_id)::bigint as found, round(coalesce(count(cand.s1_id) / nullif(count(*), 0)::double, 1), 6) as recall from truth join q a on a.entity_id = truth.s1_id join t b on b.entity_id = truth.cand_id left join cand on cand.s1_id = truth.s1_id and cand.cand_id = truth.cand_id where {D.scripts('a.name_clean')} <> {D.scripts('b.name_clean')}")(lambda s, d: rounded(E.cross_script_recall(true_pairs(s, d), cands(s, d), *sides(s, d)), "recall"))
query("ablation_loo", "select x.s as strategy, sum((len(list_filter(strategies, lambda y: y <> x.s)) > 0)::int)::bigint as pairs_without, count(truth.s1_id)::bigint as true_all, sum((len(list_filter(strategies, lambda y: y <> x.s)) > 0 and truth.s1_id is not null)::int)::bigint as true_without from cand cross join (select distinct unnest(strategies) as s from cand) x left join truth on truth.s1_id = cand.s1_id and truth.cand_id = cand.cand_id group by x.s")(lambda s, d: C.ablation(cands(s, d), true_pairs(s, d)))
query("overlap_matrix", "select x.s as a, y.s as b, count(*)::bigint as both, count(truth.s1_id)::bigint as true_both from (select s1_id, cand_id, unnest(strategies) as s from cand) x join (select s1_id, cand_id, unnest(strategies) as s from cand) y using (s1_id, cand_id) left join truth using (s1_id, cand_id) group by x.s, y.s")(lambda s, d: C.overlap_matrix(cands(s, d), true_pairs(s, d)))
query("shard_stats", "select q.country_norm, count(*)::bigint as entities, sum(n_pred)::bigint as candidates, max(n_pred)::bigint as largest from q join per on s1_id = q.entity_id group by q.country_norm")(
    lambda s, d: sides(s, d)[0].select(F.col("entity_id").alias("s1_id"), "country_norm").join(E.per_entity(true_pairs(s, d), cands(s, d), sides(s, d)[0]), "s1_id").groupBy("country_norm").agg(F.count(F.lit(1)).alias("entities"), F.sum("n_pred").alias("candidates"), F.max("n_pred").alias("largest"))
)

# profiles, samples and splits

query("profile_lengths", " union all ".join(f"select '{f}' as field, count(*)::bigint as n_rows, sum((trim({f}) = '')::int)::bigint as n_empty, min(case when trim({f}) <> '' then length({f}) end)::int as chars_min, quantile_cont(case when trim({f}) <> '' then length({f}) end, 0.95)::double as chars_p95, max(case when trim({f}) <> '' then length({f}) end)::int as chars_max from rec" for f in Q.FIELDS))(lambda s, d: Q.lengths(records(s, d)).select("field", "n_rows", "n_empty", "chars_min", "chars_p95", "chars_max"))
query("profile_country", "select country, count(*)::bigint as n, round(count(*) / sum(count(*)) over ()::double, 6) as share from rec group by country")(lambda s, d: rounded(Q.shares(records(s, d), "country"), "share"))
AUDIT = "count(*)::bigint as n_rows, sum((num % 40 = 1)::int)::bigint as bad_prefix, sum((trim(country) = '')::int)::bigint as blank_country, sum((business_name <> trim(business_name) or num % 40 = 2)::int)::bigint as padded_name, sum((trim(business_address) = '')::int)::bigint as blank_address"


def damaged(s, d) -> DataFrame:
    """Records with planted faults: some ids without a source, some names with a space after them."""
    n = number("entity_id") % 40
    return records(s, d).withColumn("business_name", F.when(n == 2, F.concat("business_name", F.lit(" "))).otherwise(F.col("business_name"))).withColumn("entity_id", F.when(n == 1, F.concat(F.lit("x"), "entity_id")).otherwise(F.col("entity_id")))


query("audit_prefix", f"select {AUDIT} from rec")(lambda s, d: Q.record_audit(damaged(s, d)))
query("profile_missing", "select count(*)::bigint as n_rows, sum((trim(country) = '')::int)::bigint as blank_country, sum((trim(business_address) = '')::int)::bigint as blank_address from rec")(lambda s, d: Q.record_audit(records(s, d)).select("n_rows", "blank_country", "blank_address"))
query("gt_histogram", "select case when n >= 6 then '6+' else n::varchar end as matches, count(*)::bigint as n from (select count(cand_id) as n from q left join truth on s1_id = entity_id group by entity_id) group by 1")(lambda s, d: Q.match_histogram(E.match_lists(true_pairs(s, d).withColumn("score", F.lit(1.0)), sides(s, d)[0])))
query("gt_coverage", "select substring(entity_id, 1, 2) as source, count(*)::bigint as n, count(case when entity_id in (select cand_id from truth) then 1 end)::bigint as matched from t group by 1")(lambda s, d: Q.target_coverage(true_pairs(s, d), sides(s, d)[1]).drop("distractors"))
query("match_coverage", "select substring(cand_id, 1, 2) as source, count(*)::bigint as n from truth group by 1")(lambda s, d: true_pairs(s, d).groupBy(F.substring("cand_id", 1, 2).alias("source")).agg(F.count(F.lit(1)).alias("n")))
query("noise_labels", "select case when a.name_clean = b.name_clean then 'exact' when a.name_core = b.name_core then 'legal_suffix' else 'typo' end || '/' || case when a.addr_is_missing or b.addr_is_missing then 'missing' when a.addr_clean = b.addr_clean then 'exact' else 'formatting' end as label, count(*)::bigint as n from truth join q a on a.entity_id = s1_id join t b on b.entity_id = cand_id group by 1")(lambda s, d: S.pair_records(true_pairs(s, d), *sides(s, d)).groupBy(Q.noise_label().alias("label")).agg(F.count(F.lit(1)).alias("n")))
HASH = "('0x' || substring(md5(entity_id || ':42'), 1, 8))::bigint"
PART = f"case when {HASH} / 4294967296.0::double < 0.8 then 'train' else 'valid' end"
query("split_3way", f"select entity_id, case when {HASH} / 4294967296.0::double < 0.75 then 'train' when {HASH} / 4294967296.0::double < 0.9 then 'valid' else 'test' end as part from q")(lambda s, d: Q.split(sides(s, d)[0], {"train": 0.75, "valid": 0.15, "test": 0.1}))
query("split_2way", f"select entity_id, {PART} as part from q")(lambda s, d: Q.split(sides(s, d)[0], {"train": 0.8, "valid": 0.2}))
query("kfold_assign", f"select entity_id, ({HASH} % 5)::int as fold from q")(lambda s, d: Q.folds(sides(s, d)[0]))
query("strat_sample", f"select entity_id from (select entity_id, row_number() over (partition by country_norm order by {HASH}, entity_id) as r, count(*) over (partition by country_norm) as n from q) where r <= ceil(n * 0.2::double)")(lambda s, d: Q.stratified_sample(sides(s, d)[0], ["country_norm"], 0.2).select("entity_id"))
query("sample_entities", f"select entity_id from q order by {HASH}, entity_id limit (select greatest(1, floor(count(*) * 0.1::double))::bigint from q)")(lambda s, d: Q.sample_entities(sides(s, d)[0], 0.1))

# checks, on results with planted faults


@query("leakage", f"select entity_id from q where {PART} = 'valid' and num % 10 = 0")
def _(s, d):
    p = Q.split(sides(s, d)[0], {"train": 0.8, "valid": 0.2})
    valid = p.where("part = 'valid'")
    return Q.leaked(p.where("part = 'train'").unionByName(valid.where(number("entity_id") % 10 == 0)), valid)


def planted(s, d) -> DataFrame:
    """Match lists with faults of every kind."""
    r, n, ids = E.match_lists(scored(s, d).where("score > 0.8"), sides(s, d)[0]), number("source1_entity_id") % 40, F.col("matched_entity_ids")
    more = F.when(n == 1, ",X9-1").when(n == 2, F.concat(F.lit(","), "source1_entity_id")).when(n == 3, ",S2-999999999").when(n == 4, ",S2-1,S2-1").otherwise("")
    r = r.where(n != 6).select(F.when(n == 7, F.concat(F.col("source1_entity_id"), F.lit("9999999"))).otherwise(F.col("source1_entity_id")).alias("source1_entity_id"), F.concat(ids, more).alias("matched_entity_ids"))
    return r.unionByName(r.where(number("source1_entity_id") % 40 == 5))


PLANTED = {
    "pl0": MATCHES.format("> 0.8"),
    "pl1": f"select *, {NUM.format('source1_entity_id')} % 40 as n from pl0",
    "pl2": "select case when n = 7 then source1_entity_id || '9999999' else source1_entity_id end as entity_id, matched_entity_ids || case n when 1 then ',X9-1' when 2 then ',' || source1_entity_id when 3 then ',S2-999999999' when 4 then ',S2-1,S2-1' else '' end as ids, n from pl1 where n <> 6",
    "pl3": f"select entity_id, ids from pl2 union all select entity_id, ids from pl2 where {NUM.format('entity_id')} % 40 = 5",
    "pl": "select entity_id, list_filter(string_split(ids, ','), lambda x: x <> '') as x from pl3",
    "pll": "select entity_id, unnest(x) as y from pl",
    "findings": """select 'duplicate_row' as finding, entity_id from pl group by entity_id having count(*) > 1
    union all select 'duplicate_in_list', entity_id from pl where len(x) <> len(list_distinct(x))
    union all select 'self_match', entity_id from pll where y like 'S1-%'
    union all select 'bad_prefix', entity_id from pll where not regexp_matches(y, '^S[123]-')
    union all select 'unknown_id', entity_id from pll where regexp_matches(y, '^S[23]-') and y not in (select entity_id from t)
    union all select 'missing_entity', entity_id from q where entity_id not in (select entity_id from pl)
    union all select 'extra_entity', entity_id from pl where entity_id not in (select entity_id from q)""",
}
query("validate", "select finding, entity_id from findings", PLANTED)(lambda s, d: Q.validate(planted(s, d), *sides(s, d)))


@query("validate_lines", "select 'no_tab' as finding, entity_id as line from q where num % 30 = 3 union all select 'comma_separated', 'source1_entity_id,matched_entity_ids'")
def _(s, d):
    """Raw lines with a header of commas and rows without a tab."""
    rows = sides(s, d)[0].select((number("entity_id") + 1).alias("place"), F.when(number("entity_id") % 30 == 3, F.col("entity_id")).otherwise(F.concat("entity_id", F.lit("\t"))).alias("value"))
    return Q.file_findings(rows.unionByName(s.createDataFrame([(0, "source1_entity_id,matched_entity_ids")], "place long, value string")))


query("containment", "select s1_id, cand_id from (select * from truth union select s1_id, cand_id from sc where score > 0.8) except select s1_id, cand_id from cand")(lambda s, d: Q.not_contained(true_pairs(s, d).unionByName(pairs_only(scored(s, d).where("score > 0.8"))).distinct(), cands(s, d)))
query("subset_warning", "select s1_id as entity_id, count(*)::bigint as missing from (select * from truth except select s1_id, cand_id from cand) group by 1")(lambda s, d: Q.subset_warning(true_pairs(s, d).distinct(), cands(s, d)))


@query("coverage", "select entity_id, 'missing' as side from q where num % 10 = 1 union all select entity_id || 'x', 'extra' from q where num % 10 = 2")
def _(s, d):
    ids = C.to_wide(cands(s, d), sides(s, d)[0]).select(F.col("source1_entity_id").alias("entity_id"))
    n = number("entity_id") % 10
    return Q.uncovered(ids.where(n != 1).unionByName(ids.where(n == 2).select(F.concat("entity_id", F.lit("x")).alias("entity_id"))), sides(s, d)[0])


@query("audit_best1", "select 'score' as finding, s1_id, cand_id from best where split_part(cand_id, '-', 2)::bigint % 4 = 0 union all select 'second', s1_id, min(cand_id) from best where split_part(cand_id, '-', 2)::bigint % 4 = 1 group by s1_id, source", BEST)
def _(s, d):
    """Best matches with planted faults, recomputed: wrong scores, and two of one source."""
    best, n = B.best_by_jaccard(*sides(s, d)), number("cand_id") % 4
    claimed = best.withColumn("score", F.when(n == 0, F.col("score") - 0.125).otherwise(F.col("score")))
    return Q.recheck_best(claimed.unionByName(claimed.where(n == 1)), best)


query("upsert_last", "select source, doc_id, n_chars from (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id desc) as r from documents) where r = 1")(lambda s, d: Q.upsert_last(s.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", "n_chars"), "source", "doc_id"))

# features and models

IN_SQL = [f for f in S.FEATURES if f not in ("name_token_sort_ratio", "name_token_set_ratio", "name_wratio", "addr_token_sort_ratio")]
query("features", "select s1_id, cand_id, " + ", ".join(f"round({f}, 6) as {f}" for f in IN_SQL) + " from feat", D.FEATURES)(lambda s, d: rounded(featured(s, d).select("s1_id", "cand_id", *IN_SQL), *IN_SQL))
query("features_full")(lambda s, d: featured(s, d))
query("feature_audit", " union all ".join(f"select '{f}' as feature, sum(({f} is null)::int)::bigint as nulls, 0::bigint as not_finite, round(min({f}), 6) as lowest, round(avg({f}), 6) as mean, round(max({f}), 6) as highest, round(stddev_pop({f}), 6) as deviation, min({f}) = max({f}) as constant from feat" for f in S.NATIVE_FEATURES), D.FEATURES)(
    lambda s, d: rounded(Q.feature_audit(featured(s, d), S.NATIVE_FEATURES), "lowest", "mean", "highest", "deviation")
)
HARD = "select s1_id, cand_id from (select feat.s1_id, feat.cand_id, row_number() over (partition by feat.s1_id order by name_lev desc, feat.cand_id) as r from feat left join (select distinct s1_id, cand_id from truth) truth on truth.s1_id = feat.s1_id and truth.cand_id = feat.cand_id where truth.s1_id is null and name_lev >= 0.3) where r <= 5"
query("hard_negatives", HARD, D.FEATURES)(lambda s, d: L.hard_negatives(featured(s, d)).select("s1_id", "cand_id"))
#: The boosted model that queries train is smaller than the operator's default, see the README.
SMALL = {"gbt": {"maxIter": 30, "maxDepth": 5, "stepSize": 0.1}}
for _kind in ("lr", "rf", "gbt"):
    query(f"train_{_kind}")(lambda s, d, k=_kind: L.score(L.train(featured(s, d), k, **SMALL.get(k, {})), featured(s, d)))
query("score_pairs")(lambda s, d: L.score(L.train(featured(s, d), "lr", balanced=True), featured(s, d)))
query("feature_importance")(lambda s, d: L.importance(L.train(featured(s, d), "rf")))


@query("model_store")
def _(s, d):
    """Scores of a model that was saved and loaded."""
    path = fresh_path(s, "model")
    L.save(L.train(featured(s, d), "lr"), path)
    return L.score(L.load(path), featured(s, d))


query("out_of_fold")(lambda s, d: L.out_of_fold(featured(s, d), Q.folds(sides(s, d)[0])))
MINED = ", ".join(f"(select coalesce(sum(case when label = 0 and score >= {r[1]}{' and m is null' if r[0] else ''} then {r[2] or 2} else 1 end), 0)::double from mined) as {k}" for k, r in L.MINING.items() if r)


@query(
    "hnm_weights",
    f"select {MINED}, (select count(*) from mined)::double as none",
    {"mined": "select sc.*, (truth.s1_id is not null)::int as label, m.s1_id as m from sc left join (select distinct s1_id, cand_id from truth) truth on truth.s1_id = sc.s1_id and truth.cand_id = sc.cand_id left join (select distinct truth.s1_id from truth join cand on cand.s1_id = truth.s1_id and cand.cand_id = truth.cand_id) m on m.s1_id = sc.s1_id"},
)
def _(s, d):
    """The total weight of the training rows by each strategy of hard-negative mining."""
    f, scores = featured(s, d).select("s1_id", "cand_id", "label"), scored(s, d)
    out = None
    for k in L.MINING:
        n = L.mined(f, scores, k).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias(k))
        out = n if out is None else out.crossJoin(n)
    return out


@query("compare_models")
def _(s, d):
    parts, f = Q.split(sides(s, d)[0], {"train": 0.7, "valid": 0.3}).withColumnRenamed("entity_id", "s1_id"), featured(s, d)
    train, valid = (f.join(parts.where(F.col("part") == p).select("s1_id"), "s1_id", "left_semi") for p in ("train", "valid"))
    ids = parts.where("part = 'valid'").select(F.col("s1_id").alias("entity_id"))
    truth = true_pairs(s, d).join(ids.withColumnRenamed("entity_id", "s1_id"), "s1_id", "left_semi")
    return L.compare(train, valid, truth, ids, settings=SMALL)


def flagship(s, d) -> DataFrame:
    """Normalise, block, union, score, decide: one row per source-1 record with its matches."""
    return E.match_lists(scored(s, d).where("score > 0.5"), sides(s, d)[0])


query("flagship", MATCHES.format("> 0.5"))(flagship)
