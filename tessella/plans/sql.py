"""What DuckDB runs beside the linkage queries: the same records, normal forms,
candidates and scores, as common table expressions over the driver's views."""

from __future__ import annotations

from ..functions import text as X
from ..sources import tables as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def folded(c: str, forms) -> str:
    for p, r in forms:
        c = f"regexp_replace({c}, {lit(p)}, {lit(r)}, 'g')"
    return c


def squeezed(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def guarded(c: str) -> str:
    r"""c with a Z on either side of every letter beyond ASCII: DuckDB's \b knows only ASCII letters, and folded text has no Z."""
    return rf"regexp_replace({c}, '([^\x00-\x7F])', 'Z\1Z', 'g')"


def unguarded(c: str) -> str:
    return f"replace({c}, 'Z', '')"


WORDLESS = r"'[^\p{L}\p{N}_\s]'"
GENERIC = ", ".join(lit(w) for w in X.GENERIC_WORDS)
LETTERS = T.ACCENTED + "ßœæø" + T.DEVANAGARI + T.TAMIL
#: Signs of ASCII that folded text does not have, one for each of LETTERS: DuckDB's distances count bytes.
SIGNS = "".join(c for c in map(chr, range(1, 128)) if not (c.islower() or c.isdigit() or c in " _'\t\n\x0b\x0c\r"))[: len(LETTERS)]


def bytewise(c: str) -> str:
    return f"translate({c}, {lit(LETTERS)}, {lit(SIGNS)})"


def reading(c: str) -> str:
    """Latin letters for c, letter by letter."""
    c = f"lower({c})"
    for x in LETTERS:
        c = f"replace({c}, {lit(x)}, {lit(X.romanised(x).lower())})"
    return f"trim({c})"


def core() -> str:
    c = folded("g", [(p, " ") for p, _ in X.LEGAL_FORMS])
    for e in X.EXPANDED_FORMS:
        c = f"replace({c}, {lit(e)}, ' ')"
    return unguarded(squeezed(c))


def w(i: int) -> str:
    return f"coalesce(w[{i + 1}], '')"


def scripts(c: str) -> str:
    return f"list_filter([case when regexp_matches({c}, '\\p{{Devanagari}}') then 'Devanagari' end, case when regexp_matches({c}, '\\p{{Latin}}') then 'Latin' end, case when regexp_matches({c}, '\\p{{Tamil}}') then 'Tamil' end], lambda x: x is not null)"


CLEAN = squeezed(f"regexp_replace({folded(chr(39).join(['replace(lower(trim(nfc_normalize(business_name))), ', '&', ', ', ' and ', ')']), [(p, '') for p in X.WEB_PARTS])}, {WORDLESS}, ' ', 'g')")
LOCALITY = r"coalesce(list_filter(addr_tokens, lambda x: length(x) >= 3 and not regexp_matches(x, '^\d+$'))[-1], '')"
INITIALS = f"list_filter(name_tokens, lambda x: x not in ({GENERIC}) and regexp_matches(x, '^[\\p{{L}}\\p{{N}}]'))"
ACRONYM = f"case when len({INITIALS}) between 3 and 6 then array_to_string(list_transform({INITIALS}, lambda x: substring(x, 1, 1)), '') end"
PLAIN_NAME = f"translate(lower(name), {lit(T.ACCENTED)}, {lit(T.PLAIN)})"

TABLES = {
    "doc": r"""select doc_id, coalesce(lang, '') as lang, coalesce(n_chars, 0) as n, 1 + doc_id % 3 as source,
    list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]+')), lambda x: {'n': -length(x), 'x': x}))[1:6], lambda s: s.x) as w,
    (list_sort(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {'n': -length(x), 'x': x}))[1]).x as best from documents where doc_id is not null""",
    "named": f"""select *, case when source = 2 and n % 17 = 0 then substring({w(0)}, 1, 1) || substring({w(1)}, 1, 1) || substring({w(2)}, 1, 1) || substring({w(3)}, 1, 1)
    else case when source = 3 and n % 13 = 0 then replace({w(0)}, 'e', 'i') else {w(0)} end || ' ' || {w(1)} || ' ' || {w(2)} || ' ' || {w(3)} || ' ' || ({list(T.SUFFIXES)})[doc_id % 5 + 1] end as name from doc""",
    "rec": f"""select 'S' || source || '-' || doc_id as entity_id, doc_id as num,
    case when n % 7 = 0 then translate({PLAIN_NAME}, {lit(T.LATIN)}, {lit(T.DEVANAGARI)}) when source = 3 and n % 7 = 1 then translate({PLAIN_NAME}, {lit(T.LATIN)}, {lit(T.TAMIL)}) else name end as business_name,
    case when doc_id % 31 = 0 then '' else (n % 900) || ' ' || {w(4)} || ' St, ' || {w(5)} || case when n % 11 = 0 or source = 2 and n % 11 = 1 then '' else ' ' || (10000 + n % 500) end end as business_address,
    case when doc_id % 97 = 0 then '' else lang end as country, case when best <> '' then md5(lower(best)) end as mark from named""",
    "n1": f"""select *, {CLEAN} as name_clean, lower(trim(business_address)) in ('', 'nan', 'null', 'none') as addr_is_missing,
    case when lower(trim(business_address)) in ('', 'nan', 'null', 'none') then '' else lower(trim(nfc_normalize(business_address))) end as f, upper(trim(country)) as country_norm from rec""",
    "n2": f"select *, {guarded('name_clean')} as g, {guarded('f')} as gf, {guarded(squeezed(f'regexp_replace(f, {WORDLESS}, {lit(" ")}, {lit("g")})'))} as ga, string_split(name_clean, ' ') as t0 from n1",
    "n3": f"""select *, {core()} as core0, {unguarded(squeezed(folded('g', X.LEGAL_FORMS)))} as name_suffix_norm, {unguarded(squeezed(folded('ga', X.ADDRESS_FORMS)))} as addr_clean,
    """ + r"""coalesce(regexp_extract(gf, '\b\d{5,6}\b'), '') as addr_pin, regexp_extract_all(gf, '\b\d+\b') as addr_numbers,
    regexp_replace(regexp_extract(regexp_replace(gf, '\b(flat no|house no|no)\s*[\.\-]?\s*', '', 'g'), '\b\d+[a-z0-9/\-]*'), '^[-/]+|[-/]+$', '', 'g') as addr_primary_num from n2""",
    "n4": f"""select *, case when core0 = '' then name_clean else core0 end as name_core, list_filter(t0, lambda x: x <> '') as name_tokens,
    list_filter(t0, lambda x: length(x) >= 2 and x not in ({GENERIC})) as inf, list_filter(string_split(addr_clean, ' '), lambda x: x <> '') as addr_tokens from n3""",
    "norm": f"select *, array_to_string(list_sort(case when len(inf) > 0 then inf else name_tokens end), ' ') as name_sorted, {LOCALITY} as loc, {ACRONYM} as acr from n4",
    "q0": "select * from norm where entity_id like 'S1-%'",
    "t": "select * from norm where entity_id not like 'S1-%'",
    "q": "select q0.*, case when country_norm <> '' and country_norm in (select country_norm from t) then country_norm else '*' end as route from q0",
    "truth": "select q.entity_id as s1_id, t.entity_id as cand_id from q join t using (mark)",
    "tr": "select country_norm as route, * exclude (mark) from t union all select '*' as route, * exclude (mark) from t",
    "exact": """select distinct q.entity_id as s1_id, tr.entity_id as cand_id from q join tr on q.route = tr.route and q.name_clean = tr.name_clean and q.name_clean <> ''
    union select q.entity_id, tr.entity_id from q join tr on q.route = tr.route and q.name_core = tr.name_core and q.name_core <> ''
    union select q.entity_id, tr.entity_id from q join tr on q.route = tr.route and q.name_sorted = tr.name_sorted and q.name_sorted <> ''""",
    "pn": "select route, addr_pin || '_' || addr_primary_num as k, entity_id from tr where addr_pin <> '' and addr_primary_num <> ''",
    "pinnum": """select distinct q.entity_id as s1_id, pn.entity_id as cand_id from q join pn on q.route = pn.route and q.addr_pin <> '' and q.addr_primary_num <> '' and q.addr_pin || '_' || q.addr_primary_num = pn.k
    where (pn.route, pn.k) in (select (route, k) from pn group by route, k having count(*) <= 30)""",
    "tt": "select entity_id, country_norm, unnest(list_distinct(list_filter(inf, lambda x: length(x) >= 3))) as token from t",
    "df": "select token, count(*) as df from tt group by token",
    "tk": "select * from (select entity_id, country_norm, token, df, row_number() over (partition by entity_id order by df, token) as r from tt join df using (token)) where r <= 2 and df <= 200",
    "tp": "select country_norm as route, token, entity_id from tk union all select '*', token, entity_id from tk",
    "qt": "select entity_id, route, unnest(list_distinct(list_filter(inf, lambda x: length(x) >= 3))) as token from q",
    "qk": "select * from (select entity_id, route, token, df, row_number() over (partition by entity_id order by df, token) as r from qt join df using (token)) where r <= 2 and df <= 200",
    "rare": "select distinct qk.entity_id as s1_id, tp.entity_id as cand_id from qk join tp using (route, token) where (route, token) in (select (route, token) from tp group by route, token having count(*) <= 30)",
    "cand": "select s1_id, cand_id, list_sort(list(s)) as strategies from (select *, 'exact_name' as s from exact union all select *, 'address' from pinnum union all select *, 'rare_token' from rare) group by s1_id, cand_id",
    "sc": """select s1_id, cand_id, strategies, round(len(list_intersect(a.name_tokens, b.name_tokens)) / len(list_distinct(list_concat(a.name_tokens, b.name_tokens)))::double, 6) as score
    from cand join q a on a.entity_id = s1_id join t b on b.entity_id = cand_id""",
    "per": """select q.entity_id as s1_id, coalesce(n_true, 0) as n_true, coalesce(n_pred, 0) as n_pred, coalesce(n_hit, 0) as n_hit from q left join (
    select coalesce(truth.s1_id, sc.s1_id) as s1_id, count(truth.s1_id) as n_true, count(sc.s1_id) as n_pred, count(case when truth.s1_id is not null and sc.s1_id is not null then 1 end) as n_hit
    from truth full join sc on truth.s1_id = sc.s1_id and truth.cand_id = sc.cand_id group by 1) x on x.s1_id = q.entity_id""",
}


def with_tables(more: dict[str, str] | None = None) -> str:
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in (TABLES | (more or {})).items()) + "\n"


#: Locality and number where a postal code is missing.
PLACES = {
    "lt": "select route, case when addr_pin <> '' then 'some_' else 'none_' end || loc || '_' || addr_primary_num as k, entity_id from tr where loc <> '' and addr_primary_num <> ''",
    "lq": """select entity_id, route, 'none_' || loc || '_' || addr_primary_num as k from q where loc <> '' and addr_primary_num <> ''
    union all select entity_id, route, 'some_' || loc || '_' || addr_primary_num from q where loc <> '' and addr_primary_num <> '' and addr_pin = ''""",
    "locnum": "select distinct lq.entity_id as s1_id, lt.entity_id as cand_id from lq join lt using (route, k) where (route, k) in (select (route, k) from lt group by route, k having count(distinct entity_id) <= @CAP@)",
}


def places(cap: int = 30) -> dict[str, str]:
    return {k: v.replace("@CAP@", str(cap)) for k, v in PLACES.items()}


def keyed(queries: str, targets: str, cap: int) -> str:
    """Pairs that share a key; queries has entity_id, route, k, targets entity_id, country_norm, k, both distinct."""
    return f"""with kp as (select country_norm as route, k, entity_id from ({targets}) union all select '*', k, entity_id from ({targets})),
    few as (select route, k from kp group by route, k having count(*) <= {cap})
    select distinct kq.entity_id as s1_id, kp.entity_id as cand_id from ({queries}) kq join kp using (route, k) join few using (route, k)"""


SOFT = {
    "st": r"select entity_id, country_norm, unnest(list_distinct(list_filter(inf, lambda x: length(x) >= 5 and regexp_matches(x, '^\p{L}+$')))) as token from t",
    "sq": r"select entity_id, route, unnest(list_distinct(list_filter(inf, lambda x: length(x) >= 5 and regexp_matches(x, '^\p{L}+$')))) as token from q",
    "near": f"""select a.token as qt, b.token as k from (select distinct token, left(token, 3) as p from sq) a join (select token, left(token, 3) as p from st group by token having count(*) <= 100) b using (p)
    where a.token <> b.token and abs(length(a.token) - length(b.token)) <= 3 and jaro_winkler_similarity({bytewise('a.token')}, {bytewise('b.token')}) >= 0.9""",
    "soft": keyed("select distinct entity_id, route, near.k from sq join near on qt = token", "select entity_id, country_norm, token as k from st", 30),
}


def rare_in_order(side: str) -> str:
    return f"""select entity_id, token from (select *, row_number() over (partition by entity_id order by pos) as r from (
    select entity_id, token, min(pos) as pos from (select entity_id, unnest(inf) as token, generate_subscripts(inf, 1) as pos from {side}) where length(token) >= 3 group by entity_id, token)
    where token in (select token from df where df <= 100)) where r <= 2"""


def number_keys(side: str, extra: str) -> str:
    return rf"""select distinct entity_id, {extra}, k from (
    select x.entity_id, {extra}, 'NUM_' || m || '#' || token as k from (select *, unnest(list_concat([regexp_extract(addr_primary_num, '^\d+')], addr_numbers[1:2])) as m from {side}) x join ({rare_in_order(side)}) r on r.entity_id = x.entity_id where m <> ''
    union all select x.entity_id, {extra}, 'PIN_' || addr_pin || '#' || token from {side} x join ({rare_in_order(side)}) r on r.entity_id = x.entity_id where addr_pin <> '')"""


HYBRID = {"hybrid": keyed(number_keys("q", "route"), number_keys("t", "country_norm"), 15)}


def acronym_keys(side: str, extra: str) -> str:
    return f"""select distinct entity_id, {extra}, k from (select entity_id, {extra}, acr || '#' || addr_pin as k from {side} where acr is not null and addr_pin <> ''
    union all select entity_id, {extra}, name_clean || '#' || addr_pin from {side} where len(name_tokens) = 1 and length(name_clean) between 3 and 6 and addr_pin <> '')"""


ACRONYMS = {"acronyms": keyed(acronym_keys("q", "route"), acronym_keys("t", "country_norm"), 10**12)}

READINGS = {
    "rt": rf"select *, {reading('name_clean')} as reading from t where regexp_matches(name_clean, '[^\x00-\x7F]')",
    "rq": f"select *, {reading('name_clean')} as reading from q",
    "rtt": "select entity_id, unnest(list_distinct(list_filter(string_split(reading, ' '), lambda x: length(x) >= 4 and regexp_matches(x, '^[a-z]+$')))) as token from rt",
    "rdf": "select token from rtt group by token having count(*) <= 150",
    "rqt": "select entity_id, unnest(list_distinct(list_filter(string_split(reading, ' '), lambda x: length(x) >= 4 and regexp_matches(x, '^[a-z]+$')))) as token from rq",
    "translit": keyed(
        "select entity_id, route, 'n:' || reading as k from rq where reading <> '' union select entity_id, route, 't:' || token from rqt join rq using (entity_id) where token in (select token from rdf)",
        "select entity_id, country_norm, 'n:' || reading as k from rt where reading <> '' union select entity_id, country_norm, 't:' || token from rtt join rt using (entity_id) where token in (select token from rdf)",
        30,
    ),
}


def char_grams(tokens: str = "name_tokens") -> str:
    of = lambda k: f"list_transform(range(1, greatest(1, length(x) + 4 - {k})), lambda i: substring(' ' || x || ' ', i, {k}))"
    return f"flatten(list_transform({tokens}, lambda x: list_concat(list_concat({of(2)}, {of(3)}), {of(4)})))"


def word_grams(tokens: str = "name_tokens") -> str:
    ws = f"list_filter({tokens}, lambda x: length(x) >= 2)"
    return f"list_concat({ws}, list_transform(range(1, greatest(1, len({ws}))), lambda i: ({ws})[i] || ' ' || ({ws})[i + 1]))"


def retrieval(grams: str, k: int = 20, least: float = 0.25, min_df: int = 2, max_df: float = 0.9, reverse: int = 0, sublinear: bool = True, routes: bool = True) -> dict[str, str]:
    tf = "(1 + ln(tf))" if sublinear else "tf"
    side = lambda x: f"select id, term, w / sqrt(sum(w * w) over (partition by id)) as w from (select id, term, {tf} * idf as w from (select id, term, count(*) as tf from (select entity_id as id, unnest({grams}) as term from {x}) group by id, term) join voc using (term))"
    where = f"x <= {k}" + (f" or y <= {reverse}" if reverse else "")
    on = "where q.route = '*' or q.route = t.country_norm" if routes else ""
    return {
        "tg": f"select entity_id as id, unnest({grams}) as term from t",
        "voc": f"select term, ln((1 + n) / (1 + df)::double) + 1 as idf from (select term, count(distinct id) as df, (select count(*) from t) as n from tg group by term) where df >= {min_df} and df <= {max_df} * n",
        "vt": side("t"),
        "vq": side("q"),
        "sim": f"""select s1_id, cand_id, round(score, 9) as score from (
        select vq.id as s1_id, vt.id as cand_id, sum(vq.w * vt.w) as score from vq join vt using (term) group by vq.id, vt.id having sum(vq.w * vt.w) >= {least})
        join q on q.entity_id = s1_id join t on t.entity_id = cand_id {on}""",
        "found": f"select s1_id, cand_id, score from (select *, row_number() over (partition by s1_id order by score desc, cand_id) as x, row_number() over (partition by cand_id order by score desc, s1_id) as y from sim) where {where}",
    }


LEGACY_AB = """select q.entity_id as s1_id, t.entity_id as cand_id from q join t on q.name_clean = t.name_clean and q.name_clean <> ''
    union select q.entity_id, t.entity_id from q join t on q.addr_pin = t.addr_pin and q.addr_primary_num = t.addr_primary_num and q.addr_pin <> '' and q.addr_primary_num <> ''"""
RARE_PCT = """select distinct a.s1_id, b.cand_id from (select entity_id as s1_id, country_norm as c, unnest(list_distinct(inf)) as k from q) a join (select entity_id as cand_id, country_norm as c, unnest(list_distinct(inf)) as k from t) b using (c, k)
    where k in (with f as (select k, count(*) as n from (select unnest(list_distinct(inf)) as k from t) group by k) select k from f where n <= (select quantile_cont(n, 0.25) from f))"""


def jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0)::double, 0)"


def legacy_pruned(source: str, top_k: int, max_cands: int) -> str:
    score = f"round({jaccard('string_split(a.name_core, chr(32))', 'string_split(b.name_core, chr(32))')} + 0.2::double * len(list_intersect(a.addr_tokens, b.addr_tokens)) + case when a.addr_pin = b.addr_pin and a.addr_pin <> '' then 0.5::double else 0 end, 9)"
    return f"""select s1_id, cand_id from (select s1_id, cand_id, count(*) over (partition by s1_id) as n, row_number() over (partition by s1_id order by score desc, cand_id) as r from (
    select s1_id, cand_id, {score} as score from {source} join q a on a.entity_id = s1_id join t b on b.entity_id = cand_id)) where n <= {max_cands} or r <= {top_k}"""


# features of the candidate pairs, column by column


def safe(c: str) -> str:
    return f"case when lower(trim({c})) in ('nan', 'none') then '' else trim({c}) end"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0)::double, 0)"


def levenshtein(a: str, b: str) -> str:
    return f"1 - coalesce(levenshtein({bytewise(a)}, {bytewise(b)}) / nullif(greatest(length({a}), length({b})), 0)::double, 0)"


def equal(c: str) -> str:
    return f"({safe('a.' + c)} = {safe('b.' + c)} and {safe('a.' + c)} <> '')::int::double"


def has(*labels: str) -> str:
    return "(" + " or ".join(f"list_contains(strategies, {lit(x)})" for x in labels) + ")::int::double"


FIELDS = f"""select s1_id, cand_id, strategies, {safe("coalesce(nullif(a.name_clean, ''), a.business_name)")} as na, {safe("coalesce(nullif(b.name_clean, ''), b.business_name)")} as nb,
    {safe("coalesce(nullif(a.addr_clean, ''), a.business_address)")} as aa, {safe("coalesce(nullif(b.addr_clean, ''), b.business_address)")} as ab, a.addr_is_missing as ma, b.addr_is_missing as mb,
    a.name_tokens as ta, b.name_tokens as tb, list_distinct(a.inf) as ia, list_distinct(b.inf) as ib, a.addr_tokens as ua, b.addr_tokens as ub,
    {equal('name_core')} as name_core_exact, {equal('name_sorted')} as name_sorted_exact, {equal('addr_pin')} as addr_pin_match, {equal('addr_primary_num')} as addr_num_match,
    (lower({safe('a.country')}) = lower({safe('b.country')}) and {safe('a.country')} <> '')::int::double as country_match
    from cand join q a on a.entity_id = s1_id join t b on b.entity_id = cand_id"""
SETS = "len(list_intersect(ta, tb))"
FEATURES = {
    "pair": FIELDS,
    "pair2": f"""select *, na <> '' and nb <> '' as named, not (ma or length(aa) < 3 or mb or length(ab) < 3) as present, {reading('na')} as ra, {reading('nb')} as rb from pair""",
    "feat1": f"""select *, (named and na = nb)::int::double as name_exact, case when named then {levenshtein('na', 'nb')} else 0 end as name_lev,
    case when named then jaro_winkler_similarity({bytewise('na')}, {bytewise('nb')}) else 0 end as name_jaro,
    case when named then {jaccard('ta', 'tb')} else 0 end as name_token_jaccard,
    case when named then {ratio(SETS, 'least(len(list_distinct(ta)), len(list_distinct(tb)))')} else 0 end as name_token_overlap,
    {ratio('len(list_intersect(ia, ib))', 'greatest(len(ia), len(ib))')} as name_rare_token_overlap,
    {ratio('abs(len(ta) - len(tb))', 'greatest(len(ta), len(tb))')} as name_token_count_diff,
    {ratio('least(length(na), length(nb))', 'greatest(length(na), length(nb))')} as name_length_ratio,
    case when present then {levenshtein('aa', 'ab')} else 0 end as addr_lev, case when present then {jaccard('ua', 'ub')} else 0 end as addr_token_jaccard,
    case when present then {ratio('least(length(aa), length(ab))', 'greatest(length(aa), length(ab))')} else 0 end as addr_length_ratio, (not present)::int::double as addr_either_missing,
    case when ra <> '' and rb <> '' then {levenshtein('ra', 'rb')} else 0 end as name_translit_lev, (ra <> '' and rb <> '' and ra = rb)::int::double as name_translit_exact,
    {has('exact_name')} as prov_exact_name, {has('address')} as prov_address, {has('rare_token')} as prov_rare_token, {has('char_retrieval', 'char_retrieval_reciprocal')} as prov_retrieval_reciprocal, {has('transliteration')} as prov_transliteration from pair2""",
    "feat": """select *, name_lev * addr_lev as cross_name_addr, (name_lev > 0.85 and addr_either_missing = 1)::int::double as name_high_addr_missing, (name_exact = 1 and addr_lev > 0.6)::int::double as name_exact_addr_match,
    prov_exact_name + prov_address + prov_rare_token + prov_retrieval_reciprocal + prov_transliteration as prov_count from feat1""",
}

PR = "case when n_true = 0 and n_pred = 0 then 1.0::double when n_pred = 0 then 0 else n_hit / n_pred::double end as p, case when n_true = 0 and n_pred = 0 then 1.0::double when n_true = 0 then 0 else n_hit / n_true::double end as r"


def tuned(grid, op: str = ">") -> dict[str, str]:
    taus = ", ".join(f"({t}::double)" for t in grid)
    return {
        "taus": f"select tau from (values {taus}) v(tau)",
        "marked": "select sc.s1_id, sc.cand_id, score, (truth.s1_id is not null)::int as t from sc left join (select distinct s1_id, cand_id from truth) truth on truth.s1_id = sc.s1_id and truth.cand_id = sc.cand_id",
        "hits": f"select s1_id, tau, count(*) as n_pred, sum(t) as n_hit from marked join taus on score {op} tau group by s1_id, tau",
        "grid": f"""select tau, avg(p) as precision, avg(r) as recall from (select tau, {PR} from (
        select q.entity_id, taus.tau, coalesce(m.n_true, 0) as n_true, coalesce(hits.n_pred, 0) as n_pred, coalesce(hits.n_hit, 0) as n_hit from q cross join taus
        left join (select s1_id, count(distinct cand_id) as n_true from truth group by s1_id) m on m.s1_id = q.entity_id left join hits on hits.s1_id = q.entity_id and hits.tau = taus.tau)) group by tau""",
        "tuned": "select *, coalesce(1.25 * precision * recall / nullif(0.25 * precision + recall, 0), 0)::double as f05 from grid",
    }
