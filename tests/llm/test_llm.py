"""Small tables with nulls, empty texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import embeddings, htmltext, mixing, neardup, packing, pii, quality, shared, substrings, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, score double"
LONG = " ".join(f"w{i % 97}" for i in range(9000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1, "r", 0.5),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, "r", 0.5),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, "r", 0.5),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota", None, None, None, None, None),
    (4, None, "en", "a", 0, None, None),
    (5, "", "en", "", 0, None, None),
    (None, "one", "en", "c", 3, None, None),
    (6, LONG, "en", "a", len(LONG), None, None),
    (7, "call +1 (017) 555-7713 or mail a.b@x.example.com, Mr. John Smith", "en", "c", 9, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_neardup(docs):
    got = by_id(neardup.near_duplicates(docs, shingle=2))
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 4, 5, 6]
    assert got[4].n_shingles == 0 and got[None].kept and neardup.near_duplicates(docs).count() == len(ROWS)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def chained(n=60, words=80, seed=1):
    """Texts that differ from one base text in a few words each, so that links form chains."""
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in rng.integers(0, 5000, words)]
    texts = []
    for _ in range(n):
        w = list(base)
        for k in rng.integers(0, words, rng.integers(0, 9)):
            w[k] = f"e{rng.integers(0, 9999)}"
        texts.append(" ".join(w))
    return texts


def components(ids, texts, k):
    """Smallest id reachable from each row; rows with one id are one node."""
    words = [t.lower().split() if t else [] for t in texts]
    sets = [set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)} if w else set() for w in words]
    label = list(ids)
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if ids[i] == ids[j] or sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("shingle,block", [(2, 400), (2, 7), (5, 400)])
def test_neardup_brute(spark, monkeypatch, shingle, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # also many blocks a band
    texts = chained()
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=shingle))
    assert [got[i].component_id for i in range(60)] == components(range(60), texts, shingle)


def test_neardup_repeated_ids(spark):
    """One doc_id with several texts has the links of all of them."""
    q, w, x = ("q1 q2 q3 q4 q5 q6 q7 q8 q9 q0 " * 3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w0 v1 v2 v3 v4 v5 v6 v7 v8", "x1 x2 x3")
    rows = [(5, q), (5, w), (9, w.replace("v8", "v9")), (3, q.upper()), (7, x), (7, None), (8, x + " y"), (6, ""), (None, q), (8, w + " z")]
    ids = [r[0] for r in rows if r[0] is not None]
    want = dict(zip(ids, components(ids, [r[1] for r in rows if r[0] is not None], 2)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((i, want[i]) for i in ids)
    assert want[9] == want[8] == 3 and [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_one_of_each(spark):
    texts = chained(20)
    rows = [(i + 10, t, "k", i) for i, t in enumerate(texts)] + [(1, "one two", "k", 1), (1, "one two", "k", 1), (1, "other text", "k", 2), (2, "ONE  two", "k", 3), (None, "one two", "k", 4), (None, None, "k", 5), (3, "", "k", 6), (3, "", "k", 6), (None, "alone", "k", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, k1 string, `group` long")
    got = Counter(tuple(r) for r in neardup.one_of_each(d).collect() if (r.doc_id or 0) < 10)
    label = components(range(20), texts, 5)
    kept = {i + 10 for i in range(20) if label[i] == i}
    assert {r.doc_id for r in neardup.one_of_each(d).collect() if (r.doc_id or 0) >= 10} == kept
    assert got == {(1, "one two", "k", 1): 1, (1, "other text", "k", 2): 1, (3, "", "k", 6): 2, (None, None, "k", 5): 1, (None, "alone", "k", 7): 1}
    assert neardup.one_of_each(d).columns == d.columns and neardup.one_of_each(d.limit(0)).count() == 0


def test_sketch_merges():
    a, b = (np.random.default_rng(i).integers(0, 2**63, 500).astype(np.uint64) for i in (1, 2))
    r = [neardup.registers(neardup.minima(x)) for x in (a, b, np.union1d(a, b))]
    assert (neardup.merge(r[0], r[1]) == r[2]).all()


@pytest.mark.parametrize("copies", [1, 40])
def test_packing_round_trip(spark, docs, copies):
    """Every id of every row in one piece, by offsets, lengths, checksums and the end of every sequence."""
    many = ROWS + [(100 + i, " ".join(f"x{(i * j) % 31}" for j in range(i * 37 % 900)), "en", "a", 0, None, None) for i in range(copies * 5)]
    got = packing.pack(spark.createDataFrame(many, SCHEMA)).collect()
    tok = packing.tokenizer(packing.public_tokenizers.path(packing.TOKENIZER))
    ids = [(r[0], np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")) for r in many]
    pieces = Counter((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got)
    by_doc = {}
    for d, n, start, length, crc in pieces.elements():
        by_doc.setdefault((d, n), []).append((start, length, crc))
    for (d, n), cuts in by_doc.items():
        rows = [x for i, x in ids if i == d and len(x) == n]
        assert rows and sum(c[1] for c in cuts) == n * len(rows)
        for start, length, crc in cuts:
            assert any(crc == zlib.crc32(x[start : start + length].tobytes()) for x in rows) and length > 0
        if len(rows) == 1:
            at = 0
            for start, length, _ in sorted(cuts):
                assert start == at
                at += length
    assert set(by_doc) == {(i, len(x)) for i, x in ids}
    padding = 0
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.01 * sum(len(x) for _, x in ids) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_nnls():
    a = np.array([[1.0, 1.0], [1.0, -1.0], [0.0, 1.0]])
    assert packing.nnls(a, np.array([2.0, 4.0, -1.0])) == pytest.approx([3.0, 0.0])


def test_mixing(docs):
    got = mixing.takes(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    assert mixing.takes(docs.limit(0)).count() == 0 and mixing.mix(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_mix_rows(spark):
    """The words written are the words taken, row by row, also where rows share id, source and size."""
    rows = [(1, "a b c d e f g", "s", "x"), (1, "t u v w x y z", "s", "x"), (1, "t u v w x y z", "s", "x"), (None, "n n n", "s", None), (None, "m m m", None, None), (-1, "k k k", "t", "x"), (2, None, "t", "x"), (3, " \n", "t", "x"), (4, "l " * 40, "t", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, doc string")
    want, have = Counter(), Counter()
    for r in mixing.takes(d, keep=True).collect():
        want[(r.doc_id, r.source, (r.doc.text or "").split(" ")[0])] += r.taken
    got = mixing.mix(d).collect()
    for r in got:
        have[(r.doc_id, r.source, r.text.split(" ")[0])] += len(r.text.split())
    assert +want == have and set(got[0].asDict()) == {"doc_id", "text", "source", "doc"}


def test_targets(spark):
    """Against sources filled one by one, with many that stop at their cap."""
    rng = np.random.default_rng(5)
    rows = [(None if i == 7 else f"s{i:02}", int(10 ** rng.uniform(0, 5))) for i in range(40)]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {r[0]: (1, 2, 3)[i % 3] for i, r in enumerate(ordered)}
    left, open_, want = float(sum(n for _, n in rows)), dict(rows), {}
    while full := {s for s, n in open_.items() if 3.0 * n <= left / sum(weight[x] for x in open_) * weight[s]}:
        want |= {s: 3.0 * open_[s] for s in full}
        left -= sum(3.0 * open_.pop(s) for s in full)
    want |= {s: left / sum(weight[x] for x in open_) * weight[s] for s in open_}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert got == pytest.approx(want)


def test_numbered(spark):
    d = spark.createDataFrame([(i * 37 % 101, str(i)) for i in range(101)], "a long, b string").repartition(7)
    assert sorted((r.a, r.k) for r in shared.numbered(d, "k", "a").collect()) == [(i, i) for i in range(101)]


def test_mixing_order(spark, tmp_path):
    d = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(120)], "doc_id long, text string, source string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    slopes = {"a": -0.5, "b": 0.0, "c": 0.5}
    want, first = [], {}
    for t in mixing.takes(d).collect():
        for k in range(t.whole + (t.part > 0)):
            n = t["size"] if k < t.whole else t.part
            y, lo, hi = (k * t.source_size + t.done + n / 2) / t.target, 0.0, 1.0
            for _ in range(60):  # invert the integral of 1 + s (2t - 1) by bisection
                m = (lo + hi) / 2
                lo, hi = (m, hi) if m + slopes[t.source] * (m * m - m) < y else (lo, m)
            want.append((lo, t.doc_id, k, n))
            first[t.doc_id] = min(first.get(t.doc_id, 2.0), lo)
    got = mixing.op7_curriculum_query(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.repeat, r.n_words) for r in got] == [x[1:] for x in sorted(want)]
    assert [r.position for r in got] == pytest.approx([x[0] for x in sorted(want)])
    rows = mixing.op7_query(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (first.get(i, 2.0), i))
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in mixing.takes(d).collect()}
    assert [r.doc_id for r in mixing.ordered(d, slopes={"a": 1.0}).collect()] != [r.doc_id for r in rows]


def test_pii(docs):
    got = by_id(pii.redact(docs))
    assert got[7].pii_count == 3 and re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or mail [a-z]\.[a-z]@[a-z]\.example\.com, Mr\. \w+ \w+", got[7].text)
    assert got[4].text is None and got[6].text == LONG and pii.redact(docs.limit(0)).count() == 0


def test_pii_distinct(spark):
    n = 400
    d = spark.createDataFrame([(i, f"+1 (555) {i:03d}-00{i % 100:02d} and a{i % 10}@b.example.com") for i in range(n)], "doc_id long, text string")
    out = [r.text for r in pii.redact(d).collect()]
    assert len({t.split(" and ")[0] for t in out}) == len({f"{i:03d}{i % 100:02d}" for i in range(n)})
    assert len({t.split(" and ")[1] for t in out}) == 10


def test_pii_spellings(spark, monkeypatch):
    texts = ["+49 (30) 1234567", "+4930 1234567", "+49 30 12 34567", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "DE00370400440532013000"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(d).collect()}
    bare = lambda i: re.sub(r"[^+\w]", "", got[i])
    assert bare(0) == bare(1) == bare(2) and bare(0).startswith("+49") and bare(3) == bare(4)
    for i in range(len(texts)):
        assert got[i] != texts[i] and re.sub(r"\d", "0", got[i]) == re.sub(r"\d", "0", texts[i])
    right = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert right(bare(4)) and not right(bare(5))
    other = {r.doc_id: r.text for r in pii.redact(d, key="another").collect()}
    assert all(other[i] != got[i] for i in other)
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba"])  # four family names for nine
    found = spark.createDataFrame([("family", f"x:{c}xo", f"x:{c}xo") for c in "ABCDEFGHI"], "kind string, norm string, e string")
    with pytest.raises(RuntimeError):
        pii.attempts(found, max_rounds=1)


NAMES = ["Mr. John Smith", "Mr John Smith", "Mrs. John Smith", "Mrs. Smith", "Herr Smith", "Mr. John McSmith", "Frau Anne-Marie Smith", "господин Иван Петров", "κύριος Νίκος Παππάς"]


def test_pii_names(spark):
    """Parts of names are replaced one by one: distinct, and the same in all names, also where some collided."""
    d = spark.createDataFrame([(i, n, "x") for i, n in enumerate(NAMES)], "doc_id long, text string, p_ents string")
    got = {r.doc_id: r.text.split(" ") for r in pii.redact(d).collect()}
    assert got[0][1:] == got[1][1:] and got[0][1] != got[2][1] and got[0][2] == got[2][2] == got[3][1] == got[4][1] == got[6][2] != got[5][2]
    assert re.fullmatch(r"[A-Z][a-z]+-[A-Z][a-z]+", got[6][1]) and re.fullmatch(r"[а-я]+", got[7][1].lower()) and re.fullmatch(r"\p{IsGreek}+".replace(r"\p{IsGreek}", "[α-ωάς]"), got[8][1].lower())
    parts = {w for t in NAMES for w in re.split(r"[ -]", t)[1:]}
    assert not parts & {w for t in got.values() for w in re.split("-", " ".join(t[1:]))}


@pytest.mark.parametrize("max_literal", [0, 5000])
def test_pii_collisions(spark, monkeypatch, max_literal):
    """Few syllables, so that names collide: each part still has one surrogate of its own, in repeated and null-id rows too."""
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be", "bo"])
    names = [f"Mr. A{chr(97 + i % 5)}xan T{chr(97 + i // 5)}{chr(97 + i % 7)}ver" for i in range(35)]
    rows = [(None if i % 3 else i, n) for i, n in enumerate(names)] * 2
    got = [r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), max_literal=max_literal).collect()]
    assert len(got) == 70 and len(set(got)) == 35 and not set(got) & set(names)
    assert len({g.split()[1] for g in got}) == 5 and len({g.split()[2] for g in got}) == len({n.split()[2] for n in names})


UNIT_ROWS = [
    (3, "A b c. D e f g!  Tail one", "keep", 7.0),
    (1, "a  B c. d e F g! Other end\n\nx", "keep", 7.0),
    (2, None, "keep", None),
    (4, "", "keep", None),
    (5, " \n. \n", "keep", None),
    (None, "D e f g!\nA b c. tail One", "keep", None),
    (6, "short. D e f g! alone. " + "w " * 40, None, None),
    (6, "short. D e f g! alone. " + "w " * 40, None, None),
]


def brute_units(rows, unit, min_run):
    """By the docstring, text by text; rows in the order of their ranks."""
    cut_at = {"line": r"(?<=\n)", "sentence": r"(?<=\n)|(?<=[.!?][ \t])"}[unit]
    seen, out = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        text = rows[i][1]
        us = [u for u in re.split(cut_at, text or "") if u]
        again, run, runs = [], [], []
        for k, u in enumerate(us):
            key = " ".join(u.lower().split())
            if not key:
                continue
            if key in seen:
                run.append(k)
            else:
                runs.append(run)
                run = []
            again.append(key)
            seen.add(key)
        gone = {k for r in [*runs, run] if sum(len(us[k].split()) for k in r) >= min_run for k in r}
        at = np.cumsum([0, *map(len, us)])
        out[i] = (text if text is None else "".join(u for k, u in enumerate(us) if k not in gone), len(us), [(int(at[k]), len(us[k])) for k in sorted(gone)])
    return out


@pytest.mark.parametrize("unit,min_run", [("line", 1), ("sentence", 1), ("sentence", 7), ("sentence", 50)])
def test_units(spark, unit, min_run):
    d = spark.createDataFrame(UNIT_ROWS, "doc_id long, text string, rank string, row_id double").coalesce(1)
    got = substrings.dedup_units(d, unit, min_run)
    assert got.columns == ["doc_id", "text", "rank", "row_id", "n_units", "n_removed", "removed"]
    want = brute_units(UNIT_ROWS, unit, min_run)
    have = sorted((repr((r.doc_id, r.text, r.rank, r.row_id)), r.n_units, r.n_removed, [tuple(x) for x in r.removed]) for r in got.collect())
    assert have == sorted((repr((UNIT_ROWS[i][0], t, *UNIT_ROWS[i][2:])), n, len(s), s) for i, (t, n, s) in want.items())
    assert substrings.dedup_units(d.limit(0), unit).count() == 0


def test_units_of_a_text():
    text = "One. Two!\nthree\n\n \nfour? 5.6 seven.\t\neight."
    split = lambda k: [m.group() for m in substrings.UNITS[k].finditer(text)]
    assert split("line") == ["One. Two!\n", "three\n", "\n", " \n", "four? 5.6 seven.\t\n", "eight."]
    assert split("sentence") == ["One. ", "Two!\n", "three\n", "\n", " \n", "four? ", "5.6 seven.\t", "\n", "eight."]
    assert split("paragraph") == ["One. Two!\nthree\n\n \n", "four? 5.6 seven.\t\neight."]
    for k in substrings.UNITS:
        for t in ("", "\n", "a\n", "\n\na\n\n\n", "a\nb", "..", ". ", "a\n \n"):
            assert "".join(m.group() for m in substrings.UNITS[k].finditer(t)) == t


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_suffixes(spark):
    rng = np.random.default_rng(0)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    a, b = word(500), word(260)
    texts = [a + word(50), word(90) + a[100:400], b, b, "ab" * 300, "é" * 90 + b[:199], None, "", word(3000) + b[20:] + word(40) + b[:230]]
    got = by_id(suffixes.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [(got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) for i in range(len(texts))] == brute(texts)


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 300):
        s = np.r_[rng.integers(1, 4, n), 0].astype(np.int16)
        assert suffixes.suffix_array(s, 5, 1000).tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    v = np.concatenate([base + 0.05 * rng.standard_normal(base.shape) for _ in range(5)])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, rows0 := [float(x) for x in v[0]]), (905, rows0)]
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=20).collect()}
    full = np.concatenate([v, v[:1], v[:1]])
    u = embeddings.unit(full)
    links = (u @ u.T >= 0.95).sum(1) - 1
    ids = [*range(len(v)), 904, 905]
    have = np.array([got[i].n_links for i in ids])
    assert have.sum() >= 0.9 * links.sum() and (have <= links).all()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))


def planted(n, dims, seed=1):
    """n vectors, and for every fourth a partner at a cosine of just over 0.95, both spread over the space."""
    rng = np.random.default_rng(seed)
    x = embeddings.unit(rng.standard_normal((n, dims)))
    other = rng.standard_normal((n // 4, dims))
    other = embeddings.unit(other - (other * x[::4]).sum(1, keepdims=True) * x[::4])
    c = 0.952
    return np.concatenate([x, c * x[::4] + (1 - c * c) ** 0.5 * other])


@pytest.mark.parametrize("n,max_leaf", [(6000, embeddings.MAX_LEAF), (2400, 60)])
def test_vectors_recall(spark, n, max_leaf):
    """Recall of links against brute force with the forest as it is set, and with leaves that are split again."""
    v = planted(n, 64)
    u = embeddings.unit(v)
    hit = u @ u.T >= 0.95
    links = hit.sum(1) - 1
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    more = {} if n == 6000 else {"leaf": 500}
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(d, max_leaf=max_leaf, **more).collect()}
    have = np.array([got[i].n_links for i in range(len(v))])
    assert links.sum() >= n / 2 and (have <= links).all()
    recall = have.sum() / links.sum()
    print("recall", n, max_leaf, recall)
    assert recall >= (0.99 if n == 6000 else 0.9)
    for i in np.flatnonzero(have == links)[:200]:
        if links[i] == 1:
            j = int(np.flatnonzero(hit[i] & (np.arange(len(v)) != i))[0])
            assert have[j] != 1 or got[i].component_id == min(i, j)


@pytest.mark.parametrize("few", [0, embeddings.FEW_HITS])
def test_vectors_blocks(spark, monkeypatch, few):
    """A leaf of several blocks, whose pairs are judged one by one or together, gives the links of brute force."""
    monkeypatch.setattr(embeddings, "BLOCK", 30)
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 0)
    monkeypatch.setattr(embeddings, "FEW_HITS", few)
    v = planted(200, 64)
    links = (v @ v.T >= 0.95).sum(1) - 1
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate([*v, v[3]])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(d, leaf=1000, trees=2).collect()}
    near = v @ v[3] >= 0.95
    assert [got[i].n_links for i in range(len(v))] == (links + near).tolist() and links.sum() >= 100
    assert [got[i].component_id for i in range(200, 250)] == list(range(0, 200, 4))


def test_vectors_odd(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 0.0]
    rows = [(1, a), (1, None), (2, a), (2, [0.0, 0.0, 0.0]), (3, b), (4, b), (5, []), (None, a), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.001])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(d).collect())
    assert got == Counter([(1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (None, 0, None, True), (6, 0, 6, True), (7, 2, 1, False)])
    assert embeddings.near_duplicate_vectors(d.limit(0)).count() == 0


def test_quality(spark, docs):
    got = quality.judge(docs, docs.where("doc_id = 6").select("doc_id")).collect()
    six = next(r for r in got if r.doc_id == 6)
    assert six.n_words == 9000 and six.n_repeat_words == 9000 and six.base_failed and len(got) == len(ROWS)
    text = "a b c d e f g h x a b c d e f g h y\nz\nz"
    r = quality.base_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_repeat_words, r.n_dup_lines, r.word_chars) == (16, 1, 20)


def test_html():
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; t</h1><p>One\n two<p>Three <b>four</b></article><div class='comments'><p>nice</p></div><script>x='<p>'</script></body></html>"
    assert htmltext.extract(page) == "T & t\n\nOne two\n\nThree four"
    assert htmltext.extract(None) == "" == htmltext.extract("")


LOREM = "This is a rather long paragraph of an article, with words enough for it. " * 4


def test_html_markup():
    side = '<div class="sidebar"><p>side</p></div>'
    p = f"<p>{LOREM}</p>"
    body = LOREM.strip()
    for page, want in (
        ('<p a=b"c>Hello one</p><p>two</p>', "Hello one\n\ntwo"),
        ("<div class=it's><p>one</p><p>two</p><p>three</p></div>", "one\n\ntwo\n\nthree"),
        (f'<body><div class="layout has-sidebar"><article>{p}</article>{side}</div></body>', body),
        (f'<body><form action=x><h1>T</h1>{p}{p}<input name=a></form></body>', f"T\n\n{body}\n\n{body}"),
        (f'<body><div id=c><h1>T</h1>{p}{p}</div><div class="comments">{p}{p}{p}</div></body>', f"T\n\n{body}\n\n{body}"),
        (f"<header><h1>Site</h1></header><div>{p}{p}</div><form><p>Search here</p><input></form>", f"{body}\n\n{body}"),
        ('<p data-class="ads">x y z</p>', "x y z"),
        ('<p>a</p><a href="x>lost', "a"),
        ("<p>a<br>b &amp;c &#x41;", "a b &c A"),
        ("<p title='>'>x</p><!-- <p>no</p> --><style>p{}</style>", "x"),
    ):
        assert htmltext.extract(page) == want, page


def test_html_density():
    """Counts, densities and sums of every node against their definition, found anew for each node."""
    page = f"<body><div><a href=x>one two</a><ul><li><a href=y>three</a><li>four</ul></div><div><p>{LOREM}<b>bold</b></p><p>tail <i>x</i> <a>y</a></p></div></body>"
    root = htmltext.parse(page)
    order = htmltext.measure(root)

    def under(n):
        return [x for c in n.children() for x in (c, *under(c))]

    size = lambda n: sum(len("".join(x.split())) for m in (n, *under(n)) for x in m.parts if isinstance(x, str))
    links = lambda n: sum(size(x) for x in under(n) if x.name == "a")
    for n in order:
        c, t, lc, lt = size(n), max(1, len(under(n))), links(n), sum(x.name == "a" for x in under(n))
        assert (n.chars, n.link_chars, n.link_tags) == (c, lc, lt)
        base = math.log(c / max(1, c - lc) * lc + links(root) / size(root) * c + math.e)
        want = c / t * math.log(max(1 + 1e-9, c / max(1, lc) * t / max(1, lt))) / math.log(max(base, 1) + math.e - 1)
        assert n.density == pytest.approx(want) and n.total == pytest.approx(sum(x.density for x in n.children()))
    assert htmltext.choose(root)[0].parts[0].name == "p"


def test_html_rows(spark):
    d = spark.createDataFrame([(1, "u", None), (None, None, "<p>x"), (1, "u", None)], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in htmltext.extract_text(d).collect()) == [("", 0), ("", 0), ("x", 1)]


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    filler = ["moving", "stone", "river", "garden", "window", "letter", "corner", "summer", "stupor", "rapid"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = list(rng.choice(filler, 30))
        if bad:
            w[5] = ("stupid", "st0pid", "s t u p i d", "stuuuupid")[i // 4 % 4] if i % 3 == 0 else "stupid"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    got = by_id(toxicity.score(d.unionByName(spark.createDataFrame([(999, None), (998, "")], "doc_id long, text string")), model))
    held = [i for i in range(400) if toxicity.crc(i) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.9
    assert got[999].predicted == got[998].predicted == 0
    assert toxicity.decode("stuuuupid", model.language) == "stupid" and toxicity.decode("s t u p i d", model.language) == "stupid"


def test_disguises(spark):
    clean = "you idiot are such a stupid person and this ass is shit for the old moving stone by the river in a garden. " * 30
    docs = spark.createDataFrame([(i, clean) for i in range(5)], "doc_id long, text string")
    r = toxicity.Restorer(toxicity.language_model(toxicity.trigram_counts(docs)))
    for text, want in {
        "idi07": "idiot", "1d107": "idiot", "5h17": "shit", "a$$": "ass", "4$$": "ass", "1di0t!": "idiot", "(5h1t)": "shit",
        "i d i o t,": "idiot", "i d i o t.": "idiot", "(i d i o t)": "idiot", "a s s": "ass", "s  h  i  t": "shit", "i\td\ti\to\tt": "idiot",
        "a s t u p i d person": "a stupid person", "y o u i d i o t": "you idiot", "y o u  i d i o t!": "you idiot", "s.t.u.p.i.d": "stupid", "s-h-1-t": "shit",
    }.items():
        assert set(want.split()) <= r.words(text)[0], text
    assert r.words("you! (person) 1,000 $100 3 4 5") == ({"you", "person", "1,000", "100", "3", "4", "5"}, 0)


def test_alike(monkeypatch):
    rng = np.random.default_rng(3)
    s = np.tile(rng.integers(0, 3, 40), 8)
    s[rng.integers(0, len(s), 6)] = 9
    a = rng.permutation(len(s) - 12)[:200]
    b = (a + 40 * rng.integers(0, 3, 200)) % (len(s) - 12)
    want = [(s[i : i + 12] == s[j : j + 12]).all() for i, j in zip(a, b)]
    for compared in (1, 30, 1 << 20):
        monkeypatch.setattr(suffixes, "COMPARED", compared)
        assert suffixes.alike(s, a, b, 12).tolist() == want
    assert len(suffixes.alike(s, a[:0], b[:0], 12)) == 0


def test_discard(spark):
    a, b = (shared.cut(spark.range(n)) for n in (5, 0))
    shared.discard(a)
    assert b.count() == 0 and not any(os.path.exists(f.removeprefix("file://")) for f in a.inputFiles())
    shared.discard(b)
