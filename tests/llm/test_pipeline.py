"""The stages of the pipeline on a small table with nulls, repeated rows and clashing names, against the rules of their docstrings."""

from collections import Counter

import pytest

import corpus_pipeline
from tessella.llm import mixing

CLASHES = "score double, predicted int, n_restored long, pii_count long, k1 string, doc string, `group` string, size long"
EXTRA = (0.25, 7, 8, 9, "k", "d", "g", 5)
FILLER = "moving stone river garden window letter corner summer stupor rapid".split()


def text(i, n=40):
    return " ".join(FILLER[(i * 7 + k * k) % 10] + str((i * 31 + k) % 97) for k in range(n))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = [(i, text(i) + (" stupid idiot" if i % 4 == 0 else "") + (f" mail a{i}@b.example.com" if i % 5 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(120)]
    rows += [(1, rows[1][1], "en", "s1", 1)] * 2 + [(200, rows[2][1], "en", "s0", 1), (201, rows[3][1].replace("moving", "moved", 1), None, None, None)]
    rows += [(None, None, None, None, None), (300, "", "en", "s1", 0), (301, None, "en", "s1", None), (None, "one single row without id " * 9, "en", "s2", 3), (302, text(500, 9000), "en", "s2", 1)]
    spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    start = rows_of(docs)
    kept = corpus_pipeline.drop_toxic(spark, docs, table)
    assert kept.columns == docs.columns and not rows_of(kept) - start
    assert not any("idiot" in (r.text or "") for r in kept.collect())
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(120) if i % 4} | {200, 201, 300, 301, 302, None}

    one = corpus_pipeline.drop_near_duplicates(spark, kept, table)
    want = rows_of(kept)
    want[next(r for r in want if r[0] == 1)] = 1
    want = +Counter({r: n for r, n in want.items() if r[0] not in (200, 201)})
    assert one.columns == docs.columns and rows_of(one) == want

    safe = corpus_pipeline.replace_pii(spark, one, table)
    before, after = ({(r.doc_id, r.source): r for r in d.collect()} for d in (one, safe))
    assert safe.columns == docs.columns and set(before) == set(after)
    for k, r in after.items():
        assert r.n_chars == len(r.text or "") and tuple(r)[5:] == EXTRA
        assert (r.text == before[k].text) == ("@" not in (r.text or ""))

    mixed = corpus_pipeline.mix_sources(spark, safe, table)
    taken = sum(r.taken for r in mixing.takes(safe).collect())
    assert mixed.columns == docs.columns and sum(len(r.text.split()) for r in mixed.collect()) == taken > 0

    pieces = corpus_pipeline.pack_sequences(spark, mixed, table)
    ends = {(r.doc_id, r.doc_tokens) for r in pieces.collect()}
    assert {i for i, _ in ends} == {r.doc_id for r in mixed.collect()}


def test_empty(spark, table):
    none = spark.read.parquet(f"{table}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, table).count() == 0


def test_run(spark, table):
    got = corpus_pipeline.run(spark, table)
    assert got.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
