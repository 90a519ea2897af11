"""The pipeline's stages on a small table, each against what its operator says of its own input."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import bpe, jaccard, langid, licenses, mixing, pii, quality, queries, substring
from tests.llm.fixtures import documents, empty_documents, odd_documents

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    stage = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    good = stage["quality"](spark, docs, sf_dir).cache()
    scored = quality.score(docs, quality.fit(docs, labels)).where("predicted = 1")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scored.collect())

    one = stage["near duplicates"](spark, good, sf_dir).cache()
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in jaccard.near_duplicates(good).where("doc_id = component_id").collect())

    clean = stage["pii"](spark, one, sf_dir).cache()
    before = {r.doc_id: r.text for r in one.collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        found = pii.find(text)
        assert (after[i].text == text) == (not found)
        assert all(text[a:b] not in after[i].text for _, a, b, _ in found)
        assert after[i].n_chars == len(after[i].text)

    mixed = stage["mixing"](spark, clean, sf_dir).cache()
    total = lambda df: df.select(mixing.n_words().alias("n")).groupBy().sum("n").first()[0]
    assert abs(total(mixed) - 1.5 * total(clean)) <= 20
    for df in (good, one, clean, mixed):
        assert df.columns == docs.columns

    ids = stage["bpe"](spark, mixed, sf_dir)
    assert ids.count() == mixed.count()


def test_stages_on_odd_documents(spark, sf_dir):
    docs = documents(spark, odd_documents()).select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, empty_documents(spark).select(docs.columns)):
        now = table
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            now = stage(spark, now, sf_dir)
            assert now.columns == docs.columns, name
        n = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).count()
        assert (n > 0) == (table is docs)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()
    assert sum(r.doc_id is None for r in kept) == 1
    assert {2, 3} <= {r.doc_id for r in kept}


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    pairs = [(1, a), (7, a), (7, b), (9, b), (20, c), (20, c + " end"), (20, c), (30, ""), (30, None), (None, a)]
    docs = documents(spark, pairs).select("doc_id", "text", "lang", "source", "n_chars")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) == 6
    assert {(1, a), (7, b), (30, ""), (30, None), (None, a)} < set(kept)
    assert sum(i == 20 for i, _ in kept) == 1


def test_very_long_texts(spark):
    """Three texts of two megabytes, two of them equal: of many words, of one word."""
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(300_000))
    pairs = [(1, long), (2, long), (3, "x" * 2_000_000), (4, "short text")]
    docs = documents(spark, pairs).repartition(2).cache()
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert near[2][1] == 1 and near[1] == near[2] and near[3] == (1, 3) and near[1][0] > 299_000
    left = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs, 35, keep_text=False).collect()}
    assert left == {1: (300_000, 300_000), 2: (300_000, 300_000), 3: (1, 0), 4: (2, 0)}
    model = quality.Model(0.1, np.zeros(quality.FEATURES), np.zeros((quality.FEATURES, 2)))
    assert quality.score(docs, model).count() == 4
    assert langid.predict(docs, langid.fit(docs)).count() == 4
    assert licenses.scan(docs).where("n_units = 0").count() == 4
    assert {r.row.doc_id: len(r.entities) for r in pii.replace_pii(docs, "k").collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    ids = {r.doc_id: r.n_tokens for r in bpe.encode_documents(docs.where("doc_id <> 2"), queries.vocabulary(), keep_ids=False, keep_text=False).collect()}
    assert ids[1] > 300_000 and ids[4] == 2


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries().keys()
    assert {re.match(r"op\d+", n)[0] for n in names if re.match(r"op\d+_", n)} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names and queries.SQL.keys() <= names


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf_dir, name):
    from tests.compare import engine, rows

    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(engine(sf_dir).sql(queries.SQL[name]).df())
