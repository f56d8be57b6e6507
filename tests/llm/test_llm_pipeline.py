"""The pipeline on the small tables: each stage's effect, and the last one's rows by brute force."""

import corpus_pipeline
import numpy as np
import pytest
from llm_helpers import plain_tokens

from citeweave.llm.common import table, written
from citeweave.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def stages(spark, data):
    out, d = [table(spark, data, "documents")], table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES:
        d = written(stage(spark, d, data), f"test-{name}")
        out.append(d)
    return out


def ids(d):
    return sorted(r.doc_id for r in d.select("doc_id").collect())


def test_stages_keep_columns_and_filter(stages, spark, data):
    first, clean, single, unseen, mixed, tokens = stages
    assert all(s.columns == first.columns for s in (clean, single, unseen, mixed))
    assert len(corpus_pipeline.STAGES) == 5
    toxic = {r.doc_id for r in table(spark, data, "labels").where("toxic = 1").collect()}
    assert not toxic & set(ids(clean)) and set(ids(first)) - set(ids(clean)) >= toxic
    assert len(ids(single)) == len(set(ids(single))) < len(ids(clean))
    assert set(ids(unseen)) < set(ids(single))
    assert max(np.unique(ids(mixed), return_counts=True)[1]) <= 2


def test_run_matches_brute_force_of_the_last_stage(stages, spark, data):
    mixed = [(r.doc_id, r.text) for r in stages[4].select("doc_id", "text").collect()]
    want = plain_tokens(mixed)
    assert sorted(map(tuple, stages[5].collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, data, name):
    if name in ORACLES:
        from compare import compared, duck

        assert compared(QUERIES[name](spark, data).toArrow(), duck(data).execute(ORACLES[name]).to_arrow_table()) == ""
    else:
        assert QUERIES[name](spark, data).count() > 0


def test_stages_with_odd_rows_and_clashing_columns(spark, data):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "one two three", "en", None, 13), (2, "one two three", "en", None, 13), (3, "word " * 30_000, "fr", "a", 150_000), (4, "é ü", None, "b", 3)]
    odd = spark.createDataFrame([(*r, 1.5, "x", [1]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size double, rank string, fp array<int>")
    for d in (odd, odd.limit(0)):
        empty = d is not odd
        for name, stage in corpus_pipeline.STAGES:
            columns = d.columns
            d = written(stage(spark, d, data), f"odd-{name}")
            assert d.columns == columns or name == "token_ids"
            assert (d.count() == 0) == empty
    single = corpus_pipeline.drop_near_duplicates(spark, odd, data)
    # the null and the empty text share a fingerprint: the row that has an id stays
    assert sorted(r.doc_id for r in single.collect()) == [1, 2, 3, 4]
