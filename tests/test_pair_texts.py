"""Text features of pairs against plain NumPy, the incremental step, and imports without the optional parts."""

import os
import shutil
import subprocess
import sys
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import cleaning, models, pair_texts, text

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _rows():
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(12)]
    say = lambda: " ".join(rng.choice(words, 9))
    texts = {i: say() for i in range(8)} | {8: None, 9: ""}
    return [("train" if i < 30 else "test", i % 10, i * 3 % 7 + i // 10, 1, texts[i % 10], texts[(i * 7 + 1) % 10]) for i in range(40)]


def test_pair_texts_match_numpy(spark):
    rows = _rows()
    pairs = spark.createDataFrame(rows, "split string, article_id long, ref_id long, is_reference_valid int, vector_text_article string, vector_text_ref string")
    unique = pair_texts.deduplicated(pairs.unionByName(pairs))
    kept = unique.collect()
    assert len(kept) == len({r[:3] for r in rows})
    train = [r for r in kept if r.split == "train"]
    bags = lambda found, c: [Counter((r[c] or "").split()) for r in found]
    both = bags(train, "vector_text_article") + bags(train, "vector_text_ref")
    terms = sorted(set().union(*both))
    idf = np.array([log((1 + len(both)) / (1 + sum(t in b for b in both))) + 1 for t in terms])

    def matrix(found):
        m = np.array([[b[t] for t in terms] for b in found]) * idf
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    fitted = pair_texts.fit(unique.where("split = 'train'"), 3, 100)
    got = {(r.split, r.article_id, r.ref_id): r for r in fitted.embeddings(unique).collect()}
    assert len(got) == len(kept)
    sides = {}
    for name in ("article", "ref"):
        v = np.linalg.svd(matrix(bags(train, f"vector_text_{name}")))[2][:3].T
        v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(3)])
        sides[name] = matrix(bags(kept, f"vector_text_{name}")) @ v
    cosine = (matrix(bags(kept, "vector_text_article")) * matrix(bags(kept, "vector_text_ref"))).sum(axis=1)
    for i, r in enumerate(kept):
        found = got[r.split, r.article_id, r.ref_id]
        assert abs(found.tfidf_similarity - cosine[i]) < 1e-9
        for name in sides:
            assert np.allclose([found[f"{name}_emb_{c:03d}"] for c in range(3)], sides[name][i], atol=1e-5)
    with pytest.raises(ValueError):
        fitted.embeddings(unique.drop("split"))
    assert fitted.similarities(unique.limit(0)).count() == 0


def test_pairs_name_their_texts(spark):
    """Texts in a table of their own give what texts on each pair give, and no pair carries a text."""
    rng = np.random.default_rng(4)
    texts = spark.createDataFrame([(i, " ".join(f"word{j}" for j in rng.choice(12, 9)) if i else None) for i in range(9)], "id long, text string")
    keys = spark.createDataFrame([("train" if i < 25 else "test", i % 9, i * 5 % 7, 1) for i in range(35)], "split string, article_id long, ref_id long, is_reference_valid int").distinct()
    whole = keys
    for side in ("article", "ref"):
        whole = whole.join(texts.select(F.col("id").alias(f"{side}_id"), F.col("text").alias(f"vector_text_{side}")), f"{side}_id")
    order = ["split", "article_id", "ref_id"]
    one = pair_texts.fit(whole.where("split = 'train'"), 3, 100).embeddings(whole).orderBy(*order).collect()
    two = pair_texts.fit(keys.where("split = 'train'"), 3, 100, texts=texts).embeddings(keys, texts=texts).orderBy(*order).collect()
    assert [r[:4] for r in one] == [r[:4] for r in two] and np.allclose([r[4:] for r in one], [r[4:] for r in two], atol=1e-5)


def test_stop_words_by_language(spark):
    rows = spark.createDataFrame([(1, "the cat and its hat")], "id int, text string")
    assert sorted(r.term for r in text.tokens(rows, "id", "text", stop_words="english").collect()) == ["cat", "hat"]


def test_incremental_steps_learn(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    rows = spark.createDataFrame([(float(a), float(b), int(a - b > 0)) for a, b in x] + [(None, 1.0, None)], "a double, b double, y int").repartition(3)
    weights = None
    for _ in range(3):
        weights = models.sgd_step(rows, ["a", "b"], "y", weights)
    right = rows.where("y is not null").where((models.sgd_probability(["a", "b"], weights) > 0.5).cast("int") == rows["y"]).count()
    assert right >= 380 and weights[0] > 0 > weights[1]
    assert models.sgd_step(rows.limit(0), ["a", "b"], "y", weights) == weights
    with pytest.raises(ValueError):
        models.sgd_step(rows, ["a"], "y", weights)


def test_train_and_test_by_name_or_place(spark):
    named = spark.createDataFrame([(1, "Training"), (2, "VAL"), (3, "test"), (4, None)], "id int, split string")
    train, test = cleaning.train_and_test(named, "id")
    assert [r.id for r in train.collect()] == [1] and sorted(r.id for r in test.collect()) == [2, 3]
    train, test = cleaning.train_and_test(named.where("id < 2").unionByName(named.where("id = 4")), "id")
    assert [r.id for r in train.collect()] == [1] and [r.id for r in test.collect()] == [4]


def test_the_rest_imports_without_the_optional_parts(tmp_path):
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=120)
