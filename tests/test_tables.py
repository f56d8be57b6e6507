"""References, registries, pairs, samples, sources on hand-made rows."""

import json

import pytest
from compare import TABLES, compared, duck
from pyspark.sql import functions as F

from citeweave.operators import combine, ordering, pairs, references, registry, sampling
from citeweave.plans import catalog
from citeweave.schema import PAPER_CLEAN
from citeweave.sources import papers as sources
from citeweave.streaming import arrivals


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_reference_validation_golden(spark):
    papers = frame(spark, [("p", 1984.0, ["a", "b", "zz"]), ("q", None, ["b", "b"]), ("r", 1990.0, None), ("s", 1990.0, [])], "id string, year double, references array<string>")
    known = frame(spark, [("a", 1984.0), ("b", 1985.0), ("p", 1984.0)], "id string, year double")
    got = {r.id: r.references for r in references.validate(papers, known).collect()}
    assert got == {"p": ["a"], "q": ["b", "b"], "r": [], "s": []}


def test_gap_fill_golden(spark):
    papers = frame(spark, [(2020, ["k"], "en", [("auth_12345", "John Smith", "MIT")]), (2019, None, "en", [("auth_12345", "J. Smith", None)])], "year int, keywords array<string>, lang string, authors array<struct<id:string,name:string,org:string>>")
    gaps = frame(spark, [("x", 0, 2020, "auth_12345", None, None), ("x", 1, 2020, None, "John Smith", None)], "paper_id string, pos int, year int, author_id string, name string, org string")
    got = [tuple(r) for r in registry.fill_gaps(gaps, registry.author_records(papers)).orderBy("pos").collect()]
    assert got == [("x", 0, 2020, "auth_12345", "John Smith", "MIT"), ("x", 1, 2020, "auth_12345", "John Smith", None)]
    nested = registry.nest_authors(registry.fill_gaps(gaps, registry.author_records(papers))).first().authors
    assert [a.id for a in nested] == ["auth_12345", "auth_12345"]


def test_official_name_ties_by_name(spark):
    records = frame(spark, [("1", "B b"), ("1", "A a"), ("1", "Dr. X"), ("2", None)], "id_or_name string, name string")
    assert [tuple(r) for r in registry.official_names(records).collect()] == [("1", "A a")]


def test_pairs_and_negatives(spark):
    ids = frame(spark, [(f"p{i}",) for i in range(6)], "id string")
    exploded = frame(spark, [("p0", 0, "p1"), ("p0", 1, "p2"), ("p0", 2, "nowhere"), ("p3", 0, "p1")], "id string, pos int, ref_id string")
    positives = pairs.positive_keys(exploded, ids)
    assert positives.count() == 3
    negatives = pairs.negative_keys(positives, ids, 1).collect()
    assert len(negatives) == 3
    for r in negatives:
        assert r.ref_id not in {"p0": {"p0", "p1", "p2"}, "p3": {"p3", "p1"}}[r.article_id]
    again = pairs.negative_keys(positives.repartition(3), ids.repartition(2), 1).collect()
    assert sorted(map(tuple, negatives)) == sorted(map(tuple, again))


def test_negatives_when_few_or_none_are_free(spark):
    ids = frame(spark, [("a",), ("b",), ("c",)], "id string")
    one_free = frame(spark, [("a", 0, "b")], "article_id string, pos int, ref_id string")
    assert [r.ref_id for r in pairs.negative_keys(one_free, ids).collect()] == ["c"]
    none_free = frame(spark, [("a", 0, "b"), ("a", 1, "c")], "article_id string, pos int, ref_id string")
    assert pairs.negative_keys(none_free, ids).count() == 2
    assert pairs.negative_keys(one_free.limit(0), ids).count() == 0


def test_dense_index(spark):
    got, total = ordering.dense_index(frame(spark, [("b",), ("a",), ("c",), ("a",)], "k string"), "k")
    assert total == 3 and {r.k: r.idx for r in got.collect()} == {"a": 0, "b": 1, "c": 2}


def test_quotas_sum_to_target(spark):
    weights = frame(spark, [(1, 0.5), (2, 0.25), (3, 0.25)], "year int, weight double")
    for target in (0, 1, 2, 3, 7, 10):
        got = {r.year: r.quota for r in sampling.papers_per_year(weights, target).collect()}
        assert sum(got.values()) == target
    assert {r.year: r.quota for r in sampling.papers_per_year(weights, 10).collect()} == {1: 5, 2: 2, 3: 3}


def test_chronological_fallback(spark):
    counts = frame(spark, [(y, 1) for y in range(2000, 2040)], "year int, n long")
    parts = sampling.chronological_years(counts, 0.99, 0.995)
    assert parts["test"] == list(range(2030, 2040)) and parts["validation"] == list(range(2020, 2030)) and len(parts["train"]) == 20
    parts = sampling.chronological_years(counts, 0.5, 0.75)
    assert [len(parts[k]) for k in ("train", "validation", "test")] == [20, 10, 10]


def test_balance_edges(spark):
    one = frame(spark, [(1, 0), (2, 0)], "id int, y int")
    assert sampling.balance(one, "y", "over", 1, "id").count() == 2
    rows = frame(spark, [(i, int(i == 0)) for i in range(7)], "id int, y int")
    over = sampling.balance(rows, "y", "over", 1, "id")
    assert {r.y: r["count"] for r in over.groupBy("y").count().collect()} == {0: 6, 1: 6}
    under = sampling.balance(rows, "y", "under", 1, "id")
    assert {r.y: r["count"] for r in under.groupBy("y").count().collect()} == {0: 1, 1: 1}
    with pytest.raises(ValueError):
        sampling.balance(rows, "y", "sideways", 1, "id")
    with pytest.raises(KeyError):
        sampling.balance(rows, "z", "over", 1, "id")
    assert sampling.imbalance(rows, "y", {0: 2, 1: 5}, 1, "id").count() == 3
    assert sampling.imbalance(rows, "y", {0: 2, 1: 5}, 1, "id", allow_oversampling=True).count() == 7


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500)
    a = {r.id for r in sampling.bounded_sample(rows.repartition(7), 20, 3, "id").collect()}
    assert a == {r.id for r in sampling.bounded_sample(rows.coalesce(1), 20, 3, "id").collect()} and len(a) == 20
    assert sampling.bounded_sample(rows, None, 3, "id").count() == 500


def test_feature_join_fans_out_unless_deduplicated(spark):
    key = "article_id string, ref_id string, is_reference_valid int"
    left = frame(spark, [("a", "b", 1, 1.0, 5.0)], key + ", year double, keywords_x double")
    right = frame(spark, [("a", "b", 1, 2.0), ("a", "b", 1, 3.0)], key + ", year double")
    text = frame(spark, [("a", "b", 1, 9.0, "train")], key + ", e double, split string")
    out = combine.join_features(left, right, text)
    assert out.count() == 2 and out.columns == ["article_id", "ref_id", "is_reference_valid", "year", "year_graph", "e"]
    assert combine.join_features(left, right, text, dedup=True).count() == 1


def test_jsonl_conversion(spark, tmp_path):
    lines = [{"id": "1", "year": "2001", "references": ["2"]}, {"id": "2", "year": "1900"}, {"id": "3", "year": "x"}, {"id": "4"}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    sources.convert_jsonl(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"))
    got = {r.bucket: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("bucket").count().collect()}
    assert got == {"2001": 1, "b_1970": 1, "nan": 3}


def test_checkpoint_and_point_read(spark, tmp_path):
    rows = frame(spark, [("1", 1999.0, "3"), ("2", None, "4"), ("3", 2000.0, "x")], "id string, year double, n_pages string")
    rows = rows.withColumn("n_pages", F.col("n_pages").try_cast("double"))
    sources.write_checkpoint(rows, str(tmp_path / "c"), by="year")
    assert [r.id for r in sources.read_year(spark, str(tmp_path / "c"), 1999.0).collect()] == ["1"]
    sources.write_checkpoint(rows, str(tmp_path / "d"), rows_per_file=1)
    assert spark.read.parquet(str(tmp_path / "d")).schema["n_pages"].dataType.typeName() == "double"
    assert sources.file_schema(spark, str(tmp_path / "d")).names == ["id", "year", "n_pages"] and sources.peek(spark, str(tmp_path / "d"), 2).count() == 2


def test_chunk_helpers(spark, tmp_path):
    template = f"file://{tmp_path}/chunk_{{}}"
    for k in range(1, 4):
        spark.range(k).write.parquet(template.format(k))
    assert [sources.read_chunks(spark, template, end=3).count(), sources.read_chunks(spark, template, start=2, end=3).count(), sources.read_chunks(spark, template, parts=[3, 1]).count()] == [6, 5, 4]
    with pytest.raises(ValueError):
        sources.read_chunks(spark, "x_{}")
    with pytest.raises(ValueError):
        sources.chunk_sequence([1], 0)
    assert sources.chunk_sequence([1, 2, 3], 2) == [[1, 2], [3]]
    assert sources.read_parquet(spark, schema=PAPER_CLEAN).count() == 0


def test_strict_and_lax_loading(spark):
    rows = frame(spark, [("1", [" a ", None], "t"), ("2", None, "t"), (None, ["a"], "t"), ("3", [""], "t"), ("4", ["b"], " ")], "id string, references array<string>, title string")
    assert [(r.id, r.references) for r in sources.load_strict(rows).collect()] == [("1", ["a"])]
    assert sources.load_strict(rows, only_filled=False).count() == 2 and sources.load_lax(rows).count() == 5


def test_strict_load_of_odd_documents_is_its_sql(spark, data, tmp_path):
    odd = [(None, "en", "web"), ("", "en", "web"), ("  ", "en", "web"), ("t", None, "web"), ("t", "", "web"), ("t", "en", None), ("t", "en", " "), ("t", "en", "web")]
    rows = [(i, *odd[i // 60 % len(odd)], 100 + i) for i in range(960)]
    rows += [(i, "again", "en", "web", 7) for i in range(0, 960, 3)]  # a repeated id
    for name in TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{data}/{name}.parquet")
    (tmp_path / "documents.parquet").unlink()
    frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "documents.parquet").symlink_to(next((tmp_path / "parts").glob("*.parquet")))
    got = catalog.queries()["s11_strict_load"](spark, str(tmp_path)).toArrow()
    assert got.num_rows and compared(got, duck(tmp_path).execute(catalog.oracles()["s11_strict_load"]).to_arrow_table()) == ""


def test_strict_loading_by_named_cells(spark):
    rows = frame(spark, [("1", ["a"], "t", None), ("2", ["a"], " ", "x"), ("3", ["a"], None, "x")], "id string, references array<string>, title string, lang string")
    assert [r.id for r in sources.load_strict(rows, only_filled=["title"]).collect()] == ["1"]


def test_arrivals_are_cleaned_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": "1", "year": "2001", "venue": "-"}) + "\n")
    go = lambda: arrivals.clean_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 2026).awaitTermination()
    go()
    (tmp_path / "in" / "b.json").write_text(json.dumps({"id": "2", "year": "1500"}) + "\n" + json.dumps({"id": "3", "year": "2002"}) + "\n")
    go()
    got = {(r.id, r.venue) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("1", None), ("3", None)}


def test_quantiles_beyond_what_is_gathered_at_once(spark):
    import numpy as np

    from citeweave.operators.profiling import quantiles

    rng = np.random.default_rng(1)
    a, b = rng.lognormal(0, 3, 3001), np.r_[np.full(2000, 5.0), rng.normal(0, 1, 1001)]
    rows = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)] + [(None, 1.0, None)], "a double, b double, c double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    for at_once in (10_000, 40):
        got = quantiles(rows, ["a", "b", "c"], shares, at_once, bins=16)
        assert got["c"] is None and np.allclose(got["a"], np.quantile(a, shares)) and np.allclose(got["b"], np.quantile(np.r_[b, 1.0], shares))


def test_quantiles_of_many_columns_take_few_passes(spark, monkeypatch):
    """All columns and shares are sought together, also with infinities, NaN (the greatest) and both zeros."""
    import numpy as np

    from citeweave.operators import profiling

    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 6)) * 10.0 ** np.arange(-3, 3)
    x[:50, 1], x[50:90, 1], x[:30, 2], x[:900, 3], x[900:1500, 3] = np.inf, -np.inf, np.nan, 0.0, -0.0
    names = [f"c{i}" for i in range(6)]
    rows = spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in names))
    calls, real = [], profiling._parts
    monkeypatch.setattr(profiling, "_parts", lambda *a: (calls.append(1), real(*a))[1])
    shares = [i / 16 for i in range(17)]
    got = profiling.quantiles(rows, names, shares, at_once=100)
    for i, n in enumerate(names):
        own = np.sort(x[:, i])
        places = [s * 1999 for s in shares]
        want = [own[int(p)] if own[int(p)] == own[min(int(p) + 1, 1999)] or p == int(p) else own[int(p)] + (p - int(p)) * (own[int(p) + 1] - own[int(p)]) for p in places]
        assert np.allclose(got[n], want, equal_nan=True)
    assert len(calls) <= 7


def test_bin_edges_are_those_of_all_rows(spark):
    import numpy as np

    from citeweave.operators.boosting import LeafwiseBoosting

    rows = spark.range(150_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / 7).alias("a"), (F.col("id") % 2).cast("int").alias("is_reference_valid"))
    want = np.quantile([r.a for r in rows.select("a").collect()], [i / 16 for i in range(1, 16)])
    model = LeafwiseBoosting("edges", ["a"], key="id", bins=16)
    assert np.allclose(model.edges(model.preprocess(rows))[0], want, rtol=1e-12)


def test_no_shared_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    from citeweave.session import shared_path

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_path(session, "x")


def test_library_works_without_the_optional_part(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/citeweave", tmp_path / "citeweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=True)


def test_lines_of_a_task_are_bounded(spark, data, monkeypatch):
    """What follows the join by paper works on some LINES lines a task, whatever adaptive execution would put together."""
    from citeweave.plans import fixtures

    before = fixtures.Inputs(spark, data).authorship
    monkeypatch.setattr(fixtures, "LINES", 500, raising=False)
    rows = fixtures.Inputs(spark, data).authorship
    most = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 1000 and rows.exceptAll(before).count() == 0 == before.exceptAll(rows).count()
