"""Batches for a trainer: every row once an epoch, the same order again, padded shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.sources import batches

SHAPES = {"ids": (4, "int"), "weights": (2, "float"), "label": (0, "double")}


def test_every_row_once_an_epoch_in_a_keyed_order(spark, tmp_path):
    rows = spark.range(103).select("id", F.transform(F.sequence(F.lit(1), (F.col("id") % 6 + 1).cast("int")), lambda x: x + F.col("id")).alias("ids"), F.when(F.col("id") % 3 > 0, F.array(F.lit(0.5), F.lit(None).cast("double"))).alias("weights"), F.when(F.col("id") != 5, F.col("id") % 2).alias("label"), F.lit("x").alias("shard_"))
    for n, parts in (("a", 3), ("b", 7)):
        index = batches.write_shards(rows.repartition(parts), f"file://{tmp_path}/{n}", "id", SHAPES, shard_rows=20)
        assert {r.shard: r.rows for r in index.collect()} == {0: 20, 1: 20, 2: 20, 3: 20, 4: 20, 5: 3}
    orders = []
    for place, number in (("a", 0), ("b", 0), ("a", 1)):
        got = batches.epoch(spark, f"file://{tmp_path}/{place}", "id", number, 16)
        orders.append([r.id for r in got.orderBy("batch", "place").collect()])
        assert sorted(orders[-1]) == list(range(103)) and [r.n for r in got.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [16] * 6 + [7]
    assert orders[0] == orders[1] != orders[2] and orders[0] != sorted(orders[0])
    read = list(batches.tensors(batches.packed(batches.epoch(spark, f"file://{tmp_path}/a", "id", 0, 16), 16, SHAPES), 16, SHAPES))
    assert [t["batch"] for t in read] == list(range(7)) and [t["real"] for t in read] == [16] * 6 + [7]
    for b, t in enumerate(read):
        assert t["ids"].shape == (16, 4) and t["weights"].shape == (16, 2) and t["label"].shape == (16,) and t["weights"].dtype == np.float32
        for place, i in enumerate(orders[0][b * 16 : b * 16 + 16]):
            want = [k + 1 + i for k in range(i % 6 + 1)][:4]
            assert t["ids"][place].tolist() == want + [0] * (4 - len(want)) and t["weights"][place].tolist() == ([0.5, 0.0] if i % 3 else [0.0, 0.0])
            assert t["label"][place] == (0 if i == 5 else i % 2)
    assert not read[-1]["ids"][7:].any()
    empty = batches.write_shards(rows.limit(0), f"file://{tmp_path}/none", "id", SHAPES)
    assert empty.count() == 0 and batches.epoch(spark, f"file://{tmp_path}/none", "id", 0, 8).count() == 0


def test_pairs_of_texts_fit_their_places(spark):
    tokenizers = pytest.importorskip("tokenizers")
    files = pytest.importorskip("public_tokenizers")
    at = str(files.path("word_bpe_49k.json"))
    plain = tokenizers.Tokenizer.from_file(at)
    texts = [("one two three", "four"), ("a " * 50, "b " * 50), ("a " * 50, "b"), (None, "b " * 50), (None, None), ("", "x")]
    rows = spark.createDataFrame([(i, *t, i % 2) for i, t in enumerate(texts)], "id int, l string, r string, label int")
    for r in batches.tokenized_pairs(rows, "l", "r", at, 16, 49406, 49407, ("id", "label")).collect():
        a, b = ([*plain.encode(x or "", add_special_tokens=False).ids] for x in texts[r.id])
        while len(a) + len(b) > 13:
            (a if len(a) > len(b) else b).pop()
        own = [49406, *a, 49407, *b, 49407]
        assert r.ids == own + [0] * (16 - len(own)) and r.mask == [1] * len(own) + [0] * (16 - len(own))
    with pytest.raises(ValueError):
        batches.tokenized_pairs(rows, "l", "r", at, 2)
