"""Saved models of every kind with what belongs to them: scores, tuning results, features, one manifest.

An artifact is a folder ``name_time``: the model in its own format, tables beside it, and a manifest of one JSON line. The
manifest is written last, so a folder without one is unfinished and never loaded. A manifest of an unknown kind fails.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from citeweave.operators import models
from citeweave.operators.attention import Attention
from citeweave.operators.boosting import LeafwiseBoosting
from citeweave.sources.papers import write_metadata

KINDS = {k.__name__: k for k in (models.BoostedTrees, models.Forest, models.Logistic, models.Perceptron, LeafwiseBoosting, Attention)}


def _settings(model) -> dict:
    """What the model's class needs to be made again."""
    if isinstance(model, Attention):
        return {"tokens": model.tokens, "size": model.size, "heads": model.heads, "rate": model.rate, "decay": model.decay, "batch": model.batch, "seed": model.seed, **model.shape}
    own = {"features": model.features, **model.params}
    return own | ({"key": model.key, "edge_rows": model.edge_rows, "seed": model.seed} if isinstance(model, LeafwiseBoosting) else {})


def save(model, path: str, metrics: DataFrame | None = None, tuning: Sequence[tuple[dict, float]] = (), **about) -> str:
    """Write a fitted model and what is known of it under a new folder of ``path``; its place."""
    kind = type(model).__name__
    if KINDS.get(kind) is not type(model):
        raise ValueError(f"unknown kind {kind}")
    spark = SparkSession.active()
    if isinstance(model, Attention):
        at = f"{path}/{model.name}_{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
        model.save_into(at)
    else:
        at = model.save(path)
    if metrics is not None:
        metrics.coalesce(1).write.parquet(f"{at}/metrics")
    if tuning:
        spark.createDataFrame([(json.dumps(p, sort_keys=True), float(s)) for p, s in tuning], "params string, score double").coalesce(1).write.parquet(f"{at}/tuning")
    write_metadata(spark, f"{at}/manifest", {"kind": kind, "name": model.name, "label": model.label, "settings": _settings(model), "metrics": metrics is not None, "tuning": bool(tuning), "about": about})
    return at


def manifest(spark: SparkSession, at: str) -> dict:
    return json.loads(spark.read.text(f"{at}/manifest").first()["value"])


def load(spark: SparkSession, at: str):
    """The model of an artifact, ready to predict."""
    known = manifest(spark, at)
    if known["kind"] not in KINDS:
        raise ValueError(f"unknown kind {known['kind']}")
    settings = dict(known["settings"])
    first = settings.pop("tokens" if known["kind"] == "Attention" else "features")
    if "hidden" in settings and known["kind"] == "Perceptron":
        settings["hidden"] = tuple(settings["hidden"])
    model = KINDS[known["kind"]](known["name"], first, label=known["label"], **settings)
    return model.load_from(at) if isinstance(model, Attention) else model.load(at)


def table(spark: SparkSession, at: str, name: str) -> DataFrame | None:
    """The artifact's ``metrics`` or ``tuning`` table; None if it has none."""
    return spark.read.parquet(f"{at}/{name}") if manifest(spark, at)[name] else None


def finished(spark: SparkSession, path: str) -> list[str]:
    """Places of all finished artifacts under ``path``, the oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    places = [s.getPath() for s in files.listStatus(root)]
    done = [p.toString() for p in places if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p.toString()}/manifest/_SUCCESS"))]
    return sorted(done, key=lambda p: p.rsplit("_", 1)[-1])


def latest(spark: SparkSession, path: str, name: str):
    """The newest finished model of a name; None if there is none."""
    own = [p for p in finished(spark, path) if p.rsplit("/", 1)[-1].rsplit("_", 1)[0] == name]
    return load(spark, own[-1]) if own else None
