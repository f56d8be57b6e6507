"""Joining feature sets on the pair key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.cleaning import drop_prefixed
from citeweave.schema import PAIR_KEY


def join_features(normal: DataFrame, graph: DataFrame, textual: DataFrame, dedup: bool = False) -> DataFrame:
    """normal left join graph left join textual on (article_id, ref_id, is_reference_valid).

    Repeated keys fan out as joins do, unless ``dedup`` keeps one row for each on the right. Columns that clash get the
    suffix of their table; hashed keywords and split labels aren't features.
    """
    out = drop_prefixed(normal, "keywords_").drop("split")
    for name, table in (("graph", graph), ("text", textual)):
        table = table.drop("split")
        table = table.dropDuplicates(list(PAIR_KEY)) if dedup else table
        clash = {c: f"{c}_{name}" for c in table.columns if c in out.columns and c not in PAIR_KEY}
        out = out.join(table.withColumnsRenamed(clash), list(PAIR_KEY), "left")
    return out.withColumn("is_reference_valid", F.col("is_reference_valid").cast("int"))
