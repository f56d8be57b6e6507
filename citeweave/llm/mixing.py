"""Mixing sources to target weights by Pareto order sampling.

A source's target, over the size of its documents, is the number of copies that a document of it is expected to have.
The whole part is certain: each document gets that many copies. The fraction p is an inclusion probability: with
U = u / (1 - u), the odds of a keyed uniform number of the document, and P = p / (1 - p), its inclusion odds, documents
are ranked by U / P, and the first ones of each source are taken until their words come nearest to what the certain
copies leave of the target (a fixed size in words). With ``weight_col`` documents of a source get expected copies in
proportion to their weights (at most ``cap``), so their inclusion odds differ; without it they differ between sources.

A source may hold any share of all rows: its cut is found from sums over bins of the rank (combined before the
shuffle), then over finer bins inside the bin of the cut, and only the rows of one fine bin (a millionth of a source)
are ever put in order. The decision for a document is a comparison with its source's cut; texts are never shuffled.

Edge cases: a null text has size 0, a null source is a source of its own, last in the order; rows that repeat an id
share a rank and are taken or left together; a source of size 0 has target 0 and nothing is taken; an empty table
gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import n_words, written

WEIGHTS, SHARE, CAP, BINS = (5, 2, 1), 1.5, 2.0, 1024


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_source, source_size, target) from (_source, source_size): weights in order of the source, capped and reshared.

    Sources run full in the order of limit / weight. With the k - 1 first ones full, the rest would share what is left
    by weight; the first source whose part stays within its limit ends the full ones.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weighed = sizes.withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    weighed = weighed.withColumn("limit", F.lit(cap) * F.col("source_size"))
    fill = Window.orderBy(F.col("limit") / F.col("w"), F.col("_source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = weighed.withColumn("left", F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("open", F.sum("w").over(after))
    level = filled.withColumn("level", F.col("left") / F.col("open")).withColumn("full", F.col("level") * F.col("w") > F.col("limit"))
    level = level.withColumn("final", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("w"), "level"))).over(whole)["level"])
    share_ = F.col("final") * F.col("w")
    return level.select("_source", "source_size", F.when(F.col("final").isNull() | F.col("full") | (share_ > F.col("limit")), F.col("limit")).otherwise(share_).alias("target"))


def _uniform(key, seed: str):
    """A keyed uniform number in (0, 1): 48 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, weight_col: str | None = None, seed: str = "mix", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The documents' narrow table (_id, _source, size, weight, rank) and the sources' table with the cuts."""
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("size"), (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("_w"))
    narrow = written(narrow, "sizes")
    sources = targets(narrow.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    sources = sources.withColumn("per_weight", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    if weight_col:
        sources = _solved(narrow, written(sources, "sources"), cap)
    sources = written(sources, "sources")
    ranked = rank(narrow, sources, cap, seed)
    certain = ranked.groupBy("_source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    left = sources.join(certain, sources["_source"].eqNullSafe(certain["_source"]), "left").select(sources["_source"], (F.col("target") - F.coalesce("certain", F.lit(0))).alias("left"))
    left = written(left, "left")
    at, cut = None, None
    for level in (1, 2):
        fine = F.floor(F.col("rank") * F.lit(float(BINS**level))).cast("long")
        rows = ranked.where("p > 0").withColumn("bin", fine)
        if at is not None:
            rows = _with(rows, at).where(F.floor(F.col("bin") / F.lit(BINS)) == F.col("cut_bin")).drop("cut_bin", "left")
        sums = rows.groupBy("_source", "bin").agg(F.sum("size").alias("words"))
        sums = _with(sums, left if at is None else at)
        run = Window.partitionBy("_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        # the last bin that begins within what is left holds the cut
        inside = sums.where(F.col("before") <= F.col("left")).groupBy("_source").agg(F.max(F.struct("bin", "before")).alias("b"), F.first("left").alias("left"))
        at = written(inside.select("_source", F.col("b.bin").alias("cut_bin"), (F.col("left") - F.col("b.before")).alias("left")), "bins")
    last = _with(ranked.where("p > 0").withColumn("bin", F.floor(F.col("rank") * F.lit(float(BINS**2))).cast("long")), at).where("bin = cut_bin")
    ties = last.groupBy("_source", "left", "cut_bin", "rank", _tie().alias("tie")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("_source").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    # ids whose middle lies within what is left bring the sum nearer; without any the cut is the bin's lower edge
    edge = F.struct((F.col("cut_bin") / F.lit(float(BINS**2))).alias("rank"), F.lit(-(1 << 63)).cast("long").alias("tie"))
    inside = F.when(F.col("before") + F.col("words") / 2 <= F.col("left"), F.struct("rank", "tie"))
    cut = ties.groupBy("_source").agg(F.coalesce(F.max(inside), F.max(edge)).alias("cut"))
    cuts = sources.join(cut, sources["_source"].eqNullSafe(cut["_source"]), "left").drop(cut["_source"])
    return ranked, written(cuts, "cuts")


def _tie() -> F.Column:
    """Tells ids of equal rank apart."""
    return F.xxhash64("_id")


def _with(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Inner join on the source, nulls equal; ``small`` has one row for each source."""
    other = small.withColumnRenamed("_source", "_other")
    return rows.join(other, rows["_source"].eqNullSafe(other["_other"])).drop("_other")


def _solved(narrow: DataFrame, sources: DataFrame, cap: float, rounds: int = 30) -> DataFrame:
    """``per_weight`` such that min(cap, per_weight * weight) copies of all documents have the target's size."""
    for _ in range(rounds):
        joined = _with(narrow, sources.select("_source", "per_weight"))
        full = F.col("per_weight") * F.col("_w") >= cap
        sums = joined.groupBy("_source").agg(F.sum(F.when(full, cap * F.col("size")).otherwise(0.0)).alias("full"), F.sum(F.when(~full, F.col("_w") * F.col("size")).otherwise(0.0)).alias("open"))
        new = F.when(F.col("open") > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("full")) / F.col("open")).otherwise(F.col("per_weight"))
        after = written(_with(sources, sums).withColumn("moved", F.abs(new - F.col("per_weight"))).withColumn("per_weight", F.greatest("per_weight", new)).drop("full", "open"), "sources")
        moved = after.agg(F.max("moved")).first()[0] or 0.0
        sources = after.drop("moved")
        if moved < 1e-9:
            break
    return sources


def rank(rows: DataFrame, sources: DataFrame, cap: float, seed: str) -> DataFrame:
    """Adds whole (certain copies), p (inclusion probability) and rank in [0, 1): Q / (1 + Q) of the Pareto ratio Q."""
    copies = F.least(F.lit(cap), F.col("per_weight") * F.col("_w"))
    out = _with(rows, sources.select("_source", "per_weight")).withColumn("copies", copies)
    out = out.withColumn("whole", F.floor("copies").cast("long")).withColumn("p", F.col("copies") - F.floor("copies"))
    u = _uniform(F.col("_id"), seed)
    ratio = (F.col("p") / (1 - F.col("p"))) * (1 / u - 1)  # 1 / Q
    return out.withColumn("rank", F.when(F.col("p") > 0, 1 / (1 + ratio))).drop("per_weight", "copies")


def _taken():
    """Copies taken of a row that has its source's cut."""
    extra = F.struct(F.col("rank"), _tie().alias("tie")) <= F.col("cut")
    return F.col("whole") + F.coalesce((F.col("p") > 0) & extra, F.lit(False)).cast("long")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: id, source, size, its source's size and target, the copies and words taken of it."""
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    ranked, cuts = plan(docs, **options)
    rows = _with(ranked, cuts).withColumn("n", _taken())
    return rows.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", F.col("n").alias("copies"), (F.col("n") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns, texts unshuffled."""
    cap, seed = options.get("cap", CAP), options.get("seed", "mix")
    id_col, source_col, weight_col = options.get("id_col", "doc_id"), options.get("source_col", "source"), options.get("weight_col")
    _, cuts = plan(docs, **options)
    columns = docs.columns
    own = docs.select(F.struct(*columns).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("_w"))
    rows = _with(rank(own, cuts, cap, seed), cuts.select("_source", "cut")).withColumn("n", _taken()).where("n > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("_row.*")
