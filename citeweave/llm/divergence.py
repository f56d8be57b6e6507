"""Source divergence audit: how far the term shares of a language's sources lie apart, in whole numbers.

Terms are runs of letters (any character beyond ASCII counts as one), A-Z lower-cased. A language keeps the terms that
``min_docs`` of its documents have. A (language, source) group, and a language as a whole, gives a kept term with count c
the share p = 1 + floor(10^9 (c + 2) / (N + 2 V)); the distance of two shares is floor((p - q)^2 / (p + q)).

Two-dimensional group-block tiling: a language's groups are dealt to blocks, its vocabulary to chunks. Each group has one
packed count vector for each chunk; it is replicated to the tiles (block, block) that need it, so each of the tiles meets
two blocks of vectors and no pair of groups is ever a row before its sum. A tile's rows are sorted by chunk: a task holds
two blocks of one chunk at a time, adds that chunk's pair submatrix, and goes on with the next. Runs of ``span`` chunks
are tiles of their own whose sums are added, so neither a large language nor a large vocabulary ends in one task.

Texts are counted where they are read: a task keeps counts by (language, source, term) in dictionaries of a bounded size
and hands on partial sums, which are combined again before the shuffle. Nothing is collected to the driver.

Arithmetic is exact while N + 2 V stays below 9 * 10^15.

Edge cases: null or empty text, lang and source are empty strings, and such a document still makes its group; a row is a
document, ids aren't read; a language without kept terms has pairs of value 0 and no terms; a language with one source has
no pairs; ties go by the item's UTF-8 bytes; texts are read whole; an empty table gives an empty result. Only the three
columns are read, so others can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import pieces, written

SCALE = 1_000_000_000
_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of UTF-8 to bytes of terms: capitals of ASCII are lower-cased, what is no letter is a space.
_TERMS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _LETTERS else 0x20 for b in range(256))


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = 400_000) -> DataFrame:
    """Partial sums (lang, source, term, n, docs); ``held`` terms at most (or one text's) are kept before they are handed on.

    A row with a null term counts the group's documents.
    """
    table = _TERMS

    def flush(n: dict, docs_: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in n.items():
            seen, terms = docs_[lang, source], list(own)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([own[t] for t in part], pa.int64()), pa.array([seen[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = {}
        seen: dict = {}
        size = 0
        for batch in pieces(batches, "text", 4 << 20):
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                words = (text.as_py() or b"").translate(table).split()
                key = (lang, source)
                if key not in n:
                    n[key], seen[key] = Counter(), Counter()
                size -= len(n[key])
                n[key].update(words)
                seen[key].update(set(words))
                seen[key][None] += 1
                n[key][None] += 0
                size += len(n[key])
                if size > held:
                    yield from flush(n, seen)
                    n, seen, size = {}, {}, 0
        yield from flush(n, seen)

    read = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: str, total: str):
    """p of a count, in decimals, as the product may pass a long."""
    return F.expr(f"1 + CAST((CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(19,0))) div CAST({total} AS DECIMAL(19,0)) AS LONG)")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """p of an array of counts: the product with 10^9 is divided in three steps of 10^3, so that none passes 64 bits."""
    rest, whole = counts + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // total
        rest = rest % total
    return whole + 1


def tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) with a < b, for rows sorted by tile (lang, low, high, span), chunk and source.

    A row is (lang, low, high, span, chunk, size, source, block, total, items): a group's counts in one chunk of a tile.
    """
    tile, sources, blocks, sums = None, [], None, None
    chunk: list[tuple] = []

    def add() -> None:
        nonlocal sources, blocks, sums
        size = chunk[0][0]
        if sums is None:
            sources, blocks = [c[1] for c in chunk], np.array([c[2] for c in chunk])
            sums = np.zeros((len(chunk), len(chunk)), np.int64)
        if size == 0:
            return
        p = np.empty((len(chunk), size), np.int64)
        for i, (_, _, _, total, at, n) in enumerate(chunk):
            counts = np.zeros(size, np.int64)
            counts[at] = n
            p[i] = shares(counts, total)
        low, high = tile[1], tile[2]
        for i in np.flatnonzero(blocks == low):
            others = np.flatnonzero(blocks == high)
            others = others[others > i] if low == high else others
            apart = p[i] - p[others]
            sums[i, others] += (apart * apart // (p[i] + p[others])).sum(axis=1)

    def done() -> Iterator[pa.RecordBatch]:
        low, high = tile[1], tile[2]
        rows = [(tile[0], *sorted((sources[i], sources[j]), key=lambda s: s.encode()), int(sums[i, j])) for i in np.flatnonzero(blocks == low) for j in np.flatnonzero(blocks == high) if low != high or j > i]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "a", "b", "value"])

    now = None
    for batch in batches:
        lists = batch.column(9)
        offsets, flat = lists.offsets.to_numpy(), lists.values
        at, n = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(9))))
        for r, (lang, low, high, span, c, size, source, block, total) in enumerate(keys):
            if now != (lang, low, high, span, c):
                if chunk:
                    add()
                    chunk = []
                if tile != (lang, low, high, span):
                    if tile is not None:
                        yield from done()
                    tile, sums = (lang, low, high, span), None
                now = (lang, low, high, span, c)
            own = slice(offsets[r], offsets[r + 1])
            chunk.append((size, source, block, total, at[own].copy(), n[own].copy()))
    if chunk:
        add()
        yield from done()


def vocabulary(counts: DataFrame, min_docs: int = 10, chunk: int = 2048) -> DataFrame:
    """(lang, term, total, chunk, at) of the kept terms: their chunk and their place in it."""
    kept = written(counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    # a row a language, written so that the planner sees how small it is and leaves the terms where they are
    sizes = written(kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks")), "chunks")
    dealt = kept.join(sizes, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).drop("chunks")
    return dealt.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, block: int = 16, chunk: int = 2048, span: int = 32, **columns) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources, and the source's own terms.

    Part ``pair`` ranks every other source by the distance summed over all kept terms; part ``term`` has the ``top`` kept
    terms whose share is above the language's, by distance. ``block`` groups and ``chunk`` terms are the sides of a
    packed block, about; ``span`` chunks of a tile are summed by one task.
    """
    counts = written(counted(docs, **columns).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = written(vocabulary(counts, min_docs, chunk), "vocabulary")
    used = written(counts.where(F.col("term").isNotNull()).select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_count"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    groups = groups.join(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")), "lang").join(langs, "lang", "left")
    groups = groups.join(used.groupBy("lang", "source").agg(F.sum("n").alias("count")), ["lang", "source"], "left").na.fill(0, ["terms", "lang_count", "count"])
    groups = written(groups.select("lang", "source", F.pmod(F.xxhash64("source"), F.ceil(F.col("groups") / block)).cast("int").alias("block"), F.ceil(F.col("groups") / block).cast("int").alias("blocks"), "terms", (F.col("count") + 2 * F.col("terms")).alias("total"), (F.col("lang_count") + 2 * F.col("terms")).alias("lang_total")), "groups")

    # every group has a row for every chunk of its language, as terms it lacks have shares too
    last = F.greatest(F.ceil(F.col("terms") / chunk).cast("int"), F.lit(1)) - 1
    roster = groups.select("lang", "source", "block", "blocks", "total", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    sizes = kept.groupBy("lang", "chunk").agg(F.count(F.lit(1)).cast("int").alias("size"))
    packed = used.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("items"))
    vectors = roster.join(sizes, ["lang", "chunk"], "left").join(packed, ["lang", "source", "chunk"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = vectors.withColumn("other", other).select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.floor(F.col("chunk") / span).cast("int").alias("span"), "chunk", F.coalesce("size", F.lit(0)).alias("size"), "source", "block", "total", F.coalesce("items", F.array().cast("array<struct<at:int,n:bigint>>")).alias("items"))
    tile = ["lang", "low", "high", "span"]
    sums = written(tiles.repartition(*tile).sortWithinPartitions(*tile, "chunk", "source").mapInArrow(tile_sums, "lang string, a string, b string, value long"), "tile-sums")
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    p = used.join(groups.select("lang", "source", F.col("total").alias("group_total"), "lang_total"), ["lang", "source"])
    p = p.select("lang", "source", "term", _share("n", "group_total").alias("p"), _share("total", "lang_total").alias("q")).where("p > q")
    terms = p.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
