"""SimHash near-duplicates by anchor points of a covering code.

The 64 bits are cut into blocks. Two fingerprints at distance 4 or less differ in at most ``within`` bits in one block at
least. In each block the anchors are the words of a code: a Hamming code on the first bits, all values on the rest. Its
covering radius is 1, so each block value has one nearest anchor within 1, and any value within ``within`` of it lies
within 1 + ``within`` of that anchor. A fingerprint therefore goes to its nearest anchor (as ``near``) and to every anchor
within that covering radius plus threshold; linked pairs meet at the nearest anchor of one of them. No
pair within the distance is missed and none is found twice: a pair counts only in its first block within ``within``,
at the nearest anchor of the smaller fingerprint.

Two layouts give the same links. Three blocks of 21 or 22 bits (``within`` 1) make 45 rows or so for each of N
fingerprints and about N^2 / 3,000 comparisons; two blocks of 32 bits (``within`` 2) make 343 rows and N^2 / 390,000. The second is
taken from WIDE_FROM distinct fingerprints on.

Equal fingerprints are one node, so copies never multiply pairs. What leaves an anchor is a spanning forest of its
links, never all pairs. An anchor that holds more than ``split_at`` fingerprints is compared in tiles of its pairs
(each near row once, against each slice of the others), so that no anchor has to fit in one task.

Edge cases: a null or empty text has fingerprint zero, which links like any other; texts are read whole whatever
their length; equal rows share node and component; ids that are null never become a component id unless a component
has no other; an empty table gives an empty result; only the id and text columns are read, so other columns can't
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import pieces, written

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MAX_BITS, WIDE_FROM = 4, 16_000_000
_PAIRS = 1 << 21


class Layout(NamedTuple):
    """Blocks as (first bit, bits); the first ``code`` bits of a block carry the Hamming code; linked pairs are ``within`` bits in one block."""

    blocks: tuple[tuple[int, int], ...]
    code: int
    within: int


NARROW, WIDE = Layout(((0, 21), (21, 21), (42, 22)), 15, 1), Layout(((0, 32), (32, 32)), 31, 2)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 ``text``: XXH64 of its word shingles, repeats included."""
    words = text.translate(_LOWER).split()  # bytes.split() takes exactly \x20 and \x09-\x0D as white space
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``fp`` (the fingerprint's bits as a signed long) and the columns of ``keep``; one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 2 << 20):
            texts = batch.column(batch.schema.get_field_index("_text")).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, batch.num_rows)
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found.view(np.int64))], [*(n for n in batch.schema.names if n != "_text"), "fp"])

    source = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("_text"))
    schema = source.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema
    return source.mapInArrow(run, schema)


def _syndromes(values: np.ndarray, code: int) -> np.ndarray:
    """Hamming syndromes of the low ``code`` bits: the xor of the positions (from 1) of the set bits."""
    out = np.zeros(len(values), np.int64)
    for bit in range(code):
        out ^= np.where((values >> bit) & 1, bit + 1, 0)
    return out


def _patterns(bits: int, layout: Layout) -> list[np.ndarray]:
    """For each syndrome: the error patterns of weight up to 1 + ``within`` on ``bits`` bits that lead to an anchor; the nearest's first."""
    values = np.array([sum(1 << i for i in c) for n in range(layout.within + 2) for c in combinations(range(bits), n)], np.int64)
    syndromes = _syndromes(values, layout.code)
    out = []
    for s in range(layout.code + 1):
        own = values[syndromes == s]
        out.append(own[np.argsort(np.bitwise_count(own), kind="stable")])
    return out


def replicas(batches: Iterator[pa.RecordBatch], layout: Layout = NARROW) -> Iterator[pa.RecordBatch]:
    """Each fingerprint at each anchor within reach in each block; ``near`` marks its nearest anchor of the block."""
    tables = [_patterns(bits, layout) for _, bits in layout.blocks]
    for whole in batches:
        for at in range(0, whole.num_rows, 1 << 15):
            fp = whole.slice(at, 1 << 15).column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for block, (first, bits) in enumerate(layout.blocks):
                values = ((fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                syndromes = _syndromes(values, layout.code)
                for s, errors in enumerate(tables[block]):
                    own = np.flatnonzero(syndromes == s)
                    if len(own) == 0:
                        continue
                    anchors = (values[own, None] ^ errors[None, :]) | (block << 32)
                    near = np.zeros(anchors.shape, bool)
                    near[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(anchors.ravel()), pa.array(np.repeat(fp[own], len(errors))), pa.array(near.ravel())], ["anchor", "fp", "near"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, for links a-b of nodes 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        if np.array_equal(label, before):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _forest(first: np.ndarray, block: np.ndarray, fp: np.ndarray, near: np.ndarray, layout: Layout) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forests of the links in groups of rows; ``first`` marks a group's first row, ``block`` is its block."""
    bounds = np.flatnonzero(np.r_[first, True])
    group = np.cumsum(first) - 1
    x = np.flatnonzero(near)
    starts, sizes = bounds[group[x]], np.diff(bounds)[group[x]]
    total = np.cumsum(sizes)
    bits = fp.view(np.uint64)
    masks = np.array([((1 << n) - 1) << f for f, n in layout.blocks], np.uint64)
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS)))
        size = sizes[at:to]
        xi = np.repeat(x[at:to], size)
        yj = np.arange(len(xi)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[at:to], size)
        differ = bits[xi] ^ bits[yj]
        linked = np.flatnonzero((np.bitwise_count(differ) <= MAX_BITS) & (fp[xi] < fp[yj]))
        xi, yj, differ = xi[linked], yj[linked], differ[linked]
        if len(xi):
            close = np.stack([np.bitwise_count(differ & m) <= layout.within for m in masks], axis=1)
            here = close.argmax(axis=1) == block[xi]
            xi, yj = xi[here], yj[here]
        if len(xi):
            nodes, index = np.unique(np.concatenate([fp[xi], fp[yj]]), return_inverse=True)
            roots = _roots(len(nodes), index[: len(xi)], index[len(xi) :])
            child = np.flatnonzero(roots != np.arange(len(nodes)))
            yield nodes[roots[child]], nodes[child]
        at = to


def compare(batches: Iterator[pa.RecordBatch], layout: Layout = NARROW) -> Iterator[pa.RecordBatch]:
    """Links (lo, hi) of the rows of a partition that is sorted by anchor and tile."""
    kept: list[pa.RecordBatch] = []

    def flush(rows: list[pa.RecordBatch], last: bool) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
        whole = pa.Table.from_batches(rows).combine_chunks()
        anchor, tile, fp = (whole[c].to_numpy() for c in ("anchor", "tile", "fp"))
        near = whole["near"].to_numpy(zero_copy_only=False)
        first = np.r_[True, (anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])]
        cut = len(fp) if last else int(np.flatnonzero(first)[-1])  # the last group may go on in the next batch
        out = [pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"]) for lo, hi in (_forest(first[:cut], anchor[:cut] >> 32, fp[:cut], near[:cut], layout) if cut else ())]
        return out, whole.slice(cut).to_batches() if cut < len(fp) else []

    size = 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            size += batch.num_rows
        if size >= 1 << 18:
            out, kept = flush(kept, False)
            size = sum(b.num_rows for b in kept)
            yield from out
    if kept:
        yield from flush(kept, True)[0]


def links(nodes: DataFrame, split_at: int = 50_000, layout: Layout | None = None) -> DataFrame:
    """Spanning links (lo, hi) between the distinct fingerprints of ``nodes`` (column fp) at distance 4 or less."""
    layout = layout or (WIDE if nodes.count() >= WIDE_FROM else NARROW)
    blocks, code, within = layout

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return replicas(batches, Layout(blocks, code, within))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return compare(batches, Layout(blocks, code, within))

    copies = nodes.select("fp").mapInArrow(replicated, "anchor long, fp long, near boolean")
    counts = copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > split_at)
    # anchors beyond split_at, written so that the planner knows how few they are
    heavy = written(counts.select("anchor", F.ceil(F.col("rows") / split_at).cast("int").alias("tiles")), "heavy-anchors")
    dealt = copies.join(heavy, "anchor", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    # tile (i, j): the near rows of slice i against the rows of slice j
    as_near = dealt.where("near").withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: own * F.col("tiles") + j)))
    as_other = dealt.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: i * F.col("tiles") + own)))
    tiled = as_near.where("tiles > 1").unionByName(as_other.where("tiles > 1").withColumn("near", F.lit(False))).unionByName(dealt.where("tiles = 1").withColumn("tile", F.lit(0)))
    return tiled.select("anchor", "tile", "fp", "near").repartition("anchor", "tile").sortWithinPartitions("anchor", "tile").mapInArrow(compared, "lo long, hi long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large-star and small-star rounds.

    Each round is a grouped minimum (combined before the shuffle) and a join that Spark may split where a node has
    very many links; each is written to the shared folder. Only a count and a checksum reach the driver.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())

    edges = written(edges.where("lo < hi").distinct(), "links")
    before = state(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        rows = small.select(F.col("m").alias("lo"), "hi").union(small.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
        edges = written(rows.where("lo < hi").distinct(), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def near_duplicates(prints: DataFrame, split_at: int = 50_000, layout: Layout | None = None) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``prints`` (id, fp): its component's smallest fingerprint and id."""
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(links(nodes, split_at, layout))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.where("root <> fp").groupBy("root").agg(F.min("first").alias("least"))
    # a root's own id joins the minimum of its other members
    lead = nodes.join(least, nodes["fp"] == least["root"], "inner").select("root", F.least("first", "least").alias("lead"))
    return rooted.join(lead, "root", "left").select("fp", "root", F.coalesce("lead", "first").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without their near-duplicates: of each component, the row of the smallest id stays.

    Rows are numbered as they are written once, so rows that repeat an id are told apart.
    """
    columns = docs.columns
    rows = written(docs.select(F.struct(*columns).alias("row"), F.monotonically_increasing_id().alias("rid")), "rows")
    texts = rows.select("rid", F.col("row")[id_col].alias("_cw_id"), F.col("row")[text_col].alias("_cw_text"))
    prints = written(fingerprints(texts, "_cw_id", "_cw_text", keep=("rid",)), "fingerprints")
    found = prints.join(near_duplicates(prints), "fp")
    first = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "rid"))
    # one row for each component; ids may repeat between components, their roots don't
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.rid").alias("rid"))
    return rows.join(written(kept, "kept"), "rid", "left_semi").select("row.*")
