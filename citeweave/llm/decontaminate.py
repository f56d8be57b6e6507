"""Benchmark decontamination by SimHash of item-sized windows.

For each benchmark item of n words, every window of n words of a document that can match is fingerprinted: a 64-bit
SimHash of its weighted five-word shingles, from running sums over the document. Fingerprints within RADIUS bits of an
item of that length are candidates; the test is by blocks: 64 bits in RADIUS + 1 blocks, of which two fingerprints
within RADIUS share one at least, so an exact look-up of each block misses none. Candidates are then verified by the
exact weighted Jaccard similarity of the shingles (as multisets; a shingle weighs 1 + ln((1 + items) / (1 + items that
have it))), 0.8 or more by default. A text of fewer words than an item is itself its one window for that item.

A window matches an item only if it holds one of the item's prefix shingles: its rarest ones, as many as leave the rest
less than the threshold's share of the item's weight (without them the similarity stays below the threshold). Only the
windows of an item's length around such places are fingerprinted, and only with that item compared, which changes no
result: the work follows the passages that texts and benchmark share, not windows times items. A block of 64 / (RADIUS + 1)
bits tells little apart, so it is this that prunes, and the blocks that vouch for the radius. Of pairs right at the threshold, 0.998
or more lie within RADIUS bits (3,000 drawn pairs for each of 16 lengths from 14 to 84 words), of others more; the rest is missed.
Texts of fewer words than an item are windows as a whole.

Words are runs of letters, digits and underscores, lower-cased, so case and punctuation don't hide a passage. An item
of fewer than five words is one shingle of all its words; an item or text without words, or null, matches nothing.
Items are read in blocks of ``block_items``, so the benchmark has no size limit either; the counts behind the weights are
of the whole benchmark. Beyond one block each is two more passes over the documents: one notes the weights of the block's
shingles in a text, one finds its items by the weights that all blocks noted. So results don't depend on the blocks.
Equal rows get equal results; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citeweave.llm.common import Shipped, pieces, written

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 26
_WORD = re.compile(r"\w+")
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_CACHE_WORDS = 200_000
_STRETCH, _PAIRS = 1 << 15, 1 << 18
FOUND = "start_word long, n_words int, hamming int, similarity double"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Hasher:
    """64-bit hashes of words (remembered) and of runs of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def runs(hashes: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of k words."""
        n = len(hashes) - k + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        out = np.full(n, np.uint64(k), np.uint64)
        for i in range(k):
            out = (out ^ hashes[i : i + n]) * _STEP
            out ^= out >> np.uint64(29)
        out *= _MIX
        return out ^ (out >> np.uint64(32))


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel().astype(np.uint64)


class Index:
    """A block of benchmark items, by number of words; ``whole`` has the items and shingle counts of all blocks (default: of this one)."""

    def __init__(self, items: list[tuple[object, str | None]], threshold: float = THRESHOLD, radius: int = RADIUS, whole: tuple[int, dict[int, int]] | None = None) -> None:
        self.threshold, self.radius, self.hasher = threshold, radius, _Hasher()
        shingles: dict[int, Counter] = {}
        lengths: dict[int, int] = {}
        for number, (_, text) in enumerate(items):
            if words := words_of(text):
                k = min(SHINGLE, len(words))
                shingles[number] = Counter(self.hasher.runs(self.hasher.words(words), k).tolist())
                lengths[number] = len(words)
        self.ids = [i for i, _ in items]
        n, df = whole or (len(shingles), Counter(h for c in shingles.values() for h in c))
        self.weight = {h: 1 + math.log((1 + n) / (1 + c)) for h, c in df.items()}
        self.other = 1 + math.log(1 + n)  # of shingles that no item has
        self.shingles = shingles
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for number, length in lengths.items():
            self.by_length[length].append(number)
        self.blocks = [(64 * b // (radius + 1), 64 * (b + 1) // (radius + 1)) for b in range(radius + 1)]
        self.fingerprints, self.lookup, self.known = {}, {}, {}
        for length, numbers in self.by_length.items():
            prints = np.concatenate([_pack(np.round((_signs(np.array(list(c), np.uint64)) * np.array([self.weight[x] * v for x, v in c.items()])[:, None]).sum(axis=0, keepdims=True), 6)) for c in (shingles[i] for i in numbers)])
            self.fingerprints[length] = prints
            tables = []
            for lo, hi in self.blocks:
                t = np.zeros((1 << (hi - lo), len(numbers)), bool)
                t[((prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(int), np.arange(len(numbers))] = True
                tables.append(t)
            self.lookup[length] = tables
        for k in range(1, SHINGLE + 1):
            own = {h for length, numbers in self.by_length.items() if min(SHINGLE, length) == k for i in numbers for h in shingles[i]}
            if own:
                self.known[k] = np.array(sorted(own), np.uint64)
        self.length = lengths
        self.print_of = {number: p for length, numbers in self.by_length.items() for number, p in zip(numbers, self.fingerprints[length])}
        self.column = {number: c for numbers in self.by_length.values() for c, number in enumerate(numbers)}
        # a bit map of 2^20 hash prefixes: most shingles of a text are told apart by it alone
        self.gate, self.known_weight = {}, {}
        for k, own in self.known.items():
            g = np.zeros(1 << 20, bool)
            g[(own >> np.uint64(44)).astype(int)] = True
            self.gate[k] = g
            self.known_weight[k] = np.array([self.weight[h] for h in own.tolist()])
        # by prefix shingle (its row in ``known``) the items that have it: offsets and numbers
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, own in self.known.items():
            holders: list[list[int]] = [[] for _ in own]
            for number, c in shingles.items():
                if min(SHINGLE, lengths[number]) == k:
                    rarest = sorted(c, key=lambda h: (-self.weight[h], h))
                    rest = sum(self.weight[h] * v for h, v in c.items())
                    least = (threshold - 1e-9) * rest
                    while rarest and rest >= least:
                        h = rarest.pop(0)
                        rest -= self.weight[h] * c[h]
                        holders[int(np.searchsorted(own, np.uint64(h)))].append(number)
            self.prefix[k] = np.cumsum([0, *map(len, holders)]), np.array([i for x in holders for i in x], np.int64)

    def similarity(self, window: np.ndarray, number: int, weights: np.ndarray) -> float:
        """Exact weighted Jaccard similarity of a window's shingles, which have ``weights``, and an item's."""
        item, own = self.shingles[number], Counter(window.tolist())
        weight = dict(zip(window.tolist(), weights.tolist()))
        low = high = 0.0
        for h in item.keys() | own.keys():
            w, a, b = weight[h] if h in weight else self.weight[h], item.get(h, 0), own.get(h, 0)
            low += w * min(a, b)
            high += w * max(a, b)
        return low / high if high else 0.0

    def _hits(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By length of shingle: a text's shingles, the places of those that items have, and their rows in ``known``."""
        for k, known in self.known.items():
            runs = self.hasher.runs(hashes, k)
            if not len(runs):
                continue
            hits = np.flatnonzero(self.gate[k][(runs >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, runs[hits]), len(known) - 1)
            real = known[place] == runs[hits]
            if real.any():
                yield k, runs, hits[real], place[real]

    def noted(self, text: str | None) -> tuple[list[int], list[float]] | None:
        """Places and weights of the five-word shingles of ``text`` that items have; None if it has no shingle of an item."""
        out = None
        for k, _, hits, place in self._hits(self.hasher.words(words_of(text))):
            if k == SHINGLE:
                return hits.tolist(), self.known_weight[k][place].tolist()
            out = [], []
        return out

    def matches(self, text: str | None, noted: tuple[list[int], list[float]] | None = None) -> list[tuple[object, int, int, int, float]]:
        """(item id, start_word, n_words, hamming, similarity) of the best window of each item found in ``text``.

        ``noted`` has places and weights of shingles that other blocks' items have.
        """
        words = words_of(text)
        if not words or not self.known:
            return []
        best: dict[int, tuple] = {}
        for k, runs, hits, place in self._hits(self.hasher.words(words)):
            at, weight = hits, self.known_weight[k][place]
            if noted and k == SHINGLE:  # a shingle of fewer words is an item's only one: its weight cancels out
                at, first = np.unique(np.concatenate([at, np.array(noted[0], np.int64)]), return_index=True)
                weight = np.concatenate([weight, np.array(noted[1])])[first]
            offsets, numbers = self.prefix[k]
            count = offsets[place + 1] - offsets[place]
            if not count.any():
                continue
            ends = np.cumsum(count)
            held = numbers[np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(offsets[place], count)]
            places_of: dict[int, np.ndarray] = {}
            order = np.argsort(held, kind="stable")
            held, where = held[order], np.repeat(hits, count)[order]
            cuts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
            for i, p in zip(held[cuts].tolist(), np.split(where, cuts[1:])):
                places_of[i] = p
            self._search(runs, at, weight, k, places_of, best)
        return [(self.ids[i], s, n, d, sim) for i, (sim, s, n, d) in sorted(best.items())]

    def _search(self, runs: np.ndarray, places: np.ndarray, weights: np.ndarray, k: int, places_of: dict[int, np.ndarray], best: dict) -> None:
        """Compare each item with the windows that hold one of its prefix shingles, at ``places_of``; the shingles at ``places`` have ``weights``."""
        sizes: dict[int, list[int]] = defaultdict(list)
        for number in places_of:
            sizes[min(self.length[number] - k + 1, len(runs))].append(number)
        reach = max(sizes)
        spots = np.unique(np.concatenate(list(places_of.values())))
        cuts = np.flatnonzero(np.diff(spots) > 2 * reach)
        for a, b in zip(np.r_[0, cuts + 1].tolist(), np.r_[cuts + 1, len(spots)].tolist()):
            first, last = max(0, int(spots[a]) - reach + 1), int(spots[b - 1])
            for at in range(first, last + 1, _STRETCH):
                to = min(last + 1, at + _STRETCH)  # starts of windows: at <= start < to
                part = runs[at : to + reach]
                lo, hi = np.searchsorted(places, (at, at + len(part)))
                weight = np.full(len(part), self.other)
                weight[places[lo:hi] - at] = weights[lo:hi]
                sums = np.zeros((len(part) + 1, 64))
                np.cumsum(_signs(part) * weight[:, None], axis=0, out=sums[1:])
                for size, numbers in sizes.items():
                    for number in numbers:
                        p = places_of[number]
                        low, high = np.maximum(p - size + 1, at), np.minimum(np.minimum(p, to - 1), len(runs) - size)
                        ranges = [np.arange(x, y + 1) for x, y in zip(low.tolist(), high.tolist()) if x <= y]
                        if ranges:
                            starts = np.unique(np.concatenate(ranges)) - at
                            for j in range(0, len(starts), _PAIRS):
                                own = starts[j : j + _PAIRS]
                                self._compare(part, at, own, weight, _pack(np.round(sums[own + size] - sums[own], 6)), size, k, number, best)

    def _compare(self, part: np.ndarray, at: int, starts: np.ndarray, weight: np.ndarray, prints: np.ndarray, size: int, k: int, number: int, best: dict) -> None:
        """Candidates among windows of one item by the blocks, then by distance, then verified."""
        length, column = self.length[number], self.column[number]
        shares = np.zeros(len(prints), bool)
        for (p, q), t in zip(self.blocks, self.lookup[length]):
            shares |= t[((prints >> np.uint64(p)) & np.uint64((1 << (q - p)) - 1)).astype(np.int64), column]
        near = np.flatnonzero(shares)
        distance = np.bitwise_count(prints[near] ^ self.print_of[number])
        near, distance = near[distance <= self.radius], distance[distance <= self.radius]
        for i in np.argsort(distance, kind="stable").tolist():
            if number in best and best[number][0] >= 1:
                return
            start = int(starts[near[i]])
            sim = self.similarity(part[start : start + size], number, weight[start : start + size])
            if sim >= self.threshold and (number not in best or sim > best[number][0]):
                best[number] = (sim, at + start, size + k - 1, int(distance[i]))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_items: int) -> Iterator[list[tuple[object, str | None]]]:
    block = []
    for row in benchmark.select(id_col, text_col).dropDuplicates().orderBy(id_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == block_items:
            yield block
            block = []
    if block:
        yield block


def _whole_counts(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[int, DataFrame]:
    """Number of items with words, and (h, df): the items that have each shingle, over the whole benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in pieces(batches, "_text", 2 << 20):
            found = [np.unique(hasher.runs(hasher.words(w), min(SHINGLE, len(w)))) for t in batch.column("_text") if (w := words_of(t.as_py()))]
            if found:
                item = np.concatenate([np.arange(len(f)) == 0 for f in found]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(item)], ["h", "item"])

    items = benchmark.select(id_col, text_col).dropDuplicates().select(F.col(text_col).alias("_text"))
    counts = items.mapInArrow(run, "h long, item long").groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.sum("item").alias("items"))
    counts = written(counts, "benchmark-shingles")
    return counts.agg(F.sum("items")).first()[0] or 0, counts.select("h", "df")


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, threshold: float, radius: int, block_items: int) -> list[Shipped]:
    """The index of each block of items, sent to executors, with weights of the whole benchmark."""
    spark, out, whole = benchmark.sparkSession, [], None
    blocks = _blocks(benchmark, id_col, text_col, block_items)
    items, following = next(blocks, None), next(blocks, None)
    while items is not None:
        if out or following is not None:
            n, counts = whole = whole or _whole_counts(benchmark, id_col, text_col)
            hasher, own = _Hasher(), set()
            for _, text in items:
                if words := words_of(text):
                    own.update(hasher.runs(hasher.words(words), min(SHINGLE, len(words))).view(np.int64).tolist())
            keys = spark.createDataFrame(pa.table({"h": pa.array(sorted(own), pa.int64())}))  # of at most block_items items
            found = counts.join(keys, "h").toArrow()
            df = dict(zip(found.column("h").to_numpy().view(np.uint64).tolist(), found.column("df").to_pylist()))
            out.append(Shipped(spark, Index(items, threshold, radius, (n, df))))
        else:
            out.append(Shipped(spark, Index(items, threshold, radius)))
        items, following = following, next(blocks, None)
    return out


_NOTED = pa.struct([("at", pa.list_(pa.int64())), ("weight", pa.list_(pa.float64()))])


def _with_notes(docs: DataFrame, text_col: str, indexes: list[Shipped]) -> tuple[DataFrame, str]:
    """``docs`` with the places and weights of each text's shingles that items of any block have, or null, and that column's name."""
    name = "noted"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    docs = docs.withColumn(name, F.lit(None).cast("struct<at:array<bigint>,weight:array<double>>"))
    for sent in indexes:

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text_col, 2 << 20):
                noted = []
                for t, before in zip(batch.column(text_col), batch.column(name).to_pylist()):
                    own = sent.value.noted(t.as_py())
                    if own and before:
                        both = dict(zip(before["at"], before["weight"])) | dict(zip(*own))
                        own = list(both), list(both.values())
                    noted.append({"at": own[0], "weight": own[1]} if own else before)
                yield batch.set_column(batch.schema.get_field_index(name), name, pa.array(noted, _NOTED))

        docs = docs.mapInArrow(run, docs.schema)
    return docs, name


def _of(noted: dict | None) -> tuple[list[int], list[float]] | None:
    return (noted["at"], noted["weight"]) if noted else None


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, block_items: int = 20_000) -> DataFrame:
    """One row for each document and benchmark item that it holds: ids, place, fingerprint distance and similarity."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"{id_col} {dict(source.dtypes)['_id']}, item_id {dict(benchmark.dtypes)[item_col]}, {FOUND}"
    parts, indexes, noted = [], _indexes(benchmark, item_col, item_text_col, threshold, radius, block_items), None
    if len(indexes) > 1:
        source, noted = _with_notes(source, "_text", indexes)
        source = written(source.where(F.col(noted).isNotNull()), "noted-texts")
    for sent in indexes:

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            out = pa.schema([])
            for batch in pieces(batches, "_text", 2 << 20):
                out = pa.schema([(id_col, batch.schema.field("_id").type), ("item_id", item_kind), ("start_word", pa.int64()), ("n_words", pa.int32()), ("hamming", pa.int32()), ("similarity", pa.float64())])
                notes = batch.column(noted).to_pylist() if noted else [None] * batch.num_rows
                found = [(i, *m) for i, t, w in zip(batch.column("_id").to_pylist(), batch.column("_text"), notes) for m in sent.value.matches(t.as_py(), _of(w))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)

        parts.append(source.mapInArrow(run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def clean_of(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, block_items: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns, no shuffle."""
    indexes, noted = _indexes(benchmark, item_col, item_text_col, threshold, radius, block_items), None
    if len(indexes) > 1:
        docs, noted = _with_notes(docs, text_col, indexes)
    for sent in indexes:

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text_col, 2 << 20):
                notes = batch.column(noted).to_pylist() if noted else [None] * batch.num_rows
                keep = [not sent.value.matches(t.as_py(), _of(w)) for t, w in zip(batch.column(text_col), notes)]
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.drop(noted) if noted else docs
