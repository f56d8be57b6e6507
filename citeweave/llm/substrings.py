"""Substring dedup by recompression: words that stand in a passage of ``window`` words that an earlier document has go.

Recompression names a document's words level by level: maximal runs of a symbol, then pairs (a, b) where a keyed bit of a's
name says left and b's says right. Whether two symbols merge is written in those two alone, so equal passages get equal
symbols inside, whatever surrounds them. A symbol's name is a keyed hash of what it stands for: it is global without a
dictionary, and two strings that shared a name would cost a comparison below, never a result.

With each symbol goes its evidence: the words that had to be read to know that it is there (its own, and neighbours that
might have merged with it). A window that holds the evidence of a symbol holds the symbol wherever it stands. Of
those the window's sign is the longest, ties by name: a function of the window's words alone, which few neighbouring
windows don't share. A window without any symbol signs with its own hash.

Spark rounds: (1) each distinct text gives its signs; a global grouping finds those of several documents. (2) Only windows
whose sign is shared give a 128-bit hash of their words, each with its document; a minimum (combined before the shuffle)
is the first document of each, and a join verifies which windows an earlier document has. (3) Words under a verified
window go. A window that two documents share always has a shared sign, so nothing is missed; nothing unverified goes.

Copies of a whole text are settled by its digest: the first copy alone takes part above, later ones go as a whole. A
group of copies or a passage of a third of all documents costs rows in proportion, never pairs: equal windows that meet in
a task are settled there, all but the first's, and minima are combined by task. What meets in one row is a document's
own: its signs and its covered places. A text is cut into pieces of ``piece`` words that overlap by a window, which changes no
sign, so a task's memory doesn't follow the longest text's symbols.

Edge cases: a null text has no words; texts of less than ``window`` words stay; a row without an id is neither earlier nor
later than another and stays whole; rows that share an id don't judge each other; rows that repeat id and text get the
same result; a run longer than a window names nothing (its windows sign with their hashes); an empty table gives
an empty result. Only id and text are read, so other columns can't clash (``deduplicated`` passes them through).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import pieces, written

WINDOW, ROUNDS, LONGEST, PIECE = 50, 4, 16, 1 << 17
#: Bytes of text that a task works on at once, or one text.
BATCH = 1 << 20
FAR = 1 << 40
_RUN, _LEFT, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), 0x9E3779B97F4A7C15
#: Odd bases of the two rolling hashes, and their inverses modulo 2^64.
_BASES = tuple((np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def recompressed(names: np.ndarray, rounds: int, longest: int, run_limit: int) -> tuple[np.ndarray, ...]:
    """(name, length, low, high) of every symbol that ``rounds`` rounds create; its evidence is [low, high).

    ``names`` are the words', with 0 (a barrier) between texts and at both ends. What depends on a barrier has evidence
    beyond every window, and so does what depends on a run of more than ``run_limit`` words.
    """
    at = np.arange(len(names))
    name, to = names, at + 1
    low, high = np.where(name == 0, -FAR, at), np.where(name == 0, FAR, to)
    made: list[tuple[np.ndarray, ...]] = []
    for r in range(rounds):
        salt = np.uint64((_STEP * (2 * r + 1)) & ((1 << 64) - 1))
        # runs
        first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (name[1:] == 0)])
        last = np.r_[first[1:], len(name)] - 1
        times = last - first + 1
        # no run is longer: the symbols beside it, as they were before, say so
        low, high = np.r_[low[:1], np.minimum(low[1:], low[:-1])][first], np.r_[np.maximum(high[:-1], high[1:]), high[-1:]][last]
        name, at, to = name[first], at[first], to[last]
        runs = times > 1
        name = np.where(runs, mixed(name * _RUN + times.astype(np.uint64) + salt) | np.uint64(1), name)
        frozen = runs & (to - at > run_limit)
        name, low, high = np.where(frozen, np.uint64(0), name), np.where(frozen, -FAR, low), np.where(frozen, FAR, high)
        own = np.flatnonzero(runs & ~frozen)
        made.append((name[own], (to - at)[own], low[own], high[own]))
        # pairs
        right = (mixed(name + salt) >> np.uint64(63)).astype(bool)
        length = to - at
        i = np.flatnonzero(~right[:-1] & right[1:] & (name[:-1] != 0) & (name[1:] != 0) & (length[:-1] + length[1:] <= longest))
        # one that stays as it is was refused by its right neighbour if it is a left one, else by its left neighbour
        low_, high_ = np.r_[low[:1], np.minimum(low[1:], low[:-1])], np.r_[np.maximum(high[:-1], high[1:]), high[-1:]]
        new_low, new_high = np.where(right, low_, low), np.where(right, high, high_)
        new_low[i], new_high[i] = np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
        pair = mixed(name[i] * _LEFT + mixed(name[i + 1] + salt)) | np.uint64(1)
        name, to = name.copy(), to.copy()
        name[i], to[i] = pair, to[i + 1]
        made.append((pair, to[i] - at[i], new_low[i], new_high[i]))
        stays = np.ones(len(name), bool)
        stays[i + 1] = False
        name, at, to, low, high = name[stays], at[stays], to[stays], new_low[stays], new_high[stays]
    return tuple(np.concatenate(x) for x in zip(*made))


def rolling(names: np.ndarray, window: int, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    """A hash of each window of names: their polynomial in ``base`` modulo 2^64."""
    powers = np.full(len(names) + 1, base, np.uint64)
    powers[0] = 1
    sums = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * np.multiply.accumulate(powers)[:-1], out=sums[1:])
    powers[1:] = inverse
    return (sums[window:] - sums[: len(names) - window + 1]) * np.multiply.accumulate(powers)[: len(names) - window + 1]


def signs(names: np.ndarray, window: int, rounds: int = ROUNDS, longest: int = LONGEST) -> np.ndarray:
    """The sign of each window of ``names`` (those over a barrier mean nothing)."""
    n = len(names)
    name, length, low, high = recompressed(names, rounds, min(longest, window), max(1, window - 2))
    # windows that hold the evidence start at first..last
    first, last = np.maximum(high - window, 0), np.minimum(low, n - window)
    held = (high - low <= window) & (first <= last)
    first, last = first[held], last[held]
    value = (np.minimum(length[held], 15).astype(np.uint64) << np.uint64(60)) | (mixed(name[held]) >> np.uint64(4))
    # the largest value over ranges: each range is two of a power of two, which are halved down to single windows
    level = np.frexp(last - first + 1)[1] - 1
    best = np.zeros(n, np.uint64)
    for k in range(int(level.max(initial=0)), -1, -1):
        own = level == k
        np.maximum.at(best, first[own], value[own])
        np.maximum.at(best, last[own] - (1 << k) + 1, value[own])
        if k:
            half = 1 << (k - 1)
            best[half:] = np.maximum(best[half:], best[:-half].copy())
    best = best[: n - window + 1]
    bare = best == 0
    if bare.any():
        best = np.where(bare, mixed(rolling(names, window, *_BASES[0])) >> np.uint64(4), best)
    return best


def laid_out(texts: list[bytes], window: int, piece: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Names of all words in two independent hashes with barriers between, and (text, first word, start, words) of pieces.

    ``texts`` are words with one space between, of at least ``window`` words each.
    """
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    offsets = np.flatnonzero(data == 32) + 1
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    digests = [xxhash.xxh3_128_intdigest(w) for w in words.dictionary.to_pylist()]
    codes = words.indices.to_numpy()
    both = [np.array([(d >> s) & ((1 << 64) - 1) | 1 for d in digests], np.uint64)[codes] for s in (0, 64)]
    counts = np.array([t.count(b" ") + 1 for t in texts])
    parts, laid, begin, start = [], [], 0, 1
    for t, count in enumerate(counts.tolist()):
        for first in range(0, max(1, count - window + 1), piece):
            size = min(count - first, piece + window - 1)
            parts.append((t, first, start, size))
            laid.append(np.arange(begin + first, begin + first + size))
            start += size + 1
        begin += count
    out = []
    for names in both:
        row = np.zeros(start, np.uint64)
        for (_, _, at, size), own in zip(parts, laid):
            row[at : at + size] = names[own]
        out.append(row)
    return out[0], out[1], parts


def _schema(rows: DataFrame, *fields: str) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"{f} {kinds[f]}" if " " not in f else f for f in fields)


def signed(docs: DataFrame, id_col: str, text_col: str, window: int, rounds: int, piece: int) -> DataFrame:
    """(id, key, n_words, digest, signs): a row per row; ``digest`` is the SHA-256 of the words with one space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH):
            texts = [(t.as_py() or b"").split() for t in batch.column(2).cast(pa.binary())]
            counts = [len(t) for t in texts]
            texts = [b" ".join(t) for t in texts]
            found: list = [None] * len(texts)
            long = [i for i, n in enumerate(counts) if n >= window]
            if long:
                names, _, parts = laid_out([texts[i] for i in long], window, piece)
                own = signs(names, window, rounds)
                for t, _, start, size in parts:
                    part = np.unique(own[start : start + size - window + 1])
                    before = found[long[t]]
                    found[long[t]] = part if before is None else np.union1d(before, part)
            listed = pa.array([None if f is None else f.view(np.int64) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), listed], ["id", "key", "n_words", "digest", "signs"])

    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, _schema(read, "id", "key", "n_words long", "digest binary", "signs array<long>"))


def windows(texts: DataFrame, wanted: str, window: int, rounds: int, piece: int, held: int = 400_000) -> DataFrame:
    """Windows of ``texts`` (id, rid, text) whose sign is in the ``wanted`` column: (w1, w2, id, rid, at, known).

    A task holds some ``held`` of them (those of one batch at least) and sorts them by hash: of equal windows only the
    first document's goes on as a row (hash, id, rid, place). The other documents' windows are settled there and then, and
    go on as a row of places for each (``known``, under a hash of its own), so a passage that many documents share is thinned
    out before it is shuffled.
    """

    def flush(ids: list, rids: list, found: list[tuple[np.ndarray, ...]], kinds: tuple) -> Iterator[pa.RecordBatch]:
        w1, w2, doc, at = (np.concatenate(c) for c in zip(*found))
        ranks = np.unique(np.array(ids, dtype=object), return_inverse=True)[1][doc]
        order = np.lexsort((ranks, w2, w1))
        w1, w2, doc, at, ranks = w1[order], w2[order], doc[order], at[order], ranks[order]
        new = np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
        later = ranks > ranks[np.flatnonzero(new)][np.cumsum(new) - 1]
        for part in np.array_split(np.flatnonzero(~later), -(-int((~later).sum()) // 50_000)):
            own = doc[part]
            yield pa.RecordBatch.from_arrays([pa.array(w1[part]), pa.array(w2[part]), pa.array(ids, kinds[0]).take(pa.array(own)), pa.array(rids, kinds[1]).take(pa.array(own)), pa.array(at[part]), pa.nulls(len(part), pa.list_(pa.int32()))], names)
        settled = np.flatnonzero(later)
        if len(settled):
            settled = settled[np.argsort(doc[settled], kind="stable")]
            whose, starts = np.unique(doc[settled], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(settled)].astype(np.int32)), pa.array(at[settled]))
            keys = [pa.array(mixed(np.array([rids[d] for d in whose], np.int64).view(np.uint64) + np.uint64(i)).view(np.int64)) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([ids[d] for d in whose], kinds[0]), pa.array([rids[d] for d in whose], kinds[1]), pa.nulls(len(whose), pa.int32()), lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rids, found, size, kinds = [], [], [], 0, ()
        for batch in pieces(batches, "text", BATCH):
            kinds = batch.schema.field(0).type, batch.schema.field(1).type
            own = [b" ".join(t.as_py().split()) for t in batch.column(2).cast(pa.binary())]
            names_, others, parts = laid_out(own, window, piece)
            sign = signs(names_, window, rounds)
            hashes = [rolling(x, window, *b).view(np.int64) for x, b in zip((names_, others), _BASES)]
            lists = [np.array(x, np.int64).view(np.uint64) for x in batch.column(3).to_pylist()]
            for t, first, start, length in parts:
                hit = start + np.flatnonzero(np.isin(sign[start : start + length - window + 1], lists[t]))
                if len(hit):
                    found.append((hashes[0][hit], hashes[1][hit], np.full(len(hit), len(ids) + t), (hit - start + first).astype(np.int32)))
                    size += len(hit)
            ids += batch.column(0).to_pylist()
            rids += batch.column(1).to_pylist()
            if size >= held:
                yield from flush(ids, rids, found, kinds)
                ids, rids, found, size = [], [], [], 0
        if size:
            yield from flush(ids, rids, found, kinds)

    names = ["w1", "w2", "id", "rid", "at", "known"]
    read = texts.where(F.size(wanted) > 0).select("id", "rid", "text", wanted)
    return read.mapInArrow(run, _schema(read, "w1 long", "w2 long", "id", "rid", "at int", "known array<int>"))


def kept(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """(rid, n_removed, kept_sha256, kept_text) of ``texts`` (rid, text, at): the words under no window that starts at one of ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH):
            removed, left = [], []
            for text, at in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                words = text.as_py().split()
                depth = np.zeros(len(words) + 1, np.int64)
                starts = at.values.to_numpy()
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + window, -1)
                stays = np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()
                removed.append(len(words) - len(stays))
                left.append(b" ".join([words[i] for i in stays]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array(left if with_text else [None] * len(left), pa.binary()).cast(pa.string())], ["rid", "n_removed", "kept_sha256", "kept_text"])

    return texts.select("rid", "text", "at").mapInArrow(run, "rid long, n_removed long, kept_sha256 string, kept_text string")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, piece: int = PIECE, with_text: bool = False) -> DataFrame:
    """(id, key, n_words, n_removed, kept_sha256, kept_text): a row per row; ``kept_text`` is null unless words go and it is asked for."""
    rows = written(signed(docs, id_col, text_col, window, rounds, piece), "signed")
    first = F.min(F.struct("id", "key", "signs")).alias("first")
    firsts = rows.where(F.col("id").isNotNull() & (F.col("n_words") >= window)).groupBy("digest").agg(first)
    firsts = written(firsts.select(F.monotonically_increasing_id().alias("rid"), "digest", "first.*"), "first-copies")

    each = firsts.select("rid", "id", F.explode("signs").alias("sign"))
    # a window, not a grouping and a join: signs are most of what is shuffled, and so go once
    alike = Window.partitionBy("sign")
    shared = each.select("rid", "id", "sign", F.min("id").over(alike).alias("least"), F.max("id").over(alike).alias("most")).where("least < most")
    own = shared.groupBy("rid").agg(F.collect_list(F.when(F.col("id") > F.col("least"), F.col("sign"))).alias("later"), F.collect_list(F.when(F.col("id") < F.col("most"), F.col("sign"))).alias("earlier"))
    own = own.join(firsts.select("rid", "id", "key"), "rid")
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    texts = written(read.join(own, ["id", "key"]).select("id", "rid", "text", "later", "earlier"), "shared-texts", compression="zstd")

    # a window counts against those of later documents only if its sign is also theirs, and the other way round
    sources = windows(texts, "earlier", window, rounds, piece).where("known IS NULL").groupBy("w1", "w2").agg(F.min("id").alias("least"))
    found = windows(texts, "later", window, rounds, piece).join(sources, ["w1", "w2"], "left").where(F.col("known").isNotNull() | (F.col("least") < F.col("id")))
    covers = found.groupBy("rid").agg(F.flatten(F.collect_set(F.coalesce("known", F.array("at")))).alias("at"))
    edits = kept(texts.where(F.size("later") > 0).select("rid", "text").join(covers, "rid"), window, with_text)
    edits = written(edits.groupBy("rid").agg(*(F.first(c).alias(c) for c in ("n_removed", "kept_sha256", "kept_text"))), "edits")

    firsts = firsts.select("rid", "digest", F.col("id").alias("first")).join(edits, "rid", "left").drop("rid")
    out = rows.drop("signs").join(firsts, "digest", "left")
    later, earliest = F.col("id") > F.col("first"), F.col("id") == F.col("first")
    return out.select(
        "id", "key", "n_words",
        F.when(later, F.col("n_words")).when(earliest, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(later, F.sha2(F.lit("").cast("binary"), 256)).when(earliest & F.col("kept_sha256").isNotNull(), F.col("kept_sha256")).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        F.when(later, F.lit("")).when(earliest, F.col("kept_text")).alias("kept_text"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with the words that stay, one space between, in texts that lose any; other texts and columns as they were."""
    edits = judged(docs, id_col, text_col, with_text=True, **params).where("n_removed > 0").groupBy("id", "key").agg(F.first("kept_text").alias("_cw_kept"))
    edits = edits.select(F.col("id").alias("_cw_id"), F.col("key").alias("_cw_key"), "_cw_kept")
    rows = docs.select(F.struct(*docs.columns).alias("_cw_row"))
    joined = rows.join(edits, (F.col("_cw_row")[id_col] == F.col("_cw_id")) & (F.xxhash64(F.col("_cw_row")[text_col]) == F.col("_cw_key")), "left")
    text = F.coalesce("_cw_kept", F.col("_cw_row")[text_col]).alias(text_col)
    return joined.select(*(text if c == text_col else F.col("_cw_row")[c].alias(c) for c in docs.columns))


def report(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): a row per row of ``docs``."""
    return judged(docs, **params).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
