"""Filter interaction audit: what each filter of a chain removes under every order of the chain.

A document fails a set of filters, and that set alone decides at which step of an order it goes. So documents are counted
once into mask cells (part, set of failed filters), 2^k of them at most for each part, and the orders are judged from the
cells. Orders are visited by adjacent transpositions (each differs from the one before by one swap of neighbours), which
leaves all steps but two as they were: the first of the two is summed anew from the cells, the second takes the rest of
what both remove together. Shapley sums accumulate along the walk: a filter's share is added when it changes, times the
orders for which it stood.

Repeats: a document fails ``repeat`` if a smaller id of the whole table has the same text (by SHA-256). The least id of
each digest is found by a minimum that is combined before the shuffle; documents then look up (digest, id), which no
group of copies makes hot. Only the narrow table (id, part, digest, mask) is shuffled, never a text.

Edge cases: a null text is empty (no words, no repeated-word failure, no capitals); a null part is the empty string; a
row without an id can't be larger than another, so it never fails ``repeat`` and has no labels; rows that share id and
text are no repeats of each other; an id with several label rows has what any of them says; an empty table gives an empty
result. Only the named columns are read, so others can't clash. Any number of parts: they are walked apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import WORD, written

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_FILTERS = 8
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions over a text and the array of its words: few words, few distinct ones, many capitals, odd signs."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def swaps(k: int) -> Iterator[int]:
    """Positions i so that swapping i and i + 1, one after another, visits every order of k things once."""
    if k < 2:
        return
    inner, down = swaps(k - 1), True
    while True:
        yield from range(k - 2, -1, -1) if down else range(k - 1)  # the last thing moves through the others
        step = next(inner, None)
        if step is None:
            return
        yield step + down
        down = not down


def walk(cells: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """Orders, what their steps remove (orders x steps x counts x parts), Shapley sums (filters x parts).

    ``cells`` holds counts x parts x 2^k numbers, by the mask of failed filters; the first count is of documents.
    """
    k = cells.shape[-1].bit_length() - 1
    masks = np.arange(1 << k)

    def removed(f: int, before: int) -> np.ndarray:
        return cells[:, :, masks[((masks >> f) & 1 == 1) & (masks & before == 0)]].sum(axis=2)

    order, steps, before = list(range(k)), [], 0
    for f in order:
        steps.append(removed(f, before))
        before |= 1 << f
    shapley, since = np.zeros((k, cells.shape[1]), np.int64), [0] * k
    orders, found = [tuple(order)], [np.stack(steps)]
    for at, i in enumerate(swaps(k), 1):
        for s in (i, i + 1):
            shapley[order[s]] += steps[s][0] * (at - since[order[s]])
            since[order[s]] = at
        both = steps[i] + steps[i + 1]
        order[i], order[i + 1] = order[i + 1], order[i]
        steps[i] = removed(order[i], sum(1 << f for f in order[:i]))
        steps[i + 1] = both - steps[i]
        orders.append(tuple(order))
        found.append(np.stack(steps))
    for s, f in enumerate(order):
        shapley[f] += steps[s][0] * (len(orders) - since[f])
    return orders, np.stack(found), shapley


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", names: str = "ABCDE", repeat: str | None = "E", filters=text_filters, good: str = "quality = 1", toxic: str = "toxic = 1") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters; bit i of the mask is ``names[i]``."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    conditions: Mapping[str, Column] = filters(F.col("text"), F.col("words"))
    bits = reduce(add, (F.when(conditions[f], 1 << i).otherwise(0) for i, f in enumerate(names) if f != repeat))
    rows = written(source.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), bits.cast("int").alias("mask")), "masks")
    known, unknown = rows.where(F.col("id").isNotNull()), rows.where(F.col("id").isNull())
    if repeat is not None:
        firsts = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
        known = known.join(firsts, ["digest", "id"], "left").withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << names.index(repeat)))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.max(F.coalesce(F.expr(c), F.lit(False)).cast("long")).alias(n) for n, c in (("good", good), ("toxic", toxic))))
    known = known.join(said, "id", "left").select("part", "mask", "good", "toxic")
    every = known.unionByName(unknown.select("part", "mask", F.lit(None).cast("long").alias("good"), F.lit(None).cast("long").alias("toxic")))
    return every.na.fill(0, ["good", "toxic"]).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def walked(cells: DataFrame, names: str) -> DataFrame:
    """One row per part, order and step, from ``mask_cells``; a part's cells (2^k at most) meet in one row."""
    k = len(names)
    if not 1 <= k <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters, as their orders are listed")
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                table = np.zeros((3, batch.num_rows, 1 << k), np.int64)
                for p, own in enumerate(batch.column(1).to_pylist()):
                    for c in own:
                        table[:, p, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, removed, shapley = walk(table)
                masks = np.arange(1 << k)
                fails = np.stack([table[0][:, (masks >> f) & 1 == 1].sum(axis=1) for f in range(k)])
                only = table[0][:, [1 << f for f in range(k)]].T
                kept = table[0].sum(axis=1) - np.cumsum(removed[:, :, 0], axis=1)
                for p, part in enumerate(batch.column(0).to_pylist()):
                    who = np.array(orders).ravel()
                    own = removed[..., p].reshape(-1, 3)
                    values = (kept[..., p].ravel(), own[:, 0], fails[who, p] - own[:, 0], only[who, p], own[:, 1], own[:, 2], shapley[who, p])
                    labels = np.repeat(["".join(names[f] for f in o) for o in orders], k)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(who), pa.string()), pa.array(labels.tolist(), pa.string()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))), *map(pa.array, values)], ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, names: str = "ABCDE", **columns) -> DataFrame:
    """The audit of ``docs`` by part: ``mask_cells`` with the same parameters, then ``walked``."""
    return walked(written(mask_cells(docs, labels, names=names, **columns), "mask-cells"), names)
