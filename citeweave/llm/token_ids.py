"""Token-ID output: Parquet list columns.

Documents are dealt by ranges of their id and put in order; each task encodes its range and writes one file. A row has
the document's place (``part``, the range's number; ``local_start``, the ids before it in its range), its length and
checksum, and ``ids``, a list of 32-bit integers. The ids' pages are dictionary-encoded while a row group's ids are few
enough for a dictionary, the other integers are delta-encoded (Parquet's version 2 pages); row groups, pages and the page
index are sized by options, so that readers can take a few documents' ids, or only the metadata columns, without
reading the rest.

The first id of a document in the whole output is its ``local_start`` plus the ids of all ranges before: a sum over
one row for each file.

Encoding is the library's; for the tokenizers whose split is known here (no normalizer, byte-level pieces, byte-pair
merges) what it made of each piece is remembered (see Encoder), for others every text goes to the library whole.

Edge cases: a null or empty text has the end id only; equal ids are ordered by text; null ids come first; an empty
table gives an empty result; other columns aren't read. ``parts`` is the number of
files (default: the session's shuffle partitions). Lost tasks are retried and committed by Spark's writer.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import fresh_path, pieces, small_batches, written

END_ID = 2
#: Parquet options of the files.
LAYOUT = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.dictionary.page.size": str(1 << 20)}
#: The tokenizer's split (a fixed value), for texts of ASCII and Latin characters only; other texts go to the library whole.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+").findall
_OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\u00a1-\u00ac\u00ae-\u024f]")
_CACHE_PIECES = 250_000


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others, in order, for U+0100 and up."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def splits_as_known(settings: dict) -> bool:
    """Whether a tokenizer's settings (its file's JSON) are those that _SPLIT and the byte alphabet stand for."""
    model, before = settings.get("model") or {}, settings.get("pre_tokenizer") or {}
    plain = settings.get("normalizer") is None and not settings.get("truncation") and not settings.get("padding")
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    merges = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return bool(plain and level and merges)


def _process_cache() -> dict[str, dict]:
    """What this process remembers between tasks."""
    return sys.modules.setdefault("_citeweave_process_cache", ModuleType("_citeweave_process_cache")).__dict__


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit integers.

    Merges never cross the pieces that the tokenizer splits a text into, so a piece's ids are the same wherever it stands:
    the library's model merges each piece once for as long as it is remembered (two generations of at most _CACHE_PIECES). Texts
    with other characters, or with a special token's text, go to the library whole.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        from tokenizers import Tokenizer

        own = _process_cache().setdefault(path, {})
        if not own:
            tokenizer = Tokenizer.from_file(path)
            model = tokenizer.model
            own |= {"tokenizer": tokenizer, "model": model, "known": splits_as_known(json.loads(tokenizer.to_str())), "special": [t.content for t in tokenizer.get_added_tokens_decoder().values()], "new": {}, "old": {}}
        self.own, self.tokenizer, self.special, self.model = own, own["tokenizer"], own["special"], own["model"]
        self.alphabet = _byte_alphabet()
        self.end = np.uint32(end_id).astype("<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece's ids by the library's model alone: its bytes in the byte-level alphabet, merged."""
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        own = self.own
        if len(own["new"]) > _CACHE_PIECES:
            own["old"], own["new"] = own["new"], {}
        known, old = own["new"], own["old"]
        split = [None if not t or not own["known"] or _OTHER.search(t) or any(s in t for s in self.special) else _SPLIT(t) for t in texts]
        pieces_: set[str] = set()
        for found in split:
            if found:
                pieces_.update(found)
        new = []
        for piece in pieces_.difference(known):
            ids = old.get(piece)
            if ids is None:
                new.append(piece)
            else:
                known[piece] = ids
        known.update(zip(new, map(self._piece, new)))
        get = known.__getitem__
        return [(b"".join(map(get, found)) if found is not None else self._whole(t) if t else b"") + self.end for t, found in zip(texts, split)]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, parts: int | None = None, layout: dict[str, str] = LAYOUT) -> None:
    """Write the token files of ``docs`` under ``path``; ``tokenizer`` is a file on every executor."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    dealt = source.repartitionByRange(parts, F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and full collections would walk the remembered pieces
        try:
            encoder, part, at = Encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
            for batch in pieces(batches, "_text", 4 << 20):
                ids = encoder(batch.column("_text").to_pylist())
                sizes = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
                ends = np.cumsum(sizes)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values)
                crc = pa.array([zlib.crc32(i) for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(at + ends - sizes), pa.array(sizes), crc, lists], ["_id", "part", "local_start", "n_tokens", "crc", "ids"])
                at += int(ends[-1])
        finally:
            gc.enable()

    kind = dict(source.dtypes)["_id"]
    files = dealt.mapInArrow(run, f"_id {kind}, part int, local_start long, n_tokens long, crc long, ids array<int>").withColumnRenamed("_id", id_col)
    with small_batches(spark):
        files.write.options(**layout).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The token files; columns and row groups that a query doesn't need aren't read."""
    return spark.read.parquet(path)


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and CRC-32 of the ids that the file holds, for each row."""
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "ids"]
        ids = batch.column(batch.schema.get_field_index("ids"))
        values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], [*rest, "n_tokens", "ids_crc32"])


def places(files: DataFrame) -> DataFrame:
    """(part, offset): the ids of all ranges before each; from the files' metadata columns, one row for each range."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("ids_of_part"))
    return sums.select("part", F.coalesce(F.sum("ids_of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files, read them back: id, start, n_tokens and ids_crc32 of each document."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-ids")
    write(docs, path, tokenizer, id_col, text_col, end_id)
    files = read(spark, path)
    kind = dict(files.dtypes)[id_col]
    # written here, as it must run in small batches: 10,000 rows of ids at a time are too much for a task
    back = written(files.select(id_col, "part", "local_start", "ids").mapInArrow(checksums, f"{id_col} {kind}, part int, local_start long, n_tokens long, ids_crc32 long"), "token-checksums")
    return back.join(places(files), "part").select(id_col, (F.col("local_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
