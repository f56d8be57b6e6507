"""Media columns: a data source over archives of media members.

An archive is a ZIP file of uncompressed members with its directory at the end. The writer is a sink of the data source
``media_archive``: each task streams its members into archives of about ARCHIVE_BYTES under names of its own, and reports
the names; the driver's commit writes a manifest of its own (Parquet: names, bytes, members) of the tasks that succeeded,
so archives of lost or repeated tasks are never read, and a later append only adds a manifest. An overwrite's manifest
names those that it replaces; they don't count from the moment it is there, and are then deleted with their archives.

The reader takes the archives of all manifests in force and plans partitions as byte ranges over them, without opening
them: RANGE_BYTES each, or more where there would be more than MAX_RANGES. A task reads its archive's directory (from the
file's tail), takes the members whose header begins in its range, and streams them as Arrow batches of about BATCH_BYTES.
Each member is read by its own offset and checked (CRC-32, length); a failure is retried for that member alone, TRIES
times, and then raises, or gives a row with an error and no bytes (option ``onError`` = ``row``). So does a directory
that can't be read: one row for its range.

A payload is stored losslessly as the 8-bit samples of a PNG image 64 samples wide: its bytes, padded with 0 to a positive
multiple of 64. Members are named by row: id, unpadded length, number. Files are reached through pyarrow's file systems,
so paths may be local, HDFS or object-store URIs.

Edge cases: null or empty text is one row of zero samples; ids may be null or repeat, and string ids may hold any
character; equal texts give equal stored bytes; texts of any length are one member; an empty table gives an empty
manifest and no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from citeweave.llm.common import fresh_path, pieces, small_batches

WIDTH, ARCHIVE_BYTES, RANGE_BYTES, MAX_RANGES, BATCH_BYTES, TRIES = 64, 256 << 20, 8 << 20, 200_000, 2 << 20, 3
SCHEMA = "archive string, offset long, name string, media binary, error string"
MANIFESTS = "_manifests"
#: Fixed values of the PNG format.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of ``payload`` (a positive multiple of 64 bytes), rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    scan = np.zeros((len(rows), WIDTH + 1), np.uint8)
    scan[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such an image, checked."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    scan = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if scan[:, 0].any():
        raise ValueError("filtered rows")
    return scan[:, 1:].tobytes()


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    archives: list


def _manifests(files, base: str) -> dict[str, pa.Table]:
    """The manifests in force, by name."""
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(f"{base}/{MANIFESTS}", allow_not_found=True))
    tables = {}
    for info in found:
        if info.base_name.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                tables[info.base_name] = pq.read_table(f)
    replaced = {n for t in tables.values() for n in t.schema.metadata[b"replaces"].decode().split()}
    return {n: t for n, t in tables.items() if n not in replaced}


class _Stream:
    """A file that zipfile can only append to."""

    def __init__(self, out) -> None:
        self._out = out

    def write(self, data: bytes) -> int:
        self._out.write(data)
        return len(data)

    def flush(self) -> None:
        self._out.flush()


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows (name string, media binary) into archives."""

    def __init__(self, path: str, size: int, overwrite: bool) -> None:
        self.path, self.size, self.overwrite = path, size, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = _files(self.path)
        files.create_dir(base, recursive=True)
        archives: list[dict] = []
        out = archive = None
        members = held = 0

        def close() -> None:
            nonlocal out, archive
            if archive is not None:
                archive.close()
                archives[-1] |= {"bytes": out.tell(), "members": members}
                out.close()
                out = archive = None

        for batch in iterator:
            for name, media in zip(batch.column("name"), batch.column("media")):
                if archive is None:
                    archives.append({"name": f"{uuid.uuid4().hex}.zip"})
                    out, members, held = files.open_output_stream(f"{base}/{archives[-1]['name']}"), 0, 0
                    archive = zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED, allowZip64=True)
                data = media.as_py()
                archive.writestr(zipfile.ZipInfo(name.as_py()), data)
                members, held = members + 1, held + len(data)
                if held >= self.size:
                    close()
        close()
        return _Written(archives)

    def commit(self, messages: list) -> None:
        files, base = _files(self.path)
        files.create_dir(f"{base}/{MANIFESTS}", recursive=True)
        before = _manifests(files, base) if self.overwrite else {}
        rows = [a for m in messages if m for a in m.archives]
        table = pa.table([pa.array([r[c] for r in rows], t) for c, t in (("name", pa.string()), ("bytes", pa.int64()), ("members", pa.int64()))], ["name", "bytes", "members"])
        with files.open_output_stream(f"{base}/{MANIFESTS}/{uuid.uuid4().hex}.parquet") as out:
            pq.write_table(table.replace_schema_metadata({"replaces": " ".join(before)}), out)
        for name, old in before.items():
            for archive in old.column("name").to_pylist():
                files.delete_file(f"{base}/{archive}")
            files.delete_file(f"{base}/{MANIFESTS}/{name}")

    def abort(self, messages: list) -> None:
        files, base = _files(self.path)
        for m in messages:
            for a in m.archives if m else ():
                files.delete_file(f"{base}/{a['name']}")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    """Plans byte ranges of the archives; reads each range's members."""

    def __init__(self, path: str, step: int, tries: int, on_error: str) -> None:
        self.path, self.step, self.tries, self.on_error = path, step, tries, on_error

    def partitions(self) -> list[InputPartition]:
        files, base = _files(self.path)
        archives = [(n, size) for t in _manifests(files, base).values() for n, size in zip(t.column("name").to_pylist(), t.column("bytes").to_pylist())]
        step = max(self.step, sum(size for _, size in archives) // MAX_RANGES)
        return [ByteRange(n, at, min(at + step, size)) for n, size in archives for at in range(0, size, step)] or [ByteRange("", 0, 0)]

    def _members(self, files, path: str) -> list[zipfile.ZipInfo]:
        """An archive's directory."""
        why: Exception | None = None
        for _ in range(self.tries):
            try:
                with files.open_input_file(path) as f:
                    return zipfile.ZipFile(f).infolist()
            except (OSError, ValueError, struct.error, zipfile.BadZipFile) as e:
                why = e
        raise OSError(f"{path}: {why}")

    def _member(self, files, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset, in a handle of its own after a failure."""
        why: Exception | None = None
        for _ in range(self.tries):
            try:
                with files.open_input_file(path) as f:
                    return self._read(f, info)
            except (OSError, ValueError, struct.error) as e:
                why = e
        raise OSError(f"{path} at {info.header_offset}: {why}")

    @staticmethod
    def _read(f, info: zipfile.ZipInfo) -> bytes:
        f.seek(info.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member header here")
        names = sum(struct.unpack_from("<HH", head, 26))
        f.seek(info.header_offset + 30 + names)
        data = f.read(info.file_size)
        if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise ValueError("damaged member")
        return data

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, base = _files(self.path)
        path = f"{base}/{partition.archive}"
        rows: list[tuple] = []
        held = 0
        try:
            members = [i for i in self._members(files, path) if partition.start <= i.header_offset < partition.end]
        except OSError as e:
            if self.on_error != "row":
                raise
            yield self._batch([(partition.archive, partition.start, None, None, str(e))])
            return
        with files.open_input_file(path) as f:
            for info in members:
                data = error = None
                try:
                    data = self._read(f, info)
                except (OSError, ValueError, struct.error):
                    try:
                        data = self._member(files, path, info)
                    except OSError as e:
                        if self.on_error != "row":
                            raise
                        error = str(e)
                rows.append((partition.archive, info.header_offset, info.filename, data, error))
                held += len(data or b"")
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"archive": pa.string(), "offset": pa.int64(), "name": pa.string(), "media": pa.binary(), "error": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


class MediaArchive(DataSource):
    """``format("media_archive")``; options path, rangeBytes, archiveBytes, tries, onError (fail or row)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        return ArchiveReader(o["path"], int(o.get("rangeBytes", RANGE_BYTES)), int(o.get("tries", TRIES)), o.get("onError", "fail"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)), overwrite)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "append", **options: str) -> None:
    """Store each text of ``docs`` as a member of the archives under ``path``."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in pieces(batches, "_text", 1 << 20):
            names, media = [], []
            for i, t in zip(batch.column("_id").to_pylist(), batch.column("_text").cast(pa.binary())):
                data = t.as_py() or b""
                names.append(f"{'n' if i is None else 'v' + quote(str(i), safe='')}_{len(data)}_{number}.png")
                media.append(to_png(padded(data)))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], ["name", "media"])

    members = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "name string, media binary")
    with small_batches(spark):
        members.write.format("media_archive").options(**options).mode(mode).save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The members: archive, offset, name, media, error."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


def feature(payload: bytes) -> str:
    """Of the samples, all whole numbers: mean, mean square, largest and crossings of 128, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"mean={int(x.sum()) / len(x):.4f};power={int((x * x).sum()) / len(x):.4f};peak={int(x.max())};crossings={crossings}"


def described(members: DataFrame, id_kind: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """The digests and features of members, from the stored bytes."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, media in zip(batch.column("name").to_pylist(), batch.column("media")):
                media = media.as_py()
                own, size, _ = name.rsplit("_", 2)
                data = from_png(media)
                rows.append((None if own == "n" else unquote(own[1:]), int(size), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    out = members.where("error is null").select("name", "media").mapInArrow(run, f"{id_col} string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumn(id_col, F.col(id_col).cast(id_kind))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Store ``docs``, read the archives back and describe each member."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "media")
    write(docs, path, id_col, text_col)
    return described(read(spark, path), dict(docs.dtypes)[id_col], id_col)
