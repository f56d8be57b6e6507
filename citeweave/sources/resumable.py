"""Parts that are written once: a ledger of what is done lets a stopped job go on, and a merge makes one table of it.

A part's name is a digest of what it is made of: the step's version, the caller's key and its input files with their sizes
and times. It is written to a folder of its own, moved to its name when complete, and only then recorded in the ledger
(a small file, written aside and renamed as well). A restart skips what the ledger has; what was half written has another
name and is never read. Inputs that change get another name, so they are done again.

Edge cases: no parts give a table of the schema without rows; a part without rows is recorded like any other; parts whose
schemas differ fail in the merge; two jobs on one folder write equal parts, and the last rename of one wins. Part names
and the ledger (a line a part) are on the driver, rows never.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Ledger:
    def __init__(self, spark: SparkSession, path: str, version: str = "1") -> None:
        self.spark, self.path, self.version = spark, path.rstrip("/"), version
        self._jvm = spark._jvm
        self._files = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def digest(self, key: str, inputs: Sequence[str] = ()) -> str:
        """The name of a part: of its key, version and input files (a folder stands for the files in it)."""
        seen = []
        for at in inputs:
            root = self._of(at)
            walk = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(root, True)
            while walk.hasNext():
                f = walk.next()
                seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return hashlib.sha256(json.dumps([self.version, key, sorted(seen)]).encode()).hexdigest()[:32]

    def done(self) -> dict[str, dict]:
        """Records of finished parts by name."""
        root = self._of(f"{self.path}/ledger")
        if not self._files.exists(root):
            return {}
        names = [s.getPath().getName() for s in self._files.listStatus(root)]
        if not any(n.endswith(".json") for n in names):
            return {}
        lines = self.spark.read.text(f"{self.path}/ledger/*.json", wholetext=True).collect()
        return {r["name"]: r for r in (json.loads(x["value"]) for x in lines)}

    def record(self, entry: dict) -> None:
        aside, place = self._of(f"{self.path}/aside/{uuid.uuid4().hex}"), self._of(f"{self.path}/ledger/{entry['name']}.json")
        self._files.mkdirs(place.getParent())
        out = self._files.create(aside, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self._files.delete(place, False)
        if not self._files.rename(aside, place):
            raise OSError(f"can't record {entry['name']}")

    def write(self, name: str, rows: DataFrame, **about) -> int:
        """Write a part aside, move it to its name, record it; the number of its rows."""
        aside, place = f"{self.path}/aside/{name}-{uuid.uuid4().hex}", f"{self.path}/parts/{name}"
        rows.write.parquet(aside)
        n = self.spark.read.schema(rows.schema).parquet(aside).count()
        self._files.mkdirs(self._of(place).getParent())
        self._files.delete(self._of(place), True)  # of a run that ended between its move and its record
        if not self._files.rename(self._of(aside), self._of(place)):
            raise OSError(f"can't move part {name}")
        self.record({"name": name, "rows": n, **about})
        return n


def write_parts(spark: SparkSession, path: str, parts: dict[str, Sequence[str]], make: Callable[[str, Sequence[str]], DataFrame], version: str = "1") -> dict[str, str]:
    """Make and write each part (key: input files) that the ledger under ``path`` lacks; key -> "written" or "kept".

    ``make`` gets the key and the files. A failure leaves the parts before it in place; another call goes on from there.
    ``version`` names the step: another one is another table of parts.
    """
    ledger = Ledger(spark, path, version)
    finished = ledger.done()
    out = {}
    for key, inputs in parts.items():
        name = ledger.digest(key, inputs)
        if name in finished:
            out[key] = "kept"
            continue
        ledger.write(name, make(key, inputs), key=key, version=version)
        out[key] = "written"
    return out


def merge_parts(spark: SparkSession, path: str, parts: dict[str, Sequence[str]], to: str, schema: StructType | str | None = None, version: str = "1") -> DataFrame:
    """One table of the named parts, all of which must be in the ledger; it is replaced as a whole, so a merge can be repeated."""
    ledger = Ledger(spark, path, version)
    finished, names = ledger.done(), {k: ledger.digest(k, v) for k, v in parts.items()}
    if missing := sorted(k for k, n in names.items() if n not in finished):
        raise ValueError(f"parts that aren't written: {missing}")
    places = [f"{path.rstrip('/')}/parts/{n}" for n in sorted(set(names.values()))]
    if not places and schema is None:
        raise ValueError("no parts and no schema")
    if places:
        kinds = {spark.read.parquet(p).schema.simpleString() for p in places}
        if len(kinds) > 1:
            raise ValueError(f"parts differ: {sorted(kinds)}")
        rows = spark.read.parquet(*places)
    else:
        rows = spark.createDataFrame([], schema)
    rows.write.mode("overwrite").parquet(to)
    out = spark.read.schema(rows.schema).parquet(to)
    if (n := out.count()) != (want := sum(finished[x]["rows"] for x in set(names.values()))):
        raise OSError(f"{n} rows merged, {want} recorded")
    return out
