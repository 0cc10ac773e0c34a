"""Tables whose files are listed in a log: each record says which files a change takes away and which it adds.

A reader sees the files of one record or of the next, never a part. Each file is listed with its range of keys and of times,
so that a change looks for its keys only where they can lie, and the newest rows are read only from files that can hold them.
A list of a hundred thousand files is some twenty MB on the driver.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.commits import Log

#: Bytes of a file after compaction.
FILE_BYTES = 256 << 20
#: Rows of a compacted file at most, near enough: rows that compress well are many in few bytes, and a task sorts them.
FILE_ROWS = 1_000_000


class History:
    """A table at ``path`` with one row (or group of rows) a key, those that were put last; rows whose key is null are only
    added. ``when`` names the time by which rows are the newest. Columns that later rows bring are null in earlier ones."""

    def __init__(self, path: str, key: str, when: str | None = None):
        self.path, self.key, self.when, self._log = path.rstrip("/"), key, when, None

    def log(self, spark: SparkSession | None = None) -> Log:
        if self._log is None:
            self._log = Log(f"{self.path}/_log", ["files", "table"], spark)
        return self._log

    def listed(self) -> dict[str, dict]:
        """Each file with its rows, bytes, least and greatest key, rows with a time, least and greatest time (microseconds)."""
        return dict(self.log().read()["files"])

    def _schema(self, now: dict) -> T.StructType | None:
        held = now["table"].get("schema")
        return T.StructType.fromJson(json.loads(held)) if held else None

    def _merged(self, now: dict, rows: DataFrame) -> T.StructType:
        fields = {f.name: f for f in (self._schema(now) or [])}
        for f in rows.schema:
            if f.name in fields and fields[f.name].dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"{self.path}: {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
            fields.setdefault(f.name, f)
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()])

    def _read(self, spark: SparkSession, names, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in sorted(names)])

    def _written(self, rows: DataFrame) -> dict[str, dict]:
        """New files with ``rows``, not listed yet, and what the list is to say of them."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        held = rows.sparkSession.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
        at = F.unix_micros(F.col(self.when)) if self.when else F.lit(None).cast("long")
        per = held.select("_metadata.file_name", "_metadata.file_size", F.col(self.key).cast("string").alias("k"), at.alias("t")).groupBy("file_name", "file_size")
        found = per.agg(F.count("*").alias("rows"), F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.count("t").alias("timed"), F.min("t").alias("oldest"), F.max("t").alias("newest"))
        return {f"{folder}/{r['file_name']}": {"bytes": r["file_size"]} | {k: r[k] for k in ("rows", "first_key", "last_key", "timed", "oldest", "newest")} for r in found.collect()}

    def put(self, rows: DataFrame) -> None:
        """Takes ``rows`` for their keys. Of the files that are there only those that hold one of the keys are written again;
        if another driver's change comes first, they are looked for once more."""
        spark, added = rows.sparkSession, self._written(rows)
        if not added:
            return
        rows = spark.read.schema(rows.schema).parquet(*[f"{self.path}/{n}" for n in added])
        keys = rows.select(self.key).distinct()
        known = [s for s in added.values() if s["first_key"] is not None]

        def decide(now: dict) -> dict:
            schema = self._merged(now, rows)
            apart = lambda s: s["first_key"] is None or not any(s["first_key"] <= a["last_key"] and a["first_key"] <= s["last_key"] for a in known)
            near = [n for n, s in now["files"].items() if not apart(s)]
            change = dict(added)
            if near:
                of = self._read(spark, near, schema).select(F.col("_metadata.file_path").alias("f"), self.key).join(keys, self.key, "left_semi")
                touched = {"/".join(r["f"].split("/")[-3:]) for r in of.select("f").distinct().collect()}
                if touched:
                    change |= dict.fromkeys(touched) | self._written(self._read(spark, touched, schema).join(keys, self.key, "left_anti"))
            return {"files": change} | ({} if now["table"].get("schema") == schema.json() else {"table": {"schema": schema.json()}})

        self.log(spark).commit(decide)

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """All rows; None before the first."""
        now = self.log(spark).read()
        return self._read(spark, now["files"], self._schema(now)) if now["files"] else None

    def holding_newest(self, n: int) -> tuple[list[str], int | None]:
        """The files that can hold one of the ``n`` newest rows, and a time that none of these rows is older than (None: unknown).

        Files are taken by their oldest row, the newest first, until they hold n rows: nothing older than all of them counts.
        """
        files, taken = self.listed(), 0
        for s in sorted((s for s in files.values() if s["timed"]), key=lambda s: -s["oldest"]):
            taken += s["timed"]
            if taken >= n:
                return [name for name, f in files.items() if f["timed"] and f["newest"] >= s["oldest"]], s["oldest"]
        return list(files), None

    def newest(self, spark: SparkSession, n: int) -> DataFrame | None:
        """The ``n`` newest rows, of equal ones those of the least key; rows without a time come last."""
        now = self.log(spark).read()
        if not now["files"]:
            return None
        names, least = self.holding_newest(n)
        rows = self._read(spark, names, self._schema(now))
        rows = rows if least is None else rows.filter(F.col(self.when) >= F.timestamp_micros(F.lit(least)))
        return rows.orderBy(F.desc(self.when), self.key).limit(n)

    def span(self) -> tuple[datetime | None, datetime | None]:
        """The times of the oldest and the newest row, from the list alone."""
        timed = [s for s in self.listed().values() if s["timed"]]
        at = lambda us: datetime.fromtimestamp(us // 1_000_000, UTC).replace(microsecond=us % 1_000_000, tzinfo=None)
        return (at(min(s["oldest"] for s in timed)), at(max(s["newest"] for s in timed))) if timed else (None, None)

    def count(self) -> int:
        return sum(s["rows"] for s in self.listed().values())

    def bytes(self) -> int:
        return sum(s["bytes"] for s in self.listed().values())

    def compact(self, spark: SparkSession) -> None:
        """The same rows in files of some 256 MB or a million rows, each of a range of times (keys, where there is no time) of its own."""
        by = [c for c in (self.when, self.key) if c]

        def decide(now: dict) -> dict | None:
            if len(now["files"]) < 2:
                return None
            parts = max(1, *[math.ceil(sum(s[k] for s in now["files"].values()) / most) for k, most in (("bytes", FILE_BYTES), ("rows", FILE_ROWS))])
            rows = self._read(spark, now["files"], self._schema(now)).repartitionByRange(parts, *by).sortWithinPartitions(*by)
            return {"files": dict.fromkeys(now["files"]) | self._written(rows)}

        self.log(spark).commit(decide)

    def vacuum(self, spark: SparkSession, hours: float = 24.0) -> int:
        """Deletes files that are not listed and older than ``hours``: readers of earlier records and unfinished changes of
        other drivers need younger ones. Returns how many."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return 0
        kept, before, gone = self.listed(), (time.time() - 3600 * hours) * 1000, 0
        for folder in system.listStatus(path):
            for file in system.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{file.getPath().getName()}"
                if name.endswith(".parquet") and name not in kept and file.getModificationTime() < before:
                    gone += system.delete(file.getPath(), False)
        return gone
