"""Parquet tables whose files are known by the range of keys they hold.

A merge asks which files a batch's keys can lie in, reads those alone, and replaces those alone. The ranges are kept in
a hidden folder of the table as a cache: a file is immutable and named once, so what the cache lacks is measured and what it
has for files that are gone is ignored. A replacement is logged before it starts and finished by whoever comes next, so a
driver lost in between leaves a table that the next merge completes. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aisleworks.session import CODEC, short_lived_shuffles

#: Hidden folders of a table: key ranges by file, replacements under way, their new files, and batches not yet merged in.
RANGES, PENDING, STAGED, DELTAS = "_key_ranges", "_pending", "_staged", "_deltas"
#: Stretches, at least and at most, into which a batch's sorted keys are cut to be compared with the files' ranges, and keys
#: of a stretch between these bounds.
LEAST_SPANS, MOST_SPANS, SPAN_KEYS = 8, 512, 64
#: Rows of a file, and files of ranges after which they are written as one.
FILE_ROWS, RANGE_FILES = 4_000_000, 40
#: Rows that are merged at a time, so that the disk their shuffles take is bounded.
SLICE_ROWS = 24_000_000
#: Bytes below which a file counts as small, and small files that are worth merging.
SMALL_BYTES, SMALL_FILES = 32 << 20, 16


class Folder:
    """A folder of any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str = "") -> str:
        return f"{self.path}/{name}" if name else self.path

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._new(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._new(self.at(name)))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self._files.delete(self._new(self.at(name)), True)

    def move(self, name: str, to: str) -> None:
        self._files.mkdirs(self._new(self.at(to)).getParent())
        if not self._files.rename(self._new(self.at(name)), self._new(self.at(to))):
            raise OSError(f"{self.at(name)} could not be moved to {self.at(to)}")

    def write(self, name: str, text: str) -> None:
        """The text appears whole under its name or not at all."""
        draft = f"{name}.draft"
        out = self._files.create(self._new(self.at(draft)), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.move(draft, name)

    def read(self, name: str) -> str:
        source = self._files.open(self._new(self.at(name)))
        text = bytes(source.readAllBytes()).decode()
        source.close()
        return text


@dataclass(frozen=True)
class KeyedTable:
    """Where a table lies, its columns, the key it merges on and, if its files are dealt to folders, by what.

    ``partition`` is the name of the folder column and the SQL expression that gives it.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    partition: tuple[str, str] | None = None
    file_rows: int = FILE_ROWS
    slice_rows: int = SLICE_ROWS

    @property
    def folder(self) -> Folder:
        return Folder(self.spark, self.path)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def data_files(self, below: str = "") -> list[str]:
        """Names of the data files, relative to the table (or to the hidden folder ``below`` of it)."""
        if not self.folder.exists(below):
            return []
        depth = 2 if self.partition else 1
        found = self.spark.read.schema(self.schema).parquet(self.folder.at(below)).inputFiles()
        return sorted("/".join(name.split("/")[-depth:]) for name in found)

    def read(self, files: list[str]) -> DataFrame:
        """The rows of some data files."""
        if not files:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", self.path)
        return reader.parquet(*[self.folder.at(name) for name in files]).select(self.columns)

    def write(self, rows: DataFrame, name: str) -> None:
        """Rows as files of disjoint key ranges, below the table's folder."""
        order = list(self.keys)
        rows = rows.select(self.columns)
        if self.partition:
            column, rule = self.partition
            rows, order = rows.withColumn(column, F.expr(rule)), [column, *order]
        writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").option("compression", CODEC)
        writer = writer.option("maxRecordsPerFile", self.file_rows)
        if self.partition:
            writer = writer.partitionBy(self.partition[0])
        with short_lived_shuffles(self.spark):
            writer.parquet(self.folder.at(name))

    # --- key ranges ---------------------------------------------------------
    def ranges(self) -> dict[str, Row]:
        """Smallest and largest key, rows and bytes of each data file; files not yet measured are measured here."""
        present = set(self.data_files())
        known: dict[str, Row] = {}
        parts = [n for n in self.folder.names(RANGES) if n.startswith("part-")]
        if parts:
            known = {r["file"]: r for r in self.spark.read.parquet(self.folder.at(RANGES)).collect() if r["file"] in present}
        missing = sorted(present - known.keys())
        if missing:
            depth = 2 if self.partition else 1
            key = F.struct(*[F.col(k) for k in self.keys])
            whole = F.lit(True)
            for k in self.keys:  # a row without a whole key matches no batch
                whole = whole & F.col(k).isNotNull()
            reader = self.spark.read.schema(self.schema).option("basePath", self.path)
            measured = reader.parquet(*[self.folder.at(name) for name in missing]).groupBy(
                F.array_join(F.slice(F.split("_metadata.file_path", "/"), -depth, depth), "/").alias("file")
            ).agg(
                F.min(F.when(whole, key)).alias("low"),
                F.max(F.when(whole, key)).alias("high"),
                F.count(F.lit(1)).alias("rows"),
                F.max("_metadata.file_size").alias("bytes"),
            )
            measured.coalesce(1).write.mode("append").parquet(self.folder.at(RANGES))
            known |= {r["file"]: r for r in self.spark.read.parquet(self.folder.at(RANGES)).collect() if r["file"] in present}
            if len(parts) >= RANGE_FILES:
                again = self.spark.createDataFrame(list(known.values()), self.spark.read.parquet(self.folder.at(RANGES)).schema)
                self.folder.delete(RANGES)
                again.coalesce(1).write.parquet(self.folder.at(RANGES))
        return known

    def touched(self, batch: DataFrame, spans: list[tuple] | None = None) -> list[str]:
        """The data files whose range meets a key of the batch's; a few more where keys between two of the batch's lie there."""
        ranges = [(name, tuple(r["low"]), tuple(r["high"])) for name, r in self.ranges().items() if r["low"] is not None]
        if not ranges:
            return []
        spans = self.stretches(batch) if spans is None else spans
        highs = [high for _, high in spans]
        out = []
        for name, low, high in ranges:
            place = bisect_left(highs, low)
            if place < len(spans) and spans[place][0] <= high:
                out.append(name)
        return sorted(out)

    def stretches(self, batch: DataFrame) -> list[tuple]:
        """Lowest and highest keys of stretches, about equally long, into which the batch's sorted keys are cut."""
        with short_lived_shuffles(self.spark):
            key = F.struct(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys])
            kept = batch.select(key.alias("key")).where(" AND ".join(f"key.`{k}` IS NOT NULL" for k in self.keys)).distinct()
            spans = min(MOST_SPANS, max(LEAST_SPANS, kept.count() // SPAN_KEYS))
            stretch = kept.repartitionByRange(spans, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("low"), F.max("key").alias("high"))
            return sorted((tuple(r["low"]), tuple(r["high"])) for r in stretch.collect())

    def slices(self, spans: list[tuple], rows: int) -> list[Column]:
        """Conditions on the keys that cut rows into stretches of keys, of ``slice_rows`` rows or so; each row meets one."""
        count = min(-(-rows // self.slice_rows), len(spans))
        cuts = [spans[len(spans) * k // count][0] for k in range(1, count)] if count > 1 else []
        if not cuts:
            return [F.lit(True)]
        kinds = [self.schema[k].dataType for k in self.keys]
        keys = [F.col(k).cast(kind) for k, kind in zip(self.keys, kinds)]
        # a single key is compared as it is, which a scan can use to leave rows out
        key = keys[0] if len(keys) == 1 else F.struct(*keys)
        at = [[F.lit(v).cast(kind) for v, kind in zip(cut, kinds)] for cut in cuts]
        at = [values[0] if len(keys) == 1 else F.struct(*values) for values in at]
        missing = F.lit(False)
        for k in keys:
            missing = missing | k.isNull()
        inner = [~missing & (key >= low) & (key < high) for low, high in zip(at, at[1:])]
        return [missing | (key < at[0]), *inner, ~missing & (key >= at[-1])]

    # --- changes ------------------------------------------------------------
    def append(self, rows: DataFrame) -> None:
        """Adds files with the rows."""
        self._replace([rows], [], [])

    def replace(self, rows: DataFrame | Iterable[DataFrame], old: list[str], merged: list[str] | None = None) -> None:
        """Puts files with the rows in the place of ``old`` ones; ``merged`` names delta folders that are done with.

        Rows given as several tables are written one after the other and take their place together.
        """
        self._replace([rows] if isinstance(rows, DataFrame) else rows, old, merged or [])

    def _replace(self, parts: Iterable[DataFrame], old: list[str], merged: list[str]) -> None:
        change = uuid.uuid4().hex
        for rows in parts:
            self.write(rows, f"{STAGED}/{change}")
        if not old and self.spark.read.schema(self.schema).parquet(self.folder.at(f"{STAGED}/{change}")).isEmpty():
            self.folder.delete(f"{STAGED}/{change}")
            return
        self.folder.write(f"{PENDING}/{change}.json", json.dumps({"old": old, "merged": merged}))
        self.recover()

    def recover(self) -> None:
        """Finishes replacements that were logged; new files of a change that was not are deleted."""
        folder = self.folder
        for name in [n for n in folder.names(PENDING) if n.endswith(".json")]:
            change = name.removesuffix(".json")
            change_folder, logged = f"{STAGED}/{change}", json.loads(folder.read(f"{PENDING}/{name}"))
            for new in self.data_files(change_folder):
                folder.move(f"{change_folder}/{new}", new)
            for gone in logged["old"]:
                folder.delete(gone)
            for delta in logged["merged"]:
                folder.delete(f"{DELTAS}/{delta}")
            folder.delete(change_folder)
            folder.delete(f"{PENDING}/{name}")
        for change in folder.names(STAGED):
            folder.delete(f"{STAGED}/{change}")

    def merge_small_files(self, small_bytes: int = SMALL_BYTES, at_least: int = SMALL_FILES) -> int:
        """Writes small files as one sorted run where there are ``at_least`` of them; returns how many were merged."""
        self.recover()
        small = sorted(name for name, r in self.ranges().items() if r["bytes"] < small_bytes)
        if len(small) < at_least:
            return 0
        self.replace(self.read(small), small)
        return len(small)
