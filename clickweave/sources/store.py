"""Stored tables that change only by whole runs.

A run writes Parquet folders ``<table>/run=<id>/<part>=<value>`` and then commits: one small
file ``_commits/<number>.json`` names, for every part of every table, the runs that make it up.
Readers follow the newest commit, so what a run has written is seen all at once or not at
all; a run that stopped half-way left folders that nobody reads, and the same run again writes
them anew. A run already committed is not begun again.

Rows join a part, or correct rows of it. A correction is a row of the same key, and a function
given by the table makes one row of all rows of a key. With a fan-in of 1 a run copies on
write: it merges the parts it corrects and takes the place of their earlier runs. Otherwise
corrections wait: once that many runs of a part lie on a level, the run that is the last of
them merges them into one of the next level. A part is then read from a few runs a level, and a
row is written once a level, so a run costs what its own rows cost, however many came before.

A commit holds names and numbers only: as many entries as there are parts in use.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of a bucket on one level before they are merged.
FAN_IN = 8
#: Hash buckets of a table of partial results.
BUCKETS = 64

DATE, BUCKET = "event_date", "bucket"
Merged = Callable[[DataFrame], DataFrame]
PART_TYPES = {DATE: T.DateType(), BUCKET: T.IntegerType()}


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Files:
    """The few file operations of a commit, on whatever store the path names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._folder = self._path(f"{root}/_commits")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def newest(self) -> tuple[int, str] | None:
        """Number and text of the newest commit."""
        if not self._fs.exists(self._folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return None
        stream = self._fs.open(self._path(f"{self._folder}/{max(numbers):020d}.json"))
        try:
            return max(numbers), self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, number: int, text: str, run: str) -> None:
        """A commit under its number; fails if another run has taken it."""
        draft, final = self._path(f"{self._folder}/.{run}.draft"), self._path(f"{self._folder}/{number:020d}.json")
        stream = self._fs.create(draft, True)
        try:
            self._jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another run has made commit {number}; run {run} again")


class Store:
    """Stored tables below ``root`` as of the newest commit."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._files = Files(spark, self.root)
        found = self._files.newest()
        self.number, text = found or (-1, '{"runs": [], "tables": {}}')
        commit = json.loads(text)
        self.runs: list[str] = commit["runs"]
        #: Per table and part: ``[run, level, whether it may hold corrections of other runs]``.
        self.tables: dict[str, dict] = commit["tables"]

    def parts(self, table: str) -> dict[str, list[list]]:
        return self.tables.get(table, {})

    def has(self, table: str) -> bool:
        return table in self.tables

    def _rows(self, table: str, by: str, schema: T.StructType, entries: list[tuple[str, str]]) -> DataFrame:
        full = T.StructType([*[f for f in schema.fields if f.name != by], T.StructField(by, PART_TYPES[by])])
        if not entries:
            return self.spark.createDataFrame([], full)
        base = f"{self.root}/{table}"
        paths = [f"{base}/run={run}/{by}={part}" for part, run in entries]
        reader = self.spark.read.schema(T.StructType([*full.fields, T.StructField("run", T.StringType())]))
        return reader.option("basePath", base).parquet(*paths).select(*full.fieldNames())

    def read(
        self, table: str, by: str, schema: T.StructType, merged: Merged | None = None, parts: list[str] | None = None
    ) -> DataFrame:
        """Rows of a table, of ``parts`` only if given, its part column last. Parts with corrections go
        through ``merged``; without it the rows come as they are stored."""
        plain, corrected = [], []
        for part, runs in self.parts(table).items():
            if parts is None or part in parts:
                waiting = merged is not None and any(open_ for _, _, open_ in runs)
                (corrected if waiting else plain).extend((part, run) for run, _, _ in runs)
        rows = self._rows(table, by, schema, plain)
        if not corrected:
            return rows
        done = merged(self._rows(table, by, schema, corrected))
        return rows.unionByName(done) if plain else done.select(*rows.columns)

    def begin(self, run: str) -> Run | None:
        """A run of that name, or None if it has been committed."""
        return None if run in self.runs else Run(self, run)


class Run:
    """One change of the store; nothing is seen of it before ``commit``."""

    def __init__(self, store: Store, name: str) -> None:
        self.store, self.name = store, name
        self.tables = json.loads(json.dumps(store.tables))

    def _entries(self, table: str) -> dict[str, list[list]]:
        return self.tables.setdefault(table, {})

    def _write(self, df: DataFrame, table: str, by: str) -> list[str]:
        """Writes rows below the run's folder; the parts that were written."""
        path = f"{self.store.root}/{table}/run={self.name}"
        df.write.mode("overwrite").partitionBy(by).parquet(path)
        files = self.store._files
        folder = files._path(path)
        names = [s.getPath().getName() for s in files._fs.listStatus(folder) if s.isDirectory()]
        return [n.removeprefix(f"{by}=") for n in names if n.startswith(f"{by}=")]

    def add(self, df: DataFrame, table: str, by: str = DATE) -> None:
        """Rows of ``df``, all of them new, join their parts."""
        entries = self._entries(table)
        for part in self._write(df, table, by):
            entries.setdefault(part, []).append([self.name, 0, False])

    def merge(
        self, rows: DataFrame, table: str, by: str, merged: Merged, corrected: set[str] | None = None,
        fan_in: int = FAN_IN, laid: Merged | None = None,
    ) -> None:
        """``rows``, new ones and corrections, join their parts; ``corrected`` names the parts that
        have corrections among them, where that is known. ``laid`` puts rows in the order they are stored in."""
        entries = self._entries(table)
        # What will be merged is known before anything is written.
        levels: dict[str, int] = {}
        for part, runs in entries.items():
            if fan_in == 1:
                if corrected is None or part in corrected:
                    levels[part] = 1 + max(at for _, at, _ in runs)
                continue
            level, count = 0, 1
            while (count := count + sum(at == level for _, at, _ in runs)) >= fan_in:
                level, count = level + 1, 1
            if level:
                levels[part] = level
        if levels:
            # Only parts that get rows are merged now.
            here = parts_of(rows, by)
            levels = {part: level for part, level in levels.items() if part in here}
        old = [(part, run) for part, level in levels.items() for run, at, _ in entries[part] if at < level]
        if old:
            schema = T.StructType([f for f in rows.schema.fields if f.name != by])
            known = self.store._rows(table, by, schema, old)
            # Parts that are not merged have nothing to be merged with.
            rows = merged(rows.unionByName(known))
        # A part with most of the rows is still written by many tasks.
        rows = laid(rows) if laid else rows.hint("rebalance", by)
        for part in self._write(rows, table, by):
            kept = [e for e in entries.get(part, []) if e[1] >= levels.get(part, 0)]
            told = corrected is None or part in corrected or any(e[2] for e in entries.get(part, []))
            waits = bool(kept) and told
            level = 0 if fan_in == 1 else levels.get(part, 0)
            entries[part] = [*kept, [self.name, level, waits]]

    def commit(self) -> None:
        text = json.dumps({"runs": [*self.store.runs, self.name], "tables": self.tables})
        self.store._files.write(self.store.number + 1, text, self.name)


def _name(value) -> str:
    """A part's value as its folder spells it."""
    return "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def buckets_of(df: DataFrame, keys: list[str], buckets: int) -> list[str]:
    """The buckets that rows of ``df`` fall into, at most ``buckets``."""
    return sorted(_name(r[0]) for r in df.select(bucket_of(keys, buckets)).distinct().collect())


def parts_of(df: DataFrame, by: str) -> set[str]:
    """The parts that rows of ``df`` belong to."""
    return {_name(r[0]) for r in df.select(by).distinct().collect()}
