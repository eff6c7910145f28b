"""Single text files as a data source: one row a file, (path, content), read by size in parallel and written with a commit.

Python tasks open the files, so that paths must lie in a folder that driver and executors have mounted."""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from ..session import scratch

FORMAT = "single_files"
#: Bytes that one task reads.
SPLIT = 64 << 20


def mounted(name: str) -> Path:
    if "://" in name and not name.startswith("file://"):
        raise ValueError(f"single files are in mounted folders only: {name}")
    return Path(name.removeprefix("file://"))


@dataclass
class Files(InputPartition):
    names: list[str]


def _test(f: Filter):
    """A filter on the path as a function, or None where it is not one."""
    if getattr(f, "attribute", None) != ("path",):
        return None
    kinds = {EqualTo: lambda p: p == f.value, In: lambda p: p in f.value, StringStartsWith: lambda p: p.startswith(f.value), StringEndsWith: lambda p: p.endswith(f.value), StringContains: lambda p: f.value in p}
    return kinds.get(type(f))


class _Reader(DataSourceReader):
    def __init__(self, root: str, pattern: str, split: int):
        self.root, self.pattern, self.split, self.tests = root, pattern, split, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the path are met by not opening the file; the others are left to Spark."""
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Files]:
        base = mounted(self.root)
        if not base.exists():
            raise FileNotFoundError(self.root)
        names = [str(p) for p in base.rglob("*")] if base.is_dir() else [str(base)]
        names = sorted(n for n in names if fnmatch.fnmatch(os.path.basename(n), self.pattern) and not os.path.basename(n).startswith(".") and os.path.isfile(n) and all(t(n) for t in self.tests))
        out, held = [Files([])], 0
        for n in names:
            if held > self.split:
                out.append(Files([]))
                held = 0
            out[-1].names.append(n)
            held += os.path.getsize(n)
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for n in partition.names:
            yield n, Path(n).read_text(encoding="utf-8", errors="replace")


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Every task writes hidden files beside the final ones and says which; the commit renames them, so that a reader sees a file
    whole or not at all, and what a failed or repeated attempt has staged is never one of them.  Which folders are written to
    is noted in a folder of the job, so that what killed attempts leave is found and taken away."""

    def __init__(self, notes: str | None):
        self.job, self.notes = uuid.uuid4().hex, notes
        if notes:
            Path(notes).mkdir(parents=True, exist_ok=True)

    def _stopped(self) -> bool:
        return bool(self.notes) and os.path.exists(f"{self.notes}/{self.job}.stopped")

    def write(self, rows: Iterator) -> Staged:
        files: list[tuple[str, str]] = []
        folders: set[Path] = set()
        try:
            for row in rows:
                at = mounted(row.path)
                if at.parent not in folders:
                    at.parent.mkdir(parents=True, exist_ok=True)
                    folders.add(at.parent)
                    if self.notes:
                        Path(self.notes, f"{self.job}.{uuid.uuid4().hex}").write_text(str(at.parent))
                staged = at.parent / f".{at.name}.{self.job}.{uuid.uuid4().hex}"
                files.append((str(staged), str(at)))
                staged.write_text(row.content or "", encoding="utf-8", newline="")
                if self._stopped():
                    raise RuntimeError("the job has been stopped")
        except BaseException:
            self._drop(files)
            raise
        return Staged(files)

    @staticmethod
    def _drop(files: list[tuple[str, str]]) -> None:
        for staged, _ in files:
            Path(staged).unlink(missing_ok=True)

    def _sweep(self) -> None:
        if self.notes:
            Path(self.notes, f"{self.job}.stopped").touch()
            for folder in {n.read_text() for n in Path(self.notes).glob(f"{self.job}.*") if n.suffix != ".stopped"}:
                for left in Path(folder).glob(f".*.{self.job}.*"):
                    left.unlink(missing_ok=True)

    def commit(self, messages: list[Staged | None]) -> None:
        for m in messages:
            for staged, final in m.files if m else ():
                os.replace(staged, final)
        self._sweep()

    def abort(self, messages: list[Staged | None]) -> None:
        for m in messages:
            self._drop(m.files if m else [])
        self._sweep()


class SingleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options.get("notes"))


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(SingleFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_files(spark: SparkSession, root: str, pattern: str = "*", split: int = SPLIT) -> DataFrame:
    """(path, content) of the files below a folder; conditions on ``path`` decide which are opened."""
    return _registered(spark).read.format(FORMAT).option("pattern", pattern).option("split", split).load(root)


def write_files(df: DataFrame, path: str = "path", content: str = "content") -> None:
    """One text file a row, at the row's path; all files appear when the job has ended, none if it fails.  A null text is an empty
    file; of rows with one path any may win."""
    out = df.select(F.col(path).cast("string").alias("path"), F.col(content).cast("string").alias("content")).write.format(FORMAT).mode("append")
    notes = scratch(_registered(df.sparkSession), "notes")
    (out if "://" in notes.removeprefix("file://") else out.option("notes", notes.removeprefix("file://"))).save()
