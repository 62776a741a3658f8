"""Tables that change by numbered commits, so that writers never lose or share work and readers see whole states.

A table's rows lie in folders of Parquet files that are never changed. A commit is a small numbered file that lists the
folders which make up the table from then on, and some metadata. It is created only if there is none of its number, in one
step, and nothing else makes folders part of the table: what fails before leaves the table as it was. Of two writers that
start from the same commit one gets the next number; the other is told (``Conflict``) and starts again from the new state.
Readers keep the folders of the commit that they opened.

Creating a commit takes one call that fails if the name exists: a hard link on local disks, a rename elsewhere, as HDFS has
it. Stores whose rename overwrites can't be used.
"""

from __future__ import annotations

import contextlib
import json
import os
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.storage import remove

TRIES, FIRST_WAIT, MOST_WAIT = 60, 0.05, 2.0
STALE_SECONDS = 3600  # a state read longer ago is read again before a commit


class Conflict(Exception):
    """Another commit has the number that this one was to get."""


@dataclass(frozen=True)
class Snapshot:
    """The table after a commit: number (0 before the first), folders with the number that brought them, metadata."""

    number: int = 0
    folders: tuple[tuple[str, int], ...] = ()
    meta: dict[str, Any] = field(default_factory=dict)
    read_at: float = 0.0


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- files ----
    def _hadoop(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[attr-defined]
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p  # type: ignore[attr-defined]

    def _name(self, number: int) -> str:
        return f"{self.path}/commits/{number:020d}.json"

    def _read(self, path: str) -> str | None:
        fs, p = self._hadoop(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")  # type: ignore[attr-defined]
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        fs, p = self._hadoop(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Whether the file is there now because of this call; its content is whole from the start."""
        draft = f"{self.path}/commits/draft-{uuid.uuid4().hex}"
        self._write(draft, text)
        fs, p = self._hadoop(draft)
        try:
            if fs.getUri().getScheme() != "file":
                return bool(fs.rename(p, self._hadoop(path)[1]))
            try:
                os.link(p.toUri().getPath(), self._hadoop(path)[1].toUri().getPath())
            except FileExistsError:
                return False
            return True
        finally:
            fs.delete(p, False)

    # ---- states ----
    def latest(self) -> Snapshot:
        """The last commit. A hint says where to begin looking; that it may be old, or missing, does no harm."""
        number = self._hint()
        state = self.at(number) if number else None
        if state is None:
            number = max(self._numbers(), default=0)
            state = self.at(number) if number else None
        while (following := self.at(number + 1)) is not None:
            state, number = following, number + 1
        return state or Snapshot(read_at=time.time())

    def _hint(self) -> int:
        """A number that has been committed; 0 if that can't be told, as while another writer replaces the hint."""
        try:
            return int(self._read(f"{self.path}/hint") or 0)
        except (Py4JJavaError, ValueError):
            return 0

    def _numbers(self) -> list[int]:
        fs, p = self._hadoop(f"{self.path}/commits")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]

    def at(self, number: int) -> Snapshot | None:
        text = self._read(self._name(number))
        if text is None:
            return None
        state = json.loads(text)
        return Snapshot(number, tuple((f, n) for f, n in state["folders"]), state["meta"], time.time())

    def commit(self, base: Snapshot, folders: tuple[tuple[str, int], ...], meta: dict[str, Any]) -> Snapshot:
        """The state after ``base``; ``Conflict`` if there is one already, or ``base`` was read too long ago."""
        number = base.number + 1
        if time.time() - base.read_at > STALE_SECONDS:
            raise Conflict(f"commit {base.number} was read more than {STALE_SECONDS} s ago")
        if not self._create(self._name(number), json.dumps({"folders": folders, "meta": meta})):
            raise Conflict(f"commit {number} exists")
        with contextlib.suppress(Py4JJavaError):  # the commit stands; two writers may replace the hint at once
            self._write(f"{self.path}/hint", str(number))
        return Snapshot(number, folders, meta, time.time())

    def transact(self, change: Callable[[Snapshot], tuple[tuple[tuple[str, int], ...], dict[str, Any]] | None]) -> Snapshot:
        """Commit what ``change`` makes of the last state, again from the new one as often as another commit comes first.

        ``change`` returns folders and metadata, or None to leave the table as it is.
        """
        for k in range(TRIES):
            base = self.latest()
            new = change(base)
            if new is None:
                return base
            try:
                return self.commit(base, *new)
            except Conflict:
                time.sleep(random.uniform(0, min(MOST_WAIT, FIRST_WAIT * 2**k)))
        raise Conflict(f"no commit in {TRIES} tries")

    # ---- rows ----
    def folder(self, name: str) -> str:
        return f"{self.path}/data/{name}"

    def write(self, rows: DataFrame) -> str:
        """A new folder with these rows, which no commit lists yet."""
        name = uuid.uuid4().hex
        rows.write.parquet(self.folder(name))
        return name

    def append(self, rows: DataFrame) -> Snapshot:
        """Rows that don't hang on the table's state: written once, committed after whatever is there."""
        name = self.write(rows)
        return self.transact(lambda s: ((*s.folders, (name, s.number + 1)), s.meta))

    def rows(self, snapshot: Snapshot, schema: str, number: str | None = None) -> DataFrame:
        """The rows of a state, with the number of the commit that brought them if wanted."""
        if not snapshot.folders:
            return self.spark.createDataFrame([], schema + (f", {number} long" if number else ""))
        found = self.spark.read.schema(schema).parquet(*(self.folder(f) for f, _ in snapshot.folders))
        if not number:
            return found
        listed = self.spark.createDataFrame(list(snapshot.folders), f"_folder string, {number} long")  # a row for each commit since the last compaction
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)
        return found.withColumn("_folder", folder).join(F.broadcast(listed), "_folder").drop("_folder")

    def vacuum(self, seconds: float = 86_400.0) -> int:
        """Delete folders that the last state doesn't list, and commits before it, once they are older; how many folders.

        Readers and writers of older states must be done by then; writers are, after ``STALE_SECONDS``.
        """
        last = self.latest()
        kept, gone = {f for f, _ in last.folders}, 0
        before = (time.time() - max(seconds, 0.0)) * 1000
        fs, data = self._hadoop(f"{self.path}/data")
        for status in fs.listStatus(data) if fs.exists(data) else []:
            if status.getPath().getName() not in kept and status.getModificationTime() <= before:
                remove(self.spark, status.getPath().toString())
                gone += 1
        for number in self._numbers():
            file = self._hadoop(self._name(number))[1]
            if number < last.number and fs.getFileStatus(file).getModificationTime() <= min(before, (time.time() - STALE_SECONDS) * 1000):
                fs.delete(file, False)
        return gone
