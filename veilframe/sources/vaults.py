"""A vault kept in a folder: every change is written next to the old state, then committed.

A change writes its tables under a new folder.  Then its claim, complete and
under a name of its own, becomes the marker of the next version in one step
that no two runs can both take, and the marker is read back.  A run that dies
anywhere before that leaves the old state valid and nobody waiting.

Tables are laid out in buckets of the identity, so that a run's values go to the
vault's rows and not the other way.  A purge writes tombstones; they are folded in when
the state is next written in one piece.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.patterns import sql_string
from veilframe.operators.tokens import (
    COUNTERS_SCHEMA,
    MAP_SCHEMA,
    RUNS_SCHEMA,
    Assignment,
    Vault,
    empty_vault,
    only_used_by,
    union_of,
    with_assignment,
)

#: After so many additions, or so many purges, the next one writes the whole state, so that loading reads few folders.
COMPACT_EVERY = 32
COMPACT_PURGES = 4
GONE_SCHEMA = "identity string"
#: Asks a store that can for a put that fails where a file exists; such files are seen once they are complete.
CONDITIONAL = "fs.option.create.conditional.overwrite"
#: Other file systems must rename in one step and never onto a file.
RENAMING = ("file", "hdfs", "viewfs", "abfs", "abfss")


class VaultChanged(RuntimeError):
    """Another run committed first; run again from the new state."""


@dataclass(frozen=True)
class Entry:
    """What a marker says."""

    base: int  # the version from which on folders count for this one's state
    folder: str
    buckets: int
    purged: str | None = None  # the run that this change forgets


def _parsed(content: str) -> Entry | None:
    """The entry of a marker; None if it is half-made."""
    try:
        found = json.loads(content)
        return Entry(int(found["base"]), str(found["folder"]), int(found["buckets"]), found["purged"])
    except (ValueError, KeyError, TypeError):
        return None


@dataclass(frozen=True)
class VaultFolder:
    """Any number of runs may work from the same state; the first to commit wins and the others raise
    :class:`VaultChanged` and leave nothing behind.

    ``buckets`` is the layout of what is written from now on.  A half-made marker (of a store where files
    are seen before they are complete) is waited for ``patience`` seconds from its last change; then its
    writer is taken for dead and the marker set aside.  Should that writer live, it finds the marker gone and raises.
    """

    spark: SparkSession
    path: str
    buckets: int = 32
    patience: float = 900.0

    # --- files -----------------------------------------------------------------

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _marker(self, version: int) -> str:
        return f"commits/{version:06d}"

    def _write_file(self, builder, content: str) -> None:
        out = builder.build()
        out.write(bytearray(content.encode()))
        out.close()

    def _move(self, name: str, target: str) -> None:
        """Give a complete file another name; raises where that name is taken."""
        files, source = self._hadoop(name)
        _, there = self._hadoop(target)
        if files.getUri().getScheme() == "file":
            # A rename would replace the file, a second link to it can't.
            file = self.spark._jvm.java.io.File
            local = [file(path.toUri().getPath()).toPath() for path in (source, there)]
            self.spark._jvm.java.nio.file.Files.createLink(local[1], local[0])
            files.delete(source, False)
            return
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext
        context.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, there, options)

    def _conditional(self) -> bool:
        """Whether the store has conditional puts; raises where it has no safe way at all."""
        files, folder = self._hadoop("commits")
        if files.hasPathCapability(folder, CONDITIONAL):
            return True
        if files.getUri().getScheme() not in RENAMING:
            raise RuntimeError(f"{files.getUri().getScheme()}: this store can neither create nor rename a file without replacing another")
        return False

    def _publish(self, version: int, entry: Entry) -> None:
        """Make the marker of a version, complete in one step; raises where there is one."""
        content = json.dumps(vars(entry))
        files, marker = self._hadoop(self._marker(version))
        if self._conditional():
            self._write_file(files.createFile(marker).recursive().overwrite(False).opt(CONDITIONAL, True), content)
            return
        claim = f"commits/.{entry.folder}.claim"
        _, own = self._hadoop(claim)
        self._write_file(files.createFile(own).recursive().overwrite(False), content)
        try:
            self._move(claim, self._marker(version))
        finally:
            files.delete(own, False)

    # --- markers ---------------------------------------------------------------

    def _versions(self) -> list[int]:
        """Numbers of all markers, half-made ones too."""
        files, folder = self._hadoop("commits")
        if not files.exists(folder):
            return []
        names = (status.getPath().getName() for status in files.listStatus(folder))
        return sorted(int(name) for name in names if name.isdigit())

    def _content(self, name: str) -> str | None:
        files, path = self._hadoop(name)
        try:
            stream = files.open(path)
        except Py4JJavaError as error:
            if "FileNotFoundException" in str(error.java_exception):
                return None
            raise
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _entry(self, version: int) -> Entry | None:
        content = self._content(self._marker(version))
        return None if content is None else _parsed(content)

    def _abandoned(self, version: int) -> bool:
        """Set a half-made marker aside, unless its writer may still be at it; False if it has become complete."""
        files, marker = self._hadoop(self._marker(version))
        try:
            age = time.time() - files.getFileStatus(marker).getModificationTime() / 1000
        except Py4JJavaError as error:
            if "FileNotFoundException" in str(error.java_exception):
                return True
            raise
        if age < self.patience:
            raise VaultChanged(f"version {version} is being committed; try again")
        aside = f"commits/.{version:06d}-{uuid.uuid4().hex}.abandoned"
        try:
            self._move(self._marker(version), aside)
        except Py4JJavaError:
            return self._entry(version) is None  # another run was faster
        if _parsed(self._content(aside) or "") is None:
            return True
        self._move(aside, self._marker(version))
        return False

    def _latest(self) -> int:
        """The last committed version, 0 if there is none."""
        for version in reversed(self._versions()):
            if self._entry(version) is not None or not self._abandoned(version):
                return version
        return 0

    # --- tables ----------------------------------------------------------------

    def _write_table(self, table: DataFrame, folder: str, name: str) -> None:
        """By identity in buckets.  Spark wants a name in its catalog for that, which goes again at once; files stay."""
        known = f"veilframe_{uuid.uuid4().hex}"
        rows = table.repartition(self.buckets, "identity").write.format("parquet").option("path", f"{self.path}/{folder}/{name}")
        rows.bucketBy(self.buckets, "identity").sortBy("identity").saveAsTable(known)
        self.spark.sql(f"DROP TABLE {known}")

    def _table(self, entry: Entry, name: str, schema: str) -> DataFrame:
        known = f"veilframe_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {known} ({schema}) USING parquet CLUSTERED BY (identity) SORTED BY (identity) INTO {entry.buckets} BUCKETS "
            f"LOCATION {sql_string(f'{self.path}/{entry.folder}/{name}')}"
        )
        found = self.spark.table(known)
        self.spark.sql(f"DROP TABLE {known}")
        return found

    # --- states ----------------------------------------------------------------

    def exists(self) -> bool:
        return bool(self._latest())

    def _entries(self, version: int) -> list[Entry]:
        """What makes up the state of a version."""
        base = self._entry(version).base
        found = (self._entry(one) for one in self._versions() if base <= one <= version)
        return [entry for entry in found if entry is not None]

    def load(self) -> Vault:
        latest = self._latest()
        if not latest:
            return empty_vault(self.spark)
        maps: list[DataFrame] = []
        runs: list[DataFrame] = []
        counters = ""
        for entry in self._entries(latest):
            if entry.purged is not None:
                gone = self._table(entry, "gone", GONE_SCHEMA)
                maps = [part.join(gone, "identity", "left_anti") for part in maps]
                runs = [part.where(F.col("run_id") != entry.purged) for part in runs]
            else:
                maps.append(self._table(entry, "token_map", MAP_SCHEMA))
                runs.append(self._table(entry, "token_runs", RUNS_SCHEMA))
                counters = entry.folder
        last = self.spark.read.schema(COUNTERS_SCHEMA).parquet(f"{self.path}/{counters}/counters")
        return Vault(union_of(maps), union_of(runs), last, latest, tuple(maps), tuple(runs))

    def _check(self, expected: int) -> None:
        latest = self._latest()
        if latest != expected:
            raise VaultChanged(f"vault is at version {latest}, the run started from {expected}")

    def _commit(self, expected: int, base: int, tables: dict[str, DataFrame], purged: str | None = None) -> int:
        version = expected + 1
        entry = Entry(base, f"v{version:06d}-{uuid.uuid4().hex}", self.buckets, purged)
        files, own = self._hadoop(entry.folder)
        try:
            self._conditional()
            for name, table in tables.items():
                self._check(expected)
                if name == "counters":
                    table.write.parquet(f"{self.path}/{entry.folder}/{name}")
                else:
                    self._write_table(table, entry.folder, name)
            self._check(expected)
        except Exception:
            files.delete(own, True)
            raise
        failed = None
        try:
            self._publish(version, entry)
        except Exception as error:
            failed = error
        # Whatever the call said, the marker says whose version this is.
        owner = self._entry(version)
        if owner == entry:
            return version
        if owner is not None:
            files.delete(own, True)
            raise VaultChanged(f"another run committed version {version}") from failed
        # The folder stays, as a marker that names it may still turn up; sweep() deletes it.
        raise failed or VaultChanged(f"the marker of version {version} is gone")

    def append(self, vault: Vault, assignment: Assignment) -> int:
        """Commit what a run adds; only new rows are written, but for every ``COMPACT_EVERY``-th time."""
        self._check(vault.version)
        base = self._entry(vault.version).base if vault.version else 1
        if vault.version + 1 - base >= COMPACT_EVERY:
            return self.overwrite(with_assignment(vault, assignment))
        tables = {"token_map": assignment.new_map, "token_runs": assignment.new_runs, "counters": assignment.counters}
        return self._commit(vault.version, base, tables)

    def overwrite(self, vault: Vault) -> int:
        """Commit a changed vault (re-key, compaction) as a full new state."""
        tables = {"token_map": vault.token_map, "token_runs": vault.token_runs, "counters": vault.counters}
        return self._commit(vault.version, vault.version + 1, tables)

    def compact(self) -> int:
        """Write the present state in one piece; purged rows are not part of it."""
        return self.overwrite(self.load())

    def purge(self, run_id: str) -> int:
        """Forget a run: the number of values that no other run used and that go with it.

        Only the identities of these are written.  Their rows stay in the files, encrypted, until the state is compacted and
        the old folders are swept.
        """
        state = self.load()
        if not state.version:
            return 0
        entries = self._entries(state.version)
        if sum(entry.purged is not None for entry in entries) >= COMPACT_PURGES:
            self.overwrite(state)
            return self.purge(run_id)
        self._commit(state.version, entries[0].base, {"gone": only_used_by(state, run_id)}, run_id)
        written = Entry(**vars(self._entry(state.version + 1)))
        return self._table(written, "gone", GONE_SCHEMA).count()

    def sweep(self, older_than: float = 7 * 86400.0) -> int:
        """Delete folders and claims that no state since the last full one names and that have not changed for so many
        seconds: what dead runs left, and states from before a compaction.  Returns their number."""
        latest = self._latest()
        named = {entry.folder for entry in self._entries(latest)} if latest else set()
        swept = 0
        for name in ("", "commits"):
            files, folder = self._hadoop(name) if name else self._hadoop(".")
            if not files.exists(folder):
                continue
            for status in files.listStatus(folder):
                own = status.getPath().getName()
                old = time.time() - status.getModificationTime() / 1000 >= older_than
                stray = own.startswith(".") if name else own.startswith("v") and own not in named
                if stray and old:
                    files.delete(status.getPath(), True)
                    swept += 1
        return swept
