"""Generations on disk: one Parquet dataset for each relation, partitioned by generation_key, and a control table.

Readers pin a generation by its partition. A candidate is written beside the others and becomes visible by one row of the
control table. Each version of that table is a dataset of its own under a free name; it counts from the moment that a small
pointer file is renamed to the version's number, which fails if another writer took that number. So the swap is as atomic
as the file system's rename without overwriting (HDFS's is), and a writer that dies leaves nothing that others stumble over.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.operators.integrity import ERROR, OK, may_break, validate_analysis
from loomgraph.projection import Graph

RECORD_VERSION = 2
CONTROL = "generation_key long, commit_sha string, fingerprint string, state string, record_version int"
RELATIONS = tuple(f.name for f in fields(Graph))
#: Bytes that a file has at most after compaction, about.
FILE_BYTES = 128 << 20


class StaleGeneration(Exception):
    """The generation or version asked for isn't the current one."""


class InvalidGeneration(ValueError):
    """A candidate that breaks rules."""


class Files:
    """What the store does to files, by Hadoop's interface, so that any path that Spark can write will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def size(self, p: str) -> int:
        return int(self.fs.getContentSummary(self.path(p)).getLength()) if self.exists(p) else 0

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, p: str, text: str) -> None:
        stream = self.fs.create(self.path(p), True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def move(self, old: str, new: str) -> bool:
        """Renames without overwriting; false if ``new`` is there."""
        if self.exists(new):
            return False
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(new).toUri(), self.conf) if "://" in new else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.path(old), self.path(new), none)
        except Exception as e:  # py4j wraps the one that counts
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True


class Store:
    """A store of one worktree's generations under ``root`` (any path that Spark can write)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self.files.names(f"{self.root}/control") if n.startswith("v") and n[1:].isdigit())

    def control(self) -> DataFrame:
        """A row for each generation."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], CONTROL)
        return self.spark.read.schema(CONTROL).parquet(f"{self.root}/control/" + self.files.read(f"{self.root}/control/v{versions[-1]}"))

    def _publish(self, rows: DataFrame, seen: int) -> None:
        """Makes ``rows`` version ``seen`` + 1 of the control table, or fails if another writer did so since ``seen`` was read."""
        name = f"data-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.root}/control/{name}")
        self.files.write(f"{self.root}/control/pointer-{name}", name)
        if not self.files.move(f"{self.root}/control/pointer-{name}", f"{self.root}/control/v{seen + 1}"):
            for gone in (f"pointer-{name}", name):
                self.files.delete(f"{self.root}/control/{gone}")
            raise StaleGeneration(f"the control table is beyond version {seen}")

    def version(self) -> int:
        return (self._versions() or [0])[-1]

    def max_key(self) -> int:
        """The largest generation key so far, 0 if there is none."""
        return int(self.control().agg(F.coalesce(F.max("generation_key"), F.lit(0)).alias("k")).first()["k"])

    def write_generation(self, g: Graph, commit: str, fingerprint: str) -> int:
        """Reserves the next key under the state building, then writes the candidate, each relation sorted by its first column within its files."""
        if not fingerprint.strip():
            raise InvalidGeneration("the build fingerprint is empty")
        seen = self.version()
        key = self.max_key() + 1
        row = self.spark.createDataFrame([(key, commit, fingerprint, "building", RECORD_VERSION)], CONTROL)
        self._publish(self.control().unionByName(row), seen)
        for name in RELATIONS:
            df = getattr(g, name)
            df.sortWithinPartitions(df.columns[0]).write.mode("overwrite").parquet(f"{self.root}/{name}/generation_key={key}")
        return key

    def _set(self, key: int, state: str, others: str | None = None, seen: int | None = None) -> None:
        seen = self.version() if seen is None else seen
        new = F.when(F.col("generation_key") == key, state)
        if others:
            new = new.when(F.col("state") == "active", others)
        self._publish(self.control().withColumn("state", new.otherwise(F.col("state"))), seen)

    def state(self, key: int) -> str | None:
        row = self.control().where(F.col("generation_key") == key).first()
        return row["state"] if row else None

    def validate(self, key: int, diagnostics: DataFrame | None = None) -> None:
        """building -> validated if the candidate breaks no rule of ``validate_analysis``; else it is failed, and the error names some violations."""
        if self.state(key) != "building":
            raise StaleGeneration(f"generation {key} is {self.state(key)}")
        g = self._graph(key)
        bad = validate_analysis(g, diagnostics).limit(5).collect() if may_break(g, diagnostics) else []
        self._set(key, "failed" if bad else "validated")
        if bad:
            raise InvalidGeneration(f"generation {key} breaks rules: " + "; ".join(f"{r['rule']} {r['subject']}" for r in bad))

    def activate(self, key: int, expected: int | None, observed_head: str | None = None) -> None:
        """validated -> active if the active generation is still ``expected`` and the candidate is of the head that was observed (if given); the active one is retired."""
        seen, row = self.version(), self.control().where(F.col("generation_key") == key).first()
        if self.active() != expected or row is None or row["state"] != "validated":
            raise StaleGeneration(f"the active generation is {self.active()}, and {key} is {row['state'] if row else None}")
        if observed_head is not None and observed_head != row["commit_sha"]:
            raise StaleGeneration(f"the head is {observed_head}, and {key} is of {row['commit_sha']}")
        self._set(key, "active", "retired", seen)

    def fail(self, key: int) -> None:
        if self.state(key) != "active":
            self._set(key, "failed")

    def active(self) -> int | None:
        row = self.control().where("state = 'active'").orderBy(F.desc("generation_key")).first()
        return int(row["generation_key"]) if row else None

    def _graph(self, key: int) -> Graph:
        read = lambda name: self.spark.read.parquet(f"{self.root}/{name}").where(F.col("generation_key") == key).drop("generation_key")
        return Graph(*(read(name) for name in RELATIONS))

    def open_view(self, key: int | None = None) -> Graph:
        """The active generation; if ``key`` is given it must be that one. The filter prunes partitions."""
        active = self.active()
        if active is None or key is not None and key != active:
            raise StaleGeneration(f"the active generation is {active}, not {key}")
        return self._graph(active)

    def ensure(self, build, commit: str, fingerprint: str, force: bool = False) -> tuple[int, str]:
        """The active generation if its commit and fingerprint are the ones asked for; else a new one of ``build()``. (key, reuse or rebuild)"""
        row = self.control().where("state = 'active'").first()
        if row and not force and (row["commit_sha"], row["fingerprint"], row["record_version"]) == (commit, fingerprint, RECORD_VERSION):
            return int(row["generation_key"]), "reuse"
        key = self.write_generation(build(), commit, fingerprint)
        self.validate(key)
        self.activate(key, int(row["generation_key"]) if row else None)
        return key, "rebuild"

    def prune(self, keep: tuple[int, ...] = ()) -> int:
        """Takes retired and failed generations but those of ``keep`` out of the control table, then deletes their partitions; returns how many."""
        seen = self.version()
        gone = [int(r["generation_key"]) for r in self.control().where(F.col("state").isin("retired", "failed")).collect() if r["generation_key"] not in keep]
        if gone:
            self._publish(self.control().where(~F.col("generation_key").isin(gone)), seen)
        for key in gone:
            for name in RELATIONS:
                self.files.delete(f"{self.root}/{name}/generation_key={key}")
        return len(gone)

    def repair(self) -> dict[str, int]:
        """Cleans up after writers that died; call it while nobody writes. Candidates that were being built fail, older and unpublished versions of the control table and partitions of unknown generations go."""
        building = [int(r["generation_key"]) for r in self.control().where("state = 'building'").collect()]
        for key in building:
            self._set(key, "failed")
        versions, folder = self._versions(), f"{self.root}/control"
        kept = {f"v{versions[-1]}", self.files.read(f"{folder}/v{versions[-1]}")} if versions else set()
        loose = [n for n in self.files.names(folder) if n not in kept]
        known = {f"generation_key={r['generation_key']}" for r in self.control().select("generation_key").collect()}
        orphans = [f"{self.root}/{name}/{n}" for name in RELATIONS for n in self.files.names(f"{self.root}/{name}") if n.startswith("generation_key=") and n not in known]
        for p in [*(f"{folder}/{n}" for n in loose), *orphans]:
            self.files.delete(p)
        return {"failed": len(building), "loose": len(loose), "orphans": len(orphans)}

    def compact(self, file_bytes: int = FILE_BYTES) -> int:
        """Rewrites the active generation in files of about ``file_bytes`` and returns by how many bytes it shrank (0 if it grew). Nobody may have a view open.

        Each relation's new partition is complete before it takes the old one's place; the old one goes last.
        """
        key, shrunk = self.active(), 0
        if key is None:
            raise StaleGeneration("there is no active generation")
        for name in RELATIONS:
            here, new, old = (f"{self.root}/{name}/{part}" for part in (f"generation_key={key}", f"_new-{key}", f"_old-{key}"))
            before = self.files.size(here)
            df = self.spark.read.parquet(here)
            df.coalesce(max(1, -(-before // file_bytes))).sortWithinPartitions(df.columns[0]).write.mode("overwrite").parquet(new)
            if not (self.files.move(here, old) and self.files.move(new, here)):
                raise StaleGeneration(f"another compaction of {name} is under way")
            self.files.delete(old)
            shrunk += before - self.files.size(here)
        return max(0, shrunk)

    def quarantine(self) -> str:
        """Moves everything that the store holds into a folder of its own beside it, named by time; what was moved goes back if a move fails. Returns the folder."""
        if not self.files.exists(self.root):
            raise FileNotFoundError(self.root)
        target = f"{self.root}/quarantine/{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}-{uuid.uuid4().hex[:8]}"
        self.files.fs.mkdirs(self.files.path(target))
        moved = []
        try:
            for name in ("control", *RELATIONS):
                if self.files.exists(f"{self.root}/{name}"):
                    if not self.files.move(f"{self.root}/{name}", f"{target}/{name}"):
                        raise FileExistsError(f"{target}/{name}")
                    moved.append(name)
        except Exception:
            for name in reversed(moved):
                self.files.move(f"{target}/{name}", f"{self.root}/{name}")
            raise
        return target

    def recover(self) -> dict[str, str]:
        """Quarantines the store and starts an empty one in its place; the graph has to be built anew."""
        target = self.quarantine()
        self.files.fs.mkdirs(self.files.path(f"{self.root}/control"))
        return {"root": self.root, "quarantine": target}

    def health(self) -> DataFrame:
        """check, status, violations: whether the control table, every relation, and every partition of the active generation can be read."""
        rows, wanted = [], {f.name for f in self.spark.createDataFrame([], CONTROL).schema}
        try:
            found = self.control()
            rows.append(("control", len(wanted - set(found.columns))))
            key = self.active()
        except Exception:  # an unreadable table is what this reports
            return self.spark.createDataFrame([("control", ERROR, 1)], "check string, status string, violations long")
        for name in RELATIONS if key is not None else ():
            path = f"{self.root}/{name}/generation_key={key}"
            try:
                self.spark.read.parquet(path).select(F.sum(F.hash("*"))).first()  # reads every column
                rows.append((name, 0))
            except Exception:  # an unreadable relation is what this reports
                rows.append((name, 1))
        return self.spark.createDataFrame([(n, ERROR if bad else OK, bad) for n, bad in rows], "check string, status string, violations long")


def catalog_scan(spark: SparkSession, roots: list[str]) -> DataFrame:
    """A row for each store: root, generations, active, issue. A store that can't be read gives an issue, the others stand."""
    out = []
    for root in roots:
        try:
            rows = Store(spark, root).control().select("generation_key", "state").collect()
            active = [int(r["generation_key"]) for r in rows if r["state"] == "active"]
            out.append((root, len(rows), active[0] if active else None, "" if rows else "no generations"))
        except Exception as e:  # a broken store is data here
            out.append((root, 0, None, type(e).__name__))
    return spark.createDataFrame(out, "root string, generations long, active long, issue string")


def replaced(g: Graph, **relations: DataFrame) -> Graph:
    return replace(g, **relations)
