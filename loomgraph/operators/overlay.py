"""The effective view: a committed base without what changed, with what the working tree has instead."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.functions import paths as P
from loomgraph.operators.lookup import SYMBOL


def manifest(statuses: DataFrame) -> DataFrame:
    """statuses: kind, old_path, new_path, tracked (0/1), sha. Entries: path, present, sha. A rename gives two; untracked paths that the analysis doesn't read give none."""
    here = statuses.where("new_path <> '' and kind <> 'deleted'").where((F.col("tracked") == 1) | P.is_eligible(F.col("new_path"))).select(F.col("new_path").alias("path"), F.lit(1).cast("long").alias("present"), "sha")
    gone = statuses.where("old_path <> '' and kind in ('deleted', 'renamed')").select(F.col("old_path").alias("path"), F.lit(0).cast("long").alias("present"), F.lit("").alias("sha"))
    return here.unionByName(gone)


def files(base: DataFrame, entries: DataFrame) -> DataFrame:
    """base: path, blob_sha. The effective files: those of the base that no entry names, and the captured ones with ids of their own."""
    kept = base.select("path", "blob_sha").join(entries.select("path"), "path", "left_anti").select("path", "blob_sha", F.lit("base").alias("origin"))
    captured = entries.where("present = 1").select("path", F.concat(F.lit("overlay:sha256:"), "sha").alias("blob_sha"), F.lit("overlay").alias("origin"))
    return kept.unionByName(captured)


def _masks(changed: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    return changed.select("key").distinct(), paths.select("path").distinct()


def symbols(base: DataFrame, local: DataFrame, changed: DataFrame, paths: DataFrame) -> DataFrame:
    """The base's symbols but for changed keys and affected paths, the local ones, and deleted ones as history. Adds origin."""
    keys, touched = _masks(changed, paths)
    kept = base.join(keys, "key", "left_anti").join(touched, "path", "left_anti").select(*SYMBOL, F.lit("base").alias("origin"))
    own = local.select(*SYMBOL, F.lit("overlay").alias("origin"))
    history = base.join(keys, "key", "left_semi").join(local.select("key"), "key", "left_anti").select(*SYMBOL, F.lit("historical").alias("origin"))
    return kept.unionByName(own).unionByName(history)


def masked_edges(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges neither end of which is masked."""
    keys = changed.select("key").distinct()
    return edges.join(keys.withColumnRenamed("key", "source_key"), "source_key", "left_anti").join(keys.withColumnRenamed("key", "target_key"), "target_key", "left_anti")


def find(effective: DataFrame, query: str) -> DataFrame:
    """By the first rule that finds anything: a local key, a historical key, names among both, then the base."""
    is_key, is_name, origin = F.col("key") == query, F.col("name") == query, F.col("origin")
    rule = F.when((origin == "overlay") & is_key, 1).when((origin == "historical") & is_key, 2).when((origin != "base") & is_name, 3).when((origin == "base") & (is_key | is_name), 4)
    found = effective.withColumn("rule", rule).where("rule is not null")
    best = found.agg(F.min("rule").alias("rule"))
    return found.join(best, "rule").select(*SYMBOL, "origin")


def search(effective: DataFrame, terms: list[str], limit: int = 256) -> DataFrame:
    """Ranked like the store's search, over seven fields, history left out."""
    text = F.lower(F.concat_ws(" ", "key", "name", "receiver", "signature", "package_key", "file_key", "path"))
    matched = sum((F.when(F.contains(text, F.lit(t.lower())), 1).otherwise(0) for t in dict.fromkeys(terms)), F.lit(0)).cast("long")
    found = effective.where("origin <> 'historical'").withColumn("matched", matched).where("matched > 0")
    return found.orderBy(F.desc("matched"), "package_key", "path", "start_line", "key").limit(limit).select(*SYMBOL, "origin", "matched")


#: Lists of a symbol's result and the edges that they hold: kinds, and the end that the symbol is (None: either).
LISTS = {
    "calls": (("calls", "possible_call", "unresolved_call"), "source"), "called_by": (("calls", "possible_call", "unresolved_call"), "target"), "implementations": (("implements",), "source"),
    "implemented_by": (("implements",), "target"), "tests": (("tests",), None), "refs": (("references",), "target"),
}


def symbol_results(effective: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """For each effective symbol with edges: key, origin, and the other ends of its edges in six lists, each at most ``limit`` long, in order of kind, source and target.

    A self-edge is an outgoing one. Edges are ranked and cut before they are collected, so a hub is never one row.
    """
    end = F.explode(F.array_distinct(F.array(F.struct(F.col("source_key").alias("key"), F.lit("source").alias("end")), F.when(F.col("source_key") != F.col("target_key"), F.struct(F.col("target_key").alias("key"), F.lit("target").alias("end"))))))
    ends = edges.select("source_key", "target_key", "kind", end.alias("own")).where("own is not null").select("source_key", "target_key", "kind", "own.key", "own.end")
    name = F.lit(None).cast("string")
    for list_, (kinds, which) in LISTS.items():
        # A reference to itself counts as incoming.
        holds = F.col("kind").isin(*kinds) & (F.lit(True) if which is None else F.col("end") == which if list_ != "refs" else F.col("target_key") == F.col("key"))
        name = F.when(holds, list_).otherwise(name)
    placed = ends.withColumn("list", name).where("list is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("key", "list").orderBy("kind", "source_key", "target_key"))
    other = F.when(F.col("source_key") == F.col("key"), F.col("target_key")).otherwise(F.col("source_key"))
    few = placed.withColumn("rank", rank).where(F.col("rank") <= limit).select("key", "list", "rank", other.alias("other"))
    lists = few.groupBy("key").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == n, F.struct("rank", "other")))), lambda x: x["other"]).alias(n) for n in LISTS])
    return effective.select("key", "origin").join(lists, "key")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the last row in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


class StaleSource(Exception):
    """The working tree or its head changed while the overlay was made."""


def manifest_id(entries: DataFrame) -> str:
    """A digest of path, present and sha of all entries, whatever their order: one row of sums leaves the executors."""
    one = F.xxhash64("path", "present", "sha")
    other = F.xxhash64(F.lit(1), "sha", "present", "path")
    row = entries.agg(F.count(F.lit(1)), F.sum(one.cast("decimal(20,0)")), F.sum(other.cast("decimal(20,0)")), F.bit_xor(other)).first()
    return hashlib.sha256(repr([str(v) for v in row]).encode()).hexdigest()


def guarded(capture: Callable[[], DataFrame], build: Callable[[DataFrame], object], head: Callable[[], str | None], commit: str, attempts: int = 2):
    """What ``build`` makes of a captured manifest, if neither the manifest nor the head has changed when it is done; else once more, ``attempts`` times in all."""
    said = "no attempt"
    for _ in range(attempts):
        entries = capture()
        before = manifest_id(entries)
        made = build(entries)
        after = manifest_id(capture())
        if after != before:
            said = f"manifest changed from {before} to {after}"
        elif head() != commit:
            said = "head changed during the analysis"
        else:
            return made
    raise StaleSource(said)
