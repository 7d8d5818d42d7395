"""Generations, their states, what is kept of them, and registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: States of a generation that is on its way.
IN_FLIGHT = ("building", "validated")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose keys it lacks; columns as in ``old``."""
    return new.select(*old.columns).unionByName(old.join(new.select(*keys), keys, "left_anti").select(*old.columns))


def upsert_changed(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """As ``upsert``, but a row whose other columns are equal keeps its old stamp. Adds changed (0/1)."""
    values = [c for c in old.columns if c not in keys and c != stamp]
    before = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in [*values, stamp]], F.lit(1).alias("_had"))
    both = new.select(*old.columns).join(before, keys, "full_outer")
    same = F.col("_had").isNotNull()
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    gone = F.col(stamp).isNull()
    keep = [F.when(gone, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return both.select(*keys, *keep, F.when(gone | same, F.col(f"_{stamp}")).otherwise(F.col(stamp)).alias(stamp), (~gone & ~same).cast("long").alias("changed"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.select(*old.columns).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def worktree_state(states: DataFrame, worktrees: DataFrame, generations: DataFrame) -> DataFrame:
    """A row for each state: its worktree, and its active generation's commit if it has one."""
    own = generations.select("repo_id", "worktree_id", F.col("generation_id").alias("active_generation"), "commit_sha")
    return states.join(worktrees.select("repo_id", "worktree_id", "worktree_path"), ["repo_id", "worktree_id"]).join(own, ["repo_id", "worktree_id", "active_generation"], "left")


def list_repositories(repositories: DataFrame, worktrees: DataFrame) -> DataFrame:
    return repositories.join(worktrees.select("repo_id", "worktree_id"), "repo_id", "left").groupBy("repo_id", "canonical_identity").agg(F.count("worktree_id").alias("worktrees"))


def next_generation_id(worktrees: DataFrame, generations: DataFrame) -> DataFrame:
    found = generations.groupBy("repo_id", "worktree_id").agg(F.max("generation_id").alias("last"))
    return worktrees.join(found, ["repo_id", "worktree_id"], "left").select("repo_id", "worktree_id", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("next_id"))


def refreshed(states: DataFrame, worktrees: DataFrame) -> DataFrame:
    """A ready state whose commit isn't the observed one is stale, a stale one whose commit is, ready."""
    own = states.join(worktrees.select("repo_id", "worktree_id", "observed_head"), ["repo_id", "worktree_id"])
    equal = F.col("observed_head") == F.col("indexed_head")
    has = F.col("active_generation").isNotNull()
    status = F.when(has & ~equal & (F.col("status") == "ready"), "stale").when(has & equal & (F.col("status") == "stale"), "ready").otherwise(F.col("status"))
    return own.select("repo_id", "worktree_id", status.alias("status"))


def lifecycle(generations: DataFrame, events: DataFrame) -> DataFrame:
    """events: repo_id, worktree_id, generation_id, seq, action (validate, activate, fail). The state that each generation ends in.

    Of a worktree the last activation of a validated generation stands; earlier active ones are retired; a failure
    counts unless the generation was active.
    """
    key = ["repo_id", "worktree_id", "generation_id"]
    seen = events.groupBy(*key).agg(*[F.max(F.when(F.col("action") == a, F.col("seq"))).alias(a) for a in ("validate", "activate", "fail")])
    own = generations.select(*key).join(seen, key, "left")
    fails_first = F.col("fail").isNotNull() & (F.col("activate").isNull() | (F.col("fail") < F.col("activate")))
    valid = F.col("validate").isNotNull() & ~fails_first
    active = valid & F.col("activate").isNotNull() & (F.col("activate") > F.col("validate"))
    order = Window.partitionBy("repo_id", "worktree_id").orderBy(F.desc("at"), F.desc("generation_id"))
    placed = own.withColumn("at", F.when(active, F.col("activate"))).withColumn("turn", F.row_number().over(order))
    state = F.when(fails_first, "failed").when(F.col("at").isNotNull() & (F.col("turn") == 1), "active").when(F.col("at").isNotNull(), "retired").when(valid, "validated").otherwise("building")
    return placed.select(*key, state.alias("state"))


def newest(generations: DataFrame, keep: int) -> DataFrame:
    """Of each worktree the newest ``keep`` generations, of any state."""
    order = Window.partitionBy("repo_id", "worktree_id").orderBy(F.desc("generation_id"))
    return generations.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def retained(generations: DataFrame, keep: int, fresh_after: int, readers: DataFrame) -> DataFrame:
    """What collection keeps: the newest, active ones, those with open readers, and those on their way since ``fresh_after``."""
    key = ["repo_id", "worktree_id", "generation_id"]
    held = generations.where((F.col("state") == "active") | (F.col("state").isin(*IN_FLIGHT) & (F.col("created_at") >= fresh_after)))
    read = generations.join(readers.select(*key), key, "left_semi")
    return newest(generations, keep).select(*key).unionByName(held.select(*key)).unionByName(read.select(*key)).distinct()


def pruned(generations: DataFrame, readers: DataFrame) -> DataFrame:
    """What pruning after a synchronisation removes: all but active generations, those on their way, and those that are read."""
    key = ["repo_id", "worktree_id", "generation_id"]
    return generations.where((F.col("state") != "active") & ~F.col("state").isin(*IN_FLIGHT)).join(readers.select(*key), key, "left_anti").select(*key, "state")


def retained_blobs(sources: list[DataFrame], kept: DataFrame) -> DataFrame:
    """sources: repo_id, worktree_id, generation_id, blob_sha. Blobs that retained generations refer to."""
    key = ["repo_id", "worktree_id", "generation_id"]
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    return every.join(kept, key, "left_semi").select("blob_sha").where("blob_sha <> ''").distinct()


def collectable_blobs(blobs: DataFrame, *used: DataFrame) -> DataFrame:
    """Blobs that none of several tables (each blob_sha) refers to."""
    for u in used:
        blobs = blobs.join(u.select("blob_sha").distinct(), "blob_sha", "left_anti")
    return blobs


def gc_plan(generations: DataFrame, kept: DataFrame, blobs: DataFrame) -> DataFrame:
    """What goes: generations that aren't kept and not on their way, and blobs; by kind, worktree, generation, blob."""
    key = ["repo_id", "worktree_id", "generation_id"]
    old = generations.where(~F.col("state").isin(*IN_FLIGHT)).join(kept, key, "left_anti").select(F.lit("generation").alias("kind"), "worktree_id", "generation_id", F.lit("").alias("blob_sha"), F.lit(0).cast("long").alias("bytes"))
    loose = blobs.select(F.lit("blob").alias("kind"), F.lit("").alias("worktree_id"), F.lit(0).cast("long").alias("generation_id"), "blob_sha", F.col("byte_size").alias("bytes"))
    return old.unionByName(loose).orderBy("kind", "worktree_id", "generation_id", "blob_sha")


def gc_report(plan: DataFrame) -> DataFrame:
    return plan.groupBy("kind").agg(F.count(F.lit(1)).alias("items"), F.sum("bytes").alias("bytes"))


def cache_stats(blobs: DataFrame, cached: DataFrame) -> DataFrame:
    """blobs, cached: blob_sha, object_format. One row: distinct blobs, hits, misses."""
    key = ["blob_sha", "object_format"]
    asked = blobs.select(*key).distinct()
    known = cached.select(*key, F.lit(1).alias("hit")).distinct()
    return asked.join(known, key, "left").agg(F.count(F.lit(1)).alias("blobs"), F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


def pending(blobs: DataFrame, cached: DataFrame) -> DataFrame:
    """Distinct blobs that the cache lacks."""
    key = ["blob_sha", "object_format"]
    return blobs.select(*key).distinct().join(cached.select(*key), key, "left_anti")
