"""Changes between two trees, what they invalidate, and how a worktree is synchronised."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.functions import paths as P

MAX_FILES, MAX_RATIO = 100, 0.30


def tree_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """base, head: path, blob_sha. kind, old_path, new_path, score: a deleted and an added path of one blob are a rename, the k-th with the k-th."""
    both = base.select("path", F.col("blob_sha").alias("old_sha")).join(head.select("path", F.col("blob_sha").alias("new_sha")), "path", "full_outer")
    changed = both.where(~F.col("old_sha").eqNullSafe(F.col("new_sha")))
    number = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("path"))
    gone = changed.where("new_sha is null").select(F.col("old_sha").alias("sha"), F.col("path").alias("old_path"), number("old_sha").alias("k"))
    come = changed.where("old_sha is null").select(F.col("new_sha").alias("sha"), F.col("path").alias("new_path"), number("new_sha").alias("k"))
    moved = gone.join(come, ["sha", "k"], "full_outer")
    kind = F.when(F.col("new_path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed")
    pairs = moved.select(kind.alias("kind"), F.coalesce("old_path", F.lit("")).alias("old_path"), F.coalesce("new_path", F.lit("")).alias("new_path"), F.when(kind == "renamed", 100).otherwise(0).cast("long").alias("score"))
    same = changed.where("old_sha is not null and new_sha is not null").select(F.lit("modified").alias("kind"), F.col("path").alias("old_path"), F.col("path").alias("new_path"), F.lit(0).cast("long").alias("score"))
    return pairs.unionByName(same)


def normalize_changes(changes: DataFrame) -> DataFrame:
    """Cleans both paths, drops what leaves the tree, and keeps each change once."""
    clean = lambda c: F.when(F.col(c) == "", "").otherwise(P.clean_path(F.col(c)))
    cleaned = changes.withColumn("old_path", clean("old_path")).withColumn("new_path", clean("new_path"))
    kept = cleaned.where("old_path is not null and new_path is not null and (old_path <> '' or new_path <> '')")
    return kept.select("kind", "old_path", "new_path", "score").distinct()


def sync_decision(changes: DataFrame, totals: DataFrame, max_files: int = MAX_FILES, max_ratio: float = MAX_RATIO) -> DataFrame:
    """totals: worktree, total_files, force, fingerprint_changed, base_available (0 or 1); changes: worktree, old_path, new_path. A decision for each worktree."""
    wide = P.is_wide_change(F.col("old_path")) | P.is_wide_change(F.col("new_path"))
    counted = changes.groupBy("worktree").agg(F.count(F.lit(1)).alias("changed"), F.max(wide.cast("int")).alias("wide"))
    own = totals.join(counted, "worktree", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))
    ratio = F.when(F.col("total_files") > 0, F.col("changed") / F.col("total_files")).when(F.col("changed") > 0, 1.0).otherwise(0.0)
    rules = (
        (F.col("force") == 1, "rebuild", "forced rebuild"), (F.col("fingerprint_changed") == 1, "rebuild", "build inputs or analyzer fingerprint changed"),
        (F.col("base_available") == 0, "rebuild", "indexed base commit unavailable"), (F.col("changed") > max_files, "rebuild", "too many changed files"),
        (F.col("ratio") > max_ratio, "rebuild", "changed file ratio too high"), (F.col("wide") == 1, "rebuild", "module, workspace, vendor, or build input changed"),
        (F.col("changed") == 0, "incremental", "commit changed without source file changes"),
    )
    mode, reason = F.lit("incremental"), F.lit("compatible source delta")
    for cond, m, r in reversed(rules):
        mode, reason = F.when(cond, m).otherwise(mode), F.when(cond, r).otherwise(reason)
    return own.withColumn("ratio", ratio).select("worktree", mode.alias("mode"), reason.alias("reason"), F.col("changed").cast("long").alias("changed"), "ratio")


def plan_invalidation(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files: path, package_key (before). For each package that a change touches: its changed and deleted files; '' collects paths of no known package."""
    sides = F.array(F.struct(F.col("old_path").alias("path"), F.col("kind").isin("deleted", "renamed").alias("gone")), F.struct(F.col("new_path").alias("path"), F.lit(False).alias("gone")))
    paths = changes.select(F.explode(sides).alias("s")).select("s.*").where("path <> ''").groupBy("path").agg(F.bool_or("gone").alias("gone"))
    own = paths.join(files.select("path", "package_key"), "path", "left").groupBy(F.coalesce("package_key", F.lit("")).alias("package_key"))
    return own.agg(F.count_if(~F.col("gone")).alias("changed"), F.count_if("gone").alias("deleted"))


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: package_key, kind, receiver, name, path, start_line, key, digest. Pairs the k-th with the k-th of one identity.

    added, deleted, renamed (another path), modified (another digest); equal ones are left out.
    """
    identity = ["package_key", "kind", "receiver", "name"]
    number = F.row_number().over(Window.partitionBy(*identity).orderBy("path", "start_line", "key"))
    side = lambda df, p: df.withColumn("k", number).select(*identity, "k", *[F.col(c).alias(f"{p}_{c}") for c in ("key", "path", "digest")])
    both = side(old, "old").join(side(new, "new"), [*identity, "k"], "full_outer")
    change = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "deleted").when(F.col("old_path") != F.col("new_path"), "renamed").when(F.col("old_digest") != F.col("new_digest"), "modified")
    return both.select(change.alias("change"), *identity, F.coalesce("old_key", F.lit("")).alias("old_key"), F.coalesce("new_key", F.lit("")).alias("new_key")).where("change is not null")


def change_seeds(changes: DataFrame) -> DataFrame:
    """Keys that an actual change starts from: what is there after it, and what was there before a deletion or renaming."""
    before = F.when(F.col("change").isin("deleted", "renamed"), F.col("old_key")).otherwise("")
    return changes.select(F.explode(F.array("new_key", before)).alias("key")).where("key <> ''").distinct()
