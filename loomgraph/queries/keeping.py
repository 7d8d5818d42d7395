"""Generations, registrations, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import retention as R
from loomgraph.queries import query

KEY = "repo_id, worktree_id, generation_id"
KEPT = {"kept": f"""SELECT {KEY} FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, worktree_id ORDER BY generation_id DESC) AS n FROM x_generations) WHERE n <= 2
UNION SELECT {KEY} FROM x_generations WHERE state = 'active' OR (state IN ('building', 'validated') AND created_at >= 20000000) UNION SELECT {KEY} FROM x_readers WHERE ({KEY}) IN (SELECT {KEY} FROM x_generations)"""}
USED = {**KEPT, "used": f"SELECT DISTINCT blob_sha FROM x_refs WHERE ({KEY}) IN (SELECT {KEY} FROM kept) AND blob_sha <> ''",
        "loose": "SELECT * FROM x_blobs WHERE blob_sha NOT IN (SELECT blob_sha FROM used) AND blob_sha NOT IN (SELECT blob_sha FROM x_cache)"}
PLAN = {**USED, "plan": f"""SELECT 'generation' AS kind, worktree_id, generation_id, '' AS blob_sha, CAST(0 AS BIGINT) AS bytes FROM x_generations WHERE state NOT IN ('building', 'validated') AND ({KEY}) NOT IN (SELECT {KEY} FROM kept)
UNION ALL SELECT 'blob', '', CAST(0 AS BIGINT), blob_sha, byte_size FROM loose"""}


def _kept(table):
    return R.retained(table("x_generations"), 2, 20_000_000, table("x_readers"))


def _loose(table):
    return R.collectable_blobs(table("x_blobs"), R.retained_blobs([table("x_refs")], _kept(table)), table("x_cache"))


@query("SELECT * FROM kept", **KEPT)
def gc_generations(g, table):
    return _kept(table)


@query("SELECT * FROM used", **USED)
def gc_retained_blobs(g, table):
    return R.retained_blobs([table("x_refs")], _kept(table))


@query("SELECT * FROM loose", **USED)
def gc_blobs(g, table):
    return _loose(table)


@query("SELECT * FROM plan", **PLAN)
def gc_plan(g, table):
    return R.gc_plan(table("x_generations"), _kept(table), _loose(table))


@query("SELECT kind, count(*) AS items, CAST(sum(bytes) AS BIGINT) AS bytes FROM plan GROUP BY kind", **PLAN)
def gc_report(g, table):
    return R.gc_report(R.gc_plan(table("x_generations"), _kept(table), _loose(table)))


@query(f"SELECT {KEY}, state FROM x_generations WHERE state NOT IN ('active', 'building', 'validated') AND ({KEY}) NOT IN (SELECT {KEY} FROM x_readers)")
def prune_generations(g, table):
    return R.pruned(table("x_generations"), table("x_readers"))


@query(f"SELECT DISTINCT {KEY}, blob_sha FROM x_refs WHERE blob_sha <> ''")
def generation_blobs(g, table):
    return table("x_refs").where("blob_sha <> ''").select(*KEY.split(", "), "blob_sha").distinct()


@query("SELECT s.repo_id, s.worktree_id, s.active_generation, s.indexed_head, s.status, w.worktree_path, g.commit_sha FROM x_states s JOIN x_worktrees w ON w.repo_id = s.repo_id AND w.worktree_id = s.worktree_id LEFT JOIN x_generations g ON g.repo_id = s.repo_id AND g.worktree_id = s.worktree_id AND g.generation_id = s.active_generation")
def worktree_state(g, table):
    return R.worktree_state(table("x_states"), table("x_worktrees"), table("x_generations"))


@query("SELECT r.repo_id, r.canonical_identity, count(w.worktree_id) AS worktrees FROM x_repositories r LEFT JOIN x_worktrees w ON w.repo_id = r.repo_id GROUP BY 1, 2")
def list_repositories(g, table):
    return R.list_repositories(table("x_repositories"), table("x_worktrees"))


@query("SELECT w.repo_id, w.worktree_id, coalesce(max(g.generation_id), 0) + 1 AS next_id FROM x_worktrees w LEFT JOIN x_generations g ON g.repo_id = w.repo_id AND g.worktree_id = w.worktree_id AND g.state <> 'failed' AND w.nk % 5 <> 0 GROUP BY 1, 2")
def next_generation_id(g, table):
    some = table("x_generations").where("state <> 'failed'").join(table("x_worktrees").where("nk % 5 <> 0").select("repo_id", "worktree_id"), ["repo_id", "worktree_id"])
    return R.next_generation_id(table("x_worktrees"), some)


@query("SELECT s.repo_id, s.worktree_id, CASE WHEN s.active_generation IS NOT NULL AND w.observed_head <> s.indexed_head AND s.status = 'ready' THEN 'stale' WHEN s.active_generation IS NOT NULL AND w.observed_head = s.indexed_head AND s.status = 'stale' THEN 'ready' ELSE s.status END AS status FROM x_states s JOIN x_worktrees w ON w.repo_id = s.repo_id AND w.worktree_id = s.worktree_id")
def refresh_status(g, table):
    return R.refreshed(table("x_states"), table("x_worktrees"))


@query(f"""SELECT {KEY}, CASE WHEN ff THEN 'failed' WHEN a IS NOT NULL AND turn = 1 THEN 'active' WHEN a IS NOT NULL THEN 'retired' WHEN v IS NOT NULL THEN 'validated' ELSE 'building' END AS state FROM (
SELECT *, row_number() OVER (PARTITION BY repo_id, worktree_id ORDER BY a DESC NULLS LAST, generation_id DESC) AS turn FROM (
SELECT {KEY}, v, ff, CASE WHEN v IS NOT NULL AND NOT ff AND ac > v THEN ac END AS a FROM (SELECT {KEY}, v, ac, f IS NOT NULL AND (ac IS NULL OR f < ac) AS ff FROM (
SELECT g.repo_id, g.worktree_id, g.generation_id, max(e.seq) FILTER (WHERE e.action = 'validate') AS v, max(e.seq) FILTER (WHERE e.action = 'activate') AS ac, max(e.seq) FILTER (WHERE e.action = 'fail') AS f
FROM x_generations g LEFT JOIN x_events e ON e.repo_id = g.repo_id AND e.worktree_id = g.worktree_id AND e.generation_id = g.generation_id GROUP BY 1, 2, 3))))""")
def generation_lifecycle(g, table):
    return R.lifecycle(table("x_generations"), table("x_events"))


@query("SELECT w.repo_id, w.worktree_id, CASE WHEN nk % 5 = 0 THEN concat(worktree_path, '/new') ELSE worktree_path END AS worktree_path, CASE WHEN nk % 5 = 0 OR nk % 7 = 3 THEN CAST(2 AS BIGINT) WHEN nk % 2 = 1 THEN CAST(1 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS updated_at, CASE WHEN nk % 5 = 0 OR nk % 7 = 3 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS changed FROM x_worktrees w")
def register_worktrees(g, table):
    w = table("x_worktrees")
    old = w.where("nk % 7 <> 3").select("repo_id", "worktree_id", "worktree_path", F.lit(1).cast("long").alias("updated_at"))
    new = w.where("nk % 2 = 0 or nk % 5 = 0 or nk % 7 = 3").select("repo_id", "worktree_id", F.when(F.col("nk") % 5 == 0, F.concat("worktree_path", F.lit("/new"))).otherwise(F.col("worktree_path")).alias("worktree_path"), F.lit(2).cast("long").alias("updated_at"))
    return R.upsert_changed(old, new, ["repo_id", "worktree_id"], "updated_at")


@query("SELECT repo_id, worktree_id, CASE WHEN nk % 3 = 0 THEN 'ready' ELSE 'unindexed' END AS status FROM x_worktrees")
def register_state(g, table):
    w = table("x_worktrees")
    return R.insert_absent(w.where("nk % 3 = 0").select("repo_id", "worktree_id", F.lit("ready").alias("status")), w.select("repo_id", "worktree_id", F.lit("unindexed").alias("status")), ["repo_id", "worktree_id"])


@query("SELECT blob_sha, CASE WHEN byte_size % 4 = 0 THEN 'sha256' ELSE object_format END AS object_format, CASE WHEN byte_size % 4 = 0 THEN byte_size + 1 ELSE byte_size END AS byte_size FROM x_blobs")
def upsert_blobs(g, table):
    blobs = table("x_blobs")
    new = blobs.where("byte_size % 4 = 0").select("blob_sha", F.lit("sha256").alias("object_format"), (F.col("byte_size") + 1).alias("byte_size"))
    return R.upsert(blobs.where("byte_size % 8 <> 0"), new, ["blob_sha"])


@query("SELECT count(*) AS blobs, count(*) FILTER (WHERE c.blob_sha IS NOT NULL) AS hits, count(*) FILTER (WHERE c.blob_sha IS NULL) AS misses FROM (SELECT DISTINCT blob_sha, object_format FROM x_blobs) b LEFT JOIN (SELECT DISTINCT blob_sha, object_format FROM x_cache) c ON c.blob_sha = b.blob_sha AND c.object_format = b.object_format")
def cache_stats(g, table):
    return R.cache_stats(table("x_blobs"), table("x_cache"))


@query("SELECT DISTINCT blob_sha, object_format FROM x_blobs WHERE blob_sha NOT IN (SELECT blob_sha FROM x_cache)")
def syntax_pending(g, table):
    return R.pending(table("x_blobs"), table("x_cache"))
