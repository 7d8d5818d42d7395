"""Queries through a store in the shared folder."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from loomgraph.operators.integrity import evidence_may_break, file_blobs
from loomgraph.projection import whole
from loomgraph.queries import query
from loomgraph.storage import shared_dir
from loomgraph.store import Store, catalog_scan as scanned


def _sound(g):
    """The projection as a candidate that may become active: edges between nodes, evidence once, unknown blobs left out."""
    nodes = g.nodes.select("key")
    # Few kinds have ends that are no nodes; edges of the others need no joins.
    ends = g.edges.select("kind", F.col("source_key").alias("key")).distinct().unionByName(g.edges.select("kind", F.col("target_key").alias("key")).distinct())
    loose = F.coalesce(F.col("kind"), F.lit("")).isin([r["kind"] or "" for r in ends.join(nodes, "key", "left_anti").select("kind").distinct().collect()])
    found = g.edges.where(loose).join(nodes.withColumnRenamed("key", "source_key"), "source_key", "left_semi").join(nodes.withColumnRenamed("key", "target_key"), "target_key", "left_semi")
    edges = g.edges.where(~loose).unionByName(found)
    # Likewise evidence of kinds whose edges all stay, if each has its edge and stands once.
    shown = edges.join(F.broadcast(g.evidence.select("kind").distinct()), "kind", "left_semi")
    calm = not evidence_may_break(shown.where(~loose), g.evidence.where(~loose))
    evidence = (g.evidence.where(loose) if calm else g.evidence).join(shown.where(loose) if calm else shown, ["source_key", "target_key", "kind"], "left_semi")
    evidence = evidence.dropDuplicates(["source_key", "target_key", "kind", "start_line", "end_line", "details"]).select(*g.evidence.columns)
    evidence = evidence.unionByName(g.evidence.where(~loose)) if calm else evidence
    unknown = file_blobs(g).select("key", F.lit(1).alias("unknown"))
    files = g.files.join(unknown, "key", "left").select("key", "path", F.when(F.col("unknown") == 1, "").otherwise(F.col("blob_sha")).alias("blob_sha"), "package_key")
    return replace(whole(g), edges=edges.select(*g.edges.columns), evidence=evidence, files=files)


def _store(g) -> Store:
    return Store(g.spark, f"{shared_dir(g.spark)}/store-{uuid.uuid4().hex}")


@query("SELECT kind, count(*) AS symbols, max(end_line) AS last_line FROM g_symbols GROUP BY kind")
def open_view(g, table):
    """Writes the projection as a generation, activates it and reads it back pinned."""
    store = _store(g)
    key, _ = store.ensure(lambda: _sound(g), "c1", "f1")
    return store.open_view(key).symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("symbols"), F.max("end_line").alias("last_line"))


@query("SELECT * FROM (VALUES (1, 'rebuild', CAST(1 AS BIGINT)), (2, 'reuse', CAST(1 AS BIGINT)), (3, 'rebuild', CAST(2 AS BIGINT))) t(step, mode, generation)")
def ensure_graph(g, table):
    """First build, reuse of the same commit and fingerprint, rebuild for another commit."""
    store = _store(g)
    build = lambda: _sound(g) if store.active() is None else store.open_view()  # noqa: E731  (the commits have the same graph)
    steps = [(k + 1, *reversed(store.ensure(build, commit, "f1"))) for k, commit in enumerate(("c1", "c1", "c2"))]
    return g.spark.createDataFrame(steps, "step int, mode string, generation long")


@query("SELECT * FROM (VALUES ('a', CAST(1 AS BIGINT), CAST(1 AS BIGINT), ''), ('b', CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 'no generations')) t(store, generations, active, issue)")
def catalog_scan(g, table):
    a, b = _store(g), _store(g)
    a.ensure(lambda: _sound(g), "c1", "f1")
    rows = scanned(g.spark, [a.root, b.root])
    return rows.select(F.when(F.col("root") == a.root, "a").otherwise("b").alias("store"), "generations", "active", "issue")


_DONE = "SELECT * FROM (VALUES ('failed', CAST(1 AS BIGINT)), ('loose', CAST(8 AS BIGINT)), ('orphans', CAST(0 AS BIGINT)), ('active', CAST(1 AS BIGINT)), ('unhealthy', CAST(0 AS BIGINT)), ('recovered', CAST(0 AS BIGINT))) t(what, n)"


@query(f"SELECT what, n FROM ({_DONE}) UNION ALL SELECT 'symbols', count(*) FROM g_symbols")
def store_recovery(g, table):
    """A writer that died, repair, compaction, health and the quarantine of a store: how many of each."""
    store = _store(g)
    store.ensure(lambda: _sound(g), "c1", "f1")
    store.write_generation(store.open_view(), "c2", "f1")
    done = store.repair()  # loose: four versions before the last, each a pointer and its data
    store.compact()
    done |= {"active": store.active(), "symbols": store.open_view().symbols.count(), "unhealthy": store.health().where("status <> 'ok'").count()}
    store.recover()
    done["recovered"] = store.control().count()
    return g.spark.createDataFrame(list(done.items()), "what string, n long")
