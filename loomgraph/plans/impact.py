"""Impact analysis: task seeds, bounded scored traversal, package evidence, and the three radii.

The traversal runs level by level: all nodes of a level look up their bounded neighbourhoods in one join, and each
new node is claimed by its first parent in queue order. What every level reads is written to the shared folder once, and the nodes
between levels, so plans stay small. Within a level nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions import text as T
from loomgraph.operators.lookup import SEMANTIC, SYMBOL, all_edges, bounded_neighborhood, search_symbols
from loomgraph.projection import Graph
from loomgraph.storage import cut

#: Weights of edge kinds; every step costs 15 for each level of its depth.
WEIGHTS = {"calls": 90, "possible_call": 65, "unresolved_call": 25, "references": 55, "implements": 75, "tests": 60}
OTHER_WEIGHT, STEP_COST = 10, 15
REQUIRED = ("must-read", "high", "direct-test", "package-tests", "package-risk", "external", "historical")


@dataclass(frozen=True)
class Request:
    """Limits of an analysis: seeds 1..64, depth 1..12, fanout 1..512, items 1..2048."""

    task: str
    max_seeds: int = 8
    max_depth: int = 3
    max_fanout: int = 32
    max_items: int = 24
    seed_keys: tuple[str, ...] = ()
    seed_only: bool = False

    def __post_init__(self):
        for name, most in (("max_seeds", 64), ("max_depth", 12), ("max_fanout", 512), ("max_items", 2048)):
            if not 1 <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be 1 to {most}")


def task_terms(g: Graph, task: str) -> list[str]:
    """The significant terms of a task, by the same column functions that symbols are read with."""
    return list(g.spark.range(1).select(T.significant_terms(F.lit(task)).alias("t")).first()["t"])


def score_candidates(symbols: DataFrame, task: str, terms: list[str]) -> DataFrame:
    """Adds score and match to symbols."""
    name, key, task_id = T.normalized_identifier(F.col("name")), T.normalized_identifier(F.col("key")), T.normalized_identifier(F.lit(task))
    own = T.tokenize(F.col("name"))
    text = F.lower(F.concat_ws(" ", "key", "name", "receiver", "signature", "package_key", "file_key", "path"))
    count = lambda cond: sum((F.when(cond(t), 1).otherwise(0) for t in terms), F.lit(0))
    matched, named = count(lambda t: F.contains(text, F.lit(t))), count(lambda t: F.array_contains(own, t))
    all_in = reduce(Column.__and__, [F.contains(F.array_join(own, ""), F.lit(t)) for t in terms], F.lit(bool(terms)))
    any_in = lambda c: reduce(Column.__or__, [F.contains(F.lower(c), F.lit(t)) for t in terms], F.lit(False))
    rules = (
        ((name == task_id) | (key == task_id), 1000, "exact identifier"), (all_in, 400, "name terms"),
        ((task_id != "") & F.endswith(task_id, name) & (F.octet_length(name) >= 4), 700, "task identifier"),
        (F.contains(name, task_id) & (task_id != ""), 350, "name prefix"), (F.contains(F.lower("signature"), F.lit(task.lower())), 140, "signature"),
    )
    bonus, match = F.lit(0), F.lit("field token")
    for cond, value, said in reversed(rules):
        bonus, match = F.when(cond, value).otherwise(bonus), F.when(cond, said).otherwise(match)
    where = F.when((F.col("path") != "") & any_in(F.col("path")), 15).otherwise(0) + F.when((F.col("package_key") != "") & any_in(F.col("package_key")), 12).otherwise(0)
    return symbols.withColumn("score", (matched * 10 + named * 140 + bonus + where).cast("long")).withColumn("match", match)


def seeds(g: Graph, request: Request) -> DataFrame:
    """Candidates by score, key, path and name, with ``selected``: 1 for the overrides, up to max_seeds; without any, for those that share the top score, up to max_seeds.

    Overrides (``seed_keys``) score 1000 more and count as candidates too; seed_only leaves the search out. A key that no symbol
    has is no candidate. ``historical`` symbols (where the graph has such a column) keep their flag.
    """
    terms = task_terms(g, request.task)
    pool = max(32, min(512, 8 * request.max_seeds))
    found = score_candidates(search_symbols(g, terms, pool).limit(0 if request.seed_only else pool), request.task, terms).withColumn("place", F.lit(0))
    if request.seed_keys:
        wanted = g.spark.createDataFrame([(k, n + 1) for n, k in enumerate(dict.fromkeys(request.seed_keys))], "key string, place int")
        own = score_candidates(g.symbols.select(*SYMBOL, F.lit(0).cast("long").alias("matched")), request.task, terms).join(wanted, "key")
        own = own.withColumn("score", F.col("score") + 1000).withColumn("match", F.lit("qualified override"))
        # The search's own row of an overridden key stands in the list of candidates; the override is what is selected.
        found = found.join(wanted.select("key"), "key", "left_anti").unionByName(own)
    everything = Window.partitionBy(F.lit(0))  # a pool of 512 rows and the overrides at most
    ranked = found.withColumn("rank", F.row_number().over(everything.orderBy(F.desc("score"), "key", "path", "name")).cast("long"))
    top = (F.col("score") == F.max("score").over(everything)) & (F.col("rank") <= request.max_seeds)
    first = F.row_number().over(everything.orderBy(F.when(F.col("place") > 0, F.col("place")).otherwise(1 << 30))) <= request.max_seeds
    chosen = F.when(F.max("place").over(everything) > 0, (F.col("place") > 0) & first).otherwise(top)
    return ranked.withColumn("selected", chosen.cast("long")).where(F.col("rank") <= pool).select(*SYMBOL, "score", "match", "rank", "selected")


def edge_weight(kind: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, value in WEIGHTS.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


@dataclass(frozen=True)
class Traversal:
    nodes: DataFrame
    packages: DataFrame
    truncated: bool


def stored(g: Graph) -> Graph:
    """The graph with what a traversal reads written once, unless its relations are tables already: edges of the kinds that it follows, evidence, symbols."""
    if g.written:
        return g
    edges = g.edges.where(F.col("kind").isin(*SEMANTIC, "references")).select("source_key", "target_key", "kind", "confidence")
    evidence = g.evidence.select("source_key", "target_key", "kind", "evidence_id", "start_line", "end_line")
    history = [c for c in ("historical",) if c in g.symbols.columns]
    return replace(g, edges=cut(edges, "edges"), evidence=cut(evidence, "evidence"), symbols=cut(g.symbols.select("key", "kind", "name", "package_key", "path", *history), "symbols"))


def _package_of(other: Column) -> Column:
    """The package that a neighbour which is no symbol stands for: itself, or the one before the colon of an external symbol."""
    outside = F.split_part(F.regexp_replace(other, "^external:symbol:", ""), F.lit(":"), F.lit(1))
    return F.when(other.startswith("package:"), F.substr(other, F.lit(9))).otherwise(F.concat(F.lit("external:package:"), F.when(outside == "", "unknown").otherwise(outside)))


def package_evidence(found: DataFrame) -> DataFrame:
    """found: key, score, current (package of the node before), steps, marks (one for each step), depth, parent_rank, rel_idx. Of each package the evidence that stands.

    In queue order a higher score replaces what is known, an equal one only if its own step comes before the whole path of
    what is known. Only candidates of the top score are gathered; a traversal's fanout and depth bound them.
    """
    own = Window.partitionBy("key")
    top = found.withColumn("best", F.max("score").over(own)).where("score = best")
    one = F.struct("depth", "parent_rank", "rel_idx", "score", "steps", F.array_join("marks", "\x01").alias("path"), F.element_at("marks", -1).alias("own"), "current")
    lists = top.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.col("all")[0], lambda a, x: F.when(x["own"] < a["path"], x).otherwise(a))
    external = F.col("key").startswith("external:") | (F.col("key") != F.col("e.current"))
    name = F.regexp_replace(F.regexp_replace("key", "^go:package:", ""), "^external:package:", "")
    return lists.select("key", kept.alias("e")).select("key", name.alias("name"), F.col("e.score").alias("score"), external.cast("long").alias("external"), F.col("e.steps").alias("steps"))


def traverse(g: Graph, start: DataFrame, max_depth: int = 3, max_fanout: int = 32) -> Traversal:
    """start: key, score, rank. All nodes reached, each claimed by its first parent in order of queue and relationship.

    nodes: key, depth, score, rank (within its depth), first_kind, steps (the path's edges), package_key, path, name, kind, historical (0/1).
    packages: see ``package_evidence``. A neighbour that is neither a symbol nor a package nor external is left out.
    """
    g = stored(g)
    past = F.col("historical").cast("long") if "historical" in g.symbols.columns else F.lit(0).cast("long")
    symbols = g.symbols.select("key", "kind", "name", "package_key", "path", past.alias("historical"))
    own = ("kind", "name", "package_key", "path", "historical")
    none = F.array().cast("array<string>")
    level = start.select("key", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank")).join(symbols, "key")
    level = level.select("key", F.lit(0).cast("long").alias("depth"), "score", "rank", F.lit("").alias("first_kind"), none.alias("steps"), none.alias("marks"), *own)
    level, seen, outside, truncated = cut(level, "level"), [], [], False
    for depth in range(max_depth + 1):
        seen.append(level)
        if depth == max_depth:
            truncated = truncated or not all_edges(g, level.select(F.col("key").alias("node"))).isEmpty()
            break
        around = cut(bounded_neighborhood(g, level.select(F.col("key").alias("node")), max_fanout + 1), "around")
        truncated = truncated or not around.where(F.col("rel_idx") >= max_fanout).isEmpty()
        other = F.when(F.col("source_key") == F.col("node"), F.col("target_key")).otherwise(F.col("source_key"))
        step = F.concat(F.col("rel_kind"), F.lit(":"), "source_key", F.lit(">"), "target_key")
        mark = F.concat_ws("\x01", "source_key", "target_key", "rel_kind")
        near = around.where(F.col("rel_idx") < max_fanout).withColumn("other", other).where("other <> node").withColumnRenamed("kind", "rel_kind")
        parent = level.select(F.col("key").alias("node"), F.col("rank").alias("parent_rank"), F.col("score").alias("parent_score"), F.col("steps").alias("parent_steps"), F.col("marks").alias("parent_marks"), F.col("package_key").alias("parent_package"), F.col("path").alias("parent_path"))
        bonus = F.when(F.col("confidence") == "exact", 10).when(F.col("confidence") == "inferred", 5).otherwise(0)
        moved = (F.col("parent_score") + edge_weight(F.col("rel_kind")) - STEP_COST * (depth + 1) + bonus).cast("long")
        moves = near.join(parent, "node").withColumn("moved", moved).withColumn("steps", F.concat("parent_steps", F.array(step))).withColumn("marks", F.concat("parent_marks", F.array(mark)))
        beyond = moves.where(F.col("other").startswith("external:") | F.col("other").startswith("package:")).join(symbols.select(F.col("key").alias("other")), "other", "left_anti")
        outside.append(beyond.select(_package_of(F.col("other")).alias("key"), F.col("moved").alias("score"), F.col("parent_package").alias("current"), "steps", "marks", F.lit(depth).cast("long").alias("depth"), "parent_rank", "rel_idx"))
        new = moves.where(~F.col("other").startswith("package:")).join(symbols.withColumnRenamed("key", "other"), "other")
        for known in seen:
            new = new.join(known.select(F.col("key").alias("other")), "other", "left_anti")
        claim = Window.partitionBy("other").orderBy("parent_rank", "rel_idx")
        near_by = F.when((F.col("package_key") != "") & (F.col("package_key") == F.col("parent_package")), 10).otherwise(0) + F.when((F.col("path") != "") & (F.col("path") == F.col("parent_path")), 8).otherwise(0)
        claimed = new.withColumn("turn", F.row_number().over(claim)).where("turn = 1")
        # The queue's order needs no dense numbers: parents and relationships are both bounded, so one number holds both.
        rank = F.col("parent_rank") * (max_fanout + 1) + F.col("rel_idx")
        level = cut(claimed.select(F.col("other").alias("key"), F.lit(depth + 1).cast("long").alias("depth"), (F.col("moved") + near_by).cast("long").alias("score"), rank.alias("rank"), F.col("rel_kind").alias("first_kind"), "steps", "marks", *own), "level")
        if level.isEmpty():
            break
    empty = g.spark.createDataFrame([], "key string, name string, score long, external long, steps array<string>")
    packages = package_evidence(reduce(DataFrame.unionByName, outside)) if outside else empty
    return Traversal(reduce(DataFrame.unionByName, seen).drop("marks"), packages, truncated)


def _ordered(items: DataFrame, order: list, limit: int) -> DataFrame:
    """Numbers items in order; beyond ``limit``, required labels go before all others, each in order. The lists are bounded by fanout and depth."""
    everything = Window.partitionBy(F.lit(0))
    items = items.withColumn("ord", F.row_number().over(everything.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(everything))
    last = F.when((F.col("n") > limit) & ~F.col("label").isin(*REQUIRED), 1).otherwise(0)
    placed = items.withColumn("place", F.row_number().over(everything.orderBy(last, "ord")).cast("long")).withColumn("cut", F.col("n") > limit)
    return placed.where(F.col("place") <= limit).drop("ord", "n")


def _by_score() -> list:
    return [F.desc("score"), "depth", "path", "key"]


#: What a report says of an item.
REASONS = {"context": ("deleted baseline symbol retained to explain former callers and tests", "direct task seed; read before implementation"), "implementation": ("historical deleted symbol; inspect former dependents before removing behavior", "direct task seed; likely implementation owner")}


def _reached() -> Column:
    return F.concat(F.lit("reached through "), "first_kind", F.lit(" at graph distance "), F.col("depth").cast("string"))


SHOWN = ("place", "key", "kind", "label", "score", "depth", "reason", "cut")


def context_radius(t: Traversal, limit: int = 24) -> DataFrame:
    past, seed, test = F.col("historical") == 1, F.col("depth") == 0, F.col("kind") == "test"
    label = F.when(past, "historical").when(seed, "must-read").when(test, "test").otherwise("supporting")
    said = F.when(past, REASONS["context"][0]).when(seed, REASONS["context"][1]).when(test, F.concat(F.lit("test associated through "), "first_kind", F.lit(" at graph distance "), F.col("depth").cast("string"))).otherwise(_reached())
    return _ordered(t.nodes.withColumn("label", label), _by_score(), limit).withColumn("reason", said).select(*SHOWN)


def implementation_radius(t: Traversal, limit: int = 24) -> DataFrame:
    past, seed = F.col("historical") == 1, F.col("depth") == 0
    unresolved, far = F.col("first_kind") == "unresolved_call", F.col("first_kind").isin("calls", "possible_call")
    label = F.when(past, "historical").when(seed, "high").when(unresolved, "inspect-only").when(F.col("depth") == 1, "medium").when(far, "downstream").otherwise("low")
    said = F.when(past, REASONS["implementation"][0]).when(seed, REASONS["implementation"][1]).when(unresolved, "unresolved call target; inspect manually before changing").when((F.col("depth") > 1) & far, "downstream dependency reached through bounded call traversal").otherwise(_reached())
    return _ordered(t.nodes.where("kind <> 'test'").withColumn("label", label), _by_score(), limit).withColumn("reason", said).select(*SHOWN)


def validation_radius(t: Traversal, limit: int = 24) -> DataFrame:
    """Tests by score, then packages by key: those of reached symbols that are no tests, and those with evidence of their own."""
    tests = t.nodes.where("kind = 'test'").select("key", "kind", F.lit("direct-test").alias("label"), "score", F.lit(0).alias("part"), "depth", "path", F.lit("test relationship reached from the impacted graph").alias("reason"))
    best = t.nodes.where("package_key <> ''").groupBy(F.col("package_key").alias("key")).agg(F.max("score").alias("best"), F.bool_or(F.col("kind") != "test").alias("named"))
    known = best.join(t.packages.select("key", F.col("score").alias("own"), "external"), "key", "full_outer").where("named or own is not null")
    none, out = F.col("own").isNull(), F.col("external") == 1
    label = F.when(none, "package-risk").when(out, "external").otherwise("package-tests")
    said = F.when(none, "package needs validation even without an exact test-symbol association").when(out, "external package relationship; validate integration at the boundary").otherwise("package relationship requires validation")
    # A best score of 0 or less counts as 20.
    rest = F.when(F.coalesce("best", F.lit(0)) > 0, F.col("best")).otherwise(F.lit(20)) - 20
    packages = known.select(F.concat(F.lit("package:"), "key").alias("key"), F.lit("package").alias("kind"), label.alias("label"), F.coalesce("own", rest).cast("long").alias("score"), F.lit(1).alias("part"), F.lit(0).cast("long").alias("depth"), F.lit("").alias("path"), said.alias("reason"))
    order = ["part", F.when(F.col("part") == 0, -F.col("score")), "depth", "path", "key"]
    return _ordered(tests.unionByName(packages), order, limit).select(*SHOWN)


def report(g: Graph, request: Request) -> dict:
    """The whole analysis: seeds, status, traversal, radii, five flags of what was cut, and diagnostics (severity, code, message).

    Without a seed there is no traversal: the radii are empty.
    """
    found = cut(seeds(g, request), "seeds")
    pool, chosen = max(32, min(512, 8 * request.max_seeds)), found.where("selected = 1").count()
    top = found.where(F.col("score") == found.agg(F.max("score").alias("m")).first()["m"]).count() if chosen else 0
    diagnostics = [("warning", "seed-not-found", f"qualified seed {k} did not match an indexed symbol key") for k in dict.fromkeys(request.seed_keys) if found.where(F.col("key") == k).isEmpty()]
    overridden = not found.where("match = 'qualified override'").isEmpty()
    flags = {"seeds": found.where("match = 'qualified override'").count() > chosen if overridden else top > request.max_seeds}
    if chosen > 1:
        diagnostics.append(("warning", "ambiguous-seeds", "multiple equally ranked task seeds were selected; use --seed with a canonical symbol key to narrow the report"))
    walk = traverse(g, found.where("selected = 1"), request.max_depth, request.max_fanout)
    walk = Traversal(cut(walk.nodes, "nodes"), cut(walk.packages, "packages"), walk.truncated)
    radii = {"context": context_radius(walk, request.max_items), "implementation": implementation_radius(walk, request.max_items), "validation": validation_radius(walk, request.max_items)}
    radii = {name: cut(df, name) for name, df in radii.items()}
    flags |= {name: not df.where("cut").isEmpty() for name, df in radii.items()} | {"traversal": walk.truncated}
    if walk.truncated:
        diagnostics.append(("info", "traversal-limit", f"impact traversal stopped at depth {request.max_depth} or was capped at {request.max_fanout} relationships of a symbol"))
    status = "no-match" if not chosen else "matched" if chosen == 1 else "ambiguous"
    return {"status": status, "seeds": found, "traversal": walk, "pool": pool, "flags": flags, "truncated": any(flags.values()), "diagnostics": diagnostics, **radii}
