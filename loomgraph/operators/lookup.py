"""Symbol and file lookups, ranked search, and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.projection import Graph
from loomgraph.storage import cut

SYMBOL = ("key", "kind", "package_key", "file_key", "name", "signature", "receiver", "path", "start_line", "end_line", "exported")
#: Kinds of edges that a symbol's neighbourhood follows in both directions; references come in only.
SEMANTIC = ("calls", "possible_call", "unresolved_call", "implements", "tests")


def find_symbols(g: Graph, query: str) -> DataFrame:
    """All symbols of that key or name, by package, file, line and key."""
    return g.symbols.where((F.col("key") == query) | (F.col("name") == query)).select(*SYMBOL).orderBy("package_key", "file_key", "start_line", "key")


def file_metadata(g: Graph, query: str) -> DataFrame:
    """The first file of that path or key, by path."""
    return g.files.where((F.col("path") == query) | (F.col("key") == query)).orderBy("path").limit(1)


def imports_of(g: Graph, packages: DataFrame) -> DataFrame:
    """packages: package_key. Their dependencies with a label: the import path, or an external package's name."""
    known = g.packages.select(F.col("key").alias("target_package"), "import_path")
    outside = F.when(F.col("target_package").startswith("external:package:"), F.expr("substring(target_package, 18)")).otherwise(F.col("target_package"))
    own = g.dependencies.join(packages.select(F.col("package_key").alias("source_package")).distinct(), "source_package", "left_semi")
    return own.join(known, "target_package", "left").select("source_package", "target_package", F.coalesce("import_path", outside).alias("label"))


def find_file(g: Graph, query: str) -> DataFrame:
    """One row: the file, whether it is a test, its symbols by line, and its package's imports."""
    file = file_metadata(g, query)
    symbols = g.symbols.join(file.select(F.col("key").alias("file_key")), "file_key").groupBy("file_key").agg(F.array_sort(F.collect_list(F.struct("start_line", "key"))).alias("own"))
    imports = imports_of(g, file).groupBy("source_package").agg(F.array_sort(F.collect_set("label")).alias("imports"))
    found = file.join(symbols, file["key"] == symbols["file_key"], "left").join(imports, file["package_key"] == imports["source_package"], "left")
    none = F.array().cast("array<string>")
    return found.select("key", "path", "blob_sha", "package_key", F.contains("package_key", F.lit("#")).cast("long").alias("is_test"), F.coalesce(F.transform("own", lambda s: s["key"]), none).alias("symbols"), F.coalesce("imports", none).alias("imports"))


def search_symbols(g: Graph, terms: list[str], limit: int = 256) -> DataFrame:
    """Symbols by the number of terms that stand, whatever the case, in any of eight fields. Ranked before they are cut."""
    terms = list(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))
    known = g.packages.select(F.col("key").alias("package_key"), "import_path")
    joined = g.symbols.join(known, "package_key", "left")
    if not terms:
        return joined.limit(0).select(*SYMBOL, F.lit(0).cast("long").alias("matched"))
    fields = ("key", "name", "receiver", "signature", "package_key", "file_key", "path", "import_path")
    has = lambda t: F.greatest(*[F.instr(F.lower(F.coalesce(c, F.lit(""))), t) for c in fields]) > 0
    matched = sum((F.when(has(t), 1).otherwise(0) for t in terms), F.lit(0)).cast("long")
    return joined.withColumn("matched", matched).where("matched > 0").select(*SYMBOL, "matched").orderBy(F.desc("matched"), "package_key", "path", "start_line", "key").limit(min(limit, 2048))


def _touching(g: Graph, keys: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """keys: node. Each node's edges of these kinds, once each: references by their target, all others by either end. One scan; each end is a row, so the join is by equality."""
    edges = g.edges.where(F.col("kind").isin(*kinds)).select("source_key", "target_key", "kind", "confidence")
    ends = F.when(F.col("kind") == "references", F.array("target_key")).otherwise(F.array_distinct(F.array("source_key", "target_key")))
    found = edges.select(F.explode(ends).alias("node"), "*").join(keys.select("node"), "node", "left_semi")
    return found.select("node", "source_key", "target_key", "kind", "confidence").distinct()


def incident_edges(g: Graph, keys: DataFrame) -> DataFrame:
    """keys: node. Each node's edges of the semantic kinds, from either side, a self-edge once."""
    return _touching(g, keys, SEMANTIC)


def incoming_references(g: Graph, keys: DataFrame) -> DataFrame:
    edges = g.edges.where("kind = 'references'").select("source_key", "target_key", "kind", "confidence")
    nodes = keys.select(F.col("node").alias("target_key")).distinct()
    return edges.join(nodes, "target_key").select(F.col("target_key").alias("node"), "source_key", "target_key", "kind", "confidence")


EDGE = ["source_key", "target_key", "kind"]


def with_first_evidence(g: Graph, edges: DataFrame) -> DataFrame:
    """Edges with the lines of their evidence of the least id. They are written, as they are read twice: only evidence of these edges is aggregated."""
    edges = cut(edges, "found-edges")
    own = g.evidence.join(edges.select(*EDGE).distinct(), EDGE, "left_semi")
    place = F.struct("start_line", "end_line")
    first = own.groupBy(*EDGE).agg(F.min("evidence_id").alias("evidence_id"), F.min_by(place, "evidence_id").alias("e")).select(*EDGE, "evidence_id", "e.*")
    return edges.join(first, EDGE, "left")


def with_evidence(g: Graph, edges: DataFrame) -> DataFrame:
    """Edges with all their evidence, one row each. Other evidence is left out before the join, so that it isn't shuffled where there are few edges."""
    own = g.evidence.select(*EDGE, "evidence_id", "start_line", "end_line").join(edges.select(*EDGE), EDGE, "left_semi")
    return edges.join(own, EDGE, "left")


def _capped(edges: DataFrame, order: list[str], limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("node").orderBy(*order))
    return edges.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def with_labels(g: Graph, rows: DataFrame) -> DataFrame:
    """rows: a table, as it is read more than once. Adds path and package of either end: of a symbol its file and package, of a package itself, else nothing."""
    ends = rows.select(F.explode(F.array("source_key", "target_key")).alias("key"))
    known = g.symbols.select("key", "path", "package_key").join(ends, "key", "left_semi")
    for end in ("source", "target"):
        own = known.select(F.col("key").alias(f"{end}_key"), F.col("path").alias("_p"), F.col("package_key").alias("_k"))
        packages = g.packages.select(F.concat(F.lit("package:"), "key").alias(f"{end}_key"), F.col("directory").alias("_d"), F.col("key").alias("_o"))
        rows = rows.join(own, f"{end}_key", "left").join(packages, f"{end}_key", "left")
        rows = rows.withColumn(f"{end}_path", F.coalesce("_p", "_d", F.lit(""))).withColumn(f"{end}_package", F.coalesce("_k", "_o", F.lit(""))).drop("_p", "_k", "_d", "_o")
    return rows


def relationships_full(g: Graph, keys: DataFrame) -> DataFrame:
    """Every incident edge with every evidence, one row each; edges without evidence have one row of nulls."""
    return with_evidence(g, with_labels(g, cut(incident_edges(g, keys), "incident")))


def relationships_bounded(g: Graph, keys: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` incident edges of each node by kind, source and target, then their first evidence: the cut is before the join that multiplies."""
    return with_first_evidence(g, with_labels(g, cut(_capped(incident_edges(g, keys), ["kind", "source_key", "target_key"], limit), "capped")))


def references_full(g: Graph, keys: DataFrame) -> DataFrame:
    return with_evidence(g, cut(incoming_references(g, keys), "incoming"))


def references_bounded(g: Graph, keys: DataFrame, limit: int) -> DataFrame:
    return with_first_evidence(g, _capped(incoming_references(g, keys), ["source_key"], limit))


def bounded_neighborhood(g: Graph, keys: DataFrame, limit: int) -> DataFrame:
    """What a traversal sees of each node: bounded relationships and references, each once, numbered by kind, source, target and place."""
    columns = ("node", "source_key", "target_key", "kind", "confidence", "start_line", "end_line")
    # References have a limit of their own; within them the order is that of their sources.
    each = Window.partitionBy("node", F.col("kind") == "references").orderBy("kind", "source_key", "target_key")
    both = all_edges(g, keys).withColumn("_rank", F.row_number().over(each)).where(F.col("_rank") <= limit).drop("_rank")
    once = with_first_evidence(g, both).select(*columns)
    order = Window.partitionBy("node").orderBy("kind", "source_key", "target_key", F.col("start_line").asc_nulls_first(), F.col("end_line").asc_nulls_first())
    return once.withColumn("rel_idx", (F.row_number().over(order) - 1).cast("long"))


def bucket(node: str = "node") -> Column:
    """The list of a symbol's result that an edge belongs to; a self-edge is an outgoing one."""
    out, kind = F.col("source_key") == F.col(node), F.col("kind")
    calls = kind.isin("calls", "possible_call", "unresolved_call")
    return (
        F.when(calls & out, "callees").when(calls, "callers").when((kind == "implements") & out, "implements").when(kind == "implements", "implementers")
        .when((kind == "tests") & out, "tested").when(kind == "tests", "tests").otherwise("references")
    )


def all_edges(g: Graph, keys: DataFrame) -> DataFrame:
    """What a symbol's result is made of: its edges of the semantic kinds, and the references to it."""
    return _touching(g, keys, (*SEMANTIC, "references"))


def symbol_buckets(g: Graph, keys: DataFrame) -> DataFrame:
    """node, bucket, n and the other ends, sorted."""
    edges = all_edges(g, keys)
    other = F.when(F.col("source_key") == F.col("node"), F.col("target_key")).otherwise(F.col("source_key"))
    return edges.withColumn("bucket", bucket()).groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(other)).alias("others"))


def generation_counts(g: Graph) -> DataFrame:
    """One row of five counts."""
    one = lambda df, name, cond=None: df.agg((F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias(name))
    parts = [one(g.packages, "packages"), one(g.files, "files"), one(g.symbols, "symbols"), one(g.edges, "edges"), one(g.nodes, "tests", F.col("kind") == "test")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of one
    return out
