"""Integrity of a stored graph: violation counts, the health that follows from them, and the rules of a candidate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.paths import escapes
from loomgraph.projection import Graph

ERROR, WARNING, OK = "error", "warning", "ok"
#: Parts that graphs are compared by.
BUCKETS = 4096


def _lacks(rows: DataFrame, key: str, known: DataFrame, column: str, skip_empty: bool = False) -> DataFrame:
    rows = rows.where(F.col(key) != "") if skip_empty else rows
    return rows.join(known.select(F.col(column).alias(key)), key, "left_anti")


def _either(rows: DataFrame, checks: list[tuple[str, DataFrame, str, bool]], identity: list[str]) -> DataFrame:
    """Rows that fail any of the anti-joins, once each."""
    return reduce(DataFrame.unionByName, [_lacks(rows, k, known, c, skip).select(*identity) for k, known, c, skip in checks]).distinct()


def edge_endpoints(g: Graph) -> DataFrame:
    """Edges with an end that is no node, once each: both ends are looked up in one anti-join."""
    ends = g.edges.select("source_key", "target_key", "kind", F.explode(F.array("source_key", "target_key")).alias("key"))
    return ends.join(g.nodes.select("key"), "key", "left_anti").select("source_key", "target_key", "kind").distinct()


def file_blobs(g: Graph) -> DataFrame:
    return _lacks(g.files, "blob_sha", g.blobs, "sha")


def symbol_ownership(g: Graph) -> DataFrame:
    return _either(g.symbols, [("package_key", g.packages, "key", False), ("file_key", g.files, "key", False)], ["key"])


def node_ownership(g: Graph) -> DataFrame:
    return _either(g.nodes, [("package_key", g.packages, "key", True), ("file_key", g.files, "key", True), ("symbol_key", g.symbols, "key", True)], ["key"])


def evidence_edges(g: Graph) -> DataFrame:
    return g.evidence.join(g.edges, ["source_key", "target_key", "kind"], "left_anti")


def package_dependencies(g: Graph) -> DataFrame:
    """Dependencies whose source is unknown, or whose target is neither known nor external."""
    inside = g.dependencies.where(~F.col("target_package").startswith("external:"))
    source = _lacks(g.dependencies, "source_package", g.packages, "key").select("source_package", "target_package")
    return source.unionByName(_lacks(inside, "target_package", g.packages, "key").select("source_package", "target_package")).distinct()


def test_relationships(g: Graph) -> DataFrame:
    return _either(g.tests, [("test_key", g.symbols, "key", False), ("target_key", g.symbols, "key", False)], ["test_key", "target_key"])


def duplicate_edges(g: Graph) -> DataFrame:
    return g.edges.groupBy("source_key", "target_key", "kind").count().where("count > 1")


CHECKS = {
    "edge_endpoints": edge_endpoints, "file_blobs": file_blobs, "symbol_ownership": symbol_ownership, "node_ownership": node_ownership, "evidence": evidence_edges,
    "package_dependencies": package_dependencies, "test_relationships": test_relationships, "duplicate_edges": duplicate_edges,
}


def doctor(g: Graph, names: tuple[str, ...] = tuple(CHECKS)) -> DataFrame:
    """A row for each check: name, status, violations."""
    rows = [CHECKS[n](g).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("check"), F.when(F.col("violations") > 0, ERROR).otherwise(OK).alias("status"), "violations") for n in names]
    return reduce(DataFrame.unionByName, rows)


def summary(checks: DataFrame) -> DataFrame:
    """One row: unhealthy with an error, else warning, else healthy. Rows of status info count as warnings of no weight."""
    errors, warnings = F.count_if(F.col("status") == ERROR), F.count_if(F.col("status") == WARNING)
    return checks.agg(errors.alias("errors"), warnings.alias("warnings"), F.sum("violations").alias("violations")).select(
        F.when(F.col("errors") > 0, "unhealthy").when(F.col("warnings") > 0, "warning").otherwise("healthy").alias("health"), "errors", "warnings", F.coalesce("violations", F.lit(0)).alias("violations")
    )


#: Confidences that a record may state; an empty one stands for the default.
CONFIDENCES = ("exact", "inferred", "possible")
SEVERITIES = ("info", "warning", "error")


def _blank(*columns: str) -> Column:
    return reduce(Column.__or__, [F.coalesce(F.col(c), F.lit("")) == "" for c in columns])


def _negative(*columns: str) -> Column:
    return reduce(Column.__or__, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in columns])


def _unknown(column: str) -> Column:
    return ~_blank(column) & ~F.col(column).isin(*CONFIDENCES)


def _flagged(df: DataFrame, subject: tuple[str, ...], *rules: tuple[str, Column]) -> DataFrame:
    """A row for each rule that a record breaks; one scan for all rules of a relation."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules]))
    return df.where(reduce(Column.__or__, [cond for _, cond in rules])).select(F.explode(broken).alias("rule"), F.concat_ws("|", *subject).alias("subject"))


def _repeated(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("subject"))


def validate_uniqueness(g: Graph) -> DataFrame:
    """Records that stand more than once: rule, subject. Evidence is told apart by edge, lines and details."""
    return reduce(DataFrame.unionByName, [
        _repeated(g.packages, "package-key", "key"), _repeated(g.files, "file-key", "key"), _repeated(g.files, "file-path", "path"), _repeated(g.symbols, "symbol-key", "key"),
        _repeated(g.nodes, "node-key", "key"), _repeated(g.edges, "edge", "source_key", "target_key", "kind"), _repeated(g.dependencies, "dependency", "source_package", "target_package"),
        _repeated(g.tests, "test", "test_key", "target_key"), _repeated(g.blobs, "blob", "sha"),
        _repeated(g.evidence, "evidence", "source_key", "target_key", "kind", "start_line", "end_line", "details"),
    ])


def validate_fields(g: Graph) -> DataFrame:
    """Missing values, paths out of the tree, negative places and unknown confidences: rule, subject."""
    edge, test, dependency = ("source_key", "target_key", "kind"), ("test_key", "target_key"), ("source_package", "target_package")
    return reduce(DataFrame.unionByName, [
        _flagged(g.packages, ("key",), ("package-key-empty", _blank("key")), ("package-directory", escapes(F.col("directory")))),
        _flagged(g.blobs, ("sha",), ("blob-empty", _blank("sha")), ("blob-size", _negative("byte_size"))),
        _flagged(g.files, ("key",), ("file-empty", _blank("key", "path")), ("file-escapes", escapes(F.col("path")))),
        _flagged(g.symbols, ("key",), ("symbol-empty", _blank("key", "package_key", "file_key")), ("symbol-lines", _negative("start_line", "end_line"))),
        _flagged(g.nodes, ("key",), ("node-empty", _blank("key")), ("node-kind", _blank("kind")), ("node-lines", _negative("source_start", "source_end"))),
        _flagged(g.edges, edge, ("edge-empty", _blank(*edge)), ("edge-confidence", _unknown("confidence"))),
        _flagged(g.evidence, edge, ("evidence-empty", _blank(*edge)), ("evidence-lines", _negative("start_line", "end_line"))),
        _flagged(g.dependencies, dependency, ("dependency-empty", _blank(*dependency))),
        _flagged(g.tests, test, ("test-empty", _blank(*test)), ("test-confidence", _unknown("confidence"))),
    ])


def validate_references(g: Graph) -> DataFrame:
    """Records that point to nothing: rule, subject. Only owned nodes must point to something; empty owners of files, nodes and edges are allowed."""
    edge, test, dependency = ("source_key", "target_key", "kind"), ("test_key", "target_key"), ("source_package", "target_package")
    owned = g.nodes.where("owned = 1")
    inside = g.dependencies.where(~F.coalesce(F.col("target_package"), F.lit("")).startswith("external:package:"))
    testable = g.symbols.select("key").unionByName(g.nodes.where("kind = 'package'").select("key"))
    links = (
        ("file-package", g.files, "package_key", g.packages, "key", True, ("key",)), ("file-blob", g.files, "blob_sha", g.blobs, "sha", True, ("key",)),
        ("symbol-package", g.symbols, "package_key", g.packages, "key", False, ("key",)), ("symbol-file", g.symbols, "file_key", g.files, "key", False, ("key",)),
        ("node-package", owned, "package_key", g.packages, "key", True, ("key",)), ("node-file", owned, "file_key", g.files, "key", True, ("key",)), ("node-symbol", owned, "symbol_key", g.symbols, "key", True, ("key",)),
        ("edge-source", g.edges, "source_key", g.nodes, "key", False, edge), ("edge-target", g.edges, "target_key", g.nodes, "key", False, edge), ("edge-owner", g.edges, "owner_package", g.packages, "key", True, edge),
        ("dependency-source", g.dependencies, "source_package", g.packages, "key", False, dependency), ("dependency-target", inside, "target_package", g.packages, "key", False, dependency),
        ("test-symbol", g.tests, "test_key", g.symbols, "key", False, test), ("test-target", g.tests, "target_key", testable, "key", False, test),
    )
    said = lambda df, rule, subject: df.select(F.lit(rule).alias("rule"), F.concat_ws("|", *subject).alias("subject"))
    rows = [said(_lacks(df, key, known, column, skip), rule, subject) for rule, df, key, known, column, skip, subject in links]
    return reduce(DataFrame.unionByName, [*rows, said(evidence_edges(g), "evidence-edge", edge)])


def _diagnosed(diagnostics: DataFrame) -> DataFrame:
    unknown = ~F.coalesce(F.col("severity"), F.lit("")).isin(*SEVERITIES)
    return _flagged(diagnostics, ("code", "message"), ("diagnostic", unknown | _blank("code") | _blank("message")), ("diagnostic-error", F.col("severity") == ERROR))


def validate_analysis(g: Graph, diagnostics: DataFrame | None = None) -> DataFrame:
    """All violations of a candidate; it is valid if there are none. diagnostics: severity, code, message of the analysis, none of which may be an error."""
    rows = validate_fields(g).unionByName(validate_uniqueness(g)).unionByName(validate_references(g))
    if diagnostics is None:
        return rows
    return rows.unionByName(_diagnosed(diagnostics))


def _hashes(*columns: Column) -> list[Column]:
    """128 bits of the values of columns, as two 64-bit hashes a and b; equal values, nulls included, have equal ones."""
    marked = [x for c in columns for x in (c.isNull(), c)]  # a hash passes over nulls
    return [F.xxhash64(F.lit(salt), *marked).alias(name) for salt, name in ((1, "a"), (2, "b"))]


def _sieved(df: DataFrame, space: str, *keys: str, unique: bool = True, known: bool = True, asked: bool = False) -> DataFrame:
    return df.select(*_hashes(F.lit(space), *[F.col(k) for k in keys]), F.lit(int(unique)).alias("places"), F.lit(int(known)).alias("known"), F.lit(int(asked)).alias("asked"))


def may_break(g: Graph, diagnostics: DataFrame | None = None) -> bool:
    """Whether a rule of ``validate_analysis`` may be broken; false: none is.

    All keys and all references to them are counted by 128-bit hashes in one aggregate, and edges with their evidence in another, so
    that no record is joined as a whole. Equal keys have equal hashes, so none is overlooked that stands twice; a
    reference to nothing is overlooked only if its hash is that of a key.
    """
    none = {"unique": False, "known": False, "asked": True}
    owned = g.nodes.where("owned = 1")
    inside = g.dependencies.where(~F.coalesce(F.col("target_package"), F.lit("")).startswith("external:package:"))
    asks = lambda df, space, key, skip: _sieved(df.where(F.col(key) != "") if skip else df, space, key, **none)
    keys = reduce(DataFrame.unionByName, [
        *(_sieved(getattr(g, name), name, "key") for name in ("packages", "files", "symbols", "nodes")), _sieved(g.files, "paths", "path"), _sieved(g.blobs, "blobs", "sha"),
        _sieved(g.dependencies, "dependencies", "source_package", "target_package"), _sieved(g.tests, "tests", "test_key", "target_key"),
        _sieved(g.symbols, "testable", "key", unique=False), _sieved(g.nodes.where("kind = 'package'"), "testable", "key", unique=False),
        *(asks(df, "packages", key, skip) for df, key, skip in ((g.files, "package_key", True), (g.symbols, "package_key", False), (owned, "package_key", True), (g.edges, "owner_package", True), (g.dependencies, "source_package", False), (inside, "target_package", False))),
        *(asks(df, "files", "file_key", skip) for df, skip in ((g.symbols, False), (owned, True))), asks(owned, "symbols", "symbol_key", True), asks(g.tests, "symbols", "test_key", False),
        asks(g.files, "blobs", "blob_sha", True), asks(g.edges, "nodes", "source_key", False), asks(g.edges, "nodes", "target_key", False), asks(g.tests, "testable", "target_key", False),
    ])
    said = [validate_fields(g)] if diagnostics is None else [validate_fields(g), _diagnosed(diagnostics)]
    return any(not x.isEmpty() for x in (*said, _wrong(keys))) or evidence_may_break(g.edges, g.evidence)


def _wrong(sieved: DataFrame) -> DataFrame:
    return sieved.groupBy("a", "b").agg(F.sum("places").alias("places"), F.max("known").alias("known"), F.max("asked").alias("asked")).where("places > 1 or asked > known")


def evidence_may_break(edges: DataFrame, evidence: DataFrame) -> bool:
    """Whether an edge or an evidence may stand twice, or an evidence be of no edge; false: none does."""
    edge = ("source_key", "target_key", "kind")
    parts = [_sieved(edges, "edges", *edge), _sieved(evidence, "edges", *edge, unique=False, known=False, asked=True), _sieved(evidence, "evidence", *edge, "start_line", "end_line", "details")]
    return not _wrong(reduce(DataFrame.unionByName, parts).repartition("a", "b")).isEmpty()  # nearly all differ: dealt out before they are counted


def _rows(x: DataFrame, y: DataFrame) -> DataFrame:
    """The rows of both with side 1 and -1, by place as in exceptAll, and the bucket and the 128-bit hash of each."""
    names = [f"c{k}" for k in range(len(x.columns))]
    both = x.toDF(*names).withColumn("side", F.lit(1)).union(y.toDF(*names).withColumn("side", F.lit(-1)))
    return both.select("*", *_hashes(*[F.col(c) for c in names])).withColumn("bucket", F.pmod("a", F.lit(BUCKETS)))


def _unequal(rows: DataFrame) -> DataFrame:
    """Buckets whose rows differ: the number of rows or the sum of either half of a hash."""
    halves = [h for c in ("a", "b") for h in (F.col(c).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(c, 32))]
    sums = [F.sum(F.col("side") * h).alias(f"s{k}") for k, h in enumerate([F.lit(1), *halves])]
    return rows.groupBy("bucket").agg(*sums).where(" or ".join(f"s{k} <> 0" for k in range(len(sums)))).select("bucket")


def equal_analysis(a: Graph, b: Graph) -> DataFrame:
    """A row for each relation: rows of either side that the other lacks, as multisets. Equal graphs have zeros only.

    Both sides are first summed up by bucket, by the 128-bit hashes of their rows, without moving rows; the rows of buckets whose sums differ are compared themselves.
    """
    names = ("packages", "files", "symbols", "nodes", "edges", "evidence", "dependencies", "tests", "blobs")
    rows = {name: _rows(getattr(a, name), getattr(b, name)) for name in names}
    found = reduce(DataFrame.unionByName, [_unequal(r).select(F.lit(n).alias("relation"), "bucket") for n, r in rows.items()]).collect()
    buckets: dict[str, list[int]] = {}
    for r in found:
        buckets.setdefault(r["relation"], []).append(r["bucket"])
    spark, schema = a.spark, "relation string, only_left long, only_right long"
    out = [spark.createDataFrame([(n, 0, 0) for n in names if n not in buckets], schema)]
    for name, numbers in buckets.items():
        own = rows[name].where(F.col("bucket").isin(numbers))
        left = own.groupBy(*[c for c in own.columns if c not in ("side", "a", "b", "bucket")]).agg(F.sum("side").alias("left"))
        count = lambda side: F.coalesce(F.sum(F.greatest(F.lit(0), F.col("left") * side)), F.lit(0)).cast("long")
        out.append(left.agg(count(1).alias("only_left"), count(-1).alias("only_right")).select(F.lit(name).alias("relation"), "only_left", "only_right"))
    return reduce(DataFrame.unionByName, out)
