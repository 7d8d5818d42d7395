"""Merged projections of nodes and edges, as rows, DOT and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Strength of confidences; the weakest of a merged edge stands.
RANKS = {"exact": 3, "inferred": 2, "possible": 1}


def confidence_rank(c: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANKS.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def kind_of_key(key: Column) -> Column:
    """What a key's prefix says of its kind; '' if nothing. Repositories are told by ``repo:``."""
    return (
        F.when(key.startswith("package:") | key.startswith("external:package:"), "package").when(key.startswith("file:"), "file").when(key.startswith("repo:"), "repository")
        .when(key.startswith("symbol:") | key.startswith("external:symbol:") | key.startswith("unresolved:"), "symbol").otherwise("")
    )


def merged_nodes(rows: DataFrame) -> DataFrame:
    """rows: id, kind, name, path, package, start_line, external, seed (0/1). One row for each id: a specific kind before ``symbol``, else the least; least non-empty texts; any flag."""
    some = lambda c: F.coalesce(F.min(F.nullif(F.col(c), F.lit(""))), F.lit(""))
    specific = F.min(F.when((F.col("kind") != "") & (F.col("kind") != "symbol"), F.col("kind")))
    return rows.groupBy("id").agg(
        F.coalesce(specific, F.max(F.nullif(F.col("kind"), F.lit(""))), F.max(kind_of_key(F.col("id")))).alias("kind"), some("name").alias("name"), some("path").alias("path"), some("package").alias("package"),
        F.coalesce(F.min(F.when(F.col("start_line") > 0, F.col("start_line"))), F.lit(0)).cast("long").alias("start_line"), F.max("external").alias("external"), F.max("seed").alias("seed"),
    )


def merged_edges(rows: DataFrame) -> DataFrame:
    """rows: source, target, kind, historical, confidence, path, start_line, details. One row for each edge: the weakest confidence, its places and details sorted, each once."""
    place = F.when(F.col("start_line") > 0, F.concat(F.col("path"), F.lit(":"), F.lpad(F.col("start_line").cast("string"), 8, "0")))
    return rows.groupBy("source", "target", "kind", "historical").agg(
        F.min_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"), F.array_join(F.array_sort(F.collect_set(place)), ",").alias("locations"),
        F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("details"), F.lit("")))), ",").alias("details"),
    )


def quoted(text: Column) -> Column:
    """A DOT string: backslashes, quotes and line ends are escaped."""
    out = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def dot_nodes(nodes: DataFrame) -> DataFrame:
    """id and its DOT statement."""
    label = F.concat_ws("\n", F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("("), "kind", F.lit(")")), F.nullif(F.col("path"), F.lit("")))
    style = F.when(F.col("external") == 1, ", style=dashed").when(F.col("seed") == 1, ", penwidth=2").otherwise("")
    return nodes.select("id", F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [label="), quoted(label), style, F.lit("];")).alias("line"))


def dot_edges(edges: DataFrame) -> DataFrame:
    """source, target, kind, historical and the edge's DOT statement."""
    style = F.when(F.col("historical") == 1, "dotted").when(F.col("confidence") == "exact", "solid").otherwise("dashed")
    line = F.concat(F.lit("  "), quoted(F.col("source")), F.lit(" -> "), quoted(F.col("target")), F.lit(" [label="), quoted(F.col("kind")), F.lit(", style="), style, F.lit("];"))
    return edges.select("source", "target", "kind", "historical", line.alias("line"))


def json_nodes(nodes: DataFrame) -> DataFrame:
    """id and its JSON object, fields in a fixed order, empty ones included."""
    return nodes.select("id", F.to_json(F.struct("id", "kind", "name", "path", "package", "start_line"), {"ignoreNullFields": "false"}).alias("json"))


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A directory of text files: nodes by id, then edges by source, target, kind, current before historical."""
    lines = dot_nodes(nodes).select(F.lit(1).alias("part"), F.array("id").alias("place"), "line").unionByName(
        dot_edges(edges).select(F.lit(2).alias("part"), F.array("source", "target", "kind", F.col("historical").cast("string")).alias("place"), "line")
    )
    ends = nodes.sparkSession.createDataFrame([(0, [], "digraph graph_export {"), (3, [], "}")], "part int, place array<string>, line string")
    lines.unionByName(ends).orderBy("part", "place").select("line").write.text(path)
