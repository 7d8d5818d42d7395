"""From extracted facts to relations: ownership, containment, references, calls, implementations, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions.text import fingerprint


def first_of(rows: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The first row of each identity: what a later extraction step repeats is dropped."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*identity).orderBy(order))).where("_n = 1").drop("_n")


def init_ordinals(symbols: DataFrame) -> DataFrame:
    """Numbers the symbols of one package and name, from 0, by file and line."""
    order = Window.partitionBy("package_key", "name").orderBy("file_key", "start_line", "key")
    return symbols.select("package_key", "name", "key", (F.row_number().over(order) - 1).cast("long").alias("ordinal"))


def owner_at(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """points: file_key, pos. spans: file_key, first, last, symbol_key, ord. Adds the narrowest span's owner, the first listed of equal ones.

    A span stands in each block of ``width`` places that it touches, so the join is on file and block, and only
    neighbours are compared. A point that no span holds has a null owner.
    """
    blocks = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    asked = points.select("file_key", "pos").distinct().withColumn("block", F.floor(F.col("pos") / width))
    inside = asked.join(blocks, ["file_key", "block"]).where("pos >= first and pos <= last")
    best = inside.groupBy("file_key", "pos").agg(F.min_by("symbol_key", F.struct(F.col("last") - F.col("first"), "ord")).alias("owner"))
    return points.join(best, ["file_key", "pos"], "left")


def implements_division(methods: DataFrame, required: DataFrame) -> DataFrame:
    """methods: type_key, method; required: interface_key, method. Pairs whose type has all of the interface's methods: by count, no cross product."""
    need = required.distinct().groupBy("interface_key").agg(F.count(F.lit(1)).alias("need"))
    shared = methods.select("type_key", "method").distinct().join(required.distinct(), "method").groupBy("type_key", "interface_key").agg(F.count(F.lit(1)).alias("has"))
    return shared.join(need, "interface_key").where("has = need and type_key <> interface_key").select("type_key", "interface_key")


def dispatch(calls: DataFrame, implementers: DataFrame) -> DataFrame:
    """calls: source_key, target_key. Calls of an interface may reach each implementer but the caller itself."""
    possible = calls.join(implementers.select(F.col("interface_key").alias("target_key"), "type_key"), "target_key").where("type_key <> source_key")
    return possible.select("source_key", F.col("type_key").alias("target_key"), F.lit("possible_call").alias("kind"), F.lit("possible").alias("confidence")).distinct()


def resolve(uses: DataFrame, objects: DataFrame) -> DataFrame:
    """uses: id, object, canonical, loose. objects: form, name, symbol_key. The symbol by the first form that is known, with that form."""
    for form in ("object", "canonical", "loose"):
        known = objects.where(F.col("form") == form).select(F.col("name").alias(form), F.col("symbol_key").alias(f"by_{form}"))
        uses = uses.join(known, form, "left")
    rule = F.when(F.col("by_object").isNotNull(), "object").when(F.col("by_canonical").isNotNull(), "canonical").when(F.col("by_loose").isNotNull(), "loose").otherwise("none")
    return uses.select("id", F.coalesce("by_object", "by_canonical", "by_loose", F.lit("")).alias("symbol_key"), rule.alias("form"))


def contains(files: DataFrame) -> DataFrame:
    return files.select(F.concat(F.lit("package:"), "package_key").alias("source_key"), F.col("key").alias("target_key"), F.lit("contains").alias("kind"))


def defines(symbols: DataFrame) -> DataFrame:
    """Each symbol by one file: of several, production before tests, then by path."""
    test = F.endswith("path", F.lit("_test.go")).cast("int")
    best = symbols.groupBy("key").agg(F.min_by("file_key", F.struct(test, "path")).alias("source_key"))
    return best.select("source_key", F.col("key").alias("target_key"), F.lit("defines").alias("kind"))


def references(uses: DataFrame, spans: DataFrame, symbols: DataFrame) -> DataFrame:
    """uses: file_key, pos, target. Edges from the narrowest owner, or else the file, to the symbol or else its external stand-in; each once, with its number of places."""
    owned = owner_at(uses, spans)
    known = symbols.select(F.col("key").alias("target"), F.lit(1).alias("known"))
    joined = owned.join(known, "target", "left")
    target = F.when(F.col("known") == 1, F.col("target")).otherwise(F.concat(F.lit("external:symbol:"), "target"))
    return joined.select(F.coalesce("owner", "file_key").alias("source_key"), target.alias("target_key")).groupBy("source_key", "target_key").agg(F.count(F.lit(1)).alias("places"))


def imports(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """dependencies: source_package, import_path. Edges to the known package or an external stand-in."""
    known = packages.select("import_path", F.col("key").alias("found"))
    target = F.coalesce(F.concat(F.lit("package:"), "found"), F.concat(F.lit("external:package:"), "import_path"))
    return dependencies.join(known, "import_path", "left").select(F.concat(F.lit("package:"), "source_package").alias("source_key"), target.alias("target_key"), F.lit("imports").alias("kind")).distinct()


def call_kind(callee: Column) -> Column:
    """calls for functions and methods that are known, unresolved_call for unknown ones; null for what is no call."""
    return F.when(callee.isin("function", "method"), "calls").when(callee.isin("unknown", "variable"), "unresolved_call")


def calls(sites: DataFrame) -> DataFrame:
    """sites: source_key, target_key, callee, mode ('', 'go', 'defer'). Call edges with their numbers of places and modes."""
    kind = call_kind(F.col("callee"))
    confidence = F.when(F.col("kind") == "calls", "exact").otherwise("possible")
    rows = sites.withColumn("kind", kind).where("kind is not null")
    return rows.groupBy("source_key", "target_key", "kind").agg(F.count(F.lit(1)).alias("places"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("mode") != "", F.col("mode")))), ",").alias("modes")).withColumn("confidence", confidence)


def test_links(tests: DataFrame, production: DataFrame, direct: DataFrame) -> DataFrame:
    """tests: key, name, package_key. By a direct edge exactly; else by name (Test, Benchmark or Example, up to the first _); else to the package.

    production: key, name, package_key, ord; of one name the last written. direct: source_key, target_key.
    """
    stem = F.regexp_extract("name", r"^(?:Test|Benchmark|Example)([^_]+)", 1)
    exact = tests.select(F.col("key").alias("source_key")).join(direct, "source_key").select(F.col("source_key").alias("test_key"), "target_key", F.lit("exact").alias("confidence")).distinct()
    rest = tests.join(exact.select(F.col("test_key").alias("key")), "key", "left_anti").withColumn("stem", stem)
    named = production.groupBy("package_key", F.lower("name").alias("stem")).agg(F.max_by("key", "ord").alias("target_key"))
    inferred = rest.where("stem <> ''").withColumn("stem", F.lower("stem")).join(named, ["package_key", "stem"]).select(F.col("key").alias("test_key"), "target_key", F.lit("inferred").alias("confidence"))
    left = rest.join(inferred.select(F.col("test_key").alias("key")), "key", "left_anti").where("stem <> ''")
    fallback = left.select(F.col("key").alias("test_key"), F.concat(F.lit("package:"), "package_key").alias("target_key"), F.lit("possible").alias("confidence"))
    return exact.unionByName(inferred).unionByName(fallback)


def package_variant(path: Column, name: Column) -> Column:
    """'' for production, test for files beside it that are tests, external for test packages of their own, main for generated mains."""
    return F.when(F.endswith(name, F.lit("_test")), "external").when(F.endswith(path, F.lit(".test")), "main").when(F.endswith(path, F.lit("_test.go")), "test").otherwise("")


def build_fingerprint(manifest: DataFrame, selection: list[str], group: str) -> DataFrame:
    """manifest: group, path, blob_sha, mode, size. One digest for each group: the selection first, then files by path."""
    line = F.struct("path", "blob_sha", "mode", F.col("size").cast("string").alias("size"))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(line)), lambda f: F.array(f["path"], f["blob_sha"], f["mode"], f["size"])))
    return manifest.groupBy(group).agg(parts.alias("parts")).select(group, fingerprint(F.concat(F.array(*map(F.lit, selection)), F.col("parts"))).alias("fingerprint"))


def manifest_hash(entries: DataFrame, group: str) -> DataFrame:
    """entries: group, path, present, sha. One digest over the ordered fields of each group's entries."""
    line = F.concat_ws("|", "path", F.col("present").cast("string"), "sha")
    return entries.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("manifest"))


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges as they are stored: ends as numbers, empty confidence as exact; edges without both ends are left out.

    A node's number is its 64-bit hash, so no global order has to be made; ``equal`` hashes are told apart by validate_uniqueness.
    """
    ids = nodes.select("key", F.xxhash64("key").alias("id"))
    source, target = ids.toDF("source_key", "source_id"), ids.toDF("target_key", "target_id")
    joined = edges.join(source, "source_key").join(target, "target_key")
    return joined.select("source_key", "target_key", "source_id", "target_id", "kind", F.when(F.col("confidence") == "", "exact").otherwise(F.col("confidence")).alias("confidence"))


def normalized(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The canonical order of a relation: sorted in full by its keys."""
    return rows.orderBy(*keys)
