"""Lookups, search, neighbourhoods, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import integrity as I, lookup as L
from loomgraph.projection import whole
from loomgraph.queries import query

NAME, FILE, TERMS, CAP = "small_ring", "supplier/1.go", ["ring", "brand#1", "promo"], 32
_S = "key, kind, package_key, file_key, name, signature, receiver, path, start_line, end_line, exported"
KEYS = f"SELECT key AS node FROM g_symbols WHERE name = '{NAME}'"
KINDS = "('calls', 'possible_call', 'unresolved_call', 'implements', 'tests')"


def incident(keys: str) -> str:
    return f"""SELECT e.source_key AS node, e.source_key, e.target_key, e.kind, e.confidence FROM g_edges e JOIN {keys} k ON e.source_key = k.node WHERE e.kind IN {KINDS}
UNION SELECT e.target_key, e.source_key, e.target_key, e.kind, e.confidence FROM g_edges e JOIN {keys} k ON e.target_key = k.node WHERE e.kind IN {KINDS}"""


def refs(keys: str) -> str:
    return f"SELECT e.target_key AS node, e.source_key, e.target_key, e.kind, e.confidence FROM g_edges e JOIN {keys} k ON e.target_key = k.node WHERE e.kind = 'references'"


FIRST = """SELECT source_key, target_key, kind, evidence_id, start_line, end_line FROM (SELECT *, row_number() OVER (PARTITION BY source_key, target_key, kind ORDER BY evidence_id) AS n FROM g_evidence) WHERE n = 1"""


def labelled(rows: str) -> str:
    ends = "".join(f", coalesce(s{k}.path, p{k}.directory, '') AS {e}_path, coalesce(s{k}.package_key, p{k}.key, '') AS {e}_package" for k, e in enumerate(("source", "target")))
    joins = "".join(f" LEFT JOIN g_symbols s{k} ON s{k}.key = r.{e}_key LEFT JOIN g_packages p{k} ON concat('package:', p{k}.key) = r.{e}_key" for k, e in enumerate(("source", "target")))
    return f"SELECT r.*{ends} FROM {rows} r{joins}"


def capped(rows: str, order: str, n: int) -> str:
    return f"SELECT node, source_key, target_key, kind, confidence FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {order}) AS n_ FROM {rows}) WHERE n_ <= {n}"


def neighborhood(name: str, keys: str, limit: int) -> dict[str, str]:
    """Named texts that end in ``name``: the bounded neighbourhood of the nodes of ``keys``."""
    return {
        f"{name}_i": incident(keys), f"{name}_r": refs(keys), f"{name}_ic": capped(f"{name}_i", "kind, source_key, target_key", limit), f"{name}_rc": capped(f"{name}_r", "source_key", limit),
        f"{name}_b": f"SELECT r.*, e.start_line, e.end_line FROM (SELECT * FROM {name}_ic UNION SELECT * FROM {name}_rc) r LEFT JOIN first_ e ON r.source_key = e.source_key AND r.target_key = e.target_key AND r.kind = e.kind",
        name: f"SELECT *, row_number() OVER (PARTITION BY node ORDER BY kind, source_key, target_key, start_line NULLS FIRST, end_line NULLS FIRST) - 1 AS rel_idx FROM {name}_b",
    }


def _keys(g):
    return g.symbols.where(F.col("name") == NAME).select(F.col("key").alias("node"))


@query(f"SELECT {_S} FROM g_symbols WHERE key = '{NAME}' OR name = '{NAME}'")
def find_symbols(g, table):
    return L.find_symbols(g, NAME)


@query(f"""SELECT f.key, f.path, f.blob_sha, f.package_key, CASE WHEN f.package_key LIKE '%#%' THEN 1 ELSE 0 END AS is_test,
 coalesce((SELECT string_agg(s.key, ',' ORDER BY s.start_line, s.key) FROM g_symbols s WHERE s.file_key = f.key), '') AS symbols,
 coalesce((SELECT string_agg(DISTINCT coalesce(p.import_path, substr(d.target_package, 18)), ',' ORDER BY coalesce(p.import_path, substr(d.target_package, 18))) FROM g_dependencies d LEFT JOIN g_packages p ON p.key = d.target_package WHERE d.source_package = f.package_key), '') AS imports
FROM (SELECT * FROM g_files WHERE path = '{FILE}' OR key = '{FILE}' ORDER BY path LIMIT 1) f""")
def find_file(g, table):
    return L.find_file(g, FILE).withColumns({"symbols": F.array_join("symbols", ","), "imports": F.array_join("imports", ",")})


@query("SELECT d.source_package, d.target_package, coalesce(p.import_path, CASE WHEN d.target_package LIKE 'external:package:%' THEN substr(d.target_package, 18) ELSE d.target_package END) AS label FROM g_dependencies d LEFT JOIN g_packages p ON p.key = d.target_package WHERE d.source_package IN (SELECT package_key FROM g_files)")
def file_imports(g, table):
    return L.imports_of(g, g.files.select("package_key"))


_FIELDS = ("key", "name", "receiver", "signature", "s.package_key", "file_key", "path", "import_path")
_MATCHED = " + ".join("CASE WHEN " + " OR ".join(f"instr(lower({c if '.' in c else ('p.' if c == 'import_path' else 's.') + c}), '{t}') > 0" for c in _FIELDS) + " THEN 1 ELSE 0 END" for t in TERMS)


@query(f"SELECT * FROM (SELECT {', '.join('s.' + c for c in _S.split(', '))}, {_MATCHED} AS matched FROM g_symbols s LEFT JOIN g_packages p ON p.key = s.package_key) WHERE matched > 0 ORDER BY matched DESC, package_key, path, start_line, key LIMIT 256")
def search_symbols(g, table):
    return L.search_symbols(g, TERMS, 256)


@query("SELECT * FROM inc", keys=KEYS, inc=incident("keys"))
def incident_edges(g, table):
    return L.incident_edges(g, _keys(g))


@query("SELECT l.*, e.evidence_id, e.start_line, e.end_line FROM lab l LEFT JOIN g_evidence e ON l.source_key = e.source_key AND l.target_key = e.target_key AND l.kind = e.kind", keys=KEYS, inc=incident("keys"), lab=labelled("inc"))
def relationships_full(g, table):
    return L.relationships_full(g, _keys(g))


@query("SELECT l.*, e.evidence_id, e.start_line, e.end_line FROM lab l LEFT JOIN first_ e ON l.source_key = e.source_key AND l.target_key = e.target_key AND l.kind = e.kind", keys=KEYS, first_=FIRST, inc=incident("keys"), cap=capped("inc", "kind, source_key, target_key", CAP), lab=labelled("cap"))
def relationships_bounded(g, table):
    return L.relationships_bounded(g, _keys(g), CAP)


@query("SELECT l.*, e.evidence_id, e.start_line, e.end_line FROM ref l LEFT JOIN g_evidence e ON l.source_key = e.source_key AND l.target_key = e.target_key AND l.kind = e.kind", keys=KEYS, ref=refs("keys"))
def references_full(g, table):
    return L.references_full(g, _keys(g))


@query("SELECT l.*, e.evidence_id, e.start_line, e.end_line FROM cap l LEFT JOIN first_ e ON l.source_key = e.source_key AND l.target_key = e.target_key AND l.kind = e.kind", keys=KEYS, first_=FIRST, ref=refs("keys"), cap=capped("ref", "source_key", 3))
def references_bounded(g, table):
    return L.references_bounded(g, _keys(g), 3)


@query("SELECT node, source_key, target_key, kind, confidence, start_line, end_line, rel_idx FROM nb", keys=KEYS, first_=FIRST, **neighborhood("nb", "keys", CAP + 1))
def find_symbol_for_impact(g, table):
    return L.bounded_neighborhood(g, _keys(g), CAP + 1)


@query("""SELECT node, bucket, count(*) AS n, string_agg(DISTINCT other, ',' ORDER BY other) AS others FROM (SELECT node, CASE WHEN source_key = node THEN target_key ELSE source_key END AS other,
 CASE WHEN kind IN ('calls', 'possible_call', 'unresolved_call') THEN CASE WHEN source_key = node THEN 'callees' ELSE 'callers' END WHEN kind = 'implements' THEN CASE WHEN source_key = node THEN 'implements' ELSE 'implementers' END
      WHEN kind = 'tests' THEN CASE WHEN source_key = node THEN 'tested' ELSE 'tests' END ELSE 'references' END AS bucket FROM (SELECT * FROM inc UNION ALL SELECT * FROM ref)) GROUP BY node, bucket""", keys=KEYS, inc=incident("keys"), ref=refs("keys"))
def symbol_buckets(g, table):
    return L.symbol_buckets(g, _keys(g)).withColumn("others", F.array_join("others", ","))


@query("SELECT (SELECT count(*) FROM g_packages) AS packages, (SELECT count(*) FROM g_files) AS files, (SELECT count(*) FROM g_symbols) AS symbols, (SELECT count(*) FROM g_edges) AS edges, (SELECT count(*) FROM g_nodes WHERE kind = 'test') AS tests")
def generation_counts(g, table):
    return L.generation_counts(g)


BAD = {
    "edge_endpoints": "SELECT e.source_key, e.target_key, e.kind FROM g_edges e WHERE NOT EXISTS (SELECT 1 FROM g_nodes n WHERE n.key = e.source_key) OR NOT EXISTS (SELECT 1 FROM g_nodes n WHERE n.key = e.target_key)",
    "file_blobs": "SELECT f.key FROM g_files f WHERE NOT EXISTS (SELECT 1 FROM g_blobs b WHERE b.sha = f.blob_sha)",
    "symbol_ownership": "SELECT s.key FROM g_symbols s WHERE NOT EXISTS (SELECT 1 FROM g_packages p WHERE p.key = s.package_key) OR NOT EXISTS (SELECT 1 FROM g_files f WHERE f.key = s.file_key)",
    "node_ownership": "SELECT n.key FROM g_nodes n WHERE (n.package_key <> '' AND n.package_key NOT IN (SELECT key FROM g_packages)) OR (n.file_key <> '' AND n.file_key NOT IN (SELECT key FROM g_files)) OR (n.symbol_key <> '' AND n.symbol_key NOT IN (SELECT key FROM g_symbols))",
    "evidence": "SELECT v.source_key, v.target_key, v.kind FROM g_evidence v WHERE NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.source_key = v.source_key AND e.target_key = v.target_key AND e.kind = v.kind)",
    "package_dependencies": "SELECT DISTINCT d.source_package, d.target_package FROM g_dependencies d WHERE d.source_package NOT IN (SELECT key FROM g_packages) OR (d.target_package NOT LIKE 'external:%' AND d.target_package NOT IN (SELECT key FROM g_packages))",
    "test_relationships": "SELECT t.test_key, t.target_key FROM g_tests t WHERE t.test_key NOT IN (SELECT key FROM g_symbols) OR t.target_key NOT IN (SELECT key FROM g_symbols)",
    "duplicate_edges": "SELECT source_key, target_key, kind FROM g_edges GROUP BY source_key, target_key, kind HAVING count(*) > 1",
}


def _check(name: str):
    @query(f"SELECT '{name}' AS \"check\", CASE WHEN count(*) > 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS violations FROM ({BAD[name]})")
    def check(g, table):
        return I.doctor(g, (name,))

    return check


def _register_checks():
    from loomgraph import queries as Q

    for name in I.CHECKS:
        _check(name)
        Q.QUERIES[f"doctor_{name}"], Q.ORACLES[f"doctor_{name}"] = Q.QUERIES.pop("check"), Q.ORACLES.pop("check")


_register_checks()


@query("SELECT CASE WHEN count(*) FILTER (WHERE v > 0) > 0 THEN 'unhealthy' ELSE 'healthy' END AS health, count(*) FILTER (WHERE v > 0) AS errors, CAST(0 AS BIGINT) AS warnings, CAST(sum(v) AS BIGINT) AS violations FROM (" + " UNION ALL ".join(f"SELECT count(*) AS v FROM ({b})" for b in BAD.values()) + ")")
def doctor_summary(g, table):
    return I.summary(I.doctor(g))


@query("SELECT f.blob_sha, count(*) AS files FROM g_files f LEFT JOIN g_blobs b ON b.sha = f.blob_sha WHERE b.sha IS NULL GROUP BY f.blob_sha")
def doctor_missing_blobs(g, table):
    return I.file_blobs(g).groupBy("blob_sha").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT count(*) AS entries, CAST(count(*) FILTER (WHERE NOT json_valid(syntax_json)) AS BIGINT) AS invalid FROM x_cache")
def doctor_parse_cache(g, table):
    return table("x_cache").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.try_parse_json("syntax_json").isNull()).alias("invalid"))


@query("""SELECT s.worktree_id, CASE WHEN s.active_generation IS NULL THEN 'unindexed' WHEN g.generation_id IS NULL THEN 'missing' WHEN g.state <> 'active' THEN 'not active' WHEN g.commit_sha <> s.indexed_head THEN 'other commit'
 WHEN g.schema_version <> 2 THEN 'old schema' ELSE 'ok' END AS provenance FROM x_states s LEFT JOIN x_generations g ON s.repo_id = g.repo_id AND s.worktree_id = g.worktree_id AND s.active_generation = g.generation_id""")
def doctor_provenance(g, table):
    own = table("x_generations").select("repo_id", "worktree_id", F.col("generation_id").alias("active_generation"), "state", "commit_sha", "schema_version", F.lit(1).alias("had"))
    said = F.when(F.col("active_generation").isNull(), "unindexed").when(F.col("had").isNull(), "missing").when(F.col("state") != "active", "not active").when(F.col("commit_sha") != F.col("indexed_head"), "other commit").when(F.col("schema_version") != 2, "old schema").otherwise("ok")
    return table("x_states").join(own, ["repo_id", "worktree_id", "active_generation"], "left").select("worktree_id", said.alias("provenance"))


def _link(rule: str, t: str, what: str, key: str, known: str, cond: str = "true", column: str = "key") -> str:
    return f"SELECT '{rule}' AS rule, {what} AS subject FROM {t} WHERE {cond} AND NOT EXISTS (SELECT 1 FROM {known} k WHERE k.{column} = {t}.{key})"


_E, _D, _T = ("concat(source_key, '|', target_key, '|', kind)", "concat(source_package, '|', target_package)", "concat(test_key, '|', target_key)")
_REFS = " UNION ALL ".join([
    _link("file-package", "g_files", "key", "package_key", "g_packages", "package_key <> ''"), _link("file-blob", "g_files", "key", "blob_sha", "g_blobs", "blob_sha <> ''", "sha"),
    _link("symbol-package", "g_symbols", "key", "package_key", "g_packages"), _link("symbol-file", "g_symbols", "key", "file_key", "g_files"),
    _link("node-package", "g_nodes", "key", "package_key", "g_packages", "owned = 1 AND package_key <> ''"), _link("node-file", "g_nodes", "key", "file_key", "g_files", "owned = 1 AND file_key <> ''"),
    _link("node-symbol", "g_nodes", "key", "symbol_key", "g_symbols", "owned = 1 AND symbol_key <> ''"), _link("edge-source", "g_edges", _E, "source_key", "g_nodes"), _link("edge-target", "g_edges", _E, "target_key", "g_nodes"),
    _link("edge-owner", "g_edges", _E, "owner_package", "g_packages", "owner_package <> ''"), _link("dependency-source", "g_dependencies", _D, "source_package", "g_packages"),
    _link("dependency-target", "g_dependencies", _D, "target_package", "g_packages", "target_package NOT LIKE 'external:package:%'"), _link("test-symbol", "g_tests", _T, "test_key", "g_symbols"),
    _link("test-target", "g_tests", _T, "target_key", "(SELECT key FROM g_symbols UNION ALL SELECT key FROM g_nodes WHERE kind = 'package')"),
    f"SELECT 'evidence-edge' AS rule, {_E} AS subject FROM ({BAD['evidence']})",
])
_UNIQUE = " UNION ALL ".join(f"SELECT '{rule}' AS rule, {what} AS subject FROM {t} GROUP BY {by} HAVING count(*) > 1" for rule, t, by, what in (
    ("package-key", "g_packages", "key", "key"), ("file-key", "g_files", "key", "key"), ("file-path", "g_files", "path", "path"), ("symbol-key", "g_symbols", "key", "key"), ("node-key", "g_nodes", "key", "key"),
    ("edge", "g_edges", "source_key, target_key, kind", _E), ("dependency", "g_dependencies", "source_package, target_package", _D), ("test", "g_tests", "test_key, target_key", _T), ("blob", "g_blobs", "sha", "sha"),
    ("evidence", "g_evidence", "source_key, target_key, kind, start_line, end_line, details", "concat_ws('|', source_key, target_key, kind, start_line, end_line, details)")))
_OUT = "(coalesce({0}, '') LIKE '/%' OR {0} = '..' OR {0} LIKE '../%')"
_FIELD = " UNION ALL ".join(f"SELECT '{rule}' AS rule, {what} AS subject FROM {t} WHERE {cond}" for rule, t, what, cond in (
    ("package-key-empty", "g_packages", "key", "coalesce(key, '') = ''"), ("package-directory", "g_packages", "key", _OUT.format("directory")), ("blob-empty", "g_blobs", "sha", "coalesce(sha, '') = ''"), ("blob-size", "g_blobs", "sha", "byte_size < 0"),
    ("file-empty", "g_files", "key", "coalesce(key, '') = '' OR coalesce(path, '') = ''"), ("file-escapes", "g_files", "key", _OUT.format("path")),
    ("symbol-empty", "g_symbols", "key", "coalesce(key, '') = '' OR coalesce(package_key, '') = '' OR coalesce(file_key, '') = ''"), ("symbol-lines", "g_symbols", "key", "start_line < 0 OR end_line < 0"),
    ("node-empty", "g_nodes", "key", "coalesce(key, '') = ''"), ("node-kind", "g_nodes", "key", "coalesce(kind, '') = ''"), ("node-lines", "g_nodes", "key", "source_start < 0 OR source_end < 0"),
    ("edge-empty", "g_edges", _E, "coalesce(source_key, '') = '' OR coalesce(target_key, '') = '' OR coalesce(kind, '') = ''"), ("edge-confidence", "g_edges", _E, "confidence NOT IN ('', 'exact', 'inferred', 'possible')"),
    ("evidence-empty", "g_evidence", _E, "coalesce(source_key, '') = '' OR coalesce(target_key, '') = '' OR coalesce(kind, '') = ''"), ("evidence-lines", "g_evidence", _E, "start_line < 0 OR end_line < 0"),
    ("dependency-empty", "g_dependencies", _D, "coalesce(source_package, '') = '' OR coalesce(target_package, '') = ''"), ("test-empty", "g_tests", _T, "coalesce(test_key, '') = '' OR coalesce(target_key, '') = ''"),
    ("test-confidence", "g_tests", _T, "confidence NOT IN ('', 'exact', 'inferred', 'possible')")))


@query(_REFS)
def validate_references(g, table):
    return I.validate_references(g)


@query(_UNIQUE)
def validate_uniqueness(g, table):
    return I.validate_uniqueness(g)


@query(f"SELECT rule, count(*) AS violations FROM ({_FIELD} UNION ALL {_UNIQUE} UNION ALL {_REFS}) GROUP BY rule")
def validate_analysis(g, table):
    return I.validate_analysis(g).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS relation, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right" for n in ("packages", "files", "symbols", "nodes", "edges", "evidence", "dependencies", "tests", "blobs")))
def equal_analysis(g, table):
    """A graph against itself, dealt out anew."""
    import dataclasses

    g = whole(g)
    other = dataclasses.replace(g, **{f.name: getattr(g, f.name).coalesce(max(3, g.spark.sparkContext.defaultParallelism - 1)) for f in dataclasses.fields(g)})
    return I.equal_analysis(g, other)


@query("SELECT source_key, target_key, kind, CASE WHEN confidence = '' THEN 'exact' ELSE confidence END AS confidence FROM g_edges WHERE source_key IN (SELECT key FROM g_nodes) AND target_key IN (SELECT key FROM g_nodes)")
def write_edges_resolved(g, table):
    from loomgraph.operators.build import resolve_edges

    return resolve_edges(g.nodes, g.edges).drop("source_id", "target_id")
