"""Overlay, construction, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import build as B, export as X, overlay as O
from loomgraph.queries import query

_S = "key, kind, package_key, file_key, name, signature, receiver, path, start_line, end_line, exported"
ENTRIES = {"entries": """SELECT new_path AS path, CAST(1 AS BIGINT) AS present, sha FROM m_status WHERE new_path <> '' AND kind <> 'deleted' AND (tracked = 1 OR new_path LIKE '%.go')
UNION ALL SELECT old_path, CAST(0 AS BIGINT), '' FROM m_status WHERE old_path <> '' AND kind IN ('deleted', 'renamed')"""}
EFFECTIVE = {"eff": f"""SELECT {_S}, 'base' AS origin FROM g_symbols WHERE key NOT IN (SELECT key FROM x_changed) AND path NOT IN (SELECT path FROM x_touched)
UNION ALL SELECT {_S}, 'overlay' FROM x_local UNION ALL SELECT {_S}, 'historical' FROM g_symbols WHERE key IN (SELECT key FROM x_changed) AND key NOT IN (SELECT key FROM x_local)"""}
MASKED = {"masked": "SELECT * FROM g_edges WHERE source_key NOT IN (SELECT key FROM x_changed) AND target_key NOT IN (SELECT key FROM x_changed)"}


def _effective(g, table):
    return O.symbols(g.symbols, table("x_local"), table("x_changed"), table("x_touched"))


@query("SELECT * FROM entries", **ENTRIES)
def overlay_manifest(g, table):
    return O.manifest(table("m_status"))


@query("SELECT path, blob_sha, 'base' AS origin FROM m_files WHERE path NOT IN (SELECT path FROM entries) UNION ALL SELECT path, concat('overlay:sha256:', sha), 'overlay' FROM entries WHERE present = 1", **ENTRIES)
def overlay_files(g, table):
    return O.files(table("m_files"), O.manifest(table("m_status")))


@query("SELECT * FROM eff", **EFFECTIVE)
def overlay_symbols(g, table):
    return _effective(g, table)


@query("SELECT * FROM masked", **MASKED)
def overlay_masked_edges(g, table):
    return O.masked_edges(g.edges, table("x_changed"))


_FIND = "small_ring"


@query(f"""SELECT {_S}, origin FROM (SELECT *, min(rule) OVER () AS best FROM (SELECT *, CASE WHEN origin = 'overlay' AND key = '{_FIND}' THEN 1 WHEN origin = 'historical' AND key = '{_FIND}' THEN 2 WHEN origin <> 'base' AND name = '{_FIND}' THEN 3
 WHEN origin = 'base' AND (key = '{_FIND}' OR name = '{_FIND}') THEN 4 END AS rule FROM eff) WHERE rule IS NOT NULL) WHERE rule = best""", **EFFECTIVE)
def overlay_find(g, table):
    return O.find(_effective(g, table), _FIND)


_HAS = " + ".join(f"CASE WHEN instr(lower(concat(key, ' ', name, ' ', receiver, ' ', signature, ' ', package_key, ' ', file_key, ' ', path)), '{t}') > 0 THEN 1 ELSE 0 END" for t in ("local", "ring", "promo"))


@query(f"SELECT * FROM (SELECT {_S}, origin, {_HAS} AS matched FROM eff WHERE origin <> 'historical') WHERE matched > 0 ORDER BY matched DESC, package_key, path, start_line, key LIMIT 200", **EFFECTIVE)
def overlay_search(g, table):
    return O.search(_effective(g, table), ["local", "ring", "promo"], 200)


_LIST = "CASE WHEN kind IN ('calls', 'possible_call', 'unresolved_call') THEN CASE WHEN source_key = key THEN 'calls' ELSE 'called_by' END WHEN kind = 'implements' THEN CASE WHEN source_key = key THEN 'implementations' ELSE 'implemented_by' END WHEN kind = 'tests' THEN 'tests' WHEN kind = 'references' AND target_key = key THEN 'refs' END"
RESULTS = {
    "ends": "SELECT DISTINCT source_key, target_key, kind, source_key AS key FROM masked UNION SELECT source_key, target_key, kind, target_key FROM masked",
    "listed": f"SELECT *, {_LIST} AS list_ FROM ends",
    "ranked": "SELECT *, CASE WHEN source_key = key THEN target_key ELSE source_key END AS other, row_number() OVER (PARTITION BY key, list_ ORDER BY kind, source_key, target_key) AS n_ FROM listed WHERE list_ IS NOT NULL",
}


@query("SELECT eff.key, origin, " + ", ".join(f"coalesce(string_agg(other, ',' ORDER BY n_) FILTER (WHERE list_ = '{n}'), '') AS {n}" for n in O.LISTS) + " FROM eff JOIN ranked r ON r.key = eff.key WHERE n_ <= 3 GROUP BY eff.key, origin", **EFFECTIVE, **MASKED, **RESULTS)
def overlay_symbol_results(g, table):
    found = O.symbol_results(_effective(g, table), O.masked_edges(g.edges, table("x_changed")), 3)
    return found.withColumns({n: F.array_join(n, ",") for n in O.LISTS})


@query("SELECT key, kind, path FROM (SELECT key, kind, path, row_number() OVER (PARTITION BY key ORDER BY ord) AS n FROM (SELECT key, kind, path, 1 AS ord FROM g_symbols UNION ALL SELECT key, 'symbol', '', 2 FROM g_symbols WHERE key LIKE '%2' UNION ALL SELECT target_key, 'symbol', '', 3 FROM g_edges)) WHERE n = 1")
def dedupe_nodes(g, table):
    rows = g.symbols.select("key", "kind", "path", F.lit(1).alias("ord")).unionByName(g.symbols.where("key like '%2'").select("key", F.lit("symbol").alias("kind"), F.lit("").alias("path"), F.lit(2).alias("ord")))
    rows = rows.unionByName(g.edges.select(F.col("target_key").alias("key"), F.lit("symbol").alias("kind"), F.lit("").alias("path"), F.lit(3).alias("ord")))
    return B.first_of(rows, ["key"], "ord").drop("ord")


@query("SELECT package_key, name, key, row_number() OVER (PARTITION BY package_key, name ORDER BY file_key, start_line, key) - 1 AS ordinal FROM g_symbols")
def init_ordinals(g, table):
    return B.init_ordinals(g.symbols)


OWN = {"own": "SELECT id, file_key, pos, symbol_key AS owner FROM (SELECT p.*, s.symbol_key, row_number() OVER (PARTITION BY p.id ORDER BY s.last - s.first, s.ord) AS n FROM x_points p LEFT JOIN x_spans s ON s.file_key = p.file_key AND p.pos BETWEEN s.first AND s.last) WHERE n = 1"}


@query("SELECT * FROM own", **OWN)
def owner_at_interval(g, table):
    return B.owner_at(table("x_points"), table("x_spans"))


IMPL = {"impl": "SELECT m.type_key, r.interface_key FROM x_methods m JOIN x_required r ON r.method = m.method GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM x_required q WHERE q.interface_key = r.interface_key)"}


@query("SELECT * FROM impl", **IMPL)
def implements_division(g, table):
    return B.implements_division(table("x_methods"), table("x_required"))


@query("SELECT DISTINCT e.source_key, i.source_key AS target_key, 'possible_call' AS kind, 'possible' AS confidence FROM g_edges e JOIN g_edges i ON i.kind = 'implements' AND i.target_key = e.target_key WHERE e.kind = 'calls' AND i.source_key <> e.source_key")
def dispatch_possible_calls(g, table):
    implementers = g.edges.where("kind = 'implements'").select(F.col("source_key").alias("type_key"), F.col("target_key").alias("interface_key"))
    return B.dispatch(g.edges.where("kind = 'calls'").select("source_key", "target_key"), implementers)


@query("SELECT u.id, coalesce(a.symbol_key, b.symbol_key, c.symbol_key, '') AS symbol_key, CASE WHEN a.symbol_key IS NOT NULL THEN 'object' WHEN b.symbol_key IS NOT NULL THEN 'canonical' WHEN c.symbol_key IS NOT NULL THEN 'loose' ELSE 'none' END AS form FROM x_uses u LEFT JOIN x_objects a ON a.form = 'object' AND a.name = u.object LEFT JOIN x_objects b ON b.form = 'canonical' AND b.name = u.canonical LEFT JOIN x_objects c ON c.form = 'loose' AND c.name = u.loose")
def resolve_objects(g, table):
    return B.resolve(table("x_uses"), table("x_objects"))


@query("SELECT concat('package:', package_key) AS source_key, key AS target_key, 'contains' AS kind FROM g_files")
def build_contains(g, table):
    return B.contains(g.files)


@query("SELECT source_key, key AS target_key, 'defines' AS kind FROM (SELECT key, file_key AS source_key, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN path LIKE '%_test.go' THEN 1 ELSE 0 END, path) AS n FROM (SELECT key, file_key, path FROM g_symbols UNION ALL SELECT s.key, f.key, f.path FROM g_symbols s JOIN m_files f ON f.id = 3 AND f.key LIKE 'file:customer/%')) WHERE n = 1")
def build_defines(g, table):
    other = table("m_files").where("id = 3 and key like 'file:customer/%'").select(F.col("key").alias("file_key"), "path")
    both = g.symbols.select("key", "file_key", "path").unionByName(g.symbols.select("key").crossJoin(F.broadcast(other.limit(1))).select("key", "file_key", "path"))  # one row
    return B.defines(both)


@query("SELECT coalesce(o.owner, o.file_key) AS source_key, CASE WHEN s.key IS NOT NULL THEN t ELSE concat('external:symbol:', t) END AS target_key, count(*) AS places FROM (SELECT owner, file_key, concat('symbol:part/', CAST(pos * 3 AS STRING)) AS t FROM own) o LEFT JOIN g_symbols s ON s.key = o.t GROUP BY 1, 2", **OWN)
def build_references(g, table):
    uses = table("x_points").withColumn("target", F.concat(F.lit("symbol:part/"), (F.col("pos") * 3).cast("string")))
    return B.references(uses, table("x_spans"), g.symbols)


@query("SELECT DISTINCT concat('package:', a.key) AS source_key, CASE WHEN b.key IS NOT NULL THEN concat('package:', b.key) ELSE concat('external:package:', i) END AS target_key, 'imports' AS kind FROM (SELECT key, CASE WHEN nk % 3 = 0 THEN concat('lib/', name) WHEN nk % 3 = 1 THEN 'AFRICA/NATION_0' ELSE import_path END AS i FROM g_packages) a LEFT JOIN g_packages b ON b.import_path = a.i")
def build_imports(g, table):
    target = F.when(F.col("nk") % 3 == 0, F.concat(F.lit("lib/"), "name")).when(F.col("nk") % 3 == 1, "AFRICA/NATION_0").otherwise(F.col("import_path"))
    return B.imports(g.packages.select(F.col("key").alias("source_package"), target.alias("import_path")), g.packages)


@query("SELECT source_key, target_key, kind, count(*) AS places, coalesce(string_agg(DISTINCT nullif(mode, ''), ',' ORDER BY nullif(mode, '')), '') AS modes, CASE WHEN kind = 'calls' THEN 'exact' ELSE 'possible' END AS confidence FROM (SELECT *, CASE WHEN callee IN ('function', 'method') THEN 'calls' WHEN callee IN ('unknown', 'variable') THEN 'unresolved_call' END AS kind FROM x_sites) WHERE kind IS NOT NULL GROUP BY source_key, target_key, kind")
def build_calls(g, table):
    return B.calls(table("x_sites"))


@query("""SELECT * FROM ex UNION ALL SELECT * FROM nm UNION ALL SELECT key, concat('package:', package_key), 'possible' FROM x_tests WHERE key NOT IN (SELECT test_key FROM ex) AND key NOT IN (SELECT test_key FROM nm)""",
       ex="SELECT DISTINCT t.key AS test_key, e.target_key, 'exact' AS confidence FROM x_tests t JOIN g_edges e ON e.source_key = t.key AND e.kind = 'calls' OR e.source_key = t.key AND e.kind = 'references' AND t.key LIKE '%5'",
       nm="SELECT t.key AS test_key, p.key AS target_key, 'inferred' AS confidence FROM x_tests t JOIN (SELECT package_key, lower(name) AS stem, arg_max(key, ord) AS key FROM x_production GROUP BY 1, 2) p ON p.package_key = t.package_key AND p.stem = lower(regexp_extract(t.name, '^(?:Test|Benchmark|Example)([^_]+)', 1)) WHERE t.key NOT IN (SELECT test_key FROM ex)")
def test_links(g, table):
    direct = g.edges.where("kind = 'calls' or (kind = 'references' and source_key like '%5')").select("source_key", "target_key")
    return B.test_links(table("x_tests"), table("x_production"), direct)


test_links.__test__ = False


@query("SELECT package_key, sha256(concat('sel', chr(0), 'v1', chr(0), string_agg(concat(path, chr(0), blob_sha, chr(0), '100644', chr(0), CAST(length(path) AS STRING), chr(0)), '' ORDER BY path))) AS fingerprint FROM m_files GROUP BY package_key")
def build_fingerprint(g, table):
    return B.build_fingerprint(table("m_files").select("package_key", "path", "blob_sha", F.lit("100644").alias("mode"), F.length("path").cast("long").alias("size")), ["sel", "v1"], "package_key")


@query("SELECT package_key, sha256(string_agg(concat(path, '|', CASE WHEN id % 2 = 0 THEN '1' ELSE '0' END, '|', blob_sha), chr(10) ORDER BY path)) AS manifest FROM m_files GROUP BY package_key")
def manifest_hash(g, table):
    return B.manifest_hash(table("m_files").select("package_key", "path", (F.col("id") % 2 == 0).cast("int").alias("present"), F.col("blob_sha").alias("sha")), "package_key")


@query("SELECT 'edge' AS relation, concat(source_key, '|', target_key, '|', kind) AS line FROM g_edges UNION ALL SELECT 'node', key FROM g_nodes")
def normalize_analysis(g, table):
    edges = B.normalized(g.edges, ["source_key", "target_key", "kind"]).select(F.lit("edge").alias("relation"), F.concat_ws("|", "source_key", "target_key", "kind").alias("line"))
    return edges.unionByName(B.normalized(g.nodes, ["key"]).select(F.lit("node").alias("relation"), F.col("key").alias("line")))


NODES = {"mn": """SELECT id, coalesce(min(CASE WHEN kind NOT IN ('', 'symbol') THEN kind END), max(nullif(kind, '')), 'symbol') AS kind, coalesce(min(nullif(name, '')), '') AS name, coalesce(min(nullif(path, '')), '') AS path,
 coalesce(min(nullif(package, '')), '') AS package, coalesce(min(CASE WHEN start_line > 0 THEN start_line END), 0) AS start_line, max(external) AS external, max(seed) AS seed FROM x_export GROUP BY id"""}
EDGES = {"me": """SELECT source, target, kind, historical, arg_min(confidence, CASE confidence WHEN 'exact' THEN 3 WHEN 'inferred' THEN 2 WHEN 'possible' THEN 1 ELSE 0 END) AS confidence,
 coalesce(string_agg(DISTINCT concat(path, ':', lpad(CAST(start_line AS STRING), 8, '0')), ',' ORDER BY concat(path, ':', lpad(CAST(start_line AS STRING), 8, '0'))), '') AS locations, coalesce(string_agg(DISTINCT nullif(details, ''), ',' ORDER BY nullif(details, '')), '') AS details FROM x_rows GROUP BY source, target, kind, historical"""}


@query("SELECT * FROM mn", **NODES)
def export_nodes(g, table):
    return X.merged_nodes(table("x_export"))


@query("SELECT * FROM me", **EDGES)
def export_edges(g, table):
    return X.merged_edges(table("x_rows"))


@query("""SELECT id, concat('  "', id, '" [label="', CASE WHEN name <> '' THEN concat(name, '\\n') ELSE '' END, '(', kind, ')', CASE WHEN path <> '' THEN concat('\\n', path) ELSE '' END, '"', CASE WHEN external = 1 THEN ', style=dashed' WHEN seed = 1 THEN ', penwidth=2' ELSE '' END, '];') AS line FROM mn""", **NODES)
def export_dot_nodes(g, table):
    return X.dot_nodes(X.merged_nodes(table("x_export")))


@query("""SELECT source, target, kind, historical, concat('  "', source, '" -> "', target, '" [label="', kind, '", style=', CASE WHEN historical = 1 THEN 'dotted' WHEN confidence = 'exact' THEN 'solid' ELSE 'dashed' END, '];') AS line FROM me""", **EDGES)
def export_dot_edges(g, table):
    return X.dot_edges(X.merged_edges(table("x_rows")))


@query("""SELECT id, concat('{"id":"', id, '","kind":"', kind, '","name":"', name, '","path":"', path, '","package":"', package, '","start_line":', CAST(start_line AS STRING), '}') AS json FROM mn""", **NODES)
def export_json(g, table):
    return X.json_nodes(X.merged_nodes(table("x_export")))
