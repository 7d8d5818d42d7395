"""Text, paths, sources, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import paths as P, text as T
from loomgraph.operators import build as B, changes as C
from loomgraph.queries import query
from loomgraph.sources import listing as S

_SPACED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '(\\p{{L}})(\\p{{Nd}})', '\\1 \\2', 'g'), '(\\p{{Nd}})(\\p{{L}})', '\\1 \\2', 'g')"
_TWICE = _SPACED.format(x=_SPACED.format(x="text"))
PARTS = f"SELECT id, i, lower(w) AS w FROM (SELECT id, unnest(string_split_regex({_TWICE}, '[^\\p{{L}}\\p{{Nd}}]+')) AS w, generate_subscripts(string_split_regex({_TWICE}, '[^\\p{{L}}\\p{{Nd}}]+'), 1) AS i FROM src) WHERE w <> ''"
STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
TALK = "SELECT concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING), ':', role) AS id, text FROM conversations"


def _talk(table):
    return table("conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("id"), "text")


@query("SELECT id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS tokens FROM (SELECT id, w, min(i) AS i FROM parts GROUP BY id, w) GROUP BY id", src=TALK, parts=PARTS)
def tokenize(g, table):
    return _talk(table).select("id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens")).where("tokens <> ''")


@query(f"""SELECT id, CASE WHEN count(*) FILTER (WHERE w NOT IN {STOP}) > 0 THEN string_agg(w, ' ' ORDER BY i) FILTER (WHERE w NOT IN {STOP}) ELSE string_agg(w, ' ' ORDER BY i) END AS terms
FROM (SELECT id, w, min(i) AS i FROM parts GROUP BY id, w) GROUP BY id""", src="SELECT concat('d', CAST(doc_id AS STRING)) AS id, concat('handle the ', text) AS text FROM documents UNION ALL SELECT r_name, 'Add to the' FROM region", parts=PARTS)
def significant_terms(g, table):
    docs = table("documents").selectExpr("concat('d', cast(doc_id as string)) AS id", "concat('handle the ', text) AS text")
    rows = docs.unionByName(table("region").selectExpr("r_name AS id", "'Add to the' AS text"))
    return rows.select("id", F.array_join(T.significant_terms(F.col("text")), " ").alias("terms"))


@query("""SELECT page_id, CASE WHEN path = '' THEN host ELSE concat(host, '/', path) END AS identity, concat('repo-', sha256(CASE WHEN path = '' THEN host ELSE concat(host, '/', path) END)) AS repo_id
FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^@/]*@)?([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/*([^?#]*)', 1), '/+$', '') AS path FROM pages)""")
def canonical_remote(g, table):
    identity = P.canonical_remote(F.col("url"))
    return table("pages").select("page_id", identity.alias("identity"), P.repository_id(identity).alias("repo_id"))


@query("SELECT page_id, replace(replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^?#]*)', 1), '/+$', ''), '/./', '/'), '//', '/') AS path FROM pages")
def normalize_paths(g, table):
    raw = F.regexp_extract("url", r"^[a-zA-Z]+://([^?#]*)", 1)
    noisy = F.concat(F.lit("./x/../"), F.replace(raw, F.lit("/"), F.lit("/.//")))
    return table("pages").select("page_id", P.clean_path(noisy).alias("path"))


@query("SELECT path FROM (SELECT path FROM m_head UNION SELECT concat(path, '.md') FROM m_head UNION SELECT concat(path, '/go.sum') FROM m_head) WHERE path LIKE '%.go' OR path LIKE '%/go.sum'")
def eligible_paths(g, table):
    head = table("m_head").select("path")
    more = head.union(head.select(F.concat("path", F.lit(".md")))).union(head.select(F.concat("path", F.lit("/go.sum")))).distinct()
    return more.where(P.is_eligible(F.col("path")))


@query("SELECT p_partkey, concat(p_name, '.Get') AS plain FROM part")
def strip_type_args(g, table):
    generic = F.concat("p_name", F.lit("["), "p_brand", F.lit(", Map["), "p_type", F.lit(", A[B[C[D[E[int]]]]]]].G]et"))
    return table("part").select("p_partkey", T.strip_type_arguments(generic).alias("plain"))


_SPAN = "list_slice(string_split(text, chr(10)), least(2, len(string_split(text, chr(10)))), least(4, len(string_split(text, chr(10)))))"


@query(f"SELECT doc_id, sha256(array_to_string({_SPAN}, chr(10))) AS digest FROM documents")
def span_digest(g, table):
    return table("documents").select("doc_id", T.span_digest(F.col("text"), F.lit(2), F.lit(4)).alias("digest"))


_LINES = "array_to_string(list_slice(string_split(text, chr(10)), least(2, len(string_split(text, chr(10)))), greatest(least(2, len(string_split(text, chr(10)))), least(61, len(string_split(text, chr(10)))))), chr(10))"


@query("SELECT doc_id, CASE WHEN strlen(t) <= 12288 THEN t ELSE left(t, list_max(list_filter(range(3072, 12289), lambda k: strlen(left(t, k)) <= 12288))) END AS excerpt FROM cut", cut=f"SELECT doc_id, {_LINES} AS t FROM documents")
def context_excerpts(g, table):
    """From the second line on, under the operator's own limits."""
    return table("documents").select("doc_id", T.excerpt(F.col("text"), F.lit(2), F.lit(1 << 30)).alias("excerpt"))


@query("SELECT path, CASE WHEN path LIKE '%_test.go' THEN 'test' ELSE '' END AS variant, CASE WHEN id % 4 = 0 THEN 'external' WHEN path LIKE '%_test.go' THEN 'test' ELSE '' END AS named FROM m_files")
def package_variants(g, table):
    named = F.when(F.col("id") % 4 == 0, "p_test").otherwise("p")
    return table("m_files").select("path", B.package_variant(F.col("path"), F.lit("p")).alias("variant"), B.package_variant(F.col("path"), named).alias("named"))


@query("SELECT package_key AS id, path, blob_sha, '100644' AS mode, CAST(length(path) AS BIGINT) AS size FROM m_files")
def src_tree_manifest(g, table):
    entry = F.concat(F.lit("100644 blob "), "blob_sha", F.lit("   "), F.length("path").cast("string"), F.lit("\t"), "path")
    raw = table("m_files").groupBy(F.col("package_key").alias("id")).agg(F.concat(F.array_join(F.collect_list(entry), "\x00"), F.lit("\x00")).alias("listing"))
    return S.tree_manifest(raw)


@query("SELECT package_key AS id, CASE kind WHEN 'added' THEN '?' WHEN 'modified' THEN ' ' ELSE upper(substr(kind, 1, 1)) END AS index_status, CASE kind WHEN 'added' THEN '?' WHEN 'modified' THEN 'M' ELSE ' ' END AS worktree_status, kind, old_path, new_path, tracked FROM m_status")
def src_status_parse(g, table):
    code = F.when(F.col("kind") == "added", "??").when(F.col("kind") == "modified", " M").when(F.col("kind") == "deleted", "D ").otherwise("R ")
    name = F.when(F.col("kind") == "deleted", F.col("old_path")).otherwise(F.col("new_path"))
    entry = F.concat(code, F.lit(" "), name, F.when(F.col("kind") == "renamed", F.concat(F.lit("\x00"), "old_path")).otherwise(""))
    raw = table("m_status").groupBy(F.col("package_key").alias("id")).agg(F.concat(F.lit("!! ignored\x00"), F.array_join(F.collect_list(entry), "\x00")).alias("listing"))
    return S.worktree_status(raw)


@query("SELECT concat('docs/', CAST(doc_id AS STRING), '.txt') AS path, sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 THEN '100755' ELSE '100644' END AS mode, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def src_file_identity(g, table):
    files = table("documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), (F.col("doc_id") % 3 == 0).cast("int").alias("executable"))
    return S.file_identity(files)


DIFF = {
    "ch": "SELECT coalesce(b.path, h.path) AS path, b.blob_sha AS old_sha, h.blob_sha AS new_sha FROM m_base b FULL JOIN m_head h ON b.path = h.path WHERE b.blob_sha IS DISTINCT FROM h.blob_sha",
    "gone": "SELECT old_sha AS sha, path AS old_path, row_number() OVER (PARTITION BY old_sha ORDER BY path) AS k FROM ch WHERE new_sha IS NULL",
    "come": "SELECT new_sha AS sha, path AS new_path, row_number() OVER (PARTITION BY new_sha ORDER BY path) AS k FROM ch WHERE old_sha IS NULL",
    "diff": """SELECT CASE WHEN new_path IS NULL THEN 'deleted' WHEN old_path IS NULL THEN 'added' ELSE 'renamed' END AS kind, coalesce(old_path, '') AS old_path, coalesce(new_path, '') AS new_path,
 CASE WHEN new_path IS NOT NULL AND old_path IS NOT NULL THEN CAST(100 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS score FROM gone FULL JOIN come ON gone.sha = come.sha AND gone.k = come.k
UNION ALL SELECT 'modified', path, path, CAST(0 AS BIGINT) FROM ch WHERE old_sha IS NOT NULL AND new_sha IS NOT NULL""",
}


@query("SELECT * FROM diff", **DIFF)
def src_tree_diff(g, table):
    return C.tree_diff(table("m_base"), table("m_head"))


NORMAL = {"normal": "SELECT DISTINCT kind, regexp_replace(old_path, '^\\./', '') AS old_path, replace(regexp_replace(new_path, '^a/\\.\\./', ''), '//', '/') AS new_path, score FROM m_changes WHERE new_path NOT LIKE '../%'"}


@query("SELECT * FROM normal", **NORMAL)
def normalize_changes(g, table):
    return C.normalize_changes(table("m_changes"))


TOTALS = "SELECT package_key AS worktree, count(*) AS total_files, CAST(substr(package_key, length(package_key), 1) AS BIGINT) % 8 AS t FROM m_files GROUP BY package_key"
_TOTALS = ("worktree", "total_files", "cast(t = 1 as long) AS force", "cast(t = 2 as long) AS fingerprint_changed", "cast(t <> 3 as long) AS base_available")


@query("""SELECT worktree, CASE WHEN t IN (1, 2, 3) OR changed > 100 OR ratio > 0.30 OR wide = 1 THEN 'rebuild' ELSE 'incremental' END AS mode,
 CASE WHEN t = 1 THEN 'forced rebuild' WHEN t = 2 THEN 'build inputs or analyzer fingerprint changed' WHEN t = 3 THEN 'indexed base commit unavailable' WHEN changed > 100 THEN 'too many changed files' WHEN ratio > 0.30 THEN 'changed file ratio too high'
  WHEN wide = 1 THEN 'module, workspace, vendor, or build input changed' WHEN changed = 0 THEN 'commit changed without source file changes' ELSE 'compatible source delta' END AS reason, changed, ratio
FROM (SELECT t.worktree, t.t, coalesce(c.changed, 0) AS changed, coalesce(c.wide, 0) AS wide, CAST(coalesce(c.changed, 0) AS DOUBLE) / t.total_files AS ratio FROM totals t
LEFT JOIN (SELECT package_key AS worktree, count(*) AS changed, max(CASE WHEN new_path LIKE '%/go.mod' THEN 1 ELSE 0 END) AS wide FROM m_changes WHERE kind <> 'modified' GROUP BY package_key) c ON c.worktree = t.worktree)""", totals=TOTALS)
def sync_decision(g, table):
    kind = F.expr("substr(package_key, length(package_key), 1)").cast("long") % 8
    totals = table("m_files").groupBy(F.col("package_key").alias("worktree")).agg(F.count(F.lit(1)).alias("total_files")).withColumn("package_key", F.col("worktree")).withColumn("t", kind)
    changes = table("m_changes").where("kind <> 'modified'").select(F.col("package_key").alias("worktree"), "old_path", "new_path")
    return C.sync_decision(changes, totals.selectExpr(*_TOTALS))


@query("""SELECT coalesce(f.package_key, '') AS package_key, count(*) FILTER (WHERE gone = 0) AS changed, count(*) FILTER (WHERE gone = 1) AS deleted FROM (SELECT path, max(gone) AS gone FROM (SELECT old_path AS path, CASE WHEN kind IN ('deleted', 'renamed') THEN 1 ELSE 0 END AS gone FROM diff
UNION ALL SELECT new_path, 0 FROM diff) WHERE path <> '' GROUP BY path) p LEFT JOIN m_base f ON f.path = p.path GROUP BY 1""", **DIFF)
def plan_invalidation(g, table):
    return C.plan_invalidation(table("m_base"), C.tree_diff(table("m_base"), table("m_head")))


_ID = "package_key, kind, receiver, name"
SYM = {
    "o": f"SELECT *, row_number() OVER (PARTITION BY {_ID} ORDER BY path, start_line, key) AS k FROM x_old", "n": f"SELECT *, row_number() OVER (PARTITION BY {_ID} ORDER BY path, start_line, key) AS k FROM x_new",
    "sym": """SELECT CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'deleted' WHEN o.path <> n.path THEN 'renamed' WHEN o.digest <> n.digest THEN 'modified' END AS change, coalesce(o.package_key, n.package_key) AS package_key,
 coalesce(o.kind, n.kind) AS kind, coalesce(o.receiver, n.receiver) AS receiver, coalesce(o.name, n.name) AS name, coalesce(o.key, '') AS old_key, coalesce(n.key, '') AS new_key
FROM o FULL JOIN n ON o.package_key = n.package_key AND o.kind = n.kind AND o.receiver = n.receiver AND o.name = n.name AND o.k = n.k""",
}


@query("SELECT * FROM sym WHERE change IS NOT NULL", **SYM)
def symbol_changes(g, table):
    return C.symbol_changes(table("x_old"), table("x_new"))


@query("SELECT DISTINCT key FROM (SELECT new_key AS key FROM sym WHERE change IS NOT NULL UNION ALL SELECT old_key FROM sym WHERE change IN ('deleted', 'renamed')) WHERE key <> ''", **SYM)
def change_seeds(g, table):
    return C.change_seeds(C.symbol_changes(table("x_old"), table("x_new")))


_NAMES = "SELECT p_partkey, concat(CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size - 3 AS STRING) END, CASE WHEN p_size % 7 = 0 THEN '-' ELSE '_' END, replace(p_name, ' ', '_'), '.sql') AS name FROM part"
_SAID = "SELECT p_partkey, concat('  ', CASE p_size % 4 WHEN 0 THEN 'Could not import ' WHEN 1 THEN 'module lookup DISABLED: ' WHEN 2 THEN 'undefined: ' ELSE '' END, p_name, ' ') AS message FROM part"


@query(f"SELECT name, CAST(CASE WHEN v > 0 THEN v ELSE 0 END AS BIGINT) AS version, count(*) AS n FROM (SELECT name, TRY_CAST(regexp_extract(name, '^([0-9]+)_', 1) AS INT) AS v FROM ({_NAMES})) GROUP BY name, v")
def migration_version(g, table):
    names = g.spark.sql(_NAMES)
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", F.coalesce(T.migration_version(F.col("name")), F.lit(0)).cast("long").alias("version"), "n")


@query(f"SELECT said, count(*) AS n FROM (SELECT concat(CASE WHEN lower(message) SIMILAR TO '.*(could not import|cannot find module|no required module provides package|module lookup disabled).*' THEN 'missing module dependency: ' ELSE '' END, trim(message)) AS said FROM ({_SAID})) GROUP BY said")
def package_message(g, table):
    return g.spark.sql(_SAID).select(T.package_message(F.col("message")).alias("said")).groupBy("said").agg(F.count(F.lit(1)).alias("n"))
