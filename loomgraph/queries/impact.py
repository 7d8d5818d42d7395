"""Impact: seeds, traversal, radii; the SQL unrolls the levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.plans import impact as M
from loomgraph.queries import query
from loomgraph.queries.lookup import FIRST, incident, neighborhood, refs

#: The operator's own limits.
REQUEST = M.Request("fix the promo ring")
START, SEEDS, DEPTH, FANOUT, ITEMS, TASK = "hot_gear", REQUEST.max_seeds, REQUEST.max_depth, REQUEST.max_fanout, REQUEST.max_items, REQUEST.task
_W = "CASE r.kind WHEN 'calls' THEN 90 WHEN 'possible_call' THEN 65 WHEN 'unresolved_call' THEN 25 WHEN 'references' THEN 55 WHEN 'implements' THEN 75 WHEN 'tests' THEN 60 ELSE 10 END"
_OTHER = "CASE WHEN r.source_key = r.node THEN r.target_key ELSE r.source_key END"
_BONUS = "CASE r.confidence WHEN 'exact' THEN 10 WHEN 'inferred' THEN 5 ELSE 0 END"
_NAMED = f"SELECT key, 1000 AS score, row_number() OVER (ORDER BY key) AS rank FROM g_symbols WHERE name = '{START}' ORDER BY key LIMIT {SEEDS}"


def walk(start: str = _NAMED) -> dict[str, str]:
    out = {"start_": start, "first_": FIRST, "lv0": "SELECT s.key, 0 AS depth, t.score, t.rank, '' AS first_kind, '' AS steps, '' AS marks, s.kind, s.name, s.package_key, s.path FROM start_ t JOIN g_symbols s ON s.key = t.key"}
    for d in range(DEPTH):
        out[f"k{d}"] = f"SELECT key AS node FROM lv{d}"
        out |= neighborhood(f"nb{d}", f"k{d}", FANOUT + 1)
        seen = " UNION ALL ".join(f"SELECT key FROM lv{k}" for k in range(d + 1))
        out[f"mv{d}"] = f"""SELECT r.*, {_OTHER} AS other, p.rank AS parent_rank, p.package_key AS parent_package, p.path AS parent_path, p.score + {_W} - {15 * (d + 1)} + {_BONUS} AS moved,
 concat(p.steps, CASE WHEN p.steps = '' THEN '' ELSE ';' END, r.kind, ':', r.source_key, '>', r.target_key) AS steps, concat(r.source_key, chr(1), r.target_key, chr(1), r.kind) AS mark,
 concat(p.marks, CASE WHEN p.marks = '' THEN '' ELSE chr(1) END, r.source_key, chr(1), r.target_key, chr(1), r.kind) AS marks FROM nb{d} r JOIN lv{d} p ON p.key = r.node WHERE r.rel_idx < {FANOUT} AND {_OTHER} <> r.node"""
        out[f"lv{d + 1}"] = f"""SELECT key, {d + 1} AS depth, score, rank, first_kind, steps, marks, kind, name, package_key, path FROM (SELECT s.key, s.kind, s.name, s.package_key, s.path, m.kind AS first_kind, m.steps, m.marks, m.parent_rank * {FANOUT + 1} + m.rel_idx AS rank,
 m.moved + CASE WHEN s.package_key <> '' AND s.package_key = m.parent_package THEN 10 ELSE 0 END + CASE WHEN s.path <> '' AND s.path = m.parent_path THEN 8 ELSE 0 END AS score,
 row_number() OVER (PARTITION BY s.key ORDER BY m.parent_rank, m.rel_idx) AS turn FROM mv{d} m JOIN g_symbols s ON s.key = m.other WHERE s.key NOT IN ({seen})) WHERE turn = 1"""
    out["walked"] = " UNION ALL ".join(f"SELECT * FROM lv{d}" for d in range(DEPTH + 1))
    out["outside"] = " UNION ALL ".join(f"SELECT concat('external:package:', string_split(replace(other, 'external:symbol:', ''), ':')[1]) AS key, moved AS score, steps, mark, marks, {d} AS depth, parent_rank, rel_idx FROM mv{d} WHERE other LIKE 'external:%'" for d in range(DEPTH))
    out["tops"] = "SELECT key, list({'score': score, 'steps': steps, 'mark': mark, 'marks': marks} ORDER BY depth, parent_rank, rel_idx) AS all_ FROM (SELECT *, max(score) OVER (PARTITION BY key) AS best FROM outside) WHERE score = best GROUP BY key"
    out["evid"] = "SELECT key, replace(key, 'external:package:', '') AS name, e.score AS score, CAST(1 AS BIGINT) AS external, e.steps AS steps FROM (SELECT key, list_reduce(all_, lambda a, x: CASE WHEN x.mark < a.marks THEN x ELSE a END) AS e FROM tops)"
    return out


WALK = walk()
REQUIRED = "('must-read', 'high', 'direct-test', 'package-tests', 'package-risk', 'external', 'historical')"


def bounded(items: str, order: str) -> str:
    return f"SELECT *, n_ > {ITEMS} AS cut FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN n_ > {ITEMS} AND label NOT IN {REQUIRED} THEN 1 ELSE 0 END, ord_) AS place FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS ord_, count(*) OVER () AS n_ FROM {items})) WHERE place <= {ITEMS}"


_BY = "score DESC, depth, path, key"
_REACHED = "concat('reached through ', first_kind, ' at graph distance ', CAST(depth AS STRING))"
CONTEXT = {"ctx": f"SELECT *, CASE WHEN depth = 0 THEN 'must-read' WHEN kind = 'test' THEN 'test' ELSE 'supporting' END AS label, CASE WHEN depth = 0 THEN 'direct task seed; read before implementation' WHEN kind = 'test' THEN concat('test associated through ', first_kind, ' at graph distance ', CAST(depth AS STRING)) ELSE {_REACHED} END AS reason FROM walked", "ctxb": bounded("ctx", _BY)}
IMPLEMENT = {"imp": f"""SELECT *, CASE WHEN depth = 0 THEN 'high' WHEN first_kind = 'unresolved_call' THEN 'inspect-only' WHEN depth = 1 THEN 'medium' WHEN first_kind IN ('calls', 'possible_call') THEN 'downstream' ELSE 'low' END AS label,
 CASE WHEN depth = 0 THEN 'direct task seed; likely implementation owner' WHEN first_kind = 'unresolved_call' THEN 'unresolved call target; inspect manually before changing' WHEN depth > 1 AND first_kind IN ('calls', 'possible_call') THEN 'downstream dependency reached through bounded call traversal' ELSE {_REACHED} END AS reason FROM walked WHERE kind <> 'test'""", "impb": bounded("imp", _BY)}
VALIDATE = {
    "pk": "SELECT coalesce(w.key, e.key) AS key, w.best, w.named, e.score AS own FROM (SELECT package_key AS key, max(score) AS best, count(*) FILTER (WHERE kind <> 'test') AS named FROM walked WHERE package_key <> '' GROUP BY package_key) w FULL JOIN evid e ON e.key = w.key WHERE named > 0 OR e.score IS NOT NULL",
    "val": """SELECT key, kind, 'direct-test' AS label, score, 0 AS part, depth, path, 'test relationship reached from the impacted graph' AS reason FROM walked WHERE kind = 'test'
UNION ALL SELECT concat('package:', key), 'package', CASE WHEN own IS NULL THEN 'package-risk' ELSE 'external' END, coalesce(own, CASE WHEN coalesce(best, 0) > 0 THEN best ELSE 20 END - 20), 1, 0, '',
 CASE WHEN own IS NULL THEN 'package needs validation even without an exact test-symbol association' ELSE 'external package relationship; validate integration at the boundary' END FROM pk""",
    "valb": bounded("val", "part, CASE WHEN part = 0 THEN -score END, depth, path, key"),
}
SHOWN = ", ".join(M.SHOWN)


def _walk(g):
    from pyspark.sql import Window

    start = g.symbols.where(F.col("name") == START).orderBy("key").limit(SEEDS)
    start = start.select("key", F.lit(1000).alias("score"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key")).alias("rank"))
    return M.traverse(g, start, DEPTH, FANOUT)


@query("SELECT key, depth, score, rank, first_kind FROM walked", **WALK)
def impact_traverse(g, table):
    return _walk(g).nodes.select("key", "depth", "score", "rank", "first_kind")


@query("SELECT key, depth, steps FROM walked WHERE depth > 0", **WALK)
def impact_paths(g, table):
    return _walk(g).nodes.where("depth > 0").select("key", "depth", F.array_join("steps", ";").alias("steps"))


@query("SELECT * FROM evid", **WALK)
def impact_packages(g, table):
    """The evidence of each package at the boundary."""
    return _walk(g).packages.withColumn("steps", F.array_join("steps", ";"))


@query(f"SELECT {SHOWN} FROM ctxb", **WALK, **CONTEXT)
def impact_context(g, table):
    return M.context_radius(_walk(g), ITEMS)


@query(f"SELECT {SHOWN} FROM impb", **WALK, **IMPLEMENT)
def impact_implementation(g, table):
    return M.implementation_radius(_walk(g), ITEMS)


@query(f"SELECT {SHOWN} FROM valb", **WALK, **VALIDATE)
def impact_validation(g, table):
    return M.validation_radius(_walk(g), ITEMS)


_TERMS = ("fix", "promo", "ring")
_TEXT = "lower(concat(key, ' ', name, ' ', receiver, ' ', signature, ' ', package_key, ' ', file_key, ' ', path))"
_N = lambda text: " + ".join(f"CASE WHEN {text.format(t=t)} THEN 1 ELSE 0 END" for t in _TERMS)
_ANY = lambda c: "(" + " OR ".join(f"instr(lower({c}), '{t}') > 0" for t in _TERMS) + ")"
_ID = "fixthepromoring"


SEEDED = dict(
       pool=f"SELECT * FROM (SELECT s.*, {' + '.join(f'''CASE WHEN {' OR '.join(f'instr(lower({c}), {chr(39)}{t}{chr(39)}) > 0' for c in ('s.key', 's.name', 's.receiver', 's.signature', 's.package_key', 's.file_key', 's.path', 'p.import_path'))} THEN 1 ELSE 0 END''' for t in _TERMS)} AS matched FROM g_symbols s LEFT JOIN g_packages p ON p.key = s.package_key) WHERE matched > 0 ORDER BY matched DESC, package_key, path, start_line, key LIMIT 64",
       named="SELECT *, replace(name, '_', '') AS nid FROM pool",
       scored=f"""SELECT key, kind, package_key, file_key, name, signature, receiver, path, start_line, end_line, exported,
 10 * ({_N("instr(" + _TEXT + ", '{t}') > 0")}) + 140 * ({_N("list_contains(string_split(name, '_'), '{t}')")}) + CASE m WHEN 'exact identifier' THEN 1000 WHEN 'name terms' THEN 400 WHEN 'task identifier' THEN 700 WHEN 'name prefix' THEN 350 WHEN 'signature' THEN 140 ELSE 0 END
 + CASE WHEN path <> '' AND {_ANY('path')} THEN 15 ELSE 0 END + CASE WHEN package_key <> '' AND {_ANY('package_key')} THEN 12 ELSE 0 END AS score, m AS match FROM (
SELECT *, CASE WHEN nid = '{_ID}' THEN 'exact identifier' WHEN instr(nid, 'fix') > 0 AND instr(nid, 'promo') > 0 AND instr(nid, 'ring') > 0 THEN 'name terms' WHEN ends_with('{_ID}', nid) AND length(nid) >= 4 THEN 'task identifier' WHEN instr(nid, '{_ID}') > 0 THEN 'name prefix' WHEN instr(lower(signature), '{TASK}') > 0 THEN 'signature' ELSE 'field token' END AS m FROM named)""",
       seeded="SELECT *, CASE WHEN score = max(score) OVER () AND rank <= 8 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS selected FROM (SELECT *, row_number() OVER (ORDER BY score DESC, key, path, name) AS rank FROM scored)",
)


@query("SELECT * FROM seeded", **SEEDED)
def impact_seeds(g, table):
    return M.seeds(g, REQUEST)


_CUT = {
    "cut_seeds": f"SELECT count(*) > {SEEDS} AS v FROM seeded WHERE score = (SELECT max(score) FROM seeded)", "cut_context": f"SELECT count(*) > {ITEMS} AS v FROM ctx", "cut_implementation": f"SELECT count(*) > {ITEMS} AS v FROM imp", "cut_validation": f"SELECT count(*) > {ITEMS} AS v FROM val",
    "last_": f"SELECT key AS node FROM lv{DEPTH}", "far": incident("last_"), "farr": refs("last_"),
    "cut_traversal": "SELECT (SELECT count(*) FROM far) + (SELECT count(*) FROM farr) > 0 OR " + " OR ".join(f"(SELECT count(*) FROM nb{d} WHERE rel_idx >= {FANOUT}) > 0" for d in range(DEPTH)) + " AS v",
}
_ONE = "SELECT 'context' AS radius, label, count(*) AS items, CAST(sum(score) AS BIGINT) AS score, bool_or(cut) AS cut FROM ctxb GROUP BY label UNION ALL SELECT 'implementation', label, count(*), CAST(sum(score) AS BIGINT), bool_or(cut) FROM impb GROUP BY label UNION ALL SELECT 'validation', label, count(*), CAST(sum(score) AS BIGINT), bool_or(cut) FROM valb GROUP BY label"
_STATUS = "CASE (SELECT count(*) FROM seeded WHERE selected = 1) WHEN 0 THEN 'no-match' WHEN 1 THEN 'matched' ELSE 'ambiguous' END"


@query(f"SELECT r.*, {_STATUS} AS status, (SELECT v FROM cut_seeds) AS cut_seeds, (SELECT v FROM cut_traversal) AS cut_traversal, (SELECT v FROM cut_seeds) OR (SELECT v FROM cut_context) OR (SELECT v FROM cut_implementation) OR (SELECT v FROM cut_validation) OR (SELECT v FROM cut_traversal) AS truncated FROM ({_ONE}) r",
       **SEEDED, **walk("SELECT key, score, rank FROM seeded WHERE selected = 1"), **CONTEXT, **IMPLEMENT, **VALIDATE, **_CUT)
def impact_report(g, table):
    """The report of a task, summed up by radius and label, with its status and flags."""
    r = M.report(g, REQUEST)
    total = lambda name: r[name].groupBy("label").agg(F.count(F.lit(1)).alias("items"), F.sum("score").alias("score"), F.bool_or("cut").alias("cut")).select(F.lit(name).alias("radius"), "label", "items", "score", "cut")
    out = total("context").unionByName(total("implementation")).unionByName(total("validation"))
    return out.withColumns({"status": F.lit(r["status"]), "cut_seeds": F.lit(r["flags"]["seeds"]), "cut_traversal": F.lit(r["flags"]["traversal"]), "truncated": F.lit(r["truncated"])})
