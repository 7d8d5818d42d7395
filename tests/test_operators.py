"""Operators on small hand-written graphs: literal results, quirks, plans, and a model of the traversal."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths as P, text as T
from loomgraph.operators import build as B, changes as C, integrity as I, lookup as L, overlay as O
from loomgraph.plans import impact as M
from loomgraph.projection import Graph, graph
from loomgraph.sources.listing import parse_status
from loomgraph.store import InvalidGeneration, StaleGeneration, Store, catalog_scan


def make(spark, symbols, edges, evidence=(), packages=(("p", "lib/p", "lib", "p", "p", 0),)):
    """symbols: key, kind, package, name, path. edges: source, target, kind, confidence."""
    s = [(k, kind, p, f"file:{path}", n, "", "", path, 1, 2, 1) for k, kind, p, n, path in symbols]
    sym = spark.createDataFrame(s, "key string, kind string, package_key string, file_key string, name string, signature string, receiver string, path string, start_line long, end_line long, exported long")
    files = spark.createDataFrame(sorted({(f"file:{x[4]}", x[4], "b", x[2]) for x in symbols}), "key string, path string, blob_sha string, package_key string")
    nodes = sym.selectExpr("key", "kind", "1L as owned", "package_key", "file_key", "key as symbol_key", "1L as source_start", "2L as source_end")
    e = spark.createDataFrame([(*x, "") for x in edges], "source_key string, target_key string, kind string, confidence string, owner_package string")
    v = spark.createDataFrame(list(evidence), "evidence_id long, source_key string, target_key string, kind string, analyzer_source string, start_line long, end_line long, details string")
    pk = spark.createDataFrame(list(packages), "key string, import_path string, module_path string, directory string, name string, nk long")
    dep = spark.createDataFrame([], "source_package string, target_package string")
    tests = spark.createDataFrame([], "test_key string, target_key string, confidence string")
    blobs = spark.createDataFrame([("b", "sha1", 1)], "sha string, object_format string, byte_size long")
    return Graph(pk, files, sym, nodes, e, v, dep, tests, blobs)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, parts", [("HTTPServer", ["http", "server"]), ("parseURL2json", ["parse", "url", "2", "json"]), ("a_b-a", ["a", "b"]), ("", []), (None, []), ("Émile42Ünder", ["émile", "42", "ünder"])])
def test_tokenize(spark, text, parts):
    assert one(spark, T.tokenize(F.lit(text).cast("string"))) == parts


def test_significant_terms_keep_lone_stop_words(spark):
    assert one(spark, T.significant_terms(F.lit("handle the Server at support"))) == ["server"]
    assert one(spark, T.significant_terms(F.lit("fix it, make it"))) == ["fix", "it", "make"]
    assert one(spark, T.significant_terms(F.lit("Add The"))) == ["add", "the"]


def test_identifiers_break_at_case_digits_and_marks(spark):
    for text, parts in (("HTTPServerID2go", ["HTTP", "Server", "ID", "2", "go"]), ("a日b", ["a日b"]), ("日B", ["日B"]), ("snake_case-Two", ["snake", "case", "Two"]), ("ABc", ["A", "Bc"]), ("", [])):
        assert one(spark, T.split_identifier(F.lit(text))) == parts


def test_excerpts_are_cut_by_bytes_between_characters(spark):
    assert one(spark, T.bounded(F.lit("aé日🙂"), 100)) == "aé日🙂"
    assert [one(spark, T.bounded(F.lit("aé日🙂"), n)) for n in range(11)] == ["", "a", "a", "aé", "aé", "aé", "aé日", "aé日", "aé日", "aé日", "aé日🙂"]


def test_status_bytes_in_order_of_weight():
    """A rename in either byte, then an addition, a deletion, a change of type."""
    kinds = {x: parse_status(f"{x} p\0" + ("o\0" if set(x) & set("RC") else ""))[0][2:5] for x in ("MR", "RM", "AD", "MD", "DM", "MT", " M", "UU", "AM", "C ", "??")}
    assert kinds == {"MR": ("renamed", "o", "p"), "RM": ("renamed", "o", "p"), "AD": ("added", "", "p"), "MD": ("deleted", "p", ""), "DM": ("deleted", "p", ""), "MT": ("type_changed", "p", "p"), " M": ("modified", "p", "p"), "UU": ("type_changed", "p", "p"), "AM": ("added", "", "p"), "C ": ("copied", "o", "p"), "??": ("added", "", "p")}
    for bad in ("M", "M  ", "MMp.go", "R  new.go\0"):
        with pytest.raises(ValueError):
            parse_status(bad)


def test_bad_listings_are_errors(spark):
    from loomgraph.sources.listing import tree_manifest

    listing = lambda *x: spark.createDataFrame([("i", "\0".join(x))], "id string, listing string")
    assert tree_manifest(listing("100644 blob aa    12\ta/b.go", "")).collect()[0][1:] == ("a/b.go", "aa", "100644", 12)
    for bad in ("160000 commit 00       -\tsub", "100644 blob 00 1\t../out", "100644 blob 00 1\t/abs", "nonsense", "040000 tree 00 -\tdir"):
        with pytest.raises(Exception, match="tree|submodule|unsafe"):
            tree_manifest(listing(bad)).collect()


def test_package_evidence_stands_by_score_then_step(spark):
    from loomgraph.plans.impact import package_evidence

    rows = [("go:package:x", 50, "go:package:y", ["s1"], ["b"], 0, 1, 0), ("go:package:x", 50, "go:package:x", ["s2"], ["a"], 0, 1, 1), ("go:package:x", 50, "go:package:y", ["s3"], ["ab"], 0, 2, 0), ("go:package:x", 40, "go:package:x", ["s4"], ["0"], 0, 3, 0), ("external:package:q", 7, "", ["s5"], ["z"], 1, 1, 0)]
    found = spark.createDataFrame(rows, "key string, score long, current string, steps array<string>, marks array<string>, depth long, parent_rank long, rel_idx long")
    got = {r["key"]: (r["name"], r["score"], r["external"], r["steps"]) for r in package_evidence(found).collect()}
    assert got == {"go:package:x": ("x", 50, 0, ["s2"]), "external:package:q": ("q", 7, 1, ["s5"])}


@pytest.mark.parametrize("path, clean", [("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../a", None), ("/a", None), ("", None), ("a/../..", None), ("a\\b", "a/b"), (None, None)])
def test_clean_path(spark, path, clean):
    assert one(spark, P.clean_path(F.lit(path).cast("string"))) == clean


@pytest.mark.parametrize("url, identity", [("git@Host.org:team/repo.git", "host.org/team/repo"), ("https://user@HOST:8443/a/b/", "host:8443/a/b"), ("ssh://git@h.io/x.git", "h.io/x"), ("file:///srv/repo.git", "/srv/repo")])
def test_canonical_remote(spark, url, identity):
    assert one(spark, P.canonical_remote(F.lit(url))) == identity


def test_strip_nested_type_arguments(spark):
    assert one(spark, T.strip_type_arguments(F.lit("Map[K, List[V]].Get"))) == "Map.Get"
    assert one(spark, T.strip_type_arguments(F.lit("A[B[C[D[E[F[G]]]]]]].m]x[y"))) == "A.mx"


def test_status_parser_takes_the_old_path_of_a_renaming():
    assert parse_status("R  new.go\0old.go\0?? x.go\0!! y\0 D z.go\0") == [("R", " ", "renamed", "old.go", "new.go", 1), ("?", "?", "added", "", "x.go", 0), (" ", "D", "deleted", "z.go", "", 1)]


def test_search_ranks_before_it_cuts(spark):
    weak = [(f"symbol:a{k:02}", "function", "p", f"alpha{k}", f"a{k:02}.go") for k in range(40)]
    g = make(spark, [*weak, ("symbol:z", "function", "p", "AlphaBeta", "z.go")], [])
    assert L.search_symbols(g, ["alpha", "beta"], 1).first()["key"] == "symbol:z"
    assert L.search_symbols(g, [" "], 5).count() == 0


def test_bounded_cut_is_before_evidence(spark):
    symbols = [(k, "function", "p", k, "f.go") for k in "abcd"]
    edges = [("a", x, "calls", "exact") for x in "bcd"]
    evidence = [(k, "a", "b", "calls", "t", k, k, "") for k in range(5)]
    g = make(spark, symbols, edges, evidence)
    keys = spark.createDataFrame([("a",)], "node string")
    assert sorted(r["target_key"] for r in L.relationships_bounded(g, keys, 2).collect()) == ["b", "c"]
    assert L.relationships_full(g, keys).count() == 7


def test_self_edge_is_outgoing_and_once(spark):
    g = make(spark, [("a", "function", "p", "a", "f.go")], [("a", "a", "calls", "exact")])
    rows = L.symbol_buckets(g, spark.createDataFrame([("a",)], "node string")).collect()
    assert [(r["bucket"], r["n"]) for r in rows] == [("callees", 1)]


def model(symbols, edges, seeds, depth, fanout):
    """A plain queue: key -> (depth, score, first kind)."""
    info = {s[0]: s for s in symbols}

    def around(key):
        semantic = sorted({e for e in edges if e[2] != "references" and key in e[:2]}, key=lambda e: (e[2], e[0], e[1]))[: fanout + 1]
        refs = sorted((e for e in edges if e[2] == "references" and e[1] == key), key=lambda e: e[0])[: fanout + 1]
        return sorted({*semantic, *refs}, key=lambda e: (e[2], e[0], e[1]))

    seen, queue = {}, deque()
    for k in seeds:
        seen[k] = (0, 1000, "")
        queue.append(k)
    while queue:
        key = queue.popleft()
        d, score, _ = seen[key]
        if d == depth:
            continue
        for e in around(key)[:fanout]:
            other = e[1] if e[0] == key else e[0]
            if other in seen or other not in info:
                continue
            step = M.WEIGHTS.get(e[2], 10) - 15 * (d + 1) + {"exact": 10, "inferred": 5}.get(e[3], 0) + 10 * (info[other][2] == info[key][2]) + 8 * (info[other][4] == info[key][4])
            seen[other] = (d + 1, score + step, e[2])
            queue.append(other)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_traversal_equals_a_queue(spark, seed):
    rng = random.Random(seed)
    keys = [f"n{k:02}" for k in range(24)]
    symbols = [(k, "function", rng.choice("pq"), k, rng.choice(["a.go", "b.go"])) for k in keys]
    kinds = ("calls", "possible_call", "references", "tests", "implements")
    edges = sorted({(rng.choice(keys), rng.choice([*keys, "unresolved:1"]), rng.choice(kinds), "exact") for _ in range(60)})
    g = make(spark, symbols, edges)
    start = spark.createDataFrame([(k, 1000, n + 1) for n, k in enumerate(keys[:2])], "key string, score long, rank long")
    got = {r["key"]: (r["depth"], r["score"], r["first_kind"]) for r in M.traverse(g, start, 3, 4).nodes.collect()}
    assert got == model(symbols, edges, keys[:2], 3, 4)


def test_request_limits():
    with pytest.raises(ValueError):
        M.Request("x", max_depth=13)


def test_required_labels_go_first_when_cut(spark):
    nodes = [("s", 0, 10, "function", "a"), ("x", 1, 90, "function", "a"), ("y", 1, 80, "function", "a")]
    df = spark.createDataFrame([(k, d, s, 1, "calls" if d else "", [], kind, k, "p", path, int(k == "y")) for k, d, s, kind, path in nodes], "key string, depth long, score long, rank long, first_kind string, steps array<string>, kind string, name string, package_key string, path string, historical long")
    none = spark.createDataFrame([], "key string, name string, score long, external long, steps array<string>")
    walk = M.Traversal(df, none, False)
    assert {r["key"]: r["label"] for r in M.implementation_radius(walk).collect()} == {"s": "high", "x": "medium", "y": "historical"}
    assert [r["key"] for r in M.context_radius(walk, 2).orderBy("place").collect()] == ["y", "s"]
    assert [r["key"] for r in M.context_radius(walk, 3).orderBy("place").collect()] == ["x", "y", "s"]


def test_owner_is_the_narrowest_then_the_first(spark):
    spans = spark.createDataFrame([("f", 0, 1000, "outer", 1), ("f", 90, 110, "late", 3), ("f", 90, 110, "early", 2), ("g", 0, 5, "other", 4)], "file_key string, first long, last long, symbol_key string, ord long")
    points = spark.createDataFrame([("f", 110), ("f", 111), ("f", 2000), ("g", 5), ("f", 90)], "file_key string, pos long")
    assert {(r["file_key"], r["pos"]): r["owner"] for r in B.owner_at(points, spans).collect()} == {("f", 110): "early", ("f", 111): "outer", ("f", 2000): None, ("g", 5): "other", ("f", 90): "early"}


def test_division_needs_all_methods(spark):
    methods = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "type_key string, method string")
    required = spark.createDataFrame([("i", "a"), ("i", "b"), ("j", "a")], "interface_key string, method string")
    assert sorted(map(tuple, B.implements_division(methods, required).collect())) == [("t", "i"), ("t", "j"), ("u", "j")]


def test_tree_diff_pairs_renames(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "4")], "path string, blob_sha string")
    head = spark.createDataFrame([("a", "9"), ("x", "2"), ("e", "5"), ("d", "4")], "path string, blob_sha string")
    assert sorted((r["kind"], r["old_path"], r["new_path"]) for r in C.tree_diff(base, head).collect()) == [("added", "", "e"), ("deleted", "c", ""), ("modified", "a", "a"), ("renamed", "b", "x")]


def test_overlay_find_prefers_local_keys(spark):
    g = make(spark, [("k", "function", "p", "n", "f.go"), ("m", "function", "p", "k", "f.go")], [])
    changed = spark.createDataFrame([("k",)], "key string")
    none = spark.createDataFrame([], "path string")
    local = g.symbols.where("key = 'k'").withColumn("name", F.lit("n2"))
    found = O.find(O.symbols(g.symbols, local, changed, none), "k").collect()
    assert [(r["key"], r["name"], r["origin"]) for r in found] == [("k", "n2", "overlay")]


def test_store_lifecycle(spark, sf, tmp_path):
    g = graph(spark, sf)
    small = make(spark, [("a", "function", "p", "a", "f.go")], [("a", "a", "calls", "exact")])
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.active() is None
    with pytest.raises(StaleGeneration):
        store.open_view()
    key, mode = store.ensure(lambda: small, "c1", "f1")
    assert (key, mode) == (1, "rebuild") and store.ensure(lambda: small, "c1", "f1") == (1, "reuse")
    second = store.write_generation(small, "c2", "f1")
    with pytest.raises(StaleGeneration):
        store.activate(second, 1)
    store.validate(second)
    with pytest.raises(StaleGeneration):
        store.activate(second, None)
    store.activate(second, 1)
    assert store.active() == 2 and store.open_view(2).symbols.count() == 1
    with pytest.raises(StaleGeneration):
        store.open_view(1)
    assert store.prune() == 1 and store.open_view().edges.count() == 1
    assert [r["issue"] for r in catalog_scan(spark, [store.root, f"file://{tmp_path}/none"]).collect()] == ["", "no generations"]
    plan = store.open_view().symbols._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(generation_key" in plan
    assert g.symbols.columns == small.symbols.columns


def test_plans_have_no_cross_product(spark, sf):
    g = graph(spark, sf)
    keys = g.symbols.where("name = 'small_ring'").selectExpr("key as node")
    for df in (L.relationships_full(g, keys), L.bounded_neighborhood(g, keys, 8), L.search_symbols(g, ["ring"])):
        assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_lifecycle_stream(spark, tmp_path):
    from loomgraph.streaming.lifecycle import state_stream

    rows = [("2024-01-01 00:00:00", "r", "w", 1, "validate"), ("2024-01-01 00:05:00", "r", "w", 1, "activate"), ("2024-01-01 05:00:00", "r", "w", 2, "fail")]
    spark.createDataFrame(rows, "ts string, repo_id string, worktree_id string, generation_id long, action string").selectExpr("cast(ts as timestamp) ts", "repo_id", "worktree_id", "generation_id", "action").write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("ts timestamp, repo_id string, worktree_id string, generation_id long, action string").parquet(f"{tmp_path}/e")
    q = state_stream(events).writeStream.outputMode("append").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["generation_id"], r["last_action"], r["events"]) for r in spark.table("states").collect()] == [(1, "activate", 2)]


def test_equal_graphs_move_no_rows_and_others_are_counted(spark):
    from dataclasses import replace

    g = make(spark, [("a", "function", "p", "a", "f.go")], [("a", "a", "calls", "exact")])
    same = I.equal_analysis(g, replace(g, edges=g.edges.coalesce(1)))
    assert "Exchange" not in same._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[1:] for r in same.collect()} == {(0, 0)} and same.count() == 9
    schema = "source_key string, target_key string, kind string, confidence string, owner_package string"
    left = [("a", None, "k", "x", "")] * 3 + [(None, "a", "k", "x", ""), ("b", "", "k", "x", ""), ("same", "s", "k", "x", "")]
    right = [("a", None, "k", "x", ""), ("same", "s", "k", "x", ""), ("same", "s", "k", "x", ""), ("b", None, "k", "x", "")]
    x, y = (replace(g, edges=spark.createDataFrame(rows, schema)) for rows in (left, right))
    got = {r["relation"]: (r["only_left"], r["only_right"]) for r in I.equal_analysis(x, y).collect()}
    assert got["edges"] == (x.edges.exceptAll(y.edges).count(), y.edges.exceptAll(x.edges).count()) == (4, 2)
    assert sum(a + b for a, b in got.values()) == 6


def test_sound_candidates_skip_the_full_rules(spark, tmp_path, monkeypatch):
    from dataclasses import replace

    from loomgraph import store as stores

    calls, rules = [], I.validate_analysis
    monkeypatch.setattr(stores, "validate_analysis", lambda *a: calls.append(1) or rules(*a))
    g = make(spark, [("a", "function", "p", "a", "f.go")], [("a", "a", "calls", "exact")], [(1, "a", "a", "calls", "x", 1, 2, "")])
    Store(spark, f"file://{tmp_path}/s").ensure(lambda: g, "c1", "f1")
    assert not calls
    wrong = {
        "edges": [g.edges.unionByName(g.edges), g.edges.withColumn("target_key", F.lit("z")), g.edges.withColumn("confidence", F.lit("?"))],
        "evidence": [g.evidence.unionByName(g.evidence), g.evidence.withColumn("kind", F.lit("tests"))],
        "symbols": [g.symbols.withColumn("file_key", F.lit("z"))],
        "blobs": [g.blobs.where("false")],
    }
    for name, frames in wrong.items():
        for df in frames:
            bad = replace(g, **{name: df})
            assert I.may_break(bad)
    with pytest.raises(InvalidGeneration):
        Store(spark, f"file://{tmp_path}/t").ensure(lambda: replace(g, edges=g.edges.unionByName(g.edges)), "c1", "f1")
    assert calls


@pytest.mark.parametrize("name", ["ensure_graph", "store_recovery"])
def test_stores_make_the_candidate_once(spark, sf, monkeypatch, name):
    from loomgraph import catalogue
    from loomgraph.queries import stores

    scans, sound = [], stores._sound
    monkeypatch.setattr(stores, "_sound", lambda g: scans.append(1) or sound(g))
    write, sources = Store.write_generation, []
    monkeypatch.setattr(Store, "write_generation", lambda self, g, *a: sources.append(g.edges.inputFiles()) or write(self, g, *a))
    catalogue.QUERIES[name](spark, sf)
    assert len(scans) == 1 and len(sources) == 2
    assert all("/edges/generation_key=1/" in f for f in sources[1])
