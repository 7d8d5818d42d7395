"""Stores that break, objects and places of repositories, guards, and the rules of a candidate."""

import subprocess
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths as P, text as T
from loomgraph.operators import integrity as I, overlay as O
from loomgraph.sources import objects, repository
from loomgraph.store import InvalidGeneration, StaleGeneration, Store
from tests.test_operators import make, one


@pytest.fixture
def small(spark):
    return make(spark, [("a", "function", "p", "a", "f.go"), ("t", "test", "p", "t", "f.go")], [("a", "a", "calls", "exact"), ("t", "a", "tests", "")])


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


def rules(g, diagnostics=None):
    return sorted((r["rule"], r["subject"]) for r in I.validate_analysis(g, diagnostics).collect())


def test_two_writers_of_one_version(store, small):
    store.ensure(lambda: small, "c1", "f1")
    seen, rows = store.version(), store.control()
    store._publish(rows, seen)
    with pytest.raises(StaleGeneration):
        store._publish(rows, seen)
    assert store.version() == seen + 1 and store.active() == 1
    assert not [n for n in store.files.names(f"{store.root}/control") if n.startswith("pointer")]


def test_unfinished_version_blocks_nobody(store, small):
    store.ensure(lambda: small, "c1", "f1")
    store.control().write.parquet(f"{store.root}/control/data-of-a-dead-writer")
    store.files.write(f"{store.root}/control/pointer-of-a-dead-writer", "data-of-a-dead-writer")
    key = store.write_generation(small, "c2", "f1")
    small.edges.write.parquet(f"{store.root}/edges/generation_key=99")
    done = store.repair()
    assert done["failed"] == 1 and done["orphans"] == 1 and store.state(key) == "failed" and store.active() == 1
    assert store.prune() == 1 and store.open_view().symbols.count() == 2
    assert store.files.names(f"{store.root}/edges") == ["_SUCCESS", "generation_key=1"] or store.files.names(f"{store.root}/edges") == ["generation_key=1"]


def test_dangling_edge_is_refused(spark, store, small):
    bad = replace(small, edges=small.edges.unionByName(spark.createDataFrame([("a", "nowhere", "calls", "exact", "")], small.edges.schema)))
    with pytest.raises(InvalidGeneration, match=r"edge-target a\|nowhere\|calls"):
        store.ensure(lambda: bad, "c1", "f1")
    assert store.active() is None and store.state(1) == "failed"
    with pytest.raises(StaleGeneration):
        store.activate(1, None)
    with pytest.raises(InvalidGeneration):
        store.write_generation(small, "c1", " ")


def test_activation_of_another_head(store, small):
    key = store.write_generation(small, "c1", "f1")
    store.validate(key)
    with pytest.raises(StaleGeneration):
        store.activate(key, None, observed_head="c2")
    store.activate(key, None, observed_head="c1")
    assert store.active() == key == store.max_key()


def test_compaction_health_and_recovery(store, small):
    store.ensure(lambda: replace(small, symbols=small.symbols.repartition(4)), "c1", "f1")
    before = sorted(map(tuple, store.open_view().symbols.collect()))
    assert store.compact() >= 0 and sorted(map(tuple, store.open_view().symbols.collect())) == before
    assert store.health().where("status <> 'ok'").count() == 0
    store.files.delete(f"{store.root}/nodes/generation_key=1")
    assert [r["check"] for r in store.health().where("status = 'error'").collect()] == ["nodes"]
    folder = store.recover()["quarantine"]
    assert store.active() is None and store.files.exists(f"{folder}/symbols/generation_key=1")
    assert store.ensure(lambda: small, "c1", "f1") == (1, "rebuild")


def test_rules_of_a_candidate(spark, small):
    assert rules(small) == []

    def more(name, row):
        df = getattr(small, name)
        return rules(replace(small, **{name: df.unionByName(spark.createDataFrame([row], df.schema))}))

    assert more("packages", ("", "x", "x", "../x", "x", 1)) == [("package-directory", ""), ("package-key-empty", "")]
    assert more("packages", ("p", "x", "x", "a/..", "x", 1)) == [("package-key", "p")]
    assert more("blobs", ("b2", "sha1", -1)) == [("blob-size", "b2")]
    assert more("files", ("g", "/etc/x", "none", "q")) == [("file-blob", "g"), ("file-escapes", "g"), ("file-package", "g")]
    assert more("files", ("g", "g.go", "", "")) == []
    assert more("symbols", ("s", "function", "p", "none", "", "", "", "", -1, 0, 1)) == [("symbol-file", "s"), ("symbol-lines", "s")]
    assert more("nodes", ("n", "", 1, "q", "q", "q", 1, -2)) == [("node-file", "n"), ("node-kind", "n"), ("node-lines", "n"), ("node-package", "n"), ("node-symbol", "n")]
    assert more("nodes", ("n", "x", 0, "q", "q", "q", 1, 2)) == []
    assert more("edges", ("a", "t", "calls", "sure", "q")) == [("edge-confidence", "a|t|calls"), ("edge-owner", "a|t|calls")]
    assert more("evidence", (1, "a", "t", "calls", "", -1, 1, "")) == [("evidence-edge", "a|t|calls"), ("evidence-lines", "a|t|calls")]
    assert more("dependencies", ("q", "external:package:x")) == [("dependency-source", "q|external:package:x")]
    assert more("dependencies", ("p", "external:x")) == [("dependency-target", "p|external:x")]
    assert more("tests", ("t", "none", "maybe")) == [("test-confidence", "t|none"), ("test-target", "t|none")]
    said = spark.createDataFrame([("error", "c", "m"), ("loud", "c", "m2"), ("info", "c", "m3")], "severity string, code string, message string")
    assert rules(small, said) == [("diagnostic", "c|m2"), ("diagnostic-error", "c|m")]


@pytest.mark.parametrize(("path", "out"), [("a/b", False), ("a/..", False), (".", False), ("..", True), ("a/../../b", True), ("/a", True), ("..a", False), ("", False), (None, False)])
def test_escapes(spark, path, out):
    assert one(spark, P.escapes(F.lit(path).cast("string"))) is out


@pytest.mark.parametrize(("name", "version"), [("001_initial.sql", 1), ("12_a_b.sql", 12), ("_a.sql", None), ("0_a.sql", None), ("-3_a.sql", None), ("x1_a.sql", None), ("3.a_b", None)])
def test_migration_version(spark, name, version):
    assert one(spark, T.migration_version(F.lit(name))) == version


def test_package_message(spark):
    assert one(spark, T.package_message(F.lit(" Cannot find module x\n"))) == "missing module dependency: Cannot find module x"
    assert one(spark, T.package_message(F.lit("syntax error "))) == "syntax error"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "r"
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True, text=True).stdout
    root.mkdir()
    git("init", "-q", "-b", "main")
    (root / "d").mkdir()
    (root / "d" / "big").write_bytes(b"\x00\xff\n" * 70_000)
    (root / "empty").write_bytes(b"")
    (root / "d" / "link").symlink_to("../empty")
    git("add", ".")
    git("commit", "-q", "-m", "m")
    git("remote", "add", "up", "https://host/x.git")
    git("remote", "add", "origin", "git@host:y.git")
    return root, git


def test_objects_round_trip(spark, tree):
    root, git = tree
    rows = [line.split(None, 3) for line in git("ls-tree", "-r", "HEAD").splitlines()]
    manifest = spark.createDataFrame([(p, oid, mode) for mode, _, oid, p in rows], "path string, blob_sha string, mode string")
    wanted = manifest.select(F.col("blob_sha").alias("oid")).union(spark.createDataFrame([("0" * 40,), (None,)], "oid string"))
    found = objects.read_objects(wanted.union(wanted), f"{root}/.git")
    assert {r["oid"]: r["type"] for r in found.collect()}["0" * 40] == "missing" and found.count() == 4
    files = {r["path"]: r for r in objects.snapshot(manifest, found).collect()}
    assert bytes(files["d/big"]["content"]) == (root / "d" / "big").read_bytes() and files["d/big"]["size"] == 210_000
    assert bytes(files["empty"]["content"]) == b"" and bytes(files["d/link"]["content"]) == b"../empty"
    for path, content, mode in (("d/l", b"../../x", "120000"), ("l", b"/etc", "120000")):
        made = spark.createDataFrame([("1", "blob", 1, bytearray(content))], objects.OBJECT)
        with pytest.raises(Exception, match="leaves the tree"):
            objects.snapshot(spark.createDataFrame([(path, "1", mode)], "path string, blob_sha string, mode string"), made).collect()
    with pytest.raises(Exception, match="no blob for"):
        objects.snapshot(spark.createDataFrame([("x", "9", "100644")], "path string, blob_sha string, mode string"), found).collect()


def test_discovery(tree, tmp_path):
    root, git = tree
    found = repository.discover(str(root / "d"))
    head = git("rev-parse", "HEAD").strip()
    assert (found.root, found.branch, found.head, found.remote) == (str(root), "main", head, ("origin", "git@host:y.git"))
    git("pack-refs", "--all")
    assert repository.discover(str(root)).head == head
    git("worktree", "add", "-q", "-b", "w", str(tmp_path / "w"))
    other = repository.discover(str(tmp_path / "w"))
    assert (other.branch, other.head, other.common_dir) == ("w", head, found.git_dir) and other.git_dir != found.git_dir
    git("checkout", "-q", "--detach")
    assert (repository.discover(str(root)).branch, repository.discover(str(root)).head) == ("", head)
    with pytest.raises(repository.NotARepository):
        repository.discover("/proc")


def test_guard_of_a_changing_tree(spark):
    made = lambda *rows: spark.createDataFrame(rows, "path string, present long, sha string")
    a, b = made(("x", 1, "1"), ("y", 0, "")), made(("x", 1, "2"), ("y", 0, ""))
    assert O.manifest_id(a) == O.manifest_id(made(("y", 0, ""), ("x", 1, "1"))) != O.manifest_id(b)
    tries = iter((a, b, b, b))
    assert O.guarded(lambda: next(tries), lambda e: O.manifest_id(e), lambda: "c", "c") == O.manifest_id(b)
    with pytest.raises(O.StaleSource, match="head"):
        O.guarded(lambda: a, lambda e: e, lambda: "other", "c")
    tries = iter((a, b, a, b))
    with pytest.raises(O.StaleSource, match="manifest"):
        O.guarded(lambda: next(tries), lambda e: e, lambda: "c", "c")
