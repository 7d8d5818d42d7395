"""The graph that the engine's queries run on: a projection of the star-schema tables, one portable SQL text for each relation.

Spark registers them as views on each other; another SQL engine can put them before a query as common table expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

#: Relation -> SQL, in order of dependence. Integers are BIGINT, flags 0 or 1, the empty string means missing.
RELATIONS = {
    "g_packages": """
SELECT concat('go:package:', r_name, '/', n_name) AS key, concat(r_name, '/', n_name) AS import_path, r_name AS module_path,
       lower(n_name) AS directory, n_name AS name, CAST(n_nationkey AS BIGINT) AS nk
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "g_files": """
SELECT concat('file:customer/', CAST(c_custkey AS STRING)) AS key,
       concat('customer/', lower(c_mktsegment), '/', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 10 = 3 THEN '_test.go' ELSE '.go' END) AS path,
       md5(concat('c', CAST(c_custkey AS STRING))) AS blob_sha, p.key AS package_key
FROM customer JOIN g_packages p ON c_nationkey = p.nk
UNION ALL
SELECT concat('file:supplier/', CAST(s_suppkey AS STRING)), concat('supplier/', CAST(s_suppkey AS STRING), '.go'),
       md5(concat('s', CAST(s_suppkey AS STRING))), p.key
FROM supplier JOIN g_packages p ON s_nationkey = p.nk""",
    "g_owners": """
SELECT l_partkey AS partkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY l_partkey""",
    "g_symbols": """
SELECT concat('symbol:part/', CAST(p_partkey AS STRING)) AS key,
       CASE WHEN p_type LIKE 'PROMO%' THEN 'interface' WHEN p_type LIKE 'SMALL%' THEN 'struct' WHEN p_type LIKE 'MEDIUM%' THEN 'type'
            WHEN p_type LIKE 'ECONOMY%' THEN 'method' ELSE 'function' END AS kind,
       f.package_key AS package_key, f.key AS file_key, replace(p_name, ' ', '_') AS name, concat('func(', p_brand, ') ', p_type) AS signature,
       CASE WHEN p_type LIKE 'ECONOMY%' THEN p_brand ELSE '' END AS receiver, f.path AS path,
       CAST(p_size AS BIGINT) AS start_line, CAST(p_size + 5 AS BIGINT) AS end_line, CAST(p_size % 2 AS BIGINT) AS exported
FROM part JOIN g_owners o ON p_partkey = o.partkey JOIN g_files f ON f.key = concat('file:supplier/', CAST(o.suppkey AS STRING))
UNION ALL
SELECT concat('symbol:order/', CAST(o_orderkey AS STRING)), CASE o_orderstatus WHEN 'P' THEN 'test' WHEN 'F' THEN 'function' ELSE 'method' END,
       f.package_key, f.key, concat(CASE o_orderstatus WHEN 'P' THEN 'TestOrder' ELSE 'order' END, CAST(o_orderkey % 1000 AS STRING)),
       concat('func(', o_orderpriority, ')'), CASE o_orderstatus WHEN 'O' THEN 'Order' ELSE '' END, f.path,
       CAST(o_orderkey % 500 + 1 AS BIGINT), CAST(o_orderkey % 500 + 7 AS BIGINT), CAST(o_orderkey % 3 AS BIGINT) % 2
FROM orders JOIN g_files f ON f.key = concat('file:customer/', CAST(o_custkey AS STRING))""",
    "g_nodes": """
SELECT key, kind, CAST(1 AS BIGINT) AS owned, package_key, file_key, key AS symbol_key, start_line AS source_start, end_line AS source_end FROM g_symbols
UNION ALL
SELECT key, 'file', CAST(1 AS BIGINT), package_key, key, '', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM g_files
UNION ALL
SELECT concat('package:', key), 'package', CAST(1 AS BIGINT), key, '', '', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM g_packages
UNION ALL
SELECT DISTINCT concat('external:symbol:', p_brand, ':Do'), 'symbol', CAST(0 AS BIGINT), '', '', '', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM part WHERE p_size > 45""",
    "g_lines": """
SELECT concat('symbol:order/', CAST(l_orderkey AS STRING)) AS source_key,
       CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'O' THEN concat('unresolved:call:', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING))
            ELSE concat('symbol:part/', CAST(l_partkey AS STRING)) END AS target_key,
       CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'O' THEN 'unresolved_call' WHEN l_returnflag = 'R' THEN 'possible_call'
            WHEN l_returnflag = 'A' THEN 'references' WHEN o_orderstatus = 'P' THEN 'tests' ELSE 'calls' END AS kind,
       CASE WHEN l_returnflag = 'R' THEN 'possible' WHEN l_returnflag = 'N' AND o_orderstatus = 'P' THEN 'inferred' ELSE 'exact' END AS confidence,
       o_custkey AS custkey, CAST(l_orderkey * 1000 AS BIGINT) + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS evidence_id,
       CAST(l_linenumber AS BIGINT) AS start_line, CAST(l_linenumber AS BIGINT) + CAST(l_quantity AS BIGINT) AS end_line, l_linestatus AS details
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "g_edges": """
SELECT concat('symbol:order/', CAST(d.orderkey AS STRING)) AS source_key,
       CASE WHEN d.kind = 'unresolved_call' THEN concat('unresolved:call:', CAST(d.orderkey AS STRING), ':', CAST(d.place AS STRING))
            ELSE concat('symbol:part/', CAST(d.place AS STRING)) END AS target_key, d.kind, d.confidence, p.key AS owner_package
FROM (SELECT DISTINCT l_orderkey AS orderkey, CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'O' THEN CAST(l_linenumber AS BIGINT) ELSE CAST(l_partkey AS BIGINT) END AS place,
             CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'O' THEN 'unresolved_call' WHEN l_returnflag = 'R' THEN 'possible_call'
                  WHEN l_returnflag = 'A' THEN 'references' WHEN o_orderstatus = 'P' THEN 'tests' ELSE 'calls' END AS kind,
             CASE WHEN l_returnflag = 'R' THEN 'possible' WHEN l_returnflag = 'N' AND o_orderstatus = 'P' THEN 'inferred' ELSE 'exact' END AS confidence, c_nationkey AS nk
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) d
JOIN g_packages p ON d.nk = p.nk
UNION ALL
SELECT concat('symbol:part/', CAST(a.p_partkey AS STRING)), concat('symbol:part/', CAST(b.p_partkey AS STRING)), 'implements', 'exact', ''
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name WHERE a.p_type NOT LIKE 'PROMO%' AND b.p_type LIKE 'PROMO%'
UNION ALL
SELECT concat('symbol:part/', CAST(p_partkey AS STRING)), concat('external:symbol:', p_brand, ':Do'), 'calls', 'exact', '' FROM part WHERE p_size > 45
UNION ALL
SELECT concat('package:', package_key), key, 'contains', 'exact', package_key FROM g_files
UNION ALL
SELECT file_key, key, 'defines', 'exact', package_key FROM g_symbols
UNION ALL
SELECT concat('package:', source_package), concat('package:', target_package), 'imports', 'exact', source_package FROM g_dependencies""",
    "g_evidence": """
SELECT evidence_id, source_key, target_key, kind, 'lines' AS analyzer_source, start_line, end_line, details FROM g_lines""",
    "g_dependencies": """
SELECT DISTINCT a.key AS source_package, b.key AS target_package
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN g_packages a ON a.nk = c_nationkey JOIN g_packages b ON b.nk = s_nationkey
WHERE c_nationkey <> s_nationkey
UNION ALL
SELECT DISTINCT a.key, concat('external:package:', p_brand)
FROM part JOIN g_owners o ON p_partkey = o.partkey JOIN supplier ON s_suppkey = o.suppkey JOIN g_packages a ON a.nk = s_nationkey WHERE p_size > 45""",
    "g_tests": """
SELECT source_key AS test_key, target_key, max(confidence) AS confidence FROM g_edges WHERE kind = 'tests' GROUP BY source_key, target_key""",
    "g_blobs": """
SELECT blob_sha AS sha, 'sha1' AS object_format, CAST(length(path) * 100 AS BIGINT) AS byte_size FROM g_files WHERE path NOT LIKE '%7.go'""",
}
ORDER = ("g_packages", "g_files", "g_owners", "g_symbols", "g_nodes", "g_lines", "g_dependencies", "g_edges", "g_evidence", "g_tests", "g_blobs")


@dataclass(frozen=True)
class Graph:
    """The relations of one generation. Every operator takes this and nothing else of the store."""

    #: Whether relations are tables, so that reading one again costs no joins.
    written: ClassVar[bool] = False

    packages: DataFrame
    files: DataFrame
    symbols: DataFrame
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    dependencies: DataFrame
    tests: DataFrame
    blobs: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.symbols.sparkSession


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers the named input tables (all by default) as temporary views."""
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The projection of the tables in ``sf_dir``. Lazy: a query reads the columns and tables that it needs."""
    tables(spark, sf_dir)
    for name in ORDER:
        spark.sql(RELATIONS[name]).createOrReplaceTempView(name)
    return Graph(*(spark.table(f"g_{f.name}") for f in fields(Graph)))


def whole(g) -> Graph:
    """A graph of any kind with all its relations named."""
    return Graph(*(getattr(g, f.name) for f in fields(Graph)))


def oracle(sql: str, *more: tuple[str, str]) -> str:
    """``sql`` with the projection, and further named texts, before it."""
    parts = [(name, RELATIONS[name]) for name in ORDER] + list(more)
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in parts) + "\n" + sql
