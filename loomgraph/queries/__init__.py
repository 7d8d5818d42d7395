"""The engine's named queries over the projection, each beside the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.projection import RELATIONS, TABLES, Graph, oracle, tables
from loomgraph.queries.data import EXTRA
from loomgraph.storage import exists, ship, states, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Relations that take joins or aggregates over the fact tables: written when a query first needs them, like a generation of the store, and read from there.
KEPT = ("g_symbols", "g_edges", "g_evidence", "g_dependencies")
TEXTS = RELATIONS | EXTRA


class Inputs:
    """The relations of the projection and the further inputs of one folder, by name; each is made when first asked for, after those that its SQL names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        tables(spark, sf_dir)
        self.spark, self.tables = spark, {name: spark.table(name) for name in TABLES}
        self.made: dict[str, DataFrame] = {}
        self.paths: dict[str, str] = {}

    def activate(self) -> None:
        """Registers the folder's tables and what has been made of them as views; starts anew where a written relation is gone."""
        if not all(exists(self.spark, f"{path}/_SUCCESS") for path in self.paths.values()):
            self.made, self.paths = {}, {}
        for name, df in (self.tables | self.made).items():
            df.createOrReplaceTempView(name)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name not in self.made:
            for other in dict.fromkeys(re.findall(r"\b[gmx]_\w+", TEXTS[name])):
                if other in TEXTS:
                    self[other]
            df = self.spark.sql(TEXTS[name])
            if name in KEPT:
                self.paths[name], df = written(df, name)
            df.createOrReplaceTempView(name)
            self.made[name] = df
        return self.made[name]


class Written:
    """The projection as a graph whose relations are made when first asked for."""

    written = True

    def __init__(self, inputs: Inputs):
        self._inputs = inputs

    @property
    def spark(self) -> SparkSession:
        return self._inputs.spark

    def __getattr__(self, name: str) -> DataFrame:
        if f"g_{name}" not in RELATIONS:
            raise AttributeError(name)
        return self._inputs[f"g_{name}"]


_known: dict[tuple, Inputs] = {}


def extra(spark: SparkSession, sf_dir: str) -> tuple[Graph | Written, Inputs]:
    """The graph and the inputs. What has been made is kept for the next query of the same session on the same files."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, *states(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES]))
    if key not in _known:
        ship(spark)
        for old in [k for k in _known if k[0] != key[0] or k[2] == sf_dir]:  # of a session that has ended, or files that have changed
            del _known[old]
        _known[key] = Inputs(spark, sf_dir)
    inputs = _known[key]
    inputs.activate()
    return Written(inputs), inputs


def query(sql: str | None = None, **more: str):
    """Registers a function of (graph, table) under its name; ``table(name)`` reads an input. more: further named texts of the SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            g, inputs = extra(spark, sf_dir)
            return f(g, inputs.__getitem__)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql.strip(), *EXTRA.items(), *more.items())
        return f

    return register
