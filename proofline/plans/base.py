"""Registry of named queries: a Spark form, and where SQL can say the same, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Derived:
    """An input table derived from the given ones by SQL that both engines read alike; ``{name}`` is a table."""

    def __init__(self, sql: str, **parts: "Derived"):
        self.template = sql
        self.parts = parts

    def _render(self, names: dict[str, str], inner) -> str:
        return self.template.format_map({**names, **{k: f"({inner(v)})" for k, v in self.parts.items()}})

    @property
    def sql(self) -> str:
        return self._render({n: n for n in TABLES}, lambda d: d.sql)

    def text(self, sf_dir: str) -> str:
        return self._render({n: f"parquet.`{sf_dir}/{n}.parquet`" for n in TABLES}, lambda d: d.text(sf_dir))

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(self.text(sf_dir))


def query(name: str, sql: str | None = None, **derived: Derived):
    """Register a query; derived inputs become CTEs of its SQL."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ctes = ", ".join(f"{n} as ({d.sql})" for n, d in derived.items())
            body = sql.strip()
            if ctes and body.lower().startswith("with recursive "):
                body = f"with recursive {ctes}, {body[len('with recursive '):]}"
            elif ctes and body.lower().startswith("with "):
                body = f"with {ctes}, {body[len('with '):]}"
            elif ctes:
                body = f"with {ctes} {body}"
            ORACLES[name] = body
        return fn
    return register
