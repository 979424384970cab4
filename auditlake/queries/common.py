"""Registration of a query with its SQL twin; output types that both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.plans.views import twin, view
from auditlake.sources.shared import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def edge(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates as text and all integers as long, as the results leave the library."""
    kinds = {T.DecimalType: "double", T.FloatType: "double", T.DateType: "string", T.TimestampType: "string", T.IntegerType: "long", T.ShortType: "long"}
    return df.select(*(F.col(f"`{f.name}`").cast(kinds[type(f.dataType)]).alias(f.name) if type(f.dataType) in kinds else F.col(f"`{f.name}`") for f in df.schema.fields))


class Tables:
    """The views of a data folder by attribute. Those named in `staged` are written out when they are first asked for, by
    other views too: a view that a query reads many times is made once, and Spark knows the size of a small one."""

    def __init__(self, spark: SparkSession, sf_dir: str, staged: tuple[str, ...] = ()):
        self.spark, self.sf_dir, self.staged = spark, sf_dir, staged

    def __getattr__(self, name: str) -> DataFrame:
        found = view(self.spark, self.sf_dir, name, lambda n: getattr(self, n))
        found = durable(found) if name in self.staged else found
        setattr(self, name, found)
        return found


def query(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, staged: tuple[str, ...] = ()) -> None:
    """Register build over the views, of which those named in `staged` are written out once, and its SQL."""
    QUERIES[name] = lambda spark, sf_dir: edge(build(Tables(spark, sf_dir, staged)))
    if sql:
        ORACLE_SQL[name] = twin(sql)
