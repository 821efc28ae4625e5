"""Tables that change: rows in and out, columns, constraints, and sessions with snapshots.

Frames are immutable, so a change makes a new frame and a snapshot is the mapping of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_rows(df: DataFrame, rows: list[tuple], columns: list[str] | None = None) -> DataFrame:
    """``df`` and ``rows``; columns that are not named become null."""
    names = columns or df.columns
    types = [df.schema[c].dataType.simpleString() for c in names]
    new = df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in zip(names, types, strict=True)))
    return df.unionByName(new, allowMissingColumns=True)


def insert_default(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """``df`` and one row of defaults, null where there is none."""
    own = defaults or {}
    row = [F.lit(own.get(c)).cast(t).alias(c) for c, t in df.dtypes]
    return df.unionByName(df.sparkSession.range(1).select(*row))


def upsert(df: DataFrame, new: DataFrame, key: list[str], replace: bool = True, order: str | None = None) -> DataFrame:
    """``df`` and ``new``; for a key of both, ``new`` replaces the row or is ignored. Of new rows with one key, the
    last in ``order`` replaces the others, and the first is the one that is not ignored; without ``order``, the
    rows' own order by their columns counts."""
    by = F.struct(order) if order else F.struct(*new.columns)
    pick = F.max_by if replace else F.min_by
    own = new.groupBy(*key).agg(pick(F.struct(*[c for c in df.columns]), by).alias("_r")).select("_r.*")
    if replace:
        return df.join(own, key, "left_anti").select(*df.columns).unionByName(own)
    return df.unionByName(own.join(df, key, "left_anti").select(*df.columns))


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """``df`` without the rows for which the condition holds; where it is null, a row stays."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def merge(df: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` where it has the key, nulls and all, else those of ``df``."""
    rest = [c for c in df.columns if c not in key]
    both = df.alias("a").join(new.withColumn("_new", F.lit(True)).alias("b"), key, "full")
    return both.select(*key, *[F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in rest])


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(kind))


def not_checked(df: DataFrame, check: Column) -> DataFrame:
    """Rows that break a CHECK: the condition is false; null passes."""
    return df.filter(~check)


def not_unique(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def without_parent(df: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose foreign key is set and not in the parent."""
    return df.filter(F.col(column).isNotNull()).join(parent, df[column] == parent[key], "left_anti")


class Session:
    """Named frames with BEGIN, SAVEPOINT, ROLLBACK and COMMIT; ``sql`` reads the present ones."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}
        self._marks: list[tuple[str | None, dict]] = []

    def create(self, name: str, schema: str, if_not_exists: bool = False) -> None:
        if name in self.tables:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        self.tables[name] = self.spark.createDataFrame([], schema)

    def put(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self.tables and not if_exists:
            raise KeyError(name)
        self.tables.pop(name, None)

    def begin(self) -> None:
        if self._marks:
            raise ValueError("a transaction is open")
        self._marks.append((None, dict(self.tables)))

    def savepoint(self, name: str) -> None:
        self._marks.append((name, dict(self.tables)))

    def _find(self, name: str) -> int:
        for k in range(len(self._marks) - 1, -1, -1):
            if self._marks[k][0] == name:
                return k
        raise KeyError(name)

    def release(self, name: str) -> None:
        del self._marks[self._find(name) :]

    def rollback(self, to: str | None = None) -> None:
        """Back to the savepoint, which stays, or to the beginning of the transaction."""
        if not self._marks:
            raise ValueError("no transaction is open")
        k = 0 if to is None else self._find(to)
        self.tables = dict(self._marks[k][1])
        del self._marks[k + (to is not None) :]

    def commit(self) -> None:
        self._marks.clear()

    def sql(self, text: str) -> DataFrame:
        """Run a query in which tables stand in braces."""
        return self.spark.sql(text, **self.tables)
