"""Row-wise verbs: select, drop, rename, with_column, filter, tokenize, explode."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.functions import checks
from rillworks.functions.exprs import tokens


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def select(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    checks.present("select", df, checks.names("select", columns))
    return df.select(*map(quoted, columns))


def drop(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    checks.present("drop", df, checks.names("drop", columns))
    return df.select(*[quoted(c) for c in df.columns if c not in columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    checks.present("rename", df, checks.names("rename", tuple(mapping)))
    new = [mapping.get(c, c) for c in df.columns]
    if any(not isinstance(c, str) or not c.strip() for c in new) or len(set(new)) != len(new):
        raise ValueError(f"rename: the result would have the columns {new}")
    return df.select(*[quoted(old).alias(name) for old, name in zip(df.columns, new)])


def with_column(df: DataFrame, name: str, value: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Add a column at the end, or replace it where it stands."""
    checks.names("with_column", (name,))
    return df.withColumn(name, value if isinstance(value, Column) else value(df))


def keep(df: DataFrame, mask: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Rows whose mask is true; a null mask drops the row."""
    return df.where(mask if isinstance(mask, Column) else mask(df))


def tokenize(df: DataFrame, column: str, out: str = "word", lowercase: bool = True) -> DataFrame:
    """One row per word; only the word column is left."""
    checks.present("tokenize", df, (column,))
    checks.names("tokenize", (out,))
    if not isinstance(df.schema[column].dataType, (T.StringType, T.NullType)):
        raise TypeError(f"tokenize: {column!r} is {df.schema[column].dataType.simpleString()}, not a string")
    return df.select(F.explode(tokens(quoted(column), lowercase)).alias(out))


def explode(df: DataFrame, column: str) -> DataFrame:
    """One row per element, in the list's place; null and empty lists drop, null elements stay."""
    checks.present("explode", df, (column,))
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        raise TypeError(f"explode: {column!r} is {df.schema[column].dataType.simpleString()}, not a list")
    return df.select(*[F.explode(quoted(c)).alias(c) if c == column else quoted(c) for c in df.columns])


def union(df: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all inputs; names and types must agree, in order (metadata and nullability need not)."""
    shape = [(f.name, _bare(f.dataType)) for f in df.schema]
    for other in others:
        if (theirs := [(f.name, _bare(f.dataType)) for f in other.schema]) != shape:
            raise TypeError(f"union: schemas differ: {df.schema.simpleString()} and {other.schema.simpleString()}: {theirs}")
        df = df.union(other)
    return df


def _bare(kind: T.DataType) -> str:
    return kind.simpleString()
