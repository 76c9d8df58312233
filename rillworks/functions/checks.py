"""Checks made when a pipeline is built, so mistakes don't wait for a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def names(what: str, columns: Sequence[str]) -> tuple[str, ...]:
    """At least one column name, none blank, none twice."""
    columns = tuple(columns)
    if not columns:
        raise ValueError(f"{what} needs at least one column")
    for column in columns:
        if not isinstance(column, str) or not column.strip():
            raise ValueError(f"{what}: a column name must be a non-blank string, not {column!r}")
    if len(set(columns)) != len(columns):
        raise ValueError(f"{what}: a column is named twice in {list(columns)}")
    return columns


def present(what: str, df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what}: no column {missing} among {df.columns}")


def type_class(kind: T.DataType) -> str:
    """Keys of different classes never match: an integer isn't a boolean, nor a string."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "float"
    if isinstance(kind, T.NullType):
        return "null"
    return kind.typeName().split("(")[0]


def keys(what: str, df: DataFrame, columns: Sequence[str], strict: bool) -> None:
    """With `strict`, only the key types that a keyed exchange takes on any number of instances."""
    present(what, df, columns)
    for column in columns if strict else ():
        kind = df.schema[column].dataType
        if type_class(kind) not in ("boolean", "integer", "string", "binary", "null"):
            raise TypeError(f"{what}: {kind.simpleString()} column {column!r} can't be a key under strict_keys")
