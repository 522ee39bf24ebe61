"""Filter expressions in the document-store style, compiled to columns, and the reads built on them."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compile_filter(query: dict[str, Any] | None) -> Column:
    """Implicit AND of fields; ``$eq``, ``$in``, ``$or``, ``$and``; an empty query matches all; anything else is a ValueError."""
    if not query:
        return F.lit(True)
    parts = []
    for key, value in query.items():
        if key in ("$or", "$and"):
            if not isinstance(value, (list, tuple)) or not value:
                raise ValueError(f"{key} takes a list of queries")
            parts.append(reduce(or_ if key == "$or" else and_, map(compile_filter, value)))
        elif key.startswith("$"):
            raise ValueError(f"unsupported operator {key}")
        elif isinstance(value, dict):
            parts += [_condition(key, operator, operand) for operator, operand in value.items()]
        else:
            parts.append(_condition(key, "$eq", value))
    return reduce(and_, parts)


def _condition(field: str, operator: str, operand: Any) -> Column:
    if operator == "$eq":
        return F.col(field).isNull() if operand is None else F.coalesce(F.col(field) == F.lit(operand), F.lit(False))
    if operator == "$in":
        present = [v for v in operand if v is not None]
        found = F.coalesce(F.col(field).isin(present), F.lit(False)) if present else F.lit(False)
        return found | F.col(field).isNull() if len(present) < len(operand) else found
    raise ValueError(f"unsupported operator {operator}")


def project(df: DataFrame, projection: dict[str, int] | None) -> DataFrame:
    """Keep the fields marked 1 that exist; without any, drop those marked 0."""
    if not projection:
        return df
    wanted = [f for f, on in projection.items() if on and f in df.columns]
    return df.select(*wanted) if any(projection.values()) else df.drop(*projection)


def match_documents(df: DataFrame, query: dict[str, Any] | None = None, projection: dict[str, int] | None = None) -> DataFrame:
    return project(df.where(compile_filter(query)), projection)


def find_one(df: DataFrame, query: dict[str, Any] | None, order: list[str], projection: dict[str, int] | None = None) -> DataFrame:
    """The first match in the given order: at most one row."""
    return project(df.where(compile_filter(query)).orderBy(*order).limit(1), projection)


def count_documents(df: DataFrame, query: dict[str, Any] | None = None) -> DataFrame:
    return df.where(compile_filter(query)).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    """Distinct non-null values; whole numbers come before other texts."""
    number = F.expr(f"try_cast(`{field}` AS bigint)")
    return df.where(F.col(field).isNotNull()).select(field).distinct().orderBy(number.isNull(), number, F.col(field).cast("string"))
