"""Declarative conditions on metric columns."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructType

from tickspark.errors import ConfigError
from tickspark.operators.validate import finite

OPERATORS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


@dataclass(frozen=True)
class Predicate:
    """metric OP value, or metric OP other_metric; use_abs takes the left side's absolute value."""

    metric: str
    operator: str
    value: float | None = None
    other_metric: str | None = None
    use_abs: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.metric, str) or not self.metric:
            raise ConfigError("a predicate's 'metric' must be a non-empty string")
        if self.operator not in OPERATORS:
            raise ConfigError(f"unknown operator '{self.operator}'; known: {sorted(OPERATORS)}")
        if (self.value is None) == (self.other_metric is None):
            raise ConfigError("a predicate needs exactly one of 'value' and 'other_metric'")
        if self.value is not None:
            try:
                object.__setattr__(self, "value", float(self.value))
            except (TypeError, ValueError) as wrong:
                raise ConfigError(f"a predicate's 'value' must be numeric: {self.value!r}") from wrong


def distinct(predicates: Sequence[Predicate], where: str) -> tuple[Predicate, ...]:
    """The predicates; a repeated one is an error."""
    if len(set(predicates)) != len(predicates):
        raise ConfigError(f"{where} repeats a predicate")
    return tuple(predicates)


def number(name: str, schema: StructType) -> Column:
    """The column as DOUBLE where it is a number or parses as one; else null."""
    field = next((f for f in schema.fields if f.name == name), None)
    if field is None or isinstance(field.dataType, BooleanType):
        return F.lit(None).cast("double")
    if isinstance(field.dataType, StringType):
        return F.expr(f"try_cast(`{name}` AS DOUBLE)")
    return F.col(f"`{name}`").cast("double") if isinstance(field.dataType, NumericType) else F.lit(None).cast("double")


def holds(predicate: Predicate, schema: StructType) -> Column:
    """Boolean, never null: false whenever a side is missing or not finite, whatever the operator."""
    left = number(predicate.metric, schema)
    right = F.lit(predicate.value) if predicate.other_metric is None else number(predicate.other_metric, schema)
    compared = OPERATORS[predicate.operator](F.abs(left) if predicate.use_abs else left, right)
    return F.coalesce(finite(left) & finite(right) & compared, F.lit(False))


def all_hold(predicates: Iterable[Predicate], schema: StructType) -> Column:
    """Conjunction; of no predicates it is true."""
    return reduce(operator.and_, (holds(p, schema) for p in predicates), F.lit(True))
