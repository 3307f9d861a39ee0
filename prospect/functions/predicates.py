"""Attributes, predicates over them, and how attributes become predicates.

A predicate is a boolean Column that is never null: a missing or NaN value
satisfies no range and no category, and its negation does.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from enum import Enum, Flag, auto

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .discretise import Discretiser, Frequency, Interval


class Kind(Enum):
    BOOLEAN = "boolean"
    CATEGORICAL = "categorical"
    NUMERICAL = "numerical"
    INDEX = "index"
    NAME = "name"


class Negate(Flag):
    NONE = 0
    BOOLEAN = auto()
    CATEGORICAL = auto()
    RANGED = auto()
    ALL = BOOLEAN | CATEGORICAL | RANGED

    @classmethod
    def parse(cls, text: str) -> Negate:
        """``"BOOLEAN|RANGED"``."""
        out = cls.NONE
        for part in filter(None, (x.strip().upper() for x in text.split("|"))):
            out |= cls[part]
        return out


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: Kind
    selected: bool = True
    position: int = 0


def kind_of(kind: T.DataType) -> Kind:
    """The kind that a column's type implies; types that need a derivation first are refused."""
    if isinstance(kind, T.BooleanType):
        return Kind.BOOLEAN
    if isinstance(kind, T.StringType):
        return Kind.CATEGORICAL
    if isinstance(kind, T.NumericType):
        return Kind.NUMERICAL
    raise TypeError(f"no kind of attribute for {kind.simpleString()}: derive a number or a category first")


def attributes(df: DataFrame, kinds: dict[str | None, Kind | str] | None = None, exclude: Iterable[str] = ()) -> list[Attribute]:
    """Attributes of a frame in column order; ``kinds`` overrides by name (None: the default)."""
    kinds = {k: Kind(v) if isinstance(v, str) else v for k, v in (kinds or {}).items()}
    exclude = set(exclude)
    out = []
    for i, f in enumerate(df.schema.fields):
        if f.name in exclude:
            continue
        kind = kinds.get(f.name) or kinds.get(None) or kind_of(f.dataType)
        out.append(Attribute(f.name, kind, kind not in (Kind.INDEX, Kind.NAME), i))
    return out


@dataclass(frozen=True)
class Predicate:
    attribute: Attribute
    negated: bool = False

    def raw(self) -> Column:
        raise NotImplementedError

    def column(self) -> Column:
        held = F.coalesce(self.raw(), F.lit(False))
        return ~held if self.negated else held

    def negate(self) -> Predicate:
        return replace(self, negated=not self.negated)

    def sort_key(self) -> tuple:
        raise NotImplementedError


def _name(text: str) -> str:
    return text if re.fullmatch(r"\w+", text) else '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


@dataclass(frozen=True)
class Truth(Predicate):
    def raw(self) -> Column:
        return F.col(self.attribute.name).cast("boolean")

    def sort_key(self) -> tuple:
        return (self.attribute.position, self.negated)

    def __str__(self) -> str:
        return ("!" if self.negated else "") + _name(self.attribute.name)


@dataclass(frozen=True)
class Equals(Predicate):
    category: str | None = None

    def raw(self) -> Column:
        return F.col(self.attribute.name) == F.lit(self.category)

    def sort_key(self) -> tuple:
        return (self.attribute.position, self.category is None, str(self.category), self.negated)

    def __str__(self) -> str:
        value = "<NA>" if self.category is None else _name(str(self.category))
        return f"[{_name(self.attribute.name)}{'!=' if self.negated else '='}{value}]"


@dataclass(frozen=True)
class Ranged(Predicate):
    interval: Interval = field(default_factory=Interval)

    def raw(self) -> Column:
        c, i = F.col(self.attribute.name).cast("double"), self.interval
        out = c.isNotNull() & ~F.isnan(c)
        if i.lower is not None:
            out &= (c >= i.lower) if i.closed_below else (c > i.lower)
        if i.upper is not None:
            out &= (c <= i.upper) if i.closed_above else (c < i.upper)
        return out

    def sort_key(self) -> tuple:
        i, far = self.interval, float("inf")
        return (self.attribute.position, -far if i.lower is None else i.lower, far if i.upper is None else i.upper, self.negated)

    def __str__(self) -> str:
        return f"[{_name(self.attribute.name)} {'not' if self.negated else 'is'} {self.interval.name}]"

    def verbose(self) -> str:
        i = self.interval
        low = "" if i.lower is None else f"{i.lower:g}{'<=' if i.closed_below else '<'}"
        high = "" if i.upper is None else f"{'<=' if i.closed_above else '<'}{i.upper:g}"
        return f"{'!' if self.negated else ''}[{low}{self.attribute.name}{high}]"


@dataclass(frozen=True)
class Prediciser:
    """Predicates of attributes: truth, equality with each category, ranges of the cuts.

    Two categories are each other's complement and get no negations.
    """

    discretiser: Discretiser = field(default_factory=lambda: Frequency(5))
    negate: Negate = Negate.ALL

    def predicates(self, df: DataFrame, of: list[Attribute]) -> list[Predicate]:
        """Sorted predicates. One job for all categories, one for all cuts."""
        of = [a for a in of if a.selected]
        categorical = [a for a in of if a.kind is Kind.CATEGORICAL]
        found = df.agg(*(F.array_sort(F.collect_set(a.name)).alias(a.name) for a in categorical)).first() if categorical else {}
        cuts = self.discretiser.cuts(df, [a.name for a in of if a.kind is Kind.NUMERICAL])
        out: list[Predicate] = []
        for a in of:
            if a.kind is Kind.BOOLEAN:
                out += self._both([Truth(a)], Negate.BOOLEAN)
            elif a.kind is Kind.CATEGORICAL:
                values = found[a.name]
                out += self._both([Equals(a, category=v) for v in values], Negate.CATEGORICAL if len(values) != 2 else Negate.NONE)
            elif a.kind is Kind.NUMERICAL:
                out += self._both([Ranged(a, interval=i) for i in self.discretiser.intervals(cuts[a.name])], Negate.RANGED)
        return sorted(out, key=lambda p: p.sort_key())

    def _both(self, found: list[Predicate], flag: Negate) -> list[Predicate]:
        return found + ([p.negate() for p in found] if flag and flag in self.negate else [])
