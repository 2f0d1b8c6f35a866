"""Functors by name, as Spark column expressions.

A functor of a program is looked up here by name.  Built-in families cover every
numeric type through a suffix (``add_i32``, ``sum_i64``, ``max_f64``); others are
registered by the host.  Integer arithmetic wraps in its declared width and division by
zero gives no row, whatever Spark's ANSI mode says.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark types of the built-in types; unsigned ones take the next wider signed type.
SPARK_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType()}
#: Foreign types that need no registration.
FOREIGN_TYPES: dict[str, T.DataType] = {
    "str": T.StringType(), "string": T.StringType(), "bytes": T.BinaryType(), "ts": T.TimestampNTZType(), "date": T.DateType(),
    "vec_f32": T.ArrayType(T.FloatType()), "vec_str": T.ArrayType(T.StringType())}
#: Code of a foreign declaration -> its type; other code needs an entry in ``foreign``.
FOREIGN_CODE: dict[str, T.DataType] = {
    "std::string": T.StringType(), "std::string_view": T.StringType(), "const char *": T.StringType(), "str": T.StringType(), "bytes": T.BinaryType(),
    "int": T.IntegerType(), "int32_t": T.IntegerType(), "int64_t": T.LongType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType()}
_BITS = {"i8": 8, "i16": 16, "i32": 32, "i64": 64, "u8": 8, "u16": 16, "u32": 32, "u64": 64}


@dataclass(frozen=True)
class Functor:
    """``make`` gives a Column: a boolean for filters, a value (or struct for several
    free parameters) for one-to-one, a value or null for zero-or-one, an array for
    zero-or-more; an aggregate expression for aggregates and merges."""

    name: str
    make: Callable[..., Column]


def wrap(value: Column, kind: str) -> Column:
    """``value`` brought into the range of ``kind`` by two's complement; floats stay."""
    if kind not in _BITS:
        return value.cast(SPARK_TYPES[kind]) if kind in SPARK_TYPES else value
    bits, half = _BITS[kind], 1 << (_BITS[kind] - 1)
    if kind == "u64":  # held in a long
        bits, half = 63, 0
    shift = 0 if kind[0] == "u" else half
    wide = T.DecimalType(38, 0)
    lit = lambda n: F.lit(str(n)).cast(wide) if bits > 32 else F.lit(n).cast("long")
    value = value.cast(wide) if bits > 32 else value.cast("long")
    return (F.pmod(value + lit(shift), lit(1 << bits)) - lit(shift)).cast(SPARK_TYPES[kind])


def _wide(kind: str) -> str | T.DataType:
    return "double" if kind[0] == "f" else T.DecimalType(38, 0) if _BITS[kind] > 32 else "long"


def _arithmetic(op: str, kind: str) -> Callable[..., Column]:
    def make(a: Column, b: Column) -> Column:
        x, y = a.cast(_wide(kind)), b.cast(_wide(kind))
        if op in ("div", "mod"):
            safe = F.when(y != 0, y)  # null where there is no result
            if op == "mod":
                return wrap(x % safe, kind)
            return wrap(x / safe, kind) if kind[0] == "f" else wrap(_truncated(x, safe, kind), kind)
        if kind == "i64" and op in ("add", "sub", "mul"):  # decimals only where a long overflows
            a, b = a.cast("long"), b.cast("long")
            plain = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[op](a, b)
            return F.when(plain.isNotNull(), plain).otherwise(wrap({"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y}[op](), kind))
        return wrap({"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "min": lambda: F.least(x, y), "max": lambda: F.greatest(x, y)}[op](), kind)

    return make


def _truncated(x: Column, y: Column, kind: str) -> Column:
    """Quotient cut toward zero, exactly: from the remainder, not by rounding."""
    return ((x - x % y) / y).cast(_wide(kind))


def _aggregate(op: str, kind: str) -> Callable[..., Column]:
    total = lambda v: wrap(F.sum(v.cast(_wide(kind))), kind)
    return {
        "sum": total, "count": lambda v: F.count(v) if kind in ("i64", "u64") else wrap(F.count(v), kind), "min": lambda v: F.min(v).cast(SPARK_TYPES[kind]), "max": lambda v: F.max(v).cast(SPARK_TYPES[kind]),
        "avg": lambda v: F.avg(v).cast(SPARK_TYPES[kind]),
        "sum_above": lambda t, v: wrap(F.sum(F.when(v > t, v).otherwise(0).cast(_wide(kind))), kind),
        "max_above": lambda t, v: F.coalesce(F.max(F.when(v > t, v)), F.lit(0)).cast(SPARK_TYPES[kind]),
        "count_above": lambda t, v: wrap(F.count(F.when(v > t, v)), kind)}[op]


def wrapped(value: int | float | None, kind: str):
    """``wrap`` for one value on the driver."""
    if value is None or kind not in _BITS:
        return value
    bits, low = (63, 0) if kind == "u64" else (_BITS[kind], 0 if kind[0] == "u" else 1 << (_BITS[kind] - 1))
    return (value + low) % (1 << bits) - low


def _quotient(a, b, kind: str):
    if b == 0:
        return None
    if kind[0] == "f":
        return a / b
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


#: The same functions on the driver, for small strata.
_LOCAL_MAPS: dict[str, Callable] = {
    "add": lambda a, b, k: a + b, "sub": lambda a, b, k: a - b, "mul": lambda a, b, k: a * b, "min": lambda a, b, k: min(a, b), "max": lambda a, b, k: max(a, b),
    "div": _quotient, "mod": lambda a, b, k: None if b == 0 else a - b * _quotient(a, b, k) if k[0] != "f" else math.fmod(a, b)}
_LOCAL_AGGREGATES: dict[str, Callable] = {
    "sum": sum, "count": len, "min": min, "max": max,
    "sum_above": lambda t, v: sum(x for x in v if x > t), "count_above": lambda t, v: sum(x > t for x in v), "max_above": lambda t, v: max((x for x in v if x > t), default=0)}
_MAPS = ("add", "sub", "mul", "div", "mod", "min", "max")
_AGGREGATES = ("sum_above", "max_above", "count_above", "sum", "count", "min", "max", "avg")


class Registry:
    """Functors a program may use.  Merges of mutable columns get (value, order): the
    order in which live proposals were first seen."""

    def __init__(self) -> None:
        self.maps: dict[str, Functor] = {}
        self.replaced: set[str] = set()  # built-in names that the host took over
        self.aggregates: dict[str, Functor] = {}
        self.merges: dict[str, Functor] = {}
        self.foreign: dict[str, T.DataType] = dict(FOREIGN_TYPES)
        for name, make in {
            "is_even": lambda x: x % 2 == 0, "is_odd": lambda x: x % 2 != 0, "is_empty": lambda s: F.length(s) == 0,
            "length": lambda s: F.length(s), "lower": F.lower, "upper": F.upper, "trim": F.trim, "reverse": F.reverse,
            "concat": lambda a, b: F.concat(a, b), "starts_with": lambda s, p: F.startswith(s, p), "contains": lambda s, p: F.contains(s, p),
            "words": lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != ""), "lines": lambda s: F.split(s, "\n"),
            "first_char": lambda s: F.when(F.length(s) > 0, F.substring(s, 1, 1)), "year": F.year, "month": F.month, "day": F.day,
            "element": lambda xs: xs, "hash": lambda x: F.xxhash64(x), "to_i64": lambda x: x.try_cast("long"), "to_f64": lambda x: x.try_cast("double"),
            "abs": F.abs, "sqrt": F.sqrt, "floor": lambda x: F.floor(x), "round2": lambda x: F.round(x, 2),
        }.items():
            self.map(name, make)
        last = lambda v, order: F.max_by(v, order)
        self.merge("last", last)
        self.merge("first", lambda v, order: F.min_by(v, order))

    def map(self, name: str, make: Callable[..., Column]) -> Registry:
        if name in self.maps:
            self.replaced.add(name)
        self.maps[name] = Functor(name, make)
        return self

    def aggregate(self, name: str, make: Callable[..., Column]) -> Registry:
        self.aggregates[name] = Functor(name, make)
        return self

    def merge(self, name: str, make: Callable[[Column, Column], Column]) -> Registry:
        self.merges[name] = Functor(name, make)
        return self

    def type(self, name: str) -> T.DataType | None:
        return SPARK_TYPES.get(name) or self.foreign.get(name)

    def find_map(self, name: str) -> Functor | None:
        op, _, kind = name.rpartition("_")
        if name not in self.maps and op in _MAPS and kind in SPARK_TYPES:
            return Functor(name, _arithmetic(op, kind))
        return self.maps.get(name)

    def local_map(self, name: str) -> Callable | None:
        """A built-in functor for single values, None where it has no row; host functors have none."""
        op, _, kind = name.rpartition("_")
        if name in self.maps or op not in _LOCAL_MAPS or kind not in SPARK_TYPES:
            return {"is_even": lambda x: x % 2 == 0, "is_odd": lambda x: x % 2 != 0}.get(name) if name not in self.replaced else None
        return lambda a, b: wrapped(_LOCAL_MAPS[op](a, b, kind), kind)

    def local_aggregate(self, name: str) -> Callable | None:
        """A built-in aggregate over (config..., list of values)."""
        op, _, kind = name.rpartition("_")
        kind, op = (kind, op) if kind in SPARK_TYPES else ("i32", name)
        if name in self.aggregates or op not in _LOCAL_AGGREGATES or kind[0] == "f" and op.startswith("sum"):
            return None  # sums of floats depend on their order: one way only
        return lambda *a: wrapped(_LOCAL_AGGREGATES[op](*a), kind)

    def find_aggregate(self, name: str) -> Functor | None:
        if name in self.aggregates:
            return self.aggregates[name]
        op, _, kind = name.rpartition("_")
        kind, op = (kind, op) if kind in SPARK_TYPES else ("i32", name)
        return Functor(name, _aggregate(op, kind)) if op in _AGGREGATES else None

    def find_merge(self, name: str) -> Functor | None:
        if name in self.merges:
            return self.merges[name]
        op, _, kind = name.rpartition("_")
        if kind in SPARK_TYPES and op in ("new_weight", "last", "first"):
            return self.merges["first" if op == "first" else "last"]
        if kind in SPARK_TYPES and op in ("add", "sum", "min", "max"):
            found = _aggregate("sum" if op == "add" else op, kind)
            return Functor(name, lambda v, order: found(v))
        return None


def default_registry() -> Registry:
    return Registry()
