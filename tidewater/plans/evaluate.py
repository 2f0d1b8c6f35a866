"""Least models from scratch.

Everything below recursion stays one lazy DataFrame for Catalyst.  A recursive stratum
first writes what it reads from lower ones, only the columns that its rules use, and then
runs semi-naively: each round joins the last round's new rows into every recursive
position, keeps what was not known, writes it and stops when nothing is new.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.lang.ast import Atom, Over, Var
from tidewater.operators.body import Body
from tidewater.plans.program import Program, Rule
from tidewater.plans.storage import LOCAL_ROWS, DivergenceError, Table, absent, delete, noted, write

Lookup = Callable[[str], DataFrame]


def rule_rows(program: Program, spark: SparkSession, rule: Rule, at: Lookup, override: dict[int, DataFrame] | None = None, guard: DataFrame | None = None, bound: dict | None = None) -> DataFrame:
    """Head rows of one rule; ``override`` replaces the relation at some positions."""
    override = override or {}

    def scan(k: int | None, atom: Atom) -> DataFrame:
        return override[k] if k in override else at(atom.key)

    return Body(program, spark, rule, scan).rows(rule.args, guard, bound=bound)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def facts(program: Program, spark: SparkSession, rules: list[Rule]) -> list[DataFrame]:
    """All rules without a body as one DataFrame."""
    rows = [tuple(a.value for a in r.args) or (True,) for r in rules if not r.body]
    if not rows:
        return []
    schema = program.schema(rules[0].head)
    return [spark.createDataFrame([tuple(_typed(v, f) for v, f in zip(row, schema, strict=True)) for row in rows], schema)]


def _typed(v, f):
    return float(v) if f.dataType.typeName() in ("double", "float") else v


def keeps_all(program: Program, rule: Rule) -> bool:
    """Whether distinct body rows give distinct head rows: nothing is projected away."""
    head = {a.name for a in rule.args if isinstance(a, Var)}
    if rule.aggregates or any(isinstance(x, Atom) and x.is_functor for x in rule.body):
        return False
    atoms = [a for _, a in rule.atoms(False)]
    names = [t.name for a in atoms for t in a.args or [] if isinstance(t, Var)]
    return set(names) <= head and all(program.relations[a.key].kind != "message" for a in atoms)


def merged(program: Program, key: str, proposals: DataFrame, order: str = "_epoch") -> DataFrame:
    """One row a key: the merge functor over all live proposals, oldest first."""
    rel = program.relations[key]
    keys = [f"c{k}" for k in range(len(rel.types)) if k != rel.mutable]
    value = F.col(f"c{rel.mutable}")
    ranked = F.struct(F.col(order), value)
    out = proposals.groupBy(*keys).agg(program.registry.find_merge(rel.merge).make(value, ranked).cast(program.schema(key)[rel.mutable].dataType).alias(f"c{rel.mutable}"))
    return out.select(*(f"c{k}" for k in range(len(rel.types))))


def derive(program: Program, spark: SparkSession, key: str, at: Lookup) -> DataFrame:
    """All rows of one relation from its rules, distinct."""
    rules = program.rules_of(key)
    parts = facts(program, spark, rules) + [rule_rows(program, spark, r, at) for r in rules if r.body]
    out = union(parts)
    if len(parts) > 1 or not all(keeps_all(program, r) for r in rules):
        out = out.distinct()
    return merged(program, key, out.withColumn("_epoch", F.lit(0))) if program.relations[key].merge else out


def rounds(limit: int | None):
    """Rounds of a fixpoint: as many as it takes, or a limit that the caller gave."""
    return count() if limit is None else range(limit)


def used_columns(program: Program, rules: list[Rule], key: str) -> set[int]:
    """Columns of a relation that any of the rules looks at."""
    out: set[int] = set()

    def walk(items: list, head: set[str]) -> None:
        for x in items:
            if isinstance(x, Over):
                walk([x.source] if x.source else x.body, {p.name for p in x.params})
            elif isinstance(x, Atom) and not x.is_functor and x.key == key:
                out.update([0] if x.args is None else [k for k, a in enumerate(x.args) if not (isinstance(a, Var) and a.anonymous and a.name not in head)])

    for r in rules:
        walk(r.body, set())
    return out


def inputs_once(program: Program, spark: SparkSession, scc: list[str], at: Lookup) -> dict[str, Table]:
    """What a recursive stratum reads from lower ones, each written once as a set of the
    columns that the stratum's rules use."""
    rules = [r for k in scc for r in program.rules_of(k)]
    looping = {u for r in rules if any(a.key in scc for _, a in r.atoms(False)) for u, _ in r.uses() if u not in scc}
    out = {}
    for key in sorted(looping):
        columns = sorted(used_columns(program, rules, key)) or [0]
        schema = T.StructType([program.schema(key).fields[k] for k in columns])
        out[key] = write(at(key).select(*schema.names).distinct(), schema)
    return out


def fixpoint(program: Program, spark: SparkSession, scc: list[str], at: Lookup, max_rounds: int | None, known: dict[str, Table] | None = None, delta: dict[str, Table] | None = None, small: bool = False) -> tuple[dict[str, Table], dict[str, Table]]:
    """Semi-naive evaluation of a stratum: (all rows, rows added) by relation.

    ``known`` and ``delta`` continue from an earlier model: delta is new and not in known.
    """
    schema = {k: program.schema(k) for k in scc}
    recursive = {k: [(r, [i for i, a in r.atoms(False) if a.key in scc]) for r in program.rules_of(k)] for k in scc}
    if known is None:
        known = {k: Table(spark, schema[k]) for k in scc}
        delta = {}
        for k in scc:
            base = facts(program, spark, program.rules_of(k)) + [rule_rows(program, spark, r, at) for r, places in recursive[k] if r.body and not places]
            delta[k] = write(union(base).distinct(), schema[k], small) if base else Table(spark, schema[k])
    added = dict(delta)
    for _ in rounds(max_rounds):
        if not any(d.count for d in delta.values()):
            return known, added
        small = max(d.count for d in delta.values()) <= LOCAL_ROWS // 4
        old, known = known, {k: known[k].plus(delta[k]) for k in scc}
        new = {}
        for k in scc:
            parts = []
            for r, places in recursive[k]:
                for n, i in enumerate(places):
                    d = delta[r.body[i].key]
                    if not d.count:
                        continue
                    # the last round's rows at one place, all rows before it, older ones after it
                    override = {i: d.df} | {j: (known if m < n else old)[r.body[j].key].df for m, j in enumerate(places) if m != n}
                    if any(not (known if m < n else old)[r.body[j].key].count for m, j in enumerate(places) if m != n):
                        continue
                    parts.append(rule_rows(program, spark, r, lambda x: known[x].df if x in known else at(x), override))
            if parts:
                fresh = union(parts).distinct()
                new[k] = write(absent(fresh, known[k]), schema[k], small)
            else:
                new[k] = Table(spark, schema[k])
        delta = new
        added = {k: added[k].plus(delta[k]) for k in scc}
    raise DivergenceError(f"{', '.join(scc)}: no fixpoint after {max_rounds} rounds")


def evaluate(program: Program, spark: SparkSession, tables: dict[str, DataFrame], max_rounds: int | None = None) -> dict[str, DataFrame]:
    """Every relation of a program over ``tables`` (message name -> rows), lazily except
    below recursion.  Rows that hold a null are no facts and do not take part."""
    found: dict[str, DataFrame] = {program.key_of(name): message_rows(program, program.key_of(name), df) for name, df in tables.items()}

    def at(key: str) -> DataFrame:
        return found[key] if key in found else spark.createDataFrame([], program.schema(key))

    for scc in program.strata:
        inputs = {u for k in scc for r in program.rules_of(k) for u, _ in r.uses()}
        if program.recursive(scc) and inputs <= set(scc) and (rows := _closed(program, scc, max_rounds)) is not None:
            found |= {k: Table.of(spark, program.schema(k), v).df for k, v in rows.items()}
        elif program.recursive(scc):
            files: set[str] = set()
            with noted(files):
                held = inputs_once(program, spark, scc, at)
                known, _ = fixpoint(program, spark, scc, lambda k, held=held: held[k].df if k in held else at(k), max_rounds)
            delete(spark, *files.difference(*(t.files for t in known.values())))
            found |= {k: t.df for k, t in known.items()}
        else:
            found[scc[0]] = derive(program, spark, scc[0], at)
    return found


def _closed(program: Program, scc: list[str], max_rounds: int | None) -> dict[str, frozenset] | None:
    """A stratum that only has facts of its own, on the driver; None if it does not fit."""
    from tidewater.plans import local

    if not local.fits(program, [r for k in scc for r in program.rules_of(k)]):
        return None
    try:
        return local.model(program, scc, lambda k: local.Rel(), max_rounds)
    except local.TooLarge:
        return None


def message_rows(program: Program, key: str, df: DataFrame) -> DataFrame:
    """Columns by the message's parameter names if the table has them, else by position;
    cast to the declared types, with range checks for unsigned ones and NaN refused."""
    rel, names = program.relations[key], program.names(key)
    lower = {c.lower(): c for c in df.columns}
    by_name = all(n.lower() in lower for n in names)
    out = []
    for k, (n, t) in enumerate(zip(names, rel.types, strict=True)):
        c = F.col(f"`{lower[n.lower()] if by_name else df.columns[k]}`").cast(program.spark_type(t))
        if t in ("f32", "f64"):
            c = F.when(F.isnan(c), F.raise_error(F.lit(f"{key}: NaN is not a value"))).otherwise(c)
        elif t and t[0] == "u" and t[1:].isdigit():
            top = (1 << min(int(t[1:]), 63)) - 1
            c = F.when((c < 0) | (c > top), F.raise_error(F.lit(f"{key}: a value is out of the range of {t}"))).otherwise(c)
        out.append(c.alias(f"c{k}"))
    return df.select(*out).dropna()


def read_query(program: Program, name: str, rows: DataFrame, pattern: str | None = None, **bound) -> DataFrame:
    """A query's rows: bound parameters are given, free ones returned under their names.
    With all parameters bound: one boolean column ``found``."""
    patterns = program.queries[name]
    if pattern is None:
        matching = [p for p, d in patterns.items() if {x.name for x in d.params if x.mode == "bound"} == set(bound)]
        if len(matching) != 1:
            raise KeyError(f"{name} has the patterns {sorted(patterns)}; name one or bind its parameters")
        pattern = matching[0]
    d = patterns[pattern]
    for k, p in enumerate(d.params):
        if p.mode == "bound":
            rows = rows.where(F.col(f"c{k}") == F.lit(bound[p.name]))
    free = [(k, p) for k, p in enumerate(d.params) if p.mode == "free"]
    if not free:
        return rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))
    out = rows.select(*(F.col(f"c{k}").alias(p.name) for k, p in free)).distinct()
    return out.limit(1) if d.pragmas.get("first") else out
