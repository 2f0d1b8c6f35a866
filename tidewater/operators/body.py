"""Clause bodies as DataFrames.

A body is a set of groups, each a DataFrame whose columns are variables.  Atoms start
groups, functors and comparisons work on the group that has their inputs, and groups
that share variables are joined.  Relations are sets and carry no nulls, so a side
whose other columns nobody needs is a semi join.  Physical strategy is left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tidewater.lang.ast import Atom, Barrier, Compare, DatalogError, Lit, Over, Var
from tidewater.plans.program import Program, Rule

#: (position in the body, or None inside an aggregate; relation) -> rows as c0, c1, ...
Scan = Callable[[int | None, Atom], DataFrame]


class Body:
    """Lowers one rule.  ``guard``: rows of the head (c0, ...) to which it is limited."""

    def __init__(self, program: Program, spark: SparkSession, rule: Rule, scan: Scan):
        self.program, self.spark, self.rule, self.scan = program, spark, rule, scan
        self.groups: list[DataFrame] = []

    # -- variables ---------------------------------------------------------------
    def unify(self, items: list) -> bool:
        """Equalities become one name or a literal; False if two literals clash."""
        self.root: dict[str, str] = {}
        self.value: dict[str, Lit] = {}
        for x in items:
            if isinstance(x, Compare) and x.op == "=":
                sides = [self.find(t) for t in (x.left, x.right)]
                names, lits = [s for s in sides if isinstance(s, Var)], [s for s in sides if isinstance(s, Lit)]
                if len(lits) == 2:
                    if lits[0].value != lits[1].value:
                        return False
                elif lits:
                    self.value[names[0].name] = lits[0]
                elif names[0].name != names[1].name:
                    self.root[names[1].name] = names[0].name
        return True

    def find(self, t):
        if isinstance(t, Lit):
            return t
        name = t.name
        while name in self.root:
            name = self.root[name]
        return self.value.get(name, Var(name))

    def kind(self, name: str) -> str | None:
        for v, k in self.rule.types.items():
            if v == name or (v in self.root and self.find(Var(v)) == Var(name)):
                return k
        return None

    def lit(self, t: Lit, kind: str | None) -> Column:
        kind = t.type or kind
        return F.lit(t.value).cast(self.program.spark_type(kind)) if kind else F.lit(t.value)

    def column(self, t, kind: str | None = None) -> Column:
        return self.lit(t, kind) if isinstance(t, Lit) else F.col(f"`{t.name}`")

    # -- groups ------------------------------------------------------------------
    def has(self, names: set[str]) -> int | None:
        return next((k for k, g in enumerate(self.groups) if names <= set(g.columns)), None)

    def source(self, df: DataFrame, args: list, types: list[str | None]) -> None:
        """A group from rows: literals and repeated variables filter, the rest is named."""
        named: dict[str, str] = {}
        for k, a in enumerate(args):
            t = self.find(a)
            if isinstance(t, Lit):
                df = df.where(F.col(f"c{k}") == self.lit(t, types[k]))
            elif t.name in named:
                df = df.where(F.col(f"c{k}") == F.col(named[t.name]))
            elif not t.anonymous or t.name in self.needed:
                named[t.name] = f"c{k}"
        self.groups.append(df.select(*(F.col(c).alias(n) for n, c in named.items())) if named else df.select(F.lit(True).alias(f"_g{len(self.groups)}_{id(df)}")))

    def join(self, i: int, j: int, later: set[str]) -> None:
        a, b = self.groups[i], self.groups[j]
        on = [c for c in a.columns if c in b.columns]
        if not set(b.columns) - set(on) & later:
            out = a.join(b, on, "left_semi")
        elif not set(a.columns) - set(on) & later:
            out = b.join(a, on, "left_semi")
        else:
            out = a.join(b, on)
        self.groups[i] = out.select(*(c for c in out.columns if c in later or c in on))
        del self.groups[j]

    # -- items -------------------------------------------------------------------
    def functor(self, x: Atom) -> bool:
        """Apply a functor if some group has its inputs."""
        names = lambda terms: {t.name for t in map(self.find, terms) if isinstance(t, Var)}
        for d in self.program.functors[x.key]:
            ins = [a for a, p in zip(x.args, d.params, strict=True) if p.mode == "bound"]
            if (k := self.has(names(ins))) is None:
                continue
            found = [self.apply(self.groups[k], x, e) for e in self.program.functors[x.key] if names([a for a, p in zip(x.args, e.params, strict=True) if p.mode == "bound"]) <= set(self.groups[k].columns)]
            out = found[0]
            for other in found[1:]:  # every applicable pattern counts
                out = out.unionByName(other)
            self.groups[k] = out.distinct() if len(found) > 1 else out
            return True
        return False

    def apply(self, g: DataFrame, x: Atom, d) -> DataFrame:
        name = d.pragmas["inline"].strip().removeprefix("python").strip() if isinstance(d.pragmas.get("inline"), str) else d.name
        found = self.program.registry.find_map(name) or self.program.registry.find_map(f"{d.name}_{d.pattern}") or self.program.registry.find_map(d.name)
        if found is None:
            raise DatalogError(f"Functor {d.name} has no implementation", x.place)
        ins = [self.column(self.find(a), p.type) for a, p in zip(x.args, d.params, strict=True) if p.mode == "bound"]
        outs = [(self.find(a), p) for a, p in zip(x.args, d.params, strict=True) if p.mode == "free"]
        value = found.make(*ins)
        if not outs:
            return g.where(~F.coalesce(value, F.lit(False)) if x.negated else value)
        reach = d.pragmas.get("range", "*")
        g = g.withColumn("_out", F.explode(value) if reach in "*+" and not x.negated else value)
        if x.negated:
            return g.where(F.col("_out").isNull() if reach == "?" else F.coalesce(F.size("_out"), F.lit(0)) <= 0).drop("_out")
        g = g.where(F.col("_out").isNotNull())
        for k, (t, p) in enumerate(outs):
            col = F.col("_out") if len(outs) == 1 else F.col("_out")[F.lit(k)] if isinstance(g.schema["_out"].dataType, ArrayType) else F.col("_out").getField(g.schema["_out"].dataType.names[k])
            col = col.cast(self.program.spark_type(self.program._type(p.type, p.place)))
            if isinstance(t, Lit) or t.name in g.columns:
                g = g.where(col == self.column(t, p.type))
            elif not t.anonymous:
                g = g.withColumn(t.name, col)
        return g.drop("_out")

    def compare(self, x: Compare) -> bool:
        a, b = self.find(x.left), self.find(x.right)
        names = {t.name for t in (a, b) if isinstance(t, Var)}
        if (k := self.has(names)) is None:
            return False
        kind = next((self.kind(n) for n in names), None)
        left, right = self.column(a, kind), self.column(b, kind)
        self.groups[k] = self.groups[k].where({"!=": left != right, "<": left < right, ">": left > right}[x.op])
        return True

    def negate(self, k: int | None, x: Atom) -> None:
        types = self.program.relations[x.key].types
        df = self.scan(k, x)
        if x.args is None:
            self.groups[0] = self.groups[0].join(df.select(F.col("c0").alias("_unit")), F.lit(True) == F.col("_unit"), "left_anti")
            return
        named: dict[str, str] = {}
        for j, a in enumerate(x.args):
            t = self.find(a)
            if isinstance(t, Lit):
                df = df.where(F.col(f"c{j}") == self.lit(t, types[j]))
            elif t.name in named:
                df = df.where(F.col(f"c{j}") == F.col(named[t.name]))
            elif not t.anonymous:
                named[t.name] = f"c{j}"
        g = self.groups[0]
        if named:
            keys = df.select(*(F.col(c).alias(n) for n, c in named.items())).distinct()
            self.groups[0] = g.join(keys, list(named), "left_anti")
        else:
            self.groups[0] = g.join(df.limit(1).select(F.lit(True).alias("_unit")), F.lit(True) == F.col("_unit"), "left_anti")

    def over(self, x: Over) -> None:
        """Group a sub-body, which is a set, by all its parameters but the aggregated."""
        d = self.program.functors[x.functor.key][0]
        params = [p.name for p in x.params]
        sub = Rule(self.rule.head, [Var(p) for p in params], x.body, True, x.place, self.rule.types)
        inner = Body(self.program, self.spark, sub, lambda k, a: self.scan(None, a))
        rows = inner.rows([Var(p) for p in params], keep_anonymous=True)
        names = {f"c{k}": p for k, p in enumerate(params)}
        rows = rows.select(*(F.col(c).alias(n) for c, n in names.items())).distinct()
        values = [a for a, p in zip(x.functor.args, d.params, strict=True) if p.mode == "aggregate"]
        config = [a for a, p in zip(x.functor.args, d.params, strict=True) if p.mode == "bound"]
        summary = [(a, p) for a, p in zip(x.functor.args, d.params, strict=True) if p.mode == "summary"]
        taken = {a.name for a in values}
        keys = [p for p in params if p not in taken]
        make = self.program.registry.find_aggregate(d.name).make
        col = lambda a: F.col(f"`{a.name}`") if isinstance(a, Var) else self.lit(a, None)
        value = make(*map(col, config + values))
        # a group's config is one of its keys, so any of its values is the value
        got = rows.groupBy(*(f"`{k}`" for k in keys)).agg(value.alias("_sum"))
        if not keys:
            got = got.join(rows.limit(1).select(F.lit(True).alias("_some")), F.lit(True) == F.col("_some"), "left_semi")
        args = [Var(k) for k in keys]
        cols = [F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keys)]
        if len(summary) == 1:
            cols.append(F.col("_sum").cast(self.program.spark_type(summary[0][1].type)).alias(f"c{len(keys)}"))
        else:
            fields = got.schema["_sum"].dataType.names
            cols += [F.col("_sum").getField(fields[i]).alias(f"c{len(keys) + i}") for i in range(len(summary))]
        args += [a for a, _ in summary]
        self.source(got.select(*cols), args, [None] * len(args))

    # -- the whole body ----------------------------------------------------------
    def rows(self, args: list, guard: DataFrame | None = None, keep_anonymous: bool = False, bound: dict | None = None) -> DataFrame:
        """The head rows c0, c1, ... (not yet distinct)."""
        body = list(self.rule.body)
        for name, v in (bound or {}).items():
            body.append(Compare("=", Var(name), Lit(v)))
        if not self.unify(body):
            return self.empty()
        heads = [self.find(a) for a in args]
        self.needed = {t.name for t in heads if isinstance(t, Var)} if keep_anonymous else set()
        todo = [(k, x) for k, x in enumerate(self.rule.body) if not (isinstance(x, Compare) and x.op == "=")]
        if guard is not None:
            self.source(guard, args, self.program.relations[self.rule.head].types)
        segments: list[list] = [[]]
        for k, x in todo:
            if isinstance(x, Barrier):
                segments.append([])
            else:
                segments[-1].append((k, x))
        conditions, negations = [], []
        pending: list = []
        for n, segment in enumerate(segments):
            after = [x for s in segments[n + 1 :] for _, x in s]
            for k, x in segment:
                if isinstance(x, Atom) and not x.is_functor and x.negated:
                    negations.append((k, x))
                elif isinstance(x, Atom) and not x.is_functor and x.args is None:
                    conditions.append((k, x))
                elif isinstance(x, Atom) and not x.is_functor:
                    self.source(self.scan(k, x), x.args, self.program.relations[x.key].types)
                elif isinstance(x, Over):
                    self.over(x)
                else:
                    pending.append(x)
            if not self.groups:
                self.groups.append(self.spark.range(1).select(F.lit(True).alias("_one")))
            pending = self.settle(pending, heads, after, [x for _, x in negations])
        while pending or len(self.groups) > 1:
            if len(self.groups) == 1:
                raise DatalogError("Some inputs of a functor or comparison are never bound", self.rule.place)
            # @product, or a group that only tests for existence
            a, b = self.groups[:2]
            self.groups[:2] = [a.crossJoin(b)]
            pending = self.settle(pending, heads, [], [x for _, x in negations])
        for k, x in conditions:
            unit = self.scan(k, x).select(F.col("c0").alias("_unit")).limit(1)
            self.groups[0] = self.groups[0].join(unit, F.lit(True) == F.col("_unit"), "left_semi")
        for k, x in negations:
            self.negate(k, x)
        types = self.program.relations[self.rule.head].types
        out = []
        for k, t in enumerate(heads):
            kind = None if keep_anonymous else types[k]
            c = self.column(t, kind)
            out.append((c.cast(self.program.spark_type(kind)) if kind else c).alias(f"c{k}"))
        if not args:
            return self.groups[0].limit(1).select(F.lit(True).alias("c0"))
        return self.groups[0].select(*out)

    def settle(self, pending: list, heads: list, after: list, negations: list) -> list:
        """Functors and comparisons as soon as they can run, then joins, until nothing moves."""
        while True:
            if done := next((x for x in pending if (self.functor(x) if isinstance(x, Atom) else self.compare(x))), None):
                pending = [x for x in pending if x is not done]
                continue
            later = {t.name for t in heads if isinstance(t, Var)} | self.names([*pending, *after, *negations])
            pairs = [(len(set(a.columns) & set(b.columns)), -i, -j) for i, a in enumerate(self.groups) for j, b in enumerate(self.groups) if i < j]
            best = max((p for p in pairs if p[0]), default=None)
            if best is None:
                return pending
            i, j = -best[1], -best[2]
            others = {c for k, g in enumerate(self.groups) if k not in (i, j) for c in g.columns}
            self.join(i, j, later | others)

    def names(self, items: list) -> set[str]:
        out = set()
        for x in items:
            terms = x.args or [] if isinstance(x, Atom) else [x.left, x.right] if isinstance(x, Compare) else [*x.functor.args, *(Var(p.name) for p in x.params)] if isinstance(x, Over) else []
            out |= {t.name for t in map(self.find, terms) if isinstance(t, Var)}
        return out

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.program.schema(self.rule.head))
