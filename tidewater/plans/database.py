"""An incremental database: batches of messages in, net changes out.

After every epoch the state equals a from-scratch evaluation of the facts that are
left, except for @never, which remembers what it let through.  In incremental mode a
stratum whose inputs changed is maintained by over-deleting with the old state,
re-deriving survivors and inserting semi-naively; aggregates and merges run again over
the groups that a change touched.  Unchanged strata are not touched.  An epoch that fails
leaves the state as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from functools import reduce
from operator import and_
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.lang.ast import Atom, DatalogError, Over, Var
from tidewater.plans.evaluate import derive, facts, fixpoint, merged, message_rows, read_query, rounds, rule_rows, union
from tidewater.plans.local import Rel, TooLarge, fits, groups, groups_fit, model
from tidewater.plans.program import Program, Rule
from tidewater.plans.storage import LOCAL_LIMIT, LOCAL_ROWS, DivergenceError, Table, absent, among, delete, noted, write

Rows = DataFrame | Iterable[tuple] | None


class Database:
    """``mode``: incremental or recompute.  ``on_publish(message, rows)`` is called with
    the net change of every published message, one boolean column ``added`` last.
    ``local``: strata whose inputs are few rows may be evaluated on the driver.
    ``max_rounds``: of any fixpoint, wherever it runs; beyond them DivergenceError is
    raised.  By default there is no limit.

    DataFrames got from a database can be read until the end of the next epoch; files that
    nothing refers to any longer are deleted after that."""

    def __init__(self, program: Program | str, spark: SparkSession, mode: str = "incremental", max_rounds: int | None = None, on_publish: Callable[[str, DataFrame], None] | None = None, local: bool = True):
        self.program = Program.parse(program) if isinstance(program, str) else program
        self.spark, self.mode, self.max_rounds, self.on_publish, self.local = spark, mode, max_rounds, on_publish, local
        self._indexed: dict[str, tuple] = {}
        self.state: dict[str, Table] = {k: Table(spark, self.program.schema(k)) for k in self.program.relations}
        self.proposals: dict[str, Table] = {}
        self.published = Published(self)
        self.epoch = -1
        self.lock = RLock()  # for streams that feed one database
        self.positions: dict[str, int] = {}  # the last micro-batch of each stream
        #: files that are ours: all, those that were idle after the last epoch, those of the saved state
        self.files: set[str] = set()
        self._idle: set[str] = set()
        self.saved: set[str] = set()
        self.manifest: dict[str, int] = {}  # the last one by folder
        self.copies: dict[tuple[str, str], tuple[frozenset, Table]] = {}  # of rows that the driver holds

    # -- entry points ------------------------------------------------------------
    def init(self) -> Database:
        """Epoch 0: facts fire.  Runs once, before any message."""
        if self.epoch >= 0:
            raise RuntimeError("init runs once")
        with noted(self.files):
            self._epoch({}, everything=True)
        self._sweep()
        return self

    def send(self, message: str, adds: Rows = None, removes: Rows = None) -> None:
        """One message, one epoch."""
        self.batch({message: (adds, removes)})

    def batch(self, changes: dict[str, tuple[Rows, Rows] | Rows]) -> None:
        """Several messages in one epoch.  What is both added and removed cancels out."""
        if self.epoch < 0:
            raise RuntimeError("init must run before any message")
        with noted(self.files):
            self._epoch(self._deltas(changes))
        self._sweep()

    def _deltas(self, changes: dict[str, tuple[Rows, Rows] | Rows]) -> dict[str, tuple[Table, Table]]:
        deltas: dict[str, tuple[Table, Table]] = {}
        for name, change in changes.items():
            key = self.program.key_of(name)
            rel = self.program.relations[key]
            adds, removes = change if isinstance(change, tuple) else (change, None)
            if rel.kind != "message" or self.program.rules_of(key):
                raise DatalogError(f"{name} is not a received message")
            if removes is not None and not rel.differential:
                raise DatalogError(f"{name} is not @differential, so it has no removals")
            a, r, old = self._table(key, adds), self._table(key, removes), self.state[key]
            # what is on both sides cancels out, before either is held against the state
            a, r = a.minus(r), r.minus(a)
            plus = a if not old.count else write(absent(a.df, old), a.schema, a.is_local) if a.count and not (a.is_local and old.is_local) else a.minus(old)
            gone = write(among(r.df, old), r.schema, r.is_local) if r.count and not (r.is_local and old.is_local) else r.minus(r.minus(old))
            deltas[key] = (plus, gone)
        return deltas

    def _sweep(self) -> None:
        """Delete the files that nothing has referred to for an epoch."""
        tables = [*self.state.values(), *self.proposals.values(), *(t for _, *both in self.published.changes.values() for t in both)]
        idle = self.files.difference(self.saved, *(t.files for t in tables))
        gone = idle & self._idle
        delete(self.spark, *gone)
        self.files -= gone
        self._idle = idle - gone

    def query(self, name: str, pattern: str | None = None, **bound) -> DataFrame:
        """Read the state; a forcing query first sends its message, as an epoch of its own."""
        key = next(k for k, r in self.program.relations.items() if r.kind == "query" and k.rpartition("/")[0] == name and (pattern is None or len(pattern) == len(r.types)))
        for r in self.program.rules_of(key):
            if r.forcing:
                values = {a.name: bound[p.name] for a, p in zip(r.args, self.program.relations[key].decl.params, strict=True) if isinstance(a, Var) and p.mode == "bound"}
                self.send(r.forcing.name, [tuple(values[a.name] if isinstance(a, Var) else a.value for a in r.forcing.args)])
        rows = self.state[key].df
        forced = [r for r in self.program.rules_of(key) if r.forcing and self._needs_bound(r)]
        if forced:
            decl = self.program.relations[key].decl
            given = {a.name: bound[p.name] for r in forced for a, p in zip(r.args, decl.params, strict=True) if isinstance(a, Var) and p.mode == "bound"}
            rows = union([rows, *(rule_rows(self.program, self.spark, r, self._now, bound=given) for r in forced)])
        return read_query(self.program, name, rows, pattern, **bound)

    def relation(self, name: str) -> DataFrame:
        """All rows of any relation, under its parameters' names."""
        key = self.program.key_of(name)
        return self.state[key].df.toDF(*self.program.names(key))

    def fetch(self, name: str, limit: int = LOCAL_LIMIT) -> set[tuple]:
        """All rows of a relation as tuples; more than ``limit`` of them are refused."""
        return _fetched(name, self.state[self.program.key_of(name)], limit)

    # -- pieces ------------------------------------------------------------------
    def _table(self, key: str, rows: Rows) -> Table:
        """Distinct checked rows; those that the driver has stay there if they are few."""
        schema = self.program.schema(key)
        if rows is None:
            return Table(self.spark, schema)
        if isinstance(rows, DataFrame):
            return write(message_rows(self.program, key, rows).distinct(), schema, fetch=True)
        checks = [_check(t, f.dataType, key) for t, f in zip(self.program.relations[key].types, schema, strict=True)]
        rows = list(rows)
        for row in rows:
            if len(row) != len(checks):
                raise DatalogError(f"{key} takes {len(checks)} values, not {len(row)}")
        return Table.of(self.spark, schema, (tuple(c(v) for c, v in zip(checks, row, strict=True)) for row in rows if None not in row))

    def _small(self, *keys: str) -> bool:
        """Whether these relations are so small that the driver may hold results."""
        return sum(self.state[k].count for k in keys) <= LOCAL_ROWS

    def _needs_bound(self, r: Rule) -> bool:
        return not r.atoms(False) and not r.aggregates

    def _now(self, key: str) -> DataFrame:
        return self.state[key].df

    def _epoch(self, deltas: dict[str, tuple[Table, Table]], everything: bool = False) -> None:
        was = dict(self.state), dict(self.proposals), self.published, self.epoch
        try:
            self._advance(deltas, everything)
        except BaseException:
            self.state, self.proposals, self.published, self.epoch = was
            raise

    def _advance(self, deltas: dict[str, tuple[Table, Table]], everything: bool) -> None:
        self.epoch += 1
        before = dict(self.state)
        for key, (plus, minus) in deltas.items():
            self._apply(key, plus, minus)
        deltas = {k: d for k, d in deltas.items() if d[0].count or d[1].count}
        for scc in self.program.strata:
            inputs = {u for k in scc for r in self.program.rules_of(k) for u, _ in r.uses()}
            if not everything and not inputs & set(deltas):
                continue
            deltas |= {k: d for k, d in self._stratum(scc, before, deltas, everything).items() if d[0].count or d[1].count}
        self.published = Published(self)
        for key, rel in self.program.relations.items():
            if rel.kind == "message" and self.program.rules_of(key):
                name = key.rpartition("/")[0]
                self.published.changes[name] = (key, *deltas.get(key, (Table(self.spark, self.program.schema(key)),) * 2))
                if self.on_publish and key in deltas:
                    self.on_publish(name, self.published[name])

    def _apply(self, key: str, plus: Table, minus: Table) -> None:
        self.state[key] = self.state[key].without(minus).plus(plus)

    def _stratum(self, scc: list[str], before: dict[str, Table], deltas: dict, everything: bool) -> dict[str, tuple[Table, Table]]:
        rules = [r for k in scc for r in self.program.rules_of(k)]
        if any(r.forcing and self._needs_bound(r) for r in rules):
            return {}
        sticky = any(r.sticky for r in rules)
        grouped = len(scc) == 1 and (rules[0].aggregates or bool(self.program.relations[scc[0]].merge))
        if grouped and (self.mode == "incremental" or self.program.relations[scc[0]].merge):
            return self._regroup(scc[0], rules, deltas)
        special = any(r.aggregates for r in rules)
        if self.local and not sticky and not special and fits(self.program, rules) and all(self.state[u].is_local for u in {u for r in rules for u, _ in r.uses()} | set(scc)):
            try:
                return self._on_driver(scc)
            except TooLarge:
                pass
        if sticky or (self.mode == "incremental" and not everything and not special):
            return self._maintain(scc, before, deltas, everything)
        old = {k: self.state[k] for k in scc}
        small = self._small(*{u for r in rules for u, _ in r.uses()}, *scc)
        if self.program.recursive(scc):
            new, _ = fixpoint(self.program, self.spark, scc, self._now, self.max_rounds, small=small)
        else:
            new = {scc[0]: self._derive(scc[0], small)}
        out = {}
        for k in scc:
            columns = new[k].df.columns
            plus = new[k] if not old[k].count else write(new[k].df.join(old[k].df, columns, "left_anti"), new[k].schema, small)
            gone = old[k].count + plus.count - new[k].count  # both are sets
            minus = write(old[k].df.join(new[k].df, columns, "left_anti"), new[k].schema, small) if gone else Table(self.spark, new[k].schema)
            self.state[k] = new[k]
            out[k] = (plus, minus)
        return out

    def _on_driver(self, scc: list[str]) -> dict[str, tuple[Table, Table]]:
        """From scratch, on the driver: for small strata that beats any chain of jobs."""

        def at(key: str) -> Rel:
            # an input's indexes are kept until it changes
            now = self.state[key].local
            if self._indexed.get(key, (None,))[0] is not now:
                self._indexed[key] = (now, Rel(now))
            return self._indexed[key][1]

        found, out = model(self.program, scc, at, self.max_rounds), {}
        for k in scc:
            old, new = self.state[k].local, found[k]
            schema = self.program.schema(k)
            out[k] = (Table(self.spark, schema, (), len(p := new - old), p), Table(self.spark, schema, (), len(m := old - new), m))
            if p or m:
                self.state[k] = Table(self.spark, schema, (), len(new), new)
        return out

    def _derive(self, key: str, small: bool) -> Table:
        return write(derive(self.program, self.spark, key, self._now).distinct(), self.program.schema(key), small)

    def _regroup(self, key: str, rules: list[Rule], deltas: dict) -> dict[str, tuple[Table, Table]]:
        """Aggregates and merges again over the groups that a change touched, and only those."""
        rel, schema, old = self.program.relations[key], self.program.schema(key), self.state[key]
        atom = next(a for x in rules[0].body for a in ([x.source] if isinstance(x, Over) else [x]))
        plus, minus = deltas.get(atom.key, (Table(self.spark, self.program.schema(atom.key)),) * 2)
        names = [a.name for a in atom.args]
        keys = [n for k, n in enumerate(names) if (k != rel.mutable if rel.merge else n in {a.name for a in rules[0].args if isinstance(a, Var)})]
        if not rel.merge:  # the groups' columns are the keys, then the summaries
            keys = [a.name for a in rules[0].args if a.name in names]
        at = [names.index(n) for n in keys]
        mine = [k for k, a in enumerate(rules[0].args) if a.name in keys]
        small = self._small(atom.key, key)
        source = self._dated(key, atom.key, plus, minus, small) if rel.merge else self.state[atom.key]

        def touched(df: DataFrame, columns: list[int]) -> DataFrame:
            if not keys or not old.count:
                return df
            changed = plus.df.unionByName(minus.df).select(*(F.col(f"c{k}").alias(f"_k{i}") for i, k in enumerate(at))).distinct()
            on = [F.col(f"c{k}") == F.col(f"_k{i}") for i, k in enumerate(columns)]
            return df.join(changed, reduce(and_, on), "left_semi")

        if self.local and source.is_local and old.is_local and not rel.merge and groups_fit(self.program, rules[0]):
            found = groups(self.program, rules[0], source.local)
            out = (Table.of(self.spark, schema, found - old.local), Table.of(self.spark, schema, old.local - found))
            self._apply(key, *out)
            return {key: out}
        rows = touched(source.df, at)
        if rel.merge:
            found = merged(self.program, key, rows)
        else:
            found = rule_rows(self.program, self.spark, rules[0], lambda k: rows if k == atom.key else self.state[k].df)
        new = write(found.distinct(), schema, small)
        before = write(touched(old.df, mine), schema, small) if old.count else old
        out = (new.minus(before), before.minus(new))
        self._apply(key, *out)
        return {key: out}

    def _dated(self, key: str, proposals: str, plus: Table, minus: Table, small: bool) -> Table:
        """Live proposals with the epoch in which each was first seen."""
        schema = T.StructType([*self.program.schema(proposals).fields, T.StructField("_epoch", T.LongType())])
        now = self.proposals.get(key, Table(self.spark, schema))
        columns = self.program.schema(proposals).names
        if minus.count:
            now = write(now.df.join(minus.df, columns, "left_anti").select(*schema.names), schema, small)
        if plus.count:
            now = now.plus(write(plus.df.withColumn("_epoch", F.lit(self.epoch).cast("long")), schema, small))
        self.proposals[key] = now
        return now

    def _copy(self, key: str, atom: Atom, deltas: dict) -> dict[str, tuple[Table, Table]]:
        """A relation whose rows are in one-to-one correspondence with some rows of another:
        changes carry over as they are, and nothing needs to be derived again."""
        rule, schema = self.program.rules_of(key)[0], self.program.schema(key)
        place = rule.body.index(atom)
        if rule.args == atom.args and len(rule.body) == 1 and schema == self.program.schema(atom.key):
            self.state[key] = self.state[atom.key]
            return {key: deltas[atom.key]}
        out = tuple(write(rule_rows(self.program, self.spark, rule, self._now, {place: t.df}), schema, self._small(key, atom.key)) if t.count else Table(self.spark, schema) for t in deltas[atom.key])
        self._apply(key, *out)
        return {key: out}

    # -- maintenance -------------------------------------------------------------
    def _maintain(self, scc: list[str], before: dict[str, Table], deltas: dict, everything: bool) -> dict[str, tuple[Table, Table]]:
        program, spark = self.program, self.spark
        if not everything and len(scc) == 1 and (atom := _source(program, scc[0])):
            return self._copy(scc[0], atom, deltas)
        schema = {k: program.schema(k) for k in scc}
        empty = {k: Table(spark, schema[k]) for k in scc}
        old = {k: self.state[k] for k in scc}
        rules = [r for k in scc for r in program.rules_of(k) if r.body]
        small = self._small(*{u for r in rules for u, _ in r.uses()}, *scc)
        was = lambda k: before[k].df

        def rows_by_head(found: list[tuple[str, DataFrame]], limit: Callable[[str, DataFrame], DataFrame]) -> dict[str, Table]:
            out = dict(empty)
            for k in scc:
                if parts := [df for h, df in found if h == k]:
                    out[k] = write(limit(k, union(parts).distinct()), schema[k], small)
            return out

        def positive(r: Rule, i: int) -> Rule:
            return replace(r, body=[replace_atom(x) if n == i else x for n, x in enumerate(r.body)])

        # 1. over-delete: all that some lost input helped to derive, by the old state
        found = []
        for r in rules:
            for i, a in r.atoms():
                if a.never or a.key not in deltas:
                    continue
                plus, minus = deltas[a.key]
                if not a.negated and minus.count:
                    found.append((r.head, rule_rows(program, spark, r, was, {i: minus.df})))
                elif a.negated and plus.count:
                    found.append((r.head, rule_rows(program, spark, positive(r, i), was, {i: plus.df})))
        doomed = delta = rows_by_head(found, lambda k, df: among(df, old[k]))
        for _ in rounds(self.max_rounds):
            if not any(d.count for d in delta.values()):
                break
            found = [(r.head, rule_rows(program, spark, r, was, {i: delta[a.key].df})) for r in rules for i, a in r.atoms(False) if a.key in scc and delta[a.key].count]
            known = doomed
            delta = rows_by_head(found, lambda k, df, known=known: among(df, old[k]).join(known[k].df, df.columns, "left_anti"))
            doomed = {k: doomed[k].plus(delta[k]) for k in scc}
        else:
            raise DivergenceError(f"{', '.join(scc)}: over-deletion did not end after {self.max_rounds} rounds")

        # 2. what is left, and what of the doomed other rules still derive from it
        left = {k: old[k].without(doomed[k]) for k in scc}
        now = lambda k: left[k].df if k in left else self.state[k].df
        found = []
        for r in rules:
            if doomed[r.head].count:
                found.append((r.head, rule_rows(program, spark, r, now, guard=doomed[r.head].df)))
        for k in scc:
            if doomed[k].count or everything:
                found += [(k, df) for df in facts(program, spark, program.rules_of(k))]
        # 3. rows that gained inputs derive
        for r in rules:
            for i, a in r.atoms():
                if a.never or a.key not in deltas:
                    continue
                plus, minus = deltas[a.key]
                if not a.negated and plus.count:
                    found.append((r.head, rule_rows(program, spark, r, now, {i: plus.df})))
                elif a.negated and minus.count:
                    # the old blocker names the candidates; the negation itself stays
                    wider = replace(r, body=[*r.body, replace_atom(a)])
                    found.append((r.head, rule_rows(program, spark, wider, now, {len(r.body): minus.df})))
        start = rows_by_head(found, lambda k, df: absent(df, left[k]))
        if program.recursive(scc):
            new, added = fixpoint(program, spark, scc, lambda k: self.state[k].df, self.max_rounds, left, start, small)
        else:
            new, added = {k: left[k].plus(start[k]) for k in scc}, start
        out = {}
        for k in scc:
            self.state[k] = new[k]
            plus = minus = empty[k]
            if added[k].count:
                plus = added[k].minus(doomed[k])
            if doomed[k].count:
                minus = doomed[k].minus(added[k])
            out[k] = (plus, minus)
        return out


def _source(program: Program, key: str) -> Atom | None:
    """The one atom of a relation's only rule, if no two of its rows give the same head row."""
    rules = program.rules_of(key)
    if len(rules) != 1 or rules[0].forcing or program.relations[key].merge or not rules[0].args:
        return None
    atoms = [x for x in rules[0].body if isinstance(x, Atom)]
    if len(atoms) != 1 or atoms[0].is_functor or atoms[0].negated or any(isinstance(x, Over) for x in rules[0].body):
        return None
    names = {a.name for a in atoms[0].args or [] if isinstance(a, Var)}
    return atoms[0] if atoms[0].args and names <= {a.name for a in rules[0].args if isinstance(a, Var)} else None


class Published(Mapping):
    """The last epoch's net changes by message: a DataFrame each, or rows by ``fetch``."""

    def __init__(self, db: Database):
        self.db, self.changes = db, {}

    def __getitem__(self, name: str) -> DataFrame:
        key, plus, minus = self.changes[name]
        out = plus.df.withColumn("added", F.lit(True)).unionByName(minus.df.withColumn("added", F.lit(False)))
        return out.toDF(*self.db.program.names(key), "added")

    def __iter__(self):
        return iter(self.changes)

    def __len__(self) -> int:
        return len(self.changes)

    def fetch(self, name: str, limit: int = LOCAL_LIMIT) -> tuple[set[tuple], set[tuple]]:
        """(added, removed) rows; more than ``limit`` of a kind are refused."""
        _, *both = self.changes[name]
        return tuple(_fetched(name, t, limit) for t in both)


def _fetched(name: str, rows: Table, limit: int) -> set[tuple]:
    if rows.count > limit:
        raise ValueError(f"{name} has {rows.count} rows, more than {limit}: read them as a DataFrame")
    return set(rows.local) if rows.is_local else {tuple(r) for r in rows.df.collect()}


def _check(kind: str | None, spark_type: T.DataType, key: str) -> Callable:
    """The conversion of one value that the driver was given, refusing what does not fit."""
    if kind in ("f32", "f64"):
        def number(v):
            v = float(v)
            if v != v:
                raise DatalogError(f"{key}: NaN is not a value")
            return v + 0.0  # both zeros are one value
        return number
    if kind and kind[0] in "iu" and kind[1:].isdigit():
        bits = int(kind[1:])
        low, high = (0, (1 << min(bits, 63)) - 1) if kind[0] == "u" else (-(1 << (bits - 1)), (1 << (bits - 1)) - 1)

        def whole(v):
            if not low <= v <= high:
                raise DatalogError(f"{key}: {v} is out of the range of {kind}")
            return int(v)
        return whole
    return lambda v: v


def replace_atom(a: Atom) -> Atom:
    """The same atom, not negated."""
    out = Atom(a.name, a.args, a.place)
    out.key, out.is_functor = a.key, False
    return out
