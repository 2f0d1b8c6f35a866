"""Syntax trees.  A place is (line, column), for diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

Place = tuple[int, int]


class DatalogError(Exception):
    """A rejected program, with the place in its source."""

    def __init__(self, message: str, place: Place = (0, 0)):
        super().__init__(f"{place[0]}:{place[1]}: {message}" if place[0] else message)
        self.message, self.place = message, place


@dataclass(frozen=True)
class Var:
    name: str
    place: Place = field(default=(0, 0), compare=False)

    @property
    def anonymous(self) -> bool:
        return self.name.startswith("_")


@dataclass(frozen=True)
class Lit:
    value: Any
    type: str | None = None
    place: Place = field(default=(0, 0), compare=False)


Term = Var | Lit


@dataclass
class Param:
    name: str
    type: str | None = None
    mode: str = ""  # bound, free, aggregate, summary
    merge: str | None = None  # functor of a mutable parameter
    place: Place = (0, 0)


@dataclass
class Atom:
    """p(args), a condition (no argument list), or a functor application."""

    name: str
    args: list[Term] | None
    place: Place = (0, 0)
    negated: bool = False
    never: bool = False
    first: bool = False  # a forcing message

    @property
    def arity(self) -> int:
        return len(self.args or [])


@dataclass
class Compare:
    op: str  # = != < >
    left: Term
    right: Term
    place: Place = (0, 0)


@dataclass
class Test:
    """A boolean variable or literal as a conjunct."""

    term: Term
    negated: bool
    place: Place = (0, 0)


@dataclass
class Barrier:
    place: Place = (0, 0)


@dataclass
class Over:
    """f(args) over pred(args), or over (params) { body }."""

    functor: Atom
    source: Atom | None
    params: list[Param]
    body: list
    place: Place = (0, 0)


@dataclass
class Clause:
    head: Atom
    body: list
    product: bool = False
    highlight: bool = False
    place: Place = (0, 0)


@dataclass
class Decl:
    kind: str  # message, local, export, query, functor
    name: str
    params: list[Param]
    pragmas: dict[str, Any] = field(default_factory=dict)
    place: Place = (0, 0)

    @property
    def arity(self) -> int:
        return len(self.params)

    @property
    def pattern(self) -> str:
        return "".join(p.mode[:1] for p in self.params)


@dataclass
class Module:
    database: str | None = None
    imports: list[str] = field(default_factory=list)
    inlines: list[tuple[str, str]] = field(default_factory=list)
    foreign: dict[str, dict] = field(default_factory=dict)
    enums: dict[str, str] = field(default_factory=dict)
    constants: dict[str, Lit] = field(default_factory=dict)
    unique: set[str] = field(default_factory=set)
    decls: list[Decl] = field(default_factory=list)
    clauses: list[Clause] = field(default_factory=list)


# -- printing: what parses again to the same tree --------------------------------------
def _term(t: Term) -> str:
    if isinstance(t, Var):
        return "_" if t.anonymous else t.name
    if isinstance(t.value, bool):
        return "true" if t.value else "false"
    if isinstance(t.value, str):
        return '"' + "".join({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t"}.get(c, c) for c in t.value) + '"'
    return repr(t.value)


def _atom(a: Atom) -> str:
    sign = "@first " if a.first else "@never " if a.never else "!" if a.negated else ""
    return sign + a.name + ("" if a.args is None else f"({', '.join(map(_term, a.args))})")


def _conjunct(c) -> str:
    if isinstance(c, Atom):
        return _atom(c)
    if isinstance(c, Compare):
        return f"{_term(c.left)} {c.op} {_term(c.right)}"
    if isinstance(c, Test):
        return ("!" if c.negated else "") + _term(c.term)
    if isinstance(c, Barrier):
        return "@barrier"
    inner = _atom(c.source) if c.source else f"({', '.join(map(_param, c.params))}) {{ {', '.join(map(_conjunct, c.body))} }}"
    return f"{_atom(c.functor)} over {inner}"


def _param(p: Param) -> str:
    kind = f"mutable({p.merge})" if p.merge else p.type or ""
    return " ".join(x for x in (p.mode, kind, p.name) if x)


def unparse(m: Module) -> str:
    out = [f"#database {m.database}."] if m.database else []
    out += [f"#foreign {k}." for k in m.foreign]
    out += [f"#enum {k} {v}." for k, v in m.enums.items()]
    out += [f"#constant {v.type} {k} {_term(v)}{' @unique' * (k in m.unique)}." for k, v in m.constants.items()]
    for d in m.decls:
        marks = "".join(f" @range({v})" if k == "range" else f" @inline(```{v}```)" if k == "inline" and v is not True else f" @{k}" for k, v in d.pragmas.items())
        out.append(f"#{d.kind} {d.name}({', '.join(map(_param, d.params))}){marks}.")
    for c in m.clauses:
        marks = " @product" * c.product + " @highlight" * c.highlight
        out.append(_atom(c.head) + marks + (" : " + ", ".join(map(_conjunct, c.body)) if c.body else "") + ".")
    return "\n".join(out) + "\n"
