"""Lexing, parsing, types and the diagnostics that are part of the contract."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.lang.ast import DatalogError, unparse
from tidewater.lang.parser import load, number, parse, tokens_of
from tidewater.plans.program import Program

EDGE = "#message edge(u64 A, u64 B) @differential.\n"


@pytest.mark.parametrize("text,value", [("42", 42), ("010", 8), ("0x1F", 31), ("0b101", 5), ("1.5", 1.5), ("-7", -7), ("0", 0)])
def test_numbers(text, value):
    assert number(text, (1, 1)) == value


def test_comments_strings_and_code():
    kinds = [(t.kind, t.text) for t in tokens_of('; note é\n#foreign str ```c++ std::string```. p("a\\n;b").')]
    assert kinds[1:3] == [("name", "str"), ("code", "```c++ std::string```")] and ("string", '"a\\n;b"') in kinds


@pytest.mark.parametrize("text,message", [
    ("#message m(i32 X). #query q(free i32 X) : m(X), pé(X).", "non-ASCII"),
    ("#message m(i32 X", "Expected"),
    ("#message m(i32 X). #query q(free i32 X) : m(X), X <= 3.", "does not exist"),
    ("#message m(i32 X). #query q(free i32 X) : m(X), X = X.", "itself"),
    ("#message m(i32 X). #query q(free i32 X) : m(X), Y > 3.", "not bound|only once"),
    ("#message m(i32 X). #query q(free i32 X) : m(X), m(Y).", "only once"),
    ("#message m(i32 X). #local p(i32 Z). p(Z) : m(X), X > 1. #query q(free i32 Z) : p(Z).", "Head variable Z|only once"),
    ("#message m(i32 X). #local p(i32 X). p(_) : m(_). #query q(free i32 X) : p(X).", "Anonymous"),
    ("#message m(i32 X). #message n(i32 Y). #query q(free i32 X, free i32 Y) : m(X), n(Y).", "cross-product"),
    ("#message m(i32 X). #message n(i32 Y). #query q(free i32 X) : m(X), n(Y), Y > 1.", "condition of their own"),
    ("#message m(i32 X). #query q(free i32 X) : m(X), n(X).", "not declared"),
    ("#message m(i32 X). #local p(i32 X). #query q(free i32 X) : m(X), p(X).", "no definition"),
    ("#message m(i32 X). #message n(i32 X). #query q(free i32 X) : m(X).", "never received"),
    (EDGE + "#local p(u64 A) : edge(A, _), !p(A). #query q(free u64 A) : p(A).", "negation depends on itself"),
    (EDGE + "#message out(u64 A) : edge(A, _).", "must be marked @differential"),
    (EDGE + "#message m(u64 A). #query q(free u64 A) : m(A), @never edge(A, _).", "@never cannot"),
    ("#functor f(bound i32 X, free i32 Y) @impure.", "@impure"),
    ("#functor f(free i32 Y).", "only free"),
    ("#functor f(bound i32 X) @range(*).", "zero-or-one"),
    ("#functor f(aggregate i32 X).", "both aggregate and summary"),
    ("#functor f(aggregate i32 X, summary i32 Y) @range(.).", "no range"),
    ("#functor f(bound i32 A, bound i32 B, free i32 C) @invertible @recompute.", "exclude"),
    ("#functor f(bound i32 A, bound i32 B, free i32 C) @recompute @recompute.", "twice"),
    ("#functor add_i32(bound i32 A, bound i32 B, free i32 C) @range(.). #message m(i32 A, i32 B). #local kv(i32 A, mutable(add_i32) B). kv(A, B) : m(A, B). #query q(free i32 A, free i32 B) : kv(A, B).", "no algebra"),
    ("#functor count_i32(aggregate i32 V, summary i32 N). #message m(i32 A, i32 B). #local p(i32 A, i32 N) : m(A, N) : count_i32(B, N) over p(A, B). #query q(free i32 A, free i32 N) : p(A, N).", "aggregate depends on itself"),
    ("#functor max_i32(bound i32 A, bound i32 B, free i32 C) @range(.) @recompute. #message m(i32 A, i32 B). #local kv(i32 A, mutable(max_i32) B) : m(A, B) : kv(A, B), m(_, B). #query q(free i32 A, free i32 B) : kv(A, B).", "depends on itself"),
    ("#functor f(bound i32 X, free i32 Y) @range(.). #message m(i32 X). #query q(free i32 X) : m(X), !f(X, _).", "only with @never"),
    ("#functor f(bound i32 X, free i32 Y) @range(.). #message m(i32 X). #query q(free i32 X) : m(X), @never f(X, _).", "zero-or-one and zero-or-more"),
    ("#message m(i32 X). c : m(_). #query q(free i32 X) : m(X), @never c.", "@never"),
    ("#message m(i32 X). #query q(free i64 X) : m(X).", "types"),
    ("#message m(i32 X). #constant i32 A. #query q(free i32 X) : m(X).", "needs a value"),
    ("#message m(i32 X) @first.", "does not apply"),
    ("#message m(i32 X). #query q(bound i32 X) @first : m(X).", "free parameter"),
    ("#message m(zzz X). #query q(free zzz X) : m(X).", "Unknown type"),
    ("#message m(i32 X). #query q(free i32 X) : m(X). #import \"x\".", "Imports must"),
    ("#nonsense.", "Unknown directive"),
    ("#foreign point ```c++ struct point```. #message m(point P). #query q(free point P) : m(P).", "no Spark type"),
    ("#message m(i32 X). #query q(free i32 X) : m(X), @barrier.", "followed"),
])
def test_rejected(text, message):
    with pytest.raises(DatalogError, match=message) as e:
        Program.parse(text)
    assert str(e.value)


def test_places_are_reported():
    with pytest.raises(DatalogError) as e:
        parse("#message m(i32 X).\n#query q(free i32 X) : m(X), X <= 3.")
    assert e.value.place == (2, 33)


def test_merge_without_algebra_is_accepted_where_the_value_is_unused():
    p = Program.parse("#functor add_u32(bound u32 A, bound u32 B, free u32 C). #message m(u64 A, u32 W). #local kv(u64 A, mutable(add_u32) W). kv(A, W) : m(A, W). #query q(free u64 A) : kv(A, _).")
    assert p.relations["kv/2"].merge is None


def test_types_are_inferred():
    p = Program.parse("#message m(u32 A, str B). #local p(X, Y). #local r(X). p(A, B) : m(A, B). r(B) : p(_, B). #query q(free str B) : r(B).")
    assert p.relations["p/2"].types == ["u32", "str"] and p.relations["r/1"].types == ["str"]


def test_two_literals_of_one_variable_are_empty_not_an_error():
    Program.parse("#message m(i32 X). #query q(free i32 X) : m(X), X = 1, X = 2.")


def test_strata_are_ordered_and_mutual_recursion_is_one():
    p = Program.parse("#message m(i32 X). #local a(i32 X) : m(X) : b(X). #local b(i32 X) : a(X). #local c(i32 X) : m(X), !a(X). #query q(free i32 X) : c(X).")
    at = {k: n for n, scc in enumerate(p.strata) for k in scc}
    assert at["a/1"] == at["b/1"] < at["c/1"] < at["q/1"]
    assert "recursive" in p.explain() and '"a/1" -> "c/1" [style=dashed]' in p.to_dot()


def test_imports(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "lib.dl").write_text("#message m(i32 X).\n#export p(i32 X) : m(X), X > LOW.\n")
    (tmp_path / "defs.dl").write_text("#constant i32 LOW 3.\n")
    (tmp_path / "main.dl").write_text('#import "defs.dl".\n#import "lib.dl".\n#import "defs.dl".\n#query q(free i32 X) : p(X).\n')
    p = Program(load(str(tmp_path / "main.dl"), (str(tmp_path / "sub"),)))
    assert {"m/1", "p/1", "q/1"} <= set(p.relations)
    with pytest.raises(DatalogError, match="Cannot find"):
        load(str(tmp_path / "main.dl"))


def test_printing_parses_to_the_same():
    from tidewater.catalogue import PROGRAMS

    for text, *_ in PROGRAMS.values():
        once = unparse(parse(text))
        assert unparse(parse(once)) == unparse(parse(unparse(parse(once))))
        Program.parse(once)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#@!:.,(){}=<>_ aXb19\"`;\né", max_size=60))
def test_any_text_parses_or_is_diagnosed(text):
    try:
        parse(text)
    except DatalogError:
        pass


def test_command_line(tmp_path, capsys, spark):
    from tidewater.__main__ import main

    (tmp_path / "p.dl").write_text("#message edge(u64 A, u64 B) @differential.\n#local tc(u64 A, u64 B) : edge(A, B) : tc(A, X), edge(X, B).\n#query from(bound u64 A, free u64 B) : tc(A, B).\n")
    (tmp_path / "s.txt").write_text("batch\n+ edge 1 2\n+ edge 2 3\nend\nbatch\n- edge 1 2\nend\n")
    path = str(tmp_path / "p.dl")
    assert main([path, "--explain", "--dot", "--print", "--demand"]) == 0
    out = capsys.readouterr().out
    assert "asked_tc_2" in out and "digraph" in out and "recursive" in out
    assert main([path, "--run", str(tmp_path / "s.txt")]) == 0
    assert capsys.readouterr().out == "from\t2 3\ntc\t2 3\n"
    (tmp_path / "p.dl").write_text("#message edge(u64 A")
    assert main([path]) == 1 and "1:20" in capsys.readouterr().err
