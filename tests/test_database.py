"""Epochs: golden cases of every family, each by three ways of evaluation."""

import random

import pytest

from tidewater.lang.ast import DatalogError
from tidewater.plans.database import Database
from tidewater.plans.storage import DivergenceError
from tidewater.sources.batches import parse_batches, run_batches

#: On the driver, by jobs with maintenance, by jobs from scratch.
WAYS = [("incremental", True), ("incremental", False), ("recompute", False)]
FAST = [("incremental", True), ("recompute", True)]


def make(spark, text, way):
    return Database(text, spark, way[0], local=way[1]).init()


TC = """
#message add_edge(u64 A, u64 B) @differential.
#local edge(A, B). #local tc(A, B).
edge(A, B) : add_edge(A, B).
tc(A, B) : edge(A, B) : tc(A, X), tc(X, B).
#query from(bound u64 A, free u64 B) : tc(A, B).
#query linked(bound u64 A, bound u64 B) : tc(A, B).
#message found(u64 A, u64 B) @differential : tc(A, B).
"""


def closure(edges):
    out = set(edges)
    while new := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= new
    return out


@pytest.mark.parametrize("way", WAYS)
def test_closure_with_retraction(spark, way):
    db = make(spark, TC, way)
    db.send("add_edge", [(1, 2), (2, 3), (3, 4), (7, 8)])
    first = closure({(1, 2), (2, 3), (3, 4), (7, 8)})
    assert db.fetch("tc") == first and db.published.fetch("found") == (first, set())
    db.send("add_edge", [(4, 7), (8, 1)], [(2, 3)])
    second = closure({(1, 2), (3, 4), (7, 8), (4, 7), (8, 1)})
    assert db.fetch("tc") == second and db.published.fetch("found") == (second - first, first - second)
    assert {r.B for r in db.query("from", A=7).collect()} == {1, 2, 8}
    assert db.query("linked", A=3, B=2).head().found and not db.query("linked", A=1, B=3).head().found


def test_phantoms_and_cycles(spark):
    for way in FAST:
        db = make(spark, TC, way)
        db.send("add_edge", [(1, 2), (1, 4), (4, 5)])
        db.send("add_edge", [(2, 5)], [(1, 2)])
        db.send("add_edge", None, [(4, 5)])
        assert db.fetch("tc") == {(1, 4), (2, 5)}
        db = make(spark, TC, way)
        db.send("add_edge", [(k, (k + 1) % 5) for k in range(5)])
        db.send("add_edge", [(9, 9)], [(2, 3)])
        assert db.fetch("tc") == closure({(0, 1), (1, 2), (3, 4), (4, 0), (9, 9)})


def test_netting(spark):
    db = make(spark, "#message m(i32 X) @differential. #message out(i32 X) @differential : m(X).", FAST[0])
    for adds, removes, state in (([1, 1], [], {1}), ([2], [2, 2], {1}), ([1], [1], {1}), ([], [5], {1}), ([3], [1], {3})):
        db.send("m", [(x,) for x in adds], [(x,) for x in removes])
        assert db.fetch("m") == {(x,) for x in state} == db.fetch("out")
    assert db.published.fetch("out") == ({(3,)}, {(1,)})
    db.send("m", [(3,)])
    assert db.published.fetch("out") == (set(), set())


PRODUCT = """
#message a_in(u32 A) @differential. #message b_in(u32 B) @differential.
#message pair(u32 A, u32 B) @differential @product : a_in(A), b_in(B).
"""


@pytest.mark.parametrize("way", WAYS)
def test_product(spark, way):
    db = make(spark, PRODUCT, way)
    db.send("a_in", [(1,)])
    db.send("b_in", [(10,)])
    assert db.published.fetch("pair") == ({(1, 10)}, set())
    db.send("a_in", [(2,)])
    assert db.published.fetch("pair") == ({(2, 10)}, set())
    db.batch({"a_in": [(3,)], "b_in": ([(11,)], [(10,)])})
    assert db.published.fetch("pair") == ({(1, 11), (2, 11), (3, 11)}, {(1, 10), (2, 10)})


GUESTS = """
#message arrives(i32 Guest). #message banned(i32 Guest).
#local unwanted(i32 Guest) : banned(Guest).
#local welcome(i32 Guest) : arrives(Guest), !unwanted(Guest).
#local admitted(i32 Guest) : arrives(Guest), @never unwanted(Guest).
#query welcome_now(free i32 Guest) : welcome(Guest). #query ever_admitted(free i32 Guest) : admitted(Guest).
"""


@pytest.mark.parametrize("way", WAYS)
def test_never_remembers_whom_it_let_in(spark, way):
    db = make(spark, GUESTS, way)
    arrived, banned, admitted = set(), set(), set()
    for message, guests in (("arrives", {11, 12, 13}), ("banned", {12, 14}), ("arrives", {14, 15, 12}), ("banned", {15}), ("arrives", {16})):
        db.send(message, [(g,) for g in sorted(guests)])
        if message == "banned":
            banned |= guests
        else:
            arrived |= guests
            admitted |= guests - banned
        assert db.fetch("welcome_now") == {(g,) for g in arrived - banned}
        assert db.fetch("ever_admitted") == {(g,) for g in admitted}


def test_negation_flap_and_counterparts(spark):
    text = """
#message blocker(i32 X) @differential. #message item(i32 X, i32 Y).
#local visible(i32 X, i32 Y) : item(X, Y), !blocker(X).
#local lonely(i32 X) : item(X, _), !item(_, X).
#query q(free i32 X, free i32 Y) : visible(X, Y). #query l(free i32 X) : lonely(X).
"""
    for way in FAST:
        db = make(spark, text, way)
        db.batch({"item": [(1, 5), (2, 6), (2, 7), (3, 1)], "blocker": [(2,)]})
        assert db.fetch("visible") == {(1, 5), (3, 1)} and db.fetch("lonely") == {(2,), (3,)}
        db.send("blocker", [(3,)], [(3,)])
        assert db.fetch("visible") == {(1, 5), (3, 1)}
        db.send("blocker", [(1,)], [(2,)])
        assert db.fetch("visible") == {(2, 6), (2, 7), (3, 1)}


FLOOD = """
#message spring(u64 Field) @differential. #message below(u64 High, u64 Low) @differential. #message dike(u64 Field) @differential.
#local wet(Field). wet(F) : spring(F). wet(L) : wet(H), below(H, L), !dike(L).
#query flooded(free u64 Field) : wet(Field).
"""


def flooded(springs, slopes, dikes):
    out, todo = set(springs), list(springs)
    while todo:
        h = todo.pop()
        for a, b in slopes:
            if a == h and b not in dikes and b not in out:
                out.add(b)
                todo.append(b)
    return {(f,) for f in out}


@pytest.mark.parametrize("way", WAYS)
def test_negation_inside_recursion(spark, way):
    db, slopes = make(spark, FLOOD, way), {(20, 21), (21, 22), (22, 20), (22, 23), (24, 22)}
    db.batch({"spring": [(20,)], "below": sorted(slopes)})
    assert db.fetch("wet") == flooded({20}, slopes, set())
    db.send("dike", [(22,)])
    assert db.fetch("wet") == flooded({20}, slopes, {22})
    db.batch({"dike": (None, [(22,)]), "below": ([(23, 25)], [(20, 21)])})
    slopes = slopes - {(20, 21)} | {(23, 25)}
    assert db.fetch("wet") == flooded({20}, slopes, set())
    db.batch({"spring": ([(24,)], [(20,)])})
    assert db.fetch("wet") == flooded({24}, slopes, set())


@pytest.mark.parametrize("local", [True, False])
def test_one_round_limit_for_both_ways(spark, local):
    text = "#message step(u64 A, u64 B). #local path(u64 A, u64 B) : step(A, B) : path(A, X), step(X, B). #query q(free u64 A, free u64 B) : path(A, B)."
    steps = [(k, k + 1) for k in range(12)]
    db = Database(text, spark, max_rounds=6, local=local).init()
    with pytest.raises(DivergenceError):
        db.send("step", steps)
    db = Database(text, spark, local=local).init()  # no limit of its own
    db.send("step", steps)
    assert db.max_rounds is None and db.fetch("path") == {(a, b) for a in range(13) for b in range(a + 1, 13)}


def test_removals_write_what_they_remove(spark):
    db = Database("#message m(i64 X) @differential. #query q(free i64 X) : m(X).", spark, local=False).init()
    db.send("m", spark.range(40_000).toDF("X"))
    db.send("m", None, spark.range(0, 40_000, 50).toDF("X"))
    now = db.state["m/1"]
    assert now.gone == 800 and now.count == 39_200 and now.df.count() == 39_200
    db.send("m", spark.range(0, 100, 50).toDF("X"))  # removed rows may come back
    assert db.relation("m").where("X in (0, 50)").count() == 2 and db.state["m/1"].count == 39_202 == db.relation("m").count()
    db.send("m", None, spark.range(0, 30_000).toDF("X"))
    assert db.relation("m").count() == db.state["m/1"].count == 10_000 - 200


def test_conditions(spark):
    text = """
#message add_a(i32 X) @differential. #message add_b(i32 X) @differential. #message add_item(i32 X).
c : add_a(_). c : add_b(_).
#local on(i32 X) : c, add_item(X). #local off(i32 X) : !c, add_item(X).
#query q(free i32 X, free bool On) : on(X), On = true : off(X), On = false.
"""
    for way in [*FAST, WAYS[1]]:
        db = make(spark, text, way)
        db.send("add_item", [(1,)])
        assert db.fetch("q") == {(1, False)}
        db.batch({"add_a": [(7,)], "add_b": [(8,)]})
        assert db.fetch("q") == {(1, True)}
        db.send("add_a", None, [(7,)])
        assert db.fetch("q") == {(1, True)}
        db.send("add_b", None, [(8,)])
        assert db.fetch("q") == {(1, False)}


def test_boolean_conjuncts(spark):
    text = """
#message m(i32 X, bool B).
#local yes(i32 X) : m(X, B), B. #local no(i32 X) : m(X, B), !B. #local all(i32 X) : m(X, _), true. #local none(i32 X) : m(X, _), false.
none(X) : m(X, _), X > 100.
#query q(free i32 X) : yes(X). #query n(free i32 X) : no(X). #query a(free i32 X) : all(X). #query z(free i32 X) : none(X).
"""
    db = make(spark, text, FAST[0])
    db.send("m", [(1, True), (2, False)])
    assert [db.fetch(k) for k in ("q", "n", "a", "z")] == [{(1,)}, {(2,)}, {(1,), (2,)}, set()]


AVERAGE = """
#functor div_i32(bound i32 L, bound i32 R, free i32 Q) @range(.).
#functor sum_i32(aggregate i32 V, summary i32 S) @invertible.
#functor count_i32(aggregate i32 V, summary i32 N) @invertible.
#functor new_weight_i32(bound i32 Old, bound i32 New, free i32 Out) @range(.) @recompute.
#message add_edge(i32 A, i32 B, i32 W).
#local weight(i32 A, i32 B, mutable(new_weight_i32) W).
weight(A, B, W) : add_edge(A, B, W).
#query average(bound i32 X, free i32 Avg)
  : sum_i32(V, Sum) over (i32 X, i32 V) { weight(_A, X, V) }, count_i32(U, N) over (i32 X, i32 U) { weight(_B, X, U) }, div_i32(Sum, N, Avg).
"""


@pytest.mark.parametrize("way", WAYS[:2])
def test_merge_keeps_the_last_and_aggregates_follow(spark, way):
    db = make(spark, AVERAGE, way)
    db.send("add_edge", [(1, 2, 10), (3, 2, 20), (5, 4, 100)])
    assert db.fetch("average") == {(2, 10), (2, 20), (4, 100)} or db.query("average", X=2).head().Avg == 15
    db.send("add_edge", [(1, 2, 30)])
    assert db.fetch("weight") == {(1, 2, 30), (3, 2, 20), (5, 4, 100)}


@pytest.mark.parametrize("way", WAYS[:2])
def test_aggregates(spark, way):
    text = """
#functor count_i32(aggregate i32 V, summary i32 N). #functor sum_above(bound i32 T, aggregate i32 V, summary i32 S) @invertible. #functor max_above(bound i32 T, aggregate i32 V, summary i32 S) @recompute.
#message reading(i32 S, i32 V) @differential. #message threshold(i32 S, i32 T).
#local per(i32 S, i32 N) : count_i32(V, N) over reading(S, V).
#local above(i32 S, i32 N) : sum_above(T, V, N) over (i32 S, i32 T, i32 V) { threshold(S, T), reading(S, V) }.
#local top(i32 S, i32 N) : max_above(T, V, N) over (i32 S, i32 T, i32 V) { threshold(S, T), reading(S, V) }.
#query p(free i32 S, free i32 N) : per(S, N). #query a(free i32 S, free i32 N) : above(S, N).
#message tops(i32 S, i32 N) @differential : top(S, N).
"""
    db = make(spark, text, way)
    db.batch({"reading": [(1, 20), (1, 30), (1, 5), (2, 60), (2, 100)], "threshold": [(1, 10), (2, 50)]})
    assert db.fetch("per") == {(1, 3), (2, 2)} and db.fetch("above") == {(1, 50), (2, 160)} and db.fetch("top") == {(1, 30), (2, 100)}
    db.send("reading", None, [(2, 100)])
    assert db.fetch("top") == {(1, 30), (2, 60)} and db.published.fetch("tops") == ({(2, 60)}, {(2, 100)})
    db.send("reading", [(1, 7)])
    assert db.published.fetch("tops") == (set(), set()) and db.fetch("per") == {(1, 4), (2, 1)}
    db.send("reading", None, [(2, 60)])
    assert db.fetch("per") == {(1, 4)}


@pytest.mark.parametrize("way", WAYS)
def test_odd_recursions(spark, way):
    text = """
#message m(u32 A) @differential. #message n(u32 A, f64 B) @differential.
#local same(A) : m(A) : same(A).
#local grow(u32 A, u32 B). grow(A, B) @product : m(A), m(B) : grow(A, _), grow(_, B).
#local twice(u32 A, f64 B) : n(A, B), n(A, B).
#local half(u32 A, f64 B). half(A, 5) : m(A). half(7, B) : n(_, B), B < 2.
#local none(u32 A) : none(A).
#local all(u32 A) : m(A), !none(A).
#query q(free u32 A) : same(A). #query g(free u32 A, free u32 B) : grow(A, B). #query t(free u32 A, free f64 B) : twice(A, B). #query h(free u32 A, free f64 B) : half(A, B). #query a(free u32 A) : all(A).
"""
    db = make(spark, text, way)
    db.batch({"m": [(1,), (2,)], "n": [(3, 1.5), (4, 2.5)]})
    db.batch({"m": ([(3,)], [(1,)])})
    assert db.fetch("same") == {(2,), (3,)} == db.fetch("all") and db.fetch("grow") == {(a, b) for a in (2, 3) for b in (2, 3)}
    assert db.fetch("twice") == {(3, 1.5), (4, 2.5)} and db.fetch("half") == {(2, 5.0), (3, 5.0), (7, 1.5)}
    assert db.relation("half").count() == 3


def test_forcing_query(spark):
    text = """
#functor mul_i64(bound i64 A, bound i64 B, free i64 C) @range(.).
#message trigger(i64 T).
#local made(i64 T, i64 N) : trigger(T), mul_i64(T, 10, N).
#query get(bound i64 T, free i64 N) @first : @first trigger(T), made(T, N).
"""
    db = make(spark, text, FAST[0])
    db.send("trigger", [(5,)])
    assert db.query("get", T=7).head().N == 70 and db.fetch("trigger") == {(5,), (7,)}


def test_functor_that_nothing_feeds_is_computed_at_the_query(spark):
    text = """
#functor add_i64(bound i64 A, bound i64 B, free i64 C) @range(.).
#message trigger(i64 T).
#query next(bound i64 T, free i64 N) @first : @first trigger(T), add_i64(T, 3, N).
"""
    db = make(spark, text, FAST[0])
    assert [db.query("next", T=t).head().N for t in (4, 9)] == [7, 12]


@pytest.mark.parametrize("way", WAYS[:2])
def test_integer_functors_wrap_and_division_by_zero_has_no_row(spark, way):
    text = """
#functor add_i32(bound i32 A, bound i32 B, free i32 C) @range(.). #functor mul_i64(bound i64 A, bound i64 B, free i64 C) @range(.). #functor div_i32(bound i32 A, bound i32 B, free i32 C) @range(?).
#functor add_u8(bound u8 A, bound u8 B, free u8 C) @range(.).
#message m(i32 X, i64 Y, u8 Z).
#query a(free i32 X) : m(Y, _, _), add_i32(Y, 1, X). #query b(free i64 X) : m(_, Y, _), mul_i64(Y, 3, X). #query c(free i32 X) : m(Y, _, _), div_i32(-7, Y, X). #query d(free u8 X) : m(_, _, Y), add_u8(Y, 1, X).
"""
    db = make(spark, text, way)
    db.send("m", [(2147483647, 2**62, 255), (0, -5, 1), (2, 1, 7)])
    assert db.fetch("a") == {(-2147483648,), (1,), (3,)} and db.fetch("c") == {(0,), (-3,)} and db.fetch("d") == {(0,), (2,), (8,)}
    assert db.fetch("b") == {((3 * 2**62 + 2**63) % 2**64 - 2**63,), (-15,), (3,)}


def test_flatmap_optional_and_negated_functors(spark):
    from pyspark.sql import functions as F

    from tidewater.functions.registry import default_registry
    from tidewater.plans.program import Program

    registry = default_registry().map("halves", lambda x: F.when(x % 2 == 0, F.floor(x / 2))).map("upto", lambda x: F.sequence(F.lit(1), x)).map("both", lambda x: F.struct((x + 1).alias("a"), (x * 2).alias("b")))
    text = """
#functor halves(bound i64 X, free i64 Y) @range(?). #functor upto(bound i64 X, free i64 Y) @range(*). #functor both(bound i64 X, free i64 A, free i64 B) @range(.).
#functor is_even(bound i64 X).
#message m(i64 X).
#query h(free i64 X) : m(Y), halves(Y, X). #query n(free i64 X) : m(X), @never halves(X, _). #query u(free i64 X, free i64 Y) : m(X), upto(X, Y), Y > 1.
#query b(free i64 A, free i64 B) : m(X), both(X, A, B). #query same(free i64 X) : m(X), both(X, A, A). #query e(free i64 X) : m(X), @never is_even(X).
#query lit(free i64 Y) : halves(10, Y).
"""
    db = Database(Program.parse(text, registry), spark).init()
    db.send("m", [(1,), (3,), (4,)])
    assert db.fetch("h") == {(2,)} and db.fetch("n") == {(1,), (3,)} and db.fetch("u") == {(3, 2), (3, 3), (4, 2), (4, 3), (4, 4)}
    assert db.fetch("lit") == {(5,)}
    assert db.fetch("b") == {(2, 2), (4, 6), (5, 8)} and db.fetch("same") == {(1,)} and db.fetch("e") == {(1,), (3,)}


FLOW = """
#functor add_i64(bound i64 A, bound i64 B, free i64 C) @range(.). #functor mod_i64(bound i64 A, bound i64 B, free i64 C) @range(?). #functor is_even(bound i64 X).
#functor sum_i64(aggregate i64 V, summary i64 S) @invertible. #functor min_i64(aggregate i64 V, summary i64 S) @recompute. #functor count_i64(aggregate i64 V, summary i64 S) @invertible.
#functor max_i64(bound i64 A, bound i64 B, free i64 C) @range(.) @recompute.
#message m(i64 K, i64 V) @differential.
#local best(i64 K, mutable(max_i64) V). best(K, V) : m(K, V).
#local shifted(i64 K, i64 V) : m(K, V), is_even(V), add_i64(V, 100, V2), V = V2 : m(K, W), add_i64(W, 7, V), @never is_even(W).
#local rest(i64 K, i64 R) : best(K, V), mod_i64(V, K, R).
#local stats(i64 K, i64 S, i64 L) : sum_i64(V, S) over shifted(K, V), min_i64(W, L) over (i64 K, i64 W) { m(K, W), W > 1 }.
#local total(i64 N) : count_i64(K, N) over (i64 K) { m(K, _) }.
#query q(free i64 K, free i64 S, free i64 L) : stats(K, S, L).
#message out(i64 K, i64 R) @differential : rest(K, R).
#query t(free i64 N) : total(N).
"""


@pytest.mark.parametrize("way,epochs", [(WAYS[0], 25), (WAYS[1], 4)])
def test_functors_and_groups_equal_brute_force(spark, way, epochs):
    rng, db, facts, before = random.Random(7), make(spark, FLOW, way), set(), set()
    for _ in range(epochs):
        adds, removes = ({(rng.randrange(4), rng.randrange(9)) for _ in range(rng.randrange(6))} for _ in range(2))
        db.send("m", sorted(adds), sorted(removes))
        facts = (facts | (adds - removes)) - (removes - adds)
        keys = {k for k, _ in facts}
        best = {k: max(v for x, v in facts if x == k) for k in keys}
        shifted = {(k, v + 7) for k, v in facts if v % 2}
        lows = {k: min((v for x, v in facts if x == k and v > 1), default=None) for k in keys}
        assert db.fetch("best") == set(best.items()) and db.fetch("shifted") == shifted
        rest = {(k, v % k) for k, v in best.items() if k}
        assert db.fetch("rest") == rest and db.published.fetch("out") == (rest - before, before - rest)
        assert db.fetch("stats") == {(k, sum(v for x, v in shifted if x == k), lows[k]) for k in {k for k, _ in shifted} if lows[k] is not None}
        assert db.fetch("total") == ({(len(keys),)} if keys else set())
        before = rest


def test_divergence_is_reported(spark):
    text = "#functor add_i64(bound i64 A, bound i64 B, free i64 C) @range(.). #message m(i64 X). #local up(i64 X) : m(X) : up(Y), add_i64(Y, 1, X). #query q(free i64 X) : up(X)."
    db = Database(text, spark, max_rounds=4).init()
    with pytest.raises(DivergenceError):
        db.send("m", [(1,)])


def test_misuse(spark):
    db = Database(TC, spark)
    with pytest.raises(RuntimeError, match="init"):
        db.send("add_edge", [(1, 2)])
    db.init()
    with pytest.raises(RuntimeError, match="once"):
        db.init()
    with pytest.raises(DatalogError, match="not a received"):
        db.send("found", [(1, 2)])
    with pytest.raises(DatalogError, match="range"):
        db.send("add_edge", [(-1, 2)])
    with pytest.raises(DatalogError, match="takes 2"):
        db.send("add_edge", [(1,)])
    db2 = make(spark, GUESTS, FAST[0])
    with pytest.raises(DatalogError, match="no removals"):
        db2.send("arrives", None, [(1,)])


def test_batch_scripts(spark):
    db = make(spark, TC, FAST[0])
    run_batches("batch\n+ add_edge 1 2\n+ add_edge 0x2 3 # hex\nend\nbatch\n- add_edge 1 2\nend\n", db)
    assert db.fetch("tc") == {(2, 3)}
    for bad in ("batch\n+ add_edge 1\nend", "batch\n+ add_edge 1 -2\nend", "+ add_edge 1 2", "batch\n"):
        with pytest.raises((DatalogError, ValueError)):
            parse_batches(bad, db)


MIXED = """
#message edge(i64 A, i64 B) @differential. #message mark(i64 A) @differential. #message gate(i64 A) @differential.
open : gate(_).
#local tc(i64 A, i64 B) : edge(A, B) : tc(A, X), edge(X, B), !mark(X).
#local sym(i64 A, i64 B) : tc(A, B), tc(B, A), A != B.
#local odd(i64 A, i64 B) : edge(A, B) : even(A, X), edge(X, B).
#local even(i64 A, i64 B) : odd(A, X), edge(X, B).
#local lone(i64 A) : mark(A), !edge(A, _), open.
#local hop(i64 A, i64 C) : edge(A, B), edge(B, C), A < C.
#query q1(free i64 A, free i64 B) : sym(A, B). #query q2(free i64 A, free i64 B) : even(A, B). #query q3(free i64 A) : lone(A). #query q4(free i64 A, free i64 B) : hop(A, B).
#message out(i64 A, i64 B) @differential : tc(A, B), !mark(B).
"""
KEYS = ["tc", "sym", "even", "lone", "hop", "out"]


def brute(edges, marks, gates):
    tc = set(edges)
    while new := {(a, c) for a, b in tc for x, c in edges if x == b and (b,) not in marks} - tc:
        tc |= new
    odd, even = set(edges), set()
    while True:
        e = {(a, c) for a, b in odd for x, c in edges if x == b}
        o = set(edges) | {(a, c) for a, b in e for x, c in edges if x == b}
        if o <= odd and e <= even:
            break
        odd, even = odd | o, even | e
    return {"tc": tc, "sym": {(a, b) for a, b in tc if (b, a) in tc and a != b}, "even": even,
            "lone": {m for m in marks if gates and not any(a == m[0] for a, _ in edges)},
            "hop": {(a, c) for a, b in edges for x, c in edges if x == b and a < c}, "out": {(a, b) for a, b in tc if (b,) not in marks}}


def random_epochs(seed, n, nodes=6):
    rng = random.Random(seed)
    for _ in range(n):
        pick = lambda k, wide: [tuple(rng.randrange(nodes) for _ in range(wide)) for _ in range(rng.randrange(k))]
        yield {"edge": (pick(5, 2), pick(4, 2)), "mark": (pick(2, 1), pick(2, 1)), "gate": (pick(2, 1), pick(2, 1))}


@pytest.mark.parametrize("way,seeds,epochs", [(WAYS[0], range(25), 12), (WAYS[1], [1], 5), (WAYS[2], [1], 4)])
def test_random_epochs_equal_brute_force(spark, way, seeds, epochs):
    for seed in seeds:
        db, facts = make(spark, MIXED, way), {"edge": set(), "mark": set(), "gate": set()}
        before = {k: set() for k in KEYS}
        for batch in random_epochs(seed, epochs):
            db.batch(batch)
            for k, (a, r) in batch.items():
                facts[k] = (facts[k] | (set(a) - set(r))) - (set(r) - set(a))
            want = brute(facts["edge"], facts["mark"], facts["gate"])
            assert {k: db.fetch(k) for k in KEYS} == want
            assert db.published.fetch("out") == (want["out"] - before["out"], before["out"] - want["out"])
            before = want


def test_driver_state_is_bounded(spark, monkeypatch):
    from tidewater.plans import local, storage

    monkeypatch.setattr(storage, "LOCAL_LIMIT", 20)
    monkeypatch.setattr(local, "LOCAL_LIMIT", 20)
    db = make(spark, TC, FAST[0])
    edges = {(k, k + 1) for k in range(9)}
    db.send("add_edge", sorted(edges))
    assert db.fetch("tc") == closure(edges) and not db.state["tc/2"].is_local
    db.send("add_edge", None, [(4, 5)])
    assert db.fetch("tc") == closure(edges - {(4, 5)})


def test_streaming_epochs(spark, tmp_path):
    from tidewater.streaming.adapter import stream_into

    spark.createDataFrame([(1, 2, True), (2, 3, True), (3, 4, True)], "A long, B long, added boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    db = Database(TC, spark, on_publish=lambda name, df: seen.append((name, {tuple(r) for r in df.collect()}))).init()
    rows = spark.readStream.schema("A long, B long, added boolean").parquet(str(tmp_path / "in"))
    query = stream_into(db, "add_edge", rows, str(tmp_path / "at"))
    query.processAllAvailable()
    spark.createDataFrame([(2, 3, False), (4, 1, True)], "A long, B long, added boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    assert db.fetch("tc") == closure({(1, 2), (3, 4), (4, 1)})
    assert len(seen) == 2 and seen[1] == ("found", {(3, 1, True), (3, 2, True), (4, 1, True), (4, 2, True), (1, 3, False), (1, 4, False), (2, 3, False), (2, 4, False)})
