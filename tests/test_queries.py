"""Registered queries against DuckDB, demand, and plans."""

import duckdb
import pytest

from tidewater.catalogue import PROGRAMS, oracle_sql, queries
from tidewater.lang.ast import DatalogError
from tidewater.plans.demand import demand
from tidewater.plans.evaluate import evaluate, read_query
from tidewater.plans.program import Program
from tidewater.sources.tables import TABLES, bind

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, name):
    df, found = queries()[name](spark, SF), duck.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    key = sorted(columns)
    want = sorted(repr([r[columns.index(k)] for k in key]) for r in found.fetchall())
    assert sorted(repr([r[k] for k in key]) for r in df.collect()) == want


def test_projections_and_filters_reach_the_scan(spark, capsys):
    p = Program.parse(PROGRAMS["compare_constant"][0])
    df = evaluate(p, spark, bind(p, spark, SF))["q/2"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linenumber,1)" in plan and "EqualTo(l_linestatus,O)" in plan
    assert "l_shipdate" not in plan.split("ReadSchema")[1].split("\n")[0] and "l_comment" not in plan


def test_joins_are_equi_joins(spark):
    for name in ("join_pivot_3way", "join_five_way", "negate", "union"):
        p = Program.parse(PROGRAMS[name][0])
        plan = evaluate(p, spark, bind(p, spark, SF))["q/" + str(len(p.relations[p.key_of("q")].types))]._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


CHAINS = "#message edge(u64 A, u64 B). #local tc(u64 A, u64 B) : edge(A, B) : tc(A, X), edge(X, B). #query from(bound u64 A, free u64 B) : tc(A, B)."


def test_demand_keeps_answers_and_derives_less(spark):
    rows = [(k, k + 1) for k in range(1, 8)] + [(k, k + 1) for k in range(100, 120)]
    edges = spark.createDataFrame(rows, "A long, B long")
    full, part = Program.parse(CHAINS), demand(Program.parse(CHAINS))
    a = evaluate(full, spark, {"edge": edges})
    b = evaluate(part.program, spark, {"edge": edges} | part.seed(spark, A=3))
    assert {r.B for r in read_query(full, "from", a["from/2"], A=3).collect()} == {r.B for r in read_query(part.program, "from", b["from/2"], A=3).collect()} == {4, 5, 6, 7, 8}
    assert b["tc/2"].count() == 5 < a["tc/2"].count()


@pytest.mark.parametrize("text,message", [
    (CHAINS + "#query to(free u64 A, bound u64 B) : tc(A, B).", "exactly one query"),
    ("#message e(u64 A, u64 B). #message n(u64 A). #query q(bound u64 A, free u64 B) : e(A, B), !n(B).", "negation"),
    ("#functor count_u64(aggregate u64 V, summary u64 N). #message e(u64 A, u64 B). #query q(bound u64 A, free u64 N) : count_u64(B, N) over e(A, B).", "aggregates"),
    ("#message e(u64 A, u64 B). #local t(u64 A, u64 B) : e(A, B) : t(X, B), e(A, X). #query q(bound u64 A, free u64 B) : t(A, B), t(_, B).", "demanded"),
])
def test_demand_refuses_what_does_not_fit(text, message):
    with pytest.raises(DatalogError, match=message):
        demand(Program.parse(text))


def test_demand_leaves_free_queries_alone():
    p = Program.parse("#message e(u64 A). #query q(free u64 A) : e(A).")
    assert demand(p).program is p


def test_entry_has_the_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["Supplier", "Nation", "Region"]
    assert set(oracle_sql()) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
