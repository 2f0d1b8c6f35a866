"""The registered queries: programs over the test tables, and the same in DuckDB SQL.

Every query runs over its whole tables.  Relations are sets, so the SQL is DISTINCT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.registry import default_registry
from tidewater.plans.database import Database
from tidewater.plans.evaluate import evaluate, read_query
from tidewater.plans.program import Program
from tidewater.sources.tables import TABLES, bind

#: name -> (program, query to read, bound parameters, SQL)
PROGRAMS: dict[str, tuple[str, str, dict, str]] = {}


def _add(name: str, tables: str, text: str, query: str, sql: str, **bound) -> None:
    head = "\n".join(TABLES[t] for t in tables.split())
    PROGRAMS[name] = (head + "\n" + text, query, bound, sql)


_add("tuple_project", "orders", "#query q(free i64 Cust, free str Status) : orders(_, Cust, Status, _, _, _).", "q",
     "SELECT DISTINCT o_custkey AS Cust, o_orderstatus AS Status FROM orders")
_add("repeated_variable", "lineitem", """
#local pair(i64 A, i64 B) : lineitem(_, A, B, _, _, _, _, _, _, _, _).
#query q(free i64 N) : pair(N, N).""", "q",
     "SELECT DISTINCT l_partkey AS N FROM lineitem WHERE l_partkey = l_suppkey")
_add("compare_chain", "lineitem", """
#query q(free i64 Order, free i32 Line)
  : lineitem(Order, _, _, Line, Quantity, Price, Discount, _, _, _, _), Quantity > 45.0, Price < 60000.0, Discount != 0.0.""", "q",
     "SELECT DISTINCT l_orderkey AS \"Order\", l_linenumber AS Line FROM lineitem WHERE l_quantity > 45 AND l_extendedprice < 60000 AND l_discount <> 0")
_add("compare_constant", "lineitem", """
#query q(free i64 Order, free str Flag) : lineitem(Order, _, _, L, _, _, _, _, Flag, Status, _), L = 1, Status = "O".""", "q",
     "SELECT DISTINCT l_orderkey AS \"Order\", l_returnflag AS Flag FROM lineitem WHERE l_linenumber = 1 AND l_linestatus = 'O'")
_add("join_pivot_3way", "supplier nation region", """
#query q(free i64 Supplier, free str Nation, free str Region)
  : supplier(Supplier, _, N, _), nation(N, Nation, R), region(R, Region).""", "q",
     "SELECT DISTINCT s_suppkey AS Supplier, n_name AS Nation, r_name AS Region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_add("join_self", "nation", """
#query q(free str A, free str B) : nation(X, A, R), nation(Y, B, R), X < Y.""", "q",
     "SELECT DISTINCT a.n_name AS A, b.n_name AS B FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add("join_semi", "customer orders", """
#query q(free i64 Cust, free str Name) : customer(Cust, Name, _, _, _), orders(_, Cust, "F", _, _, _).""", "q",
     "SELECT DISTINCT c_custkey AS Cust, c_name AS Name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_add("join_five_way", "customer orders lineitem supplier nation", """
#query q(free str Nation, free i64 Supplier)
  : customer(C, _, N, _, _), orders(O, C, _, _, _, "1-URGENT"), lineitem(O, _, Supplier, _, _, _, _, _, "R", _, _), supplier(Supplier, _, N, _), nation(N, Nation, _).""", "q",
     "SELECT DISTINCT n_name AS Nation, s_suppkey AS Supplier FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey")
_add("product", "supplier region", """
#local pair(i64 S, i32 R).
pair(S, R) @product : supplier(S, _, _, _), region(R, _).
#query q(free i64 S, free i32 R) : pair(S, R).""", "q",
     "SELECT DISTINCT s_suppkey AS S, r_regionkey AS R FROM supplier, region")
_add("negate", "part lineitem", """
#local returned(i64 P) : lineitem(_, P, _, _, Quantity, _, _, _, "R", _, _), Quantity > 40.0.
#query q(free i64 P, free str Name) : part(P, Name, _, _, _, _), !returned(P).""", "q",
     "SELECT DISTINCT p_partkey AS P, p_name AS Name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
_add("negate_wildcard", "nation supplier", """
#local trade(i32 N, i64 S) : supplier(S, _, N, B), B > 5000.0.
#query q(free i32 N) : nation(N, _, _), !trade(N, _).""", "q",
     "SELECT DISTINCT n_nationkey AS N FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
_add("union", "supplier customer", """
#local keys(i32 N) : supplier(_, _, N, _) : customer(_, _, N, _, "BUILDING").
#query q(free i32 N) : keys(N).""", "q",
     "SELECT s_nationkey AS N FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("intersect_except", "supplier customer", """
#local rich(i32 N) : customer(_, _, N, B, _), B > 9000.0.
#local poor(i32 N) : supplier(_, _, N, B), B < 0.0.
#query q(free i32 N, free bool Both) : rich(N), poor(N), Both = true : rich(N), !poor(N), Both = false.""", "q",
     "WITH r AS (SELECT DISTINCT c_nationkey N FROM customer WHERE c_acctbal > 9000), p AS (SELECT DISTINCT s_nationkey N FROM supplier WHERE s_acctbal < 0) SELECT N, N IN (SELECT N FROM p) AS \"Both\" FROM r")
_add("facts", "region", """
#local wanted(i32 R, str Why).
wanted(1, "one"). wanted(3, "three"). wanted(99, "none").
#query q(free str Name, free str Why) : wanted(R, Why), region(R, Name).""", "q",
     "SELECT r_name AS Name, why AS Why FROM region JOIN (VALUES (1, 'one'), (3, 'three'), (99, 'none')) w(r, why) ON r = r_regionkey")
_add("enum_constant", "orders", """
#enum Status i32. #constant Status OPEN 1. #constant Status DONE 2.
#local coded(i64 O, Status S) : orders(O, _, "O", _, _, _), S = OPEN : orders(O, _, "F", _, _, _), S = DONE.
#query q(free i64 O) : coded(O, DONE).""", "q", "SELECT DISTINCT o_orderkey AS O FROM orders WHERE o_orderstatus = 'F'")
_add("agg_count", "orders", """
#functor count_i64(aggregate i64 V, summary i64 N) @invertible.
#query q(free i64 Cust, free i64 N) : count_i64(O, N) over (i64 Cust, i64 O) { orders(O, Cust, _, _, _, _) }.""", "q",
     "SELECT o_custkey AS Cust, count(DISTINCT o_orderkey) AS N FROM orders GROUP BY 1")
_add("agg_set", "lineitem", """
#functor sum_i64(aggregate i64 V, summary i64 N) @invertible.
#functor to_i64(bound f64 X, free i64 Y) @range(.).
#local qty(i64 Supp, i64 Q) : lineitem(_, _, Supp, _, X, _, _, _, _, _, _), to_i64(X, Q).
#query q(free i64 Supp, free i64 N) : sum_i64(Q, N) over qty(Supp, Q).""", "q",
     "SELECT s AS Supp, CAST(sum(q) AS BIGINT) AS N FROM (SELECT DISTINCT l_suppkey s, CAST(trunc(l_quantity) AS BIGINT) q FROM lineitem) GROUP BY 1")
_add("agg_min_max", "supplier nation", """
#functor min_f64(aggregate f64 V, summary f64 N) @recompute.
#functor max_f64(aggregate f64 V, summary f64 N) @recompute.
#query q(free str Nation, free f64 Low, free f64 High)
  : min_f64(B, Low) over (i32 K, f64 B) { supplier(_, _, K, B) }, max_f64(C, High) over (i32 K, f64 C) { supplier(_, _, K, C) }, nation(K, Nation, _).""", "q",
     "SELECT n_name AS Nation, min(s_acctbal) AS Low, max(s_acctbal) AS High FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
_add("agg_config", "orders customer", """
#functor count_above(bound f64 T, aggregate f64 V, summary i64 N) @invertible.
#query q(free i64 Cust, free i64 N)
  : count_above(T, V, N) over (i64 Cust, f64 T, f64 V) { customer(Cust, _, _, T, _), orders(_, Cust, _, V, _, _) }.""", "q",
     "SELECT c AS Cust, count(*) FILTER (WHERE v > t) AS N FROM (SELECT DISTINCT c_custkey c, c_acctbal t, o_totalprice v FROM customer JOIN orders ON o_custkey = c_custkey) GROUP BY c")
_add("kv_last", "events", """
#functor max_i64(bound i64 Old, bound i64 New, free i64 Out) @range(.) @recompute @commutative @associative @idempotent.
#local latest(i64 User, mutable(max_i64) Event).
latest(User, Event) : events(Event, _, User, _, _, _).
#query q(free i64 User, free str Type) : latest(User, E), events(E, _, User, Type, _, _).""", "q",
     "SELECT user_id AS User, max_by(event_type, event_id) AS Type FROM events GROUP BY 1".replace("AS User", 'AS "User"').replace("AS Type", 'AS "Type"'))
_add("functor_one", "part", """
#functor add_i32(bound i32 L, bound i32 R, free i32 Sum) @range(.).
#functor mul_i32(bound i32 L, bound i32 R, free i32 P) @range(.).
#query q(free i64 P, free i32 X) : part(P, _, _, _, Size, _), mul_i32(Size, 3, Y), add_i32(Y, -7, X), X > 0.""", "q",
     "SELECT DISTINCT p_partkey AS P, CAST(p_size * 3 - 7 AS INTEGER) AS X FROM part WHERE p_size * 3 - 7 > 0")
_add("functor_optional", "part", """
#functor div_i32(bound i32 L, bound i32 R, free i32 Q) @range(?).
#functor sub_i32(bound i32 L, bound i32 R, free i32 D) @range(.).
#query q(free i64 P, free i32 X) : part(P, _, _, _, Size, _), sub_i32(Size, 10, D), div_i32(100, D, X).""", "q",
     "SELECT DISTINCT p_partkey AS P, CAST(100 // (p_size - 10) AS INTEGER) AS X FROM part WHERE p_size <> 10".replace("100 // (p_size - 10)", "trunc(100.0 / (p_size - 10))"))
_add("functor_filter", "supplier", """
#functor is_even(bound i64 X).
#query q(free i64 S, free bool Even) : supplier(S, _, _, _), is_even(S), Even = true : supplier(S, _, _, _), @never is_even(S), Even = false.""", "q",
     "SELECT DISTINCT s_suppkey AS S, s_suppkey % 2 = 0 AS Even FROM supplier")
_add("functor_flatmap", "conversations", """
#functor words(bound str S, free str W) @range(*).
#functor count_i64(aggregate i64 V, summary i64 N) @invertible.
#local said(str Role, str W, i64 C) : conversations(C, _, Role, S), words(S, W).
#query q(free str Role, free str W, free i64 N) : count_i64(C, N) over said(Role, W, C).""", "q",
     r"SELECT role AS Role, w AS W, count(DISTINCT conv_id) AS N FROM (SELECT conv_id, role, unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS w FROM conversations) WHERE w <> '' GROUP BY 1, 2".replace("AS Role", 'AS "Role"'))
_add("functor_unify", "nation", """
#functor add_i32(bound i32 L, bound i32 R, free i32 S) @range(.).
#query q(free i32 A, free i32 B) : nation(A, _, R), nation(B, _, R), add_i32(A, 10, X), add_i32(B, 5, Y), X = Y.""", "q",
     "SELECT DISTINCT a.n_nationkey AS A, b.n_nationkey AS B FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey + 10 = b.n_nationkey + 5")
_TRADE = """
#local link(i32 A, i32 B) : supplier(S, _, A, SB), SB > 7500.0, lineitem(O, _, S, _, Q, _, _, _, _, _, _), Q > 48.0, orders(O, C, _, _, _, _), customer(C, _, B, CB, _), CB > 9000.0.
"""
_LINKS = "link AS (SELECT DISTINCT s_nationkey a, c_nationkey b FROM supplier JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 48 JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_acctbal > 9000 WHERE s_acctbal > 7500)"
_add("tc_trade", "supplier lineitem orders customer", _TRADE + """
#local tc(i32 A, i32 B) : link(A, B) : tc(A, X), tc(X, B).
#query q(free i32 A, free i32 B) : tc(A, B).""", "q",
     f"WITH RECURSIVE {_LINKS}, tc AS (SELECT a, b FROM link UNION SELECT tc.a, link.b FROM tc JOIN link ON tc.b = link.a) SELECT a AS A, b AS B FROM tc")
#: A tree over all parts, as deep as the logarithm of their number: each part that was ever
#: sold stands below the one of half its key.
_TREE = """
#functor div_i64(bound i64 L, bound i64 R, free i64 Q) @range(?).
#local sold(i64 P) : lineitem(_, P, _, _, _, _, _, _, _, _, _).
#local below(i64 P, i64 Q) : sold(P), div_i64(P, 2, Q), part(Q, _, _, _, _, _).
"""
_BELOW = "below AS (SELECT DISTINCT l_partkey p, l_partkey // 2 q FROM lineitem JOIN part ON p_partkey = l_partkey // 2)"
_add("tc_linear", "lineitem part", _TREE + """
#local tc(i64 P, i64 Q) : below(P, Q) : tc(P, X), below(X, Q).
#query q(free i64 P, bound i64 Q) : tc(P, Q).
#query q(bound i64 P, free i64 Q) : tc(P, Q).""", "q",
     f"WITH RECURSIVE {_BELOW}, tc AS (SELECT p, q FROM below UNION SELECT tc.p, below.q FROM tc JOIN below ON tc.q = below.p) SELECT p AS P FROM tc WHERE q = 1", Q=1)
_add("tc_tree", "lineitem part", _TREE + """
#local tc(i64 P, i64 Q) : below(P, Q) : tc(P, X), tc(X, Q).
#query q(free i64 P, free i64 Q) : tc(P, Q).""", "q",
     f"WITH RECURSIVE {_BELOW}, tc AS (SELECT p, q FROM below UNION SELECT tc.p, below.q FROM tc JOIN below ON tc.q = below.p) SELECT p AS P, q AS Q FROM tc")
_add("conv_reach", "conversations", """
#functor add_i64(bound i64 L, bound i64 R, free i64 S) @range(.).
#local step(i64 C, i64 T, i64 U) : conversations(C, T, _, _), add_i64(T, 1, U), conversations(C, U, _, _).
#local reach(i64 C, i64 T, i64 U) : step(C, T, U) : reach(C, T, X), reach(C, X, U).
#query q(free i64 C, free i64 T, free i64 U) : reach(C, T, U).""", "q",
     "WITH RECURSIVE s AS (SELECT DISTINCT a.conv_id c, a.turn t, b.turn u FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r AS (SELECT * FROM s UNION SELECT r.c, r.t, s.u FROM r JOIN s ON r.c = s.c AND r.u = s.t) SELECT c AS C, t AS T, u AS U FROM r")
_add("mutual_recursion", "conversations", """
#functor add_i64(bound i64 L, bound i64 R, free i64 S) @range(.).
#local even(i64 C, i64 T). #local odd(i64 C, i64 T).
even(C, 0) : conversations(C, 0, _, _).
odd(C, U) : even(C, T), add_i64(T, 1, U), conversations(C, U, _, _).
even(C, U) : odd(C, T), add_i64(T, 1, U), conversations(C, U, _, _).
#query q(free i64 C, free i64 T, free bool Odd) : even(C, T), Odd = false : odd(C, T), Odd = true.""", "q",
     "WITH RECURSIVE r AS (SELECT conv_id c, turn t FROM conversations WHERE turn = 0 UNION SELECT r.c, v.turn FROM r JOIN conversations v ON v.conv_id = r.c AND v.turn = r.t + 1) SELECT DISTINCT c AS C, t AS T, t % 2 = 1 AS Odd FROM r")
_add("recursive_negate", "lineitem part", _TREE + """
#local dead(i64 P) : part(P, _, _, _, Size, _), Size > 47.
#local live(i64 P) : part(P, _, _, _, _, _), P = 1 : live(Q), below(P, Q), !dead(P).
#query q(free i64 P) : live(P).""", "q",
     f"WITH RECURSIVE {_BELOW}, live AS (SELECT p_partkey p FROM part WHERE p_partkey = 1 UNION SELECT below.p FROM live JOIN below ON below.q = live.p WHERE below.p NOT IN (SELECT p_partkey FROM part WHERE p_size > 47)) SELECT p AS P FROM live")
_add("source_less_recursion", "customer", """
#local never_there(i64 X) : never_there(X).
#query q(free i64 C, free bool There) : customer(C, _, _, _, _), never_there(C), There = true : customer(C, _, _, _, _), !never_there(C), There = false.""", "q",
     "SELECT c_custkey AS C, false AS There FROM customer")
_add("fibonacci", "customer", """
#functor add_i64(bound i64 A, bound i64 B, free i64 Sum) @range(.).
#local fib(i64 N, i64 V).
fib(0, 0). fib(1, 1).
fib(N, V) : fib(P, PV), fib(Q, QV), add_i64(P, 1, X), add_i64(Q, 2, Y), N = X, N = Y, N < 60, add_i64(PV, QV, V).
#query q(free i64 C, free i64 V) : customer(C, _, _, _, _), fib(C, V).""", "q",
     "WITH RECURSIVE f AS (SELECT 0 n, CAST(0 AS BIGINT) a, CAST(1 AS BIGINT) b UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 59) SELECT c_custkey AS C, a AS V FROM customer JOIN f ON n = c_custkey")
_add("boolean_conjuncts", "orders", """
#local flagged(i64 O, bool Open) : orders(O, _, "O", _, _, _), Open = true : orders(O, _, "F", _, _, _), Open = false.
#query q(free i64 O, free str What) : flagged(O, Open), Open, What = "open" : flagged(O, Open), !Open, What = "closed" : flagged(O, _), false, What = "never".""", "q",
     "SELECT DISTINCT o_orderkey AS O, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS What FROM orders WHERE o_orderstatus IN ('O', 'F')")
_add("functor_several_free", "part", """
#functor halves(bound i64 X, free i64 Whole, free i64 Rest) @range(.).
#query q(free i64 P, free i64 Whole, free i64 Rest) : part(P, _, _, _, _, _), halves(P, Whole, Rest).""", "q",
     "SELECT DISTINCT p_partkey AS P, p_partkey // 2 AS Whole, p_partkey % 2 AS Rest FROM part")
_add("functor_several_patterns", "part", """
#functor twice(bound i64 X, free i64 Y) @range(.). #functor twice(free i64 X, bound i64 Y) @range(.).
#query q(free i64 A, free i64 B) : part(A, _, _, _, _, _), twice(A, B), B < 100 : part(B, _, _, _, _, _), twice(A, B), A > 900, A < 1000.""", "q",
     "SELECT DISTINCT p_partkey AS A, p_partkey * 2 AS B FROM part WHERE p_partkey * 2 < 100 UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey // 2 > 900 AND p_partkey // 2 < 1000")
_add("functor_constant", "nation", """
#functor add_i32(bound i32 L, bound i32 R, free i32 S) @range(.).
#query q(free i32 N, free str Name) : nation(N, Name, _), add_i32(7, 8, X), N < X.""".replace("N < X.", "N > X."), "q",
     "SELECT DISTINCT n_nationkey AS N, n_name AS Name FROM nation WHERE n_nationkey > 15")
_add("functor_inline", "nation", """
#functor capitals(bound str S, free str T) @range(.) @inline(```python upper```).
#query q(free i32 N, free str T) : nation(N, Name, _), capitals(Name, T).""", "q",
     "SELECT DISTINCT n_nationkey AS N, upper(n_name) AS T FROM nation")
_add("condition", "part labels", """
toxic_seen : labels(_, _, 1).
huge_seen : part(_, _, _, _, Size, _), Size > 1000.
#query q(free i64 P, free str Why)
  : toxic_seen, part(P, _, _, _, 1, _), Why = "toxic" : !toxic_seen, part(P, _, _, _, _, _), Why = "clean"
  : huge_seen, part(P, _, _, _, _, _), Why = "huge" : !huge_seen, part(P, _, _, _, 2, _), Why = "small".""", "q",
     "SELECT DISTINCT p_partkey AS P, why AS Why FROM part, (VALUES ('toxic', 1), ('small', 2)) w(why, size) WHERE p_size = size AND EXISTS (SELECT 1 FROM labels WHERE toxic = 1) AND NOT EXISTS (SELECT 1 FROM part WHERE p_size > 1000)")
_add("barrier", "customer orders nation", """
#query q(free i64 O, free str N) : orders(O, C, "P", _, _, _), customer(C, _, K, _, _), @barrier, nation(K, N, _).""", "q",
     "SELECT DISTINCT o_orderkey AS O, n_name AS N FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P'")
_add("document_flow", "documents labels", """
#functor length(bound str S, free i32 N) @range(.).
#functor lines(bound str S, free str L) @range(*).
#functor count_i64(aggregate i64 V, summary i64 N) @invertible.
#local good(i64 D) : labels(D, 1, 0).
#local line(str L, i64 D) : documents(D, S, "en", _, _), good(D), lines(S, L), length(L, N), N > 20.
#local shared(str L, i64 N) : count_i64(D, N) over line(L, D).
#query q(free str L, free i64 N) : shared(L, N), N > 1.""", "q",
     "SELECT l AS L, count(DISTINCT doc_id) AS N FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND lang = 'en') WHERE length(l) > 20 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")


def _halves(x: Column) -> Column:
    return F.struct(F.floor(x / 2).alias("whole"), (x % 2).alias("rest"))


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, query, bound, _ = PROGRAMS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        program = Program.parse(text, default_registry().map("halves", _halves).map("twice_bf", lambda x: x * 2).map("twice_fb", lambda y: _halves(y).getField("whole")))
        found = evaluate(program, spark, bind(program, spark, sf_dir))
        return read_query(program, query, found[program.key_of(query)], **bound)

    return run


# -- queries that need epochs --------------------------------------------------------
def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("O"), F.col("o_custkey").alias("C"))


_RETRACT = """
#message order(i64 O, i64 C) @differential.
#message ban(i64 C) @differential.
#functor count_i64(aggregate i64 V, summary i64 N) @invertible.
#local live(i64 O, i64 C) : order(O, C), !banned(C).
#local banned(i64 C) : ban(C).
#local per(i64 C, i64 N) : count_i64(O, N) over live(O, C).
#query rows(free i64 C, free i64 O) : live(O, C).
#query counts(free i64 C, free i64 N) : per(C, N).
#message change(i64 C, i64 O) @differential : live(O, C).
"""


def _retract_db(spark: SparkSession, sf_dir: str, mode: str = "incremental") -> Database:
    db, orders = Database(_RETRACT, spark, mode).init(), _orders(spark, sf_dir)
    db.send("order", orders)
    db.batch({"order": (None, orders.where("O % 3 = 0")), "ban": orders.where("C % 5 = 0").select("C").distinct()})
    db.send("ban", None, orders.where("C % 10 = 0").select("C").distinct())
    return db


def retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retract_db(spark, sf_dir).query("rows")


def retract_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retract_db(spark, sf_dir).query("counts")


def publish_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retract_db(spark, sf_dir).published["change"]


def never_remembers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers seen before they were blocked stay behind @never and leave behind !."""
    db = Database("""
#message feed(i64 C). #message block(i64 C).
#local blocked(i64 C) : block(C).
#local plain(i64 C) : feed(C), !blocked(C).
#local sticky(i64 C) : feed(C), @never blocked(C).
#query q(free i64 C, free bool Sticky) : plain(C), Sticky = false : sticky(C), Sticky = true.
""", spark).init()
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("C"))
    db.send("feed", c.where("C % 2 = 0"))
    db.send("block", c.where("C % 3 = 0"))
    db.send("feed", c)
    return db.query("q")


def recursive_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closure of the parts' tree after some of its edges went, by jobs and maintenance."""
    db = Database("""
#message below(i64 P, i64 Q) @differential. #message closed(i64 P) @differential.
#local tc(i64 P, i64 Q) : below(P, Q), !closed(P) : tc(P, X), tc(X, Q).
#query q(free i64 P, free i64 Q) : tc(P, Q).
""", spark, local=False).init()
    tree = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey > 1").select(F.col("p_partkey").alias("P"), F.floor(F.col("p_partkey") / 2).alias("Q"))
    db.batch({"below": tree, "closed": tree.where("P % 31 = 0").select("P")})
    db.batch({"below": (None, tree.where("P % 7 = 3")), "closed": (tree.where("P % 29 = 0").select("P"), tree.where("P % 62 = 0").select("P"))})
    return db.query("q")


def netting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one batch both adds and removes cancels out, whatever the state has."""
    db, orders = Database("#message order(i64 O, i64 C) @differential. #query q(free i64 O, free i64 C) : order(O, C).", spark).init(), _orders(spark, sf_dir)
    db.send("order", orders.where("O % 2 = 0"))
    db.send("order", orders.where("O % 3 = 0").union(orders.where("O % 3 = 0")), orders.where("O % 5 = 0"))
    return db.query("q")


def product_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net changes of a cross product of which both sides gain and lose rows at once."""
    db = Database("""
#message left(i64 S) @differential. #message right(i64 N) @differential.
#message pair(i64 S, i64 N) @differential @product : left(S), right(N).
""", spark).init()
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("S"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("N"))
    db.batch({"left": s.where("S % 2 = 0"), "right": n.where("N < 20")})
    db.batch({"left": (s.where("S % 4 = 1"), s.where("S % 4 = 0")), "right": (n.where("N >= 22"), n.where("N < 3"))})
    return db.published["pair"]


def forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that first send what they ask for."""
    db = Database("""
#message order(i64 O, i64 C). #message asked(i64 C).
#local theirs(i64 C, i64 O) : asked(C), order(O, C).
#query of(bound i64 C, free i64 O) : @first asked(C), theirs(C, O).
""", spark).init()
    db.send("order", _orders(spark, sf_dir))
    for c in (1, 4, 7):
        got = db.query("of", C=c)
    return db.relation("theirs").join(got, "O", "left").select("C", "O")


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that are refused, each with the words that name the reason."""
    from tidewater.lang.ast import DatalogError

    out = []
    for name, text, words in _REFUSED:
        try:
            Program.parse(text)
            out.append((name, False))
        except DatalogError as e:
            out.append((name, words in str(e)))
    return spark.createDataFrame(out, "program string, refused boolean")


_REFUSED = [
    ("impure", "#functor f(bound i32 X, free i32 Y) @impure.", "@impure"),
    ("undefined", "#message m(i32 X). #local p(i32 X). #query q(free i32 X) : m(X), p(X).", "no definition"),
    ("unused", "#message m(i32 X). #message n(i32 X). #query q(free i32 X) : m(X).", "never received"),
    ("lossy", "#message e(u64 A, u64 B) @differential. #message out(u64 A) : e(A, _).", "must be marked @differential"),
    ("lossy_never", "#message e(u64 A) @differential. #message m(u64 A). #query q(free u64 A) : m(A), @never e(A).", "@never cannot"),
    ("unstratified", "#message e(u64 A). #local p(u64 A) : e(A), !p(A). #query q(free u64 A) : p(A).", "depends on itself")]


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of two files, its graph as lines."""
    import os
    import tempfile

    from tidewater.lang.parser import load

    with tempfile.TemporaryDirectory() as at:
        for name, text in (("tables.dl", TABLES["nation"] + "\n" + TABLES["supplier"] + "\n"), ("main.dl", '#import "tables.dl".\n#local home(i32 N) : supplier(_, _, N, _).\n#local empty(i32 N) : nation(N, _, _), !home(N).\n#query q(free i32 N) : empty(N).\n')):
            with open(os.path.join(at, name), "w", encoding="utf-8") as f:
                f.write(text)
        program = Program(load(os.path.join(at, "main.dl")))
    return spark.createDataFrame([(x.strip(),) for x in program.to_dot().split("\n")[1:-1]], "edge string")


def demand_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts below one, materialising only what that part needs."""
    from tidewater.plans.demand import demand

    program = demand(Program.parse("""
#message below(i64 P, i64 Q).
#local over(i64 Q, i64 P) : below(P, Q) : over(Q, X), below(P, X).
#query q(bound i64 Q, free i64 P) : over(Q, P).
"""))
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("P"), F.floor(F.col("l_partkey") / 2).alias("Q"))
    tree = sold.join(spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("Q") == F.col("p_partkey"), "left_semi")
    found = evaluate(program.program, spark, {"below": tree} | program.seed(spark, Q=3))
    return read_query(program.program, "q", found[program.program.key_of("q")], Q=3)


_EPOCHS: dict[str, tuple[Callable, str]] = {
    "retract": (retract, "SELECT DISTINCT o_custkey AS C, o_orderkey AS O FROM orders WHERE o_orderkey % 3 <> 0 AND (o_custkey % 5 <> 0 OR o_custkey % 10 = 0)"),
    "retract_aggregate": (retract_aggregate, "SELECT o_custkey AS C, count(*) AS N FROM orders WHERE o_orderkey % 3 <> 0 AND (o_custkey % 5 <> 0 OR o_custkey % 10 = 0) GROUP BY 1"),
    "publish_changes": (publish_changes, "SELECT DISTINCT o_custkey AS C, o_orderkey AS O, true AS added FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 10 = 0"),
    "never_remembers": (never_remembers, "SELECT c_custkey AS C, false AS Sticky FROM customer WHERE c_custkey % 3 <> 0 UNION SELECT c_custkey, true FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0"),
    "demand_reach": (demand_reach, f"WITH RECURSIVE {_BELOW}, r AS (SELECT p FROM below WHERE q = 3 UNION SELECT below.p FROM r JOIN below ON below.q = r.p) SELECT p AS P FROM r"),
    "recursive_retract": (recursive_retract, "WITH RECURSIVE b AS (SELECT p_partkey p, p_partkey // 2 q FROM part WHERE p_partkey > 1 AND p_partkey % 7 <> 3 AND NOT (p_partkey % 29 = 0 OR p_partkey % 31 = 0 AND p_partkey % 62 <> 0)), tc AS (SELECT p, q FROM b UNION SELECT tc.p, b.q FROM tc JOIN b ON tc.q = b.p) SELECT p AS P, q AS Q FROM tc"),
    "netting": (netting, "SELECT DISTINCT o_orderkey AS O, o_custkey AS C FROM orders WHERE (o_orderkey % 2 = 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0)) OR (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)"),
    "product_changes": (product_changes, "WITH p AS (SELECT s_suppkey S, n_nationkey N FROM supplier, nation), x AS (SELECT S, N, S % 2 = 0 AND N < 20 AS was, (S % 4 = 1 OR S % 4 = 2) AND ((N >= 3 AND N < 20) OR N >= 22) AS now FROM p) SELECT S, CAST(N AS BIGINT) AS N, now AS added FROM x WHERE was <> now"),
    "forcing": (forcing, "SELECT DISTINCT o_custkey AS C, o_orderkey AS O FROM orders WHERE o_custkey IN (1, 4, 7)"),
    "diagnostics": (diagnostics, "SELECT * FROM (VALUES " + ", ".join(f"('{name}', true)" for name, _, _ in _REFUSED) + ") v(program, refused)"),
    "dumps": (dumps, """SELECT * FROM (VALUES ('"empty/1" -> "q/1";'), ('"home/1" -> "empty/1" [style=dashed];'), ('"nation/3" -> "empty/1";'), ('"supplier/4" -> "home/1";')) v(edge)"""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(name) for name in PROGRAMS} | {name: f for name, (f, _) in _EPOCHS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: p[3] for name, p in PROGRAMS.items()} | {name: sql for name, (_, sql) in _EPOCHS.items()}
