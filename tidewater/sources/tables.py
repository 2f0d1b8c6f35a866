"""Tables as messages: any DataFrame that Spark can read can feed a program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans.program import Program

#: Message declarations of the test tables; parameters are bound by position.
TABLES = {
    "region": "#message region(i32 Key, str Name).",
    "nation": "#message nation(i32 Key, str Name, i32 Region).",
    "customer": "#message customer(i64 Key, str Name, i32 Nation, f64 Balance, str Segment).",
    "supplier": "#message supplier(i64 Key, str Name, i32 Nation, f64 Balance).",
    "part": "#message part(i64 Key, str Name, str Brand, str Type, i32 Size, f64 Price).",
    "orders": "#message orders(i64 Key, i64 Customer, str Status, f64 Total, ts Date, str Priority).",
    "lineitem": "#message lineitem(i64 OrderKey, i64 Part, i64 Supplier, i32 Line, f64 Quantity, f64 Price, f64 Discount, f64 Tax, str ReturnFlag, str Status, ts ShipDate).",
    "events": "#message events(i64 Id, ts Time, i64 User, str Type, f64 Value, str Props).",
    "documents": "#message documents(i64 Doc, str Text, str Lang, str Source, i64 Chars).",
    "embeddings": "#message embeddings(i64 Vec, vec_f32 Embedding, i32 Label).",
    "pages": "#message pages(i64 Page, str Url, str Html).",
    "benchmark": "#message benchmark(i64 Item, str Text).",
    "labels": "#message labels(i64 Doc, i32 Quality, i32 Toxic).",
    "conversations": "#message conversations(i64 Conv, i64 Turn, str Role, str Text).",
}


def bind(program: Program, spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The received messages of a program that are named like test tables, as their tables."""
    return {r.decl.name: spark.read.parquet(f"{sf_dir}/{r.decl.name}.parquet") for k, r in program.relations.items() if r.kind == "message" and r.decl.name in TABLES and not program.rules_of(k)}


def read_facts(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A tab-separated fact file without a header; ``columns`` is a schema string."""
    return spark.read.csv(path, schema=columns, sep="\t")
