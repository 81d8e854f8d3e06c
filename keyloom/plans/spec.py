"""Table specifications and the derived target that the reconciliation queries compare with."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.session import read_table


@dataclass(frozen=True)
class TableSpec:
    """A keyed relation: key columns in order, labels of key columns that sort by declaration, written columns."""

    name: str
    key: tuple[str, ...]
    columns: tuple[str, ...]
    labels: dict = field(default_factory=dict)  # key column -> labels in declared order
    unique: tuple = ()  # of tuples of columns
    foreign: tuple = ()  # of (columns, parent table, parent columns)
    generated: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.key:
            raise ValueError(f"{self.name} has no primary key")
        if missing := set(self.key) - set(self.columns):
            raise ValueError(f"{self.name}: key columns {sorted(missing)} aren't columns")

    @property
    def writable(self) -> list[str]:
        return [c for c in self.columns if c not in self.generated]

    @property
    def values(self) -> list[str]:
        return [c for c in self.writable if c not in self.key]


ORDERS = TableSpec("orders", ("o_orderkey",), ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), foreign=((("o_custkey",), "customer", ("c_custkey",)),))
CONVERSATIONS = TableSpec("conversations", ("conv_id", "turn"), ("conv_id", "turn", "role", "text"))
#: Statuses in a declared order that isn't alphabetical.
STATUS_LABELS = ("P", "O", "F")
BY_STATUS = TableSpec("orders_by_status", ("o_orderstatus", "o_orderkey"), ("o_orderstatus", "o_orderkey", "o_totalprice"), labels={"o_orderstatus": STATUS_LABELS})
CUSTOMER = TableSpec("customer", ("c_custkey",), ("c_custkey", "c_name", "c_nationkey", "c_acctbal"), unique=(("c_name",),), foreign=((("c_nationkey",), "nation", ("n_nationkey",)),))


def source_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(*ORDERS.columns)


def target_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with some rows missing, some changed, some nulled and some that the source doesn't have."""
    o, k = source_orders(spark, sf_dir), F.col("o_orderkey")
    kept = o.where(k % 17 != 0).withColumns({
        "o_totalprice": F.when(k % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        "o_orderpriority": F.when(k % 29 != 0, F.col("o_orderpriority")),
    })
    return kept.unionByName(o.where(k % 19 == 0).withColumn("o_orderkey", k + 10_000_000))


TARGET_SQL = """
select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 13 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice,
  o_orderdate, case when o_orderkey % 29 = 0 then null else o_orderpriority end as o_orderpriority from orders where o_orderkey % 17 <> 0
union all select o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 19 = 0"""
SOURCE_SQL = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders"
