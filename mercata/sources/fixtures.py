"""Stand-in entity tables derived from the TPC-H-like test tables.

Each view gives one entity schema of the commerce / credit / experiment data
model a stand-in built from the driver's parquet tables. The same views are
written in DuckDB SQL in ``mercata.plans.oracle`` so both engines see
identical inputs. All views are lazy DataFrames over the parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.functions.expressions import MONEY
from mercata.sources.tables import read_table


def _hours(n) -> F.Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _days(n) -> F.Column:
    return F.make_dt_interval(n.cast("int"))


@dataclass
class Fixtures:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def customers(self) -> DataFrame:
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                .join(r, n.n_regionkey == r.r_regionkey)
                .select(F.col("c_custkey").alias("customer_id"),
                        F.col("n_name").alias("customer_state"),
                        F.col("r_name").alias("customer_region")))

    @cached_property
    def items(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_extendedprice").cast(MONEY).alias("price"))

    @cached_property
    def orders(self) -> DataFrame:
        li = self.table("lineitem")
        q = li.groupBy("l_orderkey").agg(F.min("l_quantity").cast("int").alias("qmin"),
                                         F.max("l_quantity").cast("int").alias("qmax"))
        o = self.table("orders")
        key = F.col("o_orderkey")
        approved = F.col("o_orderdate") + _hours(key % 72)
        return (o.join(q, o.o_orderkey == q.l_orderkey, "left")
                .select(key.alias("order_id"),
                        F.col("o_custkey").alias("customer_id"),
                        F.when(F.col("o_orderstatus") == "F", "delivered")
                         .when(F.col("o_orderstatus") == "P", "shipped")
                         .otherwise("created").alias("order_status"),
                        F.col("o_orderdate").alias("purchase_ts"),
                        approved.alias("approved_ts"),
                        F.when(F.col("qmin").isNotNull(), approved + _days(F.col("qmin") % 7))
                         .alias("carrier_ts"),
                        F.when(F.col("qmax").isNotNull() & (key % 97 != 0),
                               F.col("o_orderdate") + _days(F.col("qmax")) + _hours(key % 24))
                         .alias("delivered_ts"),
                        (F.col("o_orderdate") + _days(F.lit(30))).alias("estimated_ts")))

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_partkey") % 50 != 0, F.col("p_brand")).alias("product_category_name"))

    @cached_property
    def translation(self) -> DataFrame:
        return (self.table("part").filter(F.col("p_brand") != "Brand#13")
                .select(F.col("p_brand").alias("product_category_name"),
                        F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
                        .alias("product_category_name_english"))
                .distinct())

    @cached_property
    def payments(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.lit(1).alias("payment_sequential"),
            F.col("o_orderpriority").alias("payment_type"),
            F.col("o_totalprice").cast(MONEY).alias("payment_value"))

    @cached_property
    def reviews(self) -> DataFrame:
        return (self.table("lineitem").filter(F.col("l_returnflag") != "N")
                .select(F.col("l_orderkey").alias("order_id"),
                        (F.lit(6) - F.ceil(F.col("l_quantity") / 10)).cast("int").alias("review_score")))

    @cached_property
    def applicants(self) -> DataFrame:
        li = self.table("lineitem")
        mix = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 31) % 200
        return li.select(
            "l_orderkey", "l_partkey", "l_suppkey",
            F.when(mix < F.col("l_quantity"), 1).otherwise(0).alias("target"),
            F.col("l_quantity").alias("f_utilisation"),
            F.col("l_discount").alias("f_debt"),
            F.col("l_tax").alias("f_rate"),
            F.when(F.col("l_partkey") % 10 != 0, F.col("l_extendedprice")).alias("f_income"),
            F.when(F.col("l_suppkey") % 20 == 0, F.col("l_linenumber")).otherwise(0).alias("f_late_count"))

    @cached_property
    def applicants_multi(self) -> DataFrame:
        """The same applicants with a default that depends on several features."""
        li = self.table("lineitem")
        mix = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 31) % 400
        cents = lambda c: F.round(F.col(c) * 100).cast("int")
        risk = F.col("l_quantity") + 5 * cents("l_discount") + 5 * cents("l_tax")
        return li.select(
            "l_orderkey", "l_partkey", "l_suppkey",
            F.when(mix < risk, 1).otherwise(0).alias("target"),
            F.col("l_quantity").alias("f_utilisation"),
            F.col("l_discount").alias("f_debt"),
            F.col("l_tax").alias("f_rate"),
            F.when(F.col("l_partkey") % 10 != 0, F.col("l_extendedprice")).alias("f_income"),
            F.when(F.col("l_suppkey") % 20 == 0, F.col("l_linenumber")).otherwise(0).alias("f_late_count"))

    @cached_property
    def ab(self) -> DataFrame:
        return self.table("events").select(
            (F.col("user_id") % 2 + 1).cast("int").alias("dmp_id"),
            "user_id",
            F.when(F.col("event_type") == "click", 1).otherwise(0).alias("click"))

    @cached_property
    def ab_many(self) -> DataFrame:
        """Three experiments over the same events; the third has no click at all."""
        return self.ab.select((F.col("user_id") % 3).cast("int").alias("experiment_id"), "dmp_id", "user_id",
                              F.when(F.col("user_id") % 3 == 2, 0).otherwise(F.col("click")).alias("click"))


# Fixture parameters (sf0.01 scale; FIXTURES.md).
AS_OF = "2002-01-01"
COHORT_CUTOFF = "2001-06"
APPLICANT_KEY = ("l_orderkey", "l_partkey", "l_suppkey")
APPLICANT_FEATURES = ("f_utilisation", "f_debt", "f_rate", "f_income", "f_late_count")
# Stand-ins for the reference's range filters (age > 0, utilisation < 13,
# debt ratio < 50) and median imputation of income.
APPLICANT_RANGES = (("f_utilisation", ">", 0.0), ("f_rate", "<", 13.0), ("f_debt", "<", 50.0))
APPLICANT_IMPUTE = ("f_income",)
