"""Registering queries, and the tables in the roles that the operators expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (tables) under its name, with the same query as SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def hits(self) -> DataFrame:
        """rid, sid, ord, conprb: a line item may come from a part."""
        return self.lineitem.select(F.col("l_orderkey").alias("rid"), F.col("l_partkey").alias("sid"), F.col("l_linenumber").alias("ord"), (F.col("l_quantity") / 50).alias("conprb"))

    @property
    def targets(self) -> DataFrame:
        """sid, gene, iso, length."""
        return self.part.select(F.col("p_partkey").alias("sid"), F.col("p_brand").alias("gene"), F.col("p_type").alias("iso"), F.col("p_size").alias("length"))

    @property
    def spans(self) -> DataFrame:
        """id, chrom, start, end, strand, w: events as intervals in seconds."""
        start = F.floor(F.unix_micros(F.to_timestamp_ltz("ts")) / 1_000_000)
        e = self.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("chrom"), (start - 1704067200).cast("long").alias("start"), F.col("user_id"), F.col("value"))
        return e.withColumn("end", F.col("start") + 60 + F.floor(F.col("value") * 10).cast("long")).withColumn("strand", F.when(F.col("user_id") % 2 == 0, "+").otherwise("-"))

    @property
    def regions(self) -> DataFrame:
        """All spans, a minute later and three times as long."""
        return self.spans.select("id", "chrom", (F.col("start") + 60).alias("start"), (F.col("start") + 60 + 3 * (F.col("end") - F.col("start"))).alias("end"))

    @property
    def records(self) -> DataFrame:
        """qname, flag, rname, rnext, pos, mapq, ord: line items as alignment records."""
        l = F.col
        flag = (l("l_linenumber") % 2) + F.when(l("l_returnflag") == "R", 4).otherwise(0) + F.when(l("l_linestatus") == "O", 8).otherwise(0) + F.when(l("l_suppkey") % 2 == 0, 16).otherwise(32) + F.when(l("l_partkey") % 2 == 0, 64).otherwise(128) + F.when(l("l_quantity") > 45, 256).otherwise(0) + F.when(l("l_discount") > 0.095, 512).otherwise(0) + F.when(l("l_tax") > 0.075, 1024).otherwise(0) + F.when(l("l_quantity") < 3, 2048).otherwise(0) + F.when(l("l_linenumber") % 3 == 0, 2).otherwise(0)
        return self.lineitem.select(l("l_orderkey").alias("qname"), flag.cast("int").alias("flag"), (l("l_suppkey") % 25).alias("rname"), (l("l_partkey") % 25).cast("string").alias("rnext"), l("l_partkey").alias("pos"), l("l_quantity").cast("int").alias("mapq"), l("l_extendedprice").alias("score"))


# The same tables as SQL.
HITS = "select l_orderkey as rid, l_partkey as sid, l_linenumber as ord, l_quantity / 50 as conprb from lineitem"
TARGETS = "select p_partkey as sid, p_brand as gene, p_type as iso, p_size as length from part"
SPANS = """select event_id as id, event_type as chrom, s as start, s + 60 + cast(floor(value * 10) as bigint) as "end",
  case when user_id % 2 = 0 then '+' else '-' end as strand, user_id, value
  from (select *, cast(floor(epoch_us(ts) / 1000000.0) as bigint) - 1704067200 as s from events)"""
REGIONS = f"""select id, chrom, start + 60 as start, start + 60 + 3 * ("end" - start) as "end" from ({SPANS})"""
RECORDS = """select l_orderkey as qname, cast(l_linenumber % 2 + case when l_returnflag = 'R' then 4 else 0 end + case when l_linestatus = 'O' then 8 else 0 end
  + case when l_suppkey % 2 = 0 then 16 else 32 end + case when l_partkey % 2 = 0 then 64 else 128 end + case when l_quantity > 45 then 256 else 0 end
  + case when l_discount > 0.095 then 512 else 0 end + case when l_tax > 0.075 then 1024 else 0 end + case when l_quantity < 3 then 2048 else 0 end
  + case when l_linenumber % 3 = 0 then 2 else 0 end as int) as flag,
  l_suppkey % 25 as rname, cast(l_partkey % 25 as varchar) as rnext, l_partkey as pos, cast(l_quantity as int) as mapq, l_extendedprice as score from lineitem"""


def rsql(x: str, digits: int = 4) -> str:
    s = 10**digits
    return f"floor(({x}) * {s}.0 + 0.5) / {s}.0"
