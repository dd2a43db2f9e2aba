"""Relations over the driver's tables that stand for samples, variants, labels, symbols and predictions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

SQL = {
    # customers and the brands they bought
    "brand_cells": "select distinct cast(o_custkey as string) as sample_id, p_brand as variant_id, 1 as value from {orders} join {lineitem} on o_orderkey = l_orderkey join {part} on l_partkey = p_partkey",
    "segment_labels": "select cast(c_custkey as string) as sample_id, c_mktsegment as label from {customer}",
    "debt_labels": "select cast(c_custkey as string) as sample_id, case when c_acctbal < 0 then 'neg' else 'pos' end as label from {customer}",
    # users and the days on which they did something
    "event_cells": "select distinct cast(user_id as string) as sample_id, concat(event_type, '_', cast(day(ts) as string)) as variant_id, 1 as value from {events}",
    # calls: several for a site of a sample, of which the last counts
    "raw_calls": "select cast(l_suppkey as string) as sample_id, l_orderkey * 10 + l_linenumber as line_no, l_returnflag as chrom, cast(l_partkey % 50 as int) as pos, substring('ACGT', cast(l_partkey % 50 % 4 + 1 as int), 1) as ref, substring('ACGT', cast((l_partkey + l_linenumber) % 4 + 1 as int), 1) as called, l_quantity as qual, cast(round(l_tax * 200) as int) as dp, abs(l_discount) as mq0f from {lineitem}",
    "symbols": "select cast(c_custkey as string) as sample_id, 'nation' as marker, cast(c_nationkey as string) as symbol from {customer} union all select cast(c_custkey as string), 'balance', case when c_acctbal < 0 then 'nd' when c_acctbal < 3000 then 'low' when c_acctbal < 6000 then 'mid' else 'high' end from {customer} union all select cast(o_custkey as string), 'priority', min(o_orderpriority) from {orders} group by o_custkey union all select cast(o_custkey as string), 'status', max(o_orderstatus) from {orders} group by o_custkey",
    "predictions": "select cast(user_id as string) as sample_id, event_type as label, cast(count(*) as double) / sum(count(*)) over (partition by user_id) as prob from {events} group by user_id, event_type",
    "regions": "select cast(p_partkey as int) as idx, cast(p_partkey * 10 as int) as start, cast(p_partkey * 10 + p_size % 12 as int) as `end` from {part} where p_size % 12 > 0",
    "places": "select distinct concat('v', cast(l_partkey * 7 % 20000 as string)) as variant_id, cast(l_partkey * 7 % 20000 + 1 as int) as pos from {lineitem}",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame; tables are read in place, so filters and columns reach the scans."""
    return spark.sql(SQL[name].format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def sql(name: str) -> str:
    """The same for an engine that has the tables by name."""
    return SQL[name].format(**{t: t for t in TABLES}).replace("`", '"').replace("as string", "as varchar")


def with_(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({sql(n)})" for n in names)
