"""Star-schema tables read as if they were decoded artifacts, for queries that have an SQL twin.

events stand for event-log records, lineitem with orders for file-table rows,
supplier for the table of parent folders, pages for browser history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event ids that event types and values are spread over.
IDS = [4624, 4625, 4634, 4688, 4698, 1102, 7045, 22, 4104, 59, 5156, 4720, 106, 5858, 1024, 1116, 5140, 1, 3, 999]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(props: Column) -> Column:
    """The number in an event's properties."""
    return F.get_json_object(props, "$.k").cast("int")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with event_id, channel, provider, computer and a map of event data, as an event log has them."""
    e = table(spark, sf_dir, "events").withColumn("k", key_of(F.col("props")))
    ids = F.array(*(F.lit(i) for i in IDS))
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return e.select(
        F.col("event_id").alias("record_id"),
        "ts",
        "k",
        "user_id",
        F.element_at(ids, (F.col("k") % len(IDS) + 1).cast("int")).alias("event_id"),
        F.when(F.col("k") % 3 == 0, "Microsoft-Windows-TerminalServices-RDPClient/Operational").otherwise(F.initcap("event_type")).alias("channel"),
        F.when(F.col("k") % 4 == 1, "Microsoft-Windows-Sysmon").when(F.col("k") % 4 == 2, "Microsoft-Windows-TerminalServices").otherwise("Security").alias("provider"),
        F.concat(F.lit("host"), (F.col("user_id") % 7).cast("string")).alias("computer"),
        F.map_filter(
            F.create_map(
                F.lit("TargetUserName"), user,
                F.lit("CommandLine"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("cmd.exe /c "), "event_type")),
                F.lit("Image"), F.concat(F.lit("C:\\Windows\\"), "event_type", F.lit(".exe")),
                F.lit("LogonType"), (F.col("k") % 11).cast("string"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("event_data"),
    )


#: The same in DuckDB, as a common table expression named log.
EVENT_LOG_SQL = f"""log AS (
  SELECT event_id AS record_id, ts, k, user_id, ids[k % {len(IDS)} + 1] AS event_id,
    CASE WHEN k % 3 = 0 THEN 'Microsoft-Windows-TerminalServices-RDPClient/Operational' ELSE upper(event_type[1]) || event_type[2:] END AS channel,
    CASE k % 4 WHEN 1 THEN 'Microsoft-Windows-Sysmon' WHEN 2 THEN 'Microsoft-Windows-TerminalServices' ELSE 'Security' END AS provider,
    'host' || (user_id % 7) AS computer,
    'user' || user_id AS f_user,
    CASE WHEN k % 2 = 0 THEN 'cmd.exe /c ' || event_type END AS f_cmd,
    'C:\\Windows\\' || event_type || '.exe' AS f_image,
    CAST(k % 11 AS VARCHAR) AS f_logon
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, {IDS} AS ids FROM events))"""


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its orders as file-table rows: a number, a name, ticks of the four decisive times, named-stream mark."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"])

    def ticks(ts: str) -> Column:
        return F.unix_micros(F.col(ts).cast("timestamp")) * 10 + 116_444_736_000_000_000

    return j.select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("file"), F.col("l_partkey").cast("string"), F.lit(".txt")).alias("name"),
        F.col("l_suppkey").alias("parent"),
        F.col("l_shipdate").alias("si_created"),
        F.col("o_orderdate").alias("fn_created"),
        ticks("l_shipdate").alias("si_ticks"),
        (ticks("o_orderdate") + F.col("l_linenumber") * 1234).alias("fn_ticks"),
        (F.col("l_returnflag") == "R").alias("has_ads"),
        F.col("l_quantity").cast("long").alias("size"),
    )


FILE_ROWS_SQL = """files AS (
  SELECT l_orderkey, l_linenumber, 'file' || l_partkey || '.txt' AS name, l_suppkey AS parent,
    l_shipdate AS si_created, o_orderdate AS fn_created,
    epoch_us(l_shipdate) * 10 + 116444736000000000 AS si_ticks,
    epoch_us(o_orderdate) * 10 + 116444736000000000 + l_linenumber * 1234 AS fn_ticks,
    l_returnflag = 'R' AS has_ads, CAST(trunc(l_quantity) AS BIGINT) AS size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
