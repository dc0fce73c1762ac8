"""The library's queries by name, each with the DuckDB SQL that gives the same rows.

The star-schema tables stand for decoded artifacts (see ``plans.fixtures``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoscope import artifact_queries  # noqa: F401 (its queries)
from chronoscope.functions import text as X
from chronoscope.functions import times as T
from chronoscope.operators import anomaly, events, resolve, sigma, timeline
from chronoscope.plans import normalize
from chronoscope.plans.fixtures import EVENT_LOG_SQL, FILE_ROWS_SQL, IDS, event_log, file_rows, key_of, table
from chronoscope.registered import oracle_sql, queries, query  # noqa: F401
from chronoscope.sources import collection, sinks

def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


# Timeline: union, order, pages, search


def _event_rows(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for p in {"click": "FileAccess", "view": "FileModify", "signup": "UserLogon", "purchase": "FileCreate", "error": "LogCleared"}.items() for x in p))
    e = table(spark, d, "events")
    return e.select("event_id", "ts", micros("ts").alias("us"), timeline.event_code(F.element_at(kinds, F.col("event_type"))).alias("code"), F.concat(F.lit("C:\\Users\\u"), F.col("user_id").cast("string"), F.lit("\\"), "event_type").alias("path"))


EVENT_ROWS_SQL = r"""ev AS (
  SELECT event_id, ts, epoch_us(ts) AS us,
    CASE event_type WHEN 'click' THEN 'ACC' WHEN 'view' THEN 'MOD' WHEN 'signup' THEN 'LOGON' WHEN 'purchase' THEN 'CREATE' ELSE 'LogCleared' END AS code,
    'C:\Users\u' || user_id || '\' || event_type AS path
  FROM events)"""


@query(f"""WITH {EVENT_ROWS_SQL}
SELECT us, code, path, 24 AS stage, event_id AS rec FROM ev
UNION ALL SELECT epoch_us(o_orderdate), 'CREATE', 'order' || o_orderkey, 1, o_orderkey FROM orders
UNION ALL SELECT epoch_us(l_shipdate), 'MFT', 'line' || l_orderkey || '-' || l_linenumber, 3, l_orderkey FROM lineitem""")
def timeline_union(spark, d):
    e = _event_rows(spark, d).select("us", "code", "path", F.lit(24).alias("stage"), F.col("event_id").alias("rec"))
    o = table(spark, d, "orders").select(micros("o_orderdate").alias("us"), timeline.event_code(F.lit("FileCreate")).alias("code"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(1).alias("stage"), F.col("o_orderkey").alias("rec"))
    li = table(spark, d, "lineitem").select(micros("l_shipdate").alias("us"), timeline.event_code(F.lit("MftEntryModify")).alias("code"), F.format_string("line%s-%s", "l_orderkey", "l_linenumber").alias("path"), F.lit(3).alias("stage"), F.col("l_orderkey").alias("rec"))
    return timeline.union(e, o, li)


@query(f"WITH {EVENT_ROWS_SQL} SELECT event_id, us, code, path FROM ev ORDER BY us, event_id LIMIT 50 OFFSET 200")
def timeline_page(spark, d):
    return timeline.page(_event_rows(spark, d), 200, 50, "us", "event_id").select("event_id", "us", "code", "path")


@query(f"WITH {EVENT_ROWS_SQL} SELECT event_id, us, code FROM ev ORDER BY us DESC, event_id DESC LIMIT 10000")
def timeline_topk_desc(spark, d):
    return timeline.top(_event_rows(spark, d), 10000, F.desc("us"), F.desc("event_id")).select("event_id", "us", "code")


def _numbered(spark, d):
    return timeline.numbered(_event_rows(spark, d), "us", "event_id")


NUMBERED_SQL = f"{EVENT_ROWS_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS idx FROM ev)"


@query(f"WITH {NUMBERED_SQL} SELECT idx, event_id, us FROM numbered")
def row_index(spark, d):
    return _numbered(spark, d).select("idx", "event_id", "us")


@query(f"WITH {NUMBERED_SQL} SELECT idx, path FROM numbered WHERE contains(lower(path), 'u1\\pur')")
def search_matches(spark, d):
    return timeline.search(_numbered(spark, d), "U1\\PUR").select("idx", "path")


CURSOR_SQL = f"""{NUMBERED_SQL}, m AS (SELECT idx FROM numbered WHERE contains(lower(path), 'error')),
c AS (SELECT CAST(CASE WHEN count(*) FILTER (idx >= 300) > 0 THEN count(*) FILTER (idx < 300) ELSE 0 END AS BIGINT) AS cursor, count(*) AS matches FROM m)"""


@query(f"WITH {CURSOR_SQL} SELECT * FROM c")
def search_cursor(spark, d):
    return timeline.cursor(timeline.search(_numbered(spark, d), "ERROR"), 300)


@query(f"WITH {CURSOR_SQL} SELECT (cursor + 1) % matches AS next, (cursor - 1 + matches) % matches AS prev FROM c")
def next_prev(spark, d):
    c = search_cursor(spark, d)
    return c.select(timeline.step(F.col("cursor"), F.col("matches"), 1).alias("next"), timeline.step(F.col("cursor"), F.col("matches"), -1).alias("prev"))


def _kept(spark, d):
    from chronoscope.operators.kept_timeline import KeptTimeline

    return KeptTimeline(_event_rows(spark, d), "us", "event_id", rows_a_part=4096)


@query(f"WITH {NUMBERED_SQL} SELECT idx, event_id, us, code, path FROM numbered WHERE idx BETWEEN 300 AND 399")
def kept_page(spark, d):
    return _kept(spark, d).page(300, 100).select("idx", "event_id", "us", "code", "path")


@query(f"WITH {NUMBERED_SQL} SELECT idx, path FROM numbered WHERE contains(lower(path), 'u1\\pur')")
def kept_search(spark, d):
    return _kept(spark, d).search("U1\\PUR").select("idx", "path")


@query(f"WITH {CURSOR_SQL} SELECT * FROM c")
def kept_cursor(spark, d):
    return _kept(spark, d).cursor("ERROR", 300)


# Counts by day, hour and kind, each alone and together, in one pass.
@query("""SELECT CAST(dayofmonth(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, event_type, count(*) AS n,
  CAST(GROUPING(dayofmonth(ts), hour(ts), event_type) AS BIGINT) AS level
FROM events GROUP BY GROUPING SETS ((dayofmonth(ts), hour(ts)), (dayofmonth(ts)), (event_type), (dayofmonth(ts), event_type), ())""")
def timeline_histogram(spark, d):
    e = table(spark, d, "events").select(F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"), "event_type")
    return timeline.histogram(e, [("day", "hour"), ("day",), ("event_type",), ("day", "event_type"), ()])


@query("SELECT event_type, CAST(dayofmonth(ts) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY ALL")
def timeline_summary(spark, d):
    return timeline.summary(table(spark, d, "events").withColumn("day", F.dayofmonth("ts")), "event_type", "day")


# Event logs


@query("""WITH r AS (SELECT event_id, (1::BIGINT << (k % 16)) | (1::BIGINT << (user_id % 16)) AS reason
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
SELECT event_id, reason, CASE WHEN reason & 256 <> 0 THEN 'CREATE' WHEN reason & 512 <> 0 THEN 'DEL' WHEN reason & 12288 <> 0 THEN 'REN' WHEN reason & 7 <> 0 THEN 'MOD' WHEN reason & 2048 <> 0 THEN 'SEC' WHEN reason & 32768 <> 0 THEN 'ATTR' ELSE 'MOD' END AS code FROM r""")
def reason_to_event(spark, d):
    e = table(spark, d, "events").withColumn("k", key_of(F.col("props")))
    reason = F.expr("shiftleft(1L, cast(k % 16 as int)) | shiftleft(1L, cast(user_id % 16 as int))")
    return e.select("event_id", reason.alias("reason")).withColumn("code", events.reason_code(F.col("reason")))


CODE_SQL = """CASE
  WHEN provider LIKE '%Sysmon%' THEN CASE event_id WHEN 1 THEN 'PROC' WHEN 3 THEN 'NET' WHEN 8 THEN 'RemoteThread' WHEN 11 THEN 'CREATE' WHEN 12 THEN 'REG' WHEN 13 THEN 'REG' WHEN 14 THEN 'REG' ELSE 'Sysmon:' || event_id END
  WHEN event_id IN (4624, 4625) THEN 'LOGON' WHEN event_id IN (4634, 4647) THEN 'LOGOFF' WHEN event_id = 4688 THEN 'PROC'
  WHEN event_id IN (4698, 4702) THEN 'TASK' WHEN event_id IN (1102, 104) AND channel NOT LIKE '%RDPClient%' THEN 'LogCleared'
  WHEN event_id = 7045 THEN 'SVC' WHEN event_id BETWEEN 21 AND 25 AND provider LIKE '%TerminalServices%' THEN 'RDP'
  WHEN event_id = 4104 THEN 'EXEC' WHEN event_id IN (59, 60, 61) THEN 'BITS' WHEN event_id IN (5156, 5157) THEN 'NET'
  WHEN event_id = 4720 THEN 'AccountCreated' WHEN event_id = 4732 THEN 'GroupMemberAdd' WHEN event_id IN (106, 200, 201) THEN 'TASK'
  WHEN event_id BETWEEN 5857 AND 5861 THEN 'WmiActivity' WHEN event_id IN (1024, 1102) AND channel LIKE '%RDPClient%' THEN 'RDP'
  WHEN event_id IN (1116, 1117) THEN 'Defender' WHEN event_id IN (5140, 5145) THEN 'ShareAccess' ELSE 'EID:' || event_id END"""


@query(f"WITH {EVENT_LOG_SQL} SELECT record_id, event_id, {CODE_SQL} AS code FROM log")
def eventid_map(spark, d):
    return event_log(spark, d).select("record_id", "event_id", events.event_code().alias("code"))


@query(f"WITH {EVENT_LOG_SQL} SELECT * FROM (SELECT record_id, {CODE_SQL} AS event_code FROM log) WHERE event_code NOT LIKE 'EID:%'")
def interesting_only(spark, d):
    return events.interesting(event_log(spark, d).withColumn("event_code", events.event_code())).select("record_id", "event_code")


DESCRIBE_SQL = r"""CASE
  WHEN event_id = 4624 THEN '[Logon] \' || f_user || ' Type:' || f_logon || ' from -'
  WHEN event_id = 4625 THEN '[FailedLogon] \' || f_user || ' Type:' || f_logon || ' from -'
  WHEN event_id IN (4634, 4647) THEN '[Logoff] ' || f_user
  WHEN event_id = 4688 THEN '[Process] ?' || coalesce(' -> ' || f_cmd, '') || ' (?)'
  WHEN event_id = 7045 THEN '[Service] ? -> ?'
  WHEN event_id = 1102 AND channel LIKE '%RDPClient%' THEN '[RDPClient] Connected to ?'
  WHEN event_id IN (1102, 104) THEN '[LogCleared] ' || channel || ' on ' || computer
  WHEN event_id BETWEEN 21 AND 25 AND provider LIKE '%TerminalServices%' THEN '[RDP] ? from - (EID:' || event_id || ')'
  WHEN event_id = 4104 THEN '[PowerShell] ?'
  WHEN event_id IN (59, 60, 61) THEN '[BITS] ? (0 bytes)'
  WHEN event_id = 5156 THEN '[Net:Allowed] ?:? -> ?:? (?)'
  WHEN event_id = 5157 THEN '[Net:Blocked] ?:? -> ?:? (?)'
  WHEN event_id = 4720 THEN '[AccountCreated] \' || f_user || ' by ?'
  WHEN event_id = 1 AND provider LIKE '%Sysmon%' THEN '[Sysmon:Process] ' || f_image || coalesce(' -> ' || f_cmd, '') || ' (parent: , user: ?)'
  WHEN event_id = 3 AND provider LIKE '%Sysmon%' THEN '[Sysmon:Net] ' || f_image || ' ?:? -> ?:?'
  WHEN event_id = 106 THEN '[TaskRegistered] ? (user: )'
  WHEN event_id BETWEEN 5857 AND 5861 THEN '[WMI:' || event_id || ']  '
  WHEN event_id = 1024 AND channel LIKE '%RDPClient%' THEN '[RDPClient] Connecting to ?'
  WHEN event_id = 1116 THEN '[Defender:Detection] ? at '
  WHEN event_id IN (5140, 5145) THEN '[Share] ?\ by ? from -'
  ELSE '[EVT:' || channel || '] EID:' || event_id || ' on ' || computer END"""


@query(f"WITH {EVENT_LOG_SQL} SELECT record_id, {DESCRIBE_SQL} AS description FROM log")
def describe_event(spark, d):
    return event_log(spark, d).select("record_id", events.description().alias("description"))


@query(f"WITH {EVENT_LOG_SQL} SELECT * FROM (SELECT record_id AS rec_ord, {DESCRIBE_SQL} AS path, {CODE_SQL} AS event_code, epoch_us(ts) AS us FROM log) WHERE event_code NOT LIKE 'EID:%'")
def event_log_rows(spark, d):
    raw = event_log(spark, d).withColumn("rec_ord", F.col("record_id")).withColumn("time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return normalize.event_log(raw).select("rec_ord", "path", "event_code", F.unix_micros("primary_ts").alias("us"))


# Joins


@query("""WITH first AS (SELECT s_suppkey AS parent, min_by(s_name, s_suppkey) AS folder FROM supplier GROUP BY 1)
SELECT event_id, user_id AS parent, coalesce(folder || '\\' || event_type, event_type) AS path FROM events LEFT JOIN first ON user_id = parent""".replace("\\\\", "\\"))
def path_resolve_left(spark, d):
    folders = resolve.first_by_key(table(spark, d, "supplier").select(F.col("s_suppkey").alias("parent"), F.col("s_name").alias("folder")), "parent", "folder", "parent")
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("parent"), F.col("event_type").alias("name"))
    return resolve.resolve_parents(rows, folders, "parent", "folder", "name").select("event_id", "parent", "path")


@query("SELECT l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS nth FROM lineitem) WHERE nth = 1")
def path_map_first_wins(spark, d):
    return resolve.first_by_key(table(spark, d, "lineitem"), "l_partkey", "l_orderkey", "l_shipdate", "l_orderkey", "l_linenumber")


@query("SELECT l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS nth FROM lineitem) WHERE nth = 1")
def map_last_wins(spark, d):
    return resolve.last_by_key(table(spark, d, "lineitem"), "l_partkey", "l_orderkey", "l_shipdate", "l_orderkey", "l_linenumber")


@query(r"""WITH RECURSIVE nodes AS (SELECT p_partkey AS node, p_partkey // 3 AS parent, 'n' || p_partkey AS name FROM part),
walk(node, path, depth) AS (
  SELECT node, name, 1 FROM nodes WHERE parent = node
  UNION ALL SELECT n.node, w.path || '\' || n.name, w.depth + 1 FROM nodes n JOIN walk w ON n.parent = w.node WHERE n.parent <> n.node)
SELECT node, path, depth FROM walk""")
def parent_chain(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 3").alias("parent"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"))
    return resolve.parent_chain(nodes)


@query("""SELECT o_custkey, c_name, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM customer JOIN orders ON c_custkey = o_custkey) WHERE nth <= 100""")
def visits_join_limit(spark, d):
    found = resolve.visits(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", "c_nationkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 100)
    return found.select("o_custkey", "c_name", "o_orderkey")


@query("SELECT c_custkey, nullif(c_mktsegment, 'HOUSEHOLD') AS title, o_orderkey, epoch_us(o_orderdate) AS us FROM customer JOIN orders ON c_custkey = o_custkey WHERE epoch_us(o_orderdate) > 0")
def firefox_style_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("title"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").alias("us"))
    return c.join(o.where("us > 0"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "title", "o_orderkey", "us")


@query("SELECT event_id, coalesce(s_name, 'ID:' || user_id, '?') AS name FROM (SELECT event_id, nullif(user_id, 7) AS user_id FROM events) LEFT JOIN supplier ON user_id = s_suppkey")
def idmap_resolve(spark, d):
    rows = table(spark, d, "events").select("event_id", F.nullif(F.col("user_id"), F.lit(7)).alias("id"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("known"))
    return resolve.resolve_ids(rows, names, "id", "known").select("event_id", "name")


# Anomalies


FLAGS_SQL = f"""{FILE_ROWS_SQL}, flagged AS (
  SELECT *, (CASE WHEN si_ticks < fn_ticks THEN 1 ELSE 0 END) | (CASE WHEN si_ticks % 10000000 = 0 AND fn_ticks % 10000000 <> 0 THEN 2 ELSE 0 END)
    | (CASE WHEN has_ads THEN 128 ELSE 0 END) | (CASE WHEN size > 45 THEN 32 ELSE 0 END) AS flags FROM files)"""


def _flagged(spark, d):
    f = file_rows(spark, d)
    pair = (F.col("si_ticks"), F.col("fn_ticks"))
    flags = anomaly.si_before_fn(*pair).bitwiseOR(anomaly.zero_subseconds(pair)).bitwiseOR(anomaly.flag_when(F.col("has_ads"), 0x80)).bitwiseOR(anomaly.flag_when(F.col("size") > 45, 0x20))
    return f.withColumn("flags", flags)


@query(f"WITH {FLAGS_SQL} SELECT l_orderkey, l_linenumber, flags FROM flagged")
def anomaly_flags(spark, d):
    return _flagged(spark, d).select("l_orderkey", "l_linenumber", "flags")


def _labels_sql(labels, separator):
    return "concat_ws('" + separator + "', " + ", ".join(f"CASE WHEN flags & {bit} <> 0 THEN '{name}' END" for bit, name in labels) + ")"


@query(f"WITH {FLAGS_SQL} SELECT l_orderkey, l_linenumber, {_labels_sql(anomaly.CSV_LABELS, '|')} AS labels FROM flagged")
def anomaly_labels_csv(spark, d):
    return _flagged(spark, d).select("l_orderkey", "l_linenumber", anomaly.csv_labels(F.col("flags")).alias("labels"))


@query(f"WITH {FLAGS_SQL} SELECT l_orderkey, l_linenumber, {_labels_sql(anomaly.TABLE_LABELS, ',')} AS labels FROM flagged")
def anomaly_labels_table(spark, d):
    return _flagged(spark, d).select("l_orderkey", "l_linenumber", anomaly.table_labels(F.col("flags")).alias("labels"))


@query(f"WITH {FLAGS_SQL} SELECT l_orderkey, l_linenumber, {_labels_sql(anomaly.DETAIL_LABELS, ' | ')} AS labels FROM flagged")
def anomaly_labels_detail(spark, d):
    return _flagged(spark, d).select("l_orderkey", "l_linenumber", anomaly.detail_labels(F.col("flags")).alias("labels"))


@query("""SELECT event_id, CASE WHEN epoch_us(date_trunc('second', ts)) % 1000000 = 0 AND event_id % 3 = 0 AND epoch_us(ts) % 1000000 <> 0 THEN 2 ELSE 0 END AS flag FROM events""")
def zero_nanos(spark, d):
    e = table(spark, d, "events")
    si = F.when(F.col("event_id") % 3 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts"))
    return e.select("event_id", anomaly.zero_subseconds((T.ticks_of(si), T.ticks_of("ts"))).alias("flag"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_quantity > 40 THEN epoch_us(l_shipdate) END, CASE WHEN l_quantity > 20 THEN epoch_us(o_orderdate) END, 0) AS us
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def primary_ts_fallback(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.coalesce(F.when(F.col("l_quantity") > 40, micros("l_shipdate")), F.when(F.col("l_quantity") > 20, micros("o_orderdate")), F.lit(0)).alias("us"))


@query("SELECT s_suppkey, CASE WHEN NOT EXISTS (SELECT 1 FROM events WHERE user_id = s_suppkey AND event_type = 'signup') THEN 8 ELSE 0 END AS anomalies FROM supplier")
def no_usn_create(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.lit(0).alias("anomalies"))
    partners = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("s_suppkey"))
    return anomaly.without_partner(rows, partners, "s_suppkey", 0x08).select("s_suppkey", "anomalies")


@query("SELECT event_id, CASE WHEN NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id) THEN 64 ELSE 0 END AS anomalies FROM events WHERE event_type = 'click'")
def exec_no_prefetch(spark, d):
    rows = table(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id", F.lit(0).alias("anomalies"))
    return anomaly.without_partner(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id", 0x40).select("event_id", "anomalies")


# Detection rules


def _rule(condition: str, *selections: str, level: str = "medium", title: str = "rule") -> str:
    return f"title: {title}\nlevel: {level}\ndetection:\n" + "".join(f"  {s}\n" for s in selections) + f"  condition: {condition}\n"


#: Rules by query name, and the same condition in DuckDB over the fixture's event log.
RULES = {
    "sigma_exact": (_rule("sel", "sel: {EventID: 4624, Provider: security}"), "event_id = 4624 AND lower(provider) = 'security'"),
    "sigma_contains": (_rule("sel", "sel: {CommandLine|contains: EXE /C C}"), "contains(lower(f_cmd), 'exe /c c')"),
    "sigma_startswith": (_rule("sel", r"sel: {Image|startswith: 'c:\windows\p'}"), r"starts_with(lower(f_image), 'c:\windows\p')"),
    "sigma_endswith": (_rule("sel", "sel: {Image|endswith: '\\ERROR.exe'}"), r"ends_with(lower(f_image), '\error.exe')"),
    "sigma_re": (_rule("sel", "sel: {Image|re: '(click|view)[.]exe$'}"), "regexp_matches(f_image, '(click|view)[.]exe$')"),
    "sigma_all": (_rule("sel", "sel: {CommandLine|contains|all: [cmd, view]}"), "contains(lower(f_cmd), 'cmd') AND contains(lower(f_cmd), 'view')"),
    "sigma_or_list": (_rule("sel", "sel: {EventID: [4688, 7045, 22]}"), "event_id IN (4688, 7045, 22)"),
    "sigma_and_not": (_rule("sel and not flt", "sel: {Channel: click}", "flt: {LogonType: [1, 2, 3]}"), "lower(channel) = 'click' AND NOT f_logon IN ('1', '2', '3')"),
    "sigma_or": (_rule("a or b", "a: {LogonType: 10}", "b: {Computer: HOST3}"), "f_logon = '10' OR computer = 'host3'"),
    "sigma_parens": (_rule("(a or b) and not (c and a)", "a: {LogonType: 1}", "b: {LogonType: 2}", "c: {Computer: host1}"), "f_logon IN ('1', '2') AND NOT (computer = 'host1' AND f_logon = '1')"),
    "sigma_unknown_sel": (_rule("a or nothing", "a: {LogonType: 4}"), "f_logon = '4'"),
    "sigma_missing_field": (_rule("not a", "a: {CommandLine|contains: click}"), "NOT coalesce(contains(lower(f_cmd), 'click'), false)"),
    "sigma_trailing_tokens": (_rule("a and not 1 of flt_*", "a: {LogonType: 5}", "flt_x: {Computer: host1}"), "f_logon = '5'"),
    "sigma_empty_selection": (_rule("a and b", "a: [x, y]", "b: {LogonType: 6}"), "f_logon = '6'"),
    "sigma_numbers_as_text": (_rule("a", "a: {LogonType|startswith: 1}"), "starts_with(f_logon, '1')"),
}


def _sigma_query(name: str, text: str, sql: str) -> None:
    def run(spark, d):
        return event_log(spark, d).where(sigma.rule_sql(sigma.parse_rule(text))).select("record_id")

    run.__name__ = name
    query(f"WITH {EVENT_LOG_SQL} SELECT record_id FROM log WHERE {sql}")(run)


for _name, (_text, _sql) in RULES.items():
    _sigma_query(_name, _text, _sql)


@query(f"WITH {EVENT_LOG_SQL} SELECT record_id FROM log WHERE f_logon = '5' AND NOT (computer = 'host1' OR computer = 'host2')")
def sigma_one_of(spark, d):
    rule = sigma.parse_rule(_rule("a and not 1 of flt_*", "a: {LogonType: 5}", "flt_x: {Computer: host1}", "flt_y: {Computer: host2}"))
    return event_log(spark, d).where(sigma.rule_sql(rule, extended=True)).select("record_id")


def _batch() -> list[sigma.Rule]:
    levels = ["low", "medium", "high"]
    return [sigma.parse_rule(text.replace("title: rule", f"title: {name}").replace("level: medium", f"level: {levels[i % 3]}")) for i, (name, (text, _)) in enumerate(RULES.items())]


BATCH_SQL = f"""{EVENT_LOG_SQL}, hits AS (
  SELECT record_id, unnest([{', '.join(f"CASE WHEN {sql} THEN {i} END" for i, (_, sql) in enumerate(RULES.values()))}]) AS rule_ord FROM log),
detected AS (SELECT record_id, CAST(rule_ord AS INTEGER) AS rule_ord, {list(RULES)!r}[rule_ord + 1] AS rule_title, ['low', 'medium', 'high'][rule_ord % 3 + 1] AS rule_level FROM hits WHERE rule_ord IS NOT NULL)"""


@query(f"WITH {BATCH_SQL} SELECT record_id, rule_ord, rule_title, rule_level FROM detected")
def sigma_batch(spark, d):
    return sigma.detect(event_log(spark, d), _batch()).select("record_id", "rule_ord", "rule_title", "rule_level")


#: As many rules as a large published set has for one platform.
RULE_SET_SIZE = 2847
TYPES = ("click", "error", "purchase", "signup", "view")


def rule_set(n: int = RULE_SET_SIZE) -> list[sigma.Rule]:
    """Rules by a formula: by event id, by texts alone, by channel with an exception, and with two ways to fit."""
    rules = []
    for i in range(n):
        kind, word = TYPES[i // 4 % 5], "%s" % TYPES[i // 4 % 5].capitalize()
        user = i // 4
        body = (
            (f"sel: {{EventID: {IDS[i // 4 % len(IDS)]}, CommandLine|contains: '/C {kind}', Computer: HOST{i % 7}}}", "sel"),
            (f"sel: {{Image|endswith: '\\{kind}.EXE', TargetUserName: User{user}}}", "sel"),
            (f"sel: {{Channel: {word}, TargetUserName|endswith: r{user}}}\n  flt: {{LogonType: [{i % 11}, {(i + 3) % 11}]}}", "sel and not flt"),
            (f"a: {{CommandLine|contains|all: [cmd, {kind}], TargetUserName|startswith: user{user % 97}}}\n  b: {{EventID: [4624, {IDS[i // 4 % len(IDS)]}], Provider: microsoft-windows-sysmon, LogonType: {i % 11}, TargetUserName|contains: r{user % 50}}}", "a or b"),
        )[i % 4]
        rules.append(sigma.parse_rule(f"title: generated {i}\nlevel: {('low', 'medium', 'high')[i % 3]}\ndetection:\n  {body[0]}\n  condition: {body[1]}\n"))
    return rules


# Each rule's test again, from its number.
RULE_SET_SQL = f"""{EVENT_LOG_SQL}, numbers AS (
  SELECT i::INTEGER AS i, i // 4 AS u, {list(TYPES)}[i // 4 % 5 + 1] AS kind, {IDS}[i // 4 % {len(IDS)} + 1] AS id FROM range({RULE_SET_SIZE}) AS r(i)),
detected AS (SELECT record_id, i AS rule_ord, 'generated ' || i AS rule_title, ['low', 'medium', 'high'][i % 3 + 1] AS rule_level FROM log, numbers WHERE CASE i % 4
  WHEN 0 THEN event_id = id AND coalesce(contains(f_cmd, '/c ' || kind), false) AND computer = 'host' || i % 7
  WHEN 1 THEN f_image LIKE '%\\' || kind || '.exe' AND f_user = 'user' || u
  WHEN 2 THEN lower(channel) = kind AND ends_with(f_user, 'r' || u) AND NOT f_logon IN ((i % 11)::VARCHAR, ((i + 3) % 11)::VARCHAR)
  ELSE (coalesce(contains(f_cmd, 'cmd') AND contains(f_cmd, kind), false) AND starts_with(f_user, 'user' || u % 97))
    OR (event_id IN (4624, id) AND lower(provider) = 'microsoft-windows-sysmon' AND f_logon = (i % 11)::VARCHAR AND contains(f_user, 'r' || u % 50)) END)"""


@query(f"WITH {RULE_SET_SQL} SELECT record_id, rule_ord, rule_title, rule_level FROM detected")
def sigma_rule_set(spark, d):
    return sigma.detect(event_log(spark, d), rule_set()).select("record_id", "rule_ord", "rule_title", "rule_level")


@query(f"WITH {BATCH_SQL} SELECT rule_level, count(*) AS n FROM detected GROUP BY 1")
def detections_by_level(spark, d):
    return sigma.count_by_level(sigma.detect(event_log(spark, d), _batch()))


# Aggregates and windows


@query("SELECT p_type, p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS nth FROM part) WHERE nth = 1")
def dedup_type_name(spark, d):
    return resolve.first_rows(table(spark, d, "part").select("p_type", "p_brand", "p_partkey"), ["p_type", "p_brand"], "p_partkey")


@query("""WITH p AS (SELECT user_id, event_id, event_type = 'error' AS zero, event_type IN ('click', 'view') AS page FROM events),
n AS (SELECT *, lead(page) OVER w AS next_page, count(*) FILTER (page) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS pages FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, bool_or((NOT zero AND NOT page) OR (zero AND pages > 0 AND coalesce(next_page, false))) AS gap FROM n GROUP BY 1""")
def log_gap(spark, d):
    from chronoscope.sources.decoders import page_gaps

    p = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("page_no"), F.when(F.col("event_type") == "error", "zero").when(F.col("event_type").isin("click", "view"), "RCRD").otherwise("other").alias("kind"))
    return page_gaps(p).select(F.col("file").alias("user_id"), "gap")


@query("SELECT max(l_orderkey) AS max_lsn FROM lineitem")
def max_lsn(spark, d):
    return table(spark, d, "lineitem").agg(F.max("l_orderkey").alias("max_lsn"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def artifact_counts(spark, d):
    return timeline.summary(table(spark, d, "events"), "event_type")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS suspicious FROM events GROUP BY 1")
def suspicious_count(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("suspicious"))


# Collection paths


PATHS_SQL = r"""paths AS (SELECT page_id, CASE page_id % 6
  WHEN 0 THEN 'uploads/ntfs/%5C%5C.%5CC%3A/Users/u' || page_id || '/NTUSER.DAT'
  WHEN 1 THEN 'uploads/auto/C%3A/Windows/System32/config/SYSTEM'
  WHEN 2 THEN 'uploads/ntfs/%5C%5C.%5CC%3A/$Extend/$UsnJrnl%3A$J'
  WHEN 3 THEN 'uploads/auto/C%3A/Users/a+b/Recent/' || page_id || '.lnk'
  WHEN 4 THEN 'some/random/' || url
  ELSE 'uploads/auto/C%3A/$Recycle.Bin/$I' || page_id || '.txt' END AS original_path FROM pages),
decoded AS (SELECT page_id, url_decode(original_path) AS p FROM paths),
win AS (SELECT page_id, replace(CASE WHEN p LIKE 'uploads/ntfs/%' THEN 'C:\' || substr(p, 21) WHEN p LIKE 'uploads/auto/%' THEN substr(p, 14) END, '/', '\') AS windows_path FROM decoded)"""


def _paths(spark, d):
    p = F.col("page_id").cast("string")
    shapes = [
        F.concat(F.lit("uploads/ntfs/%5C%5C.%5CC%3A/Users/u"), p, F.lit("/NTUSER.DAT")),
        F.lit("uploads/auto/C%3A/Windows/System32/config/SYSTEM"),
        F.lit("uploads/ntfs/%5C%5C.%5CC%3A/$Extend/$UsnJrnl%3A$J"),
        F.concat(F.lit("uploads/auto/C%3A/Users/a+b/Recent/"), p, F.lit(".lnk")),
        F.concat(F.lit("some/random/"), "url"),
        F.concat(F.lit("uploads/auto/C%3A/$Recycle.Bin/$I"), p, F.lit(".txt")),
    ]
    return table(spark, d, "pages").select("page_id", F.element_at(F.array(*shapes), (F.col("page_id") % 6 + 1).cast("int")).alias("original_path"))


@query(f"WITH {PATHS_SQL} SELECT page_id, windows_path FROM win")
def normalize_paths(spark, d):
    return _paths(spark, d).select("page_id", collection.windows_path(F.col("original_path")).alias("windows_path"))


@query(f"""WITH {PATHS_SQL} SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'registry' WHEN 1 THEN 'registry' WHEN 2 THEN 'usnjrnl_j' WHEN 3 THEN 'lnk' WHEN 5 THEN 'recycle_bin' END AS artifact_class,
CASE page_id % 6 WHEN 0 THEN 'NtUser' WHEN 1 THEN 'System' END AS hive_type FROM win WHERE windows_path IS NOT NULL""")
def classify_paths(spark, d):
    return collection.manifest(_paths(spark, d), ordinal="page_id").select(F.col("ordinal").alias("page_id"), "artifact_class", "hive_type")


@query(f"WITH {PATHS_SQL} SELECT max_by(windows_path, page_id) AS windows_path, 'usnjrnl_j' AS artifact_class FROM win WHERE page_id % 6 = 2")
def single_artifacts(spark, d):
    return collection.singles(collection.manifest(_paths(spark, d), ordinal="page_id"))


@query(f"WITH {PATHS_SQL} SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'u' || page_id WHEN 3 THEN 'a+b' ELSE 'unknown' END AS username FROM win WHERE windows_path IS NOT NULL")
def username_from_path(spark, d):
    return collection.manifest(_paths(spark, d), ordinal="page_id").select(F.col("ordinal").alias("page_id"), "username")


@query("SELECT o_orderkey, 'Host_' || o_custkey AS host FROM orders")
def hostname_from_file(spark, d):
    name = F.concat(F.lit("Collection-Host_"), F.col("o_custkey").cast("string"), F.lit("-2025-08-10T03_41_20Z.zip"))
    return table(spark, d, "orders").select("o_orderkey", X.hostname(name).alias("host"))


# Scalars


@query("SELECT l_orderkey, l_linenumber, CASE WHEN t >= 116444736000000000 THEN (t - 116444736000000000) // 10 END AS us FROM (SELECT *, (epoch_us(l_shipdate) * 10 + 116444736000000007) * (l_linenumber % 4 > 0)::BIGINT AS t FROM lineitem)")
def filetime(spark, d):
    t = T.ticks_of("l_shipdate") + 7
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.unix_micros(T.filetime(F.when(F.col("l_linenumber") % 4 > 0, t).otherwise(0))).alias("us"))


@query("SELECT o_orderkey, CASE WHEN c > 0 AND c >= 11644473600000000 THEN c - 11644473600000000 END AS us FROM (SELECT o_orderkey, epoch_us(o_orderdate) + CASE WHEN o_orderkey % 5 = 0 THEN -epoch_us(o_orderdate) * 2 ELSE 11644473600000000 END AS c FROM orders)")
def chrome_time(spark, d):
    us = micros("o_orderdate")
    c = us + F.when(F.col("o_orderkey") % 5 == 0, -us * 2).otherwise(T.UNIX_EPOCH_CHROME)
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(T.chrome_time(c)).alias("us"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN epoch_us(o_orderdate) END AS us FROM orders")
def firefox_time(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(T.firefox_time(F.when(F.col("o_orderkey") % 5 > 0, micros("o_orderdate")).otherwise(0))).alias("us"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN epoch_us(o_orderdate) // 1000000 END AS s FROM orders")
def unix_time(spark, d):
    s = F.when(F.col("o_orderkey") % 5 > 0, F.floor(micros("o_orderdate") / 1000000)).otherwise(-1)
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(T.unix_time(s)).alias("s"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 BETWEEN 1 AND 12 THEN epoch_us(make_timestamp(2000 + o_orderkey % 20, o_orderkey % 13, 1 + o_orderkey % 28, o_orderkey % 24, o_orderkey % 60, CAST(o_orderkey % 60 AS DOUBLE))) END AS us FROM orders")
def systemtime(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(T.systemtime(*(x.cast("int") for x in (2000 + k % 20, k % 13, 1 + k % 28, k % 24, k % 60)), (k % 60).cast("decimal(8,6)"))).alias("us"))


@query("SELECT event_id, epoch_us(ts) * 10 + 116444736000000000 + event_id % 10 AS ticks FROM events")
def iso_ticks(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), (F.col("event_id") % 10).cast("string"), F.lit("Z"))
    return table(spark, d, "events").select("event_id", T.iso_ticks(text).alias("ticks"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN epoch_us(o_orderdate) END AS us FROM orders")
def inventory_dates(spark, d):
    k, ts = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(ts, "MM/dd/yyyy HH:mm:ss")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(T.one_of_formats(text, *T.INVENTORY_FORMATS)).alias("us"))


@query("SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS name FROM part")
def rot13(spark, d):
    return table(spark, d, "part").select("p_partkey", X.rot13(F.col("p_name")).alias("name"))


@query(r"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'C:\x\' || p_name ELSE p_name END AS path FROM part")
def device_path(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("\\Device\\HarddiskVolume"), (F.col("p_partkey") % 9).cast("string"), F.lit("\\x\\"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.device_path(raw).alias("path"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN format('{:016x}', o_orderkey) END AS app_id FROM orders")
def app_id(spark, d):
    name = F.concat(F.lit("C:\\Recent\\"), F.lpad(F.hex("o_orderkey"), 16, "0"), F.when(F.col("o_orderkey") % 2 == 0, ".automaticDestinations-ms").otherwise("x.ms"))
    return table(spark, d, "orders").select("o_orderkey", X.app_id(name).alias("app_id"))


@query(r"SELECT page_id, regexp_extract(url, '[^\\/]*$') AS name FROM pages")
def basename(spark, d):
    return table(spark, d, "pages").select("page_id", X.basename(F.col("url")).alias("name"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Firefox' WHEN 1 THEN 'Edge' WHEN 2 THEN 'Firefox' ELSE 'Chrome' END AS browser FROM events")
def browser_detect(spark, d):
    path = F.element_at(F.array(*(F.lit(x) for x in ("c:/Mozilla/x", "c:/EDGE/History", "c:/edge/firefox", "c:/other/History"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.browser(path).alias("browser"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN props ELSE repeat('x', 100) || '...' END AS app FROM events")
def app_name_json(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('[{"platform":"y"},{"application":"'), "event_type", F.lit('"}]'))).when(k == 1, F.col("props")).otherwise(F.repeat(F.lit("x"), 150))
    return table(spark, d, "events").select("event_id", X.activity_app(raw).alias("app"))


@query("""WITH v AS (SELECT o_orderkey, o_orderkey * o_custkey * 37 AS n FROM orders),
u AS (SELECT *, CASE WHEN n >= 1024 * 1024 * 1024 THEN 3 WHEN n >= 1024 * 1024 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS step FROM v),
t AS (SELECT *, CAST(round_even(CAST(n * 10 AS DECIMAL(38, 12)) / CAST(pow(1024, step) AS BIGINT), 0) AS BIGINT) AS tenths FROM u)
SELECT o_orderkey, CASE step WHEN 0 THEN n || ' B' ELSE (tenths // 10) || '.' || (tenths % 10) || ' ' || ['KB', 'MB', 'GB'][step] END AS shown FROM t""")
def humanize_bytes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey * o_custkey * 37").alias("n")).select("o_orderkey", X.humanized("n").alias("shown"))


@query("SELECT event_id, CASE k WHEN 0 THEN 'Boot' WHEN 1 THEN 'System' WHEN 2 THEN 'Auto' WHEN 3 THEN 'Manual' WHEN 4 THEN 'Disabled' ELSE 'Unknown' END AS start, CASE k WHEN 6 THEN 'Wired' WHEN 23 THEN 'VPN' WHEN 71 THEN 'Wireless' ELSE 'Unknown' END AS network, CASE k WHEN 5 THEN 'Open' WHEN 6 THEN 'Focus' WHEN 16 THEN 'Clipboard' ELSE 'Type:' || k END AS activity FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def code_labels(spark, d):
    k = key_of(F.col("props"))
    return table(spark, d, "events").select("event_id", X.start_type(k).alias("start"), X.network_type(k).alias("network"), X.activity_type(k).alias("activity"))


@query("SELECT page_id, CASE WHEN length(url) <= 20 THEN url ELSE '...' || right(url, 17) END AS path FROM pages")
def truncate_path(spark, d):
    return table(spark, d, "pages").select("page_id", X.truncated(F.col("url"), 20).alias("path"))


# Rows out of values


@query(r"SELECT doc_id, CAST(n AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, trim(unnest(l), chr(32) || chr(9) || chr(13)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''")
def history_lines(spark, d):
    from chronoscope.sources.decoders import text_lines

    return text_lines(table(spark, d, "documents"), "text", "doc_id")


@query("""WITH runs AS (SELECT user_id, list(epoch_us(ts) * (event_id % 5 > 0)::BIGINT ORDER BY event_id) AS r FROM events GROUP BY 1)
SELECT user_id, unnest(list_filter(r, lambda x: x <> 0)) AS us, len(list_filter(r, lambda x: x <> 0)) AS run_count FROM runs""")
def explode_run_times(spark, d):
    return counted_runs(table(spark, d, "events"))


def counted_runs(events: DataFrame) -> DataFrame:
    """Every run's time with the number of its user's runs; no user's rows are gathered in one place."""
    runs = events.where(F.col("event_id") % 5 > 0).select("user_id", micros("ts").alias("us")).where("us <> 0")
    counts = runs.groupBy(F.col("user_id").alias("counted_user")).agg(F.count("*").alias("run_count"))
    return runs.join(counts, F.col("user_id").eqNullSafe(F.col("counted_user"))).select("user_id", "us", "run_count")


@query("""WITH p AS (SELECT o_custkey, min(epoch_us(o_orderdate)) AS a, nullif(max(epoch_us(o_orderdate)), min(epoch_us(o_orderdate))) AS b FROM orders GROUP BY 1)
SELECT o_custkey, 'FirstConnect' AS what, a AS us FROM p UNION ALL SELECT o_custkey, 'LastConnect', b FROM p WHERE b IS NOT NULL""")
def first_last_events(spark, d):
    ends = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.nullif(F.max("o_orderdate"), F.min("o_orderdate")).alias("last"))
    return normalize.connections(ends).select("o_custkey", "what", micros("ts").alias("us"))


@query("""WITH o AS (SELECT user_id, list(k ORDER BY event_id) AS mru FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_id % 3 = 0 GROUP BY 1)
SELECT event_id, CAST(coalesce(list_position(mru, k) - 1, k) AS INTEGER) AS position FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) JOIN o USING (user_id)""")
def mru_position(spark, d):
    e = table(spark, d, "events").withColumn("k", key_of(F.col("props")))
    return mru_positions(e)


def mru_positions(e: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """The first place of each event's k among its user's third events, numbered within stretches of ids and over the stretches' counts."""
    third = e.where("event_id % 3 = 0").select("user_id", "event_id", "k", F.floor(F.col("event_id") / stretch).alias("stretch"))
    counts = third.groupBy("user_id", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("user_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("user_id", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("user_id", "stretch").orderBy("event_id", "k")) - 1
    first = third.withColumn("inside", inside).groupBy("user_id", "stretch", "k").agg(F.min("inside").alias("inside"))
    first = first.join(bases, ["user_id", "stretch"]).groupBy("user_id", "k").agg(F.min(F.col("base") + F.col("inside")).alias("first"))
    known = e.join(counts.select("user_id").distinct(), "user_id", "left_semi")
    return known.join(first, ["user_id", "k"], "left").select("event_id", F.coalesce("first", "k").cast("int").alias("position"))


@query("""WITH s AS (SELECT p_partkey, p_size, p_size % 7 AS start, p_partkey % 3 AS control_set, p_partkey % 11 AS host FROM part WHERE coalesce(nullif(p_size % 7, 6), 3) <= 2)
SELECT p_partkey, CAST(start AS INTEGER) AS start FROM (SELECT *, rank() OVER (PARTITION BY host ORDER BY control_set) AS r FROM s) WHERE r = 1""")
def services_autostart(spark, d):
    s = table(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size") % 7, F.lit(6)).alias("start"), F.col("p_name").alias("image_path"), (F.col("p_partkey") % 3).alias("control_set"), (F.col("p_partkey") % 11).alias("host"))
    return normalize.started_services(s, "host").select("p_partkey", F.col("start").cast("int").alias("start"))


# Sinks


def _timeline_rows(spark, d) -> DataFrame:
    """events and their values as full timeline rows."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    none = F.lit(None).cast("timestamp")
    si = F.when(F.col("event_id") % 3 > 0, F.col("t"))
    times = ["si_created", "si_modified", "si_accessed", "si_entry_modified", "fn_created", "fn_modified", "fn_accessed", "fn_entry_modified"]
    values = [si, si, si - F.expr("interval 1 second"), si, none, none, F.col("t"), none]
    source = F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("Mft").alias("kind"), F.lit(None).cast("string").alias("detail"))).otherwise(F.struct(F.lit("Evtx").alias("kind"), F.col("event_type").alias("detail")))
    return e.select(
        F.when(F.col("event_id") % 2 == 0, "MftEntry").otherwise("Generated").alias("entity_kind"),
        F.col("event_id").alias("entity_num"),
        F.concat(F.lit("C:\\d\\"), "event_type").alias("path"),
        F.col("t").alias("primary_ts"),
        T.ticks_of("t").alias("primary_ticks"),
        F.when(F.col("event_id") % 7 == 0, "LogCheckpoint").otherwise("FileCreate").alias("event_kind"),
        F.when(F.col("event_id") % 7 == 0, "LogCheckpoint").otherwise("CREATE").alias("event_code"),
        F.struct(*(v.alias(n) for n, v in zip(times, values))).alias("timestamps"),
        F.struct((T.ticks_of(si) + F.col("event_id") % 10).alias("si_created")).alias("ticks"),
        F.array(source).alias("sources"),
        (F.col("event_id") % 256).cast("int").alias("anomalies"),
        F.struct(F.nullif(F.col("user_id"), F.lit(0)).alias("file_size"), F.when(F.col("event_id") % 4 == 1, F.col("user_id")).alias("mft_entry_number"), (F.col("event_id") % 9).cast("int").alias("mft_sequence"), (F.col("event_id") % 5 == 0).alias("is_directory"), F.lit(None).cast("string").alias("sha256")).alias("metadata"),
        F.lit(1).alias("stage"),
        F.lit(0).alias("file_ord"),
        F.col("event_id").alias("rec_ord"),
    )


_MS = "'%Y-%m-%d %H:%M:%S.%g'"
_FLAGS = _labels_sql(anomaly.CSV_LABELS, "|").replace("flags &", "(event_id % 256) &")


@query(rf"""SELECT strftime(ts, {_MS}) AS "Timestamp", CASE WHEN event_id % 7 = 0 THEN 'LogCheckpoint' ELSE 'CREATE' END AS "Event", 'C:\d\' || event_type AS "Path", CASE WHEN event_id % 2 = 0 THEN 'MFT' ELSE 'EVT:' || event_type END AS "Sources", {_FLAGS} AS "Anomalies",
  coalesce(strftime(si, {_MS}), '') AS "SI_Created", coalesce(strftime(si, {_MS}), '') AS "SI_Modified", coalesce(strftime(si - INTERVAL 1 SECOND, {_MS}), '') AS "SI_Accessed", coalesce(strftime(si, {_MS}), '') AS "SI_EntryMod",
  '' AS "FN_Created", '' AS "FN_Modified", strftime(ts, {_MS}) AS "FN_Accessed", '' AS "FN_EntryMod",
  CASE WHEN event_id % 4 = 1 THEN user_id::VARCHAR ELSE '' END AS "MFT_Entry", coalesce(nullif(user_id, 0)::VARCHAR, '') AS "FileSize", CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END AS "IsDir"
FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN ts END AS si FROM events)""")
def csv_export_rows(spark, d):
    return sinks.csv_rows(_timeline_rows(spark, d))


_SECONDS = "'%Y-%m-%d %H:%M:%S'"


@query(rf"""SELECT event_id AS entity_num, 'C:\d\' || event_type AS path,
  CASE WHEN event_id % 4 = 1 THEN 'Entry ' || user_id || ' Seq ' || (event_id % 9) || CASE WHEN user_id = 0 THEN '' WHEN user_id < 1024 THEN '  Size: ' || user_id || ' B' ELSE '  Size: ' || (tenths // 10) || '.' || (tenths % 10) || ' KB' END || CASE WHEN event_id % 5 = 0 THEN ' [DIR]' ELSE '' END END AS file,
  'C:' || si || ' M:' || si || ' A:' || earlier || ' E:' || si AS si, 'C:- M:- A:' || strftime(ts, {_SECONDS}) || ' E:-' AS fn,
  CASE WHEN event_id % 256 <> 0 THEN {_labels_sql(anomaly.DETAIL_LABELS, " | ").replace("flags &", "(event_id % 256) &")} END AS flags
FROM (SELECT *, CAST(round_even(user_id * 10 / 1024, 0) AS BIGINT) AS tenths,
  CASE WHEN event_id % 3 > 0 THEN strftime(ts, {_SECONDS}) ELSE '-' END AS si, CASE WHEN event_id % 3 > 0 THEN strftime(ts - INTERVAL 1 SECOND, {_SECONDS}) ELSE '-' END AS earlier FROM events)""")
def detail_lines(spark, d):
    return timeline.details(_timeline_rows(spark, d), "entity_num")


@query(r"""SELECT '0|C:\d\' || event_type || ' (' || CASE WHEN event_id % 2 = 0 THEN 'MFT' ELSE 'EVT:' || event_type END || ')|' ||
  CASE WHEN event_id % 2 = 0 THEN event_id || '-' || event_id % 9 WHEN event_id % 4 = 1 THEN user_id || '-' || event_id % 9 ELSE '0' END || '||0|0|' || user_id || '|' ||
  CASE WHEN si THEN s - 1 ELSE -1 END || '|' || s || '|' || CASE WHEN si THEN s ELSE -1 END || '|' || CASE WHEN si THEN s ELSE -1 END AS line
FROM (SELECT *, event_id % 3 > 0 AS si, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)""")
def bodyfile_rows(spark, d):
    return sinks.bodyfile_rows(_timeline_rows(spark, d))


@query(r"""SELECT '{"entity_id":{"' || CASE WHEN event_id % 2 = 0 THEN 'MftEntry' ELSE 'Generated' END || '":' || event_id || '},"path":"C:\\d\\' || event_type || '","primary_timestamp":"' || t || '","event_type":' || CASE WHEN event_id % 7 = 0 THEN '{"Other":"LogCheckpoint"}' ELSE '"FileCreate"' END || ',"timestamps":{"si_created":' || sc || ',"si_modified":' || si || ',"si_accessed":' || sa || ',"si_entry_modified":' || si || ',"fn_created":null,"fn_modified":null,"fn_accessed":"' || t || '","fn_entry_modified":null},"sources":[' ||
  CASE WHEN event_id % 2 = 0 THEN '"Mft"' ELSE '{"Evtx":"' || event_type || '"}' END || '],"anomalies":' || event_id % 256 || ',"metadata":{"file_size":' || coalesce(nullif(user_id, 0)::VARCHAR, 'null') || ',"mft_entry_number":' || CASE WHEN event_id % 4 = 1 THEN user_id::VARCHAR ELSE 'null' END || ',"mft_sequence":' || event_id % 9 || ',"is_directory":' || CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END || ',"sha256":null}}' AS json
FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN '"' || t || '"' ELSE 'null' END AS si, CASE WHEN event_id % 3 > 0 THEN '"' || strftime(ts - INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S') || f || 'Z"' ELSE 'null' END AS sa,
    CASE WHEN event_id % 3 = 0 THEN 'null' WHEN event_id % 10 = 0 THEN '"' || t || '"' ELSE '"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(us * 1000 + event_id % 10 * 100 AS VARCHAR), 9, '0') || 'Z"' END AS sc
  FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') || f || 'Z' AS t FROM (SELECT *, CASE WHEN us = 0 THEN '' WHEN us % 1000 = 0 THEN '.' || lpad(CAST(us // 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(us AS VARCHAR), 6, '0') END AS f
    FROM (SELECT *, epoch_us(ts) % 1000000 AS us FROM events))))""")
def json_rows(spark, d):
    return sinks.json_rows(_timeline_rows(spark, d))


# Event windows


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    from chronoscope.streaming.detect import tumbling

    return tumbling(table(spark, d, "events"), "ts", "6 hours", "event_type").select(micros("start").alias("start_us"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, session""")
def sessionize(spark, d):
    from chronoscope.streaming.detect import sessions

    return sessions(table(spark, d, "events"), "ts", "12 hours", "user_id").select("user_id", micros("start").alias("start_us"), "n")


