"""Timeline rows of every artifact, each from star-schema rows that stand for its decoded records.

Every query calls one function of ``plans.normalize`` (or a decoder's aggregate); its twin is written from the row's format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscope.functions import times as T
from chronoscope.plans import normalize as N
from chronoscope.plans.fixtures import FILE_ROWS_SQL, file_rows, key_of, table
from chronoscope.registered import query
from chronoscope.sources import decoders

AS_OF = "2025-08-10 00:00:00"
AS_OF_SQL = f"epoch_us(TIMESTAMP '{AS_OF}')"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def shown(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select("rec_ord", "path", "event_code", F.unix_micros("primary_ts").alias("us"), "anomalies", *more)


def traces(spark, d) -> DataFrame:
    """events with k, ticks and their number as the record's place."""
    e = table(spark, d, "events").withColumns({"k": key_of(F.col("props")), "ticks": T.ticks_of("ts")})
    return e.withColumn("rec_ord", F.col("event_id"))


def one_of(number: Column, *texts: str) -> Column:
    return F.element_at(F.array(*(F.lit(t) for t in texts)), (number % len(texts) + 1).cast("int"))


def traces_sql(path: str, code: str, where: str = "true", us: str = "epoch_us(ts)", more: str = "") -> str:
    """A twin over the same traces; path and code are SQL."""
    return f"SELECT event_id AS rec_ord, {path} AS path, {code} AS event_code, {us} AS us, 0 AS anomalies{more} FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE {where}"


# File system


@query(rf"""WITH {FILE_ROWS_SQL}, t AS (SELECT *, l_orderkey * 8 + l_linenumber AS n,
  CASE WHEN size > 40 THEN NULL WHEN size > 20 THEN si_ticks + 5 ELSE fn_ticks END AS modified, CASE WHEN size > 30 THEN NULL ELSE si_ticks END AS created FROM files)
SELECT n AS rec_ord, 'C:\' || name AS path, 'MFT' AS event_code, (coalesce(modified, created, fn_ticks) - 116444736000000000) // 10 AS us,
  (CASE WHEN created < fn_ticks THEN 1 ELSE 0 END) | (CASE WHEN (created % 10000000 = 0 AND fn_ticks % 10000000 <> 0) OR (fn_ticks % 10000000 = 0 AND modified % 10000000 <> 0) THEN 2 ELSE 0 END) | (CASE WHEN has_ads THEN 128 ELSE 0 END) AS anomalies,
  n AS entity_num, size AS file_size FROM t""")
def file_table_rows(spark, d):
    f = file_rows(spark, d).withColumn("entry", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    modified = F.when(F.col("size") > 40, None).when(F.col("size") > 20, F.col("si_ticks") + 5).otherwise(F.col("fn_ticks"))
    fn = F.col("fn_ticks")
    raw = f.select(
        "entry", F.col("entry").alias("rec_ord"), F.col("l_linenumber").alias("sequence"), F.concat(F.lit("C:\\"), "name").alias("path"),
        F.when(F.col("size") <= 30, F.col("si_ticks")).alias("si_created"), modified.alias("si_modified"), fn.alias("si_accessed"), fn.alias("si_entry_modified"),
        fn.alias("fn_created"), modified.alias("fn_modified"), fn.alias("fn_accessed"), fn.alias("fn_entry_modified"),
        "size", F.lit(False).alias("is_directory"), "has_ads",
    )
    return shown(N.file_table(raw), F.col("entity_num"), F.col("metadata.file_size").alias("file_size"))


@query(r"""SELECT event_id AS rec_ord, CASE WHEN s_name IS NULL THEN event_type ELSE 'C:\' || s_name || '\' || event_type END AS path,
  CASE k % 5 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'DEL' WHEN 2 THEN 'REN' WHEN 3 THEN 'SEC' ELSE 'ATTR' END AS event_code, epoch_us(ts) AS us, 0 AS anomalies
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) LEFT JOIN supplier ON s_suppkey = user_id""")
def change_journal_rows(spark, d):
    reason = F.element_at(F.array(*(F.lit(r).cast("long") for r in (0x80000100, 0x200, 0x1001, 0x800, 0x8000))), (F.col("k") % 5 + 1).cast("int"))
    raw = traces(spark, d).select("rec_ord", "ticks", F.col("event_id").alias("entry"), F.lit(1).alias("sequence"), F.col("user_id").alias("parent"), reason.alias("reason"), F.col("event_type").alias("name"))
    folders = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entry"), F.concat(F.lit("C:\\"), "s_name").alias("path"))
    return shown(N.change_journal(raw, folders))


@query(f"SELECT o_orderkey AS rec_ord, '$LogFile restart area at offset 0x' || format('{{:X}}', o_orderkey * 4096) || ': LSN=' || o_custkey || ', clients=1, pages=' || o_orderkey % 9 AS path, 'LogCheckpoint' AS event_code, {AS_OF_SQL} AS us, CASE WHEN o_orderkey % 3 = 0 THEN 16 ELSE 0 END AS anomalies FROM orders")
def log_file_rows(spark, d):
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias("rec_ord"), (F.col("o_orderkey") * 4096).alias("offset"), F.col("o_custkey").alias("lsn"), F.lit(1).alias("clients"), (F.col("o_orderkey") % 9).alias("pages"), (F.col("o_orderkey") % 3 == 0).alias("gap"))
    return shown(N.log_file(raw, as_of()))


@query("""WITH p AS (SELECT user_id AS file, event_id AS page_no, user_id * event_id AS lsn, CASE event_type WHEN 'error' THEN 'zero' WHEN 'signup' THEN 'RSTR' ELSE 'RCRD' END AS kind FROM events),
n AS (SELECT *, lead(kind) OVER w AS after, count(*) FILTER (kind = 'RCRD') OVER w AS seen FROM p WHERE page_no >= 2 WINDOW w AS (PARTITION BY file ORDER BY page_no)),
g AS (SELECT file, count(*) FILTER (kind = 'RCRD') AS record_pages, bool_or(kind = 'RSTR' OR (kind = 'zero' AND seen > 0 AND coalesce(after = 'RCRD', false))) AS gap FROM n GROUP BY 1)
SELECT file, coalesce(record_pages, 0) AS record_pages, max_lsn, coalesce(gap, false) AS gap FROM (SELECT file, max(lsn) AS max_lsn FROM p GROUP BY 1) LEFT JOIN g USING (file)""")
def log_page_summary(spark, d):
    kind = F.when(F.col("event_type") == "error", "zero").when(F.col("event_type") == "signup", "RSTR").otherwise("RCRD")
    return decoders.log_summary(table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("page_no"), kind.alias("kind"), (F.col("user_id") * F.col("event_id")).alias("lsn")))


# Execution


@query("""WITH r AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
u AS (SELECT event_id * 16 AS n, epoch_us(ts) AS us, * FROM r UNION ALL SELECT event_id * 16 + 1, epoch_us(ts) + 1000000, * FROM r WHERE k % 2 = 0)
SELECT n AS rec_ord, upper(event_type) || '.EXE (run_count: ' || k || ', loaded: ' || user_id || ' files)' AS path, 'EXEC' AS event_code, us, 0 AS anomalies, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS runs FROM u""")
def prefetch_rows(spark, d):
    runs = F.array(F.col("ticks"), F.lit(0).cast("long"), F.when(F.col("k") % 2 == 0, F.col("ticks") + T.TICKS_A_SECOND).otherwise(0))
    raw = traces(spark, d).select("rec_ord", F.concat(F.upper("event_type"), F.lit(".EXE")).alias("name"), F.col("k").alias("run_count"), F.col("user_id").alias("files"), runs.alias("run_ticks"))
    return shown(N.prefetch(raw), F.size("timestamps.prefetch_last_run").alias("runs"))


@query(traces_sql("event_type", "'EXEC'", us="CASE WHEN k % 3 = 2 THEN epoch_us(TIMESTAMP '2020-01-01') ELSE epoch_us(date_trunc('second', ts)) END", more=", CASE WHEN k % 2 = 0 THEN 'ab' || k ELSE 'ab0000' || k END AS sha1, user_id AS file_size"))
def amcache_rows(spark, d):
    link = F.when(F.col("k") % 3 == 0, F.date_format("ts", "MM/dd/yyyy HH:mm:ss")).when(F.col("k") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("unknown")
    file_id = F.concat(F.when(F.col("k") % 2 == 0, "00000000ab").otherwise("ab0000"), F.col("k").cast("string"))
    raw = traces(spark, d).select("rec_ord", F.col("event_type").alias("path"), file_id.alias("file_id"), link.alias("link_date"), T.ticks_of(F.lit("2020-01-01").cast("timestamp")).alias("key_ticks"), F.col("user_id").alias("size"))
    return shown(N.amcache(raw), F.col("metadata.sha1").alias("sha1"), F.col("metadata.file_size").alias("file_size"))


@query(traces_sql(r"'C:\' || event_type || '.exe'", "'EXEC'", "event_id % 5 > 0"))
def shimcache_rows(spark, d):
    raw = traces(spark, d).select("rec_ord", F.concat(F.lit("C:\\"), "event_type", F.lit(".exe")).alias("path"), F.when(F.col("event_id") % 5 > 0, F.col("ticks")).otherwise(0).alias("ticks"))
    return shown(N.shimcache(raw))


@query(traces_sql(r"CASE WHEN k % 3 = 0 THEN 'C:\' || event_type ELSE event_type END", "'EXEC'", "k % 4 > 0 AND k % 3 < 2"))
def bam_rows(spark, d):
    k = F.col("k")
    name = F.when(k % 3 == 0, F.concat(F.lit("\\Device\\HarddiskVolume"), (k % 9).cast("string"), F.lit("\\"), "event_type")).when(k % 3 == 1, F.col("event_type")).otherwise(one_of(k, "", "Version", "SequenceNumber"))
    return shown(N.bam(traces(spark, d).select("rec_ord", "ticks", F.when(k % 4 > 0, "S-1-5-21").otherwise("x").alias("sid"), name.alias("value_name"))))


@query(traces_sql("translate(event_type, 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm')", "'EXEC'"))
def user_assist_rows(spark, d):
    return shown(N.user_assist(traces(spark, d).withColumnRenamed("event_type", "value_name")))


@query(traces_sql("CASE k % 3 WHEN 0 THEN '[SRUM:App] ' || event_type || ' user:' || user_id || ' fg:' || k || ' bg:2 face:3' WHEN 1 THEN '[SRUM:Net] ' || event_type || ' user:' || user_id || ' sent:' || k || '.5 KB recv:' || k || ' B' ELSE '[SRUM:Conn] ' || event_type || ' user:' || user_id || ' connected:' || k || 's' END", "CASE WHEN k % 3 = 0 THEN 'EXEC' ELSE 'NET' END"))
def srum_rows(spark, d):
    k = F.col("k").cast("long")
    raw = traces(spark, d).select("rec_ord", "ticks", one_of(k, "App", "Net", "Conn").alias("table"), F.col("event_type").alias("app"), F.col("user_id").cast("string").alias("user"), k.alias("foreground"), F.lit(2).alias("background"), F.lit(3).alias("face"), (k * 1024 + 512).alias("sent"), k.alias("received"), k.alias("connected"))
    return shown(N.resource_usage(raw))


# Persistence


@query("""WITH s AS (SELECT *, coalesce(nullif(p_size % 7, 6), 3) AS start FROM part WHERE p_partkey % 5 > 0),
r AS (SELECT *, rank() OVER (PARTITION BY p_partkey % 11 ORDER BY p_partkey % 3) AS nth FROM s WHERE start <= 2)
SELECT p_partkey AS rec_ord, '[Service:' || p_name || '] ' || ['Boot', 'System', 'Auto'][start + 1] || ' -> ' || p_brand AS path, 'SVC' AS event_code, 1577836800000000 + p_partkey AS us, 0 AS anomalies FROM r WHERE nth = 1""")
def service_rows(spark, d):
    p = F.col("p_partkey")
    raw = table(spark, d, "part").select(p.alias("rec_ord"), (p % 11).alias("file_ord"), F.col("p_name").alias("name"), F.nullif(F.col("p_size") % 7, F.lit(6)).alias("start"), F.when(p % 5 > 0, F.col("p_brand")).otherwise("").alias("image_path"), (p % 3).alias("control_set"), (p * 10 + 132223104000000000).alias("ticks"))
    return shown(N.services(raw))


@query(traces_sql("'[Autorun:' || CASE WHEN k % 2 = 0 THEN 'SOFTWARE' ELSE 'NTUSER.DAT' END || '] ' || event_type || ' = ' || props || ' (Run)'", "'REG'", "k % 5 > 0"))
def autorun_rows(spark, d):
    raw = traces(spark, d).select("rec_ord", "ticks", one_of(F.col("k"), "SOFTWARE", "NTUSER.DAT").alias("hive"), F.col("event_type").alias("name"), F.when(F.col("k") % 5 > 0, F.col("props")).otherwise("").alias("command"), F.lit("Run").alias("key_path"))
    return shown(N.autoruns(raw))


@query(f"""WITH w AS (SELECT *, p_partkey % 4 AS c, CASE WHEN p_partkey % 7 = 0 THEN 'BVTConsumer' ELSE p_brand END AS name FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY c, name ORDER BY p_partkey) AS nth FROM w)
SELECT p_partkey AS rec_ord, '[WMI:' || ['CmdConsumer', 'ScriptConsumer', 'Filter', 'Binding'][c + 1] || '] ' || name || ' ' || p_name AS path, CASE WHEN c < 2 THEN 'EXEC' ELSE 'REG' END AS event_code, {AS_OF_SQL} AS us, CASE WHEN name = 'BVTConsumer' THEN 0 ELSE 64 END AS anomalies FROM f WHERE nth = 1""")
def wmi_rows(spark, d):
    p = F.col("p_partkey")
    raw = table(spark, d, "part").select(p.alias("rec_ord"), one_of(p, *N.WMI_KINDS).alias("class"), F.when(p % 7 == 0, "BVTConsumer").otherwise(F.col("p_brand")).alias("name"), F.col("p_name").alias("details"))
    return shown(N.wmi(raw, as_of()))


@query(r"SELECT o_orderkey AS rec_ord, '[SchedTask] \t' || o_orderkey || ' -> ' || o_orderstatus || ' (' || o_custkey || ')' AS path, 'TASK' AS event_code, epoch_us(o_orderdate) AS us, 0 AS anomalies FROM orders")
def task_rows(spark, d):
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias("rec_ord"), F.concat(F.lit("\\t"), F.col("o_orderkey").cast("string")).alias("uri"), F.col("o_orderstatus").alias("action"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("date"))
    return shown(N.scheduled_tasks(raw))


# What users did


@query(traces_sql(r"CASE WHEN k % 3 = 0 THEN 'D:\' || event_type || CASE WHEN k % 2 = 0 THEN ' (via host' || user_id || ', MAC: 00:01)' ELSE '' END ELSE event_id || '.lnk' || CASE WHEN k % 2 = 0 THEN ' (via host' || user_id || ', MAC: 00:01)' ELSE '' END END", "'ACC'", us="epoch_us(ts) + CASE WHEN k % 5 = 0 THEN 1 WHEN k % 5 = 1 THEN 2 ELSE 0 END"))
def shortcut_rows(spark, d):
    k, t = F.col("k"), F.col("ticks")
    target = F.when(k % 3 == 0, F.concat(F.lit("D:\\"), "event_type"))
    raw = traces(spark, d).select("rec_ord", (t + 20).alias("created"), F.when(k % 5 == 1, 0).otherwise(t + 10).alias("accessed"), F.when(k % 5 < 2, 0).otherwise(t).alias("written"), F.lit(0).cast("long").alias("size"), target.alias("target"), F.when(k % 2 == 0, F.concat(F.lit("host"), F.col("user_id").cast("string"))).alias("machine"), F.lit("00:01").alias("mac"), F.concat(F.col("event_id").cast("string"), F.lit(".lnk")).alias("lnk_path"))
    return shown(N.shortcuts(raw))


@query(traces_sql("event_type", "'ACC'", "k % 5 > 0", us="epoch_us(ts) + CASE k % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END"))
def jump_list_rows(spark, d):
    k, t = F.col("k"), F.col("ticks")
    raw = traces(spark, d).select("rec_ord", F.col("event_type").alias("target"), F.when(k % 5 > 2, t).otherwise(0).alias("written"), F.when(k % 5 == 1, t + 10).otherwise(0).alias("accessed"), F.when(k % 5 == 2, t + 20).otherwise(0).alias("created"))
    return shown(N.jump_lists(raw))


@query(traces_sql(r"'[Shellbag] ' || CASE WHEN k % 4 = 0 THEN '0\' || k ELSE event_type || ' (0\' || k || ')' END", "'ACC'"))
def shellbag_rows(spark, d):
    raw = traces(spark, d).select("rec_ord", "ticks", F.when(F.col("k") % 4 > 0, F.col("event_type")).alias("folder"), F.concat(F.lit("0\\"), F.col("k").cast("string")).alias("reg_path"))
    return shown(N.shellbags(raw))


@query(traces_sql("event_type", "'DEL'", more=", user_id AS file_size"))
def recycle_bin_rows(spark, d):
    return shown(N.recycle_bin(traces(spark, d).select("rec_ord", "ticks", F.col("event_type").alias("path"), F.col("user_id").alias("size"))), F.col("metadata.file_size").alias("file_size"))


@query(traces_sql("'[MRU:RecentDocs] ' || event_type", "'ACC'"))
def recent_list_rows(spark, d):
    return shown(N.recent_lists(traces(spark, d).select("rec_ord", "ticks", F.lit("RecentDocs").alias("key"), F.col("event_type").alias("name"))))


@query(traces_sql("""CASE k % 4 WHEN 0 THEN '[TypedPath] ' || props || ' (user: u)' WHEN 1 THEN '[SearchQuery] "' || props || '" (user: u)' WHEN 2 THEN '[OpenSave] ' || props || ' (user: u, key: ' || event_type || ')' ELSE '[LastVisitedApp] ' || props || ' (user: u)' END""", "CASE k % 4 WHEN 1 THEN 'Search' WHEN 3 THEN 'EXEC' ELSE 'ACC' END", us=f"CASE WHEN k % 5 = 0 THEN {AS_OF_SQL} ELSE epoch_us(ts) END"))
def user_registry_rows(spark, d):
    raw = traces(spark, d).select("rec_ord", F.when(F.col("k") % 5 > 0, F.col("ticks")).alias("ticks"), one_of(F.col("k"), "TypedPath", "SearchQuery", "OpenSaveDialog", "LastVisitedApp").alias("activity"), F.col("props").alias("value_data"), F.col("event_type").alias("value_name"), F.lit("u").alias("username"))
    return shown(N.user_registry(raw, as_of()))


@query(f"SELECT conv_id * 100000 + turn AS rec_ord, '[PowerShell:History] ' || coalesce(text, '') || ' (user: ' || coalesce(role, '') || ', line: ' || turn || ')' AS path, 'EXEC' AS event_code, {AS_OF_SQL} AS us, 0 AS anomalies FROM conversations")
def powershell_rows(spark, d):
    raw = table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("rec_ord"), F.col("text").alias("line"), F.col("turn").alias("line_no"), F.col("role").alias("username"))
    return shown(N.powershell(raw, as_of()))


@query(traces_sql("""'[Edge:History]' || CASE WHEN k % 3 = 2 THEN ' "' || event_type || '"' ELSE '' END || ' http://x/' || user_id || ' (visits: ' || k || ')'""", "'BrowseURL'"))
def browser_rows(spark, d):
    title = F.when(F.col("k") % 3 == 1, "").when(F.col("k") % 3 == 2, F.col("event_type"))
    raw = traces(spark, d).select("rec_ord", "ts", F.lit("Edge").alias("browser"), title.alias("title"), F.concat(F.lit("http://x/"), F.col("user_id").cast("string")).alias("url"), F.col("k").alias("visit_count"))
    return shown(N.browser_history(raw))


@query(traces_sql("'[Timeline:' || CASE k WHEN 5 THEN 'Open' WHEN 6 THEN 'Focus' WHEN 16 THEN 'Clipboard' ELSE 'Type:' || k END || '] ' || event_type", "'EXEC'", us="epoch_us(date_trunc('second', ts))"))
def activity_rows(spark, d):
    raw = traces(spark, d).select("rec_ord", F.concat(F.lit('[{"application":"'), "event_type", F.lit('"}]')).alias("app_id"), F.col("k").alias("activity"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"))
    return shown(N.activities(raw))


@query(f"SELECT p_partkey AS rec_ord, '[RDP:BitmapCache] ' || p_brand || ' (user: Unknown, tiles: ~' || p_size || ', size: ' || p_partkey || ' bytes, ver: RDP8)' AS path, 'RDP' AS event_code, {AS_OF_SQL} AS us, 0 AS anomalies FROM part")
def rdp_cache_rows(spark, d):
    raw = table(spark, d, "part").select(F.col("p_partkey").alias("rec_ord"), F.col("p_brand").alias("file"), F.lit("Unknown").alias("username"), F.col("p_size").alias("tiles"), F.col("p_partkey").alias("size"), F.lit("RDP8").alias("kind"))
    return shown(N.rdp_bitmaps(raw, as_of()))


@query("""WITH p AS (SELECT o_custkey, min(o_orderdate) AS a, nullif(max(o_orderdate), min(o_orderdate)) AS b FROM orders GROUP BY 1)
SELECT o_custkey * 2 + nth AS rec_ord, '[NetProfile:' || what || '] c' || o_custkey || ' (' || CASE o_custkey % 3 WHEN 0 THEN 'Wired' WHEN 1 THEN 'VPN' ELSE 'Unknown' END || ', DNS: d)' AS path, 'NET' AS event_code, epoch_us(ts) AS us, 0 AS anomalies
FROM (SELECT o_custkey, 0 AS nth, 'FirstConnect' AS what, a AS ts FROM p UNION ALL SELECT o_custkey, 1, 'LastConnect', b FROM p WHERE b IS NOT NULL)""")
def network_rows(spark, d):
    kind = F.element_at(F.array(F.lit(6), F.lit(23), F.lit(1)), (F.col("o_custkey") % 3 + 1).cast("int"))
    ends = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.nullif(F.max("o_orderdate"), F.min("o_orderdate")).alias("last"))
    raw = ends.select(F.col("o_custkey").alias("rec_ord"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("profile"), kind.alias("type"), F.lit("d").alias("dns"), "first", "last")
    return shown(N.network_profiles(raw))


# Blobs of an id map: every third customer an identifier, every fourth of the others a text that says nothing; a later order's row wins.
ID_MAP_SQL = r"""names AS (SELECT o_custkey AS id, o_orderkey AS n, CASE WHEN o_custkey % 3 = 0 THEN 'S-1-5-21-' || o_custkey || '-' || (o_orderkey % 65536)
    WHEN o_orderkey % 4 <> 0 THEN '\Device\é' || o_orderkey END AS name FROM orders),
last AS (SELECT id, arg_max(name, n) AS name FROM names WHERE name IS NOT NULL GROUP BY id)"""


@query(f"WITH {ID_MAP_SQL} SELECT event_id, coalesce(name, 'ID:' || user_id) AS name FROM events LEFT JOIN last ON id = user_id")
def srum_id_names(spark, d):
    from chronoscope.operators import resolve

    def word(value):
        pairs = F.lpad(F.hex(value), 8, "0")  # all 32 bits of a part of an identifier
        return F.concat(*(F.substring(pairs, at, 2) for at in (7, 5, 3, 1)))

    identifier = F.unhex(F.concat(F.lit("0103000000000005"), F.lit("15000000"), word(F.col("o_custkey")), word(F.col("o_orderkey") % 65536)))
    text = F.encode(F.concat(F.lit("\\Device\\é"), F.col("o_orderkey").cast("string"), F.lit("\0")), "UTF-16LE")
    nothing = F.unhex(F.lit("0100"))
    blob = F.when(F.col("o_custkey") % 3 == 0, identifier).when(F.col("o_orderkey") % 4 != 0, text).otherwise(nothing)
    blobs = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", blob.alias("blob"))
    names = resolve.id_map(blobs, "user_id", "blob", "o_orderkey")
    return resolve.resolve_ids(table(spark, d, "events").select("event_id", "user_id"), names, "user_id", "value").select("event_id", "name")
