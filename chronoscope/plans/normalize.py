"""From raw rows of each artifact to timeline rows, by column expressions only.

A raw table has the columns named in its function's docstring, ``ticks`` columns as
100 ns since 1601, and may have ``file_ord`` and ``rec_ord`` (0 if not), which order
rows of equal time. What has no time of its own gets ``as_of``, so that a run can be
repeated. Every function returns rows of ``schema.TIMELINE``."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscope import schema as S
from chronoscope.functions import text as X
from chronoscope.functions import times as T
from chronoscope.operators import anomaly, events, timeline
from chronoscope.operators.resolve import first_rows, full_path


def filled(template: str, **columns: Column) -> Column:
    """A text with columns, or the given expressions, in braces; null shows as nothing."""
    parts = re.findall(r"\{\w+\}|[^{]+", template)
    return F.concat(*(F.coalesce(columns.get(p[1:-1], F.col(p[1:-1])).cast("string"), F.lit("")) if p.startswith("{") else F.lit(p) for p in parts))


def _struct(schema, values: Mapping[str, Column]) -> Column:
    return F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def rows(
    raw: DataFrame,
    artifact: str,
    path: Column,
    ticks: Column,
    kind: str | Column,
    source: str,
    detail: Column | None = None,
    entity: Column | None = None,
    timestamps: Mapping[str, Column] | None = None,
    file_ticks: Mapping[str, Column] | None = None,
    anomalies: Column | None = None,
    metadata: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Timeline rows; those without a time are left out. ``entity`` is a file-table number, else ids are generated from the record's place."""
    for name in ("file_ord", "rec_ord"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(0).cast("long"))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    number = F.lit(S.id_base(artifact)).cast("long") + F.shiftleft(F.pmod(F.col("file_ord").cast("long"), F.lit(1 << 16)), 32) + F.col("rec_ord") if entity is None else entity
    metadata = {"is_directory": F.lit(False), "has_ads": F.lit(False)} | dict(metadata or {})
    out = raw.select(
        F.lit("Generated" if entity is None else "MftEntry").alias("entity_kind"),
        number.cast("long").alias("entity_num"),
        path.alias("path"),
        T.filetime(ticks).alias("primary_ts"),
        ticks.cast("long").alias("primary_ticks"),
        kind.alias("event_kind"),
        timeline.event_code(kind).alias("event_code"),
        _struct(S.TIMESTAMPS, timestamps or {}).alias("timestamps"),
        _struct(S.TICKS, file_ticks or {}).alias("ticks"),
        F.array(F.struct(F.lit(source).alias("kind"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))).alias("sources"),
        (F.lit(0) if anomalies is None else anomalies).cast("int").alias("anomalies"),
        _struct(S.METADATA, metadata).alias("metadata"),
        F.lit(S.STAGE[artifact]).alias("stage"),
        F.col("file_ord").cast("long").alias("file_ord"),
        F.col("rec_ord").cast("long").alias("rec_ord"),
    )
    return out.where(F.col("primary_ts").isNotNull())


def _ticks(ts: Column | str) -> Column:
    return T.ticks_of(ts)


def once(raw: DataFrame, name: str, value: Column) -> DataFrame:
    """raw with a costly column that is computed once a row.

    A filter on a plain column's outcome is moved below it with a copy of the expression for each use, until
    the generated code is too long to be compiled; a filter on what is exploded, here one value, stays above."""
    return raw.select(*(c for c in raw.columns if c != name), F.explode(F.array(value)).alias(name))


def file_table(raw: DataFrame) -> DataFrame:
    """entry, sequence, path, eight ``si_``/``fn_`` tick columns, size, is_directory, has_ads."""
    names = S.TICKS.names
    primary = F.coalesce("si_modified", "si_created", "fn_modified", "fn_created")
    zero = anomaly.zero_subseconds((F.col("si_created"), F.col("fn_created")), (F.col("si_modified"), F.col("fn_modified")))
    flags = anomaly.si_before_fn(F.col("si_created"), F.col("fn_created")).bitwiseOR(zero).bitwiseOR(anomaly.flag_when(F.col("has_ads"), S.HIDDEN_ADS))
    metadata = {"file_size": F.col("size"), "mft_entry_number": F.col("entry"), "mft_sequence": F.col("sequence"), "is_directory": F.col("is_directory"), "has_ads": F.col("has_ads")}
    return rows(raw.where("path is not null and path <> ''"), "Mft", F.col("path"), primary, "MftEntryModify", "Mft", entity=F.col("entry"), timestamps={n: T.filetime(n) for n in names}, file_ticks={n: F.col(n) for n in names}, anomalies=flags, metadata=metadata)


#: Event kinds of change-journal codes.
_KIND_OF = {"CREATE": "FileCreate", "DEL": "FileDelete", "REN": "FileRename", "MOD": "FileModify", "SEC": "SEC", "ATTR": "ATTR"}


def change_journal(raw: DataFrame, file_paths: DataFrame | None = None) -> DataFrame:
    """entry, sequence, parent, ticks, reason, name; file_paths (entry, path, one row each; of each ``archive``, where both have that column) resolves parents."""
    kinds = F.create_map(*(F.lit(x) for pair in _KIND_OF.items() for x in pair))
    path: Column = F.col("name")
    if file_paths is not None:
        own = ["archive"] if "archive" in raw.columns and "archive" in file_paths.columns else []
        raw = raw.join(file_paths.select(*own, F.col("entry").alias("parent"), F.col("path").alias("_parent_path")), ["parent", *own], "left")
        path = full_path(F.col("_parent_path"), F.col("name"))
    metadata = {"mft_entry_number": F.col("entry"), "mft_sequence": F.col("sequence")}
    return rows(raw, "UsnJrnl", path, F.col("ticks"), F.element_at(kinds, events.reason_code(F.col("reason"))), "UsnJrnl", entity=F.col("entry"), timestamps={"usn_timestamp": T.filetime("ticks")}, metadata=metadata)


def log_file(raw: DataFrame, as_of: Column) -> DataFrame:
    """offset, lsn, clients, pages, gap: a row for each restart area."""
    path = filled("$LogFile restart area at offset 0x{offset}: LSN={lsn}, clients={clients}, pages={pages}", offset=F.hex("offset"))
    return rows(raw, "LogFile", path, _ticks(as_of), "LogCheckpoint", "LogFile", anomalies=anomaly.flag_when(F.col("gap"), S.LOG_GAP_DETECTED))


def prefetch(raw: DataFrame) -> DataFrame:
    """name, run_count, files, run_ticks (array): a row for each run time that isn't 0."""
    runs = raw.withColumn("run_ticks", F.filter("run_ticks", lambda x: x != 0)).select("*", F.posexplode("run_ticks").alias("_nth", "ticks"))
    if "rec_ord" in raw.columns:
        runs = runs.withColumn("rec_ord", F.col("rec_ord") * 16 + F.col("_nth"))
    path = filled("{name} (run_count: {run_count}, loaded: {files} files)")
    return rows(runs, "Prefetch", path, F.col("ticks"), "Execute", "Prefetch", timestamps={"prefetch_last_run": F.transform("run_ticks", T.filetime)})


def amcache(raw: DataFrame) -> DataFrame:
    """path, file_id (with its zeros), link_date (text) or key_ticks, size."""
    raw = once(raw, "ticks", F.coalesce(_ticks(T.one_of_formats("link_date", *T.INVENTORY_FORMATS)), F.col("key_ticks")))
    metadata = {"file_size": F.col("size"), "sha1": F.regexp_replace("file_id", "^(?:0000)+", "")}
    return rows(raw, "Amcache", F.col("path"), F.col("ticks"), "Execute", "Amcache", timestamps={"amcache_timestamp": T.filetime("ticks")}, metadata=metadata)


def shimcache(raw: DataFrame) -> DataFrame:
    """path, ticks."""
    return rows(raw, "Shimcache", F.col("path"), F.col("ticks"), "Execute", "Shimcache", timestamps={"shimcache_timestamp": T.filetime("ticks")})


def bam(raw: DataFrame) -> DataFrame:
    """sid, value_name (device path), ticks."""
    kept = raw.where(F.col("sid").startswith("S-1-") & ~F.col("value_name").isin("", "Version", "SequenceNumber"))
    return rows(kept, "Bam", X.device_path(F.col("value_name")), F.col("ticks"), "Execute", "Bam")


def started_services(raw: DataFrame, host: str) -> DataFrame:
    """The services that start by themselves (a null start is 3) and have a program, of each host's first control set with such rows."""
    kept = raw.withColumn("start", F.coalesce("start", F.lit(3))).where("start <= 2 and image_path <> ''")
    first = kept.groupBy(host).agg(F.min("control_set").alias("control_set"))
    return kept.join(first, [host, "control_set"])


def services(raw: DataFrame, host: str = "file_ord") -> DataFrame:
    """name, start (null: 3), image_path, ticks, control_set: of each file the first control set with kept rows."""
    if host not in raw.columns:
        raw = raw.withColumn(host, F.lit(0))
    return rows(started_services(raw, host), "Services", filled("[Service:{name}] {start} -> {image_path}", start=X.start_type(F.col("start"))), F.col("ticks"), "ServiceInstall", "Registry", F.lit("SYSTEM"))


def resource_usage(raw: DataFrame) -> DataFrame:
    """table (App, Net or Conn), app, user (resolved names), ticks and the counters of the table."""
    text = (
        F.when(F.col("table") == "App", filled("[SRUM:App] {app} user:{user} fg:{foreground} bg:{background} face:{face}"))
        .when(F.col("table") == "Net", filled("[SRUM:Net] {app} user:{user} sent:{sent} recv:{received}", sent=X.humanized("sent"), received=X.humanized("received")))
        .otherwise(filled("[SRUM:Conn] {app} user:{user} connected:{connected}s"))
    )
    return rows(raw, "Srum", text, F.col("ticks"), F.when(F.col("table") == "App", "Execute").otherwise("NetworkConnection"), "Srum")


def autoruns(raw: DataFrame) -> DataFrame:
    """hive, name, command, key_path, ticks."""
    return rows(raw.where("command <> ''"), "Autoruns", filled("[Autorun:{hive}] {name} = {command} ({key_path})"), F.col("ticks"), "RegistryModify", "Registry", F.col("hive"))


# How kinds of persistence are named, and consumers that every system has.
WMI_KINDS = {"CommandLineEventConsumer": "CmdConsumer", "ActiveScriptEventConsumer": "ScriptConsumer", "__EventFilter": "Filter", "__FilterToConsumerBinding": "Binding"}
BENIGN_CONSUMERS = ("BVTConsumer", "SCM Event Log Consumer")


def wmi(raw: DataFrame, as_of: Column) -> DataFrame:
    """class, name, details and, where it is known, context (the text around): of equal class and name (of one ``archive``, where that is a column) the first row counts.

    A binding is benign by any of its context, everything else by its name."""
    order = [c for c in ("file_ord", "rec_ord") if c in raw.columns] or ["details"]
    first = first_rows(raw, [*(["archive"] if "archive" in raw.columns else []), "class", "name"], *order)
    names = F.create_map(*(F.lit(x) for pair in WMI_KINDS.items() for x in pair))
    runs = F.col("class").isin("CommandLineEventConsumer", "ActiveScriptEventConsumer")
    seen = F.when(F.col("class") == "__FilterToConsumerBinding", F.coalesce(F.col("context"), F.col("name"))).otherwise(F.col("name")) if "context" in raw.columns else F.col("name")
    benign = F.coalesce(seen.rlike("|".join(map(re.escape, BENIGN_CONSUMERS))), F.lit(False))
    path = filled("[WMI:{kind}] {name} {details}", kind=F.coalesce(F.element_at(names, F.col("class")), F.col("class")))
    return rows(first, "Wmi", path, _ticks(as_of), F.when(runs, "Execute").otherwise("RegistryModify"), "Wmi", anomalies=anomaly.flag_when(~benign, S.EXECUTION_NO_PREFETCH))


def connections(raw: DataFrame) -> DataFrame:
    """raw with what (FirstConnect or LastConnect), ts and nth: a row for each of first and last that is known."""
    pairs = F.array(F.struct(F.lit("FirstConnect").alias("what"), F.col("first").alias("ts"), F.lit(0).alias("nth")), F.struct(F.lit("LastConnect").alias("what"), F.col("last").alias("ts"), F.lit(1).alias("nth")))
    return raw.select("*", F.inline(F.filter(pairs, lambda x: x["ts"].isNotNull())))


def network_profiles(raw: DataFrame) -> DataFrame:
    """profile, type, dns, first and last (timestamps): up to two rows a profile."""
    both = connections(raw.where("profile <> ''"))
    if "rec_ord" in raw.columns:
        both = both.withColumn("rec_ord", F.col("rec_ord") * 2 + F.col("nth"))
    return rows(both, "Network", filled("[NetProfile:{what}] {profile} ({type}, DNS: {dns})", type=X.network_type(F.col("type"))), _ticks("ts"), "NetworkConnection", "Registry", F.lit("SOFTWARE"))


def shortcuts(raw: DataFrame) -> DataFrame:
    """The columns of ``decoders.LNK`` and lnk_path."""
    path = F.coalesce("target", "lnk_path")
    path = F.when(F.col("machine").isNotNull(), F.concat(path, filled(" (via {machine}, MAC: {mac})"))).otherwise(path)
    none = lambda c: F.nullif(F.col(c), F.lit(0))
    times = {"lnk_target_created": T.filetime("created"), "lnk_target_modified": T.filetime("written"), "lnk_target_accessed": T.filetime("accessed")}
    return rows(raw, "Lnk", path, F.coalesce(none("written"), none("accessed"), none("created")), "FileAccess", "Lnk", timestamps=times, metadata={"file_size": F.col("size")})


def jump_lists(raw: DataFrame) -> DataFrame:
    """target, written, accessed, created (ticks)."""
    none = lambda c: F.nullif(F.col(c), F.lit(0))
    ticks = F.coalesce(none("written"), none("accessed"), none("created"))
    return rows(raw, "JumpList", F.col("target"), ticks, "FileAccess", "JumpList", timestamps={"jumplist_timestamp": T.filetime(ticks)})


def user_assist(raw: DataFrame) -> DataFrame:
    """value_name (ROT13), ticks."""
    return rows(raw, "UserAssist", X.rot13(F.col("value_name")), F.col("ticks"), "Execute", "UserAssist")


def shellbags(raw: DataFrame) -> DataFrame:
    """folder (may be null), reg_path, ticks."""
    path = F.when(F.col("folder").isNotNull(), filled("[Shellbag] {folder} ({reg_path})")).otherwise(filled("[Shellbag] {reg_path}"))
    return rows(raw, "Shellbags", path, F.col("ticks"), "FileAccess", "Shellbags")


def recycle_bin(raw: DataFrame) -> DataFrame:
    """The columns of ``decoders.RECYCLED``."""
    return rows(raw, "RecycleBin", F.col("path"), F.col("ticks"), "FileDelete", "RecycleBin", metadata={"file_size": F.col("size")})


def recent_lists(raw: DataFrame) -> DataFrame:
    """key, name, ticks."""
    return rows(raw, "Mru", filled("[MRU:{key}] {name}"), F.col("ticks"), "FileAccess", "Registry", F.lit("MRU"))


def user_registry(raw: DataFrame, as_of: Column) -> DataFrame:
    """activity, value_data, value_name, username, ticks (may be null)."""
    text, code = events.user_registry_row()
    kind = F.when(code == "ACC", "FileAccess").when(code == "EXEC", "Execute").otherwise(code)
    return rows(raw, "UserRegistry", text, F.coalesce("ticks", _ticks(as_of)), kind, "Registry", F.lit("NTUSER.DAT"))


def powershell(raw: DataFrame, as_of: Column) -> DataFrame:
    """line, line_no, username."""
    return rows(raw, "PowerShell", filled("[PowerShell:History] {line} (user: {username}, line: {line_no})"), _ticks(as_of), "Execute", "Registry", F.lit("PSReadLine"))


def browser_history(raw: DataFrame) -> DataFrame:
    """browser, title (may be empty), url, visit_count, ts."""
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", filled(' "{title}"')).otherwise("")
    return rows(raw, "Browser", filled("[{browser}:History]{shown} {url} (visits: {visit_count})", shown=title), _ticks("ts"), "BrowseURL", "Registry", F.concat("browser", F.lit(":History")))


def activities(raw: DataFrame) -> DataFrame:
    """app_id, activity (number), start (seconds since 1970)."""
    path = filled("[Timeline:{kind}] {app}", kind=X.activity_type(F.col("activity")), app=X.activity_app(F.col("app_id")))
    return rows(raw, "Activities", path, _ticks(T.unix_time("start")), "Execute", "Registry", F.lit("ActivitiesCache"))


def rdp_bitmaps(raw: DataFrame, as_of: Column) -> DataFrame:
    """file, username, tiles, size, kind."""
    return rows(raw, "RdpCache", filled("[RDP:BitmapCache] {file} (user: {username}, tiles: ~{tiles}, size: {size} bytes, ver: {kind})"), _ticks(as_of), "RdpSession", "Registry", F.lit("RDPCache"))


#: Event kinds of event-log codes that have one; other codes are their own kind.
_LOG_KINDS = {code: kind for kind, code in S.EVENT_CODES.items()}


def event_log(raw: DataFrame) -> DataFrame:
    """event_id, channel, provider, computer, event_data, time (text): only ids that mean something. A cleared log sets its flag."""
    kept = events.interesting(raw.withColumn("_code", events.event_code()), "_code")
    kinds = F.create_map(*(F.lit(x) for pair in _LOG_KINDS.items() for x in pair))
    ticks = T.iso_ticks("time")
    kind = F.coalesce(F.element_at(kinds, F.col("_code")), F.col("_code"))
    return rows(kept, "Evtx", events.description(), ticks, kind, "Evtx", F.col("channel"), timestamps={"evtx_timestamp": T.filetime(ticks)}, anomalies=anomaly.flag_when(F.col("_code") == "LogCleared", S.LOG_CLEARED))


def scheduled_tasks(raw: DataFrame) -> DataFrame:
    """uri, action, author, date."""
    return rows(raw, "ScheduledTask", filled("[SchedTask] {uri} -> {action} ({author})"), _ticks("date"), "ScheduledTaskCreate", "ScheduledTask")


def build(*parts: DataFrame) -> DataFrame:
    """One timeline of all parts."""
    return timeline.union(*parts)
