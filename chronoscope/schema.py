"""Schemas and codes of the timeline."""

from __future__ import annotations

from pyspark.sql import types as T

# Event kinds and the codes they are shown with.
EVENT_CODES = {
    "FileCreate": "CREATE",
    "FileModify": "MOD",
    "FileAccess": "ACC",
    "FileDelete": "DEL",
    "FileRename": "REN",
    "MftEntryModify": "MFT",
    "Execute": "EXEC",
    "RegistryModify": "REG",
    "ServiceInstall": "SVC",
    "ScheduledTaskCreate": "TASK",
    "UserLogon": "LOGON",
    "UserLogoff": "LOGOFF",
    "ProcessCreate": "PROC",
    "NetworkConnection": "NET",
    "BitsTransfer": "BITS",
    "RdpSession": "RDP",
}

# Artifact kinds and the codes they are shown with; kinds with a detail show it after the colon.
SOURCE_CODES = {
    "Mft": "MFT",
    "UsnJrnl": "USN",
    "LogFile": "LOG",
    "Prefetch": "PF",
    "Amcache": "AM",
    "Shimcache": "SHIM",
    "Bam": "BAM",
    "UserAssist": "UA",
    "Evtx": "EVT:",
    "Lnk": "LNK",
    "JumpList": "JL",
    "Shellbags": "SB",
    "Registry": "REG:",
    "RecycleBin": "RB",
    "ScheduledTask": "TSK",
    "Srum": "SRUM",
    "Wmi": "WMI",
}

# Anomaly bits.
TIMESTOMPED_SI_LT_FN = 0x01
TIMESTOMPED_ZERO_NANOS = 0x02
METADATA_BACKDATED = 0x04
NO_USN_CREATE = 0x08
LOG_GAP_DETECTED = 0x10
LOG_CLEARED = 0x20
EXECUTION_NO_PREFETCH = 0x40
HIDDEN_ADS = 0x80

# Two-letter prefixes of generated ids; they fill an id's upper 16 bits.
ID_PREFIXES = {
    "LogFile": "LF", "Lnk": "LN", "Prefetch": "PF", "JumpList": "JL", "Amcache": "AM", "UserAssist": "UA",
    "Shimcache": "SH", "Shellbags": "SB", "Bam": "BA", "RecycleBin": "RB", "Services": "SV", "Mru": "MR",
    "Srum": "SR", "UserRegistry": "UR", "Autoruns": "AR", "PowerShell": "PS", "Wmi": "WM", "Browser": "BR",
    "Network": "NL", "Activities": "AC", "Evtx": "EX", "RdpCache": "RC", "ScheduledTask": "ST",
}

# The order in which artifacts enter the timeline, which decides between equal times.
STAGES = ["Mft", "LogFile", "UsnJrnl", "Prefetch", "Amcache", "Shimcache", "Bam", "Services", "Srum", "Autoruns", "Wmi", "Network", "Lnk", "JumpList", "UserAssist", "Shellbags", "RecycleBin", "Mru", "UserRegistry", "PowerShell", "Browser", "Activities", "RdpCache", "Evtx", "ScheduledTask"]
STAGE = {name: i for i, name in enumerate(STAGES, 1)}

_TIMES = ["si_created", "si_modified", "si_accessed", "si_entry_modified", "fn_created", "fn_modified", "fn_accessed", "fn_entry_modified"]
_OTHER_TIMES = ["usn_timestamp", "lnk_target_created", "lnk_target_modified", "lnk_target_accessed", "jumplist_timestamp", "amcache_timestamp", "shimcache_timestamp", "evtx_timestamp"]

TIMESTAMPS = T.StructType([T.StructField(n, T.TimestampType()) for n in _TIMES + _OTHER_TIMES] + [T.StructField("prefetch_last_run", T.ArrayType(T.TimestampType()))])
#: 100 ns ticks since 1601 of the file-table times: timestamps hold microseconds only.
TICKS = T.StructType([T.StructField(n, T.LongType()) for n in _TIMES])
METADATA = T.StructType().add("file_size", T.LongType()).add("mft_entry_number", T.LongType()).add("mft_sequence", T.IntegerType()).add("is_directory", T.BooleanType()).add("has_ads", T.BooleanType()).add("parent_path", T.StringType()).add("sha256", T.StringType()).add("sha1", T.StringType())

TIMELINE = T.StructType(
    [
        T.StructField("entity_kind", T.StringType()),
        T.StructField("entity_num", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("primary_ts", T.TimestampType()),
        T.StructField("primary_ticks", T.LongType()),
        T.StructField("event_kind", T.StringType()),
        T.StructField("event_code", T.StringType()),
        T.StructField("timestamps", TIMESTAMPS),
        T.StructField("ticks", TICKS),
        T.StructField("sources", T.ArrayType(T.StructType().add("kind", T.StringType()).add("detail", T.StringType()))),
        T.StructField("anomalies", T.IntegerType()),
        T.StructField("metadata", METADATA),
        T.StructField("stage", T.IntegerType()),
        T.StructField("file_ord", T.LongType()),
        T.StructField("rec_ord", T.LongType()),
    ]
)


def id_base(artifact: str) -> int:
    """The first generated id of an artifact."""
    return int.from_bytes(ID_PREFIXES[artifact].encode(), "big") << 48
