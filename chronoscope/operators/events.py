"""Event-log records: event kinds by id, descriptions, what is kept."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Change-journal reason bits (public NTFS documentation).
REASONS = {
    "DATA_OVERWRITE": 0x1,
    "DATA_EXTEND": 0x2,
    "DATA_TRUNCATION": 0x4,
    "FILE_CREATE": 0x100,
    "FILE_DELETE": 0x200,
    "SECURITY_CHANGE": 0x800,
    "RENAME_OLD_NAME": 0x1000,
    "RENAME_NEW_NAME": 0x2000,
    "BASIC_INFO_CHANGE": 0x8000,
    "CLOSE": 0x80000000,
}


def reason_code(reason: Column) -> Column:
    """The event code of a change-journal reason; of several bits the weightiest counts."""
    def any_of(*names: str) -> Column:
        return reason.bitwiseAND(F.lit(sum(REASONS[n] for n in names)).cast("long")) != 0

    return (
        F.when(any_of("FILE_CREATE"), "CREATE")
        .when(any_of("FILE_DELETE"), "DEL")
        .when(any_of("RENAME_OLD_NAME", "RENAME_NEW_NAME"), "REN")
        .when(any_of("DATA_OVERWRITE", "DATA_EXTEND", "DATA_TRUNCATION"), "MOD")
        .when(any_of("SECURITY_CHANGE"), "SEC")
        .when(any_of("BASIC_INFO_CHANGE"), "ATTR")
        .otherwise("MOD")
    )


#: (ids, needed part of a field, code): the first row that fits decides. Sysmon's own ids come first.
# Event ids and the codes they mean.
SYSMON_CODES = {1: "PROC", 3: "NET", 8: "RemoteThread", 11: "CREATE", 12: "REG", 13: "REG", 14: "REG"}
ID_CODES = [
    ((4624, 4625), None, "LOGON"),
    ((4634, 4647), None, "LOGOFF"),
    ((4688,), None, "PROC"),
    ((4698, 4702), None, "TASK"),
    ((1102, 104), ("channel", "RDPClient", False), "LogCleared"),
    ((7045,), None, "SVC"),
    ((21, 22, 23, 24, 25), ("provider", "TerminalServices", True), "RDP"),
    ((4104,), None, "EXEC"),
    ((59, 60, 61), None, "BITS"),
    ((5156, 5157), None, "NET"),
    ((4720,), None, "AccountCreated"),
    ((4732,), None, "GroupMemberAdd"),
    ((106, 200, 201), None, "TASK"),
    ((5857, 5858, 5859, 5860, 5861), None, "WmiActivity"),
    ((1024, 1102), ("channel", "RDPClient", True), "RDP"),
    ((1116, 1117), None, "Defender"),
    ((5140, 5145), None, "ShareAccess"),
]


def _needs(need: tuple[str, str, bool] | None) -> Column:
    if need is None:
        return F.lit(True)
    field, part, wanted = need
    found = F.coalesce(F.col(field).contains(part), F.lit(False))
    return found if wanted else ~found


def event_code(event_id: Column | None = None) -> Column:
    """The code of an event-log record with columns event_id, channel and provider."""
    event_id = F.col("event_id") if event_id is None else event_id
    sysmon = F.coalesce(F.col("provider").contains("Sysmon"), F.lit(False))
    chosen = F
    for number, code in SYSMON_CODES.items():
        chosen = chosen.when(sysmon & (event_id == number), code)
    chosen = chosen.when(sysmon, F.concat(F.lit("Sysmon:"), event_id.cast("string")))
    for ids, need, code in ID_CODES:
        chosen = chosen.when(event_id.isin(*ids) & _needs(need), code)
    return chosen.otherwise(F.concat(F.lit("EID:"), event_id.cast("string")))


def interesting(rows: DataFrame, code: str = "event_code") -> DataFrame:
    """Rows whose id means something."""
    return rows.where(~F.col(code).startswith("EID:"))


# Texts by event id. {a|x} is field a of the event data or x where it is missing;
# {a|b|x} tries two fields; «...» is left out where the field in it, marked with !, is missing or empty.
LOGON = r"{TargetDomainName|}\{TargetUserName|?} Type:{LogonType|?} from {IpAddress|-}"
NET_TEXT = "{SourceAddress|?}:{SourcePort|?} -> {DestAddress|?}:{DestPort|?} ({Application|?})"
TEMPLATES = [
    ((4624,), None, "[Logon] " + LOGON),
    ((4625,), None, "[FailedLogon] " + LOGON),
    ((4634, 4647), None, "[Logoff] {TargetUserName|?}"),
    ((4688,), None, "[Process] {NewProcessName|?}« -> {!CommandLine|}» ({SubjectUserName|?})"),
    ((7045,), None, "[Service] {ServiceName|?} -> {ImagePath|?}"),
    ((1102,), ("channel", "RDPClient", True), "[RDPClient] Connected to {Value|?}"),
    ((1102, 104), None, "[LogCleared] {.channel} on {.computer}"),
    ((21, 22, 23, 24, 25), ("provider", "TerminalServices", True), "[RDP] {User|?} from {Address|-} (EID:{.event_id})"),
    ((4104,), None, "[PowerShell] «{!Path|} -> »{ScriptBlockText|?/200}"),
    ((59, 60, 61), None, "[BITS] {url|?} ({bytesTransferred|0} bytes)"),
    ((5156,), None, "[Net:Allowed] " + NET_TEXT),
    ((5157,), None, "[Net:Blocked] " + NET_TEXT),
    ((4720,), None, r"[AccountCreated] {TargetDomainName|}\{TargetUserName|?} by {SubjectUserName|?}"),
    ((4732,), None, "[GroupMemberAdd] {MemberSid|?} added to {TargetUserName|?} by {SubjectUserName|?}"),
    ((1,), ("provider", "Sysmon", True), "[Sysmon:Process] {Image|?}« -> {!CommandLine|}» (parent: {ParentImage|}, user: {User|?})"),
    ((3,), ("provider", "Sysmon", True), "[Sysmon:Net] {Image|?} {SourceIp|?}:{SourcePort|?} -> {DestinationIp|?}:{DestinationPort|?}"),
    ((8,), ("provider", "Sysmon", True), "[Sysmon:RemoteThread] {SourceImage|?} -> {TargetImage|?}"),
    ((11,), ("provider", "Sysmon", True), "[Sysmon:FileCreate] {Image|?} created {TargetFilename|?}"),
    ((12, 13, 14), ("provider", "Sysmon", True), "[Sysmon:Registry] {Image|?} -> {TargetObject|?}« = {!Details|}»"),
    ((106,), None, "[TaskRegistered] {TaskName|?} (user: {UserContext|})"),
    ((200,), None, "[TaskStarted] {TaskName|?} -> {ActionName|}"),
    ((201,), None, "[TaskCompleted] {TaskName|?} (result: {ResultCode|?})"),
    ((5857, 5858, 5859, 5860, 5861), None, "[WMI:{.event_id}] {Operation|} {Query|PossibleCause|}"),
    ((1024,), ("channel", "RDPClient", True), "[RDPClient] Connecting to {Value|?}"),
    ((1116,), None, "[Defender:Detection] {Threat Name|ThreatName|?} at {Path|}"),
    ((1117,), None, "[Defender:Action] {Threat Name|ThreatName|?} -> {Action Name|ActionName|?}"),
    ((5140, 5145), None, r"[Share] {ShareName|?}\{RelativeTargetName|} by {SubjectUserName|?} from {IpAddress|-}"),
]
OTHER = "[EVT:{.channel}] EID:{.event_id} on {.computer}"


def _field(inside: str, data: Column) -> Column:
    if inside.startswith("."):
        return F.coalesce(F.col(inside[1:]).cast("string"), F.lit(""))
    inside, _, cut = inside.lstrip("!").partition("/")
    *names, missing = inside.split("|")
    found = F.coalesce(*(F.element_at(data, n) for n in names), F.lit(missing))
    return F.when(F.octet_length(found) > int(cut), F.concat(F.left(found, F.lit(int(cut))), F.lit("..."))).otherwise(found) if cut else found


def _filled(template: str, data: Column) -> Column:
    parts = []
    for piece in re.findall(r"«[^»]*»|\{[^}]*\}|[^{«]+", template):
        if piece.startswith("«"):
            name = re.search(r"\{!([^|}]*)", piece)[1]  # type: ignore[index]
            parts.append(F.when(F.coalesce(F.element_at(data, name), F.lit("")) != "", _filled(piece[1:-1], data)).otherwise(""))
        elif piece.startswith("{"):
            parts.append(_field(piece[1:-1], data))
        else:
            parts.append(F.lit(piece))
    return reduce(lambda a, b: F.concat(a, b), parts)


def description(data: str = "event_data") -> Column:
    """The text of an event-log record with columns event_id, channel, provider, computer and a map of event data."""
    chosen = F
    for ids, need, template in TEMPLATES:
        chosen = chosen.when(F.col("event_id").isin(*ids) & _needs(need), _filled(template, F.col(data)))
    return chosen.otherwise(_filled(OTHER, F.col(data)))


# Texts and codes of user-registry rows.
USER_REGISTRY = {
    "TypedPath": ("[TypedPath] {value_data} (user: {username})", "ACC"),
    "SearchQuery": ('[SearchQuery] "{value_data}" (user: {username})', "Search"),
    "OpenSaveDialog": ("[OpenSave] {value_data} (user: {username}, key: {value_name})", "ACC"),
    "LastVisitedApp": ("[LastVisitedApp] {value_data} (user: {username})", "EXEC"),
}


def user_registry_row(kind: str = "activity") -> tuple[Column, Column]:
    """Text and code of a user-registry row with columns activity, value_data, value_name and username."""
    text, code = F, F
    for name, (template, event) in USER_REGISTRY.items():
        parts = [F.coalesce(F.col(p[1:-1]), F.lit("")) if p.startswith("{") else F.lit(p) for p in re.findall(r"\{[^}]*\}|[^{]+", template)]
        text, code = text.when(F.col(kind) == name, F.concat(*parts)), code.when(F.col(kind) == name, event)
    return text, code
