"""Anomaly flags as bit columns, and their three renderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscope import schema as S
from chronoscope.functions.times import TICKS_A_SECOND


def si_before_fn(si_created: Column, fn_created: Column) -> Column:
    return F.when(si_created < fn_created, S.TIMESTOMPED_SI_LT_FN).otherwise(0)


def zero_subseconds(*pairs: tuple[Column, Column]) -> Column:
    """Set where a pair's first ticks are whole seconds and its second aren't."""
    hit = [F.coalesce((a % TICKS_A_SECOND == 0) & (b % TICKS_A_SECOND != 0), F.lit(False)) for a, b in pairs]
    return F.when(reduce(lambda x, y: x | y, hit), S.TIMESTOMPED_ZERO_NANOS).otherwise(0)


def flag_when(condition: Column, bit: int) -> Column:
    return F.when(condition, bit).otherwise(0)


def file_flags(ticks: str = "ticks", has_ads: str = "metadata.has_ads") -> Column:
    """All flags that one file-table row decides."""
    def of(name: str) -> Column:
        return F.col(f"{ticks}.{name}")

    zero = zero_subseconds((of("si_created"), of("fn_created")), (of("si_modified"), of("fn_modified")))
    return si_before_fn(of("si_created"), of("fn_created")).bitwiseOR(zero).bitwiseOR(flag_when(F.col(has_ads), S.HIDDEN_ADS))


def has(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits)) != 0


def _labels(flags: Column, names: list[tuple[int, str]], separator: str) -> Column:
    return F.concat_ws(separator, *(F.when(has(flags, bit), name) for bit, name in names))


# Labels in a CSV file, in a table and in a detail view, in their order.
CSV_LABELS = [(0x01, "STOMP"), (0x02, "ZERO_NANOS"), (0x04, "BACKDATED"), (0x08, "NO_USN"), (0x10, "LOG_GAP"), (0x20, "LOG_CLEARED"), (0x40, "NO_PREFETCH"), (0x80, "ADS")]
TABLE_LABELS = [(0x01 | 0x02, "STOMP"), (0x02, "0NANO"), (0x80, "ADS"), (0x20, "CLEAR")]
DETAIL_LABELS = [
    (0x01, "SI_CREATED < FN_CREATED (timestomping)"),
    (0x02, "SI has zero nanoseconds (tool artifact)"),
    (0x04, "Metadata timestamps backdated"),
    (0x08, "No USN Journal create record"),
    (0x10, "$LogFile gap detected"),
    (0x20, "Event log cleared"),
    (0x40, "Execution without prefetch"),
    (0x80, "Hidden Alternate Data Stream"),
]


def csv_labels(flags: Column) -> Column:
    return _labels(flags, CSV_LABELS, "|")


def table_labels(flags: Column) -> Column:
    return _labels(flags, TABLE_LABELS, ",")


def detail_labels(flags: Column) -> Column:
    return _labels(flags, DETAIL_LABELS, " | ")


def without_partner(rows: DataFrame, partners: DataFrame, key: str, bit: int) -> DataFrame:
    """rows with ``bit`` set in anomalies where no partner has the key; a null key has none."""
    known = partners.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, key, "left")
    return joined.withColumn("anomalies", F.col("anomalies").bitwiseOR(flag_when(F.col("_known").isNull(), bit))).drop("_known")
