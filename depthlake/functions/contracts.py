"""Dated futures: aliases of contracts by the time to expiry, and the continuous contract made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Contracts expire at 16:00 in this zone; quarters are 91 days apart from this date on.
ZONE, EXPIRY_HOUR = "Asia/Shanghai", 16
QUARTER_BASE, QUARTER_DAYS = "2022-12-30", 91
DAY_MS = 86_400_000


def is_dated_future(inst_id: Column) -> Column:
    """True for ids of four parts whose third is all digits."""
    return inst_id.rlike("^[^-]+-[^-]+-[0-9]+-[^-]+$")


def expiry_ms(day: Column, zone: str = ZONE) -> Column:
    """The expiry of a day yyMMdd, in milliseconds."""
    local = F.to_timestamp_ntz(F.concat(F.lit("20"), day), F.lit("yyyyMMdd")) + F.make_dt_interval(hours=F.lit(EXPIRY_HOUR))
    return F.unix_millis(F.to_utc_timestamp(local.cast("timestamp"), zone)) if zone != "UTC" else F.unix_millis(local.cast("timestamp"))


def contract_alias(now_ms: Column, day: Column, zone: str = ZONE, mode: str = "null") -> Column:
    """this_week, next_week, this_quarter, next_quarter or other; for quarters calendar dates count.

    An expiry that has passed, or a time before the first quarter day, gives null, or an error with mode raise. The session's zone must be UTC.
    """
    left = expiry_ms(day, zone) - now_ms
    days = F.datediff(F.to_date(F.concat(F.lit("20"), day), "yyyyMMdd"), F.to_date(F.lit(QUARTER_BASE)))
    on_cycle = days % QUARTER_DAYS == 0
    alias = (
        F.when(left <= 7 * DAY_MS, "this_week")
        .when(left <= 14 * DAY_MS, "next_week")
        .when(on_cycle & (left <= QUARTER_DAYS * DAY_MS), "this_quarter")
        .when(on_cycle & (left <= 2 * QUARTER_DAYS * DAY_MS), "next_quarter")
        .otherwise("other")
    )
    base = F.unix_millis(F.to_timestamp(F.lit(QUARTER_BASE), "yyyy-MM-dd"))
    valid = (left > 0) & (now_ms > base)
    if mode == "raise":
        return F.when(valid, alias).otherwise(F.raise_error(F.concat(F.lit("no contract: "), day)).cast("string"))
    return F.when(valid, alias)


def alias_flags(now_ms: Column, day: Column, zone: str = ZONE) -> dict[str, Column]:
    """is_this_week, is_next_week, is_this_quarter and is_next_quarter, each on its own: a contract can be of a week and of a quarter."""
    left = expiry_ms(day, zone) - now_ms
    on_cycle = F.datediff(F.to_date(F.concat(F.lit("20"), day), "yyyyMMdd"), F.to_date(F.lit(QUARTER_BASE))) % QUARTER_DAYS == 0
    between = lambda a, b: (left > a * DAY_MS) & (left <= b * DAY_MS)
    return {"is_this_week": between(0, 7), "is_next_week": between(7, 14), "is_this_quarter": on_cycle & between(0, QUARTER_DAYS), "is_next_quarter": on_cycle & between(QUARTER_DAYS, 2 * QUARTER_DAYS)}


def continuous_contract(rows: DataFrame, files: DataFrame, alias: str = "this_week", suffix: str = "TWEEK", zone: str = ZONE) -> DataFrame:
    """rows (with dsID and file start startTimestamp) of dated futures while they were this week's contract, as one instrument <pair>-<suffix>.

    files: (dsID, startTimestamp as text or number). Ids that aren't dated futures are left out.
    """
    inst = F.regexp_replace("dsID", "-400$", "")
    flags = files.where(is_dated_future(inst)).withColumn("_now", F.col("startTimestamp").cast("long"))
    chosen = flags.where(alias_flags(F.col("_now"), F.split(inst, "-")[2], zone)[f"is_{alias}"]).select("dsID", "startTimestamp").distinct()
    kept = rows.join(chosen, ["dsID", "startTimestamp"], "left_semi")
    parts = F.split(F.regexp_replace("dsID", "-400$", ""), "-")
    return kept.withColumn("instId", F.concat_ws("-", parts[0], parts[1], F.lit(suffix)))
