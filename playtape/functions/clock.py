"""Game clock and wall clock expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playtape.fixed_values import OVERTIME_SECONDS, PERIOD_SECONDS, REGULATION_PERIODS, REGULATION_SECONDS


def clock_seconds(text: Column) -> Column:
    """``"11:34"`` or ``"0:07.3"`` as seconds; null when malformed."""
    minutes = F.split(text, ":", 2)
    return F.when(
        text.contains(":"),
        F.get(minutes, 0).try_cast("int") * 60 + F.get(minutes, 1).try_cast("double"),
    )


def period_start(period: Column) -> Column:
    """Seconds of game clock before the period: four of 720, then overtimes of 300."""
    overtime = F.lit(REGULATION_SECONDS) + (period - REGULATION_PERIODS - 1) * OVERTIME_SECONDS
    return F.when(period <= REGULATION_PERIODS, (period - 1) * PERIOD_SECONDS).otherwise(overtime)


def period_length(period: Column) -> Column:
    return F.when(period <= REGULATION_PERIODS, F.lit(PERIOD_SECONDS)).otherwise(F.lit(OVERTIME_SECONDS))


def seconds_elapsed(period: Column, left: Column) -> Column:
    return period_start(period) + (period_length(period) - left)


def regulation_left(elapsed: Column) -> Column:
    """Seconds to the end of regulation; negative in overtime."""
    return F.lit(REGULATION_SECONDS) - elapsed


def game_length(last_period: Column) -> Column:
    """Game clock of a whole game, overtime included."""
    extra = F.greatest(last_period - REGULATION_PERIODS, F.lit(0)) * OVERTIME_SECONDS
    return (F.lit(REGULATION_SECONDS) + extra).cast("double")


def horizon_left(period: Column, regulation: Column, in_period: Column) -> Column:
    """Seconds to the end of regulation, or of the overtime being played."""
    return F.when(period <= REGULATION_PERIODS, regulation).otherwise(in_period)


def fraction_left(period: Column, left: Column) -> Column:
    total = F.when(period <= REGULATION_PERIODS, F.lit(float(REGULATION_SECONDS))).otherwise(
        F.lit(float(OVERTIME_SECONDS))
    )
    return F.when(left.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / total)))


def instant(text: Column) -> Column:
    """An ISO stamp with offset as a UTC instant; a stamp without seconds is completed first; else null."""
    full = F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})?$", "$1:00$2")
    return full.try_cast("timestamp")


def whole_second(ts: Column) -> Column:
    """Timestamp to the nearest unix second, halves to even."""
    return F.rint(F.unix_micros(ts) / F.lit(1e6)).cast("bigint")


def floor_to_grid(unix: Column, step: int | Column, phase: int | Column = 0) -> Column:
    """Latest point of the (step, phase) grid at or before a unix second."""
    step = F.lit(step) if isinstance(step, int) else step
    phase = F.lit(phase) if isinstance(phase, int) else phase
    return unix - F.pmod(unix - phase, step)


def floor_minutes(ts: Column, minutes: int) -> Column:
    """Timestamp floored to N minutes; N = 0 keeps it."""
    if not minutes:
        return ts
    return F.timestamp_seconds(floor_to_grid(F.unix_seconds(ts), 60 * minutes))


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def quarter_label(period: Column) -> Column:
    return F.when(period <= REGULATION_PERIODS, F.concat(F.lit("Q"), period.cast("string"))).otherwise("OT")
