"""Guarded timestamps, study phases and calendar labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Study phases, first and last day: fixed values.
PHASES = (
    ("P1_global_onset", "2020-01-31", "2020-11-30"),
    ("P2_pre_vaccine", "2020-12-01", "2020-12-31"),
    ("P3_vaccine_rollout", "2021-01-01", "2021-05-31"),
    ("P4_delta_wave", "2021-06-01", "2021-11-30"),
    ("P5_omicron_wave", "2021-12-01", "2022-06-30"),
    ("P6_transition_end", "2022-07-01", "2023-05-05"),
)


def parse_timestamp(value: Column, capture: bool = False) -> Column:
    """UTC timestamp of an ISO date or date-time, or of 14 digits if ``capture``; anything else is null.

    ISO forms: year-month-day and year-week(-day), with or without dashes; times of hours, minutes, seconds and
    fractions, with or without colons; offsets. Without an offset times are UTC. Numbers are epochs, so null, but a
    capture's whole number is read by its digits. A bare year or time is null.
    """
    s = F.trim(value.cast("string"))
    if capture:
        s = F.regexp_replace(s, r"^(\d{14})\.0+$", "$1")
    day = r"^(\d{4})-?(\d{2})-?(\d{2})"
    week = r"^(\d{4})-?W(\d{2})(?:-?(\d))?"
    rest = r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?)?$"
    dated = s.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{8})" + rest)
    weekly = s.rlike(r"^(\d{4}-W\d{2}(-\d)?|\d{4}W\d{2}\d?)" + rest)
    part = lambda form, i: F.regexp_extract(s, form + rest, i)
    ymd = F.try_to_timestamp(F.concat_ws("-", part(day, 1), part(day, 2), part(day, 3)), F.lit("yyyy-MM-dd")).cast("date")
    # The Monday of week 1 is that of the week with January 4.
    first = F.date_trunc("week", F.make_date(part(week, 1).cast("int"), F.lit(1), F.lit(4))).cast("date")
    at = F.date_add(first, (part(week, 2).cast("int") - 1) * 7 + F.coalesce(F.nullif(part(week, 3), F.lit("")).cast("int"), F.lit(1)) - 1)
    exists = part(week, 2).cast("int").between(1, 53) & F.coalesce(F.nullif(part(week, 3), F.lit("")).cast("int"), F.lit(1)).between(1, 7)
    same_year = F.extract(F.lit("YEAROFWEEK"), at) == part(week, 1).cast("int")

    def clock(form: str, date: Column) -> Column:
        n = lambda i: F.coalesce(F.nullif(part(form, i), F.lit("")).cast("int"), F.lit(0))
        h, m, sec = n(4), n(5), n(6)
        micro = F.rpad(F.substring(part(form, 7), 1, 6), 6, "0").cast("long")
        micro = F.coalesce(F.when(part(form, 7) != "", micro), F.lit(0))
        zone = part(form, 8)
        z = lambda i: F.coalesce(F.nullif(F.regexp_extract(zone, r"^[+-](\d{2})(?::?(\d{2}))?(?::?(\d{2}))?", i), F.lit("")).cast("int"), F.lit(0))
        away = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (z(1) * 3600 + z(2) * 60 + z(3))
        fits = (h < 24) & (m < 60) & (sec < 60) & (z(1) < 24) & (z(2) < 60)
        micros = F.unix_date(date).cast("long") * 86_400_000_000 + ((h * 3600 + m * 60 + sec - away).cast("long") * 1_000_000 + micro)
        return F.when(fits, F.timestamp_micros(micros))

    out = F.when(s.isin("", "NaT", "nan", "<NA>"), None).when(dated, clock(day, ymd)).when(weekly & exists, F.when(same_year, clock(week, at)))
    if capture:
        return F.when(s.rlike(r"^\d{14}$"), F.try_to_timestamp(s, F.lit("yyyyMMddHHmmss"))).otherwise(out)
    return out


def phase_of(day: Column, phases=PHASES) -> Column:
    """The phase whose days, both ends included, have this one; null outside."""
    out = None
    for name, first, last in phases:
        inside = day.between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return out


def event_time(published: Column, captured: Column) -> Column:
    """A valid publication time wins, even outside the study; else the capture's."""
    return F.coalesce(published, captured)


def event_phase(published: Column, captured: Column) -> Column:
    t = event_time(published, captured)
    return F.when(t.isNull(), "undated").otherwise(F.coalesce(phase_of(t.cast("date")), F.lit("outside_study")))


def date_source(published: Column, captured: Column) -> Column:
    return F.when(published.isNotNull(), "publish_date").when(captured.isNotNull(), "capture_timestamp")


def observation_month(t: Column, phase: Column) -> Column:
    return F.coalesce(F.date_format(t, "yyyy-MM"), F.concat(F.lit("undated:"), F.coalesce(phase, F.lit("unknown"))))


def iso_week(day: Column) -> Column:
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.extract(F.lit("WEEK"), day))


def window_end(month: Column) -> Column:
    """The last microsecond of a month."""
    return F.add_months(month, 1).cast("timestamp") - F.expr("interval 1 microsecond")


def cdx_window(first: str, last: str) -> tuple[str, str]:
    """Bounds of a phase as capture indexes take them."""
    return first.replace("-", "") + "000000", last.replace("-", "") + "235959"


def captured_at(timestamp: Column) -> Column:
    return F.try_to_timestamp(timestamp, F.lit("yyyyMMddHHmmss"))


def assigned(published: Column, captured: Column, capture_phase: Column, phase: Column) -> dict[str, Column]:
    """Columns of a document's event time: the phase it was captured in is kept beside that of the event."""
    t = event_time(published, captured)
    return {
        "capture_phase": F.coalesce(capture_phase, phase, phase_of(captured.cast("date"))), "phase": event_phase(published, captured),
        "event_date": F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), "event_date_source": date_source(published, captured),
    }


def selected_phase(captured: Column, capture_phase: Column, phase: Column) -> Column:
    """The phase that a capture is selected by: its time's, else its labels."""
    return F.coalesce(phase_of(captured.cast("date")), capture_phase, phase)
