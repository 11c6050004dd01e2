"""Times and durations. Seconds are BIGINT inside; text only at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv


#: More minutes than any limit has, yet safe to multiply and add up in 64 bits.
BEYOND = 10**14
#: The last second of the year 9999: no time of a job lies beyond it.
LAST_EPOCH = 253_402_300_799


def _whole(value: Column) -> Column:
    return value.cast("bigint")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _digits(text: Column) -> Column:
    """A number of any count of digits; from `BEYOND` on they all count as that."""
    return F.least(F.coalesce(text.try_cast("bigint"), F.lit(BEYOND)), F.lit(BEYOND))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind, not only spaces."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\f"))


def is_epoch(epoch: Column) -> Column:
    """Whether a number can be the time of a job, in seconds either side of 1970."""
    return epoch.between(-LAST_EPOCH, LAST_EPOCH)


def epoch_to_ts(epoch: Column) -> Column:
    """Epoch seconds to TIMESTAMP; zero and times out of range mean not set."""
    return F.when(is_epoch(epoch), F.timestamp_seconds(F.nullif(epoch, F.lit(0))))


def iso_utc(ts: Column) -> Column:
    """TIMESTAMP as ISO-8601 UTC text, whatever the session's time zone is."""
    seconds = F.unix_seconds(ts)
    day = F.floor(seconds / 86400).cast("int")
    rest = F.pmod(seconds, F.lit(86400))
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), to_clock(rest), F.lit("Z"))


def ntz_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp read as UTC, whatever the session's zone is."""
    day = F.unix_date(ts.cast("date")).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def ntz_micros(ts: Column) -> Column:
    fraction = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    return ntz_seconds(ts) * 1_000_000 + fraction


def runtime_seconds(start: Column, end: Column, as_of: Column) -> Column:
    """Seconds from start to end; not started is 0, still running counts to ``as_of``."""
    upto = F.unix_seconds(F.coalesce(end, as_of))
    return F.coalesce(F.greatest(F.lit(0), upto - F.unix_seconds(start)), F.lit(0)).cast("bigint")


def two_digits(n: Column) -> Column:
    """At least two digits. Plain text functions are far cheaper here than a format string."""
    text = n.cast("string")
    return F.when(n < 10, F.concat(F.lit("0"), text)).otherwise(text)


def to_clock(seconds: Column) -> Column:
    """``HH:MM:SS``; hours may exceed 99."""
    s = _whole(seconds)
    hours, minutes, secs = map(two_digits, (_div(s, 3600), _div(s % 3600, 60), s % 60))
    return F.concat(hours, F.lit(":"), minutes, F.lit(":"), secs)


def from_clock(text: Column) -> Column:
    """Seconds of ``HH:MM:SS``; any other shape is NULL."""
    parts = F.split(text, ":")
    h, m, s = (F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in (1, 2, 3))
    return F.when(F.size(parts) == 3, h * 3600 + m * 60 + s)


def time_limit_minutes(text: Column) -> Column:
    """Minutes of a Slurm time limit; seconds are dropped, empty is 0, unreadable is NULL.

    Forms: ``5m`` ``1h`` ``30s`` (at least one minute), ``MM:SS``, ``HH:MM:SS``,
    each with an optional ``D-`` in front of the clock forms, and bare minutes.
    Numbers may have any count of digits; one too large for a limit counts as `BEYOND`.
    """
    t = strip(text)
    unit, amount_text = F.lower(F.right(t, F.lit(1))), F.left(t, F.length(t) - 1)
    amount = _digits(amount_text)
    with_unit = (
        F.when(unit == "m", amount)
        .when(unit == "h", amount * 60)
        .otherwise(F.greatest(F.lit(1), _div(amount, 60)))
    )
    days = F.when(t.contains("-"), _digits(F.substring_index(t, "-", 1)))
    parts = F.split(F.substring_index(t, "-", -1), ":")
    p1, p2, p3 = (F.when(F.get(parts, i).isNotNull(), _digits(F.get(parts, i))) for i in range(3))
    clock = F.when(p3.isNotNull(), p1 * 60 + p2 + _div(p3, 60)).otherwise(
        p1 + F.coalesce(_div(p2, 60), F.lit(0))
    )
    return (
        F.when(text == "", F.lit(0))
        .when(t.rlike(r"^\d+[smhSMH]$"), with_unit)
        .when(
            t.rlike(r"^(\d+-)?\d+(:\d+){0,2}$"),
            F.coalesce(days, F.lit(0)) * 1440 + clock,
        )
        .cast("bigint")
    )


def flux_duration_seconds(text: Column) -> Column:
    """Seconds of a Flux duration prefix (``1.5h``, ``90m``, ``42``); missing is 0.

    A prefix of digits and dots that is no number (``1.2.3s``) is NULL.
    """
    number = F.regexp_extract(text, r"^[0-9.]+", 0)
    unit = F.substr(text, F.length(number) + 1, F.lit(1))
    factor = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    seconds = (number.try_cast("double") * factor).try_cast("bigint")
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit(0)).otherwise(seconds)


def duration_human(seconds: Column) -> Column:
    """``1h0m5s``, ``1h0s``, ``1m5s``, ``5s``."""
    s = _whole(seconds)
    hours, minutes, secs = _div(s, 3600), _div(s % 3600, 60), s % 60
    none = F.lit("")
    return F.concat(
        F.when(hours != 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(none),
        F.when(minutes != 0, F.concat(minutes.cast("string"), F.lit("m")))
        .when((hours != 0) & (secs != 0), F.lit("0m"))
        .otherwise(none),
        secs.cast("string"),
        F.lit("s"),
    )


def cpu_seconds(measured: Column, runtime: Column) -> Column:
    """Measured CPU seconds, else a fixed share of the runtime, cut to whole seconds."""
    return F.coalesce(measured.cast("bigint"), (runtime * F.lit(fv.CPU_TIME_SHARE)).cast("bigint"))


def wait_seconds(submitted: Column, started: Column) -> Column:
    """Seconds in the queue; NULL while not started."""
    waited = F.unix_seconds(started) - F.unix_seconds(submitted)
    return F.when(started.isNotNull(), F.greatest(F.lit(0).cast("bigint"), waited))


def cpu_efficiency(cpu: Column, runtime: Column, cpus: Column) -> Column:
    """CPU time over what the allocation could have used; NULL without any."""
    possible = runtime * cpus
    return F.when(possible > 0, cpu / possible)
