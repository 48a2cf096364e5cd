"""Confidence curves and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BASELINE_CONFIDENCE, CONFIDENCE_CEILING, CONFIDENCE_FLOOR, CONFIDENCE_RATIO, DECAY_PER_DAY, FRESH_DAYS


def for_observations(n: Column) -> Column:
    """Confidence after n observations: 0.6, 0.8, 0.9, ...; below one is an error, null is null."""
    refused = F.raise_error(F.concat(F.lit("a count of observations must be 1 or more, not "), n.cast("string"))).cast("double")
    return F.when(n < 1, refused).when(n >= 1, F.least(1.0 - (1.0 - BASELINE_CONFIDENCE) * F.pow(F.lit(CONFIDENCE_RATIO), n - 1), F.lit(CONFIDENCE_CEILING)))


def age_days(observed_at: Column, now: Column) -> Column:
    """Days between two timestamps, with their fraction."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(observed_at.cast("timestamp"))) / 86_400_000_000


def decayed(confidence: Column, days: Column) -> Column:
    """Confidence that was last confirmed `days` ago; a negative age is an error, null is null."""
    past = confidence - F.lit(DECAY_PER_DAY) * (days - FRESH_DAYS)
    refused = F.raise_error(F.concat(F.lit("an age must not be negative, as "), days.cast("string"), F.lit(" days are"))).cast("double")
    return F.when(days < 0, refused).when(days.isNull(), None).when(days <= FRESH_DAYS, confidence).otherwise(F.greatest(F.lit(CONFIDENCE_FLOOR), F.least(confidence, past)))


def timedelta_text(seconds: Column) -> Column:
    """A whole number of seconds as `[D day[s], ]H:MM:SS`."""
    days = F.floor(seconds / 86_400)
    rest = seconds - days * 86_400
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), (rest % 60).cast("long"))
    return F.when(days == 0, clock).otherwise(F.format_string("%d day%s, %s", days, F.when(F.abs(days) == 1, "").otherwise("s"), clock))


def port_label(protocol: Column, low: Column, high: Column) -> Column:
    """`all traffic`, `tcp/443`, `tcp/8000-8100` or `tcp`."""
    return (
        F.when(protocol == "-1", "all traffic")
        .when(low.isNull() | high.isNull(), protocol)
        .when(low == high, F.concat_ws("/", protocol, low.cast("string")))
        .otherwise(F.concat(protocol, F.lit("/"), low.cast("string"), F.lit("-"), high.cast("string")))
    )


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and plain numbers, so that equal objects are equal texts."""
    return F.to_json(F.parse_json(text))


def canonical_id(*parts: Column) -> Column:
    """A deterministic id in the shape of a UUID."""
    h = F.sha2(F.concat_ws("\u0001", *parts).cast("binary"), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def iso_timestamp(text: Column) -> Column:
    """An ISO-8601 time; without an offset it is UTC, as the session's time zone is."""
    return F.try_to_timestamp(text)
