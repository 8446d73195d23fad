"""Score columns: age, recency, length and the composite rating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried one after the other for a published time.
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mmXXX",
    "yyyy-MM-dd",
    "EEE, d MMM yyyy HH:mm:ss Z",
    "EEE, d MMM yyyy HH:mm:ss z",
    "MM/dd/yyyy HH:mm:ss",
    "d MMM yyyy",
    "MMMM d, yyyy",
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_time(text, now: Column) -> Column:
    """Timestamp of a free-form time text; one day before ``now`` if none of the formats fits.

    Times without a zone are read in the session zone, which the engine sets to UTC.
    """
    text = _col(text)
    # A weekday in front of the date is not needed and parses only in the legacy policy.
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    tries = [F.try_to_timestamp(bare, F.lit(f.replace("EEE, ", ""))) for f in TIME_FORMATS]
    return F.when(text.isNotNull(), F.coalesce(*tries, now - F.expr("interval 1 day")))


def zulu(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def plausible_time(text, now: Column) -> Column:
    """A time text that does not begin with ``20`` counts as one day before ``now``."""
    text = _col(text)
    return F.when(text.startswith("20"), text).otherwise(zulu(now - F.expr("interval 1 day")))


def age_days(ts, now: Column) -> Column:
    """Days between ``ts`` and ``now``, never negative."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(_col(ts).cast("timestamp"))
    return F.greatest(micros / F.lit(86400 * 1e6), F.lit(0.0))


def recency_score(age) -> Column:
    """1 at age 0, 0 after a day, towards -1 for old items."""
    return 2 * F.exp(-F.ln(F.lit(2.0)) * _col(age)) - 1


def length_score(length) -> Column:
    """0 up to 1000 characters, 1 at 10000, 2 from 100000 on."""
    digits = F.log10(F.greatest(_col(length).cast("double"), F.lit(1.0)))
    return F.least(F.greatest(digits - 3, F.lit(0.0)), F.lit(2.0))


def composite_rating(reputation, length, on_topic, important, low_quality, bt_z, recency) -> Column:
    """Sum of the terms; missing reputation and low_quality are 0, missing verdicts are 1."""

    def term(value, default):
        return F.coalesce(_col(value).cast("double"), F.lit(float(default)))

    return (
        term(reputation, 0) + _col(length) + term(on_topic, 1) + term(important, 1)
        - term(low_quality, 0) + term(bt_z, 0) + _col(recency)
    )


def tournament_points(z) -> Column:
    return (_col(z) + 1.5) * 1.5


def duration_text(start, end) -> Column:
    """Minutes and seconds between two times as ``m:ss``."""
    seconds = F.unix_timestamp(_col(end).cast("timestamp")) - F.unix_timestamp(_col(start).cast("timestamp"))
    return F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60)
