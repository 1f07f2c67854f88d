"""Text helpers: hour keys, rule ids, CSV quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_key(ts: Column) -> Column:
    """UTC hour of a timestamp as ``yyyy-MM-ddTHH:00:00Z``; sorts like the time itself."""
    return F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd'T'HH:00:00'Z'")


def slug(description: Column) -> Column:
    """Readable id: lower case, other characters collapse to ``-``, one dash dropped at each end."""
    dashed = F.regexp_replace(F.lower(description), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


def csv_escape(value: Column) -> Column:
    return F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""'))


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), csv_escape(value), F.lit('"'))


def instant_text(ts: Column) -> Column:
    """ISO-8601 instant: no fraction when the second is whole, else 3 or 6 digits."""
    micros = F.unix_micros(ts)
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = (
        F.when(micros % 1000000 == 0, F.lit(""))
        .when(micros % 1000 == 0, F.date_format(ts, ".SSS"))
        .otherwise(F.date_format(ts, ".SSSSSS"))
    )
    return F.concat(base, fraction, F.lit("Z"))
