"""Times as epoch seconds and as ISO texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_text(epoch: Column) -> Column:
    """Whole seconds in UTC, as 2024-01-31T23:59:59Z. The session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(epoch)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_epoch(text: Column) -> Column:
    """Epoch seconds of an ISO text with Z, an offset or neither (UTC then), a date alone being its midnight; null if it is none."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    whole = F.regexp_replace(text, r"^(.{10})$", "$1T00:00:00")
    whole = F.regexp_replace(whole, r"^(.{13}:\d{2})(?=$|[Z+-])", "$1:00")
    whole = F.regexp_replace(whole, r"([+-]\d{2})(\d{2})$", "$1:$2")
    at = F.try_to_timestamp(F.when(F.regexp_like(whole, F.lit(r".{16}.*(Z|[+-]\d{2}:\d{2})$")), whole).otherwise(F.concat(whole, F.lit("Z"))))
    return F.when(F.regexp_like(text, F.lit(shape)), F.unix_micros(at) / 1e6)


def stamp_text(iso: Column) -> Column:
    """Month, day, hour and minute of an ISO text; a dash for none."""
    return F.when(F.length(iso) > 0, F.concat(F.substring(iso, 6, 5), F.lit(" "), F.substring(iso, 12, 5))).otherwise("—")


def duration_text(hours: Column) -> Column:
    """'12 h' from ten hours on, '3.5 h' below."""
    whole, tenth = F.floor(hours + 0.5).cast("string"), F.format_string("%.1f", hours.cast("double"))
    return F.concat(F.when(hours >= 10, whole).otherwise(tenth), F.lit(" h"))
