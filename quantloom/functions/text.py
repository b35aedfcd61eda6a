"""Column functions for news: times, summaries, market hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def published(text: Column) -> Column:
    """Timestamp of an ISO-8601 or RFC-822 text, offsets normalized; null for anything else."""
    iso = F.try_to_timestamp(text)
    rest = F.substr(text, F.lit(6))
    named = F.try_to_timestamp(rest, F.lit("dd MMM yyyy HH:mm:ss z"))
    offset = F.try_to_timestamp(rest, F.lit("dd MMM yyyy HH:mm:ss xx"))
    return F.coalesce(iso, named, offset)


def time_ago(text: Column, at: Column, asof: Column) -> Column:
    """'5m ago', '3h ago', 'Yesterday', '4d ago', else a date; unreadable times keep ten characters; the future is now."""
    secs = F.greatest(F.unix_timestamp(asof) - F.unix_timestamp(at), F.lit(0))
    days = F.floor(secs / 86400)
    said = lambda v, unit: F.concat(F.floor(v).cast("string"), F.lit(f"{unit} ago"))
    known = F.when(days == 0, F.when(secs < 3600, said(secs / 60, "m")).otherwise(said(secs / 3600, "h"))).when(days == 1, "Yesterday").when(days < 7, said(days, "d")).otherwise(F.date_format(at, "MMM dd, yyyy"))
    return F.when(at.isNotNull(), known).when(F.length(F.coalesce(text, F.lit(""))) > 0, F.substring(text, 1, 10)).otherwise("Recent")


def summary(title: Column, description: Column) -> Column:
    """Cleaned description of at most 150 characters; with a short one, the title's first eight words."""
    clean = description
    for a, b in (("<![CDATA[", ""), ("]]>", ""), ("<p>", ""), ("</p>", ""), ("<br>", " "), ("<br/>", " ")):
        clean = F.replace(clean, F.lit(a), F.lit(b))
    words = F.split(F.trim(title), r"\s+")
    short = F.when(F.size(words) > 8, F.concat(F.array_join(F.slice(words, 1, 8), " "), F.lit("..."))).otherwise(title)
    return F.when(F.length(description) > 20, F.when(F.length(clean) > 150, F.concat(F.substring(clean, 1, 147), F.lit("..."))).otherwise(clean)).otherwise(short)


def market_open(utc: Column) -> Column:
    """Weekdays from 9:30 until before 16:00 in New York; holidays are not known."""
    ny = F.from_utc_timestamp(utc, "America/New_York")
    minutes = F.hour(ny) * 60 + F.minute(ny)
    return F.dayofweek(ny).between(2, 6) & minutes.between(570, 959)
