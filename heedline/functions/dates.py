"""Mail dates, week buckets and due phrases.

``as_of`` is always an argument: a date (or timestamp_ntz) column or literal.  No expression
reads the clock.
"""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from heedline import constants as C
from heedline.functions.text import col, filled, left, let, let_sql, or_empty, sql_list

# Optional weekday, then either "20 Apr 2026", "20-Apr-2026" or "Apr 20 2026", a clock time
# and a zone.  Groups: day, month, month, day, year, hour, minute, second, zone.
_DATE_PATTERN = (
    r"(?is)^\s*(?:[^\s,]*,\s*|(?:mon|tue|wed|thu|fri|sat|sun)\s+)?"
    r"(?:(\d{1,2}),?(?:\s+|-)([a-z]{3,9})|([a-z]{3,9})\s+(\d{1,2}),?)(?:\s+|-)(\d{1,4}),?"
    r"\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?,?(?:\s*([+-]\d{1,5})|\s+([^\s]+))?(?:\s.*)?$"
)
_SEP = "\x1f"
_FIELDS = _SEP.join(f"${i}" for i in range(1, 11))


def as_of_date(as_of: Column | str | dt.date) -> Column:
    return as_of.cast("date") if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def _zone_offset_sql() -> str:
    """Seconds east of UTC of the zone text ``z``; NULL for none, -0000 or an unknown name."""
    named = " ".join(f"WHEN '{zone}' THEN {hhmm}" for zone, hhmm in C.ZONE_HHMM.items())
    number = "try_cast(z AS int)"
    hhmm = f"CASE WHEN z LIKE '-%' AND {number} = 0 THEN NULL ELSE CASE z {named} ELSE {number} END END"
    seconds = "cast(signum(n) * (floor(abs(n) / 100) * 3600 + abs(n) % 100 * 60) AS bigint)"
    return let_sql("n", hhmm, seconds)


def mail_date(header: str) -> Column:
    """A mail date column as struct<year, month, day, wall, utc_offset>.

    ``wall`` is the header's own clock, NULL when it cannot be read; ``utc_offset`` is in
    seconds, NULL for a naive date.  Read the header once and take the fields you need.

    One regex pass cuts the header into ten texts; the rest works on those.  It is SQL text
    because each field is used several times and must be computed once.
    """
    pieces = f"split(regexp_replace(coalesce({header}, ''), r'{_DATE_PATTERN}', '{_FIELDS}'), '{_SEP}')"
    months = f"array({sql_list(C.MONTHS_SHORT + C.MONTHS_LONG)})"
    either = "nullif(coalesce(nullif(get(p, {}), ''), get(p, {})), '')"
    month_at = f"array_position({months}, lower({either.format(1, 2)}))"
    numbers = f"""named_struct(
      'y', try_cast(get(p, 4) AS int),
      'month', {let_sql("at", month_at, "CASE WHEN at > 0 THEN cast((at - 1) % 12 + 1 AS int) END")},
      'day', try_cast({either.format(0, 3)} AS int),
      'hour', try_cast(get(p, 5) AS int),
      'minute', try_cast(get(p, 6) AS int),
      'second', coalesce(try_cast(get(p, 7) AS int), 0),
      'utc_offset', {let_sql("z", f"upper({either.format(8, 9)})", _zone_offset_sql())})"""
    with_year = "named_struct('n', n, 'year', CASE WHEN n.y >= 100 THEN n.y WHEN n.y > 68 THEN n.y + 1900 ELSE n.y + 2000 END)"
    dated = """named_struct(
      'year', d.year, 'month', d.n.month, 'day', d.n.day,
      'wall', CASE WHEN d.n.second < 60 AND abs(coalesce(d.n.utc_offset, 0)) < 86400
        THEN try_make_timestamp_ntz(d.year, d.n.month, d.n.day, d.n.hour, d.n.minute, cast(d.n.second AS decimal(8,6))) END,
      'utc_offset', d.n.utc_offset)"""
    return F.expr(let_sql("d", let_sql("n", let_sql("p", pieces, numbers), with_year), dated))


def mail_wall(header: str) -> Column:
    return mail_date(header)["wall"]


def epoch_of(mail: Column) -> Column:
    """Instant of a ``mail_date`` struct in unix seconds (H6); naive dates count as UTC."""
    wall = F.unix_timestamp(mail["wall"].cast("timestamp"))
    return wall - F.coalesce(mail["utc_offset"], F.lit(0))


def mail_epoch(header: str) -> Column:
    return let(mail_date(header), epoch_of)


def offset_text(offset: Column) -> Column:
    size = F.abs(offset)
    sign = F.when(offset < 0, "-").otherwise("+")
    hhmm = F.format_string("%02d:%02d", F.floor(size / 3600), F.floor(size % 3600 / 60))
    return F.when(offset.isNotNull(), F.concat(sign, hhmm))


def sort_key_of(mail: Column) -> Column:
    """ISO text with the header's own offset, '' when unreadable; compared as text (H7)."""
    iso = F.date_format(mail["wall"], "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(F.concat(iso, F.coalesce(offset_text(mail["utc_offset"]), F.lit(""))), F.lit(""))


def date_sort_key(header: str) -> Column:
    return let(mail_date(header), sort_key_of)


def short_date_of(wall: Column, raw: Column | str, as_of: Column | str | dt.date) -> Column:
    """'Mon Apr 20' in the current year, ISO date in others, raw text if unreadable (H8)."""
    same_year = F.year(wall) == F.year(as_of_date(as_of))
    return F.when(wall.isNull(), left(or_empty(raw), 10)).otherwise(
        F.when(same_year, F.date_format(wall, "EEE MMM dd")).otherwise(
            F.date_format(wall, "yyyy-MM-dd")
        )
    )


def short_date(header: str, as_of: Column | str | dt.date) -> Column:
    return let(mail_wall(header), lambda wall: short_date_of(wall, header, as_of))


def simple_date(header: str) -> Column:
    """y-mm-dd as written, even for an impossible day; raw text if unreadable."""

    def shown(m: Column) -> Column:
        ymd = F.concat(m["year"].cast("string"), F.format_string("-%02d-%02d", m["month"], m["day"]))
        readable = m["year"].isNotNull() & m["month"].isNotNull() & m["day"].isNotNull()
        return F.when(readable, ymd).otherwise(left(or_empty(header), 10))

    return let(mail_date(header), shown)


def message_wall(
    header: str, feed_millis: Column | str, as_of: Column | str | dt.date
) -> Column:
    """Wall clock of a message: header, else the feed's own instant, else ``as_of``."""
    millis = filled(col(feed_millis).cast("string")).try_cast("long")
    feed = F.timestamp_millis(millis).cast("timestamp_ntz")
    fallback = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.coalesce(mail_wall(header), feed, fallback.cast("timestamp_ntz"))


def cutoff(as_of: Column | str | dt.date, days: int) -> Column:
    """The day ``days`` before ``as_of``."""
    return F.date_sub(as_of_date(as_of), days)


def days_between_mondays(wall: Column, as_of: Column | str | dt.date) -> Column:
    monday = F.date_trunc("week", as_of_date(as_of)).cast("date")
    return F.datediff(monday, F.date_trunc("week", wall).cast("date"))


def week_index(wall: Column | str, as_of: Column | str | dt.date) -> Column:
    """Weeks back from the week of ``as_of``, Monday based; -1 upcoming, 9999 undated."""
    weeks = F.floor(days_between_mondays(col(wall), as_of) / 7).cast("int")
    return F.when(col(wall).isNull(), C.UNDATED_WEEK).otherwise(F.greatest(weeks, F.lit(-1)))


def week_label(index: Column | str) -> Column:
    i = col(index)
    return (
        F.when(i == C.UNDATED_WEEK, "sometime")
        .when(i < 0, "upcoming")
        .when(i == 0, "this week")
        .when(i == 1, "last week")
        .when(i < 8, F.concat(i.cast("string"), F.lit(" weeks ago")))
        .otherwise(F.concat(F.floor(i / 4).cast("string"), F.lit(" months ago")))
    )


def relative_due(due: Column | str, as_of: Column | str | dt.date) -> Column:
    """'due today', 'due in 3 days', ...; the raw text when it is no date; '' for none."""
    text = or_empty(due)
    shaped = text.rlike(r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$")
    day = F.when(shaped, text).otherwise(F.lit(None)).try_cast("date")
    n = F.datediff(day, as_of_date(as_of))
    return (
        F.when(text == "", "")
        .when(n.isNull(), F.concat(F.lit("due "), text))
        .when(n == 0, "due today")
        .when(n == 1, "due tomorrow")
        .when(n == -1, "due yesterday")
        .when(n < 0, F.concat(F.lit("due "), (-n).cast("string"), F.lit(" days ago")))
        .otherwise(F.concat(F.lit("due in "), n.cast("string"), F.lit(" days")))
    )
