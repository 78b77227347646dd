"""Mixed timestamp texts to one UTC instant.

An ordered cascade of anchored patterns rewrites a text to its fields
(``year|month|day|hour|minute|second|fraction|am_pm|zone``); the fields are then
checked strictly and placed on the time line. Everything is a Catalyst
expression: no Python worker, no shuffle.

Defined results
---------------
* null text: ``ts_us`` null, status ``null``;
* text that is no valid time: -1, ``invalid``;
* wall time that happens twice in its zone: -1, ``ambiguous``; never: -1, ``nonexistent``;
* otherwise microseconds since 1970 UTC (finer fractions are cut off), ``ok``.

White space around the text counts for nothing, letter case neither. Text with an
offset keeps it; a bracketed zone name holds for the text; an abbreviation is
that of the source's zone; other wall-clock text is in the source's zone; a
source that is missing from the lookup, or has several zones there, has none, and its wall-clock
text is ``invalid``. The abbreviations of a zone are those its rules have named since 1970; one that stood for several
offsets (MSK) has the one in force at the wall time, or is ``invalid``; so is one that its zone never had, but for UTC and GMT. Numbers
of fewer than nine or more than 19 digits are no time. An empty frame gives an empty frame. All other columns
pass through; existing columns of the output names are replaced.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.util import DAY, MINUTE, SECOND, bounded_broadcast

PLAIN = r"^\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\dZ$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_MON = "(" + "|".join(MONTHS) + ")"
_DOW = "(" + "|".join(WEEKDAYS) + ")"
_HMS = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_OFF = r"(z|[+-]\d{2}(?::?\d{2})?)"

#: These mean the same in any zone.
UNIVERSAL = {"utc": 0, "gmt": 0}

#: name, pattern over the trimmed lower-case text, rewrite. ``x1|x2`` of ``numeric`` are put in order by the source.
CASCADE: list[tuple[str, str, str]] = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]{_HMS} ?{_OFF}?(?:\[[a-z0-9_+/-]+\])?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_OFF}?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("fourteen", r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1|$2|$3|$4|$5|$6|||"),
    ("slashed", rf"^(\d{{4}})([/.])(\d{{2}})\2(\d{{2}}) {_HMS}$", "$1|$3|$4|$5|$6|$7|$8||"),
    ("abbreviated", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]{_HMS} ([a-z]{{2,5}})$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("numeric", r"^(\d{1,2})([/.])(\d{1,2})\2(\d{4}) (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([ap]m))?$", "$4|$1|$3|$5|$6|$7||$8|"),
    ("mail", rf"^(?:{_DOW}, ?)?(\d{{1,2}}) {_MON} (\d{{4}}) {_HMS} ?([+-]\d{{4}}|[a-z]{{1,5}})?$", "$4|$3|$2|$5|$6|$7|$8||$9|$1"),
    ("month_first", rf"^{_MON} (\d{{1,2}}), (\d{{4}}) (\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?: ?([ap]m))?$", "$3|$1|$2|$4|$5|$6||$7|"),
    ("date", r"^(\d{4})-(\d{2})-(\d{2})$", "$1|$2|$3|00|00|00|||z"),
]
#: An epoch number has at least so many digits; shorter ones are no time.
NUMBER = r"^\d{9,20}(?:\.\d{1,9})?$"


def _lookup(names: tuple[str, ...], first: int) -> Column:
    return F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i + first)])


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a real date, else null."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= length), F.unix_date(F.make_date(y, m, d)).cast("long"))


def _local(u: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(u), zone))


@lru_cache(maxsize=1024)
def abbreviations(zone: str) -> dict[str, tuple[int, ...]]:
    """The abbreviations on a zone's clocks since 1970, in small letters, with their offsets in minutes."""
    try:
        tz = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        return {}
    out: dict[str, set[int]] = {}
    for year in range(1970, dt.datetime.now().year + 2):
        for month in range(1, 13):
            t = dt.datetime(year, month, 15, 12, tzinfo=dt.timezone.utc).astimezone(tz)
            name, offset = t.tzname() or "", t.utcoffset()
            if name.isalpha() and not offset.total_seconds() % 60:
                out.setdefault(name.lower(), set()).add(int(offset.total_seconds()) // 60)
    return {name: tuple(sorted(o)) for name, o in out.items()}


def _known_zones(df: DataFrame) -> str:
    """The names of all zones as an SQL list."""
    return ", ".join(f"'{z}'" for z in sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds()))


def normalize_timestamps(df: DataFrame, feeds: DataFrame, text: str = "timestamp", source: str = "exchange", zone: str = "zone", day_order: str = "day_order", out: str = "ts_us", status: str = "ts_status", max_feeds: int = 10_000) -> DataFrame:
    """Add ``out`` (microseconds or -1) and ``status`` for the text column ``text``; see the module."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c))
    lookup = feeds.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("__src")).agg(one(zone).alias("__zone"), one(day_order).alias("__order"))
    zones = _known_zones(df)
    lookup = lookup.withColumn("__zone", F.expr(f"CASE WHEN __zone IN ({zones}) THEN __zone END"))
    # no more than there are zones
    used = [r[0] for r in lookup.select("__zone").where(F.col("__zone").isNotNull()).distinct().collect()]
    base = df.drop(out, status)
    names = base.columns
    base = base.join(bounded_broadcast(lookup, max_feeds), base[source] == F.col("__src"), "left").drop("__src")

    raw = F.col(text)
    t = F.lower(F.trim(F.regexp_replace(raw, r"^[\s\x{A0}\x{200B}\x{FEFF}\x{3000}]+|[\s\x{A0}\x{200B}\x{FEFF}\x{3000}]+$", "")))
    s = base.withColumn("__plain", F.coalesce(raw.rlike(PLAIN), F.lit(False)))
    s = s.withColumn("__t", F.when(raw.isNotNull() & ~F.col("__plain"), t))
    t = F.col("__t")
    fields = reduce(
        lambda acc, p: acc.when(t.rlike(p[1]), F.concat(F.lit(p[0] + "|"), F.regexp_replace(t, p[1], p[2]))),
        CASCADE,
        F.when(t.isNull(), F.lit(None).cast("string")),
    )
    s = s.withColumn("__f", F.split(fields, r"\|"))
    part = lambda i: F.get(F.col("__f"), F.lit(i))
    kind = part(0)
    num = lambda i: F.when(part(i) != "", part(i)).cast("int")
    month_of = lambda c: F.coalesce(F.when(c.rlike(r"^\d"), c).cast("int"), F.when(~c.rlike(r"^\d"), _lookup(MONTHS, 1)[c]))
    a, b = num(2), num(3)
    order = F.col("__order")
    # a source that writes the year first gives no order of day and month: only a text with one reading is read
    day_first = (kind == "numeric") & F.when(order == "dmy", True).when(order == "mdy", False).otherwise((a > 12) & (b <= 12))
    unordered = (kind == "numeric") & ~F.coalesce(order.isin("dmy", "mdy"), F.lit(False)) & (a <= 12) & (b <= 12) & (a != b)
    day_first = F.coalesce(day_first, F.lit(False))
    hour, ap = num(4), part(8)
    hour24 = F.when(F.coalesce(ap, F.lit("")) == "", hour).when(hour.between(1, 12), hour % 12 + F.when(ap == "pm", 12).otherwise(0))
    s = s.withColumns({
        "__y": num(1),
        "__m": F.when(day_first, b).when(kind == "numeric", a).otherwise(month_of(part(2))),
        "__d": F.when(day_first, a).otherwise(b),
        "__h": F.when(~unordered, hour24),
        "__mi": num(5),
        "__s": F.coalesce(num(6), F.lit(0)),
        "__us": F.coalesce(F.rpad(F.when(part(7) != "", part(7)), 6, "0").cast("long"), F.lit(0)),
        "__z": part(9),
        "__dow": F.when(F.coalesce(part(10), F.lit("")) != "", part(10)),
        "__named": F.when((kind == "iso") & t.contains("["), F.regexp_extract(F.trim(raw), r"\[(.+)\]$", 1)),
    })
    h, mi, sec, frac = (F.col(f"__{x}") for x in ("h", "mi", "s", "us"))
    clock = F.when(
        (mi <= 59) & (sec <= 59) & ((h <= 23) | ((h == 24) & (mi == 0) & (sec == 0) & (frac == 0))),
        h.cast("long") * (60 * MINUTE) + mi.cast("long") * MINUTE + sec.cast("long") * SECOND + frac,
    )
    days = _days(F.col("__y"), F.col("__m"), F.col("__d"))
    dow_ok = F.col("__dow").isNull() | (_lookup(WEEKDAYS, 0)[F.col("__dow")] == F.pmod(days + 3, F.lit(7)))
    z = F.col("__z")
    off_min = F.when(z == "z", 0).when(
        z.rlike(r"^[+-]"),
        F.when(F.substring(z, 2, 2).cast("int") <= 18, F.when(F.left(z, F.lit(1)) == "-", -1).otherwise(1) * (F.substring(z, 2, 2).cast("int") * 60 + F.coalesce(F.when(F.length(z) > 3, F.right(z, F.lit(2))).cast("int"), F.lit(0)))),
    )
    named = {f"{zn} {ab}": o for zn in used for ab, o in abbreviations(zn).items()}
    named |= {f" {ab}": (o,) for ab, o in UNIVERSAL.items()}
    by_name = F.create_map(*[c for n, o in named.items() for c in (F.lit(n), F.array(*map(F.lit, o)))])
    abbr = F.when(z.rlike(r"^[a-z]{2,}$"), F.coalesce(by_name[F.concat(F.col("__zone"), F.lit(" "), z)], by_name[F.concat(F.lit(" "), z)]))
    has_zone_text = F.coalesce(z != "", F.lit(False))
    s = s.withColumns({
        "__wall": F.when(dow_ok, days * DAY + clock),
        "__off": F.coalesce(off_min, F.when(F.size(abbr) == 1, abbr[0])).cast("long") * MINUTE,
        "__several": F.when(F.size(abbr) > 1, abbr),
        "__tz": F.when(F.size(abbr) > 1, F.col("__zone")).when(~has_zone_text, F.when(F.col("__named").isNull(), F.col("__zone")).otherwise(F.expr(f"CASE WHEN __named IN ({zones}) THEN __named END"))),
    })
    wall, tz = F.col("__wall"), F.col("__tz")
    # one offset holds a day before, one a day after: the wall time exists under each of them or not
    before = wall - (_local(wall - DAY, tz) - (wall - DAY))
    after = wall - (_local(wall + DAY, tz) - (wall + DAY))
    s = s.withColumns({"__u1": F.when(tz.isNotNull() & wall.isNotNull(), before), "__u2": F.when(tz.isNotNull() & wall.isNotNull(), after)})
    u1, u2 = F.col("__u1"), F.col("__u2")
    s = s.withColumns({"__ok1": F.when(u1.isNotNull(), _local(u1, tz) == wall), "__ok2": F.when(u2.isNotNull(), F.when(u1 == u2, False).otherwise(_local(u2, tz) == wall))})
    ok1, ok2 = F.col("__ok1"), F.col("__ok2")

    in_force = lambda u: F.coalesce(F.array_contains(F.col("__several"), ((wall - u) / MINUTE).cast("int")), F.lit(False))
    whole = F.regexp_extract(t, r"^\d+", 0)
    digits = F.length(whole)
    places = F.when(digits <= 10, 6).when(digits <= 13, 3).when(digits <= 16, 0).otherwise(-3)
    fraction = F.regexp_extract(t, r"\.(\d+)$", 1)
    # shift the decimal point in the text, so that no digit is lost in a double
    shifted = F.when(places >= 0, F.concat(whole, F.rpad(F.substring(fraction, 1, 6), 9, "0").substr(F.lit(1), places))).otherwise(F.expr("substr(regexp_extract(__t, '^[0-9]+', 0), 1, length(regexp_extract(__t, '^[0-9]+', 0)) - 3)"))
    number = F.when(t.rlike(NUMBER) & kind.isNull() & (digits <= 19), shifted.cast("long"))

    y, m, d = (F.substring(raw, i, n).cast("int") for i, n in ((1, 4), (6, 2), (9, 2)))
    hms = [F.substring(raw, i, 2).cast("long") for i in (12, 15, 18)]
    plain = _days(y, m, d) * DAY + hms[0] * (60 * MINUTE) + hms[1] * MINUTE + hms[2] * SECOND
    s = s.withColumn(
        "__u",
        F.when(F.col("__plain"), plain)
        .when(kind.isNull(), number)
        .when(F.col("__several").isNotNull(), F.when(ok1 & in_force(u1), u1).when(ok2 & in_force(u2), u2))
        .when(has_zone_text, wall - F.col("__off"))
        .when(ok1 & ~ok2, u1)
        .when(ok2 & ~ok1, u2),
    )
    u = F.col("__u")
    state = F.when(raw.isNull(), "null").when(u.isNotNull(), "ok").when(F.col("__several").isNotNull(), "invalid").when(ok1 & ok2, "ambiguous").when(~ok1 & ~ok2, "nonexistent").otherwise("invalid")
    instant = F.when(raw.isNotNull(), F.coalesce(u, F.lit(-1).cast("long")))
    # a generator: later filters on the instant would else be pushed down through the cascade, which copies it
    return s.select(*names, F.inline(F.array(F.struct(instant.alias(out), state.alias(status)))))


def is_plain(text: Column) -> Column:
    """Text that already is a valid ``YYYY-MM-DDTHH:MM:SSZ``; false for null."""
    y, m, d = (F.substring(text, i, n).cast("int") for i, n in ((1, 4), (6, 2), (9, 2)))
    return F.when(F.coalesce(text.rlike(PLAIN), F.lit(False)), _days(y, m, d).isNotNull()).otherwise(F.lit(False))
