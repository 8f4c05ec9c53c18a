"""Problem 4: time strings of many writers and zones to one UTC instant.

Everything runs in the JVM: a chain of regular expressions picks the parts of a value, arithmetic on the
civil calendar gives its wall time in seconds, and `to_utc_timestamp` applies the offset history of a zone.
Nothing depends on the session's time zone.

Zones. A value with an offset, a zone name or an abbreviation carries its own. Other values are wall time of their
writer group (the writer columns and the declared zone). Where a group declares a usable zone, that zone holds. Where it
declares none, `estimate_zones` aligns all its local values with the ingestion times: for each candidate offset history it
counts the values that would lie after their ingestion (violations); the history with the fewest wins, among equals the
one whose freshest value lies closest to its ingestion. A group of fewer than LEAST_VALUES values has the default.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

DEFAULT_ZONE = "Asia/Shanghai"

#: Offset histories tried for groups without a declared zone.
CANDIDATE_ZONES = ("Asia/Shanghai", "Asia/Tokyo", "Europe/Berlin", "Europe/London", "America/New_York", "Australia/Sydney", "UTC")

#: Local values that a group needs to be estimated, and seconds by which clocks of writers may be ahead of ingestion.
LEAST_VALUES, SKEW = 200, 60

#: Estimated groups that are broadcast to the values, at most; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# The written forms, as Java regular expressions over the cleaned text.
_YMD = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
_HMS = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_WKD = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_ZONE = r"(?:\s*(z|utc|gmt|[+-]\d{2}:?\d{2}|[+-]\d{2}|\[[a-z_]+/[a-z_/+-]+\]|[a-z_]+/[a-z_/+-]+|[a-z]{2,5}))?"

#: name -> (pattern, groups of year, month, day, hour, minute, second, half of the day, zone); 0: not in the form.
FORMS: dict[str, tuple[str, tuple[int, ...]]] = {
    "ymd": (rf"^{_YMD}(?:t|\s+){_HMS}{_ZONE}$", (1, 2, 3, 4, 5, 6, 0, 7)),
    "garbled": (rf"^\d{{4}}-(\d{{4}})年(\d{{1,2}})-(\d{{1,2}})\s+{_HMS}$", (1, 2, 3, 4, 5, 6, 0, 0)),
    "basic": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE}$", (1, 2, 3, 4, 5, 6, 0, 7)),
    "cjk": (r"^(\d{4})年(\d{1,2})月(\d{1,2})日\s*(上午|下午|午前|午後)?\s*(\d{1,2})[:时時点](\d{1,2})分?:?(?:(\d{1,2})秒?)?$", (1, 2, 3, 5, 6, 7, 4, 0)),
    "dmy": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_HMS}(?:\s*uhr)?$", (3, 2, 1, 4, 5, 6, 0, 0)),
    "mail": (rf"^{_WKD}(\d{{1,2}})\s+{_MON}\s+(\d{{4}}),?\s+{_HMS}{_ZONE}$", (3, 2, 1, 4, 5, 6, 0, 7)),
    "unix": (rf"^{_WKD}{_MON}\s+(\d{{1,2}})\s+{_HMS}{_ZONE}\s+(\d{{4}})$", (7, 1, 2, 3, 4, 5, 0, 6)),
    "us": (rf"^{_MON}\s+(\d{{1,2}}),\s+(\d{{4}}),?\s+{_HMS}\s*(am|pm)$", (3, 1, 2, 4, 5, 6, 7, 0)),
    "no_year": (rf"^(\d{{1,2}})月(\d{{1,2}})日\s*{_HMS}$", (0, 1, 2, 3, 4, 5, 0, 0)),
    "day_word": (rf"^(今天|昨天|前天|today|yesterday)\s*{_HMS}$", (0, 0, 0, 2, 3, 4, 0, 0)),
}
FORMS = {k: ("(?i)" + p, g) for k, (p, g) in FORMS.items()}
_AGO = r"(?i)^(\d+)\s*(秒|秒钟|分钟|分|小时|天|seconds?|minutes?|mins?|hours?|days?)\s*(?:前|ago)$"
_BARE = r"^\d{10}$|^\d{13}$|^\d{16}$|^\d{19}$"
_STANDARD = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"


def cleaned(c: Column) -> Column:
    """ASCII digits and signs, one kind of space, no invisible characters or outer blanks."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    narrow = "".join(chr(0x21 + i) for i in range(94))
    given = c
    c = F.translate(c, wide + "−‐‑", narrow + "---")
    c = F.regexp_replace(c, r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]", "")
    c = F.trim(F.regexp_replace(c, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))
    # most values are ASCII with single spaces inside, and clean as they are
    return F.when(given.rlike(r"\A[\x21-\x7E]+(?: [\x21-\x7E]+)*\z"), given).otherwise(c)


def abbreviations(first: int = 2015, last: int = 2035) -> dict[str, int]:
    """Offsets in seconds by abbreviation, and by 'zone|abbreviation' where zones disagree; from the zones' own rules."""
    by: dict[str, dict[str, int]] = {}
    for name in known_zones():
        z = zoneinfo.ZoneInfo(name)
        for year in (first, (first + last) // 2, last):
            for month in (1, 4, 7, 10):
                t = dt.datetime(year, month, 15, tzinfo=z)
                if (ab := t.tzname()) and ab.isalpha():
                    by.setdefault(ab.upper(), {})[name] = int(t.utcoffset().total_seconds())
    out: dict[str, int] = {}
    for ab, zones in by.items():
        if len(set(zones.values())) == 1:
            out[ab] = next(iter(zones.values()))
        else:
            out |= {f"{z}|{ab}": o for z, o in zones.items()}
    return out


def known_zones() -> list[str]:
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z or z in ("UTC", "GMT"))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date of the Gregorian calendar."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


_SEP = "\x01"


def _let(value: Column, body) -> Column:
    """body(value) with the value evaluated once: a lambda over an array of one."""
    return F.transform(F.array(value), body)[0]


def _split(text: Column) -> Column:
    """array(form, year, month, day, hour, minute, second, half, zone) of the first form that matches, else null.

    One replacement by the form's groups picks all parts at once; parts that the form lacks are ''.
    """
    cut = [F.substring(text, a, n) for a, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))]
    plain = F.array(F.lit("ymd"), *cut, F.lit(""), F.lit(""))  # the most frequent form, without groups
    out = F.when(text.rlike(_STANDARD), plain).when(text.rlike(_BARE), F.array(F.lit("bare"))).when(text.rlike(_AGO), F.array(F.lit("ago")))
    for name, (pattern, groups) in FORMS.items():
        parts = _SEP.join([name, *(f"${g}" if g else "" for g in groups)])
        out = out.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, parts), _SEP))
    return out


def _read(text: Column, p: Column, tz: Column, crawled: Column) -> Column:
    """struct(form, wall, offset, region, abbr, zoned, utc) of a split value."""
    part = lambda k: F.when(F.get(p, F.lit(k)) != "", F.get(p, F.lit(k)))
    form = p[0]
    local = F.unix_seconds(F.from_utc_timestamp(crawled, tz))  # wall time at the writer when it was read
    today = F.floor(local / 86400).cast("int")
    month_name = F.lower(part(2))
    half = F.lower(part(7))
    hour = part(4).cast("int")
    hour = F.when(half.isin("下午", "午後", "pm"), F.when(hour < 12, hour + 12).otherwise(hour)).when(half.isin("上午", "午前", "am") & (hour == 12), F.lit(0)).otherwise(hour)
    back = F.when(text.rlike("(?i)^(今天|today)"), 0).when(text.rlike("(?i)^(昨天|yesterday)"), 1).otherwise(2)
    fields = F.struct(
        F.coalesce(part(1).cast("int"), F.when(form == "no_year", F.year(F.date_from_unix_date(today)))).alias("y"),
        F.coalesce(*(F.when(month_name == m, F.lit(i + 1)) for i, m in enumerate(_MONTHS)), month_name.try_cast("int")).alias("mo"),
        part(3).cast("int").alias("d"),
        hour.alias("h"),
        part(5).cast("int").alias("mi"),
        F.coalesce(part(6).cast("int"), F.lit(0)).alias("s"),
        (today - back).alias("named"),
    )
    z = part(8)

    def wall(f: Column) -> Column:
        dated = f["mo"].between(1, 12) & (f["d"] >= 1) & (f["d"] <= _month_days(f["y"], f["mo"])) & (f["y"] >= 1)
        day = F.when(form == "day_word", f["named"]).when(dated, _days(f["y"], f["mo"], f["d"]))
        clock = f["h"].between(0, 23) & f["mi"].between(0, 59) & f["s"].between(0, 59)
        return F.when(clock, day * 86400 + f["h"] * 3600 + f["mi"] * 60 + f["s"]).cast("bigint")

    digits = F.length(text)
    scale = F.when(digits == 13, 1000).when(digits == 16, 1000000).when(digits == 19, 1000000000).otherwise(1)
    n = F.regexp_extract(text, _AGO, 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(text, _AGO, 2))
    step = F.when(unit.rlike("^(秒|s)"), 1).when(unit.rlike("^(分|m)"), 60).when(unit.rlike("^(小时|h)"), 3600).otherwise(86400)
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    minutes = F.coalesce(F.regexp_extract(z, r"^[+-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    return F.struct(
        form.alias("_form"),
        F.when(~form.isin("bare", "ago"), _let(fields, wall)).alias("_wall"),
        F.when(F.upper(z).isin("Z", "UTC", "GMT"), 0).when(z.rlike(r"^[+-]\d"), sign * (F.substring(z, 2, 2).cast("int") * 3600 + minutes * 60)).cast("bigint").alias("_offset"),
        F.when(z.contains("/"), F.translate(z, "[]", "")).alias("_region"),
        F.when(z.rlike("(?i)^[a-z]{2,5}$") & ~F.upper(z).isin("UTC", "GMT"), F.upper(z)).alias("_abbr"),
        z.isNotNull().alias("_zoned"),
        F.when(form == "bare", F.floor(text.try_cast("decimal(20,0)") / scale).cast("bigint")).when(form == "ago", F.unix_seconds(crawled) - n * step).alias("_utc"),
    )


def parse(df: DataFrame, value: str, zone: str, crawled: str) -> DataFrame:
    """df with what its values say: `_form`, `_wall` (seconds of the wall time), `_offset`, `_region`, `_abbr`, `_zoned`, `_utc`.

    Null, blank, unknown and impossible values get null. The generator keeps Catalyst from copying the parser into
    every later use of its columns.
    """
    tz = F.when(F.col(zone).isin(known_zones()), F.col(zone)).otherwise(F.lit(DEFAULT_ZONE))
    read = _let(F.struct(cleaned(F.col(value)).alias("t"), tz.alias("z"), F.col(crawled).alias("c")), lambda a: _let(_split(a["t"]), lambda p: _read(a["t"], p, a["z"], a["c"])))
    return df.select("*", F.inline(F.array(read)))


def _at(wall: Column, tz: Column | str) -> Column:
    """Unix seconds of a wall time. A repeated one means the earlier instant, a skipped one the offset before the change."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall), tz))


def estimate_zones(parsed: DataFrame, group: list[str], crawled: str, candidates: tuple[str, ...] = CANDIDATE_ZONES, default: str = DEFAULT_ZONE) -> DataFrame:
    """(group, n, violations, _estimated): the offset history that aligns a group's local values with their ingestion.

    Reads every value of the group that carries no zone of its own, in one aggregation with map-side combine; the
    result has as many rows as there are writer groups. Fewest violations win, then the smallest delay of the freshest
    value, then the default. Groups of fewer than LEAST_VALUES local values have the default.
    """
    local = parsed.where(F.col("_wall").isNotNull() & ~F.col("_zoned") & F.col(crawled).isNotNull() & ~F.col("_form").isin("day_word", "no_year"))
    lag = {z: F.unix_seconds(F.col(crawled)) - _at(F.col("_wall"), z) for z in candidates}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, z in enumerate(candidates):
        aggs += [F.count_if(lag[z] < -SKEW).alias(f"v{i}"), F.min(F.when(lag[z] >= -SKEW, lag[z])).alias(f"m{i}")]
    stats = local.groupBy(*group).agg(*aggs)
    rank = lambda i, z: F.struct(F.col(f"v{i}").alias("v"), F.coalesce(F.col(f"m{i}"), F.lit(1 << 62)).alias("m"), F.lit(int(z != default)).alias("o"), F.lit(z).alias("z"))
    best = F.array_min(F.array(*(rank(i, z) for i, z in enumerate(candidates))))
    return stats.select(*group, "n", best["v"].alias("violations"), F.when(F.col("n") >= LEAST_VALUES, best["z"]).otherwise(F.lit(default)).alias("_estimated"))


def _group_columns(writer: Sequence[str], zone: str) -> list[Column]:
    """The writer columns and the spelling of a zone, as the columns _g0, _g1 ... that identify a writer group."""
    return [F.coalesce(F.col(f"_row.`{w}`").cast("string"), F.lit("")).alias(f"_g{i}") for i, w in enumerate(writer)] + [F.coalesce(F.col(zone), F.lit("")).alias(f"_g{len(writer)}")]


def normalize(spark: SparkSession, df: DataFrame, value: str, zone: str = "client_tz", crawled: str = "crawled_at", writer: Sequence[str] = (), estimate: bool = True) -> DataFrame:
    """df with `utc_seconds` BIGINT (null where the value denotes no instant) and `is_standard` BOOLEAN.

    Standard form is `YYYY-MM-DD HH:MM:SS` in ASCII under the default zone. Values without zone of groups that declare
    none are read in the estimated history of their group (the columns `writer` and the spelling of the zone), without
    `estimate` in the default. With it, values are parsed once and written to the shared folder between the two passes.
    Null values, null or unknown zones, blank and very long texts, repeated rows and an empty table are all handled: a row
    in gives a row out, with null where nothing can be read. Clashing names: existing columns utc_seconds and is_standard
    are replaced.
    """
    df = df.drop("utc_seconds", "is_standard")
    zones = known_zones()
    # the given columns travel as one, so that none of their names can clash with those of the parser
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    df = df.select(row, F.col(value).alias("_value"), F.col(zone).alias("_zone"), F.col(crawled).alias("_crawled"))
    value, zone, crawled = "_value", "_zone", "_crawled"
    declared = F.coalesce(F.col(zone).isin(zones), F.lit(False))
    standard = F.coalesce(F.col(value).rlike(_STANDARD) & F.coalesce(F.col(zone) == DEFAULT_ZONE, F.lit(True)), F.lit(False))
    parsed = parse(df, value, zone, crawled).withColumns({"_declared": declared, "_standard": standard})
    if estimate:
        group = _group_columns(writer, zone)
        names = [f"_g{i}" for i in range(len(group))]
        parsed = materialize(parsed.drop(value), "times")
        undeclared = parsed.where("not _declared").select("*", *group)
        guessed = materialize(estimate_zones(undeclared, names, crawled).where(F.col("_estimated") != DEFAULT_ZONE).select(*names, "_estimated"), "zones")
        if n := guessed.count():  # groups of another history than the default: none in most tables
            guessed = guessed.withColumn("_undeclared", F.lit(True))
            out = parsed.select("*", *group, (~F.col("_declared")).alias("_undeclared"))
            parsed = out.join(F.broadcast(guessed) if n <= BROADCAST_GROUPS else guessed, [*names, "_undeclared"], "left")
        else:
            parsed = parsed.withColumn("_estimated", F.lit(None).cast("string"))
        tz = F.when(F.col("_declared"), F.col(zone)).otherwise(F.coalesce(F.col("_estimated"), F.lit(DEFAULT_ZONE)))
    else:
        tz = F.when(F.col("_declared"), F.col(zone)).otherwise(F.lit(DEFAULT_ZONE))
    abbr = F.create_map(*(F.lit(x) for k, v in abbreviations().items() for x in (k, v)))
    region = F.when(F.col("_region").isin(zones), F.col("_region"))
    by_abbr = F.when(F.col("_abbr").isNotNull(), F.coalesce(F.try_element_at(abbr, F.col("_abbr")), F.try_element_at(abbr, F.concat_ws("|", tz, F.col("_abbr")))))
    utc = (
        F.when(F.col("_utc").isNotNull(), F.col("_utc"))
        .when(F.col("_offset").isNotNull(), F.col("_wall") - F.col("_offset"))
        .when(F.col("_region").isNotNull(), F.when(region.isNotNull(), _at(F.col("_wall"), region)))
        .when(F.col("_abbr").isNotNull(), F.col("_wall") - by_abbr)
        .otherwise(_at(F.col("_wall"), tz))
    )
    done = F.struct(utc.cast("bigint").alias("utc_seconds"), F.col("_standard").alias("is_standard"))
    return parsed.select("_row.*", F.inline(F.array(done)))


def zone_estimates(df: DataFrame, value: str, zone: str, crawled: str, writer: Sequence[str] = ()) -> DataFrame:
    """(writer columns, declared, n_local, violations, estimated): the zone that the values of each group speak for, read
    blindly, whether the group declares one or not; a row for each group that has local values."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    df = df.select(row, F.col(value).alias("_value"), F.col(zone).alias("_zone"), F.col(crawled).alias("_crawled"))
    group = _group_columns(writer, "_zone")
    names = [f"_g{i}" for i in range(len(group))]
    out = estimate_zones(parse(df, "_value", "_zone", "_crawled").select("*", *group), names, "_crawled")
    return out.select(*(F.col(g).alias(w) for g, w in zip(names, writer)), F.nullif(F.col(names[-1]), F.lit("")).alias("declared"), F.col("n").alias("n_local"), "violations", F.col("_estimated").alias("estimated"))
