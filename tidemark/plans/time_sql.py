"""The reading of time strings as SQL for DuckDB: the same written forms, by another engine's expressions, dates and zones."""

from __future__ import annotations

from tidemark.operators import timestamps as ts

_WIDE, _NARROW = "".join(chr(0xFF01 + i) for i in range(94)) + "−‐‑", "".join(chr(0x21 + i) for i in range(94)) + "---"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean(value: str) -> str:
    seen = f"regexp_replace(translate({value}, {_quoted(_WIDE)}, {_quoted(_NARROW)}), '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')"
    return f"trim(regexp_replace({seen}, '[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'), ' ')".replace("{{", "{").replace("}}", "}")


def _parts(t: str) -> str:
    """A list of form, year, month, day, hour, minute, second, half of the day and zone."""
    out = f"CASE WHEN regexp_matches({t}, {_quoted(ts._BARE)}) THEN ['bare'] WHEN regexp_matches({t}, {_quoted(ts._AGO)}) THEN ['ago']"
    for name, (pattern, groups) in ts.FORMS.items():
        put = "|".join([name, *(f"\\{g}" if g else "" for g in groups)])
        out += f" WHEN regexp_matches({t}, {_quoted(pattern)}) THEN string_split(regexp_replace({t}, {_quoted(pattern)}, {_quoted(put)}), '|')"
    return out + " END"


def _at(wall: str, zone: str) -> str:
    """Unix seconds of a wall time; of a repeated one the earlier instant."""
    u = f"timezone({zone}, {wall})"
    return f"CAST(epoch(CASE WHEN timezone({zone}, {u} - INTERVAL 1 HOUR) = {wall} THEN {u} - INTERVAL 1 HOUR ELSE {u} END) AS BIGINT)"


def reading(name: str, source: str, columns: str, value: str) -> str:
    """CTEs that end in `name`: the columns of source with utc_seconds and is_standard of the time string `value`.

    source has client_tz and crawled_at; zones that aren't declared mean the default.
    """
    known = ", ".join(map(_quoted, ts.known_zones()))
    months = " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(ts._MONTHS))
    abbr = "MAP {" + ", ".join(f"{_quoted(k)}: {v}" for k, v in ts.abbreviations().items()) + "}"
    part = lambda k: f"nullif(list_extract(p, {k + 1}), '')"
    n = f"try_cast(regexp_extract(t, {_quoted(ts._AGO)}, 1) AS BIGINT)"
    unit = f"lower(regexp_extract(t, {_quoted(ts._AGO)}, 2))"
    hour = f"try_cast({part(4)} AS INT)"
    half = f"lower({part(7)})"
    z = part(8)
    return f"""{name}_1 AS (SELECT {columns}, {value} AS v, client_tz AS z0, CASE WHEN client_tz IN ({known}) THEN client_tz ELSE '{ts.DEFAULT_ZONE}' END AS tz, CAST(floor(epoch(crawled_at)) AS BIGINT) AS c, {_clean(value)} AS t FROM {source}),
 {name}_2 AS (SELECT *, {_parts('t')} AS p, timezone(tz, to_timestamp(c)) AS here FROM {name}_1),
 {name}_3 AS (SELECT *, p[1] AS form, {z} AS zone, {half} AS half, CASE WHEN {half} IN ('下午', '午後', 'pm') THEN CASE WHEN {hour} < 12 THEN {hour} + 12 ELSE {hour} END WHEN {half} IN ('上午', '午前', 'am') AND {hour} = 12 THEN 0 ELSE {hour} END AS h,
   coalesce(try_cast({part(1)} AS INT), CASE WHEN p[1] = 'no_year' THEN year(here) END) AS y, CASE lower({part(2)}) {months} ELSE try_cast({part(2)} AS INT) END AS mo, try_cast({part(3)} AS INT) AS d, try_cast({part(5)} AS INT) AS mi, coalesce(try_cast({part(6)} AS INT), 0) AS s FROM {name}_2),
 {name}_4 AS (SELECT *, CASE WHEN form NOT IN ('bare', 'ago') AND h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59 THEN CAST(CASE WHEN form = 'day_word' THEN CAST(here AS DATE) - CASE WHEN regexp_matches(t, '(?i)^(今天|today)') THEN 0 WHEN regexp_matches(t, '(?i)^(昨天|yesterday)') THEN 1 ELSE 2 END ELSE try_cast(printf('%04d-%02d-%02d', y, mo, d) AS DATE) END AS TIMESTAMP) + to_seconds(h * 3600 + mi * 60 + s) END AS wall FROM {name}_3),
 {name} AS (SELECT * EXCLUDE (v, z0, tz, c, t, p, here, form, zone, half, h, y, mo, d, mi, s, wall),
   CASE WHEN form = 'bare' THEN CAST(try_cast(t AS HUGEINT) // CASE length(t) WHEN 13 THEN 1000 WHEN 16 THEN 1000000 WHEN 19 THEN 1000000000 ELSE 1 END AS BIGINT)
    WHEN form = 'ago' THEN c - {n} * CASE WHEN regexp_matches({unit}, '^(秒|s)') THEN 1 WHEN regexp_matches({unit}, '^(分|m)') THEN 60 WHEN regexp_matches({unit}, '^(小时|h)') THEN 3600 ELSE 86400 END
    WHEN upper(zone) IN ('Z', 'UTC', 'GMT') THEN CAST(epoch(wall) AS BIGINT)
    WHEN regexp_matches(zone, '^[+-]\\d') THEN CAST(epoch(wall) AS BIGINT) - CASE WHEN zone LIKE '-%' THEN -1 ELSE 1 END * (CAST(substr(zone, 2, 2) AS INT) * 3600 + coalesce(try_cast(regexp_extract(zone, '^[+-]\\d{{2}}:?(\\d{{2}})$', 1) AS INT), 0) * 60)
    WHEN contains(zone, '/') THEN CASE WHEN translate(zone, '[]', '') IN ({known}) THEN {_at('wall', "translate(zone, '[]', '')")} END
    WHEN zone IS NOT NULL THEN CAST(epoch(wall) AS BIGINT) - coalesce({abbr}[upper(zone)], {abbr}[tz || '|' || upper(zone)])
    ELSE {_at('wall', 'tz')} END AS utc_seconds,
   coalesce(regexp_matches(v, '\\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\\z') AND coalesce(z0 = '{ts.DEFAULT_ZONE}', true), false) AS is_standard FROM {name}_4)"""


def wall(utc_seconds: str) -> str:
    """The wall time of an instant in the default zone, whose offset doesn't change after 1991, as TIMESTAMP."""
    return f"(TIMESTAMP '1970-01-01' + to_seconds({utc_seconds} + 28800))"
