"""Labels of windows by several writers, in one code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes that writers use for the same label.
SAME_LABEL = {"AP": "PA", "CP": "CA"}
_WIDE, _NARROW = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))
#: White space of any kind, and invisible characters.
_BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def plain_label(c: Column) -> Column:
    """A label without case, width and outer blanks, one code for each meaning; null stays null."""
    x = F.upper(F.regexp_replace(F.translate(c, _WIDE, _NARROW), f"^{_BLANK}+|{_BLANK}+$", ""))
    for a, b in SAME_LABEL.items():
        x = F.when(x == a, F.lit(b)).otherwise(x)
    return x


def plain_label_sql(c: str) -> str:
    """The same for DuckDB."""
    x = f"upper(regexp_replace(translate({c}, '{_WIDE}', '{_NARROW.replace(chr(39), chr(39) * 2)}'), '^{_BLANK}+|{_BLANK}+$', '', 'g'))"
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SAME_LABEL.items()) + f" ELSE {x} END"
