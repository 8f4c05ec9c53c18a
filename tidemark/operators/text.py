"""Cleaning, classification and measurement of post and comment texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sentinel of filtered texts, the emphatic symbols, and the length classes.
SENTINEL = "FILTER_NEUTRAL_LEACHING"
SYMBOLS = r"[❗!！\?？🕯️]"
SHORT, LONG, SYMBOL_CAP, LEAST_BYTES = 10, 50, 5, 500
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def parse_date(s: Column) -> Column:
    """Wall time of the three forms of the collectors: ISO-like, garbled year, and RFC-like with offset (dropped); else null."""
    iso = F.when(s.rlike(r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"), s)
    garbled = F.when(s.rlike(r"\A\d{4}-\d{4}年\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"), F.replace(F.substring(s, 6, 100), F.lit("年"), F.lit("-")))
    rfc = r"\A[A-Z][a-z]{2} ([A-Z][a-z]{2}) (\d{2}) (\d{2}:\d{2}:\d{2}) [+-]\d{4} (\d{4})\z"
    month = F.lpad(F.array_position(F.array(*map(F.lit, _MONTHS)), F.regexp_extract(s, rfc, 1)).cast("string"), 2, "0")
    mail = F.when(s.rlike(rfc), F.concat_ws("-", F.regexp_extract(s, rfc, 4), month, F.concat_ws(" ", F.regexp_extract(s, rfc, 2), F.regexp_extract(s, rfc, 3))))
    return F.coalesce(iso, garbled, mail).try_cast("timestamp_ntz")


PARSE_SQL = r"""CASE WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}$') THEN try_cast({0} AS TIMESTAMP)
 WHEN regexp_matches({0}, '^\d{{4}}-\d{{4}}年\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}$') THEN try_cast(replace(substr({0}, 6), '年', '-') AS TIMESTAMP)
 WHEN regexp_matches({0}, '^[A-Z][a-z]{{2}} [A-Z][a-z]{{2}} \d{{2}} \d{{2}}:\d{{2}}:\d{{2}} [+-]\d{{4}} \d{{4}}$')
   THEN try_strptime(substr({0}, 5, 15) || ' ' || right({0}, 4), '%b %d %H:%M:%S %Y') END"""


def relative_time(s: Column, ref: Column) -> Column:
    """'N分钟前', 'N小时前', '今天 HH:MM', 'M月D日 HH:MM' against a reference wall time; else null."""
    n = F.regexp_extract(s, r"(\d+)", 1).try_cast("int")
    clock = F.regexp_extract(s, r"(\d{1,2}:\d{2})", 1)
    minutes = F.when(s.rlike(r"^\d+分钟前$"), F.timestamp_add("MINUTE", -n, ref))
    hours = F.when(s.rlike(r"^\d+小时前$"), F.timestamp_add("HOUR", -n, ref))
    today = F.when(s.rlike(r"^今天 ?\d{1,2}:\d{2}$"), F.concat_ws(" ", F.date_format(ref, "yyyy-MM-dd"), F.lpad(clock, 5, "0")))
    md = r"^(\d{1,2})月(\d{1,2})日 ?\d{1,2}:\d{2}$"
    dated = F.when(s.rlike(md), F.concat_ws(" ", F.concat_ws("-", F.date_format(ref, "yyyy"), F.lpad(F.regexp_extract(s, md, 1), 2, "0"), F.lpad(F.regexp_extract(s, md, 2), 2, "0")), F.lpad(clock, 5, "0")))
    return F.coalesce(minutes, hours, F.coalesce(today, dated).try_cast("timestamp_ntz"))


def count_number(s: Column) -> Column:
    """Counts as text: plain digits; anything else, such as a word or a unit, is null."""
    return F.trim(s).try_cast("bigint")


def day_label(days: Column) -> Column:
    """The label of a comment's delay in whole days; negative delays fall to the last class."""
    out = F.when(days == 0, "当日")
    for lo, hi, label in ((1, 3, "1-3天"), (4, 7, "4-7天"), (8, 15, "8-15天"), (16, 30, "16-30天")):
        out = out.when(days.between(lo, hi), label)
    return F.when(days.isNotNull(), out.otherwise("30天以上"))


def symbol_intensity(t: Column) -> Column:
    """Emphatic symbols of a text, by code point, capped."""
    return F.least(F.regexp_count(t, F.lit(SYMBOLS)), F.lit(SYMBOL_CAP))


def length_class(t: Column) -> Column:
    n = F.char_length(t)
    return F.when(n < SHORT, "Short").when(n > LONG, "Long").when(t.isNotNull(), "Medium")


def strict(t: Column) -> Column:
    """A text without mentions, tags, links and bracketed emoticons, trimmed, white space folded."""
    out = F.regexp_replace(t, r"//@[^:：]*[:：]?|回复@[^:：]*[:：]?|@[\w\-]+|#[^#]*#|https?://\S+|\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clean_texts(df: DataFrame, text: str, source: str, is_retweet: Column, official: list[str], irrelevant: list[str], neutral: list[str]) -> DataFrame:
    """df with text_clean, text_clean_strict and is_filtered.

    Retweets of an official source keep what stands before '//@'; retweets of an irrelevant source, texts with a neutral
    word, empty texts, and texts of which fewer than two characters are left when they are read strictly carry the
    sentinel as text_clean. text_clean_strict is what is left of text_clean before that last rule. A null text has nulls
    and isn't filtered; so has a null source no list.
    """
    retweet_of = lambda names: F.coalesce(is_retweet & F.col(source).isin(names), F.lit(False)) if names else F.lit(False)
    t = F.when(retweet_of(official), F.split(F.col(text), "//@")[0]).otherwise(F.col(text))
    drop = retweet_of(irrelevant) | (F.char_length(t) < 1)
    if neutral:
        drop = drop | t.rlike("|".join(re.escape(w) for w in neutral))
    kept = F.when(F.col(text).isNotNull(), F.when(drop, SENTINEL).otherwise(t))
    out = df.withColumn("text_clean_strict", strict(kept))
    short = F.char_length("text_clean_strict") < 2
    out = out.withColumn("text_clean", F.when(short, SENTINEL).otherwise(kept))
    return out.withColumn("is_filtered", F.coalesce(F.col("text_clean") == SENTINEL, F.lit(False)))


def without_noise(df: DataFrame, images: str, videos: list[str], author: str, official: list[str]) -> DataFrame:
    """Rows without image and video links, not by an official author; null and '' are no link, a null author is none of them."""
    none = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    keep = none(images)
    for v in videos:
        keep = keep & none(v)
    return df.where(keep & ~F.coalesce(F.col(author).isin(official), F.lit(False)))


def topic_input(df: DataFrame, clean: str, strict_text: str, processed: DataFrame, key: str) -> DataFrame:
    """Rows fit for topic models: cleaned text not null, not the sentinel, more than one character and not blank, key not yet processed."""
    fit = F.col(clean).isNotNull() & (F.col(clean) != SENTINEL) & (F.char_length(strict_text) > 1) & (F.trim(strict_text) != "")
    return df.where(fit).join(processed.select(key).distinct(), key, "left_anti")


def sentiment_rules(score: Column, text: Column, neutral: list[str], negative: list[str], positive: list[str]) -> Column:
    """Score by precedence: neutral words 0.5, negative words 0.1, positive words 0.9, else the model's score."""
    has = lambda ws: text.rlike("|".join(map(re.escape, ws))) if ws else F.lit(False)
    return F.when(has(neutral), 0.5).when(has(negative), 0.1).when(has(positive), 0.9).otherwise(score)


def sentences(t: Column, least: int = 4) -> Column:
    """Sentences of a text with their end marks; those of fewer characters are left out."""
    return F.filter(F.transform(F.split(t, r"(?<=[。！？!?…\n])"), lambda s: F.trim(s)), lambda s: F.char_length(s) >= least)


def cut_repost(t: Column) -> Column:
    """What stands before a quoted repost."""
    return F.trim(F.regexp_replace(t, r"(?s)//@.*", ""))


def tokens(t: Column, other_scripts: bool = False) -> Column:
    """Words of letters and pairs of ideographs as an array; digits and single characters are left out. Inside the JVM.

    Letters are Latin and kana, with other_scripts those of every script, whatever scripts a word mixes.
    """
    letters = r"[\p{L}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]{2,}" if other_scripts else r"[\p{IsLatin}\p{M}]{2,}"
    words = F.regexp_extract_all(F.lower(t), F.lit(rf"({letters}|[\p{{IsHiragana}}\p{{IsKatakana}}ー]{{2,}})"), F.lit(1))
    runs = F.regexp_extract_all(t, F.lit(r"(\p{IsHan}{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(words, pairs)


def distinct_tokens(t: Column) -> Column:
    """Tokens in order of first occurrence, joined by spaces."""
    return F.array_join(F.array_distinct(tokens(t)), " ")


def segment_with_lexicon(t: Column, lexicon: list[str], stopwords: list[str]) -> Column:
    """Longest match against a lexicon, other ideographs by themselves dropped; tokens of one character and stop words too.

    The lexicon is a driver-side list that a user curates; it goes to the workers with the function.
    """
    words = sorted({w for w in lexicon if len(w) > 1}, key=len, reverse=True)
    pattern = re.compile("|".join([*map(re.escape, words), r"[A-Za-zÀ-ž]{2,}"]))
    stop = set(stopwords)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda x: None if x is None else [w for w in pattern.findall(x) if w not in stop])

    return cut(t)


def compression_ratio(df: DataFrame, group: list[str], text: str, order: list[str], out: str = "comp_ratio") -> DataFrame:
    """(group, comp_ratio): zlib size over size of a group's texts joined by newlines in the given order.

    Under 500 bytes the ratio is 1, and it is capped at 1. The texts stream through the compressor in sorted order
    (sorted partitions, not a collected group), so a hot group needs no memory of its size. Null texts are skipped.
    """
    sorted_ = df.where(F.col(text).isNotNull()).select(*group, text, *[o for o in order if o not in group]).repartition(*group).sortWithinPartitions(*group, *order)
    schema = T.StructType([*(df.schema[g] for g in group), T.StructField(out, T.DoubleType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, z, raw, packed, rows = None, None, 0, 0, []

        def close() -> None:
            if z is not None:
                size = packed + len(z.flush())
                rows.append((*key, 1.0 if raw < LEAST_BYTES else min(1.0, size / raw)))

        for pdf in it:
            for k, t in zip(pdf[group].itertuples(index=False, name=None), pdf[text]):
                b = t.encode("utf-8", "surrogatepass")
                if k != key:
                    close()
                    key, z, raw, packed = k, zlib.compressobj(), 0, 0
                elif raw or packed:
                    b = b"\n" + b
                raw += len(b)
                packed += len(z.compress(b))
            if rows:
                yield pd.DataFrame(rows, columns=[*group, out])
                rows = []
        close()
        if rows:
            yield pd.DataFrame(rows, columns=[*group, out])

    return sorted_.mapInPandas(run, schema)


def entity_counts(df: DataFrame, text: str, aliases: dict[str, list[str]], top: int = 5) -> DataFrame:
    """(entity, n): mentions of each entity's aliases over all texts, the most mentioned ones."""
    cols = [F.sum(F.regexp_count(F.col(text), F.lit("|".join(map(re.escape, names))))).alias(e) for e, names in aliases.items()]
    one = df.agg(*cols)
    pairs = F.array(*(F.struct(F.lit(e).alias("entity"), F.coalesce(F.col(e), F.lit(0)).cast("bigint").alias("n")) for e in aliases))
    return one.select(F.inline(pairs)).where("n > 0").orderBy(F.desc("n"), "entity").limit(top)
