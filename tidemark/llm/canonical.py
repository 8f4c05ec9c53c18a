"""Problem 5: text that looks the same but is stored with other characters, to one canonical form.

Method. A weighted edit automaton walks a trie of the vocabulary over the text as it is stored: a character moves along
the edge of what it looks like at cost zero, an ignorable character stays where it is at cost zero, and every other edit
costs one. Canonical forms are chosen within a budget of zero, so a token reaches a leaf exactly if it looks like that
entry; `LookTrie.nearest` walks with a greater budget. Each leaf holds the canonical spelling: the plainest, then most
frequent, spelling that the corpus has for it. Letters and digits are walked as whole words, ideographs by longest match
from place to place. Tokens that reach no leaf are normalised by the table.

The vocabulary that workers hold is bounded: the `vocab_size` words and pairs of ideographs that occur in most texts
(2^16 of at most 64 characters, so some ten MB). Its bound can't change which texts come out equal: both ways map two
tokens to one form exactly if they look alike, only the spelling chosen can differ, and that is settled by look.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

# Look-alike letters by the plain letter they look like (public confusables data, letters that
# are drawn the same; pairs within ASCII such as l and I or 0 and O are left apart).
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟⅭ", "D": "ᎠⅮ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "Ԍ", "H": "НΗᎻ", "I": "ІΙӀⅠ", "J": "ЈᎫͿ",
    "K": "КΚᏦK", "L": "ᏞⅬ", "M": "МΜᎷⅯ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս",
    "V": "ѴᏙⅤ", "W": "ԜᎳ", "X": "ХΧⅩ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аɑα", "b": "Ƅ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "е", "f": "", "g": "ɡց", "h": "һհ", "i": "іⅰι", "j": "јϳ", "k": "", "l": "ⅼӏ",
    "m": "ⅿ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛգ", "s": "ѕ", "u": "սυ", "v": "ѵνⅴ", "w": "ԝѡա", "x": "хⅹ", "y": "уү", "z": "",
    "-": "‐‑‒–⁃−﹣", "'": "’‘ʼ＇", ".": "․", ",": "‚", ":": "ː∶", "/": "⁄∕", "~": "∼˜", "!": "ǃ", "|": "∣ǀ", "·": "‧∙⋅・",
}

# Radicals outside the block that Unicode itself maps, by the ideograph they look like.
RADICALS = {"⺟": "母", "⻁": "虎", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长", "⻔": "门", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻳": "龟"}

#: Characters that show nothing.
IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x84\x86-\x9F￹-￻]")
_SPACES = regex.compile(r"[\p{Zs}\t]")
_CONTROL = regex.compile(r"\r\n?|[\x85  ]")
#: Text of these characters alone is its own canonical form; most texts end here.
_PLAIN = regex.compile(r"[ -~\n\xC0-\xD6\xD8-\xF6\xF8-ž一-鿿ぁ-ゖァ-ヺー、。《-】…—]*")
VOCAB_SIZE = 1 << 16
MAX_TOKEN = 64


@lru_cache(maxsize=1 << 16)
def look(ch: str) -> str:
    """What one visible character looks like: width, compatibility ideographs, kinds of space and look-alikes folded."""
    if _SPACES.fullmatch(ch):
        return " "
    o = ord(ch)
    if 0xFF01 <= o <= 0xFFEF or 0x2F00 <= o <= 0x2FD5 or o == 0x2E9F or o == 0x2EF3:
        ch = unicodedata.normalize("NFKC", ch)
        if len(ch) == 1 and _SPACES.fullmatch(ch):
            return " "
    ch = RADICALS.get(ch, ch)
    return _FOLD.get(ch, ch)


_FOLD = {c: plain for plain, same in LOOKALIKES.items() for c in same}


def by_table(text: str) -> str:
    """The form by the table alone: equal for two texts exactly if they look the same."""
    t = IGNORABLE.sub("", _CONTROL.sub("\n", text))
    t = "".join(map(look, t))  # half-width kana need their marks beside them before they are composed
    t = unicodedata.normalize("NFD", t)
    return unicodedata.normalize("NFC", "".join(_FOLD.get(c, c) for c in t))


#: The form of a sign, blank or lone ignorable; a text holds few different ones.
_sign = lru_cache(maxsize=1 << 14)(by_table)


def _word_class(ch: str) -> str:
    """h: ideograph, w: other letter, mark or digit, '': anything else, which is a token of its own."""
    return "h" if regex.fullmatch(r"\p{Han}", ch) else "w" if regex.fullmatch(r"[\p{L}\p{M}\p{N}]", ch) else ""


def _token_pattern() -> regex.Pattern:
    """Tokens of a text as stored, ignorables inside: characters go by the class of what they look like."""
    moved = {c: _word_class(look(c)) for c in [*_FOLD, *RADICALS] if _word_class(c) != _word_class(look(c))}
    put = lambda k: "".join(map(regex.escape, (c for c, to in moved.items() if to == k)))
    away = "".join(map(regex.escape, moved)) or "\\x00"
    han, word = rf"[\p{{Han}}--[{away}]]", rf"[[\p{{L}}\p{{M}}\p{{N}}]--[\p{{Han}}{away}]]"
    han, word = (f"(?:{x}|[{p}])" if p else x for x, p in ((han, put("h")), (word, put("w"))))
    skip = IGNORABLE.pattern
    return regex.compile(rf"(?V1)(?P<han>{skip}*{han}(?:{han}|{skip})*)|(?P<word>{skip}*{word}(?:{word}|{skip})*)|{skip}+|.", regex.S)


@lru_cache(maxsize=1 << 16)
def arcs(ch: str) -> str:
    """The edges that a stored character moves along at cost zero; '' for an ignorable one."""
    if IGNORABLE.fullmatch(ch):
        return ""
    return "".join(_FOLD.get(c, c) for c in unicodedata.normalize("NFD", look(ch)))


class LookTrie:
    """A trie of spellings; edges are labelled with looks of decomposed characters."""

    __slots__ = ("root",)

    def __init__(self, words: list[tuple[str, int]]):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            form = by_table(word)
            for c in unicodedata.normalize("NFD", form):
                node = node.setdefault(c, {})
            # where the look is plain, the plain spelling is the canonical one, seen or not; else the most frequent
            spelling = form if _PLAIN.fullmatch(form) else unicodedata.normalize("NFC", IGNORABLE.sub("", word))
            if "" not in node or (-n, spelling) < node[""]:
                node[""] = (-n, spelling)

    def walk(self, token: str, at: int = 0) -> tuple[int, str | None]:
        """The automaton within a budget of zero: (end, spelling) of the longest entry that looks like token[at:end]."""
        node, end, found = self.root, at, None
        for i in range(at, len(token)):
            for c in arcs(token[i]):
                node = node.get(c)
                if node is None:
                    return end, found
            if "" in node:  # an ignorable behind a leaf stays there and belongs to it
                end, found = i + 1, node[""][1]
        return end, found

    def canonical(self, token: str) -> str | None:
        """The canonical spelling of the entry that the whole token looks like; None if it reaches no leaf."""
        node = self.root
        for ch in token:
            for c in arcs(ch):
                node = node.get(c)
                if node is None:
                    return None
        leaf = node.get("")
        return leaf[1] if leaf else None

    def nearest(self, token: str, budget: int) -> list[tuple[int, str]]:
        """(cost, spelling) of the entries within a budget of edits, cheapest first; look-alikes and ignorables are free.

        All live states are walked at once: the trie's node and the cheapest cost of being there.
        """
        states = {id(self.root): (self.root, 0)}

        def settle(live: dict, node: dict, cost: int) -> None:
            if cost <= budget and (id(node) not in live or live[id(node)][1] > cost):
                live[id(node)] = (node, cost)
                for c, child in node.items():
                    if c:
                        settle(live, child, cost + 1)  # a character of the entry that the token lacks

        for node, cost in list(states.values()):
            settle(states, node, cost)
            for c, child in node.items():
                if c:
                    settle(states, child, cost + 1)
        for c in (c for ch in token for c in arcs(ch)):
            after: dict = {}
            for node, cost in states.values():
                for edge, child in node.items():
                    if edge:
                        settle(after, child, cost + (edge != c))
                settle(after, node, cost + 1)  # a character of the token that the entry lacks
            states = after
        return sorted((cost, node[""][1]) for node, cost in states.values() if "" in node)


class Canonicalizer:
    """Token by token with a memory of words; one for each Python worker. `settled` counts tokens by how they were settled."""

    def __init__(self, words: list[tuple[str, int]]):
        self.trie = LookTrie(words)
        self.seen: dict[str, str] = {}
        self.settled = {"trie": 0, "table": 0}

    def _table(self, tok: str) -> str:
        """The table's form, in the spelling of the entry that has this look, if there is one."""
        self.settled["table"] += 1
        form = by_table(tok)
        return self.trie.canonical(form) or form

    def token(self, tok: str) -> str:
        """A word as a whole."""
        out = self.seen.get(tok)
        if out is None:
            out = self.trie.canonical(tok)
            if out is None:
                out = self._table(tok)
            else:
                self.settled["trie"] += 1
            self._remember(tok, out)
        return out

    def ideographs(self, run: str) -> str:
        """A run of ideographs by longest match; what reaches no leaf goes by the table, one character at a time."""
        known = self.seen.get(run)
        if known is not None:
            return known
        out, at = [], 0
        while at < len(run):
            end, spelling = self.trie.walk(run, at)
            if spelling is None:
                end, spelling = at + 1, self._table(run[at])
            else:
                self.settled["trie"] += 1
            out.append(spelling)
            at = end
        return self._remember(run, "".join(out))

    def _remember(self, tok: str, out: str) -> str:
        if len(self.seen) > 200_000:
            self.seen.clear()
        if len(tok) <= MAX_TOKEN:
            self.seen[tok] = out
        return out

    def text(self, t: str | None) -> str | None:
        if t is None or _PLAIN.fullmatch(t):
            return t
        out = []
        for m in _TOKEN.finditer(_CONTROL.sub("\n", t)):
            kind = m.lastgroup
            out.append(self.ideographs(m.group()) if kind == "han" else self.token(m.group()) if kind else _sign(m.group()))
        # marks and letters that compose across token borders
        return unicodedata.normalize("NFC", "".join(out))


_TOKEN = _token_pattern()


def vocabulary(df: DataFrame, column: str, size: int = VOCAB_SIZE) -> list[tuple[str, int]]:
    """The `size` most frequent words, and pairs of ideographs, of the whole column with their numbers of texts.

    Counting is one aggregation over all texts with map-side combine; only the top rows, `size` at most, come to the driver.
    """
    word = r"[\p{L}\p{M}\p{Cf}&&[^\p{IsHan}]]{2," + str(MAX_TOKEN) + "}"
    words = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(rf"({word}|\p{{IsHan}}{{1,2}})"), F.lit(1)))).alias("w"))
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(size)
    return [(r["w"], r["n"]) for r in top.collect()]


def canonical_column(df: DataFrame, column: str, words: list[tuple[str, int]]) -> Column:
    """Column with the canonical form of a text column."""
    shared = df.sparkSession.sparkContext.broadcast(words)  # at most VOCAB_SIZE words of MAX_TOKEN characters

    @F.pandas_udf(T.StringType())
    def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = Canonicalizer(shared.value)
        for s in batches:
            yield s.map(c.text, na_action="ignore")

    return canonical(F.col(column))


def canonicalize(df: DataFrame, column: str, out: str = "canonical", vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """df with the canonical form of a text column in `out`.

    Null stays null, '' stays '', texts of any length are read whole, repeated rows come out repeated, an empty table
    stays empty, and a column that is already called `out` is replaced.
    """
    words = vocabulary(df, column, vocab_size)
    return df.withColumn(out, canonical_column(df, column, words))


def looks_of(df: DataFrame, key: str, text: str, canonical: str) -> DataFrame:
    """(id, look, form, spelling), written to the shared folder: the canonical forms are computed once, not for each use.

    form and spelling are 256-bit digests of the canonical form and of the stored text, look is 64 bits of the former.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), F.xxhash64(canonical).alias("look"), F.unhex(F.sha2(text, 256)).alias("spelling"), F.unhex(F.sha2(canonical, 256)).alias("form")).distinct()
    return materialize(rows, "looks")


def look_classes(rows: DataFrame) -> DataFrame:
    """(id, class_id, n_spellings) of each record of `looks_of`: class_id is the smallest id with the same look.

    Aggregated with map-side combine; the join back is on a key that is unique on one side, so a hot look is split by AQE.
    """
    classes = rows.groupBy("form").agg(F.min("id").alias("class_id"), F.count_distinct("spelling").alias("n_spellings"))
    return rows.select("id", "form").distinct().join(classes, "form").select("id", "class_id", "n_spellings")


#: Records of one look that are paired in one block; larger groups are cut into as many blocks as they need.
BLOCK = 2_000


def lookalike_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b), id_a < id_b as strings, of `looks_of`: records of different texts with one canonical form.

    Groups with one spelling only, such as stock phrases, are dropped by an aggregation before anything is paired. In
    the rest, pairs are formed between different spellings; a look's records are spread over blocks by their number, so
    that a look that holds a third of all rows doesn't stay in one task, and one of a few rows isn't copied at all.
    """
    several = rows.groupBy("look", "form").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi"), F.ceil(F.count(F.lit(1)) / block).alias("blocks")).where("lo < hi").select("look", "form", "blocks")
    mixed = rows.join(several, ["look", "form"])
    left = mixed.select("look", "form", F.col("spelling").alias("s1"), F.col("id").alias("i1"), F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    right = mixed.select("look", "form", F.col("spelling").alias("s2"), F.col("id").alias("i2"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    pairs = left.join(right, ["look", "form", "block"]).where((F.col("s1") != F.col("s2")) & (F.col("i1") < F.col("i2")))
    return pairs.select(F.col("i1").alias("id_a"), F.col("i2").alias("id_b")).distinct()
