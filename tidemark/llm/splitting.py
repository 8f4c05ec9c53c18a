"""Problem 9: items beyond a size limit cut into ordered pieces at natural boundaries, with a given overlap.

Method. Lexical-cohesion segmentation. A text's sentences and lines are its units; at each gap between units the words
(pairs of characters, hashed to _DIMS buckets, rare ones of the text weighing more) of the BLOCK units before are compared
with those of the BLOCK units after by cosine. Where the similarity has a valley, the topic changes; a valley's depth is
how far the similarity rises within BLOCK gaps on both sides.
A piece ends at the deepest valley of its size window, which is the second half of the capacity; without a unit's end
there, at the last comma or space, and without those at the last character border. The next piece begins `overlap`
tokens before.

Sizes are tokens of the document's own encoding: piece k is tokens [token_start, token_end), at most the capacity, and
two consecutive pieces share exactly the overlap, or a few tokens more where a character of several tokens would
be torn apart. Texts are cut where they are read: no shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import bpe

BLOCK = 6
_DIMS = 256
#: Gaps that are compared at a time; bounds the memory of a very long text.
_GAPS = 2048
_UNIT = regex.compile(r"(?:[。！？!?…]+[\"'”’）)】」』]*|\.(?=\s)|\n)\s*")
_CLAUSE = regex.compile(r"[，,、；;：:]\s*|\s+")


def _window_sums(rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of `size` consecutive rows, of fewer at both ends: len(rows) + size - 1 of them, by doubling."""
    if size == 1:
        return rows
    part = _window_sums(rows, size // 2 if size % 2 == 0 else size - 1)
    shift, other = (size // 2, part) if size % 2 == 0 else (size - 1, rows)
    out = np.zeros((len(rows) + size - 1, rows.shape[1]), rows.dtype)
    out[: len(part)] = part
    out[shift : shift + len(other)] += other
    return out


def valley_depths(points: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Depth of the cohesion valley at each inner unit border; points are code points, ends the units' ends in characters."""
    n = len(ends)
    if n < 2:
        return np.empty(0)
    pair = (points[:-1].astype(np.uint32) * np.uint32(31) + points[1:]) * np.uint32(2654435761) >> np.uint32(24)
    unit = np.searchsorted(ends, np.arange(len(pair)), "right")

    def counts(first: int, last: int) -> np.ndarray:
        """Buckets of the units first to last."""
        i, j = np.searchsorted(unit, (first, last))
        return np.bincount((unit[i:j] - first) * _DIMS + pair[i:j], minlength=(last - first) * _DIMS).reshape(last - first, _DIMS).astype(np.float32)

    whole = counts(0, n) if n <= _GAPS else None
    held = (whole > 0).sum(axis=0) if whole is not None else sum((counts(i, min(n, i + _GAPS)) > 0).sum(axis=0) for i in range(0, n, _GAPS))
    weight = np.log((n + 1) / (held + 0.5)).astype(np.float32)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    sim = np.empty(n - 1)
    for lo in range(1, n, _GAPS):  # gaps lo to hi, with the units that their windows reach
        hi = min(n, lo + _GAPS)
        first, last = max(0, lo - block), min(n, hi - 1 + block)
        sums = _window_sums((counts(first, last) if whole is None else whole) * weight, block)  # row k: units first + k - block + 1 to first + k
        square = dot(sums, sums)
        at = np.arange(lo, hi) - first
        norm = np.sqrt(square[at - 1] * square[at - 1 + block])
        sim[lo - 1 : hi - 1] = np.where(norm > 0, dot(sums[at - 1], sums[at - 1 + block]) / np.maximum(norm, 1e-9), 0.0)
    padded = np.concatenate([np.full(block, -1.0), sim, np.full(block, -1.0)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, block + 1)
    return windows[: n - 1].max(axis=1) + windows[block : block + n - 1].max(axis=1) - 2 * sim


class Cutter:
    """All that is needed of one text: its token borders, units and valleys."""

    def __init__(self, text: str, ids: np.ndarray, id_bytes: np.ndarray):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        self.text, self.n = text, len(ids)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        self.char_byte = np.append(lead, len(data))
        token_byte = np.concatenate([[0], np.cumsum(id_bytes[ids])])
        at = np.searchsorted(self.char_byte, token_byte)
        #: the character at which a token begins; tokens that begin inside one count with the next
        self.token_char = at
        self.whole = self.char_byte[np.minimum(at, len(lead))] == token_byte
        self.token_byte = token_byte
        ends = np.fromiter((m.end() for m in _UNIT.finditer(text)), np.int64)
        if not len(ends) or ends[-1] != len(text):
            ends = np.append(ends, len(text))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        depth = np.append(valley_depths(points, ends), 0.0)
        cut, depth = self._tokens(ends, depth)
        self.cut_list, self.depth_list = cut.tolist(), depth.tolist()
        self._clauses: list[int] | None = None

    def _tokens(self, ends: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token borders at these characters, where there are any."""
        b = self.char_byte[ends]
        k = np.searchsorted(self.token_byte, b)
        ok = self.token_byte[np.minimum(k, self.n)] == b
        return k[ok], depth[ok]

    def clauses(self) -> list[int]:
        if self._clauses is None:
            ends = np.fromiter((m.end() for m in _CLAUSE.finditer(self.text)), np.int64)
            self._clauses = self._tokens(ends, np.zeros(len(ends)))[0].tolist()
        return self._clauses

    def _down(self, t: int) -> int:
        while t > 0 and not self.whole[t]:
            t -= 1
        return t

    def pieces(self, capacity: int, overlap: int) -> list[tuple[int, int]]:
        """[start, end) in tokens of each piece."""
        overlap = max(0, min(overlap, capacity - 1))
        cut, depth = self.cut_list, self.depth_list
        out, s = [], 0
        while self.n - s > capacity:
            hi = s + capacity
            lo = min(hi, s + max(overlap + 1, capacity // 2))
            i, j = bisect_left(cut, lo), bisect_right(cut, hi)
            if j > i:
                e = cut[max(range(i, j), key=lambda k: (depth[k], k))]  # the later of equal valleys
            else:
                c = self.clauses()
                i, j = bisect_left(c, lo), bisect_right(c, hi)
                e = c[j - 1] if j > i else self._down(hi)
            if e <= s:  # the capacity is smaller than one character
                e = hi
            out.append((s, e))
            s = max(s + 1, self._down(e - overlap)) if e - overlap > s else e
        out.append((s, self.n))
        return out


def split_column(df: DataFrame, key: str, text: str, budgets: list[tuple[int, int, int]], tokenizer: str = "byte_bpe_50k", directory: str = bpe.TOKENIZERS) -> DataFrame:
    """(budget_id, key, piece, token_start, token_end, n_tokens, char_start, char_end, text) of each text beyond a capacity.

    budgets: (budget_id, capacity, overlap). Texts that fit have no pieces; null and empty texts neither. Texts of any
    length are cut whole. Repeated rows come out repeated, an empty table gives none, other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(bpe.Merges(f"{directory}/{tokenizer}.json"))
    names = ["budget_id", key, "piece", "token_start", "token_end", "n_tokens", "char_start", "char_end", "text"]
    types = [T.IntegerType(), df.schema[key].dataType, *[T.IntegerType()] * 6, T.StringType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    least = min((c for _, c, _ in budgets), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.Encoder(shared.value)
        id_bytes = shared.value.id_bytes()
        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0).to_pylist()
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and size < (4 << 20):
                    size += len(texts[upto] or "")
                    upto += 1
                ids, n = enc.encode(texts[at:upto])
                cols: list[list] = [[] for _ in names]
                end = 0
                for k in range(at, upto):
                    start, end = end, end + int(n[k - at])
                    if end - start <= least:
                        continue
                    cutter = Cutter(texts[k], ids[start:end], id_bytes)
                    for budget, capacity, overlap in budgets:
                        if end - start <= capacity:
                            continue
                        for p, (s, e) in enumerate(cutter.pieces(capacity, overlap)):
                            a, z = int(cutter.token_char[s]), int(cutter.token_char[e])
                            for c, v in zip(cols, (budget, keys[k], p, s, e, e - s, a, z, texts[k][a:z])):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out_types)], names=names)
                at = upto

    from pyspark.sql.pandas.types import to_arrow_type

    out_types = [to_arrow_type(t) for t in types]
    return df.select(key, text).mapInArrow(run, schema)
