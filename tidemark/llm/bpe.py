"""Problem 7: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method. A hierarchical-bitmap rank queue. Pre-tokens are linked lists of symbols; each neighbouring pair that the
vocabulary merges waits, by its list position, in the bucket of its merge rank. Bitmaps over the buckets (words of 64
ranks, superwords of 64 words) give the next rank by find-first-set; entries whose pair has changed since are stale and
skipped. A merge costs the same however long its pre-token is, so very long pre-tokens take linear time.

All distinct pre-tokens of an Arrow batch share one queue: pre-tokens don't interact, so a word of 64 ranks is taken at
once and each pre-token merges its own lowest rank, all pre-tokens in one numpy step, until the word is empty. Merging
rank r only makes pairs of higher rank (both parts of a merge are older than it), so no bucket fills again behind.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the pattern that splits text before merges, published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int32(1 << 30)
_WORD, _SUPER = 6, 12
#: Bytes of distinct pre-tokens that share one queue; bounds the memory of a worker.
CHUNK_BYTES = 3 << 20


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge table as arrays; small (about 1 MB), made on the driver and sent to the workers."""

    def __init__(self, path: str):
        file = json.loads(open(path, encoding="utf-8").read())
        model, before = file["model"], file.get("pre_tokenizer") or {}
        vocab, letters = model["vocab"], byte_letters()
        # another kind of file would give wrong ids without a word
        if model.get("type", "BPE") != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or file.get("normalizer"):
            raise ValueError(f"{path} is no byte-level BPE vocabulary without normalisation")
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False or max(vocab.values()) >= 1 << 17:
            raise ValueError(f"{path} splits texts in another way than PATTERN, or has more than 2^17 ids")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_id = np.empty(256, np.int32)
        for ch, b in letters.items():
            self.byte_id[b] = vocab[ch]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.new_id = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.separator = max(vocab.values()) + 1
        self.lengths = np.zeros(self.separator, np.int32)
        for token, k in vocab.items():
            self.lengths[k] = len(token)  # a letter for each byte; special tokens never come out
        # a cascade of hash tables: keys that collide at one level go to the next
        keys, ranks = (left << 17) | right, np.arange(len(pairs), dtype=np.int32)
        self.levels: list[tuple[np.uint64, int, np.ndarray, np.ndarray]] = []
        rng, bits = np.random.default_rng(7), 19
        while len(keys):
            mult = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
            slot = ((keys.astype(np.uint64) * mult) >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            table_key, table_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
            table_key[slot[first]], table_rank[slot[first]] = keys[first], ranks[first]
            self.levels.append((mult, bits, table_key, table_rank))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, bits = keys[rest], ranks[rest], max(10, bits - 4)

    def id_bytes(self) -> np.ndarray:
        """The number of bytes of each token."""
        return self.lengths

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; _NONE where the vocabulary has none."""
        key = (a.astype(np.int64) << 17) | b
        u = key.astype(np.uint64)
        out = np.full(len(key), _NONE, np.int32)
        for mult, bits, table_key, table_rank in self.levels:
            slot = ((u * mult) >> np.uint64(64 - bits)).astype(np.int64)
            hit = table_key[slot] == key
            out[hit] = table_rank[slot[hit]]
        return out


class RankQueue:
    """The symbols of many pre-tokens as one linked list, merged in rank order within each pre-token."""

    def __init__(self, merges: Merges, pieces: list[bytes]):
        self.m = merges
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.data = np.frombuffer(b"\x00".join(pieces) + b"\x00", np.uint8)
        size = len(self.data)
        ends = np.cumsum(n + 1) - 1  # a separator ends each pre-token
        self.sym = merges.byte_id[self.data]
        self.sym[ends] = merges.separator
        self.ends = ends
        self.seg = np.zeros(size, np.int32)
        self.seg[ends[:-1] + 1] = 1
        np.cumsum(self.seg, out=self.seg)
        self.nxt = np.arange(1, size + 1, dtype=np.int32)
        self.prv = np.arange(-1, size - 1, dtype=np.int32)
        self.prv[0] = size - 1  # the last separator also stands before the first symbol
        self.nxt[-1] = size - 1
        self.pair = np.full(size, _NONE, np.int32)
        table = merges.rank(np.repeat(merges.byte_id, 256), np.tile(merges.byte_id, 256))
        self.pair[:-1] = table[self.data[:-1].astype(np.int32) * 256 + self.data[1:]]
        self.pair[ends] = _NONE
        self.pair[ends[n > 0] - 1] = _NONE
        self.live = np.ones(size, bool)
        self.live[ends] = False

    def _merge(self, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Merge the pairs that begin at these positions (ascending, none overlapping); positions whose pairs are new."""
        right = self.nxt[at]
        after = self.nxt[right]
        self.sym[at] = self.m.new_id[rank]
        self.nxt[at] = after
        self.prv[after] = at
        self.pair[right] = _NONE
        self.live[right] = False
        changed = np.concatenate([at, self.prv[at]])
        self.pair[changed] = self.m.rank(self.sym[changed], self.sym[self.nxt[changed]])
        return changed

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in order, and the number of them in each pre-token."""
        n_ranks = len(self.m.new_id)
        top = np.bincount(self.pair[self.pair < _NONE] >> _SUPER, minlength=(n_ranks >> _SUPER) + 1)
        supers = sum(1 << int(k) for k in np.flatnonzero(top))
        while supers:
            s = (supers & -supers).bit_length() - 1
            supers &= supers - 1
            lo, hi = s << _SUPER, (s + 1) << _SUPER
            waiting = np.flatnonzero((self.pair >= lo) & (self.pair < hi)).astype(np.int32)
            rank = self.pair[waiting]
            order = np.argsort(rank, kind="stable")
            waiting, rank = waiting[order], rank[order]
            cuts = np.searchsorted(rank, np.arange(lo, hi + 1, 1 << _WORD))
            bucket = [[waiting[cuts[k] : cuts[k + 1]]] if cuts[k + 1] > cuts[k] else [] for k in range(64)]
            words = sum(1 << k for k in range(64) if bucket[k])
            while words:
                w = (words & -words).bit_length() - 1
                words &= words - 1
                base = lo + (w << _WORD)
                entries = np.concatenate(bucket[w])
                while len(entries):
                    r = self.pair[entries]
                    fresh = (r >= base) & (r < base + 64)  # others are stale
                    entries, r = entries[fresh], r[fresh]
                    if not len(entries):
                        break
                    key = np.sort((self.seg[entries].astype(np.int64) << 38) | ((r - base).astype(np.int64) << 32) | entries)
                    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
                    seg, r, pos = key >> 38, (key >> 32) & 63, (key & 0xFFFFFFFF).astype(np.int32)
                    start = np.empty(len(key), bool)
                    start[0] = True
                    np.not_equal(seg[1:], seg[:-1], out=start[1:])
                    first = r[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
                    now = r == first
                    at, rank_now, rest = pos[now], r[now].astype(np.int32) + np.int32(base), pos[~now]
                    # of overlapping pairs, as in a run of one letter, every second one counts from the left
                    joined = np.zeros(len(at), bool)
                    joined[1:] = self.nxt[at[:-1]] == at[1:]
                    if joined.any():
                        k = np.arange(len(at))
                        odd = (k - np.maximum.accumulate(np.where(joined, 0, k))) & 1
                        at, rank_now = at[odd == 0], rank_now[odd == 0]
                    changed = self._merge(at, rank_now)
                    r = self.pair[changed]
                    soon = (r >= base) & (r < base + 64)
                    entries = np.concatenate([rest, changed[soon]])
                    for k in np.unique((r[(r >= base + 64) & (r < hi)] - lo) >> _WORD):
                        bucket[k].append(changed[(r >= lo + (k << _WORD)) & (r < lo + ((k + 1) << _WORD))])
                        words |= 1 << int(k)
                    for k in np.unique(r[(r >= hi) & (r < _NONE)] >> _SUPER):
                        supers |= 1 << int(k)
        counts = np.add.reduceat(self.live.astype(np.int32), np.concatenate([[0], self.ends[:-1] + 1])) if len(self.ends) else np.empty(0, np.int32)
        return self.sym[self.live], counts


class Encoder:
    """Texts to token ids; remembers nothing between calls but the merge table."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.split = regex.compile(PATTERN).findall

    def _parts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all distinct pre-tokens, their numbers of ids, the pre-token of each occurrence, occurrences of each text)."""
        known: dict[str, int] = {}
        of: list[int] = []
        per_text = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                parts = self.split(t)
                per_text[k] = len(parts)
                of.extend([known.setdefault(p, len(known)) for p in parts])
        ids, counts, chunk, size = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [], 0

        def run() -> None:
            i, c = RankQueue(self.merges, chunk).run()
            ids.append(i)
            counts.append(c)

        for p in known:
            b = p.encode("utf-8", "surrogatepass")
            chunk.append(b)
            size += len(b) + 1
            if size > CHUNK_BYTES:
                run()
                chunk, size = [], 0
        if chunk:
            run()
        return np.concatenate(ids), np.concatenate(counts).astype(np.int64), np.array(of, np.int64), per_text

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        _, n, occ, per_text = self._parts(texts)
        ends = np.concatenate([[0], np.cumsum(n[occ])])
        return np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null and '' have none."""
        flat, n, occ, per_text = self._parts(texts)
        if not len(occ):
            return flat, per_text
        begin = np.cumsum(n) - n
        length = n[occ]
        ends = np.cumsum(length)
        out = flat[np.repeat(begin[occ] - (ends - length), length) + np.arange(ends[-1])]
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return out, np.diff(cut)


def encode_column(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row: the token ids of its text, without special tokens.

    A null text and an empty text have the empty list. Texts of any length are encoded whole; a special token's name in
    a text is ordinary text. Repeated rows come out repeated; an empty table gives none; other columns are not read.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(Merges(f"{directory}/{tokenizer}.json"))
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(table.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                # results leave in pieces of bounded size
                upto, size = at, 0
                while upto < len(texts) and size < (8 << 20):
                    size += len(texts[upto] or "")
                    upto += 1
                ids, n = enc.encode(texts[at:upto])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, upto - at), lists], names=[key, "ids"])
                at = upto

    return df.select(key, text).mapInArrow(run, schema)


def count_column(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens BIGINT) of every row; 0 for null and empty texts."""
    table = df.sparkSession.sparkContext.broadcast(Merges(f"{directory}/{tokenizer}.json"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(table.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts, at = [], 0
            while at < len(texts):  # texts of bounded size at a time
                upto, size = at, 0
                while upto < len(texts) and size < (8 << 20):
                    size += len(texts[upto] or "")
                    upto += 1
                counts.append(enc.count(texts[at:upto]))
                at = upto
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.empty(0, np.int64), *counts]), pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, schema)
