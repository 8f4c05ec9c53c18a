"""Problem 3: near-duplicate texts over a collection too large for pairwise comparison.

Method. LSH forest. Each distinct text gets a label of VALUES min-wise hash values in each of TREES trees. A tree sorts the
texts by their labels; texts that share a prefix of the order are candidates. Depth is adaptive for each region: a region is
all texts with the same first value, and where it holds more than REGION texts it is sorted anew by each of the remaining
values, one order for each, and cut where the common prefix ends; regions that are still dense are descended into once more.
A pair stays together if it agrees in any of the remaining values, so recall hardly falls with depth.

Exactness. Candidates are compared by sketches of BITS one-bit min-wise values first, with a margin of several standard
deviations, the first of them before the others, then by the exact similarity of their shingle sets; only true pairs come out. A region that is dense at full
depth is compared whole, in blocks if it is hot: nothing is capped.

Scale. Exact copies are collapsed first, so a text that a third of all rows share is one text here; texts are named by 128
bits of a digest. What is shuffled is one row of about 100 bytes for each tree, once, and the texts of candidates. A region that a
large share of all texts falls into is found beforehand by counting in a sample; its rows are spread over the orders of the
next depth, and over pairs of blocks at full depth, before they are shuffled. The sample only decides where a region is
compared, never which pairs are. Nothing is gathered for the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

TREES = 10
#: Values of a label; regions are opened at one, the deepest agree in three.
VALUES, DEEPEST = 4, 3
#: One-bit values of a sketch.
BITS = 512
#: Of these, the first ones, by which most pairs are told apart.
FIRST_BITS = 128
#: Texts of a region that are compared without descending further; at each depth GROWTH times as many.
REGION, GROWTH = 512, 8
#: Texts of a region, by estimate, from which it is spread before the shuffle, and the share of texts that is counted for it.
HOT, SAMPLED = 65_536, 1 / 1024
SEED = 20250201


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, k: int = 3) -> np.ndarray:
    """The distinct k-code-point substrings as sorted numbers: exact for k up to 3, 64-bit hashes beyond."""
    c = _code_points(text)
    n = len(c) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    v = c[:n].copy()
    for i in range(1, k):
        v = (v << np.uint64(21)) | c[i : i + n] if k <= 3 else _mix(v) + c[i : i + n]
    return np.unique(v)


def word_shingles(text: str, k: int = 5) -> np.ndarray:
    """The distinct runs of k words as sorted 64-bit hashes; a text of fewer words is one run."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    codes = [_mix(np.bitwise_xor.reduce(_mix(_code_points(w) + np.arange(len(w), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), keepdims=True))[0] for w in words]
    c = np.array(codes, np.uint64)
    n = max(1, len(c) - k + 1)
    v = c[:n].copy()
    for i in range(1, min(k, len(c))):
        v = _mix(v) + c[i : i + n]
    return np.unique(v)


def _batch_shingles(texts: list[str], shingle: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all texts one after the other, the number of each); with repeats, which minima don't mind."""
    if shingle is not shingles:
        sets = [shingle(t) for t in texts]
        return np.concatenate([np.empty(0, np.uint64), *sets]), np.array([len(s) for s in sets])
    c = _code_points("".join(texts))
    length = np.array([len(t) for t in texts])
    count = np.maximum(length - 2, 0)
    if len(c) < 3:
        return np.empty(0, np.uint64), count
    v = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    keep = np.ones(len(v), bool)
    for back in (1, 2):  # substrings that reach into the next text
        at = np.cumsum(length)[:-1] - back
        keep[at[(at >= 0) & (at < len(v))]] = False
    return v[keep], count


def signatures(flat: np.ndarray, count: np.ndarray, values: int) -> np.ndarray:
    """Minima of `values` multiply-add hashes, 32 bits each, for the texts that have shingles; a row for each."""
    r = np.random.default_rng(SEED)
    a, b = (r.integers(0, 1 << 31, values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), r.integers(0, 1 << 32, values, dtype=np.uint32)
    x = (_mix(flat) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(count) - count
    out = np.empty((len(count), values), np.uint32)
    lo = 0
    while lo < len(count):  # pieces that stay in the cache
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 15))))
        part, st = x[starts[lo] : starts[hi - 1] + count[hi - 1]], starts[lo:hi] - starts[lo]
        for k in range(values):
            out[lo:hi, k] = np.minimum.reduceat(part * a[k] + b[k], st)
        lo = hi
    return out


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def most_differing(threshold: float, bits: int) -> int:
    """Bits in which the sketches of a pair at the threshold differ, with four standard deviations to spare."""
    p = (1 + threshold) / 2
    return int(np.floor(bits * (1 - p) + 4 * np.sqrt(bits * p * (1 - p))))


class _Region:
    """Texts of one region: sketches as words of 64 bits, remaining values, and the pairs that were found."""

    def __init__(self, sketch: np.ndarray, values: np.ndarray, most: tuple[int, int], region: int):
        self.sketch, self.values, self.most, self.region = sketch, values, most, region
        self.found: list[np.ndarray] = []

    def compare(self, x: np.ndarray, y: np.ndarray | None = None) -> None:
        """All pairs of x, or those between x and y."""
        whole = y is None
        y = x if whole else y
        n, first, (few, most) = len(self.sketch), FIRST_BITS // 64, self.most
        step = max(1, (1 << 18) // max(1, len(y)))
        for lo in range(0, len(x), step):
            left, right = x[lo : lo + step], y[lo:] if whole else y
            differ = np.zeros((len(left), len(right)), np.uint8)
            for w in range(min(first, self.sketch.shape[1])):
                differ += np.bitwise_count(self.sketch[left, w][:, None] ^ self.sketch[right, w][None, :])
            i, j = np.nonzero(differ <= few)
            i, j = left[i], right[j]
            if whole:
                i, j = i[i != j], j[i != j]
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                ok = np.bitwise_count(self.sketch[p] ^ self.sketch[q]).sum(axis=1) <= most
                self.found.append(np.minimum(p[ok], q[ok]) * n + np.maximum(p[ok], q[ok]))

    def descend(self, x: np.ndarray, used: int, depth: int) -> None:
        """x agrees in `depth` values; dense regions are sorted by each remaining value and cut where the prefix ends."""
        if len(x) < 2:
            return
        if len(x) <= self.region * GROWTH ** (depth - 1) or depth >= DEEPEST:
            self.compare(x)
            return
        for j in range(self.values.shape[1]):
            if not used >> j & 1:
                v = self.values[x, j]
                order = np.argsort(v, kind="stable")
                v = v[order]
                cuts = np.append(np.flatnonzero(np.r_[True, v[1:] != v[:-1]]), len(v))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if b - a > 1:
                        self.descend(x[order[a:b]], used | 1 << j, depth + 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        k = np.unique(np.concatenate(self.found)) if self.found else np.empty(0, np.int64)
        return k // len(self.sketch), k % len(self.sketch)


#: r: the tree and the prefix that a region shares; rest: the remaining values, 16 bits each; used: which of them are in the
#: prefix; depth: values in the prefix; side: 0 compare all, 1 and 2 compare across, 3 compare all and don't descend.
_ROW = "r bigint, rest bigint, used tinyint, depth tinyint, side tinyint, id binary, sketch binary"


def _signed(df: DataFrame, shingle: Callable[[str], np.ndarray], trees: int, bits: int) -> DataFrame:
    """A row of _ROW for each text of (id BINARY, txt) and tree."""
    schema = pa.schema([("r", pa.int64()), ("rest", pa.int64()), ("used", pa.int8()), ("depth", pa.int8()), ("side", pa.int8()), ("id", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                flat, count = _batch_shingles(batch.column(1).to_pylist(), shingle)
                some = np.flatnonzero(count > 0)
                if not len(some):
                    continue
                sig = signatures(flat, count[some], max(bits, trees * VALUES))
                packed = np.packbits((sig[:, :bits] >> np.uint32(9) & np.uint32(1)).astype(np.uint8), axis=1)
                width, n = packed.shape[1], len(some)
                sketch = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(packed.tobytes())])
                label = sig[:, : trees * VALUES].reshape(n, trees, VALUES).astype(np.int64)
                r = np.arange(trees, dtype=np.int64)[None, :] << 32 | label[:, :, 0]
                rest = (label[:, :, 1] & 0xFFFF) | (label[:, :, 2] & 0xFFFF) << 16 | (label[:, :, 3] & 0xFFFF) << 32
                ids = batch.column(0).take(pa.array(some))
                again = pa.array(np.repeat(np.arange(n), trees))
                none = pa.array(np.zeros(n * trees, np.int8))
                yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(rest.ravel()), none, pa.array(np.ones(n * trees, np.int8)), none, ids.take(again), sketch.take(again)], schema=schema)

    return df.mapInArrow(run, _ROW)


def _orders(rows: DataFrame) -> DataFrame:
    """Each row once for each remaining value, with that value in its prefix."""
    j = F.explode(F.filter(F.sequence(F.lit(0), F.lit(VALUES - 2)), lambda i: F.getbit("used", i) == 0)).alias("j")
    out = rows.select("*", j)
    value = F.expr("shiftright(rest, 16 * j) & 65535")
    return out.select(F.xxhash64("r", "j", value).alias("r"), "rest", F.col("used").bitwiseOR(F.expr("shiftleft(1, j)")).cast("tinyint").alias("used"), (F.col("depth") + 1).cast("tinyint").alias("depth"), "side", "id", "sketch")


def _blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows of hot regions of full depth, once for each pair of blocks that they belong to."""
    own = rows.withColumns({"blocks": blocks}).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    pairs = own.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return pairs.select(F.xxhash64("r", F.least("own", "other"), F.greatest("own", "other")).alias("r"), "rest", "used", "depth", side.cast("tinyint").alias("side"), "id", "sketch")


def _spread(rows: DataFrame, some: DataFrame, hot: int, sampled: float) -> DataFrame:
    """rows, with those of hot regions spread over the orders of the next depth, and over blocks at full depth.

    some: the rows of a share `sampled` of all texts. Where no region is hot, rows come back as they are.
    """
    done = None
    for depth in range(1, DEEPEST + 1):
        sizes = some.groupBy("r").agg((F.count(F.lit(1)) / sampled).alias("n")).where(F.col("n") >= hot)
        if not sizes.limit(1).count():
            break
        sizes = materialize(sizes, "hot")  # at most one region for `hot` rows; the planner broadcasts it if it is small
        if depth == 1:
            rows = materialize(rows, "labels")
        light, dense = rows.join(sizes, "r", "left_anti"), rows.join(sizes, "r")
        done = light if done is None else done.unionByName(light)
        if depth == DEEPEST:
            return done.unionByName(_blocks(dense, F.ceil(2 * F.col("n") / hot)).select(done.columns))
        rows, some = _orders(dense.drop("n")), _orders(some.join(sizes.drop("n"), "r", "left_semi"))
    return rows if done is None else done.unionByName(rows.select(done.columns))


def _compare(most: tuple[int, int], region: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partitions come sorted by region; only the region at the end of a batch waits for the next batch."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        r = t["r"].to_numpy()
        cuts = np.append(np.flatnonzero(np.r_[True, r[1:] != r[:-1]]), len(r))
        wide = np.flatnonzero(np.diff(cuts) > 1)
        if not len(wide):
            return
        sketch = t["sketch"].combine_chunks()
        width = len(sketch[0].as_py())
        words = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(len(r), width)
        words = np.pad(words, ((0, 0), (0, -width % 8))).view(np.uint64)
        rest, used, depth, side = (t[c].to_numpy() for c in ("rest", "used", "depth", "side"))
        values = np.stack([(rest >> 16 * j) & 0xFFFF for j in range(VALUES - 1)], axis=1)
        left, right = [], []
        for k in wide:
            a, b = cuts[k], cuts[k + 1]
            g = _Region(words[a:b], values[a:b], most, region)
            x, s = np.arange(b - a), side[a:b]
            if (s == 0).all():
                g.descend(x, int(used[a]), int(depth[a]))
            elif ((s == 1) | (s == 2)).all():
                g.compare(x[s == 1], x[s == 2])
            else:
                g.compare(x)
            i, j = g.pairs()
            left.append(i + a)
            right.append(j + a)
        i, j = np.concatenate(left), np.concatenate(right)
        if len(i):
            ids = t["id"].combine_chunks()
            x, y = ids.take(pa.array(i)), ids.take(pa.array(j))
            swap = pa.compute.greater(x, y)
            yield pa.RecordBatch.from_arrays([pa.compute.if_else(swap, y, x), pa.compute.if_else(swap, x, y)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            r = batch.column(0).to_numpy()
            last = int(np.searchsorted(r, r[-1]))
            if wait and last == 0 and wait[-1].column(0)[-1].as_py() == r[0]:
                wait.append(batch)  # one region goes on
                continue
            wait.append(batch.slice(0, last))
            yield from found(pa.Table.from_batches(wait))
            wait = [batch.slice(last)]
        if wait:
            yield from found(pa.Table.from_batches(wait))

    return run


def name_of(text: Column | str) -> Column:
    """128 bits of a digest of a text: its name."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def near_pairs(df: DataFrame, key: str, text: str, threshold: float, shingle: Callable[[str], np.ndarray] = shingles, trees: int = TREES, bits: int = BITS, region: int = REGION, hot: int = HOT, sampled: float = SAMPLED) -> DataFrame:
    """(a, b, similarity) over distinct keys, a < b: all candidate pairs whose shingle sets have at least that similarity.

    df: one row for each distinct text, with a BINARY key, such as `name_of` gives. Null texts and texts without shingles
    have no pairs. An empty table has none. Other columns are not read. A tree finds a pair of similarity s with probability s
    in sparse regions; at 0.6 ten trees miss one pair in 9,500. In dense regions it is s (1 - (1 - s)^3), one missed in 4,000,
    and s (3 s^2 - 2 s^3), one in 140, where a region of two values is dense too. Pairs above the threshold are missed less.
    """
    texts = df.select(F.col(key).cast("binary").alias("id"), F.col(text).alias("txt")).where(F.col("id").isNotNull() & F.col("txt").isNotNull())
    few = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(sampled * (1 << 20))) if sampled < 1 else texts
    rows = _spread(_signed(texts, shingle, trees, bits), _signed(few, shingle, trees, bits), hot, sampled)
    order = rows.repartition("r").sortWithinPartitions("r", "id")
    candidates = order.mapInArrow(_compare((most_differing(threshold, min(FIRST_BITS, bits)), most_differing(threshold, bits)), region), "a binary, b binary").distinct()
    both = candidates.join(texts.withColumnsRenamed({"id": "a", "txt": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "txt": "tb"}), "b")

    @F.pandas_udf(T.DoubleType())
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        sets: dict[str, np.ndarray] = {}

        def of(t: str) -> np.ndarray:
            s = sets.get(t)
            if s is None:
                s = sets[t] = shingle(t)
            return s

        return pd.Series([_similarity(of(t), of(u)) for t, u in zip(x, y)], dtype=float)

    return both.select("a", "b", exact("ta", "tb").alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
