"""Repeated images: clusters of near-equal hashes within a window, and the measures built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import hamming_hex

#: Bits by which two hashes of 256 bits may differ, and the bands that find every such pair: one more than the bits.
MOST_BITS, BANDS, DAMPING = 10, 11, 15


def hash_links(df: DataFrame, window: str, h: str, most: int = MOST_BITS) -> DataFrame:
    """(window, a, b): pairs of distinct hashes of a window within `most` bits.

    By the pigeonhole rule two such hashes agree wholly in one of most + 1 bands, so an equi-join on bands finds all
    pairs; each is then checked exactly. Hashes have 64 hexadecimal digits.
    """
    bands = most + 1
    d = df.select(window, h).where(F.col(h).isNotNull()).distinct()
    cuts = [round(i * 64 / bands) for i in range(bands + 1)]
    banded = d.select(window, h, F.posexplode(F.array(*(F.substring(h, a + 1, b - a) for a, b in zip(cuts, cuts[1:])))).alias("band", "key"))
    other = banded.withColumnRenamed(h, "b")
    pairs = banded.withColumnRenamed(h, "a").join(other, [window, "band", "key"]).where("a < b").select(window, "a", "b").distinct()
    return pairs.where(hamming_hex(F.col("a"), F.col("b")) <= most)


def components(links: DataFrame, window: str, nodes: DataFrame, h: str) -> DataFrame:
    """(window, node, root): connected components, window by window, as union-find over a window's links.

    A window holds minutes of data, so its links are few; for links without windows see `components_global`.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}

        def find(x: str) -> str:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(pdf["a"], pdf["b"]):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        return pd.DataFrame({window: pdf[window].iloc[0], "node": list(parent), "root": [find(x) for x in parent]})

    kind = links.schema[window].dataType.simpleString()
    joined = links.groupBy(window).applyInPandas(one, f"{window} {kind}, node string, root string")
    n = nodes.select(window, F.col(h).alias("node")).where(F.col("node").isNotNull()).distinct()
    return n.join(joined, [window, "node"], "left").select(window, "node", F.coalesce("root", "node").alias("root"))


def components_global(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): components of any graph by propagating the least label over edges, with pointer jumping.

    links: (a, b) strings. Each round is written to the shared folder, so lineage stays short and executors may be
    lost; rounds grow with the logarithm of the longest chain, and go on until no label moves.
    """
    from tidemark.session import materialize

    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialize(nodes.select(F.col("node"), F.col("node").alias("root")).distinct(), "labels")
    while True:
        least = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(least.withColumnRenamed("a", "node"), "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("to"))
        jump = step.join(label.select(F.col("node").alias("to"), F.col("root").alias("further")), "to", "left")
        new = materialize(jump.select("node", F.least("to", F.coalesce("further", "to")).alias("root"), (F.col("root") != F.least("to", F.coalesce("further", "to"))).alias("moved")), "labels")
        label = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return label


def repetition(df: DataFrame, window: str, h: str, most: int = MOST_BITS) -> DataFrame:
    """(window, n, groups, redundancy, concentration, largest): images, clusters, surplus, share of the three largest."""
    counts = df.where(F.col(h).isNotNull()).groupBy(window, F.col(h).alias("node")).agg(F.count(F.lit(1)).alias("m"))
    c = counts.join(components(hash_links(df, window, h, most), window, df, h), [window, "node"])
    sizes = c.groupBy(window, "root").agg(F.sum("m").alias("size"))
    w = Window.partitionBy(window).orderBy(F.desc("size"), "root")
    k = sizes.withColumn("k", F.row_number().over(w))
    g = k.groupBy(window).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("groups"), F.max("size").alias("largest"), F.sum(F.when(F.col("k") <= 3, F.col("size"))).alias("top3"))
    return g.select(window, "n", "groups", (F.col("n") - F.col("groups")).alias("redundancy"), (F.col("top3") / (F.col("n") + DAMPING)).alias("concentration"), "largest")


def impact_score(redundancy: Column, largest: Column, n: Column) -> Column:
    return F.least(F.lit(100.0), 10 * (redundancy / 10) * (1 + F.coalesce(F.try_divide(largest, n), F.lit(0.0))))


def perceptual_hash(gray: np.ndarray) -> str:
    """256 bits of an image of grey values as 64 hexadecimal digits: signs of its lowest 16 x 16 cosine coefficients
    against their median. Images that differ by noise, brightness or size differ in few bits."""
    side = 64

    def shares(n: int) -> np.ndarray:
        """The share of each of n pixels in each of `side` equal cells."""
        edge, pixel = np.arange(side + 1) * n / side, np.arange(n)
        cover = np.minimum(edge[1:, None], pixel[None, :] + 1) - np.maximum(edge[:-1, None], pixel[None, :])
        return np.maximum(cover, 0) * side / n

    small = shares(gray.shape[0]) @ gray.astype(float) @ shares(gray.shape[1]).T
    k = np.arange(16)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(side)[None, :] + 1) / (2 * side))
    low = (basis @ small @ basis.T).ravel()
    bits = low > np.median(low[1:])  # the mean brightness says nothing
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def hash_images(df: DataFrame, content: str, decode: Callable[[bytes], np.ndarray], out: str = "h") -> DataFrame:
    """df with the perceptual hash of each image, in Arrow batches.

    decode: from the stored bytes to an array of grey values, such as an image library gives; it goes to the workers.
    Null content, and content that can't be decoded, has a null hash.
    """

    @F.pandas_udf("string")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(b: bytes) -> str | None:
            try:
                gray = np.asarray(decode(bytes(b)))
            except Exception:  # any fault of a stored file
                return None
            return perceptual_hash(gray) if gray.ndim == 2 and gray.size else None

        for s in batches:
            yield s.map(one, na_action="ignore").astype(object)

    return df.withColumn(out, hashes(F.col(content)))


def planted_hash(link: Column, digits: int = 1) -> Column:
    """A stand-in for the hash of an image that isn't there: one of 16 ** digits bases, in which three digits are the link's own.

    Hashes of one base differ in up to twelve bits, so some are near and some are not; equal links have equal hashes.
    """
    own = F.md5(link)
    base = F.sha2(F.substring(own, 1, digits), 256)
    return F.concat(F.substring(base, 1, 20), F.substring(own, digits + 1, 1), F.substring(base, 22, 20), F.substring(own, digits + 2, 1), F.substring(base, 43, 21), F.substring(own, digits + 3, 1))
