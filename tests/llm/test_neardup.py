"""Problem 3: recall against brute force, dense regions, copies, edge cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import neardup, queries_groups
from tidemark.sources.tables import table


def jaccard(a, b):
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def test_shingles_are_exact():
    t = "鲸歌云旅🐋abcabc" * 3
    assert len(neardup.shingles(t)) == len({t[i : i + 3] for i in range(len(t) - 2)})
    assert len(neardup.shingles("ab")) == 0 and len(neardup.word_shingles("")) == 0
    assert len(neardup.word_shingles("a b c d e f")) == 2


def test_query_equals_brute_force(spark, data):
    rows = {r[0]: r[1] for r in table(spark, data, "merged_post").select("post_id", "text").where("char_length(text) >= 20").distinct().collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(rows), 2) if jaccard(rows[a], rows[b]) >= 0.6 - 1e-12}
    got = [tuple(r) for r in queries_groups.p3_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    from tests.compare import connect, sql_rows

    assert set(sql_rows(connect(data), queries_groups.ORACLES["p3_found"])[1]) == want


def _edited(rng, t, edits):
    t = list(t)
    for _ in range(edits):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice([[], [t[i], chr(0x4E00 + rng.randrange(2000))], [chr(0x4E00 + rng.randrange(2000))]])
    return "".join(t)


def keyed(spark, rows):
    """Texts with their numbers as binary keys, beside clashing columns."""
    return spark.createDataFrame([(i.to_bytes(4, "big"), t, "x") for i, t in rows], "n binary, txt string, sketch string")


def numbers(pairs):
    return {tuple(int.from_bytes(r[c], "big") for c in ("a", "b")) for r in pairs.collect()}


@pytest.mark.parametrize("hot,sampled", [(10**9, 1 / 1024), (40, 1.0), (10, 1.0), (60, 0.5)])
def test_a_dense_region_is_compared_whole(spark, hot, sampled):
    """Hundreds of variants of one text agree in most values, so their regions are dense at every depth.

    In one task, or spread over orders and blocks before the shuffle: the pairs are the same.
    """
    rng = random.Random(3)
    base = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(120))
    texts = sorted({_edited(rng, base, 2) for _ in range(150)} | {"".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(60)) for _ in range(50)})
    df = keyed(spark, [*enumerate(texts), (9000, None), (9001, "ab")])
    got = numbers(neardup.near_pairs(df, "n", "txt", 0.6, region=8, hot=hot, sampled=sampled))
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if jaccard(a, b) >= 0.6}
    assert got <= want and len(got) >= 0.999 * len(want) and len(want) > 5000


def test_word_shingles_at_the_usual_threshold(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(300)]
    near = base[:]
    near[10] = "other"
    df = keyed(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(rng.choice(words) for _ in range(300)))])
    assert numbers(neardup.near_pairs(df, "n", "txt", 0.8, shingle=neardup.word_shingles)) == {(1, 2)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "one text alone that is long enough")]])
def test_nothing_to_pair(spark, rows):
    df = keyed(spark, rows)
    assert neardup.near_pairs(df, "n", "txt", 0.6).count() == 0


def test_very_long_text(spark):
    a = "".join(chr(0x4E00 + i * 7 % 3000) for i in range(120_000))
    df = keyed(spark, [(1, a), (2, a + "end")]).withColumn("extra", F.lit(1))
    assert neardup.near_pairs(df, "n", "txt", 0.6).count() == 1


def test_shingles_of_a_batch_are_those_of_each_text():
    texts = ["abcd", "", "x", "鲸歌云旅🐋", "ab", "aaaaa", "abc"]
    flat, count = neardup._batch_shingles(texts, neardup.shingles)
    at = 0
    for t, n in zip(texts, count):
        assert sorted(set(flat[at : at + n].tolist())) == neardup.shingles(t).tolist()
        at += n
    assert at == len(flat)


def test_hot_text_and_groups(spark, tmp_path):
    """A text that a third of all posts share is paired in blocks; groups hold each post once."""
    rng = random.Random(5)
    hot = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(60))
    near = [_edited(rng, hot, 1) for _ in range(3)]
    rows = [(f"{i:04}", hot) for i in range(40)] + [(f"{100 + i:04}", t) for i, t in enumerate(near)] + [(f"{200 + i:04}", "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(40))) for i in range(60)]
    rows += [rows[0], ("0300", None), ("0301", "short"), (None, hot)]
    spark.createDataFrame(rows, "post_id string, text string").write.parquet(f"{tmp_path}/merged_post.parquet")
    block, queries_groups.BLOCK = queries_groups.BLOCK, 7
    try:
        got = [tuple(r) for r in queries_groups.p3_found(spark, str(tmp_path)).collect()]
    finally:
        queries_groups.BLOCK = block
    texts = {i: t for i, t in rows if i and t and len(t) >= 20}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if jaccard(texts[a], texts[b]) >= 0.6}
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r["post_id"]: r for r in queries_groups.p3_groups(spark, str(tmp_path)).collect()}
    assert set(groups) == set(texts)
    assert all(groups[a]["group_id"] == groups[b]["group_id"] for a, b in want)
    assert groups["0005"]["group_id"] == "0000" and groups["0005"]["n_copies"] == 40 and groups["0205"]["group_id"] == "0205"
    linked = {(a, b) for a, b in want if texts[a] != texts[b] and "0039" in (a, b)}
    assert groups["0039"]["n_links"] == len(linked)
