"""Problems 7, 8 and 9: exact ids, whole packing, exact pieces, edge cases."""

import base64
import os
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import bpe, packing, queries_tokens, splitting
from tidemark.sources.tables import table

FILE = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizers here")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Merges(FILE))


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    lines = open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read().splitlines()
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})


def split(ids, n):
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_ids_equal_a_reference(encoder, reference):
    rng = random.Random(1)
    alphabet = "abAB01 \n\t.,'鲸歌éß🐋​\x00ا"
    texts = ["", None, "a", "<|endoftext|>", " " * 50, "'s don't", "x" * 50_000, "ab" * 20_000, "鲸" * 30_000, "aaab" * 999, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(400))]
    ids, n = encoder.encode(texts)
    assert split(ids, n) == [reference.encode_ordinary(t) if t else [] for t in texts]
    assert encoder.count(texts).tolist() == n.tolist()


def test_chunks_do_not_change_ids(encoder, reference, monkeypatch):
    texts = [f"word{i} 鲸歌{i}" * 3 for i in range(300)]
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 100)
    ids, n = encoder.encode(texts)
    assert split(ids, n) == [reference.encode_ordinary(t) for t in texts]


def test_query_ids(spark, data, reference):
    rows = queries_tokens.p7_ids(spark, data).collect()
    text = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").select("doc_id", "text").collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {k: reference.encode_ordinary(t) if t else [] for k, t in text.items()}
    assert len(rows) == len(text)


def test_encode_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, ids string")
    assert bpe.encode_column(df, "doc_id", "text").count() == 0
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a", "z")], "doc_id bigint, text string, ids string")
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in bpe.encode_column(df, "doc_id", "text").collect()) == [("1", []), ("2", []), ("2", []), ("None", [64])]


def check_packing(rows, items, budgets):
    for b, capacity in budgets:
        mine = [r for r in rows if r["budget_id"] == b]
        space = defaultdict(int)
        for r in mine:
            assert (r["container_id"] is None) == (r["size"] == 0)
            space[r["container_id"]] += r["size"]
        space.pop(None, None)
        assert max(space.values(), default=0) <= capacity
        total, parts = defaultdict(int), defaultdict(list)
        for r in mine:
            total[r["key"]] += r["size"]
            parts[r["key"]].append((r["offset"], r["size"]))
        want = defaultdict(int)
        for k, s in items:
            want[k] += s or 0
        assert dict(total) == dict(want)
        count = defaultdict(int)
        for k, _ in items:
            count[k] += 1
        for k, s in items:
            if count[k] == 1 and (s or 0) <= capacity:
                assert len(parts[k]) == 1  # never split unless it alone exceeds the capacity
    return space


@pytest.mark.parametrize("per_part,windows", [(10**6, 64), (20, 4)])
def test_packing(spark, per_part, windows):
    rng = random.Random(per_part)
    items = [(f"k{i}", rng.choice([0, None, 3, 10, 33, 50, 99, 100, 101, 257, 1000])) for i in range(400)]
    items += [("same", 60), ("same", 60), ("same", 300), ("same", 300), (None, 7)]
    df = spark.createDataFrame([(k, s, 1) for k, s in items], "key string, size bigint, container_id int")
    budgets = [(1, 100), (2, 500)]
    rows = packing.pack(df, budgets, open_windows=windows, items_per_partition=per_part).collect()
    space = check_packing(rows, items, budgets)
    assert sum(space.values()) / (len(space) * 500) > 0.9


def test_packing_empty(spark):
    df = spark.createDataFrame([], "key string, size bigint")
    assert packing.pack(df, [(1, 100)]).count() == 0
    assert packing.pack(spark.createDataFrame([("a", 1)], "key string, size bigint"), []).count() == 0


def test_packing_query(spark, data, reference):
    rows = queries_tokens.p8_containers(spark, data).collect()
    items = [(r["doc_id"], len(reference.encode_ordinary(r["text"])) if r["text"] else 0) for r in table(spark, data, "documents").collect()]
    budgets = [(r["budget_id"], r["capacity"]) for r in table(spark, data, "token_budgets").where("purpose = 'container'").collect()]
    check_packing([{"budget_id": r["budget_id"], "container_id": r["container_id"], "key": r["doc_id"], "size": r["n_tokens"], "offset": r["token_offset"]} for r in rows], items, budgets)


def test_pieces(spark, data, reference):
    texts = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}
    budgets = {r["budget_id"]: (r["capacity"], r["overlap"]) for r in table(spark, data, "token_budgets").where("purpose = 'piece'").collect()}
    by = defaultdict(list)
    for r in queries_tokens.p9_pieces(spark, data).collect():
        by[r["budget_id"], r["doc_id"]].append(r)
    tokens = {k: len(reference.encode_ordinary(t)) if t else 0 for k, t in texts.items()}
    assert set(by) == {(b, k) for b, (c, _) in budgets.items() for k, n in tokens.items() if n > c}
    natural = cuts = 0
    for (b, k), pieces in by.items():
        capacity, overlap = budgets[b]
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert pieces[0]["token_start"] == 0 and pieces[-1]["token_end"] == tokens[k]
        for p in pieces:
            assert 0 < p["n_tokens"] == p["token_end"] - p["token_start"] <= capacity
            assert p["text"] == texts[k][p["char_start"] : p["char_end"]]
        for p, q in zip(pieces, pieces[1:]):
            assert overlap <= p["token_end"] - q["token_start"] <= overlap + 8
            assert q["char_start"] <= p["char_end"]
            natural += p["text"][-1] in "。！？!?…\n " or p["text"].rstrip()[-1:] in "。！？!?….,，、"
            cuts += 1
    assert natural / cuts > 0.6


def test_pieces_of_hard_texts(encoder):
    size = encoder.merges.id_bytes()
    for t in ("x" * 5000, "鲸" * 3000, "🐋" * 500, "\n" * 700, "一句话。" * 900, "a b " * 2000):
        ids, _ = encoder.encode([t])
        for capacity, overlap in ((128, 16), (5, 0), (5, 4), (1, 0)):
            p = splitting.Cutter(t, ids, size).pieces(capacity, overlap)
            assert p[0][0] == 0 and p[-1][1] == len(ids) and all(0 < e - s <= capacity for s, e in p) and all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(p, p[1:]))


def test_valleys_lie_between_topics():
    a, b = "潮声口琴冰语提灯。" * 8, "scores and windows of a series. " * 8
    t = a + b
    ends = np.array([i + 1 for i, ch in enumerate(t) if ch in "。."])
    depth = splitting.valley_depths(np.array(list(map(ord, t)), np.uint32), ends)
    assert int(np.argmax(depth)) == 7


def test_pieces_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id bigint, text string")
    assert splitting.split_column(df, "doc_id", "text", [(4, 128, 16)]).count() == 0
    assert splitting.split_column(df.where("false"), "doc_id", "text", [(4, 128, 16)]).count() == 0


@pytest.mark.parametrize("change", [{"pre_tokenizer": None}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "use_regex": False}}])
def test_other_vocabularies_are_refused(tmp_path, change):
    """A file that would be encoded in another way raises instead of giving wrong ids."""
    import json

    file = json.loads(open(f"{bpe.TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8").read())
    (tmp_path / "x.json").write_text(json.dumps(file | change))
    with pytest.raises(ValueError):
        bpe.Merges(str(tmp_path / "x.json"))
    with pytest.raises(ValueError):
        bpe.Merges(f"{bpe.TOKENIZERS}/word_bpe_49k.json")


def test_planted_topic_changes_are_found(data, spark):
    """Where two documents are joined, the deepest valley of a window lies there far more often than a random border."""
    import numpy as np

    rng = np.random.default_rng(1)
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").where("length(text) between 1500 and 20000").collect()]
    ends_of = lambda t: [*(e for e in (m.end() for m in splitting._UNIT.finditer(t)) if e < len(t)), len(t)]
    hit = chance = n = 0
    for _ in range(300):
        a, b = (texts[i] for i in rng.choice(len(texts), 2, replace=False))
        ea, eb = ends_of(a), ends_of(b)
        k = min(len(ea), len(eb), int(rng.integers(8, 40)))
        if k < 8:
            continue
        t, at = a[: ea[k - 1]] + b[: eb[k - 1]], ea[k - 1]
        ends = np.array(ends_of(t))
        depth = splitting.valley_depths(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), ends)
        true = int(np.searchsorted(ends, at))
        lo, hi = max(0, true - len(ends) // 4), min(len(ends) - 1, true + len(ends) // 4)
        hit, chance, n = hit + (lo + int(np.argmax(depth[lo:hi])) == true), chance + 1 / (hi - lo), n + 1
    print(f"planted changes found: {hit / n:.3f}, by chance {chance / n:.3f}, of {n}")
    assert n > 30 and hit / n > 3 * chance / n


def test_valleys_do_not_depend_on_the_pieces_they_are_computed_in(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    t = "".join("".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 60, int(k))) + "。" for k in rng.integers(1, 30, 300))
    points, ends = np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([m.end() for m in splitting._UNIT.finditer(t)])
    whole = splitting.valley_depths(points, ends)
    monkeypatch.setattr(splitting, "_GAPS", 7)
    assert np.allclose(splitting.valley_depths(points, ends), whole) and len(whole) == len(ends) - 1
