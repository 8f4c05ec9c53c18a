"""Problem 5: equal looks get one form, other differences stay; pairs equal brute force."""

import itertools

import pytest

from tidemark.llm import canonical as c

SAME = [
    ("ＡＢＣ１２３！", "ABC123!"),
    ("été", "été"),
    ("whale​song­", "whalesong"),
    ("a b　c d", "a b c d"),
    ("Теlіа", "Telia"),
    ("ｶﾞｷﾞ", "ガギ"),
    ("ガ", "ガ"),
    ("⾦⽊", "金木"),
    ("更", "更"),
    ("x‐y‑z⁃w－v", "x-y-z-w-v"),
    ("Νοrа", "Nora"),
    ("a\r\nb", "a\nb"),
]
OTHER = [("Ab", "ab"), ("été", "ete"), ("a  b", "a b"), ("国", "國"), ("a\nb", "a b"), ("l", "I"), ("0", "O"), ("パ", "バ"), ("。", "！"), ("①", "1"), ("x²", "x2"), ("ー", "一")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    k = c.Canonicalizer([("Nora", 3), ("Телиа", 2), ("ете", 1)])
    assert c.by_table(a) == c.by_table(b) and k.text(a) == k.text(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(a, b):
    k = c.Canonicalizer([])
    assert c.by_table(a) != c.by_table(b) and k.text(a) != k.text(b)


def test_automaton_finds_the_vocabulary_spelling():
    k = c.Canonicalizer([("жизнь", 9), ("whale", 5)])
    assert k.token("whаle") == "whale"
    assert k.text("жизнь") == k.text("жизнь​") == "жизнь"
    assert k.trie.canonical("unknown") is None
    assert k.text("x" * 300_000) == "x" * 300_000 and k.text("") == "" and k.text(None) is None


def test_the_trie_decides_the_spelling():
    """Words whose look isn't plain come out in the corpus's spelling: the table alone would leave mixed letters."""
    k = c.Canonicalizer([("хорошо", 9), ("金木", 3), ("日本", 2)])
    assert c.by_table("хорошо") != "хорошо" == k.text("хорошо") == k.text("xо\u200bpошо") == k.text("хо\u00adрошо")
    assert k.settled == {"trie": 3, "table": 0}
    assert k.text("\u2fa6\u200b木\u200b日本，木") == "金木日本,木"
    assert k.settled["trie"] == 5 and k.settled["table"] == 1  # the last 木 is no entry
    assert c.LookTrie([]).canonical("хорошо") is None


def test_looks_out_of_order_reach_the_same_spelling():
    """Marks stored in another order miss the walk, and the table brings them to the entry all the same."""
    word = "хậш"
    k = c.Canonicalizer([(word, 5)])
    for other in ("хa\u0323\u0302ш", "хa\u0302\u0323ш", "x\u00e2\u0323ш"):
        assert k.text(other) == k.text(word) and c.by_table(other) == c.by_table(word)


def test_other_edits_cost():
    t = c.LookTrie([("whale", 5), ("while", 4), ("金木", 2)])
    assert t.nearest("wh\u200bаle", 0) == [(0, "whale")]
    assert t.nearest("whle", 1) == [(1, "whale"), (1, "while")]
    assert t.nearest("whxle", 1) == [(1, "whale"), (1, "while")]
    assert t.nearest("whalee", 1) == [(1, "whale")] and t.nearest("shell", 1) == []


def test_most_tokens_are_settled_by_the_trie(data, spark):
    from tidemark.sources.tables import table

    df = table(spark, data, "merged_post").select("text").where("text is not null").distinct()
    k = c.Canonicalizer(c.vocabulary(df, "text"))
    odd = 0
    for r in df.collect():
        before = k.settled["trie"]
        assert c.by_table(k.text(r["text"])) == c.by_table(r["text"])
        odd += k.settled["trie"] > before and c.by_table(r["text"]) != r["text"]
    share = k.settled["trie"] / sum(k.settled.values())
    print(f"settled by the trie: {share:.3f} of {sum(k.settled.values())} tokens; {odd} texts with look-alikes")
    assert share > 0.7 and odd > 0


def test_pairs_equal_brute_force(spark):
    texts = [a for p in SAME for a in p] + [a for p in OTHER for a in p] + ["Telia", None, "", "好看", "好看​", "好‌看"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y")]  # a redelivered row
    df = spark.createDataFrame(rows, "rec int, txt string, canonical string")  # a clashing name
    got = {(r["id_a"], r["id_b"]) for r in c.lookalike_pairs(c.looks_of(c.canonicalize(df, "txt"), "rec", "txt", "canonical"), block=2).collect()}
    ids = {str(i): t for i, t, _ in rows if t is not None}
    want = {(a, b) for a, b in itertools.combinations(sorted(ids), 2) if ids[a] != ids[b] and c.by_table(ids[a]) == c.by_table(ids[b])}
    assert got == want and want


def test_empty_table(spark):
    df = spark.createDataFrame([], "rec int, txt string")
    assert c.canonicalize(df, "txt").count() == 0
    rows = c.looks_of(c.canonicalize(df, "txt"), "rec", "txt", "canonical")
    assert c.lookalike_pairs(rows).count() == 0 and c.look_classes(rows).count() == 0


def test_query_equals_brute_force(spark, data):
    from tidemark.llm.queries_text import p5_found
    from tidemark.sources.tables import table

    got = {tuple(r) for r in p5_found(spark, data).collect()}
    want = set()
    for name, key, text in (("merged_post", "post_id", "text"), ("df_sentences", "sentence_id", "sentences")):
        by: dict[str, set] = {}
        for r in table(spark, data, name).select(key, text).where(f"{text} is not null").distinct().collect():
            by.setdefault(c.by_table(r[1]), set()).add((str(r[0]), r[1]))
        for g in by.values():
            want |= {(name, *sorted((a[0], b[0]))) for a, b in itertools.combinations(g, 2) if a[1] != b[1]}
    assert got == want
    from tidemark.llm.queries_text import p5_classes

    rows = p5_classes(spark, data).collect()
    by = {(r["table_name"], r["rec_id"]): r["class_id"] for r in rows}
    assert all(by[t, a] == by[t, b] for t, a, b in want)
    assert sum(r["n_spellings"] > 1 for r in rows) == len({(t, x) for t, a, b in want for x in (a, b)})
