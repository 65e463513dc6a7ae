import os
import random
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import bpe, frequent, language, leaks, lookalike, multires, scans, subjects, textual, visitors
from quirelake.llm.queries import BYTE_BPE_PATTERN, tokenizer_file

VIEWS = "id int, a string, b string, extra int, k string"


# ---- frequent values ----------------------------------------------------------------------


def test_code_words_survive_two_errors():
    random.seed(3)
    for _ in range(40):
        fp = random.getrandbits(64)
        word = frequent.encode(np.array([fp], np.uint64))[0]
        for half in range(2):
            part = word[half * 12 : half * 12 + 12].copy()
            margin = np.ones(12)
            for i in random.sample(range(12), 2):
                part[i] ^= random.randrange(1, 16)
            data = frequent._decode_half(part, margin)
            assert data == list(word[half * 12 : half * 12 + 8])


def test_frequent_matches_counting(spark):
    random.seed(4)
    values = [f"v{int(random.paretovariate(0.7))}" for _ in range(3000)]
    data = [(i, v, None if i % 3 else "x" if i % 2 else "", i, "same") for i, v in enumerate(values)]
    data += data[:400] + [(None, "v1", "x", 0, "k"), (None, "v1", "x", 0, "k")]
    df = spark.createDataFrame(data, VIEWS)
    distinct = [*{(r[0], r[1]) for r in data if r[0] is not None}, (None, "v1"), (None, "v1")]
    n = {v: sum(1 for _, x in distinct if x == v) for v in {x for _, x in distinct}}
    want = {("a", v, c) for v, c in n.items() if c >= 0.01 * len(distinct)}
    got = {(r["field"], r["item"], r["n"]) for r in frequent.frequent(df, ["a", "b"], 0.01, "id").collect()}
    assert {g for g in got if g[0] == "a"} == want
    assert {g[1] for g in got if g[0] == "b"} == {"x"}


@pytest.mark.parametrize("share", [0.01, 0.001, 0.0001])
def test_all_values_at_the_border_are_decoded(share):
    rng = np.random.default_rng(8)
    groups, n = frequent.groups_for(share), round(1 / share)
    fps = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    counts = np.zeros((frequent.REPEATS, groups, frequent.POSITIONS, frequent.SYMBOLS), np.int32)
    code = frequent.encode(fps)
    for r in range(frequent.REPEATS):
        np.add.at(counts[r], (frequent.group_of(fps, r, groups)[:, None], np.arange(frequent.POSITIONS), code), 50)
    assert set(frequent.decode(counts, 45.0)) == set(fps.tolist())


def test_frequent_at_a_small_share(spark):
    # a thousand values on exactly the share, and as many rows of values seen once
    half = spark.range(200_000).select("id", F.concat(F.lit("v"), F.col("id") % 1000).alias("a"))
    rest = spark.range(200_000).select((F.col("id") + 500_000).alias("id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("a"))
    got = {r["item"]: r["n"] for r in frequent.frequent(half.unionAll(rest), ["a"], 0.0005, "id").collect()}
    assert got == {f"v{i}": 200 for i in range(1000)}
    with pytest.raises(ValueError):
        frequent.frequent(half, ["a"], 0.00001, "id")


def test_frequent_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "", 0, "k")], VIEWS)
    assert frequent.frequent(df, ["a", "b"]).count() == 0
    assert frequent.frequent(df.limit(0), ["a", "b"]).count() == 0


# ---- distinct counts ----------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 100, 3000, 60_000])
def test_estimates_within_bound_and_merge(spark, n):
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("who"))
    df = df.unionAll(df).unionAll(spark.createDataFrame([(0, None), (1, "")], "g long, who string"))
    parts = multires.sketch(df, ["g"], "who")
    merged = multires.merge(parts.withColumn("all", F.lit("*")), ["all"])
    whole = [r["estimate"] for r in multires.estimate(merged, ["all"]).collect()]
    assert (whole == [] and n == 0) or abs(whole[0] - n) <= max(1.5, 4 * multires.error_bound() * n)


def test_crowded_cells(spark):
    at = F.timestamp_seconds(F.lit(86400)).cast("timestamp_ntz")
    views = spark.range(200).select("id", F.when(F.col("id") < 100, "FR").alias("country"), F.concat(F.lit("v"), (F.col("id") % 10).cast("string")).alias("visitor_hash"), at.alias("created_at"))
    views = views.unionAll(views.limit(50))
    downloads = spark.range(40).select(F.col("id"), F.lit("FR").alias("country"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("visitor_hash"), at.alias("created_at"))
    got = {tuple(r) for r in visitors.crowded_cells(views, downloads).collect()}
    # FR: 50 visitors of 100 views; none: 10 of 100; all: 50 of 200
    assert got == {("1970-01-02", "")}
    assert visitors.crowded_cells(views.limit(0), downloads.limit(0)).count() == 0
    cells = {r["country"]: (r["visitors"], r["settled_by"]) for r in visitors.settled_cells(views, downloads).collect()}
    assert cells["*"] == (50.0, "exact") and cells["FR"][1] == cells[""][1] == "bitmap"


# ---- tokens -------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def ranks():
    file = tokenizer_file("byte_bpe_50k.tiktoken")
    if not os.path.exists(file):
        pytest.skip("no vocabulary here")
    with open(file, "rb") as f:
        return bpe.load_ranks(f.read())


def test_bpe_equals_public_library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Encoder(ranks, BYTE_BPE_PATTERN)
    random.seed(5)
    letters = string.ascii_letters + "  \n'.,0123éüЖ中‍"
    texts = ["", "a" * 5000, " " * 777, "<|endoftext|>", "it's  we'll\n\n x"] + ["".join(random.choices(letters, k=200)) for _ in range(60)]
    assert [mine(t) for t in texts] == [theirs.encode_ordinary(t) for t in texts]
    for _ in range(80):
        word = "".join(random.choices("aeionrst", k=random.randint(2, 90))).encode()
        assert bpe.merge_scan(word, ranks) == bpe.merge_heap(word, ranks)


def test_encode_corpus_nulls(spark, ranks):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello world", 0)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_corpus(df, "doc_id", "text", tokenizer_file("byte_bpe_50k.tiktoken"), BYTE_BPE_PATTERN).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 2
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text", tokenizer_file("byte_bpe_50k.tiktoken"), BYTE_BPE_PATTERN).count() == 0


# ---- look-alikes --------------------------------------------------------------------------


@pytest.mark.parametrize(
    "odd,want",
    [
        ("thе mоdel", "the model"),
        ("ｔｅｘｔ", "text"),
        ("modiﬁca la", "modifica la"),
        ("café", "café"),
        ("in­vi​si⁠ble﻿", "invisible"),
        ("и cтрaница ещё", "и страница ещё"),
        ("written λ in the margin", "written λ in the margin"),
        ("508 m² – “nearly” n’est", "508 m² – “nearly” n’est"),
        ("Мы нашли мяч in the hall", "Мы нашли мяч in the hall"),
        ("  Padded\nLine ", "  Padded\nLine "),
    ],
)
def test_plain(odd, want):
    assert lookalike.plain(odd) == want


def test_trie_costs():
    trie = lookalike.Trie()
    for w, n in (("cop", 5), ("сор", 2), ("cup", 9)):
        trie.add(w, n)
    assert {(w, c) for w, _, c in trie.reach("сop")} == {("cop", 0), ("сор", 0)}
    assert {(w, c) for w, _, c in trie.reach("c​op", 1)} == {("cop", 0), ("сор", 0), ("cup", 1)}


def test_canonical_values(spark):
    corpus = spark.createDataFrame([("сор на полу и the cop saw a cup",), (None,), ("cop cop",)], "text string")
    rows = [("q", "1", "see сор here", 0, 12), ("q", "1", "see сор here", 0, 12), ("q", "2", None, 0, 0), ("q", "3", "", 0, 0), ("q", "4", "plain", 0, 5), ("m", "5", "befоre Wоrd after", 7, 4)]
    values = spark.createDataFrame(rows, "field string, row_key string, whole string, skip int, size int")
    got = {tuple(r) for r in lookalike.canonical_values(values, corpus, shards=4).collect()}
    assert got == {("q", "1", "see cop here"), ("m", "5", "Word")}
    # without the vocabulary the whole-Cyrillic word stays and the table writes the other
    bare = {tuple(r) for r in lookalike.canonical_values(values, corpus.limit(0), shards=4).collect()}
    assert bare == {("m", "5", "Word")}


def test_spelling_comes_from_the_word_reached():
    trie = lookalike.Trie()
    for w, n in (("нос", 4), ("hoc", 1), ("café", 3)):
        trie.add(w, n)
    assert {w for w, _, _ in trie.reach("НОС")} == {"нос", "hoc"}
    assert {w for w, _, _ in trie.reach("нос")} == {"нос"}
    raw = "CAF\u200bE\u0301"
    assert [(w, c) for w, _, c in trie.reach(raw)] == [("café", 0)]
    assert lookalike.plain(f"a {raw} b", spellings={raw: trie.reach(raw)}) == "a CAFÉ b"
    assert lookalike.shard_key("НОС") == lookalike.shard_key("hoc") == lookalike.shard_key("нос")
    assert trie.reach("") == [] and lookalike.Trie().reach("x") == []


# ---- language -----------------------------------------------------------------------------


def test_sentences():
    text = "Title Line\n\nThe first is bro-\nken here. See «la clinique» on shelf 4. An open end"
    assert textual.sentences(text) == ["The first is broken here.", "See   on shelf 4."]


def test_languages(spark):
    en = "The cat sat on the warm mat. The dog was in the house today. "
    fr = "Le chat est sur le tapis rouge. Le chien est dans la maison. "
    rows = [(i, f"/a/f{i % 4}.pdf", en * 2, "eng") for i in range(12)] + [(20 + i, "/b/g.pdf", fr * 2, "fra") for i in range(8)]
    rows += [(50, "/b/g.pdf", fr, "eng"), (51, "/a/f1.pdf", en + fr, "eng"), (52, "/a/f1.pdf", en, None), (53, None, None, "eng"), (54, "/x", "", "und"), (55, "/x", "Heading", "")]
    df = spark.createDataFrame(rows, "page_id long, pdf_path string, text string, lang string")
    seg = language.label_segments(df, ["eng", "fra"])
    got = {tuple(r) for r in language.doubtful_pages(seg).collect()}
    assert got == {(50, "fra"), (51, "eng"), (51, "fra"), (52, "eng")}
    assert language.label_segments(df.limit(0), ["eng", "fra"]).count() == 0


# ---- scans --------------------------------------------------------------------------------


def test_furniture():
    lines = ["[12]", "   Old Title Name", "", "The first running line goes on and on to", "the next line here.", "Page 3 of 40", "Anewline begins after it with words in.", "               - 4 -"]
    assert scans.furniture(lines, set()) == [True, True, False, False, False, True, False, True]


def test_body_joins_across_furniture():
    text = "16      Coach Title\nThe first sentence of it is he-\n\nPage 61 of 126\n\nre. Next one.\n\n   - 3 -"
    assert textual.sentences(scans.body(text)) == ["The first sentence of it is here.", "Next one."]


def test_running_lines():
    tokens, _ = scans.running_lines(["It was dismi=", "ssed by a well-", "known Man."], [False] * 3)
    assert tokens == [["it", "was", "dismi\u0001ssed"], ["by", "a", "well\u0001known"], ["man"]]
    tokens, _ = scans.running_lines(["A ch\u00adim\u200bney on the so\u00ad", "uth side."], [False] * 2)
    assert tokens == [["a", "chimney", "on", "the", "so\u0001uth"], ["side"]]


def test_viterbi_prefers_the_likely_word():
    cells = [[("the", 0.0, 900.0)], [("clog", 0.0, 0.004), ("dog", -8.0, 50.0)], [("sat", 0.0, 40.0)]]
    assert scans.viterbi(cells, {("the", "dog"): 30, ("dog", "sat"): 10}, 1000.0) == ["the", "dog", "sat"]


def test_hashes_are_the_engines(spark):
    rows = [("a", "b"), ("für", "ё" * 40), ("", "x" * 33)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.xxhash64("a").alias("h"), F.xxhash64("a", "b").alias("p")).collect()
    assert all(r["h"] == scans._signed_hash(r["a"]) and r["p"] == scans.pair_hash(r["a"], r["b"]) for r in got)


def test_long_words_meet_by_thirds():
    random.seed(9)
    for _ in range(200):
        word = "".join(random.choices("abcdefghilmnorstuvw", k=random.randint(25, 60)))
        some = scans.sources(word)
        right, how = random.choice(some)
        found = scans.explain(word, right)
        assert found is not None and len(found.split("|")) <= len(how.split("|"))
        assert set(scans.third_keys(word, False)) & set(scans.third_keys(right, True))
    assert scans.explain("uncler", "under") == "cl>d" and scans.explain("abc", "xyz") is None


def test_repair_of_long_words_and_caseless_scans(spark):
    long = "thermodynamicsofpolycrystallines"
    clean = f"The dog has one {long} indeed."
    pages = [(i, f"/c/{i}.pdf", " ".join([clean] * 4)) for i in range(6)]
    pages.append((100, "/s/1.pdf", "The dog has one\n" + long.replace("nam", "narn") + " indeed.\nand more of it"))
    df = spark.createDataFrame(pages, "page_id long, pdf_path string, text string")
    assert {(r["page_id"], r["right"]) for r in scans.repair(df)[2].collect()} == {(100, long)}
    kana = spark.createDataFrame([(1, "/k/1.pdf", "日本語の文\nがここで\n続いている\nものです。"), (2, "/k/2.pdf", "題名\n本文です。")], "page_id long, pdf_path string, text string")
    assert {r["page_id"]: r["scan"] for r in scans.parse(kana).collect()} == {1: True, 2: False}


def test_repair(spark):
    clean = " ".join(["The dog sat under the well-known table and dissolved the river bank."] * 4)
    pages = [(i, f"/c/{i}.pdf", clean) for i in range(12)]
    pages += [(100, "/s/1.pdf", "[1]\nThe dog sat uncler the well-\nknown tab1e and dis-\nsolved the river bank.\n\n      - 1 -"), (101, "/s/1.pdf", None), (102, "/s/1.pdf", "")]
    df = spark.createDataFrame(pages, "page_id long, pdf_path string, text string")
    furniture, split, misread = scans.repair(df)
    assert {tuple(r) for r in furniture.collect()} == {(100, "[1]"), (100, "- 1 -")}
    assert {tuple(r) for r in split.collect()} == {(100, "well-known"), (100, "dissolved")}
    assert {(r["page_id"], r["right"]) for r in misread.collect()} == {(100, "under"), (100, "table")}
    whole = {r["page_id"]: r["text"] for r in scans.readable_pages(df).collect()}
    assert whole[100] == "The dog sat under the well-known table and dissolved the river bank."
    assert whole[3] == clean


def test_repair_knows_words_of_scans(spark):
    line = "la stagione bella era lunga\ne la terra fredda."
    pages = [(i, f"/s/{i}.pdf", line) for i in range(40)]
    pages += [(100, "/s/100.pdf", "la stag1one bella era lunga\ne la terra fredda."), (101, "/s/101.pdf", "la stagione bclla era lunga\ne la terra fredda.")]
    df = spark.createDataFrame(pages, "page_id long, pdf_path string, text string")
    assert {tuple(r) for r in scans.repair(df)[2].collect()} == {(100, "stag1one", "stagione"), (101, "bclla", "bella")}


# ---- leaks --------------------------------------------------------------------------------


def item_text(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choices(string.ascii_lowercase, k=r.randint(2, 9))) for _ in range(n)) + "?"


@pytest.mark.parametrize("blocks,slack", [(4, 0), (6, 1)])
def test_near_finds_all_within_radius(blocks, slack, monkeypatch):
    monkeypatch.setattr(leaks, "EXPAND", 97)
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    index = leaks.MultiIndex(prints, np.arange(300, dtype=np.int32), blocks, slack)
    base = prints[rng.integers(0, len(prints), 200)]
    flipped = base.copy()
    for i in range(len(flipped)):
        for b in rng.choice(64, index.radius + i % 2, replace=False):
            flipped[i] ^= np.uint64(1) << np.uint64(b)
    where, who = index.near(flipped)
    want = {(i, j) for i in range(200) for j in np.flatnonzero(np.bitwise_count(prints ^ flipped[i]) <= index.radius)}
    assert index.radius == (3 if slack == 0 else 11) and len(want) >= 100
    assert set(zip(where.tolist(), who.tolist())) == want


def test_windows_of_each_size_find_their_quotes(spark):
    text = item_text(1)
    words = text.split()
    docs = [(1, f"{item_text(50)} {text} {item_text(51)}"), (2, f"{item_text(52)} {' '.join(words[:36])} {item_text(53)}"), (3, " ".join(words[:17]) + item_text(54) + " ".join(words[17:35]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(1, text)], "item_id long, text string")
    found = {level: {r["doc_id"] for r in leaks.leaks(d, e, levels=(level,)).collect()} for level in leaks.LEVELS}
    assert 1 in found["item"] and {1, 2} <= found["half"] and found["small"] == {1, 2, 3}


def test_short_items_and_long_documents(spark):
    e = spark.createDataFrame([(1, "Zip zap zop!"), (2, "A"), (3, item_text(3))], "item_id long, text string")
    filler = " ".join(item_text(100 + i) for i in range(400))
    docs = [(1, "he said zip-zap"), (2, "nothing"), (3, filler + item_text(3) + filler), (4, "ZIPPY")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in leaks.leaks(d, e).select("doc_id", "item_id").collect()}
    assert got >= {(1, 1), (3, 3), (1, 2), (3, 2)} and (2, 1) not in got and (4, 1) not in got


def test_leaks(spark):
    items = [(i, item_text(i)) for i in range(1, 6)] + [(9, None), (10, ""), (11, item_text(1))]
    words = items[0][1].split()
    half = " ".join(words[:36])
    third = " ".join(words[:18])
    changed = " ".join(w if i % 11 else "other" for i, w in enumerate(items[1][1].split()))
    docs = [(1, f"Intro. {items[0][1].upper()} end"), (2, half), (3, third), (4, f"{' '.join(words[:18])} something between here {' '.join(words[20:40])}"), (5, changed), (6, None), (7, ""), (8, item_text(99)), (9, " ".join(reversed(words)))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, e).collect()}
    assert got == {(1, 1), (2, 1), (4, 1), (5, 2), (1, 11), (2, 11), (4, 11)}
    assert leaks.leaks(d.limit(0), e).count() == 0 and leaks.leaks(d, e.limit(0)).count() == 0


# ---- subjects -----------------------------------------------------------------------------


def test_subjects(spark):
    law, sport = "The court read the verdict near the river.", "The goal was scored before the match at noon."
    docs = [(i, " ".join([law] * 3)) for i in range(8)] + [(10 + i, " ".join([sport] * 3)) for i in range(8)]
    docs += [(30, law + " " + sport), (31, None), (32, "  "), (33, " "), (34, "- verdict, court\n- verdict\n- goal")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "law") for i in range(6)] + [(10 + i, "sport") for i in range(6)] + [(0, "law"), (30, "law"), (30, "sport"), (99, "law"), (1, None)], "doc_id long, subject string")
    got = {tuple(r) for r in subjects.subjects(d, labels).select("doc_id", "subject").collect()}
    assert {g for g in got if g[0] < 30} == {(i, "law") for i in range(8)} | {(10 + i, "sport") for i in range(8)}
    assert {g for g in got if g[0] >= 30} == {(30, "law"), (30, "sport"), (34, "law"), (34, "sport")}
    assert subjects.subjects(d, labels.limit(0)).count() == 0


def test_patterns_of_mixed_words_only():
    tree = subjects.PatternTree(2)
    for items, counts in ((("a", "b", "c"), (5, 0)), (("a", "c"), (0, 4)), (("a", "b"), (0, 3)), (("d", "e"), (3, 0))):
        tree.add(items, np.array(counts, float))
    got = {tuple(sorted(w)): tuple(n) for w, n in subjects.grow(tree, list(tree.nodes), 3)}
    # {a, c} is in all entries of c and says no more than c; e is pure; {b, c} is mixed no more
    assert got == {("b", "c"): (5.0, 0.0)}


def test_repeated_long_sentence_is_mined_quickly(spark):
    sentence = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)) + "."
    d = spark.createDataFrame([(i, sentence) for i in range(4)] + [(9 + i, "Goal and match here.") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "law" if i else "sport") for i in range(4)] + [(9 + i, "sport") for i in range(4)], "doc_id long, subject string")
    began = time.time()
    rules, usual = subjects.mine(d, labels)
    assert time.time() - began < 60 and usual == "sport"
    assert {len(r[0]) for r in rules} == {1} and len({r[0] for r in rules}) == 404


def test_every_text_has_a_subject(spark):
    law, sport = "The court read the verdict near the river.", "The goal was scored before the match at noon."
    d = spark.createDataFrame([(i, law if i < 6 else sport) for i in range(10)] + [(20, "Zxq wvu."), (21, "12345"), (22, " \n"), (23, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "law" if i < 6 else "sport") for i in range(10)], "doc_id long, subject string")
    got = {r["doc_id"]: r["subject"] for r in subjects.subjects(d, labels).collect()}
    assert got[20] == got[21] == "law" and 22 not in got and 23 not in got


def test_entry_points():
    import __spark_entry__ as e

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 8, 9)} | {"p7_ids"} <= set(e.queries())
