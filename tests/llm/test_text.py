import base64
import random
import unicodedata as U

import numpy as np
import pytest

from layerlog.llm import lookalike, mixing, tokens

DOCS = "doc_id long, text string, source string"


def reference(texts):
    import tiktoken

    raw = tokens.read_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [enc.encode_ordinary(t or "") for t in texts]


TEXTS = [None, "", "   ", "\n\n", "Hello  world's  12 a1b2\n\n  x", "<|endoftext|> 'll", "日本語 текст ελ 😂", "a\x1cb\x85c d e　f", "é é ​﻿", "x" * 3000, "word " * 400]


def rows(n=60):
    rnd = random.Random(1)
    return [(i, TEXTS[i] if i < len(TEXTS) else " ".join(rnd.choice(["the", "The", "a", "Ørsted", "12", "don't", "\n"]) for _ in range(rnd.randrange(50))), "s") for i in range(n)]


def test_ids_and_round_trip(spark):
    data = rows() + [(None, "no id", "s"), (3, "again", "s"), (3, "again", "s")]
    df = spark.createDataFrame(data, DOCS)
    got = tokens.encode_corpus(df)
    assert got.columns == ["doc_id", "ids"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((d[0], e) for d, e in zip(data, reference([x[1] for x in data]))), key=key)
    assert sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=key) == want
    back = sorted(((r.doc_id, r.text) for r in tokens.decode_corpus(got).collect()), key=key)
    assert back == sorted(((d[0], d[1] or "") for d in data), key=key)
    assert tokens.encode_corpus(df.limit(0)).count() == 0 and tokens.decode_corpus(got.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 60_000_000, -5]), (None, [0])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode_corpus(odd).collect()} == {1: "", 2: "", 3: "", None: "!"}


def test_blocks_buckets_and_groups(spark):
    data = [d for d in rows() if d[1] is None or len(d[1]) < 2500] + [(900, "w1 w2, " * 400, "s"), (901, "y" * 900, "s")]
    df = spark.createDataFrame(data, DOCS).repartition(3)
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, block_chars=40, part_chars=200, tasks_of_group=1).collect()}
    assert got == dict(zip([d[0] for d in data], reference([d[1] for d in data])))


def test_long_texts_are_cut_at_pretokens(spark):
    text = "".join(random.Random(2).choice(["ab ", "c\n", "  ", "'s", "12"]) for _ in range(2000))
    for size in (1, 7, 100):
        assert [w for p in tokens.parts(text, size) for w in p] == tokens.pretokens(text)
    long_ = "word 12, " * 150_000
    df = spark.createDataFrame([(1, "short", "s"), (2, long_, "s"), (3, "end", "s")], DOCS)
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()}
    assert got == dict(zip((1, 2, 3), reference(["short", long_, "end"])))
    assert {r.doc_id: r.tokens for r in tokens.count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}


def test_splitting_agrees_on_every_character():
    import tiktoken

    raw = tokens.read_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.parse_vocabulary(raw), special_tokens={})
    one = tokens.encoder(raw)
    for start in range(0, 0x20000, 0x400):
        chars = [chr(o) for o in range(start, start + 0x400) if not 0xD800 <= o < 0xE000 and U.category(chr(o)) != "Cn"]
        text = " ".join(f"a{c}1{c}{c} {c}" for c in chars)
        assert [i for w in tokens.pretokens(text) for i in one(w)] == enc.encode_ordinary(text), hex(start)


# --- look-alikes ------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def letters(spark):
    return lookalike.confusables(spark)


@pytest.fixture(scope="module")
def t(letters):
    return lookalike.transducer(letters)


def test_one_form(t):
    base = "Señor café Bravo's fine-print 12 K"
    variants = [
        U.normalize("NFD", base), base.replace(" ", " "), base.replace("a", "а").replace("o", "ο"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in base), base.replace("fi", "ﬁ"), base.replace("-", "‑"),
        base.replace("r", "r​"), base.replace("e", "𝖾"), base.replace("K", "K"), "﻿" + base, U.normalize("NFD", base).replace("́", "‍́"), base.replace("f", "f­"),
    ]
    assert {t(v) for v in variants} == {t(base)} == {base}
    different = [base.upper(), base.replace("12", "13"), base.replace("é", "e"), base.replace(" ", "  "), base.replace(" ", "\n"), base.replace("2", "²")]
    assert len({t(v) for v in different} | {t(base)}) == len(different) + 1
    assert t("ё") == t("ë") and t("a\r\nb") != t("a\nb") and t("") == ""


def test_letters_that_act_as_marks(t):
    for half, full in {"ｶﾞ": "ガ", "ﾊﾟﾋﾞｮﾝ": "パビョン", "ｶ\u200bﾞ": "ガ", "ｳﾞ x": "ヴ x", "ｱﾞ": "ア\u3099"}.items():
        assert t(half) == t(full) == t(t(half)) == full, ascii(half)
    assert t(U.normalize("NFD", "각 가")) == t("각 가") == "각 가"
    assert t("ﾡￂ") == "ㄱㅏ" != t("가")
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice("ｶﾊﾞﾟカはガ각\u1100\u1161\u11a8ﾡￂeé\u0301\u0316\u3099\u200b \n") for _ in range(rnd.randrange(1, 9)))
        assert t(t(text)) == t(text) == t(U.normalize("NFD", text)) == t(U.normalize("NFC", text)), ascii(text)


def test_table_is_closed(t):
    rnd = random.Random(0)
    pool = [*t.table, "e", "a", "́", "̧", "и", "\n", " "]
    for _ in range(3000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 9)))
        assert t(t(text)) == t(text), ascii(text)
        assert t(U.normalize("NFD", text)) == t(text) == t(U.normalize("NFC", text)), ascii(text)


def test_all_scripts_and_planes(t):
    assert t("丽") == t("丽") == "丽" and t("𝒜ＡAА") == "AAAA" and t("ՕᎪꓐ") == "OAB" and t("1∕2") == "1/2"
    for a, b in (("ı", "i"), ("α", "a"), ("г", "r"), ("ɑ", "a"), ("0", "O"), ("1", "l"), ("ё", "е"), ("–", "-")):
        assert t(a) != t(b)


def test_readable_text_follows_from_the_key(t, letters):
    back = lookalike.readable(letters)
    for text in ("Москва — столица России", "в том, что я", "Ёлка и ещё", "Αθήνα είναι", "Latin Москва word", "Українська мова і ліс"):
        assert back(t(text)) == U.normalize("NFC", text), text
    assert back(t("Mocквa")) == back(t("Москва")) == "Москва" and back(t("сору")) == "copy"
    rnd = random.Random(5)
    for _ in range(500):
        text = "".join(rnd.choice("аоcсxхМM влaΑAω é.") for _ in range(12))
        assert t(back(t(text))) == t(text)


def test_pairs(spark, t):
    texts = ["cafe", "саfe", "cafe", "ｃａｆｅ", "café", "café", None, "", "​", " ", " ", "CAFE", "alone"]
    data = [(i, x, "s") for i, x in enumerate(texts)] + [(3, "ｃａｆｅ", "s"), (None, "cafe", "s")]
    df = spark.createDataFrame(data, DOCS)
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and texts[i] != texts[j] and t(texts[i]).strip() and t(texts[i]) == t(texts[j])}
    got = [tuple(r) for r in lookalike.lookalike_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want) == 6
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0
    classes = {r.doc_id: (r.class_id, r.text_id) for r in lookalike.lookalike_classes(df).collect()}
    assert {(i, j) for i in classes for j in classes if i < j and classes[i][0] == classes[j][0] and classes[i][1] != classes[j][1]} == want
    assert {r.doc_id: r.text for r in lookalike.consistent(df.where("doc_id is not null")).collect()}[1] == "cafe"


# --- mixing -----------------------------------------------------------------------------------------------------------------------------------


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 200))
        p, x = np.full(n, rng.random()), rng.integers(1, 500, n).astype(float)
        q = mixing.flight(p, x, rng.random(n + 1))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * x).sum() - (p * x).sum()) < 1e-4 * x.sum()
        z = mixing.land(q, x)
        assert set(z) <= {0.0, 1.0} and abs((z * x).sum() - (p * x).sum()) <= 2 * x.max()


def test_shares():
    plan = mixing.plan_shares({"a": 1000, "b": 100, "c": 50}, {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 6), "none": (0.1, 2)})
    total = sum(plan[s] * n for s, n in (("a", 1000), ("b", 100), ("c", 50)))
    assert all(abs(plan[s] * n / total - w) < 1e-9 for s, n, w in (("a", 1000, 0.5), ("b", 100, 0.3), ("c", 50, 0.2)))
    assert plan["a"] <= 1 and plan["b"] <= 4 + 1e-9 and plan["c"] <= 6 + 1e-9 and mixing.plan_shares({}, {"a": (1.0, 1)}) == {}


@pytest.mark.parametrize("block", [50, 2000])
def test_mixture(spark, block):
    rnd = random.Random(3)
    data = [(i, "word " * rnd.randrange(1, 60), rnd.choice(["a"] * 8 + ["b"] * 2 + ["c", None, "other"])) for i in range(900)] + [(5000, None, "a"), (5001, "", "b"), (5002, "w w", "b"), (5002, "w w", "b")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(spark.createDataFrame(data, DOCS), targets, block=block)
    out = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    for s, w, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)):
        assert abs(out[s].actual_share - w) < 0.01 and 0 < out[s].most_copies <= cap
    assert out["absent"].tokens == 0 == out["absent"].spread_share and abs(out["a"].spread_share - 0.5) < 1e-9 and {r.source for r in mixed.select("source").distinct().collect()} == {"a", "b", "c"}
    assert mixing.mixture(spark.createDataFrame(data, DOCS).limit(0), targets).count() == 0
