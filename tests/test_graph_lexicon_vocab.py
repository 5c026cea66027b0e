"""GRP-1..5, AGG-2..4, LEX-1..3 on the hand-made fixtures, plus brute-force checks."""

import random


from kanaforge.operators import graph as G
from kanaforge.operators import lexicon as LX
from kanaforge.operators import vocab as VC

LINKS = [
    ("A", "p1", 0, 0), ("A", "B", 14, 1), ("A", "p2", 0, 2),
    ("B", "p3", 0, 0), ("B", "p1", 0, 1), ("B", "A", 14, 2), ("B", "C", 14, 3),
    ("C", "p4", 0, 0),
]


def _walk(spark, depth, cap=None):
    links = spark.createDataFrame(LINKS, "category string, member string, member_ns int, ord int")
    roots = spark.createDataFrame([("A",)], "root string")
    w = G.walk_category(roots, links, max_depth=depth)
    if cap:
        w = G.cap_per_root(w, cap)
    return [r["member"] for r in w.orderBy("path").collect()]


def test_walk_fixture(spark):
    assert _walk(spark, 0) == ["p1", "p2"]
    assert _walk(spark, 1) == ["p1", "p3", "p1", "p2"]
    assert _walk(spark, 2) == ["p1", "p3", "p1", "p1", "p2", "p4", "p2"]
    assert _walk(spark, 1, cap=2) == ["p1", "p3"]


def test_walk_matches_recursive_reference(spark):
    rnd = random.Random(7)
    cats = [f"c{i}" for i in range(6)]
    links = []
    for c in cats:
        for o in range(rnd.randint(1, 5)):
            if rnd.random() < 0.4:
                links.append((c, rnd.choice(cats), 14, o))
            else:
                links.append((c, f"p{rnd.randint(0, 9)}", 0, o))
    by_cat = {}
    for c, m, ns, o in links:
        by_cat.setdefault(c, []).append((o, m, ns))

    def ref(cat, level, depth, out):
        for _o, m, ns in sorted(by_cat.get(cat, [])):
            if ns == 0:
                out.append(m)
            if ns == 14 and level < depth:
                ref(m, level + 1, depth, out)
        return out

    ldf = spark.createDataFrame(links, "category string, member string, member_ns int, ord int")
    roots = spark.createDataFrame([(c,) for c in cats], "root string")
    for depth in (0, 1, 2, 3):
        w = G.walk_category(roots, ldf, depth).orderBy("root", "path").collect()
        for c in cats:
            assert [r["member"] for r in w if r["root"] == c] == ref(c, 0, depth, [])
        capped = G.cap_per_root(G.walk_category(roots, ldf, depth), 3).orderBy("root", "rank").collect()
        for c in cats:
            assert [r["member"] for r in capped if r["root"] == c] == ref(c, 0, depth, [])[:3]


def test_assemble_articles_and_dump(spark):
    links = spark.createDataFrame(LINKS, "category string, member string, member_ns int, ord int")
    pages = spark.createDataFrame([("p1", "あ。 い\n う！終わり"), ("p2", "なし"), ("p3", "え。")], "title string, text string")
    roots = spark.createDataFrame([("A",)], "root string")
    arts = G.assemble_category(roots, links, pages, max_depth=1).orderBy("rank").collect()
    assert [r["article"] for r in arts] == ["# p1\nあ。\nい う！\n\n", "# p3\nえ。\n\n", "# p1\nあ。\nい う！\n\n"]
    blocks = spark.createDataFrame([(0, "== 見出し ==\n[[リンク|表示]]{{型}}短い。これは十文字を超える長い文です！"),
                                    (1, "あいうえおかきくけこさ。かきくけこさしすせそた")], "doc long, body string")
    s = G.extract_dump_sentences(blocks, ["doc"]).orderBy("doc", "sent_no").collect()
    assert [r["sentence"] for r in s] == ["これは十文字を超える長い文です", "あいうえおかきくけこさ", "かきくけこさしすせそた"]
    first = G.extract_dump_sentences(blocks, ["doc"], max_sentences=2).collect()
    assert [r["sentence"] for r in first] == ["これは十文字を超える長い文です", "あいうえおかきくけこさ"]


def test_readings_fixture(spark):
    toks = spark.createDataFrame([
        (0, 0, "漢字", "名詞,一般,*,*,*,*,漢字,カンジ,カンジ"),
        (0, 1, "は", "助詞,係助詞,*,*,*,*,は,ハ,ワ"),
        (0, 2, "XYZ", "名詞,固有名詞,*,*,*,*,*"),
    ], "line_no long, pos int, surface string, feature string")
    assert LX.concat_readings(toks).first()["reading"] == "カンジワXYZ"


def test_longest_match_fixture(spark):
    lex = spark.createDataFrame([("カン", "感"), ("カンジ", "漢字"), ("ヲ", "を")], "key string, value string")
    lines = spark.createDataFrame([(0, "カンジヲカンタ"), (1, "タ"), (2, "")], "line_id long, text string")
    got = {r["line_id"]: r["converted"] for r in LX.longest_match(lines, lex).collect()}
    assert got == {0: "漢字を感タ", 1: "タ", 2: ""}
    conv = {r["line_id"]: r["converted"] for r in LX.dictionary_convert(lines, lex).collect()}
    # katakana -> hiragana first, so a katakana lexicon no longer matches
    assert conv[0] == "かんじをかんた"
    hira = spark.createDataFrame([("かんじ", "漢字"), ("を", "を")], "key string, value string")
    conv = {r["line_id"]: r["converted"] for r in LX.dictionary_convert(lines, hira).collect()}
    assert conv == {0: "漢字をかんた", 1: "た", 2: ""}


def test_longest_match_bruteforce(spark):
    rnd = random.Random(3)
    alphabet = "abcd"
    keys = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 4))) for _ in range(15)})
    lex = {k: k.upper() + "|" for k in keys}
    lines = ["".join(rnd.choice(alphabet + " ") for _ in range(rnd.randint(0, 40))) for _ in range(30)]

    def ref(t):
        out, i = [], 0
        while i < len(t):
            for L in range(len(t) - i, 0, -1):
                if t[i:i + L] in lex:
                    out.append(lex[t[i:i + L]])
                    i += L
                    break
            else:
                out.append(t[i])
                i += 1
        return "".join(out)

    ldf = spark.createDataFrame(list(lex.items()), "key string, value string")
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, text string")
    got = {r["line_id"]: r["converted"] for r in LX.longest_match(df, ldf).collect()}
    assert got == {i: ref(t) for i, t in enumerate(lines)}


def test_build_lexicon_ties(spark):
    pairs = spark.createDataFrame([("a", "X"), ("a", "Y"), ("a", "Y"), ("b", "Q"), ("b", "P")], "key string, value string")
    got = {r["key"]: (r["value"], r["n"]) for r in LX.build_lexicon(pairs).collect()}
    assert got == {"a": ("Y", 2), "b": ("P", 1)}


def test_vocab_fixture(spark):
    df = spark.createDataFrame([(" ba ",), ("a c",), ("",)], "text string")
    v = {r["ch"]: r["idx"] for r in VC.build_vocab(df).collect()}
    assert v == {" ": 0, "a": 1, "b": 2, "c": 3}
    s = VC.vocab_summary(VC.build_vocab(df), k=2).orderBy("idx").collect()
    assert [(r["vocab_size"], r["idx"], r["ch"]) for r in s] == [(4, 0, " "), (4, 1, "a")]


def test_vocab_code_point_order(spark):
    text = "z𠮟あアa漢Ｚ"
    df = spark.createDataFrame([(text,)], "text string")
    got = [r["ch"] for r in VC.build_vocab(df).orderBy("idx").collect()]
    assert got == sorted(set(text))


def test_assemble_titles(spark):
    pages = spark.createDataFrame([("物理", "力は質量と加速度の積である。余り"), ("空", "   ")], "title string, text string")
    req = spark.createDataFrame([(1, "物理"), (2, "空"), (3, "無い")], "req_id long, title string")
    got = {r["req_id"]: r["article"] for r in G.assemble_titles(req, pages).collect()}
    assert got == {1: "# 物理\n力は質量と加速度の積である。\n\n"}


def test_build_parallel_corpus_japanese(spark):
    from kanaforge.operators.corpus import build_parallel_corpus

    lex = spark.createDataFrame([("漢字", "カンジ"), ("を", "ヲ"), ("書く", "カク"), ("読む", "ヨム")], "key string, value string")
    texts = ["漢字を書く。", "漢字を読む", "漢字abc", "  ", "書くを読む！"] + [f"漢字を書く{i}" for i in range(3)]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_id long, text string")
    out = {r["line_id"]: (r["source"], r["target"], r["split"]) for r in build_parallel_corpus(lines, lex).collect()}
    assert set(out) == {0, 1, 4}
    assert out[0][:2] == ("カンジヲカク", "漢字を書く") and out[4][:2] == ("カクヲヨム", "書くを読む")
    assert sum(v[2] == "train" for v in out.values()) == 2  # floor(3 * 0.8)


def test_longest_match_by_candidates_equals_the_map_side(spark):
    import random

    rng = random.Random(9)
    lex = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.choice(["X", "", "yy", "ab"]) for _ in range(25)}
    lines = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    df = spark.createDataFrame(lines, "line_id long, text string")
    ldf = spark.createDataFrame(list(lex.items()) + [("", "never")], "key string, value string")
    a = {r["line_id"]: r["converted"] for r in LX.longest_match(df, ldf).collect()}
    b = {r["line_id"]: r["converted"] for r in LX.longest_match(df, ldf, broadcast_max_bytes=0).collect()}
    assert a == b and len(a) == 60
    plan = LX.longest_match(df, ldf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # lines are converted where they are


def test_long_line_takes_linear_time(spark):
    import time

    lex = spark.createDataFrame([("ab", "X"), ("abc", "Y"), ("d", "Z")], "key string, value string")
    df = spark.createDataFrame([(1, "abcdab" * 14_000)], "line_id long, text string")
    LX.longest_match(df.limit(0), lex).collect()
    t = time.time()
    assert LX.longest_match(df, lex).first()["converted"] == "YZX" * 14_000
    assert time.time() - t < 6


def test_unknown_domain_is_a_plain_category(spark):
    links = spark.createDataFrame([("Cat", "P", 0, 1), ("Phys", "P", 0, 1)], "category string, member string, member_ns int, ord int")
    pages = spark.createDataFrame([("P", "One. Two.")], "title string, text string")
    domains = spark.createDataFrame([("Dom", "Phys", 0)], "domain string, category string, ord int")
    names = spark.createDataFrame([("dom",), ("Cat",)], "name string")
    got = {r["domain"]: r["article"].split("\n")[0] for r in G.assemble_domain(names, domains, links, pages, terms=".").collect()}
    assert got == {"Dom": "# P (Category: Phys)", "Cat": "# P"}
