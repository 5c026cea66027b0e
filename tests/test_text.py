"""TXT-* rules against Python's string semantics and the hand-made fixtures."""

import re
import unicodedata

from pyspark.sql import functions as F

from kanaforge.functions import constants as K
from kanaforge.functions import text as TX


def one(spark, expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_whitespace_class_matches_python():
    assert K.WHITESPACE_CODEPOINTS == [c for c in range(0x110000) if chr(c).isspace()]
    assert 0x3000 in K.WHITESPACE_CODEPOINTS and 0x1C in K.WHITESPACE_CODEPOINTS


def test_strip_collapse_remove_like_python(spark):
    samples = ["　 あ い\n", "\x1cx\x1f", " a b  ", "", "\n\n", "a  \t b"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    rows = df.select("t", TX.strip_ws("t").alias("s"), TX.collapse_ws("t").alias("c"),
                     TX.remove_ws("t").alias("r")).collect()
    for r in rows:
        assert r["s"] == r["t"].strip()
        assert r["c"] == re.sub(r"\s+", " ", r["t"]).strip()
        assert r["r"] == re.sub(r"\s+", "", r["t"])


def test_strip_does_not_eat_before_final_newline(spark):
    # Java's "$" would match before a final line break; \z must not.
    assert one(spark, TX.strip_ws("t"), "a b\n") == "a b"
    assert one(spark, TX.strip_ws("t"), "ab\nc") == "ab\nc"


def test_normalize_text_nfkc(spark):
    assert one(spark, TX.normalize_text("t"), "ｶﾞ Ａ　１") == "ガA1"
    s = "①ﾊﾟ ﾃｽﾄ"
    assert one(spark, TX.normalize_text("t"), s) == re.sub(r"\s+", "", unicodedata.normalize("NFKC", s))
    assert one(spark, TX.nfkc("t"), None) is None


def test_strip_chars_fixture(spark):
    assert one(spark, TX.strip_chars("t"), "カンジ、ヲ　カク。") == "カンジヲカク"
    assert one(spark, TX.strip_chars("t"), "漢字、を　書く。") == "漢字を書く"
    assert one(spark, TX.strip_chars("t"), "スゴイ！") == "スゴイ"
    assert one(spark, TX.strip_chars("t"), "スゴイ!") == "スゴイ!"
    assert one(spark, TX.strip_chars("t"), "マアマア…") == "マアマア…"
    assert len(set(K.JA_PUNCT)) == 32


def test_alphabet(spark):
    ok = {"カンジヲカク": True, "コーヒー": True, "カンジabc": False, "かんじ": False, "ｶﾝｼﾞ": False,
          "ヽヾ": False, "": False, "ヷヸヹヺ": True}
    df = spark.createDataFrame([(k,) for k in ok], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", TX.is_valid_alphabet("t").alias("v")).collect()}
    assert got == ok


def test_split_keep_fixture(spark):
    assert one(spark, TX.split_sentences_keep("t"), "あ。 い\n う！終わり") == ["あ。", "い う！"]
    assert one(spark, TX.split_sentences_keep("t"), "終わりなし") == []
    assert one(spark, TX.split_sentences_keep("t"), "。。") == ["。", "。"]
    assert one(spark, TX.split_sentences_keep("t"), "") == []


def test_split_keep_matches_python_rule(spark):
    def ref(text):
        parts = re.split(r"([。！？])", text)
        out = []
        for i in range(0, len(parts) - 1, 2):
            s = re.sub(r"\s+", " ", parts[i] + parts[i + 1]).strip()
            if s:
                out.append(s)
        return out

    samples = ["a。b！c？d", "  。 x 。\n", "？！。", "no end", "x。　\n。y"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    for r in df.select("t", TX.split_sentences_keep("t").alias("s")).collect():
        assert r["s"] == ref(r["t"])


def test_markup_and_drop_split_fixture(spark):
    text = "== 見出し ==\n[[リンク|表示]]{{型}}短い。これは十文字を超える長い文です！"
    expr = TX.split_sentences_drop(TX.strip_markup("t"))
    assert one(spark, expr, text) == ["これは十文字を超える長い文です"]
    assert one(spark, TX.split_sentences_drop("t"), "あいうえおかきくけこ。あいうえおかきくけこさ") == ["あいうえおかきくけこさ"]


def test_markup_dot_stops_at_newline_only(spark):
    s = "[[a\rb]] x [[c\nd]]"
    expected = re.sub(r"\[\[.*?\]\]", "", s)
    assert one(spark, TX.strip_markup("t"), s) == expected


def test_char_set_and_array(spark):
    assert sorted(one(spark, TX.char_set("t"), "ああい𠮟")) == sorted({"あ", "い", "𠮟"})
    assert one(spark, TX.char_array("t"), "") == []


def test_kana_prompt_slug_reading(spark):
    assert one(spark, TX.katakana_to_hiragana("t"), "カンジ ひらがな ー ヴ") == "かんじ ひらがな ー ゔ"
    assert one(spark, TX.format_prompt("t"), "アイ") == "translate kana to kanji: アイ"
    assert one(spark, TX.slug("t"), " Hello, World-1! ") == "Hello_World-1"
    assert one(spark, TX.slug("t"), "物理学 (基礎)") == "物理学_基礎"
    df = spark.createDataFrame([("漢字", "名詞,一般,*,*,*,*,漢字,カンジ,カンジ"), ("XYZ", "名詞,固有名詞,*,*,*,*,*")],
                               "s string, f string")
    assert [r[0] for r in df.select(TX.reading_of("s", "f")).collect()] == ["カンジ", "XYZ"]


def test_render_and_truncate(spark):
    df = spark.createDataFrame([("T", ["a。", "b。"], "C")], "t string, s array<string>, c string")
    r = df.select(TX.render_article("t", "s").alias("a"), TX.render_article("t", "s", F.col("c")).alias("b")).first()
    assert r["a"] == "# T\na。\nb。\n\n"
    assert r["b"] == "# T (Category: C)\na。\nb。\n\n"
    assert one(spark, TX.truncate("t", 3), "𠮟あいう") == "𠮟あい"


def test_normalize_text_matches_python_on_tricky_text(spark):
    import random

    alphabet = ["a", "e", "é", "́", "ｶ", "ﾞ", "ガ", "か", "゙", "ﬁ", "²", "ª", " ", "가", "각",
                "ᄀ", "ᅡ", "ᆨ", "漢", "Ａ", "①", "Å", "Å", " ", "　", "𠮟", "ß"]
    rnd = random.Random(4)
    samples = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8))) for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(TX.normalize_text("t")).collect()]
    want = [re.sub(r"\s+", "", unicodedata.normalize("NFKC", s)) for s in samples]
    assert got == want


def test_slug_matches_python_word_rule(spark):
    import random

    alphabet = ["a", "Z", "_", "-", " ", "　", "物", "か", "゙", "゛", "①", "‿", "Ⅷ", "é", "!", "(", "ß", "٣", "\t"]
    rnd = random.Random(8)
    samples = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 10))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in samples], "t string")
    got = [r[0] for r in df.select(TX.slug("t")).collect()]
    want = [re.sub(r"[^\w\s-]", "", x).strip().replace(" ", "_") for x in samples]
    assert got == want


def test_plain_ranges_are_inert(spark):
    """No character of the short class changes or joins under NFKC, and every other one is
    still seen by the test with the full class."""
    plain = [chr(c) for lo, hi in K.PLAIN_RANGES for c in range(lo, hi + 1)]
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in plain)
    assert unicodedata.normalize("NFKC", "".join(plain)) == "".join(plain)
    whole = spark.createDataFrame([("".join(plain),)], "t string")
    assert tuple(whole.select(F.col("t").rlike(K.NOT_PLAIN), F.col("t").rlike(K.NOT_NFKC_INERT)).first()) == (False, False)
    texts = ["plain", "é", "ｶﾞ", "か\u3099", "e\u0301", "ﬁn", "Ǆ", "①", "日本", "a\u00a0b", "\u1112\u1161\u11ab", "x\u3000y", "ŉ", "…"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", TX.normalize_text("t").alias("n")).collect()}
    assert got == {i: "".join(unicodedata.normalize("NFKC", t).split()) for i, t in enumerate(texts)}
