from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import search


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first().y


def test_tokens(spark):
    for text, expected in [("I prefer a Dark  mode", ["prefer", "dark", "mode"]), ("深色模式", ["深", "色", "模", "式"]), ("用Python3写", ["用", "p", "y", "t", "h", "o", "n", "3", "写"]), ("", []), (" 　 ", []), ("x, y! zz", ["zz"])]:
        assert one(spark, text, T.tokens) == expected
        assert search.words(text) == expected


def test_hash(spark):
    assert one(spark, "hello", T.fnv1a32) == 1335831723 == search.HASHED["hello"]
    assert one(spark, "", T.fnv1a32) == 2166136261
    assert one(spark, "a😀b", T.fnv1a32) == search.HASHED["a😀b"]


def test_overlap_and_jaccard(spark):
    df = spark.createDataFrame([(["a1", "b1", "c1"], ["b1", "c1", "d1", "e1"], [])], "q array<string>, d array<string>, n array<string>")
    r = df.select(T.overlap("q", "d").alias("o"), T.overlap("n", "d").alias("z"), T.jaccard("q", "d").alias("j")).first()
    assert round(r.o, 9) == round(2 / 3, 9) and r.z == 0 and r.j == 2 / 5


def test_summaries(spark):
    assert one(spark, "x" * 120, T.summarize) == "x" * 120
    assert one(spark, "x" * 121, T.summarize) == "x" * 117 + "..."
    assert one(spark, "a \n b", T.summarize) == "a b"
    assert one(spark, "abc  def", lambda c: T.clamp_chars(c, 5)) == "abc"
    assert one(spark, "abcde", T.estimate_tokens) == 2


def test_sanitize(spark):
    assert one(spark, "<system-reminder>a\nb</system-reminder> hi", T.sanitize) == "hi"
    assert one(spark, "x <user_query> do it </user_query> y", T.sanitize) == "do it"
    assert one(spark, "<system-reminder>only</system-reminder>", T.sanitize) == ""
    assert one(spark, "## USER.md stuff", T.sanitize) == ""
    assert one(spark, None, T.sanitize) == ""


def test_first_statement(spark):
    assert one(spark, "I like tea. What about you?", T.first_statement) == "I like tea."
    assert one(spark, "I like tea. It is warm.", T.first_statement) == "I like tea. It is warm."
    assert one(spark, None, T.first_statement) == ""


def test_temporal_words(spark):
    f = lambda c: F.col(c).rlike(T.TEMPORAL)
    assert one(spark, "we now use it", f) and not one(spark, "known", f) and not one(spark, "我们现在用", f)


def test_experience_ids(spark):
    def plain(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        h = abs(h - (1 << 32) if h >= 1 << 31 else h)
        digits = ""
        while h or not digits:
            h, r = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
        return digits

    for s in ("", "a", "Keep tests small", "ü" * 40):
        assert one(spark, s, T.stable_hash36) == plain(s)


def test_snippet():
    assert search.snippet("a  b", ["zz"]) == "a b"
    long = "x " * 200 + "needle " + "y " * 200
    cut = search.snippet(long, ["none", "needle"])
    assert cut.startswith("...") and cut.endswith("...") and "needle" in cut and len(cut) == 226
    assert search.snippet("q" * 300, ["zz"]) == "q" * 217 + "..."
    assert len(search.snippet("q" * 220, ["zz"])) == 220


def test_json_array_text(spark):
    assert one(spark, 'sure:\n```json\n[1]\n```', T.json_array_text) == "[1]"
    assert one(spark, "so [1, [2]] done", T.json_array_text) == "[1, [2]]"
    assert one(spark, " none ", T.json_array_text) == "none"
