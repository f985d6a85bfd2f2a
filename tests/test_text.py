import pytest
from pyspark.sql import functions as F

from twinline.functions import text as tx
from twinline.functions.words13a import words_13a


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *columns).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


def test_strip_is_python_strip(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = ["", " ", "a b", None] + [f"{s}{s}a{s}b{s}" for s in spaces] + ["​x​", "﻿x", "".join(spaces)]
    assert values(spark, texts, tx.strip_text("t")) == [None if t is None else t.strip() for t in texts]


def test_prompt_and_sft(spark):
    row = values(spark, ["hi"], tx.prompt_prefix("t"), tx.sft_text("t", F.lit("x"), "A", "B"))
    assert row == [("translate English to Korean: hi", "Translate A to B: hi => x")]


def test_blank_answer_and_reference(spark):
    texts = ["a => b", "a => b => c", "a=>b", "plain", "a =>　b\t=> c", ""]
    blanked = [t.split(" => ")[0] + " => \n" for t in texts]
    references = [t.split("=>")[1].strip() if "=>" in t else None for t in texts]
    assert values(spark, texts, tx.blank_answer("t")) == blanked
    assert values(spark, texts, tx.extract_reference("t")) == references


def test_pairs_round_trip(spark):
    df = spark.createDataFrame([("1", "a", "b")], "id string, src string, tgt string")
    pairs = tx.make_pairs(df)
    assert pairs.columns == ["id", "translation"]
    assert tx.split_sides(pairs).collect() == df.collect()


@pytest.mark.parametrize(
    "text, words",
    [
        ("", []),
        (" 　 ", []),
        ("Hello, world.", ["Hello", ",", "world", "."]),
        ("It costs 1,000.50 today", ["It", "costs", "1,000.50", "today"]),
        ("a<skipped>b c-\nd e\nf", ["ab", "cd", "e", "f"]),
        ("&quot;x&quot; &amp; &lt;y&gt;", ['"', "x", '"', "&", "<", "y", ">"]),
        ("1990-2000 well-known", ["1990", "-", "2000", "well-known"]),
        ("안녕하세요. 세계　끝", ["안녕하세요", ".", "세계", "끝"]),
        ("a/b (c) [d] e's", ["a", "/", "b", "(", "c", ")", "[", "d", "]", "e's"]),
    ],
)
def test_words_13a(spark, text, words):
    assert values(spark, [text], words_13a(F.col("t"))) == [words]
