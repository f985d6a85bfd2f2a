import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinline.functions import tokens as tk

TEXTS = ["", "a", "héé 한국 é", "日本", "a" * 200, "\x00\x7f", "한" * 50, "😀 x"]


def ids_of(text, limit=None):
    data = text.encode()
    return [b + 3 for b in (data if limit is None else data[: limit - 1])] + [1]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def column(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


@pytest.mark.parametrize("limit", [None, 1, 2, 8, 128])
def test_token_ids(texts, limit):
    assert column(texts, tk.token_ids("t", limit)) == [ids_of(t, limit) for t in TEXTS]


def test_token_count(texts):
    assert column(texts, tk.token_count("t")) == [len(t.encode()) + 1 for t in TEXTS]
    assert column(texts, tk.token_count("t", eos=False)) == [len(t.encode()) for t in TEXTS]


def test_null_text(spark):
    df = spark.sql("select 0 as i, cast(null as string) as t")
    assert column(df, tk.token_ids("t")) == [None]


def test_padding_and_mask(texts):
    m = 16
    ids = texts.withColumn("ids", tk.token_ids("t", m))
    real = [ids_of(t, m) for t in TEXTS]
    assert column(ids, tk.pad_fixed("ids", m)) == [r + [0] * (m - len(r)) for r in real]
    assert column(ids, tk.label_pad("ids", m)) == [r + [-100] * (m - len(r)) for r in real]
    masks = column(ids, tk.attention_mask("ids", m))
    assert masks == [[1] * len(r) + [0] * (m - len(r)) for r in real]
    assert [sum(x) for x in masks] == column(ids.withColumn("p", tk.pad_fixed("ids", m)), tk.nonpad_count("p"))


def test_decode_gives_the_text_back(texts):
    assert column(texts, tk.decode_ids(tk.token_ids("t"))) == TEXTS


def test_decode_of_a_cut_character_is_valid_text(spark):
    df = spark.createDataFrame([(0, "한국")], "i int, t string")
    assert column(df, tk.decode_ids(tk.token_ids("t", 6))) == ["한�"]


def test_clamp_stops_the_decoding_crash(spark):
    df = spark.createDataFrame([(0, [-1, 75, 259, 999_999, 0, 2, -100, 1])], "i int, ids array<int>")
    assert column(df, tk.clamp_ids("ids")) == [[2, 75, 2, 2, 0, 2, 2, 1]]
    assert column(df, tk.decode_ids(tk.clamp_ids("ids"))) == ["H"]


def test_unmask(spark):
    df = spark.createDataFrame([(0, [5, -100, 1, -100])], "i int, ids array<int>")
    assert column(df, tk.unmask_labels("ids")) == [[5, 0, 1, 0]]


def test_roundtrip_audit(texts):
    assert [tuple(r) for r in tk.roundtrip_audit(texts, "t").collect()] == [
        (True, len(TEXTS), sum(len(t.encode()) for t in TEXTS))
    ]


def test_tokenize_with_keeps_failing_rows_apart(spark):
    def fussy(batch):
        if any("bad" in t for t in batch):
            raise ValueError("bad text")
        return [[len(t)] for t in batch]

    df = spark.createDataFrame([(0, "one"), (1, "bad"), (2, "three")], "i int, t string").coalesce(1)
    out = tk.ids_with(df, "t", fussy)
    assert out.schema["ids"].dataType == T.ArrayType(T.IntegerType())
    assert column(out, "ids") == [[3], None, [5]]
    assert [r.ids_error for r in out.filter(F.col("ids").isNull()).collect()] == ["ValueError: bad text"]


@pytest.mark.parametrize("error", [ImportError("no vocabulary"), ValueError("broken")])
def test_tokenize_with_stops_when_the_tokenizer_is_at_fault(spark, error):
    def broken(batch):
        raise error

    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "i int, t string").coalesce(1)
    with pytest.raises(Exception, match="no vocabulary|every text"):
        tk.ids_with(df, "t", broken).collect()


def test_tokenize_with_null_text(spark):
    df = spark.createDataFrame([(0, None), (1, "ab")], "i int, t string").coalesce(1)
    assert column(tk.ids_with(df, "t", lambda batch: [[len(t)] for t in batch]), "ids") == [None, [2]]
