import hashlib
import random
import tracemalloc

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from twinline.llm import pieces, queries

CHARACTERS = list("ab ▁\n\t é\U0001f388ß<>0x　\x00中́") + ["  ", "the ", "<s>", "<unk>", "<0x0A>", "\r\n", "    "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def some_texts(n, seed=1):
    rng = random.Random(seed)
    fixed = ["", " ", "  ", "a", " a", "  a b\n\nc", "▁x", "\U0001f388\n", "<s>", "   \n", "a ▁ b", "ab" * 5_000, "the " * 5_000, "x" * 30_000]
    return fixed + ["".join(rng.choices(CHARACTERS, k=rng.randint(0, 60))) for _ in range(n)]


def test_ids_spans_and_texts_equal_the_librarys(library):
    words = pieces.vocabulary(pieces.default_path())
    for text in some_texts(3_000):
        ids, ends = words.encode(text)
        want = library.encode(text)
        assert ids.tolist() == want
        assert words.decode(want) == library.decode(want)
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip([0, *ends.tolist()], ends.tolist())) == spans


def test_any_ids_decode_as_in_the_library(library):
    words, rng = pieces.vocabulary(pieces.default_path()), random.Random(2)
    for _ in range(5_000):
        ids = [rng.choice([0, 1, 2, *range(3, 259), 259, 264, 28705, 13, 1233, 2287]) for _ in range(rng.randint(0, 8))]
        assert words.decode(ids) == library.decode(ids)


def test_short_and_long_parts_join_alike():
    words, rng = pieces.vocabulary(pieces.default_path()), random.Random(3)
    for _ in range(2_000):
        part = "".join(rng.choices("abcdeehilnorst▁", k=rng.randint(1, pieces.SHORT)))
        assert words.join(part) == words._join_long(part)


def long_texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeehilnorst", k=rng.randint(1, 12))) for _ in range(300)] + ["▁", "\n", "é", "🎈", "", "中"]
    alphabets = ["acgt", "ABCDefgh0123+/", "的一是不了人我在有他这中大来上国", "▁ ", "\n ", "a\n"]
    return [" ".join(rng.choices(words, k=2_000))] + ["".join(rng.choices(x, k=rng.choice([41, 700, 3_000]))) for x in alphabets for _ in range(5)]


@pytest.mark.parametrize("window", [1, 2, 7, 1_000])
def test_windows_change_nothing(library, monkeypatch, window):
    monkeypatch.setattr(pieces, "WINDOW", window)
    words = pieces.vocabulary(pieces.default_path())
    for text in long_texts():
        ids, ends = words.encode(text)
        proto = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in proto] and ends.tolist() == [p.end for p in proto]
        assert words.decode(ids) == library.decode(ids.tolist())


@pytest.mark.parametrize("text, most", [("the rain in some place\n" * 40_000, 24), ("acgtta" * 20_000, 130)])
def test_long_texts_take_few_bytes_a_character(text, most):
    """Also those that are one part. A list of all parts took 33 bytes, a heap of tuples 269."""
    words = pieces.Vocabulary.read(pieces.default_path())
    tracemalloc.start()
    words.decode(words.encode(text)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most * len(text)


def test_bytes_that_are_no_utf8(spark, library):
    """Each is U+FFFD, as in the library, and one byte of the source."""
    rng = random.Random(6)
    kinds = [b"a", b" ", b"the ", b"\xff", b"\xc3", b"\xe4\xb8", b"\xed\xb2\x80", "é".encode(), "中".encode(), "\ufffd".encode(), "▁".encode()]
    texts = [b"\xff", b"a\xffb", b"\xe4\xb8", b"\xc3 \xa9"] + [b"".join(rng.choices(kinds, k=rng.randint(1, 12))) for _ in range(500)]
    words = pieces.vocabulary(pieces.default_path())
    for text in texts:
        ids, ends = words.encode_bytes(text)
        assert ids.tolist() == library.encode(text)
        assert (ends[-1] if len(ends) else 0) == len(text) and np.all(np.diff(ends) >= 0)
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(texts[:50])], "doc_id long, b binary")
    rows = rows.select("doc_id", F.expr("cast(b AS string)").alias("text"))
    for r in pieces.encode(rows, decoded=True).select("_row.doc_id", "ids", "ends", "decoded").collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.ends[-1] == len(texts[r.doc_id]) and r.decoded == library.decode(r.ids)


def test_texts_of_other_columns(spark, library):
    """A column that is no text, or lies in a struct, is cast."""
    rows = spark.range(3).select("id", F.struct(F.lit("a b").alias("x")).alias("s"))
    for name, want in (("id", "2"), ("s.x", "a b")):
        got = pieces.encode(rows, name).filter("_row.id = 2").first()
        assert got.ids == library.encode(want) and got._row.asDict(True) == {"id": 2, "s": {"x": "a b"}}


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("lead", [True, False])
def test_normalisation_by_compiled_maps(rule, squeeze, lead):
    """The longest prefixes of the map, and the source place of every character."""
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=lead, escape_whitespaces=True, remove_extra_whitespaces=squeeze
    )
    rules = pieces.Rules.read(dict(pieces.fields(library.serialized_model_proto()))[3])
    rng = random.Random(4)
    for _ in range(1_500):
        text = "".join(rng.choices("aA ＡﬁÅéé　 \t\nﷺ①½ǆﾊﾟ가각\U0001f388x", k=rng.randint(0, 12)))
        want, places = library.normalize(text, with_offsets=True)
        got, found = rules.normalise(text)
        ends = np.cumsum([0, *(len(c.encode()) for c in got.decode())])
        assert got.decode() == want
        assert [len(text.encode()[:p].decode()) for p in found[ends]] == places


def test_pieces_of_a_normalised_text_reach_into_the_source():
    """A vocabulary of characters with a map: every span is the source of its piece."""
    rules = pieces.Rules.read(dict(pieces.fields(sentencepiece.SentencePieceNormalizer(
        rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True).serialized_model_proto()))[3])
    names = ["<unk>", pieces.MARK, *"abcfi1", "fi", pieces.MARK + "a"]
    words = pieces.Vocabulary(names, [pieces.UNKNOWN] + [pieces.NORMAL] * (len(names) - 1), [-float(i) for i in range(len(names))], rules, " ? ")
    text = "  Ａaﬁ  ①中中 b "
    ids, ends = words.encode(text.replace("Ａ", "ａ"))
    source = text.replace("Ａ", "ａ").encode()
    starts = [2, *ends.tolist()]
    found = [(names[i], source[a:b].decode()) for i, a, b in zip(ids.tolist(), starts, ends.tolist())]
    assert found[0][0] == pieces.MARK + "a" and found[0][1] == "ａ"
    assert ("fi", "ﬁ") in found and ("1", "①") in found
    assert ("<unk>", "中中") in found  # neighbours without a piece are one unknown


def test_rows(spark, odd_docs, library, partitions):
    encoded = pieces.encode(odd_docs, decoded=True).withColumn("again", pieces.decode("ids"))
    got = encoded.select("_row.doc_id", "_row.text", "_row.key", "ids", "ends", "decoded", "again").collect()
    assert len(got) == odd_docs.count()
    for r in got:
        want = library.encode(r.text or "")
        assert r.ids == want and r.decoded == r.again == library.decode(want) and r.key == "x"
        assert (r.ends[-1] if r.ends else 0) == len((r.text or "").encode()) and r.ends == sorted(r.ends)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_returns_rows_without_pieces(spark, odd_docs, library, tmp_path):
    """Null and empty texts are rows with nothing covered, not errors."""
    odd_docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_pieces(spark, str(tmp_path)).collect()
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha256(",".join(map(str, ids))), sha256(library.decode(ids)), len((r.text or "").encode())))
    assert sum(r.n_tokens == 0 for r in got) == 3
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_spans_and_empty_table(spark, odd_docs, no_docs):
    assert pieces.encode(no_docs).collect() == []
    one = odd_docs.filter("doc_id = 10")
    text = one.first().text.encode()
    rows = pieces.spans(pieces.encode(one)).orderBy("at").collect()
    assert b"".join(text[r.start : r.end] for r in rows) == text and rows[0].start == 0
    assert pieces.encode(odd_docs.limit(1)).select(F.size("ids")).first()[0] > 0


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x12\x02\x18\x01")  # a model of the unigram kind
    with pytest.raises(ValueError):
        pieces.vocabulary(str(tmp_path / "m"))
