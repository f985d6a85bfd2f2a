import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from twinline.llm import binary_packing, separator_scan
from twinline.llm.bpe import END_OF_TEXT, default_path, encoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize(
    "text",
    ["", " ", "  ", "a  b", "a \n b", "x\n\n y", "　 b", "a ", "a  ", "\tq", "it's  'twas", "é,", "Word. word, w1 2w", "a <|endoftext|> b", "<|endoftext|>"],
)
def test_ids_are_the_tokenizers(tokenizer, text):
    assert encoder(default_path(), special=True)(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_decompose():
    for n in (1, 2, 3, 2047, 2048, 2049, 4095, 10_000):
        pieces = binary_packing.decompose(n)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 2048 for p in pieces)
        assert pieces == sorted(pieces, reverse=True)


def test_pack(odd_docs, tokenizer):
    rows = binary_packing.pack(odd_docs).withColumn("crc", binary_packing.ids_crc32()).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.crc and len(r.ids) == 4 * r.length
    for doc in odd_docs.select("doc_id", "text").distinct().collect():
        ids = [*tokenizer.encode(doc.text or "", add_special_tokens=False).ids, 1]
        mine = [r for r in rows if r.doc_id == doc.doc_id and r.doc_tokens == len(ids)]
        joined = {}
        for r in mine:
            joined[r.start] = np.frombuffer(r.ids, "<u4").tolist()
        assert sum((joined[s] for s in sorted(joined)), []) == ids


def test_a_bucket_holds_one_length(spark, odd_docs, tmp_path):
    path = str(tmp_path / "buckets")
    pieces = binary_packing.pack(odd_docs)
    binary_packing.write_buckets(pieces, path)
    read = spark.read.parquet(path)
    assert read.count() == pieces.count() and read.filter("length <> 1 << bucket").count() == 0


def test_pack_needs_a_power_of_two(odd_docs):
    with pytest.raises(ValueError):
        binary_packing.pack(odd_docs, longest=1000)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 18])
def test_count_tokens(odd_docs, block):
    docs = odd_docs.filter("doc_id is null or doc_id <> 9") if block < 64 else odd_docs
    encode = encoder(default_path())
    expected = sorted((r.doc_id or 0, len(encode(r.text or ""))) for r in docs.select("doc_id", "text").collect())
    found = separator_scan.count_tokens(docs, block=block).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == expected


def test_scan_stitches_any_file(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], set()
    for file in ("a", "b", "c"):
        ids = rng.choice([1, 2, END_OF_TEXT], 500, p=[0.6, 0.37, 0.03]).astype("<u2")
        if file == "c":
            ids[:] = 5
        ends = np.flatnonzero(ids == END_OF_TEXT)
        start = 0
        for k, end in enumerate([*ends.tolist(), 500]):
            if end < 500 or end > start:
                expected.add((file, k, start, end - start, end < 500))
            start = end + 1
        rows += [(file, b, ids[b * 13 : b * 13 + 13].tobytes()) for b in range(39)]
    blocks = spark.createDataFrame(rows, "file string, block long, ids binary")
    assert {tuple(r) for r in separator_scan.scan(blocks, chunk=4).collect()} == expected


def test_read_files(spark, tmp_path):
    ids = np.array([4, 5, END_OF_TEXT, 6, END_OF_TEXT, 7], "<u2")
    (tmp_path / "x.bin").write_bytes(ids.tobytes())
    found = separator_scan.scan(separator_scan.read_files(spark, str(tmp_path), block=2)).collect()
    assert sorted((r.ordinal, r.n_tokens, r.closed) for r in found) == [(0, 2, True), (1, 1, True), (2, 1, False)]


def test_empty(no_docs):
    assert binary_packing.pack(no_docs).count() == 0
    assert separator_scan.count_tokens(no_docs).count() == 0
