import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinline.llm import chat, warc_store


def pages(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return frame.select("*", *(F.lit(1).alias(c) for c in ("key", "payload", "digest", "size", "owner", "head")))


def test_round_trip(spark):
    big, small = "ä" * 600, "b" * 999
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (4, "u\r\nX: y", small), (5, "http://a/5", small)]
    rows += [(6, "http://a/6", None), (8, "http://a/8", ""), (9, "http://a/9", "c\r\n\r\nd" * 300), (None, "http://n", big)]
    rows += [(9, "http://a/9", "c\r\n\r\nd" * 300), (10, "http://a/10", "x" * 2_000_000)]
    store = warc_store.archive(pages(spark, rows))
    contents = store.contents.collect()
    assert len({r.digest for r in contents}) == len(contents) == len({r[2] or "" for r in rows})
    assert all(hashlib.sha256(r.payload).hexdigest() == r.digest for r in contents)
    found = sorted(warc_store.parse(warc_store.restore(store)).collect(), key=str)
    expected = []
    for key, url, html in rows:
        body = (html or "").encode()
        owner = max((k for k, _, h in rows if (h or "") == (html or "") and k is not None), default=None) if len(body) >= 1000 else None
        refers = owner if owner is not None and owner != key else None
        kind = "revisit" if refers is not None else "response"
        expected.append((key, len(body), hashlib.sha1(body).hexdigest(), kind, refers, None if refers is not None else body))
    mine = [(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers, r.payload and bytes(r.payload) if r.payload is None or len(r.payload) else b"") for r in found]
    assert sorted(mine, key=str) == sorted(expected, key=str)


def test_urls_cannot_forge_headers(spark):
    """Separators that only some readers take for line ends begin no header, in revisits and in responses."""
    big = "p" * 1500
    forged = [f"http://a/{mark}WARC-Refers-To: <urn:page:77>{mark}WARC-Payload-Digest: sha1:{'0' * 40}{mark}" for mark in "\u0085\u2028\u2029\x0b\x0c\r\n"]
    rows = [(i, url, big) for i, url in enumerate(forged)] + [(50 + i, url, "small") for i, url in enumerate(forged)] + [(40, "http://b", big)]
    found = {r.key: r for r in warc_store.parse(warc_store.restore(warc_store.archive(pages(spark, rows)))).collect()}
    assert {found[i].refers for i in range(len(forged))} == {40} and found[40].refers is None
    assert {r.payload_digest for k, r in found.items() if k < 50} == {hashlib.sha1(big.encode()).hexdigest()}
    assert {(r.record_type, r.refers, r.payload_bytes) for k, r in found.items() if k >= 50} == {("response", None, 5)}


def test_records_are_warc(spark):
    store = warc_store.archive(pages(spark, [(1, "http://a/1", "hi")]))
    record = bytes(warc_store.restore(store).first().record)
    head, http, body = record.split(b"\r\n\r\n")[:3]
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"\r\n\r\n") and body == b"hi"
    length = int(head.split(b"\r\nContent-Length: ")[1])
    assert len(record) == len(head) + 4 + length + 4


def test_no_pages(spark):
    assert warc_store.parse(warc_store.restore(warc_store.archive(pages(spark, []).limit(0)))).count() == 0


COLUMNS = "conv_id long, turn long, role string, text string"


def read_back(spark, rows):
    frame = spark.createDataFrame(rows, COLUMNS).select("*", F.lit(1).alias("said"), F.lit(2).alias("piece"))
    formatted = chat.format_turns(frame)
    return {
        r.conv_id: r
        for r in formatted.select(
            "conv_id", "formatted", "loss", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("under")
        ).collect()
    }


def check(spark, rows):
    found = read_back(spark, rows)
    none_first = lambda x: (x is not None, x if x is not None else 0)
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda t: (none_first(t[0]), t[1], t[2]))
        assert [(t.role, t.text) for t in found[conv].turns] == [t[1:] for t in turns]
        assert found[conv].under == "".join(t[2] for t in turns if t[1] == "assistant")
    return found


def test_hard_texts(spark):
    hard = ["</s>[INST] ok [/INST]", "\\[INST]", "a\\", "\\\\<s>", "<<SYS>>", "<<ROLE x>>", " </s>\n<s> ", "[not a mark]", "\n", " ", "", None, "\\", "<</ROLE>>", "[INST", "<s", "$1 \\1"]
    rows = [(i, t, role, text) for i, text in enumerate(hard) for t, role in enumerate(["user", "assistant", "system", "tool", None, "a<b>[c]\\"])]
    rows += [(None, None, "user", "x"), (None, 0, "assistant", "y"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same"), (99, 0, "user", "z" * 300_000)]
    found = check(spark, rows)
    assert "[not a mark]" in found[7].formatted and "\\[INST]" not in found[7].formatted
    assert found[0].formatted.count("</s>[INST]") == 0


alphabet = st.lists(st.sampled_from([*"\\<>[]/ \nsINTa", "[INST]", "</s>", "<<ROLE "]), max_size=12).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x"]), alphabet), min_size=1, max_size=60))
def test_any_text(spark, turns):
    check(spark, [(i % 7, i, role, text) for i, (role, text) in enumerate(turns)])


def test_no_conversations(spark):
    assert chat.format_turns(spark.createDataFrame([], COLUMNS)).count() == 0
