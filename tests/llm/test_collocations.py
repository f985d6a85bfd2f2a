import random
import re
from collections import Counter

import pytest

from twinline.llm import collocations

from .conftest import DOCS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def plain_counts(rows):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        for words in pieces_of(text):
            totals[lang or "und"] += len(words)
            for k in range(1, 6):
                counts.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, totals


def plain(rows, least, first=2_000):
    counts, totals = plain_counts(rows)
    found = {}
    held = [p for p, n in counts.items() if n >= least and len(p) > 2]
    longer = {}
    for p in held:
        words = p[1:]
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (p[0], *words[i : i + k])
                longer[inner] = max(longer.get(inner, 0), counts[p])
    for p in held:
        lang, *words = p
        a, n = counts[p], totals[lang]
        if longer.get(p, 0) >= a:
            continue
        score, k = min((1000 * a * n // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k) for k in range(1, len(words)))
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[(lang, *words[:k])], counts[(lang, *words[k:])], n))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n, -score)
        for lang, rows in found.items()
        for rank, (score, a, p, left, right, n) in enumerate(sorted(rows)[:first], 1)
    )


def texts(seed, rows, words=30, kinds=40):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(kinds)] + ["É", "ß", "Ab", "aB"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? ", " ", "\x1c"]
    weights = [1 / (i + 1) for i in range(len(some))]
    out = []
    for i in range(rows):
        body = "".join(w + rng.choice(ends) for w in rng.choices(some, weights, k=rng.randint(0, words)))
        out.append((body + rng.choice(["", "the same five words here again", " New york CITY"]), rng.choice(["en", "de", None, "und"])))
    return out


def table(spark, rows):
    clash = [(i, text, lang, "s", 0) for i, (text, lang) in enumerate(rows)]
    return spark.createDataFrame(clash, DOCS)


def answers(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


@pytest.mark.parametrize("budget, chunk, bits, pairs", [(1 << 20, 1 << 20, 1 << 23, 1 << 22), (64, 200, 1 << 12, 1 << 17), (8, 50, 64, 64)])
def test_equals_counting_all_phrases(spark, budget, chunk, bits, pairs):
    rows = texts(1, 300) + [("a a a a a a a", "en")] * 40 + [(None, "en"), ("", None), (" . ,", "en")]
    df = table(spark, rows).repartition(5)
    assert answers(df, least=20, budget=budget, chunk=chunk, bits=bits, pairs=pairs) == plain(rows, 20)


def test_all_counts(spark, partitions):
    rows = texts(2, 200)
    counts, totals = plain_counts(rows)
    known, n = collocations.counts(table(spark, rows), least=15, budget=50, chunk=100)
    got = {(r.lang, *r.phrase.split(" ")): r.n for r in known.collect()}
    assert got == {p: c for p, c in counts.items() if c >= 15}
    assert {r.lang: r.n for r in n.collect()} == {k: v for k, v in totals.items() if v}


def test_one_phrase_makes_up_the_corpus(spark):
    """A suffix that is repeated everywhere lies in a group of its own, as one row of each chunk."""
    rows = [("one two three four five six seven " * 30, "en")] * 100 + texts(3, 100)
    assert answers(table(spark, rows).repartition(4), least=50, budget=40, chunk=500) == plain(rows, 50)


def test_ties_and_limit(spark):
    rows = [(f"x{i} y{i}", "en") for i in range(12)] * 5 + [("b a. b c. B a", "en")] * 5
    for first in (3, 100):
        assert answers(table(spark, rows), least=5, first=first) == plain(rows, 5, first)


def test_large_products_are_exact(spark):
    big = spark.createDataFrame([(10**15 - 1, 10**15 + 7, 3 * 10**14 + 1, 7)], "a long, n long, l long, r long")
    got = big.select(collocations._ratio("a", "n", "l", "r").alias("x")).first().x
    assert got == 1000 * (10**15 - 1) * (10**15 + 7) // ((3 * 10**14 + 1) * 7) % 2**64 or got == 1000 * (10**15 - 1) * (10**15 + 7) // ((3 * 10**14 + 1) * 7)


def test_odd_rows_and_no_rows(odd_docs, no_docs):
    rows = [(r.text, r.lang) for r in odd_docs.select("text", "lang").collect()]
    assert answers(odd_docs, least=3) == plain(rows, 3)
    assert answers(no_docs) == []
