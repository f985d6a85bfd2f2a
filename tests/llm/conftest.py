import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = "an be co du er fo gi ha in jo ka le mo ne or pa qui ro sa tu ver wi xe yo zu".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def by_union(links):
    """Smallest node of the component of every node of the links."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def jaccard(a, b, n):
    a, b = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a, b))
    return len(a & b) / len(a | b)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties and repeated rows, and columns that clash with working names."""
    base = prose(1, 120)
    texts = [
        (1, base), (2, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \t\n"), (None, base), (None, None),
        (7, "one"), (8, "one two"), (9, prose(2, 60_000)), (10, "Ünïcödé  ＆ ﷽ 🎈 \u00a0x"), (11, "<|endoftext|> a  b\n\n c"),
        (12, base + " tail"), (13, "1234 !!"), (14, prose(3, 300)), (-5, prose(3, 300)),
    ]
    rows = [(i, t, "en" if i and i % 2 else None, "s", len(t or "")) for i, t in texts]
    clash = "key row check fp bucket cell piece block _key _own _hash _check n word base score text_ items ids".split()
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit("x").alias(c) for c in clash))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
