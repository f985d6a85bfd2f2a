import math
import random
from collections import Counter

import pytest

from twinline.operators import scores


def reference_counts(rows):
    m, t, hyp_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for hyp, ref in rows:
        h, r = hyp.split(), ref.split()
        hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
        for n in range(1, 5):
            a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (h, r))
            m[n - 1] += sum((a & b).values())
            t[n - 1] += max(len(h) - n + 1, 0)
    return m, t, hyp_len, ref_len


def frame(spark, rows):
    return spark.createDataFrame([(str(i), h, r) for i, (h, r) in enumerate(rows)], "id string, hyp string, ref string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    say = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randrange(25)))
    return [(say(), say()) for _ in range(200)] + [("", "a b"), ("a b", ""), ("a a a a a", "a a")]


def test_counts(spark, corpus, partitions):
    row = scores.bleu_counts(frame(spark, corpus)).first()
    m, t, hyp_len, ref_len = reference_counts(corpus)
    assert tuple(row) == (*m, *t, hyp_len, ref_len)


def test_scores(spark, corpus):
    m, t, hyp_len, ref_len = reference_counts(corpus)
    penalty = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    plain = penalty * math.exp(sum(math.log(a / b) for a, b in zip(m, t)) / 4)
    assert scores.bleu_plain(frame(spark, corpus)).first().bleu == pytest.approx(plain)
    assert scores.bleu_sacre(frame(spark, corpus)).first().bleu == pytest.approx(100 * plain)


def test_equal_texts_score_full(spark, corpus):
    same = frame(spark, [(r, r) for _, r in corpus])
    assert scores.bleu_sacre(same).first().bleu == pytest.approx(100)
    plain = scores.bleu_plain(same).first()
    assert (plain.bleu, plain.brevity_penalty, plain.length_ratio) == pytest.approx((1, 1, 1))


@pytest.mark.parametrize(
    "rows, sacre",
    [
        ([("", "a b c d")], 0.0),
        ([("x y z w", "a b c d")], 0.0),
        ([("a b c", "a b c")], 0.0),
        ([("a x b y", "a b c d")], 100 * math.exp((math.log(2 / 4) + math.log(1 / 6) + math.log(1 / 8) + math.log(1 / 8)) / 4)),
        ([("a b x y z", "a b c d e")], 100 * math.exp((math.log(2 / 5) + math.log(1 / 4) + math.log(1 / 6) + math.log(1 / 8)) / 4)),
    ],
)
def test_smoothing(spark, rows, sacre):
    assert scores.bleu_sacre(frame(spark, rows)).first().bleu == pytest.approx(sacre)
    assert scores.bleu_plain(frame(spark, rows)).first().bleu == 0.0


def test_no_rows(spark):
    assert scores.bleu_sacre(frame(spark, [("a", "b")]).limit(0)).first().bleu == 0.0


def test_plan_shuffles_rows_once(spark, corpus):
    plan = scores.bleu_counts(frame(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2
