import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinline.llm import decontaminate, simhash
from twinline.llm.components import components

from .conftest import by_union, prose


def plain_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1150)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    roots = by_union(links)
    for node, root in roots.items():
        assert found.get(node, node) == root


def test_group(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = by_union(links)
    lowest = {}
    for i, r in enumerate(rows):
        root = roots.get(i, i)
        lowest[root] = min(x for x in (lowest.get(root), r.doc_id, 10**9) if x is not None)
    expected = sorted((r.doc_id or 0, f"{p:016x}", lowest[roots.get(i, i)]) for i, (r, p) in enumerate(zip(rows, prints)))
    found = simhash.group(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.fp.hex(), r.component) for r in found) == expected


@pytest.mark.parametrize("piece", [3, 40, 8192])
def test_links_connect_as_all_pairs_do(spark, piece):
    rng = np.random.default_rng(piece)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {0, (1 << 64) - 1}
    for c in centres.tolist() + [centres[0].item()] * 10:
        for _ in range(20):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            prints.add(c ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    frame = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in prints], "fp binary")
    found = simhash.links(frame, simhash.RING, piece).collect()
    pairs = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in found]
    exact = [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 4]
    assert by_union(pairs) == by_union(exact)


def test_leaders_of_a_large_bucket_lose_no_link():
    rng = np.random.default_rng(5)
    rows = []
    for centre in rng.integers(0, 256, (4, 8), dtype=np.uint8):
        for _ in range(60):
            bits = np.unpackbits(centre)
            bits[rng.choice(64, rng.integers(0, 6), replace=False)] ^= 1
            rows.append(np.packbits(bits))
    rows = np.unique(np.array(rows), axis=0)
    values = rows.view(">u8").ravel().tolist()
    exact = [(i, j) for i, j in combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 4]
    assert by_union(simhash._spanning(rows, simhash.RING)) == by_union(exact)


def edited(words, rng, share):
    words = list(words)
    for i in rng.sample(range(len(words)), int(len(words) * share)):
        words[i] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def firsts(rows):
    """The smallest key of every component of fingerprints that differ in 4 bits or fewer, by all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = by_union([(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4])
    first = {}
    for i, (key, _) in enumerate(rows):
        root = roots.get(i, i)
        first[root] = min(first.get(root, key), key)
    return sorted(first.values())


def test_keep_first_keeps_one_of_each_component(spark):
    rng, rows = random.Random(2), []
    for i in range(60):
        words = prose(100 + i, 200).split()
        rows.append((i, " ".join(words)))
        rows += [(1000 + 10 * i + k, edited(words, rng, share)) for k, share in enumerate((0.005, 0.01, 0.015, 0.2))]
    rows += [(5000, rows[0][1]), (5000, rows[0][1])]
    rng.shuffle(rows)
    kept = sorted(r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == firsts(rows)
    assert set(range(60)) <= set(kept) and 5000 not in kept and 60 < len(kept) < len(rows) - 30


def test_keep_first_of_a_large_group_of_copies(spark):
    rng, text = random.Random(8), prose(77, 400)
    rows = [(i, text if i % 3 else edited(text.split(), rng, 0.003)) for i in range(1500)] + [(9000, prose(78, 400))]
    kept = sorted(r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == firsts(sorted(set(rows)))


def test_rings_that_miss_links_are_refused():
    with pytest.raises(ValueError):
        simhash.Ring(segments=4, threshold=4, chain=4)


def test_keep_first_on_odd_rows(odd_docs, no_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    named = [(10**9 if k is None else k, t) for k, t in rows]
    assert sorted(10**9 if r.doc_id is None else r.doc_id for r in kept.select("doc_id").collect()) == firsts(named)
    assert simhash.keep_first(no_docs).count() == 0 and simhash.group(no_docs).count() == 0


def test_keep_first_keeps_one_of_equal_rows(spark):
    texts = [prose(50, 60), prose(51, 60), None, ""]
    rows = [(k, texts[k % 4]) for k in (0, 0, 1, 1, 2, 3, 3)] + [(None, prose(52, 60))] * 2
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "1", "2", "None"]


def test_overlaps(spark):
    rng = random.Random(9)
    items = [(i, prose(500 + i, n)) for i, n in enumerate((20, 40, 12, 60, 5, 1))] + [(10, None), (11, ""), (12, prose(500, 20))]
    rows, expected = [], set()
    for i in range(40):
        body = prose(900 + i, 150).split()
        at = rng.randrange(len(body))
        kind = i % 5
        if kind < 4:
            item = items[kind][1].split()
            part = list(item)
            for j in range(0, len(part), 6 if i >= 20 else 10**6):
                part[j] = "swapped"
            body[at:at] = [w.upper() + "," for w in part]
            expected.add((i, kind))
            if kind == 0:
                expected.add((i, 12))
        rows.append((i, " ".join(body)))
    rows += [(None, items[1][1]), (100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (103, items[4][1] + " !")]
    expected |= {(None, 1), (102, 3), (103, 4)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("row"), F.lit(2).alias("items"), F.lit(3).alias("check"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    found = decontaminate.overlaps(docs, bench).collect()
    short = {5}  # an item of one common word occurs by itself
    assert {(r.doc_id, r.item_id) for r in found if r.item_id not in short} == expected
    for r in found:
        assert r.share >= 0.8 and r.matches == round(r.share * r.length)
    kept = decontaminate.clean(docs, bench.filter("item_id <> 5"))
    dirty = {i for i, _ in expected}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in dirty)


def test_overlaps_of_nothing(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, prose(1, 120))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.overlaps(odd_docs, bench).collect()} == {1, 2, 3, 12, None}
    assert decontaminate.overlaps(no_docs, bench).count() == 0
    assert decontaminate.overlaps(odd_docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_ids_with_several_texts_and_items_without_one(spark):
    first, second, nameless = prose(81, 40), prose(82, 40), prose(83, 40)
    items = spark.createDataFrame([(1, first), (1, second), (None, nameless), (None, nameless), (2, None)], "item_id long, text string")
    bodies = {10: first, 11: second, 12: nameless, 13: prose(84, 40), 14: f"{second} {first}"}
    docs = spark.createDataFrame([(k, f"{prose(900 + k, 60)} {t}") for k, t in bodies.items()], "doc_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()]
    assert sorted(found, key=str) == sorted([(10, 1), (11, 1), (12, None), (14, 1)], key=str)
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [13]


def leaks(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r for r in found.collect()}


def test_overlaps_of_a_part_and_with_words_between(spark):
    sizes, rows, expected = (30, 59, 120, 300), [], set()
    items = [(k, prose(600 + k, n)) for k, n in enumerate(sizes)]
    for k, n in enumerate(sizes):
        words, body = items[k][1].split(), prose(640 + k, 200).split()
        inserted = [*words[: n // 3], "added", *words[n // 3 : 2 * n // 3], "added", *words[2 * n // 3 :]]
        dropped = [*words[: n // 2], *words[n // 2 + 1 :]]
        for j, part in enumerate((words[: n * 48 // 100], inserted, dropped, words[5:18], words[5:11])):
            rows.append((10 * k + j, " ".join([*body[:90], *part, *body[90:]])))
            if j < 4:
                expected.add((10 * k + j, k))
    found = leaks(spark, rows, items)
    assert set(found) == expected
    for k, n in enumerate(sizes):
        both = found[10 * k + 1, k]
        assert (both.start, both.length, both.matches) == (90, n + 2, n)


def test_masks_hit_whatever_is_substituted():
    for n in range(5, 31):
        made = decontaminate._masks(decontaminate.MASKS, [n])
        most = {"": 0}  # agreements without a hit, by the last four positions
        for _ in range(n):
            new = {}
            for last, count in most.items():
                for bit in "01":
                    tail = last + bit
                    if not any(all(tail[len(tail) - span + i] == "1" for i in offsets) for _, offsets, span in made if span <= len(tail)):
                        new[tail[-4:]] = max(new.get(tail[-4:], 0), count + int(bit))
            most = new
        assert max(most.values()) < decontaminate.SHARE * n


def test_overlaps_with_random_substitutions(spark):
    rng, items, rows = random.Random(6), [], []
    for n in (6, 8, 9, 10, 11, 12, 14, 15, 20, 25, 40, 59, 200):
        for j in range(10):
            key = 1000 * n + j
            words, body = prose(key, n).split(), prose(key + 500, 80).split()
            items.append((key, " ".join(words)))
            places = range(j % 5, n, 5) if j < 5 else rng.sample(range(n), n // 5)
            for i in list(places)[: n // 5]:
                words[i] = "swapped"
            rows.append((key, " ".join([*body[:40], *words, *body[40:]])))
    found = leaks(spark, rows, items)
    assert {(i, i) for i, _ in rows} <= set(found)


def exhaustive(text, item, share=0.8, least=8, cover=0.5, enough=13):
    """Whether a stretch of one diagonal is an overlap, by trying all of them."""
    doc, words = re.findall(r"\w+", text.lower()), re.findall(r"\w+", item.lower())
    for diagonal in range(-len(words) + 1, len(doc)):
        same = [0 <= i + diagonal < len(doc) and doc[i + diagonal] == w for i, w in enumerate(words)]
        total = np.concatenate([[0], np.cumsum(same)])
        inside = [i for i in range(len(words)) if 0 <= i + diagonal < len(doc)]
        for a in inside:
            for b in range(a + min(least, len(words)), inside[-1] + 2):
                agree, length = total[b] - total[a], b - a
                if agree >= share * length and (length >= cover * len(words) or agree >= enough):
                    return True
    return False


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("together", [1, 64])
def test_overlaps_equal_an_exhaustive_search(spark, monkeypatch, together):
    monkeypatch.setattr(decontaminate, "TOGETHER", together)
    rng, rows = random.Random(21), []
    items = [(k, prose(3000 + k, rng.choice((6, 9, 14, 25, 40)))) for k in range(14)]
    for i in range(40):
        body = prose(3100 + i, rng.choice((20, 60))).split()
        for _ in range(i % 3):
            words = rng.choice(items)[1].split()
            a, b = sorted(rng.sample(range(len(words) + 1), 2))
            part = words[a:b] if i % 2 else list(words)
            for j in rng.sample(range(len(part)), len(part) // rng.choice((3, 5, 8))):
                part[j] = "swapped"
            at = rng.randrange(len(body))
            body[at:at] = part
        rows.append((i, " ".join(body)))
    found = leaks(spark, rows, items)
    due = {(i, k) for i, text in rows for k, item in items if exhaustive(text, item)}
    assert 15 < len(due) < 300 and due <= set(found)
    texts, benchmark = dict(rows), dict(items)
    for (i, k), r in found.items():  # what is found beside is chained: its words agree in their order
        stretch = texts[i].split()[r.start : r.start + r.length]
        assert common(stretch, benchmark[k].split()) >= r.matches >= 0.8 * r.length


def test_a_phrase_that_all_items_and_documents_hold(spark):
    line = prose(4000, 20)
    items = [(k, f"{prose(4100 + k, 8)} {line}") for k in range(300)]
    rows = [(i, f"{prose(4500 + i, 30)} {line}") for i in range(20)] + [(100, prose(4600, 30))]
    assert set(leaks(spark, rows, items)) == {(i, k) for i in range(20) for k in range(300)}
