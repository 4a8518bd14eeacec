"""Operator 7 against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strokeloom.llm import jaccard
from strokeloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs; a None id counts as smallest."""
    sets = [(-1 if d is None else d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    back = lambda d: None if d == -1 else d
    return Counter((back(d), len(s), back(find(d))) for d, s in sets)


def corpus(rng, families, size, passage=None):
    rows, n = [], 0
    for _ in range(families):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice(size))]
        if passage and rng.random() < 0.7:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            own = list(words)
            for _ in range(rng.randrange(0, max(2, len(own) // 25))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((n, rng.choice([" ", "\n"]).join(own).upper() if rng.random() < 0.2 else " ".join(own)))
            n += 1
    return rows


@pytest.mark.parametrize("hot,size,passage", [(32, [3, 8, 20, 60, 200], 0), (2, [4, 6, 12, 30, 100], 40), (3, [150, 160, 400], 60)])
def test_components_equal_all_pairs(spark, hot, size, passage):
    rng = random.Random(hot)
    rows = corpus(rng, 60, size, [f"p{i}" for i in range(passage)]) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "One  two"), (None, "one two three four five"), (7, "a second text of seven which is linked with nothing")]
    rows += [rows[0], rows[0], (6000, rows[1][1]), (6001, rows[1][1] + " x"), (6002, "five " * 2000)]
    docs = spark.createDataFrame([(d, t, None, None, None, "e") for d, t in rows], SCHEMA).repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, hot).collect())
    assert got == plain(rows)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    misses = 0
    for _ in range(1500):
        n = int(rng.choice([1, 2, 3, 5, 8, 13, 30, 70, 200, 700]))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        keep = x[rng.random(len(x)) > rng.choice([0, 0.05, 0.12])]
        y = np.unique(np.concatenate([keep, rng.integers(0, 2**64, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)]))
        if not len(y) or not jaccard.near_enough(len(np.setxor1d(x, y)), len(x) + len(y)):
            continue
        bands = {jaccard.band_of(len(x)), jaccard.band_of(len(x)) - 1} & {jaccard.band_of(len(y)), jaccard.band_of(len(y)) - 1}
        shared = [b for b in bands if b >= 0 and min(len(x), len(y)) < jaccard.STARTS[b + 1]]
        assert shared
        ok = False
        for b in shared:
            for plan in (jaccard.Plan(int(rng.integers(1, 3 * n + 2)), bool(rng.integers(2))),):
                (sx, rx), (sy, ry) = jaccard.walk(x, b, plan), jaccard.walk(y, b, plan)
                ok |= bool(np.intersect1d(sx, sy).size) or min(rx, ry) < 0  # a set that ran out is done again
        misses += not ok
    assert misses == 0


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for n in (1, 10, 100, 5000, 80_000):
        for other in (1, n, 2 * n + 7):
            x, y = (np.unique(rng.integers(0, 2**64, k, dtype=np.uint64)) for k in (n, other))
            y = np.union1d(y, x[: n // 2])
            assert jaccard.sketch_distance(jaccard.sketch(x), jaccard.sketch(y)) <= len(np.setxor1d(x, y))
    assert jaccard.sketch_distance(jaccard.sketch(x), jaccard.sketch(x)) == 0


def test_shingle_sets_match_the_rule(odd_rows):
    texts = [r[1] for r in odd_rows]
    assert [len(s) for s in jaccard.shingle_sets(pa.array(texts, pa.string()))] == [len(shingles(t)) for t in texts]


def test_bounds_of_columns(spark):
    rows = [(n, b) for n in [*range(1, 60), 99, 100, 1333, 20_000] for b in (jaccard.band_of(n), jaccard.band_of(n) - 1) if b >= 0]
    got = spark.createDataFrame(rows, "n long, band int").select("n", "band", jaccard.bound_of(jaccard.F.col("n"), jaccard.F.col("band")).alias("h")).collect()
    assert all(r.h == jaccard.bound(r.n, r.band) for r in got)
    assert [r[0] for r in spark.range(200).select(jaccard.reserve_of(jaccard.F.col("id"))).collect()] == [jaccard.reserve(h) for h in range(200)]


def test_both_plans_are_chosen():
    assert jaccard.allocate(20, 10**10).deletions and not jaccard.allocate(20, 10**6).deletions


@pytest.mark.parametrize("per_task", [1 << 20, 50])
def test_components_of_chains_stars_and_nothing(spark, per_task):
    rng = random.Random(9)
    order = rng.sample(range(1000), 200)
    links = list(zip(order, order[1:])) + [(5000, 5000 + i) for i in range(1, 300)] + [(7000, 7000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(4), per_task=per_task).collect()}
    assert got == {x: min(order) for x in order} | {x: 5000 for x in range(5000, 5300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_stage_keeps_unlike_texts_of_one_id_and_one_of_null_ids(spark):
    rng = random.Random(9)
    text = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    rows = [(1, text[0]), (1, text[1]), (2, text[1]), (3, text[0] + " more"), (4, text[2]), (4, text[2]), (None, text[3]), (None, text[3]), (5, text[3]), (None, text[4]), (6, text[5]), (None, None), (None, None), (7, "")]
    docs = spark.createDataFrame([(d, t, "en", "a", 0, "x") for d, t in rows], SCHEMA).repartition(3)
    got = jaccard.stage(spark, docs, "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, text[0]), (1, text[1]), (4, text[2]), (None, text[3]), (None, text[4]), (6, text[5]), (None, None), (7, "")])
