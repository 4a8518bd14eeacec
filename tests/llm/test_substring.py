"""Operator 9 against a plain search, and the consistency that it rests on."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strokeloom.llm import kernel, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    texts = [(-1 if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        out.append((None if d == -1 else d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


def corpus(rng, docs, vocabulary):
    word = lambda: f"v{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 55, 66, 80, 130]))] for _ in range(12)]
    passages += [["a"] * 70, ["a"] * 49 + ["b"], ["x", "y"] * 40, ["p"] * 3 + ["q"] * 2 + [word() for _ in range(46)] + ["q"] * 2, ["r", "r"] + [word() for _ in range(47)] + ["s"]]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += [word() for _ in range(rng.randrange(0, 60))]
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 1, 5])
            words += p[cut:] if rng.random() < 0.5 else p
        rows.append((i, "".join(w + rng.choice([" ", "\n", " \t"]) for w in words)))
    return rows


@pytest.mark.parametrize("vocabulary", [2, 30, 5000])
def test_removal_equals_a_plain_search(spark, vocabulary):
    rng = random.Random(vocabulary)
    rows = corpus(rng, 150, vocabulary)
    rows += [(900, None), (901, ""), (902, "\n \t"), (903, "few words"), (None, rows[3][1]), (904, "z " * 5000), (905, "z " * 49), (906, "z " * 50)]
    rows += [rows[7], (7, rows[8][1]), (950, rows[8][1]), (951, rows[8][1]), (960, " ".join(f"n{i}" for i in range(40_000)))]
    docs = spark.createDataFrame([(d, t, None, None, None, "e") for d, t in rows], SCHEMA).repartition(6)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.dedup(docs).collect())
    assert got == plain(rows)


def test_equal_substrings_are_parsed_alike_but_for_their_ends():
    rng = random.Random(6)
    for trial in range(400):
        vocabulary = rng.choice([2, 3, 20, 10**6])
        code = lambda n: [rng.randrange(vocabulary) + 1 for _ in range(n)]
        middle = code(50)
        if trial % 5 == 0:
            middle[:20] = [1] * 20
        seen = []
        for _ in range(2):
            before, after = code(rng.randrange(40)), code(rng.randrange(40))
            before += [middle[0]] * rng.randrange(3)
            after = [middle[-1]] * rng.randrange(3) + after
            words = np.array(before + middle + after, dtype=np.uint64)
            names, start, length = substring.parse(kernel.mix(words), np.zeros(len(words), np.int64))
            at = start - len(before)
            inside = (at + length > substring.MARGIN) & (at < 50 - substring.MARGIN)
            seen.append(list(zip(names[inside].tolist(), at[inside].tolist(), length[inside].tolist())))
            assert length.max() <= 16 and length.sum() == len(words)
        assert seen[0] == seen[1] and seen[0]


def test_symbols_stay_within_their_document():
    words = kernel.mix(np.ones(9, dtype=np.uint64))
    owner = np.repeat([0, 1, 2], 3)
    _, start, length = substring.parse(words, owner)
    assert all(owner[a] == owner[a + n - 1] for a, n in zip(start, length))


def test_names_stand_for_one_word_sequence():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 20_000).astype(np.uint64)
    names, start, length = substring.parse(kernel.mix(words), np.zeros(len(words), np.int64))
    meaning = defaultdict(set)
    for n, a, k in zip(names.tolist(), start.tolist(), length.tolist()):
        meaning[n].add(tuple(words[a : a + k].tolist()))
    assert all(len(m) == 1 for m in meaning.values()) and len(names) < 0.4 * len(words)


def test_keys_that_go_on_over_batches():
    key = np.array([2, 2, 2, 4, 4, 7], dtype=np.int64)
    node = np.array([1, 1, 5, 3, 3, 9], dtype=np.int64)
    place = np.array([10, 11, 12, 13, 14, 15], dtype=np.uint64)
    whole, _ = substring.decide_shared(key, node, place, None)
    assert whole.tolist() == [True, True, True, False, False, True]
    later, _ = substring.decide_later(key, node, place, None)
    assert later.tolist() == [False, False, True, False, False, True]
    _, begun = substring.decide_later(key[:3], node[:3], place[:3], None)
    assert substring.decide_later(np.array([2]), np.array([6]), np.array([1], dtype=np.uint64), begun)[0].tolist() == [True]
    _, begun = substring.decide_shared(key[:3], node[:3], place[:3], None)
    assert substring.decide_shared(np.array([2]), np.array([5]), np.array([1], dtype=np.uint64), begun)[0].tolist() == [True]


def test_empty_table(empty):
    assert substring.dedup(empty).count() == 0
