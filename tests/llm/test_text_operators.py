"""Operators 3, 4, 8, 10 and 1 against plain Python."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strokeloom.llm import fingerprint, jaccard, kernel, langid, linededup, mixing, packing, quality, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_hashes_agree_with_a_regular_expression(odd_rows):
    texts = [r[1] for r in odd_rows]
    data, offsets = kernel.text_bytes(pa.array(texts, pa.string()))
    words = kernel.Words(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(words.start, words.end)] == [w for t in texts for w in WORD.findall(t or "")]
    seen = {}
    for h, a, b in zip(words.hash.tolist(), words.start, words.end):
        assert seen.setdefault(h, raw[a:b]) == raw[a:b]
    assert len(seen) == len(set(seen.values()))
    at, hashes = words.windows(3)
    own = defaultdict(set)
    for i, h in zip(at.tolist(), hashes.tolist()):
        own[h].add(raw[words.start[i] : words.end[i + 2]].split().__repr__())
    assert all(len(v) == 1 for v in own.values())


def plain_counts(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


def test_quality_counts_and_base_rule(odd, odd_rows):
    got = quality.judge(odd).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = [plain_counts(r[1]) for r in odd_rows]
    assert sorted(list(r)[:5] for r in got) == sorted(want)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def plain_verdicts(rows, weight, reach):
    """The rules that fail, by row: quartiles by rank of values cut to seven bits, drawn to those of the language and of all."""
    made = [(r, dict(zip(quality.COUNTS, [*plain_counts(r[1]), sum(1 for x in (r[1] or "").split("\n") if WORD.search(x))]))) for r in rows]
    good = [(r, c) for r, c in made if not (c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"])]

    def quartile(some, top, bottom, k):
        values = []
        for c in some:
            v = 1024 * c[top] // c[bottom] if c[bottom] else 0
            cut = max(v.bit_length() - 7, 0)
            values.append(v >> cut << cut)
        return sorted(values)[-(-k * len(values) // 4) - 1]

    out = []
    for r, c in made:
        fails = []
        for rule, (top, bottom, allowance, both) in quality.RULES.items():
            own, lang, everyone = ([c2 for r2, c2 in good if r2[2 : 2 + k] == r[2 : 2 + k]] for k in (2, 1, 0))
            if not own:
                continue
            q = []
            for k in (1, 3):
                one, two, three = (quartile(x, top, bottom, k) for x in (own, lang, everyone))
                two = (len(lang) * two + weight * three) / (len(lang) + weight)
                q.append((len(own) * one + weight * two) / (len(own) + weight))
            spread, slack = reach * (q[1] - q[0]), allowance * 1024 * c[bottom] ** 0.5
            over, under = c[top] * 1024 - (q[1] + spread) * c[bottom], (q[0] - spread) * c[bottom] - c[top] * 1024
            if over > slack + 1e-6 or (both and under > slack + 1e-6):
                fails.append(rule)
        out.append((r[0], tuple(fails)))
    return out


@pytest.mark.parametrize("weight,reach", [(100, 3), (1, 0), (10_000, 1)])
def test_quality_verdicts(odd, odd_rows, weight, reach):
    rows = [r for r in odd_rows if len(r[1] or "") < 20_000] + [(900 + i, "# " * (7 * i) + " ".join(f"a{j}{'bcdef'[: (i + j) % 6]}" for j in range(40)), "en", "a", None, None) for i in range(6)]
    docs = odd.sparkSession.createDataFrame(rows, odd.schema).repartition(3)
    got = quality.judge(docs, weight, reach).select("doc_id", "failed_rules", "base_failed", "kept").collect()
    assert Counter((r[0], tuple(r[1])) for r in got) == Counter(plain_verdicts(rows, weight, reach))
    assert all(r.kept == (not r.base_failed and not r.failed_rules) for r in got) and any(r.failed_rules for r in got)


def test_every_quality_rule_fires_and_fences_follow_the_source(spark, empty):
    """Two sources of unlike spread: the same page fails in the even one and is kept in the uneven one, and all pass the base rule."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    line = lambda n: " ".join(word(rng.randrange(3, 8)) for _ in range(n))

    def page(length=0, symbols=0, dup=0, repeats=0):
        lines = [line(5) for _ in range(60)]
        lines += lines[:dup:2]
        rng.shuffle(lines)
        lines += [" ".join(word(length) for _ in range(300))] if length else []
        lines += [" ".join(word(4) + "#" for _ in range(symbols))] if symbols else []
        run = line(12)
        lines += [f"{run} {word(9)}" for _ in range(repeats)]
        return "\n".join(lines)

    planted = {"word_length": {"length": 15}, "symbols": {"symbols": 150}, "dup_lines": {"dup": 40}, "repeats": {"repeats": 9}}
    rows = [(i, page(), "en", "even", 0, None) for i in range(300)]
    for i in range(300):
        some = {"length": rng.choice([0, 9, 12, 15]), "symbols": rng.choice([0, 0, 100, 200]), "dup": rng.choice([0, 0, 30, 50]), "repeats": rng.choice([0, 0, 6, 9])}
        rows.append((1000 + i, page(**some), "en", "uneven", 0, None))
    for k, (rule, how) in enumerate(planted.items()):
        text = page(**how)
        rows += [(5000 + k, text, "en", "even", 0, None), (6000 + k, text, "en", "uneven", 0, None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, empty.schema).repartition(4)).collect()}
    for k, rule in enumerate(planted):
        assert not got[5000 + k].base_failed and rule in got[5000 + k].failed_rules and not got[5000 + k].kept
        assert rule not in got[6000 + k].failed_rules
    assert all(got[i].kept for i in range(300))


def test_language_held_out_accuracy_and_undetermined(spark):
    rng = random.Random(1)
    parts = {"xa": ["ka", "lo", "mi", "ré"], "xb": ["the", "ing", "st", "wh"], "xc": ["ß", "ch", "ei", "un"]}
    rows = [(i, " ".join("".join(rng.choices(parts[x], k=3)) for _ in range(30)) + " 123 #", x) for i in range(300) for x in [rng.choice(sorted(parts))]]
    odd = [(1000, None, "xa"), (1001, "", "xb"), (1002, "12 !? \0", None), (None, "thingst whing", None), (3, "kalomi", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs.filter(~langid.held_out()))
    got = langid.predict(docs.withColumn("held", langid.held_out()), model).collect()
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"} and all(r.score == 0 for r in got if r.lang_pred == "und")
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 40 and all(r.held for r in held) and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and next(r for r in got if r.doc_id is None).lang_pred == "xb"


def test_language_without_training_rows(odd, empty):
    model = langid.fit(empty)
    assert {(r.lang_pred, r.score) for r in langid.predict(odd.select("doc_id", "text"), model).collect()} == {("und", 0.0)}
    assert langid.predict(empty, model).count() == 0


def test_language_scores_equal_a_plain_sum():
    """Log posterior of one text, gram by gram."""
    buckets, orders = 64, (1, 2)
    rng = np.random.default_rng(0)
    model = langid.Model(("p", "q"), np.log([0.25, 0.75]), np.log(rng.random((buckets, 2))).astype(np.float32))
    text = "Ab1 é-"
    codes = [ord(c) for c in "ab é "]
    bucket = lambda g: int(kernel.mix(np.array([sum((c * int(kernel.POSITION_CODES[k + 1]) for k, c in enumerate(g))) % 2**64], dtype=np.uint64))[0] % np.uint64(buckets))
    log = model.prior.copy()
    for g in [[c] for c in codes if c != 32]:
        log = log + model.weight[bucket(g)].astype(float)
    for g in zip(codes, codes[1:]):
        log = log + model.weight[bucket(g)].astype(float)
    p = np.exp(log - log.max())
    lang, score = langid.score(model, [text], orders)
    assert lang == [model.langs[int(p.argmax())]] and abs(score[0] - p.max() / p.sum()) < 1e-6


def test_language_takes_little_memory_and_frees_the_encoder():
    """Texts of 3 MB pass through a worker in slices, which change no result, and packing's encoder is gone from it."""
    rng = random.Random(6)
    texts = [" ".join(f"{rng.choice('#éЖx')}w{rng.randrange(40)}" for _ in range(rng.randrange(1, 1500))) for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(rng.choices("pq", k=len(texts))), pa.array(texts)], names=["lang", "text"])
    assert batch.nbytes > 2_000_000
    orders, model = (1, 2, 3), langid.Model(("p", "q"), np.log([0.25, 0.75]), np.random.default_rng(0).random((1 << 13, 2)).astype(np.float32))
    for run in (lambda: langid.counted(iter([batch]), 1 << 13, orders), lambda: langid.scored(iter([batch]), model, orders)):
        packing.encoder_of(packing.default_tokenizer())
        tracemalloc.start()
        got = pa.Table.from_batches(list(run()))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6 and packing.encoder_of.cache_info().currsize == 0
    lang, p = langid.score(model, texts, orders)
    assert got["lang_pred"].to_pylist() == lang and got["score"].to_pylist() == p.tolist()


def test_language_model_counts_every_gram(spark):
    """The fitted weights are the smoothed shares of all grams of all rows, and predictions follow from them."""
    texts = [("ab cab", "p"), ("abc", "p"), ("bcd bcd", "q"), (None, "q"), ("ab", None), ("", "q")]
    buckets, orders = 16, (1, 2)
    model = langid.fit(spark.createDataFrame(texts, "text string, lang string").repartition(3), buckets, orders)
    counted = {x: np.zeros(buckets) for x in "pq"}
    for text, lang in texts:
        if text and lang:
            for _, gram in langid.grams([text], buckets, orders)[0]:
                np.add.at(counted[lang], gram, 1)
    assert model.langs == ("p", "q")
    for k, lang in enumerate("pq"):
        share = (counted[lang] + 0.5) / (counted[lang].sum() + 0.5 * buckets)
        assert np.allclose(model.weight[:, k], np.log(share), atol=1e-5)
    assert np.allclose(model.prior, np.log([2 / 4, 2 / 4]))


def plain_edit(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_fingerprints_of_texts_and_edits(spark, odd_rows, partitions):
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").repartition(5)
    got = fingerprint.with_next(docs, partitions).mapInArrow(fingerprint.pairs, fingerprint.SCHEMA).collect()
    rows = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    one = lambda t: fingerprint.text_form(*fingerprint.vectors(*kernel.text_bytes(pa.array([t]))))[0]
    want = [(d, len(t), hashlib.sha256((e := plain_edit(t, rows[(i + 1) % len(rows)][1])).encode()).hexdigest(), one(t), one(e)) for i, (d, t) in enumerate(rows)]
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def fingerprint_of(text):
    return fingerprint.text_form(*fingerprint.vectors(*kernel.text_bytes(pa.array([text]))))[0]


def plain_fingerprint(text):
    """Paragraph by paragraph, lane by lane, in Python's whole numbers."""
    hash_of = lambda b: int(kernel.span_hash(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    mix = lambda x: int(kernel.mix(np.array([x % 2**64], dtype=np.uint64))[0])
    strong, counting = [0] * fingerprint.STRONG, [0] * fingerprint.LANES
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words:
            continue
        paragraph = hash_of(line.strip(" \t\r\x0b\x0c").encode())
        for k, key in enumerate(fingerprint.STRONG_KEYS.tolist()):
            strong[k] = (strong[k] + mix(paragraph ^ key)) % 2**64
        codes, seen = [hash_of(w.encode()) for w in words], Counter()
        runs = [mix(sum(codes[i + t] * int(kernel.POSITION_CODES[t]) for t in range(3))) for i in range(len(words) - 2)]
        for r in runs if len(words) > 2 else [mix(paragraph)]:
            seen[r] += 1
            name = r if seen[r] == 1 else mix(r + (seen[r] - 1) * int(fingerprint.AGAIN_KEY))
            counting[name % fingerprint.LANES] += -1 if name >> 63 else 1
    return b"".join(x.to_bytes(8, "little") for x in strong).hex() + b"".join((x % 2**16).to_bytes(2, "little") for x in counting).hex()


def test_fingerprints_equal_plain_sums(odd_rows):
    texts = [r[1] or "" for r in odd_rows if len(r[1] or "") < 3000] + ["a b c a b c a b c\n\n a b c \na b c", "x\ny\nx"]
    assert [fingerprint_of(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_fingerprint_is_a_homomorphic_multiset_hash():
    a, b, c = "alpha beta gamma delta", "one two", "one two"
    assert fingerprint_of(f"{a}\n{b}") == fingerprint_of(f"{b}\n\n{a}") != fingerprint_of(f"{b} {a}")
    assert fingerprint_of(f"{b}\n{c}") != fingerprint_of(b)
    assert fingerprint.combine(fingerprint_of(a), fingerprint_of(b)) == fingerprint_of(f"{a}\n{b}")
    assert fingerprint.combine(fingerprint_of(f"{a}\n{b}"), fingerprint_of(b), -1) == fingerprint_of(a)
    assert set(fingerprint_of("")) == {"0"} and fingerprint.combine(fingerprint_of(""), fingerprint_of(c)) == fingerprint_of(c)


def test_likeness_is_near_that_of_the_runs():
    """The error against the exact likeness of run counts: 0.05 at one standard deviation, three at most of 200."""
    rng, errors = random.Random(2), []
    lanes = lambda t: fingerprint.vectors(*kernel.text_bytes(pa.array([t])))[1]

    def runs(text):
        out = Counter()
        for line in text.split("\n"):
            words, seen = line.split(), Counter()
            for r in zip(words, words[1:], words[2:]):
                seen[r] += 1
                out[r, seen[r]] += 1
        return out

    for k in range(200):
        words = [f"t{rng.randrange([30, 10**6][k % 2])}" for _ in range(rng.randrange(20, 800))]
        cut = rng.randrange(len(words))
        other = words[:cut] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 800))]
        layout = lambda x: "".join(w + rng.choice("      \n") for w in x)
        a, b = layout(words), layout(other)
        x, y = runs(a), runs(b)
        dot, xx, yy = sum(n * y[r] for r, n in x.items()), sum(n * n for n in x.values()), sum(n * n for n in y.values())
        if xx + yy > dot:
            errors.append(abs(fingerprint.likeness(lanes(a), lanes(b))[0] - dot / (xx + yy - dot)))
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and max(errors) < 0.15
    assert fingerprint.likeness(lanes(a), lanes(a))[0] == 1


@pytest.mark.parametrize("points", [1, 2, 3, 10, 50])
def test_ranks_among_split_points(spark, points):
    cuts = sorted(random.Random(points).sample(range(100), points))
    got = spark.range(-1, 101).select(F.col("id").alias("doc_id")).select("doc_id", fingerprint.rank(cuts).alias("r")).collect()
    assert all(r.r == sum(c <= r.doc_id for c in cuts) for r in got)


def test_fingerprints_of_an_empty_and_a_single_row_table(spark, empty):
    assert fingerprint.with_edits(empty).count() == 0
    row = fingerprint.with_edits(spark.createDataFrame([(1, "ab cd", None, None, None, None)], empty.schema)).collect()
    assert len(row) == 1 and row[0].edited_sha256 == hashlib.sha256(plain_edit("ab cd", "ab cd").encode()).hexdigest()


def plain_targets(sizes):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = set()
    while True:
        left, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * weight[s] > 3 * sizes[s] * w}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        capped |= over


def test_mixing_targets_rates_and_reruns(odd, odd_rows):
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = plain_targets(sizes)
    got = mixing.plan(odd).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.plan(odd.repartition(7)).collect()))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in odd_rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        rate = r.target / r.source_size
        assert r.copies in (int(rate), int(rate) + 1) or abs(rate - round(rate)) < 1e-9


def test_mixing_draws_of_equal_ids_follow_the_text(spark, empty):
    rows = [(i % 40, f"w{i} two three", None, "ab"[i % 2], None, None) for i in range(400)]
    draws = lambda d: Counter(tuple(r) for r in mixing.mix(d).select("doc_id", "text").collect())
    first = draws(spark.createDataFrame(rows + rows[:50], empty.schema).repartition(3))
    assert first == draws(spark.createDataFrame((rows + rows[:50])[::-1], empty.schema).repartition(7))
    assert all(first[r[0], r[1]] % 2 == 0 for r in rows[:50])  # equal rows draw alike
    assert any(len({first[d, t] for d, t, *_ in rows[50:] if d == k}) > 1 for k in range(40))  # unlike texts do not


def test_mixing_comes_near_targets(spark, empty):
    """Within two documents' words of the target, and chances near the fraction of the rate."""
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), None, rng.choice("abcde"), None, None) for i in range(4000)]
    taken, target, one_more, count = Counter(), {}, Counter(), Counter()
    for r in mixing.plan(spark.createDataFrame(rows, empty.schema)).collect():
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        rate = r.target / r.source_size
        one_more[r.source] += r.copies - int(rate) - rate % 1
        count[r.source] += 1
    assert len(target) == 5 and all(abs(taken[s] - target[s]) < 120 for s in target)
    assert all(abs(one_more[s]) <= 3 * count[s] ** 0.5 for s in target)


def test_mixing_caps_small_sources(spark, empty):
    rows = [(i, "w " * 50, None, s, None, None) for i, s in enumerate(["a"] * 200 + ["b"] * 4 + ["c"] * 2 + [None] * 40)] + [(999, "", None, "d", None, None)]
    docs = spark.createDataFrame(rows, empty.schema)
    sizes = {"a": 10_000, "b": 200, "c": 100, None: 2000, "d": 0}
    planned = mixing.plan(docs).collect()
    want = plain_targets(sizes)
    assert want["b"] == 600 and want["c"] == 300
    taken = Counter()
    for r in planned:
        taken[r.source] += r.copies * r.size
        assert abs(r.target - want[r.source]) < 1e-6
    assert taken["b"] == 600 and taken["c"] == 300 and taken["d"] == 0 and abs(taken["a"] - want["a"]) < 0.15 * want["a"]
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in planned if r.copies} | {999: 1})
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def plain_dedup(rows, min_sites, min_chars):
    strip = lambda x: x.strip(" \t\r\f\x0b")
    sites = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            sites[strip(line)].add(r[3])
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        lines = r[1].split("\n")
        kept = [x for x in lines if not (len(strip(x)) >= min_chars and len(sites[strip(x)]) >= min_sites)]
        if 2 * sum(len(strip(x)) for x in kept) < sum(len(strip(x)) for x in lines):
            kept = lines
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("min_sites", [2, 4, 9])
def test_line_dedup(spark, odd_rows, min_sites):
    rng = random.Random(7)
    common = [f"common line number {i}" for i in range(6)] + ["Home"]
    rows = [r[:4] + (None, "z") for r in odd_rows]
    for i in range(120):
        body = [f"own line {i} {j} " + "x" * rng.randrange(30) for j in range(rng.randrange(1, 5))]
        body += [" " + c + "\t\r" for k, c in enumerate(common) if rng.random() < 0.3 and i % 20 < 3 * k + 1]
        rng.shuffle(body)
        rows.append((500 + i, "\n".join(body), "en", f"s{i % 20}" if i % 20 else None, None, "z"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").repartition(4)
    got = linededup.dedup(docs, min_sites=min_sites)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "extra", "text", "n_lines", "n_removed"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == Counter(plain_dedup(rows, min_sites, linededup.MIN_CHARS))


def test_line_dedup_counts_exactly_where_sketches_are_unsure(spark):
    """With a sketch of 16 registers estimates are off by a quarter, the results are not."""
    rows = [(s * 100 + n, "a line of its own for this page, long enough\n" + "\n".join(f"shared by {k} sites" for k in range(36, 45) if s < k), None, f"site{s}", None, None) for s in range(60) for n in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    found = linededup.boilerplate(docs, min_sites=40, band=0.8, lg_k=4)
    keys = docs.sparkSession.createDataFrame([(f"shared by {k} sites",) for k in range(36, 45)], "line string").select("line", linededup.key(F.col("line")).alias("k")).select("line", "k.h1", "k.h2")
    assert {r.line for r in keys.join(found, ["h1", "h2"]).collect()} >= {f"shared by {k} sites" for k in range(40, 45)}
    assert not {r.line for r in keys.join(found, ["h1", "h2"]).collect()} & {f"shared by {k} sites" for k in range(36, 40)}


def test_pipeline_lines_takes_short_lines_of_many_sites(spark, empty):
    rows = [(i, f"a page of its own, with number {i}\nHome\n\n ok \nfew{i % 7}", "en", f"s{i % 20}", 0, "z") for i in range(40)]
    rows.append((99, "some other page without common lines\nfew0\n\n", "en", "s0", 0, "z"))
    got = linededup.stage(spark, spark.createDataFrame(rows, empty.schema).repartition(3), "").collect()
    want = plain_dedup([r[:4] for r in rows if r[0] != 99] + [rows[-1][:4]], linededup.MIN_SITES, 1)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, _, _ in want)
    texts = {r.doc_id: r.text for r in got}
    assert texts[0] == "a page of its own, with number 0\n\nfew0" and texts[99] == rows[-1][1]


def test_line_dedup_of_an_empty_table(empty):
    assert linededup.dedup(empty).count() == 0 and quality.judge(empty).count() == 0


def test_extra_columns_with_clashing_names(odd):
    clash = odd.selectExpr("*", "1 AS n_lines", "2 AS n_removed", "3 AS _drop", "4 AS size", "5 AS lang_pred", "6 AS score", "7 AS n_words", "8 AS kept", "9 AS target", "10 AS copies")
    assert linededup.dedup(clash).select("n_lines", "n_removed").count() == odd.count()
    assert quality.judge(clash).count() == odd.count() and mixing.plan(clash).count() == odd.count()
    assert mixing.mix(clash).columns == clash.columns
    assert langid.predict(clash, langid.fit(clash)).select("lang_pred", "score").count() == odd.count()
    assert fingerprint.with_edits(clash).count() == odd.count()
    more = odd.selectExpr("*", "1 AS node", "2 AS text_hash", "3 AS n", "4 AS sig", "5 AS key", "6 AS place", "7 AS run", "8 AS component_id", "9 AS n_removed", "10 AS sequence_id", "11 AS held_out", "12 AS _draw", "13 AS _row")
    assert jaccard.near_duplicates(more).count() == substring.dedup(more).count() == fingerprint.with_edits(more).count() == odd.count()
    assert packing.pack(more).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert mixing.mix(more).columns == more.columns and all(s(odd.sparkSession, more, "").columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in (linededup.stage, jaccard.stage, mixing.stage, langid.stage))
