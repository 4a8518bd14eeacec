"""Every stage of the pipeline against plain Python, on what the stage before kept."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from test_jaccard import plain as plain_components
from test_text_operators import WORD, plain_dedup, plain_targets

from strokeloom import runtime
from strokeloom.llm import langid, linededup, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(4)
    parts = {"xa": ["ka", "lo", "mi", "ré"], "xb": ["the", "ing", "st", "wh"]}
    rows = []
    common = ["all rights reserved by nobody at all", "read more about this on the next page"]
    for i in range(150):
        lang = rng.choice(sorted(parts))
        line = lambda: " ".join("".join(rng.choices(parts[lang], k=rng.randrange(2, 5))) for _ in range(rng.randrange(5, 15)))  # noqa: E731, B023
        lines = [line() for _ in range(rng.randrange(2, 9))] + [c for c in common if rng.random() < 0.3]
        rows.append((i, "\n".join(lines), lang, f"s{i % 12}", 0))
    for i in range(30):
        words = rows[i][1].split(" ")
        words[rng.randrange(len(words))] = "kalo"
        rows.append((200 + i, " ".join(words), rows[i][2], f"s{i % 12}", 0))
    return rows + [(300, None, "xa", "s1", None), (301, "12 ?!", "xb", None, 5), (302, "", None, "s2", 0), rows[0]]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = runtime.table(stage(spark, docs, str(tmp_path)))
        results.append((name, docs))
        if name != "packing":
            assert docs.columns == COLUMNS
    language, lines, near, mixed, packed = ([tuple(r) for r in d.collect()] for _, d in results)

    labelled = spark.read.parquet(f"{tmp_path}/documents.parquet").filter(~langid.held_out())
    model = langid.fit(labelled)
    predicted = langid.score(model, [r[1] for r in rows], (1, 2, 3))[0]
    assert Counter((r[0], r[1], r[2]) for r in language) == Counter((r[0], r[1], p) for r, p in zip(rows, predicted) if p != "und")

    want = plain_dedup([(r[0], r[1], r[2], r[3]) for r in language], linededup.MIN_SITES, linededup.MIN_CHARS)
    assert Counter((r[0], r[1], r[4]) for r in lines) == Counter((d, t, len(t or "")) for d, t, _, _ in want)
    assert any(removed for *_, removed in want)

    groups = {d: c for d, _, c in plain_components([(r[0], r[1]) for r in lines])}
    assert sorted(r[0] for r in near) == sorted({d for d, c in groups.items() if d == c}) and len(near) < len(lines) - 5

    sizes = defaultdict(int)
    for r in near:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets = plain_targets(sizes)
    taken, copies = Counter(), Counter(r[0] for r in mixed)
    for r in mixed:
        taken[r[3]] += len(WORD.findall(r[1] or ""))
    assert all(n <= 3 for n in copies.values()) and abs(sum(taken.values()) - sum(targets.values())) < 0.15 * sum(targets.values())
    planned = {r.doc_id: r.copies for r in mixing.plan(results[2][1]).collect()}
    assert copies == Counter({d: n for d, n in planned.items() if n})

    ends = Counter()
    for doc_id, start, length, _, total, _, _ in packed:
        ends[doc_id] += start + length == total
    assert ends == copies
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()).keys() == Counter(r[:5] for r in packed).keys()
