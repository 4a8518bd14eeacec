"""Operator 5: ids against the tokenizer itself, and the rules of packing."""

from collections import defaultdict

import numpy as np
import pytest

from strokeloom.llm import packing

ODD = ["", "Don't STOP, it's we'll ÉCOLE straße ß 12.5%", "a\x1cb \x85 c\xa0d", "<|endoftext|> x<|startoftext|>", "é ́x ﬁ ½ 日本語 text Σας İx", "tab\tnew\nline\x0b\x0c", "x" * 3000, "!!??--\x00 \x7f", " lead", "trail ", "Ÿ ÿ µ º"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_ids_are_the_tokenizers(tokenizer, odd_rows):
    texts = ODD + [r[1] or "" for r in odd_rows]
    got = packing.Encoder(packing.default_tokenizer()).texts([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_with_tiny_tables_and_blocks(tokenizer, odd_rows, monkeypatch):
    monkeypatch.setattr(packing, "TABLE_ENTRIES", 5)
    monkeypatch.setattr(packing, "BLOCK_BYTES", 64)
    texts = ODD + [r[1] or "" for r in odd_rows[:30]]
    got = packing.Encoder(packing.default_tokenizer()).texts([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check_rules(rows, expected, length):
    """expected: per document the ids; rows of pieces."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length > 0
        docs[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    found = []
    for doc_id, pieces in docs.items():
        for total in {p[2] for p in pieces}:
            found.append((doc_id, sorted(p[:2] for p in pieces if p[2] == total), total))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == length or (at < length and at & (at - 1) == 0)
    return found


def test_every_id_lies_in_one_piece(odd, odd_rows, tokenizer):
    rows = packing.pack(odd, length=256).collect()
    check_rules(rows, None, 256)
    want = defaultdict(list)
    for r in odd_rows:
        want[r[0]].append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])
    assert sum(r.length for r in rows) == sum(len(x) for v in want.values() for x in v)
    for doc_id, copies in want.items():
        if len(copies) == 1:
            pieces = sorted((r.start, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in rows if r.doc_id == doc_id)
            assert sum((p for _, p in pieces), []) == copies[0] and [s for s, _ in pieces] == np.cumsum([0, *(len(p) for _, p in pieces)])[:-1].tolist()
            assert {r.doc_tokens for r in rows if r.doc_id == doc_id} == {len(copies[0])}


def plainly_packed(documents, length):
    """Sequences of (document, start, tokens) by the rules, one token count at a time; documents: (name, tokens)."""
    done, rest = [], []
    for name, n in documents:
        at = 0
        while n - at >= length:
            done.append([(name, at, length)])
            at += length
        if n > at:
            rest.append((name, at, n - at))
    total = sum(n for *_, n in rest)
    rooms = [length] * (total // length)
    k = length
    while k:
        if total % length & k:
            rooms.append(k)
        k //= 2
    price = lambda n: n + n * n / 2048
    made, used, cost, over = [[] for _ in rooms], [0] * len(rooms), [0.0] * len(rooms), []
    for name, at, n in sorted(rest, key=lambda x: -x[2]):
        best = None
        for s, room in enumerate(rooms):
            if used[s] + n <= room and (best is None or cost[s] < cost[best]):
                best = s
        if best is None:
            over.append((name, at, n))
        else:
            made[best].append((name, at, n))
            used[best] += n
            cost[best] += price(n)
    for s in sorted(range(len(rooms)), key=lambda s: cost[s]):
        while used[s] < rooms[s]:
            name, at, n = over.pop(0)
            take = min(n, rooms[s] - used[s])
            made[s].append((name, at, take))
            used[s] += take
            if take < n:
                over.insert(0, (name, at + take, n - take))
    assert not over
    return done + made


@pytest.mark.parametrize("seed", range(6))
def test_packer_equals_a_plain_one(seed):
    rng = np.random.default_rng(seed)
    documents = [(i, int(n)) for i, n in enumerate(rng.integers(1, [20, 40, 200][seed % 3], 60))] + [(100 + i, 7) for i in range(9)]
    packer, got = packing.Packer(length=32), []
    for name, n in documents:
        got += packer.add(packing.Piece(name, 0, np.arange(n), n))
    got += packer.pack(last=True)
    assert [[(p.doc_id, p.start, len(p.ids)) for p in s] for s in got] == plainly_packed(documents, 32)
    assert all(p.ids.tolist() == list(range(p.start, p.start + len(p.ids))) for s in got for p in s)


def test_pieces_go_to_the_least_cost_with_room():
    packer = packing.Packer(length=16)
    for i, n in enumerate([9, 8, 8, 7, 5, 4, 3, 3, 1]):
        assert not list(packer.add(packing.Piece(i, 0, np.arange(n), n)))
    assert [[(p.doc_id, len(p.ids)) for p in s] for s in packer.pack(last=True)] == [[(0, 9), (5, 4), (7, 3)], [(1, 8), (3, 7), (8, 1)], [(2, 8), (4, 5), (6, 3)]]


def test_table_is_packed_as_by_the_plain_one(spark, odd_rows, tokenizer):
    rows = [(i, r[1], "clash") for i, r in enumerate(odd_rows) if len(r[1] or "") < 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").coalesce(1)
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    want = plainly_packed([(d, len(ids[d])) for d, _, _ in rows], 64)
    found = packing.pack(docs, length=64).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        got.setdefault(r.sequence_id, []).append((r.doc_id, r.start, r.length))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
    assert list(got.values()) == want


def test_tail_and_long_documents():
    packer = packing.Packer(length=8)
    out = list(packer.add(packing.Piece(1, 0, np.arange(30), 30)))
    assert [s[0].start for s in out] == [0, 8, 16] and packer.tokens == 6
    assert list(packer.pack()) == [] and packer.tokens == 6
    tail = list(packer.pack(last=True))
    assert [sum(len(p.ids) for p in s) for s in tail] == [4, 2] and packer.tokens == 0


def test_empty_table(empty):
    assert packing.pack(empty).count() == 0
