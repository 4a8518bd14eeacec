"""Tokenising and cost-balanced packing into fixed-length training sequences (operator 5).

Every input partition is packed on its own, in chunks of about ``CHUNK_TOKENS`` tokens as rows
stream by, so nothing is shuffled and memory is bounded by a chunk. Within a chunk a document's
full stretches of ``length`` tokens are sequences already; what is left of each document is one
piece, with the estimated cost ``linear * n + quadratic * n**2`` of computing on it. Pieces in
descending order go to the sequence of least cost that has room. Pieces that fit nowhere are cut
into the gaps, so all sequences of a chunk are full; what is over goes on to the next chunk, and at
the end of the partition into sequences of 2**k tokens, which need no padding.

Tokens come from a ``tokenizers`` file, whose path is a parameter. Its splitter never joins
characters across ASCII white space, so a word is given to the tokenizer once and looked up from
then on, all words of a block together, in a sorted table of 64-bit word hashes. The table is
bounded in words (``TABLE_ENTRIES``, some 30 MB) and stays with the Python worker, as the tokenizer
does, until it turns to another operator. Long texts go through block by block, cut at white space.

Defined results: a null or empty text is the end token alone. Repeated rows are documents of their
own. Pieces of equal size keep the order of their rows, and of sequences of equal cost the first
made is taken. A text may be as long as a string can be; it is cut into as many sequences as it
fills. An empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeloom import runtime
from strokeloom.llm import kernel

CHUNK_TOKENS = 1 << 20
TABLE_ENTRIES = 1_000_000
BLOCK_BYTES = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTable:
    """Token ids by word hash: sorted keys, and for each where its ids lie in one flat array.

    A table of ``TABLE_ENTRIES`` words takes some 30 MB; one that would grow beyond is begun anew.
    """

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=self.dtype)
        self.count = np.zeros(0, dtype=np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ascending keys, and whether they are there."""
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return at, there

    def add(self, keys: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        """Put in ascending keys that are not there yet, with their ids in a row."""
        first = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.count, at, count)


def gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The spans of flat that begin at first and hold count values, in a row."""
    upto = np.cumsum(count)
    return flat[np.repeat(first - upto + count, count) + np.arange(upto[-1] if len(upto) else 0)]


class Encoder:
    """Token ids of texts given as bytes, as uint16 or uint32 arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        drops = any(p["type"] == "Split" and p.get("invert") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []))
        lowers = any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        if not (drops and lowers):
            raise ValueError(f"{path} is not a lower-casing tokenizer that drops white space between words")
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if len(vocabulary) < 1 << 16 else np.dtype("<u4")
        suffix = (spec.get("model") or {}).get("end_of_word_suffix") or "\0"
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.table = WordTable(self.dtype)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, in a row, and the number of each.

        Many are given to the tokenizer as one text; each is one part of it, and the last id of a part
        has the suffix of word ends. Were one cut into several parts, there would be more ends than
        words, and the tokenizer gets them one by one.
        """
        flat, count = [], []
        for k in range(0, len(stems), 1000):
            some = stems[k : k + 1000]
            ids = np.array(self._ids([" ".join(some)])[0], dtype=self.dtype)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some) and last[-1] == len(ids) - 1:
                flat.append(ids)
                count.append(np.diff(last, prepend=-1))
            else:
                each = self._ids(some)
                flat += [np.array(x, dtype=self.dtype) for x in each]
                count.append(np.array([len(x) for x in each]))
        return np.concatenate([np.zeros(0, self.dtype), *flat]), np.concatenate([np.zeros(0, np.int64), *count])

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Tokenise words. One that is letters and one of ``.,`` is its stem and that sign, others that are not letters go whole."""
        stem: dict[str, int] = {}
        whole: list[str] = []
        part = np.empty(len(words), dtype=np.int64)  # of stems from 0 on, of whole words from -1 down
        sign = np.zeros(len(words), dtype=np.int64)
        for i, word in enumerate(map(bytes.decode, words)):
            if word.isalpha():
                part[i] = stem.setdefault(word, len(stem))
            elif word[-1] in ".," and word[:-1].isalpha():
                part[i] = stem.setdefault(word[:-1], len(stem))
                sign[i] = 1 if word[-1] == "." else 2
            else:
                whole.append(word)
                part[i] = -len(whole)
        flat, count = self._stems(list(stem))
        more = self._ids([*whole, "", ".", ","])
        flat = np.concatenate([flat, *(np.array(x, dtype=self.dtype) for x in more)])
        count = np.concatenate([count, np.array([len(x) for x in more])])
        first = np.cumsum(count) - count
        part = np.where(part < 0, len(stem) - 1 - part, part)
        both = np.stack([part, len(stem) + len(whole) + sign], axis=1).ravel()
        self.table.add(keys, gather(flat, first[both], count[both]), count[both].reshape(-1, 2).sum(1))

    def _block(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the bytes of a block, and how many lie between its edges."""
        words = kernel.Words(data, edges)
        keys, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
        _, there = self.table.find(keys)
        missing = np.flatnonzero(~there)
        if len(missing):
            if len(self.table.keys) + len(missing) > TABLE_ENTRIES:
                self.table.clear()
                missing = np.arange(len(keys))
            raw = data.tobytes()
            self._learn(keys[missing], [raw[a:b] for a, b in zip(words.start[at[missing]].tolist(), words.end[at[missing]].tolist(), strict=True)])
        place, _ = self.table.find(keys)
        count = self.table.count[place][which]
        ids = gather(self.table.flat, self.table.first[place][which], count)
        return ids, np.diff(np.append(0, np.cumsum(count))[np.append(words.first, len(words.doc))])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each; the bytes go through in blocks of about BLOCK_BYTES, cut at white space."""
        if b"<|" not in data.tobytes():  # else a special token could come of it
            data = kernel.LOWER[data]
        sizes, parts = np.zeros(len(offsets) - 1, dtype=np.int64), [np.zeros(0, dtype=self.dtype)]
        for begin, end in blocks(data, offsets):
            first, last = np.searchsorted(offsets, begin, side="right") - 1, np.searchsorted(offsets, end, side="left")
            edges = np.clip(offsets[first : last + 1], begin, end) - begin
            ids, n = self._block(data[begin:end], edges)
            parts.append(ids)
            sizes[first:last] += n
        return np.concatenate(parts), sizes

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, sizes = self.encode(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]))
        return np.split(ids, np.cumsum(sizes)[:-1])


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of blocks of about BLOCK_BYTES, cut where a text or a word ends."""
    begin, n = 0, len(data)
    while n - begin > 2 * BLOCK_BYTES:
        end = begin + BLOCK_BYTES
        edge = int(offsets[np.searchsorted(offsets, end)])
        step = 1 << 12
        while end < edge:
            found = np.flatnonzero(kernel.SEPARATOR[data[end : end + step]])
            if len(found):
                edge = min(edge, end + int(found[0]))
                break
            end += step
        yield begin, edge
        begin = edge
    if begin < n:
        yield begin, n


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker, so that its table stays filled."""
    return Encoder(path)


kernel.KEPT["packing"] = encoder_of.cache_clear


@dataclass
class Piece:
    """Some tokens of a document."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


@dataclass
class Packer:
    """Packs pieces into sequences of ``length`` tokens; a sequence is a list of pieces."""

    length: int = 2048
    linear: float = 1.0
    quadratic: float = 1 / 2048
    waiting: list[Piece] = field(default_factory=list)
    tokens: int = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take in a document; full stretches come out as sequences."""
        while len(piece.ids) >= self.length:
            head, piece = piece.cut(self.length)
            yield [head]
        if len(piece.ids):
            self.waiting.append(piece)
            self.tokens += len(piece.ids)

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def pack(self, last: bool = False) -> Iterator[list[Piece]]:
        """Full sequences of what waits; the rest waits on, or if ``last`` fills sequences of 2**k tokens."""
        room = [self.length] * (self.tokens // self.length)
        if last:
            rest = self.tokens % self.length
            room += [1 << k for k in reversed(range(self.length.bit_length())) if rest >> k & 1]
        left, cost = np.array(room, dtype=np.int64), np.zeros(len(room))
        sequences: list[list[Piece]] = [[] for _ in room]
        over: list[Piece] = []
        for piece in sorted(self.waiting, key=lambda p: -len(p.ids)):
            n = len(piece.ids)
            fits = np.flatnonzero(left >= n)
            if len(fits):
                k = fits[cost[fits].argmin()]
                sequences[k].append(piece)
                left[k] -= n
                cost[k] += self.cost(n)
            else:
                over.append(piece)
        over.reverse()
        for k in np.argsort(cost, kind="stable"):
            while left[k]:
                piece, rest_of = over.pop().cut(int(left[k]))
                sequences[k].append(piece)
                left[k] -= len(piece.ids)
                if len(rest_of.ids):
                    over.append(rest_of)
        self.waiting, self.tokens = over, sum(len(p.ids) for p in over)
        yield from sequences


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def rows(sequences: list[list[Piece]], first_id: int) -> pa.RecordBatch:
    table = [(p.doc_id, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.doc_tokens, first_id + k, at) for k, s in enumerate(sequences) for p, at in zip(s, np.cumsum([0, *(len(p.ids) for p in s)])[:-1].tolist(), strict=True)]
    columns = list(zip(*table, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(NAMES, columns, strict=True)], names=NAMES)


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, tokenizer: str | None = None, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Every document is its tokens and ``end_id``. A sequence is shorter than ``length`` only at a
    power of two. sequence_id holds the number of the input partition above bit 36.
    """
    runtime.ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.turn_to("packing")
        encoder, packer = encoder_of(path), Packer(length, linear, quadratic)
        kernel.give_back()  # what reading the tokenizer took
        next_id = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                ids, sizes = encoder.encode(*kernel.text_bytes(part.column(1)))
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                upto = np.cumsum(sizes + 1)
                full: list[list[Piece]] = []
                for doc_id, n, end in zip(part.column(0).to_pylist(), (sizes + 1).tolist(), upto.tolist(), strict=True):
                    full += packer.add(Piece(doc_id, 0, ids[end - n : end], n))
                    if packer.tokens >= CHUNK_TOKENS:
                        full += packer.pack()
                if full:
                    yield rows(full, next_id)
                    next_id += len(full)
        if packer.waiting:
            yield rows(list(packer.pack(last=True)), next_id)
        kernel.give_back()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pieces of sequences; a document that comes several times is packed as often."""
    return digest(pack(docs))
