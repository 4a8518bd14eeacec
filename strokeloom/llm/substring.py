"""Removal of word sequences that an earlier document has, by recompression (operator 9).

A window is 50 consecutive words of one document. A word goes if a window over it also starts in a
document with a smaller doc_id. Words are compared unchanged.

``parse`` runs the rounds of recompression on word sequences: round 1 names runs of exactly two
equal words and pairs, later rounds pairs of symbols. A pair is named where its left symbol falls
into one half of the alphabet and its right one into the other, the halves drawn anew by hash in
every round. A name is the hash of what it stands for, so names are global without a dictionary,
and the rounds need no exchange. What becomes of a symbol depends on its neighbours only, and
after round r it stands for at most 2**r words; therefore equal substrings are parsed alike but for
2 + 2 + 4 + 8 = 16 words at either end (``MARGIN``), and all symbols that reach into the middle 18
of a repeated window are the same ones wherever it occurs.

1. ``shared_symbols``: symbols of ``LEAST`` words or more that occur in several documents, by one
   exchange on names. Shorter ones tell little and are taken as shared. A name that several documents of one task's texts have is shared already; the
   task sends one row for it every ``GATHERED`` rows, so a passage on a third of all documents sends few.
2. ``repeated_windows``: only windows with no unshared symbol in their middle can repeat. Their
   hashes (82 bits) are exchanged; a window whose document is not the smallest with it repeats.
   Again a task decides what it can by itself and sends the rows of its smallest document.
3. ``remove``: every document gets its list of windows and loses the words under them.

Texts move twice, to meet their lists. No group of documents is ever gathered: a reducer reads the
rows of a name in order and holds a bounded number of them, or those of one document.

Defined results: a null or empty text has no words and its kept text is empty; texts under 50
words keep all. Rows with equal doc_ids don't count as earlier than each other; each is judged by
its own text; repeated rows are alike in all. A null doc_id counts as smallest. A text may be of any
length; it is parsed whole. An empty table gives no rows. Only doc_id and text are read, so extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeloom import runtime
from strokeloom.llm import kernel

WINDOW = 50
ROUNDS = 4
MARGIN = 16
LEAST = 4
NULL_ID = -(2**63)
U64 = np.uint64
#: Of a row's 64-bit place: position in its text (a string has fewer than 2**30 words), more bits of a window's hash, bits of the text's hash.
POSITION_BITS, CHECK_BITS, TAG_BITS = 30, 18, 16
PLACE = U64((1 << POSITION_BITS) - 1)
CHECK = U64(((1 << CHECK_BITS) - 1) << POSITION_BITS)
TAG = ~(PLACE | CHECK)
SIDES = kernel.stream(201, ROUNDS + 1)
PAIR_CODES = kernel.stream(202, 2) | U64(1)


def parse(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first words and lengths of the symbols after all rounds; nothing crosses from one owner to the next."""
    start = np.arange(len(names))
    length = np.ones(len(names), dtype=np.int64)
    for r in range(1, ROUNDS + 1):
        if len(names) < 2:
            break
        together = owner[1:] == owner[:-1]
        half = (kernel.mix(names ^ SIDES[r]) >> U64(63)).astype(bool)
        merge = together & ~half[:-1] & half[1:]
        if r == 1:
            same = together & (names[1:] == names[:-1])
            in_run = np.append(same, False) | np.append(False, same)
            merge &= ~in_run[:-1] & ~in_run[1:]
            before, after = np.append(False, same[:-1]), np.append(same[1:], False)
            merge |= same & ~before & ~after
        left = np.flatnonzero(merge)
        names, length = names.copy(), length.copy()
        names[left] = kernel.mix(names[left] * PAIR_CODES[0] + kernel.mix(names[left + 1] * PAIR_CODES[1]))
        length[left] += length[left + 1]
        keep = np.ones(len(names), dtype=bool)
        keep[left + 1] = False
        names, start, length, owner = names[keep], start[keep], length[keep], owner[keep]
    return names, start, length


class Slice:
    """Words and symbols of the texts of a slice that have a window."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = kernel.text_bytes(column)
        self.words = kernel.Words(self.data, self.offsets)
        self.long = self.words.count >= WINDOW
        tags = kernel.span_hash(self.data, self.offsets[:-1], self.offsets[1:])
        self.tag = (tags >> U64(64 - TAG_BITS)) << U64(POSITION_BITS + CHECK_BITS)

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Name, row, first word within the row, and length of every symbol of the long texts."""
        mine = np.flatnonzero(self.long[self.words.doc])
        row = self.words.doc[mine]
        names, start, length = parse(self.words.hash[mine], row)
        row = row[start]
        return names, row, mine[start] - self.words.first[row], length


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows begin to differ from the row before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


ROWS = "key long, node long, place long"


def batch_of(key: np.ndarray, node: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(place.view(np.int64))], names=["key", "node", "place"])


#: Rows of a partition's slices that are settled together before what is left of them is exchanged, some 20 MB.
GATHERED = 250_000


def by_slice(table: DataFrame, emit, settle, *names: str) -> DataFrame:
    """Rows (key, node, place) that emit gives for the slices of table, after settle has told, many slices together, what they answer and what must be asked.

    An odd key is an answer already, dealt out evenly; an even key a question.
    """

    def settled(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        questions, answers = settle(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for (key, node, place), odd in ((questions, 0), (answers, 1)):
            if len(node):
                code = kernel.mix(node.view(U64) ^ kernel.mix(place)) if odd else key
                yield batch_of((code & ~U64(1)) | U64(odd), node, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                parts.append(emit(part))
                size += len(parts[-1][0])
                if size >= GATHERED:
                    yield from settled(parts)
                    parts, size = [], 0
        if size:
            yield from settled(parts)

    return table.select(*names).mapInArrow(run, ROWS)


def symbol_rows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, node and place of the symbols of a slice."""
    node = part.column(0).to_numpy()
    own = Slice(part.column(1))
    names, row, position, length = own.symbols()
    keep = length >= LEAST
    row = row[keep]
    return names[keep] & ~U64(1), node[row], position[keep].astype(U64) | own.tag[row]


def settle_symbols(names: np.ndarray, nodes: np.ndarray, place: np.ndarray) -> tuple[tuple, tuple]:
    """Questions: names that one document here has, and a row with the place -1 for those that several have. Answers: where the latter are. Of a name's places in one text the first stands for all."""
    order = np.lexsort((place & TAG, nodes, names))
    order = order[runs(names[order], nodes[order], (place & TAG)[order])]
    names, nodes, place = names[order], nodes[order], place[order]
    begins = np.flatnonzero(runs(names))
    size = np.diff(np.append(begins, len(names)))
    several = nodes[begins] != nodes[begins + size - 1] if len(begins) else np.zeros(0, bool)
    known = np.repeat(several, size)
    marks = begins[several]
    questions = (np.concatenate([names[~known], names[marks]]), np.concatenate([nodes[~known], nodes[marks]]), np.concatenate([place[~known], np.full(len(marks), 2**64 - 1, dtype=U64)]))
    return questions, (names[known], nodes[known], place[known])


def answered(rows: DataFrame, decide) -> DataFrame:
    """node, place of the rows that are answers, and of the questions that decide finds true when all rows of a key are seen in order of node.

    ``decide(key, node, place, begun)`` gets whole keys, but that the rows of the last key may go on in a
    later call, in which case only its first row is kept back as ``begun``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, place = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        begun: tuple[int, int, bool] | None = None

        def out(nodes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(places.view(np.int64))], names=["node", "place"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            node = np.concatenate([node, batch.column(1).to_numpy()])
            place = np.concatenate([place, batch.column(2).to_numpy().view(U64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if len(key) - cut > 200_000 and node[cut] != node[-1]:
                cut = len(key)
            if cut:
                truth, begun = decide(key[:cut], node[:cut], place[:cut], begun)
                yield out(node[:cut][truth], place[:cut][truth])
            key, node, place = key[cut:], node[cut:], place[cut:]
        if len(key):
            truth, _ = decide(key, node, place, begun)
            yield out(node[truth], place[truth])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "node long, place long")


def decide_shared(key, node, place, begun):
    """A name is shared if its rows have several nodes or one says so; a key that goes on later has several already."""
    begins = np.flatnonzero(runs(key))
    size = np.diff(np.append(begins, len(key)))
    shared = node[begins] != node[begins + size - 1]
    said = place == U64(2**64 - 1)
    shared |= np.add.reduceat(said, begins) > 0
    if begun is not None and begun[0] == key[0]:
        shared[0] |= begun[2] or begun[1] != node[0]
    odd = (key & 1).astype(bool)
    truth = (odd | np.repeat(shared, size)) & ~said
    last = begins[-1]
    first_node = begun[1] if begun is not None and begun[0] == key[last] else int(node[last])
    return truth, (int(key[last]), first_node, bool(shared[-1]))


def decide_later(key, node, place, begun):
    """A window repeats if its hash, with the check bits, has a smaller node."""
    check = place & CHECK
    order = np.lexsort((node, check, key))
    k, c, n = key[order], check[order], node[order]
    begins = np.flatnonzero(runs(k, c))
    size = np.diff(np.append(begins, len(k)))
    least = n[begins].copy()
    if begun is not None and begun[0] == key[0]:
        least[0] = min(least[0], begun[1]) if int(c[0]) == begun[2] else least[0]
    truth = np.empty(len(key), dtype=bool)
    truth[order] = n > np.repeat(least, size)
    truth |= (key & 1).astype(bool)
    return truth, (int(k[-1]), int(least[-1]), int(c[-1]))


def shared_symbols(docs: DataFrame) -> DataFrame:
    """node, place of the shared symbols of docs (node, text)."""
    return answered(by_slice(docs, symbol_rows, settle_symbols, "node", "text"), decide_shared)


def window_rows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, node and place of the windows of a slice that may repeat."""
    node = part.column(0).to_numpy()
    own = Slice(part.column(1))
    names, row, position, length = own.symbols()
    lists = part.column(2)
    counts = np.diff(lists.offsets.to_numpy())
    places = lists.flatten().to_numpy().view(U64)
    of_row = np.repeat(np.arange(len(counts)), counts)
    mine = (places & TAG) == own.tag[of_row]
    at = own.words.first[of_row[mine]] + (places[mine] & PLACE).astype(np.int64)
    shared = np.zeros(len(own.words.doc) + 1, dtype=bool)
    shared[at] = True
    begin = own.words.first[row] + position
    told = alike(names & ~U64(1), row, shared[begin] & (length >= LEAST))
    open_words = np.zeros(len(own.words.doc) + 1, dtype=np.int64)
    alone = (length >= LEAST) & ~told
    np.add.at(open_words, begin[alone], 1)
    np.add.at(open_words, begin[alone] + length[alone], -1)
    unshared = kernel.prefix_counts(np.cumsum(open_words[:-1]) > 0)
    n = len(own.words.doc) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64)
    first = np.arange(n)
    hashes, more, fits = window_names(own)
    maybe = np.flatnonzero(fits & (unshared[first + WINDOW - MARGIN] == unshared[first + MARGIN]))
    row = own.words.doc[maybe]
    return hashes[maybe], node[row], (maybe - own.words.first[row]).astype(U64) | more[maybe] | own.tag[row]


def window_names(own: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and check bits of the window at every word, and whether it lies in one text."""
    words = own.words
    more = (kernel.windows_hash(kernel.mix(words.hash), WINDOW) >> U64(64 - CHECK_BITS)) << U64(POSITION_BITS)
    n = max(0, len(words.doc) - WINDOW + 1)
    return kernel.windows_hash(words.hash, WINDOW) & ~U64(1), more, words.doc[:n] == words.doc[WINDOW - 1 :][:n]


def alike(names: np.ndarray, row: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Where a name stands that is told of at one place of the same text."""
    own = kernel.mix(names ^ kernel.mix(row.astype(U64)))
    return np.isin(own, np.unique(own[told]))


def settle_windows(hashes: np.ndarray, nodes: np.ndarray, place: np.ndarray) -> tuple[tuple, tuple]:
    """Questions: windows of the smallest document here that has them. Answers: of the other documents. Of a window's places in one text the first stands for all."""
    more = place & CHECK
    order = np.lexsort((place & TAG, nodes, more, hashes))
    order = order[runs(hashes[order], more[order], nodes[order], (place & TAG)[order])]
    hashes, nodes, place, more = hashes[order], nodes[order], place[order], more[order]
    begins = np.flatnonzero(runs(hashes, more))
    later = nodes > np.repeat(nodes[begins], np.diff(np.append(begins, len(nodes))))
    return (hashes[~later], nodes[~later], place[~later]), (hashes[later], nodes[later], place[later])


def lists(rows: DataFrame) -> DataFrame:
    """The places of each node as one array: no longer than its texts."""
    return rows.groupBy("node").agg(F.collect_list("place").alias("places"))


def with_places(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, text, places of every row of docs; short symbols are in no list, so a document without one has windows too."""
    return docs.join(lists(rows), "node", "left").select("node", "text", F.coalesce("places", F.array().cast("array<long>")).alias("places"))


def repeated_windows(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """node, place of the windows of docs (node, text) that an earlier document has."""
    return answered(by_slice(with_places(docs, shared), window_rows, settle_windows, "node", "text", "places"), decide_later)


REMOVED = "doc_id long, n_words long, n_removed long, kept string"


def remove(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept of docs (node, text) without the words under their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                yield removed(part)

    kept = with_places(docs, windows).mapInArrow(run, REMOVED)
    return kept.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept")


def removed(part: pa.RecordBatch) -> pa.RecordBatch:
    own = Slice(part.column(1))
    counts = np.diff(part.column(2).offsets.to_numpy())
    places = part.column(2).flatten().to_numpy().view(U64)
    of_row = np.repeat(np.arange(len(counts)), counts)
    mine = (places & TAG) == own.tag[of_row]
    begin = own.words.first[of_row[mine]] + (places[mine] & PLACE).astype(np.int64)
    depth = np.zeros(len(own.words.doc) + 1, dtype=np.int64)
    if len(begin):
        hashes, more, fits = window_names(own)
        told = np.zeros(len(hashes), dtype=bool)
        told[begin] = True
        begin = np.flatnonzero(fits & alike(hashes ^ more, own.words.doc[: len(hashes)], told))
    depth[begin] += 1
    depth[begin + WINDOW] -= 1
    gone = np.cumsum(depth[:-1]) > 0
    n_removed = np.diff(kernel.prefix_counts(gone)[np.append(own.words.first, len(gone))])
    raw, kept = own.data.tobytes(), []
    for i, (a, b) in enumerate(zip(own.offsets[:-1].tolist(), own.offsets[1:].tolist(), strict=True)):
        words = raw[a:b].split()
        if n_removed[i]:
            first = own.words.first[i]
            words = [w for w, x in zip(words, gone[first : first + len(words)].tolist(), strict=True) if not x]
        kept.append(b" ".join(words))
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(own.words.count.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text of the kept words) for every row of docs (doc_id, text)."""
    runtime.ship(docs.sparkSession)
    base = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("node"), "text")
    shared = runtime.table(shared_symbols(base))
    windows = runtime.table(repeated_windows(base, shared))
    runtime.drop(shared)
    return remove(base, windows)


def query(spark, sf_dir: str) -> DataFrame:
    cleaned = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)
), m AS (SELECT h, min(doc_id) AS least FROM p GROUP BY h HAVING count(DISTINCT doc_id) > 1
), r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM p JOIN m USING (h) WHERE doc_id > least
), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM w)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w d LEFT JOIN (
  SELECT u.doc_id, count(r.j) AS n_removed, string_agg(u.x, ' ' ORDER BY u.j) FILTER (r.j IS NULL) AS kept
  FROM u LEFT JOIN r ON u.doc_id = r.doc_id AND u.j = r.j GROUP BY u.doc_id) k USING (doc_id)
"""
