"""Document fingerprints: a homomorphic multiset hash of paragraphs (operator 10).

Every paragraph (a line with a word) is hashed to a wide vector, and a text's fingerprint is the
sum of its paragraphs' vectors modulo powers of two. So it does not depend on their order, and a
paragraph is inserted or deleted by adding or subtracting its vector (``combine``). The vector has

- 8 lanes modulo 2**64, random functions of the paragraph: they tell multisets apart;
- 512 lanes modulo 2**16, in which every run of three words (a shorter paragraph: the whole) adds
  or subtracts 1 in one lane; a run's later occurrences in its paragraph count as runs of their own.
  Sums of those are a count sketch of the text's runs, so the inner product of two fingerprints
  estimates that of the run counts x, y, and the likeness is x*y / (x*x + y*y - x*y) of the
  estimates, cut to 0..1 (for runs that are not repeated the share of common runs in all). The inner
  product is off by sqrt(2 / 512) |x| |y| at one standard deviation at most, so the likeness by some 0.05.

A paragraph is compared from its first to its last word; layout around it and blank lines count for
nothing, so texts that differ in those or in the order of their paragraphs have equal fingerprints.

Successors come by ranges of doc_id (``with_next``): runs of some ``RUN_BYTES`` of text, whose rows
go through Python in order, batch by batch, so that neither many nor very long texts gather.

Defined results: null and empty texts have the fingerprint of nothing, all zero; two texts without
words are alike 1.0, and a text with and one without words 0.0. Equal doc_ids are ordered by text;
rows without a doc_id come first, as one run. Repeated rows are documents of their own. A text may be
of any length; it is handled whole. An empty table gives no rows; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokeloom import runtime
from strokeloom.llm import kernel
from strokeloom.llm.quality import lines

STRONG, LANES, RUN = 8, 512, 3
STRONG_KEYS = kernel.stream(101, STRONG)
AGAIN_KEY = kernel.stream(102, 1)[0]
#: Text that one run of ascending doc_ids holds, about.
RUN_BYTES = 64 << 20


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the strong lanes (rows x STRONG uint64) and the counting lanes (rows x LANES int64)."""
    rows = len(offsets) - 1
    words = kernel.Words(data, offsets)
    start, end, row = lines(data, offsets)
    first = np.searchsorted(words.start, start)
    full = np.searchsorted(words.start, end) > first
    start, end, row, first = start[full], end[full], row[full], first[full]
    last = np.append(first[1:], len(words.start)) if len(first) else first
    paragraph = kernel.span_hash(data, words.start[first], words.end[last - 1])
    strong = np.zeros((rows, STRONG), dtype=np.uint64)
    present = np.flatnonzero(np.bincount(row, minlength=rows))
    at = np.searchsorted(row, present)
    for lane in range(STRONG):
        if len(at):
            strong[present, lane] = np.add.reduceat(kernel.mix(paragraph ^ STRONG_KEYS[lane]), at)
    line_of = np.repeat(np.arange(len(first)), last - first)
    pos, runs = words.windows(RUN, line_of) if len(line_of) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    runs = numbered(runs, line_of[pos])
    short = last - first < RUN
    runs = np.concatenate([runs, kernel.mix(paragraph[short])])
    owner = np.concatenate([words.doc[pos], row[short]])
    sign = 1 - 2 * (runs >> np.uint64(63)).astype(np.int64)
    lane = (runs % np.uint64(LANES)).astype(np.int64)
    counting = np.bincount(owner * LANES + lane, weights=sign, minlength=rows * LANES).astype(np.int64).reshape(rows, LANES)
    return strong, counting


def numbered(runs: np.ndarray, line: np.ndarray) -> np.ndarray:
    """runs, those that stand in their line a second, third ... time with names of their own."""
    own = kernel.mix(runs ^ kernel.mix(line.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    if not same.any():
        return runs
    begins = np.flatnonzero(np.append(True, ~same))
    nth = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
    out, later = runs.copy(), nth > 0
    out[order[later]] = kernel.mix(runs[order[later]] + nth[later].astype(np.uint64) * AGAIN_KEY)
    return out


def text_form(strong: np.ndarray, counting: np.ndarray) -> list[str]:
    """A fingerprint as hex, lane by lane, little-endian."""
    a, b = strong.astype("<u8"), counting.astype("<u2")
    return [x.tobytes().hex() + y.tobytes().hex() for x, y in zip(a, b, strict=True)]


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    cut = 8 * STRONG
    return np.frombuffer(raw[:cut], dtype="<u8"), np.frombuffer(raw[cut:], dtype="<u2")


def combine(fingerprint: str, other: str, sign: int = 1) -> str:
    """The fingerprint after the paragraphs of ``other`` are inserted (1) or deleted (-1)."""
    (a, x), (b, y) = parse(fingerprint), parse(other)
    return text_form((a + b if sign > 0 else a - b)[None], (x + y if sign > 0 else x - y)[None])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of counting lanes, read as signed: shared runs over all runs, 0 to 1."""
    signed = lambda x: x.astype("<u2").astype("<i2").astype(np.float64)
    a, b = signed(a), signed(b)
    dot, aa, bb = (a * b).sum(1), (a * a).sum(1), (b * b).sum(1)
    union = aa + bb - dot
    return np.where(union > 0, np.clip(dot / np.where(union > 0, union, 1), 0, 1), 1.0)


def rank(points: list[int]) -> Column:
    """How many of the ascending points are at most doc_id: found among every k-th of them first, then among the k there."""
    k = max(1, math.isqrt(len(points)))
    array = lambda some: F.array(*map(F.lit, some)).cast("array<long>")
    upto = lambda some: F.size(F.filter(some, lambda c: c <= F.col("doc_id")))
    coarse = upto(array(points[k - 1 :: k])) * k
    return coarse + upto(F.slice(array(points), coarse + 1, k - 1)) if k > 1 else coarse


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """docs in runs of ascending doc_id: every row of a run but its closing helper is a document, and the row after it is its successor.

    Split points are quantiles of doc_id; there are ``partitions`` runs, or as many as hold RUN_BYTES
    each, the session's shuffle partitions at least. A run is a partition. The first row of each run is
    also dealt, as a helper, to the end of the run before it; that of the first run closes the last.
    One shuffle moves each text once.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions
    if n is None:
        size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RUN_BYTES))
    cuts = base.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    placed = base.select("doc_id", "text", (F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(rank(cuts) + 1) if cuts else F.lit(0)).cast("int").alias("run"))
    heads = placed.groupBy("run").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("head"))
    by_run = Window.orderBy("run")  # one row a run
    heads = runtime.table(heads.select("run", "head", F.coalesce(F.lag("run").over(by_run), F.max("run").over(Window.partitionBy())).alias("before")))
    joined = placed.join(runtime.bounded_broadcast(heads), "run")
    own = F.struct(F.col("run"), F.lit(False).alias("helper"))
    is_head = F.coalesce("doc_id", F.lit(-(2**63))) == F.col("head")
    places = F.when(is_head, F.array(own, F.struct(F.col("before").alias("run"), F.lit(True).alias("helper")))).otherwise(F.array(own))
    dealt = joined.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.run", "p.helper")
    return dealt.repartitionById(n + 1, "run").sortWithinPartitions("run", "helper", F.col("doc_id").asc_nulls_first(), "text")


def edit(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text but the last, its last floor(n/2) code points replaced by the first as many of the next text: bytes, offsets, code points before."""
    begins = np.append(np.flatnonzero(kernel.characters(data)), len(data))
    char_at = np.searchsorted(begins, offsets)
    n_chars = np.diff(char_at)
    out, sizes = [], [0]
    for i in range(len(n_chars) - 1):
        half = n_chars[i] // 2
        keep = begins[char_at[i + 1] - half]
        take = begins[char_at[i + 1] + min(half, n_chars[i + 1])]
        out += [data[offsets[i] : keep], data[offsets[i + 1] : take]]
        sizes.append(sizes[-1] + keep - offsets[i] + take - offsets[i + 1])
    return (np.concatenate(out) if out else data[:0]), np.array(sizes, dtype=np.int64), n_chars


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of one run after another, each document with its successor; the row that waits for one is carried over."""
    carried: pa.RecordBatch | None = None
    for batch in batches:
        for part in kernel.slices(batch, "text"):
            joined = part if carried is None else pa.Table.from_batches([carried, part]).combine_chunks().to_batches()[0]
            yield from _pairs(joined)
            carried = joined.slice(joined.num_rows - 1)


def _pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = rows.num_rows
    if n < 2:
        return
    run, helper = rows.column(2).to_numpy(), rows.column(3).to_numpy(zero_copy_only=False)
    real = np.flatnonzero(~helper[:-1] & (run[1:] == run[:-1]))
    if not len(real):
        return
    data, offsets = kernel.text_bytes(rows.column(1))
    edited, edges, n_chars = edit(data, offsets)
    strong, counting = vectors(data, offsets)
    e_strong, e_counting = vectors(edited, edges)
    raw = edited.tobytes()
    yield pa.RecordBatch.from_arrays(
        [
            rows.column(0).take(pa.array(real)),
            pa.array(n_chars[real]),
            pa.array([hashlib.sha256(raw[edges[i] : edges[i + 1]]).hexdigest() for i in real]),
            pa.array(text_form(strong[real], counting[real])),
            pa.array(text_form(e_strong[real], e_counting[real])),
            pa.array(likeness(counting[real], e_counting[real])),
            pa.array(likeness(counting[real], counting[real + 1])),
        ],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row's whole text, without successors."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_form(*vectors(*kernel.text_bytes(part.column(1)))), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_edits(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and likenesses to it and to the next document."""
    runtime.ship(docs.sparkSession)
    return with_next(docs).mapInArrow(pairs, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
