"""Near duplicates by an exact Jaccard self-join of word n-gram sets (operator 7).

Two documents link when ``100 * intersection >= 75 * union`` of their sets of five-word shingles.

Method: universe-partition pigeonhole.

1. Equal sets are one class, found by a 128-bit sum over the set; the class is its smallest doc_id.
2. Sizes fall into overlapping bands: band k holds ``(4/3)**k <= size < (4/3)**(k + 2)``, so every
   pair that can link lies in one band together, its smaller member in the lower half. Linked sets
   x, y differ in at most ``H = (|x| + |y|) // 7`` shingles.
3. In a band the universe of shingle hashes is cut into m equal segments. A set's subsets in its
   first non-empty segments are its signatures: an exact subset is worth 1, a subset with all of
   its one-deletion neighbours 2. A set walks on until its worth is H + 1 and a reserve. Of two
   linked sets, the one whose walk ends first would differ in more than H shingles if no segment
   agreed within its worth, so they share a signature. Where a set runs out of segments, its band
   is done again with four times as many (``levels``).
4. Per band a cost model allocates: exact subsets of small segments, or larger segments with
   deletion neighbourhoods, whichever needs fewer rows and likely candidates.
5. Signatures that more than ``hot`` sets share (parts of common passages or of large groups) are
   worth 0: sets whose reserve covers them don't need them. Only sets that would fall short
   ("saturated") are compared within such groups, in blocks and only across components.
6. Candidates are cut by an odd sketch: the parity of each set's hash buckets, whose difference is
   at most the sets' difference, so the bound is exact and no link is lost. What is left is
   compared shingle by shingle: first one pair per set, then only pairs that are still apart, as
   pairs in one component change nothing. Hot groups go through the same in two steps, with finer
   sketches: likely links that would connect them, then all that are still apart.

Texts travel to the comparison, one pair a row; no group is gathered and no pairs within a hot
group are written, except survivors of the sketch.

Defined results: texts without words (null, empty, blank) have 0 shingles, link with nothing and
are their own component; fewer than five words are one shingle. A null doc_id is compared like
others, counts as smallest, and is null again in the result. Rows with equal doc_ids are one
document for links, each with its own n_shingles. A text may be of any length; its set is held whole.
An empty table gives no rows. Only doc_id and text are read, so extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokeloom import runtime
from strokeloom.llm import kernel
from strokeloom.llm.components import components

SHINGLE = 5
HOT = 32
U64 = np.uint64
#: Sizes at which bands begin: the least integer >= (4/3)**k.
STARTS = [-(-(4**k) // 3**k) for k in range(100)]
STARTS_ARRAY = np.array(STARTS[:76], dtype=np.int64)
SKETCH_BITS = (128, 1 << 17)
NULL_ID = -(2**63)
MARK = -1


def band_of(size: int) -> int:
    """The band in whose lower half a size lies."""
    return int(np.searchsorted(STARTS_ARRAY, size, side="right")) - 1


def bound(size: int, band: int) -> int:
    """H: how many shingles a set can differ in from partners it must meet in this band."""
    if band == band_of(size):
        return (size + min(4 * size // 3, STARTS[band + 2] - 1)) // 7
    return (size + STARTS[band + 1] - 1) // 7


def reserve(h: int) -> int:
    return 3 + h // 8


@dataclass(frozen=True)
class Plan:
    """How a band is indexed: the number of segments, and whether with deletion neighbourhoods."""

    segments: int
    deletions: bool


def fewest_segments(band: int) -> int:
    """So many segments that sets of the band have H + 1 non-empty ones, seven standard deviations below the mean still, and on average the reserve too."""

    def enough(size: int, m: float) -> bool:
        h, empty = bound(size, band), math.exp(-size / m)
        mean, spread = m * (1 - empty), math.sqrt(m * empty * max(0.0, 1 - (1 + size / m) * empty))
        return mean - 7 * spread > h + 0.5 and mean > min(h + 1 + reserve(h), size - 0.5)

    sizes = {STARTS[band], STARTS[band + 1], STARTS[band + 1] - 1, STARTS[band + 2] - 1} - {0}
    m = max(1.0, STARTS[band] / 4)
    while m < 1 << 31 and not all(enough(n, m) for n in sizes if band in (band_of(n), band_of(n) - 1)):
        m = 1.05 * m + 1
    return int(m)


def allocate(band: int, sets: int, level: int = 0, share: float = 1e-9, candidate_cost: float = 20.0) -> Plan:
    """The cheaper plan of a band of ``sets`` sets: rows written plus likely candidates.

    Segments of exact subsets are as few and large as they may be for a set to have enough of them, so
    that most subsets hold several shingles and tell much for one row each. ``share`` is the chance taken
    that unlike sets agree on a shingle that is alone in its segment, as a fourth of them are; beyond
    passages, which become hot, it is small, so that deletion neighbourhoods pay for very many sets only.
    """
    size = STARTS[band]
    h = bound(size, band) + 1
    fine = fewest_segments(band)
    coarse = -(-size // 3)
    exact = sets * h + candidate_cost * sets**2 * h * share / 4
    walks = max(1.0, h / 2)
    deletion = sets * walks * (1 + max(1.0, size / coarse)) + candidate_cost * sets**2 * walks * 7 * share**2
    return Plan(fine << (2 * level), False) if exact <= deletion else Plan(coarse << (2 * level), True)


# Sets of texts ---------------------------------------------------------------------------------
def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, offsets = kernel.text_bytes(column)
    words = kernel.Words(kernel.LOWER[data], offsets)
    at, hashes = words.windows(SHINGLE)
    bounds = np.searchsorted(words.doc[at], np.arange(len(offsets)))
    out = []
    for i, n in enumerate(words.count.tolist()):
        if n >= SHINGLE:
            h = np.sort(hashes[bounds[i] : bounds[i + 1]])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        elif n:
            own = words.hash[words.first[i] : words.first[i] + n]
            out.append(kernel.mix((own * kernel.POSITION_CODES[100 : 100 + n]).sum(keepdims=True, dtype=U64) + U64(n)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the counts of hash buckets: as many buckets as a power of two from twice the set's size on, within SKETCH_BITS."""
    bits = min(max(SKETCH_BITS[0], 2 << (len(hashes) - 1).bit_length()), SKETCH_BITS[1])
    odd = np.bincount((hashes & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(a: np.ndarray, size: int) -> np.ndarray:
    """The sketch with fewer buckets."""
    return np.bitwise_xor.reduce(a.reshape(-1, size), axis=0)


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, n) ^ fold(y, n)).sum())


def near_enough(distance: np.ndarray | int, total: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of ``total`` shingles together that differ in ``distance`` link."""
    return 7 * distance <= total


def describe(docs: DataFrame) -> DataFrame:
    """node, text_hash, n, f1, f2, sketch of each row of docs (node, text, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                sets = shingle_sets(part.column(1))
                sums = [np.array([kernel.mix(s ^ U64(k)).sum(dtype=U64) for s in sets], dtype=U64).astype(np.int64) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                    names=["node", "text_hash", "n", "f1", "f2", "sketch"],
                )

    return docs.select("node", "text", "text_hash").mapInArrow(run, "node long, text_hash long, n long, f1 long, f2 long, sketch binary")


# Signatures ------------------------------------------------------------------------------------
def walk(hashes: np.ndarray, band: int, plan: Plan) -> tuple[np.ndarray, int]:
    """A set's signatures in a band, and its reserve: worth beyond H + 1, negative if it ran out."""
    h = bound(len(hashes), band)
    want = h + 1 + reserve(h)
    segment = ((hashes >> U64(32)) * U64(plan.segments) >> U64(32)) if plan.segments < 1 << 32 else hashes
    start = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    size = np.diff(np.append(start, len(hashes)))
    worth = np.minimum(size, 2) if plan.deletions else np.ones(len(size), dtype=np.int64)
    upto = np.cumsum(worth)
    used = min(int(np.searchsorted(upto, want)) + 1, len(start))
    start, size, end = start[:used], size[:used], int(start[used - 1] + size[used - 1])
    codes = kernel.mix(hashes[:end] ^ U64(0x5BD1E995))
    sums = np.add.reduceat(codes, start)
    tag = kernel.mix(segment[start] + U64(band + 1 << 40))
    if plan.deletions:
        owner = np.repeat(np.arange(used), size)
        several = size[owner] > 1
        sums, tag = np.concatenate([sums, (sums[owner] - codes)[several]]), np.concatenate([tag, tag[owner][several]])
    found = (kernel.mix(sums ^ tag) >> U64(8)) | U64(band << 56)
    return found.astype(np.int64), int(upto[used - 1]) - h - 1


def signatures(docs: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """sig, node rows of docs (node, text) in the bands of plans; sig carries the band in its upper byte.

    A set short of its reserve adds a row MARK - (band * 2**32 + worth lacking): every sig below 0 is such a mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            done = 0
            for part in kernel.slices(batch, "text"):
                sigs, owners = [], []
                for i, hashes in enumerate(shingle_sets(part.column(1))):
                    if not len(hashes):
                        continue
                    low = band_of(len(hashes))
                    for band in (low, low - 1):
                        if band not in plans:
                            continue
                        found, spare = walk(hashes, band, plans[band])
                        short = reserve(bound(len(hashes), band)) - spare
                        if short > 0:
                            found = np.append(found, MARK - (band << 32) - short)
                        sigs.append(found)
                        owners.append(np.full(len(found), nodes[done + i], dtype=np.int64))
                done += part.num_rows
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(owners))], names=["sig", "node"])

    return docs.select("node", "text").mapInArrow(run, "sig long, node long")


CANDIDATES = "kind int, sig long, a long, b long"
PAIR, GROUP, SHORT = 0, 1, 2


def meet(sigs: DataFrame, hot: int = HOT) -> DataFrame:
    """What shares a signature: kind PAIR (a < b) for groups of at most ``hot`` sets, and for larger ones their smallest set with each other; kind GROUP (sig, a) for members of those; kind SHORT (sig, a) for marks."""

    def rows(kind: int, sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(sig), pa.array(a), pa.array(b)], names=["kind", "sig", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_sig, rest_node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        leader: tuple[int, int] | None = None  # of a hot group that goes on
        pairs: list[np.ndarray] = []
        waiting = 0

        def distinct() -> pa.RecordBatch:
            a, b = np.concatenate(pairs).T
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            return rows(PAIR, np.zeros(int(new.sum()), np.int64), a[new], b[new])

        def groups(sig: np.ndarray, node: np.ndarray, goes_on: bool) -> Iterator[pa.RecordBatch]:
            """Whole groups, but that the last one may go on, or the first have begun before."""
            nonlocal leader, waiting
            if not len(sig):
                return
            start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            size = np.diff(np.append(start, len(sig)))
            is_hot = size > hot
            if leader is not None and leader[0] == sig[0]:
                is_hot[0] = True
            if goes_on:
                is_hot[-1] = True
            marks = sig[start] < 0
            for k in np.flatnonzero(marks):
                own = slice(start[k], start[k] + size[k])
                yield rows(SHORT, sig[own], node[own], node[own])
            for n in np.unique(size[~is_hot & ~marks]):
                if n > 1:
                    block = node[start[(size == n) & ~is_hot & ~marks][:, None] + np.arange(n)]
                    i, j = np.triu_indices(n, 1)
                    pairs.append(np.stack([block[:, i].ravel(), block[:, j].ravel()], axis=1))
                    waiting += len(pairs[-1])
            for k in np.flatnonzero(is_hot & ~marks):
                own = slice(start[k], start[k] + size[k])
                if leader is None or leader[0] != sig[start[k]]:
                    leader = (int(sig[start[k]]), int(node[start[k]]))
                members = node[own]
                yield rows(GROUP, sig[own], members, members)
                others = members[members != leader[1]]
                pairs.append(np.stack([np.full(len(others), leader[1]), others], axis=1))
                waiting += len(others)
            if waiting > 500_000:
                yield distinct()
                pairs.clear()
                waiting = 0

        for batch in batches:
            sig = np.concatenate([rest_sig, batch.column(0).to_numpy()])
            node = np.concatenate([rest_node, batch.column(1).to_numpy()])
            first = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
            sig, node = sig[first], node[first]
            last = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0
            if len(sig) - last > 4 * hot + 65_536:  # a hot group: all but its last row goes out
                yield from groups(sig[:-1], node[:-1], True)
                rest_sig, rest_node = sig[-1:], node[-1:]
            else:
                yield from groups(sig[:last], node[:last], False)
                rest_sig, rest_node = sig[last:], node[last:]
        yield from groups(rest_sig, rest_node, False)
        if pairs:
            yield distinct()

    return sigs.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, CANDIDATES)


# Comparison ------------------------------------------------------------------------------------
def sift(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sizes and sketches of sets (cid, n, sketch) allow to link."""
    n = lambda x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"))
    sketch_of = lambda x: sets.select(F.col("cid").alias(x), F.col("sketch").alias(f"s_{x}"))
    sized = pairs.select("a", "b").distinct().join(n("a"), "a").join(n("b"), "b")
    possible = runtime.table(sized.filter("3 * greatest(n_a, n_b) <= 4 * least(n_a, n_b)"))
    joined = possible.join(sketch_of("a"), "a").join(sketch_of("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, total = (batch.column(k).to_numpy() for k in range(3))
            far = np.fromiter((sketch_distance(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(4), strict=True)), np.int64, batch.num_rows)
            keep = near_enough(far, total)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return joined.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), "s_a", "s_b").mapInArrow(run, "a long, b long")


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the whole sets of their texts (node, text)."""
    involved = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = texts.join(runtime.bounded_broadcast(runtime.table(involved)), "node", "left_semi").select("node", "text")
    side = lambda x: needed.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in kernel.slices(batch, "t_a"):
                for part in kernel.slices(half, "t_b"):
                    keep = []
                    for x, y in zip(shingle_sets(part.column(2)), shingle_sets(part.column(3)), strict=True):
                        n = len(x) + len(y)
                        merged = np.sort(np.concatenate([x, y]))
                        common = int((merged[1:] == merged[:-1]).sum())
                        keep.append(n > 0 and near_enough(n - 2 * common, n))
                    at = pa.array(np.flatnonzero(keep))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component of labels (node, component)."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def bound_of(size: Column, band: Column) -> Column:
    """:func:`bound` of columns."""
    starts = F.array(*(F.lit(x) for x in STARTS[:78]))
    at = lambda k: F.element_at(starts, k + 1)
    return F.floor((size + F.when(size >= at(band + 1), at(band + 1) - 1).otherwise(F.least(F.floor(4 * size / 3), at(band + 2) - 1))) / 7)


def reserve_of(h: Column) -> Column:
    return 3 + F.floor(h / 8)


def marks_of(candidates: DataFrame) -> DataFrame:
    """node, band, short: what sets lack of their reserve."""
    mark = F.lit(MARK) - F.col("sig")
    marks = candidates.filter(F.col("kind") == SHORT).select(F.col("a").alias("node"), F.shiftright(mark, 32).cast("int").alias("band"), mark.bitwiseAND((1 << 32) - 1).alias("short"))
    return marks.groupBy("node", "band").agg(F.max("short").alias("short"))


def holders(candidates: DataFrame, sets: DataFrame, exact: list[int]) -> DataFrame:
    """node, needed, offered: of the hot signatures of sets, those where a set must meet all others who offer them.

    Where hot signatures are worth more than a set's reserve in a band, it lacks worth for H + 1. Of two
    linked sets that share no other signature, the one whose walk ends first is such a set y, and they
    share more hot ones than its reserve. In one order of signatures, by number, the first they share is
    then so early with both that as many follow: y needs its first ones but for the reserve, and the
    other offers its first ones but for the least reserve of sets in need. All this holds in bands of
    ``exact`` subsets; in others, where one may be worth 2 and is one of several rows, all are needed and
    offered. No array is longer than a set has signatures.
    """
    held = candidates.filter(F.col("kind") == GROUP).groupBy(F.col("a").alias("node")).agg(F.sort_array(F.collect_set("sig")).alias("sigs"))
    marks = marks_of(candidates).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("band", "short"))).alias("short"))
    band_of_sig = lambda sig: F.shiftright(sig, 56).cast("int")

    def of_band(band: Column) -> Column:
        short = F.coalesce(F.get(F.map_values(F.map_filter("short", lambda k, _: k == band)), F.lit(0)), F.lit(0))
        return F.struct(band.alias("band"), (reserve_of(bound_of(F.col("n"), band)) - short).alias("spare"), F.filter("sigs", lambda sig: band_of_sig(sig) == band).alias("own"))

    sized = held.join(sets.select(F.col("cid").alias("node"), "n"), "node").join(marks, "node", "left")
    by_band = runtime.table(sized.select("node", F.transform(F.array_distinct(F.transform("sigs", band_of_sig)), of_band).alias("bands")))
    is_exact = lambda b: b["band"].isin(exact)
    lacks = lambda b: F.when(is_exact(b), F.size(b["own"]) - b["spare"]).when(2 * F.size(b["own"]) > b["spare"], F.size(b["own"])).otherwise(0)
    each = by_band.select(F.explode("bands").alias("b"))
    least = {r.band: r.least if r.band in exact else 0 for r in each.filter(lacks(F.col("b")) > 0).groupBy("b.band").agg(F.min("b.spare").alias("least")).collect()}  # at most 76 rows
    kept = F.create_map(*(x for k, v in sorted(least.items()) for x in (F.lit(k), F.lit(max(0, v))))) if least else F.create_map().cast("map<int,bigint>")
    first = lambda b, n: F.slice(b["own"], F.lit(1), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("int"))
    needed = F.flatten(F.transform("bands", lambda b: first(b, lacks(b))))
    offered = F.flatten(F.transform("bands", lambda b: first(b, F.size(b["own"]) - F.try_element_at(kept, b["band"]))))
    return by_band.select("node", needed.alias("needed"), offered.alias("offered")).filter(F.size("offered") > 0)


class Held:
    """The saturated sets of one block, by sketch length, for distances to sets passing by."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        self.node = np.array([r[0] for r in rows], dtype=np.int64)
        self.component = np.array([r[1] for r in rows], dtype=np.int64)
        self.size = np.array([r[2] for r in rows], dtype=np.int64)
        width = np.array([len(r[3]) for r in rows])
        self.by_width = {int(w): (at := np.flatnonzero(width == w), np.stack([np.frombuffer(rows[k][3], np.uint64) for k in at])) for w in np.unique(width)}
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def distances(self, sketch: bytes) -> np.ndarray:
        """A lower bound of the difference to each set held."""
        own, out = np.frombuffer(sketch, np.uint64), np.empty(len(self.node), dtype=np.int64)
        for width, (at, matrix) in self.by_width.items():
            n = min(width // 8, len(own))
            if n < width // 8:
                if (width, n) not in self.folded:
                    self.folded[width, n] = np.bitwise_xor.reduce(matrix.reshape(len(at), -1, n), axis=1)
                matrix = self.folded[width, n]
            out[at] = np.bitwise_count(matrix ^ fold(own, n)).sum(axis=1, dtype=np.int64)
        return out


def within_groups(held: DataFrame, sets: DataFrame, spanning: bool, block: int = 8192) -> DataFrame:
    """a, b: pairs across components that share a hot signature, one of them in need of it, and that sketches allow; of sets held (node, component, needed, offered).

    Most members of a group are mostly of one component, being copies of one text. Its needy sets are
    hosts, whatever groups they are in, and all others of such groups are guests who meet them once.
    What is left of a group, its other members and those of its first component that are not in need
    of it, meets within the group, if one is in need. Those who are met are dealt into blocks of about
    ``block``, and the others pass by each. If ``spanning``, a block takes the pairs it gives for links
    and gives no pair between what they connect, so it gives fewer than it has sets. Where all of them
    turn out to be links, that left nothing out.
    """
    member = held.select("node", "component", "needed", F.explode("offered").alias("sig"))
    member = runtime.table(member.select("sig", "node", "component", F.array_contains("needed", F.col("sig")).alias("full")))
    parts = member.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("n"), F.count_if("full").alias("fulls"))
    largest = F.max(F.struct("n", "component", "fulls"))
    mixed = parts.groupBy("sig").agg(largest.alias("first"), F.sum("fulls").alias("fulls"), F.count(F.lit(1)).alias("parts")).filter("parts > 1 and fulls > 0")
    mixed = runtime.table(mixed.select("sig", F.col("first.component").alias("first"), (F.col("first.fulls") > 0).alias("hosted"), (F.col("fulls") > F.col("first.fulls")).alias("inner")))
    left = member.join(runtime.bounded_broadcast(mixed), "sig").filter("(component <> first and (hosted or inner)) or (component = first and inner and not full)")
    left = runtime.table(left)
    guests = left.filter("hosted and component <> first").select(F.lit(0).alias("kind"), F.col("first").alias("key"), "node", "component").distinct()
    several = left.filter("inner").select(F.lit(1).alias("kind"), F.col("sig").alias("key"), "node", "component", "full")
    hosts = held.filter(F.size("needed") > 0).select("node", "component")
    hosts = hosts.join(runtime.bounded_broadcast(runtime.table(guests.select(F.col("key").alias("component")).distinct())), "component", "left_semi")
    met = runtime.table(hosts.select(F.lit(0).alias("kind"), F.col("component").alias("key"), "node", "component").unionByName(several.filter("full").drop("full")))
    blocks = runtime.table(met.groupBy("kind", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    blocks = runtime.bounded_broadcast(blocks)
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.join(blocks, ["kind", "key"]).select("kind", "key", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "node", "component")
    passing = guests.unionByName(several.drop("full")).join(blocks, ["kind", "key"]).select("kind", "key", each.alias("block"), F.lit(1).alias("role"), "node", "component")
    rows = runtime.table(met.unionByName(passing))
    involved = runtime.bounded_broadcast(runtime.table(rows.select(F.col("node").alias("cid")).distinct()))
    sketched = sets.join(involved, "cid", "left_semi").select(F.col("cid").alias("node"), "n", "sketch")
    dealt = rows.join(sketched, "node").select("kind", "key", "block", "role", "node", "component", "n", "sketch").repartition("kind", "key", "block").sortWithinPartitions("kind", "key", "block", "role", "component", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, there = None, [], None
        for batch in batches:
            out = set()
            for *group, role, node, comp, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != group:
                    key, waiting, there = group, [], None
                if role == 0:
                    waiting.append((node, comp, n, own))
                    continue
                if not waiting:
                    continue
                if there is None:
                    there, joined = Held(waiting), {}
                while comp in joined:
                    comp = joined[comp]
                other = (there.component != comp) & (3 * np.maximum(there.size, n) <= 4 * np.minimum(there.size, n))
                if not other.any():
                    continue
                distance = there.distances(own)
                other &= near_enough(distance, there.size + n)
                while other.any():
                    k = int(np.where(other, distance, np.iinfo(np.int64).max).argmin())
                    out.add((min(node, int(there.node[k])), max(node, int(there.node[k]))))
                    other[k] = False
                    if spanning:
                        old = int(there.component[k])
                        joined[old] = comp
                        there.component[there.component == old] = comp
                        other &= there.component != comp
            a, b = zip(*sorted(out), strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def links_of(texts: DataFrame, sets: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect what is linked, and labels (node, component), of classes with texts (node, text) and sets (cid, n, sketch)."""
    band = F.size(F.filter(F.array(*(F.lit(x) for x in STARTS[:76])), lambda x: x <= F.col("n"))) - 1
    sizes = {r.band: r.sets for r in sets.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("sets")).collect()}  # at most 76 rows
    counts = {b: sizes.get(b, 0) + sizes.get(b + 1, 0) for b in {x for k in sizes for x in (k, k - 1) if x >= 0}}
    if not counts:  # no text has a word
        nothing = texts.sparkSession.createDataFrame([], "a long, b long")
        return nothing, nothing.toDF("node", "component")
    levels = dict.fromkeys(counts, 0)
    todo, found, exact = set(counts), [], set(counts)
    while todo:
        plans = {b: allocate(b, counts[b], levels[b]) for b in todo}
        exact -= {b for b in todo if plans[b].deletions}
        low, high = STARTS[min(todo)], STARTS[max(todo) + 2]
        chosen = texts if len(todo) == len(counts) else texts.join(runtime.bounded_broadcast(runtime.table(sets.filter(F.col("n").between(low, high)).select(F.col("cid").alias("node")))), "node", "left_semi")
        candidates = runtime.table(meet(signatures(chosen, plans), hot))
        found.append(candidates)
        lacking = marks_of(candidates).join(sets.select(F.col("cid").alias("node"), "n"), "node").filter(F.col("short") > reserve_of(bound_of(F.col("n"), F.col("band"))))
        todo = {r.band for r in lacking.select("band").distinct().collect()}  # at most 76 rows
        for b in todo:
            levels[b] += 1
    everything = found[0]
    for x in found[1:]:
        everything = everything.unionByName(x)
    pairs = runtime.table(sift(everything.filter(F.col("kind") == PAIR), sets))
    first = runtime.table(compare(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts))
    labels = runtime.table(components(first))
    links, rest = first, runtime.table(apart(pairs, labels))
    if rest.limit(1).count():
        links = first.unionByName(runtime.table(compare(rest, texts)))
        labels = runtime.table(components(links))
    held = runtime.table(holders(everything, sets, sorted(exact)))
    named = lambda rows: rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tried = None
    for spanning in (True, False):  # likely links first; then all that are still apart, among components where one was none
        if not held.filter(F.size("needed") > 0).limit(1).count():
            break
        more = within_groups(runtime.table(named(held)), sets, spanning)
        more = runtime.table(more if tried is None else more.join(tried, ["a", "b"], "left_anti"))
        linked = runtime.table(compare(more, texts))
        links, tried = links.unionByName(linked), more
        failed = runtime.table(more.join(linked, ["a", "b"], "left_anti"))
        labels = runtime.table(components(links))
        if not spanning or not failed.limit(1).count():
            break
        ends = named(failed.select(F.col("a").alias("node")).unionByName(failed.select(F.col("b").alias("node"))))
        doubtful = runtime.bounded_broadcast(runtime.table(ends.select("component").distinct()))
        held = runtime.table(named(held).join(doubtful, "component", "left_semi").drop("component"))
    return links, labels


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for every row of docs (doc_id, text)."""
    runtime.ship(docs.sparkSession)
    base = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("node"), "text", F.xxhash64("text").alias("text_hash"))
    described = runtime.table(describe(base))
    classes = runtime.table(described.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("node").alias("cid")))
    members = runtime.table(described.select("node", "text_hash", "n", "f1", "f2").join(runtime.bounded_broadcast(classes), ["f1", "f2", "n"], "left").select("node", "text_hash", "n", F.coalesce("cid", "node").alias("cid")))
    others = runtime.table(members.filter("n = 0 or node <> cid").select("node", "text_hash").distinct())
    firsts = described.join(runtime.bounded_broadcast(others), ["node", "text_hash"], "left_anti")
    sets = runtime.table(firsts.select(F.col("node").alias("cid"), "n", "sketch"))
    runtime.drop(described)
    texts = base.join(runtime.bounded_broadcast(others), ["node", "text_hash"], "left_anti").select("node", "text")
    _, labels = links_of(texts, sets, hot)
    same = _one_document(members, labels)
    named = members.select("node", "text_hash", "n", "cid").join(same.withColumnRenamed("node", "cid"), "cid", "left")
    component = F.coalesce("component", "cid")
    restore: Column = lambda c: F.when(c != NULL_ID, c)
    return named.select(restore(F.col("node")).alias("doc_id"), "text_hash", F.col("n").alias("n_shingles"), restore(component).alias("component_id"))


def _one_document(members: DataFrame, labels: DataFrame) -> DataFrame:
    """labels, with rows of equal doc_ids joined into one component; without such rows, labels as they are."""
    twice = runtime.table(members.groupBy("node").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo <> hi"))
    if not twice.limit(1).count():
        return labels
    bridges = twice.join(members.select("node", "cid"), "node").select(F.col("lo").alias("a"), F.col("cid").alias("b"))
    return runtime.table(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(bridges)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of texts the row with the smallest doc_id stays (null before all), of rows alike in both, one.

    Where doc_ids repeat or are null, rows are told apart by doc_id and text, so texts that only share an id stay apart.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if unclear.limit(1).count():
        return _one_row(docs)
    found = runtime.table(near_duplicates(docs))
    gone = runtime.table(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    return docs.join(runtime.bounded_broadcast(gone), "doc_id", "left_anti")


def _one_row(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of texts, by ids made of doc_id and text."""
    own = docs.withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    found = near_duplicates(own.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    named = runtime.table(own.select("doc_id", "_row").join(runtime.table(found.distinct()), "_row"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "_row")).getField("_row")
    stay = runtime.table(named.groupBy("component_id").agg(first.alias("_row")).select("_row"))
    kept = own.join(runtime.bounded_broadcast(stay), "_row", "left_semi")
    twice = runtime.table(named.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_row"))
    twice = runtime.bounded_broadcast(twice)
    alike = kept.join(twice, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.join(twice, "_row", "left_anti").unionByName(alike).drop("_row")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), r AS (SELECT doc_id AS d, doc_id AS z FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON r.z = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(z) FROM r WHERE r.d = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
