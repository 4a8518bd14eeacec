"""Language identification (operator 4): multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of whole texts over all labelled rows: every batch adds into a dense
language x bucket matrix, a partition emits its cells once, and Spark sums them. The matrix of log
probabilities (languages x ``buckets`` float32; at most ``max_langs`` languages, checked) is
broadcast, and texts are scored in numpy slices by gathering matrix rows and summing per text. A
byte of text takes some 100 bytes meanwhile, so slices are of ``SLICE_BYTES``; a longer text is one.

Texts are lower-cased; every character that is not a letter counts as one space, repeated spaces
count once, so digits, markup and layout carry no evidence. n-grams have 1 to 3 characters.

Defined results: a text that is null or has no letter gives ``und`` and score 0, as do all texts
if there is nothing to learn from. Ties go to the language first in code-point order. Repeated
rows are scored alike. A text may be of any length; its evidence is summed whole. Extra columns are
kept, but for those named like the results; ``query`` reads doc_id, text and lang only, so a column
named held_out is ignored. ``stage`` drops documents that are ``und`` or have a score below
``min_score`` and returns the five columns of documents, whatever others there are; repeated rows
and rows without a doc_id go or stay by their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from strokeloom import runtime
from strokeloom.llm import kernel

UNKNOWN = "und"
SLICE_BYTES = 250_000
SPACE = np.uint64(32)
_LETTER = np.zeros(0x110000, dtype=np.int8)  # 0: not looked up yet, 1: letter, -1: none


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    prior: np.ndarray  # log, by language
    weight: np.ndarray  # buckets x languages, float32 log probabilities


def is_letter(points: np.ndarray) -> np.ndarray:
    known = _LETTER[points]
    if not known.all():
        for p in np.unique(points[known == 0]).tolist():
            _LETTER[p] = 1 if chr(p).isalpha() else -1
        known = _LETTER[points]
    return known > 0


def grams(texts: list[str | None], buckets: int, orders: tuple[int, ...]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the row and the bucket of every n-gram; and which rows have a letter."""
    joined = "\0".join((t or "").replace("\0", " ").lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    breaks = points == 0
    letter = is_letter(points)
    row = np.cumsum(breaks, dtype=np.int32)
    keep = letter | breaks
    keep[1:] |= letter[:-1]  # the first of several characters between letters stands for them all
    if len(keep):
        keep[0] = True
    code = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64)
    row, has = row[keep], np.zeros(len(texts), dtype=bool)
    has[row[code != SPACE]] = True
    out, total = [], np.zeros(len(code), dtype=np.uint64)
    for k in range(1, max(orders) + 1):
        n = len(code) - k + 1
        if n <= 0:
            break
        total = total[:n] + code[k - 1 :] * kernel.POSITION_CODES[k]
        if k in orders:
            whole = row[:n] == row[k - 1 :]
            if k == 1:
                whole = whole & (code != SPACE)
            out.append((row[:n][whole], (kernel.mix(total[whole]) % np.uint64(buckets)).astype(np.int64)))
    return out, has


def counted(batches: Iterator[pa.RecordBatch], buckets: int, orders: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The cells of a partition of rows (lang, text)."""
    kernel.turn_to("langid")
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in kernel.slices(batch, "text", SLICE_BYTES):
            langs = part.column(0).to_pylist()
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])
            found, _ = grams(part.column(1).to_pylist(), buckets, orders)
            cells = np.bincount(which * (buckets + 1), minlength=len(names) * (buckets + 1))
            for row, gram in found:
                cells += np.bincount(which[row] * (buckets + 1) + gram + 1, minlength=len(cells))
            for name, own in zip(names, cells.reshape(len(names), -1), strict=True):
                seen[name] = seen.get(name, 0) + own
    for name, own in seen.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array((at - 1).astype(np.int32)), pa.array(own[at].astype(np.int64))], names=["lang", "bucket", "n"])
    kernel.give_back()


def train_counts(labelled: DataFrame, buckets: int, orders: tuple[int, ...]) -> DataFrame:
    """lang, bucket, n summed over all rows; bucket -1 counts the rows."""
    runtime.ship(labelled.sparkSession)
    cells = labelled.select("lang", "text").mapInArrow(lambda batches: counted(batches, buckets, orders), "lang string, bucket int, n long")
    return cells.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, buckets: int = 1 << 13, orders: tuple[int, ...] = (1, 2, 3), smoothing: float = 0.5, max_langs: int = 256) -> Model:
    """The model of rows with lang and text. What reaches the driver has at most max_langs x (buckets + 1) cells."""
    cells = runtime.table(train_counts(labelled.filter("lang is not null and text is not null"), buckets, orders))
    langs = sorted(r[0] for r in cells.select("lang").distinct().limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages; the broadcast matrix is bounded by max_langs")
    table = cells.toArrow()
    which = {x: i for i, x in enumerate(langs)}
    n = np.zeros((buckets + 1, len(langs)))
    if table.num_rows:
        n[table["bucket"].to_numpy() + 1, [which[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    rows, n = n[0], n[1:] + smoothing
    return Model(tuple(langs), np.log(np.maximum(rows, 1) / max(rows.sum(), 1)), np.log(n / n.sum(axis=0, keepdims=True)).astype(np.float32))


def score(model: Model, texts: list[str | None], orders: tuple[int, ...]) -> tuple[list[str], np.ndarray]:
    """Language and posterior of its being right, by text: prior and evidence of all n-grams, summed."""
    n_rows, n_langs = len(texts), len(model.langs)
    found, has = grams(texts, max(len(model.weight), 1), orders)
    if not n_langs:
        return [UNKNOWN] * n_rows, np.zeros(n_rows)
    log = np.tile(model.prior, (n_rows, 1))
    for row, gram in found:
        bounds = np.searchsorted(row, np.arange(n_rows + 1))
        full = np.flatnonzero(np.diff(bounds))
        for k in range(n_langs):
            if len(full):
                own = np.add.reduceat(model.weight[:, k][gram], bounds[full], dtype=np.float64)
                log[full, k] += own
    log -= log.max(axis=1, keepdims=True)
    p = np.exp(log)
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [model.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, p[np.arange(n_rows), best], 0.0)


def scored(batches: Iterator[pa.RecordBatch], model: Model, orders: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Batches with a column text, and lang_pred and score added."""
    kernel.turn_to("langid")
    for batch in batches:
        for part in kernel.slices(batch, "text", SLICE_BYTES):
            lang, p = score(model, part.column(part.schema.get_field_index("text")).to_pylist(), orders)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(p)], names=[*part.schema.names, "lang_pred", "score"])
    kernel.give_back()


def predict(docs: DataFrame, model: Model, orders: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs with lang_pred and score, from text alone."""
    spark, docs = runtime.ship(docs.sparkSession), docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(lambda batches: scored(batches, shared.value, orders), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that take no part in learning: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str, min_score: float = 0.5) -> DataFrame:
    """Pipeline stage: learns as the query does and drops documents without a language; lang becomes the prediction."""
    model = fit(docs.filter(~held_out()))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    scored = predict(docs.select(*columns), model)
    kept = scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")
