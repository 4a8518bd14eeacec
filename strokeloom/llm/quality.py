"""Quality rules with adaptive thresholds (operator 3).

``measure`` counts, for every whole text, what the rules need, in one vectorised pass.
``sketches`` builds a quantile sketch per language, source and rule: counts per bucket of a
log-linear scale with ``2**SUB_BITS`` buckets an octave, so a quantile is off by less than 1/64 of
itself, its rank by none beyond, and a sketch has some 2,300 buckets at most whatever the data.
Merging is a sum by the aggregation, on the JVM, so its order does not matter and reruns agree.
``fences`` takes Tukey fences from the quartiles: q3 + reach * (q3 - q1), and q1 - reach * (q3 - q1)
where low values fail too. There is no least spread: the fences of a group are its data's alone, but
that the quartiles of a group of n documents are drawn to those of its language, and those of a
language to those of all, with the weight of ``weight`` documents against n. ``verdicts`` joins each
document with the fences of its group. A document of n words or lines has its share with a standard
error that falls with the root of n, so it fails only if its count is beyond the fence by more than
the rule's ``allowance`` times sqrt(n); that is what protects short texts, and the only constant.

Sketches take documents that pass the base rule. A null language or source is a group of its own.

Defined results: a null or empty text has no words and fails the base rule. Repeated rows and equal
doc_ids are judged row by row, ties with a fence are kept, and a text may be of any length. An empty
table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strokeloom import runtime
from strokeloom.llm import kernel

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: rule: what is counted, out of what, allowance, whether low values fail too
RULES = {
    "word_length": ("word_chars", "n_words", 9, True),
    "symbols": ("n_symbols", "n_words", 1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1, False),
    "repeats": ("n_repeat_words", "n_words", 3, False),
}
#: Values are taken as whole multiples of 1 / UNIT.
UNIT, SUB_BITS = 1024, 6


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line of every text; a text has one line more than newlines."""
    breaks = np.flatnonzero(data == 10)
    per_row = np.diff(np.searchsorted(breaks, offsets)) + 1
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offsets[1:]]))
    return start, end, np.repeat(np.arange(len(per_row)), per_row)


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of a column."""
    data, offsets = kernel.text_bytes(column)
    rows, words = len(offsets) - 1, kernel.Words(data, offsets)
    chars = kernel.prefix_counts(kernel.characters(data))
    in_words = np.bincount(words.doc, weights=chars[words.end] - chars[words.start], minlength=rows)
    symbols = kernel.prefix_counts(SYMBOLS[data])[offsets]
    start, end, row = lines(data, offsets)
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, row = start[full], end[full], row[full]
    seen = kernel.mix(kernel.span_hash(data, start, end) ^ kernel.mix(row.astype(np.uint64)))
    _, first = np.unique(seen, return_index=True)
    n_lines = np.bincount(row, minlength=rows)
    at, hashes = words.windows(WINDOW)
    twice = at[repeated(kernel.mix(hashes ^ kernel.mix(words.doc[at].astype(np.uint64))))]
    depth = np.zeros(len(words.doc) + 1, dtype=np.int64)
    depth[twice] += 1
    depth[twice + WINDOW] -= 1
    covered = np.cumsum(depth[:-1]) > 0
    return {
        "n_words": words.count,
        "word_chars": in_words.astype(np.int64),
        "n_symbols": np.diff(symbols),
        "n_dup_lines": n_lines - np.bincount(row[first], minlength=rows),
        "n_repeat_words": np.bincount(words.doc[covered], minlength=rows),
        "n_lines": n_lines,
    }


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns and the counts of each row's whole text."""
    runtime.ship(docs.sparkSession)
    given = docs.select(*keep, F.col(text).alias("_text"))
    schema = StructType([*docs.select(*keep).schema.fields, *(StructField(c, LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "_text"):
                found = counts(part.column(len(keep)))
                columns = [*part.columns[: len(keep)], *(pa.array(found[c].astype(np.int64)) for c in COUNTS)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *COUNTS])

    return given.mapInArrow(run, schema)


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def bucket(rule: str) -> Column:
    """A value's bucket: values below 2**(SUB_BITS + 1) their own, then 2**SUB_BITS to every doubling."""
    top, bottom, _, _ = RULES[rule]
    value = f"CASE WHEN {bottom} > 0 THEN ({UNIT} * {top}) div {bottom} ELSE 0L END"
    shift = f"greatest(length(bin({value})) - {SUB_BITS + 1}, 0)"
    return F.expr(f"shiftleft(cast({shift} AS BIGINT), {SUB_BITS}) + shiftright({value}, {shift})")


def least_value(bucket: str) -> str:
    """SQL of the least value of a bucket, in 1 / UNIT."""
    shift = f"greatest(({bucket} >> {SUB_BITS}) - 1, 0)"
    return f"(({bucket} - ({shift} << {SUB_BITS})) << cast({shift} AS INT))"


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the sketches of the groups. Summing n over groups merges them."""
    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), bucket(r).alias("bucket")) for r in RULES)))
    return measured.filter(~base_failed()).select("lang", "source", cells.alias("c")).groupBy("lang", "source", "c.rule", "c.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(cells: DataFrame, *group: str) -> DataFrame:
    """Group, rule, total and the lower and upper quartile, from sketch cells."""
    merged = cells.groupBy(*group, "rule", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*group, "rule")
    ranked = merged.select("*", F.sum("n").over(whole.orderBy("bucket")).alias("upto"), F.sum("n").over(whole).alias("total"))
    found = ranked.groupBy(*group, "rule").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("b1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("b3"),
    )
    return found.select(*group, "rule", "total", *(F.expr(f"cast({least_value(f'b{k}')} AS DOUBLE)").alias(f"q{k}") for k in (1, 3)))


def fences(measured: DataFrame, weight: int = 100, reach: int = 3) -> DataFrame:
    """lang, source and for every rule its fences in 1 / UNIT (``low_<rule>``, ``high_<rule>``)."""
    cells = runtime.table(sketches(measured))
    rename = lambda df, tag: df.select(*(F.col(c).alias(f"{tag}_{c}") for c in df.columns))
    own, lang, everyone = quartiles(cells, "lang", "source"), rename(quartiles(cells, "lang"), "l"), rename(quartiles(cells), "a")
    joined = own.join(lang, own.lang.eqNullSafe(lang.l_lang) & (own.rule == lang.l_rule)).join(everyone, F.col("rule") == F.col("a_rule"))
    drawn = lambda n, q, to: (F.col(n) * F.col(q) + weight * to) / (F.col(n) + weight)
    chosen = joined.select("lang", "source", "rule", *(drawn("total", q, drawn("l_total", f"l_{q}", F.col(f"a_{q}"))).alias(q) for q in ("q1", "q3")))
    out = []
    for rule, (*_, both) in RULES.items():
        here, spread = F.col("rule") == rule, reach * (F.col("q3") - F.col("q1"))
        out += [F.max(F.when(here, F.col("q1") - spread if both else F.lit(0.0))).alias(f"low_{rule}"), F.max(F.when(here, F.col("q3") + spread)).alias(f"high_{rule}")]
    return chosen.groupBy("lang", "source").agg(*out)


def beyond(rule: str) -> Column:
    """Whether a document's count is beyond a fence by more than its allowance."""
    top, bottom, allowance, _ = RULES[rule]
    n, count, slack = F.col(bottom).cast("double"), F.col(top).cast("double") * UNIT, F.sqrt(F.col(bottom).cast("double")) * (allowance * UNIT)
    return (count - F.col(f"high_{rule}") * n > slack) | (F.col(f"low_{rule}") * n - count > slack)


def judge(docs: DataFrame, weight: int = 100, reach: int = 3) -> DataFrame:
    """All counts, base_failed, the rules that fail and kept for each row of docs (doc_id, text, lang, source)."""
    measured = runtime.table(measure(docs))
    limits = runtime.table(fences(measured, weight, reach).withColumnsRenamed({"lang": "g_lang", "source": "g_source"}))
    joined = measured.join(runtime.bounded_broadcast(limits), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    failed = base_failed()
    rules = F.array_compact(F.array(*(F.when(beyond(r), F.lit(r)) for r in RULES)))
    return joined.select("doc_id", "lang", "source", *COUNTS, failed.alias("base_failed"), rules.alias("failed_rules"), (~failed & (F.size(rules) == 0)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(weight: int = 100, reach: int = 3) -> str:
    """DuckDB SQL for the query."""
    value = lambda r: f"CASE WHEN {RULES[r][1]} > 0 THEN ({UNIT} * {RULES[r][0]}) // {RULES[r][1]} ELSE 0 END"
    cells = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{r}' AS rule, CAST({value(r)} AS BIGINT) AS v, {RULES[r][0]} AS t, {RULES[r][1]} AS n, {RULES[r][2]} AS allowance, {str(RULES[r][3]).lower()} AS both_ways FROM m" for r in RULES)
    shift = f"CAST(greatest(length(bin(v)) - {SUB_BITS + 1}, 0) AS BIGINT)"
    drawn = lambda n, q, to: f"({n} * {q} + {weight} * {to}) / ({n} + {weight})"
    pick = lambda q: drawn("s.n", f"s.{q}", drawn("l.n", f"l.{q}", f"a.{q}"))

    def quartiles(name: str, group: str) -> str:
        part = f"PARTITION BY {group + ', ' if group else ''}rule"
        return f"""{name} AS (SELECT {group + ', ' if group else ''}rule, CAST(max(n) AS DOUBLE) AS n, CAST(min(e) FILTER (4 * r >= n) AS DOUBLE) AS q1, CAST(min(e) FILTER (4 * r >= 3 * n) AS DOUBLE) AS q3 FROM (
  SELECT * EXCLUDE (n), row_number() OVER ({part} ORDER BY e) AS r, count(*) OVER ({part}) AS n FROM good) GROUP BY ALL)"""

    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t
), k AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 7], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
), r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM k) WHERE c > 1) GROUP BY 1
), d AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), m AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM t JOIN w USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN d USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), c AS ({cells}
), good AS (SELECT c.*, (v >> {shift}) << {shift} AS e FROM c JOIN b USING (doc_id) WHERE NOT base_failed
), {quartiles("own", "lang, source")}, {quartiles("by_lang", "lang")}, {quartiles("everyone", "")}
, bad AS (SELECT DISTINCT doc_id FROM (SELECT c.doc_id, CAST(c.t AS DOUBLE) * {UNIT} AS t, CAST(c.n AS DOUBLE) AS n, sqrt(CAST(c.n AS DOUBLE)) * (c.allowance * {UNIT}) AS slack, c.both_ways, {pick("q1")} AS q1, {pick("q3")} AS q3 FROM c
    JOIN own s ON c.rule = s.rule AND c.lang IS NOT DISTINCT FROM s.lang AND c.source IS NOT DISTINCT FROM s.source
    JOIN by_lang l ON c.rule = l.rule AND c.lang IS NOT DISTINCT FROM l.lang JOIN everyone a ON c.rule = a.rule)
  WHERE t - (q3 + {reach} * (q3 - q1)) * n > slack OR CASE WHEN both_ways THEN q1 - {reach} * (q3 - q1) ELSE 0 END * n - t > slack)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b
"""


ORACLE = oracle()
