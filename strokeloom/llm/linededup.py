"""Removal of lines that many sites share (operator 1), DataFrame functions only.

A HyperLogLog sketch of sites is built per line hash and merged by the aggregation, so a line on a
third of all pages reaches a reducer as one sketch per map task. Lines whose estimate is clearly
above or below ``min_sites`` are decided by it; those within ``band`` of it get exact distinct
counts. Lines found on at least ``min_sites`` sites are boilerplate, and every document loses them.

A document most of whose characters (more than ``max_share``) are in such lines is not a page
with boilerplate but a copy of a whole document; it is left as it is, for near-duplicate removal.
So no text disappears from the corpus altogether.

Lines are compared without white space at their ends, by 128 bits of hash; those with fewer than
``min_chars`` characters are never boilerplate. The SQL of ``query`` sets that length at 12; the
pipeline's stage takes every line that is not blank, so there the sites alone decide. The order and
the layout of what stays is kept.

Defined results: a null text stays null with 0 lines; an empty text has one line. A null site is a
site of its own. Rows with equal doc_ids are each judged with their own text. An empty table gives
no rows. ``dedup`` keeps extra columns, but for those named like its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokeloom import runtime

BLANK = " \t\r\f\x0b"
MIN_SITES, BAND, MIN_CHARS, MAX_SHARE = 8, 0.25, 12, 0.5


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def key(line: Column) -> Column:
    t = trimmed(line)
    return F.struct(F.xxhash64(F.lit(1), t).alias("h1"), F.xxhash64(F.lit(2), t).alias("h2"))


def line_keys(docs: DataFrame, min_chars: int, site: str = "source") -> DataFrame:
    """doc_id, site, h1, h2 of every line that may be boilerplate."""
    lines = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col(site)), F.lit("")).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(F.length(trimmed(F.col("line"))) >= min_chars).select("doc_id", "site", key(F.col("line")).alias("k")).select("doc_id", "site", "k.h1", "k.h2")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, min_chars: int = MIN_CHARS, site: str = "source", lg_k: int = 12) -> DataFrame:
    """h1, h2 of the lines on at least min_sites sites, as a written table."""
    lines = line_keys(docs, min_chars, site)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    maybe = runtime.table(spread.filter(F.col("sites") >= min_sites * (1 - band)))
    near = runtime.bounded_broadcast(maybe.filter(F.col("sites") <= min_sites * (1 + band)).select("h1", "h2"))
    counted = lines.join(near, ["h1", "h2"]).groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
    clear = maybe.filter(F.col("sites") > min_sites * (1 + band)).select("h1", "h2")
    return runtime.table(clear.unionByName(counted.filter(F.col("sites") >= min_sites).select("h1", "h2")))


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, min_chars: int = MIN_CHARS, max_share: float = MAX_SHARE, site: str = "source") -> DataFrame:
    """docs with text cleaned and with n_lines and n_removed added."""
    docs = docs.drop("_drop", "_kept", "_doc_id")
    found = runtime.bounded_broadcast(boilerplate(docs, min_sites, band, min_chars, site))
    hits = line_keys(docs, min_chars, site).join(found, ["h1", "h2"])
    flags = hits.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("_drop")).withColumnRenamed("doc_id", "_doc_id")
    joined = docs.join(flags, F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    lines = F.split("text", "\n")
    flagged = lambda x: (F.length(trimmed(x)) >= min_chars) & F.array_contains(F.col("_drop"), key(x))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(trimmed(x)))
    kept = F.when(F.col("_drop").isNotNull(), F.filter(lines, lambda x: ~flagged(x)))
    marked = joined.withColumn("_kept", kept)
    cleaned = F.when(F.col("_drop").isNotNull() & (chars(F.col("_kept")) >= (1 - max_share) * chars(lines)), F.col("_kept"))
    done = marked.withColumn("_kept", cleaned)
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return done.select(
        *others,
        F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_kept")).cast("long").alias("n_removed"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all rows, texts without shared lines of whatever length, n_chars counted anew; other columns are dropped."""
    cleaned = dedup(docs.select("doc_id", "text", "lang", "source", "n_chars"), min_chars=1)
    return cleaned.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL, with exact counts throughout: doc_id, n_lines, n_removed, text and the other columns."""
    trim = r"trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11))"
    return rf"""
SELECT d.* EXCLUDE (text, rid), CASE WHEN 2 * r.kept_chars >= r.all_chars THEN r.kept ELSE d.text END AS text,
       CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines,
       CAST(CASE WHEN 2 * r.kept_chars >= r.all_chars THEN r.n_lines - r.n_kept ELSE 0 END AS BIGINT) AS n_removed
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rid FROM {documents}) d LEFT JOIN (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (NOT drop_it) AS n_kept, sum(chars) AS all_chars,
         coalesce(sum(chars) FILTER (NOT drop_it), 0) AS kept_chars,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop_it), '') AS kept
  FROM (
    SELECT rid, pos, line, length(t) AS chars, length(t) >= {MIN_CHARS} AND sites >= {MIN_SITES} AS drop_it FROM (
      SELECT l.*, s.sites FROM (
        SELECT rid, pos, line, {trim} AS t FROM (
          SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
          FROM (SELECT text, row_number() OVER (ORDER BY doc_id) AS rid FROM {documents}))) l
      JOIN (
        SELECT t AS st, count(DISTINCT site) AS sites FROM (
          SELECT site, {trim} AS t FROM (
            SELECT coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line FROM {documents}))
        GROUP BY 1) s ON l.t = s.st)) GROUP BY rid) r USING (rid)
"""


ORACLE = f"SELECT doc_id, n_lines, n_removed, text FROM ({oracle('(SELECT doc_id, text, source FROM documents)')})"
