"""From raw documents to packed training sequences: five stages, each one operator of strokeloom.llm.

Every stage gets all that its predecessor kept, as a table (doc_id, text, lang, source, n_chars),
and returns such a table, but for the last, which returns pieces of sequences. ``run`` writes each
stage's result as Parquet in the shared folder and reads it back, so a lost executor costs tasks of
one stage at most.

1. language: documents without a recognisable language (no letter, or a posterior below 0.5) go; lang becomes the prediction.
2. lines: lines that many sources share are removed from texts.
3. near_duplicates: one document of each group of near copies stays.
4. mixing: documents are repeated or left out so that sources meet their target weights.
5. packing: tokens are packed into sequences of 2048.

Other columns than these five are dropped by the first stage, whatever their names. A null text goes
with the language stage, as an empty one does; a null source is a site and a source of its own; rows
without a doc_id are told apart by their texts. Repeated rows are near duplicates of each other, so
one of them stays. A text may be of any length. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strokeloom import runtime
from strokeloom.llm import jaccard, langid, linededup, mixing, packing

STAGES = [
    ("language", langid.stage),
    ("lines", linededup.stage),
    ("near_duplicates", jaccard.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Language scores and token ids have no SQL form; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = runtime.table(docs)
    return docs
