"""The corpus pipeline: stages over documents, each on all that its predecessor kept.

1. language ID: documents without letters or far from every learned language go;
2. toxicity: documents that score one half or more go;
3. n-gram Jaccard join: one document of each group of (near) copies stays;
4. substring dedup: words of repeated 35-word windows go, and `n_chars` follows the text;
5. packing: what is left, in sequences of at most 2048 ids.

Learned stages (1, 2) fit on the rows of their own input that are not held out. SQL cannot express stages 1, 2 and 5, so
there is no oracle; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txloom.llm import jaccard, langid, packing, substring, toxicity
from txloom.llm.common import stage, table, unstage

STAGES = [
    ("language_id", langid.keep_identified),
    ("toxicity", toxicity.keep_clean),
    ("ngram_jaccard_join", jaccard.keep_first),
    ("substring_dedup", substring.cut_repeats),
    ("packing", packing.pack_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; every stage but the last is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
