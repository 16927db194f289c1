"""The corpus pipeline: toxicity, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes each stage's result as Parquet to the shared folder and reads it again for the
next, so a lost executor never costs more than one stage.

Rows with null or repeated ids are documents of their own in every stage; an empty table passes through.
Inside a stage the documents' columns have names of their own, so none can clash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ROW, keyed, written
from quire.llm.exact_dedup import exact_groups
from quire.llm.jaccard_join import jaccard_components
from quire.llm.packing import pack_documents
from quire.llm.substring_dedup import remove_repeated_words
from quire.llm.toxicity import fit, held_out, score_toxicity

#: Documents with this score or more go.
TOXIC = 0.7


class _Rows:
    """The documents with row keys, and columns c0, c1, ... instead of their names."""

    def __init__(self, docs: DataFrame):
        self.columns, self.names = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
        own = dict(zip(self.columns, self.names, strict=True))
        self.text, self.n_chars = own["text"], own.get("n_chars")
        self.rows = keyed(docs.toDF(*self.names), own["doc_id"])

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.names).toDF(*self.columns)

    def kept(self, ids: DataFrame) -> DataFrame:
        """The documents whose key is among ``ids``."""
        return self.named(self.rows.join(ids.select(ROW), ROW, "left_semi"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic. The model learns from the labels of the documents at hand;
    labels of the held-out third are never read."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = fit(docs, labels)
    own = _Rows(docs)
    return own.kept(score_toxicity(own.rows, model, ROW, own.text).where(F.col("score") < TOXIC))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row by id of equal texts."""
    own = _Rows(docs)
    return own.kept(exact_groups(own.rows, ROW, own.text).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row by id of each component of similar documents: five-word shingles, similarity
    of 0.8 or more. Documents without words are no copies of one another here."""
    own = _Rows(docs)
    found = jaccard_components(own.rows, ROW, own.text, shingle=5, percent=80)
    return own.kept(found.where(F.col(ROW) == F.col("component_id")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of repeated passages. Texts without any stay as they are, white space included; a
    document that loses all its words stays with an empty text. ``n_chars`` follows the text."""
    own = _Rows(docs)
    met = own.rows.join(remove_repeated_words(own.rows, ROW, own.text).select(ROW, "n_removed", "kept"), ROW)
    less = F.col("n_removed") > 0
    met = met.withColumn(own.text, F.when(less, F.col("kept")).otherwise(F.col(own.text)))
    if own.n_chars:
        chars = F.when(less, F.length(own.text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own.n_chars))
        met = met.withColumn(own.n_chars, chars)
    return own.named(met)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row per piece."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return pack_documents(docs, f.read())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Scores and packing aren't expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
