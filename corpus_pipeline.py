"""A training corpus from raw documents: toxicity, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; run() writes it as Parquet
to the shared folder and reads it again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm import minhash_dedup, packing, substring_dedup, toxicity
from pagelattice.llm.common import table, written

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. The model learns from the labelled rows of `docs` that are not held out."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, the one with the smallest doc_id stays."""
    return minhash_dedup.near_dedup(docs, k=5, threshold=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 20 words or more that an earlier document has, or the same one further up, go; the text of a document that loses none
    stays as it is, and n_chars follows the text."""
    columns = docs.columns
    # by place: the columns of documents can have any names
    out = substring_dedup.dedup(docs, columns=columns).toDF(*(f"d{i}" for i in range(len(columns))), "n_words", "n_removed", "sha256", "kept")
    removed = F.col("n_removed") > 0
    values = {c: F.col(f"d{i}") for i, c in enumerate(columns)}
    values["text"] = F.col("kept")
    if "n_chars" in values:
        values["n_chars"] = F.when(removed, F.length("kept")).otherwise(values["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in values.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, str(public_tokenizers.path(TOKENIZER)))


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("best_fit_packing", pack)]

#: The learned scores and the tokens have no SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
