"""From raw documents to packed sequences: five stages, each by one operator of tidemill.llm.

All stages but the last take and return rows of documents (all their columns, and any extra
ones). Rows with a null doc_id are never dropped as copies or leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import stored, table
from tidemill.llm.decontamination import remove_leaks
from tidemill.llm.language_id import fit, predict
from tidemill.llm.near_dedup import near_duplicates
from tidemill.llm.packing import pack_documents
from tidemill.llm.substring_dedup import remove_repeats


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with neutral column names, so that none clashes with an operator's, and the names it had."""
    names = {c: f"column_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Null, empty and letterless texts go, and no others where no language is known."""
    model = fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    plain, names = _numbered(docs)
    told = predict(plain, model, id_col=names["doc_id"], text_col=names["text"], keep=tuple(plain.columns))
    return told.where("lang_pred <> 'und'").select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by five-word shingles: the least id."""
    gone = stored(near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document holds; texts that lose nothing stay as they are, and documents that lose every word go."""
    plain, names = _numbered(docs)
    text = names["text"]
    cut = remove_repeats(plain, id_col=names["doc_id"], text_col=text)
    cut = cut.where("n_removed = 0 OR n_removed < n_words").withColumn(text, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(text)))
    if "n_chars" in names:
        n_chars = names["n_chars"]
        cut = cut.withColumn(n_chars, F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n_chars)))
    return cut.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, nor one with up to a fifth of its characters edited."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences of 2048."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: SQL can express neither the model nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
