"""Lines that stand in many documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.keys import hash_pair, weighted_join


def drop_repeated_lines(docs: DataFrame, most: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col less the lines that stand in more than `most` documents, and n_lines and n_dropped (long).

    Lines are parted by line feeds and compared without spaces and tabs at their ends; empty ones always stay. A line
    repeated so stays where it stands in the document of the least id only. id_col must be a key; its nulls stay as they are.
    A null text has no lines.

    A line's documents are counted in two steps: distinct pairs of line and document first, so that a line of very many documents is
    spread over all tasks, then counts by task. Only hashes of lines are exchanged; texts move once, to be cut.
    """
    parts = F.split(text_col, "\n", -1)
    h1, h2 = hash_pair(F.col("line__"))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id__"), F.posexplode(parts).alias("k__", "raw__")).withColumn("line__", F.trim(F.col("raw__"), F.lit(" \t"))).where("line__ <> ''")
    keyed = lines.select("id__", "k__", h1.alias("h1"), h2.alias("h2"))
    often = keyed.select("h1", "h2", "id__").distinct().groupBy("h1", "h2").agg(F.min("id__").alias("first__"), F.count("*").alias("n__")).where(F.col("n__") > most)
    met = weighted_join(keyed, often, "n__").where("first__ < id__")
    gone = met.groupBy("id__").agg(F.array_sort(F.collect_list("k__")).alias("gone__"))
    known = docs.join(gone, docs[id_col] == gone["id__"], "left")
    # runs of lines between those that go: from behind one gone line to the next
    cut = F.concat(F.array(F.lit(-1)), F.col("gone__"))
    kept = F.flatten(F.transform(cut, lambda k, i: F.slice(parts, k + 2, F.coalesce(F.get(F.col("gone__"), i), F.size(parts)) - k - 1)))
    text = F.when(F.col("gone__").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    n_dropped = F.when(F.col("gone__").isNull(), F.lit(0)).otherwise(F.size("gone__")).cast("long")
    return known.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
