"""Quality scores from a sparse rule ensemble over text statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import fold, slices, stored, table
from tidemill.llm._words import LOWER, NOT_SPACE, hashes, spans

#: Byte classes whose shares of a text are statistics.
CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "blank": (0x20, 0x09),
    "line_end": (0x0A, 0x0D),
    "stop": map(ord, ".,;:?"),
    "shout": map(ord, "!"),
    "mark": map(ord, "*$%&#@|<>{}[]=+~^_\\/"),
    "beyond_ascii": range(0x80, 0x100),
}
STATISTICS = [*(f"share_{c}" for c in CLASSES), "n_words", "mean_word", "longest_word", "words_a_line", "distinct_words", "distinct_lines", "repeats_before"]
_CLASS = np.full(256, len(CLASSES))
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _k
_NOT_LINE_END = np.ones(256, bool)
_NOT_LINE_END[[0x0A, 0x0D]] = False


def _distinct(hashed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Share of distinct values among each text's; 1 where it has none."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashed, text))
    t, h = text[order], hashed[order]
    new = np.ones(len(h), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return np.where(counts > 0, np.bincount(t[new], minlength=len(counts)) / np.maximum(counts, 1), 1.0)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and one double for each of STATISTICS, over the whole text. Null and empty texts have noughts, and 1 for the distinct shares."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            n, size = len(part), np.maximum(np.diff(part.offsets), 1)
            text = np.repeat(np.arange(n), np.diff(part.offsets))
            shares = np.bincount(text * (len(CLASSES) + 1) + _CLASS[part.data], minlength=n * (len(CLASSES) + 1)).reshape(n, -1) / size[:, None]
            begin, end, counts = spans(part.data, part.offsets, NOT_SPACE)
            word = hashes(LOWER[part.data], begin, end)
            of, width = np.repeat(np.arange(n), counts), end - begin
            longest = np.zeros(n)
            np.maximum.at(longest, of, width)
            again = np.zeros(len(word), bool)
            again[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
            line_begin, line_end, lines = spans(part.data, part.offsets, _NOT_LINE_END)
            some = np.maximum(counts, 1)
            columns = [
                *shares[:, : len(CLASSES)].T, counts, np.bincount(of, width, n) / some, longest, counts / np.maximum(lines, 1),
                _distinct(word, counts), _distinct(hashes(part.data, line_begin, line_end), lines), np.bincount(of, again, n) / some,
            ]
            ids = part.rows.column(part.rows.schema.get_field_index(id_col))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.asarray(c, float)) for c in columns)], names=[id_col, *STATISTICS])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


#: A rule: conditions (statistic, whether it must exceed the bound, bound), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = 3, least: int = 20, path: Rule = ()) -> list[Rule]:
    """Paths to all nodes of a regression tree on a random half of the statistics at each split."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return []
    best, gain = None, 1e-9
    for k in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
        order = np.argsort(x[:, k], kind="stable")
        v, cum = x[order, k], np.cumsum(y[order])
        at = np.unique(np.linspace(least, len(y) - least, 48).astype(int))
        at = at[v[at - 1] < v[at]]
        if len(at):
            score = cum[at - 1] ** 2 / at + (cum[-1] - cum[at - 1]) ** 2 / (len(y) - at) - cum[-1] ** 2 / len(y)
            if score.max() > gain:
                i = at[score.argmax()]
                best, gain = (int(k), float((v[i - 1] + v[i]) / 2)), score.max()
    if best is None:
        return []
    k, bound = best
    rules = []
    for above in (False, True):
        some = (x[:, k] > bound) == above
        own = (*path, (k, above, bound))
        rules += [own, *tree_rules(x[some], y[some], rng, depth - 1, least, own)]
    return rules


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.all([(x[:, k] > bound) == above for k, above, bound in rule], axis=0)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept isn't penalised."""
    a = np.hstack([z, np.ones((len(z), 1))])
    rate = 4 * len(y) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = ahead = np.zeros(a.shape[1])
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    t = 1.0
    for _ in range(steps):
        v = ahead - rate * (a.T @ (1 / (1 + np.exp(-a @ ahead)) - y)) / len(y)
        v[:-1] = np.sign(v[:-1]) * np.maximum(np.abs(v[:-1]) - rate * penalty, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = v, v + (before - 1) / t * (v - w)
    return w[:-1], float(w[-1])


class Ensemble:
    """Weighted rules: the score's log odds are the intercept and the weights of the rules that hold."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float) -> None:
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def column(self) -> Column:
        """The score as one Spark expression over the columns STATISTICS."""
        odds = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            met = F.lit(True)
            for k, above, bound in rule:
                met = met & ((F.col(STATISTICS[k]) > bound) if above else (F.col(STATISTICS[k]) <= bound))
            odds = odds + F.when(met, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(labelled: DataFrame, label_col: str, most_rows: int = 20_000, trees: int = 40, penalty: float = 5e-4, seed: int = 5, id_col: str = "doc_id") -> Ensemble:
    """Fit on the statistics of labelled rows, about most_rows of them, drawn by a hash of id and statistics, so that copies of one text are drawn one by one.

    A leaf holds at least 20 rows, or a quarter of the rarer label's rows where that is less (2 at least).
    Without rows every score is 0.5; with one label only, the intercept decides.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(id_col, *STATISTICS, F.col(label_col).cast("double").alias("y"))
    share = min(1.0, most_rows / max(rows.count(), 1))
    drawn = rows.where(F.pmod(F.xxhash64(id_col, *STATISTICS), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1)).orderBy("y", *STATISTICS).toPandas()
    x, y = drawn[STATISTICS].to_numpy(float), drawn["y"].to_numpy(float)
    least = int(max(2, min(20, min(y.sum(), len(y) - y.sum()) // 4)))
    rng, rules = np.random.default_rng(seed), {}
    for _ in range(trees if len(y) else 0):
        half = rng.random(len(y)) < 0.5
        rules |= dict.fromkeys(tree_rules(x[half], y[half], rng, least=least))
    if not rules:
        return Ensemble([], [], math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    kept: dict[bytes, Rule] = {}
    for rule in sorted(rules, key=len):
        kept.setdefault(holds(rule, x).tobytes(), rule)
    chosen = list(kept.values())
    weights, intercept = lasso_logistic(np.column_stack([holds(r, x) for r in chosen]).astype(float), y, penalty)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return Ensemble([chosen[i] for i in used], weights[used].tolist(), intercept)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; labels of rows whose fold is 2 are never read into the fit."""
    stats = stored(text_statistics(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold("doc_id", 4) != 2)
    score = fit(labels.join(stats, "doc_id"), "quality").column()
    return stats.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
