from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, error long, code string"


def plain(rows, parts, entries, rounds, scale):
    """Codes and errors by trying every entry, and the books: rows of id and floats."""
    rows = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((away(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        taken = [[[] for _ in books[p]] for p in range(parts)]
        for _, v in rows:
            for p in range(parts):
                taken[p][nearest(v, p)[1]].append(cut(v, p))
        books = [[[sum(x) // len(own) for x in zip(*own, strict=True)] if own else books[p][k] for k, own in enumerate(taken[p])] for p in range(parts)]
    found = [[nearest(v, p) for p in range(parts)] for _, v in rows]
    return [(i, tuple(k for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(rows, found, strict=True)], books


def test_codes_against_trying_every_entry(spark):
    """Ties on a coarse grid, repeated rows and ids, null ids, and rows that are left out."""
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in rng.integers(-3, 4, 8) / 4]) for k in rng.permutation(120)] + [(3, [0.25] * 8), (3, [0.25] * 8), (None, [0.5] * 8), (None, [0.5] * 8)]
    out = [(200, None), (201, [1.0] * 7 + [None]), (202, [float("nan")] + [0.0] * 7), (203, [float("inf")] + [0.0] * 7)]
    table = spark.createDataFrame([(i, v, k % 3 or None, 1, "x") for k, (i, v) in enumerate(rows + out)], SCHEMA).repartition(5)
    for parts, entries, rounds, scale in ((4, 16, 3, 4), (2, 5, 6, 4096), (8, 300, 1, 1), (1, 1, 2, 7)):
        got = vector_codes.compress_vectors(table, parts, entries, rounds, scale, keep=("vec_id",))
        want, books = plain(rows, parts, entries, rounds, scale)
        assert got.books.tolist() == books
        assert sorted(map(repr, ((r["vec_id"], tuple(r["code"]), r["error"]) for r in got.rows.collect()))) == sorted(map(repr, want))


def test_search_finds_the_first_of_the_nearest():
    rng = np.random.default_rng(6)
    for n, width, reach in ((1, 2, 3), (2, 1, 1), (40, 3, 4), (200, 8, 60), (64, 2, 1 << 26)):
        entries, rows = rng.integers(-reach, reach + 1, (n, width)), rng.integers(-reach, reach + 1, (500, width))
        place, best = vector_codes.Search(entries).nearest(rows)
        every = ((rows[:, None] - entries[None]) ** 2).sum(2)
        assert (best == every.min(1)).all() and (place == every.argmin(1)).all()


def test_most_sides_are_left_out():
    """Rows near entries far apart: the search holds a row against few of them."""
    rng = np.random.default_rng(7)
    entries = rng.integers(-(10**6), 10**6, (256, 3))
    rows = entries[rng.integers(0, 256, 400)] + rng.integers(-50, 50, (400, 3))
    seen = 0
    real = vector_codes._squares

    def counted(some, entry):
        nonlocal seen
        seen += len(some)
        return real(some, entry)

    search = vector_codes.Search(entries)
    vector_codes._squares = counted
    try:
        search.nearest(rows)
    finally:
        vector_codes._squares = real
    assert seen < 400 * 256 / 4


def test_roots_are_rounded_outwards():
    squares = np.array([0, 1, 2, 3, 4, 8, 9, 10, (1 << 61) - 1, 1 << 60, (1 << 60) - 1, (1 << 60) + 1])
    down, up = vector_codes._roots(squares)
    assert down.tolist() == [math.isqrt(s) for s in squares.tolist()] and up.tolist() == [math.isqrt(s - 1) + 1 if s else 0 for s in squares.tolist()]


def test_odd_tables(spark):
    none = vector_codes.compress_vectors(spark.createDataFrame([], SCHEMA))
    assert not none.rows.collect() and none.books.size == 0
    out = vector_codes.compress_vectors(spark.createDataFrame([(1, None, 1, 1, "x"), (2, [None] * 8, 1, 1, "x")], SCHEMA))
    assert not out.rows.collect()
    for bad in ([[0.0] * 8, [0.0] * 16], [[0.0] * 9], [[1e30] * 8], [[0.0] * 8, [2.0**18] * 8]):
        with pytest.raises(ValueError):
            vector_codes.compress_vectors(spark.createDataFrame([(k, v, 1, 1, "x") for k, v in enumerate(bad)], SCHEMA))
    empty = vector_codes.compress_vectors(spark.createDataFrame([(1, [], 1, 1, "x"), (2, [], 1, 1, "x")], SCHEMA))
    assert [(r["code"], r["error"]) for r in empty.rows.collect()] == [([0] * 8, 0)] * 2


def test_query_sums_errors_by_label(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=16)], None if k % 3 == 0 else k % 2, 0, "x") for k in range(90)]
    spark.createDataFrame(rows, SCHEMA).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vector_codes.op11_vector_codes(spark, str(tmp_path))
    want, books = plain([(r[0], r[1]) for r in rows], 8, 16, 6, 4096)
    by = {i: (code, error) for i, code, error in want}
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    for r in got.collect():
        same = [by[o[0]][1] for o in rows if o[2] == rows[r["vec_id"]][2]]
        assert (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) == ("".join(f"{c:02x}" for c in by[r["vec_id"]][0]), by[r["vec_id"]][1], sum(same), digest)
    assert got.where(F.col("code").isNull()).isEmpty()
