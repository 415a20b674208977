"""Each stage of the pipeline, and all of them, against plain versions on odd inputs."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from compare import DATA, oracle
from odd_rows import SCHEMA, document
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm.decontamination import least_edits, normal

LOWER = {k: k + 32 for k in range(65, 91)}


@pytest.fixture(scope="module")
def planted(spark, odd_docs):
    """odd_docs with benchmark passages, whole and edited, a near copy and a shared passage."""
    items = [t for (t,) in oracle("SELECT text FROM benchmark ORDER BY item_id LIMIT 3")[1]]
    own = [f"own{k} words{k}" for k in range(200)]
    near = " ".join(own[:100])
    passage = " ".join(f"shared{k}" for k in range(55))
    rows = [
        document(40, f"before it {items[0]} behind it"), document(41, f"x {items[1][:20]}zz{items[1][21:]} y"), document(42, near), document(43, near + " one more"),
        document(44, f"{' '.join(own[100:130])} {passage} tail"), document(45, f"{' '.join(own[130:160])} {passage}\n end"), document(46, passage),
    ]
    return odd_docs.union(spark.createDataFrame(rows, SCHEMA))


def plain_language(rows):
    return [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]


def plain_near(rows):
    sets, root = {}, {}
    for r in rows:
        words = (r["text"] or "").translate(LOWER).encode().split()
        if r["doc_id"] is not None:
            sets[r["doc_id"]] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
            root[r["doc_id"]] = r["doc_id"]
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if x == high else x for d, x in root.items()}
    return [r for r in rows if r["doc_id"] is None or root[r["doc_id"]] == r["doc_id"]]


def plain_cut(rows):
    first = {}
    words = [(r["text"] or "").encode().split() for r in rows]
    for r, w in zip(rows, words, strict=True):
        for k in range(len(w) - 49):
            if r["doc_id"] is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - 49):
            if r["doc_id"] is not None and first[tuple(w[k : k + 50])] < r["doc_id"]:
                gone.update(range(k, k + 50))
        if gone and len(gone) == len(w):
            continue
        text = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else r["text"]
        out.append({**r, "text": text, "n_chars": len(text) if gone else r["n_chars"]})
    return out


def plain_leaks(rows):
    def words(text):
        raw = (text or "").encode()
        data, first, _ = normal(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return data[: max(0, first[-1] - 1)]

    items = [words(t) for (t,) in oracle("SELECT text FROM benchmark")[1]]
    return [r for r in rows if r["doc_id"] is None or not any(least_edits(i, words(r["text"]), int(0.2 * len(i)))[0] <= int(0.2 * len(i)) for i in items if len(i))]


def plain_packing(rows):
    from tokenizers import Tokenizer

    from tidemill.llm.packing import default_tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    out = []
    for r in rows:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        out += [{"doc_id": r["doc_id"], "start": k, "length": len(ids[k : k + 2048]), "ids_crc32": zlib.crc32(ids[k : k + 2048].tobytes()), "doc_tokens": len(ids)} for k in range(0, len(ids), 2048)]
    return out


PLAIN = [plain_language, plain_near, plain_cut, plain_leaks, plain_packing]


def as_rows(df):
    return [r.asDict() for r in df.collect()]


def same(got, want):
    keys = list(want[0])
    assert sorted(repr([r[k] for k in keys]) for r in got) == sorted(repr([r[k] for k in keys]) for r in want)


@pytest.mark.parametrize("nth", range(5))
def test_stage_against_plain_on_odd_inputs(spark, planted, no_docs, nth):
    stage = corpus_pipeline.STAGES[nth][1]
    before = as_rows(planted)
    got = stage(spark, planted, DATA)
    assert nth == 4 or got.schema.names == planted.schema.names
    same(as_rows(got), PLAIN[nth](before))
    assert not stage(spark, no_docs, DATA).collect()


def test_all_stages_against_plain(spark, planted, tmp_path):
    planted.withColumn("extra", F.lit("e")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = as_rows(planted)
    for plain in PLAIN:
        want = plain(want)
    got = corpus_pipeline.run(spark, str(tmp_path))
    same(as_rows(got), want)
    assert {40, 41, 43, 46}.isdisjoint(r["doc_id"] for r in want) and {42, 44, 45} <= {r["doc_id"] for r in want}
