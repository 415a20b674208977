"""Queries against SQL, or against a plain version, on whole small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import DATA, assert_same, oracle

from tidemill.llm.queries import ORACLE_SQL, QUERIES

LOWER = {k: k + 32 for k in range(65, 91)}


@pytest.fixture(scope="module")
def texts():
    return dict(oracle("SELECT doc_id, text FROM documents")[1])


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])


def test_licenses_base_against_plain_search(spark, texts):
    from tidemill.llm.licenses import PHRASES

    for r in QUERIES["op2_licenses"](spark, DATA).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(LOWER))
        at = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        want = (len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
        spans = [x.split(":") for x in r["found"].split(",") if x]
        assert all(label in r["labels"].split(",") and 0 <= int(a) < int(b) <= len(texts[r["doc_id"]].encode()) and int(n) >= 0 for label, a, b, n in spans)


def test_packing_keeps_every_id_once(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = QUERIES["op3_packing"](spark, DATA).toPandas()
    assert set(rows["doc_id"]) == set(texts)
    for doc, pieces in rows.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"].to_numpy() == np.append(0, np.cumsum(own["length"])[:-1])).all() and own["length"].sum() <= 2048
    assert rows["length"].sum() / (2048 * rows["sequence_id"].nunique()) > 0.97


def test_token_counts_against_greedy_cutting(spark, texts):
    from tidemill.llm.token_counts import default_vocabulary, read_vocabulary

    pieces = set(read_vocabulary(default_vocabulary()))
    longest = max(map(len, pieces))

    def greedy(word: bytes) -> int:
        n = at = 0
        while at < len(word):
            size = next(s for s in range(min(longest, len(word) - at), 0, -1) if word[at : at + s] in pieces)
            n, at = n + 1, at + size
        return n

    known: dict[bytes, int] = {}
    for r in QUERIES["op6_token_counts"](spark, DATA).collect():
        words = texts[r["doc_id"]].encode().split()
        for w in set(words) - known.keys():
            known[w] = greedy(b" " + w)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))


def test_language_of_held_out_documents(spark):
    langs = dict(oracle("SELECT doc_id, lang FROM documents")[1])
    rows = [r for r in QUERIES["op8_language_id"](spark, DATA).collect()]
    assert {r["doc_id"] for r in rows if r["held_out"]} == {d for d in langs if zlib.crc32(str(d).encode()) % 3 == 1}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.95


def test_quality_of_held_out_documents(spark):
    labels = dict(oracle("SELECT doc_id, quality FROM labels")[1])
    rows = QUERIES["op10_quality"](spark, DATA).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_leaks_against_plain_search(spark, texts):
    items = dict(oracle("SELECT item_id, text FROM benchmark")[1])
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in QUERIES["op9_decontamination"](spark, DATA).collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} == {k for k, e in found.items() if e == 0}


def test_pipeline_stages_keep_what_they_should(spark):
    import corpus_pipeline
    from tidemill.llm._spark import stored, table

    docs = table(spark, DATA, "documents")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, DATA))
        assert after.schema.names == docs.schema.names
        assert not after.select("doc_id").subtract(docs.select("doc_id")).count()
        docs = after
        sizes.append(docs.count())
    left = docs.toPandas()
    five = {r.doc_id: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in left.itertuples() if (w := r.text.translate(LOWER).split())}
    shared = Counter()
    by = {}
    for d, s in five.items():
        for x in s:
            by.setdefault(x, []).append(d)
    for own in by.values():
        shared.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :] if len(own) < 50)
    assert not [p for p, n in shared.items() if n >= 0.8 * (len(five[p[0]]) + len(five[p[1]]) - n)]
    assert not [t for t in left["text"] for (x,) in oracle("SELECT text FROM benchmark")[1] if x in t]
    packed = stored(corpus_pipeline.STAGES[-1][1](spark, docs, DATA))
    assert packed.select("doc_id").distinct().count() == sizes[-1]
