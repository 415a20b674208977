"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import decontamination, embedding_dedup, language_id, licenses, near_dedup, packing, quality, sharding, substring_dedup, token_counts


def rows(df):
    return df.collect()


def test_sharding(spark, odd_docs, no_docs):
    got = rows(sharding.shard_by_bytes(odd_docs, shards=3))
    assert len(got) == odd_docs.count()
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 and r["source"] == "s" for r in got)
    assert not rows(sharding.shard_by_bytes(no_docs))


def test_sharding_parts_a_hot_group(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"))
    sizes = [r["b"] for r in rows(sharding.shard_by_bytes(docs, range_bytes=512).groupBy("shard").agg(F.sum("size").alias("b")))]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 20


def test_sharding_cuts_one_text_into_thousands_of_ranges(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one hot text").alias("text"))
    got = sharding.shard_by_bytes(docs, range_bytes=64).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert len(got) == 16 and all(r["n"] == 1250 == r["last"] + 1 == r["slots"] for r in got)


def test_licenses(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in rows(licenses.scan_licenses(odd_docs))}
    assert (got[20]["n_words"], got[20]["labels"], got[20]["score"], got[20]["first_word"]) == (0, "", 0.0, None)
    assert got[29]["n_words"] == 6 and not rows(licenses.scan_licenses(no_docs))
    texts = ["Relased under teh MIT License!", "ALL-RIGHTS  reserved", "all right reserved", "small rights", "cc by cc by"]
    found = {r["doc_id"]: r for r in rows(licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert [found[k]["labels"] for k in range(5)] == ["mit", "reserved", "reserved", "", "cc-by"]
    assert (found[0]["found"][0]["edits"], found[0]["found"][0]["start_byte"], found[0]["found"][0]["end_byte"]) == (3, 0, 29)
    assert (found[4]["n_base"], found[4]["first_word"], found[4]["last_word"]) == (2, 0, 2) and found[2]["base_labels"] == "" and 0 < found[2]["score"] < 1


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_licenses_against_brute_force(spark):
    """Labels, score and spans from all runs of whole words, each held against each notice."""
    rng = np.random.default_rng(12)
    notices = {"gnu general public license": "gpl", "released under the mit license": "mit", "all rights reserved": "reserved"}
    texts = ["gnu general public licenseabcdef", "released under the mit licensexyzabc", "xgnu general public license", "gnu general public license 1", "gnugeneral public license mit license"]
    for _ in range(120):
        notice = str(rng.choice(list(notices)))
        texts.append(f"{rng.choice(['', 'so ', 'wordsbefore ', 'x'])}{_edited(rng, notice, int(rng.integers(0, 6)))}{rng.choice(['', ' end', 'stuck', ' all rights here', '  gnu'])}")
    got = rows(licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), notices=notices, phrases={}))
    for r in got:
        words = texts[r["doc_id"]].split()
        best, found = {}, {}
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                part = " ".join(words[a:b])
                for notice, label in notices.items():
                    if abs(len(part) - len(notice)) <= 4:
                        edits = _edits(part, notice)
                        found[part, label] = edits
                        if edits <= max(1, int(len(notice) * 0.12)):
                            best[label] = min(best.get(label, 9), edits)
        assert r["labels"] == ",".join(sorted(best)), texts[r["doc_id"]]
        assert r["score"] == pytest.approx(max((1 - e / len(n) for n, label in notices.items() for e in [best.get(label, len(n))]), default=0))
        for f in r["found"]:
            part = " ".join(texts[r["doc_id"]].encode()[f["start_byte"] : f["end_byte"]].decode().split())
            assert found[part, f["label"]] == f["edits"]


def test_packing(spark, odd_docs, no_docs):
    got = packing.pack_documents(odd_docs, keep_ids=True).toPandas()
    assert not rows(packing.pack_documents(no_docs))
    assert got[got["doc_id"] == 20]["length"].tolist() == [1] == [len(x) for x in got[got["doc_id"] == 21]["ids"]]
    assert (got["length"] == got["ids"].map(len)).all() and len(got[got["doc_id"] == 3]) == 3
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_packing_gives_the_tokenizers_ids_for_every_character(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    book = packing.WordIds(packing.default_tokenizer())
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xE0000, 0xE0200)]
    texts = [f"{'' if k % 3 else 'A'}{''.join(points[k : k + 7])}b {points[k]} x{points[k]}{points[k]}'s {points[k].upper()}1" for k in range(0, len(points), 7)]
    texts += [f"a{c}b {c} {c}{c}é {c}S" for c in points[:0x3100]]
    texts += ["\u3000\n日本、\nabc", "abc 日本、 text", "x<|endoftext|>y <|STARTOFTEXT|> <|startoftext|>", "I'M you'll 'S ''s", "\u2003 \u2029", ""]
    for order in (texts, texts[::-1]):
        raw = [t.encode() for t in order]
        for low in range(0, len(raw), 4000):
            some = raw[low : low + 4000]
            flat, edge = book.ids(np.frombuffer(b"".join(some), np.uint8), np.append(0, np.cumsum([len(r) for r in some])))
            for e, (a, b) in zip(tokenizer.encode_batch(order[low : low + 4000], add_special_tokens=False), zip(edge, edge[1:], strict=False), strict=True):
                assert flat[a:b].tolist() == e.ids


def test_packing_deals_rows_of_one_id(spark):
    docs = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit(1).alias("row"))
    got = packing.pack_documents(docs, group_pieces=100).toPandas()
    assert len(got) == 600 and (got.groupby(got["sequence_id"] // 2**32).size() < 200).all() and got["sequence_id"].nunique() >= 6


def test_first_fit_decreasing_against_plain():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 77):
        sizes = rng.integers(1, 100, n)
        room, want = [], np.zeros(n, int)
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [100] * (k == len(room))
            room[k] -= sizes[i]
            want[i] = k
        assert (packing.first_fit_decreasing(sizes, 100)[0] == want).all()


def test_substring_dedup(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in rows(substring_dedup.remove_repeats(odd_docs))}
    assert (got[0]["n_removed"], got[27]["n_removed"], got[27]["kept_text"]) == (0, 120, "")
    assert (got[28]["n_removed"], got[28]["kept_text"]) == (120, "tail of it")
    assert (got[3]["n_removed"], got[None]["n_removed"], got[20]["n_words"], got[22]["kept_text"], got[26]["n_words"]) == (0, 0, 0, "", 60_000)
    assert not rows(substring_dedup.remove_repeats(no_docs))


@pytest.mark.parametrize("hot", [1, 256])
def test_substring_dedup_against_plain(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = np.random.default_rng(hot)
    shared = [[f"s{i}_{k}" for k in range(90)] for i in range(4)]
    docs = []
    for d in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 80)]
        for _ in range(2):
            low, size, at = int(rng.integers(0, 60)), int(rng.integers(40, 90)), int(rng.integers(0, len(words)))
            words[at:at] = shared[int(rng.integers(0, 4))][low : low + size]
        docs.append((d, words))
    first = {}
    for d, w in docs:
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d)
    want = {d: " ".join(x for p, x in enumerate(w) if not any(first[tuple(w[k : k + 50])] < d for k in range(max(0, p - 49), min(p, len(w) - 50) + 1))) for d, w in docs}
    got = substring_dedup.remove_repeats(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"))
    assert {r["doc_id"]: r["kept_text"] for r in rows(got)} == want


def test_least_of_runs_against_plain():
    from tidemill.llm.fm_index import Least

    rng = np.random.default_rng(0)
    for n in (1, 5, 16, 17, 33, 100, 5000):
        values = rng.integers(0, 10000, n)
        low = rng.integers(0, n, 300)
        high = np.array([rng.integers(k + 1, n + 1) for k in low])
        assert (Least(values.astype(np.int32)).over(low, high) == [values[a:b].min() for a, b in zip(low, high, strict=True)]).all()


def test_matching_statistics_against_plain():
    from tidemill.llm.fm_index import FMIndex

    def longest(pattern, owner, texts, owners):
        best = 0
        for text in (t for t, o in zip(texts, owners, strict=True) if o < owner):
            for at in range(len(text)):
                n = 0
                while n < min(len(pattern), len(text) - at) and pattern[n] == text[at + n]:
                    n += 1
                best = max(best, n)
        return best

    rng = np.random.default_rng(1)
    for _ in range(100):
        size = int(rng.integers(1, 5))
        texts = [rng.integers(1, size + 1, rng.integers(1, 30)) for _ in range(rng.integers(1, 6))]
        owners = rng.integers(0, 6, len(texts))
        index = FMIndex(np.concatenate([np.append(t, 0) for t in texts]), np.repeat(owners, [len(t) + 1 for t in texts]), size)
        patterns = [np.where(rng.random(n) < 0.05, -1, rng.integers(1, size + 1, n)) for n in rng.integers(0, 30, 4)]
        asking, edge = rng.integers(0, 7, 4), np.cumsum([0] + [len(p) for p in patterns])
        got = index.matching(np.concatenate(patterns), edge[:-1], edge[1:], asking)
        assert got.tolist() == [longest(p[k:], o, texts, owners) for p, o in zip(patterns, asking, strict=True) for k in range(len(p))]


def test_near_dedup(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in rows(near_dedup.near_duplicates(odd_docs))}
    assert len(rows(near_dedup.near_duplicates(odd_docs))) == odd_docs.count() and not rows(near_dedup.near_duplicates(no_docs))
    assert got[27]["component_id"] == got[28]["component_id"] == 0 and not got[27]["kept"] and got[0]["kept"]
    assert (got[20]["n_shingles"], got[20]["component_id"], got[21]["kept"], got[24]["n_shingles"]) == (0, 20, True, 1)


def test_near_dedup_around_a_hub(spark):
    """Copies with own edits, alike to the original but often not to each other."""
    rng = np.random.default_rng(9)
    base = [f"b{k}" for k in range(150)]
    texts = {0: base}
    for d in range(1, 120):
        words = list(base)
        for k in rng.choice(150, int(rng.integers(1, 12)), replace=False):
            words[k] = f"e{d}_{k}"
        texts[d] = words
    sets = {d: set(zip(w, w[1:], strict=False)) for d, w in texts.items()}
    root = {d: d for d in texts}
    for a in sorted(texts):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    got = near_dedup.near_duplicates(spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string"), words_each=2)
    assert {r["doc_id"]: r["component_id"] for r in rows(got)} == root


def test_near_dedup_among_documents_of_one_template(spark):
    """Half of each text is the template's; a few pairs are similar, and none but these are linked."""
    rng = np.random.default_rng(4)
    template = [f"t{k}" for k in range(60)]
    texts = [[*template, *(f"o{d}_{k}" for k in range(60))] for d in range(900)]
    for d in range(0, 900, 30):
        copy = list(texts[d])
        for k in rng.choice(120, 6, replace=False):
            copy[k] = f"e{d}_{k}"
        texts.append(copy)
    got = {r["doc_id"]: r["component_id"] for r in rows(near_dedup.near_duplicates(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string"), words_each=2))}
    sets = [set(zip(w, w[1:], strict=False)) for w in texts]
    want = {d: d for d in range(900)}
    for k, d in enumerate(range(0, 900, 30)):
        both = len(sets[d] & sets[900 + k])
        want[900 + k] = d if 100 * both >= 80 * (len(sets[d]) + len(sets[900 + k]) - both) else 900 + k
    assert got == want and sum(want[900 + k] < 900 for k in range(30)) > 20


def test_rarest_shingles_lose_no_similar_pair(spark):
    rng = np.random.default_rng(21)
    sets = []
    for d in range(400):
        base = np.random.default_rng(d % 40).integers(0, 900, 60)
        keep = rng.random(60) < rng.uniform(0.75, 1)
        sets.append(sorted({*base[keep].tolist(), *rng.integers(0, 900, int(rng.integers(0, 12))).tolist()}))
    table = spark.createDataFrame([(d, d, s) for d, s in enumerate(sets)], "id long, component long, shingles array<long>")
    want = {(a, b) for b in range(400) for a in range(b) if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    for few in (32, 1):
        near_dedup.FEW = few
        got = {tuple(sorted(r)) for r in rows(near_dedup._remainder(table, table.select("id", "shingles"), 0.8))}
        near_dedup.FEW = 32
        assert len(want) > 100 and (got == want if few > 1 else got <= want)
        root = list(range(400))
        for a, b in sorted(got):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        assert all(root[a] == root[b] for a, b in want)


def test_token_counts(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in rows(token_counts.count_tokens(odd_docs, keep=50))}
    assert (got[20]["n_tokens"], got[21]["n_words"], got[25]["n_bytes"], got[25]["n_words"]) == (0, 0, 200_000, 1)
    assert not rows(token_counts.count_tokens(no_docs))
    automaton = token_counts.LongestMatch([b"a", b"ab", b"abcd", b"bcx", b"c"])
    assert [automaton.count(w) for w in (b"", b"abcd", b"abcx", b"abcy", b"zz")] == [0, 1, 3, 3, 2]


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    near = base[:40] + 0.28 * rng.normal(size=(40, 16))
    vectors = [*base.tolist(), *near.tolist(), *base[:3].tolist(), *(base[5:6] * 4).tolist(), None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(k, v, "x") for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, n string")
    unit = np.array([v if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v) else [0.0] * 16 for v in vectors])
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    linked = (unit @ unit.T >= 0.9) & ~np.eye(len(unit), dtype=bool)
    linked[-1, -2] = linked[-2, -1] = True
    got = {r["vec_id"]: r for r in rows(embedding_dedup.near_duplicate_vectors(df))}
    assert [got[k]["n_links"] for k in range(len(vectors))] == linked.sum(1).tolist()
    assert all(got[k]["component_id"] == got[j]["component_id"] for k, j in zip(*np.nonzero(linked), strict=True))
    assert not rows(embedding_dedup.near_duplicate_vectors(df.limit(0)))


def test_language(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(k, "the cat and the dog" if k % 2 else "der hund und die katze", "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in rows(language_id.predict(odd_docs, model))}
    assert [got[k]["lang_pred"] for k in (20, 21, 22, 23)] == ["und"] * 4 and got[20]["score"] == 0 and 0 < got[25]["score"] <= 1
    assert {r["lang_pred"] for r in rows(language_id.predict(docs, model)) if r["doc_id"] % 2} == {"en"}
    assert not rows(language_id.predict(no_docs, language_id.fit(no_docs)))
    assert {r["lang_pred"] for r in rows(language_id.predict(docs, language_id.fit(no_docs)))} == {"und"}


def test_pipeline_keeps_letters_where_no_language_is_known(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "words", None), (2, None, None), (3, "12 !", None), (4, "", None), (5, "текст", None), (None, "more", None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_languages(spark, docs, "")
    assert got.columns == docs.columns and {r["doc_id"] for r in rows(got)} == {1, 5, None} and got.count() == 3


def _segmentations(word: bytes, pieces: set[bytes]):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in _segmentations(word[n:], pieces):
                yield (word[:n], *rest)


def test_language_model_against_all_segmentations(spark, tmp_path):
    """Fitting and scores by listing every segmentation of every word."""
    import base64
    from collections import Counter
    from math import log, prod

    own = {b" a", b"ab", b"ba", b" ab", b"abab", b"b b", b" caba", "é".encode()}
    path = tmp_path / "pieces.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % k for k, p in enumerate(sorted(own))))
    texts = {"x": ["abab ab a", "caba abb ab", "AB ab ba"], "y": ["é éa bab", "cc c é"]}
    docs = spark.createDataFrame([(k, t, lang) for lang, ts in texts.items() for k, t in enumerate(ts)], "doc_id long, text string, lang string")
    pieces = own | {bytes([b]) for b in range(256)}
    chance = {lang: dict.fromkeys(pieces, 1 / len(pieces)) for lang in texts}
    for _ in range(3):
        for lang, ts in texts.items():
            counts = Counter(dict.fromkeys(pieces, 0.01))
            for word in (b" " + w for t in ts for w in t.lower().encode().split()):
                every = [(s, prod(chance[lang][p] for p in s)) for s in _segmentations(word, pieces)]
                total = sum(c for _, c in every)
                for s, c in every:
                    counts.update({p: n * c / total for p, n in Counter(s).items()})
            chance[lang] = {p: n / sum(counts.values()) for p, n in counts.items()}
    model = language_id.fit(docs, vocabulary=str(path))
    assert model.languages == ["x", "y"]
    for k, lang in enumerate(model.languages):
        assert np.allclose(model.chance[:, k], [chance[lang][p] for p in sorted(pieces)])
    unseen = "abc é caba"
    likely = [sum(log(sum(prod(chance[lang][p] for p in s) for s in _segmentations(b" " + w, pieces))) for w in unseen.encode().split()) for lang in texts]
    got = rows(language_id.predict(spark.createDataFrame([(1, unseen)], "doc_id long, text string"), model))[0]
    assert got["lang_pred"] == ("x", "y")[likely[0] < likely[1]] and np.isclose(got["score"], 1 / (1 + np.exp(-abs(likely[0] - likely[1]))))


def test_language_sums_long_words_whole():
    pieces = language_id.Pieces(language_id.default_vocabulary())
    chance = np.random.default_rng(0).random((pieces.size, 2)) / pieces.size
    words = [" theories".encode(), " supercalifragilisticexpialidocious日本語の文書".encode() * 9, b" a", b" internationalization" * 40]
    lattice = language_id.Lattice(pieces, np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words])))
    got, expected = lattice.logs(chance), lattice.expected(chance, np.ones((4, 2)))
    for k, word in enumerate(words):
        own = language_id.Lattice(pieces, np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        total = [[0.0, 0.0]]
        for end in range(1, len(word) + 1):
            edges = np.flatnonzero(own.end == end)
            total.append([np.logaddexp.reduce([total[own.begin[e]][j] + np.log(chance[own.piece[e], j]) for e in edges]) for j in range(2)])
        assert np.allclose(got[k], total[-1])
    lengths = np.zeros(pieces.size)
    lengths[lattice.piece] = lattice.end - lattice.begin
    assert np.allclose(expected.T @ lengths, sum(map(len, words)))


def test_language_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word"), F.col("id"), F.lit(" text")).alias("text"), F.lit("en").alias("lang"))
    languages, words = language_id._drawn_words(docs.select(F.col("doc_id").alias("id"), "text", "lang"), 300, 1 << 20)
    assert languages == ["en"] and 200 < words.count() < 400
    assert language_id._drawn_words(docs.select(F.col("doc_id").alias("id"), "text", "lang"), 3000, 500)[1].agg(F.sum(F.octet_length("word"))).first()[0] <= 500


@pytest.mark.parametrize(("block", "cell"), [(1024, 48), (16, 48), (16, 4)])
def test_vectors_with_null_and_repeated_ids(spark, monkeypatch, block, cell):
    """Links are those of rows: null ids, one id with two vectors, equal vectors of several ids, and cells of many blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    rng = np.random.default_rng(41)
    centres = rng.normal(size=(9, 10))
    made = [(int(k) if k % 7 else None, [float(x) for x in centres[k % 9] + rng.normal(size=10) * 0.25 * (k % 4)]) for k in range(240)]
    made += [(1, [1.0] + [0.0] * 9), (1, [1.0, 0.1] + [0.0] * 8), (1, [0.0, 0.0, -1.0] + [0.0] * 7), (500, made[0][1]), (None, made[1][1]), (None, None), (2, None), (None, [0.0] * 10)]
    ids, unit = [i for i, _ in made], np.array([np.array(v) / max(np.linalg.norm(v), 1e-9) if v else np.zeros(10) for _, v in made])
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    group = np.arange(len(ids))
    for _ in ids:
        group = np.minimum(group, np.where(near, group[None], len(ids)).min(1))
    least = {g: min((i for i, h in zip(ids, group, strict=True) if h == g and i is not None), default=None) for g in set(group.tolist())}
    want = [(i, int(near[k].sum()), least[int(group[k])], i is not None and i == least[int(group[k])]) for k, i in enumerate(ids)]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_many_languages(spark):
    """More languages than are summed at once, and more than some words are held for; one at a time gives the same."""
    rng = np.random.default_rng(31)
    texts = [(k, " ".join("".join(rng.choice(list("abcdefghijklmnop"[k % 12 : k % 12 + 5]), 4)) for _ in range(30)), f"l{k % 40:02}") for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    alone = language_id.fit(docs.where("lang IN ('l03', 'l17')"))
    assert len(model.languages) == 40 and np.allclose(model.chance[:, [3, 17]], alone.chance) and np.allclose(model.chance.sum(0), 1)
    got = rows(language_id.predict(docs, model))
    assert sum(r["lang_pred"] == texts[r["doc_id"]][2] for r in got) > 110
    with pytest.raises(ValueError):
        language_id.predict(docs.withColumn("score", F.lit(1)), model, keep=("score",))


def test_leaks(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, "short item"), (4, "short item"), (None, "x y z")], "item_id long, text string")
    docs = [(1, "so ONE, two; three four five sex seven eight nine ten eleven twelve end"), (2, "one two"), (3, None), (4, "a short-item here"), (4, "a short-item here"), (None, "short item")]
    got = rows(decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items))
    assert sorted(((r["doc_id"], r["item_id"], r["edits"], r["first_word"], r["end_word"]) for r in got), key=repr) == sorted([(1, 1, 1, 1, 13), (4, 4, 0, 1, 3), (4, 4, 0, 1, 3), (None, 4, 0, 0, 2)], key=repr)
    assert not rows(decontamination.find_leaks(odd_docs, items.limit(0))) and not rows(decontamination.find_leaks(no_docs, items))
    assert decontamination.remove_leaks(odd_docs, items).count() == odd_docs.count()


def test_leaks_with_edits_reach_their_recall(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [[vocabulary[k] for k in rng.integers(0, 3000, int(n))] for n in rng.integers(14, 60, 40)]
    docs = []
    for d in range(200):
        words = [w for w in items[d % 40] if rng.random() > 0.06]
        docs.append((d, " ".join([*(vocabulary[k] for k in rng.integers(0, 3000, 50)), *words, "end"])))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench))}
    want = set()
    for d, text in docs:
        item = np.frombuffer(" ".join(items[d % 40]).encode(), np.uint8)
        most = int(0.2 * len(item))
        if decontamination.least_edits(item, np.frombuffer(text.encode(), np.uint8), most)[0] <= most:
            want.add((d, d % 40))
    assert len(got & want) >= 0.97 * len(want) and got <= want


def _edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at, kind = int(rng.integers(0, len(text))), rng.integers(0, 3)
        new = chr(97 + int(rng.integers(0, 26)))
        text[at : at + (kind < 2)] = [new] if kind else []
    return "".join(text)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_leaks_with_edited_characters_against_brute_force(spark, share):
    rng = np.random.default_rng(int(share * 100))
    vocabulary = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 8)))) for _ in range(2000)]
    some = lambda n: " ".join(vocabulary[k] for k in rng.integers(0, 2000, int(n)))
    items = [some(n) for n in rng.integers(14, 40, 30)]
    docs = [f"{some(9)} {_edited(rng, items[d % 30], int(share * len(items[d % 30])))} {some(9)}" for d in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in rows(decontamination.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench))}
    want = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            plain = np.frombuffer(" ".join(text.split()).encode(), np.uint8)
            edits = decontamination.least_edits(np.frombuffer(item.encode(), np.uint8), plain, int(0.2 * len(item)))[0]
            if edits <= int(0.2 * len(item)):
                want[d, i] = edits
    assert len(want) >= 50 and got == want


@pytest.mark.parametrize("spread", ["even", "spaces", "deleted"])
def test_leaks_by_pieces_miss_nothing_however_edits_are_spread(spark, spread):
    """Edits at even distances, lost spaces and lost characters: as many as may be."""
    rng = np.random.default_rng(51)
    prose = lambda n: " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(n))
    items = [prose(int(rng.integers(12, 45))) for _ in range(40)]
    docs = []
    for text in items:
        most, copy = int(0.2 * len(text)), list(text)
        if spread == "even":
            for k in range(2, len(copy), 5)[:most]:
                copy[k] = "z" if copy[k] != "z" else "y"
        elif spread == "spaces":
            copy = list(text.replace(" ", "", most))
        else:
            copy = [c for k, c in enumerate(copy) if k % 5 != 3 or k // 5 >= most]
        docs.append(f"{prose(60)} {''.join(copy)} {prose(60)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = rows(decontamination.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench, all_by_pieces=True))
    assert {(k, k) for k in range(40)} <= {(r["doc_id"], r["item_id"]) for r in got}


@pytest.mark.parametrize("kind", ["short words", "no spaces"])
def test_leaks_finds_exact_copies(spark, kind):
    """Without an item of few words, and of one word inside a longer one."""
    rng = np.random.default_rng(4)
    if kind == "short words":
        items = [" ".join(rng.choice(list("abcxyz0123456789"), int(n))) for n in rng.integers(12, 41, 40)]
        docs = [f"some words before {x} and some behind" for x in items]
    else:
        items = ["".join(rng.choice(list("日本語文書検索学習資料評価問題回答"), 40)) for _ in range(20)]
        docs = [f"前置{x}後続" for x in items]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontamination.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench)) if not r["edits"]}
    assert got == {(k, k) for k in range(len(items))}


def test_leaks_with_items_of_all_lengths(spark):
    """A one-word item is found where it stands, and changes nothing for the others."""
    rng = np.random.default_rng(6)
    words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 8)))) for _ in range(500)]
    long = [" ".join(words[k] for k in rng.integers(0, 500, 40)) for _ in range(5)]
    docs = [(0, "the dog and " * 1000), (1, f"so {_edited(rng, long[1], 20)} end"), (2, long[2].replace(" ", "")), (3, f"to be or not to be it is as it is {long[3]}")]
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    bench = [*enumerate(long), (7, "to be or not to be it is as it is so we go on"), (8, "dog and")]
    got = {}
    for name, items in (("with", [*bench, (9, "the")]), ("without", bench)):
        found = rows(decontamination.find_leaks(texts, spark.createDataFrame(items, "item_id long, text string")))
        got[name] = {(r["doc_id"], r["item_id"]) for r in found}
    assert got["without"] >= {(1, 1), (2, 2), (3, 3), (0, 8)} and got["with"] - got["without"] == {(0, 9)} and got["without"] <= got["with"]


def test_edits_of_stretches_against_plain():
    rng = np.random.default_rng(1)
    for _ in range(100):
        item, text = rng.integers(97, 101, int(rng.integers(1, 65))).astype(np.uint8), rng.integers(97, 101, int(rng.integers(0, 150))).astype(np.uint8)
        masks = np.zeros((1, 256), np.uint64)
        np.bitwise_or.at(masks, (0, item), np.uint64(1) << np.arange(len(item)).astype(np.uint64))
        got = decontamination.least_edits_of_stretches(masks, np.array([0]), np.array([len(item)]), np.append(text, 0).astype(np.uint8), np.array([0]), np.array([len(text)]))
        assert got[0] == decontamination.least_edits(item, text, len(item))[0]


def test_quality(spark, odd_docs, no_docs):
    stats = quality.text_statistics(odd_docs)
    got = {r["doc_id"]: r for r in rows(stats)}
    assert got[20]["n_words"] == 0 and got[20]["distinct_words"] == 1 and got[25]["longest_word"] == 200_000
    labelled = stats.withColumn("quality", (F.col("n_words") > 50).cast("int"))
    score = quality.fit(labelled, "quality").column()
    assert all(0 <= r["s"] <= 1 for r in rows(stats.select(score.alias("s"))))
    assert {r["s"] for r in rows(stats.select(quality.fit(labelled.limit(0), "quality").column().alias("s")))} == {0.5}
    assert not rows(quality.text_statistics(no_docs))


def test_quality_statistics_against_plain(spark, odd_docs):
    """Every statistic of every text, by Python's own splitting and counting."""
    classes = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t", "line_end": b"\r\n", "stop": b".,;:?", "shout": b"!", "mark": b"*$%&#@|<>{}[]=+~^_\\/", "beyond_ascii": bytes(range(128, 256))}
    texts = ["", "One two  TWO two.", "a\nb\n\na\r\nb c!", "\t \n", "é 日本語 é é", "no-break\xa0space x\x0by\x0cz", "* * * ** 12 {x}", "line\n" * 5, None]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    given = [(r["doc_id"], (r["text"] or "").encode()) for r in rows(docs)]
    want = []
    for d, raw in given:
        words, lines = raw.lower().split(), [x for x in raw.replace(b"\r", b"\n").split(b"\n") if x]
        shares = [sum(raw.count(bytes([b])) for b in classes[c]) / max(len(raw), 1) for c in quality.CLASSES]
        n = max(len(words), 1)
        want.append((d, *shares, len(words), sum(map(len, words)) / n, max(map(len, words), default=0), len(words) / max(len(lines), 1), len(set(words)) / n if words else 1, len(set(lines)) / len(lines) if lines else 1, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n))
    got = [tuple(r) for r in rows(quality.text_statistics(docs))]
    key = lambda r: repr(r[0])
    for g, w in zip(sorted(got, key=lambda r: (key(r), r[1:])), sorted(want, key=lambda r: (key(r), r[1:])), strict=True):
        assert g[0] == w[0] and np.allclose(g[1:], w[1:])


def test_quality_column_against_its_rules(spark):
    """The compiled column and the rules' log odds summed in numpy, and the weights against the lasso's own conditions."""
    rng = np.random.default_rng(7)
    x = rng.random((400, len(quality.STATISTICS))).round(2)
    y = ((x[:, 0] > 0.5) & (x[:, 9] <= 0.7) ^ (rng.random(400) < 0.05)).astype(int)
    table = spark.createDataFrame([(k, *map(float, r), int(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))], "doc_id long, " + ", ".join(f"{s} double" for s in quality.STATISTICS) + ", quality int")
    ensemble = quality.fit(table, "quality")
    got = {r["doc_id"]: r["s"] for r in rows(table.select("doc_id", ensemble.column().alias("s")))}
    odds = np.full(400, ensemble.intercept)
    for rule, weight in zip(ensemble.rules, ensemble.weights, strict=True):
        met = [all((r[k] > bound) == above for k, above, bound in rule) for r in x]
        odds += weight * np.array(met)
    score = 1 / (1 + np.exp(-odds))
    assert ensemble.rules and np.allclose([got[k] for k in range(400)], score)
    assert np.mean((score > 0.5) == y) > 0.9
    z, penalty = (rng.random((300, 12)) < 0.4).astype(float), 0.01
    labels = (rng.random(300) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1])))).astype(float)
    weights, intercept = quality.lasso_logistic(z, labels, penalty, steps=5000)
    slope = z.T @ (1 / (1 + np.exp(-(z @ weights + intercept))) - labels) / 300
    assert np.allclose(slope[weights != 0], -penalty * np.sign(weights[weights != 0]), atol=1e-5) and (np.abs(slope) <= penalty + 1e-5).all()
    assert weights[0] > 0 > weights[1] and (weights == 0).any()
