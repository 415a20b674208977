from __future__ import annotations

import random

from tidemill.llm._components import components


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(1900, 1990)] + [(5, 5), (None, 3)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b and None not in (a, b):
            low, high = sorted((root[a], root[b]))
            root = {x: low if r == high else r for x, r in root.items()}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def _plain_repeats(texts, window):
    """Words left of each text."""
    first: dict[tuple, int] = {}
    split = {d: t.split() for d, t in texts}
    for d, w in split.items():
        for k in range(len(w) - window + 1):
            first[tuple(w[k : k + window])] = min(d, first.get(tuple(w[k : k + window]), d))
    out = {}
    for d, w in split.items():
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < d for j in range(k, k + window)}
        out[d] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_a_hot_route_indexes_in_proportion(spark, monkeypatch):
    """Pairs of near copies around words that all documents share: twice the pairs index twice the words, not four times."""
    from tidemill.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT", 16)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 4096)
    real, indexed = substring_dedup.stored, []

    def counted(df):
        out = real(df)
        if "role" in out.columns and "text" in out.columns:
            indexed.append(sum(r["words"] for r in out.where("role IN (1, 3)").select("words").collect()))
        return out

    monkeypatch.setattr(substring_dedup, "stored", counted)
    for pairs in (40, 80):
        common = " ".join(f"c{k}" for k in range(30))
        texts = [(2 * p + c, f"own{p}{c} " + " ".join(f"l{p}_{k}" for k in range(25)) + f" {common} " + " ".join(f"r{p}_{k}" for k in range(25)) + f" end{p}{c}") for p in range(pairs) for c in (0, 1)]
        texts += [(1000 + k, f"x{k} " + " ".join(f"h{j}" for j in range(70)) + f" y{k}") for k in range(40)]
        got = substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"))
        assert {r["doc_id"]: r["kept_text"] for r in got.collect()} == _plain_repeats(texts, 50)
    assert 1.2 < indexed[1] / indexed[0] < 2.1


def test_first_places_of_windows_in_batches_of_any_size(spark):
    """Rows of a hash over many batches and, where it is heavy, over many tasks: each first place once, each later document's place once."""
    import random

    from tidemill.llm import substring_dedup

    rng = random.Random(6)
    rows = sorted({(rng.choice([1, 1, 1, 2, 3, rng.randrange(4, 90)]), 7, rng.randrange(60), rng.randrange(3)) for _ in range(600)})
    first = {}
    for low, _, d, start in rows:
        first[low] = min(first.get(low, (d, start)), (d, start))
    later = {(d, start, low) for low, _, d, start in rows if d > first[low][0]}
    want = sorted([(d, start, 2) for d, start, _ in later] + [(*first[low], 1) for low in {x[2] for x in later}])
    table = spark.createDataFrame(rows, "low long, high long, id long, start long").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (1, 3, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for heavy in ({}, {(1, 7): first[1]}, {(k, 7): f for k, f in first.items() if any(x[2] == k for x in later)}):
                got = substring_dedup._repeats(table, heavy).collect()
                assert sorted((r["id"], r["start"], r["role"]) for r in got) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_documents_of_one_template_are_not_compared_in_pairs(spark, monkeypatch):
    """Similarity a little below the threshold: the exact step is asked for a few rows a document at most, however many documents there are."""
    from tidemill.llm import near_dedup

    sent = []
    real = near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda members, *rest: (sent.append(members.count()), real(members, *rest))[1])
    for common, own in ((84, 14), (86, 12)):
        texts = [(d, " ".join([*(f"w{k}" for k in range(common + 1)), *(f"x{d}_{k}" for k in range(own))])) for d in range(300)]
        got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words_each=2)
        assert got.where("kept").count() == 300
    assert max(sent) < 300
