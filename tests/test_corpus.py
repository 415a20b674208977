"""Lines, pages, conversations and vectors against plain versions, on broken and uneven input."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions.html import BLOCKS, blocks
from tidemill.operators import keys, neighbours
from tidemill.operators.keys import hash_pair, weighted_join
from tidemill.operators.lines import drop_repeated_lines
from tidemill.operators.neighbours import nearest_vectors, recall_of
from tidemill.operators.pages import page_text
from tidemill.operators.turns import assemble
from tidemill.sources.tables import load


def test_weighted_join_is_a_left_join_that_parts_heavy_keys(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 700).cast("string")).alias("word"))
    h1, h2 = hash_pair(F.col("word"))
    left = left.withColumns({"h1": h1, "h2": h2}).repartition(8)
    right = left.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("word").alias("found")).where("found = 'hot' OR found < '5'")
    got = weighted_join(left, right, "n")
    assert got.columns == ["id", "word", "h1", "h2", "n", "found"] and got.count() == 6000
    assert not got.where("found <> word OR (found IS NULL AND (word = 'hot' OR word < '5'))").count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower() and keys.HEAVY_PARTS == 1000


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", " a\t", "b", "", " ", "c d", "é", "a b "]), max_size=7).map("\n".join)), max_size=9), most=st.integers(1, 3))
def test_lines_against_plain(spark, texts, most):
    docs = spark.createDataFrame([(k * 3 % 10, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    rows = {k * 3 % 10: t for k, t in enumerate(texts)}
    first: dict[str, list[int]] = {}
    for d, t in rows.items():
        for line in {x.strip(" \t") for x in (t or "").split("\n")} - {""}:
            first.setdefault(line, []).append(d)
    want = set()
    for d, t in rows.items():
        own = [] if t is None else t.split("\n")
        kept = [x for x in own if not (len(first.get(x.strip(" \t"), [])) > most and min(first[x.strip(" \t")]) < d)]
        want.add((d, None if t is None else "\n".join(kept), len(own), len(own) - len(kept)))
    got = drop_repeated_lines(docs, most)
    assert got.columns == ["doc_id", "text", "n_chars", "n_lines", "n_dropped"]
    assert {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()} == want


def test_a_line_in_a_third_of_all_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, F.lit("\nhot line")).otherwise(F.lit(""))).alias("text"))
    got = drop_repeated_lines(docs).groupBy("n_dropped").count().collect()
    assert {r["n_dropped"]: r["count"] for r in got} == {0: 2001, 1: 999}


def plain_blocks(text):
    """One character after another."""
    out, now, unread, k = [], "", [], 0
    space = "\t\n\f\r "
    while k < len(text):
        if text.startswith("<!--", k):
            end = text.find("-->", k + 4)
            k = len(text) if end < 0 else end + 3
        elif re.match("<[!?]|</[^A-Za-z]", text[k:]):
            end = text.find(">", k)
            k = len(text) if end < 0 else end + 1
        elif m := re.match("<(/?)([A-Za-z][^\t\n\f\r />]*)", text[k:]):
            name, k = m[2].lower(), k + m.end()
            closed = False
            while k < len(text) and not closed:
                if text[k] == ">":
                    closed = True
                elif text[k] == "=":
                    j = k + 1
                    while j < len(text) and text[j] in space:
                        j += 1
                    if text[j : j + 1] in ("'", '"') and j < len(text):
                        end = text.find(text[j], j + 1)
                        k = j if end < 0 else end
                k += 1
            if not closed:
                name = ""
            if name.encode() in BLOCKS:
                out, now = [*out, now], ""
            if name in ("script", "style", "title") and not m[1]:
                end = re.search(f"(?i)</{name}(?=[\t\n\f\r />])", text[k:])
                k = k + end.start() if end else len(text)
            elif name in ("svg", "template") and not m[1]:
                unread.append(name)
            elif m[1] and name in unread:
                unread.remove(name)
        else:
            now += "" if unread else text[k]
            k += 1
    return [b for x in [*out, now] if (b := re.sub("[ \t\n\r\f\v]+", " ", x).strip(" "))]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b", ">", "<", "a", " b ", "\n", '="', "'", '"', "=", "<br/>", "<!--", "-->", "<!x", "<script>", "</script", "</script>", "<svg>", "</svg>", "</", "<title>", "</TITLE >", "<li class='x>y'>", "é", "/", "<td", "?", "-"]), max_size=16).map("".join))
def test_blocks_of_broken_pages(text):
    assert blocks(text.encode()) == plain_blocks(text)


def test_blocks_take_time_in_proportion():
    for piece in ("<", "<p", "<p a=\"", "<!--", "</script", "<script>", "<svg>", "=\"", "<p>x", "&", "</x a='"):
        blocks(piece.encode() * 100_000)
    assert blocks(b"<p>a &amp; b&nbsp;&#99;<p>\xff\xfe") == ["a & b c", "��"] and blocks(b"") == []


def test_pages_lose_what_a_host_repeats(spark):
    def html(k, own):
        return f"<html><head><title>t</title></head><body><nav><li>Home<li>About</nav><p>{own}</p><footer>© site</footer>"

    rows = [(k, f"http://User@A.example.org:80/{k}", html(k, f"text {k % 3}")) for k in range(9)] + [(20, "https://b.example.org/x", html(0, "alone")), (21, None, None), (22, "no url", "plain <b>bold</b> text"), (None, "http://a.example.org/", "x")]
    got = {r["page_id"]: r for r in page_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got) == {*range(9), 20, 21, 22}
    assert all((got[k]["host"], got[k]["text"], got[k]["n_blocks"], got[k]["n_boilerplate"]) == ("a.example.org", f"text {k % 3}", 4, 3) for k in range(9))
    assert got[20]["text"] == "Home\nAbout\nalone\n© site" and (got[21]["host"], got[21]["text"], got[21]["n_blocks"]) == ("", "", 0) and got[22]["text"] == "plain bold text"


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([None, -1, 0, 1, 2, 3, 5, 9, 14]), st.sampled_from(["user", "assistant", None]), st.sampled_from(["x", "y", None])), max_size=14), part=st.sampled_from([1, 3, 100]))
def test_conversations_against_plain(spark, rows, part):
    want = set()
    for conv in {r[0] for r in rows} - {None}:
        own = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv and t is not None and t >= 0)
        for p in {t // part for t, _, _ in own}:
            at = [k for k, r in enumerate(own) if r[0] // part == p]
            missing = sum(max(0, own[k][0] - (own[k - 1][0] if k else -1) - 1) for k in at)
            repeated = sum(k > 0 and own[k][1] == own[k - 1][1] for k in at)
            runs: list[list[str]] = []
            for k in at:
                if runs and runs[-1][0] == own[k][1]:
                    runs[-1][1] += " " + own[k][2]
                else:
                    runs.append([own[k][1], own[k][2]])
            want.add((conv, p, len(at), missing, repeated, ",".join(r for r, _ in runs), "\n".join(f"{r}: {t}" for r, t in runs)))
    got = assemble(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part)
    assert {tuple(r) for r in got.collect()} == want


def exact(rows, asks, k):
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows}
    out = {}
    for a in asks:
        out[a] = sorted((-round(float(unit[a] @ u), 9) + 0.0, i) for i, u in unit.items() if i != a)[:k]
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_neighbours_against_all_pairs(spark, monkeypatch, block):
    """Families of near and equal vectors, cells split into several blocks; exact finds all, and probing reaches its recall."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 12))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 20] + rng.normal(size=12) * (0.3 + i % 3))]) for i in range(600)]
    rows += [(1000 + i, [1.0] * 12) for i in range(40)]
    odd = [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] + [1.0] * 11), (None, [1.0] * 12), (2003, [None] + [1.0] * 11)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    asked = table.where("vec_id % 50 = 0 OR vec_id >= 2000")
    truth = nearest_vectors(asked, table, 7, exact=True)
    got: dict[int, list] = {}
    for r in truth.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["cosine"] + 0.0, r["vec_id"]))
    want = exact(rows, [i for i, _ in rows if i % 50 == 0], 7)
    assert {q: [(c, i) for _, c, i in sorted(x)] for q, x in got.items()} == want and all([n for n, *_ in sorted(x)] == [*range(1, 8)] for x in got.values())
    told = recall_of(nearest_vectors(asked, table, 7), truth).first()
    assert told["queries"] == len(want) and told["recall"] >= 0.9


def test_neighbours_of_few_and_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], none.schema)
    assert not nearest_vectors(none, none, 3).collect() and not nearest_vectors(one, one, 3, exact=True).collect() and not nearest_vectors(one, none, 3).collect()
    two = one.union(spark.createDataFrame([(2, [3.0, 1.0])], none.schema))
    assert [(r["query_id"], r["vec_id"]) for r in nearest_vectors(one, two, 3, exact=True).collect()] == [(1, 2)]


def test_lines_of_the_table_add_up(spark):
    docs = load(spark, DATA, "documents")
    lines = Counter()
    for r in docs.collect():
        lines.update({x.strip(" \t") for x in r["text"].split("\n")} - {""})
    kept = Counter()
    for r in drop_repeated_lines(docs).collect():
        kept.update({x.strip(" \t") for x in r["text"].split("\n")} - {""})
    assert set(kept) == set(lines) and max(kept.values()) == 1
