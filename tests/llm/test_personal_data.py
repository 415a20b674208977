from __future__ import annotations

import hashlib
import random
import re

import pytest
from compare import DATA, oracle
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import personal_data
from tidemill.llm.personal_data import KINDS, disguised, find_personal_data, identifiers, mask_personal_data, spans_in
from tidemill.llm.queries import QUERIES

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as they stand."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            fits = (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0, 8 <= len(d) <= 15)
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("ab@.-_1 +()0٣é", max_size=40), st.lists(st.sampled_from(["a@b.c", ".d", "@", "1.2.3.4", "300", ".", "4111 1111 1111 1111", "-", "1", " ", "+1 (835) 555-6426", "(", "x"]), max_size=12).map("".join)))
def test_plain_ones_are_what_the_patterns_match(text):
    assert identifiers(text) == plain(text)


DISGUISED = [
    ("phone", "plus one eight three five, five five five - six four two six"), ("phone", "+1 (835) five five five six four two six"), ("email", "john dot smith at mail dot example dot com"), ("email", "bob (at) example [dot] com"),
    ("email", "bob{AT}example.com"), ("email", "bob&#64;example&#x2E;com"), ("email", "bob%40example.com"), ("email", "jоhn@exаmple.com"), ("email", "bob @ example.com"), ("email", "anna arroba correo punto es"),
    ("email", "b­ob@exam​ple.com"), ("email", "bob＠example．com"), ("ip", "10[.]0[.]0[.]1"), ("ip", "one two seven dot zero dot zero dot one"), ("ip", "１２７.0.0.1"), ("card", "４１１１ 1111 1111 1111"),
    ("card", "four one one one, one one one one, one one one one, one one one one"), ("card", "4111–1111–1111–1111"), ("card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"), ("card", "٤١١١ ١١١١ ١١١١ ١١١١"),
    ("email", "john_at_example_dot_com"), ("email", "john-at-mail-dot-example-dot-com"), ("email", "bob @ example . com"), ("email", "bob AT example.com"), ("email", "&#98;ob&#x40;example.com"), ("ip", "192 dot 168 dot 0 dot 1"),
    ("ip", "192 . 168 . 0 . 1"), ("phone", "plus one double five five three triple two eight"), ("phone", "+1 (835) 555-6O2l"), ("card", "4l11 1111 1111 1111"), ("card", "four triple one one one one one one one one one one one one one"),
]


@pytest.mark.parametrize(("kind", "text"), DISGUISED)
def test_disguised_ones_are_found_at_their_source(kind, text):
    for before, after in (("", ""), ("Écrit: ", ", voilà"), ("see ", "\nnext line"), ("🙂 ", " 🙂")):
        whole = before + text + after
        assert (KINDS.index(kind), len(before), len(before) + len(text), False) in spans_in(whole)


def test_clean_prose_is_left_alone():
    for text in ("look at the point of it", "meet me at example.com today", "one two three four", "at dot at dot at", "the dot com crash at home", "Das ist der Punkt. Un point c'est tout. El punto es este.", "sieben auf einen Streich, neuf cent six", "x (at) y", "100 % & 40 [dot] a", "ten.5", "l'été à 20 °C", "come @ noon. It was", "look_at_me and dot_com", "Ill 100 lol 1O", "one double two", "LOOK AT THIS . COM", "a 12 . 5 b", "&#9786; 100%25", "we met at work . In 1999"):
        assert not spans_in(text)
    texts = [t for (t,) in oracle("SELECT text FROM documents")[1]]
    assert not [t for t in texts if disguised(t) and any(not p for *_, p in spans_in(t))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["ab ", "é", "", "x@y "]), st.sampled_from(["", "-", "Z9"])), max_size=6))
def test_a_layer_traces_back_what_it_changed(parts):
    """Each unchanged character comes from itself, each changed one from its whole stretch."""
    text = "".join(a + "#" for a, _ in parts) + "end"
    edits = [(m.start(), m.end(), put) for m, (_, put) in zip(re.finditer("#", text), parts, strict=True)]
    layer = personal_data.Layer(text, edits)
    assert layer.text == "".join(a + b for a, b in parts) + "end"
    want = []
    at = 0
    for begin, end, put in edits:
        want += [(k, k + 1) for k in range(at, begin)] + [(begin, end)] * len(put)
        at = end
    want += [(k, k + 1) for k in range(at, len(text))]
    assert [layer.source(k, k + 1) for k in range(len(layer.text))] == want


def test_time_follows_the_text():
    """Runs that a pattern could go over again and again."""
    for piece in ("x", "1", "one ", "dot ", "a dot ", "@", "1.", "+1 ", "a at ", "(at", "x at y dot ", "é", "- ", "%", "1O", "O 1 ", "_at_", "a_at_b_dot_", "double ", "one . ", "1 dot ", "AT ", "&#6"):
        spans_in(piece * 200_000)


def test_query_against_the_patterns(spark):
    texts = dict(oracle("SELECT doc_id, text FROM documents")[1])
    rows = QUERIES["op13_personal_data"](spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and sum(r["n_email"] for r in rows)
    for r in rows:
        want = [(KINDS[k], a, b) for k, a, b in plain(texts[r["doc_id"]])]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w[0] == k for w in want) for k in KINDS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["spans"] == listed and r["n_disguised"] == 0


def test_odd_rows_and_masks(spark, odd_docs, no_docs):
    assert not find_personal_data(no_docs).collect() and find_personal_data(odd_docs).count() == odd_docs.count()
    rng = random.Random(9)
    texts = [None, "", "a@b.co", "x a@b.co, call +1 (835) 555-6426 now", "jоhn@example.com and 4111 1111 1111 1111", " ".join("".join(rng.choice("abc") for _ in range(5)) for _ in range(50_000)) + " a@b.co"]
    docs = spark.createDataFrame([(k, t, "found", 1) for k, t in enumerate(texts)] + [(2, "a@b.co", None, None), (None, "1.2.3.4", "x", 2)], "doc_id long, text string, source string, start int")
    got = {(r["doc_id"], r["text"] and r["text"][-40:]) for r in mask_personal_data(docs).collect()}
    assert mask_personal_data(docs).columns == docs.columns
    assert {t for _, t in got if t is None or len(t) < 40} == {None, "", "[email]", "x [email], call [phone] now", "[email] and [card]", "[ip]"} and any(t and len(t) == 40 and t.endswith(" [email]") for _, t in got)
    both = {r["doc_id"]: r for r in find_personal_data(docs, keep=("source",)).collect()}
    assert both[0]["found"] == both[1]["found"] == [] and [(s["kind"], s["start"], s["plain"]) for s in both[4]["found"]] == [("email", 0, False), ("email", 2, True), ("card", 21, True)]
    with pytest.raises(ValueError):
        find_personal_data(docs.withColumnRenamed("source", "found"), keep=("found",))
