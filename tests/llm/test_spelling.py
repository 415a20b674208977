from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from tidemill.llm import spelling


def near(a: str, b: str) -> bool:
    """One inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any(a[:k] + a[k + (len(a) == len(b)) :] == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain(texts, least_length, least_count, times, spoil_every):
    total = Counter()
    for d, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if spoil_every and h % spoil_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                total[run] += 1
    words = {w: n for w, n in total.items() if n >= least_count}
    out = {}
    for w, n in words.items():
        own = sorted((-m, v) for v, m in words.items() if near(v, w))
        out[w] = (n, len(own), own[0][1] if own and -own[0][0] >= times * n else None)
    rows = set()
    for w, (n, n_near, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.add((w, form, root, n, n_near, words[form] if form else None))
    return rows


def test_variants_against_brute_force(spark):
    """Words over few letters, so that edits, ties, shared halves and chains of forms abound; nulls, empty and repeated rows."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abÀé÷z") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    texts = [(k, " ".join(rng.choice(words[: 3 + 147 * (k % 3 > 0)]) for _ in range(rng.randint(1, 60)))) for k in range(80)]
    texts += [(None, "aab aab ab"), (7, None), (8, ""), (9, "AAB aÀb 12,,ab"), (9, "AAB aÀb 12,,ab"), (10, "abab " * 400 + "ababa " * 30 + "bababa " * 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for least_length, least_count, times, spoil in ((1, 1, 2, None), (2, 2, 10, 5), (4, 1, 3, 31)):
        got = spelling.spelling_variants(docs, least_length, least_count, times, spoil)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {tuple(r) for r in got.collect()} == plain(texts, least_length, least_count, times, spoil)


def test_a_form_of_a_form_leads_to_the_root(spark):
    docs = spark.createDataFrame([(1, "kitten " * 2000 + "kittenn " * 200 + "kittennn " * 20 + "kittennnn " * 2 + "sitten " * 5)], "doc_id long, text string")
    got = {r["word"]: r for r in spelling.spelling_variants(docs, 5).collect()}
    assert {w: r["root"] for w, r in got.items()} == dict.fromkeys(("kitten", "kittenn", "kittennn", "kittennnn", "sitten"), "kitten")
    assert got["kittennnn"]["form"] == "kittennn" and got["kittennnn"]["form_n"] == 20 and got["kitten"]["n_near"] == 2


def test_odd_rows(spark, odd_docs, no_docs):
    rows = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    got = {r["word"]: r["n"] for r in spelling.spelling_variants(odd_docs).collect()}
    assert got and "x" * 200_000 not in got and all(n >= 2 and len(w) >= 7 for w, n in got.items()) and len(rows) < odd_docs.count()
    assert spelling.spelling_variants(odd_docs, least_count=1).where("length(word) = 200000").count() == 1
    assert not spelling.spelling_variants(no_docs).collect()


def test_stretches_cut_no_word(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 5)
    for text in ("", "abc defgh ijklmnopqrst uv", "é" * 30, "   ", "ab cd ef gh"):
        parts = list(spelling._stretches(text))
        assert "".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def test_an_edit_flips_two_parities_at_most():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice(spelling.LETTERS) for _ in range(rng.randint(1, 12)))
        k, c = rng.randrange(len(word)), rng.choice(spelling.LETTERS)
        a, b, d = spelling.parities([word, word[:k] + c + word[k + 1 :], word[:k] + c + word[k:]]).tolist()
        assert (a ^ b).bit_count() <= 2 and (a ^ d).bit_count() == 1
