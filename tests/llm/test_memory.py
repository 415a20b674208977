from __future__ import annotations

import pickle
import random
import weakref

import numpy as np
import pytest

from tidemill.llm._spark import give_back_memory
from tidemill.llm.decontamination import Items, leaks_in, normal


@pytest.mark.parametrize("all_by_pieces", [False, True])
def test_items_are_sent_packed_and_find_the_same(all_by_pieces):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    rows = [(k, " ".join(word() for _ in range(rng.choice([6, 60])))) for k in range(30)]
    items = Items(rows, 0.2, 0.999, all_by_pieces)
    flags = sum({id(s): s.flags.nbytes for s in [*items.seen, *items.own.values()]}.values()) + (items.pieces.seen.nbytes if items.pieces else 0)
    sent = pickle.dumps(items)
    assert len(sent) < flags
    texts = [f"{word()} {text[: len(text) // 2]}x{text[len(text) // 2 :]} {word()}".encode() for _, text in rows]
    docs = normal(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    found = leaks_in(*docs, items)
    assert {(k, k) for k in range(30)} <= set(found)
    assert leaks_in(*docs, pickle.loads(sent)) == found


def test_what_lies_in_a_cycle_is_given_back():
    class Task:
        pass

    task = Task()
    task.own, gone = task, weakref.ref(task)
    del task
    give_back_memory()
    assert gone() is None
