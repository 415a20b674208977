from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd

from tidemill.streaming.events import Visits


class Handle:
    """A store of one value and the timers of one key, which counts calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def _count(self, _=None):
        self.calls += 1

    def exists(self):
        self._count()
        return self.value is not None

    def get(self):
        self._count()
        return self.value

    def update(self, value):
        self._count()
        self.value = value

    def clear(self):
        self._count()
        self.value = None

    def registerTimer(self, at):
        self._count()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._count()
        self.timers.remove(at)


def test_users_of_a_bucket_share_a_value_and_a_timer():
    rng, pause, handle = random.Random(5), 10, Handle()
    visits = Visits(pause)
    visits.init(handle)
    got, want, open_ = [], [], {}
    for batch in range(12):
        rows = [(rng.randrange(300), batch * 40 + rng.randrange(-5, 40)) for _ in range(rng.choice([1, 40, 500]))]
        mark, handle.calls = batch * 40 + rng.randrange(30), 0
        parts = [pd.DataFrame(rows[k::2], columns=["user_id", "at"]) for k in range(2)]
        got += visits.handleInputRows((3,), iter(parts), None)
        for at in [t for t in handle.timers if t <= mark]:
            got += visits.handleExpiredTimer((3,), SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), None)
            handle.timers.discard(at)
        assert handle.calls <= 8 and len(handle.timers) <= 1
        for user, at in sorted(rows, key=lambda r: r[1]):
            begin, last, n = open_.get(user, (at, at, 0))
            if n and at - last >= pause:
                want.append((user, begin, last, n))
                begin, last, n = at, at, 0
            open_[user] = (min(begin, at), max(last, at), n + 1)
        for user in [u for u, (_, last, _) in open_.items() if last + pause <= mark]:
            want.append((user, *open_.pop(user)))
    rows = sorted(tuple(r) for part in got for r in part[["user_id", "begin", "last", "n"]].itertuples(index=False))
    assert rows == sorted(want) and len(want) > 500
