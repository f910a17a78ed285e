"""Calls of the state by late events: as many as stretches with rows, not as rows."""

from types import SimpleNamespace

from pyspark.sql import Row

from tracewright import streaming


class State(dict):
    """A map or a value, as the state store gives them."""

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        del self[key]

    def exists(self):
        return "v" in self

    def get(self):
        return self["v"]

    def update(self, value):
        self["v"] = value


def test_timers_follow_stretches():
    timers, held = [], []

    def made(*_):
        held.append(State())
        return held[-1]

    p = streaming.OrderedTransitions(frozenset({("a", "b")}), 1000)
    p.init(SimpleNamespace(getValueState=made, getMapState=made, registerTimer=timers.append))
    rows = [Row(us=us, seq=us, block="ab"[us // 1000 % 2]) for us in range(0, 3_000_000, 1000)]
    # Three batches, none in order.
    for part in (rows[2::3], rows[1::3], rows[::3]):
        list(p.handleInputRows((7,), iter(part[::-1]), None))
    assert sorted(timers) == [1000, 2000, 3000]
    out = [r for t in sorted(timers) for r in p.handleExpiredTimer((7,), None, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))]
    assert [(r.src, r.snk) for r in out] == [("ab"[i % 2], "ab"[(i + 1) % 2]) for i in range(2999)]
    assert [r.epoch for r in out] == [(i + 2) // 2 for i in range(2999)]
    # Nothing waits any more.
    assert sum(map(len, held)) == 1
