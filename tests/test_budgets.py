"""The ledger of reservations on a store in memory: what it asks the store for and what it gives back."""

from types import SimpleNamespace

import pandas as pd

from corpusmill.streaming import budgets


class Store:
    """Entries as Spark's value and map states keep them, with all that is asked."""

    def __init__(self):
        self.entries, self.asked = {}, []

    def exists(self):
        self.asked.append("exists")
        return () in self.entries

    def get(self):
        return self.entries.get(())

    def update(self, value):
        self.entries[()] = value

    def clear(self):
        self.entries.pop((), None)

    def containsKey(self, key):
        return key in self.entries

    def getValue(self, key):
        return self.entries[key]

    def updateValue(self, key, value):
        self.entries[key] = value

    def removeKey(self, key):
        del self.entries[key]

    def iterator(self):
        return iter(list(self.entries.items()))


def ledger():
    made = budgets.Reservations(10.0, 100)
    made.init(SimpleNamespace(getValueState=lambda *a: Store(), getMapState=lambda *a: Store(), registerTimer=lambda at: None))
    return made


def frame(*rows):
    return pd.DataFrame(rows, columns=["event", "call_id", "seq", "usd", "at"])


def test_no_frame_goes_back_where_nothing_comes_of_a_scope():
    scope, late = ledger(), lambda at: SimpleNamespace(getExpiryTimeInMs=lambda: at, getCurrentWatermarkInMs=lambda: at)
    assert list(scope.handleInputRows(("s",), iter([frame(("unknown", "a", 1, 1.0, 0), ("completed", "a", 2, 1.0, 0))]), None)) == []
    assert list(scope.handleExpiredTimer(("s",), late(50), late(50))) == [] and scope.committed.get() == (1.0,)


def test_a_new_scope_is_not_asked_for_its_timer():
    scope = ledger()
    first = pd.concat(scope.handleInputRows(("s",), iter([frame(("reserved", "a", 1, 1.0, 0))]), None))
    assert first.values.tolist() == [["s", "a", 1, "granted"]] and scope.timer.asked == [] and scope.timer.get() == (100,)
    list(scope.handleInputRows(("s",), iter([frame(("reserved", "b", 2, 1.0, 5))]), None))
    assert scope.timer.asked == ["exists"] and scope.timer.get() == (100,)  # the earlier one stays


def test_odd_rows_in_frames_out_of_order():
    """Null calls and amounts, equal numbers in the order they came, and rows that come twice, over frames."""
    frames = [frame(("reserved", None, 5, 4.0, 9), ("completed", "a", 3, None, 7)), frame(("reserved", "a", 1, 6.0, 0), ("reserved", "a", 1, 7.0, 0), ("reserved", "b", 1, 8.0, 0), ("reserved", None, 5, 4.0, 9))]
    scope = ledger()
    out = pd.concat(scope.handleInputRows(("s",), iter(frames), None))
    got = [(None if pd.isna(c) else c, q, o) for c, q, o in zip(out.call_id, out.seq, out.outcome, strict=True)]
    assert got == [("a", 1, "granted"), ("a", 1, "refused"), ("b", 1, "refused"), (None, 5, "granted"), (None, 5, "granted")]
    assert scope.committed.get() == (4.0,) and scope.actual.entries == {("a",): (0.0,)} and scope.held.entries == {(None,): (4.0, 109, 5)}
