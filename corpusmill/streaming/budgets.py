"""A ledger of reservations as a stream: granted under a cap, settled by what calls cost, reported where they stay open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "scope string, call_id string, seq long, outcome string"
SETTLED = ("completed", "failed_known_zero")
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Reservations(StatefulProcessor):
    """State of a scope: the committed sum, the open reservations and the settled calls, each call an entry of its own in the store, and the time of its timer.

    Every request to the store is a message to the JVM and every frame a batch of its own: what is known is not asked,
    rows are walked as plain values, and where nothing comes of a scope no frame goes back.
    A call's entries are read at most once a batch (not at all in a scope's first) and written once, if they have
    changed. A scope has one timer, at the earliest time at which one of its open reservations is up.
    """

    def __init__(self, cap: float, patience_ms: int):
        self.cap, self.patience = cap, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.committed = handle.getValueState("committed", "usd double")
        self.timer = handle.getValueState("timer", "at long")
        self.held = handle.getMapState("held", "call_id string", "usd double, due long, seq long")
        self.actual = handle.getMapState("actual", "call_id string", "usd double")

    def _wake(self, due: int, known: bool = True) -> None:
        """A timer at that time, if none is set before it; known: whether one may be."""
        if not (known and self.timer.exists()) or due < self.timer.get()[0]:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames)
        ordered = batch["seq"].to_numpy().argsort(kind="stable")
        events = list(zip(*(batch[c].to_numpy()[ordered].tolist() for c in ("call_id", "event", "seq", "usd", "at")), strict=True))
        known = self.committed.exists()
        total = self.committed.get()[0] if known else 0.0
        entry = lambda store, call: tuple(store.getValue((call,))) if known and store.containsKey((call,)) else None
        before = {call: (entry(self.held, call), entry(self.actual, call)) for call in dict.fromkeys(e[0] for e in events)}
        held, actual = ({call: e[i] for call, e in before.items()} for i in (0, 1))
        out = []
        for call, event, seq, amount, at in events:
            usd = 0.0 if pd.isna(amount) else float(amount)
            open_now = held[call]
            if event == "reserved":
                if total + usd > self.cap + 1e-12:
                    out.append((key[0], call, seq, "refused"))
                    continue
                out.append((key[0], call, seq, "granted"))
                if actual[call] is None:
                    total += usd - (open_now[0] if open_now else 0.0)
                    if open_now and 0 <= open_now[1] < at:
                        out.append((key[0], call, open_now[2], "unsettled"))
                    held[call] = (usd, int(at) + self.patience, int(seq))
            elif event in SETTLED:
                total += usd - (actual[call][0] if actual[call] else 0.0) - (open_now[0] if open_now else 0.0)
                actual[call] = (usd,)
                if open_now:
                    held[call] = None
                    if 0 <= open_now[1] < at:
                        out.append((key[0], call, open_now[2], "unsettled"))
        for call, was in before.items():
            for store, then, now in ((self.held, was[0], held[call]), (self.actual, was[1], actual[call])):
                if now is not None and now != then:
                    store.updateValue((call,), now)
                elif now is None and then is not None:
                    store.removeKey((call,))
        waiting = [h[1] for h in held.values() if h and h[1] >= 0]
        if waiting:
            self._wake(min(waiting), known)
        self.committed.update((total,))
        if out:
            yield pd.DataFrame(out, columns=["scope", "call_id", "seq", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Reservations whose time is up and that no later one has replaced, up to the watermark; they stay committed, as nobody knows what they cost."""
        now, out = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []
        waiting = [(call, held) for call, held in self.held.iterator() if held[1] >= 0]
        for call, (usd, due, seq) in waiting:
            if due <= now:
                self.held.updateValue(call, (usd, -1, seq))
                out.append((key[0], call[0], seq, "unsettled"))
        self.timer.clear()
        later = [held[1] for _, held in waiting if held[1] > now]
        if later:
            self._wake(min(later), False)
        if out:
            yield pd.DataFrame(out, columns=["scope", "call_id", "seq", "outcome"])

    def close(self) -> None:
        pass


def reservations(events: DataFrame, cap: float, patience_ms: int, late: str) -> DataFrame:
    """events(scope, call_id, event, seq, usd, ts) as a stream -> scope, call_id, seq, outcome.

    Every reserved event is granted or refused: granted if what the scope has committed and the new amount stay within
    the cap. A call commits what it cost once it is settled (completed, failed_known_zero; the last settlement counts), until then the last reservation
    granted; a reservation of a settled call is checked and changes nothing; other events change nothing. A granted
    reservation is unsettled if its call is neither settled nor reserved again up to patience_ms behind it, and is reported once,
    when its call's next event or the watermark has passed that time; it stays committed. Null amounts are 0.

    Batches are taken as they come and each in order of seq; what a task holds is a scope's part of one batch,
    so files per trigger bound it. Needs the state store that STORE names.
    """
    timed = events.select("scope", "call_id", "event", "seq", "usd", "ts", F.unix_millis("ts").alias("at"))
    return timed.withWatermark("ts", late).groupBy("scope").transformWithStateInPandas(Reservations(cap, patience_ms), OUTCOMES, "Append", "EventTime")
