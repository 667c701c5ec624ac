"""Keyed stream processors that take states in any order of their days: late ones, corrected ones and ones delivered again.

Keys are dealt to ``groups`` by hash, and a group's keys are worked on at once, as a call into the state store for each key and
day takes far longer than the work. Both keep their state in RocksDB as lists of columns to which a batch appends what is new, so that
it doesn't write the past again, and both forget by timers on the watermark, one of which waits in a group. Results don't depend on
the number of groups: each key has its own days, prices and floor. A checkpoint holds for the number of groups it began with. What a
stream has emitted equals the batch form over everything that was delivered.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSIONS = "stem long, day date, items string, supersedes date, kind string, turn long"
EVENTS = "stem long, day date, old_price double, new_price double, delta double"
_EPOCH = datetime.date(1970, 1, 1)
_DAY_MS = 86_400_000
_BEFORE = -(2**31)  # no day
#: Groups of keys, each of which is read when one of its keys has news.
GROUPS = 256


def _number(day: datetime.date) -> int:
    return (day - _EPOCH).days


def _date(number: int | None) -> datetime.date | None:
    return None if number is None else _EPOCH + datetime.timedelta(days=number)


def versions_of(days: dict[int, str]) -> dict[int, tuple[str, int | None]]:
    """Days whose items differ from those of the day before, with the version that they supersede."""
    out: dict[int, tuple[str, int | None]] = {}
    last: int | None = None
    for day in sorted(days):
        if last is None or days[day] != out[last][0]:
            out[day] = (days[day], last)
            last = day
    return out


def _columns(kinds: str) -> list[str]:
    return [c.split()[0] for c in kinds.split(", ")]


class Versions(StatefulProcessor):
    """Versions of the keys of one group, and corrections of what was said before.

    A row says that a day is a ``version``, that it is one after all or supersedes another (``correction``), or that it is none
    any more (``withdrawn``). Of one day's states the one seen last counts, of those the greatest; a state delivered again says
    nothing. Days more than ``horizon`` before the watermark are forgotten but for the version that was valid then, once a key's
    timer has passed; a state of such a day is passed on as ``late`` and changes nothing. A group's keys are read and
    their changed days appended at once, as columns; only timers write a group's past anew.
    """

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getListState("days", "stems array<long>, days array<int>, items array<string>, seen array<long>")
        self.due = handle.getListState("due", "stems array<long>, at array<long>")
        self.floors = handle.getValueState("floors", "stems array<long>, days array<int>")
        self.turn = handle.getValueState("turn", "turn long")

    def _held(self) -> dict[int, dict[int, tuple[int, str]]]:
        """By key and day when its state was seen, and its items."""
        held: dict[int, dict[int, tuple[int, str]]] = {}
        for block in self.days.get():
            for stem, day, items, seen in zip(*block):
                own = held.setdefault(stem, {})
                own[day] = max(own.get(day, (seen, items)), (seen, items))
        return held

    def _floors(self) -> dict[int, int]:
        return dict(zip(*self.floors.get())) if self.floors.exists() else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, floors = self._held(), self._floors()
        given: dict[int, list] = {}
        for batch in rows:
            for stem, *state in zip(*(batch[c].tolist() for c in ("stem", "number", "items", "micros"))):
                given.setdefault(stem, []).append(state)
        out, changed, due = [], [], {}
        for stem, states in given.items():
            own, floor = held.get(stem, {}), floors.get(stem)
            before, new = versions_of({d: v[1] for d, v in own.items()}), {}
            for at, items, seen in states:
                if floor is not None and at <= floor:
                    out.append((stem, _date(at), items, None, "late"))
                elif at not in own or (seen, items) > own[at]:
                    own[at] = new[at] = (seen, items)
            due[stem] = max(s[2] for s in states) // 1000 + self.horizon * _DAY_MS
            if not new:
                continue
            changed += [(stem, day, items, seen) for day, (seen, items) in new.items()]
            after = versions_of({d: v[1] for d, v in own.items()})
            for day in sorted(before.keys() | after.keys()):
                if day not in after:
                    out.append((stem, _date(day), None, None, "withdrawn"))
                elif before.get(day) != after[day]:
                    items, superseded = after[day]
                    out.append((stem, _date(day), items, _date(superseded), "correction" if day in before else "version"))
        if changed:
            self.days.appendValue(tuple(map(list, zip(*changed))))
        if due:
            self.due.appendValue((list(due), list(due.values())))
            self.handle.registerTimer(min(due.values()))
        if out:
            turn = (self.turn.get()[0] if self.turn.exists() else 0) + 1
            self.turn.update((turn,))
            yield pd.DataFrame([(*r, turn) for r in out], columns=_columns(VERSIONS))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        limit, waiting = now // _DAY_MS - self.horizon, [x for block in self.due.get() for x in zip(*block)]
        passed, left = {s for s, at in waiting if at <= now}, [x for x in waiting if x[1] > now]
        if passed:
            held, floors = self._held(), self._floors()
            for stem in passed & held.keys():
                valid = max((d for d in versions_of({d: v[1] for d, v in held[stem].items()}) if d <= limit), default=None)
                held[stem] = {d: v for d, v in held[stem].items() if d > limit or d == valid}
            floors |= {stem: max(limit, floors.get(stem, limit)) for stem in passed}
            kept = [(stem, day, items, seen) for stem, own in held.items() for day, (seen, items) in own.items()]
            self.days.put([tuple(map(list, zip(*kept)))]) if kept else self.days.clear()
            self.floors.update((list(floors), list(floors.values())))
            self.due.put([tuple(map(list, zip(*left)))]) if left else self.due.clear()
        if left:
            self.handle.registerTimer(min(at for _, at in left))
        yield from ()

    def close(self) -> None:
        pass


def _grouped(of: str, groups: int):
    """The number of the group in which a key's state lies."""
    return F.pmod(F.xxhash64(of), F.lit(groups)).alias("group")


def versions(states: DataFrame, horizon: int = 3650, delay: str = "30 days", groups: int = GROUPS) -> DataFrame:
    """A stream of (stem, day, items, seen) to the stream of its versions and their corrections; ``seen`` is when a state arrived."""
    given = states.select("stem", F.unix_date("day").alias("number"), "items", "seen", F.unix_micros("seen").alias("micros"), _grouped("stem", groups)).withWatermark("seen", delay)
    return given.groupBy("group").transformWithStateInPandas(Versions(horizon), VERSIONS, "append", "eventTime")


def current_versions(log: DataFrame) -> DataFrame:
    """stem, day, items, supersedes: what holds after all corrections of a written stream of versions."""
    said = log.filter("kind <> 'late'").groupBy("stem", "day").agg(F.max_by(F.struct("items", "supersedes", "kind"), "turn").alias("v"))
    return said.filter("v.kind <> 'withdrawn'").select("stem", "day", "v.items", "v.supersedes")


class PriceEvents(StatefulProcessor):
    """Changes of the prices of a group's keys in order of days: prices wait until the watermark has passed their day.

    Days without a price say nothing, of one day's prices the lowest counts, and a change is one of more than ``tolerance``
    against the priced day before. A price that comes after the watermark has passed its day is dropped by the stream. A
    group's prices are put down as columns, and one timer, for the first day that waits, brings up all days that are over.
    """

    def __init__(self, tolerance: float):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "stems array<long>, days array<int>, prices array<double>")
        self.last = handle.getValueState("last", "stems array<long>, prices array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([b[["stem", "number", "price"]] for b in rows]).dropna().drop_duplicates()
        if len(new):
            self.waiting.appendValue(tuple(new[c].tolist() for c in ("stem", "number", "price")))
            self.handle.registerTimer((int(new["number"].min()) + 1) * _DAY_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() // _DAY_MS  # days before this one are over
        blocks = [pd.DataFrame(dict(zip(("stem", "number", "price"), b))) for b in self.waiting.get()]
        if not blocks:
            return
        held = pd.concat(blocks).drop_duplicates()
        over, left = held[held["number"] < passed], held[held["number"] >= passed]
        if len(left):
            self.handle.registerTimer((int(left["number"].min()) + 1) * _DAY_MS)
        if not len(over):
            return
        if self.last.exists():
            stems, priced = self.last.get()
            over = pd.concat([pd.DataFrame({"stem": stems, "number": _BEFORE, "price": priced}), over])
        lowest = over.sort_values(["stem", "number", "price"]).drop_duplicates(["stem", "number"])
        old = lowest["price"].shift().where(lowest["stem"] == lowest["stem"].shift())
        found = lowest.assign(old=old, delta=lowest["price"] - old)[(old - lowest["price"]).abs() > self.tolerance]
        last = lowest.drop_duplicates("stem", keep="last")
        self.last.update((last["stem"].tolist(), last["price"].tolist()))
        self.waiting.put([tuple(left[c].tolist() for c in left.columns)]) if len(left) else self.waiting.clear()
        if len(found):
            days = [_date(n) for n in found["number"].tolist()]
            yield pd.DataFrame({"stem": found["stem"], "day": days, "old_price": found["old"], "new_price": found["price"], "delta": found["delta"]})

    def close(self) -> None:
        pass


def price_events(prices: DataFrame, delay: str = "60 days", tolerance: float = 0.005, groups: int = GROUPS) -> DataFrame:
    """A stream of (stem, at, price), ``at`` a timestamp of the price's day, to the stream of its price changes.

    A row without a stem only moves the watermark on; it makes a stream say what it holds at its end.
    """
    named = F.when(F.col("stem").isNotNull(), F.col("price").cast("double"))
    given = prices.select(F.coalesce("stem", F.lit(0)).alias("stem"), "at", F.unix_date(F.col("at").cast("date")).alias("number"), named.alias("price"), _grouped("stem", groups)).withWatermark("at", delay)
    return given.groupBy("group").transformWithStateInPandas(PriceEvents(tolerance), EVENTS, "append", "eventTime")


def drained(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet folder whatever a stream makes of what has arrived, and ends."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    given = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, given) if given else spark.conf.unset(key)
    return query
