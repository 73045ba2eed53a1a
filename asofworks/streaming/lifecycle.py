"""The lifecycle of panel items on a stream: state of an item, and a timer for the exit that no row tells of."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofworks.operators.lifecycle import EXIT_HORIZON

DAY_MS = 86_400_000
EPOCH = date(1970, 1, 1)
FIELDS = ("item_type", "parent_sector", "stance_sign", "conviction", "horizon")
PANEL = "as_of date, item string, item_type string, parent_sector string, stance string, stance_sign int, conviction int, horizon string, lifecycle_state string, delta_stance int, delta_conviction int, age int"


def next_month_end(day: date) -> date:
    """The calendar of month ends."""
    first = (day.replace(day=1) + timedelta(days=32)).replace(day=1)
    return (first + timedelta(days=32)).replace(day=1) - timedelta(days=1)


def stance(sign: int) -> str:
    return "bullish" if sign > 0 else "bearish" if sign < 0 else "neutral"


class Item:
    """What is kept of an item: its last entry, and entries of periods that are not yet complete."""

    def __init__(self, name: str, text: str | None, following: Callable[[date], date]):
        kept = json.loads(text) if text else {"last": None, "waiting": {}}
        self.name, self.last, self.waiting, self.following = name, kept["last"], kept["waiting"], following

    def text(self) -> str:
        return json.dumps({"last": self.last, "waiting": self.waiting})

    def add(self, period: int, entry: list) -> None:
        """An entry of a period; the one of the greatest order (its first field) stays."""
        known = self.waiting.get(str(period))
        if known is None or entry[0] >= known[0]:
            self.waiting[str(period)] = entry

    def exit_day(self) -> int | None:
        return None if self.last is None else (self.following(EPOCH + timedelta(days=self.last["day"])) - EPOCH).days

    def due(self, upto: int) -> Iterator[tuple]:
        """Panel rows of all periods up to a day, in their order; an entry that is not followed by another ends in the next period."""
        for day in sorted(int(d) for d in self.waiting if int(d) <= upto):
            if (gone := self.exit_day()) is not None and gone < day:
                yield self.ended(gone)
            yield self.entered(day, self.waiting.pop(str(day)))
        if (gone := self.exit_day()) is not None and gone <= upto:
            yield self.ended(gone)

    def entered(self, day: int, entry: list) -> tuple:
        kind, sector, sign, conviction, horizon = entry[1:]
        before = self.last
        if before is None:
            state, changes, age = "NEW", (0, 0), 1
        else:
            state = "FLIPPED" if sign * before["sign"] < 0 else "SUSTAINED"
            changes, age = (sign - before["sign"], conviction - before["conviction"]), before["age"] + 1
        self.last = {"day": day, "sign": sign, "conviction": conviction, "age": age, "kind": kind, "sector": sector}
        return EPOCH + timedelta(days=day), self.name, kind, sector, stance(sign), sign, conviction, horizon, state, *changes, age

    def ended(self, day: int) -> tuple:
        was, self.last = self.last, None
        return EPOCH + timedelta(days=day), self.name, was["kind"], was["sector"], "neutral", 0, 0, EXIT_HORIZON, "EXITED", -was["sign"], -was["conviction"], 0

    def timer(self) -> int | None:
        """The next day on which there is something to tell."""
        days = [int(d) for d in self.waiting] + ([] if self.last is None else [self.exit_day()])
        return min(days, default=None)


def lifecycle_stream(items: DataFrame, late: str, following: Callable[[date], date] = next_month_end, order: str | None = None) -> DataFrame:
    """The rows of operators.lifecycle of a stream of items (as_of, item, item_type, parent_sector, stance_sign, conviction, horizon).

    A period is told when the watermark has passed its date, so its rows may come
    in any order and in any micro-batch up to `late` behind the newest; those
    that are later still are dropped. An item that has no entry in a period
    exits by a timer, without any row of its own. following names the period
    after a period's date. order: of several entries of an item and period the
    greatest counts. State is one entry and the incomplete periods of each item.
    """
    # dates as times in UTC, whatever the session's zone
    day = F.unix_date("as_of")
    place = F.col(order).cast("double") if order else F.lit(0.0)
    rows = items.select("item", *FIELDS, day.alias("_day"), F.timestamp_millis(day.cast("long") * DAY_MS).alias("_ts"), place.alias("_order")).withWatermark("_ts", late)

    def told(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = Item(key[0], state.get[0] if state.exists else None, following)
        if not state.hasTimedOut:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    plain = lambda v: None if pd.isna(v) else v
                    own.add(int(r[6]), [float(r[8]), plain(r[1]), plain(r[2]), int(r[3]), int(r[4]), plain(r[5])])
        out = list(own.due(state.getCurrentWatermarkMs() // DAY_MS))
        when = own.timer()
        if when is None:
            state.remove()
        else:
            state.update((own.text(),))
            state.setTimeoutTimestamp(when * DAY_MS)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PANEL.split(", ")])

    return rows.groupBy("item").applyInPandasWithState(told, PANEL, "text string", "append", "EventTimeTimeout")
