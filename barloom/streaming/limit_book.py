"""Open limit orders of one symbol as keyed state."""

from __future__ import annotations

import math

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

LEVEL = math.log(1.01)     # prices within one per cent share a level
_PENDING = "us long, kind int, order_id long, buy boolean, low double, high double"
_US = 1_000_000


def _micros(moment) -> int:
    """Microseconds since 1970 of a time as Spark hands it over (a naive time in the machine's zone)."""
    return round(moment.timestamp() * _US)


def level_of(price: float) -> int:
    """Number of the price level; grows with the price, prices of zero and below lie beneath all others."""
    return math.floor(math.log(price) / LEVEL) if price > 0 else -(1 << 30)


class LimitBook(StatefulProcessor):
    """Per key: rows that wait for the watermark, and open orders by side and price level.

    `book` holds the orders of a level, `levels` the occupied levels of each side in ascending order. A bar
    takes the levels that it reaches from the best one on: whole ones are deleted, the last may be cut.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.book = handle.getMapState("book", "buy boolean, level int", "prices array<double>, ids array<long>, created array<long>")
        self.levels = handle.getValueState("levels", "buys array<int>, sells array<int>")

    def handleInputRows(self, key, rows, timerValues):
        waiting = list(self.pending.get()) if self.pending.exists() else []
        waiting = [tuple(r) for r in waiting] + [(_micros(r["_t"]), r["kind"], r["order_id"], r["buy"], r["low"], r["high"])
                                                 for r in rows if r["kind"] is not None]
        yield from self._work_off(key, waiting, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        waiting = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        yield from self._work_off(key, waiting, timerValues)

    def _work_off(self, key, waiting: list, timer):
        passed = timer.getCurrentWatermarkInMs() * 1000
        due = sorted((r for r in waiting if r[0] <= passed), key=lambda r: (r[0], r[1], r[2] or 0))
        later = [r for r in waiting if r[0] > passed]
        if later:
            self.pending.put(later)
            self.handle.registerTimer(-(-min(r[0] for r in later) // 1000))
        else:
            self.pending.clear()
        if not due:
            return
        known = self.levels.get() if self.levels.exists() else None
        levels = {True: set(known[0]) if known else set(), False: set(known[1]) if known else set()}
        opened, before = {}, {side: frozenset(v) for side, v in levels.items()}
        for us, kind, order_id, buy, low, high in due:
            if kind == 0:
                if low is not None and not math.isnan(low):
                    self._level(opened, levels, buy is True, level_of(low)).append((low, order_id, us))
                    levels[buy is True].add(level_of(low))
                continue
            for side, price in ((True, low), (False, high)):
                if price is None or math.isnan(price):
                    continue
                for order, created in self._reached(opened, levels, side, price):
                    yield Row(order_id=order, symbol=key[0], created_us=created, filled_us=us)
        for (side, level), orders in opened.items():
            if orders:
                prices, ids, created = zip(*orders, strict=True)
                self.book.updateValue((side, level), (list(prices), list(ids), list(created)))
            elif level in before[side]:
                self.book.removeKey((side, level))
        if any(before[s] != levels[s] for s in levels):
            if levels[True] or levels[False]:
                self.levels.update((sorted(levels[True]), sorted(levels[False])))
            else:
                self.levels.clear()

    def _level(self, opened: dict, levels: dict, side: bool, level: int) -> list:
        """Orders of a level, read from state at their first use."""
        if (side, level) not in opened:
            held = self.book.getValue((side, level)) if level in levels[side] else None
            opened[side, level] = list(zip(*held, strict=True)) if held else []
        return opened[side, level]

    def _reached(self, opened: dict, levels: dict, side: bool, price: float) -> list:
        """Take the orders out of the book that a low (buys) or a high (sells) reaches."""
        edge, out = level_of(price), []
        for level in [x for x in levels[side] if (x >= edge if side else x <= edge)]:
            orders = self._level(opened, levels, side, level)
            hit = [o for o in orders if (o[0] >= price if side else o[0] <= price)]
            if hit:
                out += [(order, created) for _, order, created in hit]
                orders[:] = [o for o in orders if not (o[0] >= price if side else o[0] <= price)]
                if not orders:
                    levels[side].discard(level)
        return out

    def close(self) -> None:
        pass
