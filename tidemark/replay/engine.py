"""Event replay with orders: one run folds its merged events in order; runs are independent and run in parallel.

Prices, quantities and money are integers at 1e-9 scale. A step does, in this order: expiry, the book, queue fills by
trades, resting orders, liquidation, triggers, TWAP slices, the strategy, commands, and an equity sample.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .book import LevelBook

SCALE = 1_000_000_000
#: States in which an order may still do something.
OPEN = ("pending", "resting", "waiting", "twap")


def notional(price: int, quantity: int) -> int:
    """price * quantity, rounded half away from zero."""
    x = price * quantity
    return (abs(x) + SCALE // 2) // SCALE * (1 if x >= 0 else -1)


@dataclass(slots=True)
class Order:
    id: str
    instrument: str
    side: str
    quantity: int
    kind: str = "market"  # market, limit
    limit: int | None = None
    tif: str = "GTC"  # GTC, IOC, FOK
    reduce_only: bool = False
    post_only: bool = False
    trigger: int | None = None  # becomes live when the mark reaches it
    trigger_above: bool = True
    expires: int | None = None
    slices: int = 0  # TWAP: that many market orders, `every` apart
    every: int = 0
    live_at: int = 0
    filled: int = 0
    status: str = "new"
    reason: str = ""
    ahead: int = 0

    @property
    def left(self) -> int:
        return self.quantity - self.filled


@dataclass
class Position:
    quantity: int = 0
    average: int = 0
    realized: int = 0
    commissions: int = 0

    def fill(self, signed: int, price: int, commission: int) -> None:
        q = self.quantity
        if q == 0 or (q > 0) == (signed > 0):
            self.average = (self.average * abs(q) + price * abs(signed)) // abs(q + signed)
        else:
            closed = min(abs(q), abs(signed)) * (1 if q > 0 else -1)
            self.realized += notional(price - self.average, closed)
            if abs(signed) > abs(q):
                self.average = price
            elif abs(signed) == abs(q):
                self.average = 0
        self.quantity += signed
        self.realized -= commission
        self.commissions += commission


@dataclass
class Config:
    cash: int = 100_000 * SCALE
    fee: str = "none"  # none, proportional, prediction, cents, tiered
    rate: float = 0.0
    rebate: float = 0.0
    tiers: tuple[tuple[int, float], ...] = ()  # (volume so far, rate)
    slippage: int = 0  # shifts what takers pay, against them
    latency: int = 0
    maintenance: float = 0.0  # equity below this share of exposure liquidates
    sample: int = 0  # distance of equity samples; 0: each step


class Run:
    """One replay. A strategy is called as strategy(run, event) and may submit, cancel and amend."""

    def __init__(self, config: Config, strategy: Callable | None = None, samples: bool = True, keeps_fills: bool = True, key: str | None = None):
        self.c, self.strategy, self.samples, self.keeps_fills, self.key = config, strategy, samples, keeps_fills, key
        self.cash, self.volume, self.now = config.cash, 0, 0
        self.books: dict[str, LevelBook] = {}
        self.marks: dict[str, int] = {}
        self.positions: dict[str, Position] = {}
        self.orders: dict[str, Order] = {}
        self.live: dict[str, Order] = {}  # the open ones: a step looks at no others
        self.fills: list[dict] = []
        self.equity_curve: list[dict] = []
        self._sampled: int | None = None
        self.records = self.filled = self.rejected = 0  # of all that has been given away

    # --- orders ---------------------------------------------------------------------------------------------------

    def submit(self, order: Order) -> None:
        order.live_at = self.now + self.c.latency
        self.orders[order.id] = order
        if order.quantity <= 0:
            order.status, order.reason = "rejected", "quantity"
        elif order.slices:
            order.status = "twap"
        elif order.trigger is not None:
            order.status = "waiting"
        else:
            order.status = "pending"
        if order.status in OPEN:
            self.live[order.id] = order

    def cancel(self, order_id: str) -> None:
        o = self.orders.get(order_id)
        if o and o.status in OPEN:
            o.status = "cancelled"

    def amend(self, order_id: str, quantity: int | None = None, limit: int | None = None) -> None:
        """A new price or a greater size loses the place in the queue."""
        o = self.orders.get(order_id)
        if not o or o.status not in ("pending", "resting", "waiting"):
            return
        if (limit is not None and limit != o.limit) or (quantity or 0) > o.quantity:
            o.ahead = self._displayed(o, limit if limit is not None else o.limit)
        o.quantity, o.limit = quantity or o.quantity, limit if limit is not None else o.limit
        if o.left <= 0:
            o.status = "filled"

    def _displayed(self, o: Order, price: int | None) -> int:
        book = self.books.get(o.instrument)
        return 0 if book is None else (book.bids if o.side == "buy" else book.asks).get(price, 0)

    def _commission(self, price: int, quantity: int, taker: bool) -> int:
        if self.c.fee == "none":
            return 0
        value = notional(price, quantity)
        if self.c.fee == "proportional":
            return round(value * self.c.rate)
        if self.c.fee in ("prediction", "cents"):
            fee = notional(notional(price, SCALE - price), quantity) * self.c.rate
            fee = fee if taker else -fee * self.c.rebate
            cent = SCALE // 100
            return -(-round(fee) // cent) * cent if self.c.fee == "cents" else round(fee)
        if self.c.fee == "tiered":
            rate = max((t for t in self.c.tiers if t[0] <= self.volume), default=(0, self.c.rate))[1]
            return round(value * rate)
        return 0

    def _fill(self, o: Order, price: int, quantity: int, taker: bool) -> None:
        sign = 1 if o.side == "buy" else -1
        if taker:
            price += sign * self.c.slippage
        fee = self._commission(price, quantity, taker)
        self.volume += (value := notional(price, quantity))
        if (p := self.positions.get(o.instrument)) is None:
            p = self.positions[o.instrument] = Position()
        p.fill(sign * quantity, price, fee)
        self.cash -= sign * value + fee
        o.filled += quantity
        if o.left <= 0:
            o.status = "filled"
        self.filled += 1
        if self.keeps_fills:
            self.fills.append({"run_id": self.key, "ts": self.now, "order_id": o.id, "instrument_id": o.instrument, "side": o.side, "price": price, "quantity": quantity, "commission": fee, "is_taker": taker})

    def _clamp(self, o: Order) -> int:
        if not o.reduce_only:
            return o.left
        q = self.positions.get(o.instrument, Position()).quantity
        against = -q if o.side == "buy" else q
        return max(0, min(o.left, against))

    def _arrive(self, o: Order) -> None:
        """A live order meets the book."""
        book = self.books.get(o.instrument, LevelBook())
        want = self._clamp(o)
        if want == 0:
            o.status, o.reason = "rejected", "reduce only"
            return
        limit = o.limit if o.kind == "limit" else None
        takes = book.walk(o.side, want, limit)
        if takes and o.post_only:
            o.status, o.reason = "rejected", "post only"
            return
        if o.tif == "FOK" and sum(q for _, q in takes) < want:
            o.status, o.reason = "cancelled", "not fillable"
            return
        levels = book.asks if o.side == "buy" else book.bids
        for price, q in takes:
            self._fill(o, price, q, True)
            levels[price] -= q
            if not levels[price]:
                del levels[price]
        if o.status == "filled":
            return
        if o.kind == "market" or o.tif in ("IOC", "FOK") or o.reduce_only and self._clamp(o) == 0:
            o.status = "cancelled"
        else:
            o.status, o.ahead = "resting", self._displayed(o, o.limit)

    # --- steps ----------------------------------------------------------------------------------------------------

    def step(self, e: dict) -> None:
        self.now = now = e["ts_init"]
        kind, name = e["kind"], e.get("instrument_id")
        for o in self.live.values() if self.live else ():
            if o.expires is not None and o.expires <= now and o.status in ("pending", "resting", "waiting"):
                o.status, o.reason = "expired", "time"
        if name and name not in self.books:
            self.books[name] = LevelBook()
        if kind in ("snapshot", "delta", "gap"):
            book = self.books[name] if name else LevelBook()
            book.apply(e.get("action") or kind, e.get("side"), e.get("price"), e.get("size"), bool(e.get("is_last", True)))
            if (mid := book.mid) is not None:
                self.marks[name] = int(mid)
        elif kind in ("trade", "bar", "reference"):
            self.marks[name] = e["price"]
        elif kind == "funding":
            p = self.positions.get(name)
            if p and p.quantity:
                self.cash -= (paid := round(notional(self.marks.get(name, p.average), p.quantity) * e["rate"]))
                p.realized -= paid
        elif kind == "corporate":
            self._corporate(name, e)
        if kind == "trade":
            self._queue_fills(name, e)
        if kind in ("snapshot", "delta"):
            for o in list(self.live.values()):
                if o.status == "resting" and o.instrument == name:
                    for price, q in book.walk(o.side, self._clamp(o), o.limit):
                        self._fill(o, min(price, o.limit) if o.side == "buy" else max(price, o.limit), q, False)
        if self.c.maintenance:
            self._liquidate()
        for o in list(self.live.values()) if self.live else ():
            if o.status == "waiting":
                mark = self.marks.get(o.instrument)
                if mark is not None and o.live_at <= now and (mark >= o.trigger if o.trigger_above else mark <= o.trigger):
                    o.status = "pending"
            elif o.status == "twap" and o.live_at <= now:
                self._twap(o)
        if self.strategy is not None:
            self.strategy(self, e)
        if kind == "command":
            self._command(e)
        if self.live:
            for o in list(self.live.values()):
                if o.status == "pending" and o.live_at <= now:
                    self._arrive(o)
            for k in [o.id for o in self.live.values() if o.status not in OPEN]:
                del self.live[k]
        if self.samples and (self._sampled is None or self.now - self._sampled >= self.c.sample):
            self._sampled = self.now
            self.equity_curve.append({"ts": self.now, "cash": self.cash, "position_value": (held := self.exposure()), "equity": self.cash + held})

    def _twap(self, o: Order) -> None:
        size = -(-o.left // o.slices) if o.slices > 0 else 0
        if size:
            child = Order(f"{o.id}/{o.slices}", o.instrument, o.side, size, tif="IOC", reduce_only=o.reduce_only, live_at=self.now, status="pending")
            self.orders[child.id] = child
            self._arrive(child)
            o.filled += child.filled
        o.slices, o.live_at = o.slices - 1, self.now + o.every
        if o.left <= 0 or o.slices <= 0:
            o.status = "filled" if o.left <= 0 else "cancelled"

    def _queue_fills(self, name: str, e: dict) -> None:
        """A print first consumes what stands ahead of a resting order, then fills it at its own limit."""
        for o in self.live.values():
            if o.status != "resting" or o.instrument != name or e.get("aggressor") == o.side:
                continue
            through = e["price"] < o.limit if o.side == "buy" else e["price"] > o.limit
            if through or e["price"] == o.limit:
                size = e["size"] if not through else e["size"] + o.ahead
                used = min(o.ahead, size)
                o.ahead, size = o.ahead - used, size - used
                if (q := min(size, self._clamp(o))) > 0:
                    self._fill(o, o.limit, q, False)

    def _corporate(self, name: str, e: dict) -> None:
        if e["action"] == "split":
            self._split(name, e["ratio"])
        p = self.positions.get(name)
        if not p or not p.quantity:
            return
        if e["action"] == "dividend":
            self.cash += (paid := notional(e["per_share"], p.quantity))
            p.realized += paid
        elif e["action"] == "delist":
            self._fill(Order("delist", name, "sell" if p.quantity > 0 else "buy", abs(p.quantity)), e["final_price"], abs(p.quantity), False)

    def _split(self, name: str, ratio: float) -> None:
        """Sizes grow and prices shrink by the ratio: of the position, the mark, the book and all open orders."""
        grow, shrink = lambda x: round(x * ratio), lambda x: None if x is None else round(x / ratio)
        if p := self.positions.get(name):
            p.quantity, p.average = grow(p.quantity), shrink(p.average)
        if name in self.marks:
            self.marks[name] = shrink(self.marks[name])
        if book := self.books.get(name):
            for levels in (book.bids, book.asks):
                old = list(levels.items())
                levels.clear()
                for price, size in old:  # prices may meet after rounding
                    levels[shrink(price)] = levels.get(shrink(price), 0) + grow(size)
        for o in self.live.values():
            if o.instrument == name:
                o.quantity, o.filled, o.ahead = grow(o.quantity), grow(o.filled), grow(o.ahead)
                o.limit, o.trigger = shrink(o.limit), shrink(o.trigger)

    def _liquidate(self) -> None:
        gross = sum(abs(notional(self.marks.get(n, p.average), p.quantity)) for n, p in self.positions.items())
        if gross and self.equity() < self.c.maintenance * gross:
            for n, p in self.positions.items():
                if p.quantity:
                    o = Order(f"liquidation/{n}/{self.now}", n, "sell" if p.quantity > 0 else "buy", abs(p.quantity), tif="IOC", reduce_only=True)
                    self.orders[o.id] = o
                    self._arrive(o)

    def _command(self, e: dict) -> None:
        c = json.loads(e["command"])
        action = c.pop("action", "submit")
        if action == "submit":
            self.submit(Order(**c))
        elif action == "cancel":
            self.cancel(c["id"])
        else:
            self.amend(**{("order_id" if k == "id" else k): v for k, v in c.items()})

    def exposure(self) -> int:
        return sum(notional(self.marks.get(n, p.average), p.quantity) for n, p in self.positions.items())

    def equity(self) -> int:
        return self.cash + self.exposure()


TABLES = {
    "summary": "run_id string, starting_cash long, final_cash long, equity long, realized_pnl long, commissions long, records long, fills long, rejected long",
    "fills": "run_id string, ts long, order_id string, instrument_id string, side string, price long, quantity long, commission long, is_taker boolean",
    "equity": "run_id string, ts long, cash long, position_value long, equity long",
    "positions": "run_id string, instrument_id string, quantity long, average long, realized long, commissions long",
    "orders": "run_id string, order_id string, instrument_id string, side string, quantity long, filled long, status string, reason string",
}


_ORDER_FIELDS = ("side", "quantity", "filled", "status", "reason")


def _given(key: str, r: Run, wanted: tuple[str, ...], done: bool) -> dict[str, list[dict]]:
    """The fills, samples and closed orders since the last call, which the run then forgets; with done, all that is left."""
    out = {}
    if r.fills:
        if "fills" in wanted:
            out["fills"] = r.fills
        r.fills = []
    if r.equity_curve:
        if "equity" in wanted:
            out["equity"] = [{"run_id": key} | f for f in r.equity_curve]
        r.equity_curve = []
    closed = [o for o in r.orders.values() if done or o.status not in OPEN]
    if closed:
        if "orders" in wanted:
            out["orders"] = [{"run_id": key, "order_id": o.id, "instrument_id": o.instrument} | {k: getattr(o, k) for k in _ORDER_FIELDS} for o in closed]
        r.rejected += sum(o.status == "rejected" for o in closed)
        r.orders = {} if len(closed) == len(r.orders) else {k: o for k, o in r.orders.items() if o.status in OPEN}
    if done and "summary" in wanted:
        p = r.positions
        summary = {"starting_cash": r.c.cash, "final_cash": r.cash, "equity": r.equity(), "records": r.records, "fills": r.filled}
        summary |= {"realized_pnl": sum(x.realized for x in p.values()), "commissions": sum(x.commissions for x in p.values()), "rejected": r.rejected}
        out["summary"] = [{"run_id": key} | summary]
    if done and "positions" in wanted:
        out["positions"] = [{"run_id": key, "instrument_id": n} | vars(x) for n, x in r.positions.items()]
    return out


def _values(c: pa.Array) -> list:
    """to_pylist, faster for numbers and for few different strings."""
    if pa.types.is_integer(c.type):
        numbers = c.fill_null(0).to_numpy().tolist()
        return numbers if not c.null_count else [v if known else None for v, known in zip(numbers, c.is_valid().to_pylist(), strict=True)]
    if pa.types.is_string(c.type) and len(c) and 4 * len((d := c.dictionary_encode()).dictionary) < len(c):
        words = [*d.dictionary.to_pylist(), None]
        return [words[k] for k in d.indices.fill_null(-1).to_numpy().tolist()]
    return c.to_pylist()


def simulate(events: DataFrame, configs: Config | dict[str, Config], output: str = "summary", strategy: Callable | None = None, expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """events: run_id, ts_init, priority, stream, arrival and what Run.step reads; configs: one for all runs, or by run.

    output names one of TABLES, or is "all": then rows of every table come from one replay, told apart by the column
    `output` (run_table picks one; write the whole before reading it more than once). A run is folded in order by one task that
    streams its events and gives fills, samples and closed orders away batch by batch: it holds the run's books, positions and open
    orders. An order's id may come again once the order is closed; that is another order, with a row of its own. A study's trials are
    as many runs.

    With expand, events need run_id and any of the order's columns, and are what is dealt and sorted: expand then makes each task's
    rows, still in order, into what Run.step reads, so that a sort holds no more than the rows given.
    """
    wanted = tuple(TABLES) if output == "all" else (output,)
    fields = {f.name: f for t in wanted for f in StructType.fromDDL(TABLES[t]).fields}
    schema = StructType([*(StructType.fromDDL("output string").fields if output == "all" else []), *fields.values()])
    arrow = to_arrow_schema(schema)
    samples, keeps_fills = "equity" in wanted or strategy is not None, "fills" in wanted or strategy is not None

    def run(batches):
        key, r = None, None

        def rows(done):
            given = _given(key, r, wanted, done)
            return [{"output": t} | x for t in wanted for x in given.get(t, ())] if output == "all" else given.get(output, [])

        for batch in batches:
            out, names = [], batch.schema.names
            for e in zip(*map(_values, batch.columns), strict=True):
                e = dict(zip(names, e, strict=True))
                if r is None or e["run_id"] != key:
                    if r is not None:
                        out += rows(True)
                    key = e["run_id"]
                    r = Run(configs if isinstance(configs, Config) else configs[key], strategy, samples, keeps_fills, key)
                r.step(e)
                r.records += 1
                if len(out) >= 65_536:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
            if r is not None:
                out += rows(False)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if r is not None:
            yield pa.RecordBatch.from_pylist(rows(True), arrow)

    order = [c for c in ("run_id", "ts_init", "priority", "stream", "arrival") if c in events.columns]
    ordered = events.repartition("run_id").sortWithinPartitions(*order)
    return (expand(ordered) if expand else ordered).mapInArrow(run, schema)


def run_table(replayed: DataFrame, name: str) -> DataFrame:
    """One of TABLES out of simulate(..., "all")."""
    return replayed.where(F.col("output") == name).select(*StructType.fromDDL(TABLES[name]).names)
