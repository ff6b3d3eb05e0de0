"""Order books of one instrument: by price level, and order by order."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field


@dataclass
class LevelBook:
    """Sizes by price. A gap makes it stale until the next snapshot; size 0 deletes a level."""

    bids: dict[int, int] = field(default_factory=dict)
    asks: dict[int, int] = field(default_factory=dict)
    stale: bool = False
    _snapshot: bool = False

    def apply(self, action: str, side: str | None = None, price: int | None = None, size: int | None = None, last: bool = True) -> None:
        if action == "gap":
            self.stale = True
        elif action == "clear":
            self.bids.clear()
            self.asks.clear()
        else:
            if action == "snapshot":
                if not self._snapshot:
                    self.bids.clear()
                    self.asks.clear()
                    self.stale = False
                self._snapshot = not last
            levels = self.bids if side == "buy" else self.asks
            if action == "delete" or not size:
                levels.pop(price, None)
            else:
                levels[price] = size

    @property
    def bid(self) -> int | None:
        return max(self.bids, default=None) if not self.stale else None

    @property
    def ask(self) -> int | None:
        return min(self.asks, default=None) if not self.stale else None

    @property
    def mid(self) -> float | None:
        return (max(self.bids) + min(self.asks)) / 2 if self.bids and self.asks and not self.stale else None

    @property
    def spread(self) -> int | None:
        return self.ask - self.bid if self.bid is not None and self.ask is not None else None

    def walk(self, side: str, quantity: int, limit: int | None = None) -> list[tuple[int, int]]:
        """What an order takes, level by level: (price, size)."""
        if self.stale:
            return []
        levels, sign = (self.asks, 1) if side == "buy" else (self.bids, -1)
        out = []
        for price in sorted(levels, key=lambda p: sign * p):
            if quantity <= 0 or (limit is not None and sign * price > sign * limit):
                break
            out.append((price, take := min(quantity, levels[price])))
            quantity -= take
        return out


@dataclass
class OrderBook:
    """Single orders, first in first out at each price."""

    orders: dict[str, tuple[str, int, int]] = field(default_factory=dict)
    queues: dict[tuple[str, int], OrderedDict] = field(default_factory=dict)

    def add(self, order: str, side: str, price: int, size: int) -> None:
        self.orders[order] = (side, price, size)
        self.queues.setdefault((side, price), OrderedDict())[order] = size

    def reduce(self, order: str, by: int) -> None:
        """Cancel or execute part of an order; its place stays."""
        side, price, size = self.orders[order]
        if size <= by:
            self.cancel(order)
            return
        self.orders[order] = (side, price, size - by)
        self.queues[side, price][order] = size - by

    execute = reduce

    def cancel(self, order: str) -> None:
        side, price, _ = self.orders.pop(order)
        queue = self.queues[side, price]
        del queue[order]
        if not queue:
            del self.queues[side, price]

    def ahead(self, order: str) -> int:
        """The size that stands before an order at its price."""
        side, price, _ = self.orders[order]
        total = 0
        for o, size in self.queues[side, price].items():
            if o == order:
                return total
            total += size
        return total

    def best(self, side: str) -> int | None:
        prices = [p for s, p in self.queues if s == side]
        return (max if side == "buy" else min)(prices, default=None)
