"""Minimum-cost maximum flow on small graphs of aggregates."""

from __future__ import annotations

from collections import defaultdict, deque


class Flow:
    """Arcs with integer capacity and cost; the cheapest augmenting path is found by relaxation from a queue."""

    def __init__(self) -> None:
        self.arcs: list[list] = []  # head, capacity left, cost; arc i ^ 1 is its reverse
        self.out: dict = defaultdict(list)

    def add(self, tail, head, capacity: int, cost: int = 0) -> int:
        self.out[tail].append(len(self.arcs))
        self.arcs.append([head, capacity, cost])
        self.out[head].append(len(self.arcs))
        self.arcs.append([tail, 0, -cost])
        return len(self.arcs) - 2

    def used(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]

    def _cheapest(self, source, sink):
        cost, by, queue, queued = {source: 0}, {}, deque([source]), {source}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for i in self.out[u]:
                v, left, c = self.arcs[i]
                if left > 0 and cost[u] + c < cost.get(v, 1 << 62):
                    cost[v], by[v] = cost[u] + c, i
                    if v not in queued:
                        queued.add(v)
                        queue.append(v)
        return by if sink in by else None

    def run(self, source, sink) -> int:
        total = 0
        while (by := self._cheapest(source, sink)) is not None:
            path, v = [], sink
            while v != source:
                path.append(by[v])
                v = self.arcs[by[v] ^ 1][0]
            amount = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= amount
                self.arcs[i ^ 1][1] += amount
            total += amount
        return total
