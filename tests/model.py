"""A plain Python model of the semantics, for tests: dictionaries and loops only."""

from __future__ import annotations

import heapq
import math


def paths(nodes, edges):
    adj = {n: [] for n in nodes}
    for u, v, c in edges:
        adj[u].append((v, c))
        adj[v].append((u, c))
    out = {}
    for s in nodes:
        dist, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for v, c in adj[u]:
                if d + c < dist.get(v, math.inf):
                    dist[v] = d + c
                    heapq.heappush(heap, (d + c, v))
        out[s] = dist
    return out


class Model:
    def __init__(self, nodes, edges, base, inc=2, overlap=1.5, zones=None, least=3):
        self.d = d = paths(nodes, edges)
        self.zones = zones = sorted(zones or nodes)
        some = zones[:: max(1, len(zones) // min(10, len(zones)))]
        reach = 1.5 * (max(max(d[s].values()) for s in some) or 10 * base)
        self.radii = []
        while base * inc ** len(self.radii) < reach or len(self.radii) < 2:
            self.radii.append(base * inc ** len(self.radii))
        stored = lambda reps, cut: {(s, t): d[s][t] for s in reps for t in reps if t in d[s] and (cut is None or d[s][t] <= cut)}
        cut = [overlap * r for r in self.radii[:-1]] + [None]
        self.reps, self.costs, up = [zones], [stored(zones, cut[0])], [{z: z for z in zones}]
        for k in range(1, len(self.radii)):
            near = lambda s, t: self.costs[-1].get((s, t), math.inf) < self.radii[k] / 2  # noqa: E731, B023
            chosen = []
            for z in self.reps[-1]:
                if not any(near(z, t) for t in chosen):
                    chosen.append(z)
            if k > 1 and len(chosen) < least:
                self.radii = self.radii[:k]
                self.costs[-1] = stored(self.reps[-1], None)
                break
            g = {z: z if z in chosen else min((self.costs[-1][z, t], t) for t in chosen if near(z, t))[1] for z in self.reps[-1]}
            up.append({z: g[r] for z, r in up[-1].items()})
            self.reps.append(chosen)
            self.costs.append(stored(chosen, cut[k]))
        self.groups = up
        for k in range(len(self.reps) - 1):
            for s in self.reps[k]:
                for t in self.reps[k]:
                    if s != t and up[k + 1][s] == up[k + 1][t] and (s, t) not in self.costs[k] and d[s].get(t, math.inf) <= self.radii[k + 1]:
                        self.costs[k][s, t] = d[s][t]

    def cost(self, i, j):
        for g, c in zip(self.groups, self.costs, strict=True):
            if (g[i], g[j]) in c:
                return c[g[i], g[j]]
        return math.inf
