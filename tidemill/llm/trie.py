"""A prefix tree of globally ordered sets, and the similarity join that traverses it."""

from __future__ import annotations

import numpy as np


class Trie:
    """Sets of integers in ascending order, stored as a compressed prefix tree in arrays.

    Sets that start alike share nodes, so an overlap with a query is added up once for what they share. A
    traversal goes level by level over all live nodes at once and drops a subtree when what is left of the query
    or of the subtree's sets can no longer bring the overlap to the bound.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.size = np.fromiter(map(len, self.sets), np.int64, len(sets))
        ids = np.unique(np.concatenate(self.sets), return_inverse=True)[1] if len(sets) else np.empty(0, np.int64)
        self.n_ids = int(ids.max()) + 1 if len(ids) else 0
        self.ids = np.split(ids, np.cumsum(self.size)[:-1]) if len(sets) else []
        common = [0]
        for x, y in zip(self.ids, self.ids[1:]):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            common.append(int(differ[0]) if len(differ) else m)
        self._build(np.array(common))

    def _build(self, common: np.ndarray) -> None:
        queue = [(0, len(self.sets), 0)]  # sets lo to hi share their first `depth` tokens
        rows, edges, starts, at = [], [], [0], 0
        i = 0
        while i < len(queue):
            lo, hi, depth = queue[i]
            end = len(self.ids[lo]) if hi - lo == 1 else int(common[lo + 1 : hi].min())
            edge = self.ids[lo][depth:end]
            children = 0
            first = len(queue)
            if hi - lo > 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == end)).tolist(), hi]
                queue += [(a, b, end) for a, b in zip(cuts, cuts[1:])]
                children = len(cuts) - 1
            span = self.size[lo:hi]
            rows.append((lo, hi, end, int(self.ids[lo][end - 1]) if end else -1, int(span.min()), int(span.max()), first, children))
            edges.append(edge)
            at += len(edge)
            starts.append(at)
            i += 1
        self.lo, self.hi, self.depth, self.last, self.shortest, self.longest, self.first, self.children = np.array(rows, np.int64).T
        self.edge, self.start = np.concatenate(edges), np.array(starts)

    def linked(self, q: np.ndarray, live: np.ndarray, bound: tuple[int, int]) -> np.ndarray:
        """Live sets (by place in the tree) whose overlap I with the set q has top * I >= low * (sum of sizes).

        q: sorted ids; those from n_ids on stand for members that no set of the tree has.
        """
        top, low = bound
        flag = np.zeros(self.n_ids, np.int64)
        flag[q[: np.searchsorted(q, self.n_ids)]] = 1
        alive = np.concatenate([[0], np.cumsum(live)])
        node, over, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(node):
            keep = alive[self.hi[node]] > alive[self.lo[node]]
            node, over = node[keep], over[keep]
            width = self.start[node + 1] - self.start[node]
            ends = np.cumsum(width)
            take = np.arange(int(width.sum())) + np.repeat(self.start[node] - (ends - width), width)
            sums = np.concatenate([[0], np.cumsum(flag[self.edge[take]])])
            over = over + sums[ends] - sums[ends - width]
            rest = len(q) - np.searchsorted(q, self.last[node], side="right")
            length = np.clip(self.depth[node] + rest, self.shortest[node], self.longest[node])
            most = over + np.minimum(rest, length - self.depth[node])
            keep = top * most >= low * (len(q) + length)
            node, over = node[keep], over[keep]
            leaf = self.children[node] == 0
            found.append(self.lo[node[leaf]])
            node, over = node[~leaf], over[~leaf]
            count = self.children[node]
            ends = np.cumsum(count)
            node = np.arange(int(count.sum())) + np.repeat(self.first[node] - (ends - count), count)
            over = np.repeat(over, count)
        return np.concatenate(found) if found else np.empty(0, np.int64)


def join(sets: list[np.ndarray], bound: tuple[int, int]) -> np.ndarray:
    """The group of each set: sets are in one group if a chain of links leads from one to the other.

    Each set queries the tree for links to sets before it that are not in its group already, so a large group of
    near copies costs a look at each member, not at each pair.
    """
    tree = Trie(sets)
    group = np.arange(len(sets))
    for i in range(1, len(sets)):
        live = group != group[i]
        live[i:] = False
        if live.any():
            for j in tree.linked(tree.ids[i], live, bound):
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
    out = np.empty(len(sets), np.int64)
    out[tree.order] = group
    return out
