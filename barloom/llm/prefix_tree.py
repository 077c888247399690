"""A tree of sorted key lists that finds overlapping sets and joins them up."""

from __future__ import annotations

from bisect import bisect_right


class _Node:
    __slots__ = ("seg", "kids", "ends", "low", "high", "roots")

    def __init__(self, seg):
        self.seg, self.kids, self.ends, self.low, self.high, self.roots = seg, {}, [], 1 << 62, 0, set()


class PrefixTree:
    """Sets under one shared key, held by common beginnings.

    A probe walks the tree once: the overlap with a node's keys is counted once for
    all sets below it, and a subtree is left as soon as the keys that remain on
    either side cannot bring the overlap to what the smallest set below needs.
    Lists may be beginnings of longer sets whose sizes are given: a hit is then a
    set that may link; with whole sets a hit is a link.

    `share`: percent of the union that must be shared. `key`: if given, only pairs
    whose first shared key this is are hits, so that each pair meets in one group.
    `merge`: hits join components, and sets of one component are not compared again.
    """

    def __init__(self, share: int, key: int | None = None, merge: bool = True):
        self.share, self.key, self.merge = share, key, merge
        self.top, self.parent, self.sets = _Node([]), {}, {}

    def find(self, x):
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def _need(self, a, b):
        return -(-self.share * (a + b) // (100 + self.share))

    def add(self, name, group, size, keys) -> list:
        """Names of earlier sets that this one hits, then it is put into the tree."""
        root = self.find(group)
        hits = self._probe(root, size, keys)
        self._insert(name, group, size, keys)
        return hits

    def _probe(self, root, size, keys):
        mine, last, hits = set(keys), keys[-1], []
        stack = [(self.top, 0, 0, 0)]
        while stack:
            node, met, depth, used = stack.pop()
            if len(node.roots) < 9:
                node.roots = {self.find(r) for r in node.roots}
                if node.roots == {self.find(root)}:
                    continue
            part, beyond = node.seg, False
            if part:
                if part[-1] > last:
                    part, beyond = part[:bisect_right(part, last)], True
                shared = mine.intersection(part)
                if shared:
                    if self.key is not None and min(shared) < self.key:
                        continue
                    met += len(shared)
                depth += len(part)
                used = len(keys) if beyond else bisect_right(keys, part[-1])
            if met + min(size - used, node.high - depth) < self._need(size, node.low):
                continue
            for name in self._below(node) if beyond else node.ends:
                group, other, length = self.sets[name]
                if self.find(group) != self.find(root) and met + min(
                        size - used, other - (depth if beyond else length)) >= self._need(size, other):
                    hits.append(name)
                    if self.merge:
                        self.parent[self.find(group)] = self.find(root)
            if not beyond:
                stack.extend((kid, met, depth, used) for kid in node.kids.values())
        return hits

    @staticmethod
    def _below(node):
        stack = [node]
        while stack:
            node = stack.pop()
            yield from node.ends
            stack.extend(node.kids.values())

    def _insert(self, name, group, size, keys):
        self.sets[name] = (group, size, len(keys))
        node, at = self.top, 0
        self._mark(node, group, size)
        while at < len(keys):
            kid = node.kids.get(keys[at])
            if kid is None:
                kid = node.kids[keys[at]] = _Node(keys[at:])
                self._mark(kid, group, size)
                node, at = kid, len(keys)
                break
            seg, same = kid.seg, 1
            most = min(len(seg), len(keys) - at)
            while same < most and seg[same] == keys[at + same]:
                same += 1
            if same < len(seg):
                upper = _Node(seg[:same])
                upper.low, upper.high, upper.roots = kid.low, kid.high, set(kid.roots)
                kid.seg = seg[same:]
                upper.kids[kid.seg[0]] = kid
                node.kids[seg[0]] = kid = upper
            self._mark(kid, group, size)
            node, at = kid, at + same
        node.ends.append(name)

    def _mark(self, node, group, size):
        node.low, node.high = min(node.low, size), max(node.high, size)
        if len(node.roots) < 9:
            node.roots.add(self.find(group))
