"""Small rooted trees inside a task: one Newick string's nodes, copies of clades, and one reconciliation."""

from __future__ import annotations

import re

TOKEN = re.compile(r"\s*(?:([(),;])|('(?:[^']|'')*'|[^(),:;\[\]]+)|(:\s*[^(),;]+)|(\[[^\]]*\]))")


class Tree:
    """Nodes by number, parents before children; node 0 is the root."""

    def __init__(self):
        self.parent: list[int] = []
        self.children: list[list[int]] = []
        self.name: list[str] = []
        self.dist: list[float | None] = []

    def add(self, parent: int, name: str = "", dist: float | None = None) -> int:
        self.parent.append(parent)
        self.children.append([])
        self.name.append(name)
        self.dist.append(dist)
        if parent >= 0:
            self.children[parent].append(len(self.parent) - 1)
        return len(self.parent) - 1

    def index(self) -> "Tree":
        """Adds depth, tin, tout (preorder intervals), post and the order of leaves and then inner nodes by post."""
        n = len(self.parent)
        self.depth, self.tin, self.tout, self.post = [0] * n, [0] * n, [0] * n, [0] * n
        clock, done, stack = 0, 0, [(0, False)]
        while stack:
            u, seen = stack.pop()
            if seen:
                self.tout[u], self.post[u] = clock - 1, done
                done += 1
                continue
            self.depth[u] = self.depth[self.parent[u]] + 1 if u else 0
            self.tin[u] = clock
            clock += 1
            stack.append((u, True))
            stack += [(c, False) for c in reversed(self.children[u])]
        self.by_post = sorted(range(n), key=self.post.__getitem__)
        leaves = [u for u in self.by_post if not self.children[u]]
        self.order = leaves + [u for u in self.by_post if self.children[u]]
        return self

    def below(self, u: int, v: int) -> bool:
        """Whether v is u or below it."""
        return self.tin[u] <= self.tin[v] <= self.tout[u]

    def lca(self, u: int, v: int) -> int:
        while not self.below(u, v):
            u = self.parent[u]
        return u

    def leaves(self, u: int) -> list[int]:
        return [v for v in self.by_post if not self.children[v] and self.below(u, v)]

    def sister(self, u: int) -> int | None:
        return next((v for v in self.children[self.parent[u]] if v != u), None) if u else None


def parse_newick(text: str) -> Tree:
    """The tree of a Newick string, with its intervals; ValueError if it isn't one."""
    return read_newick(text).index()


def read_newick(text: str) -> Tree:
    """The same without index()."""
    text = text.strip()
    if not text.endswith(";"):
        text += ";"
    tree, at, place, closed = Tree(), -1, 0, False
    current = tree.add(-1)
    while True:
        m = TOKEN.match(text, place)
        if not m:
            raise ValueError("not Newick")
        place = m.end()
        sign, name, dist, _ = m.groups()
        if sign == "(":
            if tree.name[current] or tree.children[current]:
                raise ValueError("a name or clade before a bracket")
            at, current = current, tree.add(current)
        elif sign in (",", ")"):
            if at < 0:
                raise ValueError("brackets don't match")
            if not tree.name[current] and not tree.children[current]:
                raise ValueError("a leaf without a name")
            if sign == ",":
                current = tree.add(at)
            else:
                current, at = at, tree.parent[at]
        elif sign == ";":
            closed = True
            break
        elif name is not None:
            tree.name[current] = name.strip().strip("'")
        elif dist is not None:
            tree.dist[current] = float(dist[1:])
    if at >= 0 or not closed or text[place:].strip() or not (tree.name[0] or tree.children[0]):
        raise ValueError("brackets don't match")
    return tree


def species_of(name: str) -> str:
    return name.rsplit("_", 1)[-1]
