"""One tree folded inside a task: classes of equal subtrees, what its network is like, its extended Newick, and the tree again;
and its clades against another tree's.

A tree is its leaves' names in order and its nodes' spans (first and last leaf) in preorder. A network is its root, the children of
each node with repeats, and the names of leaves.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .trees import read_newick

_TAG = re.compile("#.*$")


class Forms:
    """Numbers of subtrees' forms, the same for equal ones up to the order of children; they hold for a tree, or until fresh() drops them."""

    def __init__(self, most: int = 100_000):
        self.most, self.number, self.form = most, {}, []

    def fresh(self) -> "Forms":
        """Before a tree: drops what is known if that is much."""
        if len(self.form) > self.most:
            self.number, self.form = {}, []
        return self

    def classes(self, names, spans) -> list[int]:
        """The number of each node's form: a leaf's is its name, another node's its children's numbers, sorted."""
        number, form, below, found = self.number, self.form, [], [0] * len(spans)
        for i in range(len(spans) - 1, -1, -1):  # nodes come after all below them
            lo, hi = spans[i]
            kids = []
            while below and below[-1][0] <= hi:
                kids.append(below.pop()[1])
            kids.sort()
            own = names[lo] or "" if lo == hi else tuple(kids)
            c = number.get(own)
            if c is None:
                c = number[own] = len(form)
                form.append(own)
            below.append((lo, c))
            found[i] = c
        return found

    def into(self, found) -> dict[int, int]:
        """How often each class is a child in the network of a tree of these classes; the root's is not among them."""
        got: dict[int, int] = {}
        for c in set(found):
            if type(self.form[c]) is tuple:
                for k in self.form[c]:
                    got[k] = got.get(k, 0) + 1
        return got


def measures(forms: Forms, names, spans) -> tuple[int, int, int, int]:
    """(nodes, edges, reticulations, edges into those) of a tree's network."""
    found = forms.fresh().classes(names, spans)
    into = forms.into(found).values()
    many = [n for n in into if n > 1]
    return len(set(found)), sum(into), len(many), sum(many)


def below_reticulations(forms: Forms, names, spans) -> list[list[str]]:
    """The different names below each reticulation of a tree's network, sorted."""
    found = forms.fresh().classes(names, spans)
    many = {c for c, n in forms.into(found).items() if n > 1}
    at = {c: i for i, c in enumerate(found) if c in many}
    return sorted(sorted({x for x in names[spans[i][0] : spans[i][1] + 1] if x is not None}) for i in at.values())


def copies(forms: Forms, names, spans) -> list[tuple[int, int, int]]:
    """(first node, copies, leaves) of each lineage that folding merges, topmost equal subtrees alone; the root never folds."""
    found = forms.fresh().classes(names, spans)
    times: dict[int, int] = {}
    for c in found:
        times[c] = times.get(c, 0) + 1
    if len(times) == len(found):
        return []
    above, open_, got = False, [], {}
    for i, (lo, hi) in enumerate(spans):
        while open_ and open_[-1][0] < lo:
            open_.pop()
        above = open_[-1][1] if open_ else False  # whether the parent is a copy
        own = i > 0 and times[found[i]] > 1
        if own and not above:
            kept, n, m = got.get(found[i], (i, 0, 0))
            got[found[i]] = kept, n + 1, max(m, hi - lo + 1)
        open_.append((hi, own))
    return [x for x in got.values() if x[1] > 1]


def network(forms: Forms, names, spans) -> tuple:
    """(root, children, names) of a tree's network."""
    found = forms.classes(names, spans)
    own = set(found)
    return found[0], {c: forms.form[c] for c in own if type(forms.form[c]) is tuple}, {c: forms.form[c] for c in own if type(forms.form[c]) is str}


def text(root, kids: dict, name: dict) -> str:
    """A network in extended Newick: a reticulation's children are written where it is first met, as (...)#Hk, and #Hk stands for it elsewhere."""
    reached: dict = {}
    for below in kids.values():
        for x in below:
            reached[x] = reached.get(x, 0) + 1
    tags: dict = {}
    out, todo = [], [(root,)]  # a node in a tuple, or a sign
    while todo:
        at = todo.pop()
        if type(at) is str:
            out.append(at)
            continue
        (at,) = at
        if at in tags:
            out.append(tags[at])
            continue
        tag = tags.setdefault(at, f"#H{len(tags) + 1}") if reached.get(at, 0) > 1 else ""
        below = kids.get(at)
        if below:
            todo += [tag, ")"] + [x for c in reversed(below) for x in ((c,), ",")][:-1] + ["("]
        else:
            out.append(f"({name[at]}){tag}" if tag else name[at])
    return "".join(out) + ";"


def parsed(newick: str) -> tuple:
    """(root, children, names) of a network in extended Newick; a tag is what follows # in a name, and its places are one node."""
    tree = read_newick(newick)
    tags = [m and m.group() for m in map(_TAG.search, tree.name)]
    key = [tag or u for u, tag in enumerate(tags)]
    kids: dict = {}
    for u, below in enumerate(tree.children):
        if below:
            kids.setdefault(key[u], []).extend(key[c] for c in below)
    return key[0], kids, {u: tree.name[u] for u, below in enumerate(tree.children) if not below and not tags[u]}


def unfolded(root, kids: dict, name: dict) -> tuple[list[str], list[tuple[int, int]]]:
    """(names, spans) of the tree that a network stands for: every way from the root is a node. A node above one alone is left out."""
    names, spans, todo = [], [], [root]
    while todo:
        at = todo.pop()
        if type(at) is tuple:  # all below a node is there
            spans[at[0]] = spans[at[0]][0], len(names) - 1
            continue
        below = kids.get(at)
        if not below:
            spans.append((len(names), len(names)))
            names.append(name[at])
        elif len(below) == 1:
            todo.append(below[0])
        else:
            todo.append((len(spans),))
            spans.append((len(names), -1))
            todo += reversed(below)
    return names, spans


def comes_back(forms: Forms, names, spans) -> bool:
    """Whether a tree folded, written, read and unfolded is the same up to the order of children."""
    again = unfolded(*parsed(text(*network(forms.fresh(), names, spans))))
    return forms.classes(*again)[0] == forms.classes(names, spans)[0]


def clade_bits(names, nodes) -> tuple[dict, list[int]]:
    """(bit of each name, bits of each inner node's names) of a tree."""
    bit = {x: 1 << i for i, x in enumerate(names)}
    return bit, [(1 << hi + 1) - (1 << lo) for lo, hi in nodes if lo < hi]


def clade_distance(names, spans, bit: dict, whole: list[int]) -> int | None:
    """How many clades only one has of a tree and of another one, cut down to its names; none if a name comes twice or is not there."""
    before = [0]
    for x in names:
        b = bit.get(x)
        if b is None or before[-1] & b:
            return None
        before.append(before[-1] | b)
    all_ = before[-1]
    own = {before[hi + 1] ^ before[lo] for lo, hi in spans if lo < hi}
    return len(own ^ {x for w in whole if (x := w & all_) & x - 1})  # two names or more


@lru_cache(10_000)
def comb(n: int) -> tuple[tuple[int, int], ...]:
    """Spans of a caterpillar of n leaves."""
    return tuple((0, n - 1 - i) for i in range(n)) + tuple((i, i) for i in range(1, n))


@lru_cache(10_000)
def balanced(n: int) -> tuple[tuple[int, int], ...]:
    """Spans of the balanced tree of n leaves, as sources/corpus.py has it."""
    found = {(j << l, min((j + 1) << l, n) - 1) for l in range(n.bit_length() + 1) for j in range(((n - 1) >> l) + 1)}
    return tuple(sorted(found, key=lambda x: (x[0], -x[1])))
