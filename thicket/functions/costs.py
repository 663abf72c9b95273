"""Cost vectors: what a gene tree costs under every target of a copied clade, for many choices at once, by cumulative sums.

A species tree is arrays in preorder, so what lies below a node is a run. With a donor clade and a choice of which gene leaves
take the copy, a gene node is on the copy (C), on the original (B) or across (X), and has an image: the lowest species node
above its leaves, of an X node above those on the original. The cost as a function of the target is a sum over gene nodes of
terms that begin and end at bounds of such runs. Each node leaves a few numbers at bounds in a matrix of a row for each choice
and a column for each target, and running sums along the rows give all targets.
"""

from __future__ import annotations

import numpy as np

C, B, X = 0, 1, 2
#: Species nodes and gene nodes of all cases that are costed at once; each takes some 150 bytes.
MOST = 400_000


class Species:
    """A species tree's nodes in preorder: lo and hi, the first and last leaf below, and depth; all inner nodes have two children."""

    def __init__(self, lo, hi, depth):
        self.lo, self.hi, self.depth = (np.asarray(x, np.int64) for x in (lo, hi, depth))
        self.end = np.searchsorted(self.lo, self.hi, side="right") - 1  # first leaves never fall in preorder
        self.leaf = np.flatnonzero(self.lo == self.hi)
        inner = np.flatnonzero(self.lo < self.hi)
        between = np.zeros(len(self.leaf), np.int64)
        between[self.hi[inner + 1]] = inner  # a left child follows its parent, and ends where the right one begins
        self.rows = [self.depth[between] * len(self.lo) + between]
        while 2 ** len(self.rows) < len(self.leaf):
            step, last = 2 ** (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last, np.concatenate([last[step:], last[len(last) - step :]])))
        self.by_end = np.argsort(self.end, kind="stable")
        self.ends, self.starts = np.unique(self.end[self.by_end], return_index=True)

    def lowest(self, first, last):
        """The lowest node above all leaves from first to last: the highest of those between two neighbours."""
        found = self.leaf[first].copy()
        wide = np.flatnonzero(first < last)
        if len(wide):
            a, b = first[wide], last[wide]
            k = np.log2(b - a).astype(np.int64)
            k += (1 << (k + 1)) <= b - a
            k -= (1 << k) > b - a
            table = np.stack(self.rows)
            found[wide] = np.minimum(table[k, a], table[k, b - (1 << k)]) % len(self.lo)
        return found

    def below(self, marks):
        """Sums of marks (rows, nodes) over what lies below each node."""
        total = np.concatenate([np.zeros((len(marks), 1), marks.dtype), np.cumsum(marks, axis=1)], axis=1)
        return total[:, self.end + 1] - total[:, :-1]

    def above(self, marks):
        """Sums of marks (rows, nodes) over each node and those above it, but the root."""
        steps = np.concatenate([marks, np.zeros((len(marks), 1), marks.dtype)], axis=1)
        steps[:, 0] = 0
        falls = np.add.reduceat(marks[:, self.by_end], self.starts, axis=1)
        falls[:, -1] = 0  # nothing is read past the last node
        steps[:, self.ends + 1] -= falls
        return np.cumsum(steps, axis=1)[:, :-1]


def parents(lo, hi, of):
    """Index of the parent of each node, -1 for roots, of trees one after the other (of: which), each in preorder."""
    found, stack, at = np.full(len(lo), -1, np.int64), [], None
    for i, (a, z, tree) in enumerate(zip(lo.tolist(), hi.tolist(), of.tolist())):
        if tree != at:
            stack, at = [], tree
        while stack and hi[stack[-1]] < a:
            stack.pop()
        if stack:
            found[i] = stack[-1]
        stack.append(i)
    return found


def ranges(lengths):
    """(owner, place) of each element of groups of these lengths."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def ends_of_runs(values, first, last, least: bool):
    """Least or greatest of values from first to last, for each two places."""
    pairs = np.stack([first, last + 1], axis=1).ravel()
    return (np.minimum if least else np.maximum).reduceat(np.append(values, values[-1:]), pairs)[::2]


class Trees:
    """Gene trees one after the other: pos, each leaf's species leaf; lo and hi, first and last leaf of each node in preorder."""

    def __init__(self, species: Species, pos, nodes):
        self.n_leaves, self.n_nodes = np.array([len(x) for x in pos]), np.array([len(x) for x in nodes])
        self.pos = np.concatenate([np.asarray(x, np.int64) for x in pos])
        self.leaf_at, self.node_at = np.cumsum(self.n_leaves) - self.n_leaves, np.cumsum(self.n_nodes) - self.n_nodes
        spans = np.concatenate([np.asarray(x, np.int64).reshape(-1, 2) for x in nodes])
        self.lo, self.hi, self.of = spans[:, 0], spans[:, 1], np.repeat(np.arange(len(nodes)), self.n_nodes)
        self.parent = parents(self.lo, self.hi, self.of) - self.node_at[self.of]  # within the tree; below 0 for its root
        at = self.leaf_at[self.of]
        self.image = species.lowest(ends_of_runs(self.pos, at + self.lo, at + self.hi, True), ends_of_runs(self.pos, at + self.lo, at + self.hi, False))


def vectors(s: Species, trees: Trees, tree, donor_depth, taken_case, taken_lo, taken_hi, w_dup: float, w_loss: float):
    """(costs, plain): for each case its cost under every target (cases, nodes), and without a copy.

    A case is a tree and a donor's depth; runs of its leaves (taken_case, taken_lo, taken_hi) are on the copy.
    """
    cases, n = len(tree), len(s.lo)
    owner, place = ranges(trees.n_leaves[tree])
    leaf_at = np.cumsum(trees.n_leaves[tree]) - trees.n_leaves[tree]
    step = np.zeros(len(owner) + 1, np.int64)
    np.add.at(step, leaf_at[taken_case] + taken_lo, 1)
    np.add.at(step, leaf_at[taken_case] + taken_hi + 1, -1)
    copied = np.cumsum(step[:-1]) > 0
    before = np.concatenate([[0], np.cumsum(copied)])
    pos = trees.pos[trees.leaf_at[tree][owner] + place]
    case, k = ranges(trees.n_nodes[tree])
    node = trees.node_at[tree][case] + k
    lo, hi = leaf_at[case] + trees.lo[node], leaf_at[case] + trees.hi[node]
    on_copy, size = before[hi + 1] - before[lo], hi - lo + 1
    kind = np.where(on_copy == 0, B, np.where(on_copy == size, C, X))
    image = trees.image[node]
    across = np.flatnonzero(kind == X)
    if len(across):
        # A leaf on the copy counts for neither end.
        far = len(s.leaf)
        image[across] = s.lowest(ends_of_runs(np.where(copied, far, pos), lo[across], hi[across], True), ends_of_runs(np.where(copied, -1, pos), lo[across], hi[across], False))
    node_at = np.cumsum(trees.n_nodes[tree]) - trees.n_nodes[tree]
    child = np.flatnonzero(trees.parent[node] >= 0)
    up = node_at[case[child]] + trees.parent[node[child]]
    has = lambda what: np.bincount(up, what, len(node)) > 0
    same, has_b, has_c = has(image[child] == image[up]), has(kind[child] == B), has(kind[child] == C)
    x_image = np.full(len(node), -1, np.int64)
    x_child = kind[child] == X
    x_image[up[x_child]] = image[child[x_child]]
    sign = np.where(size == 1, 1, -1)
    d = s.depth[image]
    total = lambda rows, what: np.bincount(case[rows], what, cases)
    c_rows, b_rows = kind == C, kind == B
    const = total(c_rows, (sign * (d - donor_depth[case]))[c_rows]) + total(b_rows, (sign * d)[b_rows]) - 2 * (trees.n_leaves[tree] - 1)
    on = total(c_rows, sign[c_rows])
    # Across, with one child whole: on the copy, only targets inside the image make it a duplication; on the original, all but
    # those on the side of the other child.
    c_b = np.flatnonzero((kind == X) & has_b & has_c)
    x_b = np.flatnonzero((kind == X) & has_b & ~has_c & ~same)
    always = np.where(kind == X, ~(has_b & has_c), same)
    dups = total(always, np.ones(int(always.sum())))
    steps = np.zeros((cases, n + 1))
    np.add.at(steps, (case[c_b], image[c_b] + 1), 1)
    np.add.at(steps, (case[c_b], s.end[image[c_b]] + 1), -1)
    left = image[x_b] + 1
    side = np.where(x_image[x_b] <= s.end[left], left, s.end[left] + 1)
    np.add.at(steps, (case[x_b], side), -1)
    np.add.at(steps, (case[x_b], s.end[side] + 1), 1)
    whole, met = np.zeros((cases, n)), np.zeros((cases, n))
    np.add.at(whole, (case[b_rows], image[b_rows]), sign[b_rows])
    np.add.at(met, (case[across], image[across]), 1)
    dup_cost = w_dup + 2 * w_loss
    costs = dup_cost * (dups[:, None] + np.cumsum(steps, axis=1)[:, :-1]) + w_loss * (const[:, None] + on[:, None] * (s.depth + 1) + s.below(whole) - s.above(s.below(met)))
    return costs, dup_cost * dups + w_loss * const


def sweep(s: Species, trees: Trees, weight, u_tree, u_donor, u_lo, u_hi, w_dup: float, w_loss: float, most: int = MOST):
    """(plain, by target, by donor and target): weighted sums of least costs over trees.

    Units (u_tree, u_donor, u_lo, u_hi) are ordered by tree, then donor. Of a donor that a tree has no unit for, the tree costs
    what it does with all leaves on the original; the last table has what other donors differ by. As many cases are costed at
    once as have `most` species nodes and gene nodes together, or one.
    """
    n = len(s.lo)
    each = np.arange(len(trees.n_leaves))
    none = np.zeros(0, np.int64)
    width = n + trees.n_nodes  # of a case
    ends = np.cumsum(width)
    plain, by_target, differs = 0.0, np.zeros(n), np.zeros((n, n))
    at = 0
    while at < len(each):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] - width[at] + most, side="right")))
        part, at = each[at:upto], upto
        costs, alone = vectors(s, trees, part, np.zeros(len(part), np.int64), none, none, none, w_dup, w_loss)
        by_target += weight[part] @ costs
        plain += float(weight[part] @ alone)
    if not len(u_tree):
        return plain, by_target, differs
    first = np.flatnonzero(np.concatenate([[True], (u_tree[1:] != u_tree[:-1]) | (u_donor[1:] != u_donor[:-1])]))
    k = np.diff(np.append(first, len(u_tree)))
    ends = np.cumsum(width[u_tree[first]] << k)
    at = 0
    while at < len(first):
        # As many groups as fit; the choices of one that is larger come in parts.
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        room = max(1, most // int(width[u_tree[first[at]]])) if upto == at + 1 else most
        least = None
        for begin in range(0, 1 << int(k[at]) if upto == at + 1 else 1, room):
            g, choice = ranges(np.minimum(1 << k[at:upto], begin + room) - begin)
            choice, g = choice + begin, g + at
            case, j = ranges(k[g])
            taken = (choice[case] >> j) & 1 == 1
            unit = first[g[case]] + j
            costs, _ = vectors(s, trees, u_tree[first[g]], s.depth[u_donor[first[g]]], case[taken], u_lo[unit[taken]], u_hi[unit[taken]], w_dup, w_loss)
            if begin == 0:
                zero = np.flatnonzero(choice == 0)  # nothing on the copy
                base = costs[zero]
            found = np.minimum.reduceat(costs, np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), axis=0)
            least = found if least is None else np.minimum(least, found)
        rows = first[at:upto]
        np.add.at(differs, u_donor[rows], weight[u_tree[rows]][:, None] * (least - base))
        at = upto
    return plain, by_target, differs


def best_choice(s: Species, tree: Trees, at: int, donor: int, target: int, lo, hi, w_dup: float, w_loss: float, most: int = MOST) -> tuple[float, list[int]]:
    """(cost, copy of each unit) of tree number `at` for one donor and target, units being its runs (lo, hi): of the cheapest choices the first in order of units."""
    k, lo, hi = len(lo), np.asarray(lo, np.int64), np.asarray(hi, np.int64)
    best, room = None, max(1, most // int(len(s.lo) + tree.n_nodes[at]))
    for begin in range(0, 1 << k, room):
        order = np.arange(begin, min(1 << k, begin + room))
        # The first unit is the highest digit, so that the first cheapest choice is the one wanted.
        taken = (order[:, None] >> np.arange(k)[::-1]) & 1 == 1
        case, unit = np.nonzero(taken)
        costs, _ = vectors(s, tree, np.full(len(order), at), np.full(len(order), s.depth[donor]), case, lo[unit], hi[unit], w_dup, w_loss)
        i = int(np.argmin(costs[:, target]))
        if best is None or costs[i, target] < best[0]:
            best = float(costs[i, target]), taken[i].astype(int).tolist()
    return best
