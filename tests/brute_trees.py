"""Candidates of a species tree built one by one and scored by every choice: what the sweep must equal."""

from itertools import product

from thicket.functions.trees import Tree, species_of


def candidates(s: Tree, redundant: bool = False) -> list[tuple[int, int]]:
    """(donor, target) pairs in order: a target is not strictly below its donor and, unless asked for, not its sister."""
    return [(h, t) for h in s.order for t in s.order if not (t != h and s.below(h, t)) and (redundant or s.sister(t) != h)]


def with_copy(s: Tree, h: int, t: int) -> tuple[Tree, list[dict[str, int]]]:
    """s with a copy of the clade h joined above t, and the leaf of each species in the original and in the copy."""
    out, where = Tree(), [{}, {}]

    def put(u: int, parent: int, copy: int, graft: bool) -> None:
        if graft and u == t:
            parent = out.add(parent, "<P*>")
        v = out.add(parent, s.name[u] + "*" * copy)
        if not s.children[u]:
            where[copy][s.name[u]] = v
        for c in s.children[u]:
            put(c, v, copy, graft)
        if graft and u == t:
            put(h, parent, 1, False)

    put(0, -1, 0, True)
    return out.index(), where


def cost(g: Tree, target: Tree, images: dict[int, int], w_dup: float = 1, w_loss: float = 1) -> tuple[float, int, int]:
    """(cost, duplications, losses) of g against target, given its leaves' images."""
    image, dups, losses = dict(images), 0, 0
    for u in g.by_post:
        if not g.children[u]:
            continue
        under = [image[c] for c in g.children[u]]
        m = under[0]
        for x in under[1:]:
            m = target.lca(m, x)
        image[u] = m
        dup = int(m in under)
        dups += dup
        losses += sum(max(0, target.depth[x] - target.depth[m] - 1 + dup) for x in under)
    losses += target.depth[image[0]]
    return w_dup * dups + w_loss * losses, dups, losses


def units(g: Tree, donor: set[str]) -> list[int]:
    """Roots of the clades of donor leaves that move as one: children's species sets are disjoint at the root."""
    species: dict[int, set] = {}
    roots: dict[int, list[int]] = {}
    for u in g.by_post:
        if not g.children[u]:
            species[u] = {species_of(g.name[u])}
            roots[u] = [u] if species[u] <= donor else []
            continue
        sets = [species[c] for c in g.children[u]]
        species[u] = set().union(*sets)
        together = species[u] <= donor and sum(map(len, sets)) == len(species[u])
        roots[u] = [u] if together else [r for c in g.children[u] for r in roots[c]]
    return roots[0]


def pinned(g: Tree, s: Tree, h: int, t: int, unit: int) -> int | None:
    """The copy that a unit's sister clade ties it to, if any: 0 the original, 1 the copy."""
    sister = g.sister(unit)
    near = {species_of(g.name[v]) for v in g.leaves(sister)} if sister is not None else set()
    if not near:
        return None
    own = s.sister(h)
    if own is not None and t != h and not s.below(own, t) and near <= {s.name[v] for v in s.leaves(own)}:
        return 0
    leaf = {s.name[v]: v for v in s.order if not s.children[v]}
    at = [leaf[x] for x in near]
    m = at[0]
    for x in at[1:]:
        m = s.lca(m, x)
    return 1 if not s.below(t, h) and s.below(t, m) else None


def score(g: Tree, s: Tree, pair: tuple[int, int] | None, w_dup: float = 1, w_loss: float = 1, most_free: int = 15, exact: bool = False) -> float | None:
    """Least cost of g against s, or against s with a copied clade; None if over most_free units are free.

    exact lets every donor leaf take its own copy.
    """
    if pair is None:
        leaf = {s.name[v]: v for v in s.order if not s.children[v]}
        return cost(g, s, {u: leaf[species_of(g.name[u])] for u in g.leaves(0)}, w_dup, w_loss)[0]
    h, t = pair
    target, where = with_copy(s, h, t)
    donor = {s.name[v] for v in s.leaves(h)}
    groups = [g.leaves(r) for r in units(g, donor)] if not exact else [[u] for u in g.leaves(0) if species_of(g.name[u]) in donor]
    choices = [[0, 1] if exact or (p := pinned(g, s, h, t, r)) is None else [p] for r in (units(g, donor) if not exact else groups)]
    if sum(len(c) > 1 for c in choices) > most_free:
        return None
    images = {u: where[0][species_of(g.name[u])] for u in g.leaves(0)}
    best = None
    for taken in product(*choices):
        for group, copy in zip(groups, taken):
            for u in group:
                images[u] = where[copy][species_of(g.name[u])]
        found = cost(g, target, images, w_dup, w_loss)[0]
        best = found if best is None or found < best else best
    return best
