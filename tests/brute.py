"""Plain-Python counterparts of the graph operators, for small graphs."""

from itertools import product


def trails(edges, start, least, most, both=False):
    """All walks of ``least`` to ``most`` edges from ``start`` without a repeated edge: lists of edge numbers and ends."""
    out = []

    def go(at, used):
        if least <= len(used) <= most:
            out.append((tuple(used), at))
        if len(used) == most:
            return
        for n, (a, b) in enumerate(edges):
            if n in used:
                continue
            if a == at:
                go(b, [*used, n])
            if both and b == at and a != b:
                go(a, [*used, n])

    go(start, [])
    return out


def go_steps(edges, starts, first, last):
    """Edges leaving the set of reached vertices at each step."""
    here, rows = set(starts), []
    for k in range(1, last + 1):
        if k >= first:
            rows += [(k, n) for n, (a, _) in enumerate(edges) if a in here]
        here = {b for a, b in edges if a in here}
    return rows


def shortest(edges, sources, targets, most):
    """All shortest paths of each pair as vertex tuples and edge tuples."""
    out = []
    for s, t in product(sources, targets):
        if s == t:
            continue
        level = [((s,), ())]
        seen = {s}
        for _ in range(most):
            nxt = [((*v, b), (*e, n)) for v, e in level for n, (a, b) in enumerate(edges) if a == v[-1] and b not in seen]
            hit = [p for p in nxt if p[0][-1] == t]
            if hit:
                out += [(s, t, *p) for p in hit]
                break
            seen |= {p[0][-1] for p in nxt}
            level = nxt
    return out
