"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import itertools


def components(n: int, pairs) -> list[int]:
    """The smallest index reachable from each index."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def edits(a: str, b: str) -> int:
    """Edit distance by the usual table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def without_copied_lines(docs: list[tuple], normalise, min_chars: int, min_equal: int) -> list[str | None]:
    """Texts of (id, text) rows without the lines that an earlier line copies; ids are distinct."""
    lines = []
    for i, (d, text) in enumerate(docs):
        for j, line in enumerate((text or "").split("\n")):
            if len(x := normalise(line)) >= min_equal:
                lines.append((d is None, d or 0, i, j, x))
    first: dict[str, tuple] = {}
    for o in sorted(lines):
        first.setdefault(o[4], o)
    near = set()
    for a, b in itertools.combinations(sorted(first.values()), 2):
        if min(len(a[4]), len(b[4])) >= min_chars and abs(len(a[4]) - len(b[4])) <= 1 and edits(a[4], b[4]) <= 1:
            near.add(b[4])
    gone = {(o[2], o[3]) for o in lines if o[4] in near or first[o[4]] != o}
    return [None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, (_, t) in enumerate(docs)]


def auc(scores, labels) -> float:
    good = [s for s, y in zip(scores, labels, strict=True) if y == 1]
    bad = [s for s, y in zip(scores, labels, strict=True) if y == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / max(1, len(good) * len(bad))
