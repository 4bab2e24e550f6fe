"""Slow, obvious versions of the sequence operators, to test the window algebra against."""

from itertools import groupby

MOVING = ("walking", "driving", "train")


def trips(home: list[bool], work: list[bool]) -> list[str | None]:
    """Direction per point: look at each pair of neighbouring zone points."""
    out: list[str | None] = [None] * len(home)
    zone_points = [i for i in range(len(home)) if home[i] or work[i]]
    for p, q in zip(zone_points, zone_points[1:]):
        if q - p == 1:
            continue
        direction = ("morning" if work[q] else None) if home[p] else ("evening" if home[q] else None)
        for i in range(p + 1, q + 1):
            out[i] = direction
    return out


def smooth(modes: list[str]) -> list[str]:
    def vote(i: int) -> str:
        window = modes[i - 2 : i + 3]
        return max(window, key=lambda m: (window.count(m), -window.index(m)))

    n = len(modes)
    return [vote(i) if n > 5 and 2 <= i < n - 2 else modes[i] for i in range(n)]


def runs(modes: list[str], cuts: list[bool]) -> list[list[int]]:
    """Row numbers of each run."""
    ids, current = [], -1
    for i, m in enumerate(modes):
        if i == 0 or m != modes[i - 1] or cuts[i]:
            current += 1
        ids.append(current)
    return [[i for i, _ in rows] for _, rows in groupby(enumerate(ids), key=lambda pair: pair[1])]


def merge(modes: list[str], cuts: list[bool], deltas: list[float], minimum: float = 30.0) -> list[str]:
    out = list(modes)
    for k, rows in enumerate(runs(modes, cuts)):
        if k and sum(deltas[i] for i in rows) < minimum and not cuts[rows[0]]:
            for i in rows:
                out[i] = out[rows[0] - 1]
    return out


def waiting(modes: list[str]) -> list[str]:
    def nearest(indices) -> str | None:
        return next((modes[i] for i in indices if modes[i] in MOVING), None)

    n = len(modes)
    return [
        "waiting" if m == "stationary" and nearest(range(i, -1, -1)) != nearest(range(i, n)) else m
        for i, m in enumerate(modes)
    ]


def ids(modes: list[str]) -> list[int]:
    return [k for k, rows in enumerate(runs(modes, [False] * len(modes))) for _ in rows]
