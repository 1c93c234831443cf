"""Fixed offsets and lines of pixels within a window."""

from __future__ import annotations

#: The distinct pixel offsets (rows, columns) of eight angles at distances 1 and 2.
PAIR_OFFSETS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, 2), (1, 2), (2, 1), (2, 0), (2, -1), (1, -2)]


def line_places(r0: int, c0: int, r1: int, c1: int) -> list[tuple[int, int]]:
    """Pixels of a straight line with both ends, one for each step along its longer axis; the other coordinate is rounded, halves away from the start."""
    dr, dc = r1 - r0, c1 - c0
    n = max(abs(dr), abs(dc))
    along = lambda d, i: (1 if d > 0 else -1) * ((2 * abs(d) * i + n) // (2 * n))
    return [(r0 + along(dr, i), c0 + along(dc, i)) for i in range(n + 1)] if n else [(r0, c0)]


def rays(h: int, w: int, skip: int) -> list[list[tuple[int, int]]]:
    """Lines from the centre to every ``skip``-th border pixel: left, right, top and bottom side."""
    r, c = h // 2, w // 2
    ends = [(e, 0) for e in range(0, h, skip)] + [(e, w - 1) for e in range(0, h, skip)] + [(0, e) for e in range(0, w, skip)] + [(h - 1, e) for e in range(0, w, skip)]
    return [line_places(r, c, *end) for end in ends]
