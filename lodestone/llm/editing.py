"""Edit distance within a band, for strings and for lists of words."""

from __future__ import annotations

from collections.abc import Sequence


def edit_distance(a: Sequence, b: Sequence, most: int) -> int:
    """Edits between two strings or lists, or most + 1 if there are more: bit-parallel by columns, on the band
    of diagonals that `most` edits can reach. Common ends are cut off first."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    p, top = 0, len(b)
    while p < top and a[p] == b[p]:
        p += 1
    s = 0
    while s < top - p and a[-1 - s] == b[-1 - s]:
        s += 1
    a, b = a[p : len(a) - s], b[p : len(b) - s]
    if not b:
        return len(a)
    # Column j holds rows j - most .. j + most as a word of 2 * most + 1 bits. The score is followed
    # down the band's last diagonal, then along the last row, where it can fall once a column.
    limit, most = most, min(most, len(a))
    width = 2 * most + 1
    full = (1 << width) - 1
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    pv, mv, score = full << most & full, 0, most
    n, m = len(a), len(b)
    for j, c in enumerate(b):
        shift = j - most
        eq = places.get(c, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = ((((eq & pv) + pv) ^ pv) | eq | mv) & full
        hp = mv | ~(d0 | pv) & full
        hn = d0 & pv
        if j < n - most:
            score += 1 - (d0 >> 2 * most & 1)
            if score > limit + m - n + most:
                return limit + 1
        else:
            at = n + most - 1 - j
            score += (hp >> at & 1) - (hn >> at & 1)
        x = d0 >> 1
        pv, mv = (hn | ~(x | hp)) & full, hp & x
    return min(score, limit + 1)
