"""Tiles of the plane that hold about as many places each, and the nearest of a tile's places: helpers of ``joins.nearest``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Places that are compared with each point without a further cut, and points that they are compared with at once.
TOGETHER, AT_ONCE = 64, 1 << 14


def tree(places: np.ndarray, rows: np.ndarray, most: int) -> tuple:
    """(rows, lo, hi, axis, at, below, above): places (n, 2) halved across their longer side until at most ``most``, or equal ones, are together."""
    own = places[rows]
    lo, hi = own.min(axis=0), own.max(axis=0)
    axis = int(np.argmax(hi / 2 - lo / 2))
    along = own[:, axis]
    if len(rows) <= most or lo[axis] == hi[axis]:
        return rows, lo, hi, axis, None, None, None
    at = np.partition(along, len(along) // 2)[len(along) // 2]
    if at == lo[axis]:
        at = along[along > at].min()
    below = along < at
    return rows, lo, hi, axis, at, tree(places, rows[below], most), tree(places, rows[~below], most)


def number(node: tuple, points: np.ndarray, rows: np.ndarray, out: np.ndarray, first: int = 0) -> int:
    """Writes the number of each point's leaf into ``out``; the number that follows the node's last."""
    *_, axis, at, below, above = node
    if at is None:
        out[rows] = first
        return first + 1
    low = points[rows, axis] < at
    return number(above, points, rows[~low], out, number(below, points, rows[low], out, first))


def gap(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of points to a box; rounded, it is at most the distance to any place in it, as differences, squares and sums round in order."""
    off = np.maximum(np.maximum(lo - points, points - hi), 0.0)
    return off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1]


def reached(node: tuple, boxes: dict, points: np.ndarray, d2: np.ndarray, rows: np.ndarray, first: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) of the points that a leaf's box (lo, hi) may hold a nearer or as near place for; returns the number that follows the node's last."""
    *_, axis, at, below, above = node
    if at is None:
        if len(rows) and first in boxes:
            yield first, rows[gap(points[rows], *boxes[first]) <= d2[rows]]
        return first + 1
    off = points[rows, axis] - at
    near = off * off <= d2[rows]
    following = yield from reached(below, boxes, points, d2, rows[near | (off < 0)], first)
    return (yield from reached(above, boxes, points, d2, rows[near | (off >= 0)], following))


def closest(points: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, row) of the place nearest to each point, of equally near ones the first. Points go into the half they lie in, then into the other where it may hold one."""
    d2, best = np.full(len(points), np.inf), np.full(len(points), len(places))

    def visit(node: tuple, rows: np.ndarray) -> None:
        own, lo, hi, axis, at, below, above = node
        rows = rows[gap(points[rows], lo, hi) <= d2[rows]]
        if not len(rows):
            return
        if at is None:
            for i in range(0, len(rows), AT_ONCE):
                part = rows[i : i + AT_ONCE]
                dx, dy = points[part, 0][:, None] - places[own, 0], points[part, 1][:, None] - places[own, 1]
                far = dx * dx + dy * dy
                at_ = far.argmin(axis=1)  # the first of the least: ``own`` is in order
                least, row = far[np.arange(len(part)), at_], own[at_]
                wins = (least < d2[part]) | ((least == d2[part]) & (row < best[part]))
                d2[part[wins]], best[part[wins]] = least[wins], row[wins]
            return
        low = points[rows, axis] < at
        for side, first, then in ((rows[low], below, above), (rows[~low], above, below)):
            visit(first, side)
            visit(then, side)

    visit(tree(places, np.arange(len(places)), TOGETHER), np.arange(len(points)))
    return d2, best
