"""Planar kernels in numpy: noding and faces of the segments of a tile, chaining of edges into rings, polygon tests.

Coordinates are whole numbers of UNIT metres, in 64 bits. Vertices are even numbers and tile seams odd ones, so no vertex lies on a
seam; crossings are rounded to even numbers again. On which side of a line a point lies is told in whole numbers, which is exact
for extents up to 2^30 units (1,000 km).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNIT = 1 / 1024

Rings = list[list[np.ndarray]]


def to_units(geometry: list) -> Rings:
    """Parts and rings as arrays of even units."""
    return [[_even(np.array([[p["x"], p["y"]] for p in ring], float) / UNIT) for ring in part if len(ring) > 3] for part in geometry or []]


def polygon_segments(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Segments of all rings of a column of polygons and the row of each, without a Python object per vertex."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = column.flatten()
    rings = parts.flatten()
    points = rings.flatten()
    length = size(rings)
    row = np.repeat(np.repeat(np.arange(len(column)), size(column)), size(parts))
    xy = np.column_stack([_even(pc.struct_field(points, c).to_numpy(zero_copy_only=False) / UNIT) for c in "xy"]).reshape(-1, 2)
    ring = np.repeat(np.arange(len(length)), length)
    own = np.flatnonzero((ring[1:] == ring[:-1]) & (length[ring[1:]] > 3)) if len(ring) else np.zeros(0, np.int64)
    return np.hstack([xy[own], xy[own + 1]]), row[ring[own]]


def areas(column: pa.Array) -> np.ndarray:
    """Shells less holes of a column of polygons, whatever their direction."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = column.flatten()
    rings = parts.flatten()
    points = rings.flatten()
    length, count = size(rings), size(parts)
    xy = np.column_stack([pc.struct_field(points, c).to_numpy(zero_copy_only=False) for c in "xy"]).reshape(-1, 2)
    ring = np.repeat(np.arange(len(length)), length)
    xy = xy - xy[np.repeat(np.cumsum(length) - length, length)] if len(xy) else xy
    cross = xy[:-1, 0] * xy[1:, 1] - xy[1:, 0] * xy[:-1, 1]
    own = ring[1:] == ring[:-1]
    area = np.abs(np.bincount(ring[:-1][own], cross[own] / 2, len(length))) * (length > 3)
    first = (np.cumsum(count) - count)[count > 0]
    sign = np.full(len(length), -1.0)
    sign[first] = 1.0
    return np.bincount(np.repeat(np.repeat(np.arange(len(column)), size(column)), count), sign * area, len(column)).astype(float)


def first_vertices(column: pa.Array) -> np.ndarray:
    """The least vertex, by x and then y, of each of a column of polygons; nan where there is none."""
    out = np.full((len(column), 2), np.nan)
    parts = column.flatten()
    rings = parts.flatten()
    points = rings.flatten()
    size = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.repeat(np.repeat(np.arange(len(column)), size(column)), size(parts)), size(rings))
    x, y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False) for c in "xy")
    order = np.lexsort((y, x, row))
    names, at = np.unique(row[order], return_index=True)
    out[names, 0], out[names, 1] = x[order][at], y[order][at]
    return out


def each(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lo, lo + 1 ... hi of every row (none where hi is less), and the row of each."""
    count = np.maximum(hi - lo + 1, 0)
    row = np.repeat(np.arange(len(lo)), count)
    return lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count), row


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it hangs together with over the links a, b."""
    label = np.arange(n)
    while True:
        p, q = label[a], label[b]
        low, high = np.minimum(p, q), np.maximum(p, q)
        apart = low < high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump


def tile_rows(seg: np.ndarray, owner: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tiles that segments may meet (column, row, which segment), by bands of rows, in each the columns that the segment has there;
    and tiles whose lower left corner is inside a polygon (column, row, owner). All segments of an owner must be given."""
    low, high = np.minimum(seg[:, :2], seg[:, 2:]), np.maximum(seg[:, :2], seg[:, 2:])
    cell = lambda v: (v - 1) // side
    ty, of = each(cell(low[:, 1]), cell(high[:, 1]))
    ax, ay, bx, by = seg[of].T
    slope = np.divide(bx - ax, by - ay, out=np.zeros(len(of)), where=by != ay)
    near, far = (ax + (np.clip(row * side + 1, low[of, 1], high[of, 1]) - ay) * slope for row in (ty, ty + 1))
    flat = ay == by
    left = np.where(flat, low[of, 0], np.maximum(np.floor(np.minimum(near, far)).astype(np.int64) - 4, low[of, 0]))
    right = np.where(flat, high[of, 0], np.minimum(np.ceil(np.maximum(near, far)).astype(np.int64) + 4, high[of, 0]))
    tx, k = each(cell(left), cell(right))
    # corners: a polygon's crossings of the lower seam of a row change that for all columns from there on
    row, which = each(cell(low[:, 1]) + 1, cell(high[:, 1]))
    at = cell(on_row(seg[which], row * side + 1)) + 1 if len(row) else row
    order = np.lexsort((at, row, owner[which]))
    at, row, name = at[order], row[order], owner[which][order]
    new = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (row[1:] != row[:-1]))) if len(at) else np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
    begin = np.flatnonzero(place % 2 == 0)
    begin = begin[(begin + 1 < len(at)) & (place[np.minimum(begin + 1, len(at) - 1)] == place[begin] + 1)]
    inner, m = each(at[begin], at[np.minimum(begin + 1, max(len(at) - 1, 0))] - 1 if len(begin) else begin)
    return tx, ty[k], of[k], inner, row[begin][m], name[begin][m]


def ring_segments(rings: Rings) -> np.ndarray:
    parts = [np.hstack([r[:-1], r[1:]]) for part in rings for r in part]
    return np.vstack(parts) if parts else np.zeros((0, 4), np.int64)


def _even(v: np.ndarray) -> np.ndarray:
    return 2 * np.rint(v / 2).astype(np.int64)


def _side(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Above 0 where p is left of the line from a to b, 0 on it."""
    return (b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0])


def crossing_rows(seg: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Rows whose segments meet elsewhere than in common end points, or stand twice. Pairs come from a sweep over x within each
    row, a bounded number at a time."""
    seg, row = seg[keep := (seg[:, :2] != seg[:, 2:]).any(axis=1)], row[keep]
    if not len(seg):
        return np.zeros(0, np.int64)
    base = seg[:, [0, 2]].min()
    low, high = seg[:, [0, 2]].min(axis=1) - base, seg[:, [0, 2]].max(axis=1) - base
    order = np.lexsort((low, row))
    seg, row = seg[order], row[order]
    _, place = np.unique(row, return_inverse=True)
    step = int(high.max()) + 1  # rows lie one after the other on one line
    lo, hi = low[order] + place * step, high[order] + place * step
    n = np.searchsorted(lo, hi, side="right") - np.arange(len(seg)) - 1
    ends, out, at = np.cumsum(n), [], 0
    while at < len(seg):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        some = n[at:to]
        i = np.repeat(np.arange(at, to), some)
        j = i + 1 + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        p, q = seg[i], seg[j]
        near = (np.minimum(p[:, 1], p[:, 3]) <= np.maximum(q[:, 1], q[:, 3])) & (np.minimum(q[:, 1], q[:, 3]) <= np.maximum(p[:, 1], p[:, 3]))
        i, p, q = i[near], p[near], q[near]
        a, b, c, d = p[:, :2], p[:, 2:], q[:, :2], q[:, 2:]
        s = [np.sign(v) for v in (_side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b))]
        bad = (s[0] * s[1] < 0) & (s[2] * s[3] < 0)
        for zero, (u, v), w in ((s[0], (a, b), c), (s[1], (a, b), d), (s[2], (c, d), a), (s[3], (c, d), b)):
            bad |= (zero == 0) & (((w - u) * (v - w)).sum(axis=1) > 0)
        bad |= ((a == c).all(axis=1) & (b == d).all(axis=1)) | ((a == d).all(axis=1) & (b == c).all(axis=1))
        out.append(row[i[bad]])
        at = to
    return np.unique(np.concatenate(out))


def taken_apart(seg: np.ndarray, row: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """For each of n rows the directed edges around the area that its segments cover by the even-odd rule, as ring_columns takes them,
    and whether noding changed its segments. Rows are laid side by side and noded together, a bounded number at a time; row: in
    order."""
    out, edges = np.zeros(n, bool), [(np.zeros((0, 4), np.int64), np.zeros(0, np.int64))]
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    names, count = row[begin], np.diff(np.append(begin, len(row)))
    low = np.minimum.reduceat(np.minimum(seg[:, :2], seg[:, 2:]), begin, axis=0) if len(row) else np.zeros((0, 2), np.int64)
    width = np.maximum.reduceat(np.maximum(seg[:, 0], seg[:, 2]), begin) - low[:, 0] + 4 if len(row) else np.zeros(0, np.int64)
    part = np.stack([np.cumsum(width) >> 29, np.cumsum(count) >> 16])
    cuts = np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0)) + 1
    for k, m in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
        if k == m:
            continue
        first, size = begin[k], count[k:m]
        place = np.cumsum(width[k:m]) - width[k:m]
        shift = np.column_stack([place, np.zeros_like(place)]) - low[k:m]
        of = np.repeat(np.arange(m - k), size)
        own = seg[first : first + size.sum()] + np.tile(shift[of], 2)
        noded = node(own)
        where = lambda x: np.searchsorted(place, x, side="right") - 1  # noqa: B023, E731
        out[names[k:m]] = np.bincount(where(noded[:, 0]), minlength=m - k) != size
        sides, stops, points = face_arrays(noded)
        home = where(points[:, 0])
        faces, start, at = size[home], np.cumsum(size) - size, 0
        ends, inside = np.cumsum(faces), np.zeros(len(home), bool)
        while at < len(home):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            f = np.repeat(np.arange(at, to), faces[at:to])
            s = own[start[home[f]] + np.arange(len(f)) - np.repeat(np.cumsum(faces[at:to]) - faces[at:to], faces[at:to])]
            px, py = points[f].T
            up = (s[:, 1] > py) != (s[:, 3] > py)
            x = s[up, 0] + (py[up] - s[up, 1]) * (s[up, 2] - s[up, 0]) / (s[up, 3] - s[up, 1])
            inside[at:to] = np.bincount(f[up][x > px[up]] - at, minlength=to - at) % 2 == 1
            at = to
        kept = np.repeat(inside, np.diff(stops))
        of = np.repeat(home, np.diff(stops))[kept]
        edges.append((sides[kept] - np.tile(shift[of], 2), names[k:m][of]))
    every, of = np.vstack([e for e, _ in edges]), np.concatenate([o for _, o in edges])
    order = np.argsort(of, kind="stable")
    rows = pa.StructArray.from_arrays([pa.array(c.astype(float)) for c in every[order].T], ["ax", "ay", "bx", "by"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[order], np.arange(n + 1)).astype(np.int32)), rows), out


def on_row(seg: np.ndarray, y: int | np.ndarray) -> np.ndarray:
    """Where segments that cross a horizontal seam do so: even, a middle goes right."""
    up = seg[:, 1] < seg[:, 3]
    px, py, qx, qy = np.where(up[:, None], seg, seg[:, [2, 3, 0, 1]]).T
    return px + 2 * (((y - py) * (qx - px) + qy - py) // (2 * (qy - py)))


def on_column(seg: np.ndarray, x: int) -> np.ndarray:
    """Where segments that cross a vertical seam do so: even; a middle goes down where the segment rises to the right, else up, so that
    a segment through a corner of seams passes it on one side only."""
    right = seg[:, 0] < seg[:, 2]
    px, py, qx, qy = np.where(right[:, None], seg, seg[:, [2, 3, 0, 1]]).T
    n, d = (x - px) * (qy - py), qx - px
    return py + 2 * np.where(qy > py, -((d - n) // (2 * d)), (n + d) // (2 * d))


def clip(seg: np.ndarray, box: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of segments inside a box with odd sides, which segment each is of, and the points where they cross its sides.

    A piece has two ends: end points of its segment inside the box, and crossings of its sides. Which crossing of a line is on the
    box is told after rounding, the same way from either side of a seam.
    """
    x0, y0, x1, y1 = box
    near = np.flatnonzero((np.minimum(seg[:, 0], seg[:, 2]) < x1) & (np.maximum(seg[:, 0], seg[:, 2]) > x0) & (np.minimum(seg[:, 1], seg[:, 3]) < y1) & (np.maximum(seg[:, 1], seg[:, 3]) > y0))
    own = seg[near]
    of, points, border = [], [], []
    for end in (own[:, :2], own[:, 2:]):
        k = np.flatnonzero((end[:, 0] > x0) & (end[:, 0] < x1) & (end[:, 1] > y0) & (end[:, 1] < y1))
        of.append(k)
        points.append(end[k])
        border.append(np.zeros(len(k), bool))
    for at, other, find, lo, hi in ((0, 1, on_column, y0, y1), (1, 0, on_row, x0, x1)):
        for line in (box[at], box[at + 2]):
            k = np.flatnonzero((own[:, at] < line) != (own[:, at + 2] < line))
            v = find(own[k], line)
            k, v = k[inside := (v > lo) & (v < hi)], v[inside]
            p = np.empty((len(k), 2), np.int64)
            p[:, at], p[:, other] = line, v
            of.append(k)
            points.append(p)
            border.append(np.ones(len(k), bool))
    of_, points_, border_ = np.concatenate(of), np.vstack(points), np.concatenate(border)
    order = np.argsort(of_, kind="stable")
    of_, points_, border_ = of_[order], points_[order], border_[order]
    if len(of_) % 2 or (of_[0::2] != of_[1::2]).any():
        raise ArithmeticError("a segment leaves a tile without entering it")
    return np.hstack([points_[0::2], points_[1::2]]), near[of_[0::2]], points_[border_]


def frame(box: tuple[float, float, float, float], points: np.ndarray, stops_x: np.ndarray, stops_y: np.ndarray) -> np.ndarray:
    """Sides of a box, split at points on them and at stops (where a finer neighbour has corners)."""
    x0, y0, x1, y1 = box
    out = []
    for x in (x0, x1):
        ys = np.unique(np.concatenate([[y0, y1], stops_y[(stops_y > y0) & (stops_y < y1)], points[points[:, 0] == x, 1]]))
        out.append(np.column_stack([np.full(len(ys) - 1, x), ys[:-1], np.full(len(ys) - 1, x), ys[1:]]))
    for y in (y0, y1):
        xs = np.unique(np.concatenate([[x0, x1], stops_x[(stops_x > x0) & (stops_x < x1)], points[points[:, 1] == y, 0]]))
        out.append(np.column_stack([xs[:-1], np.full(len(xs) - 1, y), xs[1:], np.full(len(xs) - 1, y)]))
    return np.vstack(out)


def _distinct(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments each once, from the lesser end to the greater, and which of them every given one is; -1 where its ends are equal."""
    swap = (seg[:, 0] > seg[:, 2]) | ((seg[:, 0] == seg[:, 2]) & (seg[:, 1] > seg[:, 3]))
    seg = np.where(swap[:, None], seg[:, [2, 3, 0, 1]], seg)
    real = (seg[:, :2] != seg[:, 2:]).any(axis=1)
    which = np.full(len(seg), -1)
    own = seg[real]
    if not len(own):
        return own, which
    order = np.lexsort(own.T[::-1])
    new = np.append(True, (own[order][1:] != own[order][:-1]).any(axis=1))
    number = np.empty(len(own), np.int64)
    number[order] = np.cumsum(new) - 1
    which[real] = number
    return own[order][new], which


def _pairs(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose boxes touch, each once, by a sweep over x within bands of y. A pair counts in the band where the upper of the two
    begins."""
    lo, hi = np.minimum(seg[:, :2], seg[:, 2:]), np.maximum(seg[:, :2], seg[:, 2:])
    if not len(seg):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base, top = lo.min(axis=0), hi.max(axis=0)
    height = max(int((top[1] - base[1]) / np.sqrt(len(seg))), 2 * int((hi[:, 1] - lo[:, 1]).mean()), 1)
    first, last = ((v[:, 1] - base[1]).astype(np.int64) // height for v in (lo, hi))
    count = last - first + 1
    s = np.repeat(np.arange(len(seg)), count)
    band = first[s] + np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
    begin = band * int(top[0] - base[0] + 1) + lo[s, 0] - base[0]
    order = np.argsort(begin, kind="stable")
    s, band, begin = s[order], band[order], begin[order]
    n = np.searchsorted(begin, begin + hi[s, 0] - lo[s, 0], side="right") - np.arange(len(s)) - 1
    n = np.minimum(n, np.searchsorted(band, band, side="right") - np.arange(len(s)) - 1)
    ends, out, at = np.cumsum(n), [], 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        some = n[at:to]
        i = np.repeat(np.arange(at, to), some)
        j = i + 1 + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        a, b = s[i], s[j]
        near = (np.maximum(first[a], first[b]) == band[i]) & (lo[a, 1] <= hi[b, 1]) & (lo[b, 1] <= hi[a, 1])
        out.append((a[near], b[near]))
        at = to
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def node(seg: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Segments that meet only in end points: split where they cross, touch or overlap. Rounding may ask for another round; an
    ArithmeticError if that does not end."""
    return node_owned(seg, np.zeros(len(seg), np.int64), rounds)[0]


def node_owned(seg: np.ndarray, owner: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with owners: numbers of segments and the owners that have each an odd number of times."""
    seg, which = _distinct(seg)
    which, owner = which[which >= 0], owner[which >= 0]
    for _ in range(rounds):
        i, j = _pairs(seg)
        p, r, q, s = seg[i, :2], seg[i, 2:] - seg[i, :2], seg[j, :2], seg[j, 2:] - seg[j, :2]
        cross = lambda a, b: a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
        rs, w = cross(r, s), q - p
        ts, us = cross(w, s), cross(w, r)
        sign = np.where(rs < 0, -1, 1)
        size, ts, us = rs * sign, ts * sign, us * sign
        hit = (rs != 0) & (ts >= 0) & (ts <= size) & (us >= 0) & (us <= size)
        x = _even(p[hit] + (ts[hit] / size[hit])[:, None] * r[hit])
        # a crossing of a horizontal and a vertical segment, and a touch in an end point, need no rounding
        exact = ((r[hit] == 0) & (s[hit][:, ::-1] == 0)).any(axis=1)
        # end points of the other segment stay as they are
        for own, at in ((us[hit] == 0, seg[j[hit], :2]), (us[hit] == size[hit], seg[j[hit], 2:]), (ts[hit] == 0, seg[i[hit], :2]), (ts[hit] == size[hit], seg[i[hit], 2:])):
            x[own] = at[own]
            exact |= own
        of, point = [i[hit], j[hit]], [x, x]
        line = (rs == 0) & (us == 0)
        for a, b in ((i[line], j[line]), (j[line], i[line])):
            for end in (seg[b, :2], seg[b, 2:]):
                d = seg[a, 2:] - seg[a, :2]
                k = ((end - seg[a, :2]) * d).sum(axis=1)
                inside = (k > 0) & (k < (d * d).sum(axis=1))
                of.append(a[inside])
                point.append(end[inside])
        of_, point_ = np.concatenate(of), np.vstack(point)
        new = ((point_ != seg[of_, :2]).any(axis=1)) & ((point_ != seg[of_, 2:]).any(axis=1))
        of_, point_ = of_[new], point_[new]
        if not len(of_):
            return seg, *_odd(which, owner)
        every = np.concatenate([np.arange(len(seg)), np.arange(len(seg)), of_])
        points = np.vstack([seg[:, :2], seg[:, 2:], point_])
        d = seg[every, 2:] - seg[every, :2]
        along = ((points - seg[every, :2]) * d).sum(axis=1)
        order = np.lexsort((along, every))
        every, points = every[order], points[order]
        same = every[1:] == every[:-1]
        old = every[:-1][same]  # in order
        seg, number = _distinct(np.hstack([points[:-1][same], points[1:][same]]))
        begin = np.searchsorted(old, which)
        count = np.searchsorted(old, which, side="right") - begin
        which = number[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]
        owner = np.repeat(owner, count)[which >= 0]
        which = which[which >= 0]
        if exact.all():
            return seg, *_odd(which, owner)
    raise ArithmeticError(f"{len(seg)} segments still cross after {rounds} rounds of noding")


def _odd(which: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that stand an odd number of times."""
    if not len(which):
        return which, owner
    order = np.lexsort((owner, which))
    which, owner = which[order], owner[order]
    first = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (owner[1:] != owner[:-1])))
    odd = first[np.diff(np.append(first, len(which))) % 2 == 1]
    return which[odd], owner[odd]


def _numbers(points: np.ndarray) -> np.ndarray:
    """The same number for equal points. Extents are below 2^31 units."""
    if not len(points):
        return np.zeros(0, np.int64)
    x, y = (points - points.min(axis=0)).astype(np.int64).T
    return np.unique((x << 31) + y, return_inverse=True)[1].reshape(-1)


def faces(seg: np.ndarray) -> list[dict]:
    """Bounded faces of noded segments: directed edges (face on the left; holes included), area in square units, a point inside."""
    edges, stops, points = face_arrays(seg)
    own = [(edges[i:j], tuple(p)) for i, j, p in zip(stops[:-1].tolist(), stops[1:].tolist(), points.tolist())]
    return [{"edges": e, "area": float(((e[:, 0] - p[0]) * (e[:, 3] - p[1]) - (e[:, 2] - p[0]) * (e[:, 1] - p[1])).sum() / 2), "point": p} for e, p in own]


def face_arrays(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same laid end to end: directed edges, where each face's begin (and the end), and a point inside each."""
    return arrangement(seg)[:3]


def arrangement(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As face_arrays, and the face on the left of every segment and then of every reversed segment, -1 where there is none."""
    none = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros((0, 2)), np.full(2 * len(seg), -1)
    if not len(seg):
        return none
    a = np.vstack([seg[:, :2], seg[:, 2:]])
    b = np.vstack([seg[:, 2:], seg[:, :2]])
    n = len(seg)
    ids = _numbers(np.vstack([a, b]))
    from_ = ids[: 2 * n]
    angle = np.arctan2(b[:, 1] - a[:, 1], b[:, 0] - a[:, 0])
    order = np.lexsort((angle, from_))
    place = np.empty(2 * n, int)
    place[order] = np.arange(2 * n)
    group = from_[order]
    first = np.searchsorted(group, group, side="left")
    size = np.searchsorted(group, group, side="right") - first
    twin = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    at = place[twin]
    nxt = order[first[at] + (at - first[at] - 1) % size[at]]
    label, jump = np.arange(2 * n), nxt.copy()
    for _ in range(int(np.ceil(np.log2(2 * n))) + 1):
        label = np.minimum(label, label[jump])
        jump = jump[jump]
    # cycles of edges: those with the area on their left are shells, the others bound a part from outside
    by_cycle = np.argsort(label, kind="stable")
    _, starts, cycle = np.unique(label[by_cycle], return_index=True, return_inverse=True)
    cycle = cycle.reshape(-1)
    stops = np.append(starts, 2 * n)
    a, b, from_ = a[by_cycle], b[by_cycle], from_[by_cycle]
    ra, rb = a - a[0], b - a[0]
    areas = np.add.reduceat((ra[:, 0] * rb[:, 1] - rb[:, 0] * ra[:, 1]) / 2, starts)
    shells = np.flatnonzero(areas > 0)
    if not len(shells):
        return none
    low, high = np.minimum.reduceat(a, starts, axis=0)[shells], np.maximum.reduceat(a, starts, axis=0)[shells]
    owner = np.full(len(starts), -1)
    owner[shells] = np.arange(len(shells))
    by_x = np.argsort(low[:, 0], kind="stable")
    reach = np.maximum.accumulate(high[by_x, 0])
    holes = np.flatnonzero(areas < 0)
    span = np.searchsorted(reach, a[starts[holes], 0]).tolist(), np.searchsorted(low[by_x, 0], a[starts[holes], 0], side="right").tolist()
    for k, i, j in zip(holes.tolist(), *span):
        p, v = a[starts[k]], from_[starts[k]]
        some = by_x[i:j]
        around = shells[some[(low[some] <= p).all(axis=1) & (high[some] >= p).all(axis=1) & (areas[shells[some]] > -areas[k])]]
        best = None
        for s in around.tolist():
            own = slice(stops[s], stops[s + 1])
            if (best is None or areas[s] < areas[best]) and not (from_[own] == v).any() and _inside(p, a[own], b[own]):
                best = s
        if best is not None:
            owner[k] = owner[best]
    face = owner[cycle]
    sides = np.empty(2 * n, np.int64)
    sides[by_cycle] = face
    kept = np.flatnonzero(face >= 0)
    kept = kept[np.argsort(face[kept], kind="stable")]
    edges, face = np.hstack([a[kept], b[kept]]), face[kept]
    stops = np.searchsorted(face, np.arange(len(shells) + 1))
    return edges, stops, inner_points(edges, face, len(shells)), sides


def carried_covers(sides: np.ndarray, n: int, start: int, marks: list[int], which: np.ndarray, owner: np.ndarray) -> list[frozenset]:
    """Owners that cover each of n faces: those of the start are known, and whoever owns a segment ends or begins at it.

    Every face is entered once, over one of its segments, from a face that is known already. The faces of a tile hang together, as
    its frame holds them all.
    """
    m = len(sides) // 2
    begin = np.searchsorted(which, np.arange(m + 1)).tolist()
    names = owner.tolist()
    left, right = sides[:m], sides[m:]
    inner = np.flatnonzero((left >= 0) & (right >= 0) & (left != right))
    ends = np.concatenate([left[inner], right[inner]])
    order = np.argsort(ends, kind="stable")
    to, over = np.concatenate([right[inner], left[inner]])[order].tolist(), np.concatenate([inner, inner])[order].tolist()
    first = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    covers: list[frozenset | None] = [None] * n
    covers[start] = frozenset(marks)
    todo = [start]
    while todo:
        face = todo.pop()
        own = covers[face]
        for k in range(first[face], first[face + 1]):
            if covers[to[k]] is None:
                s = over[k]
                covers[to[k]] = own.symmetric_difference(names[begin[s] : begin[s + 1]]) if begin[s] < begin[s + 1] else own
                todo.append(to[k])
    return covers


def inner_points(edges: np.ndarray, face: np.ndarray, n: int) -> np.ndarray:
    """For each of n faces the middle of the widest span on a line between its middle heights. face: in order."""
    order = np.lexsort((edges[:, 1], face))
    f, y = face[order], edges[order, 1]
    new = np.append(True, (f[1:] != f[:-1]) | (y[1:] != y[:-1]))
    f, y = f[new], y[new]
    begin = np.searchsorted(f, np.arange(n))
    count = np.searchsorted(f, np.arange(n), side="right") - begin
    k = begin + (count - 1) // 2
    line = (y[k] + y[np.minimum(k + 1, len(y) - 1)]) / 2
    own = line[face]
    up = (edges[:, 1] > own) != (edges[:, 3] > own)
    e, f, own = edges[up], face[up], own[up]
    x = e[:, 0] + (own - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    order = np.lexsort((x, f))
    x, f = x[order], f[order]
    left, right, f = x[0::2], x[1::2], f[0::2]  # a line crosses a face's edges an even number of times
    widest = np.lexsort((left - right, f))
    f_, at = np.unique(f[widest], return_index=True)
    out = np.full((n, 2), np.nan)
    out[f_, 0], out[f_, 1] = ((left + right) / 2)[widest][at], line[f_]
    return out


def inside_leaf(points: np.ndarray, seg: np.ndarray, owner: np.ndarray, corner: np.ndarray, at: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Points of a leaf and owners strictly around them, given which owners (corner, 0 or 1) are around the leaf's lower left corner.

    On the way from the corner along the lower side and then up to the point every segment that is crossed changes sides. Owners
    without a segment in the leaf cover all of its points or none. A bounded number of points and segments is tested at a time.
    """
    x0, y0 = at
    busy = np.unique(owner)
    whole = np.setdiff1d(np.flatnonzero(corner), busy)
    out = [np.repeat(np.arange(len(points)), len(whole))], [np.tile(whole, len(points))]
    if len(seg):
        order = np.argsort(points[:, 0], kind="stable")
        ax, ay, bx, by = seg.T
        left, right = np.minimum(ax, bx), np.maximum(ax, bx)
        low = np.flatnonzero((ay > y0) != (by > y0))
        cross = on_row(seg[low], y0)  # even, so never the corner itself
        low, cross = low[cross > x0], cross[cross > x0]
        start = np.intersect1d(np.flatnonzero(corner), busy)
        step, n = max(1, 4 * PAIRS // len(seg)), len(corner)
        for k in range(0, len(points), step):
            own = order[k : k + step]
            px, py = points[own].T
            # for each segment the points with an x that it has, in order of x
            p, s = each(np.searchsorted(px, left), np.searchsorted(px, right, side="right") - 1)
            x, y = px[p], py[p]
            with np.errstate(divide="ignore", invalid="ignore"):
                at_ = ay[s] + (x - ax[s]) * (by[s] - ay[s]) / (bx[s] - ax[s])
            up = ((ax[s] > x) != (bx[s] > x)) & (at_ > y0) & (at_ < y)
            on = ((bx[s] - ax[s]) * (y - ay[s]) == (by[s] - ay[s]) * (x - ax[s])) & (np.minimum(ay[s], by[s]) <= y) & (y <= np.maximum(ay[s], by[s]))
            q, t = each(np.searchsorted(px, cross), np.full(len(cross), len(own) - 1))
            turns = np.concatenate([p[up] * n + owner[s[up]], q * n + owner[low[t]], (np.arange(len(own))[:, None] * n + start).ravel()])
            pairs, times = np.unique(turns, return_counts=True)
            pairs = np.setdiff1d(pairs[times % 2 == 1], p[on] * n + owner[s[on]], assume_unique=False)
            out[0].append(own[pairs // n])
            out[1].append(pairs % n)
    return np.concatenate(out[0]), np.concatenate(out[1])


def _inside(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    x = a[up, 0] + (p[1] - a[up, 1]) * (b[up, 0] - a[up, 0]) / (b[up, 1] - a[up, 1])
    return bool((x > p[0]).sum() % 2)


def covers(points: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Which points are inside a polygon given by its segments (even-odd)."""
    a, b = seg[:, :2], seg[:, 2:]
    px, py = points[:, :1], points[:, 1:]
    up = (a[:, 1] > py) != (b[:, 1] > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[:, 0] + (py - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return (up & (x > px)).sum(axis=1) % 2 == 1


def chain(edges: np.ndarray) -> list[list[list[list[float]]]]:
    """Parts and rings of directed edges that bound an area on their left; at a shared vertex the sharpest left turn keeps rings apart."""
    out_of: dict[tuple, list[int]] = {}
    for i, e in enumerate(edges):
        out_of.setdefault((e[0], e[1]), []).append(i)
    used = np.zeros(len(edges), bool)
    rings = []
    for start in range(len(edges)):
        if used[start]:
            continue
        ring, i = [], start
        while not used[i]:
            used[i] = True
            ring.append((edges[i][0], edges[i][1]))
            options = [j for j in out_of.get((edges[i][2], edges[i][3]), []) if not used[j]]
            if not options:
                break
            if len(options) > 1:
                back = np.arctan2(edges[i][1] - edges[i][3], edges[i][0] - edges[i][2])
                turn = lambda j: (back - np.arctan2(edges[j][3] - edges[j][1], edges[j][2] - edges[j][0])) % (2 * np.pi)
                options.sort(key=turn)
            i = options[0]
        if len(ring) > 2:
            rings.append(np.array([*ring, ring[0]], float))
    area = [float(((r[:-1, 0] - r[0, 0]) * (r[1:, 1] - r[0, 1]) - (r[1:, 0] - r[0, 0]) * (r[:-1, 1] - r[0, 1])).sum() / 2) for r in rings]
    parts = [[r] for r, s in zip(rings, area) if s > 0]
    sizes = [s for s in area if s > 0]
    for r, s in zip(rings, area):
        if s < 0:
            # a point of the hole that is no vertex of the shell decides
            mid = (r[0] + r[1]) / 2
            homes = [k for k, p in enumerate(parts) if sizes[k] > -s and _inside(mid, p[0][:-1], p[0][1:])]
            if homes:
                parts[min(homes, key=lambda k: sizes[k])].append(r)
    return [[r.tolist() for r in p] for p in parts]


def ring_columns(edges: pa.Array) -> pa.Array:
    """For each list of directed edges (ax, ay, bx, by) that bound an area on their left: its parts and rings, as a column of polygons
    in metres. Edges that stand in both directions cancel. The rings of all rows are chained together, in arrays."""
    edges = edges.combine_chunks() if isinstance(edges, pa.ChunkedArray) else edges
    size = pc.fill_null(pc.list_value_length(edges), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = edges.flatten()
    e = np.column_stack([pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ax", "ay", "bx", "by")]).reshape(-1, 4)
    row = np.repeat(np.arange(len(edges)), size)
    e, row = e[real := (e[:, :2] != e[:, 2:]).any(axis=1)], row[real]
    # edges that stand in both directions
    swap = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    same = np.where(swap[:, None], e[:, [2, 3, 0, 1]], e)
    order = np.lexsort((*same.T, row))
    new = np.append(True, (same[order][1:] != same[order][:-1]).any(axis=1) | (row[order][1:] != row[order][:-1])) if len(e) else np.zeros(0, bool)
    net = np.add.reduceat(np.where(swap[order], -1, 1), np.flatnonzero(new)) if len(e) else np.zeros(0)
    kept = np.sort(order[np.flatnonzero(new)[net != 0]]) if len(e) else np.zeros(0, np.int64)
    e, row = e[kept], row[kept]
    n = len(e)
    # vertices are numbered within rows; leaving edges lie around each by their angle
    at_ = _numbers(np.vstack([e[:, :2], e[:, 2:]]))
    vertex = np.unique(np.tile(row, 2) * (at_.max(initial=0) + 1) + at_, return_inverse=True)[1].reshape(-1)
    d = (e[:, 2:] - e[:, :2]).astype(float)
    leave, back = np.arctan2(d[:, 1], d[:, 0]), np.arctan2(-d[:, 1], -d[:, 0])
    out_of = np.lexsort((leave, vertex[:n]))
    group = vertex[:n][out_of]
    first, last = np.searchsorted(group, vertex[n:]), np.searchsorted(group, vertex[n:], side="right")
    # the next edge is the first one met when turning right from the way back
    at = last - 1
    many = np.flatnonzero(last - first > 1)
    if len(many):
        around, angle = np.concatenate([vertex[n:][many], group]), np.concatenate([back[many], leave[out_of]])
        leaves = np.arange(len(around)) >= len(many)
        order = np.lexsort((leaves, angle, around))
        below = np.empty(len(around), np.int64)
        below[order] = np.cumsum(leaves[order])
        below = below[: len(many)] - first[many]
        at[many] = np.where(below > 0, first[many] + below - 1, last[many] - 1)
    if n and ((last == first).any() or len(np.unique(at)) != n):
        raise ArithmeticError("edges do not close to rings")
    following = out_of[at] if n else at
    # each ring begins at its first edge; the way there from every edge by doubling
    label, jump = np.arange(n), following.copy()
    while True:
        less = np.minimum(label, label[jump])
        if (less == label).all() and (less == less[following]).all():
            break
        label, jump = less, jump[jump]
    way, jump = (label != np.arange(n)).astype(np.int64), np.where(label == np.arange(n), np.arange(n), following)
    while (jump != label).any():
        way, jump = way + way[jump], jump[jump]
    length = np.bincount(label, minlength=n)
    place = (length[label] - way) % np.maximum(length[label], 1)
    order = np.lexsort((place, label))
    order = order[length[label[order]] > 2]
    v, ring, of = e[order, :2], label[order], row[order]
    begin = np.flatnonzero(np.append(True, ring[1:] != ring[:-1])) if len(ring) else np.zeros(0, np.int64)
    stop = np.append(begin[1:], len(ring)) if len(ring) else begin
    nxt = np.arange(1, len(ring) + 1)
    nxt[stop - 1] = begin
    base = v[np.repeat(begin, stop - begin)]
    p, q = v - base, v[nxt] - base
    area = np.add.reduceat(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], begin) if len(begin) else np.zeros(0)
    owner = of[begin]
    shell = np.where(area > 0, np.arange(len(begin)), -1)
    for h in np.flatnonzero(area < 0).tolist():
        mid = (v[begin[h]] + v[nxt[begin[h]]]) / 2  # no vertex of a shell
        lo, hi = np.searchsorted(owner, [owner[h], owner[h] + 1])
        homes = [k for k in range(lo, hi) if area[k] > -area[h] and _inside(mid, v[begin[k] : stop[k]], v[nxt[begin[k] : stop[k]]])]
        shell[h] = min(homes, key=lambda k: area[k]) if homes else -1
    rings = np.flatnonzero(shell >= 0)
    rings = rings[np.lexsort((rings != shell[rings], shell[rings], owner[rings]))]
    count = stop[rings] - begin[rings]
    step = np.arange((count + 1).sum()) - np.repeat(np.cumsum(count + 1) - count - 1, count + 1)
    xy = v[np.repeat(begin[rings], count + 1) + step % np.repeat(count, count + 1)] * UNIT if len(rings) else np.zeros((0, 2))
    offset = lambda counts: pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    lists = pa.ListArray.from_arrays(offset(stop[rings] - begin[rings] + 1), pa.StructArray.from_arrays([pa.array(c) for c in xy.T], ["x", "y"]))
    heads = np.flatnonzero(rings == shell[rings])
    parts = pa.ListArray.from_arrays(offset(np.diff(np.append(heads, len(rings)))), lists)
    return pa.ListArray.from_arrays(offset(np.bincount(owner[rings[heads]], minlength=len(edges))), parts)


#: Pairs of segments that are tested at a time.
PAIRS = 1 << 20


def intersects(p: Rings, q: Rings) -> bool:
    """Whether two polygons share a point. Segments are paired by a sweep over x, a bounded number of pairs at a time."""
    a, b = ring_segments(p), ring_segments(q)
    if not len(a) or not len(b):
        return False
    if covers(a[:1, :2], b).any() or covers(b[:1, :2], a).any():
        return True
    # rings whose first vertex is outside may still lie inside
    firsts = [np.array([r[0] for part in rings for r in part]) for rings in (p, q)]
    if covers(firsts[0], b).any() or covers(firsts[1], a).any():
        return True
    lo, hi = np.minimum(b[:, 0], b[:, 2]), np.maximum(b[:, 0], b[:, 2])
    order = np.argsort(lo, kind="stable")
    b, lo, hi = b[order], lo[order], hi[order]
    reach = np.maximum.accumulate(hi)
    start = np.searchsorted(reach, np.minimum(a[:, 0], a[:, 2]))
    n = np.maximum(np.searchsorted(lo, np.maximum(a[:, 0], a[:, 2]), side="right") - start, 0)
    ends = np.cumsum(n)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, side="right")))
        own = np.repeat(np.arange(i, j), n[i:j])
        other = np.repeat(start[i:j], n[i:j]) + np.arange(n[i:j].sum()) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
        if len(own) and _meet(a[own], b[other]).any():
            return True
        i = j
    return False


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which segments share a point with the one beside them."""
    d1, d2, w = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2], b[:, :2] - a[:, :2]
    cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    rs, x, y = cross(d1, d2), cross(w, d2), cross(w, d1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = x / rs, y / rs
    hit = (rs != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    k0, k1, n = (w * d1).sum(axis=1), ((w + d2) * d1).sum(axis=1), (d1 * d1).sum(axis=1)
    return hit | ((rs == 0) & (y == 0) & (np.maximum(k0, k1) >= 0) & (np.minimum(k0, k1) <= n))


def intersection(p: Rings, q: Rings) -> list:
    """Parts and rings, in units, of the area inside both polygons."""
    a, b = ring_segments(p), ring_segments(q)
    both = [f for f in faces(node(np.vstack([a, b]))) if covers(np.array([f["point"]]), a)[0] and covers(np.array([f["point"]]), b)[0]]
    return dissolve([f["edges"] for f in both])


def dissolve(edges: list[np.ndarray]) -> list:
    """Parts and rings of the union of faces that share whole edges."""
    if not edges:
        return []
    every = np.vstack(edges)
    seen = {tuple(e) for e in every.tolist()}
    outer = np.array([e for e in every.tolist() if (e[2], e[3], e[0], e[1]) not in seen])
    return chain(outer) if len(outer) else []
