"""NumPy kernels over stacks of equal tiles (tile, row, column): blur, morphology, resize, components, contours."""

from __future__ import annotations

import math

import numpy as np

#: The binomial-like blur weights that stand for a kernel without an explicit sigma.
SMALL_BLURS = {
    1: [1.0],
    3: [0.25, 0.5, 0.25],
    5: [0.0625, 0.25, 0.375, 0.25, 0.0625],
    7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125],
}


def blur_weights(k: int) -> np.ndarray:
    if k in SMALL_BLURS:
        return np.array(SMALL_BLURS[k])
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(k) - (k - 1) / 2) ** 2) / (2 * sigma**2))
    return w / w.sum()


def blur(stack: np.ndarray, k: int) -> np.ndarray:
    """Separable Gaussian with replicated borders."""
    r, w = k // 2, blur_weights(k)
    out = stack.astype(np.float64)
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p = np.pad(out, pad, mode="edge")
        n = out.shape[axis]
        out = sum(w[i] * np.take(p, np.arange(i, i + n), axis=axis) for i in range(k))
    return out


def local_contrast(values: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Value less the mean of its valid surroundings, weighted by the blur; NaN where nothing supports it."""
    total, support = blur(np.where(valid, values, 0.0), k), blur(valid.astype(float), k)
    mean = np.divide(total, support, out=np.full(values.shape, np.nan), where=valid & (support > 1e-6))
    return np.where(valid, values - mean, np.nan)


def ellipse(k: int) -> np.ndarray:
    """The elliptical structuring element; for 3 a plus sign."""
    r = k // 2
    out = np.zeros((k, k), dtype=bool)
    for i in range(k):
        half = round(r * math.sqrt(max(0.0, 1 - ((i - r) / r) ** 2))) if r else 0
        out[i, r - half : r + half + 1] = True
    return out


def _reduce(mask: np.ndarray, k: int, erode: bool) -> np.ndarray:
    """What lies outside a tile neither erodes nor dilates it."""
    r, (h, w) = k // 2, mask.shape[1:]
    p = np.pad(mask, [(0, 0), (r, r), (r, r)], constant_values=erode)
    out = np.full(mask.shape, erode)
    for i, j in np.argwhere(ellipse(k)):
        part = p[:, i : i + h, j : j + w]
        out = out & part if erode else out | part
    return out


def open_close(mask: np.ndarray, k: int) -> np.ndarray:
    opened = _reduce(_reduce(mask, k, True), k, False)
    return _reduce(_reduce(opened, k, False), k, True)


def resize_weights(source: int, target: int, shrink: bool) -> np.ndarray:
    """Weights (target, source) along one axis: overlaps of areas if both axes shrink, else linear between pixel centres."""
    out = np.zeros((target, source))
    scale = source / target
    for t in range(target):
        if shrink:
            a, b = t * scale, (t + 1) * scale
            for s in range(int(a), min(source, math.ceil(b - 1e-9))):
                out[t, s] = (min(b, s + 1) - max(a, s)) / scale
        else:
            x = (t + 0.5) * scale - 0.5
            s = math.floor(x)
            f = x - s
            out[t, min(max(s, 0), source - 1)] += 1 - f
            out[t, min(max(s + 1, 0), source - 1)] += f
    return out


def resize(values: np.ndarray, valid: np.ndarray, shape: tuple[int, int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Resized values, weighted by validity, and which of them are invalid: supported by less than `least`."""
    if shape == values.shape[1:]:
        return np.where(valid, values, np.nan), ~valid
    shrink = shape[0] <= values.shape[1] and shape[1] <= values.shape[2]
    a, b = (resize_weights(values.shape[i + 1], shape[i], shrink) for i in (0, 1))
    over = lambda x: np.einsum("ts,nsc,uc->ntu", a, x, b)
    weight = np.clip(over(valid.astype(float)), 0, 1)
    out = np.divide(over(np.where(valid, values, 0.0)), weight, out=np.full(weight.shape, np.nan), where=weight > 0)
    invalid = (weight + 1e-6 < least) | ~np.isfinite(out)
    return np.where(invalid, np.nan, out), invalid


def stack_labels(masks: np.ndarray) -> np.ndarray:
    """8-connected components of each tile of a stack, numbered from 1 by their first pixel in raster order.

    Every pixel points to the least pixel around it, then to what that one points to, until nothing changes: all tiles at once, in about as many rounds as the logarithm of the longest way.
    """
    n, h, w = masks.shape
    place = np.arange(masks.size).reshape(masks.shape)
    none = masks.size
    point = np.where(masks, place, none)
    while masks.any():
        wide = np.full((n, h + 2, w + 2), none)
        wide[:, 1:-1, 1:-1] = point
        least = np.minimum(np.minimum(wide[:, :, :-2], wide[:, :, 1:-1]), wide[:, :, 2:])
        least = np.minimum(np.minimum(least[:, :-2], least[:, 1:-1]), least[:, 2:])
        new = np.where(masks, least, none)
        # what is pointed to takes the least of those that point to it, so a whole component follows its best member
        flat, old = np.append(new.ravel(), none), point.ravel()
        np.minimum.at(flat, old[masks.ravel()], new.ravel()[masks.ravel()])
        flat[none] = none
        new = np.where(masks, flat[flat[:none]].reshape(masks.shape), none)
        if (new == point).all():
            break
        point = new
    root = masks & (point == place)
    number = np.append(np.cumsum(root.reshape(n, -1), axis=1).ravel(), 0)
    return np.where(masks, number[point], 0).astype(np.int32)


def labels(mask: np.ndarray) -> np.ndarray:
    """Components of one tile."""
    return stack_labels(mask[None])[0]


def edge_proximity(distance: int, shape: tuple[int, int]) -> float:
    return 1.0 - min(distance / max(min(shape) // 2, 1), 1.0)


def component_rows(found: np.ndarray, planes: dict[str, np.ndarray]) -> list[dict]:
    """A row for each component: area, box, centroid, edge distance, and mean and maximum of each plane."""
    out = []
    h, w = found.shape
    for label in range(1, int(found.max(initial=0)) + 1):
        ys, xs = np.nonzero(found == label)
        if not len(ys):
            continue
        left, top, width, height = int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
        edge = min(left, top, w - left - width, h - top - height)
        row = {"label": label, "area": len(ys), "box_x": left, "box_y": top, "box_width": width, "box_height": height, "centroid_x": float(xs.mean()), "centroid_y": float(ys.mean()), "edge_distance": edge, "edge_proximity": edge_proximity(edge, (h, w))}
        for name, plane in planes.items():
            v = plane[ys, xs]
            row |= {f"mean_{name}": float(v.mean()), f"max_{name}": float(v.max())}
        out.append(row)
    return out


#: The eight neighbours (x, y), clockwise from the right.
_AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def contours(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Outer borders of the components as (x, y) corners: runs in one direction keep their ends alone; sorted by (least y, least x, length, points)."""
    found = labels(mask)
    h, w = mask.shape
    out = []
    for label in range(1, int(found.max(initial=0)) + 1):
        inside = lambda x, y, label=label: 0 <= x < w and 0 <= y < h and found[y, x] == label
        y0, x0 = map(int, np.argwhere(found == label)[0])
        border, at, came = [(x0, y0)], (x0, y0), 4
        while True:
            for turn in range(1, 9):
                d = (came + turn) % 8
                x, y = at[0] + _AROUND[d][0], at[1] + _AROUND[d][1]
                if inside(x, y):
                    break
            else:
                break
            if at == (x0, y0) and len(border) > 1 and (x, y) == border[1]:
                border.pop()
                break
            border.append((x, y))
            at, came = (x, y), (d + 4) % 8
        n = len(border)
        step = lambda i, b=border, n=n: (b[(i + 1) % n][0] - b[i % n][0], b[(i + 1) % n][1] - b[i % n][1])
        out.append([border[i] for i in range(n) if n < 3 or step(i) != step(i - 1)])
    return sorted(out, key=lambda c: (min(y for _, y in c), min(x for x, _ in c), len(c), c))


def equalized(values: np.ndarray, clip: float = 2.0, grid: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Contrast-limited adaptive histogram equalization of one uint8 tile, in single precision.

    Unless the grid (rows, columns) divides the tile, it is reflected at its lower and right edges by what is missing in each direction (by a whole row or column of cells' pixels where nothing is); a cell's histogram is cut at clip times its mean count (at least 1), what is cut
    goes to all bins alike, the remainder to every so many-th bin; pixels take the bilinear mean of the four cells around them, halves to even.
    """
    ty, tx = grid
    if not clip > 0 or ty < 1 or tx < 1:
        raise ValueError("clip has to be positive and the grid 1 x 1 at least")
    h, w = values.shape
    more = (0, 0) if h % ty == 0 and w % tx == 0 else (ty - h % ty, tx - w % tx)
    grown = np.pad(values, ((0, more[0]), (0, more[1])), mode="reflect" if h > 1 and w > 1 else "edge")
    ch, cw = grown.shape[0] // ty, grown.shape[1] // tx
    area = ch * cw
    limit = max(1, int(clip * area / 256))
    maps = np.zeros((ty, tx, 256), dtype=np.float32)
    for i in range(ty):
        for j in range(tx):
            hist = np.bincount(grown[i * ch : (i + 1) * ch, j * cw : (j + 1) * cw].ravel(), minlength=256)
            over = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + over // 256
            rest = over % 256
            if rest:
                hist[np.arange(rest) * max(256 // rest, 1)] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(hist).astype(np.float32) * np.float32(255 / area)), 0, 255)

    def between(n: int, size: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n, dtype=np.float32) * np.float32(1 / size) - np.float32(0.5)
        first = np.floor(at).astype(int)
        return np.maximum(first, 0), np.minimum(first + 1, cells - 1), (at - first).astype(np.float32)

    y0, y1, a = between(h, ch, ty)
    x0, x1, b = between(w, cw, tx)
    a, b, one = a[:, None], b[None, :], np.float32(1)
    at = lambda y, x: maps[y[:, None], x[None, :], values]
    mixed = (at(y0, x0) * (one - b) + at(y0, x1) * b) * (one - a) + (at(y1, x0) * (one - b) + at(y1, x1) * b) * a
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)
