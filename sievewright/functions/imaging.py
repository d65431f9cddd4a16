"""Masks and normalisation of gray images as arrays: threshold, components, closing, cascade, crop.

Conventions: closings use a diamond (steps along rows and columns) and see zeros beyond the frame; objects are
connected along rows and columns, the background also along diagonals. Resampling rounds to 8 bits
after each direction, and blurs are three passes of a box, so a level may differ by one from other
implementations of the same formulas.
"""

from __future__ import annotations

import numpy as np

from . import png

#: Threshold factors and closings of the attempts, accepted coverage, least object, frame margin.
ATTEMPTS = [(0.50, 5), (0.75, 5), (1.00, 7), (1.25, 7), (1.50, 5)]
COVERAGE, LEAST, MARGIN, FRINGE = (0.15, 0.85), 500, 0.05, 5


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of an 8-bit image, in fixed-point weights."""
    if image.ndim == 2:
        return image
    r, g, b = (image[..., i].astype(np.int64) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def otsu(image: np.ndarray, bins: int = 256) -> float:
    """The bin centre that parts the histogram with most variance between; an image of one value has it as its threshold."""
    low, high = float(image.min()), float(image.max())
    if low == high:
        return low
    count, edges = np.histogram(image.ravel(), bins, (low, high))
    centre = (edges[:-1] + edges[1:]) / 2
    below, above = np.cumsum(count), np.cumsum(count[::-1])[::-1]
    mean_below = np.cumsum(count * centre) / np.maximum(below, 1)
    mean_above = (np.cumsum((count * centre)[::-1]) / np.maximum(above[::-1], 1))[::-1]
    between = below[:-1].astype(float) * above[1:] * (mean_below[:-1] - mean_above[1:]) ** 2
    return float(centre[int(between.argmax())])


def _spread(mask: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        out = mask.copy()
        out[1:] |= mask[:-1]
        out[:-1] |= mask[1:]
        out[:, 1:] |= mask[:, :-1]
        out[:, :-1] |= mask[:, 1:]
        mask = out
    return mask


def closing(mask: np.ndarray, steps: int) -> np.ndarray:
    """Dilation and then erosion by a diamond; what lies beyond the frame is empty."""
    grown = np.pad(_spread(mask, steps), steps)
    return ~_spread(~grown, steps)[steps:-steps, steps:-steps] if steps else mask


def components(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Labels from 1 in order of first appearance, 0 for the rest: runs of each row are joined with those they touch above."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = list(range(len(row)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    reach = int(diagonal)
    for y in range(1, h):
        a, b = first[y - 1], first[y]
        while a < first[y] and b < first[y + 1]:
            if start[a] < end[b] + reach and start[b] < end[a] + reach:
                i, j = find(int(a)), find(int(b))
                parent[max(i, j)] = min(i, j)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    roots = np.array([find(i) for i in range(len(row))], np.int64)
    number = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros((h, w), np.int64)
    for y, s, e, n in zip(row, start, end, number):
        out[y, s:e] = n
    return out


def _largest(labels: np.ndarray) -> tuple[np.ndarray, int]:
    sizes = np.bincount(labels.ravel())[1:]
    best = int(sizes.argmax()) + 1
    return labels == best, int(sizes[best - 1])


def attempt(image: np.ndarray, factor: float, steps: int, least: int = LEAST) -> np.ndarray | None:
    """The largest object once holes are filled from the border; None if there is no object at all."""
    closed = closing(image > otsu(image) * factor, steps)
    outside = components(np.pad(~closed, 2, constant_values=True), diagonal=True)
    solid = ~(outside == outside[0, 0])[2:-2, 2:-2]
    labels = components(solid)
    if not labels.any():
        return None
    mask, size = _largest(labels)
    return closing(mask if size >= least else np.zeros_like(mask), 3)


def object_mask(image: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, int]:
    """The first attempt of accepted coverage, else the one nearest to a half, else all ones; and its number (0 for all ones)."""
    best, away, which = None, 1.0, 0
    for n, (factor, steps) in enumerate(ATTEMPTS, 1):
        mask = attempt(image, factor, steps, least)
        if mask is None:
            continue
        share = float(mask.mean())
        if COVERAGE[0] <= share <= COVERAGE[1]:
            return mask, n
        if abs(share - 0.5) < away:
            best, away, which = mask, abs(share - 0.5), n
    return (np.ones(image.shape, bool), 0) if best is None else (best, which)


def rescaled(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Levels between the first and 99th percentile of the masked pixels; of all pixels' range where the mask is empty."""
    x = image.astype(np.float64)
    if not mask.any():
        return ((x - x.min()) / (x.max() - x.min() + 1e-8) * 255).astype(np.uint8)
    low, high = np.percentile(x[mask], [1, 99])
    return ((np.clip(x, low, high) - low) / (high - low + 1e-8) * 255).astype(np.uint8)


def nearest(mask: np.ndarray, side: int) -> np.ndarray:
    """Nearest-pixel resampling to a square."""
    at = [np.minimum(((np.arange(side) + 0.5) * n / side).astype(int), n - 1) for n in mask.shape]
    return mask[np.ix_(*at)]


def blurred(image: np.ndarray, radius: float) -> np.ndarray:
    """Three passes of a box of fractional width, along both directions, edges repeated."""
    spread = radius * radius / 3
    whole = np.floor((np.sqrt(12 * spread + 1) - 1) / 2)
    part = (2 * whole + 1) * (whole * (whole + 1) - 3 * spread) / (6 * (spread - (whole + 1) ** 2))
    n, width = int(whole), 2 * (whole + part) + 1
    x = image.astype(float)
    for axis in (1, 0):
        for _ in range(3):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (n + 1, n + 1)
            p = np.pad(x, pad, mode="edge")
            take = lambda k: np.take(p, np.arange(x.shape[axis]) + n + 1 + k, axis=axis)
            x = (sum(take(k) for k in range(-n, n + 1)) + part * (take(-n - 1) + take(n + 1))) / width
    return x


def sharpened(image: np.ndarray, radius: float, percent: int, threshold: int) -> np.ndarray:
    """Unsharp mask: differences from the blur above the threshold are enlarged."""
    x = image.astype(np.int64)
    d = x - np.clip(np.floor(blurred(image, radius) + 0.5), 0, 255).astype(np.int64)
    more = x + np.trunc(d * percent / 100).astype(np.int64)
    return np.clip(np.where(np.abs(d) > threshold, more, x), 0, 255).astype(np.uint8)


def framed(image: np.ndarray, mask: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """The mask's box with a margin, resampled to a square; sharpened the more, the more it is enlarged."""
    if not mask.any():
        return png.resize(image, side, side), nearest(mask, side)
    rows, cols = (np.flatnonzero(mask.any(axis=a)) for a in (1, 0))
    span = int(max(rows[-1] - rows[0], cols[-1] - cols[0]))
    pad = max(int(span * MARGIN), 4)
    box = tuple(slice(max(0, int(x[0]) - pad), int(x[-1]) + pad + 1) for x in (rows, cols))
    out, kept = png.resize(image[box], side, side), nearest(mask[box], side)
    scale = side / max(span, 1)
    if scale > 1.2:
        t = min((scale - 1.2) / (3.0 - 1.2), 1.0)
        out = sharpened(out, 1.0 + t * 1.5, int(80 + t * 120), max(1, int(4 - t * 3)))
        out[~kept] = 0
    return out, kept


def normalised(image: np.ndarray, side: int = 128, least: int = LEAST) -> tuple[np.ndarray, int, float]:
    """The whole chain: mask, levels, empty background, frame, fringe; the image, the attempt and its coverage."""
    x = gray(image)
    mask, which = object_mask(x.astype(np.float32), least)
    level = rescaled(x, mask)
    level[~mask] = 0
    out, kept = framed(level, mask, side)
    out = out.copy()
    out[~kept] = 0
    out[out < FRINGE] = 0
    return out, which, float(mask.mean())
