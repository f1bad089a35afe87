"""Masks of image size, and the choice of views by what they show: sequential kernels over one view or one object."""

from __future__ import annotations

import heapq

import numpy as np

#: Costs of a straight and a diagonal step of the 3x3 distance transform, in units of 2**-16.
STRAIGHT, DIAGONAL, UNIT = 62587, 89738, 1 << 16
#: Separation of masks that touch, the gap that counts as full, and the pixels that a mask needs.
TOUCHING, FULL_GAP, LEAST_PIXELS = 0.15, 12.0, 64
#: Weights of separation, distance and visible share in a view's gain, the share of both parts that a pair needs, and when to stop.
SEPARATION, DIVERSITY, OVERALL, PAIR_SEEN, OF_FIRST, LEAST_GAIN = 0.25, 0.15, 0.01, 0.3, 0.1, 0.05
_FAR = 1 << 40


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Each pixel's distance to the mask, in units: the cheapest path of straight and diagonal steps.

    Two passes over the rows, down and up; along a row the best of all steps to
    one side is a running minimum of the distances less what the steps cost.
    """
    d = np.where(mask, 0, _FAR).astype(np.int64)
    steps = np.arange(d.shape[1], dtype=np.int64) * STRAIGHT
    for rows in (range(len(d)), range(len(d) - 1, -1, -1)):
        before = None
        for y in rows:
            row = d[y]
            if before is not None:
                row = np.minimum(row, before + STRAIGHT)
                row[1:] = np.minimum(row[1:], before[:-1] + DIAGONAL)
                row[:-1] = np.minimum(row[:-1], before[1:] + DIAGONAL)
            row = np.minimum.accumulate(row - steps) + steps
            row = (np.minimum.accumulate((row + steps)[::-1]))[::-1] - steps
            d[y] = before = row
    return d


def chamfer_gap(a: np.ndarray, b: np.ndarray) -> float:
    """The smallest distance between two masks in pixels, 0 if they meet or one is empty."""
    if not a.any() or not b.any() or (a & b).any():
        return 0.0
    return float(chamfer(b)[a].min()) / UNIT


def separation(a: np.ndarray, b: np.ndarray, least: int = LEAST_PIXELS, full: float = FULL_GAP, touching: float = TOUCHING) -> float:
    """0 for masks that meet, else their gap over ``full``, ``touching`` at least and 1 at most; masks that are too small touch."""
    if min(a.sum(), b.sum()) < least:
        return touching
    if (a & b).any():
        return 0.0
    return min(1.0, max(touching, chamfer_gap(a, b) / full))


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    """The mask grown and shrunk by a square of odd ``size``; beyond the image nothing grows and nothing shrinks."""
    half = size // 2
    for grow in (True, False):
        for axis in (0, 1):
            pads = [(half, half) if k == axis else (0, 0) for k in (0, 1)]
            wide = np.lib.stride_tricks.sliding_window_view(np.pad(mask, pads, constant_values=not grow), size, axis)
            mask = wide.any(-1) if grow else wide.all(-1)
    return mask


def blurred(mask: np.ndarray, size: int, over: float) -> np.ndarray:
    """Where a Gaussian blur of the mask (of odd ``size``, its width by the usual rule, mirrored at the borders) is above ``over``."""
    sigma, half = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    weight = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
    out = mask.astype(float)
    for axis in (0, 1):
        # A mirrored border needs as many pixels within.
        pads = [(half, half) if k == axis else (0, 0) for k in (0, 1)]
        out = np.lib.stride_tricks.sliding_window_view(np.pad(out, pads, mode="reflect" if min(mask.shape) > half else "edge"), size, axis) @ (weight / weight.sum())
    return out > over


def view_gain(shown: np.ndarray, covered: np.ndarray, weight: np.ndarray, fixed: float, nearest: float) -> float:
    """What a view adds: newly shown shares of parts by weight, what does not depend on other views, and its distance to the chosen ones."""
    return float((np.maximum(shown - covered, 0) * weight).sum()) + fixed + DIVERSITY * min(1.0, max(0.0, 1 - nearest))


def fixed_gain(shown: np.ndarray, pairs: list[tuple[int, int, float, float]], overall: float) -> float:
    """What a view is worth beside its parts: the separation of pairs (part, part, separation, weight) that it shows, and the share of points seen."""
    total = sum(w * min(shown[i], shown[j]) for i, j, _, w in pairs if min(shown[i], shown[j]) > PAIR_SEEN)
    apart = sum(s * w * min(shown[i], shown[j]) for i, j, s, w in pairs if min(shown[i], shown[j]) > PAIR_SEEN)
    return (SEPARATION * apart / total if total > 1e-9 else 0.0) + OVERALL * overall


def lazy_views(shown: np.ndarray, weight: np.ndarray, fixed: np.ndarray, directions: np.ndarray, n: int) -> list[tuple[int, float]]:
    """The views of largest gain, one after the other; of equal gains the first view.

    ``shown`` is [view, part], ``fixed`` what ``fixed_gain`` gives.  Coverage and
    nearness only grow, so gains only fall: one from an earlier step is a bound,
    and a view is looked at again only when its bound leads the queue.  Ends
    when the best gain is under a tenth of the first or 0.05.
    """
    covered = np.zeros(shown.shape[1])
    queue = [(-view_gain(shown[i], covered, weight, fixed[i], 0.0), i, 0) for i in range(len(shown))]
    heapq.heapify(queue)
    chosen: list[tuple[int, float]] = []
    while queue and len(chosen) < n:
        bound, i, step = heapq.heappop(queue)
        if step < len(chosen):
            nearest = float(max(directions[c] @ directions[i] for c, _ in chosen))
            heapq.heappush(queue, (-view_gain(shown[i], covered, weight, fixed[i], nearest), i, len(chosen)))
            continue
        if chosen and -bound < max(OF_FIRST * chosen[0][1], LEAST_GAIN):
            break
        chosen.append((i, -bound))
        covered = np.maximum(covered, shown[i])
    return chosen
