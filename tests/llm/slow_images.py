"""Corners and votes of images one at a time and over all pairs, as a truth for the tests."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from subvox.llm.images import BITS, INLIERS, RADIUS, RESPONSE, SCALES, SHIFT, TABLES, TURN, _tests


def blur(x):
    p = np.pad(x, 1, mode="edge")
    p = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    return (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4


def sample(x, row, col):
    r, c = np.clip(row, 0, x.shape[0] - 1.001), np.clip(col, 0, x.shape[1] - 1.001)
    i, j = r.astype(int), c.astype(int)
    a, b = r - i, c - j
    return (1 - a) * ((1 - b) * x[i, j] + b * x[i, j + 1]) + a * ((1 - b) * x[i + 1, j] + b * x[i + 1, j + 1])


def describe(image):
    out = []
    for scale in SCALES:
        h, w = int(image.shape[0] / scale), int(image.shape[1] / scale)
        if min(h, w) < 2 * RADIUS + 3:
            continue
        rows, cols = np.linspace(0, image.shape[0] - 1, h)[:, None] * np.ones(w), np.linspace(0, image.shape[1] - 1, w)[None] * np.ones((h, 1))
        x = blur(sample(image, rows, cols) if scale != 1 else image)
        dy, dx = np.gradient(x)
        xx, yy, xy = (blur(blur(p)) for p in (dx * dx, dy * dy, dx * dy))
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        if response.max() <= 1e-6:
            continue
        zoom, step = (image.shape[0] - 1) / max(h - 1, 1), np.arange(-RADIUS, RADIUS + 1)
        disc = (step[:, None] ** 2 + step[None] ** 2) <= RADIUS**2
        for r in range(RADIUS, h - RADIUS):
            for c in range(RADIUS, w - RADIUS):
                around = np.delete(response[r - 2 : r + 3, c - 2 : c + 3].ravel(), 12)
                if response[r, c] <= around.max() or response[r, c] <= RESPONSE * response.max():
                    continue
                patch = x[r - RADIUS : r + RADIUS + 1, c - RADIUS : c + RADIUS + 1] * disc
                patch = patch - patch.sum() / disc.sum() * disc
                turn = np.arctan2((patch * step[:, None]).sum(), (patch * step[None]).sum())
                t, cos, sin = _tests(), np.cos(turn), np.sin(turn)
                values = sample(x, r + t[..., 0] * cos + t[..., 1] * sin, c - t[..., 0] * sin + t[..., 1] * cos)
                out.append((r * zoom, c * zoom, np.degrees(turn), scale, values[:, 0] < values[:, 1]))
    return out


def near(asked, image):
    """Pairs of corners with an equal piece, and those of them that differ in at most ``BITS`` bits."""
    met = [(a, b) for a in asked for b in image if (a[4] == b[4]).reshape(TABLES, -1).all(1).any()]
    return len(met), [(a, b) for a, b in met if (a[4] != b[4]).sum() <= BITS]


def inliers(matches):
    """Most places of the searched image whose corners agree on one movement; 0 if too few."""
    voters = defaultdict(set)
    for (row, col, degrees, scale, _), b in matches:
        turn, zoom = (degrees - b[2]) % 360, scale / b[3]
        cos, sin, r, c = np.cos(np.radians(turn)), np.sin(np.radians(turn)), b[0] * zoom, b[1] * zoom
        down, right = (np.floor(2 * x / SHIFT) for x in (row - (cos * r + sin * c), col - (cos * c - sin * r)))
        bins = np.round(turn / TURN) % (360 // TURN), np.round(np.log2(zoom) * 2)
        for grid in ((0, 0), (0, 1), (1, 0), (1, 1)):
            voters[(*grid, *bins, (down + grid[0]) // 2, (right + grid[1]) // 2)].add((row, col))
    most = max(map(len, voters.values()), default=0)
    return most if most >= INLIERS else 0
