"""Keys along a Hilbert curve, for whole arrays of points at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each point along the Hilbert curve through a grid of 2**bits cells a side.

    cells: integers (points, dimensions) in [0, 2**bits); dimensions * bits must be at most 63. Works on the coordinates' bit
    planes from the highest to the lowest: the lower bits of the first axis are inverted, or exchanged with those of another axis,
    as that axis' bit says; a Gray code over all planes then gives the transposed key, whose bits are interleaved.
    """
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    dims = len(x)
    if dims * bits > 63:
        raise ValueError("dimensions times bits must be at most 63")
    for plane in range(bits - 1, 0, -1):
        q, low = 1 << plane, (1 << plane) - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] >> plane) & 1, (1 << plane) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> plane) & 1)
    return key


def to_cells(points: np.ndarray, low: np.ndarray | float, high: np.ndarray | float, bits: int) -> np.ndarray:
    """Points scaled into the grid; those outside go to its border."""
    side = 1 << bits
    scaled = np.floor((points - low) / (np.asarray(high) - low) * side)
    return np.clip(np.nan_to_num(scaled), 0, side - 1).astype(np.int64)
