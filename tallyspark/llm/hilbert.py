"""Places on a Hilbert curve through many dimensions (Skilling, 2004), for whole matrices."""

from __future__ import annotations

import numpy as np


def places(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the curve of each row of ``points``, whole numbers from 0 under 2^bits in each column; columns times bits are 63 at most."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    if n * bits > 63:
        raise ValueError(f"{n} dimensions of {bits} bits do not fit 63 bits")
    step = 1 << (bits - 1)
    while step > 1:  # undo the turns and swaps of each level, the coarsest first
        low = step - 1
        for i in range(n):
            here = (x[i] & step) != 0
            swap = np.where(here, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(here, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        step >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        turn = np.where((x[n - 1] & step) != 0, turn ^ (step - 1), turn)
        step >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> bit & 1
    return out
