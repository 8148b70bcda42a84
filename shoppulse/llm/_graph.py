"""Spanning forests of links found within one task."""

from __future__ import annotations

import numpy as np


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (id, smallest id connected to it) that connect what the links ``u``-``v`` connect."""
    if not len(u):
        z = np.zeros(0, np.int64)
        return z, z
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far], ids[label[far]]
