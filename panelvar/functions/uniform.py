"""Deterministic uniform draws keyed by integers, so resampling repeats itself on a retried task."""

from __future__ import annotations

import numpy as np

# Prime modulus and multiplier of a multiplicative congruential generator, and the
# offsets of the two squaring rounds. Every product stays below 2^63.
MODULUS = 2_147_483_647
MULTIPLIER = 48_271
OFFSETS = (12_345, 67_891)


def advance(state: np.ndarray) -> np.ndarray:
    """Next state of a stream; a state is an integer in [0, MODULUS)."""
    return state * MULTIPLIER % MODULUS


def mixed(*keys: np.ndarray | int) -> np.ndarray:
    """Well-spread integers in [0, MODULUS) from integer keys (broadcast against each other)."""
    x = np.int64(1)
    for key in keys:
        x = (x * MULTIPLIER + np.asarray(key, np.int64) + 1) % MODULUS
    for offset in OFFSETS:
        x = advance(x)
        x = (x * x + offset) % MODULUS
    return advance(x)


def scaled(state: np.ndarray, n: int) -> np.ndarray:
    """Integers in [0, n) from states."""
    return np.floor(state / float(MODULUS) * n).astype(np.int64)
