"""SimHash fingerprints of 3-word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from . import textnp as tn

SEED = 42


def fingerprint(words: list[bytes]) -> int:
    """The 64-bit majority of the shingles' XXH64; words as they are."""
    n = len(words)
    if not n:
        return 0
    if n < 4:
        # one shingle: its majority is itself
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    first = np.cumsum(size + 1) - size - 1
    end = (first + size)[2:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], SEED) for a, b in zip(first.tolist(), end)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):  # the bits of a long text, part by part
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(col: pa.Array) -> np.ndarray:
    """Fingerprints of whole texts, A-Z lower-cased; a null text has none of the bits."""
    out = np.zeros(len(col), np.uint64)
    data, offsets = tn.buffers(col)
    for k in range(len(col)):
        out[k] = fingerprint(tn.LOWER[data[offsets[k] : offsets[k + 1]]].tobytes().split())
    return out


# ---------------------------------------------------------------------------------------------
# Links at a bounded Hamming distance: the generalised pigeonhole principle.


def variants(values: np.ndarray, width: int, radius: int) -> list[np.ndarray]:
    """values with up to ``radius`` of their ``width`` bits flipped."""
    from itertools import combinations

    out = [values]
    for r in range(1, radius + 1):
        for bits in combinations(range(width), r):
            out.append(values ^ np.uint64(sum(1 << b for b in bits)))
    return out


def probes(width: int, radius: int) -> int:
    from math import comb

    return sum(comb(width, r) for r in range(radius + 1)) if radius >= 0 else 0


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of about one size, correlated bits together (greedy)."""
    left, out = set(range(64)), []
    a = np.abs(corr)
    for k in range(parts):
        size = (len(left) + parts - k - 1) // (parts - k)
        start = max(left, key=lambda b: (sum(a[b, c] for c in left), -b))
        group = [start]
        left.remove(start)
        while len(group) < size:
            best = max(left, key=lambda b: (a[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i (-1 upwards) with sum(t_i + 1) = budget of the least total cost, by dynamic programming.

    costs[i][k] is the cost of partition i at threshold k - 1.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for k, own in enumerate(c):
                if used + k <= budget and (used + k not in step or total + own < step[used + k][0]):
                    step[used + k] = (total + own, [*chosen, k - 1])
        best = step
    return best[budget]


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def forest(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever lies within ``most`` bits between x and y: no more than there are values."""
    values, at = np.unique(np.r_[x, y], return_inverse=True)
    xa, ya = at[: len(x)], at[len(x) :]
    label = np.arange(len(values))
    for lo in range(0, len(x), 256):
        d = np.bitwise_count(x[lo : lo + 256, None] ^ y[None, :]) <= most
        i, j = np.nonzero(d)
        u, v = xa[lo + i], ya[j]
        while True:
            a, b = label[u], label[v]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, np.maximum(a, b), low)
            while (label[label] != label).any():
                label = label[label]
    far = np.flatnonzero(label != np.arange(len(values)))
    return values[far], values[label[far]]
