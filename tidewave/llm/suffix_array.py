"""Two-stage suffix sorting to a depth, and common prefixes of neighbours, as NumPy passes."""

from __future__ import annotations

import numpy as np


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later (the empty one is smallest)."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:]) if n else np.zeros(0, int)
    following = np.full(n, -1)
    if len(differs):
        at = np.searchsorted(differs, np.arange(n))
        following = np.where(at < len(differs), differs[np.minimum(at, len(differs) - 1)], -1)
    out = np.zeros(n, bool)
    some = following >= 0
    out[some] = text[following[some]] < text[following[some] + 1]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in an order that is right for their first ``depth`` bytes at least.

    Only the suffixes smaller than their successors are compared. The rest follow from buckets by first
    byte, from small to large: in each, the larger suffixes stand before the smaller ones, and whatever
    stands there puts the suffix one byte earlier, if that is a larger one, next into its own bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(text)
    chosen = np.flatnonzero(small)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    if len(chosen):
        heads = np.lib.stride_tricks.sliding_window_view(padded, depth)[chosen]
        chosen = chosen[np.argsort(heads.view(f"S{depth}").ravel(), kind="stable")]
    first = text[chosen]
    cuts = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # from the empty suffix, before all others
    out: list[np.ndarray] = []

    def induce(at: np.ndarray, c: int) -> np.ndarray:
        before = at[at > 0] - 1
        before = before[~small[before]]
        byte = text[before]
        here = byte == c
        later, byte = before[~here], byte[~here]
        if len(later):
            order = np.argsort(byte, kind="stable")
            later, byte = later[order], byte[order]
            starts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            for b, part in zip(byte[starts], np.split(later, starts[1:]), strict=True):
                waiting[b].append(part)
        return before[here]

    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(part):
            out.append(part)
            part = induce(part, c)
        part = chosen[cuts[c] : cuts[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    return np.concatenate(out)


def neighbours_agree(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the next one, counted up to ``length`` bytes (by
    whole steps of eight; a full one is exact). All suffixes must have ``length`` bytes."""
    out = np.zeros(max(0, len(order) - 1), np.int64)
    if not len(out):
        return out
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), np.uint64, padded, 0, (1,))
    alive = np.arange(len(out))
    for at in range(0, length, 8):
        at = min(at, max(0, length - 8))
        same = words[order[alive] + at] == words[order[alive + 1] + at]
        alive = alive[same]
        out[alive] = min(length, at + 8)
    return out
