"""Viterbi decoding of many sequences at once."""

from __future__ import annotations

import numpy as np


def viterbi(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best path of each sequence: states, as uint8, in the order of `scores`.

    scores: [positions of all sequences, states], log scores of the sequences one after another; lengths: of each, 0 allowed;
    transition: [from, to], log scores. Any state can begin. Of equal paths the one with smaller states wins. Steps go along
    positions, for all sequences that reach so far together, so time is that of the scores plus that of the longest sequence.
    """
    lengths = np.asarray(lengths, np.int64)
    total, states = scores.shape
    out = np.zeros(total, np.uint8)
    if not total:
        return out
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    first = starts[order]
    reach = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")  # how many are longer than t
    back = np.zeros((total, states), np.uint8)
    best = scores[first[: reach[0]]].astype(np.float64)
    for t in range(1, len(reach)):
        n = reach[t]
        at = first[:n] + t
        way = best[:n, :, None] + transition
        came = way.argmax(axis=1)
        back[at] = came
        best[:n] = np.take_along_axis(way, came[:, None, :], axis=1)[:, 0] + scores[at]
    state = np.zeros(reach[0], np.uint8)
    for t in range(len(reach) - 1, -1, -1):
        n, longer = reach[t], reach[t + 1] if t + 1 < len(reach) else 0
        state[longer:n] = best[longer:n].argmax(axis=1)
        at = first[:n] + t
        if longer:
            state[:longer] = back[at[:longer] + 1, state[:longer]]
        out[at] = state[:n]
    return out


def switching_path(scores: np.ndarray, lengths: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """As `viterbi`, where any change of state costs the penalty of the position it is changed at."""
    lengths = np.asarray(lengths, np.int64)
    total, states = scores.shape
    out = np.zeros(total, np.uint8)
    if not total:
        return out
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    first = starts[order]
    reach = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
    back = np.zeros((total, states), np.uint8)
    own = np.arange(states, dtype=np.uint8)
    best = scores[first[: reach[0]]].astype(np.float64)
    for t in range(1, len(reach)):
        n = reach[t]
        at = first[:n] + t
        before = best[:n]
        top = before.argmax(axis=1)
        other = before[np.arange(n), top] - penalty[at]
        change = other[:, None] > before
        back[at] = np.where(change, top[:, None].astype(np.uint8), own)
        best[:n] = np.where(change, other[:, None], before) + scores[at]
    state = np.zeros(reach[0], np.uint8)
    for t in range(len(reach) - 1, -1, -1):
        n, longer = reach[t], reach[t + 1] if t + 1 < len(reach) else 0
        state[longer:n] = best[longer:n].argmax(axis=1)
        at = first[:n] + t
        if longer:
            state[:longer] = back[at[:longer] + 1, state[:longer]]
        out[at] = state[:n]
    return out
