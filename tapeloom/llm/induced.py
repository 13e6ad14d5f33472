"""Suffix arrays by induced sorting, for many short shards at once.

All shards take the same step together: step k of a scan handles the k-th entry of every
shard as one array operation, so each shard's array is induced linearly and the work is
spread over as many lanes as there are shards.
"""

from __future__ import annotations

import numpy as np

from tapeloom.llm.words import ragged


def _types(text: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller, leftmost): whether a suffix is smaller than the next one, and larger ones' first smaller follower."""
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[off[1:] - 1] = 1  # the end marks
    decided = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    small = step[decided] > 0
    left = small.copy()
    left[1:] &= ~small[:-1]
    left[off[:-1]] = False
    left[off[1:] - 1] = np.diff(off) > 1
    return small, left


def _preceded(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the suffix before each one is of the kind and in its shard; the last entry stands for no suffix (-1)."""
    out = np.zeros(len(kind) + 1, dtype=bool)
    out[1:-1] = kind[:-1]
    out[first] = False
    return out


def _induce(order: np.ndarray, bucket: np.ndarray, counts: np.ndarray, off: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Suffix arrays from leftmost smaller suffixes in ``order`` (by shard); shards descend in length."""
    size = np.diff(off)
    heads = np.cumsum(counts) - counts
    tails = heads + counts
    sa = np.full(len(bucket), -1, dtype=np.int32)
    by = order[np.argsort(bucket[order], kind="stable")]
    b = bucket[by]
    many = np.bincount(b, minlength=len(counts))
    sa[tails[b] - many[b] + np.arange(len(b)) - (np.cumsum(many) - many)[b]] = by
    first = off[:-1]
    ends = off[1:] - 1
    sa[first] = ends  # the end mark sorts first
    active = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left")  # shards longer than k
    active = active.tolist()
    large = ~small
    before = np.zeros(len(bucket), dtype=np.intp)
    before[1:] = bucket[:-1]
    goes = _preceded(large, first)
    head = heads.copy()
    for k in range(int(size[0])):
        j = sa.take(first[:active[k]] + k)
        j = j.compress(goes.take(j)).astype(np.intp)
        b = before.take(j)
        at = head.take(b)
        sa[at] = j - 1
        head[b] = at + 1
    kept = sa >= 0
    kept[kept] = large[sa[kept]]
    sa[~kept] = -1
    sa[first] = ends
    goes = _preceded(small, first)
    tail = tails - 1
    for k in range(int(size[0]) - 1, -1, -1):
        j = sa.take(first[:active[k]] + k)
        j = j.compress(goes.take(j)).astype(np.intp)
        b = before.take(j)
        at = tail.take(b)
        sa[at] = j - 1
        tail[b] = at - 1
    return sa


def _names(sa: np.ndarray, text: np.ndarray, off: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leftmost smaller positions in sorted order, their names (from 0 in each shard), and which shard each is in."""
    order = sa[left[sa]]
    shard = np.searchsorted(off, order, side="right") - 1
    at = np.flatnonzero(left)
    following = np.append(at[1:], len(text))
    length = np.zeros(len(text), dtype=np.int32)
    length[at] = np.minimum(following, off[np.searchsorted(off, at, side="right")] - 1) - at
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (shard[1:] == shard[:-1]) & (length[order[1:]] == length[order[:-1]])
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        x, y = order[open_], order[open_ - 1]
        equal = text[x + k] == text[y + k]
        same[open_[~equal]] = False
        open_ = open_[equal]
        open_ = open_[length[order[open_]] > k]
        k += 1
    running = np.cumsum(~same)
    begin = np.searchsorted(shard, np.arange(len(off) - 1))
    has = begin < len(order)
    zero = np.zeros(len(off) - 1, dtype=np.int64)
    zero[has] = running[begin[has]]
    return order, running - zero[shard], shard


def suffix_arrays(text: np.ndarray, off: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Suffixes of every shard in order, as places in ``text``.

    Shard s is ``text[off[s]:off[s + 1]]`` with symbols under ``sigma[s]``; its last symbol, 0,
    occurs nowhere else in it.
    """
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    if (order != np.arange(len(order))).any():
        back = np.concatenate([[0], np.cumsum(size[order])])
        place = ragged(off[:-1][order], size[order])
        sa = place[suffix_arrays(text[place], back, sigma[order])]
        out = np.empty_like(sa)
        out[ragged(off[:-1][order], size[order])] = sa
        return out
    bucket = (np.repeat(np.cumsum(sigma) - sigma, size) + text).astype(np.int32)
    counts = np.bincount(bucket, minlength=int(sigma.sum()))
    small, left = _types(text, off)
    sa = _induce(np.flatnonzero(left), bucket, counts, off, small)
    order, name, of = _names(sa, text, off, left)
    # Shards whose substrings all differ are in order; the others sort the string of names.
    many = np.bincount(of, minlength=len(size))
    top = np.zeros(len(size), dtype=np.int64)
    np.maximum.at(top, of, name + 1)
    deeper = np.flatnonzero(top < many)
    if len(deeper):
        again = np.isin(of, deeper)
        by_place = np.argsort(order[again], kind="stable")
        place = order[again][by_place]
        names = name[again][by_place]
        begin = np.concatenate([[0], np.cumsum(many[deeper])])
        order = order.copy()
        order[again] = place[suffix_arrays(names, begin, top[deeper])]
    return _induce(order, bucket, counts, off, small)


def common_prefixes(text: np.ndarray, off: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi) by place: the suffix before each one in its shard's array (-1: none) and their common prefix.

    Only places whose left neighbours differ from those of their predecessor are compared;
    every other one has the value of the place before it less one.
    """
    n = len(text)
    phi = np.full(n, -1, dtype=np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[off[:-1]]] = -1
    begin = np.zeros(n, dtype=bool)
    begin[off[:-1]] = True
    own = phi >= 0
    fresh = own.copy()
    inner = np.flatnonzero(own & ~begin)
    inner = inner[~begin[phi[inner]]]
    fresh[inner] = text[inner - 1] != text[phi[inner] - 1]
    plcp = np.zeros(n, dtype=np.int32)
    open_ = np.flatnonzero(fresh)
    k = 0
    # The end mark stops every comparison: it occurs once in a shard.
    while len(open_):
        open_ = open_[text[open_ + k] == text[phi[open_] + k]]
        plcp[open_] += 1
        k += 1
    last = np.maximum.accumulate(np.where(fresh | ~own, np.arange(n), -1))
    plcp = np.maximum(plcp[last] - (np.arange(n) - last), 0)
    plcp[~own] = 0
    return plcp, phi
