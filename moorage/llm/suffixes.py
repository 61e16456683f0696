"""Suffix arrays by induced sorting, and common prefixes in text order, with numpy."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


def classify(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last is not."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))
    # An equal neighbour has the type of the next suffix: look up the next unequal step.
    ahead = np.where(step != 0, np.arange(n - 1), n - 1)
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]
    smaller = np.zeros(n, bool)
    smaller[:-1] = np.append(step, -1)[ahead] > 0
    return smaller


def _deal(values: np.ndarray, chars: np.ndarray, ends: np.ndarray, out: np.ndarray, sign: int) -> None:
    """Append values to the buckets of their chars, in order; ``ends`` moves along."""
    order = np.argsort(chars, kind="stable")
    sorted_chars = chars[order]
    first = np.flatnonzero(np.append(True, sorted_chars[1:] != sorted_chars[:-1]))
    counts = np.diff(np.append(first, len(chars)))
    places = np.arange(len(chars)) - np.repeat(first, counts)
    out[ends[sorted_chars] + sign * places] = values[order]
    ends[sorted_chars[first]] += sign * counts


def induce(text: np.ndarray, smaller: np.ndarray, bounds: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones in ``leftmost`` order.

    Bucket by bucket: first the larger suffixes from left to right, then the smaller ones
    from right to left. What one bucket induces is dealt out in one step; only runs of an
    equal char need a step for each char.
    """
    n, buckets = len(text), len(bounds) - 1
    out = np.full(n, -1, np.int32)
    of_bucket = np.searchsorted(text[leftmost], np.arange(buckets + 1)) if len(leftmost) else np.zeros(buckets + 1, int)
    heads = bounds[:-1].copy()
    last = n - 1
    out[heads[text[last]]] = last
    heads[text[last]] += 1
    used = np.unique(text).tolist()
    for c in used:
        done = bounds[c]
        while done < heads[c]:
            found = out[done : heads[c]]
            done = heads[c]
            before = found[found > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _deal(before, text[before], heads, out, 1)
        found = leftmost[of_bucket[c] : of_bucket[c + 1]]
        before = found[found > 0] - 1
        if len(before):
            _deal(before, text[before], heads, out, 1)
    tails = bounds[1:].copy() - 1
    for c in reversed(used):
        done = bounds[c + 1] - 1
        while done > tails[c]:
            found = out[tails[c] + 1 : done + 1][::-1]
            done = tails[c]
            before = found[found > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _deal(before, text[before], tails, out, -1)
        found = out[bounds[c] : heads[c]][::-1]
        before = found[found > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _deal(before, text[before], tails, out, -1)
    return out


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Suffix array of a reduced text by doubling; settled ranks are not sorted again.

    The first ranks are those of as many names in a row as one number holds.
    """
    n = len(names)
    bits = int(names.max() + 1).bit_length()
    width = max(63 // bits, 1)
    rank = np.zeros(n, np.int64)
    for step in range(width):
        rank <<= bits
        # Past the end stands zero, below all names.
        rank[: max(n - step, 0)] += names[step:] + 1
    order = np.argsort(rank)
    while True:
        sorted_rank = rank[order]
        starts = np.append(True, sorted_rank[1:] != sorted_rank[:-1])
        single = starts & np.append(starts[1:], True)
        places = np.flatnonzero(~single)
        # Ranks are the first place of their group, so settled ranks need no renaming.
        first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        rank[order] = first
        if not len(places):
            return order.astype(np.int32)
        rows = order[places]
        after = np.where(rows + width < n, rank[np.minimum(rows + width, n - 1)] + 1, 0)
        keys = rank[rows] * (n + 1) + after
        inner = np.argsort(keys)
        order[places] = rows[inner]
        sorted_keys = keys[inner]
        # A group starts anew where the second half differs.
        new = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
        rank[order[places]] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        width *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative numbers, in which a prefix is smaller."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    smaller = classify(text)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    if len(leftmost) > 1:
        by_char = leftmost[np.argsort(text[leftmost], kind="stable")]
        order = induce(text, smaller, bounds, by_char)
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        order = order[is_leftmost[order]]
        # Name the substrings from one leftmost-smaller position to the next.
        ends = np.append(leftmost[1:] + 1, n).astype(np.int64)
        number = np.cumsum(is_leftmost)[order] - 1
        start, stop = order.astype(np.int64), ends[number]
        powers = np.cumprod(np.append(np.uint64(1), np.full(n, _MULTIPLIER, np.uint64)), dtype=np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        a, b = (start[:-1], stop[:-1]), (start[1:], stop[1:])
        same = (a[1] - a[0]) == (b[1] - b[0])
        # Equal sums, brought to one power, and lengths; the later substring is not shifted.
        left, right = sums[a[1]] - sums[a[0]], sums[b[1]] - sums[b[0]]
        low = np.minimum(a[0], b[0])
        same &= left * powers[b[0] - low] == right * powers[a[0] - low]
        # The last substring ends with the text and equals no other.
        same &= (a[1] < n) & (b[1] < n)
        names = np.empty(len(leftmost), np.int64)
        names[number] = np.concatenate([[0], np.cumsum(~same)])
        leftmost = leftmost[_sort_names(names)]
    return induce(text, smaller, bounds, leftmost)


def common_prefixes(text: np.ndarray, array: np.ndarray, room: np.ndarray, least: int = 1) -> np.ndarray:
    """For each position, the prefix it shares with its predecessor in the array.

    Chars are byte values plus one, and zero ends a piece. ``room`` is what is left of a
    position's piece and caps a value on both sides. In text order a value is one less than
    the one before, unless the chars before both suffixes differ or a piece begins: only such
    positions are compared, eight chars at a time. Positions with less room than ``least``
    have zero; what is below ``least`` elsewhere may be too small.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[array[1:]] = array[:-1]
    shared = np.zeros(n, np.int32)
    # Room shrinks along a piece, so these are the first positions of each long enough piece.
    open_ = np.flatnonzero(room >= max(least, 1)).astype(np.int32)
    if not len(open_):
        return shared
    fore = before[open_]
    fresh = np.append(True, np.diff(open_) > 1) | (fore <= 0)
    inner = np.flatnonzero(~fresh)
    fresh[inner] = text[open_[inner] - 1] != text[fore[inner] - 1]
    # Bytes are enough for the comparison: the room keeps it inside both pieces.
    padded = np.concatenate([np.where(text > 0, text - 1, 0).astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8")[:, 0]
    at, other = open_[fresh], fore[fresh]
    found = np.zeros(len(at), np.int32)
    most = np.where(other >= 0, np.minimum(room[at], room[other]), 0)
    active = np.flatnonzero(most >= max(least, 1))
    while len(active) > 8:
        i, j = at[active] + found[active], other[active] + found[active]
        inside = j < n
        x = np.where(inside, words[i] ^ words[np.minimum(j, n)], np.uint64(1))
        equal = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int32)
        found[active] += equal
        active = active[(equal == 8) & (found[active] < most[active])]
    # The few longest, such as runs of one char, are compared to their ends in one go.
    for k in active.tolist():
        i, j, left = at[k] + found[k], other[k] + found[k], most[k] - found[k]
        unequal = padded[i : i + left] != padded[j : j + left]
        found[k] += int(unequal.argmax()) if unequal.any() else left
    count = np.diff(np.append(np.flatnonzero(fresh), len(open_)))
    first = np.repeat(at, count)
    shared[open_] = np.maximum(np.repeat(np.minimum(found, most), count) - (open_ - first), 0)
    return shared


def repeated_windows(pieces: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each piece, the starts of ``length`` bytes that occur elsewhere as well.

    A piece counts ``weights`` times. Windows never reach from one piece into another.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    # Chars are byte values plus one; zero ends a piece.
    text = np.zeros(int(sizes.sum()) + len(pieces), np.uint16)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    joined = np.frombuffer(b"".join(pieces), np.uint8)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    text[inside] = joined.astype(np.uint16) + 1
    room = np.repeat((starts + sizes).astype(np.int32), sizes + 1) - np.arange(len(text), dtype=np.int32)
    array = suffix_array(text)
    shared = common_prefixes(text, array, room, length)
    # Only positions with a whole window count; what stands between two of them parts them.
    array = array[room[array] >= length]
    group = np.cumsum(shared[array] < length) - 1
    counts = np.bincount(group, weights=np.array(weights, float)[owner[array]])
    hit = array[counts[group] >= 2]
    hit.sort()
    cuts = np.searchsorted(hit, np.append(starts, len(text)))
    return [hit[a:b] - s for a, b, s in zip(cuts[:-1].tolist(), cuts[1:].tolist(), starts.tolist())]
