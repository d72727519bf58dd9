"""Suffix arrays by linear grouping: many small texts at a time.

Phase one sorts all suffixes of a text into groups of equal Lyndon prefix. It
starts from the groups of equal first letters and goes through the groups in
descending order: every member points to the nearest place before it whose
group is smaller (the previous-smaller pointer), and the places pointed to
move, by how often they are pointed to, into new groups right above their old
ones. Phase two emits each group in order: the suffix before an emitted one,
and then along its pointers, takes the next place of its group. No step
renames the text or recurses.

Every step treats the current group of all texts at once.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``symbols``: the texts one after another, each ending in a 0 that
    occurs nowhere else in it. Returns, text by text, the places (in
    ``symbols``) of its suffixes in ascending order."""
    n = len(symbols)
    base = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    keys = text * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(keys, kind="stable")  # slots -> places
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    fresh = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    starts = np.flatnonzero(fresh)
    group = np.empty(n, np.int64)  # of a place: the first slot of its group
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    size = np.zeros(n, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    before = np.arange(-1, n - 1)  # previous-smaller pointers, -1 for none
    before[base] = -1
    moving = np.zeros(n, bool)

    end = base + lengths
    active = np.flatnonzero(end > base + 1)
    while len(active):
        first = group[order[end[active] - 1]]
        count = end[active] - first
        at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        members, own = order[at], np.repeat(first, count)
        high, low = members, own  # those whose pointers still go to no smaller group
        while len(high):
            to = before[high]
            higher = np.flatnonzero((to >= 0) & (group[to] >= low))
            high, low = high[higher], low[higher]
            before[high] = before[to[higher]]
        to = before[members]
        to = np.sort(to[to >= 0])
        if len(to):
            at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            places, times = to[at], np.diff(np.append(at, len(to)))
            old = group[places]
            sort = np.lexsort((times, old))
            places, times, old = places[sort], times[sort], old[sort]
            run = np.concatenate(([True], old[1:] != old[:-1]))
            run_at = np.flatnonzero(run)
            moved = np.diff(np.append(run_at, len(old)))
            low = old[run_at] + size[old[run_at]] - moved
            target = np.repeat(low - run_at, moved) + np.arange(len(old))
            # The places take the highest slots of their old group; those that
            # lay there fill the slots that become free.
            moving[places] = True
            there, here = order[target], np.sort(slot[places])
            taken = np.zeros(0, np.int64)
            stay = there[~moving[there]]
            if len(stay):
                taken = np.setdiff1d(here, target, assume_unique=True)
                order[taken], slot[stay] = stay, taken
            order[target], slot[places] = places, target
            moving[places] = False
            new = run | np.concatenate(([True], times[1:] != times[:-1]))
            new_at = np.flatnonzero(new)
            many = np.diff(np.append(new_at, len(old)))
            size[old[run_at]] -= moved
            size[target[new_at]] = many
            group[places] = np.repeat(target[new_at], many)
        end[active] = first
        active = active[end[active] > base[active] + 1]

    out = np.full(n, -1, np.int64)
    filled = np.zeros(n, np.int64)
    placed = np.zeros(n, bool)
    last = base + lengths - 1
    out[base], placed[last] = last, True
    begins = np.sort(lengths)[::-1]  # texts by length, the longest first
    heads = base[np.argsort(-lengths, kind="stable")]
    many = len(lengths)
    for k in range(int(lengths.max(initial=0))):
        while begins[many - 1] <= k:
            many -= 1
        at = out[heads[:many] + k]
        at = at[at > heads[:many]] - 1
        while len(at):
            at = at[~placed[at]]
            g = group[at]
            out[g + filled[g]] = at  # one place a text, so no two meet
            filled[g] += 1
            placed[at] = True
            at = before[at]
            at = at[at >= 0]
    return out


def equal_windows(snippets: list[bytes], owners: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Classes of equal ``width``-byte windows. ``owners`` numbers the text
    (ascending) each snippet belongs to, ``windows`` says how many windows
    count, from the snippet's beginning on. Returns a class number for each
    window, snippet by snippet; classes of two texts never meet."""
    sizes = np.fromiter((len(s) for s in snippets), np.int64, len(snippets))
    ends = np.append(owners[1:] != owners[:-1], True)  # a text's last snippet
    flat = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8).astype(np.int64) + 2
    stop = np.cumsum(sizes + 1) - 1
    flat[stop] = np.where(ends, 0, 1)
    lengths = np.add.reduceat(sizes + 1, np.flatnonzero(np.append(True, ends[:-1])))
    order = suffix_arrays(flat, lengths)
    first = stop - sizes
    total = int(windows.sum())
    number = np.full(len(flat), -1, np.int64)
    at = np.repeat(first - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(total)
    number[at] = np.arange(total)
    owner_of = np.repeat(owners, windows)
    seen = order[number[order] >= 0]
    view = np.lib.stride_tricks.sliding_window_view(flat.astype(np.uint16), width)
    x, y = seen[:-1], seen[1:]
    same = owner_of[number[x]] == owner_of[number[y]]
    for part in range(0, len(x), 1 << 16):
        cut = slice(part, part + (1 << 16))
        near = np.flatnonzero(same[cut]) + part
        same[near] = (view[x[near]] == view[y[near]]).all(axis=1)
    classes = np.empty(total, np.int64)
    classes[number[seen]] = np.concatenate(([0], np.cumsum(~same))) if total else 0
    return classes
