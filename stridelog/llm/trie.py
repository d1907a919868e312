"""Similarity self-join of a few hundred sets with a prefix tree."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    """Elements `start` to `end` of the sequences `low` to `high`, which all begin alike up to `end`."""

    start: int
    end: int
    low: int
    high: int
    shortest: int = 0
    longest: int = 0
    children: list[Node] = field(default_factory=list)


def ordered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets as ascending numbers under one order of all elements: those in most sets first, ties by value.

    Elements that many sets share come first, so similar sets share long beginnings.
    """
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.empty(len(values), np.int64)
    number[np.lexsort((values, -times))] = np.arange(len(values))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(s) for s in np.split(number[place], cuts)], len(values)


def build(sequences: list[np.ndarray]) -> Node:
    """The tree of sequences that are sorted as a whole; chains of single children are one node."""
    lengths = np.array([len(s) for s in sequences])

    def common(i: int, j: int, start: int) -> int:
        a, b = sequences[i][start:], sequences[j][start:]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return start + (int(differ[0]) if len(differ) else n)

    root = Node(0, 0, 0, len(sequences))
    open_ = [root]
    while open_:
        node = open_.pop()
        part = lengths[node.low : node.high]
        node.shortest, node.longest = int(part.min()), int(part.max())
        i = node.low
        while i < node.high and lengths[i] == node.end:
            i += 1  # sequences that end here
        while i < node.high:
            # Sequences with the same next element are neighbours.
            first, j = sequences[i][node.end], i + 1
            while j < node.high and sequences[j][node.end] == first:
                j += 1
            child = Node(node.end, common(i, j - 1, node.end) if j - i > 1 else int(lengths[i]), i, j)
            node.children.append(child)
            if j - i > 1:
                open_.append(child)
            else:
                child.shortest = child.longest = int(lengths[i])
            i = j
    return root


def linked_groups(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """A group number for each set: sets joined by links 100 * common >= percent * union share one.

    Every set walks the tree. The elements it shares with a node's stretch are counted once for all
    sequences below. A subtree is left out if no length in it fits, if what is shared so far plus
    what can still come is too little, or if all of it is in the set's group already.
    """
    group = np.arange(len(sets))
    full = [i for i, s in enumerate(sets) if len(s)]
    if len(full) < 2:
        return group
    numbered, size = ordered([sets[i] for i in full])
    # Big-endian bytes sort like the sequences.
    order = sorted(range(len(full)), key=lambda i: numbered[i].astype(">u4").tobytes())
    sequences = [numbered[i] for i in order]
    root = build(sequences)
    found = np.arange(len(sequences))
    mask = np.zeros(size, bool)
    for i, x in enumerate(sequences):
        mask[x] = True
        n = len(x)
        stack = [(root, 0)]
        while stack:
            node, shared = stack.pop()
            if node.low >= i or node.longest * 100 < percent * n or n * 100 < percent * node.shortest:
                continue
            if (found[node.low : min(node.high, i)] == found[i]).all():
                continue
            if node.end > node.start:
                stretch = sequences[node.low][node.start : node.end]
                shared += int(np.count_nonzero(mask[stretch]))
                left = n - int(np.searchsorted(x, stretch[-1], "right"))
                most = shared + min(left, node.longest - node.end)
                if most * (100 + percent) < percent * (n + node.shortest):
                    continue
            for j in range(node.low, min(node.high, i)):
                if len(sequences[j]) != node.end:
                    break
                if 100 * shared >= percent * (n + node.end - shared):
                    found[found == found[j]] = found[i]
            stack.extend((child, shared) for child in node.children)
        mask[x] = False
    for place, i in enumerate(order):
        group[full[i]] = -1 - found[place]
    return group
