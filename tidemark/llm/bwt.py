"""Burrows-Wheeler transforms of text shards, and their merge by iterative interleave refinement."""

from __future__ import annotations

import numpy as np


class ShardTransform:
    """The transform of one shard's bytes, read as a circle, with its suffixes sorted by their first `depth` bytes."""

    def __init__(self, data: np.ndarray, depth: int):
        n = len(data)
        around = np.concatenate((data, data[:8], np.resize(data, max(0, 8 - n))))
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | around[k : k + n]
        self.suffixes = np.argsort(key, kind="stable")
        sorted_ = key[self.suffixes]
        head = np.append(True, sorted_[1:] != sorted_[:-1])
        group = np.cumsum(head) - 1
        rank = np.empty(n, np.int64)
        rank[self.suffixes] = group
        h = 8
        while h < depth:
            size = np.diff(np.append(np.flatnonzero(head), n))
            tied = np.flatnonzero(size[group] > 1)
            if not len(tied):
                break
            rows = self.suffixes[tied]
            # only suffixes that still tie are ordered anew, by what follows their first h bytes
            second = rank[(rows + h) % n]
            order = np.argsort(group[tied] * n + second, kind="stable")
            self.suffixes[tied], second = rows[order], second[order]
            same_group = group[tied][1:] == group[tied][:-1]
            head[tied[1:]] = ~(same_group & (second[1:] == second[:-1]))
            head[tied[0]] = True
            group = np.cumsum(head) - 1
            rank[self.suffixes] = group
            h *= 2
        self.last = data[self.suffixes - 1]
        # the row of the suffix that begins one byte earlier; taken from the suffixes, as those that tie to the full
        # depth stand in no order that the last bytes could tell
        row = np.empty(n, np.int64)
        row[self.suffixes] = np.arange(n)
        self.step_back = row[self.suffixes - 1]


def repeated_intervals(shards: list[ShardTransform], ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which strings of `depth` bytes occur more than once over all shards. ends: for each string the position, in the
    shards' texts laid end to end, right after it (a position after a text is the text's first).

    Returns the positions right after the repeated strings, the number of each one's interval, and for each of `ends` the
    greatest common prefix, read backwards from it, with any other, up to depth. The shards' rows
    are interleaved: round h takes the rows in the order of their first h bytes, deals them stably by the byte that
    goes before, as their transform tells, and steps them back to it, which is their order by h + 1 bytes. Rows
    whose first h bytes are shared form an interval; where neighbours part, their common prefix is shorter than h,
    and a row that is left alone can't be shared at any greater depth: h is its greatest common prefix, and it leaves.
    """
    base = np.concatenate(([0], np.cumsum([len(s.suffixes) for s in shards])))
    last = np.concatenate([s.last for s in shards])
    step = np.concatenate([s.step_back + b for s, b in zip(shards, base, strict=False)]).astype(np.int32)
    suffix = np.concatenate([s.suffixes + b for s, b in zip(shards, base, strict=False)]).astype(np.int32)
    wanted = np.full(len(suffix), -1, np.int32)
    wanted[ends] = np.arange(len(ends), dtype=np.int32)
    name = wanted[suffix]
    row = np.flatnonzero(name >= 0).astype(np.int32)
    name = name[row]
    interval = np.zeros(len(row), np.int32)
    common = np.zeros(len(ends), np.int32)
    for h in range(depth):
        if not len(row):
            break
        byte = last[row]
        order = np.argsort(byte, kind="stable")
        byte, interval = byte[order], interval[order]
        head = np.empty(len(row) + 1, bool)
        head[0] = head[-1] = True
        np.not_equal(byte[1:], byte[:-1], out=head[1:-1])
        head[1:-1] |= interval[1:] != interval[:-1]
        shared = ~(head[:-1] & head[1:])
        common[name[order[~shared]]] = h
        order = order[shared]
        row, name = step[row[order]], name[order]
        interval = np.cumsum(head[:-1], dtype=np.int32)[shared]
    common[name] = depth
    return ends[name], interval, common


def repeated_windows(texts: list[np.ndarray], width: int, shard_bytes: int = 1 << 18) -> list[np.ndarray]:
    """For each text a flag for each of its strings of `width` bytes: whether it occurs more than once in all texts."""
    shards: list[ShardTransform] = []
    held: list[np.ndarray] = []
    starts, at, size = [], 0, 0
    for text in texts:
        starts.append(at)
        held += [text, np.zeros(1, np.uint8)]
        at, size = at + len(text) + 1, size + len(text) + 1
        if size >= shard_bytes:
            shards.append(ShardTransform(np.concatenate(held), width))
            held, size = [], 0
    if held:
        shards.append(ShardTransform(np.concatenate(held), width))
    count = [max(0, len(t) - width + 1) for t in texts]
    if not sum(count):
        return [np.zeros(0, bool) for _ in texts]
    ends = np.concatenate([np.arange(s + width, s + width + c) for s, c in zip(starts, count, strict=True)])
    flag = np.zeros(at + 1, bool)
    found, *_ = repeated_intervals(shards, ends, width)
    flag[found - width] = True
    return [flag[s : s + c] for s, c in zip(starts, count, strict=True)]
