"""Suffix order and common prefixes of a byte text by external induced sorting.

Suffixes are sorted by inducing: those that start a descent-ascent (``starred``) are sorted first, by sorting the pieces
between them, naming equal pieces alike and recursing on the text of names; all others follow by two scans that take the
smallest (largest) suffix so far and insert the one that begins a symbol earlier. The priority queues are one first-in
first-out queue a symbol, because suffixes of equal first symbol are inserted in order; their tuples are (position, common
prefix with the tuple inserted before). Blocks of a queue beyond ``memory`` go to a file, and a large text is a memory map,
so what a scan holds is one block. The common prefix of two tuples inserted one after the other is one more than the
smallest prefix scanned between the two suffixes they come from; prefixes are cut at ``depth``.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

MEMORY, BASE = 256 << 20, 4_000_000


class Queues:
    """First-in first-out queues of (position, prefix) tuples, one a symbol, backed by a file beyond ``memory`` bytes."""

    def __init__(self, memory: int):
        self.memory, self.held, self.blocks = memory, 0, {}
        self.file = None

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        block = (pos, lcp)
        if self.held + pos.nbytes + lcp.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, os.SEEK_END)
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            block = (at, len(pos))
        else:
            self.held += pos.nbytes + lcp.nbytes
        self.blocks.setdefault(symbol, []).append(block)

    def load(self, block, keep: bool) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block[0], np.ndarray):
            if not keep:
                self.held -= block[0].nbytes + block[1].nbytes
            return block
        self.file.seek(block[0])
        pos = np.frombuffer(self.file.read(8 * block[1]), np.int64)
        return pos, np.frombuffer(self.file.read(block[1]), np.uint8)

    def pop(self, symbol: int):
        """Blocks in order, also those pushed meanwhile; small ones are taken together."""
        while symbol in self.blocks:
            now = [self.load(b, False) for b in self.blocks.pop(symbol)]
            yield now[0] if len(now) == 1 else (np.concatenate([p for p, _ in now]), np.concatenate([v for _, v in now]))

    def read(self, symbol: int):
        return [self.load(b, True) for b in self.blocks.get(symbol, [])]

    def close(self) -> None:
        self.blocks = {}
        if self.file is not None:
            self.file.close()


class Scan:
    """What a scan has seen: for each symbol when it was last inserted, for each prefix value when it was last scanned."""

    def __init__(self, symbols: int, depth: int):
        self.depth, self.at = depth, 0
        self.inserted = np.full(symbols, -1, np.int64)
        self.latest = np.full(depth + 1, -1, np.int64)

    def step(self, lcp: np.ndarray, sel: np.ndarray, ch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes ``sel`` of the scanned block insert their predecessors with first symbols ``ch``: their order by symbol
        and the prefix of each with the one inserted before it."""
        order = np.argsort(ch, kind="stable")
        c, a = ch[order], sel[order]
        first = np.ones(len(c), bool)
        first[1:] = c[1:] != c[:-1]
        out = np.zeros(len(c), np.int64)
        if len(c):
            low = np.minimum.accumulate(lcp)
            f = np.flatnonzero(first)
            since = self.inserted[c[f]]
            far = np.searchsorted(np.maximum.accumulate(self.latest), since, "right")  # smallest prefix scanned since then
            out[f] = np.where(since < 0, 0, 1 + np.minimum(far, low[a[f]]))
            r = np.flatnonzero(~first)
            if len(r):
                out[r] = 1 + range_min(lcp, a[r - 1] + 1, a[r] + 1)
            last = np.r_[f[1:] - 1, len(c) - 1]
            self.inserted[c[last]] = self.at + a[last]
        n = len(lcp)
        rev = lcp[::-1]
        values, where = np.unique(rev, return_index=True)
        self.latest[values] = self.at + n - 1 - where
        self.at += n
        return order, np.minimum(out, self.depth).astype(np.uint8)


def range_min(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of a[lo:hi] for each pair, hi > lo, by doubling spans."""
    span = hi - lo
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    row, k = a, 0
    top = int(level.max())
    for k in range(top + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k)])
        if k < top:
            row = np.minimum(row[:len(row) - (1 << k)], row[1 << k:])
    return out


def ascending(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it (the end is smallest)."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    up = np.zeros(n, bool)
    if len(change):
        rises = text[change + 1] > text[change]
        lengths = np.diff(np.r_[-1, change])
        up[:change[-1] + 1] = np.repeat(rises, lengths)
    return up


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of suffixes a and b, known to agree on ``start`` symbols, up to ``depth``."""
    out = np.minimum(start, depth).astype(np.int64)
    n = len(text)
    active = np.flatnonzero(out < depth)
    while len(active):
        i, j = a[active] + out[active], b[active] + out[active]
        ok = (i < n) & (j < n)
        active, i, j = active[ok], i[ok], j[ok]
        active = active[text[i] == text[j]]
        out[active] += 1
        active = active[out[active] < depth]
    return out


def doubled(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a short text of names by doubling, exact for ``depth`` symbols, and adjacent common prefixes."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank.astype(np.int32)], 1
    while width < depth and rank.max(initial=0) < n - 1:
        behind = np.zeros(n, np.int64)
        behind[:max(0, n - width)] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank.astype(np.int32))
        width *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    got = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + got, b + got
        ok = (i < n) & (j < n)
        same = np.zeros(len(got), bool)
        same[ok] = ranks[k][i[ok]] == ranks[k][j[ok]]
        whole = same & (np.minimum(n - i, n - j) >= 1 << k) if k else same
        got += np.where(whole, 1 << k, 0)
    lcp[1:] = np.minimum(got, depth)
    return order, lcp


def induce(text, up, symbols, seeds, seed_lcp, depth, memory, wanted):
    """Both scans. ``seeds``: starred suffixes by symbol, in order. Calls ``wanted(positions, prefixes)`` with runs of
    suffixes of one symbol and kind, in the order of the scans."""
    n = len(text)
    width = int(text.max()) + 1
    runs = None
    if seed_lcp is not None:
        change = np.flatnonzero(text[1:] != text[:-1]) + 1
        runs = np.diff(np.r_[change, n], prepend=0) if len(change) else np.array([n])
        ends = np.r_[change, n]
        run_of = lambda i: ends[np.searchsorted(ends, i, "right")] - i
    at = np.searchsorted(text[seeds], np.arange(width + 1)) if len(seeds) else np.zeros(width + 1, np.int64)
    queue, done = Queues(memory), Queues(memory)
    scan = Scan(width, depth)

    def insert(pos, lcp, keep, ch):
        order, prefix = scan.step(lcp, keep, ch)
        c, p = ch[order], pos[keep][order] - 1
        cuts = np.flatnonzero(np.diff(c)) + 1
        edges = [0, *cuts.tolist(), len(c)]
        for x, y in zip(edges, edges[1:]):
            if y > x:
                queue.push(int(c[x]), p[x:y], prefix[x:y])

    def seed(c):
        return seeds[at[c]:at[c + 1]]

    queue.push(int(text[n - 1]), np.array([n - 1]), np.zeros(1, np.uint8))
    scan.inserted[text[n - 1]] = 0
    scan.at = 1
    for c in symbols:
        last = None
        for pos, lcp in queue.pop(c):
            done.push(c, pos, lcp)
            last = pos[-1]
            keep = np.flatnonzero(pos > 0)
            ch = text[pos[keep] - 1].astype(np.int64)
            k = ch >= c
            insert(pos, lcp, keep[k], ch[k])
        pos = seed(c)
        if len(pos):
            lcp = np.zeros(len(pos), np.uint8) if seed_lcp is None else seed_lcp[at[c]:at[c + 1]].copy()
            lcp[0] = 0 if last is None or runs is None else min(depth, run_of(last), run_of(pos[0]))
            keep = np.flatnonzero(pos > 0)
            insert(pos, lcp, keep, text[pos[keep] - 1].astype(np.int64))
    scan = Scan(width, depth)
    for c in reversed(symbols):
        last = None
        for pos, lcp in queue.pop(c):
            wanted(pos, lcp)
            last = pos[-1]
            keep = np.flatnonzero(pos > 0)
            ch = text[pos[keep] - 1].astype(np.int64)
            k = ch <= c
            insert(pos, lcp, keep[k], ch[k])
        blocks = done.read(c)
        for i in range(len(blocks) - 1, -1, -1):
            pos, lcp = blocks[i]
            after = blocks[i + 1][1][0] if i + 1 < len(blocks) else (0 if last is None or runs is None else min(depth, run_of(last), run_of(pos[-1])))
            pos, lcp = pos[::-1], np.r_[np.uint8(after), lcp[:0:-1]]
            wanted(pos, lcp)
            keep = np.flatnonzero(pos > 0)
            ch = text[pos[keep] - 1].astype(np.int64)
            k = ch < c
            insert(pos, lcp, keep[k], ch[k])
    queue.close()
    done.close()


def suffixes(text: np.ndarray, depth: int, wanted, memory: int = MEMORY, base: int = BASE) -> None:
    """Calls ``wanted(positions, prefixes)`` with runs of neighbours in suffix order (downwards): each prefix is the common
    one with the suffix before it in the run or in the run before, cut at ``depth``. Symbols are small non-negative integers."""
    up = ascending(text)
    starred = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    present = np.flatnonzero(np.bincount(text)).tolist()
    lcp = np.zeros(len(starred), np.uint8)
    if len(starred):
        # sort the pieces between starred suffixes by inducing from their first symbols
        seeds = starred[np.argsort(text[starred], kind="stable")]
        flag = np.zeros(len(text), bool)
        flag[starred] = True
        found: list[np.ndarray] = []
        induce(text, up, present, seeds, None, depth, memory, lambda pos, _: found.append(pos[flag[pos]]))
        pieces = np.concatenate(found)[::-1]
        found.clear()
        del flag, seeds
        place = np.searchsorted(starred, pieces)
        length = (np.r_[starred[1:] + 1, len(text)] - starred)[place]
        new = np.ones(len(pieces), bool)
        new[1:] = (length[1:] != length[:-1]) | (common(text, pieces[:-1], pieces[1:], np.zeros(len(pieces) - 1, np.int64), int(length.max(initial=0))) < length[:-1])
        names = np.empty(len(starred), np.int64)
        names[place] = np.cumsum(new) - 1
        del place, length, pieces
        if new.all():
            order, same = np.argsort(names), np.zeros(len(names), np.int64)
        elif len(names) <= base:
            order, same = doubled(names, depth)
        else:
            runs: list[tuple] = []
            suffixes(names, depth, lambda pos, v: runs.append((pos, v)), memory, base)
            down = np.concatenate([p for p, _ in runs])
            prefix = np.concatenate([v for _, v in runs]).astype(np.int64)
            order, same = down[::-1], np.r_[0, prefix[:0:-1]]
        seeds = starred[order]
        if len(order) > 1:
            i, j = order[:-1], order[1:]
            ahead = np.r_[starred, len(text)]
            advance = ahead[np.minimum(i + same[1:], len(starred))] - starred[i]
            lcp[1:] = common(text, seeds[:-1], seeds[1:], advance, depth)
            del i, j, ahead, advance
        del order, same, names, new, starred
    else:
        seeds = starred
    induce(text, up, present, seeds, lcp, depth, memory, wanted)
