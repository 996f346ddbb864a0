"""A compressed FM-index of word sequences, and matching statistics by backward search.

The Burrows-Wheeler transform of the sequences lies in a Huffman-shaped wavelet tree, level by level in bit vectors with a count per 64 bits, so that it takes
about its zero-order entropy; neither the sequences nor a suffix array are kept. Suffixes are sorted to ``depth`` words, which is as long as patterns get.
Searches run for many sequences at once, one backward step of all per numpy call.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are set."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code for symbols met counts (positive) times."""
    n = len(counts)
    if n == 1:
        return np.ones(1, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    leaves, made = counts[order].tolist(), []
    parent = np.zeros(2 * n - 1, dtype=np.int64)
    leaf = node = 0
    for k in range(n - 1):  # two queues: leaves by count, and sums, which come out rising
        total = 0
        for _ in range(2):
            if leaf < n and (node == len(made) or leaves[leaf] <= made[node]):
                total += leaves[leaf]
                parent[leaf] = n + k
                leaf += 1
            else:
                total += made[node]
                parent[n + node] = n + k
                node += 1
        made.append(total)
    depth = np.zeros(2 * n - 1, dtype=np.int64)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    out = np.empty(n, dtype=np.int64)
    out[order] = depth[:n]
    return out


class WaveletTree:
    """rank of any symbol in a sequence of symbols 0 to n - 1, each of which occurs."""

    def __init__(self, sequence: np.ndarray, n: int) -> None:
        lengths = code_lengths(np.bincount(sequence, minlength=n))
        order = np.lexsort((np.arange(n), lengths))
        codes = np.zeros(n, dtype=np.int64)
        code = last = 0
        for symbol, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
            code <<= length - last
            codes[symbol], last = code, length
            code += 1
        deepest = last
        self.lengths = lengths
        aligned = codes << (deepest - lengths)
        self.levels = []
        current = sequence
        for level in range(deepest):
            live = np.flatnonzero(lengths > level)
            prefix = aligned[live] >> (deepest - level)
            bit = (aligned >> (deepest - level - 1)) & 1
            keys, which = np.unique(prefix, return_inverse=True)
            node = np.zeros(n, dtype=np.int64)
            node[live] = which
            held = current[lengths[current] > level]  # in the order of nodes, and in each in the order of the sequence
            nodes, ones = node[held], bit[held]
            sizes = np.bincount(nodes, minlength=len(keys))
            first = np.cumsum(sizes) - sizes
            bits = Bits(ones)
            start = first[node].astype(np.int32)
            self.levels.append((bits, start, bits.rank(start.astype(np.int64)).astype(np.int32), bit.astype(bool)))
            run = np.cumsum(ones)
            before = run - ones - np.concatenate(([0], run))[first][nodes]
            zeros = sizes - np.bincount(nodes, weights=ones, minlength=len(keys)).astype(np.int64)
            place = first[nodes] + np.where(ones == 1, zeros[nodes] + before, np.arange(len(held)) - first[nodes] - before)
            current = np.empty_like(held)
            current[place] = held

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first ``at`` entries."""
        at = at.astype(np.int64)
        lengths = self.lengths[symbol]
        live = np.arange(len(symbol))
        for level, (bits, start, before, bit) in enumerate(self.levels):
            live = live[lengths[live] > level]
            if not len(live):
                break
            symbols, inside = symbol[live], at[live]
            ones = bits.rank(start[symbols] + inside) - before[symbols]
            at[live] = np.where(bit[symbols], ones, inside - ones)
        return at


class FmIndex:
    """Index of sequences (flat symbols from 1 on, lengths), each standing for ``weights`` places of the corpus."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, weights: np.ndarray, depth: int) -> None:
        self.depth = depth
        text = np.insert(flat, np.cumsum(lengths), 0)  # a separator behind each sequence
        self.symbols = int(text.max(initial=0)) + 1
        order, ranks = _sorted(text, depth)
        self.lcp = _common(text, order, ranks, depth)
        first = self.lcp[:-1] < depth - 1  # where suffixes differ from the one before in their first depth - 1 words
        first[:1] = True
        self.marks = Bits(first)
        self.groups = np.append(np.flatnonzero(first), len(text))
        counts = np.bincount(text, minlength=self.symbols)
        self.before = np.cumsum(counts) - counts
        self.tree = WaveletTree(text[order - 1], self.symbols)
        weight = np.repeat(weights, lengths + 1)
        self.weight = np.concatenate(([0], np.cumsum(weight[order])))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol put before them."""
        both = self.before[np.concatenate((symbol, symbol))] + self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return both[: len(symbol)], both[len(symbol) :]

    def matching_statistics(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each place of the indexed sequences: how many words from there on are found at another place too, up to depth.

        Places from which no depth words are left in the sequence, or that a later place's match excludes, may be given less.
        """
        found = np.zeros(len(flat), dtype=np.int32)
        begin = np.cumsum(lengths) - lengths
        right = begin + lengths
        left = right.copy()
        low, high = np.zeros(len(lengths), dtype=np.int64), np.full(len(lengths), len(self.lcp) - 1, dtype=np.int64)
        live = np.arange(len(lengths))
        while True:
            live = live[(right[live] - begin[live] >= self.depth) & (left[live] > begin[live])]
            if not len(live):
                return found
            whole = live[right[live] - left[live] == self.depth]  # the last word goes before another comes
            right[whole] -= 1
            group = self.marks.rank(low[whole] + 1)
            low[whole], high[whole] = self.groups[group - 1], self.groups[group]
            left[live] -= 1
            low[live], high[live] = self.step(flat[left[live]], low[live], high[live])
            alone = self.weight[high[live]] - self.weight[low[live]] < 2
            there, other = live[~alone], live[alone]
            found[left[there]] = np.maximum(found[left[there]], right[there] - left[there])
            # Found nowhere else: its neighbours in the order tell how much of it is; the search goes on with what can end there.
            shared = np.maximum(self.lcp[low[other]], self.lcp[low[other] + 1]).astype(np.int64)
            found[left[other]] = np.maximum(found[left[other]], shared)
            right[other] = left[other] = left[other] + shared
            low[other], high[other] = 0, len(self.lcp) - 1


def _sorted(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Places in the order of their first depth words (ties: by place), and ranks by the first 1, 2, 4... words."""
    rank, width = text.astype(np.int64), 1
    ranks = [(1, rank)]
    order = np.argsort(rank, kind="stable") if depth == 1 else None
    while width < depth:
        ahead = min(width, depth - width)
        later = np.zeros_like(rank)
        later[:-ahead] = rank[ahead:] + 1
        key = rank * (int(rank.max()) + 2) + later
        width += ahead
        order = np.argsort(key, kind="stable" if width == depth else "quicksort")
        if width < depth:
            ordered = key[order]
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
            ranks.append((width, rank))
    return order, ranks


def _common(text: np.ndarray, order: np.ndarray, ranks: list[tuple[int, np.ndarray]], depth: int) -> np.ndarray:
    """lcp: words that each place in the order shares with the one before it, up to depth; 0 at both ends."""
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(len(a), dtype=np.int64)
    for width, rank in reversed(ranks):
        room = np.maximum(a, b) < len(text)
        same = np.zeros(len(a), dtype=bool)
        same[room] = rank[a[room]] == rank[b[room]]
        shared += width * same
        a, b = a + width * same, b + width * same
    return np.concatenate(([0], np.minimum(shared, depth), [0])).astype(np.uint8 if depth < 256 else np.int32)
