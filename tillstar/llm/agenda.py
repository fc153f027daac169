"""Byte-pair merging by a score-ordered agenda, many words at a time.

The agenda of a word holds its adjacent symbol pairs that the vocabulary
merges. The best pair (least rank, then leftmost) is merged, the two pairs it
borders are entered anew, and so on until the agenda is empty. Words of equal
length form a matrix whose rows take one step of their agendas together; long
words keep a heap each.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Rank of a pair that does not merge.
NEVER = np.iinfo(np.int32).max
#: Longest word that is a row of a matrix, and symbols of a matrix.
WIDEST, MATRIX_SYMBOLS = 40, 1 << 17


class Merges:
    """The pairs of symbols that merge, with rank and result; an open-addressing table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(int(len(keys) * 4).bit_length(), 4)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.rank = np.full(1 << bits, NEVER, dtype=np.int32)
        self.merged = np.zeros(1 << bits, dtype=np.int32)
        free, waiting, slot = self._keys[0], np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            empty = np.flatnonzero(self._keys[slot[waiting]] == free)
            _, first = np.unique(slot[waiting[empty]], return_index=True)
            placed = waiting[empty[first]]
            self._keys[slot[placed]] = keys[placed]
            self.rank[slot[placed]] = rank[placed]
            self.merged[slot[placed]] = merged[placed]
            left_over = np.ones(len(waiting), dtype=bool)
            left_over[empty[first]] = False
            waiting = waiting[left_over]
            slot[waiting] = (slot[waiting] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table's slot for each pair; that of a pair which never merges has the rank ``NEVER``."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = self._keys[slot]
        free = np.iinfo(np.uint64).max
        open_ = np.flatnonzero(((found != keys) & (found != free)).ravel())
        flat_slot, flat_keys = slot.reshape(-1), keys.reshape(-1)
        while len(open_):
            flat_slot[open_] = (flat_slot[open_] + 1) & self._mask
            found = self._keys[flat_slot[open_]]
            open_ = open_[(found != flat_keys[open_]) & (found != free)]
        return flat_slot.reshape(slot.shape)


def _merge_matrix(symbols: np.ndarray, merges: Merges) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their symbols when nothing merges any more) for words of one length."""
    done, rows = [], np.arange(len(symbols))
    slot = merges.find(symbols[:, :-1], symbols[:, 1:])
    rank = merges.rank[slot]
    while symbols.shape[1] > 1:
        at = rank.argmin(axis=1)
        live = rank[np.arange(len(rows)), at] != NEVER
        if not live.all():
            done.append((rows[~live], symbols[~live]))
            rows, symbols, slot, rank, at = rows[live], symbols[live], slot[live], rank[live], at[live]
            if not len(rows):
                return done
        width, each = symbols.shape[1], np.arange(len(rows))
        symbols[each, at] = merges.merged[slot[each, at]]
        # the pair's second symbol and the pair itself close up
        late = np.arange(width - 1) > at[:, None]
        symbols = np.where(late, symbols[:, 1:], symbols[:, :-1])
        late = late[:, 1:]
        slot, rank = np.where(late, slot[:, 1:], slot[:, :-1]), np.where(late, rank[:, 1:], rank[:, :-1])
        for row, pair in ((np.flatnonzero(at > 0), at - 1), (np.flatnonzero(at < width - 2), at)):
            pair = pair[row]
            fresh = merges.find(symbols[row, pair], symbols[row, pair + 1])
            slot[row, pair], rank[row, pair] = fresh, merges.rank[fresh]
    done.append((rows, symbols))
    return done


def _merge_long(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """One word's symbols when nothing merges any more; the agenda is a heap."""
    slots = merges.find(symbols[:-1], symbols[1:])
    ranks = merges.rank[slots]
    at = np.flatnonzero(ranks != NEVER)
    agenda = list(zip(ranks[at].tolist(), at.tolist(), slots[at].tolist(), symbols[at].tolist(), symbols[at + 1].tolist(), strict=True))
    heapq.heapify(agenda)
    own = symbols.tolist()
    after, before = list(range(1, len(own) + 1)), list(range(-1, len(own) - 1))
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def enter(i: int, j: int) -> None:
        pair = own[i], own[j]
        if pair not in known:
            slot = int(merges.find(np.array([pair[0]]), np.array([pair[1]]))[0])
            known[pair] = int(merges.rank[slot]), slot
        rank, slot = known[pair]
        if rank != NEVER:
            heapq.heappush(agenda, (rank, i, slot, *pair))

    while agenda:
        _, i, slot, left, right = heapq.heappop(agenda)
        j = after[i]
        if own[i] != left or j >= len(own) or own[j] != right:
            continue  # one of the two has merged meanwhile
        own[i], own[j], after[i] = int(merges.merged[slot]), -1, after[j]
        if after[i] < len(own):
            before[after[i]] = i
            enter(i, after[i])
        if before[i] >= 0:
            enter(before[i], i)
    return np.array([s for s in own if s >= 0], dtype=np.int32)


def merge_words(symbols: np.ndarray, ends: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word; words are runs of ``symbols`` up to ``ends``.

    Returns the remaining symbols and the words' new ends.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    borders = np.searchsorted(lengths[order], np.arange(1, WIDEST + 2))
    sizes, finished = np.zeros(len(ends), dtype=np.int64), []
    for length in range(1, WIDEST + 1):
        words = order[borders[length - 1] : borders[length]]
        step = max(MATRIX_SYMBOLS // length, 1)
        for a in range(0, len(words), step):
            some = words[a : a + step]
            matrix = symbols[starts[some][:, None] + np.arange(length)].astype(np.int32)
            for rows, rest in _merge_matrix(matrix, merges) if length > 1 else [(np.arange(len(some)), matrix)]:
                sizes[some[rows]] = rest.shape[1]
                finished.append((some[rows], rest))
    for word in order[borders[WIDEST] :].tolist():
        rest = _merge_long(symbols[starts[word] : ends[word]].astype(np.int32), merges)
        sizes[word] = len(rest)
        finished.append((np.array([word]), rest[None, :]))
    merged_ends = np.cumsum(sizes)
    merged = np.zeros(int(merged_ends[-1]) if len(ends) else 0, dtype=np.int32)
    for words, rest in finished:
        merged[(merged_ends[words] - sizes[words])[:, None] + np.arange(rest.shape[1])] = rest
    return merged, merged_ends
