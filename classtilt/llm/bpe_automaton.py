"""A byte-pair-encoding vocabulary compiled to a deterministic transducer, state by state as texts need it.

For every prefix of a text exactly one token can be the last of its encoding: the one that is compatible with the last
token of the shorter prefix that it leaves. Whether two tokens may stand side by side is asked of the merge rules
themselves (the pair, merged from scratch, must come out as the same pair) and remembered.

A state is what the future can still depend on: the longest suffix that some longer token starts with, and for each
place inside it the last token there with its token count relative to the present place. Suffixes are bounded by the
longest token, so states are finitely many; each transition carries the number of tokens by which the count of the
prefix changes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable

import numpy as np

START = -1  # the place before the first byte
NONE = -2  # no token ends here

Rank = Callable[[bytes, bytes], int | None]


def merge(symbols: Iterable[bytes], rank: Rank) -> list[bytes]:
    """Merge the adjacent pair of the lowest rank, the leftmost of equals, until none has a rank."""

    parts = list(symbols)
    while len(parts) > 1:
        ranks = [rank(a, b) for a, b in zip(parts, parts[1:])]
        known = [r for r in ranks if r is not None]
        if not known:
            break
        i = ranks.index(min(known))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def _packed(tail: bytes, places: Iterable[tuple[int, int, int]]) -> bytes:
    flat = [x for place in places for x in place]
    return struct.pack(f"<{len(flat)}i", *flat) + tail + len(flat).to_bytes(2, "little")


def _unpacked(key: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    n = int.from_bytes(key[-2:], "little")
    flat = struct.unpack_from(f"<{n}i", key)
    return key[4 * n : -2], list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))


class PrefixTransducer:
    """``tokens``: bytes to id. ``split``: bytes to the symbols that merging starts from.

    Transitions lie in arrays, a row per state and a column per byte that has occurred, and many chunks are run side by
    side: one step takes the next byte of all chunks that are not at their end. When what is held exceeds ``room`` bytes
    (``spines``, at most one entry a token, apart), it is forgotten before the next run.
    """

    def __init__(
        self,
        tokens: dict[bytes, int],
        rank: Rank,
        split: Callable[[bytes], Iterable[bytes]],
        counting: bool,
        room: int = 192 << 20,
    ):
        self.tokens, self.rank, self.split, self.counting, self.room = tokens, rank, split, counting, room
        self.spelled = {i: t for t, i in tokens.items()}
        self.sizes = np.zeros(max(tokens.values()) + 1, np.int64)
        for t, i in tokens.items():
            self.sizes[i] = len(t)
        self.longer = {t[:k] for t in tokens for k in range(1, len(t))}
        self.spines: dict[int, tuple | None] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states and pairs. What is forgotten is compiled again when it is needed."""

        # A state: its tail, and (offset in the tail, last token there, relative count) of the places that matter, packed.
        start = _packed(b"", [(0, START, 0)])
        self.keys, self.states = [start], {start: 0}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.width = 64
        self.column = np.full(256, -1, np.int32)
        self.hops = np.full(4096 * self.width, -1, np.int32)
        self.last = np.full(4096, NONE, np.int32)

    def held(self) -> int:
        """About the bytes that states and pairs take: the table, and what Python needs for a key and for a pair."""

        return self.hops.nbytes + 250 * len(self.keys) + 200 * len(self.pairs)

    def _grow(self, rows: int, width: int) -> None:
        if width == self.width:  # rows are added in place
            old = len(self.hops)
            self.hops.resize(rows * width, refcheck=False)
            self.hops[old:] = -1
        else:
            hops = np.full(rows * width, -1, np.int32)
            hops.reshape(rows, width)[: len(self.last), : self.width] = self.hops.reshape(-1, self.width)
            self.hops, self.width = hops, width
        last = np.full(rows, NONE, np.int32)
        last[: len(self.last)] = self.last
        self.last = last

    def spines_of(self, token: int) -> tuple[list[tuple[bytes, float]], list[tuple[bytes, float]]] | None:
        """How the token's left and right edges grow while its bytes are merged: (part at the edge, rank that made it).

        None if the token is not what its bytes merge to, or if a part of it was made by a higher rank than the whole:
        then ranks do not tell the order of events and the pair has to be merged from scratch.
        """

        if token in self.spines:
            return self.spines[token]
        made: dict[bytes, tuple[bytes, bytes, float]] = {}

        def rank(a: bytes, b: bytes) -> int | None:
            r = self.rank(a, b)
            if r is not None:
                made.setdefault(a + b, (a, b, r))
            return r

        whole, found = self.spelled[token], None
        if merge(self.split(whole), rank) == [whole]:
            stack, ordered = [(whole, float("inf"))], True
            while stack:
                part, above = stack.pop()
                if part in made:
                    a, b, r = made[part]
                    ordered &= r < above
                    stack += [(a, r), (b, r)]
            if ordered:
                found = ([], [])
                for side, edge in enumerate(found):
                    part = whole
                    while part in made:
                        edge.append((part, made[part][2]))
                        part = made[part][side]
                    edge.append((part, -1.0))
                    edge.reverse()
        self.spines[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, merged from their symbols, come out as they are.

        Their edges are followed in the order of ranks: the pair fails if the parts that touch have a rank which comes
        before the next merge on either side (of equal ranks the leftmost comes first).
        """

        pair = (left, right)
        known = self.pairs.get(pair)
        if known is not None:
            return known
        one, two = self.spines_of(left), self.spines_of(right)
        if one is None or two is None:
            a, b = self.spelled[left], self.spelled[right]
            known = merge(self.split(a + b), self.rank) == [a, b]
        else:
            ends, begins = one[1], two[0]
            i = j = 0
            known, never = True, float("inf")
            while True:
                up_left = ends[i + 1][1] if i + 1 < len(ends) else never
                up_right = begins[j + 1][1] if j + 1 < len(begins) else never
                meet = self.rank(ends[i][0], begins[j][0])
                if meet is not None and meet < up_left and meet <= up_right:
                    known = False
                    break
                if up_left == up_right == never:
                    break
                if up_left <= up_right:
                    i += 1
                else:
                    j += 1
        self.pairs[pair] = known
        return known

    def own(self, token: int) -> bool:
        """Whether the token's bytes encode to the token itself, as they must at the start of a text."""

        known = self.pairs.get((START, token))
        if known is None:
            t = self.spelled[token]
            known = self.pairs[(START, token)] = merge(self.split(t), self.rank) == [t]
        return known

    def compile(self, state: int, byte: int) -> None:
        """Fill in the transition of a state on a byte: the next state and the change of the token count."""

        old_tail, places = _unpacked(self.keys[state])
        text = old_tail + bytes((byte,))
        last, count, kept = NONE, 0, []
        for place in places:
            at, before, so_far = place
            rest = text[at:]
            if last == NONE:
                token = self.tokens.get(rest)
                if token is not None and (self.own(token) if before == START else self.compatible(before, token)):
                    last, count = token, so_far + 1
            if rest in self.longer:
                kept.append(place)
        cut_at = kept[0][0] if kept else len(text)
        back = count if self.counting else 0
        kept = [(at - cut_at, token, n - back) for at, token, n in kept]
        if last != NONE:
            kept.append((len(text) - cut_at, last, 0))
        key = _packed(text[cut_at:], kept)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
            if found >= len(self.last):
                self._grow(len(self.last) * 5 // 4, self.width)
            self.last[found] = last
        change = count if self.counting else 0
        self.hops[state * self.width + self.column[byte]] = found << 8 | change + 128

    def run(
        self,
        data: np.ndarray,
        starts: np.ndarray,
        sizes: np.ndarray,
        lasts: np.ndarray | None = None,
        closing: int | None = None,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and last tokens of the chunks ``data[start : start + size]``, each with ``closing`` after it.

        ``lasts`` gets the last token of every prefix, at the prefix's last byte.
        """

        if self.held() > self.room:
            self.clear()
        present = np.bincount(data, minlength=256) > 0
        if closing is not None:
            present[closing] = True
        for byte in np.flatnonzero(present & (self.column < 0)):
            self.column[byte] = (self.column >= 0).sum()
        if (used := int((self.column >= 0).sum())) > self.width:
            self._grow(len(self.last), min(256, max(used, 2 * self.width)))
        columns = self.column[data]
        longest = int(sizes.max(initial=0))
        short = sizes.astype(np.uint16) if longest < 1 << 16 else sizes
        order = np.argsort(short, kind="stable")[::-1]
        at, left = starts[order].astype(np.int64), sizes[order]
        open_at = len(left) - np.searchsorted(left[::-1], np.arange(longest), side="right")
        state, totals = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)

        def hop(m: int, column: np.ndarray, byte_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            found = self.hops[state[:m].astype(np.int64) * self.width + column]
            if (found.min(initial=0)) < 0:
                missing = np.flatnonzero(found < 0)
                for pair in np.unique(state[missing].astype(np.int64) << 8 | byte_of(missing)).tolist():
                    self.compile(pair >> 8, pair & 255)
                found = self.hops[state[:m].astype(np.int64) * self.width + column]
            if self.counting:
                totals[:m] += (found & 255) - 128
            state[:m] = found >> 8
            return state[:m]

        for k, m in enumerate(open_at.tolist()):
            place = at[:m] + k
            now = hop(m, columns[place], lambda rows, place=place: data[place[rows]])
            if lasts is not None:
                lasts[place] = self.last[now]
        if closing is not None:
            hop(len(at), self.column[closing], lambda rows: np.full(len(rows), closing))
        counts, finals = np.empty_like(totals), np.empty_like(totals)
        counts[order], finals[order] = totals, self.last[state]
        return counts, finals

    def recover(
        self, lasts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, finals: np.ndarray | None = None
    ) -> None:
        """Write each token's id into ``ids`` where it begins: from the chunks' ends back over whole tokens.

        ``finals`` are the last tokens of chunks that were run with a closing byte, which lies in no place of ``ids``.
        """

        at, stop = starts + sizes, starts
        token, closing = (lasts[at - 1], 0) if finals is None else (finals, 1)
        while len(at):
            if token.min() < 0:
                raise ValueError("no encoding ends here")
            at = at + closing - self.sizes[token]
            closing = 0
            ids[at] = token
            going = at > stop
            at, stop = at[going], stop[going]
            token = lasts[at - 1]
