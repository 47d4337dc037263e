"""Generalised suffix automaton of sequences of word numbers, with matching statistics."""

from __future__ import annotations


class SuffixAutomaton:
    """All factors of several sequences. A state is a set of factors that end at the same places; ``length`` is its longest."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: A sequence and the position after one of its words at which the state's factors end.
        self.place: list[tuple[int, int]] = [(-1, 0)]
        #: Sequences (as marked) that a state's longest suffixes complete: (mark, words), longest first.
        self.marked: list[list[tuple[int, int]]] = [[]]
        self._whole: list[tuple[int, list[int]]] = []

    def _new(self, length: int, place: tuple[int, int], next_: dict[int, int] | None = None, link: int = -1) -> int:
        self.next.append(dict(next_ or {}))
        self.link.append(link)
        self.length.append(length)
        self.place.append(place)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._new(self.length[p] + 1, self.place[q], self.next[q], self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, words: list[int], number: int) -> None:
        last = 0
        for k, w in enumerate(words):
            p, q = last, self.next[last].get(w)
            if q is not None:  # the factor is there from another sequence
                last = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
                continue
            last = self._new(self.length[p] + 1, (number, k + 1))
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = last
                p = self.link[p]
            if p < 0:
                self.link[last] = 0
            else:
                q = self.next[p][w]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)

    def mark(self, words: list[int], mark: int) -> None:
        """Words, a factor already, are to be reported wherever they stand; call ``finish`` after the last."""
        self._whole.append((mark, words))

    def finish(self) -> None:
        own: dict[int, list[tuple[int, int]]] = {}
        for mark, words in self._whole:
            s = 0
            for w in words:
                s = self.next[s][w]
            own.setdefault(s, []).append((mark, len(words)))
        self.marked = [[] for _ in self.link]
        for s in sorted(range(len(self.link)), key=lambda s: self.length[s]):
            self.marked[s] = sorted(own.get(s, []), key=lambda x: -x[1]) + (self.marked[self.link[s]] if self.link[s] >= 0 else [])

    def walk(self, words) -> list[tuple[int, int]]:
        """For each word the state and the length of the longest factor that ends there."""
        next_, link, length = self.next, self.link, self.length
        s, n, out = 0, 0, []
        for w in words:
            while s and w not in next_[s]:
                s = link[s]
                n = length[s]
            t = next_[s].get(w)
            if t is None:
                s = n = 0
            else:
                s, n = t, n + 1
            out.append((s, n))
        return out
