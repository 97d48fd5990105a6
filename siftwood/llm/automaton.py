"""A generalised suffix automaton over sequences of integers."""

from __future__ import annotations


class SuffixAutomaton:
    """Holds all factors of the sequences added so far; `statistics` streams another sequence through it.

    Sequences carry an owner; after `settle`, `smallest` tells the smallest owner of each state's factors, whatever the order in which they came.
    """

    __slots__ = ("step", "link", "longest", "smallest")

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.longest = [0]
        self.smallest: list = [float("inf")]

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the factors that end at p followed by c."""
        step, link = self.step, self.link
        new = len(step)
        step.append(step[q].copy())
        link.append(link[q])
        self.longest.append(self.longest[p] + 1)
        self.smallest.append(float("inf"))
        link[q] = new
        while p != -1 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    def add(self, sequence: list, owner: int = 0) -> None:
        step, link, longest, smallest = self.step, self.link, self.longest, self.smallest
        last = 0
        for c in sequence:
            q = step[last].get(c)
            if q is not None:
                last = q if longest[q] == longest[last] + 1 else self._split(last, c, q)
                if owner < smallest[last]:
                    smallest[last] = owner
                continue
            new = len(step)
            step.append({})
            link.append(0)
            smallest.append(owner)
            longest.append(longest[last] + 1)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p != -1:
                q = step[p][c]
                link[new] = q if longest[q] == longest[p] + 1 else self._split(p, c, q)
            last = new

    def statistics(self, sequence: list) -> list[int]:
        """For each position, the length of the longest factor that ends there."""
        step, link, longest = self.step, self.link, self.longest
        out, at, n = [], 0, 0
        for c in sequence:
            while at and c not in step[at]:
                at = link[at]
                n = longest[at]
            to = step[at].get(c)
            if to is not None:
                at = to
                n += 1
            out.append(n)
        return out

    def settle(self) -> None:
        """A factor's owners are those of all factors that it ends: owners go up the suffix links, longest first."""
        link, smallest = self.link, self.smallest
        for s in sorted(range(1, len(link)), key=self.longest.__getitem__, reverse=True):
            if smallest[s] < smallest[link[s]]:
                smallest[link[s]] = smallest[s]

    def holders(self, sequence: list, window: int) -> list:
        """For each window of the sequence, the smallest owner that holds it, or None: where the matching statistic reaches the window, the state of
        its last `window` symbols tells.
        """
        step, link, longest, smallest = self.step, self.link, self.longest, self.smallest
        out, at, n = [], 0, 0
        for i, c in enumerate(sequence):
            while at and c not in step[at]:
                at = link[at]
                n = longest[at]
            to = step[at].get(c)
            if to is not None:
                at = to
                n += 1
            if i + 1 < window:
                continue
            if n < window:
                out.append(None)
                continue
            s = at
            while longest[link[s]] >= window:
                s = link[s]
            out.append(smallest[s])
        return out
