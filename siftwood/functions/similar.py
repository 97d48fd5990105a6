"""Fuzzy equality of strings by matching blocks, with exact bounds that spare most comparisons."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from functools import cached_property, lru_cache
from heapq import heappop, heappush

_Q = 5


def ratio(new: str, old: str) -> float:
    return SequenceMatcher(None, new, old).ratio()


def reaches(matcher: SequenceMatcher | Matcher, threshold: float) -> bool:
    """Whether `matcher.ratio()` is at least `threshold`: its matching blocks, as difflib finds them, until they suffice or what is left can't.

    The widest stretch between blocks comes next; blocks in different stretches don't depend on each other.
    """
    n, m = len(matcher.a), len(matcher.b)
    if not n + m:
        return 1.0 >= threshold
    found, left, stretches = 0, min(n, m), [(-min(n, m), 0, n, 0, m)]
    while stretches and 2.0 * found / (n + m) < threshold <= 2.0 * (found + left) / (n + m):
        width, alo, ahi, blo, bhi = heappop(stretches)
        left += width
        i, j, k = matcher.find_longest_match(alo, ahi, blo, bhi)
        if k:
            found += k
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if width := min(part[1] - part[0], part[3] - part[2]):
                    left += width
                    heappush(stretches, (-width, *part))
    return 2.0 * found / (n + m) >= threshold


@lru_cache(1024)
def _any_of(letters: str) -> re.Pattern:
    return re.compile(f"[{re.escape(letters)}]+")


def _equal(a: str, i: int, b: str, j: int, most: int, way: int = 1) -> int:
    """How many characters, `most` at most, are equal from a[i] and b[j] on; way -1: before them. Slices double and halve."""
    k, step = 0, 16
    while k < most:
        w = min(step, most - k)
        at, to = (k, k + w) if way > 0 else (-k - w, -k)
        if a[i + at : i + to] == b[j + at : j + to]:
            k, step = k + w, 2 * step
        elif w == 1:
            break
        else:
            step = w // 2
    return k


class Matcher:
    """The longest matches that difflib's SequenceMatcher finds between a and b, its popular letters included, in fewer steps.

    A match starts from letters that are not popular in b. They stand in runs, and a run in a no longer than the best match so far can't better it.
    """

    def __init__(self, b: str):
        self.a, self.b, n = "", b, len(b)
        seeds = "".join(sorted(c for c, k in Counter(b).items() if n < 200 or k <= n // 100 + 1))
        self.places: dict[str, list[int]] = {c: [] for c in seeds}
        self.pattern = _any_of(seeds) if seeds else None
        for run in self.pattern.finditer(b) if seeds else ():
            for i, c in enumerate(run[0], run.start()):
                self.places[c].append(i)

    def set_seq1(self, a: str) -> None:
        self.a = a
        self.runs = [run.span() for run in self.pattern.finditer(a)] if self.pattern else []
        self.ends = [end for _, end in self.runs]

    def find_longest_match(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        a, b, places = self.a, self.b, self.places
        besti, bestj, best = alo, blo, 0
        for r in range(bisect_left(self.ends, alo + 1), len(self.runs)):
            lo, hi = self.runs[r]
            if lo >= ahi:
                break
            lo, hi = max(lo, alo), min(hi, ahi)
            lengths: dict[int, int] = {}
            for i in range(lo, hi):
                if hi - lo <= best:
                    break
                at, before, lengths = places[a[i]], lengths, {}
                for j in at[bisect_left(at, blo) : bisect_left(at, bhi)]:
                    k = lengths[j] = before.get(j - 1, 0) + 1
                    if k > best:
                        besti, bestj, best = i - k + 1, j - k + 1, k
        back = _equal(a, besti, b, bestj, min(besti - alo, bestj - blo), -1)
        besti, bestj, best = besti - back, bestj - back, best + back
        return besti, bestj, best + _equal(a, besti + best, b, bestj + best, min(ahi - besti, bhi - bestj) - best)


class _Kept:
    """A kept string; what comparisons need of it is made when the first one does."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def grams(self) -> set[str]:
        return {self.text[i : i + _Q] for i in range(len(self.text) - _Q + 1)}

    @cached_property
    def letters(self) -> Counter:
        return Counter(self.text)

    @cached_property
    def matcher(self) -> Matcher:
        return Matcher(self.text)


class Seen:
    """Strings kept so far; `like` tells whether a string is alike to one of them.

    A ratio of t leaves at most (1 - t) of both lengths unmatched. So the lengths, the letters in common, and the
    shared 5-grams (an unmatched character or a border between blocks breaks at most five) are bounded below, which rejects most strings without a comparison.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.kept: list[_Kept] = []
        self.exact: set[str] = set()

    def add(self, s: str) -> None:
        if s not in self.exact:
            self.exact.add(s)
            self.kept.append(_Kept(s))

    def like(self, s: str, shortest: int = 0) -> bool:
        """shortest: kept strings below this length don't count."""
        t, n = self.threshold, len(s)
        if s in self.exact and n >= shortest:
            return True
        letters = grams = None
        for old in self.kept:
            size = len(old.text)
            total = n + size
            if size < shortest or 2 * min(n, size) < t * total:
                continue
            need = n - _Q + 1 - _Q * (1 - t) * total
            if need > 0:
                grams = grams or [s[i : i + _Q] for i in range(n - _Q + 1)]
                if sum(g in old.grams for g in grams) < need - 1:
                    continue
            letters = letters or Counter(s)
            if 2 * sum((letters & old.letters).values()) < t * total:
                continue
            old.matcher.set_seq1(s)
            if reaches(old.matcher, t):
                return True
        return False
