"""Errors of a predicate: a code, the place, what to say, and what to write instead."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Diagnostic:
    code: str
    start: int
    end: int
    message: str = ""
    rewrites: tuple[tuple[int, int, str], ...] = field(default=())  # start, end, replacement

    def marked(self, text: str) -> str:
        return text[self.start : self.end]

    def rewritten(self, text: str) -> list[str]:
        return [text[:a] + new + text[b:] for a, b, new in self.rewrites]

    def render(self, text: str) -> str:
        """The message over the line it is about, with carets under the place."""
        begin = text.rfind("\n", 0, self.start) + 1
        end = text.find("\n", self.start)
        line = text[begin : len(text) if end < 0 else end]
        carets = " " * (self.start - begin) + "^" * max(1, min(self.end, begin + len(line)) - self.start)
        tries = "".join(f"\n  try: {x}" for x in self.rewritten(text))
        return f"{self.code}: {self.message}\n  {line}\n  {carets}{tries}"


class PredicateError(ValueError):
    """A predicate that can't be compiled; `diagnostics` has every error found, in order of the text."""

    def __init__(self, text: str, diagnostics: list[Diagnostic]):
        self.text = text
        self.diagnostics = sorted(diagnostics, key=lambda d: (d.start, d.end))
        super().__init__("\n".join(d.render(text) for d in self.diagnostics))


def closest(written: str, known: list[str]) -> str | None:
    """The known name least far from the written one, by insertions, deletions, changes and swaps of neighbours."""
    limit = 1 + (len(written) > 3) + (len(written) > 6)
    scored = [(edits(written.lower(), k.lower()), i, k) for i, k in enumerate(known)]
    best = min(scored, default=(limit + 1, 0, None))
    return best[2] if best[0] <= limit else None


def edits(a: str, b: str) -> int:
    """Optimal string alignment distance, row by row."""
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            new.append(cost)
        older, old = old, new
    return old[-1]
