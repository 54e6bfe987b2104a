"""All expressions of all rules in one pass over a text."""

from __future__ import annotations

import re

#: A quoted stretch of a line, up to the line's end if it isn't closed.
QUOTED = re.compile(r"\"[^\"\n]*\"?|“[^”\n]*”?")


class Phrases:
    """Finds the phrases of several rules in folded text (lowercase, curly apostrophes straight, quoted stretches left
    out), and the words of other rules in all of the text. A phrase ends where no letter, figure or underline follows; of
    those that begin at one place the longest counts, and those of one rule don't overlap."""

    def __init__(self, phrases: dict[str, tuple[str, ...]], words: dict[str, tuple[str, ...]]):
        self.lists = (phrases, words)
        self.automata: list | None = None

    def __getstate__(self) -> dict:
        return {"lists": self.lists, "automata": None}  # each worker builds its own

    def build(self) -> list:
        import ahocorasick

        out = []
        for lists in self.lists:
            of: dict[str, list[str]] = {}
            for rule, listed in lists.items():
                for p in listed:
                    of.setdefault(p, []).append(rule)
            a = ahocorasick.Automaton()
            for p, rules in of.items():
                a.add_word(p, (p, tuple(rules)))
            if of:
                a.make_automaton()
            out.append(a if of else None)
        return out

    def __call__(self, text: str) -> dict[str, list[str]]:
        return {r: [p for _, p in found] for r, found in self.spans(text).items()}

    def spans(self, text: str) -> dict[str, list[tuple[int, str]]]:
        """The hits of each rule with their places."""
        if self.automata is None:
            self.automata = self.build()
        out: dict[str, list[tuple[int, str]]] = {}
        low = text.lower()
        low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for automaton, folded, more in ((self.automata[0], QUOTED.sub(lambda m: '"' * len(m[0]), low).replace("’", "'"), "_"), (self.automata[1], low, "'")):
            if automaton is None:
                continue
            found, n = [], len(folded)
            for end, (p, rules) in automaton.iter(folded):
                start = end + 1 - len(p)
                before, after = folded[start - 1 : start], folded[end + 1 : end + 2]
                if before.isalnum() or before and before in more or end + 1 < n and (after.isalnum() or after in more):
                    continue
                found.append((start, -end, p, rules))
            free: dict[str, int] = {}
            for start, end, p, rules in sorted(found):
                for r in rules:
                    if start >= free.get(r, 0):
                        out.setdefault(r, []).append((start, p))
                        free[r] = 1 - end
        return out
