"""Many typed texts at once: one automaton finds all that occur, in one pass over each value.

A handful of texts is best left to the JVM, one substring test each.  With hundreds or thousands, tests
for each row and text would dominate; the automaton reads a value once, whatever their number, and also
finds those that overlap.  It is built once a task from the texts, which a user has typed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts from which the automaton is used.
MANY = 64


class Finder:
    """Finds the labels of all texts that occur in a value; it is built in the task that uses it."""

    def __init__(self, texts: dict[str, list[int]]):
        self.texts = texts
        self.machine = None

    def __getstate__(self) -> dict:
        return {"texts": self.texts, "machine": None}

    def built(self):
        if self.machine is None:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for text, labels in self.texts.items():
                if text:
                    self.machine.add_word(text, (len(text), labels))
            self.machine.make_automaton()
        return self.machine

    def found(self, value: str | None) -> set[int]:
        if value is None:
            return set()
        machine, labels = self.built(), set(self.texts.get("", ()))
        if len(machine):
            for found in {id(x): x[1] for _, x in machine.iter(value)}.values():
                labels.update(found)
        return labels

    def starting(self, value: str) -> set[int]:
        """Labels of the texts that the value starts with."""
        machine, labels = self.built(), set(self.texts.get("", ()))
        if len(machine):
            for end, (size, found) in machine.iter(value):
                if size == end + 1:
                    labels.update(found)
        return labels


def labelled(texts: Iterable[tuple[str, int]]) -> Finder:
    known: dict[str, list[int]] = {}
    for text, label in texts:
        known.setdefault(text, []).append(label)
    return Finder(known)


def found_texts(value: Column, texts: list[str]) -> Column:
    """The array of those texts that occur in the value."""
    finder = labelled((t, i) for i, t in enumerate(texts))

    @F.pandas_udf("array<string>")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in values:
            yield pd.Series([[texts[i] for i in sorted(finder.found(v))] for v in part], dtype=object)

    return run(value)


def candidates(value: Column, other: Column, anywhere: Finder, at_start: Finder, rows: list[dict], kind: str) -> Column:
    """The array of ``rows`` whose texts occur in the first value, or open the second."""

    @F.pandas_udf(f"array<{kind}>")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, others in pairs:
            picked = (sorted(anywhere.found(v) | at_start.starting(o)) for v, o in zip(values, others))
            yield pd.Series([[rows[i] for i in some] for some in picked], dtype=object)

    # Not copied into join conditions, where it would run again for each pair.
    return run.asNondeterministic()(value, other)


def tails(text: str) -> list[str]:
    """A text and what follows each of its slashes: what may be left of it below some root."""
    return [text] + [text[i + 1 :] for i, c in enumerate(text) if c == "/" and i + 1 < len(text)]
