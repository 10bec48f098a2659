"""Which of the fixed words of all rules occur in a text.

The rules name some 240 words; looking each one up with ``contains`` reads the text 240 times. One
Aho-Corasick pass per text finds all of them and hands back a few bit sets, and the patterns, which stay
built-in expressions, run only where their word occurs. The pass is the only Python step of the scan: it
takes Arrow batches of text and returns 8 bytes per 62 words. Where the executors lack the automaton library,
``automaton=False`` computes the bit sets from ``contains``, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewarden.functions.text import quoted

MARK = "_words"
PER_SET = 62


def _automaton_pass(words: list[str]):
    """The Arrow function; it carries its word list and needs no module of this package on the executors."""
    n_sets, per_set = -(-len(words) // PER_SET), PER_SET

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        import pandas

        automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            automaton.add_word(word, i)
        automaton.make_automaton()
        for texts in batches:
            marks = []
            for text in texts:
                sets = [0] * n_sets
                if text:
                    for i in {i for _, i in automaton.iter(text.lower())}:
                        sets[i // per_set] |= 1 << (i % per_set)
                marks.append(sets)
            yield pandas.Series(marks)

    return F.pandas_udf(find, T.ArrayType(T.LongType()))


def _contains_pass(words: list[str], column: str) -> Column:
    sets = []
    for start in range(0, len(words), PER_SET):
        bits = [
            f"IF(contains({column}, {quoted(w)}), {1 << n}L, 0L)" for n, w in enumerate(words[start:start + PER_SET])
        ]
        sets.append(" | ".join(bits))
    return F.expr(f"array({', '.join(sets)})")


#: Session setting: may executors import the library of the automaton?
AUTOMATON = "spark.sitewarden.automaton"


class WordIndex:
    """A fixed word list (lower case) with a bit per word."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words))
        self._bit = {w: n for n, w in enumerate(self.words)}

    def mark(self, rows: DataFrame, text: str, automaton: bool | None = None) -> DataFrame:
        """Add the bit sets of a text column, by an automaton or, without its library on the executors, by ``contains``.

        Left open, the session setting ``spark.sitewarden.automaton`` (default true) decides, for all scans alike.
        """
        if automaton is None:
            automaton = rows.sparkSession.conf.get(AUTOMATON, "true").lower() == "true"
        if automaton:
            return rows.withColumn(MARK, _automaton_pass(self.words)(F.col(text)))
        lowered = rows.withColumn("_lower", F.lower(F.coalesce(F.col(text), F.lit(""))))
        return lowered.withColumn(MARK, _contains_pass(self.words, "_lower")).drop("_lower")

    def present(self, words: Iterable[str]) -> str:
        """SQL text: does any of the words occur?"""
        masks: dict[int, int] = {}
        for word in words:
            index, bit = divmod(self._bit[word.lower()], PER_SET)
            masks[index] = masks.get(index, 0) | 1 << bit
        tests = [f"({MARK}[{index}] & {mask}L) <> 0" for index, mask in sorted(masks.items())]
        return f"({' OR '.join(tests)})"
