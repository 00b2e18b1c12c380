"""Token counters written in Python, used wherever a ``counter=`` is taken.

The set-up (a compiled pattern, a loaded vocabulary) runs once in every Python worker and
texts arrive in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from holdfast.functions.text import TokenCounter, col

Setup = Callable[[], Callable[[Sequence[str]], Sequence[int]]]
_COUNTERS: dict[str, TokenCounter] = {}


def arrow_counter(setup: Setup) -> TokenCounter:
    """A column counter from ``setup() -> (texts -> counts)``; a null text has a null count."""

    @F.pandas_udf(LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = setup()
        for texts in batches:
            counts = iter(count(texts.dropna().tolist()))
            yield pd.Series([None if text is None else next(counts) for text in texts], dtype="Int64")

    def counter(text: Column | str) -> Column:
        return counted(col(text))

    return counter


def pattern_counter(pattern: str) -> TokenCounter:
    """Matches of a pattern of Python's ``re``, by a worker-side compiled pattern."""

    def setup() -> Callable[[Sequence[str]], Sequence[int]]:
        compiled = re.compile(pattern)
        return lambda texts: [sum(1 for _ in compiled.finditer(t)) for t in texts]

    return arrow_counter(setup)


def register_counter(name: str, counter: TokenCounter) -> None:
    """Add a counter under a name, as a tokenizer is chosen by its name."""
    _COUNTERS[name] = counter


def counter_named(name: str) -> TokenCounter:
    return _COUNTERS[name]
