"""Texts as space-led chunks for byte-level BPE, used by token counts and packing.

The byte-level pattern starts a new pre-token at every blank followed by a non-blank
character, whatever stands before.  So a text may be cut at these blanks, the chunks
tokenised apart, and results per chunk kept in a bounded dictionary.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

# A blank after which the text may not be cut.
_UNSAFE = re.compile(r" (?:\s|$)")
MAX_KEPT_CHARS = 64
MAX_KEPT = 400_000


def chunked(text: str) -> list[str]:
    """The text cut before blanks that precede a non-blank; all but the first part lack that blank."""
    parts = text.split(" ")
    if not _UNSAFE.search(text):
        return parts
    out = parts[:1]
    for part in parts[1:]:
        if not part or part[0].isspace():
            out[-1] += " " + part
        else:
            out.append(part)
    return out


class ChunkTable:
    """Results per chunk.  ``work`` gets the chunks not seen yet, all of one batch together."""

    def __init__(self, work: Callable[[list[str]], Iterable[Any]]):
        self.work = work
        self.led: dict[str, Any] = {}
        self.first: dict[str, Any] = {}

    def results(self, texts: list[str]) -> list[list[Any]]:
        cut = [chunked(t) for t in texts]
        if len(self.led) > MAX_KEPT:
            self.led.clear()
            self.first.clear()
        led, first = self.led, self.first
        new_led = {p for parts in cut for p in parts[1:] if p not in led}
        new_first = {parts[0] for parts in cut if parts[0] not in first}
        new = [*[" " + p for p in new_led], *new_first]
        done = iter(self.work(new)) if new else iter(())
        for p in new_led:
            led[p] = next(done)
        for p in new_first:
            first[p] = next(done)
        out = [[first[parts[0]], *map(led.__getitem__, parts[1:])] for parts in cut]
        for p in [p for p in new_led if len(p) > MAX_KEPT_CHARS]:
            del led[p]
        for p in [p for p in new_first if len(p) > MAX_KEPT_CHARS]:
            del first[p]
        return out


def slices(values: list[str | None], chars: int = 1_000_000) -> Iterable[list[str]]:
    """Texts (null as empty) in lists of about ``chars`` characters, at least one text each."""
    part: list[str] = []
    size = 0
    for v in values:
        text = v or ""
        if part and size + len(text) > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part
