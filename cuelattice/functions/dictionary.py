"""Word lists that classes of changes and errors depend on: a table of (kind, old, new), which callers can replace by their own.

The default, data/zh_hant.csv, is public data for spoken Chinese about trading: words that recognisers confuse, fillers, terms and
titles of windows that are seen in screenshots.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Dictionary:
    homophones: Mapping[str, str]  # known pairs of wrong and right
    scored: Mapping[str, str]  # further pairs that only the scoring of errors knows
    sound_alike: Mapping[str, str]
    by_context: frozenset[tuple[str, str]]  # both are right words: the context decides
    fillers: tuple[str, ...]
    terms: tuple[str, ...]
    near_terms: tuple[str, ...]  # a single wrong character beside one of these is a wrong term
    window_titles: tuple[str, ...]

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str, str]]) -> Dictionary:
        """From rows (kind, old, new); unknown kinds are left out."""
        by: dict[str, dict[str, str]] = {}
        for kind, old, new in rows:
            by.setdefault(kind, {})[old] = new
        get = lambda k: by.get(k, {})
        return cls(get("homophone"), get("homophone_scored"), get("sound_alike"), frozenset(get("by_context").items()), *(tuple(get(k)) for k in ("filler", "term", "near_term", "window_title")))

    @classmethod
    def read(cls, path: str | Path) -> Dictionary:
        with open(path, encoding="utf-8", newline="") as f:
            return cls.of((r["kind"], r["old"], r["new"]) for r in csv.DictReader(f))


DEFAULT = Dictionary.read(Path(__file__).with_name("data") / "zh_hant.csv")
