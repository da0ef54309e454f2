"""Public tokenizers inside tasks: loaded once per worker, with a bounded memo of short units."""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Callable, Sequence

import numpy as np


def place(name: str) -> str:
    """Where a vocabulary file lies: a path as given, or a name known to the installed vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def load(name: str):
    """The tokenizer of a file, without truncation or padding; one thread per task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(place(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Memo:
    """Token ids of units that no token crosses, each unit encoded once while it is held.

    Beyond ``limit`` units those that were hardly used go; results do not depend on it.
    """

    def __init__(self, encode: Callable[[Sequence[str]], Sequence[Sequence[int]]], limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self.index: dict[str, int] = {}
        self.starts = self.lengths = self.uses = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def trim(self) -> None:
        """Keep what was used most, half of the limit at most, and count anew."""
        least = max(3, int(np.partition(self.uses, -self.limit // 2)[-self.limit // 2]) + 1)
        kept = np.flatnonzero(self.uses >= least)
        units = list(self.index)
        self.flat, self.lengths = self.ids(kept), self.lengths[kept]
        self.starts, self.uses = np.cumsum(self.lengths) - self.lengths, np.zeros(len(kept), np.int64)
        self.index = {units[i]: n for n, i in enumerate(kept.tolist())}

    def places(self, units: list[str]) -> np.ndarray:
        """The place of every unit in ``starts`` and ``lengths``."""
        if len(self.index) > self.limit:
            self.trim()
        found = np.fromiter(map(self.index.get, units, itertools.repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = list(dict.fromkeys(units[i] for i in missing))
            ids = self.encode(new)
            lengths = np.fromiter(map(len, ids), np.int64, len(new))
            first = len(self.flat)
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
            self.flat = np.concatenate([self.flat, flat])
            self.starts = np.concatenate([self.starts, first + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            found[missing] = [self.index[units[i]] for i in missing]
        self.uses = np.bincount(found, minlength=len(self.lengths)) + np.pad(self.uses, (0, len(self.lengths) - len(self.uses)))
        return found

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids of the units one after the other."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[places] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
