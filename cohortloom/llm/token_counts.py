"""Token counts; huge documents are encoded in overlapping chunks that are spliced where both sides provably agree."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, text_of
from .vocabulary import Memo, load

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 32_768
OVERLAP = 512
#: Separators that Python counts as white space and the vocabulary does not.
CONTROLS = re.compile("[\x1c-\x1f]")


@functools.cache
def _memo(tokenizer: str) -> Memo:
    return Memo(lambda new: [e.ids for e in load(tokenizer).encode_batch(new, add_special_tokens=False)])


def stable(text: str, at: int) -> bool:
    """Whether a token boundary at ``at`` holds whatever surrounds it.

    The vocabulary drops white space and takes every digit alone before merging, composes no character with a
    space or an ASCII digit before it, and no special string holds either. So no token crosses a place beside
    white space or, within ASCII, beside a digit.
    """
    left, right = text[at - 1], text[at]
    if CONTROLS.match(left) or CONTROLS.match(right):
        return False
    return left.isspace() or left.isascii() and right.isascii() and (left.isdigit() or right.isdigit())


class Chunk:
    """The tokens of ``text[begin:end]`` with their places in the whole text."""

    def __init__(self, tokenizer, text: str, begin: int, end: int):
        coded = tokenizer.encode(text[begin:end], add_special_tokens=False)
        self.begin, self.end, self.ids = begin, end, coded.ids
        self.spans = [(begin + a, begin + b) for a, b in coded.offsets]
        self.starts = [a for a, _ in self.spans]

    def before(self, at: int) -> int:
        """The number of tokens that start before ``at``."""
        return bisect_left(self.starts, at)


def meeting(text: str, left: Chunk, right: Chunk, after: int) -> int | None:
    """A place in the overlap, past ``after``, where both chunks start a token, that is stable, and from which their
    tokens agree up to the next such place; the one nearest the middle."""
    own = set(left.starts)
    places = [s for s in dict.fromkeys(right.starts) if max(after, right.begin) < s < left.end and s in own and stable(text, s)]
    middle = (max(after, right.begin) + left.end) / 2
    for i in sorted(range(len(places) - 1), key=lambda i: abs(places[i] - middle)):
        a, b = places[i], places[i + 1]
        l, r = slice(left.before(a), left.before(b)), slice(right.before(a), right.before(b))
        if left.ids[l] == right.ids[r] and left.spans[l] == right.spans[r]:
            return a
    return None


def spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text of any length.

    Neighbouring chunks overlap; they are cut at a common stable boundary. Without one the overlap is doubled
    back into the left chunk, and when that is used up the left chunk itself grows.
    """
    left, taken, total = Chunk(tokenizer, text, 0, min(chunk, len(text))), 0, 0
    while left.end < len(text):
        width, at = overlap, None
        while at is None and (begin := max(taken, left.end - width)) > taken:
            right = Chunk(tokenizer, text, begin, min(len(text), begin + max(chunk, 2 * width)))
            at, width = meeting(text, left, right, taken), 2 * width
        if at is None:
            left = Chunk(tokenizer, text, left.begin, min(len(text), left.begin + 2 * (left.end - left.begin)))
            continue
        total += left.before(at) - left.before(taken)
        left, taken = right, at
    return total + len(left.ids) - left.before(taken)


def counts_of(tokenizer: str, texts: list[str], chunk: int, overlap: int) -> np.ndarray:
    """Token counts: documents within one chunk by their words, each distinct word encoded once while it is held."""
    memo, out, cut, per = _memo(tokenizer), np.zeros(len(texts), np.int64), [], []
    for i, text in enumerate(texts):
        own = []
        if len(text) > chunk:
            out[i] = spliced(load(tokenizer), text, chunk, overlap)
        elif CONTROLS.search(text):
            out[i] = len(load(tokenizer).encode(text, add_special_tokens=False).ids)
        else:
            own = text.split()
        cut += own
        per.append(len(own))
    places = memo.places(cut)
    sums = np.concatenate([[0], np.cumsum(memo.lengths[places])])
    return out + np.diff(sums[np.cumsum(per)], prepend=0) if texts else out


def token_counts(
    docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``n_tokens`` (as the library gives them, special strings by its
    default, none added) and ``over_limit``.

    A null or empty text has no bytes and no tokens. Rows are counted one by one, so null and repeated doc_ids
    stay; other columns are not read; an empty table gives an empty result.
    """

    def work(batches):
        for batch, texts in by_size(batches, "text", 1_000_000):
            counts = counts_of(tokenizer, texts, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"]
            )

    text = text_of()
    counted = docs.select(
        F.col("doc_id").cast("bigint"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text")
    ).mapInArrow(work, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
