"""Token ids of many texts, equal to the tokenizers library's and made with less work where that can be shown.

Merging by rank of the joined bytes, as tiktoken does, and merging by a list of pairs, as the tokenizers library does,
take the same steps if tokens are numbered in the order of their merges and every token, encoded alone, gives itself: two
tokens that lie side by side and join to a third are then always the pair that the list has for it. Both conditions are
checked when a vocabulary is loaded, and so is the pattern that cuts texts. Otherwise the library encodes whole texts.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from .vocabulary import load, place

# Fixed value: the pattern that byte-level vocabularies cut texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text with a longer run of white space goes to the library: the other pattern matcher keeps a stack there.
LONG_SPACE = 10_000


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def usual(made: dict) -> bool:
    """Whether a vocabulary file cuts by PATTERN, byte-level, and changes nothing before."""
    pre, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    bare = not any(t.get(k) for t in made.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    return (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and made.get("normalizer") is None and model.get("type") == "BPE" and plain and bare
    )


def ranks_of(tokenizer, made: dict) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids, or None if merging by rank might differ from merging by the list."""
    if not usual(made):
        return None
    name, vocab = byte_names(), made["model"]["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
    order = [vocab[a + b] for a, b in pairs]
    tokens = list(vocab)
    if order != sorted(order) or len(set(order)) != len(order) or len(order) + 256 != len(tokens):
        return None
    from tokenizers import Tokenizer

    # the merges alone, without the pattern: a token may hold what the pattern cuts
    coded = Tokenizer(tokenizer.model).encode_batch_fast(tokens, add_special_tokens=False)
    if any(e.ids != [vocab[t]] for e, t in zip(coded, tokens)):
        return None
    return {bytes(name[c] for c in token): i for token, i in vocab.items()}


class Encoder:
    """A vocabulary, loaded once per worker."""

    def __init__(self, name: str):
        self.tokenizer, self.fast = load(name), None
        with open(place(name), encoding="utf-8") as file:
            made = json.load(file)
        if ranks := ranks_of(self.tokenizer, made):
            import tiktoken

            special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.special = set(special)

    def one(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if self.fast is None or long_space(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=self.special).astype(np.uint32, copy=False)

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, each followed by ``end_id`` if one is given, and how many each has."""
        each = []
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for text in texts:
            each += [self.one(text), end]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.concatenate([end[:0], *each]), counts[::2] + counts[1::2]


def long_space(text: str) -> bool:
    """Whether a run of LONG_SPACE spaces or more may be in the text."""
    return len(text) > LONG_SPACE and any(
        text[i : i + LONG_SPACE // 2].isspace() for i in range(0, len(text) - LONG_SPACE // 2 + 1, LONG_SPACE // 2)
    )


@functools.cache
def encoder(name: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(name)
