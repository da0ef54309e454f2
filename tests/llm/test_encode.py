import json
import random

import pytest

from cohortloom.llm import encode
from cohortloom.llm.vocabulary import load, place

NAME = "byte_bpe_50k.json"
PARTS = [
    "a", "Ab", "word", "1", "42", ",", ".", "..", "'s", "'", "é", "ß", "日本", "́", " ", "  ", "\n", "\n\n", "\t", "\r",
    "\x00", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "﻿", "<|endoftext|>", "<|endo", "|>", "𝒳", "½", "²",
]


@pytest.fixture(scope="module")
def coder():
    made = encode.Encoder(NAME)
    assert made.fast is not None
    return made


def direct(text, name=NAME):
    return load(name).encode(text, add_special_tokens=False).ids


def test_random_texts_equal_the_library(coder):
    draw = random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(1, 12))) for _ in range(30_000)] + ["a\tb\tc\nd\n\n"]
    ids, counts = coder.encode(texts)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == direct(text), text
        at += n


def test_odd_texts_equal_the_library(coder, odd):
    for text in odd:
        assert coder.one(text or "").tolist() == direct(text or "")


def test_every_kind_of_character_equals_the_library(coder):
    for first in range(1, 0x30000, 509):
        signs = [chr(c) for c in range(first, first + 509, 7) if not 0xD800 <= c < 0xE000]
        text = " x".join(f"a{c}1{c} {c}{c}a  {c}" for c in signs)
        assert coder.one(text).tolist() == direct(text)


@pytest.mark.parametrize("text", [" " * 30_000, "a" * 200_000, "a1" * 50_000, "\n" * 25_000 + "b", "." * 50_000])
def test_long_runs(coder, text):
    assert coder.one(text).tolist() == direct(text)


def test_end_ids_and_no_texts(coder):
    ids, counts = coder.encode(["a", "", "b c"], 7)
    assert ids.tolist() == direct("a") + [7, 7] + direct("b c") + [7] and counts.tolist() == [2, 1, 3]
    assert [len(x) for x in coder.encode([])] == [0, 0]


def test_other_vocabularies_go_to_the_library():
    assert encode.Encoder("word_bpe_49k.json").fast is None
    assert encode.Encoder("word_bpe_49k.json").one("Ab c").tolist() == direct("Ab c", "word_bpe_49k.json")


@pytest.mark.parametrize("change", ["order", "pair", "space"])
def test_a_vocabulary_that_fails_the_conditions_goes_to_the_library(tmp_path, change):
    with open(place(NAME)) as file:
        made = json.load(file)
    if change == "order":
        made["model"]["merges"][0], made["model"]["merges"][1] = made["model"]["merges"][1], made["model"]["merges"][0]
    elif change == "pair":
        made["model"]["merges"].pop(500)
    else:
        made["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "v.json"
    path.write_text(json.dumps(made))
    other = encode.Encoder(str(path))
    assert other.fast is None and other.one("some words").tolist() == direct("some words", str(path))
