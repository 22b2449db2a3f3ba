"""Encoders against the tokenizers library on awkward texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from depthlake.llm import bpe
from depthlake.llm.vocabularies import encoder

PIECES = ["the", " The", "Don't", "'s", "can't", " ", "  ", "\n", "\n\n", "\t", " \n ", "\r\n", "x" * 50, "été", "Straße", "İstanbul", "ΟΔΟΣ", "é", " ́a", " ", " ", "　", "\x85", "\x1c", "\x00", "日本語", "😀", "१२", "123", "4.5", "...", "?!", "<|endoftext|>", " <|endoftext|>", "<|startoftext|>", "<|endof", "_a_", "a_b", "ª", "µ", "|", "***", "ǅ", "ﬁ", "​", "﻿"]


def texts(n: int = 1500) -> list[str]:
    rng = random.Random(1)
    out = ["", " ", "\n", "a", " a", "a ", "  a", "a  ", "\x00", "a\x00 b"]
    return out + ["".join(rng.choice(PIECES) + rng.choice(["", " ", ""]) for _ in range(rng.randint(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("name, keeps_spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_encode_as_the_library_does(name, keeps_spaces):
    own, path = texts(), public_tokenizers.path(name)
    ids, at = encoder(path, keeps_spaces).encode(pa.array(own))
    for i, found in enumerate(Tokenizer.from_file(path).encode_batch(own, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == found.ids, repr(own[i])


def test_transducer_and_merges_encode_as_the_library_does():
    own, path = texts(), public_tokenizers.path("byte_bpe_50k.json")
    library, words = Tokenizer.from_file(path), ["the", " The", "\n", " été", "a", " a", "a_b", " the"]
    lexicon = bpe.compile_words([x.encode() for x in words], bpe.merges(path).encode(words))
    found = bpe.Encoder(path, lexicon)
    ids, at = found.encode(pa.array(own))
    decoded = found.merges.decode(ids, at)
    for i, x in enumerate(library.encode_batch(own, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == x.ids, repr(own[i])
        assert decoded[i].decode() == library.decode(x.ids, skip_special_tokens=False) == own[i]


def test_automaton_accepts_its_words_alone_and_shares_suffixes():
    words = [b"walking", b"talking", b"walk", b"talk", b"w", b"king", b" walking"]
    lexicon = bpe.compile_words(words, [[i] for i in range(len(words))])
    asked = [x.decode() for x in words] + ["", "wal", "walkings", "x", "kin"]
    number = bpe.look_up(lexicon, pa.array(asked))
    assert sorted(number[: len(words)].tolist()) == list(range(len(words))) and (number[len(words) :] == -1).all()
    assert [int(lexicon["flat"][lexicon["starts"][n]]) for n in number[: len(words)]] == list(range(len(words)))
    assert len(lexicon["ends"]) < 2 + sum(map(len, words)) - 10


def test_decoding_what_is_not_text():
    found = bpe.merges(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = found.encode(["日本"])[0][:2]
    assert found.decode(np.array(ids), np.array([0, len(ids)]))[0].decode() == library.decode(ids, skip_special_tokens=False)


def test_long_words_merge_as_the_library_does_and_in_time():
    import time

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, found, rng = Tokenizer.from_file(path), bpe.merges(path), random.Random(4)
    for letters, n in (("ab", 700), ("a", 999), ("thenarion", 5000), ("".join(map(chr, range(97, 123))) + "é日", 3000)):
        word = "".join(rng.choice(letters) for _ in range(n))
        assert found.merge([word.encode()])[0] == library.encode(word, add_special_tokens=False).ids
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(1_000_000))
    began = time.process_time()
    ids = found.merge([word.encode()])[0]
    assert time.process_time() - began < 5
    assert found.decode(np.array(ids), np.array([0, len(ids)]))[0].decode() == word


def test_frequent_words(spark):
    words = [f"w{i}" for i in range(300)]
    text = " ".join([*words, *words[:40], *words[:9] * 2000])
    counted = lambda n: bpe.frequent_words(spark.createDataFrame([(text,), (None,)], "text string"), n)
    assert set(counted(8)) <= {f" {w}" for w in words[:9]} and len(counted(9)) == 9
    assert {x.strip() for x in counted(40)} == set(words[:40]) and len(counted(1000)) == 301  # the first word, without a space, is one of its own
    assert 40 <= len(counted(200)) <= 200


def test_memory_of_two_generations():
    from depthlake.llm.shared import Remembered

    asked = []

    def new(strings):
        asked.extend(strings)
        return np.arange(len(strings))[::-1], np.array([len(x) for x in strings[::-1] for _ in range(len(x))], np.uint32), np.array([len(x) for x in strings[::-1]], np.int64)

    memory, rng = Remembered(new, 2000), random.Random(5)
    for _ in range(50):
        own = ["x" * rng.randint(0, 12) for _ in range(10)] + ["y" * rng.randint(0, 90)]
        ids, lengths = memory.ids(pa.array(own))
        assert lengths.tolist() == [len(x) for x in own] and ids.tolist() == [len(x) for x in own for _ in x]
    assert len(set(asked)) < len(asked) < 200 and memory.ids(pa.array([], pa.string()))[0].tolist() == []
