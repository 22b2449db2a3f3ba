"""Encoders over files of the tokenizers library, one per Python worker."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import Remembered, byte_letters, cut_at_white_space, cut_before_spaces, flattened, text_bounds

# Letters that are one code point each in lower case and in NFC; marks that no contraction or special token holds.
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
MARKS = r"!#$%&()*+,./:;=?@\[\]^_{}~\\\-|"
#: A simple chunk: a word, with a space before it, and marks after it; or marks alone. Its parts are what pre-tokenizers cut.
PARTS = f"^(?:(?P<word> ?[{LETTERS}]+)(?P<marks>[{MARKS}]*)|(?P<alone> ?[{MARKS}]*))$"


class ChunkEncoder:
    """Ids of texts, chunk by chunk and, for simple chunks, part by part; what is met again is remembered."""

    def __init__(self, cut, lower: bool = False):
        self.cut, self.lower = cut, lower
        self.chunks, self.parts = Remembered(self._new_chunks), Remembered(self._new_parts, 32 << 20)

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of words and of runs of marks."""
        raise NotImplementedError

    def encode_whole(self, chunks: list[str]) -> list[list[int]]:
        """Ids of any chunks."""
        raise NotImplementedError

    def _new_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.arange(len(parts)), *flattened(self.encode_parts(parts))

    def _new_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Simple chunks first, then the others."""
        array = pa.array(chunks, pa.string())
        found = pc.extract_regex(array, PARTS)
        simple = pc.is_valid(found)
        rest = array.filter(pc.invert(simple)).to_pylist()
        found = found.filter(simple)
        word, marks = pc.struct_field(found, "word"), pc.binary_join_element_wise(pc.struct_field(found, "marks"), pc.struct_field(found, "alone"), "")
        places = np.arange(2 * len(found)).reshape(2, -1).T.ravel()  # the first chunk's word and marks, the second chunk's
        parts = pa.concat_arrays([word, marks]).take(pa.array(places))
        ids, lengths = self.parts.ids(pc.utf8_lower(parts) if self.lower else parts)
        more, more_lengths = flattened(self.encode_whole(rest) if rest else [])
        order = np.argsort(~simple.to_numpy(zero_copy_only=False), kind="stable")
        return order, np.concatenate([ids, more]), np.concatenate([lengths.reshape(-1, 2).sum(axis=1), more_lengths])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the n+1 places in it where texts begin and end."""
        lists = self.cut(texts)
        ids, lengths = self.chunks.ids(lists.flatten())
        return ids, text_bounds(lists, lengths)


class LibraryEncoder(ChunkEncoder):
    """Ids from a file of the tokenizers library: parts go to its model, all other chunks whole to encode_batch.

    keeps_spaces: true for byte-level files, where white space is part of the ids; false where it is dropped and letters are lower-cased.
    """

    def __init__(self, path: str, keeps_spaces: bool):
        from tokenizers import Tokenizer

        super().__init__(cut_before_spaces if keeps_spaces else cut_at_white_space, not keeps_spaces)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model, self.letters = self.whole.model, byte_letters()

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        tokenize, letters = self.model.tokenize, self.letters
        space = letters[32]
        return [[t.id for t in tokenize(x.replace(" ", space) if x.isascii() else x.encode().decode("latin-1").translate(letters))] for x in parts]

    def encode_whole(self, chunks: list[str]) -> list[list[int]]:
        return [x.ids for x in self.whole.encode_batch(chunks, add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def encoder(path: str, keeps_spaces: bool) -> LibraryEncoder:
    return LibraryEncoder(path, keeps_spaces)
