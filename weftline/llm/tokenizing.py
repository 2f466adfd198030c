"""Token ids of whole texts with a public tokenizer, a word at a time where its definition allows it.

The tokenizer of word_bpe_49k.json drops white space and never joins across it, so that a text's ids are those of its words
in order. Each task keeps the ids of words it has met. A new word goes to the library: whole, or, if it is
plain letters with ASCII punctuation after them, as the two tokens into which the tokenizer cuts such a
word, straight to the library's merges. Such letters are their own normal form and lower-case one by one,
so that the ids are the same; tests hold both ways against each other. A definition whose normalizer,
pre-tokenizer or model settings are not those of BY_WORD encodes whole texts in the library.
"""

from __future__ import annotations

import json
import re
from codecs import charmap_decode
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from weftline.llm.wordtable import WordTable, bytes_of, give_back

WORD_BPE = "word_bpe_49k.json"
#: Words that a task remembers, of some 130 bytes each; beyond that it starts afresh, which costs time only.
REMEMBERED = 100_000
MARKS = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")
#: The same letters in UTF-8, and how to lower them there: A-Z and, after their first byte, the second bytes of \u00c0 to \u00de.
LETTERS = re.compile(rb"(?:[A-Za-z]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
LOWERED = bytes(b + 32 if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E else b for b in range(256))
#: Stems whose numbers of ids a task remembers, of some 150 bytes each.
COUNTED = 200_000

#: What a definition must say for the words of a text to be encoded apart.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    "truncation": None,
    "padding": None,
}


def splits_into_words(definition: str) -> bool:
    given = json.loads(definition)
    given["model"] = {k: v for k, v in given["model"].items() if k not in ("vocab", "merges")}
    plain = all(re.fullmatch(r"\S+", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in given["added_tokens"])
    return plain and all(given.get(k) == v for k, v in BY_WORD.items())


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next after 255."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


class _Words(dict):
    """Words to their ids; one that is not there is encoded and remembered."""

    def __init__(self, encode: Callable[[bytes], bytes], remembered: int):
        super().__init__()
        self.encode, self.remembered = encode, remembered

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.remembered:
            self.clear()
        found = self[word] = self.encode(word)
        return found


class WordTokenizer:
    """Little-endian ids of UTF-8 texts, ``width`` bytes each."""

    def __init__(self, definition: str, by_word: bool | None = None, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.merges = self.library.model
        size = self.library.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.packed = [i.to_bytes(self.width, "little") for i in range(size)]
        self.by_word = splits_into_words(definition) if by_word is None else by_word
        self.letters = byte_letters()
        self.ids = _Words(self.encode_word, remembered)
        self.parts: dict[str, bytes] = {}
        self.counts: dict[bytes, int] = {}
        self.spelling = "".join(self.letters[b] for b in range(256))

    def _packed(self, ids: list[int]) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def _merged(self, spelt: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.merges.tokenize(spelt)])

    def _part(self, part: str) -> bytes:
        """The ids of one token of plain letters, lower-cased, or of punctuation."""
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found = self.parts[part] = self._merged(spelt)
        return found

    def encode_word(self, word: bytes) -> bytes:
        # the two commonest forms of PLAIN, told without a pattern: ASCII letters, perhaps with one mark after them
        if word.isalpha():
            lower = word.lower()
            return self._merged(word.decode()) if lower == word else self.ids[lower]
        if (stem := word[:-1]).isalpha() and word[-1] in MARKS:
            return self.ids[stem] + self._part(chr(word[-1]))
        if plain := PLAIN.fullmatch(text := word.decode("utf-8", "replace")):
            return self._part(plain[1].lower()) + (self._part(plain[2]) if plain[2] else b"")
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids. Stems are remembered, not the words that only add a mark to one."""
        known, merges, packed = self.ids, self.merges.tokenize, self.packed
        if len(known) + len(words) > known.remembered:
            known.clear()
        out = []
        for word in words:
            found = known.get(word)
            if found is None:
                if word.isalpha():
                    stem, mark = word.lower(), b""
                elif (stem := word[:-1]).isalpha() and word[-1] in MARKS:
                    stem, mark = stem.lower(), self._part(chr(word[-1]))
                else:
                    out.append(known[word])
                    continue
                found = known.get(stem)
                if found is None:
                    found = known[stem] = b"".join([packed[t.id] for t in merges(stem.decode())])
                found += mark
            out.append(found)
        return out

    def word_counts(self, words: list[bytes]) -> np.ndarray:
        """[1, words]: how many ids each word has. They are counted, not made; stems and marks after them are remembered."""
        known, merges, marks = self.counts, self.merges.tokenize, bytes(MARKS)
        if len(known) + 2 * len(words) > COUNTED:
            known.clear()
        out = []
        for word in words:
            # the forms of PLAIN, told without decoding
            stem = word.rstrip(marks)
            if stem.isalpha():
                lower = stem.lower()
            elif LETTERS.fullmatch(stem):
                lower = stem.translate(LOWERED)
            else:
                out.append(len(self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False)))
                continue
            n = known.get(lower)
            if n is None:
                n = known[lower] = len(merges(charmap_decode(lower, "strict", self.spelling)[0]))
            if len(stem) < len(word):
                more = known.get(rest := word[len(stem) :])
                if more is None:
                    more = known[rest] = len(merges(rest.decode()))
                n += more
            out.append(n)
        return np.array(out, np.int64).reshape(1, -1)

    def counter(self) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
        """Whole texts to their numbers of ids and of words; remembers words."""
        if not self.by_word:
            return lambda texts: (np.array([self.count(t) for t in texts], np.int64), np.array([len(t.split()) for t in texts], np.int64))
        table = WordTable(self.word_counts, 1)

        def count(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            sums, n_words = table.sums(texts)
            return np.rint(sums[:, 0]).astype(np.int64), n_words

        return count

    def encode(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._packed(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return b"".join(map(self.ids.__getitem__, text.split()))

    def count(self, text: bytes) -> int:
        return len(self.encode(text)) // self.width

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without nulls), one text after the other, and where each begins, with the end.

        Arrow cuts the texts into words and numbers the distinct ones; each of those is looked up once, and the ids
        are gathered by number.
        """
        kind = np.dtype(f"<u{self.width}")
        if not self.by_word:
            parts = [self.encode(t.as_py().encode()) for t in texts]
            begins = np.cumsum([0, *map(len, parts)]) // self.width
            return np.frombuffer(b"".join(parts), kind), begins
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        place = words.indices.to_numpy()
        ids = self.encode_words(bytes_of(words.dictionary))
        pool = np.frombuffer(b"".join(ids), kind)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // self.width
        of_word = sizes[place]
        ends = np.concatenate([[0], np.cumsum(of_word, dtype=np.int64)])
        # the k-th id of a word lies k places after the word's first in the pool
        at = np.repeat((np.cumsum(sizes, dtype=np.int64) - sizes)[place] - ends[:-1], of_word)
        at += np.arange(ends[-1])
        found = pool[at]
        texts_at = lists.offsets.to_numpy()
        return found, ends[texts_at - texts_at[0]]


class SharedTokenizer:
    """The definition as a broadcast of a few megabytes, whatever the input's size; one tokenizer a task."""

    def __init__(self, spark: SparkSession, path: str):
        definition = Path(path).read_text(encoding="utf-8")
        self.definition, self.by_word = spark.sparkContext.broadcast(definition), splits_into_words(definition)

    def tokenizer(self, remembered: int = REMEMBERED) -> WordTokenizer:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = WordTokenizer(self.definition.value, self.by_word, remembered)
        give_back()  # reading a definition takes twice what its tokenizer keeps
        return made
