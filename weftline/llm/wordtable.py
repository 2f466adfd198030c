"""Numbers of words, looked up once a word and added up per text.

Arrow cuts about CHUNK_BYTES of texts at once into words and numbers the distinct ones. A task keeps the words it has met
and a few numbers of each, in columns; each distinct word of a chunk is looked up once, and new ones are measured together.
Beyond ``remembered`` words those go that no second chunk has had since the last time, which costs time only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a task remembers, of some 150 bytes each.
REMEMBERED = 300_000
CHUNK_BYTES = 1 << 22
#: New words measured at once, few enough for their arrays to stay in the processor's cache.
MEASURED = 2_000
#: Rows of an Arrow batch that are Python objects at once.
SLICE = 512


def give_back() -> None:
    """Returns to the system what Arrow and the C library keep of memory that is no longer used."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def bytes_of(strings: pa.Array) -> list[bytes]:
    """The strings, without nulls, as bytes."""
    _, ends, data = strings.buffers()
    at = np.frombuffer(ends, np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist() if len(strings) else [0]
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SLICE rows, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), SLICE):
            yield batch.slice(at, SLICE)
        del batch
        give_back()


class _Places(dict):
    """Word to column; a word that is not there gets the next one and is noted as new."""

    def __init__(self, words=()):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class WordTable:
    """measure: words to their numbers, ``rows`` of them, as an array [rows, words]."""

    def __init__(self, measure: Callable[[list[bytes]], np.ndarray], rows: int, remembered: int = REMEMBERED):
        self.measure, self.rows, self.remembered = measure, rows, remembered
        # Arrow's cut has an empty word at white space on a text's ends; it keeps the first place, and zeros
        self.places = _Places([b""])
        self.columns = np.zeros((rows, 1024), np.float32)
        self.chunks = np.zeros(1024, np.int32)  # that had the word, since words last had to go

    def _forget(self) -> None:
        """Keeps the words that at least two chunks had; at most half of those remembered, those of the most chunks."""
        chunks = self.chunks[: len(self.places)]
        least, room = 2, max(1, self.remembered // 2)
        if np.count_nonzero(chunks >= least) > room:
            least = max(least, int(np.partition(chunks, -room)[-room]) + 1)
        stays = chunks >= least
        stays[0] = True
        columns = self.columns[:, : len(chunks)][:, stays]
        self.places = _Places(list(compress(self.places, stays.tolist())))
        self.columns = np.zeros((self.rows, max(1024, len(self.places))), np.float32)
        self.columns[:, : len(self.places)] = columns
        self.chunks = np.ones(self.columns.shape[1], np.int32)

    def _learn(self) -> None:
        if not (new := self.places.new):
            return
        end = len(self.places)
        if end > self.columns.shape[1]:
            grown, chunks = np.zeros((self.rows, end + end // 2), np.float32), np.zeros(end + end // 2, np.int32)
            grown[:, : self.columns.shape[1]] = self.columns
            chunks[: len(self.chunks)] = self.chunks
            self.columns, self.chunks = grown, chunks
        begin = end - len(new)
        self.chunks[begin:end] = 0
        for at in range(0, len(new), MEASURED):
            part = new[at : at + MEASURED]
            self.columns[:, begin + at : begin + at + len(part)] = self.measure(part)
        self.places.new = []

    def sums(self, texts: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each whole text the sums of its words' numbers [texts, rows], and how many words it has. An array has no nulls."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary())
        sums, n_words = np.zeros((len(texts), self.rows)), np.zeros(len(texts), np.int64)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            if len(self.places) > self.remembered:
                self._forget()
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES)) + 1  # with the text that fills it
            end = min(end, len(texts))
            lists = pc.ascii_split_whitespace(texts.slice(at, end - at).cast(pa.string(), safe=False))
            words = lists.flatten().dictionary_encode()
            distinct = bytes_of(words.dictionary)
            places = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))
            self._learn()
            self.chunks[places] += 1
            word = words.indices.to_numpy()
            text = np.repeat(np.arange(end - at), pc.list_value_length(lists).to_numpy())
            n_words[at:end] = np.bincount(text, (places > 0)[word], end - at)
            for row, numbers in enumerate(self.columns[:, places]):
                sums[at:end, row] = np.bincount(text, numbers[word], end - at)
            at = end
        return sums, n_words
