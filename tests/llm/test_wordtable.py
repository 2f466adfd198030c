from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weftline.llm import wordtable
from weftline.llm.subword import SubwordSoftmax, _sums, buckets_of
from weftline.llm.tokenizing import WordTokenizer, word_bpe_path
from weftline.llm.wordtable import WordTable

ODD = ["Straße,", "ÀÉÞ!!", "ÿÿ", "×", "a×b", "÷", "ª", "µm", "it's", "don'", "'s", "42nd", "水清い川", "İstanbul", "ΑΣ", "Σ", "ΑΣ.", "été", "Ångström", "Kelvin", "!?", "#$%", "x" * 300, "</s>", "a b", "a\x1cb", "naïve--", "Déjà", "é"]
BROKEN = [b"\xe2\x82", b"a\xff", b"\xc3", b"\xc3\x97", b"ab\xe2\x82,"]


def lengths(words):
    return np.array([[len(w) for w in words], [w.count(b"a") for w in words]], float)


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_sums_are_those_of_each_text(monkeypatch, chunk):
    monkeypatch.setattr(wordtable, "CHUNK_BYTES", chunk)
    texts = [b"", b"  ", b"a", b" ab  a\t\n", b"a\x0bb\x0ca\rb", b"a\x1cb a\x85 c\xc2\xa0d", *BROKEN, b"aa " * 100, b"", " ".join(ODD).encode()]
    for given in (texts, pa.array(texts, pa.binary()), pa.array([b"other", *texts], pa.binary()).slice(1)):
        for remembered in (0, 3, 1000):
            sums, n_words = WordTable(lengths, 2, remembered).sums(given)
            assert n_words.tolist() == [len(t.split()) for t in texts]
            assert sums.tolist() == [lengths(t.split()).sum(axis=1).tolist() for t in texts]
    assert [x.shape for x in WordTable(lengths, 2).sums([])] == [(0, 2), (0,)]


def test_frequent_words_are_measured_once_though_the_table_overflows(monkeypatch):
    monkeypatch.setattr(wordtable, "CHUNK_BYTES", 100)
    measured = Counter()

    def measure(words):
        measured.update(words)
        return lengths(words)

    texts = [b" ".join([b"the", b"of", b"and", *(f"rare{i}x{k}".encode() for k in range(15))]) for i in range(60)]
    table = WordTable(measure, 2, remembered=100)
    assert table.sums(texts)[0].tolist() == [lengths(t.split()).sum(axis=1).tolist() for t in texts]
    assert set(measured.values()) == {1} and len(table.places) < 130


def test_counts_of_odd_words_are_the_librarys():
    library, words = Tokenizer.from_file(word_bpe_path()), [w.encode() for w in ODD] + BROKEN
    words += [w + mark for w in words for mark in (b".", b"'", b"?!")]
    want = [len(library.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids) for w in words]
    tokenizer = WordTokenizer(open(word_bpe_path(), encoding="utf-8").read())
    assert tokenizer.word_counts(words).tolist() == [want]
    assert tokenizer.word_counts(words[::-1]).tolist() == [want[::-1]]


def test_logits_of_odd_words_are_means_over_their_buckets():
    words = [w.encode() for w in ODD] + BROKEN
    together, n = buckets_of(words)
    alone = [buckets_of([w])[0] for w in words]
    assert together.tolist() == np.concatenate(alone).tolist() and n.tolist() == [len(x) for x in alone]
    for classes in (2, 3):
        model = SubwordSoftmax(classes)
        want = np.stack([(model.table[x] @ model.weights).mean(axis=0) for x in alone], axis=1)
        assert abs(model.word_logits(words) - want).max() < 1e-6


def test_sums_of_repeated_rows_are_those_of_the_rows_written_out():
    rng = np.random.default_rng(4)
    times, rows = rng.integers(0, 9, 300), rng.standard_normal((300, 8)).astype(np.float32)
    index = rng.integers(0, 50, times.sum())
    assert (_sums(index, rows, 60, times) == _sums(index, np.repeat(rows, times, axis=0), 60)).all()
