"""Bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with word ends marked) and of itself, all
hashed to one table of buckets; a document is the mean of its words; a linear softmax gives the classes.
Misspelt words that training never met share most n-grams, and so most of their vector.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np

from weftline.llm.wordtable import WordTable

DIM, BUCKETS = 8, 1 << 16
#: Training, as three of the learning folds were told best by the others: many small steps, until the loss learned from is
#: near zero. Stopping at the least loss of rows set aside found a third fewer of the rare class.
EPOCHS, BATCH, RATE = 16, 32, 0.4
#: The mean of the words is scaled before the softmax, so that a few words in a hundred can decide.
SCALE = 40
GRAMS = (3, 4, 5)
#: An odd 64-bit factor of the rolling hash.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lowered, split at ASCII white space."""
    return text.lower().split()


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, lowered and with ends marked, one after the other, and how many each word has."""
    # decoded and lowered as one text of a word a line, no word having a line end; each line end then gives two marks
    text = b"\n".join(words).decode("utf-8", "replace").lower()
    codes = np.frombuffer(f"<{text.replace('\n', '><')}>".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    line_ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10)
    starts = np.concatenate([[0], line_ends + 1]) + np.arange(len(words))
    return codes, np.diff(starts, append=len(codes))


def _hashes(codes: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(0, of each word), then for n of GRAMS (n, of the n code points from each place on), whether in one word or not."""
    power = np.cumprod(np.full(int(size.max()), FACTOR, np.uint64))
    start = np.cumsum(size) - size
    yield 0, np.add.reduceat(codes * power[np.arange(len(codes)) - np.repeat(start, size)], start)
    h, done = codes, 1
    for n in GRAMS:
        if n > len(codes):
            return
        for k in range(done, n):
            h = h[: len(codes) - k] * FACTOR + codes[k:]
        done = n
        yield n, h + np.uint64(n * int(FACTOR) ** n % (1 << 64))


def _placed(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(33)
    return (h % np.uint64(buckets) if buckets & (buckets - 1) else h & np.uint64(buckets - 1)).view(np.int64)


def _within(size: np.ndarray) -> np.ndarray:
    """Of each code point, how many its word has from it on."""
    return np.repeat(np.cumsum(size), size) - np.arange(size.sum())


def buckets_of(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each word, ends marked, and of the word itself: (flat, how many per word)."""
    codes, size = _codes(words)
    within, owner = _within(size), np.repeat(np.arange(len(words)), size)
    owners, hashes = [], []
    for n, h in _hashes(codes, size):
        inside = within[: len(h)] >= n
        owners.append(owner[: len(h)][inside] if n else np.arange(len(words)))
        hashes.append(h[inside] if n else h)
    own, h = np.concatenate(owners), np.concatenate(hashes)
    return _placed(h, buckets).astype(np.int32)[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(words))


class SubwordSoftmax:
    def __init__(self, classes: int, dim: int = DIM, buckets: int = BUCKETS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes, self.buckets = classes, buckets
        self.table = (rng.standard_normal((buckets, dim)) * 0.01).astype(np.float32)
        self.weights = rng.standard_normal((dim, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 2) -> SubwordSoftmax:
        """Adagrad on the log loss of all parameters at once. Without texts all classes are equally likely from then on."""
        self._made = None
        if not texts:
            self.weights[:] = 0
            return self
        vocabulary: dict[bytes, int] = {}
        bags = []
        for text in texts:
            count = Counter(words_of(text))
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in count], np.int32)
            bags.append((ids, np.array(list(count.values()), np.float32)))
        if not vocabulary:
            vocabulary[b""] = 0
        known = list(vocabulary)
        parts = [buckets_of(known[i : i + 20_000], self.buckets) for i in range(0, len(known), 20_000)]  # bounds what is in memory at once
        flat, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        y = np.array(labels)
        self.bias[:] = np.log((np.bincount(y, minlength=self.classes) + 1) / (len(y) + self.classes))
        rng = np.random.default_rng(seed)
        squares: list[np.ndarray] = []
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                # the batch's words, and for each its n-grams' places in flat
                word, inverse = np.unique(np.concatenate([bags[r][0] for r in rows]), return_inverse=True)
                if not len(word):
                    continue
                weight = np.concatenate([bags[r][1] / bags[r][1].sum() for r in rows])
                doc = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
                n = size[word]
                starts = np.cumsum(n) - n
                place = np.arange(n.sum()) + np.repeat(begin[word] - starts, n)
                sub = flat[place].astype(np.intp)  # once, not in each of the sums
                vector = np.add.reduceat(self.table.take(sub, axis=0), starts, axis=0) / n[:, None].astype(np.float32)
                mean = _sums(doc, vector[inverse] * weight[:, None], len(rows))
                mean *= SCALE
                p = _softmax(mean @ self.weights + self.bias)
                p[np.arange(len(rows)), y[rows]] -= 1
                g_logit = p / len(rows)
                g_mean = SCALE * g_logit @ self.weights.T
                g_vector = _sums(inverse, g_mean[doc] * weight[:, None], len(word)) / n[:, None].astype(np.float32)
                g_table = _sums(sub, g_vector, self.buckets, n)
                gradients = (g_table, mean.T @ g_logit, g_logit.sum(axis=0))
                # started at the first gradients' size, so that what occurs seldom moves little
                squares = squares or [np.full_like(g, 4 * np.mean(g[g != 0] ** 2) + 1e-20) for g in gradients]
                for parameter, g, square in zip((self.table, self.weights, self.bias), gradients, squares, strict=True):
                    room = g * g
                    square += room
                    np.sqrt(square, out=room)
                    g *= rate
                    g /= room
                    parameter -= g
        return self

    def word_logits(self, words: list[bytes]) -> np.ndarray:
        """[classes, words]: what each word, A-Z lowered, adds to a document's logits before they are averaged and scaled."""
        codes, size = _codes(words)
        within, logits = _within(size), self._bucket_logits()
        own, sums = None, np.zeros((self.classes, len(codes)), np.float32)
        for n, h in _hashes(codes, size):
            bucket = _placed(h, self.buckets)
            if n:  # added up at the place where each begins; what is not in one word goes to the last bucket, of zeros
                bucket[within[: len(h)] < n] = self.buckets
            found = [of_class.take(bucket) for of_class in logits]
            if not n:
                own = np.stack(found)
                continue
            for into, x in zip(sums, found, strict=True):
                into[: len(h)] += x
        grams = 1 + sum(np.maximum(size - (n - 1), 0) for n in GRAMS)
        return (own + np.add.reduceat(sums, np.cumsum(size) - size, axis=1)) / grams

    def _bucket_logits(self) -> np.ndarray:
        """[classes, buckets + 1]: table @ weights, made once after training, and zeros."""
        if getattr(self, "_made", None) is None:
            self._made = np.zeros((self.classes, self.buckets + 1), np.float32)
            self._made[:, :-1] = (self.table @ self.weights).T
        return self._made

    def of_sums(self, sums: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Class probabilities of texts, from the sums of their words' logits; those of the bias alone if there is no word."""
        return _softmax(SCALE * sums / np.maximum(n_words, 1)[:, None] + self.bias)

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        """Whole texts to class probabilities [texts, classes]; remembers words."""
        table = WordTable(self.word_logits, self.classes)
        return lambda texts: self.of_sums(*table.sums(texts))

    def posterior(self, text: bytes) -> np.ndarray:
        return self.scorer()([text])[0]

    def state(self) -> tuple:
        return self.classes, self.table, self.weights, self.bias

    @classmethod
    def of(cls, state: tuple) -> SubwordSoftmax:
        model = cls.__new__(cls)
        model.classes, model.table, model.weights, model.bias = state
        model.buckets = len(model.table)
        return model


def _sums(index: np.ndarray, rows: np.ndarray, n: int, times: np.ndarray | None = None) -> np.ndarray:
    """Rows, each repeated as often as ``times`` says, added up by index."""
    out = np.empty((n, rows.shape[1]), np.float32)
    for k, column in enumerate(np.ascontiguousarray(rows.T, np.float64)):
        out[:, k] = np.bincount(index, column if times is None else np.repeat(column, times), n)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
