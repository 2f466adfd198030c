"""Mixing to target weights with soft domain membership.

A classifier learned from a table of labelled documents (see subword.py; at most ``max_rows`` labelled
rows, as in toxicity.py) gives each document a posterior p over domains, in steps of 1 / GRID. Rates
r >= 0 are then fitted so that the expected token totals of the domains, sum of r * tokens * p, meet the
targets, with tokens of the public tokenizer (see tokenizing.py): least squares on the differences, plus
RIDGE times the token-weighted squares of r - 1, which picks the rates nearest to 1 where many fit.

Fit: projected gradient from r = 1 in its lazy form. The gradient of a document's rate is p . d, d the
differences; the steps add up to p . y with one vector y for all documents, and after each step the sum
is projected on the nonnegative rates: r = max(0, 1 - p . y). A step is d - RIDGE * y, scaled by the second
moments of the documents that can still move and halved until the dual objective, which is convex in y,
falls enough; so the fit converges from any targets. It ends when the projected gradient is shorter
than TOLERANCE. ``residual`` is the length of the differences that are left, ``converged`` tells whether
that end was reached within STEPS; a fit that did not raises unless the caller allows it.

Documents of equal posterior have equal rates at each step. Tokens are therefore added up per
posterior once, which a grid of 1 / GRID bounds at binomial(GRID + k - 1, k - 1) rows for k domains, however
many documents there are; each step is a distributed sum over that table, and the driver holds the
domains' totals alone.

Applied, a document is repeated as often as its rate says, the fraction decided by its hash, so that
the expected number of its copies is its rate. Mixing may so leave out documents of domains in excess.

Defined results: a null or wordless text has no tokens and the bias' posterior; labels as in
toxicity.py; domains that no label names keep their place with a posterior near zero, and a target that
nothing can meet is met as nearly as least squares can. An empty table gives no rows, and one without a
token keeps rates of 1. Extra columns are ignored, or kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch
from weftline.llm.subword import SubwordSoftmax
from weftline.llm.text import row_of, whole
from weftline.llm.tokenizing import SharedTokenizer, word_bpe_path
from weftline.llm.toxicity import training_rows
from weftline.llm.wordtable import WordTable, give_back

MAX_ROWS = 4000
#: Posteriors are multiples of 1 / GRID.
GRID = 512
RIDGE = 1e-6
STEPS = 200
TOLERANCE = 1e-8


def gridded(p: np.ndarray) -> np.ndarray:
    """Posteriors rounded to multiples of 1 / GRID; the greatest takes what the others leave of 1."""
    counts = np.rint(np.asarray(p, np.float64) * GRID)
    top = counts.argmax(axis=1)
    at = np.arange(len(counts))
    counts[at, top] += GRID - counts.sum(axis=1)
    return counts / GRID


def _scored(docs: DataFrame, shared, tokens: SharedTokenizer, classes: int, rows: bool) -> DataFrame:
    """(doc_id, text_hash, n_tokens, p0, p1, ...) and, if asked for, the row. Texts alone go to Python."""

    @F.arrow_udf("n_tokens long, p array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, tokenizer = SubwordSoftmax.of(shared.value), tokens.tokenizer()
        # one look-up of a word gives both its logits and its tokens
        together = WordTable(lambda words: np.concatenate([model.word_logits(words), tokenizer.word_counts(words)]), classes + 1)
        for batch in batches:
            sums, n_words = together.sums(batch)
            n_tokens = sums[:, -1] if tokenizer.by_word else np.array([tokenizer.count(text.as_py()) for text in batch])
            p = gridded(model.of_sums(sums[:, :-1], n_words))
            del batch
            give_back()
            offsets = pa.array(np.arange(0, p.size + 1, classes), pa.int32())
            yield pa.StructArray.from_arrays([pa.array(np.rint(n_tokens).astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], ["n_tokens", "p"])

    text = whole(F.col("text"))
    own = [row_of(docs).alias("row")] if rows else []
    found = docs.select(*own, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), score(F.encode(text, "UTF-8")).alias("s"))
    return found.select(*(["row"] if rows else []), "doc_id", "text_hash", "s.n_tokens", *[F.get("s.p", F.lit(k)).alias(f"p{k}") for k in range(classes)])


class Mixture:
    """Fitted on docs. labelled: (doc_id, domain), domain the position in ``targets``, the wanted shares.

    rows: keep the documents beside their scores, for ``mixed``.
    """

    def __init__(
        self,
        docs: DataFrame,
        labelled: DataFrame,
        targets: list[float],
        max_rows: int = MAX_ROWS,
        scratch: Scratch | None = None,
        tokenizer: str | None = None,
        rows: bool = False,
        allow_unconverged: bool = False,
    ):
        self.classes = len(targets)
        self.scratch = scratch or Scratch(docs.sparkSession, "mixing")
        learned = training_rows(docs, labelled, F.col("domain"), max_rows)
        model = SubwordSoftmax(self.classes).fit([bytes(r.text) for r in learned], [r.label for r in learned])
        shared = docs.sparkSession.sparkContext.broadcast(model.state())
        tokens = SharedTokenizer(docs.sparkSession, tokenizer or word_bpe_path())
        self.scored = self.scratch.put(_scored(docs, shared, tokens, self.classes, rows), "scored")
        self.p = [F.col(f"p{k}") for k in range(self.classes)]
        wanted = np.array(targets, float)
        self.y = self._fit(wanted / wanted.sum())
        if not (self.converged or allow_unconverged):
            raise ArithmeticError(f"rates did not settle in {STEPS} steps; the residual is {self.residual:.3g}")

    def _fit(self, wanted: np.ndarray) -> np.ndarray:
        """y, of which rates follow; sets residuals (one a step), residual and converged."""
        k = self.classes
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        cells = self.scratch.put(self.scored.groupBy(*self.p).agg(F.sum("n_tokens").cast("double").alias("n")).where("n > 0"), "cells")
        total = float(cells.agg(F.sum("n")).first()[0] or 0)
        self.residuals, self.converged = [], True
        y = np.zeros(k)

        def looked_at(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            """Differences, second moments of what is free to move, and the dual objective."""
            rated = cells.withColumn("rate", self.rate(y)).withColumn("free", F.when(F.col("rate") > 0, F.col("n")).otherwise(0.0))
            n, rate = F.col("n") / total, F.col("rate")
            sums = rated.agg(*[F.sum(n * rate * p) for p in self.p], *[F.sum(F.col("free") / total * self.p[a] * self.p[b]) for a, b in pairs], F.sum(n * rate * rate)).first()
            moments = np.zeros((k, k))
            for (a, b), x in zip(pairs, sums[k:-1], strict=True):
                moments[a, b] = moments[b, a] = x
            return np.array(sums[:k], float) - wanted, moments, (RIDGE * y @ y + sums[-1]) / 2 + wanted @ y

        if total:
            d, moments, dual = looked_at(y)
            for _ in range(STEPS):
                self.residuals.append(float(np.linalg.norm(d)))
                ahead = d - RIDGE * y  # zero where the projected gradient of every rate is zero
                self.converged = bool(np.linalg.norm(ahead) < TOLERANCE)
                if self.converged:
                    break
                step = np.linalg.solve(moments + (RIDGE + 1e-12) * np.eye(k), ahead)
                for _ in range(40):
                    found = looked_at(y + step)
                    if found[2] <= dual - 1e-4 * ahead @ step + 1e-12 * (1 + abs(dual)):  # or as near as sums are exact
                        break
                    step = step / 2
                y, (d, moments, dual) = y + step, found
            else:
                self.residuals.append(float(np.linalg.norm(d)))
        self.residual = self.residuals[-1] if self.residuals else 0.0
        return y

    def rate(self, y: np.ndarray) -> Column:
        """The rate of a document, of its posterior."""
        rate = F.lit(1.0)
        for p, step in zip(self.p, y, strict=True):
            rate = rate - p * F.lit(float(step))
        return F.greatest(F.lit(0.0), rate)

    def _copied(self) -> DataFrame:
        """The rates, and each rounded up or down by the document's hash, to the rate on average."""
        uniform = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text_hash"), F.lit(1 << 30)) / float(1 << 30)
        return self.scored.withColumn("rate", self.rate(self.y)).withColumn("copies", F.floor(F.col("rate") + uniform).cast("int"))

    def rates(self) -> DataFrame:
        """One row per document: doc_id, n_tokens, p0, p1, ..., rate, copies."""
        return self._copied().select("doc_id", "n_tokens", *self.p, "rate", "copies")

    def mixed(self) -> DataFrame:
        """The documents, each as often as its rate says, with the columns of docs. Nothing is shuffled."""
        rows = self._copied().where("copies > 0")
        return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: Domains of the driver's label table, and the shares wanted of them.
DOMAINS = {"good": 0.85, "plain": 0.12, "toxic": 0.03}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic before quality."""
    domain = F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 1)
    return labels.select("doc_id", domain.alias("domain"))
