"""Toxicity by a factorization machine over hashed terms (operator 13).

Terms of a text are its different words and the first letters of longer ones, hashed to 32 bits. Counts over
the labelled rows of the fit tell the terms whose share among toxic texts differs from chance; these are the
machine's inputs. It scores a text by a bias, a weight for each term and, for each pair of terms, the
product of their vectors, which learns combinations that no sum of single weights can.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, stored

PREFIXES = (4, 5, 6)
#: The machine's inputs, and the labelled rows it is fitted on: at most so many of each.
MOST_TERMS, FIT_ROWS = 2048, 20_000
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 30, 256, 0.02, 1e-4
#: Terms count if their share among toxic texts is so many deviations from that among all.
DEVIATIONS, LEAST_TEXTS = 4.0, 4
HELD_OUT = 5
_WORD = re.compile(r"[^\W_]+")
LONG_TEXT = 1 << 20
_CACHED = 1 << 18


def word_terms(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its first letters, for words that are longer than those."""
    return (zlib.crc32(word.encode("utf-8", "surrogatepass")), *[zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) for n in PREFIXES if len(word) > n])


def words_of(text: str | None) -> set[str]:
    lower = (text or "").lower()
    return set(_WORD.findall(lower)) if len(lower) <= LONG_TEXT else {m.group() for m in _WORD.finditer(lower)}


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted({t for w in words_of(text.as_py()) for t in word_terms(w)}) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("toxic"), pa.array(terms, pa.list_(pa.int64()))], names=["row", "toxic", "terms"])


@dataclass
class Machine:
    """terms: sorted hashes; weights and factors: one row for each of them."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, held: list[int]) -> float:
        """Probability of being toxic of a text that holds the terms at these places."""
        if not held:
            z = self.bias
        else:
            v = self.factors[held]
            z = self.bias + self.weights[held].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_machine(held: list[np.ndarray], toxic: np.ndarray, terms: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss by Adam over shuffled batches, with decay of weights and factors. The same rows give the same machine."""
    n, m = len(held), len(terms)
    rng = np.random.default_rng(seed)
    rate = (toxic.sum() + 1) / (n + 10)  # without any row: one in ten
    start = [np.array([np.log(rate / (1 - rate))]), np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))]
    if not m or not 0 < toxic.sum() < n:
        return Machine(float(start[0][0]), terms, start[1], start[2])
    at, first, second, step = start, [np.zeros_like(x) for x in start], [np.zeros_like(x) for x in start], 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            rows = order[lo : lo + BATCH]
            x = np.zeros((len(rows), m))
            for i, r in enumerate(rows):
                x[i, held[r]] = 1
            bias, w, v = at
            xv = x @ v
            z = bias + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))  # inputs are 0 or 1
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic[rows]) / len(rows)
            grads = [np.array([g.sum()]), x.T @ g + DECAY * w, x.T @ (g[:, None] * xv) - (x.T @ g)[:, None] * v + DECAY * v]
            step += 1
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                at[k] = at[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(at[0][0]), terms, at[1], at[2])


def train(docs: DataFrame, labels: DataFrame, most_terms: int = MOST_TERMS, fit_rows: int = FIT_ROWS) -> Machine:
    """The machine fitted on the rows of docs (doc_id, text) whose id labels (doc_id, toxic) marks 0 or 1.

    The fit takes at most ``fit_rows`` labelled ids, the first in the order of a hash; their terms are counted, and at most
    ``most_terms`` of them and ``fit_rows`` rows reach the driver. Null ids and labels are left out; an id with two labels
    is toxic. Rows that repeat an id are rows of their own.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # At most fit_rows ids and labels: joining them moves no text.
    marks = sized(stored(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "fit-labels"), 16)
    rows = docs.select("doc_id", "text").join(marks, "doc_id").select(F.xxhash64("doc_id", "text").alias("row"), "toxic", "text")
    coded = stored(rows.mapInArrow(_terms, "row long, toxic int, terms array<long>"), "labelled-terms")
    total = coded.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    share = total["t"] / max(1, total["n"])
    counts = coded.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    spread = F.sqrt(F.col("n") * share * (1 - share) + 0.5)
    chance = F.abs(F.col("t") - F.col("n") * share) / spread
    telling = counts.where(F.col("n") >= LEAST_TEXTS).select("term", chance.alias("chance")).where(F.col("chance") > DEVIATIONS)
    chosen = sorted(r["term"] for r in telling.orderBy(F.desc("chance"), "term").limit(most_terms).collect())
    kept = F.array_intersect("terms", F.array(*map(F.lit, chosen)).cast("array<long>")) if chosen else F.array().cast("array<long>")
    some = coded.orderBy("row", "toxic").limit(fit_rows).select("row", "toxic", kept.alias("terms")).toArrow()
    terms = np.array(chosen, np.int64)
    order = sorted(range(some.num_rows), key=lambda i: (some["row"][i].as_py(), some["toxic"][i].as_py()))
    held = [np.searchsorted(terms, np.array(some["terms"][i].as_py(), np.int64)) for i in order]
    return fit_machine(held, np.array([some["toxic"][i].as_py() for i in order], float), terms)


def _scored(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {int(t): i for i, t in enumerate(machine.terms)}
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in batch.column("text"):
                held: set[int] = set()
                for word in words_of(text.as_py()):
                    found = seen.get(word)
                    if found is None:
                        if len(seen) >= _CACHED:
                            seen.clear()
                        found = seen[word] = tuple(places[t] for t in word_terms(word) if t in places)
                    held.update(found)
                out.append(machine.score(sorted(held)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score): a row for each row of docs (doc_id, text), from whole texts alone. Null and empty texts have the score of the bias."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(machine), "doc_id long, score double")


def held_out(doc_id) -> F.Column:
    """Whether labels of this id are kept out of the fit: crc32 of the decimal id (a null one: of nothing) modulo HELD_OUT is 0."""
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def toxicity(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The machine is fitted on labelled rows that are not held out. Without usable labels of both kinds all scores are one base
    rate, a tenth if there are none. Rows that repeat an id come out as often; null ids stay. An empty table gives no rows;
    further columns are not read.
    """
    rows = docs.select("doc_id", "text")
    machine = train(rows, labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))), **fit)
    return score(rows, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
