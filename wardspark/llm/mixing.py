"""Mixing to target weights by soft domain membership (operator 2).

A naive Bayes classifier, fitted on a labelled table, gives every document a posterior over
domains; its sharpness is calibrated on labelled documents that it was not fitted on.
Projected-gradient least squares then fits one nonnegative rate per document so that the expected
tokens of each domain, sum over documents of rate x tokens x posterior, match the targets.

The gradient of a document's rate is its posterior times one number a domain, so what steps have
added up to is one number a domain as well: a rate is the start less posterior x those numbers,
projected onto the bounds. Each step is one grouped aggregate over all documents, which tries
several step lengths along the gradient scaled by the k x k Hessian of the rates that no bound holds.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stored

#: Word and word-ending features are hashed into so many buckets each; this bounds the model.
BUCKETS = 1 << 18
#: Only buckets whose count of documents in some domain is so many deviations from its expectation have weights.
SIGNIFICANT = 3.0
#: Powers to choose from by log-loss: of the likelihood of what a document has, and of what it lacks.
SHARPNESS, ABSENCE = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0), (0.0, 0.03, 0.1, 0.3, 1.0)
#: One labelled document in so many chooses the powers and is not counted.
HELD_OUT = 5
#: Weight of the squared distance from the start rate, against that from the targets, both as shares of all
#: tokens: it makes the rates unique and moves totals by about as much.
RIDGE = 1e-5
#: The fit ends when no domain's part of the projected gradient exceeds this share of all tokens.
TOLERANCE = 1e-6
#: Step lengths tried in one pass; passes after which the fit gives up with a warning.
LENGTHS, MAX_STEPS = (1.0, 0.3, 0.1, 0.01), 100


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep..., tokens, bucket): the different hashed words and word endings of text, each once a document.

    Words are those between white space. The first row of a document has its number of words as
    tokens and the others 0, so tokens add up; a document without words has one row of a null bucket.
    A long document counts once for each feature: documents are independent of each other, their words are not.
    """
    split = docs.select(*keep, F.array_remove(F.split(F.lower(F.col("text")), r"\s+"), "").alias("words"))
    kinds = split.select(*keep, F.size("words").alias("n"), F.array_distinct("words").alias("words"))
    ends = F.array_distinct(F.transform("words", lambda w: F.right(w, F.lit(2))))
    kinds = kinds.select(*keep, "n", "words", ends.alias("ends"))
    # Words are hashed after they are rows, in generated code, which costs half of hashing them in arrays.
    rows = kinds.select(*keep, "n", F.size("words").alias("m"), F.posexplode_outer(F.concat("words", "ends")).alias("at", "feature"))
    bucket = F.pmod(F.xxhash64("feature"), F.lit(BUCKETS)) + F.when(F.col("at") >= F.col("m"), BUCKETS).otherwise(0)
    tokens = F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n")).otherwise(0)
    return rows.select(*keep, tokens.alias("tokens"), F.when(F.col("feature").isNotNull(), bucket).cast("int").alias("bucket"))


class DomainClassifier:
    """Hashed naive Bayes over the features that a document has; those that it lacks move the prior.

    ``weights`` has a row per telling bucket: for each domain the logarithm of its documents with
    the feature over those expected if features and domains were independent. ``absence`` has, by
    domain, the log-likelihood ratio of having no telling feature. Other buckets have weight 0.
    """

    def __init__(self, domains: list[str], priors: list[float], absence: list[float], weights: DataFrame, powers: tuple[float, float]):
        self.domains, self.priors, self.absence, self.weights, self.powers = domains, priors, absence, weights, powers

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, significant: float = SIGNIFICANT) -> "DomainClassifier":
        """docs (doc_id, text), labels (doc_id, domain); of the labelled documents one in HELD_OUT, by a hash of
        the id, chooses the powers and the others are counted (all do both if either part is empty)."""
        labels = labels.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
        labels = stored(labels.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD_OUT)) == 0), "domain-labels")
        domains = sorted(r.domain for r in labels.select("domain").distinct().collect())  # a row a domain
        if not domains:
            raise ValueError("the labelled table has no domain")
        known = docs.where("text is not null").join(sized(labels, 48), "doc_id")
        sizes = known.groupBy("held", "domain").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows a domain
        parted = {r.held for r in sizes} == {True, False}
        size = [sum(r["n"] for r in sizes if r.domain == d and not (parted and r.held)) for d in domains]
        taught = features(known.where("not held") if parted else known, ["domain"])
        by_bucket = taught.where("bucket is not null").groupBy("bucket").agg(
            F.count(F.lit(1)).alias("all"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)]
        )
        by_bucket = stored(by_bucket, "domain-counts")
        k = range(len(domains))
        totals = by_bucket.agg(F.sum("all").alias("all"), *[F.sum(f"n{i}").alias(f"n{i}") for i in k]).first()
        expected = [F.col("all") * F.lit((totals[f"n{i}"] or 0) / max(1, totals["all"] or 0)) for i in k]
        strays = [F.abs(F.col(f"n{i}") - e) / F.sqrt(e + 1) for i, e in enumerate(expected)]
        telling = by_bucket.where(reduce(Column.__or__, [z >= significant for z in strays]))
        anywhere = (F.col("all") + 0.5) / (sum(size) + 1)
        chance = [(F.col(f"n{i}") + anywhere) / (n + 1) for i, n in enumerate(size)]
        absent = [F.log((1 - p) / (1 - anywhere)) for p in chance]
        columns = [F.log((F.col(f"n{i}") + 1) / (e + 1)).alias(f"w{i}") for i, e in enumerate(expected)] + [a.alias(f"a{i}") for i, a in enumerate(absent)]
        weights = stored(telling.select("bucket", *columns), "domain-weights")
        base = weights.agg(*[F.sum(F.round(F.col(f"a{i}") * 1e6).cast("long")) for i in k]).first()
        present = {d: sum(r["n"] for r in sizes if r.domain == d) for d in domains}
        total = sum(present.values())
        priors = [math.log((present[d] + 0.5) / (total + 0.5 * len(domains))) for d in domains]
        model = cls(domains, priors, [(x or 0) / 1e6 for x in base], weights.drop(*[f"a{i}" for i in k]), (1.0, 1.0))
        if len(domains) > 1:
            model.powers = model._calibrated(features(known.where("held") if parted else known, ["doc_id", "domain"]))
        return model

    def scores(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """(keep..., tokens, s0, s1, ...): summed log-likelihoods of the words of each document."""
        return self._summed(features(docs, keep), keep)

    def _summed(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        k = range(len(self.domains))
        f = rows.join(sized(self.weights, 8 * len(k) + 8), "bucket", "left")
        likelihood = [F.coalesce(f"w{i}", F.lit(0.0)) for i in k]
        # Sums of whole numbers do not depend on the order of rows.
        return f.groupBy(*keep).agg(
            F.sum("tokens").alias("tokens"), *[F.sum(F.round(x * 1e6).cast("long")).alias(f"s{i}") for i, x in zip(k, likelihood, strict=True)]
        )

    def posterior(self, powers: tuple[float, float] | None = None) -> list[Column]:
        """Posterior columns from s0, s1, ...: softmax of prior plus the likelihoods, each to its power."""
        has, lacks = powers or self.powers
        logits = [F.lit(p + lacks * a) + has * F.col(f"s{i}") / 1e6 for i, (p, a) in enumerate(zip(self.priors, self.absence, strict=True))]
        top = F.greatest(*logits) if len(logits) > 1 else logits[0]
        parts = [F.exp(x - top) for x in logits]
        return [p / reduce(Column.__add__, parts) for p in parts]

    def _calibrated(self, rows: DataFrame) -> tuple[float, float]:
        """The powers of least log-loss over rows of features of labelled documents."""
        grid = [(has, lacks) for has in SHARPNESS for lacks in ABSENCE]
        scored = self._summed(rows, ["doc_id", "domain"]).select(
            F.array(*[F.col(f"s{i}") / 1e6 for i in range(len(self.domains))]).alias("s"),
            F.array_position(F.array(*map(F.lit, self.domains)), F.col("domain")).cast("int").alias("at"),
        )
        # The grid is a row a choice, so that one small expression serves all of it.
        tried = scored.select("*", F.posexplode(F.array(*[F.struct(F.lit(h).alias("has"), F.lit(a).alias("lacks")) for h, a in grid])).alias("place", "g"))
        base = F.arrays_zip(F.col("s"), F.array(*map(F.lit, self.priors)).alias("prior"), F.array(*map(F.lit, self.absence)).alias("absence"))
        logits = tried.select("place", "at", F.transform(base, lambda x: x["prior"] + F.col("g.lacks") * x["absence"] + F.col("g.has") * x["s"]).alias("x"))
        centred = logits.select("place", "at", F.transform("x", lambda v: v - F.array_max("x")).alias("x"))
        loss = F.least(F.lit(27.7), F.log(F.aggregate("x", F.lit(0.0), lambda n, v: n + F.exp(v))) - F.element_at("x", F.col("at")))
        losses = centred.groupBy("place").agg(F.sum(F.round(loss * 1e6).cast("long")).alias("loss")).collect()  # a row a choice
        return min(((r["loss"], grid[r["place"]]) for r in losses), default=(0, (1.0, 1.0)))[1]


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    total_factor: float = 1.0,
    max_rate: float = 4.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, tokens, rate and a posterior column p_<domain> per domain.

    ``labels`` has doc_id and domain; ``weights`` are target shares of tokens (white-space words)
    by domain, domains without one get 0; targets sum to ``total_factor`` times all tokens.
    Minimises the squared distance of expected domain totals to the targets over rates in
    [0, max_rate], of equally good rates those nearest to the start (1, or max_rate if that is less).

    Null, empty and blank texts have 0 tokens, the prior as posterior and the rate that it gets.
    Null ids are dropped. Rows that repeat an id are one document with the words of all of them.
    Labels of unknown documents only name a domain. An empty table gives no rows. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    model = DomainClassifier.fit(rows, labels)
    k = range(len(model.domains))
    scored = model.scores(rows.where("text is not null"), ["doc_id"])
    none = rows.select("doc_id", F.lit(0).cast("long").alias("tokens"), *[F.lit(0).cast("long").alias(f"s{i}") for i in k])
    scored = scored.unionByName(none).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), *[F.sum(f"s{i}").alias(f"s{i}") for i in k])
    table = stored(scored.select("doc_id", "tokens", *[p.alias(f"p{i}") for i, p in enumerate(model.posterior())]), "posteriors")
    shares = [total_factor * weights.get(d, 0.0) / max(sum(weights.values()), 1e-12) for d in model.domains]
    moved = fitted(table, shares, max_rate)
    rate = _projected(F.array(*[F.lit(float(x)) for x in moved]), len(shares), max_rate)
    return table.select("doc_id", "tokens", rate.alias("rate"), *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(model.domains)])


def _projected(moved: Column, n: int, max_rate: float) -> Column:
    """Rates: the start less the product of the posteriors p0, p1, ... and an array, within the bounds."""
    step = reduce(Column.__add__, [F.get(moved, F.lit(i)) * F.col(f"p{i}") for i in range(n)])
    return F.greatest(F.lit(0.0), F.least(F.lit(float(max_rate)), F.lit(min(1.0, max_rate)) - step))


def fitted(table: DataFrame, shares: list[float], max_rate: float) -> np.ndarray:
    """One number a domain for ``_projected``, of a stored table (tokens, p0, p1, ...) and target shares of its tokens.

    With rates as shares of all tokens, the objective is half the squared distance of the totals y from the
    targets t plus RIDGE / 2 times that of the rates from the start r0. Its gradient is zero, where no bound holds, at
    r = r0 - p . (y - t) / RIDGE, so the fit seeks the m with m RIDGE = y(m) - t, which has one solution: both
    sides are monotone, and their difference is the gradient of a convex function of m, whose value guards the steps.
    """
    n, start = len(shares), min(1.0, max_rate)
    whole = table.agg(F.sum("tokens")).first()[0] or 0
    target, at, steps = np.array(shares), np.zeros(n), [np.zeros(n)]
    if not whole:
        return at

    def exact(x: Column) -> Column:  # whole numbers: sums are the same in any order of rows
        return F.sum(F.round(x * 1000).cast("decimal(38,0)")).cast("double") / (1000.0 * whole)

    upper = [(i, j) for i in range(n) for j in range(i, n)]
    best = None
    for _ in range(MAX_STEPS):
        # Literals of arrays are data and not code, so all passes share one compiled plan.
        tried = table.select("tokens", *[f"p{i}" for i in range(n)], F.explode(F.array(*[F.struct(F.lit(x).alias("place"), F.array(*[F.lit(float(v)) for v in m]).alias("m")) for x, m in enumerate(steps)])).alias("x"))
        rated = tried.select("x.place", "tokens", *[f"p{i}" for i in range(n)], F.col("x.m").alias("m"), _projected(F.col("x.m"), n, max_rate).alias("rate"))
        pull = reduce(Column.__add__, [F.get("m", F.lit(i)) * F.col(f"p{i}") for i in range(n)])
        free = F.when((F.col("rate") > 0) & (F.col("rate") < max_rate), F.col("tokens")).otherwise(0)
        sums = rated.groupBy("place").agg(
            exact(F.col("tokens") * (-F.col("rate") * pull - (F.col("rate") - start) * (F.col("rate") - start) / 2)).alias("value"),
            *[exact(F.col("tokens") * F.col("rate") * F.col(f"p{i}")).alias(f"y{i}") for i in range(n)],
            *[exact(free * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"h{i}_{j}") for i, j in upper],
        ).collect()  # a row a step length
        found = []
        for r in sums:
            m = steps[r["place"]]
            off = np.array([r[f"y{i}"] for i in range(n)]) - target - RIDGE * m
            found.append((r["value"] + float(target @ m) + RIDGE / 2 * float(m @ m), float(np.abs(off).max()), r["place"], m, off, r))
        nearest = min(found, key=lambda x: x[1])
        if nearest[1] <= TOLERANCE:
            return nearest[3]
        lowest = min(found, key=lambda x: (x[0], x[2]))
        # At the level of rounding the value cannot tell steps apart; the gradient can.
        best = nearest if best is not None and nearest[1] < best[1] and nearest[0] <= best[0] + 1e-9 else lowest
        h = np.zeros((n, n))
        for i, j in upper:
            h[i, j] = h[j, i] = best[5][f"h{i}_{j}"]
        step = np.linalg.solve(h + RIDGE * np.eye(n), best[4])
        steps = [best[3] + length * step for length in LENGTHS]
    warnings.warn(f"the fit of mixing rates stopped after {MAX_STEPS} steps with a gradient of {best[1]:.1e}", stacklevel=2)
    return best[3]


def mix(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs repeated by their rates: the whole part always, one more if a hash of the id falls below the rest.

    All rows of an id are repeated alike, null texts too. Rows whose id is null or has no rate are left out. Empty tables
    give no rows. Columns of docs keep their names and clash with nothing.
    """
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 24)) / float(1 << 24)
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    times = stored(rates.select("doc_id", copies.alias("copies")).where("copies > 0"), "copies")
    # One struct per id, so that no column of docs can clash with what is added.
    times = times.select(F.col("doc_id").alias("mixed_id"), F.sequence(F.lit(1), F.col("copies")).alias("mixed_copies"))
    joined = docs.select(F.struct("*").alias("mixed_row")).join(sized(times, 64), F.col(f"mixed_row.{id_col}") == F.col("mixed_id"))
    return joined.select("mixed_row", F.explode("mixed_copies").alias("mixed_copy")).select("mixed_row.*")
