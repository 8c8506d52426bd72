"""Document quality by hierarchical empirical Bayes: a text classifier's evidence, and what is known of host and path.

The classifier is a logistic regression on counts that built-in functions take from the text. Every document of the
corpus, labelled or not, then adds its evidence to its host and its path: a labelled one its label, any other its
classifier probability with weight ``SOFT``. A host's rate of good documents is a Beta posterior whose prior has the
corpus' mean; a path's posterior has its host's mean as prior. The priors' strengths are estimated from the spread of
the rates by moments, so that a site with few documents stays near the level above it. The site's log odds, relative to
the corpus', are added to the document's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import labelled_sample, spare, stored, text_of
from fieldloom.llm.toxicity import logistic

#: rows of each label that the classifier is fitted on
SAMPLE = 3000
#: weight of an unlabelled document's evidence for its site, and of the site's for the document
SOFT, SITE = 0.25, 0.5
KEEP = 0.35
#: bounds of a prior's strength in documents
STRENGTH = (2.0, 1000.0)
#: columns that a score adds
ADDED = ("doc_score", "host_rate", "path_rate", "quality_score")

FEATURES = ("log_words", "symbols", "bars", "digits", "upper", "line_words", "repeats", "letters", "lines", "echoes")


def features(text: Column) -> list[Column]:
    """Counts of the whole text as shares and logarithms; 0 where there is nothing to count."""
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.regexp_count(text, F.lit(r"\S+"))
    share = lambda kept: F.length(F.translate(text, kept, "")) / chars
    # what translate() removes is counted by what is left
    symbols = 1 - share("#$%&*@^~=<>{}[]\\_+")
    bars = 1 - share("|")
    digits = 1 - share("0123456789")
    upper = 1 - share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letters = 1 - F.length(F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "")) / chars
    lines = F.split(text, "\n")
    filled = F.filter(lines, lambda x: F.length(x) > 0)
    repeats = 1 - F.size(F.array_distinct(filled)) / F.greatest(F.size(filled), F.lit(1))
    values = [F.log1p(words), symbols, bars, digits, upper, F.log1p(words / F.greatest(F.size(filled), F.lit(1))), repeats, letters, F.log1p(F.size(filled)), F.regexp_count(text, F.lit(r"(?<!\S)(\S++)\s\1(?!\S)")) / F.greatest(words, F.lit(1))]
    return [v.cast("double").alias(n) for v, n in zip(values, FEATURES, strict=True)]


@dataclass
class Classifier:
    """Logistic regression on ``FEATURES``, their squares among them, after scaling; base is the log odds of the labels."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    base: float

    def log_odds(self, columns: list[Column]) -> Column:
        z = [(c - m) / s for c, m, s in zip(columns, self.mean, self.scale, strict=True)]
        total = F.lit(self.weights[0])
        for w, v in zip(self.weights[1:], [*z, *[F.least(v * v, F.lit(25.0)) for v in z]], strict=True):
            total = total + F.lit(w) * v
        return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), total))


def labels_of(labels: DataFrame) -> DataFrame:
    """doc_id, quality of the documents whose labels agree."""
    told = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    return told.where("quality = most").drop("most")


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Classifier:
    """The classifier, fitted on ``SAMPLE`` rows of each label at most, in the order of a hash of doc_id.

    Without rows of both labels it knows nothing, and all log odds are 0.
    """
    rows = docs.select("doc_id", text_of("text").alias("text"))
    found = labelled_sample(rows if learn is None else rows.where(learn), labels_of(labels), "quality", {0: SAMPLE, 1: SAMPLE})
    table = np.array([tuple(r) for r in found.select("quality", *features(F.col("text"))).orderBy("quality", *FEATURES).collect()], float).reshape(-1, 1 + len(FEATURES))
    bad, good = (table[table[:, 0] == v, 1:] for v in (0, 1))
    if not len(bad) or not len(good):
        return Classifier((0.0,) * len(FEATURES), (1.0,) * len(FEATURES), (0.0,) * (1 + 2 * len(FEATURES)), 0.0)
    x, y = np.vstack([bad, good]), np.array([0.0] * len(bad) + [1.0] * len(good))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    weights, _ = logistic(np.hstack([z, np.minimum(z * z, 25)]), y, ridge=1.0)
    return Classifier(*(tuple(map(float, v)) for v in (mean, scale, weights)), float(np.log(len(good) / len(bad))))


def _posterior(good: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (good + prior * strength) / (n + strength)


def _strength(sites: DataFrame, prior: Column) -> float:
    """Strength of a Beta prior by moments: how much more the sites' rates spread than their sizes alone make them.

    ``sites`` has good, n and what ``prior`` needs. One row of sums comes to the driver.
    """
    rate = F.col("good") / F.col("n")
    row = sites.where("n > 0").agg(F.sum(F.col("n") * (rate - prior) * (rate - prior)).alias("spread"), F.sum(prior * (1 - prior)).alias("chance"), F.sum(F.col("n") * prior * (1 - prior)).alias("most")).first()
    if row is None or not row.most:
        return STRENGTH[1]
    # spread = sum of chance * (1 + (n - 1) * rho); rho = 1 / (strength + 1)
    rho = (row.spread - row.chance) / max(row.most - row.chance, 1e-9)
    return float(min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1])) if rho > 0 else STRENGTH[1]


def scored(docs: DataFrame, labels: DataFrame, model: Classifier, host: str = "source", path: str = "lang", learn: Column | None = None) -> DataFrame:
    """``docs`` with quality_score between 0 and 1 for every row: doc_score, host_rate, path_rate and it are added.

    ``host`` and ``path`` name columns; null is a value like any other. Labels count for the rows that ``learn`` picks
    (all by default). Null texts are empty. Repeated rows count and are scored as rows. Columns of ``docs`` with these
    names are replaced. An empty table gives none.
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    new = ADDED
    text = text_of("text")
    h, p, o, ln = spare(docs, "host_key", "path_key", "own_odds", "may_learn")
    rows = docs.withColumns({h: key(host), p: key(path), o: model.log_odds(features(text)), ln: F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))}).drop(*new)
    own = 1 / (1 + F.exp(-F.col(o)))

    # evidence by path, then host, then corpus: sums only, so a host with a third of all rows is a few rows
    slim = stored(rows.select("doc_id", h, p, ln, own.alias("own")), "evidence")
    joined = slim.join(labels_of(labels), "doc_id", "left")
    labelled = F.col(ln) & F.col("quality").isNotNull()
    weight = F.when(labelled, F.lit(1.0)).otherwise(F.lit(SOFT))
    paths = stored(joined.groupBy(h, p).agg(F.sum(weight).alias("n"), F.sum(weight * F.when(labelled, F.col("quality")).otherwise(F.col("own"))).alias("good")), "paths")
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    base = (total[0] + 1) / (total[1] + 2) if total and total[1] else 0.5
    hosts = paths.groupBy(h).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    of_host = _strength(hosts, F.lit(base))
    hosts = hosts.select(h, _posterior(F.col("good"), F.col("n"), F.lit(base), F.lit(of_host)).alias("host_rate"))
    paths = paths.join(hosts, h)
    of_path = _strength(paths, F.col("host_rate"))
    paths = paths.select(h, p, "host_rate", _posterior(F.col("good"), F.col("n"), F.col("host_rate"), F.lit(of_path)).alias("path_rate"))
    paths = stored(paths, "rates")  # of known size: a small one is broadcast, and the texts stay where they are
    found = rows.join(paths, [h, p])
    site = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(base / (1 - base)))
    odds = F.col(o) + F.lit(SITE) * site
    return found.withColumns({"doc_score": own, "quality_score": 1 / (1 + F.exp(-odds))}).select(*docs.drop(*new).columns, *new)


def reject_poor(docs: DataFrame, labels: DataFrame, model: Classifier, limit: float = KEEP, **how) -> DataFrame:
    """The rows of ``docs`` whose quality_score is ``limit`` or more, as they are."""
    clash = [c for c in docs.columns if c.lower() in ADDED]
    aside = dict(zip(clash, spare(docs, *[f"kept_{c}" for c in clash]), strict=True))
    how |= {k: aside.get(how[k], how[k]) for k in ("host", "path") if k in how}
    kept = scored(docs.withColumnsRenamed(aside), labels, model, **how).where(F.col("quality_score") >= limit)
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
