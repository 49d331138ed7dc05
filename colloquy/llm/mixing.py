"""Mixing sources to target weights with soft membership, on DataFrame functions alone.

A naive Bayes classifier learns domains from a labelled table and gives every document a posterior
over domains. Document rates, not below zero, are fitted by projected-gradient least squares until
the expected tokens of each domain match the targets. A gradient in the rates needs only the
residual of each domain, so the fitted model is the list of these short vectors: a document's rate
is computed from its own posterior where the document lies, and no text ever moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, quoted, spare
from colloquy.llm.labelled import MAX_FIT_ROWS, smallest_hashes

#: Hash buckets of the classifier's words, and the evidence of how many words a posterior uses at
#: most: log likelihoods are averaged over the words and multiplied by this.
BUCKETS, EVIDENCE = 4096, 24.0
#: Gradient steps, and how strongly rates are drawn to 1.
STEPS, PULL = 16, 1e-3


@dataclass
class DomainModel:
    domains: list[str]
    stages: PipelineModel


@dataclass
class MixPlan:
    """domains with their shares before and the targets, and the scaled residuals of each step."""

    domains: list[str]
    before: list[float]
    target: list[float]
    steps: list[list[float]]
    after: list[float]


def _words(text_col: str) -> Column:
    """Lower-cased words between ASCII white space; none for a null or blank text."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(quoted(text_col)), F.lit(""))), r"\s+"), "")


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", max_rows: int = MAX_FIT_ROWS) -> DomainModel:
    """Fits the classifier on at most max_rows rows of the labelled table (id, domain); null ids and
    domains are left out, and of contradicting repeated labels the smallest counts."""
    known = labelled.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(domain_col)).alias("domain")).dropna()
    ids = F.broadcast(smallest_hashes(known.groupBy("id").agg(F.min("domain").alias("__domain")), "id", max_rows))
    texts = docs.select(F.col(quoted(id_col)).alias("id"), _words(text_col).alias("__words"))
    sample = cut(texts.join(ids, "id").select("__domain", "__words"))
    if sample.isEmpty():
        raise ValueError("no labelled document: domains can't be learned")
    index = StringIndexer(inputCol="__domain", outputCol="__label", stringOrderType="alphabetAsc").fit(sample)
    hashing = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=BUCKETS)
    bayes = NaiveBayes(featuresCol="__counts", labelCol="__label", rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__best").fit(hashing.transform(index.transform(sample)))
    return DomainModel(list(index.labels), PipelineModel([hashing, bayes]))


def with_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text", own: str = "__") -> DataFrame:
    """docs with columns tokens and p0, p1, ... for each domain, their names prefixed by own, which no
    column of docs may begin with. A text without words gets the class priors."""
    kept = [F.col(quoted(c)) for c in docs.columns]
    packed = docs.select(F.struct(*kept).alias("row"), _words(text_col).alias("__words"))  # the model's columns have names of their own
    raw = model.stages.transform(packed.withColumn("__tokens", F.size("__words").cast("double")))
    raw = raw.select("row.*", F.col("__tokens").alias(f"{own}tokens"), vector_to_array("__raw").alias(f"{own}raw"))
    top, scale = F.array_max(f"{own}raw"), F.greatest(F.lit(1.0), F.col(f"{own}tokens") / EVIDENCE)
    odds = [F.exp((F.col(f"{own}raw")[k] - top) / scale) for k in range(len(model.domains))]
    scored = raw.select(*kept, f"{own}tokens", *[o.alias(f"{own}o{k}") for k, o in enumerate(odds)])
    total = sum((F.col(f"{own}o{k}") for k in range(1, len(odds))), F.col(f"{own}o0"))
    return scored.select(*kept, f"{own}tokens", *[(F.col(f"{own}o{k}") / total).alias(f"{own}p{k}") for k in range(len(odds))])


def rate_of(steps: list[list[float]], own: str = "__") -> Column:
    """The rate that the gradient steps lead to from 1, from the columns p0, p1, ..."""
    rate = F.lit(1.0)
    for step in steps:
        slope = sum((F.col(f"{own}p{k}") * F.lit(g) for k, g in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate * F.lit(1 - PULL) + F.lit(PULL) - slope)
    return F.round(rate, 6)


def fit(posteriors: DataFrame, model: DomainModel, weights: dict[str, float], steps: int = STEPS, own: str = "__") -> MixPlan:
    """Least squares of the domains' expected token shares against the targets. posteriors should be
    written, as each step reads them.

    Residuals are divided by the domain's own share, which makes steps of length 1 safe: the
    documents' pull on a domain, weighted by their tokens, then sums up to its posterior mass.
    """
    unknown = sorted(set(weights) - set(model.domains))
    if unknown or not sum(weights.values()) > 0:
        raise ValueError(f"targets must be positive and of known domains; unknown: {unknown}")
    names, tokens = model.domains, F.col(f"{own}tokens")
    target = [weights.get(d, 0.0) / sum(weights.values()) for d in names]

    def shares(rate: Column) -> list[float]:
        row = posteriors.agg(F.coalesce(F.sum(tokens), F.lit(0.0)), *[F.coalesce(F.sum(tokens * rate * F.col(f"{own}p{k}")), F.lit(0.0)) for k in range(len(names))]).first()
        return [float(x) / max(float(row[0]), 1.0) for x in row[1:]]

    before = shares(F.lit(1.0))
    scale = [max(b, 1e-3) for b in before]
    done: list[list[float]] = []
    now = before
    for _ in range(steps):
        done.append([(n - t) / s for n, t, s in zip(now, target, scale, strict=True)])
        now = shares(rate_of(done, own))
    return MixPlan(names, before, target, done, now)


def copies_of(rate: Column, id_col: str) -> Column:
    """Whole copies: the rate's floor, and one more with the chance of its fraction, drawn by the id."""
    draw = F.pmod(F.xxhash64(F.col(quoted(id_col)), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def plan_mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """id, n_tokens, domains (struct of posteriors), rate and copies for every row.

    Null texts are empty: they have no tokens and the class priors as posterior. Ties need no rule,
    as a rate depends on a row's own text alone: repeated rows get equal rates, and equal copies if
    their ids are equal. Very long texts are counted whole; tokens are the words between ASCII white
    space. Posteriors are worked out once and written.
    """
    model = train(docs, labelled, id_col, text_col, domain_col, max_rows)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    posteriors = cut(with_posteriors(rows, model).drop("text"))
    rate = rate_of(fit(posteriors, model, weights).steps)
    domains = F.struct(*[F.round(f"__p{k}", 6).alias(d) for k, d in enumerate(model.domains)])
    return posteriors.select(F.col("id").alias(id_col), F.col("__tokens").cast("long").alias("n_tokens"), domains.alias("domains"), rate.alias("rate"), copies_of(rate, "id").alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", max_rows: int = MAX_FIT_ROWS, fit_docs: DataFrame | None = None) -> DataFrame:
    """The rows of docs, each as often as its copies say, all columns unchanged. fit_docs:
    where the labelled rows' texts are, docs unless given.

    Null, blank and very long texts and repeated rows are as in plan_mix; an empty table stays empty;
    columns of docs may have any names. The rows are written once beside their posteriors: the rates'
    steps stand over columns that are read, never over the classifier.
    """
    own = spare(docs.columns)
    model = train(docs if fit_docs is None else fit_docs, labelled, id_col, text_col, domain_col, max_rows)
    posteriors = cut(with_posteriors(docs, model, text_col, own))
    copies = copies_of(rate_of(fit(posteriors, model, weights, own=own).steps, own), id_col)
    return posteriors.withColumn(f"{own}copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[F.col(quoted(c)) for c in docs.columns])
