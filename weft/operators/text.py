"""Full-text retrieval: postings with term and document frequencies, BM25, its Bayesian calibration, priors, several fields.

Scores are column expressions over one join of the query's postings with their statistics; terms of a query are a literal list,
so that a postings table stored by term is pruned by its statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import analysis
from weft.operators import fusion, graph
from weft.operators.signals import ID, SCORE

K1, B = 1.2, 0.75


@dataclass
class Index:
    """The tokens (_doc_id, field, tokens, dl) of text columns, a row for each document and field, or stored postings (_doc_id, field,
    term, tf, dl)."""

    analyzer: str
    tokens: DataFrame | None = None
    stored: DataFrame | None = None
    #: Rows of the queries asked so far, by terms and field.
    asked: dict = field(default_factory=dict)

    def terms(self, query: str) -> list[str]:
        return analysis.analyze(query, self.analyzer)

    @property
    def postings(self) -> DataFrame:
        if self.stored is not None:
            return self.stored
        each = self.tokens.select(ID, "field", "dl", F.explode("tokens").alias("term"))
        return each.groupBy(ID, "field", "term").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))


def index(docs: DataFrame, doc_id: str, fields: list[str], analyzer: str = "standard", path: str | None = None) -> Index:
    """The index of some columns. Null texts have no postings.

    Without a path it is lazy: a query reads the texts once, counts its own terms within each row, and keeps these counts, a few
    numbers a row, in the shared folder; statistics and scores come from them. With one, postings are written there (partitioned
    by field, sorted by term), of which queries read their terms."""
    column = analysis.column(analyzer)
    parts = None
    for f in fields:
        # a condition on tokens would find them once more
        own = docs.where(F.col(f).isNotNull()).select(F.col(doc_id).cast("bigint").alias(ID), F.lit(f).alias("field"), column(F.col(f)).alias("tokens"))
        parts = own if parts is None else parts.unionByName(own)
    ix = Index(analyzer, parts.withColumn("dl", F.size("tokens")))
    if path:
        ix.postings.sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(path)
        return Index(analyzer, stored=docs.sparkSession.read.parquet(path))
    return ix


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def bm25_term(tf: Column, dl: Column, avgdl: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    """w - w / (1 + tf / (k1 (1 - b + b dl / avgdl)))."""
    return weight - weight / (1 + tf / (k1 * (1 - b + b * dl / avgdl)))


def _matched(ix: Index, query: str, field: str | None) -> DataFrame:
    """Postings of the query's terms with n, avgdl and df; a term that the query repeats counts that often."""
    terms = ix.terms(query)
    if ix.stored is None:
        return _counted(ix, terms, field)
    own = ix.postings if field is None else ix.postings.where(F.col("field") == field)
    corpus = own.groupBy("field", ID).agg(F.first("dl").alias("dl")).groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = own.where(F.col("term").isin(sorted(set(terms))))
    stats = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    times = {t: terms.count(t) for t in set(terms)}
    repeated = [t for t, n in times.items() if n > 1]
    weight = F.lit(1.0)
    for t in repeated:
        weight = F.when(F.col("term") == t, float(times[t])).otherwise(weight)
    # the statistics are one row a query term and field, the corpus row one a field
    return hits.join(F.broadcast(stats), ["field", "term"]).join(F.broadcast(corpus), "field").withColumn("boost", weight)


def _is(term: str):
    return lambda x: x == term


def prepare(ix: Index, terms: list[str], field: str | None = None) -> tuple:
    """The counts of terms in each row of an index that stores nothing, for all queries of these terms: texts are read once."""
    own, distinct = ix.tokens if field is None else ix.tokens.where(F.col("field") == field), sorted(set(terms))
    tf = F.array(*(F.size(F.filter("tokens", _is(t))) for t in distinct)) if distinct else F.array().cast("array<int>")
    counts = graph.settled(own.select(ID, "field", "dl", tf.alias("tfs"))).where("dl > 0")
    df = [F.sum((F.col("tfs")[i] > 0).cast("bigint")).alias(f"df{i}") for i in range(len(distinct))]
    stats = [(r.field, r.n, r.avgdl, [r[f"df{i}"] for i in range(len(distinct))]) for r in counts.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *df).collect()]
    ix.asked[tuple(distinct), field] = counts, stats
    return tuple(distinct), field


def _counted(ix: Index, terms: list[str], field: str | None) -> DataFrame:
    """_matched of an index that stores nothing: the counts of the terms in each row, written once and read for all that follows."""
    distinct = sorted(set(terms))
    key = next((k for k in ix.asked if k[1] == field and set(distinct) <= set(k[0])), None) or prepare(ix, terms, field)
    counts, stats = ix.asked[key]
    if list(key[0]) != distinct:  # of the counts of several queries those of this one
        at = [key[0].index(t) for t in distinct]
        counts = counts.withColumn("tfs", F.array(*(F.col("tfs")[i] for i in at)) if at else F.array().cast("array<int>"))
        stats = [(f, n, avgdl, [dfs[i] for i in at]) for f, n, avgdl, dfs in stats]
    # one row a field
    corpus = counts.sparkSession.createDataFrame(stats, "field string, n bigint, avgdl double, dfs array<bigint>")
    each = F.arrays_zip(F.array(*map(F.lit, distinct)).alias("term"), F.array(*(F.lit(float(terms.count(t))) for t in distinct)).alias("boost"), F.col("tfs").alias("tf"), F.col("dfs").alias("df")) if distinct else F.array().cast("array<struct<term:string,boost:double,tf:int,df:bigint>>")
    hits = counts.where(F.exists("tfs", lambda x: x > 0)).join(F.broadcast(corpus), "field")
    return hits.select(ID, "field", "dl", "n", "avgdl", F.explode(each).alias("_h")).select(ID, "field", F.col("_h.term").alias("term"), F.col("_h.tf").alias("tf"), "dl", F.col("_h.df").alias("df"), "n", "avgdl", F.col("_h.boost").alias("boost")).where("tf > 0")


def bm25(ix: Index, query: str, field: str | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """The BM25 signal: documents with any of the query's terms, scores summed over terms (and fields)."""
    score = bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("boost") * idf(F.col("n"), F.col("df")), k1, b)
    return _matched(ix, query, field).select(ID, score.alias("s")).groupBy(ID).agg(F.sum("s").alias(SCORE))


def term(ix: Index, query: str, field: str | None = None) -> DataFrame:
    """Documents with any of the query's terms, scored by the number of occurrences."""
    return _matched(ix, query, field).groupBy(ID).agg(F.sum("tf").cast("double").alias(SCORE))


def prior(tf: Column, ratio: Column) -> Column:
    """A prior in [.1, .9] from term frequency and relative length; our own definition of that composite."""
    by_tf = 0.2 + 0.7 * F.least(F.lit(1.0), tf / 10)
    by_length = 0.3 + 0.6 * (1 - F.least(F.lit(1.0), F.abs(ratio - 0.5) * 2))
    return F.least(F.lit(0.9), F.greatest(F.lit(0.1), 0.7 * by_tf + 0.3 * by_length))


def bayesian(ix: Index, query: str, field: str | None = None, alpha: float = 1.0, beta: float = 0.0, base_rate: float | None = None) -> DataFrame:
    """Posterior probabilities: of each term logit(sigmoid(alpha (s - beta))) + logit(prior) + logit(base rate), then the mean
    of the terms' log-odds."""
    m = _matched(ix, query, field)
    s = bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("boost") * idf(F.col("n"), F.col("df")))
    odds = fusion.logit(fusion.sigmoid(alpha * (s - beta))) + fusion.logit(prior(F.col("tf"), F.col("dl") / F.col("avgdl")))
    if base_rate is not None:
        odds = odds + fusion.logit(F.lit(base_rate))
    return m.select(ID, odds.alias("o")).groupBy(ID).agg(fusion.sigmoid(F.avg("o")).alias(SCORE))


def with_prior(signal: DataFrame, docs: DataFrame, doc_id: str, p: Column) -> DataFrame:
    """Log-odds of a probability signal and of a prior that is a column expression over docs, added."""
    table = docs.select(F.col(doc_id).cast("bigint").alias(ID), p.alias("_prior"))
    return signal.join(table, ID).select(ID, fusion.sigmoid(fusion.logit(F.col(SCORE)) + fusion.logit(F.col("_prior"))).alias(SCORE))


def recency_prior(ts: Column, now: Column | None = None, days: float = 30.0) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp(ts)) / 86400.0)
    return F.coalesce(0.5 + 0.4 * F.exp(-age / days), F.lit(0.5))


def authority_prior(level: Column) -> Column:
    return F.when(level == "high", 0.8).when(level == "medium", 0.6).when(level == "low", 0.4).otherwise(0.5)


def multi_field(ix: Index, query: str, fields: list[str], weights: list[float] | None = None) -> DataFrame:
    """Bayesian signals of several fields, a missing one being .5, by weighted log-odds."""
    return fusion.log_odds([bayesian(ix, query, f) for f in fields], weights=weights or [1.0] * len(fields), defaults=[0.5] * len(fields))


def phrase(ix: Index, query: str, field: str | None = None) -> DataFrame:
    """Documents with all of the phrase's terms: Bayesian scores, positions aren't looked at."""
    terms = sorted(set(ix.terms(query)))
    every = _matched(ix, query, field).groupBy(ID).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms))
    return bayesian(ix, query, field).join(every.select(ID), ID, "left_semi")


def calibration(scored: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """The reliability diagram: (bin, n, confidence, accuracy) of labelled probabilities, with the sums that log_loss, brier
    and ece are made of."""
    p, y = F.col(score), F.col(label).cast("double")
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return scored.where(p.isNotNull() & y.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(y).alias("accuracy"), F.sum((p - y) ** 2).alias("se"), F.sum(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("nll"))


def calibration_report(scored: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(n, log_loss, brier, ece): one row."""
    d = calibration(scored, score, label, bins)
    n = F.sum("n")
    return d.agg(n.alias("n"), (F.sum("nll") / n).alias("log_loss"), (F.sum("se") / n).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / n).alias("ece"))


def learn_parameters(scored: DataFrame, score: str, label: str, rounds: int = 200, rate: float = 0.5) -> dict[str, float]:
    """alpha and beta of sigmoid(alpha (s - beta)) fitted to labels by gradient descent on the log loss; a round is one
    aggregate. base_rate is the share of positive labels."""
    t = scored.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y")).where("s is not null and y is not null").cache()
    a, c = 1.0, 0.0
    for _ in range(rounds):
        e = fusion.sigmoid(F.col("s") * a + c) - F.col("y")
        g = t.agg(F.avg(e * F.col("s")).alias("a"), F.avg(e).alias("c")).first()
        if g.a is None or abs(g.a) + abs(g.c) < 1e-6:
            break
        a, c = a - rate * g.a, c - rate * g.c
    base = t.agg(F.avg("y")).first()[0]
    t.unpersist()
    return {"alpha": a, "beta": -c / a if a else 0.0, "base_rate": base if base is not None else 0.5}
