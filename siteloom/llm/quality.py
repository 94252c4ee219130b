"""Quality and toxicity by hierarchical empirical Bayes.

Three sources are combined in log-odds. Document evidence: log-odds weights of hashed words, word shapes
and layout features, learned from labelled documents by a grouped aggregation, kept only where they
stand out (likelihood ratio over ``SIGNIFICANT`` squared), and calibrated on labelled documents that took no
part in learning. Host posterior: the mean chance of a host's documents, shrunk toward the global rate
with a prior weight found from the spread between hosts. Path posterior: the same within the host,
shrunk toward the host's. A site with few documents thus keeps its parent's rate.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, free, ordered

FEATURES = 1 << 18
#: Labelled documents the classifier is fitted on at most, chosen by a hash of doc_id.
LABELLED = 20_000
SIGNIFICANT = 4.0
#: Chance of low quality, or of toxicity, above which a document goes.
REJECT = 0.6
TARGETS = ("low", "toxic")
CACHE_WORDS = 100_000
_SHAPE = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1"))


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


class _Words(dict):
    """Word -> the slots of itself, of its bare form and of its shape."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        shape = word
        for pattern, put in _SHAPE:
            shape = pattern.sub(put, shape)
        out = self[word] = tuple({_slot("w " + word), _slot("b " + word.strip(".,;:!?\"'()*#$%&|-_")), _slot("s " + shape[:12])})
        return out


_words = _Words()


def forget() -> None:
    _words.clear()


def features(text: str | None) -> np.ndarray:
    """Slots of the features that the whole text has, each once."""
    text = text or ""
    found = text.lower().split()
    slots = set()
    for own in map(_words.__getitem__, set(found)):
        slots.update(own)
    lines = [x for x in text.split("\n") if x]
    n, shapes = len(found), Counter()
    for w in found:
        shapes[_words[w][-1]] += 1
    letters = sum(map(str.isalpha, text))
    for name, value in (
        ("words", int(math.log2(n + 1))), ("lines", int(4 * len(set(lines)) / max(1, len(lines)))), ("repeat", int(10 * len(set(found)) / max(1, n))),
        ("letters", int(20 * letters / max(1, len(text)))), ("length", int(sum(map(len, found)) / max(1, n))), ("shape", int(10 * max(shapes.values(), default=0) / max(1, n))),
    ):
        slots.add(_slot(f"l {name} {value}"))
    return np.fromiter(slots, np.int64, len(slots))


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """rows (text, low, toxic) -> documents with each feature by class, and documents by class.

    Classes are numbered low + 2 * toxic. Each task sums into a table of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((FEATURES + 1, 4), dtype=np.int64)
        for batch in batches:
            for text, low, toxic in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kind = low + 2 * toxic
                seen[features(text.as_py()), kind] += 1
                seen[FEATURES, kind] += 1
        rows = np.flatnonzero(seen.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(seen[rows, i]) for i in range(4))], names=["slot", "c0", "c1", "c2", "c3"])

    names = [f"c{i}" for i in range(4)]
    got = rows.select("text", "low", "toxic").mapInArrow(run, "slot long, " + ", ".join(f"{c} long" for c in names)).groupBy("slot").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
    out = np.zeros((FEATURES + 1, 4))
    out[got["slot"].to_numpy(np.int64)] = got[names].to_numpy(np.float64)
    return out[:-1], out[-1]


def weights(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """(feature, target) log-odds of presence; zero where they don't stand out."""
    out = np.zeros((len(seen), 2))
    for i, kinds in enumerate(([1, 3], [2, 3])):
        rest = [k for k in range(4) if k not in kinds]
        a, b, n, m = seen[:, kinds].sum(axis=1), seen[:, rest].sum(axis=1), total[kinds].sum(), total[rest].sum()
        if not n or not m:
            continue
        odds = np.log((a + 0.5) / (n - a + 0.5)) - np.log((b + 0.5) / (m - b + 0.5))
        ratio = np.zeros(len(seen))
        for got, want in ((a, (a + b) * n / (n + m)), (b, (a + b) * m / (n + m)), (n - a, (n + m - a - b) * n / (n + m)), (m - b, (n + m - a - b) * m / (n + m))):
            ratio += 2 * np.where(got > 0, got * np.log(np.maximum(got, 1) / np.maximum(want, 1e-300)), 0)
        out[:, i] = np.where(ratio > SIGNIFICANT**2, odds, 0.0)
    return out


COVARIATES = ("pos", "neg", "root_pos", "root_neg")


def _evidence(rows: DataFrame, table: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and for each target the sums of positive and of negative weights, and their roots.

    Separate sums let the calibration tell a short text with little evidence from one with much on both sides.
    """
    sent = rows.sparkSession.sparkContext.broadcast(table)  # FEATURES x 2 numbers
    names = [f"{c}_{t}" for t in TARGETS for c in COVARIATES]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + "".join(f", {c} double" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            pos, neg = np.zeros((batch.num_rows, 2)), np.zeros((batch.num_rows, 2))
            for i, text in enumerate(batch.column(len(keep))):
                own = table[features(text.as_py())]
                pos[i], neg[i] = np.maximum(own, 0).sum(axis=0), np.maximum(-own, 0).sum(axis=0)
            columns = [x[:, i] for i in range(2) for x in (pos, neg, np.sqrt(pos), np.sqrt(neg))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=[*keep, *names])
        forget()  # an idle worker holds no memory that other stages need

    return rows.select(*keep, "text").mapInArrow(run, schema)


def calibrate(evidence: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Intercept and slopes of a logistic fit with a slight ridge; all but certain where only one class is seen."""
    n, k = evidence.shape
    if not truth.any() or truth.all():
        return np.array([30.0 if n and truth.all() else -30.0, *[0.0] * k])
    scale = np.maximum(1.0, np.abs(evidence).max(axis=0))
    x = np.concatenate((np.ones((n, 1)), evidence / scale), axis=1)
    w, ridge = np.zeros(k + 1), np.diag([1e-6] + [1e-2] * k)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (truth - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return np.concatenate((w[:1], w[1:] / scale))


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_posteriors(rows: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """rows (host, path, p_<target>) -> (host, path, host_<t>, path_<t>, rate_<t>).

    Sums are combined in each task before they are dealt. The prior weight of each level is by moments:
    the variance of group means beyond what their sizes explain; no such excess gives full shrinkage.
    """
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(f"p_{t}").alias(f"y_{t}") for t in targets))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *(F.sum(f"y_{t}").alias(f"hy_{t}") for t in targets))
    total = hosts.agg(F.sum("hn"), *(F.sum(f"hy_{t}") for t in targets)).first()
    n = total[0] or 1
    out = paths
    rates = {t: (total[i + 1] or 0.0) / n for i, t in enumerate(targets)}

    def prior_weight(groups: DataFrame, size: str, y: str, center: Column, rate: float) -> float:
        spread = F.pow(F.col(y) / F.col(size) - center, 2)
        noise = F.lit(rate * (1 - rate)) / F.col(size)
        excess = groups.where(f"{size} >= 2").agg(F.sum(F.col(size) * (spread - noise)) / F.sum(size)).first()[0]
        return 1e6 if not excess or excess <= 0 else min(1e6, max(1.0, rate * (1 - rate) / excess))

    host_posts = hosts
    for t, rate in rates.items():
        m = prior_weight(hosts, "hn", f"hy_{t}", F.lit(rate), rate)
        host_posts = host_posts.withColumn(f"host_{t}", (F.col(f"hy_{t}") + m * rate) / (F.col("hn") + m))
    out = out.join(host_posts.select("host", *(f"host_{t}" for t in targets)), "host")
    for t, rate in rates.items():
        m = prior_weight(out, "n", f"y_{t}", F.col(f"host_{t}"), rate)
        out = out.withColumn(f"path_{t}", (F.col(f"y_{t}") + m * F.col(f"host_{t}")) / (F.col("n") + m)).withColumn(f"rate_{t}", F.lit(rate))
    return out.select("host", "path", *(f"{k}_{t}" for t in targets for k in ("host", "path", "rate")))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, order: str, host: Column | None = None, path: Column | None = None, limit: int = LABELLED) -> DataFrame:
    """docs (doc_id, text, ..., and the unique column ``order``) -> row_at (that column), doc_id, p_<t>, host_<t>, path_<t> for low and toxic, keep.

    labels: (doc_id, quality 0/1, toxic 0/1); repeated doc_ids count as toxic if any is and as low
    quality if any is, null labels as good. host and path default to the columns source and lang, nulls
    to ''. A document is kept unless either chance is over REJECT. Without labelled documents of a
    kind nothing of that kind is rejected. Null and empty texts have layout features only.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = docs.select(F.col(order).alias("row_at"), "doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), "text")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("low"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    some = scratch.write(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), "labelled")  # at most ``limit`` rows, so fit to broadcast
    labelled = rows.join(F.broadcast(some), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)))
    labelled = scratch.write(labelled, "training")
    table = weights(*_counts(labelled.where("fold > 0")))
    judged = _evidence(labelled.where("fold = 0"), table, ["low", "toxic"]).toPandas()
    fits = [calibrate(judged[[f"{c}_{t}" for c in COVARIATES]].to_numpy(np.float64), judged[t].to_numpy(np.float64)) for t in TARGETS]
    evidence = _evidence(rows, table, ["row_at", "doc_id", "host", "path"])
    for t, fit in zip(TARGETS, fits):
        odds = sum((F.lit(float(b)) * F.col(f"{c}_{t}") for b, c in zip(fit[1:], COVARIATES)), F.lit(float(fit[0])))
        evidence = evidence.withColumn(f"o_{t}", odds).withColumn(f"p_{t}", _chance(F.col(f"o_{t}"))).drop(*(f"{c}_{t}" for c in COVARIATES))
    evidence = scratch.write(evidence, "evidence")
    sites = scratch.write(site_posteriors(evidence), "sites")
    joined = evidence.drop(*(f"p_{t}" for t in TARGETS)).join(sites, ["host", "path"])
    for t in TARGETS:
        joined = joined.withColumn(f"p_{t}", _chance(F.col(f"o_{t}") + _odds(F.col(f"path_{t}")) - _odds(F.col(f"rate_{t}"))))
    return joined.select("row_at", "doc_id", *(f"{k}_{t}" for t in TARGETS for k in ("p", "host", "path")), ((F.col("p_low") <= REJECT) & (F.col("p_toxic") <= REJECT)).alias("keep"))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """classify() for any documents: null or repeated doc_ids are judged row by row. One row a document."""
    scratch = Scratch(docs.sparkSession, "quality")
    return classify(ordered(docs.select("doc_id", "text", "source", "lang"), scratch, "order_at"), labels, scratch, "order_at", **options).drop("row_at")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns, whatever their names.

    Repeated rows and rows without a doc_id are judged one by one; null and empty texts by their layout and
    site; an empty table gives an empty table, and without labels all stay.
    """
    scratch, order = Scratch(docs.sparkSession, "quality"), free(docs, "order_at")
    keyed = ordered(docs, scratch, order)
    gone = classify(keyed, labels, scratch, order).where("not keep").select(F.col("row_at").alias(order))
    return keyed.join(scratch.write(gone, "rejected"), order, "left_anti").select(*docs.columns)
