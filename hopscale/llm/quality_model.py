"""Operator 10: quality by hierarchical empirical Bayes.

A logistic model on surface features gives each document its own evidence: a probability. Sites lend
strength. What is known of a document (its label if it has one, else the model's probability) is summed
by (host, path), these sums by host, and these over all. Each level is a beta posterior shrunk toward
the level above, with a strength estimated from the spread between hosts or paths, so sparse sites stay
near the global rate and rich ones speak for themselves. A document is left out of the sums of its path,
its host and the whole when it is judged itself. Its log odds are shifted by those of its path against
the global rate. The strengths are two numbers estimated from all documents.

Only a bounded sample of labelled rows comes to the driver for fitting (`max_labelled`, by hash of the
id); features, sums and strengths cover all documents, and all labels count in the sums. Sums are of
integers or decimals, so they do not depend on the order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscale.llm.text import without
from hopscale.scratch import Scratch, small

MAX_LABELLED = 20_000
UNIT = 1_000_000
FEATURES = ("log_words", "word_len", "upper", "digit", "symbol", "mark", "stop", "shout", "bar", "high", "distinct", "fresh", "lines", "dup_lines")

_SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]\\^~=_@+", np.uint8)
_MARKS = np.frombuffer(b".,;:!?", np.uint8)


def features(text: bytes) -> list[float]:
    """Surface features of a text, in the order of FEATURES."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = Counter(x for x in text.split(b"\n") if x.strip())
    n_lines = sum(lines.values())
    chars = max(1, sum(map(len, words)))
    # eight-word windows, as the share of windows that are new
    eights = {hash(w) for w in zip(*[words[k:] for k in range(8)], strict=False)} if n >= 8 else set()
    per = max(1, n)
    return [
        float(np.log1p(n)),
        chars / per,
        at[65:91].sum() / size,
        at[48:58].sum() / size,
        at[_SYMBOLS].sum() / per,
        at[_MARKS].sum() / per,
        at[46] / per,
        text.count(b"!!") / per,
        at[124] / per,
        at[128:].sum() / size,
        len(set(words)) / per,
        len(eights) / (n - 7) if n >= 8 else 1.0,
        n_lines / per,
        1 - len(lines) / n_lines if n_lines else 0.0,
    ]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([features(t) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(FEATURES))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), flat], [*b.schema.names[:-1], "f"])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model on raw features, the intercept first. Without both classes: the smoothed rate (1 without rows)."""
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 1 + (len(y) > 0)) if len(y) else 1 - 1e-6
        return np.concatenate(([np.log(p / (1 - p))], np.zeros(x.shape[1])))
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    w, pen = np.zeros(z.shape[1]), np.concatenate(([1e-6], np.full(x.shape[1], ridge)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    raw = w[1:] / sd
    return np.concatenate(([w[0] - raw @ mean], raw))


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _inside(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def _exact(x: Column) -> Column:
    """Sum of doubles as decimals of nine places, which come out the same in any order."""
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def _strength(groups: DataFrame, n: str, s: str, mean: str) -> DataFrame:
    """One row (k): the method-of-moments strength of a beta prior, from groups' counts, sums and prior means; between 1 and 10000."""
    size, m = F.col(n).cast("double"), F.col(mean)
    t = groups.agg(
        _exact(size * F.pow(F.col(s) / size - m, 2)).alias("spread"),
        F.sum(n).cast("double").alias("size"),
        _exact(m * (1 - m)).alias("most"),
        F.count("*").cast("double").alias("g"),
    )
    # variance between groups, weighted by size, beyond what their sizes explain: m (1 - m) / size each
    between = F.try_divide(F.col("spread") - F.col("most"), F.col("size"))
    k = F.try_divide(F.col("most"), F.col("g")) / F.greatest(between, F.lit(1e-9)) - 1
    return t.select(F.least(F.greatest(k, F.lit(1.0)), F.lit(1e4)).alias("k"))


def score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", max_labelled: int = MAX_LABELLED, reject_below: float = 0.5, tmp: Scratch | None = None) -> DataFrame:
    """(doc_id, text_key, doc_quality, host_quality, path_quality, quality, kept) for every row of docs.

    host_quality is the host's posterior without the document, path_quality that of its path.
    Null texts are empty; null hosts and paths are sites of their own; rows with null ids are scored
    like any other but never labelled. Labels that are null are not used, of several for one id the
    lowest; a label holds for all texts of its id. Repeated rows are scored alike and all count for
    their site. Without labels everything is kept. Extra columns are not read. An empty table gives an
    empty result.
    """
    tmp = tmp or Scratch(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = tmp.put(own.mapInArrow(_run, "doc_id long, text_key long, host string, path string, f array<double>"), "features")

    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_i")).agg(F.min(label).cast("double").alias("y"))
    known = tmp.put(known, "known")
    some = tmp.put(known.orderBy(F.xxhash64("_i"), "_i").limit(max_labelled), "labelled")
    # repeated ids: one row each, so that the sample stays bounded
    train = rows.join(some, F.col("doc_id") == F.col("_i")).groupBy("_i").agg(F.min(F.struct("text_key", "f", "y")).alias("r")).select("r.f", "r.y").collect()
    train.sort()
    w = fit(np.array([r.f for r in train], np.float64).reshape(-1, len(FEATURES)), np.array([r.y for r in train], np.float64))

    line = F.lit(float(w[0]))
    for k, b in enumerate(w[1:].tolist()):
        line = line + F.lit(b) * F.get("f", F.lit(k))
    p = F.round((1 / (1 + F.exp(-F.least(F.greatest(line, F.lit(-30.0)), F.lit(30.0))))) * UNIT).cast("long")
    rows = rows.withColumn("_p", p).drop("f").join(small(known), F.col("doc_id") == F.col("_i"), "left")
    rows = tmp.put(rows.withColumn("_e", F.coalesce(F.round(F.col("y") * UNIT).cast("long"), F.col("_p"))).drop("_i", "y"), "evidence")
    unit = lambda c: F.col(c) / F.lit(float(UNIT))
    paths = tmp.put(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("_e").alias("s")), "paths")
    hosts = tmp.put(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "hosts")
    total = tmp.put(hosts.agg(F.coalesce(F.sum("hn"), F.lit(0)).alias("gn"), F.coalesce(F.sum("hs"), F.lit(0)).alias("gs")).withColumn("m", _inside(F.coalesce(F.try_divide(unit("gs"), F.col("gn")), F.lit(0.5)))), "total")  # one row
    hosts = hosts.crossJoin(F.broadcast(total)).withColumn("_hs", unit("hs"))
    k1 = tmp.put(_strength(hosts, "hn", "_hs", "m").withColumnRenamed("k", "k1"), "k1")  # one row
    hosts = hosts.crossJoin(F.broadcast(k1)).withColumn("_prior", _inside((F.col("k1") * F.col("m") + F.col("_hs")) / (F.col("k1") + F.col("hn"))))
    sites = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).withColumn("_s", unit("s"))
    k2 = tmp.put(_strength(sites, "n", "_s", "_prior").withColumnRenamed("k", "k2"), "k2")  # one row
    sites = tmp.put(sites.crossJoin(F.broadcast(k2)).select("_h", F.col("path").alias("_q"), "n", "s", "hn", "hs", "gn", "gs", "k1", "k2"), "sites")

    r = rows.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_q")))
    # without the document itself; of a single one nothing is left but the prior
    left = lambda n, s: (F.col(n) - 1, (F.col(s) - F.col("_e")) / F.lit(float(UNIT)))
    (gn, gs), (hn, hs), (n, s) = left("gn", "gs"), left("hn", "hs"), left("n", "s")
    r = r.withColumn("_m", _inside(F.when(gn > 0, F.try_divide(gs, gn)).otherwise(F.col("_p") / F.lit(float(UNIT)))))
    r = r.withColumn("host_quality", F.round(_inside((F.col("k1") * F.col("_m") + hs) / (F.col("k1") + hn)), 9))
    r = r.withColumn("path_quality", F.round(_inside((F.col("k2") * F.col("host_quality") + s) / (F.col("k2") + n)), 9))
    r = r.withColumn("doc_quality", unit("_p"))
    odds = _logit(_inside(F.col("doc_quality"))) + _logit(F.col("path_quality")) - _logit(F.col("_m"))
    r = r.withColumn("quality", F.round(1 / (1 + F.exp(-odds)), 6))
    return r.select("doc_id", "text_key", "doc_quality", "host_quality", "path_quality", "quality", (F.col("quality") >= reject_below).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay, whatever their names. Nulls and repeats as for score."""
    tmp = Scratch(docs.sparkSession)
    bad = score(docs, labels, doc_id=doc_id, text=text, tmp=tmp, **options).where(~F.col("kept")).select("doc_id", "text_key").distinct()
    return without(docs, tmp.put(bad, "rejected"), doc_id, text)
