"""Operator 3: text quality by hierarchical empirical Bayes.

Three sources of evidence meet in one posterior:

1. a document classifier: logistic regression on shape features of the whole text;
2. the host: labelled documents and, with less weight, the classifier's belief about
   every document of the host, shrunk towards the global rate;
3. the path within the host, shrunk towards the host's posterior.

How strongly a sparse site is shrunk is estimated from the spread between sites by
the method of moments. The site's log odds against the global rate are added to the
classifier's. All site counts are grouped aggregations with partial sums, so a host
with a third of all documents is summed before it is shuffled.

`documents` has no address: its source stands for the host and its lang for the path.

Defined results: null text is empty text; a null host or path is the empty one.
Unlabelled or null labels are not learnt from; a document labelled twice counts as
good if one label says so; of rows that share a doc_id the classifier learns from one,
that with the least features. Without labels of both kinds the classifier gives 0.5.
Repeated rows each count, and get equal results. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, bounded_sample, durable, in_chunks, texts_of, unused

TRAIN_ROWS = 20_000
#: What the classifier's belief about an unlabelled document counts against a label.
BELIEF_WEIGHT = 0.2
KEEP_AT = 0.5
MOST_SITES = 100_000
#: The most and least a site may add to the log odds.
SITE_LIMIT = 1.5

FEATURES = ["log_chars", "upper", "symbols", "digits", "blanks", "distinct_words", "odd_ends", "shout_words", "repeated_lines", "word_length", "top_word", "top_pair", "lines", "marks"]
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower or non-ASCII, 3 digit, 4 white space, 5 prose mark, 6 other symbol
_KIND[33:127], _KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 6, 1, 2, 2, 3
for _c in b" \t\n\r\x0b\x0c":
    _KIND[_c] = 4
for _c in b".,;:!?'\"()-":
    _KIND[_c] = 5


def features(text: str) -> list[float]:
    """Shape of a whole text, as numbers near 0 to 1 (see FEATURES)."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) / n
    words = raw.split()
    count = max(1, len(words))
    tally = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x]
    ends = Counter(w[-1] for w in words)
    odd = sum(c for b, c in ends.items() if _KIND[b] == 6 or b == 33)
    shout = sum(c for w, c in tally.items() if len(w) > 1 and w.isupper())
    return [
        np.log1p(n) / 10, kinds[1], kinds[6], kinds[3], kinds[4], len(tally) / count, odd / count, shout / count,
        1 - len(set(lines)) / max(1, len(lines)), min(1.0, (n / count) / 20), max(tally.values(), default=0) / count,
        max(pairs.values(), default=0) / count, min(1.0, len(lines) / count), kinds[5],
    ]


class Logistic:
    """Ridge logistic regression on standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> None:
        self.mean, self.scale = np.zeros(2 * len(FEATURES)), np.ones(2 * len(FEATURES))
        self.w = np.zeros(2 * len(FEATURES) + 1)
        if not len(y) or y.min() == y.max():
            return
        x = np.hstack([x, x * x])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(z.shape[1])
            step = np.linalg.solve(hess, z.T @ (p - y) + ridge * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.hstack([x, x * x])
        return self.w[0] + np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[1:]


def measured(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path and the features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            found = [features(t or "") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "host", "path", "x"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, host string, path string, x array<double>")


def sites(believed: DataFrame, known: DataFrame) -> DataFrame:
    """host, path, n_host, n_path and the path's posterior rate of good documents.

    `believed`: doc_id, host, path, p of every document; `known`: doc_id, good of the labelled ones.
    """
    weight = F.lit(BELIEF_WEIGHT)
    by_belief = believed.groupBy("host", "path").agg((weight * F.count("*")).alias("n"), (weight * F.sum("p")).alias("good"), F.lit(0).cast("long").alias("labelled"))
    by_label = believed.select("doc_id", "host", "path").join(known, "doc_id").groupBy("host", "path").agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col("good").cast("double")).alias("good"), F.count("*").alias("labelled"))
    paths = durable(by_belief.unionByName(by_label).groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("labelled").alias("labelled")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    n, good = paths.agg(F.sum("n"), F.sum("good")).first()
    rate = min(max((good or 0) / max(n or 1, 1e-9), 1e-3), 1 - 1e-3)

    def strength(groups: DataFrame, n: str, good: str) -> float:
        """Pseudo-count of the prior: rate(1-rate)/variance between groups - 1."""
        moments = groups.agg(F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - rate, 2)).alias("s"), F.sum(n).alias("n"), F.count("*").alias("k")).first()
        if not moments["n"] or moments["k"] < 2:
            return 50.0
        within = rate * (1 - rate) * moments["k"] / moments["n"]
        between = max(moments["s"] / moments["n"] - within, 1e-6)
        return float(min(max(rate * (1 - rate) / between - 1, 5.0), 1e4))

    s_host, s_path = strength(hosts, "host_n", "host_good"), strength(paths, "n", "good")
    joined = paths.join(hosts, "host").withColumn("host_rate", (F.col("host_good") + s_host * rate) / (F.col("host_n") + s_host))
    return joined.select("host", "path", "host_rate", ((F.col("good") + s_path * F.col("host_rate")) / (F.col("n") + s_path)).alias("path_rate"), F.lit(rate).alias("rate"))


def fit(table: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Logistic, DataFrame, DataFrame]:
    """The document classifier, the table of documents with its belief (z, p), and the sites' posteriors.

    The classifier is fitted on at most `rows` labelled documents, those with the least hash of doc_id.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id is not null and good is not null")
    known = known.groupBy("doc_id").agg((F.max("good") > 0).cast("int").alias("good"))
    labelled = table.join(known, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("good").alias("good"))  # one row however often an id repeats
    sample = bounded_sample(labelled, "doc_id", rows).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["x"]))
    model = Logistic(np.array([r["x"] for r in sample]).reshape(len(sample), len(FEATURES)), np.array([float(r["good"]) for r in sample]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.logits(x))], names=["doc_id", "host", "path", "z"])

    believed = table.mapInArrow(run, "doc_id long, host string, path string, z double").withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    return model, believed, durable(sites(believed, known))


def site_odds() -> Column:
    """What a site adds to the log odds; 0 where nothing is known of it."""
    odds = lambda p: F.log(F.col(p) / (1 - F.col(p)))
    return F.coalesce(F.greatest(F.lit(-SITE_LIMIT), F.least(F.lit(SITE_LIMIT), odds("path_rate") - odds("rate"))), F.lit(0.0))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, host, path, evidence (classifier alone), path_rate, quality (posterior) and keep of every row."""
    _, believed, site = fit(durable(measured(docs, host, path)), labels, rows)
    quality = 1 / (1 + F.exp(-(F.col("z") + site_odds())))
    out = believed.join(site, ["host", "path"], "left").select("doc_id", "host", "path", F.col("p").alias("evidence"), "path_rate", quality.alias("quality"))
    return out.withColumn("keep", F.col("quality") >= KEEP_AT)


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs`, with all their columns, that `classify` keeps.

    Sites are few against documents. Up to MOST_SITES they are sent to all tasks and the
    texts stay where they are; beyond that they meet by a shuffle.
    """
    model, _, site = fit(durable(measured(docs, host, path)), labels, rows)
    site_host, site_path, odds = (unused(docs, n) for n in ("_site_host", "_site_path", "_site_odds"))
    added = site.select(F.col("host").alias(site_host), F.col("path").alias(site_path), site_odds().alias(odds))
    added = F.broadcast(added) if site.count() <= MOST_SITES else added
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    met = docs.join(added, (text(host) == F.col(site_host)) & (text(path) == F.col(site_path)), "left").select(*docs.columns, odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            z = model.logits(np.array([features(t) for t in texts_of(batch)]))
            z = z + np.array([x or 0.0 for x in batch.column(batch.num_columns - 1).to_pylist()])
            kept = batch.filter(pa.array(z >= np.log(KEEP_AT / (1 - KEEP_AT))))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

    return met.mapInArrow(run, docs.schema)
