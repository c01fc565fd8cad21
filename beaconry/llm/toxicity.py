"""Toxic passages: maximum-scoring segments of word log-odds, with extreme-value significance.

Words carry the log-odds of their strongest feature (the word itself or a prefix of it) under informative Dirichlet
priors; every other word carries one slightly negative score. A linear scan finds all maximal segments of a text,
Karlin-Altschul statistics give each its expected number by chance, and a text's score is the calibrated sum of the
significance of its segments.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import batches, cut, table, texts_of

WORDS = regex.compile(r"[\p{L}\p{N}_]+")
NOT_WORDS = r"[^\pL\pN_]+"
PREFIXES = (4, 5, 6)
#: Labelled documents learned from: so many toxic ones and twice as many others, those with the smallest hashes of their id.
SAMPLE_TOXIC = 10_000
#: Of the sample, this share of hashes calibrates, the rest gives the log-odds.
CALIBRATE = 4
#: A feature counts if its log-odds are this large, in standard errors and as they are.
LEAST_Z, LEAST_ODDS = 2.6, 2.5
#: The prior's weight, as a share of all counts.
PRIOR = 0.05
THRESHOLD = 0.7


def features(word: str) -> list[str]:
    """A word and its prefixes; prefixes end in a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


@dataclass
class ToxicModel:
    odds: dict[str, float] = field(default_factory=dict)
    other: float = -0.01
    rate: float = 1.0  # lambda
    scale: float = 1e-6  # K
    intercept: float = -3.0
    slope: float = 0.0

    def word(self, word: str) -> float:
        return max((self.odds[f] for f in features(word) if f in self.odds), default=self.other)

    def segments(self, text: str) -> list[tuple[int, int, float, float]]:
        """(first character, end, score, log of the expected number by chance) of every maximal segment."""
        found = list(WORDS.finditer(text))
        hits = [(i, s) for i, m in enumerate(found) if (s := self.word(m.group().lower())) > 0]
        return [(found[a].start(), found[b].end(), s, math.log(self.scale * len(found)) - self.rate * s)
                for a, b, s in maximal_segments(hits, self.other)]

    def evidence(self, segments: list[tuple[int, int, float, float]]) -> float:
        """Summed significance: for each segment the negative log of its chance probability."""
        return sum(-math.log(-math.expm1(-math.exp(min(e, 6.0)))) if e > -25 else -e for _, _, _, e in segments)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.intercept + self.slope * evidence))))


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text (Ruzzo and Tompa's linear scan).

    ``hits``: positions and scores of the positive words in order; every word between has the score ``other`` < 0.
    """
    segments: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum at the end
    total, at = 0.0, 0
    for i, s in hits:
        total += other * (i - at)
        first, last, left, right = i, i, total, total + s
        total, at = right, i + 1
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= left:
                j -= 1
            if j < 0 or segments[j][3] >= right:
                break
            first, left = segments[j][0], segments[j][2]
            del segments[j:]
        segments.append((first, last, left, right))
    return [(a, b, right - left) for a, b, left, right in segments]


def held_out(column) -> F.Column:
    """Rows never learned from."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, toxic_sample: int = SAMPLE_TOXIC) -> DataFrame:
    """(text, label, weight, calibrate) of at most ``toxic_sample`` toxic and twice as many other documents.

    Only the sample's ids (``3 * toxic_sample`` rows at most) are broadcast. Copies weigh as one document together:
    texts are grouped by the smallest hash of their five-word windows.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(
        "doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.filter(~held_out(F.col("doc_id"))).withColumn("pick", F.xxhash64("doc_id"))
    some = [ids.filter(F.col("label") == y).orderBy("pick", "doc_id").limit(n) for y, n in ((0, 2 * toxic_sample), (1, toxic_sample))]
    sample = cut(some[0].unionByName(some[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = rows.join(F.broadcast(sample), "doc_id")
    words = F.split(F.lower("text"), r"\s+")
    rows = rows.withColumn("w", words).withColumn("group", F.array_min(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - 5, F.lit(0))), lambda i: F.xxhash64(F.slice("w", i + 1, 5)))))
    rows = cut(rows.select("doc_id", "text", "label", "pick", "group"))
    sizes = rows.groupBy("group").agg((1.0 / F.count("*")).alias("weight"), F.min("pick").alias("first"))
    return cut(rows.join(sizes, "group").select("text", "label", "weight", (F.pmod("first", F.lit(CALIBRATE)) == 0).alias("calibrate")))


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): weighted numbers of documents that hold a feature."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source, "text", rows=4096, size=2 << 20):
            sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for text, y, w in zip(texts_of(b.column("text")), b.column("label").to_pylist(), b.column("weight").to_pylist()):
                for f in {f for x in set(WORDS.findall(text.lower())) for f in features(x)}:
                    sums[f][1 - y] += w
            both = np.array(list(sums.values())).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])],
                                             names=["feature", "toxic", "clean"])

    out = sample.select("text", "label", "weight").mapInArrow(run, "feature string, toxic double, clean double")
    return out.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _positive(counts: DataFrame, prior: float, least_z: float, least_odds: float) -> dict[str, float]:
    """Log-odds of the features that count. Each needs several toxic documents of the bounded sample, so they are few."""
    n = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    n1, n0 = n[0] or 0.0, n[1] or 0.0
    if not n1 or not n0:
        return {}
    mass = prior * (n1 + n0)
    alpha = mass * (F.col("toxic") + F.col("clean")) / F.lit(n1 + n0)
    y1, y0 = F.col("toxic") + alpha, F.col("clean") + alpha
    odds = F.log(y1 / (n1 + mass - y1)) - F.log(y0 / (n0 + mass - y0))
    z = odds / F.sqrt(1 / y1 + 1 / y0)
    rows = counts.filter("toxic > 0").select("feature", odds.alias("odds"), z.alias("z"))
    return {r[0]: r[1] for r in rows.filter((F.col("z") >= least_z) & (F.col("odds") >= least_odds)).select("feature", "odds").collect()}


def _rate(scores: np.ndarray, share: np.ndarray, other: float) -> float:
    """lambda > 0 with sum p(s) exp(lambda s) = 1, for words of a clean text."""
    rest, lo, hi = 1 - share.sum(), 0.0, 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum() + rest * math.exp(x * other))
    while value(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(y - p).sum() - ridge * a, ((y - p) * x).sum() - ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(max(b, 0.0))


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic_sample: int = SAMPLE_TOXIC, prior: float = PRIOR,
                 least_z: float = LEAST_Z, least_odds: float = LEAST_ODDS) -> ToxicModel:
    """Learn from a bounded sample of the labelled rows that are not held out.

    Null texts, null labels and labels of unknown documents teach nothing; without both labels no word is toxic.
    What comes to the driver is bounded by the sample: its significant features and one evidence per document.
    """
    sample = training_sample(docs, labels, toxic_sample)
    model = ToxicModel(odds=_positive(feature_counts(sample.filter("not calibrate")), prior, least_z, least_odds))
    if not model.odds:
        return model

    def tally(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source, "text"):
            rows = []
            for text in texts_of(b.column("text")):
                words = WORDS.findall(text.lower())
                hits = [s for w in words if (s := model.word(w)) > 0]
                rows.append((len(words), len(hits), sum(hits), max(hits, default=0.0)))
            yield pa.RecordBatch.from_arrays([b.column("label"), *(pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64())))], names=["label", "n", "hits", "total", "most"])

    t = sample.select("text", "label").mapInArrow(tally, "label int, n long, hits long, total double, most double")
    sums = {r["label"]: r for r in t.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("n", "hits", "total"))).collect()}
    if len(sums) < 2:
        return model
    toxic, clean = ((r["hits"] + 0.5) / (r["n"] + 1.0) for r in (sums[1], sums[0]))
    model.other = min(-1e-3, math.log1p(-min(toxic, 0.9)) - math.log1p(-clean))
    scores = np.array(sorted(model.odds.values()))
    # clean texts hold features at the rate seen there, spread over the scores that there are
    model.rate = _rate(scores, np.full(len(scores), clean / len(scores)), model.other)
    at = float(scores[0])
    model.scale = (sums[0]["hits"] + 0.5) / ((sums[0]["n"] + 1.0) * math.exp(-model.rate * at))

    def evidences(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source, "text"):
            x = [model.evidence(model.segments(t)) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.float64())], names=["label", "x"])

    seen = sample.select("text", "label").mapInArrow(evidences, "label int, x double").collect()  # the bounded sample
    x, y = np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen], dtype=float)
    model.intercept, model.slope = _logistic(x, y)
    return model


class Scorer:
    """Scores of whole texts in a worker; only texts with a toxic word are scanned word by word."""

    def __init__(self, model: ToxicModel):
        self.model, self.known = model, {}

    def positive(self, word: str) -> bool:
        if word not in self.known:
            if len(self.known) > 300_000:
                self.known = {}
            self.known[word] = any(f in self.model.odds for f in features(word))
        return self.known[word]

    def suspects(self, texts: pa.Array) -> np.ndarray:
        """Whether a text holds any toxic word."""
        words = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), NOT_WORDS)
        flat = words.values.dictionary_encode()
        hit = np.array([self.positive(w) for w in flat.dictionary.to_pylist()], dtype=bool)
        out = np.zeros(len(texts), dtype=bool)
        if hit.any():
            at = np.flatnonzero(hit[flat.indices.to_numpy()])
            out[np.searchsorted(words.offsets.to_numpy(), at, side="right") - 1] = True
        return out

    def segments(self, texts: pa.Array) -> list[list[tuple[int, int, float, float]]]:
        return [self.model.segments(t or "") if s else [] for t, s in zip(texts.to_pylist(), self.suspects(texts))]

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.array([self.model.score(self.model.evidence(s)) for s in self.segments(texts)])


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, passages) of every row; passages: start, end (characters), score, log_expected.

    A null or empty text has no passage and the lowest score. Repeated rows score alike; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("log_expected", pa.float64())]))
        for b in batches(source, "text"):
            found = scorer.segments(b.column("text"))
            score = [shared.value.score(shared.value.evidence(s)) for s in found]
            rows = [[dict(zip(("start", "end", "score", "log_expected"), s)) for s in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()),
                 pa.array(rows, kind)], names=["doc_id", "score", "predicted", "passages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, "
                                "passages array<struct<start:int,end:int,score:double,log_expected:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches(source, "text"):
            yield b.filter(pa.array(scorer.scores(b.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
