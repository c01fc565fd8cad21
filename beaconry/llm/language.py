"""Language identification: per-language piece unigrams, summed over all segmentations of a word.

The pieces are those of a public vocabulary; only their probabilities are learned, by expectation maximisation over
the segmentations of training words. A text's likelihood in a language is the product over its words of the forward
sum over every segmentation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconry.llm.common import batches, cut, release, table
from beaconry.llm.graph import hinted

VOCABULARY = "piece_bpe_32k.model"
UNDETERMINED = "und"
START = "▁"
#: Documents learned from, of each language at most: those with the smallest hashes of their id.
SAMPLE_PER_LANGUAGE = 2_000
ROUNDS = 3
#: The share of a piece's probability that all languages have in common, and what an unknown character costs.
FLOOR, UNKNOWN = 1e-6, 1e-7
NOT_LETTERS = r"[^\pL\pM]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_pieces(path: str | None = None) -> list[str]:
    """Lower-case pieces of letters and combining marks of the public vocabulary, of any length; a leading mark stands
    for the start of a word."""
    import unicodedata

    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = dict.fromkeys([START])
    for i in range(model.get_piece_size()):
        body = (piece := model.id_to_piece(i).lower()).removeprefix(START)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and body and all(unicodedata.category(c)[0] in "LM" for c in body):
            found[piece] = None
    return list(found)


class Pieces:
    """Ids of the pieces at every place of many words at once, by the hash of their characters."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        self.bits = 20
        slot = self._slot(self.hashes)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.slots[slot[::-1]] = np.arange(len(hashes), dtype=np.int32)[::-1]
        rest = self.slots[slot] != np.arange(len(hashes))  # shared slots: looked up by search
        self.rest = set(slot[rest].tolist())
        self.crowded = np.zeros(1 << self.bits, dtype=bool)
        self.crowded[list(self.rest)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where there is none."""
        slot = self._slot(h)
        at = self.slots[slot]
        out = np.where((at >= 0) & (self.hashes[at] == h), self.ids[at], -1)
        if len(more := np.flatnonzero(self.crowded[slot] & (out < 0))):
            at = np.minimum(np.searchsorted(self.hashes, h[more]), len(self.hashes) - 1)
            out[more] = np.where(self.hashes[at] == h[more], self.ids[at], -1)
        return out

    def lattice(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For each end position, (length, ids) of the pieces that end there; ``codes``: words of one length."""
        n = codes.shape[1]
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        h = np.zeros(codes.shape, dtype=np.uint64)
        for length in range(1, min(self.longest, n) + 1):
            h = h[:, :n - length + 1] * _BASE + codes[:, length - 1:] + np.uint64(1)
            ids = self.find(h.ravel()).reshape(h.shape)
            for end in range(length, n + 1):
                if (ids[:, end - length] >= 0).any() or length == 1:
                    out[end].append((length, ids[:, end - length]))
        return out


def by_length(words: list[str], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, characters) of words of equal length, each with the start mark; blocks of bounded size."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        if not n:
            continue
        places = np.flatnonzero(lengths == n)
        step = max(1, most // (n + 1))
        for a in range(0, len(places), step):
            p = places[a:a + step]
            body = flat[starts[p][:, None] + np.arange(n)[None, :]]
            yield p, np.concatenate([np.full((len(p), 1), ord(START), dtype=np.uint64), body], axis=1)


def forward(pieces: Pieces, codes: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """log P(word) in every language; ``probability``: (pieces + 1, languages), the last row for an unknown character.

    Sums over all segmentations position by position; the sums are rescaled as they go, so long words don't underflow.
    """
    lattice, (m, n), k = pieces.lattice(codes), codes.shape, probability.shape[1]
    alpha: list[np.ndarray | None] = [np.ones((m, k))] + [None] * n
    scale = np.zeros(m)
    for end in range(1, n + 1):
        total = np.zeros((m, k))
        for length, ids in lattice[end]:
            if length == 1:
                total += alpha[end - 1] * probability[ids]  # -1 is the last row
            else:
                rows = np.flatnonzero(ids >= 0)
                total[rows] += alpha[end - length][rows] * probability[ids[rows]]
        alpha[end] = total
        if end >= pieces.longest:
            alpha[end - pieces.longest] = None
        if end % 8 == 0:
            top = total.max(axis=1)
            scale += np.log(top)
            for i in range(max(0, end - pieces.longest + 1), end + 1):
                alpha[i] = alpha[i] / top[:, None]
    return np.log(alpha[n]) + scale[:, None]


def _expected(pieces: Pieces, codes: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected numbers of each piece over all segmentations of words of one language (forward and backward sums)."""
    lattice, (m, n) = pieces.lattice(codes), codes.shape
    a, b = np.zeros((n + 1, m)), np.zeros((n + 1, m))
    a[0], b[n] = 1.0, 1.0
    norm = np.ones(n + 1)
    for end in range(1, n + 1):
        for length, ids in lattice[end]:
            q = p[ids] if length == 1 else np.where(ids >= 0, p[ids], 0.0)
            a[end] += a[end - length] * q
        norm[end] = max(a[end].max(), 1e-300) if end % 8 == 0 else 1.0
        if norm[end] != 1.0:
            a[max(0, end - pieces.longest):end + 1] /= norm[end]
    # words beyond what doubles hold teach nothing; they are far longer than any word of a language
    for end in range(n, 0, -1):
        for length, ids in lattice[end]:
            q = p[ids] if length == 1 else np.where(ids >= 0, p[ids], 0.0)
            b[end - length] += b[end] * q
    out = np.zeros(len(p))
    total = b[0]
    ok = total > 0
    f = np.zeros((n + 1, m))
    f[0] = 1.0
    for end in range(1, n + 1):
        for length, ids in lattice[end]:
            q = p[ids] if length == 1 else np.where(ids >= 0, p[ids], 0.0)
            step = f[end - length] * q
            f[end] += step
            share = np.where(ok, weight * step * b[end] / np.where(ok, total, 1.0), 0.0)
            out += np.bincount(np.where(ids >= 0, ids, len(p) - 1), weights=np.where((ids >= 0) | (length == 1), share, 0.0),
                               minlength=len(p))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    probability: np.ndarray  # (pieces + 1, languages)


def held_out(column) -> F.Column:
    """Rows never learned from."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_words(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(lang, word, n) of at most ``per_language`` documents of each language that are not held out.

    The sample's ids are found on ids alone. Counts first tell the range of hashes that holds a language's sample, so a
    task ranks little more than ``per_language`` ids however many documents a hot language or a repeated id has.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text"))
    usable = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    keyed = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("pick"))
    # a quarter more than wanted and a fixed margin, for the count is approximate and hashes are not quite even
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("pick").alias("size"))
    reach = cut(sizes.select("lang", (F.lit(1.25 * per_language + 200) / F.col("size") * 2.0**64 - 2.0**63).alias("reach")))
    near = keyed.join(hinted(reach), "lang").filter(F.col("pick").cast("double") <= F.col("reach"))
    near = near.select("doc_id", "lang", "pick").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("pick", "doc_id"))
    ids = cut(near.withColumn("nth", nth).filter(F.col("nth") <= per_language).select("doc_id", "lang"))
    # at most per_language rows a language
    text = usable.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", F.lower("text").alias("text"))
    words = text.select("lang", F.explode(F.split("text", r"[^\p{L}\p{M}]+")).alias("word")).filter("word <> ''")
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


def fit_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS,
                  vocabulary: str | None = None) -> LanguageModel:
    """Piece probabilities by language from a bounded sample of the labelled rows that are not held out.

    A language is any value of ``lang``. Each language's probabilities are fitted in a task of its own, on the word
    counts of its sample; pieces by language come to the driver, a table bounded by the vocabulary.
    """
    names = vocabulary_pieces(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def fitted(p: pd.DataFrame) -> pd.DataFrame:
        pieces = Pieces(shared.value)
        words, n = p["word"].tolist(), p["n"].to_numpy(dtype=float)
        prob = np.full(pieces.size + 1, 1.0 / pieces.size)
        prob[-1] = UNKNOWN
        blocks = [(c, n[at]) for at, c in by_length(words) if c.shape[1] <= 64]
        for _ in range(rounds):
            counts = sum((_expected(pieces, c, w, prob) for c, w in blocks), np.zeros(pieces.size + 1))
            prob = counts / max(counts[:-1].sum(), 1e-9) * (1 - FLOOR * pieces.size) + FLOOR
            prob[-1] = UNKNOWN
        del blocks
        release()
        return pd.DataFrame({"lang": p["lang"].iloc[0], "piece": np.arange(pieces.size + 1), "p": prob})

    rows = training_words(docs, per_language).groupBy("lang").applyInPandas(fitted, "lang string, piece int, p double")
    found = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("piece", "p"))).alias("p")).select("lang", "p.p").collect()
    found = sorted(found, key=lambda r: r["lang"])
    prob = np.array([r["p"] for r in found]).T if found else np.zeros((len(names) + 1, 0))
    return LanguageModel([r["lang"] for r in found], names, prob)


class Identifier:
    """Predictions for whole texts in a worker."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, Pieces(model.pieces)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        k = len(self.model.languages)
        lowered = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
        split = pc.split_pattern_regex(lowered, NOT_LETTERS)
        flat = split.values.dictionary_encode()
        words = flat.dictionary.to_pylist()
        value = np.zeros((len(words), k))
        if k:
            for at, codes in by_length(words):
                value[at] = forward(self.pieces, codes, self.model.probability)
        letters = np.array([sum(map(str.isalpha, w)) for w in words], dtype=float)
        codes, offsets = flat.indices.to_numpy(), split.offsets.to_numpy()
        tokens = np.concatenate([np.zeros((1, k)), np.cumsum(value[codes], axis=0)])
        sums = tokens[offsets[1:]] - tokens[offsets[:-1]]
        size = np.concatenate([[0.0], np.cumsum(letters[codes])])
        size = size[offsets[1:]] - size[offsets[:-1]]
        if not k:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        # words of a text aren't independent, so its evidence counts by the root of its length
        x = (sums - sums.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(size, 1.0))[:, None]
        score = 1 / np.exp(x).sum(axis=1)
        best = sums.argmax(axis=1)
        none = size == 0
        return ([UNDETERMINED if z else self.model.languages[b] for z, b in zip(none, best)], np.where(none, 0.0, score))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone.

    A text that is null or has no letters is ``und`` with score 0, and so is every text if there was no language to
    learn. Equal likelihoods go to the language first in code-point order. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Identifier(shared.value)
        for b in batches(source, "text", rows=4096, size=3 << 20):
            lang, score = by.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language can be told: those with letters, however few."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_languages(docs))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Identifier(shared.value)
        for b in batches(source, "text", rows=4096, size=3 << 20):
            lang, _ = by.predict(b.column("text"))
            yield b.filter(pa.array([x != UNDETERMINED for x in lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit_languages(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
