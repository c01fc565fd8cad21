"""Packing token sequences: dominance reduction on the histogram of lengths, then best fit for what remains.

Lengths are at most ``capacity``, so the instance is a histogram of at most ``capacity`` numbers however many
documents there are; the plan is made on it and every piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconry.llm.common import batches, cut, table, texts_of
from beaconry.llm.encoding import encoder

CAPACITY = 4096
END_ID = 1
Runs = tuple  # ((length, times), ...): what one sequence holds, in order


def _smallest(counts: np.ndarray, without: int, most: int = 3) -> list[int]:
    """The ``most`` smallest lengths there are, one piece of ``without`` left out."""
    out: list[int] = []
    for length in np.flatnonzero(counts).tolist():
        n = int(counts[length]) - (length == without)
        out += [length] * min(n, most - len(out))
        if len(out) == most:
            break
    return out


def _best_pair(lengths: list[int], left: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two pieces of the largest total that fits, larger first. ``lengths`` ascend."""
    lo, hi, best = 0, len(lengths) - 1, None
    while lo <= hi:
        a, b = lengths[hi], lengths[lo]
        if lo == hi and left[a] < 2:
            break
        if a + b > room:
            hi -= 1
        else:
            if best is None or a + b > sum(best):
                best = (a, b)
            lo += 1
    return best


def _times(counts: np.ndarray, pieces: tuple[int, ...]) -> int:
    return min(int(counts[x]) // pieces.count(x) for x in set(pieces))


def dominance(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Runs, int]]:
    """Martello-Toth reduction: fix sets of up to three pieces that dominate every other sequence with their largest.

    Takes what it fixes off ``counts``; returns (content, how many such sequences). A set that dominates goes on
    dominating while copies of it are left, since taking pieces away only removes its rivals; so each is fixed in bulk.
    """
    fixed: list[tuple[Runs, int]] = []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0:
                room, rest = capacity - j, _smallest(counts, j)
                fits = int(np.searchsorted(np.cumsum(rest), room, side="right"))
                if fits == 0:
                    pieces: tuple[int, ...] | None = (j,)
                else:
                    present = np.flatnonzero(counts[:room + 1]).tolist()
                    left = {x: int(counts[x]) - (x == j) for x in present}
                    present = [x for x in present if left[x] > 0]
                    top, pieces = present[-1], None
                    if fits == 1 or top == room:
                        pieces = (j, top)
                    elif fits == 2:
                        a, b = _best_pair(present, left, room)
                        above = [x for x in present if x > b for _ in range(min(2, left[x]))][:2]
                        if top >= a + b:
                            pieces = (j, top)
                        elif a == top and (len(above) < 2 or sum(above) > room):
                            pieces = (j, a, b)
                if pieces is None:
                    break
                n = _times(counts, pieces)
                for x in pieces:
                    counts[x] -= n
                fixed.append((tuple((x, 1) for x in pieces), n))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Runs, int]]:
    """Longest first, each into the open sequence with the least room that takes it; equal sequences together."""
    open_: dict[int, list[tuple[Runs, int]]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, dtype=bool)

    def put(room: int, runs: Runs, n: int) -> None:
        if n:
            open_[room].append((runs, n))
            rooms[room] = True

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            found = np.flatnonzero(rooms[length:])
            if len(found):
                room = length + int(found[0])
                runs, there = open_[room].pop()
                rooms[room] = bool(open_[room])
            else:
                room, runs, there = capacity, (), n
            each = room // length
            full = min(there, n // each)
            put(room - each * length, runs + ((length, each),), full)
            n -= full * each
            there -= full
            if n and there and n < each:
                put(room - n * length, runs + ((length, n),), 1)
                n, there = 0, there - 1
            if runs:
                put(room, runs, there)
    return [x for room in sorted(open_) for x in open_[room]]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[int, dict[int, np.ndarray]]:
    """(number of sequences, places by length). A place: first rank, first sequence, pieces per sequence, offset."""
    counts = counts.copy()
    made = dominance(counts, capacity) + best_fit(counts, capacity)
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    base = 0
    for runs, n in made:
        offset = 0
        for length, each in runs:
            rows[length].append((ranks[length], base, each, offset))
            ranks[length] += n * each
            offset += length * each
        base += n
    return base, {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, shard int, nth long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, vocabulary: str | None = None, ids: bool = False) -> DataFrame:
    """Documents as token pieces, cut only where longer than ``capacity``. ``nth``: rank in its task and length."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, shard = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        step = 4 * capacity
        for b in batches(source, "text", keep=True):
            rows: list[tuple] = []
            for doc, x in zip(b.column("doc_id").to_pylist(), enc.encode(texts_of(b.column("text")))):
                x += end
                for k, at in enumerate(range(0, len(x), step)):
                    part = x[at:at + step]
                    n = len(part) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), shard, int(seen[n]), part))
                    seen[n] += 1
            *cols, raw = zip(*rows)
            arrays = [pa.array(c, type=t) for c, t in zip(cols, (
                pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "nth"]
            if ids:
                at = np.concatenate([[0], np.cumsum(cols[3])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))))
                names.append("tokens")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", tokens array<int>" if ids else ""))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, vocabulary: str | None = None, ids: bool = False) -> DataFrame:
    """A row per piece with its sequence and the offset there; ``ids`` adds the token ids.

    A null or empty text is a document of the end id alone. Every row is a document, also where ids repeat or are
    null. Other columns are not read; an empty table packs nothing. Only the histogram and the plan made from it
    (rows in the order of ``capacity``) pass through the driver.
    """
    spark = docs.sparkSession
    rows = cut(pieces(docs, id_col, text_col, capacity, end_id, vocabulary, ids))
    each = cut(rows.groupBy("shard", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(plan(counts, capacity)[1])
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = each.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                p = places.value[x]
                p = p[np.searchsorted(p[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - p[:, 0]
                seq[at], off[at] = p[:, 1] + nth // p[:, 2], p[:, 3] + nth % p[:, 2] * x
            keep = b.select([c for c in b.schema.names if c not in ("rank", "length")])
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array(length.astype(np.int64)), pa.array(seq), pa.array(off)],
                names=[*keep.schema.names, "length", "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "ids_crc32", *(["tokens"] if ids else [])]
    ranked = rows.join(first, ["shard", "length"]).select(*kept, "length", (F.col("first") + F.col("nth")).alias("rank"))
    out = ranked.mapInArrow(run, "doc_id long, piece int, start long, ids_crc32 long, " + (
        "tokens array<int>, " if ids else "") + "length long, sequence_id long, offset long")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      *(["tokens"] if ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens, doc_ids, ends) from ``pack(..., ids=True)``; a sequence holds at most ``capacity`` ids."""
    part = F.struct("offset", "length", "doc_id", "tokens")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return rows.select("sequence_id", F.flatten("p.tokens").alias("tokens"), F.col("p.doc_id").alias("doc_ids"),
                       F.transform("p", lambda x: x["offset"] + x["length"]).alias("ends"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
