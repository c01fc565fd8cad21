"""Similarity join of documents by the Jaccard similarity of their word n-grams, complete and by signature trees.

1. A document's set is its distinct n-gram hashes. A task counts which of its documents' n-grams another document has,
   and sends each n-gram once to the place where equal ones meet. A document with fewer shared n-grams than a link
   needs has no link; most documents end here.
2. Of the others, n-grams are ordered from the rarest; two sets that link share one of their first n-grams, so many
   as they may lose and one more. Documents that share one, directly or in turn, form a coarse group: no link leaves it.
3. In each coarse group signature trees (OR- and AND-combined bitmaps, size ranges) are traversed in pairs, node pairs
   that can't overlap enough are pruned, and what remains is verified on the sets. Large groups are cut into blocks
   of bounded size whose pairs are tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import batches, cut, parts, release, table
from beaconry.llm.graph import components, hinted

WORDS, SIMILARITY = 5, 80
#: N-grams a reducer gets, n-grams of a block, and n-grams a task holds before it combines them.
PER_REDUCER, BLOCK, HELD = 1_000_000, 1_000_000, 1_000_000
BITMAP_WORDS = 32
LEAF, FAN = 16, 8

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_P = _U(0x9E3779B97F4A7C15)
_SEEDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (splitmix64's last steps)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    inner = ~_SPACE[data]
    before, after = np.empty_like(inner), np.empty_like(inner)
    before[1:], after[:-1] = inner[:-1], inner[1:]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[filled] = False
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    starts, ends = np.flatnonzero(inner & ~before), np.flatnonzero(inner & ~after) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    length = ends - starts
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    powers = np.multiply.accumulate(np.full(int(length.max()), _P, dtype=np.uint64))
    sums = np.add.reduceat(_BYTES[data[inner]] * powers[place], at)
    return mix64(sums ^ length.astype(np.uint64)), np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct n-grams, ascending. Fewer words than ``n``: all of them as one."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    base, stop = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(raw, dtype=np.uint8)[base:stop] if stop > base else np.zeros(0, dtype=np.uint8)
    words, doc = word_hashes(data, offsets - base)
    counts = np.bincount(doc, minlength=len(texts))
    factors = np.array([(0xD6E8FEB86659FD93 * (2 * j + 3)) & 0xFFFFFFFFFFFFFFFF | 1 for j in range(n)], dtype=np.uint64)
    if len(words) >= n:
        grams = sum((words[j:len(words) - n + 1 + j] * f for j, f in enumerate(factors)), np.zeros(len(words) - n + 1, dtype=np.uint64))
        whole = doc[:len(words) - n + 1] == doc[n - 1:]
        grams, owner = mix64(grams)[whole], doc[:len(words) - n + 1][whole]
    else:
        grams, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        at = np.cumsum(counts) - counts
        one = [(words[at[i]:at[i] + counts[i]] * factors[:counts[i]]).sum() for i in short.tolist()]
        one = np.array(one, dtype=np.uint64) ^ counts[short].astype(np.uint64)
        grams, owner = np.concatenate([grams, mix64(one)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    grams = np.ascontiguousarray(grams)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(texts)))])


def set_sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Wrapping sums of ``x`` between the offsets; nothing sums to 0."""
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    full = offsets[:-1] < offsets[1:]
    if full.any():
        out[full] = np.add.reduceat(x, offsets[:-1][full])
    return out


class Bands:
    """Bands of set sizes: two sets that may link lie in the same band or in neighbouring ones."""

    def __init__(self, similarity: int):
        self.similarity, self.least = similarity, np.array([1], dtype=np.int64)

    def _reach(self, size: int) -> None:
        least = self.least.tolist()
        while len(least) < 3 or least[-3] <= size:
            least.append(least[-1] * 100 // self.similarity + 1)
        self.least = np.array(least, dtype=np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self._reach(int(sizes.max(initial=1)))
        return np.searchsorted(self.least, sizes, side="right") - 1


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def set_table(rows: DataFrame, n: int, similarity: int) -> DataFrame:
    """(doc_id, n, h1, h2, band): size, 128-bit hash and size band of every set."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(similarity)
        for b in batches(source, "text", rows=4096, size=1 << 20):
            x, off = shingle_sets(b.column("text"), n)
            size = np.diff(off)
            h = [set_sums(mix64(x ^ _U(c)), off).view(np.int64) for c in _SEEDS]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size), pa.array(h[0]), pa.array(h[1]), pa.array(bands.of(np.maximum(size, 1)).astype(np.int32))],
                names=["doc_id", "n", "h1", "h2", "band"])

    return rows.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, band int")


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)


def _message(part: int, docs: np.ndarray, counts: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    raw = [pa.array([x.tobytes()], pa.binary()) for x in (docs.astype(np.int64), counts.astype(np.int32), keys.astype(np.uint32), marks.astype(np.uint32))]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *raw], names=["part", "docs", "counts", "keys", "marks"])


def shared_counts(rows: DataFrame, n: int, reducers: int) -> DataFrame:
    """(doc_id, shared): how many of a document's n-grams some other document has; at least that many.

    A task's n-grams that several of its documents have are counted there and sent once, so an n-gram of a third of
    all documents costs a reducer one entry per task. Reducers compare 32 bits of the hashes of their share; equal bits
    of different n-grams only raise a count.
    """
    def send(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([h[1] for h in held])
            x = np.concatenate([h[0] for h in held])
            owner = np.repeat(np.arange(len(ids)), np.concatenate([h[2] for h in held]))
            order = np.argsort(x, kind="stable")
            starts = _runs(x[order])
            several = np.diff(np.concatenate([starts, [len(x)]])) > 1
            both = np.zeros(len(x), dtype=bool)
            both[order] = np.repeat(several, np.diff(np.concatenate([starts, [len(x)]])))
            local = np.bincount(owner[both], minlength=len(ids))
            some = np.flatnonzero(local)
            yield _message(int(ids[0] % reducers), ids[some], -local[some], np.zeros(0), np.zeros(0))
            marks = x[order[starts[several]]]
            alone = np.flatnonzero(~both)
            part = lambda v: (((v >> _U(32)) * _U(reducers)) >> _U(32)).astype(np.int64)
            parts_x, parts_m = part(x[alone]), part(marks)
            order = np.argsort(parts_x, kind="stable")  # documents stay together within a part
            cut_x = np.searchsorted(parts_x[order], np.arange(reducers + 1))
            cut_m = np.searchsorted(parts_m, np.arange(reducers + 1))  # ascending as the hashes are
            for p in range(reducers):
                e = alone[order[cut_x[p]:cut_x[p + 1]]]
                m = marks[cut_m[p]:cut_m[p + 1]]
                if len(e) or len(m):
                    first = _runs(owner[e])
                    yield _message(p, ids[owner[e[first]]], np.diff(np.concatenate([first, [len(e)]])), x[e] & _U(0xFFFFFFFF), m & _U(0xFFFFFFFF))

        for b in batches(source, "text", rows=4096, size=1 << 20):
            b = b.filter(pc.is_valid(b.column("doc_id")))
            x, off = shingle_sets(b.column("text"), n)
            if len(x):
                full = np.flatnonzero(np.diff(off))
                held.append((x, b.column("doc_id").to_numpy()[full], np.diff(off)[full]))
                size += len(x)
            if size >= HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def spread(docs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        to = docs % reducers
        order = np.argsort(to, kind="stable")
        ends = np.concatenate([_runs(to[order]), [len(to)]])
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            e = order[a:b]
            yield pa.RecordBatch.from_arrays([pa.array([int(to[e[0]])], pa.int32()), pa.array([docs[e].tobytes()], pa.binary()),
                                              pa.array([counts[e].astype(np.int32).tobytes()], pa.binary())], names=["part", "docs", "counts"])

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in source:
            for part, *raw in zip(*(b.column(c).to_pylist() for c in ("part", "docs", "counts", "keys", "marks"))):
                docs, counts, keys, marks = (np.frombuffer(r, dtype=t) for r, t in zip(raw, ("<i8", "<i4", "<u4", "<u4")))
                if len(counts) and counts[0] < 0:
                    yield from spread(docs, -counts)
                else:
                    by.setdefault(part, []).append((docs, counts, keys, marks))
        while by:
            docs, counts, keys, marks = (np.concatenate(c) for c in zip(*by.popitem()[1]))
            every = np.sort(np.concatenate([keys, marks]))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            if len(keys) and len(twice):
                at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
                sums = np.add.reduceat((twice[at] == keys).astype(np.int64), np.cumsum(counts) - counts)
                some = np.flatnonzero(sums)
                if len(some):
                    yield from spread(docs[some], sums[some])
        release()

    def total(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, counts = [], []
        for b in source:
            for d, c in zip(b.column("docs").to_pylist(), b.column("counts").to_pylist()):
                docs.append(np.frombuffer(d, dtype="<i8"))
                counts.append(np.frombuffer(c, dtype="<i4"))
        if docs:
            ids, at = np.unique(np.concatenate(docs), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], names=["doc_id", "shared"])
            del docs, counts, ids, at, sums
        release()

    sent = rows.mapInArrow(send, "part int, docs binary, counts binary, keys binary, marks binary").repartition(reducers, "part")
    met = sent.mapInArrow(meet, "part int, docs binary, counts binary").repartition(reducers, "part")
    return met.mapInArrow(total, "doc_id long, shared long")


def shingle_table(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, h1, shingles): the sets themselves."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source, "text", rows=4096, size=1 << 20):
            x, off = shingle_sets(b.column("text"), n)
            found = pa.LargeListArray.from_arrays(pa.array(off.astype(np.int64)), pa.array(x.view(np.int64)))
            h1 = set_sums(mix64(x ^ _U(_SEEDS[0])), off).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(h1), found.cast(pa.list_(pa.int64()))], names=["doc_id", "h1", "shingles"])

    return rows.mapInArrow(run, "doc_id long, h1 long, shingles array<long>")


def coarse_edges(sets: DataFrame, similarity: int) -> DataFrame:
    """Edges (a, b) of documents that share one of their rarest n-grams, from (doc_id, h1, shingles).

    The order is by how many of these documents have an n-gram, then by its hash; n-grams of one document come first
    and meet nothing. Documents join the smallest one of each n-gram, so a hot n-gram gives one edge per document.
    """
    each = sets.select("doc_id", "h1", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = cut(each.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = each.join(often, "key").groupBy("doc_id", "h1", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("s"))
    # n - ceil(n * similarity / 100) + 1 first n-grams, of which n - size(s) have no partner
    first = F.size("s") + 1 - F.ceil(F.col("n") * similarity / 100)
    firsts = shared.withColumn("first", first.cast("int")).filter("first > 0")
    firsts = cut(firsts.select("doc_id", F.explode(F.slice("s", F.lit(1), F.col("first"))).alias("s")).select("doc_id", "s.key"))
    heads = cut(firsts.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("df")).filter("df > 1").select("key", "head"))
    return firsts.join(heads, "key").filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()


class Links:
    """Union-find over the documents of one unit."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


class Node:
    """A tree node: OR and AND of its sets' bitmaps, the range of their sizes, and children or members."""

    __slots__ = ("any", "all", "low", "high", "children", "members", "joined")

    def __init__(self, any_, all_, low, high, children, members):
        self.any, self.all, self.low, self.high = any_, all_, low, high
        self.children, self.members, self.joined = children, members, len(members) == 1


class SignatureTree:
    """Signature trees over sets, and the traversal of their pairs."""

    def __init__(self, sets: list[np.ndarray], similarity: int):
        self.sets, self.similarity = sets, similarity
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.bitmaps = np.zeros((len(sets), BITMAP_WORDS), dtype=np.uint64)
        for i, s in enumerate(sets):
            np.bitwise_or.at(self.bitmaps[i], (s & _U(BITMAP_WORDS - 1)).astype(np.int64), _U(1) << (s >> _U(58)))
        self.links = Links(len(sets))

    def tree(self, members: list[int]) -> Node:
        """Leaves of sets of like size and like smallest elements, joined level by level."""
        order = sorted(members, key=lambda i: (int(self.sizes[i]), self.sets[i][:4].tolist()))
        level = []
        for a in range(0, len(order), LEAF):
            m = order[a:a + LEAF]
            bits = self.bitmaps[m]
            level.append(Node(np.bitwise_or.reduce(bits), np.bitwise_and.reduce(bits), int(self.sizes[m].min()),
                              int(self.sizes[m].max()), [], m))
        while len(level) > 1:
            up = []
            for a in range(0, len(level), FAN):
                c = level[a:a + FAN]
                up.append(Node(np.bitwise_or.reduce([x.any for x in c]), np.bitwise_and.reduce([x.all for x in c]),
                               min(x.low for x in c), max(x.high for x in c), c, [i for x in c for i in x.members]))
            level = up
        return level[0]

    def possible(self, a: Node, b: Node) -> bool:
        """Whether any pair of sets below the nodes can overlap enough."""
        most = min(a.high, b.high, a.high - int(np.bitwise_count(a.all & ~b.any).sum()),
                   b.high - int(np.bitwise_count(b.all & ~a.any).sum()))
        return 100 * most >= self.similarity * max(a.low + b.low - most, a.low, b.low)

    def _joined(self, a: Node) -> bool:
        """Whether all members are linked already; stays true once it is."""
        if not a.joined:
            a.joined = len({self.links.find(i) for i in a.members}) == 1 if not a.children else (
                all(self._joined(c) for c in a.children) and len({self.links.find(c.members[0]) for c in a.children}) == 1)
        return a.joined

    def similar(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        if self.similarity * len(b) > 100 * len(a):
            return False
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        common = int((b[at] == a).sum())
        return 100 * common >= self.similarity * (len(a) + len(b) - common)

    def _leaves(self, a: Node, b: Node, edges: list[tuple[int, int]]) -> None:
        for i in a.members:
            js = [j for j in b.members if (a is not b or i < j)]
            if not js:
                continue
            lost = np.bitwise_count(self.bitmaps[i] & ~self.bitmaps[js]).sum(axis=1)
            gained = np.bitwise_count(self.bitmaps[js] & ~self.bitmaps[i]).sum(axis=1)
            most = np.minimum(self.sizes[i] - lost, self.sizes[js] - gained)
            for j, m in zip(js, most.tolist()):
                if 100 * m >= self.similarity * (int(self.sizes[i]) + int(self.sizes[j]) - m) and (
                        self.links.find(i) != self.links.find(j)) and self.similar(i, j):
                    self.links.join(i, j)
                    edges.append((i, j))

    def join(self, left: list[int], right: list[int] | None = None) -> list[tuple[int, int]]:
        """Links that connect what is similar within ``left``, or between ``left`` and ``right``: a spanning forest.
        A pair that is connected already is not verified, so these are not all links."""
        if not left or right is not None and not right:
            return []
        a = self.tree(left)
        stack, edges = [(a, a if right is None else self.tree(right))], []
        while stack:
            a, b = stack.pop()
            if a is not b and not self.possible(a, b):
                continue
            if self._joined(a) and self._joined(b) and self.links.find(a.members[0]) == self.links.find(b.members[0]):
                continue
            if not a.children and not b.children:
                self._leaves(a, b, edges)
            elif a is b:
                c = a.children
                stack += [(c[i], c[j]) for i in range(len(c)) for j in range(i + 1, len(c))] + [(x, x) for x in c]
            elif not b.children or a.children and a.high >= b.high:
                stack += [(x, b) for x in a.children]
            else:
                stack += [(a, x) for x in b.children]
        return edges


def link_edges(sets: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Edges (a, b) between class representatives whose components are those of all links.

    ``sets``: (doc_id, shingles); ``classes``: (rep, coarse, n, band). Small coarse groups share tasks by a hash; a group of over BLOCK shingles is
    cut by size band and hash into blocks of about half of that, and its pairs of blocks within a band and between
    neighbouring bands, which hold all possible links, are tasks of their own.
    """
    spark = sets.sparkSession
    size = classes.groupBy("coarse").agg(F.count("*").alias("members"), F.sum("n").alias("total")).filter("members > 1")
    work = cut(classes.join(size, "coarse"))
    total = work.filter(F.col("total") <= BLOCK).agg(F.sum("n")).first()[0] or 0
    small = work.filter(F.col("total") <= BLOCK).select(
        F.col("rep").alias("doc_id"), F.concat(F.lit("g"), F.pmod(F.xxhash64("coarse"), F.lit(math.ceil(total / BLOCK) + parts(spark)))).alias("unit"),
        "coarse", F.lit(0).alias("side"))
    large = work.filter(F.col("total") > BLOCK)
    blocks = cut(large.groupBy("coarse", "band").agg(F.ceil(F.sum("n") / (BLOCK / 2)).cast("int").alias("q")))
    near = large.join(blocks, ["coarse", "band"])
    for step, name in ((-1, "q_before"), (1, "q_after")):
        near = near.join(blocks.select("coarse", (F.col("band") - step).alias("band"), F.col("q").alias(name)), ["coarse", "band"], "left")
    near = near.withColumn("h", F.pmod(F.xxhash64("rep"), F.col("q")).cast("int"))
    pairs = F.expr("""concat(
        transform(sequence(0, q - 1), x -> named_struct('unit', concat_ws('.', coarse, band, least(h, x), band, greatest(h, x)), 'side', if(x < h, 1, 0))),
        if(q_after is null, array(), transform(sequence(0, q_after - 1), x -> named_struct('unit', concat_ws('.', coarse, band, h, band + 1, x), 'side', 0))),
        if(q_before is null, array(), transform(sequence(0, q_before - 1), x -> named_struct('unit', concat_ws('.', coarse, band - 1, x, band, h), 'side', 1))))""")
    large = near.select(F.col("rep").alias("doc_id"), "coarse", F.explode(pairs).alias("p")).select(
        "doc_id", "p.unit", "coarse", "p.side")
    wanted = cut(small.unionByName(large))
    units = sets.join(hinted(wanted), "doc_id").select("unit", "coarse", "side", "doc_id", "shingles")

    def solve(key: tuple, t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("side").to_numpy(), t.column("coarse").to_numpy()))
        t = t.take(pa.array(order)).combine_chunks()
        coarse, side, ids = (t.column(c).to_numpy() for c in ("coarse", "side", "doc_id"))
        lists = t.column("shingles").chunk(0)
        values, off = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        a, b = [], []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(coarse)) + 1, [len(coarse)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            tree = SignatureTree([values[off[i]:off[i + 1]] for i in range(lo, hi)], similarity)
            sides = side[lo:hi]
            left = np.flatnonzero(sides == 0).tolist()
            right = np.flatnonzero(sides == 1).tolist()
            for i, j in tree.join(left, right or None) if left else []:
                a.append(ids[lo + i])
                b.append(ids[lo + j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return units.groupBy("unit").applyInArrow(solve, "a long, b long")


def similar_groups(docs: DataFrame, n: int = WORDS, similarity: int = SIMILARITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link from ``similarity`` per cent Jaccard on.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer words than ``n`` are one n-gram together; without
    words or text a document has no n-gram and links with nothing. The component is the smallest id reachable by
    links. Rows that share an id are one document; a row without an id has no component. Other columns are not read.
    Exact copies become one class before any pair is looked at.
    """
    rows = _documents(docs, id_col, text_col)
    sets = cut(set_table(rows, n, similarity))
    classes = cut(sets.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n", "band").agg(F.min("doc_id").alias("rep")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    shared = shared_counts(rows, n, math.ceil(total / PER_REDUCER) + parts(docs.sparkSession))
    # a link needs 100 * common >= similarity * n, so fewer shared n-grams leave a document without any
    open_ = cut(classes.join(shared.withColumnRenamed("doc_id", "rep"), "rep").filter(100 * F.col("shared") >= similarity * F.col("n")).drop("shared"))
    some = cut(shingle_table(rows.join(hinted(open_.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi"), n))
    coarse = components(coarse_edges(some, similarity))
    grouped = open_.join(coarse.select(F.col("node").alias("rep"), F.col("component").alias("coarse")), "rep")
    links = components(link_edges(some.select("doc_id", "shingles"), grouped.select("rep", "coarse", "n", "band"), similarity))
    named = cut(classes.join(links.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", "n", F.coalesce("component", "rep").alias("component")))
    out = sets.join(named, ["h1", "h2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those whose document another one stands for.

    Of a group of links the smallest id stays; rows repeating an id are one document, of which one row stays. Rows
    without an id stay.
    """
    groups = cut(similar_groups(docs, n, similarity))
    gone = cut(groups.filter("component_id <> doc_id").select("doc_id").distinct())
    twice = cut(groups.filter("doc_id is not null and component_id = doc_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    kept = docs.join(hinted(gone), "doc_id", "left_anti")
    if not twice.isEmpty():
        again = kept.join(hinted(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(hinted(twice), "doc_id", "left_anti").unionByName(again)
    return kept.select(docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), n=3, similarity=90)
