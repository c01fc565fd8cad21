"""Merkle manifest of documents: a tree of leaf hashes per source, a tree of subroots above, and proofs by a recursive query.

Nodes are consecutive and every three of them become one above, the last run may be shorter. The tree is built in strides:
a block of ``3 ** STRIDE`` neighbouring nodes meets in one row, which computes the levels in between and yields one stored
row per node of the block: its way up to the block's top (the hashes before and after it on each level) and the top's key
as its parent. The recursive query starts at every leaf and joins parents until there is none; each step folds the leaf's
present hash through the row's way and adds that row's siblings to the leaf's proof.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import cut, prepare, table
from beaconry.llm.graph import hinted
from beaconry.llm.positions import numbered

ARITY, STRIDE = 3, 3
#: A node's key is position * KEY + level; levels of the tree above the sources start at TOP.
KEY, TOP = 64, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_SETTING = "spark.sql.cteRecursionRowLimit"


def field(value: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hash_of(nodes: Column) -> Column:
    """The hash of concatenated binary hashes, which count as lower-case hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(nodes)), 256))


def key(level: int, pos: Column) -> Column:
    return pos * KEY + level


def joined(nodes: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.slice(nodes, start, n), lambda h: F.hex(h)), "")


def above(nodes: Column) -> Column:
    """The next level of a list of neighbouring nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda r: F.unhex(F.sha2(F.lower(joined(nodes, r * ARITY + 1, F.lit(ARITY))), 256)))


def way(levels: list[Column], wide: list[Column], i: Column) -> Column:
    """(before, after) hashes of node ``i`` and its forebears in the block; ``wide`` tells which levels have several nodes."""
    steps = []
    for j, nodes in enumerate(levels):
        at = F.floor(i / ARITY ** j).cast("int")
        first = F.floor(at / ARITY).cast("int") * ARITY
        before, after = joined(nodes, first + 1, at - first), joined(nodes, at + 2, first + ARITY - at - 1)
        steps.append(F.when(wide[j], F.struct(F.unhex(before).alias("before"), F.unhex(after).alias("after"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def blocks(nodes: DataFrame, level: int, base: int, above_all: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows of the nodes of one level, from (pos, start, size, rank, hash, *extra).

    pos is that of the node's first leaf, start that of its tree, size the leaves of its tree. ``top`` is the block's top hash, on
    the block's first row only. ``above_all`` is the parent of the tree's last node.
    """
    span = ARITY ** (level + STRIDE)
    block = F.floor((F.col("pos") - F.col("start")) / span).cast("long")
    rows = nodes.groupBy("start", "size", "rank", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "hash", *extra))).alias("items"))
    wide = [F.col("size") > ARITY ** (level + j) for j in range(STRIDE + 1)]
    rows = rows.withColumn("h0", F.col("items.hash"))
    for j in range(STRIDE):
        rows = rows.withColumn(f"h{j + 1}", F.when(wide[j], above(F.col(f"h{j}"))).otherwise(F.col(f"h{j}")))
    levels = [F.col(f"h{j}") for j in range(STRIDE)]
    parent = F.when(wide[STRIDE], key(base + level + STRIDE, F.col("start") + F.col("block") * span)).otherwise(above_all)
    rows = rows.select("*", F.posexplode("items").alias("i", "item"))
    return rows.select(
        key(base + level, F.col("item.pos")).alias("node"), parent.alias("parent"), way(levels, wide, F.col("i")).alias("way"),
        *[F.col(f"item.{c}").alias(c) for c in ("pos", "hash", *extra)], "start", "size", "rank",
        F.when(F.col("i") == 0, F.element_at(f"h{STRIDE}", 1)).alias("top"))


def raised(rows: DataFrame, level: int, finished: bool) -> DataFrame:
    """The tops of stored rows: of finished trees, or of those that go on."""
    done = F.col("size") <= ARITY ** (level + STRIDE)
    return rows.filter(F.col("top").isNotNull() & (done if finished else ~done)).select(
        "pos", "start", "size", "rank", F.col("top").alias("hash"))


def build(leaves: DataFrame, biggest: int, base: int, above_all: Column, extra: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Stored rows by stride, and the last node of every tree."""
    level, stored, last = 0, [], []
    nodes = leaves
    while True:
        rows = cut(blocks(nodes, level, base, above_all, extra))
        stored.append(rows)
        last.append(raised(rows, level, True))
        if ARITY ** (level + STRIDE) >= biggest:
            break
        nodes, extra = raised(rows, level, False), ()
        level += STRIDE
    ends = last[0]
    for more in last[1:]:
        ends = ends.unionAll(more)
    return stored, ends


FOLD = ("aggregate({way}, {start}, (h, s) -> unhex(sha2(lower(concat(hex(s.before), hex(h), hex(s.after))), 256)))")
SIBLINGS = "aggregate({way}, X'', (a, s) -> concat(a, s.before, s.after))"
CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT pos, doc_id, 0 AS step, parent, {FOLD.format(way='way', start='present')} AS folded,
         {SIBLINGS.format(way='way')} AS siblings, hash AS original
  FROM {{leaves}}
  UNION ALL
  SELECT c.pos, c.doc_id, c.step + 1, n.parent, {FOLD.format(way='n.way', start='c.folded')},
         {SIBLINGS.format(way='n.way')}, n.original
  FROM climb c JOIN {{nodes}} n ON c.parent = n.node
)
SELECT pos, doc_id,
       array_sort(collect_list(struct(step, siblings, original, CASE WHEN parent IS NULL THEN folded END AS folded))) AS steps
FROM climb GROUP BY pos, doc_id
"""


@contextmanager
def unlimited_rows(spark: SparkSession):
    """Recursive queries may yield any number of rows while this holds."""
    before = spark.conf.get(ROWS_SETTING, None)
    spark.conf.set(ROWS_SETTING, "-1")
    try:
        yield
    finally:
        spark.conf.unset(ROWS_SETTING) if before is None else spark.conf.set(ROWS_SETTING, before)


def manifest(docs: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per document.

    ``docs`` holds doc_id, source, lang, n_chars and text; other columns are not read, except ``present_text``: the text as it
    is now, where it may have been tampered with since the manifest. ``folded_root`` is what the present leaf leads to.
    Sources ascend bytewise, null first; within a source documents ascend by doc_id, null first. Rows sharing an id stay
    apart, in the order of their hashes; equal rows are leaves of their own. A lone leaf is its source's subroot, a lone
    subroot the root; a leaf without siblings has the hash of nothing as its proof. An empty table gives no rows.

    The widest row is a block of 27 hashes or a leaf's proof, whose length is the logarithm of the table's. A hot source
    spreads over tasks by blocks of positions. Only the per-task counts are broadcast, and sources up to a checked number.
    """
    spark = docs.sparkSession
    now = F.col("present_text") if "present_text" in docs.columns else F.col("text")
    source = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source")))
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("tree"), leaf_hash(*[F.col(c) for c in FIELDS]).alias("hash"),
        leaf_hash(*[F.col(c) for c in FIELDS[:-1]], now).alias("present"))
    order = [F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("present")]
    placed = numbered(hashed, order, "pos")
    spans = placed.groupBy("tree").agg(F.min("pos").alias("start"), F.count("*").alias("size"))
    trees = cut(numbered(spans, [F.col("tree")], "rank"))
    sources, biggest = trees.agg(F.count("*"), F.max("size")).first()
    if not sources:
        return spark.createDataFrame([], OUT)
    leaves = placed.join(hinted(trees), "tree").drop("tree")
    stored, subroots = build(leaves, biggest, 0, key(TOP, F.col("rank")), ("doc_id", "present"))
    heads = subroots.select(F.col("rank").alias("pos"), F.lit(0).cast("long").alias("start"), F.lit(sources).alias("size"),
                            F.lit(0).cast("long").alias("rank"), "hash")
    stored_above, ends = build(heads, sources, TOP, F.lit(None).cast("long"))
    root = ends.first()["hash"]
    nodes = None
    for n, rows in enumerate(stored[1:] + stored_above):
        # the lowest stored nodes of the upper tree are the subroots
        own = F.col("hash") if n == len(stored) - 1 else F.lit(None).cast("binary")
        rows = rows.select("node", "parent", "way", own.alias("original"))
        nodes = rows if nodes is None else nodes.unionAll(rows)
    first = stored[0].select("pos", "doc_id", "present", "hash", "parent", "way")
    climbed = spark.sql(CLIMB, leaves=first, nodes=nodes)
    text = lambda c: F.lower(F.hex(c))
    steps = F.col("steps")
    original = F.filter(steps["original"], lambda h: h.isNotNull())
    proof = F.array_join(F.transform(steps["siblings"], lambda s: F.hex(s)), "")
    with unlimited_rows(spark):
        out = cut(climbed.select(
            "doc_id", original[0].alias("leaf"), original[1].alias("subroot"),
            F.unhex(F.sha2(F.lower(proof), 256)).alias("proof"), F.element_at(steps, -1)["folded"].alias("folded")))
    return out.select(
        "doc_id", text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), F.lit(root.hex()).alias("root"),
        text(F.col("proof")).alias("proof_sha256"), text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.lit(root)).alias("verified"))


OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def tampered(docs: DataFrame) -> DataFrame:
    """With ``present_text``: the text without line feeds where 2 divides the id's CRC."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.withColumn("present_text", F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return manifest(tampered(table(spark, sf_dir, "documents")))


_CRC_BIT = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"""


def _sql_leaf(text: str) -> str:
    one = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR END"
    return "sha256(" + " || ".join(one.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE = f"""
WITH RECURSIVE now AS (
  SELECT *, CASE WHEN xor({_CRC_BIT}, 4294967295::UBIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS later
  FROM documents),
leaves AS (SELECT doc_id, source, {_sql_leaf('text')} AS leaf, {_sql_leaf('later')} AS present FROM now),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, present) - 1 AS i FROM leaves),
lv(src, level, h) AS (
  SELECT source, 0, list(leaf ORDER BY i) FROM d GROUP BY source
  UNION ALL
  SELECT src, level + 1, list_transform(range(0, len(h), 3), lambda x: sha256(array_to_string(h[x + 1:x + 3], ''))) FROM lv WHERE len(h) > 1),
subs AS (SELECT src, h[1] AS subroot, row_number() OVER (ORDER BY src NULLS FIRST) - 1 AS k FROM lv WHERE len(h) = 1),
top(level, h) AS (
  SELECT 0, list(subroot ORDER BY k) FROM subs
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(h), 3), lambda x: sha256(array_to_string(h[x + 1:x + 3], ''))) FROM top WHERE len(h) > 1),
low AS (SELECT src, level, x // 3 AS run, h[x + 1:x + 3] AS hs FROM (SELECT *, unnest(range(0, len(h), 3)) AS x FROM lv WHERE len(h) > 1)),
high AS (SELECT level, x // 3 AS run, h[x + 1:x + 3] AS hs FROM (SELECT *, unnest(range(0, len(h), 3)) AS x FROM top WHERE len(h) > 1)),
a(doc_id, src, leaf, i, level, fold, proof, done) AS (
  SELECT doc_id, source, leaf, i, 0, present, '', false FROM d
  UNION ALL
  SELECT doc_id, a.src, leaf, a.i // 3, a.level + 1,
    CASE WHEN hs IS NULL THEN fold ELSE
      sha256(array_to_string(hs[1:a.i % 3], '') || fold || array_to_string(hs[a.i % 3 + 2:3], '')) END,
    CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(hs[1:a.i % 3], '') || array_to_string(hs[a.i % 3 + 2:3], '') END,
    hs IS NULL
  FROM a LEFT JOIN low ON low.src IS NOT DISTINCT FROM a.src AND low.level = a.level AND low.run = a.i // 3 WHERE NOT done),
b(doc_id, leaf, subroot, i, level, fold, proof, done) AS (
  SELECT doc_id, leaf, subroot, k, 0, fold, proof, false FROM a JOIN subs ON subs.src IS NOT DISTINCT FROM a.src WHERE done
  UNION ALL
  SELECT doc_id, leaf, subroot, b.i // 3, b.level + 1,
    CASE WHEN hs IS NULL THEN fold ELSE
      sha256(array_to_string(hs[1:b.i % 3], '') || fold || array_to_string(hs[b.i % 3 + 2:3], '')) END,
    CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(hs[1:b.i % 3], '') || array_to_string(hs[b.i % 3 + 2:3], '') END,
    hs IS NULL
  FROM b LEFT JOIN high ON high.level = b.level AND high.run = b.i // 3 WHERE NOT done),
r AS (SELECT h[1] AS root FROM top WHERE len(h) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM b, r WHERE done
"""
