"""Merkle manifest, content sort and numbering against plain Python, with odd rows."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from beaconry.llm import content_sort, merkle
from beaconry.llm.positions import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, parent string, hash string, norm int, run int"
ODD = (None, 7, "clash", 3, 4)


def documents(n, sources):
    return [(i * 3, f"line {i % 5}\nsecond\n{'x' * (i % 4)}", None if i % 7 == 0 else "en", sources[i % len(sources)], i, *ODD) for i in range(n)]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    values = (r[0], r[3], r[2], r[4], text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i:i + 3])) for i in range(0, len(last), 3)])
    return levels


def climb(levels, i, now):
    proof = ""
    for nodes in levels[:-1]:
        lo = i // 3 * 3
        run = nodes[lo:lo + 3]
        proof += "".join(run[:i - lo] + run[i - lo + 1:])
        run[i - lo] = now
        now, i = h("".join(run)), i // 3
    return proof, now


def brute(rows):
    now = [r[1] if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else (r[1] and r[1].replace("\n", "")) for r in rows]
    by = {}
    for r, t in zip(rows, now):
        by.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), leaf(r, t), r[0]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s])]) for s in order}
    upper = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, own, present, doc_id) in enumerate(sorted(by[s])):
            a, fold = climb(trees[s], i, present)
            b, fold = climb(upper, k, fold)
            out.append((doc_id, own, trees[s][-1][0], upper[-1][0], h(a + b), fold, fold == upper[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    documents(1, ["a"]), documents(3, ["a"]), documents(28, ["a"]), documents(120, ["b", None, "a", "Ü", "", "b", "b"]),
    [(i, None if i % 2 else "t\nt", None, f"s{i:02}", None, *ODD) for i in range(31)],
    [(None, "a\n", "en", "a", 1, *ODD), (None, "a\n", "en", "a", 1, *ODD), (5, "", "en", "a", 1, *ODD), (5, "\n" * 9, "en", "a", 1, *ODD),
     (9, "w " * 200_000, None, "z", 1, *ODD)],
])
def test_manifest(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    setting = spark.conf.get(merkle.ROWS_SETTING, None)
    got = merkle.manifest(merkle.tampered(docs)).collect()
    assert spark.conf.get(merkle.ROWS_SETTING, None) == setting
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_numbering(spark):
    rows = numbered(spark.range(1000).repartition(7), [F.col("id").desc()], "at").collect()
    assert sorted((r["at"], r["id"]) for r in rows) == [(i, 999 - i) for i in range(1000)]


COPIES = [
    (1, " a b c"), (2, "abc"), (3, "a\tb\nc  "), (4, None), (5, ""), (6, " \n"), (7, "x"), (8, "x"), (None, "x"), (9, "é 日本"), (10, "é日本"),
    (11, "abcd"), (12, "y" * 300_000), (13, "y " * 300_000), (14, "p" * 40 + "1"), (15, "p" * 40 + "2"), (16, "a b"), (17, "ab"),
    *[(100 + i, "hot text" + " " * (i % 3)) for i in range(600)], *[(7, "x")],
]


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_duplicates(spark, parts):
    docs = spark.createDataFrame([(i, t, None, None, 1, *ODD) for i, t in COPIES], SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = content_sort.duplicates(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for i, t in COPIES:
        groups.setdefault((t or "").translate({ord(c): None for c in content_sort.SPACE}), []).append((-len(t or ""), i is None, i or 0, i))
    want = []
    for norm, rows in groups.items():
        rows.sort()
        for n, r in enumerate(rows):
            want.append((r[3], rows[0][3], len(rows), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_duplicates_of_nothing(spark):
    assert content_sort.duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_agrees(spark):
    """The registered SQL on rows with nulls, repeated ids and ties."""
    rows = [*[r for r in documents(90, ["b", None, "a", "b"])], (None, None, None, None, None, *ODD)]
    docs = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    for sql, got in ((merkle.ORACLE, merkle.manifest(merkle.tampered(docs))), (content_sort.ORACLE, content_sort.duplicates(docs))):
        want = con.sql(sql)
        names = want.columns
        assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
