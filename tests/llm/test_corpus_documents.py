"""Token files, packing, mixing, language, toxicity and the pipeline on odd documents."""

import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from beaconry.llm import language, mixing, packing, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int"
TEXTS = ["Hello wide WORLD", "", None, "don't <|endoftext|> stop\x1cnow é́  wide", "a " * 9000, "日本語のテキスト", "same", "same",
         "x" * 5000, "Ünïcode space 12345"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], ["b", "a", None][i % 3], 1, 2, 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "no id", "en", "a", 1, 2, 3), (4, TEXTS[4], "en", "b", 1, 2, 3)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


def test_token_files(spark, docs, ids, tmp_path):
    token_files.write_token_files(docs, str(tmp_path / "t"), shards=3)
    files = token_files.read_token_files(spark, str(tmp_path / "t"))
    got = token_files.digests(files).orderBy("start").collect()
    want = {i: ids(t) + [2] for i, t in [*enumerate(TEXTS), (None, "no id")]}
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[r.doc_id]), crc(want[r.doc_id]))
        start += r.n_tokens
    assert files.filter("doc_id = 3").first()["tokens"] == want[3]


def test_token_files_of_nothing(spark, empty, tmp_path):
    token_files.write_token_files(empty, str(tmp_path / "t"))
    assert token_files.digests(token_files.read_token_files(spark, str(tmp_path / "t"))).collect() == []


def test_packing(docs, empty, ids):
    got = packing.pack(docs, ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        whole = ids("no id" if r.doc_id is None else TEXTS[r.doc_id]) + [1]
        part = whole[r.piece * 4096:(r.piece + 1) * 4096]
        assert (r.start, r.length, r.ids_crc32, r.tokens) == (r.piece * 4096, len(part), crc(part), part)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:n]) for n in range(len(rows))]
        assert sum(r.length for r in rows) <= 4096
    assert len(got) == sum(-(-(len(ids(t)) + 1) // 4096) for t in [*TEXTS, "no id", TEXTS[4]])
    assert packing.pack(empty).collect() == []
    s = packing.sequences(packing.pack(docs.filter("doc_id is not null"), ids=True)).collect()
    assert sum(len(r.tokens) for r in s) == sum(r.length for r in got if r.doc_id is not None)


def bins(lengths, capacity):
    """Fewest bins by exhaustive search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1:]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_dominance_never_loses_a_sequence():
    rng = np.random.default_rng(2)
    for _ in range(60):
        capacity = int(rng.integers(6, 20))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 9))).tolist()
        counts = np.bincount(lengths, minlength=capacity + 1)
        rest = counts.copy()
        fixed = sum(n for _, n in packing.dominance(rest, capacity))
        left = np.repeat(np.arange(capacity + 1), rest).tolist()
        assert fixed + bins(left, capacity) == bins(lengths, capacity)
        n, places = packing.plan(counts, capacity)
        assert n >= bins(lengths, capacity) and sum(len(p) > 0 for p in places.values()) == len(set(lengths))


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == docs.count()
    total = sum(r.size for r in got)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert mine[0].source_size == sum(r.size for r in mine) and mine[0].target <= 3 * mine[0].source_size + 1e-6
        assert all(r.taken <= 3 * r.size for r in mine)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    assert mixing.mix(empty).collect() == []
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(empty).count() == 0
    clash = docs.withColumns({"mix_copies": F.lit(1), "MIX_DOC_ID": F.lit(2), "mix_nth": F.lit(3)})
    assert mixing.mixed(clash).columns == clash.columns and mixing.mixed(clash).count() == mixing.mixed(docs).count()


def test_fitting_finds_the_best_sum():
    rng = np.random.default_rng(8)
    for _ in range(80):
        lengths = np.unique(rng.integers(1, 30, 5))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 5))
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert int((lengths * take).sum()) <= budget
        reach = {0}
        for x, n in zip(lengths.tolist(), counts.tolist()):
            reach = {a + x * k for a in reach for k in range(n + 1)}
        assert max(a for a in reach if a <= budget) - int((lengths * take).sum()) <= int(lengths.max())


def test_language(spark, empty):
    words = {"aa": ["the", "house", "water", "light"], "bb": ["der", "haus", "wasser", "licht"]}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[y], 12)), y, "s", 1, 2, 3) for i in range(200) for y in [["aa", "bb"][i % 2]]]
    rows += [(900, None, "aa", None, 1, 2, 3), (901, "12 34 !!", "bb", None, 1, 2, 3), (902, "the water " * 20000, None, None, 1, 2, 3),
             (903, "wasser" * 3000, None, None, 1, 2, 3), (None, "haus", "bb", None, 1, 2, 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language.identify(docs, language.fit_languages(docs)).collect()}
    assert all(got[i].lang_pred == ["aa", "bb"][i % 2] for i in range(200))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "aa" and got[903].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    assert language.identify(empty, language.fit_languages(empty)).collect() == []
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(nothing, language.fit_languages(nothing)).collect()} == {"und"}


def test_short_documents_of_many_languages_stay(spark):
    rows = [(10 * i + k, f"gut {w} {w}", y, "s", 1, 2, 3) for i in range(20) for k, (y, w) in enumerate([("aa", "haus"), ("bb", "wald"), ("cc", "mond")])]
    docs = spark.createDataFrame(rows + [(900, "gut", "aa", "s", 1, 2, 3), (901, "12", "aa", "s", 1, 2, 3)], SCHEMA)
    assert {r.doc_id: r.score for r in language.identify(docs, language.fit_languages(docs)).collect()}[900] < 0.5
    assert {r.doc_id for r in language.drop_unidentified(docs).collect()} == {r[0] for r in rows} | {900}


def test_pieces_of_any_length_and_with_marks():
    pieces = language.vocabulary_pieces()
    assert max(map(len, pieces)) > 8 and any(unicodedata.category(c)[0] == "M" for p in pieces for c in p)
    assert all(unicodedata.category(c)[0] in "LM" for p in pieces for c in p.removeprefix(language.START))


def segmentations(word, pieces):
    if not word:
        return 1.0
    return sum(p * segmentations(word[len(x):], pieces) for x, p in pieces.items() if word.startswith(x))


def test_forward_sums_all_segmentations():
    names = [language.START, language.START + "ab", "a", "b", "ab", "ba", "aba"]
    p = np.append(np.linspace(0.05, 0.3, len(names)), 1e-7)
    by = language.Pieces(names)
    for word in ("abab", "aba", "b", "ababababababababab"):
        (_, codes), = language.by_length([word])
        want = segmentations(language.START + word, dict(zip(names, p)))
        assert language.forward(by, codes, p[:, None])[0, 0] == pytest.approx(np.log(want))


def brute_segments(scores):
    """All maximal segments by their definition: the best one, then the same left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i = -best[2]
    j = i - best[1]
    return brute_segments(scores[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_maximal_segments():
    rng = np.random.default_rng(6)
    for _ in range(200):
        raw = [float(x) if x > 0 else -1.3 for x in rng.normal(size=14).round(6)]
        hits = [(i, x) for i, x in enumerate(raw) if x > 0]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(hits, -1.3)] == brute_segments(raw)


def test_toxicity(spark, empty):
    rng = np.random.default_rng(1)
    calm = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(calm, 30))
        bad = i % 6 == 0
        if bad:
            w[5:5] = [["vile", "grotness", "grotting"][i % 3], "vile"]
        rows.append((i, " ".join(w), "en", "s", 1, 2, 3))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, None, None, 1, 2, 3), (901, "", None, None, 1, 2, 3), (902, "grotful vile " * 5000, None, None, 1, 2, 3), (902, "grotful vile", None, None, 1, 2, 3)]
    labels += [(902, 1, None), (None, 1, 1), (7777, 0, 1)]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, known)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i].predicted == int(i % 6 == 0) for i in range(600))
    assert got[900].predicted == got[901].predicted == 0 and got[902].predicted == 1
    passage = got[0].passages[0]
    assert "vile" in rows[0][1][passage.start:passage.end]
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == 502
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, known)).collect() == []
    none = known.filter("toxic = 5")
    assert {r.predicted for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect()} == {0}
