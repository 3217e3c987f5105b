"""Whitening, language by compression and fill-in-middle against brute force and round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclake.llm import boundaries, compressed_language, infill, whitening
from doclake.llm.common import ROW

# ------------------------------------------------------------------------------ 11, whitening

VECTORS = "vec_id long, embedding array<float>, n string, key string, `a.b` string, _llm_row string"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    mixed = rng.normal(0, 0.4, (60, 6)) @ rng.normal(0, 1, (6, 6))
    rows = [(i, [float(c) for c in np.float32(v)], "clash", "clash", "dot", "row") for i, v in enumerate(mixed)]
    rows += [(100 + i, rows[3][1], None, None, None, None) for i in range(40)]  # a third of all rows are one vector
    rows += [(200, [0.001, -0.0, 0.0, -0.001, 0.25, 1.0]) + (None,) * 4, (201, [0.002, 0.0, -0.0, -0.002, 0.251, 1.001]) + (None,) * 4]  # equal on the grid
    rows += [rows[5], rows[5], (None, rows[6][1], None, None, None, None)]
    broken = [None, [], [0.1] * 5 + [None], [0.1] * 5 + [float("nan")], [0.1] * 5 + [float("-inf")], [0.1] * 7]
    return rows, [(300 + i, b, None, None, None, None) for i, b in enumerate(broken)]


def grid(rows):
    return np.array([[int(np.floor(256 * float(np.float32(c)))) for c in r[1]] for r in rows], np.int64)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_brute_force(spark, vectors, weights):
    good, broken = vectors
    got = whitening.whiten(spark.createDataFrame(good + broken, VECTORS).repartition(3), weights=weights).collect()
    x = grid(good)
    fit = np.unique(x, axis=0) if weights == "one" else x
    n, sums = len(fit), fit.sum(0)
    cov = np.cov(fit.T, bias=True)
    value, vector = np.linalg.eigh(cov)
    assert Counter(r[ROW]["vec_id"] for r in got) == Counter(r[0] for r in good)
    assert {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in got}) == 1
    assert np.allclose(got[0]["explained"], value[::-1][:4] / np.trace(cov))
    by_id = {r[ROW]["vec_id"]: r for r in got}
    for row, v in zip(good, x, strict=True):
        r = by_id[row[0]]
        assert int(r["deviation"]) == int(((n * v - sums) ** 2).sum())
        assert r[ROW]["n"] == row[2] and r[ROW]["a.b"] == row[4] and r[ROW]["_llm_row"] == row[5]
    found = np.array([by_id[r[0]]["whitened"] for r in good])
    for k in range(4):
        want = (x - sums / n) @ vector[:, -1 - k] / np.sqrt(value[-1 - k])
        assert min(np.abs(found[:, k] - want).max(), np.abs(found[:, k] + want).max()) < 1e-9


def test_whitening_gives_one_row_a_component(spark, vectors):
    good, broken = vectors
    df = spark.createDataFrame(good + broken, VECTORS)
    rows = whitening.by_component(whitening.whiten(df, components=9, columns=["vec_id"])).collect()
    assert Counter(r["component"] for r in rows) == {k: len(good) for k in range(1, 7)}
    assert abs(sum({r["component"]: r["explained"] for r in rows}.values()) - 1) < 1e-9
    assert {r["deviation"] is None for r in rows} == {False}


def test_whitening_without_variance_or_rows(spark, vectors):
    _, broken = vectors
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame(broken[:-1], VECTORS)).count() == 0
    same = spark.createDataFrame([(1, [0.5, 0.25], *[None] * 4)] * 3, VECTORS)
    rows = whitening.whiten(same).collect()
    assert [(r["n"], int(r["deviation"]), list(r["whitened"])) for r in rows] == [(1, 0, [])] * 3
    assert whitening.by_component(whitening.whiten(same)).count() == 0
    line = spark.createDataFrame([(i, [i / 8, i / 4, 0.0], *[None] * 4) for i in range(9)], VECTORS)
    assert {len(r["whitened"]) for r in whitening.whiten(line).collect()} == {1}  # one direction has all the variance


def test_whitening_is_exact_for_large_entries(spark):
    rows = [(i, [float(v), 2.0**40 * i, -3e38]) for i, v in enumerate([1e30, -1e30, 7.5, 2.0**33])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r[ROW]["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    clip = lambda v: max(-(1 << 63), min((1 << 63) - 1, int(np.floor(256 * v))))
    x = [[clip(c) for c in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for i, v in enumerate(x):
        want = sum((4 * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert (got[i] is None) if want >= 10**38 else int(got[i]) == want


def test_frequent_vectors_are_joined_by_broadcast(spark, vectors):
    df = whitening.whiten(spark.createDataFrame(vectors[0], VECTORS), columns=["vec_id"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2  # frequent x, and all rows without them


# ------------------------------------------------------------------------------ 12, language

LANGUAGES = {"aa": ["ka", "ti", "mo", "rul"], "bb": ["schen", "ü", "bär", "gra"], "cc": ["из", "ко", "ша", "ё"]}
TEXTS = "doc_id long, text string, lang string, source string, score string, p string"


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + ".\n"


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(8)
    rows = [(i, sentence(rng, lang, rng.randint(5, 80)), lang, "s", "clash", "clash") for i, lang in enumerate(rng.choices(list(LANGUAGES), k=300))]
    rows[7] = (7, sentence(rng, "bb", 60_000), "bb", "s", None, None)
    return rows + [rows[9]] * 150  # a third of all rows are copies of one


EDGES = [(1000, None, "aa"), (1001, "", "aa"), (1002, " \t\n", "bb"), (1003, "12345 -- !!", "cc"), (1004, "́", None), (None, "Katimo tirulka momoti rulkati karul titika morulti.", None)]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_language_of_held_out_texts(spark, spoken):
    df = spark.createDataFrame(spoken + [(*e, None, None, None) for e in EDGES], TEXTS).repartition(3)
    rows = compressed_language.classify(df).collect()
    assert len(rows) == len(spoken) + len(EDGES)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) for r in rows)
    out = [(r[2], by_id[r[0]]["lang_pred"]) for r in spoken if held(r[0])]
    assert sum(a == b for a, b in out) >= 0.98 * len(out) and by_id[7]["lang_pred"] == "bb"
    for i, *_ in EDGES[:5]:
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["accepted"]) == ("und", 0.0, False)
    assert by_id[None]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in rows)


def test_language_learns_from_its_rows_only(spark, spoken):
    """Other languages of held-out rows, and other sources and ids, change nothing."""
    df = spark.createDataFrame(spoken, TEXTS)
    wrong = spark.createDataFrame([(r[0], r[1], "zz", "other", None, None) if held(r[0]) else r for r in spoken], TEXTS)
    a, b = ({(r["doc_id"], r["lang_pred"], r["score"]) for r in compressed_language.classify(d).collect()} for d in (df, wrong))
    assert a == b


def test_language_dictionaries_are_bounded_and_whole(spark, spoken):
    df = spark.createDataFrame(spoken, TEXTS)
    model = compressed_language.learn(df, dictionary_bytes=2000)
    again = compressed_language.learn(df.repartition(5), dictionary_bytes=2000)
    assert model.dictionaries == again.dictionaries
    assert all(1000 < len(d) <= 2000 for _, d in model.dictionaries)
    counts = Counter(r[2] for r in spoken)
    assert [name for name, _ in model.dictionaries] == sorted(counts, key=lambda c: (-counts[c], c))
    long_only = spark.createDataFrame([(1, "kati " * 9000, "aa", None, None, None)], TEXTS)
    assert len(compressed_language.learn(long_only, dictionary_bytes=500).dictionaries[0][1]) == 500


def test_language_sums_blocks_of_the_whole_text(spoken):
    model = compressed_language.Model([("aa", b"kati mo rul"), ("bb", b"schen gra")])
    text = "kati mo rul 12 " * 2000
    data = compressed_language.plain(text)
    blocks = [data[i : i + compressed_language.BLOCK].decode() for i in range(0, len(data), compressed_language.BLOCK)]
    # a block is plain text already, so it is encoded alone as it is inside the whole
    assert model.sizes(text) == [sum(s) for s in zip(*map(model.sizes, blocks), strict=True)]
    assert model.predict("kati rul")[0] == "aa" and model.predict(None) == ("und", 0.0, 0.0)
    tie = compressed_language.Model([("bb", b"same"), ("aa", b"same")])
    assert tie.predict("word") == ("bb", 0.5, 0.0)


def test_language_of_nothing(spark, spoken):
    empty = spark.createDataFrame([], TEXTS)
    assert compressed_language.classify(empty).count() == 0
    nothing = compressed_language.learn(spark.createDataFrame([(1, "x", None, None, None, None), (2, None, "aa", None, None, None)], TEXTS))
    rows = compressed_language.predict(spark.createDataFrame(spoken[:3], TEXTS), nothing).collect()
    assert [(r["lang_pred"], r["score"], r["accepted"]) for r in rows] == [("und", 0.0, False)] * 3
    assert rows[0][ROW]["score"] == "clash" and rows[0][ROW]["p"] == "clash"


# ------------------------------------------------------------------------------ 13, fill-in-middle

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, n string, form string, output string, _llm_row string"


@pytest.fixture(scope="module")
def written_texts():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "über", "🙂", "\t", "x<", "S>", " ", "end\n"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += ["", None, " ", " \n\t", "one", " one", "one ", "has <S> mark", "<P>", "<M", "word " * 40_000, "é" * 70_000 + " " + "b" * 65_535 + " c",
              "x" * 65_536, "x" * 65_535 + " y", " " * 65_537, "a b" * 30_000 + "\x0b\x0c\r"]
    return texts


def expected(doc_id, text):
    text = text or ""
    ends = [m.end() for m in TOKEN.finditer(text)]
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(ends) + 1), h[1] % (len(ends) + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(ends), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    return len(ends), form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle_equals_brute_force(spark, written_texts):
    rows = [(i, t, "clash", "clash", "clash", "clash") for i, t in enumerate(written_texts)]
    rows += [(1000 + i, t, None, None, None, None) for i, t in enumerate(written_texts)]
    rows += [rows[3], rows[3], (None, "a b c", None, None, None, None), (None, None, None, None, None, None)]
    done = infill.transform(spark.createDataFrame(rows, DOCS).repartition(3))
    got = Counter((r[ROW]["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in done.collect())
    assert got == Counter((r[0], *expected(r[0], r[1])) for r in rows)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in infill.digests(done).collect()) == Counter(
        (r[0], sha(expected(r[0], r[1])[-1]), sha(r[1] or "")) for r in rows)


def test_fill_in_middle_by_characters(spark, written_texts):
    df = spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(written_texts)], DOCS)
    rows = infill.transform(df, unit="char", percent=100, spm_percent=0).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert all(r["n"] == len(written_texts[r[ROW]["doc_id"]] or "") and r["back"] == (written_texts[r[ROW]["doc_id"]] or "") for r in rows)
    assert {r["form"] for r in rows} == {"plain", "psm"}
    assert infill.transform(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("kind, places", [
    (boundaries.Array, [0, 5, 6, 900, 65_535]),
    (boundaries.Array, list(range(1, 8192, 2))),
    (boundaries.Bitmap, list(range(1, 8195, 2))),
    (boundaries.Bitmap, [i for i in range(65_536) if i % 3]),
    (boundaries.Runs, list(range(65_536))),
    (boundaries.Runs, [*range(10, 3000), 5000, *range(60_000, 65_536)]),
])
def test_containers_select(kind, places):
    made = boundaries.container(np.array(places))
    assert type(made) is kind and made.size == len(places)
    assert [made.select(k) for k in range(len(places))] == places


def test_boundary_set_selects_over_containers():
    rng = np.random.default_rng(4)
    parts = {0: np.arange(65_536), 2: np.sort(rng.choice(65_536, 300, replace=False)), 3: np.zeros(0, int), 9: np.sort(rng.choice(65_536, 30_000, replace=False))}
    made = boundaries.BoundarySet(parts.items())
    every = np.concatenate([(k << 16) + v for k, v in parts.items()])
    assert len(made) == len(every) and [type(c).__name__ for c in made.containers] == ["Runs", "Array", "Bitmap"]
    picks = [0, 65_535, 65_536, 65_835, 65_836, len(every) - 1, *rng.integers(0, len(every), 500).tolist()]
    assert [made.select(k) for k in picks] == every[picks].tolist()
    for k in (-1, len(every)):
        with pytest.raises(IndexError):
            made.select(k)
