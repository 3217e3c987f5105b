"""Operators for training text against brute force, round trips and planted structure."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from doclake.llm import bagminhash, bilinear, decontaminate, host_rules, huffman, packing, passages, site_lines, slots, warc, words  # noqa: E402
from doclake.llm.common import ROW  # noqa: E402
from doclake.llm.tokens import Coder, coder  # noqa: E402

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, n_words string, host string, kept string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["er", "on", "th", "an", "in", "es", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(40)]
    texts += [texts[0], texts[1] + " end", "", None, " \n\t ", "one", "a b c d", prose(rng, 30_000), "x y z " * 50, "line\n" * 5 + texts[2],
              "don't <|endoftext|> É€ 🙂\x0b\x0cz"]
    out = [(i, t, None if i % 7 == 0 else f"s{i % 3}", "clash", "clash", None) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[4], "s1", None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(1)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text, end):
    return [*coder(VOCABULARY).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_coder_equals_tokenizer(rows):
    texts = [r[1] or "" for r in rows]
    fresh = Coder(VOCABULARY)
    ids, bounds = fresh.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids_of(t, 0)[:-1] for t in texts]
    assert fresh.encode([])[0].size == 0


def test_word_hashes_cut_buffers():
    text = (b"ab cd\n" * 300_000) + b"x" * (2 << 20) + b" tail"
    h, bounds = words.hashes([text, b"", b"ab"])
    assert np.diff(bounds).tolist() == [600_002, 0, 1]
    assert h[0] == h[2] == h[-1] and h[1] == h[3] and len({int(x) for x in h}) == 4


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.integers(0, 1000, 300), 2 ** np.arange(30)])
    lengths = huffman.code_lengths(counts, 12)
    used = lengths > 0
    assert lengths.max() <= 12 and (used == (counts > 0)).all() and np.exp2(-lengths[used].astype(float)).sum() <= 1
    small = np.array([1, 1, 2, 4, 8, 16])
    assert (huffman.code_lengths(small, 18) * small).sum() == 16 + 8 * 2 + 4 * 3 + 2 * 4 + 2 * 5
    ids = rng.choice(np.flatnonzero(counts), 70_001)
    block = huffman.encode_block(ids, huffman.canonical_codes(lengths), lengths)
    assert (huffman.decode_block(block, huffman.decode_table(lengths)) == ids).all()
    assert huffman.code_lengths(np.array([0, 5]))[1] == 1


def test_huffman_files(spark, docs, empty, rows):
    got = [tuple(r) for r in huffman.read_files(spark, huffman.encode_documents(docs, VOCABULARY, 1)).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    want = sorted((-1 if r[0] is None else r[0], len(i := ids_of(r[1], 1)), crc(i)) for r in rows)
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in got) == want
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert huffman.read_files(spark, huffman.encode_documents(empty, VOCABULARY, 1)).count() == 0


def test_decontamination(spark, docs, empty, rows):
    rng = random.Random(9)
    base = next(r[1] for r in rows if r[0] == 5).split()
    edited = base[10:50]
    edited[7], edited[20] = "changed", "CHANGED,"
    items = [(1, " ".join(base[10:40]).upper()), (2, " ".join(edited)), (3, prose(rng, 30)), (4, None), (5, ""), (None, "!?"), (1, " ".join(base[10:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, bench).collect()}
    want = set()
    for d, t, *_ in rows:
        run = decontaminate.plain(t or "").split()
        for i, item in items:
            pattern = decontaminate.plain(item or "").split()
            if pattern and (best := brute_distance(pattern, run)) <= int(0.2 * len(pattern)):
                want.add((d, i, best))
    assert got == want and (5, 1, 0) in want and (5, 2, 2) in want
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == len(rows) - sum(r[0] in {d for d, _, _ in want} for r in rows)
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_rows_keep_their_numbers_in_other_splits(spark, tmp_path, monkeypatch):
    """The files are one partition each in the first scan and fewer in all later ones."""
    rng = random.Random(8)
    leak = prose(rng, 30)
    texts = [prose(rng, 60) for _ in range(24)]
    texts[5], texts[17] = texts[20], f"{texts[17]} {leak}"
    path = f"{tmp_path}/docs"
    for i, t in enumerate(texts):
        spark.createDataFrame([(i, t, t if i != 12 else texts[3], None)], "doc_id long, text string, html string, url string").repartition(1).write.mode("append").parquet(path)
    key, whole = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")

    def then_whole(written):
        def run(df, label):
            out = written(df, label)
            spark.conf.set(key, whole)
            return out

        return run

    for module in (bagminhash, decontaminate, warc):
        monkeypatch.setattr(module, "written", then_whole(module.written))
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")

    def frame():
        spark.conf.set(key, "1k")
        return spark.read.parquet(path)

    try:
        few = spark.read.parquet(path).rdd.getNumPartitions()
        assert frame().rdd.getNumPartitions() > few
        assert sorted(r["doc_id"] for r in bagminhash.keep_one(frame()).collect()) == [i for i in range(24) if i != 20]
        assert sorted(r["doc_id"] for r in decontaminate.clean(frame(), bench).collect()) == [i for i in range(24) if i != 17]
        made = frame().withColumnRenamed("doc_id", "page_id")
        got = warc.read_records(warc.locate(s := warc.write_index(warc.write_archives(made)), warc.url_keys(made)), payload=True).collect()
        assert s.count() and {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {(12, 3), (20, 5)}
    finally:
        spark.conf.set(key, whole)


def brute_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_equals_table():
    rng = random.Random(2)
    for _ in range(300):
        p, t = ([rng.randrange(4) for _ in range(rng.randint(1, n))] for n in (70, 90))
        assert decontaminate.distance(p, t)[0] == brute_distance(p, t)


def test_passages(spark, docs, empty):
    rng = random.Random(1)
    made = [(i, ("AB!! CD!! " * 60 if i % 3 == 0 else prose(rng, 150)), "s") for i in range(150)]
    train = spark.createDataFrame(made, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(150)] + [(None, 1), (1, None), (2, 1)], "doc_id long, quality int")
    got = passages.classify(train, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in got if r["held_out"])
    odd = passages.classify(docs, labels)
    assert odd.count() == docs.count() and odd.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert {r["score"] for r in passages.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert passages.classify(empty, labels).count() == 0


def test_gradients_of_attention():
    rng = np.random.default_rng(0)
    model, x, bounds, y = passages.Model(), rng.normal(size=(9, passages.N_FEATURES)), np.array([0, 2, 3, 9]), np.array([0.0, 1, 1])
    model.p["score"] = rng.normal(size=passages.CODE)

    def loss():
        s = model.forward(x, bounds)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in model.gradients(x, bounds, y).items():
        flat, at = model.p[name].reshape(-1), 1 % model.p[name].size
        flat[at] += 1e-5
        up = loss()
        flat[at] -= 2e-5
        down = loss()
        flat[at] += 1e-5
        assert abs((up - down) / 2e-5 - g.reshape(-1)[at]) < 1e-6


def brute_bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_near_duplicates(spark, docs, empty, rows):
    rng = random.Random(4)
    base = prose(rng, 120).split()
    near = []
    for i in range(25):  # a group of near copies, pairwise above and below the limit
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"edit{i}"
        near.append((1000 + i, " ".join(w)))
    every = [(r[0], r[1]) for r in rows] + near
    frame = spark.createDataFrame(every, "doc_id long, text string").repartition(1)
    got = frame.sparkSession.createDataFrame(bagminhash.classes(frame).collect(), "doc_id long, class_id long, class_size long")
    bags = [brute_bag(t) for _, t in every]
    parent = list(range(len(every)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(every)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and 100 * both >= 80 * sum((bags[i] | bags[j]).values()):
                parent[root(i)] = root(j)
    members = {}
    for i, (d, _) in enumerate(every):
        members.setdefault(root(i), []).append(d)
    want = Counter((d, min((x for x in m if x is not None), default=None), len(m)) for m in members.values() for d in m)
    assert Counter(tuple(r) for r in got.collect()) == want
    left = bagminhash.keep_one(docs)
    assert left.columns == docs.columns and left.count() < docs.count()
    assert bagminhash.keep_one(spark.createDataFrame(left.collect(), SCHEMA)).count() == left.count()
    assert bagminhash.classes(empty).count() == 0


def test_one_text_without_words_stays(spark):
    made = [(i, [None, "", " \n\t "][i % 3]) for i in range(3, 60)] + [(None, ""), (100, "one two"), (101, "one two"), (102, "three")]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in bagminhash.keep_one(frame).collect()) == [3, 100, 102]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    value = words.mix(np.arange(60, dtype=np.uint64) + np.uint64(5))
    one = rng.integers(1, 12, 60)
    two = np.maximum(1, one + rng.integers(-3, 4, 60))
    share = [(s[0] == s[1]).mean() for s in (
        bagminhash.signatures(np.tile(value + np.uint64(t * 1000003), 2), np.repeat([0, 1], 60), np.concatenate([one, two]), 2) for t in range(60))]
    assert abs(np.mean(share) - np.minimum(one, two).sum() / np.maximum(one, two).sum()) < 0.02


def test_archives(spark, empty):
    made = [(1, "http://a.b.org/x?y", "<p>é</p>"), (2, "https://A.b.org:443/x?y", "<p>é</p>"), (3, None, None), (4, "bad url\n", ""),
            (None, "http://u@c.net:8080", "solo"), (5, "http://a.b.org/x?y", "z" * 3_000_000), (1, "http://a.b.org/x?y", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in made], "page_id long, url string, html string, key string").repartition(1)
    shards = warc.write_index(warc.write_archives(pages))
    got = warc.read_records(warc.locate(shards, warc.url_keys(pages)), payload=True).collect()
    assert len(got) == len(made)
    facts = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert facts == Counter([(1, "response", None, 9), (1, "revisit", 1, 9), (2, "revisit", 1, 9), (3, "response", None, 0), (4, "revisit", 3, 0),
                             (None, "response", None, 4), (5, "response", None, 3_000_000)])
    assert {bytes(r["payload"]) for r in got if r["payload"] is not None} == {b"", b"solo", "<p>é</p>".encode(), b"z" * 3_000_000}
    one = warc.locate(shards, spark.createDataFrame([(warc.url_key("http://c.net:8080/"),), ("org,missing)/",)], "key string")).collect()
    assert [r["page_id"] for r in one] == [None]
    assert warc.url_key("HTTP://A.b.org/x?y#z") == "org,b,a)/x?y"
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_index_blocks(spark, monkeypatch):
    many = spark.createDataFrame([(f"k{i % 90:03d}", i, i, "a", i, 1) for i in range(4000)], warc.CAPTURE)
    got = warc.locate(warc.write_index(many), many.select("key").distinct())
    assert sorted(r["page_id"] for r in got.collect()) == list(range(4000))


def test_host_rules(spark, docs, empty, rows):
    judged = {r["doc_id"]: r for r in host_rules.judge(docs).collect() if r["doc_id"] is not None}
    for d, t, *_ in rows:
        if d is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = Counter(runs)
        again = {i + k for i, r in enumerate(runs) if twice[r] > 1 for k in range(3)}
        lines = [s for s in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        r = judged[d]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and r["kept"] == (not r["base_failed"])
    good = prose(random.Random(5), 80)
    hosts = [(i, "short", "bad") for i in range(99)] + [(100, good, "bad")] + [(200 + i, good + str(i), f"h{i % 5}") for i in range(100)] + [(400, "short", "tiny")]
    frame = spark.createDataFrame(hosts, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in host_rules.keep(frame).collect()}
    assert 100 not in kept and set(range(200, 300)) <= kept  # a bad host takes its good page with it
    a, b = host_rules.beta_prior(10, 100, 50, 28.0)
    assert abs(a / (a + b) - 0.5) < 1e-9 and host_rules.beta_prior(0, 0, 0, 0.0) == (1.0, 1.0)
    assert host_rules.keep(docs).columns == docs.columns and host_rules.keep(empty).count() == 0


def test_bilinear(spark, docs, empty):
    rng = random.Random(6)
    made = [(i, " ".join(rng.choice(["a b c", "c d e", "x y z"]) if i % 2 else rng.choice(["u v", "w t"]) for _ in range(60))) for i in range(200)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = bilinear.score(frame).collect()
    count = Counter(w for i, t in made if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split())
    ends = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in made)
    total, kinds = sum(count.values()) + ends, len(count) + 1
    for r in got:
        p = [math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in [count[w] for w in made[r["doc_id"]][1].split()] + [ends]]
        assert abs(sum(p) - r["base_score"]) < 1e-6 and r["n_tokens"] == len(p) and r["train_tokens"] == total
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the context helps
    assert bilinear.score(docs).where("score IS NULL OR score >= 0").count() == 0 and bilinear.score(docs).count() == docs.count()
    assert bilinear.score(empty).count() == 0


def test_class_probabilities_sum_to_one():
    vocabulary = bilinear.Vocabulary([(b"a", 5), (b"b", 2)], 3)
    model = bilinear.Model(vocabulary)
    one, two = np.full(bilinear.CLASSES, 0), np.full(bilinear.CLASSES, bilinear.END)
    table = np.full(bilinear.CLASSES**2, np.nan, np.float32)
    logs = bilinear.log_class(model, table, np.arange(bilinear.CLASSES), np.stack([one, two]))
    assert abs((10**logs).sum() - 1) < 1e-4


def test_slots(spark, docs, empty, rows):
    got = slots.shard(docs, shards=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(4):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    rng = random.Random(0)
    sizes = {i: rng.randint(1, 1000) for i in range(4096)}
    old = slots.balanced(sizes, 40)
    load = Counter()
    for i, s in old.items():
        load[s] += sizes[i]
    assert max(load.values()) < 1.01 * min(load.values())
    new = slots.rebalance(old, sizes, 41)
    moved = [i for i in old if old[i] != new[i]]
    assert set(new) == set(old) and len(moved) < 4096 * 3 / 41 and set(new.values()) == set(range(41))
    assert set(slots.rebalance(new, sizes, 39).values()) == set(range(39))
    assert slots.map_table(spark, 2, sizes, new).count() == 4096
    assert slots.shard(empty, shards=4).count() == 0


def test_site_lines(spark, docs, empty):
    made = [(i, f"own {i}\n menu \nmore {i}\n\nfoot", "h" if i < 8 else None) for i in range(10)] + [(20, None, "h"), (21, "", "h"), (22, "menu", "h")]
    frame = spark.createDataFrame([(*r, "x") for r in made], "doc_id long, text string, source string, lines string")
    got = {r["doc_id"]: r["text"] for r in site_lines.drop_lines(frame).collect()}
    assert got[3] == "own 3\nmore 3\n" and got[9] == made[9][1] and got[20] is None and got[21] == "" and got[22] == ""
    counted = {r[ROW]["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in site_lines.drop_lines(frame, counts=True).collect()}
    assert counted[3] == (4, 2) and counted[9] == (4, 0) and counted[20] == (0, 0)
    assert site_lines.drop_lines(docs).columns == docs.columns and site_lines.drop_lines(empty).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 40)])
def test_packing(docs, empty, rows, limits):
    got = packing.pack(docs, VOCABULARY, 2, limits=limits).collect()
    whole = {}
    for r in got:
        assert r["ids_crc32"] == crc(r["ids"]) and r["length"] == len(r["ids"]) > 0
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], list(r["ids"])))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [0, *np.cumsum([r["length"] for r in s])[:-1].tolist()]
        assert sum(r["length"] for r in s) <= limits.max_tokens and len(s) <= limits.max_segments and sum(r["loss_tokens"] for r in s) <= limits.max_loss
    want = Counter((r[0], len(i := ids_of(r[1], 2)), tuple(i)) for r in rows)
    for (d, n), pieces in whole.items():
        copies = sum(c for (a, b, _), c in want.items() if (a, b) == (d, n))
        assert sum(len(p) for _, p in pieces) == copies * n
        if copies == 1:
            assert [x for _, p in sorted(pieces) for x in p] == next(list(i) for a, b, i in want if (a, b) == (d, n))
    if limits.max_tokens == 4096:
        sizes = [sum(r["length"] for r in s) for s in sequences.values()]
        padding = sum(4096 - n for n in sizes if n & (n - 1))
        assert padding == 0
    assert packing.pack(empty, VOCABULARY).count() == 0
