"""The pipeline, stage by stage in plain Python, against its rows on a small corpus."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from doclake.llm import decontaminate  # noqa: E402
from test_operators import brute_bag, brute_distance, crc, ids_of, prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, host string"
MENU = "home | news | about us"


def corpus():
    """Hosts good, mixed, bad and null; menus, copies, leaks, nulls, empty and long texts, a repeated row, clashing columns."""
    rng = random.Random(12)
    good = [f"{MENU}\n{prose(rng, 90)}\n{prose(rng, 40)}" for _ in range(30)]
    leak = prose(rng, 40)
    rows = [(i, t, "good") for i, t in enumerate(good)]
    rows += [(100, good[3], "mixed"), (101, good[4].replace(MENU, "other menu"), None), (102, good[5] + " changed at the end", "mixed")]
    rows += [(110, f"{prose(rng, 60)} {leak} {prose(rng, 60)}", "mixed"), (111, f"{prose(rng, 80)} {leak.upper().replace(' ', ', ', 3)}", None)]
    words = leak.split()
    words[5], words[21] = "edited", "twice"
    rows += [(112, f"{prose(rng, 70)} {' '.join(words)} {prose(rng, 5)}", "mixed"), (113, prose(rng, 20_000), "mixed")]
    rows += [(120 + i, "buy now", "bad") for i in range(60)] + [(190, prose(rng, 90), "bad")]
    rows += [(200, None, "good"), (201, "", None), (202, " \n ", "mixed"), (203, "x y z " * 40, "good"), (204, prose(rng, 70), None), (None, prose(rng, 70), None)]
    rows.append(rows[7])
    items = [(1, leak), (2, None), (3, ""), (4, prose(rng, 35)), (None, prose(rng, 30))]
    return [(d, t, None, s, None if t is None else len(t), "clash", "clash") for d, t, s in rows], items


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_quality(docs):
    fails = []
    for _, text, _, host, *_ in docs:
        w = words_of(text)
        seen = Counter(zip(w, w[1:], w[2:]))
        again = {i + k for i, run in enumerate(zip(w, w[1:], w[2:])) if seen[run] > 1 for k in range(3)}
        lines = [s for s in (text or "").split("\n") if words_of(s)]
        fails.append((len(w) < 50, 100 * len(again) > 50 * len(w), 100 * len(re.findall(r"[#*$%&|<>]", text or "")) > 20 * len(w),
                      100 * (len(lines) - len(set(lines))) > 50 * len(lines)))
    pages = Counter(d[3] for d in docs)
    bad = set()
    for rule in range(4):
        failed = Counter({h: 0 for h in pages})
        for d, f in zip(docs, fails):
            failed[d[3]] += f[rule]
        n, mean = len(docs), sum(failed.values()) / len(docs)
        spread = sum(pages[h] * (failed[h] / pages[h] - mean) ** 2 for h in pages) / n - mean * (1 - mean) * len(pages) / n
        strength = 1e6 if spread <= 0 else min(1e6, max(1.0, mean * (1 - mean) / spread - 1))
        bad |= {h for h in pages if (failed[h] + mean * strength) / (pages[h] + strength) > 0.8}
    return [d for d, f in zip(docs, fails) if not (f[0] or f[1]) and d[3] not in bad]


def by_lines(docs):
    pages, on = Counter(d[3] for d in docs), Counter()
    for _, text, _, host, *_ in docs:
        on.update((host, s) for s in {s.strip(" \t\n\x0b\f\r") for s in (text or "").split("\n") if words_of(s)})
    common = {k for k, n in on.items() if n >= 3 and n > 0.05 * pages[k[0]]}
    return [(d[0], None if d[1] is None else "\n".join(s for s in d[1].split("\n") if not words_of(s) or (d[3], s.strip(" \t\n\x0b\f\r")) not in common), *d[2:])
            for d in docs]


def by_copies(docs):
    bags, label = [brute_bag(d[1]) for d in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and 100 * both >= 80 * sum((bags[i] | bags[j]).values()) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    first = {}
    for d, x in sorted(zip(docs, label), key=lambda p: (p[0][0] is None, p[0][0] or 0)):
        first.setdefault(x, d)
    return list(first.values())


def by_leaks(docs, items):
    patterns = [p for _, t in items if (p := decontaminate.plain(t or "").split())]
    return [d for d in docs if all(brute_distance(p, decontaminate.plain(d[1] or "").split()) > int(0.2 * len(p)) for p in patterns)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    docs, items = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_equal_plain_python(spark, tables):
    docs, items = corpus()
    want = docs
    steps = [by_quality, by_lines, by_copies, lambda d: by_leaks(d, items)]
    frame = spark.read.parquet(f"{tables}/documents.parquet")
    sizes = [len(docs)]
    for (_, stage), step in zip(corpus_pipeline.STAGES, steps):
        frame, want = corpus_pipeline.written(stage(spark, frame, tables), "test-stage"), step(want)
        assert frame.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert Counter(tuple(r) for r in frame.collect()) == Counter(want)
        sizes.append(len(want))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4]  # all stages but the cutting of lines drop something
    ids = {d[0] for d in want}
    assert {0, 1, 2, 113, 204, None} <= ids and not ids & {100, 101, 102, 110, 111, 112, 190, 200, 201, 202, 203}
    assert all(MENU not in d[1] for d in want if d[3] == "good")

    whole = {}
    for r in corpus_pipeline.run(spark, tables).collect():
        whole.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(whole) == ids
    for d, text, *_ in want:
        every, at = ids_of(text, 2), 0
        for start, length, check, n in sorted(whole[d]):
            assert (start, n, check) == (at, len(every), crc(every[start:start + length]))
            at += length
        assert at == len(every)


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{tables}/documents.parquet").write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/more/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/more").where("doc_id = 110").count() > 0  # no items, nothing leaks


@pytest.mark.parametrize("pages", [6, 60])
def test_copies_reach_packing(spark, tmp_path, pages):
    """A third of a host is copies of one page, another host is nothing else: one full copy of each is packed."""
    rng = random.Random(pages)
    page = [f"{MENU}\n{prose(rng, 60)}\n{prose(rng, 60)}" for _ in range(2)]
    near = [f"{MENU}\n{prose(rng, 60)}\n{prose(rng, 60)}\n{prose(rng, 90)}" for _ in range(2)]
    third = pages // 3
    rows = [(i, page[0], "exact") for i in range(third)] + [(100 + i, page[1], "only") for i in range(third + 1)]
    rows += [(200 + i, f"{near[0]}\nedit{i}", "near") for i in range(third)]
    rows += [(300 + i, f"{MENU}\n{prose(rng, 90)}", host) for i, host in enumerate(["exact", "near"] * (pages - third))]
    docs = [(d, t, None, s, len(t), "clash", "clash") for d, t, s in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(rng, 35))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        packed[r["doc_id"]] = r["doc_tokens"]
    assert set(packed) == {0, 100, 200, *(d for d, _, _ in rows if d >= 300)}
    for d, text in ((0, page[0]), (100, page[1]), (200, f"{near[0]}\nedit0")):
        kept = text if d == 100 else text.replace(f"{MENU}\n", "")
        assert packed[d] == len(ids_of(kept, 2))
