"""Words are told apart by their bytes, not by their hashes."""

import itertools
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from doclake.llm import bagminhash, huffman, packing, words  # noqa: E402
from doclake.llm.tokens import Coder, coder  # noqa: E402

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def mirrored(n):
    """Two words of ``n`` letters that every polynomial modulo a power of two takes for one: the Thue-Morse pattern and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="module")
def pair(spark):
    texts = [*mirrored(1024), *[" ".join(w) for w in zip(mirrored(1024), mirrored(1024)[::-1])]]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)


def ids_of(text, end):
    return [*coder(VOCABULARY).tokenizer.encode(text, add_special_tokens=False).ids, end]


def test_ids_of_mirrored_words(spark, pair):
    texts, docs = pair
    crc = [zlib.crc32(np.asarray(ids_of(t, 1), "<u4").tobytes()) for t in texts]
    rows = huffman.read_files(spark, huffman.encode_documents(docs, VOCABULARY, end_id=1)).orderBy("doc_id").collect()
    assert [r["ids_crc32"] for r in rows] == crc and len(set(crc)) == 4
    packed = packing.pack(docs, VOCABULARY, end_id=2).orderBy("doc_id", "start").collect()
    for i, t in enumerate(texts):
        assert [x for r in packed if r["doc_id"] == i for x in r["ids"]] == ids_of(t, 2)


def test_classes_of_mirrored_words(pair):
    texts, docs = pair
    assert {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs).collect()} == {i: i for i in range(4)}
    assert bagminhash.keep_one(docs).count() == 4
    again = docs.unionAll(docs.selectExpr("doc_id + 10", "concat('  ', upper(text), '\\n')"))  # same words
    assert bagminhash.keep_one(again).count() == 4


def test_words_of_one_hash_keep_their_ids(monkeypatch):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefé0-"))
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(rng.integers(0, 60))) for _ in range(40)] + ["x" * 5000 + " y", "", "a a\0 a\0\0"]
    plain = words.hash_words
    monkeypatch.setattr(words, "hash_words", lambda *a: plain(*a) % np.uint64(5))
    made = Coder(VOCABULARY)
    for _ in range(2):
        ids, bounds = made.encode(texts)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [ids_of(t, 0)[:-1] for t in texts]


@pytest.mark.parametrize("name", ["MAX_WORDS", "MAX_POOL"])
def test_a_full_table_starts_anew(monkeypatch, name):
    from doclake.llm import tokens

    monkeypatch.setattr(tokens, name, 2000)
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(30)]
    made = Coder(VOCABULARY)
    for t in texts + texts:
        assert made.encode([t])[0].tolist() == ids_of(t, 0)[:-1]


def test_new_words_go_to_the_model_together(monkeypatch):
    from types import SimpleNamespace

    from doclake.llm import tokens

    monkeypatch.setattr(tokens, "MAX_PIECES", 300)
    made, calls = Coder(VOCABULARY), []
    model = made._model
    made._model = SimpleNamespace(encode_batch=lambda runs, **k: calls.append(len(runs)) or model.encode_batch(runs, **k))
    texts = [" ".join(f"Wörd{i}x{'abcdefghij'[j % 10] * (j // 10 + 1)}'s_{i}, 日本 <|endoftext|> ß¹" for j in range(100)) for i in range(9)]
    for t in [*texts, "", *texts]:
        assert made.encode([t])[0].tolist() == ids_of(t, 0)[:-1]
    assert 0 < len(calls) <= 9


def test_hashes_depend_on_every_byte_and_the_length():
    base = bytes(range(97, 123)) * 12
    made = [base[:n] for n in (1, 2, 7, 8, 9, 15, 16, 17, 255, 256, 257, 300)] + [b"a\0", b"a\0\0", b"\0"]
    made += [bytes([*w[:i], w[i] ^ 1, *w[i + 1 :]]) for w in (base[:9], base[:40], base[:300]) for i in range(len(w))]
    h, bounds = words.hashes(made)
    assert np.diff(bounds).tolist() == [1] * len(made) and len(set(h.tolist())) == len(set(made))
    joined, _ = words.hashes([b" ".join(made)])
    assert joined.tolist() == h.tolist()  # what is beside a word does not matter


def test_equal_words_are_found_in_a_pool():
    data, pool = b"abc abcdefghij abcdefghik ab", b"abcabcdefghijab" + bytes(8)
    start, end = np.array([0, 4, 15, 26]), np.array([3, 14, 25, 28])
    at = np.frombuffer(pool, np.uint8)
    assert words.same(data, start, end, at, np.array([0, 3, 3, 13]), np.array([3, 10, 10, 2])).tolist() == [True, True, False, True]
    assert words.same(data, start, end, at, np.array([0, 0, 0, 0]), np.array([2, 10, 3, 2])).tolist() == [False, False, False, True]


def test_a_tokenizer_that_keeps_white_space_is_refused():
    with pytest.raises(ValueError, match="white space"):
        Coder(public_tokenizers.path("byte_bpe_50k.json"))
