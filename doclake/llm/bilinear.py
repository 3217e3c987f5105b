"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Tokens of a text are its words (A-Z in lower case) and one end token. Token counts of the
whole training part are taken exactly. The model predicts the class of a token from the
classes of the two tokens before it: the ``HEAD`` most frequent words and the end token are
classes of their own, all other words fall into ``BUCKETS`` classes by their last letters. A
context's vector is the sum of its tokens' vectors, each scaled elementwise by its position;
the dot product with a class's vector, plus the class's bias, is the class's score. Within a
bucket a word has its smoothed share of the bucket's count, and all unseen words together
have the share of one word without count.

Every task trains on all tokens of its partition (noise samples are shared by a batch, so
scores are matrix products) from the same start; parameters are averaged by tokens. Scores
are normalised: the sum over all classes is computed once per distinct context of a worker.

Counts of the ``LOOKUP`` most frequent words go to the tasks; rarer words of a text are joined
with the table of counts, in which no word is frequent any more.

Defined cases: a null or empty text is one end token; a null id counts as training; repeated
rows are scored each; an empty table gives an empty result; without any training text all
classes are equally likely. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from doclake.llm import words
from doclake.llm.common import ID, numbered, runs_of, texts_of, written
from doclake.llm.passages import remainder

HEAD, BUCKETS = 767, 256
END = HEAD + BUCKETS
CLASSES = END + 1
LOOKUP = 1 << 17
DIM, NOISE, BATCH, RATE = 24, 32, 4096, 0.02
FLUSH = 400_000  # distinct words that a task holds before it hands counts on
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def folded(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(_LOWER)


def bucket(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of words outside the head, by up to three last bytes."""
    key = np.zeros(len(start), np.uint64)
    for back in (1, 2, 3):
        byte = np.where(end - back >= start, raw[np.maximum(end - back, 0)], 0)
        key = key * np.uint64(257) + byte.astype(np.uint64)
    return HEAD + (words.mix(key + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)


class Vocabulary:
    """The frequent words by hash: class and count; totals of the corpus and of each class."""

    def __init__(self, frequent: list[tuple[bytes, int]], n_docs: int):
        h, _ = words.hashes([w for w, _ in frequent])
        order = np.argsort(h)
        self.hash = h[order]
        self.count = np.array([c for _, c in frequent], np.int64)[order]
        self.rank = np.arange(len(frequent))[order]
        self.n_docs = n_docs
        self.class_count = np.zeros(CLASSES, np.int64)
        self.class_words = np.zeros(CLASSES, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the frequent words, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)

    def classes(self, w: words.Words, at: np.ndarray) -> np.ndarray:
        own = (at >= 0) & (self.rank[at] < HEAD) if len(self.hash) else np.zeros(len(at), bool)
        return np.where(own, self.rank[at] if len(self.hash) else 0, bucket(w.raw, w.start, w.end))

    def class_log(self) -> np.ndarray:
        """Log probability of each class in the training part, smoothed."""
        return np.log((self.class_count + 0.5) / (self.class_count.sum() + 0.5 * CLASSES))


class Model:
    """Vectors of classes as context and as target, scales of the two positions, biases."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 5):
        r = np.random.default_rng(seed)
        self.context = r.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32)
        self.target = r.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32)
        self.scale = np.ones((2, DIM), np.float32)
        self.bias = vocabulary.class_log().astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.scale, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def queries(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Predicted vectors for contexts (previous class, class before it)."""
        return self.context[one] * self.scale[0] + self.context[two] * self.scale[1]

    def log_norm(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log of the summed exponentials of all classes' scores for each context."""
        out = np.empty(len(one), np.float32)
        for i in range(0, len(one), 2048):
            s = self.queries(one[i : i + 2048], two[i : i + 2048]) @ self.target.T + self.bias
            top = s.max(1)
            out[i : i + 2048] = np.log(np.exp(s - top[:, None]).sum(1)) + top
        return out


class Trainer:
    """NCE over batches of (token, previous, one before), with Adam."""

    def __init__(self, model: Model, log_noise: np.ndarray, seed: int):
        self.model, self.log_noise = model, log_noise.astype(np.float32)
        self.cumulated = np.cumsum(np.exp(log_noise))
        self.random = np.random.default_rng(seed)
        self.m = [np.zeros_like(p) for p in model.parts()]
        self.v = [np.zeros_like(p) for p in model.parts()]
        self.step = self.tokens = 0

    def batch(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m = self.model
        noise = np.minimum(np.searchsorted(self.cumulated, self.random.random(NOISE) * self.cumulated[-1]), CLASSES - 1)
        q = m.queries(one, two)
        shift = self.log_noise + np.float32(math.log(NOISE))
        good = np.einsum("ij,ij->i", q, m.target[w]) + m.bias[w] - shift[w]
        false = q @ m.target[noise].T + (m.bias[noise] - shift[noise])
        g_good = (-1 / (1 + np.exp(np.minimum(good, 30)))) / len(w)
        g_false = (1 / (1 + np.exp(-np.maximum(false, -30)))) / len(w)
        d_q = g_good[:, None] * m.target[w] + g_false @ m.target[noise]
        d_target, d_bias = _scatter(w, g_good[:, None] * q), np.bincount(w, weights=g_good, minlength=CLASSES)
        np.add.at(d_target, noise, g_false.T @ q)
        np.add.at(d_bias, noise, g_false.sum(0))
        d_context = _scatter(one, d_q * m.scale[0]) + _scatter(two, d_q * m.scale[1])
        d_scale = np.stack([np.einsum("ij,ij->j", d_q, m.context[c]) for c in (one, two)])
        self.step += 1
        self.tokens += len(w)
        rate = RATE * math.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for p, g, a, b in zip(m.parts(), (d_context, d_target, d_scale, d_bias.astype(np.float32)), self.m, self.v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * a / (np.sqrt(b) + 1e-8)


def _scatter(index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows by class."""
    out = np.zeros((CLASSES, rows.shape[1]), np.float32)
    order = np.argsort(index.astype(np.int16), kind="stable")
    index = index[order]
    first = np.flatnonzero(np.diff(index, prepend=-1))
    out[index[first]] = np.add.reduceat(rows[order], first)
    return out


def streams(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """Classes of all tokens (each text ends with the end token), their text, place among the
    frequent words (-1: none, -2: end token), the two classes before; and the scanned words."""
    scanned, cls, doc, at = [], [], [], []
    for w in words.scan([folded(t) for t in texts]):
        found = vocabulary.find(w.hash)
        scanned.append((w, found))
        cls.append(vocabulary.classes(w, found))
        doc.append(w.doc)
        at.append(found)
    doc = np.concatenate([*doc, np.zeros(0, np.int64)]).astype(np.int64)
    last = np.searchsorted(doc, np.arange(len(texts)), "right")
    cls = np.insert(np.concatenate([*cls, np.zeros(0, np.int64)]).astype(np.int64), last, END)
    at = np.insert(np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64), last, -2)
    doc = np.insert(doc, last, np.arange(len(texts)))
    one, two = np.full(len(cls), END), np.full(len(cls), END)
    one[1:] = cls[:-1]  # the token before a text's first is an end token by itself
    two[2:] = np.where(one[1:-1] == END, END, one[1:-1]) if len(cls) > 2 else two[2:]
    two[one == END] = END
    return cls, doc, at, np.stack([one, two]), scanned


# ------------------------------------------------------------------ Spark jobs


def count_words(texts: DataFrame) -> DataFrame:
    """Counts of all words: word (bytes), n. The count of texts is under the null word. Written."""

    def run(batches):
        held: Counter = Counter()
        n_docs = 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            n_docs += b.num_rows
            for t in texts_of(b.column(0)):
                held.update(folded(t).split())
                if len(held) > FLUSH:
                    yield rows()
                    held.clear()
        yield rows()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([n_docs], pa.int64())], ["word", "n"])

    return written(texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _least_count(counts: DataFrame, most: int = LOOKUP) -> int:
    """The least count that at most ``most`` words reach, among powers of 2**(1/16)."""
    step = F.floor(F.log2("n") * 16).alias("step")
    sizes = {r["step"]: r["words"] for r in counts.groupBy(step).agg(F.count(F.lit(1)).alias("words")).collect()}  # some hundred rows
    least, total = max(sizes, default=0) + 1, 0
    for s in sorted(sizes, reverse=True):
        if (total := total + sizes[s]) > most:
            break
        least = s
    return math.ceil(2 ** (least / 16) - 1e-9)


def build_vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int]:
    """The vocabulary, all tokens N and distinct tokens V of the training part."""
    real = counts.where(F.col("word").isNotNull())
    n_docs = (counts.where(F.col("word").isNull()).agg(F.sum("n")).first()[0]) or 0
    top = sorted(((bytes(r["word"]), r["n"]) for r in real.where(F.col("n") >= _least_count(real)).collect()), key=lambda x: (-x[1], x[0]))
    vocabulary = Vocabulary(top, n_docs)

    def run(batches):
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            found = b.column(0).to_pylist()
            number = np.array(b.column(1).to_pylist(), np.int64)
            done = 0
            for w in words.scan(found):
                c = vocabulary.classes(w, vocabulary.find(w.hash))
                n += np.bincount(c, weights=number[done : done + len(c)], minlength=CLASSES).astype(np.int64)
                v += np.bincount(c, minlength=CLASSES)
                done += len(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], ["class", "n", "v"])

    for r in real.mapInArrow(run, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        vocabulary.class_count[r["class"]], vocabulary.class_words[r["class"]] = r["n"], r["v"]
    vocabulary.class_count[END], vocabulary.class_words[END] = n_docs, int(n_docs > 0)
    return vocabulary, int(vocabulary.class_count.sum()), int(vocabulary.class_words.sum())


def train(texts: DataFrame, vocabulary: Vocabulary) -> Model:
    """Train in every partition from the same start, average the parameters by tokens."""

    def run(batches):
        from pyspark import TaskContext

        trainer = Trainer(Model(vocabulary), vocabulary.class_log(), 1000 + TaskContext.get().partitionId())
        held: list[np.ndarray] = []
        waiting = 0
        for b in batches:
            for _, some in runs_of(texts_of(b.column(0))):
                cls, _, _, before, _ = streams(some, vocabulary)
                held.append(np.concatenate([cls[None], before]))
                waiting += len(cls)
                if waiting >= BATCH:
                    whole = np.concatenate(held, 1)
                    cut = waiting // BATCH * BATCH
                    for i in range(0, cut, BATCH):
                        trainer.batch(*whole[:, i : i + BATCH])
                    held, waiting = [whole[:, cut:]], waiting - cut
        if waiting:
            trainer.batch(*np.concatenate(held, 1))
        if trainer.tokens:
            flat = trainer.model.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * trainer.tokens), pa.array(np.full(len(flat), float(trainer.tokens)))],
                                             ["place", "value", "weight"])

    rows = texts.mapInArrow(run, "place long, value double, weight double").groupBy("place").agg(
        (F.sum("value") / F.sum("weight")).alias("value")).collect()  # one row per parameter
    model = Model(vocabulary)
    flat = model.flat()
    for r in rows:
        flat[r["place"]] = r["value"]
    return model.load(flat)


_norms: dict[int, np.ndarray] = {}


def _norm_table(model: Model) -> np.ndarray:
    """The worker's log normalisers by context, not a number where not computed yet."""
    key = hash(model.flat().tobytes())
    if key not in _norms:
        _norms.clear()
        _norms[key] = np.full(CLASSES * CLASSES, np.nan, np.float32)
    return _norms[key]


def log_class(model: Model, table: np.ndarray, cls: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each token's class."""
    one, two = before
    context = one * CLASSES + two
    if (new := np.unique(context[np.isnan(table[context])])).size:
        table[new] = model.log_norm(new // CLASSES, new % CLASSES)
    out = np.empty(len(cls))
    for i in range(0, len(cls), 1 << 16):
        s = slice(i, i + (1 << 16))
        out[s] = np.einsum("ij,ij->i", model.queries(one[s], two[s]), model.target[cls[s]]) + model.bias[cls[s]] - table[context[s]]
    return out / math.log(10)


def score(docs: DataFrame, modulus: int = 5, held: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Learn from the documents whose remainder is not ``held``, score all documents."""
    out_of = F.coalesce(remainder(F.col(doc_id), modulus) == held, F.lit(False))
    learn = docs.where(~out_of).select(F.col(text).alias("text"))
    counts = count_words(learn)
    vocabulary, total, distinct = build_vocabulary(counts)
    model = train(learn, vocabulary)
    base = math.log10(total + 0.5 * (distinct + 1))
    in_class = np.log10(vocabulary.class_count + 0.5 * (vocabulary.class_words + 1))

    def run(batches):
        table = _norm_table(model)
        for b in batches:
            for begin, some in runs_of(texts_of(b.column(3))):
                yield _scored(some, vocabulary, model, table, base, in_class,
                              [b.column(i).slice(begin, len(some)) for i in range(3)])

    rows = numbered(docs).select(ID, F.col(doc_id).cast("long").alias("doc_id"), out_of.alias("held_out"), F.col(text).alias("text"))
    first = written(rows.mapInArrow(run, f"{ID} long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
                                    "model double, rare array<struct<word: binary, class: int, n: long>>"), "scored")
    rare = first.select(ID, F.explode("rare").alias("r")).select(ID, "r.*")
    known = counts.where(F.col("word").isNotNull()).withColumnRenamed("n", "c")
    c = F.coalesce("c", F.lit(0))
    room = F.element_at(F.array(*[F.lit(float(x)) for x in in_class[HEAD:END]]), F.col("class") - HEAD + 1)
    more = rare.join(known, "word", "left").groupBy(ID).agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (F.log10(c + 0.5) - base)).alias("more_base"),
        F.sum(F.col("n") * (F.log10(c + 0.5) - room)).alias("more_model"))

    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return first.drop("rare").join(more, ID, "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("model", "more_model").alias("score"))


def _scored(texts, vocabulary, model, table, base, in_class, keys) -> pa.RecordBatch:
    """A run of texts: sums over frequent words and end tokens, and the rare words with their numbers."""
    cls, doc, at, before, scanned = streams(texts, vocabulary)
    n = len(texts)
    count = np.where(at == -2, vocabulary.n_docs, vocabulary.count[at] if len(vocabulary.count) else 0)
    here = at != -1
    known = np.bincount(doc[here & (count > 0)], minlength=n)
    log_count = np.log10(count + 0.5)
    base_sum = np.bincount(doc, weights=np.where(here, log_count - base, 0), minlength=n)
    shared = here & (cls >= HEAD) & (cls < END)  # frequent words inside a bucket
    model_sum = np.bincount(doc, weights=log_class(model, table, cls, before) + np.where(shared, log_count - in_class[cls], 0), minlength=n)
    rare: list[list[dict]] = [[] for _ in range(n)]
    for w, found in scanned:
        index = np.flatnonzero(found < 0)
        if not len(index):
            continue
        order = index[np.lexsort((w.hash[index], w.doc[index]))]
        new = np.flatnonzero(np.concatenate([[True], (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])]))
        pick, number = order[new], np.diff(np.append(new, len(order)))
        data, kind = w.raw.tobytes(), bucket(w.raw, w.start[pick], w.end[pick])
        for d, a, e, k, m in zip(w.doc[pick].tolist(), w.start[pick].tolist(), w.end[pick].tolist(), kind.tolist(), number.tolist(), strict=True):
            rare[d].append({"word": data[a:e], "class": k, "n": m})
    kinds = pa.list_(pa.struct([("word", pa.binary()), ("class", pa.int32()), ("n", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array(np.bincount(doc, minlength=n)), pa.array(known), pa.array(base_sum), pa.array(model_sum), pa.array(rare, kinds)],
        [ID, "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare"])
