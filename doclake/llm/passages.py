"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words. Every passage is encoded (shares of
capitals, signs, digits and repeats, word lengths, hashed words; then a learned tanh layer),
gated attention weighs the passages, and the weighted sum of their codes is scored. Encoder,
attention and score are learned together from document labels, in numpy.

Training uses at most ``SAMPLE`` labelled documents (those whose ids hash lowest) and at most
``MAX_BAG`` evenly spaced passages of each; scoring uses every passage of every document.

Defined cases: a null or empty text is one passage without words; labels of the same id are
averaged, a null label counts as none; without labels every score is 0.5; a null id is scored
and not held out; repeated rows are scored each; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from doclake.llm import words
from doclake.llm.common import runs_of, texts_of, written

WORDS = 64
SAMPLE = 8000
MAX_BAG = 64
HASHED = 32
CODE, GATE = 24, 12
EPOCHS, BATCH, RATE = 12, 64, 0.01

_KINDS = {"upper": range(65, 91), "digit": range(48, 58), "stop": b".,;:", "call": b"!?", "sign": b"#*$%&<>@=+~^", "bar": b"|/\\_"}
_FLAGS = np.zeros((len(_KINDS), 256), bool)
for _i, _chars in enumerate(_KINDS.values()):
    _FLAGS[_i, list(_chars)] = True
N_FEATURES = len(_KINDS) + 7 + HASHED


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each text's passages begin (one more entry than texts)."""
    cols: list[list[np.ndarray]] = [[] for _ in range(len(_KINDS) + 4)]
    for w in words.scan([t.encode("utf-8", "replace") for t in texts]):
        sums = np.zeros(len(w.raw) + 1, np.int32)
        for i, flags in enumerate(_FLAGS):
            found = flags[w.raw]
            if i == 0:  # capitals of composed Latin-1 letters are C3 80 to C3 9E
                found[1:] |= (w.raw[:-1] == 0xC3) & (w.raw[1:] >= 0x80) & (w.raw[1:] <= 0x9E)
            np.cumsum(found, out=sums[1:])
            cols[i].append(sums[w.end] - sums[w.start])
        cols[-4].append(_FLAGS[0][w.raw[w.start]].astype(np.int32))
        cols[-3].append((w.end - w.start).astype(np.int32))
        cols[-2].append(w.hash)
        cols[-1].append(w.doc)
    n_words = np.zeros(len(texts), np.int64)
    whole = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
    h, doc = whole[-2].astype(np.uint64), whole[-1]
    if len(doc):
        n_words = np.bincount(doc, minlength=len(texts))
    bags = np.maximum(1, -(-n_words // WORDS))
    bounds = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((int(bounds[-1]), N_FEATURES), np.float32)
    if not len(doc):
        return out, bounds
    first = np.cumsum(n_words) - n_words
    passage = bounds[doc] + (np.arange(len(doc)) - first[doc]) // WORDS
    size = np.bincount(passage, minlength=len(out)).astype(np.float32)
    some = np.maximum(size, 1)

    def total(x):
        return np.bincount(passage, weights=x, minlength=len(out))

    chars = total(whole[-3])
    for i in range(len(_KINDS)):
        out[:, i] = total(whole[i]) / np.maximum(chars, 1)
    k = len(_KINDS)
    order = np.lexsort((h, passage))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    out[:, k] = np.log1p(size) / 4
    out[:, k + 1] = chars / some / 8
    out[:, k + 2] = total(whole[-4]) / some
    out[:, k + 3] = np.bincount(passage[order][new], minlength=len(out)) / some
    out[:, k + 4] = total(again) / some
    out[:, k + 5] = total(whole[-3] <= 2) / some
    out[:, k + 6] = total(whole[-3] >= 12) / some
    mixed = words.mix(h)
    sign = (mixed >> np.uint64(63)).astype(np.float64) * 2 - 1
    slot = passage * HASHED + (mixed % np.uint64(HASHED)).astype(np.int64)
    out[:, k + 7 :] = np.bincount(slot, weights=sign, minlength=len(out) * HASHED).reshape(-1, HASHED) / np.sqrt(some)[:, None]
    return out, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """Encoder, gated attention and score; parameters by name."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.center, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.p = {
            "code": r.normal(0, N_FEATURES**-0.5, (N_FEATURES, CODE)), "code0": np.zeros(CODE),
            "what": r.normal(0, CODE**-0.5, (CODE, GATE)), "gate": r.normal(0, CODE**-0.5, (CODE, GATE)),
            "attend": r.normal(0, GATE**-0.5, GATE), "score": np.zeros(CODE), "score0": np.zeros(1),
        }

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, bounds[:-1]
        size = np.diff(bounds)
        code = np.tanh(((x - self.center) / self.scale) @ p["code"] + p["code0"])
        what, gate = np.tanh(code @ p["what"]), _sigmoid(code @ p["gate"])
        e = (what * gate) @ p["attend"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), size))
        weight = e / np.repeat(np.add.reduceat(e, at), size)
        pooled = np.add.reduceat(weight[:, None] * code, at)
        return {"code": code, "what": what, "gate": gate, "weight": weight, "pooled": pooled,
                "score": _sigmoid(pooled @ p["score"] + p["score0"])}

    def gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f, size = self.p, self.forward(x, bounds), np.diff(bounds)
        error = (f["score"] - y) / len(y)
        d_pooled = np.repeat(error[:, None] * p["score"], size, 0)
        d_weight = (d_pooled * f["code"]).sum(1)
        mean = np.repeat(np.add.reduceat(f["weight"] * d_weight, bounds[:-1]), size)
        d_e = f["weight"] * (d_weight - mean)
        d_what = d_e[:, None] * p["attend"] * f["gate"] * (1 - f["what"] ** 2)
        d_gate = d_e[:, None] * p["attend"] * f["what"] * f["gate"] * (1 - f["gate"])
        d_code = f["weight"][:, None] * d_pooled + d_what @ p["what"].T + d_gate @ p["gate"].T
        d_code *= 1 - f["code"] ** 2
        return {
            "code": ((x - self.center) / self.scale).T @ d_code, "code0": d_code.sum(0), "what": f["code"].T @ d_what,
            "gate": f["code"].T @ d_gate, "attend": d_e @ (f["what"] * f["gate"]), "score": error @ f["pooled"], "score0": error.sum(keepdims=True),
        }

    def train(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Model:
        """Adam over shuffled batches of bags."""
        if not len(bags):
            return self
        every = np.concatenate(bags)
        self.center, self.scale = every.mean(0), every.std(0) + 1e-3
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                bounds = np.concatenate([[0], np.cumsum([len(bags[j]) for j in pick])])
                step += 1
                for k, g in self.gradients(np.concatenate([bags[j] for j in pick]), bounds, y[pick]).items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def fit(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents."""
    known = labels.select(F.col(doc_id).alias("key"), F.col(label).cast("double").alias("y")).where("key IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("key").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    known = written(known.orderBy(F.xxhash64("key"), "key").limit(sample), "labelled")

    def run(batches):
        for b in batches:
            for begin, texts in runs_of(texts_of(b.column(1))):
                x, bounds = features(texts)
                bags = []
                for i in range(len(texts)):
                    n = int(bounds[i + 1] - bounds[i])
                    pick = bounds[i] + (np.arange(min(n, MAX_BAG)) * n // min(n, MAX_BAG))
                    bags.append(x[pick].tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(texts)), b.column(2).slice(begin, len(texts)), pa.array(bags, pa.binary())], ["y", "key", "bag"])

    rows = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(known, "key")
    found = rows.select("y", "text", F.col("key").cast("string")).mapInArrow(run, "y double, key string, bag binary").collect()
    found = sorted(found, key=lambda r: (r["key"], r["bag"]))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in found]
    return Model().train(bags, np.array([r["y"] for r in found]))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, score (0 to 1), n_passages, top_weight (the largest attention weight)."""

    def run(batches):
        for b in batches:
            for begin, texts in runs_of(texts_of(b.column(1))):
                x, bounds = features(texts)
                f = model.forward(x, bounds)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(begin, len(texts)), pa.array(np.clip(f["score"], 0, 1)), pa.array(np.diff(bounds).astype(np.int64)),
                     pa.array(np.maximum.reduceat(f["weight"], bounds[:-1]))], ["doc_id", "score", "n_passages", "top_weight"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, score double, n_passages long, top_weight double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """Learn from labels whose remainder modulo 4 is not 2, score all documents."""
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs, labels.where(~held), label, sample=sample)
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "top_weight")
