"""Language of a text by compression: the language whose dictionary makes the text smallest.

Every learned language has a zstandard dictionary of raw content: whole texts of that language, in the
order of a hash, up to ``dictionary_bytes``. A text is brought to lower-case letters with single spaces,
cut into blocks of ``BLOCK`` bytes, and every block is compressed once with each dictionary; blocks keep
a text from being compressed by its own repeats instead of by the dictionary. The language with the
smallest sum is the prediction. Where the next one is less than ``min_margin`` larger, the prediction is
named but not accepted.

The learned sample is bounded: ``dictionary_bytes`` for a language, and ``TOTAL_BYTES`` for all of them,
shared equally where languages are many. It is drawn by hash from all labelled texts, equal texts once.
Texts above an eighth of a dictionary come last, and the one that passes its end is cut there.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as are all texts if nothing
was learned; rows without a language, or a text, are not learned from; a null id is not held out; of
languages with equal sums the one with more labelled rows counts, then the first by name; repeated rows
are each scored; an empty table gives an empty result. All columns of the input, whatever their names,
are passed on inside the struct ``_llm_row``.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from doclake.llm.common import ROW, packed, written
from doclake.llm.passages import remainder

UNKNOWN = "und"
DICTIONARY_BYTES = 128 << 10
TOTAL_BYTES = 64 << 20
BLOCK = 4096
LEVEL = 7
OVERSAMPLE, LEAST_TEXTS = 4, 64
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
RESULT = "struct<lang: string, score: double, margin: double>"


def plain(text: str) -> bytes:
    """Lower-case letters and their marks, all else as one space."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


class Model:
    """Languages, the more frequent first, and their dictionaries. Compressors are made where they are used."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.dictionaries = dictionaries
        self._ready = None

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "_ready": None}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if self._ready is None:
            # Bare blocks: nothing in the output but what the text needs.
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)
            self._ready = []
            for _, content in self.dictionaries:
                d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                self._ready.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
        return self._ready

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text with each dictionary."""
        data = memoryview(plain(text))
        out = [0] * len(self.dictionaries)
        for begin in range(0, len(data), BLOCK):
            block = data[begin : begin + BLOCK]
            for i, c in enumerate(self._compressors()):
                out[i] += len(c.compress(block))
        return out

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and how much larger the next language's sum is, as a share of that sum."""
        if not text or not self.dictionaries or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sorted(sizes[:best] + sizes[best + 1 :])
        # One byte more is half as likely; languages far behind add nothing.
        score = 1 / (1 + sum(2.0 ** -min(s - sizes[best], 1000) for s in others))
        return self.dictionaries[best][0], score, (others[0] - sizes[best]) / others[0] if others else 1.0


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Dictionaries of all languages that the rows name."""
    known = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    known = known.withColumn("h", F.xxhash64("text")).withColumn("bytes", F.octet_length("text"))
    facts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.avg("bytes").alias("avg"), F.approx_count_distinct("h").alias("texts"))
    facts = written(facts, "languages")
    size = min(dictionary_bytes, TOTAL_BYTES // max(1, facts.count()))

    # First by hash to a few times what is needed, then to the bytes of the dictionary. Long texts are cut here
    # already, so that a language of nothing else moves LEAST_TEXTS dictionaries at most.
    share = F.greatest(F.lit(OVERSAMPLE * size) / F.greatest("avg", F.lit(1.0)), F.lit(LEAST_TEXTS)) / F.greatest("texts", F.lit(1))
    drawn = known.join(facts, "lang").where(F.shiftrightunsigned("h", 11) / F.lit(2.0**53) < share)
    drawn = drawn.withColumn("text", F.substring("text", 1, size))
    texts = drawn.groupBy("lang", "h").agg(*[F.min(c).alias(c) for c in ("text", "bytes", "rows")])
    in_order = Window.partitionBy("lang").orderBy(F.col("bytes") > size // 8, "h")
    before = F.sum("bytes").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    sample = texts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < size).select(
        "lang", "rows", "before", "text").collect()  # at most TOTAL_BYTES and a text a language

    by_lang: dict[str, list] = {r["lang"]: [r["rows"], b""] for r in facts.select("lang", "rows").collect()}
    for r in sorted(sample, key=lambda r: r["before"]):
        by_lang[r["lang"]][1] += plain(r["text"]) + b" "
    order = sorted(by_lang, key=lambda name: (-by_lang[name][0], name))
    return Model([(name, by_lang[name][1][:size]) for name in order])


def predict(docs: DataFrame, model: Model, text: str = "text", min_margin: float = 0.02, columns: list[str] | None = None) -> DataFrame:
    """``_llm_row`` (the named columns, all by default) beside lang_pred, score (0 to 1), margin and accepted."""

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        lang, score, margin = zip(*map(model.predict, texts.to_pylist()), strict=True) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())],
                                          ["lang", "score", "margin"])

    found = packed(docs, columns, run(F.col(f"`{text}`")).alias("p"))
    accepted = (F.col("p.lang") != UNKNOWN) & (F.col("p.margin") >= min_margin)
    return found.select(ROW, F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.margin").alias("margin"), accepted.alias("accepted"))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from documents whose remainder modulo 3 is not 1, predict all."""
    held = F.coalesce(remainder(F.col(f"`{doc_id}`"), 3) == 1, F.lit(False))
    model = learn(docs.where(~held), text, lang)
    kept = F.col(f"{ROW}.`{doc_id}`")
    return predict(docs, model, text, columns=[doc_id]).select(
        kept.alias("doc_id"), F.coalesce(remainder(kept, 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "accepted")
