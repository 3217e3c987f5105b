"""The registered queries of this subpackage, and their checking SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from doclake.llm import (
    bagminhash, bilinear, compressed_language, decontaminate, host_rules, huffman, infill, packing, passages, site_lines, slots, warc, whitening,
)
from doclake.llm.common import ID, ROW, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# Measures and verdicts of the host rules, as tables `measured` and `judged` over a table `docs`.
HOST_RULES_SQL = f"""numbered AS (SELECT row_number() OVER () AS rid, * FROM documents),
words AS (SELECT rid, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM numbered),
runs AS (SELECT rid, unnest(range(0, len(w) - 2)) AS p, w FROM words),
named AS (SELECT rid, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS run FROM runs),
twice AS (SELECT rid, p FROM named QUALIFY count(*) OVER (PARTITION BY rid, run) > 1),
covered AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{WORD}')) AS l FROM numbered),
measured AS (SELECT rid, doc_id, source, text, lang, n_chars, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
 FROM numbered JOIN words USING (rid) JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
failed AS (SELECT *, CAST(n_words < 50 AS INT) AS short, CAST(100 * n_repeat_words > 50 * n_words AS INT) AS repeated,
  CAST(100 * n_symbols > 20 * n_words AS INT) AS symbols, CAST(100 * n_dup_lines > 50 * n_lines AS INT) AS dup_lines FROM measured),
facts AS (UNPIVOT (SELECT rid, source, short, repeated, symbols, dup_lines FROM failed)
  ON short, repeated, symbols, dup_lines INTO NAME rule VALUE f),
hosts AS (SELECT source, rule, count(*) AS n, sum(f) AS f FROM facts GROUP BY source, rule),
moments AS (SELECT rule, count(*) AS h, sum(n) AS n, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS sq FROM hosts GROUP BY rule),
spreads AS (SELECT rule, mean, sq - mean * mean - mean * (1 - mean) * h / n AS spread FROM moments),
priors AS (SELECT rule, mean, CASE WHEN spread <= 0 THEN 1e6
  ELSE least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) END AS strength FROM spreads),
shrunk AS (SELECT source, (f + greatest(mean * strength, 1e-9))
  / (n + greatest(mean * strength, 1e-9) + greatest((1 - mean) * strength, 1e-9)) AS rate FROM hosts JOIN priors USING (rule)),
verdicts AS (SELECT source, max(rate) > 0.8 AS host_rejected FROM shrunk GROUP BY source),
judged AS (SELECT f.*, short + repeated > 0 AS base_failed, v.host_rejected, short + repeated = 0 AND NOT v.host_rejected AS kept
 FROM failed f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source)"""


@query("op6_host_rules", f"""WITH {HOST_RULES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, host_rejected, kept FROM judged""")
def op6_host_rules(spark, sf_dir):
    return host_rules.judge(table(spark, sf_dir, "documents"))


@query("op8_slot_shards")
def op8_slot_shards(spark, sf_dir):
    return slots.shard(table(spark, sf_dir, "documents"), shards=40)


# Lines cut by site-relative frequency, as a table `cut` over a table `docs` with a row number rid.
SITE_LINES_SQL = f"""split_lines AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs WHERE text IS NOT NULL),
full_lines AS (SELECT *, trim(line, {BLANKS}) AS body FROM split_lines WHERE regexp_matches(line, '{WORD}')),
line_pages AS (SELECT source, body, count(DISTINCT rid) AS pages FROM full_lines GROUP BY source, body),
totals AS (SELECT source, count(*) AS total FROM docs GROUP BY source),
common AS (SELECT l.source, body FROM line_pages l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE pages >= 3 AND pages > total * 0.05),
dropped AS (SELECT rid, place FROM full_lines f JOIN common c ON f.source IS NOT DISTINCT FROM c.source AND f.body = c.body),
cut AS (SELECT s.rid, string_agg(line, chr(10) ORDER BY s.place) FILTER (WHERE d.rid IS NULL) AS text, count(d.rid) AS n_dropped,
  count(*) FILTER (WHERE regexp_matches(line, '{WORD}')) AS n_lines
 FROM split_lines s LEFT JOIN dropped d ON s.rid = d.rid AND s.place = d.place GROUP BY s.rid)"""


@query("op9_site_lines", f"""WITH docs AS (SELECT row_number() OVER () AS rid, * FROM documents), {SITE_LINES_SQL}
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
 CASE WHEN docs.text IS NULL THEN NULL ELSE md5(coalesce(cut.text, '')) END AS text_md5 FROM docs LEFT JOIN cut USING (rid)""")
def op9_site_lines(spark, sf_dir):
    cut = site_lines.drop_lines(table(spark, sf_dir, "documents"), counts=True)
    return cut.selectExpr(f"{ROW}.doc_id AS doc_id", "n_lines", "n_dropped", f"md5({ROW}.text) AS text_md5")


def vocabulary_file() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_huffman_ids")
def op1_huffman_ids(spark, sf_dir):
    files = huffman.encode_documents(table(spark, sf_dir, "documents"), vocabulary_file(), end_id=1)
    return huffman.read_files(spark, files)


@query("op10_vector_packing")
def op10_vector_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file(), end_id=2, ids=False)


@query("op2_pigeonhole_leaks")
def op2_pigeonhole_leaks(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(ID)


@query("op4_bagminhash_classes")
def op4_bagminhash_classes(spark, sf_dir):
    return bagminhash.classes(table(spark, sf_dir, "documents"))


@query("op3_attention_mil")
def op3_attention_mil(spark, sf_dir):
    return passages.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_log_bilinear")
def op7_log_bilinear(spark, sf_dir):
    return bilinear.score(table(spark, sf_dir, "documents"))


@query("op5_capture_index", """WITH sized AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
firsts AS (SELECT payload, min(page_id) AS first_id FROM sized GROUP BY payload)
SELECT page_id, octet_length(s.payload) AS payload_bytes, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST(list_reduce(list_transform(range(0, 5), lambda b: CAST(substr(bits, 5 * k + b + 1, 1) AS INT)), lambda x, y: 2 * x + y) AS INT), 1), '' ORDER BY k)
  FROM (SELECT unnest(range(0, 32)) AS k)) AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM (SELECT *, list_reduce(list_transform(string_split(regexp_replace(sha1(payload), '(.)', '\\1 ', 'g'), ' ')[1:40],
  lambda h: right('0000' || bin(CAST(('0x' || h) AS INT)), 4)), lambda x, y: x || y) AS bits FROM sized) s JOIN firsts USING (payload)""")
def op5_capture_index(spark, sf_dir):
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir):
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings"), columns=["vec_id"]))


@query("op12_compressed_language")
def op12_compressed_language(spark, sf_dir):
    return compressed_language.classify(table(spark, sf_dir, "documents"))


# Words with the white space before them, and white space at the end, as tokens.
TOKEN = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"


@query("op13_roaring_fim", f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
    OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
   WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM texts),
parts AS (SELECT *, coalesce(array_to_string(w[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(w[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
  coalesce(array_to_string(w[greatest(a, b) + 1:], ''), '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts""")
def op13_roaring_fim(spark, sf_dir):
    return infill.digests(infill.transform(table(spark, sf_dir, "documents"), columns=["doc_id"]))
