"""The thin queries of this package: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, licenses, quality
from .byte_bpe import token_digests
from .common import in_small_batches
from .conversation_trie import rebuilt_nodes
from .exact_dedup import exact_dedup
from .language_id import language_predictions
from .mixing import mix_words
from .secrets import secret_spans
from .sentence_pieces import piece_digests
from .simhash import simhash_groups
from .spelling import LOWER, UPPER, spelling_forms
from .substring_dedup import repeats_removed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_small_batches(table(spark, sf_dir, "documents"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_words(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: their source and language stand for directories."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(documents(spark, sf_dir).select("doc_id", path.alias("path"), "text"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(documents(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_nodes(table(spark, sf_dir, "conversations"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_ann, op2_language_id, op3_secrets, op4_simhash, op5_byte_bpe, op6_mixing, op7_quality, op8_licenses, op9_exact_dedup, op10_substring_dedup, op11_spelling, op12_conversation_trie, op13_sentencepiece)}

#: White space as DuckDB's RE2 has it.
_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"

#: CRC-32 of a text's bytes, as its definition by bits has it.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(S)) + 1), lambda i: ('0x' || substr(hex(encode(S)), (2 * i - 1)::INT, 2))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

_LETTERS = "[A-Za-z\u00c0-\u00ff]"

ORACLES = {
    "op11_spelling": f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{_LETTERS}{{6,}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
h AS (SELECT run, {_CRC.replace("S", "(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM r),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 5 AND length(word) >= 6),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
e AS (SELECT DISTINCT a.word AS a, a.n AS m, b.word AS b, b.n FROM d a JOIN v b ON a.rest = b.word),
near AS (SELECT a.word AS a, a.n AS m, b.word AS b, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION ALL SELECT a, m, b, n FROM e UNION ALL SELECT b, n, a, m FROM e),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near FROM near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * v.n THEN b END AS form, CASE WHEN best.n >= 5 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON a = word AND k = 1),
led AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT led.word, f.word, f.form FROM led JOIN f ON f.word = led.next)
SELECT f.word, f.form, led.root, f.n, f.n_near, f.form_n FROM f JOIN led ON f.word = led.word AND led.next IS NULL""",
    "op12_conversation_trie": f"""
WITH t AS (SELECT conv_id AS c, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % 20 AS base, {_CRC.replace("S", "c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c.c, t.n AS place, t.t, t.words FROM c JOIN t ON t.c = c.base AND t.n <= c.h UNION ALL SELECT c.c, t.n + 10 AS place, t.t, t.words FROM c JOIN t ON t.c = c.c AND t.n > c.h),
d AS (SELECT c, row_number() OVER w AS depth, words, string_agg(t, '') OVER w AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY place)),
p AS (SELECT c, depth, words, md5(k) AS k, lag(md5(k), 1, '') OVER w AS pk, lead(depth) OVER w IS NULL AS last FROM d WINDOW w AS (PARTITION BY c ORDER BY depth)
  UNION ALL SELECT c, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM r WHERE r.c = c.c) FROM c),
n AS (SELECT k, min(c) AS rep, min(depth) AS depth, min(pk) AS pk, count(*) AS n, bool_and(last) AS leaf, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last) AS ends FROM p GROUP BY k),
m AS (SELECT p.c, p.k, sum(CASE WHEN p.c = n.rep THEN (n.n - 1) * p.words ELSE 0 END) OVER w AS saved, sum((p.c = n.rep AND n.leaf)::INT) OVER w AS leaves
  FROM p JOIN n ON p.k = n.k WINDOW w AS (PARTITION BY p.c ORDER BY p.depth DESC)),
s AS (SELECT k, sum(saved) AS saved, sum(leaves) AS leaves FROM m GROUP BY k),
ch AS (SELECT pk AS k, count(*) AS n FROM n GROUP BY pk)
SELECT n.rep AS conv_id, n.depth, up.rep AS parent_conv_id, n.n AS n_convs, coalesce(ch.n, 0) AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s ON n.k = s.k LEFT JOIN ch ON n.k = ch.k LEFT JOIN n up ON n.pk = up.k""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT *, string_agg(word, ' ') OVER f AS t, count(*) OVER f AS n FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
late AS (SELECT doc_id, word, i, n = 20 AND row_number() OVER (PARTITION BY t, n = 20 ORDER BY doc_id, i) > 1 AS late FROM win),
gone AS (SELECT doc_id, word, i, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM late),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op9_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_NORM}) AS text_sha256, length(coalesce(text, '')) AS size FROM documents),
w AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight,
  source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / weight AS filled, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY filled, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY filled, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, coalesce(weight * (SELECT level FROM l x WHERE x.level <= x.filled ORDER BY x.filled, x.source IS NULL, x.source LIMIT 1), cap)) AS target FROM l),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY
    16 * length(ltrim(bin(size), '0')) + (size >> greatest(length(ltrim(bin(size), '0')) - 4, 0)),
    CAST('0x' || substr(ord, 1, 4) AS INT) % 64, size, ord, doc_id) AS upto FROM d),
e AS (SELECT r.*, t.source_size, t.target, least(coalesce(t.target / nullif(t.source_size, 0), 0), 2.0::DOUBLE) AS each,
    CAST(CAST('0x' || substr(md5('7/' || coalesce(r.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS off
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(each * upto + off) - floor(each * (upto - 1) + off)) * size AS BIGINT) AS taken FROM e""",
}
