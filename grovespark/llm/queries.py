"""The registered queries of this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm import binary_records, brown_lm, chat_format, decontaminate, jaccard_join, line_dedup, media, packing, substring_dedup, toxicity
from grovespark.llm.shared import read_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_records.record_digests(read_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), "space")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(_table(spark, sf_dir, "conversations"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that go, by their place in the text."""
    return line_dedup.repeated_lines(read_documents(spark, sf_dir)).select(F.col("doc").alias("doc_id"), F.col("line").cast("long").alias("line"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(read_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), "lead"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_units(read_documents(spark, sf_dir)).drop("mark")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the model rejects."""
    docs = read_documents(spark, sf_dir)
    model = toxicity.fit_labels(docs, _table(spark, sf_dir, "labels"))
    return toxicity.grade_documents(docs, model).where("toxic").select("doc_id", "severity")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(read_documents(spark, sf_dir)))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.train_and_score(read_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_binary_records, op2_chat_format, op3_line_dedup, op4_packing, op5_substring_dedup, op6_jaccard_join, op7_toxicity, op8_decontamination, op9_media, op10_brown_lm)}


#: op2 in DuckDB: lengths of marks are those of chat_format's templates.
_OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '[', '\['), '<', '\<')) AS n_text,
    length(replace(replace(replace(replace(role, '\', '\\'), '[', '\['), '<', '\<'), ']', '\]')) AS n_role FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(n_text + CASE WHEN role IN ('user', 'assistant', 'system') THEN 10 + 2 * length(role) ELSE 19 + n_role END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


#: op3: runs of three lines that aren't blank (or a shorter document), and of one or two with 50 words, that stand earlier too.
_OP3 = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line
  FROM documents WHERE length(text) > 0),
l AS (
  SELECT doc_id, line, trim(x, E' \t\r\x0b\x0c') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS i,
    count(*) OVER (PARTITION BY doc_id) AS n
  FROM raw WHERE trim(x, E' \t\r\x0b\x0c') <> ''),
m AS (SELECT *, len(string_split_regex(x, '[ \t\r\x0b\x0c]+')) AS words FROM l),
w AS (
  SELECT doc_id, i, n, 1 AS size, [x] AS content, words FROM m UNION ALL
  SELECT doc_id, i, n, 2, list(x) OVER d, sum(words) OVER d FROM m WINDOW d AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) UNION ALL
  SELECT doc_id, i, n, least(n, 3), list(x) OVER d, NULL FROM m WINDOW d AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
k AS (SELECT DISTINCT doc_id, i, size, content FROM w WHERE i + size <= n AND (words IS NULL OR words >= 50)),
f AS (SELECT doc_id, i, size, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS k FROM k)
SELECT DISTINCT l.doc_id, cast(l.line AS BIGINT) AS line FROM f JOIN l ON l.doc_id = f.doc_id AND l.i BETWEEN f.i AND f.i + f.size - 1 WHERE k > 1
"""


#: op5: pieces end at lines, sentences and the longest word around; a unit is the pieces from each on that have 32 words.
_OP5 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS tokens FROM documents),
e AS (SELECT doc_id, unnest(tokens) AS x, unnest(range(len(tokens))) AS k FROM t),
o AS (SELECT *, octet_length(encode(x)) AS bytes, regexp_matches(x, '^[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]') AS is_word, lag(x) OVER d AS before, lead(x) OVER d AS after,
    coalesce(sum(octet_length(encode(x))) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
w AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, start, bytes,
    start + bytes + coalesce(octet_length(encode(regexp_extract(after, '^[^\t\n\x0b\x0c\r ]*'))), 0) AS "end", coalesce(regexp_matches(before, '\n|[.!?] '), false) AS cut FROM o WHERE is_word),
l AS (SELECT *, bytes > coalesce(max(bytes) OVER (d ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) AND bytes >= coalesce(max(bytes) OVER (d ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), 0) AS longest
    FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, i, cut OR i = 0 OR coalesce(lag(longest) OVER (PARTITION BY doc_id ORDER BY i), false) AS new FROM l),
g AS (SELECT doc_id, list(word ORDER BY i) AS words, list(start ORDER BY i) AS starts, list("end" ORDER BY i) AS ends FROM w GROUP BY doc_id),
p AS (SELECT b.doc_id, i, coalesce(lead(i) OVER (PARTITION BY b.doc_id ORDER BY i), len(words)) AS stop FROM b JOIN g ON g.doc_id = b.doc_id WHERE new),
u AS (SELECT a.doc_id, a.i, z.stop FROM p a ASOF JOIN p z ON a.doc_id = z.doc_id AND a.i + 32 <= z.stop),
c AS (SELECT u.doc_id, array_to_string(words[i + 1:stop], ' ') AS content, cast(stop - i AS INTEGER) AS n_words, cast(starts[i + 1] AS BIGINT) AS start, cast(ends[stop] AS BIGINT) AS "end" FROM u JOIN g ON g.doc_id = u.doc_id),
f AS (SELECT doc_id, start, "end", n_words, first_value(doc_id) OVER s AS first_doc_id, first_value(start) OVER s AS first_start, first_value("end") OVER s AS first_end
    FROM c WINDOW s AS (PARTITION BY content ORDER BY doc_id, start))
SELECT doc_id, start, "end", n_words, first_doc_id, first_start FROM f WHERE NOT (doc_id = first_doc_id AND start < first_end)
"""

#: op6: all pairs that share a shingle, then the smallest id that links reach.
_OP6 = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM t),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
near AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, near.b FROM r JOIN near ON near.a = r.seen)
SELECT s.doc_id, cast(len(s.shingles) AS BIGINT) AS n_shingles, min(r.seen) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.shingles
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": _OP2, "op3_line_dedup": _OP3, "op5_substring_dedup": _OP5, "op6_jaccard_join": _OP6}
