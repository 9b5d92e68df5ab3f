"""The operators as named queries over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.llm import (
    alignment,
    byte_bpe,
    co_training,
    common,
    exact_dedup,
    mixing,
    packing,
    quality_rules,
    secret_scan,
    simhash,
    spelling,
    substring_tree,
    suffix_parse,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CAPACITY = 2048


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def _crc_entry(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


@query
def op1_suffix_tree_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_tree.without_repeats(documents(spark, folder)).drop("kept")


SQL["op1_suffix_tree_dedup"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS x
  FROM words, unnest(range(1, len(w) - 33)) AS t(i)),
again AS (
  SELECT doc_id, i FROM windows WHERE x IN (SELECT x FROM windows GROUP BY x HAVING count(*) > 1)),
gone AS (
  SELECT doc_id, list_distinct(list(i + k)) AS places
  FROM again, unnest(range(0, 35)) AS t(k) GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN w ELSE (
           SELECT coalesce(list(y ORDER BY p), []) FROM (SELECT unnest(w) AS y, unnest(range(1, len(w) + 1)) AS p)
           WHERE NOT list_contains(places, p)) END AS k
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""


@query
def op2_chunk_recipe_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


SQL["op2_chunk_recipe_dedup"] = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER best AS kept, sha256(t) AS text_sha256
FROM normal
WINDOW best AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST)"""


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_pieces(documents(spark, folder), tokenizer_json(), CAPACITY)


@query
def op4_secret_automaton(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.secret_spans(documents(spark, folder))
    base = [r.kind for r in secret_scan.BASE]

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    plain = joined(F.filter("spans", lambda x: x["kind"].isin(base)))
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(plain.cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op5_certified_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judged(documents(spark, folder), labels(spark, folder))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op6_ftrl_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, folder), labels(spark, folder))


@query
def op7_co_training(spark: SparkSession, folder: str) -> DataFrame:
    return co_training.quality_scores(documents(spark, folder), labels(spark, folder))


@query
def op8_prefix_free_parsing(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_parse.without_repeats(documents(spark, folder)).drop("kept")


@query
def op9_source_schedule(spark: SparkSession, folder: str) -> DataFrame:
    sized = documents(spark, folder).withColumn("size", common.word_count(common.plain_text()))
    return mixing.taken_words(sized).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot", "n_pieces"
    )


SQL["op9_source_schedule"] = r"""
WITH sizes AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY src) - 1) % 3 + 1]::DOUBLE AS w
  FROM sizes GROUP BY src),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER earlier, 0))
           / sum(w) OVER later AS level
  FROM totals
  WINDOW earlier AS (ORDER BY 2.0::DOUBLE * source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         later AS (ORDER BY 2.0::DOUBLE * source_size / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT src, source_size, CASE WHEN cap / w <= level THEN cap
         ELSE w * max(CASE WHEN cap / w > level THEN level END) OVER () END AS target
  FROM levels),
quota AS (SELECT src, source_size, target, CAST(floor(target) AS BIGINT) AS q FROM targets),
lined AS (
  SELECT *, coalesce(sum(size) OVER (
           PARTITION BY src ORDER BY substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12), doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sizes),
needs AS (SELECT src, ceil(q / 128) AS need FROM quota),
dealt AS (
  SELECT src, CASE WHEN need > 0 THEN greatest(ceil(need * 1.02::DOUBLE), need + 8) ELSE 0 END::BIGINT AS share FROM needs),
bounds AS (
  SELECT src, round(coalesce(sum(share) OVER earlier, 0) / (sum(share) OVER ())::DOUBLE * 2147483648) AS lo,
         round((coalesce(sum(share) OVER earlier, 0) + share) / (sum(share) OVER ())::DOUBLE * 2147483648) AS hi
  FROM dealt WINDOW earlier AS (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
slots AS (
  SELECT slot, src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank
  FROM (SELECT range AS slot, range * 1327217885 % 2147483648 AS point
        FROM range((SELECT CAST(sum(share) AS BIGINT) FROM dealt))) AS line
  JOIN bounds ON point >= lo AND point < hi),
placed AS (
  SELECT *, least(start + size, q) AS stop, start + source_size AS start2, least(start + source_size + size, q) AS stop2
  FROM lined JOIN quota USING (src))
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, stop - start) + greatest(0, stop2 - start2) AS BIGINT) AS taken,
       slot AS first_slot,
       CAST(CASE WHEN start < stop THEN (stop - 1) // 128 - start // 128 + 1 ELSE 0 END
          + CASE WHEN start2 < stop2 THEN (stop2 - 1) // 128 - start2 // 128 + 1 ELSE 0 END AS BIGINT) AS n_pieces
FROM placed p LEFT JOIN slots s ON s.src = p.src AND s.rank = p.start // 128 AND p.start < p.stop"""


@query
def op10_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op11_transducer_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs, tokenizer = documents(spark, folder), tokenizer_json("byte_bpe_50k.json")
    encoded = byte_bpe.encode(docs, tokenizer, byte_bpe.lexicon(docs, tokenizer))
    return byte_bpe.decode(encoded, tokenizer).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op12_merge_path_alignment(spark: SparkSession, folder: str) -> DataFrame:
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return alignment.link_statistics(documents(spark, folder), tokenizer_json("byte_bpe_50k.json"), model)


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    found = spelling.spelling_groups(documents(spark, folder))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


#: The table of CRC-32 by its rule, for DuckDB has no such function.
_CRC_TABLE = ", ".join(str(_crc_entry(i)) for i in range(256))
#: DuckDB compares bytes; À to ÿ each become one ASCII sign that no word has.
_LATIN = "'" + "".join(map(chr, range(0xC0, 0x100))) + "', '" + "".join(map(chr, range(33, 97))).replace("'", "''") + "'"
SQL["op13_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           [4294967295::UBIGINT] || list_transform(range(0, length(x) // 2),
             lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT)),
           lambda c, b: xor(c >> 8, ([{_CRC_TABLE}]::UBIGINT[])[CAST((xor(c, b) & 255) AS BIGINT) + 1]))) AS h
  FROM counted),
typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
         ELSE run END AS word, n AS times
  FROM hashed),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n
  FROM words a JOIN words b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1
   AND a.word <> b.word
   AND (left(a.word, 3) = left(b.word, 3) OR right(a.word, 3) = right(b.word, 3))
   AND levenshtein(translate(a.word, {_LATIN}), translate(b.word, {_LATIN})) = 1),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other,
         first(other_n ORDER BY other_n DESC, other) AS other_n
  FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
walked AS (
  SELECT word, word AS root FROM formed
  UNION ALL
  SELECT w.word, f.form FROM walked w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM walked w JOIN formed f ON f.word = w.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
