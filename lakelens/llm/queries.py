"""The driver's queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm import generated, leakage, near_duplicates, neighbours, packing, residue, secrets, splitting
from lakelens.session import stage_table
from lakelens.tables import load, load_spread


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_rows(load_spread(spark, folder, "chunks"), stage_table)


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(load_spread(spark, folder, "chunks"), stage_table)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return generated.judged(load_spread(spark, folder, "chunks"), stage_table).where("found").select("project_id", "ref", "path")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_pairs(load_spread(spark, folder, "chunks"), stage_table)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(load_spread(spark, folder, "chunks"))


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.redacted(load_spread(spark, folder, "chunks"))


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What redaction must leave as it is: rows, lengths, lines and texts without any credential."""
    hidden = secrets.redacted(load_spread(spark, folder, "chunks")).where("text IS NOT NULL")
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    return hidden.select("chunk_pos", F.length("text").cast("long").alias("n_chars"), lines.alias("n_lines"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split_oversized(load_spread(spark, folder, "chunks"))
    return pieces.where("piece_no = 0").select("chunk_pos", "cut")


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(load_spread(spark, folder, "chunks"))


def p7_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces put together again without what they share: text and lines of every cut chunk, and whether all pieces fit."""
    pieces = splitting.split_oversized(load_spread(spark, folder, "chunks"))
    lines = F.split("text", "\n", -1)
    fresh = F.concat(F.lit("\n"), F.array_join(F.slice(lines, F.col("shared_lines") + 1, F.size(lines)), "\n"))
    own = F.when(F.col("piece_no") == 0, F.col("text")).when(F.col("shared_chars") > 0, F.expr("substring(text, shared_chars + 1)")).otherwise(fresh)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))), lambda x: x.own), "")
    return pieces.groupBy("chunk_pos").agg(
        F.min("start_line").cast("long").alias("start_line"), F.max("end_line").cast("long").alias("end_line"), (F.max("n_chars") <= splitting.LIMIT).alias("fits"), F.md5(whole).alias("md5")
    )


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(load_spread(spark, folder, "documents"), stage_table)


def p8_placed(spark: SparkSession, folder: str) -> DataFrame:
    """What packing guarantees of every document: placed once with all its characters, in containers that are not over capacity."""
    rows = stage_table(packing.pack(load_spread(spark, folder, "documents"), stage_table), "packed")
    loads = rows.groupBy("container").agg((F.sum("n_tokens") <= packing.CAPACITY).alias("fits"))
    per = rows.join(loads, "container").groupBy("doc_id").agg(
        F.sum(F.col("char_end") - F.col("char_start")).alias("n_chars"), F.max("char_end").cast("long").alias("last"), ((F.count(F.lit(1)) == F.max("n_pieces")) & (F.countDistinct("piece_no") == F.max("n_pieces"))).alias("once"), F.every("fits").alias("fits")
    )
    return per.select("doc_id", "n_chars", "last", "once", "fits")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(load_spread(spark, folder, "documents"), load(spark, folder, "bench_items"), stage_table).select("doc_id", "item_id")


def p9_near(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 12 words with up to one character edit."""
    return leakage.leaks(load_spread(spark, folder, "documents"), load(spark, folder, "bench_items"), stage_table, edits=1)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(load_spread(spark, folder, "documents"), stage_table).select("doc_id")


def p10_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The residue of every such document, with the width of its widest message."""
    return residue.residue(load_spread(spark, folder, "documents"), stage_table)


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_groups, p3_found, p5_found, p6_found, p6_kept, p6_redacted, p7_found, p7_pieces, p7_rebuilt, p8_packed, p8_placed, p9_found, p9_near, p10_found, p10_messages)
}

P2_FOUND = r"""
WITH w AS (SELECT chunk_pos, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM chunks WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT chunk_pos, w[p.k] || ' ' || w[p.k + 1] || ' ' || w[p.k + 2] AS g
  FROM w, range(1, len(w) - 1) AS p(k) WHERE len(w) >= 20),
n AS (SELECT chunk_pos, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.chunk_pos AS a, b.chunk_pos AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.chunk_pos < b.chunk_pos GROUP BY ALL)
SELECT a AS chunk_pos_a, b AS chunk_pos_b FROM c JOIN n x ON x.chunk_pos = a JOIN n y ON y.chunk_pos = b
WHERE c >= 0.6::DOUBLE * (x.n + y.n - c) - 1e-9
"""

# classes of equal sets, links between classes, and the least class that each one reaches
P2_GROUPS = r"""
WITH RECURSIVE w AS (SELECT chunk_pos, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM chunks WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT chunk_pos, w[p.k] || ' ' || w[p.k + 1] || ' ' || w[p.k + 2] AS g
  FROM w, range(1, len(w) - 1) AS p(k) WHERE len(w) >= 20),
k AS (SELECT chunk_pos, count(*) AS n, min(chunk_pos) OVER (PARTITION BY md5(string_agg(g, '|' ORDER BY g))) AS class_id FROM s GROUP BY chunk_pos),
h AS (SELECT s.chunk_pos, g, n FROM s JOIN k USING (chunk_pos) WHERE chunk_pos = class_id),
c AS (SELECT a.chunk_pos AS a, b.chunk_pos AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM h a JOIN h b ON a.g = b.g AND a.chunk_pos <> b.chunk_pos GROUP BY ALL),
e AS (SELECT a, b FROM c WHERE c >= 0.6::DOUBLE * (na + nb - c) - 1e-9),
r AS (SELECT class_id, class_id AS root FROM k WHERE chunk_pos = class_id UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.class_id AND r.root < e.b)
SELECT k.chunk_pos, k.class_id, least(k.class_id, (SELECT min(root) FROM r WHERE r.class_id = k.class_id)) AS group_id, (SELECT count(*) FROM e WHERE e.a = k.class_id) AS n_links FROM k
"""

P5_FOUND = r"""
WITH v AS (
  SELECT chunk_pos, vector::DOUBLE[64] AS v FROM chunks
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.chunk_pos AS p, b.chunk_pos AS o
  FROM v a JOIN v b ON a.chunk_pos <> b.chunk_pos AND array_cosine_similarity(a.v, b.v) >= 0.9
  QUALIFY row_number() OVER (PARTITION BY a.chunk_pos ORDER BY round(array_cosine_similarity(a.v, b.v), 6) DESC, b.chunk_pos) <= 5)
SELECT DISTINCT least(p, o) AS chunk_pos_a, greatest(p, o) AS chunk_pos_b FROM near
"""

P7_FOUND = r"""
SELECT chunk_pos,
       CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')) > 1600)) > 0
            THEN 'inside_line' ELSE 'whole_lines' END AS cut
FROM chunks
WHERE length(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')) > 1600
"""

P9_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM bench_items WHERE text IS NOT NULL),
ig AS (SELECT item_id, array_to_string(w[p.k:p.k + 11], ' ') AS g FROM i, range(1, greatest(len(w) - 11, 0) + 1) AS p(k)),
dg AS (SELECT doc_id, array_to_string(w[p.k:p.k + 11], ' ') AS g FROM d, range(1, greatest(len(w) - 11, 0) + 1) AS p(k))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

P6_KEPT = "SELECT chunk_pos, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines FROM chunks WHERE text IS NOT NULL"

P7_REBUILT = f"""
SELECT chunk_pos, coalesce(start_line, 1)::BIGINT AS start_line, coalesce(start_line, 1)::BIGINT + len(string_split(text, chr(10))) - 1 AS end_line, true AS fits, md5(text) AS md5
FROM chunks JOIN ({P7_FOUND}) USING (chunk_pos)
"""

P8_PLACED = "SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(length(text), 0) AS last, true AS once, true AS fits FROM documents"

ORACLES = {
    "p2_found": P2_FOUND, "p2_groups": P2_GROUPS, "p5_found": P5_FOUND, "p6_kept": P6_KEPT, "p7_found": P7_FOUND, "p7_rebuilt": P7_REBUILT, "p8_placed": P8_PLACED, "p9_found": P9_FOUND,
}
