"""op8: documents whose 3-word shingle sets have a Jaccard similarity of 0.85 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .minhash import Near, near_dedup


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; one without words is a component of its own."""
    return near_dedup(table(spark, sf_dir, "documents"), Near(words=3, percent=85))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(s) AS s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS s FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
x AS MATERIALIZED (SELECT doc_id, s FROM s WHERE s IN (SELECT s FROM often)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = doc_id
"""
