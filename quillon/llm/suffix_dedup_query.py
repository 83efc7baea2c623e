"""op3: bytes of 100-byte strings that also start earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .suffix_dedup import suffix_dedup


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: what was removed and the digest of the rest; a null or empty text has no bytes."""
    rows = suffix_dedup(table(spark, sf_dir, "documents"), span=100)
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Bytes are pairs of hexadecimal digits; a window is 200 of them.
OP3_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
often AS (SELECT w, min((doc_id, s)) AS first FROM w GROUP BY w HAVING count(*) > 1),
hits AS MATERIALIZED (SELECT doc_id, s FROM w JOIN often USING (w) WHERE (doc_id, s) <> first),
edges AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM hits),
runs AS (SELECT doc_id, s, sum(CASE WHEN gap IS NULL OR gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM edges),
gone AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY ALL),
stays AS (SELECT doc_id, coalesce(lag(b) OVER o, 0) AS a, a AS b FROM gone WINDOW o AS (PARTITION BY doc_id ORDER BY a)
          UNION ALL SELECT doc_id, max(b), NULL FROM gone GROUP BY doc_id
          UNION ALL SELECT doc_id, 0, NULL FROM d WHERE doc_id NOT IN (SELECT doc_id FROM gone)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS h FROM stays JOIN d USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
