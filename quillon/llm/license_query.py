"""op9: the licence of every document. The table has no paths, so they are made of its columns: a document lies in the
directory of its source and language, ten directories below it by the id; one in fifty by its id is the directory's
licence file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_scan import BLANK_LINES, TEMPLATES, license_scan


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; one with a null or empty text has no licence of its own. A null source or language is no step of
    the path."""
    docs = table(spark, sf_dir, "documents")
    id_ = F.col("doc_id")
    name = F.when(id_ % 50 == 0, F.concat(F.lit("LICENSE."), id_.cast("string"))).otherwise(F.concat(id_.cast("string"), F.lit(".txt")))
    folder = F.when(id_ % 3 == 0, F.concat_ws("/", "source", "lang")).otherwise(F.concat_ws("/", F.col("source"), F.col("lang"), (id_ % 10).cast("string")))
    return license_scan(docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text"))


def _sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(k, n, s.replace("'", "''")) for k, (n, s) in enumerate(TEMPLATES))
    return rf"""
WITH t(number, name, statement) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS text,
        CASE WHEN doc_id % 3 = 0 THEN concat_ws('/', source, lang) ELSE concat_ws('/', source, lang, (doc_id % 10)::VARCHAR) END AS folder,
        CASE WHEN doc_id % 50 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS file FROM documents),
tt AS (SELECT number, name, term, count(*) AS n
       FROM (SELECT number, name, unnest(regexp_extract_all(translate(statement, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]')) AS term FROM t) GROUP BY ALL),
words AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.+-]+'), lambda w: trim(w, '.+-')))) AS term FROM d),
df AS MATERIALIZED (SELECT term, count(*) AS n FROM words GROUP BY term),
total AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT DISTINCT tt.term, ln((1.0 + total.n) / (1 + coalesce(df.n, 0))) + 1 AS idf FROM tt LEFT JOIN df USING (term), total),
tw AS (SELECT number, name, term, tt.n * idf AS w FROM tt JOIN idf USING (term)),
part AS (SELECT number, name, term, w / sqrt(sum(w * w) OVER (PARTITION BY number)) AS part FROM tw),
units AS (SELECT doc_id, list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '{BLANK_LINES}'), lambda b: contains(b, chr(10))), CASE WHEN file LIKE 'LICENSE%' THEN [text] ELSE [] END) AS units FROM d),
l AS (SELECT doc_id, unnest(units) AS content, generate_subscripts(units, 1) AS line FROM units),
lt AS (SELECT doc_id, line, term, count(*) AS n
       FROM (SELECT doc_id, line, unnest(regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]')) AS term FROM l) GROUP BY ALL),
lw AS (SELECT doc_id, line, term, lt.n * (ln((1.0 + total.n) / (1 + coalesce(df.n, 0))) + 1) AS w FROM lt LEFT JOIN df USING (term), total),
norm AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY ALL),
dot AS (SELECT doc_id, line, number, name, sum(w * part) AS dot FROM lw JOIN part USING (term) GROUP BY ALL),
near AS (SELECT doc_id, number, name, round(dot / norm, 6) AS cosine FROM dot JOIN norm USING (doc_id, line) WHERE round(dot / norm, 6) >= 0.8),
best AS (SELECT doc_id, name, cosine FROM near QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, number) = 1),
found AS (SELECT d.doc_id, folder, file, name, cosine FROM d LEFT JOIN best USING (doc_id)),
given AS (SELECT folder AS directory, name AS up_name, cosine AS up_cosine FROM found WHERE file LIKE 'LICENSE%' AND name IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY folder ORDER BY cosine DESC, folder || '/' || file) = 1),
up AS (SELECT f.doc_id, g.* FROM found f JOIN given g ON f.name IS NULL AND (f.folder = g.directory OR starts_with(f.folder, g.directory || '/'))
       QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.directory) DESC) = 1)
SELECT doc_id, coalesce(name, up_name) AS license, coalesce(cosine, up_cosine) AS score,
       CASE WHEN name IS NOT NULL THEN 'own' WHEN up_name IS NOT NULL THEN 'inherited' END AS how,
       CASE WHEN name IS NULL THEN directory END AS directory
FROM found LEFT JOIN up USING (doc_id)
"""


OP9_SQL = _sql()
