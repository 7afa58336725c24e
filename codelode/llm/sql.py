"""DuckDB's SQL for the queries that SQL can express over whole tables."""

SQL: dict[str, str] = {}

SQL["p5_found"] = r"""
WITH c AS (
  SELECT chunk_no, model, text, indexed_at,
         CASE WHEN id LIKE 'file:%' THEN 'file' WHEN id LIKE 'fn:%' THEN 'function' ELSE lower(trim(kind)) END AS k
  FROM chunks WHERE chunk_no IS NOT NULL
), one AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY chunk_no ORDER BY indexed_at DESC NULLS LAST, text DESC) = 1
)
SELECT o.chunk_no,
       CASE WHEN list_max(list_transform(regexp_split_to_array(o.text, '\s+'), lambda x: length(x))) > l.max_chars
            THEN 'forced' ELSE 'natural' END AS cut
FROM one o JOIN chunk_limits l ON l.model = o.model AND l.kind = o.k
WHERE length(o.text) > l.max_chars
"""

SQL["p6_found"] = "SELECT doc_id FROM documents WHERE strlen(text) > 4096"

SQL["p7_found"] = """
WITH size AS (SELECT lower(trim(source)) AS source, sum(strlen(text)) AS n FROM documents GROUP BY 1),
t AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(s.n, 0) AS n FROM mix_targets m LEFT JOIN size s USING (source))
SELECT source FROM t WHERE max_repeats * n < target_share * (SELECT sum(n) FROM t)
"""
