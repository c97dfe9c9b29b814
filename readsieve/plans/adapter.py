"""Alignments and a mapping made from star-schema tables: reads are orders, references are parts.

The same SQL text is used by Spark and by the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ALIGNMENTS_SQL = """
WITH raw AS (
  SELECT l_orderkey, l_partkey, l_linenumber AS ln, p_size,
         CAST(100 + p_size*10 AS INT) AS slen,
         CAST(20 + (CAST(l_quantity AS INT) % 10)*3 AS INT) AS aln,
         CAST(90 + CAST(round(l_discount*100) AS INT) % 3 AS DOUBLE) AS pid,
         CASE WHEN l_tax >= 0.07 THEN 1e-3 ELSE 1e-12 END AS ev
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT concat('r', CAST(l_orderkey AS STRING)) AS queryId,
       concat('p', CAST(l_partkey AS STRING)) AS subjectId,
       pid AS percIdentity, aln AS alnLength, CAST(ln % 3 AS INT) AS mismatchCount, 0 AS gapOpenCount,
       1 AS queryStart, aln*3 AS queryEnd,
       CAST(1 + (ln*37*p_size) % (slen-aln) AS INT) AS subjectStart,
       CAST((ln*37*p_size) % (slen-aln) + aln AS INT) AS subjectEnd,
       CAST(ev AS DOUBLE) AS eVal, CAST(40 + aln*CAST(0.75 AS DOUBLE) AS DOUBLE) AS bitScore, CAST(90 + ln*5 AS INT) AS qlen, slen
FROM raw"""

MAPPING_SQL = """
SELECT concat('p', CAST(p_partkey AS STRING)) AS reference, concat('ko:', p_brand) AS grp FROM part
UNION ALL
SELECT concat('p', CAST(p_partkey AS STRING)), concat('ko:S', CAST(p_size % 5 AS STRING))
FROM part WHERE p_partkey % 2 = 0"""


def _over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "part")}
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(sql, **tables)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, ALIGNMENTS_SQL)


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, MAPPING_SQL)
