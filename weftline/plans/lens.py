"""Domain rows derived from the driver's tables, by the same integer expressions in Spark and in SQL.

Every row of lineitem is one alignment record of the read that is its order; parts are genes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ALN = """
SELECT cast(l_orderkey AS bigint) AS read_id, cast(rn AS bigint) AS rn, cast(qty AS bigint) AS qty, cast(gid AS bigint) AS gid,
  gene, chrom, sign, cast(read_start AS bigint) AS read_start, cast(read_end AS bigint) AS read_end, cast(mapq AS bigint) AS mapq,
  cast(exon AS bigint) AS exon, cast(60 + qty AS bigint) AS block_len, cast((gid + 1) * 100000 + 1000 * exon + qty AS bigint) AS bp,
  cast(seg_start AS bigint) AS seg_start, cast(seg_start + 400 AS bigint) AS seg_end,
  concat(chrom, ':', gene, ':', cast(seg_start AS string), '-', cast(seg_start + 400 AS string)) AS item,
  cast(l_orderkey * 100 + rn AS bigint) AS ord
FROM (
  SELECT *, concat('GENE', chr(cast(65 + gid AS int))) AS gene, concat('chr', cast(gid % 3 + 1 AS string)) AS chrom,
    (rn - 1) * 100 + qty % 7 AS read_start, (rn - 1) * 100 + 60 + qty AS read_end, (gid + 1) * 100000 + 1000 * exon AS seg_start
  FROM (
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn,
      cast(l_quantity AS bigint) AS qty, l_partkey % 12 AS gid, CASE WHEN l_returnflag = 'A' THEN '<' ELSE '>' END AS sign,
      cast(round(l_discount * 600) AS bigint) AS mapq, l_suppkey % 4 AS exon
    FROM lineitem
  ) x
) y
"""
GENES = """
SELECT cast(gid AS bigint) AS gid, concat('GENE', chr(cast(65 + gid AS int))) AS gene, concat('chr', cast(gid % 3 + 1 AS string)) AS chrom,
  CASE WHEN gid % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN gid % 5 = 4 THEN 'lncRNA' ELSE 'protein_coding' END AS type,
  cast(100000 * (gid + 1) AS bigint) AS start_pos, cast(100000 * (gid + 1) + 8000 AS bigint) AS end_pos
FROM (SELECT DISTINCT p_partkey % 12 AS gid FROM part) g
"""


def oracle(body: str) -> str:
    """A DuckDB query over the lens."""
    aln, genes = (x.replace("AS string)", "AS varchar)") for x in (ALN, GENES))
    return f"WITH aln AS ({aln}), genes AS ({genes}) {body}"


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    aln = spark.sql(ALN.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    genes = spark.sql(GENES.replace("FROM part)", "FROM {part})"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return aln, genes
