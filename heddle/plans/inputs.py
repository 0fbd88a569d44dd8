"""Inputs of the registered queries: SQL that Spark and the reference engine both read, over the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> SELECT; tables stand in braces. An experiment of the channel map has three parts; a key has four digits, so those beyond have another name.
INPUTS = {
    "vectors": "SELECT vec_id, label, embedding, label = 0 AS is_control FROM {embeddings}",
    "experiments": "SELECT DISTINCT concat('ops', lpad(cast(o_orderkey % 400 AS varchar(10)), 4, '0'), CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('_', cast(20230000 + (o_orderkey % 400) * 29 % 9999 AS varchar(10))) END, CASE WHEN o_orderkey % 11 = 0 THEN '_redo' ELSE '' END) AS name FROM {orders}",
    "exclusions": "SELECT 'bad' AS category, concat('ops', lpad(cast(p_partkey % 400 AS varchar(10)), 4, '0')) AS name, cast(NULL AS int) AS number FROM {part} WHERE p_partkey % 97 = 0 UNION ALL SELECT 'old', NULL, cast(p_partkey % 400 AS int) FROM {part} WHERE p_partkey % 89 = 0 UNION ALL SELECT 'other', NULL, cast(p_partkey % 400 AS int) FROM {part} WHERE p_partkey % 13 = 0",
    "labels_text": "SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'Phase' WHEN 1 THEN 'no label' WHEN 2 THEN concat(p_type, '/', p_name, ', ', p_brand) WHEN 3 THEN concat(p_type, ', ', p_name, ', ', p_brand) WHEN 4 THEN p_brand WHEN 5 THEN concat(', ', p_name) WHEN 6 THEN concat(p_type, ',', p_name, ' live dye') WHEN 7 THEN cast(NULL AS varchar(10)) ELSE concat('a\\\\b ', p_name) END AS label, CASE p_partkey % 5 WHEN 0 THEN 'GFP' WHEN 1 THEN 'Phase2D' WHEN 2 THEN 'm-Cherry' WHEN 3 THEN concat('CP1_', p_type, '_', p_brand) ELSE concat('4i_R1_', p_brand) END AS channel FROM {part}",
    "channel_map": "SELECT CASE WHEN p_partkey < 30000 THEN concat('ops', lpad(cast(cast(floor(p_partkey / 150) AS int) * 50 + p_partkey % 50 AS varchar(10)), 4, '0')) ELSE concat('lot', cast(cast(floor(p_partkey / 150) AS int) * 50 + p_partkey % 50 AS varchar(10))) END AS experiment, cast(p_partkey AS int) AS pos, CASE WHEN p_partkey % 10 = 9 THEN cast(NULL AS varchar(10)) WHEN p_partkey % 3 = 0 THEN 'BF' WHEN p_partkey % 3 = 1 THEN 'GFP' ELSE 'Cy 5' END AS channel_name, CASE WHEN p_partkey % 3 = 0 THEN 'Phase' WHEN p_partkey % 3 = 1 THEN concat(p_type, ', ', p_name) ELSE concat(p_brand, ', ', p_type) END AS label FROM {part}",
    "features": "SELECT DISTINCT concat('ops', lpad(cast(l_orderkey % 55 AS varchar(10)), 4, '0'), '_20240101') AS experiment, CASE l_linenumber % 6 WHEN 0 THEN 'single_object_Phase2D_cell_Area' WHEN 1 THEN 'single_object_GFP_nucleus_Mean' WHEN 2 THEN 'coloc_GFP_Cy_5_cell_Corr' WHEN 3 THEN 'label_str' WHEN 4 THEN 'coloc_BF_Phase3D_x' ELSE 'single_object_RFP_cell_Area' END AS feature FROM {lineitem}",
    "genes": "SELECT p_partkey AS gene, p_name AS name, lower(concat(p_name, ' ', p_type, ' ', p_brand)) AS text FROM {part}",
    "members": "SELECT concat('s', cast(l_suppkey AS varchar(10))) AS set_id, l_partkey % 40 AS member, min(l_orderkey) AS ordinal FROM {lineitem} GROUP BY 1, 2",
    "p_values": "SELECT p_partkey AS id, p_brand AS brand, p_retailprice / 2000.0 AS score, cast(p_partkey * 7919 % 1000 + 1 AS double) / 1001 AS p FROM {part}",
    "wide": "SELECT l_partkey AS part, p_brand AS brand, avg(l_quantity) AS quantity, avg(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax, 1.0 AS constant FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_partkey, p_brand",
    "quality": "SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "controls": "SELECT c_custkey, CASE WHEN c_custkey % 31 = 0 THEN -1 ELSE c_nationkey END AS gene_id, CASE WHEN c_custkey % 37 = 0 THEN -1 ELSE c_nationkey END AS ncbi_id, CASE c_custkey % 41 WHEN 0 THEN cast(NULL AS varchar(10)) WHEN 1 THEN ' ' WHEN 2 THEN 'None' WHEN 3 THEN 'Non-Targeting 4' WHEN 4 THEN 'xNTC1' WHEN 5 THEN '0' ELSE c_mktsegment END AS gene_name FROM {customer}",
    "durations": "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN concat(cast(o_orderkey % 3 AS varchar(10)), '-', lpad(cast(o_orderkey % 24 AS varchar(10)), 2, '0'), ':10:05') WHEN 1 THEN concat('01:', lpad(cast(o_orderkey % 60 AS varchar(10)), 2, '0'), ':45') WHEN 2 THEN concat(lpad(cast(o_orderkey % 60 AS varchar(10)), 2, '0'), ':30.5') WHEN 3 THEN 'junk' WHEN 4 THEN '' WHEN 5 THEN cast(NULL AS varchar(10)) ELSE 'N/A' END AS duration, CASE o_orderkey % 8 WHEN 0 THEN concat(cast(o_orderkey AS varchar(10)), 'K') WHEN 1 THEN concat(cast(o_orderkey AS varchar(10)), '.5M') WHEN 2 THEN concat(cast(o_orderkey AS varchar(10)), 'G') WHEN 3 THEN '2T' WHEN 4 THEN cast(o_orderkey AS varchar(10)) WHEN 5 THEN 'xK' WHEN 6 THEN '' ELSE cast(NULL AS varchar(10)) END AS size FROM {orders}",
    "boxes": "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN concat('(', cast(o_orderkey % 900 AS varchar(10)), ', ', cast(o_custkey % 900 AS varchar(10)), ', ', cast(o_orderkey % 900 + 21 AS varchar(10)), ', ', cast(o_custkey % 900 + 30 AS varchar(10)), ')') WHEN 1 THEN concat('[', cast(o_orderkey % 900 AS varchar(10)), ' ', cast(o_custkey % 900 AS varchar(10)), ' ', cast(o_orderkey % 900 + 200 AS varchar(10)), ' ', cast(o_custkey % 900 + 9 AS varchar(10)), ']') WHEN 2 THEN '(1, 2, 3)' WHEN 3 THEN cast(NULL AS varchar(10)) ELSE 'none' END AS bbox FROM {orders}",
    "pixels": "SELECT o_orderkey % 20 AS tile, cast(l_orderkey * 7 % 64 AS int) AS y, cast(l_partkey * 13 % 64 AS int) AS x, cast(floor((l_orderkey * 7 % 64) / 16) AS int) * 4 + cast(floor((l_partkey * 13 % 64) / 16) AS int) AS label FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "positions": "SELECT concat(CASE WHEN c_nationkey % 2 = 0 THEN 'A' ELSE 'B' END, '/', cast(c_nationkey % 6 + 1 AS varchar(10))) AS well, c_custkey AS ord, concat('pos', cast(c_custkey AS varchar(10))) AS position FROM {customer}",
    "job_records": "SELECT concat(cast(l_orderkey AS varchar(10)), CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '.batch' WHEN 3 THEN '.0' ELSE '.extern' END) AS job_id, max(CASE WHEN l_quantity < 10 THEN ' ' ELSE concat(cast(cast(l_quantity AS int) AS varchar(10)), 'M') END) AS max_rss, max(concat('00:', lpad(cast(l_suppkey % 60 AS varchar(10)), 2, '0'), ':00')) AS elapsed FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "calls": "SELECT concat('step', cast(user_id AS varchar(10)), '_', cast(event_id AS varchar(10))) AS log_key, concat(cast(value AS varchar(30)), ' seconds') AS duration, event_type AS hostname, event_id AS ord FROM {events}",
    "curves": "SELECT p_brand AS series, cast(p_size AS double) + cast(p_partkey % 2 AS double) * 1e-11 AS x, avg(p_retailprice) AS y FROM {part} GROUP BY 1, 2",
    "docs_steps": "SELECT concat('ops', lpad(cast(o_custkey % 300 AS varchar(10)), 4, '0'), '_20240101') AS experiment, concat('f', cast(o_orderkey AS varchar(10))) AS path FROM {orders}",
    "files": "SELECT concat('f', cast(l_orderkey AS varchar(10))) AS path FROM {lineitem} WHERE l_linenumber = 1 AND l_orderkey % 3 > 0",
}


def tables(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = INPUTS[name]
    return spark.sql(text, **tables(spark, sf_dir, text))


def cte(*names: str) -> str:
    """The inputs as common table expressions of the reference SQL."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', INPUTS[n])})".replace("\\\\", "\\") for n in names) + " "
