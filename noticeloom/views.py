"""Views that make the given tables look like recall records; one text for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_general": """
SELECT doc_id AS RecallID, concat('RN-', cast(cast(floor(doc_id * 0.8) AS bigint) AS string)) AS RecallNumber,
       concat('doc-', cast(doc_id AS string)) AS slug, substr(split_part(text, chr(10), 1), 1, 80) AS Title,
       text AS Description, source AS brand, lang AS productType, source AS categoryKey,
       date '2023-12-07' + cast(doc_id % 840 AS int) AS RecallDate, cast(n_chars % 12 AS int) AS n_langs
FROM {documents}""",
    "v_fda": """
SELECT o_orderkey, concat('order-', cast(o_orderkey AS string)) AS slug,
       replace(substr(cast(o_orderdate AS string), 1, 10), '-', '') AS report_date,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'drugs' WHEN '2' THEN 'food' WHEN '3' THEN 'medical-devices'
            WHEN '4' THEN 'supplements' ELSE NULL END AS browseCategory,
       c_mktsegment AS brandName, concat(c_name, ' ', o_orderpriority) AS title, o_orderstatus AS terminatedRecall
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "v_stored": "SELECT * FROM {v_fda} WHERE o_orderkey % 3 = 0",
    "v_category_rows": """
SELECT concat('RN-', cast(l_orderkey AS string)) AS RecallNumber, l_returnflag AS categoryKey,
       l_shipdate AS last_modified, cast(l_quantity AS int) % 12 AS n_langs,
       concat('p-', cast(l_partkey AS string), '-', cast(l_linenumber AS string)) AS slug, l_linenumber AS pos
FROM {lineitem}""",
    "v_products": "SELECT p_partkey, p_name AS productDescription, p_brand AS brandName, p_type AS productType FROM {part}",
    "v_campaigns": """
SELECT concat(cast(20 + p_size % 6 AS string), 'V', lpad(cast(p_partkey AS string), 6, '0')) AS campaignNumber,
       upper(p_brand) AS make, upper(p_type) AS model, 2000 + p_size % 25 AS year,
       p_name AS summary, concat('Replace ', p_name) AS remedy, concat(p_type, ':', p_brand) AS component
FROM {part}""",
    "v_hits": "SELECT event_id, concat(event_type, ':', cast(user_id AS string)) AS hit_key, ts FROM {events}",
}
NEEDS = {name: re.findall(r"\{(\w+)\}", text) for name, text in VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one of the views above it."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in NEEDS[name]})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions before it."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name in VIEWS and name not in wanted:
            wanted.append(name)

    for name in re.findall(r"\bv_\w+", sql):
        add(name)
    if not wanted:
        return sql
    texts = ",\n".join(f"{n} AS ({VIEWS[n].format_map({x: x for x in NEEDS[n]})})" for n in wanted)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    rest = re.sub(r"(?i)^WITH (RECURSIVE )?", ",\n", body, count=1) if re.match(r"(?i)WITH ", body) else "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{texts}{rest}"
