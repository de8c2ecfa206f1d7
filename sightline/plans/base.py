"""How the operators' concepts are bound to the standard tables, and the register of queries.

A binding is SQL that Spark and DuckDB both read; {name} stands for a table.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BINDINGS = {
    "boxes": """SELECT l_orderkey AS frame, l_linenumber AS det, l_partkey AS part, l_suppkey AS supp,
        (l_partkey % 160) * 4e0 - 8 AS x1, (l_suppkey % 90) * 4e0 - 3 AS y1,
        (l_partkey % 160) * 4e0 - 8 + l_quantity * 3 AS x2, (l_suppkey % 90) * 4e0 - 3 + (l_linenumber * 17 % 60) + 5e0 AS y2,
        l_quantity * 3 AS bw, (l_linenumber * 17 % 60) + 5e0 AS bh,
        l_discount * 10 AS score, l_returnflag AS label, 640 AS w, 360 AS h, l_quantity AS quantity, l_extendedprice AS price FROM {lineitem}""",
    "vectors": "SELECT vec_id, embedding, concat('b', CAST(label AS STRING)) AS brand FROM {embeddings}",
    "detections": """SELECT event_id AS id, user_id % 50 AS video, CAST(floor(value * 10) AS INT) AS frame, event_id AS tie, value AS time,
        CASE WHEN event_type = 'error' THEN 'UNKNOWN' ELSE event_type END AS brand,
        CASE user_id % 4 WHEN 0 THEN 'database' WHEN 1 THEN 'Top_2k_Brands' WHEN 2 THEN 'audio' ELSE 'other' END AS source, event_type, user_id, value, props FROM {events}""",
    "series": "SELECT o_custkey % 20 AS video, o_orderkey AS frame, o_totalprice AS ratio FROM {orders}",
    "reviews": """SELECT doc_id AS det_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'TP' WHEN quality = 0 AND toxic = 0 THEN 'FP' WHEN quality = 0 THEN 'FN' ELSE 'wrong_brand' END AS label,
        CASE doc_id % 5 WHEN 0 THEN 'partial_logo' WHEN 1 THEN 'not_logo' WHEN 2 THEN NULL ELSE 'logo' END AS is_logo,
        CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id * 13 % 101 AS INT) END AS confidence,
        CASE WHEN doc_id % 6 = 0 THEN 'UNKNOWN' ELSE concat('brand ', CAST(doc_id % 9 AS STRING)) END AS brand, doc_id % 4 = 0 AS is_truncated FROM {labels}""",
    "known": """SELECT concat('crops/', CAST(c_custkey AS STRING), '.png') AS filepath, concat('brand ', CAST(c_custkey % 40 AS STRING)) AS brand,
        CASE c_custkey % 11 WHEN 0 THEN 'typo_correction' WHEN 1 THEN 'Wrong_Logo' WHEN 2 THEN ' FP ' WHEN 3 THEN 'confirmed' WHEN 4 THEN 'bogus' ELSE NULL END AS correction,
        CASE c_custkey % 5 WHEN 0 THEN 'database' WHEN 1 THEN 'top2k' WHEN 2 THEN 'audio' WHEN 3 THEN 'elsewhere' ELSE NULL END AS source,
        CASE c_custkey % 3 WHEN 0 THEN 'Correct' WHEN 1 THEN 'Incorrect' ELSE NULL END AS verdict, c_mktsegment AS family FROM {customer}""",
    "confirmed": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN ' ' ELSE concat('brand ', CAST(s_suppkey % 60 AS STRING)) END AS brand FROM {supplier}",
    "answers": """SELECT conv_id * 1000 + turn AS det_id, conv_id, turn, role, text,
        concat('Sure, here it is: {{"is_logo": "', CASE turn % 3 WHEN 0 THEN 'logo' WHEN 1 THEN 'not_logo' ELSE 'partial_logo' END, '", "brand": "', role, '", "confidence": "', CAST(conv_id * 37 % 140 AS STRING), CASE WHEN conv_id % 4 = 0 THEN '.7' ELSE '' END, '"', CASE WHEN conv_id % 9 = 0 THEN '' ELSE '}}' END, ' done') AS raw FROM {conversations}""",
    "names": "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price FROM {part}",
    "logits": "SELECT l_orderkey AS image, concat('p', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS prompt, CASE WHEN l_suppkey % 2 = 0 THEN 'POS' ELSE 'NEG' END AS category, l_quantity / 5e0 AS logit FROM {lineitem}",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A standard table or a binding."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return sql(spark, sf_dir, BINDINGS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over standard tables; [name] stands for a binding, as in `duck`."""
    text = re.sub(r"\[(\w+)\]", lambda m: f"({BINDINGS[m[1]]})" if m[1] in BINDINGS else m[0], text)
    used = {n: table(spark, sf_dir, n) for n in re.findall(r"(?<!\{)\{(\w+)\}", text)}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    """The same for DuckDB: [name] stands for a binding."""
    text = re.sub(r"\[(\w+)\]", lambda m: f"({BINDINGS[m[1]]})" if m[1] in BINDINGS else m[0], text)
    return re.sub(r"(?<!\{)\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}").replace("AS STRING)", "AS VARCHAR)")


def query(text: str | None = None):
    """Register a query under its function's name, with SQL where that can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = duck(text)
        return f

    return add


def shared_folder(spark) -> str:
    """A new folder in the cluster's shared folder, or on one machine in a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    base = base or "file://" + tempfile.gettempdir()
    return os.path.join(base, f"sightline-io-{uuid.uuid4().hex}")
