"""Domain views derived from the generic test tables.

The definitions are plain SQL that Spark and DuckDB both accept, so a query and its check read the same
rows: Spark registers them as temporary views, DuckDB gets them as a chain of CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "fx_hit_raw": "SELECT l_orderkey AS shot_id, CAST(l_partkey % 24 AS INT) AS det FROM lineitem",
    "fx_hits": "SELECT shot_id, det FROM fx_hit_raw GROUP BY shot_id, det HAVING COUNT(*) % 2 = 1",
    "fx_shots": """
        SELECT o_orderkey AS shot_id,
               CAST((CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) + (CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 0 END) AS INT) AS obs_mask,
               CAST((CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) + (CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 0 END) AS INT) AS pred_mask
        FROM orders""",
    "fx_meas": """
        SELECT l_orderkey AS shot_id, CAST(l_suppkey % 32 AS INT) AS meas
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1""",
    "fx_det_def": """
        SELECT CAST(p_partkey % 24 AS INT) AS det, CAST(p_size % 32 AS INT) AS meas
        FROM part GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1""",
    "fx_det": """
        SELECT DISTINCT CAST(p_partkey % 24 AS INT) AS det, CAST((p_partkey % 24) % 4 AS INT) AS base_det,
               CAST(FLOOR((p_partkey % 24) / 4) AS INT) AS round_id,
               CASE WHEN p_partkey % 24 >= 20 THEN 1 ELSE 0 END AS post_flag
        FROM part""",
    "fx_err": """
        SELECT event_id AS err_id, ROUND(0.001 + 0.0008 * value, 6) AS p, CAST(user_id % 24 AS INT) AS d1,
               CASE WHEN (event_id * 7 + 3) % 25 = 24 THEN NULL ELSE CAST((event_id * 7 + 3) % 25 AS INT) END AS d2,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS obs_mask
        FROM events""",
    "fx_edge": """
        SELECT LEAST(d1, COALESCE(d2, 24)) AS u, GREATEST(d1, COALESCE(d2, 24)) AS v,
               CAST(ROUND(1000 * LN((1 - MIN(p)) / MIN(p))) AS BIGINT) AS w, MIN_BY(obs_mask, err_id) AS obs_mask
        FROM fx_err WHERE d2 IS NULL OR d1 <> d2 GROUP BY 1, 2""",
    # Four islands of six nodes with short links; only the first two have a boundary edge (NULL v).
    "fx_local": """
        SELECT u, CASE WHEN v < 24 THEN v END AS v, w, obs_mask FROM fx_edge
        WHERE (v < 24 AND FLOOR(u / 6) = FLOOR(v / 6) AND v - u <= 2) OR (v = 24 AND u IN (0, 6))""",
    "fx_stats": """
        SELECT event_id AS seq, CONCAT(event_type, '-', user_id) AS strong_id, event_type AS decoder, user_id % 8 AS d,
               CAST(100 + event_id % 900 AS BIGINT) AS shots, CAST(FLOOR(value) AS BIGINT) % 50 AS errors,
               event_id % 7 AS discards, value AS seconds
        FROM events""",
    "fx_instr": """
        SELECT conv_id AS circuit_id, turn AS seq,
               CASE WHEN role = 'user' THEN 'M' WHEN role = 'assistant' THEN 'DETECTOR' ELSE 'SHIFT_COORDS' END AS op,
               CAST(1 + LENGTH(text) % 5 AS INT) AS n
        FROM conversations""",
    # Mechanism targets with two components for even first detectors.
    "fx_tgt": """
        SELECT err_id, 0 AS comp, 'D' AS kind, d1 AS idx FROM fx_err
        UNION ALL SELECT err_id, 0, 'D', d2 FROM fx_err WHERE d2 IS NOT NULL
        UNION ALL SELECT err_id, 0, 'L', 0 FROM fx_err WHERE obs_mask = 1
        UNION ALL SELECT err_id, 1, 'D', CAST((d1 + 7) % 24 AS INT) FROM fx_err WHERE d1 % 2 = 0
        UNION ALL SELECT err_id, 1, 'D', CAST((d1 + 12) % 24 AS INT) FROM fx_err WHERE d1 % 2 = 0""",
    # Task statistics with metadata and per-name counts.
    "fx_rich": """
        SELECT seq, strong_id, decoder, shots, errors, discards, seconds,
               CONCAT('{"d":', CAST(d AS STRING), ',"c":"', decoder, '"}') AS json_metadata,
               CASE WHEN seq % 3 = 0 THEN '' ELSE CONCAT('{"x":', CAST(errors AS STRING), ',"y":', CAST(seq % 4 AS STRING), '}') END AS counts_json
        FROM fx_stats""",
    # Error-model text, one file per user; @-marks are filled from the event.
    "fx_model_line": """
        SELECT e.user_id AS model_id, e.event_id * 8 + t.sub AS seq,
               REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(t.body, '@p', LPAD(CAST(1 + e.event_id % 400 AS STRING), 4, '0')),
                 '@a', CAST(e.user_id % 24 AS STRING)), '@b', CAST(e.event_id % 24 AS STRING)),
                 '@c', CAST((e.event_id + 5) % 24 AS STRING)), '@o', CAST(e.event_id % 2 AS STRING)),
                 '@s', CAST(1 + e.event_id % 3 AS STRING)) AS line
        FROM events e JOIN (VALUES
          ('view', 0, 'error[src=view](0.@p) D@a D@b L@o'),
          ('click', 0, 'ERROR(0.@p) D@a D@b ^ D@c L@o # two parts'),
          ('purchase', 0, 'detector(1.5, @b) D@a'),
          ('signup', 0, 'repeat @s {'),
          ('signup', 1, '    error(0.@p) D@a D@b'),
          ('signup', 2, '    shift_detectors(0, 2) @s'),
          ('signup', 3, '}'),
          ('error', 0, 'logical_observable L@o'),
          ('error', 1, 'shift_detectors(1) @s')
        ) t(kind, sub, body) ON t.kind = e.event_type""",
    # Circuit text, one file per conversation.
    "fx_circuit_line": """
        SELECT c.conv_id AS circuit_id, c.turn * 8 + t.sub AS seq,
               REPLACE(REPLACE(REPLACE(t.body, '@a', CAST(LENGTH(c.text) % 9 AS STRING)), '@b', CAST(c.turn AS STRING)),
                 '@r', CAST(2 + LENGTH(c.text) % 4 AS STRING)) AS line
        FROM conversations c JOIN (VALUES
          ('system', 0, 'QUBIT_COORDS(1, @b) @a'), ('system', 1, 'R 0 1 @a'), ('system', 2, 'SHIFT_COORDS(0, 1)'),
          ('user', 0, 'X_ERROR(0.01) @a'), ('user', 1, 'M[first](0.02) 0 @a'), ('user', 2, 'TICK'),
          ('user', 3, 'MPP X0*X1 Z2'), ('user', 4, 'CX sweep[@a] 1'), ('user', 5, 'qubit_coords(2, @b) @a'),
          ('assistant', 0, 'REPEAT @r {'), ('assistant', 1, '    MR @a 10 # reset too'), ('assistant', 2, '    DETECTOR(@b, 0) rec[-1] rec[-2]'),
          ('assistant', 3, '    SHIFT_COORDS(1)'), ('assistant', 4, '}'), ('assistant', 5, 'OBSERVABLE_INCLUDE(@b) rec[-1]')
        ) t(kind, sub, body) ON t.kind = c.role""",
}


def cte_prefix(sql: str) -> str:
    """Put the definitions a check needs in front of it, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+\b", text):
            if name in VIEWS and name not in needed:
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    body = sql.strip()
    if not parts:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{parts}, {body[len(head):]}"
    return f"WITH {parts} {body}"


class Fixtures:
    """The tables of one data folder and the views over them, registered when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: set[str] = set()

    def _ensure(self, name: str) -> None:
        if name in self._known:
            return
        self._known.add(name)
        if name in TABLES:
            self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        else:
            self.spark_sql(VIEWS[name]).createOrReplaceTempView(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES or name in VIEWS:
            self._ensure(name)
            return self.spark.table(name)
        raise AttributeError(name)

    def spark_sql(self, text: str) -> DataFrame:
        for word in set(re.findall(r"\b\w+\b", text)):
            if word in TABLES or word in VIEWS:
                self._ensure(word)
        return self.spark.sql(text)
