"""Package-shaped tables derived from the plain ones; the SQL means the same in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS = {
    "fx_version": """SELECT l_partkey AS pkg,
       concat(CAST(l_suppkey % 3 AS STRING), '.', CAST(l_linenumber AS STRING), '.', CAST(CAST(l_quantity AS INT) % 10 AS STRING),
              CASE WHEN l_returnflag = 'R' THEN concat('-rc.', CAST(l_suppkey % 5 AS STRING)) ELSE '' END) AS version,
       MIN(l_tax) > 0.06 AS yanked, MIN(l_discount) > 0.08 AS deprecated, COUNT(*) AS files
FROM lineitem GROUP BY 1, 2""",
    "fx_dep": """SELECT p_partkey AS pkg, CAST(floor(p_partkey / q.d) AS BIGINT) AS dep,
       CASE p_partkey % 6 WHEN 0 THEN '^1.2.0' WHEN 1 THEN '~1.3' WHEN 2 THEN '>=0.2.0 <2.0.0'
                          WHEN 3 THEN '1.x' WHEN 4 THEN '1.1.0 - 2.4' ELSE '*' END AS spec,
       CASE WHEN p_partkey % 7 = 0 THEN 'optional' WHEN p_partkey % 11 = 0 THEN 'peer' ELSE 'runtime' END AS kind
FROM part CROSS JOIN (SELECT 2 AS d UNION ALL SELECT 3) q WHERE p_partkey >= q.d""",
    "fx_change": """SELECT event_id AS seq, concat('pkg-', CAST(user_id AS STRING)) AS name,
       concat(CAST(event_id % 3 AS STRING), '-', event_type) AS rev, event_type = 'error' AS deleted, ts FROM events""",
    "fx_state": """SELECT concat('g', CAST(o_custkey % 10 AS STRING), ':a', CAST(o_custkey AS STRING), ':1.', CAST(o_orderkey % 4 AS STRING)) AS coordinate,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'error' ELSE 'resume-skip' END AS state_status,
       o_orderkey AS pos, o_orderdate AS recorded_at FROM orders""",
    "fx_request": """SELECT c_custkey AS source_line,
       CASE WHEN c_custkey % 10 = 0 THEN '# comment' WHEN c_custkey % 10 = 1 THEN ''
            ELSE concat(CASE WHEN c_custkey % 3 = 0 THEN concat('@s', CAST(c_nationkey AS STRING), '/') ELSE '' END,
                        'pkg-', CAST(c_custkey % 97 AS STRING), CASE WHEN c_custkey % 13 = 0 THEN '@1.0.0' ELSE '' END) END AS line
FROM customer""",
    "fx_feature": """SELECT p_partkey AS pkg, concat('f', CAST(p_size % 5 AS STRING)) AS feature,
       CASE WHEN p_partkey % 4 = 0 THEN concat('dep:', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING))
            WHEN p_partkey % 4 = 1 THEN concat(CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING), '?/std') ELSE 'std' END AS member
FROM part""",
    "fx_vdep": """SELECT v.pkg, v.version, d.dep, d.spec, d.kind FROM fx_version v JOIN fx_dep d ON d.pkg = v.pkg
WHERE (CAST(substr(v.version, 1, 1) AS INT) + d.dep) % 3 <> 0""",
    "fx_tag": "SELECT pkg, 'latest' AS tag, max(version) AS version FROM fx_version GROUP BY pkg",
}

#: For oracles: fx_version with an integer that orders like the version (release candidates below the release).
ORDERED = """SELECT *, ((CAST(regexp_extract(version, '^(\\d+)\\.(\\d+)\\.(\\d+)', 1) AS BIGINT) * 100 + CAST(regexp_extract(version, '^(\\d+)\\.(\\d+)\\.(\\d+)', 2) AS BIGINT)) * 100
        + CAST(regexp_extract(version, '^(\\d+)\\.(\\d+)\\.(\\d+)', 3) AS BIGINT)) * 100 + CASE WHEN version LIKE '%-rc.%' THEN CAST(regexp_extract(version, '-rc\\.(\\d+)$', 1) AS BIGINT) ELSE 99 END AS ord,
       version LIKE '%-rc.%' AS pre FROM fx_version"""
#: For oracles: which releases (no prerelease fits) each spec of fx_dep allows.
SPECS = "SELECT * FROM (VALUES ('^1.2.0', 1020000, 2000000), ('~1.3', 1030000, 1040000), ('>=0.2.0 <2.0.0', 20000, 2000000), ('1.x', 1000000, 2000000), ('1.1.0 - 2.4', 1010000, 2050000), ('*', 0, 99000000)) s(spec, lo, hi)"


def _needs(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def oracle(sql: str, recursive: bool = False) -> str:
    """SQL with the views it needs as leading expressions."""
    known = {**VIEWS, "ver": ORDERED, "specs": SPECS}
    wanted: list[str] = []

    def add(text: str) -> None:
        for name in _needs(text, known):
            if name not in wanted and text is not known[name]:
                add(known[name])
                if name not in wanted:
                    wanted.append(name)

    add(sql)
    views = [f"{n} AS ({known[n].replace('STRING', 'VARCHAR')})" for n in wanted]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if sql.lstrip().upper().startswith("WITH "):
        body = sql.lstrip()[5:]
        body = body[10:] if body.upper().startswith("RECURSIVE ") else body
        return head + ", ".join([*views, body])
    return (head + ", ".join(views) + "\n" if views else "") + sql


#: Rows of lineitem in one piece of `Fixtures.dealt`.
PIECE_ROWS = 1 << 18


class Fixtures:
    """Tables and views of one folder as DataFrames, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str, pieces: bool = False):
        self.spark, self.sf_dir, self.pieces = spark, sf_dir, pieces

    def dealt(self) -> Fixtures:
        """The same tables, lineitem in pieces of about `PIECE_ROWS` rows by part: tasks that group or sort its parts are no larger where it is."""
        return Fixtures(self.spark, self.sf_dir, True)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            sql = VIEWS[name]
            names = _needs(sql, (*TABLES, *(v for v in VIEWS if v != name)))
            for n in names:
                sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
            return self.spark.sql(sql, **{n: getattr(self, n) for n in names})
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if self.pieces and name == "lineitem":
                n = -(-table.count() // PIECE_ROWS)  # from the files' footers
                return table.repartition(n, "l_partkey") if n > self.spark.sparkContext.defaultParallelism else table
            return table
        raise AttributeError(name)
