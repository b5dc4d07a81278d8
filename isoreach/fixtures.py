"""Accessibility-shaped views over the general purpose test tables.

Each view is one SQL text that Spark and DuckDB both run, with base tables in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "f_ttm": """
        SELECT CASE l_returnflag WHEN 'A' THEN 'bicycle' WHEN 'N' THEN 'pt' ELSE 'walk' END AS mode,
               CASE WHEN l_returnflag = 'N' THEN CASE l_linestatus WHEN 'F' THEN 'am' ELSE 'pm' END END AS time_of_day,
               l_suppkey AS from_id, l_partkey AS to_id,
               MIN(CAST(l_quantity * 3 AS INT)) AS travel_time
        FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "f_poi": """
        SELECT o_orderkey AS source_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'hospitals' WHEN '2-HIGH' THEN 'gp_practices'
                    WHEN '3-MEDIUM' THEN 'pharmacies' WHEN '4-NOT SPECIFIED' THEN 'primary_schools'
                    ELSE 'supermarkets' END AS service,
               CASE WHEN o_orderkey % 41 = 0 THEN NULL
                    ELSE (o_orderkey * 7919) % (SELECT COUNT(*) FROM {part}) END AS zone_id
        FROM {orders}""",
    "f_zone": """
        SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS employment_all,
               CAST(CASE WHEN p_type = 'PROMO' THEN p_size ELSE 0 END AS BIGINT) AS employment_promo_1,
               CAST(CASE WHEN p_type = 'STANDARD' THEN p_size ELSE 0 END AS BIGINT) AS employment_standard_2,
               CAST(CASE WHEN p_type = 'ECONOMY' THEN p_size ELSE 0 END AS BIGINT) AS employment_economy_3,
               CASE WHEN p_type = 'PROMO' THEN p_size * CAST(0.25 AS DOUBLE) END AS park_ha,
               CASE WHEN p_type = 'PROMO' THEN CAST(p_size % 3 AS BIGINT) END AS park_accesspoints,
               CASE WHEN p_partkey % 997 = 0 THEN CAST(1 AS BIGINT) END AS main_bua
        FROM {part}""",
    "f_landuse": """
        SELECT z.id, z.employment_all, z.employment_promo_1, z.employment_standard_2, z.employment_economy_3,
               COALESCE(n.hospitals, 0) AS hospitals, COALESCE(n.gp_practices, 0) AS gp_practices,
               COALESCE(z.main_bua, 0) AS main_bua, COALESCE(z.park_ha, 0) AS park_ha,
               COALESCE(z.park_accesspoints, 0) AS park_accesspoints
        FROM f_zone z
        LEFT JOIN (SELECT zone_id, COUNT(CASE WHEN service = 'hospitals' THEN 1 END) AS hospitals,
                          COUNT(CASE WHEN service = 'gp_practices' THEN 1 END) AS gp_practices
                   FROM f_poi GROUP BY zone_id) n ON n.zone_id = z.id""",
    "f_postcode": """
        SELECT CONCAT('PC', CAST(c_custkey AS STRING)) AS pcds,
               CONCAT(CASE c_nationkey % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'S' ELSE 'W' END,
                      LPAD(CAST(c_nationkey AS STRING), 8, '0')) AS lsoa11,
               CASE WHEN c_acctbal < 0 THEN '202101' END AS doterm,
               CAST(50 AS DOUBLE) + CAST(c_custkey % 640 AS DOUBLE) / 64 AS lat,
               CAST(-6 AS DOUBLE) + CAST(c_custkey % 512 AS DOUBLE) / 64 AS long
        FROM {customer}""",
    "f_practice": """
        SELECT o_orderkey AS practice_code, o_orderstatus AS status,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderpriority END AS name,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL
                    ELSE CONCAT('PC', CAST(o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END
                                           AS STRING)) END AS postcode
        FROM {orders}""",
    "f_named": """
        SELECT p_partkey AS id,
               CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 37 = 0 THEN '' ELSE p_name END AS name,
               CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_brand END AS brand, p_type AS sub_type
        FROM {part}""",
    "f_school": """
        SELECT p_partkey AS urn,
               CASE p_type WHEN 'PROMO' THEN 'Primary' WHEN 'STANDARD' THEN 'Secondary' WHEN 'ECONOMY' THEN 'All-through'
                    WHEN 'MEDIUM' THEN 'Middle deemed secondary' WHEN 'SMALL' THEN NULL ELSE '---' END AS phase,
               CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size % 20 END AS low_age,
               p_size % 20 + CAST(p_partkey % 8 AS INT) AS high_age,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CONCAT('  ', p_name, '  x ') END AS street,
               p_brand AS town
        FROM {part}""",
    "f_zonepoly": """
        SELECT n_nationkey AS zone_id,
               CAST(n_nationkey % 5 AS DOUBLE) * 100000 AS xa, CAST(FLOOR(n_nationkey / 5) AS DOUBLE) * 100000 AS ya,
               CAST(n_nationkey % 5 AS DOUBLE) * 100000 + 100000 AS xb,
               CAST(FLOOR(n_nationkey / 5) AS DOUBLE) * 100000 + 100000 AS yb
        FROM {nation}""",
    "f_point": """
        SELECT c_custkey AS id, CAST((c_custkey * 7919) % 52 AS DOUBLE) * 10000 AS x,
               CAST((c_custkey * 104729) % 52 AS DOUBLE) * 10000 AS y
        FROM {customer}""",
    "f_site": """
        SELECT id, function_, xc - side / 2 AS xa, yc - side / 2 AS ya, xc + side / 2 AS xb, yc + side / 2 AS yb
        FROM (SELECT p_partkey AS id,
                     CASE WHEN p_type = 'PROMO' THEN 'Public Park Or Garden' ELSE 'Other' END AS function_,
                     CAST((p_partkey * 15485863) % 500 AS DOUBLE) * 1000 + 500 AS xc,
                     CAST((p_partkey * 32452843) % 500 AS DOUBLE) * 1000 + 300 AS yc,
                     CAST(p_size AS DOUBLE) * 40 AS side FROM {part}) t""",
    "f_lozenge": """
        SELECT p_partkey AS id, CAST((p_partkey * 15485863) % 500 AS DOUBLE) * 1000 + 500 AS xc,
               CAST((p_partkey * 32452843) % 500 AS DOUBLE) * 1000 + 300 AS yc,
               CAST(p_size AS DOUBLE) * 400 AS a, CAST(p_size AS DOUBLE) * 200 AS b FROM {part}""",
    "f_shift": """
        SELECT i, j, CAST(90 + i * 0.25 - j * 0.125 + ((i * 7 + j * 13) % 5) * 0.5 AS DOUBLE) AS se,
               CAST(-80 + i * 0.125 + j * 0.25 - ((i * 3 + j * 11) % 7) * 0.25 AS DOUBLE) AS sn
        FROM (SELECT DISTINCT p_partkey % 53 AS i FROM {part}) a, (SELECT DISTINCT p_partkey % 53 AS j FROM {part}) b""",
    "f_access": """
        SELECT id * 10 + 1 AS access_id, id AS ref_to_greenspace_site, xa AS x, (ya + yb) / 2 AS y
        FROM f_site WHERE id % 3 <> 0""",
    "f_prev": """
        SELECT * FROM (VALUES ('employment_all', 50000), ('hospitals', 600), ('gp_practices', 610),
                              ('main_bua', 3), ('sub_bua', 9)) AS t(destination_cd, total_22)""",
}


def with_views(query: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``query`` with the views it names, in dependency order."""
    known = {**VIEWS, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(known[name])
                needed.append(name)

    visit(query)
    if not needed:
        return query
    return "WITH " + ",\n".join(f"{name} AS ({known[name]})" for name in needed) + "\n" + query


def duck_sql(query: str, extra: dict[str, str] | None = None) -> str:
    """Text for an engine where the base tables are views under their own names."""
    return with_views(query, extra).format_map({name: name for name in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, query: str, extra: dict[str, str] | None = None) -> DataFrame:
    text = with_views(query, extra)
    used = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in text}
    return spark.sql(text, **used)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, f"SELECT * FROM {name}")
