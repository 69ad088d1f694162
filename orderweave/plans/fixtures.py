"""Order-shaped views of the driver tables, as DataFrames and as oracle SQL.

The SQL text is the DuckDB side of the correctness check; the DataFrame functions
are written on their own so that the two sides stay independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderweave.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(key: Column) -> Column:
    series = (F.lit(2000) + F.floor(key / 1000)).cast("string")
    number = F.lpad((key % 1000).cast("string"), 3, "0")
    return F.concat_ws("-", F.lit("AE"), series, number)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    alloy = F.element_at(F.array(*map(F.lit, (
        "EN AW-6060", "EN AW-6063", "EN AW-6082", "EN AW-6005A"))), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        _code(key).alias("internal_code"), F.col("p_name").alias("profile_name"),
        alloy.alias("alloy"), F.col("p_size").cast("double").alias("width_mm"),
        (10 + key % 17).cast("double").alias("height_mm"),
        (1 + key % 5).cast("double").alias("wall_thickness_mm"),
        F.when(key % 10 == 9, "I").otherwise("A").alias("status"), "p_partkey")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = key.cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), text).alias("code"), F.col("c_name").alias("display_name"),
        F.when(key % 3 == 0, "table_text").when(key % 3 == 1, "local_model")
        .otherwise("api_model").alias("extraction_strategy"),
        F.when(key % 3 == 2, F.concat(F.lit("k"), text)).alias("api_key"),
        (F.col("c_acctbal") >= 0).alias("active"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_shipdate")
    numbered = table(spark, sf_dir, "lineitem").withColumn(
        "seq", F.row_number().over(number))
    heads = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    items = catalog(spark, sf_dir).select(
        F.col("p_partkey").alias("l_partkey"), "internal_code", "profile_name", "alloy",
        "width_mm", "height_mm", "wall_thickness_mm")
    part, seq = F.col("l_partkey"), F.col("seq")
    size = F.concat_ws("x", *[F.col(c).cast("int").cast("string") for c in
                              ("width_mm", "height_mm", "wall_thickness_mm")])
    unit = F.try_element_at(F.array(*map(F.lit, ("PCE", "MTR", "KGM", "TNE", "box"))),
                            F.nullif((seq % 6).cast("int"), F.lit(0)))
    return (
        numbered.join(heads, "l_orderkey").join(items, "l_partkey")
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.lpad((seq * 10).cast("string"), 4, "0").alias("line_no"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"),
            (F.col("o_custkey") % 2 == 0).alias("trusted"),
            F.when(part % 5 == 0, None)
            .when(part % 5 == 1, F.concat(F.lit("  "), F.lower("internal_code"), F.lit(" ")))
            .when(part % 5 == 2, F.concat(F.lit("PR-"), part.cast("string")))
            .otherwise(F.col("internal_code")).alias("extracted_code"),
            F.when(part % 3 == 0, F.concat(F.col("profile_name"), F.lit(" "), size,
                                           F.lit(" mm, "), F.col("alloy"), F.lit(" T66")))
            .when(part % 3 == 1, F.concat_ws(" ", "profile_name", "alloy"))
            .alias("description"),
            F.when(seq != 7, F.col("l_quantity")).alias("quantity"),
            unit.alias("unit"), F.col("l_shipdate").cast("date").alias("delivery_date"),
            "l_partkey"))


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as a written table, for queries that read them several times."""
    return stored(lines(spark, sf_dir), "lines")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"),
        F.when(key % 4 != 0, F.concat(F.lit("BP-"), key.cast("string"))).alias("order_ref"),
        F.col("o_orderdate").cast("date").alias("order_date"), F.lit("EUR").alias("currency"),
        F.col("o_orderdate").alias("created_at"))


def aliases(order_lines: DataFrame) -> DataFrame:
    taught = F.col("extracted_code").startswith("PR-") & (F.col("l_partkey") % 7 < 4)
    return order_lines.where(taught).select(
        F.col("customer").alias("customer_code"),
        F.upper(F.trim("extracted_code")).alias("customer_part_code"),
        _code(F.col("l_partkey")).alias("internal_code")).distinct()


def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("path"),
        F.col("user_id").cast("int").alias("tokens"), F.col("value").alias("cost"),
        F.col("ts").cast("timestamp").alias("timestamp"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    severity = F.element_at(F.array(*map(F.lit, (
        "CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "UNKNOWN", "weird"))),
        (key % 7 + 1).cast("int"))
    message = F.concat(F.lit("rule "), (key % 50).cast("string"), F.lit(" CWE-"),
                       (20 + key % 80).cast("string"),
                       F.when(key % 3 == 0, " cwe-798").otherwise(""))
    return table(spark, sf_dir, "events").select(
        key.alias("finding_id"), F.col("event_type").alias("source"),
        severity.alias("severity"), message.alias("message"))


# --- the same views for the oracle ---------------------------------------------

SQL = {
    "fx_catalog": """
        SELECT concat('AE-', CAST(2000 + CAST(floor(p_partkey / 1000.0) AS INT) AS STRING), '-',
                      lpad(CAST(p_partkey % 1000 AS STRING), 3, '0')) AS internal_code,
               p_name AS profile_name,
               CASE p_partkey % 4 WHEN 0 THEN 'EN AW-6060' WHEN 1 THEN 'EN AW-6063'
                    WHEN 2 THEN 'EN AW-6082' ELSE 'EN AW-6005A' END AS alloy,
               CAST(p_size AS DOUBLE) AS width_mm,
               CAST(10 + p_partkey % 17 AS DOUBLE) AS height_mm,
               CAST(1 + p_partkey % 5 AS DOUBLE) AS wall_thickness_mm,
               CASE WHEN p_partkey % 10 = 9 THEN 'I' ELSE 'A' END AS status, p_partkey
        FROM part""",
    "fx_customers": """
        SELECT concat('c', CAST(c_custkey AS STRING)) AS code, c_name AS display_name,
               CASE c_custkey % 3 WHEN 0 THEN 'table_text' WHEN 1 THEN 'local_model'
                    ELSE 'api_model' END AS extraction_strategy,
               CASE WHEN c_custkey % 3 = 2 THEN concat('k', CAST(c_custkey AS STRING)) END
                    AS api_key,
               c_acctbal >= 0 AS active
        FROM customer""",
    "fx_lines": """
        SELECT order_id, line_no, customer, trusted,
               CASE l_partkey % 5 WHEN 0 THEN NULL
                    WHEN 1 THEN concat('  ', lower(c.internal_code), ' ')
                    WHEN 2 THEN concat('PR-', CAST(l_partkey AS STRING))
                    ELSE c.internal_code END AS extracted_code,
               CASE l_partkey % 3
                    WHEN 0 THEN concat(c.profile_name, ' ', CAST(CAST(c.width_mm AS INT) AS STRING),
                         'x', CAST(CAST(c.height_mm AS INT) AS STRING), 'x',
                         CAST(CAST(c.wall_thickness_mm AS INT) AS STRING), ' mm, ', c.alloy, ' T66')
                    WHEN 1 THEN concat(c.profile_name, ' ', c.alloy) ELSE NULL END AS description,
               CASE WHEN seq = 7 THEN NULL ELSE l_quantity END AS quantity,
               CASE seq % 6 WHEN 0 THEN NULL WHEN 1 THEN 'PCE' WHEN 2 THEN 'MTR'
                    WHEN 3 THEN 'KGM' WHEN 4 THEN 'TNE' ELSE 'box' END AS unit,
               CAST(l_shipdate AS DATE) AS delivery_date, l_partkey
        FROM (SELECT l_orderkey AS order_id, l_partkey, l_quantity, l_shipdate, seq,
                     lpad(CAST(seq * 10 AS STRING), 4, '0') AS line_no
              FROM (SELECT l_orderkey, l_partkey, l_quantity, l_shipdate,
                           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
                               l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
                               l_tax, l_shipdate) AS seq FROM lineitem) q) l
        JOIN (SELECT o_orderkey, concat('c', CAST(o_custkey AS STRING)) AS customer,
                     o_custkey % 2 = 0 AS trusted FROM orders) o ON o.o_orderkey = l.order_id
        JOIN fx_catalog c ON c.p_partkey = l.l_partkey""",
    "fx_orders": """
        SELECT o_orderkey AS id, concat('c', CAST(o_custkey AS STRING)) AS customer,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL
                    ELSE concat('BP-', CAST(o_orderkey AS STRING)) END AS order_ref,
               CAST(o_orderdate AS DATE) AS order_date, 'EUR' AS currency,
               o_orderdate AS created_at
        FROM orders""",
    "fx_aliases": """
        SELECT DISTINCT customer AS customer_code, upper(trim(extracted_code)) AS customer_part_code,
               concat('AE-', CAST(2000 + CAST(floor(l_partkey / 1000.0) AS INT) AS STRING), '-',
                      lpad(CAST(l_partkey % 1000 AS STRING), 3, '0')) AS internal_code
        FROM fx_lines WHERE extracted_code LIKE 'PR-%' AND l_partkey % 7 < 4""",
    "fx_usages": """
        SELECT event_id AS id, event_type AS path, CAST(user_id AS INT) AS tokens,
               value AS cost, ts AS timestamp FROM events""",
    "fx_findings": """
        SELECT event_id AS finding_id, event_type AS source,
               CASE event_id % 7 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM'
                    WHEN 3 THEN 'LOW' WHEN 4 THEN 'INFO' WHEN 5 THEN 'UNKNOWN'
                    ELSE 'weird' END AS severity,
               concat('rule ', CAST(event_id % 50 AS STRING), ' CWE-',
                      CAST(20 + event_id % 80 AS STRING),
                      CASE WHEN event_id % 3 = 0 THEN ' cwe-798' ELSE '' END) AS message
        FROM events""",
}
_NEEDS = {"fx_lines": ("fx_catalog",), "fx_aliases": ("fx_catalog", "fx_lines")}


def with_views(names: str, extra: dict[str, str], final: str) -> str:
    """A statement whose WITH list holds the named views and then ``extra``."""
    wanted: list[str] = []
    for name in names.split():
        for view in (*_NEEDS.get(name, ()), name):
            if view not in wanted:
                wanted.append(view)
    ctes = [f"{v} AS ({SQL[v]})" for v in wanted] + [f"{n} AS ({q})" for n, q in extra.items()]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + final
