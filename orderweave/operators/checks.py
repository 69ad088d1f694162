"""Scoring, change detection, disagreement and plausibility of order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderweave.functions.text import norm_code
from orderweave.session import staged
from orderweave.streaming.runs import session_settings


def extraction_score(lines: DataFrame, truth: DataFrame, catalog: DataFrame) -> DataFrame:
    """Accuracy per customer and strategy against known lines, by position.

    ``lines``: doc_id, pos, customer, strategy, resolved_internal_code, unit;
    ``truth``: doc_id, pos, customer, strategy, expected_code, expected_unit. Expected
    codes outside the catalog should stay unresolved.
    """
    known = catalog.select(norm_code(F.col("internal_code")).alias("_want"),
                           F.lit(True).alias("_in_catalog")).distinct()
    keys = ["doc_id", "pos", "customer", "strategy"]
    wanted = truth.withColumn("_want", norm_code(F.col("expected_code"))).join(
        known, "_want", "left").withColumn("_expected", F.lit(True))
    got = lines.select(*keys, norm_code(F.col("resolved_internal_code")).alias("_got"), "unit",
                       F.lit(True).alias("_produced"))
    pairs = wanted.join(got, keys, "full_outer")
    is_expected = F.coalesce("_expected", F.lit(False))
    is_produced = F.coalesce("_produced", F.lit(False))
    in_catalog = F.coalesce("_in_catalog", F.lit(False))
    resolved = F.col("_got").isNotNull()
    per_doc = pairs.groupBy("customer", "strategy", "doc_id").agg(
        F.count_if(is_expected).alias("expected"), F.count_if(is_produced).alias("produced"),
        F.count_if(in_catalog).alias("catalog_lines"),
        F.count_if(in_catalog & (F.col("_got") == F.col("_want"))).alias("code_ok"),
        F.count_if(in_catalog & resolved & (F.col("_got") != F.col("_want"))).alias("code_wrong"),
        F.count_if(is_expected & ~in_catalog & resolved).alias("false_positive"),
        F.count_if(is_expected & is_produced
                   & F.col("unit").eqNullSafe(F.col("expected_unit"))).alias("unit_ok"))
    sums = ("expected", "produced", "catalog_lines", "code_ok", "code_wrong",
            "false_positive", "unit_ok")
    return per_doc.groupBy("customer", "strategy").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("expected") == F.col("produced")).alias("line_count_ok"),
        *[F.sum(c).alias(c) for c in sums])


def order_change_diff(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes between two versions of orders keyed by ``(order_ref, line_no)``.

    Returns changed lines with their kind and per order counts with an order level
    verdict. A line whose quantity and date both changed counts for both kinds.
    """
    return _judged(_paired(old, new, ["order_ref"]), ["order_ref"])


def _paired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Each line beside its other version, if there is one."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*keys, "line_no", F.col("quantity").alias(f"{tag}_quantity"),
                         F.col("delivery_date").alias(f"{tag}_date"),
                         F.lit(True).alias(f"_{tag}"))

    return side(old, "old").join(side(new, "new"), [*keys, "line_no"], "full_outer")


def _judged(pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The changes of paired lines, and their counts with a verdict per key."""
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(F.col("_old").isNull(), "line_added"),
        F.when(F.col("_new").isNull(), "line_cancelled"),
        F.when(both & ~F.col("old_quantity").eqNullSafe(F.col("new_quantity")),
               "quantity_changed"),
        F.when(both & ~F.col("old_date").eqNullSafe(F.col("new_date")), "date_moved")))
    marked = pairs.withColumn("kinds", kinds)
    shown = [*keys, "line_no", "old_quantity", "new_quantity", "old_date", "new_date"]
    changes = marked.select(*shown, F.explode("kinds").alias("change"))

    def counted(kind: str) -> Column:
        return F.count_if(F.array_contains("kinds", kind)).alias(kind)

    per_order = marked.groupBy(*keys).agg(
        *[counted(k) for k in ("line_added", "line_cancelled", "quantity_changed",
                               "date_moved")],
        F.count("_old").alias("old_lines"), F.count("_new").alias("new_lines"))
    touched = sum((F.col(k) for k in ("line_added", "line_cancelled", "quantity_changed",
                                      "date_moved")), F.lit(0))
    verdict = (F.when(F.col("old_lines") == 0, "new_order")
               .when(F.col("new_lines") == 0, "order_cancelled")
               .when(touched > 0, "possible_change").otherwise("unchanged"))
    return changes, per_order.withColumn("verdict", verdict)


def _previous_versions(versions: DataFrame) -> DataFrame:
    """``order_ref, version, before``: each version of an order with the one before it."""
    in_order = Window.partitionBy("order_ref").orderBy("version")
    once = versions.select("order_ref", "version").distinct()
    return once.withColumn("before", F.lag("version").over(in_order))


def order_change_chain(versions: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes along all versions of orders, each against the version before it.

    versions: ``order_ref, version``, also those without a line; lines: ``order_ref, version, line_no,
    quantity, delivery_date``. Returns the changed lines per version, and one row per version with the
    counts and its verdict: ``new_order``, ``order_cancelled`` (no line left), ``still_cancelled``,
    ``order_reopened`` (lines after none), ``possible_change`` or ``unchanged``. Versions and paired lines
    are stored on the way.
    """
    keys, fields = ["order_ref", "version"], ["line_no", "quantity", "delivery_date"]
    chain = staged(_previous_versions(versions), "versions")
    # Lines and versions are dealt by their order once, and all three joins are done where they then are.
    placed, links = lines.select(*keys, *fields).repartition("order_ref"), chain.repartition("order_ref")
    # The lines of a version count twice: as its own, and as those before the next version.
    own = placed.join(links, keys)
    before = placed.withColumnRenamed("version", "before").join(links, ["order_ref", "before"])
    with session_settings(lines.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        pairs = staged(_paired(before.select(*keys, *fields), own.select(*keys, *fields), keys), "pairs")
    changes, counts = _judged(pairs, keys)
    kinds = ["line_added", "line_cancelled", "quantity_changed", "date_moved"]
    sums = [*kinds, "old_lines", "new_lines"]
    counted = chain.join(counts.select(*keys, *sums), keys, "left").fillna(0, sums)
    touched = sum((F.col(k) for k in kinds), F.lit(0))
    verdict = (F.when(F.col("before").isNull(), "new_order")
               .when((F.col("old_lines") == 0) & (F.col("new_lines") == 0), "still_cancelled")
               .when(F.col("old_lines") == 0, "order_reopened")
               .when(F.col("new_lines") == 0, "order_cancelled")
               .when(touched > 0, "possible_change").otherwise("unchanged"))
    return changes, counted.select(*keys, "before", *sums, verdict.alias("verdict"))


def latest_lines(versions: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of each order's latest version; none for an order that ended cancelled."""
    latest = versions.groupBy("order_ref").agg(F.max("version").alias("version"))
    return lines.join(latest, ["order_ref", "version"], "left_semi")


def compare_extractions(a: DataFrame, b: DataFrame, fields: list[str],
                        keys: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """Fields in which two extractions of the same line disagree.

    A line that only one of them has is one row with the flag ``line_missing``, the field
    ``a`` or ``b`` that lacks it, and no values.
    """
    left = a.select(*keys, F.lit(True).alias("_a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    right = b.select(*keys, F.lit(True).alias("_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    rows = F.filter(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("string").alias("value_a"),
                 F.col(f"b_{f}").cast("string").alias("value_b"),
                 (~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias("differs"))
        for f in fields]), lambda r: r["differs"])
    lacking = F.when(F.col("_a").isNull(), "a").when(F.col("_b").isNull(), "b")
    none = F.lit(None).cast("string")
    one_sided = F.array(F.struct(lacking.alias("field"), none.alias("value_a"),
                                 none.alias("value_b"), F.lit(True).alias("differs")))
    shown = F.when(lacking.isNotNull(), one_sided).otherwise(rows)
    return (left.join(right, list(keys), "full_outer")
            .select(*keys, lacking.isNotNull().alias("_alone"), F.explode(shown).alias("r"))
            .select(*keys, "r.field", "r.value_a", "r.value_b",
                    F.when(F.col("_alone"), "line_missing").otherwise("metadata_mismatch")
                    .alias("flag")))


def qty_plausibility(lines: DataFrame, catalog: DataFrame, factor: float = 10.0) -> DataFrame:
    """Quantity of each line in kg, metres and pieces, and whether it is an outlier.

    A line is an outlier when its weight is more than ``factor`` times above or below
    the mean weight of the lines for the same item. Lines without a catalog item stay, with
    what can be told without its weight, and are no outliers. Weights are summed as decimals, so a line
    that lies exactly at the limit is judged alike whatever the order of the rows.
    """
    items = catalog.select(F.col("internal_code").alias("resolved_internal_code"),
                           "weight_kg_per_m")
    q, weight = F.col("quantity"), F.nullif(F.col("weight_kg_per_m"), F.lit(0.0))
    length = F.nullif(F.col("length_mm"), F.lit(0.0)) / 1000
    metres = (F.when(F.col("unit") == "MTR", q).when(F.col("unit") == "PCE", q * length)
              .when(F.col("unit") == "KGM", q / weight)
              .when(F.col("unit") == "TNE", q * 1000 / weight))
    sized = lines.join(items, "resolved_internal_code", "left").withColumn("metres", metres).withColumns({
        "kg": F.when(F.col("unit") == "KGM", q).when(F.col("unit") == "TNE", q * 1000)
        .otherwise(F.col("metres") * weight),
        "pieces": F.when(F.col("unit") == "PCE", q).otherwise(F.col("metres") / length)})
    known = sized.where(F.col("resolved_internal_code").isNotNull())
    exact = F.col("kg").try_cast("decimal(28,9)")
    # Weights that no such decimal holds are summed as they are.
    mean = F.when(F.count(exact) == F.count("kg"), F.try_sum(exact).cast("double") / F.count("kg"))
    usual = known.groupBy("resolved_internal_code").agg(F.coalesce(mean, F.avg("kg")).alias("mean_kg"))
    ratio = F.col("kg") / F.nullif(F.col("mean_kg"), F.lit(0.0))
    return sized.join(usual, "resolved_internal_code", "left").withColumn(
        "outlier", F.coalesce((ratio > factor) | (ratio < 1 / factor), F.lit(False)))
