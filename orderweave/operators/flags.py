"""Quality flags, operator edits and the codes they teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderweave import fixed_values as fv
from orderweave.functions.text import norm_code, strip
from orderweave.operators.joins import with_defaults
from orderweave.operators.resolution import catalog_index


def flags_column(code: Column, tier: Column, quantity: Column, unit: Column,
                 check: Column) -> Column:
    unmatched = F.coalesce(code, F.lit("")) == ""
    unclear = quantity.isNull() | ~F.coalesce(unit.isin(*fv.ALLOWED_UNITS), F.lit(False))
    weak = ~unmatched & ~F.coalesce(tier.isin(*fv.TRUSTED_TIERS), F.lit(False))
    return F.array_compact(F.array(
        F.when(unmatched, "unmatched_code"),
        F.when(weak, "weak_match"),
        F.when(unclear, "ambiguous_unit"),
        F.when(check == "mismatch", "code_mismatch")))


def flag_lines(lines: DataFrame) -> DataFrame:
    """Adds the ordered array ``confidence_flags``."""
    return lines.withColumn("confidence_flags", flags_column(
        *[F.col(c) for c in ("resolved_internal_code", "match_tier", "quantity", "unit",
                             "code_check")]))


def flag_frequency(flagged: DataFrame) -> DataFrame:
    """How often each flag occurs, by tier and customer."""
    # Of a plain column Spark would also filter by its size, and work out all flags again for that.
    flags = F.array_compact("confidence_flags")
    return (flagged.select(F.explode(flags).alias("flag"), "match_tier", "customer")
            .groupBy("flag", "match_tier", "customer").agg(F.count("*").alias("n")))


def apply_edits(lines: DataFrame, edits: DataFrame, catalog: DataFrame
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply operator corrections ``(edit_id, order_id, line_no, internal_code)``.

    Returns the edited lines, the rejected edits with a reason, and the taught
    ``(customer_code, customer_part_code, internal_code, seq)`` rows. Of several
    valid edits to one line the highest ``edit_id`` stands.
    """
    active = catalog_index(catalog).withColumnRenamed("_catalog_code", "_item")
    known = lines.select("order_id", "line_no", "customer", "extracted_code",
                         F.lit(True).alias("_known"))
    judged = (
        edits.withColumn("_code", F.upper(strip(F.col("internal_code"))))
        .join(active, "_code", "left").join(known, ["order_id", "line_no"], "left")
        .withColumn("reason", F.when(F.col("_known").isNull(), "line_not_found")
                    .when(F.col("_item").isNull(), "code_not_active"))
    )
    rejects = judged.where(F.col("reason").isNotNull()).select(*edits.columns, "reason")
    valid = judged.where(F.col("reason").isNull())
    last = valid.groupBy("order_id", "line_no").agg(
        F.max_by("_item", "edit_id").alias("_edited"))
    base = with_defaults(lines, {"resolved_internal_code": "string", "match_tier": "string",
                                 "confidence_flags": "array<string>"})
    edited = F.col("_edited").isNotNull()
    new_flags = flags_column(F.col("_edited"), F.lit("manual"), F.col("quantity"),
                             F.col("unit"), F.lit("absent"))
    replaced = {
        "resolved_internal_code": F.coalesce("_edited", "resolved_internal_code"),
        "match_tier": F.when(edited, "manual").otherwise(F.col("match_tier")),
        "confidence_flags": F.when(edited, new_flags).otherwise(F.col("confidence_flags")),
    }
    result = base.join(last, ["order_id", "line_no"], "left").select(
        *[replaced[c].alias(c) if c in replaced else F.col(c) for c in base.columns])
    taught = (valid.where(F.coalesce("extracted_code", F.lit("")) != "")
              .select(F.col("customer").alias("customer_code"),
                      F.col("extracted_code").alias("customer_part_code"),
                      F.col("_item").alias("internal_code"), F.col("edit_id").alias("seq")))
    return result, rejects, taught


def learn_aliases(aliases: DataFrame, taught: DataFrame) -> DataFrame:
    """Merge taught codes into the alias table, last write wins per key.

    Both sides carry ``customer_code, customer_part_code, internal_code``;
    ``created_at, updated_at`` (aliases) and ``seq, taught_at`` (taught) are optional.
    """
    stamps = {"created_at": "timestamp", "updated_at": "timestamp"}
    old = with_defaults(aliases, stamps).select(
        "customer_code", norm_code(F.col("customer_part_code")).alias("customer_part_code"),
        "internal_code", "created_at", "updated_at", F.lit(0).alias("_new"),
        F.lit(0).cast("bigint").alias("_seq"))
    new = with_defaults(taught, {"taught_at": "timestamp", "seq": "bigint"}).select(
        "customer_code", norm_code(F.col("customer_part_code")).alias("customer_part_code"),
        "internal_code", F.col("taught_at").alias("created_at"),
        F.col("taught_at").alias("updated_at"), F.lit(1).alias("_new"),
        F.coalesce(F.col("seq").cast("bigint"), F.lit(0)).alias("_seq"))
    order = F.struct("_new", "_seq", "updated_at", "internal_code")
    return (old.unionByName(new).where(F.col("customer_part_code").isNotNull())
            .groupBy("customer_code", "customer_part_code")
            .agg(F.max_by("internal_code", order).alias("internal_code"),
                 F.min("created_at").alias("created_at"),
                 F.max("updated_at").alias("updated_at")))
