"""Resolving order lines to catalog codes, tier by tier.

Lines carry ``customer, extracted_code, description`` and optionally ``alloy`` and
``trusted``; catalogs carry ``internal_code, profile_name, alloy``, the three
dimensions and ``status``; aliases map ``(customer_code, customer_part_code)`` to
``internal_code``. Every operator keeps exactly one row per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderweave import fixed_values as fv
from orderweave.functions.specs import canonical_alloy, dimensions
from orderweave.functions.text import norm_code, strip, tokens
from orderweave.operators.joins import left_lookup, with_defaults
from orderweave.operators.names import best_targets
from orderweave.session import stored

# A wall bucket is twice the tolerance wide: walls within tolerance of each other
# lie in the same or in neighbouring buckets.
_WALL_BUCKET_MM = 2 * fv.DIMENSION_TOLERANCE_MM


def active_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("status") == "A")


def _line_keys(lines: DataFrame) -> list[str]:
    return [c for c in ("order_id", "line_no", "doc_id") if c in lines.columns] or lines.columns


def _prepared(lines: DataFrame) -> DataFrame:
    return with_defaults(lines, {"alloy": "string"}).withColumn(
        "_code", norm_code(F.col("extracted_code")))


def catalog_index(catalog: DataFrame) -> DataFrame:
    """Active codes by comparison key; of equal keys the last in code order stays."""
    key = F.upper(strip(F.col("internal_code"))).alias("_code")
    return (active_catalog(catalog).select(key, "internal_code")
            .groupBy("_code").agg(F.max("internal_code").alias("_catalog_code")))


def learned_codes(aliases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Taught codes whose target is an active catalog item."""
    taught = aliases.select(
        F.col("customer_code").alias("customer"),
        F.col("customer_part_code").alias("_part"),
        F.upper(strip(F.col("internal_code"))).alias("_code"))
    return (taught.join(catalog_index(catalog), "_code")
            .select("customer", F.col("_part").alias("_code"),
                    F.col("_catalog_code").alias("_learned_code")))


def match_learned(lines: DataFrame, aliases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``learned_code``: what an operator taught for this customer's code."""
    found = left_lookup(_prepared(lines), learned_codes(aliases, catalog),
                        ["customer", "_code"], _line_keys(lines))
    return found.select(*lines.columns, F.col("_learned_code").alias("learned_code"))


def match_exact(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``exact_code``: the active catalog item with the printed code."""
    found = left_lookup(_prepared(lines), catalog_index(catalog), ["_code"],
                        _line_keys(lines))
    return found.select(*lines.columns, F.col("_catalog_code").alias("exact_code"))


def extract_attributes(lines: DataFrame) -> DataFrame:
    """Adds canonical alloy and dimensions read from the free text."""
    prepared = with_defaults(lines, {"alloy": "string"})
    return prepared.select(
        *lines.columns,
        F.coalesce(canonical_alloy(F.col("alloy")),
                   canonical_alloy(F.col("description"))).alias("canon_alloy"),
        F.inline_outer(dimensions(F.col("description"))).alias("dim_w", "dim_h", "dim_t"))


# --- dimensions ---------------------------------------------------------------

def _wall_bucket(c: Column) -> Column:
    return F.floor(c / F.lit(_WALL_BUCKET_MM))


def _sections(catalog: DataFrame) -> DataFrame:
    """Catalog sections per cross-section, wall and alloy, counted before the join."""
    w, h, t = F.col("width_mm"), F.col("height_mm"), F.col("wall_thickness_mm")
    return (
        active_catalog(catalog)
        .where(w.isNotNull() & h.isNotNull() & t.isNotNull())
        .groupBy(F.least(w, h).alias("lo"), F.greatest(w, h).alias("hi"), t.alias("wall"),
                 canonical_alloy(F.col("alloy")).alias("section_alloy"))
        .agg(F.count("*").alias("items"), F.min("internal_code").alias("item"))
        .withColumn("bucket", F.explode(F.array(
            *[_wall_bucket(F.col("wall")) + step for step in (-1, 0, 1)])))
    )


def _specs_by_dimension(specs: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(description, canon) -> code`` where exactly one section fits."""
    sized = specs.select("description", "canon",
                         F.inline(dimensions(F.col("description"))).alias("w", "h", "t"))
    wanted = sized.select("description", "canon", F.least("w", "h").alias("lo"),
                          F.greatest("w", "h").alias("hi"), "t",
                          _wall_bucket(F.col("t")).alias("bucket"))
    near = (wanted.join(_sections(catalog), ["lo", "hi", "bucket"])
            .where(F.abs(F.col("wall") - F.col("t")) <= fv.DIMENSION_TOLERANCE_MM))
    same_alloy = F.col("section_alloy") == F.col("canon")
    counted = near.groupBy("description", "canon").agg(
        F.sum("items").alias("n"), F.min("item").alias("any_item"),
        F.coalesce(F.sum(F.when(same_alloy, F.col("items"))), F.lit(0)).alias("n_alloy"),
        F.min(F.when(same_alloy, F.col("item"))).alias("alloy_item"))
    code = (F.when(F.col("n_alloy") == 1, F.col("alloy_item"))
            .when((F.col("n_alloy") == 0) & (F.col("n") == 1), F.col("any_item")))
    return counted.select("description", "canon", code.alias("code")).where(
        F.col("code").isNotNull())


# --- fuzzy ------------------------------------------------------------------------

def fuzzy_targets(catalog: DataFrame) -> DataFrame:
    """Distinct target texts; equal texts score alike, so the first code stands."""
    alloy = F.nullif(F.col("alloy"), F.lit(""))
    return (
        active_catalog(catalog)
        .select(F.concat_ws(" ", "profile_name", alloy).alias("target"),
                canonical_alloy(alloy).alias("target_alloy"), "internal_code")
        .groupBy("target", "target_alloy").agg(F.min("internal_code").alias("code"))
    )


def _containments(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of a text and a target of its alloy whose every word it holds.

    An equi-join on each target's rarest word finds all of them and the joined row
    checks the other words. Groups stay small: words that a large part of all
    targets share leave only few distinct word sets made of nothing else.
    """
    worded = targets.withColumn("words", tokens(F.col("target"))).where(F.size("words") > 0)
    frequency = (worded.select(F.explode("words").alias("word"))
                 .groupBy("word").agg(F.count("*").alias("df")))
    keyed = (
        worded.select("target", "target_alloy", "code", F.explode("words").alias("word"))
        .join(frequency, "word")
        .groupBy("target", F.col("target_alloy").alias("canon"), "code")
        .agg(F.min_by("word", F.struct("df", "word")).alias("word"))
        .withColumn("needed", tokens(F.col("target")))
    )
    spread = (texts.where(F.col("canon").isNotNull())
              .withColumn("words", tokens(F.col("description")))
              .select("*", F.explode("words").alias("word")))
    missing = F.size(F.array_except("needed", "words"))
    return spread.join(keyed, ["word", "canon"]).where(missing == 0)


def _contained_targets(specs: DataFrame, targets: DataFrame) -> DataFrame:
    """Specs settled without scoring: they hold all words of a target of their alloy.

    That is the highest score there is. A longer target that holds the whole spec
    scores as high; where such a target with an earlier code may exist, the spec is
    left to the scorer.
    """
    as_texts = targets.select(F.col("target").alias("description"),
                              F.col("target_alloy").alias("canon"),
                              F.col("code").alias("outer_code"))
    shadowed = (
        _containments(as_texts, targets).where(F.col("outer_code") < F.col("code"))
        .select("target", "canon").distinct().withColumn("shadowed", F.lit(1)))
    return (
        _containments(specs, targets).join(shadowed, ["target", "canon"], "left")
        .groupBy("description", "canon")
        .agg(F.min("code").alias("code"), F.max("shadowed").alias("shadowed"))
        .where(F.col("shadowed").isNull())
        .select("description", "canon", "code", F.lit(100.0 + fv.ALLOY_BONUS).alias("score"))
    )


def _specs_by_name(specs: DataFrame, catalog: DataFrame, threshold: float) -> DataFrame:
    targets = stored(fuzzy_targets(catalog), "targets")
    specs = specs.where(F.col("description") != "")
    contained = stored(_contained_targets(specs, targets), "contained")
    # Containment needs a known alloy, so plain equality is enough here.
    rest = specs.join(contained, ["description", "canon"], "left_anti")
    return contained.unionByName(best_targets(rest, targets, threshold, fv.ALLOY_BONUS))


def _specs(lines: DataFrame) -> DataFrame:
    """Distinct (description, canonical alloy): the work of the slow tiers.

    Several branches read it, so it is stored: the lines are passed over once for it.
    """
    wanted = lines.where(F.col("description") != "").select("description", "canon").distinct()
    return stored(wanted, "specs")


def _with_canon(lines: DataFrame) -> DataFrame:
    return with_defaults(lines, {"alloy": "string"}).withColumn("canon", F.coalesce(
        canonical_alloy(F.col("alloy")), canonical_alloy(F.col("description"))))


def _join_specs(lines: DataFrame, found: DataFrame, spread_by: list[str]) -> DataFrame:
    """Bring resolved specs back to the lines; unknown alloys join as ''."""
    def keyed(df):
        return df.withColumn("_canon", F.coalesce("canon", F.lit("")))

    return left_lookup(keyed(lines), keyed(found).drop("canon"),
                       ["description", "_canon"], spread_by).drop("_canon")


def match_dimension(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``dimension_code``: the only section with these dimensions (and alloy)."""
    prepared = _with_canon(lines)
    found = _specs_by_dimension(_specs(prepared), catalog).withColumnRenamed(
        "code", "dimension_code")
    return _join_specs(prepared, found, _line_keys(lines)).select(
        *lines.columns, "dimension_code")


def match_fuzzy(lines: DataFrame, catalog: DataFrame,
                threshold: float = fv.FUZZY_THRESHOLD) -> DataFrame:
    """Adds ``fuzzy_code`` and ``fuzzy_score``: the most similar profile name."""
    prepared = _with_canon(lines)
    found = _specs_by_name(_specs(prepared), catalog, threshold).select(
        "description", "canon", F.col("code").alias("fuzzy_code"),
        F.col("score").alias("fuzzy_score"))
    return _join_specs(prepared, found, _line_keys(lines)).select(
        *lines.columns, "fuzzy_code", "fuzzy_score")


# --- cascade -----------------------------------------------------------------------

def _code_check(read: Column, read_item: Column, resolved: Column) -> Column:
    return (F.when(read.isNull() | resolved.isNull(), "absent")
            .when(read == F.upper(strip(resolved)), "confirmed")
            .when(read_item.isNotNull(), "mismatch").otherwise("absent"))


def cross_check_codes(lines: DataFrame, catalog: DataFrame,
                      resolved: str = "resolved_internal_code") -> DataFrame:
    """Adds ``code_check``: does the printed code agree with the resolved one?"""
    found = left_lookup(_prepared(lines), catalog_index(catalog), ["_code"],
                        _line_keys(lines))
    return found.select(*lines.columns, _code_check(
        F.col("_code"), F.col("_catalog_code"), F.col(resolved)).alias("code_check"))


def resolve_lines(lines: DataFrame, catalog: DataFrame, aliases: DataFrame, *,
                  fuzzy: bool = True, threshold: float = fv.FUZZY_THRESHOLD) -> DataFrame:
    """One row per line with ``resolved_internal_code, match_tier, code_check``.

    The code tiers are two lookups on the lines, whose outcome is stored, so that they run
    once. The spec tiers run once per distinct (description, alloy) of the lines that are
    still open.
    """
    keys = _line_keys(lines)
    trusted = F.col("trusted") if "trusted" in lines.columns else F.lit(True)
    coded = left_lookup(
        left_lookup(_prepared(lines), learned_codes(aliases, catalog),
                    ["customer", "_code"], keys, hashed=True),
        catalog_index(catalog), ["_code"], keys, hashed=True)
    by_code = F.coalesce("_learned_code", F.when(trusted, F.col("_catalog_code")))
    staged = _with_canon(coded)
    is_open = F.coalesce(by_code.isNull() & (F.col("description") != ""), F.lit(False))
    # Mostly distinct values: without dictionaries the table is written in half the time.
    staged = stored(staged.select(
        *lines.columns, "_learned_code", "_catalog_code",
        F.when(by_code.isNull(), F.col("_code")).alias("_code"),
        F.when(is_open, F.col("canon")).alias("_canon")), "coded",
        **{"parquet.enable.dictionary": "false"})

    open_lines = staged.where(is_open)
    specs = _specs(open_lines.select("description", F.col("_canon").alias("canon")))
    by_size = _specs_by_dimension(specs, catalog).withColumn("tier", F.lit("dimension"))
    found = by_size
    if fuzzy:
        found = by_size = stored(by_size, "by-size")
        rest = specs.join(
            by_size, (specs["description"] == by_size["description"])
            & specs["canon"].eqNullSafe(by_size["canon"]), "left_anti")
        by_name = _specs_by_name(rest, catalog, threshold)
        found = by_size.unionByName(
            by_name.drop("score").withColumn("tier", F.lit("fuzzy")))
    found = found.select("description", F.coalesce("canon", F.lit("")).alias("_canon"),
                         F.col("code").alias("_spec_code"), F.col("tier").alias("_spec_tier"))
    # Only open lines travel to their specs; unknown alloys join as ''.
    by_spec = left_lookup(open_lines.withColumn("_canon", F.coalesce("_canon", F.lit(""))),
                          found, ["description", "_canon"], keys, hashed=True)
    joined = by_spec.unionByName(with_defaults(
        staged.where(~is_open), {"_spec_code": "string", "_spec_tier": "string"}))
    resolved = F.coalesce(by_code, F.col("_spec_code"))
    tier = (F.when(F.col("_learned_code").isNotNull(), "learned")
            .when(by_code.isNotNull(), "exact")
            .otherwise(F.coalesce("_spec_tier", F.lit("none"))))
    check = F.when(by_code.isNotNull(), "confirmed").otherwise(
        _code_check(F.col("_code"), F.col("_catalog_code"), resolved))
    return joined.select(*lines.columns, resolved.alias("resolved_internal_code"),
                         tier.alias("match_tier"), check.alias("code_check"))
