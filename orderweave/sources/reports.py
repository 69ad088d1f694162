"""Scanner reports of seven JSON shapes as one findings table.

Readers take ``(report, text)`` rows, one per report file or, for line-delimited
reports, one per line. Every finding carries its ``report`` and ``pos``, the order in
which findings arrive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave import fixed_values as fv
from orderweave.operators.joins import with_constant

FIELDS = {
    "report": "string", "pos": "array<bigint>", "source": "string", "rule_id": "string",
    "message": "string", "severity": "string", "confidence": "string", "file": "string",
    "line_start": "bigint", "line_end": "bigint", "package": "string", "version": "string",
    "fix_versions": "array<string>", "commit": "string", "verified": "boolean",
    "target": "string", "cwes": "array<string>", "owasp_categories": "array<string>",
    "references": "array<string>",
}
_NO_TEXTS = "array<string>"


def read_texts(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """``report, text`` of whole files, or of lines with the ``block`` of the file they lie in."""
    rows = spark.read.text(path, wholetext=not by_line).select(
        F.col("_metadata.file_path").alias("report"), F.col("value").alias("text"),
        F.col("_metadata.file_block_start").alias("block"))
    return rows if by_line else rows.drop("block")


def read_mapping(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Categories ``(owasp_id, pos, name, description, cwes)``, ranks
    ``(cwe, rank, name, description)`` and tests ``(test_id, cwe, owasp)``."""
    schema = (
        "owasp_top_10 map<string,struct<name:string,description:string,cwes:array<string>>>,"
        "sans_cwe_top_25 map<string,struct<rank:int,name:string,description:string>>,"
        "bandit_test_mappings map<string,struct<cwe:string,owasp:string>>")
    raw = spark.read.schema(schema).json(path, multiLine=True)
    entries = F.map_entries("owasp_top_10")
    categories = raw.select(F.posexplode(entries).alias("pos", "e")).select(
        F.col("e.key").alias("owasp_id"), "pos", "e.value.*")
    ranks = raw.select(F.explode("sans_cwe_top_25").alias("cwe", "v")).select("cwe", "v.*")
    tests = raw.select(F.explode("bandit_test_mappings").alias("test_id", "v")).select(
        "test_id", "v.*")
    return categories, ranks, tests


def cwe_ids(text: Column) -> Column:
    """All weakness numbers of a text in canonical spelling, with repeats."""
    found = F.regexp_extract_all(text, F.lit(r"(?iU)CWE-(\d+)"), F.lit(1))
    return F.coalesce(F.transform(found, lambda n: F.concat(F.lit("CWE-"), n)),
                      F.array().cast(_NO_TEXTS))


def first_category_map(categories: DataFrame) -> DataFrame:
    """One row: weakness to its first category, in category order."""
    pairs = (categories.select("owasp_id", "pos", F.explode("cwes").alias("cwe"))
             .groupBy("cwe").agg(F.min_by("owasp_id", "pos").alias("owasp_id")))
    return pairs.agg(F.map_from_entries(F.collect_list(F.struct("cwe", "owasp_id")))
                     .alias("owasp_of"))


# --- variant access -----------------------------------------------------------------

def _get(v, path: str, as_type: str, default=None) -> Column:
    got = F.try_variant_get(v, path, as_type)
    return got if default is None else F.coalesce(got, F.lit(default))


def _kind(v, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _texts(v, path: str) -> Column:
    """A list of texts, or one text as a list; empty when absent."""
    return F.coalesce(
        F.when(_kind(v, path) == "STRING", F.array(F.try_variant_get(v, path, "string"))),
        F.try_variant_get(v, path, "array<string>"), F.array().cast(_NO_TEXTS))


def _items(reports: DataFrame, path: str, first: str | None = None) -> DataFrame:
    parsed = reports.withColumn("doc", F.try_parse_json("text"))
    array = F.try_variant_get("doc", path, "array<variant>")
    if first:
        array = F.coalesce(F.try_variant_get("doc", first, "array<variant>"), array)
    return parsed.select("report", F.posexplode(array).alias("at", "v")).select(
        "report", "v", F.array(F.col("at").cast("bigint")).alias("pos"))


def _place(json: Column, key: Column, otherwise: Column) -> Column:
    """Place of a key in a JSON object as it is written; variants order their keys by name."""
    found = F.array_position(F.json_object_keys(json), key)
    return F.coalesce(F.nullif(found, F.lit(0)), otherwise + 1).cast("bigint")


def _findings(rows: DataFrame, source, **columns) -> DataFrame:
    columns["source"] = F.lit(source) if isinstance(source, str) else source
    picked = [(columns[name] if name in columns else
               F.col(name) if name in ("report", "pos") else F.lit(None))
              .cast(dtype).alias(name) for name, dtype in FIELDS.items()]
    return rows.select(*picked)


def _fixed(*values: str) -> Column:
    return F.array(*map(F.lit, values))


# --- readers ----------------------------------------------------------------------------

def read_semgrep(reports: DataFrame, categories: DataFrame) -> DataFrame:
    rows = with_constant(_items(reports, "$.results"), first_category_map(categories))
    v = F.col("v")
    rule, message = _get(v, "$.check_id", "string", "unknown"), _get(
        v, "$.extra.message", "string", "")
    cwes = F.concat(_texts(v, "$.extra.metadata.cwe"), cwe_ids(message), cwe_ids(rule))
    mapped = F.array_compact(F.transform(
        cwes, lambda c: F.try_element_at(F.col("owasp_of"), c)))
    return _findings(
        rows, "semgrep", rule_id=rule, message=message,
        severity=F.upper(_get(v, "$.extra.severity", "string", "INFO")),
        file=_get(v, "$.path", "string", "unknown"),
        line_start=_get(v, "$.start.line", "bigint", 0),
        line_end=_get(v, "$.end.line", "bigint", 0),
        cwes=F.array_sort(F.array_distinct(cwes)),
        owasp_categories=F.array_sort(F.array_distinct(
            F.concat(_texts(v, "$.extra.metadata.owasp"), mapped))),
        references=_texts(v, "$.extra.metadata.references"))


def read_bandit(reports: DataFrame, tests: DataFrame) -> DataFrame:
    v = F.col("v")
    rows = _items(reports, "$.results").withColumn(
        "test_id", _get(v, "$.test_id", "string", "unknown")).join(tests, "test_id", "left")
    name = _get(v, "$.test_name", "string", "unknown")
    line = _get(v, "$.line_number", "bigint", 0)
    return _findings(
        rows, "bandit", rule_id=F.concat_ws(":", "test_id", name),
        message=_get(v, "$.issue_text", "string", ""),
        severity=F.upper(_get(v, "$.issue_severity", "string", "LOW")),
        confidence=F.upper(_get(v, "$.issue_confidence", "string", "LOW")),
        file=_get(v, "$.filename", "string", "unknown"), line_start=line, line_end=line,
        cwes=F.array_compact(F.array("cwe")), owasp_categories=F.array_compact(F.array("owasp")),
        references=F.array(F.concat(
            F.lit("https://bandit.readthedocs.io/en/latest/plugins/"), F.lower("test_id"),
            F.lit("_"), name, F.lit(".html"))))


def read_pip_audit(reports: DataFrame) -> DataFrame:
    v = F.col("v")
    rows = _items(reports, "$.vulnerabilities", first="$").where(
        F.schema_of_variant(v).startswith("OBJECT"))

    def either(a: str, b: str, default: str) -> Column:
        return F.coalesce(_get(v, a, "string"), _get(v, b, "string"), F.lit(default))

    package, version = either("$.name", "$.package", "unknown"), _get(
        v, "$.version", "string", "unknown")
    told = either("$.description", "$.advisory", "")
    fixes = F.coalesce(F.try_variant_get(v, "$.fix_versions", _NO_TEXTS),
                       F.try_variant_get(v, "$.fixed_in", _NO_TEXTS),
                       F.array().cast(_NO_TEXTS))
    return _findings(
        rows, "pip-audit", rule_id=either("$.id", "$.vulnerability_id", "unknown"),
        message=F.concat(package, F.lit("@"), version, F.lit(": "), told),
        severity=F.lit("HIGH"), package=package, version=version, fix_versions=fixes,
        cwes=cwe_ids(told), owasp_categories=_fixed(fv.COMPONENTS_CATEGORY),
        references=F.array(F.concat(F.lit("https://pypi.org/project/"), package, F.lit("/"))))


def read_pnpm_audit(reports: DataFrame, source: str) -> DataFrame:
    packages = reports.select("report", "text", F.posexplode(F.try_variant_get(
        F.try_parse_json("text"), "$.vulnerabilities", "map<string,variant>"))
        .alias("at", "package", "pkg"))
    packages = packages.withColumn("at", _place(
        F.get_json_object("text", "$.vulnerabilities"), F.col("package"), F.col("at")))
    rows = packages.select("report", "at", "package", "pkg", F.posexplode(
        F.try_variant_get("pkg", "$.via", "array<variant>")).alias("nth", "v"))
    v, pkg = F.col("v"), F.col("pkg")
    rows = rows.where(F.schema_of_variant(v).startswith("OBJECT")).withColumn(
        "pos", F.array("at", F.col("nth").cast("bigint")))
    return _findings(
        rows, source, rule_id=_get(v, "$.source", "string", "unknown"),
        message=F.concat(F.col("package"), F.lit(": "),
                         _get(v, "$.title", "string", "Unknown vulnerability")),
        severity=F.upper(_get(pkg, "$.severity", "string", "low")), package=F.col("package"),
        version=_get(pkg, "$.range", "string", "unknown"),
        cwes=cwe_ids(F.to_json(F.try_variant_get(v, "$.cwe", "variant"))),
        owasp_categories=_fixed(fv.COMPONENTS_CATEGORY),
        references=F.array(_get(v, "$.url", "string", "")))


def read_njsscan(reports: DataFrame, source: str) -> DataFrame:
    groups = reports.select("report", "text", F.posexplode(F.try_variant_get(
        F.try_parse_json("text"), "$", "map<string,variant>")).alias("g", "_group", "rules"))
    inner = F.call_function("get_json_object", F.col("text"), F.concat(F.lit("$['"), "_group", F.lit("']")))
    groups = groups.withColumns({"g": _place(F.col("text"), F.col("_group"), F.col("g")), "inner": inner})
    rules = groups.select("report", "g", "inner", F.posexplode(F.try_variant_get(
        "rules", "$", "map<string,variant>")).alias("r", "rule_id", "rule"))
    rules = rules.withColumn("r", _place(F.col("inner"), F.col("rule_id"), F.col("r")))
    rows = rules.select("report", "g", "r", "rule_id", "rule", F.posexplode(
        F.try_variant_get("rule", "$.files", "array<variant>")).alias("f", "v")).withColumn(
        "pos", F.array("g", "r", F.col("f").cast("bigint")))
    v, rule = F.col("v"), F.col("rule")
    told, match = _get(rule, "$.metadata.description", "string", ""), _get(
        v, "$.match_string", "string", "")
    span = F.coalesce(F.try_variant_get(v, "$.match_lines", "array<bigint>"),
                      F.array(F.lit(0), F.lit(0)).cast("array<bigint>"))
    start = F.coalesce(F.get(span, F.lit(0)), F.lit(0))
    category = F.regexp_extract(_get(rule, "$.metadata.owasp", "string", ""),
                                r"A\d{1,2}:\d{4}", 0)
    return _findings(
        rows, source, rule_id=F.col("rule_id"),
        message=F.when(match != "", F.concat(told, F.lit(" - "), match)).otherwise(told),
        severity=F.upper(_get(rule, "$.metadata.severity", "string", "INFO")),
        file=_get(v, "$.file_path", "string", "unknown"), line_start=start,
        line_end=F.coalesce(F.get(span, F.lit(1)), start),
        cwes=cwe_ids(_get(rule, "$.metadata.cwe", "string", "")),
        owasp_categories=F.array_compact(F.array(F.nullif(category, F.lit("")))),
        references=F.array(_get(rule, "$.metadata.ref", "string", "")))


def read_trufflehog(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("v", F.try_parse_json("text")).where(F.col("v").isNotNull())
    if "pos" not in rows.columns:
        # Blocks of a file in order, and in a block the lines as they are scanned.
        block = [F.col("block")] if "block" in rows.columns else []
        rows = rows.withColumn("pos", F.array(*block, F.monotonically_increasing_id()))
    v = F.col("v")

    def either(name: str, as_type: str, default) -> Column:
        return F.coalesce(_get(v, f"$.{name}", as_type),
                          _get(v, f"$.{name[0].lower()}{name[1:]}", as_type), F.lit(default))

    detector, kind = either("DetectorName", "string", "unknown"), either(
        "DetectorType", "string", "")
    verified = either("Verified", "boolean", False)
    meta = F.coalesce(_get(v, "$.SourceMetadata", "variant"), _get(v, "$.sourceMetadata", "variant"))
    data = F.coalesce(_get(meta, "$.Data", "variant"), _get(meta, "$.data", "variant"))
    on_disk = _get(data, "$.Filesystem", "variant")
    place = F.coalesce(on_disk, _get(data, "$.Git", "variant"))
    file, line = _get(place, "$.file", "string", "unknown"), _get(place, "$.line", "bigint", 0)
    commit = F.when(on_disk.isNull(), _get(place, "$.commit", "string")).otherwise("")
    return _findings(
        rows, "trufflehog",
        rule_id=F.concat(detector, F.when(~kind.isin("", "0"), F.concat(
            F.lit(" ("), kind, F.lit(")"))).otherwise("")),
        message=F.concat(F.when(verified, "Verified ").otherwise("Potential "), detector,
                         F.lit(" secret detected in "), file),
        severity=F.when(verified, "CRITICAL").otherwise("HIGH"), file=file, line_start=line,
        line_end=line, commit=F.coalesce(commit, F.lit("")), verified=verified,
        cwes=_fixed(fv.SECRETS_WEAKNESS), owasp_categories=_fixed(fv.SECRETS_CATEGORY),
        references=_fixed("https://owasp.org/Top10/"
                          "A07_2021-Identification_and_Authentication_Failures/"))


def read_trivy(reports: DataFrame) -> DataFrame:
    targets = _items(reports, "$.Results").select(
        "report", F.get("pos", F.lit(0)).alias("at"), F.col("v").alias("result"))
    rows = targets.select("report", "at", "result", F.posexplode(F.try_variant_get(
        "result", "$.Vulnerabilities", "array<variant>")).alias("nth", "v")).withColumn(
        "pos", F.array("at", F.col("nth").cast("bigint")))
    v = F.col("v")
    package, version = _get(v, "$.PkgName", "string", "unknown"), _get(
        v, "$.InstalledVersion", "string", "unknown")
    fixed = _get(v, "$.FixedVersion", "string", "")
    return _findings(
        rows, "trivy", rule_id=_get(v, "$.VulnerabilityID", "string", "unknown"),
        message=F.concat(package, F.lit("@"), version, F.lit(": "),
                         _get(v, "$.Description", "string", "")),
        severity=F.upper(_get(v, "$.Severity", "string", "UNKNOWN")), package=package,
        version=version, fix_versions=F.array(fixed),
        target=_get("result", "$.Target", "string", "unknown"), cwes=_texts(v, "$.CweIDs"),
        owasp_categories=_fixed(fv.COMPONENTS_CATEGORY),
        references=_texts(v, "$.References"))


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def read_findings(spark: SparkSession, paths: dict[str, list[tuple[str, str]]],
                  mapping_path: str) -> DataFrame:
    """All findings of ``{kind: [(path, source name), ...]}``.

    Kinds: semgrep, bandit, pip-audit, pnpm-audit, njsscan, trufflehog, trivy.
    """
    categories, _, tests = read_mapping(spark, mapping_path)
    readers = {
        "semgrep": lambda r, s: read_semgrep(r, categories),
        "bandit": lambda r, s: read_bandit(r, tests),
        "pip-audit": lambda r, s: read_pip_audit(r),
        "pnpm-audit": read_pnpm_audit, "njsscan": read_njsscan,
        "trufflehog": lambda r, s: read_trufflehog(r),
        "trivy": lambda r, s: read_trivy(r),
    }
    return union_findings([
        readers[kind](read_texts(spark, path, by_line=kind == "trufflehog"), source)
        for kind, places in paths.items() for path, source in places])


def findings_totals(findings: DataFrame) -> DataFrame:
    """Counts per source and severity with totals (NULL means all)."""
    return findings.rollup("source", "severity").agg(F.count("*").alias("n"))
