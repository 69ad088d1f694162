"""Registered queries on documents, sources, interchange files and checks."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from orderweave.operators import checks, extraction, interchange, resolution
from orderweave.operators.ordering import ordered_list
from orderweave.plans import fixtures as fx
from orderweave.plans import order_queries as oq
from orderweave.plans.fixtures import with_views
from orderweave.session import freed_shuffles, shared_dir, staged
from orderweave.sources import catalog as cat
from orderweave.sources import files as fl
from orderweave.sources import pages as pg
from orderweave.sources import sinks
from orderweave.sources.interchanges import read_interchanges
from orderweave.streaming.intake import start_intake
from orderweave.streaming.runs import stream_parquet

AS_OF = datetime(2024, 1, 30, 12, 0, 0)
RULES_AS_OF = date(1998, 6, 1)


# --- sources ------------------------------------------------------------------------

def clean_catalog(spark, sf):
    key = F.col("p_partkey")
    base = fx.catalog(spark, sf)
    raw = base.select(
        F.concat(F.lit(" "), "internal_code", F.lit("\t")).alias("internal_code"),
        F.concat("profile_name", F.lit("  ")).alias("profile_name"),
        F.when(key % 5 == 0, "  ").otherwise(F.col("alloy")).alias("alloy"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.lit(" "), F.col("width_mm").cast("string")))
        .alias("width_mm"),
        F.when(key % 9 == 0, "n/a").otherwise(F.col("height_mm").cast("string"))
        .alias("height_mm"), F.col("internal_code").alias("edi_pia_code"))
    known = {f.name for f in raw.schema}
    full = raw.select("*", *[F.lit("").alias(f.name) for f in cat.CSV_SCHEMA
                             if f.name not in known])
    return cat.clean_catalog(full).select(
        "internal_code", "profile_name", "alloy", "width_mm", "height_mm", "edi_pia_code",
        "category", "status")


def flatten_catalog(spark, sf):
    """Nested JSON catalog text, parsed and flattened to the CSV form."""
    base = fx.catalog(spark, sf)
    text = F.to_json(F.struct(
        "internal_code", "profile_name", "alloy",
        F.struct(F.col("width_mm").alias("width"), F.col("height_mm").alias("height"),
                 F.col("wall_thickness_mm").alias("wall_thickness")).alias("dimensions_mm"),
        F.array(F.lit(6000), (F.col("p_partkey") + 6000)).alias("standard_lengths_mm"),
        F.array(F.lit("M"), F.lit("AE2")).alias("surface_finishes"),
        F.col("internal_code").alias("edi_pia_code")))
    nested = base.select(F.from_json(text, cat.JSON_DDL).alias("r")).select("r.*")
    return cat.clean_catalog(cat.flatten_catalog(nested)).select(
        "internal_code", "profile_name", "alloy", "width_mm", "height_mm", "wall_thickness_mm",
        "standard_lengths_mm", "surface_finishes", "edi_pia_code")


def documents_from_pages(spark, sf):
    """Conversations as documents: turns are pages."""
    pages = fx.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"),
        F.concat(F.lit("c"), (F.col("conv_id") % 50).cast("string")).alias("customer"),
        F.when(F.col("turn") % 4 != 3, F.col("text")).alias("text"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("# "), "text")).alias("markdown"))
    return pg.documents_from_pages(pages, fx.customers(spark, sf)).select(
        "doc_id", "customer", "text")


def _files(spark, sf):
    """Web pages as stored files; every fifth keeps its query string."""
    bare = F.regexp_replace("url", "^https?://", "")
    path = F.when(F.col("page_id") % 5 == 0, bare).when(
        F.col("page_id") % 7 == 0, F.regexp_replace(bare, r"\?.*$", "")).otherwise(
        F.concat(F.regexp_replace(bare, r"\?.*$", ""), F.lit(".html")))
    return fx.table(spark, sf, "pages").select(
        path.alias("path"), F.octet_length("html").cast("bigint").alias("length"))


def file_manifest(spark, sf):
    return fl.file_manifest(_files(spark, sf))[0]


def file_manifest_children(spark, sf):
    return fl.file_manifest(_files(spark, sf), "/", recursive=False)[0]


def file_manifest_refused(spark, sf):
    return fl.file_manifest(_files(spark, sf), max_bytes=4000)[1]


def directory_totals(spark, sf):
    return fl.directory_totals(_files(spark, sf))


# --- table documents --------------------------------------------------------------------

def _drawn_lines(spark, sf, lines=None):
    """Order lines with the catalog code printed, as a table document shows them."""
    lines = fx.lines(spark, sf) if lines is None else lines
    items = fx.catalog(spark, sf).select(F.col("p_partkey").alias("l_partkey"), "internal_code",
                                         "profile_name", F.col("alloy").alias("item_alloy"))
    q = F.col("quantity")
    printed = (F.when(q.isNull(), None)
               .when(F.col("l_partkey") % 3 == 0, F.concat(q.cast("int").cast("string"),
                                                           F.lit(".000")))
               .when(F.col("l_partkey") % 3 == 1, F.concat(q.cast("int").cast("string"),
                                                           F.lit(",5")))
               .otherwise(q.cast("int").cast("string")))
    return lines.join(items, "l_partkey").withColumns({
        "no": F.lpad((F.col("line_no").cast("int")).cast("string"), 3, "0"),
        "printed": printed,
        "unit_word": F.element_at(F.array(*map(F.lit, ("Stk.", "kg", "m", "Stück", "STUCK"))),
                                  (F.col("l_partkey") % 5 + 1).cast("int"))})


def _table_documents(spark, sf, lines=None):
    block = F.concat_ws(
        "\n",
        F.concat("no", F.lit("  "), "internal_code", F.lit("   "), "profile_name"),
        F.concat(F.lit("  Werkstoff "), "item_alloy"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(
            F.lit("Länge: 6."), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"),
            F.lit(" mm"))),
        F.when(F.col("printed").isNotNull(), F.concat_ws(
            " ", "printed", "unit_word", F.lit("27,80 4.170,00"),
            F.date_format("delivery_date", "dd.MM.yyyy"))),
        F.when(F.col("printed").isNotNull(), "Preis je Einheit, netto"))
    blocks = _drawn_lines(spark, sf, lines).groupBy("order_id", "customer").agg(
        F.array_join(ordered_list(block, F.col("no")), "\n").alias("blocks"))
    heads = fx.orders(spark, sf).select(F.col("id").alias("order_id"), "order_ref", "order_date")
    return blocks.join(heads, "order_id").select(
        F.col("order_id").alias("doc_id"), "customer", F.concat_ws(
            "\n", F.lit("Bestellung"),
            F.concat(F.lit("BESTELL-NR.: "), "order_ref"),
            F.concat(F.lit("Bestelldatum: "), F.date_format("order_date", "dd.MM.yyyy")),
            "blocks", F.lit("Es gelten unsere Bedingungen.")).alias("text"))


def parse_order_tables(spark, sf):
    return extraction.parse_order_tables(_table_documents(spark, sf))[1].select(
        "doc_id", "line_no", "extracted_code", "description", "quantity", "unit", "unit_raw",
        "delivery_date", "length_mm", "alloy")


def parse_order_tables_orders(spark, sf):
    return extraction.parse_order_tables(_table_documents(spark, sf))[0].select(
        "doc_id", "customer", "source", "order_ref", "order_date", "delivery_date_default",
        "currency")


# --- model answers -------------------------------------------------------------------------

def _answers(spark, sf, lines=None):
    """Answers as a model writes them: bare, fenced, with talk around, or no JSON."""
    lines = fx.lines(spark, sf) if lines is None else lines
    line = F.struct(
        F.when(F.col("l_partkey") % 4 != 0, F.col("line_no")).alias("line_no"),
        F.col("extracted_code").alias("code"), F.coalesce("description", F.lit(""))
        .alias("description"),
        F.when(F.col("l_partkey") % 3 == 0, F.replace(F.col("quantity").cast("string"),
                                                      F.lit("."), F.lit(",")))
        .otherwise(F.col("quantity").cast("string")).alias("quantity"),
        F.when(F.col("unit") == "PCE", "Stück").when(F.col("unit") == "MTR", "mètres")
        .when(F.col("unit") == "KGM", "Kilograms").otherwise(F.col("unit")).alias("unit"),
        F.date_format("delivery_date", "dd/MM/yyyy").alias("delivery_date"),
        (F.col("l_partkey") % 7000).alias("length_mm"))
    lines = lines.groupBy("order_id", "customer").agg(
        ordered_list(line, F.col("line_no")).alias("lines"))
    heads = fx.orders(spark, sf).select(F.col("id").alias("order_id"), "order_ref",
                                        F.col("order_date").cast("string").alias("order_date"))
    text = F.to_json(F.struct("order_ref", "order_date", "lines"))
    mode = F.col("order_id") % 4
    answer = (F.when(mode == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
              .when(mode == 2, F.concat(F.lit("Here is the order: "), text, F.lit(" Done.")))
              .when((mode == 3) & (F.col("order_id") % 5 == 0), "Sorry, I cannot read this {")
              .otherwise(text))
    return lines.join(heads, "order_id").select(
        F.col("order_id").alias("doc_id"), "customer", F.lit("local_model").alias("source"),
        answer.alias("answer"))


def parse_json_payloads(spark, sf):
    return extraction.parse_json_payloads(_answers(spark, sf))[1].select(
        "doc_id", "line_no", "extracted_code", "description", "quantity", "unit",
        "delivery_date", "length_mm")


def parse_json_payloads_orders(spark, sf):
    return extraction.parse_json_payloads(_answers(spark, sf))[0].select(
        "doc_id", "order_ref", "order_date", "currency")


_UNITS = ("Stk", "piece(s)", "mètre", "KGS", "Tonnen", "unité", "???", "box", "ml")


def _raw_lines(spark, sf):
    part = F.col("l_partkey")
    day = F.col("l_shipdate")
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey",
        F.element_at(F.array(*map(F.lit, _UNITS)), (part % 9 + 1).cast("int")).alias("unit_raw"),
        F.when(part % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(part % 5 == 1, F.date_format(day, "d.M.yyyy"))
        .when(part % 5 == 2, F.date_format(day, "dd/MM/yyyy"))
        .when(part % 5 == 3, F.concat(F.lit("KW "), (part % 52 + 1).cast("string"), F.lit("/"),
                                      F.year(day).cast("string")))
        .otherwise("soon").alias("date_raw"),
        F.when(part % 4 == 0, F.replace(F.col("l_quantity").cast("string"), F.lit("."),
                                        F.lit(",")))
        .when(part % 4 == 1, "many").otherwise(F.col("l_quantity").cast("string"))
        .alias("quantity_raw"))


def standardise_lines(spark, sf):
    done, _ = extraction.standardise_lines(_raw_lines(spark, sf), 2024)
    return done.select("l_orderkey", "l_partkey", "unit", "delivery_date", "quantity")


def unmapped_values(spark, sf):
    return extraction.standardise_lines(_raw_lines(spark, sf), 2024)[1]


def _routed(spark, sf):
    """Lines, documents and answers are stored first, so that the steps' shuffled rows do not add up on disk."""
    lines = staged(fx.lines(spark, sf), "lines")
    docs = staged(_table_documents(spark, sf, lines), "documents")
    answers = staged(_answers(spark, sf, lines).where("doc_id % 6 <> 5").select("doc_id", "answer"), "answers")
    return extraction.route_extraction(docs, fx.customers(spark, sf), answers)


def route_extraction(spark, sf):
    return _routed(spark, sf)[1].select("doc_id", "trusted", "line_no", "extracted_code", "quantity")


def route_extraction_refused(spark, sf):
    return _routed(spark, sf)[2].select("doc_id", "extraction_strategy", "reason")


def provenance_log(spark, sf):
    orders = fx.orders(spark, sf).select(F.col("id").alias("order_id"), "customer", "order_ref",
                                         "order_date").withColumn("source", F.lit("text_parser"))
    lines = fx.lines(spark, sf).select("order_id", "line_no", "extracted_code", "quantity")
    log = sinks.provenance_log(orders, lines, AS_OF)
    # The whole payload, read back from its JSON text.
    payload = F.from_json("raw_payload", "customer string, order_ref string, order_date date, lines array<struct<"
                          "line_no: string, extracted_code: string, quantity: double>>").alias("p")
    return log.select("order_id", "customer", "source", payload).select(
        "order_id", "customer", "source", F.col("p.customer").alias("said_customer"), "p.order_ref", "p.order_date",
        F.array_join(F.transform("p.lines", lambda r: F.concat_ws(
            ":", r["line_no"], F.coalesce(r["extracted_code"], F.lit("-")),
            F.coalesce(r["quantity"].cast("decimal(20,2)").cast("string"), F.lit("-")))), ",").alias("lines"))


# --- interchange -----------------------------------------------------------------------------

def _edi_files(spark, sf, kept=False):
    """Generated messages, some of them broken on purpose."""
    text, key = F.col("edi_text"), F.col("order_id")
    broken = (F.when(key % 8 == 0, F.replace(text, F.lit("UNOA:2"), F.lit("UNOB:1")))
              .when(key % 8 == 1, F.replace(text, F.lit("BGM+220"), F.lit("BGM+231")))
              .when(key % 8 == 2, F.replace(text, F.lit("CNT+2:"), F.lit("CNT+2:9")))
              .when(key % 8 == 3, F.replace(text, F.lit("UNZ+1"), F.lit("UNZ+2")))
              .otherwise(text))
    return oq.generate_messages(spark, sf, kept).select(
        key.alias("file"), broken.alias("text"))


def edi_scan(spark, sf):
    return interchange.edi_scan(_edi_files(spark, sf)).select(
        "file", F.col("seq").cast("bigint").alias("seq"), "tag", "interchange_no", "message_no", "line_index",
        F.array_join(F.transform("fields", lambda e: F.array_join(e, ":")), "+").alias("segment"))


def edi_lines(spark, sf):
    return interchange.edi_lines(interchange.edi_scan(_edi_files(spark, sf))).select(
        "file", "line_index", "pia_code", "description", "quantity", "unit", "length_mm",
        "date_text")


def edi_validate(spark, sf):
    _, verdicts = interchange.edi_validate(_edi_files(spark, sf), fx.catalog(spark, sf), RULES_AS_OF)
    return verdicts.select("file", "accepted", F.array_join("rules", "|").alias("rules"))


_BULK = 40


def edi_validate_bulk(spark, sf):
    """All interchanges in 40 files, written as the bulk export does and read back.

    Lines and messages are stored first, so that the steps' shuffled rows do not add up on disk.
    """
    out = shared_dir(spark, "bulk")
    files = staged(_edi_files(spark, sf, kept=True), "messages")
    with freed_shuffles(spark):
        (files.select(
            (F.col("file") % _BULK).alias("bulk"), "file", F.regexp_replace("text", "\n$", "").alias("text"))
            .repartition("bulk").sortWithinPartitions("bulk", "file").select("bulk", "text")
            .write.partitionBy("bulk").text(out, compression="gzip"))
    _, verdicts = interchange.edi_validate(
        read_interchanges(spark, f"{out}/bulk=*"), fx.catalog(spark, sf), RULES_AS_OF)
    name = F.concat(F.lit("bulk"), F.regexp_extract("file", r"bulk=(\d+)", 1))
    return verdicts.select(name.alias("file"), "interchange_no", "accepted",
                           F.array_join("rules", "|").alias("rules"))


_RULE_BREAKS = (
    # rule, what is looked for in the message, what takes its place
    ("R1", r"UNOA:2", "UNOB:1"), ("R2", r"(UNB\+[^']*?\+)4012345123456", "$19"),
    ("R3", r"(UNB\+[^']*\+)\d{6}:", "$1261340:"), ("R4", r"D:96A", "D:97A"),
    ("R5", r"BGM\+220", "BGM+231"), ("R6", r"(?s)LIN\+.*(?=UNS\+S)", ""),
    ("R7", r"CNT\+2:", "CNT+2:9"), ("R8", r"UNT\+", "UNT+9"), ("R9", r"UNZ\+1", "UNZ+2"),
    ("L1", r"PIA\+1[^']*'\n", ""), ("L2", r"(PIA\+1\+[^':]*):SA", "$1:BP"),
    ("L3", r"PIA\+1\+[^':]*", "PIA+1+NONE"), ("L4", r"QTY\+21:", "QTY+21:x"),
    ("L5", r"(QTY\+21:[^':]*):[A-Za-z]+", "$1:BOX"), ("L6", r"DTM\+2:", "DTM+2:x"))


def edi_validate_rules(spark, sf):
    """Every one of the sixteen rules broken in some messages."""
    text, kind = F.col("edi_text"), F.col("order_id") % 17
    for number, (_, pattern, instead) in enumerate(_RULE_BREAKS):
        text = F.when(kind == number, F.regexp_replace("edi_text", pattern, instead)).otherwise(text)
    # More lines than a message may have; they hold nothing else.
    text = F.when((kind == 15) & (F.col("order_id") % 5 == 0), F.replace(
        F.col("edi_text"), F.lit("UNS+S'"), F.concat(F.repeat(F.lit("LIN+1'\n"), F.lit(1000)), F.lit("UNS+S'")))).otherwise(text)
    files = oq.generate_messages(spark, sf).select(F.col("order_id").alias("file"), text.alias("text"))
    _, verdicts = interchange.edi_validate(files, fx.catalog(spark, sf), RULES_AS_OF)
    return verdicts.select("file", "accepted", F.array_join("rules", "|").alias("rules"))


def edi_violations(spark, sf):
    broken, _ = interchange.edi_validate(_edi_files(spark, sf), fx.catalog(spark, sf), RULES_AS_OF)
    return broken.select("file", "rule", "line_index", "code")


# --- checks --------------------------------------------------------------------------------------

def extraction_score(spark, sf):
    items = fx.catalog(spark, sf).select(F.col("p_partkey").alias("l_partkey"), "internal_code")
    lines = resolution.match_exact(fx.lines(spark, sf), fx.catalog(spark, sf)).join(
        items, "l_partkey")
    keys = [F.col("order_id").alias("doc_id"), F.col("line_no").alias("pos"), "customer",
            F.when(F.col("trusted"), "table_text").otherwise("local_model").alias("strategy")]
    truth = lines.select(
        *keys, F.when(F.col("l_partkey") % 8 == 0, F.concat(
            F.lit("CUSTOM-"), F.col("l_partkey").cast("string")))
        .otherwise(F.col("internal_code")).alias("expected_code"),
        F.coalesce("unit", F.lit("PCE")).alias("expected_unit"))
    got = lines.where("l_partkey % 12 <> 7").select(
        *keys, F.col("exact_code").alias("resolved_internal_code"), "unit")
    active = fx.catalog(spark, sf).where("status = 'A'")
    return checks.extraction_score(got, truth, active)


def _versions(spark, sf):
    old = fx.lines(spark, sf).select(F.col("order_id").alias("order_ref"), "line_no", "quantity",
                                     "delivery_date", "l_partkey")
    k = F.col("l_partkey") % 11
    new = old.where((k != 0) & (F.col("order_ref") % 50 != 0)).select(
        "order_ref", "line_no",
        F.when(k.isin(1, 3), F.col("quantity") + 5).otherwise(F.col("quantity"))
        .alias("quantity"),
        F.when(k.isin(2, 3), F.date_add("delivery_date", 7)).otherwise(F.col("delivery_date"))
        .alias("delivery_date"))
    added = old.where("l_partkey % 11 = 4").select(
        "order_ref", F.concat("line_no", F.lit("n")).alias("line_no"), "quantity",
        "delivery_date")
    return old, new.unionByName(added)


def order_change_lines(spark, sf):
    return checks.order_change_diff(*_versions(spark, sf))[0].select(
        "order_ref", "line_no", "change", "old_quantity", "new_quantity")


def order_change_diff(spark, sf):
    return checks.order_change_diff(*_versions(spark, sf))[1]


def _chain(spark, sf):
    """Four versions of orders: changed, some cancelled, reopened, new lines."""
    old = staged(fx.lines(spark, sf).select(F.col("order_id").alias("order_ref"), "line_no", "quantity", "delivery_date", "l_partkey"), "lines")
    v, k, ref = F.col("version"), F.col("l_partkey") % 11, F.col("order_ref")
    every = old.select("*", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3, 4)])).alias("version"))
    # Orders divisible by 7 have no second version, those by 10 are cancelled in the third.
    exists = ~((ref % 7 == 0) & (v == 2))
    lines = every.where(exists & ~((ref % 10 == 0) & (v == 3)) & ~((ref % 15 == 0) & (v >= 3)) & ~((k == 0) & (v == 2))).select(
        "order_ref", "version", "line_no",
        F.when((k == 1) & (v >= 3), F.col("quantity") + v).otherwise(F.col("quantity")).alias("quantity"),
        F.when((k == 2) & (v == 4), F.date_add("delivery_date", 7)).otherwise(F.col("delivery_date")).alias("delivery_date"))
    return every.where(exists).select("order_ref", "version").distinct(), lines


def order_change_chain(spark, sf):
    return checks.order_change_chain(*_chain(spark, sf))[1]


def order_chain_lines(spark, sf):
    return checks.order_change_chain(*_chain(spark, sf))[0].select(
        "order_ref", "version", "line_no", "change", "old_quantity", "new_quantity")


def latest_lines(spark, sf):
    return checks.latest_lines(*_chain(spark, sf))


def compare_extractions(spark, sf):
    a = fx.lines(spark, sf).withColumnRenamed("order_id", "doc_id")
    b = a.withColumns({
        "quantity": F.when(F.col("l_partkey") % 13 == 0, F.col("quantity") - 20)
        .otherwise(F.col("quantity")),
        "unit": F.when(F.col("l_partkey") % 17 == 0, "MTR").otherwise(F.col("unit"))})
    a, b = a.where("l_partkey % 29 <> 0"), b.where("l_partkey % 31 <> 0")
    return checks.compare_extractions(a, b, ["quantity", "unit"])


def qty_plausibility(spark, sf):
    weights = fx.catalog(spark, sf).withColumn(
        "weight_kg_per_m", (F.col("p_partkey") % 50 + 1) / 10)
    lines = resolution.match_exact(fx.lines(spark, sf), weights).withColumnRenamed(
        "exact_code", "resolved_internal_code")
    lines = lines.withColumn("length_mm", F.when(
        F.col("l_partkey") % 4 != 0, (F.col("l_partkey") % 6 + 1) * 1000.0))
    found = checks.qty_plausibility(lines, weights)
    return found.select("order_id", "line_no", *[
        F.round(c, 3).alias(c) for c in ("kg", "metres", "pieces")], "outlier")


# --- streaming -------------------------------------------------------------------------------------

def intake_stream(spark, sf):
    """Table documents of all orders through the intake, then read back."""
    stored, out = shared_dir(spark, "documents"), shared_dir(spark, "intake")
    lines = staged(fx.lines(spark, sf), "lines")
    docs = _table_documents(spark, sf, lines).select(F.col("doc_id").cast("string").alias("doc_id"),
                                                     "customer", "text")
    with freed_shuffles(spark):
        docs.write.parquet(stored, compression="zstd")
    customers = fx.customers(spark, sf).withColumn("extraction_strategy", F.lit("table_text"))
    query = start_intake(
        stream_parquet(spark, stored), customers, fx.catalog(spark, sf),
        fx.aliases(lines), out, shared_dir(spark, "intake-state"), every=None)
    query.awaitTermination()
    return spark.read.parquet(f"{out}/lines").groupBy("match_tier").agg(
        F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    clean_catalog, flatten_catalog, documents_from_pages, file_manifest,
    file_manifest_children, file_manifest_refused, directory_totals, parse_order_tables,
    parse_order_tables_orders, parse_json_payloads, parse_json_payloads_orders,
    standardise_lines, unmapped_values, route_extraction, route_extraction_refused,
    provenance_log, edi_scan, edi_lines, edi_validate, edi_validate_bulk, edi_validate_rules, edi_violations, extraction_score,
    order_change_lines, order_change_diff, order_change_chain, order_chain_lines, latest_lines, compare_extractions, qty_plausibility,
    intake_stream)}


# --- oracle ------------------------------------------------------------------------------------------

_FILES = {"f": """
    SELECT CASE WHEN page_id % 5 = 0 THEN bare
                WHEN page_id % 7 = 0 THEN regexp_replace(bare, '\\?.*$', '')
                ELSE concat(regexp_replace(bare, '\\?.*$', ''), '.html') END AS path,
           CAST(strlen(html) AS BIGINT) AS length
    FROM (SELECT *, regexp_replace(url, '^https?://', '') AS bare FROM pages)""",
    "j": """SELECT *, CASE
                WHEN NOT regexp_full_match(path, '[\\w\\-./]+') OR path LIKE '%//%'
                     OR path LIKE '/%' OR path LIKE '%/' THEN 'invalid_path'
                WHEN NOT regexp_matches(path, '[^/.]\\.[^./]+$') THEN 'no_extension' END AS reason
            FROM f"""}
_DRAWN = {"drawn": """
    SELECT l.order_id, lpad(CAST(CAST(l.line_no AS INT) AS STRING), 3, '0') AS no,
           c.internal_code, c.profile_name, c.alloy AS item_alloy, l.quantity AS q, l.l_partkey AS p,
           l.delivery_date, l.customer
    FROM fx_lines l JOIN fx_catalog c ON c.p_partkey = l.l_partkey""",
    "parsed": """SELECT order_id, no, internal_code, p, delivery_date, q, item_alloy, customer,
           CASE p % 3 WHEN 0 THEN q * 1000 WHEN 1 THEN q + 0.5 ELSE q END AS quantity,
           CASE p % 5 WHEN 0 THEN 'Stk.' WHEN 1 THEN 'kg' WHEN 2 THEN 'm' WHEN 3 THEN 'Stück'
                ELSE 'STUCK' END AS word,
           concat(profile_name, ' Werkstoff ', item_alloy, CASE WHEN p % 2 = 0 THEN
               concat(' Länge: 6.', lpad(CAST(p % 1000 AS STRING), 3, '0'), ' mm') ELSE '' END,
               -- Without a quantity row the last position takes in the closing words.
               CASE WHEN q IS NULL AND no = max(no) OVER (PARTITION BY order_id)
                    THEN ' Es gelten unsere Bedingungen.' ELSE '' END)
               AS description FROM drawn"""}
_ANSWERED = {"ans": """
    SELECT order_id, l_partkey AS p, line_no, extracted_code, description, quantity, unit,
           delivery_date, row_number() OVER (PARTITION BY order_id ORDER BY line_no) AS k
    FROM fx_lines WHERE NOT (order_id % 4 = 3 AND order_id % 5 = 0)"""}
_RAW = {"raw": """
    SELECT l_orderkey, l_partkey, l_quantity, l_shipdate, l_partkey % 9 AS u, l_partkey % 5 AS d,
           l_partkey % 4 AS q, l_partkey % 52 + 1 AS w, year(l_shipdate) AS y FROM lineitem"""}
_WEEK = ("CAST(date_trunc('week', make_date(y, 1, 4)) AS DATE) + CAST((w - 1) * 7 AS INT)")
_EDI = {**oq._MESSAGE, "cat_active":
        "SELECT DISTINCT upper(trim(internal_code)) AS code FROM fx_catalog WHERE status = 'A'"}
_LINE_RULES = {
    **_EDI,
    "lr": """SELECT s.order_id, s.k, s.code,
                CASE WHEN c.code IS NULL THEN 'L3' END AS l3,
                CASE WHEN NOT s.q > 0 THEN 'L4' END AS l4,
                CASE WHEN coalesce(s.unit, 'PCE') NOT IN ('PCE','MTR','KGM','TNE') THEN 'L5' END
                    AS l5,
                CASE WHEN s.delivery_date < DATE '1997-12-01' THEN 'L6' END AS l6
             FROM seg s JOIN msg m ON m.order_id = s.order_id
             LEFT JOIN cat_active c ON c.code = upper(trim(s.code))""",
}
_VERSIONS = {
    "old_v": """SELECT order_id AS order_ref, line_no, quantity, delivery_date, l_partkey % 11 AS k
                FROM fx_lines""",
    "new_v": """SELECT order_ref, line_no, CASE WHEN k IN (1, 3) THEN quantity + 5 ELSE quantity END
                    AS quantity, CASE WHEN k IN (2, 3) THEN delivery_date + 7
                                 ELSE delivery_date END AS delivery_date
                FROM old_v WHERE k <> 0 AND order_ref % 50 <> 0
                UNION ALL SELECT order_ref, concat(line_no, 'n'), quantity, delivery_date
                FROM old_v WHERE k = 4""",
    "pairs": """SELECT coalesce(o.order_ref, n.order_ref) AS order_ref,
                       coalesce(o.line_no, n.line_no) AS line_no,
                       o.order_ref IS NOT NULL AS was, n.order_ref IS NOT NULL AS now_there,
                       o.quantity AS oq, n.quantity AS nq, o.delivery_date AS od,
                       n.delivery_date AS nd
                FROM old_v o FULL JOIN new_v n
                  ON n.order_ref = o.order_ref AND n.line_no = o.line_no""",
    "changes": """
        SELECT *, 'line_added' AS change FROM pairs WHERE NOT was
        UNION ALL SELECT *, 'line_cancelled' FROM pairs WHERE NOT now_there
        UNION ALL SELECT *, 'quantity_changed' FROM pairs
                  WHERE was AND now_there AND oq IS DISTINCT FROM nq
        UNION ALL SELECT *, 'date_moved' FROM pairs
                  WHERE was AND now_there AND od IS DISTINCT FROM nd""",
}
_CHAIN = {
    "ev": """SELECT order_id AS r, l_partkey % 11 AS k, line_no, quantity, delivery_date, v
             FROM fx_lines CROSS JOIN (VALUES (1), (2), (3), (4)) t(v)
             WHERE NOT (order_id % 7 = 0 AND v = 2)""",
    "ch": "SELECT r, v, lag(v) OVER (PARTITION BY r ORDER BY v) AS b FROM (SELECT DISTINCT r, v FROM ev)",
    "li": """SELECT r, v, line_no, CASE WHEN k = 1 AND v >= 3 THEN quantity + v ELSE quantity END AS q,
                    CASE WHEN k = 2 AND v = 4 THEN delivery_date + 7 ELSE delivery_date END AS d
             FROM ev WHERE NOT (r % 10 = 0 AND v = 3) AND NOT (r % 15 = 0 AND v >= 3) AND NOT (k = 0 AND v = 2)""",
    # Every line number that a version or the one before it has, with both of its states.
    "st": """SELECT ch.r, ch.v, n.line_no, o.line_no IS NOT NULL AS was, w.line_no IS NOT NULL AS there,
                    o.q AS oq, w.q AS nq, o.d AS od, w.d AS nd
             FROM ch JOIN (SELECT DISTINCT r, line_no FROM li) n ON n.r = ch.r
             LEFT JOIN li o ON o.r = ch.r AND o.v = ch.b AND o.line_no = n.line_no
             LEFT JOIN li w ON w.r = ch.r AND w.v = ch.v AND w.line_no = n.line_no""",
}
_SCORE = {
    **oq._EXACT,
    "pair": """SELECT e.order_id, e.customer,
                      CASE WHEN e.trusted THEN 'table_text' ELSE 'local_model' END AS strategy,
                      CASE WHEN e.l_partkey % 8 = 0 THEN NULL WHEN c.status = 'A'
                           THEN c.internal_code END AS want,
                      coalesce(e.unit, 'PCE') AS want_unit, e.l_partkey % 12 <> 7 AS made,
                      CASE WHEN e.l_partkey % 12 <> 7 THEN e.resolved END AS got, e.unit
               FROM ex e JOIN fx_catalog c ON c.p_partkey = e.l_partkey""",
    "docs": """SELECT customer, strategy, order_id, count(*) AS expected,
                      count(*) FILTER (WHERE made) AS produced,
                      count(want) AS catalog_lines,
                      count(*) FILTER (WHERE got = want) AS code_ok,
                      count(*) FILTER (WHERE got <> want) AS code_wrong,
                      count(*) FILTER (WHERE want IS NULL AND got IS NOT NULL) AS false_positive,
                      count(*) FILTER (WHERE made AND unit IS NOT DISTINCT FROM want_unit)
                          AS unit_ok
               FROM pair GROUP BY 1, 2, 3""",
}
_QTY = {
    **oq._EXACT,
    "m": """SELECT e.order_id, e.line_no, e.resolved, e.quantity AS q, e.unit,
                   (c.p_partkey % 50 + 1) / 10.0::DOUBLE AS w,
                   CASE WHEN e.l_partkey % 4 <> 0 THEN (e.l_partkey % 6 + 1)::DOUBLE END AS len
            FROM ex e LEFT JOIN fx_catalog c ON c.internal_code = e.resolved""",
    "mm": """SELECT *, CASE unit WHEN 'MTR' THEN q WHEN 'PCE' THEN q * len WHEN 'KGM' THEN q / w
                            WHEN 'TNE' THEN q * 1000 / w END AS metres FROM m""",
    "kk": """SELECT *, CASE unit WHEN 'KGM' THEN q WHEN 'TNE' THEN q * 1000
                            ELSE metres * w END AS kg,
                    CASE WHEN unit = 'PCE' THEN q ELSE metres / len END AS pieces FROM mm""",
    "mean": "SELECT resolved, avg(kg) AS mean_kg FROM kk WHERE resolved IS NOT NULL GROUP BY 1",
}

ORACLE = {
    "clean_catalog": with_views("fx_catalog", {}, """
        SELECT internal_code, profile_name, CASE WHEN p_partkey % 5 <> 0 THEN alloy END AS alloy,
               CASE WHEN p_partkey % 7 <> 0 THEN width_mm END AS width_mm,
               CASE WHEN p_partkey % 9 <> 0 THEN height_mm END AS height_mm,
               internal_code AS edi_pia_code, CAST(NULL AS STRING) AS category, 'A' AS status
        FROM fx_catalog"""),
    "flatten_catalog": with_views("fx_catalog", {}, """
        SELECT internal_code, profile_name, alloy, width_mm, height_mm, wall_thickness_mm,
               concat('6000|', p_partkey + 6000) AS standard_lengths_mm,
               'M|AE2' AS surface_finishes, internal_code AS edi_pia_code FROM fx_catalog"""),
    "documents_from_pages": with_views("fx_customers", {"d": """
        SELECT conv_id AS doc_id, concat('c', conv_id % 50) AS customer,
               string_agg(CASE WHEN turn % 4 <> 3 THEN text ELSE '' END, chr(10) ORDER BY turn)
                   AS plain,
               string_agg(CASE WHEN conv_id % 2 = 0 THEN concat('# ', text) ELSE '' END, chr(10)
                   ORDER BY turn) AS marked
        FROM conversations GROUP BY 1, 2"""}, """
        SELECT d.doc_id, d.customer, CASE WHEN c.extraction_strategy <> 'table_text'
               AND d.doc_id % 2 = 0 THEN marked ELSE plain END AS text
        FROM d LEFT JOIN fx_customers c ON c.code = d.customer"""),
    "file_manifest": with_views("", _FILES, """
        SELECT path AS entry, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes,
               CASE WHEN path LIKE '%.html' THEN 'text/html' ELSE 'application/octet-stream' END
                   AS media_type FROM j WHERE reason IS NULL GROUP BY path"""),
    "file_manifest_children": with_views("", _FILES, """
        SELECT regexp_extract(path, '^[^/]+/?') AS entry, count(*) AS files,
               CAST(sum(length) AS BIGINT) AS bytes, CASE WHEN path NOT LIKE '%/%'
                   THEN 'text/html' END AS media_type
        FROM j WHERE reason IS NULL GROUP BY 1, 4"""),
    "file_manifest_refused": with_views("", _FILES, """
        SELECT path, length, coalesce(reason, 'too_large') AS reason FROM j
        WHERE reason IS NOT NULL OR length > 4000"""),
    "directory_totals": with_views("", _FILES, """
        SELECT regexp_extract(path, '^(.*/)?[^/]*$', 1) AS directory, count(*) AS files,
               CAST(sum(length) AS BIGINT) AS bytes FROM f GROUP BY 1"""),
    "parse_order_tables": with_views("fx_lines", _DRAWN, """
        SELECT order_id AS doc_id, no AS line_no, internal_code AS extracted_code, description,
               quantity, CASE WHEN q IS NOT NULL THEN CASE word WHEN 'Stk.' THEN 'PCE'
                   WHEN 'kg' THEN 'KGM' WHEN 'm' THEN 'MTR' WHEN 'Stück' THEN 'PCE' END END AS unit,
               CASE WHEN q IS NOT NULL THEN word END AS unit_raw,
               CASE WHEN q IS NOT NULL THEN delivery_date END AS delivery_date,
               CASE WHEN p % 2 = 0 THEN (6000 + p % 1000)::DOUBLE END AS length_mm,
               item_alloy AS alloy FROM parsed"""),
    "parse_order_tables_orders": with_views("fx_lines fx_orders", {}, """
        SELECT id AS doc_id, customer, 'text_parser' AS source, order_ref, order_date,
               CAST(NULL AS DATE) AS delivery_date_default, currency FROM fx_orders
        WHERE id IN (SELECT order_id FROM fx_lines)"""),
    "parse_json_payloads": with_views("fx_lines", _ANSWERED, """
        SELECT order_id AS doc_id, CASE WHEN p % 4 <> 0 THEN line_no
                   ELSE lpad(CAST(k * 10 AS STRING), 3, '0') END AS line_no, extracted_code,
               description, quantity, CASE WHEN unit <> 'box' THEN unit END AS unit,
               delivery_date, (p % 7000)::DOUBLE AS length_mm FROM ans"""),
    "parse_json_payloads_orders": with_views("fx_lines fx_orders", {}, """
        SELECT id AS doc_id, CASE WHEN NOT (id % 4 = 3 AND id % 5 = 0) THEN order_ref END
                   AS order_ref, CASE WHEN NOT (id % 4 = 3 AND id % 5 = 0) THEN order_date END
                   AS order_date, 'EUR' AS currency FROM fx_orders
        WHERE id IN (SELECT order_id FROM fx_lines)"""),
    "standardise_lines": with_views("", _RAW, f"""
        SELECT l_orderkey, l_partkey,
               CASE u WHEN 0 THEN 'PCE' WHEN 1 THEN 'PCE' WHEN 2 THEN 'MTR' WHEN 3 THEN 'KGM'
                    WHEN 4 THEN 'TNE' WHEN 5 THEN 'PCE' WHEN 8 THEN 'MTR' END AS unit,
               CASE WHEN d < 3 THEN CAST(l_shipdate AS DATE) WHEN d = 3 THEN {_WEEK} END
                   AS delivery_date,
               CASE WHEN q <> 1 THEN l_quantity END AS quantity FROM raw"""),
    "unmapped_values": with_views("", _RAW, """
        SELECT 'unit' AS kind, CASE u WHEN 6 THEN '???' ELSE 'box' END AS raw_value,
               count(*) AS n FROM raw WHERE u IN (6, 7) GROUP BY 1, 2
        UNION ALL SELECT 'date', 'soon', count(*) FROM raw WHERE d = 4 HAVING count(*) > 0
        UNION ALL SELECT 'quantity', 'many', count(*) FROM raw WHERE q = 1
                  HAVING count(*) > 0"""),
    "route_extraction": with_views("fx_lines fx_customers", {**_DRAWN, **_ANSWERED}, """
        SELECT p.order_id AS doc_id, true AS trusted, no AS line_no, internal_code AS extracted_code, p.quantity
        FROM parsed p JOIN fx_customers c ON c.code = p.customer
        WHERE c.extraction_strategy = 'table_text'
        UNION ALL SELECT a.order_id, false, CASE WHEN a.p % 4 <> 0 THEN a.line_no
                   ELSE lpad(CAST(a.k * 10 AS STRING), 3, '0') END, a.extracted_code, a.quantity
        FROM ans a JOIN fx_lines l ON l.order_id = a.order_id AND l.line_no = a.line_no
        JOIN fx_customers c ON c.code = l.customer
        WHERE c.extraction_strategy <> 'table_text' AND a.order_id % 6 <> 5"""),
    "route_extraction_refused": with_views("fx_lines fx_customers", {}, """
        SELECT DISTINCT l.order_id AS doc_id, c.extraction_strategy, 'no_answer' AS reason
        FROM fx_lines l JOIN fx_customers c ON c.code = l.customer
        WHERE c.extraction_strategy <> 'table_text' AND l.order_id % 6 = 5"""),
    "provenance_log": with_views("fx_lines fx_orders", {}, """
        SELECT o.id AS order_id, o.customer, 'text_parser' AS source, o.customer AS said_customer, o.order_ref, o.order_date,
               coalesce(string_agg(concat(l.line_no, ':', coalesce(l.extracted_code, '-'), ':',
                   coalesce(CAST(CAST(l.quantity AS DECIMAL(20,2)) AS STRING), '-')), ',' ORDER BY l.line_no)
                   FILTER (WHERE l.line_no IS NOT NULL), '') AS lines
        FROM fx_orders o LEFT JOIN fx_lines l ON l.order_id = o.id GROUP BY o.id, o.customer, o.order_ref, o.order_date"""),
    "edi_scan": with_views("fx_lines fx_orders", {**oq._MESSAGE, "rows_": """
        SELECT order_id AS file, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS seq
        FROM (SELECT order_id, rtrim(CASE order_id % 8 WHEN 0 THEN replace(edi_text, 'UNOA:2', 'UNOB:1')
            WHEN 1 THEN replace(edi_text, 'BGM+220', 'BGM+231') WHEN 2 THEN replace(edi_text, 'CNT+2:', 'CNT+2:9')
            WHEN 3 THEN replace(edi_text, 'UNZ+1', 'UNZ+2') ELSE edi_text END, chr(10)) AS t FROM full_msg)"""}, """
        SELECT file, seq, left(s, 3) AS tag, 1 AS interchange_no, CASE WHEN seq = 1 THEN 0 ELSE 1 END AS message_no,
               CASE WHEN NOT ended AND k > 0 THEN k END AS line_index,
               -- Without the terminator and the signs that release others.
               regexp_replace(left(s, length(s) - 1), '[?](.)', '\\1', 'g') AS segment
        FROM (SELECT *, CAST(sum(CASE WHEN left(s, 3) = 'LIN' THEN 1 ELSE 0 END) OVER w AS INT) AS k,
                     max(left(s, 3) IN ('UNS', 'UNZ')) OVER w AS ended
              FROM rows_ WINDOW w AS (PARTITION BY file ORDER BY seq))"""),
    "edi_lines": with_views("fx_lines fx_orders", _EDI, """
        SELECT s.order_id AS file, s.k AS line_index, s.code AS pia_code, s.description,
               s.q AS quantity, coalesce(s.unit, 'PCE') AS unit,
               CASE WHEN s.len_mm <> 0 THEN s.len_mm END AS length_mm,
               strftime(s.delivery_date, '%Y%m%d') AS date_text
        FROM seg s JOIN msg m ON m.order_id = s.order_id"""),
    "edi_validate": with_views("fx_lines fx_orders", {**_LINE_RULES, "v": """
        SELECT order_id, concat_ws('|', max(l3), max(l4), max(l5), max(l6),
            CASE order_id % 8 WHEN 0 THEN 'R1' WHEN 1 THEN 'R5' WHEN 2 THEN 'R7'
                 WHEN 3 THEN 'R9' END) AS rules FROM lr GROUP BY order_id"""}, """
        SELECT order_id AS file, rules = '' AS accepted, rules FROM v"""),
    "edi_validate_bulk": with_views("fx_lines fx_orders", {**_LINE_RULES, "v": """
        SELECT order_id, concat_ws('|', max(l3), max(l4), max(l5), max(l6),
            CASE order_id % 8 WHEN 0 THEN 'R1' WHEN 1 THEN 'R5' WHEN 2 THEN 'R7'
                 WHEN 3 THEN 'R9' END) AS rules FROM lr GROUP BY order_id"""}, """
        SELECT concat('bulk', order_id % 40) AS file,
               row_number() OVER (PARTITION BY order_id % 40 ORDER BY order_id) AS interchange_no,
               rules = '' AS accepted, rules FROM v"""),
    "edi_validate_rules": with_views("fx_lines fx_orders", {**_LINE_RULES, "v": """
        SELECT order_id, CAST(order_id % 17 AS INT) AS kind, order_id % 17 = 15 AND order_id % 5 = 0 AS many,
               max(l3) AS l3, max(l4) AS l4, max(l5) AS l5, max(l6) AS l6 FROM lr GROUP BY order_id""",
        "u": """
        SELECT order_id, list_sort(list_distinct(list_filter(CASE
            WHEN kind = 5 THEN ['R6', 'R7', 'R8']
            WHEN kind = 9 THEN ['L1', 'R8', l4, l5, l6]
            WHEN kind = 10 THEN ['L2', l3, l4, l5, l6]
            WHEN kind = 11 THEN ['L3', l4, l5, l6]
            WHEN kind = 12 THEN ['L4', l3, l5, l6]
            WHEN kind = 13 THEN ['L5', l3, l4, l6]
            WHEN kind = 14 THEN ['L6', l3, l4, l5]
            WHEN many THEN ['L1', 'L4', 'L5', 'L6', 'L7', 'R7', 'R8', l3]
            ELSE [l3, l4, l5, l6, CASE kind WHEN 0 THEN 'R1' WHEN 1 THEN 'R2' WHEN 2 THEN 'R3'
                WHEN 3 THEN 'R4' WHEN 4 THEN 'R5' WHEN 6 THEN 'R7' WHEN 7 THEN 'R8' WHEN 8 THEN 'R9' END]
            END, lambda x: x IS NOT NULL))) AS rules FROM v"""}, """
        SELECT order_id AS file, len(rules) = 0 AS accepted, array_to_string(rules, '|') AS rules FROM u"""),
    "edi_violations": with_views("fx_lines fx_orders", _LINE_RULES, """
        SELECT order_id AS file, l3 AS rule, k AS line_index, code FROM lr WHERE l3 IS NOT NULL
        UNION ALL SELECT order_id, l4, k, code FROM lr WHERE l4 IS NOT NULL
        UNION ALL SELECT order_id, l5, k, code FROM lr WHERE l5 IS NOT NULL
        UNION ALL SELECT order_id, l6, k, code FROM lr WHERE l6 IS NOT NULL
        UNION ALL SELECT DISTINCT order_id, CASE order_id % 8 WHEN 0 THEN 'R1' WHEN 1 THEN 'R5'
            WHEN 2 THEN 'R7' ELSE 'R9' END, NULL, NULL FROM lr WHERE order_id % 8 < 4"""),
    "extraction_score": with_views("fx_lines", _SCORE, """
        SELECT customer, strategy, count(*) AS documents,
               count(*) FILTER (WHERE expected = produced) AS line_count_ok,
               CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(produced) AS BIGINT) AS produced,
               CAST(sum(catalog_lines) AS BIGINT) AS catalog_lines,
               CAST(sum(code_ok) AS BIGINT) AS code_ok,
               CAST(sum(code_wrong) AS BIGINT) AS code_wrong,
               CAST(sum(false_positive) AS BIGINT) AS false_positive,
               CAST(sum(unit_ok) AS BIGINT) AS unit_ok FROM docs GROUP BY 1, 2"""),
    "order_change_lines": with_views("fx_lines", _VERSIONS, """
        SELECT order_ref, line_no, change, oq AS old_quantity, nq AS new_quantity FROM changes"""),
    "order_change_diff": with_views("fx_lines", {**_VERSIONS, "per": """
        SELECT p.order_ref, count(*) FILTER (WHERE was) AS old_lines,
               count(*) FILTER (WHERE now_there) AS new_lines,
               count(*) FILTER (WHERE NOT was) AS line_added,
               count(*) FILTER (WHERE NOT now_there) AS line_cancelled,
               count(*) FILTER (WHERE was AND now_there AND oq IS DISTINCT FROM nq)
                   AS quantity_changed,
               count(*) FILTER (WHERE was AND now_there AND od IS DISTINCT FROM nd) AS date_moved
        FROM pairs p GROUP BY 1"""}, """
        SELECT *, CASE WHEN old_lines = 0 THEN 'new_order' WHEN new_lines = 0
                       THEN 'order_cancelled'
                       WHEN line_added + line_cancelled + quantity_changed + date_moved > 0
                       THEN 'possible_change' ELSE 'unchanged' END AS verdict FROM per"""),
    "order_change_chain": with_views("fx_lines", {**_CHAIN, "per": """
        SELECT r, v, count(*) FILTER (WHERE there AND NOT was) AS line_added,
               count(*) FILTER (WHERE was AND NOT there) AS line_cancelled,
               count(*) FILTER (WHERE was AND there AND oq IS DISTINCT FROM nq) AS quantity_changed,
               count(*) FILTER (WHERE was AND there AND od IS DISTINCT FROM nd) AS date_moved,
               count(*) FILTER (WHERE was) AS old_lines, count(*) FILTER (WHERE there) AS new_lines
        FROM st GROUP BY 1, 2"""}, """
        SELECT ch.r AS order_ref, ch.v AS version, b AS before, line_added, line_cancelled, quantity_changed, date_moved,
               old_lines, new_lines, CASE WHEN b IS NULL THEN 'new_order'
                   WHEN old_lines + new_lines = 0 THEN 'still_cancelled' WHEN old_lines = 0 THEN 'order_reopened'
                   WHEN new_lines = 0 THEN 'order_cancelled'
                   WHEN line_added + line_cancelled + quantity_changed + date_moved > 0 THEN 'possible_change'
                   ELSE 'unchanged' END AS verdict
        FROM ch JOIN per ON per.r = ch.r AND per.v = ch.v"""),
    "order_chain_lines": with_views("fx_lines", _CHAIN, """
        SELECT r AS order_ref, v AS version, line_no, change, oq AS old_quantity, nq AS new_quantity FROM (
            SELECT *, unnest(list_filter([CASE WHEN there AND NOT was THEN 'line_added' END,
                CASE WHEN was AND NOT there THEN 'line_cancelled' END,
                CASE WHEN was AND there AND oq IS DISTINCT FROM nq THEN 'quantity_changed' END,
                CASE WHEN was AND there AND od IS DISTINCT FROM nd THEN 'date_moved' END], lambda x: x IS NOT NULL)) AS change
            FROM st)"""),
    "latest_lines": with_views("fx_lines", _CHAIN, """
        SELECT r AS order_ref, v AS version, line_no, q AS quantity, d AS delivery_date FROM li
        WHERE v = (SELECT max(c.v) FROM ch c WHERE c.r = li.r)"""),
    "compare_extractions": with_views("fx_lines", {}, """
        SELECT order_id AS doc_id, line_no, 'quantity' AS field,
               printf('%.1f', quantity) AS value_a, printf('%.1f', quantity - 20) AS value_b,
               'metadata_mismatch' AS flag
        FROM fx_lines WHERE l_partkey % 13 = 0 AND quantity IS NOT NULL
          AND l_partkey % 29 <> 0 AND l_partkey % 31 <> 0
        UNION ALL SELECT order_id, line_no, 'unit', unit, 'MTR', 'metadata_mismatch' FROM fx_lines
        WHERE l_partkey % 17 = 0 AND unit IS DISTINCT FROM 'MTR'
          AND l_partkey % 29 <> 0 AND l_partkey % 31 <> 0
        UNION ALL SELECT order_id, line_no, CASE WHEN l_partkey % 29 = 0 THEN 'a' ELSE 'b' END,
                         NULL, NULL, 'line_missing' FROM fx_lines
        WHERE (l_partkey % 29 = 0) <> (l_partkey % 31 = 0)"""),
    "qty_plausibility": with_views("fx_lines", _QTY, """
        SELECT k.order_id, k.line_no, round(kg, 3) AS kg, round(metres, 3) AS metres,
               round(pieces, 3) AS pieces,
               coalesce(kg / mean_kg > 10 OR kg / mean_kg < 0.1, false) AS outlier
        FROM kk k LEFT JOIN mean USING (resolved)"""),
    "intake_stream": with_views("fx_lines fx_aliases", {**_DRAWN, "idx": oq._EXACT["idx"],
                                                       "tiers": """
        SELECT CASE WHEN i.item IS NOT NULL THEN 'exact' ELSE 'other' END AS tier
        FROM drawn d LEFT JOIN idx i ON i.code = d.internal_code"""}, """
        SELECT CASE tier WHEN 'exact' THEN 'exact' ELSE 'fuzzy' END AS match_tier,
               count(*) AS n FROM tiers GROUP BY 1"""),
}
