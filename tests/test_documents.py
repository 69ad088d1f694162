"""Extraction, messages, interchange, sources and streaming on small fixtures."""

import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from orderweave import session
from orderweave.operators import checks, extraction, interchange, messages, orders
from orderweave.plans import document_queries
from orderweave.sources import catalog as cat
from orderweave.sources import files as fl
from orderweave.sources import pages as pg
from orderweave.sources import sinks
from orderweave.sources.interchanges import read_interchanges
from orderweave.streaming.intake import document_files, first_deliveries, start_intake
from orderweave.streaming.runs import run_to_parquet, session_settings

AS_OF = datetime(2026, 6, 10, 9, 15, 30)
TEXT = """Kopf 010 AE-2024-034 ist hier keine Position
Bestell-Nr.: BP-2026-00487
bestelldatum: 15.06.2026   Liefertermin: 30.09.2026
   010 AE-2024-034   Winkelprofil 40x40x3 mm, EN  AW-6060 T66
   Länge: 6.000 mm
  150 Stk. 27,80 4.170,00 15.09.2026
Preis netto Länge: 9.000 mm
030 AE-2025-020 Schiene nge: 5.000 mm
Lnge: 6.500 mm\r\nLnge: 7.000 mm
2.400 kg 3,95 9.480,00 01.10.2026
2.500 kg 3,95 9.480,00 02.10.2026
040 AE-2025-021 Rohr
1,5 Stuck 3,95 9.480,00 31.02.2026
050 AE-2025-022 Ohne Menge
Seite 1 von 1
"""


def test_table_documents(spark):
    docs = spark.createDataFrame([("d", "c", TEXT), ("e", "c", "nothing here"), ("n", "c", None)],
                                 "doc_id string, customer string, text string")
    heads, lines = extraction.parse_order_tables(docs)
    head = heads.where("doc_id = 'd'").first()
    assert (head["order_ref"], head["order_date"], head["delivery_date_default"],
            head["currency"]) == ("BP-2026-00487", date(2026, 6, 15), date(2026, 9, 30), "EUR")
    assert heads.count() == 3
    got = [tuple(r) for r in lines.orderBy("pos").select(
        "line_no", "extracted_code", "description", "quantity", "unit", "unit_raw",
        "delivery_date", "length_mm", "alloy").collect()]
    assert got == [
        ("010", "AE-2024-034", "Winkelprofil 40x40x3 mm, EN  AW-6060 T66 Länge: 6.000 mm", 150.0,
         "PCE", "Stk.", date(2026, 9, 15), 6000.0, "EN AW-6060"),
        ("030", "AE-2025-020", "Schiene nge: 5.000 mm Lnge: 6.500 mm Lnge: 7.000 mm", 2400.0,
         "KGM", "kg", date(2026, 10, 1), 6500.0, None),
        ("040", "AE-2025-021", "Rohr", 1.5, None, "Stuck", None, None, None),
        ("050", "AE-2025-022", "Ohne Menge Seite 1 von 1", None, None, None, None, None, None)]


def test_table_parse_needs_no_shuffle(spark):
    docs = spark.createDataFrame([("d", "c", TEXT)], "doc_id string, customer string, text string")
    plan = extraction.parse_order_tables(docs)[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_lines_are_cut_without_a_pattern_per_line(spark):
    """``split`` compiles its pattern for each row; and a text like the quantity row is not yet that row."""
    text = "010 AE-2000-001 a\nx 5 Stk 1,00 2,00 01.02.2024\n5 Stk 1,00 2,00 01.02.2024\n7 kg 1,00 2,00 30.02.2024"
    docs = spark.createDataFrame([("d", "c", text)], "doc_id string, customer string, text string")
    lines = extraction.parse_order_tables(docs)[1]
    assert [tuple(r) for r in lines.select("description", "quantity", "unit", "delivery_date").collect()] == [
        ("a x 5 Stk 1,00 2,00 01.02.2024", 5.0, "PCE", date(2024, 2, 1))]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "split(block" not in plan


def test_fields_of_answers_are_taken_out_in_one_pass(spark):
    """Reading a field as a variant copies it, so no entry is read field by field."""
    answers = spark.createDataFrame([("d", "c", "m", '{"lines": [{"code": 0, "unit": "kg"}, 5, null, {"CODE": "x"}]}')],
                                    "doc_id string, customer string, source string, answer string")
    lines = extraction.parse_json_payloads(answers)[1]
    assert [tuple(r) for r in lines.orderBy("pos").select("pos", "line_no", "extracted_code", "unit").collect()] == [
        (0, "010", None, "KGM"), (3, "040", None, None)]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "$.code" not in plan and "$.unit" not in plan


def test_answers(spark):
    payload = {"order_ref": "CA-1", "order_date": "2026-04-10", "currency": "", "lines": [
        {"line_no": "1", "code": "AE-2024-034", "description": "Corniere", "quantity": 120,
         "unit": "pieces", "delivery_date": "2026-05-01", "length_mm": 6000, "alloy": "x"},
        "no object",
        {"code": None, "description": "", "quantity": "50,5", "unit": "m"},
        {"line_no": 7, "code": 0, "quantity": True, "unit": 5, "delivery_date": 5},
        {"line_no": 8.0, "code": "0", "quantity": "many"}]}
    text = json.dumps(payload)
    answers = [text, f"```json\n{text}\n```", f"Sure! {text} Bye", "no json {", "[1]", None,
               '[{"lines":[{"code":"A"}]}]', '{"lines": {"code": "A"}}']
    df = spark.createDataFrame([(i, "c", "local_model", a) for i, a in enumerate(answers)],
                               "doc_id int, customer string, source string, answer string")
    heads, lines = extraction.parse_json_payloads(df)
    assert [(r["order_ref"], r["order_date"], r["currency"])
            for r in heads.orderBy("doc_id").collect()] == [
        ("CA-1", date(2026, 4, 10), "EUR")] * 3 + [(None, None, "EUR")] * 5
    wanted = [
        ("1", "AE-2024-034", "Corniere", 120.0, "PCE", date(2026, 5, 1), 6000.0, "x"),
        ("030", None, None, 50.5, "MTR", None, None, None),
        ("7", None, None, 1.0, None, None, None, None),
        ("8.0", "0", None, None, None, None, None, None)]
    for doc in range(3):
        got = [tuple(r) for r in lines.where(F.col("doc_id") == doc).orderBy("pos").select(
            "line_no", "extracted_code", "description", "quantity", "unit", "delivery_date",
            "length_mm", "alloy").collect()]
        assert got == wanted
    assert lines.where("doc_id > 2").count() == 0


def test_routing(spark):
    docs = spark.createDataFrame(
        [("1", "tab", TEXT), ("2", "loc", "x"), ("3", "api", "x"), ("4", "nokey", "x"),
         ("5", "odd", "x"), ("6", "who", "x"), ("7", "loc", "x")],
        "doc_id string, customer string, text string")
    customers = spark.createDataFrame(
        [("tab", "table_text", None), ("loc", "local_model", None), ("api", "api_model", "k"),
         ("nokey", "api_model", ""), ("odd", "telepathy", None)],
        "code string, extraction_strategy string, api_key string")
    answers = spark.createDataFrame(
        [("2", '{"lines":[{"code":"A"}]}'), ("3", '{"lines":[{"code":"B"}]}'), ("4", "{}"),
         ("5", "{}")], "doc_id string, answer string")
    _, lines, rejects = extraction.route_extraction(docs, customers, answers)
    assert {(r["doc_id"], r["trusted"]) for r in lines.collect()} == {
        ("1", True), ("2", False), ("3", False)}
    assert {(r["doc_id"], r["reason"]) for r in rejects.collect()} == {
        ("4", "api_key_missing"), ("5", "unknown_strategy"), ("6", "unknown_customer"),
        ("7", "no_answer")}
    _, _, rejects = extraction.route_extraction(docs, customers, answers, False)
    assert ("2", "local_model_not_configured") in {
        (r["doc_id"], r["reason"]) for r in rejects.collect()}


@pytest.fixture(scope="module")
def order_tables(spark):
    heads = spark.createDataFrame(
        [(7, "bauprofil", "BP-2026-00487", None, date(2026, 9, 1), "EUR"),
         (12345678901, "nobody", None, date(2026, 6, 1), None, "CHF"),
         (8, "x", None, None, None, "EUR"), (9, "x", None, None, None, "EUR")],
        "id bigint, customer string, order_ref string, order_date date, "
        "delivery_date_default date, currency string")
    lines = spark.createDataFrame(
        [(7, "2", "Größe + 'x'?", "ae-2024-034", 150.0, "PCE", 6000.5, date(2026, 9, 15)),
         (7, "10", None, " OLD-1 ", None, None, 0.0, None),
         (12345678901, "1", "a", "AE-2024-034", 2.5, "KGM", None, date(2026, 9, 2)),
         (9, "1", "a", None, 1.0, "PCE", None, None), (9, "2", "a", "", 1.0, "PCE", None, None),
         (9, "3", "a", "AE-2024-034", 1.0, "PCE", None, None)],
        "order_id bigint, line_no string, description string, resolved_internal_code string, "
        "quantity double, unit string, length_mm double, delivery_date date")
    catalog = spark.createDataFrame([("AE-2024-034", "EDI-034", "A"), ("OLD-1", "EDI-1", "I")],
                                    "internal_code string, edi_pia_code string, status string")
    return heads, lines, catalog


MESSAGE = """UNB+UNOA:2+4012345600007+4012345123456+260610:0915+OI7091530'
UNH+OI7091530A+ORDERS:D:96A:UN'
BGM+220+BP-2026-00487+9'
DTM+137:20260901:102'
RFF+ON:BP-2026-00487'
NAD+BY+4012345600007::9'
NAD+SU+4012345123456::9'
NAD+DP+4012345600007::9'
CUX+2:EUR:9'
PAT+1++5:3:D:30'
LIN+1++OLD-1:SA'
PIA+1+OLD-1:SA'
QTY+21:0:PCE'
DTM+2:20260901:102'
LIN+2++EDI-034:SA'
PIA+1+EDI-034:SA'
IMD+F++:::Groesse ?+ ?'x?'??'
QTY+21:150:PCE'
MEA+PD+AAC+6000.5:MMT'
DTM+2:20260915:102'
UNS+S'
CNT+2:2'
UNT+22+OI7091530A'
UNZ+1+OI7091530'
"""


def test_message_text(order_tables):
    got = {r["order_id"]: r for r in messages.generate_messages(*order_tables, AS_OF).collect()}
    assert set(got) == {7, 12345678901}
    assert got[7]["edi_text"] == MESSAGE
    assert got[7]["segment_count"] == 24
    other = got[12345678901]["edi_text"]
    assert "+0000000000000+" in other and "BGM+220+12345678901+9'" in other
    assert "UNH+OI12345678901A+" in other and "RFF" not in other and "QTY+21:2.5:KGM'" in other


def test_gate(order_tables):
    ready, blocked, blocking = orders.order_gate(*order_tables[:2])
    assert {r["id"] for r in ready.collect()} == {7, 12345678901}
    assert {(r["id"], r["reason"]) for r in blocked.collect()} == {
        (8, "no_lines"), (9, "unresolved_lines")}
    assert {tuple(r) for r in blocking.collect()} == {(9, "1"), (9, "2")}


def test_a_large_order_is_one_message(spark, order_tables):
    heads, _, catalog = order_tables
    lines = spark.createDataFrame(
        [(7, f"{i:06d}", f"text {i}", "AE-2024-034", float(i + 1), "PCE", None, None)
         for i in range(30_000)] + [(8, "1", "a", "AE-2024-034", 1.0, "PCE", None, None)],
        order_tables[1].schema).repartition(7)
    made = messages.generate_messages(heads, lines, catalog, AS_OF)
    text = {r["order_id"]: r["edi_text"] for r in made.collect()}[7]
    numbers = [x.split("+")[1] for x in text.split("\n") if x.startswith("LIN")]
    assert numbers == [str(i + 1) for i in range(30_000)]
    said = [x for x in text.split("\n") if x.startswith("IMD")]
    assert said == [f"IMD+F++:::text {i}'" for i in range(30_000)]
    pieces = messages.message_segments(made).where("order_id = 7").orderBy("position").collect()
    assert [r["segment"] for r in pieces] == text.rstrip("\n").split("\n")
    assert messages.shared_references(made).count() == 0
    nested = {r["id"]: r for r in orders.orders_with_lines(
        heads.drop("delivery_date_default"), lines).collect()}
    assert [x["line_no"] for x in nested[7]["lines"]] == [f"{i:06d}" for i in range(30_000)]
    assert nested[9]["lines"] == [] and nested[7]["line_count"] == 30_000


@pytest.mark.parametrize("quantity", [1e25, float("inf"), float("nan")])
def test_impossible_quantities_block_the_order_and_not_the_job(spark, order_tables, quantity):
    heads, _, catalog = order_tables
    lines = spark.createDataFrame(
        [(7, "1", "a", "AE-2024-034", quantity, "PCE", None, None),
         (8, "1", "a", "AE-2024-034", 1.0, "PCE", None, None)], order_tables[1].schema)
    made = messages.generate_messages(heads, lines, catalog, AS_OF).collect()
    assert [r["order_id"] for r in made] == [8]
    _, blocked, blocking = orders.order_gate(heads, lines)
    assert (7, "bad_quantity") in {(r["id"], r["reason"]) for r in blocked.collect()}
    assert [tuple(r) for r in blocking.collect()] == [(7, "1")]


def test_interchange_round_trip(spark, order_tables):
    made = messages.generate_messages(*order_tables, AS_OF)
    files = made.select(F.col("order_id").cast("string").alias("file"),
                        F.col("edi_text").alias("text"))
    segments = interchange.edi_scan(files)
    counts = {r["file"]: r["count"] for r in segments.groupBy("file").count().collect()}
    assert counts["7"] == 24
    rows = {(r["file"], r["line_index"]): r for r in interchange.edi_lines(segments).collect()}
    assert rows[("7", 2)]["description"] == "Groesse + 'x'?"
    assert rows[("7", 2)]["length_mm"] == 6000.5
    assert rows[("7", 1)]["pia_code"] == "OLD-1"


def test_a_file_of_several_interchanges(spark, order_tables):
    good = MESSAGE.replace("OLD-1", "EDI-034").replace("QTY+21:0:", "QTY+21:1:")
    files = spark.createDataFrame([("f", good + good.replace("UNOA:2", "UNOB:2") + good)], "file string, text string")
    catalog = spark.createDataFrame([("EDI-034", "A")], "internal_code string, status string")
    segments = interchange.edi_scan(files)
    _, verdicts = interchange.edi_validate(files, catalog, date(2026, 6, 10))
    assert sorted((r["interchange_no"], r["message_no"], r["rules"]) for r in verdicts.collect()) == [
        (1, 1, []), (2, 1, ["R1"]), (3, 1, [])]
    assert interchange.edi_lines(segments).count() == 6


def test_interchange_rules(spark):
    good = MESSAGE.replace("OLD-1", "EDI-034").replace("QTY+21:0:", "QTY+21:1:")
    changes = {
        "good": (None, None), "R1": ("UNOA:2", "UNOB:2"), "R2": ("+4012345123456+2", "+1+2"),
        "R3": ("+260610:", "+261310:"), "R4": ("D:96A", "D:97A"), "R5": ("BGM+220", "BGM+221"),
        "R7": ("CNT+2:2", "CNT+2:3"), "R8": ("UNT+22", "UNT+23"), "R9": ("UNZ+1", "UNZ+2"),
        "L1|R8": ("PIA+1+EDI-034:SA'\nIMD", "IMD"), "L2": ("PIA+1+EDI-034:SA'\nIMD",
                                                            "PIA+1+EDI-034:BP'\nIMD"),
        "L3": ("PIA+1+EDI-034:SA'\nIMD", "PIA+1+NONE:SA'\nIMD"), "L4": ("21:150", "21:x"),
        "L5": (":150:PCE", ":150:BOX"), "L6": ("DTM+2:20260915:102", "DTM+2:20250915:102")}
    files = spark.createDataFrame(
        [(k, good if a is None else good.replace(a, b)) for k, (a, b) in changes.items()]
        + [("none", "rubbish")], "file string, text string")
    catalog = spark.createDataFrame([("EDI-034", "A")], "internal_code string, status string")
    _, verdicts = interchange.edi_validate(files, catalog, date(2026, 6, 10))
    got = {r["file"]: "|".join(r["rules"]) or "good" for r in verdicts.collect()}
    for name in changes:
        assert got[name] == name
    assert "none" not in got or "R4" in got["none"]


def test_export_writes_once(spark, order_tables, tmp_path):
    log = sinks.export_orders(*order_tables, str(tmp_path), AS_OF, per_order_files=True)
    rows = log.collect()
    assert {r["order_id"] for r in rows} == {7, 12345678901}
    again = sinks.export_orders(*order_tables, str(tmp_path / "b"), AS_OF, per_order_files=True)
    assert {r["blob_path"] for r in again.collect()} == {r["blob_path"] for r in rows}
    name = next(r["blob_path"] for r in rows if r["order_id"] == 7).split("/")[1][:-4]
    written = list(tmp_path.glob(f"edifact/*/message={name}/*.txt"))
    assert [p.read_text() for p in written] == [MESSAGE]
    sinks.export_orders(*order_tables, str(tmp_path / "f"), AS_OF)
    bulk = "".join(p.read_text() for p in sorted(tmp_path.glob("f/edifact/*/*.txt")))
    assert bulk.count("UNB+") == 2 and MESSAGE in bulk
    rest = sinks.export_orders(*order_tables, str(tmp_path / "c"), AS_OF,
                               exported=log.where("order_id = 7"))
    assert {r["order_id"] for r in rest.collect()} == {12345678901}


def test_export_counts_only_when_whole(spark, order_tables, tmp_path):
    heads, lines, catalog = order_tables
    out = str(tmp_path / "out")
    one = heads.where("id = 7")
    # A run that broke before its manifest: its folders are there, but count for nothing.
    sinks.export_orders(heads, lines, catalog, out, AS_OF)
    (tmp_path / "out" / "manifest").mkdir()
    assert sinks.finished_exports(spark, out).count() == 0
    first = sinks.export_batch(one, lines.where("order_id = 7"), catalog, out, AS_OF, "1")
    assert [(r["order_id"], r["batch"]) for r in first.collect()] == [(7, "1")]
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.txt")}
    again = sinks.export_batch(heads, lines, catalog, out, AS_OF, "1")
    assert again.count() == 1
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.txt")} == files
    both = sinks.export_batch(heads, lines, catalog, out, AS_OF, "2")
    assert sorted((r["order_id"], r["batch"]) for r in both.collect()) == [(7, "1"), (12345678901, "2")]
    assert not list((tmp_path / "out" / "staging").glob("*"))
    merged = sinks.merge_status(heads.withColumn("status", F.lit("new")), both)
    assert sinks.merge_status(merged, both).collect() == merged.collect()
    assert {r["id"]: r["status"] for r in merged.collect()} == {
        r["id"]: "edifact_generated" if r["id"] in (7, 12345678901) else "new" for r in heads.collect()}


def test_bulk_files_are_read_in_pieces(spark, tmp_path):
    """Several blocks per file; header letters at the end of an element, released terminators, line breaks."""
    one = "UNB+UNOA:2+A+4012345123456+260610:1200+R{0}'\nUNH+R{0}A+ORDERS:D:96A:UN'\n{1}UNT+3+R{0}A'\nUNZ+1+R{0}'\n"
    odd = ["FTX+HANSUNB+x'\n", "FTX+it?'UNB+y'\n", "FTX+done??'\n", "", "FTX+a?+UNB+UNB+z'"]
    texts = [one.format(i, odd[i % 5] * (i % 3)) for i in range(300)]
    (tmp_path / "a.edi").write_text("".join(texts[:200]))
    (tmp_path / "b.edi").write_text(" rubbish'\n" + "".join(t.replace("\n", "") for t in texts[200:]))
    with session_settings(spark, {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "0"}):
        rows = read_interchanges(spark, str(tmp_path)).collect()
    got = {(r["file"][-5:], r["interchange_no"]): r["text"] for r in rows}
    assert len(got) == len(rows) == 301
    assert [got["a.edi", i + 1] for i in range(200)] == texts[:200]
    assert [got["b.edi", i + 1] for i in range(100)] == [t.replace("\n", "") for t in texts[200:]]
    assert got["b.edi", 0].strip() == "rubbish'"
    segments = interchange.edi_scan(read_interchanges(spark, str(tmp_path)))
    assert segments.where("tag = 'UNB'").count() == 300


def test_interchange_parts_are_numbered_in_their_row(spark):
    """Segments before the first header, after the last one, several messages, lines after the summary."""
    text = ("X+1'UNB+a'UNH+1'LIN+1'QTY+21:1'LIN+2'UNS+S'LIN+9'UNT+1'UNH+2'BGM+220'UNT+2'UNZ+2'"
            "UNB+b'UNZ+0' ' tail")
    rows = interchange.edi_scan(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("seq").collect()
    assert [(r["seq"], r["tag"], r["interchange_no"], r["message_no"], r["line_index"]) for r in rows] == [
        (1, "X", 0, 0, None), (2, "UNB", 1, 0, None), (3, "UNH", 1, 1, None), (4, "LIN", 1, 1, 1), (5, "QTY", 1, 1, 1),
        (6, "LIN", 1, 1, 2), (7, "UNS", 1, 1, None), (8, "LIN", 1, 1, None), (9, "UNT", 1, 1, None), (10, "UNH", 1, 2, None),
        (11, "BGM", 1, 2, None), (12, "UNT", 1, 2, None), (13, "UNZ", 1, 2, None), (14, "UNB", 2, 0, None),
        (15, "UNZ", 2, 0, None), (16, "tail", 2, 0, None)]
    assert interchange.edi_scan(spark.createDataFrame([("f", None), ("g", "")], "file string, text string")).count() == 0


def test_scan_and_rules_shuffle_no_segments(spark):
    files = spark.createDataFrame([("f", MESSAGE)], "file string, text string")
    plan = interchange.edi_scan(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_catalog_sources(spark, tmp_path):
    head = ",".join(f.name for f in cat.CSV_SCHEMA)
    (tmp_path / "c.csv").write_text(
        head + "\n AE-1 ,Equal Angle,EN AW-6060, ,T66,20.0,,2.0,angle,0.21,6000|6500,M|AE2,"
               "EN,arch,AE-1\n")
    record = {"internal_code": "AE-1", "profile_name": "Equal Angle", "alloy": "EN AW-6060",
              "temper": "T66", "dimensions_mm": {"width": 20.0, "wall_thickness": 2.0},
              "profile_type": "angle", "weight_kg_per_m": 0.21,
              "standard_lengths_mm": [6000, 6500], "surface_finishes": ["M", "AE2"],
              "tolerance_standard": "EN", "category": "arch", "edi_pia_code": "AE-1"}
    (tmp_path / "c.json").write_text(json.dumps([record]))
    from_csv = cat.load_catalog(spark, str(tmp_path / "c.csv")).collect()
    assert from_csv == cat.load_catalog(spark, str(tmp_path / "c.json"), "json").collect()
    row = from_csv[0]
    assert (row["internal_code"], row["alloy_din"], row["height_mm"], row["status"]) == (
        "AE-1", None, None, "A")


def test_pages_and_model_input(spark):
    pages = spark.createDataFrame(
        [(1, "t", 2, None, "m2"), (1, "t", 1, "a", "m1"), (2, "l", 1, "a", "m1"),
         (3, "l", 1, "a", "  ")],
        "doc_id int, customer string, page_no int, text string, markdown string")
    customers = spark.createDataFrame([("t", "table_text"), ("l", "local_model")],
                                      "code string, extraction_strategy string")
    docs = pg.documents_from_pages(pages, customers)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {1: "a\n", 2: "m1", 3: "a"}
    filled = pg.model_input(docs, "Read:\n{document}\n--")
    assert {r["model_text"] for r in filled.where("doc_id = 2").collect()} == {"Read:\nm1\n--"}


def test_file_names(spark, tmp_path):
    names = spark.createDataFrame([("Bestellung Größe.PDF",), ("  ",), ("a b",)], "n string")
    assert [r[0] for r in names.select(fl.safe_name(F.col("n"))).collect()] == [
        "Bestellung_Gr_e.PDF", "order.pdf", "a_b.pdf"]
    paths = spark.createDataFrame([("a/b.tar.gz",), ("a.x/b",)], "p string")
    got = [r[0] for r in paths.select(fl.hash_suffix(F.col("p"), F.lit("k"))).collect()]
    assert got[0].startswith("a/b.tar-") and got[0].endswith(".gz")
    assert got[1].startswith("a.x/b-")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.pdf").write_bytes(b"123")
    (tmp_path / "y.csv").write_bytes(b"1")
    listed = fl.scan_files(spark, str(tmp_path))
    entries, _ = fl.file_manifest(listed, "", recursive=False)
    assert {(r["entry"], r["bytes"], r["media_type"]) for r in entries.collect()} == {
        ("d/", 3, None), ("y.csv", 1, "text/csv")}


def test_changes_and_score(spark):
    schema = "order_ref string, line_no string, quantity double, delivery_date date"
    day = date(2026, 1, 1)
    old = spark.createDataFrame([("a", "1", 1.0, day), ("a", "2", 1.0, day), ("b", "1", 1.0, day),
                                 ("d", "1", None, day)], schema)
    new = spark.createDataFrame([("a", "1", 2.0, date(2026, 1, 2)), ("a", "3", 1.0, day),
                                 ("c", "1", 1.0, day), ("d", "1", None, day)], schema)
    changes, verdicts = checks.order_change_diff(old, new)
    assert {(r["order_ref"], r["line_no"], r["change"]) for r in changes.collect()} == {
        ("a", "1", "quantity_changed"), ("a", "1", "date_moved"), ("a", "2", "line_cancelled"),
        ("a", "3", "line_added"), ("b", "1", "line_cancelled"), ("c", "1", "line_added")}
    assert {r["order_ref"]: r["verdict"] for r in verdicts.collect()} == {
        "a": "possible_change", "b": "order_cancelled", "c": "new_order", "d": "unchanged"}


def test_intake_counts_each_file_once(spark, tmp_path):
    for customer, name, body in (("tab", "one.txt", TEXT), ("loc", "two.json",
                                 '{"lines":[{"description":"Equal Angle 40x40x3"}]}')):
        (tmp_path / "in" / customer).mkdir(parents=True)
        (tmp_path / "in" / customer / name).write_text(body)
    customers = spark.createDataFrame([("tab", "table_text", None), ("loc", "local_model", None)],
                                      "code string, extraction_strategy string, api_key string")
    catalog = spark.createDataFrame(
        [("AE-2024-034", "Equal Angle 40x40x3", "EN AW-6060", 40.0, 40.0, 3.0, "A")],
        "internal_code string, profile_name string, alloy string, width_mm double, "
        "height_mm double, wall_thickness_mm double, status string")
    aliases = spark.createDataFrame([], "customer_code string, customer_part_code string, "
                                        "internal_code string")

    def go():
        start_intake(document_files(spark, str(tmp_path / "in")), customers, catalog, aliases,
                     str(tmp_path / "out"), str(tmp_path / "state"), every=None
                     ).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out" / "lines"))

    work = spark.conf.get("spark.checkpoint.dir", None)
    before = set(os.listdir(work)) if work else set()
    first = go()
    assert set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == before
    assert first.count() == 5
    tiers = {r["match_tier"] for r in first.collect()}
    assert tiers == {"exact", "dimension", "none"}
    (tmp_path / "in" / "tab" / "three.txt").write_text(TEXT)
    assert go().count() == 9


def test_the_same_text_counts_once_under_any_name(spark, tmp_path):
    customers = spark.createDataFrame([("tab", "table_text", None), ("two", "table_text", None)],
                                      "code string, extraction_strategy string, api_key string")
    catalog = spark.createDataFrame([], "internal_code string, profile_name string, alloy string, width_mm double, "
                                        "height_mm double, wall_thickness_mm double, status string")
    aliases = spark.createDataFrame([], "customer_code string, customer_part_code string, internal_code string")
    (tmp_path / "in").mkdir()
    docs = first_deliveries(document_files(spark, str(tmp_path / "in")))
    for files, orders_now in (([("tab", "a.txt", TEXT)], 1), ([("tab", "b.txt", TEXT), ("two", "a.txt", TEXT), ("tab", "c.txt", TEXT + " ")], 3)):
        for customer, name, body in files:
            (tmp_path / "in" / customer).mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / customer / name).write_text(body)
        start_intake(docs, customers, catalog, aliases, str(tmp_path / "out"), str(tmp_path / "state"), every=None).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out" / "orders")).select("doc_id").distinct().count() == orders_now


def test_old_texts_are_forgotten_on_request(spark, tmp_path):
    rows = [("a", "c", "same", datetime(2026, 1, 1)), ("b", "c", "same", datetime(2026, 1, 2)), ("d", "c", None, datetime(2026, 1, 2)),
            ("e", "c", None, datetime(2026, 1, 2)), ("f", "c", "other", datetime(2026, 5, 1)), ("g", "c", "same", datetime(2026, 5, 2))]
    schema = "doc_id string, customer string, text string, arrived timestamp"
    (tmp_path / "in").mkdir()
    for chunk in (rows[:4], rows[4:5], rows[5:]):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = run_to_parquet(first_deliveries(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "30 days"),
                             str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r["doc_id"] for r in out.collect()}
    assert len(got & {"a", "b"}) == 1 and got - {"a", "b"} == {"d", "e", "f", "g"}


def test_a_chain_of_versions(spark):
    versions = [("a", v) for v in (1, 2, 4, 5, 6)] + [("b", 3)]
    lines = [("a", 1, "1", 1.0, None), ("a", 1, "2", 1.0, None), ("a", 2, "1", 2.0, None), ("a", 5, "1", 2.0, None),
             ("a", 6, "1", 2.0, None), ("b", 3, "1", None, None)]
    args = (spark.createDataFrame(versions, "order_ref string, version int"),
            spark.createDataFrame(lines, "order_ref string, version int, line_no string, quantity double, delivery_date date"))
    changes, verdicts = checks.order_change_chain(*args)
    assert sorted((r["order_ref"], r["version"], r["before"], r["verdict"]) for r in verdicts.fillna(0).collect()) == [
        ("a", 1, 0, "new_order"), ("a", 2, 1, "possible_change"), ("a", 4, 2, "order_cancelled"),
        ("a", 5, 4, "order_reopened"), ("a", 6, 5, "unchanged"), ("b", 3, 0, "new_order")]
    assert sorted((r["version"], r["line_no"], r["change"]) for r in changes.where("order_ref = 'a'").collect()) == [
        (1, "1", "line_added"), (1, "2", "line_added"), (2, "1", "quantity_changed"), (2, "2", "line_cancelled"),
        (4, "1", "line_cancelled"), (5, "1", "line_added")]
    assert sorted(tuple(r)[:3] for r in checks.latest_lines(*args).collect()) == [("a", 6, "1"), ("b", 3, "1")]


def test_weights_at_the_limit_are_judged_alike_in_any_order(spark):
    # Nineteen lines of 0.7 kg and one of 13.3, ten times the mean: a sum of doubles falls short of it.
    weights = [0.7] * 9 + [13.3] + [0.7] * 10
    schema = "order_id int, line_no string, resolved_internal_code string, quantity double, unit string, length_mm double"
    catalog = spark.createDataFrame([("A", 1.0)], "internal_code string, weight_kg_per_m double")
    for rows in (weights, weights[9:] + weights[:9]):
        lines = spark.createDataFrame([(1, str(i), "A", q, "KGM", None) for i, q in enumerate(rows)], schema)
        assert checks.qty_plausibility(lines, catalog).where("outlier").count() == 0
    # Beyond what a decimal holds.
    odd = spark.createDataFrame([(1, "1", "A", 1e30, "KGM", None), (1, "2", "A", 1.0, "KGM", None)], schema)
    assert [r["outlier"] for r in checks.qty_plausibility(odd, catalog).orderBy("line_no").collect()] == [False, True]


def test_bulk_files_grow_with_the_orders(spark, sf):
    rows = document_queries.edi_validate_bulk(spark, sf).select("file", "interchange_no").collect()
    numbers = {}
    for r in rows:
        numbers.setdefault(r["file"], []).append(r["interchange_no"])
    assert set(numbers) == {f"bulk{n}" for n in range(40)}
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())


def test_facts_are_found_whether_or_not_characters_are_released(spark, order_tables):
    made = messages.generate_messages(*order_tables, AS_OF).where("order_id = 7").first()["edi_text"]
    qualified = made.replace("QTY+21:", "QTY+12:9:KGM'\nQTY+21:").replace("PIA+1+", "PIA+5+OTHER:SA'\nPIA+1+")
    # A released character anywhere in a group has all its segments parsed; tags with components count too.
    released = qualified.replace("IMD+F++:::", "IMD+F++:::it?'s PIA?+1?+NONE:SA ")
    split = qualified.replace("BGM+220", "BGM:x+220").replace("DTM+2:", "DTM:1+2:")
    files = spark.createDataFrame([("a", made), ("b", qualified), ("c", released), ("d", split)], "file string, text string")
    facts = interchange._facts(files).drop("segments", "said_segments").collect()
    of = {name: sorted([tuple(r)[1:] for r in facts if r["file"] == name], key=lambda r: str(r)) for name in "abcd"}
    assert of["a"] and of["a"] == of["b"] == of["c"] == of["d"]


def test_lines_of_messages_are_read_once(spark, order_tables, tmp_path):
    heads, lines, catalog = order_tables
    lines.write.parquet(str(tmp_path / "lines"))
    made = messages.generate_messages(heads, spark.read.parquet(str(tmp_path / "lines")), catalog, AS_OF)
    scans = [r for r in made._jdf.queryExecution().sparkPlan().toString().split("\n") if "FileScan" in r]
    assert len(scans) == 1


def _carried(plan):
    """Types of the columns that rows carry through each generator of a plan."""
    children = plan.children()
    for i in range(children.size()):
        yield from _carried(children.apply(i))
    if plan.nodeName() == "Generate":
        kept = plan.requiredChildOutput()
        yield from (kept.apply(i).dataType().simpleString() for i in range(kept.size()))


def test_line_groups_do_not_carry_their_message(spark, order_tables):
    files = messages.generate_messages(*order_tables, AS_OF).select(F.col("order_id").alias("file"), F.col("edi_text").alias("text"))
    catalog = order_tables[2].select("internal_code", F.lit("A").alias("status"))
    _, verdicts = interchange.edi_validate(files, catalog, date(2026, 6, 10))
    types = list(_carried(verdicts._jdf.queryExecution().optimizedPlan()))
    assert types and not [t for t in types if t.startswith("array")]


def test_many_lines_are_counted_with_their_message(spark, order_tables):
    made = messages.generate_messages(*order_tables, AS_OF).where("order_id = 7").first()["edi_text"]
    long = made.replace("UNS+S'", "LIN+1'\n" * 1500 + "UNS+S'")
    facts = interchange._facts(spark.createDataFrame([("f", made), ("g", long)], "file string, text string"))
    of = {r["file"]: r for r in facts.groupBy("file").agg(
        F.count_if(F.col("line_index") > 0).alias("n"), F.collect_set(F.struct("lines", "segments")).alias("said")).collect()}
    (few,), (many,) = of["f"]["said"], of["g"]["said"]
    assert of["g"]["n"] == of["f"]["n"] + 1500 == many["lines"] == few["lines"] + 1500
    assert many["segments"] == few["segments"] + 1500


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_a_staged_table_leaves_no_shuffled_rows(spark, tmp_path):
    groups = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = _shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    kept = session.staged(groups, "groups")
    assert not _shuffle_files(spark) - before and spark.conf.get(setting) == was
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in groups.collect()}


def test_chains_of_versions_are_shuffled_once(spark):
    rows = [(o, v, str(n), float(n + (v if n == 2 else 0)), date(2026, 1, 1)) for o in range(20) for v in (1, 2, 3) for n in range(3) if n < v]
    rows += [(1, 2, "0", 9.0, None), (1, 2, None, 1.0, None), (1, 3, None, 1.0, None)]  # a line twice, lines without a number
    lines = spark.createDataFrame(rows, "order_ref long, version long, line_no string, quantity double, delivery_date date")
    changes, verdicts = checks.order_change_chain(lines.select("order_ref", "version"), lines)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan(changes) and plan(verdicts).count("Join") == 1
    got = {(r["order_ref"], r["version"]): r for r in verdicts.collect()}
    assert len(got) == 60
    assert [got[2, v]["verdict"] for v in (1, 2, 3)] == ["new_order", "possible_change", "possible_change"]
    of = got[1, 3]  # line 0 was there twice, so it is compared twice; lines without a number are never the same
    assert (of["old_lines"], of["new_lines"], of["line_added"], of["line_cancelled"], of["quantity_changed"]) == (4, 5, 2, 1, 1)


def test_texts_of_interchanges_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("UNB+1'\nUNZ+1'\nUNB+2'\nUNZ+2'\n")
    rows = read_interchanges(spark, str(tmp_path))
    assert "SortMergeJoin" not in rows._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r["interchange_no"], r["text"].strip()) for r in rows.collect()) == [(1, "UNB+1'\nUNZ+1'"), (2, "UNB+2'\nUNZ+2'")]


def test_compressed_exports_are_read_back(spark, order_tables, tmp_path):
    before = _shuffle_files(spark)
    log = sinks.export_orders(*order_tables, str(tmp_path), AS_OF, compression="gzip")
    assert not _shuffle_files(spark) - before
    assert all(p.suffix == ".gz" for p in tmp_path.glob("edifact/*/part-*"))
    back = read_interchanges(spark, f"{tmp_path}/edifact")
    assert {r["text"].strip() for r in back.collect()} == {r["edi_text"].strip() for r in log.collect()} != set()


def test_documents_are_routed_from_stored_tables(spark, sf):
    plan = document_queries.route_extraction(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "Window" not in plan and "collect_list" not in plan


def test_intake_leaves_no_shuffled_rows(spark, sf):
    before = _shuffle_files(spark)
    found = document_queries.intake_stream(spark, sf)
    assert not _shuffle_files(spark) - before
    assert found.agg(F.sum("n")).first()[0] > 0
