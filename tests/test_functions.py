"""Column functions against plain Python expectations."""

import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from orderweave import fixed_values as fv
from orderweave.functions import specs, text, values


def run(spark, fn, inputs, dtype="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def folded(value, german=True):
    if german:
        for letter, spelled in fv.GERMAN_LETTERS.items():
            value = value.replace(letter, spelled)
    form = unicodedata.normalize("NFKD", value)
    return "".join(c for c in form if not unicodedata.combining(c)).encode(
        "ascii", "ignore").decode("ascii")


def test_fold_known_words(spark):
    words = ["Düsseldorf Größe", "straße", "façade référence", "plain"]
    assert run(spark, text.ascii_fold, words) == [
        "Duesseldorf Groesse", "strasse", "facade reference", "plain"]


def test_fold_equals_normalising_for_every_character(spark):
    chars = [chr(p) for p in range(128, 0x30000) if not 0xD800 <= p <= 0xDFFF]
    blocks = ["x".join(chars[i:i + 200]) for i in range(0, len(chars), 200)]
    assert run(spark, text.ascii_fold, blocks) == [folded(b) for b in blocks]
    got = run(spark, lambda c: text.ascii_fold(c, german=False), ["Stück ﬁ ½ ㎏"])
    assert got == [folded("Stück ﬁ ½ ㎏", german=False)]


def test_release_characters(spark):
    assert run(spark, text.message_text, ["a?b+c:d'e", None]) == ["a??b?+c?:d?'e", None]


def test_norm_code(spark):
    assert run(spark, text.norm_code, ["  pro-045-0020 ", None, "   ", "\tab "]) == [
        "PRO-045-0020", None, None, "AB"]


def test_payload_units(spark):
    spellings = ["u", "U", "unité", "ml", "kg", "t", "???", "Stück", "Kilograms", "pieces",
                 "mètres", " ", None, "to", "stuck"]
    assert run(spark, text.payload_unit, spellings) == [
        "PCE", "PCE", "PCE", "MTR", "KGM", "TNE", None, "PCE", "KGM", "PCE", "MTR", None, None,
        "TNE", "PCE"]


def test_table_units(spark):
    assert run(spark, text.table_unit, ["Stk.", "Stück", "STUCK", " m ", "KG"]) == [
        "PCE", "PCE", None, "MTR", "KGM"]


def test_numbers(spark):
    assert run(spark, values.german_number, ["2.400", "3,95", "x"]) == [2400.0, 3.95, None]
    assert run(spark, values.lenient_float, ["50", "3,5", "1e3", "", "12d", None]) == [
        50.0, 3.5, 1000.0, None, None, None]


@pytest.mark.parametrize("quantity", [150.0, 2.5, 0.125, 1234567.0, 3.14159, 0.0, 10.1])
def test_quantity_text(spark, quantity):
    wanted = (str(int(quantity)) if quantity == int(quantity)
              else f"{quantity:.3f}".rstrip("0").rstrip("."))
    assert run(spark, values.quantity_text, [quantity], "double") == [wanted]


def test_dates(spark):
    assert run(spark, values.german_date, ["15.09.2026", "31.02.2026", "1.2.2026", None]) == [
        date(2026, 9, 15), None, date(2026, 2, 1), None]
    assert run(spark, values.any_date, ["2026-05-01", "1.5.2026", "01/05/2026", "5/2026"]) == [
        date(2026, 5, 1)] * 3 + [None]
    weeks = run(spark, lambda c: values.week_date(c, F.lit(2026)),
                ["KW 38", "kw38/2026", "KW 53", "KW 54", "KW 53/2025", "x"])
    assert weeks == [date(2026, 9, 14), date(2026, 9, 14), date(2026, 12, 28), None, None, None]


def test_alloys(spark):
    texts = ["6060", "AlMgSi0.5", "EN AW-6063", "3.2315", "en aw 6005a T6", "6005", None, "steel",
             "Al Mg Si 1", "EN AW-6005"]
    assert run(spark, specs.canonical_alloy, texts) == [
        "EN AW-6060", "EN AW-6060", "EN AW-6063", "EN AW-6082", "EN AW-6005A", "EN AW-6005A",
        None, None, "EN AW-6082", "EN AW-6005"]


def test_dimensions(spark):
    texts = ["Corniere 40x40x3 mm", "40 x 30 x 2,5", "no dims here",
             "Tube rond Ø 40×3 mm, EN AW-6063", "Round tube Ø 50x3", "diam. ext. 60 * 2.5", None]
    got = run(spark, specs.dimensions, texts)
    assert [tuple(g[0]) if g else None for g in got] == [
        (40.0, 40.0, 3.0), (40.0, 30.0, 2.5), None, (40.0, 40.0, 3.0), (50.0, 50.0, 3.0),
        (60.0, 60.0, 2.5), None]
