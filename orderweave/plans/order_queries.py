"""Registered queries on order lines: resolution, flags, gates, messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.operators import flags, messages, orders, resolution
from orderweave.plans import fixtures as fx
from orderweave.plans.fixtures import with_views
from orderweave.session import shared_dir, staged
from orderweave.sources import sinks
from orderweave.sources.interchanges import read_interchanges

AS_OF = datetime(2024, 1, 30, 12, 0, 0)


def _resolved(spark, sf, fuzzy=True) -> DataFrame:
    lines = fx.lines(spark, sf)
    return resolution.resolve_lines(lines, fx.catalog(spark, sf), fx.aliases(lines), fuzzy=fuzzy)


def _exact_lines(spark, sf) -> DataFrame:
    """Lines resolved by their printed code alone, with flags."""
    exact = resolution.match_exact(fx.lines(spark, sf), fx.catalog(spark, sf))
    code = F.col("exact_code")
    return flags.flag_lines(exact.select(
        "*", code.alias("resolved_internal_code"),
        F.when(code.isNull(), "none").otherwise("exact").alias("match_tier"),
        F.when(code.isNull(), "absent").otherwise("confirmed").alias("code_check")))


def _flag_text(df: DataFrame) -> DataFrame:
    return df.withColumn("flags", F.array_join("confidence_flags", "|")).drop("confidence_flags")


def order_overview(spark, sf):
    """Flagship: lines, flagged, unmatched and exportable, for every order."""
    summary = orders.order_summary(fx.orders(spark, sf), _exact_lines(spark, sf))
    can = (F.col("line_count") > 0) & (F.col("unmatched_count") == 0)
    return summary.select("id", "customer", "line_count", "flagged_count", "unmatched_count",
                          can.alias("can_generate"))


_LINE_KEY = ("order_id", "line_no")


def extract_attributes(spark, sf):
    return resolution.extract_attributes(fx.lines(spark, sf)).select(
        *_LINE_KEY, "canon_alloy", "dim_w", "dim_h", "dim_t")


def match_learned(spark, sf):
    lines = fx.lines(spark, sf)
    return resolution.match_learned(lines, fx.aliases(lines), fx.catalog(spark, sf)).select(
        *_LINE_KEY, "learned_code")


def match_exact(spark, sf):
    return resolution.match_exact(fx.lines(spark, sf), fx.catalog(spark, sf)).select(
        *_LINE_KEY, "exact_code")


def match_dimension(spark, sf):
    return resolution.match_dimension(fx.lines(spark, sf), fx.catalog(spark, sf)).select(
        *_LINE_KEY, "dimension_code")


def match_fuzzy(spark, sf):
    return resolution.match_fuzzy(fx.lines(spark, sf), fx.catalog(spark, sf)).select(
        *_LINE_KEY, "fuzzy_code", "fuzzy_score")


def match_fuzzy_misspelled(spark, sf):
    """Descriptions with a dropped letter per line, which only the scorer can match."""
    text = F.col("description")
    at = (F.pmod(F.col("l_partkey"), F.lit(7)) + 2).cast("int")
    damaged = F.concat(F.expr("substring(description, 1, CAST(l_partkey % 7 + 1 AS INT))"),
                       F.expr("substring(description, CAST(l_partkey % 7 + 3 AS INT))"))
    lines = fx.lines(spark, sf).withColumn("description", F.when(F.length(text) > at, damaged))
    return resolution.match_fuzzy(lines, fx.catalog(spark, sf)).select(
        *_LINE_KEY, "fuzzy_code", F.round("fuzzy_score", 4).alias("fuzzy_score"))


def resolve_lines(spark, sf):
    return _resolved(spark, sf).select(*_LINE_KEY, "resolved_internal_code", "match_tier",
                                       "code_check")


def resolve_lines_without_fuzzy(spark, sf):
    return _resolved(spark, sf, fuzzy=False).select(
        *_LINE_KEY, "resolved_internal_code", "match_tier", "code_check")


def cross_check_codes(spark, sf):
    dims = resolution.match_dimension(fx.lines(spark, sf), fx.catalog(spark, sf))
    return resolution.cross_check_codes(dims, fx.catalog(spark, sf), "dimension_code").select(
        *_LINE_KEY, "dimension_code", "code_check")


def flag_lines(spark, sf):
    return _flag_text(flags.flag_lines(_resolved(spark, sf))).select(
        *_LINE_KEY, "match_tier", "flags")


def flag_frequency(spark, sf):
    return flags.flag_frequency(flags.flag_lines(_resolved(spark, sf)))


def _edits(spark, sf) -> DataFrame:
    """Operator edits derived from the lines: some codes inactive, some lines unknown."""
    lines = fx.lines(spark, sf).where("l_partkey % 6 = 0")
    items = fx.catalog(spark, sf).select(F.col("p_partkey").alias("l_partkey"),
                                         "internal_code")
    known = lines.withColumn("l_partkey", F.floor(F.col("l_partkey") / 2)).join(items, "l_partkey")
    return known.select(
        (F.col("order_id") * 1000 + F.col("line_no").cast("int")).alias("edit_id"),
        F.when(F.col("order_id") % 10 == 0, -F.col("order_id")).otherwise(F.col("order_id"))
        .alias("order_id"), "line_no", F.lower("internal_code").alias("internal_code"))


def apply_edits(spark, sf):
    result, _, _ = flags.apply_edits(_exact_lines(spark, sf), _edits(spark, sf),
                                     fx.catalog(spark, sf))
    return _flag_text(result).select(*_LINE_KEY, "resolved_internal_code", "match_tier", "flags")


def rejected_edits(spark, sf):
    _, rejects, _ = flags.apply_edits(_exact_lines(spark, sf), _edits(spark, sf),
                                      fx.catalog(spark, sf))
    return rejects


def learn_aliases(spark, sf):
    _, _, taught = flags.apply_edits(_exact_lines(spark, sf), _edits(spark, sf),
                                     fx.catalog(spark, sf))
    known = fx.aliases(fx.lines(spark, sf))
    return flags.learn_aliases(known, taught).select(
        "customer_code", "customer_part_code", "internal_code")


def order_gate_ready(spark, sf):
    ready, _, _ = orders.order_gate(fx.orders(spark, sf), _exact_lines(spark, sf))
    return ready.select("id", "line_count", "matched_count")


def order_gate_blocked(spark, sf):
    _, blocked, _ = orders.order_gate(fx.orders(spark, sf), _exact_lines(spark, sf))
    return blocked.select("id", "line_count", "matched_count", "reason")


def order_gate_blocking_lines(spark, sf):
    _, _, blocking = orders.order_gate(fx.orders(spark, sf), _exact_lines(spark, sf))
    return blocking


def orders_with_lines(spark, sf):
    nested = orders.orders_with_lines(fx.orders(spark, sf),
                                      fx.lines(spark, sf).drop("customer"))
    shown = F.transform("lines", lambda r: F.concat_ws(
        ":", r["line_no"], F.coalesce(r["extracted_code"], F.lit("-"))))
    return nested.select("id", "customer", "line_count",
                         F.array_join(shown, "|").alias("lines"))


def _message_input(spark, sf):
    """Orders whose lines all resolve: unresolved lines go to a sibling order."""
    lines = _exact_lines(spark, sf)
    code = F.coalesce("resolved_internal_code", F.when(
        F.col("order_id") % 3 != 0, F.concat(F.lit("OLD-"), F.col("l_partkey").cast("string"))))
    return fx.orders(spark, sf), lines.withColumn("resolved_internal_code", code).withColumn(
        "length_mm", F.when(F.col("l_partkey") % 2 == 0, F.col("quantity") * 100 + 0.5))


def _staged_input(spark, sf):
    """The same with the lines as a written table, for queries that go on for long after them."""
    heads, lines = _message_input(spark, sf)
    return heads, staged(lines.select("order_id", "line_no", "description", "quantity", "unit", "length_mm", "delivery_date",
                                      "resolved_internal_code"), "lines")


def generate_messages(spark, sf, kept=False):
    heads, lines = (_staged_input if kept else _message_input)(spark, sf)
    return messages.generate_messages(heads, lines, fx.catalog(spark, sf), AS_OF).select(
        "order_id", "edi_text", "segment_count")


def export_plan(spark, sf):
    heads, lines = _message_input(spark, sf)
    done = heads.where("id % 2 = 0").select(F.col("id").alias("order_id"))
    plan = messages.export_plan(heads, lines, fx.catalog(spark, sf), AS_OF, done)
    return plan.select("order_id", "edi_text", "segment_count", "status",
                       F.length("blob_path").cast("bigint").alias("path_chars"))


def export_round_trip(spark, sf):
    """Two exports, the first one run twice, read back from their files and merged into the orders."""
    heads, lines = _staged_input(spark, sf)
    catalog, out = fx.catalog(spark, sf), shared_dir(spark, "export")
    for even in (True, True, False):
        part = heads.where((F.col("id") % 2 == 0) | F.lit(not even))
        log = sinks.export_batch(part, lines.join(part.select(F.col("id").alias("order_id")), "order_id", "left_semi"),
                                 catalog, out, AS_OF, "first" if even else "second", compression="gzip")
    back = read_interchanges(spark, f"{out}/edifact").select(
        F.regexp_extract("text", r"UNH\+([^+']+)A\+", 1).alias("ref"), F.md5(F.rtrim("text", F.lit("\n"))).alias("md5"))
    written = log.select(F.col("order_id").alias("id"), "ref", F.col("batch").cast("string").alias("batch")).join(back, "ref", "left")
    merged = sinks.merge_status(heads.withColumn("status", F.lit("ready")), log)
    return merged.join(written, "id", "left").select(
        F.col("id").alias("order_id"), "status", "batch", "md5")


def fold_text(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return messages.fold_text(docs, ["text"])


def release_text(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return messages.fold_text(docs, ["text"], release=True)


QUERIES = {f.__name__: f for f in (
    order_overview, extract_attributes, match_learned, match_exact, match_dimension,
    match_fuzzy, match_fuzzy_misspelled, resolve_lines, resolve_lines_without_fuzzy,
    cross_check_codes, flag_lines, flag_frequency, apply_edits, rejected_edits,
    learn_aliases, order_gate_ready, order_gate_blocked, order_gate_blocking_lines,
    orders_with_lines, generate_messages, export_plan, export_round_trip, fold_text, release_text)}


# --- oracle ---------------------------------------------------------------------

_NORM = "nullif(upper(trim(extracted_code)), '')"
_ALLOY = ("CASE WHEN regexp_matches({0}, '(?i)en\\s*aw[-\\s]?\\d{{4}}[a-z]?') THEN "
          "'EN AW-' || upper(regexp_extract({0}, '(?i)en\\s*aw[-\\s]?(\\d{{4}}[a-z]?)', 1)) END")
_DIM = "'(\\d+(?:[.,]\\d+)?)\\s*[x×*]\\s*(\\d+(?:[.,]\\d+)?)\\s*[x×*]\\s*(\\d+(?:[.,]\\d+)?)'"


def _dim(i: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract(description, {_DIM}, {i}), '') AS DOUBLE)"


_EXACT = {
    "idx": "SELECT upper(trim(internal_code)) AS code, max(internal_code) AS item "
           "FROM fx_catalog WHERE status = 'A' GROUP BY 1",
    "ex": f"SELECT l.*, i.item AS resolved, "
          "CASE WHEN i.item IS NULL THEN 'none' ELSE 'exact' END AS tier "
          f"FROM fx_lines l LEFT JOIN idx i ON {_NORM} = i.code",
}
_UNIT_BAD = ("quantity IS NULL OR unit IS NULL OR unit NOT IN ('PCE','MTR','KGM','TNE')")


def _flags_sql(resolved: str, tier: str, check: str) -> str:
    return (f"concat_ws('|', CASE WHEN {resolved} IS NULL THEN 'unmatched_code' "
            f"WHEN {tier} NOT IN ('exact','manual','learned') THEN 'weak_match' END, "
            f"CASE WHEN {_UNIT_BAD} THEN 'ambiguous_unit' END, "
            f"CASE WHEN {check} = 'mismatch' THEN 'code_mismatch' END)")


_FLAGGED = {**_EXACT, "fl": f"SELECT *, {_flags_sql('resolved', 'tier', chr(39) + 'x' + chr(39))} "
                            "AS flags FROM ex"}
_COUNTS = {**_FLAGGED, "counts": """
    SELECT o.id, o.customer, o.created_at, count(l.order_id) AS line_count,
           count(*) FILTER (WHERE l.flags <> '') AS flagged_count,
           count(*) FILTER (WHERE l.order_id IS NOT NULL AND l.resolved IS NULL) AS unmatched_count
    FROM fx_orders o LEFT JOIN fl l ON l.order_id = o.id GROUP BY 1, 2, 3"""}
_DIMENSION = {
    "spec": f"SELECT order_id, line_no, extracted_code, description, "
            f"{_ALLOY.format('description')} AS alloy, {_dim(1)} AS w, {_dim(2)} AS h, "
            f"{_dim(3)} AS t FROM fx_lines",
    "cand": """SELECT s.order_id, s.line_no, c.internal_code, c.alloy = s.alloy AS same
               FROM spec s JOIN fx_catalog c ON c.status = 'A'
                AND least(c.width_mm, c.height_mm) = least(s.w, s.h)
                AND greatest(c.width_mm, c.height_mm) = greatest(s.w, s.h)
                AND abs(c.wall_thickness_mm - s.t) <= 0.1
               WHERE s.w IS NOT NULL""",
    "dim": """SELECT order_id, line_no,
                     CASE WHEN count(*) FILTER (WHERE same) = 1
                          THEN min(internal_code) FILTER (WHERE same)
                          WHEN count(*) FILTER (WHERE same) = 0 AND count(*) = 1
                          THEN min(internal_code) END AS code
              FROM cand GROUP BY 1, 2""",
}
# From sf0.01 up, every description holds all words of an active target of its alloy,
# which is the highest score; so containment decides the fuzzy tier on these tables.
# Smaller tables lack some targets; there only the unit tests' brute force is a measure.
_FUZZY = {
    "texts": f"SELECT DISTINCT description, {_ALLOY.format('description')} AS alloy, "
             "list_distinct(string_split(description, ' ')) AS words FROM fx_lines "
             "WHERE description IS NOT NULL",
    "targets": "SELECT concat(profile_name, ' ', alloy) AS target, alloy, "
               "min(internal_code) AS code FROM fx_catalog WHERE status = 'A' GROUP BY 1, 2",
    "fz": """SELECT x.description, min(t.code) AS code FROM texts x JOIN targets t
             ON t.alloy = x.alloy AND list_has_all(x.words, string_split(t.target, ' '))
             GROUP BY 1""",
}
# The score itself, for texts that no set of words settles. The longest common subsequence of what is left
# of both sides goes row by row over the letters of one, with the list of the lengths so far.
_SCORED = {
    "damaged": """
        SELECT order_id, line_no, CASE WHEN length(description) > l_partkey % 7 + 2 THEN
               concat(substring(description, 1, CAST(l_partkey % 7 + 1 AS INT)),
                      substring(description, CAST(l_partkey % 7 + 3 AS INT))) END AS description FROM fx_lines""",
    "said": f"""
        SELECT description, {_ALLOY.format('description')} AS alloy,
               list_distinct(list_filter(string_split(description, ' '), lambda w: w <> '')) AS words
        FROM (SELECT DISTINCT description FROM damaged WHERE description IS NOT NULL)""",
    "goals": """
        SELECT target, alloy, code, list_distinct(list_filter(string_split(target, ' '), lambda w: w <> '')) AS words
        FROM (SELECT concat(profile_name, ' ', alloy) AS target, alloy, min(internal_code) AS code
              FROM fx_catalog WHERE status = 'A' GROUP BY 1, 2)""",
    "sides": """
        SELECT x.description, g.code, CASE WHEN x.alloy = g.alloy THEN 5.0 ELSE 0.0 END AS bonus,
               length(array_to_string(list_filter(x.words, lambda w: list_contains(g.words, w)), ' ')) AS common,
               array_to_string(list_sort(list_filter(x.words, lambda w: NOT list_contains(g.words, w))), ' ') AS a,
               array_to_string(list_sort(list_filter(g.words, lambda w: NOT list_contains(x.words, w))), ' ') AS b
        FROM said x CROSS JOIN goals g""",
    "cut": """SELECT DISTINCT a, b, string_split(a, '') AS la, string_split(b, '') AS lb FROM sides
              WHERE a <> '' AND b <> ''""",
    "sub": """
        SELECT a, b, list_reduce(list_prepend(list_transform(range(len(lb) + 1), lambda i: 0),
            list_transform(la, lambda x: list_transform(lb, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))),
            lambda before, same: list_reduce(list_prepend([0], list_transform(range(1, len(same) + 1),
                lambda j: [same[j], before[j], before[j + 1]])),
                lambda row, e: list_append(row, CASE WHEN e[1] = 1 THEN e[2] + 1
                                                     ELSE greatest(row[len(row)], e[3]) END)))[len(lb) + 1] AS n
        FROM cut""",
    "parts": """
        SELECT s.*, coalesce(sub.n, 0) AS n, length(s.a) AS na, length(s.b) AS nb,
               CASE WHEN common > 0 THEN 1 ELSE 0 END AS gap
        FROM sides s LEFT JOIN sub ON sub.a = s.a AND sub.b = s.b""",
    "graded": """
        SELECT description, code, bonus + CASE WHEN common > 0 AND (na = 0 OR nb = 0) THEN 100.0
            ELSE greatest(100.0 - 100.0 * (na + nb - 2 * n) / (2 * common + 2 * gap + na + nb),
                 CASE WHEN common > 0 THEN 100.0 - 100.0 * (1 + na) / (2 * common + 1 + na) ELSE 0.0 END,
                 CASE WHEN common > 0 THEN 100.0 - 100.0 * (1 + nb) / (2 * common + 1 + nb) ELSE 0.0 END) END AS score
        FROM parts""",
    "best": """
        SELECT description, code, score FROM graded WHERE score >= 86
        QUALIFY row_number() OVER (PARTITION BY description ORDER BY score DESC, code) = 1""",
}
_LEARNED = {
    "idx": _EXACT["idx"],
    "learn": "SELECT a.customer_code, a.customer_part_code, i.item FROM fx_aliases a "
             "JOIN idx i ON upper(trim(a.internal_code)) = i.code",
    "le": f"SELECT l.*, a.item AS learned FROM fx_lines l LEFT JOIN learn a "
          f"ON a.customer_code = l.customer AND a.customer_part_code = {_NORM}",
}


def _resolve(fuzzy: bool) -> dict[str, str]:
    fuzzy_code = "f.code" if fuzzy else "NULL"
    return {
        **_LEARNED, **_DIMENSION, **_FUZZY,
        "res0": f"""
            SELECT l.*, i.item AS read_item, {_NORM} AS norm,
                   CASE WHEN l.learned IS NOT NULL THEN 'learned'
                        WHEN l.trusted AND i.item IS NOT NULL THEN 'exact'
                        WHEN d.code IS NOT NULL THEN 'dimension'
                        WHEN {fuzzy_code} IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS tier,
                   d.code AS dim_code, {fuzzy_code} AS fuzzy_code
            FROM le l LEFT JOIN idx i ON {_NORM} = i.code
            LEFT JOIN dim d ON d.order_id = l.order_id AND d.line_no = l.line_no
            LEFT JOIN fz f ON f.description = l.description""",
        "res1": """SELECT *, CASE tier WHEN 'learned' THEN learned WHEN 'exact' THEN read_item
                      WHEN 'dimension' THEN dim_code WHEN 'fuzzy' THEN fuzzy_code END AS resolved
                   FROM res0""",
        "res": """SELECT *, CASE WHEN tier IN ('learned', 'exact') THEN 'confirmed'
                      WHEN tier = 'none' OR norm IS NULL THEN 'absent'
                      WHEN norm = upper(trim(resolved)) THEN 'confirmed'
                      WHEN read_item IS NOT NULL THEN 'mismatch' ELSE 'absent' END AS chk
                  FROM res1""",
    }


_ALL_VIEWS = "fx_catalog fx_lines fx_aliases"
_EDITS = {
    **_FLAGGED,
    "edits": """SELECT l.order_id * 1000 + CAST(l.line_no AS BIGINT) AS edit_id,
                       CASE WHEN l.order_id % 10 = 0 THEN -l.order_id ELSE l.order_id END
                           AS order_id, l.line_no, lower(c.internal_code) AS internal_code
                FROM fx_lines l JOIN fx_catalog c ON c.p_partkey = l.l_partkey // 2
                WHERE l.l_partkey % 6 = 0""",
    "judged": """SELECT e.*, i.item, k.customer, k.extracted_code,
                        CASE WHEN k.order_id IS NULL THEN 'line_not_found'
                             WHEN i.item IS NULL THEN 'code_not_active' END AS reason
                 FROM edits e LEFT JOIN idx i ON i.code = upper(trim(e.internal_code))
                 LEFT JOIN fx_lines k ON k.order_id = e.order_id AND k.line_no = e.line_no""",
}
_MESSAGE = {
    **_EXACT,
    "ml": """SELECT *, CASE WHEN l_partkey % 2 = 0 THEN quantity * 100 + 0.5 END AS len_mm,
                    coalesce(resolved, CASE WHEN order_id % 3 <> 0
                        THEN concat('OLD-', CAST(l_partkey AS STRING)) END) AS code FROM ex""",
    "ready": """SELECT order_id, count(*) AS n FROM ml GROUP BY 1
                HAVING count(*) FILTER (WHERE code IS NULL) = 0""",
    "seg": """SELECT order_id, line_no, row_number() OVER (PARTITION BY order_id
                     ORDER BY line_no) AS k, code, description, unit, len_mm, delivery_date,
                     coalesce(quantity, 0) AS q FROM ml""",
    "body": """SELECT order_id, string_agg(concat(
                 'LIN+', k, '++', code, ':SA''', chr(10), 'PIA+1+', code, ':SA''', chr(10),
                 CASE WHEN description IS NULL THEN '' ELSE concat('IMD+F++:::', description,
                      '''', chr(10)) END,
                 'QTY+21:', CAST(CAST(q AS BIGINT) AS STRING), ':', coalesce(unit, 'PCE'), '''',
                 chr(10),
                 CASE WHEN coalesce(len_mm, 0) = 0 THEN '' ELSE concat('MEA+PD+AAC+',
                      CAST(len_mm AS STRING), ':MMT''', chr(10)) END,
                 'DTM+2:', strftime(delivery_date, '%Y%m%d'), ':102''', chr(10)), '' ORDER BY k)
                   AS txt,
                 CAST(sum(4 + CAST(description IS NOT NULL AS INT)
                     + CAST(coalesce(len_mm, 0) <> 0 AS INT)) AS BIGINT) AS segs
               FROM seg GROUP BY 1""",
    "msg": """SELECT o.id AS order_id, left(concat('OI', o.id, '120000'), 13) AS ref, r.n,
                     b.txt, b.segs + 11 + CAST(o.order_ref IS NOT NULL AS INT) AS unt, o.order_ref,
                     o.order_date
              FROM fx_orders o JOIN ready r ON r.order_id = o.id
              JOIN body b ON b.order_id = o.id""",
    "full_msg": """SELECT order_id, concat(
            'UNB+UNOA:2+0000000000000+4012345123456+240130:1200+', ref, '''', chr(10),
            'UNH+', ref, 'A+ORDERS:D:96A:UN''', chr(10),
            'BGM+220+', coalesce(order_ref, CAST(order_id AS STRING)), '+9''', chr(10),
            'DTM+137:', strftime(order_date, '%Y%m%d'), ':102''', chr(10),
            CASE WHEN order_ref IS NULL THEN '' ELSE concat('RFF+ON:', order_ref, '''', chr(10)) END,
            'NAD+BY+0000000000000::9''', chr(10), 'NAD+SU+4012345123456::9''', chr(10),
            'NAD+DP+0000000000000::9''', chr(10), 'CUX+2:EUR:9''', chr(10),
            'PAT+1++5:3:D:30''', chr(10), txt, 'UNS+S''', chr(10), 'CNT+2:', n, '''', chr(10),
            'UNT+', unt, '+', ref, 'A''', chr(10), 'UNZ+1+', ref, '''', chr(10)) AS edi_text,
            unt + 2 AS segment_count FROM msg""",
}
_GERMAN = ("replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'),"
           " 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss')")
_FOLD = f"regexp_replace(strip_accents({_GERMAN}), '[^\\x00-\\x7F]', '', 'g')"

ORACLE = {
    "order_overview": with_views("fx_catalog fx_lines fx_orders", _COUNTS, """
        SELECT id, customer, line_count, flagged_count, unmatched_count,
               line_count > 0 AND unmatched_count = 0 AS can_generate FROM counts"""),
    "extract_attributes": with_views("fx_lines", _DIMENSION, """
        SELECT order_id, line_no, alloy AS canon_alloy, w AS dim_w, h AS dim_h, t AS dim_t
        FROM spec"""),
    "match_learned": with_views(_ALL_VIEWS, _LEARNED, """
        SELECT order_id, line_no, learned AS learned_code FROM le"""),
    "match_exact": with_views("fx_lines", _EXACT, """
        SELECT order_id, line_no, resolved AS exact_code FROM ex"""),
    "match_dimension": with_views("fx_lines", _DIMENSION, """
        SELECT l.order_id, l.line_no, d.code AS dimension_code FROM fx_lines l
        LEFT JOIN dim d ON d.order_id = l.order_id AND d.line_no = l.line_no"""),
    "match_fuzzy": with_views("fx_lines", _FUZZY, """
        SELECT l.order_id, l.line_no, f.code AS fuzzy_code,
               CASE WHEN f.code IS NOT NULL THEN 105.0 END AS fuzzy_score
        FROM fx_lines l LEFT JOIN fz f ON f.description = l.description"""),
    "match_fuzzy_misspelled": with_views("fx_lines", _SCORED, """
        SELECT d.order_id, d.line_no, b.code AS fuzzy_code, round(b.score, 4) AS fuzzy_score
        FROM damaged d LEFT JOIN best b ON b.description = d.description"""),
    "resolve_lines": with_views(_ALL_VIEWS, _resolve(True), """
        SELECT order_id, line_no, resolved AS resolved_internal_code, tier AS match_tier,
               chk AS code_check FROM res"""),
    "resolve_lines_without_fuzzy": with_views(_ALL_VIEWS, _resolve(False), """
        SELECT order_id, line_no, resolved AS resolved_internal_code, tier AS match_tier,
               chk AS code_check FROM res"""),
    "cross_check_codes": with_views("fx_lines", {"idx": _EXACT["idx"], **_DIMENSION}, f"""
        SELECT l.order_id, l.line_no, d.code AS dimension_code,
               CASE WHEN d.code IS NULL OR {_NORM} IS NULL THEN 'absent'
                    WHEN {_NORM} = upper(trim(d.code)) THEN 'confirmed'
                    WHEN i.item IS NOT NULL THEN 'mismatch' ELSE 'absent' END AS code_check
        FROM fx_lines l LEFT JOIN dim d ON d.order_id = l.order_id AND d.line_no = l.line_no
        LEFT JOIN idx i ON i.code = {_NORM}"""),
    "flag_lines": with_views(_ALL_VIEWS, _resolve(True), f"""
        SELECT order_id, line_no, tier AS match_tier,
               {_flags_sql('resolved', 'tier', 'chk')} AS flags FROM res"""),
    "flag_frequency": with_views(_ALL_VIEWS, {**_resolve(True), "ff": f"""
        SELECT tier, customer, unnest(string_split({_flags_sql('resolved', 'tier', 'chk')}, '|'))
               AS flag FROM res"""}, """
        SELECT flag, tier AS match_tier, customer, count(*) AS n FROM ff WHERE flag <> ''
        GROUP BY 1, 2, 3"""),
    "apply_edits": with_views("fx_lines", {**_EDITS, "last": """
        SELECT order_id, line_no, max_by(item, edit_id) AS item FROM judged
        WHERE reason IS NULL GROUP BY 1, 2"""}, f"""
        SELECT f.order_id, f.line_no, coalesce(e.item, f.resolved) AS resolved_internal_code,
               CASE WHEN e.item IS NULL THEN f.tier ELSE 'manual' END AS match_tier,
               CASE WHEN e.item IS NULL THEN f.flags
                    WHEN {_UNIT_BAD} THEN 'ambiguous_unit' ELSE '' END AS flags
        FROM fl f LEFT JOIN last e ON e.order_id = f.order_id AND e.line_no = f.line_no"""),
    "rejected_edits": with_views("fx_lines", _EDITS, """
        SELECT edit_id, order_id, line_no, internal_code, reason FROM judged
        WHERE reason IS NOT NULL"""),
    "learn_aliases": with_views(_ALL_VIEWS, {**_EDITS, "both_sides": f"""
        SELECT customer_code, customer_part_code, internal_code, -1 AS seq FROM fx_aliases
        UNION ALL SELECT customer, {_NORM}, item, edit_id FROM judged
        WHERE reason IS NULL AND {_NORM} IS NOT NULL"""}, """
        SELECT customer_code, customer_part_code, max_by(internal_code, seq) AS internal_code
        FROM both_sides GROUP BY 1, 2"""),
    "order_gate_ready": with_views("fx_lines fx_orders", _COUNTS, """
        SELECT id, line_count, line_count - unmatched_count AS matched_count FROM counts
        WHERE line_count > 0 AND unmatched_count = 0"""),
    "order_gate_blocked": with_views("fx_lines fx_orders", _COUNTS, """
        SELECT id, line_count, line_count - unmatched_count AS matched_count,
               CASE WHEN line_count = 0 THEN 'no_lines' ELSE 'unresolved_lines' END AS reason
        FROM counts WHERE line_count = 0 OR unmatched_count > 0"""),
    "order_gate_blocking_lines": with_views("fx_lines", _EXACT, """
        SELECT order_id, line_no FROM ex WHERE resolved IS NULL"""),
    "orders_with_lines": with_views("fx_lines fx_orders", {}, """
        SELECT o.id, o.customer, count(l.order_id) AS line_count,
               coalesce(string_agg(concat(l.line_no, ':', coalesce(l.extracted_code, '-')), '|'
                   ORDER BY l.line_no) FILTER (WHERE l.order_id IS NOT NULL), '') AS lines
        FROM fx_orders o LEFT JOIN fx_lines l ON l.order_id = o.id GROUP BY 1, 2"""),
    "generate_messages": with_views("fx_lines fx_orders", _MESSAGE, """
        SELECT order_id, edi_text, segment_count FROM full_msg"""),
    "export_plan": with_views("fx_lines fx_orders", _MESSAGE, """
        SELECT order_id, edi_text, segment_count,
               'edifact_generated' AS status,
               CAST(27 + length(CAST(order_id AS STRING)) AS BIGINT) AS path_chars
        FROM full_msg WHERE order_id % 2 <> 0"""),
    "export_round_trip": with_views("fx_lines fx_orders", _MESSAGE, """
        SELECT o.id AS order_id, CASE WHEN m.order_id IS NULL THEN 'ready' ELSE 'edifact_generated' END AS status,
               CASE WHEN m.order_id % 2 = 0 THEN 'first' WHEN m.order_id % 2 = 1 THEN 'second' END AS batch,
               md5(rtrim(m.edi_text, chr(10))) AS md5
        FROM fx_orders o LEFT JOIN full_msg m ON m.order_id = o.id"""),
    "fold_text": f"SELECT doc_id, {_FOLD} AS text FROM documents",
    "release_text": f"SELECT doc_id, regexp_replace({_FOLD}, '([?+:''])', '?\\1', 'g') AS text "
                    "FROM documents",
}
