"""Tiers, flags, edits and the fuzzy scorer against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from orderweave.functions.similarity import token_set_score
from orderweave.operators import flags, names, resolution
from orderweave.operators.names import best_targets

CATALOG = [
    ("AE-2024-036", "Equal Angle 40x40x3", "EN AW-6060", 40.0, 40.0, 3.0, "A"),
    ("AE-2024-071", "T-Slot Profile 40x40 Nut 8", "EN AW-6060", 40.0, 40.0, 2.5, "A"),
    ("AE-2025-030", "Heat Sink 100x30 20 Fins", "EN AW-6063", 100.0, 30.0, 10.0, "A"),
    ("AE-2024-034", "Equal Angle 20x20x2", "EN AW-6060", 20.0, 20.0, 2.0, "A"),
    ("AE-2024-099", "Old Angle 20x20x2", "EN AW-6060", 20.0, 20.0, 2.0, "I"),
]
SCHEMA = ("internal_code string, profile_name string, alloy string, width_mm double, "
          "height_mm double, wall_thickness_mm double, status string")
LINES = ("order_id int, line_no string, customer string, trusted boolean, "
         "extracted_code string, description string, alloy string")


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, SCHEMA)


@pytest.fixture(scope="module")
def no_aliases(spark):
    return spark.createDataFrame([], "customer_code string, customer_part_code string, "
                                     "internal_code string")


def resolve(spark, rows, catalog, aliases, **kw):
    lines = spark.createDataFrame(
        [(1, f"{i:03d}", "x", *r) for i, r in enumerate(rows)], LINES)
    got = resolution.resolve_lines(lines, catalog, aliases, **kw).orderBy("line_no").collect()
    return [(r["resolved_internal_code"], r["match_tier"], r["code_check"]) for r in got]


def test_tiers(spark, catalog, no_aliases):
    rows = [
        (True, None, "Corniere 40x40x3 mm EN AW-6060", "6060"),
        (True, None, "Heat Sink 100x30 20 Fins", None),
        (True, None, "completely unrelated gibberish zzz", None),
        (False, "AE-2024-034", "Corniere a ailes egales 40x40x3 mm EN AW-6060 T66", "6060"),
        (False, "AE-2024-036", "Equal angle 40x40x3 EN AW-6060", "6060"),
        (False, "PRO-045-0020", "Equal angle 40x40x3 EN AW-6060", "6060"),
        (True, " ae-2024-034 ", None, None),
        (True, "AE-2024-099", None, None),
        (True, "   ", "", None),
    ]
    assert resolve(spark, rows, catalog, no_aliases) == [
        ("AE-2024-036", "dimension", "absent"), ("AE-2025-030", "fuzzy", "absent"),
        (None, "none", "absent"), ("AE-2024-036", "dimension", "mismatch"),
        ("AE-2024-036", "dimension", "confirmed"), ("AE-2024-036", "dimension", "absent"),
        ("AE-2024-034", "exact", "confirmed"), (None, "none", "absent"),
        (None, "none", "absent")]


def test_learned_comes_first_and_needs_an_active_target(spark, catalog):
    aliases = spark.createDataFrame(
        [("x", "PRO-045-0020", "AE-2024-071"), ("x", "DEAD", "AE-2024-099"),
         ("y", "ONLY-Y", "AE-2024-071")],
        "customer_code string, customer_part_code string, internal_code string")
    rows = [(False, "pro-045-0020", "window frame", None), (True, "DEAD", None, None),
            (False, "ONLY-Y", None, None)]
    assert resolve(spark, rows, catalog, aliases) == [
        ("AE-2024-071", "learned", "confirmed"), (None, "none", "absent"),
        (None, "none", "absent")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_codes_are_looked_up_once_and_only_open_lines_are_joined(spark, catalog, no_aliases):
    rows = [(1, f"{i:03d}", "x", True, code, text, alloy) for i, (code, text, alloy) in enumerate([
        ("AE-2024-036", "Equal angle 40x40x3 EN AW-6060", None), (None, "T-Slot 40x40x2,5", "6060"),
        (None, None, None), ("nowhere", "", "6060"), (None, "T-Slot 40x40x2,5", None)])]
    for null_trust in (False, True):
        lines = spark.createDataFrame([(*r[:3], None if null_trust else r[3], *r[4:]) for r in rows], LINES)
        found = resolution.resolve_lines(lines, catalog, no_aliases, fuzzy=False)
        assert _plan(found).count("Join LeftOuter") == 1
        got = [tuple(r)[-3:] for r in found.orderBy("line_no").collect()]
        first = ("AE-2024-036", "dimension" if null_trust else "exact", "confirmed")
        assert got == [first, ("AE-2024-071", "dimension", "absent"), (None, "none", "absent"),
                       (None, "none", "absent"), ("AE-2024-071", "dimension", "absent")]


def test_flags_are_worked_out_once_a_line(spark, catalog, no_aliases):
    lines = spark.createDataFrame([(1, "1", "x", True, "AE-2024-036", None, None), (1, "2", "x", True, None, "?", None)], LINES)
    full = lines.withColumns({"quantity": F.lit(None).cast("double"), "unit": F.lit("PCE")})
    counted = flags.flag_frequency(flags.flag_lines(resolution.resolve_lines(full, catalog, no_aliases, fuzzy=False)))
    assert "size(" not in _plan(counted)
    assert sorted(tuple(r) for r in counted.collect()) == [
        ("ambiguous_unit", "exact", "x", 1), ("ambiguous_unit", "none", "x", 1), ("unmatched_code", "none", "x", 1)]


def test_round_tube(spark, no_aliases):
    tube = spark.createDataFrame([("AE-2024-052", "Round Tube OD40x3", "EN AW-6060", 40.0, 40.0,
                                   3.0, "A")], SCHEMA)
    rows = [(False, "AE-2024-052", "Tube rond Ø 40×3 mm, EN AW-6063 T66, 5500 mm", "6063")]
    assert resolve(spark, rows, tube, no_aliases) == [
        ("AE-2024-052", "dimension", "confirmed")]


def test_dimension_tolerance_and_uniqueness(spark, no_aliases):
    items = spark.createDataFrame([
        ("C1", "a", "EN AW-6060", 10.0, 20.0, 2.05, "A"), ("C2", "b", "EN AW-6063", 20.0, 10.0,
                                                          1.95, "A"),
        ("C3", "c", "EN AW-6060", 30.0, 30.0, 2.0, "A"), ("C4", "d", "EN AW-6060", 30.0, 30.0,
                                                          2.0, "A"),
        ("C5", "e", None, None, 30.0, 2.0, "A")], SCHEMA)
    rows = [(True, None, "20x10x2", "6060"), (True, None, "10x20x2", None),
            (True, None, "30x30x2", "6060"), (True, None, "10x20x2", "6082"),
            (True, None, "10 x 20 x 2,3", None)]
    got = resolve(spark, rows, items, no_aliases, fuzzy=False)
    assert [g[0] for g in got] == ["C1", None, None, None, None]


def brute_force(description, alloy, catalog):
    """Every target scored, first in code order on ties."""
    from orderweave import fixed_values as fv
    best, best_code = 0.0, None
    for code, name, item_alloy, *_, status in sorted(catalog):
        if status != "A":
            continue
        score = token_set_score(frozenset(description.split()),
                                frozenset(f"{name} {item_alloy or ''}".split()))
        if alloy and item_alloy == alloy:
            score += fv.ALLOY_BONUS
        if score > best:
            best, best_code = score, code
    return best_code if best >= fv.FUZZY_THRESHOLD else None


@pytest.mark.parametrize("seed", [7, 8])
def test_fuzzy_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = "Angle Equal Tube Round Slot Profile Heat Sink Beam Flat Bar Corner U T".split()
    alloys = ["EN AW-6060", "EN AW-6063", None]
    items = []
    for i in range(60):
        name = " ".join(rng.sample(words, rng.randint(1, 4)))
        items.append((f"C{i:03d}", name, rng.choice(alloys), 1.0, 1.0, 1.0,
                      rng.choice("AAAAI")))
    texts = []
    for _ in range(250):
        _, name, alloy, *_ = rng.choice(items)
        parts = name.split() + rng.sample(words, rng.randint(0, 2))
        rng.shuffle(parts)
        said = " ".join(parts)
        if rng.random() < 0.6:
            at = rng.randrange(len(said))
            said = said[:at] + rng.choice("xyz ") + said[at + rng.randint(0, 1):]
        texts.append((said.strip(), alloy if rng.random() < 0.7 else None))
    lines = spark.createDataFrame(
        [(1, f"{i:03d}", "x", True, None, t, a) for i, (t, a) in enumerate(texts)], LINES)
    got = resolution.match_fuzzy(lines, spark.createDataFrame(items, SCHEMA))
    found = {r["line_no"]: r["fuzzy_code"] for r in got.collect()}
    wanted = {f"{i:03d}": brute_force(t, a, items) for i, (t, a) in enumerate(texts)}
    assert found == wanted
    assert len(set(found.values())) > 10


@pytest.mark.parametrize("accept", [86.0, 70.0, 99.0])
def test_the_join_finds_every_best_target(spark, accept):
    """Short words, single letters, repeated pairs of letters, very long texts: as scoring all pairs."""
    rng = random.Random(accept)

    def name(most):
        return " ".join("".join(rng.choices("aabcde1é😀", k=rng.choice([1, 1, 2, 3, 8]))) for _ in range(rng.randint(1, most)))

    targets = [(name(5), rng.choice(["X", "Y", None]), f"C{i:03d}") for i in range(70)]
    texts = {(name(6), rng.choice(["X", "Z", None])) for _ in range(150)} | {("ab " * 400, "X"), (" \t ", "Y")}
    for target, alloy, _ in targets[:40]:
        at = rng.randrange(len(target))
        texts.add((target[:at] + rng.choice(["", "e", " "]) + target[at + 1:], alloy))
    want = {}
    for text, alloy in texts:
        best = min(((-(token_set_score(frozenset(text.split()), frozenset(target.split())) + 5.0 * bool(alloy and alloy == own)), code)
                    for target, own, code in targets))
        if -best[0] >= accept:
            want[text, alloy] = (best[1], -best[0])
    found = best_targets(spark.createDataFrame(sorted(texts, key=str), "description string, canon string"),
                         spark.createDataFrame(targets, "target string, target_alloy string, code string"), accept, 5.0)
    assert {(r.description, r.canon): (r.code, r.score) for r in found.collect()} == want
    assert len(want) > 20


def test_candidates_are_far_fewer_than_pairs(spark):
    """At the upper level keys join about the pairs that score so high; not every text meets every target."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(400)]
    targets = [(" ".join(rng.sample(words, 3)), None, f"C{i:04d}") for i in range(600)]
    texts = [(t[:2] + t[3:], None) for t, _, _ in targets]
    specs, goal = (spark.createDataFrame(rows, schema) for rows, schema in (
        (texts, "description string, canon string"), (targets, "target string, target_alloy string, code string")))
    seen = []
    inner = names.candidates
    try:
        names.candidates = lambda *a: seen.append(inner(*a)) or seen[-1]
        found = best_targets(specs, goal, 86.0, 5.0).collect()
    finally:
        names.candidates = inner
    assert len(found) >= 590
    assert seen[0].count() < 600 * 600 * 0.02


def slow_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = (rows[i][j] + 1 if x == y
                                  else max(rows[i][j + 1], rows[i + 1][j]))
    return rows[-1][-1]


def test_common_subsequence_length():
    from orderweave.functions.similarity import lcs_length
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choices("abcd é", k=rng.randint(0, 90)))
        b = "".join(rng.choices("abcd é", k=rng.randint(0, 90)))
        assert lcs_length(a, b) == slow_lcs(a, b)


def test_token_set_score_examples():
    def score(a, b):
        return token_set_score(frozenset(a.split()), frozenset(b.split()))
    assert score("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert score("", "x") == 0.0
    assert score("abcd", "abcf") == 75.0
    assert round(score("new york mets", "new york meats"), 4) == 96.2963


def test_flags(spark):
    rows = [
        (1, "C", "exact", 150.0, "PCE", "confirmed"), (2, None, "none", None, None, "absent"),
        (3, "C", "dimension", 1.0, "PCE", "mismatch"), (4, "C", "learned", 1.0, "box", "absent"),
        (5, "", "none", 1.0, "TNE", "absent")]
    df = spark.createDataFrame(rows, "i int, resolved_internal_code string, match_tier string, "
                                     "quantity double, unit string, code_check string")
    got = {r["i"]: r["confidence_flags"] for r in flags.flag_lines(df).collect()}
    assert got == {1: [], 2: ["unmatched_code", "ambiguous_unit"],
                   3: ["weak_match", "code_mismatch"], 4: ["ambiguous_unit"],
                   5: ["unmatched_code"]}


def test_edits_teach_and_reject(spark, catalog):
    lines = spark.createDataFrame(
        [(1, "010", "x", True, " pro-1 ", None, None), (1, "020", "x", True, None, None, None)],
        LINES).withColumns({
            "quantity": F.lit(5.0), "unit": F.lit("PCE"),
            "resolved_internal_code": F.lit(None).cast("string"), "match_tier": F.lit("none"),
            "confidence_flags": F.array(F.lit("unmatched_code"), F.lit("code_mismatch"))})
    edits = spark.createDataFrame(
        [(1, 1, "010", "AE-2024-034"), (2, 1, "010", "ae-2024-036"), (3, 1, "020", "NOPE"),
         (4, 9, "010", "AE-2024-034"), (5, 1, "020", "AE-2024-071")],
        "edit_id bigint, order_id int, line_no string, internal_code string")
    done, rejects, taught = flags.apply_edits(lines, edits, catalog)
    assert [(r["resolved_internal_code"], r["match_tier"], r["confidence_flags"])
            for r in done.orderBy("line_no").collect()] == [
        ("AE-2024-036", "manual", []), ("AE-2024-071", "manual", [])]
    assert {(r["edit_id"], r["reason"]) for r in rejects.collect()} == {
        (3, "code_not_active"), (4, "line_not_found")}
    old = spark.createDataFrame([("x", "PRO-1", "AE-2025-030"), ("y", "PRO-1", "AE-2025-030")],
                                "customer_code string, customer_part_code string, "
                                "internal_code string")
    learned = {(r[0], r[1]): r[2] for r in flags.learn_aliases(old, taught).collect()}
    assert learned == {("x", "PRO-1"): "AE-2024-036", ("y", "PRO-1"): "AE-2025-030"}


def test_missing_keys_are_spread(spark, no_aliases, catalog):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.range(2000).selectExpr(
            "CAST(id AS INT) AS order_id", "'1' AS line_no", "'x' AS customer",
            "IF(id < 0, 'x', NULL) AS extracted_code", "CAST(NULL AS STRING) AS description")
        joined = resolution.match_exact(lines, catalog)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_code" in plan and "_spread" in plan.split("hashpartitioning")[1]
        assert joined.count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_nested_loops_and_no_python_without_fuzzy(spark, sf):
    from orderweave.plans.registry import QUERIES
    plan = QUERIES["resolve_lines_without_fuzzy"](spark, sf)._jdf.queryExecution(
        ).executedPlan().toString()
    assert not any(word in plan for word in ("NestedLoop", "Cartesian", "Python", "Pandas"))
