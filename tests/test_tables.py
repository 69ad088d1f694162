"""Tables, documents, customers, usage, findings and their streams."""

from decimal import Decimal
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orderweave.operators import customers as cu
from orderweave.operators import findings as fi
from orderweave.operators import tables, usage
from orderweave.session import shared_dir
from orderweave.sources import reports
from orderweave.sources.documents import read_documents, write_documents
from orderweave.sources.keyed import delete_stored, merge_stored, update_stored, write_keyed
from orderweave.streaming.runs import run_to_end, run_to_parquet, session_settings, tick, tick_stream
from orderweave.streaming.usage import ROCKSDB, usage_alerts, usage_windows


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "a", 1.5, date(2026, 1, 1), True), (2, "b", None, date(2026, 1, 2), False),
         (3, "b", 3.5, None, None)], "id int, name string, score double, day date, ok boolean")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters(people):
    def found(**f):
        return ids(people.where(tables.filter_column(people, f)))
    assert found(name="eq:b") == [2, 3]
    assert found(score="gte:1.5", ok="eq:YES") == [1]
    assert found(day="lt:2026-01-02") == [1]
    assert found(id="gt:1", name="lte:b") == [2, 3]
    for bad in ({"name": "b"}, {"name": "like:b"}, {"nope": "eq:1"}):
        with pytest.raises(ValueError):
            tables.filter_column(people, bad)
    with pytest.raises(ValueError):
        tables.filter_column(people, {"day": "eq:1.1.2026"})


def test_pages(people):
    page = tables.query_table(people, {}, ["id"], "score:desc", 2, 0, ["id"])
    assert [r["id"] for r in page.collect()] == [2, 3]
    assert tables.next_offset(page, 2, 0) == 2
    last = tables.query_table(people, {}, ["id"], "score", 2, 2, ["id"])
    assert [r["id"] for r in last.collect()] == [2]
    assert tables.next_offset(last, 2, 2) is None
    with pytest.raises(ValueError):
        tables.query_table(people, limit=501, max_page=500)
    with pytest.raises(ValueError):
        tables.query_table(people, order_by="id:sideways")


def test_filters_reach_the_scan(spark, sf):
    page = tables.query_table(spark.read.parquet(f"{sf}/orders.parquet"),
                              {"o_totalprice": "gte:1000"}, ["o_orderkey"], "o_orderkey")
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in plan
    assert "TakeOrderedAndProject" in plan and "o_custkey" not in plan


def test_documents(spark):
    docs = spark.createDataFrame(
        [("1", '{"k": 5, "s": "x"}'), ("2", '{"k": "5"}'), ("3", '{"k": 7.5, "s": null}'),
         ("4", "{}")], "_id string, raw string").select("_id", F.parse_json("raw").alias("doc"))

    def found(f, **kw):
        return [r["_id"] for r in tables.query_documents(docs, f, **kw).collect()]
    assert found({"k": 5}) == ["1"]
    assert found({"k": {"$gte": 5}}) == ["1", "3"]
    assert found({"k": {"$in": [5, "5"]}}) == ["1", "2"]
    assert found({"k": {"$ne": 5}}) == ["2", "3", "4"]
    assert found({"s": None}) == ["2", "3", "4"]
    assert found({}, limit=2) == ["1", "2"] and found({}, limit=2, after="2") == ["3", "4"]
    page = tables.query_documents(docs, {}, limit=2)
    assert tables.next_after(page, 2) == "2" and tables.next_after(page, 3) is None
    assert tables.query_documents(docs, {}, {"k": 1, "_id": 0}).columns == ["k"]
    with pytest.raises(ValueError):
        tables.query_documents(docs, {}, {"k": 1, "s": 0})


def test_changes(people):
    table, changed = tables.update_where(people, {"name": "eq:b"}, {"score": "9", "ok": True})
    assert ids(changed) == [2, 3]
    assert {r["id"]: r["score"] for r in table.collect()} == {1: 1.5, 2: 9.0, 3: 9.0}
    table, changed = tables.update_first(people, {"name": "eq:b"}, {"name": "c"}, "id")
    assert ids(changed) == [2] and table.where("name = 'c'").count() == 1
    kept, gone = tables.delete_where(people, {"score": "gt:1"})
    assert ids(kept) == [2] and ids(gone) == [1, 3]
    with pytest.raises(ValueError):
        tables.update_where(people, {}, {})


def test_merge_keys_with_nulls(spark):
    old = spark.createDataFrame([("daily", None, 1.0), ("daily", "p", 2.0)],
                                "period string, path string, max_cost double")
    new = spark.createDataFrame([("daily", None, 5.0), ("minute", None, 6.0)], old.schema)
    got = {(r[0], r[1]): r[2] for r in usage.set_limits(old, new).collect()}
    assert got == {("daily", None): 5.0, ("daily", "p"): 2.0, ("minute", None): 6.0}
    merged, clash = tables.merge_rows(old, new, ["period", "path"], "error")
    assert merged.count() == 3 and [tuple(r) for r in clash.collect()] == [("daily", None, 5.0)]
    kept = tables.merge_rows(old, new, ["period", "path"], "ignore")[0]
    assert {(r[0], r[1]): r[2] for r in kept.collect()}[("daily", None)] == 1.0
    assert usage.delete_limits(old, new.select("period", "path")).count() == 1


def test_column_rules(spark, people):
    rules = spark.createDataFrame([("people", ["score"], False), ("shut", [], True)],
                                  "table_name string, disabled_columns array<string>, "
                                  "is_fully_disabled boolean")
    assert tables.column_rules(people, "people", rules).columns == ["id", "name", "day", "ok"]
    assert tables.column_rules(people, "people", rules, ["id"]).columns == ["id"]
    for table, names in (("people", ["score"]), ("shut", None), ("usages", None)):
        with pytest.raises(PermissionError):
            tables.column_rules(people, table, rules, names)


@pytest.fixture
def times(spark):
    """Sessions know the type of times of day only if they are told so."""
    with session_settings(spark, {"spark.sql.timeType.enabled": "true"}):
        yield


@pytest.mark.parametrize("order_by", [None, "score", "score:desc", "at:desc"])
def test_pages_by_cursor_give_the_table(spark, times, order_by):
    rows = [(i, None if i % 5 == 0 else float(i % 3), None if i % 4 == 0 else f"{i % 24:02d}:{i % 60:02d}:07", f"n{i % 2}") for i in range(23)]
    said = F.col("said").alias("said", metadata={tables.TIME_OF_DAY: True})
    df = spark.createDataFrame(rows, "id bigint, score double, said string, name string").select(
        "id", "score", said, "name", F.to_time("said").alias("at"))
    want = [r["id"] for r in df.orderBy(*tables.sort_columns(order_by, ["id"])).collect()]
    got, after = [], None
    while after or not got:
        page = tables.query_table(df, None, None, order_by, 10, 0, ["id"], None, after)
        got += [r["id"] for r in page.orderBy(*tables.sort_columns(order_by, ["id"])).collect()]
        after = tables.next_cursor(page, order_by, ["id"], 10)
    assert got == want


def test_times_of_day(spark, times):
    df = spark.createDataFrame([(1, "09:05:00"), (2, "23:59:59"), (3, None)], "id int, said string").select(
        "id", F.col("said").alias("said", metadata={tables.TIME_OF_DAY: True}), F.to_time("said").alias("at"))
    for column in ("said", "at"):
        assert [r["id"] for r in df.where(tables.filter_column(df, {column: "lt:9:6:0"})).collect()] == [1]
        with pytest.raises(ValueError):
            tables.filter_column(df, {column: "eq:24:00:00"})
    read = tables.cast_columns(spark.createDataFrame([("1", "7:5:3", "7:5:3"), ("2", "25:00:00", "noon")], "id string, said string, at string"),
                               df.schema).orderBy("id").collect()
    assert [(r["said"], str(r["at"]), r["cast_errors"]) for r in read] == [
        ("07:05:03", "07:05:03", []), (None, "None", ["said", "at"])]
    table, changed = tables.update_where(df, {"id": "eq:3"}, {"at": "1:2:3", "said": "1:2:3"})
    assert [(r["said"], str(r["at"])) for r in changed.collect()] == [("01:02:03", "01:02:03")]
    assert table.count() == 3


def test_shredded_documents_give_the_same_rows(spark, tmp_path):
    texts = ['{"k": 1, "t": "a"}', '{"k": 2.5, "t": true}', '{"k": "2", "t": null}', '{"t": "b"}', "[1]", '{"k": null}', None,
             *[f'{{"k": {i}, "t": "c{i % 3}"}}' for i in range(10, 200)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id int, text string").select("_id", F.try_parse_json("text").alias("doc"))
    write_documents(docs, str(tmp_path / "d"), ["k", "t"], ("k", "number"))
    stored = read_documents(spark, str(tmp_path / "d"))
    for filters in ({"k": 2}, {"k": {"$gt": 1, "$lte": 12}}, {"k": "2"}, {"k": {"$ne": 11}}, {"k": None}, {"t": True},
                    {"t": {"$in": ["a", "c1"]}, "k": {"$lt": 20}}, {"t": {"$ne": None}}, {"x": None}):
        want, got = ([r["_id"] for r in tables.query_documents(d, filters, {}, 1000).collect()] for d in (docs, stored))
        assert got == want, filters
    assert tables.query_documents(stored, {}, {"t": 0}, 5).columns == ["_id", "doc"]
    plan = stored.where(tables.document_filter(stored, {"k": {"$gte": 150}})).select("_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc__k__number,150.0)" in plan.split("PushedFilters")[1] and "doc:" not in plan.split("ReadSchema")[1]


def files_of(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def rewritten(before, path):
    """The parts whose files are not what they were."""
    now = files_of(path)
    return {str(file.parent).split("=")[1] for file, _ in set(before.items()) ^ set(now.items())}


@pytest.mark.parametrize("width,parts", [(10, 1), (None, 8)])
def test_changes_rewrite_only_what_they_touch(spark, tmp_path, width, parts):
    rows = [(i, f"n{i}", i % 4) for i in range(100)] + [(None, "no key", 1)]
    path = tmp_path / "t"
    table = write_keyed(spark.createDataFrame(rows, "id bigint, name string, kind int"), str(path), ["id"], width, parts)
    want = {(r[0], r[1]): r for r in rows}

    def check():
        assert sorted(map(str, map(tuple, table.read(spark).collect()))) == sorted(map(str, want.values()))

    check()
    before = files_of(path)
    source = spark.createDataFrame([(12, "new", 9), (203, "more", 9), (12, "newer", 9)], "id bigint, name string, kind int")
    touched, _ = merge_stored(table, source, "replace")
    want = {k: v for k, v in want.items() if k[0] != 12} | {(12, "new"): (12, "new", 9), (203, "more"): (203, "more", 9)}
    check()
    assert len(rewritten(before, path)) == touched <= 2
    before = files_of(path)
    touched, changed = update_stored(table, spark, {"id": "gte:95", "kind": "lt:2"}, {"name": "u"})
    assert sorted(r["id"] for r in changed.collect()) == [96, 97]
    want = {k: (v[0], "u", v[2]) if v[0] in (96, 97) else v for k, v in want.items()}
    check()
    assert len(rewritten(before, path)) == touched <= 2
    before = files_of(path)
    touched, gone = delete_stored(table, spark, {"id": "lt:20"})
    assert gone.count() == 20
    want = {k: v for k, v in want.items() if v[0] is None or v[0] >= 20}
    check()
    if width:
        # Both parts are empty now and gone; nothing else was written.
        assert touched == 2 and rewritten(before, path) == {"0", "1"}
    before = files_of(path)
    assert delete_stored(table, spark, {"id": "eq:-5"})[0] == 0
    assert files_of(path) == before


def test_key_filters_leave_parts_out(spark, tmp_path):
    table = write_keyed(spark.range(1000).selectExpr("id", "id % 7 AS kind"), str(tmp_path / "t"), ["id"], 100)
    assert len(table.read(spark, table.key_range(250, 320)).inputFiles()) <= len(table.read(spark).inputFiles())
    plan = table.read(spark, table.key_range(250, 320))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part_no" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        write_keyed(spark.range(3).selectExpr("cast(id AS string) AS id"), str(tmp_path / "s"), ["id"], 100)
    with pytest.raises(ValueError):
        update_stored(table, spark, {"id": "eq:1"}, {"id": "2"})


def test_wide_ranges_of_keys_do_not_make_more_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("orderweave.sources.keyed.MOST_PARTS", 8)
    path = tmp_path / "wide"
    table = write_keyed(spark.range(-30, 970).selectExpr("id", "id % 7 AS kind"), str(path), ["id"], 10)
    assert table.width % 10 == 0 and len(list(path.glob("part_no=*"))) <= 8
    touched, changed = update_stored(table, spark, {"id": "gte:900"}, {"kind": "9"})
    assert touched <= 2 and changed.count() == 70
    assert table.read(spark).where("kind = 9").count() == 70 and table.read(spark).count() == 1000


def test_customer_rules(spark):
    rows = [("ok-1", "n", "table_text", None), ("A", "", "x", None),
            ("k1", "n", "api_model", ""), ("k2", "n", "api_model", " https://x")]
    df = spark.createDataFrame(
        rows, "code string, display_name string, extraction_strategy string, api_key string")
    valid, broken = cu.customer_quality(df)
    assert [r["code"] for r in valid.collect()] == ["ok-1"]
    assert {r["code"]: r["violations"] for r in broken.collect()} == {
        "A": ["bad_code", "name_missing", "unknown_strategy"], "k1": ["key_missing"],
        "k2": ["key_is_url"]}
    assert "api_key" not in cu.mask_secrets(df).columns


START = datetime(2026, 1, 1)


def usage_rows(n=400):
    return [(i, "hot" if i % 3 else f"p{i % 5}", i % 17, round((i * 7 % 100) / 8, 3),
             START + timedelta(seconds=(i * i * 37) % 200_000)) for i in range(n)]


USAGE = "id bigint, path string, tokens int, cost double, timestamp timestamp"


def test_trailing_equals_brute_force(spark):
    rows = usage_rows() + [(9_000, "hot", 1, 0.5, START), (9_001, "hot", 2, 0.25, START)]
    spans = {"minute": 60, "daily": 86_400, "monthly": 2_592_000}
    for chunk_rows in (20_000, 60, 7):
        got = {r["id"]: r for r in usage.usage_trailing(
            spark.createDataFrame(rows, USAGE), chunk_rows).collect()}
        for i, path, _, _, at in rows[::37] + rows[-2:]:
            for period, seconds in spans.items():
                near = [r for r in rows if at - timedelta(seconds=seconds) <= r[4] <= at]
                own = [r for r in near if r[1] == path]
                assert got[i][f"all_{period}_tokens"] == sum(r[2] for r in near)
                assert got[i][f"path_{period}_tokens"] == sum(r[2] for r in own)
                assert got[i][f"path_{period}_cost"] == pytest.approx(sum(r[3] for r in own))


def test_limit_verdicts(spark):
    use = spark.createDataFrame([(1, "a", 10, 1.0, START), (2, "b", 1, 1.0, START)], USAGE)
    limits = spark.createDataFrame(
        [("daily", "a", None, 11), ("daily", "b", 1.0, None), ("minute", "c", 0.0, None),
         ("monthly", None, 2.5, None)],
        "period string, path string, max_cost double, max_tokens bigint")
    verdict = usage.limit_check(use, limits, START + timedelta(hours=1))
    assert {r["path"]: r["available"] for r in verdict.collect()} == {
        "a": True, "b": False, "c": False}
    tight = limits.where("path IS NULL").withColumn("max_cost", F.lit(2.0))
    assert not any(r["available"] for r in usage.limit_check(
        use, tight, START + timedelta(hours=1)).collect())


def crossings(rows, limits):
    """Every instant at which a trailing sum of whole minutes goes over its limit or comes back."""
    spans, wanted = {"minute": 60, "daily": 86_400, "monthly": 2_592_000}, set()
    for period, path, overall, column, limit in limits:
        minutes = {}
        for _, name, tokens, cost, at in rows:
            if overall or name == path:
                close = at.replace(second=0, microsecond=0) + timedelta(minutes=1)
                minutes[close] = minutes.get(close, 0) + (tokens, cost)[column]
        span, over = timedelta(seconds=spans[period]), False
        for at in sorted({t for close in minutes for t in (close, close + span)}):
            total = sum(v for t, v in minutes.items() if at - span < t <= at)
            if (total >= limit) != over:
                over = not over
                wanted.add((path, overall, period, at, over))
    return wanted


def test_usage_streams(spark, tmp_path):
    """In two batches, with a path called like the old name of the overall scope and one without name."""
    rows = sorted(usage_rows(), key=lambda r: r[4])
    rows = [(i, {"p1": "*", "p2": None}.get(path, path), tokens, cost, at) for i, path, tokens, cost, at in rows]
    source, ticks = f"{tmp_path}/usages", f"{tmp_path}/ticks"
    tick(spark, ticks)
    spark.createDataFrame(rows[:200], USAGE).coalesce(1).write.parquet(source)
    limits = spark.createDataFrame(
        [("daily", "hot", None, 900), ("monthly", None, 500.0, None), ("minute", "*", None, 10), ("daily", "*", 3.0, 10**6)],
        "period string, path string, max_cost double, max_tokens bigint")
    limits.write.parquet(f"{tmp_path}/limits")
    stream = spark.readStream.schema(USAGE).parquet(source)
    found = usage_alerts(stream, spark.read.parquet(f"{tmp_path}/limits"), ticks=tick_stream(spark, ticks))
    sums = usage_windows(stream, "1 hour", ticks=tick_stream(spark, ticks))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for query, name, settings in ((found, "alerts", ROCKSDB), (sums, "sums", None)):
        run_to_parquet(query, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", settings)
    spark.createDataFrame(rows[200:], USAGE).coalesce(1).write.mode("append").parquet(source)
    last = START + timedelta(days=90)
    out = run_to_parquet(found, f"{tmp_path}/alerts", f"{tmp_path}/alerts-state", ROCKSDB)
    whole = run_to_end(sums, ticks, last, f"{tmp_path}/sums", f"{tmp_path}/sums-state")
    out = run_to_end(found, ticks, last, f"{tmp_path}/alerts", f"{tmp_path}/alerts-state", ROCKSDB)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert whole.agg(F.sum("tokens")).first()[0] == sum(r[2] for r in rows)
    wanted = crossings(rows, [("daily", "hot", False, 0, 900), ("monthly", None, True, 1, 500.0), ("minute", "*", False, 0, 10),
                              ("daily", "*", False, 1, 3.0)])
    got = [(r["path"], r["overall"], r["period"], r["at"], r["over"]) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert len(wanted) > 10


def test_a_limit_is_left_without_new_usage(spark, tmp_path):
    """Only time passes for one path; another one's usage moves the watermark, so a timer fires."""
    source = f"{tmp_path}/usages"
    (tmp_path / "usages").mkdir()
    limits = spark.createDataFrame([("minute", "a", None, 5), ("daily", "a", None, 5)],
                                   "period string, path string, max_cost double, max_tokens bigint")
    limits.write.parquet(f"{tmp_path}/limits")
    found = usage_alerts(spark.readStream.schema(USAGE).parquet(source), spark.read.parquet(f"{tmp_path}/limits"))
    seen = []
    for number, (path, at) in enumerate([("a", START), ("b", START + timedelta(hours=1)), ("b", START + timedelta(days=2)),
                                         ("b", START + timedelta(days=2, hours=1))]):
        spark.createDataFrame([(number, path, 9, 1.0, at)], USAGE).coalesce(1).write.mode("append").parquet(source)
        out = run_to_parquet(found, f"{tmp_path}/out", f"{tmp_path}/state", ROCKSDB)
        seen.append(sorted((r["period"], r["at"], r["over"]) for r in out.collect()))
    minute = timedelta(minutes=1)
    up = [("daily", START + minute, True), ("minute", START + minute, True)]
    assert seen[0] == []
    assert seen[1] == sorted([*up, ("minute", START + 2 * minute, False)])
    assert seen[2] == sorted([*seen[1], ("daily", START + minute + timedelta(days=1), False)])
    assert seen[3] == seen[2]


MAPPING = """{"owasp_top_10": {"A03:2021": {"name": "Injection", "description": "d",
 "cwes": ["CWE-79", "CWE-89"]}, "A01:2021": {"name": "Access", "description": "d",
 "cwes": ["CWE-89", "CWE-22"]}}, "sans_cwe_top_25": {"CWE-79": {"rank": 2, "name": "XSS",
 "description": "d"}, "CWE-787": {"rank": 1, "name": "OOB", "description": "d"}},
 "bandit_test_mappings": {"B1": {"cwe": "CWE-22", "owasp": null, "name": "x"}}}"""


def test_findings_end_to_end(spark, tmp_path):
    (tmp_path / "m.json").write_text(MAPPING)
    (tmp_path / "s.json").write_text(
        '{"results": [{"check_id": "r.cwe-79", "path": "a.py", "start": {"line": 3},'
        ' "extra": {"message": "see CWE-89", "severity": "error", "metadata":'
        ' {"cwe": "CWE-22", "owasp": ["A77:2021"]}}}, {}]}')
    (tmp_path / "t.json").write_text('{"DetectorName": "K", "Verified": true}\nbroken\n\n')
    (tmp_path / "p.json").write_text('[{"name": "x", "version": "1", "id": "V",'
                                     ' "description": "CWE-79"}, 5]')
    found = reports.read_findings(spark, {
        "semgrep": [(f"{tmp_path}/s.json", "semgrep")],
        "trufflehog": [(f"{tmp_path}/t.json", "")], "pip-audit": [(f"{tmp_path}/p.json", "")]},
        f"{tmp_path}/m.json")
    rows = {(r["source"], r["rule_id"]): r for r in found.collect()}
    assert len(rows) == 4
    first = rows[("semgrep", "r.cwe-79")]
    assert first["cwes"] == ["CWE-22", "CWE-79", "CWE-89"]
    assert first["owasp_categories"] == ["A01:2021", "A03:2021", "A77:2021"]
    assert (first["severity"], first["line_start"], first["line_end"]) == ("ERROR", 3, 0)
    assert rows[("semgrep", "unknown")]["severity"] == "INFO"
    assert rows[("trufflehog", "K")]["message"] == "Verified K secret detected in unknown"
    assert rows[("pip-audit", "V")]["message"] == "x@1: CWE-79"
    categories, ranks, _ = reports.read_mapping(spark, f"{tmp_path}/m.json")
    tagged, rest = fi.categorise_findings(found, categories, ranks)
    assert {(r["rule_id"], r["framework"], r["category"]) for r in tagged.collect()} == {
        ("r.cwe-79", "owasp", "A01:2021"), ("r.cwe-79", "owasp", "A03:2021"),
        ("r.cwe-79", "sans", "CWE-79"), ("V", "sans", "CWE-79"), ("V", "owasp", "A03:2021")}
    assert {r["rule_id"] for r in rest.collect()} == {"unknown", "K"}
    by_category, by_rank = fi.severity_rollups(tagged, categories, ranks)
    assert [(r["owasp_id"], r["finding_count"], r["high"], r["unknown"])
            for r in by_category.collect()] == [("A01:2021", 1, 0, 1), ("A03:2021", 2, 1, 1)]
    assert [(r["cwe"], r["finding_count"]) for r in by_rank.collect()] == [
        ("CWE-787", 0), ("CWE-79", 2)]


def test_documents_first_delete_find_and_exclude(spark):
    docs = spark.createDataFrame(
        [("a", '{"k": 1, "password": "p", "n": {"x": null}}'), ("b", '{"k": 1}'), ("c", '{"k": 2}'), ("d", None)],
        "_id string, t string").select("_id", F.try_parse_json("t").alias("doc"))
    text = lambda df: {r["_id"]: r["t"] for r in df.select("_id", F.to_json("doc").alias("t")).collect()}
    done, new = tables.update_document_first(docs, {"k": 1}, {"k": "5", "s": '{"a": [1]}'})
    assert text(new) == {"a": '{"k":5,"n":{"x":null},"password":"p","s":{"a":[1]}}'}
    assert text(done) == {**text(new), "b": '{"k":1}', "c": '{"k":2}', "d": None}
    assert text(tables.update_document_first(docs, {"k": 9}, {"k": "5"})[1]) == {}
    kept, count = tables.delete_documents(docs, {"k": 1})
    assert set(text(kept)) == {"c", "d"} and count.first()["deleted"] == 2
    assert text(tables.find_document(docs, {"k": {"$gte": 1}})) == {"a": text(docs)["a"]}
    with pytest.raises(Exception, match="no document matches"):
        tables.find_document(docs, {"k": 7}).collect()
    page = tables.query_documents(docs, {}, {"password": 0})
    assert text(page)["a"] == '{"k":1,"n":{"x":null}}' and text(page)["d"] is None


def test_document_filters_reach_the_scan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("doc", F.try_parse_json("props"))
    found = events.where(tables.document_filter(events, {"event_type": {"$in": ["click"]}, "k": {"$gte": 3}}))
    assert "PushedFilters: [In(event_type" in found._jdf.queryExecution().toString() or \
        "EqualTo(event_type,click)" in found._jdf.queryExecution().toString()


def test_decimals_compare_exactly(spark):
    df = spark.createDataFrame([(Decimal("0.10"),), (Decimal("0.30"),)], "d decimal(20,2)")
    assert tables.query_table(df, {"d": "eq:0.3"}).count() == 1
    assert tables.query_table(df, {"d": "lt:0.3"}, limit=900).count() == 1
    with pytest.raises(ValueError):
        tables.query_table(df, limit=900, max_page=500)


def test_entries_without_path_are_apart(spark):
    rows = [(1, None, 5, 1.0, START), (2, "", 7, 1.0, START)]
    got = {r["id"]: r for r in usage.usage_trailing(spark.createDataFrame(rows, USAGE)).collect()}
    assert (got[1]["path_daily_tokens"], got[2]["path_daily_tokens"], got[1]["all_daily_tokens"]) == (5, 7, 12)


def test_findings_keep_their_order_of_arrival(spark):
    pnpm = '{"vulnerabilities": {"z": {"via": [{"source": 1}, {"source": 2}]}, "a": {"via": [{"source": 3}]}}}'
    rows = reports.read_pnpm_audit(spark.createDataFrame([("r", pnpm)], "report string, text string"), "s")
    assert [r["rule_id"] for r in rows.orderBy("pos").collect()] == ["1", "2", "3"]
    njs = '{"y": {"q": {"files": [{}, {}]}, "b": {"files": [{}]}}, "c": {"x": {"files": [{}]}}}'
    rows = reports.read_njsscan(spark.createDataFrame([("r", njs)], "report string, text string"), "s")
    assert [r["rule_id"] for r in rows.orderBy("pos").collect()] == ["q", "q", "b", "x"]
