"""Registered queries on tables, customers, usages and findings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from orderweave.operators import customers as cu
from orderweave.operators import findings as fi
from orderweave.operators import tables, usage
from orderweave.plans import fixtures as fx
from orderweave.plans.fixtures import with_views
from orderweave.session import shared_dir, stored
from orderweave.sources import reports
from orderweave.sources.documents import read_documents, write_documents
from orderweave.sources.keyed import delete_stored, merge_stored, update_stored, write_keyed
from orderweave.streaming.runs import run_to_end, stream_parquet, tick, tick_stream
from orderweave.streaming.usage import ROCKSDB
from orderweave.streaming.usage import usage_alerts as alerts
from orderweave.streaming.usage import usage_windows as windows

AS_OF = datetime(2024, 1, 30, 12, 0, 0)


# --- tables -----------------------------------------------------------------------

def query_table(spark, sf):
    return tables.query_table(
        fx.table(spark, sf, "orders"),
        {"o_totalprice": "gte:1000.5", "o_orderdate": "lt:1998-06-01", "o_orderstatus": "eq:F"},
        ["o_orderkey", "o_custkey", "o_totalprice"], "o_totalprice:desc", 200, 50,
        ["o_orderkey"])


def _timed_events(spark, sf):
    """Events with their time of day, as marked text; some have none."""
    at = F.when(F.col("event_id") % 11 != 0, F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss"))
    return fx.table(spark, sf, "events").select(
        "event_id", "event_type", at.alias("at", metadata={tables.TIME_OF_DAY: True}))


def query_table_times(spark, sf):
    """Filters on times of day; texts read as times, and those that are none."""
    events = _timed_events(spark, sf)
    early = events.where(tables.filter_column(events, {"at": "lt:17:05:9"}))
    # As a source may write them: without leading zeros, or not at all.
    said = F.when(F.col("event_id") % 13 == 0, "noon").otherwise(F.regexp_replace("at", r"\b0(\d)", "$1"))
    read = tables.cast_columns(early.where(tables.filter_column(early, {"at": "gte:8:30:00"})).select(
        "event_id", said.alias("at")), events.select("event_id", "at").schema)
    return read.select("event_id", "at", F.array_join("cast_errors", "|").alias("errors"))


def query_table_pages(spark, sf):
    """Six pages by cursor, sorted by time of day, latest first; together they are the table."""
    events = _timed_events(spark, sf)
    size, after, pages, number = -(-events.count() // 6) + 1, None, None, 0
    while number == 0 or after:
        number += 1
        page = tables.query_table(events, {"event_type": "gte:b"}, None, "at:desc", size, 0, ["event_id"], None, after)
        after = tables.next_cursor(page, "at:desc", ["event_id"], size)
        shown = page.select("event_id", "at", F.lit(number).alias("page"))
        pages = shown if pages is None else pages.unionByName(shown)
    return pages


def query_documents(spark, sf):
    docs = fx.table(spark, sf, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("_id"),
        F.try_parse_json("props").alias("doc"), "event_type")
    return tables.query_documents(
        docs, {"k": {"$gte": 20, "$lt": 90}, "event_type": {"$in": ["click", "view", "error"]}},
        {"k": 1, "event_type": 1}, 100, "000000000100")


def _event_documents(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("_id"),
        F.parse_json(F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"secret":"s","type":"'),
                              F.col("event_type"), F.lit('"}'))).alias("doc"))


def query_documents_without(spark, sf):
    """The projection that leaves fields out, over all documents; ``query_documents`` pages."""
    docs = _event_documents(spark, sf)
    found = docs.where(tables.document_filter(docs, {"k": {"$ne": 5}}))
    return found.select(*tables.document_projection(found, {"secret": 0})).select("_id", F.to_json("doc").alias("doc"))


def query_documents_shredded(spark, sf):
    """Filters on documents that are stored with their hot fields as columns."""
    path = shared_dir(spark, "documents")
    write_documents(_event_documents(spark, sf), path, ["k", "type"], ("k", "number"))
    docs = read_documents(spark, path)
    found = docs.where(tables.document_filter(docs, {"k": {"$gte": 20, "$lt": 90, "$ne": 33}, "type": {"$in": ["click", "view"]}}))
    return found.select(*tables.document_projection(found, {"secret": 0})).select("_id", F.to_json("doc").alias("doc"))


def update_document_first(spark, sf):
    docs, _ = tables.update_document_first(
        _event_documents(spark, sf), {"type": "click", "k": {"$gt": 40}}, {"k": "-1", "seen": "true"})
    return docs.select("_id", F.to_json("doc").alias("doc"))


def delete_documents(spark, sf):
    kept, _ = tables.delete_documents(_event_documents(spark, sf), {"type": {"$in": ["click", "view"]}})
    return kept.select("_id", F.to_json("doc").alias("doc"))


def find_document(spark, sf):
    return tables.find_document(_event_documents(spark, sf), {"k": {"$gte": 90}, "type": "error"}).select(
        "_id", F.to_json("doc").alias("doc"))


def _column_rule(spark, sf):
    """One rule, derived from the customers: hide keys where any customer has one."""
    return fx.customers(spark, sf).where("api_key IS NOT NULL").agg(
        F.lit("customers").alias("table_name"),
        F.array(F.lit("api_key")).alias("disabled_columns"),
        (F.count("*") < 0).alias("is_fully_disabled"))


def column_rules(spark, sf):
    return tables.column_rules(fx.customers(spark, sf), "customers", _column_rule(spark, sf))


def _described(spark, sf):
    """Tables and rules described by the events: users as tables, event types as columns."""
    events = fx.table(spark, sf, "events")
    name = F.concat(F.lit("t"), F.col("user_id").cast("string"))
    described = events.groupBy(name.alias("table_name")).agg(
        F.array_sort(F.collect_set("event_type")).alias("columns"))
    rules = events.where("user_id % 3 = 0").groupBy(name.alias("table_name")).agg(
        F.array(F.min("event_type")).alias("disabled_columns"),
        (F.max("user_id") % 15 == 0).alias("is_fully_disabled"))
    new = events.where("user_id % 2 = 0").groupBy(
        F.when(F.col("user_id") % 8 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
        .otherwise(name).alias("table_name")).agg(
        F.array(F.max("event_type")).alias("disabled_columns"),
        F.lit(False).alias("is_fully_disabled"))
    return described, rules, new


def _listed(df, *cols):
    return df.withColumns({c: F.array_join(F.array_sort(c), "|") for c in cols})


def allowed_columns(spark, sf):
    described, rules, _ = _described(spark, sf)
    return _listed(tables.allowed_columns(described, rules, ("t1", "t3", "t4")), "columns")


def merge_rules(spark, sf):
    return _listed(tables.merge_rules(*_described(spark, sf))[0], "disabled_columns")


def merge_rules_refused(spark, sf):
    refused = tables.merge_rules(*_described(spark, sf))[1]
    return refused.select("table_name", "reason")


def _merge_sides(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    target = orders.where("o_orderkey % 3 <> 0")
    source = orders.where("o_orderkey % 2 = 0").withColumn(
        "o_totalprice", F.round(F.col("o_totalprice") * 2, 2))
    again = source.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.lit(1.0))
    return target, source.unionByName(again)


def merge_rows_ignore(spark, sf):
    return tables.merge_rows(*_merge_sides(spark, sf), ["o_orderkey"], "ignore")[0]


def merge_rows_replace(spark, sf):
    return tables.merge_rows(*_merge_sides(spark, sf), ["o_orderkey"], "replace",
                             prefer=-F.col("o_totalprice"))[0]


def merge_rows_error(spark, sf):
    return tables.merge_rows(*_merge_sides(spark, sf), ["o_orderkey"], "error")[1]


def cast_columns(spark, sf):
    raw = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(
            F.col("o_custkey").cast("string")).alias("customer"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no").alias("done"))
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("day", T.DateType()),
                           T.StructField("customer", T.LongType()),
                           T.StructField("done", T.BooleanType())])
    done = tables.cast_columns(raw, schema)
    return done.withColumn("cast_errors", F.array_join("cast_errors", "|"))


def update_where(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.update_where(orders, {"o_totalprice": "gt:250000", "o_orderstatus": "eq:O"},
                               {"o_orderstatus": "X", "o_totalprice": "0"})[0]


def update_first(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return tables.update_first(orders, {"o_orderstatus": "eq:P"}, {"o_orderstatus": "first"},
                               "o_orderkey")[0]


def delete_where(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "event_type", "value")
    return tables.delete_where(events, {"event_type": "eq:click", "value": "lt:50"})[0]


def _cascade(spark, sf):
    return tables.delete_cascade(
        fx.orders(spark, sf).select("id", "customer", "order_date"),
        {"lines": fx.lines(spark, sf).select("order_id", "line_no")},
        {"order_date": "lt:1996-01-01"})


def delete_cascade(spark, sf):
    return _cascade(spark, sf)[1]["lines"]


def delete_cascade_parents(spark, sf):
    return _cascade(spark, sf)[0]


def clear_counts(spark, sf):
    return tables.clear_counts(fx.table(spark, sf, "orders"), fx.table(spark, sf, "pages"))


# --- customers ---------------------------------------------------------------------

def _doubtful(spark, sf):
    """Customers with broken fields, picked by their number."""
    number = F.substring("code", 2, 20).cast("bigint")
    return fx.customers(spark, sf).withColumn("n", number).select(
        F.when(F.col("n") % 11 == 0, F.upper("code")).otherwise(F.col("code")).alias("code"),
        F.when(F.col("n") % 13 != 0, F.col("display_name")).alias("display_name"),
        F.when(F.col("n") % 17 == 0, "by_phone").otherwise(F.col("extraction_strategy"))
        .alias("extraction_strategy"),
        F.when(F.col("n") % 19 == 0, " HTTP://key").when(F.col("n") % 23 == 0, "")
        .otherwise(F.col("api_key")).alias("api_key"), "n")


def customer_quality(spark, sf):
    return cu.customer_quality(_doubtful(spark, sf))[1].select(
        "n", F.array_join("violations", "|").alias("violations"))


def customer_quality_valid(spark, sf):
    return cu.customer_quality(_doubtful(spark, sf))[0].select("n", "code")


def mask_secrets(spark, sf):
    return cu.mask_secrets(fx.customers(spark, sf))


def active_customers(spark, sf):
    return cu.active_customers(fx.customers(spark, sf)).select("code", "display_name")


# --- usage ------------------------------------------------------------------------------

def _limits(spark, sf):
    """Limits taken from the usages themselves: some paths and periods, and overall."""
    use = fx.usages(spark, sf)
    per_path = use.groupBy("path").agg(
        F.round(F.sum("cost") * 0.9, 2).alias("c"), F.sum("tokens").cast("bigint").alias("t"))
    overall = use.agg(F.round(F.sum("cost") * 2, 2).alias("c"),
                      F.sum("tokens").cast("bigint").alias("t"))
    own = per_path.select(
        F.explode(F.array(F.lit("daily"), F.lit("monthly"))).alias("period"), "path",
        F.when(F.length("path") % 2 == 0, F.col("c")).alias("max_cost"),
        F.col("t").alias("max_tokens"))
    return own.unionByName(overall.select(
        F.lit("monthly").alias("period"), F.lit(None).cast("string").alias("path"),
        F.col("c").alias("max_cost"), F.lit(None).cast("bigint").alias("max_tokens")))


def _money(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


def usage_totals(spark, sf):
    parts = [usage.usage_totals(fx.usages(spark, sf), AS_OF, p, path).select(
        F.lit(p or "ever").alias("period"), F.lit(path or "*").alias("path"), "tokens", "cost")
        for p in (None, "minute", "daily", "monthly") for path in (None, "click")]
    return _money(reports.union_findings(parts), "cost")


def usage_by_path(spark, sf):
    return _money(usage.usage_by_path(fx.usages(spark, sf), AS_OF, "daily"), "cost")


def usage_latest(spark, sf):
    return usage.usage_latest(fx.usages(spark, sf), AS_OF, "monthly", "click", 100).select(
        "id", "path", "tokens", "cost")


def limit_check(spark, sf):
    return usage.limit_check(fx.usages(spark, sf), _limits(spark, sf), AS_OF)


def set_limits(spark, sf):
    old = _limits(spark, sf)
    new = old.where("path IS NULL OR length(path) % 2 = 0").withColumn("max_cost", F.lit(1.5))
    return usage.set_limits(old, new).select("period", "path", "max_cost", "max_tokens")


def usage_trailing(spark, sf):
    sums = usage.usage_trailing(fx.usages(spark, sf))
    return _money(sums, *[c for c in sums.columns if c.endswith("_cost")])


def _usage_stream(spark, sf):
    return stream_parquet(spark, f"{sf}/events.parquet").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("path"),
        F.col("user_id").cast("int").alias("tokens"), F.col("value").alias("cost"),
        F.col("ts").cast("timestamp").alias("timestamp"))


def _to_end(spark, sf, make, settings):
    """Run a usage stream over all events, then close what is open two months later."""
    ticks = shared_dir(spark, "ticks")
    tick(spark, ticks)
    last = fx.table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    # Few rows per part of the state: no more parts than cores.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return run_to_end(make(_usage_stream(spark, sf), tick_stream(spark, ticks)), ticks,
                      last + timedelta(days=60), shared_dir(spark, "usage-stream"), shared_dir(spark, "usage-state"),
                      {"spark.sql.shuffle.partitions": str(parts), **settings})


def usage_windows(spark, sf):
    return _money(_to_end(spark, sf, lambda usages, ticks: windows(usages, "1 day", ticks=ticks), {}), "cost")


def usage_alerts(spark, sf):
    # Static sides of a stream are planned per batch, so the limits are stored first.
    limits = stored(_alert_limits(spark, sf), "limits")
    out = _to_end(spark, sf, lambda usages, ticks: alerts(usages, limits, ticks=ticks), ROCKSDB)
    return _money(out, "cost")


def _alert_limits(spark, sf):
    """The limits, and tighter ones that daily and minute sums cross again and again."""
    use = fx.usages(spark, sf)
    days = use.groupBy("path", F.to_date("timestamp")).agg(F.sum("tokens").alias("t"))
    tight = days.groupBy("path").agg(F.floor(F.avg("t")).cast("bigint").alias("max_tokens")).select(
        F.lit("daily").alias("period"), "path", F.lit(None).cast("double").alias("max_cost"), "max_tokens")
    minute = use.groupBy().agg((F.max("tokens") * 2).cast("bigint").alias("max_tokens")).select(
        F.lit("minute").alias("period"), F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("double").alias("max_cost"), "max_tokens")
    return _limits(spark, sf).where("period = 'monthly'").unionByName(tight).unionByName(minute)


# --- stored tables ----------------

def change_stored_rows(spark, sf):
    """Orders as a stored table: some replaced, some new, some updated, some deleted."""
    rows = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    table = write_keyed(rows, shared_dir(spark, "orders"), ["o_orderkey"], width=500)
    key = F.col("o_orderkey")
    source = rows.where((key < 1200) & (key % 3 == 0)).select(
        F.when(key % 2 == 0, key).otherwise(key + 10_000_000).alias("o_orderkey"), F.lit("M").alias("o_orderstatus"),
        (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderpriority")
    merge_stored(table, source, "replace")
    update_stored(table, spark, {"o_orderkey": "gte:2000", "o_totalprice": "lt:5000"}, {"o_orderpriority": "low"})
    delete_stored(table, spark, {"o_orderstatus": "eq:F", "o_orderkey": "lt:3000"})
    return table.read(spark).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority")


# --- findings ----------------------------------------------------------------------------

def _mapping(spark, sf):
    """A weakness mapping over the numbers the findings name."""
    numbers = fx.findings(spark, sf).select(
        F.explode(F.regexp_extract_all("message", F.lit(r"(?i)CWE-(\d+)"), F.lit(1))).alias("n")
    ).distinct().select(F.col("n").cast("int").alias("n"))
    cwe = F.concat(F.lit("CWE-"), F.col("n").cast("string"))
    slot = F.col("n") % 11
    member = numbers.where(slot < 10).select(
        (slot + 1).alias("pos"), F.explode(F.array(slot + 1, (slot + 2) % 10 + 1)).alias("slot"),
        cwe.alias("cwe"))
    categories = member.groupBy("slot").agg(F.array_sort(F.collect_set("cwe")).alias("cwes")).select(
        F.concat(F.lit("A"), F.lpad(F.col("slot").cast("string"), 2, "0"), F.lit(":2021"))
        .alias("owasp_id"), F.col("slot").alias("pos"),
        F.concat(F.lit("Category "), F.col("slot").cast("string")).alias("name"), "cwes")
    ranks = numbers.where("n % 4 = 0").select(
        cwe.alias("cwe"), F.col("n").alias("rank"),
        F.concat(F.lit("Weakness "), F.col("n").cast("string")).alias("name"))
    return categories, ranks


def _semgrep_reports(spark, sf):
    """Reports of up to fifty results, written as JSON text."""
    f = fx.findings(spark, sf)
    result = F.struct(
        F.concat(F.lit("rule."), F.col("source")).alias("check_id"),
        F.concat(F.lit("src/f"), F.col("finding_id").cast("string"), F.lit(".py")).alias("path"),
        F.struct((F.col("finding_id") % 90).alias("line")).alias("start"),
        F.struct((F.col("finding_id") % 90 + 1).alias("line")).alias("end"),
        F.struct("message", F.lower("severity").alias("severity"), F.struct(
            F.when(F.col("finding_id") % 4 == 0, F.array(F.lit("CWE-20"))).alias("cwe"),
            F.when(F.col("finding_id") % 6 == 0, F.array(F.lit("A03:2021"))).alias("owasp"))
            .alias("metadata")).alias("extra"))
    return f.groupBy(F.floor(F.col("finding_id") / 50).cast("string").alias("report")).agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("finding_id", result.alias("r"))))
                           .alias("results"))).alias("raw")).select(
        "report", F.to_json(F.struct(F.transform(
            F.from_json("raw", _RAW)["results"], lambda x: x["r"]).alias("results")))
        .alias("text"))


_RAW = ("results array<struct<finding_id:bigint,r:struct<check_id:string,path:string,"
        "start:struct<line:bigint>,end:struct<line:bigint>,extra:struct<message:string,"
        "severity:string,metadata:struct<cwe:array<string>,owasp:array<string>>>>>>")


def _semgrep(spark, sf):
    return reports.read_semgrep(_semgrep_reports(spark, sf), _mapping(spark, sf)[0])


def _texts(df, *cols):
    return df.withColumns({c: F.array_join(c, "|") for c in cols})


def read_semgrep(spark, sf):
    return _texts(_semgrep(spark, sf), "cwes", "owasp_categories").select(
        "rule_id", "message", "severity", "file", "line_start", "line_end", "cwes",
        "owasp_categories")


def _json_reports(spark, sf, name, items):
    """Reports of up to fifty entries as ``{name: [...]}``."""
    f = fx.findings(spark, sf)
    return f.groupBy(F.floor(F.col("finding_id") / 50).cast("string").alias("report")).agg(
        F.to_json(F.struct(F.collect_list(items).alias(name))).alias("text"))


def read_bandit(spark, sf):
    item = F.struct(
        F.concat(F.lit("B"), (F.col("finding_id") % 40 + 100).cast("string")).alias("test_id"),
        F.col("source").alias("test_name"), F.col("message").alias("issue_text"),
        F.lower("severity").alias("issue_severity"),
        F.concat(F.lit("f"), F.col("finding_id").cast("string")).alias("filename"),
        (F.col("finding_id") % 300).alias("line_number"))
    tests = fx.findings(spark, sf).select((F.col("finding_id") % 40).alias("n")).distinct().where(
        "n % 3 <> 0").select(
        F.concat(F.lit("B"), (F.col("n") + 100).cast("string")).alias("test_id"),
        F.concat(F.lit("CWE-"), F.col("n").cast("string")).alias("cwe"),
        F.when(F.col("n") % 2 == 0, F.lit("A03:2021")).alias("owasp"))
    found = reports.read_bandit(_json_reports(spark, sf, "results", item), tests)
    return _texts(found, "cwes", "owasp_categories", "references").select(
        "rule_id", "message", "severity", "confidence", "file", "line_start", "cwes",
        "owasp_categories", "references")


def read_pip_audit(spark, sf):
    even = F.col("finding_id") % 2 == 0
    item = F.struct(
        F.when(even, F.col("source")).alias("name"), F.when(~even, F.col("source")).alias("package"),
        F.concat(F.lit("1."), F.col("finding_id").cast("string")).alias("version"),
        F.concat(F.lit("V-"), F.col("finding_id").cast("string")).alias("id"),
        F.when(even, F.col("message")).alias("description"),
        F.when(~even, F.col("message")).alias("advisory"))
    found = reports.read_pip_audit(_json_reports(spark, sf, "vulnerabilities", item))
    return _texts(found, "cwes", "owasp_categories", "references").select(
        "rule_id", "message", "severity", "package", "version", "cwes", "owasp_categories",
        "references")


def read_pnpm_audit(spark, sf):
    f = fx.findings(spark, sf)
    name = F.concat(F.lit("pkg"), F.col("finding_id").cast("string"))
    via = F.array(F.struct(F.col("finding_id").alias("source"), F.col("message").alias("title"),
                           F.array(F.lit("CWE-79")).alias("cwe"), name.alias("url")))
    made = f.groupBy(F.floor(F.col("finding_id") / 50).cast("string").alias("report")).agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(name, F.struct(
            F.lower("severity").alias("severity"), via.alias("via"), F.lit("<2").alias("range")))))
            .alias("vulnerabilities"))).alias("text"))
    found = reports.read_pnpm_audit(made, "pnpm-audit")
    return _texts(found, "cwes", "references").select(
        "source", "rule_id", "message", "severity", "package", "version", "cwes", "references")


def read_njsscan(spark, sf):
    f = fx.findings(spark, sf)
    rule = F.concat(F.lit("rule"), F.col("finding_id").cast("string"))
    body = F.struct(
        F.struct("message", F.col("message").alias("description"), F.lower("severity")
                 .alias("severity"), F.lit("CWE-89: injection").alias("cwe"),
                 F.lit("A1:2017 Injection").alias("owasp"), rule.alias("ref")).alias("metadata"),
        F.array(F.struct(rule.alias("file_path"), F.array(F.lit(3), F.lit(5)).alias("match_lines"),
                         F.repeat(F.lit("abc"), 50).alias("match_string"))).alias("files"))
    made = f.groupBy(F.floor(F.col("finding_id") / 50).cast("string").alias("report")).agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(rule, body)))
                           .alias("nodejs"), F.lit("5").alias("version"))).alias("text"))
    found = reports.read_njsscan(made, "njsscan")
    return _texts(found, "cwes", "owasp_categories", "references").select(
        "rule_id", "message", "severity", "file", "line_start", "line_end", "cwes",
        "owasp_categories", "references")


def read_trufflehog(spark, sf):
    f = fx.findings(spark, sf)
    where = F.struct("source", F.concat(F.lit("f"), F.col("finding_id").cast("string"))
                     .alias("file"), (F.col("finding_id") % 77).alias("line"),
                     F.lit("c0ffee").alias("commit"))
    disk = F.col("finding_id") % 2 == 0
    line = F.to_json(F.struct(
        F.col("source").alias("DetectorName"), (F.col("finding_id") % 3).alias("DetectorType"),
        (F.col("finding_id") % 5 == 0).alias("Verified"),
        F.struct(F.struct(F.when(disk, where).alias("Filesystem"),
                          F.when(~disk, where).alias("Git")).alias("Data"))
        .alias("SourceMetadata")))
    rows = f.select(F.lit("scan").alias("report"), F.when(
        F.col("finding_id") % 9 == 0, "not json {").otherwise(line).alias("text"))
    return reports.read_trufflehog(rows).select(
        "rule_id", "message", "severity", "file", "line_start", "commit", "verified")


def read_trivy(spark, sf):
    item = F.struct(
        F.concat(F.lit("CVE-"), F.col("finding_id").cast("string")).alias("VulnerabilityID"),
        F.col("source").alias("PkgName"), F.lit("1.0.1").alias("InstalledVersion"),
        F.initcap("severity").alias("Severity"),
        F.repeat(F.col("message"), 20).alias("Description"),
        F.array(F.lit("CWE-1"), F.lit("CWE-2")).alias("CweIDs"),
        F.array(*[F.lit(f"r{i}") for i in range(5)]).alias("References"))
    f = fx.findings(spark, sf)
    made = f.groupBy(F.floor(F.col("finding_id") / 50).cast("string").alias("report")).agg(
        F.to_json(F.struct(F.array(F.struct(
            F.lit("lock").alias("Target"), F.collect_list(item).alias("Vulnerabilities")))
            .alias("Results"))).alias("text"))
    return _texts(reports.read_trivy(made), "cwes", "references").select(
        "rule_id", "message", "severity", "package", "version", "target", "cwes", "references")


def findings_totals(spark, sf):
    return reports.findings_totals(fx.findings(spark, sf))


def tag_weaknesses(spark, sf):
    return fi.tag_weaknesses(fx.findings(spark, sf), *_mapping(spark, sf)).select(
        "finding_id", "cwe", "owasp_id", "sans_rank", "sans_name")


def _to_categorise(spark, sf):
    f = fx.findings(spark, sf)
    listed = F.array_compact(F.array(
        F.when(F.col("finding_id") % 5 == 0, "A03:2021"),
        F.when(F.col("finding_id") % 7 == 0, "A77:2021")))
    return f.where("finding_id % 10 <> 9").withColumn(
        "cwes", reports.cwe_ids(F.col("message"))).unionByName(
        f.where("finding_id % 10 = 9").withColumn("cwes", F.array().cast("array<string>"))
    ).withColumn("owasp_categories", listed)


def categorise_findings(spark, sf):
    rows, _ = fi.categorise_findings(_to_categorise(spark, sf), *_mapping(spark, sf))
    return rows.select("finding_id", "framework", "category")


def uncategorised_findings(spark, sf):
    _, rest = fi.categorise_findings(_to_categorise(spark, sf), *_mapping(spark, sf))
    return rest.select("finding_id")


def _rollups(spark, sf):
    mapping = _mapping(spark, sf)
    rows, _ = fi.categorise_findings(_to_categorise(spark, sf), *mapping)
    return fi.severity_rollups(rows, *mapping)


def severity_rollup_categories(spark, sf):
    return _rollups(spark, sf)[0]


def severity_rollup_ranks(spark, sf):
    return _rollups(spark, sf)[1]


def top_findings(spark, sf):
    rows, _ = fi.categorise_findings(_to_categorise(spark, sf), *_mapping(spark, sf))
    once = rows.select("finding_id", "framework", "category").distinct()
    return fi.top_findings(once, 5, ["framework", "category"], ["finding_id"])


QUERIES = {f.__name__: f for f in (
    query_table, query_table_times, query_table_pages, query_documents, query_documents_without, query_documents_shredded, update_document_first, delete_documents,
    find_document, column_rules, allowed_columns, merge_rules,
    merge_rules_refused, merge_rows_ignore, merge_rows_replace, merge_rows_error, cast_columns,
    update_where, update_first, delete_where, delete_cascade, delete_cascade_parents,
    clear_counts, customer_quality, customer_quality_valid, mask_secrets, active_customers,
    change_stored_rows, usage_totals, usage_by_path, usage_latest, limit_check, set_limits, usage_trailing,
    usage_windows, usage_alerts, read_semgrep, read_bandit, read_pip_audit, read_pnpm_audit,
    read_njsscan, read_trufflehog, read_trivy, findings_totals, tag_weaknesses,
    categorise_findings, uncategorised_findings, severity_rollup_categories,
    severity_rollup_ranks, top_findings)}


# --- oracle --------------------------------------------------------------------------

_DESCRIBED = {
    "described": """SELECT concat('t', user_id) AS table_name,
                           list_sort(list_distinct(list(event_type))) AS columns
                    FROM events GROUP BY user_id""",
    "rules": """SELECT concat('t', user_id) AS table_name, [min(event_type)] AS dis,
                       user_id % 15 = 0 AS closed FROM events WHERE user_id % 3 = 0
                GROUP BY user_id""",
    "fresh": """SELECT concat(CASE WHEN user_id % 8 = 0 THEN 'u' ELSE 't' END, user_id)
                       AS table_name, [max(event_type)] AS dis
                FROM events WHERE user_id % 2 = 0 GROUP BY user_id""",
    "judged": """SELECT n.table_name, n.dis, r.dis AS old, r.closed,
                        CASE WHEN d.columns IS NULL THEN 'unknown_table'
                             WHEN r.closed THEN 'table_fully_disabled'
                             WHEN r.dis = n.dis THEN 'column_already_disabled' END AS reason
                 FROM fresh n LEFT JOIN described d USING (table_name)
                 LEFT JOIN rules r USING (table_name)""",
}
_SIDES = {
    "tgt": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0",
    "src": """SELECT o_orderkey, o_custkey, round(o_totalprice * 2, 2) AS o_totalprice
              FROM orders WHERE o_orderkey % 2 = 0
              UNION ALL SELECT o_orderkey, o_custkey, 1.0 FROM orders WHERE o_orderkey % 10 = 0""",
}
_DOUBT = {"doubt": """
    SELECT n, CASE WHEN n % 11 = 0 THEN upper(code) ELSE code END AS code,
           CASE WHEN n % 13 <> 0 THEN display_name END AS display_name,
           CASE WHEN n % 17 = 0 THEN 'by_phone' ELSE extraction_strategy END AS strategy,
           CASE WHEN n % 19 = 0 THEN ' HTTP://key' WHEN n % 23 = 0 THEN '' ELSE api_key END AS k
    FROM (SELECT *, CAST(substr(code, 2) AS BIGINT) AS n FROM fx_customers)""",
    "judged": """
    SELECT n, code, concat_ws('|',
        CASE WHEN NOT regexp_full_match(code, '[a-z0-9][a-z0-9_-]*')
             OR length(code) NOT BETWEEN 2 AND 40 THEN 'bad_code' END,
        CASE WHEN coalesce(display_name, '') = '' THEN 'name_missing' END,
        CASE WHEN strategy = 'by_phone' THEN 'unknown_strategy' END,
        CASE WHEN strategy = 'api_model' AND coalesce(k, '') = '' THEN 'key_missing' END,
        CASE WHEN lower(trim(k)) LIKE 'http%' THEN 'key_is_url' END) AS violations FROM doubt"""}
_LIMITS = {"lim": """
    SELECT p.period, u.path, CASE WHEN length(u.path) % 2 = 0 THEN round(sum(u.cost) * 0.9, 2) END
               AS max_cost, CAST(sum(u.tokens) AS BIGINT) AS max_tokens
    FROM fx_usages u CROSS JOIN (VALUES ('daily'), ('monthly')) p(period) GROUP BY 1, 2
    UNION ALL SELECT 'monthly', NULL, round(sum(cost) * 2, 2), NULL FROM fx_usages"""}
_T = "TIMESTAMP '2024-01-30 12:00:00'"
_SPAN = {"minute": "INTERVAL 1 MINUTE", "daily": "INTERVAL 1 DAY", "monthly": "INTERVAL 30 DAY"}


def _total(period, path) -> str:
    where = [f"timestamp >= {_T} - {_SPAN[period]}"] if period else []
    where += [f"path = '{path}'"] if path else []
    clause = f"WHERE {' AND '.join(where)}" if where else ""
    return (f"SELECT '{period or 'ever'}' AS period, '{path or '*'}' AS path, "
            "CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, "
            f"round(coalesce(sum(cost), 0), 4) AS cost FROM fx_usages {clause}")


def _trailing() -> str:
    cols = []
    for name, part in (("path", "PARTITION BY path"), ("all", "")):
        for p, span in _SPAN.items():
            over = (f"OVER ({part} ORDER BY timestamp RANGE BETWEEN {span} PRECEDING "
                    "AND CURRENT ROW)")
            cols.append(f"CAST(sum(tokens) {over} AS BIGINT) AS {name}_{p}_tokens")
            cols.append(f"round(CAST(sum(CAST(cost AS DECIMAL(18,6))) {over} AS DOUBLE), 4) "
                        f"AS {name}_{p}_cost")
    return f"SELECT id, {', '.join(cols)} FROM fx_usages"


_MAPPING = {
    "numbers": """SELECT DISTINCT CAST(n AS INT) AS n FROM (SELECT unnest(
                  regexp_extract_all(message, '(?i)CWE-(\\d+)', 1)) AS n FROM fx_findings)""",
    "member": """SELECT unnest([n % 11 + 1, (n % 11 + 2) % 10 + 1]) AS slot,
                        concat('CWE-', n) AS cwe FROM numbers WHERE n % 11 < 10""",
    "cats": """SELECT DISTINCT slot, cwe, concat('A', lpad(CAST(slot AS STRING), 2, '0'), ':2021')
               AS owasp_id FROM member""",
    "owasp_of": "SELECT cwe, min_by(owasp_id, slot) AS owasp_id FROM cats GROUP BY 1",
    "sans": "SELECT concat('CWE-', n) AS cwe, n AS rank, concat('Weakness ', n) AS name "
            "FROM numbers WHERE n % 4 = 0",
}
_CATEGORISED = {
    **_MAPPING,
    "fcwe": """SELECT finding_id, severity, concat('CWE-', n) AS cwe FROM (
                 SELECT finding_id, severity,
                        unnest(regexp_extract_all(message, '(?i)CWE-(\\d+)', 1)) AS n
                 FROM fx_findings WHERE finding_id % 10 <> 9)""",
    "listed": """SELECT finding_id, severity, 'A03:2021' AS category FROM fx_findings
                 WHERE finding_id % 5 = 0 AND 'A03:2021' IN (SELECT owasp_id FROM cats)""",
    "catrows": """
        SELECT finding_id, severity, 'owasp' AS framework, category FROM listed
        UNION ALL SELECT f.finding_id, f.severity, 'sans', f.cwe FROM fcwe f
                  JOIN sans s ON s.cwe = f.cwe
        UNION ALL SELECT f.finding_id, f.severity, 'owasp', o.owasp_id FROM fcwe f
                  JOIN owasp_of o ON o.cwe = f.cwe
                  WHERE NOT (f.finding_id % 5 = 0 AND o.owasp_id = 'A03:2021')""",
}
_SEV = ", ".join(
    f"count(*) FILTER (WHERE r.framework IS NOT NULL AND "
    + (f"r.severity = '{s}'" if s != "UNKNOWN" else
       "r.severity NOT IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO')") + f") AS {s.lower()}"
    for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "UNKNOWN"))
_UP = "upper(severity)"

_EVENT_DOCS = """docs AS (SELECT lpad(CAST(event_id AS STRING), 12, '0') AS _id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS t FROM events)"""

_TIMES = {"et": """SELECT event_id, event_type, CASE WHEN event_id % 11 <> 0 THEN strftime(ts, '%H:%M:%S') END AS tm FROM events"""}
ORACLE = {
    "query_table_times": with_views("", _TIMES, """
        SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN tm END AS "at", CASE WHEN event_id % 13 = 0 THEN 'at' ELSE '' END AS errors
        FROM et WHERE CAST(tm AS TIME) >= TIME '08:30:00' AND CAST(tm AS TIME) < TIME '17:05:09'"""),
    "query_table_pages": with_views("", _TIMES, """
        SELECT event_id, tm AS "at", CAST(ceil(row_number() OVER (ORDER BY tm DESC NULLS FIRST, event_id) /
               ((SELECT (count(*) + 5) // 6 FROM events) + 1)) AS INT) AS page FROM et WHERE event_type >= 'b'"""),
    "query_table": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        WHERE o_totalprice >= 1000.5 AND o_orderdate < TIMESTAMP '1998-06-01'
          AND o_orderstatus = 'F'
        ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 200 OFFSET 50""",
    "query_documents": """
        SELECT * FROM (SELECT lpad(CAST(event_id AS STRING), 12, '0') AS _id,
               json_extract_string(props, '$.k') AS k, event_type FROM events)
        WHERE CAST(k AS INT) >= 20 AND CAST(k AS INT) < 90
          AND event_type IN ('click', 'view', 'error') AND _id > '000000000100'
        ORDER BY _id LIMIT 100""",
    "query_documents_without": f"""
        WITH {_EVENT_DOCS} SELECT _id, concat('{{"k":', k, ',"type":"', t, '"}}') AS doc FROM docs
        WHERE k <> 5""",
    "query_documents_shredded": f"""
        WITH {_EVENT_DOCS} SELECT _id, concat('{{"k":', k, ',"type":"', t, '"}}') AS doc FROM docs
        WHERE k >= 20 AND k < 90 AND k <> 33 AND t IN ('click', 'view')""",
    "update_document_first": f"""
        WITH {_EVENT_DOCS} SELECT _id, CASE WHEN _id = (SELECT min(_id) FROM docs WHERE t = 'click' AND k > 40)
            THEN concat('{{"k":-1,"secret":"s","seen":true,"type":"', t, '"}}')
            ELSE concat('{{"k":', k, ',"secret":"s","type":"', t, '"}}') END AS doc FROM docs""",
    "delete_documents": f"""
        WITH {_EVENT_DOCS} SELECT _id, concat('{{"k":', k, ',"secret":"s","type":"', t, '"}}') AS doc FROM docs
        WHERE t NOT IN ('click', 'view')""",
    "find_document": f"""
        WITH {_EVENT_DOCS} SELECT _id, concat('{{"k":', k, ',"secret":"s","type":"', t, '"}}') AS doc FROM docs
        WHERE k >= 90 AND t = 'error' ORDER BY _id LIMIT 1""",
    "column_rules": with_views("fx_customers", {}, """
        SELECT code, display_name, extraction_strategy, active FROM fx_customers"""),
    "allowed_columns": with_views("", _DESCRIBED, """
        SELECT table_name, array_to_string(left_over, '|') AS columns FROM (
            SELECT d.table_name, list_sort(list_filter(d.columns,
                       lambda c: r.dis IS NULL OR NOT list_contains(r.dis, c))) AS left_over,
                   coalesce(r.closed, false) AS closed, r.dis
            FROM described d LEFT JOIN rules r USING (table_name))
        WHERE NOT closed AND NOT (table_name IN ('t1', 't3', 't4') AND dis IS NULL)
          AND len(left_over) > 0"""),
    "merge_rules": with_views("", _DESCRIBED, """
        SELECT table_name, array_to_string(dis, '|') AS disabled_columns,
               closed AS is_fully_disabled FROM rules
        WHERE table_name NOT IN (SELECT table_name FROM judged WHERE reason IS NULL)
        UNION ALL SELECT table_name, array_to_string(list_sort(
            CASE WHEN old IS NULL THEN dis ELSE list_distinct(list_concat(old, dis)) END), '|'),
            false FROM judged WHERE reason IS NULL"""),
    "merge_rules_refused": with_views("", _DESCRIBED, """
        SELECT table_name, reason FROM judged WHERE reason IS NOT NULL"""),
    "merge_rows_ignore": with_views("", _SIDES, """
        SELECT * FROM tgt UNION ALL
        SELECT o_orderkey, min(o_custkey) AS o_custkey, min(o_totalprice) AS o_totalprice FROM src
        WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tgt) GROUP BY 1"""),
    "merge_rows_replace": with_views("", _SIDES, """
        SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src) UNION ALL
        SELECT o_orderkey, min(o_custkey) AS o_custkey, max(o_totalprice) AS o_totalprice FROM src
        GROUP BY 1"""),
    "merge_rows_error": with_views("", _SIDES, """
        SELECT * FROM src WHERE o_orderkey IN (SELECT o_orderkey FROM tgt)
           OR o_orderkey IN (SELECT o_orderkey FROM src GROUP BY 1 HAVING count(*) > 1)"""),
    "cast_columns": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END
                   AS day, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS customer,
               o_orderstatus = 'F' AS done,
               concat_ws('|', CASE WHEN o_orderkey % 5 = 0 THEN 'day' END,
                         CASE WHEN o_orderkey % 7 = 0 THEN 'customer' END) AS cast_errors
        FROM orders""",
    "update_where": """
        SELECT o_orderkey, CASE WHEN hit THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN hit THEN 0.0 ELSE o_totalprice END AS o_totalprice
        FROM (SELECT *, o_totalprice > 250000 AND o_orderstatus = 'O' AS hit FROM orders)""",
    "update_first": """
        SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders
                   WHERE o_orderstatus = 'P') THEN 'first' ELSE o_orderstatus END
               AS o_orderstatus FROM orders""",
    "delete_where": """
        SELECT event_id, event_type, value FROM events
        WHERE NOT coalesce(event_type = 'click' AND value < 50, false)""",
    "delete_cascade": with_views("fx_lines fx_orders", {}, """
        SELECT order_id, line_no FROM fx_lines WHERE order_id NOT IN
            (SELECT id FROM fx_orders WHERE order_date < DATE '1996-01-01')"""),
    "delete_cascade_parents": with_views("fx_orders", {}, """
        SELECT id, customer, order_date FROM fx_orders
        WHERE NOT order_date < DATE '1996-01-01'"""),
    "clear_counts": """
        SELECT 'deleted_orders' AS what, count(*) AS n FROM orders
        UNION ALL SELECT 'deleted_files', count(*) FROM pages""",
    "customer_quality": with_views("fx_customers", _DOUBT, """
        SELECT n, violations FROM judged WHERE violations <> ''"""),
    "customer_quality_valid": with_views("fx_customers", _DOUBT, """
        SELECT n, code FROM judged WHERE violations = ''"""),
    "mask_secrets": with_views("fx_customers", {}, """
        SELECT code, display_name, extraction_strategy, active,
               coalesce(api_key, '') <> '' AS has_api_key FROM fx_customers"""),
    "active_customers": with_views("fx_customers", {}, """
        SELECT code, display_name FROM fx_customers WHERE active ORDER BY display_name"""),
    "usage_totals": with_views("fx_usages", {}, " UNION ALL ".join(
        _total(p, x) for p in (None, "minute", "daily", "monthly") for x in (None, "click"))),
    "usage_by_path": with_views("fx_usages", {}, f"""
        SELECT path, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost
        FROM fx_usages WHERE timestamp >= {_T} - INTERVAL 1 DAY GROUP BY 1"""),
    "usage_latest": with_views("fx_usages", {}, f"""
        SELECT id, path, tokens, cost FROM fx_usages
        WHERE timestamp >= {_T} - INTERVAL 30 DAY AND path = 'click'
        ORDER BY timestamp DESC, id DESC LIMIT 100"""),
    "limit_check": with_views("fx_usages", {**_LIMITS, "verdicts": f"""
        SELECT l.path, coalesce(coalesce(sum(u.cost), 0) < any_value(l.max_cost), true)
               AND coalesce(coalesce(sum(u.tokens), 0) < any_value(l.max_tokens), true) AS ok
        FROM lim l LEFT JOIN fx_usages u ON (l.path IS NULL OR u.path = l.path)
          AND u.timestamp >= {_T} - CASE l.period WHEN 'daily' THEN INTERVAL 1 DAY
                                    ELSE INTERVAL 30 DAY END
        GROUP BY l.period, l.path"""}, """
        SELECT p.path, bool_and(v.ok) AS available
        FROM (SELECT DISTINCT path FROM fx_usages) p
        JOIN verdicts v ON v.path = p.path OR v.path IS NULL GROUP BY 1"""),
    "set_limits": with_views("fx_usages", _LIMITS, """
        SELECT period, path, CASE WHEN path IS NULL OR length(path) % 2 = 0 THEN 1.5
                                  ELSE max_cost END AS max_cost, max_tokens FROM lim"""),
    "change_stored_rows": """
        WITH src AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 10000000 END AS o_orderkey,
                            'M' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderpriority
                     FROM orders WHERE o_orderkey < 1200 AND o_orderkey % 3 = 0),
        merged AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
                   WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src) UNION ALL SELECT * FROM src)
        SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice,
               CASE WHEN o_orderkey >= 2000 AND o_totalprice < 5000 THEN 'low' ELSE o_orderpriority END AS o_orderpriority
        FROM merged WHERE NOT (o_orderstatus = 'F' AND o_orderkey < 3000)""",
    "usage_trailing": with_views("fx_usages", {}, _trailing()),
    "usage_windows": with_views("fx_usages", {}, """
        SELECT * FROM (
            SELECT date_trunc('day', timestamp) AS window_start,
                   date_trunc('day', timestamp) + INTERVAL 1 DAY AS window_end, path,
                   CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost
            FROM fx_usages GROUP BY 1, 2, 3)"""),
    "usage_alerts": with_views("fx_usages", {**_LIMITS, "al": """
        SELECT period, path, max_cost, max_tokens FROM lim WHERE period = 'monthly'
        UNION ALL SELECT 'daily', path, NULL, CAST(floor(avg(t)) AS BIGINT) FROM
            (SELECT path, CAST(timestamp AS DATE) AS d, sum(tokens) AS t FROM fx_usages GROUP BY 1, 2) GROUP BY path
        UNION ALL SELECT 'minute', NULL, NULL, CAST(max(tokens) * 2 AS BIGINT) FROM fx_usages""",
        # Minute sums per scope; each comes in at the minute's end and leaves a period later.
        "ms": """
        SELECT path, date_trunc('minute', timestamp) + INTERVAL 1 MINUTE AS m, sum(tokens) AS t,
               sum(CAST(round(cost * 1000000) AS BIGINT)) AS u FROM fx_usages GROUP BY 1, 2
        UNION ALL SELECT NULL, date_trunc('minute', timestamp) + INTERVAL 1 MINUTE, sum(tokens),
               sum(CAST(round(cost * 1000000) AS BIGINT)) FROM fx_usages GROUP BY 2""",
        "moves": """
        SELECT l.period, l.path, l.max_cost, l.max_tokens, x.tm, x.sign * ms.t AS t, x.sign * ms.u AS u
        FROM al l JOIN ms ON ms.path IS NOT DISTINCT FROM l.path
        JOIN (VALUES ('minute', INTERVAL 1 MINUTE), ('daily', INTERVAL 1 DAY), ('monthly', INTERVAL 30 DAY)) s(period, span)
             ON s.period = l.period,
        LATERAL (SELECT ms.m AS tm, 1 AS sign UNION ALL SELECT ms.m + s.span, -1) x""",
        "sums": """
        SELECT period, path, max_cost, max_tokens, tm, sum(sum(t)) OVER w AS t, sum(sum(u)) OVER w AS u
        FROM moves GROUP BY 1, 2, 3, 4, 5
        WINDOW w AS (PARTITION BY period, path ORDER BY tm RANGE UNBOUNDED PRECEDING)""",
        "judged": """
        SELECT *, coalesce(t >= max_tokens, false) OR coalesce(u / 1000000.0 >= max_cost, false) AS over FROM sums"""}, """
        SELECT path, path IS NULL AS overall, period, tm AS "at", CAST(t AS BIGINT) AS tokens,
               round(u / 1000000.0, 4) AS cost, over
        FROM (SELECT *, lag(over, 1, false) OVER (PARTITION BY period, path ORDER BY tm) AS was FROM judged)
        WHERE over <> was"""),
    "read_semgrep": with_views("fx_findings", {**_MAPPING, "c": f"""
        SELECT finding_id, source, severity, message, list_sort(list_distinct(list_concat(
            CASE WHEN finding_id % 4 = 0 THEN ['CWE-20'] ELSE [] END,
            list_transform(regexp_extract_all(message, '(?i)CWE-(\\d+)', 1),
                           lambda x: 'CWE-' || x)))) AS cwes FROM fx_findings""",
        "mapped": """SELECT c.finding_id, list(o.owasp_id) AS ids FROM
            (SELECT finding_id, unnest(cwes) AS cwe FROM c) c
            JOIN owasp_of o ON o.cwe = c.cwe GROUP BY 1"""}, f"""
        SELECT concat('rule.', source) AS rule_id, message, {_UP} AS severity,
               concat('src/f', c.finding_id, '.py') AS file, c.finding_id % 90 AS line_start,
               c.finding_id % 90 + 1 AS line_end, array_to_string(cwes, '|') AS cwes,
               array_to_string(list_sort(list_distinct(list_concat(
                   CASE WHEN c.finding_id % 6 = 0 THEN ['A03:2021'] ELSE [] END,
                   coalesce(m.ids, [])))), '|') AS owasp_categories
        FROM c LEFT JOIN mapped m ON m.finding_id = c.finding_id"""),
    "read_bandit": with_views("fx_findings", {}, f"""
        SELECT concat('B', i % 40 + 100, ':', source) AS rule_id, message, {_UP} AS severity,
               'LOW' AS confidence, concat('f', i) AS file, i % 300 AS line_start,
               CASE WHEN i % 40 % 3 <> 0 THEN concat('CWE-', i % 40) ELSE '' END AS cwes,
               CASE WHEN i % 40 % 3 <> 0 AND i % 40 % 2 = 0 THEN 'A03:2021' ELSE '' END
                   AS owasp_categories,
               concat('https://bandit.readthedocs.io/en/latest/plugins/b', i % 40 + 100, '_',
                      source, '.html') AS "references"
        FROM (SELECT *, finding_id AS i FROM fx_findings)"""),
    "read_pip_audit": with_views("fx_findings", {}, """
        SELECT concat('V-', finding_id) AS rule_id,
               concat(source, '@1.', finding_id, ': ', message) AS message, 'HIGH' AS severity,
               source AS package, concat('1.', finding_id) AS version,
               array_to_string(list_transform(regexp_extract_all(message, '(?i)CWE-(\\d+)', 1),
                   lambda x: 'CWE-' || x), '|') AS cwes, 'A06:2021' AS owasp_categories,
               concat('https://pypi.org/project/', source, '/') AS "references"
        FROM fx_findings"""),
    "read_pnpm_audit": with_views("fx_findings", {}, f"""
        SELECT 'pnpm-audit' AS source, CAST(finding_id AS STRING) AS rule_id,
               concat('pkg', finding_id, ': ', message) AS message, {_UP} AS severity,
               concat('pkg', finding_id) AS package, '<2' AS version, 'CWE-79' AS cwes,
               concat('pkg', finding_id) AS "references" FROM fx_findings"""),
    "read_njsscan": with_views("fx_findings", {}, f"""
        SELECT concat('rule', finding_id) AS rule_id,
               concat(message, ' - ', repeat('abc', 50)) AS message,
               {_UP} AS severity, concat('rule', finding_id) AS file,
               CAST(3 AS BIGINT) AS line_start, CAST(5 AS BIGINT) AS line_end, 'CWE-89' AS cwes,
               'A1:2017' AS owasp_categories, concat('rule', finding_id) AS "references"
        FROM fx_findings"""),
    "read_trufflehog": with_views("fx_findings", {}, """
        SELECT concat(source, CASE WHEN finding_id % 3 = 0 THEN ''
                      ELSE concat(' (', finding_id % 3, ')') END) AS rule_id,
               concat(CASE WHEN finding_id % 5 = 0 THEN 'Verified ' ELSE 'Potential ' END, source,
                      ' secret detected in f', finding_id) AS message,
               CASE WHEN finding_id % 5 = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
               concat('f', finding_id) AS file, finding_id % 77 AS line_start,
               CASE WHEN finding_id % 2 = 0 THEN '' ELSE 'c0ffee' END AS "commit",
               finding_id % 5 = 0 AS verified
        FROM fx_findings WHERE finding_id % 9 <> 0"""),
    "read_trivy": with_views("fx_findings", {}, f"""
        SELECT concat('CVE-', finding_id) AS rule_id,
               concat(source, '@1.0.1: ', repeat(message, 20)) AS message,
               {_UP} AS severity, source AS package, '1.0.1' AS version, 'lock' AS target,
               'CWE-1|CWE-2' AS cwes, 'r0|r1|r2|r3|r4' AS "references" FROM fx_findings"""),
    "findings_totals": with_views("fx_findings", {}, """
        SELECT source, severity, count(*) AS n FROM fx_findings GROUP BY ROLLUP (1, 2)"""),
    "tag_weaknesses": with_views("fx_findings", {**_MAPPING, "named": """
        SELECT DISTINCT finding_id, concat('CWE-', n) AS cwe FROM (SELECT finding_id,
            unnest(regexp_extract_all(message, '(?i)CWE-(\\d+)', 1)) AS n FROM fx_findings)"""}, """
        SELECT n.finding_id, n.cwe, o.owasp_id, s.rank AS sans_rank, s.name AS sans_name
        FROM named n LEFT JOIN owasp_of o ON o.cwe = n.cwe LEFT JOIN sans s ON s.cwe = n.cwe"""),
    "categorise_findings": with_views("fx_findings", _CATEGORISED, """
        SELECT finding_id, framework, category FROM catrows"""),
    "uncategorised_findings": with_views("fx_findings", _CATEGORISED, """
        SELECT finding_id FROM fx_findings
        WHERE finding_id NOT IN (SELECT finding_id FROM catrows)"""),
    "severity_rollup_categories": with_views("fx_findings", _CATEGORISED, f"""
        SELECT c.owasp_id, concat('Category ', c.slot) AS name, count(r.finding_id)
               AS finding_count, {_SEV}
        FROM (SELECT DISTINCT owasp_id, slot FROM cats) c LEFT JOIN catrows r
          ON r.framework = 'owasp' AND r.category = c.owasp_id GROUP BY 1, 2"""),
    "severity_rollup_ranks": with_views("fx_findings", _CATEGORISED, f"""
        SELECT s.cwe, s.rank, s.name, count(r.finding_id) AS finding_count, {_SEV}
        FROM sans s LEFT JOIN catrows r ON r.framework = 'sans' AND r.category = s.cwe
        GROUP BY 1, 2, 3"""),
    "top_findings": with_views("fx_findings", _CATEGORISED, """
        SELECT finding_id, framework, category, place FROM (SELECT finding_id, framework, category,
            row_number() OVER (PARTITION BY framework, category ORDER BY finding_id) AS place
            FROM (SELECT DISTINCT finding_id, framework, category FROM catrows))
        WHERE place <= 5"""),
}
