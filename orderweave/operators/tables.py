"""Typed filters, paging, column rules and row changes on any table."""

from __future__ import annotations

import json
import re
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderweave import fixed_values as fv
from orderweave.functions.text import strip
from orderweave.operators.joins import all_of, any_of

_COMPARE = {
    "eq": Column.__eq__, "lt": Column.__lt__, "lte": Column.__le__,
    "gt": Column.__gt__, "gte": Column.__ge__,
}
_TRUE_WORDS = ("true", "1", "yes")


# --- literals and filters ---------------------------------------------------------

def literal(text: str, dtype: T.DataType) -> Column:
    """A text literal in the type of the column it is compared with or stored in."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return F.lit(text)
    if isinstance(dtype, T.IntegralType):
        return F.lit(int(text)).cast(dtype)
    if isinstance(dtype, T.DecimalType):
        return F.lit(Decimal(text))
    if isinstance(dtype, T.FractionalType):
        return F.lit(float(text))
    if isinstance(dtype, T.BooleanType):
        return F.lit(text.lower() in _TRUE_WORDS)
    if isinstance(dtype, T.DateType):
        return F.lit(date.fromisoformat(text))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit(datetime.fromisoformat(text)).cast(dtype)
    if isinstance(dtype, T.VariantType):
        return F.parse_json(F.lit(json.dumps(json.loads(text))))
    raise ValueError(f"unsupported column type: {dtype.simpleString()}")


#: Key of a text column's metadata that says it holds times of day, as ``HH:MM:SS``; for
#: sessions and files without a type for them.
TIME_OF_DAY = "time_of_day"


def holds_times(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.TimeType) or bool((field.metadata or {}).get(TIME_OF_DAY))


def time_text(text: str) -> str:
    """A time of day with two digits for each of its parts, which sorts by time."""
    if not re.fullmatch(r"([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d", text):
        raise ValueError(f"not a time of day: {text}; hours, minutes and seconds are needed")
    return ":".join(part.zfill(2) for part in text.split(":"))


def field_literal(text: str, field: T.StructField) -> Column:
    """As ``literal``, also for times of day."""
    if not holds_times(field):
        return literal(text, field.dataType)
    value = F.lit(time_text(text))
    return F.to_time(value) if isinstance(field.dataType, T.TimeType) else value


def _read_time(c: Column, dtype: T.DataType) -> Column:
    """A column of texts as times; NULL where one does not read as such."""
    parts = F.transform(F.split(strip(c), ":"), lambda p: F.lpad(p, 2, "0"))
    value = F.when(strip(c).rlike(r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$"), F.array_join(parts, ":"))
    return F.try_to_time(value) if isinstance(dtype, T.TimeType) else value


def filter_column(df: DataFrame, filters: dict[str, str]) -> Column:
    """AND of ``{"column": "op:value"}`` filters with eq, lt, lte, gt, gte."""
    predicates = []
    for name, spec in filters.items():
        op, colon, value = str(spec).partition(":")
        if not colon:
            raise ValueError(f"invalid filter: {spec}")
        if op not in _COMPARE:
            raise ValueError(f"unsupported operator: {op}")
        if name not in df.columns:
            raise ValueError(f"unknown column: {name}")
        predicates.append(_COMPARE[op](F.col(name), field_literal(value, df.schema[name])))
    return all_of(predicates)


def cast_columns(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Text rows in the types of a target table; what does not parse is reported.

    Adds ``cast_errors``, the names of the columns with an unreadable value.
    """
    casts, errors = [], []
    for field in schema:
        if field.name not in rows.columns:
            casts.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        c, dtype = F.col(field.name), field.dataType
        if rows.schema[field.name].dataType != T.StringType():
            casts.append(c.cast(dtype).alias(field.name))
            continue
        if isinstance(dtype, T.BooleanType):
            value = F.lower(c).isin(*_TRUE_WORDS)
        elif isinstance(dtype, T.DateType):
            value = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))
        elif holds_times(field):
            value = _read_time(c, dtype)
        elif isinstance(dtype, T.VariantType):
            value = F.try_parse_json(c)
        elif isinstance(dtype, T.StringType):
            value = c
        else:
            value = strip(c).try_cast(dtype)
        casts.append(value.alias(field.name))
        errors.append(F.when(c.isNotNull() & value.isNull(), F.lit(field.name)))
    return rows.select(*casts, F.array_compact(F.array(*errors)).alias("cast_errors"))


# --- queries --------------------------------------------------------------------------

def _sort_order(order_by: str | None, key: list[str]) -> list[tuple[str, bool, bool]]:
    """(column, ascending, NULLs first) of a sort, with the key, so that pages do not overlap."""
    order = []
    if order_by:
        name, _, direction = order_by.partition(":")
        direction = direction.lower() or "asc"
        if direction not in ("asc", "desc"):
            raise ValueError(f"unknown sort direction: {direction}")
        # NULLs sort as the largest value.
        order.append((name, direction == "asc", direction == "desc"))
    return order + [(k, True, True) for k in key]


def sort_columns(order_by: str | None, key: list[str]) -> list[Column]:
    """``"column[:asc|desc]"`` plus the key."""
    return [(F.asc_nulls_first if nulls_first else F.asc_nulls_last)(name) if ascending
            else (F.desc_nulls_first if nulls_first else F.desc_nulls_last)(name)
            for name, ascending, nulls_first in _sort_order(order_by, key)]


def _cursor_value(df: DataFrame, name: str, value) -> Column:
    field = df.schema[name]
    return field_literal(str(value), field) if holds_times(field) else F.lit(value).cast(field.dataType)


def after_cursor(df: DataFrame, cursor: dict, order_by: str | None, key: list[str]) -> Column:
    """The rows that come after the row with these values in the sort order, NULLs included."""
    alternatives, same = [], []
    for name, ascending, nulls_first in _sort_order(order_by, key):
        c, value = F.col(name), cursor[name]
        if value is None:
            later = c.isNotNull() if nulls_first else F.lit(False)
            equal = c.isNull()
        else:
            bound = _cursor_value(df, name, value)
            later = c > bound if ascending else c < bound
            later = F.coalesce(later, F.lit(not nulls_first))
            equal = c.eqNullSafe(bound)
        alternatives.append(all_of([*same, later]))
        same.append(equal)
    return any_of(alternatives)


def decimals_as_double(df: DataFrame) -> DataFrame:
    decimals = {f.name: F.col(f.name).cast("double") for f in df.schema
                if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(decimals) if decimals else df


def query_table(df: DataFrame, filters: dict[str, str] | None = None,
                columns: list[str] | None = None, order_by: str | None = None,
                limit: int = 100, offset: int = 0, key: list[str] | None = None,
                max_page: int | None = None, after: dict | None = None) -> DataFrame:
    """One page of a table. ``max_page`` refuses larger pages, if the caller wants that.

    after: the ``next_cursor`` of the page before. A page then starts behind that row and costs
    the same wherever it stands, while an offset sorts all rows before it too.
    """
    if limit < 1 or offset < 0 or (max_page is not None and limit > max_page):
        raise ValueError(f"limit must be 1..{max_page or 'any'} and offset not negative")
    if after is not None and not key:
        raise ValueError("pages by cursor need a key")
    found = df.where(filter_column(df, filters or {}))
    if after is not None:
        found = found.where(after_cursor(df, after, order_by, key))
    order = sort_columns(order_by, key or [])
    page = (found.orderBy(*order) if order else found).offset(offset).limit(limit)
    return decimals_as_double(page.select(*(columns or df.columns)))


def next_cursor(page: DataFrame, order_by: str | None, key: list[str], limit: int) -> dict | None:
    """The sort values of a page's last row; None after a page that is not full.

    The page must hold the sort column and the key. Decimals go through doubles, as in the page.
    """
    order = _sort_order(order_by, key)
    shown = [F.col(n).cast("string").alias(n) if holds_times(page.schema[n]) else F.col(n) for n, *_ in order]
    from_the_end = [(F.desc_nulls_last if nulls_first else F.desc_nulls_first)(n) if ascending
                    else (F.asc_nulls_last if nulls_first else F.asc_nulls_first)(n) for n, ascending, nulls_first in order]
    if page.count() < limit:
        return None
    return page.orderBy(*from_the_end).select(*shown).first().asDict()


def next_offset(page: DataFrame, limit: int, offset: int) -> int | None:
    """Where the next page starts; None after a page that is not full."""
    rows = page.count()
    return offset + rows if rows == limit else None


# --- column rules ----------------------------------------------------------------------

def allowed_columns(tables: DataFrame, rules: DataFrame, closed=fv.CLOSED_TABLES) -> DataFrame:
    """Tables with their permitted columns; closed and emptied tables are left out."""
    fixed = F.col("table_name").isin(*closed)
    ruled = tables.join(rules, "table_name", "left")
    stored = F.coalesce("disabled_columns", F.array().cast("array<string>"))
    # A closed table without single disabled columns is closed as a whole.
    hidden = F.coalesce("is_fully_disabled", F.lit(False)) | (fixed & (F.size(stored) == 0))
    return (ruled.where(~hidden)
            .select("table_name", F.array_except("columns", stored).alias("columns"))
            .where(F.size("columns") > 0))


def merge_rules(tables: DataFrame, rules: DataFrame, new: DataFrame
                ) -> tuple[DataFrame, DataFrame]:
    """Add column rules, at most one new rule per table; refused ones have a reason."""
    old = rules.select("table_name", F.col("disabled_columns").alias("_old"),
                       F.col("is_fully_disabled").alias("_closed"))
    judged = new.join(tables, "table_name", "left").join(old, "table_name", "left").withColumn(
        "reason",
        F.when(F.col("columns").isNull(), "unknown_table")
        .when(F.size(F.array_except("disabled_columns", "columns")) > 0, "unknown_column")
        .when(F.col("_closed"), "table_fully_disabled")
        .when(F.arrays_overlap("_old", "disabled_columns"), "column_already_disabled"))
    fine = judged.where(F.col("reason").isNull()).select(
        "table_name",
        F.array_sort(F.array_union(F.coalesce("_old", F.array().cast("array<string>")),
                                   "disabled_columns")).alias("disabled_columns"),
        F.coalesce("is_fully_disabled", F.lit(False)).alias("is_fully_disabled"))
    kept = rules.join(fine.select("table_name"), "table_name", "left_anti")
    rejects = judged.where(F.col("reason").isNotNull()).select(*new.columns, "reason")
    return kept.select(*fine.columns).unionByName(fine), rejects


def column_rules(df: DataFrame, table: str, rules: DataFrame,
                 requested: list[str] | None = None, closed=fv.CLOSED_TABLES) -> DataFrame:
    """Project the permitted columns of a table; refuse any other requested name.

    ``requested`` takes every name a request uses: columns, filters, sort, updates.
    """
    rule = rules.where(F.col("table_name") == table).first()
    hidden = set(rule["disabled_columns"]) if rule else set()
    if (rule and rule["is_fully_disabled"]) or (table in closed and not hidden):
        raise PermissionError(f"table not allowed: {table}")
    allowed = [c for c in df.columns if c not in hidden]
    refused = sorted(set(requested or []) - set(allowed))
    if refused or not allowed:
        raise PermissionError(f"columns not allowed for {table}: {', '.join(refused)}")
    return df.select(*[c for c in allowed if not requested or c in requested])


# --- row changes ---------------------------------------------------------------------------

def _same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return all_of(left[k].eqNullSafe(right[k]) for k in keys)


def merge_rows(target: DataFrame, source: DataFrame, keys: list[str], mode: str = "ignore",
               prefer: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert rows by key; NULL keys equal each other.

    ``ignore`` keeps existing rows, ``replace`` lets the source win, ``error`` sets
    aside source rows whose key exists or repeats. Of source rows with one key the
    smallest ``prefer`` (default: all columns) goes in. Returns (rows, set-aside rows).
    """
    rest = [c for c in target.columns if c not in keys]
    order = prefer if prefer is not None else F.struct(*(rest or keys))
    whole = F.struct(*target.columns)
    once = source.groupBy(*keys).agg(F.min_by(whole, order).alias("_row"),
                                     F.count("*").alias("_n"))
    rows = once.select("_row.*")
    none = source.limit(0)
    if mode == "ignore":
        fresh = rows.join(target.select(*keys), _same_key(rows, target, keys), "left_anti")
        return target.unionByName(fresh), none
    if mode == "replace":
        kept = target.join(rows.select(*keys), _same_key(target, rows, keys), "left_anti")
        return kept.unionByName(rows), none
    if mode == "error":
        single = once.where(F.col("_n") == 1).select("_row.*")
        fresh = single.join(target.select(*keys), _same_key(single, target, keys), "left_anti")
        repeated = once.where(F.col("_n") > 1).select(*keys)
        clash = source.join(
            target.select(*keys).distinct().unionByName(repeated).distinct().select(
                *[F.col(k).alias(f"_{k}") for k in keys]),
            all_of(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), "left_semi")
        return target.unionByName(fresh), clash
    raise ValueError(f"unknown merge mode: {mode}")


def _matching(df: DataFrame, filters: dict[str, str]) -> Column:
    return F.coalesce(filter_column(df, filters), F.lit(False))


def _set_column(df: DataFrame, name: str, value) -> Column:
    if isinstance(value, Column):
        return value
    dtype = df.schema[name].dataType
    if isinstance(value, str) and (not isinstance(dtype, T.StringType) or holds_times(df.schema[name])):
        return field_literal(value, df.schema[name])
    return F.lit(value).cast(dtype)


def _assign(df: DataFrame, hit: Column, changes: dict) -> DataFrame:
    if not changes:
        raise ValueError("nothing to set")
    return df.withColumns({
        c: F.when(hit, _set_column(df, c, v)).otherwise(F.col(c)) for c, v in changes.items()})


def update_where(df: DataFrame, filters: dict[str, str], changes: dict
                 ) -> tuple[DataFrame, DataFrame]:
    """Set columns of the matching rows; returns (table, changed rows)."""
    marked = df.withColumn("_hit", _matching(df, filters))
    done = _assign(marked, F.col("_hit"), changes)
    return done.drop("_hit"), done.where("_hit").drop("_hit")


def update_first(df: DataFrame, filters: dict[str, str], changes: dict, key: str
                 ) -> tuple[DataFrame, DataFrame]:
    """Set columns of the matching row with the smallest unique key only."""
    first = df.where(_matching(df, filters)).agg(F.min(key).alias("_first")).scalar()
    marked = df.withColumn("_hit", F.coalesce(F.col(key) == first, F.lit(False)))
    done = _assign(marked, F.col("_hit"), changes)
    return done.drop("_hit"), done.where("_hit").drop("_hit")


def update_document_first(df: DataFrame, filters: dict, changes: dict[str, str], doc: str = "doc",
                          key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Set top-level fields of the first matching document, by ``key``.

    ``changes`` maps fields to JSON texts. Returns the documents and the new document, which
    is no row if none matches.
    """
    first = df.where(document_filter(df, filters, doc)).agg(F.min(key).alias("_first")).scalar()
    hit = F.coalesce(F.col(key) == first, F.lit(False))
    members = F.coalesce(F.try_variant_get(doc, "$", "map<string, variant>"),
                         F.create_map().cast("map<string, variant>"))
    put = F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), F.parse_json(F.lit(v)))])
    kept = F.map_filter(members, lambda k, _: ~k.isin(list(changes)))
    done = df.withColumn("_hit", hit).withColumn(
        doc, F.when(F.col("_hit"), F.to_variant_object(F.map_concat(kept, put))).otherwise(F.col(doc)))
    return done.drop("_hit"), done.where("_hit").drop("_hit")


def delete_documents(df: DataFrame, filters: dict, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """The documents that stay, and one row ``deleted`` with the number of the others."""
    hit = F.coalesce(document_filter(df, filters, doc), F.lit(False))
    return df.where(~hit), df.where(hit).agg(F.count("*").alias("deleted"))


def find_document(df: DataFrame, filters: dict, doc: str = "doc", key: str = "_id") -> DataFrame:
    """The first matching document by ``key``; the job fails if there is none."""
    found = df.where(document_filter(df, filters, doc)).orderBy(key).limit(1)
    one = found.agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("found"))
    missing = F.raise_error(F.lit("no document matches"))
    return one.select(F.when(F.col("n") > 0, F.col("found")).otherwise(missing).alias("found")).select(
        "found.*")


def delete_where(df: DataFrame, filters: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Remaining rows and the deleted ones; rows with unknown match stay."""
    hit = _matching(df, filters)
    return df.where(~hit), df.where(hit)


def delete_cascade(parents: DataFrame, children: dict[str, DataFrame], filters: dict[str, str],
                   key: str = "id", foreign_key: str = "order_id"
                   ) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Delete parents and everything that refers to them; last item: deleted keys."""
    kept, gone = delete_where(parents, filters)
    gone_keys = gone.select(F.col(key).alias(foreign_key)).distinct()
    rest = {name: child.join(gone_keys, foreign_key, "left_anti")
            for name, child in children.items()}
    return kept, rest, gone_keys


def clear_counts(orders: DataFrame, files: DataFrame) -> DataFrame:
    """Counts a full reset reports; the tables themselves are then truncated."""
    def counted(df, name):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")

    return counted(orders, "deleted_orders").unionByName(counted(files, "deleted_files"))


# --- documents --------------------------------------------------------------------------------

_NUMERIC_KINDS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def shredded_name(doc: str, name: str, what: str) -> str:
    """The column that holds a document field as ``number``, ``text`` or ``flag``, or whether it is ``there``."""
    return f"{doc}__{name}__{what}"


def shred_documents(df: DataFrame, hot: list[str], doc: str = "doc") -> DataFrame:
    """Add plain columns for the fields that filters often name.

    Each field gets one column per type that it is compared in, with the value that a filter reads from the
    document, so that filters on such a table give the same rows and reach the files.
    """
    return df.withColumns({
        shredded_name(doc, name, what): column for name in hot for what, column in (
            ("number", _field(df, name, 0.0, doc)), ("text", _field(df, name, "", doc)),
            ("flag", _field(df, name, True, doc)), ("there", _exists(df, name, doc)))})


def _field(df: DataFrame, name: str, value, doc: str) -> Column:
    """A field in the type of the value it is compared with, NULL in any other type."""
    if name in df.columns:
        return F.col(name)
    what = "flag" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text"
    if shredded_name(doc, name, what) in df.columns:
        return F.col(shredded_name(doc, name, what))
    path = f"$.{name}"
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    if what == "flag":
        return F.when(kind == "BOOLEAN", F.try_variant_get(doc, path, "boolean"))
    if what == "number":
        return F.when(kind.rlike(_NUMERIC_KINDS), F.try_variant_get(doc, path, "double"))
    return F.when(kind == "STRING", F.try_variant_get(doc, path, "string"))


def _exists(df: DataFrame, name: str, doc: str) -> Column:
    if name in df.columns:
        return F.col(name).isNotNull()
    if shredded_name(doc, name, "there") in df.columns:
        return F.col(shredded_name(doc, name, "there"))
    kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant"))
    return F.coalesce(kind != "VOID", F.lit(False))


def document_filter(df: DataFrame, filters: dict, doc: str = "doc") -> Column:
    """Equality and ``$eq $ne $gt $gte $lt $lte $in`` over columns or variant fields."""
    def one(name: str, op: str, value) -> Column:
        if op == "$in":
            return any_of(one(name, "$eq", v) for v in value)
        if op == "$ne":
            # Negation needs a plain truth value; elsewhere where() drops NULL by itself.
            return ~F.coalesce(one(name, "$eq", value), F.lit(False))
        if op == "$eq" and value is None:
            return ~_exists(df, name, doc)
        c = _field(df, name, value, doc)
        v = F.lit(float(value)) if (isinstance(value, int) and not isinstance(value, bool)
                                    and name not in df.columns) else F.lit(value)
        ops = {"$eq": c == v, "$gt": c > v, "$gte": c >= v, "$lt": c < v, "$lte": c <= v}
        if op not in ops:
            raise ValueError(f"unsupported operator: {op}")
        return ops[op]

    predicates = []
    for name, spec in filters.items():
        if isinstance(spec, dict):
            predicates += [one(name, op, value) for op, value in spec.items()]
        else:
            predicates.append(one(name, "$eq", spec))
    return all_of(predicates)


def document_projection(df: DataFrame, fields: dict[str, int], doc: str = "doc"
                        ) -> list[Column]:
    """Include-only or exclude-only field maps; ``_id`` may be dropped from either."""
    modes = {bool(v) for k, v in fields.items() if k != "_id"}
    if len(modes) > 1:
        raise ValueError("cannot include and exclude fields at the same time")
    with_id = fields.get("_id", 1) != 0
    if modes == {True}:
        names = [n for n in fields if n != "_id"]
        return ([F.col("_id")] if with_id else []) + [
            F.col(n) if n in df.columns else
            F.try_variant_get(doc, f"$.{n}", "string").alias(n) for n in names]
    inner = [n for n in fields if n != "_id" and n not in df.columns]
    return [without_fields(F.col(c), inner).alias(c) if c == doc and inner else F.col(c)
            for c in df.columns if not (c in fields and c != "_id") and (c != "_id" or with_id)
            and not c.startswith(f"{doc}__")]


def without_fields(doc: Column, names: list[str]) -> Column:
    """A variant object without some of its top-level fields; other variants as they are."""
    members = F.try_variant_get(doc, "$", "map<string, variant>")
    return F.when(members.isNull(), doc).otherwise(F.to_variant_object(
        F.map_filter(members, lambda k, _: ~k.isin(names))))


def query_documents(df: DataFrame, filters: dict | None = None,
                    projection: dict[str, int] | None = None, limit: int = 50,
                    after: str | None = None, doc: str = "doc") -> DataFrame:
    """One page of documents by ``_id``; ``after`` is the last ``_id`` of the page before."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    found = df.where(document_filter(df, filters or {}, doc))
    if after is not None:
        found = found.where(F.col("_id") > F.lit(after))
    page = found.orderBy("_id").limit(limit)
    return page.select(*document_projection(page, projection or {}, doc))


def next_after(page: DataFrame, limit: int) -> str | None:
    """The cursor of the next page, None after a page that is not full."""
    row = page.agg(F.count("*").alias("n"), F.max("_id").alias("last")).first()
    return row["last"] if row["n"] == limit else None
