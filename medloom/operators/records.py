"""Typed records: a model's entries checked against a catalogue's fields and parsed into nested columns.

An entry is ``{category: {field: value, ...}}`` in a JSON list.  ``checked`` looks at every entry once and says what is wrong with
it; ``typed`` makes the table of one category from the entries without fault, ``refused`` the quarantine of the others with reasons.
All of it is done within an entry's row: fields meet their rules in a broadcast table with one row for each category of the
catalogue, so nothing is shuffled and no list of fields reaches the plan.

Defined results: a null answer has no entries; an answer that is no JSON list is refused whole (``entry_no`` null); null and
empty values are missing values; of an answer that repeats a key within an object nothing is read (no list).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom.ontology.catalog import Category, Item

_SCALARS = {"date": T.DateType(), "number": T.DoubleType(), "float": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}
_RULE = "type: string, many: boolean, required: boolean, allowed: array<string>"
_RULES = f"category string, fields map<string, struct<{_RULE}, items: map<string, struct<{_RULE}>>>>"
_PATTERNS = {"date": r"^\d{4}-\d{2}-\d{2}$", "number": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$", "integer": r"^[+-]?\d{1,18}(\.0*)?$", "boolean": "(?i)^(true|false)$"}
_PATTERNS["float"] = _PATTERNS["number"]


def _kind(item: Item) -> str:
    return "object" if item.items else item.type if item.type in _SCALARS else "string"


def _many(item: Item) -> bool:
    return item.repeatable or item.type == "array"


def field_type(item: Item) -> T.DataType:
    """The column type of a field: arrays of repeatable ones, structs of objects."""
    one = T.StructType([T.StructField(i.id, field_type(i)) for i in item.items]) if item.items else _SCALARS.get(item.type, T.StringType())
    return T.ArrayType(one) if _many(item) else one


def record_type(category: Category) -> T.StructType:
    return T.StructType([T.StructField(i.id, field_type(i)) for i in category.items])


def _rule(item: Item, nested: bool) -> tuple:
    if nested and item.items:
        raise ValueError(f"{item.id}: objects within objects have no objects here")
    rule = (_kind(item), _many(item), item.required, list(item.values))
    return rule if nested else (*rule, {i.id: _rule(i, True) for i in item.items})


def _seen(value: Column) -> Column:
    """A JSON value with its shape and its text, both taken once."""
    return F.struct(value.alias("value"), F.schema_of_variant(value).alias("shape"), F.trim(F.try_variant_get(value, "$", "string")).alias("text"))


def _is(seen: Column, shape: str) -> Column:
    return F.coalesce(seen["shape"].startswith(shape), F.lit(False))


def _missing(seen: Column) -> Column:
    """Null, JSON's null, or an empty text."""
    return seen["shape"].isNull() | (seen["shape"] == "VOID") | F.coalesce(seen["text"] == "", F.lit(False))


def _elements(value: Column) -> Column:
    return F.transform(F.try_variant_get(value, "$", "array<variant>"), _seen)


def _fields(value: Column) -> Column:
    return F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda _, v: _seen(v))


def _none() -> Column:
    return F.array().cast("array<string>")


def _said(name: Column, what: str) -> Column:
    return F.array(F.concat(name, F.lit(f": {what}")))


def _one_fault(name: Column, value: Column, rule: Column, nested: bool) -> Column:
    """Faults of one value of a field."""
    scalar = F.when(_is(value, "OBJECT") | _is(value, "ARRAY"), _said(name, "no single value"))
    for kind, pattern in _PATTERNS.items():
        bad = ~value["text"].rlike(pattern)
        if kind == "date":
            bad = bad | F.try_to_date(value["text"], "yyyy-MM-dd").isNull()
        scalar = scalar.when((rule["type"] == kind) & bad, _said(name, f"no {kind}"))
    scalar = scalar.when((F.size(rule["allowed"]) > 0) & ~F.array_contains(rule["allowed"], value["text"]), _said(name, "not an allowed value")).otherwise(_none())
    if nested:
        return F.when(_missing(value), _none()).otherwise(scalar)
    inner = F.when(_is(value, "OBJECT"), _faults(_fields(value["value"]), rule["items"], F.concat(name, F.lit(".")), True)).otherwise(_said(name, "no object"))
    return F.when(_missing(value), _none()).when(rule["type"] == "object", inner).otherwise(scalar)


def _fault(name: Column, value: Column, rule: Column, nested: bool) -> Column:
    """Faults of a field, whether it holds one value or a list."""
    values = F.when(_is(value, "ARRAY"), _elements(value["value"])).otherwise(F.array(value))
    each = F.array_distinct(F.flatten(F.transform(values, lambda y: _one_fault(name, y, rule, nested))))
    return F.when(rule.isNull(), _said(name, "unknown field")).when(_is(value, "ARRAY") & ~rule["many"], _said(name, "one value expected")).otherwise(each)


def _faults(fields: Column, rules: Column, before: Column, nested: bool) -> Column:
    """Faults of an object's fields, then the required ones that it lacks."""
    found = F.flatten(F.transform(F.map_entries(fields), lambda x: _fault(F.concat(before, x["key"]), x["value"], F.try_element_at(rules, x["key"]), nested)))
    lacking = F.filter(F.map_entries(rules), lambda r: r["value"]["required"] & _missing(F.try_element_at(fields, r["key"])))
    return F.concat(F.array_sort(found), F.array_sort(F.transform(lacking, lambda r: F.concat(before, r["key"], F.lit(": missing")))))


def checked(extractions: DataFrame, categories: Iterable[Category], pid: str = "patient_id", column: str = "extraction") -> DataFrame:
    """(patient, entry_no, category, entry, fields, faults) of every entry; ``faults`` is empty for good ones.

    Of categories named twice (for several cancer types) the fields are united, the last rule of a field counts.
    """
    spark = extractions.sparkSession
    rules: dict[str, dict[str, tuple]] = {}
    for c in categories:
        rules.setdefault(c.id, {}).update({i.id: _rule(i, False) for i in c.items})
    known = spark.createDataFrame(list(rules.items()), _RULES)
    answers = extractions.where(F.col(column).isNotNull()).select(F.col(pid).alias("_p"), F.col(column).alias("_t"), F.try_parse_json(F.col(column)).alias("_v"))
    answers = answers.withColumn("_v", F.when(F.schema_of_variant("_v").startswith("ARRAY"), F.col("_v")))
    entries = spark.sql("SELECT t.*, e.pos AS entry_no, e.value AS _e FROM {rows} AS t, LATERAL variant_explode_outer(t._v) AS e", rows=answers).where("_v IS NULL OR entry_no IS NOT NULL")
    entries = entries.withColumn("_m", F.when(F.schema_of_variant("_e").startswith("OBJECT"), F.map_entries(F.try_variant_get("_e", "$", "map<string,variant>"))))
    named = entries.withColumn("_single", F.coalesce(F.size("_m") == 1, F.lit(False))).withColumn("category", F.when(F.col("_single"), F.col("_m")[0]["key"])).withColumn("_a", F.when(F.col("_single"), F.col("_m")[0]["value"]))
    joined = named.join(F.broadcast(known.withColumnRenamed("fields", "_rules")), "category", "left").withColumn("fields", F.when(F.schema_of_variant("_a").startswith("OBJECT"), _fields(F.col("_a"))))
    say = lambda what: F.array(F.lit(what))
    faults = (
        F.when(F.col("_v").isNull(), say("no list"))
        .when(~F.col("_single"), say("no single-key object"))
        .when(F.col("_rules").isNull(), say("unknown category"))
        .when(F.col("fields").isNull(), say("no fields"))
        .otherwise(_faults(F.col("fields"), F.col("_rules"), F.lit(""), False))
    )
    text = F.when(F.col("_v").isNull(), F.col("_t")).otherwise(F.to_json("_e"))
    return joined.select(F.col("_p").alias(pid), "entry_no", "category", text.alias("entry"), "fields", faults.alias("faults"))


def refused(entries: DataFrame) -> DataFrame:
    """The quarantine: entries with faults, as text, and their reasons."""
    return entries.where(F.size("faults") > 0).drop("fields").withColumnRenamed("faults", "reasons")


def _value(value: Column, item: Item) -> Column:
    text = F.nullif(value["text"], F.lit(""))
    if item.items:
        inner = _fields(value["value"])
        return F.when(_is(value, "OBJECT"), F.struct(*[_column(inner, i).alias(i.id) for i in item.items]))
    if item.type == "date":
        return F.try_to_date(text, "yyyy-MM-dd")
    if item.type == "integer":
        return F.regexp_replace(text, r"\.0*$", "").try_cast("bigint")
    return text.try_cast(field_type(item) if not _many(item) else field_type(item).elementType)


def _column(fields: Column, item: Item) -> Column:
    value = F.try_element_at(fields, F.lit(item.id))
    if not _many(item):
        return _value(value, item)
    listed = F.when(_is(value, "ARRAY"), _elements(value["value"])).otherwise(F.array(value))
    return F.when(~_missing(value), F.filter(F.transform(listed, lambda y: _value(y, item)), lambda y: y.isNotNull()))


def typed(entries: DataFrame, category: Category, pid: str = "patient_id") -> DataFrame:
    """The entries of a category without fault: (patient, entry_no) and a column of ``field_type`` for each field."""
    good = entries.where((F.col("category") == category.id) & (F.size("faults") == 0))
    return good.select(pid, "entry_no", *[_column(F.col("fields"), i).alias(i.id) for i in category.items])
