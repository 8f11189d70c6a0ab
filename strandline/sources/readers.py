"""Raw events into DataFrames: JSON lines, records in memory, and IPFIX flow messages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: IPFIX information elements that get a name.
IPFIX_NAMES = {"4": "protocol", "12": "dest_ip", "56": "source_mac", "182": "source_port", "183": "dest_port", "150": "timestamp"}

Processor = Callable[[DataFrame], DataFrame]


def _column_type(described: str) -> str:
    """A type as values of mixed JSON describe themselves, as one of columns: no decimals, and text where only nulls were seen."""
    out = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", described)
    return out.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")


def _ddl(t: T.DataType) -> str:
    """A type as text, with names quoted."""
    if isinstance(t, T.StructType):
        return f"struct<{','.join(f'{_quoted(f.name)}:{_ddl(f.dataType)}' for f in t)}>"
    if isinstance(t, T.ArrayType):
        return f"array<{_ddl(t.elementType)}>"
    return f"map<{_ddl(t.keyType)},{_ddl(t.valueType)}>" if isinstance(t, T.MapType) else t.simpleString()


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _attribute(name: str, t: T.DataType) -> Column:
    """One attribute of ``_object`` as a type, null where it is missing or is not of it."""
    if "'" not in name:
        return F.try_variant_get("_object", f"$['{name}']", _ddl(t))
    return F.try_variant_get(F.try_element_at(F.col("_object").try_cast("map<string,variant>"), F.lit(name)), "$", _ddl(t))


def _objects(lines: DataFrame) -> DataFrame:
    """``lines`` with ``_object``, the line's JSON object; null where the line is none."""
    return lines.withColumn("_object", F.when(F.col("value").rlike(r"^\s*\{"), F.try_parse_json("value")))


def json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, lines: DataFrame | None = None) -> DataFrame:
    """One JSON object per line from any number of paths or patterns, compressed or not, in the order of reading as ``_order``.

    Lines that are no JSON object are left out (``json_rejects`` counts them), among them objects that name a key twice. No
    line is lost for the type of an attribute. With a schema a value that cannot be read as the declared type is null.
    Without one the types are found in a pass of their own, and an attribute that holds several types stays a variant,
    each value as it came. ``lines`` may give a table with the lines in ``value`` instead of paths.
    """
    raw = raw_lines(spark, paths) if lines is None else lines
    held = _objects(raw.select("value").withColumn("_order", F.monotonically_increasing_id())).filter("_object is not null")
    if schema is None:
        found = held.agg(F.schema_of_variant_agg("_object")).first()[0]
        inside = _column_type(found)[len("STRUCT<") : -1] if found and found.startswith("OBJECT") else ""
        schema = T.StructType.fromDDL(inside) if inside else T.StructType()
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = [_attribute(f.name, f.dataType).alias(f.name) for f in schema]
    return held.select(*columns, "_order")


def json_rejects(spark: SparkSession, paths: str | list[str], lines: DataFrame | None = None) -> dict[str, int]:
    """How many lines there are, and how many of them are blank or no JSON object."""
    raw = raw_lines(spark, paths) if lines is None else lines
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    r = _objects(raw.select("value")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("blank"), F.count_if(~blank & F.col("_object").isNull()).alias("no_object")).first()
    return r.asDict()


def raw_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The lines as they are, as ``value``, for processors that parse them themselves."""
    return spark.read.text(paths)


def records(spark: SparkSession, rows: Iterable[dict], schema: T.StructType | str) -> DataFrame:
    """Records at hand as a table, keys that a record lacks being null."""
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    data = [tuple(r.get(f.name) for f in shape) + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, T.StructType([*shape, T.StructField("_order", T.LongType())]))


def ipfix(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row per data set of each IPFIX message with a source MAC: the named elements as columns, the rest in ``other``.

    A message is a JSON object with ``DataSets``, lists of elements {I: number, V: value}. Elements without a name keep
    their number as key in ``other``. Data sets without a source MAC, messages without data sets, and lines that are no
    JSON object give no rows. Values come as strings; the later of two equal elements counts.
    """
    message = "struct<DataSets: array<array<struct<I: string, V: string>>>>"
    parsed = lines.select(F.from_json(F.col(value), message, {"mode": "PERMISSIVE"}).alias("m"))
    sets = parsed.select(F.explode("m.DataSets").alias("elements"))
    rows = sets.select(F.filter("elements", lambda e: e["I"].isNotNull()).alias("e"))
    numbers = {"protocol": "int", "source_port": "int", "dest_port": "int", "timestamp": "bigint"}
    last = lambda number: F.try_element_at(F.filter("e", lambda e: e["I"] == number), F.lit(-1))["V"]
    names = {name: last(number).try_cast(numbers.get(name, "string")).alias(name) for number, name in sorted(IPFIX_NAMES.items(), key=lambda x: x[1])}
    rest = F.filter("e", lambda e: ~e["I"].isin(list(IPFIX_NAMES)))
    other = F.transform(F.array_distinct(F.transform(rest, lambda e: e["I"])), lambda k: F.struct(k.alias("k"), F.try_element_at(F.filter(rest, lambda e: e["I"] == k), F.lit(-1))["V"].alias("v")))
    return rows.filter(last("56").isNotNull()).select(*names.values(), F.map_from_entries(other).alias("other"))


PROCESSORS: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = {
    "simple": lambda spark, paths: json_lines(spark, paths),
    "ipfix": lambda spark, paths: ipfix(raw_lines(spark, paths)),
}
