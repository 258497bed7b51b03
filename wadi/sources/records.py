"""Result records as JSON: a unit with its items in one document, and back to rows.

Items stand in the order of their place. Nulls are left out of the JSON and come back as
nulls; fields that a reader does not know are ignored, missing ones are null. A document
that cannot be read gives no rows, and is told by ``broken``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_records(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(record): a JSON document for each key, with the other columns of its rows as ``items``; a unit's rows come together."""
    item = F.struct(place, *[c for c in rows.columns if c not in (*keys, place)])
    # by place alone: other fields need not have an order
    by_place = lambda a, b: F.when(a[place] < b[place], -1).when(a[place] > b[place], 1).otherwise(0)
    units = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item), by_place).alias("items"))
    return units.select(F.to_json(F.struct(*keys, "items")).alias("record"))


def record_schema(rows: DataFrame, keys: list[str], place: str) -> T.StructType:
    """The schema of the documents that ``write_records`` makes of such rows."""
    of = {f.name: f.dataType for f in rows.schema}
    items = T.StructType([T.StructField(c, of[c]) for c in (place, *(c for c in rows.columns if c not in (*keys, place)))])
    return T.StructType([*(T.StructField(k, of[k]) for k in keys), T.StructField("items", T.ArrayType(items))])


def broken(record: Column, schema: T.StructType) -> Column:
    """Whether a document cannot be read; null is none."""
    kept = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return F.from_json(record, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()


def read_records(records: DataFrame, schema: T.StructType, record: str = "record") -> DataFrame:
    """The rows of JSON documents: the keys and the fields of each item."""
    parsed = records.select(F.from_json(record, schema).alias("r")).select("r.*")
    return parsed.select(*[c for c in schema.names if c != "items"], F.inline("items"))
