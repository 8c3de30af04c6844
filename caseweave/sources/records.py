"""Bug records: delimited XML files to typed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The format of the bug record files.
END_TAG = "</CDETS>"
_FIELD = "Field: ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>"
RECORD_SCHEMA = (
    f"Defect ARRAY<STRUCT<_id: STRING, {_FIELD}, "
    f"AuditTrail: ARRAY<STRUCT<_id: STRING, _defectID: STRING, {_FIELD}>>, "
    f"Notes: STRUCT<Note: ARRAY<STRUCT<_id: STRING, {_FIELD}>>>, "
    f"Files: STRUCT<File: ARRAY<STRUCT<_id: STRING, {_FIELD}>>>>>, _corrupt_record STRING"
)


def read_delimited_records(spark: SparkSession, path: str, end_tag: str = END_TAG) -> DataFrame:
    """Records of big files, each up to and with its end tag.

    The end tag is the record separator of the text source, so files stay splittable and a record may
    cross a split.
    """
    pieces = spark.read.text(path, lineSep=end_tag)
    return pieces.where(F.length(F.trim(F.regexp_replace("value", r"\s+", " "))) > 0).select(
        F.concat("value", F.lit(end_tag)).alias("record")
    )


def _parsed(records: DataFrame) -> DataFrame:
    bare = F.regexp_replace("record", r"^\s*<\?xml[^>]*\?>", "")
    xml = F.from_xml(bare, RECORD_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return (
        records.select(F.explode(F.array(xml)).alias("x"))  # below a generator the filters on x would parse the record anew each
        .where(F.col("x._corrupt_record").isNull())
        .select(F.explode("x.Defect").alias("d"))
        .select("d.*")
        .where("_id IS NOT NULL")
    )


def _fields(owner: str) -> Column:
    """All fields of the child elements of one kind, in one array."""
    nested = F.flatten(F.transform(F.col(owner), lambda e: F.coalesce(e["Field"], F.array())))
    return F.coalesce(nested, F.array())


def _value_of(fields: Column, name: str) -> Column:
    return F.try_element_at(F.filter(fields, lambda f: f["_name"] == name), F.lit(-1))["_VALUE"]


def parse_defects(records: DataFrame) -> DataFrame:
    """(defect_id, metadata): every field anywhere in the record, name → sorted distinct values.

    Records that are no valid XML drop out. It works inside each row, without a shuffle.
    """
    fields = F.concat(F.coalesce("Field", F.array()), _fields("AuditTrail"), _fields("Notes.Note"), _fields("Files.File"))
    clean = F.transform(
        fields, lambda f: F.struct(f["_name"].alias("name"), F.coalesce(F.trim(f["_VALUE"]), F.lit("")).alias("value"))
    )
    names = F.array_distinct(F.transform("fields", lambda f: f["name"]))
    entry = lambda n: F.struct(
        n, F.sort_array(F.array_distinct(F.transform(F.filter("fields", lambda f: f["name"] == n), lambda f: f["value"])))
    )
    return (
        _parsed(records)
        .select(F.col("_id").alias("defect_id"), F.filter(clean, lambda f: f["name"].isNotNull()).alias("fields"))
        .select("defect_id", F.map_from_entries(F.transform(names, entry)).alias("metadata"))
    )


def defect_direct_fields(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per name with the last value among the record's own fields."""
    columns = [F.trim(_value_of(F.col("Field"), n)).alias(n) for n in names]
    return _parsed(records).select(F.col("_id").alias("defect_id"), *columns)


def defect_audit_rows(records: DataFrame) -> DataFrame:
    """One row per audit entry with its fields as a map."""
    entries = _parsed(records).select(F.col("_id").alias("defect_id"), F.explode("AuditTrail").alias("a"))
    names = F.array_distinct(F.transform("a.Field", lambda f: f["_name"]))
    fields = F.map_from_arrays(names, F.transform(names, lambda n: F.trim(F.try_element_at(F.filter("a.Field", lambda f: f["_name"] == n), F.lit(-1))["_VALUE"])))
    return entries.select("defect_id", F.col("a._id").alias("audit_id"), fields.alias("fields"))


def defect_posts(records: DataFrame) -> DataFrame:
    """Description as the post text, each note as a comment."""
    notes = F.coalesce(F.transform("Notes.Note", lambda n: n["Field"]), F.array())
    comments = F.transform(
        F.filter(notes, lambda f: F.exists(f, lambda x: x["_name"] == "Note")),
        lambda f: F.struct(
            _value_of(f, "CreatedBy").alias("author"), _value_of(f, "CreatedOn").alias("date"), F.trim(_value_of(f, "Note")).alias("text")
        ),
    )
    return _parsed(records).select(
        F.lit("defects").alias("source"), F.col("_id").alias("post_id"),
        F.trim(_value_of(F.col("Field"), "Headline")).alias("title"),
        F.trim(_value_of(F.col("Field"), "Description")).alias("text"), comments.alias("comments"),
    )
