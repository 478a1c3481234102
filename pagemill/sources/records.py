"""Scans of raw records: JSON lines under three policies, whole files, containers, and field picking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import fallback_id, strip

# Alternative names of a record's fields, in order of preference.
TEXT_FIELDS = ("text", "content", "body", "abstract")
SUBJECT_FIELDS = ("subject", "category", "discipline", "final_subjects")
CONTAINERS = ("data", "records", "items", "documents")


def read_lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(source_file, value) of text files, compressed or not, in folders at any depth; bad UTF-8 is replaced.

    Gzip files are read whole by one task each.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("source_file"), F.make_valid_utf8("value").alias("value"))


def resolved(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files and folders that some patterns name, each once and in order; a pattern that names nothing is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found: set[str] = set()
    for pattern in patterns:
        place = path(pattern)
        hits = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
        if not hits:
            raise FileNotFoundError(pattern)
        found |= {h.getPath().toString() for h in hits}
    return sorted(found)


def strict_json(c: Column) -> Column:
    """The one JSON value of a string as a variant; null if it is malformed or anything follows the value.

    Spark's parser stops at the end of the first value, so the string is parsed inside a list and inside an object:
    what follows a value cannot close both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    alone = inside.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def as_object(record: Column) -> Column:
    """A JSON value that is no object becomes the ``text`` of one."""
    wrapped = F.try_parse_json(F.concat(F.lit('{"text":'), F.to_json(record), F.lit("}")))
    return F.when(F.schema_of_variant(record).startswith("OBJECT"), record).otherwise(wrapped)


def parsed(lines: DataFrame, line: str = "line", policy: str = "skip", file: str = "source_file", order: str = "line_no", required: str | None = None) -> DataFrame:
    """Lines with ``record`` (variant) and ``reject_reason``; blank lines are left out.

    With ``required``, a record whose field of that name is missing or empty is rejected as ``empty``.

    The policy says what a malformed line does: ``skip`` drops it, ``count`` keeps it with its reason, ``fail_file``
    drops it and the rest of its file.
    """
    rows = lines.where(strip(F.col(line)) != "").withColumn("record", strict_json(F.col(line)))
    reason = F.when(F.col("record").isNull(), "malformed")
    if required:
        reason = reason.when(F.coalesce(F.try_variant_get("record", f"$.{required}", "string"), F.lit("")) == "", "empty")
    rows = rows.withColumn("reject_reason", reason)
    if policy == "count":
        return rows
    if policy == "fail_file":
        bad = rows.where("reject_reason is not null").groupBy(file).agg(F.min(order).alias("__bad"))
        rows = rows.join(bad, file, "left").where(F.col("__bad").isNull() | (F.col(order) < F.col("__bad"))).drop("__bad")
    elif policy != "skip":
        raise ValueError(f"unknown policy {policy!r}")
    return rows.where("reject_reason is null")


def _kind(record: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(record, f"$.{field}", "variant"))


def text_field(record: Column, field: str) -> Column:
    """A string as it is, a list's elements by lines; anything else and what is empty gives null."""
    kind = _kind(record, field)
    listed = F.array_join(F.try_variant_get(record, f"$.{field}", "array<string>"), "\n", "None")
    value = F.when(kind == "STRING", F.try_variant_get(record, f"$.{field}", "string")).when(kind.startswith("ARRAY"), listed)
    return F.when(value != "", value)


def label_field(record: Column, field: str) -> Column:
    """A string, or the first element of a list."""
    kind = _kind(record, field)
    first = F.try_element_at(F.try_variant_get(record, f"$.{field}", "array<string>"), F.lit(1))
    value = F.when(kind == "STRING", F.try_variant_get(record, f"$.{field}", "string")).when(kind.startswith("ARRAY"), first)
    return F.when(value != "", value)


def picked(rows: DataFrame, record: str = "record") -> DataFrame:
    """Adds text, subject and doc_id. The id is ``id`` if the record has one, else ``doc_id``; an empty one gives way to a hash of the text."""
    v = F.col(record)
    text = F.coalesce(*[text_field(v, f) for f in TEXT_FIELDS])
    subject = F.coalesce(*[label_field(v, f) for f in SUBJECT_FIELDS], F.lit(""))
    own, other = (F.try_variant_get(v, f"$.{f}", "string") for f in ("id", "doc_id"))
    rows = rows.withColumns({"text": F.coalesce(text, F.lit("")), "subject": subject, "__id": F.coalesce(own, other, F.lit(""))})
    return rows.withColumn("doc_id", F.when(F.col("__id") != "", F.col("__id")).otherwise(fallback_id(F.col("text")))).drop("__id")


def nested_field(record: Column, *paths: str) -> Column:
    """The first of some dotted paths that is there and not blank, whatever its type, as a string."""
    values = [F.try_variant_get(record, "$." + p, "string") for p in paths]
    return F.coalesce(*[F.when(strip(x) != "", x) for x in values])


def exploded(spark: SparkSession, path: str) -> DataFrame:
    """Records of whole-file JSON: a list's elements, those of the first container that holds a list, or the value itself."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("source_file"), F.try_parse_json("value").alias("v"))
    lists = [F.when(_kind(F.col("v"), c).startswith("ARRAY"), F.try_variant_get(F.col("v"), f"$.{c}", "array<variant>")) for c in CONTAINERS]
    top = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get(F.col("v"), "$", "array<variant>"))
    return whole.where("v is not null").select("source_file", F.posexplode(F.coalesce(top, *lists, F.array("v"))).alias("record_index", "record"))


def row_at(df: DataFrame, order: str, k: int) -> DataFrame:
    """The k-th row by an order column, from the end if negative."""
    key = F.asc(order) if k >= 0 else F.desc(order)
    return df.orderBy(key).offset(k if k >= 0 else -k - 1).limit(1)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    from pagemill.schemas import CHAT

    return spark.read.schema(CHAT).json(path)


def estimated_rows(spark: SparkSession, path: str, sample_bytes: int = 4 << 20) -> int:
    """Rows of uncompressed text: the line ends in the first ``sample_bytes`` of its first file, carried on to the size of all.

    Exact for one file within the sample; an estimate for planning beyond it.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length").orderBy("path")
    total = files.agg(F.sum("length")).first()[0] or 0
    head = files.first()
    if head is None:
        return 0
    place = jvm.org.apache.hadoop.fs.Path(head["path"])
    stream = place.getFileSystem(conf).open(place)
    try:
        sample = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(int(head["length"]), sample_bytes)))
    finally:
        stream.close()
    return round(sample.count(b"\n") / len(sample) * total)
