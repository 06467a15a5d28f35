"""Files and rows to points: delimiter, quoting, coercion, validation. Every bad row is reported, none is lost."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from depotry.operators.mapping import FIELDS, Embedder, alias_mapping, map_columns
from depotry.operators.scan import prefix_sums
from depotry.schema import POINTS, RANGES, SCENARIOS, TRAFFIC, VEHICLES

DELIMITERS = (",", ";", "\t", "|")


def delimiter(header: Column) -> Column:
    """The delimiter that cuts a header line into most pieces, the first of equals."""
    counts = [F.struct(F.size(F.split(header, f"[{d}]")).alias("pieces"), F.lit(-i).alias("rank"), F.lit(d).alias("sep")) for i, d in enumerate(DELIMITERS)]
    return F.array_max(F.array(*counts))["sep"]


def peek(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """(headers, delimiter) of a file, from its first line that is not blank."""
    lines = spark.read.text(path).where(F.trim("value") != "").limit(1)
    row = lines.select(F.regexp_replace("value", "^﻿", "").alias("line")).select("line", delimiter(F.col("line")).alias("sep")).first()
    if row is None:
        return [], ","
    cells = spark.createDataFrame([(row["line"],)], "line string").select(F.from_csv("line", ", ".join(f"_{i} string" for i in range(row["line"].count(row["sep"]) + 1)), {"sep": row["sep"], "escape": '"'}).alias("c")).first()["c"]
    return [(c or "").strip() for c in cells], row["sep"]


def to_float(raw: Column) -> Column:
    """Number of a text: degree signs out, one comma without a point is a decimal comma, others part thousands; null if none."""
    text = F.regexp_replace(F.trim(raw), "°", "")
    single = (F.size(F.split(text, ",")) == 2) & ~F.contains(text, F.lit("."))
    return _finite(F.when(single, F.replace(text, F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit(""))))


def _finite(text: Column) -> Column:
    plain = text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    return F.when(plain, text.try_cast("double"))


def to_int(raw: Column) -> Column:
    """Number of a text with separators ``,`` and ``_`` out; hexadecimal is read too. Whether it is whole is the caller's test."""
    text = F.regexp_replace(F.trim(raw), "[,_]", "")
    sixteen = F.conv(F.substring(text, 3, 20), 16, 10).cast("double")
    return F.when(text.rlike("^0[xX][0-9a-fA-F]{1,13}$"), sixteen).otherwise(_finite(text))


def coerce(raw: DataFrame) -> DataFrame:
    """``raw(dataset, line_no, id, lat, lon, orders)`` of texts with typed values and ``errors``; blank rows drop out."""
    # The sentences of errors, which users of such files read.
    where = F.concat(F.lit("Row "), F.col("line_no").cast("string"))

    def said(field: str, text: str) -> Column:
        return F.concat(where, F.lit(f": '{field}' {text}"))

    def problem(field: str, value: Column | None) -> Column:
        blank = F.when(F.col(field).isNull(), said(field, "is missing.")).when(F.trim(field) == "", said(field, "is empty."))
        if value is None:
            return blank
        return blank.when(value.isNull(), F.concat(said(field, 'is not a number (got "'), F.col(field), F.lit('").')))

    lat, lon, orders = to_float(F.col("lat")), to_float(F.col("lon")), to_int(F.col("orders"))
    whole = F.coalesce(problem("orders", orders), F.when(orders != F.floor(orders), F.concat(said("orders", 'must be a whole number of orders (got "'), F.col("orders"), F.lit('").'))))
    rows = raw.where(F.trim(F.concat_ws("", *FIELDS)) != "")
    errors = F.array_compact(F.array(problem("id", None), problem("lat", lat), problem("lon", lon), whole))
    return rows.select("dataset", "line_no", F.trim("id").alias("id"), lat.alias("lat"), lon.alias("lon"), orders.try_cast("bigint").alias("orders"), errors.alias("errors"))


def good_and_bad(coerced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, errors)."""
    good = coerced.where(F.size("errors") == 0).select("dataset", F.col("line_no").cast("long").alias("ord"), "id", "lat", "lon", "orders")
    return good, coerced.where(F.size("errors") > 0).select("dataset", "line_no", F.explode("errors").alias("error"))


def validate(points: DataFrame) -> DataFrame:
    """(dataset, ord, error) for every rule that a point breaks: id, ranges, whole orders, ids only once."""
    same = Window.partitionBy("dataset", "id")
    marked = points.withColumn("_first", F.min("ord").over(same))
    rules = [
        (F.col("id").isNull() | (F.trim("id") == ""), F.lit("id is blank")),
        (F.col("id").isNotNull() & (F.col("_first") < F.col("ord")), F.concat(F.lit("id repeats row "), F.col("_first").cast("string"))),
        (~F.coalesce(F.col("lat").between(-90, 90), F.lit(False)), F.lit("lat is not in -90..90")),
        (~F.coalesce(F.col("lon").between(-180, 180), F.lit(False)), F.lit("lon is not in -180..180")),
        (~F.coalesce((F.col("orders") >= 0) & (F.col("orders").cast("double") < float("inf")), F.lit(False)), F.lit("orders is not a whole number of 0 or more")),
    ]
    found = F.array_compact(F.array(*(F.when(broken, text) for broken, text in rules)))
    return marked.select("dataset", "ord", F.explode(found).alias("error"))


def repeated_ids(points: DataFrame) -> DataFrame:
    """Points whose id a point before them has, with the ``ord`` of the ``first``."""
    return points.withColumn("first", F.min("ord").over(Window.partitionBy("dataset", "id"))).where("id IS NOT NULL AND first < ord")


def _real(x: object) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def check(points: DataFrame, k: int, constraints: dict | None = None) -> None:
    """Raise for an empty data set, a bad K, columns that hold no numbers, constraints that are not known or any broken rule."""
    for name in ("lat", "lon", "orders"):
        if not isinstance(points.schema[name].dataType, NumericType):
            raise ValueError(f"{name} is no column of numbers")
    rules = {"capacity": lambda x: x > 0, "max_radius_km": lambda x: x >= 0}
    for name, value in (constraints or {}).items():
        if name not in rules:
            raise ValueError(f"constraint {name!r} is not one of {', '.join(rules)}")
        if value is not None and not (_real(value) and rules[name](value)):
            raise ValueError(f"constraint {name} must be a number {'above' if name == 'capacity' else 'of at least'} 0")
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("K must be a whole number of at least 1")
    if points.limit(1).count() == 0:
        raise ValueError("there are no points")
    if bad := validate(points).orderBy("dataset", "ord").limit(3).collect():
        raise ValueError("; ".join(f"{r['dataset']} row {r['ord']}: {r['error']}" for r in bad))


def read_csv(spark: SparkSession, path: str, dataset: str = "upload", mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, errors) of a CSV file; columns by ``mapping`` (source_column, field) or by alias."""
    headers, sep = peek(spark, path)
    if mapping is None:
        mapping = alias_mapping(spark.createDataFrame(list(enumerate(headers)), "col_ord int, header string"))
    at = {r["field"]: r["col_ord"] for r in mapping.collect()}  # four rows at most
    if lost := [f for f in FIELDS if f not in at]:
        return spark.createDataFrame([], POINTS), spark.createDataFrame([(dataset, 1, f"No column for: {', '.join(lost)}.")], "dataset string, line_no long, error string")
    lines = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("enforceSchema", True).schema(", ".join(f"_{i} string" for i in range(len(headers)))).csv(path)
    numbered = lines.withColumn("_n", F.monotonically_increasing_id())
    # A line's number in its file: a quoted file is one task, so its ids are its order.
    raw = numbered.select(F.lit(dataset).alias("dataset"), (F.col("_n") + 2).alias("line_no"), *(F.trim(f"_{at[f]}").alias(f) for f in FIELDS))
    return good_and_bad(coerce(raw))


def read_folder(spark: SparkSession, path: str, dataset: str = "upload", mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, errors) of a folder of CSV files with one header, each file read in as many parts as it has blocks.

    Lines are cut before quotes are read, so a value holds no line break. Every line equal to the
    header is one. Rows keep the number of their line in their file, headers and blank lines
    counted; ``ord`` is the number over all files in the order of their names.
    """
    headers, sep = peek(spark, path)
    if mapping is None:
        mapping = alias_mapping(spark.createDataFrame(list(enumerate(headers)), "col_ord int, header string"))
    at = {r["field"]: r["col_ord"] for r in mapping.collect()}  # four rows at most
    if lost := [f for f in FIELDS if f not in at]:
        return spark.createDataFrame([], POINTS), spark.createDataFrame([(dataset, 1, f"No column for: {', '.join(lost)}.")], "dataset string, line_no long, error string")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_id", F.monotonically_increasing_id())
    numbered = prefix_sums(lines, ["_file"], ["_block", "_id"], {"line_no": F.lit(1).cast("long")})
    files = numbered.groupBy("_file").agg(F.max("line_no").alias("_n"))
    before = files.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a file
    cells = F.from_csv("value", ", ".join(f"_{i} string" for i in range(len(headers))), {"sep": sep, "quote": '"', "escape": '"'})
    line = F.regexp_replace("value", "^\ufeff", "")
    named = numbered.where(F.trim("value") != "").withColumn("_c", cells).where(~_is_header(line, headers, sep)).join(before, "_file")
    raw = named.select(F.lit(dataset).alias("dataset"), (F.col("_before") + F.col("line_no")).alias("line_no"), *(F.trim(F.col(f"_c._{at[f]}")).alias(f) for f in FIELDS))
    return good_and_bad(coerce(raw))


def _is_header(line: Column, headers: list[str], sep: str) -> Column:
    cells = F.from_csv(line, ", ".join(f"_{i} string" for i in range(len(headers))), {"sep": sep, "quote": '"', "escape": '"'})
    return F.coalesce(F.concat_ws("\x1f", *(F.trim(F.coalesce(cells[f"_{i}"], F.lit(""))) for i in range(len(headers)))) == F.lit("\x1f".join(headers)), F.lit(False))


def read_rows(spark: SparkSession, rows: list[dict], dataset: str = "table") -> tuple[DataFrame, DataFrame]:
    """(points, errors) of row objects; keys by alias, the first value of a field wins."""
    from depotry.operators.mapping import ALIASES

    out = []
    for i, row in enumerate(rows):
        found: dict[str, str] = {}
        for key, value in row.items():
            field = ALIASES.get("".join(c for c in str(key).strip().lower() if c not in "_-." and not c.isspace()))
            if field and field not in found and value is not None:
                found[field] = str(value)
        out.append((dataset, i + 1, *(found.get(f) for f in FIELDS)))
    return good_and_bad(coerce(spark.createDataFrame(out, "dataset string, line_no long, id string, lat string, lon string, orders string")))


def read_lines(spark: SparkSession, text: str, dataset: str = "text") -> tuple[DataFrame, DataFrame]:
    """(points, errors) of a CSV text."""
    import csv
    import io

    lines = [x for x in text.removeprefix("﻿").splitlines() if x.strip()]
    sep = max(DELIMITERS, key=lambda d: (len(lines[0].split(d)), -DELIMITERS.index(d))) if lines else ","
    return read_rows(spark, [dict(zip(map(str.strip, head), row, strict=False)) for head, *body in [list(csv.reader(io.StringIO("\n".join(lines)), delimiter=sep))] for row in body] if lines else [], dataset)


def decode_link(links: DataFrame) -> DataFrame:
    """Settings of ``links(link)`` (``a=b&c=d``), each null unless in range or in the catalogues."""
    m = F.str_to_map(F.regexp_replace("link", "^#", ""), F.lit("&"), F.lit("="))

    def number(key: str) -> Column:
        low, high = RANGES[key]
        value = F.try_element_at(m, F.lit(key)).try_cast("double")
        return F.when(value.between(low, high), value)

    def known(key: str, names: tuple[str, ...]) -> Column:
        value = F.try_element_at(m, F.lit(key))
        return F.when(value.isin(*names), value)

    return links.select("link", F.try_element_at(m, F.lit("s")).alias("sample"), number("k").alias("k"), known("v", tuple(v[0] for v in VEHICLES)).alias("vehicle"), known("t", tuple(t[0] for t in TRAFFIC)).alias("traffic"), number("f").alias("fuel_price"), number("w").alias("driver_wage"), number("r").alias("rent"), number("cap").alias("capacity"), number("rad").alias("max_radius"), known("sc", tuple(s[0] for s in SCENARIOS)).alias("scenario"), (F.try_element_at(m, F.lit("run")) == "1").alias("run"))


def ingest(spark: SparkSession, path: str, dataset: str = "upload", embed: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, errors) of an unfamiliar file: headers mapped by meaning where an embedder is given, rows read, rules checked."""
    headers, sep = peek(spark, path)
    head = spark.read.text(path).where(F.trim("value") != "").limit(9)
    cells = F.from_csv("value", ", ".join(f"_{i} string" for i in range(len(headers))), {"sep": sep, "escape": '"'})
    rows = [[x or "" for x in r["c"]] for r in head.select(cells.alias("c")).collect()[1:]] if headers else []  # eight sample rows
    good, bad = read_csv(spark, path, dataset, map_columns(spark, headers, rows, embed))
    broken = validate(good)
    said = broken.select("dataset", F.col("ord").alias("line_no"), F.concat(F.lit("Row "), F.col("ord").cast("string"), F.lit(": "), "error").alias("error"))
    return good.join(broken.select("dataset", "ord").distinct(), ["dataset", "ord"], "left_anti"), bad.unionByName(said)


def read_json_plans(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(dataset, k, objective, wh_ord, wh_id, lat, lon) of ``lines(dataset, json)``, one plan a document."""
    kind = "k int, objective double, sites array<struct<wh_ord int, wh_id string, lat double, lon double>>"
    return lines.select("dataset", F.from_json("json", kind).alias("p")).select("dataset", "p.k", "p.objective", F.inline("p.sites"))
