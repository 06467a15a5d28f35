"""Columns of a file to the four fields: by alias, or by meaning with a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("id", "lat", "lon", "orders")
# Header names that are known.
ALIASES = {
    "id": "id", "name": "id", "neighborhood": "id", "neighbourhood": "id", "area": "id", "zone": "id", "locality": "id", "region": "id", "ward": "id",
    "lat": "lat", "latitude": "lat", "y": "lat", "ycoord": "lat",
    "lon": "lon", "lng": "lon", "long": "lon", "longitude": "lon", "x": "lon", "xcoord": "lon",
    "orders": "orders", "order": "orders", "demand": "orders", "weight": "orders", "volume": "orders", "dailyorders": "orders", "deliveries": "orders", "parcels": "orders", "shipments": "orders",
}
#: Largest weight of a column's own values, share of numbers that makes it numeric, least score of a match.
NUDGE, NUMERIC, LEAST_SCORE = 0.12, 0.9, 0.15


def clean_key(header: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(header, F.lit("")))), r"[\s_\-.]", "")


def canonical(header: Column) -> Column:
    """The field that a header's alias names, null if none does."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), clean_key(header))


def alias_mapping(headers: DataFrame) -> DataFrame:
    """(source_column, field, confidence, method) of ``headers(col_ord, header)``; the first column of a field wins."""
    first = Window.partitionBy("field").orderBy("col_ord")
    named = headers.withColumn("field", canonical(F.col("header"))).where("field IS NOT NULL").withColumn("_n", F.row_number().over(first))
    return named.where("_n = 1").select("col_ord", F.col("header").alias("source_column"), "field", F.lit(1.0).alias("confidence"), F.lit("alias").alias("method"))


def missing_fields(spark: SparkSession, mapping: DataFrame) -> DataFrame:
    """Required fields that nothing is mapped to."""
    needed = spark.createDataFrame([(i, f) for i, f in enumerate(FIELDS)], "field_ord int, field string")
    return needed.join(mapping.select("field"), "field", "left_anti")


def value_evidence(samples: DataFrame) -> DataFrame:
    """(col_ord, n, numeric_share, low, high, whole) of ``samples(col_ord, value)``, blanks left out."""
    v = F.trim("value")
    number = F.expr("try_cast(replace(trim(value), ',', '') AS double)")
    return samples.where(v != "").withColumn("_x", number).groupBy("col_ord").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("_x").isNotNull().cast("double")).alias("numeric_share"), F.min("_x").alias("low"), F.max("_x").alias("high"), F.bool_and(F.col("_x") == F.floor("_x")).alias("whole")
    )


def value_prior() -> Column:
    """Evidence of a column's values for ``field``: within NUDGE of zero, so that it breaks ties and no more."""
    numeric = (F.coalesce("numeric_share", F.lit(0.0)) >= NUMERIC) & F.col("low").isNotNull()
    lat = F.when((F.col("low") < -90) | (F.col("high") > 90), -NUDGE).when(~F.col("whole") & (F.abs("high") <= 90), NUDGE).otherwise(0.02)
    lon = F.when((F.col("low") < -180) | (F.col("high") > 180), -NUDGE).when(~F.col("whole") & (F.abs("high") > 90), NUDGE).when(~F.col("whole"), 0.06).otherwise(0.02)
    orders = F.when(F.col("low") < 0, -NUDGE).when(F.col("whole"), NUDGE).otherwise(-0.04)
    by_field = F.when(~numeric, -NUDGE).when(F.col("field") == "lat", lat).when(F.col("field") == "lon", lon).otherwise(orders)
    text = F.when(F.col("numeric_share") > NUMERIC, -NUDGE).otherwise(0.1)
    return F.when(F.col("n").isNull(), 0.0).when(F.col("field") == "id", text).otherwise(by_field)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score_matrix(fields: DataFrame, headers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(field_ord, field, col_ord, header, score) of ``fields(field_ord, field, vector)`` and ``headers(col_ord, header, vector)``: four fields times the columns of one file."""
    pairs = F.broadcast(fields.withColumnRenamed("vector", "_f")).crossJoin(headers.withColumnRenamed("vector", "_h")).join(evidence, "col_ord", "left")
    return pairs.withColumn("score", cosine(F.col("_f"), F.col("_h")) + value_prior()).select("field_ord", "field", "col_ord", "header", "score")


def greedy_pairs(scores: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """One column a field and one field a column, best scores first; a fold over the matrix of one file."""
    ranked = scores.where(F.col("score") >= least).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "field_ord", "col_ord", "field", "header"))).alias("all"))
    none = F.expr("CAST(array() AS array<struct<neg:double,field_ord:int,col_ord:int,field:string,header:string>>)")
    free = lambda done, x: ~F.exists(done, lambda d: (d["field_ord"] == x["field_ord"]) | (d["col_ord"] == x["col_ord"]))
    folded = F.aggregate("all", none, lambda done, x: F.when(free(done, x), F.concat(done, F.array(x))).otherwise(done))
    return ranked.select(F.explode(folded).alias("m")).select("m.col_ord", F.col("m.header").alias("source_column"), "m.field", F.round(-F.col("m.neg"), 6).alias("confidence"), F.lit("semantic").alias("method"))


Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
# What each field means, for the embedder.
PROMPTS = {"id": "name of an area, neighbourhood or zone", "lat": "latitude, y coordinate, north-south position", "lon": "longitude, x coordinate, east-west position", "orders": "number of orders, parcels or deliveries per day"}


def map_columns(spark: SparkSession, headers: Sequence[str], rows: Sequence[Sequence[str]] = (), embed: Embedder | None = None) -> DataFrame:
    """Mapping of a file's headers; without an embedder, or if it fails, by alias alone.

    With one, fields that no column means closely enough are filled by alias from columns left over.
    """
    numbered = [(i, h) for i, h in enumerate(headers) if h is not None and h.strip()]
    frame = spark.createDataFrame(numbered, "col_ord int, header string")
    if embed is None or not numbered:
        return alias_mapping(frame)
    try:
        vectors = [list(map(float, v)) for v in embed([*PROMPTS.values(), *(h for _, h in numbered)])]
    except Exception:  # any failure of the model leaves the aliases
        return alias_mapping(frame)
    fields = spark.createDataFrame([(i, f, vectors[i]) for i, f in enumerate(FIELDS)], "field_ord int, field string, vector array<double>")
    named = spark.createDataFrame([(i, h, v) for (i, h), v in zip(numbered, vectors[len(FIELDS) :], strict=True)], "col_ord int, header string, vector array<double>")
    cells = [(i, row[i]) for row in rows for i, _ in numbered if i < len(row)]
    evidence = value_evidence(spark.createDataFrame(cells, "col_ord int, value string"))
    meant = greedy_pairs(score_matrix(fields, named, evidence))
    filled = alias_mapping(frame).join(meant.select("field"), "field", "left_anti").join(meant.select("col_ord"), "col_ord", "left_anti")
    return meant.unionByName(filled.select(meant.columns))
