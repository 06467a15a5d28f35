"""Reading, coercing, validating, mapping and writing points."""

import json

import pytest
from pyspark.sql import functions as F

from depotry.operators import assign, mapping
from depotry.plans import whatif
from depotry.schema import Config
from depotry.sources import export, points
from depotry.sources.samples import BENGALURU_12, MESSY_CSV, sample


def test_round_trip(spark, tmp_path):
    rows = sample(spark, "bengaluru_8").select("id", "lat", "lon", "orders")
    export.write_csv(rows.coalesce(1), str(tmp_path / "out"))
    good, bad = points.read_csv(spark, str(tmp_path / "out"))
    assert bad.count() == 0
    assert sorted((r["id"], r["lat"], r["lon"], r["orders"]) for r in good.collect()) == sorted(BENGALURU_12[:8])


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters_quotes_and_bad_rows(spark, tmp_path, sep):
    head = sep.join(["﻿Locality", "Latitude", "Longitude", "Deliveries"])
    body = [f'"A ""one""{sep} x"', "12.9", "77.6", "5"], ["B", "north", "77.6", "5"], ["", "", "", ""], ["C", "13.0°", "77.7", "12.0"]
    path = tmp_path / "in.csv"
    path.write_text("\n".join([head, *(sep.join(r) for r in body)]) + "\n")
    good, bad = points.read_csv(spark, str(path))
    got = {r["id"]: r for r in good.collect()}
    assert set(got) == {f'A "one"{sep} x', "C"}
    assert (got["C"]["lat"], got["C"]["orders"]) == (13.0, 12)
    assert [r["error"] for r in bad.collect()] == ["Row 3: 'lat' is not a number (got \"north\")."]


@pytest.mark.parametrize(("text", "number"), [("12,97", 12.97), ("1,234.5", 1234.5), ("1,2,3", 123.0), (" 12.5° ", 12.5), ("1e3", 1000.0), ("x", None), ("", None), ("NaN", None), ("Infinity", None), ("-7", -7.0)])
def test_floats(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(points.to_float(F.col("t")).alias("x")).first()["x"] == number


@pytest.mark.parametrize(("text", "number"), [("1,234", 1234), ("1_000", 1000), ("12.0", 12), ("1e3", 1000), ("0x10", 16), ("3.5", 3.5), ("five", None)])
def test_ints(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(points.to_int(F.col("t")).alias("x")).first()["x"] == number


def test_rows_and_text(spark):
    good, bad = points.read_rows(spark, [{"Name": "A", "Y": 12.9, "x": 77.6, "demand": 4, "area": "later"}, {"Name": " ", "y": ""}, {"Name": "B", "lat": "1", "lng": "2", "orders": "2.5"}])
    assert [(r["id"], r["orders"]) for r in good.collect()] == [("A", 4)]
    assert bad.count() == 1
    good, bad = points.read_lines(spark, "id;lat;lon;orders\nA;12,5;77,5;3\n\nB;1;2;3\n")
    assert sorted((r["id"], r["lat"]) for r in good.collect()) == [("A", 12.5), ("B", 1.0)]
    assert points.read_lines(spark, "")[0].count() == 0


def test_validation(spark):
    rows = [("d", 0, "A", 12.0, 77.0, 5), ("d", 1, "A", 12.0, 77.0, 5), ("d", 2, "B", 120.0, 77.0, 5), ("d", 3, "C", 12.0, 77.0, -5), ("d", 4, " ", 12.0, None, 5)]
    pts = spark.createDataFrame(rows, "dataset string, ord long, id string, lat double, lon double, orders long")
    assert sorted(r["ord"] for r in points.validate(pts).collect()) == [1, 2, 3, 4, 4]
    for k in (0, True, 1.5):
        with pytest.raises(ValueError):
            points.check(pts.limit(1), k)
    with pytest.raises(ValueError):
        points.check(pts, 2)
    with pytest.raises(ValueError):
        points.check(pts.limit(0), 2)
    points.check(pts.where("ord = 0"), 2)


def test_mapping(spark, tmp_path):
    path = tmp_path / "messy.csv"
    path.write_text(MESSY_CSV)
    _, bad = points.read_csv(spark, str(path))
    assert bad.count() == 1
    headers, _ = points.peek(spark, str(path))
    by_word = {"locality": 0, "name": 0, "latitude": 1, "y": 1, "longitude": 2, "x": 2, "parcels": 3, "orders": 3}

    def embed(texts):
        out = []
        for t in texts:
            v = [0.0] * 4
            for w in t.lower().replace(",", " ").split():
                if w in by_word:
                    v[by_word[w]] += 1
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out

    mapped = mapping.map_columns(spark, headers, [r.split(",") for r in MESSY_CSV.splitlines()[1:]], embed)
    assert {r["field"]: r["source_column"] for r in mapped.collect()} == {"id": "Locality Name", "lat": "Y Coordinate", "lon": "X Coordinate", "orders": "Parcels Per Day"}
    good, bad = points.read_csv(spark, str(path), mapping=mapped)
    assert (good.count(), bad.count()) == (6, 0)
    broken = mapping.map_columns(spark, ["id", "lat"], [], lambda texts: 1 / 0)
    assert {r["method"] for r in broken.collect()} == {"alias"}


def test_links(spark):
    row = spark.createDataFrame([("a", 3, "ev", "light", 90.0, 120.0, 2500.0, 0, 0, "sprawl")], "sample string, k int, vehicle string, traffic string, fuel_price double, driver_wage double, rent double, capacity int, max_radius int, scenario string")
    text = export.link(row).first()["link"]
    assert text == "s=a&k=3&v=ev&f=90.0&sc=sprawl"
    back = points.decode_link(spark.createDataFrame([(text,)], "link string")).first()
    assert (back["k"], back["vehicle"], back["fuel_price"], back["scenario"], back["traffic"]) == (3.0, "ev", 90.0, "sprawl", None)


def test_exports(spark):
    plan = whatif.run(sample(spark, "bengaluru_12"), 3)
    sites = plan["sites"].select("dataset", "k", "wh_ord", "wh_id", "lat", "lon")
    rows = export.plan_rows(plan["assignment"], sites, plan["load"]).collect()
    assert [sum(r["type"] == t for r in rows) for t in ("warehouse", "area")] == [3, 12]
    feature = json.loads(export.geojson(plan["assignment"], 1.0).first()["feature"])
    assert feature["geometry"]["type"] == "LineString"
    assert len(feature["geometry"]["coordinates"]) == 2
    s = plan["summary"].select("dataset", F.lit(12).alias("n"), F.lit(3880).alias("orders_total"), F.lit(3).alias("k"), "total", "base_total", F.lit(4).alias("best_k"), "saved_per_year", F.lit(None).cast("double").alias("regret_pct"))
    text = export.summary(s).first()["summary"]
    assert "12 areas" in text
    assert "₹27,870" in text
    assert text.count("\n") == 3
    assert spark.range(1).select(export.rupees(F.lit(1234567.0)).alias("x")).first()["x"] == "₹12,34,567"


def test_scenarios_and_flags(spark):
    from depotry.schema import scenarios

    pts = sample(spark, "bengaluru_12").cache()
    moved = whatif.demand_scenarios(pts, scenarios(spark))
    total = {r["variant"]: r["t"] for r in moved.groupBy("variant").agg(F.sum("orders").alias("t")).collect()}
    assert total["today"] == 3880
    assert total["growth"] > 1.39 * 3880
    assert total["downturn"] < 3880
    near = whatif.run(pts, 3)["assignment"]
    far = assign.out_of_radius(near, 5.0, 1.32).count()
    assert 0 < far < 12
    assert assign.out_of_radius(near, None, 1.32).count() == 0


def test_energy_of_electric_vehicles(spark):
    ev = Config(vehicle="ev")
    pts = sample(spark, "small_4")
    full, omitted = whatif.run(pts, 1, ev)["summary"].first(), whatif.run(pts, 1, ev.with_(fuel_only_rows=True))["summary"].first()
    assert abs(full["delivery"] - omitted["delivery"] - 1.4 * full["vehicle_km"]) < 1e-6
    assert abs(Config().rate_per_km - 7.5318) < 1e-3


def test_whole_ingest(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("name,lat,lng,orders\nA,12.9,77.6,5\nB,95,77.6,5\nA,12.8,77.6,5\nC,12.8,x,5\n")
    good, bad = points.ingest(spark, str(path))
    assert [r["id"] for r in good.collect()] == ["A"]
    assert bad.count() == 3


def test_what_a_solver_refuses(spark):
    pts = sample(spark, "small_4")
    points.check(pts, 2, {"capacity": 100, "max_radius_km": None})
    for constraints in ({"capacity": 0}, {"capacity": True}, {"max_radius_km": float("nan")}, {"max_radius_km": -1}, {"speed": 3}):
        with pytest.raises(ValueError, match="constraint"):
            points.check(pts, 2, constraints)
    with pytest.raises(ValueError, match="numbers"):
        points.check(pts.withColumn("lat", F.lit(True)), 2)
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError, match="orders"):
            points.check(pts.withColumn("orders", F.lit(bad)), 2)


def test_a_folder_of_files_keeps_line_numbers_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffArea;lat;lon;orders;note\n"North; ""old""";12,5;77.5;1,200;x\n\nSouth;12.6;77.6;3.5;y\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("Area;lat;lon;orders;note\nEast;12.7;77.7;9;z\nWest;north;77.8;4;z\n;;;;only a note\n", encoding="utf-8")
    good, bad = points.read_folder(spark, str(tmp_path))
    assert [tuple(r) for r in good.orderBy("ord").collect()] == [("upload", 2, 'North; "old"', 12.5, 77.5, 1200), ("upload", 6, "East", 12.7, 77.7, 9)]
    assert sorted((r["line_no"], r["error"].split("'")[1]) for r in bad.collect()) == [(4, "orders"), (7, "lat")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.csv").write_text("Area,lat\nx,1\n")
    assert "No column for" in points.read_folder(spark, str(tmp_path / "c"))[1].first()["error"]
