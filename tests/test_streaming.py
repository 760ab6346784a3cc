from __future__ import annotations

import json

from gasflow.operators.proximity import locations_of, vessels_near_locations
from gasflow.streaming.vessels import collect_vessels, decode_vessels, read_vessel_stream, tag_vessels

MESSAGES = [
    {"mmsi": 1, "timestamp": 1700000000, "lat": 30.0, "lon": -90.0, "speed": 7.5, "course": 90, "navStatus": "0", "typeCode": 70},
    {"mmsi": 2, "timestamp": 1700000001, "lat": 30.01, "lon": -90.0, "typeCode": "79"},
    {"mmsi": 3, "lat": 40.0, "lon": -90.0, "typeCode": 75},
    {"mmsi": 4, "timestamp": 1700000003, "lat": 30.0, "lon": -90.0, "typeCode": 69},
    {"mmsi": 5, "timestamp": 1700000003, "lat": 30.0, "lon": -90.0, "typeCode": 80},
    {"mmsi": 6, "lat": 30.0, "lon": -90.0},
    {"mmsi": 7, "lat": 30.0, "lon": -90.0, "typeCode": "tanker"},
]
COLUMNS = ["mmsi", "timestamp", "latitude", "longitude", "speed", "course", "status", "vessel_type"]


def lines():
    return [json.dumps(m) for m in MESSAGES] + ['{"mmsi": 8, "typeCode": 7', "", "[]"]


def test_decode(spark):
    decoded = decode_vessels(spark.createDataFrame([(v,) for v in lines()], "value string"))
    assert decoded.columns == COLUMNS
    got = {r["mmsi"]: r for r in decoded.collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["speed"] == 7.5 and got[1]["status"] == "0" and got[2]["vessel_type"] == 79
    assert got[3]["timestamp"].timestamp() == 0


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "messages"
    folder.mkdir()
    for i, part in enumerate((lines()[:4], lines()[4:])):
        (folder / f"{i}.json").write_text("\n".join(part))
    places = spark.createDataFrame([("a", 30.0, -90.0), ("b", 30.1, -90.0)], "loc_name string, latitude double, longitude double")
    locations = locations_of(places)
    batch = decode_vessels(spark.read.text(str(folder)))
    near = vessels_near_locations(batch, locations)

    stream = decode_vessels(read_vessel_stream(spark, str(folder), files_per_trigger=1))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    collect_vessels(stream, out, marks).awaitTermination()
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch.collect()))

    tagged_out, tagged_marks = str(tmp_path / "tagged"), str(tmp_path / "tagged-marks")
    tagged = tag_vessels(decode_vessels(read_vessel_stream(spark, str(folder))), locations)
    collect_vessels(tagged, tagged_out, tagged_marks).awaitTermination()
    got = sorted((r["mmsi"], r["loc_name"]) for r in spark.read.parquet(tagged_out).collect())
    assert got == sorted((r["mmsi"], r["loc_name"]) for r in near.collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]

    (folder / "later.json").write_text(json.dumps({"mmsi": 9, "lat": 1.0, "lon": 1.0, "typeCode": 71}))
    collect_vessels(stream, out, marks).awaitTermination()
    assert {r["mmsi"] for r in spark.read.parquet(out).collect()} == {1, 2, 3, 9}
