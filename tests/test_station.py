"""Sources: station files, dates, decimals, calendars, configuration."""

import datetime

import pytest
from pyspark.sql import functions as F

from daywheel.sources import config, schema, station, stationfiles

DAY = datetime.date(2025, 1, 1)
HEAD = "DATA;TEMPERATURA_MAXIMA;TEMPERATURA_MIN;UMIDADE_MAX;UMIDADE_MIN;PRESSAO_MAX;PRESSAO_MIN;VELOCIDADE_VENTO;DIRECAO_VENTO;RAJADA_VENTO;PRECIPITACAO_TOTAL;RADIACAO"


def write(root, lines, name="A801_2000_2025_daily.csv"):
    folder = root / "RS" / "A801"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([HEAD, *lines]))


def test_load_station(spark, tmp_path):
    write(tmp_path, ["2025-01-01;33;21;98;40;1010;1008;1.2;180;2.5;10;18000", "2025-01-02;32;20;96;42;1012;1009;1.0;175;2.3;0;17500"])
    rows = station.load_station(spark, "RS", "A801", str(tmp_path)).orderBy("Data").collect()
    assert len(rows) == 2 and rows[0].TEMPERATURA_MAXIMA == 33.0 and rows[0].PRECIPITACAO_TOTAL == 10.0
    assert [r.row_idx for r in rows] == [0, 1] and rows[0].state == "RS"


def test_load_odd_cells(spark, tmp_path):
    write(tmp_path, ["2025-01-01;33,5;21;;;;;;;;10,25;1", "not a date;1;1;;;;;;;;1;1", "2025-01-01;34,5;x;;;;;;;;1;1", "2025-01-04;30;20;;;;;;;;2;"])
    rows = station.load_station(spark, "RS", "A801", str(tmp_path), ("DATA", "TEMPERATURA_MAXIMA", "TEMPERATURA_MIN", "PRECIPITACAO_TOTAL")).orderBy("Data").collect()
    assert [r.Data for r in rows] == [DAY + datetime.timedelta(i) for i in range(4)]
    assert rows[0].TEMPERATURA_MAXIMA == 34.0 and rows[0].TEMPERATURA_MIN == 10.5 and rows[0].PRECIPITACAO_TOTAL == 11.25
    assert rows[1].TEMPERATURA_MAXIMA is None and rows[1].PRECIPITACAO_TOTAL == 0.0
    assert "RADIACAO" not in rows[0].asDict()


def test_missing_and_ambiguous_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        station.load_station(spark, "RS", "A801", str(tmp_path))
    write(tmp_path, [])
    write(tmp_path, [], "A801_2000_2026_daily.csv")
    with pytest.raises(ValueError):
        station.load_station(spark, "RS", "A801", str(tmp_path))
    assert station.station_files(spark, str(tmp_path / "none")).count() == 0
    assert {r.station_key for r in station.station_files(spark, str(tmp_path)).collect()} == {"RS_A801"}


def test_series_and_period(spark):
    rows = spark.createDataFrame([("a", DAY + datetime.timedelta(i), None if i == 3 else float(i), i) for i in range(12)], f"station_id string, Data date, {schema.RAIN} double, row_idx long")
    series = station.rain_series(rows).orderBy("row_idx").collect()
    assert [r[schema.RAIN] for r in series] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11] and [r.row_idx for r in series] == list(range(11))
    with pytest.raises(ValueError):
        station.rain_series(rows.limit(5), check=True)
    assert [r.row_idx for r in station.select_period(rows, 3, "oldest", "2025-01-03").orderBy("Data").collect()] == [2, 3, 4]
    assert [r.row_idx for r in station.select_period(rows, 2, end="2025-01-05").orderBy("Data").collect()] == [3, 4]
    with pytest.raises(ValueError):
        station.select_period(rows, 2, "other")
    assert station.normalize_decimals(spark.createDataFrame([("1,5", "x")], "a string, Data string")).first().a == 1.5
    assert station.fill_missing(rows).where(F.col(schema.RAIN).isNull()).count() == 0


def test_config(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text("# head\noutput_root: 'a # b'  # tail\nno colon here\ngroup_outputs_by_day: no\ndeep:\n  inner:\n    x: 1e3\n  y: on\nruns: [1, 2]\nempty:\nrate: 0.5\ntext: \"it\\\"s # kept\" # gone\n")
    found = config.load_config(file)
    assert found == {"output_root": "a # b", "group_outputs_by_day": "no", "deep": {"inner": {"x": 1000.0}, "y": "on"}, "runs": [1, 2], "empty": {}, "rate": 0.5, "text": 'it\\"s # kept'}
    assert config.load_config(tmp_path / "none") == {}
    assert config.output_root(found, "/p").as_posix() == "/p/a # b"
    assert config.output_root({"output_root": "outputs"}, "/p", day=DAY).as_posix() == "/p/outputs/01_01_25"
    assert config.output_root({"output_root": "/o", "group_outputs_by_day": False}, "/p").as_posix() == "/o"
    assert config.output_root({"date_folder_format": "%Y"}, "/p", day=DAY).as_posix() == "/p/outputs/2025"
    assert config.date_folder(DAY.replace(month=7, day=14)) == "14_07_25"
    once = config.dated_root("/o", DAY)
    assert once.name == "01_01_25" and config.dated_root(once, DAY) == once


def tree(root, stations, days=40):
    for n, (state, name) in enumerate(stations):
        folder = root / state / name
        folder.mkdir(parents=True)
        head = ["DATA", "PRECIPITACAO_TOTAL", "TEMPERATURA_MAXIMA"] if n % 2 else ["DATA", "TEMPERATURA_MAXIMA", "PRECIPITACAO_TOTAL"]
        cells = {"DATA": lambda i: str(DAY + datetime.timedelta(i)), "TEMPERATURA_MAXIMA": lambda i, n=n: f"{n},{i}", "PRECIPITACAO_TOTAL": lambda i, n=n: f"{i}.{n}"}
        lines = [";".join(cells[c](i) for c in head) for i in range(days) if i % 7]
        (folder / f"{name}_2000_2025_daily.csv").write_text("\r\n".join([";".join(head), *lines]))


def test_all_stations_in_one_scan(spark, tmp_path):
    stations = [("RS", "A801"), ("RS", "A802"), ("SC", "A801"), ("SC", "B9")]
    tree(tmp_path, stations)
    (tmp_path / "note.txt").write_text("no folder")
    got = stationfiles.load_stations(spark, str(tmp_path), columns=("TEMPERATURA_MAXIMA", "PRECIPITACAO_TOTAL"))
    for state, name in stations:
        own = got.where((F.col("state") == state) & (F.col("station_id") == name)).select("Data", "TEMPERATURA_MAXIMA", "PRECIPITACAO_TOTAL", "row_idx")
        want = station.load_station(spark, state, name, str(tmp_path)).select(*own.columns)
        assert sorted(own.collect()) == sorted(want.collect()) and own.count() == 39
    assert stationfiles.scan(spark, str(tmp_path / "none")).count() == 0


def test_ranges_hold_every_line_once(spark, tmp_path):
    tree(tmp_path, [("RS", "A801"), ("SC", "B9")])
    whole = sorted(stationfiles.scan(spark, str(tmp_path)).collect(), key=str)
    for size in (1, 7, 64, 333):
        cut = stationfiles.scan(spark, str(tmp_path), split_bytes=str(size))
        assert sorted(cut.collect(), key=str) == whole and len(whole) == 68
    assert cut.rdd.getNumPartitions() > 2


def test_conditions_open_only_their_files(spark, tmp_path):
    tree(tmp_path, [("RS", "A801"), ("RS", "A802")])
    # A second file makes any listing of SC an error.
    tree(tmp_path, [("SC", "A801")])
    (tmp_path / "SC" / "A801" / "A801_1990_1999_daily.csv").write_text("DATA")
    with pytest.raises(Exception, match="more than one file"):
        stationfiles.scan(spark, str(tmp_path)).count()
    raw = stationfiles.scan(spark, str(tmp_path))
    assert raw.where("state = 'RS'").count() == 68
    assert raw.where("state in ('RS', 'XX') and station_id = 'A802' and DATA >= '2025-01-10'").count() == sum(i % 7 > 0 for i in range(9, 40))
    assert raw.where("state = 'RS' and station_id = '../SC'").count() == 0
    assert stationfiles.scan(spark, str(tmp_path), states="RS", stations="A801,Z").count() == 34


def test_odd_cells_of_a_scan(spark, tmp_path):
    folder = tmp_path / "RS" / "A1"
    folder.mkdir(parents=True)
    text = "﻿DATA;PRECIPITACAO_TOTAL;OTHER;RADIACAO\n2025-01-01;1,5;x;2\n2025-01-02\n\n2025-01-03;;x;3;beyond;more\nbad;1;x;1\n2025-01-04;\"2,5\";\"a;b\";n\n"
    (folder / "A1_2000_2001_daily.csv").write_bytes(text.encode() + b"2025-01-05;7;\xff;1")
    rows = {r.Data.day: (r.PRECIPITACAO_TOTAL, r.RADIACAO, r.UMIDADE_MAX) for r in stationfiles.load_stations(spark, str(tmp_path)).collect()}
    assert rows == {1: (1.5, 2.0, 0.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 3.0, 0.0), 4: (2.5, 0.0, 0.0), 5: (7.0, 1.0, 0.0)}
