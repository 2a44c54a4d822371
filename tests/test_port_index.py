"""Port index rows and coordinates, from files of both encodings."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import port_index

HEADER = "OID_,World Port Index Number,Main Port Name,Alternate Port Name,UN/LOCODE,Country Code,Harbor Use,Latitude,Longitude,First Port of Entry\n"


def test_a_file_of_three_ports(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1,100.0,Rotterdam, ,NLRTM,Netherlands,Cargo,51.90,4.50,Yes\n2,200.0,Fort Bay, , ,Saba,Unknown,17.62,-63.25,Yes\n3,300.0,Yacht Club Marina, , ,Saba,Unknown,17.80,-63.10,No\n")
    got = {r["index"]: r for r in port_index.read_port_index(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["100", "200", "300"]
    r = got["100"]
    assert (r["name"], r["lat"], r["lon"], r["country"], r["harbor_use"], r["alt"], r["unlocode"]) == ("Rotterdam", 51.9, 4.5, "Netherlands", "Cargo", None, "NLRTM")
    assert "first_port_of_entry" not in {c.lower() for c in r.asDict()}


def test_encodings_repeats_and_unusable_rows(spark, tmp_path):
    rows = ['9,7,"Güiria, port",GÜIRIA,,VE,,10.5,-62.3,', "9,7.00,again,,,VE,,1,1,", "9,,Nowhere,,,VE,,none,1,", "9,8,,,,VE,,1,1,", "9,9,Off,,,VE,,91,1,", "9,,Same,,,VE,,1,2,", "9,,same,,,VE,,1,2,", f"9,10,{'n' * 300},,ABCDEFGHIJKLMNOP,VE,,1,2,"]
    body = HEADER + "\n".join(rows) + "\n"
    for name, data in (("utf", b"\xef\xbb\xbf" + body.replace("OID_,World Port Index Number", "World Port Index Number,OID_").replace("\n9,", "\n").encode()), ("latin", body.encode("latin-1"))):
        if name == "utf":  # the byte order mark lies before the index
            data = b"\xef\xbb\xbf" + (HEADER.replace("OID_,", "") + "\n".join(r.removeprefix("9,") for r in rows) + "\n").encode()
        (tmp_path / f"{name}.csv").write_bytes(data)
        got = port_index.read_port_index(spark, str(tmp_path / f"{name}.csv")).collect()
        assert sorted(r["index"] for r in got) == ["", "10", "7"]
        by = {r["index"]: r for r in got}
        assert by["7"]["name"] == "Güiria, port" and by["7"]["alt"] == "GÜIRIA" and by["7"]["harbor_use"] == "Unknown"
        assert by[""]["name"] == "Same" and len(by["10"]["name"]) == 200 and by["10"]["unlocode"] == "ABCDEFGHIJKL"
    (tmp_path / "none.csv").write_text(HEADER)
    assert port_index.read_port_index(spark, str(tmp_path / "none.csv")).count() == 0


@pytest.mark.parametrize("raw, want", [("51.9", 51.9), ("-63.25", -63.25), ("36°50'00\"N", 36 + 50 / 60), ("36°50'00''N", 36 + 50 / 60), ("74°15'00\"W", -74.25), ("S 12° 30′", -12.5), ("12 30 00 w", -12.5),
                                       ("", None), (None, None), ("nan", None), ("none", None), ("200", None), ("181°0'", None), ("x", None), ("1e1", 10.0)])
def test_degrees(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "c string").select(port_index.degrees(F.col("c")).alias("v")).first().v
    assert got == pytest.approx(want) if want is not None else got is None


def test_index_keys(spark):
    rows = [("100.0", "100"), (" 7 ", "7"), ("007.00", "7"), ("-5.0", "-5"), ("1.5", "1.5"), ("A1.0", "A1.0"), ("", ""), ("0.0", "0")]
    got = spark.createDataFrame(rows, "c string, want string").select(port_index.index_key(F.col("c")).alias("v"), "want").collect()
    assert [r.v for r in got] == [r.want for r in got]


def test_other_headers_and_rows_from_json(spark):
    raw = spark.createDataFrame([("9.0", "X", 1.5, 2.5, "nan")], "index string, NAME string, lat double, lon double, alt string")
    r = port_index.records(raw).first()
    assert (r["index"], r["name"], r["lat"], r["lon"], r["alt"], r["harbor_use"], r["country"]) == ("9", "X", 1.5, 2.5, None, "Unknown", "")
