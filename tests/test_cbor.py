"""CBOR items by the published examples, a paragraph corpus, and a round trip of a table."""

import math

import pytest

from lexspan.sources import cbor


@pytest.mark.parametrize(("raw", "value"), [("00", 0), ("17", 23), ("1818", 24), ("1903e8", 1000), ("1bffffffffffffffff", (1 << 64) - 1), ("20", -1), ("3903e7", -1000), ("f93c00", 1.0), ("fa47c35000", 100000.0), ("fb3ff199999999999a", 1.1), ("f4", False), ("f5", True), ("f6", None), ("c11a514b67b0", 1363896240), ("4401020304", b"\1\2\3\4"), ("62c3bc", "ü"), ("80", []), ("8301820203820405", [1, [2, 3], [4, 5]]), ("a201020304", [(1, 2), (3, 4)]), ("5f42010243030405ff", b"\1\2\3\4\5"), ("7f657374726561646d696e67ff", "streaming"), ("9f018202039f0405ffff", [1, [2, 3], [4, 5]]), ("bf6161016162ff", None)])
def test_examples(raw, value):
    data = bytes.fromhex(raw)
    if raw == "bf6161016162ff":
        with pytest.raises(ValueError):
            cbor.item(data)
        return
    assert cbor.item(data) == (value, len(data))
    assert cbor.item(cbor.encoded(value))[0] == value if not isinstance(value, list) or not value or not isinstance(value[0], tuple) else True


@pytest.mark.parametrize("raw", ["", "18", "62c3", "1c", "8201", "82ff01", "9f01", "fb3ff1"])
def test_broken_items(raw):
    with pytest.raises(cbor.CborError):
        cbor.item(bytes.fromhex(raw))
    assert math.isnan(cbor.item(bytes.fromhex("f97e00"))[0])


def body(*parts):
    return b"\x9f" + b"".join(map(cbor.encoded, parts)) + b"\xff"


def record(name, *parts):
    return b"\x83" + cbor.encoded(0) + cbor.encoded(name) + body(*parts)


def test_paragraphs(spark, tmp_path):
    rows = [
        record(b"p1", [0, "A fox"], [1, [0, "Red fox", [], b"enwiki:Red", "red fox"]], [0, "runs."]),
        record(b"p2", [1, [0, "Page", ["s"], b"id", ""]]),
        record(b"p3"), cbor.encoded("no paragraph"), record("p4", [0, "ü" * 70_000]),
    ]
    (tmp_path / "a.cbor").write_bytes(cbor.encoded(["header", 1]) + b"\x9f" + b"".join(rows) + b"\xff")
    (tmp_path / "b.cbor").write_bytes(record(b"p5", [0, "alone"]))
    (tmp_path / "none.cbor").write_bytes(b"")
    got = {r.docno: r.text for r in cbor.paragraphs(spark, str(tmp_path)).collect()}
    assert got == {"CAR_p1": "A fox red fox runs. >>> Red fox", "CAR_p2": "s >>> Page", "CAR_p4": "ü" * 70_000, "CAR_p5": "alone"}
    fields = {(r.docno, r.feature): r.said for r in cbor.paragraph_fields(cbor.paragraphs(spark, str(tmp_path))).collect()}
    assert fields["CAR_p5", ":pid:"] == "CAR_p5" and fields["CAR_p5", ":paragraph:"] == "alone" and len(fields) == 8
    (tmp_path / "bad.cbor").write_bytes(record(b"p6", [0, "cut"])[:-3])
    with pytest.raises(Exception, match="bad.cbor"):
        cbor.paragraphs(spark, str(tmp_path)).collect()


def test_round_trip(spark, tmp_path):
    rows = [(f"d{k}", f"text {k} é", k) for k in range(2500)]
    (tmp_path / "t.cbor").write_bytes(b"".join(cbor.encoded([*r, None, 0.5, [True, -k]]) for k, r in enumerate(rows)))
    got = cbor.read_records(spark, str(tmp_path), lambda x: (x[0], x[1], x[2] + x[5][1]), "docno string, text string, n long")
    assert {(r.docno, r.text, r.n) for r in got.collect()} == {(a, b, 0) for a, b, _ in rows}


def test_elements():
    data = b"\x9f" + b"\x9f\x01\xff" + b"\x02" + b"\xff" + b"\x03" + b"\x9f\x04\xff"
    assert list(cbor.elements(data)) == [[1], 2, 3, 4]
