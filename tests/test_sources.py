import pytest

from pagetide.sources import tables


def test_target_list_with_quotes_and_bom(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('﻿name,url,keywords\n"A, ""B""\nC",https://h/,k\nshort,https://i/\n', encoding="utf-8")
    got = sorted((r["name"], r["url"], r["keywords"], r["enabled"]) for r in tables.scan_targets(spark, str(p)).collect())
    assert got == [('A, "B"\nC', "https://h/", "k", ""), ("short", "https://i/", "", "")]


@pytest.mark.parametrize("head", ["name,name,url", "name", "name,url,other"])
def test_bad_headers_are_refused(spark, tmp_path, head):
    p = tmp_path / "t.csv"
    p.write_text(head + "\na,b,c\n")
    with pytest.raises(ValueError):
        tables.scan_targets(spark, str(p))


def test_encodings(spark):
    data = [(1, "é".encode(), None), (2, "é".encode("latin-1"), "latin-1"), (3, "日本".encode("shift_jis"), "Shift_JIS"), (4, b"\xff", None), (5, "é".encode("utf-16"), None), (6, b"<meta charset=gbk>" + "中".encode("gbk"), None), (7, b"x", "rot13"), (8, None, None)]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None, c) for k, b, c in data], "k int, body binary, charset string")
    got = {r["k"]: r["text"] for r in tables.decode_documents(df, "k").collect()}
    assert got == {1: "é", 2: "é", 3: "日本", 4: None, 5: "é", 6: "<meta charset=gbk>中", 7: None, 8: None}


def test_lists_with_surplus_cells_or_of_too_many_bytes_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,url\na,https://h/1,surplus\nb,https://h/2\n")
    rows = tables.scan_targets(spark, f"file://{tmp_path}/a.csv", strict=False).collect()
    assert [(r["name"], r["problem"]) for r in rows] == [("a", "surplus cells"), ("b", None)]
    with pytest.raises(ValueError, match="surplus"):
        tables.scan_targets(spark, f"file://{tmp_path}/a.csv")
    (tmp_path / "b.csv").write_text("name,url\n" + "a,https://h/1\n" * 10)
    assert tables.scan_targets(spark, f"file://{tmp_path}/b.csv").count() == 10
    with pytest.raises(ValueError, match="large"):
        tables.scan_targets(spark, f"file://{tmp_path}/b.csv", most_bytes=20)
