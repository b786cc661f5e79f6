"""Delimited files in each encoding, larger than a split, against their Parquet twin."""

import pytest

from funnelweir.sources import tables as IO

ROWS = [(str(k), f"名称 {k % 97}é漢", f'say "{k % 7}", ok' if k % 5 else None, f"{k / 8}") for k in range(9000)]
HEADER = ["id", "name", "note", "price"]


def lines():
    field = lambda v: "" if v is None else '"' + v.replace('"', '\\"') + '"' if any(c in v for c in '",') else v
    return "\n".join([",".join(HEADER), *[",".join(map(field, r)) for r in ROWS], ""])


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "48k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_encoding_equals_the_parquet_twin(spark, tmp_path, small_splits, encoding, end):
    (tmp_path / "t.csv").write_bytes(lines().replace("\n", end).encode(encoding))
    spark.createDataFrame(ROWS, "id string, name string, note string, price string").write.parquet(str(tmp_path / "twin.parquet"))
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.legacy.javaCharsets")
    df = IO.read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == HEADER and df.rdd.getNumPartitions() > 5
    twin = IO.read_table(spark, str(tmp_path / "twin"))
    assert df.count() == len(ROWS) and df.exceptAll(twin).count() == 0 and twin.exceptAll(df).count() == 0
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.legacy.javaCharsets"))


def test_folders_schemas_short_lines_and_no_rows(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in range(3):
        (folder / f"p{k}.csv").write_bytes(f"a,b\n{k},x\n\n{k + 10}\n".encode())
    assert sorted(map(tuple, IO.read_delimited(spark, str(folder)).collect())) == [("0", "x"), ("1", "x"), ("10", None), ("11", None), ("12", None), ("2", "x")]
    typed = IO.read_delimited(spark, str(folder), "a int, b string")
    assert typed.dtypes == [("a", "int"), ("b", "string")] and typed.agg({"a": "sum"}).first()[0] == 36
    (tmp_path / "none.csv").write_bytes(b"")
    assert IO.read_delimited(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    with pytest.raises(ValueError):
        IO.read_delimited(spark, str(tmp_path / "none.csv"))


def test_bytes_of_no_encoding_are_refused(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"a,b\n1,\xff\xff\n")
    with pytest.raises(Exception, match="gb18030"):
        IO.read_delimited(spark, str(tmp_path / "bad.csv")).collect()
