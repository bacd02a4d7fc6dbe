import random

import pytest
from conftest import rows

from textlab.sources import readers
from textlab.sources.csv_cut import cut_csv


def field(rng):
    kind = rng.randrange(7)
    if kind == 0:
        return ""
    if kind == 1:
        return '""'
    if kind < 5:
        return "plain" * rng.randrange(3) + str(rng.randrange(1000)) + rng.choice(["", "é😀", " x "])
    inner = "".join(rng.choice(["a", ",", "\n", '""', "\r\n", " ", "é", "\n\n"]) for _ in range(rng.randrange(60)))
    return f'"{inner}"'


def write(path, seed, n, end="\n"):
    rng = random.Random(seed)
    lines = ["k,text,other"] + [f"{i},{field(rng)},{field(rng)}" for i in range(n)]
    path.write_bytes((end.join(lines) + (end if seed % 2 else "")).encode())


@pytest.fixture
def small_blocks(spark):
    for key, value in (("maxPartitionBytes", "97"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    yield
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\n"), (3, "\r\n"), (4, "\n")])
def test_equals_the_whole_file_reader(spark, tmp_path, small_blocks, seed, end):
    write(tmp_path / "a.csv", seed, 80, end)
    write(tmp_path / "b.csv", seed + 10, 3, end)
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    found = cut_csv(spark, paths, ["k", "text", "other"])
    assert found.select("_file", "_block").distinct().count() > 10
    whole = readers._csv(spark, True).csv(paths)
    assert rows(found.select("k", "text", "other")) == rows(whole)
    ordered = found.orderBy("_file", "_block", "_row").select("k").collect()
    assert [int(r[0]) for r in ordered] == [*range(80), *range(3)]


def test_a_record_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join("line" * 9 for _ in range(60))
    (tmp_path / "a.csv").write_text(f'k,text\n1,"{long}"\n2,x\n3,"{long} ""q"" \n"\n4,y')
    found = cut_csv(spark, [str(tmp_path / "a.csv")], ["k", "text"]).select("k", "text")
    assert rows(found) == [("1", long), ("2", "x"), ("3", f'{long} "q" \n'), ("4", "y")]


def test_headers_only_and_odd_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,text\n")
    assert cut_csv(spark, [str(tmp_path / "a.csv")], ["k", "text"]).collect() == []
    (tmp_path / "b.csv").write_text('k,text\n1,5" disk\n')
    with pytest.raises(ValueError, match="cut=False"):
        cut_csv(spark, [str(tmp_path / "b.csv")], ["k", "text"])
    [table] = readers.read_csv_folder(spark, str(tmp_path), cut=False)
    assert table.filter("k = '1'").count() == 1


def test_missing_files_are_reported(spark, tmp_path):
    with pytest.warns(UserWarning, match="no files"):
        assert readers.read_csv_folder(spark, str(tmp_path)) == []
    with pytest.warns(UserWarning, match="no file "):
        assert readers.read_csv(spark, str(tmp_path / "none.csv")) is None


def test_split_map_is_cut_at_its_separators(spark, tmp_path, small_blocks):
    from textlab.sources import writers

    entries = ",\n".join(f'"{i}": "{["train", "val", "test"][i % 3]}"' for i in range(200))
    (tmp_path / "map.json").write_text("{\n" + entries + "\n}\n")
    read = readers.read_split_map(spark, str(tmp_path / "map.json"))
    assert read.rdd.getNumPartitions() > 10
    assert rows(read) == [(i, ["train", "val", "test"][i % 3]) for i in range(200)]
    writers.write_split_map(read, str(tmp_path / "out"))
    assert rows(readers.read_split_map(spark, str(tmp_path / "out"))) == rows(read)
    (tmp_path / "empty.json").write_text("{}")
    assert readers.read_split_map(spark, str(tmp_path / "empty.json")).collect() == []
    (tmp_path / "odd.json").write_text('{"1": "a,b"}')
    with pytest.raises(Exception, match="not an entry"):
        readers.read_split_map(spark, str(tmp_path / "odd.json")).collect()
