"""Array files read in splits against the reader of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marklake.sources.arrays import read_array_elements
from marklake.sources.files import read_bookmark_pages


def element(rnd, depth=0):
    text = lambda: "".join(rnd.choice('ab"\\{}[],é\n 😀') for _ in range(rnd.randrange(12)))
    kind = rnd.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return text()
    if kind == 1:
        return rnd.choice([None, True, 1.5, -3, "null", "[]"])
    if kind in (2, 3):
        return {text(): text() for _ in range(rnd.randrange(3))}
    if kind == 4:
        return [element(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {text(): element(rnd, depth + 1) for _ in range(rnd.randrange(1, 5))}


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "1b"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_three_elements(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text('\n [ {"a": "x}y,\\"]' + "p" * 90 + '"} ,' + '{"b": [1, {"c": 2}]}, {"d":\n{}} ] \n')
    read = read_array_elements(spark, str(tmp_path))
    assert read.select("file").distinct().count() == 1
    rows = {r.pos: r.raw for r in read.collect()}
    assert [json.loads(rows[i]) for i in range(3)] == [{"a": 'x}y,"]' + "p" * 90}, {"b": [1, {"c": 2}]}, {"d": {}}]


def test_rows_equal_the_whole_file_reader(spark, tmp_path, small_splits):
    rnd = random.Random(6)
    for n in range(25):
        data = [element(rnd) for _ in range(rnd.choice([0, 1, 2, 9]))]
        (tmp_path / f"f{n}.json").write_text(json.dumps(data, ensure_ascii=n % 2 == 0, indent=rnd.choice([None, 1])))
    whole = json.dumps([{"k": ["v}", {"x": 1}]}] * 6)
    damaged = {"cut": whole[:-9], "object": whole[1:-1], "comma": whole[:-1] + ",]", "empty": "", "blank": " \n",
               "scalar": "5", "brace": whole[:-1] + "}", "inner": whole.replace('"x"', '"x', 1), "word": "[tru]", "none": "[ ]", "nulls": "[null, null]"}
    for name, text in damaged.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "other.txt").write_text(whole)
    for name, text in (("tail", whole + "x"), ("two", whole + whole)):
        (tmp_path / "behind").mkdir(exist_ok=True)
        (tmp_path / "behind" / f"{name}.json").write_text(text)
    assert read_array_elements(spark, str(tmp_path / "behind")).count() == 0
    shown = lambda df: sorted(map(tuple, df.select(F.substring_index("file", "/", -1), "page_no", "raw").collect()), key=repr)
    want, got = shown(read_bookmark_pages(spark, str(tmp_path))), shown(read_bookmark_pages(spark, str(tmp_path), large=True))
    assert got == want and len(want) >= 50
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    assert shown(read_bookmark_pages(spark, str(tmp_path), large=True)) == want


def test_texts_are_cut_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"b": 2}]')
    read = read_array_elements(spark, str(tmp_path))
    plan = read._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "FileScan text" not in plan and read.count() == 2
