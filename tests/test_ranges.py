"""Arrays and quoted CSV files cut into small ranges, against the readers that take a file whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mixloom.sources import mixtures, ranges, readers

PARTS = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"


@pytest.fixture(params=["307b"])
def small_ranges(spark, request):
    before = {key: spark.conf.get(key) for key in (PARTS, COST)}
    spark.conf.set(PARTS, request.param)
    spark.conf.set(COST, "1b")
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


AWKWARD = ['}', '{', '"', '\\', '\\"', '\\\\', '}{', '],[', ',', '":{"', '[1,2', 'a}b"c\\', 'é漢}', '\n', '\t', '', 'x' * 300 + '}']


def records(n=24):
    draw = random.Random(n)
    text = lambda: "".join(draw.choices(AWKWARD, k=draw.randint(0, 6)))
    return [{"id": i, "text": text(), "deep": {"a": [{"b": text()}], "n": None}, "list": [i, i + 1]} for i in range(n)]


def places_in_order(df):
    return df.orderBy("_file", "_block", "_row")


@pytest.mark.parametrize("indent", [None, 2])
def test_array_elements_in_order(spark, small_ranges, tmp_path, indent):
    rows = records()
    (tmp_path / "a.json").write_text("\n " + json.dumps(rows, indent=indent, ensure_ascii=False) + " \n")
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text(json.dumps(rows[:3]))
    elements = places_in_order(ranges.json_elements(spark, str(tmp_path))).collect()
    assert [json.loads(r["value"]) for r in elements] == rows + rows[:3]
    assert len({r["_block"] for r in elements}) > 3


def test_array_rows_equal_the_reader(spark, small_ranges, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(records(), ensure_ascii=False))
    assert ranges.splits(spark, str(path))
    found = readers.read_json(spark, str(path))
    whole = spark.read.option("multiLine", True).json(str(path))
    assert found.schema == whole.schema
    key = lambda r: r["id"]
    assert sorted(found.collect(), key=key) == sorted(whole.collect(), key=key)
    assert "text string" in found.schema.simpleString() or "text:string" in found.schema.simpleString()
    given = readers.read_json(spark, str(path), schema="id long, text string")
    assert [r["text"] for r in given.orderBy("id").collect()] == [r["text"] for r in records()]


def test_one_array_is_read_by_many_tasks(spark, small_ranges, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"id": i, "text": "t" * 40} for i in range(60)]))
    cut = ranges._with_starts(*[(p := ranges._pieces(spark, str(path), "}")), ranges._json_starts(p).withColumn("lists", F.lit(0))])
    assert cut.rdd.getNumPartitions() > 4


@pytest.mark.parametrize("values", [[1, "a}", None, [1, "]"], 2.5, "x,\\\"y"], [[1, 2], [3]], ["only"]])
def test_elements_of_any_kind(spark, small_ranges, tmp_path, values):
    (tmp_path / "a.json").write_text(json.dumps(values * 9))
    elements = places_in_order(ranges.json_elements(spark, str(tmp_path))).collect()
    assert [json.loads(r["value"]) for r in elements] == values * 9


def test_malformed_elements_raise(spark, small_ranges, tmp_path):
    (tmp_path / "a.json").write_text("[" + ",".join('{"id": %d}' % i for i in range(60)) + ', {"id": oops}]')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read_json(spark, str(tmp_path / "a.json"), schema="id long").collect()


def test_first_list_of_a_root_object(spark, small_ranges, tmp_path):
    rows = records(16)
    first = {"about": {"x": [1, {"y": ["}"]}], "s": "[\"}"}, "n": 1, "items": rows, "others": [{"id": -1}], "z": "]"}
    (tmp_path / "a.json").write_text(json.dumps(first, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"rows": [], "more": rows}, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"id": 1000, "text": "no list", "deep": {"n": "x"}}))
    elements = places_in_order(ranges.json_elements(spark, str(tmp_path), of_root_object=True)).collect()
    assert [json.loads(r["value"]) for r in elements] == rows
    found = readers.read_json_root(spark, str(tmp_path))
    assert {r["id"]: r["text"] for r in found.collect()} == {r["id"]: r["text"] for r in rows} | {1000: "no list"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"k": "x" * 5000, "v": [1, 2, 3]}))
    assert sorted(r["value"] for r in readers.read_json_root(spark, str(tmp_path / "d")).collect()) == [1, 2, 3]


def quoted_lines(n=60, break_="\n"):
    draw = random.Random(n)
    pieces = ["a", '""', ",", break_, "é", '"",""', break_ + '""' + break_, "'", " "]
    lines = ["id,text,more" + break_]
    for i in range(n):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 9)))
        more = draw.choice(["", "plain", "it\"s", "3\" pipe", '""', f'"q{break_}{i}"'])
        lines.append(f'{i},"{text}",{more}{break_}' + (break_ if i % 20 == 0 else ""))
    return "".join(lines)


@pytest.mark.parametrize("break_", ["\n", "\r\n"])
def test_csv_rows_equal_the_reader(spark, small_ranges, tmp_path, break_):
    (tmp_path / "a.csv").write_text(quoted_lines(break_=break_), newline="")
    (tmp_path / "b.csv").write_text(quoted_lines(40, break_).rstrip() + break_ + '900,"last without end', newline="")
    paths = [str(tmp_path / "a.csv")]
    whole = spark.read.csv(paths, header=True, multiLine=True, escape='"').na.fill("")
    found = readers.read_csv(spark, paths)
    assert found.columns == whole.columns
    assert sorted(found.collect()) == sorted(whole.collect())
    records = places_in_order(ranges.csv_records(spark, str(tmp_path / "a.csv"))).collect()
    ids = [r["value"].split(",")[0] for r in records if r["_row"] != ranges.HEADER_ROW or r["_block"]]
    assert ids == [str(i) for i in range(60)]


def test_long_quoted_fields_over_ranges(spark, small_ranges, tmp_path):
    rows = [(str(i), "line\n" * (i * 7 % 90) + '"" ' * (i % 5)) for i in range(40)]
    text = 'id,"te\nxt"\n' + "".join(f'{i},"{t}"\n' for i, t in rows)
    (tmp_path / "a.csv").write_text(text)
    found = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert found.columns == ["id", "te\nxt"]
    assert {tuple(r) for r in found.collect()} == {(i, t.replace('""', '"')) for i, t in rows}


def test_mixture_of_large_files(spark, tmp_path):
    rows = [{"instruction": f"i{i}", "output": "o}\"" + "x" * (i % 50)} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(rows + [{"instruction": "last", "extra": {"k": [1]}}]))
    (tmp_path / "c.csv").write_text("text\n" + "".join(f'"row {i}\nmore"\n' for i in range(200)))
    entries = {"a": {"file_name": "a.json"}, "c": {"file_name": "c.csv", "num_samples": 7}}

    def read():
        df = mixtures.load_mixture(spark, entries, root=str(tmp_path), row_ids=True)
        return [(r["dataset"], r["_id"], r["r"]) for r in
                df.select("dataset", "_id", F.to_json("record").alias("r")).orderBy("_id").collect()]

    whole, before = read(), {key: spark.conf.get(key) for key in (PARTS, COST)}
    spark.conf.set(PARTS, "2k")
    spark.conf.set(COST, "1b")
    try:
        assert read() == whole and len(whole) == 208
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_files_cut_differently_are_noticed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i} for i in range(100)]))
    pieces = ranges._pieces(spark, str(tmp_path / "a.json"), "}")
    none = ranges._json_starts(pieces).withColumn("lists", F.lit(0)).filter("_block < 0")
    with pytest.raises(Exception, match="cut differently"):
        ranges._with_starts(pieces, none).mapInArrow(ranges._cut(1), "_file string, _block long, _row long, part string, value string").collect()
