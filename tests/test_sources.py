"""Readers, catalogue, mixture loading and sinks."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mixloom import prepare
from mixloom.sources import catalogue, mixtures, readers, sinks


@pytest.fixture
def file(tmp_path):
    def make(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8", newline="")
        return str(path)
    return make


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_json_array(spark, file):
    path = file("a.json", '[\n {"b": 1, "a": "x\\ny"},\n {"a": null, "b": 2}\n]')
    assert sorted(dicts(readers.read_json(spark, path)), key=lambda r: r["b"]) == [
        {"a": "x\ny", "b": 1}, {"a": None, "b": 2}
    ]


def test_json_root_takes_the_first_list_in_file_order(spark, file):
    path = file("a.json", '{"meta": "v1", "zrows": [{"k": 1}, {"k": 2}], "arows": [{"k": 3}]}')
    assert [r["k"] for r in dicts(readers.read_json_root(spark, path))] == [1, 2]
    assert [r["k"] for r in dicts(readers.read_json(spark, path, "arows"))] == [3]
    with pytest.raises(ValueError):
        readers.read_json(spark, path, "meta")


def test_json_root_of_plain_values_and_without_list(spark, file):
    assert dicts(readers.read_json_root(spark, file("v.json", '{"l": ["a", "b"]}'))) == [{"value": "a"}, {"value": "b"}]
    assert dicts(readers.read_json_root(spark, file("o.json", '{"k": {"x": 1}}'))) == [{"k": {"x": 1}}]


def test_jsonl_skips_blank_lines_and_raises_on_bad_ones(spark, file):
    path = file("a.jsonl", '{"k": 1}\n\n{"k": 2}\n')
    assert sorted(r["k"] for r in dicts(readers.read_jsonl(spark, path))) == [1, 2]
    bad = file("b.jsonl", '{"k": 1}\n{"k": oops\n')
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        readers.read_jsonl(spark, bad, schema="k bigint").collect()
    kept = dicts(readers.read_jsonl(spark, bad, schema="k bigint", quarantine=True))
    assert {r["k"] for r in kept} == {1, None}
    assert [r["_corrupt_record"] for r in kept if r["k"] is None] == ['{"k": oops']


def test_csv_quotes_and_empty_values(spark, file):
    path = file("a.csv", 'id,text\n1,"a ""q""\nb, c"\n2,\n')
    assert dicts(readers.read_csv(spark, path)) == [
        {"id": "1", "text": 'a "q"\nb, c'}, {"id": "2", "text": ""}
    ]


def test_text_lines(spark, file):
    path = file("a.txt", "one\n\ntwo\n")
    assert sorted(r["text"] for r in dicts(readers.read_text(spark, path))) == ["one", "two"]
    assert readers.read_text(spark, path, drop_empty=False).count() == 3
    crlf = file("b.txt", "one\r\n two \r\n")
    assert sorted(r["text"] for r in dicts(readers.read_text(spark, crlf))) == [" two ", "one"]


def test_read_file_by_suffix(spark, file, tmp_path):
    assert readers.read_file(spark, file("a.txt", "x\n")).columns == ["text"]
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert readers.read_file(spark, str(tmp_path / "p.parquet")).count() == 3
    with pytest.raises(ValueError, match="no reader for files"):
        readers.read_file(spark, "x.arrow")


def test_custom_loader_ignores_limits(spark):
    loaded = readers.load_custom(spark, lambda s, o: s.range(o["n"]), {"n": 4, "max_samples": 1})
    assert loaded.count() == 4


@pytest.mark.parametrize("driver_rows", [10_000, 5])
def test_first_rows_in_source_order(spark, file, monkeypatch, driver_rows):
    monkeypatch.setattr(readers, "DRIVER_ROWS", driver_rows)
    for name, start in (("b.jsonl", 100), ("a.jsonl", 0)):
        file(f"d/{name}", "".join(json.dumps({"k": start + i}) + "\n" for i in range(50)))
    path = file("d/c.jsonl", '{"k": 500}\n').rsplit("/", 1)[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        df = readers.read_jsonl(spark, path, schema="k bigint")
        got = sorted(r["k"] for r in readers.first_in_source(df, 70).collect())
        assert got == list(range(50)) + list(range(100, 120))
        assert readers.first_in_source(df, None).count() == 101
        assert readers.first_in_source(df, 1000).count() == 101
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_positions_do_not_depend_on_file_pieces(spark, file, tmp_path):
    for name in ("b", "a"):
        file(f"d/{name}.jsonl", "".join(json.dumps({"k": f"{name}{i}"}) + "\n" for i in range(40)))
    path = str(tmp_path / "d")

    def positions():
        rows = readers.with_positions(readers.read_jsonl(spark, path, schema="k string")).collect()
        return {r["k"]: r["_id"] for r in rows}

    whole = positions()
    assert whole == {f"{n}{i}": 40 * (n == "b") + i for n in "ab" for i in range(40)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert positions() == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.range(25).repartitionByRange(3, "id").write.parquet(str(tmp_path / "p"))
    parquet = readers.with_positions(readers.read_parquet(spark, str(tmp_path / "p"))).collect()
    assert all(r["id"] == r["_id"] for r in parquet) and len(parquet) == 25


def test_concat_unites_shapes_and_names_sources(spark, file, tmp_path):
    a, b = file("a.jsonl", '{"x": 1}\n'), file("b.jsonl", '{"x": 2, "y": "t"}\n')
    c = file("c.csv", "y,z\nu,v\n")
    rows = dicts(readers.concat_datasets(spark, [a, b, c]))
    by_source = {r["source"].rsplit("/", 1)[-1]: (r["x"], r["y"], r["z"]) for r in rows}
    assert by_source == {"a.jsonl": (1, None, None), "b.jsonl": (2, "t", None), "c.csv": (None, "u", "v")}


def resolved(spark, entries, **options):
    rows = catalogue.with_flags(catalogue.with_defaults(catalogue.catalogue_table(spark, entries), **options))
    return {r["name"]: r for r in dicts(rows)}


def test_catalogue_defaults(spark):
    rows = resolved(spark, {
        "both": {"hf_hub_url": "o/a", "ms_hub_url": "m/a", "file_name": "f.json"},
        "second": {"ms_hub_url": "m/a", "formatting": "sharegpt", "tags": {"user_tag": "me"}},
        "local": {"file_name": "f.json", "columns": {"prompt": "q", "query": "c", "response": "a"}, "split": "dev"},
        "plain": {"file_name": "f.jsonl", "columns": {"prompt": "text"}},
        "field": {"file_name": "f.json", "columns": {"instruction": "i", "output": "o"}, "input_field": "x"},
        "chosen": {"file_name": "f.json", "ranking": True,
                   "columns": {"messages": "m", "kto_tag": "k", "images": "i", "videos": "v", "audios": "a", "tools": "t"}},
    })
    assert (rows["both"]["source"], rows["both"]["path"], rows["both"]["label"]) == ("huggingface", "o/a", "hf")
    assert rows["both"]["columns"] == {"instruction": "instruction", "input": "input", "output": "output"}
    assert rows["both"]["tags"] is None and rows["both"]["has_input"] and rows["both"]["split"] == "train"
    assert (rows["second"]["source"], rows["second"]["label"]) == ("modelscope", "local")
    assert rows["second"]["columns"] == {"messages": "conversations"}
    assert rows["second"]["tags"] == {
        "role_tag": "from", "content_tag": "value", "user_tag": "me", "assistant_tag": "gpt", "system_tag": "system"
    }
    assert rows["local"]["has_input"] and rows["local"]["split"] == "dev"
    assert rows["plain"]["formatting"] == "text" and rows["plain"]["has_input"] is None
    assert rows["field"]["has_input"]
    flags = ("ranking", "kto", "has_images", "has_videos", "has_audios", "has_tools")
    assert all(rows["chosen"][f] for f in flags) and not any(rows["local"][f] for f in flags)


def test_strict_catalogue(spark):
    rows = resolved(spark, {
        "plain": {"file_name": "f.jsonl", "columns": {"prompt": "text"}},
        "query": {"file_name": "f.jsonl", "columns": {"prompt": "a", "query": "b", "response": "c"}},
    }, strict_columns=True)
    assert rows["plain"]["formatting"] == "alpaca"
    assert not rows["query"]["has_input"]


def test_entry_without_source_raises(spark):
    with pytest.raises(PySparkException, match="dataset 'x' names neither"):
        resolved(spark, {"x": {"formatting": "alpaca"}})


def test_entries_file(spark, file):
    path = file("info.json", json.dumps({"d": {"file_name": "d.json", "columns": {"prompt": "p"}}}))
    assert catalogue.catalogue_table(spark, catalogue.load_entries(path)).first()["columns"] == {"prompt": "p"}


def test_load_mixture(spark, file, tmp_path):
    file("data/one.json", '[{"a": "x", "l": ["m", {"text": "n"}]}, {"a": null}]')
    file("data/two.jsonl", '{"q": 1}\n\n{"q": 2}\n{"q": 3}\n')
    file("data/three.csv", "a,b\n1,\n")
    file("data/four.txt", "line\n\nlast\n")
    spark.createDataFrame([(1, "v", "s1", "train"), (2, "w", "s1", "test"), (3, "x", "s2", "train")],
                          "k int, t string, subset string, split string").write.partitionBy(
        "subset", "split").parquet(str(tmp_path / "hub/org/five/en"))
    entries = {
        "one": {"file_name": "one.json"}, "two": {"file_name": "two.jsonl", "num_samples": 2},
        "three": {"file_name": "three.csv"}, "four": {"file_name": "four.txt"},
        "five": {"hf_hub_url": "org/five", "folder": "en", "subset": "s1"},
    }
    loaded = mixtures.load_mixture(spark, entries, root=str(tmp_path / "data"), hub_root=str(tmp_path / "hub"))
    rows = loaded.filter("dataset <> 'five'").select("dataset", F.to_json("record").alias("record")).collect()
    got = sorted(((r["dataset"], json.loads(r["record"])) for r in rows), key=str)
    assert [r["text"] for n, r in got if n == "four"] == ["", "last", "line"]
    assert ("one", {"a": "x", "l": ["m", {"text": "n"}]}) in got and ("one", {"a": None, "l": None}) in got
    assert [r for n, r in got if n == "two"] == [{"q": 1}, {"q": 2}]
    assert [r for n, r in got if n == "three"] == [{"a": "1", "b": ""}]
    five = loaded.filter("dataset = 'five'").select(F.try_variant_get("record", "$.k", "int").alias("k")).collect()
    assert [r["k"] for r in five] == [1]
    limited = mixtures.load_mixture(spark, entries, ["four"], root=str(tmp_path / "data"), max_samples=1)
    assert limited.select(F.to_json("record")).first()[0] == '{"text":"line"}'


def test_load_mixture_errors(spark, file, tmp_path):
    base = str(tmp_path)
    file("a.xml", "x")
    with pytest.raises(ValueError, match="no reader for files"):
        mixtures.load_mixture(spark, {"a": {"file_name": "a.xml"}}, root=base)
    with pytest.raises(FileNotFoundError):
        mixtures.load_mixture(spark, {"a": {"file_name": "gone.json"}}, root=base)
    with pytest.raises(ValueError, match="nope"):
        mixtures.load_mixture(spark, {"a": {"file_name": "gone.json"}}, ["nope"], root=base)
    with pytest.raises(ValueError, match="hub_root"):
        mixtures.load_mixture(spark, {"a": {"ms_hub_url": "o/a"}}, root=base)


def test_local_files_beside_the_catalogue_or_in_data(spark, file, tmp_path, monkeypatch):
    spark.range(1).write.json(str(tmp_path / "x.jsonl"))
    loaded = mixtures.load_mixture(spark, {"a": {"file_name": str(tmp_path / "x.jsonl")}}, row_ids=True)
    assert loaded.columns == ["dataset", "record", "_id"] and loaded.count() == 1


def test_prepare_datasets(spark, file, tmp_path):
    file("chat.jsonl", "".join(json.dumps({"conversations": [{"from": "human", "value": f"q{i}"}]}) + "\n" for i in range(30)))
    file("ask.json", json.dumps([{"instruction": f"i{i}", "input": "", "output": "o"} for i in range(21)]))
    entries = {"chat": {"file_name": "chat.jsonl", "formatting": "sharegpt"}, "ask": {"file_name": "ask.json"}}
    train, test = prepare.prepare_datasets(spark, entries, root=str(tmp_path), max_samples=20)
    assert (train.count(), test.count()) == (36, 4)
    texts = {r["text"] for r in train.unionByName(test).collect()}
    assert len(texts) == 40 and {f"User: q{i}" for i in range(20)} < texts
    _, tail = prepare.prepare_datasets(spark, entries, ["ask", "chat"], root=str(tmp_path), test_size=5, shuffle=False)
    assert {r["text"] for r in tail.collect()} == {f"User: q{i}" for i in range(25, 30)}
    everything, none = prepare.prepare_datasets(spark, entries, ["chat"], root=str(tmp_path), test_size=0)
    assert none is None and everything.count() == 30


def test_prepare_table(spark):
    df = spark.range(10).withColumn("body", F.concat(F.lit("t"), "id"))
    train, test = prepare.prepare_table(df, "id", text_field="body", test_size=3)
    assert (train.count(), test.count()) == (7, 3)
    templated, _ = prepare.prepare_table(
        df, "id", template="{instruction}!{output}", instruction_field="body", output_field="body",
        test_size=0, shuffle=False, max_samples=2,
    )
    assert {r["text"] for r in templated.collect()} == {"t0!t0", "t1!t1"}


def test_second_hub_entry_reads_the_mirror(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "o/a"))
    loaded = mixtures.load_mixture(spark, {"a": {"ms_hub_url": "o/a"}}, hub_root=str(tmp_path))
    assert loaded.count() == 2


def test_write_metrics_replaces(spark, tmp_path):
    path = str(tmp_path / "m")
    for value in (0.5, 0.25):
        sinks.write_metrics(spark.createDataFrame([(value,)], "bleu double"), path)
    assert dicts(spark.read.json(path)) == [{"bleu": 0.25}]


def test_append_metrics_stamps_and_keeps(spark, tmp_path):
    path = str(tmp_path / "m")
    for step in (1, 2):
        sinks.append_metrics(spark.createDataFrame([(step, 0.5)], "step int, loss double"), path)
    rows = sorted(dicts(spark.read.json(path)), key=lambda r: r["step"])
    assert [r["step"] for r in rows] == [1, 2] and all("T" in r["timestamp"] for r in rows)


def test_write_splits_prunes(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_splits(spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train")), path)
    test = spark.read.parquet(path).filter("split = 'test'")
    assert test.count() == 3
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString()


def test_first_list_is_that_of_each_file(spark, file):
    file("d/a.json", '{"v": 1, "rows": [{"k": 1}], "more": [{"k": 9}]}')
    file("d/b.json", '{"more": [{"k": 2}, {"k": 3}], "rows": [{"k": 8}]}')
    path = file("d/c d.json", '{"n": {"k": [1]}, "rows": [{"k": 4}]}').rsplit("/", 1)[0]
    assert sorted(r["k"] for r in readers.read_json_root(spark, f"{path}/*").collect()) == [1, 2, 3, 4]


def test_json_lines_in_a_json_file(spark, file):
    path = file("l.json", '\n{"k": 1}\n{"k": 2, "m": "x"}\n')
    assert sorted(r["k"] for r in readers.read_file(spark, path).collect()) == [1, 2]
    loaded = mixtures.load_mixture(spark, {"l": {"file_name": path}})
    assert loaded.count() == 2
    pretty = file("o.json", '{\n "k": 1\n}\n')
    assert readers.read_json(spark, pretty).collect()[0]["k"] == 1
    file("both/a.json", '[{"k": 1}]')
    both = file("both/b.json", '{"k": 2}\n').rsplit("/", 1)[0]
    with pytest.raises(ValueError, match="apart"):
        readers.read_json(spark, both)


def test_absent_split_raises(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.range(3).write.parquet(path)
    assert mixtures.read_partitioned(spark, path).count() == 3
    with pytest.raises(ValueError, match="no split"):
        mixtures.read_partitioned(spark, path, split="validation")


def test_origin_of_encoded_paths(spark, tmp_path):
    path = str(tmp_path / "s p+q")
    spark.range(2).write.parquet(path + "/x.parquet")
    found = readers.concat_datasets(spark, [path + "/x.parquet"], source="origin").select("origin").distinct().collect()
    assert [r["origin"] for r in found] == [path + "/x.parquet"]
