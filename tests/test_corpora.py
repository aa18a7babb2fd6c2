import json
import os

import cardmill
import pytest
from cardmill.contracts.shapes import record, text
from cardmill.operators import registry
from cardmill.operators.defaults import apply_defaults, defaults_of
from cardmill.operators.lookup import fits_broadcast, lookup_join
from cardmill.plans.corpus import table
from cardmill.plans.process import process_cards
from cardmill.sources import cards as card_sources
from pyspark.sql import functions as F


def test_shuffled_join_gives_the_same_rows_for_a_hot_key(spark):
    facts = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id) END AS k"
    )
    lookup = facts.filter("k IS NOT NULL AND id % 2 = 0").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("left", "inner", "left_anti", "left_semi"):
        joins = [lookup_join(facts, lookup, ["k"], how, shuffle=s) for s in (False, True)]
        small, large = (sorted(map(tuple, join.select(*joins[0].columns).collect()), key=str) for join in joins)
        assert small == large
        plan = joins[1]._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan


def test_broadcast_is_measured(spark):
    lookup = spark.range(100).selectExpr("id", "repeat('x', 100) AS wide")
    assert fits_broadcast(lookup)
    assert not fits_broadcast(lookup, rows=99)
    assert not fits_broadcast(lookup, size=5000)


def test_a_task_gets_a_bounded_part_of_a_large_table(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "orders.parquet")
    spark.range(200_000, numPartitions=1).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).write.parquet(path)
    size = sum(os.path.getsize(os.path.join(path, file)) for file in os.listdir(path) if file.endswith(".parquet"))
    monkeypatch.setattr(card_sources, "TASK_BYTES", 64 * 1024, raising=False)
    dealt = [table(spark, str(tmp_path), "orders"), card_sources.spread(spark.read.parquet(path), size // 2)]
    counts = [[r["count"] for r in t.groupBy(F.spark_partition_id()).count().collect()] for t in dealt]
    assert max(counts[0]) <= 1.1 * 200_000 * 64 * 1024 / size and sum(counts[0]) == 200_000
    assert counts[1] == [200_000]


def test_repeated_registry_rows_need_an_order(spark):
    schema = '{"$id": "v%d", "properties": {"Model": {}}, "$defs": {"model": {}}}'
    sparse = '{"$id": "sparse"}'
    registry = spark.createDataFrame(
        [("model", "base", sparse, 1), ("model", "url", schema % 9, 1), ("model", "url", schema % 10, 2),
         ("model", "bad", "{}", 1)],
        "card_type string, source string, raw string, loaded int",
    ).select("card_type", "source", F.parse_json("raw").alias("document"), "loaded")
    cards = spark.createDataFrame(
        [(1, "model", None), (2, "model", "url"), (3, "dataset", None), (4, "model", "bad")],
        "id int, card_type string, schema_source string",
    )

    def found(**how):
        rows = cardmill.resolve_schema(cards, registry, **how).orderBy("id").collect()
        return [(r.id, r.schema_text, r.schema_version, r.schema_found) for r in rows]

    rest = [(3, "Base Schema", "Unknown", False), (4, "Base Schema", "sparse", True)]
    first = (1, "Base Schema", "sparse", True)
    assert found(order="loaded") == [first, (2, "url", "v10", True), *rest]
    assert found() == [first, (2, "Base Schema", "sparse", True), *rest]
    assert found(order="loaded", shuffle=True) == found(order="loaded")


def test_defaults_fill_only_what_is_missing(spark):
    defaults = defaults_of(cardmill.legacy_model())
    assert defaults["Author"] == [{"Name": "", "Email": ""}]
    assert defaults["Date"] == {} and defaults["Repository"] == []
    section = spark.sql("""SELECT parse_json('{"Name": null, "Version": "1", "X": 2}') AS s""")
    filled = json.loads(section.select(F.to_json(apply_defaults(F.col("s"), defaults))).first()[0])
    assert filled["Name"] is None and filled["Version"] == "1" and filled["X"] == 2
    assert filled["Funding"] == "" and set(filled) == set(defaults) | {"X"}


def test_exports_round_trip(spark, cards_of, tmp_path):
    card = {"Model": {"Name": "m", "Input": "in"}}
    loaded = cardmill.load_section(
        cardmill.classify(cards_of(("a.json", json.dumps(card)), ("b.json", json.dumps(card))))
    )
    nested, flat = str(tmp_path / "nested"), str(tmp_path / "flat")
    none = [cardmill.export_nested(loaded, nested, family="FAM", day="2025-01-02"),
            cardmill.export_flat(loaded, flat, day="2025-01-02")]
    assert [x.count() for x in none] == [0, 0]
    (folder,) = {f.parent.relative_to(tmp_path / "nested").parts for f in (tmp_path / "nested").rglob("part-*")}
    assert folder == ("card_type=model", "export_date=2025-01-02")
    written = [json.loads(r.value) for r in spark.read.text(nested).collect()]
    assert written == [{"$schema": "FAM-model-2025-05.json"} | card] * 2
    lines = spark.read.text(flat).collect()
    assert [json.loads(r.value)["model_architecture"] for r in lines] == ["in", "in"]


def test_no_card_is_invented_or_lost(spark, cards_of, tmp_path):
    cards = cards_of(
        ("a.json", '{"Model": {"Name": "m", "Results": "text"}}'), ("b.json", '{"Model": {"Name": "n"}}'),
        ("c.txt", '{"model_name": "x", "results": "text"}'), ("d.json", "[1]"),
    )
    loaded = cardmill.load_section(cardmill.classify(cards))
    for kind, fates in (
        ("nested", {"c.txt": "no_section", "d.json": "unknown_type"}),
        ("flat", {"a.json": "not_mappable", "c.txt": "no_section", "d.json": "unknown_type"}),
    ):
        path = str(tmp_path / kind)
        export = cardmill.export_flat if kind == "flat" else cardmill.export_nested
        refused = export(loaded, path, **({} if kind == "flat" else {"family": "FAM"}))
        assert {r.file_name: r.refusal for r in refused.collect()} == fates
        assert spark.read.text(path).count() == 4 - len(fates)


def test_day_of_an_export_is_that_of_utc(spark):
    from cardmill.sinks.exports import utc_day

    moment = spark.sql("SELECT timestamp'2025-01-02 23:30:00-05:00' AS t")
    assert moment.select(utc_day(F.col("t"))).first()[0] == "2025-01-03"
    assert spark.range(1).select(utc_day() == F.date_format(F.current_timestamp(), "yyyy-MM-dd")).first()[0]


def test_preview_is_indented_like_a_script_does(spark):
    value = {"a": [], "b": {}, "c": [1, {"d": "x,[\"{\\\\"}], "e": {"f": {"g": None}}, "h": "y" * 30000}
    value["long"] = [[i] for i in range(600)]
    row = spark.createDataFrame([(json.dumps(value),), (None,)], "raw string")
    shown = [r[0] for r in row.select(cardmill.preview_json(F.parse_json("raw"))).collect()]
    assert shown == [json.dumps(value, indent=2, sort_keys=True), None]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    source = tmp_path / "cards"
    source.mkdir()
    for i in range(6):
        raw = json.dumps({"dataset_name": f"d{i}"}) if i % 3 else "broken"
        (source / f"card {i}.txt").write_text(raw)
    shapes = {"dataset": record({"Name": text(pattern="[24]")}, closed=False)}
    columns = ("file_name", "card_type", "error_count", "reject_reason")
    batch = process_cards(cardmill.read_cards(spark, str(source)), shapes).select(*columns)
    stream = process_cards(cardmill.card_stream(spark, str(source)), shapes).select(*columns)
    out, commits = str(tmp_path / "out"), str(tmp_path / "commits")
    cardmill.write_card_stream(stream, out, commits).awaitTermination()
    # Started again, the stream takes no file twice.
    cardmill.write_card_stream(stream, out, commits).awaitTermination()
    streamed = spark.read.parquet(out)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    assert streamed.count() == 6


def test_missing_fields_are_filled_on_the_way(cards_of):
    shape = {"dataset": record({"Name": text(min_length=1), "Comments": text()}, closed=False)}
    cards = cards_of(("a.json", '{"Dataset": {"Comments": "c"}}'))
    plain, filled = (process_cards(cards, shape, fill=fill).first() for fill in (False, True))
    assert [v.keyword for v in plain.violations] == []
    assert [(v.path, v.keyword) for v in filled.violations] == [("$.Name", "minLength")]


@pytest.mark.parametrize("most", [1, 3, 200])
def test_any_number_of_schemas(spark, monkeypatch, most):
    """Groups of schemas, one run, and a registry of which cards use a part give the same."""
    monkeypatch.setattr(registry, "MOST_SCHEMAS", most)
    text = (
        '{"$id":"%s","properties":{"Model":{"$ref":"#/$defs/model"},"Dataset":{}},"$defs":{"dataset":{},'
        '"model":{"properties":{"n":{"maximum":%d}%s}}}}'
    )
    rows = [("model", f"s{i}", text % (i, i, "")) for i in range(6)] + [("model", "same", text % (1, 1, ""))]
    rows += [("model", "odd", text % (7, 7, ',"m":{"unknown":1}')), ("model", "base", text % ("b", 100, ""))]
    known = spark.createDataFrame(rows, "card_type string, source string, raw string")
    known = known.selectExpr("card_type", "source", "try_parse_json(raw) AS document")
    named = [(i, "model", source) for i, source in enumerate(["s1", "s2", "s2", "s5", "same", "odd", "none", None])]
    cards = spark.createDataFrame([*named, (8, "other", "s1")], "id long, card_type string, schema_source string")
    cards = cards.selectExpr("*", "parse_json('{\"Model\":{\"n\":3}}') AS doc")
    told = registry.check_by_registry(cards, known).select("id", "error_count", "contract_read", "is_custom").collect()
    assert sorted(map(tuple, told)) == [
        (0, 1, True, True), (1, 1, True, True), (2, 1, True, True), (3, 0, True, True), (4, 1, True, True),
        (5, None, False, True), (6, 0, True, False), (7, 0, True, False), (8, None, False, False),
    ]


def test_a_registry_is_read_for_each_batch(spark, tmp_path):
    """A schema that was added between two batches counts for the later cards only; no card is taken twice."""
    text = '{"$id":"v","properties":{"Model":{"$ref":"#/$defs/model"},"Dataset":{}},"$defs":{"dataset":{},"model":{"properties":{"n":{"maximum":%d}}}}}'
    folder, out, commits = (str(tmp_path / name) for name in ("cards", "out", "commits"))
    known = [("model", "base", text % 100), ("model", "a", text % 1)]

    def rows():
        return spark.createDataFrame(known, "card_type string, source string, raw string").selectExpr(
            "card_type", "source", "try_parse_json(raw) AS document"
        )

    schema = "id long, card_type string, schema_source string"
    for lot in range(2):
        spark.createDataFrame([(2 * lot, "model", "a"), (2 * lot + 1, "model", "b")], schema).write.mode("append").parquet(folder)
        cards = spark.readStream.schema(schema).parquet(folder).selectExpr("*", "parse_json('{\"Model\":{\"n\":3}}') AS doc")
        for _ in range(2):
            cardmill.check_stream_by_registry(cards, rows, out, commits, columns=("id", "error_count", "is_custom")).awaitTermination()
        known.append(("model", "b", text % 2))
    told = spark.read.parquet(out).select("id", "error_count", "is_custom").collect()
    assert sorted(map(tuple, told)) == [(0, 1, True), (1, 0, False), (2, 1, True), (3, 1, True)]


def test_a_streamed_intake_summary_goes_on_after_a_stop(spark, tmp_path):
    source, out, commits = tmp_path / "cards", str(tmp_path / "out"), str(tmp_path / "commits")
    source.mkdir()
    for lot in range(3):
        for i in range(4):
            (source / f"{lot} {i}.txt").write_text(json.dumps({"dataset_name": "d"}) if i % 2 else "broken")
        (source / f"{lot}.json").write_text(json.dumps({"Model": {"n": lot}}))
        stream = cardmill.intake_summary(cardmill.classify(cardmill.card_stream(spark, str(source))))
        cardmill.write_summary_stream(stream, out, commits).awaitTermination()
        batch = cardmill.intake_summary(cardmill.classify(cardmill.read_cards(spark, str(source))))
        told = cardmill.read_summary(spark, out, ("cards",))
        assert sorted(map(str, told.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_files_are_landed_once_and_packed(spark, tmp_path):
    """Files that are older than those landed before count too; a run that meets nothing new changes nothing."""
    source, table, commits = tmp_path / "cards", str(tmp_path / "table"), str(tmp_path / "commits")
    (source / "below").mkdir(parents=True)
    want = {}
    for lot in range(3):
        for i in range(40):
            name = f"{lot} {i}+ä.txt"
            content = "" if i == 0 else " \n" if i == 1 else json.dumps({"dataset_name": "d" * i}) + "\n"
            path = source / ("below" if i % 2 else ".") / name
            path.write_text(content)
            if content:  # a file without a byte has no row, as in read_cards
                want[name] = content
            os.utime(path, (1_700_000_000 - lot * 10_000_000,) * 2)
        for _ in range(2):
            cardmill.land_cards(spark, str(source), table, commits, files_per_batch=25).awaitTermination()
        landed = cardmill.landed_cards(spark, table)
        assert {row.file_name: row.raw for row in landed.collect()} == want and landed.count() == len(want)
    assert landed.filter("file_size <> octet_length(raw) OR modified IS NULL OR NOT file_path LIKE '%.txt'").count() == 0
    assert len(list((tmp_path / "table").glob("batch=*"))) == 6
    cards = cardmill.cards_from_table(landed, "raw", "file_name")
    assert cards.filter("parse_ok").count() == len(want) - 3

    # As after a stop between writing the last batch and noting it: the batch is done again, in place of its own.
    for note in ("5", ".5.crc"):
        (tmp_path / "commits" / "commits" / note).unlink(missing_ok=True)
    cardmill.land_cards(spark, str(source), table, commits, files_per_batch=25).awaitTermination()
    landed = cardmill.landed_cards(spark, table)
    assert {row.file_name: row.raw for row in landed.collect()} == want and landed.count() == len(want)

    # One task for all files where a group takes them.
    one = str(tmp_path / "one")
    spark.conf.set("spark.sql.files.minPartitionNum", "64")
    try:
        cardmill.land_cards(spark, str(source), one, str(tmp_path / "other"), open_bytes=1).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len(list((tmp_path / "one").glob("batch=0/*.parquet"))) <= spark.sparkContext.defaultParallelism + 1


def test_the_schema_of_the_time(spark):
    text = '{"$id":"%s","properties":{"Dataset":{},"Model":{"$ref":"#/$defs/model"}},"$defs":{"dataset":{},"model":{"properties":{"n":{"maximum":%d}}}}}'
    rows = [("a", 10, text % ("a10", 5)), ("a", 20, text % ("a20", 1)), ("a", 15, "{"), ("a", 30, text % ("a30", 4))]
    rows += [("a", 30, text % ("a31", 2)), ("b", None, text % ("b", 9)), ("b", 20, text % ("b20", 1))]
    rows += [("base", 12, text % ("base12", 0)), ("base", 22, text % ("base22", 7))]
    known = spark.createDataFrame(rows, "source string, since int, raw string").selectExpr(
        "'model' AS card_type", "source", "since", "try_parse_json(raw) AS document"
    )
    dates = [("a", 9), ("a", 10), ("a", 19), ("a", 20), ("a", 99), ("a", None), ("b", 1), ("b", 20), ("c", 11), ("c", 12)]
    dates += [(None, 50), ("c", None), ("b", None)]
    cards = spark.createDataFrame([(i, *d) for i, d in enumerate(dates)], "id int, schema_source string, `card date` int")
    cards = cards.selectExpr("*", "'model' AS card_type", "parse_json('{\"Model\":{\"n\":3}}') AS doc")
    want = ["Unknown", "a10", "a10", "a20", "a31", "a31", "b", "b20", "Unknown", "base12", "base22", "base22", "b20"]
    top = {"a10": 5, "a20": 1, "a31": 2, "b": 9, "b20": 1, "base12": 0, "base22": 7}
    for shuffle in (None, True):
        told = registry.resolve_schema(cards, known, order="since", at="card date", shuffle=shuffle)
        assert [row.schema_version for row in told.orderBy("id").collect()] == want
    checked = registry.check_by_registry(cards, known, order="since", at="card date").orderBy("id").collect()
    assert [row.schema_version for row in checked] == want
    assert [row.error_count for row in checked] == [None if v == "Unknown" else int(3 > top[v]) for v in want]
    assert [row.is_custom for row in checked] == [v[0] in "ab" and not v.startswith("base") for v in want]
    with pytest.raises(ValueError):
        registry.resolve_schema(cards, known, at="card date")
