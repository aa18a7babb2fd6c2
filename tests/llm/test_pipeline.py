import corpus_pipeline
from cardmill.llm.line_dedup import remove_repeated_runs
from cardmill.llm.packing import pack_documents
from cardmill.llm.secrets import masked
from cardmill.llm.simhash import fingerprint_of, keep_first_of_each
from cardmill.llm.toxicity import fresh_model, score_documents
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_packing import PATH
from test_toxicity import BAD, corpus


def write(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_against_brute_force(spark, docs_of, tmp_path):
    rows = [(i, t) for i, t, _ in corpus(300, 5)]
    extra = ["one two three four five six", "one two three four five six", "a\nb\nc", "x\na\nb\nc", "my token=abcdefgh12", "", None]
    docs = docs_of(*rows, *[(1000 + i, t) for i, t in enumerate(extra)]).withColumn("_score", F.lit(1))
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in corpus(300, 5)], "doc_id long, toxic int, quality int")
    sf_dir = write(spark, tmp_path, docs, labels)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    held = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in held.collect()]
        made = stage(spark, held, sf_dir)
        path = f"{tmp_path}/{number}"
        made.write.parquet(path)
        made = spark.read.parquet(path)
        if name == "best_fit_packing":
            assert made.count() == pack_documents(held, PATH).count()
            break
        assert made.columns == docs.columns
        after = {r.doc_id: r.text for r in made.collect()}
        if name == "toxicity":
            wrong = [i for i, t in before if (i in after) == (t is not None and any(b in t for b in BAD))]
            assert len(wrong) <= 10
        elif name == "line_dedup":
            assert after == {i: t for (i, _), t in brute_lines(before, 3).items()}
        elif name == "simhash_near_dedup":
            groups = {}
            for i, t in sorted(before):
                f = fingerprint_of((t or "").encode()) & (1 << 64) - 1
                near = [g for g in groups if any((f ^ x).bit_count() <= 2 for x in groups[g])]
                groups[min([i, *near])] = [f] + [x for g in near for x in groups.pop(g)]
            assert set(after) == set(groups)
        else:
            assert after == {i: None if t is None else masked(t) for i, t in before}
        held = made


def test_run_and_empty_tables(spark, docs_of, empty, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "none", empty, labels)).count() == 0
    some = write(spark, tmp_path / "some", docs_of("a b", "c d", None), labels)
    assert corpus_pipeline.run(spark, some).agg(F.countDistinct("doc_id")).first()[0] == 3
    assert remove_repeated_runs(empty).columns == empty.columns


def test_texts_go_to_python_in_small_batches(spark, docs_of):
    """Each step that hands whole texts to Python lowers the size of a batch; a smaller setting stays."""
    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", docs_of("a b c d", None)
    before = spark.conf.get(name)
    steps = [remove_repeated_runs, keep_first_of_each, lambda d: score_documents(d, fresh_model())]
    try:
        for step in steps:
            for given, want in (("10000", "1000"), ("0", "1000"), ("7", "7")):
                spark.conf.set(name, given)
                assert step(docs).count() == 2 and spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
