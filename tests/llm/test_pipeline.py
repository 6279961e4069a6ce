"""The corpus pipeline, stage by stage, against brute force."""

from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import packing, quality_rules, toxicity
from tests.llm.test_operators import naive_counts, naive_groups, naive_hits
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.columns == columns
        kept = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            source = spark.read.parquet(f"{SF}/documents.parquet")
            machine = toxicity.learn(source, spark.read.parquet(f"{SF}/labels.parquet"))
            score = toxicity.Scorer(machine)
            want = {i for i, t in before.items() if score(t) < 0.5}
        elif name == "quality rules":
            judge = quality_rules.make_judge()
            counts = {i: naive_counts(t) for i, t in before.items()}
            want = {i for i, t in before.items() if counts[i][0] >= 50 and 100 * counts[i][4] <= 50 * counts[i][0] and judge(t)[4]}
        elif name == "n-gram Jaccard join":
            want = {i for i, (_, g) in naive_groups(before).items() if g == i}
        else:
            want = {i for i, t in before.items() if not naive_hits(t or "", bench)[1]}
            assert len(want) < len(before)
        assert set(kept) == want, name
        before = kept
    t = Tokenizer.from_file(packing.default_tokenizer())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.length for r in pieces) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in before.values())


def test_pipeline_on_no_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
    assert docs.count() == 0


def test_no_packed_document_holds_a_benchmark_window(spark, tmp_path):
    """A long document that quotes one item word for word goes; those that quote less than a window stay."""
    words = [f"w{i * 7919 % 10007}" for i in range(3000)]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = next(r.text for r in bench.collect() if len((r.text or "").split()) >= 20).split()
    texts = [" ".join(words), " ".join(words[:1500] + item + words[1500:]), " ".join(words[:9] + item[:12] + words[9:])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_registry_runs_the_pipeline(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert sum(name.startswith("op") and name[2].isdigit() for name in entry.queries()) == 10
