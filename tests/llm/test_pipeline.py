from __future__ import annotations

import subprocess
import sys

import corpus_pipeline
import pyarrow as pa
from conftest import ROOT, SF_SMALL
from llm.helpers import documents, empty
from pyspark.sql.types import StructType

import __spark_entry__ as E
from ledgerscope.llm import common, decontaminate, jaccard, quality, secrets
from ledgerscope.llm.hashing import materialise
from ledgerscope.llm.queries import ORACLES, QUERIES


def test_each_stage_and_the_run(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF_SMALL), "stage")
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.assess(docs, quality.fit(docs)).where("kept").collect()}
            assert {r["doc_id"] for r in out.collect()} == kept
        elif name == "n-gram Jaccard join":
            assert {r["doc_id"] for r in out.collect()} == {r["component_id"] for r in jaccard.join(docs).collect()}
        elif name == "benchmark decontamination":
            found = {r["doc_id"] for r in decontaminate.find(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
            assert found and {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} - found
        elif name == "secret scans":
            assert out.count() == docs.count()
            assert not any(secrets.base_spans(r["text"]) for r in out.collect())
            assert out.where("n_chars <> length(text)").count() == 0
        if name != "best-fit packing":
            assert out.columns == columns
            docs = out
    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(map(tuple, out.drop("sequence_id", "offset").collect()))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(ORACLES) <= set(E.oracle_sql())


def test_entry_without_the_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('ledgerscope.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as E\n"
        "assert E.queries() and not any(n.startswith('op') for n in E.queries()) and 'pipeline' not in E.queries()\n"
        "assert E.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_queries_run_on_the_small_tables(spark):
    for name in ("op1_token_counts", "op4_toxicity", "op7_language_id", "op8_quality_rules", "op9_best_fit_packing"):
        assert QUERIES[name](spark, SF_SMALL).count() >= 200, name


def test_stages_on_awkward_rows(spark):
    """Null and empty texts, a row without an id, repeated rows, a long text and clashing columns; then no row at all."""
    for docs in (documents(spark), empty(spark)):
        rows = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_SMALL)
            assert docs.columns == empty(spark).columns, name
            docs = materialise(docs, "awkward")
            assert docs.count() <= rows
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        assert (packed.count() == 0) == (docs.count() == 0)


def test_a_step_drops_the_state_of_others():
    """Python workers outlive jobs: no cache of one operator stays while the next one runs."""

    class Table:
        schema = StructType.fromDDL("text string")

        def mapInArrow(self, run, schema):
            return run

    def hold(cols):
        common.worker_state("held", dict)["x"] = 1
        return {"n": [len(common.worker_state("held", dict))]}

    def look(cols):
        return {"n": [int(common._STATE["owner"] == "held")]}

    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    first, second = common.map_batches(Table(), hold, "n long"), common.map_batches(Table(), look, "n long")
    third = common.map_texts(Table(), "text", lambda texts: texts)
    for step in (second, third):
        assert [b.to_pydict() for b in first(iter([batch]))] == [{"n": [1]}]
        assert common._STATE["owner"] == "held"
        (out,) = step(iter([batch]))
        assert common._STATE["owner"] is None and out.to_pydict() in ({"n": [0]}, {"text": ["a"]})


def test_a_step_keeps_its_own_state():
    seen = []

    def run(batches):
        for b in batches:
            common.worker_state("mine", list).append(b)
            seen.append(len(common.worker_state("mine", list)))
            yield b

    one, other = common.tidy(run), common.tidy(run)
    assert list(one(iter([1, 2]))) == [1, 2] and list(one(iter([3]))) == [3] and list(other(iter([4]))) == [4]
    assert seen == [1, 2, 3, 1]


def test_secret_training_runs_one_python_worker_a_task(spark):
    """An executor keeps as many Python workers as ever ran at once: a shuffle parts the two Python steps, and no rows come from Python."""
    plan = secrets.pair_counts(secrets.training_sample(documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Exchange" in plan[plan.index("MapInArrow") : plan.rindex("MapInArrow")]
    assert "LocalTableScan" in plan
    counts = {r["at"]: r["n"] for r in secrets.pair_counts(spark.createDataFrame([("abc", 1), ("abc", 1), ("ab", 0), (None, 1), ("abc", 2), ("abc", None)], "sample string, is_random int")).collect()}
    code, size = secrets._CODE, secrets.N_SYMBOLS
    place = lambda y, a, b: (y * size + code[a]) * size + code[b]
    assert counts == {place(1, "a", "b"): 2, place(1, "b", "c"): 2, place(0, "a", "b"): 1}


def test_stages_take_small_batches_unless_the_session_names_a_number(spark):
    key, default = corpus_pipeline.ARROW_ROWS
    before = spark.conf.get(key)
    try:
        for given, used in ((default, common.ROWS), ("77", 77)):
            for _, stage in corpus_pipeline.STAGES:
                spark.conf.set(key, given)
                stage(spark, empty(spark), SF_SMALL)
                assert int(spark.conf.get(key)) == used
    finally:
        spark.conf.set(key, before)
