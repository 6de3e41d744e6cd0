"""The pipeline's stages one after the other against plain Python, and its registration."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from pathloom.llm import quality
from tests.llm.test_duplicates import roots, shingle_set
from tests.llm.test_texts import affected, plain_dedup

DATA = Path("/root/testdata/sf0.001")


def test_registration():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert len({n.split("_")[0] for n in names}) == 11
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns = docs.columns
    items = [(r[0], r[1]) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).select("item_id", "text").collect()]
    chain = quality.learn(docs, spark.read.parquet(str(DATA / "labels.parquet")))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = dict(zip(rows, quality.score_batches(chain, list(rows.values())), strict=True))
    rows = {i: t for i, t in sorted(rows.items()) if scores[i] >= 0.3}
    rows = {i: t for i, t in plain_dedup(list(rows.items())).items() if t or not rows[i]}
    sets = {i: shingle_set(t, 5) for i, t in rows.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    up = roots(list(sets), links)
    rows = {i: t for i, t in rows.items() if up[i] == i}
    rows = {i: t for i, t in rows.items() if not affected(t, items, 13)}
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(DATA)).cache()
        assert state.columns == columns, name
    assert {r["doc_id"]: r["text"] for r in state.collect()} == rows
    assert corpus_pipeline.run(spark, str(DATA)).count() == len(rows)


def test_stages_with_odd_rows(spark):
    """Null, empty, very long and repeated texts, null ids, clashing names and empty tables, through every stage."""
    long = " ".join(f"w{k % 977}" for k in range(40_000))
    passage = "\n".join(f"shared line number {k} with some words of its own" for k in range(9))
    item = " ".join(f"b{k}" for k in range(30))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "no id here"), (4, passage), (5, passage), (6, f"own words\n{passage}"), (7, "x " * 900 + item), (8, "a b c d e f g h")]
    schema = "doc_id long, text string, _n_removed string, n_words int, component_id long"
    docs = spark.createDataFrame([(i, t, "r", 1, 2) for i, t in rows], schema)
    folder = str(spark.conf.get("spark.checkpoint.dir")) + "/odd"
    spark.createDataFrame([(k, k % 2, 0) for k in range(20, 60)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def ids(frame):
        return sorted(((r["doc_id"] or -1) for r in frame.collect()))

    assert stages["quality classifier"](spark, docs, folder).columns == docs.columns  # no labelled texts: the model says nothing
    lines = stages["line dedup"](spark, docs.drop("_n_removed"), folder)
    assert ids(lines) == [-1, 1, 2, 3, 3, 4, 6, 7, 8]  # 5 held nothing but the passage
    assert {r["doc_id"]: r["text"] for r in lines.collect()}[6] == "own words"
    assert ids(stages["MinHash near-dedup"](spark, docs, folder)) == [-1, 1, 2, 3, 3, 4, 7, 8]  # 5 and 6 are near 4
    assert ids(stages["benchmark decontamination"](spark, docs, folder)) == [-1, 1, 2, 3, 3, 4, 5, 6, 8]
    coded = stages["BPE encoding and decoding"](spark, docs, folder).collect()
    assert len(coded) == len(rows) and {r["doc_id"]: r["n_tokens"] for r in coded if r["doc_id"] in (1, 2)} == {1: 0, 2: 0}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    assert stages["benchmark decontamination"](spark, docs, folder).count() == len(rows)


_GIVES_BACK = """
import re
from pathlib import Path
from pathloom.llm.common import held

def mb():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

last = []

def make():
    out = [bytes(2000) for _ in range(50_000)]
    last.append(bytes(2000))
    return out

before = mb()
held("one operator", make)
full = mb()
held("another operator", dict)
assert full - before > 80 and mb() - before < 30, (before, full, mb())
"""


def test_a_worker_gives_the_memory_of_the_last_operator_back():
    """In a process of its own, like a worker; also where something that lives on lies above it in the heap."""
    done = subprocess.run([sys.executable, "-c", _GIVES_BACK], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
