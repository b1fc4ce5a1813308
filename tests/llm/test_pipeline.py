"""The pipeline: every stage takes effect, keeps the columns, and agrees with its operator; the entry guard."""

import importlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from playtape.llm import decontam, neardup
from playtape.llm.queries import table, vocabulary

FOLDER = "/root/testdata/sf0.001"


def firsts_of_near_groups(rows):
    """The least id of each component of texts whose sets of five words have a Jaccard of 0.8 or more, by all pairs."""
    sets = [neardup.shingles(r.text and r.text.encode()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if one == sets[j] or both / (len(one) + len(sets[j]) - both) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row.doc_id)
    return {min(ids) for ids in groups.values()}


def test_stages_one_by_one(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        before, ids = docs.count(), {r.doc_id for r in docs.select("doc_id").collect()}
        out.write.parquet(str(tmp_path / f"{i}"))
        after = spark.read.parquet(str(tmp_path / f"{i}"))
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids and 0 < after.count() <= before
        if name == "near_duplicates":
            assert {r.doc_id for r in after.select("doc_id").collect()} == firsts_of_near_groups(docs.select("doc_id", "text").collect())
        if name == "benchmark_decontamination":
            assert after.count() == decontam.contamination(docs, table(spark, FOLDER, "benchmark")).where("not contaminated").count()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        docs = after
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    t = Tokenizer.from_file(vocabulary())
    assert all(r.n_tokens == len(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, docs.collect()))


def test_no_rows_pass_all_stages(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []


def test_entry_registers_each_operator_once():
    names = importlib.import_module("__spark_entry__").queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


def test_entry_works_without_this_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    code = ("import sys; sys.modules['playtape.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import warnings; warnings.simplefilter('ignore')\n"
            "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q")
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
