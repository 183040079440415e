from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from archidex.llm import decontam, linededup, simhash, stages
from archidex.session import cut_lineage

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def states(spark):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
        found.append(docs)
    return found


def test_order_and_columns(states):
    assert [s for _, s in corpus_pipeline.STAGES] == [
        stages.known_language, stages.without_repeated_lines, stages.one_of_each_group, stages.without_benchmark, stages.encoded,
    ]
    assert all(d.columns == COLUMNS for d in states[:-1])


def test_each_stage_does_what_its_operator_says(spark, states):
    given, language, lines, distinct, clean, tokens = states
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(language) == ids(given.where("text rlike '[a-zA-Z]'"))
    want = {r.doc_id: r.text for r in linededup.drop_repeated_lines(language).collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    groups = simhash.near_duplicates(lines).collect()
    assert ids(distinct) == {r.doc_id for r in groups if r.doc_id == r.component_id}
    leaks = {r.doc_id for r in decontam.leaks(distinct, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(clean) == ids(distinct) - leaks
    assert {(r.doc_id, r.text) for r in tokens.collect()} == {(r.doc_id, r.text) for r in clean.collect()}
    assert all(r.n_tokens == len(r.ids) for r in tokens.collect())


def test_run_gives_the_last_stage(spark, states):
    key = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(states[-1])


def test_stages_of_odd_documents(spark):
    shown = "the house of the dog is not red and it was a very long time ago"
    rows = [(1, shown), (2, shown), (3, None), (4, ""), (5, "12 34"), (None, "das haus von dem hund ist nicht rot"), (7, shown)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, found int"
    given = spark.createDataFrame([(i, t, "en", "s", 1, "r", 0) for i, t in rows], schema)
    docs = given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.columns == given.columns
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [
        (0, "das haus von dem hund ist nicht rot"), (1, shown), (2, "")
    ]
    empty = given.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_one_row_of_each_group_whatever_the_ids(spark):
    """Rows that share an id are judged by their texts; one of identical rows stays; other columns stay as given."""
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "ABCDE"}
    rows = [(1, "A"), (2, "A"), (2, "B"), (3, "C"), (3, "C"), (None, "B"), (None, "D"), (None, "D"), (5, "E"), (4, "E")]
    schema = "doc_id long, text string, n_dropped string, hash string, id int, key string, n_chars long"
    given = spark.createDataFrame([(i, texts[t], "mine", t, 7, "k", 1) for i, t in rows], schema).repartition(3)
    kept = stages.one_of_each_group(spark, given, SF)
    assert kept.columns == given.columns
    assert sorted(((r.doc_id or 0, r.hash) for r in kept.collect())) == [(0, "D"), (1, "A"), (2, "B"), (3, "C"), (4, "E")]
    lines = stages.without_repeated_lines(spark, given, SF)
    assert lines.columns == given.columns and {(r.n_dropped, r.id, r.key) for r in lines.collect()} == {("mine", 7, "k")}


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """A copy without the llm folders and the pipeline still offers all other queries."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'duplicates' in names and 'pipeline' not in names and not any(n.startswith('op') for n in names)\n"
        "assert set(e.oracle_sql()) == set(names)\n"
    )
    import shutil

    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    shutil.copytree(ROOT / "archidex", copy / "archidex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    subprocess.run([sys.executable, "-c", code, str(copy)], check=True, cwd=tmp_path)
