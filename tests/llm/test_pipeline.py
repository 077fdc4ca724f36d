"""The pipeline on the smallest tables, each stage held against a plain version of its rule on its own input."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm._shared import materialise
from tidemark.llm.queries import tokenizer_path

from test_operators import plain_near

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), name.split()[0].lower()))
    return out


def test_columns_and_shrinking(stages):
    assert [d.columns for d in stages[:-1]] == [corpus_pipeline.COLUMNS] * 5
    n = [d.count() for d in stages]
    assert n[0] > n[1] > n[2] >= n[3] == n[4] == n[5]


def test_quality_keeps_clean_rows(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    rows = labels.select("doc_id", "quality").collect()
    assert sum(r.doc_id in kept for r in rows if r.quality == 1) >= 0.97 * sum(r.quality == 1 for r in rows)


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].select("doc_id", "text").collect()]
    _, root = plain_near(rows)
    assert {r.doc_id for r in stages[2].select("doc_id").collect()} == {i for i, r in root.items() if i == r}


def test_no_window_of_a_benchmark_stays(spark, stages):
    low = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = low(r.text)
        k = min(10, len(w))
        windows |= {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
    before = {r.doc_id: r.text for r in stages[2].collect()}
    hit = lambda t: any(tuple((w := low(t))[a : a + 10]) in windows for a in range(len(low(t)) - 9))
    for r in stages[3].collect():
        assert not hit(r.text) and r.n_chars == len(r.text)
        if not hit(before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_mixture_and_records(stages):
    from tokenizers import Tokenizer

    order = [r.doc_id for r in stages[4].orderBy("_metadata.file_name", "_metadata.row_index").collect()]
    assert sorted(order) == sorted(r.doc_id for r in stages[3].collect())
    records = stages[5].orderBy("start").collect()
    assert [r.doc_id for r in records] == order
    library, text = Tokenizer.from_file(tokenizer_path()), {r.doc_id: r.text for r in stages[4].collect()}
    for r in records:
        assert r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids) + 1


def test_records_follow_files_of_any_number(spark, tmp_path):
    rows = [(f"part-{n}-x.snappy.parquet", i) for i, n in enumerate(("00009", "99999", "100000", "100001", "1000000"))]
    for name, i in rows:
        spark.createDataFrame([(i, f"text {i}", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "one" / name))
        (written,) = (tmp_path / "one" / name).glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        written.rename(tmp_path / "all" / name)
    got = corpus_pipeline.write_tokens(spark, spark.read.parquet(str(tmp_path / "all")), SF).orderBy("start").collect()
    assert [r.doc_id for r in got] == [0, 1, 2, 3, 4]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).agg(F.sum("n_tokens")).first()[0] > 0
