"""The pipeline and the registered queries."""

import collections
import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from lakewright.llm import exact, mixing, neardup, quality, sampling
from lakewright.llm.queries import QUERIES, SQL
from lakewright.sources.tables import TABLES
from tests.llm.helpers import collected
from tests.llm.test_chunks import groups
from tests.llm.test_neardup import plain as near_plain

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    found = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in found) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in found and set(QUERIES) <= set(found) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("key", sorted(SQL))
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_queries_match_their_sql(spark, key, folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = QUERIES[key](spark, folder).toPandas(), con.execute(SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = list(got.columns)
    by = [c for c in ("item_id", "rank", "conv_id", "vec_id", "doc_id") if c in columns]
    got, want = (x[columns].sort_values(by, ignore_index=True) for x in (got, want))
    assert got.equals(want.astype(got.dtypes))


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_a_row_per_document(spark, documents, key):
    rows = collected(QUERIES[key](spark, FOLDER))
    assert sorted(r["doc_id"] for r in rows) == sorted(r.doc_id for r in documents.collect())


def test_stages_against_plain_counterparts(spark, documents, labels):
    docs = documents
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema) if n < 4 else stage(spark, docs, FOLDER)
        after = [r.asDict() for r in docs.collect()]
        if n < 4:
            assert docs.columns == columns
            assert {r["doc_id"]: r for r in after}.items() <= {r["doc_id"]: r for r in before}.items()
        rows = [(r["doc_id"], r["text"]) for r in before]
        if n == 0:
            verdicts = {r["doc_id"]: r["kept"] for r in collected(quality.assess(documents, quality.fit(documents, labels)))}
            want = [k for k, kept in verdicts.items() if kept]
        elif n == 1:
            want = [min(g)[2] for g in groups(rows).values()]
        elif n == 2:
            want = [k for k, (_, root) in near_plain(rows, 80).items() if k == root]
        elif n == 3:
            taken = {r["doc_id"]: r for r in collected(mixing.mix(spark.createDataFrame(before, documents.schema)))}
            want = [k for k, r in taken.items() for _ in range(r["taken"] // max(1, r["size"]))]
        else:
            want = [k for k, _ in rows]
            lattice_texts = {r["doc_id"]: r["text"] for r in collected(sampling.decode(docs))}
            assert lattice_texts == dict(rows) and all(r["lossless"] for r in after)
        assert collections.Counter(r["doc_id"] for r in after) == collections.Counter(want), name
    run = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.ids) for r in run.collect()) == sorted((r["doc_id"], r["ids"]) for r in after)


def test_stages_take_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    for name, docs in (("odd", odd), ("nothing", nothing)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, FOLDER)
            path = str(tmp_path / f"{name}-{n}")
            out.write.parquet(path)
            if n < 4:
                assert out.columns == odd.columns
                docs = spark.read.schema(out.schema).parquet(path)
        assert spark.read.schema(out.schema).parquet(path).count() == docs.count()
        assert (docs.count() > 0) == (name == "odd")
