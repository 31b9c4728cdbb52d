"""The pipeline's stages on a small corpus, against what each must do, and the registered queries' oracles."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from evalsieve.llm import entry

from .test_operators import DOCS, bag, documents, edited, prose, weighted_jaccard


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = [prose(s, 60) for s in range(40)]
    bad = [prose(s, 30) + " vile rotten " + prose(s + 500, 30) for s in range(100, 220)]
    texts = base + [t.upper() for t in base[:10]] + [edited(t, 1, 1) for t in base[10:20]] + bad + [prose(s, 50) for s in range(300, 500)] + [None, "", "tiny"]
    path = tmp_path_factory.mktemp("sf")
    documents(spark, texts).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(60 <= i < 180)) for i in range(len(texts)) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_keep_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], folder).cache()
        assert out.columns == docs.columns
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    toxic = set(range(60, 180))
    assert not ids[1] & toxic and len(ids[0] - toxic - ids[1]) <= 3
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = {}
    for i in ids[1]:
        groups.setdefault((texts[i] or "").lower(), []).append(i)
    assert ids[2] == {max(g) for g in groups.values()}
    left = sorted(ids[3])
    bags = {i: bag(texts[i]) for i in ids[2]}
    assert all(weighted_jaccard(bags[i], bags[j]) < 0.8 for k, i in enumerate(left) for j in left[k + 1 :])
    for i in ids[2] - ids[3]:
        assert any(j < i and (weighted_jaccard(bags[i], bags[j]) >= 0.8 - 1e-9) for j in left)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == ids[3]


def test_stages_take_an_empty_table(spark, folder, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.mark.parametrize("labels", [[], [(i, 1, 0) for i in range(30)], [(i, 1, 1) for i in range(30)], [(None, 1, 1), (1, None, None)]])
def test_stages_with_null_ids_repeated_rows_and_one_class(spark, tmp_path, labels):
    texts = [prose(i, 40) for i in range(30)] + [None, None, "", "Tiny", "tiny", prose(0, 40), prose(0, 40)]
    ids = [*range(30), None, None, 31, None, 32, None, 40]
    documents(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert left.count() == (0 if labels and all(y == 1 for _, _, y in labels) else 37)  # one class only: its rate decides
    copies = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
    assert sorted((str(r.doc_id), r.text or "") for r in copies.collect()) == sorted([*((str(i), prose(i, 40)) for i in range(1, 30)), ("40", prose(0, 40)), ("31", ""), ("32", "tiny")])
    assert corpus_pipeline.drop_near_copies(spark, copies, str(tmp_path)).count() == 32
    if left.count():
        pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert len(pieces) == 32 and {r.doc_id for r in pieces} == {*range(1, 30), 31, 32, 40}


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_queries_equal_their_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = entry.queries()[name](spark, sf_dir)
    want = con.execute(entry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in entry.queries()) == list(range(1, 14))
    assert zlib.crc32(b"1") == 2212294583  # the folds' hash
