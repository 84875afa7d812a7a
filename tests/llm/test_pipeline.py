"""The pipeline's stages against plain recomputations, and registered queries against their SQL."""

import math
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from lacuna.llm import langid, mixing, pieces, queries, toxicity

from test_nearcopies import groups
from test_nearcopies import plain as plain_shingles

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got[name] = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name != "encode_pieces":
            assert out.columns == docs.columns
            docs = out
    pool = spark.read.parquet(f"{SF}/documents.parquet")
    predicted = langid.identify_documents(pool)
    good = {r.doc_id for r in predicted.where(f"lang_pred <> 'und' and score >= {langid.CERTAIN}").collect()}
    assert set(got["language_id"]) == good
    pool = pool.where(pool.doc_id.isin(list(good)))
    scores = toxicity.score_documents(pool, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in scores.where("predicted = 0").collect()}
    assert set(got["toxicity"]) == clean
    ids = sorted(clean)
    comp, _ = groups([plain_shingles(before[i].text) for i in ids])
    kept = {ids[c] for c in comp}
    assert set(got["simhash_near_dedup"]) == kept
    pool = pool.where(pool.doc_id.isin(list(kept)))
    used = {r.doc_id: math.ceil(r.taken / r.size) for r in mixing.mix_documents(pool).collect() if r.taken}
    assert got["mix_sources"] == Counter(used)
    assert got["encode_pieces"] == Counter(used)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    segmenter = pieces.Segmenter(pieces.read_model(pieces.default_path()))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows and all(r.lossless and segmenter.decode(r.pieces) == texts[r.doc_id] for r in rows)


@pytest.mark.parametrize("kind", ["empty", "awkward"])
def test_run_on_awkward_tables(spark, tmp_path, kind):
    """No rows at all; ids that are null or repeat; null and empty texts; a map among the columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    if kind == "empty":
        docs, labels = docs.limit(0), labels.limit(0)
    else:
        rows = docs.selectExpr("case when doc_id % 7 = 0 then null when doc_id % 7 = 1 then 1 else doc_id end as doc_id", "case when doc_id % 11 = 0 then null when doc_id % 11 = 1 then '' else text end as text", "lang", "case when doc_id % 5 = 0 then null else source end as source", "n_chars")
        docs = rows.unionByName(rows.where("doc_id < 40")).selectExpr("*", "map('k', lang) as extra")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind == "empty":
        assert out == []
        return
    texts = {r["text"] for r in docs.collect()}
    segmenter = pieces.Segmenter(pieces.read_model(pieces.default_path()))
    assert len(out) > 50 and any(r["doc_id"] is None for r in out)
    assert all(r["lossless"] and segmenter.decode(r["pieces"]) in texts for r in out)


def plain(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    assert sorted([plain(r[c]) for c in key] for r in df.collect()) == sorted([plain(r[names.index(c)]) for c in key] for r in found.fetchall())
