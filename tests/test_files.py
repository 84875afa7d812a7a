"""Files that several tasks write and read by position."""

import numpy as np
from lacuna.operators import mine
from lacuna.sources import markup, tables
from pyspark.sql import functions as F


def test_rolling_files_are_full_whatever_the_tasks(spark, tmp_path):
    rows = spark.range(1000).select((2000 + F.col("id") % 3).cast("int").alias("year"), "id", F.lit("same").alias("text"))
    rows = rows.unionByName(spark.range(250).select(F.lit(2001).alias("year"), F.lit(7).cast("long").alias("id"), F.lit("equal rows").alias("text")))
    for k, parts in enumerate((1, 7)):
        tables.write_rolling(rows.repartition(parts), str(tmp_path / str(k)), 100)
        back = spark.read.parquet(str(tmp_path / str(k)))
        sizes = {(r["year"], r["file"]): r["count"] for r in back.groupBy("year", "file").count().collect()}
        totals = {2000: 334, 2001: 583, 2002: 333}
        assert sizes == {(y, f): min(100, n - 100 * f) for y, n in totals.items() for f in range(-(-n // 100))}
        assert back.where("text = 'same'").select("id").distinct().count() == 1000
        assert all(len(list((tmp_path / str(k) / f"year={y}" / f"file={f}").glob("*.parquet"))) == 1 for y, f in sizes)
    assert tables.years_of(spark, str(tmp_path / "0")) == [2000, 2001, 2002]
    assert tables.years_of(spark, str(tmp_path / "none")) == []


def test_matrix_parts(spark, tmp_path):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(301, 5)).astype("<f4")
    ids = rng.permutation(301) * 3
    vectors = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, m)], "x long, vec array<float>").repartition(5)
    tables.write_matrix_parts(vectors, str(tmp_path / "m"))
    got = {r["x"]: r["vec"] for r in tables.read_matrix_parts(spark, str(tmp_path / "m"), 16).collect()}
    assert {x: np.asarray(v, "<f4").tobytes() for x, v in got.items()} == {int(i): r.tobytes() for i, r in zip(ids, m)}
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "m").glob("rows-*.f32")))
    assert raw == m[np.argsort(ids)].tobytes()
    tables.write_matrix_parts(vectors.limit(0), str(tmp_path / "none"))
    assert tables.read_matrix_parts(spark, str(tmp_path / "none")).collect() == []


def test_raw_matrix_by_ranges(spark, tmp_path):
    m = np.arange(700 * 3, dtype="<f4").reshape(700, 3)
    (tmp_path / "m").write_bytes(m.tobytes())
    (tmp_path / "i").write_text("\n\n".join(str(10 * k) for k in range(700)) + "\n")
    got = {r["x"]: r["vec"] for r in tables.read_float_matrix(spark, str(tmp_path / "i"), str(tmp_path / "m"), 64).collect()}
    assert got == {10 * k: m[k].tolist() for k in range(700)}


def test_document_level(spark):
    texts = spark.createDataFrame([(1, 2000, ["A cat. A dog.", "cat"]), (2, 2000, ["dog"]), (3, 2001, []), (4, 2001, ["None of them."])], "doc_id long, year int, blocks array<string>")
    words = spark.createDataFrame([(["cat"], 0), (["dog"], 1)], "tokens array<string>, term_id long")
    records = lambda level: sorted(map(tuple, mine.mine_texts(texts, words, 1, level=level).collect()), key=str)
    assert records("document") == sorted([("COOCCURRENCE", 2000, 0, 1, 1), ("OCCURRENCE", 2000, 0, None, 1), ("OCCURRENCE", 2000, 1, None, 2), ("SENTENCECOUNT", 2000, None, None, 2), ("SENTENCECOUNT", 2001, None, None, 2)], key=str)
    assert ("COOCCURRENCE", 2000, 0, 1, 1) not in records("sentence")


def test_article_summaries_walk_no_text(spark, tmp_path):
    """What describes articles is read alike without their texts, which aren't walked then."""
    (tmp_path / "a.nxml").write_text("<article article-type='research'><front><article-meta><article-id pub-id-type='pmid'>7</article-id><pub-date><year>2001</year></pub-date></article-meta></front><body><p>x</p></body></article>")
    whole = markup.article_summary(markup.read_articles(spark, str(tmp_path))).collect()
    heads = markup.read_articles(spark, str(tmp_path), texts=False)
    assert "blocks" not in heads.columns and markup.article_summary(heads).collect() == whole and len(whole) == 1
    assert [d["texts"] for d in markup.article_documents(markup.ET.fromstring((tmp_path / "a.nxml").read_text()), texts=False)] == [[]]
