from pathlib import Path

import pytest
from lacuna import session
from lacuna.operators import dataset, mine
from lacuna.plans import catalogue, files  # noqa: F401
from lacuna.streaming import incremental

SCHEMA = "unit long, year int, t long"


@pytest.mark.parametrize("late", [False, True], ids=["years in order", "an earlier year comes late"])
def test_stream_equals_batch(spark, tmp_path, late):
    rows = [(u, 2000 + u // 10, t) for u in range(40) for t in {u % 3, u % 5, u % 7, u % 11}] + [(100 + u, 2000 + u, None) for u in range(4)]
    years = [2003, 2001, 2000, 2002] if late else [2000, 2001, 2002, 2003]
    out = str(tmp_path / "out")
    for year in years:
        spark.createDataFrame([r for r in rows if r[1] == year], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        incremental.mine_stream(stream, out, str(tmp_path / "mined")).awaitTermination()
        incremental.track_stream(spark, out, str(tmp_path / "tracked")).awaitTermination()
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    every = spark.createDataFrame(rows, SCHEMA)
    named = every.where("t is not null")
    pairs = mine.cooccurrences(named)
    assert same(incremental.current(spark, out), pairs)
    assert same(incremental.current(spark, out, incremental.CONCEPTS), mine.occurrences(named))
    assert same(incremental.current(spark, out, incremental.UNITS), mine.unit_counts(every.select("unit", "year").distinct()))
    assert same(incremental.tracked(spark, out), dataset.first_seen(pairs).select("x", "y", "first_year"))
    ids = spark.createDataFrame([(i,) for i in range(9)], "x long")
    for year in years:
        assert same(incremental.holdout(spark, out, ids, year), dataset.holdout(pairs, ids, year))


def test_more_rows_come_as_more_files_of_three_batches(spark, monkeypatch):
    """Files grow in number with the items; counts stay the same."""
    few = sorted(files.streamed_counts(spark, "/root/testdata/sf0.001").collect(), key=str)
    monkeypatch.setattr(session, "ROWS", 500)
    made = []
    monkeypatch.setattr(files, "new_folder", lambda s: made.append(session.new_folder(s)) or made[-1])
    assert sorted(files.streamed_counts(spark, "/root/testdata/sf0.001").collect(), key=str) == few
    at, out = (Path(m.removeprefix("file:")) for m in made[:2])
    assert len(list(at.glob("*.parquet"))) > 9 and len(list((out / "cooccurrence").glob("batch=*"))) == 3
