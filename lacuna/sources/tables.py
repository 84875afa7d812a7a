"""Readers and writers of the text formats: matrices, records, vocabularies, factors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.mine import split_records
from ..session import settled


def _tsv(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", quote="")


def read_cooccurrences(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.COOCCURRENCE)


def read_occurrences(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.OCCURRENCE)


def read_sentence_count(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.SENTENCE_COUNT)


def read_ids(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.IDS)


def read_relations(spark: SparkSession, path) -> DataFrame:
    """The first two fields of each line, whatever follows."""
    fields = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(fields[0].cast("long").alias("x"), fields[1].cast("long").alias("y"))


def read_mined(spark: SparkSession, path) -> dict[str, DataFrame]:
    """Tagged lines by kind, the tag and what a kind lacks left out."""
    fields = F.split("value", "\t")
    number = lambda i: F.try_element_at(fields, F.lit(i)).try_cast("long")
    kind = fields[0]
    records = spark.read.text(path).select(
        kind.alias("kind"),
        F.when(kind != "SENTENCECOUNT", number(2)).alias("x"),
        F.when(kind == "COOCCURRENCE", number(3)).alias("y"),
        F.when(kind == "COOCCURRENCE", number(4)).when(kind == "OCCURRENCE", number(3)).otherwise(number(2)).alias("n"),
    )
    return split_records(records)


def read_rrf_concepts(spark: SparkSession, path) -> DataFrame:
    """(cuid, language, term, line) of a concept file: fields 0, 1 and 14 between bars."""
    fields = F.split("value", r"\|")
    return spark.read.text(path).select(fields[0].alias("cuid"), fields[1].alias("language"), fields[14].alias("term"), F.monotonically_increasing_id().alias("line"))


def read_rrf_types(spark: SparkSession, path) -> DataFrame:
    fields = F.split("value", r"\|")
    return spark.read.text(path).select(fields[0].alias("cuid"), fields[1].alias("type_id"))


def read_semantic_groups(spark: SparkSession, path) -> DataFrame:
    fields = F.split("value", r"\|")
    return spark.read.text(path).select(fields[0].alias("group"), fields[1].alias("name"), fields[2].alias("type_id"), fields[3].alias("type_name"))


def read_wordlist(spark: SparkSession, path) -> DataFrame:
    """Sorted TSV (cuid, types, terms) -> the word-list; ids are ranks of cuids."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).select(fields[0].alias("cuid"), F.split(fields[1], r"\|").alias("types"), F.split(fields[2], r"\|").alias("terms"))
    return rows.select((F.row_number().over(Window.orderBy("cuid")) - 1).cast("long").alias("term_id"), "cuid", "types", "terms")


def write_wordlist(wordlist: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", "cuid", F.array_join("types", "|"), F.array_join("terms", "|"))
    wordlist.orderBy("cuid").select(line.alias("value")).write.text(path)


def read_factors(spark: SparkSession, path) -> DataFrame:
    """Blank-separated rows ``id v1 .. vk``; lines starting with % are comments."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    return rows.select(fields[0].cast("double").cast("long").alias("x"), F.transform(F.slice(fields, 2, F.size(fields)), lambda v: v.cast("double")).alias("f"))


def read_singular_values(spark: SparkSession, path) -> list[float]:
    """The values in file order; a few hundred numbers."""
    return [float(r["value"]) for r in spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).collect()]


def read_float_matrix(spark: SparkSession, index_path: str, matrix_path: str, rows_a_task: int = 1 << 14) -> DataFrame:
    """A raw little-endian float32 matrix and its row index (a text file, an id a line) -> (x, vec).

    Lines are numbered by the splits of the index, which stay in file order; tasks
    seek to the byte ranges of their rows, so none holds the matrix.
    """
    lines = spark.read.text(index_path).select("value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")).where(F.trim("value") != "")
    lines = settled(lines)
    starts = lines.groupBy("_start").count()  # a row for each split
    before = starts.select("_start", F.coalesce(F.sum("count").over(Window.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_start").orderBy("_id")) - 1
    index = lines.withColumn("_at", inside).join(F.broadcast(before), "_start").select((F.col("_before") + F.col("_at")).alias("r"), F.trim("value").cast("long").alias("x"))
    count = lines.count()
    if not count:
        return spark.createDataFrame([], schemas.VECTORS)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(matrix_path)
    width = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).getLen() // count

    def read(batches):
        files, place = _store(matrix_path)
        with files.open_input_file(place) as raw:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    n = min(rows_a_task, count - first)
                    raw.seek(first * width)
                    flat = np.frombuffer(raw.read(n * width), "<f4")
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (width // 4))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["r", "vec"])

    return spark.range(0, count, rows_a_task).mapInArrow(read, "r long, vec array<float>").join(index, "r").select("x", "vec")


def write_float_matrix(vectors: DataFrame, index_path: str, matrix_path: str) -> None:
    """Index and matrix on the driver's disk, ordered by id; rows stream through."""
    with open(index_path, "w") as index, open(matrix_path, "wb") as matrix:
        for row in vectors.orderBy("x").toLocalIterator():
            index.write(f"{row['x']}\n")
            matrix.write(np.asarray(row["vec"], "<f4").tobytes())


def dump_vectors(vectors: DataFrame) -> DataFrame:
    """Long form (x, column, value)."""
    return vectors.select("x", F.posexplode("vec").alias("column", "value"))


def write_matrix(df: DataFrame, path: str) -> None:
    """Sorted TSV without header."""
    df.orderBy(*df.columns[:-1]).write.csv(path, sep="\t")


def by_year(df: DataFrame, year: str = "year", ways: int = 16) -> DataFrame:
    """``df`` dealt so that a year is written by ``ways`` tasks, not by one."""
    rest = [c for c in df.columns if c != year]
    return df.repartition(year, F.pmod(F.xxhash64(*rest), F.lit(ways)))


def write_by_year(df: DataFrame, path: str, most_rows: int = 30_000, year: str = "year") -> None:
    """One folder for each year, files of at most ``most_rows`` rows."""
    by_year(df, year).write.partitionBy(year).option("maxRecordsPerFile", most_rows).parquet(path)


def write_rolling(df: DataFrame, path: str, most_rows: int = 30_000, year: str = "year", ways: int = 64) -> None:
    """Folders by year and file; each file of a year but its last holds exactly ``most_rows`` rows, however many tasks write.

    Rows of a year are numbered in two steps: inside each of ``ways`` shares of its
    hashes, then by the sizes of the shares before, so no task holds a year.
    """
    rest = [c for c in df.columns if c != year]
    dealt = settled(df.withColumn("_hash", F.xxhash64(*rest)).withColumn("_way", F.pmod("_hash", F.lit(ways))))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(year).orderBy("_way").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = dealt.groupBy(year, "_way").count().select(year, "_way", before.alias("_before"))  # ``ways`` rows a year
    inside = F.row_number().over(Window.partitionBy(year, "_way").orderBy("_hash"))
    numbered = dealt.withColumn("_at", inside).join(F.broadcast(shares), [year, "_way"])
    out = numbered.withColumn("file", F.floor((F.col("_before") + F.col("_at") - 1) / most_rows).cast("int")).drop("_hash", "_way", "_at", "_before")
    out.repartition(year, "file").write.partitionBy(year, "file").parquet(path)


def article_lists(summary: DataFrame, path: str, most_rows: int = 2000) -> None:
    """Paths of main articles by year, ``most_rows`` a file."""
    write_rolling(summary.where(F.col("part") == "MAIN").select(F.col("pub_year").alias("year"), "path"), path, most_rows)


def years_of(spark: SparkSession, path: str) -> list[int]:
    """Years that a partitioned table holds, from its folders' names; nothing is read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/year=*")
    found = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(place)
    return sorted(int(f.getPath().getName().partition("=")[2]) for f in found or [])


def _store(uri: str):
    """File system and path of a URI as Spark writes it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_matrix_parts(vectors: DataFrame, path: str) -> None:
    """(x, vec) -> raw float32 parts ``rows-N.f32`` ordered by id, and ``index.parquet`` (file, row, x) beside them.

    A task writes a part under a hidden name and moves it when it is whole; a
    part's name and rows follow from the range of ids, so a task run again makes
    the same.
    """

    def write(batches):
        import uuid

        from pyspark import TaskContext

        files, folder = _store(path)
        files.create_dir(folder, recursive=True)
        name = f"rows-{TaskContext.get().partitionId():05d}.f32"
        hidden, row = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
        with files.open_output_stream(hidden, compression=None) as out:
            for batch in batches:
                out.write(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(row, row + n)), batch.column(0)], names=["file", "row", "x"])
                row += n
        files.move(hidden, f"{folder}/{name}")

    ordered = settled(vectors.select("x", "vec")).repartitionByRange("x").sortWithinPartitions("x")
    ordered.mapInArrow(write, "file string, row long, x long").write.parquet(f"{path}/index.parquet")


def read_matrix_parts(spark: SparkSession, path: str, rows_a_task: int = 1 << 16) -> DataFrame:
    """(x, vec) of ``write_matrix_parts``: tasks seek to the byte ranges of their rows."""
    index = spark.read.parquet(f"{path}/index.parquet")
    spans = index.groupBy("file", F.floor(F.col("row") / rows_a_task).alias("span")).agg(F.sort_array(F.collect_list(F.struct("row", "x"))).alias("rows"))
    total = index.groupBy("file").agg(F.count(F.lit(1)).alias("of_file"))

    def read(batches):
        files, folder = _store(path)
        for batch in batches:
            for name, rows, of_file in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                first, n = rows.values[0].as_py()["row"], len(rows)
                with files.open_input_file(f"{folder}/{name}") as raw:
                    width = raw.size() // of_file
                    raw.seek(first * width)
                    flat = np.frombuffer(raw.read(n * width), "<f4")
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (width // 4))
                yield pa.RecordBatch.from_arrays([rows.values.field("x"), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["x", "vec"])

    return spans.join(total, "file").select("file", "rows", "of_file").mapInArrow(read, "x long, vec array<float>")
