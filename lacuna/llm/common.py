"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Words are runs of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder serves in-process (``local[n]``)
    sessions such as tests; any other master must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named:
            sc.setCheckpointDir(named)
        elif sc.master == "local" or sc.master.startswith("local["):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lacuna-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of any store; only what no later plan reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


class Settled:
    """A DataFrame written once to the shared folder; ``df`` rereads it.

    It cuts lineage: a lost executor costs a reread, not a recomputation.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{new_folder(self.spark)}.parquet"
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no later plan reads."""
        delete(self.spark, self.path)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to and reread from the shared folder."""
    return Settled(df).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_text(key: Column) -> Column:
    """A key as text, null as ``null``: what hash-random orders are drawn from."""
    return F.coalesce(key.cast("string"), F.lit("null"))


def join_spread(rows: DataFrame, info: DataFrame, key: str, by: str, ways: int = 32) -> DataFrame:
    """``rows`` joined with the one row that ``info`` has for each ``key``.

    A key may hold a third of ``rows``: they are dealt to ``ways`` by a hash of
    ``by``, and the row of ``info`` goes to each of them.
    """
    dealt = rows.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    copies = info.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return dealt.join(copies, [key, "_way"]).drop("_way")


def holds_map(kind: DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
    return isinstance(kind, MapType) or any(map(holds_map, inner))


def hashable(df: DataFrame) -> list[Column]:
    """Every column as hash functions take it: one that holds a map goes as JSON."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if holds_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields]


#: A key with 1/HOT_SHARE or more of all rows is hot; there are HOT_SHARE such keys at most.
HOT_SHARE = 4096


def join_hot(rows: DataFrame, info: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row that ``info`` has for each of ``keys``, ``n`` being the number of rows with it.

    Hot keys (``HOT_SHARE`` at most, whatever the data) are broadcast, all others meet theirs in a shuffle.
    ``info`` is read three times, ``rows`` twice: settle what isn't cheap.
    """
    total = info.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.broadcast(info.where(F.col(n) * HOT_SHARE >= total).drop(n))
    cold = info.where(F.col(n) * HOT_SHARE < total).drop(n)
    here = rows.join(hot, keys)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return here.unionByName(rest)


def repeated(df: DataFrame, times: str, into: str, at_once: int = 4096) -> DataFrame:
    """Each row of ``df`` as often as ``times`` says, numbered from 1 in ``into``.

    Repeats beyond ``at_once`` are dealt to tasks in blocks of so many.
    """
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / at_once))).alias("_block")
    inside = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(at_once), F.col(times) - F.col("_block") * at_once))).alias("_in")
    few = df.where(F.col(times).between(1, at_once)).select("*", F.lit(0).cast("long").alias("_block"))
    many = df.where(F.col(times) > at_once).select("*", block)
    number = (F.col("_block") * at_once + F.col("_in")).alias(into)
    spread = [part.select("*", inside).select(*df.columns, number) for part in (few, many.repartition(F.xxhash64("_block")))]
    return spread[0].unionByName(spread[1])
