"""Schemas of the data at rest."""

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _schema(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


TEXTS = ArrayType(StringType())
COOCCURRENCE = _schema(("x", LongType()), ("y", LongType()), ("n", LongType()))
OCCURRENCE = _schema(("x", LongType()), ("n", LongType()))
SENTENCE_COUNT = _schema(("n", LongType()))
IDS = _schema(("x", LongType()))
RELATIONS = _schema(("x", LongType()), ("y", LongType()))
LABELLED = _schema(("x", LongType()), ("y", LongType()), ("class", IntegerType()))
MINED = _schema(("kind", StringType()), ("x", LongType()), ("y", LongType()), ("n", LongType()))
WORDLIST = _schema(("term_id", LongType()), ("cuid", StringType()), ("types", TEXTS), ("terms", TEXTS))
DICTIONARY = _schema(("tokens", TEXTS), ("term_id", LongType()))
CUID_MAPPING = _schema(("cuid", StringType()), ("types", TEXTS), ("term", StringType()))
DOCUMENT = _schema(("doc_id", StringType()), ("pmid", StringType()), ("pmcid", StringType()), ("doi", StringType()), ("pub_year", IntegerType()), ("blocks", TEXTS))
ARTICLE_SUMMARY = _schema(("pmid", StringType()), ("pmcid", StringType()), ("article_type", StringType()), ("pub_year", StringType()), ("path", StringType()), ("part", StringType()))
VECTORS = _schema(("x", LongType()), ("vec", ArrayType(FloatType())))
FACTORS = _schema(("x", LongType()), ("f", ArrayType(DoubleType())))
SCORES = _schema(("x", LongType()), ("y", LongType()), ("score", DoubleType()))
CURVE = _schema(("method", StringType()), ("tpr", DoubleType()), ("fpr", DoubleType()), ("precision", DoubleType()), ("f1", DoubleType()), ("tp", LongType()), ("fp", LongType()), ("tn", LongType()), ("fn", LongType()), ("threshold", DoubleType()))
