"""Operators on workers that have the Python libraries but not this package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
#: The driver finds the package by a path of its own; Python workers are started without it.
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()

@F.udf("boolean")
def found(x):
    try:
        import lacuna
    except ImportError:
        return False
    return True

assert not spark.range(1).select(found("id")).first()[0], "workers see the package"
docs = spark.createDataFrame([(i, f"the cat number {{i}} sat", "en", "s") if i % 2 else (i, f"der hund nummer {{i}} sass da", "de", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "vec_id long, embedding array<float>")
pages = spark.createDataFrame([(i, f"https://a{{i}}.org/x") if i % 2 else (i, f"https://b{{i}}.com/de/") for i in range(40)], "page_id long, url string")
turns = spark.createDataFrame([(i // 4, i % 4, "user", f"turn {{i % 9}}") for i in range(40)], "conv_id long, turn long, role string, text string")
from lacuna.llm import align, langid, nearcopies, pieces, simhash, tokencount, topk, toxicity, trie, url_lm, warc
from lacuna.llm import vectors as vec
for name, df in {{"langid": langid.identify_documents(docs), "toxicity": toxicity.score_documents(docs, labels), "simhash": simhash.deduplicate_documents(docs), "near": nearcopies.one_of_each_group(docs), "tokens": tokencount.count_documents(docs), "pieces": pieces.decode_pieces(pieces.encode_documents(docs)), "vectors": vec.deduplicate_embeddings(vectors), "top": topk.search_embeddings(vectors), "urls": url_lm.judge_pages(pages), "align": align.align_documents(docs), "warc": warc.archive_pages(pages.withColumn("html", F.col("url"))), "trie": trie.rebuilt_trie(turns)}}.items():
    print(name, len(df.collect()))
"""


def test_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=str(ROOT)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONSAFEPATH": "1"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    if "workers see the package" in done.stderr:
        pytest.skip("the package is installed for every interpreter here")
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) == 24
