"""Registered queries of the library's own operators, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anni, dataset, evaluate, matrix, mine, predict, score, svd, vocab
from ..operators.dataset import DENSE, DRAWS
from ..session import new_folder, settled
from ..sources import markup, tables
from .fixtures import GRAPH_K, K, SAMPLE, SIGMA, SPLIT, Factors, Graph, graded, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Common table expressions, each after those it needs.
CTE = {
    "m": "SELECT DISTINCT l_orderkey AS unit, CAST(year(o_orderdate) AS INT) AS year, l_partkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "d": "SELECT DISTINCT o_custkey AS c, CAST(year(o_orderdate) AS INT) AS year, l_partkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "co": "SELECT a.year, a.t AS x, b.t AS y, count(*) AS n FROM m a JOIN m b ON a.unit = b.unit AND a.t < b.t GROUP BY ALL",
    "occ": "SELECT year, t AS x, count(*) AS n FROM m GROUP BY ALL",
    "tr": f"SELECT x, y, CAST(sum(n) AS BIGINT) AS n FROM co WHERE year <= {SPLIT - 1} GROUP BY ALL",
    "tv": f"SELECT x, y, CAST(sum(n) AS BIGINT) AS n FROM co WHERE year <= {SPLIT} GROUP BY ALL",
    "trids": "SELECT x FROM tr UNION SELECT y FROM tr",
    "tvids": "SELECT x FROM tv UNION SELECT y FROM tv",
    "tvocc": f"SELECT x, CAST(sum(n) AS BIGINT) AS n FROM occ WHERE year <= {SPLIT} AND x IN (SELECT x FROM tvids) GROUP BY x",
    "seen": "SELECT x, y, min(year) AS year, arg_min(n, year) AS n FROM co GROUP BY x, y",
    "val": f"SELECT * FROM seen WHERE year = {SPLIT} AND x IN (SELECT x FROM trids) AND y IN (SELECT x FROM trids)",
    "test": f"SELECT * FROM seen WHERE year > {SPLIT} AND x IN (SELECT x FROM tvids) AND y IN (SELECT x FROM tvids)",
    "pos": f"SELECT * FROM test ORDER BY md5(x || '_' || y || '_draw'), x, y LIMIT {SAMPLE}",
    "ranked": "SELECT x, row_number() OVER (ORDER BY x) - 1 AS r FROM tvids",
    "truth": "SELECT x, y FROM tv UNION ALL SELECT x, y FROM test",
    "room": "SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM tvids) - (SELECT count(*) FROM truth) AS n",
    "drawn": f"SELECT CAST('0x' || substr(md5(id || '_a_negative'), 1, 8) AS BIGINT) % (SELECT count(*) FROM tvids) AS a, CAST('0x' || substr(md5(id || '_b_negative'), 1, 8) AS BIGINT) % (SELECT count(*) FROM tvids) AS b FROM (SELECT unnest(range({DRAWS} * least((SELECT n FROM room), {SAMPLE}))) AS id) WHERE (SELECT n FROM room) >= {DENSE} * least((SELECT n FROM room), {SAMPLE}) UNION ALL SELECT p.r, q.r FROM ranked p JOIN ranked q ON p.r < q.r WHERE (SELECT n FROM room) < {DENSE} * least((SELECT n FROM room), {SAMPLE})",
    "neg": f"SELECT x, y, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT least(p.x, q.x) AS x, greatest(p.x, q.x) AS y FROM drawn JOIN ranked p ON p.r = a JOIN ranked q ON q.r = b WHERE p.x <> q.x) t WHERE NOT EXISTS (SELECT 1 FROM truth k WHERE k.x = t.x AND k.y = t.y) ORDER BY md5(x || '_' || y || '_negative'), x, y LIMIT least((SELECT n FROM room), {SAMPLE})",
    "drawn_all": f"SELECT CAST('0x' || substr(md5(id || '_a_negative'), 1, 8) AS BIGINT) % (SELECT count(*) FROM tvids) AS a, CAST('0x' || substr(md5(id || '_b_negative'), 1, 8) AS BIGINT) % (SELECT count(*) FROM tvids) AS b FROM (SELECT unnest(range({DRAWS} * least((SELECT n FROM room), (SELECT count(*) FROM test)))) AS id) WHERE (SELECT n FROM room) >= {DENSE} * least((SELECT n FROM room), (SELECT count(*) FROM test)) UNION ALL SELECT p.r, q.r FROM ranked p JOIN ranked q ON p.r < q.r WHERE (SELECT n FROM room) < {DENSE} * least((SELECT n FROM room), (SELECT count(*) FROM test))",
    "neg_all": f"SELECT x, y, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT least(p.x, q.x) AS x, greatest(p.x, q.x) AS y FROM drawn_all JOIN ranked p ON p.r = a JOIN ranked q ON q.r = b WHERE p.x <> q.x) t WHERE NOT EXISTS (SELECT 1 FROM truth k WHERE k.x = t.x AND k.y = t.y) ORDER BY md5(x || '_' || y || '_negative'), x, y LIMIT least((SELECT n FROM room), (SELECT count(*) FROM test))",
    "cand": 'SELECT x, y, 1 AS "class" FROM test UNION ALL SELECT x, y, 0 AS "class" FROM neg_all',
    "cand_few": 'SELECT x, y, 1 AS "class" FROM pos UNION ALL SELECT x, y, 0 AS "class" FROM neg',
    "adj": "SELECT x, y, n FROM tv UNION ALL SELECT y AS x, x AS y, n FROM tv",
    "deg": "SELECT x, count(*) AS d FROM adj GROUP BY x",
    "stren": "SELECT a.x, a.y, a.n, a.n / CAST(least(p.n, q.n) AS DOUBLE) AS d FROM adj a JOIN tvocc p ON p.x = a.x JOIN tvocc q ON q.x = a.y",
    "sums": "SELECT c.x, c.y, count(*) AS s, sum(a.n * b.n) AS b, sum(least(a.n, b.n)) AS l, product(1 - a.d * b.d) AS p FROM cand c JOIN stren a ON a.x = c.x JOIN stren b ON b.x = c.y AND b.y = a.y GROUP BY c.x, c.y",
    "scores": """SELECT c.x, c.y, c."class", round(1 - coalesce(p, 1.0), 9) AS factaplus, CAST(coalesce(b, 0) AS BIGINT) AS bitola, CAST(coalesce(s, 0) AS BIGINT) AS arrowsmith,
      round(CASE WHEN coalesce(dx.d, 0) + coalesce(dy.d, 0) - coalesce(s, 0) > 0 THEN coalesce(s, 0) / CAST(coalesce(dx.d, 0) + coalesce(dy.d, 0) - coalesce(s, 0) AS DOUBLE) ELSE 0 END, 9) AS jaccard,
      CAST(coalesce(dx.d, 0) + coalesce(dy.d, 0) AS BIGINT) AS prefattach, round(coalesce(l / CAST(s AS DOUBLE), 0.0), 9) AS amw, round(coalesce(s, 0) + 0.001 * coalesce(l / CAST(s AS DOUBLE), 0.0), 9) AS ltc_amw
      FROM cand c LEFT JOIN sums USING (x, y) LEFT JOIN deg dx ON dx.x = c.x LEFT JOIN deg dy ON dy.x = c.y""",
    "melted": """SELECT x, y, "class", method, score FROM (UNPIVOT (SELECT x, y, "class", CAST(factaplus AS DOUBLE) AS factaplus, CAST(bitola AS DOUBLE) AS bitola, CAST(arrowsmith AS DOUBLE) AS arrowsmith, CAST(jaccard AS DOUBLE) AS jaccard, CAST(prefattach AS DOUBLE) AS prefattach, CAST(amw AS DOUBLE) AS amw, CAST(ltc_amw AS DOUBLE) AS ltc_amw FROM scores) ON factaplus, bitola, arrowsmith, jaccard, prefattach, amw, ltc_amw INTO NAME method VALUE score)""",
    "total": f"SELECT CAST(count(*) AS DOUBLE) AS n FROM orders WHERE year(o_orderdate) <= {SPLIT}",
    "f": f"SELECT vec_id AS x, label, CAST(embedding AS DOUBLE[])[1:{K}] AS u, list_transform(range(1, {K + 1}), lambda i: CAST(embedding[{K} + i] AS DOUBLE) / i) AS v FROM embeddings",
    "graded": 'SELECT l.doc_id, l.method, l."class", CAST(d.n_chars AS DOUBLE) AS score FROM (SELECT doc_id, \'quality\' AS method, quality AS "class" FROM labels UNION ALL SELECT doc_id, \'toxic\', toxic FROM labels) l JOIN documents d USING (doc_id)',
    "by_score": 'SELECT method, score AS threshold, sum("class") AS pos, sum(1 - "class") AS neg FROM graded GROUP BY ALL',
    "counted": """SELECT method, threshold, coalesce(sum(pos) OVER w, 0) AS tp, coalesce(sum(neg) OVER w, 0) AS fp, sum(pos) OVER (PARTITION BY method) AS p, sum(neg) OVER (PARTITION BY method) AS q FROM by_score WINDOW w AS (PARTITION BY method ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      UNION ALL SELECT method, min(threshold) - 1, sum(pos), sum(neg), sum(pos), sum(neg) FROM by_score GROUP BY method""",
}
NEEDS = {
    "co": ["m"], "occ": ["m"], "tr": ["co"], "tv": ["co"], "trids": ["tr"], "tvids": ["tv"], "tvocc": ["occ", "tvids"], "seen": ["co"], "val": ["seen", "trids"], "test": ["seen", "tvids"],
    "pos": ["test"], "ranked": ["tvids"], "truth": ["tv", "test"], "room": ["tvids", "truth"], "drawn": ["ranked", "room"], "neg": ["drawn"], "drawn_all": ["ranked", "room"], "neg_all": ["drawn_all"], "cand": ["test", "neg_all"], "cand_few": ["pos", "neg"], "adj": ["tv"], "deg": ["adj"],
    "stren": ["adj", "tvocc"], "sums": ["cand", "stren"], "scores": ["sums", "deg"], "melted": ["scores"], "by_score": ["graded"], "counted": ["by_score"],
}


def sql(final: str, *parts: str, **more: str) -> str:
    """``final`` after the table expressions it needs (``parts``) and its own (``more``)."""
    chosen: dict[str, None] = {}

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        chosen.setdefault(name)

    for p in parts:
        add(p)
    exprs = [f"{n} AS ({CTE[n]})" for n in chosen] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH " + ",\n".join(exprs) + "\n" if exprs else "") + final


def query(oracle: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Mining.


@query(sql("SELECT unit, year, t FROM m", "m"))
def mentions(spark, sf):
    return mine.distinct_mentions(Graph(spark, sf).mentions)


@query(sql("SELECT * FROM co", "co"))
def cooccurrence_by_year(spark, sf):
    return Graph(spark, sf).cooccurrence


@query(sql("SELECT * FROM occ", "occ"))
def occurrence_by_year(spark, sf):
    return Graph(spark, sf).occurrence


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1")
def sentence_count(spark, sf):
    return Graph(spark, sf).sentences


@query(sql("SELECT a.year, a.t AS x, b.t AS y, count(*) AS n FROM d a JOIN d b ON a.c = b.c AND a.year = b.year AND a.t < b.t GROUP BY ALL", "d"))
def document_level_cooccurrence(spark, sf):
    return mine.cooccurrences(Graph(spark, sf).by_document)


@query(sql("""SELECT kind, year, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'COOCCURRENCE' AS kind, year, n FROM co UNION ALL SELECT 'OCCURRENCE', year, n FROM occ UNION ALL
  SELECT 'SENTENCECOUNT', CAST(year(o_orderdate) AS INT), count(*) FROM orders GROUP BY 2) GROUP BY ALL""", "co", "occ"))  # fmt: skip
def mined_records(spark, sf):
    """Tagged records of all kinds, split again and merged."""
    g = Graph(spark, sf)
    sets = g.mentions.groupBy("unit", "year").agg(F.array_sort(F.collect_set("t")).alias("s"))
    tagged = g.orders.join(sets.drop("year"), g.orders["o_orderkey"] == sets["unit"], "left").select("year", F.lit(1).alias("n_sentences"), F.when(F.col("s").isNotNull(), F.array("s")).otherwise(F.expr("cast(array() as array<array<bigint>>)")).alias("term_sets"))
    kinds = mine.split_records(mine.mined_records(tagged))
    merged = {"COOCCURRENCE": matrix.merge_pairs(kinds["COOCCURRENCE"], "year"), "OCCURRENCE": matrix.merge_counts(kinds["OCCURRENCE"], "year"), "SENTENCECOUNT": kinds["SENTENCECOUNT"].groupBy("year").agg(F.sum("n").alias("n"))}
    parts = [df.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n")).select(F.lit(kind).alias("kind"), "year", "n_rows", "n") for kind, df in merged.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Matrices.


@query(sql("SELECT * FROM adj", "adj"))
def mirror_matrix(spark, sf):
    return matrix.mirror(Graph(spark, sf).known())


@query(sql("SELECT x, y, n FROM adj WHERE x <> y UNION ALL SELECT i, i, 1 FROM (SELECT unnest(range((SELECT count(*) FROM part))) AS i)", "adj"))
def fill_diagonal(spark, sf):
    return matrix.transform(Graph(spark, sf).known(), mirrored=True, diagonal=table(spark, sf, "part").count())


@query(sql("SELECT x, y, CAST(1 AS BIGINT) AS n FROM adj", "adj"))
def binarize(spark, sf):
    return matrix.transform(Graph(spark, sf).known(), mirrored=True, values="binary")


@query(sql("SELECT x, y, round(ln(n + 1), 6) AS n FROM adj", "adj"))
def log1p_matrix(spark, sf):
    return matrix.transform(Graph(spark, sf).known(), mirrored=True, values="log").withColumn("n", F.round("n", 6))


@query(sql("SELECT a.x, a.y, round(1e6 * a.n / (p.c + q.c - a.n), 6) AS n FROM adj a JOIN s p ON p.x = a.x JOIN s q ON q.x = a.y", "adj", s="SELECT x, sum(n) AS c FROM adj GROUP BY x"))
def mi_matrix(spark, sf):
    return matrix.transform(Graph(spark, sf).known(), mirrored=True, values="information")


# Splits.


@query(sql("SELECT * FROM tr", "tr"))
def split_training(spark, sf):
    return Graph(spark, sf).known(SPLIT - 1)


@query(sql("SELECT * FROM tv", "tv"))
def split_training_validation(spark, sf):
    return Graph(spark, sf).known()


@query(sql("SELECT x FROM tvids", "tvids"))
def split_ids(spark, sf):
    return Graph(spark, sf).ids()


@query(sql("SELECT * FROM tvocc", "tvocc"))
def split_occurrences(spark, sf):
    return Graph(spark, sf, at_rest=True).counts()


@query(f"SELECT count(*) AS n FROM orders WHERE year(o_orderdate) <= {SPLIT}")
def split_sentence_count(spark, sf):
    return dataset.known_sentences(Graph(spark, sf).sentences, SPLIT)


@query(sql("SELECT year, x, y, n FROM val", "val"))
def holdout_validation(spark, sf):
    return Graph(spark, sf, at_rest=True).validation()


@query(sql("SELECT year, x, y, n FROM test", "test"))
def holdout_testing_by_year(spark, sf):
    return Graph(spark, sf, at_rest=True).testing()


@query(sql("SELECT x, y, CAST(sum(n) AS BIGINT) AS n FROM test GROUP BY ALL", "test"))
def testing_all(spark, sf):
    return matrix.merge_pairs(Graph(spark, sf, at_rest=True).testing())


@query(sql("SELECT x, y, CAST(sum(n) AS BIGINT) AS n FROM co GROUP BY ALL", "co"))
def all_cooccurrences(spark, sf):
    return matrix.merge_pairs(Graph(spark, sf).cooccurrence)


@query(sql("SELECT year, x, y, n FROM pos", "pos"))
def holdout_subset(spark, sf):
    return Graph(spark, sf, at_rest=True).positives()


@query(sql("SELECT 'cooccurrence' AS what, count(*) AS bad FROM test WHERE x NOT IN (SELECT x FROM tvids) OR y NOT IN (SELECT x FROM tvids) OR (x, y) IN (SELECT (x, y) FROM tv) UNION ALL SELECT 'occurrence', count(*) FROM tvocc WHERE x NOT IN (SELECT x FROM tvids)", "test", "tv", "tvocc"))
def check_filtered(spark, sf):
    g = Graph(spark, sf, at_rest=True)
    parts = {"cooccurrence": dataset.check_cooccurrences(g.testing(), g.ids(), g.known()), "occurrence": dataset.check_occurrences(g.counts(), g.ids())}
    a, b = (df.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("what"), "bad") for name, df in parts.items())
    return a.unionByName(b)


@query(sql("SELECT *, 'a' AS side FROM (SELECT x, y, n FROM tr EXCEPT ALL SELECT x, y, n FROM tv) UNION ALL SELECT *, 'b' FROM (SELECT x, y, n FROM tv EXCEPT ALL SELECT x, y, n FROM tr)", "tr", "tv"))
def symmetric_difference(spark, sf):
    """What two versions of the merged matrix have that the other hasn't."""
    g = Graph(spark, sf, at_rest=True)
    return dataset.symmetric_difference(g.known(SPLIT - 1), g.known())


@query(sql("SELECT * FROM neg", "neg"))
def negatives(spark, sf):
    return Graph(spark, sf, at_rest=True).negatives()


@query(sql('SELECT x, y, "class" FROM cand_few', "cand_few"))
def labelled_candidates(spark, sf):
    return Graph(spark, sf, at_rest=True).sampled_candidates()


@query(sql('SELECT x, y, "class" FROM cand', "cand"))
def all_candidates(spark, sf):
    """Every test pair and as many negatives: what the scoring queries take."""
    return Graph(spark, sf, one_split=True).candidates()


@query(sql("SELECT *, round(test / (terms * (terms + 1) / 2.0 - known), 12) AS class_balance FROM (SELECT (SELECT count(*) FROM tvids) AS terms, (SELECT count(*) FROM tv) AS known, (SELECT count(*) FROM test) AS test)", "test"))
def class_balance(spark, sf):
    g = Graph(spark, sf, at_rest=True)
    return dataset.class_balance(g.ids(), g.known(), g.testing()).withColumn("class_balance", F.round("class_balance", 12))


# Scores.


def all_scores(spark, sf, methods=score.METHODS):
    g = Graph(spark, sf, one_split=True)
    found = score.score_all(g.candidates(), g.known(), g.counts() if "factaplus" in methods else None, methods, at_rest=True, keep=("class",))
    rounded = {m: F.round(m, 9) for m in ("factaplus", "jaccard", "amw", "ltc_amw") if m in methods}  # many scores end in a 5 at the seventh decimal
    return found.withColumns(rounded)


@query(sql("SELECT * FROM scores", "scores"))
def score_all(spark, sf):
    return all_scores(spark, sf)


def _register_methods() -> None:
    for method in score.METHODS:

        def one(spark, sf, method=method):
            g = Graph(spark, sf, one_split=True)
            return score.score(g.candidates(), g.known(), g.counts() if method == "factaplus" else None, method, at_rest=True).withColumn("score", F.round(F.col("score").cast("double"), 9))

        one.__name__ = f"score_{method}"
        query(sql(f"SELECT x, y, CAST({method} AS DOUBLE) AS score FROM scores", "scores"))(one)


_register_methods()

_P = "CASE WHEN {0} > 0 THEN -({0}) / t * ln(({0}) / t) ELSE 0.0 END"


def _u(i: str, j: str, n: str) -> str:
    """The uncertainty coefficient in SQL."""
    h1 = lambda o: f"({_P.format(o)} + {_P.format(f't - {o}')})"
    h2 = " + ".join(f"({_P.format(c)})" for c in (n, f"{j} - {n}", f"{i} - {n}", f"t - {j} - {i}"))
    return f"(CASE WHEN {h1(i)} + {h1(j)} <> 0 THEN ({h1(i)} + {h1(j)} - ({h2})) / (0.5 * ({h1(i)} + {h1(j)})) ELSE 0.0 END)"


@query(sql(f"SELECT x, y, round({_u('oi', 'oj', 'n')}, 6) AS u FROM (SELECT a.x, a.y, a.n, p.n AS oi, q.n AS oj, (SELECT n FROM total) AS t FROM adj a JOIN tvocc p ON p.x = a.x JOIN tvocc q ON q.x = a.y)", "adj", "tvocc", "total"))
def anni_vectors(spark, sf):
    """Entries of co-occurring concepts; all others follow from ``anni_background``."""
    g = Graph(spark, sf, one_split=True)
    return anni.concept_vectors(g.known(), g.counts(), g.sentence_total()).withColumn("u", F.round("u", 6))


@query(sql(f"SELECT oi, oj, round({_u('oi', 'oj', '0')}, 6) AS u FROM (SELECT oi, oj, (SELECT n FROM total) AS t FROM k)", "tvocc", "cand", "total", k="SELECT DISTINCT least(p.n, q.n) AS oi, greatest(p.n, q.n) AS oj FROM cand c JOIN tvocc p ON p.x = c.x JOIN tvocc q ON q.x = c.y"))
def anni_background(spark, sf):
    """Values of the pairs of counts that candidates have."""
    g = Graph(spark, sf, one_split=True)
    return anni.background(g.candidates(), g.counts(), g.sentence_total()).withColumn("u", F.round("u", 6))


@query(sql("SELECT c.x, c.y, round(list_inner_product(a.v, b.v), 6) + 0.0 AS anni FROM cand c JOIN vec a ON a.z = c.x JOIN vec b ON b.z = c.y", "cand", "adj", "tvocc", "total",
    ends="SELECT x AS z FROM cand UNION SELECT y FROM cand",
    pairs="SELECT e.z, p.n AS oi, o.x AS y, o.n AS oj, coalesce(a.n, 0) AS n, (SELECT n FROM total) AS t FROM ends e JOIN tvocc p ON p.x = e.z CROSS JOIN tvocc o LEFT JOIN adj a ON a.x = e.z AND a.y = o.x",
    uu=f"SELECT z, y, {_u('oi', 'oj', 'n')} AS u FROM pairs", vec="SELECT z, list(u ORDER BY y) AS v FROM uu GROUP BY z"))
def score_anni(spark, sf):
    g = Graph(spark, sf, one_split=True)
    return anni.score_anni(g.candidates(), g.known(), g.counts(), g.sentence_total()).withColumn("anni", F.round("anni", 6) + 0.0)


# Factors.


@query(sql("SELECT a.x, b.x AS y, round(list_inner_product(a.u, b.v), 6) + 0.0 AS score FROM f a JOIN f b ON b.x = a.x + 1", "f"))
def svd_score_given_factors(spark, sf):
    f = Factors(spark, sf)
    return svd.score_pairs(f.neighbours, f.u, SIGMA, f.v, decimals=6).withColumn("score", F.col("score") + 0.0)


@query(sql(f"SELECT a.x, b.x AS y, CAST(k AS INT) AS k, round(list_inner_product(a.u[1:k], b.v[1:k]), 6) + 0.0 AS score FROM f a JOIN f b ON b.x = a.x + 1, range(1, {K + 1}) AS g(k)", "f"))
def svd_score_all_k(spark, sf):
    f = Factors(spark, sf)
    return svd.score_all_k(f.neighbours, f.u, SIGMA, f.v).withColumn("score", F.round("score", 6) + 0.0)


@query("SELECT CAST(substr(p_brand, 7) AS BIGINT) AS x, CAST(p_size AS BIGINT) AS y, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY ALL")
def svd_reconstruction(spark, sf):
    """A decomposition at full rank gives back the matrix (brands by sizes) it is of."""
    cells = table(spark, sf, "part").groupBy(F.substring("p_brand", 7, 9).cast("long").alias("x"), F.col("p_size").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rank = min(cells.select("x").distinct().count(), cells.select("y").distinct().count())
    u, sigma, v, _ = svd.train(cells, rank)
    values = F.array(*(F.lit(s) for s in sigma))
    dot = F.aggregate(F.zip_with(F.zip_with("p", values, lambda a, b: a * b), "q", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    both = cells.select("x", "y").join(u.withColumnRenamed("f", "p"), "x").join(v.select(F.col("x").alias("y"), F.col("f").alias("q")), "y")
    return both.select("x", "y", F.round(dot, 6).alias("n"))


_ABOVE = "SELECT a.x, b.x AS y, list_inner_product(a.u, b.v) AS score FROM f a JOIN f b ON a.x < b.x WHERE list_inner_product(a.u, b.v) > 0.1"


@query(sql("SELECT count(*) AS predictions FROM above WHERE y <> x + 1", "f", above=_ABOVE))
def count_predictions(spark, sf):
    f = Factors(spark, sf)
    return svd.count_predictions(f.ids, f.u, SIGMA, f.v, 0.1, f.neighbours)


@query(sql("SELECT x, y, round(score, 6) + 0.0 AS score FROM above", "f", above=_ABOVE))
def all_pairs_predictions(spark, sf):
    f = Factors(spark, sf)
    return svd.predictions(f.ids, f.u, SIGMA, f.v, 0.1).withColumn("score", F.round("score", 6))


@query(sql("SELECT least(a.x, b.x) AS x, greatest(a.x, b.x) AS y, round(list_inner_product(p.u, q.v), 6) AS score FROM f a JOIN f b ON a.label = 0 AND b.label = 1 JOIN f p ON p.x = least(a.x, b.x) JOIN f q ON q.x = greatest(a.x, b.x) WHERE list_inner_product(p.u, q.v) > 0.02 AND abs(a.x - b.x) <> 1", "f"))
def cross_predictions(spark, sf):
    """Two given lists of ids, each with each, above a threshold and not known."""
    f = Factors(spark, sf)
    accepted = lambda n: f.of_label(n).join(f.ids, "x", "left_semi")
    return svd.cross_predictions(accepted(0), accepted(1), f.u, SIGMA, f.v, 0.02, f.neighbours).withColumn("score", F.round("score", 6))


# Evaluation.


def _curve(ratio: str) -> str:
    return f"""SELECT method, tp / CAST(p AS DOUBLE) AS tpr, fp / CAST(q AS DOUBLE) AS fpr, CASE WHEN tp + fp > 0 THEN 0.2 * tp / (0.2 * tp + (1 - 0.2) * {ratio} * fp) ELSE 0.0 END AS prec,
      tp, fp, q - fp AS tn, p - tp AS fn, threshold FROM counted"""


_F1 = "CASE WHEN tpr + prec <> 0 THEN 2 * tpr * prec / (tpr + prec) ELSE 0.0 END"
_POINTS = f"SELECT method, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(prec, 9) AS precision, round({_F1}, 9) AS f1, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, threshold FROM curve"
_RATIO = "(p / CAST(q AS DOUBLE))"


def _rounded(curve: DataFrame) -> DataFrame:
    return curve.withColumns({c: F.round(c, 9) for c in ("tpr", "fpr", "precision", "f1")})


@query(sql(_POINTS, "counted", curve=_curve(_RATIO)))
def eval_sweep(spark, sf):
    return _rounded(evaluate.sweep(graded(spark, sf), 0.2))


@query(sql(_POINTS, "counted", curve=_curve("1.0")))
def eval_sweep_old(spark, sf):
    return _rounded(evaluate.sweep(graded(spark, sf), 0.2, prior_ratio=False))


@query(sql("SELECT method, round(sum((tpr - nr) * (prec + np) / 2), 6) AS auc FROM (SELECT method, tpr, prec, coalesce(lead(tpr) OVER w, 0.0) AS nr, coalesce(lead(prec) OVER w, 1.0) AS np FROM curve WINDOW w AS (PARTITION BY method ORDER BY tpr DESC, prec DESC)) GROUP BY method", "counted", curve=_curve(_RATIO)))
def pr_auc(spark, sf):
    return evaluate.pr_auc(evaluate.sweep(graded(spark, sf), 0.2)).withColumn("auc", F.round("auc", 6))


@query(sql(f"SELECT method, threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, threshold DESC) AS r FROM (SELECT *, {_F1} AS f1 FROM curve)) WHERE r = 1", "counted", curve=_curve(_RATIO)))
def best_threshold(spark, sf):
    return evaluate.best_threshold(evaluate.sweep(graded(spark, sf), 0.2)).withColumn("f1", F.round("f1", 6))


def _k_scores(spark, sf) -> DataFrame:
    """Every k's scores of neighbouring vectors; the class is whether their labels agree."""
    f = Factors(spark, sf)
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    same = labels.alias("a").join(labels.alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select(F.col("a.vec_id").alias("x"), (F.col("a.label") <= F.col("b.label")).cast("int").alias("class"))
    return svd.score_all_k(f.neighbours, f.u, SIGMA, f.v).join(same, "x")


@query(sql("SELECT CAST(k AS INT) AS k, round(auc, 6) AS auc FROM (SELECT *, row_number() OVER (ORDER BY auc DESC, k) AS r FROM areas) WHERE r = 1", "f",
    sc=f'SELECT CAST(k AS VARCHAR) AS method, round(list_inner_product(a.u[1:k], b.v[1:k]), 6) AS score, CAST(a.label <= b.label AS INT) AS "class" FROM f a JOIN f b ON b.x = a.x + 1, range(1, {K + 1}) AS g(k)',
    by_score='SELECT method, score AS threshold, sum("class") AS pos, sum(1 - "class") AS neg FROM sc GROUP BY ALL', counted=CTE["counted"], curve=_curve(_RATIO),
    areas="SELECT CAST(method AS INT) AS k, round(sum((tpr - nr) * (prec + np) / 2), 9) AS auc FROM (SELECT method, tpr, prec, coalesce(lead(tpr) OVER w, 0.0) AS nr, coalesce(lead(prec) OVER w, 1.0) AS np FROM curve WINDOW w AS (PARTITION BY method ORDER BY tpr DESC, prec DESC)) GROUP BY method"))
def best_k(spark, sf):
    """All numbers of singular values in one pass, and the one of greatest area."""
    scored = _k_scores(spark, sf).select(F.col("k").cast("string").alias("method"), F.round("score", 6).alias("score"), "class")
    areas = evaluate.pr_auc(evaluate.sweep(scored, 0.2)).select(F.col("method").cast("int").alias("k"), F.round("auc", 9).alias("auc"))
    return evaluate.best_k(areas).withColumn("auc", F.round("auc", 6))


#: Class balances of the grid (fixed values).
_BALANCES = [0.00141446976033217173, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]


@query(sql("SELECT method, cb AS class_balance, round(sum((nr - r) * (p + np) / 2), 6) AS auc FROM (SELECT method, cb, r, p, coalesce(lead(r) OVER w, 1.0) AS nr, coalesce(lead(p) OVER w, 0.0) AS np FROM pts WINDOW w AS (PARTITION BY method, cb ORDER BY score DESC, doc_id)) GROUP BY ALL", "graded",
    c='SELECT method, doc_id, score, sum("class") OVER w AS tp, sum(1 - "class") OVER w AS fp, sum("class") OVER (PARTITION BY method) AS pos FROM graded WINDOW w AS (PARTITION BY method ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)',
    pts=f"SELECT method, doc_id, score, cb, tp / CAST(pos AS DOUBLE) AS r, cb * tp / (cb * tp + (1 - cb) * fp) AS p FROM c, (SELECT unnest({[float(b) for b in _BALANCES]}::DOUBLE[]) AS cb)"))
def pr_auc_balance_grid(spark, sf):
    return evaluate.balance_grid(graded(spark, sf), _BALANCES, ["doc_id"]).withColumn("auc", F.round("auc", 6))


_TITLED = "CASE method WHEN 'prefattach' THEN 'Preferential Attachment' WHEN 'factaplus' THEN 'FACTA+' WHEN 'jaccard' THEN 'Jaccard' WHEN 'arrowsmith' THEN 'Arrowsmith' WHEN 'bitola' THEN 'BITOLA' WHEN 'amw' THEN 'AMW' WHEN 'ltc_amw' THEN 'LTC-AMW' END"


@query(sql(f"SELECT x, y, CASE \"class\" WHEN 1 THEN 'Positive' ELSE 'Negative' END AS \"class\", {_TITLED} AS method, score FROM melted", "melted"))
def melt_scores(spark, sf):
    long = score.melt(all_scores(spark, sf), keep=("x", "y", "class"))
    return long.select("x", "y", F.when(F.col("class") == 1, "Positive").otherwise("Negative").alias("class"), score.title().alias("method"), "score")


@query(sql("SELECT t.year, count(*) AS total, count(*) FILTER (coalesce(s, 0) > 1) AS predicted, round(count(*) FILTER (coalesce(s, 0) > 1) / count(*), 6) AS recall FROM test t LEFT JOIN w USING (x, y) WHERE t.year <> 2001 GROUP BY t.year", "test", "adj",
    w="SELECT t.x, t.y, count(*) AS s FROM test t JOIN adj a ON a.x = t.x JOIN adj b ON b.x = t.y AND b.y = a.y GROUP BY t.x, t.y"))
def yearly_recall(spark, sf):
    g = Graph(spark, sf, one_split=True)
    found = score.score(g.testing(), g.known(), None, "arrowsmith", at_rest=True)
    scored = g.testing().select("year", "x", "y").join(found, ["x", "y"])
    return evaluate.yearly_recall(scored, 1, partial_year=2001).withColumn("recall", F.round("recall", 6))


_BEST = "SELECT method, arg_max(threshold, (f1, threshold)) AS threshold FROM (SELECT method, threshold, CASE WHEN tpr + prec <> 0 THEN round(2 * tpr * prec / (tpr + prec), 9) ELSE 0.0 END AS f1 FROM curve) GROUP BY method"


@query(sql("SELECT methods, count(*) AS pairs FROM (SELECT x, y, string_agg(method, '+' ORDER BY method) AS methods FROM melted JOIN best USING (method) WHERE score > threshold GROUP BY x, y) GROUP BY methods", "melted",
    by_score='SELECT method, score AS threshold, sum("class") AS pos, sum(1 - "class") AS neg FROM melted GROUP BY ALL', counted=CTE["counted"], curve=_curve(_RATIO), best=_BEST))
def prediction_overlap(spark, sf):
    long = settled(score.melt(all_scores(spark, sf), keep=("x", "y", "class")))
    curve = evaluate.sweep(long, 0.2).withColumn("f1", F.round("f1", 9))
    return evaluate.overlap(evaluate.predicted_pairs(long, evaluate.best_threshold(curve)))


_GRADINGS = """SELECT d.doc_id AS x, d.doc_id AS y, l.quality AS "class", unnest(['length', 'lines', 'remainder']) AS method,
  unnest([CAST(n_chars AS DOUBLE), CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS DOUBLE), CAST(n_chars % 97 AS DOUBLE)]) AS score FROM labels l JOIN documents d USING (doc_id)"""


@query(sql("SELECT methods, count(*) AS pairs FROM (SELECT x, y, string_agg(method, '+' ORDER BY method) AS methods FROM melted JOIN best USING (method) WHERE score > threshold GROUP BY x, y) GROUP BY methods",
    melted=_GRADINGS, by_score='SELECT method, score AS threshold, sum("class") AS pos, sum(1 - "class") AS neg FROM melted GROUP BY ALL', counted=CTE["counted"], curve=_curve(_RATIO), best=_BEST))
def graded_overlap(spark, sf):
    """Which of three unlike scores of documents predict the same ones."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    lines = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("")))
    wide = docs.select(F.col("doc_id").alias("x"), F.col("doc_id").alias("y"), F.col("quality").alias("class"), F.col("n_chars").alias("length"), lines.alias("lines"), (F.col("n_chars") % 97).alias("remainder"))
    long = settled(score.melt(wide, ("length", "lines", "remainder"), ("x", "y", "class")))
    curve = evaluate.sweep(long, 0.2).withColumn("f1", F.round("f1", 9))
    return evaluate.overlap(evaluate.predicted_pairs(long, evaluate.best_threshold(curve)))


# Reports.


def _names(spark, sf) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_partkey").cast("string").alias("cuid"), F.col("p_name").alias("term"))
    return part.select("term_id", "cuid"), part.select("cuid", "term")


@query(sql('SELECT c.x, c.y, c."class", c.arrowsmith, CAST(c.x AS VARCHAR) AS cuid_x, CAST(c.y AS VARCHAR) AS cuid_y, coalesce(p.p_name, \'\') AS term_x, coalesce(q.p_name, \'\') AS term_y FROM scores c LEFT JOIN part p ON p.p_partkey = c.x LEFT JOIN part q ON q.p_partkey = c.y ORDER BY arrowsmith DESC, x, y LIMIT 10', "scores"))
def top_explanations(spark, sf):
    rows = predict.named(all_scores(spark, sf, ("arrowsmith",)).select("x", "y", "class", "arrowsmith"), *_names(spark, sf))
    return predict.top(rows.select("x", "y", "class", "arrowsmith", "cuid_x", "cuid_y", "term_x", "term_y"), [F.desc("arrowsmith"), F.col("x"), F.col("y")])


_LIST = "(SELECT x, y, \"class\", bitola, arrowsmith, '{0}' AS list FROM scores {1} ORDER BY {2}, x, y LIMIT 10)"


@query(sql(" UNION ALL ".join((_LIST.format("best", "", "bitola DESC"), _LIST.format("few_links", "WHERE bitola > 2", "arrowsmith"), _LIST.format("low_score", "WHERE arrowsmith > 1", "bitola"), _LIST.format("false_best", 'WHERE "class" = 0', "bitola DESC"))), "scores"))
def explanation_lists(spark, sf):
    """The four ranked lists, by the BITOLA score and the number of linking terms."""
    rows = settled(all_scores(spark, sf, ("bitola", "arrowsmith")).select("x", "y", "class", "bitola", "arrowsmith"))
    return predict.explanation_lists(rows, "bitola", "arrowsmith", 2, 1, ["x", "y"])


@query(sql("SELECT a.y AS link, a.n AS n_x, b.n AS n_y FROM best JOIN adj a ON a.x = best.x JOIN adj b ON b.x = best.y AND b.y = a.y", "scores", best="SELECT x, y FROM scores ORDER BY arrowsmith DESC, x, y LIMIT 1"))
def explain_pair(spark, sf):
    """The linking terms of the candidate pair that has most."""
    g = Graph(spark, sf, at_rest=True)
    links = score.score(g.candidates(), g.known(), g.counts(), "arrowsmith", at_rest=True)
    best = links.orderBy(F.desc("score"), "x", "y").first()
    return score.shared_links(best["x"], best["y"], g.known())


@query(sql("SELECT 'documents' AS statistic, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'terms', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'known', count(*) FROM tv UNION ALL SELECT 'ids', count(*) FROM tvids UNION ALL SELECT 'testing', count(*) FROM test", "test", "tv"))
def corpus_statistics(spark, sf):
    g = Graph(spark, sf, at_rest=True)
    return predict.corpus_statistics(documents=table(spark, sf, "documents"), pages=table(spark, sf, "pages"), terms=table(spark, sf, "part").select("p_brand").distinct(), known=g.known(), ids=g.ids(), testing=g.testing())


# Vocabulary and text.


def _concepts(spark, sf) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    return part.select(F.col("p_brand").alias("cuid"), F.when(F.col("p_partkey") % 4 == 0, "FRE").otherwise("ENG").alias("language"), F.col("p_name").alias("term"), F.col("p_partkey").alias("line")), part.select(F.col("p_brand").alias("cuid"), F.col("p_type").alias("type_id"))


@query("SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS term_id, p_brand AS cuid, list_sort(list(DISTINCT p_type)) AS types, list_sort(list(DISTINCT lower(p_name)) FILTER (p_partkey % 4 <> 0)) AS terms FROM part GROUP BY p_brand HAVING count(*) FILTER (p_partkey % 4 <> 0) > 0")
def wordlist(spark, sf):
    return vocab.wordlist(*_concepts(spark, sf))


@query("SELECT p_brand AS cuid, list_sort(list(DISTINCT p_type)) AS types, arg_min(p_name, p_partkey) FILTER (p_partkey % 4 <> 0) AS term FROM part GROUP BY p_brand HAVING count(*) FILTER (p_partkey % 4 <> 0) > 0")
def cuid_mapping(spark, sf):
    return vocab.cuid_mapping(*_concepts(spark, sf))


#: White space, words and tokens in RE2, as in ``functions.text``.
_WHITE = "[ \\t\\n\\x0B\\f\\r]"
_WORD = "[\\p{L}\\p{M}\\p{N}_]"
_TOKEN = f"{_WORD}+(?:[-'']{_WORD}+)*|[^\\s\\x0B\\p{{L}}\\p{{M}}\\p{{N}}_]"


def _sentences(text: str) -> str:
    """Pieces between white space that follows an end sign, empty ones left out; chr(1) is in no text."""
    return f"list_filter(string_split(regexp_replace({text}, '([.!?]){_WHITE}+', '\\1' || chr(1), 'g'), chr(1)), lambda p: length(p) > 0)"


def _tokens(sentence: str) -> str:
    """Tokens in lower case; none if a word has 900 bytes or more."""
    return f"CASE WHEN len(list_filter(string_split_regex(trim({sentence}), '{_WHITE}+'), lambda w: strlen(w) >= 900)) > 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(regexp_extract_all({sentence}, '{_TOKEN}'), lambda w: lower(w)) END"


@query(f"SELECT doc_id, CAST(len({_sentences('text')}) AS INT) AS n_sentences FROM documents")
def sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query(f"SELECT doc_id, sentence, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, sentence, {_tokens('s')} AS t FROM (SELECT doc_id, unnest(range(len(p))) AS sentence, unnest(p) AS s FROM (SELECT doc_id, {_sentences('text')} AS p FROM documents)))")
def tokens(spark, sf):
    """Tokens of every sentence of every document."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence", "s"))
    found = T.lowered(T.tokens(F.col("s")))
    return rows.select("doc_id", F.col("sentence").cast("long").alias("sentence"), F.size(found).alias("n_tokens"), F.md5(F.array_join(found, " ").cast("binary")).alias("tokens"))


_BRACKETS = "regexp_replace(regexp_replace(regexp_replace({0}, '\\([\\W\\s]*\\)', ' ', 'g'), '\\[[\\W\\s]*\\]', ' ', 'g'), '\\{{[\\W\\s]*\\}}', ' ', 'g')"


@query(f"SELECT doc_id, md5(trim(regexp_replace({_BRACKETS.format('text')}, '\\p{{C}}', '', 'g'))) AS normal FROM documents")
def normalise_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalise(F.col("text")).cast("binary")).alias("normal"))


_MINE = {
    "texts": f"SELECT CAST(1995 + doc_id % 7 AS INT) AS year, doc_id, sentence, {_tokens('s')} AS t FROM (SELECT doc_id, unnest(range(len(p))) AS sentence, unnest(p) AS s FROM (SELECT doc_id, {_sentences('normal')} AS p FROM normals))",
    "words": f"SELECT t, row_number() OVER (ORDER BY t) - 1 AS term_id FROM (SELECT DISTINCT unnest({_tokens('text')}) AS t FROM benchmark)",
    "hits": "SELECT DISTINCT year, doc_id, sentence, term_id FROM (SELECT year, doc_id, sentence, unnest(t) AS t FROM texts) JOIN words USING (t)",
}
_NORMAL = f"SELECT doc_id, trim(regexp_replace({_BRACKETS.format("replace(text, chr(10), ' ')")}, '\\p{{C}}', '', 'g')) AS normal FROM documents"


@query(sql("""SELECT 'COOCCURRENCE' AS kind, a.year, a.term_id AS x, b.term_id AS y, count(*) AS n FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.sentence = b.sentence AND a.term_id < b.term_id GROUP BY ALL
  UNION ALL SELECT 'OCCURRENCE', year, term_id, NULL, count(*) FROM hits GROUP BY ALL UNION ALL SELECT 'SENTENCECOUNT', year, NULL, NULL, count(*) FROM texts GROUP BY ALL""", normals=_NORMAL, **_MINE))  # fmt: skip
def mined_texts(spark, sf):
    """Whole documents to merged records, with the benchmark's words as dictionary; a document's year is made of its id."""
    words, texts = _mined(spark, sf)
    return mine.mine_texts(texts, words, 1)


def _mined(spark, sf) -> tuple[DataFrame, DataFrame]:
    words = table(spark, sf, "benchmark").select(F.explode(T.lowered(T.tokens(F.col("text")))).alias("t")).distinct()
    ranked = words.select(F.array("t").alias("tokens"), (F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("term_id"))  # a vocabulary
    texts = table(spark, sf, "documents").select("doc_id", (1995 + F.col("doc_id") % 7).cast("int").alias("year"), F.array("text").alias("blocks"))
    return settled(ranked), texts


@query(sql("""SELECT 'COOCCURRENCE' AS kind, a.year, a.term_id AS x, b.term_id AS y, count(*) AS n FROM of_document a JOIN of_document b ON a.doc_id = b.doc_id AND a.term_id < b.term_id GROUP BY ALL
  UNION ALL SELECT 'OCCURRENCE', year, term_id, NULL, count(*) FROM of_document GROUP BY ALL UNION ALL SELECT 'SENTENCECOUNT', CAST(1995 + doc_id % 7 AS INT), NULL, NULL, count(*) FROM documents GROUP BY ALL""", normals=_NORMAL, **_MINE, of_document="SELECT DISTINCT year, doc_id, term_id FROM hits"))  # fmt: skip
def mined_documents(spark, sf):
    """As ``mined_texts``, a whole document being the unit in which terms meet."""
    words, texts = _mined(spark, sf)
    return mine.mine_texts(texts, words, 1, level="document")


_TOKENS = "regexp_extract_all(lower({0}), '[a-z]+')"


@query(sql("SELECT doc_id, count(*) AS n_mentions, count(DISTINCT t) AS n_terms FROM (SELECT doc_id, unnest(" + _TOKENS.format("text") + ") AS t FROM documents) JOIN dict USING (t) GROUP BY doc_id", dict="SELECT DISTINCT unnest(" + _TOKENS.format("text") + ") AS t FROM benchmark"))
def tag_terms_unigram(spark, sf):
    """Mentions of the benchmark's words in whole documents."""
    words = lambda name: F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    terms = table(spark, sf, "benchmark").select(words("benchmark").alias("t")).distinct()
    found = table(spark, sf, "documents").select("doc_id", words("documents").alias("t"))
    per_word = found.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).join(terms, "t")
    return per_word.groupBy("doc_id").agg(F.sum("n").alias("n_mentions"), F.count(F.lit(1)).alias("n_terms"))


@query(sql("""SELECT doc_id, CAST(sentence AS INT) AS sentence, list_reduce(hits, lambda acc, h: CASE WHEN len(list_intersect(acc.taken, h.taken)) = 0 THEN {'taken': list_concat(acc.taken, h.taken), 'ids': list_concat(acc.ids, h.ids)} ELSE acc END).ids AS ids
  FROM (SELECT doc_id, sentence, list({'taken': range(i, i + l), 'ids': [term_id]} ORDER BY l DESC, i) AS hits FROM hits GROUP BY doc_id, sentence)""",
    tok=f"SELECT {_tokens('s')} AS t FROM (SELECT unnest({_sentences('text')}) AS s FROM benchmark)",
    terms="SELECT array_to_string(t, ' ') AS term, len(t) AS l FROM tok WHERE len(t) > 0 UNION SELECT w, 1 FROM (SELECT unnest(t) AS w FROM tok)",
    ranked="SELECT term, l, row_number() OVER (ORDER BY term) - 1 AS term_id FROM terms",
    sents=f"SELECT doc_id, sentence, {_tokens('s')} AS t FROM (SELECT doc_id, unnest(range(len(p))) AS sentence, unnest(p) AS s FROM (SELECT doc_id, {_sentences('text')} AS p FROM documents))",
    places="SELECT doc_id, sentence, t, unnest(range(1, len(t) + 1)) AS i FROM sents",
    grams="SELECT doc_id, sentence, i, l, array_to_string(t[i:i + l - 1], ' ') AS term FROM places JOIN (SELECT DISTINCT string_split(term, ' ')[1] AS f, l FROM terms) ON f = t[i] AND i + l - 1 <= len(t)",
    hits="SELECT doc_id, sentence, i, l, term_id FROM grams JOIN ranked USING (term, l)"))
def tag_terms_longest(spark, sf):
    """Longest-match tagging of every sentence with the benchmark's sentences and words, whole terms of any length."""
    items = table(spark, sf, "benchmark").select(F.explode(T.sentences(F.col("text"))).alias("s")).select(T.lowered(T.tokens(F.col("s"))).alias("t"))
    terms = items.unionByName(items.select(F.explode("t").alias("w")).select(F.array("w").alias("t"))).where(F.size("t") > 0).distinct()
    words = settled(terms.select(F.col("t").alias("tokens"), (F.row_number().over(Window.orderBy(F.array_join("t", " "))) - 1).cast("long").alias("term_id")))  # a vocabulary
    longest = words.agg(F.max(F.size("tokens"))).first()[0] or 1
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence", "s"))
    return vocab.tag(docs.select("doc_id", "sentence", T.tokens(F.col("s")).alias("tokens")), words, longest)


@query(None)
def html_blocks(spark, sf):
    """Visible text blocks of every page."""
    return markup.html_to_blocks(table(spark, sf, "pages").select("page_id", "html"), "html").select("page_id", "blocks")


_DATES = "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate) + 1 END AS VARCHAR) AS y, CASE WHEN o_orderkey % 3 = 1 THEN NULL WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y %b') ELSE strftime(o_orderdate, '%m/%d/%y') END AS d FROM orders"


@query(f"""SELECT o_orderkey, coalesce(TRY_CAST(substr(d, 1, 4) AS INT), TRY_CAST(y AS INT), 0) AS simple, CAST(robust AS INT) AS robust, robust BETWEEN 1800 AND 1999 AS valid FROM (
  SELECT *, CASE WHEN d IS NULL THEN CAST(y AS INT) WHEN d LIKE '%/%/%' THEN CASE WHEN CAST(substr(d, 7, 2) AS INT) <= 25 THEN 2000 ELSE 1900 END + CAST(substr(d, 7, 2) AS INT) ELSE CAST(substr(d, 1, 4) AS INT) END AS robust FROM ({_DATES}))""")
def years(spark, sf):
    """Years of dates as citations spell them; ``valid`` is judged as of 1998."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    rows = table(spark, sf, "orders").select(
        key,
        F.when(key % 3 != 0, (F.year(date) + 1).cast("string")).alias("y"),
        F.when(key % 3 == 1, None).when(key % 2 == 0, F.date_format(date, "yyyy MMM")).otherwise(F.date_format(date, "MM/dd/yy")).alias("d"),
    )
    found = rows.select("o_orderkey", T.simple_year(F.col("y"), F.col("d")).alias("simple"), T.robust_year(F.col("y"), F.col("d"), 2024).alias("robust"))
    return found.withColumn("valid", T.valid_year(F.col("robust"), 1998))


@query(f"""SELECT DISTINCT p_partkey AS term_id, array_to_string(k, ' ') AS tokens FROM (SELECT p_partkey, {_tokens('s')} AS k FROM (SELECT p_partkey, unnest([p_name, p_type, p_brand, substr(p_type, 1, 2)]) AS s FROM part))
  WHERE len(k) > 0 AND strlen(array_to_string(k, '')) > 2 AND array_to_string(k, ' ') NOT IN (SELECT lower(p_type) FROM part WHERE p_size = 1)""")
def dictionary(spark, sf):
    """Keys of names, types and brands; types of the smallest size are stop-words, short keys are dropped."""
    part = table(spark, sf, "part")
    terms = part.select(F.col("p_partkey").alias("term_id"), F.concat_ws("|", "p_name", "p_type", "p_brand", F.substring("p_type", 1, 2)).alias("synonyms"))
    stop = part.where("p_size = 1").select(F.lower("p_type").alias("term")).distinct()
    return vocab.dictionary(terms, stop, drop_short=True).select("term_id", F.array_join("tokens", " ").alias("tokens"))


@query("SELECT DISTINCT p_type AS type_id FROM part WHERE p_brand <> 'Brand#1' AND p_type NOT LIKE '%SMALL%'")
def selected_types(spark, sf):
    """Types whose group is among the kept ones and whose name is no finding."""
    part = table(spark, sf, "part")
    group = F.when(F.col("p_brand") == "Brand#1", "OCCU").otherwise("CHEM").alias("group")
    name = F.when(F.col("p_type").contains("SMALL"), "Finding").otherwise("Drug").alias("type_name")
    return vocab.selected_types(part.select(group, F.lit("n").alias("name"), F.col("p_type").alias("type_id"), name))


@query(sql("SELECT 'cooccurrence' AS what, x, y, n FROM tv UNION ALL SELECT 'occurrence', x, NULL, n FROM tvocc UNION ALL SELECT 'ids', x, NULL, NULL FROM tvids UNION ALL SELECT 'relations', x, y, NULL FROM tv UNION ALL SELECT 'sentences', NULL, NULL, CAST(n AS BIGINT) FROM total", "tv", "tvocc", "tvids", "total"))
def matrix_files(spark, sf):
    """Matrices written as sorted text files and read again."""
    g = Graph(spark, sf, at_rest=True)
    empty = F.lit(None).cast("long")
    sentences = dataset.known_sentences(g.sentences, SPLIT)
    written = {"cooccurrence": g.known().select("x", "y", "n"), "occurrence": g.counts().select("x", "n"), "ids": g.ids(), "sentences": sentences}
    at = {name: new_folder(spark) for name in written}
    for name, df in written.items():
        tables.write_matrix(df, at[name]) if len(df.columns) > 1 else df.write.csv(at[name], sep="\t")
    read = {
        "cooccurrence": tables.read_cooccurrences(spark, at["cooccurrence"]),
        "occurrence": tables.read_occurrences(spark, at["occurrence"]).select("x", empty.alias("y"), "n"),
        "ids": tables.read_ids(spark, at["ids"]).select("x", empty.alias("y"), empty.alias("n")),
        "relations": tables.read_relations(spark, at["cooccurrence"]).select("x", "y", empty.alias("n")),
        "sentences": tables.read_sentence_count(spark, at["sentences"]).select(empty.alias("x"), empty.alias("y"), "n"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("what"), "x", "y", "n") for name, df in read.items()])


@query(sql("SELECT 'COOCCURRENCE' AS kind, x, y, n FROM co UNION ALL SELECT 'OCCURRENCE', x, NULL, n FROM occ UNION ALL SELECT 'SENTENCECOUNT', NULL, NULL, count(*) FROM orders GROUP BY year(o_orderdate)", "co", "occ"))
def record_files(spark, sf):
    """Tagged lines written as text, read and routed by kind."""
    g = Graph(spark, sf)
    line = lambda *c: F.concat_ws("\t", *c).alias("value")
    lines = g.cooccurrence.select(line(F.lit("COOCCURRENCE"), "x", "y", "n")).unionByName(g.occurrence.select(line(F.lit("OCCURRENCE"), "x", "n"))).unionByName(g.sentences.select(line(F.lit("SENTENCECOUNT"), "n")))
    at = new_folder(spark)
    lines.write.text(at)
    kinds = tables.read_mined(spark, at)
    column = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("long").alias(c)
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), *(column(df, c) for c in ("x", "y", "n"))) for kind, df in kinds.items()])


@query("SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS term_id, p_brand AS cuid, list_sort(list(DISTINCT p_type)) AS types, list_sort(list(DISTINCT lower(p_name))) AS terms FROM part GROUP BY p_brand")
def vocabulary_files(spark, sf):
    """Concept and type files between bars, read into a word-list, written and read again."""
    part = table(spark, sf, "part")
    concepts, types, words = (new_folder(spark) for _ in range(3))
    part.select(F.concat_ws("|", "p_brand", F.lit("ENG"), *(F.lit("-") for _ in range(12)), "p_name", F.lit("-")).alias("value")).write.text(concepts)
    part.select(F.concat_ws("|", "p_brand", "p_type").alias("value")).write.text(types)
    tables.write_wordlist(vocab.wordlist(tables.read_rrf_concepts(spark, concepts), tables.read_rrf_types(spark, types)), words)
    return tables.read_wordlist(spark, words)


@query("SELECT vec_id AS x, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 6) + 0.0) AS f FROM embeddings")
def factor_files(spark, sf):
    """Factors written as blank-separated lines under a comment, and read again."""
    rows = table(spark, sf, "embeddings").select(F.concat_ws(" ", F.col("vec_id").cast("string"), *(F.col("embedding")[i].cast("double").cast("string") for i in range(2 * K))).alias("value"))
    at = new_folder(spark)
    rows.unionByName(spark.createDataFrame([("% rows of U",)], "value string")).write.text(at)
    return tables.read_factors(spark, at).select("x", F.transform("f", lambda v: F.round(v, 6) + 0.0).alias("f"))


@query("SELECT a.vec_id AS x, a.vec_id + 1 AS y, CASE WHEN b.vec_id IS NULL THEN -1.0 ELSE round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 END AS anni FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def score_dense_vectors(spark, sf):
    """Products of vectors given; -1 where one is missing."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("x"), F.col("embedding").alias("vec"))
    return anni.score_dense(Factors(spark, sf).neighbours, rows).withColumn("anni", F.round("anni", 6) + 0.0)


@query(sql("SELECT methods, count(*) AS pairs FROM (SELECT x, y, string_agg(method, '+' ORDER BY method) AS methods FROM melted JOIN best USING (method) WHERE score > threshold AND \"class\" = 1 GROUP BY x, y) GROUP BY methods", "melted",
    by_score='SELECT method, score AS threshold, sum("class") AS pos, sum(1 - "class") AS neg FROM melted GROUP BY ALL', counted=CTE["counted"], curve=_curve(_RATIO), best=_BEST))
def correct_prediction_overlap(spark, sf):
    """As ``prediction_overlap``, of true pairs only."""
    long = settled(score.melt(all_scores(spark, sf), keep=("x", "y", "class")))
    curve = evaluate.sweep(long, 0.2).withColumn("f1", F.round("f1", 9))
    return evaluate.overlap(evaluate.predicted_pairs(long, evaluate.best_threshold(curve), correct_only=True))


# Decomposition of the graph: train, choose, predict.


def _graph_factors(spark, sf, last: int, k: int):
    """Factors of the mirrored binary matrix up to a year, at rest."""
    g = Graph(spark, sf, at_rest=True)
    u, sigma, v, _ = svd.train(_binary(g, last), k)
    return g, u, sigma, v


def _binary(g: Graph, last: int) -> DataFrame:
    return g.once("binary", last, lambda: matrix.transform(g.known(last), mirrored=True, values="binary"))


@query(f"SELECT CAST(factor AS INT) AS factor, CAST(0 AS DOUBLE) AS left_residual, CAST(0 AS DOUBLE) AS right_residual FROM range({GRAPH_K}) AS r(factor)")
def svd_residuals(spark, sf):
    """Of each factor trained on the graph, how far products of matrix and factor are from sigma times the other one."""
    g, u, sigma, v = _graph_factors(spark, sf, SPLIT, GRAPH_K)
    found = svd.residuals(_binary(g, SPLIT), u, sigma, v)
    return found.select("factor", F.round("left", 4).alias("left_residual"), F.round("right", 4).alias("right_residual"))


@query(f"SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(i = j AS DOUBLE) AS left_dot, CAST(i = j AS DOUBLE) AS right_dot FROM range({GRAPH_K}) AS a(i), range({GRAPH_K}) AS b(j)")
def svd_orthonormal(spark, sf):
    """Products of all pairs of factors trained on the graph."""
    _, u, _, v = _graph_factors(spark, sf, SPLIT, GRAPH_K)
    both = svd.gram(u, GRAPH_K).withColumnRenamed("dot", "l").join(svd.gram(v, GRAPH_K).withColumnRenamed("dot", "r"), ["i", "j"])
    return both.select("i", "j", (F.round("l", 6) + 0.0).alias("left_dot"), (F.round("r", 6) + 0.0).alias("right_dot"))


@query(None)
def svd_graph_scores(spark, sf):
    """Scores of every candidate by ``GRAPH_K`` factors trained on the graph."""
    g, u, sigma, v = _graph_factors(spark, sf, SPLIT, GRAPH_K)
    return g.candidates().join(svd.score_pairs(g.candidates(), u, sigma, v), ["x", "y"])


@query(None)
def svd_chain(spark, sf):
    """Train on the years before the split, choose k and threshold on the validation year, train again and predict each test year."""
    g, u, sigma, v = _graph_factors(spark, sf, SPLIT - 1, GRAPH_K)
    held = g.validation_candidates()
    scored = settled(svd.score_all_k(held, u, sigma, v).join(held, ["x", "y"]).select(F.col("k").cast("string").alias("method"), "score", "class"))
    curve = settled(evaluate.sweep(scored, 0.2))
    areas = evaluate.pr_auc(curve).select(F.col("method").cast("int").alias("k"), F.round("auc", 9).alias("auc"))
    k = evaluate.best_k(areas).first()["k"]
    threshold = evaluate.best_threshold(curve.where(F.col("method") == str(k))).first()["threshold"]
    g, u, sigma, v = _graph_factors(spark, sf, SPLIT, k)
    tested = g.testing().select("year", "x", "y").join(svd.score_pairs(g.testing(), u, sigma, v), ["x", "y"])
    return evaluate.yearly_recall(tested, threshold).select(F.lit(k).alias("k"), F.lit(threshold).alias("threshold"), "year", "total", "predicted", "recall")


@query(None)
def nine_methods_auc(spark, sf):
    """Area under precision and recall of all nine methods over every candidate; ends without an occurrence or factor score 0."""
    g, u, sigma, v = _graph_factors(spark, sf, SPLIT, GRAPH_K)
    candidates = g.candidates()
    wide = score.score_all(candidates, g.known(), g.counts(), at_rest=True).join(anni.score_anni(candidates, g.known(), g.counts(), g.sentence_total()), ["x", "y"], "left").join(svd.score_pairs(candidates, u, sigma, v).withColumnRenamed("score", "svd"), ["x", "y"], "left")
    long = settled(score.melt(candidates.join(wide, ["x", "y"]), (*score.METHODS, "anni", "svd"), ("class",)).withColumn("score", F.coalesce("score", F.lit(0.0))))
    return evaluate.pr_auc(evaluate.sweep(long, 0.2)).select(score.title().alias("method"), "auc")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph, holdout, candidates and all neighbourhood scores, end to end."""
    return all_scores(spark, sf_dir)
