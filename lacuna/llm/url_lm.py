r"""URL filter by the likelihood ratio of two character language models.

Rules accept or reject what they fit.  The URLs they judge teach two smoothed
variable-order Markov models, one of accepted and one of rejected URLs; all
other URLs are judged by the difference of their length-normalised
log-likelihoods against a calibrated threshold.

A model interpolates orders 0 to ``ORDER``: p_k = (n(context, char) + L * p_(k-1))
/ (n(context) + L), so a context not seen backs off to the next shorter one by
itself.  Counts are exact: every position of every judged URL gives a window of
``ORDER`` + 1 characters, windows are counted by class in one shuffle, and the
counts of all shorter grams are sums of those.  The table grows with the corpus.

A position's log-ratio depends on its window only, so it is computed once for
each distinct window of the URLs to be scored: the window's grams of every order
are joined with the counts.  A URL's ratio is the mean over its positions.
Windows that make up 1/``HOT`` of all positions or more (so ``HOT`` of them at
most) are broadcast with their values; positions of all others meet theirs in a
shuffle, in which no window has a large share.

Calibration: of the judged URLs, those whose crc32 is divisible by ``FOLD`` are
scored by counts without that fold; their ratios go into a histogram of ``BINS``
bins for each class, and the threshold is the edge with the least sum of the two
error rates.  The ratios of all other URLs use the counts of all folds.

Defined cases: a URL without ``://`` or null has an empty host and path and no
rule; null, empty and all other URLs without a rule are scored (null as empty);
URLs of any length are scored whole; if only one class was seen, everything
without a rule gets that verdict, and ``allow`` if none was; the threshold is 0
if the fold lacks a class; repeated rows get equal results; other columns,
whatever their names, never enter the plan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, settle

ORDER = 5
SMOOTHING = 2.0
#: Probability of a character before anything is counted.
BASE = 1 / 256
FOLD = 5
BINS = 4000
SPAN = 5.0
HOT = 4096
ALLOW, BLOCK_VERDICT = "allow", "block"
#: The rules of the query (fixed by its contract): rule and verdict.
RULES = (("org/", ALLOW), ("example.org/es/", BLOCK_VERDICT), ("example.org/en/1", BLOCK_VERDICT), ("com/fr/", ALLOW), ("com/de/", BLOCK_VERDICT))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x01", "\n"
#: Counts of a gram: accepted and rejected, outside and inside the calibration fold.
COUNTS = ("a0", "r0", "a1", "r1")


def host_and_path(url: Column) -> tuple[Column, Column]:
    mark = F.locate("://", url)
    after = F.when(mark > 0, url.substr(mark + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def normal(url: Column) -> Column:
    """What is modelled: the URL after its scheme, in lower case, digits as one sign."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://(?=.)", "")
    return F.translate(F.lower(rest), "123456789", "000000000")


def windows(text: Column) -> Column:
    """Each character with the ``ORDER`` signs before it; start signs precede the text, an end sign follows."""
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def grams(window: Column) -> Column:
    """Of a window: (kind, gram) of every order, the gram with its character (c) and its context alone (x)."""
    out = []
    for k in range(ORDER + 1):
        out.append(F.struct(F.lit(f"c{k}").alias("kind"), F.substring(window, ORDER + 1 - k, k + 1).alias("gram")))
        out.append(F.struct(F.lit(f"x{k}").alias("kind"), F.substring(window, ORDER + 1 - k, k).alias("gram")))
    return F.array(*out)


def gather(judged: DataFrame) -> DataFrame:
    """(url text, accepted 0/1, fold 0/1) -> (kind, gram, ``COUNTS``) over all rows."""
    hit = lambda a, f: F.count_if((F.col("accepted") == a) & (F.col("fold") == f))
    seen = judged.select("accepted", "fold", F.explode(windows(F.col("text"))).alias("w"))
    seen = settle(seen.groupBy("w").agg(hit(1, 0).alias("a0"), hit(0, 0).alias("r0"), hit(1, 1).alias("a1"), hit(0, 1).alias("r1")))
    every = seen.select(F.explode(grams(F.col("w"))).alias("g"), *COUNTS).groupBy("g.kind", "g.gram")
    return every.agg(*(F.sum(c).alias(c) for c in COUNTS))


def log_chance(cell, context) -> Column:
    """Log probability of a window's character, by functions from an order to its two counts."""
    p = F.lit(BASE)
    for k in range(ORDER + 1):
        p = (cell(k) + SMOOTHING * p) / (context(k) + SMOOTHING)
    return F.ln(p)


def window_ratios(seen: DataFrame, counts: DataFrame) -> DataFrame:
    """(w, n) distinct windows -> with log-ratios ``s0`` (without the fold's counts) and ``s`` (with all)."""
    asked = seen.select("w", F.explode(grams(F.col("w"))).alias("g")).select("w", "g.kind", "g.gram")
    # The empty context is part of every window: grams of a large share of all are sent to every task instead.
    info = settle(counts.join(asked.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("_n")), ["kind", "gram"]))
    kinds = [f"{t}{k}" for k in range(ORDER + 1) for t in "cx"]
    found = join_hot(asked, info, ["kind", "gram"], "_n").groupBy("w").agg(*(F.sum(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}") for kind in kinds for c in COUNTS))
    n = lambda kind, *cs: sum((F.coalesce(F.col(f"{kind}_{c}"), F.lit(0)) for c in cs), F.lit(0))
    by = lambda *cs: log_chance(lambda k: n(f"c{k}", *cs), lambda k: n(f"x{k}", *cs))
    return seen.join(found, "w", "left").select("w", "n", (by("a0") - by("r0")).alias("s0"), (by("a0", "a1") - by("r0", "r1")).alias("s"))


def ratios(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(text) distinct -> (key, ratio0, ratio): means over all positions, without and with the fold's counts."""
    keyed = settle(texts.select(text_key(F.col("text")).alias("key"), "text"))  # beside the windows, the key would be computed for each
    at = keyed.select("key", F.explode(windows(F.col("text"))).alias("w"))
    seen = settle(at.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    valued = settle(window_ratios(seen, counts))
    total = valued.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(valued.where(F.col("n") * HOT >= total).drop("n"))  # HOT rows at most
    sums = [F.sum("s0").alias("s0"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("n")]
    here = at.join(hot, "w").groupBy("key").agg(*sums)
    rest = at.join(hot, "w", "left_anti").join(valued.where(F.col("n") * HOT < total).drop("n"), "w").groupBy("key").agg(*sums)
    whole = here.unionByName(rest).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("s0", "s", "n")))
    return whole.select("key", (F.col("s0") / F.col("n")).alias("ratio0"), (F.col("s") / F.col("n")).alias("ratio"))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def best_edge(hist: np.ndarray) -> float:
    """(2, BINS) counts of rejected and accepted by ratio -> the threshold amid equally good edges; 0 if a class is missing."""
    if hist.sum(1).min() == 0:
        return 0.0
    share = hist / hist.sum(1, keepdims=True)
    errors = np.concatenate([[0.0], np.cumsum(share[1])]) + 1 - np.concatenate([[0.0], np.cumsum(share[0])])  # allow from this edge on
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(best.mean()) * 2 * SPAN / BINS - SPAN


def judge(df: DataFrame, url: str = "url", rules=RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns, host, path, rule, ratio (null where a rule decides) and verdict of every row of ``df``."""
    host, path = host_and_path(F.col("_url"))
    rows = df.select(*(F.col(c).alias(f"_carry_{c}") for c in carry), F.col(url).cast("string").alias("_url"))
    rows = rows.withColumn("_host", host).withColumn("_path", path)
    rule, verdict = ruled(F.col("_host"), F.col("_path"), rules)
    fold = (F.crc32(F.coalesce("_url", F.lit("")).cast("binary")) % FOLD == 0).cast("int")
    rows = rows.withColumn("_rule", rule).withColumn("_ruled", verdict).withColumns({"text": normal(F.col("_url")), "fold": fold, "accepted": F.when(F.col("_ruled").isNotNull(), (F.col("_ruled") == ALLOW).cast("int"))})
    judged = rows.where("_rule is not null")
    classes = {r["accepted"] for r in judged.select("accepted").distinct().collect()}  # two at most
    out = [*(F.col(f"_carry_{c}").alias(c) for c in carry), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule")]
    if classes != {0, 1}:
        by_method = F.lit(BLOCK_VERDICT if classes == {0} else ALLOW)
        return rows.select(*out, F.when(F.col("_rule").isNull(), 0.0).alias("ratio"), F.coalesce("_ruled", by_method).alias("verdict"))
    counts = settle(gather(judged.select("text", "accepted", "fold")))
    found = settle(ratios(rows.where("_rule is null or fold = 1").select("text").distinct(), counts))
    bin_of = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("ratio0") + SPAN) * (BINS / (2 * SPAN))))).cast("int")
    held = judged.where("fold = 1").select(text_key(F.col("text")).alias("key"), "accepted").join(found, "key")
    hist = np.zeros((2, BINS))
    for accepted, b, n in held.groupBy("accepted", bin_of.alias("bin")).count().collect():  # two classes of BINS bins
        hist[accepted, b] = n
    by_method = F.when(F.col("ratio") >= best_edge(hist), ALLOW).otherwise(BLOCK_VERDICT)
    key = F.when(F.col("_rule").isNull(), text_key(F.col("text")))
    scored = rows.withColumn("key", key).join(found.select("key", "ratio"), "key", "left")
    return scored.select(*out, "ratio", F.coalesce("_ruled", by_method).alias("verdict"))


def judge_pages(pages: DataFrame) -> DataFrame:
    """The ``op2`` digest."""
    return judge(pages, carry=("page_id",)).select("page_id", "host", "path", "rule", "verdict", "ratio")
