"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets its word statistics and rule failures.  Failures are
added up by host, each host's failure rate is shrunk towards the corpus by a
beta prior fitted to the hosts (method of moments), and the host's verdict is
joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.common import unique_name
from rillet.llm.common import NOT_SPACE, SPACE, join_groups, text_of
from rillet.session import materialize

#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"

FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _next(array: Column, step: int = 1) -> Column:
    """``array`` moved ``step`` to the left (shorter by ``step``)."""
    return F.slice(array, F.lit(1 + step), F.greatest(F.size(array) - step, F.lit(0)))


def _features(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``FEATURES``; every array is a column of its own, so that none is worked out twice."""
    t = text_of(text)
    d = docs.withColumn("__words", F.filter(F.split(t, SPACE), lambda x: x != ""))
    d = d.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE)))
    d = d.withColumn("__hash", F.transform("__words", lambda x: F.xxhash64(x)))
    h = F.col("__hash")
    pairs = F.zip_with(h, _next(h), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    triples = F.zip_with(pairs, _next(h, 2), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    d = d.withColumn("__windows", F.slice(triples, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))))
    # Windows in order of (hash, place): equal ones are neighbours.
    placed = F.transform("__windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    d = d.withColumn("__sorted", F.sort_array(placed))
    s = F.col("__sorted")
    d = d.withColumn("__same", F.zip_with(s, _next(s), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))))
    same = F.col("__same")
    before = F.concat(F.array(F.lit(False)), same)  # one longer; the surplus last entry is null-paired
    flagged = F.zip_with(F.zip_with(same, before, lambda a, b: F.coalesce(a, F.lit(False)) | b), s,
                         lambda f, x: F.when(f, x["i"]))
    d = d.withColumn("__starts", F.sort_array(F.filter(flagged, lambda x: x.isNotNull())))
    st = F.col("__starts")
    covered = F.aggregate(
        F.zip_with(st, _next(st), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return d.select(
        *[c for c in docs.columns if c != text],
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def host_rates(rated: DataFrame) -> DataFrame:
    """``host, n_docs, n_failed, host_rate`` from rows of ``host, failed``.

    The prior is beta(m·k, (1 − m)·k) with m the mean of the hosts' rates and
    k = m(1 − m)/v − 1 from their variance v, held to 1 ≤ k ≤ 1000 (1000 when
    the hosts do not differ).  ``host_rate`` is the posterior mean.
    """
    hosts = rated.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"),
                                      F.sum(F.col("failed").cast("bigint")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    k = F.when(F.col("v") > 1e-12, F.least(F.lit(1000.0), F.greatest(
        F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(1000.0))
    prior = prior.select("m", k.alias("k"))  # one row
    return hosts.join(F.broadcast(prior), F.lit(True)).select(
        "host", "n_docs", "n_failed",
        F.round((F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k")), 6).alias("host_rate"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                  min_words: int = 50, max_repeat_pct: int = 50, max_symbols_pct: int = 10,
                  max_dup_lines_pct: int = 30, word_length: tuple[int, int] = (2, 20),
                  strict_rate: float = 0.05, reject_rate: float = 0.5) -> DataFrame:
    """One row per input row: statistics, rule failures, the host's rate and the verdict.

    * ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_pct`` % of the words in
      3-word windows that occur twice or more.  Such documents are not kept.
    * ``n_rules_failed``: the further rules broken (symbols per 100 words, share of repeated lines, mean
      word length).
    * A document with a broken rule is kept on a host whose shrunk failure rate is under ``strict_rate`` and
      dropped elsewhere; a host at ``reject_rate`` or more loses all its documents.

    Null text counts as empty (no words, so it fails); a null host is the host ``""``; repeated rows
    each get a row and count each; an empty table gives an empty result.  Other columns are not used.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                       F.col(text).alias("__text"))
    d = _features(rows, "__text")
    low, high = word_length
    broken = (
        (100 * F.col("n_symbols") > max_symbols_pct * F.col("n_words")).cast("int")
        + (100 * F.col("n_dup_lines") > max_dup_lines_pct * F.col("n_lines")).cast("int")
        + ((F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words"))).cast("int"))
    d = d.withColumn("base_failed", (F.col("n_words") < min_words)
                     | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    d = d.withColumn("n_rules_failed", broken)
    # The statistics (a few numbers a document) are read twice: for the hosts and for the verdicts.
    d = materialize(d, "quality-features")
    hosts = host_rates(d.select("host", (F.col("base_failed") | (F.col("n_rules_failed") > 0)).alias("failed")))
    verdict = join_groups(d, hosts, "host", "n_docs")
    bad = F.col("base_failed") | (F.col("host_rate") >= reject_rate) | (
        (F.col("n_rules_failed") > 0) & (F.col("host_rate") >= strict_rate))
    return verdict.select("doc_id", *FEATURES, "base_failed", "n_rules_failed", "host", "host_rate",
                          (~bad).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, all columns.

    A doc_id on several rows goes if any of its rows is rejected; rows with a null doc_id have no verdict to join
    and stay.
    """
    key = options.get("doc_id", "doc_id")
    id_ = unique_name(docs, "__id")
    rejected = quality_rules(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias(id_)).distinct()
    return docs.join(rejected, docs[key] == F.col(id_), "left_anti")
