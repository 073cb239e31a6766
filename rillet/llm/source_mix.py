"""Mixing sources to target weights by iterative proportional fitting.

Token counts are added up by cell (source, language and topic class).  Raking
scales the cells until their sums match the target share of every source,
language and topic; a document is then sampled with a probability in
proportion to its cell's weight over its cell's tokens.  Sources have no fixed
list: their targets are tempered shares of what the table holds.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.common import unique_name
from rillet.llm.common import text_of
from rillet.session import materialize

#: Class of all values that a target map does not name; a map may give it a share of its own.
REST = "(other)"


def _class(value: Column, target: Mapping[str, float]) -> Column:
    """The value if the target names it, else the rest class."""
    return F.when(value.cast("string").isin(*[k for k in target if k != REST]), value.cast("string")) \
        .otherwise(F.lit(REST)) if any(k != REST for k in target) else F.lit(REST)


def topic_of(text: str = "text") -> Column:
    """A coarse topic by form: ``table`` (a bar for every 20 characters or denser), ``shout`` (over half of the
    letters A-Z are capital, and some are there), else ``prose``."""
    t = text_of(text)
    bars = F.length(t) - F.length(F.translate(t, "|", ""))
    capital = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    small = F.length(F.regexp_replace(t, "[^a-z]+", ""))
    return F.when((bars > 0) & (20 * bars >= F.length(t)), "table").when(capital > small, "shout").otherwise("prose")


def n_tokens_of(text: str = "text") -> Column:
    """Tokens of a text for weighing: a quarter of its UTF-8 bytes, one at least for a text that is not empty."""
    size = F.octet_length(text_of(text))
    return F.ceil(size / 4).cast("bigint")


def rake(cells: np.ndarray, targets: list[tuple[np.ndarray, np.ndarray]], rounds: int) -> np.ndarray:
    """Weights of cells after ``rounds`` rounds; a target is (class of each cell, share of each class)."""
    w = cells.astype(float) / cells.sum()
    for _ in range(rounds):
        for member, share in targets:
            have = np.bincount(member, weights=w, minlength=share.size)
            w = w * np.where(have > 0, share / np.where(have > 0, have, 1), 0)[member]
    return w


def reachable(per_token: np.ndarray, tokens: np.ndarray, budget_share: float, least_share: float) -> float:
    """The budget under which no cell passes a probability of 1, so that all targets are met: ``budget_share`` of the
    tokens at most; and ``least_share`` at least, even if some cells then fall short."""
    return max(min(budget_share, 1 / (per_token.max() * tokens.sum())), least_share)


def inclusion(per_token: np.ndarray, tokens: np.ndarray, budget_share: float | None) -> np.ndarray:
    """Probabilities in proportion to ``per_token``: the largest 1, or expected tokens of ``budget_share`` of all,
    with the cells that would pass 1 held there."""
    if budget_share is None:
        return per_token / per_token.max()
    order = np.argsort(-per_token, kind="stable")
    r, t = per_token[order], tokens[order]
    full = np.cumsum(t) - t  # tokens of the cells held at 1, if the first ones are
    rest = np.cumsum((r * t)[::-1])[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = (budget_share * tokens.sum() - full) / rest
        fits = np.flatnonzero(scale * r <= 1)
    return np.minimum(1, scale[fits[0]] * per_token) if fits.size else np.ones_like(per_token)


def _shares(classes: list[str], target: Mapping[str, float], have: Mapping[str, float]) -> np.ndarray:
    """Target shares of the classes present, 1 in sum; the rest class without a share of its own keeps what the
    named ones leave, or its part of the corpus if they leave nothing."""
    out = {c: float(target[c]) for c in classes if c in target}
    if REST in classes and REST not in target:
        left = 1 - sum(float(v) for v in target.values())
        out[REST] = left if left > 1e-12 else have[REST]
    total = sum(out.values())
    return np.array([out[c] / total for c in classes])


def calibrated(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], columns: Mapping[str, Column],
               n_tokens: Column, rounds: int = 20, budget_share: float | None = None,
               least_share: float = 0.0) -> DataFrame:
    """``<marginal>_class …, probability`` of each cell of ``docs`` (see :func:`mix`): at most the product of (named
    values + 1) over the marginals, so it is small enough to broadcast."""
    names = list(targets)
    rows = docs.select(*[_class(columns[n], targets[n]).alias(f"{n}_class") for n in names],
                       F.coalesce(n_tokens, F.lit(0)).cast("bigint").alias("__tokens"))
    classes = [f"{n}_class" for n in names]
    cells = rows.groupBy(*classes).agg(F.sum("__tokens").alias("__tokens")).orderBy(*classes).collect()
    tokens = np.array([c["__tokens"] for c in cells], float)
    ratio = np.ones(len(cells))
    if tokens.sum() > 0:
        rake_to = []
        for n, k in zip(names, classes, strict=True):
            present = sorted({c[k] for c in cells if c["__tokens"] > 0})
            have = {p: sum(c["__tokens"] for c in cells if c[k] == p) / tokens.sum() for p in present}
            member = np.array([present.index(c[k]) if c[k] in present else 0 for c in cells])
            rake_to.append((member, _shares(present, targets[n], have)))
        weight = rake(tokens, rake_to, rounds)
        per_token = np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0)
        if budget_share is not None:
            budget_share = reachable(per_token, tokens, budget_share, least_share)
        ratio = inclusion(per_token, tokens, budget_share)
        ratio[tokens == 0] = 1
    return docs.sparkSession.createDataFrame(
        [(*[c[k] for k in classes], round(r, 9)) for c, r in zip(cells, ratio.tolist(), strict=True)],
        ", ".join(f"{k} string" for k in classes) + ", probability double")


def drawn(doc_id: Column, probability: Column, seed: str = "mix") -> Column:
    """Whether a document is drawn: 52 bits of the md5 of seed and id, as a share of one, under the probability."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52) < probability


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], columns: Mapping[str, Column],
        n_tokens: Column, doc_id: str = "doc_id", rounds: int = 20, budget_share: float | None = None,
        least_share: float = 0.0, seed: str = "mix") -> DataFrame:
    """One row per input row: ``doc_id``, a class column for each target, ``n_tokens, probability, kept``.

    ``targets`` maps each marginal to the shares of its named values; all others form the class ``(other)``, so
    the cells that are brought to the driver are at most the product of (names + 1) over the marginals,
    whatever the table holds.  Probabilities are in proportion to weight over tokens of the cell: scaled so
    that the largest is 1, or so that the expected tokens are ``budget_share`` of all, or as much as meets all targets
    without a probability over 1 (``least_share`` of all at least: then cells that would pass 1 are held there).
    The draw depends on the seed and the id alone, so a document is drawn alike anywhere.

    Null values of a marginal are in ``(other)``; documents without tokens have their cell's probability; a null
    doc_id draws as the empty id; repeated rows are drawn alike.  An empty table, or one without tokens, gives
    probability 1 to all rows.
    """
    classes = [f"{n}_class" for n in targets]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), *[_class(columns[n], targets[n]).alias(f"{n}_class") for n in targets],
        F.coalesce(n_tokens, F.lit(0)).cast("bigint").alias("n_tokens"))
    cells = calibrated(docs, targets, columns, n_tokens, rounds, budget_share, least_share)
    rows = rows.join(F.broadcast(cells), classes)
    return rows.select("doc_id", *classes, "n_tokens", "probability").withColumn(
        "kept", drawn(F.col("doc_id"), F.col("probability"), seed))


def tempered(docs: DataFrame, column: Column, n_tokens: Column, power: float) -> dict[str, float]:
    """Target shares of the values of a column: their tokens to a power under 1, which favours small ones.

    Values of less than ``NAMED_SHARE`` of the tokens (and nulls) are the class ``(other)``, whose share is the sum of
    theirs; so at most 1 / ``NAMED_SHARE`` values are named.
    """
    per = docs.select(column.cast("string").alias("value"), F.coalesce(n_tokens, F.lit(0)).alias("n")) \
        .groupBy("value").agg(F.sum("n").alias("n")).where("n > 0")
    per = materialize(per.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power))), "values")
    total, weight = per.agg(F.sum("n"), F.sum("weight")).first()
    if not total:
        return {REST: 1.0}
    named = per.where(F.col("value").isNotNull() & (F.col("value") != REST) & (F.col("n") >= NAMED_SHARE * total)).collect()
    out = {r["value"]: r["weight"] / weight for r in sorted(named, key=lambda r: r["value"])}
    left = 1 - sum(out.values())
    return {**out, REST: left} if left > 1e-9 else out


#: Targets of languages and topics in the registered query and the pipeline (of tokens); those of sources are their
#: tokens to the power ``SOURCE_POWER``.
TARGETS = {
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11},
    "topic": {"prose": 0.96, "table": 0.02, "shout": 0.02},
}
SOURCE_POWER = 0.9
#: Share of the tokens that a value needs to have a target of its own.
NAMED_SHARE = 1 / 1000
#: Share of the tokens that the query and the pipeline draw: as much as meets the targets, between these bounds.
BUDGET, LEAST = 0.9, 0.5


def document_targets(docs: DataFrame) -> dict[str, dict[str, float]]:
    return {"source": tempered(docs, F.col("source"), n_tokens_of("text"), SOURCE_POWER), **TARGETS}


def document_marginals() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of("text")}


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """:func:`mix` over ``source`` (tempered shares), ``lang`` and the topic by form (``TARGETS``)."""
    return mix(docs, document_targets(docs), document_marginals(), n_tokens_of("text"),
               **{"budget_share": BUDGET, "least_share": LEAST, **options})


def keep_drawn(docs: DataFrame, doc_id: str = "doc_id", seed: str = "mix", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`mix_documents` draws, all columns.

    Rows that share a doc_id are drawn alike within a cell; null sources and languages are in ``(other)``, a null
    doc_id draws as the empty id, documents without tokens have their cell's probability.  A table without tokens
    stays whole, an empty one empty.
    """
    targets, columns = document_targets(docs), document_marginals()
    names = {f"{n}_class": unique_name(docs, f"{n}_class") for n in targets}
    share = unique_name(docs, "probability")
    cells = calibrated(docs, targets, columns, n_tokens_of("text"),
                       **{"budget_share": BUDGET, "least_share": LEAST, **options})
    cells = cells.withColumnsRenamed({**names, "probability": share})
    rows = docs.withColumns({names[f"{n}_class"]: _class(columns[n], targets[n]) for n in targets})
    rows = rows.join(F.broadcast(cells), list(names.values())).where(drawn(F.col(doc_id), F.col(share), seed))
    return rows.select(*docs.columns)
