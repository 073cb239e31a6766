"""Approximate text join: the closest reference value for each source value.

Similarity of two texts is ``100 * (1 - d / max(len))`` with ``d`` the plain
Levenshtein distance.  A pair qualifies when the similarity reaches the
threshold ``t``, i.e. ``d <= k(m) = m - ceil(t * m / 100)`` with
``m = max(len)``.  For each distinct source value the best qualifying
reference is the one with the least ``(d, reference)``.

Threshold mode never forms all pairs.  Candidates come from an equi-join on
q-grams with two lossless filters:

* length: ``|ls - lr| <= k(m)``;
* count + prefix (Gravano et al., VLDB 2001; Chaudhuri et al., ICDE 2006):
  a qualifying pair shares at least ``tau(m) = m - q + 1 - q * k(m)``
  q-grams, so under one global order of grams (rarest first) each string
  only needs to index its first ``|G| - tau + 1`` grams, and hot grams
  are left out of the join keys.  A lower bound of ``tau`` that grows with
  ``m`` keeps this exact when the partner is longer.

Pairs whose bound is ``<= 0`` (very short strings) cannot be found through
shared q-grams; they go through the same join with ``q = 1`` (characters),
whose bound stays positive for any ``t > 0``.  Every candidate is verified
with ``levenshtein(s, r, k)``, which stops early beyond ``k``.

``on_miss="nearest"`` (or ``t <= 0``) takes rounds of growing distance
``k = 1, 2, 4, ...`` over the sources that have no reference within the last
one.  Of ``k + 1`` segments of a reference one is left whole by ``k`` edits, so
it stands in the source, shifted by no more than the edits around it (Li et
al., VLDB 2011): an equi-join on segments finds these pairs.  References too
short for segments, and all of them once ``k`` is large, are joined on bands.
The distance is a metric, so a pair within ``k`` differs by at most ``k`` in
its distances to any third text: to the empty one (the lengths) and to some
pivots; three of these are joined on in bands of width ``k + 1`` and the others
filter.  What is left is verified.  A source leaves with its best reference as
soon as it has one; the pairs formed depend on how far off the nearest
references are, not on the product of the two sides.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rillet.common import StepError, col, require_columns, unique_name
from rillet.session import checkpoint_root, materialize


def _k(m: Column, t: float) -> Column:
    """Largest allowed distance for max length ``m`` (exact decimal arithmetic)."""
    return m - F.ceil(m * F.lit(Decimal(str(t))) / F.lit(100)).cast("int")


def _tau_lower(length: Column, q: int, t: float) -> Column:
    """Increasing lower bound of the common-gram count for pairs with max length >= ``length``."""
    slope = Decimal(1) - Decimal(q) * (Decimal(1) - Decimal(str(t)) / Decimal(100))
    return F.ceil(length * F.lit(slope) - F.lit(q - 1)).cast("int")


def _gram_counts(strings: DataFrame, q: int) -> DataFrame:
    """``(id, n, g, c)``: each q-gram of each text (by id, length ``n``) with its multiplicity."""
    n = F.length("x") - q + 1
    pos = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    grams = strings.select("id", F.length("x").alias("n"),
                           F.explode(F.transform(pos, lambda j: F.substring(F.col("x"), j, q))).alias("g"))
    return grams.groupBy("id", "n", "g").agg(F.count(F.lit(1)).alias("c"))


def _prefix(grams: DataFrame, freq: DataFrame, q: int, t: float) -> DataFrame:
    """``(id, n, g)``: grams inside each text's prefix under the global (frequency, gram) order."""
    w = Window.partitionBy("id").orderBy("f", "g")
    ranked = (grams.join(freq, "g")
              .withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("size", F.sum("c").over(Window.partitionBy("id")))
              .withColumn("tau", F.greatest(_tau_lower(F.col("n"), q, t), F.lit(1))))
    keep = (F.col("upto") - F.col("c")) < (F.col("size") - F.col("tau") + 1)
    return ranked.where(keep).select("id", "n", "g")


def _candidates(src: DataFrame, ref: DataFrame, q: int, t: float) -> DataFrame:
    """Candidate id pairs ``(sid, rid)`` sharing a prefix q-gram and passing the length filter.

    Texts travel as long ids (fixed by the checkpoint of the distinct
    values), so the pair join and its de-duplication move 16-byte rows.  The
    gram tables are used twice (global frequencies, then prefixes), so they
    are materialised once.
    """
    sg = _gram_counts(src, q).checkpoint(eager=True)
    rg = _gram_counts(ref, q).checkpoint(eager=True)
    freq = sg.unionByName(rg).groupBy("g").agg(F.sum("c").alias("f"))
    sp = _prefix(sg, freq, q, t).toDF("sid", "sn", "g")
    rp = _prefix(rg, freq, q, t).toDF("rid", "rn", "g")
    m = F.greatest(F.col("sn"), F.col("rn"))
    return (sp.join(rp, "g").where(F.abs(F.col("sn") - F.col("rn")) <= _k(m, t))
            .select("sid", "rid").distinct())


def threshold_matches(src: DataFrame, ref: DataFrame, t: float, q: int = 2) -> DataFrame:
    """``(s, r, d)``: for every source value with a qualifying reference, the best one.

    ``src`` and ``ref`` are one-column frames of distinct non-null texts named
    ``x``.  Exact: equal to checking every pair.
    """
    if not 0 < t <= 100:
        raise StepError("fuzzy_match: threshold mode needs 0 < threshold <= 100")
    if q * (1 - t / 100) >= 1:
        q = 1
    checkpoint_root(src.sparkSession)
    src = src.withColumn("id", F.monotonically_increasing_id()).checkpoint(eager=True)
    ref = ref.withColumn("id", F.monotonically_increasing_id()).checkpoint(eager=True)
    cands = _candidates(src, ref, q, t)
    # pairs whose common-gram bound can be <= 0: both strings short; use characters
    if q > 1:
        slope = 1 - q * (1 - t / 100)
        short = int(math.floor((q - 1) / slope)) if slope > 0 else 0
        if short >= 1:
            s_short = src.where(F.length("x") <= short)
            r_short = ref.where(F.length("x") <= short)
            if not (s_short.isEmpty() or r_short.isEmpty()):  # a pair needs both sides short
                cands = cands.unionByName(_candidates(s_short, r_short, 1, t)).distinct()
    pairs = (cands.join(src.toDF("s", "sid"), "sid").join(ref.toDF("r", "rid"), "rid").select("s", "r"))
    m = F.greatest(F.length("s"), F.length("r"))
    k = _k(m, t)
    verified = (pairs.withColumn("d", F.call_function("levenshtein", F.col("s"), F.col("r"), k))
                .where(F.col("d") >= 0))
    # best per source: least distance, then least text; the window keeps one
    # row per source before the shuffle (partial WindowGroupLimit)
    w = Window.partitionBy("s").orderBy("d", "r")
    return verified.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").select("s", "r", "d")


#: Reference texts looked at for pivots, and pivots chosen (the first two are joined on, the others filter).
PIVOT_SAMPLE, PIVOTS = 200, 6
#: Rounds up to this distance join on segments.
SEGMENT_DISTANCE = 8


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def choose_pivots(ref: DataFrame) -> list[str]:
    """Texts far from each other: each the farthest from those before it, among a bounded sample cut to 64 characters
    (any texts are right as pivots)."""
    rows = ref.select(F.substring("x", 1, 64).alias("x")).orderBy(F.xxhash64("x"), "x").limit(PIVOT_SAMPLE).collect()
    texts = sorted({r["x"] for r in rows if r["x"]})
    out: list[str] = []
    least = {t: len(t) for t in texts}  # distance to the empty text, the first coordinate
    while len(out) < PIVOTS and least and max(least.values()) > 0:
        far = max(sorted(least), key=least.get)
        out.append(far)
        least = {t: min(d, _distance(t, far)) for t, d in least.items()}
    return out


def _segment_pairs(left: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """Pairs of sources (``s``, length ``s0``) and references (``r``, ``r0``: 2·(k + 1) or more) that share a segment:
    all pairs within ``k``, some of them repeatedly."""
    parts = k + 1
    size = F.expr(f"l div {parts} + CAST(i >= {parts} - l % {parts} AS int)")  # the last segments take the remainder
    begin = F.expr(f"i * (l div {parts}) + greatest(0, i - ({parts} - l % {parts}))")

    def cut(text: str, start: Column) -> Column:
        return F.substring(F.col(text), start + 1, F.col("size")).alias("part")

    right = refs.where(F.col("r0") >= 2 * parts).withColumn("l", F.col("r0").cast("int")) \
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k)))).withColumn("size", size)
    right = right.select(*refs.columns, "l", "i", cut("r", begin))
    near = left.withColumn("l", F.explode(F.sequence(F.greatest(F.lit(2 * parts), F.col("s0") - k),
                                                     F.greatest(F.lit(2 * parts), F.col("s0") + k)))) \
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k)))).withColumn("size", size)
    low = F.expr(f"greatest(-i, s0 - l - ({k} - i))")
    high = F.expr(f"least(i, s0 - l + ({k} - i))")
    near = near.where(low <= high).withColumn("shift", F.explode(F.sequence(low, high))) \
        .withColumn("at", F.col("shift") + begin).where("at >= 0 AND at + size <= s0")
    return near.select(*left.columns, "l", "i", cut("s", F.col("at"))).join(right, ["l", "i", "part"]) \
        .drop("l", "i", "part")


def _band_pairs(left: DataFrame, refs: DataFrame, k: int, joined_on: range) -> DataFrame:
    """Pairs whose coordinates of ``joined_on`` lie in neighbouring bands: all pairs within ``k``, each once."""
    width = k + 1
    for i in joined_on:
        band = F.floor(F.col(f"s{i}") / width)
        left = left.withColumn(f"b{i}", F.explode(F.array(band - 1, band, band + 1)))
    refs = refs.withColumns({f"b{i}": F.floor(F.col(f"r{i}") / width) for i in joined_on})
    names = [f"b{i}" for i in joined_on]
    return left.join(refs, names).drop(*names)


def nearest_matches(src: DataFrame, ref: DataFrame, report: list[dict] | None = None) -> DataFrame:
    """``(s, r, d)``: the nearest reference for every source value (no threshold), least ``(d, r)``; nulls without any.

    ``src`` and ``ref`` are one-column frames of distinct non-null texts named ``x``.  ``report`` is given a row for
    each round: ``distance, sources, pairs`` (pairs that the joins formed).
    """
    checkpoint_root(src.sparkSession)
    pivots = choose_pivots(ref)
    if not pivots and ref.where(F.length("x") > 0).isEmpty():  # no reference, or the empty text alone
        there = ref.agg(F.max("x").alias("r"))
        return src.join(F.broadcast(there), F.lit(True)).select(
            F.col("x").alias("s"), "r", F.when(F.col("r").isNotNull(), F.length("x")).alias("d"))

    def placed(texts: DataFrame, side: str) -> DataFrame:
        """``side`` text and its coordinates: length, and distances to the pivots."""
        return texts.select(F.col("x").alias(side), F.length("x").alias(f"{side}0"), *[
            F.levenshtein("x", F.lit(p)).alias(f"{side}{i + 1}") for i, p in enumerate(pivots)])

    coordinates, joined_on = range(len(pivots) + 1), range(min(3, len(pivots) + 1))
    refs, left = materialize(placed(ref, "r"), "references"), materialize(placed(src, "s"), "sources")
    longest = max(t.agg(F.max(c)).first()[0] or 0 for t, c in ((refs, "r0"), (left, "s0")))
    best, k = [], 1
    while not left.isEmpty():
        if k <= SEGMENT_DISTANCE:
            pairs = _segment_pairs(left, refs, k).unionByName(
                _band_pairs(left, refs.where(F.col("r0") < 2 * (k + 1)), k, joined_on))
        else:
            pairs = _band_pairs(left, refs, k, joined_on)
        seen = Observation()
        pairs = pairs.observe(seen, F.count(F.lit(1)).alias("pairs"))
        for i in coordinates:
            pairs = pairs.where(F.abs(F.col(f"s{i}") - F.col(f"r{i}")) <= k)
        pairs = pairs.withColumn("d", F.call_function("levenshtein", F.col("s"), F.col("r"), F.lit(k))).where("d >= 0")
        found = materialize(pairs.groupBy("s").agg(F.min(F.struct("d", "r")).alias("best")), "nearest")
        if report is not None:
            report.append({"distance": k, "sources": left.count(), "pairs": seen.get["pairs"]})
        best.append(found.select("s", F.col("best.r").alias("r"), F.col("best.d").alias("d")))
        if k >= longest:
            break
        left = materialize(left.join(found.select("s"), "s", "left_anti"), "sources")
        k *= 2
    out = best[0] if best else src.select(F.col("x").alias("s"), F.col("x").alias("r"), F.lit(0).alias("d")).limit(0)
    for more in best[1:]:
        out = out.unionByName(more)
    return out


def fuzzy_match(df: DataFrame, column: str, reference: DataFrame, reference_column: str,
                output_column: str, threshold: float = 80.0, on_miss: str = "null",
                similarity_column: str | None = None) -> DataFrame:
    """Add ``output_column``: the best reference value for each row's ``column``.

    Below the threshold the output is null (``on_miss="null"``) or the
    nearest value regardless (``on_miss="nearest"``).  An empty source text
    gives ``''``; a null source gives null.  Matching runs on distinct
    values; the answers are joined back on the source text.
    """
    require_columns(df, [column], "fuzzy_match")
    require_columns(reference, [reference_column], "fuzzy_match (reference)")
    if on_miss not in ("null", "nearest"):
        raise StepError(f"fuzzy_match: unknown on_miss {on_miss!r}")
    text = col(column).cast("string")
    src = df.select(text.alias("x")).where(F.col("x").isNotNull() & (F.length("x") > 0)).distinct()
    ref = reference.select(col(reference_column).cast("string").alias("x")).where(
        F.col("x").isNotNull()).distinct()
    t = float(threshold)
    if on_miss == "nearest" or t <= 0:
        best = nearest_matches(src, ref)
    else:
        best = threshold_matches(src, ref, t)
    key, r, d = (unique_name(df, x) for x in ("__fz_src", "__fz_ref", "__fz_dist"))
    best = best.select(F.col("s").alias(key), F.col("r").alias(r), F.col("d").alias(d))
    joined = df.join(best, text == F.col(key), "left")
    out = F.when(text == "", F.lit("")).otherwise(F.col(r))
    cols = {output_column: out}
    if similarity_column:
        m = F.greatest(F.length(text), F.length(r))
        cols[similarity_column] = F.when(F.col(r).isNotNull(),
                                         F.when(m == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.col(d) / m)))
    keep = [c for c in df.columns if c not in cols]
    return joined.withColumns(cols).select(*[col(c) for c in [*keep, *cols]])
