"""Quality rules with risk-controlled thresholds (DataFrame and SQL functions only).

Each rule is a score of the text; a text is rejected when a score reaches the cutoff of its
stratum. Cutoffs come from labelled rows: a stratum's cutoffs are allowed only if an exact
(Clopper-Pearson) binomial bound shows that all of them together reject at most a given share of
its good rows, at a confidence that is divided among the strata (Bonferroni); within a stratum
they are tried in a fixed sequence, which needs no division. A stratum with too few labels to
prove that has no cutoff, and nothing of it is rejected by the method.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, written

SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Risk:
    """alpha: share of a stratum's good rows that all rules together may reject; delta: chance
    that any of these limits is broken; cost: junk rejections that one good rejection must bring;
    cutoffs: tried for each rule, fixed before any label is seen."""

    alpha: float = 0.02
    delta: float = 0.05
    cost: float = 5.0
    cutoffs: tuple[float, ...] = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


#: Scores from 0 to 1 by name; each is a ratio of metrics() columns.
RULES = ("symbol_share", "upper_share", "dup_line_share", "repeat_share", "mark_share")


def _count(text: Column, characters: str) -> Column:
    """Matches of a character class, as the pieces between them; much cheaper than translate()."""
    return (F.size(F.split(text, characters)) - 1).cast("long")


#: Low bits of a sort key hold a window's place, so at most that many windows take the fast way.
PLACE_BITS = 24


def _window(words: str, at: Column) -> list[Column]:
    return [F.get(F.col(words), at + j) for j in range(3)]


def _same_window(words: str, p: Column, q: Column) -> Column:
    x, y = _window(words, p), _window(words, q)
    return (x[0] == y[0]) & (x[1] == y[1]) & (x[2] == y[2])


def _sorted_words(words: str) -> Column:
    """Exact but slow: windows sorted by their words, then by place."""
    w, n = F.col(words), F.size(words) - 2
    zipped = F.arrays_zip(F.slice(w, F.lit(1), n).alias("a"), F.slice(w, F.lit(2), n).alias("b"), F.slice(w, F.lit(3), n).alias("c"), F.sequence(F.lit(0), n - 1).alias("p"))
    return F.transform(F.sort_array(zipped), lambda x: x["p"])


def metrics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and, per row, the base metrics and each rule's score.

    A null text counts as empty: every metric 0. Nothing is shuffled. Words in repeated 3-word
    windows: places are sorted by a hash of their window, neighbours of equal hash are compared
    word by word, and if any of these differ (two windows of one hash) the places are sorted by
    the words themselves instead, so the count is exact. Each select holds what later ones use
    more than once, so that nothing is computed twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(f"`{c}`") for c in keep]
    low = (1 << PLACE_BITS) - 1
    w = df.select(*kept, t.alias("_t"), F.array_remove(F.split(t, SPLIT), "").alias("_w"))
    few = F.array().cast("array<bigint>")
    keys = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.xxhash64(*_window("_w", i)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
    )
    w = w.select("*", F.when(F.size("_w") < 4, few).when(F.size("_w") > low, few).otherwise(F.sort_array(keys)).alias("_k"))
    near = F.transform(
        F.filter(F.arrays_zip(F.col("_k").alias("x"), F.slice("_k", F.lit(2), F.greatest(F.size("_k") - 1, F.lit(0))).alias("y")), lambda z: F.shiftright(z["x"], PLACE_BITS) == F.shiftright(z["y"], PLACE_BITS)),
        lambda z: F.struct(z["x"].bitwiseAND(F.lit(low)).cast("int").alias("p"), z["y"].bitwiseAND(F.lit(low)).cast("int").alias("q")),
    )
    w = w.select(*kept, "_t", "_w", near.alias("_n"))
    w = w.select("*", ((F.size("_w") > low) | F.exists("_n", lambda z: ~_same_window("_w", z["p"], z["q"]))).alias("_odd"))
    w = w.select("*", F.when(F.col("_odd"), _sorted_words("_w")).alias("_s"))
    slow = F.filter(F.transform(F.arrays_zip(F.col("_s").alias("p"), F.slice("_s", F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))).alias("q")), lambda z: F.struct(z["p"].alias("p"), z["q"].alias("q"))), lambda z: _same_window("_w", z["p"], z["q"]))
    w = w.select(*kept, "_t", "_w", F.when(F.col("_odd"), slow).otherwise(F.col("_n")).alias("_n"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    covered = F.flatten(F.transform("_n", lambda z: F.array(*[z[c] + j for c in "pq" for j in range(3)])))
    c = w.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
        _count(F.col("_t"), "[A-Z]").alias("n_upper"),
        _count(F.col("_t"), r"[!?|=_~^]").alias("n_marks"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a) / F.col(b))).otherwise(F.lit(0.0))

    return c.select(
        "*",
        ratio("n_symbols", "n_words").alias("symbol_share"),
        ratio("n_upper", "word_chars").alias("upper_share"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_share"),
        ratio("n_repeat_words", "n_words").alias("repeat_share"),
        ratio("n_marks", "n_words").alias("mark_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma1(x: Column) -> Column:
    """ln(x!) by Stirling's series at x + 8, exact to about 1e-12."""
    z = x + 9.0
    stirling = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    shift = F.lit(0.0)
    for j in range(1, 9):
        shift = shift + F.log(x + float(j))
    return stirling - shift


def binomial_tail(k: Column, n: Column, p: float, terms: int = 4096) -> Column:
    """P[Bin(n, p) <= k] for k < n p, summed downwards from k.

    Terms fall at least geometrically there; what lies beyond `terms` of them is replaced by its
    geometric bound, so the value is never too small and a guarantee drawn from it holds.
    """
    k, n = k.cast("double"), n.cast("double")
    log_first = _log_gamma1(n) - _log_gamma1(k) - _log_gamma1(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.least(k, F.lit(float(terms))).cast("int") + 1),
        start,
        lambda s, j: F.struct(
            (s["term"] * F.greatest(k - j + 1, F.lit(0.0)) / (n - k + j) * odds).alias("term"),
            (s["total"] + s["term"] * F.greatest(k - j + 1, F.lit(0.0)) / (n - k + j) * odds).alias("total"),
        ),
        lambda s: F.struct(s["term"].alias("term"), s["total"].alias("total")),
    )
    ratio = F.greatest(k - terms, F.lit(0.0)) / (n - k + 1) * odds
    rest = F.when(k > terms, series["term"] * ratio / F.greatest(1 - ratio, F.lit(1e-9))).otherwise(F.lit(0.0))
    return F.exp(log_first) * (series["total"] + rest)


def thresholds(scored: DataFrame, stratum: str, good: str, risk: Risk) -> DataFrame:
    """For each stratum the cutoffs that pay most among those proved safe together.

    Steps lower one rule to one cutoff, from the strictest cutoff down and in the order of RULES; a
    step that is no junk row's first is skipped. Which are left depends on junk rows only, so the
    tests on good rows have an order fixed beforehand: each tests all steps so far together, at the
    full alpha and the stratum's share of delta, and the first that fails ends them.

    `scored` holds labelled rows with RULES columns and `good` (true: a good row). All rows are
    counted. Rows: stratum, rule, cutoff, and for all rules of the stratum together n_good,
    n_good_rejected, n_junk_rejected.
    """
    cutoffs = sorted(risk.cutoffs, reverse=True)

    def missed(rule: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: F.col(rule) < c))

    # for each rule the first of the cutoffs that the score reaches; their number if it reaches none
    first = F.array(*map(missed, RULES))
    # one row for each stratum and combination of cutoffs reached; pre-aggregated before the shuffle
    counts = scored.select(F.col(stratum).alias("stratum"), F.col(good).alias("good"), first.alias("first")).groupBy("stratum", "first").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("j"))
    every = F.array(*[F.struct(F.lit(i * len(RULES) + r).alias("step"), F.lit(i).alias("at"), F.lit(r).alias("rule")) for i in range(len(cutoffs)) for r in range(len(RULES))])

    def taken(steps: Column) -> Column:
        return F.array_min(F.transform(F.filter(steps, lambda s: F.get(F.col("first"), s["rule"]) <= s["at"]), lambda s: s["step"]))

    junk = counts.filter("j > 0").withColumn("step", taken(every)).filter("step is not null")
    plan = junk.groupBy("stratum").agg(F.collect_set("step").alias("_some")).select("stratum", F.filter(every, lambda s: F.array_contains("_some", s["step"])).alias("steps"))
    # strata without steps test nothing and take no share of delta
    plan = plan.crossJoin(F.broadcast(plan.agg(F.count("*").alias("strata")))).withColumnRenamed("stratum", "_of")
    taking = counts.join(plan, F.col("stratum").eqNullSafe(F.col("_of"))).withColumn("taken", taken(F.col("steps")))
    tried = (
        taking.withColumn("s", F.explode("steps"))
        .groupBy("stratum", "strata", F.col("s.step").alias("step"))
        .agg(
            F.sum("g").alias("n_good"),
            F.sum(F.when(F.col("taken") <= F.col("s.step"), F.col("g")).otherwise(0)).alias("n_good_rejected"),
            F.sum(F.when(F.col("taken") <= F.col("s.step"), F.col("j")).otherwise(0)).alias("n_junk_rejected"),
        )
    )
    n, k = F.col("n_good"), F.col("n_good_rejected")
    safe = F.when(k < risk.alpha * n, binomial_tail(k, n, risk.alpha) <= F.lit(risk.delta) / F.col("strata")).otherwise(False)
    gain = F.col("n_junk_rejected") - risk.cost * k
    tested = tried.select("*", safe.alias("safe"), gain.alias("gain")).groupBy("stratum").agg(
        F.min(F.when(~F.col("safe"), F.col("step"))).alias("failed"),
        F.array_sort(F.collect_list(F.struct("step", "gain", "n_good", "n_good_rejected", "n_junk_rejected"))).alias("t"),
    )
    proved = F.filter("t", lambda x: (x["gain"] > 0) & F.coalesce(x["step"] < F.col("failed"), F.lit(True)))
    best = tested.withColumn("p", proved).filter("size(p) > 0").select("stratum", F.filter("p", lambda x: x["gain"] == F.array_max(F.col("p.gain")))[0].alias("b"), "t")
    names, values = F.array(*map(F.lit, RULES)), F.array(*map(F.lit, cutoffs))
    each = best.select("stratum", "b", F.explode(F.filter("t", lambda x: x["step"] <= F.col("b.step"))["step"]).alias("step"))
    return each.groupBy("stratum", F.get(names, F.col("step") % len(RULES)).alias("rule")).agg(
        F.min(F.get(values, F.floor(F.col("step") / len(RULES)).cast("int"))).alias("cutoff"),
        *[F.first(F.col("b")[c]).alias(c) for c in ("n_good", "n_good_rejected", "n_junk_rejected")],
    )


def judge(df: DataFrame, labels: DataFrame, risk: Risk = Risk(), text: str = "text", stratum: str = "lang", row_id: str = "doc_id") -> DataFrame:
    """Metrics, base rule and verdict of every row: row_id, the metrics, base_failed, kept.

    Metrics are computed once and written to the shared folder. Nulls: an empty text fails the
    base rule; a null stratum is a stratum of its own; rows with a null id have no label; null
    labels are no labels. Repeated ids each get a row; an id labelled more than once counts once,
    as good if any of its labels is. An empty label table leaves only the base rule.
    """
    m = written(metrics(df, [row_id, stratum], text), "quality-metrics")
    marked = labels.filter(F.col("quality").isNotNull() & F.col(row_id).isNotNull()).groupBy(row_id).agg((F.max("quality") > 0).alias("good"))
    scored = m.filter(~base_failed()).join(marked, row_id)
    chosen = thresholds(scored, stratum, "good", risk)
    # a few rows per stratum, so the join on the stratum is against one row of each
    per = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(F.col(r) >= F.col("cut")[r], F.lit(False))
    judged = m.join(per, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    return judged.select(
        F.col(row_id), F.col(stratum), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES,
        base_failed().alias("base_failed"), (~base_failed() & ~hit).alias("kept"),
    )


def keep_good(df: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of df that the rules keep, with all its columns; rows that share an id are judged each.

    A verdict follows from the text and the stratum, so it is joined by the id and a hash of both.
    Null and empty texts fail the base rule; long texts are judged whole; an empty table stays
    empty; extra columns, whatever their names, stay as they are.
    """
    tag, judged_id, judged_tag = free_name(df, "tag"), free_name(df, "id"), free_name(df, "good")
    hashed = F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")))
    m = written(metrics(df.select("doc_id", "lang", "text", hashed.alias("_tag")), ["doc_id", "lang", "_tag"]), "quality-metrics")
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    chosen = thresholds(m.filter(~base_failed()).join(marked, "doc_id"), "lang", "good", risk)
    per = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(F.col(r) >= F.col("cut")[r], F.lit(False))
    good = m.join(per, F.col("lang").eqNullSafe(F.col("stratum")), "left").filter(~base_failed() & ~hit)
    good = good.select(F.col("doc_id").alias(judged_id), F.col("_tag").alias(judged_tag)).distinct()
    return df.withColumn(tag, hashed).join(good, F.col("doc_id").eqNullSafe(F.col(judged_id)) & (F.col(tag) == F.col(judged_tag)), "left_semi").drop(tag)
