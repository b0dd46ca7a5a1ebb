"""URL verdicts: host rules, and gradient-boosted trees on lexical features for other URLs.

URLs that a rule decides are the labelled ones; the trees learn from them what blocked URLs look
like and judge the rest. Features: lengths, path depth, digit ratio, character entropy, number of
parameters, and how often other labelled URLs of the host's suffix are blocked (over all rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import spread_join, written

#: Fixed rules: host and path, then the verdict.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)


#: Weight of the share of all labelled URLs in a suffix's share.
PRIOR = 10
#: URLs whose bytes are counted at once.
COUNTED = 2048


@dataclass(frozen=True)
class Boosting:
    """rows: labelled URLs that the trees are fitted on, at most."""

    rows: int = 20_000
    trees: int = 30
    depth: int = 3
    rate: float = 0.3
    bins: int = 32


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (nulls if none does)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, then in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(then)).otherwise(verdict)
    return rule, verdict


def entropy(urls: pd.Series) -> np.ndarray:
    """Shannon entropy of each URL's bytes (null or empty: 0)."""
    out = []
    raw = [u.encode("utf-8", "replace") if u else b"" for u in urls]
    for at in range(0, len(raw), COUNTED):
        part = raw[at : at + COUNTED]
        size = np.array([len(r) for r in part])
        count = np.bincount(np.repeat(np.arange(len(part)) * 256, size) + np.frombuffer(b"".join(part), np.uint8), minlength=256 * len(part)).reshape(-1, 256)
        share = count / np.maximum(size, 1)[:, None]
        out.append(-(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1))
    return np.concatenate(out) if out else np.zeros(0)


def _times(text: Column, char: str) -> Column:
    """How often a character of one byte occurs."""
    return F.octet_length(text) - F.octet_length(F.translate(text, char, ""))


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """Lexical features but for the entropy: lengths in bytes, labels of the host, depth, digit ratio, parameters."""
    u = F.coalesce(url, F.lit(""))
    n = F.octet_length(u)
    query = F.regexp_extract(u, r"(?s)^[^?]*\?([^#]*)", 1)
    digits = n - F.octet_length(F.translate(u, "0123456789", ""))
    columns = {
        "f_bytes": n,
        "f_host": F.octet_length(host),
        "f_labels": _times(host, ".") + 1,
        "f_depth": _times(path, "/"),
        "f_digits": digits / F.greatest(n, F.lit(1)),
        "f_parameters": F.when(query == "", 0).otherwise(_times(query, "&") + 1),
        "f_path": F.octet_length(path),
    }
    return [c.cast("double").alias(name) for name, c in columns.items()]


LEXICAL = ["f_bytes", "f_host", "f_labels", "f_depth", "f_digits", "f_parameters", "f_path"]


class Trees:
    """Boosted regression trees of fixed depth on quantile bins, for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, how: Boosting):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, how.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.how, self.trees = how, []
        score = np.full(len(y), self.base)
        for _ in range(how.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p), how)
            self.trees.append(tree)
            score += self._leaf(binned, tree)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, how: Boosting) -> tuple:
        node = np.zeros(len(binned), dtype=np.int64)
        splits: list[list[tuple[int, int]]] = []
        for level in range(how.depth):
            n = 1 << level
            best = [(-1.0, 0, how.bins)] * n
            for f in range(binned.shape[1]):
                key = node * how.bins + binned[:, f]
                g = np.bincount(key, weights=gradient, minlength=n * how.bins).reshape(n, -1).cumsum(1)
                h = np.bincount(key, weights=weight, minlength=n * how.bins).reshape(n, -1).cumsum(1)
                gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1)
                cut = gain.argmax(1)
                best = [(gain[i, cut[i]], f, int(cut[i])) if gain[i, cut[i]] > best[i][0] + 1e-12 else best[i] for i in range(n)]
            splits.append([(f, c) for _, f, c in best])
            which = np.array([f for _, f, _ in best])[node]
            at = np.array([c for _, _, c in best])[node]
            node = 2 * node + (binned[np.arange(len(binned)), which] > at)
        g, h = (np.bincount(node, weights=w, minlength=1 << how.depth) for w in (gradient, weight))
        return splits, how.rate * g / (h + 1)

    def _leaf(self, binned: np.ndarray, tree: tuple) -> np.ndarray:
        splits, values = tree
        node = np.zeros(len(binned), dtype=np.int64)
        for level in splits:
            f, c = np.array(level).T
            node = 2 * node + (binned[np.arange(len(binned)), f[node]] > c[node])
        return values[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return 1 / (1 + np.exp(-(self.base + sum(self._leaf(binned, t) for t in self.trees))))


def judged(df: DataFrame, how: Boosting = Boosting(), row_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: row_id, host, path, rule, score, verdict.

    A null url or one without :// has an empty host and path, no rule, and is judged by the trees
    like others. Repeated rows each give a row, null ids stay, an empty table gives none; extra
    columns are left out. Where no URL, or only URLs of one verdict, are labelled, the rest is
    allowed, or gets that verdict. The share of a suffix leaves the URL itself out; hosts without a
    labelled other URL get the share of all. URLs of any length are read whole.
    """
    spark = df.sparkSession
    u = F.col("_url")
    base = df.select(F.col(f"`{row_id}`").alias("_id"), F.col(f"`{url}`").alias("_url"))
    base = base.select("*", host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    base = base.select("*", rule.alias("rule"), verdict.alias("_rule_verdict"), F.substring_index("host", ".", -2).alias("_suffix"))
    blocked = F.col("_rule_verdict") == "block"
    stats = written(base.groupBy(F.col("_suffix").alias("_of")).agg(F.count_if(blocked).alias("_b"), F.count("rule").alias("_n"), F.count("*").alias("_all")), "url-suffixes")
    b, n, rows = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("_b", "_n", "_all")]).first()
    total = (b + 1) / (n + 2)
    # rows of a suffix that very many share are dealt out
    hot = [r[0] for r in stats.filter(F.col("_all") * 1000 > rows).select("_of").collect()]  # fewer than 1000
    known = spread_join(base, stats.filter("_n > 0").drop("_all"), "_suffix", "_of", hot, "_url", "left")
    own = F.when(F.col("rule").isNull(), 0).otherwise(1)
    share = (F.coalesce(F.col("_b"), F.lit(0)) - F.coalesce(blocked, F.lit(False)).cast("int") + PRIOR * total) / (F.coalesce(F.col("_n"), F.lit(0)) - own + PRIOR)
    known = known.select("_id", "_url", "host", "path", "rule", "_rule_verdict", *lexical(u, F.col("host"), F.col("path")), share.alias("f_share"))
    # about as many rows as are wanted, by a hash of the URL, so that no task sends more than its part
    place = F.pmod(F.xxhash64("_url"), F.lit(1 << 30))
    some = known.filter("rule is not null").filter(place < int((1 << 30) * min(1.0, 1.2 * how.rows / max(n, 1)))).orderBy(place, "_url").limit(how.rows)
    sample = some.select("_url", *LEXICAL, "f_share", "_rule_verdict").toPandas()
    y = (sample["_rule_verdict"] == "block").to_numpy(dtype=np.float64)
    trees = None
    if 0 < y.sum() < len(y):
        trees = Trees(np.column_stack([sample[c] for c in [*LEXICAL, "f_share"]] + [entropy(sample["_url"])]), y, how)
    shared = spark.sparkContext.broadcast((trees, float(y.mean()) if len(y) else 0.0))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model, otherwise = shared.value
        for text, *columns in batches:
            yield pd.Series(model.predict(np.column_stack([*columns, entropy(text)])) if model else np.full(len(text), otherwise))

    out = known.withColumn("score", score("_url", *LEXICAL, "f_share"))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return out.select(F.col("_id").alias(row_id), "host", "path", "rule", "score", F.coalesce("_rule_verdict", method).alias("verdict"))
