"""URL filters: host and path rules first, then boosted trees on lexical features.

The rules are DataFrame expressions. The trees are fitted to the URLs that a rule labels,
on a bounded sample of them, and judge the URLs that no rule fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import hash_sample

#: Upper and lower case of A to Z.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A to Z lower-cased) and path (up to ``?`` or ``#``); both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(u, F.lit("://")), F.substr(u, F.position(F.lit("://"), u) + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


@dataclass(frozen=True)
class Rule:
    """``host/path-prefix`` and its verdict; it fits the host and all its subdomains."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, tail = self.text.partition("/")
        return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))


def apply_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        ok = r.fits(host, path)
        text, verdict = F.when(ok, r.text).otherwise(text), F.when(ok, r.verdict).otherwise(verdict)
    return text, verdict


#: The features, in order.
FEATURES = ["length", "depth", "digit_ratio", "entropy", "n_params", "host_length", "n_labels", "hyphens", "path_length", "suffix_rate", "suffix_seen"]


#: Of these, the ones that Spark's own functions work out.
_NATIVE = [f for f in FEATURES if f not in ("entropy", "suffix_rate", "suffix_seen")]


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features that need no Python, and ``suffix``: the last two labels of the host. Null URLs are empty."""
    u = F.coalesce(url, F.lit(""))
    count = lambda c, x: F.char_length(c) - F.char_length(F.replace(c, F.lit(x), F.lit("")))
    query = F.regexp_extract(u, r"\A[^#?]*\?([^#]*)", 1)
    out = {
        "length": F.char_length(u), "depth": count(path, "/"), "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / F.greatest(F.lit(1), F.octet_length(u)),
        "n_params": F.when(query != "", count(query, "&") + 1).otherwise(0), "host_length": F.char_length(host), "n_labels": F.when(host != "", count(host, ".") + 1).otherwise(0),
        "hyphens": count(host, "-"), "path_length": F.char_length(path),
    }
    return {k: v.cast("double") for k, v in out.items()} | {"suffix": F.substring_index(host, ".", -2)}


def entropy(urls: pd.Series) -> np.ndarray:
    """Bits a byte of each URL, all at once."""
    raw = [u.encode() for u in urls.fillna("")]
    n = np.array([len(r) for r in raw], np.int64)
    out = np.zeros(len(raw))
    for lo in range(0, len(raw), 4096):  # 256 counts a row
        size = n[lo : lo + 4096]
        owner = np.repeat(np.arange(len(size)), size)
        count = np.bincount(owner * 256 + np.frombuffer(b"".join(raw[lo : lo + 4096]), np.uint8), minlength=256 * len(size)).reshape(-1, 256)
        share = count / np.maximum(size, 1)[:, None]
        out[lo : lo + 4096] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    return out


@dataclass
class BoostedTrees:
    """Gradient boosting of the logistic loss over histogram splits; small, deterministic."""

    rounds: int = 40
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    least: int = 20
    base: float = 0.0
    trees: list[list[tuple]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows by features; y: 0 or 1. With one class or no rows the model is a constant."""
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        if len(np.unique(y)) < 2:
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            score += self._grow(tree, binned, edges, y - p, p * (1 - p), np.arange(len(y)), self.depth, np.zeros(len(y)))
            self.trees.append(tree)
        return self

    def _grow(self, tree, binned, edges, g, h, rows, depth, add):
        """Append the node of ``rows`` (feature, edge, left, right, value) and set their part of ``add``."""
        here, value = len(tree), self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        tree.append((-1, 0.0, 0, 0, value))
        add[rows] = value
        best = (1e-6, -1, -1)
        if depth and len(rows) >= 2 * self.least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                if gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
        if best[1] >= 0:
            _, j, k = best
            left = binned[rows, j] <= k
            l_at = len(tree)
            self._grow(tree, binned, edges, g, h, rows[left], depth - 1, add)
            r_at = len(tree)
            self._grow(tree, binned, edges, g, h, rows[~left], depth - 1, add)
            tree[here] = (j, float(edges[j][k]), l_at, r_at, value)
        return add

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        score = np.full(len(x), self.base)
        for tree in self.trees:
            f, e, lt, rt, v = (np.array(c) for c in zip(*tree, strict=True))
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = f[at] >= 0
                go = np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= e[at], lt[at], rt[at])
                at = np.where(inner, go, at)
            score += v[at]
        return 1 / (1 + np.exp(-score))


@dataclass
class UrlModel:
    """Trees, and block rate and count of each suffix in the sample. Tables have ``url``, ``suffix`` and the native features."""

    trees: BoostedTrees
    rates: dict[str, tuple[float, float]]
    base: float

    def features(self, rows: pd.DataFrame) -> np.ndarray:
        rate, seen = (rows["suffix"].map({k: v[i] for k, v in self.rates.items()}).fillna(other).to_numpy(float) for i, other in ((0, self.base), (1, 0.0)))
        own = {"entropy": entropy(rows["url"]), "suffix_rate": rate, "suffix_seen": seen} | {f: rows[f].to_numpy(float) for f in _NATIVE}
        return np.stack([own[f] for f in FEATURES], 1)

    @classmethod
    def fit(cls, labelled: pd.DataFrame) -> UrlModel:
        """``y``: 1 for block. Rates of a suffix leave out the row's own label when fitting."""
        y = labelled["y"].to_numpy(float)
        base = float((y.sum() + 1) / (len(y) + 2))
        stats = labelled.groupby("suffix")["y"].agg(["sum", "count"]) if len(labelled) else pd.DataFrame(columns=["sum", "count"])
        model = cls(BoostedTrees(), {k: (float((r["sum"] + 4 * base) / (r["count"] + 4)), float(np.log1p(r["count"]))) for k, r in stats.iterrows()}, base)
        x = model.features(labelled)
        if len(y):
            n, s = (labelled["suffix"].map(stats[c]).to_numpy(float) for c in ("count", "sum"))
            x[:, FEATURES.index("suffix_rate")] = (s - y + 4 * base) / (n - 1 + 4)
        model.trees.fit(x, y)
        return model

    def score(self, rows: pd.DataFrame) -> np.ndarray:
        return self.trees.predict(self.features(rows))


def judge_urls(df: DataFrame, key: str, url: str, rules: list[Rule], sample: int = 20_000, cut: float = 0.5) -> DataFrame:
    """Verdict on every URL: key, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the trees' probability of block, null where a rule decides).

    The trees are fitted on at most ``sample`` distinct URLs that a rule labels, those with
    the least hash of the URL, so the sample does not depend on row order. Where a rule fits, its verdict stands; the other
    URLs alone go through the trees, in Arrow batches, with features from Spark's functions. Null URLs and URLs
    without ``://`` have empty host and path, fit no rule and are judged by the trees. Repeated rows
    are judged alike. Without labelled URLs every other URL is allowed. An empty table gives an empty table. Other columns are dropped.
    """
    host, path = host_and_path(F.col("url"))
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    own = lexical(F.col("url"), F.col("host"), F.col("path"))
    known = rows.filter(F.col("rule").isNotNull()).select("url", "host", "path", (F.col("verdict") == "block").cast("int").alias("y")).distinct()
    picked = hash_sample(known, "url", sample).select("url", "y", *[c.alias(n) for n, c in own.items()])
    shared = df.sparkSession.sparkContext.broadcast(UrlModel.fit(picked.toPandas()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = shared.value.score(b)
            yield b[["key", "host", "path"]].assign(rule=None, verdict=np.where(s > cut, "block", "allow"), score=s)

    kind = dict(rows.dtypes)["key"]
    rest = rows.filter(F.col("rule").isNull()).select("key", "url", "host", "path", *[c.alias(n) for n, c in own.items()])
    judged = rest.mapInPandas(run, f"key {kind}, host string, path string, rule string, verdict string, score double")
    decided = rows.filter(F.col("rule").isNotNull()).select("key", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    return decided.unionByName(judged).withColumnRenamed("key", key)
