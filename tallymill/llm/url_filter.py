"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule decides.

The trees are trained, in numpy, from labelled URLs: here those that the rules decide (block is 1). Features: lengths of
URL, host and path, depth, labels of the host, digit ratios, entropy of the characters, parameters, punctuation, and
the block rate of the host's suffix. Suffixes are hashed into a fixed number of buckets, whose rates come from all labelled
URLs of one half (by hash of the URL), the trees from the other half, so no row sees its own label. The fit takes a bounded, deterministic sample (``SAMPLE``); every URL is judged.

Null URLs, and those without ``://``, have empty host and path and fit no rule; the trees judge them by what is there.
Without labels of both classes the trees allow everything. Repeated rows are judged each; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import first_hashes, map_parts

SUFFIXES, SAMPLE = 4096, 20_000
TREES, DEPTH, BINS, RATE, LEAST = 60, 4, 32, 0.15, 20


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(SUFFIXES)).cast("int")


def rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(name, verdict) of the longest rule whose host is the URL's or a parent of it and whose path begins the URL's."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def features(url: str, host: str, path: str) -> list[float]:
    """Lexical features of one URL."""
    n = len(url) or 1
    query = url.partition("?")[2].partition("#")[0]
    entropy = -sum(c / n * log2(c / n) for c in Counter(url).values())
    digits = sum(map(str.isdigit, url))
    last = path.rstrip("/").rpartition("/")[2]
    return [
        len(url), len(host), len(path), path.count("/"), host.count(".") + 1, digits / n, sum(map(str.isdigit, host)) / (len(host) or 1), entropy,
        query.count("&") + (query != ""), len(query), host.count("-"), path.count("-") + path.count("_"), "." in last, path.endswith("/"), url.startswith("https"),
        "#" in url, len(last), max(map(len, path.split("/"))), sum(not x.isalnum() for x in url) / n,
    ]


@dataclass
class Trees:
    """Complete trees of one depth over binned features; a split goes right above its edge."""

    base: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    edge: np.ndarray
    leaf: np.ndarray  # (trees, 2^depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, e, leaf in zip(self.feature, self.edge, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(log2(len(leaf)))):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > e[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = LEAST) -> Trees:
    """Gradient boosting of the logistic loss, splits by the gain of second-order histograms, halfway between values. Both
    classes weigh the same, so that what looks like neither side is near one half."""
    edges = []
    for c in x.T:
        values = np.unique(np.quantile(c, np.linspace(0, 1, BINS), method="nearest"))
        edges.append((values[1:] + values[:-1]) / 2)
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    base = 0.0
    raw, inner = np.full(len(y), base), (1 << depth) - 1
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = weight * (y - p), weight * p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                rows = np.flatnonzero(node == k)
                best = (1e-6, 0, np.inf)
                if len(rows) >= 2 * least:
                    G, H = g[rows].sum(), h[rows].sum()
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[rows, f]
                        gl, hl, nl = (np.bincount(b, w, len(e) + 1)[:-1].cumsum() for w in (g[rows], h[rows], np.ones(len(rows))))
                        gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                        gain[(nl < least) | (len(rows) - nl < least)] = 0
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (gain[i], f, e[i])
                out.feature[t, k], out.edge[t, k] = best[1:]
                node[rows] = 2 * k + 1 + (x[rows, best[1]] > best[2])
        at = node - inner
        out.leaf[t] = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        raw += out.leaf[t][at]
    return out


@dataclass
class Model:
    suffixes: np.ndarray  # (SUFFIXES, 1): block rate among labelled rows, one half where none is labelled
    trees: Trees | None

    def blocked(self, urls: list[str], hosts: list[str], paths: list[str], buckets: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(urls):
            return np.zeros(len(urls))
        x = np.array([features(*u) for u in zip(urls, hosts, paths)], np.float64)
        return 1 / (1 + np.exp(-self.trees.raw(np.concatenate((x, self.suffixes[buckets]), axis=1))))


def parsed(pages: DataFrame, rules: list[Rule], id_col: str, url_col: str) -> DataFrame:
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("__id"), F.coalesce(url, F.lit("")).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.withColumn("rule", rule_of(rules, F.col("host"), F.col("path"))).withColumn("suffix", suffix_of(F.col("host")))


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """From parsed URLs; those with a rule are labelled. Suffix rates count all rows of one half of the URLs; the trees learn from
    at most ``sample`` distinct URLs of the other, the first in the order of a hash."""
    half, block = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(2)) == 0, F.col("rule.verdict") == "block"
    labelled = F.col("rule").isNotNull()
    told = rows.groupBy("suffix").agg(F.count_if(labelled & half).alias("known"), F.count_if(labelled & half & block).alias("bad")).collect()
    known, bad = (sum(r[k] for r in told) for k in ("known", "bad"))
    odds = (known - bad + 1) / (bad + 1)  # what a blocked row weighs, so that both classes weigh the same
    suffixes = np.full((SUFFIXES, 1), 0.5)
    for r in told:
        suffixes[r["suffix"], 0] = (r["bad"] * odds + 5) / (r["bad"] * odds + r["known"] - r["bad"] + 10)
    fit = rows.where(labelled & ~half).select("url", "host", "path", "suffix", block.alias("y"), F.xxhash64("url", F.lit(2)).alias("h"))
    distinct = fit.agg(F.approx_count_distinct("url")).first()[0]
    few = first_hashes(fit, "h", sample, distinct).dropDuplicates(["url"]).orderBy("h", "url").limit(sample).collect()
    y = np.array([r["y"] for r in few], np.float64)
    if len(set(y)) < 2:
        return Model(suffixes, None)
    x = np.array([features(r["url"], r["host"], r["path"]) for r in few], np.float64)
    return Model(suffixes, boost(np.concatenate((x, suffixes[[r["suffix"] for r in few]]), axis=1), y))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """id, host, path, rule, verdict and score (null where a rule decides) of every page."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = parsed(pages, rules, id_col, url_col)
    fitted = model or train(rows)

    def make():
        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, urls, hosts, paths, names, verdicts, buckets = (b.column(i) for i in range(7))
            ruled = np.array([v is not None for v in verdicts.to_pylist()], bool)
            at = np.flatnonzero(~ruled)
            score = np.full(len(ruled), np.nan)
            pick = lambda c: c.take(pa.array(at)).to_pylist()
            score[at] = fitted.blocked(pick(urls), pick(hosts), pick(paths), buckets.to_numpy()[at])
            judged = [v or ("block" if s >= threshold else "allow") for v, s in zip(verdicts.to_pylist(), score)]
            return pa.record_batch([ids, hosts, paths, names, pa.array(judged), pa.array(score, pa.float64(), mask=ruled)], ["__id", "host", "path", "rule", "verdict", "score"])

        return part

    base = rows.select("__id", "url", "host", "path", F.col("rule.name").alias("name"), F.col("rule.verdict").alias("told"), "suffix")
    return map_parts(base, make, f"__id {kind}, host string, path string, rule string, verdict string, score double", 4096).withColumnRenamed("__id", id_col)
