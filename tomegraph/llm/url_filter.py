"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs, here those a rule decides: TRAIN_ROWS distinct ones at most, those
with the smallest hash. Suffix statistics (order of magnitude of the rows and hosts of the last host
label, its length) count all pages and no labels: since rules name suffixes, a suffix's label rate
would be the rule told again, and the trees would learn nothing else.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is judged
by the trees; with no labelled row, or one label only, the trees answer that label (allow if none);
equal page_ids keep a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialise, table

TRAIN_ROWS = 20_000
#: The rules of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "params", "query_length", "suffix_length", "suffix_rows", "suffix_hosts", "hyphens", "escapes")


def split_url(pages: DataFrame) -> DataFrame:
    """Adds host, path and suffix (the host's last label)."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = pages.withColumn("rest", F.coalesce(rest, F.lit(""))).withColumns({"host": lower, "path": F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1)})
    return out.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).drop("rest")


def apply_rules(urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds rule and ruled (its verdict); the longest fitting rule wins, null where none fits."""
    rule = ruled = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):  # a later one is longer and stands above
        host, path = r[: r.index("/")], r[r.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, r).otherwise(rule), F.when(fits, rules[r]).otherwise(ruled)
    return urls.withColumns({"rule": rule, "ruled": ruled})


def features(urls: list[str | None], hosts: list[str], paths: list[str], suffix_rows: np.ndarray, suffix_hosts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(urls), len(FEATURES)))
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
        u = url or ""
        n = len(u)
        query = u.partition("?")[2].partition("#")[0]
        counts = np.unique(np.frombuffer(u.encode("utf-8", "replace"), np.uint8), return_counts=True)[1] if n else np.ones(1)
        p = counts / counts.sum()
        out[i] = (n, len(host), len(path), path.count("/"), host.count(".") + 1 if host else 0, sum(c.isdigit() for c in u) / max(n, 1), -(p * np.log2(p)).sum(), query.count("=") + query.count("&"), len(query), len(host.rpartition(".")[2]), 0, 0, u.count("-"), u.count("%"))
    out[:, 10], out[:, 11] = suffix_rows, suffix_hosts
    return out


class BoostedTrees:
    """Logistic gradient boosting on binned features; trees of a fixed depth stored as arrays."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth = rounds, depth, rate, bins, smooth

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 1e-4
        self.base = float(np.log(mean / (1 - mean)))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(code, cuts, y - p, p * (1 - p))
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, code, cuts, g, h):
        n_inner = (1 << self.depth) - 1
        feature, cut = np.full(n_inner, -1), np.full(n_inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            base = (1 << level) - 1
            for k in range(base, 2 * base + 1):
                rows = np.flatnonzero(node == k)
                if not len(rows):
                    continue
                gk, hk = g[rows], h[rows]
                total_g, total_h = gk.sum(), hk.sum()
                best = (1e-6, -1, 0)
                for f in range(code.shape[1]):
                    if not len(cuts[f]):
                        continue
                    gl = np.cumsum(np.bincount(code[rows, f], gk, len(cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, f], hk, len(cuts[f]) + 1))[:-1]
                    gain = gl**2 / (hl + self.smooth) + (total_g - gl) ** 2 / (total_h - hl + self.smooth) - total_g**2 / (total_h + self.smooth)
                    j = int(np.argmax(gain))
                    if gain[j] > best[0]:
                        best = (float(gain[j]), f, j)
                if best[1] >= 0:
                    feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
            split = feature[node] >= 0
            right = np.zeros(len(g), bool)
            for k in np.unique(node[split]):
                rows = node == k
                right[rows] = code[rows, feature[k]] > np.searchsorted(cuts[feature[k]], cut[k], "left")
            node = 2 * node + 1 + right
        leaf = node - n_inner
        value = self.rate * np.bincount(leaf, g, n_inner + 1) / (np.bincount(leaf, h, n_inner + 1) + self.smooth)
        return (feature, cut, value), leaf

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        at = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[at, np.maximum(f, 0)] > cut[node]))
            score += value[node - len(feature)]
        return 1 / (1 + np.exp(-score))


_FIELDS = ["url", "host", "path", "suffix_rows", "suffix_hosts"]


def with_suffixes(urls: DataFrame) -> DataFrame:
    """Adds suffix_rows and suffix_hosts, decimal orders of magnitude over all of urls."""
    size = lambda n: F.floor(F.log10(n)).cast("double")
    suffixes = urls.groupBy("suffix").agg(size(F.count("*")).alias("suffix_rows"), size(F.greatest(F.approx_count_distinct("host"), F.lit(1))).alias("suffix_hosts"))
    suffixes = materialise(suffixes, "suffixes")
    # a host label has 63 bytes at most; longer text is no host but may occur, and its few rows go by a join of their own
    usual = F.octet_length("suffix") <= 128
    short = suffixes.where(usual)
    if short.count() * 256 <= BROADCAST_BYTES:
        short = F.broadcast(short)
    return urls.where(usual).join(short, "suffix").unionByName(urls.where(~usual).join(suffixes.where(~usual), "suffix"))


def training_rows(urls: DataFrame, train_rows: int):
    """Features, labels (1: block) and hosts of distinct labelled URLs, train_rows at most, on the driver."""
    labelled = urls.where("ruled IS NOT NULL").select(*_FIELDS, (F.col("ruled") == "block").cast("int").alias("label")).distinct()
    rows = labelled.orderBy(F.xxhash64("url"), "url").limit(train_rows).toPandas().sort_values("url", kind="stable")
    x = features(rows["url"].tolist(), rows["host"].tolist(), rows["path"].tolist(), rows["suffix_rows"].to_numpy(float), rows["suffix_hosts"].to_numpy(float))
    return x, rows["label"].to_numpy(float), rows["host"].to_numpy()


def ruled_urls(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """page_id, url, host, path, rule, ruled, suffix_rows, suffix_hosts of every page."""
    return with_suffixes(apply_rules(split_url(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))), rules))


def judge(pages: DataFrame, rules: dict[str, str], train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block)."""
    urls = ruled_urls(pages, rules)
    x, y, _ = training_rows(urls, train_rows)
    model = pages.sparkSession.sparkContext.broadcast(BoostedTrees().fit(x, y))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            got = features(*(c[n].to_pylist() for n in _FIELDS[:3]), *(c[n].to_numpy(zero_copy_only=False).astype(float) for n in _FIELDS[3:]))
            score = model.value.predict(got)
            verdict = [r or ("block" if s >= threshold else "allow") for r, s in zip(c["ruled"].to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([c["page_id"], c["host"], c["path"], c["rule"], pa.array(verdict, pa.string()), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "score"])

    return urls.select("page_id", *_FIELDS, "rule", "ruled").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE: dict[str, str] = {}
