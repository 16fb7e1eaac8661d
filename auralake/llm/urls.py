"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule fits.

All of it is DataFrame expressions. A boosting step is an aggregate (gradients by node, feature and bin) of which
the driver gets a table of fixed size; the trained trees are a column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, spill, table

#: (verdict, host, path); a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Bin borders of the features; a value falls into the bin numbered by how many borders it reaches.
BORDERS = {
    "length": (20, 28, 34, 40, 46, 54, 64, 80, 120, 200),
    "host_length": (8, 12, 16, 18, 20, 22, 24, 28, 36),
    "labels": (2, 3, 4, 5),
    "depth": (1, 2, 3, 4, 6),
    "digit_ratio": (0.01, 0.04, 0.06, 0.08, 0.1, 0.15, 0.25),
    "entropy": (2.5, 3.0, 3.4, 3.6, 3.8, 4.0, 4.2, 4.5),
    "params": (1, 2, 3, 5),
    "hyphens": (1, 2, 4),
    "suffix1_rate": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9),
    "suffix2_rate": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9),
}
#: So many suffixes' rates are sent to all executors; more are joined by shuffle.
SENT_SUFFIXES = 100_000


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text (host and path), and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last fitting one stands
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The lexical features of a url but for the suffix statistics; null counts as the empty text."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    count = lambda c, s: (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))).cast("double")
    share = F.transform(F.array_distinct(F.split(u, "")), lambda c: F.when(c == "", F.lit(0.0)).otherwise((F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n))
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": F.when(host == "", 0.0).otherwise(count(host, ".") + 1),
        "depth": count(path, "/"),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / n,
        "entropy": F.round(entropy, 6),
        "params": count(u, "&") + count(u, "="),
        "hyphens": count(host, "-"),
    }


def _bin(c: Column, borders) -> Column:
    return sum(((c >= b).cast("int") for b in borders), F.lit(0))


@dataclass
class Node:
    """A split (feature, bin: rows with a lesser bin go left) or, with no feature, a leaf."""

    value: float = 0.0
    feature: str | None = None
    bin: int = 0
    left: Node | None = None
    right: Node | None = None

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) < self.bin, self.left.column()).otherwise(self.right.column())

    def leaf(self, path: str = "1") -> Column:
        """The number of the leaf a row falls into."""
        if self.feature is None:
            return F.lit(int(path, 2))
        return F.when(F.col(self.feature) < self.bin, self.left.leaf(path + "0")).otherwise(self.right.leaf(path + "1"))

    def leaves(self, path: str = "1"):
        return {int(path, 2): self} if self.feature is None else self.left.leaves(path + "0") | self.right.leaves(path + "1")


@dataclass
class Model:
    base: float
    suffix1: DataFrame | None
    suffix2: DataFrame | None
    mean: float
    trees: list[Node]

    def score(self) -> Column:
        """The probability of a block, from the bin columns."""
        margin = sum((t.column() for t in self.trees), F.lit(self.base))
        return 1 / (1 + F.exp(-margin))


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _rates(labelled: DataFrame, labels: int, mean: float) -> DataFrame:
    """The rate of each labelled suffix. The mean rate, which suffixes without labels have, counts like ten urls."""
    counts = labelled.groupBy(_suffix(F.col("host"), labels).alias("s")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    rates = spill(counts.select(F.col("s").alias(f"_s{labels}"), ((F.col("y") + 10 * mean) / (F.col("n") + 10)).alias(f"_rate{labels}")), "url-suffixes")
    return F.broadcast(rates) if rates.limit(SENT_SUFFIXES + 1).count() <= SENT_SUFFIXES else rates


def train(labelled: DataFrame, trees: int = 10, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Model:
    """Boosted trees for the logistic loss. ``labelled``: url, host, path, y (1: block).

    All labelled rows count. They are binned and rows with equal bins are folded into one with a weight; a
    step sums gradients as whole millionths, so that no order of summation changes a split. Ties go to the
    feature and bin that come first. Without rows of either label the model is a constant.
    """
    total = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    n, y = total.n, total.y or 0
    mean = (y + 1) / (n + 2)
    model = Model(math.log(mean / (1 - mean)), None, None, mean, [])
    if not 0 < y < n:
        return model
    model.suffix1, model.suffix2 = _rates(labelled, 1, mean), _rates(labelled, 2, mean)
    names = list(BORDERS)
    rows = spill(binned(labelled, model).groupBy(*names).agg(F.count("*").alias("n"), F.sum("y").alias("y")), "url-bins")
    for _ in range(trees):
        tree = Node()
        for _level in range(depth):
            p = model.score()
            grads = rows.select(
                *names, tree.leaf().alias("leaf"), F.round((F.col("y") - F.col("n") * p) * 1_000_000).cast("long").alias("g"),
                F.round(F.col("n") * p * (1 - p) * 1_000_000).cast("long").alias("h"),
            )
            pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(k).alias("b")) for i, k in enumerate(names)]))
            sums = grads.select("leaf", "g", "h", pairs.alias("x")).groupBy("leaf", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for path, leaf in tree.leaves().items():
                _split(leaf, [(names[r.f], r.b, r.g / 1e6, r.h / 1e6) for r in sums if r.leaf == path], rate, l2)
        model.trees.append(tree)
    return model


def _split(leaf: Node, sums: list[tuple[str, int, float, float]], rate: float, l2: float) -> None:
    """Turns a leaf into the best split of its rows, if one gains."""
    best = (1e-6,)
    for name in BORDERS:
        own = sorted((b, g, h) for f, b, g, h in sums if f == name)
        all_g, all_h = sum(x[1] for x in own), sum(x[2] for x in own)
        g = h = 0.0
        for (_, dg, dh), (b, *_) in zip(own, own[1:], strict=False):
            g, h = g + dg, h + dh
            gain = round(g * g / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2), 6)
            if gain > best[0]:
                best = (gain, name, b, rate * g / (h + l2), rate * (all_g - g) / (all_h - h + l2))
    if len(best) > 1:
        _, leaf.feature, leaf.bin, low, high = best
        leaf.left, leaf.right = Node(low), Node(high)


def binned(df: DataFrame, model: Model) -> DataFrame:
    """df (url, host, path, ...) with the bins of all features in columns of the features' names."""
    host, found = F.col("host"), features(F.col("url"), F.col("host"), F.col("path"))
    for labels, rates in ((1, model.suffix1), (2, model.suffix2)):
        if rates is not None:
            df = df.join(rates, _suffix(host, labels) == F.col(f"_s{labels}"), "left")
        found[f"suffix{labels}_rate"] = F.lit(model.mean) if rates is None else F.coalesce(f"_rate{labels}", F.lit(model.mean))
    kept = [c for c in ("page_id", "host", "path", "rule", "judged", "y") if c in df.columns]
    return df.select(*kept, *[_bin(found[k], b).alias(k) for k, b in BORDERS.items()])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, at: float = 0.5) -> DataFrame:
    """A row for each row of pages: page_id, host, path, rule, verdict (allow, block), score.

    A rule decides the urls it fits, the longest one if several do; these urls are also the labelled ones
    from which the trees learn, and the trees decide the rest: block from ``at`` on. A null url, and one
    without ``://``, has an empty host and path, fits no rule and is scored by its features. Repeated rows
    get a row each; ids may be null. Without labelled urls of both kinds the score is the smoothed mean.
    Columns other than the two named are not read.
    """
    url = F.col(url_col).cast("string")
    host, path = parts_of(url)
    parsed = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("judged", verdict)
    labelled = parsed.where(F.col("judged").isNotNull()).withColumn("y", (F.col("judged") == "block").cast("long"))
    model = train(labelled)
    scored = binned(parsed, model).withColumn("score", model.score())
    return scored.select(
        F.col("page_id").alias(id_col), "host", "path", "rule",
        F.coalesce("judged", F.when(F.col("score") >= at, "block").otherwise("allow")).alias("verdict"), "score",
    )


def op2_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
