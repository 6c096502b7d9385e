"""URL filters: rules by host and path, and for the URLs no rule decides gradient-boosted trees on lexical features. DataFrame operations only.

The labelled URLs are those that a rule decides (blocked or allowed), or that a column says so of. The features are whole numbers, each put into a few
bins: lengths of URL, host and path, depth of path and host, share of digits, entropy of the characters, numbers of parameters, and for the
host's last label and its last two labels how many URLs have that suffix and what share of them is known to be blocked (URLs without a label and
PRIOR_ROWS more count with the share over all labels, so a suffix of which few URLs are labelled says little).

Labelled URLs of equal bins are one cell with two counts, so a URL or host repeated any number of times is one row, and all labelled
URLs take part in the fit: no sample. Each level of a tree is one aggregate over the cells, by (node, feature, bin), summed within the tasks first; the
driver gets at most nodes x features x BINS sums and chooses the splits. Gradients are integers in units of 1 / UNIT, so sums don't depend on the order of rows
and reruns agree. The trees become one SQL expression, which Spark compiles into the scan of the URLs.

Broadcast is the table of suffixes, where it has at most FEW_SUFFIXES rows; else it is joined by sorting both sides.

Defined cases: a null URL, and one without ``://``, has an empty host and path, matches no rule and is judged by the trees like any other; repeated
rows are judged alike; of rules that match, the longest (host and path) wins, then the longer host, then the blocking one. Without any labelled URL every
verdict is ``allow``; where all labels agree, it is theirs. An empty table gives an empty result. Other columns are ignored. ``rules`` are part of the
plan and meant to be few (hundreds); larger lists are a table to be joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import cut, spread, with_columns_of

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS, TREES, DEPTH, RATE, RIDGE = 16, 12, 3, 0.3, 1.0
UNIT = 1 << 16
PRIOR_ROWS = 20
FEW_SUFFIXES = 100_000
CELLS_A_TASK = 50_000
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "last_known", "last_seen", "domain_known", "domain_seen")


@dataclass
class Trees:
    """Boosted trees: the first score and, for each tree, a nested (feature, bin, left, right) or a leaf's value."""

    base: float
    trees: list = field(default_factory=list)

    def score(self) -> Column:
        """The log odds of being blocked, over the feature columns."""
        return F.lit(self.base) + sum((_value(t) for t in self.trees), F.lit(0.0))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The rule that decides, as one text, and its verdict; null where none does."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r))
    none = F.lit(None).cast("string")
    tests = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for h, p, _ in order]
    return F.coalesce(none, *[F.when(t, h + p) for t, (h, p, _) in zip(tests, order, strict=True)]), F.coalesce(none, *[F.when(t, v) for t, (_, _, v) in zip(tests, order, strict=True)])


def entropy(text: Column) -> Column:
    """Bits for each character of ``text``: one walk over its sorted characters, without a table of them."""
    begin = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"))
    weigh = lambda run: F.when(run > 1, run * F.log2(run.cast("double"))).otherwise(0.0)

    def walk(state: Column, c: Column) -> Column:
        same = state["last"] == c
        run = F.when(same, state["run"] + 1).otherwise(F.lit(1).cast("long"))
        total = F.when(same, state["total"]).otherwise(state["total"] + weigh(state["run"]))
        return F.struct(c.alias("last"), run.alias("run"), total.alias("total"), (state["n"] + 1).alias("n"))

    bits = lambda s: F.when(s["n"] > 0, F.log2(s["n"].cast("double")) - (s["total"] + weigh(s["run"])) / s["n"]).otherwise(0.0)
    return F.aggregate(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), begin, walk, bits)


def _binned(number: Column, step: float) -> Column:
    """``number`` in steps, 0 to BINS - 1."""
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(number / step).cast("int")))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, ...) with the binned features that the URL alone gives, and its suffixes ``last`` and ``domain``."""
    url = F.coalesce("url", F.lit(""))
    length = F.char_length(url)
    digits = length - F.char_length(F.translate(url, "0123456789", ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        "url_length": _binned(length, 6), "host_length": _binned(F.char_length("host"), 3), "path_length": _binned(F.char_length("path"), 2),
        "depth": _binned(F.size(F.filter(F.split("path", "/"), lambda x: x != "")), 1), "labels": _binned(F.size(F.split("host", r"\.")), 1),
        "digits": _binned(digits / F.greatest(length, F.lit(1)), 0.04), "entropy": _binned(entropy(url) - 2, 0.25),
        "parameters": _binned(F.size(F.filter(F.split(query, "&"), lambda x: x != "")), 1),
        "last": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
    })


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """suffix, known, seen (binned) over all ``urls`` (last, domain, blocked): one row for each of their suffixes."""
    each = urls.select("blocked", F.explode(F.array_distinct(F.array("last", "domain"))).alias("suffix"))
    counts = cut(each.groupBy("suffix").agg(F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")))
    whole = urls.agg(F.count("blocked").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    prior = (whole["blocked"] or 0) / max(1, whole["labelled"])
    known = (F.col("blocked") + F.lit(prior) * (F.col("n") - F.col("labelled") + PRIOR_ROWS)) / (F.col("n") + PRIOR_ROWS)
    return counts.select("suffix", _binned(known, 1 / BINS).alias("known"), _binned(F.log2(F.col("n").cast("double")), 2).alias("seen"))


def with_features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, blocked, ...) with FEATURES; ``blocked`` is 1, 0 or null for no label."""
    rows = lexical(urls)
    found = cut(suffix_statistics(rows))
    found = F.broadcast(found) if found.count() <= FEW_SUFFIXES else spread(found)
    for name in ("last", "domain"):
        rows = rows.join(found.select(F.col("suffix").alias(name), F.col("known").alias(f"{name}_known"), F.col("seen").alias(f"{name}_seen")), name)
    return rows


def _value(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, edge, left, right = tree
    return F.when(F.col(name) <= edge, _value(left)).otherwise(_value(right))


def _leaf(g: int, h: int) -> float:
    return -RATE * (g / UNIT) / (h / UNIT + RIDGE)


def _gain(g: int, h: int) -> float:
    return (g / UNIT) ** 2 / (h / UNIT + RIDGE)


def split_of(sums: dict[str, dict[int, tuple[int, int]]]) -> tuple[str, int] | None:
    """The best (feature, bin) of a node's sums (g, h) by feature and bin; ties go to the earlier feature and the lower bin."""
    best, found = 1e-9, None
    for name in FEATURES:
        bins = sums.get(name, {})
        g, h = (sum(x[i] for x in bins.values()) for i in (0, 1))
        left_g = left_h = 0
        for edge in sorted(bins)[:-1]:
            left_g, left_h = left_g + bins[edge][0], left_h + bins[edge][1]
            gain = _gain(left_g, left_h) + _gain(g - left_g, h - left_h) - _gain(g, h)
            if gain > best:
                best, found = gain, (name, edge)
    return found


def _grown(cells: DataFrame) -> list | float:
    """One tree over ``cells`` (FEATURES, g, h)."""
    open_nodes, tree = {0: (0, 0)}, {}
    node, path = F.lit(0), {}
    for level in range(DEPTH + 1):
        sums: dict[int, dict[str, dict[int, tuple[int, int]]]] = {}
        if level < DEPTH:
            each = cells.withColumn("node", node).where("node >= 0").select("node", "g", "h", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES])).alias("at"))
            for r in each.groupBy("node", "at.feature", "at.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes x features x BINS rows at most
                sums.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"])
        if level == 0:
            first = sums[0][FEATURES[0]].values()
            open_nodes[0] = (sum(x[0] for x in first), sum(x[1] for x in first))
        chosen, below = {}, {}
        for n, total in open_nodes.items():
            cut_at = split_of(sums[n]) if n in sums else None
            if cut_at is None:
                tree[n] = _leaf(*total)
                continue
            name, edge = cut_at
            bins = sums[n][name]
            left = tuple(sum(bins[b][i] for b in bins if b <= edge) for i in (0, 1))
            chosen[n], tree[n] = cut_at, (name, edge)
            below[2 * n + 1], below[2 * n + 2] = left, (total[0] - left[0], total[1] - left[1])
        if not chosen:
            break
        path = node
        node = F.lit(-1)
        for n, (name, edge) in chosen.items():
            node = F.when((path == n) & (F.col(name) <= edge), 2 * n + 1).when(path == n, 2 * n + 2).otherwise(node)
        open_nodes = below

    def built(n: int) -> list | float:
        return tree[n] if isinstance(tree[n], float) else (*tree[n], built(2 * n + 1), built(2 * n + 2))

    return built(0)


def fit(rows: DataFrame, trees: int = TREES) -> Trees:
    """Trees from ``rows`` (FEATURES, blocked), of all that have a label."""
    cells = rows.where("blocked IS NOT NULL").groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    cells = cut(cells)
    size = cells.agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    if not size["n"] or size["b"] in (0, size["n"]):
        return Trees(math.inf if size["b"] else -math.inf)
    model = Trees(math.log(size["b"] / (size["n"] - size["b"])))
    cells = cut(cells.coalesce(size["cells"] // CELLS_A_TASK + 1).withColumn("score", F.lit(model.base)))
    for _ in range(trees):
        p = F.round(F.lit(float(UNIT)) / (1 + F.exp(-F.col("score")))).cast("long")
        graded = cells.withColumn("g", F.col("n") * p - F.col("b") * UNIT).withColumn("h", F.expr("0L") + F.col("n") * F.floor(p * (UNIT - p) / UNIT))
        tree = _grown(graded)
        model.trees.append(tree)
        cells = cut(cells.withColumn("score", F.col("score") + _value(tree)))
    return model


def judged(urls: DataFrame, rules: tuple = RULES, trees: int = TREES) -> DataFrame:
    """``urls`` with host, path, rule, verdict, and the trees' ``odds`` (log odds of being blocked), which decide where no rule does."""
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns({"rule": rule, "verdict": verdict})
    rows = with_features(rows.withColumn("blocked", F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", 0)))
    model = fit(rows, trees)
    rows = rows.withColumn("odds", model.score())
    own = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return rows.select(*[F.col(f"`{c}`") for c in urls.columns], "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "odds")


def op13_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = with_columns_of(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_id="bigint", url="string")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict")
