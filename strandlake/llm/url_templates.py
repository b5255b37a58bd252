"""URL filters: a tree of path templates for each host, some of which are rejected by their labels.

``UrlTemplates.fit`` learns the tree from all urls:

1. A path is split at its slashes; segments beyond DEPTH count as one. Segments
   that are numbers, long hexadecimal numbers, or words with digits become a
   wildcard of their kind, file endings kept. Paths that are alike from then on
   are one row with a count, so a host with a third of all urls is a few rows.
2. Level by level, a segment stays literal if SUPPORT urls of its node have it, and one
   in RARE of the node's urls; all others become the wildcard for words. So
   each node has RARE literal children at most, and a few wildcards.
3. The tree of a host, which has no row for a url any more, goes to one task.
   From the top, the branches of a node are merged where what follows them
   is distributed alike (Jensen-Shannon distance up to NEAR, or up to what
   chance allows with so few urls) and where their labels don't differ (two shares, within
   SIGMAS standard errors).
4. A template's share of bad labels is smoothed with WEIGHT labels of its
   parent's share, from the share of all labels down. It is rejected from
   REJECT on. So a template without labels of its own judges like its parent.

Labels are part of what is given: (url, bad), for some urls, repeated ones
counting as often as they stand there. ``judged`` then gives each url its rule's
verdict, or else its template's.

Nulls and odd rows: a url that is null or lacks ``://`` has an empty host and an
empty path, which are a template like others. Repeated rows are judged alike. A
url whose path the tree never saw is allowed. An empty table gives no rows.
Columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments of a path that have a level of their own; what follows counts as one segment.
DEPTH = 8
SUPPORT, RARE = 5, 50
NEAR, SIGMAS, WEIGHT, REJECT = 0.25, 2.0, 4.0, 0.5
NUMBER, HEX, MIXED, WORD, REST, END = "<number>", "<hex>", "<mixed>", "<word>", "<rest>", "<end>"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host, path = F.regexp_extract(rest, r"^([^/?#]*)", 1), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct of text and verdict of the longest rule that fits, or null. An expression for each rule: for lists of some hundreds at most."""
    tests = []
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        tests.append(F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))))
    return F.coalesce(*tests, F.lit(None).cast("struct<text: string, verdict: string>"))


def shapes(path: Column) -> Column:
    """The segments of a path, those of variable kinds as wildcards, ended by END."""
    cuts = F.split(F.regexp_replace(path, "^/", ""), "/")
    levels = F.when(F.size(cuts) > DEPTH, F.concat(F.slice(cuts, 1, DEPTH), F.array(F.lit(REST)))).otherwise(cuts)

    def shape(s: Column) -> Column:
        ending = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})?$", 0)
        stem = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
        kind = F.when(F.rlike(stem, F.lit(r"^[0-9]+$")), NUMBER).when(F.rlike(stem, F.lit(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$")), HEX).when((s != REST) & F.rlike(stem, F.lit("[0-9]")), MIXED)
        return F.coalesce(F.concat(kind, ending), s)

    return F.concat(F.transform(levels, shape), F.array(F.lit(END)))


def distance(a: Counter, b: Counter) -> float:
    """Jensen-Shannon distance (base 2) of two counted distributions."""
    n, m, total = sum(a.values()), sum(b.values()), 0.0
    for x in sorted({*a, *b}):
        p, q = a[x] / n, b[x] / m
        total += sum(0.5 * y * math.log2(2 * y / (p + q)) for y in (p, q) if y)
    return math.sqrt(max(0.0, total))


class Node:
    def __init__(self):
        self.n = self.labels = self.bad = 0
        self.children: dict[str, Node] = {}
        self.paths: list[int] = []

    def count(self, n: int, labels: int, bad: int) -> None:
        self.n, self.labels, self.bad = self.n + n, self.labels + labels, self.bad + bad

    def follow(self) -> Counter:
        return Counter({name: c.n for name, c in self.children.items()})

    def absorb(self, other: Node) -> None:
        self.count(other.n, other.labels, other.bad)
        self.paths += other.paths
        for name, child in other.children.items():
            self.children.setdefault(name, Node()).absorb(child)


def alike(a: Node, b: Node) -> bool:
    """Whether two branches are followed by the same and labelled the same, as far as so few urls can tell."""
    x, y = a.follow(), b.follow()
    if bool(x) != bool(y):
        return False
    if x:
        # Drawn from one distribution of k values, n urls stray by about sqrt(k / n).
        chance = math.sqrt((len({*x, *y}) - 1) / (8 * math.log(2)) * (1 / sum(x.values()) + 1 / sum(y.values())))
        if distance(x, y) > max(NEAR, min(0.5, 2 * chance)):
            return False
    if a.labels and b.labels:
        share = (a.bad + b.bad) / (a.labels + b.labels)
        error = math.sqrt(share * (1 - share) * (1 / a.labels + 1 / b.labels))
        return abs(a.bad / a.labels - b.bad / b.labels) <= SIGMAS * error
    return True


def merged_children(node: Node) -> dict[str, Node]:
    """The children, largest first, each merged into the first class that it is like; a class is named by its members."""
    classes: list[tuple[list[str], Node]] = []
    for name, child in sorted(node.children.items(), key=lambda x: (-x[1].n, x[0])):
        for names, held in classes:
            if END not in (name, *names) and alike(held, child):
                names.append(name)
                held.absorb(child)
                break
        else:
            classes.append(([name], child))
    return {"|".join(sorted(names)): held for names, held in classes}


def leaves(root: Node, share: float) -> Iterator[tuple[list[int], str, float, int]]:
    """Of each template: the numbers of its paths, its text, its smoothed share of bad labels, its labels."""
    todo = [(root, "", share)]
    while todo:
        node, text, above = todo.pop()
        own = (node.bad + WEIGHT * above) / (node.labels + WEIGHT)
        if node.paths:
            yield node.paths, text or "/", own, node.labels
        todo += [(child, text if name == END else f"{text}/{name}", own) for name, child in merged_children(node).items()]


def templates_of(segs: list[list[str]], counts: list[tuple[int, int, int]], share: float) -> list[tuple[str, float, int]]:
    """template, smoothed share, labels for each generalised path of one host; counts: urls, labels, bad ones."""
    root, out = Node(), [None] * len(segs)
    for i, (names, c) in enumerate(zip(segs, counts, strict=True)):
        node = root
        node.count(*c)
        for name in names:
            node = node.children.setdefault(name, Node())
            node.count(*c)
        node.paths.append(i)
    for paths, text, own, labels in leaves(root, share):
        for i in paths:
            out[i] = (text, own, labels)
    return out


def generalised(paths: DataFrame, keep: Scratch) -> DataFrame:
    """paths (host, segs, n, labels, bad) with ``general``: the segments, rare ones as the wildcard for words."""
    deepest = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    left, before = paths.withColumn("general", F.array().cast("array<string>")), None
    here, segment = [F.col("host"), F.col("general")], F.get("segs", F.size("general"))
    special = segment.isin(END, REST, "") | F.rlike(segment, F.lit(rf"^({NUMBER}|{HEX}|{MIXED})(\.|$)"))
    for _ in range(deepest):  # DEPTH + 2 at most
        open_ = F.size("segs") > F.size("general")
        named = left.filter(open_ & ~special)
        counts = named.groupBy(*here, segment.alias("s")).agg(F.sum("n").alias("c"))
        totals = left.filter(open_).groupBy(*here).agg(F.sum("n").alias("t"))
        kept = counts.join(totals, ["host", "general"]).filter((F.col("c") >= SUPPORT) & (F.col("c") * RARE >= F.col("t"))).select("host", "general", "s", F.lit(True).alias("kept"))
        met = left.withColumn("s", segment).join(kept, ["host", "general", "s"], "left")
        name = F.when(special | F.col("kept"), F.col("s")).otherwise(F.lit(WORD))
        level = met.withColumn("general", F.when(open_, F.concat("general", F.array(name))).otherwise(F.col("general"))).drop("s", "kept")
        left = before = keep.cut(level, "templates-level", before)
    return left


class UrlTemplates:
    """paths: host, segs, template, purity (smoothed share of bad labels), labels, rejected."""

    def __init__(self, paths: DataFrame):
        self.paths = paths

    @classmethod
    def fit(cls, urls: DataFrame, labelled: DataFrame, keep: Scratch) -> UrlTemplates:
        """urls (url), labelled (url, bad boolean). keep: a Scratch for the tables between."""
        parts = lambda df, *more: df.select(*(x.alias(n) for x, n in zip(host_and_path(F.col("url")), ("host", "path"), strict=True)), *more)
        seen = parts(urls, F.lit(1).alias("n"), F.lit(0).alias("labels"), F.lit(0).alias("bad"))
        told = parts(labelled.filter("bad is not null"), F.lit(0).alias("n"), F.lit(1).alias("labels"), F.col("bad").cast("int").alias("bad"))
        paths = seen.unionByName(told).select("host", shapes(F.col("path")).alias("segs"), "n", "labels", "bad").groupBy("host", "segs").agg(*(F.sum(c).alias(c) for c in ("n", "labels", "bad")))
        paths = keep.cut(paths.filter("n > 0"), "url-paths")
        total = paths.agg(F.coalesce(F.sum("labels"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
        share = total[1] / total[0] if total[0] else 0.0
        general = generalised(paths, keep)
        # What the tasks get has a row for each generalised path of a host, not for each path.
        tree = general.groupBy("host", "general").agg(*(F.sum(c).alias(c) for c in ("n", "labels", "bad")))

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(order=["\0".join(x) for x in pdf["general"]]).sort_values("order")
            found = templates_of([list(x) for x in pdf["general"]], [tuple(map(int, x)) for x in pdf[["n", "labels", "bad"]].itertuples(index=False)], share)
            return pd.DataFrame([(key[0], list(g), *x) for g, x in zip(pdf["general"], found, strict=True)], columns=["host", "general", "template", "purity", "labels"])

        judged = tree.groupBy("host").applyInPandas(run, "host string, general array<string>, template string, purity double, labels long")
        out = general.select("host", "segs", "general").join(judged, ["host", "general"])
        return cls(keep.cut(out.select("host", "segs", "template", "purity", "labels", (F.col("purity") >= REJECT).alias("rejected")), "url-templates"))

    def judged(self, pages: DataFrame, rules: tuple[Rule, ...] = ()) -> DataFrame:
        """pages (page_id, url) as page_id, host, path, rule, verdict, template, purity. Where one path has very many urls, Spark splits the join's partition."""
        host, path = host_and_path(F.col("url"))
        own = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segs", shapes(F.col("path")))
        met = own.join(self.paths.select("host", "segs", "template", "purity", "rejected"), ["host", "segs"], "left")
        verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
        return met.select("page_id", "host", "path", F.col("_rule.text").alias("rule"), verdict.alias("verdict"), "template", "purity")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad: a page shows the document whose number ends its path, and is as bad as that document's label. Documents labelled twice are bad if one label is."""
    number = F.regexp_extract(host_and_path(F.col("url"))[1], r"/([0-9]{1,18})(\.[A-Za-z]+)?/?$", 1)
    own = pages.select("url", number.try_cast("long").alias("doc_id"))
    known = labels.filter("quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return own.join(known, "doc_id").select("url", "bad")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each page; templates are labelled by the quality labels of the documents that pages show."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    with Scratch(spark) as keep:
        model = UrlTemplates.fit(pages.select("url"), page_labels(pages.select("url"), labels), keep)
        return cut(model.judged(pages, RULES), "url-verdicts")
