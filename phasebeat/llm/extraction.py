"""The main text of web pages by wrapper induction.

Every page becomes a tree of its block elements, in which repeated siblings are one node.  The trees of one host are aligned by simple
tree matching and merged into the host's wrapper, whose nodes are slots.  A slot whose text is the same on most pages, or has few
variants, is template; a slot whose text varies is content.  Slots seen on too few pages of a host are judged by the same
path on all hosts.  What a page marks as menu, header, footer, sidebar, notice, advert, form or comments is never content.

Only distinct trees of a host are aligned, by groups of them and then group by group, so a host with any number of pages costs its pages
nothing but a parse and an aggregation of text fingerprints.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasebeat.llm.markup import SIBLINGS, Page, is_aside, is_comment
from phasebeat.workspace import store

# Slots on fewer different pages of a host are judged by their path on all hosts.
ENOUGH = 4
# Template: the commonest text is on this share of the pages, or there are so few variants for each page.
SAME, VARIANTS = 0.5, 0.3
# Within an article only what nearly all of many pages share is template.
ARTICLE_SAME, ARTICLE_ENOUGH = 0.9, 8
# Groups in which the distinct trees of one host are first merged.
GROUPS = 16

# Elements that are never part of an article, wherever they are.
ASIDE = frozenset("nav footer aside noscript template object canvas audio video dialog select button textarea datalist menu svg option".split())
MAIN = frozenset(["article", "main"])


class Tree:
    """An ordered tree of labels; nodes are numbered, a parent before its children."""

    def __init__(self, parents: list[int], labels: list[str]):
        self.parents, self.labels = list(parents), list(labels)
        self.children: list[list[int]] = [[] for _ in labels]
        for i, p in enumerate(parents):
            if p >= 0:
                self.children[p].append(i)

    @classmethod
    def read(cls, text: str) -> Tree:
        return cls(*json.loads(text))

    def written(self) -> str:
        return json.dumps([self.parents, self.labels], separators=(",", ":"))

    def paths(self) -> list[str]:
        """The labels from the root to each node, each with its number among siblings of that label."""
        out: list[str] = []
        seen: Counter = Counter()
        for p, label in zip(self.parents, self.labels, strict=True):
            seen[p, label] += 1
            out.append(f"{out[p]}/{label}:{seen[p, label]}" if p >= 0 else label)
        return out


def matched(a: Tree, b: Tree) -> dict[int, int]:
    """The nodes of ``b`` and the nodes of ``a`` they match: most nodes in order, parent under parent (simple tree matching)."""
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(x: int, y: int) -> tuple[int, list[tuple[int, int]]]:
        """The number of matching nodes below and with ``x`` and ``y``, and the pairs of their children."""
        if a.labels[x] != b.labels[y]:
            return 0, []
        if (x, y) in known:
            return known[x, y]
        left, right = a.children[x], b.children[y]
        if not left or not right:
            known[x, y] = 1, []
            return known[x, y]
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        weight = [[match(i, j)[0] for j in right] for i in left]
        for i in range(len(left)):
            for j in range(len(right)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[i][j])
        pairs, i, j = [], len(left), len(right)
        while i and j:
            if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
                i, j = i - 1, j - 1
                pairs.append((left[i], right[j]))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        known[x, y] = 1 + best[-1][-1], pairs
        return known[x, y]

    out, open_ = {}, [(0, 0)]
    while open_:
        x, y = open_.pop()
        if a.labels[x] == b.labels[y]:
            out[y] = x
            open_ += match(x, y)[1]
    return out


def merged(a: Tree, b: Tree) -> Tree:
    """``a`` with the nodes of ``b`` that match none, each after the sibling that it follows in ``b``."""
    at = matched(a, b)
    for y in range(len(b.labels)):
        if y in at:
            continue
        parent = at[b.parents[y]]
        siblings = a.children[parent]
        alike = [s for s in siblings if a.labels[s] == b.labels[y]]
        if len(alike) >= SIBLINGS:
            at[y] = alike[-1]
            continue
        place = 0
        for s in b.children[b.parents[y]]:
            if s == y:
                break
            if at.get(s) in siblings:
                place = siblings.index(at[s]) + 1
        at[y] = len(a.labels)
        a.labels.append(b.labels[y])
        a.parents.append(parent)
        a.children.append([])
        siblings.insert(place, at[y])
    return a


def ordered(tree: Tree) -> Tree:
    """The tree numbered in the order of the page, level by level, so that its text form keeps the order of siblings."""
    queue, new = [0], {0: 0}
    for x in queue:
        for c in tree.children[x]:
            new[c] = len(new)
            queue.append(c)
    return Tree([new.get(tree.parents[x], -1) for x in queue], [tree.labels[x] for x in queue])


def roles(tree: Tree) -> tuple[list[bool], list[bool]]:
    """For each node whether it is apart from the text by what it is called, and whether it is within an article."""
    n = len(tree.labels)
    names = [label.partition(".")[0] for label in tree.labels]
    hidden = [label.endswith("!") for label in tree.labels]
    comment = [is_comment(label) for label in tree.labels]
    aside = [is_aside(label) for label in tree.labels]
    main = [names[i] in MAIN and not (hidden[i] or comment[i] or aside[i]) for i in range(n)]
    # An element that holds the article, or a page's title, is no sidebar or form, whatever its class says.
    holds = [main[i] or names[i] == "h1" for i in range(n)]
    for i in range(n - 1, 0, -1):
        holds[tree.parents[i]] |= holds[i]
    apart, within = [False] * n, [False] * n
    for i in range(n):
        p = tree.parents[i]
        over, article = (apart[p], within[p]) if p >= 0 else (False, False)
        own = names[i] in ASIDE or names[i] == "header" and not article or hidden[i] or comment[i]
        own |= (aside[i] or names[i] == "form") and not holds[i]
        apart[i] = over or own
        within[i] = article or main[i]
    return apart, within


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, name, tree, marks, blocks``: the tree, a fingerprint of each node's text, and the blocks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.struct([("node", pa.int32()), ("text", pa.string())])
        for batch in batches:
            trees, marks, blocks = [], [], []
            for source in batch["html"].to_pylist():
                p = Page(source)
                hashes: dict[int, xxhash.xxh64] = {}
                for node, text in p.blocks:
                    hashes.setdefault(node, xxhash.xxh64()).update(text.encode("utf-8", "surrogatepass") + b"\n")
                found = [hashes[i].intdigest() if i in hashes else 0 for i in range(len(p.labels))]
                trees.append(Tree(p.parents, p.labels).written())
                marks.append([h - 2**64 if h >> 63 else h for h in found])
                blocks.append([{"node": n, "text": t} for n, t in p.blocks])
            columns = [batch[c] for c in ("page_id", "url", "host")]
            columns += [pa.array(trees, pa.string()), pa.array(marks, pa.list_(pa.int64())), pa.array(blocks, pa.list_(block))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "tree", "marks", "blocks"])

    source = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), source)
    kind = rows.schema["page_id"].dataType.simpleString()
    found = rows.mapInArrow(of, f"page_id {kind}, url string, host string, tree string, marks array<long>, blocks array<struct<node:int,text:string>>")
    # Trees are few and long; a name of 128 bits stands for each.
    return found.withColumn("name", F.md5("tree"))


def wrappers(trees: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``host, wrapper`` from the distinct ``host, name, tree``: trees are merged in groups, then the groups' wrappers."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Larger trees first, then by name, so that the result does not depend on the order of rows.
        order = sorted(rows["tree"], key=lambda t: (-len(t), t))
        tree = functools.reduce(merged, map(Tree.read, order[1:]), Tree.read(order[0]))
        return pd.DataFrame({"host": [key[0]], "tree": [ordered(tree).written()]})

    salted = trees.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(groups)))
    some = salted.groupBy("host", "salt").applyInPandas(merge, "host string, tree string")
    whole = some.groupBy("host").applyInPandas(merge, "host string, tree string")
    return whole.withColumnRenamed("tree", "wrapper")


def slots(trees: DataFrame, made: DataFrame) -> DataFrame:
    """``host, name, node, slot, path, apart, within`` of every node of every distinct tree."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "name", "node", "slot", "path", "apart", "within"]
        for batch in batches:
            for r in batch.to_pylist():
                tree, wrapper = Tree.read(r["tree"]), Tree.read(r["wrapper"])
                at = matched(wrapper, tree)
                n = len(tree.labels)
                apart, within = roles(tree)
                paths = [xxhash.xxh64_intdigest(p.encode()) for p in tree.paths()]
                columns = [[r["host"]] * n, [r["name"]] * n, list(range(n)), [at.get(i, -1) for i in range(n)], [p - 2**64 if p >> 63 else p for p in paths], apart, within]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    both = trees.join(made, "host").select("host", "name", "tree", "wrapper")
    return both.mapInArrow(of, "host string, name string, node int, slot int, path long, apart boolean, within boolean")


def _variety(texts: DataFrame, *key: str) -> DataFrame:
    """How many pages have a text at ``key``, in how many variants, and how many have the commonest."""
    counts = texts.groupBy(*key, "mark").agg(F.sum("pages").alias("pages"))
    return counts.groupBy(*key).agg(F.sum("pages").alias("n"), F.count("*").alias("variants"), F.max("pages").alias("most"))


def decided(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """``host, name, keep``: for each distinct tree, whether each of its nodes is content."""
    # Copies of a page count once: they say nothing on what varies.
    different = pages.select("host", "name", "marks").distinct()
    texts = different.select("host", "name", F.posexplode("marks").alias("node", "mark")).where("mark <> 0")
    counted = texts.groupBy("host", "name", "node", "mark").agg(F.count("*").alias("pages"))
    placed = store(counted.join(nodes.select("host", "name", "node", "slot", "path"), ["host", "name", "node"]), "slots")
    own = _variety(placed.where("slot >= 0"), "host", "slot")
    everywhere = _variety(placed, "path").select("path", *[F.col(c).alias(f"all_{c}") for c in ("n", "variants", "most")])
    rows = nodes.join(own, ["host", "slot"], "left").join(everywhere, "path", "left")
    local = F.coalesce(F.col("n"), F.lit(0)) >= ENOUGH
    n, variants, most = (F.when(local, F.col(c)).otherwise(F.col(f"all_{c}")) for c in ("n", "variants", "most"))
    template = (n >= ENOUGH) & ((most > SAME * n) | (variants < VARIANTS * n))
    strictly = (n >= ARTICLE_ENOUGH) & (most >= ARTICLE_SAME * n)
    rows = rows.select(
        "host", "name", "node", "within", (~F.col("apart")).alias("open"), F.coalesce(template, F.lit(False)).alias("template"), F.coalesce(strictly, F.lit(False)).alias("strictly")
    )
    # The nodes of one tree meet here, which is no larger than the tree of one page.
    by = rows.groupBy("host", "name").agg(F.sort_array(F.collect_list(F.struct("node", "within", "open", "template", "strictly"))).alias("nodes"))
    has_article = F.exists("nodes", lambda x: x["within"] & x["open"])
    keep = F.when(has_article, F.transform("nodes", lambda x: x["open"] & x["within"] & ~x["strictly"])).otherwise(
        F.transform("nodes", lambda x: x["open"] & ~x["template"])
    )
    # A tree that has nothing but template keeps all that is not apart.
    keep = F.when(F.exists(keep, lambda x: x), keep).otherwise(F.transform("nodes", lambda x: x["open"]))
    return by.select("host", "name", keep.alias("keep"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Character references are decoded, white space within a block becomes one space, blocks are joined in page order by one
    space.  Null and empty pages have an empty text.  A page without a host belongs to the host with the empty name.  Repeated rows each
    get their text, but count as one page for what varies.  Pages without any varying slot keep all that no element or
    class sets apart.  An empty table gives no rows.
    """
    found = store(parsed(pages), "pages")
    trees = store(found.select("host", "name", "tree").distinct(), "trees")
    nodes = store(slots(trees, wrappers(trees)), "nodes")
    keep = store(decided(found, nodes), "keep")
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.get("keep", b["node"])), lambda b: b["text"]), " ")
    done = found.select("page_id", "url", "host", "name", "blocks").join(keep, ["host", "name"])
    return done.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
