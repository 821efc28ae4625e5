"""SimHash near-duplicates, found exactly with a vantage-point tree over the fingerprints.

1. Every text gives a 64-bit fingerprint of its word shingles; equal fingerprints collapse to one.
2. A vantage-point tree is built from a bounded sample of the fingerprints (``tree_sample``). It only
   decides where a fingerprint goes, so the sample affects balance and not the result. A
   fingerprint's home is one leaf; where it lies inside a boundary, so near to it that the triangle
   inequality cannot exclude a partner outside, it also visits the outside as a query. Those outside
   do not visit the inside, as a pair need meet only once; a query goes wherever a partner can be.
   A leaf of more than ``dense`` squared comparisons is divided by a tree of its own points, and so on.
3. Each leaf compares its home fingerprints with each other and with its visitors, and keeps a
   spanning star of what is linked. Only a leaf that no tree divides, as its points are a ball of very
   many near copies, is not compared pairwise: each member emits itself and its neighbours at distance
   one, and two members within two bits share one of those, in groups of at most 65 fingerprints.
4. Connected components of the links come from rounds of large-star and small-star, each round
   written to the shared folder. Neither links nor fingerprints reach the driver.

Nulls and edge cases: a text without words, empty or null, has fingerprint zero, linked like any
other; fewer words than a shingle make one shingle; null doc_ids take part but are never the
smallest id unless a component has no other; repeated rows give repeated rows; an empty table
gives no rows; only the two named columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import drop_scratch, freed, freed_group, row_of, scratch, table, with_row

SEED = 42
ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of one text: A-Z lowered, ASCII white space between words, XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        hashes = [xxh64_intdigest(line, SEED)]
    else:
        starts, at = [0] * n, 0
        for k, w in enumerate(words):
            starts[k] = at
            at += len(w) + 1
        stops = [s - 1 for s in starts[shingle:]] + [len(line)]
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=False)]
    n = len(hashes)
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(n, 64)
    count = np.zeros(64, np.int64)
    for k in range(0, n, 255):  # byte counters hold 255 at most
        count += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every document; with ``keep``, also a struct
    ``row`` of these columns."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text")
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            rest = [batch.column("row")] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), *rest], ["doc_id", "fp"] + ["row"] * len(rest))

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row_of(docs, keep))
    return cols.mapInArrow(freed(run), with_row("doc_id long, fp long", docs, keep))


# -- vantage-point tree -----------------------------------------------------


def build_tree(points: np.ndarray, leaves: int, bits: int, tries: int = 12) -> list[tuple]:
    """Nodes (vantage point, radius, inside, outside); a child below zero is leaf -child - 1.

    A part of over one and a half times its share of the points, one of ``leaves``, is divided. Of several
    vantage points and radii near the median, a node takes the one with the fewest
    points within ``bits`` of its boundary; where these are over three fifths of all, a division would
    double the points and spare few comparisons, and there is none. Node 0 is the root; no nodes mean
    one leaf."""
    rng = np.random.default_rng(7)
    nodes: list[tuple] = []
    count = 0

    def split(own: np.ndarray) -> int:
        nonlocal count
        best = None
        if 2 * leaves * len(own) > 3 * len(points) and len(own) >= 8:
            for vp in rng.choice(own, tries):
                d = np.bitwise_count(own ^ vp).astype(np.int64)
                for mu in {int(np.quantile(d, q)) for q in (0.4, 0.5, 0.6)}:
                    inside = int((d <= mu).sum())
                    if min(inside, len(own) - inside) * 4 >= len(own):
                        cost = int(((d > mu - bits) & (d <= mu + bits)).sum())
                        if best is None or cost < best[0]:
                            best = cost, vp, mu
        if best is None or best[0] * 5 > 3 * len(own):
            count += 1
            return -count
        at = len(nodes)
        nodes.append(())
        _, vp, mu = best
        d = np.bitwise_count(own ^ vp)
        nodes[at] = (np.uint64(vp), mu, split(own[d <= mu]), split(own[d > mu]))
        return at

    split(points)
    return nodes


def assign(nodes: list[tuple], points: np.ndarray, bits: int, home: np.ndarray | None = None):
    """(index, leaf, whether home) of every leaf that each point must reach; ``home`` tells which points
    are not visitors already. Two points within ``bits``, of which one at least is home, meet in a leaf that
    is the home of one of them."""
    out_i, out_leaf, out_home = [], [], []
    every = np.arange(len(points))
    stack = [(0 if nodes else -1, every, np.ones(len(points), bool) if home is None else home)]
    while stack:
        node, idx, home = stack.pop()
        if not len(idx):
            continue
        if node < 0:
            out_i.append(idx)
            out_leaf.append(np.full(len(idx), -node - 1))
            out_home.append(home)
            continue
        vp, mu, inside, outside = nodes[node]
        d = np.bitwise_count(points[idx] ^ vp).astype(np.int64)
        near = d <= mu
        into = (home & near) | (~home & (d - bits <= mu))
        stack.append((inside, idx[into], home[into]))
        over = d + bits > mu
        stack.append((outside, idx[over], (home & ~near)[over]))
    return np.concatenate(out_i), np.concatenate(out_leaf), np.concatenate(out_home)


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of n points that each is linked to by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (label[a], label[b], a, b):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def stars(points: np.ndarray, home: np.ndarray, bits: int, cells: int = 1 << 20):
    """(member, root) index pairs that span what is linked among the points of a leaf; two
    visitors are not compared. Pairs are folded into one link a point, ``cells`` comparisons at a time."""
    own = np.flatnonzero(home)
    n = len(points)
    label = np.arange(n)
    block = max(1, cells // max(1, len(own)))
    for k in range(0, n, block):
        close = np.bitwise_count(points[k : k + block, None] ^ points[None, own]) <= bits
        a, b = np.nonzero(close)
        a, b = a + k, own[b]
        keep = label[a] != label[b]
        if keep.any():
            linked = np.flatnonzero(label != np.arange(n))
            label = joined(np.concatenate([a[keep], linked]), np.concatenate([b[keep], label[linked]]), n)
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


# -- components -------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (a, b) with b the least node of a's component, for every node a but the least ones.

    ``edges`` has long columns a and b without nulls. Large-star and small-star in turn; each
    aggregates before it shuffles, and joins back on a node, which adaptive execution splits."""
    now = scratch(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "links")
    stamp = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.join(low, "a").filter("b > a").selectExpr("b a", "m b").filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.selectExpr("b a", "m b").union(small.selectExpr("a", "m b")).filter("a <> b").distinct()
        new = scratch(small, "links")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_scratch(now)
        now = new
        if mark == stamp:
            return now
        stamp = mark
    raise RuntimeError("components did not settle")


def _dealt(rows: DataFrame, trees: dict[int, list[tuple]], first: int, bits: int) -> DataFrame:
    """Rows (leaf, fp, home) of leaves that have a tree, dealt to the leaves of these trees, which
    are numbered from ``first`` on."""
    base = dict(zip(trees, np.cumsum([first, *[len(x) + 1 for x in trees.values()]]).tolist(), strict=False))
    sent = rows.sparkSession.sparkContext.broadcast((trees, base))

    def run(batches):
        import pyarrow as pa

        trees, base = sent.value
        for batch in batches:
            own, points = np.asarray(batch.column("leaf")), np.asarray(batch.column("fp")).view(np.uint64)
            home = np.asarray(batch.column("home").cast(pa.int8())).astype(bool)
            for leaf in np.unique(own).tolist():
                part = np.flatnonzero(own == leaf)
                i, sub, at_home = assign(trees[leaf], points[part], bits, home[part])
                yield pa.RecordBatch.from_arrays([pa.array(sub.astype(np.int64) + base[leaf]), pa.array(points[part][i].view(np.int64)), pa.array(at_home)], ["leaf", "fp", "home"])

    return rows.mapInArrow(freed(run), "leaf long, fp long, home boolean")


def leaves(distinct: DataFrame, bits: int, leaf_points: int, tree_sample: int, dense: int, at_once: int = 256) -> tuple[list, list, list]:
    """(tables of leaf, fp and home whose leaves are to be compared, tables of leaves that no tree divides,
    the scratch tables that both read).

    The first tree comes from a sample of all fingerprints. A leaf whose homes and rows make more than
    ``dense`` squared comparisons gets a tree of a sample of its own homes, and so on, ``at_once`` leaves at a
    time, each with its share of ``tree_sample`` points. Each node leaves a quarter of the sample on either
    side, so this ends. Not divided is a leaf whose tree has no node: a ball of points within a few bits."""
    todo = [(distinct.select(F.lit(0).cast("long").alias("leaf"), "fp", F.lit(True).alias("home")), {0: distinct.count()})]
    done, balls, made, first, buckets, root = [], [], [], 1, 1 << 30, True
    while todo:
        rows, sizes = todo.pop()
        n = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("leaf")]
        share = max(32, tree_sample // len(sizes))
        drawn = rows.filter("home").filter(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(buckets)) * n.cast("double") < float(share * buckets))
        found = drawn.select("leaf", "fp").distinct().limit(2 * tree_sample).toPandas().groupby("leaf")["fp"]
        sample = {k: np.sort(v.to_numpy(np.int64)).view(np.uint64) for k, v in found}
        none = np.zeros(0, np.uint64)
        trees = {k: build_tree(sample.get(k, none), max(1 if root else 2, count // leaf_points), bits) for k, count in sizes.items()}
        whole = [k for k, count in sizes.items() if not trees[k] and (not root or count > dense)]
        root = False
        if whole:
            balls.append(rows.filter(F.col("leaf").isin(whole)))
            trees = {k: x for k, x in trees.items() if k not in whole}
        if trees:
            placed = scratch(_dealt(rows.filter(F.col("leaf").isin(list(trees))), trees, first, bits), "leaves")
            made.append(placed)
            first += sum(len(x) + 1 for x in trees.values())
            counts = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
            over = [(r.leaf, r.homes) for r in counts.filter(F.col("n") * F.col("homes") > dense * dense).collect()]
            done.append(placed.filter(~F.col("leaf").isin([k for k, _ in over])) if over else placed)
            for a in range(0, len(over), at_once):
                part = dict(over[a : a + at_once])
                todo.append((placed.filter(F.col("leaf").isin(list(part))), part))
    return done, balls, made


def near_groups(fps: DataFrame, bits: int = 2, leaf_points: int = 4000, tree_sample: int = 65_536,
                dense: int = 40_000) -> DataFrame:
    """fp and component_id (least doc_id reachable) for every distinct fingerprint of ``fps``
    (doc_id, fp). ``bits`` may be 2 at most if leaves that no tree divides are to stay exact."""
    if bits > 2:
        raise ValueError("balls of points are exact for two bits at most")
    distinct = scratch(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    done, balls, made = leaves(distinct, bits, leaf_points, tree_sample, dense)

    def compare(group):
        import pyarrow as pa

        points = np.asarray(group.column("fp").combine_chunks()).view(np.uint64)
        home = np.asarray(group.column("home").combine_chunks().cast(pa.int8())).astype(bool)
        order = np.argsort(points, kind="stable")
        points, home = points[order], home[order]
        a, b = stars(points, home, bits)
        return pa.table({"a": points[a].view(np.int64), "b": points[b].view(np.int64)})

    def neighbours(batches):
        import pyarrow as pa

        masks = np.concatenate([[np.uint64(0)], ONE << np.arange(64, dtype=np.uint64)])
        for batch in batches:
            points = np.asarray(batch.column("fp")).view(np.uint64)
            for k in range(0, len(points), 10_000):
                part = points[k : k + 10_000]
                near = (part[:, None] ^ masks).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(np.repeat(part, 65).view(np.int64))], ["near", "fp"])

    links = [reduce(DataFrame.union, done).groupBy("leaf").applyInArrow(freed_group(compare), "a long, b long")] if done else []
    if balls:
        around = reduce(DataFrame.union, balls).select("fp").distinct().mapInArrow(freed(neighbours), "near long, fp long")
        around = around.groupBy("near").agg(F.collect_set("fp").alias("fps"), F.min("fp").alias("b")).filter(F.size("fps") > 1)
        links.append(around.select(F.explode("fps").alias("a"), "b"))
    roots = components(reduce(DataFrame.union, links))
    rooted = distinct.join(roots.withColumnsRenamed({"a": "fp", "b": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = scratch(rooted, "roots")
    drop_scratch(distinct, roots, *made)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2,
                    **tree) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every document."""
    fps = scratch(fingerprints(docs, id_col, text_col, shingle), "simhash")
    groups = near_groups(fps, bits, **tree)
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, **tree) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: of each group the one with the least id stays
    (a null id only where there is no other; one row of several with that id)."""
    rows = fingerprints(docs, id_col, text_col, shingle, tuple(docs.columns))
    rows = scratch(rows.withColumn("place", F.monotonically_increasing_id()), "rows")
    groups = near_groups(rows.select("doc_id", "fp"), bits, **tree)
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("place")))
    of_fp = rows.groupBy("fp").agg(best.alias("best"))  # one row a fingerprint before the groups meet
    stay = of_fp.join(groups, "fp").groupBy("component_id").agg(F.min("best").alias("best")).select(F.col("best.place").alias("place"))
    return rows.join(stay, "place", "left_semi").select("row.*")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
