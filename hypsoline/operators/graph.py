"""Graph algorithms over edge tables (src, dst): degrees, PageRank, communities, betweenness, neighbourhoods."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import bucketed, cut


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): edges that leave each node, parallel ones counted."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.join(out, "id", "left").fillna(0, ["degree"])


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float = 1e-7, every: int = 3) -> DataFrame:
    """(id, pagerank): (1 - d) + d * what flows in, ranks starting at 1 - d; parallel edges each carry their share.

    Edges are counted by (src, dst) once, and written in buckets of src, so that a round shuffles only ranks by src, and
    shares, summed before, by dst. Every round's ranks are written and its shuffle files removed; every few rounds the loop
    ends if no rank has moved by more than the tolerance.
    """
    pairs = cut(edges.groupBy("src", "dst").agg(F.count("*").alias("n")))
    total = pairs.groupBy("src").agg(F.sum("n").alias("out"))
    links = bucketed(pairs.join(total, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")), "src")
    ids = cut(nodes.select("id").distinct())
    ranks = ids.withColumn("pagerank", F.lit(1 - damping))
    for i in range(rounds):
        flow = links.join(ranks.hint("shuffle_hash"), links.src == ranks.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("flow"))
        new = cut(ids.join(flow, "id", "left").select("id", (F.lit(1 - damping) + damping * F.coalesce("flow", F.lit(0.0))).alias("pagerank")))
        if tolerance and i > 1 and (i + 1) % every == 0:
            moved = new.join(ranks.withColumnRenamed("pagerank", "old"), "id").agg(F.max(F.abs(F.col("pagerank") - F.col("old")))).first()[0]
            if moved is None or moved < tolerance * every:
                return new
        ranks = new
    return ranks


def label_propagation(edges: DataFrame, rounds: int | None = 10) -> DataFrame:
    """(id, community): each node takes the label of most weight among its neighbours and itself, ties to the least.

    Deterministic, all nodes at once; weights count parallel edges. Stops when no label changes, or
    without a number of rounds also when all labels are as after an earlier round, from where they would go in a circle.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    links = cut(both.groupBy("src", "dst").agg(F.count("*").alias("w")))
    labels = cut(links.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct())
    seen = set()
    for _ in itertools.count() if rounds is None else range(rounds):
        votes = links.join(labels, links.dst == labels.id).select(F.col("src").alias("node"), "community", "w")
        votes = votes.unionByName(labels.select(F.col("id").alias("node"), "community", F.lit(1).cast("long").alias("w")))
        tally = votes.groupBy("node", "community").agg(F.sum("w").alias("w"))
        new = cut(tally.groupBy(F.col("node").alias("id")).agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("community")))
        changed = new.join(labels.withColumnRenamed("community", "old"), "id").where("community <> old").limit(1).count()
        labels = new
        if not changed:
            break
        if rounds is None:
            state = labels.agg(F.sum(F.xxhash64("id", "community").cast("decimal(38,0)"))).first()[0]
            if state in seen:
                break
            seen.add(state)
    return labels


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node each node reaches, by repeated minima and pointer jumps."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(labels, both.dst == labels.id).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("low"))
        step = labels.join(near, "id").select("id", F.least("component", "low").alias("component"))
        jump = step.alias("a").join(step.select(F.col("id").alias("at"), F.col("component").alias("next")), F.col("a.component") == F.col("at"), "left")
        new = cut(jump.select("id", F.least("component", F.coalesce("next", "component")).alias("component")))
        same = new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").isEmpty()
        labels = new
        if same:
            return labels


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Newman's modularity of an undirected reading of the edges."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("c1")), labels.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    df = both.join(a, "src").join(b, "dst")
    m2 = df.count()
    inside = df.where("c1 = c2").count()
    spread = df.groupBy("c1").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
    return inside / m2 - spread / (m2 * m2) if m2 else 0.0


def neighbours(links, rows):
    """(many, near): how many neighbours each of the rows has, and these, row by row. links are compressed by node: node v's
    neighbours are near[start[v] : start[v + 1]]."""
    import numpy as np

    start, near = links
    many = start[rows + 1] - start[rows]
    return many, near[np.repeat(start[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())]


def blocks(rows, links, most_rows: int = 4096, most_edges: int = 1 << 18) -> Iterator:
    """rows in runs of at most so many rows and neighbours, one row at least."""
    import numpy as np

    ends, at = np.cumsum(links[0][rows + 1] - links[0][rows]), 0
    while at < len(rows):
        last = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_edges, side="right"))
        to = min(at + most_rows, max(at + 1, last))
        yield rows[at:to]
        at = to


class Sums:
    """Sums over the links (see `neighbours`) of a run of rows, for vectors side by side: a row's neighbours are cut into pieces of
    `piece`, and those of about one length are summed together, a neighbour of each at a time. Holds 4 bytes a link."""

    def __init__(self, rows, links, piece: int = 64, tall: int = 4096):
        import numpy as np

        many, near = neighbours(links, rows)
        self.rows, self.edges, self.near, self.count = np.flatnonzero(many), len(near), np.unique(near), len(rows)
        many = many[self.rows]
        parts = -(-many // piece)
        self.first = np.cumsum(parts) - parts
        size = np.full(parts.sum(), piece)
        size[self.first + parts - 1] = many - (parts - 1) * piece
        start, self.pieces = np.cumsum(size) - size, len(size)
        order = np.lexsort((np.arange(self.pieces) - np.repeat(self.first, parts), -size))  # pieces with near neighbours side by side
        self.runs = []
        for i in range(0, len(order), tall):
            own = order[i : i + tall]
            steps = np.arange(size[own[0]])[:, None]
            lies = steps < size[own]
            live = lies.sum(1)
            self.runs.append((own, live.tolist(), np.split(near[(start[own] + steps)[lies]], np.cumsum(live)[:-1])))

    def __call__(self, x):
        """(row, vector): of each row the sum of its neighbours' rows of x (node, vector)."""
        import numpy as np

        wide = x.shape[1]
        sums = np.empty((self.pieces, wide))
        for own, live, near in self.runs:
            acc, space = x.take(near[0], 0), np.empty((live[0], wide))
            for n, at in zip(live[1:], near[1:], strict=True):
                acc[:n] += x.take(at, 0, out=space[:n], mode="clip")
            sums[own] = acc
        if self.pieces > len(self.rows):
            sums = np.add.reduceat(sums, self.first, axis=0)
        if len(self.rows) == self.count:
            return sums
        out = np.zeros((self.count, wide))
        out[self.rows] = sums
        return out


def shortest_path_shares(sources, times, out, into, n: int, ends=None, wide: int = 4, tall: int = 4096):
    """(rows, shares): Brandes' sums over some distinct sources, for the nodes that another node among them reaches: the
    shares of shortest paths from each source that pass them, times the source's `times`. out and into are the links and
    their reverse (see `neighbours`); `ends`: where runs of nodes that are alike end, which are divided at `tall` rows.

    Takes `wide` sources at once. A level's sums are made of its own links if these are few, else of all links of those runs
    that it can reach. Holds 8 bytes a link, and up to 64 bytes for each node and source at once.
    """
    import numpy as np

    cuts = np.unique(np.concatenate([np.arange(0, n, tall), [n], np.empty(0, np.int64) if ends is None else ends]))
    runs = [[Sums(np.arange(i, j), links) for i, j in itertools.pairwise(cuts)] for links in (out, into)]
    run_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    leads = np.zeros((len(cuts) - 1, len(cuts) - 1), bool)
    for i, run in enumerate(runs[1]):
        leads[run_of[run.near], i] = True
    enter, leave = (np.array([run.edges for run in way], np.int64) for way in (runs[1], runs[0]))
    total, seen, degree = np.zeros(n), np.zeros(n, bool), np.diff(out[0])

    def few(links: int, ways, width: int) -> bool:
        return links * 12 < ways.sum() * width

    def own_links(front, width: int):
        """Of the (node, source) pairs in front: which of them each link leaves, and which pair it enters."""
        many, near = neighbours(out, front // width)
        which = np.repeat(np.arange(len(front)), many)
        return which, near * np.int64(width) + (front % width)[which]

    def met(front, width: int):
        """The runs in which the pairs of front, in order, lie."""
        if len(front) < len(cuts):
            return np.unique(run_of[front // width])
        return np.flatnonzero(np.diff(np.searchsorted(front, cuts * width)))

    for i in range(0, len(sources), wide):
        asked = sources[i : i + wide]
        width = len(asked)
        if not i or width < wide:
            size = n * width
            paths, share, level, x = np.empty(size), np.empty(size), np.empty(size, np.int32), np.zeros((n, width))
            flat, of = x.reshape(-1), [slice(k * width, j * width) for k, j in itertools.pairwise(cuts.tolist())]
        for values in (paths, share, level):
            values.fill(0)
        begin = np.sort(asked * width + np.arange(width))
        paths[begin] = 1.0
        fronts = [begin]
        left = np.array([len(run.rows) * width for run in runs[1]])
        np.subtract.at(left, run_of[asked[np.diff(into[0])[asked] > 0]], 1)
        while len(front := fronts[-1]):
            ways = leads[met(front, width)].any(0) & (left > 0)
            new = [np.empty(0, np.int64)]
            if not ways.any():
                pass
            elif few(degree[front // width].sum(), enter[ways], width):
                which, to = own_links(front, width)
                fresh = paths[to] == 0
                to, which = to[fresh], which[fresh]
                if len(to) * 16 > size:
                    sums = np.bincount(to, paths[front][which], minlength=size)
                    found = np.flatnonzero(sums)
                    sums = sums[found]
                else:
                    found, at = np.unique(to, return_inverse=True)
                    sums = np.bincount(at, paths[front][which], minlength=len(found))
                paths[found], level[found] = sums, len(fronts)
                new.append(found)
                np.subtract.at(left, run_of[found // width], 1)
            else:
                flat[front] = paths[front]
                for k in np.flatnonzero(ways):
                    sums, own = runs[1][k](x).reshape(-1), of[k]
                    fresh = (sums > 0) & (paths[own] == 0)
                    np.copyto(paths[own], sums, where=fresh)
                    np.copyto(level[own], len(fronts), where=fresh)
                    new.append(np.flatnonzero(fresh) + own.start)
                    left[k] -= len(new[-1])
                flat[front] = 0
            fronts.append(np.concatenate(new))
        for at in range(len(fronts) - 2, 1, -1):
            there, front = fronts[at], fronts[at - 1]
            flat[there] = (1 + share[there]) / paths[there]
            parts = met(front, width)
            if few(degree[front // width].sum(), leave[parts], width):
                which, to = own_links(front, width)
                share[front] = paths[front] * np.bincount(which, flat[to], minlength=len(front))
            else:
                for k in parts:
                    sums = runs[0][k](x).reshape(-1)
                    sums *= paths[of[k]]
                    np.copyto(share[of[k]], sums, where=level[of[k]] == at - 1)
            flat[there] = 0
        total += share.reshape(n, width) @ times[i : i + wide]
        paths[begin] = 0
        seen |= paths.reshape(n, width) @ np.ones(width) > 0
    found = np.flatnonzero(seen)
    return found, total[found]


def sides(out, into, n: int, rounds: int = 30):
    """(root, far): of each node the least one of its component, links read both ways, and its distance from there, -1 where it
    is more than so many rounds away. In graphs that take more rounds to join, root is 0 everywhere."""
    import numpy as np

    root, joined = np.arange(n, dtype=np.int32), False
    for _ in range(rounds):
        new = root.copy()
        for start, near in (out, into):
            some = np.flatnonzero(np.diff(start))
            if len(some):
                new[some] = np.minimum(new[some], np.minimum.reduceat(new[near], start[some]))
        new = new[new]
        joined = (new == root).all()
        root = new
        if joined:
            break
    if not joined:
        root = np.zeros(n, np.int32)
    far, front = np.full(n, -1, np.int32), np.flatnonzero(root == np.arange(n))
    far[front] = 0
    for i in range(rounds):
        met = np.zeros(n, bool)
        for links in (out, into):
            for rows in blocks(front, links):
                met[neighbours(links, rows)[1]] = True
        front = np.flatnonzero(met & (far < 0))
        far[front] = i + 1
        if not len(front):
            break
    return root, far


def grouped(sources, out, into, n: int, rounds: int = 30):
    """sources in an order that puts those together whose paths meet the same nodes at the same time: by component, and by the
    parity of the distance from its least node. In graphs that take more rounds, the order is only not as good."""
    import numpy as np

    root, far = sides(out, into, n, rounds)
    return sources[np.lexsort((sources, far[sources] % 2, root[sources]))]


def split_up(out, into, n: int, together: int = 8192) -> Iterator[tuple]:
    """(nodes, out, into, ends) for each component, or several of `together` nodes or less: the nodes, by the parity of their
    distance from the least one, the links between their places in that order, and where the first of two parities ends."""
    import numpy as np

    root, far = sides(out, into, n)
    least, group = np.flatnonzero(root == np.arange(n)), np.zeros(n, np.int64)
    many = np.bincount(root, minlength=n)[least]
    group[least] = (np.cumsum(many) - many) // together
    group = group[root]
    order = np.lexsort((np.arange(n), far % 2, group))
    place = np.empty(n, np.int32)
    starts = np.flatnonzero(np.diff(group[order], prepend=-1)).tolist()
    for at, to in itertools.pairwise([*starts, n]):
        nodes = order[at:to]
        place[nodes] = np.arange(len(nodes), dtype=np.int32)
        links = []
        for way in (out, into):
            many, near = neighbours(way, nodes)
            links.append((np.r_[0, np.cumsum(many)], place[near]))
        yield nodes, *links, np.array([np.count_nonzero(far[nodes] % 2 == 0)])


def numbered(ids: DataFrame) -> DataFrame:
    """ids (id) with `number`, from 0 without gaps."""
    rows = cut(ids.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before, at = [], 0
    for part, n in sorted(tuple(r) for r in rows.groupBy("_part").count().collect()):  # one row a partition
        before += [F.lit(part), F.lit(at)]
        at += n
    first = F.element_at(F.create_map(*before), F.col("_part")) if before else F.lit(0)
    return rows.select("id", (F.col("_at") + first).cast("int").alias("number"))


def alike(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, stands): the edges (src, dst) without all but one of those nodes that no edge enters and that have the same
    neighbours, and (id, one): each such node, and which of them is kept. As no path leads to them, they give all other nodes
    the same shares."""
    entered = pairs.select(F.col("dst").alias("src")).distinct()
    near = cut(pairs.join(entered, "src", "left_anti").groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("near")))
    groups = near.groupBy("near").agg(F.min("src").alias("one"))
    kept = pairs.join(entered, "src", "left_semi").unionByName(groups.select(F.col("one").alias("src"), F.explode("near").alias("dst")))
    return kept, near.join(groups, "near").select(F.col("src").alias("id"), "one")


def packed_rows(edges: DataFrame) -> DataFrame:
    """(src, dst, nodes, many, near): edges between numbers (src, dst) in order, many in a row: node nodes[i]'s neighbours are the next
    many[i] of near, all 4 bytes and deflated; src and dst are those of the row's first edge."""
    import numpy as np
    import pandas as pd

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = batch["dst"].to_numpy(np.int32)
                nodes, many = np.unique(batch["src"].to_numpy(np.int32), return_counts=True)
                bytes_of = [zlib.compress(x.astype(np.int32).tobytes(), 1) for x in (np.diff(nodes, prepend=0), many, np.diff(near, prepend=0))]
                yield pd.DataFrame({"src": nodes[:1], "dst": near[:1], **{k: [v] for k, v in zip(("nodes", "many", "near"), bytes_of, strict=True)}})

    rows = edges.repartitionByRange("src").sortWithinPartitions("src", "dst")
    return rows.mapInPandas(pack, "src int, dst int, nodes binary, many binary, near binary")


def unpacked(row):
    """(nodes, many, near) of a row of `packed_rows`."""
    import numpy as np

    nodes, many, near = (np.frombuffer(zlib.decompress(x), np.int32) for x in (row.nodes, row.many, row.near))
    return np.cumsum(nodes, dtype=np.int32), many, np.cumsum(near, dtype=np.int32)


def packed(edges: DataFrame, most_edges: int):
    """(nodes, many, near) of all edges between numbers (src, dst), in the driver: it receives them packed, and holds 4 bytes an
    edge and 8 a node. For graphs that fit there; `betweenness` sends no edges to the driver."""
    import numpy as np

    edges = cut(edges)
    n = edges.count()
    if n > most_edges:
        raise ValueError(f"more than {most_edges} edges")
    nodes, many, near, at = [np.empty(0, np.int32)], [np.empty(0, np.int32)], np.empty(n, np.int32), 0
    for r in packed_rows(edges).toLocalIterator():
        own = unpacked(r)
        near[at : at + len(own[2])], at = own[2], at + len(own[2])
        nodes.append(own[0])
        many.append(own[1])
    return np.concatenate(nodes), np.concatenate(many), near


def betweenness(edges: DataFrame, sources: DataFrame, most_edges: int | None = None, batch_bytes: int = 192_000_000) -> DataFrame:
    """(id, betweenness): Brandes' sums over the given sources (all nodes: exact), directed and unweighted, for nodes that a
    source reaches. Sources that no edge enters and that have the same neighbours are worked out once and counted.

    No edge reaches the driver. Every task is sent the edges, packed, and some sources, of which it takes as many at once as
    `batch_bytes` hold (4, more in small graphs), component by component; it holds 8 bytes an edge beside, and while it works on a
    component, 16 bytes for each of its edges. More distinct edges than `most_edges` (without those sources) are refused, if it is given.
    """
    import numpy as np
    import pandas as pd

    pairs = cut(edges.select("src", "dst").where("src <> dst").distinct())
    kept, stands = alike(pairs)
    kept = cut(kept)
    ids = numbered(kept.select(F.col("src").alias("id")).unionByName(kept.select("dst").toDF("id")).distinct())
    ends = [ids.select(F.col("id").alias(c), F.col("number").alias(f"_{c}")) for c in ("src", "dst")]
    links = cut(kept.join(ends[0], "src").join(ends[1], "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    n, n_edges, tasks = ids.count(), links.count(), edges.sparkSession.sparkContext.defaultParallelism
    if most_edges is not None and n_edges > most_edges:
        raise ValueError(f"more than {most_edges} edges")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, near, filled = np.zeros((2, n + 1), np.int64), np.empty((2, n_edges), np.int32), [0, 0]
        asked, times = [np.empty(0, np.int64)], np.zeros(n)
        for batch in batches:
            some = batch[batch["kind"] == 2]
            asked.append(some["src"].to_numpy(np.int64))
            times[asked[-1]] = some["times"]
            for r in batch[batch["kind"] < 2].itertuples():
                nodes, many, own = unpacked(r)
                start[r.kind, nodes + 1] += many
                near[r.kind, filled[r.kind] : filled[r.kind] + len(own)] = own
                filled[r.kind] += len(own)
        out, into = ((np.cumsum(start[i]), near[i]) for i in range(2))
        asked = np.concatenate(asked)
        asked = asked[np.diff(out[0])[asked] > 0]  # the others reach nothing
        total, seen = np.zeros(n), np.zeros(n, bool)
        wanted = np.zeros(n, bool)
        wanted[asked] = True
        for nodes, *links, ends in split_up(out, into, n) if len(asked) else ():
            own = np.flatnonzero(wanted[nodes])
            if len(own):
                wide = max(1, min(64, max(4, 65536 // len(nodes)), batch_bytes // (64 * len(nodes))))
                rows, shares = shortest_path_shares(own, times[nodes[own]], *links, len(nodes), ends, wide)
                total[nodes[rows]] += shares
                seen[nodes[rows]] = True
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"number": found.astype(np.int32), "part": total[found]})

    kind = sources.schema["id"].dataType
    asked = sources.select("id").distinct().join(stands, "id", "left").groupBy(F.coalesce("one", "id").alias("id")).agg(F.count("*").alias("times"))
    asked = asked.join(ids, "id").select((F.col("number") % tasks).alias("task"), F.lit(2).alias("kind"), F.col("number").alias("src"), "times")
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    ways = [packed_rows(x).select(every, F.lit(i).alias("kind"), "*") for i, x in enumerate((links, links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))]
    dealt = ways[0].unionByName(ways[1]).unionByName(asked, allowMissingColumns=True).repartitionById(tasks, F.col("task"))
    parts = dealt.sortWithinPartitions("kind", "src", "dst").mapInPandas(run, "number int, part double").groupBy("number").agg(F.sum("part").alias("betweenness"))
    return parts.join(ids, "number").select(F.col("id").cast(kind).alias("id"), "betweenness")


def neighbourhood(edges: DataFrame, node) -> DataFrame:
    """Edges of one node in both directions, with the way each goes."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("way"), F.col("src").alias("node"), F.col("dst").alias("other"), "relation_type")
    into = edges.where(F.col("dst") == node).select(F.lit("in").alias("way"), F.col("dst").alias("node"), F.col("src").alias("other"), "relation_type")
    return out.unionByName(into)


#: Colours of node groups.
COLOURS = {"Technology": "#4e79a7", "Company": "#f28e2b", "Document": "#76b7b2", "Community": "#e15759"}


def colour(label: Column) -> Column:
    out = F.lit("#bab0ac")
    for k, v in COLOURS.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def clean_properties(props: Column) -> Column:
    """A map without embeddings and search texts."""
    return F.map_filter(props, lambda k, v: ~(k.contains("embedding") | k.contains("search_corpus")))


def tooltip(props: list[tuple[str, Column]]) -> Column:
    """The first five properties that are not null, each of at most fifty characters."""
    text = lambda c: F.when(F.length(c) > 50, F.concat(F.substring(c, 1, 50), F.lit("..."))).otherwise(c)
    lines = F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), text(c.cast("string")))) for k, c in props]))
    return F.array_join(F.slice(lines, 1, 5), "\n")
