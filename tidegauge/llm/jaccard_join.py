"""Exact Jaccard self-join of word shingles by prefix trees.

1. Every text becomes its set of shingle hashes; equal sets are one class (a digest of the set names it), so copies are never paired.
2. Shingles get one global order, by the power of two of the number of sets that hold them and then by hash. Sets alike enough share one of their first
   shingles in that order. To learn the numbers, shingles are dealt out by hash in packed pages; only those of two sets or more come back. Each of
   the first shingles links its classes to one of them (a star, not all pairs); the connected parts of these links are candidate groups.
3. In a group the sets are stored in a trie, commonest shingles first, so that sets share the beginnings of their paths. A probe walks the trie from
   the root: the overlap with a path's beginning is counted once for all sets below, and a subtree is left as soon as what remains of the probe and of
   its longest set cannot reach the wanted overlap.
4. Large groups are split into blocks, and every pair of blocks is a task of its own: all pairs of a group are compared once. What leaves a task is, for
   each class, how many documents it is linked with there and one link that unites it with what it is connected with; never the pairs.

A null or empty text has the empty set and is linked with nothing; null ids belong to the smallest other id of their component (null if there is none);
repeated rows are returned as often as they come; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import batches as B
from tidegauge.session import settle

WORDS = 5
#: Wanted likeness in hundredths: 100 * overlap >= PERCENT * union.
PERCENT = 80
#: Shingles that are counted together (about 40 bytes each in a task).
BUCKET = 1 << 21
#: A block holds at most so many sets and about so many characters.
BLOCK_SETS = 1024
BLOCK_CHARS = 16 << 20
#: A list of group members of at most so many rows (24 bytes each) is broadcast; a longer one is joined in a shuffle.
BROADCAST_ROWS = 1 << 20
#: Probes that walk a trie together.
PROBES = 64


def shingles(offsets, data, first: int, last: int, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row counted from ``first``, hash), distinct and sorted within each row. A text of fewer than ``k`` words is one shingle."""
    rows, words = B.words(offsets, data, first, last, B.NON_SPACE)
    counts = B.per_row(rows, last - first)
    begins = np.cumsum(counts) - counts
    hashes, whole = B.grams(rows, words, k)
    of, found = [rows[: len(hashes)][whole]], [hashes[whole]]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            runs, _ = B.grams(rows, words, m)
            of.append(short)
            found.append(B.mix(runs[begins[short]] + B.U(m)))
    row, value = np.concatenate(of), np.concatenate(found)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _digests(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and digest of each row's set; the digest does not depend on an order."""
    sizes = np.bincount(row, minlength=n)
    digest = np.zeros(n, B.U)
    some = np.flatnonzero(sizes)
    if len(some):
        digest[some] = np.add.reduceat(B.mix(value + B.U(0x632BE59BD9B4E019)), (np.cumsum(sizes) - sizes)[some])
    return sizes.astype(np.int64), B.signed(B.mix(digest + sizes.astype(B.U)))


def _describe(k: int):
    """(key, class, n) of every row: digest and size of its set."""

    def work(batch: pa.RecordBatch):
        offsets, data = B.texts(batch.column(1))
        for first, last in B.groups(offsets):
            n = last - first
            sizes, digest = _digests(*shingles(offsets, data, first, last, k), n)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(digest), pa.array(sizes)], ["key", "class", "n"])

    return work


def _pages(k: int, buckets: int):
    """Pages of (bucket, classes, sizes, how many shingles of each class are in the bucket, 32 bits of each of these)."""

    def work(batch: pa.RecordBatch):
        offsets, data = B.texts(batch.column(0))
        for first, last in B.groups(offsets):
            row, value = shingles(offsets, data, first, last, k)
            sizes, digest = _digests(row, value, last - first)
            _, once = np.unique(digest, return_index=True)  # copies within a page need no second entry
            alone = np.zeros(len(sizes), bool)
            alone[once] = True
            # a set of one shingle is only like itself
            keep = (alone & (sizes > 1))[row]
            row, value = row[keep], value[keep]
            bucket = (value % B.U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            row, value, bucket = row[order], value[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            out: list[list] = [[], [], [], [], []]
            for at in np.flatnonzero(np.diff(cuts)):
                low, high = cuts[at], cuts[at + 1]
                members, times = np.unique(row[low:high], return_counts=True)
                short = (value[low:high] >> B.U(32)).astype(np.uint32)
                for column, x in zip(out, (int(at), digest[members].tobytes(), sizes[members].astype(np.int32).tobytes(), times.astype(np.int32).tobytes(), short.tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "classes", "sizes", "times", "shingles"])

    return work


def _held_by_several(batches):
    """Over pages sorted by bucket: (class, n, power, shingle) of every shingle that two classes or more hold."""

    def count(bucket: int, pages: list[tuple]):
        classes = np.concatenate([np.frombuffer(p[0], np.int64) for p in pages])
        sizes = np.concatenate([np.frombuffer(p[1], np.int32) for p in pages])
        of = np.repeat(np.arange(len(classes)), np.concatenate([np.frombuffer(p[2], np.int32) for p in pages]))
        short = np.concatenate([np.frombuffer(p[3], np.uint32) for p in pages])
        order = np.argsort(short, kind="stable")
        short, of = short[order], of[order]
        # what stands alone is most of it
        same = short[1:] == short[:-1]
        several = np.zeros(len(short), bool)
        several[1:] |= same
        several[:-1] |= same
        short, of = short[several], of[several]
        order = np.lexsort((classes[of], short))
        short, of = short[order], of[order]
        new = np.ones(len(short), bool)
        new[1:] = (short[1:] != short[:-1]) | (classes[of[1:]] != classes[of[:-1]])
        short, of = short[new], of[new]
        _, where, held = np.unique(short, return_inverse=True, return_counts=True)
        held = held[where]
        short, of, held = short[held > 1], of[held > 1], held[held > 1]
        name = (short.astype(np.int64) << 24) ^ bucket
        power = np.log2(held).astype(np.int32)
        for at in range(0, len(short), 1 << 17):
            part = slice(at, at + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(classes[of[part]]), pa.array(sizes[of[part]].astype(np.int64)), pa.array(power[part]), pa.array(name[part])], ["class", "n", "power", "shingle"])

    current, pages = None, []
    for batch in batches:
        for bucket, *page in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != current:
                if pages:
                    yield from count(current, pages)
                current, pages = bucket, []
            pages.append(page)
    if pages:
        yield from count(current, pages)


def _first_shingles(texts: DataFrame, k: int, percent: int, total: int, bucket: int) -> DataFrame:
    """(class, shingle): the first shingles of every set in the global order that another set holds too."""
    buckets = min(total // bucket + 1, 1 << 24)
    pages = B.over_text(texts.select("text"), "text", "bucket int, classes binary, sizes binary, times binary, shingles binary", _pages(k, buckets))
    several = pages.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_held_by_several, "class long, n long, power int, shingle long")
    held = several.groupBy("class").agg(F.max("n").alias("n"), F.count("*").alias("several"), F.collect_list(F.struct("power", "shingle")).alias("order"))
    # those that no other set holds come first; the rest fill what is left of the beginning
    wanted = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("several"))
    return held.where(wanted > 0).select("class", F.explode(F.slice(F.array_sort("order"), F.lit(1), wanted.cast("int"))).alias("entry")).select("class", F.col("entry.shingle").alias("shingle"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that is connected, for every node of the undirected edges (a, b). Each round halves paths at least."""
    links = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # every larger neighbour moves to the smallest neighbour
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # then every neighbour that is not larger does, and the node itself
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a")
        small = settle(moved.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        # done when every node has one edge and every edge ends in a root
        rows = small.agg(F.count("*").alias("n")).head()["n"]
        nodes = small.select("a").distinct().count()
        ends = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        links = small
        if nodes == rows and not ends:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Trie:
    """Sets of numbers, each sorted, as a path-compressed trie in arrays."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()), np.int64)
        paths = [sets[i] for i in self.order]
        self.sizes = sizes[self.order]
        n = len(paths)
        shared = [0] * (n + 1)
        for i in range(1, n):
            a, b = paths[i - 1], paths[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[i] = int(differ[0]) if len(differ) else m
        # an edge is the part of a path between two branchings; sets first … last-1 lie below it
        edges: list[tuple[int, int, int, int, int]] = []  # parent, set, from depth, to depth, first set
        ends: list[int] = []
        stack: list[tuple[int, int]] = []  # edge, depth where it ends
        for i in range(n):
            while stack and stack[-1][1] > shared[i]:
                edge, depth = stack.pop()
                top = stack[-1][1] if stack else 0
                if top < shared[i]:  # the edge is cut in two at the branching
                    parent, of, low, high, begin = edges[edge]
                    edges.append((parent, of, low, shared[i], begin))
                    ends.append(i)
                    upper = len(edges) - 1
                    edges[edge] = (upper, of, shared[i], high, begin)
                    ends[edge] = i
                    stack.append((upper, shared[i]))
                    break
                ends[edge] = i
            low = stack[-1][1] if stack else 0
            edges.append((stack[-1][0] if stack else -1, i, low, len(paths[i]), i))
            ends.append(n)
            stack.append((len(edges) - 1, len(paths[i])))
        while stack:
            ends[stack.pop()[0]] = n
        parent = np.array([e[0] for e in edges])
        self.first, self.last = np.array([e[4] for e in edges]), np.array(ends)
        self.low, self.high = np.array([e[2] for e in edges]), np.array([e[3] for e in edges])
        begins = np.cumsum([0] + [len(p) for p in paths])
        self.tokens = np.concatenate(paths) if n else np.zeros(0, np.int64)
        self.at = begins[[e[1] for e in edges]] + self.low
        lengths = np.array([len(p) for p in paths])
        self.deepest = np.array([lengths[f:l].max() for f, l in zip(self.first, self.last)])
        self.least = np.array([self.sizes[f:l].min() for f, l in zip(self.first, self.last)])
        self.most = np.array([self.sizes[f:l].max() for f, l in zip(self.first, self.last)])
        # a set ends where its path is as deep as the edge
        # (that of an equal path above, not of the empty edge below it)
        ending = [np.flatnonzero(lengths[f:l] == h if h > low or p < 0 else []) + f for f, l, h, low, p in zip(self.first, self.last, self.high, self.low, parent)]
        self.end_at = np.cumsum([0] + [len(e) for e in ending])
        self.ending = np.concatenate(ending).astype(np.int64)
        by_parent = np.argsort(parent, kind="stable")
        self.children, self.child_at = by_parent, np.searchsorted(parent[by_parent], np.arange(-1, len(edges) + 1))

    def _below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of the nodes (-1: the root's), and which node each belongs to."""
        low, high = self.child_at[nodes + 1], self.child_at[nodes + 2]
        times = high - low
        owner = np.repeat(np.arange(len(nodes)), times)
        return self.children[np.repeat(low, times) + np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)], owner

    def alike(self, marked: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe, set as given) of all pairs alike enough. Probes are walked together, level by level.

        ``marked`` tells the numbers of each probe (a row each), ``sizes`` their whole sizes, ``wanted`` the sets that each looks for.
        """
        left = np.zeros((len(sizes), len(self.order) + 1), np.int32)
        np.cumsum(wanted[:, self.order], axis=1, out=left[:, 1:])
        upto = np.zeros((len(sizes), marked.shape[1] + 1), np.int32)
        np.cumsum(marked, axis=1, out=upto[:, 1:])
        roots, _ = self._below(np.array([-1]))
        probe, nodes = np.repeat(np.arange(len(sizes)), len(roots)), np.tile(roots, len(sizes))
        over = np.zeros(len(nodes), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        both = 100 + percent
        while len(nodes):
            # by sizes alone, and where nothing is wanted
            size = sizes[probe]
            fits = (100 * self.most[nodes] >= percent * size) & (100 * size >= percent * self.least[nodes]) & (left[probe, self.last[nodes]] > left[probe, self.first[nodes]])
            probe, nodes, over, size = probe[fits], nodes[fits], over[fits], size[fits]
            if not len(nodes):
                break
            length = self.high[nodes] - self.low[nodes]
            starts = np.cumsum(length) - length
            place = np.repeat(self.at[nodes] - starts, length) + np.arange(int(length.sum()))
            hit = np.concatenate([[0], np.cumsum(marked[np.repeat(probe, length), self.tokens[place]])])
            over = over + hit[starts + length] - hit[starts]
            ends_at, times = self.end_at[nodes], self.end_at[nodes + 1] - self.end_at[nodes]
            times = np.where(both * over >= percent * (size + self.least[nodes]), times, 0)
            of = np.repeat(np.arange(len(nodes)), times)
            ends = self.ending[np.repeat(ends_at - (np.cumsum(times) - times), times) + np.arange(len(of))]
            good = (both * over[of] >= percent * (size[of] + self.sizes[ends])) & wanted[probe[of], self.order[ends]]
            found.append((probe[of][good], self.order[ends[good]]))
            # what may still be found below: numbers of the probe after the path's last, and of the longest path
            after = np.where(length > 0, self.tokens[np.minimum(self.at[nodes] + length - 1, max(len(self.tokens) - 1, 0))] + 1, 0)
            rest = upto[probe, -1] - upto[probe, after]
            reach = over + np.minimum(rest, self.deepest[nodes] - self.high[nodes])
            # overlap o is enough if 100 o >= percent (a + b - o)
            alive = both * reach >= percent * (size + self.least[nodes])
            nodes, owner = self._below(nodes[alive])
            probe, over = probe[alive][owner], over[alive][owner]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f for f, _ in found]), np.concatenate([g for _, g in found])


def links_within(sets: list[np.ndarray], native: list[bool] | np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs alike enough: of native sets with each other if all are native, else of every other set with the native ones."""
    none = np.zeros(0, np.int64)
    native = np.asarray(native, bool)
    home = np.flatnonzero(native)
    inside = len(home) == len(sets)
    turns = home if inside else np.flatnonzero(~native)
    if not len(home) or not len(turns):
        return none, none
    whole = np.concatenate(sets)
    _, where, times = np.unique(whole, return_inverse=True, return_counts=True)
    number = np.empty(len(times), np.int64)
    number[np.argsort(-times, kind="stable")] = np.arange(len(times))
    ends = np.cumsum([len(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    shared = times > 1  # what one set alone holds only counts in its size
    numbered = [np.sort(number[w[shared[w]]]) for w in np.split(where, ends[:-1])]
    trie = Trie([numbered[i] for i in home], sizes[home])
    turns = turns[[len(numbered[i]) > 0 for i in turns]]
    out: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
    for at in range(0, len(turns), PROBES):
        now = turns[at : at + PROBES]
        marked = np.zeros((len(now), len(times) + 1), bool)
        for row, i in enumerate(now):
            marked[row, numbered[i]] = True
        # each pair is looked for once
        wanted = home[None, :] > now[:, None] if inside else np.ones((len(now), len(home)), bool)
        row, j = trie.alike(marked, sizes[now], wanted, percent)
        out.append((now[row], home[j]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places is connected with."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            break
    return root


def _link_blocks(k: int, percent: int):
    """Over rows sorted by pair of blocks: (class, links), the documents that each class is linked with, and (class, hub), enough links to unite what is linked."""

    def block(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        keys = table["class"].to_pylist()
        seen: dict = {}
        for i, key in enumerate(keys):
            seen.setdefault(key, i)
        table = table.take(pa.array(sorted(seen.values())))
        if table.num_rows < 2:
            return
        offsets, data = B.texts(table["text"])
        sets: list[np.ndarray] = []
        for first, last in B.groups(offsets):
            row, value = shingles(offsets, data, first, last, k)
            sets += np.split(value, np.searchsorted(row, np.arange(1, last - first)))
        i, j = links_within(sets, table["native"].to_numpy(), percent)
        if not len(i):
            return
        n, size = table.num_rows, table["size"].to_numpy()
        links = np.zeros(n, np.int64)
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        keys, root, some = table["class"].to_numpy(), _roots(n, i, j), np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(keys[root[some]]), pa.array(links[some])], ["class", "hub", "links"])

    def run(batches):
        held, current = [], None
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "block", "other")])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), names.shape[1]]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if tuple(names[:, low]) != current:
                    if held:
                        yield from block(held)
                    held, current = [], tuple(names[:, low])
                held.append(batch.slice(low, high - low))
        if held:
            yield from block(held)

    return run


def _links(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(class, hub, links) of (group, block, other, class, size, native, text): pairs of blocks, or a block with itself."""
    dealt = rows.select("group", "block", "other", "class", "size", "native", "text").repartition("group", "block", "other").sortWithinPartitions("group", "block", "other", "class")
    return dealt.mapInArrow(_link_blocks(k, percent), "class long, hub long, links long")


def _members(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """One text of every class of ``groups`` (key, class, …)."""
    n = groups.count()
    # rows are told apart by id and text, as ids may be null or stand for several texts
    own = F.col("t.key.id").eqNullSafe(F.col("g.key.id")) & (F.col("t.key.h") == F.col("g.key.h"))
    found = settle(texts.alias("t").join((F.broadcast(groups) if n <= BROADCAST_ROWS else groups).alias("g"), own).select("g.*", "t.text").where(F.col("text") != ""))
    # rows that are equal in both are one text
    return found if found.count() <= n else settle(found.dropDuplicates(["class"]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT,
                    block_sets: int = BLOCK_SETS, block_chars: int = BLOCK_CHARS, bucket: int = BUCKET) -> DataFrame:
    """(id, n_shingles, component_id, n_links) for every row; n_links counts the other rows that are alike enough, copies included."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("key"), text.alias("text"))
    kind = texts.schema["key"].dataType.simpleString()
    sets = settle(B.over_text(texts, "text", f"key {kind}, class long, n long", _describe(k)))
    classes = settle(sets.where("n > 0").groupBy("class").agg(F.min("key").alias("key"), F.min("key.id").alias("id"), F.first("n").alias("n"), F.count("*").alias("size")))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    first_ones = settle(_first_shingles(texts, k, percent, total, bucket))
    hubs = first_ones.groupBy("shingle").agg(F.min("class").alias("hub"), F.max("class").alias("other")).where("hub <> other").select("shingle", "hub")
    stars = first_ones.join(hubs, "shingle").where("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(stars).select(F.col("node").alias("class"), F.col("root").alias("group"))

    held = _members(texts, settle(classes.join(groups, "class").select("key", "class", "group", "size")))
    parts = held.groupBy("group").agg((F.greatest(F.floor((F.count("*") - 1) / block_sets), F.floor(F.sum(F.length("text")) / block_chars)) + 1).alias("parts"))
    placed = held.join(parts, "group").withColumn("home", F.pmod(F.xxhash64("class"), F.col("parts")))
    # every pair of blocks meets once, and every block meets itself
    met = placed.withColumn("visited", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumns({
        "block": F.least("home", "visited"), "other": F.greatest("home", "visited"), "native": F.col("home") <= F.col("visited"),
    })
    found = settle(_links(met, k, percent))
    linked = settle(components(found.select(F.col("class").alias("a"), F.col("hub").alias("b"))))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))

    named = classes.join(linked.withColumnRenamed("node", "class"), "class", "left").select("class", "id", "size", F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    labelled = named.join(least, "root").join(links, "class", "left").select("class", "component_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return sets.join(labelled, "class", "left").select(
        F.col("key.id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key.id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null ids last). Rows without words are components of their own unless they are equal in id."""
    # rows are told apart by id and text; what is equal in both is one document. The row itself travels packed, so its columns' names are free
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("jaccard_doc"), key.alias("jaccard_row"), F.col(text_col).alias("jaccard_text"))
    found = settle(near_duplicates(named, "jaccard_row", "jaccard_text", k, percent))
    kept = found.where(F.col("jaccard_row") == F.col("component_id")).groupBy("jaccard_row").agg(F.count("*").alias("times"))
    out = named.join(kept.select("jaccard_row"), "jaccard_row", "left_semi")
    if kept.where("times > 1").limit(1).count():
        out = out.dropDuplicates(["jaccard_row"])
    return out.select("jaccard_doc.*")
