"""N-gram Jaccard join by T-occurrence search.

A document's set is its distinct word shingles (64-bit hashes; 3 words, or any other number). Two sets are linked if their Jaccard
similarity reaches `percent` (90). Of linked sets x and y, y not the larger, both hold at least a = ceil(percent (|x| + |y|) / (100 +
percent)) shingles of the other, so in any common order of shingles they share one among the first |x| - a + 1 and |y| - a + 1. With the
least a of any partner this gives each set the lists it is probed by (the first |x| - ceil(percent |x| / 100) + 1) and, among them, the
shorter prefix it is indexed by: these are the short inverted lists of DivideSkip, the other shingles are the long lists that are probed
and never merged. The order is rare first: shingles that many documents have are tallied in every task and the most frequent of all (a
fixed bound) go last; the others go by the product of their words' counts, from a count sketch of fixed size.

1. Documents with equal sets become one node.
2. The short lists are dealt by shingle. Every list compares its most central indexed member (most of whose shingles are frequent) with
   the others: a star, not all pairs. Stars are merged by member pair, and each centre searches its members in chunks.
3. Linked nodes are merged into components. Lists are cut by size bands, as wide as linked sizes may differ, and a list whose members are
   in one component is done. A list that would cost more to search than to cut is cut once more by the next shingle that both sides must
   share (linked sets share two among prefixes that are one longer). In what is left, members outside the largest component are
   searched against the other role's members, both in chunks, so that no pair within a large group is ever listed; a search reports a
   link only if it joins what earlier ones have not. Before sets are sent to a search, bitmaps of them (some bits for each shingle)
   bound every overlap from above; members that can have no partner, such as documents that share a passage, go.
4. Components are merged again.

A search (`divide_skip`) builds the inverted lists of a chunk, merges the short lists of the query with a heap, probes the long ones
by binary search, and keeps members that reach the overlap. All lists are resolved, so no link between different components is lost,
whatever the size of a group; the order and the choice of centres only affect the work.

Cases: null, empty and wordless texts have empty sets and link with nothing. Texts of fewer words than a shingle are one shingle. Rows
are nodes: repeated rows and equal texts are in one component. A null doc_id is never the smallest id of a component with other ids.
Other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, discard, give_back, materialize, ngrams, row_key, slices, small, small_bytes, summed, word_hashes

PERCENT, WORDS = 90, 3
#: Frequent shingles that go last in the order: in all, offered by one task, tallied at a time.
FREQUENT, OFFERED, TALLIED = 100_000, 20_000, 800_000
#: Cells of the sketch of word counts.
CELLS_LOG2, CELL_BLOCK = 18, 1 << 14
#: Members of one search chunk.
CHUNK = 512


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(ngrams(word_hashes((text or "").encode().lower().split()), words))


def threshold(n: int, percent: int = PERCENT) -> int:
    """Least overlap with any linked set."""
    return -(-n * percent // 100)


def probed(n: int, percent: int) -> int:
    """Length of the prefix by which a set meets linked sets that are not larger."""
    return n - threshold(n, percent) + 1


def indexed(n: Column, percent: int) -> Column:
    """Length of the prefix by which a set is met by linked sets that are not smaller."""
    part = 2 * percent * n + (100 + percent - 1)
    return (n + 1 - (part - part % (100 + percent)) / (100 + percent)).cast("int")


# ---- passes over the texts ------------------------------------------------------------------------------------------


@dataclass
class Order:
    """What puts shingles in order: the most frequent ones with their counts, and the logarithms of word counts by cell."""

    frequent: np.ndarray
    counts: np.ndarray
    words: np.ndarray

    def ranks(self, s: np.ndarray) -> np.ndarray:
        """How often each shingle was tallied; 0 if it isn't among the frequent."""
        if not len(self.frequent):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
        return np.where(self.frequent[at] == s, self.counts[at], 0)

    def weights(self, h: np.ndarray, words: int) -> np.ndarray:
        """Rounded logarithms of the product of the word counts of each window of words."""
        w = self.words[h >> np.uint64(64 - CELLS_LOG2)]
        n = len(h) - words + 1
        return np.round(4 * sum(w[i : n + i] for i in range(words))).astype(np.int32) if n > 0 else np.zeros(min(len(h), 1), np.int32)


def shingle_order(docs: DataFrame, words: int = WORDS, top: int = FREQUENT) -> Order:
    """Tallies of all texts."""

    def tally(batches):
        held: list[np.ndarray] = []
        kept_h, kept_n, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        cells = np.zeros(1 << CELLS_LOG2, np.int64)

        def merge():
            every, counts = np.unique(np.concatenate([kept_h, *held]), return_counts=True)
            if len(kept_h):
                counts[np.searchsorted(every, kept_h)] += kept_n - 1
            some = counts > 1
            every, counts = every[some], counts[some]
            if len(every) > TALLIED // 4:
                best = np.sort(np.argpartition(counts, -TALLIED // 8)[-TALLIED // 8 :])
                every, counts = every[best], counts[best]
            return every, counts

        for batch in slices(batches):
            seen = []
            for t in batch.column(0).to_pylist():
                h = word_hashes(t.encode().lower().split())
                seen.append(h)
                held.append(np.unique(ngrams(h, words)))
                size += len(held[-1])
            cells += np.bincount((np.concatenate(seen) >> np.uint64(64 - CELLS_LOG2)).astype(np.int64), minlength=len(cells))
            if size > TALLIED:
                (kept_h, kept_n), held, size = merge(), [], 0
        if held or len(kept_h):
            kept_h, kept_n = merge()
        if len(kept_h) > OFFERED:
            best = np.argpartition(kept_n, -OFFERED)[-OFFERED:]
            kept_h, kept_n = kept_h[best], kept_n[best]
        blocks = [(k, cells[k : k + CELL_BLOCK].tobytes()) for k in range(0, len(cells), CELL_BLOCK)] if cells.any() else []
        m, n = len(kept_h), len(blocks)
        yield pa.RecordBatch.from_arrays([
            pa.array([*kept_h.view(np.int64).tolist(), *[None] * n], pa.int64()), pa.array([*kept_n.tolist(), *[None] * n], pa.int64()),
            pa.array([*[None] * m, *(k for k, _ in blocks)], pa.int32()), pa.array([*[None] * m, *(v for _, v in blocks)], pa.binary()),
        ], ["h", "n", "k", "v"])
        give_back()

    told = materialize(docs.where(F.col("text").isNotNull()).select("text").mapInArrow(tally, "h long, n long, k int, v binary"), "tallies")
    # The most frequent shingles, at most `top`: those in the upper classes of a histogram of counts.
    sums = materialize(told.where("h is not null").groupBy("h").agg(F.sum("n").alias("n")), "sums")
    level = F.floor(F.log2("n") * 8).cast("int")
    least, room = None, top
    for r in sorted(sums.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["level"]):  # some 500 rows
        if (room := room - r["k"]) < 0:
            break
        least = r["level"]
    best = sums.where(F.lit(False) if least is None else level >= least).toArrow()
    cells = np.zeros(1 << CELLS_LOG2)
    for r in summed(told.where("k is not null").select("k", "v")).collect():  # as many cells, whatever the input
        cells[r["k"] : r["k"] + CELL_BLOCK] = np.frombuffer(r["v"], np.int64)
    discard(told, sums)
    h, n = best["h"].to_numpy().view(np.uint64), best["n"].to_numpy()
    order = np.argsort(h)
    return Order(h[order], n[order], np.log1p(cells).astype(np.float32))


def signatures(docs: DataFrame, order: Order, words: int, percent: int) -> DataFrame:
    """KEY, doc_id, n, node (fingerprint of the set; null if empty), central (millionths of the shingles that are frequent), bits, and
    prefix (the shingles it is probed by and one more, rare first)."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        order = shared.value
        for batch in slices(batches):
            n, node, central, bits, prefix = [], [], [], [], []
            for t in batch.column(3).to_pylist():
                h = word_hashes((t or "").encode().lower().split())
                s, first = np.unique(ngrams(h, words), return_index=True)
                n.append(len(s))
                if not len(s):
                    node.append(None), central.append(0), bits.append(None), prefix.append(None)
                    continue
                rank, weight = order.ranks(s), order.weights(h, words)[first]
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                central.append(int(1e6 * np.count_nonzero(rank) / len(s)))
                bits.append(bitmap(s))
                rare = np.lexsort((s, weight, rank))[: probed(len(s), percent) + 1]
                prefix.append(s[rare].view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int32()), pa.array(node, pa.binary()), pa.array(central, pa.int32()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], [*KEY, "doc_id", "n", "node", "central", "bits", "prefix"])
        give_back()

    return docs.select(*row_key(), "doc_id", "text").mapInArrow(run, "__k1 long, __k2 long, doc_id long, n int, node binary, central int, bits binary, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and set (sorted hashes as bytes) of the documents in wanted(KEY, node), materialized, one document for each node."""

    def run(batches):
        for batch in slices(batches):
            nodes, sets = [], []
            for node, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(t, words).tobytes()
                if hashlib.blake2b(own, digest_size=16).digest() == node:  # else another text under the same key
                    nodes.append(node), sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "set"])
        give_back()

    return docs.select(*row_key(), "text").join(small(wanted), KEY).select("node", "text").mapInArrow(run, "node binary, set binary")


# ---- bounds from bitmaps ----------------------------------------------------------------------------------------------


def bitmap(s: np.ndarray) -> bytes:
    """A set's hashes by their low bits, two to four bits for each."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[s & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[-1] > words:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] | rows[..., half:]
    return rows


def may_link(n: int, own: bytes, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others (bitmaps of one length) may reach the similarity: a bit that one side lacks is a shingle that it lacks."""
    mine = np.frombuffer(own, np.uint64)
    words = min(len(mine), others.shape[1])
    mine, others = _folded(mine, words), _folded(others, words)
    most = np.minimum(n - np.bitwise_count(mine & ~others).sum(1, dtype=np.int64), sizes - np.bitwise_count(others & ~mine).sum(1, dtype=np.int64))
    return (most > 0) & (100 * most >= percent * (n + sizes - most))


def _sift(percent: int):
    """Rows (job, query, g, node, comp, n, bits), sorted by job. Yields the (g, node) of those that may have a partner in another component."""

    def run(batches):
        for rows in _jobs(batches):
            by_length: dict[int, list] = defaultdict(list)
            for r in rows:
                if not r[0]:
                    by_length[len(r[5])].append(r)
            groups = [(g, np.array([r[4] for r in g]), np.array([np.frombuffer(r[5], np.uint64) for r in g]), np.array([r[3] for r in g], object)) for g in by_length.values()]
            kept = set()
            for query, own, node, comp, n, bits in rows:
                for g, sizes, maps, comps in groups if query else ():
                    for m in np.flatnonzero(may_link(n, bits, sizes, maps, percent) & (comps != comp)):
                        kept.add((own, g[m][2]))
                        kept.add((own, node))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.binary())], ["g", "node"])

    return run


def _jobs(batches):
    """The rows of each job, without it."""
    job, rows = None, []
    for batch in slices(batches, 256):
        for now, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != job:
                if rows:
                    yield rows
                job, rows = now, []
            rows.append(row)
    if rows:
        yield rows


# ---- the search within a task -----------------------------------------------------------------------------------------


def inverted(members: list[np.ndarray]) -> dict[int, list[int]]:
    lists: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(members):
        for h in s.tolist():
            lists[h].append(i)
    return lists


def divide_skip(query: np.ndarray, lists: dict[int, list[int]], sizes: list[int], percent: int) -> list[int]:
    """Members whose set is linked with the query's. lists: ascending member numbers by shingle; sizes: of the members' sets."""
    own, t = len(query), threshold(len(query), percent)
    found = sorted((lists[h] for h in query.tolist() if h in lists), key=len)
    if len(found) < t:
        return []
    short, long = found[: len(found) - t + 1], found[len(found) - t + 1 :]
    out, last, count = [], -1, 0

    def settle(m: int, count: int) -> None:
        need = max(t, threshold(sizes[m], percent), -(-percent * (own + sizes[m]) // (100 + percent)))
        for k, probed in enumerate(long):
            if count + len(long) - k < need:
                return
            at = np.searchsorted(probed, m) if len(probed) > 64 else _place(probed, m)
            count += at < len(probed) and probed[at] == m
        if 100 * count >= percent * (own + sizes[m] - count):
            out.append(m)

    for m in heapq.merge(*short):
        if m != last:
            if count:
                settle(last, count)
            last, count = m, 0
        count += 1
    if count:
        settle(last, count)
    return out


def _place(probed: list[int], m: int) -> int:
    from bisect import bisect_left

    return bisect_left(probed, m)


class Forest:
    """Union-find over what one task has seen."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: bytes, y: bytes) -> bool:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _search(percent: int):
    """Rows (job, query, node, comp, set), sorted by job: all rows of a job are together. Yields the links (a, b) that join components."""

    def run(batches):
        for rows in _jobs(batches):
            members = [r for r in rows if not r[0]]
            queries = [r for r in rows if r[0]]
            if not members or not queries:
                continue
            sets = [np.frombuffer(r[3], np.uint64) for r in members]
            lists, sizes, forest, links = inverted(sets), [len(s) for s in sets], Forest(), []
            arrays = {h: np.array(x) if len(x) > 64 else x for h, x in lists.items()}
            for _, node, comp, own in queries:
                for m in divide_skip(np.frombuffer(own, np.uint64), arrays, sizes, percent):
                    if members[m][1] != node and forest.join(comp, members[m][2]):
                        links.append((node, members[m][1]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return run


def search(jobs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of jobs(job, query, node, comp): every node with query true against every one with false in its job."""
    full = jobs.join(sets, "node").select("job", "query", "node", "comp", "set")
    dealt = full.repartition("job").sortWithinPartitions("job")
    return dealt.mapInArrow(_search(percent), "a binary, b binary")


# ---- components -------------------------------------------------------------------------------------------------------


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, comp) of all nodes of the links (a, b); comp is the smallest node. Large star and small star until nothing changes."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), tag)
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(star.where("u != v").distinct(), tag)
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v"), F.col("v")).distinct())


# ---- the join -----------------------------------------------------------------------------------------------------------


def banded(rows: DataFrame, percent: int) -> DataFrame:
    """rows(h, i, node, n, indexed, comp) as members of lists (g, probe, node, n, comp, h, i): a list holds the sets of one size band
    that are probed by h and the sets of this and the next smaller band that are indexed by it."""
    width = -math.log(percent / 100) * (1 + 1e-9)
    band = F.floor(F.log("n") / width)
    as_probe = rows.select("h", "i", "node", "n", "comp", F.lit(True).alias("probe"), band.alias("band"))
    as_index = rows.where("indexed").select("h", "i", "node", "n", "comp", F.lit(False).alias("probe"), F.explode(F.array(band, band + 1)).alias("band"))
    return as_probe.union(as_index).select(F.xxhash64("h", "band").alias("g"), "probe", "node", "n", "comp", "h", "i")


def tallied(rows: DataFrame) -> DataFrame:
    """Of rows(g, probe, node, n, comp), lists with probed and indexed members in several components: g, its largest component `main`,
    members by role in and outside it (pm, po, im, io), and the hash sum of the members."""
    by_comp = rows.groupBy("g", "comp").agg(
        F.count("*").alias("k"), F.count_if("probe").alias("p"), F.sum(F.xxhash64("node", "probe").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")
    )
    main = F.max(F.struct("k", "comp", "p"))
    lists = by_comp.groupBy("g").agg(F.sum("k").alias("k"), F.sum("p").alias("p"), F.sum("s").alias("s"), F.sum("n").alias("n"), main.alias("main"))
    i, im = F.col("k") - F.col("p"), F.col("main.k") - F.col("main.p")
    parts = lists.select("g", "k", "s", "n", F.col("main.comp").alias("main"), F.col("main.p").alias("pm"), (F.col("p") - F.col("main.p")).alias("po"), im.alias("im"), (i - im).alias("io"))
    return parts.where("po * (im + io) + io * pm > 0")


def dealt_size() -> Column:
    """Rows that the search of a list deals to its jobs."""
    jobs = lambda a, b: F.ceil(F.col(a) / CHUNK) * b + F.ceil(b / CHUNK) * F.col(a)
    return jobs("po", F.col("im") + F.col("io")) + jobs("io", F.col("pm"))


def narrowed(rows: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """rows(g, probe, node, n, comp, h, i) with each list that would be dealt to more rows than the cut costs replaced by lists of the
    members that also share a later shingle of the prefix, which is one longer than the list's own."""
    cost = F.col("n") * (100 - percent) / 100 + 2 * F.col("k")
    long = materialize(tallied(rows).where(dealt_size() > 2 * cost).select("g"), "long")
    if long.isEmpty():
        return rows
    some = small(long)
    cut = rows.join(some, "g").join(prefixes, "node")
    last = F.when(F.col("probe"), F.size("prefix")).otherwise(F.least(indexed(F.col("n"), percent) + 1, F.size("prefix")))
    later = F.slice("prefix", F.col("i") + 2, F.greatest(last - F.col("i") - 1, F.lit(0)))
    cut = cut.select("g", "probe", "node", "n", "comp", "h", "i", F.explode(later).alias("h2"))
    return rows.join(some, "g", "left_anti").union(cut.select(F.xxhash64("g", "h2").alias("g"), "probe", "node", "n", "comp", "h", "i"))


def open_jobs(rows: DataFrame) -> DataFrame:
    """Jobs (job, query, g, node, comp) for the lists of rows(g, probe, node, n, comp): probed members outside the largest component
    against the indexed ones, and indexed ones outside it against the probed ones in it, both in chunks. Of lists with the same members,
    one is enough."""
    lists = tallied(rows)
    one = lists.groupBy("s", "k").agg(F.max(F.struct("g", "main", "pm", "po", "im", "io")).alias("x")).select("x.*")
    out, (q0, m0, q1, m1) = F.col("comp") != F.col("main"), (F.ceil(k / CHUNK) for k in (F.col("po"), F.col("im") + F.col("io"), F.col("io"), F.col("pm")))
    full = rows.join(one, "g")
    own = lambda k: F.pmod(F.xxhash64("node"), F.greatest(k, F.lit(1)))

    def dealt(query: bool, chunks: Column, number) -> Column:
        """One (query, job) for each chunk of the other side. Jobs that share a number are one job: more work, no other links."""
        each = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(chunks - 1, F.lit(0))), lambda j: j < chunks)
        return F.transform(each, lambda j: F.struct(F.lit(query).alias("query"), F.xxhash64("g", *number(j)).alias("job")))

    asked, member = dealt(True, m0, lambda j: (F.lit(0), j, own(q0))), dealt(False, q0, lambda j: (F.lit(0), own(m0), j))
    asked_back, member_back = dealt(True, m1, lambda j: (F.lit(1), j, own(q1))), dealt(False, q1, lambda j: (F.lit(1), own(m1), j))
    roles = F.when(F.col("probe"), F.when(out, asked).otherwise(member_back)).otherwise(F.when(out, F.concat(member, asked_back)).otherwise(member))
    return full.select("g", "node", "comp", F.explode(roles).alias("x")).select("x.job", "x.query", "g", "node", "comp")


def _pairs_that_may_link(percent: int):
    """Of rows (a, b, n, bits, n, bits), the pairs (a, b)."""

    def run(batches):
        for batch in slices(batches, 2000):
            a, b, na, xa, nb, xb = (c.to_pylist() for c in batch.columns)
            kept = [may_link(na[i], xa[i], np.array([nb[i]]), np.frombuffer(xb[i], np.uint64)[None], percent)[0] for i in range(len(a))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), batch.column(1).filter(pa.array(kept))], ["centre", "node"])

    return run


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """KEY, doc_id, n_shingles, component_id (smallest doc_id reachable by links, null if none of them has an id) and head (whether the
    row has the key of its component's first row, by id, then key; null for empty sets) of every row. percent: over 50."""
    signed = materialize(signatures(docs, shingle_order(docs, words), words, percent), "signatures")
    # One aggregation, partial in every task, so that copies of a set, however many, meet as one row a task.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY, "n", "central", "bits", "prefix")).alias("x")
    heads = signed.where(F.col("node").isNotNull()).groupBy("node").agg(first).select("node", "x.*")
    heads = materialize(heads, "heads")
    # A list holds short ids of its members; nodes that share one are both looked at.
    short = F.xxhash64("node").alias("short")
    lists = heads.select(short, "n", F.posexplode(F.slice("prefix", F.lit(1), F.col("n") - F.expr(f"(n * {percent} + 99) div 100").cast("int") + 1)).alias("i", "h"))
    lists = lists.select("short", "i", "h", (F.col("i") < indexed(F.col("n"), percent)).alias("indexed"))

    # Lists of two or more with an indexed member: each with its centre.
    counts = lists.groupBy("h").agg(F.count("*").alias("size"), F.max("indexed").alias("any")).where("size > 1 and any").drop("any")
    met = materialize(lists.join(counts, "h"), "met")
    members = materialize(heads.select(short, "node", "n", "central", "bits", *KEY, "prefix").join(met.select("short").distinct(), "short", "left_semi"), "members")
    known = members.count()
    about = small_bytes(members.select("node", "n", "bits"), "bits")
    shared = met.join(small(members.select("short", "node", "n", "central"), known), "short").select("h", "i", "size", "indexed", "node", "n", "central")
    centres = shared.where("indexed").groupBy("h").agg(F.max(F.struct("central", "node", "n")).alias("c")).select("h", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"))
    shared = materialize(shared.join(centres, "h").select("h", "i", "size", "indexed", "node", "n", "centre", "centre_n"), "lists")
    discard(met)
    near = (100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")) & (F.col("indexed") | (F.col("n") >= F.col("centre_n")))
    stars = shared.where((F.col("node") != F.col("centre")) & near).select("centre", "node").distinct()
    stars = stars.join(about, "node").join(about.select(F.col("node").alias("centre"), F.col("n").alias("cn"), F.col("bits").alias("cb")), "centre")
    stars = materialize(stars.select("centre", "node", "cn", "cb", "n", "bits").mapInArrow(_pairs_that_may_link(percent), "centre binary, node binary"), "stars")
    sizes = stars.groupBy("centre").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    spokes = stars.join(sizes, "centre").select(F.xxhash64("centre", chunk).alias("job"), F.lit(False).alias("query"), "node", F.col("node").alias("comp"), "centre")
    jobs = materialize(spokes.drop("centre").union(spokes.select("job", F.lit(True), F.col("centre"), F.col("centre")).distinct()), "jobs")
    discard(stars)

    def found(jobs: DataFrame) -> DataFrame:
        asked = materialize(jobs.select("node").distinct(), "asked")
        wanted = materialize(members.select(*KEY, "node").join(small(asked), "node", "left_semi"), "wanted")
        sets = materialize(sets_of(docs, wanted, words), "sets")
        links = materialize(search(jobs, sets.dropDuplicates(["node"]), percent), "links")
        discard(asked, wanted, sets, jobs)
        return links

    links = found(jobs)
    comp = materialize(components(links), "components")

    # What the stars have not settled: members other than the centre, of lists with several components.
    rest = shared.where((F.col("node") != F.col("centre")) & (F.col("size") > 2)).select("h", "i", "node", "n", "indexed")
    rest = rest.join(small(comp), "node", "left").select("h", "i", "node", "n", "indexed", F.coalesce("comp", "node").alias("comp"))
    lists = materialize(banded(rest, percent), "bands")
    discard(shared)
    rest = narrowed(lists, members.select("node", "prefix"), percent).select("g", "probe", "node", "n", "comp")
    sifted = open_jobs(rest).join(about, "node").select("job", "query", "g", "node", "comp", "n", "bits").repartition("job").sortWithinPartitions("job")
    kept = materialize(sifted.mapInArrow(_sift(percent), "g long, node binary").distinct(), "kept")
    again = materialize(open_jobs(rest.join(kept, ["g", "node"], "left_semi")).drop("g"), "jobs")
    more = found(again)
    final = materialize(components(comp.toDF("a", "b").union(more)), "components") if not more.isEmpty() else comp

    head = F.struct("none", "doc_id", *KEY).alias("head")
    label = materialize(heads.select("node", head).join(small(final), "node", "left").select("node", "head", F.coalesce("comp", "node").alias("comp")), "labels")
    by_node = materialize(label.join(label.groupBy("comp").agg(F.min("head").alias("lead")), "comp").select("node", "lead"), "leads")
    discard(lists, kept, members, heads, links, more, label, *{id(x): x for x in (comp, final)}.values())
    # Rows without a set meet nothing; of the others a node's copies are one key, which adaptive execution splits.
    named = signed.where(F.col("node").isNotNull()).join(small(by_node), "node").select(*KEY, "doc_id", "n", F.col("lead.doc_id").alias("component_id"), F.expr(" and ".join(f"{k} = lead.{k}" for k in KEY)).alias("head"))
    empty = signed.where(F.col("node").isNull()).select(*KEY, "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("boolean").alias("head"))
    return named.union(empty).select(*KEY, "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "head")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop(*KEY, "head")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: Every pair that shares a shingle, compared in full: brute force.
ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (na + nb - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS c FROM r GROUP BY 1)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, s.doc_id) AS component_id FROM s LEFT JOIN c ON c.node = s.doc_id"""
