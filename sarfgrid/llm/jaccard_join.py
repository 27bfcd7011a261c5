"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Partners of n and m elements have at most d = (1-t)/(1+t) * (n+m) elements that only one
of them has. A set is therefore dealt, by the elements' values, into more parts than d
(as many for all sets of a size class), so partners have equal parts; each set is listed
under the fingerprints of its largest parts, d + 1 of them, of which a partner has one.
Of the sets of a list only those are candidates whose parts leave room for d, which a byte
a part tells (unequal parts of one size differ by two elements at least): passages or
common words that many documents share make no cluster, however many documents there are. What is left falls into clusters; in each
cluster every set queries the inverted lists of the others: short lists are merged and
counted, long lists are only probed by binary search for sets that can still reach the
required overlap. Where components are asked, partners that are linked already are
skipped; ``jaccard_links`` skips none and gives every link, and the number of links of
each row.

Equal sets count once from the start. A cluster beyond BLOCK_SHINGLES is cut into
chunks by hash, and every pair of chunks is searched, so no task holds more than two
chunks and no link is lost.

Defined results: null and wordless texts have the empty set, and link with nothing;
repeated rows have equal sets and so one component; the order of rows never matters.
"""

from __future__ import annotations

import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, scratch, small_batches, table, tidy, written
from .components import connected_components
from .shingles import mix, set_key, shingle_set

PERCENT = 90
_SALT = np.uint64(0x5851F42D4C957F2D)
#: Words of a shingle.
WORDS = 3
#: Size of the filter that finds candidates again (fixed).
FILTER_BITS = 23
#: Bytes of outlines that are compared at once.
OUTLINE_BYTES = 2_000_000
#: Scratch that nothing reads once the links are written.
SPENT = ("join-lists", "join-sets", "cc-")
#: Shingles of one chunk of a cluster.
BLOCK_SHINGLES = 2_000_000


def required(n, percent: int):
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def most_apart(n: int, m: int, percent: int) -> int:
    """Most elements that only one of two partners of n and m elements has."""
    return (100 - percent) * (n + m) // (100 + percent)


@lru_cache(maxsize=4096)
def size_class(n: int) -> tuple[int, int]:
    """Number and greatest size of the class that holds sets of n elements."""
    k, top = 0, 8
    while top < n:
        k, top = k + 1, top * 8 // 5
    return k, top


def parts(s: np.ndarray, percent: int):
    """For each size class that may hold an unequal partner of a set: its number, most elements that one partner alone has, sizes and fingerprints of the set's parts."""
    n = len(s)
    largest = 100 * n // percent
    (own, top), (last, _) = size_class(n), size_class(largest)
    for k in range(own, last + 1):
        if k > own:
            _, top = size_class(top + 1)
        apart = most_apart(n, min(top, largest), percent)
        if n and apart:
            m = most_apart(top, top, percent) + 1
            at = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # in order, as s is
            edge = np.searchsorted(at, np.arange(m + 1))
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ _SALT), dtype=np.uint64)])
                prints = mix(sums[edge[1:]] - sums[edge[:-1]] + mix(np.arange(m, dtype=np.uint64) * np.uint64(256) + np.uint64(k)))
            yield k, apart, np.diff(edge), prints


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the parts by which any unequal partner of a set is found, the largest ones, and their size classes."""
    out, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for k, apart, size, prints in parts(s, percent):
        out.append(prints[np.lexsort((prints, -size))[: apart + 1]])
        kinds.append(np.full(len(out[-1]), k, np.int32))
    return np.concatenate(out), np.concatenate(kinds)


def outlines(s: np.ndarray, percent: int) -> tuple[list[int], list[bytes]]:
    """By size class: the set's size, and a byte of every part: its size, 15 at most, and four bits of its fingerprint."""
    got = [(k, np.uint32(len(s)).tobytes() + (np.minimum(size, 15).astype(np.uint8) << 4 | prints.astype(np.uint8) & 15).tobytes()) for k, _, size, prints in parts(s, percent)]
    return [x[0] for x in got], [x[1] for x in got]


def _apart() -> np.ndarray:
    """Least number of elements that one of two parts alone has, by their bytes of outline."""
    size, low = np.arange(256) >> 4, np.arange(256) & 15
    same = np.where(low[:, None] == low[None, :], 0, np.where(size == 15, 1, 2)[:, None])  # parts of one size differ by two at least
    return np.where(size[:, None] == size[None, :], same, np.abs(size[:, None] - size[None, :])).astype(np.uint8).ravel()


APART = _apart()


def summaries(docs: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Rows of documents: doc_id, n, key, and the set's outlines."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            lines = [outlines(s, percent) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([x[0] for x in lines], pa.list_(pa.int32())), pa.array([x[1] for x in lines], pa.list_(pa.binary()))],
                names=["doc_id", "n", "key", "kinds", "lines"],
            )
        tidy()

    return docs.mapInArrow(run, "doc_id long, n long, key long, kinds array<int>, lines array<binary>")


def postings(docs: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """(h, key, kind): each distinct set's signatures, once a task."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            hs, keys, kinds = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                k = set_key(s)
                if len(s) and k not in seen:
                    seen.add(k)
                    h, kind = signatures(s, percent)
                    hs.append(h)
                    kinds.append(kind)
                    keys.append(np.full(len(h), k))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(kinds))], names=["h", "key", "kind"])
        tidy()

    return docs.mapInArrow(run, "h long, key long, kind int")


def alike(keys: np.ndarray, lines: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Edges that join the sets of one list whose outlines let them be partners."""
    view = np.frombuffer(b"".join(lines), np.uint8).reshape(len(lines), -1)
    n = np.ascontiguousarray(view[:, :4]).view(np.uint32).ravel().astype(np.int64)
    view, rest, out = view[:, 4:], np.arange(len(keys)), []
    step = max(1, OUTLINE_BYTES // view.shape[1])
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            v = reached.pop()
            mine, ok = view[v].astype(np.uint16) << 8, np.zeros(len(rest), bool)
            for a in range(0, len(rest), step):
                r = rest[a : a + step]
                ok[a : a + step] = APART[mine | view[r]].sum(1, dtype=np.int64) <= most_apart(n[r], n[v], percent)
            new = rest[ok].tolist()
            out += [(int(keys[v]), int(keys[x])) for x in new]
            reached += new
            rest = rest[~ok]
    return out


def alike_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the lists' edges. rows: list, key, line; a list's rows stand together."""

    def run(batches):
        now, keys, lines = None, [], []
        for b in batches:
            a, z = [], []
            for x, k, line in zip(*(b.column(c).to_pylist() for c in ("list", "key", "line")), strict=True):
                if x != now:
                    if len(keys) > 1:
                        edges = alike(np.array(keys), lines, percent)
                        a += [e[0] for e in edges]
                        z += [e[1] for e in edges]
                    now, keys, lines = x, [], []
                keys.append(k)
                lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])
        if len(keys) > 1:
            edges = alike(np.array(keys), lines, percent)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])
        tidy()

    return rows.mapInArrow(run, "a long, b long")


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A bit for every key's slot, 1 MB whatever the input."""

    def run(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            bits[b.column(0).to_numpy(zero_copy_only=False) & ((1 << FILTER_BITS) - 1)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])

    blobs = keys.select("key").mapInArrow(run, "bits binary").toLocalIterator()  # one by one
    return reduce(np.bitwise_or, (np.frombuffer(zlib.decompress(r["bits"]), np.uint8) for r in blobs), np.zeros(1 << (FILTER_BITS - 3), np.uint8))


def candidate_sets(docs: DataFrame, bits, words: int = WORDS) -> DataFrame:
    """(key, set) of the sets whose key may be a candidate's, once a task."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            got = {}
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                k = set_key(s)
                at = k & ((1 << FILTER_BITS) - 1)
                if bits.value[at >> 3] >> (7 - (at & 7)) & 1 and k not in seen:
                    seen.add(k)
                    got[k] = s.tobytes()
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], names=["key", "set"])
        tidy()

    return docs.mapInArrow(run, "key long, set binary")


class Lists:
    """Inverted lists over a cluster's sets, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size = sets, np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.size)
        every = np.concatenate(sets)
        order = np.lexsort((owner, every))
        every, self.owner = every[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.element, self.start = every[first], np.concatenate([first, [len(every)]])
        self.cell = np.repeat(np.arange(len(first)), np.diff(self.start)) * len(sets) + self.owner  # sorted: (list, set)

    def partners(self, q: int, percent: int, wanted) -> np.ndarray:
        """Sets of Jaccard >= percent with set q among those that wanted(candidates) keeps."""
        n = int(self.size[q])
        need = required(n, percent)
        lists = np.searchsorted(self.element, self.sets[q])
        long_first = lists[np.argsort(self.start[lists] - self.start[lists + 1], kind="stable")]
        n_long = need - 1 - max(0, (need - 1) // 8)  # the rest must be met need - n_long times in short lists
        long, short = long_first[:n_long], long_first[n_long:]
        runs = [self.owner[self.start[x] : self.start[x + 1]] for x in short.tolist()]
        cand, count = np.unique(np.concatenate(runs), return_counts=True)  # the merge
        enough = count >= need - n_long
        cand, count = cand[enough], count[enough]
        ok = wanted(cand) & (cand != q) & (100 * np.minimum(self.size[cand], n) >= percent * np.maximum(self.size[cand], n))
        cand, count = cand[ok], count[ok]
        if len(cand) and len(long):  # probes
            probe = (long[:, None] * len(self.sets) + cand[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.cell, probe), len(self.cell) - 1)
            count = count + (self.cell[at] == probe).reshape(len(long), -1).sum(0)
        return cand[100 * count >= percent * (n + self.size[cand] - count)]


def link_cluster(keys, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Links that join the cluster's components, or every link once; with sides, only links between different sides are looked for."""
    if len(sets) < 2:
        return []
    lists, label, members, out = Lists(sets), np.arange(len(sets)), [[k] for k in range(len(sets))], []
    for q in range(len(sets) if every else 0):
        later = lambda c, q=q: (c > q) & (True if side is None else side[c] != side[q])
        out += [(int(keys[q]), int(keys[x])) for x in lists.partners(q, percent, later).tolist()]
    for q in range(0 if every else len(sets)):
        apart = lambda c, q=q: (label[c] != label[q]) & (True if side is None else side[c] != side[q])
        for x in lists.partners(q, percent, apart).tolist():
            a, b = sorted((int(label[x]), int(label[q])), key=lambda k: len(members[k]))
            if a != b:
                out.append((int(keys[q]), int(keys[x])))
                label[members[a]] = b
                members[b] += members[a]
                members[a] = []
    return out


def links(sets: DataFrame, clusters: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """(a, b): enough links of keys to join every component, or every link once. sets: key, set; clusters: v, root."""
    c = clusters.select(F.col("v").alias("x"), F.col("root").alias("cluster"))
    rows = written(sets.join(c, sets["key"] == c["x"]).select("cluster", "key", "set").dropDuplicates(["key"]), "join-sets")
    total = rows.groupBy("cluster").agg(F.sum(F.length("set") / 8).alias("shingles"), F.count("*").alias("k")).where("k > 1")
    total = total.select(F.col("cluster").alias("c"), F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int").alias("chunks"))
    rows = rows.join(total, rows["cluster"] == total["c"]).drop("c")
    mine = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    rows = rows.withColumn("mine", mine).withColumn("at", F.explode(pairs)).select("cluster", "key", "set", "mine", "at.i", "at.j")

    def run(key, rows):
        got = rows.sort_by("key")
        sets = [np.frombuffer(x, np.uint64) for x in got.column("set").to_pylist()]
        side = got.column("mine").to_numpy() if key[1].as_py() != key[2].as_py() else None
        out = link_cluster(got.column("key").to_numpy(), sets, percent, side, every)
        if len(sets) > 200:
            tidy()
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def search(docs: DataFrame, percent: int, id_col: str, text_col: str, words: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key) of every row, and the links of keys: enough for the components, or all."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    context = docs.sparkSession.sparkContext
    rows = written(summaries(docs, percent, words), "join-summaries")
    of_h = Window.partitionBy("h")
    p = postings(docs, percent, words).repartition("h").dropDuplicates(["h", "key"]).withColumn("k", F.count("*").over(of_h))
    p = p.withColumn("list", F.bit_xor(F.xxhash64("key", "kind")).over(of_h)).where("k > 1")
    p = written(p.select(F.struct("kind", "k", "list").alias("list"), "key", "kind").distinct(), "join-lists")  # lists of the same sets count once
    line = rows.where("n > 0").select(F.col("key").alias("of"), F.explode(F.arrays_zip("kinds", "lines")).alias("x")).select("of", F.col("x.kinds").alias("is"), F.col("x.lines").alias("line"))
    met = p.join(line.dropDuplicates(["of", "is"]), (F.col("key") == F.col("of")) & (F.col("kind") == F.col("is"))).select(F.xxhash64("list.*").alias("list"), "key", "line")
    clusters = connected_components(alike_pairs(met.repartition("list").sortWithinPartitions("list"), percent))
    bits = context.broadcast(bit_filter(clusters.select(F.col("v").alias("key"))))
    return rows.select("doc_id", "n", "key"), links(candidate_sets(docs, bits, words), clusters, percent, every)


def jaccard_links(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Without the skip of linked partners: (doc_id, n_shingles, set_key, n_links) of every row, and (a, b), every link between distinct sets' keys once.

    n_links counts the other rows that a row links with, those of an equal set too. The
    links of a group of near copies grow with the square of its distinct sets.
    """
    before = set(scratch())
    rows, found = search(docs, percent, id_col, text_col, words, True)
    found = written(found, "join-links")
    release(docs.sparkSession, [x for x in scratch() if x not in before], SPENT)
    size = rows.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(size, both["b"] == size["key"]).groupBy("a").agg(F.sum("copies").alias("others"))
    per_set = size.join(others, size["key"] == others["a"], "left").select(F.col("key").alias("of"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.join(per_set, (rows["key"] == per_set["of"]) & (rows["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("set_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), found


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles (of so many words), component_id of every row."""
    before = set(scratch())
    rows, found = search(docs, percent, id_col, text_col, words, False)
    spent = [x for x in scratch() if x not in before]
    found = connected_components(found)
    release(docs.sparkSession, spent, SPENT)
    keyed = rows.join(found, rows["key"] == found["v"], "left").select("doc_id", "n", F.coalesce("root", "key").alias("c"))
    least = keyed.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("c", "of")
    out = keyed.join(least, (keyed["c"] == least["of"]) & (keyed["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
