"""Suffix-array dedup by a logarithmic family of sorted suffix levels.

Every byte covered by a LENGTH-byte string that also starts in a document with a
smaller id is removed. Suffixes are sampled: any LENGTH bytes hold GRAM bytes whose
fingerprint is least among the LENGTH - GRAM + 1 inside, and equal strings choose the
same ones, so only suffixes around these *anchors* (one byte in sixteen) are looked at.

1. Documents are packed into chunks of some MB, written once, in hash buckets: no later
   step shuffles a text.
2. Every chunk sends its anchors' fingerprints, sorted and packed, to their buckets;
   a bucket answers each chunk with the anchors that another document shares.
3. Only shared anchors send their surroundings (the bytes any LENGTH-byte string over
   the anchor can hold); equal surroundings count once a chunk, for the least document.
4. In a bucket, documents arrive in batches by id. A batch gets its own suffix array
   (suffixes cut at LENGTH bytes, in byte order), is merge-scanned within itself and
   against the levels of all earlier batches, then becomes a level; levels of like size
   merge, so a suffix is rewritten a logarithmic number of times.
5. The covered spans go back to their chunks, which cut them out.

All comparisons that decide are between bytes, never fingerprints. A string that many
documents share costs one entry a chunk. No task holds more than one bucket or chunk,
and no driver holds anything but one number.

Defined results: null text is empty; texts shorter than LENGTH stay whole; repeated
rows of one id don't remove each other; a null id counts as larger than all ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, tidy, written_in_buckets
from .shingles import mix, powers, prefix_sums

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # bytes on either side of an anchor that one string over it can hold
WIDTH = GRAM + 2 * REACH
#: Bytes of text of one chunk, and of text whose anchors share one bucket.
CHUNK_BYTES, BUCKET_BYTES = 4_000_000, 2_000_000
#: A bucket of fingerprints holds so many times the text of a bucket of surroundings: it needs few bytes a text, and a chunk sends a blob to each.
PRINTS_WIDER = 4
#: Bytes that are fingerprinted at once, and suffixes of one batch.
SLAB, BATCH = 1_000_000, 150_000
LAST = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes, each with type and length in front."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        body = pa.compress(raw, "zstd", asbytes=True) if raw else b""
        head = a.dtype.str.encode()
        out.append(np.array([len(head), len(a), len(body)], np.int64).tobytes() + head + body)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        h, n, size = np.frombuffer(blob, np.int64, 3, at).tolist()
        kind = np.dtype(blob[at + 24 : at + 24 + h].decode())
        at += 24 + h
        raw = np.frombuffer(pa.decompress(blob[at : at + size], n * kind.itemsize, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else raw.view(kind))
        at += size
    return out


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[: len(a) - (w - span)], a[w - span :]) if w > span else a


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints of the anchors of one text."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, prints = [], []
    for s in range(0, len(raw) - LENGTH + 1, SLAB):
        part = raw[s : s + SLAB + LENGTH - 1]
        sums = prefix_sums(part)
        n = len(part) - GRAM + 1
        with np.errstate(over="ignore"):
            h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(len(part))[1][:n])
        least = sliding(h, REACH + 1, np.minimum)
        edge = np.zeros(REACH, np.uint64)
        p = np.flatnonzero(h == sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum))
        at.append(p + s)
        prints.append(h[p])
    at, prints = np.concatenate(at), np.concatenate(prints)
    if len(raw) > SLAB:  # seen from two slabs
        at, first = np.unique(at, return_index=True)
        prints = prints[first]
    return at, prints


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def record(names, *columns):
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def chunks(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, payload, carried): ids, lengths and bytes of some MB of documents, and their carried column. docs: i, t, carried."""

    def run(batches):
        part, seq, ids, texts, held, carried = TaskContext.get().partitionId(), 0, [], [], 0, []

        def row():
            lengths = np.array([len(t) for t in texts], np.int64)
            return record(["chunk", "payload", "carried"], pa.array([(part << 32) + seq], pa.int64()), pa.array([pack(np.array(ids, np.int64), lengths, np.frombuffer(b"".join(texts), np.uint8))], pa.binary()), pa.array([to_ipc(pa.concat_arrays(carried))], pa.binary()))

        for b in batches:
            first = 0
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                ids.append(LAST if i is None else i)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= size:
                    carried.append(b.column(2).slice(first, k + 1 - first))
                    yield row()
                    seq, ids, texts, held, carried, first = seq + 1, [], [], 0, [], k + 1
            carried.append(b.column(2).slice(first))
        if ids:
            yield row()
        tidy()

    return docs.mapInArrow(run, "chunk long, payload binary, carried binary")


def to_ipc(a: pa.Array) -> bytes:
    if pa.types.is_struct(a.type):  # as Spark's schema texts have it
        a = a.cast(pa.struct([f.with_nullable(True) for f in a.type]))
    sink = pa.BufferOutputStream()
    batch = record(["carried"], a)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(blob: bytes) -> pa.Array:
    return pa.ipc.open_stream(blob).read_all().column(0).combine_chunks()


def opened(payload: bytes):
    ids, lengths, raw = unpack(payload)
    ends = np.cumsum(lengths)
    return ids, ends - lengths, ends, raw


def found(payload: bytes):
    """ids, starts, raw, and per anchor: document, position in raw, fingerprint."""
    ids, starts, ends, raw = opened(payload)
    doc, at, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in np.flatnonzero(ends - starts >= LENGTH).tolist():
        p, h = anchors(raw[starts[k] : ends[k]])
        doc.append(np.full(len(p), k))
        at.append(p + starts[k])
        prints.append(h)
    return ids, starts, ends, raw, np.concatenate(doc), np.concatenate(at), np.concatenate(prints)


def send_prints(n: int):
    """Chunk -> (bucket, chunk, blob): sorted fingerprints, and whether two documents of the chunk hold them."""

    def run(batches):
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload").to_pylist(), strict=True):
                ids, _, _, _, doc, _, h = found(payload)
                if not len(h):
                    continue
                order = np.argsort(h)
                h, d = h[order], ids[doc][order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                u, many = h[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
                at = bucket_of(u, n)
                edge = np.searchsorted(at, np.arange(n + 1))
                got = [(k, pack(np.diff(u[a:z], prepend=np.uint64(0)), many[a:z])) for k, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if z > a]
                if got:
                    yield record(["bucket", "chunk", "blob"], pa.array([g[0] for g in got], pa.int64()), pa.array([chunk] * len(got), pa.int64()), pa.array([g[1] for g in got], pa.binary()))
            tidy()

    return run


def undiff(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(a, dtype=np.uint64)


def shared_prints(rows: pa.Table) -> pa.Table:
    """One bucket -> (chunk, blob): the chunk's fingerprints that two documents hold."""
    parts = [unpack(x) for x in rows.column("blob").to_pylist()]
    every = [undiff(p[0]) for p in parts]
    h = np.concatenate(every)
    many = np.concatenate([p[1] for p in parts])
    u, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    keep = ((count > 1) | (np.bincount(inverse, many, len(u)) > 0))[inverse]
    out, at = [], 0
    for chunk, x in zip(rows.column("chunk").to_pylist(), every, strict=True):
        mine = x[keep[at : at + len(x)]]
        at += len(x)
        if len(mine):
            out.append((chunk, pack(np.diff(mine, prepend=np.uint64(0)))))
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary())})


def strings(matrix: np.ndarray) -> np.ndarray:
    """Rows of bytes as fixed-length strings, which compare in byte order."""
    m = np.ascontiguousarray(matrix)
    return m.view(f"S{m.shape[1]}").reshape(len(m))


def classes(keys: np.ndarray, ids: np.ndarray):
    """For every entry the number of its class of equal keys, and for every class its least id."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), LAST)
    np.minimum.at(least, number, ids)
    return number, least


def surroundings(raw, starts, ends, doc, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """WIDTH bytes around every anchor, and how many on either side belong to its document."""
    padded = np.concatenate([np.zeros(REACH, np.uint8), raw, np.zeros(REACH + GRAM, np.uint8)])
    left, right = np.minimum(at - starts[doc], REACH), np.minimum(ends[doc] - at - GRAM, REACH)
    view = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    k = np.arange(WIDTH)
    view[(k[None, :] < (REACH - left)[:, None]) | (k[None, :] >= (REACH + GRAM + right)[:, None])] = 0
    return view, left.astype(np.uint8), right.astype(np.uint8)


def keyed(view, left, right) -> np.ndarray:
    return strings(np.concatenate([view, left[:, None] + 1, right[:, None] + 1], 1))


#: What goes with the surroundings of an anchor: its document's id and place in the chunk, its position there, bytes on either side.
ENTRY = np.dtype([("id", np.int64), ("doc", np.int32), ("at", np.int32), ("left", np.uint8), ("right", np.uint8)])


def entry(*columns) -> np.ndarray:
    """Rows of ENTRY as bytes of that width: one array is one blob to pack, whatever the number of its columns."""
    out = np.empty(len(columns[0]), ENTRY)
    for name, x in zip(ENTRY.names, columns, strict=True):
        out[name] = x
    return out.view(f"V{ENTRY.itemsize}")


def send_surroundings(n: int):
    """Chunk with its answers -> (bucket, chunk, kind, blob): entries for the index, and spans decided here."""

    def run(key, left_rows, right_rows):
        out = []
        if left_rows.num_rows and right_rows.num_rows:
            chunk = key[0].as_py()
            shared = np.sort(np.concatenate([undiff(unpack(x)[0]) for x in right_rows.column("blob").to_pylist()]))
            ids, starts, ends, raw, doc, at, h = found(left_rows.column("payload")[0].as_py())
            hit = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h
            doc, at, h = doc[hit], at[hit], h[hit]
            view, la, ra = surroundings(raw, starts, ends, doc, at)
            number, least = classes(keyed(view, la, ra), ids[doc])
            first = ids[doc] == least[number]
            rest = ~first
            if rest.any():
                out.append((chunk % n, chunk, 0, pack(doc[rest], (at - starts[doc])[rest] - la[rest], (at - starts[doc])[rest] + GRAM + ra[rest])))
            doc, at, h, view, la, ra = (x[first] for x in (doc, at, h, view, la, ra))
            b = bucket_of(h, n)
            order = np.argsort(b, kind="stable")
            edge = np.searchsorted(b[order], np.arange(n + 1))
            for k, (s, e) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                if e > s:
                    o = order[s:e]
                    out.append((k, chunk, 1, pack(entry(ids[doc[o]], doc[o], at[o] - starts[doc[o]], la[o], ra[o]), view[o].ravel())))
        tidy()
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "chunk": pa.array([x[1] for x in out], pa.int64()), "kind": pa.array([x[2] for x in out], pa.int32()), "blob": pa.array([x[3] for x in out], pa.binary())})

    return run


class Levels:
    """A logarithmic family of sorted arrays of distinct suffixes."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def holds(self, suffixes: np.ndarray) -> np.ndarray:
        """Merge-scan: which of the sorted suffixes are in some level."""
        out = np.zeros(len(suffixes), bool)
        for x in self.levels:
            out |= x[np.minimum(np.searchsorted(x, suffixes), len(x) - 1)] == suffixes
        return out

    def add(self, suffixes: np.ndarray) -> None:
        self.levels.append(suffixes)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            both = np.sort(np.concatenate([self.levels.pop(), self.levels.pop()]), kind="stable")
            self.levels.append(both[np.concatenate([[True], both[1:] != both[:-1]])])


def scan(ids: np.ndarray, view: np.ndarray, left: np.ndarray, right: np.ndarray):
    """For every entry the least and largest shift of its strings that start in an earlier document; -1 without any."""
    low, high = np.full(len(ids), LENGTH), np.full(len(ids), -1)
    order, levels = np.argsort(ids, kind="stable"), Levels()
    step = max(1, BATCH // (REACH + 1))
    s = 0
    while s < len(order):
        e = min(s + step, len(order))
        while e < len(order) and ids[order[e]] == ids[order[e - 1]]:  # a document is in one batch
            e += 1
        mine = order[s:e]
        shift = np.arange(REACH + 1)
        ok = (shift[None, :] <= left[mine][:, None]) & (REACH - shift[None, :] <= right[mine][:, None])
        row, a = np.nonzero(ok)
        windows = np.lib.stride_tricks.sliding_window_view(view[mine], LENGTH, axis=1)[row, REACH - a]
        suffixes = strings(windows)
        by = np.argsort(suffixes, kind="stable")  # the batch's suffix array; equal suffixes stay in order of entries, so of ids
        suffixes, row, a = suffixes[by], row[by], a[by]
        new = np.concatenate([[True], suffixes[1:] != suffixes[:-1]])
        group, distinct = np.cumsum(new) - 1, suffixes[new]
        earliest = ids[mine][row[new]]
        hit = (ids[mine][row] > earliest[group]) | levels.holds(distinct)[group]
        np.minimum.at(low, mine[row[hit]], a[hit])
        np.maximum.at(high, mine[row[hit]], a[hit])
        levels.add(distinct)
        s = e
    return low, high


def find_spans(rows: pa.Table) -> pa.Table:
    """One bucket -> (chunk, blob): covered spans (document, start, end) of each chunk."""
    out, entries = [], []
    for chunk, kind, blob in zip(*(rows.column(c).to_pylist() for c in ("chunk", "kind", "blob")), strict=True):
        if kind == 0:
            out.append((chunk, blob))
        else:
            entries.append((chunk, *unpack(blob)))
    if entries:
        chunk = np.repeat(np.array([e[0] for e in entries]), [len(e[1]) for e in entries])
        rows = np.concatenate([e[1] for e in entries]).view(ENTRY)
        ids, doc, at, la, ra = (np.ascontiguousarray(rows[name]).astype(kind) for name, kind in zip(ENTRY.names, (np.int64, np.int32, np.int64, np.uint8, np.uint8), strict=True))
        view = np.concatenate([e[2] for e in entries]).reshape(-1, WIDTH)
        entries.clear()
        number, least = classes(keyed(view, la, ra), ids)
        start, end = np.full(len(ids), -1), np.full(len(ids), -1)
        later = ids > least[number]
        start[later], end[later] = at[later] - la[later], at[later] + GRAM + ra[later]
        # of each class one entry of its least document is looked up, if its gram occurs in another class
        head = np.full(len(least), -1)
        early = np.flatnonzero(~later)
        head[number[early]] = early
        grams, _ = classes(strings(view[head][:, REACH : REACH + GRAM]), ids[head])
        look = head[np.bincount(grams)[grams] > 1]
        if len(look):
            low, high = scan(ids[look], view[look], la[look], ra[look])
            by_class = np.full((2, len(least)), -1)
            by_class[0, number[look]], by_class[1, number[look]] = low, high
            lo, hi = by_class[0, number[early]], by_class[1, number[early]]
            got = hi >= 0
            start[early[got]], end[early[got]] = at[early[got]] - hi[got], at[early[got]] - lo[got] + LENGTH
        k = np.flatnonzero(end >= 0)
        k = k[np.argsort(chunk[k], kind="stable")]
        for k in np.split(k, np.flatnonzero(np.diff(chunk[k])) + 1) if len(k) else []:
            out.append((int(chunk[k[0]]), pack(doc[k].astype(np.int64), start[k], end[k])))
        tidy()
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary())})


def cut(key, left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
    """Chunk with its spans -> every document with what is left of it."""
    out, carried = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}, None
    if left_rows.num_rows:
        ids, starts, ends, raw = opened(left_rows.column("payload")[0].as_py())
        carried = from_ipc(left_rows.column("carried")[0].as_py())
        edge = np.zeros(len(raw) + 1, np.int32)
        for blob in right_rows.column("blob").to_pylist():
            doc, s, e = unpack(blob)
            np.add.at(edge, starts[doc] + s, 1)
            np.add.at(edge, starts[doc] + e, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for i, s, e in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
            g = gone[s:e]
            left = raw[s:e][~g].tobytes()
            out["doc_id"].append(None if i == LAST else i)
            out["n_bytes"].append(e - s)
            out["n_removed"].append(e - s - len(left))
            out["n_spans"].append(int((np.diff(g.astype(np.int8), prepend=0) == 1).sum()))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["kept"].append(left.decode(errors="ignore"))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    tidy()
    return pa.table({n: pa.array(out[n], k) for n, k in zip(out, kinds, strict=True)} | ({} if carried is None else {"carried": carried}))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (characters cut in half fall away) of every row, and its columns named in carry, as the struct carried."""
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(8, -(-total // bucket_bytes))
    packed = written_in_buckets(chunks(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), (F.struct(*carry) if carry else F.lit(0)).alias("carried")), chunk_bytes), "dedup-chunks", "chunk", max(8, -(-total // chunk_bytes)))
    prints = packed.select("chunk", "payload").mapInArrow(send_prints(max(8, -(-n // PRINTS_WIDER))), "bucket long, chunk long, blob binary")
    answers = prints.groupBy("bucket").applyInArrow(shared_prints, "chunk long, blob binary")
    entries = packed.select("chunk", "payload").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(send_surroundings(n), "bucket long, chunk long, kind int, blob binary")
    spans = entries.groupBy("bucket").applyInArrow(find_spans, "chunk long, blob binary")
    kind = docs.select(F.struct(*carry)).schema[0].dataType.simpleString() if carry else "int"
    return packed.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, carried {kind}")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "carried")
