"""SentencePiece encoding and decoding over a relational lattice.

Words (a blank mark and the characters after it) are exploded into their substrings of
bounded length, equi-joined to the piece table, and each word's edges are grouped and
folded by Spark's higher-order ``aggregate``.

The model file holds a byte-pair vocabulary. There the best path by summed scores, as
plain Viterbi finds it, is not the encoding; so the fold visits the lattice's edges in
merge order, and keeps the path as a bit mask of word positions: an edge is taken when
just one boundary is left inside it. ``Pieces.prove`` shows offline that one pass in
that order is enough, by merging every piece's own text: its last two parts always
come earlier than itself. Pieces that their own text doesn't merge to never occur and
stay out of the table. Words of more than MASK_CHARS characters, and runs of blanks,
are merged by a heap of pairs instead, one word at a time.

Chunks of CHUNK_BYTES of text (their distinct words, and texts as numbers of words) are
written once in hash buckets. Words are counted by chunks; the KNOWN words at most that
most chunks hold are folded once a corpus and sent to all tasks (bounded by KNOWN words of
MASK_CHARS characters), every other word is folded once a chunk, beside its chunk: no text
and no mask is shuffled. Texts are composed and compared SLAB units at a time.

Defined results: null and empty texts have no pieces; characters outside the
vocabulary become their UTF-8 bytes' pieces; repeated rows are encoded each; decoding
gives the text back, byte for byte. A blank mark (U+2581) in a text counts as a blank,
as in the library, and comes back as one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, small_batches, spread, table, tidy, written, written_in_buckets
from .suffix_dedup import pack, unpack

MARK = "▁"
MASK_CHARS = 60
CHUNK_BYTES = 4_000_000
#: Words that are folded once a corpus, at most; and steps of a doubling in which their least count is sought.
KNOWN, STEPS = 1 << 18, 16
#: Units of a text that are composed at once, and units that a chunk holds as Python strings.
SLAB, HELD = 1_000_000, 200_000
#: Masks whose cuts a worker remembers.
CUTS = 1 << 16


class Pieces:
    """A byte-pair piece table."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text, self.score, self.byte = {}, {}, {}
        self.bytes: list[bytes] = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                self.bytes.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.text[p], self.score[p] = i, sp.get_score(i)
                self.bytes.append(p.replace(MARK, " ").encode())
        several = [p for p in self.text if len(p) > 1]
        if any(MARK in p[1:] and p.strip(MARK) for p in several):
            raise ValueError("a piece holds a blank mark behind another character")
        words = [p for p in several if p.strip(MARK)]
        self.core = {c for p in words for c in p if c != MARK}
        self.longest = max(map(len, words))
        order = sorted(words, key=lambda p: -self.score[p])
        self.rank = {p: k for k, p in enumerate(order)}
        self.edges = self.prove(order)
        self.whole = set(self.edges)
        self.raw = {t: array("i", [i]).tobytes() for t, i in self.text.items()}
        self.cuts: dict[int, list[slice]] = {}
        self.units = self._units()
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def _units(self) -> re.Pattern:
        """Cuts that no merge can cross: before a blank mark, around characters of no longer piece, and, if no piece holds a letter beside another character, between those."""
        quoted = lambda cs: "".join(map(re.escape, sorted(cs)))
        core, letters = quoted(self.core), {c for c in self.core if c.isalpha()}
        mixed = any(a.isalpha() != b.isalpha() for w in self.edges for a, b in zip(w, w[1:], strict=False) if MARK not in (a, b))
        runs = [core] if mixed else [quoted(letters), quoted(self.core - letters)]
        return re.compile("|".join(f"{MARK}*[{r}]+" for r in runs if r) + f"|{MARK}+|[^{core}{MARK}]", re.S)

    def parts(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merges of a word by a heap of pairs: best score first, then leftmost; and the last merge's two parts."""
        sym: list[str | None] = list(word)
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap, last = [], None

        def push(i):
            j = right[i]
            if j >= 0 and sym[i] + sym[j] in self.score:
                heapq.heappush(heap, (-self.score[sym[i] + sym[j]], i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue
            last = (a, b)
            sym[i], sym[j] = a + b, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [s for s in sym if s is not None], last

    def prove(self, order: list[str]) -> list[str]:
        """Pieces that occur, in merge order; fails unless each one's last two parts come before it."""
        out = []
        for p in order:
            got, last = self.parts(p)
            if got == [p]:
                if any(len(x) > 1 and self.rank[x] >= self.rank[p] for x in last):
                    raise ValueError(f"one pass in merge order is not enough for {p!r}")
                out.append(p)
        return out

    def char(self, c: str) -> list[int]:
        return [self.text[c]] if c in self.text else [self.byte[b] for b in c.encode()]

    def ids(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([self.text[p]] if p in self.text else self.char(p))]

    def run(self, n: int) -> list[int]:
        return self.ids(self.parts(MARK * n)[0])

    def word_ids(self, word: str, mask: int | None) -> list[int]:
        """A word's ids from the folded mask; without one from its characters, or the heap if it's too long."""
        if word in self.whole:
            return [self.text[word]]
        if len(word) > MASK_CHARS:
            return self.ids(self.parts(word)[0])
        if mask is None:
            return [i for c in word for i in self.char(c)]
        out, a, mask = [], 0, mask >> 1
        while mask:  # the next boundary is the lowest bit
            step = (mask & -mask).bit_length()
            piece = word[a : a + step]
            i = self.text.get(piece)
            out += [i] if i is not None else self.char(piece)
            a, mask = a + step, mask >> step
        return out

    def cut(self, mask: int) -> list[slice]:
        """Where a mask cuts its word; words of one shape share it."""
        got = self.cuts.get(mask)
        if got is None:
            at = [k for k in range(mask.bit_length()) if mask >> k & 1]
            got = [slice(a, b) for a, b in zip(at, at[1:], strict=False)]
            if len(self.cuts) >= CUTS:
                self.cuts.clear()
            self.cuts[mask] = got
        return got

    def split(self, text: str) -> list[str]:
        return self.units.findall(MARK + text.replace(" ", MARK)) if text else []

    def word_of(self, unit: str) -> str:
        """The part of a unit that goes to the lattice: one mark at most, then characters."""
        if unit[:2] != MARK + MARK:
            return unit if unit != MARK else ""
        bare = unit.lstrip(MARK)
        return (MARK + bare if len(bare) < len(unit) else bare) if bare else ""

    def to_fold(self, units: pa.Array) -> pa.Array:
        """The distinct words of these distinct units that the lattice decides, sorted."""
        spaced = pc.starts_with(units, MARK * 2)
        words = pc.filter(units, pc.invert(spaced))
        if behind := {self.word_of(u) for u in pc.filter(units, spaced).to_pylist()}:
            words = pc.unique(pa.concat_arrays([words, pa.array(sorted(behind), pa.string())]))
        size = pc.utf8_length(words)
        fit = pc.and_(pc.and_(pc.greater(size, 1), pc.less_equal(size, MASK_CHARS)), pc.is_in(pc.utf8_slice_codeunits(words, -1), pa.array(sorted(self.core), pa.string())))
        words = pc.filter(words, pc.and_not(fit, pc.is_in(words, pa.array(self.edges, pa.string()))))
        return words.take(pc.sort_indices(words))

    def unit_ids(self, unit: str, mask: int | None, got: list[int] | None = None) -> list[int]:
        """A unit's ids; got: its word's ids, if they are known."""
        word = self.word_of(unit)
        more = len(unit) - len(word)
        if not word:
            return self.run(len(unit))
        got = got or (self.word_ids(word, mask) if word[-1] in self.core else [i for c in word for i in self.char(c)])
        if more:
            got = self.run(more + 1) + got[1:] if got[0] == self.text.get(MARK) else self.run(more) + got
        return got

    def decode(self, ids) -> bytes:
        """The text of ids; the first blank is the one that encoding put there."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def chunks(docs: DataFrame, path: str, size: int) -> DataFrame:
    """(chunk, payload, words): documents as numbers of units, the distinct units, and the words to fold, by lines."""

    def run(batches):
        p, part, seq = pieces(path), TaskContext.get().partitionId(), 0
        ids, n_units, seen, mine, held = [], [], [], [], 0

        def settle():
            seen.append(pa.array(mine, pa.string()))
            mine.clear()

        def row():
            settle()
            coded = pa.chunked_array(seen, pa.string()).dictionary_encode()
            units = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
            number = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in coded.chunks)])
            order = np.argsort(-np.bincount(number, minlength=len(units)), kind="stable")  # frequent units get small numbers
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            names = units.take(pa.array(order))
            words = p.to_fold(names)
            null = np.array([i is None for i in ids], bool)
            sizes, raw = pc.binary_length(names).to_numpy().astype(np.int64), names.cast(pa.binary()).buffers()[2]
            body = pack(np.array([i or 0 for i in ids], np.int64), null, np.array(n_units, np.int64), place[number], sizes, np.frombuffer(raw or b"", np.uint8)[: sizes.sum()])
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([body], pa.binary()), pa.array(["\n".join(words.to_pylist())])], names=["chunk", "payload", "words"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = p.split(t or "")
                ids.append(i)
                n_units.append(len(got))
                mine += got
                held += len(t or "")
                if len(mine) >= HELD:
                    settle()
                if held >= size:
                    yield row()
                    seq, ids, n_units, seen, held = seq + 1, [], [], [], 0
        if ids:
            yield row()
        tidy()

    return docs.mapInArrow(run, "chunk long, payload binary, words string")


def piece_table(spark, p: Pieces) -> DataFrame:
    """(piece, rank) of the pieces that occur; as many rows as the vocabulary has at most."""
    return spark.createDataFrame(list(enumerate(p.edges)), "rank int, piece string")


def fold(edges: Column) -> Column:
    """Mask of the boundaries that are left in a word. edges: ((rank * 64 + start) * 64 + end) * 64 + the word's characters, sorted, one at least."""
    one = F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, k)

    def step(mask, x):
        end, start = (F.shiftright(x, k).bitwiseAND(F.lit(63)).cast("int") for k in (6, 12))
        inside = (bit(end) - bit(start + 1)).bitwiseAND(mask)
        take = (mask.bitwiseAND(bit(start)) != 0) & (mask.bitwiseAND(bit(end)) != 0) & (F.bit_count(inside) == 1)
        return F.when(take, mask.bitwiseXOR(inside)).otherwise(mask)

    return F.aggregate(edges, bit(edges[0].bitwiseAND(F.lit(63)).cast("int") + 1) - one, step)


def masks(words: DataFrame, table: DataFrame, longest: int, key: list[str]) -> DataFrame:
    """key and mask: the lattice of every word with an edge. words: key and word."""
    at = words.select(*key, F.col("word").alias("of"), F.length("word").alias("n")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 2)))
    at = at.withColumn("l", F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), F.col("n") - F.col("s")))))
    sub = at.select(*key, "n", "s", (F.col("s") + F.col("l")).alias("e"), F.substring("of", F.col("s") + 1, F.col("l")).alias("sub"))
    edges = sub.join(F.broadcast(table), sub["sub"] == table["piece"])  # the vocabulary
    edge = ((F.col("rank").cast("long") * 64 + F.col("s")) * 64 + F.col("e")) * 64 + F.col("n")
    lattice = edges.select(*key, edge.alias("edge")).groupBy(*key).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    return lattice.select(*key, fold(F.col("edges")).alias("mask"))


class Known:
    """Masks of words that many chunks hold (0: no edge); in a worker, a word's mask gives way to its ids once it is met."""

    def __init__(self, words: list[str], masks: np.ndarray):
        self.sent, self.held = pack(np.frombuffer("\n".join(words).encode(), np.uint8), masks), None

    def open(self) -> None:
        if self.held is None:
            words, masks = unpack(self.sent)
            self.held = dict(zip(words.tobytes().decode().split("\n"), masks.tolist(), strict=False))

    def ids(self, p: Pieces, unit: str, own: dict[str, int]) -> bytes:
        """A unit's ids as int32 bytes; own: masks of the words that only its chunk folds."""
        got = self.held.get(unit)
        if isinstance(got, bytes):
            return got
        raw = p.raw
        out = raw[unit] if unit in p.whole else None
        if out is None and (mask := got or own.get(unit)):
            try:
                out = b"".join([raw[unit[at]] for at in p.cuts.get(mask) or p.cut(mask)])
            except KeyError:  # a character outside the vocabulary
                out = None
        if out is not None:
            if got is not None:
                self.held[unit] = out
            return out
        word = p.word_of(unit)
        mask = self.held.get(word)
        met = np.frombuffer(mask, np.int32).tolist() if isinstance(mask, bytes) else None  # blanks before a word that was met
        out = array("i", p.unit_ids(unit, (mask or None) if mask is not None else own.get(word), met)).tobytes()
        if got is not None:
            self.held[unit] = out
        return out


def known_words(lines: DataFrame, limit: int) -> DataFrame:
    """(known): the words that most chunks hold, limit at most; words of one chunk are left to it."""
    words = lines.select(F.explode(F.split("words", "\n")).alias("known"))
    level = F.floor(F.log2("chunks") * STEPS).cast("int")
    counted = written(words.groupBy("known").agg(F.count("*").alias("chunks")).where("chunks > 1").select("known", level.alias("level")), "piece-counts")
    sizes = sorted(counted.groupBy("level").count().collect(), reverse=True)  # a row for each sixteenth of a doubling
    held = np.cumsum([r["count"] for r in sizes])
    least = min((r["level"] for r, n in zip(sizes, held, strict=True) if n <= limit), default=1 << 30)
    return counted.where(F.col("level") >= least).select("known")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_BYTES, keep_ids: bool = True, known: int = KNOWN) -> DataFrame:
    """doc_id, n_pieces, ids (on demand), ids_sha256 (of little-endian int32) and round_trip, decoded_sha256 of every row."""
    small_batches(docs.sparkSession)
    spark = beside(docs.sparkSession, {"spark.sql.execution.useObjectHashAggregateExec": "false"})  # edges are sorted by word once, not gathered, spilled and sorted
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    packed = written_in_buckets(chunks(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), path, size), "piece-chunks", "chunk", max(8, -(-total // size)), spark)
    p = pieces(path)
    vocabulary = piece_table(spark, p)
    lines = packed.where("words <> ''").select(F.col("chunk").alias("c"), "words")
    often = known_words(lines, known)
    folded = masks(often.select(F.col("known").alias("at"), F.col("known").alias("word")), vocabulary, p.longest, ["at"])
    table = often.join(folded, often["known"] == folded["at"], "left").select("known", F.coalesce("mask", F.lit(0)).alias("mask")).toArrow()  # known rows at most
    sent = spark.sparkContext.broadcast(Known(table["known"].to_pylist(), table["mask"].to_numpy()))
    del table
    words = lines.select("c", F.posexplode(F.split("words", "\n")).alias("w", "word"))
    rest = words.join(F.broadcast(often), words["word"] == often["known"], "left_anti")  # limit rows at most
    lattice = masks(rest, vocabulary, p.longest, ["c", "w"])

    def compose(key, left, right):
        of, often = pieces(path), sent.value
        often.open()
        out = {k: [] for k in ("doc_id", "n_pieces", "ids", "ids_sha256", "round_trip", "decoded_sha256")}
        for payload, lines in zip(right.column("payload").to_pylist(), right.column("words").to_pylist(), strict=True):
            ids, null, n_units, numbers, lengths, raw = unpack(payload)
            cuts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            raw = raw.tobytes()
            names = [raw[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]
            listed = lines.split("\n")
            own = {listed[w]: m for w, m in zip(left.column("w").to_pylist(), left.column("mask").to_pylist(), strict=True)}
            each = [often.ids(of, u, own) for u in names]
            shown = [u.replace(MARK, " ").encode() for u in names]
            pieces_of, bytes_of = Runs(each, np.int32), Runs(shown, np.uint8)
            stop = np.cumsum(n_units).tolist()
            for i, z, a, b in zip(ids.tolist(), null.tolist(), [0, *stop], stop, strict=False):
                digest, text, same, held, first = hashlib.sha256(), hashlib.sha256(), True, [], True
                n = 0
                for s in range(a, b, SLAB):
                    mine = numbers[s : min(s + SLAB, b)]
                    got = pieces_of.of(mine)
                    decoded = of.flat[spread(of.start[got], of.start[got] + of.size[got])[0]]
                    want = bytes_of.of(mine)
                    if first:  # the blank that encoding put there
                        decoded, want, first = decoded[1:] if decoded[:1] == 32 else decoded, want[1:], False
                    same = same and np.array_equal(decoded, want)
                    digest.update(got.tobytes())
                    text.update(decoded.tobytes())
                    n += len(got)
                    if keep_ids:
                        held.append(got)
                out["doc_id"].append(None if z else i)
                out["n_pieces"].append(n)
                out["ids"].append(np.concatenate([np.zeros(0, np.int32), *held]) if keep_ids else None)
                out["ids_sha256"].append(digest.hexdigest())
                out["round_trip"].append(same)
                out["decoded_sha256"].append(text.hexdigest())
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.bool_(), pa.string())
        tidy()
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    right = packed.groupBy("chunk")
    return lattice.groupBy("c").cogroup(right).applyInArrow(compose, "doc_id long, n_pieces long, ids array<int>, ids_sha256 string, round_trip boolean, decoded_sha256 string")


class Runs:
    """Byte strings as one array of items, to be strung together by number."""

    def __init__(self, each: list[bytes], kind):
        self.flat = np.frombuffer(b"".join(each), kind)
        size = np.fromiter(map(len, each), np.int64, len(each)) // np.dtype(kind).itemsize
        self.end = np.cumsum(size)
        self.start = self.end - size

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.start[numbers], self.end[numbers])[0]]


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with their text, as ``decoded``: the pieces' bytes in order, without the blank that encoding put in front."""
    p = pieces(path)
    sent = encoded.sparkSession.sparkContext.broadcast(p.bytes)

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        def one(x):
            b = b"".join(map(sent.value.__getitem__, x)) if x is not None else b""
            return (b[1:] if b[:1] == b" " else b).decode(errors="replace")

        return pd.Series([one(x) for x in ids])

    return encoded.withColumn("decoded", text(F.col(ids_col)))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False).drop("ids")
