"""Removal of repeated substrings by a distributed, sampled suffix sort.

Sorting every suffix would move the corpus many times over. A string of `length` bytes can repeat only where the
least (by hash) of its `GRAM`-byte substrings repeats too, so only suffixes that begin at such an anchor are
sorted, each with the bytes around it that its strings can reach:

1. documents are dealt by a hash of doc_id into chunks of a bounded size, a bucketed table in the warehouse;
2. anchors' hashes are dealt by range; those found in two chunks are marked, one bit each;
3. the suffixes at marked anchors, alike ones merged within a chunk, are range-partitioned by their leading bytes and
   a hash of their chunk at splitters sampled from just these suffixes. A common anchor so covers several buckets;
4. a bucket sorts its suffixes, and the bytes before them, by multikey quicksort on 8-byte symbols. Neighbours that
   agree far enough to both sides hold the same string, and the least doc_id of such a run is its first holder;
5. runs of an anchor at which a splitter lies may go on in other buckets: every bucket sends the first holder of each
   such run, and these are compared across the boundaries, by the string itself;
6. what is found, one bit per string, goes back to the chunks, which remove bytes.

A chunk sends a suffix once however many of its documents hold it, so a passage in a third of all documents costs
as many rows as there are chunks, and these rows are spread over as many buckets as their number asks for.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at_close, delete_folder, partitions, pick, shared_path, table, utf8, written

LENGTH, GRAM = 50, 24
#: Bytes of text in a chunk (a longer document is a chunk of its own size), and positions that are handled at once.
CHUNK_BYTES, BLOCK = 2 << 20, 1 << 18
#: Buckets are as many as there are such shares of the text. Ranges, whose splitters all tasks get, have a bound; beyond
#: it a range is several buckets, by the anchor's hash, and a task has several buckets, one after another.
BUCKET_BYTES, MAX_RANGES = 8 << 20, 1 << 16
#: Splitters are sampled from about a 32nd of the chunks, these numbers at least and at most, and so many suffixes in all.
SAMPLE_CHUNKS, SAMPLE_ROWS = (16, 1024), 1 << 18
#: Chunks in a file of the bucketed table, and the most files that such a table may have.
FILE_CHUNKS, MAX_FILES = 64, 100_000
#: What a bucket is told and tells: kind 0 marks of hashes, 1 bits of strings, 2 a run's first holder in a bucket.
SIDE = "chunk long, kind int, bucket int, bits binary, place long, least long"
_FACTOR = 0x9E3779B97F4A7C15


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all substrings of this size, by doubling."""
    def join(a: np.ndarray, b: np.ndarray, la: int, lb: int) -> np.ndarray:
        n = len(data) - la - lb + 1
        return a[:n] * np.uint64(pow(_FACTOR, lb, 1 << 64)) + b[la : la + n]

    power, width, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if size & width:
            out, done = (power, width) if out is None else (join(out, power, done, width), done + width)
        if done == size:
            return out
        power, width = join(power, power, width, width), width * 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) | np.uint64(1)  # never 0


def _sliding(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    width, out = 1, values
    while width * 2 <= size:
        out, width = best(out[:-width], out[width:]), width * 2
    rest = size - width
    return best(out[: len(out) - rest], out[rest:]) if rest else out


class Chunk:
    """Documents of one chunk in order of doc_id, with their anchors."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int):
        self.ids, self.length, self.spread = ids, length, length - GRAM
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    @classmethod
    def of(cls, pdf: pd.DataFrame, length: int) -> Chunk:
        rows: list[tuple[int, bytes]] = []
        for blob in pdf["docs"]:
            rows += _unpack(blob)
        rows.sort()
        return cls(np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], length)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and hashes of all anchors, and the strings each stands for: bit j is the one that begins j before it."""
        at, hashes, strings = [], [], []
        windows = len(self.data) - self.length + 1
        for low in range(0, max(windows, 0), BLOCK):
            n = min(BLOCK, windows - low)
            v = _mixed(_rolling(self.data[low : low + n + self.length - 1], GRAM))
            least = _sliding(v, self.spread + 1, np.minimum)
            doc = np.searchsorted(self.ends, np.arange(low, low + n), side="right") if len(self.ends) < 2 else None
            if doc is None:
                first, last = np.searchsorted(self.ends, [low, low + n - 1], side="right")
                size = np.minimum(self.ends[first : last + 1], low + n) - np.maximum(self.starts[first : last + 1], low)
                limit = np.repeat(self.ends[first : last + 1], size)
            else:
                limit = self.ends[doc]
            least[np.arange(low, low + n) + self.length > limit] = 0  # strings end with their document
            wide = np.concatenate((np.zeros(self.spread, np.uint64), least, np.zeros(self.spread, np.uint64)))
            pos = np.flatnonzero(_sliding(wide, self.spread + 1, np.maximum) == v)
            val, mask = v[pos], np.zeros(len(pos), np.uint32)
            for j in range(self.spread + 1):
                mask |= (wide[pos + self.spread - j] == val).astype(np.uint32) << np.uint32(j)
            at.append(pos + low)
            hashes.append(val)
            strings.append(mask)
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return join(at, np.int64), join(hashes, np.uint64), join(strings, np.uint32)


def _pack(rows: list[tuple[int, bytes]]) -> bytes:
    ids, sizes = np.array([r[0] for r in rows], "<i8"), np.array([len(r[1]) for r in rows], "<i8")
    return zstandard.compress(np.array([len(rows)], "<i8").tobytes() + ids.tobytes() + sizes.tobytes() + b"".join(r[1] for r in rows), 3)


def _unpack(blob: bytes) -> list[tuple[int, bytes]]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    stops = 8 + 16 * n + np.cumsum(sizes)
    return [(int(i), raw[b - s : b]) for i, s, b in zip(ids, sizes.tolist(), stops.tolist())]


def _packing(most: int):
    """Rows (chunk, doc_id, text) into blobs by chunk; at most `most` bytes of text are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        size = 0
        for pdf in batches:
            for c, i, t in zip(pdf["chunk"].tolist(), pdf["doc_id"].tolist(), pdf["text"].tolist()):
                raw = bytes(t)
                held.setdefault(c, []).append((i, raw))
                size += len(raw)
                if size >= most:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    def flush(held: dict) -> pd.DataFrame:
        return pd.DataFrame({"chunk": list(held), "docs": [_pack(r) for r in held.values()]})

    return run


def _hash_rows(length: int, n_buckets: int):
    """Of a chunk, the upper 48 bits of its anchors' hashes, dealt into buckets by range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u = np.unique(_dealt(Chunk.of(pdf, length).anchors()[1]))
        buckets, cuts = np.unique(_hash_bucket(u, n_buckets), return_index=True)
        parts = [(b, u[x:y].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) for b, x, y in zip(buckets.tolist(), cuts, [*cuts[1:], len(u)])]
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]] * len(parts), "bucket": [p[0] for p in parts], "hashes": [p[1] for p in parts]})

    return run


def _dealt(hashes: np.ndarray) -> np.ndarray:
    """48 bits of anchors' hashes, mixed once more: anchors are least hashes, which would crowd the first ranges."""
    return _mixed(hashes) >> np.uint64(16)


def _hash_bucket(u: np.ndarray, n: int) -> np.ndarray:
    return ((u >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _mark(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket of hashes, per chunk a bitmap of those that another chunk has too."""
    parts = []
    for blob in pdf["hashes"]:
        wide = np.zeros((len(blob) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
        parts.append(wide.view("<u8")[:, 0])
    u = np.concatenate(parts)
    order = np.argsort(u, kind="stable")
    same = u[order][1:] == u[order][:-1]
    shared = np.zeros(len(u), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    bits = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum([len(p) for p in parts])[:-1])]
    return pd.DataFrame({"chunk": pdf["chunk"], "kind": 0, "bucket": pdf["bucket"], "bits": bits, "place": -1, "least": -1})


class Suffixes:
    """The distinct suffixes that a chunk sends: bytes around the anchor, strings, least doc_id; and who holds them."""

    def __init__(self, number: int, chunk: Chunk, marks: pd.DataFrame, n_buckets: int, splitters: np.ndarray, per_range: int = 1):
        at, hashes, strings = chunk.anchors()
        u, of = np.unique(_dealt(hashes), return_inverse=True)
        marked = np.zeros(len(u), bool)
        dealt, asked = _hash_bucket(u, n_buckets), marks["bucket"].to_numpy(np.int64)
        for x, y, bits in zip(np.searchsorted(dealt, asked), np.searchsorted(dealt, asked, side="right"), marks["bits"]):
            marked[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).astype(bool)
        doc = np.searchsorted(chunk.ends, at, side="right")
        # also those that two documents of this chunk share
        low, high = np.full(len(u), len(chunk.ids)), np.full(len(u), -1)
        np.minimum.at(low, of, doc)
        np.maximum.at(high, of, doc)
        use = (marked | (low < high))[of]
        self.at, self.strings, self.doc = at[use], strings[use], doc[use]
        rows = self._bytes(chunk)
        words = np.zeros((len(rows), (rows.shape[1] + 4 + 7) // 8 * 8), np.uint8)
        words[:, : rows.shape[1]] = rows
        words[:, -4:] = self.strings.astype(">u4")[:, None].view(np.uint8).reshape(-1, 4)
        order, group = _classes(words.view(">u8").astype(np.uint64))
        self.of = np.empty(len(order), np.int64)
        self.of[order] = group
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else group
        self.rows, self.row_strings = rows[order[first]], self.strings[order[first]]
        self.least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.of, chunk.ids[self.doc])
        self.keys = _keys(self.rows[:, chunk.spread : chunk.spread + GRAM], number)
        bucket = np.searchsorted(splitters, self.keys, side="right")
        if per_range > 1:
            bucket = bucket * per_range + (hashes[use][order[first]] >> np.uint64(1)).astype(np.int64) % per_range
        self.order = np.argsort(bucket, kind="stable")
        self.buckets, self.cuts = np.unique(bucket[self.order], return_index=True)
        self.cuts = [*self.cuts.tolist(), len(first)]

    def _bytes(self, chunk: Chunk) -> np.ndarray:
        """For each anchor, spread + GRAM + spread bytes, zero where none of its strings reaches."""
        s = chunk.spread
        width = 2 * s + GRAM
        if not len(self.at):
            return np.zeros((0, width), np.uint8)
        padded = np.concatenate((np.zeros(s, np.uint8), chunk.data, np.zeros(s, np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(padded, width)[self.at]
        lowest = np.log2((self.strings & (~self.strings + np.uint32(1))).astype(np.float64)).astype(np.int64)  # string that begins last
        highest = np.floor(np.log2(self.strings.astype(np.float64))).astype(np.int64)  # string that begins first
        col = np.arange(width)
        rows[(col < (s - highest)[:, None]) | (col >= (s - lowest + chunk.length)[:, None])] = 0
        return rows

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        for b, x, y in zip(self.buckets.tolist(), self.cuts, self.cuts[1:]):
            yield b, self.order[x:y]


def _keys(grams: np.ndarray, number: int) -> np.ndarray:
    """What suffixes are ranged by: their leading bytes, then a hash of their chunk, so that many of one anchor part too."""
    out = np.zeros((len(grams), GRAM + 8), np.uint8)
    out[:, :GRAM] = grams
    out[:, GRAM:] = _mixed(np.array([number * _FACTOR % (1 << 64)], np.uint64)).astype(">u8").view(np.uint8)
    return out.view(f"S{GRAM + 8}")[:, 0]


def _symbols(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 8-byte symbols whose order is that of the bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: order of the rows, and the number of each sorted row's class of equal rows.

    Every round parts all open segments at once into rows below, at and above the segment's pivot symbol; only the
    middle part goes on to the next symbol. Segments are closed when they hold one row or have no symbol left.
    """
    n, width = words.shape
    order = np.arange(n)
    starts, depth = np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)  # of open segments
    sizes = np.full(len(starts), n)
    edge = np.zeros(n, bool)
    edge[:1] = True
    while True:
        going = (sizes > 1) & (depth < width)
        starts, sizes, depth = starts[going], sizes[going], depth[going]
        if not len(starts):
            return order, np.cumsum(edge) - 1
        ends = np.cumsum(sizes)
        heads = ends - sizes
        seg = np.repeat(np.arange(len(starts)), sizes)
        rows = np.arange(ends[-1]) + (starts - heads)[seg]
        held = order[rows]
        symbol = words[held, depth[seg]]
        x, y, z = symbol[heads], symbol[heads + sizes // 2], symbol[ends - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[seg]
        below, above = symbol < pivot, symbol > pivot
        middle = ~(below | above)
        to, begin, parts = np.empty(len(rows), np.int64), starts, []
        for side in (below, middle, above):
            count = np.concatenate(([0], np.cumsum(side)))
            size = count[ends] - count[heads]
            to[side] = (begin[seg] + count[:-1] - count[heads][seg])[side]
            parts.append((begin, size, depth + (side is middle)))
            begin = begin + size
        order[to] = held
        starts, sizes, depth = (np.concatenate(p) for p in zip(*parts))
        edge[starts[sizes > 0]] = True


def _agreement(rows: np.ndarray) -> np.ndarray:
    """For sorted rows, how many leading bytes each has in common with the one before it (the first: -1)."""
    differs = np.ones((max(len(rows) - 1, 0), rows.shape[1] + 1), bool)
    differs[:, :-1] = rows[1:] != rows[:-1]
    return np.concatenate((np.full(min(len(rows), 1), -1), differs.argmax(1)))


def _suffix_rows(length: int, n_buckets: int, splitters: np.ndarray, per_range: int):
    def run(docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"chunk": [], "bucket": [], "suffixes": []})
        s = Suffixes(int(docs["chunk"].iloc[0]), Chunk.of(docs, length), marks, n_buckets, splitters, per_range)
        parts = [(b, zstandard.compress(s.least[i].astype("<i8").tobytes() + s.row_strings[i].astype("<u4").tobytes() + s.rows[i].tobytes(), 3)) for b, i in s.parts()]
        return pd.DataFrame({"chunk": [docs["chunk"].iloc[0]] * len(parts), "bucket": [p[0] for p in parts], "suffixes": [p[1] for p in parts]})

    return run


def _compare(length: int, splitters: np.ndarray):
    """Of a bucket of suffixes, per chunk and suffix the strings that a smaller doc_id than its least holds as well.

    Strings at an anchor at which a splitter lies and that nothing in the bucket precedes are given out besides.
    """
    spread = length - GRAM
    width = 2 * spread + GRAM
    cut = np.unique(splitters.astype(f"S{GRAM}"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        least, strings, rows = [], [], []
        for blob in pdf["suffixes"]:
            raw = zstandard.decompress(blob)
            n = len(raw) // (12 + width)
            least.append(np.frombuffer(raw, "<i8", n))
            strings.append(np.frombuffer(raw, "<u4", n, 8 * n))
            rows.append(np.frombuffer(raw, np.uint8, n * width, 12 * n).reshape(n, width))
        sizes = np.array([len(x) for x in least])
        stops = np.cumsum(sizes)
        ids, mask, text = np.concatenate(least), np.concatenate(strings), np.concatenate(rows)
        found = np.zeros(len(ids), np.uint32)
        border = np.isin(np.ascontiguousarray(text[:, spread : spread + GRAM]).view(f"S{GRAM}")[:, 0], cut)

        order, _ = multikey_order(_symbols(text[:, spread:]))
        after = _agreement(text[order, spread:])
        near = after >= GRAM
        use = near | np.concatenate((near[1:], [False])) | border[order]
        order, after = order[use], after[use]  # one that is left out agrees with no neighbour
        back, _ = multikey_order(_symbols(text[order, :spread][:, ::-1]))
        before = _agreement(text[order[back], :spread][:, ::-1])
        # per kept suffix, in order of what follows its anchor
        ids_, mask_, border_, left = ids[order], mask[order], border[order], np.empty(len(order), np.int64)
        out = []
        for j in range(spread + 1):
            own = np.flatnonzero(mask_ >> np.uint32(j) & np.uint32(1))
            if not len(own):
                continue
            right = np.cumsum(after < length - j)
            left[back] = np.cumsum(before < j)
            run_of = right[own] * (len(order) + 1) + left[own]  # alike before and after: the same string
            by = np.argsort(run_of, kind="stable")
            own, run_of = own[by], run_of[by]
            new = np.concatenate(([True], run_of[1:] != run_of[:-1]))
            first = np.minimum.reduceat(ids_[own], np.flatnonzero(new))[np.cumsum(new) - 1]
            late = first < ids_[own]
            found[order[own[late]]] |= np.uint32(1 << j)
            at = order[own[~late & border_[own]]]
            if len(at):
                blob = np.searchsorted(stops, at, side="right")
                place = (at - (stops - sizes)[blob]) * 32 + j
                out.append(pd.DataFrame({"chunk": pdf["chunk"].to_numpy()[blob], "bits": [x.tobytes() for x in text[at, spread - j : spread - j + length]], "place": place, "least": ids[at]}))
        bits = [x.astype("<u4").tobytes() for x in np.split(found, stops[:-1])]
        here = pd.DataFrame({"chunk": pdf["chunk"], "kind": 1, "bucket": pdf["bucket"], "bits": bits, "place": -1, "least": -1})
        return pd.concat([here, *[x.assign(kind=2, bucket=pdf["bucket"].iloc[0]) for x in out]])[["chunk", "kind", "bucket", "bits", "place", "least"]]

    return run


def _across(answers: DataFrame) -> DataFrame:
    """First holders of a run in their bucket, at an anchor that several buckets share, whom a holder in another bucket precedes.

    A string has at most a few such holders per bucket that its anchor covers.
    """
    first = F.min("least").over(Window.partitionBy("bits"))
    return answers.where("kind = 2").withColumn("first", first).where("first < least").select("chunk", "kind", "bucket", F.lit(None).cast("binary").alias("bits"), "place", "least")


def _classes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and classes of equal rows within a chunk, classes in any order: by a hash, if rows of one hash prove to be the same."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(len(words), np.uint64)
    for c in range(words.shape[1]):
        h = _mixed(h * np.uint64(_FACTOR) + words[:, c])
    by = np.argsort(h, kind="stable")
    new = h[by][1:] != h[by][:-1]
    if (new | (words[by][1:] == words[by][:-1]).all(1)).all():
        return by, np.concatenate(([0], np.cumsum(new)))
    return multikey_order(words)


def _remove(length: int, n_buckets: int, splitters: np.ndarray, per_range: int):
    def run(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_sizes"]
        if not len(docs):
            return pd.DataFrame({c: [] for c in columns})
        chunk = Chunk.of(docs, length)
        s = Suffixes(int(docs["chunk"].iloc[0]), chunk, side[side["kind"] == 0], n_buckets, splitters, per_range)
        earlier = np.zeros(len(s.rows), np.uint32)
        answers = dict(zip(side["bucket"][side["kind"] == 1].tolist(), side["bits"][side["kind"] == 1]))
        elsewhere = {b: g.to_numpy() for b, g in side[side["kind"] == 2].groupby("bucket")["place"]}
        for b, i in s.parts():
            earlier[i] = np.frombuffer(answers[b], "<u4")
            if b in elsewhere:
                np.bitwise_or.at(earlier, i[elsewhere[b] >> 5], np.uint32(1) << (elsewhere[b] & 31).astype(np.uint32))
        hit = s.strings & np.where(chunk.ids[s.doc] > s.least[s.of], np.uint32(0xFFFFFFFF), earlier[s.of])
        begins = np.zeros(len(chunk.data) + length, np.int32)
        for j in range(chunk.spread + 1):
            at = s.at[(hit >> np.uint32(j) & np.uint32(1)).astype(bool)] - j
            begins[at] = 1
        running = np.cumsum(begins)
        gone = running[: len(chunk.data)] - np.concatenate((np.zeros(length, np.int64), running))[: len(chunk.data)] > 0
        out = []
        for i, a, b in zip(chunk.ids.tolist(), chunk.starts.tolist(), chunk.ends.tolist()):
            lost = gone[a:b]
            if not lost.any():
                out.append((i, b - a, 0, 0, hashlib.sha256(chunk.data[a:b].tobytes()).hexdigest(), [], []))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], lost.view(np.int8), [0]))))
            starts, stops = edge[::2], edge[1::2]
            kept = chunk.data[a:b][~lost].tobytes()
            out.append((i, b - a, int(lost.sum()), len(starts), hashlib.sha256(kept).hexdigest(), starts.tolist(), (stops - starts).tolist()))
        return pd.DataFrame(out, columns=columns)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, max_ranges: int = MAX_RANGES) -> DataFrame:
    """Per row of docs what goes: doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_sizes (bytes).

    A byte goes if a string of `length` bytes over it also starts in a document of a smaller doc_id; strings are
    judged on the input. length is from 32 to 55. Texts are UTF-8 bytes, whole; a null text is empty. Rows that repeat a
    doc_id don't cause each other's removal. A row without doc_id causes none and loses nothing. Other columns
    are left out. An empty table gives an empty result. bucket_bytes, the text that a bucket stands for, and max_ranges
    change only how the work is dealt.
    """
    if not GRAM + 8 <= length <= GRAM + 31:
        raise ValueError(f"length must be from {GRAM + 8} to {GRAM + 31}")
    spark = docs.sparkSession
    d = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    known = d.where("doc_id is not null")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_chunks = max(1, -(-size // chunk_bytes))
    n = min(n_chunks, MAX_FILES, max(partitions(spark), n_chunks // FILE_CHUNKS))
    n_buckets = max(2 * min(partitions(spark), n_chunks), -(-size // bucket_bytes))
    per_range = -(-n_buckets // max_ranges)
    n_tasks = min(n_buckets, MAX_RANGES)

    packed = known.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)).alias("chunk"), "doc_id", utf8(F.col("text")).alias("text")).mapInPandas(_packing(32 << 20), "chunk long, docs binary")
    name = f"chunks_{uuid.uuid4().hex}"
    path = shared_path(spark, name)
    # dealt by the hash that buckets have: every task writes one bucket, and what follows needs no shuffle of text
    packed.repartition(n, "chunk").write.bucketBy(n, "chunk").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    at_close(lambda: spark.sql(f"drop table if exists {name}"))
    at_close(lambda: delete_folder(spark, path))
    chunks = spark.table(name)

    hashes = chunks.groupBy("chunk").applyInPandas(_hash_rows(length, n_buckets), "chunk long, bucket int, hashes binary")
    marks = written(hashes.repartition(n_tasks, "bucket").groupBy("bucket").applyInPandas(_mark, SIDE), "marks")
    splitters = _splitters(chunks, marks, length, n_buckets, -(-n_buckets // per_range), n_chunks)
    suffixes = chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInPandas(_suffix_rows(length, n_buckets, splitters, per_range), "chunk long, bucket int, suffixes binary")
    answers = written(suffixes.repartition(n_tasks, "bucket").groupBy("bucket").applyInPandas(_compare(length, splitters), SIDE), "answers")
    both = marks.unionByName(answers.where("kind = 1")).unionByName(_across(answers))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_sizes array<long>"
    out = chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(_remove(length, n_buckets, splitters, per_range), result)
    none = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("long")
    rest = d.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"), none.alias("span_starts"), none.alias("span_sizes"))
    return out.unionByName(rest)


def _splitters(chunks: DataFrame, marks: DataFrame, length: int, n_buckets: int, n_ranges: int, n_chunks: int) -> np.ndarray:
    """At most n_ranges - 1 keys that part a bounded sample of the suffixes to be sent evenly."""
    low, high = SAMPLE_CHUNKS
    of = min(n_chunks, high, max(low, n_chunks // 32))

    def sample(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"key": []})
        number = int(docs["chunk"].iloc[0])
        keys = Suffixes(number, Chunk.of(docs, length), side, n_buckets, np.empty(0, f"S{GRAM + 8}")).keys
        at = np.random.default_rng(number).permutation(len(keys))[: SAMPLE_ROWS // of]
        return pd.DataFrame({"key": [keys[a : a + 1].tobytes() for a in at.tolist()]})

    few = F.col("chunk") < of
    got = chunks.where(few).groupBy("chunk").cogroup(marks.where(few).groupBy("chunk")).applyInPandas(sample, "key binary").collect()
    keys = np.sort(np.array([bytes(r["key"]) for r in got], f"S{GRAM + 8}"))
    if not len(keys):
        return keys
    return np.unique(keys[[len(keys) * i // n_ranges for i in range(1, n_ranges)]])


#: Strings as hexadecimal digits; texts are taken in blocks first, as a long one would be walked from its start for every string.
ORACLE_SQL = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, length(h) // 2 as n from d),
blocks as (select doc_id, n, base, substr(h, 2 * base + 1, 2098) as b from (select *, unnest(range(0, n, 1000)) as base from n)),
strings as (select doc_id, base + i as pos, substr(b, 2 * i + 1, 100) as s from (select *, unnest(range(0, 1000)) as i from blocks) where base + i + 50 <= n),
hits as (select doc_id, pos from (select doc_id, pos, min(doc_id) over (partition by s) as first from strings) where first < doc_id),
opens as (select *, case when pos <= lag(pos) over (partition by doc_id order by pos) + 50 then 0 else 1 end as opens from hits),
runs as (select doc_id, min(pos) as a, max(pos) + 50 as z from (select *, sum(opens) over (partition by doc_id order by pos) as run from opens) group by doc_id, run),
parts as (select doc_id, coalesce(lag(z) over w, 0) as kept_from, a as kept_to, z - a as gone from runs window w as (partition by doc_id order by a)
  union all select n.doc_id, coalesce(max(z), 0), n.n, 0 from n left join runs on runs.doc_id = n.doc_id group by n.doc_id, n.n)
select doc_id, any_value(n) as n_bytes, cast(sum(gone) as bigint) as n_removed, count(*) - 1 as n_spans,
  sha256(unhex(string_agg(substr(h, 2 * kept_from + 1, 2 * (kept_to - kept_from)), '' order by kept_from, kept_to))) as kept_sha256
from parts join n using (doc_id) group by doc_id
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
