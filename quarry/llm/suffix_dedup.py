"""Removal of repeated substrings by an external suffix sort.

Every string of `length` bytes that starts anywhere else too marks its bytes; marked bytes go. Strings are judged on
the input, overlaps count, and matches stay inside documents.

Sharding. Each start p has an anchor: the least hash of a K-byte gram inside p's string (leftmost on ties). Equal
strings have equal anchors, so starts are partitioned by anchor and shards are independent and exact. Neighbouring
starts with one anchor form a run, sent as a digest of its bytes. Runs equal in whole to another one are settled by
the digest's count, after partial aggregation, so a third of all rows being copies costs one row per partition. Only
runs that differ under a shared anchor go on as bytes, one example of each.

Suffix sort. A shard's runs are joined, with a separator each, and sorted by induction: suffixes are L or S; the sorted
leftmost S suffixes come from naming their substrings and sorting the reduced text the same way one level down (by
prefix doubling once names are many), up to the depth that matters, `length`. Then L suffixes are induced from left to
right and S suffixes from right to left through a monotone priority queue keyed by first byte and arrival: one queue
of blocks per byte, whose items are (position, common prefix with the item before). Common prefixes come along: two
neighbours in a queue share one byte plus the least common prefix between the suffixes that induced them. Blocks beyond
the memory limit go to files in the shared folder until their turn. A shard ends at the first anchor beyond SHARD
bytes; its text and its S ranks stay in memory, about 40 bytes for each of its bytes. Of a shard only the starts whose
string's hash occurs twice are sorted, and of equal stretches of them one example; a hash shared by chance costs time
only, since the sort compares bytes. An anchor whose own runs exceed
SHARD bytes isn't sorted: each of its starts goes as the 128-bit digest of its string to the partition of that digest,
where equal neighbours are found in a stream, so no anchor needs more memory than two shards.

Null text is empty. Texts shorter than `length` keep everything. Rows that repeat doc_id and text are two places, so
each repeats the other. Null doc_ids are an id like any other here. No byte is exempt: line ends and zero bytes match.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import local_path, shared_dir, text_hash, written
from quarry.llm.model_text import texts

LENGTH = 400
#: Bytes of an anchor gram.
K = 64
#: Bytes of runs that a shard takes before it is sorted, and of queue blocks that stay in memory.
SHARD = 4 << 20
MEMORY = 256 << 20


# -- anchors and runs ----------------------------------------------------------------------------------------------


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes from each place, by doubling."""
    h, base, size = b.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    while size < K:
        with np.errstate(over="ignore"):
            h = h[:-size] * base + h[size:]
            base = base * base
        size *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours, by doubling."""
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, number of starts, whether several places carry the anchor) of a text's runs."""
    if len(b) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(bool)
    out: list[tuple[np.ndarray, ...]] = []
    most, n = 1 << 21, len(b) - length + 1
    for at in range(0, n, most):  # long texts in parts; a run that crosses a border is two, on both sides alike or not at all
        part = b[at : min(len(b), at + most + length - 1)]
        h = _gram_hashes(part)
        place = np.arange(len(h), dtype=np.uint64)
        low = _window_min((h & ~np.uint64(0x3FFFFF)) | place, length - K + 1)
        anchor = h[(low & np.uint64(0x3FFFFF)).astype(np.int64)]
        edge = np.flatnonzero(np.diff(anchor)) + 1
        first = np.concatenate(([0], edge))
        count = np.diff(np.append(first, len(anchor)))
        moved = np.concatenate(([0], np.cumsum(np.diff(low) != 0)))
        several = moved[first + count - 1] != moved[first]
        out.append((anchor[first].view(np.int64), first + at, count, several))
    return tuple(np.concatenate(c) for c in zip(*out))


def run_table(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, th, anchor, digest, start, n, several: one row per run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches, 1 << 20):
            cols: list[list] = [[] for _ in range(7)]
            for doc, th, text in zip(batch["doc_id"].to_pylist(), batch["th"].to_pylist(), own):
                data = text.encode("utf-8", "surrogatepass")
                anchor, first, count, several = runs(np.frombuffer(data, np.uint8), length)
                if not len(anchor):
                    continue
                view = memoryview(data)
                digest = [xxhash.xxh3_64_intdigest(view[s : s + c + length - 1]) for s, c in zip(first.tolist(), count.tolist())]
                for c, v in zip(cols, ([doc] * len(first), [th] * len(first), anchor, np.array(digest, np.uint64).view(np.int64), first, count, several)):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 6 + (pa.bool_(),))],
                names=["doc_id", "th", "anchor", "digest", "start", "n", "several"],
            )

    narrow = docs.select("doc_id", "text", text_hash(F.col("text")).cast("long").alias("th"))
    return narrow.mapInArrow(run, "doc_id long, th long, anchor long, digest long, start long, n long, several boolean")


# -- suffix sort ----------------------------------------------------------------------------------------------------


class Queue:
    """A monotone priority queue: items leave by first byte, then in the order of arrival. Blocks beyond `memory` bytes
    lie in a file of the scratch folder until their turn."""

    def __init__(self, scratch: str | None, memory: int):
        self.blocks: list[list] = [[] for _ in range(258)]
        self.held, self.memory, self.scratch, self.file = 0, memory, scratch, None

    def push(self, key: int, place: np.ndarray, lcp: np.ndarray) -> None:
        if not len(place):
            return
        if self.held + place.nbytes + lcp.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=self.scratch)
            at = self.file.seek(0, os.SEEK_END)
            self.file.write(place.tobytes())
            self.file.write(lcp.tobytes())
            self.blocks[key].append((at, len(place), place.dtype, lcp.dtype))
        else:
            self.held += place.nbytes + lcp.nbytes
            self.blocks[key].append((place, lcp))

    def pop(self, key: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """All blocks of a key, in order of arrival."""
        out = []
        for block in self.blocks[key]:
            if len(block) == 2:
                self.held -= block[0].nbytes + block[1].nbytes
                out.append(block)
            else:
                at, n, kind, small = block
                self.file.seek(at)
                out.append((np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(n * small.itemsize), small)))
        self.blocks[key] = []
        return out


Sorted = list[tuple[np.ndarray, np.ndarray]]
KEYS = 258  # the end (0), the separator (1), and the bytes plus 2
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _induce(text: np.ndarray, run: np.ndarray, seeds: Sorted, wanted: np.ndarray, depth: int, down: bool, queue: Queue) -> Sorted:
    """What the seeds induce, by first byte, as (positions, common prefixes with the item before) in scan order.

    A scanned suffix i induces i - 1 where wanted. Within a byte's bucket the queue comes first, then the seeds: going
    up these are the L suffixes and the leftmost S ones, going down, with all orders reversed, S and L.
    """
    out: Sorted = []
    filled = np.zeros(KEYS, bool)
    gap = np.zeros(KEYS, np.int32)

    def scan(place: np.ndarray, lcp: np.ndarray) -> None:
        before = np.maximum(place - 1, 0)
        target = text[before]
        ok = np.flatnonzero(wanted[before] & (place > 0))
        ok = ok[np.argsort(target[ok], kind="stable")]  # hits by target, each in scan order
        edge = np.append(0, np.flatnonzero(np.diff(target[ok])) + 1) if len(ok) else np.zeros(0, np.int64)
        rest_gap = np.minimum(gap, lcp.min())
        for lo, hi in zip(edge, np.append(edge[1:], len(ok))):
            hit = ok[lo:hi]
            c = int(target[hit[0]])
            share = np.minimum.reduceat(lcp[: hit[-1] + 1], np.append(0, hit[:-1] + 1))
            share[0] = min(share[0], gap[c])
            share = np.minimum(share + np.int32(1), np.int32(depth))
            if not filled[c]:
                share[0], filled[c] = 0, True
            rest = lcp[hit[-1] + 1 :]
            rest_gap[c] = rest.min() if len(rest) else depth
            queue.push(c, before[hit], share)
        gap[:] = rest_gap

    for c in range(KEYS - 1, -1, -1) if down else range(KEYS):
        gap[:] = 0  # suffixes with different first bytes share nothing
        got, tail = [], None
        while blocks := queue.pop(c):
            place, lcp = (np.concatenate(x) for x in zip(*blocks))
            got.append((place, lcp))
            scan(place, lcp)
            tail = place[-1]
        place, lcp = seeds[c]
        if len(place):
            lcp = lcp.copy()
            lcp[0] = 0 if tail is None else min(run[tail], run[place[0]], depth)
            scan(place, lcp)
        out.append(tuple(np.concatenate(x) for x in zip(*got)) if got else _NONE)
    return out


def _runs_of_one(text: np.ndarray) -> np.ndarray:
    """How often each place's value is repeated from there on."""
    edge = np.append(np.flatnonzero(np.diff(text)) + 1, len(text))
    return edge[np.searchsorted(edge, np.arange(len(text)), side="right")] - np.arange(len(text))


def _s_types(text: np.ndarray) -> np.ndarray:
    """Whether the suffix from each place is smaller than the next one; the last one is."""
    n = len(text)
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(np.diff(text.astype(np.int32)))
    decided = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _refined(rank: np.ndarray, key: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (the number of smaller items) refined by key among the tied items; the items that are tied still."""
    order = tied[np.lexsort((key, rank[tied]))]
    by = np.empty(len(rank), np.int64)
    by[tied] = key
    r, k, i = rank[order], by[order], np.arange(len(order))
    group = np.append(True, r[1:] != r[:-1])
    new = group | np.append(True, k[1:] != k[:-1])
    first = np.maximum.accumulate(np.where(new, i, 0))
    rank[order] = r + first - np.maximum.accumulate(np.where(group, i, 0))
    alone = new & np.append(new[1:], True)
    return rank, order[~alone]


def _sort_lms(text: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """The order of the leftmost S suffixes, as far as depth: name their substrings, then double over the names."""
    size = np.append(np.diff(lms), 0) + 1
    padded = np.concatenate((text.astype(np.int64), np.zeros(8, np.int64)))
    rank, tied = np.zeros(len(lms), np.int64), np.arange(len(lms))
    for at in range(0, depth + 1, 6):
        part = tied
        if not len(part) or at and not (size[part] > at).any():
            break
        key = np.zeros(len(part), np.int64)
        for k in range(at, at + 6):  # 9 bits a value; past its end a substring counts as greatest
            key = (key << 9) | np.where(k < size[part], padded[np.minimum(lms[part] + k, len(text))], 511)
        rank, tied = _refined(rank, key, part)
    width = 1
    while len(tied) and width <= depth:
        at = tied + width
        rank, tied = _refined(rank, np.where(at < len(lms), rank[np.minimum(at, len(lms) - 1)] + 1, 0), tied)
        width *= 2
    return np.argsort(rank, kind="stable")


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths of the suffixes a and b, four values at a time, up to depth."""
    t = np.concatenate((text.astype(np.uint64), np.zeros(depth + 8, np.uint64)))
    four = t[:-3] | (t[1:-2] << np.uint64(16)) | (t[2:-1] << np.uint64(32)) | (t[3:] << np.uint64(48))
    out, left = np.zeros(len(a), np.int64), np.arange(len(a))
    for at in range(0, depth, 4):
        x = four[a[left] + at] ^ four[b[left] + at]
        same = x == 0
        out[left[same]] += 4
        for k in range(3):
            out[left[~same]] += (x[~same] & np.uint64((1 << (16 * (k + 1))) - 1)) == 0
        left = left[same]
        if not len(left):
            break
    return np.minimum(out, depth).astype(np.int32)


def suffix_sort(text: np.ndarray, depth: int, scratch: str | None = None, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes of text in order, and what each shares with the one before, both as far as depth.

    text: values below KEYS, of which the last is 0 and no other.
    """
    s_type, run = _s_types(text), _runs_of_one(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    lms = lms[_sort_lms(text, lms, depth)] if len(lms) > 1 else lms
    share = np.append(np.int32(0), _common(text, lms[:-1], lms[1:], depth)) if len(lms) else np.zeros(0, np.int32)
    at = np.searchsorted(text[lms], np.arange(KEYS + 1))
    seeds = [(lms[i:j], share[i:j]) for i, j in zip(at[:-1], at[1:])]
    large = _induce(text, run, seeds, ~s_type, depth, False, Queue(scratch, memory))
    back = [(p[::-1], np.append(np.int32(0), q[:0:-1])) if len(p) else _NONE for p, q in large]
    small = _induce(text, run, back, s_type, depth, True, Queue(scratch, memory))[::-1]
    order, lcp = [np.array([len(text) - 1])], [np.array([0])]
    for (p, q), (r, t) in zip(large, small):
        if len(p):
            order.append(p), lcp.append(np.append(0, q[1:]))
        if len(r):
            head = min(run[p[-1]], run[r[-1]], depth) if len(p) else 0
            order.append(r[::-1]), lcp.append(np.append(head, t[:0:-1]))
    return np.concatenate(order), np.concatenate(lcp)


def _window_hashes(b: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each place, by doubling; in blocks that stay in the cache."""
    out, most = [np.zeros(0, np.uint64)], 1 << 15
    for at in range(0, len(b) - length + 1, most):
        h = b[at : at + most + length - 1].astype(np.uint64) + np.uint64(1)
        base, size, done, whole = np.uint64(0x9E3779B97F4A7C15), 1, 0, None
        with np.errstate(over="ignore"):
            while True:
                if length & size:
                    whole = h if whole is None else whole[: len(h) - done] * base + h[done:]
                    done += size
                if 2 * size > length:
                    break
                h = h[:-size] * base + h[size:]
                base, size = base * base, 2 * size
        out.append(whole[: len(b) - length + 1 - at])
    return np.concatenate(out)


def repeated_starts(parts: list[bytes], length: int, scratch: str | None = None) -> np.ndarray:
    """Which places of the parts, one after the other with a separator after each, start a string that starts elsewhere too.

    A start whose string's hash no other has is left out. The others form stretches; equal ones repeat each other, which
    their bytes show. Stretches that are there once are sorted, with one example of each other that shares a hash with them.
    """
    b = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    end = np.cumsum(size)
    out = np.zeros(len(b) + len(parts) + 1, bool)
    place = np.concatenate([np.arange(e - n, e - length + 1) for e, n in zip(end.tolist(), size.tolist())] or [np.zeros(0, np.int64)])
    if not len(place):
        return out
    h = _window_hashes(b, length)[place]
    order = np.argsort(h)
    new = np.append(True, h[order][1:] != h[order][:-1])
    name = np.empty(len(h), np.int64)  # of a start's hash
    name[order] = np.cumsum(new) - 1
    again = (np.bincount(name) > 1)[name]
    place, name = place[again], name[again]
    if not len(place):
        return out
    part = np.searchsorted(end, place, side="right")
    first = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(part) != 0)))
    last = np.append(first[1:], len(place)) - 1
    alike: dict[bytes, list[int]] = {}
    for k, (lo, hi) in enumerate(zip(place[first].tolist(), place[last].tolist())):
        alike.setdefault(b[lo : hi + length].tobytes(), []).append(k)
    found = np.zeros(len(place), bool)
    alone = np.zeros(len(h), bool)  # whether a hash occurs in a stretch that is there once
    for ks in alike.values():
        for k in ks:
            if len(ks) > 1:
                found[first[k] : last[k] + 1] = True
            else:
                alone[name[first[k] : last[k] + 1]] = True
    wanted = np.logical_or.reduceat(alone[name], first)
    sort = [(data, ks) for data, ks in alike.items() if wanted[ks[0]]]
    if sort:
        text = np.concatenate([x for data, _ in sort for x in (np.frombuffer(data, np.uint8).astype(np.uint16) + 2, np.ones(1, np.uint16))] + [np.zeros(1, np.uint16)])
        ranked, lcp = suffix_sort(text, length, scratch, MEMORY if scratch else 1 << 62)
        same = lcp >= length
        hit = np.zeros(len(text), bool)
        hit[ranked[same]] = True
        hit[ranked[np.flatnonzero(same) - 1]] = True
        at = 0
        for data, ks in sort:
            if len(ks) == 1:
                found[first[ks[0]] : last[ks[0]] + 1] = hit[at : at + len(data) - length + 1]
            at += len(data) + 1
    out[(place + part)[found]] = True
    return out


# -- the operator ---------------------------------------------------------------------------------------------------


def _bytes_of_runs(wanted: DataFrame, length: int) -> DataFrame:
    """wanted: text and runs (anchor, start, stop, open, hot). One row per run with its bytes, or, where hot, one per
    start, with the halves of its string's digest as anchor and rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches):
            cols: list[list] = [[] for _ in range(7)]

            def taken() -> pa.RecordBatch:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64())
                done = [pa.array(c, t) for c, t in zip(cols, kinds)]
                for c in cols:
                    c.clear()
                return pa.RecordBatch.from_arrays(done, names=["anchor", "doc_id", "th", "start", "open", "bytes", "rest"])

            for doc, th, text, items in zip(batch["doc_id"].to_pylist(), batch["th"].to_pylist(), own, batch["runs"].to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                for r in items:
                    if r["hot"]:
                        for p in range(r["start"], r["stop"] - length + 1):
                            first, rest = struct.unpack("<qq", xxhash.xxh3_128_digest(data[p : p + length]))
                            for c, v in zip(cols, (first, doc, th, p, r["open"], None, rest)):
                                c.append(v)
                            if len(cols[0]) >= 1 << 16:
                                yield taken()
                        continue
                    for c, v in zip(cols, (r["anchor"], doc, th, r["start"], r["open"], data[r["start"] : r["stop"]], None)):
                        c.append(v)
            yield taken()

    return wanted.mapInArrow(run, "anchor long, doc_id long, th long, start long, open boolean, bytes binary, rest long")


def _sorted_shards(rows: DataFrame, length: int, scratch: str | None, shard: int = SHARD) -> DataFrame:
    """doc_id, th, start, stop: the byte ranges that the suffix sort finds, for open runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            if scratch:
                os.makedirs(scratch, exist_ok=True)
            found = repeated_starts([r[4] for r in held], length, scratch)
            cols: list[list] = [[] for _ in range(4)]
            at = 0
            for doc, th, start, open_, data in held:
                if open_:
                    hit = np.flatnonzero(found[at : at + len(data) - length + 1])
                    if len(hit):
                        edge = np.flatnonzero(np.diff(hit) > length) + 1
                        lo, hi = hit[np.append(0, edge)], hit[np.append(edge - 1, len(hit) - 1)]
                        for a, b in zip(lo.tolist(), hi.tolist()):
                            for c, v in zip(cols, (doc, th, start + a, start + b + length)):
                                c.append(v)
                at += len(data) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "th", "start", "stop"])

        anchor = None
        last, told = None, False  # the start before, of a hot anchor, and whether it has gone out
        for batch in batches:
            again: list[list] = [[] for _ in range(4)]
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "th", "start", "open", "bytes", "anchor", "rest"))):
                if row[4] is None:
                    same = last is not None and last[5:] == row[5:]
                    for doc, th, start, open_ in ([row[:4]] if told else [last[:4], row[:4]]) if same else []:
                        if open_:
                            for c, v in zip(again, (doc, th, start, start + length)):
                                c.append(v)
                    last, told = row, same
                    continue
                if size > shard and row[5] != anchor:
                    yield flush()
                    held, size = [], 0
                anchor = row[5]
                held.append(row[:5])
                size += len(row[4])
            if again[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in again], names=["doc_id", "th", "start", "stop"])
        if held:
            yield flush()

    laid = rows.repartition("anchor").sortWithinPartitions("anchor", "rest").select("doc_id", "th", "start", "open", "bytes", "anchor", "rest")
    return laid.mapInArrow(run, "doc_id long, th long, start long, stop long")


def removed_ranges(docs: DataFrame, length: int = LENGTH, hot: int = SHARD) -> DataFrame:
    """doc_id, th and ranges: an array of (start, stop) in bytes, unordered, possibly overlapping. hot: the bytes of runs
    under one anchor from which on they go by start."""
    spark = docs.sparkSession
    table = written(run_table(docs, length), "runs")
    by_digest = table.groupBy("anchor", "digest").agg(
        F.count("*").alias("c"), F.max("several").alias("several"), F.min(F.struct("doc_id", "th", "start", "n")).alias("rep")
    )
    by_digest = written(by_digest, "digests")
    by_anchor = by_digest.groupBy("anchor").agg(F.count("*").alias("nd"), F.min("c").alias("least"), F.max("c").alias("most"), F.max("several").alias("any"), F.sum(F.col("rep.n") + length - 1).alias("bytes"))
    by_anchor = by_anchor.where("nd > 1 OR most > 1 OR any").select("anchor", (((F.col("nd") > 1) & (F.col("least") == 1)) | F.col("any")).alias("sort"), (F.col("bytes") > hot).alias("hot"))
    settled = by_digest.where("c > 1").select("anchor", "digest")
    whole = table.join(settled, ["anchor", "digest"]).select("doc_id", "th", "start", (F.col("start") + F.col("n") + length - 1).alias("stop"))

    unsettled = by_digest.join(by_anchor.where("sort").select("anchor", "hot"), "anchor").select(
        "rep.doc_id", "rep.th", F.struct("anchor", "rep.start", (F.col("rep.start") + F.col("rep.n") + length - 1).alias("stop"), (F.col("c") == 1).alias("open"), "hot").alias("run")
    )
    runs_of = unsettled.groupBy("doc_id", "th").agg(F.collect_list("run").alias("runs"))  # bounded by the document's length
    source = docs.select("doc_id", "text", text_hash(F.col("text")).cast("long").alias("th"))
    wanted = source.join(runs_of, source["doc_id"].eqNullSafe(runs_of["doc_id"]) & (source["th"] == runs_of["th"])).select(source["doc_id"], source["th"], "text", "runs")
    folder = local_path(shared_dir(spark))  # elsewhere the queues' blocks stay in memory, which SHARD bounds
    found = _sorted_shards(_bytes_of_runs(wanted, length), length, folder and folder + "/quarry-queues")
    return whole.union(found).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deduplicate(docs: DataFrame, length: int = LENGTH, hot: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept: the bytes that remain, for every row of docs."""
    ranges = removed_ranges(docs, length, hot)
    source = docs.select("doc_id", "text", text_hash(F.col("text")).cast("long").alias("th"))
    joined = source.join(ranges, source["doc_id"].eqNullSafe(ranges["doc_id"]) & (source["th"] == ranges["th"]), "left").select(source["doc_id"], "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches):
            cols: list[list] = [[] for _ in range(6)]
            for doc, text, found in zip(batch["doc_id"].to_pylist(), own, batch["ranges"].to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                spans = merged([(r["start"], r["stop"]) for r in found or []])
                cut = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cut[::2], cut[1::2]))
                for c, v in zip(cols, (doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: Every string of 400 bytes, as hexadecimal digits, is counted by its MD5; what repeats is merged to spans.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rid, unnest(range(0, (length(h) - 800) // 8192 + 1)) AS c, h FROM d WHERE length(h) >= 800),
p AS (SELECT rid, c * 4096 AS o, substr(h, c * 8192 + 1, 8192 + 798) AS part FROM b),
s AS (SELECT rid, o + i AS i, md5_number(substr(part, 2 * i + 1, 800)) AS k FROM (SELECT rid, o, part, unnest(range(0, (length(part) - 800) // 2 + 1)) AS i FROM p)),
r AS (SELECT rid, i FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM r)),
x AS (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY rid, g),
y AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM x),
z AS (SELECT rid, sum(b - a) AS gone, count(*) AS n, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM y JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(CASE WHEN z.rid IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN z USING (rid)
"""
