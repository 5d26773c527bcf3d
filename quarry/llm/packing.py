"""Best-fit packing of token sequences by linear grouping.

Documents become token ids plus one end id. Longer ones than the capacity are cut; the first piece takes the remainder,
so all others are full. Only lengths matter for packing, and there are at most `capacity` different ones, so the plan
is made from their histogram, which stays that small at any corpus size:

1. Linear grouping: the large lengths, sorted, are split into groups of equal cardinality, each rounded up to its
   largest length.
2. Configurations: a linear program over the few rounded sizes, solved by column generation (a knapsack per column),
   says how often to use which combination of groups; it is rounded down.
3. Substitution: each slot of a configuration takes an actual length of its group, largest first; the last slot takes
   the largest length of any group that fits what the actual lengths leave free.
4. Best fit: the small lengths and what rounding down left over, largest first, go where they leave the least room.

The plan is a list of patterns with multiplicities. A piece finds its place from its rank among the pieces of its
length: ranks come from counts per partition, and a piece looks its slot up in the plan. Nothing is sorted globally.

Null text is empty and has the end id only. Repeated rows are packed each by itself; ties are broken by the order in
the written piece table. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.model_text import texts

CAPACITY = 2048
END = 0
#: Groups of large lengths, and the length from which one is large, as a share of the capacity.
GROUPS, LARGE = 48, 1 / 8
#: The share of a configuration's copies that is used; the rest goes to best fit, which needs lengths to choose from.
SURE = 0.9
#: Texts of these characters only are split alike by both libraries; the faster one encodes them.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧€]*")
_encoders: dict[str, tuple] = {}


def encoders(json_path: str, ranks_path: str | None) -> tuple:
    """The tokenizer of json_path and, where a rank file of the same vocabulary is given, its fast twin; one a process."""
    if json_path not in _encoders:
        from tokenizers import Tokenizer

        fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[json_path] = (Tokenizer.from_file(json_path), fast)
    return _encoders[json_path]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(text: str, slow, fast) -> np.ndarray:
    """The ids that `slow` gives, as uint32."""
    if fast is not None and "<|" not in text and _PLAIN.fullmatch(text):
        return np.array(fast.encode_ordinary(text), dtype="<u4")
    return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part: the partition that made the row."""
    json_path, ranks_path = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slow, fast = encoders(json_path, ranks_path)
        for batch, own in texts(batches):
            out: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), own):
                ids = np.append(encode(text, slow, fast), np.uint32(END)).astype("<u4")
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[int, ...]


def _best_fit(items: dict[int, int], capacity: int, bins: dict[Pattern, int]) -> dict[Pattern, int]:
    """Best fit, largest first, on counts: items {length: count} into bins {pattern: count}."""
    room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for pattern, n in bins.items():
        room[capacity - sum(pattern)].append((pattern, n))
    for size in sorted(items, reverse=True):
        left = items[size]
        while left:
            fits = [r for r in room if r >= size and room[r]]
            if fits:
                at = min(fits)
                pattern, n = room[at].pop()
            else:
                at, pattern, n = capacity, (), max(1, left // min(capacity // size, left))
            per = min(at // size, left)
            full = min(n, left // per)
            if n > full:
                room[at].append((pattern, n - full))
            room[at - per * size].append((pattern + (size,) * per, full))
            left -= per * full
    out: dict[Pattern, int] = defaultdict(int)
    for group in room.values():
        for pattern, n in group:
            if pattern:
                out[pattern] += n
    return out


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Column generation for min sum(x) with A x >= demand: [(how many of each size, x)]."""
    m, each = len(sizes), np.array(sizes)
    columns = [[capacity // s if j == i else 0 for j in range(m)] for i, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    for _ in range(40 * m):
        x = np.linalg.solve(basis, np.array(demand, float))
        price = np.linalg.solve(basis.T, np.ones(m))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):  # unbounded knapsack, vectorised over the sizes
            best[c], last[c] = best[c - 1], -1
            gain = np.where(each <= c, best[c - each] + price, -1.0)
            if gain[top := int(gain.argmax())] > best[c] + 1e-12:
                best[c], last[c] = gain[top], top
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= sizes[int(last[c])]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, np.array(demand, float))
    return [([int(round(v)) for v in basis[:, k]], float(x[k])) for k in range(m)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[Pattern, int]]:
    """Patterns of lengths and how often each is used; together they hold the histogram exactly."""
    large = sorted((n for n in histogram if capacity * LARGE <= n < capacity and histogram[n]), reverse=True)
    total = sum(histogram[n] for n in large)
    bins: dict[Pattern, int] = defaultdict(int)
    left = {n: k for n, k in histogram.items() if k}
    if total >= groups:
        quota, members, filled = total / groups, [[]], 0
        for n in large:  # equal cardinality; equal lengths stay together
            if filled >= quota * len(members):
                members.append([])
            members[-1].append(n)
            filled += histogram[n]
        sizes = [g[0] for g in members]
        demand = [sum(histogram[n] for n in g) for g in members]
        free = sorted(large)  # lengths that are left, ascending

        def largest(most: int, used: dict[int, int], least: int = 0) -> int | None:
            """The largest length up to most, and from least on, of which more are left than used."""
            k = bisect_right(free, most) - 1
            while k >= 0 and free[k] >= least and left[free[k]] <= used.get(free[k], 0):
                k -= 1
            return free[k] if k >= 0 and free[k] >= least else None

        for config, x in _configurations(sizes, demand, capacity):
            slots, x = [members[i] for i, k in enumerate(config) for _ in range(k)], int(SURE * x)
            while x:  # each pass substitutes actual lengths for as many copies as go alike
                pick: list[int] = []
                used: dict[int, int] = defaultdict(int)
                room = capacity
                for k, g in enumerate(slots[:-1], 2 - len(slots)):
                    n = None
                    if not k:  # of two last slots the first leaves what some length fills, if it can
                        fits = lambda a: room > a and left.get(room - a, 0) > used.get(room - a, 0) + (a == room - a)  # noqa: E731, B023
                        n = next((a for a in g if left[a] > used.get(a, 0) and fits(a)), None)
                    if n is not None or (n := largest(min(g[0], room), used, g[-1])) is not None:
                        pick.append(n)
                        used[n] += 1
                        room -= n
                while room and (n := room if left.get(room, 0) > used.get(room, 0) else largest(room, used)):
                    pick.append(n)  # the last slot takes up what rounding left free
                    used[n] += 1
                    room -= n
                if not pick:
                    break
                times = min(x, *(left[n] // k for n, k in used.items()))
                bins[tuple(pick)] += times
                x -= times
                for n, k in used.items():
                    left[n] -= times * k
                    if not left[n] and n in free:
                        free.remove(n)
    return sorted(_best_fit({n: k for n, k in left.items() if k}, capacity, bins).items())


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece."""
    spark = docs.sparkSession
    made = pieces(docs, capacity, paths).withColumn("part", F.spark_partition_id())
    made = written(made.withColumn("local", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length: (first rank, first sequence, offset)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in plan(histogram, capacity):
        offset = 0
        for size in pattern:
            slots[size].append((ranks[size], sequence, offset))
            ranks[size] += n
            offset += size
        sequence += n
    table = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in slots.items()}
    shared = spark.sparkContext.broadcast(table)

    # The rank of a piece among those of its length: what earlier partitions hold, plus its place in its own.
    per = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = per.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "part").orderBy("local")
    ranked = made.withColumn("r", F.row_number().over(own) - 1).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("base")).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, sequence, offset = t[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                seq[at] = sequence[k] + rank[at] - first[k]
                off[at] = offset[k]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
