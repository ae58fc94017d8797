"""Suffix dedup: repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Every window of `LENGTH` bytes has an anchor, the place of its smallest `GRAM`-byte hash, so equal windows have equal
anchors at equal offsets. Only anchors whose hash occurs twice can belong to a repeat. For those a task sorts its
suffixes from the anchor on and sends front-coded runs (shared prefix length and the rest of each string, likewise for
the bytes before the anchor) to the range of their hash. There a loser tree merges the runs: a string carries the prefix
it is known to share with the last one sent out, and bytes inside known prefixes are never compared again. The merge
leaves the sorted suffixes with their common prefix lengths. A window that starts o bytes before its anchor is repeated
if another suffix of its class at depth LENGTH - o has the same o bytes before its anchor; that is read off for all
suffixes together, one offset at a time.

Equal texts are removed whole (they repeat each other) and take part once. Nothing is sent for texts without repeats,
apart from one hash per anchor. An anchor with more than `HOT` suffixes leaves the merge: its windows are counted by
hash in one aggregation, which has no groups to hold.

Defined cases: null reads as empty; texts shorter than LENGTH lose nothing; matches never cross texts; repeated rows are
copies of each other; texts that overlap themselves count; of the input only the id column is carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistagrid.llm.common import reliable, sized_slices, small_batches, table, text_bytes
from vistagrid.llm.membership import filter_bits, member_filter, passes
from vistagrid.llm.registry import query

LENGTH = 400
GRAM = 48
SPAN = LENGTH - GRAM + 1
CHUNK = 1 << 19
RUN_BYTES = 8 << 20
# Suffix bytes of one hash range, before front coding, and ranges that one task merges one after the other; the number of
# ranges follows from the counted suffixes.
RANGE_BYTES = 8 << 20
RANGES = 8
SLICE = 4096
HOT = 50_000
SALTS = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def rolling_hash(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of every `length`-byte string of the data, by doubling."""
    out, have = None, 0
    power, level = BASE, data.astype(np.uint64) + np.uint64(1)
    size = 1
    while True:
        if length & size:
            out = level if out is None else out[:len(out) - size] * power + level[have:have + len(out) - size]
            have += size
        if size * 2 > length:
            break
        level = level[:len(level) - size] * power + level[size:]
        power = np.uint64(int(power) ** 2 & (2**64 - 1))
        size *= 2
    out = out[:len(data) - length + 1]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return out ^ (out >> np.uint64(29))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:len(values) - size], values[size:])
        size *= 2
    return values if size == width else pick(values[:len(values) - (width - size)], values[width - size:])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window, last window, anchor, hash), over the texts [starts, ends) of the data."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    h = rolling_hash(data, GRAM)
    least = sliding(h, SPAN, np.minimum)
    n = len(least)
    valid = np.zeros(n + 1, dtype=np.int32)
    long = ends - starts >= LENGTH
    valid[starts[long]] += 1
    valid[ends[long] - LENGTH + 1] -= 1
    valid = np.cumsum(valid[:n]) > 0
    change = np.r_[True, (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])]
    first = np.flatnonzero(change)
    last = np.r_[first[1:], n] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    value = least[first]
    # Places that are the minimum of some window; the anchor of a window is the first of them with its value.
    top = sliding(np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)]), SPAN, np.maximum)
    place = np.flatnonzero(h == top[:len(h)])
    out = []
    while len(first):
        at = np.searchsorted(place, first)
        wrong = h[place[at]] != value
        while wrong.any():
            at[wrong] += 1
            wrong = h[place[at]] != value
        anchor = place[at]
        stop = np.minimum(last, anchor)
        out.append((first, stop, anchor, value))
        more = stop < last
        first, last, value = stop[more] + 1, last[more], value[more]
    if not out:
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def _chunks(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    texts = text_bytes(part.column("t"))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    return texts, np.frombuffer(b"".join(texts), dtype=np.uint8), ends - sizes, ends


def _anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sized_slices(batch, "t", CHUNK):
            _, data, starts, ends = _chunks(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchors(data, starts, ends)[3].view(np.int64))], names=["h"])


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    size = 16
    while a[known:known + size] == b[known:known + size]:
        known += size
        size *= 2
    x = int.from_bytes(a[known:min(known + size, n)], "big") ^ int.from_bytes(b[known:min(known + size, n)], "big")
    return known + min(size, n - known) - (x.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared prefix with the string before, length of the rest, and all rests."""
    shared, rest, tails, before = [], [], [], b""
    for s in strings:
        k = common_prefix(before, s, 0)
        shared.append(k)
        rest.append(len(s) - k)
        tails.append(s[k:])
        before = s
    return np.array(shared, dtype="<u2").tobytes(), np.array(rest, dtype="<u2").tobytes(), b"".join(tails)


def front_decoded(shared: bytes, rest: bytes, tails: bytes) -> Iterator[tuple[bytes, int]]:
    at, before = 0, b""
    for k, n in zip(np.frombuffer(shared, dtype="<u2").tolist(), np.frombuffer(rest, dtype="<u2").tolist()):
        before = before[:k] + tails[at:at + n]
        at += n
        yield before, k


def merged(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Loser-tree merge of sorted runs of (string, prefix shared with the one before, payload).

    Every string competes with the length of the prefix it shares with the last output. The longer one is smaller
    without any comparison; of equal lengths only the bytes behind the prefix are compared, and the loser remembers what
    it shares with the winner.
    """
    width = 1
    while width < max(1, len(runs)):
        width *= 2
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (width - len(runs))
    prefix = [0] * width
    losers = [-1] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        s, t, k = x[0], y[0], prefix[a]
        k = common_prefix(s, t, k)
        if s[k:k + 1] <= t[k:k + 1]:
            prefix[b] = k
            return a, b
        prefix[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= width:
            return node - width
        win, lose = play(build(2 * node), build(2 * node + 1))
        losers[node] = lose
        return win

    win = build(1)
    while heads[win] is not None:
        s, _, payload = heads[win]
        yield s, prefix[win], payload
        heads[win] = next(runs[win], None) if win < len(runs) else None
        prefix[win] = heads[win][1] if heads[win] is not None else 0
        node = (win + width) // 2
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2


def spread(h: int) -> bytes:
    """An anchor's hash as sort key. Anchors are minima, so their hashes crowd near zero; the odd factor deals them evenly."""
    return (h * int(BASE) & (1 << 64) - 1).to_bytes(8, "big")


def _sent(shared, power: int, hot: frozenset | None, buckets: int):
    """Front-coded sorted runs of the suffixes at repeated anchors, one row per run and hash range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes, int, int]] = []
        size = 0

        def flush():
            held.sort(key=lambda m: m[0])
            bucket = np.array([int.from_bytes(m[0][:4], "big") * buckets >> 32 for m in held])
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(cut.tolist(), np.r_[cut[1:], len(held)].tolist()):
                part = held[a:b]
                right, left = front_coded([m[0] for m in part]), front_coded([m[1] for m in part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[a])], pa.int64()), *[pa.array([x], pa.binary()) for x in (*right, *left)], pa.array([b"".join(m[2] for m in part)], pa.binary()),
                     pa.array([np.array([m[3:] for m in part], dtype="<i8").tobytes()], pa.binary())], names=RUN_COLUMNS)

        for batch in batches:
            for part in sized_slices(batch, "t", CHUNK):
                texts, data, starts, ends = _chunks(part)
                first, last, anchor, h = anchors(data, starts, ends)
                hit = np.flatnonzero(passes(shared.value, power, h.view(np.int64)))
                row = np.searchsorted(ends, first[hit], side="right")
                marks = part.column("mark").to_pylist()
                for k, r in zip(hit.tolist(), row.tolist()):
                    own = int(h[k])
                    if hot and own in hot:
                        continue
                    base = int(starts[r])
                    a, lo, hi = int(anchor[k]) - base, int(first[k]) - base, int(last[k]) - base
                    held.append((spread(own) + texts[r][a:hi + LENGTH], texts[r][lo:a][::-1], marks[r], a, a - hi))
                    size += hi + LENGTH - lo
                if size > RUN_BYTES:
                    yield from flush()
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    return run


RUN_COLUMNS = ["bucket", "right_shared", "right_rest", "right", "left_shared", "left_rest", "left", "marks", "places"]
RUN_SCHEMA = "bucket bigint, right_shared binary, right_rest binary, right binary, left_shared binary, left_rest binary, left binary, marks binary, places binary"


def repeated_windows(prefix: np.ndarray, left: list[bytes], least: np.ndarray) -> np.ndarray:
    """Of sorted suffixes with their common prefixes (hash bytes not counted): whether the window at each offset before
    the anchor is repeated. Offsets of a suffix go from `least` to the number of its left bytes.

    The left bytes are sorted as well: two of them have the same first o bytes if no shared prefix between their ranks is
    below o. So both halves of a window become exact class numbers, without hashing.
    """
    n = len(left)
    most = np.array([len(x) for x in left])
    order = sorted(range(n), key=left.__getitem__)
    shared = np.array([-1, *(common_prefix(left[i], left[j], 0) for i, j in zip(order, order[1:]))])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    out = np.zeros((n, SPAN), dtype=bool)
    for o in range(int(most.max()) + 1):
        rows = np.flatnonzero((least <= o) & (o <= most))
        if len(rows) < 2:
            continue
        right_class = np.cumsum(prefix < LENGTH - o)
        left_class = np.cumsum(shared < o)
        key = right_class[rows] * (n + 1) + left_class[rank[rows]]
        at = np.argsort(key, kind="stable")
        same = key[at][1:] == key[at][:-1]
        out[rows[at[1:][same]], o] = True
        out[rows[at[:-1][same]], o] = True
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, start, end) of repeated bytes, from the runs of one hash range after the other."""
    def solve(members: list[tuple[int, bytes, bytes, int, int]]):
        prefix = np.array([max(m[0] - 8, 0) for m in members])
        prefix[[m[0] < 8 for m in members]] = -1
        least = np.array([m[4] for m in members])
        flags = repeated_windows(prefix, [m[1] for m in members], least)
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        place = np.array([m[3] for m in members], dtype=np.int64)
        # Offset o is the window that starts o bytes before the anchor.
        return pa.RecordBatch.from_arrays([pa.array([members[r][2] for r in row.tolist()], pa.binary()), pa.array(place[row] - high), pa.array(place[row] - low + LENGTH)],
                                          names=["mark", "start", "end"])

    def runs_of(row: dict) -> Iterator[tuple[bytes, int, object]]:
        places = np.frombuffer(row["places"], dtype="<i8").reshape(-1, 2).tolist()
        lefts = front_decoded(row["left_shared"], row["left_rest"], row["left"])
        for k, ((s, shared), (left, _)) in enumerate(zip(front_decoded(row["right_shared"], row["right_rest"], row["right"]), lefts)):
            yield s, shared, (left, row["marks"][16 * k:16 * k + 16], *places[k])

    def settle(rows: list[dict]):
        members = []
        for s, prefix, payload in merged([runs_of(r) for r in rows]):
            if prefix < 8 and len(members) >= SLICE:
                yield solve(members)
                members = []
            members.append((prefix, *payload))
        if members:
            yield solve(members)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield from settle(held)
                held = []
            held.append(row)
    if held:
        yield from settle(held)


def _hot_windows(hot: frozenset):
    """(window hash pair, mark, start) of all windows at hot anchors."""
    def run(batches):
        for batch in batches:
            for part in sized_slices(batch, "t", CHUNK):
                _, data, starts, ends = _chunks(part)
                first, last, _, h = anchors(data, starts, ends)
                keep = np.isin(h, np.array(list(hot), dtype=np.uint64))
                if not keep.any():
                    continue
                size = last[keep] - first[keep] + 1
                p = np.repeat(first[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                row = np.searchsorted(ends, p, side="right")
                one, two = rolling_hash(data, LENGTH)[p], rolling_hash(data ^ np.uint8(0x5A), LENGTH)[p]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), part.column("mark").take(pa.array(row)), pa.array(p - starts[row])],
                                                 names=["one", "two", "mark", "start"])

    return run


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeat_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(mark, spans): MD5 of every distinct text with repeated bytes, and their (start, end) byte ranges, not yet merged."""
    spark = docs.sparkSession
    small_batches(spark)
    body = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).where(F.octet_length("t") >= LENGTH).withColumn("mark", F.unhex(F.md5("t")))
    copied = reliable(body.groupBy("mark").agg(F.count("*").alias("n"), F.first(F.octet_length("t")).cast("bigint").alias("size")).where("n > 1"))
    tagged = body.withColumn("h", F.xxhash64("mark"))
    hashes = copied.select(F.xxhash64("mark").alias("h"))
    once = member_filter(tagged, "h", hashes, inside=False).unionByName(member_filter(tagged, "h", hashes).groupBy("mark").agg(F.first("t").alias("t")).select("t", "mark"))
    counts = reliable(once.mapInArrow(_anchor_hashes, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    # Anchors with more than HOT suffixes; each stands for HOT places in the text, so they are few.
    hot = frozenset(r.h & (2**64 - 1) for r in counts.where(F.col("n") > HOT).toLocalIterator())
    suffixes = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), suffixes * (LENGTH + SPAN) // (RANGE_BYTES * RANGES) + 1)
    place = F.floor(F.col("bucket") / RANGES).cast("int")
    bits, power = filter_bits(counts.select("h"))
    runs = once.mapInArrow(_sent(bits, power, hot, tasks * RANGES), RUN_SCHEMA).repartitionById(tasks, place).sortWithinPartitions("bucket")
    found = runs.mapInArrow(_found, "mark binary, start bigint, end bigint")
    if hot:
        windows = once.mapInArrow(_hot_windows(hot), "one bigint, two bigint, mark binary, start bigint")
        # A window may occur in any number of texts: its rows are counted, and met again, in SALTS parts.
        salted = windows.withColumn("salt", F.pmod(F.xxhash64("mark", "start"), F.lit(SALTS)))
        parts = salted.groupBy("one", "two", "salt").agg(F.count("*").alias("n"))
        twice = parts.withColumn("n", F.sum("n").over(Window.partitionBy("one", "two"))).where("n > 1").select("one", "two", "salt")
        found = found.unionByName(salted.join(twice, ["one", "two", "salt"]).select("mark", "start", (F.col("start") + LENGTH).alias("end")))
    whole = copied.select("mark", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"))
    spans = reliable(found.unionByName(whole))
    return spans.groupBy("mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: id, bytes, removed bytes, merged byte spans, and the bytes that are left with their SHA-256."""
    spans = reliable(repeat_spans(docs, text))
    keyed = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("mark", F.unhex(F.md5("t"))).withColumn(
        "h", F.xxhash64("mark"))
    hashes = spans.select(F.xxhash64("mark").alias("h"))
    touched = member_filter(keyed, "h", hashes).join(spans, "mark", "left")
    schema = f"{docs.schema[doc_id].dataType.simpleString()}"

    def cut(batches):
        for batch in batches:
            rows = []
            for t, s in zip(text_bytes(batch.column("t")), batch.column("spans").to_pylist()):
                merged_ = _union(s or [])
                at, parts = 0, []
                for a, b in merged_:
                    parts.append(t[at:a])
                    at = b
                kept = b"".join([*parts, t[at:]])
                rows.append((len(t), sum(b - a for a, b in merged_), [{"start": a, "end": b} for a, b in merged_], kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([r[3] for r in rows], pa.binary()),
                 pa.array([r[4] for r in rows], pa.string())], names=["id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    out = touched.select("id", "t", "spans").mapInArrow(
        cut, f"id {schema}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string")
    clean = member_filter(keyed, "h", hashes, inside=False).select(
        "id", F.octet_length("t").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.encode("t", "utf-8").alias("kept"), F.sha2("t", 256).alias("kept_sha256"))
    return clean.unionByName(out).withColumnRenamed("id", doc_id)


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
