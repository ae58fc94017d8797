"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts become sets of five-word shingles; texts with the same set form one class, and only classes are joined. Classes
that agree on all rows of a MinHash band meet in a bucket; a pair belongs to the first band it shares, so it is looked
at once. A bucket is cut into blocks of at most `BLOCK` classes, and a task gets two blocks: it compares MinHash values
`STEP` at a time and drops a pair as soon as the posterior probability that its similarity reaches the threshold falls
below `TOLERANCE`. The pairs that are left are verified on the full shingle sets. Pairs never become rows: a block row
holds them packed, and verification returns per class the number of links and one local root.

With 32 bands of 4 rows a pair at similarity 0.8 misses every band with probability 5e-8, at 0.9 with 1e-15.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Defined cases: a text of one to four
words has one shingle; null, empty and wordless texts link to nothing and are classes of their own; repeated rows are
copies; copies count as links; of a class of rows without any id the class id is null; only the id column is carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistagrid.llm.common import WORD_TABLE, reliable, sized_slices, small_batches, table, text_bytes, tidied
from vistagrid.llm.membership import member_filter
from vistagrid.llm.registry import query

WORDS = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 4
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-9
BLOCK = 1024
PAIRS = 1 << 16
PIECE = 8192

_random = np.random.default_rng(20240229)
FACTOR = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
OFFSET = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32)
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Sorted distinct shingle hashes of texts; word hashes are remembered up to a limit."""

    def __init__(self, words: int = WORDS, memory: int = 150_000):
        self.words, self.memory = words, memory
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        h = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > self.memory:
            self.known.clear()
        get, make, out = self.known.get, self._hash, []
        for t in texts:
            own = t.translate(WORD_TABLE).split()
            h = np.fromiter((get(w) or make(w) for w in own), dtype=np.uint64, count=len(own))
            n = min(self.words, len(h))
            if not n:
                out.append(h)
                continue
            rolled = h[:len(h) - n + 1].copy()
            for k in range(1, n):
                rolled = rolled * ROLL + h[k:len(h) - n + 1 + k]
            rolled = (rolled ^ (rolled >> np.uint64(31)) ^ np.uint64(n)) * MIX
            out.append(np.unique(rolled ^ (rolled >> np.uint64(29))))
        return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (texts x VALUES) of nonempty sets."""
    out = np.full((len(sets), VALUES), 0xFFFFFFFF, dtype=np.uint32)
    lo = 0
    while lo < len(sets):
        hi, held = lo, 0
        while hi < len(sets) and (hi == lo or held + len(sets[hi]) <= PIECE):
            held += len(sets[hi])
            hi += 1
        if hi == lo + 1:
            for a in range(0, len(sets[lo]), PIECE):
                x = (sets[lo][a:a + PIECE] >> np.uint64(32)).astype(np.uint32)
                out[lo] = np.minimum(out[lo], (FACTOR[:, None] * x + OFFSET[:, None]).min(axis=1))
        else:
            x = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
            sizes = np.array([len(s) for s in sets[lo:hi]])
            out[lo:hi] = np.minimum.reduceat(FACTOR[:, None] * x + OFFSET[:, None], np.cumsum(sizes) - sizes, axis=1).T
        lo = hi
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """Fewest agreements after STEP, 2 STEP, ... values with which the posterior of reaching the threshold is kept.

    Under a uniform prior P(J >= t | m of k agree) = P(Bin(k + 1, t) <= m).
    """
    out = []
    for k in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


@tidied
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for part in sized_slices(batch, "t"):
            sets = shingler.sets(text_bytes(part.column("t")))
            full = [k for k, s in enumerate(sets) if len(s)]
            values = iter(minhashes([sets[k] for k in full])) if full else iter(())
            signs = [next(values).astype("<u4").tobytes() if len(s) else None for s in sets]
            keys = [hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs, pa.binary()),
                                              pa.array([hashlib.md5(t).hexdigest() for t in text_bytes(part.column("t"))], pa.string())],
                                             names=["id", "c", "n", "signature", "mark"])


@tidied
def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band key, class) of every class; the key holds the band in its lowest bits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype="<u4").reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = values[:, :, 0].copy()
        for k in range(1, ROWS):
            key = (key ^ (key >> np.uint64(32))) * MIX + values[:, :, k]
        key = (key ^ (key >> np.uint64(30))) * ROLL
        key = (key & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)
        index = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), batch.column("c").take(index)], names=["bucket", "c"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from batches sorted by `keys`; only the last group of a batch is carried over."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        codes = frame[keys]
        new = (codes != codes.shift()).any(axis=1).to_numpy()
        cut = int(np.flatnonzero(new)[-1])
        if held and (tuple(held[-1][keys].iloc[-1]) != tuple(codes.iloc[0]) or cut > 0):
            same = tuple(held[-1][keys].iloc[-1]) == tuple(codes.iloc[0])
            head = int(np.flatnonzero(new)[1]) if same and new.sum() > 1 else 0
            yield pd.concat([*held, frame.iloc[:head]]) if head else pd.concat(held)
            if cut > head:
                yield frame.iloc[head:cut]
            held = [frame.iloc[cut:]]
        elif held:
            held.append(frame)
        else:
            if cut:
                yield frame.iloc[:cut]
            held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held)


def _pairs_of(sides: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs inside each group: all of one block, or those across its two blocks; at most about `PAIRS` at a time."""
    left, right, held = [], [], 0
    for a, b in zip(starts, ends):
        own = sides[a:b]
        first, second = np.arange(a, b)[own == 0], np.arange(a, b)[own == 1]
        for lo in range(0, len(first), 64):
            rows = first[lo:lo + 64]
            if len(second):
                i, j = np.repeat(rows, len(second)), np.tile(second, len(rows))
            else:
                i, j = np.repeat(rows, len(first)), np.tile(first, len(rows))
                i, j = i[i < j], j[i < j]
            left.append(i)
            right.append(j)
            held += len(i)
            if held >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


LEAST = least_matches()


@tidied
def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per surviving member of a block pair: its partners are numbers of members of the same `job`."""
    for frame in _groups(batches, ["bucket", "job"]):
        bucket, job = frame["bucket"].to_numpy(np.int64), frame["job"].to_numpy(np.int64)
        values = np.frombuffer(b"".join(frame["signature"]), dtype="<u4").reshape(-1, VALUES)
        band = (bucket.view(np.uint64) & np.uint64(BANDS - 1)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (job[1:] != job[:-1])])
        ends = np.r_[starts[1:], len(bucket)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in _pairs_of(frame["side"].to_numpy(), starts, ends):
            agree = np.zeros(len(i), dtype=np.int64)
            earlier = np.zeros(len(i), dtype=bool)
            for k, least in enumerate(LEAST):
                same = values[i, k * STEP:(k + 1) * STEP] == values[j, k * STEP:(k + 1) * STEP]
                agree += same.sum(axis=1)
                bands = same.reshape(len(i), STEP // ROWS, ROWS).all(axis=2)
                earlier |= (bands & (np.arange(k * STEP // ROWS, (k + 1) * STEP // ROWS)[None, :] < band[i][:, None])).any(axis=1)
                go = (agree >= least) & ~earlier
                i, j, agree, earlier = i[go], j[go], agree[go], earlier[go]
                if not len(i):
                    break
            if len(i):
                found.append((i, j))
        if not found:
            continue
        i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        first, n = np.unique(i, return_index=True, return_counts=True)[1:]
        members = np.unique(np.concatenate([i, j]))
        group = np.searchsorted(starts, members, side="right") - 1
        place = members - starts[group]
        partners = {int(i[a]): (j[a:a + m] - starts[np.searchsorted(starts, i[a], side="right") - 1]).astype("<u2").tobytes() for a, m in zip(first, n)}
        classes = frame["c"].to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[members]), pa.array(job[members]), pa.array(list(classes[members]), pa.binary()), pa.array(place.astype(np.int32)),
             pa.array([partners.get(int(m)) for m in members], pa.binary())], names=["bucket", "job", "c", "place", "partners"])


@tidied
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, links, root): exact similarity of the packed pairs; links count copies, roots join what is linked here."""
    for frame in _groups(batches, ["bucket", "job"]):
        for _, job in frame.groupby(["bucket", "job"], sort=False):
            sets = {int(p): np.frombuffer(s, dtype="<u8") for p, s in zip(job["place"], job["shingles"])}
            name = dict(zip(job["place"].astype(int), job["c"]))
            copies = dict(zip(job["place"].astype(int), job["copies"]))
            links = dict.fromkeys(sets, 0)
            root = {p: p for p in sets}

            def find(p):
                while root[p] != p:
                    root[p] = root[root[p]]
                    p = root[p]
                return p

            for p, packed in zip(job["place"].astype(int), job["partners"]):
                if packed is None:
                    continue
                own = sets[p]
                others = [q for q in np.frombuffer(packed, dtype="<u2").tolist() if _may_reach(len(own), len(sets[q]))]
                if not others:
                    continue
                sizes = np.array([len(sets[q]) for q in others])
                flat = np.concatenate([sets[q] for q in others])
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                shared = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                for q, common, size in zip(others, shared.tolist(), sizes.tolist()):
                    if reaches(common, len(own), size):
                        links[p] += int(copies[q])
                        links[q] += int(copies[p])
                        a, b = find(p), find(q)
                        if a != b:
                            root[max(a, b, key=lambda x: name[x])] = min(a, b, key=lambda x: name[x])
            kept = [p for p in sets if links[p]]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([name[p] for p in kept], pa.binary()), pa.array([links[p] for p in kept], pa.int64()),
                                                  pa.array([name[find(p)] for p in kept], pa.binary())], names=["c", "links", "root"])


def reaches(common: int, a: int, b: int) -> bool:
    """Jaccard similarity of at least 0.8, in whole numbers."""
    return 10 * common >= round(10 * THRESHOLD) * (a + b - common)


def _may_reach(a: int, b: int) -> bool:
    return reaches(min(a, b), a, b)


@tidied
def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for part in sized_slices(batch, "t"):
            sets = [s.astype("<u8").tobytes() for s in shingler.sets(text_bytes(part.column("t")))]
            keys = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["c", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(c, label): smallest member of the component of every node, by alternating large and small stars."""
    state = reliable(edges.where("c <> root").select(F.col("c").alias("u"), F.col("root").alias("v")).distinct())
    seen = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        state = reliable(small.where("u <> v").distinct())
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            return state.select(F.col("u").alias("c"), F.col("v").alias("label"))
        seen = mark


def jaccard_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: id, its class (smallest id of all rows joined by links), links, shingles and copies."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("t"))
    rows = reliable(source.mapInArrow(_signed, "id bigint, c binary, n bigint, signature binary, mark string"))
    classes = rows.where("n > 0").groupBy("c").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    classes = reliable(classes)
    bands = classes.select("c", "signature").mapInArrow(_banded, "bucket bigint, c binary")
    crowded = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("bigint")
    member = reliable(bands.join(crowded, "bucket").select("bucket", "c", blocks.alias("blocks")))
    own = F.pmod(F.xxhash64("c"), F.col("blocks"))
    placed = member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    job = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    placed = placed.select("bucket", job.alias("job"), (F.col("own") > F.col("other")).cast("int").alias("side"), "c")
    signed = placed.join(classes.select("c", "signature"), "c").repartition("bucket", "job").sortWithinPartitions("bucket", "job", "c")
    survivors = reliable(signed.mapInArrow(_pruned, "bucket bigint, job bigint, c binary, place int, partners binary"))
    # Shingle sets are needed for survivors alone; the bounded filter keeps most other texts from being read again.
    wanted = survivors.select("c").distinct().join(classes.select("c", "first", "copies"), "c")
    ids = wanted.select(F.xxhash64("first").alias("h"))
    chosen = member_filter(source.withColumn("h", F.xxhash64("id")), "h", ids)
    sets = chosen.join(wanted.select(F.col("first").alias("id")).distinct(), "id", "left_semi")
    nulls = chosen.where("id is null")
    sets = sets.unionByName(nulls).select("t").mapInArrow(_shingled, "c binary, shingles binary")
    sets = sets.join(wanted.select("c", "copies"), "c").dropDuplicates(["c"])
    jobs = survivors.join(sets, "c").repartition("bucket", "job").sortWithinPartitions("bucket", "job", "place")
    verified = reliable(jobs.mapInArrow(_verified, "c binary, links bigint, root binary"))
    label = components(verified)
    links = verified.groupBy("c").agg(F.sum("links").alias("links"))
    known = classes.select("c", "first", "copies").join(links, "c", "left").join(label, "c", "left").withColumn("label", F.coalesce("label", "c"))
    heads = known.where(F.col("links") > 0).groupBy("label").agg(F.min("first").alias("head"))
    known = known.join(heads, "label", "left").select("c", F.coalesce("head", "first").alias("class_id"),
                                                      (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    # Wordless rows get keys of their own.
    keyed = rows.select("id", "mark", F.coalesce("c", F.encode(F.concat(F.lit("none:"), F.xxhash64("id").cast("string")), "utf-8")).alias("c"), "n")
    return keyed.join(known, "c", "left").select(F.col("id").alias(doc_id), F.coalesce("class_id", "id").alias("class_id"),
                                                 F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("n").alias("n_shingles"),
                                                 F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"), "mark")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Input rows and columns, with one row of every near-duplicate class: the one with the smallest id, then text digest.

    Rows without id are grouped by equal text. Only rows that may have to go, by a bounded filter, travel with their
    texts; all others are passed on where they are read.
    """
    def key(id_col, mark):
        return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("none")), mark)

    rows = reliable(jaccard_classes(docs, text, doc_id).select(key(F.col(doc_id), F.col("mark")).alias("k"), F.coalesce(F.col("class_id").cast("string"), F.concat(F.lit("none:"), "mark")).alias("class"),
                                                               F.struct(F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"), F.col("mark").alias("c")).alias("rank")))
    kept = rows.groupBy("class").agg(F.min("rank").alias("rank")).select(key(F.col("rank.b"), F.col("rank.c")).alias("k"))
    gone = reliable(rows.select("k").distinct().join(kept, "k", "left_anti"))
    repeated = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    keyed = docs.withColumn("__k", key(F.col(f"`{doc_id}`"), F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))).withColumn("__h", F.xxhash64("__k"))
    hashes = gone.unionByName(repeated).select(F.xxhash64("k").alias("h"))
    open_ = member_filter(keyed, "__h", hashes)
    left = open_.join(gone.withColumnRenamed("k", "__k"), "__k", "left_anti").dropDuplicates(["__k"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    passed = member_filter(keyed, "__h", hashes, inside=False).drop("__k")
    return passed.unionByName(left)


@query("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("mark")
