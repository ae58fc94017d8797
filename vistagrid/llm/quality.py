"""Quality rules: n-gram perplexity under a modified Kneser-Ney model, with bands per language.

The model reads whole code points. An n-gram of order five is kept exactly, as two 64-bit numbers, so its size grows with
the texts and no part of it is broadcast: texts are cut into chunks of one language, Spark counts the n-grams of all
chunks, the levels of the model are aggregations and joins over distinct n-grams, and a chunk asks for each of its
distinct n-grams once. Asks and model meet in hash buckets of whole contexts, where the model is an array sorted by hash and asks are
found by bisection; the answers meet the texts of the chunk again.

Every text that is scored was counted, so the value of its n-grams is in the model and scoring never backs off.

Defined cases: null and empty texts have no words and fail the base rules; a null language is a language of its own
(``''``); repeated rows are judged alike; further columns pass through, except those the operator writes itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistagrid.llm.common import appended, sized_slices, small_batches, stored, table, text_bytes, tidied, with_columns
from vistagrid.llm.registry import query

ORDER = 5
POINT_BITS = 21
POINT = (1 << POINT_BITS) - 1
PAIR = (1 << (2 * POINT_BITS)) - 1
# Text bytes of a chunk, of all open chunks of a task, and behind one bucket of n-grams.
CHUNK = 8 << 20
OPEN = 24 << 20
BUCKET = 32 << 20
# Texts that are decoded together, and code points whose n-grams are put together at a time.
RUN = 256
PIECE = 1 << 20
MIN_WORDS = 50
REPEAT_PERCENT = 50
# A text leaves its language's band when its bits per character lie further than this many quartile distances outside.
BAND_WIDTH = 6.0
MIN_BAND = 0.25
STAT_COLUMNS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                "bits_per_char double, band_low double, band_high double, base_failed boolean, kept boolean")


def packed(values: np.ndarray) -> bytes:
    """Compressed numbers, the bytes of equal rank together."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 3)


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _two_numbers(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (parts[0] << POINT_BITS) | parts[1], (parts[2] << (2 * POINT_BITS)) | (parts[3] << POINT_BITS) | parts[4]


def code_points(keys: np.ndarray, points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The five code points behind chunk keys whose digits are places in `points`, as two numbers, put together piece by piece."""
    hi, lo = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
    for a in range(0, len(keys), PIECE):
        own = keys[a:a + PIECE]
        hi[a:a + PIECE], lo[a:a + PIECE] = _two_numbers([points[(own >> (bits * back)) & ((1 << bits) - 1)] for back in range(ORDER - 1, -1, -1)])
    return hi, lo


class Grams:
    """n-grams of order five over the code points of texts; every text follows four boundaries, so none spans two texts.

    A code point counts as its number plus two, a boundary as one, and zero stands for no symbol in n-grams of lower order.
    """

    def __init__(self, texts: list[bytes]):
        self.lengths, filled = np.zeros(len(texts), dtype=np.int64), 0
        # A text has no more code points than bytes, so the runs are decoded into place.
        codes = np.empty(sum(map(len, texts)) + (ORDER - 1) * len(texts), dtype=np.uint32)
        for at in range(0, len(texts), RUN):
            decoded = [t.decode("utf-8", "replace") for t in texts[at:at + RUN]]
            self.lengths[at:at + RUN] = [len(t) for t in decoded]
            run = np.frombuffer(("\x00" * (ORDER - 1)).join(["", *decoded]).encode("utf-32-le"), dtype=np.uint32)
            codes[filled:filled + len(run)] = run
            filled += len(run)
        codes = codes[:filled]
        codes += np.uint32(2)
        starts = np.cumsum(self.lengths + ORDER - 1) - self.lengths
        self.real = np.ones(len(codes), dtype=bool)
        for back in range(1, ORDER):
            codes[starts - back] = 1
            self.real[starts - back] = False
        seen = np.zeros(1 << POINT_BITS, dtype=bool)
        seen[codes] = True
        self.points = np.flatnonzero(seen)
        rank = np.zeros(1 << POINT_BITS, dtype=np.uint32)
        rank[self.points] = np.arange(len(self.points))
        for at in range(0, len(codes), PIECE):
            codes[at:at + PIECE] = rank[codes[at:at + PIECE]]
        self.symbols = codes
        self.bits = max(1, int(len(self.points) - 1).bit_length())
        self.direct = ORDER * self.bits <= 63
        self.keys = None if self.direct else self._numbered()

    def _numbered(self) -> np.ndarray:
        """Keys where the digits of five symbols do not fit: a key is numbered anew among those that occur."""
        symbols = self.symbols
        keys, used = symbols[:len(symbols) - ORDER + 1].astype(np.int64), self.bits
        for k in range(1, ORDER):
            if used + self.bits > 63:
                known, keys = np.unique(keys, return_inverse=True)
                used = max(1, int(len(known)).bit_length())
            keys = (keys << self.bits) | symbols[k:len(symbols) - ORDER + 1 + k]
            used += self.bits
        return keys[self.real[ORDER - 1:]]

    def _pieces(self) -> Iterator[np.ndarray]:
        """Keys of all n-grams in text order, numbers of this chunk only. Digits of symbols are put together piece by piece, so
        that a task never holds them for a whole chunk."""
        if not self.direct:
            yield self.keys
            return
        n = max(0, len(self.symbols) - ORDER + 1)
        for a in range(0, n, PIECE):
            b = min(n, a + PIECE)
            keys = self.symbols[a:b].astype(np.int64)
            for k in range(1, ORDER):
                keys <<= self.bits
                keys |= self.symbols[a + k:b + k]
            yield keys[self.real[a + ORDER - 1:b + ORDER - 1]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, how often each occurs, and their five code points as two numbers."""
        if self.direct:
            found, counts = [], []
            for piece in self._pieces():
                own, n = np.unique(piece, return_counts=True)
                found.append(own)
                counts.append(n.astype(np.int32))
            keys = np.concatenate(found or [np.empty(0, np.int64)])
            n = np.concatenate(counts or [np.empty(0, np.int32)])
            del found, counts
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            n = n[order]
            del order
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            keys, n = keys[starts], np.add.reduceat(n, starts, dtype=np.int64) if len(n) else n.astype(np.int64)
            return keys, n, *code_points(keys, self.points, self.bits)
        keys, at, n = np.unique(self.keys, return_index=True, return_counts=True)
        first = np.flatnonzero(self.real)[at] - ORDER + 1
        return keys, n, *_two_numbers([self.points[self.symbols[first + k]] for k in range(ORDER)])

    def bits_per_char(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Mean negative log2 probability per code point (log2 of the perplexity) from the values of the distinct keys; NaN for empty texts."""
        out = np.full(len(self.lengths), np.nan)
        full = self.lengths > 0
        if full.any():
            each, filled = np.empty(int(self.lengths.sum()), dtype=values.dtype), 0
            for piece in self._pieces():
                each[filled:filled + len(piece)] = values[np.searchsorted(keys, piece)]
                filled += len(piece)
            sums = np.add.reduceat(each, (np.cumsum(self.lengths) - self.lengths)[full], dtype=np.float64)
            out[full] = -sums / self.lengths[full]
        return out


def _language(lang: str | None) -> str:
    return lang or ""


CHUNKED = "chunk bigint, lang string, size bigint, rows binary"


def _rows_packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 12))) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _rows_of(data: bytes) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(data))


def _chunked(text: str, lang: str):
    """Chunks of whole rows of one language."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        waiting: dict[str, list[pa.RecordBatch]] = {}
        sizes: dict[str, int] = {}

        def chunk(language: str) -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(waiting.pop(language))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([(context.partitionId() << 32) | number], pa.int64()), pa.array([language]), pa.array([sizes.pop(language)], pa.int64()),
                                               pa.array([_rows_packed(rows)], pa.binary())], names=["chunk", "lang", "size", "rows"])

        for batch in batches:
            for part in sized_slices(batch, text):
                languages = np.array([_language(x) for x in part.column(lang).cast(pa.string()).to_pylist()], dtype=object)
                for language in dict.fromkeys(languages):
                    own = part.filter(pa.array(languages == language))
                    waiting.setdefault(language, []).append(own)
                    sizes[language] = sizes.get(language, 0) + own.nbytes
                    if sizes[language] >= CHUNK:
                        yield chunk(language)
                while sum(sizes.values()) > OPEN:
                    yield chunk(max(sizes, key=sizes.get))
        for language in list(waiting):
            yield chunk(language)

    return run


def _texts(rows: bytes, text: str) -> list[bytes]:
    return [t for b in _rows_of(rows) for t in text_bytes(b.column(text))]


def _cuts(level: DataFrame) -> DataFrame:
    """Discounts of counts 1, 2 and 3 or more, a row per language; where counts of counts are empty, the usual constants."""
    found = level.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("bigint")).cast("double").alias(f"c{k}") for k in (1, 2, 3, 4)])
    c1, c2, c3, c4 = (F.col(f"c{k}") for k in (1, 2, 3, 4))
    one = F.lit(1.0)
    y = c1 / F.greatest(c1 + 2 * c2, one)
    raw = [1 - 2 * y * c2 / F.greatest(c1, one), 2 - 3 * y * c3 / F.greatest(c2, one), 3 - 4 * y * c4 / F.greatest(c3, one)]
    return found.select("lang", *[F.when((c1 > 0) & (c2 > 0) & (c3 > 0), F.least(F.greatest(d, F.lit(0.05)), F.lit(k + 0.95))).otherwise(F.lit(usual)).alias(f"d{k + 1}")
                                  for k, (d, usual) in enumerate(zip(raw, (0.5, 0.75, 0.9)))])


def _suffix(order: int) -> tuple[Column, Column]:
    """An n-gram of this order without its first symbol."""
    hi, lo = F.col("hi"), F.col("lo")
    if order > 3:
        return hi.bitwiseAND(F.lit(POINT if order == 5 else 0)), lo
    return hi, lo.bitwiseAND(F.lit({3: PAIR, 2: POINT}[order]))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, hi, lo, p): interpolated modified Kneser-Ney probability of every n-gram of order five.

    Counts at the highest order, numbers of left extensions below it; order zero is uniform over all code points. `counts` as
    from `_summed`, which knows the sums of whole contexts; the smaller lower orders, and plain counts, get theirs from window functions.
    """
    levels = {ORDER: counts}
    for order in range(ORDER, 1, -1):
        hi, lo = _suffix(order)
        levels[order - 1] = stored(levels[order].groupBy("lang", hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("n")))
    model = None
    for order in range(1, ORDER + 1):
        hi, lo = F.col("hi"), F.col("lo")
        d1, d2, d3 = (F.col(f"d{k}") for k in (1, 2, 3))
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = levels[order].join(F.broadcast(_cuts(levels[order])), "lang")
        if order == ORDER and "total" in counts.columns:
            total, cuts = F.col("total"), d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")
        else:
            context = Window.partitionBy("lang", F.shiftright(hi, POINT_BITS), F.shiftleft(hi.bitwiseAND(F.lit(POINT)), 2 * POINT_BITS).bitwiseOR(F.shiftright(lo, POINT_BITS)))
            total, cuts = F.sum("n").over(context), F.sum(cut).over(context)
        rows = rows.select("lang", "hi", "lo", ((F.col("n") - cut) / total).cast("float").alias("own"), (cuts / total).cast("float").alias("free"))
        if model is None:
            model = rows.withColumn("below", F.lit(1.0 / (1 << POINT_BITS)))
        else:
            shi, slo = _suffix(order)
            below = model.select(F.col("lang").alias("slang"), F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("below"))
            model = rows.join(below, (F.col("lang") == F.col("slang")) & (shi == F.col("shi")) & (slo == F.col("slo")))
        model = model.select("lang", "hi", "lo", (F.col("own") + F.col("free") * F.col("below")).alias("p"))
    return model


# Constants of the 64-bit hash that Spark's xxhash64 computes for longs.
SEED, PRIMES = 42, [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def hash_longs(*columns: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for bigint columns."""
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.full(len(columns[0]), SEED, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in columns:
            h = h + PRIMES[4] + np.uint64(8)
            h ^= turned(column.astype(np.int64).view(np.uint64) * PRIMES[1], 31) * PRIMES[0]
            h = turned(h, 27) * PRIMES[0] + PRIMES[3]
            h ^= h >> np.uint64(33)
            h *= PRIMES[1]
            h ^= h >> np.uint64(29)
            h *= PRIMES[2]
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _context(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first four symbols of an n-gram of order five."""
    return hi >> POINT_BITS, ((hi & POINT) << (2 * POINT_BITS)) | (lo >> POINT_BITS)


def _bucket(hi: np.ndarray, lo: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of an n-gram by its context, so that a bucket holds whole contexts."""
    return (hash_longs(*_context(hi, lo)) % buckets).astype(np.int32)


def _cut_by_bucket(hi: np.ndarray, lo: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    own = _bucket(hi, lo, buckets)
    order = np.argsort(own, kind="stable")
    own = own[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    for a, b in zip(starts, np.r_[starts[1:], len(own)]):
        yield int(own[a]), order[a:b]


def _listed(keys: np.ndarray, hi: np.ndarray, lo: np.ndarray, grams: Grams, at: np.ndarray) -> tuple[int, bytes, bytes]:
    """n-grams of one bucket: differences of their sorted chunk keys and the chunk's code points, or where keys are no plain
    digits of code points, the n-grams themselves (bits 0)."""
    if grams.direct:
        return grams.bits, packed(np.diff(keys[at], prepend=0)), packed(grams.points)
    return 0, packed(hi[at]), packed(lo[at])


def _unlisted(bits: int, first: bytes, second: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, second = unpacked(first, np.int64), unpacked(second, np.int64)
    return code_points(np.cumsum(first), second, bits) if bits else (first, second)


ASKED = "bucket int, chunk bigint, lang string, bits int, hi binary, lo binary, n binary"


def _asked(text: str, buckets: int):
    """Distinct n-grams of every chunk and how often each occurs, packed by bucket."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, language, data in zip(*[batch.column(c).to_pylist() for c in ("chunk", "lang", "rows")]):
                grams = Grams(_texts(data, text))
                keys, n, hi, lo = grams.distinct()
                rows = [(bucket, chunk, language, *_listed(keys, hi, lo, grams, at), packed(n[at].astype(np.int32))) for bucket, at in _cut_by_bucket(hi, lo, buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                                     names=["bucket", "chunk", "lang", "bits", "hi", "lo", "n"])

    return run


COUNTS = "lang string, hi bigint, lo bigint, n bigint, total bigint, n1 bigint, n2 bigint, n3 bigint"


def _counted(bits, first, second, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of the lists of many chunks, and their counts. The lists are unpacked one after the other into
    place, and columns are sorted one at a time."""
    n = [unpacked(x, np.int32) for x in counts]
    ends = np.cumsum([len(x) for x in n])
    hi, lo = np.empty(ends[-1], dtype=np.int64), np.empty(ends[-1], dtype=np.int64)
    for end, own, *packs in zip(ends.tolist(), n, bits, first, second):
        hi[end - len(own):end], lo[end - len(own):end] = _unlisted(*packs)
    n = np.concatenate(n)
    order = np.lexsort((lo, hi))
    hi = hi[order]
    lo = lo[order]
    n = n[order]
    del order
    starts = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    return hi[starts], lo[starts], np.add.reduceat(n, starts, dtype=np.int64)


@tidied
def _summed(asks: pd.DataFrame) -> pd.DataFrame:
    """Counts of the n-grams of a bucket, and of their contexts: all occurrences, and n-grams seen once, twice, more often."""
    out = []
    for language, own in asks.groupby("lang"):
        hi, lo, n = _counted(*[own[c] for c in ("bits", "hi", "lo", "n")])
        rows = pd.DataFrame({"hi": hi, "lo": lo, "n": n})
        high, low = _context(hi, lo)
        starts = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        sizes = np.diff(np.r_[starts, len(n)])
        del high, low
        # A context has fewer n-grams than there are code points; its occurrences have no such bound.
        for name, value, kind in (("total", n, np.int64), ("n1", n == 1, np.int32), ("n2", n == 2, np.int32), ("n3", n > 2, np.int32)):
            rows[name] = np.repeat(np.add.reduceat(value, starts, dtype=kind), sizes)
        rows.insert(0, "lang", language)
        out.append(rows)
    return pd.concat(out)


def _finder(hi: np.ndarray, lo: np.ndarray, values: np.ndarray):
    """Looks up values of wanted n-grams: bisection in the array of sorted hashes, on to the next equal hash where two collide."""
    hashes = hash_longs(hi, lo)
    order = np.argsort(hashes, kind="stable")
    hashes, hi, lo, values = hashes[order], hi[order], lo[order], values[order]

    def found(want_hi: np.ndarray, want_lo: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hashes, hash_longs(want_hi, want_lo))
        while (wrong := (hi[at] != want_hi) | (lo[at] != want_lo)).any():
            at = at + wrong
        return values[at]

    return found


@tidied
def _answered(asks: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    out = []
    for language, own in asks.groupby("lang"):
        known = model[model["lang"] == language]
        found = _finder(*(known[c].to_numpy() for c in ("hi", "lo", "value")))
        # The lists of the chunks are many times the model of the bucket, so they are unpacked and answered one after the other.
        out += [(chunk, bucket, packed(found(*_unlisted(*lists)).astype(np.float32))) for chunk, bucket, *lists in zip(*(own[c] for c in ("chunk", "bucket", "bits", "hi", "lo")))]
    return pd.DataFrame(out, columns=["chunk", "bucket", "value"])


COUNTED = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_())]


def _scored(text: str, carry: list[str], keep_only: bool, buckets: int):
    """Chunks with the carried columns and base counts of their rows, and the bits per character; `long` has those that count for the quartiles.

    With `keep_only`, rows that fail the base rules leave here.
    """
    def bits_of(texts: list[bytes], answers: pd.DataFrame) -> np.ndarray:
        grams = Grams(texts)
        keys, _, hi, lo = grams.distinct()
        values, found = np.zeros(len(keys), dtype=np.float32), dict(zip(answers["bucket"], answers["value"]))
        for bucket, at in _cut_by_bucket(hi, lo, buckets):
            values[at] = unpacked(found[bucket], np.float32)
        del hi, lo
        return grams.bits_per_char(keys, values)

    @tidied
    def run(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = chunks.iloc[0]
        rows = pa.Table.from_batches(_rows_of(row["rows"]))
        texts = [t for b in rows.to_batches() for t in text_bytes(b.column(text))]
        bits = bits_of(texts, answers)
        long = np.array([t.count(b" ") + t.count(b"\n") + 1 >= MIN_WORDS for t in texts])
        counts = [base_counts(t) for t in texts]
        counts = [(*c, base_failed(c[0], c[4])) for c in counts]
        own, kept = rows.select(carry), np.array([not (keep_only and c[5]) for c in counts])
        for k, (name, kind) in enumerate([] if keep_only else COUNTED):
            own = own.append_column(name, pa.array([c[k] for c in counts], kind))
        return pd.DataFrame({"lang": [row["lang"]], "rows": [_rows_packed(own.filter(pa.array(kept)))], "bits": [bits[kept].tolist()], "long": [bits[long].tolist()]})

    return run


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbol characters, repeated lines, words inside repeated three-word windows."""
    words = text.split()
    if not words:
        return 0, 0, sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), 0, 0
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    chars = int(seen.sum() - seen[128:192].sum() - seen[9:14].sum() - seen[32])
    symbols = int(seen[[35, 36, 37, 38, 42, 60, 62, 124]].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        ids: dict[bytes, int] = {}
        order = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
        size = len(ids)
        pairs = order[:-1] * size + order[1:]
        if size > 2_000_000:
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * size + order[2:]
        _, which, n = np.unique(windows, return_inverse=True, return_counts=True)
        twice = n[which] > 1
        if twice.any():
            hit = np.zeros(len(words), dtype=bool)
            for k in range(3):
                hit[k:len(words) - 2 + k] |= twice
            repeated = int(hit.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def perplexity_bands(scored: DataFrame) -> DataFrame:
    """(lang, low, high): bits per character from the quartiles over all texts of a language of `MIN_WORDS` words or more."""
    rows = scored.select("lang", F.explode("long").alias("b")).groupBy("lang").agg(F.percentile_approx("b", [0.25, 0.75], 10_000).alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    spread = F.greatest(q3 - q1, F.lit(MIN_BAND / BAND_WIDTH))
    return rows.select("lang", (q1 - BAND_WIDTH * spread).alias("low"), (q3 + BAND_WIDTH * spread).alias("high"))


def scored_chunks(docs: DataFrame, text: str, lang: str, carry: list[str], keep_only: bool) -> DataFrame:
    """(lang, rows, bits, long): the rows in packed chunks of one language, with the bits per character of each."""
    chunks = stored(docs.mapInArrow(_chunked(text, lang), CHUNKED))
    size = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, size // BUCKET + 1)
    asked = chunks.select("chunk", "lang", "rows").mapInArrow(_asked(text, buckets), ASKED)
    counts = asked.drop("chunk").groupBy("bucket").applyInPandas(_summed, COUNTS)
    hi, lo = F.col("hi"), F.col("lo")
    context = F.xxhash64(F.shiftright(hi, POINT_BITS), F.shiftleft(hi.bitwiseAND(F.lit(POINT)), 2 * POINT_BITS).bitwiseOR(F.shiftright(lo, POINT_BITS)))
    model = kneser_ney(stored(counts)).select(F.pmod(context, F.lit(buckets)).cast("int").alias("bucket"), "lang", "hi", "lo", F.log2("p").cast("float").alias("value"))
    answers = asked.drop("n").groupBy("bucket").cogroup(model.groupBy("bucket")).applyInPandas(_answered, "chunk bigint, bucket int, value binary")
    parts = chunks.select("chunk", "lang", "rows").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return stored(parts.applyInPandas(_scored(text, carry, keep_only, buckets), "lang string, rows binary, bits array<double>, long array<double>"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", keep_only: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Input rows with base counts, bits per character, the band of their language and the verdict `kept`.

    `keep_only` returns the kept rows with the input columns alone; `carry` names the input columns that are returned, all if missing.
    """
    small_batches(docs.sparkSession)
    carry = carry or docs.columns
    if keep_only:
        source, schema = docs, docs.select(*carry).schema
    else:
        source, _ = appended(docs, STAT_COLUMNS)
        carry = [c for c in carry if c in source.columns]
        _, schema = appended(source.select(*[F.col(f"`{c}`") for c in carry]), STAT_COLUMNS)
    scored = scored_chunks(source, text, lang, carry, keep_only)

    @tidied
    def judged(batches):
        for batch in batches:
            for data, bits, low, high in zip(*[batch.column(c).to_pylist() for c in ("rows", "bits", "low", "high")]):
                low, high = (-np.inf, np.inf) if low is None else (low, high)
                at = 0
                for rows in _rows_of(data):
                    own = np.array(bits[at:at + rows.num_rows], dtype=np.float64)
                    at += rows.num_rows
                    kept = (own >= low) & (own <= high)
                    if keep_only:
                        yield from sized_slices(rows.filter(pa.array(kept)), text) if text in carry else [rows.filter(pa.array(kept))]
                        continue
                    kept &= ~rows.column("base_failed").to_numpy(zero_copy_only=False)
                    values = {"bits_per_char": pa.array(own, mask=np.isnan(own)), "band_low": pa.array(np.full(len(own), low)), "band_high": pa.array(np.full(len(own), high)),
                              "kept": pa.array(kept)}
                    done = with_columns(rows, values, schema)
                    yield from sized_slices(done, text) if text in carry else [done]

    return scored.join(F.broadcast(perplexity_bands(scored)), "lang", "left").select("rows", "bits", "low", "high").mapInArrow(judged, schema)


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits_per_char",
                         "band_low", "band_high")
