"""Benchmark decontamination: an FM-index per shard of training texts, searched backwards for the windows of all items.

Only words that occur in the benchmark can be part of a match, so each task keeps the runs of such words that are at
least as long as the shortest window and drops the rest; nothing that could match is lost. The kept runs of a shard,
one separator between them, form the indexed sequence. Its suffix array comes from prefix doubling; the wavelet tree
over the Burrows-Wheeler transform answers ranks, suffix positions are sampled, and all windows step through the
backward search together. Occurrences become word spans, which are merged per document.

Memory: a shard holds at most `SHARD_WORDS` kept words (or one text, if that has more). The windows of the items are
broadcast in blocks of at most `BLOCK_BYTES` of item text; a larger benchmark takes several passes.

Defined cases: null and empty texts have no words; null or empty items have no windows; of items with the same id every
one counts, but the id is listed once; a null item id is not listed, though its words are hit; repeated documents are
treated alike; further columns pass through, except those written here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistagrid.llm.common import WORD_TABLE, appended, sized_slices, small_batches, table, text_bytes, with_columns
from vistagrid.llm.registry import query

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20
SAMPLE = 8
STEPS = 1 << 19
ADDED = ("n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<bigint>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be smaller than all others and occur once."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    # A rank is the place of the first suffix that shares it.
    rank[order] = np.maximum.accumulate(np.where(np.r_[True, symbols[order][1:] != symbols[order][:-1]], np.arange(n), 0))
    width = 1
    # Only suffixes that still share their rank with another one are sorted again.
    while True:
        ranked = rank[order]
        tied = np.r_[ranked[1:] == ranked[:-1], False] | np.r_[False, ranked[1:] == ranked[:-1]]
        if not tied.any():
            return order
        at = np.flatnonzero(tied)
        open_ = order[at]
        follow = np.where(open_ + width < n, rank[np.minimum(open_ + width, n - 1)] + 1, 0)
        again = np.lexsort((follow, ranked[at]))
        open_, follow, own = open_[again], follow[again], ranked[at][again]
        order[at] = open_
        fresh = np.r_[True, (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])]
        first = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], np.arange(len(at)), 0))
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        rank[open_] = own + begin - first
        width *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector per level, each with a running count of its ones."""

    def __init__(self, sequence: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        current = sequence
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            self.zeros.append(len(current) - int(self.ones[-1][-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its position."""
        low = np.zeros_like(position)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            low_ones, ones_ = ones[low], ones[position]
            low = np.where(bit == 1, zeros + low_ones, low - low_ones)
            position = np.where(bit == 1, zeros + ones_, position - ones_)
        return position - low

    def access(self, position: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(position)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[position + 1] - ones[position]
            symbol = (symbol << 1) | bit
            position = np.where(bit == 1, zeros + ones[position], position - ones[position])
        return symbol


class FMIndex:
    """Backward search and location over one sequence of symbols 1..size-1; symbol 0 is the end mark."""

    def __init__(self, sequence: np.ndarray, size: int):
        text = np.r_[sequence, 0].astype(np.int64)
        order = suffix_order(text)
        self.n = len(text)
        self.wavelet = WaveletTree(text[order - 1], size)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]
        sampled = order % SAMPLE == 0
        self.mark = np.r_[0, np.cumsum(sampled)]
        self.position = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all patterns (rows, left-aligned) at once."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for step in range(int(lengths.max(initial=0))):
            alive = alive[(low[alive] < high[alive]) & (lengths[alive] > step)]
            if not len(alive):
                break
            symbol = patterns[alive, lengths[alive] - 1 - step]
            first = self.before[symbol]
            low[alive] = first + self.wavelet.rank(symbol, low[alive])
            high[alive] = first + self.wavelet.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: steps back in the text until a sampled position."""
        found = np.empty(len(rows), dtype=np.int64)
        walking, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(walking):
            sampled = self.mark[at + 1] > self.mark[at]
            found[walking[sampled]] = self.position[self.mark[at[sampled]]] + steps
            walking, at = walking[~sampled], at[~sampled]
            symbol = self.wavelet.access(at)
            at = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return found


class Phrases:
    """Windows of a block of items: distinct rows of word numbers (1 is the separator, words start at 2)."""

    def __init__(self, rows: list[tuple[int | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[k:k + window]), set()).add(item)
        self.lengths = np.array([len(w) for w in owners], dtype=np.int64)
        self.patterns = np.zeros((len(owners), window), dtype=np.int64)
        for k, w in enumerate(owners):
            self.patterns[k, :len(w)] = w
        self.items = [sorted(i for i in o if i is not None) for o in owners.values()]
        self.shortest = int(self.lengths.min(initial=window))
        self.size = len(self.vocabulary) + 2


def kept_runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of nonzero ids that are at least `shortest` long."""
    edge = np.flatnonzero(np.diff(np.r_[0, ids != 0, 0].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= shortest
    return starts[long], ends[long]


def search_shard(phrases: Phrases, shard: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a shard of (row, first word, ids) runs: (row, start, end, window) arrays of all occurrences."""
    if not shard:
        return
    pieces, rows, firsts, at, begin = [], [], [], 0, []
    for row, first, ids in shard:
        pieces += [ids, np.array([1])]
        rows.append(row)
        firsts.append(first)
        begin.append(at)
        at += len(ids) + 1
    index = FMIndex(np.concatenate(pieces), phrases.size)
    low, high = index.search(phrases.patterns, phrases.lengths)
    rows, firsts, begin = np.array(rows), np.array(firsts), np.array(begin)
    hit = np.flatnonzero(high > low)
    counts = (high - low)[hit]
    # Occurrences are located a bounded number at a time.
    ends = np.cumsum(counts)
    lo, total = 0, int(counts.sum())
    while lo < total:
        hi = min(total, lo + STEPS)
        k = np.searchsorted(ends, np.arange(lo, hi), side="right")
        position = index.locate(low[hit[k]] + np.arange(lo, hi) - (ends[k] - counts[k]))
        run = np.searchsorted(begin, position, side="right") - 1
        start = firsts[run] + position - begin[run]
        yield rows[run], start, start + phrases.lengths[hit[k]], hit[k]
        lo = hi


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; touching ones are joined."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[fresh], reach[np.r_[fresh[1:] - 1, len(start) - 1]]


def _searched(part: pa.RecordBatch, text: str, phrases: Phrases, known: list | None, items: list | None):
    """Word counts, spans and item ids of every row, added to what earlier blocks found."""
    words, shard, held = np.zeros(part.num_rows, dtype=np.int64), [], 0
    found: list[list] = [[(np.array([s["start"] for s in r], dtype=np.int64), np.array([s["end"] for s in r], dtype=np.int64))] if r else [] for r in known] if known \
        else [[] for _ in range(part.num_rows)]
    owners = [set(r or []) for r in items] if items else [set() for _ in range(part.num_rows)]

    def flush():
        for rows, start, end, window in search_shard(phrases, shard):
            order = np.argsort(rows, kind="stable")
            rows, start, end, window = rows[order], start[order], end[order], window[order]
            cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(rows)]):
                found[rows[a]].append(merged_spans(start[a:b], end[a:b]))
                for w in np.unique(window[a:b]).tolist():
                    owners[rows[a]].update(phrases.items[w])

    get = phrases.vocabulary.get
    for row, t in enumerate(text_bytes(part.column(text))):
        own = words_of(t)
        words[row] = len(own)
        ids = np.fromiter((get(w, 0) for w in own), dtype=np.int64, count=len(own))
        for a, b in zip(*kept_runs(ids, phrases.shortest)):
            shard.append((row, a, ids[a:b]))
            held += b - a + 1
        if held >= SHARD_WORDS:
            flush()
            shard.clear()
            held = 0
    flush()
    spans = []
    for f in found:
        if not f:
            spans.append([])
            continue
        start, end = merged_spans(np.concatenate([x[0] for x in f]), np.concatenate([x[1] for x in f]))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end)])
    return words, spans, [sorted(o) for o in owners]


def item_blocks(items: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """Disjoint parts of the items, each of about `limit` bytes of text at most, told apart by a hash."""
    rows = items.select(F.col(item_id).alias("item"), F.col(text).alias("t")).where(F.length("t") > 0)
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(size // limit) + 1
    return [rows.where(F.pmod(F.xxhash64("item", "t"), F.lit(n)) == k) for k in range(n)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """Input rows with `n_words`, `n_hit`, merged word `spans` [start, end) and the ids of the `items` found."""
    out, schema = appended(docs, ADDED)
    spark = docs.sparkSession
    small_batches(spark)
    names = [c.split()[0] for c in ("n_words", "n_hit", "spans", "items")]
    first = True
    for block in item_blocks(benchmark, item_id, item_text):
        phrases = spark.sparkContext.broadcast(Phrases([(r.item, r.t.encode()) for r in block.collect()], window))

        def searched(batches, phrases=phrases, first=first):
            for batch in batches:
                for part in sized_slices(batch, text):
                    known = None if first else part.column("spans").to_pylist()
                    items = None if first else part.column("items").to_pylist()
                    words, spans, owners = _searched(part, text, phrases.value, known, items)
                    hits = [sum(s["end"] - s["start"] for s in r) for r in spans]
                    made = [pa.array(words), pa.array(hits, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                            pa.array(owners, pa.list_(pa.int64()))]
                    yield with_columns(part, dict(zip(names, made)), schema)

        out = out.mapInArrow(searched, schema)
        first = False
    return out


def without_hits(hits: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `benchmark_hits` with the words of every span cut out of the text; text around them stays as it is."""
    columns = [c for c in hits.columns if c not in ("n_words", "n_hit", "spans", "items")]
    schema = hits.select(*columns).schema

    def cut(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    data = texts[k].encode()
                    flags = np.r_[0, np.frombuffer(data.translate(WORD_TABLE), dtype=np.uint8) != 32, 0].astype(np.int8)
                    edge = np.flatnonzero(np.diff(flags))
                    starts, ends = edge[::2], edge[1::2]
                    parts, at = [], 0
                    for s in spans:
                        parts.append(data[at:starts[s["start"]]])
                        at = ends[s["end"] - 1]
                    texts[k] = b"".join([*parts, data[at:]]).decode()
            own = {c: batch.column(c) for c in columns} | {text: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([own[c] for c in columns], names=columns)

    return hits.mapInArrow(cut, schema)


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    joined = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))
