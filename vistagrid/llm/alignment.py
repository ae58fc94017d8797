"""Cross-tokenizer alignment of a byte-level BPE (A) and a piece BPE with byte fallback (B).

Rows are grouped by their full text, so each distinct text is tokenised and aligned once, however many copies it has. Both
tokenisations of space + text spell the same bytes; offsets where a token of A and a token of B both end cut them into
groups, and two tokens whose byte ranges overlap are linked. Steps:

1. Distinct texts with their number of copies. Tasks tokenise them in chunks; a chunk keeps its distinct (A id, B id) pairs,
   their links weighted by copies, and for each text the pairs it holds, packed.
2. Pair counts are summed over all chunks; the highest count of each B id has one row per vocabulary entry (at most 32,000
   here), which is the only thing broadcast besides the vocabularies.
3. Each chunk asks for the counts of its own distinct pairs in one join, and the answers meet the packed texts again.
4. Measures of the distinct texts go back to the documents by the SHA-256 of the text. Texts with over a thousandth of all
   copies, at most 999 of them by counting, are joined by broadcast; every other text has few copies.

Defined cases: null and empty texts, and texts whose tokens do not spell space + text (a text with U+2581), have no tokens:
all numbers 0, `groups_sha256` empty. Strings of special tokens are plain text. Repeated rows are kept and count as often as
they stand there. Very long texts form a chunk of their own and are tokenised whole. Ties for the highest count are all
best. An empty table gives no rows. Further columns pass through, except those written here.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistagrid.llm.bpe import byte_symbols
from vistagrid.llm.common import appended, sized_slices, stored, table
from vistagrid.llm.registry import query

# Text bytes that are aligned together, and the share of all copies (one in so many) above which a text is joined by broadcast.
CHUNK = 6 << 20
HOT_SHARE = 1000
# Runs of white space that the fast tokenizer's pattern cannot take.
LONG_SPACE = re.compile(r"\s{5000}")
COMMA, BAR, SEMICOLON, LAST = range(4)
MEASURES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
CHUNKED = "chunk bigint, digests binary, measures binary, groups array<string>, keys binary, weights binary, sizes binary, members binary, copies binary"


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 3)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


class ByteTokenizer:
    """Ids and token bytes of a byte-level BPE, read from its JSON file.

    Ids follow the order of the merges, so the vocabulary doubles as the rank table of the faster library; the plain
    library takes vocabularies without that order and texts with very long runs of white space.
    """

    def __init__(self, data: bytes):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(data)
        added = {t["content"] for t in spec["added_tokens"]}
        back = {s: b for b, s in enumerate(byte_symbols())}
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in added}
        self.bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for symbols, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in symbols)
        merged = [vocab[left + right] for left, right in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.plain = Tokenizer.from_buffer(data)
        self.plain.encode_special_tokens = True
        self.fast = None
        if all(a < b for a, b in zip(merged, merged[1:])):
            ranks = {self.bytes[i]: i for i in vocab.values()}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or len(text) > 5000 and LONG_SPACE.search(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokenizer:
    """Ids and token bytes of a piece model; it puts the space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(self.model.id_to_piece(i) for i in range(n))]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def _strings(n: int) -> list[bytes]:
    """Decimal ids followed by each separator: entry separator * n + id."""
    return [b"%d%s" % (i, s) for s in (b",", b"|", b";", b"") for i in range(n)]


@dataclass
class Vocabularies:
    a: ByteTokenizer
    b: PieceTokenizer

    def __post_init__(self):
        self.size = max(len(self.a.bytes), len(self.b.bytes))
        self.lengths = [np.array([len(t) for t in v.bytes], dtype=np.int64) for v in (self.a, self.b)]
        self.strings = _strings(self.size)


def _merged(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """A and B ids in the order of the group text, each with its separator as separator * size + id."""
    n = len(last)
    per_a, per_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    start_b, end_a = np.cumsum(per_b) - per_b, np.cumsum(per_a)
    at_a, at_b = np.arange(len(a)) + start_b[group_a], np.arange(len(b)) + end_a[group_b]
    out = np.empty(len(a) + len(b), np.int64)
    end = np.r_[group_a[1:] != group_a[:-1], True]
    out[at_a] = a + size * np.where(end, BAR, COMMA)
    end = np.r_[group_b[1:] != group_b[:-1], True]
    out[at_b] = b + size * np.where(end, np.where(last[group_b], LAST, SEMICOLON), COMMA)
    return out


def align(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each A token, group of each B token, and the links as (A position, B position), from byte ends; also the group ends."""
    common_a = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a
    common_b = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
    group_a, group_b = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
    starts_a = np.r_[0, ends_a[:-1]]
    first, final = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a, "left")
    n = final - first + 1
    left = np.repeat(np.arange(len(a)), n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return group_a, group_b, left, right, ends_a[common_a]


def _chunk(vocabularies: Vocabularies, raws: list[bytes], copies: np.ndarray):
    """Tokenises and aligns the texts of a chunk."""
    a_rows, b_rows, used = [], [], []
    for k, raw in enumerate(raws):
        text = raw.decode("utf-8", "replace")
        a, b, whole = vocabularies.a.encode(" " + text), vocabularies.b.encode(text), b" " + raw
        if b"".join(map(vocabularies.a.bytes.__getitem__, a)) == whole and b"".join(map(vocabularies.b.bytes.__getitem__, b)) == whole:
            a_rows.append(np.array(a, dtype=np.int64))
            b_rows.append(np.array(b, dtype=np.int64))
            used.append(k)
    if not used:
        return None
    sizes_a, sizes_b = np.array([len(r) for r in a_rows]), np.array([len(r) for r in b_rows])
    a, b = np.concatenate(a_rows), np.concatenate(b_rows)
    text_of_a = np.repeat(np.arange(len(used)), sizes_a)
    group_a, group_b, left, right, group_ends = align(a, b, np.cumsum(vocabularies.lengths[0][a]), np.cumsum(vocabularies.lengths[1][b]))
    last_of_text = group_a[np.cumsum(sizes_a) - 1]
    last = np.zeros(len(group_ends), dtype=bool)
    last[last_of_text] = True
    n_groups = np.diff(np.r_[-1, last_of_text])
    tokens = _merged(a, b, group_a, group_b, last, vocabularies.size)
    cuts = np.cumsum(sizes_a + sizes_b)
    strings = vocabularies.strings
    groups = [hashlib.sha256(b"".join(map(strings.__getitem__, tokens[lo:hi].tolist()))).hexdigest() for lo, hi in zip(np.r_[0, cuts[:-1]], cuts)]
    links = (a[left] << 32) | b[right]
    owner = text_of_a[left]
    del tokens, left, right, group_a, group_b
    keys, place = np.unique(links, return_inverse=True)
    held, times = np.unique((owner << 32) | place, return_counts=True)
    text_of, member = held >> 32, held & 0xFFFFFFFF
    weights = np.zeros(len(keys), dtype=np.int64)
    np.add.at(weights, member, times * copies[np.array(used)][text_of])
    sizes = np.bincount(text_of, minlength=len(used))
    steps = np.diff(np.r_[0, member])
    steps[np.cumsum(sizes) - sizes] = member[np.cumsum(sizes) - sizes]
    measures = np.stack([sizes_a, sizes_b, n_groups, np.bincount(owner, minlength=len(used))]).astype(np.int64)
    return used, measures, groups, keys, weights, sizes.astype(np.int64), steps.astype(np.int32), times.astype(np.int32)


def _tokenised(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number, vocabularies = TaskContext.get(), 0, None
        for batch in batches:
            for part in sized_slices(batch, "t", CHUNK):
                vocabularies = vocabularies or Vocabularies(ByteTokenizer(shared.value[0]), PieceTokenizer(shared.value[1]))
                raws = part.column("t").cast(pa.large_binary()).to_pylist()
                copies = part.column("copies").to_numpy(zero_copy_only=False).astype(np.int64)
                done = _chunk(vocabularies, raws, copies)
                if done is None:
                    continue
                used, measures, groups, keys, weights, sizes, steps, times = done
                digests = b"".join(hashlib.sha256(raws[k]).digest() for k in used)
                values = [[(context.partitionId() << 32) | number], [digests], [_packed(measures)], [groups], [_packed(np.diff(keys, prepend=0))], [_packed(weights)],
                          [_packed(sizes)], [_packed(np.r_[steps, times])], [_packed(copies[np.array(used)])]]
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 5]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in CHUNKED.split(", ")])

    return run


def _pair_rows(batches):
    """(chunk, pair, links weighted by copies) of every chunk."""
    for batch in batches:
        for chunk, keys, weights in zip(*(batch.column(c).to_pylist() for c in ("chunk", "keys", "weights"))):
            keys = np.cumsum(_unpacked(keys, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk), pa.int64()), pa.array(keys), pa.array(_unpacked(weights, np.int64))], names=["chunk", "pair", "n"])


MEASURED = "digest binary, copies bigint, " + MEASURES


def _measured(answers: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
    """Measures of the texts of one chunk from the counts of its pairs."""
    if chunks.empty:
        return pd.DataFrame({c.split()[0]: [] for c in MEASURED.split(", ")})
    row = chunks.iloc[0]
    answers = answers.sort_values("pair")
    count, best = answers["count"].to_numpy(np.int64), answers["best"].to_numpy(bool)
    sizes = _unpacked(row["sizes"], np.int64)
    both = _unpacked(row["members"], np.int32).astype(np.int64)
    steps, times = both[:len(both) // 2], both[len(both) // 2:]
    starts = np.cumsum(sizes) - sizes
    run = np.cumsum(steps)
    member = run - np.repeat(run[starts] - steps[starts], sizes)
    n_a, n_b, n_groups, n_links = _unpacked(row["measures"], np.int64).reshape(4, -1)
    digests = row["digests"]
    return pd.DataFrame({"digest": [digests[i:i + 32] for i in range(0, len(digests), 32)], "copies": _unpacked(row["copies"], np.int64), "n_a": n_a, "n_b": n_b,
                         "n_groups": n_groups, "n_links": n_links, "n_best": np.add.reduceat(times * best[member], starts),
                         "count_sum": np.add.reduceat(times * count[member], starts), "groups_sha256": list(row["groups"])})


@dataclass
class Alignment:
    """`pairs`: a_id, b_id, count of links corpus-wide, best. `texts`: measures of each distinct text under its digest."""

    pairs: DataFrame
    texts: DataFrame


def aligned_texts(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> Alignment:
    """Aligns every distinct text of `docs`; the two paths name the vocabulary files on the driver."""
    spark = docs.sparkSession
    files = []
    for path in (byte_path, piece_path):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = spark.sparkContext.broadcast(files)
    distinct = docs.select(F.col(f"`{text}`").alias("t")).where("t <> ''").groupBy("t").agg(F.count("*").alias("copies"))
    chunks = stored(distinct.mapInArrow(_tokenised(shared), CHUNKED))
    asked = chunks.select("chunk", "keys", "weights").mapInArrow(_pair_rows, "chunk bigint, pair bigint, n bigint")
    counts = stored(asked.groupBy("pair").agg(F.sum("n").alias("count")))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("highest"))
    known = counts.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = asked.select("chunk", "pair").join(known, "pair")
    texts = answers.groupBy("chunk").cogroup(chunks.select("chunk", "digests", "measures", "groups", "sizes", "members", "copies").groupBy("chunk")).applyInPandas(_measured, MEASURED)
    pairs = known.select(F.shiftright("pair", 32).alias("a_id"), b_id.alias("b_id"), "count", "best")
    return Alignment(pairs, stored(texts))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """Input rows with the measures of their text."""
    kept, _ = appended(docs, MEASURES, drop=["digest", "copies"])
    done = aligned_texts(kept, byte_path, piece_path, text)
    names = [m.split()[0] for m in MEASURES.split(", ")]
    zero = [F.coalesce(F.col(n), F.lit("" if n == "groups_sha256" else 0)).alias(n) for n in names]
    own = [F.col(f"`{c}`") for c in kept.columns]
    many = F.col("copies") * HOT_SHARE > kept.count()
    hot, rest = F.broadcast(done.texts.where(many).drop("copies")), done.texts.where(~many).drop("copies")
    empty = F.coalesce(F.col(f"`{text}`") == "", F.lit(True))
    keyed = kept.where(~empty).withColumn("digest", F.unhex(F.sha2(F.col(f"`{text}`"), 256)))
    without = [F.lit("" if n == "groups_sha256" else 0).alias(n) for n in names]
    return (keyed.join(hot, "digest").select(*own, *zero)
            .unionAll(keyed.join(hot.select("digest"), "digest", "left_anti").join(rest, "digest", "left").select(*own, *zero))
            .unionAll(kept.where(empty).select(*own, *[c if n == "groups_sha256" else c.cast("bigint").alias(n) for c, n in zip(without, names)])))


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return aligned(docs, *default_paths()).drop("text")
