"""BPE encoding and decoding: batched merge rounds over one flat symbol array.

The distinct words of a batch lie one behind the other in a flat array of symbol ids. One round looks up the rank of
every adjacent pair by bisection in the sorted pair keys of the merge table, takes the lowest rank of each word, merges
all its occurrences from left to right, and drops finished words. Words leave in as many rounds as they need.

The vocabulary file is read once on the driver and broadcast: its size is fixed by the tokenizer, not by the corpus.

Defined cases: null reads as empty; an empty text has no tokens; strings of special tokens become those tokens, as in
the library's default; repeated rows are encoded alike; further columns pass through, except those written here.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistagrid.llm.common import appended, sha, sized_slices, small_batches, table, with_columns
from vistagrid.llm.registry import query

# Chunks that one task remembers before it starts anew.
MEMORY = 150_000
NO_RANK = np.iinfo(np.int32).max
# Letters and digits of Unicode 17, which the tokenizers library (Unicode 16) does not class as such,
# and capitals whose lower case Python's older tables lack, as (first, last, first lower case).
LATER_LETTERS = """558 558 58b 58c 88f 88f c5c c5c cdc cdc 208f 208f 209d 209f a7ce a7cf a7d2 a7d2 a7d4 a7d4 a7dd a7dd a7e2 a7e2 a7f1 a7f1
ab6c ab6d 107bb 107bf 10940 10959 10ec5 10ec7 10ed9 10eee 11b0a 11b0a 11db0 11ddb 11de0 11de9 11df1 11df1 1246f 1246f 12475 1247f
12550 12686 16ea0 16eb8 16ebb 16ed3 16ff2 16ff6 187f8 187ff 18cd6 18cda 18d09 18d20 18d80 18df2 18e00 19191 191a0 191d2 1b123 1b128
1b168 1b168 1d6a6 1d6a6 1df1f 1df24 1df2b 1df81 1df90 1df96 1dfcd 1dfff 1e6c0 1e6de 1e6e0 1e6e2 1e6e4 1e6e5 1e6e7 1e6ed 1e6f0 1e6f4
1e6fe 1e6ff 2b73a 2b73f 2b81e 2b81e 2cea2 2cead 323b0 33479 3d000 3fc3f""".split()
LATER_CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
                  (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
LOWER_FIRST = {a + k: low + k for a, b, low in LATER_CAPITALS for k in range(b - a + 1)} | {ord("Σ"): ord("σ")}
KINDS = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}


def byte_symbols() -> list[str]:
    """Character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Merge table with sorted pair keys, symbols of single bytes, and token strings."""

    pair_keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    inner: np.ndarray
    final: np.ndarray
    tokens: list[bytes]
    specials: dict[str, int]
    words: str
    shift: int = 20
    _split: re.Pattern | None = field(default=None, repr=False)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        left = np.array([vocab[a] for a, _ in model["merges"]], dtype=np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int32)
        keys = (left << 20) | right
        order = np.argsort(keys)
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
        for word, i in {**vocab, **specials}.items():
            tokens[i] = word.encode()
        symbols = byte_symbols()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return cls(keys[order], order.astype(np.int32), made[order], np.array([vocab[s] for s in symbols], dtype=np.int32),
                   np.array([vocab[s + end] for s in symbols], dtype=np.int32), tokens, specials, pattern)

    def split_words(self, chunk: str) -> list[str]:
        if self._split is None:
            later = "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in zip(LATER_LETTERS[::2], LATER_LETTERS[1::2]))
            classes = {kind: rf"[\p{{{kind}}}--[{later}]]" for kind in "LN"}
            self._split = regex.compile(self.words.replace(r"\p{L}", classes["L"]).replace(r"\p{N}", classes["N"]), regex.V1)
        return self._split.findall(chunk)

    def __getstate__(self):
        return {**self.__dict__, "_split": None}


def merge_rounds(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, flat, and the number of tokens of each word. No word may be empty."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    symbols = vocab.inner[flat]
    symbols[np.cumsum(lengths) - 1] = vocab.final[flat[np.cumsum(lengths) - 1]]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_owner = [], []
    while len(symbols):
        inside = owner[:-1] == owner[1:]
        keys = (symbols[:-1].astype(np.int64) << vocab.shift) | symbols[1:]
        at = np.minimum(np.searchsorted(vocab.pair_keys, keys), len(vocab.pair_keys) - 1)
        rank = np.where(inside & (vocab.pair_keys[at] == keys), vocab.ranks[at], NO_RANK)
        rank = np.append(rank, NO_RANK)
        starts = np.flatnonzero(np.r_[True, ~inside])
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        finished = np.repeat(best == NO_RANK, sizes)
        if finished.any():
            done_symbols.append(symbols[finished])
            done_owner.append(owner[finished])
        chosen = (rank == np.repeat(best, sizes)) & ~finished
        # Pairs of equal symbols overlap: of a run of matches every second one counts, from the left.
        follows = np.r_[False, chosen[:-1]] & chosen
        if follows.any():
            position = np.arange(len(chosen))
            first = np.maximum.accumulate(np.where(chosen & ~follows, position, -1))
            chosen &= (position - first) % 2 == 0
        hit = np.flatnonzero(chosen)
        symbols[hit] = vocab.merged[at[hit]]
        keep = ~finished
        keep[hit + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    all_symbols, all_owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    order = np.argsort(all_owner, kind="stable")
    return all_symbols[order], np.bincount(all_owner, minlength=len(words))


SPACES_OF_PYTHON_ONLY = re.compile("[\x1c-\x1f]")
ODD_CAPITALS = re.compile("[" + "".join(map(chr, LOWER_FIRST)) + "]")
WHITE = regex.compile(r"\p{White_Space}+")


def _chunks(text: str) -> list[str]:
    """Runs without white space of the normalized text: composed, each character lower-cased by itself."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if ODD_CAPITALS.search(text):
            text = text.translate(LOWER_FIRST)
    text = text.lower()
    if SPACES_OF_PYTHON_ONLY.search(text):
        return [c for c in WHITE.split(text) if c]
    return text.split()


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Concatenation of the slices [starts, starts + counts) chosen by `index`."""
    n = counts[index]
    if not len(n):
        return values[:0]
    offset = np.repeat(starts[index] - np.r_[0, np.cumsum(n)[:-1]], n)
    return values[offset + np.arange(len(offset))]


class Encoder:
    """Encodes batches of texts; remembers the chunks it has met, up to `MEMORY`."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        names = sorted(vocab.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.counts = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)
        self.shown: list[bytes] = []

    def _learn(self, names: list[str]) -> None:
        specials = self.vocab.specials
        words: dict[str, int] = {}
        parts, sizes = [], []
        for name in names:
            own = [name[1:]] if name[0] == "\x00" and name[1:] in specials else self.vocab.split_words(name)
            marked = name if own and own[0] == name[1:] and own[0] in specials else None
            parts.extend(words.setdefault(marked or w, len(words)) for w in own)
            sizes.append(len(own))
        plain = [w for w in words if not (w[0] == "\x00" and w[1:] in specials)]
        flat, n = merge_rounds(self.vocab, [w.encode() for w in plain])
        starts = np.cumsum(n) - n
        if len(plain) < len(words):
            flat = np.concatenate([flat, np.array([specials[w[1:]] for w in words if w[0] == "\x00" and w[1:] in specials], dtype=np.int32)])
            at = {w: (s, c) for w, s, c in zip(plain, starts, n)}
            extra = iter(range(int(n.sum()), len(flat)))
            pairs = [at[w] if w in at else (next(extra), 1) for w in words]
            starts, n = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        parts = np.array(parts, dtype=np.int64)
        tokens = _gather(flat, starts, n, parts)
        per_part = n[parts] if len(parts) else np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        sums = np.r_[0, np.cumsum(per_part)]
        counts = sums[ends] - sums[ends - np.array(sizes)]
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, tokens])
        strings = [self.vocab.tokens[i] for i in tokens.tolist()]
        at = 0
        for c in counts.tolist():
            self.shown.append(b" ".join(strings[at:at + c]))
            at += c

    def _split(self, text: str) -> list[str]:
        """Chunks of a text; a special token is marked by a leading NUL, which no other chunk pairs with its string."""
        if self.special is None or not self.special.search(text):
            return _chunks(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += _chunks(text[at:m.start()])
            out.append("\x00" + m.group())
            at = m.end()
        return out + _chunks(text[at:])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """Ids of every text, and the texts that decoding gives back (UTF-8)."""
        if len(self.known) > MEMORY:
            self._forget()
        before = len(self.known)
        known = self.known
        rows = []
        for text in texts:
            rows.append([known.setdefault(c, len(known)) for c in self._split(text)])
        fresh = list(known)[before:] if before else list(known)
        self._learn(fresh) if fresh else None
        ids = [_gather(self.ids, self.starts, self.counts, np.array(r, dtype=np.int64)) for r in rows]
        shown = self.shown
        return ids, [b" ".join([shown[i] for i in r]) for r in rows]


def bpe_tokens(docs: DataFrame, path: str, text: str = "text", outputs: list[str] | None = None) -> DataFrame:
    """Input rows with the chosen outputs of `KINDS`: ids, their number and digest, the decoded text and its digest."""
    outputs = outputs or ["n_tokens", "ids", "decoded"]
    small_batches(docs.sparkSession)
    source, schema = appended(docs, ", ".join(f"{o} {KINDS[o]}" for o in outputs))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in sized_slices(batch, text):
                ids, decoded = encoder.encode([t or "" for t in part.column(text).to_pylist()])
                made = {"n_tokens": lambda: pa.array([len(i) for i in ids], pa.int64()),
                        "ids_sha256": lambda: pa.array([sha(i.astype("<u4").tobytes()) for i in ids], pa.string()),
                        "decoded_sha256": lambda: pa.array([sha(d) for d in decoded], pa.string()),
                        "ids": lambda: pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32),
                                                                pa.array(np.concatenate([np.empty(0, np.int32), *ids]))),
                        "decoded": lambda: pa.array([d.decode() for d in decoded], pa.string())}
                yield with_columns(part, {o: made[o]() for o in outputs}, schema)

    return source.mapInArrow(encoded, schema)


def bpe_text(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Input rows with `decoded`: the token strings of the ids, one space between them; null ids give the empty text."""
    source, schema = appended(tokens, "decoded string")
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def decoded(batches):
        names = shared.value.tokens
        for batch in batches:
            rows = batch.column(ids).to_pylist()
            yield with_columns(batch, {"decoded": pa.array([b" ".join([names[i] for i in r or []]).decode() for r in rows], pa.string())}, schema)

    return source.mapInArrow(decoded, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe_tokens(docs, default_path(), outputs=["n_tokens", "ids_sha256", "decoded_sha256"])
    return tokens.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
