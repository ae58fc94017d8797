"""Cross-tokenizer alignment against a plain version with the two libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import DOCS
from tokenizers import Tokenizer

from vistagrid.llm.alignment import ByteTokenizer, aligned, aligned_texts, default_paths
from vistagrid.llm.bpe import byte_symbols

NAMES = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(libraries, texts):
    """Links and group text of each text, by walking both token lists."""
    first, second = libraries
    back = {s: b for b, s in enumerate(byte_symbols())}
    out = []
    for text in texts:
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a = [bytes(back[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append(None)
            continue
        ends = [[sum(map(len, t[:k + 1])) for k in range(len(t))] for t in (bytes_a, bytes_b)]
        links = [(x, y) for x, ex, lx in zip(a, ends[0], map(len, bytes_a)) for y, ey, ly in zip(b, ends[1], map(len, bytes_b)) if ex - lx < ey and ey - ly < ex]
        groups, low = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, own) if low < e <= cut) for ids, own in zip((a, b), ends)))
            low = cut
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def expected(libraries, texts):
    rows = brute(libraries, [t or "" for t in texts])
    counts = Counter(link for r in rows if r for link in r[3])
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[x] == highest[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in rows]


def test_measures_match_a_plain_walk(spark, docs, libraries):
    odd = ["<|endoftext|> </s> <s>", "a▁b", "  two  spaces ", "日本語 \u0000 ünï", "x" * 3000, " ", "\n\n\t", "don't 'll 1234567"]
    rows = [(r.doc_id, r.text) for r in docs.where("text IS NULL OR length(text) < 3000").collect()] + [(1000 + k, t) for k, t in enumerate(odd)] + [(1001, odd[1]), (1007, odd[7]), (1007, odd[7])]
    got = aligned(spark.createDataFrame(rows, "doc_id long, text string"), *default_paths()).collect()
    want = expected(libraries, [t for _, t in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, *(r[n] for n in NAMES)) for r in got), key=key) == sorted(((d, *w) for (d, _), w in zip(rows, want)), key=key)


def test_pairs_count_every_copy(spark, libraries):
    texts = ["the same text"] * 5 + ["another text"]
    done = aligned_texts(spark.createDataFrame([(t,) for t in texts], "text string"), *default_paths())
    want = Counter(link for r in brute(libraries, texts) for link in r[3])
    assert {(r.a_id, r.b_id): r["count"] for r in done.pairs.collect()} == dict(want)
    assert done.texts.count() == 2


def test_both_byte_libraries_agree(libraries):
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        own = ByteTokenizer(f.read())
    assert own.fast is not None
    texts = [" " + "".join(chr(c) for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x30000, 64)]
    assert [own.encode(t) for t in texts] == [own.plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_very_long_texts(spark, libraries):
    texts = ["ab cd " * 60_000, " " * 200_000 + "end", "q" * 200_000]
    rows = {r.doc_id: r for r in aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *default_paths()).collect()}
    for k, t in enumerate(texts):
        assert rows[k].n_a == len(libraries[0].encode(" " + t, add_special_tokens=False).ids)
        assert rows[k].n_b == len(libraries[1].encode(t))
        assert rows[k].n_links == rows[k].n_a + rows[k].n_b - rows[k].n_groups


def test_empty_table_and_clashing_columns(spark, no_docs):
    assert aligned(no_docs, *default_paths()).count() == 0
    given = spark.createDataFrame([(1, "some text", "mine", "own", 3)], "doc_id long, text string, n_a string, digest string, other int")
    row = aligned(given, *default_paths()).first()
    assert row.n_a > 0 and row.other == 3 and set(DOCS.names[:2]) <= set(row.asDict())
