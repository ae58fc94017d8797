"""Every document operator against a plain version, over rows with nulls, copies, ties, odd texts and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest_llm import DOCS, documents, lower, prose, words
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistagrid.llm import bpe, brown, decontaminate, jaccard, licenses, pii, quality, secrets, suffixes

ROWS = documents()


def by_text(rows, text="text"):
    return {(r["doc_id"], r[text]): r for r in rows}


def test_quality(docs, no_docs):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(ROWS) and "source" in got[0] and isinstance(got[0]["kept"], bool)
    for r in got:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        hit = {j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(k, k + 3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    kept = quality.quality_rules(docs, keep_only=True)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.quality_rules(no_docs).count() == 0


def plain_kneser_ney(texts: list[str]) -> list[float]:
    """Bits per character of each text under a modified Kneser-Ney model of order five over all texts, by dictionaries."""
    from collections import Counter, defaultdict

    level = Counter(tuple(("\0" * 4 + t)[i:i + 5]) for t in texts for i in range(len(t)))
    levels = {5: level}
    for order in range(4, 0, -1):
        level = Counter(g[1:] for g in levels[order + 1])
        levels[order] = level
    cuts, sums, free = {}, {}, {}
    for order, level in levels.items():
        c = [sum(n == k for n in level.values()) for k in (1, 2, 3, 4)]
        y = c[0] / max(c[0] + 2 * c[1], 1)
        raw = [1 - 2 * y * c[1] / max(c[0], 1), 2 - 3 * y * c[2] / max(c[1], 1), 3 - 4 * y * c[3] / max(c[2], 1)]
        cuts[order] = [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)] if all(c[:3]) else [0.5, 0.75, 0.9]
        sums[order], free[order] = defaultdict(float), defaultdict(float)
        for g, n in level.items():
            sums[order][g[:-1]] += n
            free[order][g[:-1]] += cuts[order][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / (1 << 21)
        order, n = len(g), levels[len(g)][g]
        return (n - cuts[order][min(n, 3) - 1]) / sums[order][g[:-1]] + free[order][g[:-1]] / sums[order][g[:-1]] * p(g[1:])

    return [-sum(np.log2(p(tuple(("\0" * 4 + t)[i:i + 5]))) for i in range(len(t))) / len(t) for t in texts]


def test_quality_bits_match_a_plain_model(spark):
    texts = [prose(k, 60) for k in range(8)] + ["日本語 のテキスト です " * 9, "aaaa", prose(3, 60), "".join(chr(0x4E00 + k % 5000) for k in range(5200))]
    rows = spark.createDataFrame([(k, t, "en" if k % 2 else None) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.bits_per_char for r in quality.quality_rules(rows.repartition(3)).collect()}
    for part in (0, 1):
        own = [k for k in range(len(texts)) if k % 2 == part]
        for k, want in zip(own, plain_kneser_ney([texts[k] for k in own])):
            assert abs(got[k] - want) < 1e-4


def test_quality_hashes_agree_with_spark(spark):
    rows = [(0, 0), (1, -1), (2**62, 77), (-(2**63), 2**63 - 1), (123456789, 987654321)]
    want = [r[0] for r in spark.createDataFrame(rows, "a long, b long").selectExpr("xxhash64(a, b)").collect()]
    assert quality.hash_longs(*(np.array(c) for c in zip(*rows))).tolist() == want


def test_quality_bands_reject_the_odd_text(spark):
    rows = [(k, prose(k, 120), "en") for k in range(60)] + [(99, " ".join("zqxj%dvkw" % k for k in range(120)), "en")]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[99] and all(got[k] for k in range(60))


def test_bpe(docs, no_docs):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(bpe.default_path())
    got = bpe.bpe_tokens(docs, bpe.default_path(), outputs=["n_tokens", "ids", "decoded", "ids_sha256"])
    for r in got.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == tok.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    again = bpe.bpe_text(got.withColumnRenamed("decoded", "first"), bpe.default_path())
    assert again.where("first <> decoded").count() == 0
    assert bpe.bpe_tokens(no_docs, bpe.default_path()).count() == 0


def test_bpe_special_and_odd_characters():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = ["a<|endoftext|>b <|startoftext|>", "Hello  World it's ΑΣ İ ½ \x85 x\x1cy", "aaaaaaaaaaaaa ababababa", "\x00<|endoftext|>", "don'T we'll 'tis", "日本語 テスト 한국어"]
    ids, shown = bpe.Encoder(bpe.Vocabulary.read(bpe.default_path())).encode(texts)
    for t, i, s in zip(texts, ids, shown):
        want = tok.encode(t, add_special_tokens=False).ids
        assert i.tolist() == want and s.decode() == tok.decode(want, skip_special_tokens=False)


def plain_hits(texts, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        yield len(w), hit, found - {None}


def test_decontamination(spark, docs, no_docs):
    passage = prose(2, 120).split(" ")
    items = [(1, " ".join(passage[10:30])), (2, "one"), (3, None), (4, ""), (None, " ".join(passage[60:75])), (1, "Two Words"), (7, "never seen words of an item that is long enough here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.benchmark_hits(docs, benchmark)
    rows = hits.collect()
    for r, (n, hit, found) in zip(rows, plain_hits([r["text"] for r in rows], items)):
        assert r["n_words"] == n and r["n_hit"] == len(hit) and set(r["items"]) == found
        assert {k for s in r["spans"] for k in range(s["start"], s["end"])} == hit
    cut = decontaminate.without_hits(hits).collect()
    for before, after in zip(rows, cut):
        gone = {k for s in before["spans"] for k in range(s["start"], s["end"])}
        assert words(after["text"]) == [w for k, w in enumerate(words(before["text"])) if k not in gone]
    assert decontaminate.benchmark_hits(no_docs, benchmark).count() == 0
    assert decontaminate.benchmark_hits(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = [(k, " ".join(prose(2, 120).split(" ")[k:k + 12])) for k in range(0, 60, 7)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = [tuple(r) for r in decontaminate.benchmark_hits(docs, benchmark).select("n_hit", "items").collect()]
    monkeypatch.setattr(decontaminate, "item_blocks", lambda items, i, t: [items.select(F.col(i).alias("item"), F.col(t).alias("t")).where(F.col(i) % 3 == k) for k in range(3)])
    assert [tuple(r) for r in decontaminate.benchmark_hits(docs, benchmark).select("n_hit", "items").collect()] == whole


def test_fm_index():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 600)
    index = decontaminate.FMIndex(text, 5)
    patterns = np.array([text[k:k + 4] for k in (0, 100, 596)] + [[4, 4, 4, 4]])
    low, high = index.search(patterns, np.full(4, 4))
    for p, a, b in zip(patterns, low, high):
        want = [k for k in range(597) if (text[k:k + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    return sorted(s + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32])


def test_secrets(docs, no_docs):
    rows = secrets.secret_spans(docs, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert [tuple(s) for s in r["spans"] if s["rank"] < 3] == base_spans(r["text"] or "")
    linked = next(r for r in rows if r["text"] and r["text"].startswith("client_id"))
    assert {s["kind"] for s in linked["spans"]} == {"identifier", "bare", "endpoint"}
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert not any(base_spans(r["text"] or "") for r in clean.collect())
    assert secrets.secret_spans(no_docs).count() == 0


def test_weak_parts_alone_are_not_reported(spark):
    rows = [(1, "client_id: svc-reader and nothing else"), (2, "see https://example.org/page"), (3, "client_id: svc-reader" + " word" * 200 + " Zk3aB9xaB9xaB9xaB9xaB9x1")]
    got = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(not r["spans"] for r in got)


def test_licenses(docs, no_docs):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    rows = licenses.license_scan(docs, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        w = words(r["text"])
        at = {label: [k for k in range(len(w)) if w[k:k + len(p)] == p] for label, p in phrases.items()}
        every = [k for ks in at.values() for k in ks]
        assert r["n_words"] == len(w) and r["n_base"] == len(every)
        assert (r["first_word"], r["last_word"]) == (min(every, default=None), max(every, default=None))
        assert r["base_labels"] == sorted(k for k, v in at.items() if v) and set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert licenses.license_scan(no_docs).count() == 0 and len(licenses.rules()) > 300


def test_license_containment(spark):
    row = licenses.license_scan(spark.createDataFrame([(1, "x Licensed under the Apache License, Version 2.0 y")], "doc_id long, text string")).first()
    assert [(d["start"], d["end"], d["label"], d["tier"]) for d in row["detections"]] == [(1, 9, "apache", 1)]


def shingles(t):
    w = words(t)
    n = min(5, len(w))
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if n else frozenset()


def test_jaccard(docs, no_docs):
    rows = jaccard.jaccard_classes(docs).collect()
    sets = [(r[0], hashlib.md5((r[1] or "").encode()).hexdigest(), shingles(r[1])) for r in ROWS]
    links = [{j for j, b in enumerate(sets) if i != j and a[2] and 10 * len(a[2] & b[2]) >= 8 * len(a[2] | b[2])} for i, a in enumerate(sets)]
    want = collections.Counter()
    for i, a in enumerate(sets):
        group, open_ = {i}, [i]
        while open_:
            for j in links[open_.pop()] - group:
                group.add(j)
                open_.append(j)
        ids = [sets[j][0] for j in group if sets[j][0] is not None]
        want[a[0], a[1], min(ids, default=None), len(links[i])] += 1
    assert collections.Counter((r["doc_id"], r["mark"], r["class_id"], r["n_links"]) for r in rows) == want
    kept = jaccard.one_of_each(docs)
    classes = {(r["class_id"], r["mark"] if r["class_id"] is None else "") for r in rows if r["n_shingles"]}
    wordless = {(r["doc_id"], r["mark"]) for r in rows if not r["n_shingles"]}
    assert kept.columns == docs.columns and kept.count() == len(classes) + len(wordless)
    assert jaccard.jaccard_classes(no_docs).count() == 0 and jaccard.one_of_each(no_docs).count() == 0


def test_large_near_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    base = prose(21, 150).split(" ")
    rows = [(k, " ".join([*base[:k], f"edit{k}", *base[k + 1:]])) for k in range(40)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [shingles(t) for _, t in rows]
    for r in got:
        a = sets[r["doc_id"]]
        assert r["n_links"] == sum(10 * len(a & b) >= 8 * len(a | b) for b in sets) - 1 and r["class_id"] == 0


def test_suffixes(docs, no_docs):
    texts = [(r[1] or "").encode() for r in ROWS]
    seen = collections.Counter(t[p:p + 400] for t in texts for p in range(len(t) - 399))
    want = collections.Counter()
    for (doc_id, *_), t in zip(ROWS, texts):
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - 399):
            if seen[t[p:p + 400]] > 1:
                gone[p:p + 400] = True
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want[doc_id, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    for hot in (suffixes.HOT, 1):
        suffixes.HOT, before = hot, suffixes.HOT
        got = suffixes.without_repeats(docs).collect()
        suffixes.HOT = before
        assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got) == want
    assert suffixes.without_repeats(no_docs).count() == 0


def test_loser_tree():
    import random

    rng = random.Random(5)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))).encode() for _ in range(300)]
    runs = [sorted(strings[k::7]) for k in range(7)]
    coded = [((s, n, None) for s, n in suffixes.front_decoded(*suffixes.front_coded(r))) for r in runs]
    out = list(suffixes.merged([iter(c) for c in coded]))
    assert [s for s, _, _ in out] == sorted(strings)
    for (a, _, _), (b, n, _) in zip(out, out[1:]):
        assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_class_lm(docs, no_docs):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    got = brown.class_lm_scores(docs, held).collect()
    fold = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in ROWS]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(r[1] or "")) + [None] for r in ROWS]
    counts = collections.Counter(w for t, h in zip(tokens, fold) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if r[0] is None else r[0], h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6))
                  for r, t, h in zip(ROWS, tokens, fold))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert brown.class_lm_scores(no_docs, held).count() == 0


def test_class_lm_beats_unigrams(spark):
    import random

    rng = random.Random(4)
    nouns, verbs = [f"n{k}" for k in range(30)], [f"v{k}" for k in range(30)]
    rows = [(k, " ".join(w for _ in range(40) for w in (rng.choice(nouns), rng.choice(verbs)))) for k in range(80)]
    got = brown.class_lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 0).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 10 * len(got)


def test_exchange_gain_is_the_likelihood_difference():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (brown.SIZE, brown.SIZE)).astype(float)
    classes = rng.integers(0, brown.CLASSES, brown.SIZE)
    between = brown.class_counts(counts, classes)
    for unit in (0, 17, 900):
        best, gain = brown.best_class(unit, counts[unit], counts[:, unit], counts[unit, unit], classes, between)
        moved = classes.copy()
        moved[unit] = best
        assert abs(brown.likelihood(brown.class_counts(counts, moved)) - brown.likelihood(between) - gain) < 1e-4


def test_surrogates(docs, no_docs):
    rows = by_text(pii.surrogates(docs.withColumn("before", F.col("text")), key="k").collect(), "before")
    for r in rows.values():
        assert (r["text"] == r["before"]) == (r["n_entities"] == 0)
    a, b = rows[18, ROWS[18][1]], rows[19, ROWS[19][1]]
    assert [e["kind"] for e in a["entities"]] == ["email", "phone", "card", "ip"]
    for e in a["entities"]:
        assert a["before"][e["start"]:e["end"]] not in a["text"] and e["new"] in a["text"]
    card = next(e["new"] for e in a["entities"] if e["kind"] == "card")
    assert re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", card)
    digits = [int(c) for c in card if c.isdigit()]
    assert sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", next(e["new"] for e in a["entities"] if e["kind"] == "phone"))
    assert a["entities"][0]["new"] == b["entities"][0]["new"]
    full, short = [e["new"] for e in b["entities"] if e["kind"] == "name"]
    assert full.startswith("Mrs. ") and short.startswith("Mr. ") and full.split()[-1] == short.split()[-1]
    assert pii.surrogates(no_docs, key="k").count() == 0


def test_surrogates_stay_distinct(spark, monkeypatch):
    # All first attempts collide, so every entity but one has to go on.
    real = pii.proposal
    monkeypatch.setattr(pii, "proposal", lambda key: F.when(F.col("attempt") < 2, F.lit("same")).otherwise(real(key)))
    rows = [("ssn", f"{k:09d}") for k in range(50)]
    got = pii.assigned(spark.createDataFrame(rows, "kind string, norm string"), "k").collect()
    assert len(got) == 50 and len({r["new"] for r in got}) == 50 and not {r["new"] for r in got} & {n for _, n in rows}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r[:5] for r in ROWS] + [(100 + k, prose(100 + k, 90), "en", "s", 1) for k in range(20)]
    spark.createDataFrame(rows, T.StructType(DOCS.fields[:5])).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(prose(103, 90).split(" ")[20:35]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        seen.append(spark.read.parquet(str(tmp_path / f"out{k}")))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == docs.columns
    assert seen[1].count() == quality.quality_rules(docs).where("kept").count()
    sets = [shingles(r["text"]) for r in seen[2].collect()]
    assert all(10 * len(a & b) < 8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert not any(hit for _, hit, _ in plain_hits([r["text"] for r in seen[3].collect()], [(1, " ".join(prose(103, 90).split(" ")[20:35]))]))
    assert not any(base_spans(r["text"]) for r in seen[4].collect())
    assert sorted(r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r["ids_sha256"] for r in seen[5].collect())


def test_pii_gate_lets_every_kind_pass(spark):
    texts = ["10.0.0.1", "at 8.8.8.8 now", "a@b.io", "+41 44 123", "GB29 NWBK ABCD EFGH", "DE89AAAABBBBCCCC", "(212) 555-0199", "123-45-6789", "Mrs. Anna", "4111 1111 1111 1111", "x@-a.com"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = rows.where(F.rlike("text", F.lit(pii.ALL)))
    assert found.count() >= len(texts) - 1 and found.where(~F.rlike("text", F.lit(pii.GATE))).count() == 0
    alone, beside = (pii.surrogates(spark.createDataFrame([(1, t)], "doc_id long, text string"), key="k").first() for t in ("10.0.0.1", "10.0.0.1 and a@b.io"))
    assert alone.entities[0]["new"] == beside.entities[0]["new"]


def test_pii_survives_endless_repeats(spark):
    n = 100_000
    texts = ["a@b" + ".cc" * n, "+1" + " 22" * n, "AB12" + " ABCD" * n, "1.2.3." * n, "1" + "-2" * n, "Mr. A" + "b" * n, "a." * n + "@b.io", "(" * n]
    rows = pii.surrogates(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), key="k").select("doc_id", "n_entities").collect()
    assert len(rows) == len(texts)
