"""Places where an operator did less than the whole job: each test failed before."""

import random

import pytest

from vistagrid.llm import quality

CYRILLIC = "дорога ведёт через лес вдоль реки мимо старой мельницы дальше начинается подъём хорошо видно долину деревню мост церковь поля утром туман".split()


def sentence(seed: int, pool, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(pool) for _ in range(n))


def shuffled(text: str, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.sample(w, len(w))) for w in text.split(" "))


def test_quality_tells_letters_apart_in_every_script(spark):
    rows = [(k, sentence(k, CYRILLIC, 120), "ru") for k in range(60)] + [(99, shuffled(sentence(99, CYRILLIC, 120), 1), "ru")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[99].kept and got[99].bits_per_char > got[99].band_high and all(got[k].kept for k in range(60))


def test_quality_grams_are_whole_code_points():
    texts = ["a" * 9, "", "día 数据\U0001F600", "数"] + ["".join(chr(0x4E00 + (3000 * k + 7 * j) % 9000) for j in range(3000)) for k in range(8)]
    for part in (texts[:4], texts):
        grams = quality.Grams([t.encode() for t in part])
        keys, n, hi, lo = grams.distinct()
        want = {}
        for t in part:
            codes = [1] * 4 + [ord(c) + 2 for c in t]
            for k in range(len(t)):
                want[tuple(codes[k:k + 5])] = want.get(tuple(codes[k:k + 5]), 0) + 1
        mask = quality.POINT
        got = {(int(h) >> 21, int(h) & mask, int(x) >> 42, (int(x) >> 21) & mask, int(x) & mask): int(c) for h, x, c in zip(hi, lo, n)}
        assert got == want
    assert not grams.direct


def test_quality_model_sums_to_at_most_one(spark):
    texts = [sentence(k, CYRILLIC, 60).encode() for k in range(4)]
    _, n, hi, lo = quality.Grams(texts).distinct()
    rows = [("ru", int(a), int(b), int(c)) for a, b, c in zip(hi, lo, n)]
    model = quality.kneser_ney(spark.createDataFrame(rows, "lang string, hi bigint, lo bigint, n bigint")).collect()
    assert len(model) == len(rows)
    total = {}
    for r in model:
        assert 0 < r.p <= 1
        total[r.hi, r.lo >> 21] = total.get((r.hi, r.lo >> 21), 0) + r.p
    # What is left to a context's unseen symbols is less than its discounted mass.
    assert all(0.02 < t <= 1 + 1e-9 for t in total.values()) and max(total.values()) == pytest.approx(1, abs=0.2)


def test_quality_languages_do_not_share_a_band(spark):
    # The former slots put these two together; the few texts of one were judged by the quartiles of the other.
    mono = "ab abba baab bab aab".split()
    rows = [(k, sentence(k, CYRILLIC, 120), "pt") for k in range(60)] + [(100 + k, sentence(k, mono, 120), "hi") for k in range(6)] + [(200, sentence(1, CYRILLIC, 120), None)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    bands = {lang: {(r.band_low, r.band_high) for r in got if r.lang == lang} for lang in ("pt", "hi", None)}
    assert all(len(b) == 1 for b in bands.values()) and len(set.union(*bands.values())) == 3
    low, high = next(iter(bands["hi"]))
    assert all(low <= r.bits_per_char <= high for r in got if r.lang == "hi")
