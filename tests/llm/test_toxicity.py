"""Toxicity grammar: composition against its parts, learning, held-out labels, odd rows."""

import itertools
import random
import zlib

import pytest
from conftest_llm import prose

from vistagrid.llm.toxicity import EVENTS, Model, fold, grammar, learn, negation_transducer, op11_toxicity, report_transducer, scored, target_transducer


def plain_events(symbols):
    """Events of a clause by direct rules."""
    out, reach, reported = [], 0, False
    targets = [k for k, s in enumerate(symbols) if s == "y"]
    for s in symbols:
        event = ""
        if s in "it":
            event = (s.upper() if targets else s) + ("-" if reach else "") + ('"' if reported else "")
        reported |= s == "r"
        reach = 3 if s == "n" else max(0, reach - 1)
        out.append(event)
    return tuple(out)


def test_composed_machine_equals_the_rules():
    machine = grammar({e: 1.0 if e[0] in "IT" else 0.0 for e in EVENTS})
    for n in range(1, 6):
        for symbols in itertools.product("oitynr", repeat=n):
            assert machine.best("".join(symbols)) == plain_events(symbols)


def test_parts_run_alone():
    assert target_transducer().best("oiy") in (("o", "i", "y"), ("o", "I", "y"))
    assert negation_transducer().best("noioi") == ("n", "o", "i-", "o", "i")
    assert report_transducer().best("iri") == ("i", "r", 'i"')


@pytest.fixture(scope="module")
def taught(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(400):
        toxic = k % 8 == 0
        words = prose(500 + k, 60).split(" ")
        if toxic:
            words[rng.randrange(60)] = rng.choice(["grobian", "Grobiane", "flegel."])
        docs.append((k, " ".join(words)))
        labels.append((k, 0, int(toxic)))
    docs += [(1000 + k, docs[8][1]) for k in range(30)]
    labels += [(1000 + k, 0, 1) for k in range(30)] + [(3, 0, None), (None, 0, 1), (99999, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_the_stems_and_not_their_company(taught):
    model = learn(*taught, fold() != 0)
    assert any(s.startswith("gro") for s in model.stems) and any(s.startswith("fle") for s in model.stems)
    assert len(model.stems) <= 3


def test_held_out_rows_never_teach(spark, taught):
    docs, labels = taught
    turned = labels.withColumn("toxic", (1 - labels.toxic).cast("int")).where(fold() == 0).unionAll(labels.where(fold() != 0))
    assert learn(docs, turned, fold() != 0).stems == learn(docs, labels, fold() != 0).stems


def test_scores(spark, taught):
    model = learn(*taught, fold() != 0)
    texts = ["you grobian", "alpha beta", "", None, "he said the grobian is not here", "GROBIANE!", "x " * 200_000 + "grobian", "not a grobian"]
    given = spark.createDataFrame([(k, t, "own", 7) for k, t in enumerate(texts)], "doc_id long, text string, score string, other int")
    rows = {r.doc_id: r for r in scored(given, model).collect()}
    assert [rows[k].predicted for k in (0, 1, 2, 3, 5, 6)] == [1, 0, 0, 0, 1, 1]
    assert rows[1].score == rows[2].score == rows[3].score and rows[0].event == "I" and rows[4].event.startswith("i") and rows[7].event == "i-"
    assert all(0 <= r.score <= 1 and r.other == 7 for r in rows.values())


def test_no_labels_and_no_rows(spark, taught):
    docs, labels = taught
    model = learn(docs, labels.limit(0), fold() != 0)
    assert model.stems == {} and 0 < scored(docs.limit(1), model).first().score < 0.5
    assert scored(docs.limit(0), learn(docs.limit(0), labels, fold() != 0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op11_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    caught = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    # Some labels are wrong on purpose, so neither share reaches one.
    assert sum(r.predicted for r in caught) >= 0.8 * len(caught) and sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_model_survives_pickling():
    import pickle

    model = Model({"grob": (5.0, 5.0)}, dict.fromkeys(EVENTS, 0.0), -2.0, -4.0)
    model.clauses("you grob")
    assert pickle.loads(pickle.dumps(model)).clauses("you grob")[0][0] == "I"
