"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. The lexicon turns each word into a class: insult, threat, target, negation, report, or other.
Four small transducers rewrite the classes of a clause and are composed into one machine:

    target:    insult and threat become directed where the clause also names a target, before or after;
    negation:  an event within three words after a negation becomes negated;
    report:    an event after a verb of speaking becomes reported;
    score:     every event gets the weight of its kind.

The best path of the composed machine gives the events of the clause; a clause weighs what its stem and its event weigh.
The score of a text is sigmoid(prior + log-sum of its clauses' weights), so words without a clause around them, and texts
without events, add nothing.

Learning uses a bounded sample: at most about `SAMPLE` labelled rows per class, chosen by the hash of their id, near
copies once. Candidate stems are word beginnings and whole words that stand in enough toxic sample texts, once or
at least twice in each; clean sample texts count against them; a greedy cover keeps the stems that explain toxic texts which no better stem explains, so
words that merely accompany an insult in copied texts drop out. Stem weights are log likelihood ratios; event weights come
from the purity of each kind of event, drawn towards hand-written priors. Everything else reads all rows: each text is
scored whole. Only the text is an input of a score.

Defined cases: null reads as empty; texts without events, empty ones included, get the score of texts without events;
a null id falls into the fold of the empty string; labels that are null, or of unknown documents, teach nothing; an id with
several labels counts as toxic if any says so; with no label at all every text scores 0.5 less a little; repeated rows are
scored alike; ties in the cover go to the longer stem, then to the alphabet. Further columns pass through, except those
written here.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistagrid.llm.common import appended, sized_slices, stored, table, text_bytes, with_columns
from vistagrid.llm.registry import query

SAMPLE = 1 << 14
# A stem needs this many toxic sample texts, and this share of them; a clean text counts `PENALTY` times its share against it.
# Its texts must be no chance finding: by the binomial bound, at `CHANCE` for all candidates together.
MIN_TEXTS, MIN_SHARE, PENALTY, CHANCE = 3, 0.001, 12.0, 0.01
STEM_LENGTHS = range(3, 13)
PRIOR_TEXTS = 4.0
WORD = re.compile(r"\w+")
CLAUSE = re.compile(r"[.!?;\n]+|(?<!\w)(?:but|aber|mais|pero)(?!\w)")
# Grammar words in English, German, French and Spanish.
TARGETS = "you your yours yourself u ya du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vos".split()
NEGATIONS = "not no never don't isn't aren't without hardly nicht nie kein keine niemals ohne ne pas jamais sans nunca jamás ni sin".split()
REPORTS = "said says say told called calls wrote writes claimed reported quoted sagte sagt schrieb nannte behauptete dit disait appelé écrit dijo dice llamó escribió".split()
THREATS = "kill murder hurt destroy strangle stab beat töten umbringen verprügeln tuer frapper détruire matar golpear destruir".split()
INSULTS = "idiot moron imbecile dumbass scumbag arschloch dummkopf vollidiot connard salope crétin gilipollas cabrón imbécil".split()
SEED_WEIGHT = 4.0
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "o", "i", "t", "y", "n", "r"
EVENTS = [a + b + c for a in "iItT" for b in ("", "-") for c in ("", '"')]
# Purity that each kind of event is drawn to: directed events most, negated and reported ones less.
PRIOR_PURITY = {e: (0.9 if e[0] in "IT" else 0.8) - 0.25 * ("-" in e) - 0.15 * ('"' in e) for e in EVENTS}


@dataclass
class Transducer:
    """Weighted transducer: arcs[state, input] = [(output, weight, next state)]; state 0 starts; `final` states end."""

    arcs: dict = field(default_factory=dict)
    final: set = field(default_factory=lambda: {0})

    def arc(self, state, symbol: str, output: str, target, weight: float = 0.0) -> None:
        self.arcs.setdefault((state, symbol), []).append((output, weight, target))

    def compose(self, other: Transducer) -> Transducer:
        """Machine that feeds the output of this one to `other`; states are pairs, numbered as they are reached."""
        number, todo, out = {(0, 0): 0}, [(0, 0)], Transducer(final=set())
        symbols = {s for _, s in self.arcs}
        while todo:
            pair = todo.pop()
            if pair[0] in self.final and pair[1] in other.final:
                out.final.add(number[pair])
            for s in sorted(symbols):
                for middle, w1, to1 in self.arcs.get((pair[0], s), []):
                    for output, w2, to2 in other.arcs.get((pair[1], middle), []):
                        if (to1, to2) not in number:
                            number[to1, to2] = len(number)
                            todo.append((to1, to2))
                        out.arc(number[pair], s, output, number[to1, to2], w1 + w2)
        return out

    def best(self, symbols: str) -> tuple[str, ...]:
        """Outputs along the heaviest accepted path."""
        front = {0: (0.0, ())}
        for s in symbols:
            ahead: dict = {}
            for state, (weight, path) in front.items():
                for output, w, to in self.arcs.get((state, s), []):
                    if to not in ahead or weight + w > ahead[to][0]:
                        ahead[to] = (weight + w, (*path, output))
            front = ahead
        ends = [front[s] for s in sorted(front) if s in self.final]
        return max(ends, key=lambda e: e[0])[1] if ends else tuple(symbols)


def target_transducer() -> Transducer:
    """States: 0 no target yet, 1 target seen, 2 a later target is promised (no end state)."""
    t = Transducer(final={0, 1})
    for s in (OTHER, NEGATION, REPORT):
        for state in (0, 1, 2):
            t.arc(state, s, s, state)
    for state in (0, 1, 2):
        t.arc(state, TARGET, TARGET, 1)
    for s in (INSULT, THREAT):
        t.arc(0, s, s, 0)
        t.arc(0, s, s.upper(), 2)
        t.arc(1, s, s.upper(), 1)
        t.arc(2, s, s.upper(), 2)
    return t


def negation_transducer(reach: int = 3) -> Transducer:
    """State k: a negation still reaches k words ahead."""
    t = Transducer(final=set(range(reach + 1)))
    for state in range(reach + 1):
        after = max(0, state - 1)
        for s in (OTHER, TARGET, REPORT):
            t.arc(state, s, s, after)
        t.arc(state, NEGATION, NEGATION, reach)
        for s in "iItT":
            t.arc(state, s, s + ("-" if state else ""), after)
    return t


def report_transducer() -> Transducer:
    t = Transducer(final={0, 1})
    for state in (0, 1):
        for s in (OTHER, TARGET, NEGATION):
            t.arc(state, s, s, state)
        t.arc(state, REPORT, REPORT, 1)
        for s in EVENTS:
            if '"' not in s:
                t.arc(state, s, s + ('"' if state else ""), state)
    return t


def score_transducer(weights: dict[str, float]) -> Transducer:
    t = Transducer()
    for s in (OTHER, TARGET, NEGATION, REPORT):
        t.arc(0, s, "", 0)
    for e in EVENTS:
        t.arc(0, e, e, 0, weights[e])
    return t


def grammar(weights: dict[str, float]) -> Transducer:
    return target_transducer().compose(negation_transducer()).compose(report_transducer()).compose(score_transducer(weights))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass
class Model:
    """Stems (a trailing `$` marks a whole word) with their weights where they stand once and where they stand twice or more
    in a text, event weights, and the logits of texts with and without events."""

    stems: dict[str, tuple[float, float]]
    events: dict[str, float]
    prior: float
    none: float

    def __post_init__(self):
        self.fixed = {w: (c, "") for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.fixed |= {w: (THREAT, "") for w in THREATS} | {w: (INSULT, "") for w in INSULTS}
        self.machine, self.known, self.paths = None, {}, {}

    def word(self, w: str) -> tuple[str, str]:
        """Class of a word and the heaviest stem it begins with, or its place in the grammar."""
        found = [p for p in (*(w[:k] for k in STEM_LENGTHS if k <= len(w)), w + "$") if p in self.stems]
        return (INSULT, max(found, key=lambda p: max(self.stems[p]))) if found else self.fixed.get(w, (OTHER, ""))

    def _path(self, symbols: str) -> tuple[str, ...]:
        if symbols not in self.paths:
            self.machine = self.machine or grammar(self.events)
            if len(self.paths) > 100_000:
                self.paths = {}
            self.paths[symbols] = self.machine.best(symbols)
        return self.paths[symbols]

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """(event, weight) of every event of the text."""
        text = text.lower()
        known = self.known
        if len(known) > 500_000:
            known.clear()
        eventful = False
        for w in set(WORD.findall(text)):
            if w not in known:
                known[w] = self.word(w)
            eventful |= known[w][0] in (INSULT, THREAT)
        if not eventful:
            return []
        met, times = [], Counter()
        for clause in CLAUSE.split(text):
            classes = [known.get(w) or self.word(w) for w in WORD.findall(clause)]
            if any(c in (INSULT, THREAT) for c, _ in classes):
                path = self._path("".join(c for c, _ in classes))
                met += [(e, stem) for e, (c, stem) in zip(path, classes) if c in (INSULT, THREAT)]
        times.update(stem for _, stem in met)
        weights = [self.stems[stem][times[stem] > 1] if stem else SEED_WEIGHT for _, stem in met]
        return [(e, w + self.events[e]) for (e, _), w in zip(met, weights) if w > 0]

    def score(self, found: list[tuple[str, float]]) -> float:
        if not found:
            return 1 / (1 + math.exp(-self.none))
        weights = [w for _, w in found]
        top = max(weights)
        logit = self.prior + top + math.log(sum(math.exp(w - top) for w in weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

    def __getstate__(self):
        return {**self.__dict__, "machine": None, "known": {}, "paths": {}}


def _stems_of(text: bytes) -> set[str]:
    """Word beginnings and whole words of a text; a star marks those that stand in it at least twice."""
    out: Counter = Counter()
    for w, n in Counter(WORD.findall(text.decode("utf-8", "replace").lower())).items():
        for k in STEM_LENGTHS:
            if k > len(w):
                break
            out[w[:k]] += n
        out[w + "$"] += n
    return {*out, *(s + "*" for s, n in out.items() if n > 1)}


def _counted(wanted) -> Callable:
    """(stem, texts) of a task's texts; only those of the broadcast set, where one is given. Flushed at a bounded size."""

    def run(batches):
        counts: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["stem", "n"])

        for batch in batches:
            for t in text_bytes(batch.column("t")):
                found = _stems_of(t)
                counts.update(found if wanted is None else found & wanted.value)
                if len(counts) > 2_000_000:
                    yield rows()
                    counts = Counter()
        yield rows()

    return run


def _held(wanted) -> Callable:
    """Numbers of the useful stems of each text."""

    def run(batches):
        for batch in batches:
            numbers = [sorted(wanted.value[s] for s in _stems_of(t) if s in wanted.value) for t in text_bytes(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.list_(pa.int32()))], names=["held"])

    return run


def surprising(hits: int, misses: int, rate: float, candidates: int) -> bool:
    """Whether so many hits among hits + misses are beyond chance at the given rate, for that many candidates."""
    n = hits + misses
    share = hits / n
    gap = share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if misses else 0.0)
    return share > rate and n * gap >= math.log(max(1, candidates) / CHANCE)


def cover(held: list[tuple[list[int], int]], cost: np.ndarray, order: list[int], least: float) -> list[int]:
    """Greedy cover: the stem with the most newly explained texts less its cost, while it explains `least` new ones."""
    owner = np.repeat(np.arange(len(held)), [len(h) for h, _ in held])
    stem = np.array([s for h, _ in held for s in h], dtype=np.int64)
    weight = np.array([n for _, n in held], dtype=np.float64)
    rank = np.empty(len(cost))
    rank[order] = np.arange(len(order))
    open_, chosen = np.ones(len(held), dtype=bool), []
    while len(stem):
        new = np.bincount(stem, weights=weight[owner] * open_[owner], minlength=len(cost))
        gain = np.where(new >= least, new - cost, -np.inf)
        best = gain.max()
        if best <= 0:
            break
        ties = np.flatnonzero(gain == best)
        pick = int(ties[np.argmin(rank[ties])])
        chosen.append(pick)
        open_[owner[stem == pick]] = False
    return chosen


def _least_shingle(seed: int) -> Callable:
    """Texts with the smallest hash of their five-word shingles: near copies mostly share it, other texts do not."""

    def run(batches):
        for batch in batches:
            least = []
            for t in text_bytes(batch.column("t")):
                words = t.lower().split()
                least.append(min((xxhash.xxh3_64_intdigest(b" ".join(p), seed) for p in zip(*(words[k:] for k in range(5)))), default=xxhash.xxh3_64_intdigest(t, seed)) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("y"), pa.array(least, pa.int64())], names=["t", "y", "shingle"])

    return run


def sampled(docs: DataFrame, labels: DataFrame, trains: Column, text: str) -> tuple[DataFrame, float, float]:
    """Distinct texts (t, y) of the bounded sample, and the numbers of toxic and clean training labels."""
    own = labels.where(trains & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    n = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    share = F.when(F.col("y") == 1, min(1.0, SAMPLE / max(1, toxic))).otherwise(min(1.0, SAMPLE / max(1, clean)))
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # About `SAMPLE` ids of each class at most: broadcast, so that only sampled texts move.
    met = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).join(F.broadcast(chosen), "doc_id")
    texts = met.groupBy("t").agg(F.avg("y").alias("y"))
    # Copies are no independent witnesses: two rounds keep one of each group of near copies, with the group's mean label.
    for seed in (1, 2):
        texts = texts.mapInArrow(_least_shingle(seed), "t string, y double, shingle bigint").groupBy("shingle").agg(F.min("t").alias("t"), F.avg("y").alias("y"))
    return stored(texts.select("t", (F.col("y") >= 0.5).cast("int").alias("y"))), float(toxic), float(clean)


def learn_stems(sample: DataFrame) -> dict[str, tuple[float, float]]:
    """Stems with their log likelihood ratios where they stand once, and at least twice; 0 where they prove nothing."""
    spark = sample.sparkSession
    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    least = max(MIN_TEXTS, MIN_SHARE * toxic)
    bad, good = sample.where("y = 1").select("t"), sample.where("y = 0").select("t")
    often = {r.stem: r.n for r in bad.mapInArrow(_counted(None), "stem string, n bigint").groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toLocalIterator()}
    shared = spark.sparkContext.broadcast(frozenset(often))
    against = {r.stem: r.n for r in good.mapInArrow(_counted(shared), "stem string, n bigint").groupBy("stem").agg(F.sum("n").alias("n")).toLocalIterator()}
    price = PENALTY * toxic / max(1, clean)
    rate = min(0.5, max(1, toxic) / max(2, toxic + clean))
    useful = sorted(s for s, n in often.items() if n > price * against.get(s, 0) and surprising(n, against.get(s, 0), rate, len(often)))
    numbers = spark.sparkContext.broadcast({s: k for k, s in enumerate(useful)})
    held = [(r.held, r.n) for r in bad.mapInArrow(_held(numbers), "held array<int>").where(F.size("held") > 0).groupBy("held").agg(F.count("*").alias("n")).toLocalIterator()]
    cost = np.array([price * against.get(s, 0) for s in useful])
    order = sorted(range(len(useful)), key=lambda k: ("*" in useful[k], "$" in useful[k], -len(useful[k]), useful[k]))
    ratio = lambda s: math.log((often[s] + 0.5) / (toxic + 1)) - math.log((against.get(s, 0) + 0.5) / (clean + 1))
    found = {useful[k]: ratio(useful[k]) for k in cover(sorted(held), cost, order, 1)}
    return {s: (found.get(s, 0.0), max(found.get(s, 0.0), found.get(s + "*", 0.0))) for s in {k.rstrip("*") for k in found}}


def _strongest(shared) -> Callable:
    def run(batches):
        for batch in batches:
            found = [shared.value.clauses(t.decode("utf-8", "replace")) for t in text_bytes(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([max(f, key=lambda e: e[1])[0] if f else "" for f in found], pa.string())], names=["y", "event"])

    return run


def learn(docs: DataFrame, labels: DataFrame, trains: Column, text: str = "text") -> Model:
    """Model from the labelled rows that `trains`, a condition on `doc_id`, admits."""
    sample, toxic, clean = sampled(docs, labels, trains, text)
    prior = _logit((toxic + 0.5) / (toxic + clean + 1.5))
    flat = {e: _logit(p) - _logit(0.9) for e, p in PRIOR_PURITY.items()}
    model = Model(learn_stems(sample), flat, prior, prior)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = {(r.y, r.event): r.n for r in sample.mapInArrow(_strongest(shared), "y int, event string").groupBy("y", "event").agg(F.count("*").alias("n")).collect()}
    drawn = max(1, sum(n for (y, _), n in seen.items() if y == 0))
    odds = max(1, sum(n for (y, _), n in seen.items() if y == 1)) / drawn

    def purity(event: str) -> float:
        """Share of toxic texts where the event is the strongest one, as if both classes were equally common."""
        one, none = seen.get((1, event), 0), seen.get((0, event), 0) * odds
        return (one + PRIOR_TEXTS * PRIOR_PURITY[event]) / (one + none + PRIOR_TEXTS)

    model.events = {e: min(0.0, _logit(min(0.999, purity(e))) - _logit(0.9)) for e in EVENTS}
    one, none = seen.get((1, ""), 0), seen.get((0, ""), 0)
    share = clean / drawn
    model.none = _logit((one + 0.5) / (one + none * max(1.0, share) + 1.5))
    return Model(model.stems, model.events, prior, model.none)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Input rows with `score`, `predicted`, `n_events` and `event`, the kind of the strongest event."""
    source, schema = appended(docs, "score double, predicted int, n_events bigint, event string")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, text):
                found = [shared.value.clauses(t.decode("utf-8", "replace")) for t in text_bytes(part.column(text))]
                scores = [shared.value.score(f) for f in found]
                yield with_columns(part, {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                                          "n_events": pa.array([len(f) for f in found], pa.int64()),
                                          "event": pa.array([max(f, key=lambda e: e[1])[0] if f else None for f in found], pa.string())}, schema)

    return source.mapInArrow(run, schema)


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5))


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), fold() != 0)
    return scored(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted", "n_events", "event")
