"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insults (stems learned from labelled documents, with weights), threats, targets,
negations and reported speech, which are word lists. Small weighted transducers are composed over each clause: one rewrites
what stands under a negation, the next, reading that, what is reported, the last what is aimed at a target. Documents are judged
by their matched clauses, not by isolated words; the last step is a logistic model over clause scores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspan.llm.common import any_names, bound_batches, only, sampled_labels

#: Labelled documents in the sample, at most.
SAMPLE_DOCS = 4000
#: Stems learned: code points, documents that support one at least, and how many are kept.
SHORTEST, LONGEST, SUPPORT, STEMS = 4, 9, 4, 2000

WORD = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”«»]")
BREAKS = frozenset(".!?;:\n")
QUOTES = frozenset("\"“”«»")

# Word classes of the grammar in four languages.
THREATS = frozenset("kill murder hurt destroy shoot stab burn hang beat attack die töten umbringen schlagen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours yourself he she they them him her people du dich dir ihr euch tu toi vous ils elles usted ustedes ellos ellas".split())
NEGATIONS = frozenset("not no never nor without isn aren wasn weren don doesn didn won nicht kein keine nie pas jamais aucun nunca ningún sin".split())
REPORTS = frozenset("said says reported quoted according allegedly claimed wrote sagte schrieb laut selon déclaré écrit dijo según escribió".split())


#: What the grammar may leave of an insult or a threat.
MATCHED = frozenset("i i- i~ i! t! t~".split())


class Transducer:
    """A deterministic weighted transducer: (state, input) -> (state, output, factor). Unlisted input passes unchanged."""

    def __init__(self, moves: dict[tuple[int, str], tuple[int, str, float]], rest: dict[int, int] | None = None):
        self.moves, self.rest = moves, rest or {}

    def start(self) -> int:
        return 0

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        found = self.moves.get((state, symbol))
        return found if found is not None else (self.rest.get(state, state), symbol, 1.0)


class Composed(Transducer):
    """Two transducers in series: the first one's output is the second one's input; factors multiply."""

    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second, self.known = first, second, {}

    def start(self):
        return self.first.start(), self.second.start()

    def step(self, state, symbol):
        key = (state, symbol)
        if key not in self.known:
            a, middle, x = self.first.step(state[0], symbol)
            b, out, y = self.second.step(state[1], middle)
            self.known[key] = (a, b), out, x * y
        return self.known[key]


def negations() -> Transducer:
    """Within three words of a negation an insult or a threat is a denied one, and a verb of saying reports nothing ("never said ...")."""
    return Transducer(
        {(s, "n"): (3, "n", 1.0) for s in range(4)}
        | {(s, c): (s - 1, out, factor) for s in (1, 2, 3) for c, out, factor in (("i", "i-", 0.4), ("t", "t-", 0.4), ("r", "w", 1.0))},
        {3: 2, 2: 1, 1: 0})


def reports() -> Transducer:
    """After a verb of saying, up to the clause's end, and between quotation marks, an insult or a threat is a reported one; a denied threat is none there."""
    return Transducer(
        {(s, "r"): (1, "r", 1.0) for s in (0, 1)} | {(0, "q"): (2, "q", 1.0), (1, "q"): (2, "q", 1.0), (2, "q"): (0, "q", 1.0)}
        | {(s, c): (s, out, factor) for s in (1, 2) for c, out, factor in (("i", "i~", 0.6), ("t", "t~", 0.6), ("i-", "i-", 0.6), ("t-", "w", 0.0))})


def targets() -> Transducer:
    """An insult after its target is an aimed one and weighs more, but not a denied or reported one; a threat counts only after
    its target, and a denied one never."""
    return Transducer(
        {(s, "g"): (1, "g", 1.0) for s in (0, 1)} | {(1, "i"): (1, "i!", 1.25), (1, "t"): (1, "t!", 1.0)}
        | {(0, c): (0, "w", 0.0) for c in ("t", "t~", "t-")} | {(1, "t-"): (1, "w", 0.0)})


def grammar(*machines: Transducer) -> Transducer:
    """The machines in series; by default negations, reports and targets, each of which reads what the one before it wrote.

    Classes: i insult, t threat, g target, n negation, r report, q quotation mark, w any other word. The machines
    rewrite i and t: with - denied, with ~ reported, with ! aimed at a target; w is what counts no longer.
    """
    first, *others = machines or (negations(), reports(), targets())
    for other in others:
        first = Composed(first, other)
    return first


@dataclass
class ToxicityModel:
    """Stem weights and the logistic weights over document features."""

    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [-4.0, 0.0, 0.0, 0.0, 0.0])
    scale: list[float] = field(default_factory=lambda: [1.0] * 4)


class Scorer:
    LIMIT = 300_000

    def __init__(self, model: ToxicityModel):
        self.model, self.grammar, self.known = model, grammar(), {}

    def word(self, w: str) -> tuple[str, float]:
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            v = w.lower()
            weight = max([self.model.stems.get(v + "$", 0.0), *[self.model.stems.get(v[:n], 0.0) for n in range(SHORTEST, min(len(v), LONGEST) + 1)]])
            kind = ("q" if w in QUOTES else "b" if w in BREAKS else "i" if weight > 0 else "t" if v in THREATS else "g" if v in TARGETS
                    else "n" if v in NEGATIONS else "r" if v in REPORTS else "w")
            found = self.known[w] = (kind, weight if kind == "i" else 1.0)
        return found

    def clauses(self, text: str) -> tuple[list[float], int, int]:
        """Scores of the clauses that match, the number of different insults, and the number of words."""
        tokens = WORD.findall(text)
        word = self.word
        kinds = list(map(word, tokens))
        hits = [i for i, (k, _) in enumerate(kinds) if k in "it"]
        scores, done = [], -1
        for at in hits:
            if at < done:
                continue
            begin = at
            while begin and kinds[begin - 1][0] != "b":
                begin -= 1
            state, total, end = self.grammar.start(), 0.0, begin
            while end < len(kinds) and kinds[end][0] != "b":
                kind, weight = kinds[end]
                state, out, factor = self.grammar.step(state, kind)
                if out in MATCHED:
                    total += weight * factor
                end += 1
            done = end
            if total > 0:
                scores.append(total)
        return scores, len({tokens[i].lower() for i in hits if kinds[i][0] == "i"}), len(tokens)

    def features(self, text: str) -> list[float]:
        scores, different, n = self.clauses(text)
        return [math.log1p(sum(scores)), math.log1p(len(scores)), math.log1p(different), 100 * sum(scores) / (n + 20)]

    def score(self, text: str) -> float:
        z = self.model.weights[0] + sum(w * x / s for w, x, s in zip(self.model.weights[1:], self.features(text), self.model.scale, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def stems_of(text: str) -> set[str]:
    """Beginnings of the words of a text; a whole word ends in $."""
    out = set()
    for w in {x.lower() for x in WORD.findall(text)}:
        if len(w) >= SHORTEST - 1:
            out.add(w + "$")
            out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def learn_stems(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Stems whose documents are toxic far more often than others, weighted by a cautious log-odds."""
    hit, miss = Counter(), Counter()
    for text, y in zip(texts, labels, strict=True):
        (hit if y else miss).update(stems_of(text))
    yes, no = max(1, sum(labels)), max(1, len(labels) - sum(labels))
    found = {}
    for stem, n in hit.items():
        if n >= SUPPORT:
            m = miss[stem]
            odds = math.log((n + 0.5) / (yes + 1)) - math.log((m + 0.5) / (no + 1)) - 1.64 * math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
            if odds > 0.7:
                found[stem] = odds
    return dict(sorted(found.items(), key=lambda p: (-p[1], p[0]))[:STEMS])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) / 100 * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: list[int]) -> ToxicityModel:
    """Stems from all documents; the logistic weights from features of stems learned on the other half."""
    if len(set(labels)) < 2:
        return ToxicityModel()
    half = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 2 for t in texts]
    rows, ys = [], []
    for side in (0, 1):
        other = [(t, y) for t, y, h in zip(texts, labels, half, strict=True) if h != side]
        scorer = Scorer(ToxicityModel(learn_stems([t for t, _ in other], [y for _, y in other])))
        for t, y, h in zip(texts, labels, half, strict=True):
            if h == side:
                rows.append(scorer.features(t))
                ys.append(y)
    x, y = np.array(rows), np.array(ys, float)
    scale = np.maximum(x.std(axis=0), 1e-6)
    return ToxicityModel(learn_stems(texts, labels), _logistic(x / scale, y).tolist(), scale.tolist())


def held_out_id(column):
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(5)) == 0


def _packed(batches):
    for batch in batches:
        texts = [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 6) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(texts, pa.binary())], names=["doc_id", "toxic", "text"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Fit to at most sample_docs labelled documents whose crc32(doc_id) mod 5 is not 0, chosen by a hash of their ids.

    Only these texts are gathered, packed. Null ids and labels are left out, and
    ids with labels that differ; of an id that repeats in docs, the least text counts. Without both labels the model scores all alike.
    """
    bound_batches(docs.sparkSession)
    chosen = sampled_labels(labels, "toxic", sample_docs, held_out_id(F.col("doc_id")))
    texts = only(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    rows = texts.select("doc_id", "toxic", "text").mapInArrow(_packed, "doc_id long, toxic int, text binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["text"])))
    return fit([zlib.decompress(bytes(r["text"])).decode("utf-8", "surrogatepass") for r in rows], [int(r["toxic"] > 0) for r in rows])


def _run(model: ToxicityModel):
    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t or "") for t in batch.column("text").to_pylist()]
            cols = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64())], names=[*batch.schema.names, "_score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    A null text scores as an empty one; a null doc_id is not held out. Rows are judged one by one, without a
    shuffle; repeated rows give repeated results, other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    scored = only(docs, doc_id="long", text="string").mapInArrow(_run(model), "doc_id long, text string, _score double")
    return scored.select(
        "doc_id", F.coalesce(held_out_id(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def _harmless(model: ToxicityModel, threshold: float):
    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or "") < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


@any_names
def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns, whatever their names. Null texts score as empty ones."""
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(_harmless(model, threshold), docs.schema)
