"""Quality rules by line labels of a linear-chain conditional random field.

Each line of a text is content or boilerplate. Features of a line give scores for both labels, transitions
tie neighbours together, and Viterbi decoding finds the best labelling; the share of words that lie in
content lines decides whether a document stays. Weights are fitted to a bounded sample of labelled documents:
their lines first take the document's label; then lines that clearly read otherwise change theirs, as long as most
of the document keeps it, and the field is fitted again, so that it learns where content and boilerplate meet.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspan.llm.common import WordHashes, bound_batches, grams, only, sampled_labels

SYMBOL = re.compile(r"[#*$%&|<>]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[^\W\d_]")
#: Labelled documents in the sample, at most; rounds of fitting.
SAMPLE_DOCS, EPOCHS = 1500, 60
#: Rounds of relabelling lines, and the log-odds that change a label.
ROUNDS, MARGIN = 2, 1.0
#: Least share of words in content lines.
LEAST_CONTENT = 0.5

FEATURES = (
    "bias", "words<3", "words<8", "words>=20", "symbols>5%", "symbols>0", "pipes>=2", "bangs>=2", "upper>50%", "upper>20%",
    "digits>20%", "ends a sentence", "repeated line", "word length<3", "word length>7", "letters<60%", "starts upper", "repeats a word",
)


def line_features(line: str, seen: bool) -> list[int]:
    """Indices of FEATURES that hold for a line with words."""
    words = line.split()
    n, size = len(words), len(line)
    symbols, upper, digits = len(SYMBOL.findall(line)), len(UPPER.findall(line)), len(DIGIT.findall(line))
    letters = max(1, len(LETTER.findall(line)))
    mean = sum(map(len, words)) / n if n else 0
    tests = (
        True, n < 3, n < 8, n >= 20, symbols > 0.05 * size, symbols > 0, line.count("|") >= 2, line.count("!") >= 2, upper > 0.5 * letters,
        upper > 0.2 * letters, digits > 0.2 * size, line.rstrip().endswith((".", "!", "?", "…", "。")), seen, mean < 3, mean > 7,
        letters < 0.6 * size, line.lstrip()[:1].isupper(), n >= 6 and len(set(words)) < 0.5 * n,
    )
    return [i for i, x in enumerate(tests) if x]


@dataclass(frozen=True)
class ChainModel:
    """Scores: emit[feature, label], move[label, next label]; label 1 is content."""

    emit: np.ndarray
    move: np.ndarray

    @staticmethod
    def plain() -> ChainModel:
        """Where nothing is labelled: every line is content."""
        emit = np.zeros((len(FEATURES), 2))
        emit[0] = (-1, 1)
        return ChainModel(emit, np.zeros((2, 2)))

    def decode(self, lines: list[list[int]]) -> list[int]:
        """Best labelling by Viterbi."""
        if not lines:
            return []
        diff = (self.emit[:, 1] - self.emit[:, 0]).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        zero, one, back = 0.0, sum([diff[i] for i in lines[0]]), []
        for feats in lines[1:]:
            e = sum([diff[i] for i in feats])
            a, b, c, d = zero + m00, one + m10, zero + m01, one + m11
            back.append((b > a, d > c))
            zero, one = max(a, b), max(c, d) + e
        label = int(one >= zero)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def relabelled(model: ChainModel, lines: list[list[int]], label: int) -> list[int]:
    """The document's label for each line, but the other one for lines that clearly read so, if these are fewer than half."""
    score = np.array([sum(model.emit[i, 1] - model.emit[i, 0] for i in feats) for feats in lines])
    other = score < -MARGIN if label else score > MARGIN
    return np.where(other, 1 - label, label).tolist() if 2 * other.sum() < len(lines) else [label] * len(lines)


def fit_lines(documents: list[list[list[int]]], labels: list[int], rounds: int = ROUNDS) -> ChainModel:
    """Fit to documents whose lines' labels are latent: rounds of fitting and relabelling."""
    model = fit_chain(documents, labels)
    for _ in range(rounds if len({y for d, y in zip(documents, labels, strict=True) if d}) == 2 else 0):
        model = fit_chain(documents, labels, [relabelled(model, d, y) for d, y in zip(documents, labels, strict=True)])
    return model


def fit_chain(documents: list[list[list[int]]], labels: list[int], lines: list[list[int]] | None = None, epochs: int = EPOCHS, ridge: float = 1e-3) -> ChainModel:
    """Gradient ascent on the chain's conditional likelihood; all sequences advance together, line by line.

    lines holds the labels of each document's lines; without it, they take the document's label.
    """
    lines = lines or [[y] * len(d) for d, y in zip(documents, labels, strict=True)]
    ordered = sorted(((d, y, own) for d, y, own in zip(documents, labels, lines, strict=True) if d), key=lambda p: -len(p[0]))
    if len({y for _, y, _ in ordered}) < 2:
        return ChainModel.plain()
    kept = [(d, y) for d, y, _ in ordered]
    sizes = np.array([len(d) for d, _ in kept])
    y = np.array([v for _, v in kept])
    longest, k = sizes[0], len(FEATURES)
    active = [int((sizes > t).sum()) for t in range(longest)]
    x = []
    for t in range(longest):
        step = np.zeros((active[t], k))
        for row, (d, _) in zip(step, kept[: active[t]], strict=True):
            row[d[t]] = 1
        x.append(step)
    truth = [np.array([own[t] for _, _, own in ordered[: active[t]]]) for t in range(longest)]
    share = np.array([len(kept) / (2 * (y == v).sum()) for v in y]) / sizes  # both labels and all documents weigh alike
    emit, move = np.zeros((k, 2)), np.zeros((2, 2))
    speed = [np.zeros_like(emit), np.zeros_like(move)]
    for _ in range(epochs):
        scores = [s @ emit for s in x]
        ahead = [scores[0]]
        for t in range(1, longest):
            p = ahead[-1][: active[t], :, None] + move
            ahead.append(scores[t] + np.logaddexp(p[:, 0], p[:, 1]))
        behind = [np.zeros((active[t], 2)) for t in range(longest)]
        for t in range(longest - 2, -1, -1):
            n = active[t + 1]
            p = move + (scores[t + 1] + behind[t + 1])[:, None, :]
            behind[t][:n] = np.logaddexp(p[:, :, 0], p[:, :, 1])
        total = np.logaddexp(*(ahead[0] + behind[0]).T)
        g_emit, g_move = -ridge * emit * len(kept), -ridge * move * len(kept)
        for t in range(longest):
            n = active[t]
            near = np.exp(ahead[t] + behind[t] - total[:n, None])
            want = np.eye(2)[truth[t]]
            g_emit = g_emit + x[t].T @ ((want - near) * share[:n, None])
            if t:
                pair = np.exp(ahead[t - 1][:n, :, None] + move + (scores[t] + behind[t])[:, None, :] - total[:n, None, None])
                pair = np.eye(4)[2 * truth[t - 1][:n] + truth[t]].reshape(n, 2, 2) - pair
                g_move = g_move + (pair * share[:n, None, None]).sum(axis=0)
        for value, grad, v in ((emit, g_emit, speed[0]), (move, g_move, speed[1])):
            v *= 0.9
            v += grad / len(kept)
            value += 0.5 * v
    return ChainModel(emit, np.clip(move, -4, 4))


def _lines(text: str):
    """Features and number of words of each line with words, with whether an equal line came before."""
    seen, feats, sizes, repeats = set(), [], [], 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        feats.append(line_features(line, again))
        sizes.append(n)
    return feats, sizes, repeats


def _sampled(batches):
    for batch in batches:
        feats = [_lines(t)[0] if t else [] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(feats, pa.list_(pa.list_(pa.int32())))], names=["quality", "lines"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ChainModel:
    """Fit to sample_docs labelled documents at most, chosen by a hash of their ids; only these are gathered.

    Ids are chosen first, so texts of other documents are not moved. Null labels are left out, and ids with labels that
    differ; of an id that repeats in docs, the least text counts. Without both labels every line is content.
    """
    bound_batches(docs.sparkSession)
    chosen = sampled_labels(labels, "quality", sample_docs)
    texts = only(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = texts.select("quality", "text").mapInArrow(_sampled, "quality int, lines array<array<int>>").collect()
    rows.sort(key=lambda r: (r["quality"], r["lines"]))
    return fit_lines([r["lines"] for r in rows], [int(r["quality"] > 0) for r in rows])


def _judge(model: ChainModel, least: float):
    def run(batches):
        known = WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                words = text.encode("utf-8", "surrogatepass").split()
                n = len(words)
                chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
                g = grams(known.array(words), 3)
                repeated = 0
                if len(g):
                    _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
                    twice = np.zeros(n + 1, np.int64)
                    hit = np.flatnonzero(count[inverse] > 1)
                    twice[hit] += 1
                    twice[hit + 3] -= 1
                    repeated = int((np.cumsum(twice)[:n] > 0).sum())
                feats, sizes, dup = _lines(text)
                good = sum(s for s, label in zip(sizes, model.decode(feats), strict=True) if label)
                share = good / n if n else 0.0
                failed = n < 50 or 100 * repeated > 50 * n
                rows.append((n, chars, len(SYMBOL.findall(text)), dup, repeated, failed, not failed and share >= least, share))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[
                "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    return run


def judge_quality(docs: DataFrame, model: ChainModel, least_content: float = LEAST_CONTENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share for each row.

    Null and empty texts have no words and fail the base rules. Rows are judged one by one, in one pass without
    a shuffle; repeated rows give repeated results, other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    return only(docs, doc_id="long", text="string").mapInArrow(
        _judge(model, least_content),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")
