"""Quality rules: a linear-chain conditional random field labels lines, their share decides.

Every line with a word gets a set of binary features (length, symbols, repetition, capitals,
place); the CRF scores label and transition, and Viterbi decoding marks each line as content or
boilerplate.  A document is kept if it does not fail the base rules and content lines hold at
least half of its words.

The CRF is fitted by gradient ascent on the conditional likelihood of a bounded sample: segments
of labelled documents, whose lines all take the document's quality label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, text_bytes

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8
CONTENT_SHARE = 0.5

FEATURES = (
    "always", "one_word", "few_words", "some_words", "many_words", "symbols_2", "symbols_10", "repeats_half", "repeats_most",
    "capitals", "digits", "copy_of_line", "covered_some", "covered_most", "sentence_end", "no_letters", "long_words", "first", "last",
)
NUMBER = {name: k for k, name in enumerate(FEATURES)}


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit."""

    documents: int = 6_000
    lines: int = 64
    segments: int = 12_000
    rounds: int = 200
    rate: float = 0.5
    penalty: float = 1e-3


@dataclass
class Model:
    """Weights of content (label 1) against boilerplate (0) per feature, and the transition scores."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, lines: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[line].sum() for line in lines])


def repeated_windows(words: list[bytes], width: int = WINDOW) -> np.ndarray:
    """Which words lie in a ``width``-word window that occurs twice or more in the list."""
    marks = np.zeros(len(words), dtype=bool)
    count = len(words) - width + 1
    if count < 2:
        return marks
    seen: dict[bytes, int] = {}
    first = np.fromiter((seen.setdefault(word, k) for k, word in enumerate(words)), dtype=np.int64, count=len(words))
    if len(seen) == len(words):
        return marks
    mixed = (first.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + count]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return marks
    # Equal hashes are compared word by word; windows of equal words are neighbours in this order.
    maybe = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    windows = np.lib.stride_tricks.sliding_window_view(first, width)[maybe]
    _, group, many = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = maybe[many[group.ravel()] > 1]
    edges[starts] += 1
    edges[starts + width] -= 1
    return np.cumsum(edges[:-1]) > 0


@dataclass
class Reading:
    """What one pass over a text finds: the base counts, and features and words of its lines."""

    base: tuple[int, int, int, int, int]
    lines: list[list[int]]
    sizes: list[int]


def _line_features(line: bytes, words: list[bytes], again: bool, covered: float) -> list[int]:
    size, n = len(line), len(words)
    out = [0, NUMBER["one_word"] if n == 1 else NUMBER["few_words"] if n < 5 else NUMBER["some_words"] if n < 15 else NUMBER["many_words"]]
    symbols = size - len(line.translate(None, SYMBOLS))
    if 50 * symbols > size:
        out.append(NUMBER["symbols_2"])
    if 10 * symbols > size:
        out.append(NUMBER["symbols_10"])
    if n >= 5:
        distinct = len(set(words))
        if 2 * distinct < n:
            out.append(NUMBER["repeats_half"])
        if 5 * distinct < n:
            out.append(NUMBER["repeats_most"])
    lowered = line.lower()
    if lowered != line and 2 * sum(map(int.__ne__, line, lowered)) > size - n:
        out.append(NUMBER["capitals"])
    if 5 * (size - len(line.translate(None, b"0123456789"))) > size:
        out.append(NUMBER["digits"])
    if again:
        out.append(NUMBER["copy_of_line"])
    if covered > 0.3:
        out.append(NUMBER["covered_some"])
    if covered > 0.7:
        out.append(NUMBER["covered_most"])
    if words[-1][-1:] in b".!?:":
        out.append(NUMBER["sentence_end"])
    if not any(byte >= 0x80 or 65 <= byte <= 90 or 97 <= byte <= 122 for byte in line):
        out.append(NUMBER["no_letters"])
    if size > 20 * n:
        out.append(NUMBER["long_words"])
    return out


def read_text(raw: bytes) -> Reading:
    words = raw.split()
    marks = repeated_windows(words)
    upto = np.concatenate([[0], np.cumsum(marks)])
    seen: set[bytes] = set()
    copies, at, lines, sizes = 0, 0, [], []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        again = line in seen
        seen.add(line)
        copies += again
        covered = (upto[at + len(own)] - upto[at]) / len(own)
        at += len(own)
        lines.append(_line_features(line, own, again, covered))
        sizes.append(len(own))
    if lines:
        lines[0].append(NUMBER["first"])
        lines[-1].append(NUMBER["last"])
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    letters = len(raw.translate(None, SPACE + CONTINUATION))
    return Reading((len(words), letters, symbols, copies, int(marks.sum())), lines, sizes)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best labels for content scores of lines: ``scores`` counts for label 1, 0 for label 0."""
    zero, one, back = 0.0, 0.0, []
    (stay0, to1), (to0, stay1) = moves.tolist()
    for k, score in enumerate(scores.tolist()):
        if k:
            from0, from1 = zero + to1 > one + stay1, zero + stay0 >= one + to0
            zero, one, step = (zero + stay0 if from1 else one + to0), (zero + to1 if from0 else one + stay1), (0 if from1 else 1, 0 if from0 else 1)
            back.append(step)
        one += score
    label = int(one > zero)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def base_failed(words: int, repeated: int) -> bool:
    return words < 20 or 100 * repeated > 30 * words


def _segments(batches, lines: int):
    import pandas as pd

    for batch in batches:
        out = []
        for raw, label in zip(batch["raw"], batch["quality"], strict=True):
            found = read_text(raw).lines
            out += [(int(label), [sum(1 << k for k in line) for line in found[at : at + lines]]) for at in range(0, len(found), lines)]
        yield pd.DataFrame(out, columns=["label", "lines"])


def training_segments(docs: DataFrame, labels: DataFrame, limits: Limits, doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, list[int]]]:
    """(label, line feature sets as bit masks) of a bounded sample of labelled documents, first by hash."""
    one = labels.filter(F.col("quality").isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
    picked = one.agg(F.min(F.col("quality").cast("int")).alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(limits.documents)
    sample = docs.select(F.col(doc_id).alias("_id"), text_bytes(text).alias("raw")).join(F.broadcast(picked), "_id").select("raw", "quality")
    found = sample.mapInPandas(lambda batches: _segments(batches, limits.lines), "label int, lines array<bigint>")
    rows = found.orderBy(F.xxhash64("lines", "label"), "label").limit(limits.segments).collect()
    return [(r["label"], list(r["lines"])) for r in rows]


def fit(segments: list[tuple[int, list[int]]], limits: Limits = Limits()) -> Model:
    """Maximum conditional likelihood, both labels weighing the same; forward-backward over all segments at once."""
    if not segments:
        return Model(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    segments = sorted(segments, key=lambda s: (-len(s[1]), s))
    sizes = np.array([len(lines) for _, lines in segments])
    label = np.array([kind for kind, _ in segments])
    x = np.zeros((len(segments), sizes[0], len(FEATURES)), dtype=np.float32)
    for row, (_, lines) in enumerate(segments):
        x[row, : len(lines)] = (np.array(lines)[:, None] >> np.arange(len(FEATURES))) & 1
    active = [int((sizes > t).sum()) for t in range(sizes[0])]
    share = [max(1, int((label == k).sum())) for k in (0, 1)]
    weight = np.where(label == 1, 0.5 / share[1], 0.5 / share[0])
    hot = np.eye(2)[label]
    model = Model(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    speed = [np.zeros(len(FEATURES)), np.zeros((2, 2))]
    for _ in range(limits.rounds):
        emit = np.zeros((len(segments), sizes[0], 2))
        emit[:, :, 1] = x @ model.weights.astype(np.float32)
        alpha = np.zeros_like(emit)
        beta = np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for t in range(1, sizes[0]):
            n = active[t]
            alpha[:n, t] = np.logaddexp.reduce(alpha[:n, t - 1, :, None] + model.moves, axis=1) + emit[:n, t]
        for t in range(sizes[0] - 2, -1, -1):
            n = active[t + 1]
            beta[:n, t] = np.logaddexp.reduce(model.moves + (emit[:n, t + 1] + beta[:n, t + 1])[:, None, :], axis=2)
        norm = np.logaddexp.reduce(alpha[:, 0] + beta[:, 0], axis=1)
        step, pairs = np.zeros(len(FEATURES)), np.zeros((2, 2))
        for t in range(sizes[0]):
            n = active[t]
            content = np.exp(alpha[:n, t, 1] + beta[:n, t, 1] - norm[:n])
            # A segment counts by its share of lines, so long ones do not rule.
            line_weight = weight[:n] / sizes[:n]
            step += ((hot[:n, 1] - content) * line_weight) @ x[:n, t]
            if t:
                joint = alpha[:n, t - 1, :, None] + model.moves + (emit[:n, t] + beta[:n, t])[:, None, :] - norm[:n, None, None]
                seen = hot[:n, :, None] * hot[:n, None, :]
                pairs += np.einsum("n,nij->ij", line_weight, seen - np.exp(joint))
        for k, (now, slope) in enumerate(((model.weights, step), (model.moves, pairs))):
            speed[k] = 0.9 * speed[k] + slope - limits.penalty * now
            now += limits.rate * speed[k]
    return model


def judged(model: Model, text: str = "text", share: float = CONTENT_SHARE) -> Column:
    """Struct of a text column: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, n_lines, labels, kept.

    ``labels`` has one letter per line with a word: c content, b boilerplate.  A null or empty text
    has no line, fails the base rules and is not kept.
    """
    schema = (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
        "content_words bigint, n_lines bigint, labels string, kept boolean"
    )

    def start():
        def judge(raw: bytes) -> tuple:
            found = read_text(raw)
            words, *_, repeated = found.base
            marks = viterbi(model.scores(found.lines), model.moves) if found.lines else []
            content = sum(size for size, mark in zip(found.sizes, marks, strict=True) if mark)
            failed = base_failed(words, repeated)
            letters = "".join("bc"[mark] for mark in marks)
            return (*found.base, failed, content, len(marks), letters, not failed and content >= share * words)

        return judge

    return per_text(start, schema)(text_bytes(text))
