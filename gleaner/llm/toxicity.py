"""Toxicity by a bidirectional gated recurrent network with attention pooling.

The network reads words.  A word's input is its own vector, if training has met it, and the largest
values, dimension by dimension, of the vectors of its letter n-grams (three to six letters).  Two gated recurrent layers read a window of words forwards
and backwards, attention pools their states, and a logistic unit scores the window.  A text is
covered by overlapping windows, all are scored, and the highest score is the text's.

Training (numpy, on the driver) takes at most ``per_class`` labelled texts of each class, drawn by a
hash whatever their length; very long ones give pieces from their whole length.  The bounds are
parameters.  A toxic text only says that some window is toxic, so
the window with the highest score stands for it, at first by word odds, then by the network itself.
Scoring covers whole texts and runs in tasks, with the layers' input products kept per word.

Null texts and texts without words have no window content and get the score of an empty window.
Repeated rows are scored alike; equal draws are ordered by identifier.  Without labelled texts of
both classes every score is 0, and ``fit`` warns if there are labels.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bound_arrow_batches, claim, slices

WINDOW, STRIDE = 32, 8
TRAINING_STRIDE = 24
WORD_SIZE, CHAR_SIZE, STATE, ATTENTION = 12, 8, 12, 12
CHAR_BUCKETS = 1 << 15
GRAMS = (3, 4, 5, 6)
PER_CLASS = 2_000
TRAINING_CHARS = 12_000
COPY_SHARE = 0.5
PIECE_CHARS, PIECE_END = 600, "\x1d"
STEPS, ROUNDS, BATCH = 960, 8, 96
RATE = 0.001
ALARM_COST = 3
KEPT_WORDS = 60_000
SLICE_CHARS = 500_000
BLOCK = 768  # so many rows that a product of a step is too small for BLAS to start threads

words_of = re.compile(r"\w+").findall


def letter_grams(words: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n the hashed n-grams of all words in a row, and how many each word has.

    Words are marked at both ends and filled up, so that each has one n-gram at least.
    """
    marked = [f"<{word}>".ljust(max(GRAMS), ">") for word in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    found = []
    hashed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        reach = len(codes) - n + 1
        hashed[:reach] = (hashed[:reach] * np.uint64(1_000_003)) ^ codes[n - 1 :]
        if n in GRAMS:
            inside = np.arange(len(codes)) + n <= ends
            mixed = (hashed[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
            found.append((mixed.astype(np.int64), sizes - n + 1))
    return found


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def window_starts(words: int, stride: int = STRIDE) -> range:
    """Starts of overlapping windows that cover all words; one window at least."""
    return range(0, max(1, words - (WINDOW - stride)), stride)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    vocabulary: dict[str, int]  # from 1; 0 is no known word
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(
        cls, vocabulary: dict[str, int], odds: np.ndarray, gram_odds: np.ndarray, seed: int = 5
    ) -> Network:
        random = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        size = WORD_SIZE + CHAR_SIZE
        w = {
            "word": random.standard_normal((len(vocabulary) + 1, WORD_SIZE)).astype(np.float32) * 0.1,
            "char": random.standard_normal((CHAR_BUCKETS, CHAR_SIZE)).astype(np.float32) * 0.3,
            "attend": normal(2 * STATE, ATTENTION),
            "focus": normal(ATTENTION),
            "out": normal(2 * STATE),
            "bias": np.full(1, -2, np.float32),
        }
        w["char"][:, 0] = gram_odds
        w["word"][:, 0] = odds
        w["word"][0] = 0
        for way in ("f", "b"):
            w[way + "in"] = normal(size, 3 * STATE)
            w[way + "rec"] = normal(STATE, 3 * STATE)
            w[way + "bias"] = np.zeros(3 * STATE, np.float32)
        return cls(vocabulary, w)

    def inputs(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list]:
        """Input vector of each word, its number, and its letter n-grams."""
        numbers = np.array([self.vocabulary.get(x, 0) for x in words], np.int64)
        grams = letter_grams(words)
        table = self.weights["char"]
        chars = np.full((len(words), CHAR_SIZE), -np.inf, np.float32)
        for ids, counts in grams:
            np.maximum(chars, np.maximum.reduceat(table[ids], _starts(counts), axis=0), out=chars)
        return np.concatenate([self.weights["word"][numbers], chars], axis=1), numbers, grams

    def run(
        self, way: str, products: np.ndarray, mask: np.ndarray | None, keep: list | None = None
    ) -> np.ndarray:
        """States (step, row, unit) of one direction; ``products`` are inputs (step, row, 3 units)."""
        recurrent = self.weights[way + "rec"]
        steps, rows, _ = products.shape
        state = np.zeros((rows, STATE), np.float32)
        states = np.empty((steps, rows, STATE), np.float32)
        for t in range(steps) if way == "f" else reversed(range(steps)):
            inner = state @ recurrent
            gates = sigmoid(products[t, :, : 2 * STATE] + inner[:, : 2 * STATE])
            z, r = gates[:, :STATE], gates[:, STATE:]
            new = np.tanh(products[t, :, 2 * STATE :] + r * inner[:, 2 * STATE :])
            after = new + z * (state - new)
            if mask is not None:
                after = np.where(mask[t][:, None], after, state)
            if keep is not None:
                keep.append((t, state, inner, z, r, new))
            states[t] = state = after
        return states

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """Logit of each row, with what the gradient needs."""
        w = self.weights
        hidden = np.tanh(states @ w["attend"])
        energy = np.where(mask, np.einsum("tru,u->tr", hidden, w["focus"]), -1e9)
        share = np.exp(energy - energy.max(axis=0)) * mask
        share /= np.maximum(share.sum(axis=0), 1e-9)
        pooled = (share[:, :, None] * states).sum(axis=0)
        return np.einsum("ru,u->r", pooled, w["out"]) + w["bias"][0], hidden, share, pooled


def train_step(net: Network, windows: list[list[str]], labels: np.ndarray, random: np.random.Generator) -> dict:
    """Gradient of the mean logistic loss over the windows."""
    w = net.weights
    known = sorted({x for window in windows for x in window}) or [""]
    place = {x: i for i, x in enumerate(known)}
    vectors, numbers, grams = net.inputs(known)
    steps, rows = WINDOW, len(windows)
    at = np.zeros((steps, rows), np.int64)
    mask = np.zeros((steps, rows), bool)
    for j, window in enumerate(windows):
        at[: len(window), j] = [place[x] for x in window]
        mask[: len(window), j] = True
    x = vectors[at]
    seen = random.random((steps, rows)) > 0.2  # else the word's own vector is hidden
    x[..., :WORD_SIZE] *= seen[..., None]
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate(
        [net.run(d, x @ w[d + "in"] + w[d + "bias"], mask, kept[d]) for d in ("f", "b")], axis=2
    )
    logit, hidden, share, pooled = net.pool(states, mask)
    error = ((sigmoid(logit) - labels) / rows).astype(np.float32)
    grad = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
    d_pooled = error[:, None] * w["out"]
    d_share = (states * d_pooled).sum(axis=2)
    d_energy = share * (d_share - (share * d_share).sum(axis=0))
    d_hidden = d_energy[..., None] * w["focus"] * (1 - hidden**2)
    grad["focus"] = (d_energy[..., None] * hidden).sum(axis=(0, 1))
    grad["attend"] = np.tensordot(states, d_hidden, axes=([0, 1], [0, 1]))
    d_states = share[..., None] * d_pooled + d_hidden @ w["attend"].T
    d_x = np.zeros_like(x)
    for d, part in (("f", slice(0, STATE)), ("b", slice(STATE, 2 * STATE))):
        recurrent = w[d + "rec"]
        d_products = np.zeros((steps, rows, 3 * STATE), np.float32)
        d_recurrent = np.zeros_like(recurrent)
        carried = np.zeros((rows, STATE), np.float32)
        for t, before, inner, z, r, new in reversed(kept[d]):
            total = d_states[t, :, part] + carried
            live = total * mask[t][:, None]
            d_new = live * (1 - z) * (1 - new**2)
            d_z = live * (before - new) * z * (1 - z)
            d_r = d_new * inner[:, 2 * STATE :] * r * (1 - r)
            d_products[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_recurrent += before.T @ d_inner
            carried = total - live + live * z + d_inner @ recurrent.T
        grad[d + "rec"] = d_recurrent
        grad[d + "bias"] = d_products.sum(axis=(0, 1))
        grad[d + "in"] = np.tensordot(x, d_products, axes=([0, 1], [0, 1]))
        d_x += d_products @ w[d + "in"].T
    d_words = d_x[..., :WORD_SIZE] * seen[..., None]
    grad["word"] = np.zeros_like(w["word"])
    np.add.at(grad["word"], numbers[at], d_words * mask[..., None])
    grad["word"][0] = 0
    d_known = np.zeros((len(known), CHAR_SIZE), np.float32)
    np.add.at(d_known, at, d_x[..., WORD_SIZE:] * mask[..., None])
    grad["char"] = np.zeros_like(w["char"])
    for ids, counts in grams:
        owner = np.repeat(np.arange(len(known)), counts)
        largest = w["char"][ids] == vectors[owner, WORD_SIZE:]
        row, column = np.nonzero(largest)
        np.add.at(grad["char"], (ids[row], column), d_known[owner[row], column])
    return grad


class Scorer:
    """Scores texts with a trained network; keeps the input products of recent words."""

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        # Input products of both gates, halved, and of the new state, for each direction.
        self.products = {
            (way, part): np.zeros((0, size * STATE), np.float32)
            for way in ("f", "b")
            for part, size in (("gates", 2), ("new", 1))
        }
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        w = self.net.weights
        for low in range(0, len(words), 20_000):
            part = words[low : low + 20_000]
            inputs = self.net.inputs(part)[0]
            products = {way: small_products(inputs, w[way + "in"]) + w[way + "bias"] for way in ("f", "b")}
            for (way, kind), table in self.products.items():
                if self.used + len(part) > len(table):
                    grown = np.zeros((max(2 * len(table), self.used + len(part)), table.shape[1]), np.float32)
                    grown[: self.used] = table[: self.used]
                    self.products[way, kind] = table = grown
                table[self.used : self.used + len(part)] = halved(products[way], kind)
            for number, word in enumerate(part, self.used):
                self.place[word] = number
            self.used += len(part)

    def logits(self, texts: Sequence[str | None]) -> np.ndarray:
        """The highest logit among the windows of each text."""
        cut = [words_of((text or "").lower()) for text in texts]
        if self.used > KEPT_WORDS:
            self._reset()
        fresh = sorted({x for words in cut for x in words if x not in self.place})
        if fresh:
            self._learn(fresh)
        place = self.place
        numbers = np.fromiter((place[x] for words in cut for x in words), np.int32, sum(map(len, cut)))
        starts, sizes, owners = [], [], []
        begin = 0
        for owner, words in enumerate(cut):
            for start in window_starts(len(words)):
                starts.append(begin + start)
                sizes.append(min(WINDOW, len(words) - start))
                owners.append(owner)
            begin += len(words)
        first, size = np.array(starts, np.int64), np.array(sizes, np.int64)
        scores = np.empty(len(first), np.float32)
        by_size = np.argsort(size, kind="stable")
        for low in range(0, len(first), BLOCK):
            rows = by_size[low : low + BLOCK]
            scores[rows] = self._window_logits(numbers, first[rows], size[rows])
        best = np.full(len(cut), -np.inf, np.float32)
        np.maximum.at(best, np.array(owners, np.int64), scores)
        return best

    def _window_logits(self, numbers: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        steps = max(1, int(size.max()))
        step = np.arange(steps)[:, None]
        mask = step < size
        if not len(numbers):
            numbers = np.zeros(1, np.int32)
            if not self.used:
                self._learn([""])
        at = numbers[np.minimum(first + np.minimum(step, np.maximum(size - 1, 0)), len(numbers) - 1)]
        states = np.empty((steps, len(size), 2 * STATE), np.float32)
        self._run("f", at, mask, states[..., :STATE])
        self._run("b", at[::-1], mask[::-1], states[::-1, :, STATE:])
        return self.net.pool(states, mask)[0]

    def _run(self, way: str, at: np.ndarray, mask: np.ndarray, states: np.ndarray) -> None:
        """``Network.run`` in the order of ``at``, in place; 1/(1+exp(-x)) is (1 + tanh(x/2)) / 2."""
        rows = at.shape[1]
        recurrent = self.net.weights[way + "rec"]
        to_gates, to_new = halved(recurrent, "gates"), halved(recurrent, "new")
        of_gates, of_new = self.products[way, "gates"], self.products[way, "new"]
        state = np.zeros((rows, STATE), np.float32)
        gates, gates_inner = np.empty((2, rows, 2 * STATE), np.float32)
        new, new_inner = np.empty((2, rows, STATE), np.float32)
        for words, live, out in zip(at, mask, states, strict=True):
            np.take(of_gates, words, axis=0, out=gates, mode="clip")
            np.take(of_new, words, axis=0, out=new, mode="clip")
            gates += np.matmul(state, to_gates, out=gates_inner)
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            np.matmul(state, to_new, out=new_inner)
            new_inner *= gates[:, STATE:]
            new += new_inner
            np.tanh(new, out=new)
            change = state - new
            change *= gates[:, :STATE]
            change += new
            state = change if live.all() else np.where(live[:, None], change, state)
            out[:] = state


def small_products(rows: np.ndarray, matrix: np.ndarray, at_once: int = 256) -> np.ndarray:
    """``rows @ matrix`` in parts too small for BLAS to start threads: a task has one core."""
    return np.concatenate([rows[i : i + at_once] @ matrix for i in range(0, max(len(rows), 1), at_once)])


def halved(rows: np.ndarray, kind: str) -> np.ndarray:
    """The gates' columns, halved, or those of the new state, as an array of their own."""
    return rows[:, : 2 * STATE] / 2 if kind == "gates" else rows[:, 2 * STATE :].copy()


def cut_windows(text: str | None, known: dict[str, str], stride: int = STRIDE) -> list[list[str]]:
    """Windows of a training text; ``known`` keeps one object per word for all texts."""
    windows = []
    for piece in (text or "").lower().split(PIECE_END):
        words = [known.setdefault(word, word) for word in words_of(piece)]
        windows += [words[s : s + WINDOW] for s in window_starts(len(words), stride)]
    return windows


def train(texts: Sequence[str], labels: Sequence[int], steps: int = STEPS, seed: int = 11) -> Network | None:
    """A network from labelled texts, or None if a class is missing.

    The number of steps is fixed, so the time does not depend on the amount of data.  Every fifth
    text of a class is not learned from: on these the cut between the classes is set.
    """
    if len(set(labels)) < 2:
        return None
    random = np.random.default_rng(seed)
    distinct = distinct_texts(texts, labels)
    texts, labels = [texts[i] for i in distinct], [labels[i] for i in distinct]
    learned, checked = split(labels)
    known: dict[str, str] = {}
    check_windows, check_marks = [cut_windows(texts[i], known) for i in checked], np.array([labels[i] for i in checked])
    windows, labels = [cut_windows(texts[i], known, TRAINING_STRIDE) for i in learned], [labels[i] for i in learned]
    marks = np.array(labels)
    contents = [sorted({x for window in found for x in window}) for found in windows]
    met = Counter(x for words in contents for x in words)
    vocabulary = {x: i for i, x in enumerate(sorted(x for x, n in met.items() if n > 1), 1)}
    gram_table = grams_of(sorted(met))
    words_met = np.zeros((2, len(vocabulary) + 1))
    grams_met = np.zeros((2, CHAR_BUCKETS))
    for words, label in zip(contents, labels, strict=True):
        words_met[label, [vocabulary[x] for x in words if x in vocabulary]] += 1
        if words:
            grams_met[label, np.unique(np.concatenate([gram_table[x] for x in words]))] += 1
    share = (marks.sum() + 1) / (len(marks) - marks.sum() + 1)

    def odds(met: np.ndarray) -> np.ndarray:
        return np.log((met[1] + 0.3) / (met[0] + 0.3) / share) * (met.sum(axis=0) > 2)

    def evidence(window: list[str]) -> float:
        """The strongest word or n-gram of a window, by odds and by the number of toxic texts."""
        best = 0.0
        for x in window:
            best = max(best, word_weight[vocabulary.get(x, 0)], gram_weight[gram_table[x]].max())
        return best

    word_odds, gram_odds = odds(words_met), odds(grams_met)
    word_odds[0] = 0
    word_weight, gram_weight = word_odds * np.sqrt(words_met[1]), gram_odds * np.sqrt(grams_met[1])
    net = Network.fresh(vocabulary, np.clip(word_odds, -3, 3), np.clip(gram_odds, -3, 3))
    clean = [w for found, label in zip(windows, labels, strict=True) if not label for w in found]
    toxic = [found for found, label in zip(windows, labels, strict=True) if label]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step = 0
    for turn in range(ROUNDS):
        if turn == 0:
            picked, hard = [max(found, key=evidence) for found in toxic], clean
        else:
            score = scores_of(net, [w for found in toxic for w in found])
            picked, at = [], 0
            for found in toxic:
                picked.append(found[int(score[at : at + len(found)].argmax())])
                at += len(found)
            worst = np.argsort(-scores_of(net, clean), kind="stable")[: max(BATCH, len(clean) // 50)]
            hard = [clean[i] for i in worst]
        for _ in range(steps // ROUNDS):
            step += 1
            third = BATCH // 3
            batch = [picked[i] for i in random.integers(0, len(picked), third)]
            batch += [clean[i] for i in random.integers(0, len(clean), third)]
            batch += [hard[i] for i in random.integers(0, len(hard), third)]
            grad = train_step(net, batch, np.repeat([1, 0], [third, 2 * third]), random)
            for name, g in grad.items():
                mean, square = moments[name]
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                rate = RATE / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
                net.weights[name] -= (rate * mean / (np.sqrt(square) + 1e-7)).astype(np.float32)
    net.weights["bias"] -= np.float32(best_cut(scores_of_texts(net, check_windows), check_marks))
    return net


def distinct_texts(texts: Sequence[str], labels: Sequence[int], size: int = 5) -> list[int]:
    """Numbers of the texts that share less than ``COPY_SHARE`` of their word shingles with earlier ones of their class.

    Copies would make chance words look toxic, and would stand on both sides of the check.  A toxic
    copy of a clean text stays, for what was put into it; so does the first text of each class.
    """
    seen: dict[int, set[int]] = {label: set() for label in labels}
    kept = []
    for number, (text, label) in enumerate(zip(texts, labels, strict=True)):
        words = words_of(text.lower())
        own = {hash(tuple(words[i : i + size])) for i in range(max(1, len(words) - size + 1))}
        if len(own & seen[label]) < COPY_SHARE * len(own):
            kept.append(number)
        seen[label] |= own
    return kept


def split(labels: Sequence[int]) -> tuple[list[int], list[int]]:
    """Numbers of the texts to learn from, and of every fifth of each class to check with.

    A class too small for that is used for both.
    """
    learned, checked = [], []
    for c in (0, 1):
        own = [i for i, label in enumerate(labels) if label == c]
        checked += own[::5] if len(own) >= 5 else own
        learned += [i for j, i in enumerate(own) if j % 5] if len(own) >= 5 else own
    return sorted(learned), sorted(checked)


def best_cut(logits: np.ndarray, marks: np.ndarray) -> float:
    """The middle of the range of cuts with the least loss.

    A text's score is the highest of many windows, which training on single windows cannot know.
    A share of clean texts lost counts ``ALARM_COST`` times as much as one of toxic texts missed,
    because clean texts are many times as frequent.
    """
    order = np.argsort(logits, kind="stable")
    toxic = marks[order] == 1
    missed = np.concatenate([[0], np.cumsum(toxic)]) / toxic.sum()
    alarms = 1 - np.concatenate([[0], np.cumsum(~toxic)]) / (~toxic).sum()
    best = int((missed + ALARM_COST * alarms)[1:-1].argmin()) + 1 if len(order) > 2 else 1
    low, high = logits[order[best - 1]], logits[order[best]]
    return float(low + high) / 2


def scores_of_texts(net: Network, windows: list[list[list[str]]]) -> np.ndarray:
    scores = scores_of(net, [w for found in windows for w in found])
    starts = np.cumsum([0, *map(len, windows)])[:-1]
    return np.maximum.reduceat(scores, starts)


def grams_of(words: list[str]) -> dict[str, np.ndarray]:
    """The letter n-grams of each word."""
    parts = [np.split(ids, np.cumsum(counts)[:-1]) for ids, counts in letter_grams(words)]
    return {x: np.concatenate(found) for x, found in zip(words, zip(*parts, strict=True), strict=True)}


def scores_of(net: Network, windows: list[list[str]], at_once: int = 4_000) -> np.ndarray:
    scorer = Scorer(net)
    parts = [windows[low : low + at_once] for low in range(0, len(windows), at_once)]
    return np.concatenate([scorer.logits([" ".join(w) for w in part]) for part in parts])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    trainable: Column,
    per_class: int = PER_CLASS,
    most_chars: int = TRAINING_CHARS,
) -> Network | None:
    """Train on at most ``per_class`` texts per class, with ``most_chars`` characters each on average.

    ``trainable`` is a condition on ``doc_id``.  Identifiers are drawn by a hash, whatever the length
    of their texts; only the texts of those leave their place.  A text longer than its share of the
    room gives pieces from its whole length.
    """
    drawn = F.xxhash64("doc_id", F.lit("toxicity"))
    texts_of = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    marks = (
        labels.where(trainable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("draw", drawn)
    )
    texts: list[str] = []
    classes: list[int] = []
    for c in (0, 1):
        own = marks.where(F.col("toxic") == c).join(texts_of, "doc_id", "left_semi")
        ids = own.orderBy("draw", "doc_id").limit(per_class).collect()
        if not ids:
            continue
        wanted = docs.sparkSession.createDataFrame(ids, marks.schema)
        room = max(PIECE_CHARS, per_class * most_chars // len(ids))
        found = texts_of.join(F.broadcast(wanted), "doc_id")
        taken = found.select("draw", "doc_id", excerpt(F.col("text"), room).alias("text"))
        for r in taken.orderBy("draw", "doc_id", "text").limit(per_class).collect():
            texts.append(r["text"])
            classes.append(c)
    if len(set(classes)) < 2 and marks.limit(1).count():
        warnings.warn("labelled texts of one class or none: every score is 0", stacklevel=2)
    return train(texts, classes)


def excerpt(text: Column, room: int) -> Column:
    """The whole text if it fits, else pieces at even distances from its begin to its end.

    Words cut at the ends of a piece are left out.
    """
    pieces = max(2, room // PIECE_CHARS)
    step = (F.char_length(text) - PIECE_CHARS) / F.lit(pieces - 1)
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(pieces - 1)),
        lambda i: F.substr(text, F.floor(i * step).cast("int") + 1, F.lit(PIECE_CHARS)),
    )
    whole_words = F.transform(parts, lambda p: F.regexp_replace(p, r"^\S+\s|\s\S+$", " "))
    return F.when(F.char_length(text) <= room, text).otherwise(F.array_join(whole_words, PIECE_END))


def score(docs: DataFrame, net: Network | None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``, the highest of all windows' scores."""
    clash = {"score", "_text"} & set(keep)
    if clash:
        raise ValueError(f"columns to keep have names of new columns: {sorted(clash)}")
    spark = docs.sparkSession
    if net is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    bound_arrow_batches(spark)
    column = "text" if "text" in keep else "_text"
    rows = docs.select(*keep) if column in keep else docs.select(*keep, F.col("text").alias(column))
    sent = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        scorer = Scorer(sent.value)
        for batch in batches:
            for part, texts in slices(batch, column, SLICE_CHARS):
                scores = sigmoid(scorer.logits(texts).astype(np.float64))
                kept = {c: part.column(c) for c in keep}
                yield pa.RecordBatch.from_pydict(kept | {"score": pa.array(scores, pa.float64())})

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, kept + "score double")
