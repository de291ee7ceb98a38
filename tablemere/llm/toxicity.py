"""Toxicity: a subsequence-kernel support vector machine with Nystroem landmarks."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemere.llm.common import SLICE_BYTES, bounded_sample, checkpoint, map_texts, text_buffer

#: Bound of the training sample: labelled documents of either label, the longest that are taken, and, where ids repeat, so many times that of texts.
TRAIN_ROWS, TRAIN_CHARS, REPEATS = 2000, 20_000, 4
LANDMARKS, ROUNDS, NEGATIVES = 384, 3, 4000
#: A training text with more than this part of its runs of five words seen in others is a copy, and counts once.
COPY = 0.3
#: A word is toxic itself if there is at most this chance that any word is in toxic texts so often; copies with a letter put in, and their weight.
CHANCE, INSERTED, INSERTED_COST = 0.01, 4, 0.25
#: Gaps (a, b) between the three signs of a subsequence, and the decay of each sign of span beyond three.
GAPS = ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1))
DECAY = 0.6
#: Words of a text that its score looks at, and the least margin told apart.
TOP, FLOOR = 3, -3.0
_DROP = 255
_SIZE = 64**3


def _classes() -> np.ndarray:
    """Byte -> 0 for white space, 1-26 for A-Z in either case, 27-58 for the last bytes of other letters; else dropped."""
    out = np.full(256, _DROP, np.uint8)
    out[list(b" \t\n\x0b\x0c\r")] = 0
    for k in range(26):
        out[ord("a") + k] = out[ord("A") + k] = k + 1
    for b in range(0x80, 0xC0):
        out[b] = 27 + b % 32
    return out


_CLASS = _classes()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs, borders, owner): words as signs between single zeros at ``borders``, and each word's text.

    Signs that are no letters are dropped within words, so that marks put into
    a word don't matter; neighbouring words of one sign are one word, so that
    letters set apart by spaces don't either.
    """
    n = len(offs) - 1
    kind = _CLASS[data]
    keep = kind != _DROP
    kept = np.concatenate(([0], np.cumsum(keep)))[offs]
    signs = np.insert(kind[keep], kept[:-1], 0)
    owner = np.repeat(np.arange(n), np.diff(kept) + 1)
    signs, owner = np.append(signs, 0).astype(np.int32), np.append(owner, n)
    keep = signs != 0
    keep[:-1] |= signs[1:] != 0  # of a run of zeros the last stays
    keep[-1] = True
    signs, owner = signs[keep], owner[keep]
    borders = np.flatnonzero(signs == 0)
    one = np.diff(borders) == 2
    same = owner[borders[:-1] + 1] == owner[borders[:-1]] if len(borders) > 1 else np.zeros(0, bool)
    glue = np.flatnonzero(one[1:] & one[:-1] & same[1:] & (owner[borders[1:-1] - 1] == owner[borders[1:-1]])) + 1
    if len(glue):
        keep = np.ones(len(signs), bool)
        keep[borders[glue]] = False
        signs, owner = signs[keep], owner[keep]
        borders = np.flatnonzero(signs == 0)
    return signs, borders, owner[borders[:-1] + 1] if len(borders) > 1 else np.zeros(0, np.int64)


def _parts(data: np.ndarray, size: int):
    """A text in parts of about ``size`` bytes, parted at spaces between words of two signs or more, which nothing joins."""
    at = 0
    while at < len(data):
        to = min(len(data), at + size)
        while to < len(data):
            near = _CLASS[data[at : min(len(data), to + 2)]]
            letter = (near != 0) & (near != _DROP)
            cuts = np.flatnonzero((near[2:-2] == 0) & letter[:-4] & letter[1:-3] & letter[3:-1] & letter[4:]) + 2
            if len(cuts):
                to = at + int(cuts[-1])
                break
            to = min(len(data), to + size)
        yield data[at:to]
        at = to


def _spans(signs: np.ndarray, borders: np.ndarray):
    """(gap weight, first places, codes) of all subsequences of three that stay within one word and its borders."""
    ahead = np.repeat(borders[1:], np.diff(borders)) - np.arange(borders[0], borders[-1]) if len(borders) > 1 else np.zeros(0, np.int64)
    for a, b in GAPS:
        at = np.flatnonzero(ahead >= a + b)
        yield DECAY ** (a + b - 2), at, signs[at] << 12 | signs[at + a] << 6 | signs[at + a + b]


def sums(signs: np.ndarray, borders: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each word the weighted sum of its gapped subsequences, over its norm."""
    if len(borders) < 2:
        return np.zeros(0)
    total = np.zeros(borders[-1])
    for decay, at, code in _spans(signs, borders):
        total[at] += decay * weights[code]
    return np.add.reduceat(total, borders[:-1]) / _norms(np.diff(borders) - 1)


def _norms(lens: np.ndarray) -> np.ndarray:
    """Norm of a word of so many signs, were its subsequences all different."""
    total = np.zeros(len(lens))
    for a, b in GAPS:
        total += np.maximum(lens + 2 - a - b, 0) * DECAY ** (2 * (a + b - 2))
    return np.sqrt(np.maximum(total, 1))


def _features(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A word's normalised feature vector: the places that aren't zero, and their values."""
    spans = list(_spans(*_joined([word])))
    codes, back = np.unique(np.concatenate([c for _, _, c in spans]), return_inverse=True)
    values = np.bincount(back, np.repeat([d for d, _, _ in spans], [len(c) for _, _, c in spans]), len(codes))
    return codes, values / _norms(np.array([len(word)]))[0]


def _kernel(words_: list[bytes], landmarks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Normalised subsequence kernel of each word with each landmark."""
    stream, one, out = _joined(words_), np.zeros(_SIZE, np.float32), np.zeros((len(words_), len(landmarks)))
    for k, (codes, values) in enumerate(landmarks):
        one[codes] = values
        out[:, k] = sums(*stream, one)
        one[codes] = 0
    return out


def _inserted(words_: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """Each word with a letter, its own or any other, put in at a random place within."""
    out = []
    for w in words_:
        at = int(rng.integers(1, len(w))) if len(w) > 1 else 1
        new = w[at - 1 : at] if rng.random() < 0.5 else bytes([int(rng.integers(1, 27))])
        out.append(w[:at] + new + w[at:])
    return out


def _joined(words_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    signs = np.frombuffer(b"\0" + b"".join(w + b"\0" for w in words_), np.uint8).astype(np.int32)
    return signs, np.flatnonzero(signs == 0)


@dataclass(frozen=True)
class ToxicModel:
    """The machine folded into one weight per subsequence, with the logistic curve of a text's margins.

    The decision function is a sum over landmarks of kernel values, each a
    product of feature vectors: so it is a product with one vector of weights.
    A text's probability is the larger of two curves': one of its most toxic
    word's margin, and one of the margins of its TOP most toxic words. The first
    catches a single plain insult, the second several doubtful ones.
    """

    weights: np.ndarray
    bias: float
    slopes: np.ndarray  # (2, TOP)
    shifts: np.ndarray  # (2,)

    def margins(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Of each whole text the margins of its TOP most toxic words, FLOOR for those it lacks or that are below."""
        if len(offs) == 2 and len(data) > 2 * SLICE_BYTES:
            found = [self._margins(part, np.array([0, len(part)]))[0] for part in _parts(data, SLICE_BYTES)]
            return np.sort(np.concatenate(found))[None, : -TOP - 1 : -1]
        return self._margins(data, offs)

    def _margins(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        signs, borders, owner = words(data, offs)
        own = sums(signs, borders, self.weights) + self.bias
        out = np.full((len(offs) - 1, TOP), FLOOR)
        for k in range(TOP if len(own) else 0):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.maximum.reduceat(own, starts)
            out[owner[starts], k] = np.maximum(best, FLOOR)
            hits = np.flatnonzero(own == np.repeat(best, np.diff(np.append(starts, len(own)))))
            own[hits[np.concatenate(([True], owner[hits[1:]] != owner[hits[:-1]]))]] = -np.inf
        return out

    def probability(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        odds = (self.margins(data, offs) @ self.slopes.T + self.shifts).max(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last column of ``x`` is one, for the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        live = y * (x @ w) < 1
        a = x[live] * cost[live, None]
        new = np.linalg.solve(x[live].T @ a + ridge * np.eye(len(w)), a.T @ y[live])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(m: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    x, w = np.hstack((m, np.ones((len(m), 1)))), np.zeros(m.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (cost * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (cost * (p - y)) + 1e-2 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _significant(toxic: Counter, clean: Counter, share: float) -> set[bytes]:
    """Words held by more toxic texts than chance has it.

    By Chernoff's bound at most CHANCE of any word, were ``share`` of all words'
    texts toxic; words below three times that share don't count.
    """
    need, out = np.log(max(2, len(toxic)) / CHANCE), set()
    for w, n in toxic.items():
        total = n + clean[w]
        part = n / total
        if part >= min(3 * share, (1 + share) / 2):
            rest = (1 - part) * np.log((1 - part) / (1 - share)) if part < 1 else 0.0
            if total * (part * np.log(part / share) + rest) >= need:
                out.add(w)
    return out


def train(texts: list[str], labels: np.ndarray, share: float = 0.5, seed: int = 7) -> ToxicModel:
    """Learn from labelled texts; ``share`` is that of label 1 among all labelled documents.

    A toxic text says that some word of some sentence in it is toxic, not which.
    So the words that carry the label are those that far more toxic texts hold
    than others, and one more of each text that is found in rounds: at first by how much
    more often their subsequences occur in toxic texts, then by the machine
    learned from the last round's. Each also counts with a letter put in. Words of the other texts are not toxic, those
    that score highest are learned from first. A quarter of the texts is kept
    apart for the curve from margin to probability.
    """
    y = np.asarray(labels, np.int64)
    flat = ToxicModel(np.zeros(_SIZE, np.float32), 0.0, np.zeros((2, TOP)), np.full(2, np.log((share + 1e-6) / (1 - share + 1e-6))))
    if not len(y) or y.min() == y.max():
        return flat
    rng = np.random.default_rng(seed)
    own: list[list[bytes]] = []
    seen: set[int] = set()
    single = np.ones(len(y), bool)
    for t in texts:
        signs, borders, _ = words(*text_buffer(pa.array([t], pa.string())))
        raw = signs.astype(np.uint8).tobytes()
        run = [raw[i + 1 : j] for i, j in zip(borders[:-1], borders[1:], strict=True)]
        own.append(sorted({w for w in run if len(w) > 1}))
        grams = {hash(tuple(run[k : k + 5])) for k in range(max(1, len(run) - 4))}
        single[len(own) - 1] = len(grams & seen) <= COPY * len(grams)
        seen |= grams
    kept_apart = (rng.random(len(y)) < 0.25) & single
    bad = [d for d in range(len(y)) if y[d] == 1 and single[d] and not kept_apart[d] and own[d]]
    good = [d for d in range(len(y)) if y[d] == 0 and not kept_apart[d]]
    texts_with = [Counter(w for d in ds if single[d] for w in own[d]) for ds in (bad, good)]
    held = [sum(c.values()) for c in texts_with]
    often = _significant(*texts_with, held[0] / max(1, sum(held)) * 0.999)
    clean = sorted({w for d in good for w in own[d]} - often)
    if not bad or not clean:
        return flat
    clean_set, clean_stream = set(clean), _joined(clean)
    found = np.zeros((2, _SIZE))
    for d in [*bad, *good]:
        if own[d] and single[d]:
            found[y[d], np.unique(np.concatenate([c for _, _, c in _spans(*_joined(own[d]))]))] += 1
    odds = np.log((found[1] + 2) / (len(bad) + 4)) - np.log((found[0] + 2) / (single[good].sum() + 4))
    weights, bias = np.maximum(odds, -3).astype(np.float32), 0.0
    texts_with = Counter(w for d in bad for w in own[d])
    held = [sum(len(own[d]) for d in ds if single[d]) for ds in (bad, good)]
    least = np.log(CHANCE / len(texts_with)) / np.log(held[0] / max(1, sum(held)) * 0.999)
    often = [w for w, n in texts_with.items() if n >= least and w not in clean_set]
    streams = {d: _joined(own[d]) for d in bad}
    for _ in range(ROUNDS):
        witness = [own[d][int(sums(*streams[d], weights).argmax())] for d in bad]
        pos = sorted({*often, *(w for w in witness if w not in clean_set)} or {*witness})
        plain = len(pos)
        pos += [w for _ in range(INSERTED) for w in _inserted(pos[:plain], rng) if w not in clean_set]
        ranked = np.argsort(-sums(*clean_stream, weights))
        hard = [clean[k] for k in ranked[: NEGATIVES // 2]]
        neg = sorted({*hard, *(clean[k] for k in rng.choice(len(clean), min(len(clean), NEGATIVES // 2), replace=False))})
        marks = [pos[k] for k in rng.permutation(plain)[: LANDMARKS // 2]]
        marks += hard[: LANDMARKS // 4] + [neg[k] for k in rng.permutation(len(neg))[: LANDMARKS - len(marks) - LANDMARKS // 4]]
        landmark = [_features(w) for w in marks]
        values, axes = np.linalg.eigh(_kernel(marks, landmark))
        live = values > 1e-6 * values.max()
        root = axes[:, live] / np.sqrt(values[live])  # the Nystroem map is kernel values times this
        x = np.hstack((_kernel([*pos, *neg], landmark) @ root, np.ones((len(pos) + len(neg), 1))))
        side = np.repeat([1.0, -1.0], [len(pos), len(neg)])
        w = _machine(x, side, np.repeat([1.0, INSERTED_COST, 1.0], [plain, len(pos) - plain, len(neg)]))
        weights = np.zeros(_SIZE, np.float32)
        for beta, (codes, amounts) in zip(root @ w[:-1], landmark, strict=True):
            weights[codes] += beta * amounts
        bias = float(w[-1])
    model = ToxicModel(weights, bias, np.zeros((2, TOP)), np.zeros(2))
    apart = [d for d in range(len(y)) if kept_apart[d]] if 0 < y[kept_apart].sum() < kept_apart.sum() else list(range(len(y)))
    m = model.margins(*text_buffer(pa.array([texts[d] for d in apart], pa.string())))
    part = y[apart].mean()
    cost = np.where(y[apart] == 1, share / part, (1 - share) / (1 - part))
    (one, one_shift), (top, top_shift) = _logistic(m[:, :1], y[apart], cost), _logistic(m, y[apart], cost)
    slopes = np.stack((np.pad(one, (0, TOP - 1)), top))
    return ToxicModel(weights, bias, slopes, np.array([one_shift, top_shift]))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS
) -> ToxicModel:
    """Learn from at most ``rows`` documents of either label, those with the least hash of id.

    Only labelled documents of up to TRAIN_CHARS characters are learned from, and
    rows without id, label or text don't count. Where an id has several labels or
    texts, each pair is a row; of more than REPEATS times ``rows`` pairs those
    with the least hash are learned from.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(doc_id, F.col(label).cast("int").alias("_label"))
    share = known.agg(F.avg("_label")).first()[0]
    few = checkpoint(bounded_sample(known.where("_label = 0"), doc_id, rows).union(bounded_sample(known.where("_label = 1"), doc_id, rows)))
    found = (
        docs.where(F.length(text) <= TRAIN_CHARS).select(doc_id, text).join(F.broadcast(few), doc_id)
        .select("_label", F.col(text).alias("t")).orderBy(F.xxhash64("t", "_label"), "t", "_label").limit(REPEATS * rows).collect()
    )
    return train([r["t"] for r in found], np.array([r["_label"] for r in found], np.int64), share if share is not None else 0.5)


def score(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text: the probability that its most toxic words make it toxic.

    Null texts count as empty; texts without a word get the score of FLOOR; very
    long texts are read whole, some megabytes at a time; words that tie count
    each; repeated rows give repeated rows; an empty table gives none. Other
    columns are not read.
    """

    def run(data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        return {"score": model.probability(data, offs)}

    return map_texts(docs, run, [doc_id], text, "score double")
