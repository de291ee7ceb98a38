"""Quality classifier: boosted trees over statistics of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemere.llm.boosting import Forest, train
from tablemere.llm.common import SLICE_BYTES, bounded_sample, checkpoint, map_texts

#: Bound of the training sample: labelled rows; where ids repeat, so many times that of (label, text) rows are learned from.
TRAIN_ROWS, REPEATS = 8000, 4

_LETTER, _UPPER, _DIGIT, _SPACE, _HIGH, _STOP, _BANG, _OTHER, _SYMBOL = range(9)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[128:] = _HIGH
    for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", _LETTER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b" \t\n\x0b\x0c\r", _SPACE), (b".,;:?", _STOP), (b"!", _BANG), (b"#*$%&|<>", _SYMBOL)):
        out[list(chars)] = kind
    return out


_CLASS = _classes()
#: Odd multiplier of the rolling word hash.
_MIX = np.uint64(0x9E3779B97F4A7C15)
FEATURES = (
    "log_bytes", "letters", "uppers", "digits", "spaces", "high", "stops", "bangs", "other", "symbols",
    "log_words", "word_bytes", "distinct_words", "same_as_last", "distinct_pairs", "distinct_fives",
    "symbol_words", "bare_words", "log_lines", "line_bytes", "distinct_lines",
)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _per(text: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(text, weights, n).astype(np.float64)


def _distinct(text: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each text."""
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    return _per(t[new], n)


def _hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes: sums of mixed powers that count from each stretch's own start."""
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(data), _MIX))))  # wraps modulo 2**64
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])))
    back = np.uint64(pow(int(_MIX), -len(data), 1 << 64))  # with the next power: that of minus the start
    return (sums[stop] - sums[start]) * power[len(data) - start] * back


def _grams(key: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` word hashes."""
    m = max(0, len(key) - width + 1)
    mixed = np.zeros(m, np.uint64)
    for k in range(width):
        mixed = (mixed ^ key[k : k + m]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """FEATURES of each whole text, as rows; an empty text has zeros."""
    if len(offs) == 2 and len(data) > 2 * SLICE_BYTES:
        return _long_statistics(data)[None]
    n, size = len(offs) - 1, np.diff(offs).astype(np.float64)
    text = np.repeat(np.arange(n), np.diff(offs))
    kind = _CLASS[data]
    shares = np.bincount(text * 9 + kind, minlength=9 * n).reshape(n, 9) if len(data) else np.zeros((n, 9))
    space = kind == _SPACE
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True  # a text's border parts words and lines too
    inside = ~space
    begins = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], space[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((space[1:], [True])))) + 1
    owner = text[begins]
    words = _per(owner, n)
    key = _hashed(data, begins, ends)
    follows = np.zeros(len(key), bool)
    follows[1:] = owner[1:] == owner[:-1]
    same = np.zeros(len(key), bool)
    same[1:] = follows[1:] & (key[1:] == key[:-1])
    grams = {}
    for width in (2, 5):
        mixed = _grams(key, width)
        m = len(mixed)
        whole = owner[:m] == owner[width - 1 :] if m else np.zeros(0, bool)
        grams[width] = _ratio(_distinct(owner[:m][whole], mixed[whole], n), np.maximum(words - width + 1, 1))
    symbols = np.concatenate(([0], np.cumsum((kind == _SYMBOL) | (kind == _BANG))))
    letters = np.concatenate(([0], np.cumsum((kind == _LETTER) | (kind == _UPPER) | (kind == _HIGH))))
    breaks = (data == 10) if len(data) else np.zeros(0, bool)
    stops = np.union1d(np.flatnonzero(breaks), offs[1:][size > 0] - 1)
    line_end = np.where(breaks[stops], stops, stops + 1) if len(stops) else stops
    line_start = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    full = line_end > line_start
    line_owner, line_key = text[line_start[full]], _hashed(data, line_start[full], line_end[full])
    lines = _per(line_owner, n)
    cols = [np.log1p(size), *[_ratio(shares[:, k], size) for k in (_LETTER, _UPPER, _DIGIT, _SPACE, _HIGH, _STOP, _BANG, _OTHER, _SYMBOL)]]
    cols += [np.log1p(words), _ratio(_per(owner, n, ends - begins), words), _ratio(_distinct(owner, key, n), words), _ratio(_per(owner, n, same), words), grams[2], grams[5]]
    cols += [_ratio(_per(owner, n, symbols[ends] > symbols[begins]), words), _ratio(_per(owner, n, letters[ends] == letters[begins]), words)]
    cols += [np.log1p(lines), _ratio(_per(line_owner, n, (line_end - line_start)[full]), lines), _ratio(_distinct(line_owner, line_key, n), lines)]
    return np.stack(cols, axis=1)


class _Distinct:
    """Counts different hashes that come in parts."""

    def __init__(self) -> None:
        self._known, self._new, self._rows = np.zeros(0, np.uint64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self._new.append(np.unique(keys))
        self._rows += len(self._new[-1])
        if self._rows > max(1 << 18, len(self._known) // 2):
            self._merge()

    def _merge(self) -> None:
        both = np.concatenate((self._known, *self._new))
        self._new, self._rows, self._known = [], 0, np.zeros(0, np.uint64)
        both.sort()
        self._known = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both

    def count(self) -> int:
        self._merge()
        return len(self._known)


def _parts(data: np.ndarray, size: int):
    """A text in parts of about ``size`` bytes, each with its last space; a longer word is in one part."""
    at = 0
    while at < len(data):
        to = min(len(data), at + size)
        while to < len(data) and not (spaces := np.flatnonzero(_CLASS[data[at:to]] == _SPACE)).size:
            to = min(len(data), to + size)
        if to < len(data):
            to = at + int(spaces[-1]) + 1
        yield data[at:to]
        at = to


def _long_statistics(data: np.ndarray, size: int = SLICE_BYTES) -> np.ndarray:
    """FEATURES of one text, with memory for one part of it and for its different hashes."""
    shares, words, word_bytes, same, symbol_words, bare_words, lines, line_bytes = np.zeros(9), 0, 0, 0, 0, 0, 0, 0
    distinct = {k: _Distinct() for k in ("words", "pairs", "fives", "lines")}
    last = np.zeros(0, np.uint64)  # hashes of the last four words
    open_hash, open_bytes, mask = 0, 0, (1 << 64) - 1  # of the line that goes on

    for part in _parts(data, size):
        kind = _CLASS[part]
        shares += np.bincount(kind, minlength=9)
        space = kind == _SPACE
        begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
        key = _hashed(part, begins, ends)
        words, word_bytes = words + len(key), word_bytes + int((ends - begins).sum())
        joined = np.concatenate((last, key))
        distinct["words"].add(key)
        distinct["pairs"].add(_grams(joined[max(0, len(last) - 1) :], 2))
        distinct["fives"].add(_grams(joined, 5))
        step = joined[max(0, len(last) - 1) :]
        same += int((step[1:] == step[:-1]).sum())
        last = joined[-4:]
        symbols = np.concatenate(([0], np.cumsum((kind == _SYMBOL) | (kind == _BANG), dtype=np.int32)))
        symbol_words += int((symbols[ends] > symbols[begins]).sum())
        letters = np.concatenate(([0], np.cumsum((kind == _LETTER) | (kind == _UPPER) | (kind == _HIGH), dtype=np.int32)))
        bare_words += int((letters[ends] == letters[begins]).sum())
        stops = np.flatnonzero(part == 10)
        starts, stops = np.concatenate(([0], stops + 1)), np.append(stops, len(part))
        made = _hashed(part, starts, stops)
        made[0] = (open_hash + pow(int(_MIX), open_bytes, 1 << 64) * int(made[0])) & mask
        sizes = stops - starts
        sizes[0] += open_bytes
        open_hash, open_bytes = int(made[-1]), int(sizes[-1])
        full = sizes[:-1] > 0
        distinct["lines"].add(made[:-1][full])
        lines, line_bytes = lines + int(full.sum()), line_bytes + int(sizes[:-1].sum())
    if open_bytes:
        distinct["lines"].add(np.array([open_hash], np.uint64))
        lines, line_bytes = lines + 1, line_bytes + open_bytes
    n = max(1, len(data))
    of_words = [distinct["words"].count() / max(1, words), same / max(1, words), distinct["pairs"].count() / max(1, words - 1), distinct["fives"].count() / max(1, words - 4)]
    cols = [np.log1p(len(data)), *[shares[k] / n for k in (_LETTER, _UPPER, _DIGIT, _SPACE, _HIGH, _STOP, _BANG, _OTHER, _SYMBOL)]]
    cols += [np.log1p(words), word_bytes / max(1, words), *of_words, symbol_words / max(1, words), bare_words / max(1, words)]
    cols += [np.log1p(lines), line_bytes / max(1, lines), distinct["lines"].count() / max(1, lines)]
    return np.array(cols, np.float64)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS
) -> Forest:
    """Trees learned from at most ``rows`` labelled documents: those with the least hash of id.

    Rows without id or label don't count. Where an id has several labels, or
    several texts, each pair is a row; of more than REPEATS times ``rows`` such
    pairs those with the least hash of their statistics are learned from.
    """
    few = bounded_sample(labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(doc_id, label), doc_id, rows)
    few = checkpoint(few.withColumnRenamed(label, "_label"))  # bounded, and so fit to be broadcast
    sampled = docs.select(doc_id, text).join(F.broadcast(few), doc_id).select(F.col("_label").cast("int").alias("y"), text)

    def run(data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        return {"x": pa.array(list(statistics(data, offs)), pa.list_(pa.float64()))}

    found = map_texts(sampled, run, ["y"], text, "x array<double>").orderBy(F.xxhash64("x", "y"), "x", "y").limit(REPEATS * rows).collect()
    x = np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES))
    return train(x, np.array([r["y"] for r in found]))


def score(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text: the probability of label 1.

    Null texts count as empty; empty texts get the score of their zeros; a very
    long text is read in parts with running totals, and takes memory for one part
    and 8 bytes for each different word, pair, run of five and line; texts of
    equal statistics get equal scores; repeated rows give repeated rows; an empty
    table gives none. Other columns are not read.
    """

    def run(data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        return {"score": forest.probability(statistics(data, offs))}

    return map_texts(docs, run, [doc_id], text, "score double")
