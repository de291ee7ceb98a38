"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemere.llm.automaton import SuffixAutomaton
from tablemere.llm.common import SLICE_BYTES, checkpoint, map_texts

#: Bound of the training sample: documents per language, and characters of each.
TRAIN_DOCS, TRAIN_CHARS = 64, 4000
#: Bytes of training text per language, and of all languages together; most languages, those with most rows.
TRAIN_BYTES, TRAIN_ALL, LANGUAGES = 32 << 10, 1 << 20, 256
#: Of a language's training text one part in so many is held back to measure its rate; rates lean on the others' by so many signs.
HELD_BACK, LEAN = 5, 256
#: Coded bytes of a segment: a phrase ends with its segment at the latest.
SEGMENT = 1024
_LETTER = regex.compile(r"\p{L}")
_SHIFT = 6


def _classes() -> np.ndarray:
    """Byte -> one of 64 signs: 0 for all that is no letter, 1-26 for A-Z in either case, the rest for bytes above 127."""
    out = np.zeros(256, np.uint8)
    for k in range(26):
        out[ord("a") + k] = out[ord("A") + k] = k + 1
    for b in range(0x80, 0xC0):
        out[b] = 27 + b % 32  # the case of two-byte letters often is this bit
    for b in range(0xC0, 0x100):
        out[b] = 59 + b % 5
    return out


_CLASS = _classes()


def coded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of each text between single zeros, and their offsets: runs of zeros are one."""
    signs = _CLASS[data]
    keep = np.ones(len(signs), bool)
    keep[1:] = (signs[1:] != 0) | (signs[:-1] != 0)
    keep[offs[:-1][offs[:-1] < len(signs)]] = True
    sizes = [np.count_nonzero(keep[i:j]) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    return signs[keep], np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _has_letter(data: np.ndarray) -> bool:
    """Whether some UTF-8 bytes hold a letter, ``\\p{L}``; read in parts that end with a character."""
    at = 0
    while at < len(data):
        to = min(len(data), at + (1 << 16))
        while to < len(data) and 0x80 <= data[to] < 0xC0:
            to += 1
        part = data[at:to]
        if ((_CLASS[part] > 0) & (part < 0x80)).any() or (part > 0x7F).any() and _LETTER.search(part.tobytes().decode("utf-8", "replace")):
            return True
        at = to
    return False


@dataclass(frozen=True)
class LanguageModel:
    """Automata of several languages in one table.

    ``table[state << 6 | sign]`` holds the next state, pre-shifted, and in bit 0
    whether a phrase ended; states of language k start at ``roots[k]``.
    ``rates[k]`` is what text of language k itself needs: phrases a sign, on
    training text that its automaton has not seen.
    """

    languages: list[str]
    table: np.ndarray
    roots: np.ndarray
    rates: np.ndarray

    def phrases(self, signs: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language: (texts, languages).

        Greedy cross-parsing: the automaton accepts all substrings of its text,
        so walking from the root until there is no way on is the longest match.
        All segments of all texts walk side by side, so many at once that they
        are SLICE_BYTES long.
        """
        if len(signs) > 2 * SLICE_BYTES and len(offs) == 2:  # one very long text: whole segments of it are like texts
            cuts = [*range(0, len(signs), SLICE_BYTES // SEGMENT * SEGMENT), len(signs)]
            return sum(self.phrases(signs[i:j], np.array([0, j - i])) for i, j in zip(cuts[:-1], cuts[1:], strict=True))
        lens = np.diff(offs)
        parts = -(-lens // SEGMENT)
        of = np.repeat(np.arange(len(lens)), parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = offs[:-1][of] + nth * SEGMENT
        size = np.minimum(lens[of] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        start, size, of = start[order], size[order], of[order]
        live = np.searchsorted(-size, -np.arange(1, SEGMENT + 1), side="right")  # segments longer than t
        state = np.repeat(self.roots[:, None], len(size), axis=1).astype(np.int32)
        count = np.zeros(state.shape, np.int32)
        table, small = self.table, signs.astype(np.int32)
        for t in range(int(size[0]) if len(size) else 0):
            n = live[t]
            now = state[:, :n]
            now += small[start[:n] + t]
            step = table[now]
            count[:, :n] += step & 1
            np.bitwise_and(step, -2, out=now)
            now >>= 1
        out = np.zeros((len(lens), len(self.roots)), np.int64)
        for k in range(len(self.roots)):
            out[:, k] = np.bincount(of, weights=count[k] + 1, minlength=len(lens))
        return out

    def classify(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language with the fewest normalised phrases (of equal ones the first by name), and a score.

        A count is normalised by its language's rate, so that a language with
        little training text, whose phrases are short, is not at a loss.
        """
        signs, places = coded(data, offs)
        if not self.languages:
            return ["und"] * (len(offs) - 1), np.zeros(len(offs) - 1)
        needs = self.phrases(signs, places) / self.rates
        best = needs.argmin(axis=1)
        least = needs.min(axis=1)
        second = np.partition(needs, 1, axis=1)[:, 1] if needs.shape[1] > 1 else np.full(len(needs), np.inf)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, second / np.maximum(least + second, 1e-9))
        names = [self.languages[k] for k in best]
        for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            if not _has_letter(data[a:b]):
                names[i], score[i] = "und", 0.0
        return names, score


def _automaton(signs: np.ndarray) -> np.ndarray:
    """Next states of a text's automaton by (state, sign), pre-shifted, with the mark that a phrase ended."""
    sam = SuffixAutomaton([bytes(signs)])
    n = len(sam.length) + 1
    to = np.full((n, 1 << _SHIFT), -1, np.int64)  # the last state is that of a sign which the text lacks
    keys = np.fromiter(sam.next.keys(), np.int64, len(sam.next))
    to[keys >> 8, keys & 255] = np.fromiter(sam.next.values(), np.int64, len(sam.next))
    ends = to < 0
    ends[0] = False  # nothing is open at the root, where a segment begins
    fresh = np.where(to[0] < 0, n - 1, to[0])  # a new phrase begins with the sign that ended the last
    return (np.where(to < 0, fresh[None, :], to) << _SHIFT << 1 | ends).astype(np.int32)


def _walker(languages: list[str], texts: list[np.ndarray]) -> LanguageModel:
    """The automata of coded texts in one table, all rates one."""
    tables, roots, base = [], [], 0
    for signs in texts:
        table = _automaton(signs)
        tables.append((table + (base << _SHIFT << 1)).ravel())
        roots.append(base << _SHIFT)
        base += len(table)
    flat = np.concatenate(tables) if tables else np.zeros(0, np.int32)
    return LanguageModel(languages, flat, np.array(roots, np.int64), np.ones(len(languages)))


def build(texts: dict[str, list[str]], limit: int = TRAIN_BYTES) -> LanguageModel:
    """Model of labelled texts; each language uses up to ``limit`` bytes, shared evenly by its different texts.

    Rates are those of the last of HELD_BACK parts in an automaton of the others.
    """
    languages, own = sorted(texts), []
    limit = min(limit, TRAIN_ALL // max(1, len(languages)))
    for lang in languages:
        known = sorted(set(texts[lang]), key=lambda t: (len(t), t))
        share = max(1, limit // max(1, len(known)))
        raw = "\n".join(t.encode()[: 4 * share].decode("utf-8", "ignore") for t in known)
        data = np.frombuffer(raw.encode()[:limit], np.uint8)
        own.append(coded(data, np.array([0, len(data)]))[0])
    model = _walker(languages, own)
    if not languages:
        return model
    cuts = [len(s) - len(s) // HELD_BACK for s in own]
    held = [s[c:] for s, c in zip(own, cuts, strict=True)]
    places = np.concatenate(([0], np.cumsum([len(h) for h in held])))
    counts = np.diagonal(_walker(languages, [s[:c] for s, c in zip(own, cuts, strict=True)]).phrases(np.concatenate(held), places))
    sizes = np.diff(places)
    mean = (counts.sum() + 1) / (sizes.sum() + 1)
    return LanguageModel(languages, model.table, model.roots, (counts + LEAN * mean) / (sizes + LEAN))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from a bounded sample of the labelled rows of ``docs``.

    Each language's rows fall by a hash of id into TRAIN_DOCS bins, each bin
    gives the row with the least hash, shorter texts before those above
    TRAIN_CHARS: an unbiased sample by aggregation with map-side combine. Rows
    without language or letters do not count; of more than LANGUAGES languages
    those with most rows are learned.
    """
    place = F.xxhash64(F.lit(5), F.col(doc_id))
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), F.pmod(place, F.lit(TRAIN_DOCS)).alias("bin"), F.left(F.col(text), F.lit(TRAIN_CHARS)).alias("t"),
        F.struct((F.length(text) > TRAIN_CHARS).alias("long"), place.alias("place")).alias("rank"),
    )
    few = checkpoint(rows.groupBy("lang", "bin").agg(F.min_by("t", "rank").alias("t"), F.count(F.lit(1)).alias("n")))
    most = few.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    found: dict[str, list[str]] = {}
    for r in few.join(F.broadcast(most), "lang", "left_semi").orderBy("lang", "bin").collect():
        found.setdefault(r["lang"], []).append(r["t"])
    return build(found)


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text.

    The language whose automaton parses the text into the fewest phrases, each
    count normalised by its language's rate, wins; the score is the runner-up's
    as a part of both's (0.5 for a tie, which the first by name wins). Null texts
    and texts without a letter are ``und`` with score 0; very long texts are
    parsed whole, some megabytes at a time; repeated rows give repeated rows; an
    empty table gives none. Other columns are not read.
    """

    def run(data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        names, score = model.classify(data, offs)
        return {"lang_pred": pa.array(names, pa.string()), "score": score}

    return map_texts(docs, run, [doc_id], text, "lang_pred string, score double")
