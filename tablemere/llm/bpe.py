"""Byte-level BPE by per-prefix dynamic programming over suffix-automaton matches."""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tablemere.llm.automaton import SuffixAutomaton
from tablemere.llm.common import map_texts, prepare_workers, tidied, worker_state

#: Most pieces and bytes of each of the two generations of a worker's cache, the longest piece in it, and pair tests kept.
CACHE_PIECES, CACHE_BYTES, CACHE_LONGEST, CACHE_PAIRS = 250_000, 80_000_000, 256, 300_000
#: Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 30


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class _PieceCache(dict):
    """What ``make`` says of each piece, for the last two generations of CACHE_PIECES and CACHE_BYTES; long pieces are not kept."""

    def __init__(self, make: Callable[[str], str]) -> None:
        super().__init__()
        self._make, self._old, self._bytes = make, {}, 0

    def __missing__(self, piece: str) -> str:
        found = self._old.get(piece)
        if found is None:
            found = self._make(piece)
        if len(piece) > CACHE_LONGEST:
            return found
        if len(self) >= CACHE_PIECES or self._bytes >= CACHE_BYTES:
            self._old = dict(self)
            self.clear()
            self._bytes = 0
        self._bytes += sys.getsizeof(piece) + sys.getsizeof(found) + 100  # and its place in the table
        self[piece] = found
        return found


class BpeModel:
    """Encoder and decoder of a tokenizers file with a ByteLevel pre-tokenizer and a BPE model."""

    def __init__(self, source: bytes) -> None:
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True):
            raise ValueError("only BPE models with a ByteLevel pre-tokenizer are supported")
        if pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("prefix spaces, normalizers, ignored merges and dropout are not supported")
        back = {c: b for b, c in enumerate(byte_letters())}
        to_bytes = lambda t: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or stand alone are not supported")
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.token = {i: to_bytes(t) for t, i in [*vocab.items(), *self.special.items()]}
        size = max(self.token) + 1
        self.rank, self.left, self.right = array("i", [-1]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        self.pair: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.rank[z] >= 0 or max(self.rank[x], self.rank[y]) >= rank:
                raise ValueError("merges must make each token once, from tokens made before")
            self.rank[z], self.left[z], self.right[z] = rank, x, y
            self.pair[x << 32 | y] = rank
        self._tests: dict[int, bool] = {}
        ids = sorted(vocab.values())
        self.id_of = {self.token[i]: i for i in ids}
        whole = {i for i in ids if self._reached(i)}
        BpeModel._reached.cache_clear()
        self.sam = SuffixAutomaton([self.token[i] for i in ids])
        self.ends = array("i", [-1]) * len(self.sam.length)
        for i, s in zip(ids, self.sam.ends, strict=True):
            if i in whole:
                self.ends[s] = i
        # nearest state on the way of suffix links, itself included, where a token ends
        self.up = array("i", [-1]) * len(self.sam.length)
        for s in sorted(range(1, len(self.up)), key=self.sam.length.__getitem__):
            self.up[s] = s if self.ends[s] >= 0 else self.up[self.sam.link[s]]
        self.whole = {self.token[i]: i for i in whole}
        self._split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._pieces = regex.compile(PIECES)
        self._ids = _PieceCache(self._joined)
        self._odd: dict[str, str] = {}  # pieces that decoding changes

    def _crossing(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of tokens a and b; _NEVER if none.

        Undo the merges inside a and b, latest first: what then meets at the
        border did so until the merge just undone. Equal merges run from left to
        right, so a border pair must come before a merge in a, but may tie with
        one in b.
        """
        until_a = until_b = first = _NEVER
        rank, pair = self.rank, self.pair
        while True:
            k = pair.get(a << 32 | b)
            if k is not None and k < until_a and k <= until_b and k < first:
                first = k
            ra, rb = rank[a], rank[b]
            if ra > rb:
                until_a, a = ra, self.right[a]
            elif rb >= 0:
                until_b, b = rb, self.left[b]
            else:
                return first

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a border between tokens a and b."""
        key = a << 32 | b
        known = self._tests.get(key)
        if known is None:
            if len(self._tests) >= CACHE_PAIRS:
                self._tests.clear()
            known = self._tests[key] = self._crossing(a, b) == _NEVER
        return known

    @lru_cache(maxsize=None)  # noqa: B019  the build's only
    def _reached(self, token: int) -> bool:
        """Whether BPE makes this token of its own bytes."""
        if self.rank[token] < 0:
            return len(self.token[token]) == 1
        a, b = self.left[token], self.right[token]
        return self._reached(a) and self._reached(b) and self._crossing(a, b) == self.rank[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: for each prefix keep its only last token, then follow the tokens back."""
        one = self.whole.get(piece)
        if one is not None:
            return [one]
        nxt, link, length, up, ends = self.sam.next, self.sam.link, self.sam.length, self.up, self.ends
        last = array("i", [-1]) * (len(piece) + 1)
        state = size = 0
        for at, c in enumerate(piece, 1):
            to = nxt.get(state << 8 | c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt.get(state << 8 | c)
            if to is None:
                raise ValueError(f"no token for byte {c}")
            state, size = to, size + 1
            s = up[state]
            while s > 0:
                n = length[s]
                if n <= size:
                    token = ends[s]
                    if n == at or (last[at - n] >= 0 and self.compatible(last[at - n], token)):
                        last[at] = token
                        break
                s = up[link[s]]
        out, at = [], len(piece)
        while at:
            token = last[at]
            if token < 0:
                raise ValueError("a prefix has no encoding")
            out.append(token)
            at -= len(self.token[token])
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.token[i] for i in ids]).decode("utf-8", "replace")

    def _joined(self, piece: str) -> str:
        """A piece's ids, joined by commas."""
        ids = self.encode_piece(piece.encode())
        if (text := self.decode(ids)) != piece:
            self._odd[piece] = text
        return ",".join(map(str, ids))

    def _plain(self, text: str) -> tuple[list[str], list[str]]:
        pieces = self._pieces.findall(text)
        ids = list(map(self._ids.__getitem__, pieces))
        return ids, [self._odd.get(p, p) for p in pieces] if self._odd else pieces

    def run(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, their decoded text) of a whole text; special tokens' strings are those tokens."""
        if self._split is None or not self._split.search(text):
            ids, back = self._plain(text)
            return ",".join(ids), "".join(back)
        ids, back, at = [], [], 0
        for m in [*self._split.finditer(text), None]:
            plain = self._plain(text[at : m.start() if m else len(text)])
            ids += plain[0]
            back += plain[1]
            if m:
                ids.append(str(self.special[m[0]]))
                back.append(self.decode([self.special[m[0]]]))
                at = m.end()
        return ",".join(ids), "".join(back)

    def encode(self, text: str) -> list[int]:
        ids = self.run(text)[0]
        return list(map(int, ids.split(","))) if ids else []


def model_of(source: bytes) -> BpeModel:
    """The model of a tokenizers file's content, built once in each worker process."""
    return worker_state(hashlib.sha256(source).hexdigest(), lambda: BpeModel(source))


def _texts(data: np.ndarray, offs: np.ndarray) -> Iterator[str]:
    raw = data.tobytes()
    for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        yield raw[i:j].decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, intact) of every whole text; intact: decoding the ids gives the text.

    ``tokenizer`` is the path of a tokenizers file on the driver; its content
    goes out with the tasks. Null and empty texts have no ids; very long texts
    are encoded whole, and a very long piece takes 4 bytes of back-pointers for
    each of its bytes; of encodings that tie there is none, for each prefix has
    one last token; repeated rows give repeated rows; an empty table gives none;
    other columns are not read.
    """
    source = Path(tokenizer).read_bytes()

    def run(data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        model, found, sizes, intact = model_of(source), [], [0], []
        for t in _texts(data, offs):
            ids, back = model.run(t)
            found.append(np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32))
            sizes.append(len(found[-1]))
            intact.append(back == t)
        flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))
        return {"ids": pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), flat), "intact": np.array(intact, bool)}

    return map_texts(docs, run, [doc_id], text, "ids array<int>, intact boolean", state=True)


def decode(encoded: DataFrame, tokenizer: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids give a null text."""
    source = Path(tokenizer).read_bytes()
    schema = StructType([encoded.schema[doc_id], StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(source)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema.names)

    prepare_workers(encoded.sparkSession)
    return encoded.select(doc_id, ids).mapInArrow(tidied(run, state=True), schema)


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ``encode`` and of decoding its ids.

    The digests are taken in the workers, so neither ids nor texts move. Nulls,
    long texts, repeats and empty tables are as in ``encode``.
    """
    source = Path(tokenizer).read_bytes()

    def run(data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        model, counts, ids_sha, text_sha = model_of(source), [], [], []
        for t in _texts(data, offs):
            ids, back = model.run(t)
            counts.append(ids.count(",") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            text_sha.append(hashlib.sha256(back.encode()).hexdigest())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}

    return map_texts(docs, run, [doc_id], text, "n_tokens long, ids_sha256 string, decoded_sha256 string", state=True)
