"""BPE encoding and decoding with a deterministic tokenization automaton.

States are the tokens last emitted, arcs are labelled by tokens, and a path is legal exactly if it is
the BPE tokenization of the bytes it spells. Merge (a, b) -> ab is one gadget:

* every state with an a-arc gets an ab-arc; it leads to a copy of the state behind b;
* the state behind a becomes a copy of its own without the b-arc.

`MergeAutomaton.arc` gives an arc as all gadgets applied in merge order leave it. Only gadgets that
touch a pair change its arc, so an arc is compiled at its first use from the gadgets that made its two
ends, and kept in the transition table. 50,000 merges would fill a table of 2.5e9 arcs otherwise.
Encoding reads a pre-split word by table lookups, taking the longest arc that fits and going back from
dead states. A prefix has one legal path, so each position is dead at most once and a word takes time
linear in its length times the longest token. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomlake.llm.common import KEPT, lean

# Fixed value: the pre-split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = re.compile("[\x00-\x1b -~À-ÖØ-öø-ÿ]*").fullmatch
LATIN_SPLIT = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+").findall
CACHE_WORDS = 600_000
NEVER = 1 << 60


def printable_bytes() -> dict[str, int]:
    """The printable stand-in of each byte, as byte-level vocabularies spell it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def supported(data: dict) -> None:
    """Raise unless a tokenizers file asks for nothing but what this module does."""
    model, split = data["model"], data.get("pre_tokenizer") or {"type": "ByteLevel", "add_prefix_space": False}
    wrong = [k for k in ("normalizer", "post_processor") if data.get(k)]
    wrong += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["model type"] * (model.get("type", "BPE") != "BPE")
    wrong += ["pre_tokenizer"] * (split["type"] != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True))
    wrong += ["decoder"] * ((data.get("decoder") or {"type": "ByteLevel"})["type"] != "ByteLevel")
    wrong += ["added_tokens"] * any(x.get(k) for x in data.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    if wrong:
        raise ValueError(f"not supported in a vocabulary file: {', '.join(wrong)}")


def gadget_rows(base: list[int], merges: list[tuple[int, int, int]]) -> dict[int, set[int]]:
    """For the state behind each token the labels of its arcs, by one merge gadget after another; merges: (a, b, ab).

    This is the whole automaton, for vocabularies whose square is small; MergeAutomaton.arc gives the same arcs one by one.
    """
    rows = {x: set(base) for x in base}
    for a, b, ab in merges:
        behind = set(rows[b])
        if b in rows[a]:
            if a in behind:
                behind.add(ab)
            for x, row in rows.items():
                if a in row and not x == a == b:
                    row.add(ab)
            rows[a].discard(b)
        rows[ab] = behind
    return rows


class WordCache(dict):
    """Words and their paths. A full cache forgets, but for the words that came first in their thousands."""

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            keep = list(self.items())[: CACHE_WORDS // 4]
            self.clear()
            self.update(keep)


class MergeAutomaton:
    def __init__(self, spec: str) -> None:
        """spec: the JSON text of a tokenizers file with a ByteLevel BPE model."""
        data = json.loads(spec)
        supported(data)
        byte_of = printable_bytes()
        spell = lambda s: bytes(byte_of[c] for c in s)
        vocab = data["model"]["vocab"]
        self.labels: dict[int, bytes] = {i: spell(s) for s, i in vocab.items()}
        self.ids: dict[bytes, int] = {b: i for i, b in self.labels.items()}
        #: The longest token by its first three bytes; all others have two bytes at most.
        self.reach: dict[bytes, int] = {}
        for b in self.ids:
            if len(b) > 2:
                self.reach[b[:3]] = max(self.reach.get(b[:3], 0), len(b))
        self.born: dict[int, int] = {i: -1 for i in self.labels}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for t, m in enumerate(data["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.merged.setdefault(pair, t)
            if made not in self.parts:
                self.born[made], self.parts[made] = t, pair
        top = max(self.labels, default=-1) + 1
        self.sizes, self.shorter = [0] * top, [-1] * top
        for b, i in self.ids.items():
            self.sizes[i] = len(b)
            self.shorter[i] = next((self.ids[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ids), -1)
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.special_at = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        #: The transition table: for each state the arcs that were asked for.
        self.table: list[dict[int, bool]] = [{} for _ in range(top)]
        #: Paths of words that were read before; half of a full cache goes, the older part of what isn't kept.
        self.words: dict[str, str] = WordCache()
        self.packed: dict[str, bytes] = WordCache()
        self.any_split = regex.compile(PATTERN).findall
        self.text_labels = {str(i): b for i, b in self.labels.items()} | {str(i): s.encode() for s, i in self.special.items()}

    def _after(self, x: int, y: int, t: int) -> bool:
        """Whether the state behind x has a y-arc just before gadget t."""
        while True:
            cut, bx, by = self.merged.get((x, y), NEVER), self.born[x], self.born[y]
            if max(bx, by) < cut < t:
                return False
            if bx < 0 and by < 0:
                return True
            if x == y:
                a, b = self.parts[x]
                x, y, t = b, a, bx
            elif bx > by:
                x, t = self.parts[x][1], bx
            else:
                a, b = self.parts[y]
                if x == a == b:
                    return False
                y, t = a, by

    def arc(self, x: int, y: int) -> bool:
        """Whether the state behind x has a y-arc; kept in the transition table."""
        row = self.table[x]
        if y not in row:
            row[y] = self._after(x, y, NEVER)
        return row[y]

    def path(self, word: bytes) -> list[int]:
        """The labels of the only legal path that spells word."""
        find, reach, sizes, shorter, table = self.ids.get, self.reach.get, self.sizes, self.shorter, self.table
        token = find(word)
        if token is not None:
            return [token]
        n, at, arcs, out, dead = len(word), 0, None, [], None
        while at < n:
            end = at + reach(word[at : at + 3], 2)
            if end > n:
                end = n
            token = find(word[at:end])
            while token is None:
                end -= 1
                token = find(word[at:end])
            while arcs is not None or dead:
                if not dead or end not in dead:
                    if arcs is None:
                        break
                    legal = arcs.get(token)
                    if legal is None:
                        legal = self.arc(out[-1], token)
                    if legal:
                        break
                token = shorter[token]
                while token < 0:  # a dead state: go back and take a shorter arc there
                    dead = dead or set()
                    dead.add(at)
                    token = out.pop()
                    at -= sizes[token]
                    token = shorter[token]
                    arcs = table[out[-1]] if out else None
                end = at + sizes[token]
            out.append(token)
            at, arcs = end, table[token]
        return out

    def split(self, text: str) -> list[str]:
        """Pre-split words; text of Latin letters alone takes the same pattern with plain classes, which is faster."""
        return LATIN_SPLIT(text) if LATIN(text) else self.any_split(text)

    def _plain(self, text: str) -> str:
        words = self.split(text)
        known = self.words
        try:
            return ",".join(map(known.__getitem__, words))
        except KeyError:
            path = self.path
            for w in words:
                if w not in known:
                    known[w] = ",".join(map(str, path(w.encode("utf-8", "surrogatepass"))))
            return ",".join(map(known.__getitem__, words))

    def encode(self, text: str | None) -> str:
        """Decimal ids joined by commas; the strings of added tokens in a text are those tokens."""
        if not text:
            return ""
        self.words.trim()
        if not self.special_at or not self.special_at.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self._plain(text[at : m.start()]), str(self.special[m[0]])]
            at = m.end()
        return ",".join(filter(None, [*out, self._plain(text[at:])]))

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of encode() as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        self.packed.trim()
        if self.special_at and self.special_at.search(text):
            return np.array(self.encode(text).split(","), np.uint32).astype("<u4").tobytes()
        words = self.split(text)
        known = self.packed
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            path = self.path
            for w in words:
                if w not in known:
                    known[w] = array("I", path(w.encode("utf-8", "surrogatepass"))).tobytes()
            return b"".join(map(known.__getitem__, words))

    def decode(self, ids: str) -> str:
        """The text that the arcs of these ids spell; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.text_labels.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_BUILT: dict[int, MergeAutomaton] = {}


def automaton(spec: str) -> MergeAutomaton:
    """One automaton a process for each vocabulary."""
    key = hash(spec)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = MergeAutomaton(spec)
    KEPT["bpe"] = _BUILT.clear
    return _BUILT[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text and decode it again.

    tokenizer: path of a vocabulary file; it is read once and its text, of fixed size, is broadcast.
    Returns key, n_tokens, ids (decimal, joined by commas) and decoded. A null text is empty: no ids,
    empty decoded text. Repeated rows and null keys give a row each; other columns are not read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(spec.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 1000):
                ids = [auto.encode(t) for t in texts[at : at + 1000]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1000), pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()), pa.array(ids, pa.string()), pa.array([auto.decode(x) for x in ids], pa.string())],
                    names=[key, "n_tokens", "ids", "decoded"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(lean(run, "bpe"), f"{key} {kind}, n_tokens long, ids string, decoded string")


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, hashed where they are made.

    Like encode_documents, but ids and decoded text leave the worker as digests only.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(spec.value)
        for batch in batches:
            counts, left, right = [], [], []
            for t in batch.column(1):
                ids = auto.encode(t.as_py())
                counts.append(ids.count(",") + 1 if ids else 0)
                left.append(sha(ids))
                right.append(sha(auto.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(counts, np.int64)), pa.array(left, pa.string()), pa.array(right, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(lean(run, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
