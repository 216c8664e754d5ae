"""Byte-level BPE by per-prefix dynamic programming, and its inverse.

For every prefix of a word there is exactly one token that can end its encoding. The suffix automaton of the vocabulary
gives the longest piece of any token that ends at a position, and its suffix links all tokens that end there, longest
first; a pair-compatibility test looks for a merge across the border and tells whether BPE would keep the token beside
the last token of the shorter prefix.
Following the back-pointers gives the ids. Work per word is linear in its matches, with no merge loop, so a very long
run without spaces stays cheap.

Edge cases: null and empty texts give no ids and decode to the empty text; repeated rows and null ids keep one output
row per input row; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import lean

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Token pairs, and words of a generation, remembered by a worker.
MEMO = 400_000
#: Bytes of a word whose prefixes are remembered.
HEAD = 6


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encoder and decoder of one byte-level BPE vocabulary file (JSON content as bytes)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        back = byte_chars()
        self.tokens = [b""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for s, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in s)
        # ranks: the order in which BPE makes tokens; single bytes come first
        n = len(self.tokens)
        self.rank = {}
        self.id_of: list[int] = []
        self.split: list[tuple[int, int]] = []
        self.pairs: dict[int, int] = {}
        for s, i in vocab.items():
            if len(self.tokens[i]) == 1:
                self._add(i, None)
        for m in merges:
            a, b = m if isinstance(m, list) else m.split(" ")
            if (i := vocab[a + b]) not in self.rank:
                self._add(i, (self.rank[vocab[a]], self.rank[vocab[b]]))
            self.pairs.setdefault(self.rank[vocab[a]] * n + self.rank[vocab[b]], self.rank[i])
        self.n = n
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.splitter = regex.compile(SPLIT)
        self.gap = re.compile(r" (?=\s|\Z)")
        self.before = re.compile(r" (?=\S)")
        self.memo_pairs: dict[int, bool] = {}
        self.heads: dict[bytes, tuple] = {}
        self.steps: dict[tuple[int, int], dict] = {}
        self.start = self._start()
        self.id_bytes = [i.to_bytes(4, "little") for i in self.id_of]
        self.spaced = _Memo(lambda w: self.pieces(" " + w))
        self.first = _Memo(self.pieces)

    def _add(self, i: int, made: tuple[int, int] | None) -> None:
        self.rank[i] = r = len(self.split)
        self.id_of.append(i)
        self.split.append(made or (r, r))

    @functools.cached_property
    def auto(self) -> SuffixAutomaton:
        return SuffixAutomaton([self.tokens[i] for i in self.id_of])

    @functools.cached_property
    def right(self) -> list:
        return [self.spines(t, 1) for t in range(len(self.split))]

    @functools.cached_property
    def left(self) -> list:
        return [self.spines(t, 0) for t in range(len(self.split))]

    def spines(self, t: int, side: int) -> list[tuple[int, int]]:
        """Tokens that are at one end of t while it is made, each with the rank at which the next of them takes its place."""
        out, until = [], 1 << 62
        while True:
            out.append((t, until))
            part = self.split[t][side]
            if part == t:
                return out
            t, until = part, t

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b (as ranks) side by side.

        It does unless some merge crosses their border: of a token x that ends a for a while and a token y that begins
        b for a while, at a rank before either is replaced. Of two merges of one rank the left one comes first, so x
        may be replaced at that rank, and y not before it.
        """
        for x, gone in self.right[a]:
            for y, lost in self.left[b]:
                made = self.pairs.get(x * self.n + y)
                if made is not None and made < gone and made <= lost:
                    return False
        return True

    def word(self, raw: bytes) -> bytes:
        """The ids of one pre-token. What is known of its first HEAD bytes is remembered: many words begin alike."""
        if len(raw) <= HEAD:
            _, last, sizes = self.prefixes(raw, self.start, [-1], [0])
        else:
            head = raw[:HEAD]
            known = self.heads.get(head)
            if known is None:
                if len(self.heads) >= MEMO // 4:
                    self.heads.clear()
                known = self.heads[head] = self.prefixes(head, self.start, [-1], [0])
            step, last, sizes = known
            _, last, sizes = self.prefixes(raw[HEAD:], step, last.copy(), sizes.copy())
        out, at, ids = [], len(raw), self.id_bytes
        while at:
            out.append(ids[last[at]])
            at -= sizes[at]
        out.reverse()
        return b"".join(out)

    def prefixes(self, raw: bytes, step: dict, last: list[int], sizes: list[int]):
        """Goes on by the bytes of raw: adds the last token of every further prefix, and its length, to last and sizes."""
        memo, n = self.memo_pairs, self.n
        end = len(last) - 1
        for c in raw:
            end += 1
            try:
                step = step[c]
            except KeyError:
                step = self.after(step, c)
            for t, k in step[-1]:
                if end != k:
                    key = last[end - k] * n + t
                    try:
                        if not memo[key]:
                            continue
                    except KeyError:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[key] = self.compatible(last[end - k], t)
                        if not memo[key]:
                            continue
                last.append(t)
                sizes.append(k)
                break
        return step, last, sizes

    def after(self, step: dict, c: int) -> dict:
        """The step to which byte c leads: the longest piece of a token that ends with it, as found in the automaton.

        A step holds the steps known to follow it, by byte, under -1 the tokens that end there, longest first, and under
        -2 its state and the length of the piece.
        """
        nxt, link, length, ends = self.auto.next, self.auto.link, self.auto.length, self.auto.ends
        state, size = step[-2]
        while c not in nxt[state]:
            state = link[state]
            size = length[state]
        state, size = nxt[state][c], size + 1
        if (to := self.steps.get((state, size))) is None:
            if len(self.steps) >= MEMO // 4:
                self.steps.clear(), self.heads.clear()
                self.start = self._start()
            # a shorter piece than the state's longest has the tokens of the links only
            to = self.steps[state, size] = {-1: ends[state] if size == length[state] else ends[link[state]], -2: (state, size)}
        step[c] = to
        return to

    def _start(self) -> dict:
        return {-1: [], -2: (0, 0)}

    def pieces(self, text: str) -> bytes:
        parts = self.splitter.findall(text)
        if len(parts) == 1:
            return self.word(text.encode())
        # most parts are met in other words too, or alone
        return b"".join([self.spaced[p[1:]] if p[0] == " " else self.first[p] for p in parts])

    def _plain(self, text: str) -> bytes:
        # A border always lies before a space that a visible character follows, so the parts are encoded alone.
        parts = self.before.split(text) if self.gap.search(text) else text.split(" ")
        return self.first[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of added tokens become those tokens."""
        if not text:
            return b""
        if self.special_re is None or not self.special_re.search(text):
            return self._plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(self.special_re.split(text)) if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class SuffixAutomaton:
    """The suffix automaton of several byte strings.

    next and link are its transitions and suffix links; length is that of a state's longest string; ends lists the
    (number, length) of given strings that are suffixes of it, longest first.
    """

    def __init__(self, strings: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [0], [0]
        for s in strings:
            state = 0
            for c in s:
                state = self._grow(state, c)
        own: dict[int, int] = {}
        for i, s in enumerate(strings):
            state = 0
            for c in s:
                state = self.next[state][c]
            own[state] = i
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            shorter = self.ends[self.link[state]]
            self.ends[state] = [(own[state], self.length[state]), *shorter] if state in own else shorter

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def _grow(self, at: int, c: int) -> int:
        """The state of the string at `at` with c after it; made if it is new."""
        to = self.next[at].get(c)
        if to is not None:
            return to if self.length[to] == self.length[at] + 1 else self._part(at, c, to)
        new = self._state(self.length[at] + 1, 0, {})
        while c not in self.next[at]:
            self.next[at][c] = new
            if not at:
                return new
            at = self.link[at]
        to = self.next[at][c]
        self.link[new] = to if self.length[to] == self.length[at] + 1 else self._part(at, c, to)
        return new

    def _part(self, at: int, c: int, to: int) -> int:
        """Parts the shorter strings of `to`, those up to the one at `at` with c after it, from the longer ones."""
        new = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = new
        while self.next[at].get(c) == to:
            self.next[at][c] = new
            if not at:
                break
            at = self.link[at]
        return new


class _Memo(dict):
    """Remembers short words only, 2 MEMO of them at most: those of the last generation, and those met again since."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


_encoders: dict[int, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """This worker's encoder for a vocabulary; built once."""
    key = hash(content)
    if key not in _encoders:
        _encoders[key] = Encoder(content)
    return _encoders[key]


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file (a few MB, whatever the input) broadcast to the executors."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded text of every row."""
    vocab = vocabulary(df, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                raw = [enc.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                ids = pa.array([np.frombuffer(r, "<i4") for r in raw], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([enc.decode(r) for r in raw], pa.string())], ["id", "ids", "decoded"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run), "id long, ids array<int>, decoded string")


def encode_digest(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode_decode gives, taken where it is made."""
    vocab = vocabulary(df, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for b in batches:
            n, hi, hd = [], [], []
            for t in b.column(1):
                raw = enc.encode(t.as_py() or "")
                n.append(len(raw) // 4)
                hi.append(hashlib.sha256(raw).hexdigest())
                hd.append(hashlib.sha256(enc.decode(raw).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.string()), pa.array(hd, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
