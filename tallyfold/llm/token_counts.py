"""Token counts by compiled finite-state transducers.

Two deterministic machines, whose transitions carry the number of tokens they emit:

- The *splitter* reads character classes and emits a pre-token's start. Its seven states
  are compiled into two arrays. A batch of texts is cut into chunks; each chunk's state map
  (entry state to exit state) is found for all chunks at once, the maps are composed by a
  parallel prefix scan, and a last pass with known entry states emits the starts.
- The *merger* reads a pre-token's bytes. Its state holds the last tokens of the encoding of
  what has been read, as far back as a later token can begin; a transition carries the
  change in the number of tokens, which may be negative. States are compiled when first met.
"""

from __future__ import annotations

import json
import math
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import map_texts

TOKENIZER = "word_bpe_49k.json"
CHUNK = 64
KNOWN_WORDS = 500_000
KNOWN_STATES = 100_000

SPACE, LETTER, DIGIT, OTHER, QUOTE, SHORT, R, V, L, E = range(10)
FRESH, WORD, MARKS, QUOTED, AFTER_R, AFTER_V, AFTER_L = range(7)
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts emitted) by state and class, for the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d|letters|one digit|others``."""
    step = np.zeros((7, 10), np.uint8)
    emit = np.zeros((7, 10), np.uint8)
    letters = (LETTER, SHORT, R, V, L, E)

    def put(state, classes, to, out):
        for c in classes:
            step[state, c], emit[state, c] = to, out

    for state in range(7):
        pending = BEFORE if state in (AFTER_R, AFTER_V, AFTER_L) else 0
        put(state, (SPACE,), FRESH, pending)
        put(state, letters, WORD, HERE)
        put(state, (DIGIT,), FRESH, HERE | pending)
        put(state, (OTHER,), MARKS, HERE | pending)
        put(state, (QUOTE,), QUOTED, HERE | pending)
        if pending:
            put(state, letters, WORD, BEFORE)
    put(WORD, letters, WORD, 0)
    put(MARKS, (OTHER, QUOTE), MARKS, 0)
    put(QUOTED, (OTHER, QUOTE), MARKS, 0)
    put(QUOTED, (SHORT,), FRESH, 0)
    for first, last, state in ((R, E, AFTER_R), (V, E, AFTER_V), (L, L, AFTER_L)):
        put(QUOTED, (first,), state, 0)
        put(state, (last,), FRESH, 0)
    return step, emit


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = DIGIT
        elif chr(code).isspace() and not 0x1C <= code <= 0x1F:
            table[code] = SPACE
    for letters, kind in (("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE)):
        table[[ord(c) for c in letters]] = kind
    return table


def state_maps(kinds: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Exit state of each chunk (rows of ``kinds``) for each entry state."""
    n_states = step.shape[0]
    flat = step.ravel()
    at = np.repeat(np.arange(n_states, dtype=np.uint8)[:, None], kinds.shape[0], axis=1)
    for k in range(kinds.shape[1]):
        at = flat[at * np.uint8(step.shape[1]) + kinds[:, k]]
    return at.T.copy()


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, in log(n) rounds."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], axis=1)
        gap *= 2
    return maps


def starts_of(codes: np.ndarray, step: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pre-tokens. The last code must be white space."""
    n = len(codes)
    kinds = np.full(-(-n // CHUNK) * CHUNK, SPACE, np.uint8)
    kinds[:n] = classes()[codes]
    kinds = kinds.reshape(-1, CHUNK)
    after = scan(state_maps(kinds, step))[:, FRESH]
    at = np.concatenate([[FRESH], after[:-1]]).astype(np.uint8)
    out = np.empty(kinds.shape, np.uint8)
    flat_step, flat_emit, width = step.ravel(), emit.ravel(), np.uint8(step.shape[1])
    for k in range(CHUNK):
        cell = at * width + kinds[:, k]
        out[:, k], at = flat_emit[cell], flat_step[cell]
    out = out.ravel()
    begins = (out & HERE).astype(bool)
    begins[:-1] |= (out[1:] & BEFORE).astype(bool)
    edges = np.flatnonzero(begins | (kinds.ravel() == SPACE))
    where = np.flatnonzero(begins)
    return where, edges[np.searchsorted(edges, where, "right")]


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Number of tokens of a pre-token under a merge list whose words end in a suffix.

    Symbols are bytes; a word's last byte is raised by 256, which stands for the suffix.
    """

    def __init__(self, merges: list, suffix: str, max_states: int = KNOWN_STATES):
        letters = byte_letters()

        def symbols(token: str) -> str:
            ends = token.endswith(suffix)
            bare = [letters[c] for c in (token[: -len(suffix)] if ends else token)]
            return "".join(map(chr, bare[:-1])) + chr(bare[-1] + 256 * ends)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for i, (a, b) in enumerate(pairs):
            pair = (symbols(a), symbols(b))
            self.rank.setdefault(pair, i)
            self.parts.setdefault(pair[0] + pair[1], pair)
        self.tokens = {*self.parts, *map(chr, range(512))}
        self.beginnings = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.longest = max(map(len, self.tokens))
        self.max_states = max_states
        self.edges: dict = {}
        self._forget()

    def _forget(self) -> None:
        self.state_ids: dict = {("", (), ()): 0}
        self.states = [("", (), ())]
        self.arcs: list[dict] = [{}]

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """What stands at the token's right (1) or left (0) edge while it is built up, each
        with the rank of the merge that takes it; the token itself is never taken."""
        key = (token, side)
        if key not in self.edges:
            if len(self.edges) > 200_000:
                self.edges.clear()
            chain, gone = [(token, math.inf)], math.inf
            while token in self.parts:
                pair = self.parts[token]
                gone, token = self.rank[pair], pair[side]
                chain.append((token, gone))
            self.edges[key] = chain[::-1]
        return self.edges[key]

    def _adjacent(self, left: str, right: str) -> bool:
        """Do both tokens stay as they are when they stand side by side? Two symbols that
        meet at the border merge if their rank comes before both are taken; of equal ranks,
        the merge further left comes first."""
        ends, begins = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (a, a_gone), (b, b_gone) = ends[i], begins[j]
            rank = self.rank.get((a, b))
            if rank is not None and rank < a_gone and rank <= b_gone:
                return False
            if a_gone == b_gone == math.inf:
                return True
            if a_gone <= b_gone:
                i += 1
            else:
                j += 1

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        """State: the window of symbols in which a later token can still begin, and for each
        place in it from its start on the last token before it and the count there, less the
        count at the end. Empty token: the word's start."""
        window, before, counts = self.states[state]
        if not before:
            before, counts = ("",), (0,)
        grown = window + symbol
        for i in range(max(0, len(grown) - self.longest), len(grown)):
            token = grown[i:]
            if token in self.tokens and (not before[i] or self._adjacent(before[i], token)):
                break
        total = counts[i] + 1
        before, counts = (*before, token), (*counts, total)
        cut = next((i for i in range(len(grown)) if grown[i:] in self.beginnings), len(grown))
        key = (grown[cut:], before[cut:], tuple(c - total for c in counts[cut:]))
        if key not in self.state_ids:
            self.state_ids[key] = len(self.states)
            self.states.append(key)
            self.arcs.append({})
        arc = self.arcs[state][symbol] = (self.state_ids[key], total)
        return arc

    def count(self, word: bytes) -> int:
        if len(self.states) > self.max_states:
            self._forget()
        state = total = 0
        for symbol in word[:-1].decode("latin-1") + chr(word[-1] + 256):
            state, emitted = self.arcs[state].get(symbol) or self._compile(state, symbol)
            total += emitted
        return total


class _Known(dict):
    def __init__(self, merger: Merger):
        self.merger = merger

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        n = self.merger.count(word.encode("utf-8"))
        if len(word) < 100:
            self[word] = n
        return n


class Counter:
    """Counts the tokens of lists of texts, as compiled from a tokenizer's JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.step, self.emit = splitter()
        self.known = _Known(Merger(spec["model"]["merges"], spec["model"]["end_of_word_suffix"]))

    def _lowered(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # the final sigma depends on what follows it in Python only
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        special = np.zeros(len(texts), np.int64)
        ready = []
        for i, text in enumerate(texts):
            text = text or ""
            if "<|" in text:
                for mark in self.specials:
                    special[i] += text.count(mark)
                    text = text.replace(mark, "\n")
            ready.append(self._lowered(text) + "\n")
        joined = "".join(ready)
        if not joined:
            return special
        ends = np.cumsum([len(t) for t in ready])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin, end = starts_of(codes, self.step, self.emit)
        words = map(joined.__getitem__, map(slice, begin.tolist(), end.tolist()))
        counts = np.fromiter(map(self.known.__getitem__, words), np.int64, len(begin))
        sums = np.concatenate([[0], np.cumsum(counts)])
        upto = sums[np.searchsorted(begin, ends)]
        return np.diff(upto, prepend=0) + special


@lru_cache(4)
def _counter(path: str | None) -> Counter:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Counter(path)


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Replace the text by ``n_tokens`` (bigint); other columns stay.

    ``path``: a tokenizer's JSON file that all executors have; by default that of the
    installed tokenizer files. Null and empty texts have 0 tokens. Repeated rows are counted
    each. A text of any length is read whole, batches of texts a few MB at a time.
    """

    def counted(texts):
        return {"n_tokens": pa.array(_counter(path)(texts), pa.int64())}

    return map_texts(docs, text, "n_tokens bigint", counted)


def token_report(docs: DataFrame, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for rows of (doc_id, text)."""
    rows = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text"
    )
    return token_counts(rows).withColumn("over_limit", F.col("n_tokens") > limit)
