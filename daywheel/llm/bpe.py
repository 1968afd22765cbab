r"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A word is a string of symbols: a byte each, the last one marked as a word's end. Reading it, a suffix automaton over the
vocabulary's tokens keeps the longest suffix read that occurs within a token; the tokens that end there lie on its chain
of suffix links. For each prefix exactly one of these is the last token of the prefix's encoding: the one that stands
alone, or that is compatible with the last token of the prefix before it, which is already known. Two tokens are
compatible if merging their symbols gives these two again; that is tested by undoing their merges, the latest first. From
the whole word the stored last tokens lead back through all the ids. The time is linear in the word, however long it is.

Words come from the vocabulary's own normalisation and splitting: by the tokenizers library, or, for characters below
U+0300, by one pattern with the same classes; tests hold both against the library. Special tokens in a text are ids of
their own, as in the library. A worker remembers the ids of words that come again, of up to CACHE words.

Memory: texts are encoded PIECE characters at a time, cut at a space between two ASCII signs or letters, where no word
and no composition of characters reaches across. A text's ids must fit a task.

Defined results: a null or empty text has no ids and decodes to the empty text; rows that repeat a doc_id are encoded
each; decoding null ids gives the empty text, and unknown ids are left out; an empty table gives no rows; all columns
are kept, and those named as the results are replaced.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from .common import text_batches

VOCABULARY = "word_bpe_49k.json"
CACHE = 600_000
#: Longer words aren't remembered.
LONG_WORD = 64
PIECE = 1 << 20
#: A symbol is a byte, or END + the byte at a word's end.
END = 256
NONE = sys.maxsize


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: a visible character for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SuffixAutomaton:
    """Of the strings of symbols given in turn: states, suffix links, and the strings that end in each state."""

    def __init__(self) -> None:
        self.length, self.link = [0], [-1]
        self.step: list[dict[int, int]] = [{}]
        self.token: dict[int, int] = {}

    def add(self, symbols: list[int], token: int) -> None:
        at = 0
        for s in symbols:
            at = self._extend(at, s)
        # The string is the longest of its state and stays so: splitting a state takes its shorter strings away.
        self.token[at] = token

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _extend(self, last: int, s: int) -> int:
        length, link, step = self.length, self.link, self.step
        there = step[last].get(s)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._split(last, s, there)
        new = self._new(length[last] + 1, 0, {})
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, s, q)
        return new

    def _split(self, p: int, s: int, q: int) -> int:
        """A state for the strings of q that are no longer than p's with s behind."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(s) == q:
            self.step[p][s] = clone
            p = self.link[p]
        return clone

    def chains(self) -> list[tuple[tuple[int, int], ...]]:
        """Of each state the (length, token) on its chain of suffix links, longest first."""
        found: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        for at in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            mine = ((self.length[at], self.token[at]),) if at in self.token else ()
            found[at] = mine + found[self.link[at]]
        return found


class Encoder:
    """Ids of words and texts under a vocabulary of byte-level merges with marked word ends."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model = made["model"]
        suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError(f"{path}: byte-level merges with marked word ends are expected")
        vocab, alphabet = model["vocab"], byte_alphabet()
        self.library = Tokenizer.from_file(path)
        self.symbol = [0] * (2 * END)
        for shown, b in alphabet.items():
            self.symbol[b], self.symbol[END + b] = vocab[shown], vocab[shown + suffix]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = dict.fromkeys(self.symbol, -1)
        self.merged: dict[int, int] = {}
        spelt = {t: [s] for s, t in enumerate(self.symbol)}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merged[a << 32 | b] = whole
            if whole not in spelt:
                self.parts[whole], self.rank[whole], spelt[whole] = (a, b), rank, spelt[a] + spelt[b]
        self.size = {t: len(s) for t, s in spelt.items()}
        # A token whose own symbols merge into something else never occurs.
        alone = dict.fromkeys(self.symbol, True)
        for t, (a, b) in self.parts.items():
            alone[t] = alone[a] and alone[b] and self._compatible(a, b, self.rank[t])
        self.machine = SuffixAutomaton()
        for t in sorted((t for t in spelt if alone[t]), key=spelt.__getitem__):
            self.machine.add(spelt[t], t)
        self.chains = self.machine.chains()
        self.falls: dict[int, tuple[int, int]] = {}
        self.together: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.simple = _simple_words(made)

    def _compatible(self, a: int, b: int, limit: int = NONE) -> bool:
        """Whether a's and b's symbols in a row merge into a and b again; limit: the rank that ends it."""
        merged, rank, parts = self.merged, self.rank, self.parts
        while True:
            whole = merged.get(a << 32 | b)
            if whole is not None and rank[whole] < limit:
                return False
            if rank[a] > rank[b]:
                # a's merge came later than b's; of equal ranks the left pair comes first.
                limit, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, parts[b][0]
            else:
                return True

    def _fall(self, state: int, s: int) -> tuple[int, int]:
        """(state, length of the match) after s, where state has no step for it."""
        step, link = self.machine.step, self.machine.link
        key, at = state << 10 | s, state
        while s not in step[at]:
            at = link[at]
        found = self.falls[key] = step[at][s], self.machine.length[at] + 1
        return found

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, little-endian unsigned 32-bit. In order, a word starts from the prefixes it shares with the one before."""
        step, falls, chains, together, sizes = self.machine.step, self.falls, self.chains, self.together, self.size
        found, before = {}, b""
        # Of each prefix of the word before, its state, the length of its match, and the last token of its encoding.
        states, matches, last = [0], [0], [-1]
        for word in sorted(words):
            symbols = word.encode("utf-8", "surrogatepass")
            end = len(symbols) - 1
            i = 0
            # The last symbol of either word is marked: what comes before it can be shared.
            for x, y in zip(before[:-1], symbols[:end], strict=False):
                if x != y:
                    break
                i += 1
            del states[i + 1 :], matches[i + 1 :], last[i + 1 :]
            state, size = states[i], matches[i]
            for s in symbols[i:]:
                if i == end:
                    s += END
                i += 1
                there = step[state].get(s)
                if there is None:
                    state, size = falls.get(state << 10 | s) or self._fall(state, s)
                else:
                    state = there
                    size += 1
                token = -1
                for n, t in chains[state]:
                    # A token longer than the match may end in this state too; it isn't there.
                    if n > size:
                        continue
                    if n == i:
                        token = t
                        break
                    left = last[i - n]
                    if left < 0:
                        continue
                    fits = together.get(left << 32 | t)
                    if fits is None:
                        if len(together) > 4 * CACHE:
                            together.clear()
                        fits = together[left << 32 | t] = self._compatible(left, t)
                    if fits:
                        token = t
                        break
                states.append(state)
                matches.append(size)
                last.append(token)
            ids, at = [], i
            while at:
                ids.append(last[at])
                at -= sizes[last[at]]
            ids.reverse()
            found[word] = struct.pack(f"<{len(ids)}I", *ids)
            before = symbols
        return found

    def words(self, text: str) -> list[str]:
        """The vocabulary's words of a text without special tokens."""
        if self.simple is not None and (found := self.simple(text)) is not None:
            return found
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        alphabet = self._bytes
        return [bytes(map(alphabet.__getitem__, w)).decode("utf-8", "surrogatepass") for w, _ in shown]

    _bytes = byte_alphabet()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Of each text its ids, little-endian unsigned 32-bit."""
        parts: list[tuple[int, bytes | list[str]]] = []
        size, done = 0, defaultdict(list)
        for i, text in enumerate(texts):
            done[i] = []
            for part in self.cut(text) if "<" in text else [text]:
                if part in self.special:
                    parts.append((i, struct.pack("<I", self.special[part])))
                    continue
                for piece in _pieces(part):
                    parts.append((i, self.words(piece)))
                    size += len(piece)
                    if size > PIECE:
                        self._assemble(parts, done)
                        parts, size = [], 0
        self._assemble(parts, done)
        return [b"".join(x) for x in done.values()]

    def _assemble(self, parts: list[tuple[int, bytes | list[str]]], done: dict[int, list[bytes]]) -> None:
        known = self.known
        found = [x if isinstance(x, bytes) else list(map(known.get, x)) for _, x in parts]
        new = self.learn({w for (_, words), ids in zip(parts, found, strict=True) if not isinstance(ids, bytes) and None in ids for w, x in zip(words, ids, strict=True) if x is None})
        for (i, words), ids in zip(parts, found, strict=True):
            if isinstance(ids, list):
                ids = b"".join([new[w] if x is None else x for x, w in zip(ids, words, strict=True)] if None in ids else ids)
            done[i].append(ids)
        if len(known) > CACHE:
            known.clear()
        known.update((w, ids) for w, ids in new.items() if len(w) <= LONG_WORD)


_GAP = re.compile("(?<=[!-~]) (?=[!-~])")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE and (gap := _GAP.search(text, at + PIECE)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


#: The splitting pattern and normalisation that _simple_words stands for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALS = ["NFC", "Replace", "Lowercase"]


def _simple_words(made: dict):
    """For texts of characters below U+0300: their words by one pattern; None for other texts, None in all if the vocabulary splits otherwise."""
    normal, split = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
    kinds, first = [x["type"] for x in normal.get("normalizers", [])], (split.get("pretokenizers") or [{}])[0]
    if kinds != NORMALS or first.get("pattern", {}).get("Regex") != SPLIT or not first.get("invert"):
        return None
    below = [chr(c) for c in range(0x300)]
    kind = {c: unicodedata.category(c)[0] for c in below}
    letters, numbers = ("".join(re.escape(c) for c in below if kind[c] == k) for k in "LN")
    blank = "\\t-\\r \x85\xa0"
    words = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{blank}{letters}{numbers}]+").findall
    # U+0130 becomes two characters, one of them beyond.
    other = re.compile("[^\\x00-įı-˿]").search
    return lambda text: None if other(text) else words(text.lower())


@functools.cache
def token_names(path: str) -> pa.Array:
    """The names of all ids, in order."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    names = {t: name for name, t in made["model"]["vocab"].items()} | {t["id"]: t["content"] for t in made["added_tokens"]}
    return pa.array([names.get(t) for t in range(max(names) + 1)], pa.string())


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    path = path or default_vocabulary()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32)))


def _with(df: DataFrame, name: str, kind: DataType, run: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """df with one more column that run makes of a record batch, or with that column replaced."""
    schema = StructType([f for f in df.schema.fields if f.name.lower() != name.lower()]).add(name, kind)
    keep = [i for i, c in enumerate(df.columns) if c.lower() != name.lower()]

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), run(batch)], schema.names)

    return df.mapInArrow(each, schema)


def encode(docs: DataFrame, text: str = "text", ids: str = "bpe_ids", vocabulary: str | None = None) -> DataFrame:
    """docs with the ids of column `text`, an array of int."""
    text_batches(docs.sparkSession)
    path, at = vocabulary or default_vocabulary(), docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.Array:
        return _lists(encoder(path).encode(t or "" for t in batch.column(at).to_pylist()))

    return _with(docs, ids, ArrayType(IntegerType()), run)


def decode(rows: DataFrame, ids: str = "bpe_ids", text: str = "bpe_text", vocabulary: str | None = None) -> DataFrame:
    """rows with the text of column `ids`: the names of the ids, special ones too, joined by spaces, as the library does without a decoder."""
    text_batches(rows.sparkSession)
    path, at = vocabulary or default_vocabulary(), rows.columns.index(ids)

    def run(batch: pa.RecordBatch) -> pa.Array:
        names = token_names(path)
        lists = batch.column(at).cast(pa.list_(pa.int64())).fill_null([])
        flat = lists.flatten()
        good = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names))), flat, None)
        tokens = names.take(good)
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int32)
        if tokens.null_count:
            there = tokens.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(there)))[offsets].astype(np.int32)
            tokens = tokens.drop_null()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens), " ")

    return _with(rows, text, StringType(), run)
