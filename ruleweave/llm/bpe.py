"""BPE encoding and decoding with a transducer lexicon.

Frequent words of the corpus are compiled, with their token ids, into a
minimal acyclic automaton (equal suffixes share states).  A word's number among
all words of the automaton falls out of the walk, and addresses its ids.  The
automaton is a flat file that every Python worker maps into memory; words that
it lacks are merged exactly, pair by pair, by the merge ranks.

The vocabulary file is one of the ``tokenizers`` library: byte-level BPE
with a word-end suffix, NFC and lower case, white space dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import give_back, small_batches
from .textops import text_buffers, text_slices

LEXICON_WORDS = 1 << 16
#: Entries of a worker's summary while it counts words.
SUMMARY = 1 << 15
#: Bytes of text whose words are held at once, as Python strings of some 15 bytes a byte.
SLICE = 1 << 18

def _class(*kinds: str) -> str:
    """Characters below U+0370 of these general categories, as ranges for ``re``."""
    return "".join(f"\\u{i:04x}" for i in range(0x370) if unicodedata.category(chr(i))[0] in kinds)


# Fixed by the vocabulary file's splitter; letters stand first as they are most
# frequent (no other branch begins with one).
_SPACE = "\\t-\\r \x85\xa0"
_LETTER, _NUMBER = _class("L"), _class("N")
_SPLIT = re.compile(f"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_SPLIT_ASCII = re.compile("[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\t-\\r a-z0-9]+")
#: Beyond this range, categories depend on the Unicode version; the library's own splitter decides there.
_BEYOND = re.compile("[^\\x00-\u036f]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_NEVER = 1 << 62  # no merge; after every rank
#: Bytes of a word that is merged by a heap of its own, and words merged together.
_LONG, _TOGETHER = 48, 4096


class Vocabulary:
    """Token ids and merge ranks of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        m = d["model"]
        if m["type"] != "BPE" or m.get("unk_token") or m.get("continuing_subword_prefix") or d.get("decoder"):
            raise ValueError(f"{path}: not a byte-level BPE vocabulary with word ends")
        ids: dict[str, int] = m["vocab"]
        suffix = m["end_of_word_suffix"]
        letters = _byte_letters()
        self.byte = {c: i for i, c in enumerate(letters)}
        self.path, self._library, self._merges = path, None, None
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([ids[c + suffix] for c in letters], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        for t in d["added_tokens"]:
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"):
                raise ValueError(f"{path}: added token {t['content']!r} is not matched as plain text")
        self.size = max(max(ids.values()), *self.special.values(), 0) + 1 if self.special else max(ids.values()) + 1
        self.token = [""] * self.size
        for t, i in (*ids.items(), *self.special.items()):
            self.token[i] = t
        # merges: sorted pairs, their ranks, and by rank what they make
        pairs = [p if isinstance(p, list) else p.split(" ") for p in m["merges"]]
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.argsort(key, kind="stable")
        self.pair, self.rank = key[rank], rank
        self.special_re = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    @property
    def library(self) -> Tokenizer:
        """The tokenizer itself, read only where its own splitter is needed."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word (its UTF-8 bytes, one at least), exactly as the ranks say."""
        return self.merge_many([word])[0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word; words of about the same length advance together,
        one merge each at a time (of the least rank, the leftmost of equal ones)."""
        out: list[list[int]] = [[]] * len(words)
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        short = order[:int(np.searchsorted(size[order], _LONG, side="right"))]
        for i in range(0, len(short), _TOGETHER):
            self._merge_rows([words[k] for k in short[i:i + _TOGETHER]], short[i:i + _TOGETHER], out)
        for k in order[len(short):]:
            w = np.frombuffer(words[k], np.uint8)
            out[k] = self._merge_long([*self.inner[w[:-1]].tolist(), int(self.last[w[-1]])])
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; _NEVER without a merge (or beyond a word, -1)."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        if not len(self.pair):
            return np.full(a.shape, _NEVER)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.rank[at], _NEVER)

    def _merge_rows(self, words: list[bytes], place: np.ndarray, out: list) -> None:
        size = np.array([len(w) for w in words])
        n, width = len(words), int(size.max())
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(n), size)
        ids = np.full((n, width), -1, dtype=np.int64)
        ids[row, np.arange(len(data)) - np.repeat(first, size)] = self.inner[data]
        ids[np.arange(n), size - 1] = self.last[data[first + size - 1]]
        rank = np.concatenate([self._rank(ids[:, :-1], ids[:, 1:]), np.full((n, 1), _NEVER)], axis=1)
        while n:
            at = rank.argmin(axis=1)
            best = rank[np.arange(n), at]
            go = best < _NEVER
            if not go.all():
                for k in np.flatnonzero(~go):
                    out[place[k]] = ids[k, :size[k]].tolist()
                ids, rank, size, place, at, best = ids[go], rank[go], size[go], place[go], at[go], best[go]
                n = len(ids)
                if not n:
                    break
            # every word left loses one piece: its merged pair's second, and the pair's rank
            rows, keep = np.arange(n), np.ones(ids.shape, bool)
            ids[rows, at] = self.made[best]
            keep[rows, at + 1] = False
            ids = ids[keep].reshape(n, -1)
            keep[rows, at + 1], keep[rows, at] = True, False
            rank = rank[keep].reshape(n, -1)
            size = size - 1
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = self._rank(ids[inner, at[inner] - 1], ids[inner, at[inner]])
            inner = np.flatnonzero(at + 1 < size)
            rank[inner, at[inner]] = self._rank(ids[inner, at[inner]], ids[inner, at[inner] + 1])

    @property
    def merges(self) -> dict:
        """{pair: (rank, what it makes)}, made only where a long word needs it."""
        if self._merges is None:
            a, b = np.divmod(self.pair, self.size)
            self._merges = dict(zip(zip(a.tolist(), b.tolist()), zip(self.rank.tolist(), self.made[self.rank].tolist())))
        return self._merges

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long words, with a heap of pairs: n log n."""
        merges, n = self.merges, len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def push(i: int) -> None:
            if (j := right[i]) >= 0 and (m := merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            if left[i] >= 0:
                push(left[i])
            push(i)
        return [x for x in ids if x >= 0]


def words_of(text: str, vocabulary: Vocabulary) -> list[str]:
    """Normalised words of a text without special tokens."""
    if text.isascii():
        return _SPLIT_ASCII.findall(text.lower())
    if not _BEYOND.search(text):
        text = unicodedata.normalize("NFC", text)
        if not _BEYOND.search(text):
            return _SPLIT.findall(text.lower())
    pieces = vocabulary.library.pre_tokenizer.pre_tokenize_str(vocabulary.library.normalizer.normalize_str(text))
    return [bytes(map(vocabulary.byte.__getitem__, p)).decode() for p, _ in pieces]


_WORKER: dict = {}


def _worker_vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    if path not in _WORKER:
        _WORKER[path] = Vocabulary(path)
    return _WORKER[path]


# ---------------------------------------------------------------------------
# The lexicon
# ---------------------------------------------------------------------------

def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words, with their ids, as one flat
    block of bytes.

    Words are added in sorted order; what can no longer change is replaced by
    an equal state that is already there.  Every arc holds the number of words
    that sort before those behind it, so the sum along a walk is the word's
    number, which addresses its ids.
    """
    words = sorted(entries)
    # a state: [is a word, {byte: state number}]; states of the last word's path are open
    register: dict = {}
    final: list[bool] = []
    arcs: list[tuple] = []
    path: list[list] = [[False, []]]  # [is a word, [(byte, state)]] from the root on

    def close(depth: int, word: bytes) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            key = (node[0], tuple(node[1]))
            if (s := register.get(key)) is None:
                s = register[key] = len(final)
                final.append(node[0])
                arcs.append(key[1])
            path[-1][1].append((word[len(path) - 1], s))

    last = b""
    for w in words:
        k = len(os.path.commonprefix([last, w]))
        close(k, last)
        path.extend([False, []] for _ in w[k:])
        path[-1][0] = True
        last = w
    close(0, last)
    final.append(path[0][0])
    arcs.append(tuple(path[0][1]))
    count = [0] * len(final)  # words behind a state; targets have smaller numbers
    first, label, target, skip = [0], bytearray(), [], []
    for s, out in enumerate(arcs):
        n = int(final[s])
        for b, t in out:
            label.append(b)
            target.append(t)
            skip.append(n)
            n += count[t]
        count[s] = n
        first.append(len(target))
    offsets, ids = [0], []
    for w in words:
        ids.extend(entries[w])
        offsets.append(len(ids))
    blocks = [struct.pack(f"<{len(x)}I", *x) for x in (first, target, skip, offsets, ids)]
    blocks += [bytes(label), bytes(final)]
    return struct.pack("<7I", *map(len, blocks)) + b"".join(blocks)


class Lexicon:
    """Reads a compiled lexicon from a mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        sizes, at, parts = struct.unpack("<7I", self._map[:28]), 28, []
        for n in sizes:
            parts.append(self._map[at:at + n])
            at += n
        first, self._target, self._skip, self._off, self._ids = (np.frombuffer(p, "<u4") for p in parts[:5])
        label, self._final = np.frombuffer(parts[5], np.uint8), np.frombuffer(parts[6], np.uint8)
        # arcs are sorted by state and byte
        self._arc = np.repeat(np.arange(len(first) - 1), np.diff(first)) * 256 + label
        self._root = len(self._final) - 1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the lexicon, -1 for words that it lacks; all
        words walk the automaton together, a byte at a time."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        state, number = np.full(len(words), self._root), np.zeros(len(words), np.int64)
        live = np.arange(len(words)) if len(self._arc) else np.zeros(0, np.int64)
        if not len(self._arc):
            state[size > 0] = -1
        for k in range(int(size.max(initial=0))):
            live = live[size[live] > k]
            if not len(live):
                break
            key = state[live] * 256 + data[first[live] + k]
            at = np.minimum(np.searchsorted(self._arc, key), len(self._arc) - 1)
            ok = self._arc[at] == key
            state[live[~ok]] = -1
            live, at = live[ok], at[ok]
            number[live] += self._skip[at]
            state[live] = self._target[at]
        return np.where((state >= 0) & (self._final[state] != 0), number, -1)

    def ids(self, number: int) -> list[int]:
        return self._ids[self._off[number]:self._off[number + 1]].tolist()

    def get(self, word: bytes) -> list[int] | None:
        n = int(self.numbers([word])[0])
        return None if n < 0 else self.ids(n)

    def __len__(self) -> int:
        return len(self._off) - 1


def frequent_words(docs: DataFrame, vocabulary: str, text_col: str, k: int = LEXICON_WORDS) -> list[str]:
    """The k words found most often over all whole texts (ties by name), from
    one bounded summary per task (a word that makes up more than 1 in SUMMARY
    words of a task's texts is in it); at most k rows come to the driver."""
    def summarise(batches):
        v = _worker_vocabulary(vocabulary)
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    seen.update(words_of(x, v))
            if len(seen) > 4 * SUMMARY:  # keep the larger counts, less what each dropped one may have had
                least = sorted(seen.values(), reverse=True)[SUMMARY]
                seen = Counter({w: c - least for w, c in seen.items() if c > least})
        kept = seen.most_common(SUMMARY)
        del seen, v
        _WORKER.clear()
        give_back()
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([c for _, c in kept], pa.int64())], ["word", "n"])

    small_batches(docs.sparkSession)
    found = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(summarise, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in found.orderBy(F.desc("n"), "word").limit(k).collect()]


# ---------------------------------------------------------------------------
# Encoding and decoding
# ---------------------------------------------------------------------------

class Encoder(dict):
    """(ids, tokens) of words as text.  Words of the lexicon stay once met; others
    are merged for each batch of texts and go with it."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def fill(self, words: list[str]) -> list[str]:
        """Take in distinct words that are not there yet; those that the lexicon lacks."""
        v, b = self.vocabulary, [w.encode("utf-8", "surrogatepass") for w in words]
        number = self.lexicon.numbers(b).tolist()
        unseen = iter(v.merge_many([x for x, n in zip(b, number) if n < 0]))
        for w, n in zip(words, number):
            ids = self.lexicon.ids(n) if n >= 0 else next(unseen)
            self[w] = (" ".join(map(str, ids)), " ".join([v.token[i] for i in ids]))
        return [w for w, n in zip(words, number) if n < 0]

    def _words(self, text: str | None) -> list[str]:
        """Keys of a text's words; a special token's key is its text after \\0."""
        if not text:
            return []
        v = self.vocabulary
        if v.special_re is None or not v.special_re.search(text):
            return words_of(text, v)
        out = []
        for piece in v.special_re.split(text):
            if piece in v.special:
                out.append("\0" + piece)
                self["\0" + piece] = (str(v.special[piece]), piece)
            else:
                out.extend(words_of(piece, v))
        return out

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """(ids joined by a space, the decoded text: tokens joined by a space) of each text."""
        words = [self._words(t) for t in texts]
        passing = self.fill([w for w in set().union(*words) if w not in self])
        for own in words:
            found = list(map(self.__getitem__, own))
            yield " ".join([p[0] for p in found]), " ".join([p[1] for p in found])
        for w in passing:
            del self[w]

    def encode(self, text: str | None) -> tuple[str, str]:
        return next(self.encode_all([text]))


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text that the vocabulary's file defines for ids (special tokens kept)."""
    return " ".join(vocabulary.token[i] for i in ids)


def _worker_encoder(path: str, blob: bytes) -> Encoder:
    """One encoder per Python worker; its lexicon is a mapped file in the
    worker's own temporary folder, made anew from the broadcast wherever needed."""
    key = (path, hashlib.sha256(blob).hexdigest())
    if key not in _WORKER:
        for old in [k for k in _WORKER if isinstance(k, tuple)]:
            del _WORKER[old]
        fd, name = tempfile.mkstemp(suffix=".lexicon")
        with os.fdopen(fd, "wb") as f:
            f.write(blob)
        _WORKER[key] = Encoder(_worker_vocabulary(path), Lexicon(name))
        os.unlink(name)  # the mapping stays
    return _WORKER[key]


def build_lexicon(docs: DataFrame, vocabulary: str, text_col: str = "text", k: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the corpus's k most frequent words."""
    v = Vocabulary(vocabulary)
    words = [w.encode("utf-8", "surrogatepass") for w in frequent_words(docs, vocabulary, text_col, k)]
    return compile_lexicon(dict(zip(words, v.merge_many(words))))


#: What ``bpe_encode`` can add to a row.
RESULTS = {"n_tokens": "bigint", "ids_text": "string", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string", "ids": "array<int>"}


def bpe_encode(docs: DataFrame, vocabulary: str, lexicon: bytes, text_col: str = "text", results: tuple[str, ...] = tuple(RESULTS)) -> DataFrame:
    """Add ``results`` to every row: n_tokens, ids_text (decimal ids joined by a
    space), decoded, their SHA-256 (ids_sha256, decoded_sha256) and the array ids.

    Null and empty texts have no tokens, and empty ids and decoded texts.
    Strings of special tokens become those tokens.  Whole texts are encoded;
    the lexicon changes the speed only, never the ids.  Rows are independent,
    an empty table gives an empty one, input columns stay whatever their names
    (those named like a result are replaced).  No shuffle; the broadcast lexicon
    holds a bounded number of words.  Only the results asked for leave the worker.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    make = {"n_tokens": lambda i, d: i.count(" ") + 1 if i else 0, "ids_text": lambda i, d: i, "ids_sha256": lambda i, d: sha(i),
            "decoded": lambda i, d: d, "decoded_sha256": lambda i, d: sha(d), "ids": lambda i, d: np.fromstring(i, np.int32, sep=" ") if i else np.zeros(0, np.int32)}
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def encode(batches):
        enc = _worker_encoder(vocabulary, shared.value)
        for text in batches:
            _, off = text_buffers(text)
            parts = []
            for i, j in text_slices(off, SLICE):
                rows = list(enc.encode_all(text.slice(i, j - i).to_pylist()))
                parts.append(pa.StructArray.from_arrays([pa.array([make[c](*r) for r in rows], kinds.get(c, pa.string())) for c in results], list(results)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(c, kinds.get(c, pa.string())) for c in results]))
        del enc
        _WORKER.clear()  # the worker lives on; its memory goes back after every task
        give_back()

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(encode, "struct<" + ",".join(f"{c}:{RESULTS[c]}" for c in results) + ">")
    keep = [c for c in docs.columns if c not in RESULTS]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), udf(F.col(f"`{text_col}`")).alias("out"))
    return held.select(*[F.col("row")[c].alias(c) for c in keep], *[F.col("out")[c].alias(c) for c in results])
