"""Byte-level BPE encoding and decoding by depth-first traversal of a word trie.

BPE of a string has one property that makes prefixes shareable: the encoding of a
prefix followed by its last token determines everything before. For the prefix
that ends at byte n, exactly one vocabulary token t that is a suffix of it can be
its last token: the one whose left neighbour, the last token of the prefix that
ends where t begins, would not be merged across the border. So each trie node
needs one state, its last token, computed from the states of its ancestors.

The distinct words (pre-tokens) of a block of texts are put in byte order, which
is the depth-first order of their trie; only the states along the current path
are held, and a word starts from the states of the prefix it shares with the word
before. Encodings found are kept by word for the following blocks and tasks of a
Python worker in two generations of bounded size; the oldest go first, and a word
that comes again is encoded again, with the same result.

The vocabulary file is a parameter; nothing of it is stored here.

Defined results: null text is empty and has no ids; the text of a special token
becomes its id; equal rows give equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ordersight.llm.common import ship, slices

#: Fixed value: the word pattern of the public byte-level vocabularies.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def printable_bytes() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, data: dict):
        letters = printable_bytes()
        raw = lambda s: bytes(letters[c] for c in s)
        model = data["model"]
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        self.bytes = {i: token for token, i in self.ids.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, merged token
        self.parts: dict[int, tuple[int, int, int]] = {}  # merged token -> rank, left, right
        for rank, merge in enumerate(model["merges"]):
            left, right = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            a, b, ab = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = (rank, ab)
            self.parts.setdefault(ab, (rank, a, b))
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", []) if t["special"]}
        self.longest = max(map(len, self.ids))
        self.bytes |= {i: text.encode() for text, i in self.special.items()}
        self.valid: dict[tuple[int, int], bool] = {}

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of ``a`` then ``b`` gives these two tokens: no merge across the border comes before those that build them.

        Undo the later of the two tokens' merges again and again; at each border
        seen on the way, a merge of the pair there must not be ranked below the
        merge that was undone last.
        """
        known = self.valid.get((a, b))
        if known is not None:
            return known
        left, right, bound, ok = a, b, 1 << 60, True
        while True:
            across = self.rank.get((left, right))
            if across is not None and across[0] < bound:
                ok = False
                break
            of_left, of_right = self.parts.get(left), self.parts.get(right)
            if of_left is None and of_right is None:
                break
            if of_right is None or (of_left is not None and of_left[0] > of_right[0]):
                bound, left = of_left[0], of_left[2]
            else:  # of equal merges the left one is done first, so an equal rank across the border wins over the right token
                bound, right = of_right[0] + 1, of_right[1]
        if len(self.valid) > 400_000:
            self.valid.clear()
        self.valid[a, b] = ok
        return ok


class TrieEncoder:
    """Encodes distinct words in the depth-first order of their trie."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        token_of, known, longest = self.v.ids.get, self.v.valid.get, self.v.longest
        path, last, size = b"", [], []  # along the path: last token of each prefix and its length in bytes
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared:], size[shared:]
            for end in range(shared + 1, len(word) + 1):
                for begin in range(max(0, end - longest), end):
                    token = token_of(word[begin:end])
                    if token is None:
                        continue
                    if begin == 0:
                        break
                    fits = known((last[begin - 1], token))
                    if self.v.stay_apart(last[begin - 1], token) if fits is None else fits:
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(token)
                size.append(end - begin)
            path, out, end = word, [], len(word)
            while end:
                out.append(last[end - 1])
                end -= size[end - 1]
            yield word, out[::-1]


class Codec:
    """Encodes and decodes texts; ids are handled as their decimal strings joined by commas."""

    def __init__(self, vocabulary: Vocabulary, store_bytes: int = 20 << 20):
        self.v, self.trie, self.store_bytes = vocabulary, TrieEncoder(vocabulary), store_bytes
        self.find = regex.compile(WORD).findall
        self.token = {str(i): b for i, b in vocabulary.bytes.items()}
        self.known: dict[str, str] = {}  # words met lately; a full store becomes the older one
        self.older: dict[str, str] = {}
        self.held = 0
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split \
            if vocabulary.special else lambda text: [text]

    def encode_block(self, texts: list[str]) -> list[str]:
        """Ids of each text as a decimal list."""
        cut = [[(part, None) if part in self.v.special else (part, self.find(part)) for part in self.split(text) if part] for text in texts]
        if self.held > self.store_bytes:
            self.known, self.older, self.held = {}, self.known, 0
        words = set().union(*[words for parts in cut for _, words in parts if words is not None]) - self.known.keys()
        names = {}
        for w in words:
            text = self.older.get(w)
            if text is None:
                names[w.encode("utf-8", "replace")] = w
            else:
                self._keep(w, text)
        for word, ids in self.trie.encode_words(names):
            self._keep(names[word], ",".join(map(str, ids)))
        known = self.known
        return [",".join([str(self.v.special[part]) if words is None else ",".join([known[w] for w in words])
                          for part, words in parts]) for parts in cut]

    def _keep(self, word: str, text: str) -> None:
        self.known[word] = text
        self.held += len(text) + len(word) + 200

    def decode(self, ids: str) -> str:
        token = self.token
        return b"".join([token[i] for i in ids.split(",")]).decode("utf-8", "replace") if ids else ""


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


#: Bytes of text that a worker cuts into words at a time: each word is a Python string of five to ten times its bytes.
BLOCK = 1 << 20

_CODECS: dict[str, Codec] = {}  # of this Python worker, by digest of the vocabulary


def _shared(df: DataFrame, path: str):
    """The vocabulary for the tasks: read by the driver, a file of one or two megabytes."""
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(vocabulary_text(path))


def _codec(shared) -> Codec:
    text = shared.value
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(Vocabulary(json.loads(text)))
    return _CODECS[name]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in slices(batches, "text", BLOCK):
        yield batch, [t or "" for t in batch.column("text").to_pylist()]


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row: ids as decimals joined by commas, decoded from these ids."""
    shared = _shared(docs, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        for batch, texts in _texts(batches):
            ids = codec.encode_block(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()),
                 pa.array([sha(x) for x in ids], pa.string()), pa.array([sha(codec.decode(x)) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
                .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id`` and the ``ids`` (array of int) of each row's text."""
    shared = _shared(docs, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch, texts in _texts(batches):
            ids = codec.encode_block(texts)
            flat = [np.array(x.split(","), np.int32) if x else np.zeros(0, np.int32) for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])
    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
                .mapInArrow(run, "doc_id long, ids array<int>"))


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id`` and the ``text`` of each row's ``ids`` (null: empty), special tokens included."""
    shared = _shared(encoded, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = [codec.decode(",".join(map(str, ids or []))) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select(encoded["doc_id"], F.col("ids")).mapInArrow(run, "doc_id long, text string")
