"""Byte-level BPE encoding and decoding with numpy merge rounds.

A text is cut into words by character class, as the byte-level pre-tokenizer does. The distinct words of a batch that
aren't known yet lie in one flat array of symbols; each round finds every word's lowest-ranked adjacent pair by binary
search over the sorted pair keys and merges it wherever it stands in that word. Nothing here is trained: vocabulary and
merges come from a tokenizer file whose path is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitrail.llm.common import map_batches, text_bytes

#: Distinct words remembered by a task.
CACHE_WORDS = 60_000
#: Characters cut into words in one go; one longer text is cut alone.
PIECE_CHARS = 1 << 18

LETTER, NUMBER, OTHER, SPACE = range(4)
#: The white space of the Unicode standard, and the contractions of the pre-tokenizer's pattern.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def character_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            kinds[code] = LETTER
        elif kind == "N":
            kinds[code] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


class ByteBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of_char = byte_characters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(of_char[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.size = size
        self.of_byte = np.array([vocab[c] for c, _ in sorted(of_char.items(), key=lambda x: x[1])], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        kind = np.uint32 if size <= 1 << 16 else np.int64  # of a key of two symbols
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], kind)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], kind)
        self.of_byte = self.of_byte.astype(kind)
        left, right = np.divmod(np.arange(1 << 16), 256)
        self.byte_ranks = self._rank(self.of_byte[left], self.of_byte[right]) if pairs else np.zeros(1 << 16, np.int32)
        self.kinds = character_classes()
        self.splitter = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def word_starts(self, text: str, breaks: np.ndarray) -> np.ndarray:
        """Where words start in joined texts; ``breaks`` are the places where a text starts."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        kind = self.kinds[codes]
        first = np.zeros(n + 1, bool)
        first[breaks] = True
        first[n] = True
        start = first.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # the last white space before a word: a plain space belongs to the word, another one stands alone
        before = np.flatnonzero(~first[1:n] & (kind[:-1] == SPACE) & (kind[1:] != SPACE))
        start[before] = True
        start[before[codes[before] == 0x20] + 1] = False
        # contractions begin with an apostrophe that starts a word
        for a in np.flatnonzero((codes == 0x27) & start[:n]):
            for tail in CONTRACTIONS:
                end = a + 1 + len(tail)
                if end <= n and text[a + 1 : end] == tail and not first[a + 1 : end].any():
                    start[a + 1 : end] = False
                    start[end] = True
                    break
        return np.flatnonzero(start)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; the number of merges for one that doesn't merge."""
        key = left * self.keys.dtype.type(self.size) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(len(self.ranks)))

    def merge(self, words: list[bytes]) -> tuple[bytes, list[int]]:
        """The words' token ids, joined, and the bytes of ids up to each word and its end.

        Ranks of pairs of bytes were searched when the file was read; then only pairs that a merge has changed are searched for.
        """
        if not words:
            return b"", [0]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        octets = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.of_byte[octets]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        none = np.int32(len(self.ranks))
        rank = np.full(len(symbols), none)  # of the pair that begins here
        if none and len(symbols) > 1:
            of_bytes = self.byte_ranks[octets[:-1].astype(np.uint16) << np.uint16(8) | octets[1:]]
            rank[:-1] = np.where(owner[:-1] == owner[1:], of_bytes, none)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(owner))))
            finished = least == none
            if finished.any():
                done.append((owner[finished], symbols[finished]))
                going = ~finished
                symbols, owner, rank, least = symbols[going], owner[going], rank[going], least[going]
                if not len(symbols):
                    break
            places = np.flatnonzero(rank == least)
            # of overlapping pairs (the same symbol again and again) every second one merges
            run = np.flatnonzero(np.append(True, np.diff(places) > 1))
            in_run = np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))
            places = places[in_run % 2 == 0]
            symbols[places] = self.merged[rank[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            places -= np.arange(len(places))
            changed = np.concatenate([places, places[places > 0] - 1])
            inside = changed < len(symbols) - 1
            rank[changed[~inside]] = none
            changed = changed[inside]
            same = owner[changed] == owner[changed + 1]
            rank[changed[~same]] = none
            changed = changed[same]
            rank[changed] = self._rank(symbols[changed], symbols[changed + 1])
        owner, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        counts = np.bincount(owner, minlength=len(words))
        return symbols[np.argsort(owner, kind="stable")].astype("<u4").tobytes(), np.append(0, 4 * np.cumsum(counts)).tolist()

    def _learn(self, words: list[str]) -> None:
        ids, bounds = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        self.cache.update(zip(words, (ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers; special tokens in a text are their ids."""
        pieces: list[str | int] = []
        counts = []
        for text in texts:
            parts = [p for p in (self.splitter.split(text) if self.splitter else [text]) if p]
            pieces += [self.special.get(p, p) for p in parts]
            counts.append(len(parts))
        encoded = self._encode_pieces(pieces)
        out, at = [], 0
        for n in counts:
            out.append(b"".join(encoded[at : at + n]))
            at += n
        return out

    def _encode_pieces(self, pieces: list[str | int]) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for piece in [*pieces, None]:
            if group and (piece is None or isinstance(piece, int) or size + len(piece) > PIECE_CHARS):
                out += self._encode_group(group)
                group, size = [], 0
            if isinstance(piece, int):
                out.append(piece.to_bytes(4, "little"))
            elif piece is not None:
                group.append(piece)
                size += len(piece)
        return out

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        breaks = np.cumsum([0, *map(len, texts)])
        starts = self.word_starts(joined, breaks[:-1])
        bounds = starts.tolist()
        words = [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        ids = list(map(self.cache.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            self._learn(list(dict.fromkeys([words[i] for i in missing])))
            for i in missing:
                ids[i] = self.cache[words[i]]
            if len(self.cache) > CACHE_WORDS:  # the words of this group stay
                self.cache = dict(zip(words, ids, strict=True))
        first = np.searchsorted(starts, breaks)
        return [b"".join(ids[first[i] : first[i + 1]]) for i in range(len(texts))]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, invalid UTF-8 replaced."""
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace").encode()


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _texts(column: pa.Array):
    """Lists of decoded texts with about a megabyte each."""
    group, size = [], 0
    for value in column:
        data = value.as_py() or b""
        group.append(data.decode("utf-8", "replace"))
        size += len(data)
        if size >= 1 << 20:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>), a row for each row of ``docs``. Null and empty texts have no tokens. No shuffle."""

    def work(batch):
        bpe = tokenizer(path)
        at = 0
        for texts in _texts(batch.column(1)):
            found = bpe.encode(texts)
            sizes = np.array([len(x) // 4 for x in found], np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sizes.astype(np.int64)), ids], ["doc_id", "n_tokens", "ids"])
            at += len(texts)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return map_batches(rows, work, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null ids give an empty text."""

    def work(batch):
        bpe = tokenizer(path)
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()).decode() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", F.col(ids).cast("array<int>").alias("ids")), work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text decoded from them, in one pass."""

    def work(batch):
        bpe = tokenizer(path)
        counts, ids, decoded = [], [], []
        for texts in _texts(batch.column(1)):
            for found in bpe.encode(texts):
                counts.append(len(found) // 4)
                ids.append(hashlib.sha256(found).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(found)).hexdigest())
        arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return map_batches(rows, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
