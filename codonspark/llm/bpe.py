"""BPE encoding and decoding with a public tokenizer's vocabulary, for BPE models with ends of words.

Encoding finds exact merges in linear time without merging: an Aho-Corasick automaton over the vocabulary gives the longest
token at each place; a token may follow another only if merging their characters would leave the border between them in
place (the pairs' compatibility, kept in a table once computed); where no token fits, the last one is exchanged for its
next shorter prefix. Decoding cuts tokens out of one string by a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import releasing, small_batches, text_or_empty

#: Unicode's White_Space, which the pre-tokenizer's \\s stands for.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Distinct stretches of text whose tokens a worker remembers; memory stays bounded whatever the corpus has.
REMEMBERED = 200_000
#: Bytes of stretches, ids and decoded texts in a generation, and the longest stretch that is remembered.
REMEMBERED_BYTES, LONG = 16 << 20, 200
OUT_ROWS = 500


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for byte in range(256):
        if byte in plain:
            out[byte] = chr(byte)
        else:
            out[byte], spare = chr(spare), spare + 1
    return out


class Tokenizer:
    """Encoder and decoder of one vocabulary file (the JSON of a BPE model with ``end_of_word_suffix``)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace("\\s", WHITE))
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        # symbols: bytes inside a word, and, from 256 on, bytes that end one
        symbol = {c: chr(k) for k, c in enumerate(letters)}
        self.inner = [chr(k) for k in range(256)]
        spelled: dict[int, str] = {}
        for token, k in vocab.items():
            end = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            body = token[: -len(self.suffix)] if end else token
            if all(c in symbol for c in body):
                text = "".join(symbol[c] for c in body)
                spelled[k] = text[:-1] + chr(ord(text[-1]) + 256) if end else text
        #: merged token -> its two parts; rank: when the merge is made, base symbols before all.
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {k: -1 for k in spelled}
        self.pair: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair[a, b] = whole
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (a, b), rank
        self.spelled, self.of = spelled, {text: k for k, text in spelled.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        # only tokens that merging their own symbols gives can stand in a result
        usable = [k for k in sorted(spelled, key=lambda k: self.rank[k]) if k not in self.parts or self.border(*self.parts[k], self.rank[k])]
        self.usable = set(usable)
        self.automaton = ahocorasick.Automaton()
        for k in usable:
            self.automaton.add_word(spelled[k][::-1], k)
        self.automaton.make_automaton()
        self.size = {k: len(text) for k, text in spelled.items()}
        self.shorter = {k: self._prefix(spelled[k]) for k in usable}
        # the offset table: token k stands at blob[offsets[k]:offsets[k + 1]]
        text = {k: t for t, k in vocab.items()} | {k: t for t, k in self.added.items()}
        self.offsets, parts, at = [0], [], 0
        for k in range(max(text) + 1):
            parts.append(text.get(k, ""))
            at += len(parts[-1])
            self.offsets.append(at)
        self.blob = "".join(parts)

    def _prefix(self, text: str) -> int:
        """The longest usable token that is a proper prefix, -1 if none is."""
        for n in range(len(text) - 1, 0, -1):
            if self.of.get(text[:n], -1) in self.usable:
                return self.of[text[:n]]
        return -1

    def border(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether merging the symbols of two tokens keeps them apart until rank ``before``.

        Both are taken to pieces from the latest merge on, as they stood at that time; a merge over the border that comes
        before the next piece is put together would have joined them.
        """
        rank, parts = self.rank, self.parts
        until = before
        while True:
            joined = self.pair.get((left, right))
            if joined is not None and rank[joined] < until:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            # the side whose merge came later is opened; of two equal merges the left one was made first
            if rank[left] > rank[right]:
                # before its merge at this rank, the left token's right part stood at the border
                until, left = min(until, rank[left]), parts[left][1]
            else:
                # a merge over the border of the same rank would have come first, as it starts further left
                until, right = min(until, rank[right] + 0.5), parts[right][0]

    def _fits(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            found = self.fits[key] = self.border(left, right)
        return found

    def word(self, data: bytes) -> list[int]:
        """Token ids of one word of the pre-tokenizer, given in UTF-8."""
        text = data[:-1].decode("latin-1") + chr(data[-1] + (256 if self.suffix else 0))
        n, size, shorter, fits = len(text), self.size, self.shorter, self.fits
        # the automaton runs over the reversed word: tokens that start at a place end there, the longest comes first
        longest, last = [-1] * (n + 1), -1
        for end, k in self.automaton.iter(text[::-1]):
            if end != last:
                longest[n - 1 - end], last = k, end
        out: list[int] = []
        dead: set[int] = set()
        at, token, left = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + size[token]
                if end not in dead:
                    if left < 0:
                        break
                    good = fits.get((left, token))
                    if good or good is None and self._fits(left, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, left, token = end, token, longest[end]
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]
                left, token = out[-1] if out else -1, shorter[token]
        return out

    def encode(self, text: str) -> list[int]:
        """Token ids of a text, added tokens included where their strings stand in it."""
        out: list[int] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.added[part])
                continue
            if part.isascii():
                part = part.lower()
            else:  # letters are lowered one by one: a capital sigma has no final form here
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for word in [part] if part.isascii() and part.isalpha() else self.words.findall(part):
                out += self.word(word.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, one space between them: the vocabulary has no decoder of its own."""
        blob, at = self.blob, self.offsets
        return " ".join([blob[at[k]:at[k + 1]] for k in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class Memo(dict):
    """Stretches without ASCII white space -> their ids; ``decoded`` has the same of the decoded ids; both as joined bytes.

    No token spans such white space, so that a text's ids are those of its stretches. When REMEMBERED stretches or REMEMBERED_BYTES
    of them are known, they become the older generation, from which those still met are taken over. Stretches over LONG bytes, as
    texts without blanks have, are forgotten with their text.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tok, self.decoded, self.older, self.empty = tokenizer(path), {}, ({}, {}), set()
        self.held, self.long, self.special = 0, [], [a.encode() for a in self.tok.added]

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk in self.older[0]:
            ids, text = self.older[0][chunk], self.older[1][chunk]
        else:
            found = self.tok.encode(chunk.decode())
            ids, text = " ".join(map(str, found)).encode(), self.tok.decode(found).encode()
        self[chunk], self.decoded[chunk] = ids, text
        self.held += len(chunk) + len(ids) + len(text)
        if len(chunk) > LONG:
            self.long.append(chunk)
        if not ids:
            self.empty.add(chunk)
        return ids

    def text(self, data: bytes) -> tuple[bytes, bytes]:
        """(ids, decoded text) of a whole text in UTF-8, each joined by spaces."""
        for chunk in self.long:  # of the text before
            self.held -= len(chunk) + len(self.pop(chunk)) + len(self.decoded.pop(chunk))
            self.empty.discard(chunk)
        self.long = []
        if len(self) >= REMEMBERED or self.held >= REMEMBERED_BYTES:
            self.older = dict(self), self.decoded
            self.clear()
            self.decoded, self.empty, self.held = {}, set(), 0
        # the strings of added tokens count as they are written, all else is lowered anyway
        chunks = data.split() if any(a in data for a in self.special) else data.lower().split()
        ids = b" ".join(map(self.__getitem__, chunks))
        if self.empty and not self.empty.isdisjoint(chunks):
            chunks = [c for c in chunks if self[c]]
            ids = b" ".join(map(self.__getitem__, chunks))
        return ids, b" ".join(map(self.decoded.__getitem__, chunks))


@lru_cache(maxsize=1)
def memo_of(path: str) -> Memo:
    """The worker's memo, which the tasks that follow each other in it share."""
    return Memo(path)


def encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of its text as array<int>. A null text has no tokens; a column ``out_col`` is replaced."""
    small_batches(df.sparkSession)
    df = df.drop(out_col)
    where = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                ids = [np.fromstring(memo.text((t.as_py() or "").encode())[0], np.int32, sep=" ") for t in batch.column(where)]
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out_col])

    return df.mapInArrow(releasing(run), T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids; null ids give the empty text. A column ``out_col`` is replaced."""
    df = df.drop(out_col)
    where = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [tokenizer(path).decode(ids or []) for ids in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return df.mapInArrow(releasing(run), T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the ids, joined by spaces, and of the decoded text.

    The same as encode() then decode(), without carrying ids or texts out of the task. A null text counts as empty.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sha = memo_of(path), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for data in batch.column(1):
                ids, text = memo.text(data.as_py())
                n.append(ids.count(b" ") + bool(ids))
                a.append(sha(ids).hexdigest())
                b.append(sha(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(releasing(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
