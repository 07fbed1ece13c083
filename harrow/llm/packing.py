"""Packing documents into training sequences by vector best fit.

A document is its token ids and a closing id 0; only documents longer than a sequence
are cut. Every sequence has three capacities: tokens, documents, and attention cost
(the sum of squared piece lengths). Pieces, longest first, go to the open sequence
that fits under every capacity and is best by the chosen rule: the least weighted norm
of what would be left (`norm`), or the greatest weighted dot product of the piece with
what is left (`dot`). If none fits, a sequence is opened.

Pieces are dealt by a hash into groups of some 20,000, each packed by one task: a
group's last sequences are all that is not filled, whatever the size of the input.
Pieces of a full sequence's length take one each.

NULL text is an empty document (one token, the closing id). Rows without doc_id and
repeated rows are packed like any other.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import in_byte_slices
from harrow.session import stored

SEQUENCE_TOKENS = 2048
GROUP_PIECES = 20_000
WEIGHTS = (1.0, 0.01, 0.01)
MEMO_BYTES = 64_000_000
WORD_BYTES = 150  # of a remembered word beside its letters and ids
LONG_WORD = 64
HELD_BYTES = 1_000_000
_CLOSING = np.uint32(0).tobytes()

# What the tokenizer makes of plain Latin text: lower case, then these words. The blank-free
# chunks of a text with other characters, or a special token's opening, go to it as they are.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*\Z")
_WORDS = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[!-/:-@\[-`{-~]+")
# Byte-level vocabularies write bytes that have no sign of their own as characters from 256 on.
_OWN_SIGN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = dict(zip((byte for byte in range(256) if byte not in _OWN_SIGN), range(256, 512)))
# Where a tokenizer gives these other ids than its merges do, its own rules are followed throughout.
_TRIED = ["the", "straße", "éàü", "7", "'s", "?!", "x" * 40, "ñandú"]


class WordTokens:
    """Ids, as little-endian bytes, of texts; words that come again are remembered, up to some bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism here
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.direct = self._of_words(_TRIED) == self._encoded(_TRIED)

    def _encoded(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [struct.pack(f"<{len(one.ids)}I", *one.ids) for one in found]

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of what `_WORDS` finds, straight from the merges, behind which are no further rules."""
        made = []
        for word in words:
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = [token.id for token in self.model.tokenize(word)]
            made.append(struct.pack(f"<{len(ids)}I", *ids))
        return made

    def _learned(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that are not known, which are known from here on but for long ones."""
        if self.held > MEMO_BYTES // 2:
            self.older, self.known, self.held = self.known, {}, 0
        found = {word: self.older[word] for word in words.intersection(self.older)}
        new = words.difference(found)
        plain = [word for word in new if _WORDS.fullmatch(word)] if self.direct else []
        other = list(new.difference(plain))
        found |= zip(plain, self._of_words(plain))
        found |= zip(other, self._encoded(other))
        kept = {word: ids for word, ids in found.items() if len(word) <= LONG_WORD}
        self.known |= kept
        self.held += sum(map(len, kept)) + sum(map(len, kept.values())) + len(kept) * WORD_BYTES
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of a few texts; what is new in them goes to the tokenizer in one call."""
        split, missing = [], set()
        for text in texts:
            if _PLAIN.match(text) and "<|" not in text:
                words = _WORDS.findall(text.lower())
            else:
                words = text.replace("\n", " ").split(" ")
            found = list(map(self.known.get, words))
            holes = [(at, words[at]) for at, ids in enumerate(found) if ids is None]
            missing.update([word for _, word in holes])
            split.append((found, holes))
        new = self._learned(missing) if missing else {}
        for found, holes in split:
            for at, word in holes:
                found[at] = new[word]
        return [b"".join(found) for found, _ in split]


@lru_cache(maxsize=2)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _cutter(path: str, most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in in_byte_slices(batches, 1, HELD_BYTES):
            rows = []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, found in zip(batch.column(0).to_pylist(), tokens.ids(texts)):
                ids = found + _CLOSING
                for piece, start in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[start:start + 4 * most]
                    rows.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
    return cut


def pieces(documents: DataFrame, path: str, most: int = SEQUENCE_TOKENS) -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32)`; `path`: the tokenizer's file, on every machine."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(
        _cutter(path, most), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class VectorBestFit:
    """Open sequences, in order, and what is left of their three capacities, as shares."""

    def __init__(self, tokens: int, documents: int, attention: int, rule: str, weights=WEIGHTS):
        self.capacity = np.array([tokens, documents, attention], np.float64)
        self.rule = rule
        self.weights = weights
        self.left = np.empty((3, 256))  # by capacity, of the first `open` columns
        self.number = np.empty(256, np.int64)
        self.open = 0
        self.used: list[int] = []

    def _need(self, length: int) -> list[float]:
        return [length / self.capacity[0], 1 / self.capacity[1], length * length / self.capacity[2]]

    def _best(self, need: list[float]) -> int | None:
        """The column of the first best sequence that the piece fits into."""
        if not self.open:
            return None
        cost, fits = 0.0, None
        for left, own, weight in zip(self.left[:, :self.open], need, self.weights):
            after = left - own
            fits = after > -1e-9 if fits is None else fits & (after > -1e-9)
            cost = cost + (weight * after * after if self.rule == "norm" else -weight * own * left)
        at = int(np.argmin(np.where(fits, cost, np.inf)))
        return at if fits[at] else None

    def place(self, length: int) -> tuple[int, int]:
        """`(sequence, offset)` of a piece."""
        need = self._need(length)
        at = self._best(need)
        if at is None:
            at = self._new()
        sequence = int(self.number[at])
        offset = self.used[sequence]
        self.left[:, at] -= need
        self.used[sequence] += length
        return sequence, offset

    def _new(self) -> int:
        if self.open == self.left.shape[1]:
            self.left = np.concatenate([self.left, np.empty_like(self.left)], axis=1)
            self.number = np.concatenate([self.number, np.empty_like(self.number)])
        self.left[:, self.open] = 1.0
        self.number[self.open] = len(self.used)
        self.used.append(0)
        self.open += 1
        return self.open - 1

    def close_below(self, shortest: int) -> None:
        """Leave out sequences that not even the shortest piece to come fits into."""
        left = self.left[:, :self.open]
        stay = np.flatnonzero((left - np.array(self._need(shortest))[:, None] > -1e-9).all(axis=0))
        self.left[:, :len(stay)], self.number[:len(stay)] = left[:, stay], self.number[stay]
        self.open = len(stay)


def _packer(tokens: int, documents: int, attention: int, rule: str):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        lengths = pdf["length"].tolist()
        bins = VectorBestFit(tokens, documents, attention, rule)
        placed = []
        for number, length in enumerate(lengths):
            if number % 256 == 0:
                bins.close_below(lengths[-1])
            placed.append(bins.place(length))
        group = int(pdf["_group"].iloc[0])
        out = pdf.drop(columns="_group")
        out["sequence_id"] = [(group << 32) + sequence for sequence, _ in placed]
        out["offset"] = [offset for _, offset in placed]
        return out
    return pack


def pack(
    documents: DataFrame,
    path: str,
    tokens: int = SEQUENCE_TOKENS,
    max_documents: int | None = None,
    max_attention: int | None = None,
    rule: str = "norm",
) -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32, sequence_id, offset)` of every piece.

    Without a bound on documents or attention those capacities never bind.
    """
    attention = max_attention or tokens * tokens
    most = min(tokens, int(attention ** 0.5))
    rows = stored(pieces(documents, path, most), "pieces")
    groups = max(1, -(-rows.count() // GROUP_PIECES))
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(
        _packer(tokens, max_documents or tokens, attention, rule),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
