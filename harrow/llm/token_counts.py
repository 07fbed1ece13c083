"""Word-piece counts by a linear longest-match automaton.

A text's words (between ASCII white space), each behind the word mark, are cut
greedily into the longest vocabulary pieces. The automaton is a trie with failure
links: where no longer match exists, the pieces that the matched part is sure to be
cut into are popped, and the link leads to the node of what is left. Only the number
of popped pieces is kept per node, so a word is counted in one pass over its
characters and no piece is ever built. A character no piece starts with counts as
its UTF-8 bytes, as byte-fallback vocabularies do.

NULL and blank texts count 0. Rows keep their order and number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import Memo

MARK = "▁"
MEMO_WORDS = 200_000
_SHIFT = 21  # bits of a code point


class LongestMatch:
    """Automaton over a vocabulary; node 0 is the root."""

    def __init__(self, pieces: Iterable[str]):
        self.step: dict[int, int] = {}
        self.pops = [0]
        self.link = [0]
        accepts = [False]
        parents = [(0, 0)]
        for piece in pieces:
            node = 0
            for char in map(ord, piece):
                key = node << _SHIFT | char
                child = self.step.get(key)
                if child is None:
                    child = self.step[key] = len(accepts)
                    accepts.append(False)
                    parents.append((node, char))
                node = child
            accepts[node] = node > 0
        self.pops += [0] * (len(accepts) - 1)
        self.link += [0] * (len(accepts) - 1)
        level = [node for node in range(1, len(accepts)) if parents[node][0] == 0]
        children: dict[int, list[int]] = {}
        for node in range(1, len(accepts)):
            children.setdefault(parents[node][0], []).append(node)
        while level:
            for node in level:
                self._link(node, *parents[node], accepts[node])
            level = [child for node in level for child in children.get(node, ())]

    def _link(self, node: int, parent: int, char: int, accepted: bool) -> None:
        if accepted:
            self.pops[node], self.link[node] = 1, 0
        elif parent == 0:  # a character that is no piece by itself
            self.pops[node], self.link[node] = len(chr(char).encode("utf-8", "surrogatepass")), 0
        else:
            pops, at = self.pops[parent], self.link[parent]
            while True:
                after = self.step.get(at << _SHIFT | char)
                if after is not None:
                    break
                if at == 0:
                    after = 0
                    pops += len(chr(char).encode("utf-8", "surrogatepass"))
                    break
                pops += self.pops[at]
                at = self.link[at]
            self.pops[node], self.link[node] = pops, after

    def count(self, word: str) -> int:
        step, pops, link = self.step, self.pops, self.link
        node = total = 0
        for char in map(ord, MARK + word):
            after = step.get(node << _SHIFT | char)
            while after is None:
                if node == 0:
                    total += len(chr(char).encode("utf-8", "surrogatepass"))
                    after = 0
                else:
                    total += pops[node]
                    node = link[node]
                    after = step.get(node << _SHIFT | char)
            node = after
        while node:
            total += pops[node]
            node = link[node]
        return total


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentence-piece model that stand for text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skipped = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(test(i) for test in skipped)]


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    return Memo(LongestMatch(vocabulary(path)).count, MEMO_WORDS)


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _memo(path)
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1).to_pylist():
                words = _words(text or "")
                sizes.append(len(words))
                tokens.append(sum(map(lengths.__getitem__, words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )
    return count


_TO_SPACE = str.maketrans("\t\n\v\f\r", "     ")


def _words(text: str) -> list[str]:
    return [word for word in text.translate(_TO_SPACE).split(" ") if word]


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """`(doc_id, n_words, n_tokens)` of every row; `path`: the vocabulary file, on every machine."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_counter(path), "doc_id long, n_words long, n_tokens long")
