"""Best documents of many queries, scored in blocks of documents.

A row per query and document would be far more than the postings where most queries meet most
documents. Here a task takes the documents of some buckets in blocks, and scores all queries against a
block, a batch of queries at a time. Terms that many queries of the batch share with many documents are
multiplied as matrices; the postings of the others are added one by one. These sums are in single precision: with
the bound of their error they tell which documents can be among the best `k` of a query, by the floor that the
blocks before have set. Only those few are summed exactly, token by token in their order.

The queries are handed to the tasks in parts that keep to the broadcast limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.operators import ranking
from harrow.operators.order import numbered
from harrow.session import broadcast_limit, fits_broadcast, stored

# Postings of one block, and numbers in the table of a batch of queries.
CELLS = 4_000_000
# What a token (places take two bytes below 65,536) and a query (with its `k` best scores) take in a task.
TOKEN_BYTES = 6
QUERY_BYTES = 16
LEAST_PART_BYTES = 1 << 20
# A term is multiplied if this share of a batch's pairs of query and document have it.
DENSE_SHARE = 0.005
# Postings of a term that are added by themselves rather than together with those of others.
LONG = 300
# Twice the rounding of a single-precision number.
ROUNDING = 2.0 ** -23
# Documents whose sums set a first floor.
SAMPLE = 2048


def best_documents(
    postings: DataFrame, weighted: DataFrame, avgdl: float, k: int, use_tf: bool = False
) -> DataFrame:
    """`(qid, rank, doc_id, score)`: the same rows as `ranking.top_k` over the scores of all candidates."""
    terms = stored(
        numbered(weighted.groupBy("term").agg(F.max("idf").alias("idf")), [F.col("term")], "no")
        .select("term", (F.col("no") - 1).cast("int").alias("no"), "idf"),
        "numbered-terms",
    )
    if fits_broadcast(terms):
        terms = F.broadcast(terms)
    asked = stored(weighted.select("qid", "pos", "term").join(terms, "term").select("qid", "pos", "term", "no", "idf"), "asked")
    size = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum(F.col("n") * TOKEN_BYTES + QUERY_BYTES + 8 * k).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // max(LEAST_PART_BYTES, broadcast_limit(weighted.sparkSession))))
    if parts == 1:
        return _best(postings, terms, asked, avgdl, k, use_tf)
    by_query = F.pmod(F.xxhash64("qid"), F.lit(parts))
    return reduce(DataFrame.unionByName, [
        stored(_best(postings, terms, asked.filter(by_query == at), avgdl, k, use_tf), "best-of-part")
        for at in range(parts)
    ])


def _best(postings: DataFrame, terms: DataFrame, asked: DataFrame, avgdl: float, k: int, use_tf: bool) -> DataFrame:
    spark = asked.sparkSession
    worth = ranking.with_contributions(postings.join(terms, "term"), avgdl, use_tf)
    by_document = worth.groupBy("doc_id").agg(F.collect_list(F.struct("no", "c")).alias("terms"))
    # a task goes through several buckets: the larger its blocks, the fewer times it takes up each query
    by_document = by_document.coalesce(spark.sparkContext.defaultParallelism)
    queries = spark.sparkContext.broadcast(_Queries.of(asked))
    schema = T.StructType([
        T.StructField("qid", asked.schema["qid"].dataType), T.StructField("doc_id", postings.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType()), T.StructField("first_pos", T.IntegerType())])
    return ranking.top_k(by_document.mapInArrow(_scorer(queries, k, CELLS), schema), k)


class _Queries:
    """Token lists of queries, those of like length side by side."""

    def __init__(self, qids: pa.Array, starts: np.ndarray, number: np.ndarray, pos: np.ndarray, signed: np.ndarray):
        self.qids, self.starts, self.number, self.pos, self.signed = qids, starts, number, pos, signed

    @classmethod
    def of(cls, asked: DataFrame) -> _Queries:
        rows = asked.orderBy("qid", "pos", "term").select("qid", "pos", "no", (F.col("idf") < 0).alias("sinks")).toArrow()
        qids = rows["qid"].combine_chunks()
        number, pos, sinks = (rows[name].to_numpy() for name in ("no", "pos", "sinks"))
        changes = qids.slice(1).to_pylist()
        first = np.flatnonzero(np.append(True, [a != b for a, b in zip(changes, qids.to_pylist())])) \
            if len(qids) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(first, len(number)))
        signed = np.maximum.reduceat(sinks.astype(bool), first) if len(first) else np.zeros(0, bool)
        order = np.lexsort((lengths, signed))
        tokens = _spans(first[order], lengths[order])
        return cls(
            qids.take(pa.array(first[order])), np.append(0, np.cumsum(lengths[order])), number[tokens].astype(np.int32),
            pos[tokens].astype(np.min_scalar_type(int(pos.max(initial=0)))), signed[order])

    def __len__(self) -> int:
        return len(self.qids)

    def batches(self, documents: int, cells: int) -> Iterator[tuple[int, int]]:
        """Ranges of queries whose tables keep to `cells`."""
        at, most = 0, max(1, cells // documents)
        while at < len(self):
            wide = np.arange(1, most + 1)[:len(self) - at] * (self.starts[at + 1:at + most + 1] - self.starts[at])
            stop = at + max(1, int(np.searchsorted(wide, 4 * cells, "right")))
            if self.signed[at] != self.signed[stop - 1]:
                stop = at + int(np.argmax(self.signed[at:stop]))
            yield at, stop
            at = stop


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after the other."""
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)


def _scorer(queries, k: int, cells: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        if not len(asked):
            return
        best = np.full((len(asked), k), -np.inf)
        for block in _blocks(batches, cells):
            for first, last in asked.batches(block.size, cells):
                query, document, scores, places = _score_batch(block, asked, first, last, best[first:last])
                for start in range(0, len(query), 10_000):
                    part = slice(start, start + 10_000)
                    yield pa.RecordBatch.from_arrays([
                        asked.qids.take(pa.array(query[part])), block.ids.take(pa.array(document[part])),
                        pa.array(scores[part], pa.float64()), pa.array(places[part], pa.int32()),
                    ], names=["qid", "doc_id", "score", "first_pos"])
    return score


def _blocks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[_Block]:
    ids, counts, term, worth, held = [], [], [], [], 0
    for batch in batches:
        lists = batch.column(1)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        terms, worths = (values.to_numpy(zero_copy_only=False) for values in lists.flatten().flatten())
        at, base = 0, 0
        while at < len(ends):
            stop = at + int(np.searchsorted(ends[at:] - base, cells - held, "right"))
            if stop == at and not held:
                stop = at + 1  # a document is never cut
            if stop > at:
                end = int(ends[stop - 1])
                ids.append(batch.column(0).slice(at, stop - at))
                counts.append(np.diff(ends[at:stop], prepend=base))
                term.append(terms[base:end].copy())
                worth.append(worths[base:end].copy())
                held += end - base
                at, base = stop, end
            if at < len(ends):
                yield _Block(ids, counts, term, worth)
                ids, counts, term, worth, held = [], [], [], [], 0
    if ids:
        yield _Block(ids, counts, term, worth)


class _Block:
    """Documents with their postings, by document and by term. Documents with the same terms of the same worth
    have the same score for every query: `size` counts them once."""

    def __init__(self, ids: list, counts: list, term: list, worth: list):
        self.ids = pa.concat_arrays(ids)
        counts, term, worth = np.concatenate(counts), np.concatenate(term), np.concatenate(worth)
        starts = np.cumsum(counts) - counts
        names = ["" if x is None else str(x) for x in self.ids.to_pylist()]
        self.place = np.empty(len(names), np.int64)  # in the order of ids as strings
        self.place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        kind = _alike(starts, counts, term, worth)
        self.members = np.lexsort((self.place, kind))
        self.size = int(kind.max()) + 1
        self.copies = np.bincount(kind, minlength=self.size)
        self.first = np.cumsum(self.copies) - self.copies
        kept = self.members[self.first]
        chosen = _spans(starts[kept], counts[kept])
        self.term, self.worth = term, worth = term[chosen], worth[chosen]
        self.counts = counts[kept]
        self.starts = np.cumsum(self.counts) - self.counts

        document = np.repeat(np.arange(self.size), self.counts)
        order = np.argsort(term, kind="stable")
        of_term = term[order]
        self.documents = document[order]
        self.small = worth[order].astype(np.float32)
        self.ends = np.cumsum(np.bincount(of_term, minlength=1))
        # ids can repeat: a document may have a term twice
        twice = np.flatnonzero((of_term[1:] == of_term[:-1]) & (self.documents[1:] == self.documents[:-1]))
        self.repeats = np.zeros(self.size, bool)
        self.repeats[self.documents[twice]] = True
        self.rows: dict[int, np.ndarray] = {}

    def spans(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where to where the postings of terms go."""
        known = terms < len(self.ends)
        at = np.where(known, terms, 0)
        stop = np.where(known, self.ends[at], 0)
        return np.where(known & (at > 0), self.ends[at - 1], 0), stop

    def row(self, term: int) -> np.ndarray:
        """What a term adds to each document."""
        if term not in self.rows:
            (start,), (stop,) = self.spans(np.array([term]))
            self.rows[term] = np.bincount(
                self.documents[start:stop], self.small[start:stop], self.size).astype(np.float32)
        return self.rows[term]


def _alike(starts: np.ndarray, counts: np.ndarray, term: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """A number per document, the same for those with equal postings (by 128 bits of a hash)."""
    mixed = (term.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= np.ascontiguousarray(worth).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    keys = [counts.astype(np.uint64)]
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(factor)
        mixed ^= mixed >> np.uint64(29)
        keys.append(np.add.reduceat(mixed, starts))
    order = np.lexsort(keys)
    new = np.append(False, reduce(np.logical_or, [key[order][1:] != key[order][:-1] for key in keys]))
    kind = np.empty(len(starts), np.int64)
    kind[order] = np.cumsum(new)
    return kind


def _score_batch(block: _Block, asked: _Queries, first: int, last: int, best: np.ndarray) -> tuple:
    """`(query, document, score, first_pos)` of what can be among the best; `best` takes up their scores."""
    n, k = best.shape
    bounds = asked.starts[first:last + 1]
    number = asked.number[bounds[0]:bounds[-1]]
    row = np.repeat(np.arange(n), np.diff(bounds))
    terms, local = np.unique(number, return_inverse=True)
    start, stop = block.spans(terms)
    sums = _sums(block, n, row, terms, local, start, stop)
    error = (np.diff(bounds).max() + 8) * ROUNDING
    if asked.signed[first]:
        size = _sums(block, n, row, terms, local, start, stop, np.abs)
        lower = np.where(size > 0, sums - error * size, -np.inf)
        upper = np.where(size > 0, sums + error * size, -np.inf)
        floors, shrunk = np.maximum(best.min(axis=1), np.finfo(np.float32).min), 1.0
    else:
        lower = upper = sums
        shrunk = 1.0 - 4 * error
        floors = np.maximum(best.min(axis=1) * shrunk, np.finfo(np.float32).smallest_subnormal)
    if block.size > k and (open_ := np.flatnonzero(np.isneginf(best.min(axis=1)))).size:
        # the k-th best of some documents is a floor as well
        some = lower[open_, :max(SAMPLE, 2 * k)]
        if some.shape[1] > k:
            floors[open_] = np.maximum(floors[open_], np.partition(some, -k, axis=1)[:, -k] * shrunk)
    near = np.flatnonzero(upper >= floors[:, None])
    query, document = np.divmod(near, block.size)
    least, surely = np.full(n, -np.inf), lower.ravel()[near]
    ends = np.searchsorted(query, np.arange(n + 1))
    for many in np.flatnonzero(np.diff(ends) > k):
        least[many] = np.partition(surely[ends[many]:ends[many + 1]], -k)[-k] * shrunk
    reach = upper.ravel()[near] >= least[query]
    query, document = query[reach], document[reach]
    if not len(query):
        return query, document, np.zeros(0), np.zeros(0, np.int32)
    scores, places = _exact(block, query, document, bounds, asked.pos[bounds[0]:bounds[-1]], number, row, terms, local)

    def cut(keep, place):
        order = np.lexsort((place, places[keep], -scores[keep], query[keep]))
        order = keep[order]
        nth = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        return order[nth < k], nth[nth < k]

    reach = np.flatnonzero(~np.isnan(scores) & (scores >= best.min(axis=1)[query]))
    kept, _ = cut(reach, block.place[block.members[block.first[document[reach]]]])
    copies = np.minimum(block.copies[document[kept]], k)
    one_of = block.members[_spans(block.first[document[kept]], copies)]
    kept = np.repeat(kept, copies)
    query, scores, places = query[kept], scores[kept], places[kept]
    kept, nth = cut(np.arange(len(kept)), block.place[one_of])
    query, scores, places = query[kept], scores[kept], places[kept]
    both = np.full((n, 2 * k), -np.inf)
    both[:, :k] = best
    both[query, k + nth] = scores
    best[:] = np.partition(both, k, axis=1)[:, k:]
    return query + first, one_of[kept], scores, places


def _sums(block: _Block, n: int, row, terms, local, start, stop, of=None) -> np.ndarray:
    """Sum of every query and document in single precision; `of` is taken of each summand."""
    uses = np.bincount(local, minlength=len(terms)) * (stop - start)
    dense = np.flatnonzero(uses > n * block.size * DENSE_SHARE)
    if len(dense):
        at = np.full(len(terms), -1)
        at[dense] = np.arange(len(dense))
        mine = np.flatnonzero(at[local] >= 0)
        times = np.bincount(row[mine] * len(dense) + at[local[mine]], minlength=n * len(dense))
        table = np.stack([block.row(term) for term in terms[dense].tolist()])
        sums = times.astype(np.float32).reshape(n, -1) @ (of(table) if of else table)
    else:
        sums = np.zeros((n, block.size), np.float32)
    other = stop > start
    other[dense] = False
    mine = np.flatnonzero(other[local])
    documents, small = block.documents, of(block.small) if of else block.small
    lengths = (stop - start)[local[mine]]
    few = mine[lengths < LONG]
    entry = _spans(start[local[few]], lengths[lengths < LONG])
    at = documents[entry]
    at += np.repeat(row[few] * block.size, lengths[lengths < LONG])
    np.add.at(sums.ravel(), at, small[entry])
    many = mine[lengths >= LONG]
    for query, a, b in zip(row[many].tolist(), start[local[many]].tolist(), stop[local[many]].tolist()):
        np.add.at(sums[query], documents[a:b], small[a:b])
    return sums


def _exact(block: _Block, query, document, bounds, pos, number, row, terms, local) -> tuple[np.ndarray, np.ndarray]:
    """Scores of pairs, summed over the tokens in their order, and their first matching token; NaN if none matches."""
    n, width = len(bounds) - 1, int(np.diff(bounds).max())
    key, slot = np.unique(row * len(terms) + local, return_inverse=True)  # each term of a query once
    of_key = key // len(terms)
    slot -= np.searchsorted(of_key, np.arange(n))[row]
    slots = np.full((width, n), width)
    slots[np.arange(len(row)) - (bounds[:-1] - bounds[0])[row], row] = slot
    # the slot of a term of the block in each query; the last column stands for terms that no query has
    known = np.full((n, len(terms) + 1), -1, np.int32)
    known[of_key, key % len(terms)] = np.arange(len(key)) - np.searchsorted(of_key, of_key)
    known = known.ravel()
    here = np.full(max(int(terms.max()), int(block.term.max())) + 1, len(terms), np.int32)
    here[terms] = np.arange(len(terms))

    scores, places = np.zeros(len(query)), np.full(len(query), -1, np.int32)
    step = max(1, CELLS // max(width, int(block.counts.mean()) + 1))
    for begin in range(0, len(query), step):
        part = slice(begin, begin + step)
        asking, asked_of = query[part], document[part]
        lengths = block.counts[asked_of]
        entry = _spans(block.starts[asked_of], lengths)
        held = here[block.term[entry]]
        held += np.repeat((asking * (len(terms) + 1)).astype(np.int32), lengths)
        held = known[held]
        used = np.flatnonzero(held >= 0)
        pair = np.searchsorted(np.cumsum(lengths), used, "right")
        worth = np.zeros((len(asking), width + 1))
        worth[pair, held[used]] = block.worth[entry[used]]
        total, nth = np.zeros(len(asking)), np.full(len(asking), -1)
        every = np.arange(len(asking))
        for token in range(width):
            added = worth[every, slots[token, asking]]
            total += added
            nth[(nth < 0) & (added != 0)] = token
        matched = nth >= 0
        scores[part] = np.where(matched, total, np.nan)
        places[part] = np.where(matched, pos[np.where(matched, (bounds[:-1] - bounds[0])[asking] + nth, 0)], -1)
    for at in np.flatnonzero(block.repeats[document]):
        start, stop = block.starts[document[at]], block.starts[document[at]] + block.counts[document[at]]
        found: dict[int, list[float]] = {}
        for term, worth in zip(block.term[start:stop].tolist(), block.worth[start:stop].tolist()):
            found.setdefault(term, []).append(worth)
        tokens = number[bounds[query[at]] - bounds[0]:bounds[query[at] + 1] - bounds[0]].tolist()
        scores[at] = reduce(float.__add__, (worth for token in tokens for worth in sorted(found.get(token, []))), 0.0)
    return scores, places
