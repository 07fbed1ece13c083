"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a word (a run of letters, lower case; pieces of 24
bytes of a longer one, cut between characters) from both ends and gives language probabilities at every byte.
A document's probabilities are the mean over all bytes of all its words, so the whole
text counts. Repeated words are computed once per task.

Training is numpy backpropagation through time on all pieces of the `VOCABULARY` most frequent words of
each language, counted over the whole texts of all training documents. Only `text` and `lang` of documents
with crc32(doc_id) mod 5 other than 0 are learned from.

`lang_pred` is `und`, with score 0, where text is NULL or has no letter, or where
nothing was learned; of equally likely languages the first by name is taken. A NULL doc_id is not
held out. Rows keep their number.

Rejection goes by certainty: the mean over all bytes of the probability of each word's
own best language, so that texts in two learned languages are as certain as others. Bytes
of letters that no training word has count as undecided (one over the number of
languages). A text goes if most of its letters are of that kind, or if its certainty is
under the floor of its language: the `FLOOR_SHARE` quantile of all training documents
(by words; exact counts over bins that are refined), less what a mean of so few words may stray (Hoeffding's bound for that share).
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import in_slices
from harrow.session import stored

UNKNOWN = "und"
FOLDS = 5
VOCABULARY = 5_000
WORD_SLICES = 32
HIDDEN = 24
WINDOW = 24
STEPS = 700
BATCH = 256
RATE = 0.01
MEMO_BYTES = 64_000_000
WORD_BYTES = 250  # of a remembered word beside its letters
HELD_CHARS = 500_000
SLICE_ROWS = 500
FLOOR_SHARE = 0.01
FLOOR_BINS = 1024
_RUN = re.compile(r"[^\W\d_]+")
_NET_PIECES = 1024


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def letter_runs(text: str) -> list[str]:
    runs = _RUN.findall(text.lower())
    return runs if text.isascii() else [run for run in runs if run.isalpha() or any(map(str.isalpha, run))]


# --- the network -------------------------------------------------------------


def pieces_of(word: bytes) -> list[bytes]:
    """The word in pieces of at most `WINDOW` bytes, cut between characters."""
    pieces = []
    while len(word) > WINDOW:
        cut = WINDOW
        while cut > 1 and word[cut] & 0xC0 == 0x80:
            cut -= 1
        pieces.append(word[:cut])
        word = word[cut:]
    return [*pieces, word]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Per direction: input rows by byte, recurrent matrix, biases; then the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        made = {}
        for way in "fb":
            made[f"in_{way}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
            made[f"gates_{way}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 2 * HIDDEN))
            made[f"new_{way}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, HIDDEN))
            made[f"bias_{way}"] = np.zeros(3 * HIDDEN)
        made["out"] = rng.normal(0, 0.3, (2 * HIDDEN, len(languages)))
        made["bias"] = np.zeros(len(languages))
        return cls(languages, {name: value.astype(np.float32) for name, value in made.items()})

    def _run(self, way: str, codes: np.ndarray, inside: np.ndarray, keep: bool):
        """Hidden states `(time, word, hidden)` of one direction and what its gradient needs."""
        w = self.weights
        words, steps = codes.shape
        state = np.zeros((words, HIDDEN), np.float32)
        states, trail = np.zeros((steps, words, HIDDEN), np.float32), []
        order = range(steps) if way == "f" else range(steps - 1, -1, -1)
        for t in order:
            given = w[f"in_{way}"][codes[:, t]] + w[f"bias_{way}"]
            gates = _sigmoid(given[:, :2 * HIDDEN] + state @ w[f"gates_{way}"])
            reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
            fresh = np.tanh(given[:, 2 * HIDDEN:] + (reset * state) @ w[f"new_{way}"])
            mask = inside[:, t:t + 1]
            after = np.where(mask, update * state + (1 - update) * fresh, state)
            if keep:
                trail.append((t, state, reset, update, fresh, mask))
            state = after
            states[t] = state
        return states, trail

    def probabilities(self, codes: np.ndarray, inside: np.ndarray):
        """Language probabilities at every position `(time, word, language)`, and the trails."""
        forward, trail_f = self._run("f", codes, inside, True)
        backward, trail_b = self._run("b", codes, inside, True)
        both = np.concatenate([forward, backward], axis=2)
        return self._softmax(both), both, trail_f, trail_b

    def _softmax(self, both: np.ndarray) -> np.ndarray:
        scores = both @ self.weights["out"] + self.weights["bias"]
        scores -= scores.max(axis=-1, keepdims=True)
        np.exp(scores, out=scores)
        return scores / scores.sum(axis=-1, keepdims=True)

    def _final_states(self, way: str, codes: np.ndarray, active: list[int]) -> np.ndarray:
        """The states of `_run` for words sorted from long to short: `active[t]` of them have a byte at `t`."""
        w = self.weights
        given_by = w[f"in_{way}"] + w[f"bias_{way}"]
        state = np.zeros((codes.shape[1], HIDDEN), np.float32)
        states = np.zeros((len(active), codes.shape[1], HIDDEN), np.float32)
        for t in range(len(active)) if way == "f" else range(len(active) - 1, -1, -1):
            n = active[t]
            given, before = given_by[codes[t, :n]], state[:n]
            gates = before @ w[f"gates_{way}"]
            gates += given[:, :2 * HIDDEN]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            fresh = (gates[:, :HIDDEN] * before) @ w[f"new_{way}"]
            fresh += given[:, 2 * HIDDEN:]
            np.tanh(fresh, out=fresh)
            update = gates[:, HIDDEN:]
            before *= update
            fresh *= 1 - update
            before += fresh
            states[t, :n] = before
        return states

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """Per word, the sums of its positions' probabilities and, last, its positions."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        pieces, owner = list(words), np.arange(len(words))
        if max(map(len, words), default=0) > WINDOW:
            cut = [pieces_of(word) for word in words]
            pieces, owner = [piece for own in cut for piece in own], np.repeat(owner, list(map(len, cut)))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts, joined = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pieces) + bytes(WINDOW), np.uint8)
        order = np.argsort(-sizes, kind="stable")
        for start in range(0, len(order), _NET_PIECES):
            part = order[start:start + _NET_PIECES]
            steps = np.arange(sizes[part[0]])
            codes = joined[starts[part] + steps[:, None]]
            active = np.searchsorted(-sizes[part], -steps).tolist()  # words longer than each step
            found = self._softmax(np.concatenate([self._final_states(way, codes, active) for way in "fb"], axis=2))
            inside = steps[:, None] < sizes[part]
            sums = np.column_stack([(found * inside[:, :, None]).sum(axis=0), sizes[part]]).astype(np.float32)
            if len(pieces) == len(words):
                out[part] = sums
            else:
                np.add.at(out, owner[part], sums)
        return out

    def gradients(self, codes: np.ndarray, inside: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, by backpropagation through time."""
        found, both, trail_f, trail_b = self.probabilities(codes, inside)
        wrong = found.copy()
        wrong[:, np.arange(len(labels)), labels] -= 1
        wrong *= inside.T[:, :, None] / inside.sum()
        grads = {"out": np.einsum("twh,twl->hl", both, wrong), "bias": wrong.sum(axis=(0, 1))}
        down = wrong @ self.weights["out"].T
        self._back("f", codes, down[:, :, :HIDDEN], trail_f, grads)
        self._back("b", codes, down[:, :, HIDDEN:], trail_b, grads)
        return grads

    def _back(self, way: str, codes, down, trail, grads) -> None:
        w = self.weights
        gates, new = w[f"gates_{way}"], w[f"new_{way}"]
        d_in, d_gates, d_new = np.zeros_like(w[f"in_{way}"]), np.zeros_like(gates), np.zeros_like(new)
        d_bias, d_state = np.zeros_like(w[f"bias_{way}"]), np.zeros(down.shape[1:], np.float32)
        for t, state, reset, update, fresh, mask in reversed(trail):
            d_after = d_state + down[t]
            d_on = d_after * mask
            d_fresh = d_on * (1 - update) * (1 - fresh * fresh)
            d_update = d_on * (state - fresh) * update * (1 - update)
            d_held = d_fresh @ new.T
            d_reset = d_held * state * reset * (1 - reset)
            d_pair = np.concatenate([d_reset, d_update], axis=1)
            d_state = np.where(mask, d_on * update + d_held * reset + d_pair @ gates.T, d_after)
            d_gates += state.T @ d_pair
            d_new += (reset * state).T @ d_fresh
            d_given = np.concatenate([d_pair, d_fresh], axis=1)
            np.add.at(d_in, codes[:, t], d_given)
            d_bias += d_given.sum(axis=0)
        grads |= {f"in_{way}": d_in, f"gates_{way}": d_gates, f"new_{way}": d_new, f"bias_{way}": d_bias}


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, words))
    codes = np.frombuffer(b"".join(word.ljust(longest, b"\0") for word in words), np.uint8).reshape(-1, longest)
    inside = np.arange(longest) < np.array([len(word) for word in words])[:, None]
    return codes.astype(np.int64), inside


def fit(words: list[bytes], labels: list[str], counts: list[int], seed: int = 0, steps: int = STEPS) -> Network:
    """Adam on batches of words drawn by the square root of their count, languages evenly."""
    languages = sorted(set(labels))
    cut = [(piece, label, n) for word, label, n in zip(words, labels, counts) for piece in pieces_of(word)]
    words, labels, counts = ([row[at] for row in cut] for at in range(3))
    net = Network.fresh(languages, seed)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    label = np.array([languages.index(one) for one in labels])
    share = np.sqrt(np.array(counts, np.float64))
    for at in range(len(languages)):
        share[label == at] /= share[label == at].sum()
    share /= share.sum()
    first = {name: np.zeros_like(value) for name, value in net.weights.items()}
    second = {name: np.zeros_like(value) for name, value in net.weights.items()}
    for step in range(1, steps + 1):
        drawn = rng.choice(len(words), BATCH, p=share)
        codes, inside = padded([words[i] for i in drawn])
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for name, grad in net.gradients(codes, inside, label[drawn]).items():
            first[name] = 0.9 * first[name] + 0.1 * grad
            second[name] = 0.99 * second[name] + 0.01 * grad * grad
            change = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
            net.weights[name] = (net.weights[name] - rate * change).astype(np.float32)
    return net


# --- on tables ---------------------------------------------------------------


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(letter_runs(text or ""))
        rows = [(lang, word, n) for lang, found in counts.items() for word, n in found.items()]
        langs, words, numbers = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(numbers, pa.int64())], names=["lang", "word", "n"])


def _is_training() -> Column:
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id").cast("long"))


def training_documents(documents: DataFrame) -> DataFrame:
    """`(lang, text)` of every labelled document that is not held out."""
    own = documents.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return own.filter(_is_training()).select("lang", "text")


def training_words(documents: DataFrame) -> DataFrame:
    """`(lang, word, n)`: the `VOCABULARY` most frequent words of each language in all training documents."""
    found = training_documents(documents).mapInArrow(_counted_words, "lang string, word string, n long")
    counted = found.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.xxhash64("word"), "word"]
    # first within slices of a language, so that no task sorts all of its words
    for keys in (["lang", F.pmod(F.xxhash64("word", F.lit("slice")), F.lit(WORD_SLICES))], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        counted = counted.withColumn("nth", nth).filter(F.col("nth") <= VOCABULARY).drop("nth")
    return counted


def _fitted(words: DataFrame, seed: int) -> tuple[Network, frozenset[str]]:
    """The network and the letters of its training words."""
    rows = sorted((r["lang"], r["word"], r["n"]) for r in words.collect())
    net = fit([word.encode() for _, word, _ in rows], [lang for lang, _, _ in rows], [n for _, _, n in rows], seed)
    return net, frozenset().union(*(word for _, word, _ in rows))


def train(documents: DataFrame, seed: int = 0) -> Network:
    return _fitted(training_words(documents), seed)[0]


class Judgement(NamedTuple):
    lang: str
    score: float
    certainty: float
    words: int
    learned: bool  # whether no more than half of the letters are of a kind that no training word has


NOTHING = Judgement(UNKNOWN, 0.0, 0.0, 0, False)


class _Words:
    """Sums of each word seen lately in this task: by language, bytes, certainty, strange letters, letters.

    All that is asked of a text are sums over its words. What is held is bounded by bytes, beside
    the words of the texts that are judged together. When half of that is full, the words met since stay
    and those before are forgotten, but for the ones that come again.
    """

    def __init__(self, net: Network, letters: frozenset[str] = frozenset()):
        self.net = net
        self.letters = letters
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((0, len(net.languages) + 4))
        self.held = 0
        self.older: tuple[dict[str, int], np.ndarray] = {}, self.sums

    def learn(self, words: set[str]) -> None:
        if self.held > MEMO_BYTES // 2:
            self.older, self.rows, self.held = (self.rows, self.sums), {}, 0
            self.sums = np.zeros((0, self.sums.shape[1]))
        new = list(words.difference(self.rows))
        if not new:
            return
        rows, sums = self.older
        again = [word for word in new if word in rows] if rows else []
        if again:
            self._keep(again, sums[[rows[word] for word in again]])
            new = list(words.difference(self.rows))
        if new:
            self._keep(new, self._computed(new))

    def _keep(self, words: list[str], sums: np.ndarray) -> None:
        first = len(self.rows)
        if first + len(words) > len(self.sums):
            self.sums = np.resize(self.sums, (2 * (first + len(words)), self.sums.shape[1]))
        self.sums[first:first + len(words)] = sums
        self.rows.update(zip(words, range(first, first + len(words))))
        self.held += sum(map(len, words)) * 2 + len(words) * WORD_BYTES

    def _computed(self, words: list[str]) -> np.ndarray:
        found = self.net.word_sums([word.encode("utf-8", "surrogatepass") for word in words]).astype(np.float64)
        sizes = np.fromiter(map(len, words), np.float64, len(words))
        missing, strange = np.zeros(len(words)), np.zeros(len(words))
        if self.letters:
            for at, word in enumerate(words):
                if not self.letters.issuperset(word):
                    others = [c for c in word if c not in self.letters]
                    missing[at] = len("".join(others).encode("utf-8", "surrogatepass"))
                    strange[at] = len(others)
        else:
            missing, strange = found[:, -1], sizes
        sure = found[:, :-1].max(axis=1, initial=0) * (1 - missing / found[:, -1]) + missing / max(1, len(self.net.languages))
        return np.column_stack([found, sure, strange, sizes])


def judged(memo: _Words, texts: list[str | None]) -> Iterator[Judgement]:
    """What the network says of each text; the words of a few texts at a time are held.

    Of languages that are equally likely the first by name is taken.
    """
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and size < HELD_CHARS:
            size += len(texts[stop] or "")
            stop += 1
        yield from _judged_together(memo, texts[start:stop])
        start = stop


def _judged_together(memo: _Words, texts: list[str | None]) -> Iterator[Judgement]:
    found = [letter_runs(text or "") for text in texts]
    if memo.net.languages:
        memo.learn(set().union(*found))
    for words in found:
        if not words or not memo.net.languages:
            yield NOTHING._replace(words=len(words))
            continue
        *langs, size, sure, strange, letters = memo.sums[np.fromiter(map(memo.rows.__getitem__, words), np.int64, len(words))].sum(axis=0).tolist()
        best = int(np.argmax(langs))
        yield Judgement(memo.net.languages[best], min(1.0, langs[best] / size), sure / size, len(words), 2 * strange <= letters)


def _predictor(net: Network):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words(net)
        for batch in in_slices(batches):
            found = list(judged(memo, batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([one.lang for one in found], pa.string()),
                 pa.array([one.score for one in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )
    return predict


def predict(documents: DataFrame, net: Network) -> DataFrame:
    """`(doc_id, held_out, lang_pred, score)` of every row."""
    rows = documents.select(
        F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(_predictor(net), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """Train on the documents themselves, then predict each."""
    return predict(documents, train(documents))


@dataclass
class Rejection:
    """What the certainty of texts is held against."""

    net: Network
    letters: frozenset[str]
    floors: dict[str, float] = field(default_factory=dict)

    def memo(self) -> _Words:
        return _Words(self.net, self.letters)

    def spread(self) -> float:
        return (1 - 1 / len(self.net.languages)) * math.sqrt(math.log(1 / FLOOR_SHARE) / 2)

    def keeps(self, found: Judgement) -> bool:
        if not self.net.languages:
            return found.words > 0
        if found.lang == UNKNOWN or not found.learned or len(self.net.languages) < 2:
            return found.learned
        return found.certainty >= self.floors[found.lang] - self.spread() / math.sqrt(found.words)

    def kept(self, found: Column) -> Column:
        """`keeps` of a struct column of `JUDGED`."""
        if not self.net.languages:
            return found["words"] > 0
        if len(self.net.languages) < 2:
            return found["learned"]
        floor = F.element_at(F.create_map(*[F.lit(x) for pair in self.floors.items() for x in pair]), found["lang"])
        certain = found["certainty"] >= floor - F.lit(self.spread()) / F.sqrt(found["words"])
        return F.when((found["lang"] == UNKNOWN) | ~found["learned"], found["learned"]).otherwise(certain)

    def judged(self, text: Column) -> Column:
        """Only texts go to Python, and a struct of `JUDGED` comes back."""
        rule = self

        @F.arrow_udf(JUDGED)
        def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            memo = rule.memo()
            for texts in batches:
                found = []
                for start in range(0, len(texts), SLICE_ROWS):
                    found += judged(memo, texts.slice(start, SLICE_ROWS).to_pylist())
                yield pa.array([one._asdict() for one in found], _JUDGED_ARROW)

        return judge(text.cast("string"))


JUDGED = "struct<lang:string,score:double,certainty:double,words:bigint,learned:boolean>"
_JUDGED_ARROW = pa.struct([
    ("lang", pa.string()), ("score", pa.float64()), ("certainty", pa.float64()), ("words", pa.int64()), ("learned", pa.bool_())])


def learned_floors(rows: DataFrame) -> dict[str, float]:
    """Per language of `(lang, certainty, words)` the least certainty that `FLOOR_SHARE` of the words do not exceed.

    Exact: the words are counted by bins of certainty, and the bin that holds the floor is
    cut again until one value is left. Some `FLOOR_BINS` numbers a language come to the driver.
    """
    rows = rows.filter("words > 0")
    spans = {r["lang"]: (r["lo"], r["hi"], FLOOR_SHARE * r["n"]) for r in rows.groupBy("lang").agg(
        F.min("certainty").alias("lo"), F.max("certainty").alias("hi"), F.sum("words").alias("n")).collect()}
    floors: dict[str, float] = {}
    while spans:
        floors |= {lang: lo for lang, (lo, hi, _) in spans.items() if lo == hi}
        spans = {lang: span for lang, span in spans.items() if span[0] < span[1]}
        if not spans:
            break
        asked = rows.sparkSession.createDataFrame(
            [(lang, lo, hi) for lang, (lo, hi, _) in spans.items()], "lang string, lo double, hi double")
        near = rows.join(F.broadcast(asked), "lang").filter(F.col("certainty").between(F.col("lo"), F.col("hi")))
        place = F.floor((F.col("certainty") - F.col("lo")) / (F.col("hi") - F.col("lo")) * FLOOR_BINS)
        bins = near.groupBy("lang", place.alias("bin")).agg(
            F.sum("words").alias("n"), F.min("certainty").alias("lo"), F.max("certainty").alias("hi")).collect()
        for lang, (_, _, wanted) in list(spans.items()):
            for row in sorted((r for r in bins if r["lang"] == lang), key=lambda r: r["bin"]):
                if row["n"] >= wanted:
                    spans[lang] = (row["lo"], row["hi"], wanted)
                    break
                wanted -= row["n"]
    return floors


def learned_rejection(documents: DataFrame, seed: int = 0) -> Rejection:
    """Network and floors; the floors are of all training documents, held out ones are not looked at."""
    rule = Rejection(*_fitted(training_words(documents), seed))
    if rule.net.languages:
        found = training_documents(documents).select("lang", rule.judged(F.col("text")).alias("found"))
        rule.floors = learned_floors(stored(found.select("lang", "found.certainty", "found.words"), "certainties"))
    return rule


def with_language(documents: DataFrame, least_score: float = 0.0, by_certainty: bool = False) -> DataFrame:
    """The rows that have a language, scored `least_score` or more; same columns.

    `by_certainty` also rejects what no learned language explains (see the module): every text is
    judged once, and the floors are taken from what was said of the training documents.
    If nothing could be learned, rows with a letter stay.
    """
    rule = Rejection(*_fitted(training_words(documents), 0)) if by_certainty else Rejection(train(documents), frozenset())
    name = "judged_" + uuid.uuid4().hex[:12]
    rows = documents.withColumn(name, rule.judged(F.col("text")))
    found = F.col(name)
    if by_certainty and rule.net.languages:
        rows = stored(rows, "judged")
        rule.floors = learned_floors(rows.filter(_is_training()).select(
            F.col("lang").cast("string"), found["certainty"].alias("certainty"), found["words"].alias("words")))
    if not rule.net.languages:
        good = rule.kept(found)
    else:
        good = (rule.kept(found) if by_certainty else found["lang"] != UNKNOWN) & (found["score"] >= least_score)
    return rows.filter(good).drop(name)
