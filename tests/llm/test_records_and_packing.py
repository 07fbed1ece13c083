"""WARC records, packing, language identification, fingerprints and decontamination."""

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harrow.llm import decontamination, language_id, lz_fingerprints, packing, warc_records
from harrow.llm.queries import WORD_BPE, tokenizer_file
from harrow.session import new_path
from harrow.sources.storage import located
from harrow.sources.tables import read_table

# --- WARC --------------------------------------------------------------------


def expected_records(rows):
    payloads = [(html or "").encode() for _, _, html in rows]
    result = []
    for (page_id, _, _), payload in zip(rows, payloads):
        ids = [r[0] for r, p in zip(rows, payloads) if p == payload and r[0] is not None]
        refers = min(ids) if len(payload) >= 100 and ids and page_id != min(ids) else None
        if sum(p == payload for p in payloads) < 2:
            refers = None
        result.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(result, key=str)


PAGE_ROWS = [
    (1, "http://a.example/", "<p>" + "x" * 200), (2, "http://b.example/\r\nX: y", "<p>" + "x" * 200), (3, None, None), (4, "", ""),
    (5, "http://c.example/", "é" * 49), (6, "http://c.example/", "é" * 49), (7, "u", "é" * 50), (8, "u", "é" * 50), (8, "u", "é" * 50),
    (None, "u", "é" * 50), (None, "v", "y" * 300), (None, "v", "y" * 300), (9, "w", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (10, "long", "z" * 3_000_000),
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_round_trip(spark, request, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    pages = spark.createDataFrame(PAGE_ROWS, "page_id long, url string, html string").withColumns(
        {name: F.lit("x") for name in ("digest", "payload", "uses", "first_id")})
    read = warc_records.archived(pages).collect()
    assert not any(r["problem"] for r in read)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read]
    assert sorted(got, key=str) == expected_records(PAGE_ROWS)
    assert warc_records.archived(pages.limit(0)).count() == 0


CLAIMS = [
    # id, type, size, digest, refers to, problem
    (1, "response", 200, "aa", None, None), (1, "response", 200, "aa", None, None), (2, "response", 300, "bb", None, None),
    (3, "response", 400, "cc", None, "block too short"), (None, "response", 500, "dd", None, None),
    (11, "revisit", 200, "aa", 1, None), (12, "revisit", 200, "bb", 1, None), (13, "revisit", 201, "aa", 1, None),
    (14, "revisit", 300, "bb", 9, None), (15, "revisit", 400, "cc", 3, None), (16, "revisit", 500, "dd", None, None),
    (17, "revisit", None, None, 1, None), (18, "revisit", 300, "bb", 2, "block digest differs"), (19, None, None, None, None, "bad gzip member"),
    *[(100 + n, "revisit", 300, "bb", 2, None) for n in range(30)], *[(200 + n, "revisit", 300, "bc", 2, None) for n in range(30)],
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_revisits_are_held_against_their_responses(spark, request, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    records = spark.createDataFrame(
        CLAIMS, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, problem string"
    ).withColumn("offset", F.col("page_id"))
    got = {r["page_id"]: r["problem"] for r in warc_records.verified(records).filter("record_type = 'revisit'").collect()}
    wrong = {12, 13, 14, 15, 16, 17, *range(200, 230)}
    assert got == {row[0]: "block digest differs" if row[0] == 18 else warc_records.UNPROVED if row[0] in wrong else None
                   for row in CLAIMS if row[1] == "revisit"}
    assert warc_records.verified(records).count() == len(CLAIMS)
    assert warc_records.verified(records.filter("page_id = 11 OR page_id = 1")).filter("problem IS NOT NULL").count() == 0
    assert warc_records.verified(records.limit(0)).count() == 0


def test_a_header_without_end_is_not_inflated_whole():
    member = gzip.compress(b"WARC/1.1\r\n" + b"x" * 30_000_000)
    good = gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\nWARC-Type: response\r\n\r\nab\r\n\r\n")
    rows = list(warc_records.records_of(io.BytesIO(member + good)))
    assert [r.get("problem") for r in rows] == ["no record header", None] and rows[1]["payload"] == b"ab"


def test_files_roll_and_payloads_return(spark, folder):
    pages = read_table(spark, folder, "pages").coalesce(1)
    path = new_path(spark, "test-warc")
    files = warc_records.write_archive(pages, path, roll_bytes=20_000)
    assert files.count() > 3 and files.agg(F.sum("records")).first()[0] == pages.count()
    read = warc_records.read_archive(warc_records.archive_files(spark, path), path).filter("record_type = 'response'")
    same = read.join(pages, "page_id").filter(F.col("payload") == F.encode("html", "UTF-8"))
    assert same.count() == read.count() == pages.count()


def member(page_id, payload, **changed):
    digest = hashlib.sha256(payload).hexdigest()
    data = warc_records.record_bytes(page_id, "http://u.example/", payload, digest, None)
    for old, new in changed.get("swap", ()):
        data = data.replace(old, new)
    return gzip.compress(data)


def problems(data, monkeypatch, chunk):
    monkeypatch.setattr(warc_records, "CHUNK", chunk)
    return [(r.get("page_id"), r.get("problem"), r["offset"]) for r in warc_records.records_of(io.BytesIO(data))]


@pytest.mark.parametrize("chunk", [17, 1000, 1 << 20])
def test_damage_is_reported_and_passed(monkeypatch, chunk):
    rng = random.Random(1)
    payload = bytes(rng.randrange(256) for _ in range(3000))
    good = [member(n, payload + bytes([n])) for n in range(3)]
    wrong = member(7, payload, swap=[(payload[:9], b"otherbyte")])
    short = member(8, payload, swap=[(b"Content-Length: 3000", b"Content-Length: 9000")])
    long = member(9, payload, swap=[(b"Content-Length: 3000", b"Content-Length: 100")])
    none = member(9, payload, swap=[(b"Content-Length", b"Content-Size")])
    broken = good[1][:1000] + b"\0\0\0\0\0\0\0\0" + good[1][1008:]
    data = good[0] + wrong + short + long + none + gzip.compress(b"no record") + good[1] + broken + good[2]
    got = problems(data, monkeypatch, chunk)
    assert [g[1] for g in got][:7] == [None, "block digest differs", "block too short", "block too long", "no content length",
                                       "no record header", None]
    assert got[7][1] in ("bad gzip member", "block digest differs") and got[-1][:2] == (2, None)
    assert got[-1][2] == len(data) - len(good[2])
    assert [g[:2] for g in problems(good[0] + good[1][:-9], monkeypatch, chunk)] == [(0, None), (None, "cut short")]
    assert problems(b"", monkeypatch, chunk) == [] and problems(b"noise" * 50, monkeypatch, chunk) == []


def test_unreported_files_are_not_read(spark):
    pages = spark.createDataFrame(PAGE_ROWS[:2], "page_id long, url string, html string")
    path = new_path(spark, "test-warc")
    files = warc_records.write_archive(pages, path)
    fs, root = located(path)
    with fs.open_output_stream(f"{root}/part-lost-00000.warc.gz", compression=None) as out:
        out.write(member(99, b"lost attempt"))
    assert sorted(r["page_id"] for r in warc_records.read_archive(files, path).collect()) == [1, 2]


# --- packing -----------------------------------------------------------------


def check_packing(rows, found, tokens):
    tokenizer = Tokenizer.from_file(tokenizer_file(WORD_BPE))
    expected = []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), tokens)):
            part = ids[start:start + tokens]
            expected.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(expected, key=str)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= tokens
    return sequences


STRANGE = [
    "It's  we'll I'D don't 's x's!'s ''s 12a3.4", "<|endoftext|> a<|startoftext|>b <|", "ﬁ ①② ª º µ İI ΑΣ Σ", "a b c\x1cd\x85e　f",
    "é ́x Å", "Straße ÀÉÎ × ÷ ñ", "北京 日本", "\U0001f600‍\U0001f600", "tab\there\rthere\fff\vv", "()[]{}~^`@#\\_-",
]


def test_packing(spark, odd_documents, odd_rows, no_documents, folder):
    path = tokenizer_file(WORD_BPE)
    check_packing(odd_rows, packing.pack(odd_documents, path).collect(), 2048)
    strange = list(enumerate(STRANGE))
    check_packing(strange, packing.pack(spark.createDataFrame(strange, "doc_id long, text string"), path, 16).collect(), 16)
    documents = read_table(spark, folder, "documents")
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = packing.pack(documents, path).collect()
    sequences = check_packing(rows, found, 2048)
    assert len(sequences) <= -(-sum(r["length"] for r in found) // 2048) + 1
    assert packing.pack(no_documents, path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, rule):
    rng = random.Random(4)
    rows = [(n, " ".join(rng.choices(["a", "of", "the", "stone"], k=rng.randrange(0, 40)))) for n in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.pack(documents, tokenizer_file(WORD_BPE), 64, max_documents=3, max_attention=1600, rule=rule).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append(r["length"])
    assert all(sum(s) <= 64 and len(s) <= 3 and sum(x * x for x in s) <= 1600 for s in sequences.values())
    assert max(map(len, sequences.values())) == 3 and max(r["length"] for r in found) <= 40


def test_groups_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    rows = [(n, "word " * (n % 50)) for n in range(500)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_file(WORD_BPE), 64).collect()
    sequences = check_packing(rows, found, 64)
    assert len({s >> 32 for s in sequences}) == 5
    assert len(sequences) <= sum(r["length"] for r in found) / 64 * 1.1 + 5


# --- language ----------------------------------------------------------------


def test_gradients_against_differences():
    net = language_id.Network.fresh(["a", "b", "c"], 3)
    net.weights = {name: value.astype(np.float64) for name, value in net.weights.items()}
    codes, inside = language_id.padded([b"abc", b"hello", b"x"])
    labels = np.array([0, 2, 1])

    def loss():
        found = net.probabilities(codes, inside)[0]
        picked = np.log(found[:, np.arange(3), labels])
        return -(picked * inside.T).sum() / inside.sum()

    grads = net.gradients(codes, inside, labels)
    rng = np.random.default_rng(0)
    for name, value in net.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name.startswith("in_"):
                at = (int(codes[1, rng.integers(0, 5)]), at[1])
            kept = value[at]
            value[at] = kept + 1e-3
            up = loss()
            value[at] = kept - 1e-3
            down = loss()
            value[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


@pytest.fixture(scope="module")
def trained(spark):
    return language_id.train(read_table(spark, "/root/testdata/sf0.01", "documents"))


def test_held_out_accuracy(spark, trained):
    documents = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = language_id.predict(documents, trained).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == documents.count() and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_words_one_by_one(trained):
    words = ["theron", "größe", "été" * 30, "a"]
    found, blank = language_id.judged(language_id._Words(trained), [" ".join(words), " 12 "])
    assert blank == language_id.NOTHING
    total, positions = np.zeros(len(trained.languages)), 0
    for word in words:
        for piece in language_id.pieces_of(word.encode()):
            codes, inside = language_id.padded([piece])
            each = trained.probabilities(codes, inside)[0][:, 0]
            total += each.sum(axis=0)
            positions += len(each)
    assert found.lang == trained.languages[int(np.argmax(total))]
    assert found.score == pytest.approx((total / positions).max(), abs=1e-4)


def test_pieces_are_cut_between_characters():
    for word in ("a", "a" * 24, "a" * 25, "é" * 30, "北" * 100, "a" + "\U0001f600" * 40):
        pieces = language_id.pieces_of(word.encode())
        assert "".join(piece.decode() for piece in pieces) == word
        assert all(20 < len(piece) <= 24 for piece in pieces[:-1]) and 0 < len(pieces[-1]) <= 24


def test_remembered_words_are_bounded(trained, monkeypatch):
    """Text after text of new words, short and long: what is held stays under the bound and results do not change."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.choice([3, 9, 300]))) for _ in range(40)) for _ in range(60)]
    whole = list(language_id.judged(language_id._Words(trained), texts))
    monkeypatch.setattr(language_id, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(language_id, "HELD_CHARS", 1_000)
    memo = language_id._Words(trained)
    again = []
    for text in texts:
        again += language_id.judged(memo, [text])
        assert memo.held < 20_000 + 40 * (600 + language_id.WORD_BYTES)
    assert [one.lang for one in whole] == [one.lang for one in again]
    assert [one.score for one in whole] == pytest.approx([one.score for one in again])


def test_words_that_come_again_are_computed_once(trained, monkeypatch):
    """However many other words pass through the memory, those of every text stay in it."""
    monkeypatch.setattr(language_id, "MEMO_BYTES", 40_000)
    rng, computed = random.Random(5), []
    compute = language_id.Network.word_sums
    monkeypatch.setattr(language_id.Network, "word_sums", lambda net, words: computed.extend(words) or compute(net, words))
    common = ["theron", "größe", "maison"]
    memo = language_id._Words(trained)
    for _ in range(40):
        text = " ".join(common + ["".join(rng.choices("abcdefgh", k=9)) for _ in range(30)])
        list(language_id.judged(memo, [text]))
        assert memo.held < 20_000 + 40 * (20 + language_id.WORD_BYTES)
    assert len(computed) > 1000 and all(computed.count(word.encode()) == 1 for word in common)


def test_words_of_all_lengths_together(trained):
    """Words computed side by side are as when computed alone, long ones in pieces."""
    words = [word.encode() for word in ("a", "été" * 30, "größe", "x" * 24, "y" * 25, "ab", "theron")]
    alone = np.concatenate([trained.word_sums([word]) for word in words])
    assert np.allclose(trained.word_sums(words), alone, atol=1e-4)
    assert alone[:, -1].tolist() == list(map(len, words)) and trained.word_sums([]).shape == (0, alone.shape[1])


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents, attention", [(2048, 2048 ** 2), (5, 2048 ** 2), (2048, 900_000)])
def test_placement_against_a_plain_loop(rule, documents, attention):
    rng = random.Random(documents)
    longest = int(min(2048, attention ** 0.5))
    lengths = sorted([min(longest, int(rng.expovariate(1 / 500)) + 1) for _ in range(1500)], reverse=True)
    capacity = (2048, documents, attention)
    fast = packing.VectorBestFit(*capacity, rule)
    sequences = []  # what is left, as shares, and the tokens used
    for number, length in enumerate(lengths):
        if number % 100 == 0:
            fast.close_below(lengths[-1])
        need = [length / capacity[0], 1 / capacity[1], length * length / capacity[2]]
        costs = {}
        for at, (left, _) in enumerate(sequences):
            after = [x - y for x, y in zip(left, need)]
            if min(after) > -1e-9:
                costs[at] = (sum(w * x * x for w, x in zip(packing.WEIGHTS, after)) if rule == "norm"
                             else -sum(w * y * x for w, x, y in zip(packing.WEIGHTS, left, need)))
        chosen, offset = fast.place(length)
        if not costs:
            assert chosen == len(sequences)
            sequences.append(([1.0, 1.0, 1.0], 0))
        else:
            assert costs[chosen] <= min(costs.values()) + 1e-12  # sums of floats may part equal ones
        left, used = sequences[chosen]
        assert offset == used
        sequences[chosen] = [x - y for x, y in zip(left, need)], used + length


def test_tokens_of_odd_texts():
    """Texts learned together, one by one, and by the tokenizer itself."""
    from tokenizers import Tokenizer
    path = tokenizer_file(WORD_BPE)
    whole = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = ["", " ", "don't WE'LL straße ÉTÉ 12,345 x_y", "<|endoftext|> a", "北京 text", "a" * 500 + " " + "b!" * 300,
             *["".join(rng.choices("abcABCéÉß '!?._-0123456789\n\t", k=400)) for _ in range(60)]]
    tokens = packing.WordTokens(path)
    assert tokens.direct
    expected = [whole.encode(text, add_special_tokens=False).ids for text in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in tokens.ids(texts)] == expected
    assert [np.frombuffer(tokens.ids([text])[0], "<u4").tolist() for text in texts] == expected
    assert max(map(len, tokens.known)) <= packing.LONG_WORD


def test_language_of_odd_rows(spark, trained, odd_documents, odd_rows, no_documents):
    rows = language_id.predict(odd_documents, trained).collect()
    assert len(rows) == len(odd_rows)
    unknown = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert unknown == {4, 5, 6, 12, None} and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert language_id.identify(no_documents).count() == 0
    one = spark.createDataFrame([(1, "abc def", "en"), (2, "ghi", None), (3, "?", "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(one).collect()} <= {"en", "und"}


def test_rows_without_language_go(spark, odd_documents, odd_rows):
    documents = odd_documents.drop("lang").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    kept = language_id.with_language(documents)
    assert kept.columns == documents.columns
    letters = [row for row in odd_rows if row[1] and any(map(str.isalpha, row[1]))]
    assert kept.count() == len(letters)
    unlabelled = documents.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.with_language(unlabelled).count() == len(letters)


# --- fingerprints ------------------------------------------------------------


def phrase_set(data):
    """Lempel-Ziv phrases by slices and a set."""
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def plain_print(text):
    import xxhash
    return sorted({xxhash.xxh32_intdigest(p) for p in phrase_set(text.encode())})[:lz_fingerprints.LEAST]


def plain_rows(rows):
    ordered = sorted(rows, key=lambda r: (-2**63 if r[0] is None else r[0], r[1] is not None, (r[1] or "").encode()))
    result = []
    for at, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        cut = len(text) // 2
        changed = text[:len(text) - cut] + following[:cut]
        one, two, three = plain_print(text), plain_print(changed), plain_print(following)

        def near(a, b):
            least = sorted(set(a) | set(b))[:lz_fingerprints.LEAST]
            return len(set(least) & set(a) & set(b)) / len(least) if least else 1.0

        text_of = lambda hashes: "".join(f"{h:08x}" for h in hashes)
        result.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), text_of(one), text_of(two), near(one, two), near(one, three)))
    return sorted(result, key=str)


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_fingerprints(spark, odd_documents, odd_rows, no_documents, partitions, monkeypatch):
    size = sum(len((text or "").encode()) for _, text in odd_rows)
    monkeypatch.setattr(lz_fingerprints, "RANGE_BYTES", size // int(partitions) + 1)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(tuple, lz_fingerprints.compared(odd_documents).collect()), key=str)
        assert [(*g[:5], *(round(x, 9) for x in g[5:])) for g in got] == [
            (*g[:5], *(round(x, 9) for x in g[5:])) for g in plain_rows(odd_rows)]
        assert lz_fingerprints.compared(no_documents).count() == 0
        one = spark.createDataFrame([(5, "abcabcabd")], "doc_id long, text string")
        assert sorted(map(tuple, lz_fingerprints.compared(one).collect())) == plain_rows([(5, "abcabcabd")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_fingerprints_of_a_table(spark, folder):
    documents = read_table(spark, folder, "documents")
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted(map(tuple, lz_fingerprints.compared(documents).collect()), key=str)
    assert [g[:5] for g in got] == [g[:5] for g in plain_rows(rows)]
    assert np.mean([g[5] for g in got]) > np.mean([g[6] for g in got]) + 0.15


# --- decontamination ---------------------------------------------------------

ITEMS = [
    (1, "Anna has 12 apples and gives 5 of them to her friend Peter before she walks 3 km home from school."),
    (2, "what is the name of the long river that runs through the old town"),
    (3, "six words of a short one"),
    (4, "too short"), (5, None), (6, ""),
    (7, "the box holds 4 kg of flour and again 4 kg of sugar so the whole load weighs 8 kg in the end"),
    (7, "the box holds 4 kg of flour and again 4 kg of sugar so the whole load weighs 8 kg in the end"),
]
TEXTS = [
    (1, f"Something before it. {ITEMS[0][1]} And after."),
    (2, "x y z Anna has 31 apples and gives 7 of them to her friend Maria Lopez before she walks 9 miles home from school."),
    (3, "WHAT IS THE NAME OF THE LONG RIVER THAT RUNS THROUGH THE OLD TOWN"),
    (4, "what is the name of the long river near the small town"),
    (5, "note: six words of a short one indeed"), (6, "too short"), (7, None), (8, ""),
    (9, "the box holds 5 kg of flour and again 5 kg of sugar so the whole load weighs 10 kg in the end"),
    (10, "the box holds 5 kg of flour and again 6 kg of sugar so the whole load weighs 10 kg in the end"),
    (None, ITEMS[1][1]), (11, ITEMS[1][1] + " . " + ITEMS[1][1]), (11, ITEMS[1][1] + " . " + ITEMS[1][1]),
    (12, "filler " * 30_000 + ITEMS[1][1]), (13, "the the the the the the the the 1 2 3 4 5 6 7 8 9"),
]
LEAKING = {(1, 1), (2, 1), (3, 2), (5, 3), (6, 4), (9, 7), (None, 2), (11, 2), (12, 2)}  # 6: a line of its own


@pytest.mark.parametrize("broadcast", [True, False])
def test_leaks(spark, request, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    documents = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns(
        {name: F.lit("x") for name in ("hash", "raw", "template", "line", "item_id", "places", "uses", "n_chars")})
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("length", F.lit(1))
    rows = decontamination.leak_report(documents, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == LEAKING and len(rows) == len(LEAKING)
    changed = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in rows}
    assert changed[(1, 1)] == 0 and changed[(2, 1)] >= 4 and changed[(9, 7)] == 3
    kept = decontamination.without_leaks(documents, benchmark)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {4, 7, 8, 10, 13}
    assert decontamination.leak_report(documents.limit(0), benchmark).count() == 0
    assert decontamination.leak_report(documents, benchmark.limit(0)).count() == 0


def test_leaks_of_a_table(spark):
    folder = "/root/testdata/sf0.01"
    documents, benchmark = read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    items = [(r["item_id"], r["text"].strip()) for r in benchmark.collect()]
    holding = {(r["doc_id"], item) for r in documents.collect() for item, text in items if text in r["text"]}
    rows = decontamination.leak_report(documents, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == holding and holding


def test_leak_plan_is_native(spark, folder):
    matches = decontamination.leak_report(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
