"""Conversation repair, byte-level BPE and hard negatives against brute force."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from skein.llm import byte_bpe, conversation_repair, hard_negatives, queries
from skein.llm.queries import tokenizer_file
from tests.llm import brute

CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, piece int, mark int"


def conversations(seed, n=25, longest=12):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "why", "a b?", " ", "", None, " ", "x" * 50, "Was\nist.\t", "日本。"])
            out.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
        if rng.random() < 0.3:
            out += rng.choices(out[-3:], k=rng.randrange(1, 5))
    return out + [(None, 0, "user", "Hi."), (None, None, None, None), (77, None, "user", "Hi."), (78, 2**40, "assistant", "long " * 20000 + ".")]


def expected(rows):
    return {conv: brute.repaired(x) for conv, x in brute.damaged(rows).items()}


def repair(spark, rows, **options):
    table = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], CONVERSATIONS).repartition(3)
    pieces = conversation_repair.repair_conversations(queries.damaged_conversations(table), copies="copies", **options)
    return {r.conv_id: tuple(r)[1:] for r in conversation_repair.conversation_digests(pieces).collect()}, pieces


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"piece_rows": 1, "partitions": 9}), (3, {"piece_rows": 3, "piece_bytes": 60, "partitions": 20})])
def test_repair(spark, seed, options):
    rows = conversations(seed)
    want = expected(rows)
    got, _ = repair(spark, rows, **options)
    assert got == want and any(x[6] for x in want.values())


def test_repair_hot_conversation(spark):
    """One conversation has most rows, and most of them are one repeated row."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{t % 60}{rng.choice('.!?x')}") for t in range(300)] + [(1, 7, "user", "Same.")] * 200 + [(2, 0, "user", "a.")] + [(1, t, "user", "Ok.") for t in range(0, 300, 2)]
    # brute force's grammar check is quadratic, so the reference is the same search on states
    got, pieces = repair(spark, rows, piece_rows=16, partitions=6)
    once, _ = repair(spark, rows, piece_rows=10**6, partitions=1)
    assert got == once and set(got) == {1, 2}
    assert pieces.filter("conv_id = 1").count() > 20
    made = conversation_repair.repaired_turns(pieces).filter("conv_id = 1").orderBy("piece", "place").collect()
    assert "".join(r.role[0] for r in made) == "ua" * (len(made) // 2)
    assert got[1][7] == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in made).encode()).hexdigest()


def test_repair_no_rows(spark):
    table = spark.createDataFrame([], CONVERSATIONS)
    assert conversation_repair.conversation_digests(conversation_repair.repair_conversations(table)).collect() == []
    lost = spark.createDataFrame([(5, 1, "user", "a", 0)], "conv_id long, turn long, role string, text string, copies int")
    got = conversation_repair.conversation_digests(conversation_repair.repair_conversations(lost, copies="copies")).first()
    assert tuple(got) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


RANKS = tokenizer_file("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts():
    rng = random.Random(3)
    alphabets = ["ab", "etaoin shrdlu", "\t \n\r\x0b　", "0123456789.,", "日本語中文漢字カナ", "ßéüàçñ ", "😀👩‍👩‍👧 ", "'sdmt ", "=-_#*", "абвгд ", "مرحبا ", "́​\x00\x1c\x85a"]
    out = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 400))) for a in alphabets for _ in range(8)]
    return out + ["", None, " ", "don't  stop", "<|endoftext|> x", "a" * 3000, "=" * 1000, "".join(rng.choice("etaoinshr") for _ in range(6000))]


def test_byte_bpe(spark, library):
    rows = list(enumerate(some_texts())) + [(None, "null id"), (3, "again")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ids string, bytes int").repartition(3)
    tokens = byte_bpe.encode_bytes(docs, RANKS, public_tokenizers.PATTERN)
    want = sorted((d is None, d or 0, library.encode_ordinary(t or "")) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in tokens.collect()) == want
    back = byte_bpe.decode_bytes(tokens, RANKS, public_tokenizers.PATTERN)
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in back.collect()) == sorted((d or 0, (t or "").encode()) for d, t in rows)
    digests = {r.doc_id: r for r in byte_bpe.token_digests(tokens.filter("doc_id <> 3"), RANKS, public_tokenizers.PATTERN).collect()}
    for d, t in rows[4:-2]:
        ids = library.encode_ordinary(t or "")
        assert digests[d].n_tokens == len(ids) and digests[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_bytes(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_long_and_bounded(library, monkeypatch):
    """Both ways of merging agree with the library; texts of many pieces go bit by bit; a full memo starts anew."""
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "PIECES", 7)
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 200)
    texts = [t or "" for t in some_texts()]
    ids, count = bpe.encode(texts)
    assert np.array_equal(ids, np.array([i for t in texts for i in library.encode_ordinary(t)])) and count.tolist() == [len(library.encode_ordinary(t)) for t in texts]
    rng = random.Random(9)
    for size in (2, 3, 17, 60, 256):
        for letters in ("ab", "etaoinshrdlu", "aé日", "xyzqjk"):
            pieces = [("".join(rng.choice(letters) for _ in range(size))).encode()[:256] for _ in range(30)]
            rows = [bpe.byte_ids[np.frombuffer(p, np.uint8)] for p in pieces]
            block = np.full((len(rows), 256), -1, np.int32)
            for i, r in enumerate(rows):
                block[i, : len(r)] = r
            flat, n = bpe.merge_matrix(block)
            assert flat.tolist() == [i for p in rows for i in bpe.merge_long(p).tolist()]
    million = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert bpe.encode([million])[0].tolist() == library.encode_ordinary(million)


VECTORS = "vec_id long, embedding array<float>, label int, id long, norm double, block long"


def vectors(seed, n=300, width=6, labels=4, spread=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=width) * (rng.exponential() if spread else 1)
        if i % 9 == 0:
            v = np.ones(width) * 0.25  # many equal vectors
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(labels) ** 2 // 3)))
    return rows


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], VECTORS).repartition(3)
    got = hard_negatives.mine_hard_negatives(table, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"bucket_rows": 7, "block_rows": 3, "slice_rows": 40}), (3, {"bucket_rows": 1, "block_rows": 1, "slice_rows": 100, "partitions": 5})])
def test_hard_negatives(spark, seed, options):
    odd = [(None, [1.0] * 6, 1), (50, [0.5] * 6, 1), (50, [0.5] * 6, 1), (400, [0.25, 0.25], 0), (450, [], 1), (500, None, 1), (550, [1.0, None], 1), (600, [float("nan")] * 6, 1), (650, [1.0] * 6, None), (-50, [0.3] * 7, 0), (700, [float("inf")], 2)]
    rows = vectors(seed) + odd
    want = brute.hard_negatives(rows)
    assert mined(spark, rows, **options) == want and len(want) > 50


def test_hard_negatives_large_values_and_none(spark):
    """Scores beyond 2^53 are exact; one label, one row and no rows give nothing."""
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(size=3) * 3e5], i % 3) for i in range(60)]
    assert mined(spark, rows, every=10) == brute.hard_negatives(rows, every=10)
    assert mined(spark, [(0, [3e38, -3e38], 1), (1, [3e38, 3e38], 1), (2, [1.0, 1.0], 2)]) == [(0, 1, 1, 2, 0, 0)]
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, []) == []


def test_hard_negatives_prunes_by_norm(spark, monkeypatch):
    """Buckets whose norms can't reach a window's lower limit are not multiplied."""
    matrix = np.arange(12.0).reshape(4, 3)
    assert (hard_negatives.inner(matrix, matrix, 1e3) == matrix @ matrix.T).all() and (hard_negatives.inner(matrix, matrix, 1e18) == matrix @ matrix.T).all()
    best = hard_negatives.Best(2, 2, np.float64)
    best.offer(np.array([0, 1]), np.array([[1.0, 5, 5, 5], [-np.inf, 2, -np.inf, 0]]), np.array([3, 4, 6, 9]))
    best.offer(np.array([0]), np.array([[5.0, 5.0]]), np.array([5, 1]))
    assert best.id[0].tolist() == [1, 4] and best.score.tolist() == [[5, 5], [2, 0]] and best.id[1].tolist() == [4, 9]
