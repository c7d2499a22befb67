"""The corpus operators on small tables, against brute force, with nulls, empty and long texts, ties and extra columns."""

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import common, decontamination, exact_dedup, id_files, language_id, near_dup, packing, personal_data, queries, sharding, substring_dedup, toxicity
from skein.llm.common import text_blocks
from skein.llm.queries import tokenizer_file
from skein.llm.tokens import Memo, word_encoder
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, node long, row string, sha string, body string, start int, n int"


def texts(n=60, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta.", "eps", "zeta", "eta", "theta", "über", "mañana"]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and out:
            t = rng.choice(out)
            w = (t or "").split(" ")
            if rng.random() < 0.6 and len(w) > 3:
                w[rng.randrange(len(w))] = f"new{i}"
            t = " ".join(w)
        else:
            t = rng.choice([" ", "\n", "  "]).join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 120)))
        out.append(t)
    return out + [None, "", " \n ", "x", "a b", "A B", "run " * 40, "run " * 41, ("long " + "word%d " * 5) * 200 % tuple(range(1000))]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns clash with names that the operators use inside."""
    full = [(d, t, "en" if d % 2 else None, None if d % 7 == 0 else f"s{d % 3 // 2}", d, "r", "h", "b", 1, 2) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def test_exact_groups(docs, rows):
    got = exact_dedup.exact_groups(docs).toPandas().set_index("doc_id")
    groups = {}
    for d, t in rows:
        groups.setdefault(brute.lower(t), []).append(d)
    for t, ds in groups.items():
        for d in ds:
            assert (got.loc[d].keep_id, got.loc[d].group_size, got.loc[d].kept) == (max(ds), len(ds), d == max(ds))
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(max(x) for x in groups.values())


def test_exact_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.exact_groups(df).toPandas()
    assert got.kept.sum() == 2 and got.group_size.tolist().count(3) == 3
    assert exact_dedup.drop_exact_copies(df).count() == 2


@pytest.mark.parametrize("n, bits", [(0, 20), (1, 16), (1000, 24), (5000, 63)])
def test_rice_round_trip(n, bits):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint64))
    assert (exact_dedup.rice_decode(exact_dedup.rice_encode(values, bits)) == values).all()


def test_shards(docs, rows):
    got = sharding.interleave_shards(docs, shards=5, buckets=8).toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == len(rows) and counts.max() - counts.min() <= 1 and set(got.law) == {"rows"}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    by = got.assign(source=got.source.fillna("none")).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (by.max(axis=1) - by.min(axis=1) <= 2).all()
    import zlib

    for r in got.itertuples():
        t = (rows[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups(docs, rows, k):
    want = brute.near(rows, k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_groups(docs, k=k).collect()}
    assert got == want


def test_near_second_pass_in_blocks(spark, monkeypatch):
    """Copies of one text with edits: many share buckets and few are linked; small blocks must find the same links."""
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 7)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(80):
        w = list(base)
        for _ in range(rng.randrange(2, 8)):
            w[rng.randrange(60)] = f"e{d}x{rng.randrange(9)}"
        rows.append((d, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == brute.near(rows, 2)


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 54, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:600], rng.integers(0, 1 << 54, 300).astype(np.uint64)]))
    s = near_dup.superminhash(np.concatenate([a, b, a[:3]]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 3]), 256)
    true = 600 / (len(a) + len(b) - 600)
    assert abs((s[0] == s[1]).mean() - true) < 0.1 and (s != near_dup.EMPTY).all()
    assert sorted((s[2] >> np.uint64(32)).tolist()) == sorted((s[2] >> np.uint64(32)).tolist())


def test_substrings(docs, rows):
    want = brute.substrings(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, owner_bytes=4000).collect()}
    assert got == want


def test_substrings_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (7, t + " end")], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 0), (5, 0), (5, 0), (7, 30)], key=str)


def test_packing(docs, rows):
    path = queries.tokenizer_file()
    want = brute.token_ids(path, rows, 2)
    got = packing.pack_sequences(docs, path, capacity=256, piece=64, windows=4).toPandas()
    for r in got.itertuples():
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and brute.crc_ids(ids[r.start : r.start + r.length]) == r.ids_crc32
    for d, g in got.sort_values("start").groupby("doc_id"):
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(want[d])
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256


def test_differencing():
    sizes = np.array([8, 7, 6, 5, 4])
    where, sums = packing.differencing(sizes, 2)
    assert sorted(sums.tolist()) == [14, 16] and [sizes[where == i].sum() for i in (0, 1)] == sums.tolist()


def test_token_files(docs, rows):
    path = queries.tokenizer_file()
    want, at = brute.token_ids(path, rows, 1), 0
    for r in sorted(id_files.token_round_trip(docs, path).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want[r.doc_id]), brute.crc_ids(want[r.doc_id]))
        at += r.n_tokens


@pytest.mark.parametrize("n, block", [(0, 64), (1, 64), (64, 64), (65, 64), (5000, 512)])
def test_coder_round_trip(n, block):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 30, n), rng.integers(0, 1 << 18, n)).astype(np.uint32)
    assert (id_files.decode_blocks(id_files.encode_blocks(ids, block), n, block) == ids).all()


def test_damage_is_noticed():
    ids = np.arange(3000, dtype=np.uint32)
    content = bytearray(id_files.write_file(np.array([1]), np.array([3000]), ids))
    content[-40] ^= 1
    with pytest.raises(ValueError):
        id_files.read_file(bytes(content))


def test_personal_data(spark):
    cases = ["a.b+c@x-y.co.uk_d@e.fr +1 (017) 555-7713.", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8", "card 4539 1488 0343 6467 1234-5678-9012 é 4539148803436467", None, "", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "@someone +123456789012345678 000-12-3456", "1" * 5000]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    import hashlib

    for r in personal_data.find_personal_data(df).collect():
        base = brute.personal(cases[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[2] == k for b in base) for k in brute.PATTERNS]
        assert set(f"{k}:{s}:{e}" for s, _, k, e in base) <= set(r.spans.split(","))


def test_language(spark):
    rng = random.Random(2)
    make = lambda lang: " ".join(rng.choice({"en": ["the", "house", "with"], "de": ["das", "haus", "über"]}[lang]) for _ in range(12))
    rows = [(i, make("en" if i % 2 else "de"), None if i == 3 else "en" if i % 2 else "de") for i in range(80)] + [(100, None, "en"), (101, "12 34", "de"), (102, "", None)]
    got = {r.doc_id: r for r in language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(80)) and {got[i].lang_pred for i in (100, 101, 102)} == {"und"}


def test_language_of_a_text_alone(spark):
    """A score doesn't depend on the texts beside it, nor on how rows are dealt."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["the", "house", "das", "haus", "über"]) for _ in range(rng.randrange(0, 9))), rng.choice(["en", "de"])) for i in range(60)]
    schema = "doc_id long, text string, lang string"
    model = language_id.fit_languages(spark.createDataFrame(rows, schema))
    none = F.lit(False)
    want = {r.doc_id: r.score for r in language_id.predict_languages(spark.createDataFrame(rows, schema).coalesce(1), model, none).collect()}
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert want == {r.doc_id: r.score for r in language_id.predict_languages(spark.createDataFrame(shuffled, schema).repartition(7), model, none).collect()}
    for row in rows[:3]:
        assert want[row[0]] == language_id.predict_languages(spark.createDataFrame([row], schema), model, none).first().score
    again = language_id.fit_languages(spark.createDataFrame(shuffled, schema).repartition(5))
    assert (again["logs"] == model["logs"]).all()


def test_language_by_brute_force(spark):
    """Naive Bayes over the same buckets, with plain loops."""
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 12))), rng.choice(["x", "y"])) for i in range(30)]
    bits = 8

    def grams(text):
        points = [0, *map(ord, text.lower()), 0, 0]
        for n in (1, 2, 3):
            for i in range(len(text) + 1):
                yield int(next(language_id.gram_buckets(np.array(points[i : i + n], np.uint32), (n,), bits))[0])

    counts = {lang: np.zeros(1 << bits) for lang in "xy"}
    for _, t, lang in rows:
        for g in grams(t):
            counts[lang][g] += 1
    logs = {lang: np.log((c + 0.5) / (c + 0.5).sum()) for lang, c in counts.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict_languages(df, language_id.fit_languages(df, bits=bits), F.lit(False)).collect()
    for r in got:
        text = rows[r.doc_id][1]
        if not any(c.isalpha() for c in text):
            assert r.lang_pred == "und"
            continue
        total = {lang: sum(x[g] for g in grams(text)) for lang, x in logs.items()}
        assert total[r.lang_pred] >= max(total.values()) - 1e-4 and abs(r.score - 1 / sum(np.exp(v - max(total.values())) for v in total.values())) < 1e-4


def test_personal_data_of_unbroken_runs():
    """A megabyte without a gap takes no more than seconds, and long zeros before an ip don't crash."""
    import time

    n = 10**6
    assert personal_data.base_spans("0" * 5000 + ".1.1.1") == [(0, 1, 5006)]
    for text in ("1" * n, "a" * n, "@" + "a-" * (n // 2), "a-" * (n // 2), "+1" + " " * n, "a" * n + "@b.c"):
        began = time.time()
        base = personal_data.base_spans(text)
        personal_data._more(text, base)
        assert time.time() - began < 10
    assert base == [(0, 0, n + 4)]


def test_personal_weights_are_free_of_scale():
    patterns = [(k, v * personal_data.SHAPES + s, 1 + (k * 7 + v + s) % 50) for k in range(5) for v in (3, 364, 700) for s in (0, 17, 200)]
    one, _ = personal_data.train_spans(patterns)
    many, _ = personal_data.train_spans([(k, v, 1000 * n) for k, v, n in patterns])
    assert all(abs(one[x] - many[x]) < 1e-6 for x in one)


def test_stages_with_clashing_names(spark):
    """Columns named like the stages' own survive, in any case."""
    rng = random.Random(14)
    t = " ".join(f"w{rng.randrange(999)}" for _ in range(40))
    schema = "doc_id long, text string, lang string, _gone long, _hash long, _sha string, key_0 long, KEY_1 long, node long, sha string"
    docs = spark.createDataFrame([(i, x, "en", 1, 2, "s", 3, 4, 5, "h") for i, x in enumerate([t, t.upper(), t + " end", None, "", "other words"])], schema)
    bench, labels = spark.createDataFrame([(1, "other words of which there are eight in all")], "item_id long, text string"), spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    for out, ids in ((exact_dedup.drop_exact_copies(docs), [1, 2, 4, 5]), (near_dup.drop_near_copies(docs), [0, 3, 4, 5]), (decontamination.drop_contaminated(docs, bench), list(range(6))), (toxicity.drop_toxic(docs, labels), None)):
        assert out.schema == docs.schema
        if ids is not None:
            assert sorted(r.doc_id for r in out.collect()) == ids


def test_stages_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    for out in (exact_dedup.drop_exact_copies(docs), near_dup.drop_near_copies(docs), decontamination.drop_contaminated(docs, bench), toxicity.drop_toxic(docs, labels)):
        assert out.count() == 0 and out.columns == docs.columns


def test_shards_by_brute_force(docs, rows):
    """The same ranks and cuts from plain sorting."""
    import hashlib
    from fractions import Fraction

    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    text = dict(rows)
    order = sorted(sources, key=lambda d: hashlib.md5(f"11:{d}:{zlib.crc32((text[d] or '').encode())}".encode()).hexdigest())
    size, rank, place = {}, {}, []
    for d in order:
        size[sources[d]] = rank[d] = size.get(sources[d], 0) + 1
    place = sorted(order, key=lambda d: (Fraction(2 * rank[d] - 1, 2 * size[sources[d]]), sources[d] is not None, sources[d] or "", order.index(d)))
    n, shards = len(place), 5
    want = {d: (i * shards // n, i - -(-(i * shards // n) * n // shards)) for i, d in enumerate(place)}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave_shards(docs, shards=shards, buckets=8).collect()} == want


def test_shards_null_and_repeated_ids(spark):
    """The contract's columns in its order; rows without an id, and many of one id, are spread like others."""
    full = [(None, f"t{i}", "a") for i in range(40)] + [(7, f"u{i}", "b") for i in range(40)] + [(7, "same", None)] * 3
    got = sharding.interleave_shards(spark.createDataFrame(full, "doc_id long, text string, source string"), shards=4, buckets=16)
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    table = got.toPandas()
    counts = table.groupby("shard").size()
    assert len(table) == 83 and counts.max() - counts.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in table.groupby("shard"))
    mix = table[table.doc_id.isna()].groupby("shard").size()
    assert mix.max() - mix.min() <= 2  # proportional, though not to the row


def test_network_by_brute_force():
    """Logits by plain loops, and the step's gradient against differences."""
    rng = np.random.default_rng(3)
    network = toxicity.Network(dim=3, filters=2, seed=1)
    one, two = rng.integers(0, 1 << toxicity.BITS, 12), rng.integers(0, 1 << toxicity.BITS, 12)
    first = np.array([0, 5, 5, 7, 12])
    proof = np.where(rng.random(12) < 0.4, rng.normal(size=12), 0).astype(np.float32)

    def plain(i):
        total, at = float(network.shift), 0
        x = [np.append(network.tables[0][a] + network.tables[1][b], e) for a, b, e in zip(*(v[first[i] : first[i + 1]] for v in (one, two, proof)))]
        for w, f, bias in zip(toxicity.WIDTHS, network.filters, network.bias):
            for k in range(f.shape[2]):
                places = [sum(float(x[p + j] @ f[j][:, k]) for j in range(w)) + float(bias[k]) for p in range(len(x) - w + 1)]
                total += max(0.0, max(places, default=0.0)) * float(network.out[at + k])
            at += f.shape[2]
        return total

    got = toxicity.logits(network, network.folded(), one, two, proof, first)
    assert np.allclose(got, [plain(i) for i in range(4)], atol=1e-5)
    before = network.out.copy()
    y = np.array([1, 0, 1, 0], np.float32)
    loss = lambda: float(np.log1p(np.exp(-np.where(y > 0, 1, -1) * np.array([plain(i) for i in range(4)]))).mean())
    slope = []
    for k in range(len(before)):
        network.out = before.copy()
        network.out[k] += 1e-2
        up = loss()
        network.out[k] -= 2e-2
        slope.append((up - loss()) / 2e-2)
    network.out = before.copy()
    network.step(one, two, proof, first, y, np.ones(4, np.float32), 1e-3, np.ones(12, np.float32))
    moment = network.moments["out", None][0] / 0.1
    assert np.allclose(moment, slope, atol=2e-3)


def test_toxicity(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 40))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["Awful,", "nasty"])
        rows.append((i, " ".join(w), "en"))
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(900, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas()
    held = got[got.held_out & (got.doc_id < 400)]
    assert ((held.predicted == 1) == (held.doc_id % 4 == 0)).mean() > 0.95
    assert got.score.between(0, 1).all() and len(got) == 402
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 290 <= kept.count() <= 310


def test_toxicity_by_language(spark):
    """Toxic words that only a dozen texts of a language have are learnt in each of three languages; evidence of rare words is shrunk."""
    rng = random.Random(8)
    rows, bad = [], {"en": "vile", "de": "schlimm", "fr": "affreux"}
    for i in range(1800):
        lang = ("en", "en", "en", "en", "de", "fr")[i % 6]
        w = [f"{lang}{rng.randrange(400)}" for _ in range(rng.randrange(20, 80))]
        if i % 7 == 0:
            w[rng.randrange(len(w))] = bad[lang] + rng.choice("ab")
        rows.append((i, " ".join(w), lang, int(i % 7 == 0)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    got = toxicity.toxicity(docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")).toPandas().set_index("doc_id")
    for lang in bad:
        mine = [(r[3], got.loc[r[0]].predicted) for r in rows if r[2] == lang and got.loc[r[0]].held_out]
        hits = [p for y, p in mine if y]
        assert np.mean(hits) >= 0.8 and np.mean([p for y, p in mine if not y]) <= 0.05, (lang, len(hits))
    few = toxicity.Evidence([np.array([1, 2], np.uint64), np.array([1, 3], np.uint64), np.array([4], np.uint64), np.array([4, 2], np.uint64)], np.array([1, 1, 0, 0.0]))
    assert few.of(np.array([1, 3, 4, 2, 9], np.uint64)).tolist() == pytest.approx([np.log(3), np.log(2), 0, 0, 0])
    none = toxicity.Evidence([np.array([1], np.uint64)], np.array([1.0]))
    assert none.of(np.array([1], np.uint64)).tolist() == [0]


def test_contamination(spark):
    rng = random.Random(5)
    vocabulary = [f"term{i}" for i in range(3000)]
    item = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [item(rng.choice([16, 40, 60])) for _ in range(20)]
    rows, want = [], set()
    for d in range(120):
        w = item(rng.randrange(40, 200))
        if d % 6 == 0:
            q = d // 6
            leak = list(items[q])
            if d % 12 == 0:  # a paraphrase: one term in ten is another
                leak = [x if j % 10 else "other" for j, x in enumerate(leak)]
            at = rng.randrange(len(w))
            w[at:at] = leak
            want.add((d, q))
        rows.append((d, " ".join(w)))
    rows += [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows += [(600, "this is Too, short"), (601, "too very short"), (602, "one two three four five six")]
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (90, None), (91, "too short"), (92, "two three four FIVE six"), (93, "")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want |= {(600, 91), (602, 92)}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated_pairs(docs, bench, block=16).collect()}
    assert got == want
    assert decontamination.drop_contaminated(docs, bench).count() == len(rows) - len(want) + 1  # two words are no leak


def test_aligned():
    rng = random.Random(6)
    for _ in range(300):
        x, y = ([rng.randrange(6) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        bits = decontamination.aligned(x, y)
        assert bits.bit_count() == decontamination.common_subsequence(x, y)
        at = iter(y)
        assert all(v in at for i, v in enumerate(x) if bits >> i & 1)


def test_contamination_by_quotations(spark):
    """Quotations of over half of an item are found wherever they start in the item and in the document; fifths are not."""
    rng = random.Random(7)
    vocabulary = [f"term{i}" for i in range(3000)]
    item = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [item(n) for n in (12, 24, 25, 30, 40, 60, 100)]
    rows, want = [], set()
    for q, x in enumerate(items):
        for n, leak in ((len(x) // 2 + 2, True), (-(-len(x) * 3 // 4), True), (len(x) // 5, False)):
            for start in range(len(x) - n + 1):
                w = item(rng.randrange(40, 100))
                at = rng.randrange(len(w))
                quoted = x[start : start + n]
                if n > 40 and 4 * n >= 3 * len(x) and start % 2:  # a paraphrase: one term in ten is another
                    quoted = [v if j % 10 != 9 else "other" for j, v in enumerate(quoted)]
                w[at:at] = quoted
                if leak:
                    want.add((len(rows), q))
                rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated_pairs(docs, bench, block=5).collect()}
    assert got == want


def test_contamination_of_many_copies(spark):
    """A passage that a third of the rows copy is a leak in each of them, not stop words."""
    rng = random.Random(8)
    vocabulary = [f"term{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (20, 40, 60)]
    rows = []
    for d in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 40) if d % 3 == 0 else rng.randrange(20, 60))]
        if d % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = items[0]
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, " ".join(items[1])) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated_pairs(docs, bench).collect()}
    assert got == {(d, 0) for d in range(0, 600, 3)} | {(1000 + d, 1) for d in range(300)}


def test_drops_with_null_and_repeated_ids(spark):
    """Only the copies and the contaminated texts go, not other texts of their ids."""
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(999)}" for _ in range(60)) for x in "abcd")
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(5, a), (None, a + " end"), (None, b), (None, None), (9, a + " tail"), (9, c), (7, d)], schema)
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(near_dup.drop_near_copies(docs).collect()) == order([(5, a), (None, b), (None, None), (9, c), (7, d)])
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert order(decontamination.drop_contaminated(docs, bench).collect()) == order([(None, b), (None, None), (9, c), (7, d)])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    path = queries.tokenizer_file()
    for out in (exact_dedup.exact_groups(docs), sharding.interleave_shards(docs), near_dup.near_groups(docs), substring_dedup.remove_repeats(docs), packing.pack_sequences(docs, path),
                id_files.token_round_trip(docs, path), personal_data.find_personal_data(docs), language_id.identify_languages(docs), toxicity.toxicity(docs, labels), decontamination.contaminated_pairs(docs, bench)):
        assert out.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, kept = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        old = [(r.doc_id, r.text) for r in before.collect()]
        assert ids <= {d for d, _ in old}
        if name == "exact_dedup":
            last = {}
            for d, t in old:
                last[brute.lower(t)] = max(d, last.get(brute.lower(t), -1))
            assert ids == set(last.values())
        if name == "near_dedup":
            assert ids == {c for _, c in brute.near(old, 5).values()}
        before, kept = common.Scratch(spark).stash(after, name), ids
    packed = corpus_pipeline.STAGES[-1][1](spark, before, folder).toPandas()
    assert set(packed.doc_id) == kept


def test_units_against_the_library():
    """Cutting words into units gives the ids that the library gives for the whole text."""
    rng = random.Random(3)
    pool = "abcXYZ éÉßñÿĀıİŉſŒ×÷ª«»–—…'’.,!?-_09٣½ \t\n\x0b\x1c\x7f\x85 ́中文кКΣσς<|>endoftextS't𝒳😀ﬁ​　"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", None, "<|endoftext|>", "x<|endoftext|>y <|ENDOFTEXT|>.", "it's IT'S we'LL 'tis !'s ''s", "word, Word... 2024-11-02"]
    encoder, whole = word_encoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    assert encoder.split
    for lo, hi, data, at in text_blocks(pa.array(texts, pa.string())):
        ids, counts = encoder.encode(data, at)
        expected = whole.encode_batch([x or "" for x in texts[lo:hi]], add_special_tokens=False)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.ids for x in expected]


def test_toxicity_sample(spark):
    """At most so many ids of either label, those that hash lowest; repeated rows and null labels add none."""
    docs = spark.createDataFrame([(i % 200, f"w{i}") for i in range(400)] + [(None, "x"), (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0) if i != 7 else None) for i in range(200)] + [(0, 1), (500, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.sample_ids(docs, labels, "doc_id", "text", "toxic", 30)
    order = {r.doc_id: r.h for r in labels.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    for label in (0, 1):
        want = sorted((i for i in range(200) if i != 7 and int(i % 4 == 0) == label), key=order.get)[:30]
        assert sorted(i for i, y in got if y == label) == sorted(want)
    few = toxicity.sample_ids(docs, labels, "doc_id", "text", "toxic", 30, most_bytes=40)
    assert 0 < len(few) < len(got) and set(few) <= set(got)


def test_memo_numbers_hashes_in_order():
    rng = np.random.default_rng(3)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 30_000, np.uint64), np.arange(50, dtype=np.uint64)]))  # the small ones share a home
    rng.shuffle(hashes)
    memo = Memo()
    for part in np.array_split(hashes[:20_000], 7):
        assert (memo.find(part) == -1).all()
        memo.add(part)
    assert (memo.find(hashes) == np.where(np.arange(len(hashes)) < 20_000, np.arange(len(hashes)), -1)).all()
    assert len(memo.find(hashes[:0])) == 0


@pytest.mark.parametrize("block", [1, 7, 2048, 9000])
def test_coder_round_trips_in_blocks_of_any_size(block):
    rng = np.random.default_rng(block)
    ids = np.concatenate([np.full(9500, 49_000), rng.integers(0, 1 << 18, 500), rng.zipf(1.3, 9000) % 49_152, [0, (1 << 18) - 1]]).astype(np.int64)
    assert (id_files.decode_blocks(id_files.encode_blocks(ids, block), len(ids), block) == ids).all()
