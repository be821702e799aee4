import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, keep_id long, rank int"


def documents(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 7, 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, ties, a very long text, and copies."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(1, None), (2, ""), (3, "   \n"), (4, base), (5, base.upper()), (5, base.upper()), (6, "short"), (7, "Été SHORT"), (8, "été short"), (9, base + " phi"), (10, "w" * 50 + (" lorem ipsum dolor" * 20_000)), (11, "w" * 50 + (" lorem ipsum dolor" * 20_000)), (12, "a\tb\x0bc d"), (None, "nobody")]
    return documents(spark, rows), rows


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def thue_morse():
    """Two words that every polynomial hash modulo 2 ** 64 takes for one another."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_word_hashes_tell_thue_morse_words_apart():
    from polyadic.llm.textarrays import word_hashes

    x, y = thue_morse()
    found = word_hashes(np.frombuffer(f"{x} {y} {x} ab ba".encode(), np.uint8))
    assert len(set(found.tolist())) == 4 and found[0] == found[2]


def test_coders_tell_thue_morse_words_apart(spark):
    from tokenizers import Tokenizer

    from polyadic.llm.bpe import byte_bpe
    from polyadic.llm.packing import pack
    from polyadic.llm.wfst import encode_decode

    path, rows = public_tokenizers.path("byte_bpe_50k.json"), list(enumerate(thue_morse()))
    library = Tokenizer.from_file(path)
    want = {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows}
    assert {r["doc_id"]: r["ids_crc32"] for r in pack(documents(spark, rows), byte_bpe(path), 2048).collect()} == want
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = encode_decode(documents(spark, rows), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: pieces.encode(t) for i, t in rows}


def test_coder_compares_whole_words(monkeypatch):
    """Words whose hashes all collide still get their own ids."""
    from polyadic.llm import wordwise

    monkeypatch.setattr(wordwise, "span_hashes", lambda values, starts, ends: np.full(len(starts), 5, np.uint64))
    coder = wordwise.WordCoder(wordwise.split_words, lambda words: [[len(w), ord(w[-1])] for w in words])
    for _ in range(2):
        got = [x.tolist() for x in coder(pa.array(["ab ac", "zz", None, "ab ac"]))]
        assert got == [[2, 98, 3, 99], [2, 122], [], [2, 98, 3, 99]]


def test_jaccard_thue_morse(spark):
    from polyadic.llm.jaccard_join import jaccard_components

    rows = list(enumerate(thue_morse()))
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_components(documents(spark, rows), 3, 9, 10).collect()} == {(0, 0), (1, 1)}


def test_parity_sketches_rule_out_no_link():
    from polyadic.llm.jaccard_join import Similarity, _distances, parity_sketch

    rng = np.random.default_rng(3)
    sim = Similarity(8, 10)
    for size in (3, 30, 140, 900):
        x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        sets = [x] + [np.concatenate((x[int(k) :], rng.integers(0, 1 << 63, int(rng.integers(0, k + 1))).astype(np.uint64))) for k in rng.integers(0, size // 3 + 1, 60)]
        n, sketches = np.array([len(s) for s in sets]), [parity_sketch(s, sim) for s in sets]
        b = np.arange(1, len(sets))
        may = _distances(n, sketches, np.zeros(len(b), np.int64), b, sim) >= 0
        assert not any(sim.linked(len(x), len(sets[k]), len(np.intersect1d(x, sets[k]))) and not may[k - 1] for k in b)


def test_components_of_hubs_and_chains(spark, monkeypatch):
    from polyadic.llm import components

    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7), (0, 5), (5, 0)]
    frame = spark.createDataFrame(edges, "u long, v long")
    want = {(k, 0) for k in range(400)} | {(k, 1000) for k in range(1000, 1101)}
    assert {tuple(r) for r in components.connected_components(frame).collect()} == want
    monkeypatch.setattr(components, "ONE_TASK", 0)  # the way of large graphs, with hubs broadcast
    assert {tuple(r) for r in components.connected_components(frame).collect()} == want


# 9: exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, odd, keep):
    from polyadic.llm.exact_dedup import exact_dedup

    df, rows = odd
    got = exact_dedup(df, keep=keep).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    assert len(got) == len(rows)
    pick = min if keep == "smallest" else max
    want = Counter()
    for text, ids in groups.items():
        best = pick((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_splits_a_hot_group(spark):
    from polyadic.llm.exact_dedup import exact_dedup

    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = exact_dedup(df, keep="largest").toPandas()
    same = got[got["group_size"] > 1]
    assert len(same) == 2000 and set(same["group_size"]) == {2000} and set(same["keep_id"]) == {2999} and same["kept"].sum() == 1


def test_keep_unique(spark, odd, nothing):
    from polyadic.llm.exact_dedup import keep_unique

    df, _ = odd
    kept = keep_unique(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted([1, 3, 4, 6, 7, 8, 9, 10, 12, None], key=str)
    assert keep_unique(nothing).count() == 0


# 10: packing


def test_packing_round_trip(spark, odd, nothing):
    from tokenizers import Tokenizer

    from polyadic.llm.bpe import byte_bpe
    from polyadic.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    df, rows = odd
    got = pack(df, byte_bpe(path, 1), size=256).collect()
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            want[(i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert pack(nothing, byte_bpe(path, 1)).count() == 0


def test_shortest_pack_first():
    from polyadic.llm.packing import shortest_pack_first

    rng = random.Random(0)
    for _ in range(30):
        counts = {rng.randint(1, 63): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        patterns = shortest_pack_first(dict(counts), 64)
        seen = Counter()
        for p, n in patterns:
            assert sum(p) <= 64
            for length in p:
                seen[length] += n
        assert seen == counts
        assert sum(n for _, n in patterns) <= 2 * -(-sum(k * n for k, n in counts.items()) // 64) + 1


def test_word_splitting_equals_the_library():
    from tokenizers import Tokenizer

    from polyadic.llm.bpe import byte_bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(2)
    bits = ["a", "Bc", "'s", "'ll", "'", " ", "  ", "\n", "\t", "9", "½", "é", "日本", "!", "--", " ", "don't", "<|endoftext|>", "𝒳", "👍🏽"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [None]
    for text, ids in zip(texts, byte_bpe(path, None)(pa.array(texts)), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


# 8: Jaccard join


def brute_components(rows, n, num, den):
    sets = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        k = min(n, len(words))
        sets.append((i, {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()))
    root = {i: i for i, _ in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and den * len(x & y) >= num * len(x | y):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_jaccard_components(spark, n, num, den):
    from polyadic.llm.jaccard_join import jaccard_components

    rng = random.Random(n)
    words = [f"w{k}" for k in range(60)]
    rows, families = [], []
    for _ in range(12):
        families.append([rng.choice(words) for _ in range(rng.choice([1, 2, 4, 9, 20, 45, 120]))])
    for i in range(220):
        text = list(rng.choice(families))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text).title() if i % 2 else " ".join(text)))
    rows += [(900, None), (901, ""), (902, " \n")]
    got = jaccard_components(documents(spark, rows), n, num, den)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, n, num, den)


def test_jaccard_hot_group(spark, monkeypatch):
    """A third of several thousand rows is one group of near copies; common keys are compared in blocks."""
    from polyadic.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, rows = [word() for _ in range(60)], []
    for i in range(3000):
        text = list(base) if i % 3 == 0 else [word() for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.choice([0, 1, 1, 1, 2]) if i % 3 == 0 else 0):
            text[rng.randrange(60)] = word()
        rows.append((i, " ".join(text)))
    got = jaccard_join.jaccard_components(documents(spark, rows), 5, 8, 10).collect()
    hot = [(i, t) for i, t in rows if i % 3 == 0]
    want = dict((i, c) for i, _, c in brute_components(hot, 5, 8, 10)) | {i: i for i, _ in rows if i % 3}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_jaccard_odd_rows(spark, odd, nothing):
    from polyadic.llm.jaccard_join import jaccard_components, keep_one_of_similar

    df, rows = odd
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_components(df).collect()}
    assert {(4, 4), (5, 4), (9, 4), (10, 10), (11, 10), (1, 1), (2, 2), (None, None)} <= got
    kept = keep_one_of_similar(df)
    assert kept.columns[0] == "doc_id" and set(kept.columns) == set(df.columns)
    assert keep_one_of_similar(nothing).count() == 0


def test_jaccard_repeated_identifiers(spark):
    """A long text's need of shared keys is not asked of a short text with the same identifier."""
    from polyadic.llm.jaccard_join import jaccard_components

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for i in range(16):
        short, long = [word() for _ in range(40)], [word() for _ in range(4000)]
        texts = [(i, short), (i, long)]
        rows += texts if i % 2 else texts[::-1]
        rows += [(100 + i, short[:-1] + [word()]), (200 + i, long[:2400] + [word() for _ in range(1600)])]
    rows = [(i, " ".join(t)) for i, t in rows]
    got = jaccard_components(documents(spark, rows), 5, 8, 10).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 5, 8, 10)


def test_pigeonhole_loses_no_pair():
    """Every pair at the threshold shares a key, whatever the sizes and the allocation."""
    from polyadic.llm.jaccard_join import Similarity, keys_of

    rng = np.random.default_rng(0)
    for num, den in ((9, 10), (8, 10), (1, 2)):
        sim = Similarity(num, den)
        for _ in range(400):
            size = int(rng.integers(1, 300))
            x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            d = int(rng.integers(0, sim.differences(2 * len(x)) + 1))
            gone = int(rng.integers(0, min(d, len(x) - 1) + 1))
            y = np.unique(np.concatenate((x[gone:], rng.integers(0, 1 << 63, d - gone).astype(np.uint64))))
            common = len(np.intersect1d(x, y))
            if sim.linked(len(x), len(y), common) and not np.array_equal(x, y):
                small, large = sorted((x, y), key=len)
                # In the larger set's band both share as many keys as each is said to need.
                mine, need = keys_of(large, sim)[0]
                assert any(len(np.intersect1d(mine, k)) >= max(need, n) for k, n in keys_of(small, sim))


# 1: near-dedup


def test_near_duplicates(spark):
    from polyadic.llm.near_dedup import near_duplicates

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(size=(12, 16)) * rng.choice([0.02, 0.12, 0.3]) for c in centres])
    x[5] = x[6]
    x[7] = 3 * x[8]
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)] + [(1000, None, 1, 2), (1001, [0.0] * 16, 1, 2), (1002, [float("nan")] + [1.0] * 15, 1, 2), (1003, [], 1, 2), (1004, [1.0, None], 1, 2), (1005, [1e-30] * 16, 1, 2)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, copies int")).orderBy("vec_id").collect()
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    assert sum(r["n_links"] for r in got[: len(x)]) >= 0.99 * (links.sum() - len(x))
    assert [r["n_links"] for r in got[: len(x)]] == (links.sum(axis=1) - 1).tolist()
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in got[len(x) :])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_audit_is_per_query(monkeypatch):
    """A graph that finds all of a large group and nothing of small ones is not used."""
    import pandas as pd

    from polyadic.llm import near_dedup

    rng = np.random.default_rng(1)
    hot = rng.normal(size=16) + rng.normal(size=(600, 16)) * 0.01
    small = np.repeat(rng.normal(size=(60, 16)), 2, axis=0) + rng.normal(size=(120, 16)) * 0.01
    x = np.concatenate([hot, small])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.95

    class Forgetful:
        @classmethod
        def load(cls, _):
            return cls()

        def within(self, q, threshold, beam):
            near = [np.flatnonzero(u @ v >= threshold) for v in q.astype(np.float64)]
            return [n if len(n) > 100 else n[:0] for n in near]

    monkeypatch.setattr(near_dedup, "Graph", Forgetful)
    rows = pd.DataFrame({"rep": range(len(x)), "embedding": list(x)})
    index = pd.DataFrame({"reps": [np.arange(len(x)).tobytes()], "copies": [np.ones(len(x), np.int64).tobytes()], "exact": [u.tobytes()], "graph": [b""]})
    got = near_dedup._search(0.95)(rows, index).set_index("node")["links"]
    assert [int(got.get(i, 0)) for i in range(len(x))] == (links.sum(axis=1) - 1).tolist()


# 2, 3, 7: classifiers


def held_out(spark, name, truth, column):
    from polyadic.llm.queries import QUERIES

    got = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    true = spark.read.parquet(f"/root/testdata/sf0.01/{truth}.parquet").select("doc_id", column).toPandas()
    both = got.merge(true, on="doc_id")
    return both[both["held_out"]]


def test_quality_held_out(spark):
    rows = held_out(spark, "op2_quality_classifier", "labels", "quality")
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97 and rows["score"].between(0, 1).all()


def test_toxicity_held_out(spark):
    rows = held_out(spark, "op3_toxicity", "labels", "toxic")
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.9 and rows["score"].between(0, 1).all()


def test_language_held_out(spark):
    rows = held_out(spark, "op7_language_id", "documents", "lang")
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.97 and rows["score"].between(0, 1).all()


def test_discriminant_equals_dense_densities(spark):
    """Scores equal log densities by slogdet and solve on the whole matrix of statistics."""
    from polyadic.llm.quality import FEATURES, quality_scores, statistics_of

    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels, shrinkage=0.1).collect()}
    both = docs.join(labels.where("quality in (0, 1)"), "doc_id").collect()
    x = np.array([statistics_of(np.frombuffer((r["text"] or "").encode(), np.uint8)) for r in both])
    y = np.array([r["quality"] for r in both])
    pooled, density = np.cov(x.T, bias=True), []
    every = docs.collect()
    all_x = np.array([statistics_of(np.frombuffer((r["text"] or "").encode(), np.uint8)) for r in every])
    for c in (0, 1):
        own = np.cov(x[y == c].T, bias=True) if (y == c).sum() > len(FEATURES) else pooled
        s = 0.9 * own + 0.1 * np.diag(np.diag(pooled)) + 0.01 * np.eye(len(FEATURES))
        d = all_x - x[y == c].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(s, d.T).T) - 0.5 * np.linalg.slogdet(s)[1])
    odds = density[1] - density[0] + np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1))
    np.testing.assert_allclose([got[r["doc_id"]] for r in every], 1 / (1 + np.exp(-np.clip(odds, -60, 60))), atol=1e-6)


def test_ftrl_equals_a_plain_one():
    """Per-coordinate rates and L1 sparsity, one weight at a time in a dictionary."""
    from polyadic.llm.toxicity import ftrl

    rng = random.Random(2)
    rows = [sorted(rng.sample(range(40), rng.randint(1, 9))) for _ in range(120)]
    labels = [int(3 in r or 5 in r) for r in rows]
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.5 else -(z[i] - (0.5 if z[i] > 0 else -0.5)) / ((1.0 + n[i] ** 0.5) / 0.8 + 0.1)

    for _ in range(3):
        for row, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in row}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in row:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.8 * w[i]
                n[i] += g * g
    got = ftrl([np.array(r) for r in rows], np.array(labels, float), epochs=3, alpha=0.8, beta=1.0, l1=0.5, l2=0.1)
    np.testing.assert_allclose(got[:40], [weight(i) for i in range(40)], atol=1e-12)


def test_language_equals_plain_compression(spark):
    """Predictions equal direct zstandard sizes with the same dictionaries; narrow margins are rejected."""
    import zstandard

    from polyadic.llm.lang_id import BLOCK_BYTES, fit, identify

    docs = table(spark, "documents")
    models, _ = fit(docs, None, "doc_id", "text", "lang", 400, 96_000)
    assert all(0 < len(m) <= 96_000 for m in models.values())
    coders = {lang: zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(m, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for lang, m in models.items()}
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").lower().encode()
        sizes = {lang: sum(len(c.compress(raw[k : k + BLOCK_BYTES])) for k in range(0, len(raw), BLOCK_BYTES)) for lang, c in coders.items()}
        mine = got[r["doc_id"]]
        if mine["lang_pred"] == "und":
            assert not any(c.isalpha() for c in r["text"] or "") and mine["rejected"]
        else:
            assert abs(sizes[mine["lang_pred"]] - min(sizes.values())) <= 0
    strict = identify(docs, min_margin=1.1).collect()
    assert all(r["rejected"] for r in strict) and not all(r["rejected"] for r in got.values())


def test_toxicity_with_repeated_identifiers(spark):
    """A text never meets another text's label, and a thousand equal rows count once."""
    from polyadic.llm.toxicity import fit

    texts = spark.createDataFrame([(1, f"bad{k % 3}") for k in range(1000)] + [(k, "good words") for k in range(2, 60)], "doc long, text string")
    known = spark.createDataFrame([(1, 1)] + [(k, 0) for k in range(2, 60)], "doc long, label int")
    once = spark.createDataFrame([(1, f"bad{k}") for k in range(3)] + [(k, "good words") for k in range(2, 60)], "doc long, text string")
    for a, b in zip(fit(texts, known), fit(once, known), strict=True):
        np.testing.assert_array_equal(a, b)


def test_toxicity_learns_from_a_stream(spark):
    """A shard's texts are taken batch by batch, never held together; weights are those of rows in hashed order."""
    from polyadic.llm.textarrays import mix
    from polyadic.llm.toxicity import BITS, _learn, ftrl, gram_indices

    start, most = pa.total_allocated_bytes(), 0

    def batches():
        nonlocal most
        for k in range(30):
            texts = [f"word{k % 7} good{i % 5} " * 4000 for i in range(20)]
            yield pa.RecordBatch.from_arrays([pa.array(range(20 * k, 20 * k + 20), pa.int64()), pa.array(texts), pa.array([float(k % 7 == 3)] * 20)], ["doc", "text", "label"])
            most = max(most, pa.total_allocated_bytes() - start)

    (got,) = _learn(batches())
    assert most < 3 * 20 * 4000 * 13  # 30 batches are ten times as much
    order = np.argsort(mix(np.arange(600, dtype=np.uint64)))
    rows = [np.append(np.unique(gram_indices(np.frombuffer((f"word{d // 20 % 7} good{d % 20 % 5} " * 4000).encode(), np.uint8))), 1 << BITS) for d in order]
    want = ftrl(rows, (order // 20 % 7 == 3).astype(float))
    np.testing.assert_array_equal(got["i"].to_numpy(), np.flatnonzero(want))
    np.testing.assert_array_equal(got["w"].to_numpy(), want[want != 0])


def test_pipeline_stages_give_python_small_batches(spark, monkeypatch):
    """Long texts go to Python some megabytes at a time, in each stage of the pipeline."""
    import corpus_pipeline
    from polyadic.llm.scratch import BATCH_BYTES

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pa.compute.sum(pa.compute.binary_length(batch["text"])).as_py()])], ["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    long = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab ', 14000)").alias("text"))
    for operator in ("drop_toxic", "keep_good", "keep_unique", "keep_one_of_similar", "pack"):
        monkeypatch.setattr(corpus_pipeline, operator, lambda docs, *a, **k: docs)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(name)
            stage(spark, table(spark, "documents"), SF)
            found = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
            assert sum(found) == 400 * 42_000 and max(found) < 1.5 * BATCH_BYTES
    finally:
        spark.conf.set(name, before)


def test_other_steps_release_the_word_memory():
    """A worker that has packed does not hold its words while it learns; packing again gives the same ids."""
    from polyadic.llm.bpe import _coder, byte_bpe
    from polyadic.llm.toxicity import _learn

    encode, texts = byte_bpe(public_tokenizers.path("byte_bpe_50k.json")), pa.array(["some words", "", "others"])
    before = [ids.tolist() for ids in encode(texts)]
    assert _coder.cache_info().currsize == 1
    list(_learn([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", "b"]), pa.array([0.0, 1.0])], ["doc", "text", "label"])]))
    assert _coder.cache_info().currsize == 0
    assert [ids.tolist() for ids in encode(texts)] == before


def test_classifiers_on_odd_rows(spark, odd, nothing):
    from polyadic.llm.lang_id import identify
    from polyadic.llm.quality import keep_good, quality_scores
    from polyadic.llm.toxicity import drop_toxic, toxicity_scores

    df, rows = odd
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 0, 1), (7, None, None), (99, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for f in (quality_scores, toxicity_scores):
        for known in (labels, none):
            got = f(df, known).collect()
            assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert all(r["score"] == 0.5 for r in f(df, none).collect())
        assert f(nothing, labels).count() == 0
    assert keep_good(df, labels).columns == drop_toxic(df, labels).columns == df.columns
    clashing = df.withColumnsRenamed({"lang": "score", "source": "predicted", "sha": "component_id", "rank": "n"})
    from polyadic.llm.exact_dedup import keep_unique
    from polyadic.llm.jaccard_join import keep_one_of_similar

    for stage in (lambda d: keep_good(d, labels), lambda d: drop_toxic(d, labels), keep_unique, keep_one_of_similar):
        assert stage(clashing).columns == clashing.columns and stage(clashing).count() <= len(rows) and stage(nothing).count() == 0
    got = {r["doc_id"]: r["lang_pred"] for r in identify(df).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "en"
    assert identify(nothing).count() == 0
    assert {r["lang_pred"] for r in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 4: SentencePiece


def test_transducer_equals_the_library(spark, odd, nothing):
    import sentencepiece

    from polyadic.llm.wfst import _coder, encode_decode

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    machine, _ = _coder(path)
    rng = random.Random(4)
    pieces = list(machine.ids)
    for k in range(1500):
        text = "".join(rng.choice("abcdeinorst éñ.,\n日▁ﬁ07  ") for _ in range(rng.randint(0, 16))) if k % 2 else "".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randint(1, 5)))
        ids = library.encode(text)
        assert machine.encode(text) == ids, repr(text)
        assert machine.decode(ids) == library.decode(ids)
    df, rows = odd
    got = encode_decode(df, path).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(library.encode(t or ""))) for i, t in rows)
    assert all(r["round_trip"] for r in got)
    assert encode_decode(nothing, path).count() == 0


def field(number, value):
    """One field of a protocol-buffer message."""

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def piece_model(kind, pieces, fallback, prefix=True, squeeze=False, rules=None):
    """A model of hand-made pieces: (text, score, type)."""
    import sentencepiece

    every = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []), *pieces]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in every)
    out += field(2, field(3, kind) + (field(35, 1) if fallback else b""))
    spec = field(1, (rules or "own").encode())
    if rules:
        normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rules)
        from polyadic.llm.wfst import _fields

        spec += field(2, dict(_fields(normaliser.serialized_normalizer_spec()))[2])
    return out + field(3, spec + field(3, int(prefix)) + field(4, int(squeeze)))


CHARS = "abcde ▁é日"


def hand_made(kind, rng, users=(), **how):
    """Random pieces over a few letters; each of a BPE model's is two others joined."""
    texts = list("abcde▁") if how["fallback"] else list("abcd▁")
    for _ in range(40):
        a, b = rng.choice(texts), rng.choice(texts)
        if a + b not in texts and "▁" not in (a + b)[1:] and len(a + b) < 7:
            texts.append(a + b)
    if kind == 2:
        scored = [(t, -float(k), 1) for k, t in enumerate(texts[5 + how["fallback"] :] + texts[: 5 + how["fallback"]])]
    else:
        scored = [(t, -rng.uniform(1, 9), 1) for t in texts]
    return piece_model(kind, scored + [(u, 0.0, 4) for u in users if u not in texts], **how)


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("prefix,squeeze,rules,users", [(True, False, None, ()), (True, True, None, ()), (False, True, "nmt_nfkc", ()), (True, True, "nmt_nfkc", ("bé日", "<u>", "ba")), (True, False, "nfkc_cf", ("cab",)), (False, False, None, ("ee", "▁da"))])
def test_hand_made_models_equal_the_library(kind, fallback, prefix, squeeze, rules, users):
    """Both kinds of models with character maps, squeezed spaces, user-defined pieces, with and without bytes."""
    import sentencepiece

    from polyadic.llm.wfst import Transducer, WordCoder

    rng = random.Random(kind * 100 + fallback * 10 + len(users))
    for _ in range(3):
        model = hand_made(kind, rng, users, fallback=fallback, prefix=prefix, squeeze=squeeze, rules=rules)
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        machine = Transducer(model)
        coder = WordCoder(machine.splitter(), lambda words, m=machine: [m.ids_of(w) for w in words])
        texts = ["", " ", "  ", "▁", " ▁ a ▁ ", "ab\u3000\u3000 c\u200b", "\u200b", "\x01 a", "ＡＢ ﬁ①e\u0301", "bé日ba<u>ba cabcab ▁dada eee", "xyz xx日日x"]
        texts += ["".join(rng.choice(CHARS + "ﬁ①\u3000\u0301\tE") for _ in range(rng.randint(0, 30))) for _ in range(150)]
        texts += ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 40))) for _ in range(150)]
        stretches = coder(pa.array(map(machine.normaliser, texts), pa.large_string()))
        for text, ids in zip(texts, stretches, strict=True):
            want = library.encode(text)
            assert machine.encode(text) == want, (text, model)
            assert machine.drawn_together(ids).tolist() == want, text
            assert machine.decode(want) == library.decode(want), text


def test_spaced_pieces_and_refused_models():
    """Pieces with spaces inside are found across words; what can't be compiled is refused."""
    import sentencepiece

    from polyadic.llm.wfst import Transducer, WordCoder

    pieces = [(c, -5.0, 1) for c in "ab▁"] + [("a▁b", -1.5, 1), ("▁a▁", -2.25, 1)]
    model = piece_model(1, pieces, True)
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=model), Transducer(model)
    coder = WordCoder(machine.splitter(), lambda words: [machine.ids_of(w) for w in words])
    texts = ["a b", "a a b a b", "b xa ba b", "a  b"]
    assert [x.tolist() for x in coder(pa.array(map(machine.normaliser, texts), pa.large_string()))] == [library.encode(t) for t in texts]
    for kind, bad in ((3, []), (4, []), (2, [("ab", -1.0, 5)])):
        with pytest.raises(ValueError):
            Transducer(piece_model(kind, pieces[:3] + bad, True))


# 5: HTML


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b <b>c</b>d</div>", "a\nb cd"),
        ("a<br>b", "a\nb"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n    - z"),
        ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"),
        ("<table><tr><th>k<th>value<tr><td>long one<td>2</table>", "k         value\nlong one  2"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<p hidden>no</p><p style='display: none'>no</p><script>var x='<p>no</p>'</script>yes", "yes"),
        ("&lt;x&gt; &amp; &eacute;&nbsp;!", "<x> & é !"),
        ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
        ("<title>t</title><body>b</i></div>", "b"),
        ("<p>a</p></p><span>b</span>", "a\n\nb"),
        ("<table><tr><td><ul><li>a<li>b</ul><td>x<tr><td>c<td><pre>y\n z</pre></table>", "- a  x\n- b\nc    y\n      z"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<object>a</object> <object hidden>b</object>", "a"),
        ("Go<textarea>typed</textarea>", "Go typed"),
        ("<div style='visibility:hidden'>a<p style='visibility: visible'>b</p>c</div>d", "b\n\nd"),
        ("<p style='content-visibility:hidden'>a</p><p style='font:display: none'>b", "b"),
        ("<style>.h, p#x {display:none} @media print {i {display:none}} b{visibility:hidden}</style><p class='k h'>a<p id=x>b<p><i>c</i><b>d</b>", "c"),
        ("<style>.h{display:none}</style><p class=h style='display:block'>a", "a"),
        ("<ol reversed><li>x<li value=7>y<li>z</ol>", "3. x\n7. y\n6. z"),
        ("<table><tr><td>" + "w" * 70 + "<td>a<tr><td>x<td>b</table>", "w" * 70 + "  a\nx" + " " * 71 + "b"),
        ("<table><tr><td colspan=200>a<td>b<tr><td colspan=0>c</table>", "a  b\nc"),
        ("<table><tr><td>" * 1500 + "deep", "deep"),
    ],
)
def test_html(html, text):
    from polyadic.llm.html_layout import text_of

    assert text_of(html) == text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<table><tr><form><td>a</td></form></tr></table>", "a"),
        ("<table><tbody><td>a</tbody></table>", "a"),
        ("<table><td>a<th>b</table>c", "a  b\n\nc"),
        ("<table><tr>note<td>a</table>", "note\n\na"),
        ("<table><tbody><div>x</div><tr><td>a</table>", "x\n\na"),
        ("<table><colgroup><b>x</b><col><tr><td>a</table>", "x\n\na"),
        ("<table><tr><td>a<table><tr><td>b</table>c</table>", "a\nb\nc"),  # a cell keeps its lines
        ("<table><template><tr><td>no</template><tr><td>a</table>", "a"),
        ("<head><meta charset=x>shown", "shown"),
        ("<head><title>t</title> <p>shown", "shown"),
        ("<p>a<head>b", "ab"),
        ("<svg><title>no</title><defs><text>no</text></defs><path d=M0/><text>a</text><text>b</text></svg>c", "a b c"),
        ("<svg><defs/><text>a</text><p>b", "a\n\nb"),
        ("<math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></semantics></math>", "x=1"),
    ],
)
def test_html_misplaced(html, text):
    from polyadic.llm.html_layout import text_of

    assert text_of(html) == text


def test_html_loses_no_text():
    """Every visible text node is in the output once, however tags are nested."""
    from polyadic.llm.html_layout import text_of

    rng = random.Random(5)
    tags = "html head body table table caption colgroup col thead tbody tfoot tr tr td td th form div p b ul li dl dd pre h2 a svg g text math mi foreignobject summary br img".split()
    for _ in range(3000):
        words, html = [], []
        for k in range(rng.randint(1, 30)):
            if rng.random() < 0.4:
                words.append(f"word{k}z")
                html.append(words[-1])
            else:
                html.append(rng.choice(("<{}>", "<{}>", "</{}>", "<{}/>")).format(rng.choice(tags)))
        text = text_of("".join(html))
        assert all(text.count(w) == 1 for w in words), "".join(html)


def test_html_rows(spark):
    from polyadic.llm.html_layout import extract, text_of

    assert text_of("<div>" * 30_000 + "deep") == "deep"
    for broken in ("<" * 50_000, "<!-- <p>", "<a href='", "&#x110000;&#0;&bogus;", "<table><tr><td>" * 100 + "x"):
        text_of(broken)
    rows = [(1, None, "u"), (1, "<p>a", "u"), (None, "<p>b", "u")]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted(((r["page_id"], r["text"]) for r in got), key=str) == sorted([(1, ""), (1, "a"), (None, "b")], key=str)
    assert extract(table(spark, "pages")).where("n_chars > 0").count() == table(spark, "pages").count()


# 6: chat templates


def test_templates():
    from polyadic.llm.chat_template import TemplateError, compile_template, fold, parse

    render = compile_template("{# r #}{% set a = 'x' ~ 1 %}{% for m in ms %}{{ loop.index0 }}{{ m['t'] | upper }}{% if not loop.last %},{% endif %}{% endfor %}{{ a }}")
    assert render(ms=[{"t": "p"}, {"t": "q"}]) == ("0P,1Qx1", [])
    assert compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")(x="yz") == ("abyzc", [(1, 4)])
    assert fold(parse("{{ 'a' + 'b' }}{% if 1 == 2 %}no{% else %}c{% endif %}")) == [("text", "abc")]
    assert compile_template("{{ x }} {%- if x -%} y {%- endif %}")(x=None) == ("", [])
    for bad in ("{% for x %}{% endfor %}", "{% if x %}", "{{ x() }}", "{{ x | nope }}", "{% bogus %}", "{{ }}", "{% endif %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    with pytest.raises(TemplateError):
        compile_template("{{ x.__class__ }}")(x=1)


def test_escaping_is_reversible():
    from polyadic.llm.chat_template import CONTROL, TEMPLATE, compile_template, escape, read_back, unescape

    rng = random.Random(6)
    render = compile_template(TEMPLATE)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", ">", "\\", "</s>", "[INST]", "s", "\n", "[", "/", "]", "end"]) for _ in range(rng.randint(0, 9)))
        assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROL)
        formatted, spans = render(messages=[{"role": text[:3], "text": text}, {"role": "assistant", "text": text}])
        assert read_back(formatted) == [(text[:3], text), ("assistant", text)]
        assert unescape(formatted[slice(*spans[-1])]) == text


def test_conversations(spark):
    from polyadic.llm.chat_template import digest, format_conversations

    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (2, 0, None, ""), (2, 0, "user", "x"), (None, 5, "assistant", "z"), (1, 1, "assistant", "b</s>")]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    got = {r["conv_id"]: r for r in digest(format_conversations(df)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (3, 10), 2: (2, 0), None: (1, 1)}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb</s>\nassistant\nb</s>\n").hexdigest()
    assert digest(format_conversations(df.limit(0))).count() == 0


# SQL and the pipeline


@pytest.mark.parametrize("name", ["op6_chat_formatting", "op9_exact_dedup"])
def test_sql(spark, name):
    import duckdb

    from polyadic.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    assert sorted(map(tuple, got[sorted(got)].to_numpy().tolist())) == sorted(map(tuple, want[sorted(want)].to_numpy().tolist()))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert set(out.columns) == set(docs.columns)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.items() <= before.items()
        if name == "exact":
            first = {}
            for i in sorted(before):
                first.setdefault((before[i] or "").translate(LOWER), i)
            assert set(after) == set(first.values())
        elif name == "similar":
            assert set(after) == {c for _, _, c in brute_components(sorted(before.items()), 5, 8, 10)}
        else:
            labels = {r["doc_id"]: r for r in table(spark, "labels").collect()}
            good = [i for i in before if i in labels and (labels[i]["toxic"] == 0 if name == "toxicity" else labels[i]["quality"] == 1)]
            bad = [i for i in before if i in labels and i not in good]
            assert sum(i in after for i in good) >= 0.95 * len(good) and sum(i in after for i in bad) <= 0.1 * len(bad) + 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces["doc_id"]) == set(after)
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)
