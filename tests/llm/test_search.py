"""Collocations, hard negatives and fingerprints against plain Python versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, h long, n long, score double, rank int, phrase string, a long, pair long"


def documents(spark, rows):
    """Rows (doc_id, text, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, l, 1, 2, 0.5, 3, "x", 4, 5) for i, t, l in rows], SCHEMA).repartition(3)


def plain_collocations(rows, longest, least, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        good = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside.get(p[i : i + k], 0), a)
        kept = []
        for p, a in good.items():
            if inside.get(p, -1) >= a:
                continue
            score, cut = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), found[p[:cut]], found[p[cut:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(kept)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    words = ["the", "of", "Ärger", "été", "x" * 300, "a\x00b", "zed", "\x01", "New", "York"]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(rng.randint(0, 60)))
        text += rng.choice(["", " new york city hall", " NEW YORK\tcity hall tower", f" rare{i} of the"])
        rows.append((i % 250, text, rng.choice(["en", "en", "de", None, "und"])))
    long = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(140_000))
    return [*rows, (None, None, "en"), (1, "", "fr"), (2, " ,. \n", None), (3, long, "en")]


@pytest.mark.parametrize("dictionary_bytes", [1 << 26, 0])
def test_collocations(spark, dictionary_bytes):
    from polyadic.llm.collocations import collocations

    rows = phrase_rows()
    got = collocations(documents(spark, rows), least=20, top=50, dictionary_bytes=dictionary_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 5, 20, 50)


def test_collocations_in_small_blocks(spark, monkeypatch):
    from polyadic.llm import collocations as module

    for name, value in (("BLOCK_IDS", 500), ("SLICE_BYTES", 3_000), ("RANGE_KEYS", 50), ("SAMPLE_ROWS", 4), ("JOIN_BLOCK", 64), ("MOST_FILTER_BITS", 64)):
        monkeypatch.setattr(module, name, value)
    rows = [(i, t and t[:2_000], l) for i, t, l in phrase_rows()]
    for size in (1 << 26, 0):
        got = module.collocations(documents(spark, rows), longest=4, least=5, top=30, dictionary_bytes=size)
        assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 4, 5, 30)


def test_collocations_of_nothing(spark):
    from polyadic.llm.collocations import collocations

    assert collocations(documents(spark, [])).collect() == []
    assert collocations(documents(spark, [(1, None, None), (2, "one two", "en")])).collect() == []
    with pytest.raises(ValueError):
        collocations(documents(spark, []), longest=9)


def test_collocation_scores_pass_64_bits(spark):
    """1000 a n and l r beyond 64 bits are divided exactly."""
    x = spark.range(1).select(F.lit(9_000_000_000_000).alias("a"))
    wide = F.col("a").cast("decimal(19,0)")
    got = x.select(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide * wide), wide * (wide - 1).cast("decimal(19,0)")).cast("long")).first()[0]
    assert got == 1000 * 9_000_000_000_000**2 // (9_000_000_000_000 * 8_999_999_999_999)


VECTORS = "vec_id long, embedding array<float>, label int, q int, cell int, anchor long, grp int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, l, 1, 2, 3, 4) for i, x, l in rows], VECTORS).repartition(4)


def plain_negatives(rows, every, positives=5, negatives=5):
    seen, good = set(), []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        q = tuple(int(np.floor(256.0 * float(np.float32(v)))) for v in x)
        if (i, label, q) not in seen:
            seen.add((i, label, q))
            good.append((i, label, q))
    out = []
    for i, label, q in good:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p)), j, m) for j, m, p in good if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(fit[:negatives], start=1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    from polyadic.llm import hard_negatives as module

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.4 * rng.normal(size=12)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    same = rows[10][1]
    rows += [(1_000 + i, same, i % 2) for i in range(400)]  # a hot group of copies with ties
    rows += [(5_000, None, 1), (5_010, [float("nan")] * 12, 1), (5_020, [None, *[1.0] * 11], 2), (5_030, [0.0] * 12, 3), (5_040, [1.0] * 12, None), (None, [1.0] * 12, 1), (5_050, [0.5] * 5, 1), (5_060, (-centres[0]).tolist(), 9)]
    rows += rows[:30] + [(20, rows[21][1], 2)]
    wanted = plain_negatives(rows, 10)
    for sizes in ({}, {"PIVOT_ROWS": 40, "GROUP_ANCHORS": 9, "CHUNK_ROWS": 100}):
        for name, value in sizes.items():
            monkeypatch.setattr(module, name, value)
        got = module.hard_negatives(vectors(spark, rows), anchors=F.col("vec_id") % 10 == 0)
        assert sorted(map(tuple, got.collect())) == wanted


def test_hard_negatives_of_large_numbers_and_nothing(spark):
    from polyadic.llm.hard_negatives import hard_negatives

    assert hard_negatives(vectors(spark, []), anchors=F.lit(True)).collect() == []
    rows = [(0, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [2.9e6, 5.0], 2), (3, [2.5e6, 7.0], 2)]
    got = hard_negatives(vectors(spark, rows), anchors=F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, 1_000_000)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives(vectors(spark, [(0, [1e12], 1), (1, [1e12], 1), (2, [1e12], 2)]), anchors=F.lit(True)).collect()


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain_digests(text):
    cut = re.findall(r"[^\n]{64,192}?[.!?]+\n*|[^\n]{1,192}\n*|\n+", text)
    assert "".join(cut) == text
    out = set()
    for p in cut:
        high = xxhash.xxh64(p.encode(), seed=42).intdigest() & ~0xFFFF
        out.add(high | xxhash.xxh64(high.to_bytes(8, "little"), seed=42).intdigest() & 0xFFFF)
    return out


def plain_fingerprint(text):
    found = plain_digests(text)
    out = f"{len(found):08x}"
    for t in range(3):
        for i in range(8):
            here = [k for k in found if (k >> (16 + 3 * t)) & 7 == i]
            x = 0
            for k in here:
                x ^= k
            out += f"{len(here) & 255:02x}{x:016x}"
    return out


def plain_fingerprints(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-1 if r[0] is None else r[0], signed(xxhash.xxh64(r[1].encode(), seed=42).intdigest())))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        a, e, b = plain_digests(text), plain_digests(edited), plain_digests(after)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((-1 if i is None else i, n, hashlib.sha256(edited.encode()).hexdigest(), plain_fingerprint(text), plain_fingerprint(edited), round(like(a, e), 12), round(like(a, b), 12)))
    return sorted(out)


def test_fingerprints(spark):
    from polyadic.llm.fingerprints import fingerprints

    rng = random.Random(9)
    prose = lambda k: "".join(rng.choice(["Ein Satz", "été 😀 où", "w" * 200, "x\ny", "a b c d e"]) + str(rng.randint(0, 40)) + rng.choice([". ", "! ", "\n", " ", "?! "]) for _ in range(k))
    rows = [(i * 3, prose(rng.randint(0, 80))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "abc"), (503, "....\n\n"), (504, prose(4_000)), (505, "w" * 5_000), (None, "nobody. "), (None, prose(9))]
    rows += [(600, "same. text. "), (600, "same. text. "), (600, "same. text. "), (600, "other. text. "), (601, "same. text. ")]
    got = fingerprints(documents(spark, [(i, t, "en") for i, t in rows]))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = sorted((-1 if r[0] is None else r[0], *r[1:5], round(r[5], 12), round(r[6], 12)) for r in got.collect())
    assert got == plain_fingerprints(rows)


def test_fingerprints_of_few(spark):
    from polyadic.llm.fingerprints import fingerprints

    assert fingerprints(documents(spark, [])).collect() == []
    one = fingerprints(documents(spark, [(7, "One. Two. Three. Four.", "en")])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 22
    twins = fingerprints(documents(spark, [(7, "One. Two.", "en"), (7, "One. Two.", "en")])).collect()
    assert len(twins) == 2 and twins[0] == twins[1] and twins[0]["near_next"] == 1.0


def test_fingerprints_use_no_python(spark):
    from polyadic.llm.fingerprints import fingerprints

    plan = fingerprints(documents(spark, [(1, "a. b.", "en"), (2, "c.", "en")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
