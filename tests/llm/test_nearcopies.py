"""Near copies of the pipeline against all pairs in plain Python."""

from itertools import combinations

import numpy as np
import xxhash

import corpus_pipeline
from lakesieve.llm import nearcopies
from lakesieve.llm.simhash import majority


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) < 4 * max(len(sets[i]), len(sets[j])):
                continue
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}


def test_near_dedup_drops_what_all_pairs_at_similarity_08_say(spark):
    rng = np.random.default_rng(3)
    texts = ["", None, "one two", "One  two", "three"]
    for _ in range(25):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        texts.append(" ".join(base))
        for n in (1, 2, 3, 4):  # similarities around 0.92, 0.84, 0.77, 0.71
            copy = list(base)
            for at in rng.choice(np.arange(6, 114, 6), n, replace=False):
                copy[at] = "other"
            texts.append(" ".join(copy))
    # A large group: all near the same text, many of them not near each other.
    base = [f"h{x}" for x in range(200)]
    for i in range(60):
        copy = list(base)
        for at in rng.choice(np.arange(6, 194, 6), i % 6, replace=False):
            copy[at] = f"x{i}"
        texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)]
    order = rng.permutation(len(rows))
    docs = spark.createDataFrame([(int(i), rows[i][1], "en", "s", 1) for i in order], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == brute(rows)


def test_shingles_of_short_texts():
    assert [len(x) for x in nearcopies.shingles((None, " ", "a", "a b c d e", "a b c d e f", "a a a a a a a"))] == [0, 0, 1, 1, 2, 1]
    one, two, padded, short = nearcopies.shingles(("A b c d e f", "a b\tc d e f", "  a b c d e f\n", "a b"))
    assert one.tolist() == two.tolist() == padded.tolist() != short.tolist()


def test_sketches_never_differ_in_more_bits_than_the_sets():
    rng = np.random.default_rng(5)
    for n, own in ((0, 0), (0, 3), (5, 1), (100, 12), (100, 100), (2000, 300)):
        a = rng.integers(0, 2**63, n + own).astype(np.uint64)
        b = np.concatenate((a[:n], rng.integers(0, 2**63, own).astype(np.uint64)))
        bits = np.bitwise_count((nearcopies._sketch(a) ^ nearcopies._sketch(b)).view(np.uint64)).sum()
        assert bits <= 2 * own and nearcopies._sketch(a).shape == (nearcopies.SKETCH,)


def test_a_cell_of_many_unlike_texts_and_chains(spark):
    # One passage in all texts puts many unlike ones into a cell; a chain of small steps links texts that are not near each other.
    rng = np.random.default_rng(6)
    passage = [f"p{x}" for x in range(60)]
    texts = [" ".join(passage + [f"q{x}" for x in rng.integers(0, 9000, 40)]) for _ in range(80)]
    chain = [f"c{x}" for x in range(150)]
    for i in range(30):
        chain = list(chain)
        chain[5 * i] = f"d{i}"
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == brute(rows)


def test_simhash_finds_the_first_candidates_and_they_are_verified(spark, monkeypatch):
    # Half of the copies are a word away, which few bits of a fingerprint tell; unlike texts have few words each.
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 9000, 300)]
        texts += [" ".join(base), " ".join([*base[:150], "other", *base[151:]]), " ".join(base + [f"v{x}" for x in rng.integers(0, 9000, 200)])]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = []
    verified = nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, sets: found.append((pairs.count(), (out := verified(pairs, sets)).count())) or out)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == brute(rows)
    by_key = {xxhash.xxh64_intdigest(h.tobytes(), nearcopies.SEED): majority(h) for h in nearcopies.shingles(texts)}
    near = sum((by_key_a ^ by_key_b).bit_count() <= nearcopies.BITS for by_key_a, by_key_b in combinations(by_key.values(), 2))
    assert near > 20 and found[0] == (near, near)


def test_majority_is_the_simhash_of_the_set():
    for text in ("", "one", "a b c d e f g", " ".join(f"w{i}" for i in range(70000))):
        h = next(nearcopies.shingles([text]))
        ones = [sum(int(x) >> b & 1 for x in h) for b in range(64)]
        assert majority(h) == sum(1 << b for b in range(64) if 2 * ones[b] > len(h))
