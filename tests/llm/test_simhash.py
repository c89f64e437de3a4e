import random

import pytest
from xxhash import xxh64_intdigest

from quiresmith.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(prints):
        for b, y in prints[i + 1 :]:
            if (x ^ y).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in root}


@pytest.mark.parametrize("paired", [64, 0])
def test_matches_brute_force(spark, paired):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 60))) for _ in range(25)]
    texts = [*base, *base[:8], None, "", " \n", "One", "one two", "  x", "É e É"]
    texts += [base[3] + " tail" + str(i % 3) for i in range(12)] + ["A b c " * 2000]
    rows = [(i * 7 % 1009, t, i) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int"), paired=paired).collect()
    prints = sorted((i, plain_fingerprint(t)) for i, t, _ in rows)
    want = plain_components(prints)
    assert {r.doc_id: r.fp % 2**64 for r in got} == dict(prints)
    assert {r.doc_id: r.component_id for r in got} == want


def test_crowded_blocks_lose_no_link(spark):
    rng = random.Random(5)
    seed = rng.getrandbits(64)
    prints = {seed}
    while len(prints) < 300:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ rng.choice([0, 1 << rng.randrange(64)]))
    prints |= {rng.getrandbits(64) for _ in range(100)}
    rows = [(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(sorted(prints))]
    from quiresmith.llm.common import Shelf
    from quiresmith.llm.graph import components

    df = spark.createDataFrame(rows, "fp long, rep long")
    for paired in (64, 5):
        shelf = Shelf(spark, "test")
        got = {r.id: r.root for r in components(simhash.links(df, shelf, paired), "a", "b", shelf).collect()}
        want = {i: r for i, r in plain_components([(i, p % 2**64) for p, i in rows]).items()}
        assert {i: got.get(i, i) for i in want} == want


def test_nulls_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string, component_id string, __text string"
    rows = [(None, "a b c d", "x", "y"), (4, "a b c d", "x", None), (4, "a b c d", None, None), (9, None, None, None), (2, "", None, None)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(None, None), (4, 4), (9, 2), (2, 2)}
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_an_id_of_several_texts_ties_their_groups(spark):
    a, b = "one two three four five six", "quite another text of some words"
    rows = [(5, a), (5, b), (9, a), (7, b), (8, "alone in the world it is")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (9, 5), (7, 5), (8, 8)}
