"""SimHash groups, components, and repeated passages, against brute force."""

import hashlib
import random
import time

import pytest
import xxhash
from odd_rows import LONG, ODD, PASSAGE, none, odd, shared  # noqa: F401
from pyspark.sql import functions as F

from growthgrain.llm import simhash, substrings
from growthgrain.llm.components import components


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, distance=4):
    """The smallest node reachable from each node, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    nodes = sorted(root)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in nodes}


def signed(n):
    return n - (1 << 64) if n >> 63 else n


@pytest.mark.parametrize("text", [t for _, t, *_ in ODD])
def test_fingerprint(text):
    found = simhash.fingerprint(None if text is None else text.encode(), 4)
    assert found == signed(plain_fingerprint(text))


def links(spark, prints, distance=4):
    """Groups of given fingerprints by the operator's own steps."""
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint").distinct()
    near = components(simhash._close(df)).withColumnRenamed("node", "fp")
    rooted = df.join(near, "fp", "left").withColumn("root", F.coalesce("root", "fp")).checkpoint()
    wide = components(simhash._ring(rooted, distance))
    wide = wide.select(F.col("node").alias("root"), F.col("root").alias("top"))
    rows = rooted.join(wide, "root", "left").select("fp", F.coalesce("top", "root").alias("top"))
    return {r.fp: r.top for r in rows.collect()}


def same_partition(found, wanted):
    forward = {}
    for p, top in wanted.items():
        assert forward.setdefault(top, found[signed(p)]) == found[signed(p)]
    assert len(set(forward.values())) == len(forward)


@pytest.mark.parametrize("seed", range(3))
def test_no_link_is_lost_among_planted_neighbours(spark, seed):
    rng = random.Random(seed)
    prints = []
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.append(p)
        for _ in range(rng.randrange(5)):  # chains of steps of 1 to 6 bits
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                p ^= 1 << b
            prints.append(p)
    prints += [0, (1 << 64) - 1, 1 << 63, 15]
    same_partition(links(spark, prints), plain_groups(prints))


def test_every_place_of_four_bits_is_found(spark):
    rng = random.Random(9)
    prints = []
    for i in range(300):
        p = rng.getrandbits(64)
        near = p
        for b in rng.sample(range(64), 4 if i % 2 else 5):
            near ^= 1 << b
        prints += [p, near]
    wanted = plain_groups(prints)
    assert len(set(wanted.values())) == 450
    same_partition(links(spark, prints), wanted)


def test_a_dense_group_makes_no_pairs(spark):
    middle, rng = 0x0123456789ABCDEF, random.Random(3)
    prints = {middle}
    while len(prints) < 1200:
        a, b = rng.sample(range(64), 2)
        prints.add(middle ^ 1 << a ^ 1 << b)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    assert simhash._close(df).count() <= 65 * len(prints)
    assert len(set(links(spark, prints).values())) == 1


def test_prints_of_one_group_at_one_key_are_not_paired(spark):
    """8,000 prints with two equal segments: as one group they make no pairs, and a print of
    another group among them is still linked."""
    chance = random.Random(6)
    low = chance.getrandbits(26)
    crowd = {chance.getrandbits(38) << 26 | low for _ in range(8000)}
    near = [next(iter(crowd)) ^ (1 << 40) ^ (1 << 50) ^ (1 << 60)]
    rows = [(signed(p), 1) for p in crowd] + [(signed(p), 2) for p in near if p not in crowd]
    prints = spark.createDataFrame(rows, "fp bigint, root bigint").repartition(4)
    alone = simhash._ring(prints.where("root = 1"), 4)
    begin = time.monotonic()
    assert alone.count() == 0
    assert time.monotonic() - begin < 60
    found = {tuple(r) for r in simhash._ring(prints, 4).distinct().collect()}
    assert found and found <= {(1, 2), (2, 1)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 4), (9, 9), (30, 20), (20, 10)]
    edges += [(n, n + 1) for n in range(100, 180)] + [(n, 500) for n in range(501, 560)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    roots = {r.node: r.root for r in found}
    assert len(found) == len(roots)
    assert {roots[n] for n in (1, 2, 3)} == {1} and roots[5] == 4 and roots[30] == 10
    assert {roots[n] for n in range(100, 181)} == {100} and {roots[n] for n in range(500, 560)} == {500}
    assert 9 not in roots
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_of_odd_rows(odd, none):
    rows = simhash.groups(odd).collect()
    prints = {(i, t): plain_fingerprint(t) for i, t, *_ in ODD}
    tops = plain_groups(set(prints.values()))
    least = {}
    for (i, t), p in prints.items():
        if i is not None:
            least[tops[p]] = min(i, least.get(tops[p], i))
    wanted = sorted((str(i), signed(plain_fingerprint(t)), least.get(tops[plain_fingerprint(t)])) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in rows) == wanted
    assert simhash.groups(none).count() == 0


def test_one_document_of_each_group_stays(odd, none):
    kept = simhash.keep_first(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in rows]
    assert sorted(str(i) for i in ids) == sorted(
        ["1", "3", "6", "7", "8", "9", "10", "11", "12", "13", "14", "None", "None"]
    )
    assert simhash.keep_first(none).count() == 0


def plain_repeats(rows, width):
    first, texts = {}, [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    for i, words in texts:
        for at in range(len(words) - width + 1):
            key = tuple(words[at : at + width])
            first[key] = min(first.get(key, i), i, key=order)
    found = []
    for i, words in texts:
        gone = set()
        for at in range(len(words) - width + 1):
            if order(first[tuple(words[at : at + width])]) < order(i):
                gone |= set(range(at, at + width))
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone)
        found.append((str(i), len(words), len(gone), kept.decode()))
    return sorted(found)


def found_repeats(docs, width):
    rows = substrings.repeats(docs, width).collect()
    return sorted((str(r["row"]["doc_id"]), r.n_words, r.n_removed, r.kept) for r in rows)


def test_repeats_of_odd_rows(odd, none):
    assert found_repeats(odd, 50) == plain_repeats([(i, t) for i, t, *_ in ODD], 50)
    assert substrings.repeats(none).count() == 0


@pytest.mark.parametrize("width", [1, 3])
def test_repeats_of_random_texts(spark, width):
    rng = random.Random(width)
    rows = [
        (rng.choice([None, *range(12)]), " ".join(rng.choices("abcdefgh", k=rng.randrange(30))))
        for _ in range(40)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_repeats(docs, width) == plain_repeats(rows, width)


def test_documents_without_repeats_stay_as_they_were(odd):
    left = {(r.doc_id, r.n_chars): r for r in substrings.without_repeats(odd).collect()}
    assert substrings.without_repeats(odd).columns == odd.columns
    assert left[(6, len(LONG))].text == LONG and left[(5, 4)].text == " \t\n "
    assert left[(3, 0)].text is None
    assert left[(7, len(PASSAGE) + 19)].text == f"before it {PASSAGE} after it"
    shortened = next(r for r in left.values() if r.doc_id == 8)
    assert shortened.text == "ends elsewhere in another way" and shortened.n_chars == len(shortened.text)
    assert all(PASSAGE not in (r.text or "") for r in left.values() if r.doc_id != 7)


def test_same_text_in_many_documents_goes_from_all_but_one(spark):
    rows = [(i, f"{PASSAGE} {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substrings.repeats(docs).collect()
    kept = {r["row"]["doc_id"]: r.n_removed for r in found}
    assert kept == {i: 0 if i == 0 else 60 for i in range(300)}
    digest = hashlib.sha256(b"299").hexdigest()
    last = next(r for r in found if r["row"]["doc_id"] == 299)
    assert hashlib.sha256(last.kept.encode()).hexdigest() == digest
