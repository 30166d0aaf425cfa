"""Source mixing, chat logs, WARC archives and the whole pipeline, against plain Python."""

import gzip
import hashlib
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD, none, odd, shared  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from growthgrain.llm import chats, mixing, packing, quality, simhash, substrings, warc

def plain_targets(sizes, total):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    found = {s: 0.0 for s in names}
    full, left = set(), float(total)
    while True:
        open_weight = sum(weight[s] for s in names if s not in full)
        for s in names:
            if s not in full:
                found[s] = left * weight[s] / open_weight
        over = [s for s in names if s not in full and found[s] > 3 * sizes[s]]
        if not over:
            return found
        for s in over:
            found[s] = 3.0 * sizes[s]
            left -= found[s]
            full.add(s)


def spark_targets(spark, sizes, total):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint").repartition(2)
    return {r.source: r.target for r in mixing.targets(table, total).collect()}


@pytest.mark.parametrize("seed", range(5))
def test_targets_equal_repeated_resharing(spark, seed):
    chance = random.Random(seed)
    names = [None, "", "a", "b", "B", "ü", "z", "梦", "aa"]
    sizes = {s: chance.choice([0, 1, 3, 10, 10**4, 10**9]) for s in names[: 2 + 2 * seed]}
    found = spark_targets(spark, sizes, sum(sizes.values()))
    wanted = plain_targets(sizes, sum(sizes.values()))
    assert found.keys() == wanted.keys()
    for s, t in wanted.items():
        assert found[s] == pytest.approx(t, abs=1e-6, rel=1e-12)


def test_a_hundred_thousand_sources_give_rows(spark):
    n = 100_050
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("two words").alias("text"), F.concat(F.lit("host"), "id").alias("source")
    )
    found = mixing.mix(docs, ["doc_id"]).agg(F.count("*"), F.sum("taken"), F.max("taken")).first()
    assert found[0] == n and abs(found[1] - 2 * n) < n and found[2] == 4


def test_many_groups_of_shared_sources(spark):
    rows = [(i, "w " * (1 + i % 5), f"g{i % 40}", i % 3) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, g string, kind int")
    left, right = (F.concat("g", F.lit(x)) for x in ("a", "b"))
    both = F.when(F.col("kind") == 0, F.array(left)).when(F.col("kind") == 1, F.array(left, right)).otherwise(F.array(right))
    found = mixing.mix(docs, ["doc_id", "g", "kind"], sources=both).collect()
    sizes, words = {}, {}
    for i, text, g, kind in rows:
        pattern = [(f"{g}a",), (f"{g}a", f"{g}b"), (f"{g}b",)][kind]
        words[pattern] = words.get(pattern, 0) + len(text.split())
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + len(text.split())
    wanted = plain_targets(sizes, sum(words.values()))
    amounts = mixing.given(words, {s: int(t + 0.5) for s, t in wanted.items()})
    taken = {}
    for r in found:
        g, kind = r["row"]["g"], r["row"]["kind"]
        pattern = [(f"{g}a",), (f"{g}a", f"{g}b"), (f"{g}b",)][kind]
        taken[pattern] = taken.get(pattern, 0) + r.taken
    assert sum(taken.values()) == sum(amounts.values())
    # patterns without a shared source have one cheapest amount
    assert all(taken[p] <= 3 * words[p] for p in words)


def cheapest(patterns, quotas):
    """The largest total, and the least cost of it, over all whole amounts."""
    best = (-1, 0)
    names = list(quotas)
    for amounts in itertools.product(*[range(3 * n + 1) for n in patterns.values()]):
        reach = all(
            sum(a for p, a in zip(patterns, amounts) if set(p) <= set(some))
            <= sum(quotas[s] for s in some)
            for k in range(len(names) + 1)
            for some in itertools.combinations(names, k)
        )
        if reach:
            cost = sum(
                sum(u // n for u in range(a)) for a, n in zip(amounts, patterns.values()) if a
            )
            best = max(best, (sum(amounts), -cost))
    return best


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2), st.integers(0, 2), st.integers(0, 2), st.lists(st.integers(0, 6), min_size=2, max_size=2))
def test_flow_is_largest_and_cheapest(a, b, ab, quotas):
    patterns = {("a",): a, ("b",): b, ("a", "b"): ab}
    wanted = dict(zip("ab", quotas))
    found = mixing.given(patterns, wanted)
    cost = sum(sum(u // patterns[p] for u in range(n)) for p, n in found.items() if n)
    assert all(n <= 3 * patterns[p] for p, n in found.items())
    assert (sum(found.values()), -cost) == cheapest(patterns, wanted)


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd, ["doc_id", "source"]).collect()
    assert len(rows) == len(ODD)
    sizes = {}
    for _, text, _, source in ODD:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    wanted = plain_targets(sizes, sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r["row"]["source"]]
        assert r.target == pytest.approx(wanted[r["row"]["source"]])
        taken[r["row"]["source"]] += r.taken
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 0.5
    again = mixing.mix(odd.repartition(5), ["doc_id", "source"]).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(none, ["doc_id"]).count() == 0


def test_documents_of_several_sources(spark):
    rows = [(i, "w " * (1 + i % 7), i % 3) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind int")
    both = F.when(F.col("kind") == 0, F.array(F.lit("a"))).when(
        F.col("kind") == 1, F.array(F.lit("b"), F.lit("a"))
    ).otherwise(F.array(F.lit("b")))
    found = mixing.mix(docs, ["doc_id", "kind"], sources=both).collect()
    total = sum(r["size"] for r in found)
    assert abs(sum(r.taken for r in found) - total) <= 2
    assert all(0 <= r.taken <= 3 * r["size"] for r in found)
    by_kind = [sum(r.taken for r in found if r["row"]["kind"] == k) for k in range(3)]
    b_target = 2 / 7 * total
    assert by_kind[2] <= b_target + 1 <= by_kind[1] + by_kind[2] + 2


def test_repeated_documents_are_whole(odd):
    copies = mixing.repeat_documents(odd)
    assert copies.columns == odd.columns
    given_rows = {(r.doc_id, r.text) for r in odd.collect()}
    rows = copies.collect()
    assert {(r.doc_id, r.text) for r in rows} <= given_rows
    taken = mixing.mix(odd, ["doc_id"]).agg(F.sum(F.floor(F.try_divide("taken", "size") + 0.5))).first()[0]
    assert len(rows) == taken


TURNS = "conv_id bigint, turn bigint, role string, text string, place int, n_turns string"


def plain_collapse(rows):
    chats_by_id = {}
    for conv, turn, role, text in set(rows):
        chats_by_id.setdefault(conv, []).append((turn is not None, turn or 0, role or "unknown", text or ""))
    told = {c: tuple((r, t) for _, _, r, t in sorted(set(ts))) for c, ts in chats_by_id.items()}
    found = {}
    for c, ts in told.items():
        longer = any(len(o) > len(ts) and o[: len(ts)] == ts for o in told.values())
        equal = [o for o, other in told.items() if other == ts]
        first = min((o for o in equal if o is not None), default=None)
        if not longer and first == c:
            clean = lambda s: s.replace("<|im_end|>", "< |im_end|>").replace("<|im_start|>", "< |im_start|>")
            lines = [f"<|im_start|>{clean(r)}\n{clean(t)}<|im_end|>\n" for r, t in ts]
            found[c] = (len(ts), "".join(lines))
    return found


def found_collapse(spark, rows):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    found = chats.collapse(turns).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: (r.n_turns, r.rendered) for r in found}


def test_snapshots_collapse(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        whole = [(t, ("user", "assistant")[t % 2], rng.choice("abc")) for t in range(rng.randrange(1, 6))]
        for n in rng.sample(range(1, len(whole) + 1), rng.randrange(1, len(whole) + 1)):
            rows += [(c * 10 + n, *turn) for turn in whole[:n]]
    rows += rows[:20]
    assert found_collapse(spark, rows) == plain_collapse(rows)


def test_odd_turns(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, None, None),
        (2, 0, "user", "hi"),
        (2, 1, "unknown", ""),
        (2, 1, "unknown", "tie"),
        (None, 5, "user", "no id <|im_end|> <|im_start|>system"),
        (3, None, "user", "hi"),
        (4, 7, "user", ""),
        (5, 7, "user", "x" * 100_000),
        (6, 0, "user", "hi"),
        (6, 0, "user", "hi"),
    ]
    assert found_collapse(spark, rows) == plain_collapse(rows)
    assert chats.collapse(spark.createDataFrame([], TURNS)).count() == 0


def pages(spark, rows):
    schema = "page_id bigint, url string, html string, payload string, digest int, n int"
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], schema).repartition(3)


def plain_archive(rows):
    largest = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            largest[html] = max(i, largest.get(html, i))
    found = []
    for i, url, html in rows:
        payload = (html or "").encode()
        to = largest.get(html) if len(payload) >= 1000 else None
        to = None if to == i else to
        kind = "response" if to is None else "revisit"
        found.append((str(i), url, len(payload), hashlib.sha1(payload).hexdigest(), kind, to))
    return sorted(found, key=str)


PAGES = [
    (1, "http://a.example/1", "<p>" + "same " * 300),
    (2, "http://a.example/2", "<p>" + "same " * 300),
    (9, "http://a.example/9?x=%20", "<p>" + "same " * 300),
    (9, "http://a.example/9", "<p>" + "same " * 300),
    (None, "http://a.example/none", "<p>" + "same " * 300),
    (3, None, None),
    (4, "http://a.example/\r\nX: y", ""),
    (5, "u", "short"),
    (6, "u", "short"),
    (7, "ü", "é" * 500),
    (8, "ü", "é" * 500),
    (10, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 3),
    (11, "u", "z" * 300_000),
]


@pytest.mark.parametrize("file_bytes", [1, 3000, 1 << 26])
def test_archives_round_trip(spark, tmp_path, file_bytes):
    folder = f"file://{tmp_path}/archive"
    warc.write_archives(pages(spark, PAGES), folder, file_bytes)
    found = warc.read_archives(spark, folder).collect()
    as_rows = [(str(r.page_id), r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(as_rows, key=str) == plain_archive(PAGES)
    manifest = {r.file: r for r in spark.read.parquet(f"{folder}/manifest").collect()}
    files = {p.name: p.read_bytes() for p in (tmp_path / "archive").glob("*.warc.gz")}
    assert files.keys() == manifest.keys() and not list((tmp_path / "archive").glob("_temporary*"))
    for name, data in files.items():
        assert manifest[name].sha1 == hashlib.sha1(data).hexdigest()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    warc.write_archives(pages(spark, PAGES), f"file://{tmp_path}/again", file_bytes)
    assert {p.name: p.read_bytes() for p in (tmp_path / "again").glob("*.warc.gz")} == files


def many_pages(spark, n=2500):
    html = F.concat(F.lit("<p>"), F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 90).cast("int")))
    shared_id = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 7 == 0, 77).otherwise(F.col("id") * 11)
    return spark.range(n).select(shared_id.alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), html.alias("html"))


def written(spark, table, folder):
    warc.write_archives(table, f"file://{folder}", 50_000)
    names = {p.name: p.read_bytes() for p in folder.glob("*.warc.gz")}
    manifest = spark.read.parquet(f"file://{folder}/manifest").collect()
    return names, sorted(map(tuple, manifest))


def test_files_follow_from_the_pages_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_RANGE_BYTES", 300_000)
    table = many_pages(spark).checkpoint()
    first = written(spark, table.repartition(3), tmp_path / "first")
    assert len({name.split("-")[1] for name in first[0]}) > 8
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = written(spark, table.repartition(11, "url"), tmp_path / "again")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    assert again == first
    # rows without an id, a third of all, are in many ranges
    ids = {r[0].split("-")[1] for r in first[1] if r[4] is None}
    assert len(ids) > 2


def test_a_second_attempt_leaves_the_files_of_the_first(spark, tmp_path):
    table = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").checkpoint()
    first = written(spark, table, tmp_path / "a")
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "a").glob("*.warc.gz")}
    page = {"page_id": 1, "url": "u", "payload": b"abc", "refers_to": None}
    lost = warc._File(f"file://{tmp_path}/a", "pages-000000-0000.warc.gz")
    lost.add(page)  # dies before it is closed
    assert written(spark, table, tmp_path / "a") == first
    assert {p: p.stat().st_mtime_ns for p in times} == times
    assert warc.read_archives(spark, f"file://{tmp_path}/a").count() == len(PAGES)


@pytest.mark.parametrize("most", [0, 100_000])
def test_revisits_with_many_groups(spark, most):
    table = spark.createDataFrame(PAGES * 3, "page_id bigint, url string, html string")
    found = warc.with_revisits(table, most).select("page_id", "url", "refers_to").collect()
    wanted = warc.with_revisits(table).select("page_id", "url", "refers_to").collect()
    assert sorted(found, key=str) == sorted(wanted, key=str) and len(found) == 3 * len(PAGES)


def test_leftover_files_do_not_count(spark, tmp_path):
    folder = str(tmp_path / "archive")
    warc.write_archives(pages(spark, PAGES[:3]), folder)
    (tmp_path / "archive" / "pages-000099-0000.warc.gz").write_bytes(b"of a lost attempt")
    assert warc.read_archives(spark, folder).count() == 3


def test_damage_is_found(spark, tmp_path):
    record = gzip.decompress(warc.page_record({"page_id": 1, "url": "u", "payload": b"abc", "refers_to": None}))
    assert warc.read_record(record)["payload_bytes"] == 3
    with pytest.raises(ValueError):
        warc.read_record(record.replace(b"abc", b"abd"))


def test_no_pages(spark, tmp_path):
    folder = str(tmp_path / "archive")
    warc.write_archives(pages(spark, PAGES).limit(0), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_pipeline_stages_keep_columns_and_take_effect(spark, odd, none, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        given_columns = docs.columns
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert docs.columns == given_columns
    assert sum(len(r.ids) for r in docs.collect()) == docs.agg(F.sum("length")).first()[0]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_pipeline_is_its_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = quality.keep_good(docs)
    docs = simhash.keep_first(docs)
    docs = substrings.without_repeats(docs)
    docs = mixing.repeat_documents(docs)
    wanted = packing.pack_documents(docs, with_ids=False).groupBy("doc_id", "ids_crc32").count()
    found = corpus_pipeline.run(spark, folder).groupBy("doc_id", "ids_crc32").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert found.count() > 100
