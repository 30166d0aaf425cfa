"""Katz scores, languages and syncmer fingerprints, against plain Python."""

import hashlib
import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import ODD, none, odd, shared  # noqa: F401
from pyspark.sql import functions as F

from growthgrain.llm import katz, language, queries, syncmers
from growthgrain.llm.words import read_words


def plain_discounts(times):
    """What part of a count of 1 to 5 stays, from how many n-grams are seen 1 to 6 times."""
    out = []
    for r in range(1, 6):
        d = -1
        if all(times):
            d = ((r + 1) * times[r] / times[r - 1] / r - 6 * times[5] / times[0]) / (
                1 - 6 * times[5] / times[0]
            )
        out.append(d if 0 < d < 1 else 1 - 0.5 / r)
    return out


class PlainKatz:
    """The model with dictionaries; ``P(word | history)`` by recursion."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for words in texts:
            padded = ["<s>"] * (order - 1) + words
            for i in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    self.counts[n][tuple(padded[i - n + 1 : i + 1])] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.after, self.factor = {}, {}
        for n in range(2, order + 1):
            times = Counter(self.counts[n].values())
            self.factor[n] = plain_discounts([times[r] for r in range(1, 7)])
            for gram in self.counts[n]:
                self.after.setdefault(gram[:-1], []).append(gram[-1])

    def discounted(self, gram):
        c = self.counts[len(gram)][gram]
        return c * (self.factor[len(gram)][c - 1] if c <= 5 else 1)

    def chance(self, word, history):
        if not history:
            return (self.counts[1][(word,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
        seen = self.after.get(history, [])
        if not seen:
            return self.chance(word, history[1:])
        of = sum(self.counts[len(history) + 1][(*history, w)] for w in seen)
        kept = sum(self.discounted((*history, w)) for w in seen)
        left, room = (of - kept, of) if of - kept > 1e-9 else (1, of + 1)
        if word in seen:
            return self.discounted((*history, word)) / room
        unseen = 1 - sum(self.chance(w, history[1:]) for w in seen)
        return left / room / unseen * self.chance(word, history[1:])

    def score(self, words):
        padded, n = ["<s>"] * (self.order - 1) + words, self.order - 1
        return sum(
            math.log10(self.chance(padded[i], tuple(padded[i - n : i]))) for i in range(n, len(padded))
        )


def tokens(text):
    return [*(text or "").encode().lower().split(), "</s>"]


def check_scores(docs, rows, learns, order, **sizes):
    plain = PlainKatz([tokens(t) for i, t in rows if learns(i)], order)
    base = PlainKatz([tokens(t) for i, t in rows if learns(i)], 1)
    train = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    found = katz.scores(docs, train, order, **sizes).select("row.doc_id", *[f.split()[0] for f in katz.SCORES.split(", ")])
    found = sorted(found.collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.score))
    wanted = sorted(
        ((str(i), len(tokens(t)), plain.score(tokens(t)), base.score(tokens(t)), t) for i, t in rows),
        key=lambda r: r[:3],
    )
    assert len(found) == len(wanted)
    for r, (i, n, score, base_score, text) in zip(found, wanted):
        assert (str(r.doc_id), r.n_tokens, r.train_tokens) == (i, n, plain.n)
        assert r.n_known == sum(base.counts[1][(w,)] > 0 for w in tokens(text))
        assert r.score == pytest.approx(score, rel=1e-9)
        assert r.base_score == pytest.approx(base_score, rel=1e-9)
    return plain


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_of_odd_rows(odd, none, order):
    learns = lambda i: i is None or i % 5 != 1
    check_scores(
        odd.where("doc_id is null or doc_id <> 6"),
        [(i, t) for i, t, *_ in ODD if i != 6],
        learns,
        order,
    )
    assert katz.scores(none, F.lit(True), order).count() == 0


def some_words(n, per_text, seed=5):
    rng = random.Random(seed)
    words = lambda: [rng.choice(["hot", "hot", f"w{rng.randrange(60)}", f"v{rng.randrange(3000)}"]) for _ in range(rng.randrange(per_text))]
    return [(i, " ".join(words())) for i in range(n)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_frequent_histories_and_many_buckets(spark, order):
    rows = some_words(200, 120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    learns = lambda i: i % 5 != 1
    check_scores(docs, rows, learns, order, chunk_bytes=6000, often=3)


def test_questions_in_two_rounds(spark):
    rows = some_words(120, 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check_scores(docs, rows, lambda i: i % 5 != 1, 3, chunk_bytes=6000, often=3, rounds=2)


def test_words_of_one_chunk_alone(spark):
    rows = [(i, f"a{i // 9} b{i // 9} a{i // 9} c{i % 3} a{i // 9} b{i // 9}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    check_scores(docs, rows, lambda i: i % 5 != 1, 3, chunk_bytes=200)


def told(texts, training, level):
    """What the buckets tell one chunk per text of n-grams of a length, and the chunks' readers."""
    sizes, totals, rows = katz.Sizes(3, 2, 1000), [], []
    tables = [
        pa.table({"chunk": [i]} | {f.split()[0]: [v] for f, v in zip(katz.TOKENS.split(", "), found)})
        for i, found in enumerate(
            katz.cut_texts([t.encode()], np.array([learns])) for t, learns in zip(texts, training)
        )
    ]
    for _ in range(level):
        readers = [
            katz.Reader(table, [a for a in rows if a["chunk"] == i], totals, sizes)
            for i, table in enumerate(tables)
        ]
        asked = [row for i, reader in enumerate(readers) for row in reader.ask(i, 0, 1)]
        found = []
        for bucket in range(sizes.n_buckets):
            mine = [row for row in asked if row["bucket"] == bucket]
            found += katz._count(katz._message(mine)).to_pylist() if mine else []
        totals.append([sum(a[c] or 0 for a in found if a["kind"] == katz.TOTALS) for c in katz.NUMBERS])
        rows += [a for a in found if a["kind"] == katz.COUNTS]
    return [a for a in rows if a["level"] == level]


@pytest.mark.parametrize("level", [2, 3])
def test_numbers_of_histories_go_only_where_a_word_is_unseen(level):
    learnt = " ".join(f"a b w{i} c" for i in range(40))
    for text, some in ((learnt, False), ("a b other", True)):
        answers = told([learnt, learnt + " d", text], [True, True, False], level)
        numbers = [len(katz.unpack(a[c])) for a in answers for c in ("seen", "lower") if a[c]]
        assert len(answers) > 3 and (sum(numbers) > 0) == some
        assert sum(numbers) <= 2 * 6 * len(text.split()) * some


def test_places_in_ascending_order():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        for top in (1, 3, 1 << 20):
            upper = rng.integers(0, top, n).astype(np.uint64) << np.uint64(44)
            for low in (1, 7, 1 << 30):
                keys = upper | rng.integers(0, low, n).astype(np.uint64)
                order = katz._order(keys)
                assert (np.sort(keys) == keys[order]).all()
                assert (np.sort(order) == np.arange(n)).all()


def test_tables_go_once_scores_are_there(spark, shared):
    import subprocess

    docs = spark.createDataFrame(some_words(20, 30), "doc_id bigint, text string")
    folder = shared.removeprefix("file:")
    names = lambda: set(subprocess.run(["ls", folder], capture_output=True, text=True).stdout.split())
    before = names()
    found = katz.scores(docs, F.lit(True), 3)
    (new,) = names() - before
    kept = subprocess.run(["ls", f"{folder}/{new}"], capture_output=True, text=True).stdout.split()
    assert new.startswith("katz-") and kept == ["scores"]
    assert found.count() == 20
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan and plan.count("\n") < 60


def test_probabilities_after_a_history_add_up_to_one():
    texts = [tokens(t) for t in ("a b a c", "a b b", "c c c c c c c c", "", "a b a b a b")]
    plain = PlainKatz(texts, 3)
    words = [w for (w,) in plain.counts[1]]
    for history in [*plain.after, (b"never",), (b"a", b"never")]:
        total = sum(plain.chance(w, history) for w in [*words, "unknown"])
        assert total == pytest.approx(1)


def test_discounts():
    good = katz.discounts([1000, 300, 150, 90, 60, 40])
    assert ((good > 0) & (good < 1)).all()
    r = np.arange(1, 6)
    assert np.allclose(katz.discounts([5, 0, 0, 0, 0, 0]), (r - 0.5) / r)


def test_nothing_to_learn_from(odd):
    rows = katz.scores(odd, F.lit(False)).collect()
    assert len(rows) == len(ODD) and all(r.train_tokens == 0 and r.n_known == 0 for r in rows)
    assert all(r.score == 0 for r in rows)


@pytest.fixture(scope="module")
def vocabulary():
    return language.Vocabulary(language.vocabulary_path())


def test_forward_sums_over_all_segmentations(vocabulary):
    chance = np.random.default_rng(1).random((vocabulary.size, 3)) * 1e-3
    pieces = defaultdict(float)
    for i in range(vocabulary.size):
        piece = vocabulary.model.id_to_piece(i)
        if vocabulary.model.is_byte(i):
            pieces[bytes([int(piece[3:5], 16)])] += chance[i]
        elif not vocabulary.model.is_control(i) and not vocabulary.model.is_unknown(i):
            pieces[piece.replace("▁", " ").encode()] += chance[i]
    text = ("Hello wörld of straße ééé Étion 梦 x " + "y" * 70 + " zé%%").encode()
    words = read_words([text, None, b""])
    found = vocabulary.forward(words, np.arange(len(words.starts)), chance)
    for word, logs in zip(text.split(), found, strict=True):
        total, word = 0, b" " + word
        for at in range(0, len(word), language.LONGEST):
            part = word[at : at + language.LONGEST]
            sums = [np.ones(3), *(np.zeros(3) for _ in part)]
            for end in range(1, len(part) + 1):
                for begin in range(end):
                    if part[begin:end] in pieces:
                        sums[end] = sums[end] + sums[begin] * pieces[part[begin:end]]
            total = total + np.log(sums[-1])
        assert np.allclose(total, logs)


@pytest.mark.parametrize("most", [0, 60, 10**6])
def test_kept_word_scores_are_those_of_the_forward_pass(vocabulary, monkeypatch, most):
    monkeypatch.setattr(language, "MOST_KEPT", most)
    chance = np.random.default_rng(2).random((vocabulary.size, 3)) * 1e-3
    kept = language._WordScores(vocabulary, chance)
    for text in ("one two three two", "", "two four five größer", "one five six seven eight", "two"):
        words = read_words([text.encode()])
        hashes, at, _ = language._distinct(words)
        assert np.array_equal(kept.of(words, hashes, at), vocabulary.forward(words, at, chance))
        assert kept.logs.size <= max(most, 3 * len(at))


def test_languages_of_odd_rows(odd, none):
    found = language.predict(odd, F.lit(True)).collect()
    assert len(found) == len(ODD)
    for r in found:
        assert 0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es", "und"}
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (3, 4, 5, 11))
    assert by_id[9].lang_pred == "de" and by_id[1].lang_pred == "en"
    assert {r.lang_pred for r in language.predict(odd, F.lit(False)).collect()} == {"und"}
    assert language.predict(none, F.lit(True)).count() == 0


def test_numbers_are_no_letters(spark):
    texts = ["½ ² ①", "Ⅳ ⅷ", "٣ 三", "① a", "ª", "12 _ %", "ʰ"]
    assert [language.has_letter(t) for t in texts] == [False, False, True, True, True, False, True]
    rows = [(i, t, "en") for i, t in enumerate([*texts, "some words to learn from"])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    found = {r.doc_id: r for r in language.predict(docs, F.col("doc_id") == 7).collect()}
    assert [found[i].lang_pred for i in range(7)] == ["und", "und", "en", "en", "en", "und", "en"]
    assert found[0].score == 0


def plain_predictions(rows, vocabulary):
    """Language and score of each text, learned from the rows marked for it, with dictionaries."""
    pieces, counts = defaultdict(list), defaultdict(lambda: np.zeros(vocabulary.size))
    for i in range(vocabulary.size):
        piece = vocabulary.model.id_to_piece(i)
        if vocabulary.model.is_byte(i):
            pieces[bytes([int(piece[3:5], 16)])].append(i)
        elif not vocabulary.model.is_control(i) and not vocabulary.model.is_unknown(i):
            pieces[piece.replace("▁", " ").encode()].append(i)
    for text, lang, learns in rows:
        if learns and text is not None and lang is not None:
            for word in text.encode().split():
                np.add.at(counts[lang], vocabulary.model.encode(word.decode()), 1)
    langs = sorted(counts)
    share = np.array([counts[x] / max(counts[x].sum(), 1) for x in langs]).T
    chance = (1 - language.FLOOR) * share + language.FLOOR / vocabulary.size
    found = []
    for text, _, _ in rows:
        if not langs or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            found.append(("und", 0.0))
            continue
        total = np.zeros(len(langs))
        for word in text.encode().split():
            word = b" " + word
            for at in range(0, len(word), language.LONGEST):
                part = word[at : at + language.LONGEST]
                sums = [np.ones(len(langs)), *(np.zeros(len(langs)) for _ in part)]
                for end in range(1, len(part) + 1):
                    for begin in range(end):
                        for i in pieces.get(part[begin:end], []):
                            sums[end] = sums[end] + sums[begin] * chance[i]
                total = total + np.log(sums[-1])
        best = int(np.argmax(total))
        found.append((langs[best], 1 / np.exp(total - total[best]).sum()))
    return found


def test_predictions_are_those_of_plain_python(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 30")
    rows = [(r.text and r.text[:400], r.lang, r.doc_id % 5 != 0) for r in docs.orderBy("doc_id").collect()]
    rows += [(t, lang, i % 3 > 0) for i, (_, t, lang, _) in enumerate(ODD) if len(t or "") < 1000]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, text string, lang string, learns boolean")
    found = language.predict(table.repartition(3), F.col("learns")).orderBy("doc_id").collect()
    for r, (lang, score) in zip(found, plain_predictions(rows, vocabulary), strict=True):
        assert r.lang_pred == lang
        assert r.score == pytest.approx(score, rel=1e-9)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held_out = language.held_out(F.col("doc_id"))
    found = language.predict(docs, ~held_out).join(docs, "doc_id").where(held_out)
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95


def plain_likeness(a, b):
    cut = lambda s: {s[i : i + 8] for i in range(0, len(s), 8)}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check_edits(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    found = defaultdict(list)
    for r in syncmers.edited_pairs(docs).collect():
        found[(r.doc_id, r.n_chars)].append(r)
    prints = {}
    for (i, text) in rows:
        r = found[(i, len(text or ""))][0]
        assert prints.setdefault(text or "", r.fingerprint) == r.fingerprint
    for at, (i, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        same = [
            r
            for r in found[(i, len(text))]
            if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        ]
        assert same, i
        assert same[0].near_edited == plain_likeness(prints[text], same[0].edited_fingerprint)
        assert same[0].near_next == plain_likeness(prints[text], prints[after])
        if edited == text:
            assert same[0].near_edited == 1
    assert sum(map(len, found.values())) == len(rows)


def test_edits_of_odd_rows(odd, none):
    rows = [(i, t) for i, t, *_ in ODD if i is not None and i != 2]
    check_edits(odd.where("doc_id <> 2"), rows)
    everything = syncmers.edited_pairs(odd).collect()
    assert len(everything) == len(ODD) and all(0 <= r.near_edited <= 1 for r in everything)
    same = {r.fingerprint for r in everything if r.doc_id == 2}
    assert len(same) == 1
    assert syncmers.edited_pairs(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 400])
def test_edits_across_ranges(spark, n):
    rng = random.Random(n)
    ids = rng.sample(range(-(1 << 40), 1 << 40), n)
    rows = [(i, " ".join(rng.choices("abcdé", k=rng.randrange(40)))) for i in ids]
    check_edits(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rows)


def test_anchors_are_closed_syncmers_and_move_with_the_text(spark):
    words = [f"w{i * 7919 % 101}" for i in range(200)]
    moved = ["new", "words", *words]
    docs = spark.createDataFrame([(" ".join(words), " ".join(moved))], "a string, b string")
    a, b = syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))
    row = docs.select(a.alias("a"), b.alias("b"), syncmers.aligned(a, b, F.lit(2)).alias("n")).first()
    assert row.n == len(row.a) and 0.4 * 197 < len(row.a) < 0.9 * 197
    shared = {(x.place + 2, x.hash) for x in row.a}
    assert shared <= {(x.place, x.hash) for x in row.b}
    pairs = spark.createDataFrame([(words[i], words[i + 1]) for i in range(199)], "x string, y string")
    hashes = [r[0] for r in pairs.select(F.xxhash64(F.xxhash64("x"), F.xxhash64("y"))).collect()]
    inner = syncmers.INNER
    wanted = [
        i
        for i in range(200 - syncmers.K + 1)
        if min(hashes[i : i + inner]) in (hashes[i], hashes[i + inner - 1])
    ]
    assert [x.place for x in row.a] == wanted


def test_unspaced_text_keeps_its_anchors_when_it_moves(spark):
    rng = random.Random(5)
    long = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4000)) + "𠀀" * 3
    words = "some words of at most sixteencharacter letters " * 3
    rows = [(long, "一" + long), (f"{words}{long} {words}", f"{words}x{long} {words}")]
    docs = spark.createDataFrame(rows, "a string, b string")
    a, b = syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))
    near = syncmers.likeness(syncmers.hashes(a), syncmers.hashes(b))
    for row in docs.select(a.alias("a"), near.alias("near")).collect():
        assert len(row.a) > 1600 and row.near > 0.99
    pieces = F.regexp_extract_all(F.lit("a" * 16 + " " + "bé𠀀" * 6 + "\nend"), F.lit(syncmers.TOKEN), F.lit(0))
    assert docs.select(pieces).first()[0] == ["a" * 16, *"bé𠀀" * 6, "end"]


def test_registered_katz_model_has_three_words(spark, tmp_path):
    texts = ["a b c d a b c", "a b d", "x b c a b c d", "b c", "a b c a b c", "c d a b"]
    rows = [(i, text) for i, text in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.QUERIES["op3_katz"](spark, str(tmp_path)).collect()}
    plain = PlainKatz([tokens(t) for i, t in rows if not found[i].held_out], 3)
    for i, text in rows:
        assert found[i].score == pytest.approx(plain.score(tokens(text)), rel=1e-9)
