"""Repetition rules, packing, and the word helpers, against plain Python."""

import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from growthgrain.llm import packing, quality
from growthgrain.llm import words as w

from odd_rows import ODD, none, odd, shared  # noqa: F401

TEXT = st.text(alphabet="ab é\n\t#", max_size=60).map(str.encode)


def plain_measures(text):
    words = text.split()
    found = dict.fromkeys(quality.MEASURES, 0)
    found["n_words"] = len(words)
    found["word_chars"] = sum(len(x.decode()) for x in words)
    found["n_symbols"] = sum(c in "#*$%&|<>" for c in text.decode())
    seen = set()
    for line in text.split(b"\n"):
        if line.split() and line in seen:
            found["n_dup_lines"] += 1
            found["dup_line_chars"] += sum(len(x.decode()) for x in line.split())
        seen.add(line)
    for n in quality.LIMITS:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        times, seen, every, late = Counter(grams), set(), set(), set()
        for i, gram in enumerate(grams):
            every |= set(range(i, i + n)) if times[gram] > 1 else set()
            late |= set(range(i, i + n)) if gram in seen else set()
            seen.add(gram)
        found[f"dup_{n}gram_chars"] = sum(len(words[i].decode()) for i in late)
        if n == 5:
            found["n_repeat_words"] = len(every)
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=5))
def test_measures_equal_plain_counting(texts):
    found = quality.measures(texts)
    for i, text in enumerate(texts):
        assert {m: found[m][i] for m in quality.MEASURES} == plain_measures(text or b"")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=5), st.integers(1, 6))
def test_words_and_windows(texts, width):
    words = w.read_words(texts)
    plain = [x for t in texts for x in (t or b"").split()]
    assert [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends)] == plain
    assert words.counts().tolist() == [len((t or b"").split()) for t in texts]
    hashes = w.word_hashes(words)
    assert len(set(hashes.tolist())) == len(set(plain))
    windows = [tuple(plain[i : i + width]) for i in range(len(plain) - width + 1)]
    assert len(set(w.window_hashes(hashes, width).tolist())) == len(set(windows))
    numbers = np.sort(hashes)
    assert (w.unpack_sorted(w.pack_sorted(numbers)) == numbers).all()


def test_hashes_do_not_depend_on_place():
    long = [b"q" * n for n in (1, 7, 8, 9, 63, 64, 65, 200)]
    one = w.word_hashes(w.read_words([b" ".join(long)]))
    other = w.word_hashes(w.read_words([b"shift " + b"  ".join(long)]))[1:]
    assert (one == other).all() and len(set(one.tolist())) == len(long)


def test_windows_across_pieces(monkeypatch):
    hashes = w.mixed(np.arange(1000, dtype=np.uint64) % np.uint64(37))
    whole = w.window_hashes(hashes, 9)
    monkeypatch.setattr(w, "SLICE", 64)
    assert (w.window_hashes(hashes, 9) == whole).all()


def test_rules_on_odd_rows(odd, none):
    rows = quality.judged(odd).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        text = next(t for i, t, *_ in ODD if i == row["row"]["doc_id"] and len(t or "") == row["row"]["n_chars"])
        for m, n in plain_measures((text or "").encode()).items():
            assert row[m] == n, (m, text)
        assert row["base_failed"] == (row["n_words"] < 10 or 100 * row["n_repeat_words"] > 20 * row["n_words"])
        assert not (row["kept"] and row["base_failed"])
    assert {r["row"]["doc_id"] for r in rows if r["kept"]} == {1, 2, None, 7, 8, 9, 6} - {
        r["row"]["doc_id"] for r in rows if r["base_failed"]
    }
    kept = quality.keep_good(odd)
    assert kept.schema == odd.schema and kept.count() == sum(r["kept"] for r in rows)
    assert quality.judged(none).count() == 0


def test_repeated_passage_is_rejected_beyond_its_share(spark):
    base = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame(
        [(1, " ".join(base)), (2, " ".join(base + base[:9])), (3, " ".join(base + base[:40]))],
        "doc_id bigint, text string",
    )
    kept = {r["row"]["doc_id"]: r["kept"] for r in quality.judged(docs).collect()}
    assert kept == {1: True, 2: True, 3: False}


@given(st.integers(1, 20_000))
def test_cuts(n):
    found = packing.cuts(n)
    assert sum(found) == n and found == sorted(found, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 1024 for x in found)
    assert max(Counter(x for x in found if x < 1024).values(), default=1) == 1


def test_packing_holds_every_token_once(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    rows = packing.pack_documents(odd).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by_doc = {}
    for r in rows:
        assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    wanted = Counter()
    for doc_id, text, *_ in ODD:
        ids = [*known.encode(text or "", add_special_tokens=False).ids, 0]
        wanted[(doc_id, tuple(ids))] += 1
    for (doc_id, ids), copies in wanted.items():
        pieces = sorted((r.start, r.length, tuple(r.ids)) for r in by_doc[(doc_id, len(ids))])
        assert pieces == sorted(
            (s, len(p), p)
            for s, p in ((s, ids[s : s + n]) for s, n in _starts(len(ids)))
            for _ in range(copies)
        )
    assert packing.pack_documents(none).count() == 0


def _starts(n):
    at = 0
    for length in packing.cuts(n):
        yield at, length
        at += length


def test_special_strings_are_text():
    encode = packing.encoder(packing.vocabulary_path()).encode_ordinary
    assert 50256 not in encode("a <|endoftext|> b")


def test_ids_are_those_of_the_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>" * 3, " <|endoftext| > x", "é " * 9000]
    texts += ["x" + " " * 1_000_000 + "y", "\n" * 1_000_000, "a" + "\u3000" * 9_999 + "b"]
    rows = packing.pack_documents(
        spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ).collect()
    assert 50256 in known.encode(texts[0], add_special_tokens=False).ids
    for i, text in enumerate(texts):
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = [*known.encode(text, add_special_tokens=False).ids, 0]
        assert [x for r in pieces for x in r.ids] == ids
        assert [(r.start, r.length) for r in pieces] == list(_starts(len(ids)))
        assert {r.doc_tokens for r in pieces} == {len(ids)}
