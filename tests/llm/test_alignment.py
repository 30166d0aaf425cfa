"""Alignment of two tokenizers against plain Python."""

import hashlib
import json
from collections import Counter, defaultdict

import pytest
from odd_rows import ODD, none, odd, shared  # noqa: F401
from pyspark.sql import functions as F

from growthgrain.llm import alignment

TEXTS = [
    "The cat sat on the mat, antidisestablishmentarianism.",
    "größer Straße über 日本語 😀 naïve",
    "aaaa aaa aa aaaaaaaaa a" * 3,
    "<|endoftext|> and <s> and <0x41> are plain text here",
    "a\ttab\nand  two spaces\r\n",
    "text with ▁ in it",
    "é composed ﬁne ½",
    " " * 12_000,
    "\x00 nul",
]


@pytest.fixture(scope="module")
def plain():
    """Encoders and the bytes of each id, from the files alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    files = alignment.public_files()
    whole = Tokenizer.from_file(files.tokenizer)
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
    symbols, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            symbols[chr(b)] = b
        else:
            symbols[chr(256 + extra)] = b
            extra += 1
    vocabulary = json.load(open(files.tokenizer))["model"]["vocab"]
    a_bytes = {i: bytes(symbols[c] for c in entry) for entry, i in vocabulary.items()}

    def b_bytes(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    def cut(text):
        if not text:
            return None
        a = whole.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        if {b"".join(map(a_bytes.get, a)), b"".join(map(b_bytes, b))} != {(" " + text).encode()}:
            return None
        return [(i, len(a_bytes[i])) for i in a], [(i, len(b_bytes(i))) for i in b]

    return cut


def ranges(tokens):
    at, found = 0, []
    for i, size in tokens:
        found.append((i, at, at + size))
        at += size
    return found


def links(a, b):
    """Every overlapping pair, by walking both lists."""
    found, j = [], 0
    for i, begin, end in a:
        while b[j][2] <= begin:
            j += 1
        k = j
        while k < len(b) and b[k][1] < end:
            found.append((i, b[k][0]))
            k += 1
    return found


def groups(a, b):
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    at, parts = 0, []
    for cut in cuts:
        parts.append("|".join(",".join(str(i) for i, s, e in x if at < e <= cut) for x in (a, b)))
        at = cut
    return ";".join(parts)


def brute(cut, texts):
    made, holds = [], Counter()
    for text in texts:
        both = cut(text)
        if both is None:
            made.append(None)
            continue
        a, b = map(ranges, both)
        own = links(a, b)
        made.append((a, b, own, groups(a, b) if len(text) < 5000 else None))
        holds.update(set(own))
    best = defaultdict(int)
    for (a, _), n in holds.items():
        best[a] = max(best[a], n)
    rows = []
    for m in made:
        if m is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, own, text = m
        n_groups = len({e for _, _, e in a} & {e for _, _, e in b})
        digest = hashlib.sha256(text.encode()).hexdigest() if text is not None else None
        n_best = sum(holds[p] == best[p[0]] for p in own)
        rows.append((len(a), len(b), n_groups, len(own), n_best, sum(holds[p] for p in own), digest))
    return rows, holds


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same_rows(found, wanted):
    assert len(found) == len(wanted)
    for r, w in zip(found, wanted, strict=True):
        assert tuple(r[n] for n in NAMES[:6]) == w[:6]
        if w[6] is not None:
            assert r.groups_sha256 == w[6]


@pytest.mark.parametrize("chunk_bytes", [200, 8_000_000])
def test_links_are_those_of_plain_python(spark, plain, chunk_bytes):
    texts = [t + f" {i % 3}" for i in range(4) for t in TEXTS] + TEXTS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    found = alignment.linked(docs, chunk_bytes=chunk_bytes).orderBy("row.doc_id").collect()
    wanted, holds = brute(plain, texts)
    assert any(w[0] == 0 for w in wanted)
    same_rows(found, wanted)
    counted = alignment.pair_counts(docs, chunk_bytes=chunk_bytes).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in counted} == dict(holds)
    assert len(counted) == len(holds)


def test_sample_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    found = alignment.linked(docs, chunk_bytes=50_000).orderBy("row.doc_id").collect()
    same_rows(found, brute(plain, [r.text for r in rows])[0])


def test_odd_rows(spark, odd, none, plain):  # noqa: F811
    found = sorted(alignment.linked(odd).collect(), key=lambda r: (str(r.row.doc_id), r.n_a, r.n_b))
    wanted, _ = brute(plain, [r[1] for r in ODD])
    wanted = [w for _, w in sorted(zip([str(r[0]) for r in ODD], wanted, strict=True), key=lambda p: (p[0], *p[1][:2]))]
    same_rows(found, wanted)
    assert found[0].row.lang is not None and found[0].row.chunk == "c"
    assert alignment.linked(none).count() == 0


def test_groups_without_counts(spark, odd, plain):  # noqa: F811
    found = alignment.aligned(odd).where("row.doc_id = 1").select("groups").first().groups
    a, b = map(ranges, plain(ODD[0][1]))
    assert found == groups(a, b)


def test_most_links_need_no_shuffle(spark):
    """Groups of one token each are counted in vectors; only other pairs are rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    files = alignment.public_files()
    chunk = alignment._chunks(docs, files, 8_000_000).agg(
        F.sum(F.size("same")).alias("same"), F.sum(F.size("pairs")).alias("pairs")
    )
    assert chunk.first().same > 0
    aligner = alignment.Aligner(files)
    for a, b in enumerate(aligner.same[:2000].tolist()):
        assert b < 0 or aligner.a_bytes[a] == aligner.b_bytes[b]
