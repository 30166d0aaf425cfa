"""Personal data: fixed forms, and what stands in the same contexts.

Strings of a fixed form are the seeds. The words around a seed are a pattern; a pattern is
trusted as far as what stands in it all over the corpus is known to be personal data. A
string that only looks like an identifier is trusted as far as the best pattern it stands
in, which in turn lets further patterns be trusted, for some rounds. Identifiers in trusted
patterns are added to what the fixed forms find.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthgrain.llm.words import BASE, mixed, pieces, read_words, word_hashes
from growthgrain.session import shared_folder

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(len(KINDS))
#: Scores are whole millionths, so sums of them are the same in any order.
SURE = 1_000_000
#: A pattern is trusted from this score on, if so many different known strings stand in it.
TRUST, SUPPORT = 800_000, 3
ROUNDS = 3
#: Patterns whose occurrences one reading of the texts counts; more take more readings.
PATTERNS_AT_ONCE = 4_000_000
BEGIN = np.uint64(0xBE61)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SIGN = re.compile(r"[0-9@]|[(\[{](?:at|AT)[)\]}]")
GAP = re.compile(r"[\x20\x09-\x0D]")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def _emails(text: str) -> Iterator[Span]:
    """Each @ with the characters before and after it; no character is looked at twice."""
    at, end = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            end = domain.end()
            yield Span(begin, EMAIL, end)
        at = text.find("@", max(end, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed forms in code points, by start and kind; those of one kind do not
    overlap. A match that fails its test is dropped with all its characters."""
    found = list(_emails(text))
    for m in ADDRESS.finditer(text):
        if all(map(_small, m.group().split("."))):
            found.append(Span(m.start(), IP, m.end()))
    for m in NUMBER.finditer(text):
        digits = NOT_DIGIT.sub("", m.group()) if m.end() - m.start() >= 14 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(Span(m.start(), CARD, m.end()))
    for m in CALL.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            found.append(Span(m.start(), PHONE, m.end()))
    return sorted(found)


#: Forms that an identifier without a fixed form may have, by kind.
LOOKS = {
    EMAIL: re.compile(r"[^\s@]+(?:@|[(\[{](?:at|AT)[)\]}])[^\s@]+"),
    IP: re.compile(r"[0-9]+(?:\.[0-9]+){3,}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}"),
    CARD: re.compile(r"[0-9](?:-?[0-9]){11,18}"),
    PHONE: re.compile(r"\+?\(?[0-9](?:[().-]{0,2}[0-9]){6,14}"),
}
EDGE = ".,;:!?\"'`*#$%&<>|~^=_/\\"
#: No identifier is longer; a longer word is not looked at.
LONGEST_LOOK = 128


class Candidate(NamedTuple):
    start: int
    end: int
    kinds: tuple[int, ...]


def candidates(text: str, base: list[Span]) -> list[Candidate]:
    """Words, edges trimmed, that look like identifiers and touch no span of ``base``."""
    found, at, nearest, until = [], 0, 0, 0
    while sign := SIGN.search(text, at):
        begin = sign.start()
        while begin > at and text[begin - 1] not in " \t\n\v\f\r":
            begin -= 1
        gap = GAP.search(text, sign.end())
        at = gap.start() if gap else len(text)
        while nearest < len(base) and base[nearest].start < at:
            until = max(until, base[nearest].end)
            nearest += 1
        if until > begin or at - begin > LONGEST_LOOK:
            continue
        word = text[begin:at]
        start = begin + len(word) - len(word.lstrip(EDGE))
        word = word.strip(EDGE)
        kinds = tuple(k for k, form in LOOKS.items() if form.fullmatch(word))
        if kinds:
            found.append(Candidate(start, start + len(word), kinds))
    return found


def contexts(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two patterns each word stands in: the two words before it, and the word before
    and the word after it. Zero where a text has no word before, or none after."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    left = np.zeros(n, np.uint64)
    left[1:] = hashes[:-1]
    left_2 = np.full(n, BEGIN, np.uint64)
    left_2[2:] = np.where(place[2:] >= 2, hashes[:-2], BEGIN)
    right = np.zeros(n, np.uint64)
    right[:-1] = hashes[1:]
    last = np.zeros(n, bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    before = mixed(mixed(left_2 * np.uint64(BASE) + np.uint64(1)) * np.uint64(BASE) + left)
    around = mixed(mixed(left * np.uint64(BASE) + np.uint64(2)) * np.uint64(BASE) + right)
    return np.where(place > 0, before, 0), np.where((place > 0) & ~last, around, 0)


def _bytes_at(text: str, places: list[int]) -> list[int]:
    """Byte offsets of ascending code point offsets."""
    found, before, total = [], 0, 0
    for place in places:
        total += len(text[before:place].encode())
        found.append(total)
        before = place
    return found


def _patterns_of(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """The patterns that spans stand in, in the order of the spans: that before the word in
    which a span begins, and that around it if the span ends in the same word."""
    words = read_words([text.encode()], lower=True)
    before, around = contexts(word_hashes(words), words.first)
    order = sorted({x for s, e in spans for x in (s, e - 1)})
    byte = dict(zip(order, _bytes_at(text, order), strict=True))
    found = []
    for s, e in spans:
        i, j = (int(np.searchsorted(words.starts, byte[x], "right")) - 1 for x in (s, e - 1))
        own = [before[i], around[i]] if i == j else [before[i]]
        found.append([int(p) for p in np.array(own, np.uint64).view(np.int64) if p != 0])
    return found


SPAN = "struct<start:bigint,kind:int,`end`:bigint>"
EDGE_ROW = "struct<start:bigint,`end`:bigint,kind:int,seed:boolean,instance:bigint,pattern:bigint>"


def _instance(text: str) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(text.lower().encode())).view(np.int64))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, base, edges = batch.column("text"), [], []
        for text in texts:
            text = text.as_py() or ""
            spans = base_spans(text)
            looks = candidates(text, spans)
            base.append([s._asdict() for s in spans])
            edges.append([])
            if not spans and not looks:
                continue
            given = [(s.start, s.end, (s.kind,), True) for s in spans]
            given += [(c.start, c.end, c.kinds, False) for c in looks]
            patterns = _patterns_of(text, [g[:2] for g in given])
            for (start, end, kinds, seed), own in zip(given, patterns, strict=True):
                name = _instance(text[start:end])
                edges[-1] += [
                    {"start": start, "end": end, "kind": k, "seed": seed, "instance": name, "pattern": p}
                    for k in kinds
                    for p in own
                ]
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        edge = pa.struct(
            [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("seed", pa.bool_())]
            + [("instance", pa.int64()), ("pattern", pa.int64())]
        )
        columns = [batch.column("row"), pa.array(base, pa.list_(span)), pa.array(edges, pa.list_(edge))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "base", "edges"])


def scan(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs`` but the text), ``base``, the spans of fixed form, and
    ``edges``, the patterns that these and other identifiers stand in."""
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    given = docs.select(F.struct(*others).alias("row"), docs.text)
    row = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(_scan, f"row {row}, base array<{SPAN}>, edges array<{EDGE_ROW}>")


def _occurrences(texts: DataFrame, patterns: np.ndarray) -> DataFrame:
    """``pattern`` and ``total``: how often each of the sorted ``patterns`` has a word in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(patterns), np.int64)
        for batch in batches:
            column = batch.column("text")
            for a, b in pieces(column):
                words = read_words(column[a:b].cast(pa.binary()).to_pylist(), lower=True)
                for found in contexts(word_hashes(words), words.first):
                    at = np.minimum(np.searchsorted(patterns, found), len(patterns) - 1)
                    total += np.bincount(at[patterns[at] == found], minlength=len(patterns))
        some = np.flatnonzero(total)
        columns = [pa.array(patterns[some].view(np.int64)), pa.array(total[some])]
        yield pa.RecordBatch.from_arrays(columns, names=["pattern", "total"])

    counted = texts.mapInArrow(count, "pattern bigint, total bigint")
    return counted.groupBy("pattern").agg(F.sum("total").alias("total"))


def totals(texts: DataFrame, patterns: DataFrame, at_once: int = PATTERNS_AT_ONCE) -> DataFrame:
    """``pattern`` and ``total`` over all texts, a reading of them for each ``at_once``
    patterns, which are sent to the tasks as one sorted array."""
    n = max(1, -(-patterns.count() // at_once))
    parts = None
    for i in range(n):
        own = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == i).select("pattern")
        sorted_own = np.sort(own.toArrow()["pattern"].to_numpy().view(np.uint64))
        if len(sorted_own):
            part = _occurrences(texts, sorted_own).checkpoint()
            parts = part if parts is None else parts.unionByName(part)
    return patterns.select("pattern", F.lit(0).cast("bigint").alias("total")) if parts is None else parts


class Graph(NamedTuple):
    """``edges``: how often an instance stands in a pattern as a kind, and whether it is a
    seed there; ``totals``: how often a pattern has any word in it. Patterns with fewer
    than ``SUPPORT`` different instances, which nothing can make trusted, are left out."""

    edges: DataFrame
    totals: DataFrame


def graph(found: DataFrame, texts: DataFrame, support: int = SUPPORT) -> Graph:
    rows = found.select(F.inline("edges"))
    edges = rows.groupBy("pattern", "instance", "kind", "seed").agg(F.count("*").alias("n"))
    edges = edges.checkpoint()
    each = edges.select("pattern", "instance").distinct()
    often = each.groupBy("pattern").agg(F.count("*").alias("instances"))
    often = often.where(F.col("instances") >= support).select("pattern").checkpoint()
    return Graph(edges.join(often, "pattern").checkpoint(), totals(texts, often))


def _confidence(edges: DataFrame, scores: DataFrame, all_words: DataFrame, support: int, trust: int) -> DataFrame:
    """``pattern``, ``kind`` and ``confidence`` of the patterns that are trusted now."""
    known = edges.join(scores, ["instance", "kind"]).groupBy("pattern", "kind")
    known = known.agg(
        F.sum(F.col("n") * F.col("score")).alias("sum"), F.count_distinct("instance").alias("support")
    )
    # a span of several words is no single word in its pattern's count of those around one
    share = F.least(F.floor(F.col("sum") / F.greatest("total", F.lit(1))), F.lit(SURE))
    return (
        known.where(F.col("support") >= support)
        .join(all_words, "pattern")
        .select("pattern", "kind", share.alias("confidence"))
        .where(F.col("confidence") >= trust)
    )


def trusted(
    of: Graph, rounds: int = ROUNDS, support: int = SUPPORT, trust: int = TRUST
) -> DataFrame:
    """``pattern``, ``kind`` and ``confidence`` (millionths) of the patterns trusted after
    ``rounds`` rounds of scoring patterns by instances and instances by patterns."""
    seeds = of.edges.where("seed").select("instance", "kind").distinct()
    seeds = seeds.withColumn("score", F.lit(SURE).cast("bigint")).checkpoint()
    scores, patterns = seeds, None
    for _ in range(rounds):
        patterns = _confidence(of.edges, scores, of.totals, support, trust).checkpoint()
        if patterns.isEmpty():
            break
        others = of.edges.where("not seed").join(seeds, ["instance", "kind"], "left_anti")
        heard = others.join(patterns, ["pattern", "kind"]).groupBy("instance", "kind")
        scores = seeds.unionByName(heard.agg(F.max("confidence").alias("score"))).checkpoint()
    return patterns


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(one, ",")


def _number_of(spans: str, kind: int) -> Column:
    # a second parameter of the function would be the place of the span, whatever its default
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def private_spans(
    docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: int = TRUST
) -> DataFrame:
    """``row`` (the columns of ``docs`` but the text), the numbers of base spans by kind,
    ``base`` and ``spans``: the spans of fixed form, and those with the spans that trusted
    patterns add, as arrays of (``start``, ``kind``, ``end``) in code points.

    A missing or empty text has no spans. Texts are read whole, in time that grows with
    their length; a word of over 128 characters is no candidate. A missing ``doc_id`` stays
    missing, a repeated row is a document of its own; a string that repeats supports a
    pattern once. An empty table gives no rows. Further columns stay in ``row``.
    """
    shared_folder(docs.sparkSession)
    found = scan(docs).withColumn("number", F.monotonically_increasing_id()).checkpoint()
    patterns = trusted(graph(found, docs.select("text"), support), rounds, support, trust)
    looks = found.select("number", F.inline("edges")).where("not seed")
    added = looks.join(patterns.drop("confidence"), ["pattern", "kind"])
    span = F.struct("start", "kind", "end")
    added = added.groupBy("number").agg(F.collect_set(span).alias("added"))
    added = added.select(F.col("number").alias("added_to"), "added")
    whole = found.join(added, F.col("number") == F.col("added_to"), "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(
        F.array_sort(F.concat("base", "added"))
    )
    counts = [_number_of("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return whole.select("row", *counts, "base", spans.alias("spans"))
