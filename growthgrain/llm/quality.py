"""Quality rules on repetition inside a text.

Rolling hashes of the words give every n-gram of several lengths a number; characters
inside n-grams that occur before, and inside lines that occur before, are measured
against the characters of the text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthgrain.llm.words import BASE, covered, mixed, pieces, read_words, word_hashes

#: Largest share, in percent, of the characters of a text in words of n-grams that occur
#: earlier in it, by n (published repetition limits).
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: The same for lines that occur earlier.
LINE_LIMIT = 20
MIN_WORDS = 10
REPEAT_WIDTH = 5
REPEAT_LIMIT = 20
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Bytes that don't start a code point.
INNER = (np.arange(256) & 0xC0) == 0x80

MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "dup_line_chars",
    *[f"dup_{n}gram_chars" for n in LIMITS],
]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which occur at an earlier place."""
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order], prepend=np.uint64(0)) == 0
    if len(same):
        same[0] = False
    found, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[same]] = True
    found[order[same]] = True
    found[order[np.flatnonzero(same) - 1]] = True
    return found, later


def _lines(text: bytes) -> tuple[int, int]:
    """Lines equal to an earlier line, and the characters in their words."""
    seen, n, chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
            chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        elif line and not line.isspace():
            seen.add(line)
    return n, chars


def measures(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Counts of some texts; all but the symbols are 0 for a text without words.

    The n-grams of all texts are sorted together, with the number of the text in their
    hash. Only where an n-gram is repeated can a longer one be.
    """
    words = read_words(texts)
    counts, owner = words.counts(), words.text_of()
    until = np.concatenate([[0], np.cumsum(~INNER[words.data])])
    chars = until[words.ends] - until[words.starts]

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[words.first])

    lines = np.array([_lines(t or b"") for t in texts], np.int64).reshape(-1, 2)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[words.data])])
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    total = {
        "n_words": counts,
        "word_chars": per_text(chars),
        "n_symbols": np.diff(symbols[np.concatenate([[0], ends])]),
        "n_dup_lines": lines[:, 0],
        "dup_line_chars": lines[:, 1],
    }
    hashes = word_hashes(words)
    left = words.first[1:][owner] - np.arange(len(hashes))  # words from here to the text's end
    salt = mixed(owner.astype(np.uint64) + np.uint64(1))
    rolling, places = hashes, np.arange(len(hashes))
    for width in range(2, max(LIMITS) + 1):
        places = places[left[places] >= width]
        rolling = rolling[: len(hashes) - width + 1] * np.uint64(BASE) + hashes[width - 1 :]
        if width not in LIMITS:
            continue
        found, later = _repeats(mixed(rolling[places] + salt[places]))
        marks = np.zeros((2, len(hashes)), bool)
        marks[0, places[found]] = True
        marks[1, places[later]] = True
        if width == REPEAT_WIDTH:
            total["n_repeat_words"] = per_text(covered(marks[0], width))
        total[f"dup_{width}gram_chars"] = per_text(np.where(covered(marks[1], width), chars, 0))
        places = places[found]
    return total


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for a, b in pieces(texts):
            found = measures(texts[a:b].to_pylist())
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), *(pa.array(found[m], pa.int64()) for m in MEASURES)],
                names=["row", *MEASURES],
            )


def repetition(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``) and the measures of its text, without a shuffle.

    A null text has no words. A text is measured whole, however long, one by one where it is
    longer than a megabyte. Every row, also a repeated one, gives a row; an empty
    table gives none. Columns of ``docs`` may have any names, as they stay inside ``row``.
    """
    given = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs.text)
    counts = ", ".join(f"{m} bigint" for m in MEASURES)
    schema = f"row {given.schema['row'].dataType.simpleString()}, {counts}"
    return given.mapInArrow(_measure, schema)


def base_failed() -> F.Column:
    """Too few words, or too many of them in repeated windows of five."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_LIMIT * F.col("n_words")
    )


def verdict() -> F.Column:
    """Whether all shares of repeated characters are within their limits."""
    fine = 100 * F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, limit in LIMITS.items():
        fine = fine & (100 * F.col(f"dup_{n}gram_chars") <= limit * F.col("word_chars"))
    return ~base_failed() & fine


def judged(docs: DataFrame) -> DataFrame:
    """``row``, the measures, and the verdict ``kept``; odd rows as in ``repetition``. A null
    or empty text has too few words and is not kept."""
    return repetition(docs).withColumns({"base_failed": base_failed(), "kept": verdict()})


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they were, repeated rows each."""
    return judged(docs).where("kept").select("row.*")


def _sql() -> str:
    """The same verdict in SQL, n-grams compared by their words."""
    parts, joins, shares = [], [], ["100 * dup_line_chars <= 20 * word_chars"]
    for n, limit in LIMITS.items():
        parts.append(f"""
g{n} AS (
  SELECT doc_id, i, count(*) OVER grams AS times, row_number() OVER (grams ORDER BY i) AS nth
  FROM (SELECT doc_id, i, md5(array_to_string(words[i:i + {n - 1}], ' ')) AS gram
    FROM d, unnest(range(1, len(words) - {n - 2})) AS t(i))
  WINDOW grams AS (PARTITION BY doc_id, gram)
), c{n} AS (
  SELECT doc_id, sum(chars) AS dup_{n}gram_chars FROM w SEMI JOIN (
    SELECT doc_id, unnest(range(i, i + {n})) AS i FROM g{n} WHERE nth > 1) AS late USING (doc_id, i)
  GROUP BY doc_id
)""")
        joins.append(f"LEFT JOIN c{n} USING (doc_id)")
        shares.append(f"100 * dup_{n}gram_chars <= {limit} * word_chars")
    zero = [f"coalesce(dup_{n}gram_chars, 0)::BIGINT AS dup_{n}gram_chars" for n in LIMITS]
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, length(words[i]) AS chars FROM d, unnest(range(1, len(words) + 1)) AS t(i)
), l AS (
  SELECT doc_id, list_sum(list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'),
      lambda x: length(x))) AS chars,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), dl AS (
  SELECT doc_id, count(*) AS n_dup_lines, sum(chars) AS dup_line_chars FROM l WHERE nth > 1
  GROUP BY doc_id
), {",".join(parts)}, r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM g5, unnest(range(i, i + 5)) AS t(j) WHERE times > 1 GROUP BY doc_id
), m AS (
  SELECT doc_id, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {", ".join(zero)}
  FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN r USING (doc_id) {" ".join(joins)}
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND {" AND ".join(shares)} AS kept FROM b
"""


SQL = _sql()
