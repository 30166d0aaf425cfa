"""Chat logs: collapse cumulative snapshots and render what is left.

A chat that is logged again after each turn leaves one conversation per snapshot, each a
prefix of the next. Hashes of the turns so far, rolled along each conversation, tell
which conversations are the beginning of a longer one; those go.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The markers of the format, and what stands for them in a text.
TURN = "<|im_start|>%s\n%s<|im_end|>\n"
MARKER, INSTEAD = r"<\|(im_start|im_end)\|>", "< |$1|>"
NO_ROLE = "unknown"


#: A conversation by a text that is never missing, so that windows, joins and groups on it
#: share one exchange of the texts.
KEY = "_conversation"


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(conv_id.cast("string"), F.lit("=")), F.lit(""))


def _conv_id(turns: DataFrame) -> Column:
    number = F.when(F.col(KEY) != "", F.left(KEY, F.length(KEY) - 1))
    return number.cast(turns.schema["conv_id"].dataType)


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation and a hash of the turns so far.

    The hash is the exclusive or of two 64-bit hashes of every (place, role, text).
    """
    rows = turns.select(
        _key(turns.conv_id).alias(KEY),
        turns.turn.alias("turn"),
        F.coalesce(turns.role, F.lit(NO_ROLE)).alias("role"),
        F.coalesce(turns.text, F.lit("")).alias("text"),
    )
    in_order = Window.partitionBy(KEY).orderBy("turn", "role", "text")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    this = F.struct("turn", "role", "text")
    return (
        rows.withColumn("before", F.lag(this).over(in_order))
        .where(~this.eqNullSafe(F.col("before")))
        .withColumn("place", F.row_number().over(in_order))
        .withColumn("one", F.xxhash64("place", "role", "text"))
        .withColumn("other", F.xxhash64("text", "role", "place"))
        .select(
            KEY,
            "place",
            "role",
            "text",
            F.bit_xor("one").over(so_far).alias("one"),
            F.bit_xor("other").over(so_far).alias("other"),
            F.max("place").over(whole).alias("n_turns"),
        )
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_turns`` of the conversations that begin no longer one.

    Of equal conversations that with the smallest ``conv_id`` stays.
    """
    numbered = _numbered(turns)
    key = ["n_turns", "one", "other"]
    whole = numbered.where(F.col("place") == F.col("n_turns"))
    whole = whole.groupBy(*key).agg(F.min(_conv_id(turns)).alias("conv_id"))
    begun = numbered.where(F.col("place") < F.col("n_turns"))
    begun = begun.select(F.col("place").alias("n_turns"), "one", "other").distinct()
    return whole.join(begun, key, "left_anti").select("conv_id", "n_turns")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn between markers; markers inside it are broken up."""
    clean = [F.regexp_replace(part, MARKER, INSTEAD) for part in (role, text)]
    return F.format_string(TURN, *clean)


def collapse(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``rendered`` of the conversations that stay.

    Turns go by ``turn``, ``role`` and ``text``, missing values first; a row that repeats
    another counts once. A missing role is "unknown", a missing text empty. Rows without
    ``conv_id`` are one conversation. An empty table gives no rows; further columns are
    not read. A conversation, and so its texts, is held by one task; the texts pass one
    exchange.
    """
    left = maximal(turns).select(_key(F.col("conv_id")).alias(KEY))
    kept = _numbered(turns).join(left, KEY, "left_semi")
    line = F.struct("place", rendered_turn(F.col("role"), F.col("text")).alias("line"))
    lines = F.array_sort(F.collect_list(line))
    return kept.groupBy(KEY).agg(
        F.count("*").alias("n_turns"), F.array_join(lines["line"], "").alias("rendered")
    ).select(_conv_id(turns).alias("conv_id"), "n_turns", "rendered")


SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations
), r AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM t
), p AS (
  SELECT conv_id, place, n, md5(string_agg(role || chr(1) || text || chr(2), '')
    OVER (PARTITION BY conv_id ORDER BY place)) AS so_far
  FROM r
), whole AS (
  SELECT n, so_far, min(conv_id) AS conv_id FROM p WHERE place = n GROUP BY n, so_far
), maximal AS (
  SELECT conv_id FROM whole w WHERE NOT EXISTS (
    SELECT 1 FROM p WHERE p.place < p.n AND p.place = w.n AND p.so_far = w.so_far)
)
SELECT conv_id, count(*) AS n_turns,
  string_agg('<|im_start|>' || regexp_replace(role, '<\\|(im_start|im_end)\\|>', '< |\\1|>', 'g')
    || chr(10) || regexp_replace(text, '<\\|(im_start|im_end)\\|>', '< |\\1|>', 'g')
    || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM r JOIN maximal USING (conv_id) GROUP BY conv_id
"""
