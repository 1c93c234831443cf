"""Multi-party perspective rotation of dialogues, in DataFrame functions.

For every participant of a dialogue the whole dialogue is rendered with that speaker as assistant and the
others as named users; only what the assistant says is to be learned. A rendering is a sequence of rows, one a
turn, with the places of its text and of its loss span in the whole. Turns are range-partitioned by dialogue,
turn and row, so a long dialogue is spread over tasks; running lengths are made within a task's part of a
dialogue and shifted by the parts before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import table, written

END = "<|end|>\n"


def rotate(turns: DataFrame, system: tuple[str, ...] = ("system",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, position, turn, author, piece, start, mask_start, mask_end) for every speaker and turn.

    piece is the rendered turn, start its place (in characters) in the speaker's rendering, and the mask is the
    span of an assistant's words and end sign, null for other turns. Roles in ``system`` stay system turns and
    are nobody's perspective, so a dialogue of such turns only has no rendering. A null role is the speaker
    "unknown", a null text is empty, a null conv_id is a dialogue of its own. Turns of one number are ordered by
    role, then text (nulls first); repeated rows stay. The opening of a sign within a text or name is broken up.
    """
    spark = turns.sparkSession
    speaker = F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), speaker.alias("name"), F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("name"), F.col("text"), F.col("row")]
    parts = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", *order)
    rows = written(parts.withColumn("part", F.spark_partition_id()), "turns")
    is_system = F.col("name").isin(*system) if system else F.lit(False)
    speakers = rows.where(~is_system).select(F.col("conv_id").alias("c"), F.col("name").alias("speaker")).distinct()
    # Turns meet the speakers within their part, so that a long dialogue is not put into one task.
    places = rows.select(F.col("conv_id").alias("d"), F.col("part").alias("at")).distinct()
    speakers = speakers.join(places, F.col("c").eqNullSafe(F.col("d"))).drop("d")
    each = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("at"))).drop("c", "at")
    own = ~is_system & (F.col("name") == F.col("speaker"))
    author = F.when(is_system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    named = F.concat(F.lit("<|user name="), F.translate("name", "<|>\n\r", "_____"), F.lit("|>\n"))
    head = F.when(is_system, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(named)
    each = each.select("conv_id", "speaker", "turn", "name", "row", "part", author.alias("author"), F.length(head).alias("head"), F.concat(head, F.col("text"), F.lit(END)).alias("piece"), "text")
    each = each.withColumn("n", F.length("piece").cast("long"))
    sums = each.groupBy("conv_id", "speaker", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    inside = Window.partitionBy("conv_id", "speaker", "part").orderBy(*order)
    local = each.withColumns({"k1": F.row_number().over(inside) - 1, "n1": F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    joined = local.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("part") == F.col("p")))
    start = (F.col("n0") + F.col("n1")).cast("long")
    mask = lambda x: F.when(F.col("author") == "assistant", x)
    return joined.select("conv_id", "speaker", (F.col("k0") + F.col("k1")).cast("long").alias("position"), "turn", "author", "piece", start.alias("start"), mask(start + F.col("head")).alias("mask_start"), mask(start + F.col("n")).alias("mask_end"))


def renderings(rotated: DataFrame) -> DataFrame:
    """(conv_id, speaker, text, masks) in one row each, for dialogues that fit into one."""
    pieces = F.sort_array(F.collect_list(F.struct("position", "piece", "mask_start", "mask_end"))).alias("p")
    return rotated.groupBy("conv_id", "speaker").agg(pieces).select(
        "conv_id", "speaker", F.array_join("p.piece", "").alias("text"), F.transform(F.filter("p", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("masks")
    )


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id AS c, name AS speaker FROM t WHERE name <> 'system'),
e AS (
  SELECT conv_id, speaker, turn, name, text, CASE WHEN name = 'system' THEN 'system' WHEN name = speaker THEN 'assistant' ELSE 'user' END AS author,
    CASE WHEN name = 'system' THEN '<|system|>' WHEN name = speaker THEN '<|assistant|>' ELSE '<|user name=' || translate(name, '<|>' || chr(10) || chr(13), '_____') || '|>' END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.c),
r AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS piece,
    row_number() OVER w - 1 AS position
  FROM e WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, name, text)),
q AS (
  SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM r)
SELECT conv_id, speaker, CAST(position AS BIGINT) AS position, turn, author, piece, start,
  CASE WHEN author = 'assistant' THEN CAST(start + length(head) AS BIGINT) END AS mask_start, CASE WHEN author = 'assistant' THEN CAST(start + length(piece) AS BIGINT) END AS mask_end
FROM q
"""
