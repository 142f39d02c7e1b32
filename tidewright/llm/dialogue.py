"""Multi-party perspective rotation of conversations (operator 5), by DataFrame functions only.

Every participant of a conversation gets a rendering in which they are the assistant, the others are named users and
system turns stay system turns; the mask lists the character spans that the participant is to be trained on: their own
texts and the end marks after them. Marks inside a text are left as they are: the mask goes by position.

Every participant gets the whole dialogue, whatever its length. A row holds at most ``PART_ROWS`` messages of it, counted
by their place in the conversation, so that no row or group grows with a conversation; a dialogue of more messages comes in
several rows. The ``rendered`` of a perspective, joined in order of part, are the whole dialogue; ``start`` is the number
of characters before the part, and ``mask_spans`` count from the dialogue's start. Parts in which the participant is
silent are there, with an empty ``mask_spans``.

Places come from one sort of all messages over ranges of (conversation, turn, role, text), written once: a conversation
that holds many of all rows spreads over many tasks. Lengths are summed over parts on counts alone, without the texts.

Turns go by turn number, then role, then text, nulls first. Repeated rows are one message, dropped before the sort. A null
role is a user named ``unknown`` and no participant, nor is an empty one; a null text is empty; rows with a null
conv_id are one conversation. Conversations without a participant have no row. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import checkpoint

#: Messages of a row of the result.
PART_ROWS = 512
#: Parts of a conversation that meet its participants in one task.
CHUNK = 64
END = "<|end|>"


def _head(role: Column, perspective: Column) -> Column:
    return (
        F.when(role == perspective, F.lit("<|assistant|>\n"))
        .when(role == "system", F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), F.coalesce(role, F.lit("unknown")), F.lit("|>\n")))
    )


def placed(turns: DataFrame) -> DataFrame:
    """Distinct messages (conv_id, turn, role, text, at): ``at`` counts from 0 within a conversation."""
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("range", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    rows = checkpoint(rows)
    shares = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    shares = shares.select(F.col("conv_id").alias("conv"), F.col("range").alias("its"), shift)
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("range") == F.col("its"))
    return rows.join(shares, same).select(*order, (F.col("i") + F.col("shift")).alias("at"))


def rotate(turns: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_id, part, perspective, start, n_turns, n_own, rendered, mask_spans, n_trained) of every part of each
    conversation for each of its participants."""
    part = F.floor(F.col("at") / part_rows).alias("part")
    message = F.struct("at", "role", "text")
    parts = placed(turns).groupBy("conv_id", part).agg(F.sort_array(F.collect_list(message)).alias("messages"))
    parts = checkpoint(parts)
    # Characters of a part where nobody is the assistant, and what each speaker's own messages change in it.
    plain = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.length(_head(m["role"], F.lit(None))) + F.length(m["text"]) + len(END) + 1)
    roles = F.transform("messages", lambda m: m["role"])
    named = F.array_distinct(F.filter(roles, lambda r: r.isNotNull() & ~r.isin("", "system")))
    sizes = parts.select("conv_id", "part", plain.alias("plain"), roles.alias("roles"), named.alias("named"))
    speakers = sizes.select("conv_id", "part", F.explode("named").alias("perspective"))
    last = speakers.groupBy("conv_id").agg(F.max("part").alias("spoken"))
    ends = sizes.groupBy("conv_id").agg(F.max("part").alias("last")).join(last.withColumnRenamed("conv_id", "conv"), F.col("conv_id").eqNullSafe(F.col("conv")))
    ends = ends.select("conv", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / CHUNK))).alias("chunk"))
    people = speakers.select(F.col("conv_id").alias("who"), "perspective").distinct()
    people = people.join(ends, F.col("who").eqNullSafe(F.col("conv"))).drop("who")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.floor(F.col("part") / CHUNK) == F.col("chunk"))
    own = F.size(F.filter("roles", lambda r: r == F.col("perspective")))
    gain = F.length(_head(F.col("perspective"), F.col("perspective"))) - F.length(_head(F.col("perspective"), F.lit(None)))
    each = sizes.join(people, same).select("conv_id", "part", "perspective", (F.col("plain") + own * gain).alias("size"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")).alias("start")
    each = each.select(F.col("conv_id").alias("conv"), F.col("part").alias("its"), "perspective", start)
    return _render(parts.join(each, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("its"))))


def _render(each: DataFrame) -> DataFrame:
    """The rendering of each row's ``messages`` for its ``perspective``, its spans counted on from ``start``."""
    said = F.transform(
        "messages",
        lambda m: F.struct(
            F.coalesce(m["role"] == F.col("perspective"), F.lit(False)).alias("own"),
            _head(m["role"], F.col("perspective")).alias("head"), m["text"].alias("text"),
        ),
    )
    each = each.select("conv_id", "part", "perspective", "start", said.alias("said"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["head"])
        end = start + F.length(m["text"]) + len(END)
        return F.struct(
            (end + 1).alias("at"),
            F.when(m["own"], F.concat(acc["trained"], F.array(F.struct(start.alias("b"), end.alias("e"))))).otherwise(acc["trained"]).alias("trained"),
        )

    zero = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<b:bigint,e:bigint>>").alias("trained"))
    masked = each.withColumn("trained", F.aggregate("said", zero, step, lambda acc: acc["trained"]))
    rendered = F.array_join(F.transform("said", lambda m: F.concat(m["head"], m["text"], F.lit(END + "\n"))), "")
    spans = F.array_join(F.transform("trained", lambda s: F.concat_ws("-", s["b"].cast("string"), s["e"].cast("string"))), ",")
    n_trained = F.aggregate("trained", F.lit(0).cast("long"), lambda n, s: n + s["e"] - s["b"])
    return masked.select(
        "conv_id", "part", "perspective", "start", F.size("said").cast("long").alias("n_turns"), F.size("trained").cast("long").alias("n_own"),
        rendered.alias("rendered"), spans.alias("mask_spans"), n_trained.alias("n_trained"),
    )


ORACLE_SQL = """
WITH d AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS k FROM d
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role NOT IN ('', 'system')
), s AS (
  SELECT m.conv_id, m.k, m.k // 512 AS part, p.perspective, m.text, coalesce(m.role = p.perspective, false) AS own,
         CASE WHEN m.role = p.perspective THEN '<|assistant|>' || chr(10)
              WHEN m.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || coalesce(m.role, 'unknown') || '|>' || chr(10) END AS head
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
), l AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS segment,
         CAST(coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, perspective ORDER BY k
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM s
)
SELECT conv_id, part, perspective, min(a) AS start, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(segment, '' ORDER BY k) AS rendered,
       coalesce(string_agg(CAST(a + length(head) AS VARCHAR) || '-' || CAST(a + length(head) + length(text) + 7 AS VARCHAR), ',' ORDER BY k)
         FILTER (own), '') AS mask_spans,
       CAST(coalesce(sum(length(text) + 7) FILTER (own), 0) AS BIGINT) AS n_trained
FROM l GROUP BY conv_id, part, perspective
"""
