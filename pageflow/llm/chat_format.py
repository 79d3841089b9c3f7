r"""Chat formatting by prefix-target expansion (operator 4).

Every assistant turn becomes an example of its own: all preceding turns are its context and only
that reply is trainable. A turn is written as an opening mark for its role, the text and ``</s>``:

    [INST]question</s>[/INST]reply</s>

``<<SYS>>`` opens system turns, ``<<ROLE:hex>>`` those of any other role. In texts, a backslash goes in
front of every control string and every backslash, so that formatting is reversible for any text.

``formatted`` gives each turn its place in the conversation's formatted text, and for an assistant turn the
example's number and the span of its loss mask. ``expanded`` writes the examples out: a row per reply, with
the whole text from the conversation's first turn to the reply, and a row for turns after the last reply. ``stored_turns``
parses that output: of each example the turns that the one before it did not have, and the text under its mask.

Whole examples grow with the square of a conversation's length; their number is that of the replies. One row holds one
example, so a conversation has to fit in a row; no task holds more than one conversation's text and one batch of
rows. zstd keeps what neighbouring examples share nearly once on disk. Digests are taken from sorted rows one after the other.

Null texts count as empty, null roles as the empty role. Turns are ordered by (turn, role, text), nulls
first, so ties and repeated rows have a fixed order; rows without conv_id form one conversation.
Turns after the last reply are kept without loss mask. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageflow.llm.common import table, written

END = "</s>"
OPENING = {"user": "[INST]", "assistant": "[/INST]", "system": "<<SYS>>"}
#: Control strings of the template and the escape sign itself.
CONTROL = r"\\|</?s>|\[/?INST\]|<</?SYS>>|<<ROLE:"
PROBE = "</s>[INST] ok [/INST]"


def escaped(text) -> F.Column:
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescaped(text) -> F.Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def opening(role) -> F.Column:
    known = F.lit(None).cast("string")
    for name, mark in OPENING.items():
        known = F.when(role == name, F.lit(mark)).otherwise(known)
    return F.coalesce(known, F.concat(F.lit("<<ROLE:"), F.hex(F.encode(role, "utf-8")), F.lit(">>")))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, at, piece, example, loss_start, loss_end): the stream of each conversation, a row
    per turn. Offsets are code points in the stream; example and loss are null but for replies."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("mark", opening(F.col("role"))).withColumn("body", escaped(F.col("text")))
    rows = rows.withColumn("piece", F.concat("mark", "body", F.lit(END)))
    reply = F.col("role") == "assistant"
    rows = rows.withColumn("pos", F.count(F.lit(1)).over(order) - 1).withColumn("to", F.sum(F.length("piece")).over(order))
    rows = rows.withColumn("example", F.when(reply, F.count(F.when(reply, 1)).over(order) - 1))
    end = F.col("to") - len(END)
    return rows.select(
        "conv_id", "pos", (F.col("to") - F.length("piece")).alias("at"), "piece", "example",
        F.when(reply, end - F.length("body")).alias("loss_start"), F.when(reply, end).alias("loss_end"),
    )


def expanded(stream: DataFrame) -> DataFrame:
    """(conv_id, example, text, at, loss_start, loss_end, first, since): prefix-target expansion, a row per reply.

    ``text`` is all from the conversation's first turn to the reply. Turns from ``first`` on, at offset ``since``, are not
    in the example before. Turns after the last reply are a row without example, which starts at offset ``at``.
    """
    turn = F.struct("pos", "at", "piece", "example", "loss_start", "loss_end")
    whole = stream.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.withColumn("text", F.array_join(F.transform("turns", lambda x: x["piece"]), ""))
    # where examples end: behind each reply, and behind the last turn
    stops = F.filter("turns", lambda x: x["example"].isNotNull() | (x["pos"] == F.size("turns") - 1))
    narrow = F.transform(stops, lambda x: F.struct(x["pos"].alias("pos"), (x["at"] + F.length(x["piece"])).alias("to"), x["example"].alias("example"), x["loss_start"].alias("loss_start"), x["loss_end"].alias("loss_end")))
    whole = whole.select("conv_id", "text", narrow.alias("stops"))
    rows = whole.select("conv_id", "text", "stops", F.posexplode("stops").alias("k", "stop"))
    before = F.when(F.col("k") > 0, F.get("stops", F.col("k") - 1))
    rows = rows.select("conv_id", "text", "stop.*", F.coalesce(before["pos"] + 1, F.lit(0)).alias("first"), F.coalesce(before["to"], F.lit(0)).alias("since"))
    at = F.when(F.col("example").isNull(), F.col("since")).otherwise(0)
    rows = rows.withColumn("at", at).withColumn("text", F.substring("text", F.col("at") + 1, F.col("to") - F.col("at")))
    return rows.select("conv_id", "example", "text", "at", "loss_start", "loss_end", "first", "since")


def examples(stream: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): the examples written out in full."""
    return expanded(stream).filter("example IS NOT NULL").select("conv_id", "example", "text", "loss_start", "loss_end")


#: A turn in a text: up to the first end mark that no backslash escapes.
PIECE = rf"(?s)(?:[^\\<]++|\\.|<(?!/s>))*+{END}"


def stored_turns(rows: DataFrame) -> DataFrame:
    """The stream of :func:`formatted`, read from the texts and masks of :func:`expanded`: each turn from the first example that has it."""
    new = F.substring("text", F.col("since") - F.col("at") + 1, F.length("text"))
    pieces = rows.select("conv_id", "example", "first", "loss_start", "loss_end", F.regexp_extract_all(new, F.lit(PIECE), F.lit(0)).alias("pieces"))
    each = pieces.select("conv_id", "example", "first", "loss_start", "loss_end", F.size("pieces").alias("n"), F.posexplode("pieces").alias("k", "piece"))
    own = (F.col("k") == F.col("n") - 1) & F.col("example").isNotNull()
    return each.select(
        "conv_id", (F.col("first") + F.col("k")).alias("pos"), F.when(own, F.col("loss_end") + len(END) - F.length("piece")).alias("at"), "piece",
        *[F.when(own, F.col(c)).alias(c) for c in ("example", "loss_start", "loss_end")],
    )


def read_back(stream: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, loss): turns and trainable texts parsed from the formatted stream."""
    mark = F.regexp_extract("piece", r"^(\[/?INST\]|<<SYS>>|<<ROLE:[0-9A-F]*>>)", 1)
    role = F.decode(F.unhex(F.regexp_extract(mark, "^<<ROLE:(.*)>>$", 1)), "utf-8")
    for name, sign in OPENING.items():
        role = F.when(mark == sign, F.lit(name)).otherwise(role)
    inner = F.substring("piece", F.length(mark) + 1, F.length("piece") - F.length(mark) - len(END))
    loss = F.substring("piece", F.col("loss_start") - F.col("at") + 1, F.col("loss_end") - F.col("loss_start"))
    return stream.select("conv_id", "pos", role.alias("role"), unescaped(inner).alias("text"), unescaped(loss).alias("loss"), F.length("piece").alias("chars"))


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation from its turns in order; a task holds one batch of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, state = None, None

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, role, text, loss, chars in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "loss", "chars")), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += chars
            if len(done) >= 10_000:
                yield _batch(done)
                done = []
        close()
        yield _batch(done)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.select("conv_id", "role", "text", "loss", "chars").mapInArrow(run, DIGESTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [()] * 6
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    made = written(expanded(formatted(turns.unionByName(probe))), "examples", "zstd")
    return digests(read_back(stored_turns(made)))


SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), f AS (
  SELECT *, length(regexp_replace(text, '({CONTROL})', '\\\1', 'g')) + {len(END)}
    + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 WHEN 'system' THEN 7 ELSE 9 + length(hex(role)) END AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
