"""Operator 3: chat formatting from event logs.

A conversation is a log of events: a message starts, grows by streamed deltas, is edited or regenerated, and ends. Events are
folded by message (so a conversation of a third of all rows is spread over tasks), the final messages are rendered, and the
rendered turns of a conversation are put in order by a sort within partitions and read as a stream. Control strings inside
texts are escaped by a backslash after their first character, and one more where there are some already, so it can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomframe.llm.common import read, small_batches

START, END = "<|im_start|>", "<|im_end|>"
#: What follows the first character (< or [) of control strings of common chat templates.
CONTROL = r"\||INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>"
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({CONTROL})")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)
#: Characters of a streamed delta.
DELTA = 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def events(rows: DataFrame) -> DataFrame:
    """The log of finished turns (conv_id, turn, role, text): (conv_id, turn, message, copies, seq, kind, text).

    Assistant messages were streamed, stopped after the first delta and regenerated; others were sent in part and then edited.
    message tells rows of one turn apart, by 128 bits; copies counts equal rows. Null texts and roles are empty.
    """
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    # one pass over the text: a substring for each delta would walk to its place from the start
    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda part: event("delta", part))
    first = F.array(event("start", F.col("role")), event("delta", F.substring("text", 1, DELTA)))
    streamed = F.concat(first, F.array(event("regenerate", F.lit(""))), deltas)
    edited = F.concat(first, F.array(event("edit", F.col("text"))))
    told = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    log = F.when(F.col("role") == "assistant", streamed).otherwise(edited)
    # beside the explode it would be worked out for every event
    own = own.withColumn("message", told)
    return own.select("conv_id", "turn", "message", "copies", F.posexplode(F.concat(log, F.array(event("end", F.lit(""))))).alias("seq", "e")).select("conv_id", "turn", "message", "copies", "seq", "e.kind", "e.text")


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): final messages. In order of seq: start sets the role, delta adds text, edit puts
    its text in place of all, regenerate begins anew; other kinds do nothing. A message without a start has an empty role."""
    own = log.groupBy("conv_id", "turn", "message", "copies").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))).alias("log"))
    # the text is what was added from the last edit or regeneration on, joined once: no growing copies
    cut = F.array_max(F.filter("log", lambda e: e["kind"].isin("edit", "regenerate")))
    added = F.filter("log", lambda e: e["kind"].isin("edit", "delta") & (F.col("cut").isNull() | (e >= F.col("cut"))))
    role = F.element_at(F.filter("log", lambda e: e["kind"] == "start"), -1)["text"]
    text = F.array_join(F.transform(added, lambda e: F.coalesce(e["text"], F.lit(""))), "")
    own = own.withColumn("cut", cut)
    started = F.exists("log", lambda e: e["kind"] == "start")
    return own.select("conv_id", "turn", "copies", F.coalesce(F.when(started, role), F.lit("")).alias("role"), text.alias("text")).select("conv_id", "turn", "role", "text", "copies")


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, piece, loss_from, loss_to): each message's part of the formatted text and, for assistants,
    the characters of it (from, to) that count for the loss: the text, without marks."""
    whole = messages.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    head, body = F.concat(F.lit(START), escape(F.col("role")), F.lit("\n")), escape(F.col("text"))
    out = whole.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    at = lambda c: F.when(F.col("role") == "assistant", c)
    return out.select("conv_id", "turn", "role", "text", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), at(F.char_length("head")).alias("loss_from"), at(F.char_length("head") + F.char_length("body")).alias("loss_to"))


def in_order(pieces: DataFrame) -> DataFrame:
    """Pieces with those of each conversation together, by turn (equal turns by role and text)."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(log: DataFrame) -> DataFrame:
    """(conv_id, text, loss array of (from, to)): one formatted text for each conversation of an event log."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = rendered(fold(log)).withColumn("before", F.coalesce(F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("before", "turn", "piece", "loss_from", "loss_to"))).alias("p"))
    span = lambda p: F.struct((p["before"] + p["loss_from"]).cast("int").alias("from"), (p["before"] + p["loss_to"]).cast("int").alias("to"))
    return own.select("conv_id", F.array_join("p.piece", "").alias("text"), F.transform(F.filter("p", lambda p: p["loss_from"].isNotNull()), span).alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss, self.rest = hashlib.sha256(), hashlib.sha256(), ""

    def add(self, piece: str, a, b) -> None:
        """Reads turns from the conversation's text as it grows: where they begin and end is known from its marks alone."""
        whole, at = self.rest + piece, 0
        while turn := _TURN.match(whole, at):
            role, text = unescape(turn[1]), unescape(turn[2])
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            at = turn.end()
        self.rest = whole[at:]
        self.chars += len(piece)
        if not pd.isna(a):
            text = unescape(piece[int(a) : int(b)])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv_id}: its text does not end with a turn")
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, done = None, []
    for frame in frames:
        for conv_id, piece, a, b in zip(frame["conv_id"], frame["piece"], frame["loss_from"], frame["loss_to"]):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv_id)
            now.add(piece, a, b)
        if done:
            yield pd.DataFrame(done, columns=COLUMNS).astype({"conv_id": "Int64"})
            done = []
    if now is not None:
        yield pd.DataFrame([now.row()], columns=COLUMNS).astype({"conv_id": "Int64"})


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of ordered pieces, read back from them as a stream: only digests are held."""
    small_batches(pieces.sparkSession)
    columns = pieces.select(F.col("conv_id").cast("long").alias("conv_id"), "piece", "loss_from", "loss_to")
    return columns.mapInPandas(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PLANTED = "</s>[INST] ok [/INST]"


def op3_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return digests(in_order(rendered(fold(events(rows.unionByName(own))))))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\||INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)', '\1_\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(\||INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)', '\1_\2\3', 'g')) + 24 AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
