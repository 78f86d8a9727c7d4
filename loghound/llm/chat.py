"""Chat formatting by incremental black-box rendering (operator 6)."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghound.llm.common import empty_if_null, prepare, table

#: Turns that are rendered as one prefix series if the template declares its look-back.
SEGMENT_TURNS = 16
#: Private characters; the first one that a rendered prefix does not hold stands for its last text.
PROBES = (range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE))
TRAINED_ROLE = "assistant"

Template = Callable[[list[tuple[str, str]]], str]


def escape(text: str) -> str:
    """Double each backslash and part each ``<|``; afterwards no control string is left in a text."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def turn_template(turns: list[tuple[str, str]]) -> str:
    """``<|turn|>role<|says|>text<|end|>`` and a line feed for each turn."""
    return "".join(f"<|turn|>{escape(role)}<|says|>{escape(text)}<|end|>\n" for role, text in turns)


#: The earlier turns that a turn's form may depend on; a template without this is rendered from the first turn on.
turn_template.look_back = 0


_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a text made by :func:`turn_template`."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def probe_for(rendered: str) -> str:
    """A character that ``rendered`` does not hold."""
    return next(chr(c) for r in PROBES for c in r if chr(c) not in rendered)


class PrefixSeries:
    """Renders each prefix of a conversation and locates every turn by comparing consecutive outputs.

    The template is a black box.  The output of a prefix without the end that
    all its outputs share (for example a closing mark) must start the next
    output; where it does not, the turn is marked ``rewrites`` and the piece
    is counted from where the two outputs part.  The text inside a piece is
    found by rendering the prefix with a private character, one that it does
    not hold, as the last text.

    Only the turns and the last output are held.  With ``look_back``, after
    each ``segment_turns`` turns only that many earlier turns, and one at
    least, are kept, so that no later turn is rendered as a first one.
    """

    def __init__(self, template: Template, look_back: int | None = None, segment_turns: int = SEGMENT_TURNS):
        self.template, self.turns = template, []
        self.empty = self.before = template([])
        self.keep = None if look_back is None else max(1, look_back)
        self.limit = segment_turns

    def add(self, role: str, text: str) -> dict:
        """piece, text_start, text_end (offsets in the piece, -1 if the template does not show the text), rewrites."""
        if self.keep is not None and len(self.turns) >= max(self.limit, self.keep + 1):
            self.turns = self.turns[-self.keep:]
            self.before = self.template(list(self.turns))
        self.turns.append((role, text))
        before, empty = self.before, self.empty
        now = self.template(list(self.turns))
        tail = len(os.path.commonprefix([before[::-1], now[::-1], empty[::-1]])) if empty else 0
        kept = before[:len(before) - tail]
        rewrites = not now.startswith(kept)
        start = len(os.path.commonprefix([kept, now])) if rewrites else len(kept)
        piece = now[start:len(now) - tail]
        mark = probe_for(now)
        probe = self.template(self.turns[:-1] + [(role, mark)])[start:]
        at = probe.find(mark)
        end = len(now) - start - (len(probe) - at - 1) if at >= 0 else -1
        self.before = now
        return {"piece": piece, "text_start": at if at >= 0 else -1, "text_end": end, "rewrites": rewrites}


def render_series(turns: list[tuple[str, str]], template: Template) -> list[dict]:
    """For each turn what :meth:`PrefixSeries.add` returns."""
    series = PrefixSeries(template)
    return [series.add(role, text) for role, text in turns]


def format_turns(conversations: DataFrame, template: Template = turn_template,
                 segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """Every turn of every conversation as it stands in the formatted text.

    Needs conv_id, turn, role, text.  Rows are dealt by conv_id and sorted; a
    task streams over its conversations and renders the successive prefixes of
    each from its first turn on: the time grows with the square of its turns.
    Only for a template that declares, as its attribute ``look_back``, how many
    earlier turns the form of a turn depends on (besides whether there is one),
    it goes on from those after each ``segment_turns`` turns, and a
    conversation of any length takes bounded memory.

    Cases: a null text or role is empty; turns tie by role, then text; a null
    turn comes first; rows without conv_id are one conversation; repeated rows
    are turns of their own; an empty table gives no rows.

    Returns conv_id, pos, role, text (as read back), piece, text_start,
    text_end, rewrites, in order within each partition.
    """
    look_back = getattr(template, "look_back", None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, conv, pos, rows = None, None, 0, []
        columns = ["conv_id", "pos", "piece", "text_start", "text_end", "rewrites"]
        for pdf in batches:
            for c, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                if c != conv:
                    series, conv, pos = PrefixSeries(template, look_back, segment_turns), c, 0
                r = series.add(role, text)
                rows.append((conv, pos, r["piece"], r["text_start"], r["text_end"], r["rewrites"]))
                pos += 1
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"conv_id": "object"})
                rows.clear()

    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        empty_if_null(F.col("role")).alias("role"), empty_if_null(F.col("text")).alias("text"))
    return (rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInPandas(run, "conv_id string, pos long, piece string, text_start long, text_end long, rewrites boolean"))


def digest(formatted: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per conversation, read back from the formatted pieces, streamed in order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, rows = None, None, []

        def close():
            if state:
                rows.append((conv or None, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for pdf in batches:
            for c, piece, a, b, bad in zip(pdf["conv_id"], pdf["piece"], pdf["text_start"], pdf["text_end"], pdf["rewrites"]):
                if c != conv or state is None:
                    close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                (role, text), = read_back(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == trained_role:
                    masked = unescape(piece[a:b])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(piece)
                state[5] += bool(bad)
            if rows:
                yield pd.DataFrame(rows, columns=columns)
                rows.clear()
        close()
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"]
    return formatted.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, "
                                      "loss_sha256 string, formatted_chars long, n_rewrites long")


def op6_incremental_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    odd = "\\### Assistant: </turn> ok"
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digest(format_turns(conv.unionByName(extra))).withColumn("conv_id", F.col("conv_id").cast("long"))
