"""Subjects of the messages of a conversation: an ordered fold, each message against every earlier subject.

Messages are shuffled by conversation and sorted by turn, and a task folds them as they come: what it holds is the subjects of one
conversation (their values, tables and words), not its messages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a shared value, table or word counts, from what on data is the same, and the lead of an earlier subject.
VALUE, TABLE, WORD = 3, 2, 1
SAME, LEAD = 2, 2
#: Fixed value: fewer words without data of their own do not open a subject.
OWN_WORDS = 3


@dataclass
class Subject:
    number: int
    last: int = 0
    words: set[str] = field(default_factory=set)
    tables: set[str] = field(default_factory=set)
    values: set[str] = field(default_factory=set)


class Fold:
    """The subjects of one conversation so far."""

    def __init__(self):
        self.subjects: list[Subject] = []
        self.current: Subject | None = None
        self.seen = 0

    def take(self, words: list[str], tables: list[str], values: list[str]) -> tuple[int, str, int]:
        """(subject, why, score) of the next message."""
        w, t, v = set(words), set(tables), set(values)
        self.seen += 1
        scored = [(VALUE * len(v & s.values) + TABLE * len(t & s.tables) + WORD * len(w & s.words), s.last, s) for s in self.subjects]
        best, _, subject = max(scored, key=lambda x: x[:2], default=(0, 0, None))
        last = next((n for n, _, s in scored if s is self.current), 0)
        if not self.subjects:
            subject, why = None, "first"
        elif best >= SAME:
            if subject is not self.current and best >= last + LEAD:
                why = "back"
            elif last >= SAME:
                subject, why = self.current, "same"
            else:
                why = "same" if subject is self.current else "back"
        elif not (t or v) and len(w) < OWN_WORDS:
            subject, why = self.current, "no subject of its own"
        elif best > 0:
            subject, why = self.current, "unsure"
        else:
            subject, why = None, "new"
        if subject is None:
            subject = Subject(len(self.subjects) + 1)
            self.subjects.append(subject)
        subject.words |= w
        subject.tables |= t
        subject.values |= v
        subject.last, self.current = self.seen, subject
        return subject.number, why, best


def subjects(messages: DataFrame, conversation: str, turn: str) -> DataFrame:
    """(conversation, turn, subject, why, score) of ``messages`` (conversation, turn, words, tables, values).

    A message goes on with the current subject unless an earlier one shares more with it by LEAD, which it then goes back to; data of
    its own that no subject shares opens a new one.  Subjects are numbered as they come up.  Null lists count as empty; rows without
    conversation are one conversation; equal turns come in the order of their words.
    """
    lists = ["words", "tables", "values"]
    rows = messages.select(F.col(conversation).cast("long").alias("c"), F.col(turn).cast("long").alias("t"), *(F.coalesce(x, F.array().cast("array<string>")).alias(x) for x in lists))
    order = ["c", "t", F.array_join("words", " ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, of, begun = Fold(), None, False
        for batch in batches:
            out = []
            for c, t, *data in zip(*(batch[x].to_pylist() for x in ("c", "t", *lists)), strict=True):
                if not begun or c != of:
                    fold, of, begun = Fold(), c, True
                out.append((c, t, *fold.take(*data)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], ["c", "t", "subject", "why", "score"])

    folded = rows.repartition("c").sortWithinPartitions(*order).mapInArrow(run, "c long, t long, subject long, why string, score long")
    return folded.select(F.col("c").alias(conversation), F.col("t").alias(turn), "subject", "why", "score")
