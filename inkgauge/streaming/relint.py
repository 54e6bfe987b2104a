"""Findings of open documents, kept up to date while they change: a stream of events (uri, event, seq, path, source,
kind, code_lang), where event is open, change or close. The newest text of each document is its state; every change
emits the document's findings anew, closing it emits none."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.code_rules import code_findings
from ..session import ship

OUT = "uri string, seq long, rule_id string, line long"
STATE = "seq long, source string"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, source = state.get if state.exists else (-1, None)
    newest = None
    for rows in batches:
        rows = rows[rows["seq"] > seq]
        if len(rows):
            last = rows.loc[rows["seq"].idxmax()]
            if newest is None or last["seq"] > newest["seq"]:
                newest = last
    if newest is None:
        return
    seq = int(newest["seq"])
    if newest["event"] == "close":
        state.remove()
        yield pd.DataFrame({"uri": [key[0]], "seq": [seq], "rule_id": [None], "line": [None]})
        return
    state.update((seq, newest["source"]))
    found = code_findings(newest["path"] or "", newest["source"] or "", newest["kind"] or "docs", newest["code_lang"])
    yield pd.DataFrame({"uri": key[0], "seq": seq, "rule_id": [r for r, _ in found] or [None], "line": [n for _, n in found] or [None]})


def relint(events: DataFrame) -> DataFrame:
    """uri, seq, rule_id, line: the findings after each change; a row without rule says that there are none."""
    ship(events.sparkSession)
    return events.groupBy("uri").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def current(updates: DataFrame) -> DataFrame:
    """The findings that hold: those of the newest update of each document."""
    last = updates.groupBy("uri").agg(F.max("seq").alias("seq"))
    return updates.join(last, ["uri", "seq"], "left_semi").where(F.col("rule_id").isNotNull())
