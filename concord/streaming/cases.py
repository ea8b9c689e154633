"""Open cases as keyed state: messages and their documents may arrive in any order.

Messages and documents are two streams, joined by case in a stateful operator. The state of a case is its latest message
and the latest version of each document. An arrival gives the whole case out again, so a micro-batch checks exactly the
cases it touches and reads no table of messages or documents: the work of a batch follows its own size, not the history.

A case whose last arrival lies further behind the watermark than `keep` is closed and its state is dropped; a document
that comes still later waits, as one that comes before its message does, until a message of the case arrives. State is
kept by Spark in the checkpoint folder and restored from there when an executor is lost.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from concord.plans.checks import Settings
from concord.streaming.ingest import check_batch

MESSAGE = ["sender", "subject", "body"]
DOCUMENT = ["doc_id", "attachment_no", "name", "text", "error"]
_ARRIVAL = "case_id string, at timestamp, sender string, subject string, body string, doc_id string, attachment_no int, name string, text string, error string"
_OPEN = "case_id string, case string"
_CASE = "at double, sender string, subject string, body string, docs array<struct<at:double,doc_id:string,attachment_no:int,name:string,text:string,error:string>>"


def arrivals(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """Both streams in one shape: a message has no doc_id, a document no message columns. `at` is the time of arrival."""
    fields = {f.split()[0]: f.split()[1] for f in _ARRIVAL.split(", ")}

    def shaped(df: DataFrame, own: list[str]) -> DataFrame:
        given = {"case_id", "at", *(c for c in own if c in df.columns)}
        return df.select(*[(F.col(c) if c in given else F.lit(None)).cast(kind).alias(c) for c, kind in fields.items()])

    return shaped(messages, MESSAGE).unionByName(shaped(documents, DOCUMENT).where(F.col("doc_id").isNotNull()))


def _merge(case: dict, rows: pd.DataFrame) -> dict:
    """The case after some arrivals: of each part the latest version, of equal times the one read last."""
    for r in rows.sort_values("at", kind="stable").itertuples(index=False):
        at = r.at.timestamp()
        if r.doc_id is None:
            if at >= case.get("at", float("-inf")):
                case |= {"at": at, **{c: getattr(r, c) for c in MESSAGE}}
        elif at >= case["docs"].get(r.doc_id, {"at": float("-inf")})["at"]:
            number = getattr(r, "attachment_no")
            case["docs"][r.doc_id] = {"at": at, **{c: getattr(r, c) for c in DOCUMENT}, "attachment_no": None if pd.isna(number) else int(number)}
    return case


def _keep_open(keep_ms: int) -> Callable:
    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        case = json.loads(state.get[0]) if state.exists else {"docs": {}}
        latest = 0.0
        for rows in parts:
            rows = rows.astype(object).where(rows.notna(), None)
            case = _merge(case, rows)
            latest = max(latest, *(at.timestamp() for at in rows["at"]))
        case["seen"] = max(case.get("seen", 0.0), latest)
        state.update((json.dumps(case),))
        state.setTimeoutTimestamp(max(int(case["seen"] * 1000) + keep_ms, state.getCurrentWatermarkMs() + 1))
        if "at" in case:  # without a message there is nothing to check yet
            yield pd.DataFrame({"case_id": [key[0]], "case": [json.dumps(case | {"docs": list(case["docs"].values())})]})

    return update


def open_cases(messages: DataFrame, documents: DataFrame, *, keep: str = "90 days", late: str = "7 days") -> DataFrame:
    """The whole case (case_id, case as JSON) for every case that an arrival touched; rows without a time are left out."""
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = arrivals(messages, documents).where(F.col("at").isNotNull() & F.col("case_id").isNotNull()).withWatermark("at", late)
    return rows.groupBy("case_id").applyInPandasWithState(_keep_open(keep_ms), _OPEN, "case string", "update", GroupStateTimeout.EventTimeTimeout)


def split_cases(opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, documents) of open cases, as the check reads them."""
    rows = opened.select("case_id", F.from_json("case", _CASE).alias("c"))
    docs = rows.select("case_id", F.explode("c.docs").alias("d")).select("case_id", *[F.col(f"d.{c}").alias(c) for c in DOCUMENT])
    return rows.select("case_id", *[F.col(f"c.{c}").alias(c) for c in MESSAGE]), docs


def start_cases(
    messages: DataFrame, documents: DataFrame, board: str, checkpoint: str, *, keep: str = "90 days", late: str = "7 days",
    knowledge: DataFrame | None = None, overrides: DataFrame | Callable[[], DataFrame] | None = None, settings: Settings = Settings(),
) -> StreamingQuery:
    """Check every case again that a message or a document touches, and append the result to the board.

    Reviewers' overrides keep a case settled while its answer stays the same and re-open it when the answer changes.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        opened = batch.persist()  # both parts of the batch read it
        try:
            if opened.isEmpty():  # a batch that only moves the watermark
                return
            mail, docs = split_cases(opened)
            check_batch(mail, docs, board, batch_id, knowledge=knowledge, overrides=overrides, settings=settings)
        finally:
            opened.unpersist()

    stream = open_cases(messages, documents, keep=keep, late=late)
    return stream.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
