"""The request path as a stream: documents land, their fields come late or are corrected, and every version is judged.

A request tells something of one document, named by the hash of its image: the landing with what was extracted, a field that
was recognised later, or a reviewer's correction. State is kept by hash, so a copy is known however late it comes, a correction
finds the document that it corrects, and no table is joined. What may come in any order has one outcome: of a field's values
a correction counts before a late field, that before the extraction, and the latest of equals.

Timers bound the state. Fields whose document does not land within ``patience`` are told as orphans and forgotten; a document that
nothing was told of for ``retention`` is forgotten, so that a copy after that is new. The state says what a document holds; what
that means (triage, checks, audit) is worked out for the changed documents of a batch by the same column expressions as
for whole tables. Everything of a batch is written under its number, so one that is run again overwrites its own rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import review
from ..operators.mutate import audit_event
from ..schemas import CORE_FIELDS
from .ingest import added, signals_by, statistics_of, totals

#: What a request may be; of a field's values the one of the later kind counts.
KINDS = ("extraction", "field", "correction")
#: One row for each field that a request tells of.
REQUEST = "image_hash string, kind string, request_id long, doc_id long, ts timestamp, amount double, field_name string, value string, confidence double"
CHANGE = "image_hash string, event string, doc_id long, landed_at timestamp, amount double, version int, copies int, before string, after string"
FIELDS = "map<string,struct<value:string,confidence:double,method:string>>"
METHODS = {"extraction": "ocr", "field": "recognizer", "correction": "manual_correction"}


class Documents(StatefulProcessor):
    """The state of one document: what landed, and its fields with the rank of what they were last told by."""

    def __init__(self, patience_ms: int, retention_ms: int):
        self.patience, self.retention = patience_ms, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one text, so a document is one look-up and one write a batch
        self.state = handle.getValueState("document", "held string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else {"doc": None, "version": 0, "fields": {}, "timer": None, "last": 0}
        before, copies, changed = shown(held["fields"]), set(), False
        told = sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: (r.ts, r.request_id))
        for r in told:
            at, rank = int(r.ts.value // 1000), KINDS.index(r.kind)
            held["last"] = max(held["last"], at // 1000)
            if rank == 0:
                if held["doc"] is None:
                    held["doc"] = [int(r.request_id), int(r.doc_id), at, None if pd.isna(r.amount) else float(r.amount)]
                elif held["doc"][0] != r.request_id:
                    copies.add(int(r.request_id))
                    continue
            old, new = held["fields"].get(r.field_name), [rank, at, int(r.request_id), r.value, float(r.confidence)]
            if old is None or new[:3] > old[:3]:
                held["fields"][r.field_name], changed = new, True
        self.wait(held, timerValues)
        if held["doc"] and (changed or copies):
            held["version"] += changed
            event = "copy" if not changed else "landed" if held["version"] == 1 else "changed"
            yield self.row(key, held, event, len(copies), None if held["version"] == 1 else before)
        self.state.update((json.dumps(held),))

    def wait(self, held: dict, timerValues: Any) -> None:
        """One timer a document: after the last request, by patience before it lands and by retention then."""
        if held["timer"] is not None:
            self.handle.deleteTimer(held["timer"])
        held["timer"] = max(held["last"] + (self.retention if held["doc"] else self.patience), timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(held["timer"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            held = json.loads(self.state.get()[0])
            self.state.clear()
            if held["doc"] is None:
                yield self.row(key, held, "orphan", 0, None)

    def row(self, key: Any, held: dict, event: str, copies: int, before: dict | None) -> pd.DataFrame:
        _, doc, at, amount = held["doc"] or [None] * 4
        one = {"image_hash": key[0], "event": event, "doc_id": doc, "landed_at": None if at is None else pd.Timestamp(at, unit="us"), "amount": amount, "version": held["version"], "copies": copies, "before": None if before is None else json.dumps(before), "after": json.dumps(shown(held["fields"]))}
        return pd.DataFrame([one]).astype({"doc_id": "Int64", "version": "int32", "copies": "int32", "landed_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def shown(fields: dict[str, list]) -> dict[str, dict]:
    return {name: {"value": v, "confidence": 1.0 if rank == 2 else c, "method": METHODS[KINDS[rank]]} for name, (rank, _, _, v, c) in sorted(fields.items())}


def changes(requests: DataFrame, patience: str = "2 days", retention: str = "30 days", lateness: str = "1 day") -> DataFrame:
    """A row for each document that a batch changed, and for fields whose document never came. ``requests`` as REQUEST."""
    milliseconds = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    rows = requests.where(F.col("image_hash").isNotNull() & F.col("field_name").isNotNull() & F.col("kind").isin(*KINDS)).withWatermark("ts", lateness)
    processor = Documents(milliseconds(patience), milliseconds(retention))
    return rows.groupBy("image_hash").transformWithStateInPandas(processor, CHANGE, "Append", "EventTime")


def wide(rows: DataFrame, fields: str) -> DataFrame:
    """Changed documents as triage wants them, from one of their maps of fields."""
    held = F.from_json(fields, FIELDS)
    rows = rows.withColumn("__f", held)
    value = lambda f: F.col("__f")[f]["value"]
    confidence = lambda f: F.col("__f")[f]["confidence"]
    columns = {f: value(f) for f in CORE_FIELDS} | {f"{f}_confidence": confidence(f) for f in CORE_FIELDS}
    mean = F.aggregate(F.map_values("__f"), F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size("__f")
    signed = {"signature_present": F.coalesce(value("signature") != "", F.lit(False)), "signature_confidence": confidence("signature")}
    return rows.withColumns({**columns, **signed, "amt_in_words": value("amt_in_words"), "bank_name": value("bank_name"), "overall_confidence": F.coalesce(F.round(mean, 4), F.lit(0.0))})


def judged(changed: DataFrame, reference: Column | None) -> DataFrame:
    """Status, priority and reasons of changed documents, as they were before (``earlier``) and as they are: one plan for both."""
    sides = F.array(F.struct(F.lit(True).alias("earlier"), F.col("before").alias("f")), F.struct(F.lit(False).alias("earlier"), F.col("after").alias("f")))
    rows = changed.select("doc_id", F.inline(sides)).where("f is not null")
    # triage hands the id on as it is
    made = review.triage(wide(rows.withColumn("doc_id", F.struct("doc_id", "earlier")), "f"), reference)
    return made.select("doc_id.*", *[c for c in made.columns if c != "doc_id"])


def start(requests: DataFrame, folder: str, checkpoint: str, reference: Column | None = None, history: DataFrame | None = None, **waits: str) -> StreamingQuery:
    """Writes, under the number of each batch: ``changes`` as the state told them, ``judged``, ``documents`` (a version a row), ``fields``,
    ``checks``, ``audit``, ``totals`` and ``signals``. A reader of the current state takes each document's last version."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def put(rows: DataFrame, name: str) -> DataFrame:
            path = f"{folder}/{name}/batch={number}"
            rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        told = put(batch, "changes")
        if number and not told.limit(1).count():  # time went on and nothing else
            put(spark.read.parquet(f"{folder}/totals/batch={number - 1}"), "totals")
            return
        changed = told.where(F.col("event").isin("landed", "changed"))
        both = put(judged(changed, reference), "judged")
        version = changed.select("doc_id", "image_hash", "version", "landed_at", "amount")
        documents = put(both.where("not earlier").drop("earlier").join(version, "doc_id"), "documents")
        field = changed.select("doc_id", "version", F.explode(F.from_json("after", FIELDS)).alias("field_name", "f"))
        put(field.select("doc_id", "version", "field_name", "f.value", "f.confidence", "f.method"), "fields")
        put(review.validation_rows(documents).join(version.select("doc_id", "version"), "doc_id"), "checks")
        earlier = both.where("earlier").select("doc_id", F.col("status").alias("old_status"))
        moved = documents.join(earlier, "doc_id", "left").where("old_status is null or old_status <> status")
        event = audit_event(moved, "STATUS_CHANGE", "cheque", "doc_id", {"old_status": F.coalesce("old_status", F.lit("LANDED")), "new_status": F.col("status")}, F.col("landed_at"))
        copied = told.where("copies > 0")
        put(event.unionByName(audit_event(copied, "COPY_DROPPED", "cheque", "doc_id", {"copies": F.col("copies")}, F.col("landed_at"))), "audit")

        landed = documents.where("version = 1")
        own = totals(landed, "amount")
        before = spark.read.schema(own.schema).parquet(f"{folder}/totals/batch={number - 1}") if number else totals(landed.limit(0) if history is None else history, "amount")
        put(added(own, before), "totals")
        put(signals_by(landed.select("doc_id", "amount"), statistics_of(before), "amount"), "signals")

    return changes(requests, **waits).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(documents: DataFrame) -> DataFrame:
    """Each document's last version."""
    rest = [c for c in documents.columns if c != "doc_id"]
    return documents.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "version").alias("last")).select("doc_id", "last.*")
