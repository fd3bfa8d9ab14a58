"""Ingest of message events in order: what each may change, given what the ones before it have changed."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.scope import owner_of

# The status that a kind of event gives a row, and how far statuses are.
CANONICAL = {"declined": "skip", "withdrawn": "discarded", "applied": "applied", "responded": "responded", "interview": "interview", "offer": "offer", "rejected": "rejected", "hired": "hired"}
PHASE = {"evaluated": 0, "applied": 1, "responded": 2, "interview": 3, "offer": 4, "rejected": 5, "hired": 5, "discarded": 5, "skip": 0}
#: Statuses that are applications.
APPLICATION = ("applied", "responded", "interview", "offer", "rejected", "hired")
#: Kinds that only weigh a proposal.
UNDECIDED = ("pending", "proposal_unanswered")

_STATE = "status string, dates map<string,date>, decision string, decided_at timestamp, withdrawn boolean, noted boolean"


class ApplicationState:
    """What is known of one key while its events pass in order."""

    def __init__(self, row: dict | None) -> None:
        row = row or {}
        self.status, self.dates = row.get("status"), dict(row.get("dates") or {})
        self.decision, self.decided_at = row.get("decision"), row.get("decided_at")
        self.withdrawn, self.noted = bool(row.get("withdrawn")), bool(row.get("noted"))

    def is_application(self) -> bool:
        return self.status in APPLICATION or (self.status == "discarded" and (self.decision == "applied" or self.noted))

    def judge(self, kind: str, at: datetime.datetime, review: bool) -> tuple[str, bool]:
        """(outcome, needs_review) of an event that is meant to be applied."""
        canonical, applied = CANONICAL.get(kind), self.is_application()
        day = self.dates.get(self.status)
        if self.decided_at is not None and at < self.decided_at:
            return "older_than_current_decision", review
        if day is not None and at.date() < day:
            return "older_than_canonical_transition", review
        if self.status == "skip" and kind == "proposal_unanswered":
            return "prior_exclusion_preserved", review
        if review and applied:
            return "review_preserves_application", review
        if applied and kind in (*UNDECIDED, "declined"):
            return "application_preserved", kind == "declined"
        if self.status and canonical and kind != "withdrawn" and PHASE.get(self.status, 0) > PHASE[canonical]:
            return "later_application_stage_preserved", review
        if self.withdrawn and kind in (*UNDECIDED, "declined"):
            return "withdrawal_preserved", review
        return "applied", review

    def apply(self, kind: str, at: datetime.datetime, review: bool) -> None:
        """An event under review only leaves a pending decision; others set the status, of a new row if there is none."""
        self.status = self.status if review else CANONICAL.get(kind, self.status)
        self.decision = "pending" if review or kind in UNDECIDED else "excluded" if kind in ("declined", "withdrawn") else "applied"
        self.decided_at, self.withdrawn = at, kind == "withdrawn" and not review


def ingest_in_order(events: DataFrame, ledger: DataFrame, state: DataFrame) -> DataFrame:
    """Q6 in full: (event_id, key, kind, event_at, outcome, needs_review, status, decision) for every event that is not done.

    events: event_id, key, kind, event_at (UTC), apply, needs_review; the last two may be missing or null (true, false).
    ledger: event_id, and outcome if there is one; events of outcome prepared or error are tried again, others are done.
    state: key (unique), status of its tracker row (null: no row), dates (when its row reached which status), decision
    (applied, pending, excluded), decided_at (null if none, or made by a note), withdrawn, noted (its notes tell of an
    application); what is missing is null.

    Outcomes: history_only (not meant to be applied), older_than_current_decision, older_than_canonical_transition,
    prior_exclusion_preserved, review_preserves_application, application_preserved, later_application_stage_preserved,
    withdrawal_preserved, applied. Events of a key are judged in order of event_at and event_id, each against what the
    ones before left; status and decision are those after it. Keys and what is known of them are sorted within hash
    partitions and pass one event at a time, so a task keeps one state, however many events a key has. Events without
    a key or time are judged alone against nothing. Of events that repeat an id one counts.
    """
    own = owner_of(events, ledger, state)
    by_id, by = [*own, "event_id"], [*own, "key"]
    open_again = F.col("outcome").isin("prepared", "error") if "outcome" in ledger.columns else F.lit(False)
    done = ledger.where(~F.coalesce(open_again, F.lit(False))).select(*by_id).distinct()
    flag = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in events.columns else F.lit(other)
    fresh = events.select(*by_id, "key", "kind", F.col("event_at").cast("timestamp").alias("event_at"), flag("apply", True).alias("apply"), flag("needs_review", False).alias("needs_review"))
    fresh = fresh.join(done, by_id, "left_anti").dropDuplicates(by_id)
    types = [x.rsplit(" ", 1) for x in _STATE.split(", ")]
    known = [(F.col(c) if c in state.columns else F.lit(None)).cast(t).alias(c) for c, t in types]
    event_columns = ["event_id", "kind", "event_at", "needs_review"]
    kinds = {f.name: f.dataType.simpleString() for f in fresh.schema}
    nothing = [F.lit(None).cast(t).alias(c) for c, t in types]
    meant = fresh.where("apply")
    rows = state.select(*by, F.lit(False).alias("_event"), *[F.lit(None).cast(kinds[c]).alias(c) for c in event_columns], *known).union(meant.select(*by, F.lit(True), *event_columns, *nothing))
    rows = rows.repartition(*by).sortWithinPartitions(*by, "_event", "event_at", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, ApplicationState(None)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mine = tuple(r[c] for c in by)
                if key != mine or None in mine:
                    key, now = mine, ApplicationState(None)
                if not r["_event"]:
                    now = ApplicationState({**r, "dates": dict(r["dates"] or ())})
                    continue
                alone = r["event_at"] is None
                held = ApplicationState(None) if alone else now
                outcome, review = held.judge(r["kind"], r["event_at"], r["needs_review"])
                if outcome == "applied" and not alone:
                    now.apply(r["kind"], r["event_at"], review)
                out.append({**{c: r[c] for c in (*by, "event_id", "kind", "event_at")}, "outcome": outcome, "needs_review": review, "status": held.status, "decision": held.decision})
            kept = [batch.schema.field(c) for c in (*by, "event_id", "kind", "event_at")]
            yield pa.RecordBatch.from_pylist(out, pa.schema([*kept, ("outcome", pa.string()), ("needs_review", pa.bool_()), ("status", pa.string()), ("decision", pa.string())]))

    first = [*by, "event_id", "kind", "event_at"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in first) + ", outcome string, needs_review boolean, status string, decision string"
    null = F.lit(None).cast("string")
    logged = fresh.where("NOT apply").select(*first, F.lit("history_only").alias("outcome"), "needs_review", null.alias("status"), null.alias("decision"))
    return rows.mapInArrow(run, schema).union(logged).select(*own, "event_id", "key", "kind", "event_at", "outcome", "needs_review", "status", "decision")
