"""Threads as applications and ingest in order, against plain loops."""

import datetime
import random
import re

from pyspark.sql import functions as F

from brightloom.operators import ingest, threads
from brightloom.plans.application_queries import _SAYINGS
from brightloom.streaming import events

SUBJECTS = (None, "", "포지션 제안", "Re: 서류 전형 결과 안내", "Job Alert: 10 new", "FW: 지원 건", "application decision", "hello")
TEXTS = [s[0] for s in _SAYINGS] + [
    "지원하신 포지션의 결과를 알려드립니다. 함께 하기 어렵습니다", "We will not be moving forward with your application", "Thank you for applying to the position",
    "I will consider it", "please submit my resume", "I decline the offer", "interview invitation", None, "", "보류하겠습니다", "position proposal\nunfortunately other candidates",
]


def says(pattern, text):
    return bool(re.search(pattern, text, re.I | re.S))


def plain_thread(messages):
    """[(message_id, kind, review)] for (id, at, sent, forwarded, subject, body) of one thread."""
    T = threads
    ms = sorted(((at, i, sent, fwd, subject or "", body or "") for i, at, sent, fwd, subject, body in messages if not says(T.NEWSLETTER_SUBJECT, subject or "")))
    if not ms:
        return []
    both = [f"{m[4]}\n{m[5]}" for m in ms]
    recruitment = any(says(f"{T.RECRUITMENT}|{T.PROPOSAL}|{T.RECEIPT}", x) for x in both)
    tells = any(says(f"{T.RECEIPT}|{T.INTERVIEW}|{T.OFFER}|{T.REJECT}", x) for x in both)
    relevant = says(T.PROPOSAL, ms[0][4]) or any(says(T.PROPOSAL, m[5]) or (m[2] and says(T.APPLY, m[5])) or (m[3] and re.search(T.FORWARDED_SUBJECT, m[4])) for m in ms) or (recruitment and tells)
    if not relevant:
        return []
    out, current, application = [], None, False
    for _, i, sent, fwd, subject, body in ms:
        status = "\n".join(x for x in body.split("\n") if not re.search(T.PROCESS_LINE, x))
        if not sent and says(T.RESULT_SUBJECT, subject):
            status = f"{subject}\n{status}"
        proposal = not sent and current is None and says(T.PROPOSAL, f"{subject}\n{body}")
        personal = says(T.PERSONAL_RESULT, status) or (recruitment and says(T.REJECT, status) and (says(T.RESULT_SUBJECT, subject) or not says(T.PROPOSAL, body)))
        kind = None
        if proposal and not personal:
            kind = "proposal_unanswered"
        else:
            for name, pattern in T.SENT_RULES if sent else T.RECEIVED_RULES:
                if name == "applied" and sent and says(T.CONDITIONAL_APPLY, status):
                    continue
                if says(pattern, status):
                    kind = name
                    break
        if not kind and proposal:
            kind = "proposal_unanswered"
        if not kind and sent and current == "proposal_unanswered":
            kind = "pending"
        if not kind and not sent and current in ("applied", "responded"):
            kind = "responded"
        if not kind and fwd:
            kind = "pending"
        if not kind:
            continue
        unsure = kind == "applied" and not sent and says(T.UNCERTAIN_SUBJECT, subject) and not says(T.CERTAIN_RECEIPT, status)
        if kind == "declined" and application:
            kind = "withdrawn"
        if kind == "pending" and application:
            continue
        application = application or kind in ("applied", "responded", "interview", "offer", "hired", "rejected")
        current = kind
        out.append((i, kind, bool(fwd or unsure)))
    return out


def mailbox(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(n // 6), i, rng.randrange(50), rng.random() < 0.4, rng.random() < 0.1, rng.choice(SUBJECTS), rng.choice(TEXTS)) for i in range(n)]


SCHEMA = "thread_id long, message_id long, at long, sent boolean, forwarded boolean, subject string, body string"


def test_threads_equal_a_plain_loop(spark):
    rows = mailbox(1, 600)
    df = spark.createDataFrame([("me", *r) for r in rows] + [("you", *r) for r in rows[:50]], f"owner_id string, {SCHEMA}").repartition(7)
    got = sorted((r.owner_id, r.thread_id, r.message_id, r.kind, r.needs_review, r.apply) for r in threads.thread_states(df).collect())
    want = []
    for owner, part in (("me", rows), ("you", rows[:50])):
        for t in {r[0] for r in part}:
            events_of = plain_thread([r[1:] for r in part if r[0] == t])
            want += [(owner, t, i, kind, review, n == len(events_of) - 1) for n, (i, kind, review) in enumerate(events_of)]
    assert got == sorted(want)
    assert {"proposal_unanswered", "pending", "declined", "withdrawn", "applied", "responded", "interview", "offer", "hired", "rejected"} == {x[3] for x in want}
    assert threads.thread_states(df.limit(0)).count() == 0


def test_stream_of_threads_agrees_with_batch_whatever_the_arrival(spark, tmp_path):
    rows = mailbox(2, 120)
    random.Random(3).shuffle(rows)
    gone = rows[5]
    schema = f"{SCHEMA}, removed boolean"
    src, out, cursor = (str(tmp_path / x) for x in ("src", "out", "cursor"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in ([(*r, False) for r in rows[:60]], [(*r, False) for r in rows[60:]], [(*gone, True)]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            stream = threads.stream_thread_states(spark.readStream.schema(schema).parquet(src))
            events.run_incremental(stream, cursor, events.parquet_sink(out)).awaitTermination()
    finally:
        spark.conf.set(store, before)
    made = spark.read.parquet(out).groupBy("thread_id").agg(F.max_by(F.struct("kind", "message_id", "n_events", "n_messages", "unavailable"), "batch").alias("r")).select("thread_id", "r.*")
    got = {r.thread_id: (r.kind, r.message_id, r.n_events) for r in made.collect()}
    for t, found in got.items():
        want = plain_thread([r[1:] for r in rows if r[0] == t])
        assert found == ((want[-1][1], want[-1][0], len(want)) if want else (None, None, 0)), t
    assert sum(r.unavailable for r in made.collect()) == (0 if says(threads.NEWSLETTER_SUBJECT, gone[5] or "") else 1)


def plain_ingest(rows, done, known):
    """{event_id: (outcome, review, status, decision)} for (event_id, key, kind, at, apply, review)."""
    out, now = {}, {k: dict(v) for k, v in known.items()}
    for e, key, kind, at, apply, review in sorted(rows, key=lambda r: (r[3], r[0])):
        if e in done:
            continue
        if not apply:
            out[e] = ("history_only", review, None, None)
            continue
        s = now.setdefault(key, {}) if key is not None else {}
        status, canonical = s.get("status"), ingest.CANONICAL.get(kind)
        applied = status in ingest.APPLICATION or (status == "discarded" and (s.get("decision") == "applied" or s.get("noted")))
        if s.get("decided_at") and at < s["decided_at"]:
            o = "older_than_current_decision"
        elif status in (s.get("dates") or {}) and at.date() < s["dates"][status]:
            o = "older_than_canonical_transition"
        elif status == "skip" and kind == "proposal_unanswered":
            o = "prior_exclusion_preserved"
        elif review and applied:
            o = "review_preserves_application"
        elif applied and kind in ("pending", "proposal_unanswered", "declined"):
            o, review = "application_preserved", kind == "declined"
        elif status and canonical and kind != "withdrawn" and ingest.PHASE.get(status, 0) > ingest.PHASE[canonical]:
            o = "later_application_stage_preserved"
        elif s.get("withdrawn") and kind in ("pending", "proposal_unanswered", "declined"):
            o = "withdrawal_preserved"
        else:
            o = "applied"
            if canonical and not review:
                s["status"] = canonical
            s["decision"] = "pending" if review or kind in ("pending", "proposal_unanswered") else "excluded" if kind in ("declined", "withdrawn") else "applied"
            s["decided_at"], s["withdrawn"] = at, kind == "withdrawn" and not review
        out[e] = (o, bool(review), s.get("status"), s.get("decision"))
    return out


def test_ingest_equals_a_plain_loop(spark):
    rng = random.Random(4)
    kinds = ["proposal_unanswered", "pending", *ingest.CANONICAL]
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(24 * n))
    rows = [(i, rng.choice([None, *range(60), 3, 3, 3, 3]), rng.choice(kinds), day(30), rng.random() < 0.9, rng.random() < 0.2) for i in range(900)]
    done, again = set(range(0, 900, 9)), {5, 14, 23}
    known = {
        k: {"status": rng.choice([None, "evaluated", "applied", "skip", "interview", "discarded", "no-response"]), "decision": rng.choice([None, "applied", "pending", "excluded"]), "decided_at": rng.choice([None, day(10)]),
            "withdrawn": rng.random() < 0.3, "noted": rng.random() < 0.3, "dates": {rng.choice(["applied", "interview", "skip"]): datetime.date(2024, 1, 12)}}
        for k in range(50)
    }
    frame = spark.createDataFrame(rows, "event_id long, key long, kind string, event_at timestamp, apply boolean, needs_review boolean")
    ledger = spark.createDataFrame([(e, "applied") for e in done] + [(e, rng.choice(["prepared", "error"])) for e in again], "event_id long, outcome string")
    state = spark.createDataFrame([(k, v["status"], v["dates"], v["decision"], v["decided_at"], v["withdrawn"], v["noted"]) for k, v in known.items()], "key long, status string, dates map<string,date>, decision string, decided_at timestamp, withdrawn boolean, noted boolean")
    want = plain_ingest(rows, done, known)
    got = ingest.ingest_in_order(frame.union(frame.limit(40)), ledger, state).collect()
    assert {r.event_id: (r.outcome, r.needs_review, r.status, r.decision) for r in got} == want
    assert len(got) == len(want) and len({x[0] for x in want.values()}) == 9
    assert ingest.ingest_in_order(frame.limit(0), ledger, state).count() == 0
    alone = ingest.ingest_in_order(spark.createDataFrame([(1, 0, "applied", None)], "event_id long, key long, kind string, event_at timestamp"), ledger.select("event_id"), state.select("key"))
    assert [(r.outcome, r.status) for r in alone.collect()] == [("applied", None)]
