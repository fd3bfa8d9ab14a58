"""Threads of messages as applications: what each message says, and the state machine that its thread folds it into.

What a message says on its own are columns (message_facts). What it means depends on the thread: a reply to a proposal
holds it, an answer after an application is a response, a refusal after one withdraws it. That fold runs over the
messages of a thread in order of time. In a batch they pass a task one by one, sorted; a stream keeps the facts of a
thread's messages as state and folds them anew when a late one arrives, so both give the same events.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brightloom.functions.scope import owner_of

# What messages of recruiters and candidates say.
PROPOSAL = r"포지션\s*(?:제안|소개|안내)|(?:채용|입사|이직)\s*제안|position\s+(?:proposal|opportunity)|career\s+opportunity"
DECLINE = r"고사(?:하|드|를)|지원(?:을|은|를)?\s*(?:하지\s*않|안\s*하|안\s*할|않겠|어려|어렵|포기)|진행(?:을|은)?\s*(?:하지\s*않|어려|어렵|않겠)|정중히\s*거절|decline\s+(?:the|this|your)|not\s+(?:be\s+)?(?:interested|proceeding)|won.t\s+(?:apply|proceed)"
WITHDRAW = r"(?:지원|전형|면접)\s*(?:을|를|은)?\s*(?:철회|중단|취소)|withdraw\s+(?:my\s+)?application"
HOLD = r"(?:검토|고려)(?:해|하|하여|하고)\s*(?:보|있|후)|(?:추후|나중에|다음에).{0,15}(?:검토|연락)|보류|시간.{0,10}(?:필요|주시면)|consider\s+(?:it|the|this)|review\s+(?:it|the|this)"
APPLY = (
    r"지원(?:을|하고자)?\s*(?:하겠|합니다|할게|희망|진행)|지원\s*의사(?:가|를|는)?\s*(?:있|밝히|전달|드립니다)"
    r"|(?:이력서|지원서|서류|resume|cv).{0,35}(?:첨부(?:합니다|드립니다|하였|했)|송부(?:합니다|드립니다|했)|전달(?:합니다|드립니다|했)|보냅니다|보내드립니다|attached|attach)"
    r"|(?:apply|applying)\s+(?:for|to)|please\s+(?:submit|proceed)"
)
CONDITIONAL_APPLY = (
    r"지원\s*의사.{0,15}(?:없|않)|아직.{0,30}(?:지원|이력서).{0,20}(?:않|없|못)|(?:조건|처우|연봉).{0,30}(?:확인한\s*후|확인\s*후|맞으면|충족|괜찮으면)"
    r"|(?:검토|확인).{0,8}(?:후에|후|뒤).{0,25}(?:지원|이력서)|if.{0,50}(?:apply|resume|proceed)"
)
RECEIPT = (
    r"지원(?:서|이)?\s*(?:정상적으로\s*)?(?:접수|완료)|지원해\s*주셔서|서류(?:가|를)?\s*(?:접수|전달|추천).{0,15}(?:완료|드렸|했습니다)"
    r"|application\s+(?:received|submitted)|thank\s+you\s+for\s+applying"
)
REJECT = (
    r"불합격|(?:함께|다음\s*단계).{0,25}(?:어렵|어려|못하)|(?:전형|지원).{0,25}(?:탈락|아쉽)|not\s+(?:be\s+)?(?:moving|proceeding)\s+(?:forward|further|with\s+(?:your|the)\s+(?:application|candidacy))"
    r"|unfortunately.{0,60}(?:application|position)|(?:decided|deciding|chosen)\s+to\s+(?:move\s+forward|proceed)\s+with\s+other\s+candidates|(?:다른|적합한)\s*후보.{0,20}(?:진행|채용)"
    r"|(?:요건|기준).{0,20}차이가\s*(?:있다는|있어|있다고)|모시기.{0,12}(?:어려|어렵)|모시지\s*못하|탈락\s*사유(?:였|입|가)|잘\s*안\s*되(?:셨어|셨)"
    r"|(?:긍정적인|좋은|합격)\s*(?:소식|결과).{0,35}(?:이어지지\s*못|전해\s*드리지\s*못|전하지\s*못)|인연을\s*이어가지\s*못"
)
INTERVIEW = r"(?:면접|인터뷰|과제|인적성).{0,25}(?:안내|일정|요청|진행|참석|전형)|interview\s+(?:invitation|schedule|with)|assessment\s+(?:invitation|request)"
OFFER = r"(?:최종\s*합격|오퍼\s*(?:레터|안내|제안)|처우\s*(?:협의|제안))|offer\s+letter|pleased\s+to\s+offer"
HIRED = r"입사(?:일|\s*확정|를\s*환영)|온보딩\s*안내|welcome\s+aboard|start\s+date\s+(?:is|confirmed)"
RECRUITMENT = (
    r"채용|구직|이직|입사|헤드헌|이력서|지원서|지원\s*(?:공고|분야)|지원한\s*공고|지원(?:하신|하셨|해\s*주)|서류\s*전형|전형\s*(?:결과|안내|일정)|면접"
    r"|\b(?:recruitment|recruiter|hiring|candidate|candidates|candidacy|resume|interview)\b|\b(?:job|career)\s+(?:application|opportunity)"
    r"|\bapplication\s+(?:decision|result|received|submitted)|\byour\s+application\b|thank\s+you\s+for\s+applying"
)
RESULT_SUBJECT = r"(?:서류|전형|지원|채용).{0,25}(?:결과|불합격|탈락)|불합격\s*안내|\bapplication\s+(?:decision|result)|\b(?:interview|recruitment)\s+(?:decision|result)"
NEWSLETTER_SUBJECT = r"job\s*alert|채용\s*알림|뉴스레터|맞춤\s*공고|추천\s*공고|newsletter"
PERSONAL_RESULT = r"지원하신.{0,100}결과|(?:이력서|서류).{0,25}검토(?:한)?\s*결과|탈락\s*사유(?:였|입|가)|(?:요건|기준).{0,20}차이가\s*(?:있다는|있어|있다고)"
#: Lines that describe how hiring goes in general, and so say nothing of this person.
PROCESS_LINE = r"(?:채용|전형)\s*(?:절차|프로세스)|(?:서류|면접|인터뷰|처우).*(?:[-→>]).*(?:면접|인터뷰|합격|처우)|불합격자(?:에게|는|에\s*한해)|합격자(?:에게|에\s*한해)"
FORWARDED_SUBJECT = r"지원|채용|전형|면접"
UNCERTAIN_SUBJECT = r"(?:서류|전형|지원|application).{0,30}(?:결과|결정|result|decision)"
CERTAIN_RECEIPT = r"접수.{0,15}완료|지원이\s*(?:정상적으로\s*)?완료|application\s+(?:received|submitted)"
#: Rules of own and of received messages, the first that fits counts.
SENT_RULES = (("withdrawn", WITHDRAW), ("declined", DECLINE), ("applied", APPLY), ("pending", HOLD))
RECEIVED_RULES = (("rejected", REJECT), ("hired", HIRED), ("offer", OFFER), ("interview", INTERVIEW), ("applied", RECEIPT))
#: Kinds after which a thread is an application.
APPLICATION_KINDS = ("applied", "responded", "interview", "offer", "hired", "rejected")

#: What the fold needs of a message, besides its thread, time and id.
FACTS = ("sent", "forwarded", "proposal", "personal", "rejects", "recruits", "tells", "proves", "led", "rule", "uncertain")


def _says(text: Column, pattern: str) -> Column:
    return text.rlike("(?is)" + pattern)


def message_facts(messages: DataFrame) -> DataFrame:
    """Of X27: messages (thread_id, message_id, at, sent, body, and if there are any subject and forwarded) as FACTS.

    A column removed is kept. Newsletters go. Null texts are empty. A pattern is looked for in one message at a time, not over two.
    """
    col = lambda name, other: F.coalesce(F.col(name), other) if name in messages.columns else other
    kept = [*owner_of(messages), "thread_id", "message_id", "at", *(["removed"] if "removed" in messages.columns else [])]
    rows = messages.select(
        *kept, F.coalesce("sent", F.lit(False)).alias("sent"), col("forwarded", F.lit(False)).alias("forwarded"),
        col("subject", F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("body"),
    )
    rows = rows.where(~_says(F.col("subject"), NEWSLETTER_SUBJECT))
    subject, body, sent = F.col("subject"), F.col("body"), F.col("sent")
    outlined = F.when(_says(body, PROCESS_LINE), F.array_join(F.filter(F.split(body, "\n"), lambda x: ~x.rlike(PROCESS_LINE)), "\n")).otherwise(body)
    result = _says(subject, RESULT_SUBJECT)
    status = F.when(~sent & result, F.concat(subject, F.lit("\n"), outlined)).otherwise(outlined)
    rows = rows.withColumns({"_all": F.concat(subject, F.lit("\n"), body), "_status": status, "_result": result})
    everything, status = F.col("_all"), F.col("_status")

    def first(rules: Sequence[tuple[str, str]], but: Column | None = None) -> Column:
        kind = F.lit(None).cast("string")
        for name, pattern in reversed(rules):
            hit = _says(status, pattern) & (~but if but is not None and name == "applied" else F.lit(True))
            kind = F.when(hit, name).otherwise(kind)
        return kind

    rule = F.when(sent, first(SENT_RULES, _says(status, CONDITIONAL_APPLY))).otherwise(first(RECEIVED_RULES))
    return rows.select(
        *kept, "sent", "forwarded",
        _says(everything, PROPOSAL).alias("proposal"), _says(status, PERSONAL_RESULT).alias("personal"),
        (_says(status, REJECT) & (F.col("_result") | ~_says(body, PROPOSAL))).alias("rejects"),
        _says(everything, f"{RECRUITMENT}|{PROPOSAL}|{RECEIPT}").alias("recruits"),
        # enough with recruitment in the thread, and enough alone
        _says(everything, f"{RECEIPT}|{INTERVIEW}|{OFFER}|{REJECT}").alias("tells"),
        (_says(body, PROPOSAL) | (sent & _says(body, APPLY)) | (F.col("forwarded") & subject.rlike(FORWARDED_SUBJECT))).alias("proves"),
        _says(subject, PROPOSAL).alias("led"),
        rule.alias("rule"), (_says(subject, UNCERTAIN_SUBJECT) & ~_says(status, CERTAIN_RECEIPT)).alias("uncertain"),
    )


class ThreadFold:
    """The state of one thread while its messages pass in order."""

    def __init__(self, recruits: bool) -> None:
        self.recruits, self.current, self.application = recruits, None, False

    def step(self, m: dict) -> tuple[str, bool] | None:
        """(kind, needs_review) of the event that message m makes, or None."""
        proposal = not m["sent"] and self.current is None and m["proposal"]
        personal = m["personal"] or (self.recruits and m["rejects"])
        # a proposal describes how hiring goes on; nothing of that has happened
        kind = "proposal_unanswered" if proposal and not personal else m["rule"]
        if kind is None:
            if proposal:
                kind = "proposal_unanswered"
            elif m["sent"] and self.current == "proposal_unanswered" or m["forwarded"]:
                kind = "pending"
            if not m["sent"] and self.current in ("applied", "responded"):
                kind = "responded"
        if kind is None:
            return None
        review = m["forwarded"] or (kind == "applied" and not m["sent"] and m["uncertain"])
        if self.application and kind == "declined":
            kind = "withdrawn"
        if self.application and kind == "pending":
            return None
        self.application = self.application or kind in APPLICATION_KINDS
        self.current = kind
        return kind, review


def is_relevant(recruits: bool, tells: bool, proves: bool, led: bool) -> bool:
    """Does a thread concern an application? led: its first subject proposes."""
    return proves or led or (recruits and tells)


def thread_states(messages: DataFrame) -> DataFrame:
    """W7 and W11 in full: (thread_id, message_id, at, kind, needs_review, apply): what the messages of each thread change,
    in order of at and message_id; apply marks the thread's last event. Threads that concern no application have none.

    What holds for a whole thread is aggregated first (combined before the shuffle). Then threads are sorted within
    hash partitions and pass one message at a time: a task keeps one state and one event, however long a thread is.
    Null threads are one thread; of null times the order is the message_id's; messages of one id and time come in any order.
    """
    facts = message_facts(messages)
    own = owner_of(messages)
    by = [*own, "thread_id"]
    whole = facts.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(
        F.bool_or("recruits").alias("_r"), F.bool_or("tells").alias("_t"), F.bool_or("proves").alias("_p"), F.min_by("led", F.struct("at", "message_id")).alias("_l")
    ).where("_p OR _l OR (_r AND _t)")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = facts.join(whole, same).select(*by, "message_id", "at", F.col("_r").alias("thread_recruits"), *FACTS)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, held = None, None, None
        schema = None
        for batch in batches:
            schema = schema or pa.schema([*[batch.schema.field(c) for c in (*by, "message_id", "at")], ("kind", pa.string()), ("needs_review", pa.bool_()), ("apply", pa.bool_())])
            out = []
            for m in batch.to_pylist():
                now = tuple(m[c] for c in by)
                if key != (now,):
                    if held:
                        out.append({**held, "apply": True})
                    key, fold, held = (now,), ThreadFold(m["thread_recruits"]), None
                if event := fold.step(m):
                    if held:
                        out.append(held)
                    held = {**{c: m[c] for c in (*by, "message_id", "at")}, "kind": event[0], "needs_review": event[1], "apply": False}
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([{**held, "apply": True}], schema)

    fields = ", ".join(f"{c} {kinds[c]}" for c in (*by, "message_id", "at"))
    return rows.repartition(*by).sortWithinPartitions(*by, "at", "message_id").mapInArrow(run, f"{fields}, kind string, needs_review boolean, apply boolean")


def fold_messages(messages: Iterable[dict]) -> list[tuple[dict, str, bool]]:
    """(message, kind, needs_review) of the events of one thread whose messages (with at, message_id and FACTS) are given."""
    held = sorted(messages, key=lambda m: (m["at"], m["message_id"]))
    recruits = any(m["recruits"] for m in held)
    if not held or not is_relevant(recruits, any(m["tells"] for m in held), any(m["proves"] for m in held), held[0]["led"]):
        return []
    fold = ThreadFold(recruits)
    return [(m, *e) for m in held if (e := fold.step(m))]


class ThreadProcessor(StatefulProcessor):
    """Keeps the facts of a thread's messages, and folds them anew whenever some arrive or are removed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"rule": "string"}
        facts = ", ".join(f"{f} {kinds.get(f, 'boolean')}" for f in FACTS)
        self.messages = handle.getMapState("messages", "message_id long", f"at long, removed boolean, {facts}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        for part in rows:
            for m in part.to_dict("records"):
                if m["removed"] and self.messages.containsKey((m["message_id"],)):
                    old = list(self.messages.getValue((m["message_id"],)))
                    self.messages.updateValue((m["message_id"],), (old[0], True, *old[2:]))
                else:
                    rule = m["rule"] if isinstance(m["rule"], str) else None
                    self.messages.updateValue((m["message_id"],), (int(m["at"]), bool(m["removed"]), *[rule if f == "rule" else bool(m[f]) for f in FACTS]))
        # the fold needs them in order of time, so a thread's facts (not its texts) are in memory here
        held = [{"message_id": k[0], **dict(zip(("at", "removed", *FACTS), v))} for k, v in self.messages.iterator()]
        events = fold_messages(held)
        last = events[-1] if events else ({"message_id": None}, None, None)
        yield pd.DataFrame({
            "thread_id": [key[0]], "kind": [last[1]], "message_id": pd.array([last[0]["message_id"]], dtype="Int64"), "n_events": [len(events)],
            "n_messages": [len(held)], "unavailable": [sum(m["removed"] for m in held)],
        })

    def close(self) -> None:
        pass


def stream_thread_states(src: DataFrame) -> DataFrame:
    """T5 and T6 in full: (thread_id, kind, message_id, n_events, n_messages, unavailable) whenever a thread's messages (as of
    message_facts, with numbers as thread_id, message_id and at, and removed) arrive, in any order and any batch.

    kind and message_id are those of the thread's last event; thread_states gives the same for all messages at once.
    Removed messages stay as evidence; a message that comes again under its id replaces itself. Needs the RocksDB state store.
    """
    facts = message_facts(src)
    facts = facts.withColumn("removed", F.coalesce("removed", F.lit(False)) if "removed" in facts.columns else F.lit(False))
    schema = "thread_id long, kind string, message_id long, n_events long, n_messages long, unavailable long"
    return facts.groupBy("thread_id").transformWithStateInPandas(ThreadProcessor(), schema, "Update", "None")
