"""Messages and events: text rules, thread state, receipts, reconciliation and idempotent ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.scope import owner_of
from brightloom.functions.text import company_key, html_to_text, let, nfkc, text_key
from brightloom.operators.tracker import transition_allowed

# What messages say, from the strongest kind to the weakest.
REJECTED = (
    r"불\s*합격",
    r"(?:이번|귀하|지원하신|지원했던|전형\s*결과|서류\s*결과).{0,45}탈락|탈락.{0,35}(?:이후|다음)\s*(?:단계|전형)",
    r"(?:해당\s*)?(?:포지션|직무|채용|전형).{0,30}탈락(?!률)|탈락(?!률)\s*(?:결과|안내|통보)",
    r"아쉬운\s*결과",
    r"합격.{0,18}못",
    r"(?:지원자|귀하|함께|모시).{0,20}못",
    r"합격\s*소식.{0,35}(?:전해|전하|전달).{0,12}못",
    r"(?:이후|다음)\s*(?:채용\s*)?(?:단계|전형).{0,30}(?:진행|함께).{0,12}(?:어렵(?!지\s*않)|불가)",
    r"(?:함께|모시).{0,20}(?:어렵|할\s*수\s*없)",
    r"(?:서류\s*)?검토\s*기간(?:이|은|가)?\s*만료(?!\s*(?:전|되지))",
    r"전형(?:이|은|을)?\s*(?:종료|마감)",
    r"(?:will|would|have|has)?\s*not\s+(?:be\s+)?mov(?:e|ing)\s+forward",
    r"decided\s+not\s+to\s+proceed",
    r"(?:pursue|pursuing|move forward with)\s+other\s+candidates",
    r"application\s+(?:was|is)\s+unsuccessful",
)
OFFER = ("최종 합격", "처우 제안", "오퍼 레터", "offer letter", "employment offer")
INTERVIEW = (
    "면접 일정", "면접 안내", "인터뷰 일정", "인터뷰 안내", "인터뷰 요청", "interview invitation", "schedule your interview", "assessment invitation",
    r"(?:면접|인터뷰).{0,25}(?:일정|리마인드|알림|안내|요청|확정|시작)", r"서류\s*전형?\s*합격",
)
RESPONDED = (
    "결과 안내가 지연", "지원 결과가 지연", "채용 절차가 지연", "서류 검토 중", "전형을 진행 중", "검토가 진행 중", "application is under review", "still reviewing your application",
    "update on your application", "application status update",
)
APPLIED = (
    "지원이 완료", "지원이 정상적으로 완료", "지원서 접수 완료", "입사지원서 접수", "지원 완료", "thank you for applying", "received your application", "application received",
    r"(?:입사)?지원서(?:가|는)?\s*(?:정상(?:적으로)?\s*)?접수",
)
KINDS = (("rejected", REJECTED), ("offer", OFFER), ("interview", INTERVIEW), ("responded", RESPONDED), ("applied", APPLIED))
#: A rejection needs one of these besides.
CONTEXT = r"지원|채용|포지션|직무|전형|서류|면접|인터뷰|application|candidate|position|role"
#: An own message that applies: what is meant, and what is attached.
OWN_APPLICATION = (
    r"지원하고자|지원(?:한다는|하겠다는)\s*(?:의사|뜻)|지원\s*(?:희망|의사)",
    r"(?:이력서|resume|cv).{0,60}(?:첨부(?:드립니다|했습니다|합니다)|제출(?:드립니다|했습니다|합니다)|송부(?:드립니다|했습니다|합니다))",
)
#: Chat notices tell of an application only with one of the words.
CHAT_NOTICE, CHAT_WORDS = r"에서\s*메시지를\s*보냈습니다", r"지원|합격|불\s*합격|탈락|일정.{0,8}(?:확정|요청)"
# Where receipts and notices name company and role: (of subject or body, pattern); groups 1 and 2.
NAMED = (
    ("body", r"^\[([^]]+)\]\s*(.+?)\s+지원(?:이|서가)?\s+(?:정상적으로\s+)?완료"),
    ("subject", r"^\[지원\s*안내\]\s*(.+?)\s*[_｜|]\s*(.+?)\s*(?:\([^)]*\))?\s*$"),
    ("subject", r"^지원하신\s+(.+?)\s+(.+?)의\s+(?:서류|지원|채용|전형)"),
    ("subject", r"^(?:\[원티드\]\s*[^!]+!\s*)?(?:\[[^]]+\]\s*)?(.+?)의\s+(.+?)에\s+지원이\s+(?:정상적으로\s+)?완료"),
    ("led", r"^\[([^]]+)\]\s*\u0001(?:의)?\s+(.+?)\s+(?:지원(?:서|의|은|을|이)?|인터뷰|채용)"),
    ("body", r"기업명\s+(.+?)\s+지원한 공고\s+(.+?)(?:\s+-\s+서류|\s+전형 상태|\s+\S{2,10}\s*님(?:\s|,|$)|\s+안녕하세요|$)"),
)
BRACKET, PORTALS = r"^\[([^]]+)\]", ("원티드", "리멤버", "안내")
APPLYING_TO = r"applying to\s+(.+?)(?:$|\s*[-|])"
ROLE_ALONE = (
    ("body", r"님의?\s+(.+?)\s+지원이\s+(?:정상적으로\s+)?완료"),
    ("both", r"(?:application for|applying for|interest in)\s+(?:the\s+)?(.+?)(?:\s+position|\s+role|\s+at\s+|[.!]|$)"),
)
POSITION = r"채용\s*포지션\s*[:：]\s*(.+?)\s+[-–—|｜/]\s+(.+?)(?:\n|\r|지원일|전형|결과|$)"


def message_kind(text: Column, subject: Column | None = None, kinds: Sequence = KINDS, context: str | None = CONTEXT) -> Column:
    """Kind of a message, the strongest that its text says; a rejection needs a word of recruiting besides. Null if
    nothing is said, or if a portal only tells of a chat message."""

    def judged(low: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, patterns in reversed(list(kinds)):
            hit = low.rlike("|".join(f"(?:{p})" for p in patterns))
            if name == "rejected" and context:
                hit = hit & low.rlike(context)
            if name == "applied":
                hit = hit | (low.rlike(OWN_APPLICATION[0]) & low.rlike(OWN_APPLICATION[1]))
            kind = F.when(hit, name).otherwise(kind)
        if subject is not None:
            kind = F.when(~(F.lower(nfkc(F.coalesce(subject, F.lit("")))).rlike(CHAT_NOTICE) & ~low.rlike(CHAT_WORDS)), kind)
        return kind

    return let(F.lower(nfkc(F.coalesce(text, F.lit("")))), judged)


def subject_names(subject: Column, body: Column) -> tuple[Column, Column]:
    """(company, role) by the first template that subject or body fits, else what either names alone; null where
    nothing is named."""
    plain = lambda c: F.trim(nfkc(F.coalesce(c, F.lit(""))))
    both = F.struct(F.regexp_replace(plain(subject), r"(?i)^(?:(?:fwd?|re)\s*:\s*)+", "").alias("said"), plain(body).alias("told"))
    return let(both, lambda x: _named(x["said"], x["told"])[0]), let(both, lambda x: _named(x["said"], x["told"])[1])


def _named(said: Column, told: Column) -> tuple[Column, Column]:
    first = F.regexp_replace(F.regexp_extract(said, BRACKET, 1), r"(?i)\s+(?:careers|채용)$", "")
    # a body that begins with the company of the subject's bracket: the bracket and what follows the name
    led = F.when((first != "") & told.startswith(first), F.concat(F.lit("["), first, F.lit("]\u0001"), F.substr(told, F.length(first) + 1))).otherwise("")
    texts = {"subject": said, "body": told, "led": led, "both": F.concat_ws(" ", said, told)}
    got = lambda of, pattern, i: F.nullif(F.trim(F.regexp_extract(texts[of], "(?i)" + pattern, i)), F.lit(""))
    bracket = F.regexp_extract(said, BRACKET, 1)
    company = F.coalesce(got("subject", APPLYING_TO, 1), F.when((bracket != "") & ~bracket.isin(*PORTALS), bracket), got("body", POSITION, 1))
    role = F.coalesce(*[got(of, p, 1) for of, p in ROLE_ALONE], got("body", POSITION, 2))
    for of, pattern in reversed(NAMED):
        hit = texts[of].rlike("(?i)" + pattern)
        company, role = F.when(hit, got(of, pattern, 1)).otherwise(company), F.when(hit, got(of, pattern, 2)).otherwise(role)
    return company, role


def explode_mail(df: DataFrame, skip: Sequence[str] = ("DRAFT", "SPAM", "TRASH")) -> DataFrame:
    """Messages (labels, parts array<struct<mime, text>>) with body: the first plain part that is not blank, else the
    text of the first HTML part, cut at quote markers. Drafts, spam and trash go."""
    usable = lambda mime: F.filter("parts", lambda p: (p["mime"] == mime) & (F.trim(F.coalesce(p["text"], F.lit(""))) != ""))
    part = lambda mime: F.get(usable(mime), F.lit(0))["text"]
    skipped = F.arrays_overlap(F.coalesce("labels", F.array().cast("array<string>")), F.array(*map(F.lit, skip)))
    return df.where(~F.coalesce(skipped, F.lit(False))).withColumn("body", clean_body(F.coalesce(part("text/plain"), html_to_text(part("text/html")), F.lit("")))).drop("parts")


def clean_body(body: Column) -> Column:
    """A message's own text: everything from the first quote marker on goes."""
    return F.trim(F.regexp_replace(body, r"(?s)(?:\n>|\nOn [^\n]* wrote:|\n-{2,} ?Original Message).*$", ""))


def thread_events(messages: DataFrame, kind: Column) -> DataFrame:
    """(thread_id, at, kind, apply): what each message changes in its thread, in order of at.

    A thread moves forward only: a message counts if its kind is allowed after the last that counted; apply marks the
    thread's last event. The fold is an aggregate over the sorted messages of one thread.
    """
    keys = [*owner_of(messages), "thread_id"]
    rows = messages.withColumn("kind", kind).where("kind IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "kind"))).alias("m"))
    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<struct<at:bigint,kind:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["now"].isNull() | ((x["kind"] != acc["now"]) & transition_allowed(acc["now"], x["kind"]))
        event = F.array(F.struct(x["at"].cast("bigint").alias("at"), x["kind"].alias("kind")))
        return F.struct(F.when(new, x["kind"]).otherwise(acc["now"]).alias("now"), F.when(new, F.concat(acc["out"], event)).otherwise(acc["out"]).alias("out"))

    folded = rows.select(*keys, F.aggregate("m", start, step, lambda a: a["out"]).alias("out"))
    return folded.select(*keys, F.size("out").alias("n"), F.posexplode("out").alias("i", "e")).select(*keys, "e.at", "e.kind", (F.col("i") == F.col("n") - 1).alias("apply"))


def paired_receipts(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Of J15: (a_id, b_id) of events of one role and key within so many seconds of each other, a before b.

    Events meet in buckets of that width, each in its own and the one before, so that no key joins whole with itself.
    """
    t = F.unix_micros(F.col("event_at").cast("timestamp"))
    width = seconds * 1_000_000
    own = owner_of(events)
    a = events.select(*own, F.col("event_id").alias("a_id"), "key", "role", t.alias("ta"), F.floor(t / width).alias("slot"))
    b = events.select(*own, F.col("event_id").alias("b_id"), "key", "role", t.alias("tb"), F.explode(F.array(F.floor(t / width), F.floor(t / width) - 1)).alias("slot"))
    near = (F.col("tb") - F.col("ta")).between(0, width) & ((F.col("tb") > F.col("ta")) | (F.col("b_id") > F.col("a_id")))
    return a.join(b, [*own, "key", "role", "slot"]).where(near).select(*own, "a_id", "b_id")


def _identity(text: Column) -> Column:
    """Lower case and single blanks, none beside brackets."""
    flat = F.trim(F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"\s+", " "))
    return F.regexp_replace(flat, r"\s*([()])\s*", "$1")


def company_aliases(company: Column) -> Column:
    """The company's name, and both names where one in Hangul and one in Latin letters stand as "name (name)"."""

    def names(name: Column) -> Column:
        left, right = F.trim(F.regexp_extract(name, r"^([^()]+)\(([^()]+)\)$", 1)), F.trim(F.regexp_extract(name, r"^([^()]+)\(([^()]+)\)$", 2))
        hangul, latin = (lambda t: t.rlike("[가-힣]")), (lambda t: t.rlike("[a-z]"))
        two = (hangul(left) & latin(right)) | (latin(left) & hangul(right))
        letters = F.regexp_replace(F.when(hangul(left), right).otherwise(left), "[^a-z]", "")
        told = two & (F.least(F.length(left), F.length(right)) >= 2) & (F.length(letters) >= 3) & ~right.isin("inc", "ltd", "korea", "한국", "주식회사")
        return F.when(told, F.array_distinct(F.array(name, left, right))).otherwise(F.array(name))

    return let(_identity(company), names)


def receipt_aliases(events: DataFrame, tracker: DataFrame, seconds: int = 300) -> DataFrame:
    """(event_id, num): receipts that belong to a row of the tracker under another name of the company.

    A receipt (event_id, company, role, event_at) may be a row's (num, company, role, date) if role and day are the same
    and their company names share an alias; it is if, besides, another receipt within so many seconds names the row
    exactly and shares an alias with it. Receipts meet peers of a row in time slots, never a row's whole history.
    """
    own = owner_of(events, tracker)
    width = seconds * 1_000_000
    t = F.unix_micros(F.col("event_at").cast("timestamp"))
    e = events.select(*own, "event_id", _identity(F.col("company")).alias("c"), _identity(F.col("role")).alias("r"), company_aliases(F.col("company")).alias("names"), t.alias("at"), F.to_date("event_at").alias("day"))
    rows = tracker.where("num IS NOT NULL").select(*own, "num", _identity(F.col("company")).alias("c"), _identity(F.col("role")).alias("r"), F.to_date("date").alias("day"), company_aliases(F.col("company")).alias("row_names"))
    named = rows.select(*own, "num", "r", "day", F.explode("row_names").alias("name"))
    maybe = e.select(*own, "event_id", "r", "day", "at", "names", F.explode("names").alias("name")).join(named, [*own, "r", "day", "name"])
    maybe = maybe.select(*own, "event_id", "num", "at", "names").distinct()
    peers = e.join(rows.select(*own, "num", "c", "r"), [*own, "c", "r"]).select(*own, "num", F.col("event_id").alias("peer"), F.col("at").alias("peer_at"), F.col("names").alias("peer_names"))
    slots = F.explode(F.array(*[F.floor(F.col("at") / width) + i for i in (-1, 0, 1)]))
    met = maybe.withColumn("slot", slots).join(peers.withColumn("slot", F.floor(F.col("peer_at") / width)), [*own, "num", "slot"])
    near = (F.col("event_id") != F.col("peer")) & (F.abs(F.col("at") - F.col("peer_at")) <= width) & F.arrays_overlap("names", "peer_names")
    return met.where(near).select(*own, "event_id", "num").distinct()


def same_run_block(candidates: DataFrame, messages: DataFrame) -> DataFrame:
    """Candidates with blocked: does a message of this run (company, action) concern their company?"""
    own = owner_of(candidates, messages)
    keys = messages.where(F.col("action").isin("add", "update", "no_change")).select(*own, company_key(F.col("company")).alias("_k")).where("_k <> ''").distinct().withColumn("_b", F.lit(True))
    met = candidates.withColumn("_k", company_key(F.col("company"))).join(keys, [*own, "_k"], "left")
    return met.select(*candidates.columns, F.coalesce("_b", F.lit(False)).alias("blocked"))


def reconcile(messages: DataFrame, tracker: DataFrame) -> DataFrame:
    """Q3: (key, action, num, kind) for the first message of each company and role: update where the one row of the
    tracker may move on, no_change where it may not, review where several fit, add where none does.

    messages: message_id, company, role, kind; the least message_id is first.
    """
    own = owner_of(messages, tracker)
    keyed = messages.select(*own, "message_id", "kind", company_key(F.col("company")).alias("k"), text_key(F.col("role")).alias("r")).where("k <> '' AND kind IS NOT NULL")
    first = keyed.groupBy(*own, "k", "r").agg(F.min_by("kind", "message_id").alias("kind"))
    # summed by names as they stand, so that keys are made once for each
    named = tracker.groupBy(*own, "company", "role").agg(F.count("*").alias("n"), F.max(F.struct("num", "status")).alias("row"))
    rows = named.groupBy(*own, company_key(F.col("company")).alias("k"), text_key(F.col("role")).alias("r")).agg(F.sum("n").alias("n"), F.max("row").alias("row"))
    met = first.join(rows, [*own, "k", "r"], "left")
    moves = (F.col("row.status") != F.col("kind")) & transition_allowed(F.col("row.status"), F.col("kind"))
    action = F.when(F.col("n").isNull(), "add").when(F.col("n") > 1, "review").when(moves, "update").otherwise("no_change")
    return met.select(*own, F.concat_ws("::", "k", "r").alias("key"), action.alias("action"), F.when(F.col("n") == 1, F.col("row.num")).alias("num"), "kind")


def update_queue(queue: DataFrame, messages: DataFrame, now: Column, archive_days: int = 90, prune_days: int = 180) -> DataFrame:
    """Q4: review queue (message_key, state, first_seen, last_seen) with the messages (message_key, at) of this run.

    Seen messages are open, and reopen what was archived; resolved and ignored stay so. Open ones not seen for
    archive_days are archived; archived ones not seen for prune_days go.
    """
    keys = [*owner_of(queue, messages), "message_key"]
    seen = messages.groupBy(*keys).agg(F.min("at").alias("a"), F.max("at").alias("z"))
    met = queue.join(seen, keys, "full")
    last = F.greatest("last_seen", "z")
    idle = F.datediff(now, last)
    state = F.when(F.col("state").isin("resolved", "ignored"), F.col("state")).when(F.col("z").isNotNull() & (idle < archive_days), "open").when(idle >= archive_days, "archived").otherwise(F.coalesce("state", F.lit("open")))
    out = met.select(*keys, state.alias("state"), F.least("first_seen", "a").alias("first_seen"), last.alias("last_seen"))
    return out.where(~((F.col("state") == "archived") & (F.datediff(now, "last_seen") >= prune_days)))


def ingest_events(events: DataFrame, ledger: DataFrame, state: DataFrame) -> DataFrame:
    """Q6: outcome of every event (event_id, key, kind, event_at) that the ledger (event_id) lacks, against the state
    (key, status, decided_at): history_only (nothing known of the key), older_than_current_decision,
    prior_exclusion_preserved, later_stage_preserved, superseded_in_batch or apply.

    Only the last event of a key that may be applied is; the others of the batch are superseded.
    """
    own = owner_of(events, ledger, state)
    by_id, by_key = [*own, "event_id"], [*own, "key"]
    fresh = events.join(ledger.select(*by_id).distinct(), by_id, "left_anti").dropDuplicates(by_id)
    met = fresh.join(state.select(*by_key, "status", "decided_at"), by_key, "left")
    outcome = (
        F.when(F.col("status").isNull(), "history_only")
        .when(F.col("event_at") < F.col("decided_at"), "older_than_current_decision")
        .when(F.col("status").isin("discarded", "skip"), "prior_exclusion_preserved")
        .when(~transition_allowed(F.col("status"), F.col("kind")), "later_stage_preserved")
        .otherwise("apply")
    )
    judged = met.select(*own, "event_id", "key", "kind", "event_at", outcome.alias("outcome"))
    last = judged.where("outcome = 'apply'").groupBy(*by_key).agg(F.max(F.struct("event_at", "event_id")).alias("l")).select(*by_key, F.col("l.event_id").alias("_last"))
    done = judged.join(last, by_key, "left")
    superseded = (F.col("outcome") == "apply") & (F.col("event_id") != F.col("_last"))
    return done.withColumn("outcome", F.when(superseded, "superseded_in_batch").otherwise(F.col("outcome"))).drop("_last")


def timeline(*parts: DataFrame) -> DataFrame:
    """Q8: union of (id, at, what) newest first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("id", F.desc("at"), "what")
