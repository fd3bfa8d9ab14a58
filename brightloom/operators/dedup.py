"""Seen-before logic: anti-joins against history, first-wins, the url-and-role fixpoint, indexes and state upserts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.functions.scope import owner_of
from brightloom.functions.text import company_key, dedup_url, role_key, stable_id


def _set_checkpoint_folder(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut df's lineage in the folder that the session names; a local session without one gets its own."""
    _set_checkpoint_folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df by way of a packed table in the checkpoint folder: half the disk of a checkpoint, and the planner knows its size.
    It is left to the folder's own expiry."""
    _set_checkpoint_folder(df)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is a shuffle. The planner knows files by their packed size and exploded rows by what
    they came from, and would send millions of such rows through the driver as a broadcast."""
    return df.hint("merge")


def _url_key(url: Column) -> Column:
    """dedup_url as a join key that is never null: for a nullable key Spark would filter on it first and make it twice."""
    return F.coalesce(dedup_url(url), F.lit("\u0000"))


def anti_seen_urls(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose normalised url is none of those of seen (column url)."""
    own = owner_of(df, seen)
    keys = seen.where("url IS NOT NULL").select(*own, _url_key(F.col("url")).alias("_seen")).distinct()
    return df.withColumn("_seen", _url_key(F.col("url"))).join(keys, [*own, "_seen"], "left_anti").select(*df.columns)


def anti_seen_roles(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose company and role keys were not seen (columns company, title); blank keys never match."""
    own = owner_of(df, seen)
    keyed = lambda t: t.withColumns({"_c": company_key(F.col("company")), "_r": role_key(F.col("title"))})
    keys = keyed(seen).select(*own, "_c", "_r").where("_c <> '' AND _r <> ''").distinct()
    return keyed(df).join(keys, [*own, "_c", "_r"], "left_anti").select(*df.columns)


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """W2, one key: the first row of each key in order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """W2, one key, for keys that may be hot: the least row by order, combined before the shuffle. order must be total."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


#: Rows of a broadcast that marks keys by a bit of their hash, 64 bits a row.
MARK_ROWS = 1 << 20

#: Rounds whose rows are kept in tables of their own, so that many rounds make no long plan.
ROUNDS = 16


def _digests(df: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, list[str]]:
    """df's order as o and each key as a 128-bit digest, whatever its length, in a table of their own; and the digests' names."""
    own, names = owner_of(df), [f"k{i}" for i in range(len(keys))]
    keyed = lambda k: F.when(F.col(k).isNotNull(), F.unhex(F.md5(F.to_json(F.struct(*own, F.col(k).alias("key"))))))
    return written(df.select(F.col(order).alias("o"), *[keyed(k).alias(n) for k, n in zip(keys, names)])), names


def _with_key(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull())


def _least(rows: DataFrame, name: str) -> DataFrame:
    """The first row of each key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in ("o", name)]
    return _with_key(rows, name).groupBy(name).agg(F.min(F.struct("o", *rest)).alias("row")).select(*[name if c == name else f"row.{c}" for c in rows.columns])


def _marked(rows: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """rows whose key has the mark of one of asked's: all that have such a key, and of a million asked some 1.5 % of the others.
    What is broadcast has up to MARK_ROWS rows, however many are asked."""
    place = lambda n: F.xxhash64(n).bitwiseAND(MARK_ROWS - 1)
    mark = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(n), 40).bitwiseAND(63).cast("int"))
    marks = asked.groupBy(place(name).alias("place")).agg(F.bit_or(mark(name)).alias("marks"))
    return rows.join(F.broadcast(marks), place(name) == F.col("place")).where(F.col("marks").bitwiseAND(mark(name)) != 0).select(*rows.columns)


def _accepted_of_two(rows: DataFrame, asks: str, holds: str) -> DataFrame:
    """o of the accepted rows of two keys, as in a stable matching: each key `asks` asks with its first row, each key `holds`
    keeps the first that it is asked with, and a key that is refused asks with its next row. What is refused is refused for
    good, as a row held only gives way to earlier ones; so only first rows move, and rows of keys that were refused.

    Rows that come after the one held of their key are not asked with, so there are no more rounds than in
    _accepted_in_rounds; but each looks for rows of refused keys in the whole table.
    """
    columns = rows.columns
    alone = rows.where(F.col(asks).isNull() & F.col(holds).isNull()).select("o")
    asked = written(_least(rows, asks).union(rows.where(F.col(asks).isNull() & F.col(holds).isNotNull())))
    held, kept, left = None, [], []
    while True:
        now = written(_least(asked, holds).union(asked.where(F.col(holds).isNull())))
        kept.append(now)
        refused = _with_key(asked, asks).join(_with_key(now, asks).select(asks), asks, "left_anti").select(*columns)
        if held is not None:
            gave_way = written(held.join(_with_key(now, holds).select(holds), holds, "left_semi").select(*columns))
            left.append(gave_way.select("o"))
            refused = refused.union(_with_key(gave_way, asks))
        refused = written(refused.select(asks, F.col("o").alias("after")))
        undecided = written(_marked(_with_key(rows, asks), refused, asks).join(dealt(refused), asks).where("o > after").select(*columns))
        if undecided.isEmpty():
            break
        if len(kept) > ROUNDS:
            kept, left = [kept[0], written(reduce(DataFrame.union, kept[1:]))], [written(reduce(DataFrame.union, left))]
        open_keys = _with_key(undecided, holds)
        held = written(_least(_marked(_with_key(reduce(DataFrame.union, kept), holds), open_keys, holds), holds))
        before = held.select(F.col(holds).alias("key"), F.col("o").alias("first"))
        late = (F.col(holds) == F.col("key")) & (F.col("first") < F.col("o"))
        live = undecided.where(F.col(holds).isNull()).union(open_keys.join(before, late, "left_anti"))
        asked = checkpointed(_least(live, asks))
    found = reduce(DataFrame.union, kept).select("o")
    return alone.union(found.join(reduce(DataFrame.union, left), "o", "left_anti") if left else found)


def _accepted_in_rounds(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """o of the accepted rows. Each round accepts the rows that come first on all their keys among those undecided, and
    rejects those that share a key with an accepted one. Rounds are bounded by the longest chain of rows in which each
    waits for the one before.

    The first row of each key is combined before its shuffle, so what is undecided is only shuffled to reject, and not
    again for a key once it is gone by another.
    """
    asked = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    accepted, open_rows = [rows.where(asked == 0).select("o")], rows.where(asked > 0)
    while True:
        firsts = [open_rows.where(F.col(n).isNotNull()).groupBy(n).agg(F.min(F.struct("o", *names)).alias("row")).select("row") for n in names]
        met = reduce(DataFrame.union, firsts).groupBy("row").agg(F.count("*").alias("n")).select("row.*", "n")
        now = checkpointed(met.where(F.col("n") == asked).select("o", *names))
        if now.isEmpty():
            break
        accepted.append(now.select("o"))
        if len(accepted) > ROUNDS:
            accepted = [checkpointed(reduce(DataFrame.union, accepted))]
        rest = open_rows
        for n in names:
            # rows without the key would all be dealt to one task; up to eight bytes are no digest
            at = F.coalesce(n, F.unhex(F.hex(F.xxhash64("o"))))
            rest = rest.withColumn("at", at).join(now.where(F.col(n).isNotNull()).select(F.col(n).alias("at")).distinct(), "at", "left_anti")
        open_rows = checkpointed(rest.select("o", *names))
    return reduce(DataFrame.union, accepted)


def _accepted(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(names) != 2:
        return _accepted_in_rounds(rows, names)
    # whichever has fewer asks, as its first rows are what moves; a row without the key asks for itself
    many = rows.agg(*[(F.approx_count_distinct(n) + F.count_if(F.col(n).isNull())).alias(n) for n in names]).first()
    return _accepted_of_two(rows, *sorted(names, key=lambda n: many[n]))


def accept_in_order(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """W2, several keys: df with accepted, as if rows came one by one in order (unique), and each were accepted unless
    an earlier accepted row of its owner has one of its keys. A rejected row marks nothing. Null keys never match."""
    found = _accepted(*_digests(df, keys, order)).withColumn("accepted", F.lit(True))
    return df.join(found, df[order] == found["o"], "left").drop("o").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def verdicts_in_order(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """W2, several keys: (order, accepted) as accept_in_order has them, one row for each order; a row may be repeated in df.
    df is read once."""
    rows, names = _digests(df, keys, order)
    both = rows.select("o", F.lit(False).alias("accepted")).union(_accepted(rows, names).select("o", F.lit(True)))
    return both.groupBy(F.col("o").alias(order)).agg(F.max("accepted").alias("accepted"))


def append_history(new: DataFrame, history: DataFrame, active: Column) -> DataFrame:
    """K1: the rows of new (url, status, pos, ...) to append: first of each normalised url and status, unless the history
    has an active row (condition active on history) of both."""
    own = owner_of(new, history)
    seen = history.where(active).where("url IS NOT NULL").select(*own, _url_key(F.col("url")).alias("_key"), "status").distinct()
    fresh = new.withColumn("_key", _url_key(F.col("url"))).join(seen, [*own, "_key", "status"], "left_anti")
    return first_per_key(fresh, [*own, "_key", "status"], F.col("pos")).drop("_key")


#: What posting_index returns besides the two ids.
INDEX_COLUMNS = ("url", "first_seen", "portal", "company_key", "role_key", "status", "pos")


def posting_index(history: DataFrame, columns: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """K3: index rebuilt from history: the first row by pos of each listing id (of each owner), with those of INDEX_COLUMNS
    that are asked for and both ids. What is not asked for is not shuffled."""
    own = owner_of(history)
    asked = [c for c in ("url", "first_seen", "portal", "status") if c in columns]
    # the id stands for its url in the shuffle, in half its letters; a null url has none
    listing = F.unhex(F.substr(F.sha2(dedup_url(F.col("url")), 256), F.lit(1), F.lit(20)))
    rows = history.select(*own, listing.alias("_id"), *asked, "company", "title", "pos")
    # keys are made from what the first row has, once for each id and after the shuffle
    first = first_per_key(rows, [*own, "_id"], F.col("pos")).withColumns({"company_key": company_key(F.col("company")), "role_key": role_key(F.col("title"))})
    ids = {"listing_instance_id": F.concat(F.lit("li_"), F.lower(F.hex("_id"))), "posting_cluster_id": stable_id("pc_", F.concat_ws("::", "company_key", "role_key"))}
    return first.withColumns(ids).select(*own, *[c for c in INDEX_COLUMNS if c in columns], *ids)


def append_posting_index(new: DataFrame, index: DataFrame, columns: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """K2: rows of posting_index(new) whose listing id the index doesn't have."""
    keys = [*owner_of(new, index), "listing_instance_id"]
    return posting_index(new, columns).join(index.select(*keys).distinct(), keys, "left_anti")


def sanitize_tsv(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tabs and line breaks become blanks; a cell that begins like a formula gets a quote in front."""
    def clean(c: str) -> Column:
        flat = F.trim(F.regexp_replace(F.col(c), r"[\t\r\n]+", " "))
        return F.when(flat.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), flat)).otherwise(flat)

    return df.withColumns({c: clean(c) for c in columns})


def upsert_state(state: DataFrame, updates: DataFrame) -> DataFrame:
    """K9: state (url, at, n) with updates (url, at): the later time, and the count of all times a url was updated."""
    keys = [*owner_of(state, updates), "url"]
    new = updates.groupBy(*keys).agg(F.max("at").alias("new_at"), F.count("*").alias("more"))
    return state.join(new, keys, "full").select(*keys, F.greatest("at", "new_at").alias("at"), (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))


def history_metadata(history: DataFrame) -> DataFrame:
    """First and last time that a normalised url was seen, and how often."""
    return history.groupBy(*owner_of(history), dedup_url(F.col("url")).alias("url_key")).agg(F.min("first_seen").alias("first_seen"), F.max("first_seen").alias("last_seen"), F.count("*").alias("n"))


def latest_state(df: DataFrame, key: str, at: list[str]) -> DataFrame:
    """The latest row of each key, by at."""
    keys = [*owner_of(df), key]
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_row")).select(*keys, "_row.*")


def dedup_feed(df: DataFrame, source: str, row_id: str, url: str, order: str) -> DataFrame:
    """Within a source, the first row of each id (url where the id is null)."""
    keyed = df.withColumn("_id", F.coalesce(F.col(row_id).cast("string"), F.col(url)))
    return first_per_key(keyed, [source, "_id"], F.col(order)).drop("_id")


def open_only(df: DataFrame, status: str) -> DataFrame:
    """Rows whose status is exactly active; a missing status is no pass here."""
    return df.where(F.lower(F.trim(status)) == "active")


def collect_offices(df: DataFrame, posting: str, office: str) -> DataFrame:
    """The distinct offices of each posting in alphabetical order, joined by comma."""
    return df.where(F.trim(office) != "").groupBy(posting).agg(F.array_join(F.array_sort(F.collect_set(office)), ", ").alias("location"))
