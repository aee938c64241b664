"""At-least-once delivery: keep exactly one copy of each message.

:func:`told_apart` routes every row by its identifier.

* A *sequence identifier* ends in a number that its producer counts up (``<prefix><digits>``, at most 18 digits; zero-padded numbers are a
  sequence of their own for each width). The numbers seen from one producer are kept as disjoint, merged ranges: a number inside a range was delivered
  before, an uncovered number is accepted once, by its first copy (:func:`accept_sequences`, :func:`merge_ranges`). A state of ranges is far smaller
  than a set of numbers, as producers count without large holes.
* Every other identifier (digests, free text, null) is *malformed* for that purpose and is resolved by exact keyed lookup (:func:`message_id`).

:func:`surplus` and :func:`keep_one` take a whole table, with or without ranges of what was seen before; :func:`accept_batch` takes one batch of a stream and
the state of all earlier ones, :func:`accept_all` a number of batches.  The table is read once: rows and their digests are stored in the shared folder.  Two
compact shuffles find the messages with more than one copy (hashes only, combined before the shuffle, so a group holding a third of all rows arrives as one
row per task); only rows of such messages are compared in full.  Where these meet the small tables of ids, a message with more than HOT copies is spread over
several tasks. No group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import shielded
from ..functions.instants import fixed
from ..session import cut, stored

SEQUENCE = r"^(.*?[^0-9a-fA-F])?([0-9]{1,18})$"
#: what identifies a message of `parsed_events` on its device if its key was lost
REST = ("kind", "device_ts_raw", "job_id", "state")
#: an id of more than HOT rows is joined in pieces of about half as many; the list of such ids is broadcast and never has more than HOT_IDS entries (4 MB), as on
#: tables of more than HOT x HOT_IDS rows an id is hot from that share of the rows on
HOT, HOT_IDS = 1 << 17, 100_000


def _digest(*cols: Column) -> Column:
    """128 bits that stand for the tuple, nulls told apart from empty text. Lengths make the encoding unambiguous."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in cols]
    return F.unhex(F.md5(F.concat(*parts)))


def natural_id(device="device_id", rest=REST) -> Column:
    """What identifies a message whose key was lost. Nulls equal nulls."""
    return _digest(F.col(device), *(F.col(c) for c in rest))


def _pieces(hot: int) -> Column:
    """In how many pieces an id of ``_n`` rows is joined."""
    return F.when(F.col("_n") > hot, F.ceil(F.col("_n") * 2 / hot)).otherwise(1)


def _spread(rows: DataFrame, key: str, counts: DataFrame, most: int) -> DataFrame:
    """`rows` with ``_s``, the piece they are joined in; `counts` (`key`, _n) tells hot ids, those of more than `most` rows.

    The piece depends on the number of the row in the stored table, so that exact repeats are spread, and a task that runs again gives the same.
    """
    hot = counts.where(F.col("_n") > most).select(key, _pieces(most).alias("_parts"))
    piece = F.pmod(F.xxhash64("_row"), F.col("_parts"))
    return rows.join(F.broadcast(hot), key, "left").withColumn("_s", F.coalesce(piece, F.lit(0).cast("bigint"))).drop("_parts")


def _for_all_pieces(small: DataFrame, most: int) -> DataFrame:
    """`small` (with ``_n``) once for each piece of its ids."""
    return small.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), (_pieces(most) - 1).cast("bigint")))).drop("_n")


def told_apart(df: DataFrame, key="dedupe_key", device="device_id", rest=REST) -> DataFrame:
    """Adds ``_producer`` and ``_seq`` (sequence identifiers; else null), ``_key`` (digest of the identifier; null where there is none) and ``_nid`` (natural id).

    Letter case of malformed identifiers has no meaning; equal identifiers of different producers are different messages.
    """
    text, ok = F.col(key).cast("string"), F.col("_ok")
    number, head = F.regexp_extract(text, SEQUENCE, 2), F.regexp_extract(text, SEQUENCE, 1)
    width = F.when(number.startswith("0") & (F.length(number) > 1), F.length(number)).otherwise(0)
    out = fixed(df, _ok=F.coalesce(text.rlike(SEQUENCE), F.lit(False)))  # the pattern is matched once
    out = out.withColumn("_producer", F.when(ok, F.struct(F.col(device).alias("p"), head.alias("s"), width.alias("w")))).withColumn("_seq", F.when(ok, number.cast("long")))
    odd = F.when(F.col(key).isNotNull(), _digest(F.col(device), F.lower(F.col(key))))
    told = F.when(ok, _digest(F.col(device), F.lit("#"), F.col("_producer.s"), F.col("_producer.w"), F.col("_seq"))).otherwise(odd)
    return out.withColumn("_key", told).withColumn("_nid", natural_id(device, rest)).drop("_ok")


def message_id(told: DataFrame, most: int = HOT) -> DataFrame:
    """Adds ``_mid`` to rows of :func:`told_apart`: the key, and for keyless rows the least key of a keyed row with the same natural id, else the natural id itself."""
    keyed, keyless = told.where(F.col("_key").isNotNull()), told.where(F.col("_key").isNull())
    wanted = keyless.groupBy("_nid").agg(F.count(F.lit(1)).alias("_n"))
    # Only natural ids that a keyless row asks for survive.
    found = keyed.select("_nid", F.hex("_key").alias("_k")).join(wanted, "_nid").groupBy("_nid").agg(F.unhex(F.min("_k")).alias("_found"), F.max("_n").alias("_n"))
    resolved = _spread(keyless, "_nid", wanted, most).join(_for_all_pieces(found, most), ["_nid", "_s"], "left").withColumn("_mid", F.coalesce("_found", "_nid"))
    return keyed.withColumn("_mid", F.col("_key")).unionByName(resolved.select(*told.columns, "_mid"))


def _ranked(df: DataFrame, columns, **ids) -> tuple[DataFrame, int]:
    """(`columns` of all rows with ``_mid``, ``_s`` (see :func:`_spread`) and ``_many``: null where the message has one copy; from how many rows on an id is hot). `df` is read once."""
    told = stored(told_apart(df, **ids).select(*dict.fromkeys(columns), "_key", "_nid", F.monotonically_increasing_id().alias("_row")))
    most = max(HOT, told.count() // HOT_IDS)
    rows = message_id(told, most)
    counts = rows.groupBy("_mid").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    many = _for_all_pieces(counts, most).withColumn("_many", F.lit(True))
    return _spread(rows, "_mid", counts, most).join(many, ["_mid", "_s"], "left"), most


def _first(copies: DataFrame, order: tuple[str, ...], most: int) -> DataFrame:
    """The least copy of each message by `order`, for each piece of it; combined before the shuffle. Null order values come first."""
    return _for_all_pieces(copies.groupBy("_mid").agg(F.min(F.struct(*order, "_row")).alias("_first"), F.count(F.lit(1)).alias("_n")), most)


@shielded
def surplus(df: DataFrame, order=("received_at", "path", "line_number"), seen: DataFrame | None = None, columns=None, **ids) -> DataFrame:
    """The rows that go: every copy but the first by `order`, and, where `seen` gives ranges of sequence numbers (_producer, lo, hi), every copy of those.

    Nulls: a null key is looked up by the natural id; nulls in it equal each other. Of copies that tie on all of `order`, exact repeats too, one stays.
    Empty input: empty result. `columns` (all by default) are those that come out.
    """
    columns = tuple(columns or df.columns)
    rows, most = _ranked(df, (*columns, *order), **ids)
    copies = stored(rows.where("_many").select(*dict.fromkeys((*columns, *order)), "_mid", "_s", "_row"))
    out = copies.join(_first(copies, order, most), ["_mid", "_s"]).where(F.col("_row") != F.col("_first._row")).select(*columns)
    if seen is None:
        return out
    kept = keep_one(df, order, **ids)
    told = told_apart(kept, **ids).where("_seq is not null")
    return out.unionByName(_covered(told, seen, "left_semi").select(*columns))


@shielded
def keep_one(df: DataFrame, order=("received_at", "path", "line_number"), seen: DataFrame | None = None, columns=None, **ids) -> DataFrame:
    """The rows that stay, exactly one for each message (see :func:`surplus`)."""
    columns = tuple(columns or df.columns)
    if seen is not None:
        told = told_apart(keep_one(df, order, **ids), **ids)
        return told.where("_seq is null").select(*columns).unionByName(_covered(told.where("_seq is not null"), seen, "left_anti").select(*columns))
    rows, _ = _ranked(df, (*columns, *order), **ids)
    single = rows.where(F.col("_many").isNull()).select(*columns)
    copies = rows.where("_many").drop("_many")
    best = copies.groupBy("_mid").agg(F.min_by(F.struct(*columns), F.struct(*order, "_row")).alias("_best")).select("_best.*")
    return single.unionByName(best)


# --- sequence identifiers ----------------------------------------------------------------------------------------------------------------


BLOCK = 1 << 16  #: ranges are kept within blocks of so many numbers


def merge_ranges(numbers: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_producer, lo, hi) of disjoint ranges from rows (_producer, lo, hi), overlapping or touching ones merged.

    Ranges are cut at multiples of `block` and merged within (producer, block), so that a producer with a third of all numbers is spread; a
    range of the state thus never spans two blocks, and lookups meet it by equality of block.
    """
    from pyspark.sql import Window as W

    cutup = numbers.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block)))).select(
        "_producer", "_b", F.greatest("lo", F.col("_b") * block).alias("lo"), F.least("hi", F.col("_b") * block + block - 1).alias("hi")
    ).distinct()
    w = W.partitionBy("_producer", "_b").orderBy("lo", "hi")
    new = F.when(F.col("lo") > F.coalesce(F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(-(1 << 62))), 1).otherwise(0)
    isle = cutup.withColumn("_new", new).withColumn("_isle", F.sum("_new").over(w))
    return isle.groupBy("_producer", "_b", "_isle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("_producer", "lo", "hi")


def _covered(numbered: DataFrame, seen: DataFrame, how: str, block: int = BLOCK) -> DataFrame:
    """Rows (_producer, _seq) whose number lies in a range of `seen` ('left_semi') or in none ('left_anti')."""
    rows = numbered.withColumn("_b", F.floor(F.col("_seq") / block))
    blocks = seen.select(F.col("_producer").alias("_p"), "lo", "hi", F.floor(F.col("lo") / block).alias("_rb"))
    hit = rows._producer.eqNullSafe(F.col("_p")) & (F.col("_b") == F.col("_rb")) & F.col("_seq").between(F.col("lo"), F.col("hi"))
    return rows.join(blocks, hit, how).drop("_b")


def accept_sequences(batch: DataFrame, seen: DataFrame, order=("received_at", "path", "line_number"), block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """One batch of sequence identifiers (:func:`told_apart`): (accepted rows, new state). `seen` holds (_producer, lo, hi)."""
    first = batch.groupBy("_producer", "_seq").agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_row")).select("_row.*")
    fresh = _covered(first, seen, "left_anti", block)
    state = merge_ranges(seen.select("_producer", "lo", "hi").unionByName(fresh.select("_producer", F.col("_seq").alias("lo"), F.col("_seq").alias("hi"))), block)
    return fresh, state


@shielded
def accept_batch(batch: DataFrame, seen: DataFrame, known: DataFrame, key: str, producer: str, order=("received_at", "path", "line_number"), rest=REST, columns=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch of a stream with identifiers of any kind: (accepted rows, new ranges, new ids). Each message is accepted once over all batches.

    `seen` holds the ranges (_producer, lo, hi), `known` the digests (_key, _nid) of key and natural id of all earlier messages; the third result
    is to be added to it. A null key is looked up by the natural id (`producer` and `rest`): a row whose natural id is known goes, else it belongs to the
    least key of its batch with that natural id, else it stands for itself. If a message was accepted without a key, the first key to come with its
    natural id (the least one in a batch) is its own, and goes. `columns` (all by default) are those that come out.
    """
    out = tuple(columns or batch.columns)
    cols = list(dict.fromkeys((*out, *order)))
    rows = stored(told_apart(batch, key, producer, rest).select(*cols, "_producer", "_seq", "_key", "_nid"))
    keyed, bare = rows.where("_key is not null"), rows.where("_key is null").select(*cols, "_nid")
    least = keyed.join(bare.select("_nid").distinct(), "_nid", "left_semi").groupBy("_nid").agg(F.min(F.struct("_key", "_producer", "_seq")).alias("_least"))
    bare = bare.join(known.select("_nid").distinct(), "_nid", "left_anti").join(least, "_nid", "left").select(*cols, "_nid", "_least.*")
    told = keyed.unionByName(bare)

    numbered, ranges = accept_sequences(told.where("_seq is not null"), seen, order)
    other = told.where("_seq is null")
    first = other.groupBy("_key", F.when(F.col("_key").isNull(), F.col("_nid")).alias("_own")).agg(F.min_by(F.struct(*other.columns), F.struct(*order)).alias("_row")).select("_row.*")
    exact = first.join(known.select("_key").distinct(), "_key", "left_anti")

    waiting = known.groupBy("_nid").agg(F.count("_key").alias("_n")).where("_n = 0").select("_nid")
    late = keyed.join(waiting, "_nid", "left_semi").groupBy("_nid").agg(F.min("_key").alias("_key")).select("_key").distinct()
    fresh = numbered.unionByName(exact).join(late, "_key", "left_anti").select(*out)
    return fresh, ranges, told.select("_key", "_nid").distinct().join(known, ["_key", "_nid"], "left_anti")


RANGES, IDS = "_producer struct<p:string,s:string,w:int>, lo bigint, hi bigint", "_key binary, _nid binary"


def accept_all(batches: list[DataFrame], key: str, producer: str, order=("received_at", "path", "line_number"), rest=REST, columns=None) -> DataFrame:
    """The accepted rows of several batches, one after the other, as a stream would accept them."""
    spark = batches[0].sparkSession
    seen, known, out = spark.createDataFrame([], RANGES), spark.createDataFrame([], IDS), None
    for k, batch in enumerate(batches):
        fresh, ranges, ids = accept_batch(batch, seen, known, key, producer, order, rest, columns)
        if k + 1 < len(batches):
            seen, known = cut(ranges), cut(known.unionByName(ids))
        out = fresh if out is None else out.unionByName(fresh)
    return out
