"""Versioned dimension merge: changes fold into versions slice by slice, with placeholders for what a slice inherits.

A slice is a week of one key. It is folded by itself, where attributes that it hasn't set are placeholders; a chain of
slice summaries, as long as the key has slices, says what each slice starts from; a join puts that in, and versions
that go on over a boundary are stitched. A week of a key with very many changes is cut into up to MOST_PARTS slices, so
no slice holds more than a small share of all rows and no chain grows with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, plain_names, table

SECOND = 1_000_000
WEEK = 604_800 * SECOND
#: A week of a key with more instants than PART_ROWS is cut, into MOST_PARTS slices at most.
PART_ROWS = 1_000
MOST_PARTS = 64
_CELL = 60 * SECOND


def micros(df: DataFrame, col: str) -> Column:
    """A time as microseconds since 1970; one without a zone is UTC, whatever the session's zone."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(f"`{col}`").cast("timestamp"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join on keys where null equals null; the keys come from the left."""
    named = right.select(*[F.col(c).alias(f"r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(named[f"r_{c}"]) for c in keys]
    return left.join(named, on, how).drop(*[f"r_{c}" for c in keys])


def _instants(changes: DataFrame) -> DataFrame:
    """(k, t, won, n, again) of (k, c, s, o, t, a): one row for each instant of a key.

    won: (seq, op, attributes) of the change that holds there, null if all were dropped. n: change ids seen there for
    the first time. again: for ids that an earlier instant had, when it was.
    """
    # Rows without an id or a seq equal no other; a number of their own keeps them out of one large group.
    own = lambda test: F.when(test, F.xxhash64("c", "s", "o", "t", "a")).otherwise(F.lit(0).cast("bigint"))
    rows = changes.where("t IS NOT NULL").withColumn("x", own(F.col("c").isNull()))
    rows = rows.groupBy("k", "c", "x").agg(F.sort_array(F.collect_set(F.struct("t", "s", "o", "a"))).alias("r"))
    rows = rows.select("k", "c", "r", F.posexplode("r").alias("pos", "e"))
    rows = rows.select("k", "c", "e.*", F.when(F.col("pos") > 0, F.get("r", F.col("pos") - 1)["t"]).alias("before"))
    known = F.coalesce(F.col("o").isin("D", "I", "U"), F.lit(False))
    first = Window.partitionBy("k", "s", "y").orderBy(F.desc("known"), F.asc_nulls_last("c"), "t", "o", "a")
    rows = rows.withColumn("known", known).withColumn("y", own(F.col("s").isNull())).withColumn("nth", F.row_number().over(first))
    won = F.when((F.col("nth") == 1) & F.col("known"), F.struct("s", (-F.col("c")).alias("nc"), "o", "a"))
    there = F.col("c").isNotNull()
    return rows.groupBy("k", "t").agg(
        F.max(won).alias("won"), F.count_if(there & F.col("before").isNull()).alias("n"), F.collect_list(F.when(there, F.col("before"))).alias("again")
    )


def _sliced(instants: DataFrame, slice_micros: int) -> DataFrame:
    """instants with z, the number of their slice, rising with time. Weeks of many instants are cut by a histogram of their minutes."""
    at = lambda unit: F.floor(F.col("t") / F.lit(unit)) if unit == 1 else F.expr(f"t div {unit} - CAST(t % {unit} < 0 AS BIGINT)")
    rows = instants.withColumn("w", at(slice_micros)).withColumn("m", at(_CELL))
    week = Window.partitionBy("k", "w")
    cells = rows.groupBy("k", "w", "m").agg(F.count("*").alias("of"))
    cells = cells.withColumn("all", F.sum("of").over(week)).where(F.col("all") > PART_ROWS)
    cells = cells.withColumn("sofar", F.sum("of").over(week.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)) - F.col("of"))
    parts = F.least(F.lit(MOST_PARTS), F.expr(f"`all` div {PART_ROWS} + 1"))
    cells = cells.select("k", "w", "m", F.floor(F.col("sofar") * parts / F.col("all")).alias("part"))
    out = _same(rows, cells, ["k", "w", "m"], "left")
    return out.select("k", "t", "won", "n", "again", (F.col("w") * MOST_PARTS + F.coalesce("part", F.lit(0))).alias("z"))


def versions(changes: DataFrame, key: str, attributes: Sequence[str], inherit: bool = True, slice_micros: int = WEEK) -> DataFrame:
    """(key, version, from_at, to_at, is_deleted, attributes, first_seq, n_changes) of changes (key, change_id, seq, op, at, attributes).

    at is in microseconds; rows without it are left out and equal rows count once. Of a key's rows of equal seq that of
    the least change_id stays, then at equal `at` that of the greatest seq. D deletes: attributes are null. I sets all
    attributes. U sets them too; with `inherit` its nulls leave an attribute as it was since the last D or I, without
    they stay null. Equal states that follow each other are one version, which ends where the next begins (to_at is
    null for the last). n_changes counts the distinct change ids, those of dropped rows too, from from_at to before to_at.

    Nulls: a null key is a key of its own; a null seq equals no other, ranks below all and then by change_id; a null
    change_id comes after all others and isn't counted; any other op, or none, sets nothing but is counted. Rows before
    a key's first state are in no version. No rows give no rows; other columns are left out.
    """
    named = [F.col(f"`{key}`").alias("k"), F.col("change_id").alias("c"), F.col("seq").alias("s"), F.col("op").alias("o"), F.col("at").cast("bigint").alias("t")]
    states = [f"v{i}" for i in range(len(attributes) + 1)]
    rows = changes.select(*named, F.struct(*[F.col(f"`{a}`").alias(v) for a, v in zip(attributes, states[1:])]).alias("a"))
    rows = checkpointed(_sliced(_instants(rows), slice_micros))

    # Fold of each slice by itself: a null v is a placeholder, a struct holds what was set.
    op, slice_ = F.col("won.o"), Window.partitionBy("k", "z").orderBy("t")
    whole = op.isin("D", "I") if inherit else op.isNotNull()
    set_to = [F.when(op.isNotNull(), F.struct((op == "D").alias("x")))]
    for v in states[1:]:
        value = F.when(op != "D", F.col(f"won.a.{v}"))
        set_to.append(F.when(op.isNotNull() & (whole | value.isNotNull()), F.struct(value.alias("x"))))
    folded = rows.select("k", "z", "t", "won", "n", "again", *[F.last(x, True).over(slice_.rowsBetween(Window.unboundedPreceding, 0)).alias(v) for v, x in zip(states, set_to)])
    ends = folded.groupBy("k", "z").agg(F.max_by(F.struct(*states), "t").alias("end"))
    earlier = Window.partitionBy("k").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    chain = ends.select("k", "z", *[F.last(F.col(f"end.{v}"), True).over(earlier).alias(f"in_{v}") for v in states])

    # Placeholders take what the chain says; a row begins a version where its state isn't that before it.
    full = _same(folded, chain, ["k", "z"], "left")
    state = F.struct(*[F.coalesce(v, f"in_{v}")["x"].alias(v) for v in states])
    full = full.select("k", "z", "t", "won", "n", "again", state.alias("state"), F.struct(*[F.col(f"in_{v}")["x"].alias(v) for v in states]).alias("came"))
    before = F.coalesce(F.lag("state").over(slice_), F.col("came"))
    full = full.withColumn("begins", F.col("won").isNotNull() & ~F.col("state").eqNullSafe(before))
    full = full.withColumn("i", F.sum(F.col("begins").cast("int")).over(slice_.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = full.groupBy("k", "z", "i").agg(
        F.min("t").alias("t"), F.max(F.when(F.col("begins"), F.col("state"))).alias("state"), F.max(F.when(F.col("begins"), F.col("won.s"))).alias("first_seq"),
        F.sum("n").alias("n"), F.flatten(F.collect_list("again")).alias("again"),
    )
    pieces = checkpointed(pieces.withColumn("next", F.lead("t").over(Window.partitionBy("k", "z").orderBy("i"))))

    # A second chain numbers the versions and says where the one that goes on began, and where it ends.
    began = F.when(F.col("i") > 0, F.col("t"))
    sums = pieces.groupBy("k", "z").agg(F.max("i").alias("starts"), F.min(began).alias("first"), F.max(began).alias("last"))
    later = Window.partitionBy("k").orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("k", "z", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("base"), F.last("last", True).over(earlier).alias("since"), F.last("first", True).over(later).alias("until"))
    done = _same(pieces, sums, ["k", "z"], "left").withColumn("version", (F.col("base") + F.col("i")).cast("int")).where("version > 0")
    done = done.withColumn("from", F.when(F.col("i") > 0, F.col("t")).otherwise(F.col("since")))
    fresh = F.col("n") + F.size(F.filter("again", lambda t: t < F.col("from")))
    done = done.groupBy("k", "version").agg(
        F.max("from").alias("from_at"), F.max(F.coalesce("next", "until")).alias("to_at"), F.max("state").alias("state"), F.max("first_seq").alias("first_seq"), F.sum(fresh).alias("n_changes")
    )
    out = [F.col(f"state.{v}").alias(a) for v, a in zip(states, ["is_deleted", *attributes])]
    return done.select(F.col("k").alias(key), "version", "from_at", "to_at", *out, "first_seq", "n_changes")


def op13_dimension_merge(spark, sf_dir: str) -> DataFrame:
    """The versions of all clients. Times of changes whose crc32 is divisible by 3 move 240 hours back; nulls of updates stay null."""
    raw = plain_names(table(spark, sf_dir, "client_changes"), ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"])
    moved = F.coalesce(F.crc32(F.col("change_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    cents = F.floor(100 * F.col("balance") + 0.5)
    rows = raw.select(
        "client_id", "change_id", "seq", "op", (micros(raw, "valid_at") - F.when(moved, 240 * 3600 * SECOND).otherwise(0)).alias("at"), "source", "segment", "city",
        F.when(F.abs("balance") < 9e16, cents).alias("balance_cents"),
    )
    out = versions(rows, "client_id", ["source", "segment", "city", "balance_cents"], inherit=False)
    seconds = lambda c: F.floor(F.col(c) / SECOND)
    return out.select("client_id", "version", seconds("from_at").alias("valid_from"), seconds("to_at").alias("valid_to"), "is_deleted", "source", "segment", "city", "balance_cents", "first_seq", "n_changes")


# crc32 of decimal text, byte by byte, over a table made by its rule.
CRC_SQL = """crc_table AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) r(n)))"""


def crc_sql(text: str, codes: str = "t") -> str:
    return f"xor(list_reduce([CAST(ord(x) AS BIGINT) FOR x IN string_split({text}, '')], lambda c, b: xor(c >> 8, {codes}[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


SQL = f"""WITH {CRC_SQL},
seen AS (
  SELECT DISTINCT change_id, client_id, seq, op, source, segment, city, CAST(floor(100 * balance + 0.5) AS BIGINT) AS cents, balance,
    CAST(epoch(valid_at) AS BIGINT) - CASE WHEN {crc_sql("CAST(change_id AS VARCHAR)")} % 3 = 0 THEN 864000 ELSE 0 END AS moment
  FROM client_changes, crc_table WHERE valid_at IS NOT NULL
),
one AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY client_id, seq ORDER BY change_id) = 1),
kept AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY client_id, moment ORDER BY seq DESC) = 1),
states AS (
  SELECT client_id, moment, seq, op = 'D' AS is_deleted, CASE WHEN op <> 'D' THEN source END AS source, CASE WHEN op <> 'D' THEN segment END AS segment,
    CASE WHEN op <> 'D' THEN city END AS city, CASE WHEN op <> 'D' THEN cents END AS balance_cents FROM kept
),
changed AS (
  SELECT *, row(is_deleted, source, segment, city, balance_cents) IS DISTINCT FROM lag(row(is_deleted, source, segment, city, balance_cents)) OVER (PARTITION BY client_id ORDER BY moment) AS begins FROM states
),
spans AS (
  SELECT *, row_number() OVER w AS version, lead(moment) OVER w AS valid_to FROM changed WHERE begins WINDOW w AS (PARTITION BY client_id ORDER BY moment)
)
SELECT s.client_id, CAST(s.version AS INTEGER) AS version, s.moment AS valid_from, s.valid_to, s.is_deleted, s.source, s.segment, s.city, s.balance_cents, s.seq AS first_seq, count(DISTINCT c.change_id) AS n_changes
FROM spans s JOIN seen c ON c.client_id IS NOT DISTINCT FROM s.client_id AND c.moment >= s.moment AND (s.valid_to IS NULL OR c.moment < s.valid_to)
GROUP BY ALL"""
