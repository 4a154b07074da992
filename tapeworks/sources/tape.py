"""Order-book views of the bundled tables, by integer arithmetic only.

`events` becomes a tape of file-style messages and, row by row, a synthetic three-level book; `lineitem`
becomes a tape of trades; the events of a user become a point-process path. Every function here has its
SQL twin in `CTES`, which the oracles use. Clocks do not depend on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How many users make a session, so that sessions grow in number with the data and not in length, and how deep
#: the synthetic book is.
USERS, DEPTH = 3, 3
HOUR_NS = 3_600_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    i = ts - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), i).cast("long")
    seconds = (part("DAY") * 24 + part("HOUR")) * 3600 + part("MINUTE") * 60
    return seconds * 1_000_000 + F.round(F.extract(F.lit("SECOND"), i) * 1_000_000).cast("long")


def messages_of(events: DataFrame, session: Column, *keep: Column | str) -> DataFrame:
    """(session_id, seq, ts_ns, event_id, type, size, price, direction) of file-style messages, with the columns to keep."""
    kind = (
        F.when(F.col("event_type") == "click", 2)
        .when(F.col("event_type") == "error", 3)
        .when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 7 == 0, 5).otherwise(4))
        .otherwise(1)
    )
    # The session comes first, so that numbering and every later window share one partitioning.
    return events.withColumn("session_id", session).select(
        "session_id",
        F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")).cast("long").alias("seq"),
        (F.floor(micros(F.col("ts")) / 3_600_000_000).cast("long") * HOUR_NS).alias("ts_ns"),
        "event_id",
        kind.cast("int").alias("type"),
        (10 * (1 + F.col("event_id") % 30)).alias("size"),
        (100 * (1000 + F.floor("value").cast("long") % 20)).alias("price"),
        F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("direction"),
        *keep,
    )


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of all events, some users a session."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return messages_of(e, F.expr(f"user_id div {USERS}"))


def with_book(rows: DataFrame) -> DataFrame:
    """Adds the synthetic book (asks, bids) that belongs to each event id."""
    e = F.col("event_id")
    pb = 1000 + (e * 7) % 5
    pa = pb + 1 + e % 3

    def side(base: Column, sign: int, shift: int, few: int, none: int) -> Column:
        off, rows_ = F.lit(0).cast("long"), []
        for k in range(1, DEPTH + 1):
            if k > 1:
                off = off + 1 + (e * k) % 3
            rows_.append(F.struct((base + sign * off).alias("price"), (10 * (1 + (e * (k + shift)) % 50)).alias("size")))
        whole = F.array(*rows_)
        return F.when(e % none == 0, F.slice(whole, 1, 0)).when(e % few == 0, F.slice(whole, 1, 1)).otherwise(whole)

    return rows.withColumns({"asks": side(pa, 1, 3, 11, 97), "bids": side(pb, -1, 5, 13, 89)})


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, ts_ns, event_id, asks, bids)."""
    return with_book(tape(spark, sf_dir).select("session_id", "seq", "ts_ns", "event_id"))


def tape_with_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_book(tape(spark, sf_dir))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, ts_ns, volume, signed, value) from line items; value in cents."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "session_id")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    volume = F.col("l_quantity").cast("long")
    return li.select(
        "session_id",
        F.row_number().over(Window.partitionBy("session_id").orderBy(*order)).cast("long").alias("seq"),
        (micros(F.col("l_shipdate")) * 1000).alias("ts_ns"),
        volume.alias("volume"),
        F.when(F.col("l_returnflag") == "R", -volume).otherwise(volume).alias("signed"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, n, t, type): each user's events as a point process, t in hours since its first event."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4).otherwise(0)
    us = micros(F.col("ts"))
    first = F.min(us).over(Window.partitionBy("user_id"))
    return e.select(F.col("user_id").alias("path_id"), F.row_number().over(w).cast("long").alias("n"), ((us - first) / F.lit(3.6e9)).alias("t"), kind.alias("type"))


# The same views in DuckDB SQL. bk has a column a level instead of arrays.
_LEVEL = {
    "a": ("pa + {off}", "10 * (1 + (e * ({k} + 3)) % 50)", 97, 11),
    "b": ("pb - ({off})", "10 * (1 + (e * ({k} + 5)) % 50)", 89, 13),
}


def _bk() -> str:
    out = []
    for s, (price, size, none, few) in _LEVEL.items():
        for k in range(1, DEPTH + 1):
            off = " + ".join(["0"] + [f"1 + (e * {j}) % 3" for j in range(2, k + 1)])
            gone = f"e % {none} = 0" + (f" OR e % {few} = 0" if k > 1 else "")
            out += [f"CASE WHEN {gone} THEN NULL ELSE {price.format(off=off)} END AS {s}p{k}", f"CASE WHEN {gone} THEN NULL ELSE {size.format(k=k)} END AS {s}s{k}"]
    return ", ".join(out)


CTES = {
    "tape": f"""tape AS (
        SELECT user_id // {USERS} AS session_id, row_number() OVER (PARTITION BY user_id // {USERS} ORDER BY ts, event_id) AS seq,
            (epoch_us(ts) // 3600000000) * {HOUR_NS} AS ts_ns, event_id AS e,
            CAST(CASE event_type WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN CASE WHEN event_id % 7 = 0 THEN 5 ELSE 4 END ELSE 1 END AS INTEGER) AS type,
            10 * (1 + event_id % 30) AS size, 100 * (1000 + CAST(floor(value) AS BIGINT) % 20) AS price,
            CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS direction
        FROM events)""",
    "bk": f"""tp AS (SELECT *, 1000 + (e * 7) % 5 AS pb, 1000 + (e * 7) % 5 + 1 + e % 3 AS pa FROM tape),
        bk AS (SELECT session_id, seq, ts_ns, e, type, size, price, direction, {_bk()} FROM tp)""",
    "trades": """trades AS (
        SELECT l_suppkey AS session_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq,
            epoch_us(l_shipdate) * 1000 AS ts_ns, CAST(l_quantity AS BIGINT) AS volume,
            CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT) AS signed, CAST(round(l_extendedprice * 100) AS BIGINT) AS value
        FROM lineitem)""",
    "paths": """paths AS (
        SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
            (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS t,
            CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS INTEGER) AS type
        FROM events)""",
}


def sql(body: str, *views: str, more: str = "") -> str:
    """A query over the named views; `more` has further CTEs."""
    need = [v for v in CTES if v in views or v == "tape" and "bk" in views]
    ctes = [CTES[v] for v in need] + ([more] if more else [])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
