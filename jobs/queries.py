"""The jobs as registered queries: each runs its job twice into a fresh folder of the shared one and reads the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import session_bars, text_profile
from tapeworks.sources.shared import shared_path
from tapeworks.sources.tape import CTES, DEPTH, HOUR_NS, USERS

BAR = 14_400


def job1_session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars; the second run finds nothing new."""
    config = session_bars.Config(f"{sf_dir}/events.parquet", shared_path(spark, "job1"), bar_seconds=BAR)
    for _ in range(2):
        session_bars.run(spark, config)
    return session_bars.read_bars(spark, config.out)


def job2_text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the texts of every source; the second run writes the same."""
    config = text_profile.Config(f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", shared_path(spark, "job2"))
    for _ in range(2):
        text_profile.run(spark, config)
    # The last digits of sums of floats depend on their order.
    return text_profile.read_profile(spark, config.out).withColumn("value", F.round("value", 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_session_bars, job2_text_profile)}


# The tape's SQL with days kept apart.
_TAPE = (
    CTES["tape"]
    .replace(f"user_id // {USERS}", f"(epoch_us(ts) // 86400000000) * {session_bars.DAY_STRIDE} + user_id // {USERS}")
    .replace("AS direction", f"AS direction, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INTEGER) AS day, CAST((epoch_us(ts) // 1000000 % 86400) // {BAR} AS INTEGER) AS bar")
)
_BOOK = CTES["bk"].replace("direction, CASE", "direction, day, bar, CASE")
assert DEPTH == 3 and HOUR_NS and _TAPE.count("DAY_STRIDE") == 0 and "day, bar" in _BOOK

_BARS = f"""WITH {_TAPE}, {_BOOK},
    lb AS (SELECT *, lag(bp1) OVER o AS pbp, lag(bs1) OVER o AS pbs, lag(ap1) OVER o AS pap, lag(as1) OVER o AS pas FROM bk WINDOW o AS (PARTITION BY session_id ORDER BY ts_ns, seq)),
    fw AS (SELECT *, CASE WHEN bp1 IS NOT NULL AND pbp IS NOT NULL AND ap1 IS NOT NULL AND pap IS NOT NULL THEN
        (CASE WHEN bp1 >= pbp THEN bs1 ELSE 0 END) - (CASE WHEN bp1 <= pbp THEN pbs ELSE 0 END) - (CASE WHEN ap1 <= pap THEN as1 ELSE 0 END) + (CASE WHEN ap1 >= pap THEN pas ELSE 0 END) END AS flow,
        (ap1 + bp1) / 2.0 AS mid, ap1 - bp1 AS spread, type = 4 AS lit FROM lb)
SELECT session_id % {session_bars.DAY_STRIDE} AS session_id, bar, CAST(count(*) AS BIGINT) AS messages, CAST(count(*) FILTER (WHERE lit) AS BIGINT) AS trades, CAST(count(*) FILTER (WHERE type = 5) AS BIGINT) AS hidden,
    CAST(coalesce(sum(size) FILTER (WHERE lit), 0) AS BIGINT) AS volume, CAST(coalesce(sum(-direction * size) FILTER (WHERE lit), 0) AS BIGINT) AS signed_volume,
    CAST(coalesce(sum(size * price) FILTER (WHERE lit), 0) AS BIGINT) AS traded_value, CAST(sum(size * price) FILTER (WHERE lit) AS DOUBLE) / nullif(sum(size) FILTER (WHERE lit), 0) AS vwap,
    arg_min(price, seq) FILTER (WHERE lit) AS open, max(price) FILTER (WHERE lit) AS high, min(price) FILTER (WHERE lit) AS low, arg_max(price, seq) FILTER (WHERE lit) AS close,
    CAST(sum(flow) AS BIGINT) AS flow, bool_and(flow IS NOT NULL) AS flow_known, CAST(sum(spread) AS DOUBLE) / count(spread) AS mean_spread, arg_max(mid, seq) FILTER (WHERE mid IS NOT NULL) AS last_mid, day
FROM fw GROUP BY day, fw.session_id, bar"""


_SIGNALS = text_profile.SIGNALS
_COUNTS = "documents empty labelled good words mean_words fano_words".split()
_CONSTRAINTS = {"n_chars fits": "NOT fits", "has words": "words = 0", "has a language": "lang = '(none)'"}

_PROFILE = rf"""WITH d AS (
    SELECT doc_id, text, coalesce(text, '') AS t, coalesce(nullif(lang, ''), '(none)') AS lang, coalesce(nullif(source, ''), '(none)') AS source, n_chars, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
    SELECT doc_id, source, lang, length(t) AS chars, CAST(len(w) AS BIGINT) AS words, CAST(len(list_distinct(w)) AS DOUBLE) / nullif(len(w), 0) AS distinct_share,
        CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS DOUBLE) / nullif(length(t), 0) AS capital_share,
        CAST(length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS DOUBLE) / nullif(length(t), 0) AS digit_share,
        CAST(length(array_to_string(w, '')) AS DOUBLE) / nullif(len(w), 0) AS mean_word, n_chars IS NOT DISTINCT FROM length(text) AS fits, good
    FROM d LEFT JOIN l USING (doc_id)
), c AS (
    SELECT source, 'lang:' || lang AS scope, CAST(count(*) AS DOUBLE) AS documents, CAST(count(*) FILTER (WHERE chars = 0) AS DOUBLE) AS empty, CAST(count(good) AS DOUBLE) AS labelled,
        CAST(count(*) FILTER (WHERE good) AS DOUBLE) AS good, CAST(sum(words) AS DOUBLE) AS words, avg(words) AS mean_words, var_samp(words) / nullif(avg(words), 0) AS fano_words
    FROM f GROUP BY source, lang
), s AS (
    {" UNION ALL ".join(f"SELECT source, good, '{x}' AS signal, CAST({x} AS DOUBLE) AS x FROM f WHERE good IS NOT NULL AND {x} IS NOT NULL" for x in _SIGNALS)}
), law AS (
    SELECT source, signal, sum(CASE WHEN good THEN 1.0 ELSE 0 END) OVER w AS a, sum(CASE WHEN good THEN 0.0 ELSE 1 END) OVER w AS b,
        CAST(count(*) FILTER (WHERE good) OVER g AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE NOT good) OVER g AS DOUBLE) AS m
    FROM s WINDOW w AS (PARTITION BY source, signal ORDER BY x RANGE UNBOUNDED PRECEDING), g AS (PARTITION BY source, signal)
), ks AS (
    SELECT source, 'signal:' || signal AS scope, max(n) AS n, max(m) AS m, max(abs(a / nullif(n, 0) - b / nullif(m, 0))) AS d FROM law GROUP BY source, signal
), kp AS (
    SELECT source, scope, n, m, d, CASE WHEN z <= 0 THEN 1 WHEN z < 1 THEN 1 - sqrt(2 * pi()) / z * sum(exp(-power(2 * k - 1, 2) * pi() * pi() / (8 * z * z)))
        ELSE 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * z * z)) END AS p
    FROM (SELECT *, d * sqrt(n * m / (n + m)) AS z FROM ks), range(1, 21) r(k) GROUP BY source, scope, n, m, d, z
), ed AS (
    SELECT source, signal, list_distinct(quantile_cont(x, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS edges FROM s GROUP BY ALL
), jn AS (
    SELECT source, signal, len(list_filter(edges, lambda e: e < x)) AS bin, good, CAST(count(*) AS DOUBLE) AS n FROM s JOIN ed USING (source, signal) GROUP BY ALL
), jw AS (
    SELECT *, sum(n) OVER (PARTITION BY source, signal, bin) AS nx, sum(n) OVER (PARTITION BY source, signal, good) AS ny, sum(n) OVER (PARTITION BY source, signal) AS t FROM jn
), mi AS (
    SELECT source, 'signal:' || signal AS scope, sum(n / t * ln(n * t / (nx * ny))) AS i, sum(n / t * ln(n * t / (nx * ny))) - (count(*) - count(DISTINCT bin) - count(DISTINCT good) + 1) / (2 * max(t)) AS corrected
    FROM jw GROUP BY source, signal
), out AS (
    {" UNION ALL ".join(f"SELECT source, scope, '{x}' AS measure, {x} AS value FROM c" for x in _COUNTS)}
    UNION ALL SELECT source, 'lang:' || lang, unnest(['words_q10', 'words_q50', 'words_q90', 'words_q99']), unnest(quantile_cont(words, [0.1, 0.5, 0.9, 0.99])) FROM f GROUP BY source, lang
    {" ".join(f"UNION ALL SELECT source, 'constraint:{n}', unnest(['rejected', 'first']), unnest([CAST(count(*) FILTER (WHERE {x}) AS DOUBLE), CAST(min(doc_id) FILTER (WHERE {x}) AS DOUBLE)]) FROM f GROUP BY source" for n, x in _CONSTRAINTS.items())}
    UNION ALL SELECT source, scope, 'good', n FROM kp UNION ALL SELECT source, scope, 'other', m FROM kp UNION ALL SELECT source, scope, 'distance', d FROM kp UNION ALL SELECT source, scope, 'p', p FROM kp
    UNION ALL SELECT source, scope, 'information', i FROM mi UNION ALL SELECT source, scope, 'information_corrected', corrected FROM mi
)
SELECT scope, measure, round(value, 9) AS value, source FROM out WHERE value IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    return {"job1_session_bars": _BARS, "job2_text_profile": _PROFILE}
