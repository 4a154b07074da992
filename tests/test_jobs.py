"""The jobs over growing and odd input, run again, ended early, and from the command line."""

import datetime as dt
import json
import logging
import os
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import common, queries, session_bars, text_profile
from tests.compare import assert_same
from tests.conftest import REPO

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, day int, session_id long"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_against_sql(spark, duck, sf_dir, name):
    settings = lambda: {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"}
    before = settings()
    assert_same(queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).df())
    assert settings() == before


def files(folder):
    """Every data file below a folder with its time of change."""
    return {os.path.relpath(os.path.join(r, f), folder): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def growing(spark, sf_dir, tmp_path):
    """A copy of the events that grows part by part; the third part belongs to days that the first has already filled."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    ranked = events.toPandas()
    middle, end = len(ranked) // 2, len(ranked)
    order = [i for i in range(middle) if i % 10] + list(range(middle, end)) + [i for i in range(0, middle // 4) if i % 10 == 0]
    ranked = ranked.iloc[order].reset_index(drop=True)
    ranked["event_id"] = range(1, len(ranked) + 1)
    cut = [0, sum(1 for i in range(middle) if i % 10), sum(1 for i in range(middle) if i % 10) + end - middle, len(ranked)]
    folder = tmp_path / "events"
    parts = [ranked.iloc[a:b] for a, b in zip(cut, cut[1:])]

    def arrive(k):
        spark.createDataFrame(parts[k], events.schema).write.mode("append").parquet(str(folder))

    return str(folder), arrive


def test_only_new_events_are_taken_and_only_their_days_written(spark, growing, tmp_path):
    folder, arrive = growing
    config = session_bars.Config(folder, str(tmp_path / "out"))
    taken = []
    for k in range(3):
        arrive(k)
        was = files(f"{config.out}/bars")
        done = session_bars.run(spark, config)
        taken.append(done.read)
        now = files(f"{config.out}/bars")
        changed = {os.path.dirname(f) for f, _ in set(was.items()) ^ set(now.items())}
        assert len(changed) == done.parts
        if k == 2:  # late events reach old days and leave the others as they were
            assert 0 < done.parts < len({os.path.dirname(f) for f in now})
        # The same from one run over all that has arrived.
        fresh = session_bars.Config(folder, str(tmp_path / f"whole{k}"))
        session_bars.run(spark, fresh)
        assert rows(session_bars.read_bars(spark, config.out)) == rows(session_bars.read_bars(spark, fresh.out))
    assert sum(taken) == spark.read.parquet(folder).count()
    again, marks = files(config.out), rows(spark.read.parquet(f"{config.out}/marks"))
    assert session_bars.run(spark, config).wrote == 0
    assert files(config.out) == again and len(marks) == 3


def test_a_run_that_ended_before_its_mark_is_made_good(spark, growing, tmp_path):
    folder, arrive = growing
    config = session_bars.Config(folder, str(tmp_path / "out"))
    arrive(0)
    session_bars.run(spark, config)
    shutil.copytree(f"{config.out}/marks", tmp_path / "marks")
    arrive(1)
    session_bars.run(spark, config)
    want = rows(session_bars.read_bars(spark, config.out))
    # The bars of the second run are there, its mark is not; a day's files are half gone.
    shutil.rmtree(f"{config.out}/marks")
    shutil.copytree(tmp_path / "marks", f"{config.out}/marks")
    last = sorted(files(f"{config.out}/bars"))[-1]
    os.remove(f"{config.out}/bars/{last}")
    session_bars.run(spark, config)
    assert rows(session_bars.read_bars(spark, config.out)) == want


def test_odd_events(spark, tmp_path):
    """Rows without a place are left out, repeated rows count each, clashing columns do not matter, a day can be one event."""
    at = dt.datetime(2024, 3, 1, 23, 59, 59, 999999)
    data = [(1, at, 7, "purchase", 5.0, 3, 4), (1, at, 7, "purchase", 5.0, 3, 4), (2, None, 7, "view", 1.0, 3, 4), (3, at, None, "view", 1.0, 3, 4), (None, at, 7, "view", 1.0, 3, 4), (4, at + dt.timedelta(microseconds=1), 7, None, None, 3, 4)]
    spark.createDataFrame(data, EVENTS).write.parquet(str(tmp_path / "events"))
    config = session_bars.Config(str(tmp_path / "events"), str(tmp_path / "out"), bar_seconds=3600)
    done = session_bars.run(spark, config)
    got = {(r.day, r.bar): r for r in session_bars.read_bars(spark, config.out).collect()}
    assert done.read == 6 and set(got) == {(20240301, 23), (20240302, 0)}
    assert got[20240301, 23].messages == 2 and got[20240301, 23].trades == 2 and got[20240301, 23].session_id == 2
    assert got[20240302, 0].messages == 1 and got[20240302, 0].vwap is None and not got[20240302, 0].flow_known
    assert session_bars.run(spark, config).wrote == 0


def test_empty_events(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "events"))
    config = session_bars.Config(str(tmp_path / "events"), str(tmp_path / "out"))
    assert session_bars.run(spark, config).wrote == 0
    assert session_bars.read_bars(spark, config.out).count() == 0


def test_settings_are_checked(tmp_path):
    for bad in ({}, {"events": "a"}, {"events": "a", "out": "b", "bar_seconds": 7}, {"events": "a", "out": "b", "files_per_day": 0}, {"events": "a", "out": "b", "other": 1}):
        with pytest.raises(ValueError):
            common.from_values(session_bars.Config, bad)
    for bad in ({"documents": "a", "labels": "b"}, {"documents": "a", "labels": "b", "out": "c", "bins": 1}, {"documents": "a", "labels": "b", "out": "c", "quantiles": [2]}):
        with pytest.raises(ValueError):
            common.from_values(text_profile.Config, bad)
    for name, kind in (("session_bars", session_bars.Config), ("text_profile", text_profile.Config)):
        with open(f"{REPO}/jobs/{name}.json") as f:
            common.from_values(kind, json.load(f))


DOCS = "doc_id long, text string, lang string, source string, n_chars int, good boolean, words long"


def test_profile_of_odd_texts(spark, tmp_path, caplog):
    docs = [(1, "a B c", "en", "s/1", 5), (2, None, None, None, None), (3, "", "", "", 0), (4, "word " * 50_000, "en", "s/1", 3), (5, "a B c", "en", "s/1", 5), (5, "a B c", "en", "s/1", 5), (None, "x", "en", "s/1", 1)]
    spark.createDataFrame([(*d, True, 1) for d in docs], DOCS).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, 1, "en"), (1, 0, "en"), (4, 0, "en"), (5, None, "en"), (None, 1, "en"), (77, 1, "en")], "doc_id long, quality int, lang string").write.parquet(str(tmp_path / "labels"))
    config = text_profile.Config(str(tmp_path / "docs"), str(tmp_path / "labels"), str(tmp_path / "out"))
    with caplog.at_level(logging.INFO, "tapeworks.jobs"):
        text_profile.run(spark, config)
    assert re.search(r"read 7 rows, wrote \d+ rows in 2 partitions", caplog.text)
    got = {(r.source, r.scope, r.measure): r.value for r in text_profile.read_profile(spark, config.out).collect()}
    assert got["s/1", "lang:en", "documents"] == 5 and got["(none)", "lang:(none)", "documents"] == 2 and got["(none)", "lang:(none)", "empty"] == 2
    assert (got["s/1", "lang:en", "labelled"], got["s/1", "lang:en", "good"]) == (4, 1)
    assert got["s/1", "lang:en", "words_q50"] == 3 and got["s/1", "lang:en", "words"] == 50_010
    assert (got["s/1", "constraint:n_chars fits", "rejected"], got["s/1", "constraint:n_chars fits", "first"]) == (1, 4)
    assert got["(none)", "constraint:has words", "rejected"] == 2 and got["(none)", "constraint:has a language", "first"] == 2
    assert (got["s/1", "signal:words", "good"], got["s/1", "signal:words", "other"], got["s/1", "signal:words", "distance"]) == (1, 3, pytest.approx(1 / 3))
    assert not any(s == "(none)" and scope.startswith("signal") for s, scope, _ in got)
    want = rows(text_profile.read_profile(spark, config.out))
    text_profile.run(spark, config)
    assert rows(text_profile.read_profile(spark, config.out)) == want


def test_profile_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels"))
    config = text_profile.Config(str(tmp_path / "docs"), str(tmp_path / "labels"), str(tmp_path / "out"))
    for _ in range(2):
        text_profile.run(spark, config)
        assert text_profile.read_profile(spark, config.out).count() == 0


def test_command_line(sf_dir, tmp_path):
    """A setting on the command line replaces the file's; the log tells what was read and written."""
    command = [sys.executable, "-m", "jobs.session_bars", "--events", f"{sf_dir}/events.parquet", "--out", str(tmp_path / "out"), "--bar-seconds", "86400"]
    done = subprocess.run(command, cwd=REPO, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "session_bars: read 1000 rows" in done.stderr and os.path.isdir(tmp_path / "out" / "marks")


def test_jobs_stand_apart():
    for name in os.listdir(f"{REPO}/jobs"):
        if name.endswith(".py"):
            with open(f"{REPO}/jobs/{name}") as f:
                assert not re.search(r"\bllm\b|corpus_pipeline", f.read())
