"""What grows with the input: sorts a task holds, passes over the input, and state of streams."""

import re

from pyspark.sql import functions as F

from jobs import text_profile
from tapeworks import plans
from tapeworks.operators import hawkes as hk
from tapeworks.sources import files
from tapeworks.streaming import fold as stf
from tapeworks.streaming import windows as stw

QUERIES = plans.queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_streams_are_sorted_in_one_pass(spark, sf_dir):
    """One sort numbers the tape, one merges it; a sort a stream would all be held by one task."""
    plan = plan_of(QUERIES["SRT02_merged_streams"](spark, sf_dir))
    assert plan.count("Sort [") == 2 and plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan


class Calls:
    """State variables that count what is asked of them; `values` is what they hold."""

    def __init__(self, value=None):
        self.count, self.value = 0, value

    def __getattr__(self, name):
        def call(*args):
            self.count += 1
            if name == "get":
                return self.value
            if name == "iterator":
                return iter(self.value.items())
            if name in ("update", "put"):
                self.value = args[0]
            elif name == "appendList":
                self.value = (self.value or []) + args[0]
            elif name == "updateValue":
                self.value[args[0]] = args[1]
            elif name == "removeKey":
                del self.value[args[0]]

        return call


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Calls())

    def getListState(self, name, *_):
        return self.states.setdefault(name, Calls([]))

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Calls({}))

    def asked(self):
        out = {n: s.count for n, s in self.states.items() if s.count}
        for s in self.states.values():
            s.count = 0
        return out


def fed(processor, handle, key, *columns):
    """The results of one arrival, its rows packed."""
    processor.init(handle)
    processor.packed = len(columns)
    return [x for r in processor.handleInputRows((key,), iter([(key, *columns)]), None) for x in r["rows"]]


def test_a_session_asks_for_its_state_in_few_calls():
    """Each call goes from a Python worker to the executor and back, so they decide what a session costs."""
    handle = Handle()
    got = fed(stw._Rolling(5), handle, 1, list(range(50)), list(range(50)), [1] * 50)
    assert [r[3] for r in got] == [min(k + 1, 5) for k in range(50)]
    assert handle.asked() == {"last": 2, "rows": 1}
    got = fed(stw._Rolling(5), handle, 1, [51, 50], [51, 50], [1, 1])
    assert [r[1:] for r in got] == [(50, 50, 5, 5), (51, 51, 5, 5)]
    assert sum(handle.asked().values()) <= 6


def test_rows_of_a_session_travel_as_one(spark):
    """A batch of rows goes to the sessions as a row of arrays each; nothing is lost or mixed up."""
    rows = [(s, k, 10 * k, None if k == 7 else (s or 0) + k) for k in range(20) for s in (3, 1, None)]
    got = stw.packed(spark.createDataFrame(rows, "session_id long, seq long, ts_ns long, value long").coalesce(1)).collect()
    assert len(got) == 3
    assert sorted(((r[0], *v) for r in got for v in zip(*r[1:])), key=str) == sorted(rows, key=str)


def test_residuals_are_replayed_once(spark, sf_dir):
    """The passes of a law read what one replay wrote."""
    assert "MapInArrow" not in plan_of(QUERIES["HWK15_two_sample_ks"](spark, sf_dir))


def test_blocks_that_leave_nothing_are_not_scanned_twice(spark):
    """A path of less than a block has no end to hand on, so its rows are scanned once."""
    seen = spark.sparkContext.accumulator(0)
    plain = hk._ends

    def counted(*args):
        run = plain(*args)

        def scan(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield from run([batch])

        return scan

    rows = [(p, n, float(n), n % 2) for p, size in ((1, 9), (2, 3), (3, 4)) for n in range(size)]
    hk._ends = counted
    try:
        got = hk.replay(spark.createDataFrame(rows, "path_id long, n long, t double, type int"), 1.0, 2, block=4)
        whole = hk.replay(spark.createDataFrame(rows, "path_id long, n long, t double, type int"), 1.0, 2)
        key = lambda df: {(r.path_id, r.n): ([round(x, 9) for x in r.z], r.counts) for r in df.collect()}
        assert key(got) == key(whole)
    finally:
        hk._ends = plain
    assert seen.value == 12  # two full blocks of the first path and one of the third


def test_a_pair_is_read_in_few_passes(spark, tmp_path):
    """One pass over each file for what is told of it, then two for the rows and their numbers; each scan reads every row."""
    pair = files.FilePair(str(tmp_path), "T", "2024-01-01", 0, 10**9, 1)
    price = lambda p: F.array(F.struct(p.alias("price"), F.lit(5).cast("long").alias("size")))
    i = F.col("id")
    rows = spark.range(200).select(i.alias("row_no"), (i * 10**9).alias("TimeNanoseconds"), F.lit(1).cast("long").alias("Type"), i.alias("OrderID"), i.alias("Size"), (i + 100).alias("Price"), F.lit(1).cast("long").alias("Direction"), price(i + 2).alias("asks"), price(i + 1).alias("bids"))
    files.write_pair(rows, pair.messages_path, pair.orderbook_path, 1)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("aligned"))
    spark.sparkContext.setJobGroup("aligned", "loads a pair")
    try:
        got = files.load_aligned(spark, pair)
        told = jobs()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = plan_of(got)
    assert plan.count("FileScan csv") == 4 and plan.count("BroadcastHashJoin") >= 2
    assert told <= 4  # two aggregates, each of two jobs at most
    assert [(r.row_no, r.Size, r.asks[0].price) for r in got.orderBy("row_no").collect()] == [(k, k, k + 2) for k in range(200)]


def test_a_profile_measures_every_text_once(spark, sf_dir, tmp_path, monkeypatch):
    """The ranges by which features are dealt are drawn from rows already measured."""
    seen, plain = spark.sparkContext.accumulator(0), text_profile.features

    def counted(documents, labels):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return plain(documents.mapInArrow(run, documents.schema), labels)

    monkeypatch.setattr(text_profile, "features", counted)
    text_profile.run(spark, text_profile.Config(f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", str(tmp_path)))
    assert seen.value == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_odd_texts_are_measured_as_before(spark):
    """Words end at the six white characters only; letters and digits are those of ASCII, counted by code points."""
    texts = ["", " ", None, "a", "\ta  b\n", "A\x0bB\x0cC\r1", "x\x85y z\x1cq", "\U0001f600 Ä9٣ AÁ", " ", "a a A"]
    rows = [(k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts)]
    got = text_profile.features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([], "doc_id long, quality int")).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]", t) if w]
        share = lambda x, n: x / n if n else None
        assert (r.chars, r.words, r.distinct_share, r.mean_word) == (len(t), len(words), share(len(set(words)), len(words)), share(len("".join(words)), len(words)))
        assert (r.capital_share, r.digit_share) == (share(len(re.findall("[A-Z]", t)), len(t)), share(len(re.findall("[0-9]", t)), len(t)))


def test_a_folded_session_writes_only_what_differs():
    """A level that an arrival made and unmade was never stored, so the state is not asked for it; nor for one as it was."""
    handle = Handle()
    arrive = lambda *columns: fed(stf.BookProcessor(5), handle, 1, *columns)  # noqa: E731  seq, ts_ns, size, price, direction, kind
    arrive([0, 1, 2], [0, 1, 2], [10, 20, 20], [1000, 1003, 1003], [1, -1, -1], [1, 1, 2])
    assert handle.states["levels"].value == {(1, 1000): (10,)}
    assert handle.asked() == {"last": 2, "levels": 1}
    arrive([3, 4, 5], [3, 4, 5], [5, 5, 7], [1000, 1000, 999], [1, 1, 1], [1, 2, 1])
    assert handle.states["levels"].value == {(1, 1000): (10,), (1, 999): (7,)}
    assert handle.asked() == {"last": 2, "levels": 2}


def test_a_shallow_book_costs_two_calls():
    """However many levels an arrival changes; what comes out is what levels kept one by one give."""
    arrivals = [
        ([0, 1, 2, 3], [0, 1, 2, 3], [10, 20, 20, 5], [1000, 1003, 1003, 1004], [1, -1, -1, -1], [1, 1, 2, 1]),
        ([5, 4], [5, 4], [7, 7], [0, 999], [-1, 1], [1, 1]),
        ([6, 7], [6, 7], [9, 1], [(1 << 63) - 1, 1000], [1, -1], [1, 1]),
    ]
    handle, other = Handle(), Handle()
    for columns in arrivals:
        got = fed(stf.ShallowBookProcessor(5), handle, 1, *columns)
        assert handle.asked() == {"last": 2}
        assert got == fed(stf.BookProcessor(5), other, 1, *columns)
    book = handle.states["last"].value
    assert book[:2] == (7, 7) and {(d, p): (s,) for d, side in ((1, book[3]), (-1, book[4])) for p, s in side} == other.states["levels"].value


def test_a_shallow_fold_over_many_arrivals(spark, tmp_path):
    """Books kept as a whole go on where they were and are forgotten with idle sessions; only the named columns are made."""
    s = 1_000_000_000
    names = "session_id long, seq long, ts_ns long, size long, price long, direction int, kind int"
    first = [(1, 0, s, 10, 1000, 1, 1), (1, 1, s, 20, 1003, -1, 1), (2, 0, s, 5, 999, 1, 1)]
    parts = [first, [(1, 2, 2 * s, 15, 1003, 1, 1)], [(2, 1, 500 * s, 9, 999, -1, 1)], [(2, 2, 501 * s, 1, 997, 1, 1)], [(1, 3, 502 * s, 7, 1000, -1, 1)]]
    for idle, want in ((None, {(1, 2): 15, (2, 1): 5, (1, 3): 7}), (60 * s, {(1, 2): 15, (2, 1): 5})):
        frames = [spark.createDataFrame(p, names) for p in parts]
        got = stw.run_in_parts(spark, frames, lambda m: stf.fold_stream(m, 5, idle_ns=idle, columns=["seq", "session_id", "traded_size"], shallow=True))  # noqa: B023
        assert got.columns == ["seq", "session_id", "traded_size"]
        rows = {(r.session_id, r.seq): r.traded_size for r in got.collect()}
        assert len(rows) == 7 and {k: v for k, v in rows.items() if v} == want


def test_the_fold_of_a_stream_makes_what_is_asked(spark, sf_dir, monkeypatch):
    """States, fills and deltas of every message would cost several times the fold itself."""
    made = []

    def run(spark, parts, operator):
        made.append(operator(parts[0]).columns)
        return operator(parts[0])

    monkeypatch.setattr(stw, "run_in_parts", run)
    got = QUERIES["STR01_stream_fold"](spark, sf_dir)
    assert made == [got.columns] == [["session_id", "seq", "fill_count", "traded_size", "traded_value"]]
