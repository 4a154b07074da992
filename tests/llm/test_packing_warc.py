"""Packing and archives: certificates, round trips, edge cases; the pipeline against its parts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tapeworks.llm import packing, warc
from tapeworks.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
DOCS = "doc_id long, text string, start long"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return list(tokenizer.encode(text or "", add_special_tokens=False).ids) + [0]


def check_packing(rows, got, tokenizer, capacity):
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for i, ts in texts.items():
        want = []
        for t in ts:
            ids = np.array(ids_of(tokenizer, t), "<u4")
            want += [(k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == sorted(want)
    return len(by_seq)


def test_packing(spark, tokenizer):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta,", "gamma-delta", "ÉTÉ", "don't", "<|endoftext|>", "x9"], k=rng.randint(0, 700)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "word " * 5000), (None, "hello"), (None, None), (5, "again"), (903, "y" * 50_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], DOCS)
    got = packing.pack_documents(df, PATH, part_items=100).collect()
    used = check_packing(rows, got, tokenizer, 2048)
    lengths = np.array([r.length for r in got])
    bound = packing.lower_bound(lengths, 2048)
    assert bound <= used <= bound * 1.05 + 1
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_sequence_ids_cannot_collide():
    """Fields of round, part and place do not run into each other nor into the ids of full pieces; beyond them is an error."""
    last = [(1 << b) - 1 for b in (packing.ROUND_BITS, packing.PART_BITS, packing.BIN_BITS)]
    base = packing.sequence_base
    assert base(0, 0, 1) == 0 and base(0, 1, 1) == 1 << packing.BIN_BITS
    assert base(0, last[1], 1) + last[2] < base(1, 0, 1) and base(last[0], last[1], 1) + last[2] < packing.FULL
    assert packing.PART_ITEMS * 2 <= last[2] and packing.MOST_ROUNDS <= last[0]
    for beyond in ((last[0] + 1, 0, 1), (0, last[1] + 1, 1), (0, 0, last[2] + 2)):
        with pytest.raises(OverflowError):
            base(*beyond)


def test_rounds_are_bounded(spark, tokenizer, monkeypatch):
    rows = [(i, "word " * (600 + 37 * i % 900)) for i in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], DOCS)
    monkeypatch.setattr(packing, "MOST_ROUNDS", 1)
    check_packing(rows, packing.pack_documents(df, PATH, part_items=8).collect(), tokenizer, 2048)


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, n = packing.best_fit_decreasing(x, 100)
        fill = np.bincount(bins, x)
        assert len(fill) == n and fill.max() <= 100
        for b in range(n):
            at = np.flatnonzero(bins == b)
            order = at[np.argsort(offsets[at])]
            assert offsets[order].tolist() == (np.cumsum(x[order]) - x[order]).tolist()
        assert -(-x.sum() // 100) <= packing.lower_bound(x, 100) <= n
    assert packing.lower_bound(np.array([60] * 10), 100) == 10
    assert packing.lower_bound(np.array([34] * 9), 100) == 5
    assert packing.lower_bound(np.zeros(0, int), 100) == 0


def test_words_give_the_tokenizers_ids(tokenizer):
    rng = random.Random(3)
    signs = ["a", "S", "'s", "'", "<|endoftext|>", "<|", "é", "É", "ß", "İ", "é", "́", " ", "\n", "\t", " ", " ", "\x1c", "1", "²", "中", "Σ", "_", "-", "😀", "\x00", "µ", "ª", "!", "don't", "THE"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    words = packing._WordIds(PATH)
    for text, ids in zip(texts, words.documents(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(tokenizer, text)[:-1], text


def test_any_tokenizer(spark):
    """Tokenizers that keep white space get whole texts."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert packing.drops_white_space(PATH) and not packing.drops_white_space(path)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices([" ", "  ", "\n", "word", "Word", "é", "1", "😀", "<|endoftext|>"], k=rng.randint(0, 400)))) for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], DOCS)
    check_packing(rows, packing.pack_documents(df, path, capacity=128, part_items=50).collect(), Tokenizer.from_file(path), 128)


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"truncation": {"max_length": 5}}])
def test_changed_tokenizers_take_no_short_cut(tmp_path, change):
    import json

    told = json.load(open(PATH)) | change
    (tmp_path / "t.json").write_text(json.dumps(told))
    assert not packing.drops_white_space(str(tmp_path / "t.json"))


def test_archives(spark):
    rows = [(i, f"http://x/{i}?q=é\n", "<p>%d</p>" % (i % 7) * (i % 50)) for i in range(400)]
    rows += [(1000 + i, None, "hot") for i in range(200)] + [(2000, "u", None), (2001, "u", ""), (None, "u", "hot"), (None, "u", "alone"), (3000, "u", "twice"), (3000, "u", "twice"), (4000, "u", "é" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string")
    keep = {}
    for i, _, h in rows:
        h = h or ""
        keep[h] = max((x for x in (keep.get(h), i) if x is not None), default=None)
    want = sorted(((i, len((h or "").encode()), warc.digest_of((h or "").encode()), "response" if keep[h or ""] in (i, None) else "revisit", None if keep[h or ""] in (i, None) else keep[h or ""]) for i, _, h in rows), key=str)
    got = warc.archive_pages(df, roll_bytes=20_000).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    assert len({r.file for r in got}) > 1 and len({(r.file, r["at"]) for r in got}) == len(rows)
    few = warc.archive_pages(df, least_bytes=10_000_000).collect()
    assert {r.record_type for r in few} == {"response"}
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_tasks_are_bounded_whatever_the_number_of_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_TASKS", 3)
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 20}" * 50) for i in range(60)], "page_id long, url string, html string").repartition(6)
    got = warc.archive_pages(pages, roll_bytes=500)
    assert got.rdd.getNumPartitions() == 3
    rows = got.collect()
    assert len(rows) == 60 and len({r.file for r in rows}) > 20 and sum(r.record_type == "response" for r in rows) == 20


def test_records_have_the_demanded_fields(spark, tmp_path):
    """Every file is members of one record each, a warcinfo first; ids are unique and what is referred to is there."""
    import gzip
    import re
    from datetime import UTC, datetime

    rows = [(i, f"http://x/{i}", "same" if i % 3 else f"page {i}") for i in range(60)] + [(7, "http://x/again", "other"), (None, None, "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    (tmp_path / "mine").mkdir()
    got = warc.archive_pages(df, folder=str(tmp_path / "mine"), roll_bytes=2000, date=datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC)).collect()
    names = sorted(p.name for p in (tmp_path / "mine").iterdir())
    assert names == sorted({r.file for r in got} | {r.file + ".idx" for r in got})  # nothing else stays
    heads, pages = {}, 0
    for name in (n for n in names if n.endswith(".gz")):
        told, data, at = [], gzip.decompress((tmp_path / "mine" / name).read_bytes()), 0
        while at < len(data):
            head, block, at = warc.parse(data, at)
            told.append(head)
            assert head["WARC-Record-ID"] not in heads and re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", head["WARC-Record-ID"])
            heads[head["WARC-Record-ID"]] = head
            assert head["WARC-Date"] == "2024-05-06T07:08:09Z" and int(head["Content-Length"]) == len(block)
            assert {"WARC-Type", "Content-Type"} <= set(head)
        assert [h["WARC-Type"] for h in told].index("warcinfo") == 0 and told[0]["WARC-Filename"] == name
        assert all(h["WARC-Type"] in ("response", "revisit") for h in told[1:])
        pages += len(told) - 1
    assert pages == len(rows)
    revisits = [h for h in heads.values() if h["WARC-Type"] == "revisit"]
    assert revisits and all(heads[h["WARC-Refers-To"]]["WARC-Type"] == "response" and heads[h["WARC-Refers-To"]]["X-Page-ID"] == h["X-Refers-To-Page-ID"] == "59" for h in revisits)
    assert all("WARC-Profile" in h for h in revisits)


def test_a_broken_stream_is_refused(tmp_path):
    import gzip

    records = [warc.record("response", f"id{i}", "2024-01-01T00:00:00Z", i, "u", warc.digest_of(b"x"), 1, b"x") for i in range(50)]
    data = b"".join(records)
    whole = gzip.compress(data)
    (tmp_path / "a.gz").write_bytes(whole)
    assert len(list(warc.stream_records(str(tmp_path), "a.gz"))) == 50
    (tmp_path / "c.gz").write_bytes(b"".join(map(gzip.compress, records)))  # many members
    assert list(warc.stream_records(str(tmp_path), "c.gz")) == list(warc.stream_records(str(tmp_path), "a.gz"))
    (tmp_path / "b.gz").write_bytes(whole[:-20])
    with pytest.raises(ValueError):
        list(warc.stream_records(str(tmp_path), "b.gz"))


def test_pipeline_is_its_stages(spark, sf_dir, tokenizer):
    import corpus_pipeline

    from tapeworks.llm import decontaminate, langid
    from tests.llm.test_dedup import lower, shingle_set

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    und = {r.doc_id for r in langid.identify(table).where("lang_pred = 'und'").collect()}
    left = {i: t for i, t in docs.items() if i not in und}
    last = {}
    for i, t in left.items():
        last[lower(t)] = max(i, last.get(lower(t), i))
    left = {i: t for i, t in left.items() if i in set(last.values())}
    # Classes of similarity 0.8 over five-word shingles, of which the smallest id stays.
    sets, parent = {i: shingle_set(t) for i, t in left.items()}, {i: i for i in left}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in left:
        for j in left:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if find(i) == i}
    kept = table.where(table.doc_id.isin(list(left)))
    bad = {r.doc_id for r in decontaminate.contaminated(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    rows = [(i, t) for i, t in left.items() if i not in bad]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows} and bad
    check_packing(rows, got, tokenizer, 2048)
    stage = table
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, sf_dir)
        assert stage.columns == table.columns
