"""Exact and near duplicates, components, repeated passages: brute force and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeworks.llm import exact_dedup, near_copies, simhash, substring_dedup
from tapeworks.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, keep_id long, fp long"
WORDS = [f"w{i}" for i in range(40)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, 7) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))) for i in range(60)]
    base = " ".join(rng.choices(WORDS, k=400)) + ". "
    rows += [(100 + i, base) for i in range(40)]  # a hot group
    rows += [(200 + i, base.replace("w1 ", f"w1{i} ", 1)) for i in range(40)]  # near copies
    rows += [(300, None), (301, ""), (302, "  \n\t"), (303, "ÀÉ Straße"), (304, "àé straße"), (305, base * 40), (306, base.upper() * 40), (None, base), (None, None), (100, base), (307, "\x00x\x0b😀 y")]
    return rows


def test_exact_duplicates(spark, mixed):
    got = {}
    for r in exact_dedup.exact_duplicates(docs(spark, mixed)).collect():
        got.setdefault((r.doc_id, r.text_sha256), []).append(r)
    groups = {}
    for i, t in mixed:
        groups.setdefault(lower(t), []).append(i)
    assert sum(map(len, got.values())) == len(mixed)
    for i, t in mixed:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        for r in got[i, hashlib.sha256(lower(t).encode()).hexdigest()]:
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), i == keep)


def test_exact_duplicates_with_colliding_hashes(spark, mixed):
    """A hash of one value still tells chunks apart."""
    weak = exact_dedup.exact_duplicates(docs(spark, mixed), least=8, greatest=64, hashed=lambda c: F.length(c) * 0)
    strong = exact_dedup.exact_duplicates(docs(spark, mixed))
    assert sorted(map(tuple, weak.collect()), key=str) == sorted(map(tuple, strong.collect()), key=str)


def test_chunks_give_the_text_back(spark, mixed):
    rows = docs(spark, mixed).where("text is not null")
    joined = rows.select("text", F.concat_ws("", exact_dedup.chunks(F.col("text"), 5, 20)).alias("again"))
    assert joined.where("text <> again").isEmpty()


@pytest.mark.parametrize("kind", ["prose", "letters", "hex", "cjk", "greek"])
def test_chunks_meet_again_after_an_insertion(spark, kind):
    """Cuts follow the content, with or without punctuation, in any script."""
    rng = random.Random(kind)
    alphabet = {"prose": "aeiou nrst. ", "letters": "abcdefghijklmnopqrstuvwxyz ", "hex": "0123456789abcdef", "cjk": "".join(map(chr, range(0x4E00, 0x5E00))), "greek": "αβγδεζηθικλμνξοπρστυφχψω "}[kind]
    text = "".join(rng.choices(alphabet, k=60_000))
    rows = [(1, text), (2, text[:100] + "ins" + text[100:]), (3, "é" + text)]
    got = {r.doc_id: r.c for r in docs(spark, rows).select("doc_id", exact_dedup.chunks(F.col("text")).alias("c")).collect()}
    assert all("".join(got[i]) == t for i, t in rows)
    assert all(len(c.encode()) <= exact_dedup.GREATEST for c in got[1])
    assert len(got[1]) > 10 and all(len(set(got[1]) & set(got[i])) > 0.8 * len(got[1]) for i in (2, 3))


def test_keep_largest(spark, mixed):
    rows = [r for r in mixed if r[0] is not None]
    kept = exact_dedup.keep_largest(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "keep_id", "fp"]
    want = {}
    for i, t in rows:
        want[lower(t)] = max(i, want.get(lower(t), i))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want.values())


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text).encode())
    if not words:
        return 0
    sh = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if len(words) >= 3 else [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, radius):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    return {f: find(f) for f in fps}


def check_classes(rows, got, radius=3):
    fps = [fingerprint(t) for _, t in rows]
    root = components(fps, radius)
    least = {}
    for (i, _), f in zip(rows, fps):
        least[root[f]] = min((x for x in (least.get(root[f]), i) if x is not None), default=None)
    want = sorted(((i, f"{f:016x}", least[root[f]]) for (i, _), f in zip(rows, fps)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_near_duplicate_classes(spark, mixed):
    check_classes(mixed, simhash.near_duplicate_classes(docs(spark, mixed)).collect())


@pytest.mark.parametrize("radius", [3, 6])
def test_links_of_clustered_fingerprints(spark, radius):
    """Dense clusters and hot keys, split into small blocks, lose no link."""
    rng = random.Random(radius)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, radius + 1))) & ((1 << 64) - 1))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    links = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"), radius, block_rows=16).collect()
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = (int(np.int64(x).view(np.uint64)) for x in (r.u, r.v))
        parent[find(a)] = find(b)
    root = components(fps, radius)
    mine = {}
    for f in fps:
        mine.setdefault(find(f), set()).add(root[f])
    assert all(len(x) == 1 for x in mine.values()) and len(mine) == len(set(root.values()))


def test_thresholds_cover_the_radius():
    n, joint = 1000, np.diag(np.full(64, 500)) + 250 * (1 - np.eye(64, dtype=int))
    for radius in (1, 3, 5):
        groups = simhash.plan(n, joint, radius)
        bits = [b for g, _ in groups for b in g]
        assert len(bits) == len(set(bits))
        # With every group left out counted as -1, thresholds add up to radius - m + 1.
        assert sum(t + 1 for _, t in groups) == radius + 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)] + [(5, None), (None, None), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    root = {x: find(x) for x in parent}
    assert got == root
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def removed(rows, size=13):
    words = {i: [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for i, t in rows}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            least.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < i:
                keep[k : k + size] = [False] * size
        kept = [x for x, y in zip(w, keep) if y]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block,bucket,coarse,settle", [(1 << 20, 1 << 19, 12, 1 << 20), (700, 1 << 19, 12, 300), (3000, 400, 9, 1 << 20), (4000, 400, 8, 50)])
def test_repeated_passages(spark, mixed, block, bucket, coarse, settle):
    rng = random.Random(9)
    passage = " ".join(rng.choices(WORDS, k=60))
    rows = [r for r in dict(mixed).items() if r[0] is not None]
    rows += [(400 + i, " ".join(rng.choices(WORDS, k=rng.randint(0, 30))) + "\n" + passage + " " + " ".join(rng.choices(WORDS, k=5))) for i in range(30)]
    rows += [(500, "a " * 200), (501, "a " * 50), (502, "x" * 3_000_000 + " tail"), (-3, passage)]
    got = substring_dedup.remove_repeated_passages(docs(spark, rows), block_bytes=block, bucket_windows=bucket, coarse_bits=coarse, settle_windows=settle).collect()
    want = removed(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
        assert sum(s["last"] - s["first"] for s in r.removed) == r.n_removed
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("run", [exact_dedup.exact_duplicates, exact_dedup.keep_largest, simhash.near_duplicate_classes, simhash.keep_representatives, substring_dedup.remove_repeated_passages])
def test_empty_tables(spark, run):
    assert run(docs(spark, [])).count() == 0


def thue_morse(n):
    """Two different words of n bytes that polynomial hashes modulo 2**64 cannot tell apart."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    a, b = thue_morse(n)
    rows = [(1, " ".join([*WORDS[:12], a])), (2, " ".join([*WORDS[:12], b])), (3, " ".join([*WORDS[:12], b]))]
    got = substring_dedup.remove_repeated_passages(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), (3, 13)]


def test_word_hashes_tell_words_apart():
    from tapeworks.llm import _tokens
    import pyarrow as pa

    words = sorted({"x" * k for k in range(1, 300)} | {f"{a}{k}" for a in ("", "word-", "a-very-long-prefix-of-a-word-") for k in range(5000)} | set(thue_morse(512)))
    for salt in (0, 1):
        raw, at = _tokens.buffers(pa.array([" ".join(words[:7000]), None, "", " ".join(words[7000:])]))
        starts, ends, _ = _tokens.word_spans(raw, at)
        hashes = _tokens.word_hashes(raw, starts, ends, salt)
        assert len(set(hashes.tolist())) == len(words)
        alone = [_tokens.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), salt)[0] for w in words[::997]]
        assert hashes[::997].tolist() == [int(h) for h in alone]


def test_key_bytes_follow_the_size():
    assert [substring_dedup.key_bytes(n) for n in (0, 1, 1e6, 1e9, 1e12, 1e14, 1e30)] == [10, 10, 10, 10, 13, 15, 16]


def test_sizes_are_of_the_text_and_not_of_an_estimate(spark, sf_dir):
    """A join's estimate is a product; the work is dealt by what the texts hold."""
    from tapeworks.llm._util import text_bytes

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = sum(len((r.text or "").encode()) for r in table.select("text").collect())
    labelled = table.join(spark.read.parquet(f"{sf_dir}/labels.parquet").hint("merge"), "doc_id", "left").drop("quality", "toxic")
    assert text_bytes(table, "text") == text_bytes(labelled, "text") == held
    whole = sorted(map(tuple, substring_dedup.remove_repeated_passages(table, with_text=False).select("doc_id", "n_removed", "kept_sha256").collect()))
    joined = substring_dedup.remove_repeated_passages(labelled, with_text=False).select("doc_id", "n_removed", "kept_sha256")
    assert joined.rdd.getNumPartitions() <= 256
    assert sorted(map(tuple, joined.collect())) == whole


def test_null_ids_in_passages(spark):
    text = " ".join(WORDS[:20])
    got = substring_dedup.remove_repeated_passages(docs(spark, [(None, text), (1, text), (None, None)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 20), (True, 0), (True, 0)]


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def test_near_copies_against_brute_force(spark, mixed):
    """The pipeline's stage leaves one document of every class of similarity 0.8, and all others."""
    import corpus_pipeline

    rng = random.Random(12)
    wide = [f"v{i}" for i in range(2000)]
    rows = [r for r in dict(mixed).items() if r[0] is not None]
    for c in range(40):
        base = rng.choices(wide, k=rng.randint(20, 300))
        for k in range(5):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                words[rng.randrange(len(words))] = rng.choice(wide)
            rows.append((1000 + 10 * c + k, " ".join(words).upper() if k == 1 else "\n".join(words)))
    # A chain, the smallest id of which is near to its neighbour only.
    base = rng.choices(wide, k=400)
    rows += [(2000 + k, " ".join(base[20 * k :] + base[: 20 * k])) for k in range(4)] + [(2010 + k, " ".join(base[30 * k : 30 * k + 280])) for k in range(5)]
    sets = [(i, shingle_set(t)) for i, t in sorted(rows)]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j, len(a & b) / len(a | b)) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if a & b]
    for i, j, s in pairs:
        if s >= 0.8:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    frame = docs(spark, [*rows, (None, rows[-1][1]), (1000, dict(rows)[1000])])
    kept = near_copies.keep_distinct(frame)
    assert kept.columns == ["doc_id", "text", "lang", "keep_id", "fp"]
    got = [r.doc_id for r in kept.collect()]
    want = {i for i in parent if find(i) == i}
    assert set(got) == want | {None} and len(got) == len(want) + 2
    assert any((simhash.fingerprint(dict(rows)[i]) ^ simhash.fingerprint(dict(rows)[j])).bit_count() > 3 for i, j, s in pairs if s >= 0.8)
    assert {r.doc_id for r in corpus_pipeline.near(spark, frame, "").collect()} == set(got)
    assert near_copies.keep_distinct(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block_shingles,block_rows", [(1 << 18, 1024), (400, 1024), (1 << 18, 5), (300, 3)])
def test_large_keys_are_compared_in_full(spark, block_shingles, block_rows):
    """Families of borderline copies: no link is lost, however keys are cut into blocks."""
    rng = random.Random(block_rows)
    wide = [f"v{i}" for i in range(3000)]
    rows = []
    for c in range(4):
        base = rng.choices(wide, k=120)
        for k in range(40):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(wide)
            rows.append((100 * c + k, " ".join(words)))
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in near_copies.near_copy_classes(docs(spark, rows), block_shingles=block_shingles, block_rows=block_rows).collect()}
    assert {i: got.get(i, i) for i in sets} == {i: find(i) for i in sets}
    assert len(set(map(find, sets))) > 8  # families fall into several classes


def test_common_shingles_of_many(monkeypatch):
    monkeypatch.setattr(near_copies, "SLICE", 7)
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(0, 40))), np.int64) for _ in range(30)]
    got = near_copies._common(sets[:12], sets[12:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in map(np.ndarray.tolist, sets[12:])] for a in map(np.ndarray.tolist, sets[:12])]


def test_keep_representatives(spark, mixed):
    """The smallest id of every class stays, and rows without an id."""
    rows = [*mixed, (310, "long " * 200_000), (311, "long " * 200_000 + "tail")]
    root = components([fingerprint(t) for _, t in rows], 3)
    least = {}
    for i, t in rows:
        if i is not None:
            r = root[fingerprint(t)]
            least[r] = min(i, least.get(r, i))
    kept = simhash.keep_representatives(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "keep_id", "fp"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, t in rows if i is None or i in least.values()), key=str)
