"""The pipeline's near-duplicate stage against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from gridverity.llm import common, near_duplicates, simhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall((t or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def brute(pairs):
    """Links as index pairs, and the least member of each document's component."""
    sets = [shingles(t) for _, t in pairs]
    links = [(i, j) for j in range(len(pairs)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = list(range(len(pairs)))
    for i, j in links:
        a, b = sorted((label[i], label[j]))
        if a != b:
            label = [a if x == b else x for x in label]
    return links, label


def edited(rng, n, edits):
    w = [f"w{rng.randrange(5000)}" for _ in range(n)]
    e = list(w)
    for at in rng.sample(range(n), edits):
        e[at] = f"x{rng.randrange(10**6)}"
    return " ".join(w), " ".join(e)


@pytest.fixture(scope="module")
def light_edits():
    """Pairs around the threshold; few edits of a long text, so most are between 0.7 and 0.95."""
    rng = random.Random(3)
    return [(2 * p + x, t) for p in range(150) for x, t in enumerate(edited(rng, 300, 2 + p % 9))]


def test_stage_finds_light_edits(spark, docs_of, light_edits):
    links, label = brute(light_edits)
    between = [(i, j) for i, j in links if likeness(shingles(light_edits[i][1]), shingles(light_edits[j][1])) < 0.9]
    assert len(between) >= 40 and len(links) < 150  # pairs below 0.8 stay whole
    df = docs_of(light_edits).repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()}
    assert kept == {light_edits[i][0] for i in set(label)}
    assert simhash.keep_one(df).count() > len(kept) + len(between) / 2  # three bits miss most of them


def test_stage_keeps_pairs_below_the_threshold(spark, docs_of):
    rng = random.Random(5)
    filler = " ".join(["z"] * 300)  # decides every bit of a fingerprint, and is one shingle
    pairs = [(i, filler + " " + edited(rng, 20, 1)[0]) for i in range(8)]
    assert max(likeness(shingles(a), shingles(b)) for i, (_, a) in enumerate(pairs) for _, b in pairs[:i]) < 0.8
    df = docs_of(pairs)
    assert simhash.keep_one(df).count() < len(pairs)  # some are within three bits
    assert corpus_pipeline.near_duplicate_stage(spark, df, "").count() == len(pairs)


@pytest.mark.parametrize("rows", [near_duplicates.GROUP_ROWS, 3])
def test_stage_against_brute_force(spark, sf_dir, docs_of, texts, rows, monkeypatch):
    monkeypatch.setattr(near_duplicates, "GROUP_ROWS", rows)
    if rows == 3:  # nothing is small enough to broadcast either
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    d = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    rng = random.Random(1)
    base = [f"c{rng.randrange(900)}" for _ in range(200)]
    chain = [" ".join(base[i : i + 150]) for i in range(0, 50, 7)]  # neighbours alike, ends not
    pairs = [*zip(d.doc_id.tolist(), d.text), *((10_000 + i, t) for i, t in texts), *((20_000 + i, t) for i, t in enumerate(chain)), *((30_000 + i, t) for i, t in enumerate(chain[:2]))]
    _, label = brute(pairs)
    df = docs_of(pairs).repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(pairs[i][0] for i in set(label))


def test_stage_on_odd_ids(spark, docs_of):
    pairs = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "q r s"), (3, "q r s"), (None, None), (None, "")]
    got = corpus_pipeline.near_duplicate_stage(spark, docs_of(pairs), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr)[:2] == [(3, "a b c d e f"), (3, "q r s")] and len(got) == 3
    assert corpus_pipeline.near_duplicate_stage(spark, docs_of([]), "").count() == 0


def test_stage_on_a_crowd_below_the_threshold(spark, docs_of, monkeypatch):
    """Many edited copies of one text: some pairs are links, most are not; blocks are small here."""
    monkeypatch.setattr(near_duplicates, "GROUP_ROWS", 7)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    pairs = []
    for i in range(90):
        e = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 7)):
            e[at] = f"x{rng.randrange(10**6)}"
        pairs.append((i, " ".join(e)))
    links, label = brute(pairs)
    assert 150 < len(links) < 2500 and len(set(label)) > 3
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs_of(pairs).repartition(3), "").collect()}
    assert got == {pairs[i][0] for i in set(label)}


def test_pivots_discard_members_before_their_sets_travel():
    """A block keeps what may be a link by size, pivots and fingerprints, of another root, and short texts whatever their bits."""
    one, far = np.uint64(0xF0F0), ~np.uint64(0xF0F0)
    place = np.array([1] * 5 + [2] * 3)
    guest = np.array([False, False, False, True, True, False, False, True])
    root = np.array([1, 2, 3, 4, 3, 5, 6, 7])
    n = np.array([100, 100, 300, 100, 300, 10, 50, 9])
    fp = np.array([one, far, one, one ^ np.uint64(7), one, far, one, one])
    got = near_duplicates.partners(place, guest, root, n, fp)
    assert got.tolist() == [True, False, False, True, False, True, False, True]


def test_blocks_verify_only_what_pivots_leave():
    x = np.arange(100, dtype=np.int64)
    root, guest = np.array([1, 2, 3]), np.array([False, False, True])
    one = np.uint64(5)
    i, j = near_duplicates.block_links(root, guest, np.array([one, ~one, one]), [x, x + 1, x + 2])
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(2, 0)]  # the second is as similar, but its fingerprint is not near
    assert len(near_duplicates.block_links(root, guest, np.array([one, one, one]), [x, x + 1, x + 2])[0]) == 2


def test_buckets_of_fingerprints_are_candidates(spark):
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 15 << 20), (5, 15 << 20)], "s long, fp long")
    got = {frozenset((r.a, r.b)) for r in near_duplicates._bucket_pairs(common.cut(nodes)).collect()}
    assert got == {frozenset((1, 2)), frozenset((1, 3)), frozenset((4, 5))}


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_blocks_go_on_in_the_next_batch(size):
    place = [1, 1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, 4]
    rows = pa.record_batch({"place": place, "x": list(range(len(place)))})
    out = list(near_duplicates._whole_blocks(rows.slice(i, size) for i in range(0, len(place), size)))
    assert [v for b in out for v in b.column("x").to_pylist()] == list(range(len(place)))
    assert all(not set(a.column("place").to_pylist()) & set(b.column("place").to_pylist()) for k, a in enumerate(out) for b in out[:k])


def test_blocks_of_long_texts_hold_few(spark, docs_of, monkeypatch):
    """Blocks are bounded by shingles too."""
    monkeypatch.setattr(near_duplicates, "GROUP_SHINGLES", 300)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    pairs = []
    for i in range(40):
        e = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 7)):
            e[at] = f"x{rng.randrange(10**6)}"
        pairs.append((i, " ".join(e)))
    _, label = brute(pairs)
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs_of(pairs).repartition(3), "").collect()}
    assert got == {pairs[i][0] for i in set(label)}
