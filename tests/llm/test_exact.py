"""Operators with an exact contract against brute force: on a small corpus with edge cases, on sf0.001, and on an empty table."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from gridverity.llm import embeddings, fingerprints, packing, pieces, sharding, simhash, substrings, suffixes, xxh

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BIG = 2**63


def raw(t):
    return (t or "").encode()


@pytest.fixture(scope="module", params=["corner", "sf0.001", "repeated ids"])
def corpus(request, texts, docs_of, spark, sf_dir):
    if request.param == "sf0.001":
        d = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
        return list(zip(d.doc_id, d.text)), spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    pairs = texts if request.param == "corner" else [(i // 2, t) for i, t in texts] + [(None, texts[5][1]), (None, None), (3, texts[6][1]), texts[8], texts[8]]
    return pairs, docs_of(pairs).repartition(3)


def key(i):
    return BIG if i is None else i


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def removed(pairs, units, n):
    """For each document the units it loses, by looking at all windows."""
    seen = [units(t) for _, t in pairs]
    first = {}
    for (i, _), u in zip(pairs, seen):
        for j in range(len(u) - n + 1):
            w = u[j : j + n] if isinstance(u, bytes) else tuple(u[j : j + n])
            first[w] = min(first.get(w, BIG), key(i))
    for (i, _), u in zip(pairs, seen):
        mask = np.zeros(len(u), bool)
        for j in range(len(u) - n + 1):
            if first[u[j : j + n] if isinstance(u, bytes) else tuple(u[j : j + n])] < key(i):
                mask[j : j + n] = True
        yield i, u, mask


def test_substrings(corpus):
    pairs, df = corpus
    want = [(i, len(u), int(m.sum()), b" ".join(x for x, gone in zip(u, m) if not gone).decode()) for i, u, m in removed(pairs, lambda t: WORD.findall(raw(t)), 13)]
    assert rows_of(substrings.deduplicate(df), "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=repr)


def test_suffixes(corpus):
    pairs, df = corpus
    want = []
    for i, u, m in removed(pairs, raw, 50):
        runs = int((m[1:] & ~m[:-1]).sum() + (len(m) > 0 and m[0]))
        want.append((i, len(u), int(m.sum()), runs, bytearray(np.frombuffer(u, np.uint8)[~m].tobytes())))
    got = rows_of(suffixes.deduplicate(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert [tuple(map(repr, g[:4])) + (bytes(g[4]),) for g in got] == [tuple(map(repr, w[:4])) + (bytes(w[4]),) for w in sorted(want, key=repr)]


def simhash_of(t):
    w = WORD.findall(raw(t).lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(corpus):
    pairs, df = corpus
    fp = [simhash_of(t) for _, t in pairs]
    label = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for x, (i, _) in zip(label, pairs):
        least[x] = min(least.get(x, BIG), key(i))
    want = [(i, f"{f:016x}", None if least[x] == BIG else least[x]) for (i, _), f, x in zip(pairs, fp, label)]
    assert rows_of(simhash.simhash_groups(df), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(least)


@pytest.mark.parametrize("split", [simhash.SPLIT_ROWS, 4])
@pytest.mark.parametrize("crowd", [False, True])
def test_simhash_links_any_close_pair(spark, monkeypatch, split, crowd):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    if crowd:  # all share most of their bits
        base = base & np.uint64(0x0000FF000000F00F) | np.uint64(0x123400567890)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)) for b in base for k in (1, 2, 3, 4)]
    fp = np.unique(np.array([*map(int, base), *near], np.uint64))
    df = spark.createDataFrame([(int(x), k) for k, x in enumerate(fp.view(np.int64))], "fp long, k long")
    from gridverity.llm.components import components

    monkeypatch.setattr(simhash, "SPLIT_ROWS", split)
    got = {r.node.fp: r.root.fp for r in components(simhash.fingerprint_links(df)).collect()}
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    label = np.arange(len(fp))
    while True:
        new = np.array([label[row].min() for row in close])
        if (new == label).all():
            break
        label = new
    ours = [got.get(int(x), int(x)) for x in fp.view(np.int64)]
    assert len(set(zip(ours, label))) == len(set(ours)) == len(set(label))


def test_components_of_a_long_chain(spark):
    from gridverity.llm.components import components

    rng = np.random.default_rng(2)
    order = rng.permutation(200)
    links = [(int(a), int(b)) for a, b in zip(order[:-1], order[1:])] + [(500, 501), (501, 501), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_xxh64():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 3000, dtype=np.uint8)
    start = rng.integers(0, 2500, 2000)
    end = start + rng.integers(0, 200, 2000)
    assert [int(x) for x in xxh.xxh64(buf, start, end, 42)] == [xxhash.xxh64_intdigest(buf[a:b].tobytes(), 42) for a, b in zip(start, end)]


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, need = int(rng.integers(1, 300)), int(rng.integers(1, 60))
        t = rng.integers(1, int(rng.integers(2, 6)), n).astype(np.int16)
        t[rng.random(n) < 0.05] = 0
        rank = suffixes.suffix_ranks(t, need)
        order = np.argsort(rank)
        pad = np.concatenate([t, np.zeros(need, np.int16)])
        heads = [tuple(pad[i : i + need]) for i in order]
        assert sorted(rank) == list(range(n)) and all(a <= b for a, b in zip(heads, heads[1:]))


def test_fingerprints(corpus):
    pairs, df = corpus
    if any(i is None for i, _ in pairs) or len({i for i, _ in pairs}) < len(pairs):
        # null ids come first; rows of one id are in the order of a hash of their texts, the greatest first
        from pyspark.sql import functions as F

        hashed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
        order = sorted(hashed, key=lambda r: (-key(r.doc_id), -r.h))
        want = []
        for r, n in zip(order, [*order[1:], order[0]]):
            half = len(r.text) // 2
            want.append((r.doc_id, len(r.text), hashlib.sha256((r.text[: len(r.text) - half] + n.text[:half]).encode()).hexdigest()))
        got = fingerprints.fingerprint_documents(df).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
        return
    down = sorted(pairs, key=lambda p: -p[0])
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(WORD.findall(raw(t)))
    likeness = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df).collect()}
    errors = []
    by_text = {}
    for (i, t), (_, nxt) in zip(down, [*down[1:], down[0]]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, n = shingles(t), shingles(edited), shingles(nxt)
        assert len(r.sketch) == min(128, len(a)) and by_text.setdefault(t, r.sketch) == r.sketch
        errors += [r.near_edited - likeness(a, b), r.near_next - likeness(a, n)]
        if max(len(a | b), len(a | n)) <= 128:
            assert abs(errors[-1]) < 1e-9 and abs(errors[-2]) < 1e-9
    assert np.std(errors) < 0.05 and np.abs(errors).max() < 0.25


def test_hot_ids_are_divided(spark):
    """Half of the rows have no id, some have one id: these too are dealt to several intervals, in order."""
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, fingerprints.NO_ID).when(F.col("id") % 8 == 1, 77).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("h"))
    got = fingerprints.with_cells(rows, "k", "h", "cell").toPandas()
    assert got.groupby("cell").size().max() < 4000 / 16
    cells = got.sort_values(["k", "h"]).cell.to_numpy()
    assert (np.diff(cells) >= 0).all()


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    h = [int(x) for x in rng.integers(-(2**63), 2**63, 5000)]
    parts = [(k % 2, sorted(h[i : i + 1500])[:128]) for k, i in enumerate(range(0, 3500, 500))]
    df = spark.createDataFrame(parts, "g int, sketch array<bigint>")
    got = {r.g: r.sketch for r in fingerprints.merged(df, "g").collect()}
    for g in (0, 1):
        assert got[g] == sorted({x for k, s in parts if k == g for x in s})[:128]
    two = spark.createDataFrame([(sorted(h[:3000])[:128], sorted(h[1000:5000])[:128])], "a array<bigint>, b array<bigint>")
    r = two.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_count(F.col("a")).alias("n")).first()
    assert abs(r.j - 0.4) < 0.15 and abs(r.c - 2 / 3) < 0.2 and abs(r.n - 3000) < 900


def test_packing(corpus):
    from tokenizers import Tokenizer

    pairs, df = corpus
    tok = Tokenizer.from_file(packing.vocabulary())
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in pairs]
    got = packing.pack_documents(df).toPandas()
    assert got.length.sum() == sum(len(x) for _, x in ids)
    # each id lies in one piece: a document's pieces are gapless from 0 (rows of one doc_id and length are told apart by counting)
    places = {}
    for r in got.itertuples():
        places.setdefault((None if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens), []).append((r.start, r.length))
    copies = {}
    for i, x in ids:
        copies[i, len(x)] = copies.get((i, len(x)), 0) + 1
    assert set(places) == set(copies)
    for (doc, n), found in places.items():
        cover = np.zeros(n + 1, int)
        for start, length in found:
            assert 0 <= start and 0 < length and start + length <= n
            cover[start] += 1
            cover[start + length] -= 1
        assert (np.cumsum(cover)[:n] == copies[doc, n]).all()
    bags = {}
    for i, x in ids:
        bags.setdefault(i, []).append(x)
    for r in got.itertuples():
        doc = None if r.doc_id != r.doc_id else int(r.doc_id)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in bags[doc])
    sizes = got.groupby("sequence_id").length.sum()
    assert list(sizes.index) == list(range(len(sizes))) and (sizes[:-1] == 2048).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()


def test_packer_is_bounded():
    rng = np.random.default_rng(0)
    p = packing.Packer(64, 4)
    total = 0
    for d in range(500):
        n = int(rng.integers(1, 150))
        total += n
        p.add(d, np.arange(n, dtype=np.uint32))
        assert len(p.windows) <= 4
    p.close()
    assert sum(len(x[2]) for _, _, x in p.out) == total
    full = {}
    for seq, at, x in p.out:
        full[seq] = full.get(seq, 0) + len(x[2])
    assert all(v == 64 for k, v in full.items() if k is not None) and full.get(None, 0) < 64


def test_pieces(corpus, texts):
    import sentencepiece

    pairs, df = corpus
    path = pieces.vocabulary()
    odd = ["x" + " " * n + "y" for n in range(1, 45)] + [" " * n for n in range(20)] + ["▁ a▁b", "\x00 \x01", "<s> <0x41>"]
    assert pieces.parity(path, [t or "" for _, t in texts] + odd) == []
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.decode_documents(pieces.encode_documents(df)).collect()
    assert len(got) == len(pairs)
    for r in got:
        want = np.array(theirs.encode(r.text or ""), "<u4")
        assert r.n_ids == len(want) and r.ids_crc32 == zlib.crc32(want.tobytes()) and r.decoded == theirs.decode(want.tolist())


def thue_morse(n):
    """Two strings of 2**n letters whose polynomial hashes modulo 2**64 are equal, whatever the base (n >= 10)."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [10, 12])
def test_equal_hashes_are_not_equal_strings(docs_of, n):
    from tokenizers import Tokenizer

    from gridverity.llm.blocks import equal_spans, prefix_hashes, span_hashes

    a, b = thue_morse(n)
    data = np.frombuffer((a + b + a + b).encode(), np.uint8)
    start = np.arange(4) * len(a)
    prefix, inverse = prefix_hashes(data)
    h = span_hashes(prefix, inverse, start, start + len(a))
    assert h[0] == h[1]  # they do collide
    first, back = equal_spans(data, start, start + len(a), h)
    assert len(first) == 2 and back[0] == back[2] != back[1] == back[3]
    tail = " ".join(f"w{i}" for i in range(12))
    pairs = [(0, f"{a} {tail}"), (1, f"{b} {tail}"), (2, f"{b} {tail}"), (3, f"x {a} y"), (4, f"x {b} y"), (5, f"{b}é<{a}"), (6, f"{a}é<{b}")]
    df = docs_of(pairs)
    assert pieces.parity(pieces.vocabulary(), [t for _, t in pairs]) == []
    tok = Tokenizer.from_file(packing.vocabulary())
    for r in packing.pack_documents(df).collect():
        ids = np.array([*tok.encode(pairs[r.doc_id][1], add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    got = {r.doc_id: (r.n_removed, r.kept) for r in substrings.deduplicate(df).collect()}
    want = {i: (int(m.sum()), b" ".join(x for x, gone in zip(u, m) if not gone).decode()) for i, u, m in removed(pairs, lambda t: WORD.findall(raw(t)), 13)}
    assert got == want and got[1][0] == 0 and got[2][0] == 13
    got = {r.doc_id: bytes(r.kept) for r in suffixes.deduplicate(df).collect()}
    assert got == {i: np.frombuffer(u, np.uint8)[~m].tobytes() for i, u, m in removed(pairs, raw, 50)}


@pytest.mark.parametrize("case", ["corner", "boilerplate"])
def test_hot_minimisers_change_no_result(docs_of, texts, monkeypatch, case):
    """Windows of hot minimisers go one by one; here all that two sampled documents have are hot."""
    import random

    from gridverity.llm import spans

    monkeypatch.setattr(spans, "HOT_PARTS", 0)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    line = " ".join(word() for _ in range(20))
    boiler = [(i, " ".join([*(word() for _ in range(rng.randrange(30))), line, *(word() for _ in range(rng.randrange(30)))])) for i in range(60)]
    pairs = texts if case == "corner" else boiler
    df = docs_of(pairs).repartition(3)
    sample = [raw(t) for _, t in pairs if len(t or "") >= 8]
    assert len(spans.hot_minimisers(sample, 13, 3, substrings.word_units(3), 1)) and len(spans.hot_minimisers(sample, 50, 8, suffixes.byte_units(8), 1))
    got = {r.doc_id: r.n_removed for r in substrings.deduplicate(df).collect()}
    assert got == {i: int(m.sum()) for i, _, m in removed(pairs, lambda t: WORD.findall(raw(t)), 13)}
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffixes.deduplicate(df).collect()}
    assert got == {i: (int(m.sum()), np.frombuffer(u, np.uint8)[~m].tobytes()) for i, u, m in removed(pairs, raw, 50)}


def _proto(*fields):
    """A protobuf message of (number, value): str and bytes are length-delimited, float is fixed32, int is a varint."""
    import struct

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_model(tmp_path, spark, byte_fallback):
    """Scores of a Unigram model decide: a small model written here, against the sentencepiece library."""
    import random

    import sentencepiece

    rng = random.Random(2)
    subwords = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))) for _ in range(60)})
    normal = [(w, -rng.uniform(4, 9)) for w in [*subwords, *(pieces.MARK + w for w in subwords[:25])]] + [(c, -rng.uniform(9, 12)) for c in "abcdefgé,." + pieces.MARK]
    listed = [_proto((1, "<unk>"), (2, 0.0), (3, 2)), _proto((1, "<s>"), (2, 0.0), (3, 3)), _proto((1, "</s>"), (2, 0.0), (3, 3))]
    listed += [_proto((1, f"<0x{i:02X}>"), (2, 0.0), (3, 6)) for i in range(256)] if byte_fallback else []
    listed += [_proto((1, w), (2, s), (3, 1)) for w, s in normal]
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(_proto(*[(1, p) for p in listed], (2, _proto((3, 1), (35, int(byte_fallback)))), (3, _proto((1, "identity"), (3, 1), (4, 0), (5, 1)))))
    model = pieces.PieceModel.read(path)
    assert model.unigram and dict(zip(model.pieces, model.scores))[normal[0][0]] == pytest.approx(normal[0][1], abs=1e-6)
    texts = ["", "a", " ", "abc abcde, cab.", "a  b   c", "".join(rng.choice("abcdefg ,.é") for _ in range(300)), *(" ".join(rng.choice(subwords) for _ in range(20)) for _ in range(30))]
    texts += ["日本 abc", "abz<é"] if byte_fallback else []
    assert pieces.parity(path, texts) == []
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.decode_documents(pieces.encode_documents(df, path), path).collect():
        want = theirs.encode(r.text)
        assert r.n_ids == len(want) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes()) and r.decoded == theirs.decode(want)


def test_sharding(corpus):
    pairs, df = corpus
    got = sharding.shard_documents(df).toPandas()
    assert len(got) == len(pairs)
    assert sorted(zip(got["size"], got.text_crc32)) == sorted((len(raw(t)) + 1, zlib.crc32(raw(t))) for _, t in pairs)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert set(got.shard) <= set(range(8)) and ((got.grown_shard == got.shard) | (got.grown_shard == 8)).all()


def test_hash_tree_shares_and_moves(spark):
    from pyspark.sql import functions as F

    tree = sharding.Tree((((1.0, 2.0), (1.0,)), ((4.0,),)))
    heavy = sharding.Tree((((1.0, 2.0), (3.0,)), ((4.0,),)))
    df = spark.range(40000).select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavy).alias("b")).toPandas()
    share = df.a.value_counts(normalize=True)
    assert [round(share[i], 2) for i in range(4)] == pytest.approx([1 / 8, 2 / 8, 1 / 8, 4 / 8], abs=0.02)
    moved = df[df.a != df.b]
    assert not (moved.b == 3).any() and not ((moved.a < 2) & (moved.b < 2)).any()  # only into the region that grew


def brute_links(v, threshold=0.95):
    x = np.array(v, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T >= threshold


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    rows = [*base, *(base[:60] + rng.normal(size=(60, 16)) * 0.08), *base[:20], *(base[5] + rng.normal(size=(40, 16)) * 0.05)]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None, *[1.0] * 15]), (1005, [1.0, 2.0]), (1006, [1.0, 2.0]), (None, vectors[0][1]), (1007, [float("inf"), *[1.0] * 15])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.embedding_groups(df).collect()}
    link = brute_links([v for _, v in vectors])
    n = link.sum(1) - 1 + link[:, 0]  # the row without an id is a copy of the first
    label = np.arange(len(rows))
    while True:
        new = np.array([label[r].min() for r in link])
        if (new == label).all():
            break
        label = new
    assert all(got[i].n_links == n[i] for i, _ in vectors)
    assert all(got[i].component_id == label[i] for i, _ in vectors)
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1007))
    assert got[1005].n_links == got[1006].n_links == 1 and got[1006].component_id == 1005 and not got[1006].kept
    assert not got[None].kept and got[None].component_id == got[0].component_id


@pytest.mark.parametrize("kind", ["clusters", "between centroids", "copies"])
@pytest.mark.parametrize("block", [embeddings.BLOCK_BYTES, 1 << 11])
def test_embedding_cells_miss_no_link(spark, kind, block, monkeypatch):
    """The operator as registered, but for smaller cells: 20 of them and more, and several blocks each."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(embeddings, "CELL_SIZE", 20)
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", block)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "clusters":
        rows = np.concatenate([x + rng.normal(size=(50, 8)) * 0.25 for x in rng.normal(size=(10, 8))])
    elif kind == "copies":
        rows = np.concatenate([np.repeat(rng.normal(size=(30, 8)), 9, axis=0), rng.normal(size=(250, 8))])
        rows[::3] += rng.normal(size=rows[::3].shape) * 0.01
    else:  # pairs that differ along the line from one centre to another, at every place between them
        c = unit(rng.normal(size=(6, 8)))
        rows = [c[i] + rng.normal(size=8) * 0.02 for i in range(6) for _ in range(20)]
        for _ in range(200):
            i, j = rng.choice(6, 2, replace=False)
            s = rng.uniform(0.3, 0.7)
            p = unit((c[i] * (1 - s) + c[j] * s)[None])[0]
            d = unit((c[j] - c[i])[None])[0]
            rows += [p, p + d * rng.uniform(0.29, 0.33)]
        rows = np.array(rows)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_groups(df).collect()}
    link = brute_links(rows)
    label = np.arange(len(rows))
    while True:
        new = np.array([label[r].min() for r in link])
        if (new == label).all():
            break
        label = new
    want = link.sum(1) - 1
    assert want.sum() > 100
    assert [got[i][0] for i in range(len(rows))] == want.tolist()
    assert [got[i][1] for i in range(len(rows))] == label.tolist()


def test_empty_tables(docs_of, spark):
    none = docs_of([])
    for f in (substrings.deduplicate, suffixes.deduplicate, simhash.simhash_groups, simhash.keep_one, packing.pack_documents, sharding.shard_documents, fingerprints.fingerprint_documents, lambda d: pieces.decode_documents(pieces.encode_documents(d))):
        assert f(none).count() == 0
    assert embeddings.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
