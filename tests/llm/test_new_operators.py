"""Manifest, whitening and token shards against plain versions, and on edges."""

import base64
import hashlib
import importlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.llm import bpe, merkle, token_shards, whitening
from assayflow.llm.common import positions

# ------------------------------------------------------------------- manifest


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _tree(nodes):
    """(root, list of sibling paths) of a list of nodes."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            low = p // 8 * 8
            paths[i].append(("".join(level[low:p]), "".join(level[p + 1:low + 8])))
            at[i] = p // 8
        level = [_h("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


@pytest.mark.parametrize("sizes", [(1,), (8, 9), (64, 1, 65), (511, 513), (4100, 2)])
def test_manifest_equals_a_plain_tree(spark, sizes):
    groups = [None, "b", "ä"][:len(sizes)]
    rows = [(g, i, _h(f"{g}{i}")) for g, n in zip(groups, sizes) for i in range(n)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "g string, i long, node string").repartition(3)
    got = {(r.g, r.i): r for r in merkle.manifest(df, F.col("g"), F.col("i"), F.col("node"), g=F.col("g"), i=F.col("i")).collect()}
    trees = {g: _tree([r[2] for r in rows if r[0] == g]) for g in groups}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, over = _tree([trees[g][0] for g in order])
    assert len(got) == len(rows)
    for g, i, _ in rows:
        r = got[g, i]
        assert (r.subroot, r.root) == (trees[g][0], root)
        assert [(bytes(s.left).decode(), bytes(s.right).decode()) for s in r.path] == trees[g][1][i] + over[order.index(g)]


def test_manifest_on_edges(edge, empty):
    docs = edge.withColumn("n_chars", F.length("text"))
    rows = merkle.manifest_table(docs).collect()
    assert len(rows) == docs.count() and len({r.root for r in rows}) == 1
    for r in rows:
        touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        assert r.verified or touched
    texts = {r.doc_id: r.text for r in docs.collect()}
    changed = {i for i, t in texts.items() if i is not None and zlib.crc32(str(i).encode()) % 3 == 0
               and t and any("A" <= c <= "Z" for c in t)}
    assert {r.doc_id for r in rows if not r.verified} == changed
    assert merkle.manifest_table(empty.withColumn("n_chars", F.lit(1))).count() == 0


def test_positions_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.lit(1).alias("k"), "id").repartition(7)
    rows = positions(df, "g", ["k", "id"]).collect()
    for g in "012":
        assert [r.pos for r in sorted((r for r in rows if r.g == g), key=lambda r: r.id)] == list(range(sum(r.g == g for r in rows)))


# ------------------------------------------------------------------ whitening
@pytest.mark.parametrize("n", [1, 2, 7, 64])
@pytest.mark.parametrize("kind", ["random", "equal", "wide", "zeros", "one"])
def test_qdwh_eigen_equals_lapack(n, kind):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {"random": rng.random(n), "equal": np.ones(n), "wide": 10.0 ** -rng.integers(0, 13, n),
              "zeros": (rng.random(n) > .5) * 1.0, "one": np.r_[1e6, np.ones(n - 1)]}[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.eigen(a)
    size = max(np.linalg.norm(a, 2), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-13 and np.abs(v.T @ a @ v - np.diag(e)).max() <= 1e-13 * size


def test_whitening_equals_numpy_and_handles_edges(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((300, 40)).astype(np.float32) @ rng.standard_normal((40, 40)).astype(np.float32)
    good = [(i, v.tolist(), i) for i, v in enumerate(vectors)] + [(None, vectors[0].tolist(), 1), (3, vectors[3].tolist(), 1)]
    bad = [(900, None, 1), (901, [1.0] * 39 + [None], 1), (902, [float("nan")] * 40, 1), (903, [float("inf")] * 40, 1),
           (904, [], 1), (905, [1.0, 2.0], 1)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, component int").repartition(5)
    rows = whitening.whitening_table(df).collect()
    x = np.floor(64 * np.array([v for _, v, _ in good], dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    cov = y.T @ y / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    assert len(rows) == 32 * n and {r.component for r in rows} == set(range(1, 33)) and {r.n for r in rows} == {n}
    assert max(r.identity_error for r in rows) < 1e-9
    got = {(r.vec_id, r.component): r for r in rows}
    deviation = ((n * x - s) ** 2).sum(axis=1)
    for k in range(1, 33):
        ours = np.array([got[i, k].whitened for i, _, _ in good[:300]])
        want = y[:300] @ vec[:, k - 1] / np.sqrt(e[k - 1])
        assert min(np.abs(ours - want).max(), np.abs(ours + want).max()) < 1e-8
        assert abs(got[0, k].explained - e[k - 1] / e.sum()) < 1e-12
    assert all(got[i, 1].deviation == deviation[i] for i in range(300))
    assert whitening.whitening_table(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    assert whitening.whitening_table(same).count() == 0


# --------------------------------------------------------------- token shards
@pytest.mark.parametrize("ids", [[], [5], [1] * 1001, [1, 2] * 500, [1, 1, 2] * 400, list(range(300)),
                                 list(np.random.default_rng(0).zipf(1.3, 20000) % 49408)])
def test_shards_expand_and_read_at_random(ids):
    ids = np.array(ids, dtype=np.int64)
    shard = token_shards.Shard(token_shards.pack(ids, 49408))
    rng = random.Random(2)
    assert (shard.read(0, len(ids)) == ids).all()
    for _ in range(60):
        at = rng.randint(0, len(ids))
        n = rng.randint(0, len(ids) - at)
        assert (shard.read(at, n) == ids[at:at + n]).all()


def test_frequent_pairs_become_rules():
    ids = np.array([7, 8, 9, 7, 8] * 400)
    rules, lengths, seq = token_shards.compress(ids, 100)
    assert len(rules) >= 3 and len(seq) < 60 and lengths.max() > 20
    assert (token_shards.expand(seq, rules, 100) == ids).all()


def test_joined_crc32():
    data = random.Random(3).randbytes(1000)
    pieces = [data[:10], data[10:10], data[10:501], data[501:]]
    assert token_shards.joined_crc32([(zlib.crc32(p), len(p)) for p in pieces]) == zlib.crc32(data)


ODD = ["a<|endoftext|>b", "it's. don't!'s", "İstanbul İ. ÀÉ é. ≠ word.́x", "a\x1cc", "ΣΑΣ. ας", "한국어. 中文,混合",
       "...!!'s't", "tab\there\r\nnew", "", "   ", "ª º ǅ. ʰ"]


def test_texts_are_encoded_as_the_library_does():
    rng = random.Random(1)
    pool = list("aB éÉ.,;:!?'\"#$%&*()<|>1٢\t\nŕ̸  İΣςσǅ한中\x1c_-")
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    config = token_shards.read_tokenizer()
    library = importlib.import_module("tokenizers").Tokenizer.from_str(config)
    import pyarrow as pa
    ids, ends = token_shards.Encoder(config).texts(pa.array(texts), 2)
    at = 0
    for t, end in zip(texts, ends, strict=True):
        assert ids[at:end].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]
        at = end


def test_a_worker_loads_the_tokenizer_once_and_encodes_a_word_of_any_case_once():
    config = token_shards.read_tokenizer()
    encoder = token_shards._encoder(config)
    assert token_shards._encoder(config) is encoder
    handed, plain = [], encoder.plain

    class Plain:
        def encode_batch_fast(self, texts, **how):
            handed.extend(w for t in texts for w in t.split(" "))
            return plain.encode_batch_fast(texts, **how)

    import pyarrow as pa
    try:
        encoder.plain = Plain()
        ids, ends = encoder.texts(pa.array(["Overword OVERWORD, éa", "overword Éa x1"]), 2)
    finally:
        encoder.plain = plain
    assert sorted(handed) == ["overword", "éa"]
    library = encoder.tokenizer
    assert ids[:ends[0]].tolist() == [*library.encode("Overword OVERWORD, éa", add_special_tokens=False).ids, 2]
    assert ids[ends[0]:].tolist() == [*library.encode("overword Éa x1", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("shard_ids", [token_shards.SHARD_IDS, 700])
def test_documents_read_back_from_the_files(spark, edge, empty, tmp_path, shard_ids):
    config = token_shards.read_tokenizer()
    library = importlib.import_module("tokenizers").Tokenizer.from_str(config)
    token_shards.write_shards(edge, f"{tmp_path}/s", config, shard_ids=shard_ids)
    rows = sorted(token_shards.read_documents(spark, f"{tmp_path}/s").collect(), key=lambda r: r.start)
    texts = {}
    for r in edge.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in edge.collect()), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in rows:
        coded = [np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4") for t in texts[r.doc_id]]
        assert r.start == start and (r.n_tokens, r.ids_crc32) in {(len(c), zlib.crc32(c.tobytes())) for c in coded}
        start += r.n_tokens
    token_shards.write_shards(empty, f"{tmp_path}/e", config)
    assert token_shards.read_documents(spark, f"{tmp_path}/e").count() == 0


# ------------------------------------------------------------- short and long words
def test_ranks_of_many_strings_and_short_words_equal_a_plain_map(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 301, b"abc": 302, b"\xc3\xa9": 303, b"aa": 304}
    table = spark.createDataFrame([(bytearray(k), v) for k, v in ranks.items()], "piece binary, rank int")
    rng = random.Random(5)
    words = ["".join(rng.choice("aabcé") for _ in range(rng.randint(2, 10))) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    with bpe.Constants(spark) as constants:
        _, of_all = bpe._rank_lookups(constants, table)
        b = df.word.cast("binary")
        halves = F.array(b, F.substring(b, 1, 2), F.substring(b, 2, 3), F.lit(b""))
        rows = df.select("word", of_all(halves).alias("found"), bpe.fold_short_word(b, of_all).alias("ids")).collect()
    for r in rows:
        w = r.word.encode()
        assert r.found == [ranks.get(x) for x in (w, w[:2], w[1:4], b"")]
        pieces = [w[i:i + 1] for i in range(len(w))]
        while len(pieces) > 1:
            best, at = min((ranks.get(x + y, 999), i) for i, (x, y) in enumerate(zip(pieces, pieces[1:])))
            if best == 999:
                break
            pieces[at:at + 2] = [pieces[at] + pieces[at + 1]]
        assert r.ids == [ranks[x] for x in pieces]


def test_short_words_whose_substrings_share_cells_equal_a_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(bpe, "RANK_CELLS", 256)   # most cells are shared, or hold another string's rank
    ranks = {bytes([b]): b for b in range(256)} | {
        p: 256 + i for i, p in enumerate([b"ab", b"bc", b"abc", b"cab", b"aa", b"aaaa", b"abcab", b"\xc3\xa9"])}
    assert bpe.ascending(ranks)
    table = spark.createDataFrame([(bytearray(k), v) for k, v in ranks.items()], "piece binary, rank int")
    rng = random.Random(7)
    words = ["".join(rng.choice("aabcé") for _ in range(rng.randint(1, 11))) for _ in range(300)] + ["a" * 22, "abc" * 7]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    with bpe.Constants(spark) as constants:
        found = bpe.Ranks(constants, table)
        cells = df.select(found.cell_of(F.col("word").cast("binary")).alias("cell")).distinct().collect()
        rows = df.select("word", found.rank_of(F.col("word").cast("binary")).alias("own"),
                         bpe.fold_short_word(F.col("word").cast("binary"), found).alias("ids")).collect()
    assert len(cells) > 2 and (-1,) in cells
    for r in rows:
        w = r.word.encode()
        assert r.own == ranks.get(w)
        pieces = [w[i:i + 1] for i in range(len(w))]
        while len(pieces) > 1:
            best, at = min((ranks.get(x + y, 999), i) for i, (x, y) in enumerate(zip(pieces, pieces[1:])))
            if best == 999:
                break
            pieces[at:at + 2] = [pieces[at] + pieces[at + 1]]
        assert r.ids == [ranks[x] for x in pieces]


def test_long_words_and_breaks_equal_tiktoken(spark):
    import tiktoken
    public = importlib.import_module("public_tokenizers")
    with open(public.path(bpe.TOKENIZER), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert bpe.ascending(ranks)
    assert not bpe.ascending({b"a": 0, b"b": 1, b"c": 2, b"bc": 4, b"abc": 3})   # bc would come too late
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [None, "", "a\x1eb c\x1e", "\x1e", "a" * 5000, "ab" * 3000 + " x", "é漢" * 2000, "=" * 3000,
             "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.round_trip(df, bpe.read_ranks(spark)).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded).decode() == text
