"""Results against plain versions: tiktoken, regular expressions, full dynamic
programmes, every-pair searches, DuckDB, and held-out labels."""

import base64
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pytest
import regex

import corpus_pipeline
from assayflow.llm import bpe, catalog, decontaminate, language, near_dedup, pii, quality, sharding, toxicity
from assayflow.llm.common import connected_components, joined_components, table
from tests.conftest import SF001, SF01


# ----------------------------------------------------------------- SQL twins
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    ours = catalog.QUERIES[name](spark, SF001)
    theirs = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=key) == sorted(theirs.fetchall(), key=key)


# -------------------------------------------------------------------- op3
def test_wand_finds_what_scoring_every_item_finds(spark):
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in table(spark, SF001, "benchmark").collect()]
    index = decontaminate.Index(items)
    rng = random.Random(4)
    for _ in range(60):
        words = rng.sample(sorted(index.terms), 25) + rng.choice(items)[1][:rng.randint(3, 40)]
        query = np.unique([index.terms[w] for w in words])
        score = np.zeros(len(items))
        for t in query:
            at = slice(index.start[t], index.start[t + 1])
            score[index.docs[at]] += index.weights[at]
        want = {int(d): score[d] for d in np.nonzero(score >= 1 - 1e-9)[0]}
        got = dict(index.wand(query))
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)


def test_quoted_items_are_found(spark):
    items = table(spark, SF01, "benchmark").collect()
    docs = table(spark, SF01, "documents").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.query(spark, SF01).collect()}
    assert want and want <= got and len(got - want) <= 2


def test_edited_and_truncated_quotes_are_found(spark):
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in table(spark, SF001, "benchmark").collect()]
    index = decontaminate.Index(items)
    rng = random.Random(13)
    filler = [f"filler{i}" for i in range(2000)]
    found = lambda quote, start: {m[0] for m in index.matches(" ".join(filler[:start] + quote + filler[start:]))}
    for item, words in items:
        n, start = len(words), rng.randint(0, 400)
        quotes = [words[:i] + x + words[i + 1:] for i in range(n) for x in ([], ["edit"], [words[i], "edit"])]
        quotes += [words[:n - k] for k in range(1, n // 5 + 1)] + [words[k:] for k in range(1, n // 5 + 1)]
        quotes += [["edit" if i in (n // 6, n // 2, n - 3) else w for i, w in enumerate(words)]] * (n >= 20)
        cut = len(decontaminate.split_item(words)[0])
        quotes += [words[:cut] + filler[:300] + words[cut:]]
        assert all(item in found(q, start) for q in quotes), words
        assert item not in found(words[:cut], start) and item not in found(words[cut:], start)
        shuffled = rng.sample(words, n)
        assert item not in found(shuffled, start)


def test_alignment_of_an_item_equals_the_full_one():
    rng = random.Random(14)
    for _ in range(300):
        item, text = ([rng.randint(0, 4) for _ in range(rng.randint(1, n))] for n in (9, 14))
        want = min(_distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        whole, first, rest = decontaminate.aligned(np.array(item), np.array(text), len(item) // 2)
        assert abs(whole - (1 - want / len(item))) < 1e-9 and 0 <= first <= 1 and 0 <= rest <= 1


def test_parts_of_the_index_do_not_change_what_is_found(spark):
    """BM25 counts and windows are those of all items, one long item included."""
    benchmark = table(spark, SF001, "benchmark").select("item_id", "text")
    long_item = " ".join(f"lone{i}" for i in range(300))
    benchmark = benchmark.unionByName(spark.createDataFrame([(10_000, long_item)], benchmark.schema)).repartition(3)
    docs = table(spark, SF001, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, f"before {long_item} after")], "doc_id long, text string"))
    found = [sorted(map(tuple, decontaminate.contaminated(docs, benchmark, part_items=n).collect())) for n in (7, 40, 4096)]
    assert found[0] == found[1] == found[2]
    assert {item for doc, item, *_ in found[0] if doc == -1} == {10_000}
    assert len(found[0]) > 1


def test_items_are_counted_over_the_whole_benchmark(spark):
    rows = [(1, "a b c a"), (2, "b c"), (3, None), (4, ""), (5, "c " * 65), (5, "c " * 65)]
    got = {(r.item_id, r.stride, tuple(sorted((t.word, t.n) for t in r.seen)))
           for r in decontaminate.counted_items(spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert got == {(1, 64, (("a", 1), ("b", 2), ("c", 4))), (2, 64, (("b", 2), ("c", 4))), (5, 128, (("c", 4),))}
    assert [decontaminate.stride_of(n) for n in (1, 64, 65, 128, 129)] == [64, 64, 128, 128, 256]


def test_long_texts_are_walked_in_stretches(spark, monkeypatch):
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in table(spark, SF001, "benchmark").collect()]
    index = decontaminate.Index(items)
    words = [w for i in range(0, len(items), 3) for w in [f"filler{i}"] * 50 + items[i][1]]
    whole = index.matches(" ".join(words))
    monkeypatch.setattr(decontaminate, "WINDOWS", 3)
    assert whole and index.matches(" ".join(words)) == whole


# -------------------------------------------------- learned: held-out accuracy
def test_held_out_accuracy(spark):
    labels = {r.doc_id: r for r in table(spark, SF01, "labels").collect()}
    langs = {r.doc_id: r.lang for r in table(spark, SF01, "documents").select("doc_id", "lang").collect()}
    predicted = [r for r in language.query(spark, SF01).collect() if r.held_out]
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in predicted]) > 0.97
    scored = [(r.predicted, labels[r.doc_id].quality) for r in quality.query(spark, SF01).collect()
              if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in scored]) > 0.9
    toxic = [(r.toxic, labels[r.doc_id].toxic) for r in toxicity.query(spark, SF01).collect()
             if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in toxic]) > 0.85


def test_words_seen_once_and_rare_languages_are_learned(spark):
    """Every word is new, one language is rare, and no level of frequency fits."""
    rng = random.Random(5)
    letters = {"aa": "abcdefgh", "bb": "qrstuvwx", "rare": "\u0915\u0916\u0917\u0918"}
    rows = []
    for i in range(400):
        lang = "rare" if i % 50 == 0 else "aa" if i % 2 else "bb"
        words = ["".join(rng.choice(letters[lang]) for _ in range(14)) for _ in range(60)]
        if lang == "rare":  # a combining mark belongs to its word
            words = [w[:3] + "\u093f" + w[3:] for w in words]
        rows.append((i, " ".join(words), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.language_table(docs).collect()}
    assert len(got) == 400 and all(got[i].lang_pred == lang for i, _, lang in rows)


def test_language_scores_equal_plain_ones(spark):
    """Word-first backoff computed word by word from counts, one language at a
    time; without a letter a text is und."""
    docs = table(spark, SF01, "documents").limit(300)
    model = language.learn(docs)
    counts = {}
    for r in docs.collect():
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", r.text.lower()):
                for size in (0, 4, 3, 2, 1):
                    marked = f"_{w}_"
                    for key in [w] if not size else [marked[i:i + size] for i in range(len(marked) - size + 1)]:
                        own = counts.setdefault(size, {}).setdefault(r.lang, {})
                        own[key] = own.get(key, 0) + 1
    assert sorted(counts[0]) == list(model.languages)
    keys = {size: set().union(*by.values()) for size, by in counts.items()}
    total = {(size, lang): sum(own.values()) + 0.1 * len(keys[size])
             for size, by in counts.items() for lang, own in by.items()}

    def plain(text, lang):
        score = 0.0
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
            marked, found, size = f"_{w}_", [w] if w in keys[0] else [], 0
            for size in () if found else (4, 3, 2, 1):
                found = [g for i in range(len(marked) - size + 1) if (g := marked[i:i + size]) in keys[size]]
                if found:
                    break
            score += sum(math.log((counts[size][lang].get(k, 0) + 0.1) / total[size, lang]) for k in found) / max(1, len(found))
        return score

    texts = [r.text for r in docs.limit(40).collect() if r.text] + ["Xylophonique zzyzx unheard", "q\u0301 \u00fc\u00df \u4e2d\u6587"]
    for text in texts:
        scores = {lang: plain(text, lang) for lang in model.languages}
        if not regex.search(r"\p{L}", text):
            continue
        lang, p = model.score(text)
        assert scores[lang] >= max(scores.values()) - 1e-6
        assert p == pytest.approx(1 / sum(math.exp(s - scores[lang]) for s in scores.values()), rel=1e-6)
    for none in (None, "", "\u00bd \u2167 \u00b2 42 _", "\u0301"):
        assert model.score(none) == ("und", 0.0)


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 12)) < 0.3).astype(np.float32)
    first = x[:, 0] * (rng.random(600) < 0.9)
    y = np.stack([first, np.maximum(first, x[:, 1])], axis=1)
    chain = toxicity.Chain(("a", "b"), {f"={i}": i for i in range(12)}).fit(x, y, np.arange(600) % 3)
    p = chain.predict(x)
    assert chain.models[1].shape == (14,) and chain.models[1][13] > 0
    assert ((p[:, 1] > 0.5) == (y[:, 1] > 0)).mean() > 0.9


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.grow(x, y)

    def walk(row, t, node=0, depth=0):
        if depth == quality.DEPTH:
            return forest.value[t, node]
        right = row[forest.feature[t, node]] > forest.threshold[t, node]
        return walk(row, t, 2 * node + 1 + right, depth + 1)

    z = np.array([forest.base + sum(walk(r, t) for t in range(quality.TREES)) for r in x[:50]])
    np.testing.assert_allclose(forest.predict(x[:50]), 1 / (1 + np.exp(-z)))
    assert ((forest.predict(x) > 0.5) == (y > 0)).mean() > 0.97


# -------------------------------------------------------------------- op6
def test_ids_equal_tiktoken(spark):
    import public_tokenizers as public
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(bpe.TOKENIZER), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    alphabet = "aeiostn  \n\t'.,;!?0159éßñ漢字🙂  　\x1c\x85ABC"
    texts = ["", " ", "don't we'll I'D 's", "a" * 300, "    x\n\n  y  ", "<|endoftext|>", "naïve café 3.14"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    texts += [r.text for r in table(spark, SF001, "documents").limit(30).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.round_trip(docs, bpe.read_ranks(spark)).collect():
        assert list(r.ids) == coder.encode_ordinary(texts[r.doc_id]), texts[r.doc_id]
        assert bytes(r.decoded) == texts[r.doc_id].encode()


# -------------------------------------------------------------------- op7
def test_curve_visits_every_cell_by_unit_steps():
    for bits, dims in ((1, 2), (3, 2), (2, 3), (4, 3)):
        index = sharding.hilbert_indexes(bits, dims)
        assert sorted(index) == list(range(1 << (bits * dims)))
        cells = np.argsort(index)
        at = np.stack([(cells >> (bits * i)) & ((1 << bits) - 1) for i in range(dims)], axis=1)
        assert (np.abs(np.diff(at, axis=0)).sum(axis=1) == 1).all()


# -------------------------------------------------------------------- op9
def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _base_spans(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if lo <= len(digits) <= hi and (kind == 3 or _luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return sorted(out)


def test_base_spans_equal_plain_expressions(spark):
    rng = random.Random(6)
    texts = ["a@b.c_x@d.e", "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1111-",
             "+1 (017) 555-7713+44 20 7946 0958", "9" * 20000, "a" * 20000 + "@", "é漢🙂 x@y.zz 10.0.0.1",
             "5 4 3 " + "1-" * 3000, "a@" + "b." * 4000 + "c"]
    texts += ["".join(rng.choice("01234567 .-+()@ab%_é") for _ in range(rng.randint(5, 120))) for _ in range(400)]
    texts += [r.text for r in table(spark, SF001, "documents").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.span_table(docs).collect():
        want = _base_spans(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_classifier_adds_spans_without_a_context_word(spark):
    texts = [f"x user{i}@example.com y +1 (212) 555-01{i:02d} z" for i in range(40)]
    texts += ["jane [at] example [dot] com", "(212) 555-0199", "1234 5678 9012 3456 and 300.1.1.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.span_table(docs).collect()}
    assert (spans[40], spans[41], spans[42]) == ("email:0:27", "phone:0:14", "")


def test_reliable_labelers_outweigh_a_noisy_one():
    patterns = [((1, 1, 1, -1, 1), 500), ((0, 0, 0, -1, 1), 400), ((0, 0, 0, -1, 0), 100), ((1, 1, 1, -1, 0), 90)]
    post = pii.reliabilities(patterns)
    assert post[0] > 0.95 and post[3] > 0.9 and post[1] < 0.1 and post[2] < 0.05


# -------------------------------------------------------------------- op10
def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_banded_alignment_equals_the_full_one():
    rng = random.Random(7)
    for _ in range(1500):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 16))]
        b = list(a) if rng.random() < 0.6 else [rng.randint(0, 4) for _ in range(rng.randint(0, 16))]
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = [rng.randint(0, 4)] * rng.randint(0, 2)
        most, want = rng.randint(0, 9), _distance(a, b)
        got = near_dedup.banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), most)
        assert got == min(want, most + 1)


def test_no_link_between_texts_is_lost(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(30, 300))] for _ in range(25)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for words in base:
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(copy)
    texts += [passage + [f"u{rng.randint(0, 10**6)}" for _ in range(60)] for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    of = {r.doc_id: r.class_id for r in near_dedup.class_table(docs).collect()}
    grams = [set(zip(*[t[i:] for i in range(5)])) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            share = len(grams[i] & grams[j]) / len(grams[i] | grams[j])
            if share >= 0.8:
                assert of[i] == of[j]
            elif not share:
                assert of[i] != of[j]
    assert len({of[i] for i in range(len(texts) - 120, len(texts))}) == 120


def test_workers_hold_few_texts_and_words():
    import pyarrow as pa
    import xxhash
    known = {}
    words = [f"w{i}" for i in range(3 * near_dedup.KNOWN)]
    hashes = near_dedup._word_hashes(words, known)
    assert len(known) <= near_dedup.KNOWN and hashes[-1] == xxhash.xxh3_64_intdigest(words[-1])
    texts = ["One two", None, "", "one, two three"] * near_dedup.TEXTS
    batch = pa.RecordBatch.from_pydict({"node": pa.array([b"%d" % i for i in range(len(texts))]), "text": pa.array(texts)})
    packed = list(near_dedup._packed(iter([batch])))
    assert max(map(len, packed)) <= near_dedup.TEXTS and sum(map(len, packed)) == len(texts)
    cells = pa.Table.from_batches(packed).combine_chunks().column("words").combine_chunks()
    want = [near_dedup._word_hashes(near_dedup.WORD.findall((t or "").lower()), {}).tobytes() for t in texts]
    assert cells.to_pylist() == want
    pairs = pa.RecordBatch.from_pydict({"a": [b"1", b"2"], "b": [b"3", b"4"], "words_a": pa.array([want[0], want[0]]),
                                        "words_b": pa.array([want[3], want[4]])})
    kept = list(near_dedup._alike(iter([pairs.slice(1), pairs])))
    assert [k.to_pydict() for k in kept] == [{"a": [b"2"], "b": [b"4"]}] * 2


LEAN_WORKER = """
import re, sys
import pyarrow as pa
from assayflow.llm import bpe, near_dedup
from assayflow.llm.common import give_back

def megabytes():
    told = open("/proc/self/smaps_rollup").read()
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", told))) / 1024

def batches(path):
    with open(path, "rb") as stream, pa.ipc.open_stream(stream) as reader:
        yield from reader

def write(path, columns):
    one = pa.RecordBatch.from_pydict(columns)
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_stream(sink, one.schema) as out:
        out.write_batch(one)
        out.write_batch(one)

text, n, folder = " ".join("abcdefgh"[i % 8] * 108 for i in range(30)), 8000, sys.argv[1]
ids = pa.array(range(n))
write(folder + "/near", {"doc_id": ids, "k1": ids, "k2": ids, "node": pa.array([b"x"] * n), "text": pa.array([text] * n)})
write(folder + "/bpe", {"whole": ids, "joined": pa.array([text.replace(" ", " \\x1e")] * n), "apart": pa.nulls(n, pa.list_(pa.string()))})
for path, worker in (("near", near_dedup._signed), ("near", near_dedup._packed), ("bpe", bpe._index_words)):
    for again in range(3):
        if again == 1:          # what a worker loads once does not count
            give_back()
            before = megabytes()
        for out in worker(batches(folder + "/" + path)):
            pass
        del out
    assert megabytes() - before < 12, (worker.__name__, round(megabytes() - before))
"""


def test_an_idle_worker_keeps_no_batch(tmp_path):
    """Two batches of 27 MB, read from a stream as Spark's workers do."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])
    ran = subprocess.run([sys.executable, "-c", LEAN_WORKER, str(tmp_path)], env=os.environ | {"PYTHONPATH": paths},
                         capture_output=True, text=True, timeout=300)
    assert not ran.returncode, ran.stderr[-1000:]


def test_what_workers_return_holds_no_batch():
    """A batch lies in one piece, which any of its columns would hold."""
    import pyarrow as pa
    ids, n = pa.array(range(600)), 600
    columns = {"doc_id": ids, "k1": ids, "k2": ids, "node": pa.array([b"x"] * n), "text": pa.array(["some words"] * n),
               "whole": ids, "joined": pa.array(["some \x1ewords\x1e"] * n), "apart": pa.nulls(n, pa.list_(pa.string()))}
    one = pa.RecordBatch.from_pydict(columns)
    given = {b.address for c in one.columns for b in c.buffers() if b is not None}
    for worker, names in ((near_dedup._signed, ["doc_id", "k1", "k2", "text"]), (near_dedup._packed, ["node", "text"]),
                          (bpe._index_words, ["whole", "joined", "apart"])):
        batch = one.select(names)
        out = list(worker(iter([batch])))
        kept = {"doc_id", "node", "whole"} & set(names) & set(out[0].schema.names)
        assert kept
        for name in kept - ({"node"} if worker is near_dedup._signed else set()):
            got = pa.concat_arrays([o.column(name) for o in out]).drop_null()
            assert got.equals(batch.column(name))
            assert not given & {b.address for o in out for b in o.column(name).buffers() if b is not None}


def test_a_repeated_shingle_changes_no_other_label(spark):
    rng = random.Random(10)
    page = [f"w{rng.randint(0, 5000)}" for _ in range(1000)]
    again = page + page[200:212]
    a, b = (near_dedup.labelled(near_dedup.shingles(near_dedup._word_hashes(t, {}))) for t in (page, again))
    assert set(a) < set(b) and len(b) == len(set(b)) == 1008
    loses = page[:204] + ["edit"] + page[205:] + page[600:612]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((page, again, loses))], "doc_id long, text string")
    assert {r.class_id for r in near_dedup.class_table(docs).collect()} == {0}


def test_word_pairs_never_rule_out_an_alike_pair():
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        a = [rng.randint(0, 30) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(b) // 4))):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = [rng.randint(0, 30)] * rng.randint(0, 2)
        texts += [np.array(t, np.uint64) for t in (a, b) if t]
    may = near_dedup.may_be_alike(texts, texts)
    like = np.array([[near_dedup.alike(a, b) for b in texts] for a in texts])
    assert like.sum() > len(texts) and not (like & ~may).any() and may.sum() < may.size / 4


def test_both_passes_link_what_aligns(spark):
    rng = random.Random(12)
    texts, pairs = [], []
    for _ in range(40):
        a = [f"p{i}" for i in range(30)] + [f"w{rng.randint(0, 10**6)}" for _ in range(70)]
        b = [f"edit{rng.randint(0, 10**6)}" if i >= 30 and i % 5 == 0 else w for i, w in enumerate(a)]
        pairs.append((len(texts), len(texts) + 1))
        texts += [a, b]
    texts += [[f"p{i}" for i in range(30)] + [f"u{rng.randint(0, 10**6)}" for _ in range(70)] for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    of = {r.doc_id: r.class_id for r in near_dedup.class_table(docs).collect()}
    hashes = [near_dedup._word_hashes(t, {}) for t in texts]
    sketch = [near_dedup.sketches(h) for h in hashes]
    want = [(a, b) for a, b in pairs if (sketch[a] == sketch[b]).any()]
    assert len(want) > 10 and all(near_dedup.alike(hashes[a], hashes[b]) and of[a] == of[b] for a, b in want)
    assert len(set(of.values())) == len(texts) - len(want)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(300, 200)]
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100}
    assert got[300] == got[200] == 200
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    more = [(rng.randrange(330), rng.randrange(330)) for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links + more:
        root[max(find(a), find(b))] = min(find(a), find(b))
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = joined_components(connected_components(frame(links)), frame(more)).collect()
    assert all(r.component == find(r.node) for r in got)
    assert {r.node for r in got} == {x for p in links + more for x in p if p[0] != p[1]}


# ----------------------------------------------------------------- pipeline
def test_pipeline_keeps_clean_documents(spark):
    docs = table(spark, SF01, "documents")
    n = docs.count()
    seen = [n]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF01).cache()
        seen.append(docs.count())
    assert seen[1] >= 0.85 * n                     # toxic documents are a tenth
    assert seen[0] > seen[1] > seen[2] > seen[3] > seen[4] == seen[5]
    assert {"doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"} == set(docs.columns)
    texts = {r.doc_id: r.text for r in table(spark, SF01, "documents").collect()}
    for r in docs.limit(50).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
