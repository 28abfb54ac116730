"""Token-id output with Re-Pair grammars (operator 13).

Texts become token ids with a public tokenizer, an end id follows each. The
documents are sorted by id over ranges, so every sorted partition is a run of
the whole sequence; a task cuts its run into shards of ``SHARD_IDS`` ids (a
long document spans several) and compresses each shard by itself: as long as
some pair of neighbouring ids is frequent, the frequent pairs are replaced by
nonterminals, the more frequent of two overlapping ones first. A shard stores
its rules, the expansion length of every nonterminal and the remaining
sequence, so any stretch of ids is found by summed lengths and only the
nonterminals that cover it are expanded. Shards are rows of a Parquet folder
with a binary cell each: Spark's writer commits them, so a lost executor
leaves no half file. Nothing but one row per partition is gathered to number
the ids.

The tokenizer works on words between white space, so each distinct word of a
batch is encoded once by the library and its ids are put in place by index;
words that differ in upper and lower case alone are one. A Python worker loads
the tokenizer once for all its tasks.

Defined results: NULL text counts as empty and holds the end id alone; NULL
doc_id sorts first; rows with equal doc_id follow one another by the hash of
their text, each with ids of its own; texts of any length are encoded whole;
extra columns are ignored; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import functools
import importlib
import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayflow.llm.common import materialize, table
from assayflow.session import table_path

TOKENIZER = "word_bpe_49k.json"
#: The id that ends each document (fixed by the contract).
END_ID = 2
#: Ids of a shard, and the fewest replacements that pay for a rule.
SHARD_IDS, LEAST_USES = 1 << 17, 16
#: Multiplier and bits of the hash that counts pairs roughly.
HASH, HASH_BITS = -7046029254386353131, 17
#: Bytes of text whose distinct words are encoded together, and the words of
#: letters that are handed to the tokenizer as one text.
STEP_BYTES, TOGETHER = 1 << 24, 64
# White space and, after one of these letters, marks at which the
# tokenizer's words end whatever surrounds them (Latin and Cyrillic letters that
# stay letters in lower case and normal form).
WHITE, MARKS = "\t\n\r", ".,;:!?#$%&*)"
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017F\u0400-\u045F"
MAGIC = 0x52505231


# -------------------------------------------------------------------- Re-Pair
def compress(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (one row left, right per nonterminal, numbered from ``first``),
    expansion lengths of the nonterminals, and the remaining sequence.

    A round replaces the pairs within a sixteenth of the most frequent one.
    Hashed counts, never below the true ones, tell which places can hold such
    a pair; only those are sorted and counted exactly."""
    seq = ids.astype(np.int64)
    rules: list[np.ndarray] = []
    lengths, reach = np.ones(first, dtype=np.int64), 16
    while len(seq) > 1:
        codes = (seq[:-1] << 32) | seq[1:]
        bucket = (codes * HASH >> (64 - HASH_BITS)) & ((1 << HASH_BITS) - 1)
        near = np.bincount(bucket, minlength=1 << HASH_BITS)[bucket]
        least = max(LEAST_USES, int(near.max()) // reach)
        at = np.flatnonzero(near >= least)
        order = np.argsort(codes[at])
        ordered = codes[at][order]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(at) else np.empty(0, dtype=bool)
        starts = np.flatnonzero(new)
        counts = np.diff(np.r_[starts, len(ordered)])
        by_count = np.argsort(-counts, kind="stable")
        common = int((counts >= least).sum())
        rank_of = np.empty(len(starts), dtype=np.int64)
        rank_of[by_count] = np.arange(len(starts))
        own = np.empty(len(at), dtype=np.int64)
        own[order] = rank_of[np.cumsum(new) - 1]
        # a pair goes where neither overlapping pair is more frequent; in a
        # run of one id every second pair does
        ranks = np.full(len(codes) + 2, len(starts), dtype=np.int64)
        ranks[at + 1] = own
        before, after = ranks[at], ranks[at + 2]
        run = np.maximum.accumulate(np.where(own != before, at, 0))
        goes = (own < common) & (own <= before) & (own <= after) & ((at - run) % 2 == 0)
        good = np.bincount(own[goes], minlength=common) >= LEAST_USES
        if not good.any():
            if least == LEAST_USES:
                break
            reach *= 4
            continue
        goes[goes] = good[own[goes]]
        pairs = ordered[starts][by_count[:common]][good]
        made = np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)
        rules.append(made)
        seq[at[goes]] = (np.cumsum(good) - 1 + len(lengths))[own[goes]]
        lengths = np.append(lengths, lengths[made[:, 0]] + lengths[made[:, 1]])
        keep = np.ones(len(seq), dtype=bool)
        keep[at[goes] + 1] = False
        seq = seq[keep]
    return np.concatenate([np.empty((0, 2), dtype=np.int64), *rules]), lengths[first:], seq


def expand(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids of a stretch of a compressed sequence."""
    while len(seq) and seq.max() >= first:
        nonterminal = seq >= first
        width = 1 + nonterminal
        out = np.repeat(seq, width)
        at = (np.cumsum(width) - width)[nonterminal]
        out[at], out[at + 1] = rules[seq[nonterminal] - first].T
        seq = out
    return seq


def pack(ids: np.ndarray, first: int) -> bytes:
    """One shard: a header of six 32-bit numbers (format, first nonterminal,
    ids, rules, symbols, bytes a symbol), rules, lengths, symbols."""
    rules, lengths, seq = compress(ids, first)
    kind = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
    head = np.array([MAGIC, first, len(ids), len(rules), len(seq), int(kind[2])], dtype="<u4")
    return b"".join([head.tobytes(), rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(),
                     seq.astype(kind).tobytes()])


class Shard:
    """Random access to the ids of a packed shard."""

    def __init__(self, blob: bytes):
        magic, self.first, self.n_ids, n_rules, n_seq, width = map(int, np.frombuffer(blob, "<u4", 6))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        kind, at = f"<u{width}", 24
        self.rules = np.frombuffer(blob, kind, 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
        at += 2 * n_rules * width
        lengths = np.frombuffer(blob, "<u4", n_rules, at).astype(np.int64)
        self.seq = np.frombuffer(blob, kind, n_seq, at + 4 * n_rules).astype(np.int64)
        sizes = np.ones(n_seq, dtype=np.int64)
        nonterminal = self.seq >= self.first
        sizes[nonterminal] = lengths[self.seq[nonterminal] - self.first]
        self.ends = np.cumsum(sizes)

    def read(self, at: int, n: int) -> np.ndarray:
        """``n`` ids from place ``at``; only the symbols that cover them are
        expanded."""
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        low, high = np.searchsorted(self.ends, [at, at + n - 1], side="right")
        skipped = at - (int(self.ends[low - 1]) if low else 0)
        return expand(self.seq[low:high + 1], self.rules, self.first)[skipped:skipped + n]


# ------------------------------------------------------------------- encoding
class Encoder:
    """A tokenizer, and one without the steps that leave lower-case words in
    normal form as they are."""

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        load = importlib.import_module("tokenizers").Tokenizer.from_str
        self.tokenizer = load(config)
        plain = json.loads(config)
        steps = plain["pre_tokenizer"]["pretokenizers"]
        if [n["type"] for n in plain["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or \
                [t["type"] for t in steps] != ["Split", "ByteLevel"]:
            raise ValueError("not the tokenizer that the split into words is made for")
        plain["normalizer"] = None
        plain["pre_tokenizer"]["pretokenizers"] = [{"type": "WhitespaceSplit"}, steps[1]]
        self.plain = load(json.dumps(plain))
        # the last id of a word, and no other, has the suffix (no word of letters holds it)
        vocab, suffix = plain["model"]["vocab"], plain["model"]["end_of_word_suffix"]
        if not suffix or sum(len(v) == 1 + len(suffix) and v.endswith(suffix) for v in vocab) != 256:
            raise ValueError("not a tokenizer that marks where each word ends")
        self.is_last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.is_last[[i for v, i in vocab.items() if v.endswith(suffix)]] = True

    def words(self, words: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of distinct words, and the place of each word's ids. A
        word of simple letters in lower case is one word of the tokenizer, so
        many make one text; all others are texts of their own."""
        simple = pc.match_substring_regex(words, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(words.filter(pa.array(simple))).dictionary_encode()
        letters = lower.dictionary.to_pylist()
        joined = [" ".join(letters[i:i + TOGETHER]) for i in range(0, len(letters), TOGETHER)]
        flat = [np.empty(0, dtype=np.uint32)]
        for at in range(0, len(joined), TOGETHER):      # few encodings are held at a time
            batch = self.plain.encode_batch_fast(joined[at:at + TOGETHER], add_special_tokens=False)
            flat += [np.array(e.ids, dtype=np.uint32) for e in batch]
        flat = [np.concatenate(flat)]
        sizes = np.diff(np.flatnonzero(self.is_last[flat[0]]), prepend=-1)
        others = words.filter(pa.array(~simple)).to_pylist()
        own = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        flat.append(np.fromiter(itertools.chain.from_iterable(own), dtype=np.uint32))
        sizes = np.r_[sizes, np.fromiter(map(len, own), dtype=np.int64, count=len(own))]
        place = np.empty(len(words), dtype=np.int64)
        place[simple] = lower.indices.to_numpy()
        place[~simple] = len(letters) + np.arange(len(others))
        return pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), np.concatenate(flat)), place

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, end ids included, and the end of each text."""
        for white in WHITE:
            texts = pc.replace_substring(texts, white, " ")
        parts = pc.split_pattern(pc.replace_substring_regex(texts, f"([{LETTERS}])([{MARKS}])", r"\1 \2"), " ")
        coded = parts.flatten().dictionary_encode()
        lists, place = self.words(coded.dictionary)
        # the end id is one more word, put after the last word of each text
        lists = pa.concat_arrays([lists, pa.array([[end_id]], lists.type)])
        last = np.cumsum(pc.list_value_length(parts).to_numpy())
        index = np.insert(place[coded.indices.to_numpy()], last, len(lists) - 1)
        found = lists.take(pa.array(index))
        ends = np.cumsum(pc.list_value_length(found).to_numpy(), dtype=np.int64)[last + np.arange(len(last))]
        return found.flatten().to_numpy(), ends


@functools.lru_cache(maxsize=1)
def _encoder(config: str) -> Encoder:
    """The encoder of a worker, kept for its later tasks."""
    return Encoder(config)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``STEP_BYTES`` bytes, one at least."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, done + STEP_BYTES, side="right")))
        yield at, end
        at, done = end, int(size[end - 1])


def read_tokenizer(path: str | None = None) -> str:
    """The configuration of a tokenizer, a local parameter of the driver."""
    with open(path or importlib.import_module("public_tokenizers").path(TOKENIZER), encoding="utf-8") as f:
        return f.read()


# ------------------------------------------------------------------ the files
DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))
SHARDS = ("part int, shard int, at long, n long, blob binary, "
          "docs array<struct<doc_id:long,at:long,n:long>>, open_at long")


def write_shards(docs: DataFrame, path: str, config: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all documents, ascending by doc_id.

    A row per shard: ``part`` and ``shard`` order the files, ``at`` and ``n``
    are the shard's first place in its part and its number of ids, ``blob``
    the grammar, ``docs`` the documents that start in it (place in the part
    and number of ids), ``open_at`` the place of the document that goes on
    from the shard before, else NULL."""
    first = _vocabulary(config)

    shared = docs.sparkSession.sparkContext.broadcast(config)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, shard, begin, place = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []
        started: list[dict] = []
        open_at, encoder = None, _encoder(shared.value)

        def full() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([begin], pa.int64()),
                pa.array([len(ids)], pa.int64()), pa.array([pack(ids, first)], pa.binary()),
                pa.array([started], DOCS), pa.array([open_at], pa.int64())],
                ["part", "shard", "at", "n", "blob", "docs", "open_at"])

        for batch in batches:
            for low, high in _slices(batch.column(1)):
                flat, ends = encoder.texts(batch.column(1).slice(low, high - low), end_id)
                names = batch.column(0).slice(low, high - low).to_pylist()
                for doc_id, i, j in zip(names, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                    start = place
                    started.append({"doc_id": doc_id, "at": start, "n": j - i})
                    while i < j:
                        k = min(j, i + shard_ids - (place - begin))
                        held.append(flat[i:k])
                        place, i = place + k - i, k
                        if place - begin == shard_ids:
                            yield full()
                            shard, begin, held, started = shard + 1, place, [], []
                            open_at = start if i < j else None
        if held:
            yield full()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("tie"),
                       F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(cut, SHARDS).write.parquet(path))


def _vocabulary(config: str) -> int:
    """The first number that is no id of the tokenizer."""
    tokenizer = importlib.import_module("tokenizers").Tokenizer.from_str(config)
    return max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, lowest power in the
    highest bit."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc32(pieces: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation from (crc32, bytes) of its pieces."""
    crc = 0
    for own, size in pieces:
        shift, power = 1 << 31, 1 << 23        # x^0 and x^8
        while size:
            if size & 1:
                shift = _times(shift, power)
            power, size = _times(power, power), size >> 1
        crc = _times(crc, shift) ^ own
    return crc


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    files = spark.read.schema(SHARDS).parquet(path)
    kind = "part int, at long, doc_id long, n_tokens long, shard int, crc long, size long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begin, end, out = row["at"], row["at"] + row["n"], []
                data = Shard(row["blob"]).read(0, row["n"]).astype("<u4")
                if row["open_at"] is not None:
                    stop = min([d["at"] for d in row["docs"]] + [end])
                    out.append((row["open_at"], None, None, begin, stop))
                out += [(d["at"], d["doc_id"], d["n"], d["at"], min(d["at"] + d["n"], end)) for d in row["docs"]]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(out), pa.int32()), "at": pa.array([o[0] for o in out], pa.int64()),
                    "doc_id": pa.array([o[1] for o in out], pa.int64()), "n_tokens": pa.array([o[2] for o in out], pa.int64()),
                    "shard": pa.array([row["shard"]] * len(out), pa.int32()),
                    "crc": pa.array([zlib.crc32(data[o[3] - begin:o[4] - begin].tobytes()) for o in out], pa.int64()),
                    "size": pa.array([4 * (o[4] - o[3]) for o in out], pa.int64())})

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([joined_crc32([(p["crc"], p["size"]) for p in own]) for own in parts])

    read = files.select("part", "shard", "at", "n", "blob", "docs", "open_at").mapInArrow(pieces, kind)
    read = materialize(read)
    whole = F.coalesce(F.col("size") == 4 * F.col("n_tokens"), F.lit(False))
    # a document across shards: one small row per shard it touches
    long = read.filter(~whole).groupBy("part", "at").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("shard", "crc", "size"))).alias("own")).select(
        "part", "at", "doc_id", "n_tokens", joined("own").alias("crc"))
    found = read.filter(whole).select("part", "at", "doc_id", "n_tokens", "crc").union(long)
    # one row per partition of the sort
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return found.join(materialize(before), "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, f"token-shards-{uuid.uuid4().hex}")
    write_shards(table(spark, sf_dir, "documents"), path, read_tokenizer())
    return read_documents(spark, path)
