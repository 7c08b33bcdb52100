"""Token ids in a byte-aligned variable-length store with separate control bytes.

Ids are renumbered by corpus frequency, so that the commonest 256 take one byte. A store is a folder with the table of ids by rank and
the table of blocks. A block holds the documents of a stretch of doc_id order: a control stream of two bits a value (its bytes less one,
four values a byte, each document from a byte of its own) and a data stream of little-endian bytes. Decoding looks the lengths of four
values up by control byte, sums them to places and gathers; there is no loop over values. Both are Parquet tables, so the shared file
system and Spark's commit protocol carry them, and a reader needs nothing else.

Texts are tokenized once, into a written table of ids (two bytes each where the vocabulary allows). Ids are counted from it (a task
emits one row an id); only these counts, at most one row a vocabulary entry, pass through the driver. Then ranges of doc_id are dealt
out, and a task ranks and packs a block at a time.

Of a tokenizer with the normalizer and the pre-tokenizer below, the ids of a text are those of its runs in turn: runs of letters and
runs of other characters in blank-parted words of plain characters, and any other word as a whole. A slice's different runs are
found by Arrow, and a worker remembers the ids of up to `REMEMBERED` runs. Any other tokenizer encodes whole texts.

Defined cases: null and blank texts have the end id alone; null doc_ids come first; repeated rows are stored each; no rows
give no blocks; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafmill.llm import common
from sheafmill.llm.shingles import IS_BLANK, LOWER

END_ID = 2
BLOCK_IDS = 1 << 18
REMEMBERED = 800_000
ENCODED_AT_ONCE, JOINED = 20_000, 200
SLICE_BYTES = 4 << 20
# What a tokenizer does before its merges if runs may be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PARTS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
SPECIAL_BEGINS = "<|"
#: By byte: is it a plain ASCII character (no apostrophe), and is it in a letter; of two bytes, only those of Latin letters are plain.
PLAIN_ASCII = np.array([0x21 <= b <= 0x7E and b != 0x27 for b in range(256)])
IN_LETTER = np.array([0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LATIN_LEAD = 0xC3
LATIN_ENDS = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
LATIN_UPPER = np.array([0x80 <= b <= 0x9E and b != 0x97 for b in range(256)])
LOWERED = np.frombuffer(LOWER, np.uint8)
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One row a block of the store; broadcast up to so many, shuffled beyond.
BROADCAST_ROWS = 100_000
#: Bytes of each of four values, by control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1

BLOCKS = "shard int, block int, n_ids long, doc_ids array<long>, sizes array<long>, control binary, data binary"

_encoders: dict[str, WordEncoder] = {}


class Memory:
    """Ids of strings met so far, as places in flat arrays."""

    def __init__(self, kind: type) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(0, kind)
        self.starts = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int32)

    def add(self, new: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))

    def of(self, known: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known strings one after the other, and each one's number of ids."""
        at = np.fromiter(map(self.place.__getitem__, known), np.int32, len(known))
        return gathered(self.ids, self.starts[at], self.counts[at]), self.counts[at]


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of `values` from `starts` on, one after the other."""
    ends = np.cumsum(counts, dtype=np.int32)
    at = np.repeat(starts - ends + counts, counts)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


def run_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(values)])
    return np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])


def runs_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of blank-parted UTF-8 text: lower-cased bytes without blanks, and where in `raw` each run begins and ends."""
    blank = IS_BLANK[raw]
    edges = np.nonzero(np.diff(blank, prepend=True, append=True))[0]
    starts, ends = edges[::2], edges[1::2]
    after_lead = np.concatenate([[False], raw[:-1] == LATIN_LEAD])
    latin = after_lead & LATIN_ENDS[raw]
    plain = PLAIN_ASCII[raw] | latin
    plain[:-1] |= latin[1:]
    plain[:-1] &= ~((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
    low = LOWERED[raw]
    low[after_lead & LATIN_UPPER[raw]] += 0x20
    odd = np.nonzero(~(plain | blank))[0]
    odd_words = np.unique(np.searchsorted(starts, odd, "right") - 1)
    letter = IN_LETTER[low]
    inner = (letter[1:] != letter[:-1]) & ~blank[1:] & ~blank[:-1]
    for k in odd_words.tolist():  # stays whole and as it is
        inner[starts[k] : ends[k] - 1] = False
        low[starts[k] : ends[k]] = raw[starts[k] : ends[k]]
    begins, stops = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    begins[starts], stops[ends] = True, True
    begins[1:-1] |= inner
    stops[1:-1] |= inner
    return low[~blank], np.nonzero(begins)[0], np.nonzero(stops)[0]


class WordEncoder:
    """Ids of texts by their runs, or by whole texts where the tokenizer isn't known to allow it. Its memory is bounded, and outlives a task."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        spec = json.loads(self.tokenizer.to_str())
        special = all(t["content"].startswith(SPECIAL_BEGINS) for t in spec["added_tokens"])
        self.by_runs = special and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and not spec["truncation"]
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends_run = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self.runs = Memory(self.kind)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), self.kind), np.fromiter(map(len, found), np.int32, len(found))

    def of_runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different runs one after the other, and each one's number of ids."""
        new = [r for r in runs if r not in self.runs.place]
        if new and len(self.runs.place) + len(new) > REMEMBERED:
            self.runs, new = Memory(self.kind), runs
        for begin in range(0, len(new), ENCODED_AT_ONCE):
            some = new[begin : begin + ENCODED_AT_ONCE]
            words, others = [], []
            for r in some:
                (words if LETTERS.fullmatch(r) else others).append(r)
            self.runs.add(words, *self.encoded_words([r.decode() for r in words]))
            self.runs.add(others, *self.encoded([r.decode() for r in others]))
        return self.runs.of(runs)

    def encoded_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `encoded`, for runs of letters: many in one text, whose ids part where a word ends."""
        ids = self.encoded([" ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)])[0]
        ends = np.nonzero(self.ends_run[ids])[0] + 1
        if len(ends) != len(words) or (len(ids) and ends[-1] != len(ids)):
            return self.encoded(words)
        return ids, np.diff(ends, prepend=0).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and each text's number of ids."""
        if not self.by_runs:
            found = [self.encoded([t])[0] for t in pc.fill_null(texts, "").to_pylist()]
            return np.concatenate([x for ids in found for x in (ids, [END_ID])] or [[]]).astype(self.kind), np.array([len(x) + 1 for x in found], np.int64)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1  # with a blank behind each
        raw = np.frombuffer("\n".join([*pc.fill_null(texts, "").to_pylist(), ""]).encode(), np.uint8)
        letters, begins, stops = runs_of(raw)
        offsets = np.concatenate([[0], np.cumsum(stops - begins)]).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        ids, counts = self.of_runs(runs.dictionary.to_pylist())
        ids, counts = np.append(ids, self.kind(END_ID)), np.append(counts, np.int32(1))
        n_runs = np.diff(np.searchsorted(begins, np.concatenate([[0], np.cumsum(lengths)])))
        at = np.insert(runs.indices.to_numpy(zero_copy_only=False), np.cumsum(n_runs), len(counts) - 1)  # the end id as each text's last run
        return gathered(ids, (np.cumsum(counts, dtype=np.int32) - counts)[at], counts[at]), run_sums(counts[at], n_runs + 1)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(texts: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[slice]:
    """Slices of some MB of text each, of one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most_bytes, "right")))
        yield slice(begin, end)
        begin = end


def places(sizes: np.ndarray) -> np.ndarray:
    """Where the values of documents of these sizes stand, if each one's number is rounded up to four."""
    padded = -(-sizes // 4) * 4
    return np.arange(int(sizes.sum())) + np.repeat(np.cumsum(padded - sizes) - (padded - sizes), sizes)


def packed(values: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data streams of documents of these sizes."""
    lengths = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    at = np.cumsum(lengths) - lengths
    data = np.zeros(int(lengths.sum()), np.uint8)
    data[at] = values & np.uint32(0xFF)
    for k in range(1, 4):
        long = lengths > k
        if long.any():
            data[at[long] + k] = (values[long] >> np.uint32(8 * k)) & np.uint32(0xFF)
    codes = np.zeros(int((-(-sizes // 4) * 4).sum()), np.uint8)
    codes[places(sizes)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpacked(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """All values of documents of these sizes, whose streams stand one after the other."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[places(sizes)]
    at = np.cumsum(lengths) - lengths
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        long = lengths > k
        if long.any():
            out[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenized(docs: DataFrame, path: str, label: str = "op4-ids") -> DataFrame:
    """The written table of (doc_id, ids, width): each text's ids and the end id, as little-endian unsigned integers of `width` bytes."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch["text"]):
                rows = batch.slice(part.start, part.stop - part.start)
                ids, sizes = encoder(path).encode(rows["text"])
                width = ids.dtype.itemsize
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * width
                made = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays([rows["doc_id"], made, pa.array(np.full(len(rows), width, np.int32))], names=["doc_id", "ids", "width"])

    return common.written(docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary, width int"), label)


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(np.frombuffer(b"".join(batch["ids"]), f"<u{batch['width'].iloc[0]}") if len(batch) else [])
            total = np.pad(total, (0, max(0, len(seen) - len(total))))
            total[: len(seen)] += seen
        kept = np.nonzero(total)[0]
        yield pd.DataFrame({"id": kept, "n": total[kept]})

    return tokens.select("ids", "width").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_store(docs: DataFrame, path: str, folder: str) -> None:
    """Writes the tables `ranks` (rank, id) and `blocks` (a row a block) into a folder."""
    spark, tokens = docs.sparkSession, tokenized(docs, path)
    by_rank = np.array([r["id"] for r in id_counts(tokens).orderBy(F.desc("n"), "id").collect()], np.uint32)
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(by_rank)), "id": by_rank.astype(np.int64)}), "rank long, id long").write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, rows = 0, 0, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows.append(row)
                held += len(row.ids) // int(row.width)
                if held >= BLOCK_IDS:
                    yield one_block(number, rows)
                    number, held, rows = number + 1, 0, []
        if rows:
            yield one_block(number, rows)

    def one_block(number: int, rows: list) -> pd.DataFrame:
        width = int(rows[0].width)
        values, sizes = rank[np.frombuffer(b"".join(r.ids for r in rows), f"<u{width}")], np.array([len(r.ids) // width for r in rows], np.int64)
        control, data = packed(values, sizes)
        doc_ids = [None if pd.isna(r.doc_id) else int(r.doc_id) for r in rows]
        return pd.DataFrame({"shard": [int(rows[0].shard)], "block": [number], "n_ids": [len(values)], "doc_ids": [doc_ids], "sizes": [sizes], "control": [control], "data": [data]})

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").withColumn("shard", F.spark_partition_id())
    ordered.mapInPandas(block, BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def opened(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    """A store's blocks and its ids by rank, at most one a vocabulary entry, from its files."""
    ranks = spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").orderBy("rank").collect()
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), np.array([r["id"] for r in ranks], np.uint32)


def stored(docs: DataFrame, path: str) -> tuple[DataFrame, np.ndarray]:
    """A new store in the shared folder, opened."""
    folder = common.fresh_path(docs.sparkSession, "op4-store")
    write_store(docs, path, folder)
    return opened(docs.sparkSession, folder)


def block_starts(store: DataFrame) -> DataFrame:
    """(shard, block, first): ids before each block. One window runs over one row a shard, the other within shards."""
    blocks = store.select("shard", "block", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_first"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("in_shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard").select("shard", "block", (F.col("shard_first") + F.col("in_shard")).alias("first"))


def decoded(store: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """A row a document, read back: shard, block, doc_id, ids_before (in its block), ids."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sizes = np.asarray(row.sizes, np.int64)
                ids = by_rank[unpacked(row.control, row.data, sizes)]
                ends = np.cumsum(sizes)
                yield pd.DataFrame({
                    "shard": row.shard, "block": row.block, "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], "Int64"), "ids_before": ends - sizes,
                    "n_tokens": sizes, "ids": [ids[e - s : e].astype("<u4").tobytes() for s, e in zip(sizes, ends, strict=True)],
                })

    return store.mapInPandas(decode, "shard int, block int, doc_id long, ids_before long, n_tokens long, ids binary")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.load(spark, sf_dir, "documents")
    store, by_rank = stored(docs, public_tokenizers.path("word_bpe_49k.json"))
    starts = common.small_or_shuffled(common.written(block_starts(store), "op4-starts"), BROADCAST_ROWS)
    rows = decoded(store, by_rank).withColumn("ids_crc32", F.crc32("ids")).drop("ids").join(starts, ["shard", "block"])
    return rows.select("doc_id", (F.col("first") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")


def texts_of(ids: bytes, path: str) -> str:
    """The (normalised) text of stored ids, without the end id."""
    return encoder(path).tokenizer.decode([int(i) for i in np.frombuffer(ids, "<u4")[:-1]])
