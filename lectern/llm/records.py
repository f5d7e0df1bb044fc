"""Length-delimited binary records of token ids with a separate offset index.

A record is: length of the payload (8 bytes, little endian), masked checksum of these 8 bytes (4 bytes), the payload
(ids, little-endian), masked checksum of the payload (4 bytes). Ids take two bytes where the whole vocabulary and the end id fit, else four; the manifest says
which. The checksum is CRC-32C, masked by a
rotation of 15 bits and a constant, so that checksums stored inside payloads stay harmless. Each shard has an index
file with a row (doc_id, offset, length, tokens before it in the shard) for each record, little-endian 64-bit, so that
records can be read in any order without scanning.

Documents go out in ascending doc_id: range-partitioned, sorted within partitions, one shard for each partition. A task
writes under a name of its own and only names in the returned manifest count, so a task that runs again after the loss
of an executor leaves no half-written shard behind in the result.

Defined results: a null text counts as empty and is a record that holds the end id alone; null doc_ids come first
(written as the least 64-bit integer and read back as null); repeated rows are records each; an empty table gives no
shard; extra columns are ignored.
"""

from __future__ import annotations

import json
import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, cut, restrict, shared_dir, slices

NO_ID = -(1 << 63)
#: Fixed value: the CRC-32C polynomial, bits reversed.
POLYNOMIAL = 0x82F63B78
#: Fixed value: what masking adds after the rotation.
MASK_DELTA = 0xA282EAD8
_ROW = 2048
#: Shards whose offsets are summed along by one task.
GROUP = 4096


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


_T0 = _byte_table()


def _advance(state: np.ndarray, zeros: int) -> np.ndarray:
    """States after ``zeros`` more zero bytes, byte by byte; only for building tables."""
    for _ in range(zeros):
        state = (state >> np.uint32(8)) ^ _T0[state & np.uint32(255)]
    return state


def _shift_tables(zeros: int) -> np.ndarray:
    """Four tables that together move a state over ``zeros`` zero bytes: one gather for each byte of the state."""
    return np.stack([_advance(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), zeros) for k in range(4)])


def _shifted(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
    m = np.uint32(255)
    return tables[0][state & m] ^ tables[1][(state >> np.uint32(8)) & m] ^ tables[2][(state >> np.uint32(16)) & m] ^ tables[3][state >> np.uint32(24)]


# one word of four bytes at a time, by its two halves
_WORD = _shift_tables(4)
_LOW = (_WORD[0][np.arange(65536) & 255] ^ _WORD[1][np.arange(65536) >> 8]).astype(np.uint32)
_HIGH = (_WORD[2][np.arange(65536) & 255] ^ _WORD[3][np.arange(65536) >> 8]).astype(np.uint32)
_OVER_ROW = _shift_tables(_ROW)


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part, all parts side by side.

    Parts are cut into rows of _ROW bytes from their end; rows run in parallel, one word a step, and the states of a
    part's rows are then combined by shifting over the rows behind them. Zero bytes before the data leave a zero state
    as it is, so the first row is padded in front; the initial all-ones state is folded into the first four bytes.
    """
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    out = np.zeros(len(parts), dtype=np.uint32)
    for n in np.flatnonzero(lengths < 4):
        state = np.uint32(0xFFFFFFFF)
        for byte in parts[n]:
            state = (state >> np.uint32(8)) ^ _T0[(state ^ np.uint32(byte)) & np.uint32(255)]
        out[n] = state
    long = np.flatnonzero(lengths >= 4)
    if len(long):
        size = lengths[long]
        rows = -(-size // _ROW)
        grid = np.zeros(int(rows.sum()) * _ROW, dtype=np.uint8)
        ends = np.cumsum(rows) * _ROW
        begin = ends - size
        for n, at, to in zip(long.tolist(), begin.tolist(), ends.tolist(), strict=True):
            grid[at:to] = np.frombuffer(parts[n], dtype=np.uint8)
        for k in range(4):
            grid[begin + k] ^= 255
        words = np.ascontiguousarray(grid.view("<u4").reshape(-1, _ROW // 4).T)
        state = np.zeros(words.shape[1], dtype=np.uint32)
        for step in words:
            state ^= step
            state = _LOW[state & np.uint32(0xFFFF)] ^ _HIGH[state >> np.uint32(16)]
        first = np.cumsum(rows) - rows
        total = state[first]
        for k in range(1, int(rows.max())):
            more = rows > k
            total[more] = _shifted(total[more], _OVER_ROW) ^ state[first[more] + k]
        out[long] = total
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    """The records of the payloads."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    one, two = masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()
    return [b"".join((h, struct.pack("<I", a), p, struct.pack("<I", b))) for h, a, p, b in zip(heads, one, payloads, two, strict=True)]


def unframe(data: bytes, offsets: list[int], lengths: list[int]) -> list[bytes]:
    """The payloads of records at offsets in ``data``; a record that fails a check raises ValueError."""
    heads = [data[o : o + 8] for o in offsets]
    payloads = [data[o + 12 : o + 12 + n] for o, n in zip(offsets, lengths, strict=True)]
    one, two = masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()
    for o, n, h, a, p, b in zip(offsets, lengths, heads, one, payloads, two, strict=True):
        if struct.unpack("<Q", h)[0] != n or len(p) != n or struct.unpack_from("<I", data, o + 8)[0] != a or struct.unpack_from("<I", data, o + 12 + n)[0] != b:
            raise ValueError(f"damaged record at {o}")
    return payloads


# Fixed value: how a word tokenizer of this family splits, so that no word reaches over white space, letters end where marks
# begin, and marks stay together.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that words often end with; none begins one of the endings above.
MARKS = ".,;:!?$%&*#()\"-"
LETTERS = string.ascii_letters


def by_words(data: str) -> bool:
    """Whether a tokenizer's description says that words can be encoded apart: white space is only dropped, marks and
    letters are split, normal forms do not reach over white space, and no special token holds any."""
    own = json.loads(data)
    normal, cut_, core = own.get("normalizer") or {}, own.get("pre_tokenizer") or {}, own.get("model") or {}
    steps, splits = normal.get("normalizers", []), cut_.get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": SPLIT} and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        and core.get("type") == "BPE" and not core.get("dropout") and own.get("post_processor") is None
        and not any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].isalpha() or not set(t["content"]) - set(MARKS) for t in own["added_tokens"])
    )


class WordCache:
    """Encodes texts, word by word where the tokenizer's description allows it; then each part of a word is encoded once.

    A word of ASCII letters and then marks is two parts, the letters in lower case; any other is one. Arrow splits and
    numbers words and parts, so that of a batch only distinct parts reach Python, and numpy puts their ids in place.
    """

    def __init__(self, data: str, room: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_str(data), room
        self.known: dict[bytes, bytes] = {}
        self.apart = by_words(data)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    _kept: dict[tuple[int, int], WordCache] = {}

    @classmethod
    def kept(cls, data: str) -> WordCache:
        """The cache of a tokenizer in this process; tasks that follow each other share it."""
        key = (len(data), zlib.crc32(data.encode()))
        if key not in cls._kept:
            cls._kept = {key: cls(data)}
        return cls._kept[key]

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """The ids of parts; those not known yet are encoded."""
        known = self.known
        new = [p for p in parts if p not in known]
        if len(known) + len(new) > self.room:
            known.clear()
            new = parts
        # letters in lower case pass the normaliser and the split as they are, so the model can be asked at once
        core, rest = self.tokenizer.model, []
        for p in new:
            if p.isalpha() and p.islower():
                known[p] = self._bytes([t.id for t in core.tokenize(p.decode())])
            else:
                rest.append(p)
        if rest:
            got = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in rest], add_special_tokens=False)
            known |= zip(rest, (self._bytes(e.ids) for e in got), strict=True)
        return [known[p] for p in parts]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: none), little-endian, ``width`` bytes each."""
        if not self.apart:
            return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in as_bytes(texts)], add_special_tokens=False)]
        if not len(texts):
            return []
        rows = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        words = rows.flatten().dictionary_encode()
        each, place = words.dictionary, words.indices.to_numpy()
        letters = pc.ascii_rtrim(each, characters=MARKS)
        two = pc.ascii_is_alpha(letters)
        heads = pc.if_else(two, pc.ascii_lower(letters), each)
        tails = pc.if_else(two, pc.ascii_ltrim(each, characters=LETTERS), "")
        parts = pa.concat_arrays([heads, tails]).dictionary_encode()
        ids = self._ids(parts.dictionary.cast(pa.binary()).to_pylist())
        flat = np.frombuffer(b"".join(ids), dtype=f"<u{self.width}")
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.width
        first = np.cumsum(size) - size
        # head, tail, head, tail of the words as they stand
        part = parts.indices.to_numpy().reshape(2, -1).T[place].ravel()
        own = size[part]
        end = np.cumsum(own)
        out = flat[np.repeat(first[part] - (end - own), own) + np.arange(int(own.sum()))]
        edges = (np.r_[0, end] * self.width)[2 * (rows.offsets.to_numpy() - rows.offsets[0].as_py())].tolist()
        data = out.tobytes()
        return [data[lo:hi] for lo, hi in zip(edges, edges[1:], strict=False)]


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int) -> DataFrame:
    """Writes documents (doc_id, text) and returns the manifest: (shard, file, records, tokens, width, start), one row a shard.

    ``tokenizer`` is the JSON of a tokenizer; ``folder`` an address that the executors share.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sink, index, at, seen, records = WordCache.kept(tokenizer), None, None, 0, 0, 0
        system = path = name = None
        width = cache.width if end_id < 1 << 16 else 4
        if width != cache.width:
            raise ValueError("the end id does not fit the ids of this vocabulary")
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        try:
            for batch in slices(batches, "text"):
                if sink is None:
                    system, path = _filesystem(folder)
                    name = f"shard-{uuid.uuid4().hex}"
                    sink, index = system.open_output_stream(f"{path}/{name}.rec"), system.open_output_stream(f"{path}/{name}.idx")
                ids = [NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
                payloads = [x + end for x in cache.encode(batch.column("text"))]
                framed = frame(payloads)
                sizes = np.fromiter(map(len, framed), dtype=np.int64, count=len(framed))
                tokens = np.fromiter(map(len, payloads), dtype=np.int64, count=len(framed)) // width
                rows = np.column_stack([np.array(ids, dtype=np.int64), at + np.cumsum(sizes) - sizes, tokens * width, seen + np.cumsum(tokens) - tokens])
                sink.write(b"".join(framed))
                index.write(rows.astype("<i8").tobytes())
                at, seen, records = at + int(sizes.sum()), seen + int(tokens.sum()), records + len(ids)
        finally:
            for f in (sink, index):
                if f is not None:
                    f.close()
        if sink is not None:
            # ranges are numbered in their order
            shard = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([name]), pa.array([records], pa.int64()), pa.array([seen], pa.int64()), pa.array([width], pa.int32())], names=["shard", "file", "records", "tokens", "width"])

    dealt = restrict(docs, "doc_id", "text").repartitionByRange(shards, F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    manifest = cut(dealt.mapInArrow(run, "shard long, file string, records long, tokens long, width int"))
    # offsets in two steps: a row for each group of shards is summed along, and each group's shards within it
    grouped = manifest.withColumn("group", F.expr(f"shard div {GROUP}"))
    ahead = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(grouped.groupBy("group").agg(F.sum("tokens").alias("held")).select("group", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base")))
    within = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.withColumn("within", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(base, "group")
    return placed.select("shard", "file", "records", "tokens", "width", (F.col("base") + F.col("within")).alias("start"))


def read_shards(manifest: DataFrame, folder: str, at_once: int = 4 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, by the index, with all checksums verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        for batch in batches:
            for name, start, width in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "width")), strict=True):
                with system.open_input_stream(f"{path}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), dtype="<i8").reshape(-1, 4)
                block = (index[:, 1] // at_once).astype(np.int64)
                starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() if len(index) else []
                with system.open_input_file(f"{path}/{name}.rec") as f:
                    for lo, hi in zip(starts, [*starts[1:], len(index)], strict=True):
                        part = index[lo:hi]
                        first, last = int(part[0, 1]), int(part[-1, 1] + part[-1, 2] + 16)
                        data = f.read_at(last - first, first)
                        payloads = unframe(data, (part[:, 1] - first).tolist(), part[:, 2].tolist())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([None if i == NO_ID else i for i in part[:, 0].tolist()], pa.int64()), pa.array(part[:, 3] + start, pa.int64()), pa.array(part[:, 2] // width, pa.int64()), pa.array([zlib.crc32(np.frombuffer(p, dtype=f"<u{width}").astype("<u4")) for p in payloads], pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # as many tasks as shards: rows of a manifest are small, and dealt out by their size they would all go to one
    return manifest.select("file", "start", "width", "shard").repartition(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_bytes: int = 8 << 20) -> DataFrame:
    """Documents written as shards in the session's shared folder and read back from them."""
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/records-{uuid.uuid4().hex}"
    total = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    return read_shards(write_shards(docs, folder, tokenizer, end_id, max(8, -(-total // shard_bytes))), folder)
