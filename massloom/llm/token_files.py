"""Token ids in files: fixed-width bit packing with block offsets.

A file holds the ids of consecutive documents in the fewest bits that the vocabulary needs, least significant bit
first. Blocks of BLOCK ids begin at byte offsets that the file lists, so a block, or any range of ids, unpacks by numpy
without the rest. Layout, little-endian: magic, then uint32 bits, n_docs, n_blocks, uint64 n_ids; int64 doc_id, uint8
null mark and uint32 length of every document; uint64 byte offset of every block from the payload's start; payload.

Documents are encoded first, where they lie; their ids, packed in two or four bytes, are then dealt by ranges of (id, a
hash of the ids), so that texts never move, equal ids may part, and the number of ranges follows the number of ids.
Files are written by Spark's Parquet sink, one in a row (part, seq, file): the sink works in any store that Spark
reaches and commits by task, so a lost executor leaves no half file. dump() puts them out as plain files.

Edge cases: a null or empty text has the end id alone; a special token's spelling in a text is that token, as the
library has it; documents of one id are ordered by a hash of their token ids; null ids come first; very long texts are
encoded whole; an empty table gives no file; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch
from .textnum import UnitCache, flat, pieces, ragged

MAGIC = b"MLBITS01"
BLOCK = 4096
#: Ids in one file, a document more or less.
FILE_IDS = 2_000_000
#: Ids in one range of documents: the total's PARTS-th part within these bounds.
PART_IDS = (2_000_000, 64_000_000)
PARTS = 128
END_ID = 0
#: Bytes of text encoded at once, or one text.
PIECE = 4 << 20


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    ids = ids.astype(np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(rows.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    rows = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (rows.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def pack_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack_bits(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    sizes = np.array([len(b) for b in blocks], np.uint64)
    return b"".join(
        [
            MAGIC,
            struct.pack("<IIIQ", bits, len(doc_ids), len(blocks), len(ids)),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.asarray(lengths).astype("<u4").tobytes(),
            (np.cumsum(sizes) - sizes).astype("<u8").tobytes(),
            *blocks,
        ]
    )


class TokenFile:
    """A file's bytes, or a memory map of it."""

    def __init__(self, data):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.bits, n, blocks, self.n_ids = struct.unpack_from("<IIIQ", self.data, 8)
        at = 8 + struct.calcsize("<IIIQ")
        ids = np.frombuffer(self.data, "<i8", n, at)
        null = np.frombuffer(self.data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if k else int(x) for x, k in zip(ids, null)]
        self.lengths = np.frombuffer(self.data, "<u4", n, at + 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.offsets = np.frombuffer(self.data, "<u8", blocks, at + 13 * n)
        self.payload = at + 13 * n + 8 * blocks

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them alone."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        out = []
        for b in range(first, last + 1):
            n = min(BLOCK, self.n_ids - b * BLOCK)
            at = self.payload + int(self.offsets[b])
            out.append(unpack_bits(self.data[at : at + (n * self.bits + 7) // 8], self.bits, n))
        return np.concatenate(out)[start - first * BLOCK : stop - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k] + self.lengths[k]))


def tokenizer_units(path: str):
    """encode for a UnitCache by the tokenizers library, for units that hold no added token's spelling."""
    coder = _coder(path)
    feed = coder.encode("\n", add_special_tokens=False).ids

    def one_by_one(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [x.ids for x in coder.encode_batch_fast(units, add_special_tokens=False)]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter((x for r in rows for x in r), np.int32, int(sizes.sum())), sizes

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a unit without white space but for one space in front is the same alone or after a line feed, so such units
        # go in as one text and part again at the line feed's id
        plain = [len(p := u.split()) == 1 and len(p[0]) >= len(u) - (u[0] == " ") for u in units]
        if len(feed) != 1 or not all(plain):
            if len(feed) != 1 or not any(plain):
                return one_by_one(units)
            is_plain = np.array(plain)
            a, a_sizes = encode([u for u, k in zip(units, plain) if k])
            b, b_sizes = one_by_one([u for u, k in zip(units, plain) if not k])
            sizes = np.empty(len(units), np.int64)
            sizes[is_plain], sizes[~is_plain] = a_sizes, b_sizes
            starts = np.empty(len(units), np.int64)
            starts[is_plain], starts[~is_plain] = np.cumsum(a_sizes) - a_sizes, len(a) + np.cumsum(b_sizes) - b_sizes
            return np.concatenate([a, b])[ragged(starts, sizes)], sizes
        ids = np.array(coder.encode_batch_fast(["\n".join(units)], add_special_tokens=False)[0].ids, np.int32)
        cut = ids == feed[0]
        sizes = np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(ids)]])) - 1
        if len(sizes) != len(units):
            return one_by_one(units)
        return ids[~cut], sizes

    return encode


@lru_cache(maxsize=2)
def _coder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class TextCoder:
    """Ids of whole texts, as the library gives them without special tokens added."""

    def __init__(self, path: str):
        self.coder, self.cache = _coder(path), UnitCache(tokenizer_units(path), most=800_000, fine=True)
        self.added = [t.content for t in self.coder.get_added_tokens_decoder().values()]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and how many each text has."""
        column = pc.fill_null(column, "")
        whole = np.zeros(len(column), bool)
        for token in self.added:  # units would cut these tokens, so texts with one are encoded in one go
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.cache(*flat(column))
        sizes = np.zeros(len(column), np.int64)
        part, sizes[~whole] = self.cache(*flat(column.filter(pa.array(~whole))))
        rows = {i: np.array(self.coder.encode(column[i].as_py(), add_special_tokens=False).ids, np.int32) for i in np.flatnonzero(whole).tolist()}
        sizes[list(rows)] = [len(x) for x in rows.values()]
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]), np.int32)
        mine = np.repeat(whole, sizes)
        out[~mine] = part
        out[mine] = np.concatenate(list(rows.values()))
        return out, sizes


#: One coder a worker process: it lasts over the tasks that the process runs.
@lru_cache(maxsize=2)
def _text_coder(path: str) -> TextCoder:
    return TextCoder(path)


def vocabulary_size(path: str) -> int:
    return _coder(path).get_vocab_size()


#: n_before: ids of the part's files before this one.
FILES = "part int, seq int, n_before long, n_ids long, file binary"


def encode_texts(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n, ids): each document's ids with the end id, as little-endian numbers of two bytes, or of four where the
    vocabulary needs them."""
    kind = "<u2" if bits_for(vocabulary_size(tokenizer_path)) <= 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _text_coder(tokenizer_path)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                got, sizes = coder(piece.column("text"))
                ended = np.full(len(got) + len(sizes), END_ID, kind)
                keep = np.ones(len(ended), bool)
                keep[np.cumsum(sizes + 1) - 1] = False
                ended[keep] = got
                cuts = np.append(0, np.cumsum(sizes + 1)) * ended.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(ended)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes + 1), packed], ["doc_id", "n", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n long, ids binary")


def encode_files(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """FILES rows over all documents in ascending order of ids: by (part, seq), each file after the one before it.

    The tokenizer's file is read by the workers from a local path, as libraries are. A byte-level tokenizer cuts texts
    before a space that follows a letter, digit or sign, so units between such spaces are encoded once each (UnitCache).
    """
    bits = bits_for(vocabulary_size(tokenizer_path))
    kind = "<u2" if bits <= 16 else "<u4"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, ids, n = [], [], [], 0

        def out():
            data = pack_file(doc_ids, np.array(lengths), np.concatenate(ids), bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_before", "n_ids", "file"])

        for batch in batches:
            for doc_id, k, data in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids")):
                doc_ids.append(doc_id)
                lengths.append(k)
                ids.append(np.frombuffer(data.as_buffer(), kind))
                n += k
                if n >= file_ids:
                    yield out()
                    doc_ids, lengths, ids, n, seq, before = [], [], [], 0, seq + 1, before + n
        if doc_ids:
            yield out()

    encoded = scratch(encode_texts(docs, tokenizer_path, id_column, text_column).withColumn("h", F.xxhash64("ids")), "tokenids")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    least, most = PART_IDS
    n_parts = max(1, -(-total // min(most, max(least, total // PARTS))))
    rows = encoded.repartitionByRange(n_parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return rows.select("doc_id", "n", "ids").mapInArrow(pack, FILES)


def read_files(files: DataFrame) -> DataFrame:
    """A row a document of FILES: doc_id, start, n_tokens, ids_crc32. start counts the ids of all documents before it.

    A file knows the ids before it in its part; what lies in the parts before comes from a table with a row a part, some
    hundred for most corpora and one for each PART_IDS[1] ids at the most, which Spark sends out or joins by its size.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file"), batch.column("base").to_pylist()):
                f = TokenFile(file.as_buffer())
                all_ids = f.ids(0, f.n_ids).astype("<u4")
                crc = [zlib.crc32(all_ids[s : s + k]) for s, k in zip(f.starts.tolist(), f.lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(f.starts + base), pa.array(f.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    before = scratch(sizes.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before")), "tokenparts")
    return files.join(before, "part").select((F.col("before") + F.col("n_before")).alias("base"), "file").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def dump(files: DataFrame, folder: str) -> None:
    """Write FILES rows as plain files part-PPPPP-SSSSS.tok in a folder that all executors share (a mounted store).

    On a cluster a path that is not shared would spread the files over machines: give one that is.
    """

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            name = os.path.join(folder, f"part-{r.part:05d}-{r.seq:05d}.tok")
            with open(f"{name}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                f.write(r.file)
            os.replace(f.name, name)

    files.foreachPartition(put)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = scratch(encode_files(docs, public_tokenizers.path("byte_bpe_50k.json")), "tokens")
    return read_files(files)
