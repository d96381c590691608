"""Token ids as length-delimited binary records.

A shard is a run of records: length (uint64), masked checksum of the length's bytes (uint32), payload, masked
checksum of the payload (uint32), all little-endian. The payload is the document's id (int64), a byte that is 1 for a
null id, the ids' width in bytes (2 or 4), and the ids. A shard's index, a separate file, holds the offset of each
record (uint64), so that a shuffled read seeks straight to its records. Checksums are CRC-32, rotated right by 15 and
offset by a constant as in other record formats, so that a checksum of stored checksums stays sound.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, scratch_path, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 2
#: A shard is closed beyond this many bytes; it bounds what a reader holds.
SHARD_BYTES = 32 << 20
#: Texts are encoded in groups of about so many characters, and so many distinct pieces are remembered.
GROUP_CHARS, WORDS = 1 << 20, 150_000
_MASK = 0xA282EAD8
_SPACE, _LETTER, _MARK, _TAIL, _OTHER = 1, 2, 3, 4, 0


def _kinds() -> np.ndarray:
    """The kind of each byte: white space, letter and mark of ASCII, a byte that goes on a character, and others."""
    out = np.zeros(256, np.uint8)
    out[[*range(9, 14), 32]] = _SPACE
    out[33:127] = _MARK
    out[[*range(65, 91), *range(97, 123)]] = _LETTER
    out[48:58] = _OTHER
    out[128:192] = _TAIL
    return out


_KIND = _kinds()
# Bytes that surely begin a character other than white space.
_BEGINS = np.zeros(256, bool)
_BEGINS[[*range(33, 127), *range(0xC3, 0xE0)]] = True


# One word for byte-level pre-tokenisation: letters of ASCII and Latin-1, with a space before them or without.
_WORD = re.compile(rb"\x20?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def byte_letters() -> dict[int, int]:
    """The letter by which byte-level vocabularies write each byte: itself if it shows, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places at which the texts, which begin at starts, may be cut without a change of their ids: byte-level
    pre-tokenisation ends a piece there, and the parts alone are cut as they are together.

    These are the texts' starts, and, where the characters on both sides are surely told apart: the start of a run of
    white space, its last character, and what follows that unless it is a space, which belongs to the word; and a mark
    after a letter.
    """
    n = len(data)
    kind, begins = _KIND[data], _BEGINS[data]
    space = kind == _SPACE
    first = np.zeros(n + 1, bool)
    first[starts] = True
    before = np.empty(n, bool)  # the character before is surely none of white space
    before[:1] = False
    before[1:] = (data[:-1] > 32) & (data[:-1] < 127)
    two = (kind[1:-1] == _TAIL) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
    before[2:] |= two
    after = np.zeros(n, bool)  # the character after is surely none of white space, and of the same text
    after[:-1] = begins[1:] & ~first[1:n]
    spaced = np.zeros(n, bool)
    spaced[1:] = space[:-1]
    ends_run = space & after & (spaced | before | first[:n])
    cut = first[:n] | (space & before) | ends_run
    cut[1:] |= begins[1:] & (ends_run & (data != 32))[:-1] & ~first[1:n]
    letter = np.zeros(n, bool)
    letter[1:] = kind[:-1] == _LETTER
    letter[2:] |= (kind[1:-1] == _TAIL) & (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    cut |= (kind == _MARK) & letter
    return np.flatnonzero(cut)


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


class WordEncoder:
    """Encodes whole texts with the tokenizers library, running each distinct piece through it once.

    It gives what Tokenizer.encode(text, add_special_tokens=False) gives; texts that may hold special tokens go to the
    library whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # of each id in bytes: one character for each
        for token, i in vocab.items():
            self.size[i] = len(token)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}  # the generation before, from which pieces in use move on
        self.mark = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.letters = byte_letters()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode pieces: words by the model alone, others many in a call, with a line break before each, which is one
        id of its own and keeps them apart."""
        words, some = [], []
        for w in pieces:
            if _WORD.fullmatch(w):
                words.append(w)
                continue
            text = w.decode()
            if b"\n" in w or text[-1].isspace() or (w[0] != 32 and text[0].isspace()):
                self.known[w] = self.whole(text)
            else:
                some.append(w)
        if words:
            model, mark = self.tokenizer.model, chr(self.letters[10])
            flat, sizes = [], []
            for x in b"\n".join(words).decode("latin-1").translate(self.letters).split(mark):
                ids = [t.id for t in model.tokenize(x)]
                flat += ids
                sizes.append(len(ids))
            data, start = np.array(flat, self.dtype).tobytes(), 0
            for w, n in zip(words, sizes):
                end = start + n * self.dtype.itemsize
                self.known[w] = data[start:end]
                start = end
        width, skip = self.dtype.itemsize, len(self.mark)
        for at in range(0, len(some), 4096):
            part = some[at : at + 4096]
            ids = np.array(self.tokenizer.encode(b"".join(w if w[0] == 32 else b"\n" + w for w in part).decode(), add_special_tokens=False).ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(w) + (w[0] != 32) for w in part])) + 1
            data, start = ids.tobytes(), 0
            for w, end in zip(part, ends.tolist()):
                self.known[w] = data[(start + skip * (w[0] != 32)) * width : end * width]
                start = end

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > WORDS:
            self.known, self.old = {}, self.known
        get, old = self.known.get, self.old.get
        out = [get(w) for w in pieces]
        missing = [i for i, x in enumerate(out) if x is None]
        unknown = []
        for i in missing:
            w = pieces[i]
            if (x := old(w)) is None:
                unknown.append(w)
            else:
                self.known[w] = x
        self._learn(unknown)
        for i in missing:
            out[i] = self.known[pieces[i]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.dtype."""
        special = {i: self.whole(t) for i, t in enumerate(texts) if "<|" in t}
        raw = [b"" if i in special else t.encode() for i, t in enumerate(texts)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        joined = b"".join(raw)
        if not joined:
            return [special.get(i, b"") for i in range(len(texts))]
        data, starts = np.frombuffer(joined, np.uint8), np.cumsum(sizes) - sizes
        at = cuts(data, starts[sizes > 0])
        offsets = np.append(at, len(data)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        kind = pa.BinaryArray if offsets.dtype == np.int32 else pa.LargeBinaryArray
        pieces = kind.from_buffers(pa.binary() if kind is pa.BinaryArray else pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        code = pieces.indices.to_numpy()
        parts = self._ids(pieces.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(parts), self.dtype)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        each = size[code]
        ends = np.cumsum(each)
        out = flat[np.repeat(begin[code] - (ends - each), each) + np.arange(ends[-1])].tobytes()
        upto = np.append(0, ends)[np.searchsorted(at, np.append(starts, len(data)))] * self.dtype.itemsize
        upto = upto.tolist()
        return [special[i] if i in special else out[s:e] for i, (s, e) in enumerate(zip(upto, upto[1:]))]


_workers: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """One for each Python worker, which serves many tasks."""
    if vocabulary not in _workers:
        _workers[vocabulary] = WordEncoder(vocabulary)
    return _workers[vocabulary]


def groups(texts: Iterable[str]) -> Iterator[list[str]]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= GROUP_CHARS:
            yield out
            out, size = [], 0
    if out:
        yield out


class ShardWriter:
    """Shards of one task, named by partition, number and attempt: a retried or speculative attempt has its own files."""

    def __init__(self, base: str, part: int, attempt: int, limit: int):
        self.fs, root = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(root, recursive=True)
        self.base, self.root, self.part, self.attempt, self.limit = base, root, part, attempt, limit
        self.seq, self.out, self.done = 0, None, []

    def add(self, payload: bytes, n_tokens: int) -> None:
        if self.out is None:
            self.name = f"shard-{self.part:06d}-{self.seq:05d}-{self.attempt}"
            self.out, self.offsets, self.at, self.tokens = self.fs.open_output_stream(f"{self.root}/{self.name}.bin"), [], 0, 0
        length = struct.pack("<Q", len(payload))
        self.offsets.append(self.at)
        for x in (length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))):
            self.out.write(x)
        self.at += 16 + len(payload)
        self.tokens += n_tokens
        if self.at >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        with self.fs.open_output_stream(f"{self.root}/{self.name}.idx") as f:
            f.write(np.array(self.offsets, "<u8").tobytes())
        self.done.append((self.part, self.seq, f"{self.base}/{self.name}", len(self.offsets), self.tokens, self.at))
        self.seq, self.out = self.seq + 1, None


def _unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    (doc_id,) = struct.unpack_from("<q", payload)
    return None if payload[8] else doc_id, np.frombuffer(payload, f"<u{payload[9]}", offset=10)


def _record(f, at: int | None = None) -> bytes | None:
    if at is not None:
        f.seek(at)
    head = f.read(12)
    if not head:
        return None
    length, crc = struct.unpack("<QI", head)
    if crc != masked_crc(head[:8]):
        raise ValueError("the length of a record is damaged")
    payload = f.read(length)
    if len(payload) < length or struct.unpack("<I", f.read(4))[0] != masked_crc(payload):
        raise ValueError("a record is damaged")
    return payload


def read_shard(shard: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every record in order; a failed checksum raises ValueError."""
    fs, path = pafs.FileSystem.from_uri(shard)
    with fs.open_input_stream(f"{path}.bin", buffer_size=1 << 20) as f:
        while (payload := _record(f)) is not None:
            yield _unpack(payload)


def read_at(shard: str, numbers: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the records with these numbers, in the order asked, by the offset index."""
    fs, path = pafs.FileSystem.from_uri(shard)
    with fs.open_input_file(f"{path}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8")
    with fs.open_input_file(f"{path}.bin") as f:
        for k in numbers:
            yield _unpack(_record(f, int(offsets[k])))


def write_records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the ids of every text, and `end` after each, to shards under path in ascending order of id_col.

    Returns the manifest (part, seq, shard, n_docs, n_tokens, bytes, start): shards in the order (part, seq), start
    being the ids before the shard. A null text counts as empty and has only the end id; null ids come first; equal
    ids are ordered by a hash of the text; ids that are no whole numbers fail in the cast; an empty table gives no shard; other columns are ignored. path must be on
    a store that driver and executors share. Only shards of the manifest count: lost attempts may leave others.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # Rows with one id and text give the same record, so any number of them may be dealt over ranges.
    rows = rows.withColumn("spread", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("spread")]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("id", "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, enc = TaskContext.get(), encoder(vocabulary)
        out = ShardWriter(path, ctx.partitionId(), ctx.taskAttemptId(), shard_bytes)
        last, width = np.array([end], enc.dtype).tobytes(), enc.dtype.itemsize
        for b in batches:
            ids = iter(b.column(0))
            for some in groups(t.as_py() for t in b.column(1)):
                for data in enc.encode(some):
                    doc_id = next(ids).as_py()
                    out.add(struct.pack("<qBB", doc_id or 0, doc_id is None, width) + data + last, len(data) // width + 1)
        out.close()
        enc.old = {}  # an idle worker holds one generation
        pa.default_memory_pool().release_unused()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out.done), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "seq", "shard", "n_docs", "n_tokens", "bytes"])

    done = materialize(ranged.mapInArrow(write, "part int, seq int, shard string, n_docs long, n_tokens long, bytes long"), "manifest")
    # One row for each partition comes to the driver, whatever the number of documents and shards.
    starts, total = [], 0
    for r in sorted(done.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        starts.append((r["part"], total))
        total += r["n"]
    first = spark.createDataFrame(starts or [(0, 0)], "part int, first long")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return done.join(F.broadcast(first), "part").withColumn("start", F.col("first") + before).drop("first")


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each record, read back from the shards that the manifest lists."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for doc_id, ids in read_shard(shard):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("shard", "start").repartition(partitions(manifest.sparkSession))
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(docs: DataFrame, make_path: Callable[[], str] | None = None, **options) -> DataFrame:
    """read_records of write_records(docs), to a folder of make_path or of the shared scratch folder.

    Null and empty texts have the end id alone; repeated rows have a record each; ids must be whole numbers or null; an
    empty table gives no rows; options are those of write_records.
    """
    path = make_path() if make_path else scratch_path(docs.sparkSession, "records")
    return read_records(write_records(docs, path, **options))


def op5_token_records(spark, sf_dir: str) -> DataFrame:
    """encode_corpus of all documents, whose docstring defines every case."""
    return encode_corpus(table(spark, sf_dir, "documents"))
