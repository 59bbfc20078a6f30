"""Token ids in files: frequency-ranked ids, byte-aligned variable-length coding.

Texts are dealt by ranges of doc_id, so that the files' order is the order of the
documents, tokenised once and kept as raw ids. One pass counts the ids (a vector no
longer than the vocabulary per task); the rank of an id by frequency replaces it, so
that common ids take one byte. A block of a file holds

    magic ``VTB1``, number of values (8 bytes, little-endian), control bytes, data bytes

with two control bits a value (its length in bytes less one, four values to a control
byte, lowest bits first) apart from the data bytes (little-endian ranks). Decoding looks
up the lengths of a control byte in a 256-row table and gathers the values with numpy.
Blocks are binary cells of Parquet files, beside the ids and lengths of their documents:
so Spark's own committers write them and any store can hold them.

A null or empty text is only the end id. Rows with equal ids stay apart, ordered by
text; rows with a null id come first. Texts are encoded whole, however long; columns besides the id and the text are ignored;
an empty table gives files without blocks.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_rows, arrow_schema, gathered, id_text, n_parts, offsets_of, shared_dir, slices, text_bytes, trim

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SHARD_BYTES = 32 << 20
BLOCK_IDS = 1 << 16
SLICE_BYTES = 4 << 20
#: Blocks that travel to a worker at once to be coded: they are large, the usual 10,000 would be all of a task.
BATCH_BLOCKS = 16
#: Rows that a writer holds before it writes them out: blocks are large, so that the usual 128 MB would be all of a task.
ROW_GROUP = 4 << 20
MAGIC = b"VTB1"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: Classes of bytes: letters, digits, apostrophe, other printable ASCII, space, other white space; 0: no cut is known beside it.
_LETTER, _DIGIT, _APOSTROPHE, _SIGN, _SPACE, _BREAK = range(1, 7)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x27], _CLASS[0x20], _CLASS[[0x09, 0x0A, 0x0D]] = _APOSTROPHE, _SPACE, _BREAK
#: Lead bytes of U+00C0 to U+027F and U+0400 to U+047F, which are letters but for the signs of multiplication and division.
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True
#: _CUT[8 * a + b]: between classes a and b the pre-tokenizer always cuts. An apostrophe may begin a contraction or end a run of signs.
_CUT = np.zeros((8, 8), dtype=bool)
_CUT[_LETTER, [_DIGIT, _APOSTROPHE, _SIGN, _SPACE, _BREAK]] = _CUT[_DIGIT, [_LETTER, _APOSTROPHE, _SIGN, _SPACE, _BREAK]] = True
_CUT[_APOSTROPHE, [_DIGIT, _SPACE, _BREAK]] = _CUT[_SIGN, [_LETTER, _DIGIT, _SPACE, _BREAK]] = True
_CUT = _CUT.reshape(-1)
_SHOWN, _BLANK = np.isin(np.arange(256), [_LETTER, _DIGIT, _APOSTROPHE, _SIGN]), np.isin(np.arange(256), [_SPACE, _BREAK])


class Encoder:
    """The library's encoder, for slices of texts; every distinct unit of a text is encoded once.

    A unit ends where the byte-level pre-tokenizer cuts whatever stands around, as far as the classes of two bytes, or three
    with white space, tell; mostly it is one word, number or run of signs, with the space before it. Tokens never cross those cuts,
    so that the ids of a text are those of its units in order; the constructor refuses a tokenizer file of another kind. Beside other
    letters, control bytes and the strings of added tokens there is no cut. Units are told apart by their bytes. They
    are remembered with their ids until ``MEMO`` units or ``MEMO_BYTES`` are passed, then the memory starts anew.
    """

    MEMO = 1 << 19
    MEMO_BYTES = 16 << 20
    CALL_BYTES = 1 << 18
    TEXT_BYTES = 1 << 11

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already keeps the cores busy
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        if made["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or any(len(t["content"].split()) != 1 or t["content"] != t["content"].strip() or not t["content"].isascii() or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
            raise ValueError("token files need a byte-level tokenizer without a normalizer")
        self.added = [t["content"].encode() for t in made["added_tokens"]]
        #: Bytes of a token: a byte-level token has a character for each.
        self.n_vocabulary = max(self.tokenizer.get_vocab().values()) + 1
        self.size = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.n_vocabulary)], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], type=pa.binary())
        self.ids, self.ends = np.zeros(1 << 16, dtype="<u4"), np.zeros(1 << 16, dtype=np.int64)
        self.n_ids = 0

    def _classes(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Classes of the bytes of texts laid end to end (text i from at[i] to at[i + 1])."""
        kind = _CLASS[data]
        lead = np.flatnonzero(_LEAD[data[:-1]])
        lead = lead[(data[lead + 1] & 0xC0 == 0x80) & ((data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)))]
        if not np.all(data[at[1:-1][at[1:-1] < len(data)]] & 0xC0 != 0x80):  # a broken text: no letter may cross its end
            lead = lead[~np.isin(lead + 1, at)]
        kind[lead] = kind[lead + 1] = _LETTER
        text = data.tobytes()
        for one in self.added:
            i = text.find(one)
            while i >= 0:
                kind[i : i + len(one)] = 0
                i = text.find(one, i + 1)
        return kind

    def _starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the units of such texts start."""
        kind, first = self._classes(data, at), at[:-1][at[:-1] < at[1:]]
        mark = np.zeros(len(data) + 1, dtype=bool)
        mark[1:-1] = _CUT[kind[:-1] * np.uint8(8) + kind[1:]]
        # The last of several white spaces stands apart, or goes with what follows in its text.
        blank, shown = _BLANK[kind], _SHOWN[kind]
        shown[first] = False
        mark[1:-2] |= blank[:-2] & blank[1:-1] & shown[2:]
        mark[first] = True
        shown[first] = _SHOWN[kind[first]]
        mark[1:-1] |= (kind[:-1] == _BREAK) & mark[:-2] & shown[1:]
        return np.flatnonzero(mark[:-1])

    def _call(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of some texts, and how many each has."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        return np.fromiter(itertools.chain.from_iterable(each), dtype="<u4", count=int(lens.sum())), lens

    def _learn(self, units: pa.Array) -> None:
        """Encodes new units, in calls of bounded size, and remembers them."""
        data, at = flat(units)
        kind, first, last = self._classes(data, at), at[:-1], at[1:] - 1
        shown = _SHOWN[kind]
        # Between units that begin and end so, and line feeds between others, the pre-tokenizer cuts: they stay in one text, and the tokens' lengths tell their ids apart.
        spaced = (kind[first] == _SPACE) & (last > first) & shown[np.minimum(first + 1, last)] & shown[last]
        bare = shown[first] & shown[last]
        for which, close in ((spaced, b""), (bare, b"\n"), (~spaced & ~bare, None)):
            some = units.filter(pa.array(which))
            while len(some):
                n = max(1, int(np.searchsorted(flat(some)[1], self.CALL_BYTES, side="right")) - 1)
                lot, some = some.slice(0, n), some.slice(n)
                if close is None or not self._in_rows(lot, close):
                    self._add(lot, *self._call([u.decode("utf-8", "replace") for u in lot.to_pylist()]))

    def _in_rows(self, units: pa.Array, close: bytes) -> bool:
        """Encodes units as texts of many, each closed by ``close``; refuses broken bytes, whose tokens have other lengths."""
        data, at = flat(pc.binary_join_element_wise(units, pa.scalar(close, pa.binary()), pa.scalar(b"", pa.binary())) if close else units)
        cuts = at[[0, *(np.flatnonzero(np.diff(at[:-1] // self.TEXT_BYTES)) + 1).tolist(), len(units)]].tolist()
        text = data.tobytes()
        try:
            rows = [text[a:b].decode() for a, b in itertools.pairwise(cuts)]
        except UnicodeDecodeError:
            return False
        ids, _ = self._call(rows)
        lens = np.diff(np.searchsorted(np.cumsum(self.size[ids]), at[1:]) + 1, prepend=0)
        if close:
            ids, lens = np.delete(ids, np.cumsum(lens) - 1), lens - 1
        self._add(units, ids, lens)
        return True

    def _add(self, units: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.known)
        self.ids, self.ends = _grown(self.ids, self.n_ids + len(ids)), _grown(self.ends, n + len(lens))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.ends[n : n + len(lens)] = self.n_ids + np.cumsum(lens)
        self.known = pa.concat_arrays([self.known, units])
        self.n_ids += len(ids)

    def encode(self, data: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Of texts laid end to end in ``data`` (text i from at[i] to at[i + 1]): all ids, each text closed by the end id, and the texts' ends among them."""
        starts = self._starts(data, at)
        bounds = np.append(starts, len(data)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        if len(self.known) > self.MEMO or self.known.nbytes > self.MEMO_BYTES:
            self.forget()
        # The memory is looked up in the slice's units, which are fewer.
        n_old, number = len(self.known), np.full(len(units.dictionary), -1, dtype=np.int64)
        met = np.asarray(pc.index_in(self.known, value_set=units.dictionary).fill_null(-1))
        number[met[met >= 0]] = np.flatnonzero(met >= 0)
        if np.any(number < 0):
            new = units.dictionary.filter(pa.array(number < 0))
            self._learn(new)
            number[number < 0] = n_old + np.asarray(pc.index_in(new, value_set=self.known.slice(n_old)))
        # Of each distinct unit: where its ids begin in the memory, and how many there are.
        first, size = np.append(0, self.ends)[number], np.diff(self.ends, prepend=0)[number]
        places = np.asarray(units.indices)
        # The end id of each text goes before the unit that follows it.
        n = offsets_of(size[places])
        closed = n[np.searchsorted(starts, at[1:])]
        pick = np.repeat(first[places] - n[:-1], size[places])
        pick += np.arange(n[-1])
        return np.insert(self.ids[pick], closed, end_id).astype("<u4"), closed + np.arange(1, len(closed) + 1)


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` values."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), dtype=x.dtype)
    out[: len(x)] = x
    return out


def _end_units() -> np.ndarray:
    codes = np.arange(256)
    return np.stack([(codes >> (2 * k)) & 3 for k in range(4)], axis=1).astype(np.int64) + 1


#: Lengths of the four values of a control byte.
LENGTHS = _end_units()


def pack(values: np.ndarray) -> bytes:
    """A block's bytes from unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    n = len(v)
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    codes[:n] = size - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | (four[:, 1] << 2) | (four[:, 2] << 4) | (four[:, 3] << 6)
    ends = np.cumsum(size, dtype=np.int64)
    data = np.empty(ends[-1] if n else 0, dtype=np.uint8)
    at = ends - size
    data[at] = v & 0xFF
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        data[at[more] + k] = (v[more] >> np.uint32(8 * k)) & 0xFF
    return MAGIC + n.to_bytes(8, "little") + control.astype(np.uint8).tobytes() + data.tobytes()


def unpack(block: bytes) -> np.ndarray:
    """The values of a block; raises on a damaged one."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    n = int.from_bytes(block[4:12], "little")
    c = -(-n // 4)
    control = np.frombuffer(block, dtype=np.uint8, count=c, offset=12)
    data = np.frombuffer(block, dtype=np.uint8, offset=12 + c)
    size = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(size)
    if (ends[-1] if n else 0) != len(data):
        raise ValueError("a token block has the wrong length")
    at = ends - size
    out = data[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def flat(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls end to end, and the rows' bounds in them."""
    bodies = bodies.cast(pa.binary())
    at = np.frombuffer(bodies.buffers()[1], dtype=np.int32, count=len(bodies) + 1, offset=4 * bodies.offset).astype(np.int64)
    data = np.frombuffer(bodies.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if at[-1] else np.zeros(0, np.uint8)
    return data, at - at[0]


_RAW = "shard int, block int, at long, doc_ids array<long>, lens array<long>, width int, ids binary, freq binary"
_FILE = "shard int, block int, at long, doc_ids array<long>, lens array<long>, body binary"


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Blocks of raw ids, of two bytes where the vocabulary allows it (``width``), in doc_id order; ``at``: ids of the shard before the block. Written once.

    The last row of a task has no block but ``freq``: how often each id stands in the task, by id.
    """
    texts = id_text(docs)
    n = n_parts(text_bytes(texts), SHARD_BYTES)
    arrow = arrow_schema(_RAW)
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        if not held:
            held["encoder"] = Encoder(path)
        encoder, shard = held["encoder"], TaskContext.get().partitionId()
        block, at, ids, lens, parts, size = 0, 0, [], [], [], 0
        freq = np.zeros(max(encoder.n_vocabulary, end_id + 1), dtype="<i8")
        width = 2 if len(freq) <= 1 << 16 else 4

        def row(*values: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(values, arrow, strict=True)], schema=arrow)

        for batch in gathered(batches, SLICE_BYTES):
            for lo, hi in slices(batch.column("body"), SLICE_BYTES):
                names, bodies = (batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "body"))
                found, ends = encoder.encode(*flat(bodies), end_id)
                freq += np.bincount(found, minlength=len(freq))
                for name, a, b in zip(names.to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                    ids.append(name)
                    lens.append(b - a)
                    parts.append(found[a:b])
                    size += b - a
                    if size >= BLOCK_IDS:
                        yield row(shard, block, at, ids, lens, width, np.concatenate(parts).astype(f"<u{width}").tobytes(), None)
                        block, at, ids, lens, parts, size = block + 1, at + size, [], [], [], 0
            trim()
        if ids:
            yield row(shard, block, at, ids, lens, width, np.concatenate(parts).astype(f"<u{width}").tobytes(), None)
        if freq.any():
            yield row(shard, None, None, None, None, None, None, freq.tobytes())

    dealt = texts.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "body")
    out = f"{shared_dir(docs.sparkSession).rstrip('/')}/veredas/token-ids-{uuid.uuid4().hex}"
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        dealt.mapInArrow(run, _RAW).write.option("parquet.block.size", ROW_GROUP).parquet(out)
    return docs.sparkSession.read.schema(_RAW).parquet(out)


def ranks(raw: DataFrame) -> np.ndarray:
    """ids by falling frequency (ties: smaller id first): as long as the vocabulary at most, whatever the corpus."""
    arrow = arrow_schema("id long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for x in batch.column("freq"):
                more = np.frombuffer(x.as_py(), dtype="<i8")
                total = more + np.concatenate([total, np.zeros(len(more) - len(total), np.int64)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=arrow)

    counts = raw.where("freq is not null").select("freq").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r.id for r in counts.orderBy(F.desc("n"), "id").select("id").collect()], dtype=np.uint32)


@dataclass(frozen=True)
class TokenFiles:
    """Where the blocks and the rank table lie."""

    path: str

    @property
    def blocks(self) -> str:
        return f"{self.path}/blocks"

    @property
    def table(self) -> str:
        return f"{self.path}/ranks"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> TokenFiles:
    """Writes the documents' ids below ``path`` in the format above."""
    spark = docs.sparkSession
    files = TokenFiles(path)
    raw = tokenize(docs, tokenizer or default_path(), end_id)
    by_rank = ranks(raw)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 0, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    arrow = arrow_schema(_FILE)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                body = pack(rank_of[np.frombuffer(row.column("ids")[0].as_py(), dtype=f"<u{row.column('width')[0].as_py()}")])
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("shard", "block", "at", "doc_ids", "lens")), pa.array([body], type=pa.binary())], schema=arrow)

    blocks = raw.where("block is not null").drop("freq")
    with arrow_rows(spark, BATCH_BLOCKS):
        blocks.mapInArrow(code, _FILE).write.option("parquet.block.size", ROW_GROUP).parquet(files.blocks)
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(files.table)
    return files


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document in the files."""
    blocks = spark.read.schema(_FILE).parquet(files.blocks)
    table = spark.read.schema("rank long, id long").parquet(files.table)
    by_rank = np.array([r.id for r in table.orderBy("rank").collect()], dtype="<u4")
    sizes = blocks.groupBy("shard").agg(F.max(F.col("at") + F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One row a shard, of SHARD_BYTES of text each: the running sum over them is small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = {r.shard: r.start for r in sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).collect()}
    arrow = arrow_schema("doc_id long, start long, n_tokens long, ids binary")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids = by_rank[unpack(row["body"].as_py())]
                at = offsets_of(np.asarray(row["lens"].values))
                each = [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
                first = starts[row["shard"].as_py()] + row["at"].as_py()
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values.cast(pa.int64()), pa.array(first + at[:-1]), pa.array(np.diff(at)), pa.array(each, type=pa.binary())], schema=arrow)

    return blocks.mapInArrow(back, "doc_id long, start long, n_tokens long, ids binary")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the ids' crc32."""
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/veredas/tokens-{uuid.uuid4().hex}"


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
