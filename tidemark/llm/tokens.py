"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

Texts are encoded by the ``tokenizers`` library. Byte-level BPE works on one pre-token (a word with its leading space, a run
of digits, marks or white space) at a time, so each worker keeps the ids of every pre-token it has met; numpy cuts texts of
Latin letters into pre-tokens and looks them up, and only new ones go to the library. Texts with any other character, with a
special token's string, or for another kind of tokenizer, go to the library whole. Both ways give the library's ids.

A record is ``length (u64) | masked crc of the length (u32) | payload | masked crc of the payload (u32)``, all little-endian;
the payload is ``document id (i64) | bytes per id (u8) | ids``. The checksum is zlib's CRC-32, rotated and shifted by a
constant so that a checksum of data that holds checksums stays sound. Each task writes one file under a name of its own and
returns its rows of the index (file, offset, length, ids), so a task that runs again leaves at most a file nobody refers to.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._shared import materialise, new_path

END_ID = 2
#: Marks the record of a document without an id, beside the width of its ids.
NO_ID = 1 << 4
MASK_DELTA = 0xA282EAD8
HEAD = "<QI"
KEY = "<qB"
#: Pre-tokens that a worker keeps (some 40 MB); beyond, it starts anew.
CACHE_ENTRIES = 1 << 19
SPACE, LETTER, NUMBER, MARK, OTHER = range(5)


def _classes() -> np.ndarray:
    """Classes of the characters whose pre-token class is beyond doubt; everything else is OTHER."""
    out = np.full(0x251, OTHER, np.uint8)
    for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]:
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else SPACE if c < 33 else MARK if kind[0] in "PS" else OTHER
    return out


CLASSES = _classes()
#: Endings that the pre-tokenizer splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def pretoken_starts(cps: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens start; ``bounds`` are the texts' bounds in ``cps``."""
    n = len(cps)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    edge = first[:n].copy()
    edge[1:] |= kinds[1:] != kinds[:-1]
    blank = kinds == SPACE
    after_space = np.zeros(n, bool)
    after_space[1:] = (cps[:-1] == 32) & ~first[1:n]
    start = edge & (blank | ~after_space)
    # the last white space before anything else stands apart (and leads the next pre-token if it is a plain space)
    ends = np.zeros(n, bool)
    ends[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    start |= ends
    # 's and the like
    mark = np.flatnonzero((cps == 39) & edge & ~after_space)
    mark = mark[mark + 1 < n]
    mark = mark[(kinds[mark + 1] == LETTER) & ~first[mark + 1]]
    for i in mark:
        for ending in ENDINGS:
            j = i + 1 + len(ending)
            if j <= n and not first[i + 2 : j].any() and all(cps[i + 1 + k] == ord(c) for k, c in enumerate(ending)):
                start[i + 1] = False
                if j < n:
                    start[j] |= kinds[j] == LETTER or first[j]
                break
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts, with a table of known pre-tokens: open addressing over 64-bit hashes, in numpy."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.fast = (
            "ByteLevel(add_prefix_space=False" in repr(pre) and "use_regex=True" in repr(pre) and self.tokenizer.normalizer is None
        )
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self.tokenizer.token_to_id("Ċ")
        self.fast = self.fast and self.newline is not None
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.count = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.off, self.len = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of known hashes, -1 for new ones."""
        mask = np.uint64(len(self.keys) - 1)
        at = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        kept = self.keys[at]
        hit = kept == h
        out[hit] = self.slot[at[hit]]
        left = np.flatnonzero(~hit & (kept != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(mask)
            kept = self.keys[at[left]]
            hit = kept == h[left]
            out[left[hit]] = self.slot[at[left[hit]]]
            left = left[~hit & (kept != 0)]
        return out

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.keys[at[left]] == 0
            mine = left[free]
            self.keys[at[mine]] = h[mine]
            won = self.keys[at[left]] == h[left]
            self.slot[at[left[won]]] = number[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & mask

    def learn(self, h: np.ndarray, tokens: list[str]) -> None:
        """Encode new pre-tokens (distinct hashes) and keep their ids."""
        blank = [not t.strip(" \t\r\n") for t in tokens]
        plain = np.flatnonzero(~np.array(blank))
        order, sizes, flats = [plain], [], []
        for lo in range(0, len(plain), 2000):
            part = [tokens[i] for i in plain[lo : lo + 2000].tolist()]
            joined = np.array(self.library(["\n".join(part)])[0], np.uint32)
            cuts = np.flatnonzero(joined == self.newline)
            if len(cuts) == len(part) - 1:
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(joined)]])) - 1)
                flats.append(joined[joined != self.newline])
            else:
                groups = self.library(part)
                sizes.append(np.array([len(g) for g in groups]))
                flats.append(np.concatenate([np.asarray(g, np.uint32) for g in groups]))
        alone = np.flatnonzero(blank)
        order.append(alone)
        for g in self.library([tokens[i] for i in alone.tolist()]):
            sizes.append(np.array([len(g)]))
            flats.append(np.asarray(g, np.uint32))
        ids, n, new = np.concatenate(order), np.concatenate(sizes), np.concatenate(flats)
        h = h[ids]
        number = np.arange(self.count, self.count + len(ids))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(ids) > len(self.off):
            self.off, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len))
        self.flat[self.used : self.used + len(new)] = new
        self.off[number], self.len[number] = self.used + np.cumsum(n) - n, n
        self.used += len(new)
        self.count += len(ids)
        if self.count * 2 > len(self.keys):
            old = self.keys != 0
            h, number = np.concatenate([self.keys[old], h]), np.concatenate([self.slot[old], number])
            size = 1 << int(self.count * 2 - 1).bit_length()
            self.keys, self.slot = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self._place(h, number)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        for lo, hi, data, offsets in _text.slices(column, 1 << 19):
            text = data.tobytes().decode()
            cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            lead = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            bounds = lead[offsets]
            kinds = CLASSES[np.minimum(cps, 0x250)]
            odd = np.add.reduceat(np.append(kinds == OTHER, False), bounds[:-1], dtype=np.int64) * (np.diff(bounds) > 0) > 0
            whole = {r: text[bounds[r] : bounds[r + 1]] for r in range(hi - lo) if odd[r] or not self.fast}
            for token in self.special:
                if token in text:
                    whole |= {r: text[bounds[r] : bounds[r + 1]] for r in range(hi - lo) if token in text[bounds[r] : bounds[r + 1]]}
            slow = dict(zip(whole, self.library(list(whole.values())), strict=True)) if whole else {}
            if len(slow) == hi - lo:
                yield from (np.array(slow[r], np.uint32) for r in range(hi - lo))
                continue
            starts = pretoken_starts(cps, kinds, bounds)
            if slow:
                starts = starts[~np.isin(np.searchsorted(bounds, starts, "right") - 1, list(slow))]
            ends = np.append(starts[1:], len(cps))
            if slow:
                ends = np.minimum(ends, bounds[np.searchsorted(bounds, starts, "right")])
            if self.count > CACHE_ENTRIES:
                self.clear()
            h = np.maximum(_text.span_hashes(cps, starts, ends), np.uint64(1))
            number = self.find(h)
            new = np.flatnonzero(number < 0)
            if len(new):
                distinct, at = np.unique(h[new], return_index=True)
                first = new[at]
                self.learn(distinct, [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
                number[new] = self.find(h[new])
            n = self.len[number].astype(np.int64)
            to = np.cumsum(n) - n
            ids = self.flat[np.arange(int(n.sum())) + np.repeat(self.off[number] - to, n)]
            cuts = np.append(to, len(ids))[np.searchsorted(starts, bounds)]
            for r in range(hi - lo):
                yield np.array(slow[r], np.uint32) if r in slow else ids[cuts[r] : cuts[r + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


INDEX = "part int, file string, row long, doc_id long, offset long, length long, n_tokens long, before long"


def _writer(tokenizer: str, folder: str, end_id: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        name = f"{folder}/part-{number:06d}-{uuid.uuid4().hex}.rec"
        fs, path = pyarrow.fs.FileSystem.from_uri(name)
        end = np.array([end_id], np.uint32)
        kind = np.dtype("<u2") if width == 2 else np.dtype("<u4")
        out, offset, before, row = None, 0, 0, 0
        for batch in (part for whole in batches for part in _text.pieces(whole)):
            if out is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path)
            docs, rows = batch.column(0).to_pylist(), []
            for doc_id, ids in zip(docs, encoder(tokenizer).encode(batch.column(1)), strict=True):
                ids = np.concatenate([ids, end])
                key = struct.pack(KEY, 0, width | NO_ID) if doc_id is None else struct.pack(KEY, doc_id, width)
                payload = key + ids.astype(kind).tobytes()
                length = struct.pack("<Q", len(payload))
                record = b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])
                out.write(record)
                rows.append((number, name, row, doc_id, offset, len(record), len(ids), before))
                offset, before, row = offset + len(record), before + len(ids), row + 1
            names = [x.split()[0] for x in INDEX.split(", ")]
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if out is not None:
            out.close()

    return work


def write_records(
    docs: DataFrame, tokenizer: str, order: list[Column], id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, folder: str | None = None
) -> DataFrame:
    """Write all texts in ``order`` and return the index (written beside them as a table); null and empty texts have the end id
    only, rows that repeat a record each, a very long text one long record; an empty table writes no file and an empty index."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id) <= 1 << 16 else 4
    keys = [f"__k{i}" for i in range(len(order))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return materialise(rows.mapInArrow(_text.frugal(_writer(tokenizer, folder, end_id, width)), INDEX), "index")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs

    opened, name = None, ""
    for batch in batches:
        counts, crcs = [], []
        for file, doc_id, offset, length in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if file != name:
                fs, path = pyarrow.fs.FileSystem.from_uri(file)
                opened, name = fs.open_input_file(path), file
            record = opened.read_at(length, offset)
            size, crc = struct.unpack_from(HEAD, record)
            payload = record[12:-4]
            if crc != masked(record[:8]) or size != len(payload) or struct.unpack("<I", record[-4:])[0] != masked(payload):
                raise ValueError(f"{file}: damaged record at {offset}")
            key, width = struct.unpack_from(KEY, payload)
            key, width = None if width & NO_ID else key, width & ~NO_ID
            if key != doc_id:
                raise ValueError(f"{file}: the record at {offset} is of document {key}, not {doc_id}")
            ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=struct.calcsize(KEY))
            counts.append(len(ids))
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([*batch.columns[4:], batch.column(1), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["start", "doc_id", "n_tokens", "ids_crc32"])


def read_records(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read every record of an index back: doc id, start (ids before it in the whole output), n_tokens, ids_crc32."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = index.join(base, "part").select("file", "doc_id", "offset", "length", (F.col("base") + F.col("before")).alias("start"))
    return rows.mapInArrow(_reader, "start long, doc_id long, n_tokens long, ids_crc32 long").select(F.col("doc_id").alias(id_col), "start", "n_tokens", "ids_crc32")


def token_records(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None) -> DataFrame:
    """Write and read back: one row per document with its place in the token stream.

    The order is ascending id (nulls first, rows that repeat an id in any order) unless ``order`` is given. Empty and null
    texts give the end id alone; an empty table gives an empty result; other columns are not read.
    """
    return read_records(write_records(docs, tokenizer, order or [F.col(id_col)], id_col, text_col), id_col)
