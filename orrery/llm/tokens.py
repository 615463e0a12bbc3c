"""Token ids in binary files, grammar-coded per segment, in ascending doc_id order.

Texts are dealt by ranges of doc_id and sorted; each task encodes its documents and
writes segments of about ``SEGMENT`` ids (one row: order, documents' ids, payload) through
Spark's Parquet writer into the shared folder, so the committer discards what lost tasks
left. The format of a payload is in ``repair``.

Byte-level BPE never joins a word with the space, line end or mark that follows it, so
texts are cut there and each distinct piece is encoded by the library once while a
worker remembers it; a test compares with whole texts. A remembered piece is found by
hashes and then compared byte by byte, so no piece can get another one's ids.

Defined results: null text is empty and has the end id alone; null doc_ids come first;
rows of one doc_id are ordered by the text's XXH64, then by text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import repair
from orrery.llm.common import ranges, saved, trim

#: Ids in a segment, bytes encoded at once, pieces that a worker remembers, pieces encoded in one call's string.
SEGMENT, AT_ONCE, REMEMBERED, JOINED = 1 << 19, 1 << 17, 800_000, 256
#: Bytes of a piece beyond which it is not remembered; bytes of text in a partition.
LONG, PART = 64, 64 << 20
VOCABULARY = "byte_bpe_50k.json"
END = 0
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _flags(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


_LETTERS, _MARKS = _flags(string.ascii_letters), _flags("".join(set(string.punctuation) - set("'|")))


def piece_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces start in the UTF-8 bytes of texts that start at ``starts``.

    At each text; at single spaces and around single line ends between characters that are
    surely not white space (ASCII beyond the space, and those of two bytes from U+00C0); and
    at ASCII marks behind a letter of ASCII or Latin-1, but for the apostrophe, which can
    belong to the letters behind it, and the bar of the special tokens."""
    plain = (raw > 32) & (raw < 127)
    two = (raw >= 0xC3) & (raw <= 0xDF)
    after = plain | two
    before = plain  # a character's last byte
    before[1:] |= two[:-1]
    letter = _LETTERS[raw]
    letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    between = np.zeros(len(raw), bool)
    between[1:-1] = before[:-2] & after[2:]
    cut = (raw == 32) & between
    first = starts[starts < len(raw)]
    cut[first[first > 0] - 1] = False  # a text's last space
    line = (raw == 10) & between
    cut |= line
    cut[1:] |= line[:-1] | _MARKS[raw[1:]] & letter[:-1]
    cut[first] = True
    return np.flatnonzero(cut)


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of spans of these sizes, one after another."""
    to = np.cumsum(size)
    return np.arange(int(to[-1]) if len(to) else 0) + np.repeat(begin - (to - size), size)


class PieceEncoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library, piece by piece.

    Pieces are found by two 64-bit hashes of their bytes, in an open-addressing table of
    numpy arrays, and compared with the bytes stored there, so that only new pieces become
    Python strings. Long pieces, and those whose hashes are another piece's, are encoded
    each time they come."""

    def __init__(self, path: str):
        # a task has one core; the library's own threads would only wait for it
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        names = self.library.get_vocab(with_added_tokens=True)
        # in byte-level BPE each character of a token's name stands for one byte
        self.width = np.zeros(max(names.values()) + 1, np.int64)
        for name, at in names.items():
            self.width[at] = len(name)
        rng = np.random.default_rng(8)
        self.values = rng.integers(1, 1 << 63, (2, 256), np.uint64)
        self.base = [int(x) | 1 for x in rng.integers(1 << 62, 1 << 63, 2, np.uint64)]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2
        self._empty()

    def _empty(self) -> None:
        self.slots = 1 << (2 * REMEMBERED).bit_length()
        self.rows = np.full(self.slots, -1, np.int32)
        self.known = 0  # pieces; the arrays hold room for more
        self.keys = np.zeros((2, REMEMBERED), np.uint64)
        self.counts = np.zeros(REMEMBERED, np.int32)
        self.ids, self.ends = np.zeros(4 * REMEMBERED, np.uint32), np.zeros(REMEMBERED + 1, np.int64)
        self.bytes, self.stops = np.zeros(8 * REMEMBERED, np.uint8), np.zeros(REMEMBERED + 1, np.int64)

    def _forget(self) -> None:
        """Keep the pieces that came again, at most half of what may be remembered."""
        counts = self.counts[: self.known]
        least = max(2, np.partition(counts, -self.known // 2)[-self.known // 2] + 1)
        kept = np.flatnonzero(counts >= least)
        keys, counts, sizes = self.keys[:, kept], counts[kept], self.ends[kept + 1] - self.ends[kept]
        ids = self.ids[_spans(self.ends[kept], sizes)]
        widths = self.stops[kept + 1] - self.stops[kept]
        raw = self.bytes[_spans(self.stops[kept], widths)]
        self._empty()
        self._store(keys, ids, sizes, raw, widths)
        self.counts[: self.known] = counts // 2

    def _hashes(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two polynomial hashes of raw[begin:end], by prefix sums and inverse powers."""
        out = []
        for k in range(2):
            up, down = self.powers[k]
            if len(up) <= len(raw):
                n = len(raw) + (1 << 17)
                up, down = np.full((2, n), self.base[k], np.uint64)
                down[:] = pow(self.base[k], -1, 1 << 64)
                up[0] = down[0] = 1
                np.cumprod(up, out=up)
                np.cumprod(down, out=down)
                self.powers[k] = up, down
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(self.values[k][raw] * up[: len(raw)], out=sums[1:])
            # bytes stand at their places in the text, so the sum is shifted back
            h = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)
            out.append((h ^ (h >> np.uint64(32))) * (_MIX if k else _SPREAD) | np.uint64(k == 0))
        return np.stack(out)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the pieces with these hashes, -1 for unknown ones."""
        out = np.full(keys.shape[1], -1, np.int64)
        slot = (keys[0] >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        left = np.arange(keys.shape[1])
        while len(left):
            row = self.rows[slot]
            full = row >= 0
            left, slot, row = left[full], slot[full], row[full]
            same = (self.keys[0][row] == keys[0][left]) & (self.keys[1][row] == keys[1][left])
            out[left[same]] = row[same]
            left, slot = left[~same], (slot[~same] + 1) & (self.slots - 1)
        return out

    def _same(self, rows: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the stored bytes of ``rows`` are raw[begin:end]; false for row -1."""
        size = end - begin
        same = (rows >= 0) & (self.stops[rows + 1] - self.stops[rows] == size)
        at, size = np.flatnonzero(same), size[same]
        if len(at):
            differ = self.bytes[_spans(self.stops[rows[at]], size)] != raw[_spans(begin[at], size)]
            same[at[np.logical_or.reduceat(differ, np.cumsum(size) - size)]] = False
        return same

    def _append(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """Rows for pieces with their ids and bytes one after another, not yet to be found."""
        first, last, base, place = self.known, self.known + keys.shape[1], int(self.ends[self.known]), int(self.stops[self.known])
        room = lambda x, n: x if x.shape[-1] >= n else np.concatenate([x, np.zeros((*x.shape[:-1], n), x.dtype)], axis=-1)
        self.keys, self.counts, self.ends, self.stops = room(self.keys, last), room(self.counts, last), room(self.ends, last + 1), room(self.stops, last + 1)
        self.ids, self.bytes = room(self.ids, base + len(ids)), room(self.bytes, place + len(raw))
        self.keys[:, first:last] = keys
        self.counts[first:last] = 0
        self.ends[first + 1 : last + 1] = base + np.cumsum(sizes)
        self.stops[first + 1 : last + 1] = place + np.cumsum(widths)
        self.ids[base : base + len(ids)] = ids
        self.bytes[place : place + len(raw)] = raw
        self.known = last
        return np.arange(first, last)

    def _store(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, widths: np.ndarray) -> None:
        """New pieces, all different, that are found from now on."""
        row = self._append(keys, ids, sizes, raw, widths)
        slot = (keys[0] >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        left = np.arange(keys.shape[1])
        while len(left):
            free = np.flatnonzero(self.rows[slot] < 0)
            _, pick = np.unique(slot[free], return_index=True)
            won = free[pick]
            self.rows[slot[won]] = row[left[won]]
            on = np.ones(len(left), bool)
            on[won] = False
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _apart(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, each encoded on its own."""
        return self._library([raw[a:b].tobytes().decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])

    def _joined(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that may follow one another, many in one string; the bytes that
        the tokens stand for tell where each piece ends."""
        size = end - begin
        to = np.cumsum(size)
        data = raw[_spans(begin, size)].tobytes()
        cuts = [0, *to[JOINED - 1 : -1 : JOINED].tolist(), len(data)]
        ids, _ = self._library([data[a:b].decode() for a, b in zip(cuts, cuts[1:])])
        bytes_ = np.concatenate([[0], np.cumsum(self.width[ids])])
        cut = np.searchsorted(bytes_, to)
        if cut[-1] != len(ids) or not np.array_equal(bytes_[cut], to):  # a token crosses pieces
            return self._apart(raw, begin, end)
        return ids, np.diff(cut, prepend=0)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END appended to each, and where each ends."""
        coded = [(t or "").encode() for t in texts]
        whole = np.cumsum([0, *map(len, coded)])
        return self.encode_bytes(b"".join(coded), whole)

    def encode_bytes(self, data: bytes, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts data[whole[k]:whole[k + 1]] in UTF-8."""
        if self.known > REMEMBERED:
            self._forget()
        raw = np.frombuffer(data, np.uint8)
        begin = piece_starts(raw, whole[:-1])
        end = np.append(begin[1:], len(raw)) if len(begin) else begin
        keys = self._hashes(raw, begin, end)
        rows = self._find(keys)
        rows[~self._same(rows, raw, begin, end)] = -1
        missing = np.flatnonzero((rows < 0) & (end - begin <= LONG))
        if len(missing):
            _, one = np.unique(keys[0][missing], return_index=True)
            new = missing[np.sort(one)]
            # pieces that start with a space and end before a text does can stand in a row
            outer = (raw[begin[new]] != 32) | np.isin(begin[new], whole[:-1]) | np.isin(end[new], whole[1:])
            for some, ids in ((new[~outer], self._joined), (new[outer], self._apart)):
                if len(some):
                    size = end[some] - begin[some]
                    self._store(keys[:, some], *ids(raw, begin[some], end[some]), raw[_spans(begin[some], size)], size)
            rows[missing] = self._find(keys[:, missing])
            rows[missing[~self._same(rows[missing], raw, begin[missing], end[missing])]] = -1
        np.add.at(self.counts, rows[rows >= 0], 1)
        mark = self.known
        if len(alone := np.flatnonzero(rows < 0)):  # long, or with the hashes of another piece
            rows[alone] = self._append(keys[:, alone], *self._apart(raw, begin[alone], end[alone]), raw[:0], np.zeros(len(alone), np.int64))
        size = self.ends[rows + 1] - self.ends[rows]
        to = np.cumsum(size)
        flat = self.ids[_spans(self.ends[rows], size)]
        self.known = mark
        stops = np.concatenate([[0], to])[np.searchsorted(begin, whole[1:])]
        return np.insert(flat, stops, END).astype(np.uint32), stops + np.arange(1, len(stops) + 1)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str | None = None) -> PieceEncoder:
    """One encoder a worker process and file; ``path`` defaults to the public vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def write_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the files; their rows are returned.

    (part, segment, doc_ids, n_ids, payload): by part, then segment, in doc_id order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, ends, segment = [], [], [], 0
        part = None

        def pack() -> pa.RecordBatch:
            sizes = np.concatenate([np.diff(np.concatenate([[0], e])) for e in ends])
            all_ids = np.concatenate(ids)
            row = [[part], [segment], [pa.concat_arrays(held)], [len(all_ids)], [repair.compress(all_ids, np.cumsum(sizes))]]
            names = ["part", "segment", "doc_ids", "n_ids", "payload"]
            types = [pa.int32(), pa.int32(), pa.list_(held[0].type), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            texts, keys = batch.column("text").cast(pa.large_binary()).fill_null(b""), batch.column("doc_id")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = memoryview(texts.buffers()[2] or b"")
            for a, b in ranges(np.diff(offsets), AT_ONCE):
                flat, stops = encoder(path).encode_bytes(bytes(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
                held.append(keys.slice(a, b - a))
                ids.append(flat)
                ends.append(stops)
                if sum(map(len, ids)) >= SEGMENT:
                    yield pack()
                    held, ids, ends, segment = [], [], [], segment + 1
        if held:
            yield pack()
        trim()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    place = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, *place)
    order = dealt.sortWithinPartitions(*place, "text").withColumn("part", F.spark_partition_id())
    coded = order.mapInArrow(run, f"part int, segment int, doc_ids array<{kind}>, n_ids long, payload binary")
    return saved(coded, "tokens")


def read_back(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = files.select("part", "segment", "n_ids")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    starts = sizes.withColumn("inside", inside).join(before, "part").select("part", "segment", (F.col("base") + F.col("inside")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, ends = repair.Segment(batch.column("payload")[k].as_py()).documents()
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin, ends, strict=True)]
                first = batch.column("first")[k].as_py()
                cols = [batch.column("doc_ids")[k].values, pa.array(begin + first), pa.array(ends - begin), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(starts, ["part", "segment"]).select("doc_ids", "payload", "first").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_back(write_files(docs, path))
