"""Token-ID output in patched frame-of-reference blocks.

A folder has `files` and `index`. A file is a row of the Parquet table `files`, (part, seq, payload): Spark commits, moves
and reads it on any store. Rows in the order (part, seq) hold documents in ascending id order. `index` has a row a file:
(part, seq, start, n_ids, n_docs, first_key, last_key), start being the ids of all files before it and keys null where a file
has none, so a reader finds the
file of an id or a document without touching payloads, and in it the block by its start. A payload is little-endian:

    magic "PFR1" | block size u32 | ids u64 | documents u64 | blocks u64 | exceptions u64 | words u64
    document keys i64[documents] | key present u8[documents] | document lengths u32[documents]
    block starts u64[blocks + 1] (offsets in words) | block minima u32[blocks] | block widths u8[blocks]
    exception starts u64[blocks + 1] | exception places u8[exceptions] | exception values u32[exceptions]
    words u32[words]

A block holds `block size` ids less their minimum, packed at the width that PERCENTILE of them fit; the low bits of the
others are packed too and their whole values stand in the exception list.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditlake.llm.common import bounded_batches, byte_slices, lean_memory, shared_dir, strings

MAGIC, BLOCK, PERCENTILE, END_ID = b"PFR1", 128, 90, 2
#: Ids after which a file is closed; a document is never split.
FILE_IDS = 1 << 19
#: Bytes of text cut at once, parts of it encoded at once, pieces in a generation of those whose ids a task remembers,
#: and the length up to which it does.
SLICE_BYTES, PARTS_KEPT, PIECES_KEPT, PIECE_CHARS = 5 << 20, 350_000, 120_000, 64
FILES = "part int, seq int, n_ids long, n_docs long, first_key long, last_key long, payload binary"
INDEX = ("part", "seq", "start", "n_ids", "n_docs", "first_key", "last_key")
LONG_SPACE = re.compile(r"\s{3}|\s\s\Z").search
#: The splitter's classes over characters whose kind is certain: ASCII and Latin letters.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN = re.compile(f"[!-~\t\n\r{_LETTERS}]*").fullmatch
#: What most parts are, for Arrow to cut: a word, perhaps with a comma or full stop, perhaps a line end and another one.
COMMON = rf"^(?P<a>[{_LETTERS}]+)(?P<b>[.,]?)(?:(?P<c>\n)(?P<d>[{_LETTERS}]+)(?P<e>[.,]?))?$"
MARKS = [b"", b",", b".", b"\n"]
PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
#: The byte-level alphabet: printable Latin-1 characters stand for themselves, the others for U+0100 on, in order.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(256)} - _SHOWN))}
SPACE_CHAR = BYTE_CHARS[0x20]


def pack(ids: np.ndarray, lengths, keys, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """The payload of documents with these keys (None: absent) and numbers of ids."""
    n, blocks = len(ids), -(-len(ids) // block)
    table = np.empty(blocks * block, np.uint32)
    table[:n] = ids
    table[n:] = ids[-1] if n else 0
    table = table.reshape(blocks, block)
    low = table.min(1) if n else np.zeros(0, np.uint32)
    rest = table - low[:, None]
    rank = min(block - 1, -(-block * percentile // 100) - 1)
    high = np.partition(rest, rank, axis=1)[:, rank] if n else low
    widths = np.ceil(np.log2(high.astype(np.float64) + 1)).astype(np.uint8)
    over = rest > ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    row, place = np.nonzero(over)
    size = -(-block * widths.astype(np.int64) // 32)
    starts = np.r_[0, np.cumsum(size)].astype(np.uint64)
    out = np.zeros(int(starts[-1]), np.uint32)
    for w in np.unique(widths[widths > 0]).tolist():
        pick = np.flatnonzero(widths == w)
        values = np.ascontiguousarray((rest[pick] & np.uint32((1 << w) - 1)).T)
        packed = np.zeros((int(size[pick[0]]) + 1, len(pick)), np.uint32)
        for j in range(block):
            word, bit = divmod(j * w, 32)
            packed[word] |= values[j] << np.uint32(bit)  # bits beyond the word fall off and go to the next one
            if bit + w > 32:
                packed[word + 1] |= values[j] >> np.uint32(32 - bit)
        out[(starts[pick].astype(np.int64)[:, None] + np.arange(size[pick[0]])).ravel()] = packed[:-1].T.ravel()
    present = np.array([k is not None for k in keys], np.uint8)
    head = np.array([n, len(lengths), blocks, len(row), len(out)], "<u8")
    parts = [
        np.array([block], "<u4"), head, np.array([k or 0 for k in keys], "<i8"), present, np.asarray(lengths, "<u4"), starts, low.astype("<u4"), widths,
        np.r_[0, np.cumsum(over.sum(1))].astype("<u8"), place.astype(np.uint8), rest[row, place].astype("<u4"), out,
    ]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Payload:
    """A payload's parts, read in place; block(i) decodes one block, ids() all."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.data, self.at = data, 4
        (self.size,) = self._take("<u4", 1)
        self.n, docs, blocks, exceptions, n_words = (int(x) for x in self._take("<u8", 5))
        self.keys, self.present, self.lengths = self._take("<i8", docs), self._take("u1", docs), self._take("<u4", docs)
        self.starts, self.low, self.widths = self._take("<u8", blocks + 1), self._take("<u4", blocks), self._take("u1", blocks)
        self.e_starts, self.places, self.values = self._take("<u8", blocks + 1), self._take("u1", exceptions), self._take("<u4", exceptions)
        self.words = self._take("<u4", n_words)

    def _take(self, kind: str, n: int) -> np.ndarray:
        x = np.frombuffer(self.data, kind, n, self.at)
        self.at += x.nbytes
        return x

    def _unpack(self, pick: np.ndarray, w: int) -> np.ndarray:
        size, block = -(-int(self.size) * w // 32), int(self.size)
        words = np.ascontiguousarray(self.words[self.starts[pick].astype(np.int64)[:, None] + np.arange(size)].T)
        out, mask = np.empty((block, len(pick)), np.uint32), np.uint32((1 << w) - 1)
        for j in range(block):
            word, bit = divmod(j * w, 32)
            x = words[word] >> np.uint32(bit)
            if bit + w > 32:
                x |= words[word + 1] << np.uint32(32 - bit)
            np.bitwise_and(x, mask, out=out[j])
        return out.T

    def blocks(self, pick: np.ndarray) -> np.ndarray:
        """The ids of some blocks, a row each, padding included."""
        out = np.zeros((len(pick), int(self.size)), np.uint32)
        for w in np.unique(self.widths[pick]).tolist():
            if w:
                own = np.flatnonzero(self.widths[pick] == w)
                out[own] = self._unpack(pick[own], w)
        counts = (self.e_starts[pick + 1] - self.e_starts[pick]).astype(np.int64)
        rows = np.repeat(np.arange(len(pick)), counts)
        at = np.concatenate([np.arange(a, b) for a, b in zip(self.e_starts[pick].tolist(), self.e_starts[pick + 1].tolist())] or [np.zeros(0)]).astype(np.int64)
        out[rows, self.places[at]] = self.values[at]
        return out + self.low[pick][:, None]

    def block(self, i: int) -> np.ndarray:
        return self.blocks(np.array([i]))[0][: self.n - i * int(self.size)]

    def ids(self) -> np.ndarray:
        return self.blocks(np.arange(len(self.low))).ravel()[: self.n]


class Remembered(dict):
    """What make(key) gave, for the keys used last: when `kept` are there they become the older generation, and a key used
    again comes back from it. Keys over PIECE_CHARS aren't kept, so the size is bounded in bytes too."""

    def __init__(self, make, kept: int):
        super().__init__()
        self.make, self.kept, self.older = make, kept, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) > PIECE_CHARS:
            return got
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """Ids of whole texts, as little-endian u32, by way of the parts between single spaces.

    The byte-level splitter never joins the end of a word to what follows a space, and hands a space to the word after
    it, so each part with its space before it is encoded on its own. Arrow cuts a slice of texts into parts and finds
    the distinct ones; each of those is encoded once, and numpy gathers their ids in the texts' order. Only runs of
    three spaces, and of two at the end, are split otherwise; a text with one is encoded whole. Parts of ASCII and Latin
    letters are cut as the splitter would, and the tokenizer's model encodes each piece; other parts go through the
    tokenizer. With `added`, as the library does by default, the content of an added token is that token; the tokenizer
    finds it before it splits, so every text with one is encoded whole. Without, it is text like any other.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.id_bytes = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.forget()

    def forget(self) -> None:
        """Drop the remembered pieces; a task does so at its end."""
        self.pieces = Remembered(self._piece, PIECES_KEPT)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, x: str) -> bytes:
        known = self.id_bytes
        if x.isascii() and x[1:].isalpha():
            x = SPACE_CHAR + x[1:] if x[0] == " " else x
        else:
            x = x.encode().decode("latin-1").translate(BYTE_CHARS)
        found = self.tokenize(x)
        return known[found[0].id] if len(found) == 1 else b"".join([known[t.id] for t in found])

    def _parts(self, before: str, parts: list[str]) -> list[bytes]:
        """The ids of each part with `before` before it."""
        pieces = self.pieces
        return [b"".join([pieces[x] for x in PIECES.findall(before + p)]) if PLAIN(p) else self._whole([before + p])[0] for p in parts]

    def _table(self, distinct) -> tuple[list[bytes], np.ndarray]:
        """Ids of pieces, and for each part, after a space, the up to five pieces that it is made of; piece 0 is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.extract_regex(distinct, COMMON)
        other = np.flatnonzero(cut.is_null().to_numpy(zero_copy_only=False))
        a, b, c, d, e = (cut.field(i) for i in range(5))
        again = pc.not_equal(pc.fill_null(d, ""), "")
        space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        coded = pa.concat_arrays([pc.binary_join_element_wise(space, pc.fill_null(a, ""), nothing), d.filter(again)]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(MARKS)
        mark = lambda x: pc.fill_null(pc.index_in(x.cast(pa.binary()), pa.array(MARKS, pa.binary())), 0).to_numpy(zero_copy_only=False)
        rows = np.zeros((len(distinct), 5), np.int64)
        rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 4] = code[: len(distinct)], mark(b), mark(c), mark(e)
        rows[again.to_numpy(zero_copy_only=False), 3] = code[len(distinct) :]
        pieces = self.pieces
        made = [pieces[m.decode()] if m else b"" for m in MARKS] + [pieces[w] for w in strings(coded.dictionary)]
        rows[other] = 0
        rows[other, 0] = len(made) + np.arange(len(other))
        return made + self._parts(" ", strings(distinct.take(pa.array(other)))), rows

    def encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = [has_long_space(t) or any(map(t.__contains__, self.added)) for t in texts]
        cut = pc.split_pattern(pa.array([t for t, w in zip(texts, whole) if not w], pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.asarray(cut.offsets)[1:] - np.asarray(cut.offsets)[0]
        heads = np.r_[0, ends[:-1]] if len(ends) else ends
        # a text's first part has no space before it: those are entries of their own
        first, place = np.unique(index[heads], return_inverse=True)
        index[heads] = len(distinct) + place
        made, rows = [b""], [np.zeros((0, 5), np.int64)]
        for a in range(0, len(distinct), PARTS_KEPT):
            more, their = self._table(distinct.slice(a, PARTS_KEPT))
            rows.append(their + len(made))
            made += more
        more = self._parts("", strings(distinct.take(pa.array(first))))
        rows.append(np.c_[len(made) + np.arange(len(more)), np.zeros((len(more), 4), np.int64)])
        ids, upto = gathered([*made, *more], np.concatenate(rows), index)
        bounds = (np.r_[0, upto[ends - 1]] * 4).tolist() if len(ends) else [0]
        plain = (ids[a:b] for a, b in zip(bounds, bounds[1:]))
        rest = iter(self._whole([t for t, w in zip(texts, whole) if w]))
        return [next(rest) if w else next(plain) for w in whole]


def gathered(made: list[bytes], rows: np.ndarray, index: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids of the parts `index`, where rows[i] are the pieces of part i and made has pieces' ids; and where each ends."""

    def lay(table, starts, sizes, order):
        out, ends, done = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0
        for a in range(0, len(order), 1 << 16):  # the places are eight times the ids, so some at a time
            some = order[a : a + (1 << 16)]
            n = sizes[some]
            upto = np.cumsum(n)
            out.append(table[np.repeat(starts[some] - (upto - n), n) + np.arange(upto[-1])])
            ends.append(upto + done)
            done += int(upto[-1])
        return np.concatenate(out), np.concatenate(ends)

    sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
    flat, upto = lay(np.frombuffer(b"".join(made), "<u4"), np.cumsum(sizes) - sizes, sizes, rows.ravel())
    ends = upto[rows.shape[1] - 1 :: rows.shape[1]]
    own = np.diff(ends, prepend=0)
    ids, upto = lay(flat, ends - own, own, index)
    return ids.tobytes(), upto


def has_long_space(t: str) -> bool:
    """Whether the text has a run of three spaces of any kind, or of two at its end. Without two together and without
    other spaces than blanks and line ends it can't, which is quick to see."""
    if "  " in t or " \n" in t or "\n " in t or "\n\n" in t or not t.replace("\n", "").isprintable():
        return LONG_SPACE(t) is not None
    return False


_ENCODERS: dict[str, Encoder] = {}


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text, null as empty, append end_id, and write the ids in ascending key order, null first.

    Texts are dealt by range of key, the one shuffle; each task packs its range into files of about FILE_IDS ids. Rows
    of equal keys keep together in any order. `tokenizer` names a file of the public tokenizers or is a path to one.
    """

    def run(batches):
        import os

        import public_tokenizers
        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lean_memory()
        file = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
        encoder = _ENCODERS.setdefault(file, None) or Encoder(file, added=True)
        _ENCODERS[file] = encoder  # the tokenizer alone is kept between tasks
        part, seq, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        held, keys, lengths, n = [], [], [], 0

        def close():
            payload = pack(np.frombuffer(b"".join(held), "<u4"), lengths, keys)
            row = {"part": part, "seq": seq, "n_ids": n, "n_docs": len(keys), "first_key": next((k for k in keys if k is not None), None), "last_key": keys[-1], "payload": payload}
            kinds = dict.fromkeys(row, pa.int64()) | {"part": pa.int32(), "seq": pa.int32(), "payload": pa.binary()}
            return pa.RecordBatch.from_pydict({c: [x] for c, x in row.items()}, schema=pa.schema(list(kinds.items())))

        try:
            for batch in batches:
                for some in byte_slices(batch, SLICE_BYTES):
                    for k, ids in zip(some.column(0).to_pylist(), encoder.encode([t or "" for t in strings(some.column(1))])):
                        held.append(ids + end)
                        keys.append(k)
                        lengths.append(len(ids) // 4 + 1)
                        n += lengths[-1]
                        if n >= FILE_IDS:
                            yield close()
                            held, keys, lengths, n, seq = [], [], [], 0, seq + 1
            if keys:
                yield close()
        finally:
            encoder.forget()

    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    dealt = slim.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())
    dealt.mapInArrow(run, FILES).write.option("compression", "none").parquet(f"{path}/files")
    # two levels: totals of parts in one small table, files within their part
    files = docs.sparkSession.read.schema(FILES).parquet(f"{path}/files").drop("payload")
    ahead = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", ahead(W.orderBy("part")).alias("before"))
    index = files.withColumn("within", ahead(W.partitionBy("part").orderBy("seq"))).join(parts, "part").withColumn("start", F.col("before") + F.col("within"))
    index.select(*INDEX).write.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, decoded from the files; start counts all ids before it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                p = Payload(data)
                ids = p.ids().astype("<u4").tobytes()
                ends = np.cumsum(p.lengths.astype(np.int64))
                starts = ends - p.lengths
                crc = [zlib.crc32(ids[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist())]
                keys = pa.array(p.keys, mask=p.present == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(crc), pa.int32()), pa.array([seq] * len(crc), pa.int32()), keys, pa.array(starts), pa.array(p.lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["part", "seq", "key", "inside", "n_tokens", "ids_crc32"],
                )

    bounded_batches(spark)
    files = spark.read.schema(FILES).parquet(f"{path}/files").select("part", "seq", "payload")
    docs = files.mapInArrow(run, "part int, seq int, key long, inside long, n_tokens long, ids_crc32 long")
    offsets = spark.read.schema(FILES.replace("payload binary", "start long")).parquet(f"{path}/index").select("part", "seq", F.col("start").alias("offset"))
    return docs.join(offsets, ["part", "seq"]).select(F.col("key").alias(key), (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents' places in token files, which are written to `path` or a new folder of the shared one."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token_files-{uuid.uuid4().hex}"
    write_token_files(docs, path)
    return read_token_files(spark, path)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"))
