"""Token ids in files of patched frame-of-reference blocks.

Documents are put in order (range partitions, sorted within), encoded, and each
partition becomes one shard.  A shard is a row of segments; a segment holds whole documents
of about ``SEGMENT`` ids and can be read alone:

    magic "LPF1", u32 documents, u64 ids, u32 blocks
    i64 id and u32 count of ids of each document
    u32 start of each block, and the end of the last
    blocks of 1,024 ids (the last: the rest): u32 minimum, u8 width, u16 exceptions,
        ids minus minimum packed in ``width`` bits (low bits first), then for each exception
        u16 position and u32 high part

The width holds ``PERCENTILE`` of the block's values; what exceeds it is an exception.  Segments
are stored through the cluster's own file system as binary rows of Parquet files beside their
shard and sequence number, so that lost executors leave no half-written shard.  Counts of ids
of shards and segments give each document's global start; no id is read for it.

Defined cases: a null text is empty and has the end id alone; a null id comes first; rows that
share an id follow each other in text order; repeated rows are written repeatedly; extra columns
are ignored; an empty table gives no segments and no rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.staging import new_path

END_ID, BLOCK, SEGMENT, PERCENTILE = 2, 1024, 1 << 18, 0.95
#: Bytes of a worker's memory of runs of letters (of other strings: an eighth), and what an entry takes besides its string and ids.
REMEMBERED, ENTRY = 96 << 20, 220
#: Bytes of texts encoded at once, rows of a batch, and white space beyond ASCII (or that only Python takes for it).
TOGETHER, BATCH_ROWS = 4 << 20, 2048
_ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of texts in a shard, at most on average.
SHARD_BYTES = 32 << 20
MAGIC = b"LPF1"


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values packed ``width`` bits each, low bits first."""
    kind = "<u2" if width <= 16 else "<u4"
    bits = np.unpackbits(values.astype(kind).view(np.uint8), axis=1, bitorder="little")
    bits = bits.reshape(len(values), values.shape[1], -1)[:, :, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ``ids`` (unsigned 32-bit)."""
    n = len(ids)
    if not n:
        return []
    rows = -(-n // BLOCK)
    v = np.full(rows * BLOCK, ids[-1], np.uint32)
    v[:n] = ids
    v = v.reshape(rows, BLOCK)
    if n % BLOCK:
        v[-1, n % BLOCK :] = v[-1, : n % BLOCK].min()
    low = v.min(axis=1)
    v = v - low[:, None]
    at = np.partition(v, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
    width = np.array([int(x).bit_length() for x in at])
    blocks: list[bytes] = [b""] * rows
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        part = v[which]
        high = part >> np.uint32(w) if w < 32 else np.zeros_like(part)
        packed = _bits(part, w)
        for r, i in enumerate(which.tolist()):
            length = n - i * BLOCK if i == rows - 1 else BLOCK
            where = np.flatnonzero(high[r])
            blocks[i] = struct.pack("<IBH", low[i], w, len(where)) + packed[r, : -(-length * w // 8)].tobytes() + where.astype("<u2").tobytes() + high[r, where].astype("<u4").tobytes()
    return blocks


def decode_block(data: memoryview, n: int) -> np.ndarray:
    """The ``n`` ids of one block."""
    low, w, k = struct.unpack_from("<IBH", data)
    end = 7 + -(-n * w // 8)
    kind = np.dtype("<u2" if w <= 16 else "<u4")
    bits = np.zeros((n, kind.itemsize * 8), np.uint8)
    bits[:, :w] = np.unpackbits(np.frombuffer(data, np.uint8, end - 7, 7), bitorder="little")[: n * w].reshape(n, w)
    v = np.packbits(bits, bitorder="little").view(kind).astype(np.uint32)
    where = np.frombuffer(data, "<u2", k, end)
    v[where] |= np.frombuffer(data, "<u4", k, end + 2 * k) << np.uint32(w)
    return v + np.uint32(low)


def encode_segment(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    """One segment; a null document id is the smallest long."""
    blocks = encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u4")
    head = MAGIC + struct.pack("<IQI", len(doc_ids), len(ids), len(blocks))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<u4").tobytes(), starts.tobytes(), *blocks])


def decode_segment(data: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, counts, token ids); ``first`` and ``last`` choose blocks through the index."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, n, blocks = struct.unpack_from("<IQI", data, 4)
    at = 20
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    starts = np.frombuffer(data, "<u4", blocks + 1, at + 12 * docs)
    base, view = at + 12 * docs + 4 * (blocks + 1), memoryview(data)
    parts = [decode_block(view[base + starts[b] : base + starts[b + 1]], min(BLOCK, n - b * BLOCK)) for b in range(first, blocks if last is None else last)]
    return doc_ids, counts, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class Memory:
    """Ids of strings in two generations of up to half of ``limit`` bytes: the young one, when full, becomes the old one,
    from which it takes what comes up again."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit, self.size = encode, limit, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, words: list[str]) -> list[bytes]:
        """The ids of distinct strings."""
        found = list(map(self.young.get, words))
        lost = [w for w, x in zip(words, found, strict=True) if x is None]
        if lost:
            fresh = {w: self.old[w] for w in lost if w in self.old}
            new = [w for w in lost if w not in fresh]
            fresh.update(zip(new, self.encode(new), strict=True))
            found = [fresh[w] if x is None else x for w, x in zip(words, found, strict=True)]
            size = sum(map(len, fresh)) + sum(map(len, fresh.values())) + ENTRY * len(fresh)
            if self.size + size > self.limit // 2:
                self.old, self.young, self.size = self.young, {}, 0
            if size <= self.limit // 2:
                self.young.update(fresh)
                self.size += size
        return found


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def splits_at_space(definition: dict) -> bool:
    """Whether a tokenizer's definition is of the kind for which texts may be parted at white space and lower-cased by runs of
    letters: it lower-cases, its pre-tokenizer drops white space and takes letters and signs apart, and the last token of a
    run ends in ``</w>``; nothing else in it looks beyond a run."""
    normal, before, model = (definition.get(x) or {} for x in ("normalizer", "pre_tokenizer", "model"))
    kinds = [x.get("type") for x in normal.get("normalizers", [normal])]
    split = [x for x in before.get("pretokenizers", []) if x.get("type") == "Split"]
    return (
        "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"}
        and [x.get("type") for x in before.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        and split[0].get("behavior") == "Removed" and split[0].get("invert") is True
        and split[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not before["pretokenizers"][1].get("add_prefix_space")
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and definition.get("post_processor") is None and definition.get("truncation") is None
    )


class Encoder:
    """Ids of texts; of a tokenizer of another kind (``splits_at_space``) plainly.  No token of this kind of tokenizer crosses white space, so texts are split there (by Arrow)
    and each distinct string is encoded once.  A string of Latin letters and plain signs is the token runs of its lower-case
    letters and of its signs, which are looked up apart.  Workers remember runs and other strings in bounded memories."""

    _parts = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[.,;:!?|$%&*#()]*)$"

    def __init__(self, tokenizer_path: str, remembered: int = REMEMBERED):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            self.plain = not splits_at_space(json.load(f))
        self.letters, self.others = Memory(self._letters, remembered), Memory(self._encode, remembered // 8)
        self.odd = re.compile(r"[^ \t\r\n]+").findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: many in one call, parted behind the tokens that end a word."""
        out: list[bytes] = []
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            raw = self._encode([" ".join(part)])[0]
            cut = ((np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1) * 4).tolist()
            if len(cut) == len(part) and cut[-1] == len(raw):
                out += [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)]
            else:
                out += self._encode(part)
        return out

    def many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        texts = texts.cast(pa.large_string())
        if self.plain:
            return self._encode(texts.to_pylist())
        if pc.any(pc.match_substring_regex(texts, _ODD_SPACE)).as_py():
            # str.split also parts at four control characters that are no white space to the tokenizer
            plain = [self.odd(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts.to_pylist()]
            offsets = np.cumsum([0, *map(len, plain)])
            flat = pa.array([w for p in plain for w in p], pa.large_string())
        else:
            split = pc.ascii_split_whitespace(texts)
            flat, offsets = split.flatten(), split.offsets.to_numpy()
            offsets = offsets - offsets[0]
        numbered = flat.dictionary_encode()
        words, at = numbered.dictionary, numbered.indices.to_numpy(zero_copy_only=False)
        two = pc.extract_regex(words, self._parts)
        simple = pc.is_valid(two).to_numpy(zero_copy_only=False)
        letters = pc.utf8_lower(two.field("a").filter(pa.array(simple))).dictionary_encode()
        signs = two.field("b").filter(pa.array(simple)).dictionary_encode()
        rest = words.filter(pa.array(~simple))
        # the distinct pieces: runs of letters, runs of signs, other strings, and the empty one
        pieces = [*self.letters(_strings(letters.dictionary)), *self.others(_strings(signs.dictionary)), *self.others(_strings(rest)), b""]
        first, second = np.empty(len(words), np.int64), np.full(len(words), len(pieces) - 1)
        first[simple], first[~simple] = letters.indices.to_numpy(), len(letters.dictionary) + len(signs.dictionary) + np.arange(len(rest))
        second[simple] = len(letters.dictionary) + signs.indices.to_numpy()
        piece = np.stack([first[at], second[at]], axis=1).ravel()
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        begin = np.cumsum(size) - size
        per = size[piece]
        ends = np.cumsum(per)
        pool = np.frombuffer(b"".join(pieces), "<u4")
        raw = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[piece] - (ends - per), per)].tobytes()
        cut = (np.r_[0, ends][offsets * 2] * 4).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def __call__(self, text: str) -> bytes:
        return self.many(pa.array([text]))[0]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder, which its next tasks find warm."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", order: list | None = None, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` to ``path`` in ascending ``order`` (columns; default: id, then text)."""
    by = [F.col(id_col), F.col(text_col)] if order is None else [*order]
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *[c.alias(f"o{n}") for n, c in enumerate(by)])
    keys = [f"o{n}" for n in range(len(by))]
    # partitions of bounded size, by id and text, so that rows without id or of one id are dealt too
    size = d.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ranges = ["o0", F.substring("o1", 1, 64)] if order is None else keys  # in the order of the keys
    d = d.repartitionByRange(parts, *ranges).sortWithinPartitions(*keys).select("i", "t")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, encode = TaskContext.get().partitionId(), 0, _encoder(tokenizer_path)
        ids: list[bytes] = []
        doc_ids: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            payload = encode_segment(doc_ids, [len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_pydict({"shard": [shard], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [size], "payload": [payload]}, schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
        for batch in (whole.slice(i, BATCH_ROWS) for whole in batches for i in range(0, whole.num_rows, BATCH_ROWS)):
            room = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(room)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                for i, found in zip(part.column(0).to_pylist(), encode.many(part.column(1)), strict=True):
                    ids.append(found + end)
                    doc_ids.append(i)
                    size += len(ids[-1]) // 4
                    if size >= SEGMENT:
                        yield flush()
                        ids, doc_ids, size, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    d.mapInArrow(run, "shard int, seq int, n_docs long, n_tokens long, payload binary").write.option("compression", "uncompressed").parquet(path)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    files = spark.read.schema("shard int, seq int, n_docs long, n_tokens long, payload binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seq, payload in zip(*(batch.column(c) for c in range(3)), strict=True):
                docs, counts, ids = decode_segment(payload.as_py())
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(docs)
                out = [pa.array([shard.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()), pa.array(docs), pa.array(starts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["shard", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    rows = files.select("shard", "seq", "payload").mapInArrow(run, "shard int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    index = files.select("shard", "seq", "n_tokens")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a task that wrote
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_at"))
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    index = index.select(F.col("shard").alias("s"), F.col("seq").alias("q"), F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("seg_at")).join(shards, "s")
    out = rows.join(index, (F.col("shard") == F.col("s")) & (F.col("seq") == F.col("q")))
    doc_id = F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id")
    start = (F.col("shard_at") + F.col("seg_at") + F.col("at")).alias("start")
    return out.select(doc_id, start, "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(doc_id, start, n_tokens, ids_crc32, ids)`` decoded from the files at ``path``."""
    return _read(spark, path, True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(doc_id, start, n_tokens, ids_crc32)`` decoded from the files at ``path``."""
    return _read(spark, path, False)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path())
    return read_digests(spark, path)
