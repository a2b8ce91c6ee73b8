"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

Both encode the bytes of space + text.  Two pointers move over the cumulative ends of both sides' tokens; where
both end, a group of tokens closes.  Each A and each B token of a group are linked.  What two
ids are worth to each other is counted over all documents that hold them linked.

* No token of these tokenizers crosses the border between a visible character and a space or line end (``parts_at_space`` asks
  the tokenizers' definitions; others are encoded whole), so texts are parted there, a worker encodes and merges
  each distinct part once, and a document is the sequence of its parts.  Workers remember a bounded number of parts.
* A task deals its documents into chunks of bounded bytes.  A chunk carries one row for each of its distinct pairs of ids with the number of its documents
  that hold it (the counts' pre-aggregation), and each document's links as numbers of that list.  This is written once.
* Spark sums the pairs over all chunks, takes each side's maxima (no more rows than its vocabulary has ids, so they may be broadcast), joins
  both back to the chunks' pairs, and gives them to the documents of their chunk.  No document's links are ever shuffled as rows.

``mapInArrow`` rather than ``mapInPandas``, so that null ids leave the others exact.

Defined cases: a null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens: all counts
are zero and its groups are the empty string.  Each row is a document of its own, also if rows share an id or have none.  Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import stage

#: Bytes of texts in a chunk (a longer text is a chunk), and parts that a worker remembers.
CHUNK, REMEMBERED = 2 << 20, 300_000
#: Parts that are encoded as one text, and bytes beyond which a part is encoded by itself.
TOGETHER, LONG = 512, 512
A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"


def byte_of_sign() -> dict[str, int]:
    """Which byte each sign of a byte-level vocabulary stands for: printable Latin-1 ones for themselves, the others, in order, for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        signs = byte_of_sign()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.b_space = self.b.piece_to_id(SPACE)
        self.parted = self.parts_at_space(pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # ids as text with what follows them: an A id, the last A id of a group, a B id, the last B id of a group
        numbers_a, numbers_b = range(len(self.a_bytes)), range(len(self.b_bytes))
        self.written = np.array([*(f"{i}," for i in numbers_a), *(f"{i}|" for i in numbers_a), *(f"{i}," for i in numbers_b), *(f"{i};" for i in numbers_b)], object)

    def parts_at_space(self, pieces: list[str]) -> bool:
        """Whether texts may be parted before a space or line end that follows a visible character: A is byte-level with the usual pattern and no
        normaliser; no piece of B holds a space after a visible character, or a line end; B keeps all spaces and adds one."""
        a = json.loads(self.a.to_str())
        before = a.get("pre_tokenizer") or {}
        if a.get("normalizer") or a.get("post_processor") or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            return False
        if a["model"].get("type") != "BPE" or a["model"].get("dropout"):
            return False
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            return False
        probe = "a  B\nﬁ \n x"
        return b"".join(self.b_bytes[i] for i in self.b.encode(probe)) == (" " + probe).encode() and self.b_space != self.b.unk_id()

    def parts(self, text: str) -> list[str]:
        """Space + text, cut where no token crosses."""
        whole = " " + text
        if not self.parted:
            return [whole]
        return _WORDS(whole) if not _ODD(whole) else _CUT(whole)

    def encode_alone(self, part: str) -> tuple[list[int], list[int]]:
        """Ids of one part by A and B; B puts a space before what it is given."""
        a = self.a.encode(part, add_special_tokens=False).ids
        if part == " ":
            return a, [self.b_space]
        if part[0] == " ":
            return a, self.b.encode(part[1:])
        b = self.b.encode(part)
        return a, b[1:] if b[:1] == [self.b_space] else []

    def encode_together(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and B of runs of parts, each run as one text: every part ends in a visible character."""
        texts = ["".join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]
        a = self.a.encode_batch_fast(texts, add_special_tokens=False)
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        b = [y if t[0] == " " or y[:1] != [self.b_space] else y[1:] for t, y in zip(texts, b, strict=True)]
        return [(np.array(x.ids, np.int64), np.array(y, np.int64)) for x, y in zip(a, b, strict=True)]


_WORDS = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
_ODD = re.compile(r"[^\S \n]").search
_CUT = re.compile(r"(?<=\S)(?=[ \n])").split


def merge(a_ids: list[int], b_ids: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> list[tuple[int, int]]:
    """Where groups end: two pointers over the cumulative ends of tokens; pairs (A tokens, B tokens) up to there."""
    out, i, j = [], 0, 0
    a_end = b_end = 0
    while i < len(a_ids) or j < len(b_ids):
        if a_end <= b_end and i < len(a_ids):
            a_end += len(a_bytes[a_ids[i]])
            i += 1
        else:
            b_end += len(b_bytes[b_ids[j]])
            j += 1
        if a_end == b_end:
            out.append((i, j))
    return out


class Parts:
    """What a worker knows of parts: numbers of tokens, groups and links, the groups as text, the links as numbers of pairs."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pair: dict[int, int] = {}
        self.pairs = array("q")
        self.sizes = array("q")  # A tokens, B tokens, groups, links, faults of each part
        self.groups: list[str] = []
        self.links, self.times, self.ends = array("i"), array("q"), array("q", [0])  # each part's pair numbers and how often they are linked there

    def numbers(self, parts: list[str]) -> np.ndarray:
        found = list(map(self.number.get, parts))
        if None in found:
            self.learn(list(dict.fromkeys(p for p, x in zip(parts, found, strict=True) if x is None)))
            found = list(map(self.number.__getitem__, parts))
        return np.array(found, np.int64)

    def learn(self, fresh: list[str]) -> None:
        """Encode and merge new parts: short ones many at a time, others, and those of runs that do not come back whole, by themselves."""
        t = self.tokenizers
        short = [p for p in fresh if len(p) <= LONG and not p[-1].isspace()] if t.parted else []
        alone = set(fresh).difference(short)
        for i, (a, b) in enumerate(t.encode_together(short)):
            parts = short[i * TOGETHER : (i + 1) * TOGETHER]
            raw = [p.encode() for p in parts]
            if b"".join([t.a_bytes[x] for x in a.tolist()]) == b"".join([t.b_bytes[x] for x in b.tolist()]) == b"".join(raw):
                self._merge_run(parts, np.cumsum([len(x) for x in raw]), a, b)
            else:
                alone.update(parts)
        for part in fresh:
            if part in alone:
                self._merge_one(part, *t.encode_alone(part))

    def _remember(self, keys: list[int]) -> list[int]:
        """Numbers of pairs."""
        out = []
        for key in keys:
            at = self.pair.get(key)
            if at is None:
                at = self.pair[key] = len(self.pairs)
                self.pairs.append(key)
            out.append(at)
        return out

    def _merge_run(self, parts: list[str], part_ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """The two pointers over a run of parts: both lists of ends ascend, so what both hold is found by merging them."""
        t = self.tokenizers
        a_ends, b_ends = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        closes = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(closes, a_ends), np.searchsorted(closes, b_ends)
        group_part = np.searchsorted(part_ends, closes)
        k, n = len(closes), len(parts)
        a_count, b_count = np.bincount(a_group, minlength=k), np.bincount(b_group, minlength=k)
        # the groups' text: ids in order of group and side
        last_a, last_b = np.r_[a_group[1:] != a_group[:-1], True], np.r_[b_group[1:] != b_group[:-1], True]
        va, vb = len(t.a_bytes), len(t.b_bytes)
        which = np.r_[a + va * last_a, b + 2 * va + vb * last_b][np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable")]
        strings = t.written[which].tolist()
        tokens = np.cumsum(np.bincount(group_part, a_count + b_count, n)).astype(np.int64).tolist()
        # all links: each A token of a group with each of its B tokens
        per = b_count[a_group]
        stop = np.cumsum(per)
        b_first = np.cumsum(b_count) - b_count
        at = np.arange(stop[-1]) - np.repeat(stop - per, per) + np.repeat(b_first[a_group], per)
        keys = np.repeat(a, per) << 32 | b[at]
        owner = np.repeat(group_part[a_group], per)
        distinct, inverse = np.unique(keys, return_inverse=True)
        linked, times = np.unique(owner * len(distinct) + inverse, return_counts=True)
        numbers = np.array(self._remember(distinct.tolist()), np.int64)[linked % len(distinct)]
        sizes = np.stack([np.bincount(group_part[a_group], minlength=n), np.bincount(group_part[b_group], minlength=n), np.bincount(group_part, minlength=n), np.bincount(owner, minlength=n), np.zeros(n, np.int64)], axis=1)
        first = len(self.groups)
        self.number.update(zip(parts, range(first, first + n), strict=True))
        self.groups += ["".join(strings[x:y])[:-1] for x, y in zip([0, *tokens], tokens, strict=False)]
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.ends.frombytes((len(self.links) + np.cumsum(np.bincount(linked // len(distinct), minlength=n))).astype(np.int64).tobytes())
        self.links.frombytes(numbers.astype(np.int32).tobytes())
        self.times.frombytes(times.astype(np.int64).tobytes())

    def _merge_one(self, part: str, a_ids: list[int], b_ids: list[int]) -> None:
        a_bytes, b_bytes, raw = self.tokenizers.a_bytes, self.tokenizers.b_bytes, part.encode()
        self.number[part] = len(self.groups)
        if b"".join([a_bytes[i] for i in a_ids]) != raw or b"".join([b_bytes[i] for i in b_ids]) != raw:
            self.sizes.extend((0, 0, 0, 0, 1))
            self.groups.append("")
            self.ends.append(len(self.links))
            return
        written, linked, n, i0, j0 = [], {}, 0, 0, 0
        for i, j in merge(a_ids, b_ids, a_bytes, b_bytes):
            left, right = a_ids[i0:i], b_ids[j0:j]
            written.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
            n += len(left) * len(right)
            for x, k in _tally(left).items():
                for y, m in _tally(right).items():
                    linked[x << 32 | y] = linked.get(x << 32 | y, 0) + k * m
            i0, j0 = i, j
        self.links.extend(self._remember(list(linked)))
        self.times.extend(linked.values())
        self.sizes.extend((len(a_ids), len(b_ids), len(written), n, 0))
        self.groups.append(";".join(written))
        self.ends.append(len(self.links))


def _tally(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i in ids:
        out[i] = out.get(i, 0) + 1
    return out


def packed(*parts: np.ndarray) -> bytes:
    """Sequences of unsigned integers of one length, each by planes of its bytes, which compress well: u32 length, u8 width of each, planes."""
    widths = [next(w for w in (1, 2, 4, 8) if not len(v) or int(v.max()) < 1 << (8 * w - 1)) for v in parts]
    body = [v.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T.tobytes() for v, w in zip(parts, widths, strict=True)]
    return struct.pack(f"<I{len(parts)}B", len(parts[0]), *widths) + b"".join(body)


def unpacked(data: bytes, k: int) -> list[np.ndarray]:
    n, *widths = struct.unpack_from(f"<I{k}B", data)
    at, out = 4 + k, []
    for w in widths:
        out.append(np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T.copy().view(f"<u{w}").reshape(-1).astype(np.int64))
        at += n * w
    return out


def chunk_rows(store: Parts, texts: list[str | None]) -> tuple[dict[str, list], dict[str, list]]:
    """A chunk's documents (counts, groups, links) and its pairs (ids, number of documents)."""
    per = [store.tokenizers.parts(t) if t else [] for t in texts]
    at = store.numbers([p for d in per for p in d])
    lengths = np.array([len(d) for d in per], np.int64)
    edges = np.r_[0, np.cumsum(lengths)]
    sizes = np.frombuffer(store.sizes, np.int64).reshape(-1, 5)[at]
    sums = np.r_[np.zeros((1, 5), np.int64), np.cumsum(sizes, axis=0)]
    totals = sums[edges[1:]] - sums[edges[:-1]]
    good = totals[:, 4] == 0
    totals[~good] = 0
    groups = [";".join([store.groups[i] for i in at[a:b].tolist()]) if ok else "" for a, b, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), good.tolist(), strict=True)]
    # all links of the chunk: (document, pair number, times)
    ends = np.frombuffer(store.ends, np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    keep = good[doc]
    at, doc = at[keep], doc[keep]
    n = ends[at + 1] - ends[at]
    stop = np.cumsum(n)
    where = np.arange(stop[-1] if len(stop) else 0) + np.repeat(ends[at] - (stop - n), n)
    link, times, doc = np.frombuffer(store.links, np.int32)[where].astype(np.int64), np.frombuffer(store.times, np.int64)[where], np.repeat(doc, n)
    there = np.zeros(len(store.pairs), bool)
    there[link] = True
    pairs = np.frombuffer(store.pairs, np.int64)[there]
    order = np.argsort(pairs)  # a chunk's numbers do not depend on what the worker met before
    k = len(pairs)
    numbered = np.zeros(len(there), np.int64)
    numbered[np.flatnonzero(there)[order]] = np.arange(k)
    key, inverse = np.unique(doc * max(k, 1) + numbered[link], return_inverse=True)
    total = np.bincount(inverse, times, len(key)).astype(np.int64)
    key_doc, key_pair = key // max(k, 1), key % max(k, 1)
    cut = np.searchsorted(key_doc, np.arange(len(texts) + 1)).tolist()
    links = [packed(np.diff(key_pair[a:b], prepend=0), total[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    pairs = pairs[order]
    documents = {"n_a": totals[:, 0].tolist(), "n_b": totals[:, 1].tolist(), "n_groups": totals[:, 2].tolist(), "n_links": totals[:, 3].tolist(), "groups": groups, "links": links}
    return documents, {"a": (pairs >> 32).tolist(), "b": (pairs & 0xFFFFFFFF).tolist(), "docs": np.bincount(key_pair, minlength=k).tolist() if k else []}


_stores: dict[tuple[str, str], Parts] = {}


def _store(a_path: str, b_path: str) -> Parts:
    """The worker's memory, which its next tasks find warm."""
    if (a_path, b_path) not in _stores:
        _stores.clear()
        _stores[a_path, b_path] = Parts(Tokenizers(a_path, b_path))
    return _stores[a_path, b_path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def aligned(docs: DataFrame, *, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, remembered: int = REMEMBERED) -> DataFrame:
    """Rows of documents ``(chunk, doc_id, n_a, n_b, n_groups, n_links, groups, links)``, ``groups`` as text ``a1,a2|b1;a3|b2,b3``, and after
    each chunk's documents one row that has its distinct pairs of ids instead: ``pairs``, an array of ``(a, b, docs)``."""
    kind = docs.schema[id_col].dataType.simpleString()
    pair_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int32())]))
    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, seq, part = _store(a_path, b_path), 0, TaskContext.get().partitionId()

        def close(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            nonlocal seq
            if len(store.number) > remembered:
                store.forget()
            d, p = chunk_rows(store, texts)
            n = len(texts)
            blank = lambda values, t: pa.array([*values, None], t)
            pairs = pa.array([*[None] * n, [{"a": a, "b": b, "docs": k} for a, b, k in zip(p["a"], p["b"], p["docs"], strict=True)]], pair_type)
            counts = [blank(d[c], pa.int64()) for c in names[2:6]]
            number = pa.array([part << 32 | seq] * (n + 1), pa.int64())
            seq += 1
            return pa.RecordBatch.from_arrays([number, pa.concat_arrays([ids, pa.nulls(1, ids.type)]), *counts, blank(d["groups"], pa.string()), blank(d["links"], pa.binary()), pairs], names)

        held: list[str | None] = []
        keys: list[pa.Array] = []
        size = 0
        for batch in batches:
            from_row = 0
            for i, text in enumerate(batch.column(1)):
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size >= chunk:
                    keys.append(batch.column(0).slice(from_row, i + 1 - from_row))
                    yield close(pa.concat_arrays(keys), held)
                    held, keys, size, from_row = [], [], 0, i + 1
            if from_row < batch.num_rows:
                keys.append(batch.column(0).slice(from_row))
        if held:
            yield close(pa.concat_arrays(keys), held)

    schema = f"chunk long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pairs array<struct<a:int,b:int,docs:int>>"
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def _chunk_pairs(rows: DataFrame) -> DataFrame:
    found = rows.where(F.col("pairs").isNotNull()).select("chunk", F.posexplode("pairs").alias("number", "p"))
    return found.select("chunk", "number", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.docs").alias("docs"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """Rows ``(a, b, n_docs, best_a, best_b)``: how many documents hold a pair linked, and whether that is the highest count of its A and of its B id."""
    counts = _chunk_pairs(rows).groupBy("a", "b").agg(F.sum("docs").alias("n_docs"))
    # one row for each id of a vocabulary
    top_a = F.broadcast(counts.groupBy(F.col("a").alias("ta")).agg(F.max("n_docs").alias("ma")))
    top_b = F.broadcast(counts.groupBy(F.col("b").alias("tb")).agg(F.max("n_docs").alias("mb")))
    both = counts.join(top_a, F.col("a") == F.col("ta")).join(top_b, F.col("b") == F.col("tb"))
    return both.select("a", "b", "n_docs", (F.col("n_docs") == F.col("ma")).alias("best_a"), (F.col("n_docs") == F.col("mb")).alias("best_b"))


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of ``rows`` with ``n_best`` (links whose count is their A id's highest) and ``count_sum`` (over links), without links."""
    worth = _chunk_pairs(rows).join(counts.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "n_docs", "best_a"), (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")))
    worth = worth.select(F.col("chunk").alias("of"), "number", "n_docs", "best_a")
    documents = rows.where(F.col("pairs").isNull()).drop("pairs")
    kept = [c for c in documents.columns if c not in ("chunk", "links")]

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("number").to_numpy())
        count, best = right.column("n_docs").to_numpy()[order], right.column("best_a").to_numpy()[order]
        n_best, count_sum = [], []
        for data in left.column("links"):
            steps, times = unpacked(data.as_py(), 2)
            at = np.cumsum(steps)
            n_best.append(int(times[best[at].astype(bool)].sum()))
            count_sum.append(int((times * count[at]).sum()))
        return left.select(kept).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    schema = ", ".join(f"{c} {t}" for c, t in documents.select(*kept).dtypes) + ", n_best long, count_sum long"
    return documents.groupBy("chunk").cogroup(worth.groupBy("of")).applyInArrow(weigh, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = aligned(docs, a_path=tokenizer_path(A_NAME), b_path=tokenizer_path(B_NAME))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = stage(rows.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    out = with_counts(rows, pair_counts(rows))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
