"""Named entities by a pluggable recogniser that each worker loads once.

Null texts are skipped and counted; offsets are half-open, in code points."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from importlib.util import find_spec
from pathlib import Path
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.columns import col, family, is_float, type_of

#: Text, in bytes, that a worker turns into Python's strings at once.
TEXT_BYTES = 1 << 20


@dataclass(frozen=True)
class NamedEntity:
    text: str
    label: str
    start_char: int
    end_char: int
    kb_id: str | None = None


class Recognizer(Protocol):
    """Loaded lazily on a worker; ``extract_many`` yields the entities of each text in order."""

    labels: frozenset[str]

    def extract_many(self, texts: Iterable[str]) -> Iterator[tuple[NamedEntity, ...]]: ...


@dataclass
class PatternRecognizer:
    """A recogniser by regular expressions, one for each label."""

    patterns: Mapping[str, str]

    @property
    def labels(self) -> frozenset[str]:
        return frozenset(self.patterns)

    def extract_many(self, texts: Iterable[str]) -> Iterator[tuple[NamedEntity, ...]]:
        compiled = [(label, re.compile(p)) for label, p in self.patterns.items()]
        for text in texts:
            found = [NamedEntity(m[0], label, m.start(), m.end()) for label, p in compiled for m in p.finditer(text)]
            yield tuple(sorted(found, key=lambda e: (e.start_char, e.end_char, e.label)))


class ModelRecognizer:
    """A spaCy pipeline, if that library is there.  Its version and the digest of its files may be pinned; labels that
    the pipeline does not give, and texts longer than it takes, are refused.  Each worker checks and loads it once."""

    def __init__(self, model: str, *, labels: Iterable[str] | None = None, expected_version: str | None = None, expected_sha256: str | None = None, batch_size: int = 256, processes: int = 1):
        if batch_size < 1 or processes < 1:
            raise ValueError("batch_size and processes are at least 1")
        if expected_sha256 is not None and not re.fullmatch(r"[0-9a-f]{64}", expected_sha256.strip().lower()):
            raise ValueError("a pinned digest has 64 hexadecimal digits")
        self.model, self.expected_version, self.expected_sha256, self.batch_size, self.processes = model, expected_version, expected_sha256, batch_size, processes
        self.labels = frozenset(labels or ())
        if any(not label.strip() for label in self.labels):
            raise ValueError("labels must not be blank")
        self._nlp = None

    def __getstate__(self):
        return {**self.__dict__, "_nlp": None}

    def _load(self):
        if self._nlp is None:
            import spacy

            if self.expected_sha256 is not None and directory_sha256(model_folder(self.model)) != self.expected_sha256.strip().lower():
                raise ValueError("the model differs from its pinned digest")
            nlp = spacy.load(self.model)
            if self.expected_version is not None and nlp.meta.get("version") != self.expected_version:
                raise ValueError("the model differs from its pinned version")
            given = {label for found in nlp.pipe_labels.values() for label in found}
            if lost := sorted(self.labels - given):
                raise ValueError(f"the model does not give the labels {lost}")
            self._nlp = nlp
        return self._nlp

    def describe(self) -> dict:
        """What an audit tells of the model; loads it."""
        nlp = self._load()
        return {"model": self.model, "version": nlp.meta.get("version"), "sha256": directory_sha256(model_folder(self.model)), "labels": sorted(self.labels)}

    def extract_many(self, texts: Iterable[str]) -> Iterator[tuple[NamedEntity, ...]]:
        nlp = self._load()

        def checked() -> Iterator[str]:
            for text in texts:
                if len(text) > nlp.max_length:
                    raise ValueError(f"a text has {len(text)} characters; the model takes {nlp.max_length}")
                yield text

        for doc in nlp.pipe(checked(), batch_size=self.batch_size, n_process=self.processes):
            yield tuple(NamedEntity(e.text, e.label_, e.start_char, e.end_char, e.kb_id_ or None) for e in doc.ents if not self.labels or e.label_ in self.labels)


def model_folder(model: str) -> Path:
    """The folder of a model given by path or by the name of an installed package."""
    if Path(model).expanduser().is_dir():
        return Path(model).expanduser().resolve()
    try:
        spec = find_spec(model)
    except (ImportError, ValueError):
        spec = None
    places = list(spec.submodule_search_locations or ()) if spec else []
    if len(places) != 1:
        raise ValueError(f"no model {model!r} is found")
    return Path(places[0]).resolve()


def directory_sha256(root: Path) -> str:
    """Digest of a model's files in the order of their paths, without compiled ones.  Fixed format: path and content, each
    after its length as eight bytes, the highest first."""
    if not root.is_dir():
        raise ValueError("the model must be a directory")
    paths = {p.relative_to(root).as_posix(): p for p in root.rglob("*") if p.is_file() and p.suffix != ".pyc" and "__pycache__" not in p.parts}
    if not paths:
        raise ValueError("the model holds no files")
    total = hashlib.sha256()
    for name in sorted(paths):
        total.update(struct.pack(">Q", len(name.encode())) + name.encode() + struct.pack(">Q", paths[name].stat().st_size))
        with paths[name].open("rb") as f:
            while part := f.read(1 << 20):
                total.update(part)
    return total.hexdigest()


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices of at most ``TEXT_BYTES`` of text (one row at least), so that Python holds few texts at once, however many rows the
    engine sends."""
    sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
    low = total = 0
    for at, size in enumerate(sizes.tolist()):
        if at > low and total + size > TEXT_BYTES:
            yield batch.slice(low, at - low)
            low, total = at, 0
        total += size
    if low < len(sizes):
        yield batch.slice(low)


def extract(df: DataFrame, recognizer: Recognizer, *, id_col: str, text_col: str = "text", max_chars: int | None = None, labels: Iterable[str] | None = None) -> DataFrame:
    """Rows ``(row_id, text, label, start_char, end_char, kb_id)``.  A text longer than ``max_chars`` (default: what the recognizer
    itself can take, if it has a limit) fails the query."""
    max_chars = getattr(recognizer, "max_chars", None) if max_chars is None else max_chars
    only = frozenset(labels or ())
    if only and recognizer.labels and not only <= recognizer.labels:
        raise ValueError(f"unknown labels {sorted(only - recognizer.labels)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _small(whole)):
            rows = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if max_chars is not None and any(len(t) > max_chars for _, t in rows):
                raise ValueError(f"a text has more than {max_chars} characters")
            out = [(i, e) for (i, _), es in zip(rows, recognizer.extract_many([t for _, t in rows]), strict=True) for e in es if not only or e.label in only]
            columns = [pa.array([i for i, _ in out], batch.column(0).type), *[pa.array([getattr(e, n) for _, e in out], t) for n, t in (("text", pa.string()), ("label", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("kb_id", pa.string()))]]
            yield pa.RecordBatch.from_arrays(columns, ["row_id", "text", "label", "start_char", "end_char", "kb_id"])

    d = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("row_id"), F.col(text_col).alias("t"))
    kind = d.schema["row_id"].dataType.simpleString()
    return d.mapInArrow(run, f"row_id {kind}, text string, label string, start_char long, end_char long, kb_id string")


def label_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("entities"))


def numbered(df: DataFrame, name: str = "row_index") -> DataFrame:
    """``df`` with the place of each row, from zero, in the order in which it is read.  Only the rows of each partition are
    counted; the shifts (one row a partition) are broadcast."""
    placed = df.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    joined = placed.join(F.broadcast(shift), part == F.col("__part"))
    return joined.withColumn(name, F.col("__shift") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__shift")


def check_request(df: DataFrame, *, text_col: str, id_col: str | None = None) -> None:
    """The text column is text; ids, if there are any, are present, finite and unique."""
    if lost := [c for c in (text_col, id_col) if c is not None and c not in df.columns]:
        raise ValueError(f"no columns {lost}")
    if family(type_of(df, text_col)) not in ("string", "void"):
        raise TypeError(f"column {text_col!r} is not text")
    if id_col is None:
        return
    i = col(id_col)
    bad = i.isNull()
    if is_float(type_of(df, id_col)):
        bad = bad | F.isnan(i) | (F.abs(i) == float("inf"))
    if df.where(bad).limit(1).count():
        raise ValueError(f"column {id_col!r} has missing or infinite ids")
    if df.groupBy(i).count().where("count > 1").limit(1).count():
        raise ValueError(f"column {id_col!r} is not unique")


def found_rows(df: DataFrame, recognizer: Recognizer, *, text_col: str = "text", id_col: str | None = None, labels: Iterable[str] | None = None) -> DataFrame:
    """Rows ``(row_index, record_id, text, label, start_char, end_char, kb_id)``, for an audit; without ids no ``record_id``."""
    rows = numbered(df.select(col(text_col).cast("string").alias("t"), *([col(id_col).alias("record_id")] if id_col else [])))
    key = F.struct("row_index", *(["record_id"] if id_col else [])).alias("key")
    found = extract(rows.select(key, "t"), recognizer, id_col="key", text_col="t", labels=labels)
    return found.select("row_id.*", "text", "label", "start_char", "end_char", "kb_id")


def audit(df: DataFrame, recognizer: Recognizer, *, id_col: str, text_col: str = "text") -> dict:
    """Counts of a run: rows, skipped null texts, entities by label."""
    rows, skipped = df.agg(F.count(F.lit(1)), F.count_if(F.col(text_col).isNull())).first()
    counts = {r.label: r.entities for r in label_counts(extract(df, recognizer, id_col=id_col, text_col=text_col)).collect()}
    return {"rows": rows, "skipped_null_texts": skipped, "entities": sum(counts.values()), "labels": dict(sorted(counts.items()))}
