"""Operator 3, token-id output: flat unsigned integer files and 64-bit document offsets, read through memory maps.

A folder holds, for each part k in ascending document order, ``k.bin`` (ids, uint16 or uint32 little-endian),
``k.idx`` (uint64: where each document of the part starts, and the part's total) and ``k.doc`` (int64 document ids),
and a ``manifest.json`` with the integer width and, for each part, its documents, tokens and base. Bases are prefix sums
of the parts' token counts; a document's global start is base + offset.

Parts are ranges of doc_id, as many as the bytes of text ask for; each is written by one task, chunk by chunk, under a name
of its own attempt and renamed when whole, so a repeated task replaces its part. NULL texts are empty documents (the end id alone). NULL ids sort first and read back as
NULL. Rows that repeat an id are all written, ordered by text. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.llm.shared import chunks, shared_root, small_batches

#: Stands for a NULL document id in a .doc file.
NULL_ID = -(1 << 63)
END_ID = 1
#: Bytes of text in a part at most, about; there are spark.sql.shuffle.partitions parts if that makes them smaller.
PART_BYTES = 256 << 20


# ---------------------------------------------------------------- files in the shared folder


def _local(url: str) -> str | None:
    """The path of a file: URL or plain path; None for other stores."""
    if url.startswith("file:"):
        return "/" + url.removeprefix("file:").lstrip("/")
    return url if "://" not in url else None


def write_file(url: str, parts: Iterable[bytes]) -> None:
    """Write piece by piece and rename, so that a file is whole or absent."""
    temp = f"{url}.{uuid.uuid4().hex}"
    if path := _local(url):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(temp), "wb") as f:
            f.writelines(parts)
        os.replace(_local(temp), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url)
    _, temp_path = fs.FileSystem.from_uri(temp)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(temp_path) as f:
        for p in parts:
            f.write(p)
    store.move(temp_path, path)


def read_map(url: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped where the store is a file system, read otherwise."""
    if path := _local(url):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


# ---------------------------------------------------------------- encoding


class WordEncoder:
    """tokenizers' ids of a text, word by word, with caches.

    Nothing in this tokenizer's normaliser or splitter reaches across ASCII white space, so a text's ids are those of its
    white-space-separated chunks. A chunk in turn is split before trailing ASCII punctuation that follows a letter (never
    an apostrophe or angle bracket), and an ASCII chunk is lower-cased, as the normaliser does anyway.
    """

    TAIL = ".,;:!?|)]}\"%*$&#"

    def __init__(self, path: str, dtype: str, limit: int = 450_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.dtype, self.limit = Tokenizer.from_file(path), dtype, limit
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_chunks, self.old_words = {}, {}  # the generation before; what is met again moves up
        (self.zero,) = self.model.encode("0", add_special_tokens=False).ids

    def _encode(self, texts: list[str]) -> None:
        """Many short words go to the library as one text, with a digit that none of them has between them."""
        plain = [t for t in texts if "0" not in t]
        for lo in range(0, len(plain), 2000):
            group = plain[lo : lo + 2000]
            ids = np.array(self.model.encode_batch_fast([" 0 ".join(group)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(ids == self.zero)
            raw, width, at = ids.tobytes(), ids.itemsize, 0
            if len(cuts) != len(group) - 1:
                raise AssertionError("words and separators do not match")
            for t, end in zip(group, [*cuts.tolist(), len(ids)]):
                self.words[t] = raw[at * width : end * width]
                at = end + 1
        rest = [t for t in texts if "0" in t]
        for t, e in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False) if rest else []):
            self.words[t] = np.array(e.ids, self.dtype).tobytes()

    def _split(self, chunk: bytes) -> tuple[str, str]:
        text = chunk.decode()
        head = text.rstrip(self.TAIL)
        # A letter that its normal form writes as a base and a mark keeps its tail, which the splitter joins with the mark.
        if not head or not head[-1].isalpha() or len(head[-1].lower()) > 1 or "<" in text or not unicodedata.is_normalized("NFC", head[-1]):
            head = text
        tail = text[len(head) :]
        return (head.lower() if head.isascii() and "<" not in head else head), tail

    def ids(self, text: bytes) -> bytes:
        found = text.split()
        out = list(map(self.chunks.get, found))
        if None in out:
            missing = {}
            for c, x in zip(found, out):
                if x is None:
                    if (old := self.old_chunks.get(c)) is not None:
                        self.chunks[c] = old
                    else:
                        missing[c] = self._split(c)
            new = set()
            for w in {w for pair in missing.values() for w in pair if w and w not in self.words}:
                if (old := self.old_words.get(w)) is not None:
                    self.words[w] = old
                else:
                    new.add(w)
            if new:
                self._encode(sorted(new))
            for c, (head, tail) in missing.items():
                self.chunks[c] = self.words[head] + (self.words[tail] if tail else b"")
            out = list(map(self.chunks.__getitem__, found))
            if len(self.chunks) > self.limit:
                self.old_chunks, self.chunks = self.chunks, {}
            if len(self.words) > self.limit:
                self.old_words, self.words = self.words, {}
        return b"".join(out)


@lru_cache(2)
def encoder(path: str, dtype: str) -> WordEncoder:
    return WordEncoder(path, dtype)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


# ---------------------------------------------------------------- writing and reading


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> dict:
    """Encode docs (doc_id, text) and write them to folder, a URL all nodes can reach. Returns the manifest."""
    dtype = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, enc = TaskContext.get().partitionId(), encoder(tokenizer, dtype)
        end, sizes, names = np.array([end_id], dtype).tobytes(), [], []
        width = np.dtype(dtype).itemsize

        def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
            for b in batches:
                names.append(b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                for _, _, data, off in chunks(b.column(1)):
                    raw = data.tobytes()
                    ids = [enc.ids(raw[i:j]) + end for i, j in zip(off.tolist(), off[1:].tolist())]
                    sizes.extend(len(x) // width for x in ids)
                    yield b"".join(ids)

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        write_file(f"{folder}/{k:06d}.bin", blocks(chain([first], batches)))  # one chunk of texts is held at a time
        starts = np.zeros(len(sizes) + 1, "<u8")
        np.cumsum(sizes, out=starts[1:])
        write_file(f"{folder}/{k:06d}.idx", [starts.tobytes()])
        write_file(f"{folder}/{k:06d}.doc", [np.concatenate(names).tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (k, len(sizes), int(starts[-1]))], ["part", "n_docs", "n_tokens"])

    small_batches(docs.sparkSession)
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    size = plain.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = plain.repartitionByRange(-(-size // PART_BYTES), "doc_id") if size > most * PART_BYTES else plain.repartitionByRange("doc_id")
    ranges = dealt.sortWithinPartitions("doc_id", "text")
    parts = sorted(map(tuple, ranges.mapInArrow(part, "part long, n_docs long, n_tokens long").collect()))  # one row for each part
    manifest, base = {"dtype": dtype, "end_id": end_id, "parts": []}, 0
    for k, n_docs, n_tokens in parts:
        manifest["parts"].append({"part": k, "n_docs": n_docs, "n_tokens": n_tokens, "base": base})
        base += n_tokens
    write_file(f"{folder}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def read(spark: SparkSession, folder: str, manifest: dict | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian uint32) of every document, in parallel over parts."""
    if manifest is None:
        manifest = json.loads(read_map(f"{folder}/manifest.json", "u1").tobytes())
    dtype = manifest["dtype"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, base in ((k, x) for b in batches for k, x in zip(b.column("part").to_pylist(), b.column("base").to_pylist())):
            ids, off, names = (read_map(f"{folder}/{k:06d}.{kind}", t) for kind, t in (("bin", dtype), ("idx", "<u8"), ("doc", "<i8")))
            for lo in range(0, len(names), 500):
                hi = min(lo + 500, len(names))
                at = off[lo : hi + 1].astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(names[lo:hi].astype(np.int64), mask=names[lo:hi] == NULL_ID),
                    pa.array(at[:-1] + base), pa.array(np.diff(at)),
                    pa.array([ids[i:j].astype("<u4").tobytes() for i, j in zip(at, at[1:])], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])

    parts = [(p["part"], p["base"]) for p in manifest["parts"]]
    listed = spark.sparkContext.parallelize(parts, max(1, len(parts))).toDF("part long, base long")
    return listed.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    folder = f"{shared_root(spark)}/motorlens/token-files-{uuid.uuid4().hex[:12]}"
    manifest = write(docs, folder, tokenizer or default_tokenizer())
    return read(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
