"""BPE encoding and decoding by a distinct-word table (operator 10).

Texts are split at white space in batches of a task's documents; a batch keeps each document as positions into its own
list of distinct words.  Only those lists are shuffled: dealt and sorted by word they are the distinct-word table, in which
each word of the corpus is one run and is encoded once.  Its ids go back to every batch of the run, and each batch puts
them at the words' positions.  Decoding joins ids with the pieces of the vocabulary (one row an id, a fixed size) and
sets one blank between them, as the tokenizer without a decoder does.

The tokenizer lower-cases, normalises (NFC) and drops white space, so words are encoded apart; special tokens are cut out
of the raw text first.  Defined results: a null or empty text has no tokens; repeated rows each give a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, text_or_empty

#: White space as the tokenizer's patterns have it (Unicode White_Space).
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
BATCH_CHARS = 26_000_000
#: Ids travel as numbers of this type; a vocabulary must fit.
ID = np.uint16
#: Documents whose positions are packed together.
PACK = 256


def normal(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # letter by letter: no final sigma


#: ASCII marks that end a word without being part of it; the apostrophe may start a word's last piece.
MARKS = string.punctuation.replace("'", "")


def pieces_of(word: str) -> tuple[str, ...]:
    """A word and the marks after it: the tokenizer always cuts between a letter or digit and what is neither."""
    core = word.rstrip(MARKS)
    if core and core != word and word[0] != " " and (core[-1].isalpha() or core[-1].isdecimal()):
        return core, word[len(core) :]
    return (word,)


class Splitter:
    """Words of a text.  A special token found in the raw text is a word that starts with a blank, as no other does."""

    def __init__(self, spec: dict):
        self.marks = {t["content"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.marks)) + ")") if self.marks else None

    def words(self, text: str) -> list[str]:
        parts = self.special.split(text) if any(m in text for m in self.marks) else [text]
        out = []
        for p in parts:
            out += [f" {p}"] if p in self.marks else [w for w in SPACE.split(normal(p)) if w]
        return out


class Batch:
    """Documents as codes into the batch's distinct words, the most frequent first.

    A piece of a word is never cut again, so only words of two pieces need an entry of their own besides their pieces'."""

    def __init__(self):
        self.ids, self.docs, self.code, self.cut, self.chars = [], [], {}, {}, 0

    def add(self, doc_id, text: str, words: list[str]) -> None:
        cut, code, out = self.cut, self.code, []
        for w in words:
            one = code.get(w)
            if one is not None:
                out.append(one)
                continue
            codes = cut.get(w)
            if codes is None:
                codes = tuple([code.setdefault(p, len(code)) for p in pieces_of(w)])
                if len(codes) > 1:
                    cut[w] = codes
            out += codes
        self.ids.append(doc_id)
        self.docs.append(np.array(out, np.uint32))
        self.chars += len(text)

    def finish(self, part: int) -> tuple[int, list, list[np.ndarray], list[str]]:
        self.cut.clear()
        order = np.argsort(-np.bincount(np.concatenate(self.docs), minlength=len(self.code)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        names = list(self.code)
        self.code.clear()  # what is handed on should not be held twice
        for k, d in enumerate(self.docs):
            self.docs[k] = rank[d]
        docs, words = self.docs, [names[i] for i in order.tolist()]
        h = xxhash.xxh3_64(repr((part, self.ids)).encode())
        for d in docs:
            h.update(d.tobytes())
            h.update(len(d).to_bytes(4, "little"))
        for w in words:
            h.update(w.encode("utf-8", "surrogatepass") + b" ")
        return h.intdigest() - (1 << 63), self.ids, docs, words


def _batches(stream: Iterator[pa.RecordBatch], splitter: Splitter) -> Iterator[tuple[int, list, list[np.ndarray], list[str]]]:
    """(batch number, doc ids, codes of each document, distinct words), of some BATCH_CHARS characters each.

    Numbers are digests of the partition's number, the batch's doc ids, codes and words.  Two passes over a table give one
    batch the same number only if they see the same rows in the same order; otherwise the batches don't meet, and ``put`` says so.
    """
    part, now = TaskContext.get().partitionId(), Batch()
    for batch in stream:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            now.add(doc_id, text, splitter.words(text))
            if now.chars >= BATCH_CHARS:
                yield now.finish(part)
                now = Batch()
    if now.ids:
        yield now.finish(part)


def _pack(codes: np.ndarray) -> bytes:
    """Little-endian base-128 numbers."""
    if not len(codes):
        return b""
    digits = np.stack([codes >> np.uint32(7 * k) for k in range(5)], axis=1)
    more = np.concatenate([digits[:, 1:] > 0, np.zeros((len(codes), 1), bool)], axis=1)
    keep = np.concatenate([np.ones((len(codes), 1), bool), digits[:, 1:] > 0], axis=1)
    return ((digits & 127) | (more.astype(np.uint32) << 7)).astype(np.uint8)[keep].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def encode_documents(docs: DataFrame, tokenizer_path: str, digests: bool = False) -> DataFrame:
    """One row per document: doc_id, ids, decoded; with digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Digests are taken where a document's ids are put together, so that ids and texts need not leave their task.
    The table is scanned twice and must give the same rows in the same order, as stored tables do; RuntimeError if not.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    if max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]]) > np.iinfo(ID).max:
        raise ValueError("the vocabulary has ids beyond 65535")
    shipped = spark.sparkContext.broadcast(json.dumps(spec))  # the vocabulary file, a fixed size
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def word_lists(stream):
        splitter = Splitter(json.loads(shipped.value))
        for number, _, _, words in _batches(stream, splitter):
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), number)), pa.array(np.arange(a, a + len(part), dtype=np.int32))], names=["word", "batch", "code"])

    def positions(stream):
        splitter, packer = Splitter(json.loads(shipped.value)), zstandard.ZstdCompressor(level=1)
        for number, ids, codes, _ in _batches(stream, splitter):
            for a in range(0, len(ids), PACK):
                part = codes[a : a + PACK]
                packed = packer.compress(_pack(np.concatenate(part)))
                row = [[number], [pa.array(ids[a : a + PACK], pa.int64())], [np.array([len(c) for c in part], np.int32)], [packed]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.list_(pa.int64())), pa.array(row[2], pa.list_(pa.int32())), pa.array(row[3], pa.binary())], names=["batch", "doc_ids", "counts", "codes"])

    def encode(stream):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        spec = json.loads(shipped.value)
        marks = {" " + t["content"]: t["id"] for t in spec["added_tokens"]}
        bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "truncation": None, "padding": None}))
        bare.encode_special_tokens = True
        last, last_ids = None, []
        for batch in stream:
            runs = pc.run_end_encode(batch.column("word"))
            words, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            fresh = [w for w in words if w != last]
            ids = [[marks[w]] if w in marks else e.ids for w, e in zip(fresh, bare.encode_batch(fresh, add_special_tokens=False))]
            ids = [last_ids] * (len(words) - len(fresh)) + ids  # a run may go on from the batch before
            last, last_ids = words[-1], ids[-1]
            times = np.diff(ends, prepend=0)
            flat = np.concatenate([np.array(i * t, ID) for i, t in zip(ids, times.tolist())])
            sizes = np.repeat([len(i) for i in ids], times) * ID().itemsize
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("batch"), batch.column("code"), packed], names=["batch", "code", "ids"])

    lists = rows.mapInArrow(word_lists, "word string, batch long, code int")
    table = lists.repartition(n_partitions(spark), "word").sortWithinPartitions("word")
    found = table.mapInArrow(encode, "batch long, code int, ids binary")
    placed = rows.mapInArrow(positions, "batch long, doc_ids array<bigint>, counts array<int>, codes binary")

    columns = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]

    def put(placed: pa.Table, found: pa.Table) -> pa.Table:
        if found.num_rows and not placed.num_rows:
            raise RuntimeError("rows came in another order in the second scan: store the table first")
        numbers, pieces = _vocabulary(shipped.value)
        found = found.combine_chunks()
        lists = pa.concat_arrays(found.column("ids").chunks) if found.num_rows else pa.array([], pa.binary())
        offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int32)
        flat = np.frombuffer(lists.buffers()[2], np.uint8)[: offsets[-1]].view(ID) if offsets[-1] else np.empty(0, ID)
        starts, size = offsets[:-1] // ID().itemsize, np.diff(offsets) // ID().itemsize
        row = np.empty(len(lists), np.int64)
        row[found.column("code").to_numpy()] = np.arange(len(lists))  # codes of a batch are 0..n-1
        packer, doc_ids, outputs = zstandard.ZstdDecompressor(), [], [[] for _ in columns]
        for pack in range(placed.num_rows):
            codes = _unpack(packer.decompress(placed.column("codes")[pack].as_py()))
            if len(codes) and codes.max() >= len(lists):
                raise RuntimeError("rows came in another order in the second scan: store the table first")
            doc_ids += placed.column("doc_ids")[pack].as_py()
            for mine in np.split(codes, np.cumsum(placed.column("counts")[pack].as_py())[:-1]):
                rows = row[mine]
                n = size[rows]
                # ids in the order of the words, then an id's row meets its piece's row
                ids = flat[np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                text = " ".join(pieces[ids].tolist())
                row_out = (len(ids), hashlib.sha256(" ".join(numbers[ids].tolist()).encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()) if digests else (ids.astype(np.int32), text)
                for column, value in zip(outputs, row_out, strict=True):
                    column.append(value)
        made = [pa.array(v, t) for v, (_, t) in zip(outputs, columns, strict=True)]
        return pa.table([pa.array(doc_ids, pa.int64()), *made], names=["doc_id", *[name for name, _ in columns]])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return placed.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(put, schema)


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded(row, ids array<int>) -> (row, decoded): ids joined with the pieces of the vocabulary, one blank between them.

    row must be unique.  Null or no ids give an empty text; an id beyond the vocabulary gives nothing.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        _, pieces = _vocabulary(f.read())
    table = F.broadcast(encoded.sparkSession.createDataFrame(list(enumerate(pieces.tolist())), "id int, piece string"))  # a row an id
    spread = encoded.select("row", F.posexplode("ids").alias("at", "id")).join(table, "id")
    joined = spread.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    texts = joined.select("row", F.array_join("pieces.piece", " ").alias("decoded"))
    return encoded.select("row").join(texts, "row", "left").withColumn("decoded", F.coalesce("decoded", F.lit("")))


@lru_cache(1)
def _vocabulary(spec: str) -> tuple[np.ndarray, np.ndarray]:
    """Every id as a number and as its piece."""
    spec = json.loads(spec)
    rows = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    pieces = np.full(max(rows) + 1, "", object)
    pieces[list(rows)] = list(rows.values())
    return np.array([str(i) for i in range(len(pieces))], object), pieces
