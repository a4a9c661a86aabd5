"""Token ids in a canonical, length-limited Huffman code with random access.

File format: a folder with three Parquet tables.

* ``codes`` (id, bits): code length of every id that occurs.  The code is
  canonical -- ids in order of (bits, id) take consecutive code words -- so
  lengths are all a reader needs.
* ``shards`` (shard, first): number of the first token of each shard.  Shards
  are ranges of ``doc_id`` in ascending order.
* ``blocks`` (shard, block, first, doc_ids, n_tokens, payload, checkpoints): an
  independent block of whole documents in ascending order; ``first`` counts the
  shard's tokens before it.  Every document starts on a byte; ``checkpoints``
  (little-endian unsigned 64-bit) is the bit offset of every document and of
  each ``EVERY``-th token inside it, so decoding starts anywhere and many lanes
  run at once through one lookup table.

Writing.  A text's ids are those of its pieces between white space, one after
another (the file's pipeline drops white space before merging; a full stop or
comma after a letter is a piece of its own to it as well).  Tasks collect their
distinct pieces with counts, Spark shuffles them by hash, and each is encoded
once by the library.  That gives the global counts of the ids -- one row per id
and bucket -- from which the driver makes the code, whose size is the
vocabulary's; and a dictionary of sorted arrays in the shared folder, which
workers memory-map to code whole texts.  Pieces are told apart by 96 bits: a
hash of 64 that the dictionary is sorted by, and 32 of their size and their
first and last 8 bytes.  The coded documents are shuffled into
ascending ``doc_id`` order.  Pieces of over ``LONGEST`` bytes stay out of the
dictionary and are encoded where they stand.

Defined results: a null text has just the end id; a null ``doc_id`` sorts
first; repeated rows follow one another; an empty table gives empty tables;
extra columns are ignored; a document of any length is one block at least.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import encoding
from labelscope.llm import text_kernel as tk
from labelscope.llm.scratch import Buckets, parked, save, scratch_path, shared_file_path

EVERY = 128
LIMIT = 18
LONGEST = 256
HELD = 1_500_000  # pieces that a task holds before it passes them on
SLAB = 1 << 21


def encode_pieces(path: str, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in a row, number of ids of each) by the library."""
    tokenizer, ids, sizes = encoding.load(path), [], []
    for s in range(0, len(pieces), 4096):
        got = tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces[s:s + 4096]], add_special_tokens=False)
        each = [e.ids for e in got]
        sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        ids.append(np.fromiter(chain.from_iterable(each), np.uint32, int(sizes[-1].sum())))
    return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), (np.concatenate(sizes) if sizes else np.zeros(0, np.int64))


def merge_pieces(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, check, count, size, bytes) of the distinct pieces, by hash, from parts of the same form."""
    h, check, n, size, data = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h)
    alike = h[order][1:] == h[order][:-1]
    if (alike & (check[order][1:] != check[order][:-1])).any():  # pieces that share a hash: put equal ones together
        order = np.lexsort((check, h))
        alike = (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])
    first = np.flatnonzero(np.concatenate([[True], ~alike])) if len(h) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], first) if len(h) else n
    one = order[first]
    begin = np.cumsum(size) - size
    return h[one], check[one], total, size[one], data[tk.ragged(begin[one], size[one])]


def bucket_runs(h: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of the buckets that occur in ascending hashes."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else np.zeros(0, np.int64)
    return list(zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(h)]))


def distinct_pieces(docs: DataFrame, path: str, bits: int, end_id: int) -> DataFrame:
    """(bucket, run, ids, n): runs of distinct pieces by hash bucket; counts of ids known at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, n_docs, known = [], 0, 0, []

        def flush() -> pa.RecordBatch:
            h, check, n, size, data = merge_pieces(held)
            at = np.concatenate([[0], np.cumsum(size)])
            rows = [(b, np.int64(e - s).tobytes() + h[s:e].tobytes() + n[s:e].tobytes() + check[s:e].tobytes()
                     + size[s:e].astype(np.uint16).tobytes() + data[at[s]:at[e]].tobytes()) for b, s, e in bucket_runs(h, bits)]
            k = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64()))], ["bucket", "run", "ids", "n"])

        for batch in batches:
            n_docs += batch.num_rows
            for _, data, starts in tk.text_slabs(batch["text"], SLAB):
                if not len(data):
                    continue
                first, last = tk.word_spans(data, starts, split_stops=True)
                long = np.flatnonzero(last - first >= LONGEST)
                if len(long):
                    known.append(encode_pieces(path, [data[first[i]:last[i] + 1].tobytes() for i in long])[0])
                h, check, at, back = tk.distinct_spans(data, first, last)
                n, size = np.bincount(back, minlength=len(h)), (last - first + 1)[at]
                ok = size <= LONGEST
                h, check, at, n, size = h[ok], check[ok], at[ok], n[ok], size[ok]
                held.append((h, check, n, size, data[tk.ragged(first[at], size)]))
                n_held += len(h)
                if n_held > HELD:
                    yield flush()
                    held, n_held = [], 0
        if held:
            yield flush()
        ids, n = np.unique(np.concatenate(known), return_counts=True) if known else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([[end_id, *ids.tolist()]], pa.list_(pa.int64())),
             pa.array([[n_docs, *n.tolist()]], pa.list_(pa.int64()))], ["bucket", "run", "ids", "n"])
    return docs.select("text").mapInArrow(run, "bucket int, run binary, ids array<long>, n array<long>")


def read_pieces(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = int(np.frombuffer(run, np.int64, 1)[0])
    return (np.frombuffer(run, np.uint64, k, 8), np.frombuffer(run, np.uint32, k, 8 + 16 * k), np.frombuffer(run, np.int64, k, 8 + 8 * k),
            np.frombuffer(run, np.uint16, k, 8 + 20 * k).astype(np.int64), np.frombuffer(run, np.uint8, -1, 8 + 22 * k))


def dictionary(pieces: DataFrame, path: str, files: str) -> DataFrame:
    """Encode each bucket's pieces, write its arrays, and return (id, n) over all texts."""
    def group(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket < 0:
            return table.select(["ids", "n"])
        h, check, n, size, data = merge_pieces([read_pieces(x) for x in table["run"].to_pylist()])
        at = np.concatenate([[0], np.cumsum(size)])
        raw = data.tobytes()
        ids, sizes = encode_pieces(path, [raw[a:b] for a, b in zip(at, at[1:])])
        base = f"{files}/pieces-{bucket:05d}"
        save(f"{base}.start", np.concatenate([[0], np.cumsum(sizes)])), save(f"{base}.ids", ids), save(f"{base}.check", check), save(f"{base}.hash", h)
        count = np.bincount(ids, weights=np.repeat(n, sizes)).astype(np.int64)
        seen = np.flatnonzero(count)
        return pa.table([pa.array([seen.tolist()], pa.list_(pa.int64())), pa.array([count[seen].tolist()], pa.list_(pa.int64()))],
                        names=["ids", "n"])
    counted = parked(pieces.groupBy("bucket").applyInArrow(group, "ids array<long>, n array<long>"), "counts")
    return counted.select(F.explode(F.arrays_zip("ids", "n")).alias("x")).groupBy(F.col("x.ids").alias("id")).agg(F.sum("x.n").alias("n"))


class Dictionary:
    """The memory-mapped pieces; turns slabs of text into ids."""

    def __init__(self, files: str, bits: int, path: str, end_id: int):
        self.path, self.end_id, self.bits = path, end_id, bits
        self.buckets = Buckets(files, "pieces", ("start", "ids", "check", "hash"))

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents with their end ids, number of each)."""
        n_docs = len(starts) - 1
        if not len(data):
            return np.full(n_docs, self.end_id, np.int64), np.ones(n_docs, np.int64)
        first, last = tk.word_spans(data, starts, split_stops=True)
        h, check, one, back = tk.distinct_spans(data, first, last)
        size = np.full(len(h), -1, np.int64)
        flat, begin, total = [], np.zeros(len(h), np.int64), 0
        for bucket, a, b in bucket_runs(h, self.bits):
            part = self.buckets.part(bucket)
            if part is None:
                continue
            starts_of, ids_of, checks, hashes = part
            at = np.minimum(np.searchsorted(hashes, h[a:b]), len(hashes) - 1)
            hit = np.flatnonzero((hashes[at] == h[a:b]) & (checks[at] == check[a:b]))
            at = at[hit]
            start, stop = starts_of[at], starts_of[at + 1]
            size[a + hit] = stop - start
            begin[a + hit] = total + np.cumsum(stop - start) - (stop - start)
            flat.append(ids_of[tk.ragged(start, stop - start)])
            total += len(flat[-1])
        for i in np.flatnonzero(size < 0):  # too long, or not the first of those that share a hash
            ids, _ = encode_pieces(self.path, [data[first[one[i]]:last[one[i]] + 1].tobytes()])
            size[i], begin[i] = len(ids), total
            flat.append(ids)
            total += len(ids)
        flat = np.concatenate([*flat, [self.end_id]]).astype(np.int64)
        ends = np.searchsorted(first, starts[1:])  # a document's end id follows its last piece
        begin, size = np.insert(begin[back], ends, total), np.insert(size[back], ends, 1)
        upto = np.cumsum(size)[ends + np.arange(n_docs)]
        return flat[tk.ragged(begin, size)], np.diff(upto, prepend=0)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal prefix code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    packages, is_leaf = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        is_leaf.append(place < n)
        both = both[place]
        packages = both[:len(both) // 2 * 2].reshape(-1, 2).sum(1)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        bits[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Code words of ids with the given lengths."""
    order = np.lexsort((ids, bits))
    step = (1 << (bits.max(initial=0) - bits[order])).astype(np.uint64)
    codes = np.empty(len(ids), np.uint64)
    codes[order] = (np.cumsum(step) - step) >> (bits.max(initial=0) - bits[order]).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, byte offset of each document with the end, bit offset of each
    token from its document's start) of documents with ``sizes`` tokens."""
    length = bits[ids]
    before = np.cumsum(length) - length
    stop = np.cumsum(sizes)
    total = np.concatenate([[0], np.append(before, length.sum())[stop]])
    begin = np.concatenate([[0], np.cumsum((np.diff(total) + 7) // 8)])
    offset = before - np.repeat(total[:-1], sizes)
    at = offset + np.repeat(begin[:-1] * 8, sizes)
    words = np.zeros((int(begin[-1]) + 7) // 8 + 1, np.uint64)
    if len(ids):
        code, word = codes[ids], at >> 6
        room = 64 - (at & 63) - length
        over = room < 0
        part = np.where(over, code >> np.maximum(-room, 0).astype(np.uint64), code << np.maximum(room, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] += np.add.reduceat(part, first)
        over = np.flatnonzero(over)
        words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)[:begin[-1]], begin, offset


def code_documents(docs: DataFrame, path: str, files: str, dict_bits: int, end_id: int, ids: np.ndarray, bits: np.ndarray,
                   borders: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, payload, checkpoints, shard): every document in the code."""
    size = int(ids.max(initial=end_id)) + 1
    names = ["doc_id", "n_tokens", "payload", "checkpoints", "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, code = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        length[ids], code[ids] = bits, canonical(ids, bits)
        pieces = Dictionary(files, dict_bits, path, end_id)
        for batch in batches:
            for row, text, starts in tk.text_slabs(batch["text"], SLAB):
                x, n = pieces.ids(text, starts)
                data, begin, offset = pack(x, n, code, length)
                stop = np.cumsum(n)
                doc = batch["doc_id"].slice(row, len(n)).cast(pa.int64())
                shard = np.searchsorted(borders, pc.fill_null(doc, -(1 << 63)).to_numpy(zero_copy_only=False), "right")
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(n, pa.int64()), pa.array([data[s:e].tobytes() for s, e in zip(begin, begin[1:])], pa.binary()),
                     pa.array([offset[s:e:EVERY].astype(np.uint64).tobytes() for s, e in zip(stop - n, stop)], pa.binary()),
                     pa.array(shard, pa.int32())], names)
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, payload binary, checkpoints binary, shard int")


def assemble(coded: DataFrame, shards: int, block_tokens: int) -> DataFrame:
    """Documents with a ``shard``, in order -> blocks."""
    schema = "shard int, block long, first long, doc_ids array<long>, n_tokens array<long>, payload binary, checkpoints binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, held, tokens = None, 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            size = np.cumsum([0] + [len(x["payload"]) for x in held])
            marks = [np.frombuffer(x["checkpoints"], np.uint64) + np.uint64(8 * s) for x, s in zip(held, size)]
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()),
                 pa.array([[x["doc_id"] for x in held]], pa.list_(pa.int64())),
                 pa.array([[x["n_tokens"] for x in held]], pa.list_(pa.int64())),
                 pa.array([b"".join(x["payload"] for x in held)], pa.binary()),
                 pa.array([np.concatenate(marks).tobytes()], pa.binary())],
                ["shard", "block", "first", "doc_ids", "n_tokens", "payload", "checkpoints"])

        for batch in batches:
            for x in batch.to_pylist():
                if held and (x["shard"] != shard or tokens >= block_tokens):
                    yield flush()
                    block, first, held, tokens = block + 1, first + tokens, [], 0
                if x["shard"] != shard:
                    shard, block, first = x["shard"], 0, 0
                held.append(x)
                tokens += x["n_tokens"]
        if held:
            yield flush()

    ordered = coded.repartition(shards, "shard").sortWithinPartitions(
        "shard", F.col("doc_id").asc_nulls_first(), "n_tokens", F.crc32("payload"))
    return ordered.mapInArrow(run, schema)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_tokens: int = 1 << 16,
                 shard_tokens: int = 1 << 22, bucket_bytes: int = 16 << 20) -> None:
    """Encode ``docs`` (doc_id, text) into the folder ``path``: shards of
    ``shard_tokens`` or, with n tokens, n^(2/3) (the driver holds a number for
    each; two for each task at least) and a dictionary bucket for each
    ``bucket_bytes`` of text, at any size."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dict_bits = max(3, (chars // bucket_bytes).bit_length())
    files = shared_file_path(scratch_path(spark, "pieces"))
    os.makedirs(files, exist_ok=True)
    counts = dictionary(distinct_pieces(docs, tokenizer, dict_bits, end_id), tokenizer, files).orderBy("id").collect()  # a row per id
    ids, n = np.array([r["id"] for r in counts if r["n"]], np.int64), np.array([r["n"] for r in counts if r["n"]], np.int64)
    bits = code_lengths(n, max(LIMIT, int(len(n)).bit_length() + 1))
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, bits)], "id long, bits int").coalesce(1) \
        .write.parquet(f"{path}/codes")
    shards = int(max(1, n.sum() // max(shard_tokens, float(n.sum()) ** (2 / 3)), spark.sparkContext.defaultParallelism * 2))
    # range borders of doc_id; a border only moves documents between neighbouring shards
    borders = docs.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)] or [0.5], 10 * shards).alias("b")).first()["b"]
    borders = np.unique(np.array(borders or [], np.int64))
    coded = code_documents(docs, tokenizer, files, dict_bits, end_id, ids, bits, borders)
    assemble(coded, shards, block_tokens).write.option("compression", "none").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("t")) \
        .groupBy("shard").agg(F.sum("t").alias("t")).orderBy("shard").collect()  # a row per shard
    first = np.cumsum([0] + [r["t"] for r in totals])
    spark.createDataFrame([(r["shard"], int(f)) for r, f in zip(totals, first)], "shard int, first long").coalesce(1) \
        .write.parquet(f"{path}/shards")


def decoder(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Lookup tables (id, code length) by the next ``width`` bits."""
    width = int(bits.max(initial=1))
    order = np.lexsort((ids, bits))
    copies = 1 << (width - bits[order])
    symbol, length = np.zeros(1 << width, np.int64), np.ones(1 << width, np.int64)
    symbol[:copies.sum()] = np.repeat(ids[order], copies)
    length[:copies.sum()] = np.repeat(bits[order], copies)
    return symbol, length, width


def decode(payload: bytes, marks: np.ndarray, sizes: np.ndarray, table) -> np.ndarray:
    """All ids of a block: every checkpoint is a lane, all lanes step together."""
    symbol, length, width = table
    b = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
    lanes = -(-sizes // EVERY)
    last = np.cumsum(lanes)
    left = np.full(int(last[-1]) if len(last) else 0, EVERY, np.int64)
    left[last - 1] = sizes - (lanes - 1) * EVERY
    to = np.cumsum(left) - left
    order = np.argsort(-left, kind="stable")
    at, to, left = marks[order].astype(np.int64), to[order], left[order]
    out = np.empty(int(sizes.sum()), np.uint32)
    active = np.searchsorted(-left, -np.arange(1, EVERY + 1), "right")
    for step in range(EVERY):
        k = active[step]
        if not k:
            break
        p = at[:k]
        word = (window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[to[:k] + step] = symbol[word]
        at[:k] += length[word]
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a folder; ids as little-endian unsigned 32-bit bytes."""
    codes = spark.read.parquet(f"{path}/codes").orderBy("id").collect()
    ids, bits = np.array([r["id"] for r in codes], np.int64), np.array([r["bits"] for r in codes], np.int64)
    shards = {r["shard"]: r["first"] for r in spark.read.parquet(f"{path}/shards").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder(ids, bits)
        for batch in batches:
            for x in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # a block at a time
                sizes = np.array(x["n_tokens"], np.int64)
                got = decode(x["payload"], np.frombuffer(x["checkpoints"], np.uint64), sizes, table)
                stop = np.cumsum(sizes)
                start = shards[x["shard"]] + x["first"] + stop - sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["doc_ids"], pa.int64()), pa.array(start), pa.array(sizes),
                     pa.array([got[a:b].tobytes() for a, b in zip(stop - sizes, stop)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])
    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32)."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, **params) -> DataFrame:
    """Write ``docs`` and read the files back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, **params)
    return digest(read_tokens(docs.sparkSession, path))
