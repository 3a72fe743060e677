"""Byte-level BPE over a corpus: a global shuffle of distinct words.

Texts are cut into pre-tokens with their positions.  A task keeps a block of texts as positions that
name the block's distinct words, and sends each word once to the bucket of its hash.  A bucket sees the
words of all blocks, merges every distinct one of them once, and its ids go back to the blocks that asked,
where they are put in place by position.  What moves is packed: (block, bucket) rows of words and
ids.  The positions of a block are one row of a table bucketed by block, and don't move.  A word's share of a bucket is one entry for each block, so
a frequent word is no hot key.  Decoding joins ids with the table of the tokens' bytes; that table is the
rank file, whose size is checked before each task gets a copy.

Ids are those of the rank file, without special tokens.  Defined cases: a null text counts as empty and
an empty text has no ids; every row is encoded on its own, also where a key repeats or is null; only the key and
the text are read, so further columns don't matter; a text longer than a block is a block; bytes that
are not UTF-8 become U+FFFD; an empty table gives no rows.  Of equal ranks in a word the leftmost merges first."""

from __future__ import annotations

import base64
import heapq
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep.llm.common import release, stored_by, word_hashes
from textprep.session import shuffle_partitions

# Fixed value: the pattern that cuts a text into the pieces which are encoded one by one.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Runs of letters and digits that the regex package knows, but not Unicode 16.0, by which the rank files' own library cuts.
LATER = (
    "\\u0558 \\u058b-\\u058c \\u088f \\u0c5c \\u0cdc \\u208f \\u209d-\\u209f \\ua7ce-\\ua7cf \\ua7d2 \\ua7d4 \\ua7dd \\ua7e2 \\ua7f1 \\uab6c-\\uab6d "
    "\\U000107bb-\\U000107bf \\U00010940-\\U00010959 \\U00010ec5-\\U00010ec7 \\U00010ed9-\\U00010eee \\U00011b0a \\U00011db0-\\U00011ddb "
    "\\U00011de0-\\U00011de9 \\U00011df1 \\U0001246f \\U00012475-\\U0001247f \\U00012550-\\U00012686 \\U00016ea0-\\U00016eb8 "
    "\\U00016ebb-\\U00016ed3 \\U00016ff2-\\U00016ff6 \\U000187f8-\\U000187ff \\U00018cd6-\\U00018cda \\U00018d09-\\U00018d20 "
    "\\U00018d80-\\U00018df2 \\U00018e00-\\U00019191 \\U000191a0-\\U000191d2 \\U0001b123-\\U0001b128 \\U0001b168 \\U0001d6a6 "
    "\\U0001df1f-\\U0001df24 \\U0001df2b-\\U0001df81 \\U0001df90-\\U0001df96 \\U0001dfcd-\\U0001dfff \\U0001e6c0-\\U0001e6de "
    "\\U0001e6e0-\\U0001e6e2 \\U0001e6e4-\\U0001e6e5 \\U0001e6e7-\\U0001e6ed \\U0001e6f0-\\U0001e6f4 \\U0001e6fe-\\U0001e6ff "
    "\\U0002b73a-\\U0002b73f \\U0002b81e \\U0002cea2-\\U0002cead \\U000323b0-\\U00033479 \\U0003d000-\\U0003fc3f"
).replace(" ", "")

BLOCK_BYTES = 16 << 20  # of the texts of a block (one text at least)
BUCKET_BYTES = 64 << 20  # of the texts for each bucket of words
CHUNK_WORDS = 200_000  # words that are Python strings at the same time
RANK_FILE_BYTES = 64 << 20  # of a rank file that every task may hold a copy of


_HIGH = re.compile("[\u0558-\U0010FFFF]")  # from the first of them on
_LATER = regex.compile(f"[{LATER}]")
_PLAIN = regex.compile(PATTERN)
_EXACT = regex.compile(
    PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]{LATER}]").replace(r"?\p{L}+", rf"?[\p{{L}}--[{LATER}]]+").replace(r"?\p{N}+", rf"?[\p{{N}}--[{LATER}]]+"),
    regex.V1,
)


def split(text: str) -> list[str]:
    """Pre-tokens of a text."""
    later = not text.isascii() and _HIGH.search(text) and _LATER.search(text)
    return (_EXACT if later else _PLAIN).findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from lines of base64 and id.  All 256 single bytes must be among them."""
    if os.path.getsize(path) > RANK_FILE_BYTES:
        raise ValueError(f"{path} is larger than {RANK_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} lacks single bytes")
    return ranks


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: of neighbouring parts those whose join has the least rank become one, until none has any.
    Parts are a linked list and their joins a heap, so long words cost n log n."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n))  # where a part ends, where its left neighbour starts
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = after[i]
        if mid < 0 or mid >= n or after[mid] != end:
            continue  # one of the two parts has changed since
        after[i], after[mid] = end, -1
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        left = before[i]
        if left >= 0 and (r := ranks.get(word[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


# --- packing --------------------------------------------------------------------------------------

def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, integers byte plane by byte plane (high planes are mostly zero)."""
    import pyarrow as pa

    parts = []
    for a in arrays:
        wide = next(t for t in (np.uint8, np.uint16, np.uint32) if not len(a) or a.max() <= np.iinfo(t).max)
        planes = np.ascontiguousarray(a, wide).view(np.uint8).reshape(len(a), np.dtype(wide).itemsize).T
        raw = planes.tobytes()
        parts += [np.array([len(a), np.dtype(wide).itemsize], np.int64).tobytes(), raw]
    raw = b"".join(parts)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unzip(value: bytes) -> Iterator[np.ndarray]:
    import pyarrow as pa

    raw, at = pa.decompress(value[8:], int(np.frombuffer(value, np.int64, 1)[0]), "zstd", asbytes=True), 0
    while at < len(raw):
        n, size = map(int, np.frombuffer(raw, np.int64, 2, at))
        planes = np.frombuffer(raw, np.uint8, n * size, at + 16).reshape(size, n)
        yield np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{size}")
        at += 16 + n * size


def _starts(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def _ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices ``flat[start : start + len]`` one behind the other."""
    to = _starts(lens)
    return flat[np.repeat(starts - to[:-1], lens) + np.arange(to[-1])]


# --- encoding -------------------------------------------------------------------------------------

def _word_arrays(words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow array of strings."""
    import pyarrow as pa

    words = words.cast(pa.large_binary())
    _, offs, data = words.buffers()
    at = np.frombuffer(offs, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _blocks(buckets: int, block_bytes: int, key_type: T.DataType, schema: T.StructType):
    """Rows of a block: its positions (``seq``; the words numbered from the most frequent), and for every bucket
    that it has words of, those words."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

        arrow, kind = to_arrow_schema(schema), to_arrow_type(key_type)
        block = itertools.count(TaskContext.get().partitionId() << 32)
        keys, lens, chunks, words, size = [], [], [], [], 0

        def encode_chunk():
            if words:
                found = pa.array(words, pa.large_string()).dictionary_encode()
                chunks.append((found.indices.to_numpy(), found.dictionary))
                words.clear()

        def flush():
            encode_chunk()
            number = next(block)
            columns = {f.name: [] for f in schema.fields}

            def add(**row):
                for name in columns:
                    columns[name].append(row.get(name))

            seq, bucket_of = np.zeros(0, np.int32), np.zeros(0, np.int64)
            if chunks:
                # one numbering for the block's words
                all_words = pa.concat_arrays([w for _, w in chunks]).dictionary_encode()
                to, at = all_words.indices.to_numpy(), _starts(np.array([len(w) for _, w in chunks]))
                seq = np.concatenate([to[at[i] : at[i + 1]][codes] for i, (codes, _) in enumerate(chunks)])
                chunks.clear()
                order = np.argsort(-np.bincount(seq, minlength=len(all_words.dictionary)), kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order))
                seq = rank[seq]
                data, offs = _word_arrays(all_words.dictionary)
                data, offs = _ragged(data, offs[:-1][order], np.diff(offs)[order]), _starts(np.diff(offs)[order])
                bucket_of = (word_hashes(data, offs[:-1], offs[1:]) % np.uint64(buckets)).astype(np.int64)
                place = np.argsort(bucket_of, kind="stable")
                used, first = np.unique(bucket_of[place], return_index=True)
                for b, mine in zip(used, np.split(place, first[1:])):
                    n = np.diff(offs)[mine]
                    add(block=number, bucket=int(b), words=_zip(n, _ragged(data, offs[:-1][mine], n)))
            add(block=number, keys=keys.copy(), seq=_zip(np.array(lens, np.int64), bucket_of, seq))
            keys.clear(), lens.clear(), chunks.clear()
            arrays = [pa.array(columns[f.name], f.type) for f in arrow]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            for key, text in zip(batch.column(0).cast(kind).to_pylist(), batch.column(1).cast(pa.large_binary())):
                text = text.as_py() or b""
                if size and size + len(text) > block_bytes:
                    yield flush()
                    size = 0
                found = split(text.decode("utf-8", "replace"))
                keys.append(key)
                lens.append(len(found))
                words.extend(found)
                size += len(text)
                if len(words) >= CHUNK_WORDS:
                    encode_chunk()
        if keys:
            yield flush()
        release()

    return run


def _merged(ranks_of):
    """Of a bucket: every distinct word merged once, and the ids of each block's words in their order."""

    def run(rows):
        import pyarrow as pa

        ranks, seen = ranks_of(), {}
        blocks, values = rows.column("block"), []
        for value in rows.column("words"):
            lens, data = _unzip(value.as_py())
            raw, at = data.tobytes(), _starts(lens)
            ids = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                word = raw[a:b]
                if (found := seen.get(word)) is None:
                    found = seen[word] = merge(word, ranks)
                ids.append(found)
            values.append(_zip(np.array([len(x) for x in ids], np.int64), np.array(list(itertools.chain.from_iterable(ids)), np.int64)))
        return pa.table({"block": blocks, "bucket": rows.column("bucket"), "ids": pa.array(values, pa.binary())})

    return run


def _placed(key_type: T.DataType):
    """Of a block: the ids of its words put where the words stood."""

    def run(blocks, answers):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        answers = answers.sort_by("bucket")
        lens, ids = [], []
        for value in answers.column("ids"):
            n, flat = _unzip(value.as_py())
            lens.append(n.astype(np.int64))
            ids.append(flat.astype(np.int32))
        lens, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lens, ids))
        keys, offsets, out = [], [np.zeros(1, np.int64)], []
        for row in blocks.to_pylist():
            n_words, bucket_of, seq = _unzip(row["seq"])
            place = np.argsort(bucket_of, kind="stable")  # the order in which the answers came
            size, start = np.zeros((2, len(place)), np.int64)
            size[place], start[place] = lens, _starts(lens)[:-1]
            ends = _starts(n_words)
            for a in range(0, len(n_words), 256):
                b = min(a + 256, len(n_words))
                mine = seq[ends[a] : ends[b]]
                out.append(_ragged(ids, start[mine], size[mine]).astype(np.int32))
                last = offsets[-1][-1]
                offsets.append(last + _starts(size[mine])[ends[a + 1 : b + 1] - ends[a]])
            keys += row["keys"]
        flat = np.concatenate(out) if out else np.zeros(0, np.int32)
        del out, answers, blocks
        release()
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), pa.array(flat))
        return pa.table({"key": pa.array(keys, to_arrow_type(key_type)), "ids": lists})

    return run


def encode(docs: DataFrame, rank_file: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(key, ids)`` of every row: the ids of its whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(rank_file))
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    key_type = docs.schema["key"].dataType
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total // BUCKET_BYTES))

    schema = T.StructType().add("block", "long").add("bucket", "integer").add("words", "binary").add("keys", T.ArrayType(key_type)).add("seq", "binary")
    blocks = stored_by(docs.mapInArrow(_blocks(buckets, block_bytes, key_type, schema), schema), "bpe_blocks", buckets, "block")
    answers = (
        blocks.where("bucket is not null")
        .select("block", "bucket", "words")
        .repartition(buckets, "bucket")
        .groupBy("bucket")
        .applyInArrow(_merged(lambda: shared.value), "block long, bucket int, ids binary")
    )
    asked = blocks.where("bucket is null").select("block", "keys", "seq")
    found = asked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _placed(key_type), T.StructType().add("key", key_type).add("ids", T.ArrayType(T.IntegerType()))
    )
    return found.withColumnRenamed("key", key)


# --- decoding -------------------------------------------------------------------------------------

def decode(encoded: DataFrame, rank_file: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of the ids one behind the other, and ``packed``, the ids as little-endian unsigned 32-bit
    integers (both empty for a null list).  An id that the table lacks is an error."""
    ranks = read_ranks(rank_file)
    tokens = [b""] * (max(ranks.values()) + 1)
    known = np.zeros(len(tokens), bool)
    for token, rank in ranks.items():
        tokens[rank], known[rank] = token, True
    shared = encoded.sparkSession.sparkContext.broadcast((b"".join(tokens), np.array([len(t) for t in tokens], np.int64), known))
    at = encoded.columns.index(ids)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType()), T.StructField("packed", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        data, size, known = shared.value
        data, start = np.frombuffer(data, np.uint8), _starts(size)[:-1]
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows = batch.column(at)
                rows = rows.fill_null([]) if rows.null_count else rows
                flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(known) or not known[flat].all()):
                    raise ValueError("an id that the token table lacks")
                ends = _starts(rows.value_lengths().to_numpy(zero_copy_only=False))
                columns = []
                for raw, offs in ((_ragged(data, start[flat], size[flat]).tobytes(), _starts(size[flat])[ends]), (flat.astype("<u4").tobytes(), 4 * ends)):
                    columns.append(pa.array([raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "decoded", "packed"])
        release()

    return encoded.mapInArrow(run, schema)
