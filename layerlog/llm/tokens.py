"""Encoding a whole corpus with a public byte-level BPE tokenizer.

Texts are split into pre-tokens once.  Within a block of documents a pre-token is a number, its place in the block's word list; a document is the
sequence of its numbers, which are the positions.  The distinct words of all blocks are shuffled by word, in `BUCKETS` buckets: each distinct word is
encoded once where the buckets of all blocks meet, the ids are joined back to their block, and there put in the places of their pre-tokens.  What moves is
one row for each block and bucket, with words and ids as packed bytes, and one row for the documents of a block.  So no row or key grows with the number
of uses of a word.  A word is one entry of a bucket for each block it occurs in; beyond `GROUP` scan tasks, buckets are salted by group of tasks (a
word is then encoded once a group), so that no bucket grows with the corpus.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"  #: where the public vocabularies lie; spark.layerlog.tokenizers names another place
FILE = "byte_bpe_50k.tiktoken"
VOCABULARY = f"{FOLDER}/{FILE}"
#: the public pattern that splits text before the merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 4_000_000  #: texts of one block
PART_CHARS = 1_000_000  #: longer texts are cut into parts of about so many characters, at ends of pre-tokens
BUCKETS, GROUP = 64, 256
CACHE = 400_000  #: distinct words of a bucket held at once


def vocabulary_path(spark) -> str:
    return f"{spark.conf.get('spark.layerlog.tokenizers', FOLDER)}/{FILE}"


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The rank file; of fixed size, less than 1 MB, shipped to the executors with the plan."""
    return Path(path).read_bytes()


def parse_vocabulary(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


@lru_cache(maxsize=4)
def encoder(raw: bytes):
    """Text to ids. A pre-token by itself is split into itself, so the same call encodes single words."""
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=parse_vocabulary(raw), special_tokens={}).encode_ordinary


_SPLIT = regex.compile(PATTERN)


def pretokens(text: str) -> list[str]:
    return _SPLIT.findall(text)


def parts(text: str, size: int = PART_CHARS):
    """Pre-tokens of the text in parts of at least `size` characters; together they are exactly those of the whole text."""
    if len(text) <= size:
        yield pretokens(text)
        return
    out, n = [], 0
    for m in _SPLIT.finditer(text):
        out.append(m.group())
        n += len(out[-1])
        if n >= size:
            yield out
            out, n = [], 0
    yield out


class _Numbers(dict):
    """Words numbered in the order of their first use."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _gather(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places start[0] .. start[0]+n[0]-1, start[1] .. of runs laid end to end."""
    end = np.cumsum(n)
    return np.repeat(start - (end - n), n) + np.arange(end[-1] if len(end) else 0)


# --- blocks ---------------------------------------------------------------------------------------------------------------------------------

#: a row holds the words of one block and bucket (slot < BUCKETS; a: their numbers, b: lengths, c: bytes), after encoding their ids (b: lengths, c: ids), or the
#: documents of one block (slot = BUCKETS; a: doc_ids, b: lengths, c: numbers of their pre-tokens, d: which doc_ids are null; last: the text ends here)
_ROWS = "route long, home long, part long, slot int, last boolean, a binary, b binary, c binary, d binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_TYPES = pa.schema([("route", pa.int64()), ("home", pa.int64()), ("part", pa.int64()), ("slot", pa.int32()), ("last", pa.bool_()), *[(k, pa.binary()) for k in "abcd"]])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.types)], schema=_TYPES)


def _pack(group: int, home: int, part: int, words: _Numbers, docs: list[tuple], last: bool) -> pa.RecordBatch:
    """Rows of one block (or one part of a long text). docs: (doc_id or None, numbers)."""
    by: list[tuple[list, list]] = [([], []) for _ in range(BUCKETS)]
    for w, n in words.items():
        raw = w.encode("utf-8", "replace")
        numbers, texts = by[crc32(raw) % BUCKETS]
        numbers.append(n)
        texts.append(raw)
    rows = [
        (group * BUCKETS + k, home, part, k, None, np.array(numbers, np.int32).tobytes(), np.fromiter(map(len, texts), np.int32, len(texts)).tobytes(), b"".join(texts), None)
        for k, (numbers, texts) in enumerate(by) if numbers
    ]
    codes = np.concatenate([c for _, c in docs])
    codes = codes.astype(np.uint16 if len(words) <= 1 << 16 else np.int32)
    ids, null = np.array([d or 0 for d, _ in docs], np.int64), np.array([d is None for d, _ in docs])
    # the documents of a block stay spread evenly while words meet
    rows.append((group * BUCKETS + (home + part) % BUCKETS, home, part, BUCKETS, last, ids.tobytes(), np.array([len(c) for _, c in docs], np.int64).tobytes(), codes.tobytes(), null.tobytes()))
    return _batch(rows)


def _blocks(batches, task: int, block_chars: int, part_chars: int, tasks_of_group: int):
    """Rows of the blocks of one task. Blocks are numbered within the task's input, which is the same whenever the task runs again over the same scan."""
    group, home, words, docs, chars = task // tasks_of_group, task << 32, _Numbers(), [], 0
    number = lambda table, ws: np.fromiter(map(table.__getitem__, ws), np.int32, len(ws))
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if len(text) > part_chars:
                if docs:
                    yield _pack(group, home, 0, words, docs, True)
                    home, words, docs, chars = home + 1, _Numbers(), [], 0
                held = None
                for k, ws in enumerate(parts(text, part_chars)):
                    if held is not None:
                        yield _pack(group, home, *held, False)
                    own = _Numbers()
                    held = (k, own, [(doc, number(own, ws))])
                yield _pack(group, home, *held, True)
                home += 1
                continue
            docs.append((doc, number(words, pretokens(text))))
            chars += len(text)
            if chars >= block_chars:
                yield _pack(group, home, 0, words, docs, True)
                home, words, docs, chars = home + 1, _Numbers(), [], 0
    if docs:
        yield _pack(group, home, 0, words, docs, True)


def _split(*sizes):
    def run(batches):
        from pyspark import TaskContext

        return _blocks(batches, TaskContext.get().partitionId(), *sizes)

    return run


def _encode(raw: bytes):
    def run(batches):
        encode = encoder(raw)
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            rows = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                route, home, part, slot, last, a, b, c, d = row
                if slot == BUCKETS:
                    rows.append(row)
                    continue
                found, at = [], 0
                for n in np.frombuffer(b, np.int32).tolist():
                    w = c[at : at + n]
                    at += n
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= CACHE:
                            known.clear()
                        ids = known[w] = encode(w.decode())
                    found.append(ids)
                sizes = np.fromiter(map(len, found), np.int32, len(found))
                flat = np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum()))
                rows.append((route, home, part, slot, last, a, sizes.tobytes(), flat.tobytes(), None))
            if rows:
                yield _batch(rows)

    return run


def _list_array(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _assemble(batches):
    """Ids in the places of their pre-tokens. Rows come sorted by home, part and slot: the words of a block, then its documents."""
    key, held = None, []
    numbers, sizes, flat = [], [], []
    for batch in batches:
        for _, home, part, slot, last, a, b, c, d in zip(*[x.to_pylist() for x in batch.columns]):
            if (home, part) != key:
                key, numbers, sizes, flat = (home, part), [], [], []
            if slot < BUCKETS:
                numbers.append(np.frombuffer(a, np.int32))
                sizes.append(np.frombuffer(b, np.int32))
                flat.append(np.frombuffer(c, np.int32))
                continue
            ids, n = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            null = np.frombuffer(d, np.bool_)
            codes = np.frombuffer(c, np.uint16 if len(c) == 2 * int(n.sum()) else np.int32)
            values, count = np.zeros(0, np.int32), np.zeros(len(n), np.int64)
            if len(codes):
                word, size = np.concatenate(numbers), np.concatenate(sizes).astype(np.int64)
                start = np.empty(len(word), np.int64)
                length = np.empty(len(word), np.int64)
                start[word], length[word] = np.cumsum(size) - size, size
                each = length[codes]
                values = np.concatenate(flat)[_gather(start[codes], each)]
                count = np.diff(np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(n)]])
            if not last or held:  # a part of a long text
                held.append(values)
                if not last:
                    continue
                values, held = np.concatenate(held), []
                count = np.array([len(values)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), _list_array(count, values)], names=["doc_id", "ids"])


def encode_corpus(docs: DataFrame, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS, tasks_of_group: int = GROUP) -> DataFrame:
    """(doc_id, ids) of every row of `docs` (doc_id, text).

    Null and empty texts have no ids ([]). Repeated rows and null doc_ids stay as they are. Strings of special tokens are ordinary text. Very long texts are encoded
    whole, in parts. `docs` must be a scan or a checkpoint, so that a task that runs again sees the same rows. Other columns are left out.
    """
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_split(block_chars, part_chars, tasks_of_group), _ROWS)
    met = split.repartition("route").mapInArrow(_encode(read_vocabulary(vocabulary)), _ROWS)
    return met.repartition("home").sortWithinPartitions("home", "part", "slot").mapInArrow(_assemble, "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): ids are looked up in the token-byte table, which is of fixed size and lies in every task; bytes are laid end to end.

    No ids give '', and so do null, and ids that the table doesn't have. Bytes that aren't UTF-8 become U+FFFD.
    """
    raw = read_vocabulary(vocabulary)

    def run(batches):
        table = {i: b for b, i in parse_vocabulary(raw).items()}
        top = max(table) + 1
        size = np.array([len(table.get(i, b"")) for i in range(top)] + [0], np.int64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(table.get(i, b"") for i in range(top)), np.uint8)
        for batch in batches:
            doc, ids = batch.column(0), batch.column(1)
            n = np.asarray(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            v = np.asarray(ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
            v = np.where((v >= 0) & (v < top), v, top)
            blob = flat[_gather(start[v], size[v])].tobytes()
            at = np.r_[0, np.cumsum(size[v])][np.r_[0, np.cumsum(n)]].tolist()
            yield pa.RecordBatch.from_arrays([doc, pa.array([blob[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:])], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, carry: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every row, or (doc_id, `carry`, tokens) with a text column that comes along; counted where the texts lie, nothing is shuffled.

    Null and empty texts have no tokens.
    """
    raw = read_vocabulary(vocabulary)

    def run(batches):
        encode = encoder(raw)
        count = lambda text: 0 if not text else len(encode(text)) if len(text) <= PART_CHARS else sum(len(encode(w)) for ws in parts(text) for w in ws)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([count(x) for x in batch.column(2).to_pylist()], pa.int64())], names=["doc_id", "carry", "tokens"])

    with_ = F.col(carry).cast("string") if carry else F.lit(None).cast("string")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), with_.alias("carry"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, carry string, tokens long")
    return out.withColumnRenamed("carry", carry) if carry else out.drop("carry")


__all__ = ["encode_corpus", "decode_corpus", "count_tokens"]
