"""Encoding of a whole corpus with a public tokenizer: a global distinct-word shuffle.

Documents are read in blocks. A block's pre-tokens become a list of its
distinct words and, for each position, the number of its word. The words are
shuffled, so that each distinct word of the corpus is encoded once, and their
ids are joined back to the blocks, which put them together by position. A word
gives one row a block, however often it occurs there. Words are shuffled by
groups of ``GROUP_PARTITIONS`` input partitions, so that the rows of a word
that is in every block don't all meet in one task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.session import repeatable

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Characters of a block; a longer text is a block by itself.
BLOCK_CHARS = 1_000_000
#: Input partitions whose words are encoded once; as many as a word can have rows from in one task.
GROUP_PARTITIONS = 4096
#: Tokens of a vocabulary; decoding ships its token-byte table.
MAX_TOKENS = 1 << 22

# How the vocabulary's tokenizer splits a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ROW = pa.schema(
    [
        ("key", pa.string()),  # the word, or the block's name for the block's own row
        ("block", pa.int64()),
        ("word_no", pa.int32()),  # null for the block's own row
        ("payload", pa.binary()),  # of the block's own row: its documents and their words' numbers
    ]
)
_ROW_DDL = "key STRING, block BIGINT, word_no INT, payload BINARY"


def ranks(path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """Bytes of every token with its id, of a ``.tiktoken`` file in the folder ``path``."""
    with open(os.path.join(path, f"{vocabulary}.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(i) for token, i in (line.split() for line in lines)}


def word_encoder(path: str = TOKENIZERS, vocabulary: str = VOCABULARY):  # noqa: ANN201
    """Encoding without special tokens; their strings in a text are ordinary text."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks(path, vocabulary), special_tokens={})


def _head(doc_ids: list[int | None], lengths: list[int], sequence: np.ndarray) -> bytes:
    known = np.array([i is not None for i in doc_ids], dtype=np.uint8)
    ids = np.array([i or 0 for i in doc_ids], dtype=np.int64)
    size = np.array([len(doc_ids), sequence.itemsize], dtype=np.int64)
    return b"".join(x.tobytes() for x in (size, ids, np.array(lengths, dtype=np.int32), known, sequence))


def _read_head(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    n, width = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    ids, at = np.frombuffer(raw, np.int64, n, 16), 16 + 8 * n
    lengths, at = np.frombuffer(raw, np.int32, n, at), at + 4 * n
    known, at = np.frombuffer(raw, np.uint8, n, at), at + n
    sequence = np.frombuffer(raw[at:], np.uint16 if width == 2 else np.uint32)
    return pa.array(ids, pa.int64(), mask=known == 0), lengths, sequence


def _block(block: int, doc_ids: list, texts: list[list[str]]) -> pa.RecordBatch:
    number: dict[str, int] = {}
    sequence = [number.setdefault(w, len(number)) for words in texts for w in words]
    n = len(number)
    head = _head(doc_ids, [len(words) for words in texts], np.array(sequence, dtype=np.uint16 if n <= 2**16 else np.uint32))
    columns = [[f"\0{block}", *number], [block] * (n + 1), [None, *range(n)], [head] + [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    split = regex.compile(PATTERN).findall
    block, size, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(split(text) if text else [])
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield _block(block, ids, texts)
                block, size, ids, texts = block + 1, 0, [], []
    if ids:
        yield _block(block, ids, texts)


_CODED_DDL = "block BIGINT, word_no INT, payload BINARY"


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, vocabulary: str) -> Iterator[pa.RecordBatch]:
    """The ids of each row's word as its payload; rows come sorted by word, so that each is encoded once."""
    encode, word, ids = word_encoder(path, vocabulary).encode_ordinary, None, b""
    for batch in batches:
        out = []
        for key, own in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if own is None:
                if key != word:
                    word, ids = key, np.array(encode(key), dtype=np.int32).tobytes()
                own = ids
            out.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["block", "word_no", "payload"])


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _assembled(head: bytes, words: list[bytes]) -> pa.RecordBatch:
    doc_ids, lengths, sequence = _read_head(head)
    flat = np.frombuffer(b"".join(words), dtype=np.int32)
    width = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) // 4
    start = np.cumsum(width) - width
    # Each position's ids are a stretch of ``flat``; the stretches are laid out one after the other.
    of_word = width[sequence]
    ends = np.cumsum(of_word)
    ids = flat[np.repeat(start[sequence] - ends + of_word, of_word) + np.arange(of_word.sum())]
    at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    offsets = np.concatenate([[0], ends])[at].astype(np.int32)
    return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], schema=_IDS)


def _assemble_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each block; rows come sorted by block, its own row first, then its words by number."""
    head, words = None, []
    for batch in batches:
        for word_no, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if word_no is None:
                if head is not None:
                    yield _assembled(head, words)
                head, words = payload, []
            else:
                words.append(payload)
    if head is not None:
        yield _assembled(head, words)


def encode_corpus(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZERS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Ids of every text, without special tokens: doc_id, ids.

    One row for each row of ``documents``, also for repeated rows and null ids;
    a null or empty text has an empty list. Texts are encoded whole, a very long
    one as a block of its own; no rows give none; other columns are not looked
    at. ``path`` is the folder of the
    vocabulary's ``.tiktoken`` file, which every executor reads there. Documents
    that come out of a shuffle are written to the checkpoint folder first, as
    blocks are named by their place.
    """
    docs = repeatable(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    words = docs.mapInArrow(_split_batches, _ROW_DDL)
    words = words.repartition("key", F.shiftright("block", 32 + GROUP_PARTITIONS.bit_length() - 1)).sortWithinPartitions("key")
    coded = words.mapInArrow(lambda b: _encode_batches(b, path, vocabulary), _CODED_DDL)
    return coded.repartition("block").sortWithinPartitions("block", "word_no").mapInArrow(_assemble_batches, "doc_id BIGINT, ids ARRAY<INT>")


class TokenBytes:
    """The token-byte table: the bytes of id i are ``flat[start[i]:start[i] + width[i]]``."""

    def __init__(self, table: dict[bytes, int]):
        if len(table) > MAX_TOKENS or max(table.values(), default=0) >= 2 * MAX_TOKENS:
            raise ValueError(f"more than {MAX_TOKENS} tokens")
        unknown = "\ufffd".encode()
        self.known = max(table.values(), default=-1) + 1
        tokens = [unknown] * (self.known + 1)  # the last stands for every unknown id
        for token, i in table.items():
            tokens[i] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.width = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.width) - self.width

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of lists of ids, the i-th being ``ids[offsets[i]:offsets[i + 1]]``."""
        ids = np.where((ids >= 0) & (ids < self.known), ids, self.known)
        width = self.width[ids]
        ends = np.cumsum(width)
        raw = self.flat[np.repeat(self.start[ids] - ends + width, width) + np.arange(width.sum())].tobytes()
        at = np.concatenate([[0], ends])[offsets]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def decode_corpus(encoded: DataFrame, path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts of encoded documents (doc_id, ids): doc_id, text.

    One row for each row, also for repeated and null doc_ids. Ids meet the
    token-byte table, which is shipped to the tasks and no larger than the
    vocabulary, position by position; nothing is shuffled. Null and empty lists
    give an empty text; bytes that are no UTF-8, null ids and ids that the
    vocabulary doesn't have give U+FFFD. Other columns are not looked at.
    """
    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("ids"), F.array()).cast("array<bigint>").alias("ids"))
    shipped = encoded.sparkSession.sparkContext.broadcast(TokenBytes(ranks(path, vocabulary)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            texts = shipped.value.texts(ids, offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(decode, "doc_id BIGINT, text STRING")


def token_counts(text: Column, path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text, 0 for null: a local expression, for those who need no ids."""
    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = word_encoder(path, vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
