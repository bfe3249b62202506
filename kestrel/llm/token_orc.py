"""Token ids as ORC files: written in ascending document order, read back.

The documents are range-partitioned and sorted by id; each task tokenizes its
range and writes one ORC file of rows (doc_id, part, start, n_tokens, ids).
ORC run-length codes the integers, keeps a row index every ``row_index_stride``
rows and a Bloom filter on ``doc_id``, so a lookup of documents skips files,
stripes and row groups, and readers share a file stripe by stripe.  ``start``
counts from the beginning of the file; a file's own offset is the sum of the
files before it, one row per file.

Null and empty texts hold the end id alone.  Rows with the same id follow each
other, ordered by a hash of their text; a null id comes first.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.blocks import materialize
from kestrel.llm.hashing import text_bytes
from kestrel.session import scratch_path

CACHE_WORDS = 500_000
#: Files whose offsets (16 bytes each) are broadcast when reading back.
BROADCAST_FILES = 100_000
# Lower-case words in normal form, without an apostrophe, and how the vocabulary's pattern cuts them.
_PLAIN = re.compile("[!-&(-@\\[-`{-~a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall
STORED = "doc_id long, part int, start long, n_tokens long, ids array<int>"


class _Words:
    """Ids of texts by the tokenizers library, called once per distinct word.

    Sound for vocabularies that lower-case and whose splitting drops white
    space: then no token reaches across it, and a text's ids are those of its
    words in turn.  A word of lower-case Latin letters, digits and ASCII signs
    needs no normalizing; its runs of letters, its digits and its runs of signs
    are the pieces, each learnt once by the library's merge model alone.  A word
    with an apostrophe or any other character goes through the whole tokenizer,
    and so does a text that may hold the string of a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        # the character that stands for each byte in a byte-level vocabulary
        self.chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.pack = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.cache = _Cache(self)

    def learn(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters only
            return self.piece(word.decode())
        text = word.decode()
        if not _PLAIN(text):
            return self.whole(word)
        pieces = _PIECES(text)
        if len(pieces) > 1:
            return b"".join([self.cache[p.encode()] for p in pieces])
        return self.piece(word.decode("latin-1").translate(self.chars))

    def piece(self, chars: str) -> bytes:
        pack = self.pack
        return b"".join([pack[t.id] for t in self.model.tokenize(chars)])

    def whole(self, text: bytes) -> bytes:
        return b"".join([self.pack[i] for i in self.tokenizer.encode(text.decode(), add_special_tokens=False).ids])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.cache = _Cache(self, self.cache)
        look = self.cache.__getitem__
        return [self.whole(t) if b"<|" in t else b"".join(map(look, t.lower().split())) for t in texts]


class _Cache(dict):
    """Ids by word, learnt when first asked for; takes over what is used of the cache before."""

    def __init__(self, words: _Words, older: dict | None = None):
        super().__init__()
        self.words, self.older = words, dict(older or ())

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.words.learn(word)
        self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _load(path: str) -> _Words:
    return _Words(path)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", row_index_stride: int = 1000) -> None:
    """Tokenize and write; ``vocabulary`` and ``path`` must be reachable by every executor."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    source = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = np.array([end_id], "<i4").tobytes()

    def run(batches):
        words, part, start = _load(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                data, ends = text_bytes(piece.column(1))
                raw, ends = data.tobytes(), ends.tolist()
                ids = words.encode([raw[a:b] for a, b in zip([0, *ends], ends)])
                sizes = np.array([len(i) // 4 + 1 for i in ids], np.int64)
                stops = np.cumsum(sizes)
                values = np.frombuffer(b"".join(x for i in ids for x in (i, end)), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(start + stops - sizes),
                     pa.array(sizes), lists], names=["doc_id", "part", "start", "n_tokens", "ids"])
                start += int(stops[-1])

    (source.mapInArrow(run, STORED).write.format("orc")
     .option("compression", "zstd").option("orc.row.index.stride", row_index_stride)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).save(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids of written files."""
    stored = spark.read.schema(STORED).orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
               .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    offsets = materialize(offsets, "token-offsets")
    if offsets.count() <= BROADCAST_FILES:  # else the ids are shuffled to their file's offset
        offsets = F.broadcast(offsets)
    return (stored.join(offsets, "part")
            .select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids"))


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, the number of ids read and their crc32."""
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return tokens.select("doc_id", "start", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write to the shared scratch folder, then read the files back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "llm-tokens")
    write_tokens(docs, vocabulary, path, end_id)
    return read_tokens(spark, path)
