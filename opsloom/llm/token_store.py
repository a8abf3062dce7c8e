"""Token ids in Parquet: delta-encoded numbers, dictionary-encoded id lists.

A dataset of token files is written in ascending document order: the rows are
dealt by ranges of the id, sorted, and encoded where they lie. A file's rows
hold ``doc_id``, ``part`` (the file's place in the order), ``offset`` (ids of
the part before this document), ``n_tokens`` and ``tokens`` (list of int). Row
groups and pages are bounded, and page indexes are written, so a reader that
asks for a few documents or for the numbers alone touches few pages. The small
``parts`` table has a row a part with the ids before it; ``start`` is its sum
with ``offset``.

Words repeat, so a text is cut at blanks, each distinct chunk is encoded once
a worker and looked up afterwards. This gives the same ids: the tokenizer's
words never span blanks.

Defined results: null text is empty and gives the end id alone; rows with a
null id come first; repeated ids are ordered by their text; an empty table
gives empty files. Extra columns of the input are not stored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.llm.workspace import Workspace

END = 1
CACHE = 600_000  # distinct chunks a worker keeps; then it starts anew
JOINED = 256  # words in a line
SLICE = 1000  # documents encoded at a time
MARKS = ".,!?;:|"
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding for numbers without a dictionary
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#offset": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
SCHEMA = "doc_id long, part int, offset long, n_tokens long, tokens array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_tokenizer(path: str) -> None:
    """Chunks give the ids of whole texts only if blanks separate, case goes and words end with a mark of their own."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    kinds = lambda part, inner: [x.get("type") for x in ((whole.get(part) or {}).get(inner) or [])]
    split = ((whole.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    same = kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
    if not (same and split.get("behavior") == "Removed" and split.get("invert") and whole["model"].get("end_of_word_suffix") == "</w>"):
        raise ValueError("a tokenizer that does not cut texts at blanks into lower-case words with an end mark; its ids are not those of chunks")


class ChunkEncoder:
    """Encodes texts by their chunks between blanks, each distinct piece once.

    A chunk of letters and closing marks is two pieces, since the tokenizer
    never joins them; ASCII letters count in lower case. A chunk is known by
    the places of its two pieces in the table of ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, int] = {"": 0}
        self.pieces: dict[str, int] = {"": 0}
        self.table, self.first, self.size = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, chunks: set[str]) -> None:
        chunks.difference_update(self.chunks)
        pairs = []
        for c in chunks:
            stem = c.rstrip(MARKS)
            pairs.append((stem.lower() if stem.isascii() else stem, c[len(stem) :]) if stem.isalpha() else (c, ""))
        new = list({x for pair in pairs for x in pair}.difference(self.pieces))
        new.sort(key=str.isalpha)  # words of letters last: they are encoded many at a time
        split = next((i for i, x in enumerate(new) if x.isalpha()), len(new))
        ids, size = self._ids(new[:split])
        for at in range(split, len(new), JOINED * 64):
            more, sizes = self._joined(new[at : at + JOINED * 64])
            ids, size = np.concatenate([ids, more]), np.concatenate([size, sizes])
        self.pieces.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
        self.first = np.concatenate([self.first, len(self.table) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.table = np.concatenate([self.table, ids])
        place = self.pieces
        self.chunks.update((c, place[x] << 32 | place[y]) for c, (x, y) in zip(chunks, pairs, strict=True))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, encoded as lines of words; each word ends with one closing id."""
        ids, _ = self._ids([" ".join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)])
        ends = np.flatnonzero(self.closes[ids])
        if len(ends) != len(words):  # letters that fall apart when they are normalised
            return self._ids(words)
        return ids, np.diff(ends, prepend=-1)

    def encode(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has; each text's last is the end id.

        Arrow cuts the texts and finds the distinct chunks, so that Python
        objects are made for these alone.
        """
        texts = texts.fill_null("")
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.chunks) > CACHE:
            self.clear()
        self.learn(set(distinct))
        both = np.fromiter(map(self.chunks.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        at = np.stack([both >> 32, both & 0xFFFFFFFF], axis=1).ravel()
        n = self.size[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = self.table[np.repeat(self.first[at] - upto[:-1], n) + np.arange(upto[-1])]
        edge = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        ends = upto[2 * edge]
        return np.insert(out, ends[1:], end), np.diff(ends) + 1


@lru_cache(1)
def encoder_of(path: str) -> ChunkEncoder:
    """A worker's encoder; it keeps what it has learned for its next task."""
    return ChunkEncoder(path)


def _encoder(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = encoder_of(path), 0
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                ids, n = encoder.encode(part.column("text"), end)
                edge = np.concatenate([[0], np.cumsum(n)])
                tokens = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(before + edge[:-1]), pa.array(n), tokens], names=["doc_id", "part", "offset", "n_tokens", "tokens"])
                before += int(edge[-1])

    return run


PART_BYTES = 128 << 20
UNKNOWN_SIZE = 1 << 50  # where Spark knows no size it takes 2**63 bytes, and less for a part of the columns


def number_of_parts(docs: DataFrame) -> int:
    """As many parts as the shuffle has partitions, or as there are ``PART_BYTES`` in the input as Spark estimates it from the files, if those are more."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= UNKNOWN_SIZE else max(least, -(-size // PART_BYTES))


def write_tokens(docs: DataFrame, space: Workspace, tokenizer: str | None = None, end: int = END, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the token files (``tokens``) and the table of their parts (``parts``)."""
    check_tokenizer(tokenizer or default_tokenizer())  # once, on the driver
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = parts or number_of_parts(rows)
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    space.save(rows.mapInArrow(_encoder(tokenizer or default_tokenizer(), end), SCHEMA), "tokens", **FORMAT)
    sums = space.read("tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One row a part: the window over all of them stays small.
    space.save(sums.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1), "parts")


def read_tokens(space: Workspace) -> DataFrame:
    """doc_id, start, n_tokens, tokens; columns that are not asked for are not read."""
    parts = space.read("parts").select("part", "before")
    rows = space.read("tokens").join(F.broadcast(parts), "part")  # one row a file
    return rows.select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "tokens")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("tokens")
        edge, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "op3")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), space)
    return read_tokens(space).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op3_token_store": op3_token_store}
ORACLE: dict[str, str] = {}
