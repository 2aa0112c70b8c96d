"""Token ids in a binary form: Simple-8b words in blocks.

``encode`` deals documents out by ranges of doc_id, tokenises each range in order and writes blocks; ``documents`` and
``digests`` read them back.  The files are Parquet, so Spark's commit protocol and any Hadoop file system hold for them
and a lost executor leaves no half-written block.  A row is one block of whole documents:

====================  ==================================================================================================
part, block           place in the order of doc_id: the part is the range, the block counts up inside it
ids_before            ids of the part before this block
doc_ids, doc_ends     the documents, and where each ends, in ids from the block's start
words                 64-bit little-endian words; 4 bits select how many ids of what width the other 60 hold
escapes               ids too wide for 60 bits, as 64-bit little-endian words; the selector 0 points at them
====================  ==================================================================================================

The selectors are those of widths from 1 to 60 bits; there are none for runs of zeros, as the id 0 is rare in texts.  A block decodes without any other: the selectors give the offset of each word's first id, and all words of one
selector are unpacked in one array operation.

Defined cases: a null or empty text is just the end id; rows that share an id stay neighbours in the order of a hash of their texts, each a document; a null
id comes first; an empty table writes no block.  A text of any length is one document in one block.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmark.llm.arrow_text import as_bytes, gathered, parts, pieces
from gridmark.llm.common import hinted, shared_dir, ship

#: Selector k from 1 on: WIDTHS[k - 1] bits for each of COUNTS[k - 1] ids.
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.uint64)
COUNTS = np.array([60 // int(w) for w in WIDTHS])
ESCAPE = 0
BLOCK_IDS = 1 << 16
SCHEMA = "part int, block int, ids_before long, n_ids int, doc_ids array<long>, doc_ends array<long>, words binary, escapes binary"
ARROW_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("words", pa.binary()), ("escapes", pa.binary())])
#: Bytes of words and their ids that a Python worker remembers before it drops those used least, about 45 a word; longer pieces count as no words.
MOST_BYTES, LONGEST_PIECE = 24 << 20, 48
#: Signs after a word that the tokenizer always cuts off; an apostrophe may start a contraction.
TAIL = ".,;:!?%$&*#"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words and the escapes of unsigned 64-bit ids.  Each word takes as many of the next ids as fit."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    if not len(ids):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    need = np.where(ids >= np.uint64(1 << 60), 61, np.where(ids >= np.uint64(1 << 53), 60, np.frexp(ids.astype(np.float64))[1]))
    kind = np.searchsorted(WIDTHS.astype(np.int64), np.arange(65), side="left").astype(np.uint8)[need]
    padded = np.concatenate([kind, np.zeros(64, np.uint8)])
    widest = {1: padded}
    for n in (2, 4, 8, 16, 32):
        half = widest[n // 2]
        widest[n] = np.maximum(half[: -(n // 2)], half[n // 2 :])
    best = np.full(len(ids), ESCAPE, np.uint8)
    for k in range(len(WIDTHS), 0, -1):
        count = int(COUNTS[k - 1])
        reach = 1 << (count.bit_length() - 1)
        top = widest[reach]
        fits = np.maximum(top[: len(ids)], top[count - reach : count - reach + len(ids)]) < k
        best[fits] = k
    step = np.concatenate([[1], COUNTS]).astype(np.uint8)[best].tobytes()
    at, n, starts = 0, len(ids), []
    add = starts.append
    while at < n:
        add(at)
        at += step[at]
    starts = np.array(starts)
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    values = np.concatenate([ids, np.zeros(64, np.uint64)])
    for k in np.unique(chosen):
        where = np.flatnonzero(chosen == k)
        if k == ESCAPE:
            words[where] |= np.arange(len(where), dtype=np.uint64)
            continue
        shifts = np.arange(COUNTS[k - 1], dtype=np.uint64) * WIDTHS[k - 1]
        words[where] |= np.bitwise_or.reduce(values[starts[where][:, None] + np.arange(COUNTS[k - 1])] << shifts, axis=1)
    return words, ids[starts[chosen == ESCAPE]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the words."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.concatenate([[1], COUNTS])[chosen]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for k in np.unique(chosen):
        where = np.flatnonzero(chosen == k)
        first = (ends - counts)[where]
        if k == ESCAPE:
            out[first] = escapes[(words[where] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        width = WIDTHS[k - 1]
        shifts = np.arange(COUNTS[k - 1], dtype=np.uint64) * width
        out[first[:, None] + np.arange(COUNTS[k - 1])] = (words[where][:, None] >> shifts) & np.uint64((1 << int(width)) - 1)
    return out[:n]


class Pieces:
    """Ids of texts.

    A vocabulary whose tokenizer drops white space and marks ends of words has the ids of a text's pieces (between blanks and line feeds) in
    order.  Arrow finds the different pieces of a batch, so that each of them is looked up once, in a memory that Arrow holds as well.  A piece of letters with ``TAIL`` signs after it is cut
    there, and its letters lower-cased, so that a word is encoded once however it is written and whatever follows it; new words are encoded as
    one text and cut at the ids that end a word.  Other vocabularies encode whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        suffix = kind["model"].get("end_of_word_suffix")
        steps = (kind["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_piece = bool(suffix) and any(s.get("behavior") == "Removed" and s.get("invert") and r"[^\s\p{L}\p{N}]+" in s["pattern"].get("Regex", "") for s in steps)
        self.word_ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.by_piece:
            self.word_ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """Empties the memory: the words, their ids one after the other, where those of each word end, how often batches had the word.  Place 0 is the empty word."""
        self.words, self.flat = pa.array([""], pa.large_string()), np.empty(0, np.uint32)
        self.ends, self.uses = np.zeros(1, np.int64), np.ones(1, np.int32)

    def sizes(self) -> np.ndarray:
        """About how many bytes each remembered word takes."""
        return pc.binary_length(self.words).to_numpy() + 4 * np.diff(self.ends, prepend=0) + 20

    def trim(self) -> None:
        """Drops the words that the fewest batches had, the oldest first, once all take ``MOST_BYTES``; half of that stays, and uses count half from then on."""
        sizes = self.sizes()
        if sizes.sum() <= MOST_BYTES:
            return
        order = np.lexsort((-np.arange(len(sizes)), -self.uses))
        stay = np.sort(order[np.cumsum(sizes[order]) <= MOST_BYTES // 2])
        stay = np.append(0, stay[stay > 0])
        self.flat, ends = gathered(self.flat, np.append(0, self.ends)[stay], self.ends[stay])
        self.words, self.ends, self.uses = self.words.take(pa.array(stay)), ends, self.uses[stay] // 2

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def remember(self, words: pa.Array, whole: pa.Array) -> None:
        """Adds ids: of words that are letters only, many as one text, and of other pieces, each as a text."""
        ids: list[np.ndarray] = [self.flat]
        sizes: list[np.ndarray] = []

        def one_by_one(texts: list[str]) -> None:
            for i in range(0, len(texts), 1000):
                each = self.encoded(texts[i : i + 1000])
                ids.append(np.fromiter(chain.from_iterable(each), np.uint32))
                sizes.append(np.fromiter(map(len, each), np.int64))

        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), pa.scalar(" ", pa.large_string()))
            found = np.array(self.encoded(joined.to_pylist())[0], np.uint32)
            cuts = np.flatnonzero(self.word_ends[found]) + 1
            if len(cuts) == len(part):
                ids.append(found)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                one_by_one(part.to_pylist())
        one_by_one(whole.to_pylist())
        self.words = pa.concat_arrays([self.words, words, whole])
        self.flat = np.concatenate(ids)
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes)))
        self.uses = np.append(self.uses, np.zeros(len(words) + len(whole), np.int32))

    def places(self, words: pa.Array, of_letters: np.ndarray) -> np.ndarray:
        """The places of different words; those that aren't known are encoded first."""
        at = pc.index_in(self.words, value_set=words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        place = np.full(len(words), -1, np.int64)
        place[at.drop_null().to_numpy()] = np.flatnonzero(known)
        new = place < 0
        if new.any():
            letters, others = np.flatnonzero(new & of_letters), np.flatnonzero(new & ~of_letters)
            place[np.append(letters, others)] = np.arange(len(self.words), len(self.words) + len(letters) + len(others))
            self.remember(words.take(pa.array(letters)), words.take(pa.array(others)))
        self.uses[place] += 1
        return place

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end``, and where each text's ids stop."""
        if not self.by_piece:
            each = self.encoded(["" if t is None else t for t in texts.to_pylist()])
            stops = np.cumsum([len(x) + 1 for x in each], dtype=np.int64)
            return np.fromiter((i for x in each for i in (*x, end)), np.uint32, int(stops[-1]) if len(stops) else 0), stops
        self.trim()
        bounds, data = as_bytes(texts)
        cuts, found = pieces(bounds, data, (data == 32) | (data == 10))
        own = pc.ascii_ltrim(found.dictionary, characters=" \n").cast(pa.large_string())
        core = pc.utf8_rtrim(own, characters=TAIL)
        letters = pc.and_(pc.utf8_is_alpha(core), pc.less_equal(pc.binary_length(own), LONGEST_PIECE))
        ascii_letters = pc.and_(letters, pc.string_is_ascii(core))
        word = pc.if_else(ascii_letters, pc.ascii_lower(core), pc.if_else(letters, core, own)).dictionary_encode()
        of_letters = np.zeros(len(word.dictionary), bool)
        number = word.indices.to_numpy(zero_copy_only=False)
        is_letters = letters.to_numpy(zero_copy_only=False).astype(bool)
        of_letters[number[is_letters]] = True
        tail_size = np.where(is_letters, pc.binary_length(own).to_numpy(zero_copy_only=False) - pc.binary_length(core).to_numpy(zero_copy_only=False), 0)
        tailed = np.flatnonzero(tail_size)
        own_bounds, own_data = as_bytes(own)
        tail_data, tail_ends = gathered(own_data, own_bounds[1:][tailed] - tail_size[tailed], own_bounds[1:][tailed])
        tails = pa.Array.from_buffers(pa.large_string(), len(tailed), [None, pa.py_buffer(np.append(0, tail_ends)), pa.py_buffer(tail_data)]).dictionary_encode()
        every = pa.concat_arrays([word.dictionary, tails.dictionary]).dictionary_encode()
        place = self.places(every.dictionary, np.append(of_letters, np.zeros(len(every.dictionary) - len(of_letters), bool)))[every.indices.to_numpy(zero_copy_only=False)]
        head, tail = place[number], np.zeros(len(own), np.int64)
        tail[tailed] = place[len(of_letters) :][tails.indices.to_numpy(zero_copy_only=False)]
        both = np.stack([head, tail], 1).ravel()
        kinds, kind_ends = gathered(self.flat, np.append(0, self.ends)[both], self.ends[both])
        kind_ends = kind_ends[1::2]
        kind_starts = np.concatenate([[0], kind_ends])[:-1]
        order = found.indices.to_numpy(zero_copy_only=False)
        sizes = (kind_ends - kind_starts)[order]
        before = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(cuts, bounds)]
        stops = before[1:] + np.arange(1, len(bounds))
        out = np.full(int(before[-1]) + len(stops), end, np.uint32)
        text_of = np.ones(len(out), bool)
        text_of[stops - 1] = False
        out[text_of] = gathered(kinds, kind_starts[order], kind_ends[order])[0]
        return out, stops


@functools.cache
def encoder(path: str) -> Pieces:
    """One for each Python worker: loading a vocabulary costs more than a task's texts."""
    return Pieces(path)


def encode(docs: DataFrame, vocabulary: str, end: int, path: str) -> None:
    """Writes the ids of the texts of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        ends: list[int] = []

        def closed() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            words, escapes = pack(flat)
            row = {"part": part, "block": block, "ids_before": before, "n_ids": len(flat), "doc_ids": names, "doc_ends": ends, "words": words.astype("<u8").tobytes(), "escapes": escapes.astype("<u8").tobytes()}
            return pa.RecordBatch.from_pylist([row], ARROW_SCHEMA)

        for batch in batches:
            for rows in parts(batch):
                flat, stops = encoder(vocabulary).ids(rows.column("text"), end)
                begin = 0
                for name, stop in zip(rows.column("doc_id").to_pylist(), stops.tolist(), strict=True):
                    ids.append(flat[begin:stop])
                    names.append(name)
                    ends.append((ends[-1] if ends else 0) + stop - begin)
                    begin = stop
                    if ends[-1] >= BLOCK_IDS:
                        yield closed()
                        block, before = block + 1, before + ends[-1]
                        ids, names, ends = [], [], []
        if ids:
            yield closed()

    ship(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(blocks, SCHEMA).write.option("compression", "zstd").parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``first``: the ids of all documents before each.  One sum for each range gives where ranges begin."""
    ship(spark)
    blocks = spark.read.schema(SCHEMA).parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    return blocks.join(hinted(starts, 100_000), "part").withColumn("first", F.col("part_start") + F.col("ids_before"))


def _each(block) -> Iterator[tuple[int | None, int, np.ndarray]]:
    ids = unpack(np.frombuffer(block.words, "<u8"), np.frombuffer(block.escapes, "<u8"), block.n_ids)
    begin = 0
    for name, stop in zip(block.doc_ids, block.doc_ends, strict=True):
        yield (None if pd.isna(name) else int(name)), int(block.first) + begin, ids[begin:stop]
        begin = int(stop)


def documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids) for each document of ``opened`` blocks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                yield pd.DataFrame([(n, s, i.astype(np.int64)) for n, s, i in _each(b)], columns=["doc_id", "start", "ids"]).astype({"doc_id": "Int64"})

    return blocks.mapInPandas(rows, "doc_id long, start long, ids array<long>")


def digests(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document of ``opened`` blocks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(n, s, len(i), zlib.crc32(i.astype("<u4").tobytes())) for b in batch.itertuples() for n, s, i in _each(b)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    return blocks.mapInPandas(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """``digests`` of what ``encode`` wrote to a new folder in the shared one."""
    path = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    encode(docs, vocabulary, end, path)
    return digests(opened(docs.sparkSession, path))
