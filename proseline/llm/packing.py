"""Operator 5, best-fit packing: a plan over the histogram of lengths, then pieces take planned slots by their rank.

Tokenising yields one slim row a piece; the histogram of their lengths (as many rows at most as a sequence has tokens)
is all that the driver sees. Best-fit decreasing runs over counts: all pieces of a length and all sequences with the
same room are handled at once, so planning takes the same time whatever the number of documents. The plan says which
ranks within a length go where; a piece's rank comes from a count by buckets and a row number within its bucket.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proseline.llm.common import body, cut

CAPACITY = 1024
END_ID = 2
#: Pieces in a bucket of one length, about.
BUCKET = 20_000
#: Bytes of texts that are encoded at once, about.
BLOCK = 4 << 20
#: Words that a worker remembers, and characters of the longest of them.
REMEMBERED, LONGEST = 600_000, 64
#: Words that a worker may hold between tasks.
BETWEEN_TASKS = 600_000
#: New words that are encoded as one text, and how few are encoded one by one.
TOGETHER, FEW = 512, 16
#: Marks that may end a word; an apostrophe is none, as what follows it may belong to it.
MARKS = ".,;:!?#$%&*|"
#: How byte-level vocabularies write a byte: visible Latin-1 characters as themselves, the rest from U+0100 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = dict(zip((b for b in range(256) if b not in _VISIBLE), range(256, 512), strict=False))
SPACE = chr(BYTE_LETTERS[32])
#: Each byte as they write it, as UTF-32; a line feed, which parts words, stays.
WRITTEN = np.array([b if b == 10 else BYTE_LETTERS.get(b, b) for b in range(256)], "<u4")
#: Texts with white space at their start, before other white space or at their end (RE2), and empty ones.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
ODD = rf"\A(?:{WHITE}|\z)|[ \n](?:{WHITE}|\z)"
LINE_FEED, BLANK, NOTHING = (pa.scalar(x, pa.large_string()) for x in ("\n", " ", ""))
NO_BYTES = pa.scalar(b"", pa.large_binary())
PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def strings(texts: pa.Array) -> list[str]:
    """As to_pylist, faster where no text has a space."""
    _, _, data = pc.binary_join_element_wise(texts, NOTHING, BLANK).buffers()
    out = str(data or b"", "utf-8").split(" ")[:-1]
    return out if len(out) == len(texts) else texts.to_pylist()


def by_value(texts: pa.Array, find: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """What find gives for the different texts, in the place of each."""
    coded = texts.dictionary_encode()
    return find(coded.dictionary).take(coded.indices)


def ends(names: pa.Array, stems: pa.Array) -> pa.Array:
    """What each name has after its stem."""
    size = pc.subtract(pc.binary_length(names), pc.binary_length(stems)).to_numpy()
    _, stops, data = names.buffers()
    at = np.append(0, np.cumsum(size))
    stops = np.frombuffer(stops, np.int64)[1 : len(names) + 1]
    own = np.frombuffer(data or b"", np.uint8)[np.repeat(stops - at[1:], size) + np.arange(at[-1])]
    return pa.LargeStringArray.from_buffers(len(names), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(own))


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes, by a byte-level BPE file of tokenizers.

    The pre-tokeniser of such files always starts a token at a white space that something else follows, so a text is the
    sequence of its chunks from one such space or line feed to the next, and each chunk has its ids by itself. A chunk's
    name is what follows its space, or the line feed and what follows it. Arrow finds the chunks of most texts and puts
    ids in their places; Python sees the different names of a block of texts. Ids of short chunks are remembered (without
    the marks that end them); all come from the tokenizers library, many new chunks at once. A token's characters in the
    vocabulary are its bytes, so the ids of a chunk are those that make up its length.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: The same model on words that are parted already.
        self.parted = Tokenizer(self.model)
        self.parted.pre_tokenizer = CharDelimiterSplit("\n")
        words = self.tokenizer.get_vocab()
        self.size = np.zeros(max(words.values()) + 1, np.int64)
        self.size[list(words.values())] = list(map(len, words))
        #: Strings that are looked for before the pre-tokeniser runs.
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line = self.ids("\n")
        self.starts = re.compile(r" (?=\S)|(?=\n\S)")

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def each(self, tokenizer, texts: list[str], ends: list[np.ndarray]) -> list[bytes]:
        """Ids of the parts of each text, whose ends in bytes are given."""
        out = []
        for own, encoded in zip(ends, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, "<u4")
            size = np.cumsum(self.size[ids])
            at = np.searchsorted(size, own)
            if not np.array_equal(size[at], own):
                raise ValueError("the vocabulary isn't one of byte-level tokens")
            data, stops = ids.tobytes(), (4 * (at + 1)).tolist()
            out += [data[a:b] for a, b in pairwise([0, *stops])]
        return out

    def together(self, names: list[str]) -> list[bytes]:
        """Ids of each name's chunk."""
        chunks = [x if x[0] == "\n" else f" {x}" for x in names]
        parts = [chunks[i : i + TOGETHER] for i in range(0, len(chunks), TOGETHER)]
        return self.each(self.tokenizer, ["".join(x) for x in parts], [np.cumsum([len(y.encode()) for y in x]) for x in parts])

    def letters(self, word: str) -> bytes:
        """Ids of letters after a space, which the pre-tokeniser keeps together: the model's own tokens."""
        text = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(SPACE + text)]).tobytes()

    def all_letters(self, words: list[str], before: str) -> list[bytes]:
        """Ids of letters, which the pre-tokeniser keeps together, each after a space or after nothing."""
        texts, ends = [], []
        for i in range(0, len(words), TOGETHER):
            data = np.frombuffer((before + f"\n{before}".join(words[i : i + TOGETHER])).encode(), np.uint8)
            texts.append(WRITTEN[data].tobytes().decode("utf-32-le"))
            at = np.append(np.flatnonzero(data == 10), len(data))
            ends.append(at - np.arange(len(at)))
        return self.each(self.parted, texts, ends)

    def learn(self, chunks: set[str], others: Iterable[str] = ()) -> None:
        """Remember the ids of all chunks (by name) but very long ones; others are names in the same texts."""
        known = self.known
        new = chunks.difference(known)
        if met := new.intersection(self.older):
            known.update((x, self.older[x]) for x in met)
            new -= met
        if len(known) + len(new) > REMEMBERED // 2:
            # what these texts have in common with earlier ones is kept, the rest until this happens again
            known, self.older = {x: known[x] for x in chain(chunks, others) if x in known}, known
            self.known = known
        short = [x for x in new if len(x) <= LONGEST]
        words = [x for x in short if x.isalpha()]
        rest = [x for x in short if not x.isalpha()]
        lines = [x[1:] for x in rest if x[0] == "\n" and x[1:].isalpha()]
        rest = [x for x in rest if x[0] != "\n" or not x[1:].isalpha()]
        known.update(zip(words, map(self.letters, words) if len(words) <= FEW else self.all_letters(words, " "), strict=True))
        known.update((f"\n{x}", self.line + y) for x, y in zip(lines, self.all_letters(lines, ""), strict=True))
        known.update(zip(rest, self.together(rest), strict=True))

    def stems(self, stems: pa.Array) -> pa.Array:
        """Ids of each name's chunk, remembered."""
        names = strings(stems)
        out = list(map(self.known.get, names))
        if new := {x for x, y in zip(names, out, strict=True) if y is None}:
            self.learn(new, names)
            # what is too long is not remembered
            out = [y or self.known.get(x) or self.together([x])[0] for x, y in zip(names, out, strict=True)]
        return pa.array(out, pa.large_binary())

    def ends(self, marks: pa.Array) -> pa.Array:
        """Ids of marks after a letter or a digit."""
        return pa.array([self.ids(x) for x in marks.to_pylist()], pa.large_binary())

    def find(self, names: pa.Array) -> pa.Array:
        """Ids of each name's chunk. The pre-tokeniser parts marks from a letter or a digit before them, so they are found apart."""
        stems = pc.ascii_rtrim(names, MARKS)
        stems = pc.if_else(pc.match_substring_regex(stems, r"[\p{L}\p{N}]\z"), stems, names)
        return pc.binary_join_element_wise(by_value(stems, self.stems), by_value(ends(names, stems), self.ends), NO_BYTES)

    def trim(self) -> None:
        """Forget what a worker between tasks shouldn't hold."""
        if len(self.known) + len(self.older) > BETWEEN_TASKS:
            self.older.clear()

    def many(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text of an Arrow array of large strings without nulls, or of a list."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        odd = pc.match_substring_regex(texts, ODD)
        for x in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        rest = iter(self.odd(texts.filter(odd).to_pylist()))
        # a line feed before a text makes its first chunk one like others
        lines = pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n")
        split = pc.split_pattern(pc.binary_join_element_wise(LINE_FEED, lines, NOTHING), " ")
        ids = by_value(split.flatten(), self.find)
        _, offsets, data = ids.buffers()
        stops = np.frombuffer(offsets, np.int64)[split.offsets].tolist()
        data, skip = memoryview(data), len(self.line)
        usual = (bytes(data[a + skip : b]) for a, b in pairwise(stops))
        return [next(rest if x else usual) for x in odd.to_pylist()]

    def odd(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, whatever is in it."""
        split = [[x] if any(y in x for y in self.added) else self.starts.split(x) for x in texts]
        names = list({y for x in split for y in x[1:]})
        by = dict(zip(names, self.find(pa.array(names, pa.large_string())).to_pylist(), strict=True))
        return [b"".join([self.ids(first), *map(by.__getitem__, rest)]) for first, *rest in split]


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """The encoder of this process, which keeps what it remembers from one task to the next."""
    return Encoder(path)


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens: one if they fit, else the first may be shorter and the rest are full."""
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


def whole(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes as large strings; what isn't UTF-8 is replaced."""
    try:
        return texts.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.large_string())


def blocks(batches: Iterable[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of as many rows as have about so many bytes; 256 rows stay together."""
    held, bytes_held = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held.append((part.column(0), whole(part.column(1))))
            bytes_held += pc.sum(pc.binary_length(part.column(1))).as_py()
            if bytes_held >= size:
                yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))
                held, bytes_held = [], 0
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids as bytes."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = shared_encoder(vocabulary or default_vocabulary())
        end = END_ID.to_bytes(4, "little")
        for ids_of_docs, texts in blocks(batches):
            take, out = [], []
            for i, ids in enumerate(encoder.many(texts)):
                ids, start = ids + end, 0
                for k, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    take.append(i)
                    out.append((k, start, length, zlib.crc32(own), own if with_ids else None))
                    start += length
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 3, pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids_of_docs.take(pa.array(take)), *columns[: 4 + with_ids]],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids],
            )
        encoder.trim()
        pa.default_memory_pool().release_unused()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", body().alias("body")).mapInArrow(run, f"doc_id {kind}, {PIECE}{', ids binary' * with_ids}")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, pieces a sequence, first sequence, offset).

    Piece number t of a run (from 0) goes to sequence first + t // n, at offset + t % n * length.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: (first sequence, how many)
    free: list[int] = []  # the keys of room, ascending
    runs, made = [], 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if not room[left]:
                insort(free, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            at = bisect_left(free, length)
            if at == len(free):
                each = capacity // length
                count = -(-todo // each)
                put(capacity, made, count)
                made += count
                continue
            left = free[at]
            first, count = room[left].pop()
            if not room[left]:
                free.pop(at)
            each = left // length
            whole = min(count, todo // each)
            if whole:
                runs.append((length, rank, rank + whole * each, each, first, capacity - left))
                put(left - each * length, first, whole)
                rank, todo = rank + whole * each, todo - whole * each
            if whole < count and todo:
                runs.append((length, rank, rank + todo, todo, first + whole, capacity - left))
                put(left - todo * length, first + whole, 1)
                todo, whole = 0, whole + 1
            put(left, first + whole, count - whole)
    return runs


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (which has a length column and is stored already) with sequence_id and offset.

    A length's rows are dealt to buckets in turn, whatever their ids, so one length of a third of all rows is ranked by
    many tasks. The plan has at most two runs for each pair of a length and a free room.
    """
    spark = found.sparkSession
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(
        plan(histogram, capacity) or [],
        "length bigint, since bigint, until bigint, each bigint, first bigint, base bigint",
    )
    buckets = max(1, -(-sum(histogram.values()) // BUCKET))
    dealt = found.withColumn("_bucket", F.pmod("_at", F.lit(buckets)))
    before = (
        dealt.groupBy("length", "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n"))
        .drop("_n")
    )
    own = Window.partitionBy("length", "_bucket").orderBy("_at")
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_bucket"])
    t = F.col("_before") + F.col("_own")
    placed = ranked.withColumn("_rank", t).join(
        F.broadcast(runs.withColumnRenamed("length", "_length")),
        F.expr("length = _length and _rank >= since and _rank < until"),
    )
    nth = F.col("_rank") - F.col("since")
    return placed.withColumns(
        {
            "sequence_id": F.col("first") + F.floor(nth / F.col("each")).cast("bigint"),
            "offset": F.col("base") + F.pmod(nth, F.col("each")) * F.col("length"),
        }
    ).drop("_at", "_bucket", "_own", "_before", "_rank", "_length", "since", "until", "each", "first", "base")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and the end id; a null or empty text is the end id alone. Only documents longer than
    capacity are cut. Repeated rows and null ids are packed like others; no rows give none; other columns are ignored.
    """
    found = pieces(docs, vocabulary, capacity, with_ids).withColumn("_at", F.monotonically_increasing_id())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    # about: a document's last piece, and others of four bytes a token; rows with ids are long and stay where they are
    asked = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(body())).alias("size")).first()
    rows = None if with_ids else asked.n + (asked.size or 0) // (4 * capacity)
    return place(cut(found, rows, dealt=True), capacity).select(*columns)
