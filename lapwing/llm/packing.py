"""Best-fit packing of tokenized documents by exact-complement hashing.

A packing decision depends on lengths alone, and there are at most ``capacity`` different
lengths, so the plan is made on the histogram of lengths and never sees a document: patterns
(lengths that share a sequence, with counts) and how many sequences follow each. Pieces then
find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import string
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import cut, running, runs, table

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 4096, 1
#: Words without case and punctuation that a task remembers the ids of; bytes of text that are worked through at once.
PARTS, AT_ONCE = 500_000, 2 << 20
#: Punctuation that may be taken off a word's end; no apostrophe, as it can begin a token group with letters.
TAIL = b".,*$%&#!?;:)\""
#: Words that are encoded in one call.
TOGETHER = 2000
#: Pieces of one length that are ranked in one window.
RANKED_TOGETHER = 512


def _ends_in_letter(body: bytes) -> bool:
    """Whether what the tokenizer makes of a word (composed, lower case) ends in a letter: "\u0130" ends in a mark, which joins punctuation."""
    if body.isascii():
        return body[-1:].isalpha()
    return unicodedata.normalize("NFC", body.decode("utf-8", "replace")).lower()[-1].isalpha()


def _one_group(text: str) -> bool:
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


def _chunks(text: bytes, most: int = AT_ONCE):
    """The text in parts of about ``most`` bytes, cut before white space."""
    at = 0
    while len(text) - at > most:
        gap = _SPACE.search(text, at + most)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


_SPACE = re.compile(rb"[ \t-\r]")


_LETTERS = np.frombuffer(string.ascii_letters.encode(), dtype=np.uint8)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of large strings."""
    _, offsets, data = texts.buffers()
    return np.frombuffer(data or b"", dtype=np.uint8), np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]


def _gathered(data: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(data, ends) of the runs of ``data`` that ``index`` names, in its order."""
    size = np.diff(ends)[index]
    past = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(ends[:-1][index] - past[:-1], size) + np.arange(past[-1])], past


class WordTokenizer:
    """Ids of whole texts, word by word.

    The tokenizer drops white space before it merges, so a text's ids are those of its
    space-separated words in order. A run of punctuation after a word's last letter is a token
    group of its own (unless the word ends in a mark when it is composed and folded), and case is
    folded, so words are encoded without both. The words of many texts are made distinct as an
    Arrow dictionary, looked up once each, and their ids gathered by position.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are busy with other tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # ids that end a token group
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.parts: dict[bytes, bytes] = {b"": b""}
        self.again: set[bytes] = {b""}

    def _split(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(bodies, tails): words without the punctuation after their last letter and without case, and that punctuation; other words as they are."""
        bodies = pc.ascii_rtrim(words, TAIL.decode())
        (data, ends), (_, word_ends) = _bytes(bodies), _bytes(words)
        sizes, whole = np.diff(ends), np.diff(word_ends)
        last = np.where(sizes > 0, data[ends[1:] - 1] if len(data) else 0, 0)
        ok = np.isin(last, _LETTERS) | (last > 127)
        for i in np.flatnonzero(last > 127).tolist():
            ok[i] = _ends_in_letter(bodies[i].as_buffer().to_pybytes())
        ok &= ~pc.match_substring(words, "<").to_numpy(zero_copy_only=False)
        tails = np.where(ok, whole - sizes, 0)
        in_tail = np.repeat(np.tile([False, True], len(words)), np.stack([whole - tails, tails], axis=1).ravel())
        text = _bytes(words)[0][word_ends[0] : word_ends[-1]][in_tail]
        tail = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(tails)]).astype(np.int64)), pa.py_buffer(text.tobytes()))
        return pc.if_else(pa.array(ok), pc.ascii_lower(bodies), words), tail

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_groups(self, texts: list[str]) -> list[bytes]:
        """Encodes words that are one token group each, as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, dtype="<u4")
        past = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(past) != len(texts):
            return self._encode(texts)
        data, past = ids.tobytes(), past.tolist()
        return [data[a:b] for a, b in zip([0, *past], past, strict=False)]

    def learn(self, new: list[bytes]) -> None:
        """Adds the parts."""
        groups, others = [], []
        for x in new:
            (groups if _one_group(text := x.decode("utf-8", "replace")) else others).append((x, text))
        for some, encode in ((groups, self._encode_groups), (others, self._encode)):
            for at in range(0, len(some), TOGETHER):
                part = some[at : at + TOGETHER]
                self.parts.update(zip([x for x, _ in part], encode([text for _, text in part]), strict=True))

    def _known(self, some: list[bytes]) -> list[bytes]:
        """The ids of different parts. Those that came again since parts were last forgotten stay when the others are; most come once."""
        if len(self.parts) > PARTS:
            self.parts = {x: self.parts[x] for x in itertools.islice(self.again, PARTS // 2)} | {b"": b""}
            self.again = {b""}
        got = list(map(self.parts.get, some))
        new = [x for x, ids in zip(some, got, strict=True) if ids is None]
        self.again.update(itertools.compress(some, got))
        if new:
            self.learn(new)
            got = list(map(self.parts.__getitem__, some))
        return got

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of different words one after another, and where each word's begin and end."""
        body, tail = (x.dictionary_encode() for x in self._split(words))
        distinct = [x.dictionary.cast(pa.large_binary()).to_pylist() for x in (body, tail)]
        got = [ids for some in distinct for ids in self._known(some)]
        unit = np.stack([body.indices.to_numpy(zero_copy_only=False), tail.indices.to_numpy(zero_copy_only=False) + len(distinct[0])], axis=1).ravel()
        ids, ends = _gathered(np.frombuffer(b"".join(got), dtype="<u4"), np.concatenate([[0], np.cumsum(np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4)]), unit)
        return ids, ends[::2]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text; together the texts are about ``AT_ONCE`` bytes."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        found = split.flatten().dictionary_encode()
        out, past = _gathered(*self._of_words(found.dictionary), found.indices.to_numpy(zero_copy_only=False))
        ends = past[np.asarray(split.offsets) - split.offsets[0].as_py()]
        return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def pieces(self, texts: list[bytes], capacity: int):
        """(text's number, piece, start, length, crc) of the texts, each ended by the end id."""
        end = np.array([END], dtype="<u4")
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= AT_ONCE):
                n += len(texts[j])
                j += 1
            if j == i + 1:
                every = [np.concatenate([ids for part in _chunks(texts[i]) for ids in self.ids([part])])]
            else:
                every = self.ids(texts[i:j])
            for k, ids in enumerate(every, i):
                ids = np.append(ids, end)
                for p, a in enumerate(range(0, len(ids), capacity)):
                    b = ids[a : a + capacity]
                    yield k, p, a, len(b), zlib.crc32(b.tobytes())
            i = j


@functools.cache
def shared_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a Python worker, so that later tasks find the words of earlier ones."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a row for each piece of each document.

    A null text counts as empty and gives one piece that holds the end id only.
    """

    def split(batches):
        words = shared_tokenizer(tokenizer)
        for batch in batches:
            for at, part in runs(batch.column(1)):
                row, *rest = list(zip(*words.pieces(part, capacity), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at).take(pa.array(row, pa.int64())), pa.array(rest[0], pa.int32()), *[pa.array(x, pa.int64()) for x in rest[1:]]], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(split, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class Sums:
    """How many pieces of each length are left, with an index of pair sums.

    ``pairs[s]`` counts the unordered pairs of available lengths with sum ``s`` (a length pairs
    with itself while two pieces are left). It changes only when a length runs out, comes back,
    or goes between one piece and two, so keeping it costs one pass over the lengths then.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.free = np.zeros(capacity + 1, dtype=np.int64)
        self.pairs = np.zeros(2 * capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.add(length, n)

    def add(self, length: int, n: int) -> None:
        before, after = int(self.free[length]), int(self.free[length]) + n
        self.free[length] = after
        if (before > 0) != (after > 0):
            others = np.flatnonzero(self.free)
            self.pairs[others[others != length] + length] += 1 if after > 0 else -1
        self.pairs[2 * length] += (after > 1) - (before > 1)

    def pair(self, total: int, without: int = 0) -> list[int] | None:
        """Two available lengths with this sum, one piece of length ``without`` being taken; the longest short end, so that short pieces stay for the residuals."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange(1, total // 2 + 1)
        a = a[total - a < len(self.free)]
        b = total - a
        short = a[(self.free[a] >= 1 + (a == b) + (a == without)) & (self.free[b] >= 1 + (a == b) + (b == without))]
        return [total - int(short[-1]), int(short[-1])] if len(short) else None

    def complement(self, gap: int) -> list[int] | None:
        """One, two or three available lengths whose sum is ``gap``. Every length is tried as the third of a triple."""
        if gap < 1:
            return None
        if self.free[gap]:
            return [gap]
        if two := self.pair(gap):
            return two
        x = np.flatnonzero(self.free[: max(gap - 1, 0)])
        x = x[self.pairs[gap - x] > 0]
        for third in x[np.argsort(np.abs(3 * x - gap), kind="stable")].tolist():
            if two := self.pair(gap - third, third):
                return [third, *two]
        return None


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[((length, how many), ...), sequences]: patterns that use up all pieces.

    First every length, longest first, takes exact complements (one, two or three lengths that
    fill its gap, by the index of sums) as often as the counts allow. What is left goes best-fit, longest first: into
    the fullest open pattern with room for it, a new one where there is none. Every step uses
    up a length or a pattern, so steps depend on the number of lengths, not of pieces.
    """
    left = Sums(counts, capacity)
    free = left.free
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if free[capacity]:
        done.append((((capacity, 1),), int(free[capacity])))
        left.add(capacity, -int(free[capacity]))
    for length in range(capacity - 1, 0, -1):
        while free[length]:
            left.add(length, -1)
            found = left.complement(capacity - length)
            left.add(length, 1)
            if not found:
                break
            uses = {x: found.count(x) + (x == length) for x in {*found, length}}
            times = int(min(free[x] // n for x, n in uses.items()))
            for x, n in uses.items():
                left.add(x, -n * times)
            done.append((tuple(sorted(uses.items(), reverse=True)), times))
    room: dict[int, list[list]] = {}  # by tokens left: [pattern, sequences]
    open_bins = np.zeros(capacity + 1, dtype=np.int64)

    def keep(left: int, pattern: dict[int, int], seqs: int) -> None:
        room.setdefault(left, []).append([pattern, seqs])
        open_bins[left] += left < capacity

    for length in range(capacity, 0, -1):
        n = int(free[length])
        while n:
            fits = np.flatnonzero(open_bins[length:])
            gap = length + int(fits[0]) if len(fits) else None
            if gap is None:
                each = capacity // length
                for many, seqs in ((each, n // each), (n % each, 1)):
                    if many and seqs:
                        keep(capacity - many * length, {length: many}, seqs)
                n = 0
                continue
            pattern, seqs = room[gap].pop()
            open_bins[gap] -= 1
            each = min(gap // length, -(-n // seqs))
            full = min(seqs, n // each)
            if full < seqs:
                keep(gap, dict(pattern), seqs - full)
            pattern = pattern | {length: pattern.get(length, 0) + each}
            keep(gap - each * length, pattern, full)
            n -= full * each
    return done + [(tuple(sorted(p.items(), reverse=True)), seqs) for left in sorted(room) for p, seqs in room[left]]


def _slots(patterns, capacity: int) -> tuple[np.ndarray, ...]:
    """Of each (pattern, length): key of its first rank, ranks per sequence, first sequence, first offset; sorted by key."""
    cursor, base, out = np.zeros(capacity + 1, dtype=np.int64), 0, []
    for pattern, seqs in patterns:
        offset = 0
        for length, many in pattern:
            out.append((length << 44 | int(cursor[length]), many, base, offset))
            cursor[length] += many * seqs
            offset += length * many
        base += seqs
    return tuple(np.array(sorted(out), dtype=np.int64).reshape(-1, 4).T.copy())


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with a ``length`` of 1 to ``capacity``) with sequence_id and offset."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    key, many, base, offset = _slots(plan_patterns(counts, capacity), capacity)
    shared = spark.sparkContext.broadcast((key, many, base, offset))  # grows with the number of lengths, not of pieces
    split = F.array(*[F.lit(-(-counts.get(i, 0) // RANKED_TOGETHER) or 1) for i in range(capacity + 1)])
    mixed = F.xxhash64("id", "piece", "ids_crc32")
    ranked = running(parts.withColumn("__mix", mixed), ["length"], F.pmod("__mix", F.element_at(split, (F.col("length") + 1).cast("int"))), ["__mix", "id", "piece"], {"__rank": "1"}).drop("__mix")
    names = [c for c in ranked.columns if c != "__rank"]

    def find(batches):
        key, many, base, offset = shared.value
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            want = (length << 44) | batch.column(len(names)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, want, side="right") - 1
            k = want - key[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(base[at] + k // many[at]), pa.array(offset[at] + k % many[at] * length)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")
    return ranked.select(*names, "__rank").mapInArrow(find, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id. Repeated rows and ids, and null ids, are
    packed like any others; extra columns are ignored; an empty table gives no rows.
    """
    parts = cut(pieces(docs, tokenizer, id_col, text_col, capacity))
    return place(parts, capacity).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
