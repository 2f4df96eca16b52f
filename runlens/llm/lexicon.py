"""BPE encoding and decoding with a minimal acyclic transducer over frequent words.

Frequent chunks (a word with the white space before it) are compiled into one
automaton whose words share prefixes and suffixes. Every arc carries a number;
the sum along a word's path is its place in a table of ids, so the automaton is
a transducer from words to ids. It is one flat file that workers map into
memory. Chunks that it lacks are merged exactly by the tokenizer itself.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, table, text_rows
from .tokens import Chunks, led_chunks, tokenizer_path

#: Words in the automaton, and the words that each task proposes with their counts.
WORDS_MAX, PER_TASK = 40_000, 20_000
#: Bytes of a word in the automaton at most; longer ones are merged.
LONGEST = 40
#: Texts whose chunks are looked up together.
TOGETHER = 512


def compile_words(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The automaton of ``words`` (built in sorted order, merging equal right languages at once) as one flat file."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[int] = [0]
    before = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            same = known.setdefault((final[state], *arcs[state].items()), state)
            if same != state:
                arcs[path[-1]][before[len(path) - 1]] = same

    for word in sorted(words):
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        settle(shared)
        for b in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        before = word
    settle(0)

    below: dict[int, int] = {}  # words that end at or below a state
    order: list[int] = []
    stack = [0]
    seen = {0}
    while stack:
        state = stack.pop()
        order.append(state)
        for to in arcs[state].values():
            if to not in seen:
                seen.add(to)
                stack.append(to)
    number = {state: i for i, state in enumerate(order)}

    def count(top: int) -> None:
        todo = [top]
        while todo:
            state = todo[-1]
            if open_ := [t for t in arcs[state].values() if t not in below]:
                todo += open_
            else:
                below[state] = final[state] + sum(below[t] for t in arcs[state].values())
                todo.pop()

    count(0)
    keys, targets, adds = [], [], []
    for state in order:
        place = int(final[state])
        for b in sorted(arcs[state]):
            to = arcs[state][b]
            keys.append(number[state] * 256 + b)
            targets.append(number[to])
            adds.append(place)
            place += below[to]
    ids = [words[w] for w in sorted(words)]
    parts = {
        "keys": np.array(keys, "<u8"), "targets": np.array(targets, "<u4"), "adds": np.array(adds, "<u4"),
        "final": np.array([final[s] for s in order], "u1"), "starts": np.cumsum([0, *map(len, ids)]).astype("<u4"), "ids": np.array([x for t in ids for x in t], "<u4"),
    }
    head, at, blobs = {}, 0, []
    for name, a in parts.items():
        head[name] = [a.dtype.str, at, len(a)]
        blobs.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        at += len(blobs[-1])
    top = json.dumps(head).encode()
    top += b" " * (-len(top) % 8)
    return len(top).to_bytes(8, "little") + top + b"".join(blobs)


class Lexicon:
    """A compiled automaton, mapped into memory; looks up many words at once."""

    held: dict[str, Lexicon] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(self.map[:8], "little")
        for name, (kind, at, n) in json.loads(self.map[8 : 8 + size]).items():
            setattr(self, name, np.frombuffer(self.map, kind, n, 8 + size + at))

    @classmethod
    def of(cls, name: str) -> Lexicon:
        return cls.held.get(name) or cls.held.setdefault(name, cls(SparkFiles.get(name)))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the ids table, -1 for words that aren't there."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        out = np.full(len(words), -1, np.int64)
        if not len(rows) or not len(self.keys):
            return out
        chars = np.frombuffer(b"".join(words[r].ljust(LONGEST, b"\0") for r in rows), np.uint8).reshape(-1, LONGEST)
        lengths, state, place = lengths[rows], np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        for k in range(int(lengths.max())):
            key = state[live] * np.uint64(256) + chars[live, k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            live, at = live[found], at[found]
            state[live] = self.targets[at]
            place[live] += self.adds[at]
            ends = lengths[live] == k + 1
            done = live[ends]
            good = done[self.final[state[done].astype(np.int64)] == 1]
            out[rows[good]] = place[good]
            live = live[~ends]
            if not len(live):
                break
        return out

    def ids_at(self, places: np.ndarray) -> list[bytes]:
        """Ids of the words at these places, as little-endian 32-bit numbers."""
        raw = self.ids.data.cast("B")
        return [bytes(raw[a:b]) for a, b in zip((4 * self.starts[places]).tolist(), (4 * self.starts[places + 1]).tolist())]


def frequent_words(docs: DataFrame) -> dict[str, int]:
    """Counts over all texts of the most frequent chunks: each task proposes its PER_TASK most frequent ones, their counts are summed, WORDS_MAX stay."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(led_chunks(text))
            if len(seen) > 20 * PER_TASK:
                seen = Counter(dict(seen.most_common(10 * PER_TASK)))
        top = [(w, n) for w, n in seen.most_common(PER_TASK) if len(w) <= LONGEST and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    top = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(WORDS_MAX)
    return {r.word: r.n for r in top.collect()}


def ship_lexicon(spark: SparkSession, words: list[str], path: str) -> str:
    """Compile ``words``, put the file into the shared folder and have Spark hand it to every executor; its name there."""
    chunks = Chunks.of(path)
    kept = [w for w in words if 0 < len(w.encode()) <= LONGEST]
    blob = compile_words({w.encode(): tuple(np.frombuffer(ids, "<u4").tolist()) for w, ids in chunks.merge(kept).items()})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to)
    out.write(blob)
    out.close()
    spark.sparkContext.addFile(to.toString())
    return name


class Decoder:
    """Bytes of every id, special tokens as their text."""

    held: dict[str, Decoder] = {}

    def __init__(self, path: str):
        with open(path) as f:
            data = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary shows as themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        names = {i: t for t, i in data["model"]["vocab"].items()} | {x["id"]: x["content"] for x in data["added_tokens"]}
        self.bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in (names.get(i, "") for i in range(max(names) + 1))]
        self.text = [*map(str, range(len(self.bytes)))]

    @classmethod
    def of(cls, path: str) -> Decoder:
        return cls.held.get(path) or cls.held.setdefault(path, cls(path))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode_texts(texts: list[str], lexicon: Lexicon, chunks: Chunks) -> Iterator[list[int]]:
    """Ids of each text: the automaton's for the words that it has, exact merges for the rest."""
    for at in range(0, len(texts), TOGETHER):
        split = [led_chunks(t) for t in texts[at : at + TOGETHER]]
        words = [*{w for s in split for w in s}]
        places = lexicon.places([w.encode() for w in words])
        known = places >= 0
        ids = dict(zip((w for w, k in zip(words, known.tolist()) if k), lexicon.ids_at(places[known])))
        ids.update(chunks.each({w for w, k in zip(words, known.tolist()) if not k}))
        for s in split:
            yield np.frombuffer(b"".join(map(ids.__getitem__, s)), "<u4").tolist()


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (array), decoded text, and SHA-256 of both as hex.

    ``tokenizer`` is the path of a byte-level BPE file. Null text counts as
    empty, which has no ids; repeated rows and null ids are kept as they are; an
    empty table gives an empty result; other columns are ignored. Special
    tokens are recognised in texts, as the library does by default.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    docs = text_rows(df, id_col, text_col)
    name = ship_lexicon(df.sparkSession, [*frequent_words(docs)], path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, chunks, decoder = Lexicon.of(name), Chunks.of(path), Decoder.of(path)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for batch in batches:
            out: list[tuple] = []
            for ids in encode_texts(batch.column(1).to_pylist(), lexicon, chunks):
                text = decoder.decode(ids)
                out.append((len(ids), sha(",".join(map(decoder.text.__getitem__, ids)).encode()), sha(text.encode()), *((ids, text) if with_ids else ())))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 5 if with_ids else 3]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.split()[0] for f in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def op3_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), with_ids=False)
