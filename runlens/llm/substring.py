"""Substring dedup: documents streamed through suffix automata of reference shards, for matching statistics.

Two windows of ``width`` words that are equal have the same anchor: the least
hash of their inner word sequences. Stretches of windows with one anchor go to
the shard of that anchor, so all copies of a window meet in one shard, and no
document meets shards that hold nothing of it. Anchors that occur once are left
out beforehand, and equal stretches are one row before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, join_sized, numbered, sliced, stored, table, text_rows
from .jaccard import PRIME, WordHashes

#: Words of an anchor, at most; the power of two of bits in the filter of anchors that repeat (16 MB, whatever the input).
ANCHOR, FILTER = 8, 27
#: Stretches in a shard on average, and of one anchor at most before its windows go each to a shard of its own.
SHARD, HOT = 1024, 1024
#: Characters of texts taken together in a task, and the bits that the place of a window there has.
TOGETHER, PLACES = 1 << 20, 24


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive words."""
    out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        out = out * np.uint64(PRIME) + hashes[k : len(hashes) - width + 1 + k]
    return mixed(out)


def least(x: np.ndarray, many: int) -> np.ndarray:
    """Least of each ``many`` consecutive values."""
    width = 1
    while 2 * width <= many:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return np.minimum(x[: len(x) - (many - width)], x[many - width :]) if many > width else x


def stretches(words: list[bytes], ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first word, windows) of every stretch: consecutive windows of one text with the same leftmost least inner hash.

    ``words`` of texts that end at ``ends``. Equal windows get equal anchors at
    equal places, so two of them in a text are in different stretches.
    """
    inner = min(ANCHOR, width)
    none = np.zeros(0, np.int64)
    if len(words) < width:
        return none.astype(np.uint64), none, none
    hashes = np.fromiter(map(WordHashes.of().__getitem__, words), np.uint64, len(words))
    at = rolled(hashes, inner)
    if len(at) >> PLACES and len(ends) == 1:  # a text alone whose places don't fit beside the hash
        cut = 1 << (PLACES - 1)
        pieces = [(k, words[k : k + cut + width - 1]) for k in range(0, len(words), cut)]
        parts = [(k, *stretches(w, np.array([len(w)]), width)) for k, w in pieces]
        return np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + p[0] for p in parts]), np.concatenate([p[3] for p in parts])
    mask = np.uint64((1 << PLACES) - 1)
    place = least(at & ~mask | np.arange(len(at), dtype=np.uint64), width - inner + 1) & mask
    starts = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    whole = np.flatnonzero(owner[: len(place)] == owner[width - 1 :])  # windows within one text
    new = np.ones(len(whole), bool)
    new[1:] = (np.diff(place[whole].astype(np.int64)) != 0) | (np.diff(whole) != 1)
    first = np.flatnonzero(new)
    return at[place[whole[first]].astype(np.int64)], whole[first], np.diff(np.append(first, len(whole)))


def grouped(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(place of the first text, words, ends) of texts taken together; a long text comes alone."""
    at, words, ends, size = 0, [], [], 0
    for i, text in enumerate(texts):
        if ends and size + len(text) > TOGETHER:
            yield at, words, np.array(ends, np.int64)
            at, words, ends, size = i, [], [], 0
        words += text.split()
        ends.append(len(words))
        size += len(text)
    if ends:
        yield at, words, np.array(ends, np.int64)


def anchors(docs: DataFrame, width: int) -> DataFrame:
    """(anchor) of every stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for _, words, ends in grouped(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(stretches(words, ends, width)[0].view(np.int64))], ["anchor"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "anchor long")


def repeated(docs: DataFrame, width: int) -> np.ndarray:
    """A bit for each of 2**FILTER buckets of anchors: set if an anchor in it occurs more than once. Its size doesn't depend on the input."""
    often = anchors(docs, width).groupBy("anchor").count().where("count > 1")
    place = F.col("anchor").bitwiseAND((1 << FILTER) - 1)
    cells = often.select(F.shiftright(place, 15).alias("chunk"), place.bitwiseAND(32767).alias("place"))
    bits = np.zeros((1 << (FILTER - 15), 4096), np.uint8)
    for r in cells.repartition("chunk").groupBy("chunk").agg(F.bitmap_construct_agg("place").alias("bits")).collect():  # 4096 rows at most
        bits[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(-1)


def met(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    place = codes & np.uint64((1 << FILTER) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Automaton:
    """Suffix automaton of the word sequences read so far, built as they are read.

    Reading a word also gives the matching statistic: the length of the longest
    run of words, ending here, that was read before at an earlier place.
    """

    def __init__(self):
        self.length, self.link, self.next = [0], [-1], [{}]
        self.last = 0

    def restart(self) -> None:
        """A new sequence; what was read stays."""
        self.last = 0

    def split(self, at: int, word: int, state: int) -> int:
        """The state for the words of ``at`` and then ``word``, which ``state`` holds with longer ones."""
        length, link, step = self.length, self.link, self.next
        if length[state] == length[at] + 1:
            return state
        clone = len(length)
        length.append(length[at] + 1)
        link.append(link[state])
        step.append(step[state].copy())
        link[state] = clone
        while at >= 0 and step[at].get(word) == state:
            step[at][word] = clone
            at = link[at]
        return clone

    def read(self, word: int) -> int:
        length, link, step = self.length, self.link, self.next
        at = self.last
        known = step[at].get(word)
        if known is not None:
            self.last = self.split(at, word, known)
            return length[self.last]
        new = self.last = len(length)
        length.append(length[at] + 1)
        link.append(0)
        step.append({})
        while at >= 0 and (known := step[at].get(word)) is None:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            link[new] = self.split(at, word, known)
        return length[link[new]]


STRETCH = "anchor long, blank boolean, doc_id long, row long, start int, words binary"


def spans(docs: DataFrame, width: int, bits: np.ndarray) -> DataFrame:
    """The stretches with an anchor that may repeat, as rows STRETCH."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, rows = batch.column(0), batch.column(1)
            for at, words, ends in grouped(batch.column(2).to_pylist()):
                anchor, first, n = stretches(words, ends, width)
                go = met(shared.value, anchor)
                anchor, first, n = anchor[go], first[go], n[go]
                owner = np.searchsorted(ends, first, "right")
                start = first - np.concatenate([[0], ends])[owner]
                held = [b" ".join(words[a:b]) for a, b in zip(first.tolist(), (first + n + width - 1).tolist())]
                doc = ids.take(pa.array(owner + at))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), doc.is_null(), doc, rows.take(pa.array(owner + at)), pa.array(start.astype(np.int32)), pa.array(held, pa.binary())], ["anchor", "blank", "doc_id", "row", "start", "words"])

    return docs.select("doc_id", "row", F.col("text").cast("binary").alias("text")).mapInArrow(run, STRETCH)


def distinct_first(rows: DataFrame) -> DataFrame:
    """Of stretches with the same words the first; each task merges its own before the shuffle."""
    return rows.groupBy("anchor", "words").agg(F.min(F.struct("blank", "doc_id", "row", "start")).alias("first")).select("anchor", "first.*", "words")


def windows_apart(rows: DataFrame, width: int) -> DataFrame:
    """Each window of the stretches as one of its own, with the window's hash as its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for r in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                words = r[4].split()
                codes = rolled(np.fromiter(map(WordHashes.of().__getitem__, words), np.uint64, len(words)), width).view(np.int64).tolist()
                made += [(c, *r[:3], r[3] + k, b" ".join(words[k : k + width])) for k, c in enumerate(codes)]
            columns = [*zip(*made)] or [()] * 6
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "blank", "doc_id", "row", "start", "words"])

    return rows.select("anchor", "blank", "doc_id", "row", "start", "words").mapInArrow(run, STRETCH)


def first_windows(rows: DataFrame, width: int, shards: int) -> DataFrame:
    """(row, start, fresh): of each distinct stretch the windows, by bit from its start, that were not read before in the automaton of its shard."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton, ids = None, Automaton(), {}
        for batch in batches:
            out: list[tuple] = []
            for shard, row, start, words in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    now, automaton, ids = shard, Automaton(), {}
                automaton.restart()
                fresh = 0
                for i, word in enumerate(words.split()):
                    matched = automaton.read(ids.setdefault(word, len(ids)))
                    if i >= width - 1 and matched < width:
                        fresh |= 1 << (i - width + 1)
                if fresh:
                    out.append((row, start, fresh))
            columns = [*zip(*out)] or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64()))], ["row", "start", "fresh"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    order = ["shard", "blank", "doc_id", "row", "start"]
    return dealt.repartition(parts, "shard").sortWithinPartitions(*order).select("shard", "row", "start", "words").mapInArrow(run, "row long, start int, fresh long")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, removed for every row: without the words of windows that start earlier too.

    A window is ``width`` consecutive words (9 to 63 of them, white space
    between); earlier is a smaller id, null last, of rows that share an id the
    one that is stored first, and in one row an earlier start. Windows are judged
    on the input. ``removed`` has the maximal spans (first word, word after the
    last), ``kept_text`` the other words with one space between.

    1. Anchors of all stretches are counted; those that repeat set bits in a
       filter of fixed size. A bit set by chance only costs work.
    2. Stretches that pass it are rows; equal ones become one, with its first
       place. Of an anchor with over HOT different stretches the windows go each
       to the shard of their own hash, so no shard grows with a common phrase.
    3. A shard's stretches are read in order by its automaton; a window whose
       matching statistic is below ``width`` is new there, which makes its first
       place the first of all. All other windows that passed are removed.

    Null text has no words. An empty table gives an empty result; other columns
    are ignored.
    """
    if not ANCHOR < width < 64:
        raise ValueError(f"a window has {ANCHOR + 1} to 63 words")
    source = numbered(df)
    docs = text_rows(source, id_col, text_col, F.col(ROW).alias("row"))
    bits = repeated(docs, width)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = stored(distinct_first(spans(docs, width, bits)), "stretches")
    hot = stored(rows.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot")
    n = hot.count()
    cold = join_sized(rows, hot, "anchor", "left_anti", n)
    apart = distinct_first(windows_apart(join_sized(rows, hot, "anchor", "left_semi", n), width))
    known = stored(first_windows(cold.select(*apart.columns).unionByName(apart), width, max(1, -(-rows.count() // SHARD))), "fresh")
    known = known.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("fresh").alias("fresh"))  # a row has no more of them than words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, starts, fresh = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for at, words, ends in grouped(batch.column(1).to_pylist()):
                anchor, first, n = stretches(words, ends, width)
                go = met(shared.value, anchor)
                edge = np.zeros(len(words) + width + 1, np.int64)  # window starts as steps
                np.add.at(edge, first[go], 1)
                np.add.at(edge, first[go] + n[go], -1)
                gone = np.cumsum(edge) > 0
                begins = np.concatenate([[0], ends])
                for k, begin in enumerate(begins[:-1].tolist()):
                    if starts[at + k]:
                        masks = np.array(fresh[at + k], np.int64)[:, None] >> np.arange(63) & 1
                        r, c = np.nonzero(masks)
                        gone[begin + np.array(starts[at + k], np.int64)[r] + c] = False
                over = np.flatnonzero(gone)
                edge = np.zeros(len(words) + width + 1, np.int64)
                np.add.at(edge, over, 1)
                np.add.at(edge, over + width, -1)
                covered = (np.cumsum(edge) > 0)[: len(words)]
                kept, removed = [], []
                for a, b in zip(begins[:-1].tolist(), ends.tolist()):
                    own = covered[a:b]
                    turn = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
                    spans = [*zip(turn[::2], turn[1::2])]
                    stays = zip([0, *turn[1::2]], [*turn[::2], b - a])
                    kept.append(b" ".join(w for x, y in stays for w in words[a + x : a + y]))
                    removed.append([{"start": x, "stop": y} for x, y in spans])
                sizes = np.diff(begins)
                lost = [sum(s["stop"] - s["start"] for s in x) for x in removed]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(ends)), pa.array(sizes), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                    ["doc_id", "n_words", "n_removed", "kept_text", "removed"],
                )

    whole = docs.join(known.hint("merge"), "row", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "starts", "fresh")
    out = whole.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text binary, removed array<struct<start: int, stop: int>>")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))


def op13_automaton_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, start, array_to_string(w[start:start+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS start FROM d)),
r AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY k ORDER BY doc_id, start) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM r),
k AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) USING (doc_id)),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) a ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN s USING (doc_id)
"""
