"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, chosen, join_sized, numbered, sliced, stored, table, text_rows
from .graph import components

#: Shingles in a block of documents on average, and the fewest and most documents for that.
BLOCK, FEWEST, MOST = 1 << 20, 8, 256
#: N-grams that each task proposes as frequent, and the power of two of buckets for their counts.
PROPOSED, BUCKETS = 1 << 16, 24
#: Hashes counted together in a task, columns of the incidence matrix multiplied together.
TOGETHER, COLUMNS = 1 << 20, 4096
#: Rows in a task that multiplies blocks, on average at most.
DEALT = 4096
PRIME = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """64-bit hashes of words."""

    held: WordHashes | None = None

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    @classmethod
    def of(cls) -> WordHashes:
        if cls.held is None or len(cls.held) > 1 << 17:
            cls.held = cls()
        return cls.held


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles (A-Z lowered, words between white space); the whole sequence if it has fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([*map(WordHashes.of().__getitem__, words)], np.uint64)
    wide = min(width, len(words))
    out = np.zeros(len(words) - wide + 1, np.uint64)
    for k in range(wide):
        out = out * np.uint64(PRIME) + h[k : len(h) - wide + 1 + k]
    out ^= np.uint64(wide)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def first_pass(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document (doc_id, n, sig), and rows (hash, n) of frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "sig", "hash"]
        held: list[np.ndarray] = []
        met: set[bytes] = set()
        size, seen, times = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            got, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            both = np.concatenate([got[n > 1], seen])
            keys, at = np.unique(both, return_inverse=True)
            n = np.bincount(at, np.concatenate([n[n > 1], times]), len(keys)).astype(np.int64)
            top = np.argsort(-n, kind="stable")[: 4 * PROPOSED]
            return keys[top], n[top]

        for batch in sliced(batches):
            n, sigs = [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                sigs.append(signature(s))
                if sigs[-1] not in met:  # a copy adds nothing
                    met.add(sigs[-1])
                    held.append(s)
                    size += len(s)
                if size > TOGETHER:
                    seen, times = merged()
                    held, size, met = [], 0, set()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.nulls(len(n), pa.int64())], names)
        seen, times = (x[:PROPOSED] for x in merged())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.int64()), pa.array(times), pa.nulls(len(seen), pa.binary()), pa.array(seen.view(np.int64))], names)

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, hash long")


def count_levels(frequent: DataFrame) -> np.ndarray:
    """A byte for each of 2**BUCKETS buckets of hashes: the largest count in it on a logarithmic scale. Its size doesn't depend on the input."""
    low = BUCKETS - 10
    cells = frequent.select(
        F.expr(f"cast((hash & {(1 << BUCKETS) - 1}) >> {low} as int)").alias("chunk"), F.expr(f"cast(hash & {(1 << low) - 1} as int)").alias("cell"), F.least(F.lit(255), F.ceil(F.log2("n") * 8)).cast("int").alias("level")
    )

    def run(group: pa.Table) -> pa.Table:
        out = np.zeros(1 << low, np.uint8)
        np.maximum.at(out, group["cell"].to_numpy(), group["level"].to_numpy().astype(np.uint8))
        return pa.table({"chunk": group["chunk"][:1].combine_chunks(), "levels": pa.array([out.tobytes()], pa.binary())})

    whole = np.zeros((1 << 10, 1 << low), np.uint8)
    for r in cells.groupBy("chunk").applyInArrow(run, "chunk int, levels binary").collect():  # 1024 rows at most
        whole[r.chunk] = np.frombuffer(r.levels, np.uint8)
    return whole.reshape(-1)


def prefixes(docs: DataFrame, width: int, share: tuple[int, int], levels: np.ndarray) -> DataFrame:
    """(doc_id, sig, size, prefix): the rarest shingles of each document, rarest first, so many that two documents that link share one."""
    ranked = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, mask = ranked.value, np.uint64((1 << BUCKETS) - 1)
        for batch in sliced(batches):
            sigs, flat, ends, sizes = [], [], [0], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, width)
                sigs.append(signature(s))
                sizes.append(len(s))
                many = len(s) + (-len(s) * share[0] // share[1]) + 1 if len(s) else 0
                s = s[np.argsort(rank[s & mask], kind="stable")]
                flat.append(s[:many].view(np.int64))
                ends.append(ends[-1] + many)
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), arrays], ["doc_id", "sig", "size", "prefix"])

    return docs.mapInArrow(run, "doc_id long, sig binary, size long, prefix array<long>")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, words): whole texts, compressed; a text takes a third of the room that the hashes of its shingles would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            words = [press.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["doc_id", "words"])

    return docs.mapInArrow(run, "doc_id long, words binary")


def linked(ids: list[int], docs: list[np.ndarray], first: np.ndarray, labels: list[int], share: tuple[int, int]) -> list[tuple[int, int]]:
    """Spanning edges of the links between the documents of two blocks (``first`` tells them apart), or within one block; none between those that share a label.

    Overlaps are summed over column chunks of the incidence matrix; a pair is
    dropped where its sizes alone rule it out.
    """
    sizes = np.array([*map(len, docs)], np.int64)
    _, column, many = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(docs)), sizes)
    keep = many[column] > 1
    row, (_, column) = row[keep], np.unique(column[keep], return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    two = not first.all()
    left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if two else (np.arange(len(docs)),) * 2
    overlap = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(docs), min(COLUMNS, width - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        overlap += (part[left] @ part[right].T).astype(np.int64)
    small, large = np.minimum(sizes[left][:, None], sizes[right]), np.maximum(sizes[left][:, None], sizes[right])
    total = sizes[left][:, None] + sizes[right] - overlap
    p, q = share
    a, b = np.nonzero((small * q >= large * p) & (overlap * q >= total * p) & (overlap > 0))
    held: dict[int, int] = {}
    root = [held.setdefault(x, i) for i, x in enumerate(labels)]

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(left[a].tolist(), right[b].tolist()):
        i, j = top(x), top(y)
        if i != j:
            root[max(i, j)] = min(i, j)
            out.append((ids[x], ids[y]))
    return out


def block_links(docs: DataFrame, dealt: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """(a, b), stored: spanning edges of the links in each block pair (b1, b2) of the stored table ``dealt`` (doc_id, b1, b2, first, label): rows of one label are known to be one component."""
    who = stored(dealt.select("doc_id").distinct(), "who")
    rows = packed(join_sized(docs, who, "doc_id", "left_semi", who.count()))
    n = dealt.count()
    rows = join_sized(rows, dealt, "doc_id", "inner", n).select("b1", "b2", "first", "doc_id", "label", "words")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // DEALT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        now, ids, sets, first, labels = None, [], [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            out = linked(ids, sets, np.array(first), labels, share) if len(ids) > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        for batch in batches:
            for b1, b2, one, doc, label, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (b1, b2) != now:
                    yield from close()
                    now, ids, sets, first, labels = (b1, b2), [], [], [], []
                ids.append(doc)
                sets.append(shingles(press.decompress(words).decode("utf-8", "surrogatepass"), width))
                first.append(one)
                labels.append(label)
        yield from close()

    return stored(rows.repartition(parts, "b1", "b2").sortWithinPartitions("b1", "b2").mapInArrow(run, "a long, b long"), "links")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: components of links with Jaccard similarity >= share.

    1. Rows with equal sets form a class, which its smallest id stands for.
    2. Of each representative only its rarest shingles, as many as the similarity
       leaves open, become columns; a link has a column in common. The order is by
       the counts of frequent shingles over the whole corpus; any order is exact.
    3. Representatives are dealt to blocks by their most common column and their
       size, large columns to several blocks, twice over and in two ways. Each block
       is multiplied as a sparse matrix over all shingles, and spanning edges of
       links come out, so pairs within a group are never emitted. This joins most
       of a large group into one component.
    4. Where two blocks meet in a column, the rows in it that could link are
       multiplied as well: those not yet in one component, whose sizes allow a link
       and for whom enough shingles follow the column in the order of step 2.
    5. Components of all edges, then back from representatives to rows.

    Null, empty or blank text has an empty set, and no links. Texts with fewer
    words than ``width`` have one shingle, the whole sequence. Rows that share an
    id count as one node with the links of all of them; a row with a null id adds
    no links, and has the component of the rows with its set, null if all of
    them lack an id. An empty table gives an empty result.
    """
    p, q = share
    docs = text_rows(df, id_col, text_col)
    base = stored(first_pass(docs, width), "first")
    rows = base.where("sig is not null").select("doc_id", "n", "sig")
    levels = count_levels(base.where("hash is not null").groupBy("hash").agg(F.sum("n").alias("n")))
    classes = stored(rows.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("class_id")), "classes")
    others = stored(rows.where("n > 0").join(classes.hint("merge"), "sig").where("doc_id <> class_id").select("doc_id", "sig"), "others")
    prefix = prefixes(docs.where("doc_id is not null"), width, share, levels)
    prefix = stored(join_sized(prefix, others, ["doc_id", "sig"], "left_anti", others.count()).select("doc_id", "size", "prefix"), "prefixes")
    cells = prefix.select("doc_id", "size", F.posexplode("prefix").alias("at", "col")).select("doc_id", "size", "col", (F.col("size") - F.col("at")).alias("rest"))
    shared = cells.groupBy("col").agg(F.count("*").alias("m")).where("m > 1")
    cells = stored(cells.join(shared.hint("merge"), "col"), "cells")
    home = cells.groupBy("doc_id", "size").agg(F.max(F.struct("m", "col")).alias("home"))  # rows that share an id may differ in size
    level = F.floor(F.log(F.col("size").cast("double")) / log(q / p)).cast("int")  # linked documents are at most one level apart
    room = F.least(F.lit(MOST), F.greatest(F.lit(FEWEST), F.floor(BLOCK / F.pow(F.lit(q / p), F.col("level")))))
    block = lambda seed: F.xxhash64("home.col", "level", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("parts")), F.lit(seed))
    members = home.withColumn("level", level).withColumn("parts", F.ceil(F.col("home.m") / room))
    members = stored(members.select("doc_id", "size", "level", "parts", block(0).alias("block"), block(1).alias("again")), "members")
    own = members.select("doc_id", "block").union(members.where("parts > 1").select("doc_id", "again"))
    full = own.groupBy("block").count().where("count > 1").select("block")
    own = stored(own.join(full.hint("merge"), "block").select("doc_id", F.col("block").alias("b1"), F.col("block").alias("b2"), F.lit(True).alias("first"), F.col("doc_id").alias("label")), "own")
    within = block_links(docs, own, width, share)
    labels = components(within).withColumnsRenamed({"node": "doc_id", "component": "label"})
    members = stored(members.join(labels.hint("merge"), "doc_id", "left").select("doc_id", "size", "level", "block", F.coalesce("label", "doc_id").alias("label")), "labelled")
    cells = stored(cells.select("col", "doc_id", "size", "rest").join(members.hint("merge"), ["doc_id", "size"]), "placed")
    seen = cells.groupBy("col", F.col("block").alias("other"), F.col("level").alias("near")).agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.max("rest").alias("left"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    could = (F.col("block") != F.col("other")) & (F.abs(F.col("level") - F.col("near")) <= 1) & ((F.col("label") != F.col("low")) | (F.col("label") != F.col("high")))
    could &= (F.col("size") * q >= F.col("least") * p) & (F.col("most") * q >= F.col("size") * p)
    could &= F.least("rest", "left") * (p + q) >= (F.col("size") + F.col("least")) * p
    meets = cells.join(stored(seen, "seen").hint("merge"), "col").where(could)
    meets = stored(meets.select("doc_id", "label", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), (F.col("block") < F.col("other")).alias("first")).distinct(), "meets")
    edges = within.union(block_links(docs, meets, width, share))
    tops = components(edges).withColumnRenamed("node", "class_id")
    classes = stored(classes.join(tops.hint("merge"), "class_id", "left").select("sig", F.coalesce("component", "class_id").alias("component_id")), "components")
    return rows.join(classes.hint("merge"), "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, share=(85, 100))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def keep_first_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns: of each near-duplicate component the row with the smallest id.

    Rows are nodes of their own, so one with a null id (after all others) or
    with the id of another row takes part by its own text. Of rows with the same
    id and text one stays, but all rows without words do: they have no links.
    """
    rows = numbered(docs)
    parts = jaccard_components(rows, ROW).select(F.col("doc_id").alias(ROW), "component_id")
    ids = rows.select(ROW, F.col("doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", ROW)).alias("first")
    return chosen(rows, parts.join(ids.hint("merge"), ROW).groupBy("component_id").agg(first).select(f"first.{ROW}"))
