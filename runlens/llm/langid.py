"""Language ID: bit-sliced Bloom filters that return, for an n-gram, the languages that have it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, chosen, numbered, sliced, stored, table, text_rows

#: Training texts for each language (on average, at most), filter bits as a power of two, hash functions.
SAMPLE, BITS, HASHES = 1500, 22, 2
#: Filter positions that one row of the written filters has, as a power of two.
CHUNK = 12
#: A language has an n-gram if its share there is at least this part of the largest share in any language.
SHARE = 0.35
#: Characters of texts taken together.
TOGETHER = 1 << 19


class Letters:
    """Code points that are letters."""

    held: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls.held is None:
            cls.held = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.held


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit codes of the trigrams of all texts, text number of each, whether each text has a letter).

    Lower-cased; whatever isn't a letter counts as a space; trigrams whose middle is a letter.
    """
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 2 for t in lowered), np.int64, len(texts))
    codes = np.frombuffer(("".join(f" {t} " for t in lowered)).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = Letters.table()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    middle = np.flatnonzero(letter)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)[middle]
    found = codes[middle - 1] << np.uint64(42) | codes[middle] << np.uint64(21) | codes[middle + 1]
    has = np.zeros(len(texts), bool)
    has[owner] = True
    return found, owner, has


def together(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about TOGETHER characters, with the place of the first."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def mixed(codes: np.ndarray, k: int) -> np.ndarray:
    x = codes * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[k])
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)


def mask_type(languages: int) -> type:
    """The narrowest integer with a bit for each language, of 64 at most."""
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if languages <= 8 * np.dtype(t).itemsize or t is np.uint64)


@dataclass
class Filters:
    """``bits``: for each 64 languages and filter position, a mask of languages; ``false``: each language's rate of false positives."""

    languages: list[str]
    bits: np.ndarray
    false: np.ndarray

    @classmethod
    def of(cls, languages: list[str], bits: np.ndarray) -> Filters:
        bits = bits.astype(mask_type(len(languages)), copy=False)
        filled = np.array([np.count_nonzero(bits[i // 64] >> bits.dtype.type(i % 64) & bits.dtype.type(1)) for i in range(len(languages))])
        return cls(languages, bits, (filled / (1 << BITS)) ** HASHES)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """For each text the language, its share of all languages' counts, and the share of the text's n-grams that it has."""
        codes, owner, has = grams(texts)
        places = [mixed(codes, k) for k in range(HASHES)]
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        hits = np.zeros((len(texts), max(1, len(self.languages))))
        for w, plane in enumerate(self.bits):
            mask = plane[places[0]]
            for at in places[1:]:
                mask &= plane[at]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits[:, i] = np.bincount(owner[(mask >> mask.dtype.type(i % 64) & mask.dtype.type(1)).astype(bool)], minlength=len(texts))
        real = np.maximum(0, (hits - total[:, None] * self.false) / (1 - self.false)) if self.languages else hits
        best, sums = real.argmax(1), real.sum(1)
        score = np.divide(real.max(1), sums, out=np.zeros(len(texts)), where=sums > 0)
        held = np.divide(real.max(1), total, out=np.zeros(len(texts)), where=total > 0)
        names = [self.languages[b] if h and self.languages else "und" for b, h in zip(best.tolist(), has.tolist())]
        return names, *([float(s) if h and self.languages else 0.0 for s, h in zip(x, has.tolist())] for x in (score, held))


def fit(train: DataFrame) -> Filters:
    """Filters from rows (text, lang): trigram counts of at most about SAMPLE texts a language, chosen by a hash of doc_id.

    Every language is learned with all n-grams of its sample, but for those
    whose share there is that of one or two in the language with the most text.
    Counts, masks and filters are made by tasks; the driver gets a count for
    each language and the finished filters, 32 MB for each 64 languages
    whatever the texts (for up to 8, 16 or 32 languages an eighth, a quarter, a half).
    """
    counts = train.groupBy("lang").count().collect()
    languages = sorted(r.lang for r in counts)
    if not languages:
        return Filters([], np.zeros((1, 1 << BITS), np.uint64), np.zeros(0))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, SAMPLE / r["count"]))))
    sample = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, lang = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for at, some in together(texts):
                codes, owner, _ = grams(some)
                for name in set(lang[at : at + len(some)]):
                    own = lang[at : at + len(some)] == name
                    code, n = np.unique(codes[own[owner]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"])

    each = sample.select("text", "lang").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    each = stored(each, "grams")
    sums = each.groupBy("lang").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    largest = max((r.n for r in sums), default=1)
    learned = [(r.lang, languages.index(r.lang), r.n, min(r.most, 2 * r.n // largest + 1)) for r in sums]
    of = train.sparkSession.createDataFrame(learned, "lang string, at int, total long, least long")
    top = each.join(F.broadcast(of), "lang").where(F.col("n") >= F.col("least")).select("code", "at", (F.col("n") / F.col("total")).alias("share"))
    held = top.groupBy("code").agg(F.max("share").alias("most"), F.collect_list(F.struct("at", "share")).alias("by"))  # no more than languages
    held = held.select("code", F.transform(F.filter("by", lambda x: x["share"] >= SHARE * F.col("most")), lambda x: x["at"]).alias("has"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, many = batch.column(0).to_numpy().astype(np.int64).view(np.uint64), np.diff(batch.column(1).offsets.to_numpy())
            at = batch.column(1).flatten().to_numpy().astype(np.int64)
            for k in range(HASHES):
                to = np.repeat(mixed(codes, k).astype(np.int64), many)
                bit = (np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at // 64, to >> CHUNK, to & ((1 << CHUNK) - 1), bit)], ["plane", "chunk", "cell", "bit"])

    def chunk(group: pa.Table) -> pa.Table:
        out = np.zeros(1 << CHUNK, kind)
        np.bitwise_or.at(out, group["cell"].to_numpy(), group["bit"].to_numpy().view(np.uint64).astype(kind))
        return pa.table({"plane": group["plane"][:1].combine_chunks(), "chunk": group["chunk"][:1].combine_chunks(), "words": pa.array([out.tobytes()], pa.binary())})

    kind = mask_type(len(languages))
    bits = np.zeros((-(-len(languages) // 64), 1 << (BITS - CHUNK), 1 << CHUNK), kind)
    cells = held.mapInArrow(place, "plane long, chunk long, cell long, bit long")
    for r in stored(cells.groupBy("plane", "chunk").applyInArrow(chunk, "plane long, chunk long, words binary"), "filters").toLocalIterator():
        bits[r.plane, r.chunk] = np.frombuffer(r.words, kind)
    return Filters.of(languages, bits.reshape(len(bits), -1))


def identify(df: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, held: for every row, from its whole text.

    ``und`` and 0.0 for a text that is null or has no letter. The score is the
    winning language's share of all corrected counts; a tie goes to the first
    language in alphabetical order. Held is the share of the text's n-grams that the winning
    language has, which other languages don't change. Repeated rows and null ids
    are kept.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names: list[str] = []
            scores: list[float] = []
            shares: list[float] = []
            for _, some in together(batch.column(1).to_pylist()):
                n, s, h = shared.value.predict(some)
                names += n
                scores += s
                shares += h
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score", "held"])

    return text_rows(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, held double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame) -> Filters:
    return fit(text_rows(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True))))


def language_ids(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    return identify(docs, filters or learn(docs)).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents"))


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is told: not ``und``, and with at least ``least`` of its n-grams held.

    Each row by its own text; its id may be null or occur twice.
    """
    rows = numbered(docs)
    told = identify(rows, learn(rows), ROW).where((F.col("lang_pred") != "und") & (F.col("held") >= least))
    return chosen(rows, told.withColumnRenamed("doc_id", ROW))
