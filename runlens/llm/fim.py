"""Fill-in-middle: texts cut at two members of a boundary set held in array, bitmap and run containers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, table

#: Places in a container, and the most members that an array container holds.
SPAN, ARRAY = 1 << 16, 4096
#: Markers of prefix, suffix and middle: a text that contains one stays plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bits set in each byte, and the place in a byte of its k-th set bit.
ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)
NTH = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64)
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@dataclass(frozen=True)
class ArrayPlaces:
    """Few members: their places, in order."""

    places: np.ndarray

    def select(self, k: int) -> int:
        return int(self.places[k])


@dataclass(frozen=True)
class BitPlaces:
    """Many scattered members: a bit for each place, and the members before each byte."""

    bits: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return 8 * at + int(NTH[self.bits[at], k - self.before[at]])


@dataclass(frozen=True)
class RunPlaces:
    """Long runs of members: where each starts, and the members before it."""

    starts: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[at] + k - self.before[at])


def container(mask: np.ndarray) -> tuple[ArrayPlaces | BitPlaces | RunPlaces, int]:
    """The smallest container for the members of ``mask``, a place each, and how many there are."""
    n = int(np.count_nonzero(mask))
    step = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    starts, stops = step[::2], step[1::2]
    if 4 * len(starts) <= min(2 * n, SPAN // 8):
        return RunPlaces(starts, np.concatenate([[0], np.cumsum(stops - starts)[:-1]])), n
    if n <= ARRAY:
        return ArrayPlaces(np.flatnonzero(mask).astype(np.uint16)), n
    bits = np.packbits(mask, bitorder="little")
    return BitPlaces(bits, np.concatenate([[0], np.cumsum(ONES[bits])[:-1]])), n


@dataclass(frozen=True)
class BoundarySet:
    """Byte offsets where a text may be cut: a container for each SPAN of them, and the members before each container."""

    containers: list
    before: np.ndarray
    size: int

    @classmethod
    def of(cls, mask: np.ndarray) -> BoundarySet:
        made = [container(mask[at : at + SPAN]) for at in range(0, len(mask), SPAN)]
        upto = np.cumsum([0, *(n for _, n in made)])
        return cls([c for c, _ in made], upto[:-1], int(upto[-1]))

    def select(self, k: int) -> int:
        """The k-th member, from 0: the container by its cumulative cardinality, then the place in it."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return SPAN * at + self.containers[at].select(k - int(self.before[at]))


def boundaries(text: bytes, unit: str) -> np.ndarray:
    """A mask of the byte offsets 0 to len(text): where a character, word or line of UTF-8 begins, and the end."""
    raw = np.frombuffer(text, np.uint8)
    mask = np.ones(len(raw) + 1, bool)
    if unit == "char":
        mask[:-1] = raw & 0xC0 != 0x80
    elif unit == "word":
        mask[1:-1] = SPACES[raw[:-1]] & ~SPACES[raw[1:]]
    elif unit == "line":
        mask[1:-1] = raw[:-1] == 10
    else:
        raise ValueError(f"no unit {unit!r}")
    return mask


@dataclass(frozen=True)
class Rule:
    """Seed of the hashes; of each 100 documents how many are transformed, and of those how many with the suffix first; the unit that is not cut."""

    seed: int = 1
    rate: int = 90
    spm: int = 20
    unit: str = "char"

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers of 32 bits from the hash of seed and id."""
        found = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(found[i : i + 4], "big") for i in (0, 4, 8, 12)]

    def apply(self, doc_id: int | None, text: bytes) -> tuple[str, bytes, int, int | None, int | None]:
        """(form, output, units, units of the prefix, units of the middle)."""
        cuts = BoundarySet.of(boundaries(text, self.unit))
        n = cuts.size - 1
        a, b, chance, kind = self.draws(doc_id)
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or chance % 100 >= self.rate:
            return "plain", text, n, None, None
        low, high = sorted((a % (n + 1), b % (n + 1)))
        i, j = cuts.select(low), cuts.select(high)
        if kind % 100 < self.spm:
            return "spm", b"".join([SUFFIX, text[j:], PREFIX, text[:i], MIDDLE, text[i:j]]), n, low, high - low
        return "psm", b"".join([PREFIX, text[:i], SUFFIX, text[j:], MIDDLE, text[i:j]]), n, low, high - low


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row, from its whole text.

    Lengths are in the rule's units; they are null for a plain text. Null text
    counts as empty, and an empty text is plain. Which cuts a row gets hangs on
    its id alone, so repeated rows are cut alike; a null id hashes as the empty
    string. Other columns are ignored. An empty table gives an empty result.
    """
    importable(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [rule.apply(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            form, output, n, prefix, middle = zip(*made) if made else ((),) * 5
            longs = [pa.array(c, pa.int64()) for c in (n, prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), longs[0], pa.array(form, pa.string()), *longs[1:], pa.array(output, pa.binary())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = docs.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. The markers cut it in three: no text has one, nor can text and marker make one."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


#: The hex digits of a group, each times its power of 16, give its number.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
g AS (SELECT doc_id, t, length(t) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || h[i:i+7])::BIGINT) AS h FROM d),
c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_slice(t, 1, a) AS pre, array_slice(t, a + 1, b) AS mid, array_slice(t, b + 1, n) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
