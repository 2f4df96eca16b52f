"""Pipeline stages against brute force, on rows with null ids, repeated rows and ids with two texts."""

import random
import re

import corpus_pipeline
import pytest
from runlens.llm import common, dedup, jaccard, langid, quality

WORDS = [f"word{i}" for i in range(40)]
NEAR = [" ".join(WORDS[:k] + ["other"] + WORDS[k + 1 :]) for k in (39, 0, 38)]
TEXTS = ["the cat and the hat sat", "der hund und die katze hier", "A!! B!! C!! ### 7", " ".join(WORDS), *NEAR, "one two three", "the cat  and the hat sat"]
ROWS = [(i // 2 if i % 7 else None, TEXTS[i * 5 % len(TEXTS)]) for i in range(36)]
ROWS += [*ROWS[:8], (1, TEXTS[2]), (1, TEXTS[0]), (900, TEXTS[2]), (900, "a text of its own that nobody else has"), (None, "lone words with no id at all")]


def docs(spark):
    rows = [(d, t, ["en", "de", "en"][k % 3], "s", n) for n, (d, t) in enumerate(ROWS) for k in [TEXTS.index(t) if t in TEXTS else 0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int").repartition(3, "row")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def first_of(groups):
    """Of each group's rows (id, text) the one with the least id, null last; which of equal texts' spellings stays is open."""
    return [min((d is None, d or 0) for d, _ in g) for g in groups]


def held(df):
    return [(d is None, d or 0) for d, _ in pairs(df)]


def test_exact_stage_keeps_one_row_of_each_text(spark):
    groups = {}
    for d, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append((d, t))
    out = dedup.keep_first(docs(spark))
    assert sorted(held(out)) == sorted(first_of(groups.values()))
    assert out.columns == docs(spark).columns
    assert sorted(re.sub(r"\s+", " ", t) for _, t in pairs(out)) == sorted(groups)


def test_near_stage_keeps_one_row_of_each_component(spark):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.lower().split() for _, t in ROWS)]
    label = [*range(len(ROWS))]
    for _ in ROWS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    groups = [[ROWS[i] for i in range(len(ROWS)) if label[i] == k] for k in set(label)]
    assert max(len({t for _, t in g}) for g in groups) > 2
    assert sorted(held(jaccard.keep_first_of_each(docs(spark)))) == sorted(first_of(groups))


def test_quality_stage_judges_each_row(spark):
    more = spark.createDataFrame([(2000 + i, TEXTS[2] + f" {i}" if i % 3 == 0 else f"plain words in a line {i}", "en", "s", 0) for i in range(90)], docs(spark).schema)
    labels = spark.createDataFrame([(2000 + i, int(i % 3 != 0)) for i in range(0, 90, 2)], "doc_id long, quality int")
    out = quality.keep_accepted(docs(spark).unionByName(more), labels).where("doc_id < 2000 or doc_id is null")
    assert pairs(out) == sorted(((d, t) for d, t in ROWS if t != TEXTS[2]), key=str)


def test_language_stage_judges_each_row(spark):
    blank = spark.createDataFrame([(1, "12 !!", None, "s", 0), (None, None, None, "s", 0), (None, TEXTS[1], None, "s", 0)], docs(spark).schema)
    out = langid.keep_identified(docs(spark).where("doc_id is null or doc_id < 900").unionByName(blank))
    assert {t for _, t in pairs(out)} >= {TEXTS[0], TEXTS[1]} and "12 !!" not in {t for _, t in pairs(out)}
    told = [(d, t) for d, t in [*ROWS, (None, TEXTS[1])] if t in (TEXTS[0], TEXTS[1])]
    assert [p for p in pairs(out) if p[1] in (TEXTS[0], TEXTS[1])] == sorted(told, key=str)


def test_stages_take_each_others_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rng, words = random.Random(1), f"{ROWS[-1][1]} {TEXTS[3]}".split()
    known = spark.createDataFrame([(3000 + i, " ".join(rng.sample(words, 20)), "en", "s", 0) for i in range(40)], docs(spark).schema)  # texts that have the lone row's words
    out = jaccard.keep_first_of_each(dedup.keep_first(langid.keep_identified(quality.keep_accepted(docs(spark).unionByName(known), labels))))
    assert "lone words with no id at all" in {t for _, t in pairs(out)}
    assert len(corpus_pipeline.STAGES) == 5


def test_rows_of_files_are_numbered_without_a_copy(spark, tmp_path, monkeypatch):
    docs(spark).repartition(3).write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    monkeypatch.setattr(common, "stored", lambda *_: pytest.fail("a copy"))
    first = {(r.row, r[common.ROW]) for r in common.numbered(read).collect()}
    assert len(first) == len({n for _, n in first}) == len(ROWS)
    assert {(r.row, r[common.ROW]) for r in common.numbered(read.select("row", "text")).repartition(2).collect()} == first


def test_rows_given_twice_have_numbers_of_their_own(spark, tmp_path):
    docs(spark).where("row < 2").repartition(2).write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    for twice in (read.selectExpr("*", "explode(array(1, 2)) AS k"), spark.read.parquet(f"{tmp_path}/d", f"{tmp_path}/d")):
        assert common.numbered(twice).select(common.ROW).distinct().count() == 4
        assert dedup.keep_first(twice).count() == jaccard.keep_first_of_each(twice).count() == 2


@pytest.mark.parametrize("bitmaps", [0, 1 << 14])
def test_chosen_rows_by_bitmap_and_by_join(spark, tmp_path, monkeypatch, bitmaps):
    monkeypatch.setattr(common, "BITMAPS", bitmaps)
    spark.range(100_000).selectExpr("id", "'x' AS text").repartition(3).write.parquet(f"{tmp_path}/d")
    rows = common.numbered(spark.read.parquet(f"{tmp_path}/d"))
    for rule in ("id % 7 = 3", "id < 40000", "id = 99999", "id < 0", "true"):
        out = common.chosen(rows, rows.where(rule))
        assert out.columns == ["id", "text"]
        want = spark.range(100_000).where(rule)
        assert out.count() == want.count() and out.select("id").exceptAll(want).isEmpty()


def test_stages_on_an_empty_table_and_clashing_names(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for df in (docs(spark).limit(0), docs(spark).selectExpr("doc_id", "text", "lang", "source", "row", "1 AS h", "'x' AS component_id", "2.0 AS quality", "3 AS n", "4 AS _metadata")):
        for stage in (lambda d: quality.keep_accepted(d, labels), langid.keep_identified, dedup.keep_first, jaccard.keep_first_of_each):
            out = stage(df)
            assert out.columns == df.columns and out.count() <= df.count()
