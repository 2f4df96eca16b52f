"""Language ID with more languages than a 64-bit mask holds, one of them much larger than the others."""

import random

from pyspark.sql import functions as F

from runlens.llm import langid

LANGS, COMMON = 70, [f"{a}{b}{c}" for a in "aeiou" for b in "mnr" for c in "st"]


def rows(spark, per=8, big=300):
    rng = random.Random(5)
    letters = "bcdfghjklpqvwxyz"
    own = [["".join(rng.choices(letters, k=5)) for _ in range(12)] for _ in range(LANGS)]
    large = ["".join(rng.choices("stuvwxyz", k=5)) for _ in range(600)]
    text = lambda i: " ".join(rng.sample(COMMON, 20) + rng.choices(own[i] + (large if i == 0 else []), k=20))
    out = [(f"l{i:02}", text(i)) for i in range(LANGS) for _ in range(big if i == 0 else per)]
    return spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(out)], "doc_id long, text string, lang string")


def test_every_language_is_learned_and_kept(spark):
    docs = rows(spark).cache()
    small = docs.where("lang <> 'l00'")
    told = langid.language_ids(docs).join(small, "doc_id")
    wrong, n = told.where("lang_pred <> lang").count(), small.count()
    assert n == (LANGS - 1) * 8 and wrong <= n // 100
    assert langid.keep_identified(docs).count() == docs.count()


def test_text_of_no_language_is_dropped(spark):
    docs = rows(spark)
    odd = spark.createDataFrame([(10**6, "ééé ççç ñññ " * 9, None)], docs.schema)
    assert langid.keep_identified(docs.unionByName(odd)).where(F.col("doc_id") == 10**6).count() == 0
