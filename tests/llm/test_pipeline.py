"""The whole pipeline against brute force on a table whose verdicts are plain: junk, texts without letters, copies, near copies, long texts."""

import random
import zlib

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from runlens.llm.tokens import tokenizer_path

SIZE = 4096


def rows():
    rng = random.Random(11)
    words = {"en": ["the", "cat", "sat", "with", "hat", "river", "stone", "green", "under", "morning"], "de": ["der", "hund", "und", "die", "katze", "hier", "schnee", "wieder", "morgen", "fluss"]}
    own = lambda lang, n: [rng.choice(words[lang]) + rng.choice(["", "s", "en", "er"]) for _ in range(n)]
    out = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        out.append((i, " ".join(own(lang, rng.randrange(12, 120))), lang, "site"))
    out += [(200 + i, f"A!! B!! C!! ### {i} 7 || $$ !!", "en", "spam") for i in range(60)]
    out += [(300 + i, "12 !! 34 -- 56 " * (i + 1), None, "site") for i in range(5)]
    out += [(400 + i, out[i % 9][1].replace(" ", "  "), "en", "site") for i in range(40)]  # copies but for white space
    base = own("en", 60)
    out += [(500 + i, " ".join(base[:k] + ["other"] + base[k + 1 :]), "en", "site") for i, k in enumerate((0, 59, 0, 1))]  # one word apart, at an end
    out += [(None, out[3][1], "de", "site"), (None, " ".join(own("de", 40)), "de", "site"), (7, " ".join(own("de", 30)), "de", "site"), out[5], out[5]]
    out += [(600, " ".join(own("en", 9000)), "en", "site")]
    return out


def sets(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept():
    """Rows that stay, by rule: no junk, letters, first of equal texts, first of each near component."""
    stay = [r for r in rows() if r[3] != "spam" and any(c.isalpha() for c in r[1])]
    rank = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for r in sorted(stay, key=rank):
        first.setdefault(" ".join(r[1].split()), r)
    stay, grams = [*first.values()], [sets(r[1]) for r in first.values()]
    label = [*range(len(stay))]
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [min((stay[i] for i in range(len(stay)) if label[i] == k), key=rank) for k in set(label)]


def test_run_against_brute_force(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[3] != "spam"), 0) for r in rows()[: 220 : 2]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for d, text, *_ in kept():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k // SIZE, k, len(ids[k : k + SIZE]), zlib.crc32(ids[k : k + SIZE].tobytes())) for k in range(0, len(ids), SIZE)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= SIZE
    assert len(by) <= -(-sum(r.length for r in got) // SIZE) + 1
