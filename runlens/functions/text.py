"""Column functions over answers, messages and page text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers that a model reply may hold, removed in this order.
MARKERS = ["**", "$\\boxed{", "}$", "\\$", "$\\text{", "$", "\\mathrm{", "\\{", "\\text", "\\(", "\\mathbf{", "{", "\\boxed"]
#: Phrases that accept a plan.
ACCEPT = [
    "accept", "accepted", "acept", "run", "execute plan", "execute", "looks good", "do it", "accept plan", "accpt", "run plan", "sounds good",
    "i don't know. use your best judgment.", "i don't know, you figure it out, don't ask me again.",
]
#: Words that approve or deny an action.
APPROVE, DENY = ["accept", "yes", "y"], ["deny", "no", "n"]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: What Python reads as a float: digits may be parted by single underscores, white space may stand around.
FLOAT = r"(?Ui)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != ""))


def normalised(c: Column) -> Column:
    """Lower-cased, with even spacing after commas and no closing mark."""
    out = F.regexp_replace(F.lower(strip(c)), ",", ", ")
    return F.regexp_replace(strip(F.regexp_replace(out, r"(?U)\s+", " ")), r"[.!?]+$", "")


def f1(a: Column, b: Column) -> Column:
    """F1 of two token sets; 0 where they share nothing."""
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)


def score_exact(gold: Column, pred: Column) -> Column:
    return (strip(gold) == strip(pred)).cast("double")


def score_token_f1(gold: Column, pred: Column) -> Column:
    return let(F.struct(tokens(gold).alias("g"), tokens(pred).alias("p")), lambda t: f1(t["g"], t["p"]))


def score_normalised(gold: Column, pred: Column) -> Column:
    return ((normalised(gold) == normalised(pred)) & (normalised(gold) != "")).cast("double")


def clean_response(c: Column) -> Column:
    return reduce(lambda out, m: F.replace(out, F.lit(m), F.lit("")), MARKERS, c)


def clean_number(c: Column) -> Column:
    """Number in a text without units; a comma is a decimal point; null if it isn't one."""
    bare = reduce(lambda out, m: F.replace(out, F.lit(m), F.lit("")), ["$", "%", "sqft", " square kilometers"], c)
    bare = strip(F.replace(bare, F.lit(","), F.lit(".")))
    return let(bare, lambda b: F.when(b.rlike(NUMBER), b.cast("double")))


def score_number(gold: Column, pred: Column) -> Column:
    """1 - ln(larger / smaller), at least 0; zeros count as 1e-4, other signs score 0; null if either is."""
    small = lambda x: F.when(x == 0, 1e-4).otherwise(x)

    def score(x: Column) -> Column:
        gold, pred, g, p = x["gold"], x["pred"], small(x["gold"]), small(x["pred"])
        return F.when(gold.isNull() | pred.isNull(), None).when((gold == 0) & (pred == 0), 1.0).when(g * p <= 0, 0.0).when(g < 0, F.when(g == p, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.ln(F.greatest(g, p) / F.least(g, p))))

    return let(F.struct(gold.alias("gold"), pred.alias("pred")), score)


def python_float(x: Column) -> Column:
    """A double as Python prints it: 330.0, 12345678.0, 1e+16, 1e-05, inf, nan."""

    def scientific(j: Column) -> Column:
        part = lambda i: F.regexp_extract(j, r"^(-?)(\d)\.(\d+)E(-?\d+)$", i)
        exp, more = part(4).cast("int"), F.when(part(3) == "0", "").otherwise(part(3))
        digits = F.concat(part(2), more)
        whole = F.concat(part(1), F.substring(F.rpad(digits, exp + 1, "0"), F.lit(1), exp + 1), F.lit("."), F.when(F.length(digits) > exp + 1, F.substring(digits, exp + 2, F.lit(400))).otherwise("0"))
        power = F.concat(F.when(exp < 0, "-").otherwise("+"), F.when(F.abs(exp) < 10, "0").otherwise(""), F.abs(exp).cast("string"))
        short = F.concat(part(1), part(2), F.when(more == "", "").otherwise(F.concat(F.lit("."), more)), F.lit("e"), power)
        return F.when(exp.between(7, 15), whole).when(exp == -4, F.concat(part(1), F.lit("0.000"), digits)).otherwise(short)

    def told(java: Column) -> Column:
        return F.when(java == "NaN", "nan").when(java == "Infinity", "inf").when(java == "-Infinity", "-inf").when(java.contains("E"), scientific(java)).otherwise(java)

    return let(x.cast("string"), told)


def as_float(c: Column) -> Column:
    """The number that a text is to Python, null if it is none."""

    def number(bare: Column) -> Column:
        sign = F.when(bare.startswith("-"), -1.0).otherwise(1.0)
        return F.when(bare.contains("nan"), float("nan")).when(bare.contains("inf"), sign * float("inf")).otherwise(bare.try_cast("double"))

    return let(c, lambda x: F.when(x.rlike(FLOAT), let(F.lower(F.replace(strip(x), F.lit("_"), F.lit(""))), number)))


def span_words(c: Column) -> Column:
    """Words of a span, parted at spaces and hyphens: lower-cased, no ASCII punctuation but in numbers, canonical numbers, no articles."""

    def one(x: Column) -> Column:
        bare = F.when(x.rlike(FLOAT), x).otherwise(F.regexp_replace(x, PUNCTUATION, ""))
        return let(bare, lambda b: F.regexp_replace(F.when(b.rlike(FLOAT), python_float(as_float(b))).otherwise(b), r"(?U)\b(a|an|the)\b", " "))

    words = F.transform(F.split(F.lower(c), "[ -]"), one)
    return F.filter(F.split(F.array_join(words, " "), r"(?U)\s+"), lambda x: x != "")


def normalised_span(c: Column) -> Column:
    return F.array_join(span_words(c), " ")


def pair_f1(gold: Column, pred: Column) -> Column:
    """F1 of two word bags: 1 if both are empty, 0 if the gold one has numbers and none of them is shared."""
    number = lambda xs: F.filter(xs, lambda x: x.rlike(FLOAT))

    def score(b: Column) -> Column:
        unmet = (F.size(number(b["g"])) > 0) & (F.size(F.array_intersect(number(b["g"]), number(b["p"]))) == 0)
        return F.when((F.size(b["g"]) == 0) & (F.size(b["p"]) == 0), 1.0).when(unmet, 0.0).otherwise(f1(b["g"], b["p"]))

    return let(F.struct(F.array_distinct(gold).alias("g"), F.array_distinct(pred).alias("p")), score)


def exact_set_match(gold: Column, pred: Column) -> Column:
    """Whether two span lists have the same set of normalised spans and the same number of spans."""
    spans = lambda xs: F.transform(xs, normalised_span)
    return (F.array_sort(F.array_distinct(spans(gold))) == F.array_sort(F.array_distinct(spans(pred)))) & (F.size(gold) == F.size(pred))


def final_answer(c: Column) -> Column:
    """Of a message that begins with ``Final Answer:`` the text after its first ``FINAL ANSWER:``, up to a second one; null for other messages and without that marker."""
    parts = F.split(F.substring(c, len("Final Answer:") + 1, 1 << 30), "FINAL ANSWER:", -1)
    return F.when(c.startswith("Final Answer:") & (F.size(parts) > 1), strip(F.get(parts, F.lit(1))))


def verdict(c: Column) -> Column:
    """First of A, B, C in a judge's reply, C if there is none."""
    found = F.regexp_extract(c, "([ABC])", 1)
    return F.when(found == "", "C").otherwise(found)


def success(c: Column) -> Column:
    return F.when(c.contains("NOT SUCCESS"), 0.0).when(c.contains("SUCCESS"), 1.0).otherwise(0.0)


def judgement(c: Column) -> Column:
    """struct(score, success, reasoning) of a judge's JSON reply: the score over 10; 0, false and a fixed text for what is missing; null if it is no JSON object."""
    v = F.when(c.rlike(r"^\s*\{"), strict_variant(c))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return F.when(v.isNotNull(), F.struct((F.coalesce(get("$.score", "double"), F.lit(0.0)) / 10).alias("score"), F.coalesce(get("$.success", "boolean"), F.lit(False)).alias("success"), F.coalesce(get("$.reasoning", "string"), F.lit("No reasoning provided.")).alias("reasoning")))


def reply_accepted(c: Column) -> Column:
    """Whether a reply accepts a plan."""
    return strip(F.lower(c)).isin(ACCEPT)


def truthy(v: Column) -> Column:
    """Whether a JSON value counts as true: not null, false, 0, an empty text, list or object."""
    kind, text = F.schema_of_variant(v), F.to_json(v)
    return F.when(F.is_variant_null(v), False).when(kind.isin("BOOLEAN", "STRING"), ~text.isin("false", '""')).when(kind.rlike("^(ARRAY|OBJECT)"), ~text.isin("[]", "{}")).otherwise(F.try_variant_get(v, "$", "double") != 0)


def action_approved(c: Column, default: bool) -> Column:
    """Whether a reply approves an action: the ``accepted`` of a JSON object, else a word that approves or denies; ``default`` for others."""
    said = strip(c)
    v = F.when(said.startswith("{") & strict_json(said), F.try_parse_json(said))
    word = F.when(F.lower(said).isin(APPROVE), True).when(F.lower(said).isin(DENY), False).otherwise(default)
    return F.when(v.isNull(), word).otherwise(F.coalesce(truthy(F.try_variant_get(v, "$.accepted", "variant")), F.lit(default)))


def approval_required(policy: Column, baseline: Column, guess: Column, verdict: Column) -> Column:
    """Whether an action needs approval: by a policy of always or never, else a baseline of always or never, else the guess (auto-permissive) or the model's verdict, of which only a no spares it."""
    no = F.coalesce(F.lower(verdict).isin("no", "n"), F.lit(False))
    return F.when(policy == "always", True).when(policy == "never", False).when(baseline == "never", False).when(baseline == "always", True).when(policy == "auto-permissive", ~guess.eqNullSafe(F.lit("never"))).otherwise(~no)


def stable_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def url_safe_id(c: Column) -> Column:
    raw = F.base64(F.unhex(F.substring(F.sha2(c, 256), 1, 32)))
    return F.regexp_replace(F.translate(raw, "+/", "-_"), "=+$", "")


def page_lines(c: Column, lines: int = 50, words: int | None = None) -> Column:
    """First lines of a page's text without scripts, styles and tags; blank ones go after the cut. At most ``words`` words of them, if given."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", "\n")
    cut = F.slice(F.split(F.regexp_replace(bare, "[ \t]+", " "), "\n"), 1, lines)
    text = F.array_join(F.filter(F.transform(cut, strip), lambda x: x != ""), "\n")
    if words is None:
        return text
    return F.regexp_replace(F.array_join(F.slice(F.split(text, r"(?U)(?<=\s)(?=\S)"), 1, words), ""), r"(?U)\s+$", "")


def strict_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else."""
    return strict_variant(c).isNotNull()


def strict_variant(c: Column) -> Column:
    """The JSON value that a text is, null if it isn't one value and nothing else; it is parsed once.

    The parser takes text after the first value, so the value is wrapped in two
    lists with a hash of the text behind it, which must come out again.
    """

    def whole(x: Column) -> Column:
        get = lambda path, kind: F.try_variant_get(x["v"], path, kind)
        good = (F.size(get("$", "array<variant>")) == 2) & (F.size(get("$[0]", "array<variant>")) == 1) & (get("$[1]", "string") == x["h"])
        return F.when(good, get("$[0][0]", "variant"))

    wrapped = lambda x: F.struct(F.try_parse_json(F.concat(F.lit("[["), x["c"], F.lit('],"'), x["h"], F.lit('"]'))).alias("v"), x["h"].alias("h"))
    return let(let(F.struct(c.alias("c"), F.md5(c).alias("h")), wrapped), whole)


def first_json(c: Column) -> Column:
    """Text from the first { to the last }, if it parses; else null."""
    found = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(strict_json(found), found)


def viewport_chunks(c: Column, size: int) -> Column:
    """Chunks of at least ``size`` characters that end on white space; an empty text is one empty chunk."""
    found = F.regexp_extract_all(c, F.lit(rf"(?s)(?:.{{{size - 1}}}[^ \t\r\n]*[ \t\r\n]|.+)"), F.lit(0))
    return F.when(c == "", F.array(F.lit(""))).otherwise(found)


def find_in_chunks(chunks: Column, query: str, start: Column) -> Column:
    """Place of the first chunk, from ``start`` on and then from 0, that has the query; null if none has.

    Words are compared in lower case with anything that is no letter, digit or
    underscore as a space; ``*`` stands for any text. A query without a word or
    star finds nothing.
    """
    bare = " " + " ".join(w for w in re.split(r"\W+", query.replace("*", "__STAR__")) if w) + " "
    pattern = bare.replace(" __STAR__ ", "__STAR__ ").replace("__STAR__", ".*").lower()
    if not pattern.strip():
        return F.lit(None).cast("int")
    plain = lambda x: F.concat(F.lit(" "), F.lower(F.regexp_replace(F.regexp_replace(x, r"(?U)[\W&&[^_]]+", " "), "^ | $", "")), F.lit(" "))
    n = F.size(chunks)
    steps = F.filter(F.transform(chunks, lambda x, i: F.when(plain(x).rlike(pattern), (i - start + n) % n)), lambda x: x.isNotNull())
    return ((F.array_min(steps) + start) % n).cast("int")


def flatten_json(c: Column, levels: int = 3) -> Column:
    """Array of (path, value): leaves of a JSON text in order, down to ``levels`` of keys (.key) and list places ([i]); deeper values as JSON text. Null if it isn't JSON."""
    kind = "array<struct<path:string,v:variant>>"

    def children(item: Column) -> Column:
        schema = F.schema_of_variant(item["v"])
        values = F.transform(F.try_variant_get(item["v"], "$", "array<variant>"), lambda v, i: F.struct(F.concat(item["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), v.alias("v")))
        entries = F.transform(F.map_entries(F.try_variant_get(item["v"], "$", "map<string,variant>")), lambda e: F.struct(F.concat(item["path"], F.when(item["path"] == "", "").otherwise("."), e["key"]).alias("path"), e["value"].alias("v")))
        return F.when(schema.startswith("ARRAY"), values).when(schema.startswith("OBJECT"), entries).otherwise(F.array(item)).cast(kind)

    items = F.array(F.struct(F.lit("").alias("path"), F.try_parse_json(c).alias("v"))).cast(kind)
    for _ in range(levels):
        items = F.flatten(F.transform(items, children))
    text = lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v))
    return F.when(strict_json(c), F.transform(items, lambda x: F.struct(x["path"].alias("path"), text(x["v"]).alias("value"))))
