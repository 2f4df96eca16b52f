"""Scores over lists and maps: best one-to-one alignment, keyed scores, longest common subsequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assignment import map_alignment, span_alignment
from .text import as_float, clean_number, let, python_float, score_number, span_words, strict_json, strict_variant, strip


def align_spans(df: DataFrame, gold: Column, pred: Column, score: str = "score") -> DataFrame:
    """Adds the best one-to-one alignment of two span lists over the longer list's size; 0 if either is empty, null if null."""
    none, empty = gold.isNull() | pred.isNull(), (F.size(gold) == 0) | (F.size(pred) == 0)
    out = df.withColumns({"_g": F.transform(gold, span_words), "_p": F.transform(pred, span_words), "_0": F.when(none, None).when(empty, 0.0)})
    return out.withColumn(score, F.coalesce("_0", aligned(span_alignment, "_g", "_p"))).drop("_g", "_p", "_0")


def aligned(how, gold: str, pred: str) -> Column:
    """``how`` over two columns. They are named twice, so that they are worked out before: Spark takes no Arrow function out of an expression with lambdas nested in its input."""
    return F.when((F.size(gold) >= 0) & (F.size(pred) >= 0), how(gold, pred))


#: Kinds of values: numbers (also true, false and texts that are one), texts, lists, others.
NUMBER, TEXT, LIST, OTHER = range(4)
VALUE = "struct<kind:int,number:double,words:array<array<string>>>"


def value_number(c: Column) -> Column:
    """The number that a text inside a map is: signs of money and percent and sqft count as spaces, a comma as a decimal point; null if it isn't one to Python."""
    for sign in ("$", "%", "sqft"):
        c = F.replace(c, F.lit(sign), F.lit(" "))
    return as_float(F.replace(strip(c), F.lit(","), F.lit(".")))


def typed_values(c: Column) -> Column:
    """A JSON object's entries as array<struct(key, kind, number, words)>: the words of a text (a list of one) or of each text of a list. Null if it is no object."""

    def parts(x: Column) -> Column:
        """A value's text, flag and list, of which at most one isn't null, and its plain number."""
        v, schema = x["v"], x["schema"]
        text = F.when(schema == "STRING", F.try_variant_get(v, "$", "string"))
        flag = F.when(schema == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        plain = F.when(~schema.isin("STRING", "BOOLEAN") & ~schema.rlike("^(ARRAY|OBJECT)"), F.try_variant_get(v, "$", "double"))
        items = F.when(schema.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        return let(text, lambda t: F.struct(t.alias("text"), F.coalesce(flag, value_number(t), plain).alias("number"), items.alias("items")))

    def one(x: Column) -> Column:
        kind = F.when(x["number"].isNotNull(), NUMBER).when(x["text"].isNotNull(), TEXT).when(x["items"].isNotNull(), LIST).otherwise(OTHER)
        texts = F.transform(x["items"], lambda i: F.when(F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string")))
        return F.struct(kind.alias("kind"), x["number"].alias("number"), F.transform(F.coalesce(texts, F.array(x["text"])), span_words).alias("words")).cast(VALUE)

    value = lambda v: let(let(F.struct(v.alias("v"), F.schema_of_variant(v).alias("schema")), parts), one)
    entries = F.map_entries(F.when(c.rlike(r"^\s*\{"), F.try_variant_get(strict_variant(c), "$", "map<string,variant>")))
    return F.transform(entries, lambda e: let(value(e["value"]), lambda v: F.struct(e["key"].alias("key"), v["kind"].alias("kind"), v["number"].alias("number"), v["words"].alias("words"))))


def score_dict(df: DataFrame, gold: Column, pred: Column, score: str = "score") -> DataFrame:
    """Adds the F1 of two maps of typed values: recall is the mean key score over gold keys, precision that over predicted keys, where the prediction takes the gold one's part.

    Values of one kind are scored: numbers by their ratio, texts as spans, of
    which the gold one's numbers must be met, lists of texts by their best
    one-to-one alignment, whatever their size. 0 if a map is empty or null, or
    holds a value that is no number, text or list.
    """
    out = df.withColumns({"_g": F.when(gold.isNotNull(), F.array(gold)), "_p": F.when(pred.isNotNull(), F.array(pred))})
    return out.withColumn(score, F.coalesce(aligned(map_alignment, "_g", "_p"), F.lit(0.0))).drop("_g", "_p")


def answer_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")


def as_json(line: Column) -> Column:
    """A line with the quotes of a Python dictionary made those of JSON."""
    for old, new in (("{'", '{"'), ("', '", '", "'), ("': '", '": "'), ("'}", '"}'), ("': ", '": ')):
        line = F.replace(line, F.lit(old), F.lit(new))
    return line


def answer_type(c: Column) -> Column:
    """number, json (every line is a JSON value), string or string list."""
    return lines_type(answer_lines(c))


def lines_type(lines: Column) -> Column:
    one = F.size(lines) == 1
    return F.when(one & clean_number(F.get(lines, F.lit(0))).isNotNull(), "number").when(F.forall(lines, lambda x: strict_json(as_json(x))), "json").when(one, "string").otherwise("string list")


PREDICTED = "struct<number:double,spans:array<string>,objects:array<string>,list:boolean>"


def predicted(c: Column) -> Column:
    """struct(number, spans, objects, list) of a prediction: a JSON list's texts are its spans, any other text is one span, however many lines it has."""

    def of(x: Column) -> Column:
        v, kind, c = x["v"], x["kind"], x["c"]
        items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "VOID", "None").otherwise(c)
        number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(clean_number(text))
        return let(F.struct(items.alias("items"), text.alias("text"), number.alias("number"), kind.alias("kind")), told)

    def told(x: Column) -> Column:
        texts = F.transform(x["items"], lambda i: F.when(F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string")))
        lines = F.split(x["text"], "\n")
        objects = F.when(x["items"].isNotNull(), F.transform(x["items"], lambda i: F.to_json(i))).when(x["number"].isNull() & F.forall(lines, strict_json), lines).when(x["kind"].startswith("OBJECT"), F.array(x["text"]))
        spans = F.coalesce(texts, F.array(F.coalesce(python_float(x["number"]), x["text"])))
        return F.struct(F.when(x["items"].isNull(), x["number"]).alias("number"), spans.alias("spans"), objects.alias("objects"), x["items"].isNotNull().alias("list")).cast(PREDICTED)

    parsed = let(F.struct(strict_variant(c).alias("v"), c.alias("c")), lambda x: F.struct(x["v"].alias("v"), F.schema_of_variant(x["v"]).alias("kind"), x["c"].alias("c")))
    return let(parsed, of)


def score_typed(df: DataFrame, gold: Column, pred: Column, score: str = "score") -> DataFrame:
    """Adds the score by the gold answer's type; an empty prediction, a list against a number, and what can't be scored give 0.

    JSON objects are aligned one to one, over the longer list; a prediction that
    is one JSON object counts as a list of one. Each step is a column of its own
    and works on one type: numbers are done at once, lines become words, objects
    entries, and both are aligned a batch at a time.
    """
    kind, g, p = F.col("_kind"), F.col("_g"), F.col("_p")
    steps = df.withColumns({"_g": answer_lines(gold), "_p": predicted(pred), "_said": F.coalesce(F.trim(pred) != "", F.lit(False))}).withColumn("_kind", lines_type(g))
    steps = steps.withColumns({
        "_number": F.when((kind == "number") & ~p["list"], score_number(clean_number(F.get(g, F.lit(0))), p["number"])),
        "_gw": F.when(kind.startswith("string"), F.transform(g, span_words)),
        "_pw": F.when(kind.startswith("string"), F.transform(p["spans"], lambda x: F.when(x.isNotNull(), span_words(x)))),
        "_gm": F.when(kind == "json", F.transform(g, lambda x: typed_values(as_json(x)))),
        "_pm": F.when(kind == "json", F.transform(p["objects"], typed_values)),
    })
    steps = steps.withColumn("_s", F.coalesce("_number", aligned(span_alignment, "_gw", "_pw"), aligned(map_alignment, "_gm", "_pm")))
    done = steps.withColumn(score, F.coalesce(F.when(F.col("_said") & F.col("_s").between(0.0, 1.0), F.col("_s")), F.lit(0.0)))
    return done.drop("_g", "_p", "_said", "_kind", "_number", "_gw", "_pw", "_gm", "_pm", "_s")


def without_repeats(xs: Column) -> Column:
    """An array without items equal to the one before."""
    return F.filter(xs, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(xs, i - 1)))


def common_lengths(a: Column, b: Column) -> Column:
    """Lengths of the longest common subsequence of an array with each prefix of ``b``, from its first item on."""
    none = F.transform(b, lambda _: F.lit(0))

    def step(row: Column, x: Column) -> Column:
        def cell(out: Column, j: Column) -> Column:
            diagonal = F.when(j == 0, 0).otherwise(F.get(row, j - 1))
            left = F.when(j == 0, 0).otherwise(F.get(out, j - 1))
            return F.array_append(out, F.when(F.get(b, j) == x, diagonal + 1).otherwise(F.greatest(F.get(row, j), left)))

        return F.aggregate(F.transform(b, lambda _, j: j), F.array().cast("array<int>"), cell)

    return F.aggregate(a, none, step)


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays."""
    return F.coalesce(F.array_max(common_lengths(a, b)), F.lit(0))


def path_summary(gold: Column, steps: Column) -> Column:
    """The common length of ``steps`` with every stretch of the gold path, as the rows of a square array<int>: place (i, j) is that of gold[i:j], 0 unless i < j.

    Summaries of two stretches of a run give that of both, see ``joined_summary``.
    """
    m = F.size(gold)
    return F.flatten(F.transform(F.sequence(F.lit(0), m), lambda i: F.concat(F.array_repeat(F.lit(0), i + 1), common_lengths(steps, F.slice(gold, i + 1, m - i)))))


def joined_summary(first: Column, then: Column, m: Column) -> Column:
    """The summary of a stretch and the one after it: the gold path is cut where both parts together are longest."""

    def cell(p: Column) -> Column:
        i, j = F.floor(p / (m + 1)).cast("int"), p % (m + 1)
        return F.when(j <= i, 0).otherwise(F.array_max(F.transform(F.sequence(i, F.greatest(i, j)), lambda k: F.get(first, i * (m + 1) + k) + F.get(then, k * (m + 1) + j))))

    return F.transform(F.sequence(F.lit(0), (m + 1) * (m + 1) - 1), cell)


def path_score(gold: Column, pred: Column) -> Column:
    """Steps of the gold path that the predicted path walks in order, both without immediate repeats; null without a gold path."""
    return F.when(F.size(gold) > 0, common_length(without_repeats(gold), without_repeats(F.coalesce(pred, F.array().cast("array<string>")))).cast("double"))


def score_custom(**scores: Column) -> Column:
    """A map of the named scores that aren't null."""
    names = F.array(*(F.lit(n) for n in scores))
    return F.map_filter(F.map_from_arrays(names, F.array(*(c.cast("double") for c in scores.values()))), lambda _, v: v.isNotNull())
