"""Column functions and joins over URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A few public suffix rules; a parameter wherever they are used.
SUFFIXES = ["com", "net", "org", "co.uk"]
#: Rules that are broadcast at most.
RULES_BROADCAST = 100_000


def full(url: Column) -> Column:
    return F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url))


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(full(url), F.lit(name))


def normalise_url(url: Column) -> Column:
    """Unquoted path without closing slashes, sorted query parameters, no fragment."""
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    query = part(url, "QUERY")
    tail = F.when(query.isNotNull() & (query != ""), F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))).otherwise("")
    return F.concat(part(url, "PROTOCOL"), F.lit("://"), part(url, "AUTHORITY"), F.regexp_replace(plain, "/+$", ""), tail)


def suffix_rules(lines: DataFrame) -> DataFrame:
    """(tail, labels, whole, below, not_here) from lines of public suffix rules in a text column ``value``.

    ``co.uk`` makes that tail a suffix, ``*.ck`` each name right below ck, and
    ``!www.ck`` is an exception to such a rule. Lines without a rule, and those
    that begin with //, are left out; upper case counts as lower.
    """
    rule = F.lower(F.regexp_extract("value", r"^\s*([^\s/][^\s]*)", 1))
    rows = lines.select(rule.alias("_rule")).where("_rule not in ('', '*')").select("_rule", F.regexp_replace("_rule", r"^(\*\.|!)", "").alias("tail"))
    first = F.substring("_rule", 1, 1)
    kind = (F.bool_or(~first.isin("*", "!")).alias("whole"), F.bool_or(first == "*").alias("below"), F.bool_or(first == "!").alias("not_here"))
    return rows.groupBy("tail").agg(*kind).withColumn("labels", F.size(F.split("tail", r"\.")))


def host_parts(df: DataFrame, url: str, suffixes: list[str] | DataFrame | None = None) -> DataFrame:
    """Adds scheme, subdomain, domain, suffix and path.

    ``suffixes``: rules as for ``suffix_rules``, a short list or a table of lines
    (such as ``spark.read.text`` of a rules file). The longest rule that fits a
    host gives its suffix, an exception before any; a host that no rule fits ends
    in its last label, of a single label or an IP address all is the domain. Hosts
    meet rules by one join for each number of labels that rules have, broadcast
    if rules are counted few.
    """
    lines = suffixes if isinstance(suffixes, DataFrame) else df.sparkSession.createDataFrame([(s,) for s in suffixes or SUFFIXES], "value string")
    rules = suffix_rules(lines)
    counts = {r.labels: r["count"] for r in rules.groupBy("labels").count().collect()}  # one for each number of labels
    hint = "broadcast" if sum(counts.values()) <= RULES_BROADCAST else "merge"
    out = df.withColumn("_host", F.regexp_replace(F.lower(part(F.col(url), "HOST")), r"\.$", ""))
    out = out.withColumn("_labels", F.when(F.col("_host").rlike(r"^(\d+\.){3}\d+$|:"), 0).otherwise(F.size(F.split("_host", r"\."))))
    lengths, exceptions, held = [F.lit(0)], [], ["_host", "_labels", "_rest", "_in"]
    for n in sorted(counts):
        own = rules.where(F.col("labels") == n).select(F.col("tail").alias(f"_tail{n}"), F.struct("whole", "below", "not_here").alias(f"_rule{n}"))
        out = out.withColumn(f"_tail{n}", F.when(F.col("_labels") >= n, F.substring_index("_host", ".", -n))).join(own.hint(hint), f"_tail{n}", "left")
        r = F.col(f"_rule{n}")
        lengths += [F.when(r["whole"], n), F.when(r["below"] & (F.col("_labels") > n), n + 1)]
        exceptions.append(F.when(r["not_here"], n - 1))
        held += [f"_tail{n}", f"_rule{n}"]
    fits = F.coalesce(*exceptions, F.greatest(*lengths)) if exceptions else F.lit(0)
    out = out.withColumn("_in", F.when((fits == 0) & (F.col("_labels") > 1), 1).otherwise(fits))
    out = out.withColumn("suffix", F.when(F.col("_in") == 0, "").otherwise(F.expr("substring_index(_host, '.', -_in)")))
    out = out.withColumn("_rest", F.when(F.col("_in") == 0, F.col("_host")).otherwise(F.expr("left(_host, greatest(length(_host) - length(suffix) - 1, 0))")))
    out = out.withColumn("domain", F.when(F.col("_labels") == 0, F.col("_rest")).otherwise(F.substring_index("_rest", ".", -1)))
    out = out.withColumn("subdomain", F.expr("left(_rest, greatest(length(_rest) - length(domain) - 1, 0))"))
    return out.withColumn("scheme", F.lower(part(F.col(url), "PROTOCOL"))).withColumn("path", F.coalesce(part(F.col(url), "PATH"), F.lit(""))).drop(*held)


def url_policy(urls: DataFrame, rules: DataFrame, url: str = "url", pattern: str = "pattern", status: str = "status", suffixes: list[str] | DataFrame | None = None) -> DataFrame:
    """Adds ``allowed``: blocked over rejected over allowed; without any allowed rule every other URL is allowed.

    A rule meets a URL with the same domain, an equal scheme (http as https; none
    given: either), its subdomain and suffix if it names them, and a path that
    begins with its own. The join is on the domain; rules are broadcast if counted few.
    """
    r = host_parts(rules, pattern, suffixes).select(F.col("domain").alias("domain"), *(F.col(c).alias(f"r_{c}") for c in ("scheme", "subdomain", "suffix", "path")), F.col(status).alias("r_status"))
    u = host_parts(urls.select(url).distinct(), url, suffixes)
    web = lambda c: F.when(F.col(c) == "https", "http").otherwise(F.col(c))
    path = F.regexp_replace("r_path", "/+$", "")
    fits = (web("scheme") == web("r_scheme")) & F.col("r_subdomain").isin("") | (web("scheme") == web("r_scheme")) & (F.col("r_subdomain") == F.col("subdomain"))
    fits = fits & ((F.col("r_suffix") == "") | (F.col("r_suffix") == F.col("suffix"))) & F.col("path").startswith(path)
    few = rules.count() <= RULES_BROADCAST
    met = u.join(r.hint("broadcast" if few else "merge"), "domain").where(fits).groupBy(url).agg(*(F.bool_or(F.col("r_status") == s).alias(s) for s in ("blocked", "rejected", "allowed")))
    lists = rules.where(F.col(status) == "allowed").limit(1).agg(F.count("*").alias("lists"))
    false = F.lit(False)
    verdict = ~F.coalesce("blocked", false) & ~F.coalesce("rejected", false) & ((F.col("lists") == 0) | F.coalesce("allowed", false))
    return urls.join(met, url, "left").crossJoin(F.broadcast(lists)).withColumn("allowed", verdict).drop("blocked", "rejected", "lists")
