"""Column functions over html and markdown: elements, links, metadata, chunks of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: Roles of elements without one of their own, by tag or by tag and type.
ROLE_OF = {
    "a": "link", "area": "link", "button": "button", "input, type=button": "button", "input, type=checkbox": "checkbox", "input, type=email": "textbox", "input, type=number": "spinbutton", "input, type=radio": "radio",
    "input, type=range": "slider", "input, type=reset": "button", "input, type=search": "searchbox", "input, type=submit": "button", "input, type=tel": "textbox", "input, type=text": "textbox", "input, type=url": "textbox",
    "search": "search", "select": "combobox", "option": "option", "textarea": "textbox",
}
#: Roles that make an element interactive.
ROLES = [
    "scrollbar", "searchbox", "slider", "spinbutton", "switch", "tab", "treeitem", "button", "checkbox", "gridcell", "link", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "progressbar", "radio", "textbox", "combobox",
    "menu", "tree", "treegrid", "grid", "listbox", "radiogroup", "widget",
]
TAG = r"(?is)<([a-z][a-z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
LINK = r"(?is)<a(\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</a\s*>"


def attribute(attrs: Column, name: str) -> Column:
    """An attribute's value, quoted or not; null if it is absent, empty if it has none."""
    return attributes(attrs, name, F.regexp_extract)


def attributes(attrs: Column, name: str, extract) -> Column:
    pattern = rf"(?is)(?:^|[\s\"'])({name})(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)"
    get = lambda i: extract(attrs, pattern, i)
    return F.when(get(1) != "", F.concat(get(2), get(3), get(4)))


def page_elements(html: Column) -> Column:
    """Array of roles of a page's interactive elements, in page order.

    Those are inputs, selects, options, text areas and buttons, elements with
    href, onclick, contenteditable, a tab index other than -1 or an interactive
    role, none of them disabled (options count always). The role is the
    element's own, else that of its tag and type, else empty. Layout and
    cursors, which need a browser, play no part. Comments, scripts and styles
    hold no elements.
    """
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    tags = F.arrays_zip(F.regexp_extract_all(bare, F.lit(TAG), F.lit(1)).alias("tag"), F.regexp_extract_all(bare, F.lit(TAG), F.lit(2)).alias("attrs"))

    def seen(e: Column) -> Column:
        at = {n: attribute(e["attrs"], n) for n in ("role", "type", "href", "onclick", "contenteditable", "tabindex", "disabled")}
        tag = F.lower(e["tag"])
        known = tag.isin("input", "select", "textarea", "button") | at["href"].isNotNull() | at["onclick"].isNotNull() | at["contenteditable"].isNotNull() | (at["tabindex"] != "-1") | at["role"].isin(ROLES)
        on = (tag == "option") | F.coalesce(known, F.lit(False)) & at["disabled"].isNull()
        kind = F.when(tag == "input", F.concat(F.lit("input, type="), F.coalesce(F.lower(at["type"]), F.lit("text")))).otherwise(tag)
        roles = F.create_map(*(F.lit(x) for kv in ROLE_OF.items() for x in kv))
        return F.when(on, F.coalesce(at["role"], roles[kind], F.lit("")))

    return F.filter(F.transform(tags, seen), lambda r: r.isNotNull())


def html_links(html: Column) -> Column:
    """Array of (url, label) of a page's http and https links with a host, in page order; labels are without tags, their white space one space each."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("attrs"), F.regexp_extract_all(html, F.lit(LINK), F.lit(2)).alias("inner"))
    plain = lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", ""), r"(?U)\s+", " "))
    return F.filter(F.transform(found, lambda x: F.struct(attribute(x["attrs"], "href").alias("url"), plain(x["inner"]).alias("label"))), lambda x: web_url(x["url"]))


def web_url(url: Column) -> Column:
    """Whether a URL is http or https and has a host."""
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#\s]"), F.lit(False))


def markdown_links(text: Column) -> Column:
    """Array of (url, label): the link of each line that holds exactly one of each bracket, if its URL is http or https with a host."""
    count = lambda line, c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    lines = F.filter(F.split(text, "\n"), lambda x: (count(x, "[") == 1) & (count(x, "]") == 1) & (count(x, "(") == 1) & (count(x, ")") == 1))
    inner = lambda x, a, b: F.regexp_extract(x, rf"(?s){a}([^{b}]*){b}", 1)
    found = F.transform(lines, lambda x: F.struct(inner(x, r"\(", r"\)").alias("url"), inner(x, r"\[", r"\]").alias("label")))
    return F.filter(found, lambda x: web_url(x["url"]))


def meta_map(html: Column) -> Column:
    """Contents of a page's meta tags by name, else property; the last of equal names counts, tags without a content don't."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"), F.lit(1))
    pairs = F.transform(tags, lambda a: F.struct(F.coalesce(attribute(a, "name"), attribute(a, "property")).alias("key"), attribute(a, "content").alias("value")))
    kept = F.filter(pairs, lambda x: x["key"].isNotNull() & x["value"].isNotNull())
    last = let(kept, lambda xs: F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, i + 2, F.size(xs)), lambda y: y["key"] == x["key"])))
    return F.map_from_entries(last)


def json_ld(html: Column) -> Column:
    """Texts of a page's JSON-LD scripts."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)), strip)


#: Elements without an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
OPEN = "struct<tag:string,scope:boolean,type:string,owner:string,name:string,given:string,at:int>"
DONE = "struct<at:int,upto:int,owner:string,name:string,given:string>"


def item_properties(html: Column) -> Column:
    """Array of (type, name, value) of microdata, in page order: each itemprop inside an item, with the itemtype of the nearest item around it.

    A stack of open elements is folded over the tags, so an end tag closes all
    that stands open in its element. The value is a ``url``'s href, else the
    content, else all text up to the element's end, tags left out, else the src.
    An itemprop that is an item itself has no value of its own; its properties
    are its own. Comments, scripts and styles hold nothing.
    """
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    tag = r"(?is)<(/?)([a-z][a-z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>([^<]*(?:<(?![/a-z])[^<]*)*)"
    get = lambda i: F.regexp_extract_all(bare, F.lit(tag), F.lit(i))
    tags = F.arrays_zip(get(1).alias("end"), F.transform(get(2), F.lower).alias("tag"), get(3).alias("attrs"), F.transform(get(4), lambda _, i: i).alias("at"))
    none = F.struct(F.array().cast(f"array<{OPEN}>").alias("open"), F.array().cast(f"array<{DONE}>").alias("done"))

    def closed(items: Column, upto: Column) -> Column:
        named = F.filter(items, lambda x: x["name"].isNotNull() & x["owner"].isNotNull() & ~x["scope"])
        return F.transform(named, lambda x: F.struct(x["at"], upto.alias("upto"), x["owner"], x["name"], x["given"]).cast(DONE))

    def step(st: Column, t: Column) -> Column:
        def shut(_: Column) -> Column:
            last = F.array_position(F.reverse(F.transform(st["open"], lambda x: x["tag"])), t["tag"]).cast("int")  # 0: no such element is open
            keep = F.when(last > 0, F.size(st["open"]) - last).otherwise(F.size(st["open"]))
            return let(keep, lambda n: F.struct(F.slice(st["open"], F.lit(1), n).alias("open"), F.concat(st["done"], closed(F.slice(st["open"], n + 1, F.size(st["open"])), t["at"])).alias("done")))

        def start(_: Column) -> Column:
            scope, owner = attribute(t["attrs"], "itemscope").isNotNull(), F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(st["open"], lambda x: x["scope"]), lambda x: x["type"])), -1)
            name = attribute(t["attrs"], "itemprop")
            given = F.coalesce(F.when(attribute(t["attrs"], "content") != "", attribute(t["attrs"], "content")), F.lit(None).cast("string"))
            one = F.struct(t["tag"], scope.alias("scope"), F.coalesce(attribute(t["attrs"], "itemtype"), F.lit("")).alias("type"), owner.alias("owner"), name.alias("name"), given.alias("given"), t["at"]).cast(OPEN)
            alone = t["tag"].isin(VOID) | t["attrs"].endswith("/")
            return F.when(alone, F.struct(st["open"].alias("open"), F.concat(st["done"], closed(F.array(one), t["at"])).alias("done"))).otherwise(F.struct(F.array_append(st["open"], one).alias("open"), st["done"].alias("done")))

        return F.when(t["end"] == "/", shut(t)).otherwise(start(t))

    def told(x: Column) -> Column:
        found = F.array_sort(F.aggregate(x["tags"], none, step, lambda st: F.concat(st["done"], closed(st["open"], F.size(x["tags"])))))

        def value(d: Column) -> Column:
            attrs = F.get(x["tags"], d["at"])["attrs"]
            text = strip(F.regexp_replace(F.array_join(F.slice(x["text"], d["at"] + 1, F.greatest(d["upto"] - d["at"], F.lit(0))), ""), r"(?U)\s", " "))
            plain = F.coalesce(d["given"], F.when(text != "", text), attribute(attrs, "src"), F.lit(""))
            names = F.filter(F.split(d["name"], r"\s+"), lambda n: n != "")
            return F.transform(names, lambda n: F.struct(d["owner"].alias("type"), n.alias("name"), F.when(n == "url", attribute(attrs, "href")).otherwise(plain).alias("value")))

        return F.flatten(F.transform(found, value))

    return let(F.struct(tags.alias("tags"), get(4).alias("text")), told)


def title(html: Column) -> Column:
    return F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)
