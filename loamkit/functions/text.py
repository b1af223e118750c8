"""Column functions on text: normalising, chunking, headings, slugs, formats."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of the characters that trimming removes: blanks, tab, line ends, NUL, vertical tab.
_EDGE = "[ \\t\\n\\r\\x00\\x0B]+"


def trimmed(col: Column) -> Column:
    """Trim blanks and line ends of all kinds, not only spaces."""
    return F.regexp_replace(col, f"\\A{_EDGE}|{_EDGE}\\z", "")


def normalised(col: Column) -> Column:
    """NZ-1: line ends to LF, runs of blanks to one, no blanks around line ends, at most one empty
    line, trimmed."""
    text = F.regexp_replace(col, "\\r\\n?", "\n")
    text = F.regexp_replace(text, "[ \\t]+", " ")
    text = F.regexp_replace(text, " *\\n *", "\n")
    return trimmed(F.regexp_replace(text, "\\n{3,}", "\n\n"))


def paragraphs(content: Column) -> Column:
    """CH-1: the non-empty trimmed stretches between blank lines."""
    parts = F.transform(F.split(content, "\\n\\s*\\n"), trimmed)
    return F.filter(parts, lambda p: p != "")


def is_heading(paragraph: Column) -> Column:
    """CH-3: a one-line paragraph of one to six hashes, white space and more."""
    return paragraph.rlike("\\A#{1,6}\\s+[^\\n]+\\z")


def chunks(content: Column, max_bytes: int = 0) -> Column:
    """CH-2: array of (chunk_index, content).

    A fold over paragraphs packs greedily: the open chunk is closed when it, its trailing blank
    line included, and the next paragraph exceed ``max_bytes`` bytes. A closed chunk is prefixed by
    the heading in force at that moment."""
    state = "struct<heading:string,open:string,done:array<string>>"

    def closed(acc: Column) -> Column:
        body = trimmed(acc["open"])
        return F.concat(acc["done"], F.array(F.when(acc["heading"] != "", F.concat(acc["heading"], F.lit("\n\n"), body)).otherwise(body)))

    def step(acc: Column, p: Column) -> Column:
        full = (F.octet_length(acc["open"]) + F.octet_length(p) > max_bytes) & (acc["open"] != "")
        packed = F.struct(
            acc["heading"].alias("heading"),
            F.concat(F.when(full, F.lit("")).otherwise(acc["open"]), p, F.lit("\n\n")).alias("open"),
            F.when(full, closed(acc)).otherwise(acc["done"]).alias("done"),
        )
        heading = F.struct(p.alias("heading"), acc["open"].alias("open"), acc["done"].alias("done"))
        return F.when(is_heading(p), heading).otherwise(packed).cast(state)

    start = F.struct(F.lit("").alias("heading"), F.lit("").alias("open"), F.array().cast("array<string>").alias("done")).cast(state)
    texts = F.aggregate(paragraphs(F.coalesce(content, F.lit(""))), start, step, lambda acc: F.when(acc["open"] != "", closed(acc)).otherwise(acc["done"]))
    return F.transform(texts, lambda x, i: F.struct(i.alias("chunk_index"), x.alias("content")))


def sections(content: Column) -> Column:
    """MD-1: array of (title, content) of a markdown document.

    Lines fold into sections: ``# `` and ``## `` open one, titled H1 or H1 / H2; sections with an
    empty body are dropped, as is text before the first heading; if none is left, the whole is one
    section."""
    state = "struct<h1:string,title:string,buf:array<string>,done:array<struct<title:string,content:string>>>"

    def flushed(acc: Column) -> Column:
        body = trimmed(F.array_join(acc["buf"], "\n"))
        keep = acc["title"].isNotNull() & (body != "")
        return F.when(keep, F.concat(acc["done"], F.array(F.struct(acc["title"].alias("title"), body.alias("content"))))).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        one, two = line.rlike("\\A#\\s+[^\\n]+\\z"), line.rlike("\\A##\\s+[^\\n]+\\z")
        name = trimmed(F.regexp_replace(line, "\\A##?\\s+", ""))
        empty = F.array().cast("array<string>")
        opened = F.struct(
            F.when(one, name).otherwise(acc["h1"]).alias("h1"),
            F.when(one | acc["h1"].isNull(), name).otherwise(F.concat(acc["h1"], F.lit(" / "), name)).alias("title"),
            empty.alias("buf"),
            flushed(acc).alias("done"),
        ).cast(state)
        more = F.struct(acc["h1"].alias("h1"), acc["title"].alias("title"), F.concat(acc["buf"], F.array(line)).alias("buf"), acc["done"].alias("done")).cast(state)
        return F.when(one | two, opened).otherwise(more)

    start = F.struct(F.lit(None).cast("string").alias("h1"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("buf"), F.array().cast("array<struct<title:string,content:string>>").alias("done")).cast(state)
    found = F.aggregate(F.split(content, "\\r\\n|\\r|\\n"), start, step, flushed)
    whole = F.array(F.struct(F.lit("Imported Document").alias("title"), content.alias("content")))
    return F.when(F.size(found) > 0, found).otherwise(whole)


def slug(path: Column) -> Column:
    """TX-5: the slug of a path's last part; ``project`` if nothing is left."""
    name = F.regexp_extract(F.regexp_replace(path, "/+\\z", ""), "([^/]*)\\z", 1)
    plain = F.translate(F.lower(name), "áàâãäéèêëíìîïóòôõöúùûüçñ_", "aaaaaeeeeiiiiooooouuuucn-")
    words = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9\\s-]", ""), "[\\s-]+", "-")
    out = F.regexp_replace(words, "\\A-+|-+\\z", "")
    return F.when(out == "", F.lit("project")).otherwise(out)


def csv_list(text: Column) -> Column:
    """TX-7: the non-empty trimmed items of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), trimmed), lambda x: x != "")


def triples(items: Column) -> Column:
    """TX-7: (subject, predicate, object) of ``s:p:o`` items; others are dropped."""
    parts = F.transform(items, lambda x: F.transform(F.split(x, ":", 3), trimmed))
    whole = F.filter(parts, lambda p: (F.size(p) == 3) & F.forall(p, lambda x: x != ""))
    return F.transform(whole, lambda p: F.struct(p[0].alias("subject"), p[1].alias("predicate"), p[2].alias("object")))


def text_config(language: Column) -> Column:
    """TX-1: the text-search language of a language code."""
    code = F.lower(F.translate(F.coalesce(language, F.lit("")), "_", "-"))
    return F.when(code.rlike("\\Apt(-|\\z)"), "portuguese").when(code.rlike("\\Aes(-|\\z)"), "spanish").otherwise("english")


def language_code(text: Column, known: list[str]) -> Column:
    """TX-8: the known code that equals the text but for case and ``_`` or ``-``, else null."""
    plain = F.lower(F.translate(trimmed(text), "_", "-"))
    out = F.lit(None).cast("string")
    for code in reversed(known):
        out = F.when(plain == code.lower().replace("_", "-"), F.lit(code)).otherwise(out)
    return out


def technologies(items: Column, known: list[str]) -> Column:
    """TX-6: struct (technologies, unknown): lower-cased, unknown ones as ``other``, distinct in
    order."""
    plain = F.filter(F.transform(items, lambda x: F.lower(trimmed(x))), lambda x: x != "")
    catalogue = F.array(*[F.lit(k) for k in known])
    named = F.array_distinct(F.transform(plain, lambda x: F.when(F.array_contains(catalogue, x), x).otherwise(F.lit("other"))))
    odd = F.filter(items, lambda x: (trimmed(x) != "") & ~F.array_contains(catalogue, F.lower(trimmed(x))))
    return F.struct(named.alias("technologies"), odd.alias("unknown"))


def strings_only(items: Column) -> Column:
    """FLT-14: the non-empty strings of a list."""
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def nfc_title():  # noqa: ANN201
    """NZ-4: a function that puts titles into NFC, trims them and lower-cases them."""

    @F.pandas_udf("string")
    def normalise(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).strip().lower())

    return normalise


def candidate_hash(candidate: Column) -> Column:
    """NZ-2, NZ-3: SHA-256 of a candidate's canonical JSON.

    ``candidate`` is a struct (title, content, category, source, tags, entities (name, type),
    relations (subject, predicate, object)); texts are normalised, lists sorted."""

    def pairs(col: Column, names: list[str]) -> Column:
        return F.array_sort(F.transform(col, lambda x: F.struct(*[normalised(F.coalesce(x[n], F.lit(""))).alias(n) for n in names])))

    canonical = F.struct(
        normalised(candidate["title"]).alias("title"),
        normalised(candidate["content"]).alias("content"),
        candidate["category"].alias("category"),
        candidate["source"].alias("source"),
        F.array_sort(F.transform(candidate["tags"], normalised)).alias("tags"),
        pairs(candidate["entities"], ["name", "type"]).alias("entities"),
        pairs(candidate["relations"], ["subject", "predicate", "object"]).alias("relations"),
    )
    return F.sha2(F.to_json(canonical), 256)


def snippet(text: Column, terms: Column, width: int = 200) -> Column:
    """TX-4: a stretch around the first term found, terms in bold; else the text's beginning."""
    low = F.lower(text)
    spots = F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0)
    first = F.coalesce(F.array_min(spots), F.lit(0))
    part = F.substring(text, F.greatest(first - width // 2, F.lit(1)), F.lit(width))
    pattern = F.concat(F.lit("(?iU)(?<![\\p{L}\\p{N}])("), F.array_join(F.transform(terms, lambda t: F.regexp_replace(t, "([^\\p{L}\\p{N} ])", "\\\\$1")), "|"), F.lit(")(?![\\p{L}\\p{N}])"))
    return F.when(first > 0, F.regexp_replace(part, pattern, F.lit("<b>$1</b>"))).otherwise(F.substring(text, 1, width))


def metadata_split(metadata: Column) -> Column:
    """TX-9: struct (editable, machine) of a JSON object's text: scalar values as text, and nested
    values as JSON."""
    keys = F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>"))
    parsed, kinds = F.from_json(metadata, "map<string,string>"), F.from_json(metadata, "map<string,variant>")
    pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(parsed, k).alias("value"), F.schema_of_variant(F.try_element_at(kinds, k)).alias("kind")))
    nested = lambda p: F.coalesce(p["kind"].startswith("ARRAY") | p["kind"].startswith("OBJECT"), F.lit(False))
    plain = lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))
    parts = [F.map_from_entries(F.transform(F.filter(pairs, keep), plain)) for keep in (lambda p: ~nested(p), nested)]
    return F.struct(parts[0].alias("editable"), parts[1].alias("machine"))
