"""Text functions as native columns: they stay in the JVM and inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

#: A maximal run of word characters and hyphens that begins and ends with a word character.
RUN = r"[\p{L}\p{N}_]+(?:-+[\p{L}\p{N}_]+)*"
WORD = r"[\p{L}\p{N}_]+"
#: The line ends that count: carriage return with or without line feed, and the rarer separators.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether one of ``words`` is a substring."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column, preserved: Iterable[str] = K.PRESERVED_TERMS) -> Column:
    """Distinct index tokens: preserved substrings, runs, and their pieces at ``-`` and ``_``, longer than one character."""
    low = F.lower(text)

    def of(x: Column) -> Column:
        kept = F.filter(F.array(*[F.lit(t) for t in preserved]).cast("array<string>"), lambda t: F.contains(x["low"], t))

        def pieces(mark: str) -> Column:
            return F.flatten(F.transform(F.filter(x["runs"], lambda w: F.contains(w, F.lit(mark))), lambda w: F.split(w, mark)))

        return F.array_distinct(F.filter(F.concat(kept, x["runs"], pieces("-"), pieces("_")), lambda t: F.length(t) > 1))

    # a lambda over one element binds the runs: the pattern is matched once a row
    return F.element_at(F.transform(F.array(F.struct(low.alias("low"), all_matches(low, RUN).alias("runs"))), of), 1)


def normalize_query(text: Column) -> Column:
    """Lower case, marks but hyphens to spaces, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", " "), r"\s+", " "))


def query_hash(text: Column) -> Column:
    return F.sha2(normalize_query(text), 256)


def exact_phrase(query: Column, content: Column) -> Column:
    """Whether the query is a substring, without case; an empty query always is."""
    return F.contains(F.lower(content), F.lower(query))


def word_set(text: Column) -> Column:
    return F.array_distinct(all_matches(F.lower(text), WORD))


def set_overlap(q: Column, c: Column) -> Column:
    """Jaccard similarity of two sets; 0 if the first is empty."""
    both = F.size(F.array_intersect(q, c))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(both / (F.size(q) + F.size(c) - both))


def overlap(query: Column, content: Column) -> Column:
    """Jaccard similarity of the distinct words; 0 for an empty query."""
    return set_overlap(word_set(query), word_set(content))


def quality(content: Column, min_length: int = 50) -> Column:
    """Length, variety of characters and variety of words; 0 for an empty text, else 0.1 at least."""
    n = F.length(content)
    chars = F.size(F.array_distinct(F.filter(F.split(F.lower(content), ""), lambda c: c != "")))
    words = F.filter(F.split(content, r"\s+"), lambda w: w != "")
    short = F.when(n < min_length, n / F.lit(float(min_length))).otherwise(1.0)
    variety = F.least(chars / F.least(n, F.lit(100)) * 2, F.lit(1.0))
    diversity = F.when(F.size(words) > 5, 0.7 + 0.3 * (F.size(F.array_distinct(words)) / F.size(words))).otherwise(1.0)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(short * variety * diversity, F.lit(0.1)))


def classify(query: Column) -> Column:
    """The first class of the ladder with a matching keyword."""
    low, out = F.lower(query), None
    for name, words in K.QUERY_CLASSES:
        out = F.when(any_of(low, words), name) if out is None else out.when(any_of(low, words), name)
    return out.otherwise(K.DEFAULT_CLASS)


def stem_title(stem: Column) -> Column:
    """A file's stem as a title; letters after any other character are capitals."""
    spaced = F.translate(stem, "-_", "  ")
    return F.initcap(spaced)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def title(content: Column, path: Column) -> Column:
    """First H1, else the front matter's title, else the file's stem."""
    h1 = F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1)
    front = F.regexp_extract(content, r"(?s)(?:^|\n)---\s*\n(.*?)\n---", 1)
    named = F.trim(F.regexp_extract(front, r"(?m)^title:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1))
    return F.coalesce(F.nullif(F.trim(h1), F.lit("")), F.nullif(named, F.lit("")), stem_title(stem(path)))


def category(path: Column, ladder: Iterable[tuple[str, str]] = K.CATEGORIES) -> Column:
    """Category of the first path part that holds a key; keys in order within a part."""

    def of(part: Column) -> Column:
        out = None
        for key, value in ladder:
            hit = F.contains(F.lower(part), F.lit(key))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    found = F.filter(F.transform(F.split(path, "/"), of), lambda c: c.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("general"))


def doc_type(content: Column, path: Column) -> Column:
    low = F.lower(content)
    return (
        F.when(any_of(low, K.TUTORIAL_WORDS), "tutorial")
        .when(suffix(path).isin(".yaml", ".yml"), "config")
        .when(any_of(low, K.REFERENCE_WORDS), "reference")
        .when(any_of(low, K.GUIDE_WORDS), "guide")
        .when(any_of(low, K.CONCEPT_WORDS), "concept")
        .otherwise("guide")
    )


def tags(content: Column, terms: Iterable[str] = K.TAG_TERMS, most: int = 10) -> Column:
    """At most ten terms that occur, in alphabetical order."""
    low = F.lower(content)
    return F.slice(F.array_sort(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))), 1, most)


def source_url(source: Column, path: Column, base: str, known: str = "kubernetes") -> Column:
    """Documentation URL for one known source with a file, else null."""
    plain = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    return F.when((F.lower(source) == known) & (path != ""), F.concat(F.lit(base + "/"), plain, F.lit("/")))


def preview(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def lines(text: Column) -> Column:
    """Lines without a trailing empty one."""
    parts = F.split(text, LINE_END)
    last = F.element_at(parts, -1)
    return F.when(last == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def ensure_h1(name: Column, text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"^\s*#")), text).otherwise(F.concat(F.lit("# "), name, F.lit("\n\n"), text))


# replies of language models -----------------------------------------------------------------------


def json_nodes(reply: Column) -> Column:
    """Ids of the first flat object with ``relevant_nodes``, else of the whole reply, else none; falsy ids drop."""
    block = F.regexp_extract(reply, r'(?s)\{[^{}]*"relevant_nodes"[^{}]*\}', 0)

    def ids(text: Column) -> Column:
        return F.from_json(text, "relevant_nodes array<string>")["relevant_nodes"]

    got = F.coalesce(ids(F.nullif(block, F.lit(""))), ids(F.trim(reply)), F.array().cast("array<string>"))
    return F.filter(got, lambda x: x.isNotNull() & ~x.isin("", "0", "false", "null"))


def json_list(reply: Column) -> Column:
    """The reply as a list, else its first [...], else its quoted strings of ten or more characters, else null."""

    def parsed(text: Column) -> Column:
        found = F.from_json(F.when(F.regexp_like(text, F.lit(r"(?s)^\s*\[.*\]\s*$")), text), "array<string>")
        return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))

    block = F.regexp_extract(reply, r"(?s)\[.*?\]", 0)
    quoted = F.regexp_extract_all(reply, F.lit('"([^"]{10,})"'), F.lit(1))
    return F.coalesce(parsed(F.trim(reply)), parsed(block), F.when(F.size(quoted) > 0, quoted))


def json_check(reply: Column) -> Column:
    """``(complete, confidence, gaps)`` of a self-check reply; anything unreadable passes as complete, 0.5, no gaps."""
    schema = "complete boolean, confidence double, gaps array<string>, _bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}

    def parsed(text: Column) -> Column:
        got = F.from_json(F.when(F.regexp_like(text, F.lit(r"(?s)^\s*\{.*\}\s*$")), text), schema, options)
        return F.when(got.isNotNull() & got["_bad"].isNull(), F.struct(F.coalesce(got["complete"], F.lit(True)).alias("complete"), F.coalesce(got["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(got["gaps"], F.array().cast("array<string>")).alias("gaps")))

    block = F.regexp_extract(reply, r"(?s)\{.*?\}", 0)
    flag = F.lower(F.regexp_extract(reply, r'(?i)"complete"\s*:\s*(true|false)', 1))
    number = F.regexp_extract(reply, r'"confidence"\s*:\s*([\d.]+)', 1).try_cast("double")
    gap_text = F.regexp_extract(reply, r'(?s)"gaps"\s*:\s*\[(.*?)\]', 1)
    keyed = F.when(flag != "", F.struct((flag == "true").alias("complete"), F.coalesce(number, F.lit(0.5)).alias("confidence"), F.regexp_extract_all(gap_text, F.lit('"([^"]+)"'), F.lit(1)).alias("gaps")))
    passed = F.struct(F.lit(True).alias("complete"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("gaps"))
    got = F.coalesce(parsed(F.trim(reply)), parsed(block), keyed, passed)
    return F.struct(
        got["complete"].alias("complete"),
        clamp(got["confidence"]).alias("confidence"),
        F.filter(F.transform(got["gaps"], lambda g: F.trim(g)), lambda g: g.isNotNull() & (g != "")).alias("gaps"),
    )


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def json_score(reply: Column, key: str = "score", fallback: float = 0.5) -> Column:
    """A score within 0..1 from the whole reply, else its first {...}, else a pattern, else the fallback."""

    def parsed(text: Column) -> Column:
        whole = F.when(F.regexp_like(text, F.lit(r"(?s)^\s*\{.*\}\s*$")), text)
        got = F.from_json(whole, f"`{key}` string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        return F.when(got.isNotNull() & got["_bad"].isNull(), F.coalesce(got[key].try_cast("double"), F.when(got[key].isNull(), F.lit(fallback))))

    block = F.regexp_extract(reply, r"(?s)\{.*?\}", 0)
    number = F.regexp_extract(reply, rf'(?i)"{key}"\s*:\s*([\d.]+)', 1).try_cast("double")
    return clamp(F.coalesce(parsed(F.trim(reply)), parsed(block), number, F.lit(fallback)))


def json_reason(reply: Column, key: str = "reason") -> Column:
    return F.regexp_extract(reply, rf'(?is)"{key}"\s*:\s*"([^"]*)"', 1)


# evaluation ---------------------------------------------------------------------------------------


def hits(text: Column, terms: Column) -> Column:
    """The terms that occur in the text, without case."""
    low = F.lower(text)
    return F.filter(terms, lambda t: F.contains(low, F.lower(t)))


def rule_quality(answer: Column, good: Column, bad: Column) -> Column:
    """(good - bad matches) / good terms within 0..1; 0 without good terms."""
    score = (F.size(hits(answer, good)) - F.size(hits(answer, bad))) / F.size(good)
    return F.when(F.size(good) > 0, clamp(score)).otherwise(0.0)
