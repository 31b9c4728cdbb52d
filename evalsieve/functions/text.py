"""Column -> Column functions over text: words, grams, fingerprints, normalisation. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values

PUNCTUATION = "[^\\p{L}\\p{N}_\\s]"


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: as a lambda's variable it isn't repeated wherever body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Split at white space; no empty words, so blank or empty text has none. Null stays null."""
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Lower-cased words without punctuation."""
    return words(F.regexp_replace(F.lower(text), PUNCTUATION, ""))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def grams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by blanks; none if there are fewer than n words."""

    def of(w: Column) -> Column:
        last = F.size(w) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    return bound(tokens, of)


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the lower-cased, collapsed text."""
    return F.sha2(F.lower(collapsed(text)), 256)


def catalog_grams(text: Column, n: int = 8) -> Column:
    """MD5 of each n-gram of the words without punctuation; repeats stay."""
    return F.transform(grams(plain_words(text), n), F.md5)


def gram_count(text: Column, n: int = 8) -> Column:
    """How many n-grams catalog_grams gives, without making them."""
    return F.greatest(F.size(plain_words(text)) - (n - 1), F.lit(0)).cast("long")


def gram_keys(text: Column, n: int = 8) -> Column:
    """A key of two hashes, 96 bits in all, for each of catalog_grams' n-grams: to join corpora without making texts of them."""

    def of(w: Column) -> Column:
        last = F.size(w) - n
        key = lambda i: bound(F.slice(w, i + 1, n), lambda g: F.struct(F.xxhash64(g).alias("h"), F.hash(g).alias("k")))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), key)).otherwise(F.array().cast("array<struct<h:bigint,k:int>>"))

    return bound(plain_words(text), of)


def index_grams(text: Column, n: int = 6) -> Column:
    """The first eight hex digits of the MD5 of each distinct n-gram; punctuation stays."""
    return F.transform(F.array_distinct(grams(words(F.lower(text)), n)), lambda g: F.substring(F.md5(g), 1, 8))


def content_words(text: Column) -> Column:
    """Distinct words of three letters or more that are no stop words."""
    stop = F.array(*map(F.lit, values.STOP_WORDS))
    return F.array_distinct(F.filter(plain_words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def without_negation(text: Column) -> Column:
    negation = F.array(*map(F.lit, values.NEGATION_WORDS))
    return F.filter(words(F.lower(text)), lambda w: ~F.array_contains(negation, w))


def has_negation(text: Column) -> Column:
    return F.arrays_overlap(words(F.lower(text)), F.array(*map(F.lit, values.NEGATION_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""

    def of(both: Column) -> Column:
        union = F.size(F.array_union(both["a"], both["b"]))
        return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both["a"], both["b"])) / union)

    return bound(F.struct(a.alias("a"), b.alias("b")), of)


def share_in(a: Column, b: Column) -> Column:
    """Share of a's distinct elements that b has; 0 if a is empty."""

    def of(distinct: Column) -> Column:
        return F.when(F.size(distinct) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(distinct, b)) / F.size(distinct))

    return bound(F.array_distinct(a), of)


def normal_answer(text: Column) -> Column:
    """Lower case, no closing marks, first line, up to the first full stop."""
    marks = F.regexp_replace(F.regexp_replace(F.lower(text), "^\\s+|\\s+$", ""), "[.,;:!?]+$", "")
    return F.trim(F.substring_index(F.substring_index(marks, "\n", 1), ".", 1))


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    return sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def pattern_hits(text: Column, patterns: list[str]) -> Column:
    low = F.lower(text)
    return sum((low.rlike(p).cast("int") for p in patterns), F.lit(0))


def element_texts(html: Column, tag: str, name: str) -> Column:
    """The raw insides of the elements <tag class="... name ...">, elements of the same tag within them included.

    Opening and closing tags are walked in order: the depth rises and falls, and an element that begins while no other
    is open ends where the depth is back at nought (or with the page). Those inside another one are part of it.
    """
    mark = f"(?is)<{tag}\\b[^>]*>|</{tag}\\s*>"
    class_has = f"(?is)^<{tag}\\b[^>]*\\bclass\\s*=\\s*[\"']([^\"']*\\s)?{name}(\\s[^\"']*)?[\"']"
    tags, between = F.regexp_extract_all(html, F.lit(mark), F.lit(0)), F.split(html, mark)
    steps = F.zip_with(tags, F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(0))), lambda t, after: F.struct(t.alias("tag"), after.alias("after")))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, x: Column) -> Column:
        closes = F.startswith(x["tag"], F.lit("</"))
        inside = state["depth"] > 0
        begins = ~inside & ~closes & F.regexp_like(x["tag"], F.lit(class_has))
        depth = F.when(inside, state["depth"] + F.when(closes, -1).otherwise(1)).when(begins, 1).otherwise(0)
        ends = inside & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            F.when(ends, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
            F.when(begins, x["after"]).when(ends, F.lit("")).when(inside, F.concat(state["open"], x["tag"], x["after"])).otherwise(F.lit("")).alias("open"),
        )

    return F.aggregate(steps, start, step, lambda s: F.when(s["depth"] > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def without_markup(text: Column) -> Column:
    """Without [[..]], {{..}} and <tags>, collapsed."""
    for pattern in ("\\[\\[.*?\\]\\]", "\\{\\{.*?\\}\\}", "<[^>]+>"):
        text = F.regexp_replace(text, pattern, "")
    return collapsed(text)


def sentences(text: Column) -> Column:
    return F.split(text, "(?<=[.!?])\\s+")


def sentences_with(text: Column, stems: list[str], most: int) -> Column:
    """The first sentences that hold one of stems."""
    return F.slice(F.transform(F.filter(sentences(text), lambda s: any_of(F.lower(s), stems)), F.trim), 1, most)


def any_of(low: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(low, F.lit(p))
    return found


def math_subject(text: Column) -> Column:
    out = F.lit("general")
    for subject, found in reversed(values.MATH_SUBJECTS.items()):
        out = F.when(any_of(F.lower(text), found), subject).otherwise(out)
    return out


def prefix_and_rest(text: Column) -> tuple[Column, Column]:
    """The first third of the words (three at least) and the rest; null below five words."""
    cut = lambda w: F.greatest(F.lit(3), F.floor(F.size(w) / 3).cast("int"))
    prefix = lambda w: F.when(F.size(w) >= 5, F.array_join(F.slice(w, 1, cut(w)), " "))
    rest = lambda w: F.when(F.size(w) >= 5, F.array_join(F.slice(w, cut(w) + 1, F.size(w)), " "))
    return bound(words(text), prefix), bound(words(text), rest)


def bigrams(text: Column) -> Column:
    return F.array_distinct(grams(words(F.lower(text)), 2))


def without_fence(text: Column) -> Column:
    """The inside of a Markdown code fence, or the text itself."""
    t = F.trim(text)
    inside = F.regexp_replace(F.regexp_replace(t, "^```[^\\n]*\\n?", ""), "\\n?\\s*```\\s*$", "")
    return F.when(F.startswith(t, F.lit("```")), inside).otherwise(t)


def json_text(text: Column) -> Column:
    """The JSON that a model's answer holds: all of it, what a fence holds, or first to last brace; null if none parses."""
    braces = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    out = F.lit(None).cast("string")
    for candidate in (braces, without_fence(text), F.trim(text)):
        out = F.when(F.try_parse_json(candidate).isNotNull() & (candidate != ""), candidate).otherwise(out)
    return out


def format_reward(text: Column) -> Column:
    """1 for JSON, 0.3 for text with braces, else 0."""
    inside = without_fence(text)
    return F.when(F.try_parse_json(inside).isNotNull() & (inside != ""), 1.0).when(F.contains(inside, F.lit("{")) & F.contains(inside, F.lit("}")), 0.3).otherwise(0.0)


def year_of_venue(venue: Column) -> Column:
    return F.coalesce(F.regexp_extract(venue, "/([0-9]{4})(?:/|$)", 1).try_cast("int"), F.lit(0))
