"""Text columns: cleaning, lines, chunks, terms and token estimates. All built-in expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evipack.schema import DEFAULTS

# Words that say nothing about a task, short words that do, and spellings of one word.
STOPWORDS = (
    "the", "and", "for", "what", "which", "who", "how", "did", "does", "was", "were", "are", "with", "from", "that",
    "this", "into", "about", "when", "where", "why", "has", "have", "had", "its", "any", "his", "her", "been",
    "will", "many", "much", "last", "year", "today", "yesterday", "currently", "out", "off", "some", "also", "over",
    "there", "their", "they", "them", "than", "then",
)
KEEP_SHORT = ("fy", "q1", "q2", "q3", "q4", "ai", "5g")
ALIASES = {"full-year": "fy", "fiscal": "fy"}
#: Letters, numbers and underscores of any script, with inner dots and hyphens.
TERM = r"[\p{L}\p{N}_][\p{L}\p{N}_.\-]*"


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it is mentioned in lambdas."""
    return F.transform(F.array(value), use)[0]


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_boilerplate(text: Column, rules: list[str]) -> Column:
    """Each rule's matches become one blank, in the order of the rules; then runs of blanks and tabs shrink to one."""
    cleaned = reduce(lambda t, rule: F.regexp_replace(t, rule, " "), rules, text)
    if rules:  # most texts match none, and to search one costs less than to copy it
        cleaned = F.when(reduce(lambda a, b: a | b, [text.rlike(rule) for rule in rules]), cleaned).otherwise(text)
    return F.regexp_replace(cleaned, r"[ \t]{2,}|\t", " ")  # a single blank stays as it is


def lines(text: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")


def chunk_lines(paragraphs: Column, limit: int = DEFAULTS.chunk_chars) -> Column:
    """Paragraphs packed greedily: one more is added while both lengths stay within the limit; none is ever split."""
    kind = "struct<done:array<string>,cur:string>"
    start = F.struct(F.array().alias("done"), F.lit("").alias("cur")).cast(kind)

    def add(s: Column, p: Column) -> Column:
        full = (s.cur != "") & (F.length(s.cur) + F.length(p) > limit)
        done = F.when(full, F.array_append(s.done, s.cur)).otherwise(s.done)
        joined = F.when(full | (s.cur == ""), p).otherwise(F.concat(s.cur, F.lit("\n"), p))
        return F.struct(done.alias("done"), joined.alias("cur")).cast(kind)

    return F.aggregate(paragraphs, start, add, lambda s: F.when(s.cur == "", s.done).otherwise(F.array_append(s.done, s.cur)))


def chunks(text: Column, limit: int = DEFAULTS.chunk_chars) -> Column:
    return chunk_lines(lines(text), limit)


def terms(text: Column) -> Column:
    """Lower-case words longer than two letters or known short ones, without stop words; spellings unified. May repeat."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    kept = F.filter(words, lambda t: ((F.length(t) > 2) | t.isin(*KEEP_SHORT)) & ~t.isin(*STOPWORDS))

    def unified(t: Column) -> Column:
        known = None
        for spelling, word in ALIASES.items():
            known = F.when(t == spelling, word) if known is None else known.when(t == spelling, word)
        return known.otherwise(t)

    return F.transform(kept, unified)


def tokens(text: Column) -> Column:
    return (F.floor(F.length(text) / 4) + 1).cast("int")


def quote(text: Column) -> Column:
    return F.substring(text, 1, DEFAULTS.quote_chars)


def record_text(title: Column, summary: Column, metrics: Column, organizations: Column, people: Column, technologies: Column) -> Column:
    """Title, summary and the lists that are not empty, each as a sentence."""

    def part(label: str, items: Column, sep: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, sep), F.lit(".")))

    return F.concat_ws(
        " ", F.concat(title, F.lit(".")), summary, part("Key metrics", metrics, "; "),
        part("Organizations", organizations, ", "), part("People", people, ", "), part("Technologies", technologies, ", "),
    )


def content_hash(title: Column, content: Column, observed: Column, precision: Column, scope: Column, confidence: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (title, content, observed, precision, scope, confidence)]
    return F.sha2(F.concat_ws("|", *parts), 256)
