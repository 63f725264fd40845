"""Text expressions: pure Column -> Column, evaluated in the JVM.

Offsets and lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.let import let

# --- fixed values -----------------------------------------------------------
# Blank characters of the browser platform (Java's and RE2's \s know only the
# ASCII ones). The class is valid in Java and in RE2.
BLANKS = (
    r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
BLANK_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

TITLE_PREFIXES = (
    "how to ",
    "a guide to ",
    "the best ",
    "what is ",
    "introduction to ",
    "getting started with ",
)

STOP_WORDS = (
    "the", "a", "an", "to", "of", "in", "for", "and", "or",
    "is", "it", "on", "at", "by", "with", "from", "how",
    "what", "which", "this", "that",
)

GENERIC_ANCHORS = (
    "click here",
    "read more",
    "learn more",
    "this article",
    "this page",
    "here",
)

CONTEXT_CHARS = 50
MIN_PHRASE_WORDS = 3
MAX_PHRASE_WORDS = 8
NEAR_EMPTY_WORDS = 50
# ----------------------------------------------------------------------------

_BLANK = f"[{BLANKS}]"
# Characters of Latin text that are in no distinctive word.
_DROPPED = "".join(
    c for c in map(chr, range(0x21, 0x100)) if not (c.isascii() and c.isalnum()) and c not in BLANK_CHARS
)


def trim_blank(c: Column) -> Column:
    """Trim every blank character, not only the ASCII space."""
    return F.trim(c, F.lit(BLANK_CHARS))


def squeeze(c: Column) -> Column:
    """Runs of blanks become one space; ends trimmed."""
    return trim_blank(F.regexp_replace(c, f"{_BLANK}+", " "))


def split_blank(c: Column) -> Column:
    return F.split(c, f"{_BLANK}+")


def word_count(c: Column) -> Column:
    trimmed = trim_blank(c)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(split_blank(trimmed)))


def word_count_untrimmed(c: Column) -> Column:
    """Manifest rule: the text is split as it is, so outer blanks count."""
    return F.when(c == "", F.lit(0)).otherwise(F.size(split_blank(c)))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def strip_title_prefix(c: Column) -> Column:
    """Remove one leading boiler-plate prefix, keeping the case of the rest."""
    return F.regexp_replace(c, "(?i)^(" + "|".join(TITLE_PREFIXES) + ")", "")


def distinctive_words(c: Column) -> Column:
    """Lower-cased ASCII words that are no stop words; repeats are kept."""
    # A regular expression is slow at each match: the common characters go before it.
    plain = F.translate(F.lower(c), BLANK_CHARS[1:] + _DROPPED, " " * (len(BLANK_CHARS) - 1))
    kept = F.regexp_replace(plain, "[^a-z0-9 ]+", "")
    return F.filter(F.split(kept, " "), lambda w: ~w.isin("", *STOP_WORDS))


def _code_unit(n: Column) -> Column:
    """The character with 16-bit code ``n``; a lone surrogate becomes U+FFFD."""
    safe = F.when(n.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(n)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 4, "0")), "UTF-16BE")


def _decode_refs(c: Column, pattern: str, code) -> Column:
    """Replace every numeric reference matching ``pattern`` by its character."""
    refs = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    chars = F.transform(refs, lambda r: F.coalesce(_code_unit(code(r)), F.lit("")))
    pieces = F.split(c, pattern)
    filled = F.concat(chars, F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, filled, lambda p, ch: F.concat(p, ch)), "")


def sanitize_anchor(c: Column) -> Column:
    """Anchor text without markup; empty when it could carry script."""

    def hex_code(r: Column) -> Column:
        return F.conv(F.right(r, F.lit(4)), 16, 10).cast("bigint")

    def dec_code(r: Column) -> Column:
        return (r.try_cast("decimal(38,0)") % 65536).cast("bigint")

    def decoded(pattern: str, code):
        return lambda t: F.when(
            F.contains(t, F.lit("&#")), _decode_refs(t, pattern, code)
        ).otherwise(t)

    def checked(t: Column) -> Column:
        unsafe = (
            t.rlike(f"(?i)javascript{_BLANK}*:")
            | t.rlike(rf"(?i)\bon\w+{_BLANK}*=")
            | t.rlike("[<>]")
        )
        return F.when(unsafe, F.lit("")).otherwise(trim_blank(t))

    bare = F.regexp_replace(c, "<[^>]*>", "")
    hexed = let(bare, decoded("(?i)&#x([0-9a-f]+);", hex_code))
    return let(let(hexed, decoded("&#([0-9]+);", dec_code)), checked)


def bigrams(c: Column) -> Column:
    """Distinct two-character slices."""

    def pairs(chars: Column) -> Column:
        rest = F.size(chars) - 1
        joined = F.zip_with(
            F.slice(chars, F.lit(1), rest), F.slice(chars, F.lit(2), rest), lambda x, y: F.concat(x, y)
        )
        return F.when(rest >= 1, F.array_distinct(joined)).otherwise(
            F.array().cast("array<string>")
        )

    return let(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), pairs)


def bigram_overlap(a: Column, b: Column) -> Column:
    """How many distinct bigrams two texts share."""
    return F.size(F.array_intersect(bigrams(F.lower(a)), bigrams(F.lower(b))))


def dice_of_sets(a: Column, b: Column) -> Column:
    """Dice coefficient of two bigram arrays."""
    total = F.size(a) + F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when(total == 0, F.lit(1.0)).otherwise(
        (2 * shared).cast("double") / F.greatest(total, F.lit(1)).cast("double")
    )


def dice(a: Column, b: Column) -> Column:
    return let(
        F.struct(bigrams(F.lower(a)).alias("a"), bigrams(F.lower(b)).alias("b")),
        lambda s: dice_of_sets(s["a"], s["b"]),
    )


def context_at(body: Column, offset: Column, length: Column) -> Column:
    """The text around ``[offset, offset + length)``, 50 characters each side."""
    start = F.greatest(F.lit(0), offset - CONTEXT_CHARS)
    end = F.least(F.length(body), offset + length + CONTEXT_CHARS)
    return F.substring(body, start + 1, F.greatest(end - start, F.lit(0)))


def find_in_body(body: Column, phrase: Column) -> Column:
    """First case-insensitive hit as struct(offset, context); null when absent."""
    offset = F.position(F.lower(phrase), F.lower(body)) - 1
    return F.when(
        offset >= 0,
        F.struct(
            offset.cast("int").alias("offset"),
            context_at(body, offset, F.length(phrase)).alias("context"),
        ),
    )


def sentences(c: Column) -> Column:
    """Text between runs of ``.``, ``!`` and ``?``, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(c, "[.!?]+"), trim_blank), lambda s: s != "")


_SITE_SUFFIX = f"{_BLANK}*[-|]{_BLANK}*[^-|]+$"


def display_title(c: Column) -> Column:
    """Title without a trailing site name; the title itself if nothing is left."""
    return let(
        trim_blank(F.regexp_replace(c, _SITE_SUFFIX, "")),
        lambda cut: F.when(cut == "", c).otherwise(cut),
    )


def scored_sentences(body: Column) -> Column:
    """Sentences with their distinctive words: computed once per body.

    array<struct<sentence, words>>, to be reused for every target title.
    """
    return F.transform(
        sentences(body),
        lambda s: F.struct(
            s.alias("sentence"), F.array_distinct(distinctive_words(s)).alias("words")
        ),
    )


def best_sentence(scored: Column, title_words: Column) -> Column:
    """struct(score, sentence) of the sentence with most title words, first on ties."""

    def counted(words: Column) -> Column:
        return F.transform(
            scored,
            lambda x, i: F.struct(
                F.size(F.filter(words, lambda w: F.array_contains(x["words"], w))).alias("score"),
                (-i).alias("neg_pos"),
                x["sentence"].alias("sentence"),
            ),
        )

    # Bound here: inside the sentences' lambda the title would be split for each of them.
    return F.array_max(let(title_words, counted))


def best_phrase(sentence: Column, title_words: Column) -> Column:
    """At most eight words of the sentence, where title words are densest."""

    def title_hits(words: Column) -> Column:
        def marks(titled: Column) -> Column:
            return F.transform(
                words,
                lambda w: F.array_contains(
                    titled, F.regexp_replace(F.lower(w), "[^a-z0-9]+", "")
                ).cast("int"),
            )

        return let(title_words, marks)

    def frame(hits: Column, start: Column) -> Column:
        inside = F.slice(hits, start, F.lit(MAX_PHRASE_WORDS))
        return F.struct(
            F.aggregate(inside, F.lit(0), lambda acc, x: acc + x).alias("hits"),
            (-start).alias("neg_start"),
        )

    def densest(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(p["words"]) - MIN_PHRASE_WORDS + 1)
        best = F.array_max(F.transform(starts, lambda s: frame(p["hits"], s)))
        return F.array_join(
            F.slice(p["words"], -best["neg_start"], F.lit(MAX_PHRASE_WORDS)), " "
        )

    return let(
        split_blank(sentence),
        lambda words: F.when(F.size(words) <= MAX_PHRASE_WORDS, sentence).otherwise(
            let(
                F.struct(words.alias("words"), title_hits(words).alias("hits")),
                densest,
            )
        ),
    )


def title_phrase(title: Column) -> Column:
    """Anchor made from the title alone: first eight words, lower-cased."""
    words = split_blank(strip_title_prefix(display_title(title)))
    return F.lower(sanitize_anchor(F.array_join(F.slice(words, 1, MAX_PHRASE_WORDS), " ")))


def semantic_anchor_from(title: Column, scored: Column) -> Column:
    """Anchor for a related target, from pre-split sentences of the source body."""

    def choose(x: Column) -> Column:
        phrase = F.when(
            x["best"]["score"] >= 2, best_phrase(x["best"]["sentence"], x["words"])
        )
        return let(
            phrase,
            lambda p: F.when(F.size(x["words"]) == 0, F.lit(""))
            .when(p != "", sanitize_anchor(p))
            .otherwise(title_phrase(title)),
        )

    return let(
        distinctive_words(display_title(title)),
        lambda words: let(
            F.struct(words.alias("words"), best_sentence(scored, words).alias("best")), choose
        ),
    )


def semantic_anchor(title: Column, body: Column) -> Column:
    return semantic_anchor_from(title, scored_sentences(body))


def is_generic_anchor(c: Column) -> Column:
    return F.lower(c).isin(*GENERIC_ANCHORS)


def near_empty_warning(words: Column, http_status: Column) -> Column:
    return F.when((words < NEAR_EMPTY_WORDS) & (http_status == 200), F.lit("near-empty-body"))


def embed_text(title: Column, body: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), body)


def has_content(title: Column, body: Column) -> Column:
    return trim_blank(F.concat(title, body)) != ""


def sanitize_cell(c: Column) -> Column:
    """A leading formula character is defused with a quote."""
    return F.when(c.rlike(r"\A[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def escape_html(c: Column) -> Column:
    for raw, safe in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#39;"),
    ):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def html_snippet(anchor: Column, url: Column) -> Column:
    return F.concat(
        F.lit('<a href="'), escape_html(url), F.lit('">'), escape_html(anchor), F.lit("</a>")
    )


def file_extension(name: Column) -> Column:
    """Lower-cased from the last dot; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"(?s)(\.[^.]*)\z", 1))
