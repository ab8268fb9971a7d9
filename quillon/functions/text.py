"""Text expressions, all as Columns. Offsets are code points; `(?U)` makes Java's classes Unicode-aware."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.shipping import packaged

ASCII_WORD = "[A-Za-z]+(?:['’][A-Za-z]+)?"
TERM = "(?U)[^\\W_]+(?:['’][^\\W_]+)?"
CORPUS_TOKEN = "(?U)\\w+"
SENTENCE = "(?Usd)\\S(?:.*?\\S)?(?:[.!?]+(?=\\s|$)|$)"


def column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def casefold(x) -> Column:
    """lower, with sharp s spelled out: equal to full case folding on Latin and Cyrillic text."""
    return F.replace(F.lower(column(x)), F.lit("ß"), F.lit("ss"))


def find_all(x, pattern: str) -> Column:
    return F.regexp_extract_all(column(x), F.lit(pattern), F.lit(0))


def ascii_words(x) -> Column:
    return find_all(x, ASCII_WORD)


def terms(x) -> Column:
    """Case-folded words of three letters or more that aren't all digits."""
    return F.filter(find_all(casefold(x), TERM), lambda t: (F.length(t) >= 3) & ~t.rlike("^\\p{Nd}+$"))


def corpus_tokens(x) -> Column:
    return find_all(casefold(x), CORPUS_TOKEN)


def sentences(x) -> Column:
    """Spans that end in . ! or ? before white space, or at the end, and hold an ASCII word."""
    return F.filter(find_all(x, SENTENCE), lambda s: s.rlike(ASCII_WORD))


def squeeze(x) -> Column:
    """White space runs become one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(column(x), "(?U)\\s+", " "), "^ | $", "")


def truncated(x, limit: int) -> Column:
    """Squeezed text of at most limit characters; a cut one ends in an ellipsis."""
    whole = squeeze(x)
    return F.when(F.length(whole) > limit, F.concat(F.rtrim(F.left(whole, F.lit(limit - 1))), F.lit("…"))).otherwise(whole)


def language(x) -> Column:
    """The primary subtag, lower case; null if blank."""
    first = F.element_at(F.split(F.lower(F.trim(column(x))), "-"), 1)
    return F.nullif(first, F.lit(""))


def is_english(x) -> Column:
    return column(x).rlike("(?i)^en($|-)")


def suspicious_characters(x) -> Column:
    """Replacement characters, controls other than line ends and tabs, lone surrogates."""
    return F.regexp_count(column(x), F.lit("�|[\\p{Cc}\\p{Cs}&&[^\\n\\r\\t]]"))


def is_readable(x) -> Column:
    text = F.trim(column(x))
    return (F.length(text) > 0) & (suspicious_characters(text) <= F.greatest(F.lit(2), F.floor(F.length(text) / 200)))


def normalize_lines(x) -> Column:
    """Line ends become \\n; trailing blanks of lines and blanks at both ends go."""
    unix = F.regexp_replace(column(x), "\\r\\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unix, "(?U)[^\\S\\n]+(?=\\n|$)", ""), "(?U)^\\s+|\\s+$", "")


def extracted_text(x) -> Column:
    """Blanks within lines become one space, blank lines one, and none stay at the ends."""
    lines = F.regexp_replace(F.regexp_replace(column(x), "[\\t ]+", " "), " ?\\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def context(text, start, end, width: int = 120) -> Column:
    """The characters around [start, end), width on either side."""
    lead = F.greatest(F.lit(0), column(start) - width)
    return F.substring(column(text), lead + 1, column(end) + width - lead)


def context_start(start, width: int = 120) -> Column:
    return F.greatest(F.lit(0), column(start) - width)


def is_heading(line) -> Column:
    """One line of 1 to 18 words and at most 180 characters that doesn't end like a sentence; a colon only if short."""
    x = F.trim(column(line))
    n = F.size(find_all(x, "(?U)\\b[\\w'-]+\\b"))
    return (
        ~F.contains(x, F.lit("\n"))
        & n.between(1, 18)
        & (F.length(x) <= 180)
        & ~x.rlike("[.!;]$")
        & (~x.rlike(":$") | (F.length(x) <= 80))
    )


def html_unescaped(x) -> Column:
    out = column(x)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def html_main_text(x) -> Column:
    """Text of a page without scripts, styles, navigation and comments; blocks end in line breaks."""
    out = F.regexp_replace(column(x), "(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|form|noscript)\\b.*?</\\1\\s*>", " ")
    out = F.regexp_replace(out, "(?i)<br\\s*/?>|</(p|div|li|h[1-6]|tr|section|article|ul|ol|table)\\s*>", "\n")
    return extracted_text(html_unescaped(F.regexp_replace(out, "(?s)<[^>]+>", "")))


def video_id(url) -> Column:
    """The eleven-character id of an https video address on one of four hosts, else null."""
    u = column(url)
    host, path = F.lower(F.try_parse_url(u, F.lit("HOST"))), F.try_parse_url(u, F.lit("PATH"))
    long = host.isin("youtube.com", "www.youtube.com", "m.youtube.com")
    query = F.try_parse_url(u, F.lit("QUERY"), F.lit("v"))
    id_ = (
        F.when(long & path.isin("/watch", "/watch/"), query)
        .when(long, F.regexp_extract(path, "^/(?:shorts|live)/([^/]+)/?$", 1))
        .when(host == "youtu.be", F.regexp_extract(path, "^/([^/]+)/?$", 1))
    )
    return F.when(u.startswith("https://") & id_.rlike("^[A-Za-z0-9_-]{11}$"), id_)


def is_language_tag(x) -> Column:
    """A simple BCP-47 tag: a language of two or three letters (or up to eight), then subtags of letters and digits."""
    return F.coalesce(column(x).rlike("^[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*$"), F.lit(False))


def is_digest(x) -> Column:
    """A SHA-256 in lower-case hexadecimal."""
    return F.coalesce(column(x).rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_source_id(x) -> Column:
    return F.coalesce(column(x).rlike("^[a-z0-9][a-z0-9._-]{0,99}$"), F.lit(False))


def is_revision(x) -> Column:
    """A full revision id of a repository."""
    return F.coalesce(column(x).rlike("^[0-9a-f]{40}$"), F.lit(False))


def command(x) -> tuple[Column, Column]:
    """Command (without a bot's name, case-folded) and argument of a message like /name@bot argument; nulls for other messages."""
    text = F.regexp_replace(column(x), "^\\s+|\\s+$", "")
    is_command = text.startswith("/")
    first = F.regexp_extract(text, "^/([^\\s@]*)", 1)
    rest = F.regexp_extract(text, "(?s)^\\S+\\s+(.*)$", 1)
    return F.when(is_command, casefold(first)), F.when(is_command & text.rlike("^\\S+\\s+\\S"), rest)


def unicode_form(x, form: str) -> Column:
    """Text in a Unicode normal form (NFC, NFD, NFKC, NFKD). ASCII text is in all of them and never leaves the JVM."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no normal form {form!r}")

    def normalize(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    packaged()
    text = column(x)
    ascii_ = text.rlike("\\A\\p{ASCII}*\\z")
    return F.when(ascii_, text).otherwise(F.arrow_udf(normalize, StringType())(F.when(~ascii_, text)))


def canonical_mention(x) -> Column:
    """NFKC, white space squeezed, case folded: the form by which mentions are compared."""
    return casefold(squeeze(unicode_form(x, "NFKC")))


def stored_text(x) -> tuple[Column, Column]:
    """NFC text with line ends as \\n, and the problem that keeps it from being stored: a NUL character, or nothing to read."""
    text = F.regexp_replace(unicode_form(x, "NFC"), "\r\n?", "\n")
    issue = F.when(F.contains(text, F.lit("\0")), "nul_character").when(~F.coalesce(text.rlike("\\S"), F.lit(False)), "blank")
    return F.when(issue.isNull(), text), issue
