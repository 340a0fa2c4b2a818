"""Text functions as columns: cleaning, splitting, classifying, measuring.

Words are runs of letters, digits and underscores of any script, in lower case.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"
TAG = r"<[^>]+>"
EMAIL = r"[\w\.-]+@[\w\.-]+"
URL = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"
EMAIL_FORM = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL_FORM = r"^https?://[\w.-]+(:\d+)?(/[^\s]*)?$"
SCIENTIFIC = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"
TITLES = ("Mr", "Mrs", "Dr", "Prof")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def collapsed(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean(text: Column) -> Column:
    """Collapsed, with a double hyphen as a dash."""
    return F.replace(collapsed(text), F.lit("--"), F.lit("—"))


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, for which there is no built-in function."""
    for texts in parts:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def without_special(text: Column, keep: str = ".,!?-") -> Column:
    escaped = "".join("\\" + c for c in keep)
    return F.regexp_replace(text, f"[^a-zA-Z0-9\\s{escaped}]", "")


def without_latex(text: Column) -> Column:
    for pattern in (r"\$[^$]+\$", r"\\\[.*?\\\]", r"\\[a-zA-Z]+\{[^}]*\}"):
        text = F.regexp_replace(text, pattern, "")
    return text


def without_tags(text: Column, by: str = "") -> Column:
    return F.regexp_replace(text, TAG, by)


def mended_breaks(text: Column) -> Column:
    """A line break between lower-case letters becomes a space; three or more breaks become two."""
    return F.regexp_replace(F.regexp_replace(text, r"([a-z])\n([a-z])", "$1 $2"), r"\n{3,}", "\n\n")


def normalized(text: Column) -> Column:
    return collapsed(F.lower(text))


def sanitized(text: Column) -> Column:
    """Without tags and then without signs other than . , ! ? -; runs of spaces that this leaves become one."""
    return collapsed(F.regexp_replace(without_tags(text), r"[^\p{L}\p{N}_\s.,!?-]", ""))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def cleaned_document(text: Column, *, links: bool = True, html: bool = True, markdown: bool = False, numbers: bool = False, lower: bool = False) -> Column:
    if html:
        text = without_tags(text, " ")
    if links:
        text = F.regexp_replace(F.regexp_replace(text, URL, ""), EMAIL, "")
    if markdown:
        text = F.regexp_replace(F.regexp_replace(text, r"(?m)^#+\s*|\*\*|__|`", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")
    if numbers:
        text = F.regexp_replace(text, r"\d+", "")
    return collapsed(F.lower(text) if lower else text)


def sentences(text: Column) -> Column:
    """Parts at white space between . ! or ? and a capital letter. A title's dot ends no sentence and is kept."""
    titled = F.regexp_replace(text, rf"\b({'|'.join(TITLES)})\.", "$1\u0001")
    parts = F.split(titled, r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def is_complete(text: Column) -> Column:
    return F.trim(text).rlike(r"[.!?]\s*$")


def is_balanced(text: Column, strict: bool = False) -> Column:
    """Whether brackets close in order. strict: a text with a quote or an apostrophe is not balanced."""
    signs = F.regexp_extract_all(text, F.lit(r"[()\[\]{}]"), F.lit(0))
    step = lambda stack, c: (
        F.when(stack == "!", stack)
        .when(c.isin("(", "[", "{"), F.concat(stack, c))
        .when(F.concat(F.right(stack, F.lit(1)), c).isin("()", "[]", "{}"), F.substring(stack, F.lit(1), F.length(stack) - 1))
        .otherwise(F.lit("!"))
    )
    balanced = F.aggregate(signs, F.lit(""), step) == ""
    return balanced & ~text.rlike("[\"']") if strict else balanced


def is_valid_chunk(text: Column, least: int = 50) -> Column:
    return (F.trim(text) != "") & (F.length(text) >= least) & is_complete(text) & is_balanced(text)


def metrics(text: Column) -> Column:
    """Struct of characters, words, sentences (parts at . ! ?, a last empty one too) and mean word length."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    total = F.aggregate(parts, F.lit(0), lambda n, w: n + F.length(w))
    return F.struct(
        F.length(text).alias("char_count"),
        F.size(parts).alias("word_count"),
        F.size(F.split(text, "[.!?]+")).alias("sentence_count"),
        F.coalesce(F.try_divide(total, F.size(parts)), F.lit(0.0)).alias("avg_word_length"),
    )


def readability(text: Column) -> Column:
    """Half of what remains of 40 words a sentence plus half of what remains of 10 letters a word."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n_sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != ""))
    letters = F.aggregate(parts, F.lit(0), lambda n, w: n + F.length(w))
    per_sentence = F.coalesce(F.try_divide(F.size(parts), n_sentences), F.lit(0.0))
    per_word = F.coalesce(F.try_divide(letters, F.size(parts)), F.lit(0.0))
    return (F.greatest(F.lit(0.0), 1 - per_sentence / 40) + F.greatest(F.lit(0.0), 1 - per_word / 10)) / 2


def snake_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s-]+", "_"))


def pascal_case(text: Column) -> Column:
    return F.replace(F.initcap(F.regexp_replace(text, r"[\s_-]+", " ")), F.lit(" "), F.lit(""))


def camel_case(text: Column) -> Column:
    pascal = pascal_case(text)
    return F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, F.lit(2), F.length(pascal)))


def truncated(text: Column, n: int, within: bool = True) -> Column:
    """At most n characters with the dots; or, within=False, n characters and the dots."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3 if within else n), F.lit("..."))).otherwise(text)


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL_FORM)


def is_url(text: Column) -> Column:
    return text.rlike(URL_FORM)


def is_scientific(text: Column) -> Column:
    return text.rlike(SCIENTIFIC)


def first_match(text: Column, patterns: Mapping[str, str], default: str) -> Column:
    """Name of the first pattern that occurs."""
    out = None
    for name, pattern in patterns.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return F.lit(default) if out is None else out.otherwise(default)


def stripped_terms(text: Column, drop: Sequence[str], replace: Mapping[str, str]) -> Column:
    """Patterns become spaces, then literals are replaced; trimmed, lower case."""
    for pattern in drop:
        text = F.regexp_replace(text, pattern, " ")
    for old, new in replace.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.lower(F.trim(text))


def half_width(text: Column) -> Column:
    """Full-width forms as ASCII, the ideographic space as a space."""
    return F.translate(text, "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " ")


def highlighted(text: Column, terms: Sequence[str]) -> Column:
    pattern = "(?i)\\b(" + "|".join(terms) + ")\\b"
    return F.regexp_replace(text, pattern, "<em>$1</em>")


def ngrams(tokens: Column, n: int) -> Column:
    """tokens should be a column, not an expression: it is looked at for every gram."""
    many = F.transform(tokens, lambda first, i: F.concat_ws(" ", first, *[F.get(tokens, i + k) for k in range(1, n)]))
    return F.slice(many, F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(0)))


def token_type(token: Column) -> Column:
    return F.when(token.rlike(r"^\d+(\.\d+)?$"), "NUMBER").when(token.rlike(r"^[\p{P}]+$"), "PUNCTUATION").when(token.rlike(r"^[^\p{L}\p{N}\s]+$"), "SPECIAL").when(token.rlike(r"^\s+$"), "SPACE").otherwise("WORD")


def token_weight(token: Column) -> Column:
    kind = token_type(token)
    return F.when(kind == "WORD", 1.5).when(kind == "NUMBER", 1.2).otherwise(1.0) * F.log(F.length(token) + F.lit(1.0))


def tokens(text: Column) -> Column:
    """Words, numbers and signs in order, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\d+(?:\.\d+)?|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))


def filtered_tokens(text: Column, kinds: Sequence[str] | None = None, stop_words: Sequence[str] = (), least: int = 1) -> Column:
    """tokens of at least so many characters, of these kinds (null: of any), that are no stop words."""

    def fine(t: Column) -> Column:
        out = F.length(t) >= least
        out = out & token_type(t).isin(*kinds) if kinds is not None else out
        return out & ~t.isin(*stop_words) if stop_words else out

    return F.filter(tokens(text), fine)


def fine_grained(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Words and numbers of a text, without stop words, as one text."""
    return F.array_join(filtered_tokens(text, ("WORD", "NUMBER"), stop_words), " ")


def grown_keywords(keywords: Column, stop_words: Sequence[str] = (), least: int = 2) -> Column:
    """Keywords, each once, and then the words within them that are not among them."""
    return F.array_union(keywords, F.flatten(F.transform(keywords, lambda k: filtered_tokens(k, ("WORD", "NUMBER"), stop_words, least))))


def tight(text: Column) -> Column:
    """White space as single spaces, trimmed; of null the empty text."""
    return F.coalesce(collapsed(text), F.lit(""))


def is_date(text: Column, form: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(text, F.lit(form)).isNotNull()


#: Characters that keep their order in a text written from right to left (fixed value).
LEFT_TO_RIGHT = r"a-zA-Z0-9 :*./%+-"


def reversed_script(text: Column) -> Column:
    """Characters in reverse order, but runs of LEFT_TO_RIGHT in their own."""
    runs = F.regexp_extract_all(text, F.lit(f"[{LEFT_TO_RIGHT}]+|[^{LEFT_TO_RIGHT}]"), F.lit(0))
    return F.array_join(F.reverse(runs), "")


#: What looks like a numbered point but is none; what is an article's number; signs that no title has (fixed values).
NOT_BULLET = r"^(?:0|[0-9]+ +[0-9~个只-]|[0-9]+\.{2,})"
ARTICLE = r"^第[零一二三四五六七八九十百0-9]+条"
NOT_IN_TITLE = r"[,;，。；！!]"


def not_bullet(line: Column) -> Column:
    return line.rlike(NOT_BULLET)


def not_title(text: Column) -> Column:
    """Whether a line is too long for a title (above 12 words, or 32 characters without a space) or has a sign that no title has; an article's number is a title."""
    long = (F.regexp_count(text, F.lit(r"\S+")) > 12) | (~text.contains(" ") & (F.length(text) >= 32))
    return ~text.rlike(ARTICLE) & (long | text.rlike(NOT_IN_TITLE))


PROTECTED = r"https?://\S+|[\w.-]+@[\w.-]+\.\w+|(?:[A-Z]\.){2,}|\d+(?:[.,]\d+)*|n't|'(?:s|re|ve|ll|d|m)|[\p{L}_]+?(?=n't)|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def word_tokens(text: Column) -> Column:
    """Tokens that keep addresses, acronyms and numbers whole and split contractions."""
    return F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))


def filled(template: str, values: Mapping[str, Column], required: Sequence[str] = ()) -> Column:
    """A template's ${name} replaced by columns."""
    missing = [r for r in required if r not in values]
    if missing:
        raise ValueError(f"missing: {missing}")
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("${" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def numbered(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("Chunk "), (i + 1).cast("string"), F.lit(":\n"), c)), "\n\n")


def extract_summary(text: Column, n: int = 3) -> Column:
    parts = F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(F.slice(parts, 1, n), ". ")


def cjk_share(text: Column) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"[\u4e00-\u9fff]")), F.length(text)), F.lit(0.0))


def numeral(text: Column) -> Column:
    """Number that a heading's digits or roman or spelled numeral states; null if none."""
    spelled = F.create_map(*[F.lit(x) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split()) for x in (w, i)])
    roman = F.aggregate(
        F.split(F.reverse(F.upper(text)), ""),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")),
        lambda s, c: F.struct(
            (s["total"] + F.when(_roman(c) < s["last"], -_roman(c)).otherwise(_roman(c))).alias("total"), F.greatest(s["last"], _roman(c)).alias("last")
        ),
    )["total"]
    return F.coalesce(text.try_cast("int"), F.element_at(spelled, F.lower(text)), F.when(F.upper(text).rlike("^[IVXLCDM]+$"), roman))


def _roman(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in (k, v)]), c), F.lit(0))
