"""Text functions.  All are native columns but NFKC, which Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import batches as B

#: What counts as white space, for Java and RE2 alike (Java's \s is ASCII only).
SPACE = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
QUERY_TOKEN = r"[\p{L}\p{N}_]+"
INDEX_TOKEN = r"[\p{L}\p{N}]+"

#: Words that queries drop.
STOPWORDS = (
    "a an and are as at be by did do does for from how in is it of on or that the this to "
    "was were what when where which who with"
).split()


#: The characters of SPACE.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The words between white space; none for null or empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def has_words(text: Column, n: int) -> Column:
    """Whether there are n words or more; reads no further than to the n-th."""
    other = f"[^{SPACE[1:-1]}]"
    return F.coalesce(text, F.lit("")).rlike(rf"\A{SPACE}*+(?:{other}++{SPACE}++){{{n - 1}}}{other}")


@F.arrow_udf(T.StringType())
def nfkc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """By parts of a bounded size: a batch never stands in memory as Python strings, nor a second time as Arrow."""
    for batch in texts:
        for row, end in B.spans(batch):
            yield pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in batch.slice(row, end - row).to_pylist()], pa.string())
        del batch
        B.release()


def tidy(text: Column) -> Column:
    """NUL dropped, runs of spaces and tabs made one space, three and more newlines made two, ends stripped."""
    text = F.replace(text, F.lit("\0"), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def clean_text(text: Column) -> Column:
    return tidy(nfkc(text))


def repeat_key(paragraph: Column) -> Column:
    """Running lines that differ in numbers only share a key."""
    return strip(F.regexp_replace(F.lower(paragraph), r"\p{Nd}+", "#"))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), f"\n{SPACE}*\n"), strip), lambda p: p != "")


def _folding() -> tuple[str, str]:
    """Letters of the Latin blocks whose canonical decomposition is a letter and marks, and that letter."""
    pairs = []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def fold(text: Column) -> Column:
    """Lower case without diacritics; combining marks go, letters of their own such as sharp s stay."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}+", "")


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(INDEX_TOKEN), F.lit(0))


def joined_tokens(text: Column) -> Column:
    """index_tokens as one text with a space between them, which goes to Python as one value."""
    return F.array_join(index_tokens(text), " ")


def query_tokens(query: Column) -> Column:
    """Distinct tokens in order of first use, stopwords dropped; distinct by surface, so two forms of a stem both count."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(QUERY_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(STOPWORDS)))


def citation(doc_name: Column, page: Column, section: Column) -> Column:
    """The page if there is one, else a section that is not empty, else the name alone."""
    return (
        F.when(page.isNotNull(), F.concat(doc_name, F.lit(", p. "), page.cast("string")))
        .when(F.coalesce(section, F.lit("")) != "", F.concat(doc_name, F.lit(", § "), section))
        .otherwise(doc_name)
    )


def content_id(content: Column) -> Column:
    """Documents are named by their content: the first 12 hex digits of its SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 12)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.format_string("%s:%04d", doc_id, index)


def base_name(path: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_extract(path, "[^/]+$", 0), F.lit("+"), F.lit("%2B")))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def preview(text: Column, n: int, one_line: bool = False) -> Column:
    short = F.substring(text, 1, n)
    short = F.replace(short, F.lit("\n"), F.lit(" ")) if one_line else short
    return F.when(F.char_length(text) > n, F.concat(short, F.lit("..."))).otherwise(short)


def label(field: Column) -> Column:
    return F.initcap(F.replace(field, F.lit("_"), F.lit(" ")))


def shown(value: Column) -> Column:
    return F.when(F.coalesce(value.cast("string"), F.lit("")) == "", F.lit("—")).otherwise(value.cast("string"))
