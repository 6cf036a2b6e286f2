"""Text, identity and vector functions, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classic English stop list, and the patterns of the data model.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
WORD = r"[\p{L}\p{N}_]{2,}"
BARE_LABEL = r"(?i)^(?:chapter|section|appendix|part)?\s*(?:[0-9]+(?:\.[0-9]+)*|[a-z]\.[0-9]+(?:\.[0-9]+)*)\.?$"
SPACE = r"\s"


def strip(x: Column) -> Column:
    """Without white space at either end (``trim`` takes off blanks only)."""
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column, stop: bool = True) -> Column:
    """Lower-cased words of two characters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS)) if stop else found


def short_hash(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def chunk_id(source_path: Column, heading: Column, offset: Column) -> Column:
    return short_hash(F.concat_ws(":", source_path, heading, offset.cast("string")))


def section_id(source_path: Column, heading_path: Column) -> Column:
    """Of the innermost heading; documents without headings have one section."""
    plain = F.concat(F.lit("unstructured:"), short_hash(source_path))
    return F.when(F.size(heading_path) > 0, short_hash(F.concat_ws(":", source_path, F.element_at(heading_path, -1)))).otherwise(plain)


def public_id(corpus: Column, chunk: Column) -> Column:
    return F.concat_ws(":", corpus, chunk)


def split_public_id(x: Column) -> tuple[Column, Column]:
    """(corpus, chunk id): cut at the last colon, so corpus names may hold some."""
    return F.regexp_extract(x, r"^(.*):([^:]*)$", 1), F.regexp_extract(x, r"^(.*):([^:]*)$", 2)


def summary(heading: Column, text: Column) -> Column:
    """The heading, or else the first two lines with something in them; 200 characters at most."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    first = F.array_join(F.slice(lines, 1, 2), " ")
    return F.substring(F.when(strip(heading) != "", strip(heading)).otherwise(first), 1, 200)


def embedding_text(heading: Column, text: Column, most: int = 500) -> Column:
    """What is embedded of a chunk: its heading and the first ``most`` characters."""
    head = F.substring(text, 1, most)
    return F.when(F.coalesce(strip(heading), F.lit("")) != "", F.concat(strip(heading), F.lit("\n"), head)).otherwise(head)


def location(source_path: Column, heading: Column) -> Column:
    return F.regexp_replace(F.concat(source_path, F.lit("#"), F.coalesce(heading, F.lit(""))), "#+$", "")


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(filename(path), r"^.+(\.[^.]+)$", 1))


def join_hyphenated(x: Column) -> Column:
    return F.regexp_replace(x, r"(?<=[A-Za-z])-\s+(?=[A-Za-z])", "-")


def escape_heading_marks(x: Column) -> Column:
    return F.regexp_replace(x, r"^(#{1,6})(\s)", r"\\$1$2")


def is_bare_label(x: Column) -> Column:
    return x.rlike(BARE_LABEL)


def sanitize_error(x: Column, most: int = 300) -> Column:
    """Absolute paths of two parts or more hidden, length limited."""
    hidden = F.regexp_replace(x, r"(^|\s)/[^\s/]+(?:/[^\s/]+)+/?", "$1[path]")
    return F.when(F.length(hidden) > most, F.concat(F.substring(hidden, 1, most), F.lit("..."))).otherwise(hidden)


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(model), text), 256)


# -- vectors ---------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalized(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / norm))


def token_bucket(token: Column, dims: int) -> Column:
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dims).cast("int")


def token_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 1), 16, 10).cast("int") < 8, F.lit(1.0)).otherwise(F.lit(-1.0))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Signed feature hashing of a text's words to a unit vector: the embedder without a model."""
    marks = F.transform(tokens(text, stop=False), lambda t: F.struct(token_bucket(t, dims).alias("b"), token_sign(t).alias("s")))
    # arrays of one element, so that marks and sums are made once a text
    sums = F.transform(F.array(marks), lambda ms: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(ms, lambda m: m["b"] == i), F.lit(0.0), lambda a, m: a + m["s"])))
    return F.transform(sums, l2_normalized)[0]
