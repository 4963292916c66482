"""Text expressions: all are columns, none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide tokens, keywords and query kinds.
TOKEN = r"(?U)[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\d|\b)|\d+|[a-zA-Z]\w*|[^\s\w]"
IDENTIFIER = r"(?U)[a-zA-Z_]\w*"
CODE_QUERY = r"(?U)[{}()\[\];=<>!&|+\-*/\\]|::|\.\w+\(|\bfunction\b|\bclass\b|\blocal\b|\breturn\b|\bimport\b|\brequire\b"
CJK = r"[一-鿿]"
DEPENDENCY_QUERY = r"(?i)依赖|dependency|dependencies|接口定义|interface|组件.*关系|component.*dep|依赖关系|dep graph|service\.json|component info|数据读取|数据访问|data.*read|数据流"
ENTRY_QUERY = r"(?i)入口|初始化|启动|startup|initialize|entry.?point|main\s|app\s"
ENTRY_FILE = r"(^|/)main\.(cpp|lua)$|_app\.lua$"
CLEAN_WORDS = ("csr", "json", "mds", "sr")


def tokens(text: Column) -> Column:
    """Lower-cased code tokens of two characters or more; camel case, digits and punctuation part them."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(F.filter(found, lambda t: F.char_length(t) > 1), F.lower)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines cut at any line end; a final line end opens no further line."""
    return F.split(F.regexp_replace(text, r"(\r\n|\n|\r)$", ""), r"\r\n|\n|\r")


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def shorten(text: Column, n: int, tail: str = "") -> Column:
    """At most n characters, with a tail where something was cut."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit(tail))).otherwise(text)


def first_line(text: Column, n: int = 200) -> Column:
    return F.substring(F.trim(F.substring_index(text, "\n", 1)), 1, n)


def name_before(text: Column) -> Column:
    """What stands before the first slash or bracket."""
    return F.trim(F.substring_index(F.substring_index(text, "/", 1), "[", 1))


def words(text: Column) -> Column:
    """Distinct identifiers of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(IDENTIFIER), F.lit(0)))


def clean_query(text: Column) -> Column:
    """Without the words that only filter; the text itself if nothing is left."""
    out = text
    for word in CLEAN_WORDS:
        out = F.replace(out, F.lit(word), F.lit(""))
    out = strip(out)
    return F.when(out == "", text).otherwise(out)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; the guard keeps zero vectors at 0."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))


def chunk_id(*parts: Column) -> Column:
    """A name that depends on the contents only, so that indexing again replaces rows instead of doubling them."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
