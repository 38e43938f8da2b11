"""Scalar functions, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the tokenizer.
STOPWORDS = [
    "the", "a", "an", "and", "or", "is", "in", "on", "at", "to", "of", "for", "with",
    "as", "by", "from", "that", "this", "it", "be", "are", "was", "were", "has",
    "have", "had", "not", "but", "if", "then", "so", "do", "does", "did", "will",
    "would", "could", "should", "can", "may", "might", "i", "we", "you", "he",
    "she", "they", "def", "return", "import", "class", "self", "none", "true",
    "false", "var", "let", "const", "function", "new", "null", "undefined",
]
LEAST_TOKEN = 2
K1, B = 1.5, 0.75
CHARS_PER_TOKEN = 4
#: What Python's splitlines() splits at, as a Java pattern.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
#: What Python's strip() takes off.
_BLANK = r"[\s\x1C-\x1F\x85\xA0  -     　]"
# Fixed value: what the embedding model is told before a query.
INSTRUCTION = "Represent this code search query for retrieving relevant code: "
# Fixed value: the URL name space of UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def tokens(text: Column) -> Column:
    """Lower-case tokens: cut at other characters than ASCII letters and digits, at aB, and before the last capital of ABc."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.split(F.lower(cut), " "), lambda t: (F.length(t) >= LEAST_TOKEN) & ~t.isin(STOPWORDS))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def tf_weight(tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(avgdl, F.lit(1.0))))


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def lines(text: Column) -> Column:
    """The lines as splitlines() gives them: nothing for an empty text, no empty line after a last break."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def chunk_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws("::", path, name, line.cast("string"))


def qualified(parent: Column, name: Column, line: Column) -> Column:
    own = F.when(name != "", name).otherwise(F.concat(F.lit("unnamed::"), line.cast("string")))
    return F.when((parent != "") & (name != ""), F.concat(parent, F.lit("."), name)).otherwise(own)


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def short_id(chunk: Column) -> Column:
    """The part before the last one, between double colons."""
    parts = F.split(chunk, "::")
    return F.when(F.size(parts) >= 2, F.element_at(parts, F.size(parts) - 1)).otherwise(chunk)


def uuid5_url(name: Column) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def point_id(collection: Column, path: Column, name: Column, line: Column) -> Column:
    return uuid5_url(F.concat_ws(":", collection, path, name, line.cast("string")))


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, "https://[^@]+@", "https://")


def repo_name(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(without_credentials(url), "/+$", ""), "/"), -1)
    return F.regexp_replace(F.replace(last, F.lit(".git"), F.lit("")), "[^a-zA-Z0-9_-]", "_")


def branch_of(ref: Column) -> Column:
    return F.replace(ref, F.lit("refs/heads/"), F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """With its dot, lower-cased; empty for names that start or end with their only dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def normal_path(path: Column) -> Column:
    return F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))


def markdown_cell(text: Column, width: int = 60) -> Column:
    return F.substring(F.translate(F.coalesce(text, F.lit("")), "\n|", " /"), 1, width)


def embed_text(doc_type: Column, name: Column, text: Column) -> Column:
    full = lambda c: F.coalesce(c, F.lit(""))
    return strip(F.concat_ws(" ", full(doc_type), full(name), full(text)))


def enriched_text(description: Column, text: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(description, F.lit("\n\n"), text)).otherwise(text)


def instructed(query: Column) -> Column:
    """Only what is embedded gets the instruction."""
    return F.concat(F.lit(INSTRUCTION), query)


def score_from_text(text: Column) -> Column:
    """The first whole number, held within 0 and 10, as a tenth."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)", 1)
    return F.least(F.lit(10.0), F.when(first == "", F.lit(0.0)).otherwise(first.cast("double"))) / 10


def sha_prefix(sha: Column) -> Column:
    return F.substring(F.coalesce(sha, F.lit("")), 1, 8)


def signature_ok(body: Column, secret: Column, header: Column) -> Column:
    """HMAC-SHA256 of the body under the secret, from sha2 alone, against "sha256=<hex>"."""
    key = F.encode(secret, "UTF-8")
    key = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    padded = F.rpad(F.hex(key), 128, "0")
    mask = lambda byte: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substr(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(byte)), 2, "0")), ""))
    inner = F.unhex(F.sha2(F.concat(mask(0x36), F.encode(body, "UTF-8")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(mask(0x5C), inner), 256)) == F.lower(header)
