"""Chunkers over lines: sliding windows, configuration, Markdown, notebooks.

A file is one row and its chunks are made within the row by array functions, so nothing shuffles:
the places where pieces start are filtered from the lines' indexes, and each piece is the slice up to
the next start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkyard.functions import text as X
from chunkyard.schema import NOTEBOOK

WINDOW, OVERLAP = 400, 50
SLICE_CHARS = 8000
CONFIG_TOKENS = 300


def _chunks(rows: DataFrame, pieces: Column) -> DataFrame:
    """One row a piece: the files' columns (without text) and text, name, start_line."""
    kept = [c for c in rows.columns if c != "text"]
    return rows.select(*kept, F.explode(pieces).alias("p")).select(*kept, X.strip(F.col("p.text")).alias("text"), F.col("p.name").alias("name"), F.col("p.line").cast("int").alias("start_line"))


def _piece(text: Column, name: Column, line: Column) -> Column:
    return F.struct(text.alias("text"), name.alias("name"), line.cast("int").alias("line"))


def sliding_windows(files: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, prefix: str = "chunk::", text: str = "text") -> DataFrame:
    """Windows of lines from every ``window - overlap``-th line on; blank ones are left out."""
    rows = files.withColumn("_lines", X.lines(F.coalesce(F.col(text), F.lit(""))))
    starts = F.when(F.size("_lines") > 0, F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(max(1, window - overlap)))).otherwise(F.array().cast("array<int>"))
    made = F.transform(starts, lambda i: _piece(F.array_join(F.slice("_lines", i + 1, F.lit(window)), "\n"), F.concat(F.lit(prefix), i.cast("string")), i))
    return _chunks(rows, F.filter(made, lambda p: X.strip(p["text"]) != "")).drop("_lines")


def _sections(starts: Column, count: Column) -> Column:
    """Array of first line and number of lines for pieces that begin at the given lines, and at line 0."""
    begins = F.array_distinct(F.concat(F.array(F.lit(0)), starts))
    return F.transform(begins, lambda s, i: F.struct(s.alias("first"), (F.coalesce(F.get(begins, i + 1), count) - s).alias("n")))


def config_chunks(files: DataFrame, whole_tokens: int = CONFIG_TOKENS) -> DataFrame:
    """A short text whole; a longer one from each line that is neither empty, nor indented, nor a comment."""
    rows = files.withColumn("_lines", X.lines(F.coalesce("text", F.lit(""))))
    index = F.sequence(F.lit(0), F.greatest(F.size("_lines") - 1, F.lit(0)))
    opens = lambda i: F.coalesce(F.get(F.col("_lines"), i), F.lit("")).rlike(rf"^(?![\s\x1C-\x1F\x85\xA0  -     　]|#|//).")
    parts = F.transform(_sections(F.filter(index, opens), F.size("_lines")), lambda s: _piece(F.array_join(F.slice("_lines", s["first"] + 1, s["n"]), "\n"), F.concat(F.lit("config::"), s["first"].cast("string")), s["first"]))
    whole = F.array(_piece(F.col("text"), F.lit("[config]"), F.lit(0)))
    return _chunks(rows, F.when(X.approx_tokens(F.col("text")) <= whole_tokens, whole).otherwise(F.filter(parts, lambda p: p["line"].isNotNull()))).drop("_lines")


def markdown_chunks(files: DataFrame) -> DataFrame:
    """From each line that starts with one to three # and a space; what precedes the first is a section too, blank ones are not."""
    parts = F.split(F.col("text"), r"(?m)(?=^#{1,3} )", -1)
    full = F.filter(F.transform(parts, X.strip), lambda p: p != "")
    named = F.transform(full, lambda p, i: _piece(p, F.concat(F.lit("section::"), i.cast("string")), F.lit(0)))
    empty = F.array(_piece(F.col("text"), F.lit("section::0"), F.lit(0)))
    return _chunks(files, F.when(F.size(full) > 0, named).otherwise(empty))


def notebook_chunks(files: DataFrame) -> DataFrame:
    """Code cells one by one, numbered; Markdown cells between two of them together; blank cells are left out."""
    # A cell's source is a string or a list of strings; as a string field, a list arrives as its JSON.
    source = lambda c: F.when(c["source"].startswith("["), F.coalesce(F.array_join(F.from_json(c["source"], "array<string>"), ""), c["source"])).otherwise(F.coalesce(c["source"], F.lit("")))
    cells = F.filter(F.transform(F.from_json("text", NOTEBOOK)["cells"], lambda c: F.struct(c["cell_type"].alias("kind"), source(c).alias("source"))), lambda c: (X.strip(c["source"]) != "") & c["kind"].isin("code", "markdown"))
    rows = files.withColumn("_cells", F.coalesce(cells, F.array().cast("array<struct<kind:string,source:string>>")))
    index = F.sequence(F.lit(1), F.size("_cells"))
    at = lambda i: F.element_at("_cells", i)
    code = F.filter(F.when(F.size("_cells") > 0, index).otherwise(F.array().cast("array<int>")), lambda i: at(i)["kind"] == "code")
    rows = rows.withColumn("_code", code)
    bounds = F.concat(F.array(F.lit(0)), F.col("_code"), F.array(F.size("_cells") + 1))

    def stretch(i: Column) -> Column:
        """The Markdown before the i-th code cell (from 0; the last has no code cell), then that cell."""
        first, code_cell = F.get(bounds, i) + 1, F.get(bounds, i + 1)
        between = F.transform(F.slice("_cells", first, code_cell - first), lambda c: c["source"])
        text = F.array(F.struct(F.array_join(between, "\n\n").alias("text"), F.concat(F.lit("md::"), i.cast("string")).alias("name"), i.alias("line"), F.lit("notebook_markdown").alias("doc_type"), F.lit("").alias("language")))
        own = F.array(F.struct(at(code_cell)["source"].alias("text"), F.concat(F.lit("cell::"), i.cast("string")).alias("name"), i.alias("line"), F.lit("notebook").alias("doc_type"), F.lit("python").alias("language")))
        return F.concat(F.when(F.size(between) > 0, text).otherwise(F.filter(text, lambda _: F.lit(False))), F.when(code_cell <= F.size("_cells"), own).otherwise(F.filter(text, lambda _: F.lit(False))))

    # What is no notebook at all comes in slices of its characters.
    text = F.coalesce("text", F.lit(""))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(SLICE_CHARS)), lambda i: F.substring(text, i + 1, F.lit(SLICE_CHARS)))
    sliced = F.transform(F.filter(cut, lambda t: X.strip(t) != ""), lambda t, i: F.struct(t.alias("text"), F.concat(F.lit("chunk::"), (i * SLICE_CHARS).cast("string")).alias("name"), F.lit(0).alias("line"), F.lit("notebook").alias("doc_type"), F.lit("python").alias("language")))
    broken = F.from_json("text", NOTEBOOK)["cells"].isNull() & ~X.strip(text).startswith("{}")
    made = F.when(broken, sliced).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_code")), stretch)))
    kept = [c for c in files.columns if c not in ("text", "doc_type", "language")]
    return rows.select(*kept, F.explode(made).alias("p")).select(*kept, X.strip(F.col("p.text")).alias("text"), F.col("p.name").alias("name"), F.col("p.line").cast("int").alias("start_line"), F.col("p.doc_type").alias("doc_type"), F.col("p.language").alias("language"))
