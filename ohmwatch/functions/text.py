"""Text columns: chunking, tokens and reference lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the retrieval defaults.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
REFERENCE_CHARS = 300
TOKEN = r"[\p{L}\p{N}_]{2,}"

# What counts as white space at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


# Windows per stretch of a long text.
_WINDOWS = 64


def strip(column: Column) -> Column:
    return F.trim(column, F.lit(BLANKS))


def chunk(
    documents: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per non-blank window of the text; ``chunk_no`` is the window's number in its document.

    All other columns are kept.  The last window may lie wholly inside the one before it, and a window that
    would not move forward is the only one.  A long text is first cut into stretches of some windows, each
    with the overlap behind it, since finding a character takes a walk from the start of a string.
    """
    kept = [c for c in documents.columns if c != text]
    whole = F.col(text)
    if overlap >= size:
        one = strip(F.substring(whole, 1, size))
        rows = documents.select(*kept, F.lit(0).alias("chunk_no"), one.alias(text))
        return rows.where(F.length(text) > 0)
    step = size - overlap
    windows = max(_WINDOWS, -(-size // step))
    length = step * windows

    def with_overlap(pieces: Column) -> Column:
        return F.transform(
            pieces,
            lambda piece, i: F.struct(
                F.concat(piece, F.coalesce(F.substring(F.get(pieces, i + 1), 1, overlap), F.lit(""))).alias("body"),
                F.length(piece).alias("own"),
            ),
        )

    # A one-element array names the pieces, so that the text is cut once.
    cut = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
    long = F.get(F.transform(F.array(cut), with_overlap), F.lit(0))
    short = F.array(F.struct(whole.alias("body"), F.length(whole).alias("own")))
    stretches = F.when(F.length(whole) <= length, short).otherwise(long)
    rows = documents.where(F.length(whole) > 0).select(*kept, F.posexplode(stretches).alias("__at", "__stretch"))
    body, own = F.col("__stretch")["body"], F.col("__stretch")["own"]
    rows = rows.select(
        *kept, "__at", body.alias("__body"),
        F.posexplode(F.sequence(F.lit(0), own - 1, F.lit(step))).alias("__no", "__start"),
    )
    window = strip(F.substring(F.col("__body"), F.col("__start") + 1, F.lit(size)))
    number = (F.col("__at") * windows + F.col("__no")).alias("chunk_no")
    return rows.select(*kept, number, window.alias(text)).where(F.length(text) > 0)


def tokens(column: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0))


def term_counts(column: Column) -> Column:
    """Array of (term, tf) of one text, sorted by term.

    Equal tokens are neighbours after sorting, so counts are distances between the starts of runs; no
    shuffle is needed because a chunk is one row.
    """
    in_order = F.array_sort(tokens(column))

    def runs(words: Column) -> Column:
        starts = F.filter(
            F.transform(words, lambda w, i: F.when((i == 0) | (F.get(words, i - 1) != w), i)),
            lambda i: i.isNotNull(),
        )
        return F.struct(words.alias("words"), starts.alias("starts"))

    def count(r: Column) -> Column:
        return F.transform(
            r["starts"],
            lambda start, j: F.struct(
                F.get(r["words"], start).alias("term"),
                (F.coalesce(F.get(r["starts"], j + 1), F.size(r["words"])) - start).cast("long").alias("tf"),
            ),
        )

    # One-element arrays name an intermediate value, so that it is computed once.
    named = F.transform(F.transform(F.array(in_order), runs), count)
    return F.get(named, F.lit(0))


def reference_line(source: Column, text: Column) -> Column:
    """``[source] `` and the first 300 characters of the stripped text."""
    return F.concat(F.lit("["), source, F.lit("] "), F.substring(strip(text), 1, REFERENCE_CHARS))
