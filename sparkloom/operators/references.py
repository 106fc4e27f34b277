"""Passages named in messages: the longest ending of the words before a number that is a book's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that ask for the book collection rather than name a book.
REQUEST_WORDS = ("laisiangtho", "bible", "verse", "verses", "chapter")
#: Book words, chapter, verse, last verse.
REFERENCE = r"((?:[1-3]\s*)?\p{L}[\p{L}\p{N}_' .]{0,80}?)\s*(\d{1,3})(?:\s*[:.]\s*(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?)?(?!\d)"


def book_key(c: Column | str) -> Column:
    """Letters a-z and digits of a name in lower case."""
    return F.regexp_replace(F.lower(c if isinstance(c, Column) else F.col(c)), "[^0-9a-z]", "")


def book_names(books: DataFrame) -> DataFrame:
    """key and book of every name, code and local name; of books with one key the first by ``rank``. ``books``: book, rank, name, code, name_local."""
    named = books.select("book", "rank", F.explode(F.array_compact(F.array("name", "code", "name_local"))).alias("n")).select("book", "rank", book_key("n").alias("key")).where("key <> ''")
    return named.groupBy("key").agg(F.min(F.struct("rank", "book")).alias("b")).select("key", "b.book")


def find_references(messages: DataFrame, names: DataFrame, chapters: DataFrame) -> DataFrame:
    """message, book, chapter, verse, last: the first passage that each message names, if its book has the chapter.

    ``messages``: message, text; ``names``: key, book; ``chapters``: book,
    chapter. Leading words of a match are dropped until the rest is a book's
    name. A name that is a word too counts with a verse, with a capital or a
    digit first, or where the message asks for the collection. Endings meet the
    names by a join, so the list of names may be of any length.
    """
    found = F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0))
    asks = F.arrays_overlap(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array(*map(F.lit, REQUEST_WORDS)))
    part = lambda i: F.regexp_extract("m", REFERENCE, i)
    number = lambda i: F.try_to_number(F.nullif(part(i), F.lit("")), F.lit("999")).cast("int")
    matches = messages.select("message", asks.alias("asks"), F.posexplode(found).alias("nth", "m")).select(
        "message", "asks", "nth", F.split(F.trim(part(1)), r"\s+").alias("words"), number(2).alias("chapter"), number(3).alias("verse"), number(4).alias("end")
    )
    endings = matches.select("*", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("start")).withColumn("name", F.array_join(F.slice("words", F.col("start"), F.size("words")), " "))
    met = endings.withColumn("key", book_key("name")).where("key <> ''").join(names, "key")
    counts = F.col("verse").isNotNull() | F.col("asks") | ~F.left("name", F.lit(1)).rlike(r"\p{Ll}")
    first = met.where(counts).groupBy("message").agg(F.min(F.struct("nth", "start", "book", "chapter", "verse", F.coalesce("end", "verse").alias("last"))).alias("r"))
    chosen = first.select("message", "r.book", "r.chapter", "r.verse", "r.last")
    return chosen.join(chapters.select("book", "chapter").distinct(), ["book", "chapter"], "left_semi").select("message", "book", "chapter", "verse", "last")
