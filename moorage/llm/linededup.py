"""Recurring lines, found by a fixed-depth tree of line templates.

DataFrame functions only. A line is reduced to words; words with a digit become ``<*>``. The
tree has a level for the number of words and one for each of the leading DEPTH words. Three
templates of a leaf can take a line: the line itself; the leaf's majority, whose constants are
the words with half of the leaf's weight at their place; and the line's own mask, in which
words that few lines of the leaf have at that place are variable fields. So a leaf has as many
templates as its lines have masks, and all are found in one pass.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, cut

DEPTH = 3
MIN_WORDS = 3
# Texts in which lines of one template, and equal lines, must stand to recur.
MIN_DOCUMENTS = 3
MIN_EQUAL = 2
# Share of a line's words that must be constants of its template.
SIMILARITY = 0.7
# Texts that share this part of their lines' characters are copies and count as one.
COPY_SHARE = 0.8

_SPACE = r" \t\x0B\f\r"
FIELD = "<*>"

# Mixed leaves that are copied to every executor at most: 16 bytes each.
_COPIED_LEAVES = 1_000_000
_LINE = ["line", "line_twin"]


def _text_number(value: Column, start: int) -> Column:
    """60 bits of a text's MD5, as a whole number that SQL can give as well."""
    return F.conv(F.substring(F.md5(value), start, 15), 16, 10).cast("bigint")


def _row_numbers(text: str) -> list[Column]:
    """Two numbers that stand for a text: rows with equal texts are one document."""
    return [_text_number(F.col(text), 1).alias("_row"), _text_number(F.col(text), 16).alias("_twin")]


def _folded(text: Column) -> Column:
    """(folded, size) of each line: single spaces between words, FIELD for words with a digit.

    A short search goes first: few texts have other white space, few lines a digit.
    """

    def fold(line: Column) -> Column:
        fields = F.regexp_replace(line, "(^| )[^ 0-9]*+[0-9][^ ]*", f"$1{FIELD}")
        return F.trim(F.when(line.rlike("[0-9]"), fields).otherwise(line))

    def plain(line: Column) -> Column:
        return F.struct(fold(line).alias("folded"), F.length(line).alias("size"))

    def spaced(line: Column) -> Column:
        single = F.regexp_replace(line, f"[{_SPACE}]+", " ")
        return F.struct(fold(single).alias("folded"), F.length(line).alias("size"))

    lines = F.split(text, "\n")
    odd = text.rlike(r"[\t\x0B\f\r]|  ")
    return F.when(odd, F.transform(lines, spaced)).otherwise(F.transform(lines, plain))


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def _long_enough(line: Column, min_words: int) -> Column:
    return (line != "") & (_words(line) >= min_words)


def _leaf(line: Column) -> Column:
    return F.xxhash64(_words(line), F.substring_index(line, " ", DEPTH))


def _written(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder as packed columns."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="moorage-")
    path = f"{base.rstrip('/')}/lines-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lines(documents: DataFrame, text: str, min_words: int) -> DataFrame:
    """A row for every line that counts; each text is folded here, once."""
    value = F.col(text)
    total = F.length(F.replace(value, F.lit("\n"), F.lit(""))).cast("bigint")
    parsed = documents.where(value.isNotNull()).select(
        *_row_numbers(text), total.alias("total"), _folded(value).alias("_zip")
    )
    folded = F.col("both.folded")
    return (
        # Not posexplode: for that Spark puts a filter on the array's size below, which folds once more.
        parsed.select("_row", "_twin", "total", F.posexplode_outer("_zip").alias("place", "both"))
        .where(_long_enough(folded, min_words))
        .select(
            "_row", "_twin", "total", "place", F.col("both.size").alias("size"), _leaf(folded).alias("leaf"),
            F.xxhash64(folded).alias("line"), F.xxhash64(F.lit(1), folded).alias("line_twin"), folded.alias("folded"),
        )
    )


def _origins(met: DataFrame, copy_share: float) -> DataFrame:
    """(_row, _origin) of the texts that are copies of others: one number for texts that share
    ``copy_share`` of their lines' characters.

    Each text is compared with the least text of every line it has, by the sizes of the
    lines that both have, as a share of what either has.
    """
    shared = (
        met.where(F.col("_row") != F.col("least._row"))
        .groupBy("_row", "total", "least")
        .agg(F.sum("size").alias("both"))
    )
    either = F.col("total") + F.col("least.total") - F.col("both")
    links = shared.where(F.col("both") >= copy_share * either)
    roots = connected_components(links.select(F.col("_row").alias("a"), F.col("least._row").alias("b")))
    return cut(roots.select(F.col("node").alias("_row"), F.col("root").alias("_origin")))


def _fitting(mixed: DataFrame, min_documents: int, similarity: float) -> DataFrame:
    """(line, line_twin, template): what the lines of leaves with several lines belong to."""
    words = mixed.select("leaf", "total", "weight", *_LINE, F.posexplode_outer(F.split("folded", " ")).alias("place", "word"))
    votes = cut(
        words.groupBy("leaf", "total", "place", "word")
        .agg(F.sum("weight").alias("votes"))
        .where(F.col("votes") >= F.least(F.lit(min_documents), F.ceil(F.col("total") / 2)))
    )
    best = votes.groupBy("leaf", "total", "place").agg(
        F.min_by("word", F.struct(-F.col("votes"), "word")).alias("word"), F.max("votes").alias("votes")
    )
    majority = best.where(F.col("votes") * 2 >= F.col("total")).select("leaf", "place", "word", F.lit(True).alias("major"))
    known = cut(
        votes.join(majority, ["leaf", "place", "word"], "left").select(
            "leaf", "place", "word", (F.col("votes") >= min_documents).alias("often"), F.coalesce("major", F.lit(False)).alias("major")
        )
    )
    # The places and words of a mask as two sums of hashes: no list of words is gathered.
    part = [F.when(F.col("often"), F.xxhash64(F.lit(seed), "place", "word") % (1 << 40)) for seed in (0, 1)]
    judged = cut(
        words.select("leaf", *_LINE, "place", "word")
        .join(known, ["leaf", "place", "word"])
        .groupBy("leaf", *_LINE)
        .agg(
            F.count_if("often").alias("often"),
            F.count_if("major").alias("major"),
            *[F.sum(p).alias(name) for p, name in zip(part, ("mask", "mask_twin"))],
        )
        .join(mixed.select(*_LINE, F.size(F.split("folded", " ")).alias("n")), _LINE)
    )
    of_leaf = judged.where(F.col("major") >= similarity * F.col("n")).select(*_LINE, F.xxhash64("leaf").alias("template"))
    of_mask = judged.where(F.col("often") >= similarity * F.col("n")).select(
        *_LINE, F.xxhash64("leaf", "mask", "mask_twin").alias("template")
    )
    return of_leaf.unionByName(of_mask)


def recurring_lines(
    documents: DataFrame,
    text: str = "text",
    min_words: int = MIN_WORDS,
    min_documents: int = MIN_DOCUMENTS,
    min_equal: int = MIN_EQUAL,
    similarity: float = SIMILARITY,
    copy_share: float = COPY_SHARE,
) -> DataFrame:
    """(_row, _twin, dropped): the numbers, from 0, of the lines that each text loses.

    A template recurs if lines of at least ``min_documents`` texts belong to it, an equal line
    if it stands in ``min_equal`` texts. Equal texts count as one, and so do texts that share
    ``copy_share`` of their lines. Lines with fewer than ``min_words`` words never count.
    """
    lines = _written(_lines(documents, text, min_words))
    firsts = _written(
        lines.groupBy("_row", *_LINE).agg(F.min("size").alias("size"), F.min("total").alias("total"), F.min("leaf").alias("leaf"))
    )
    kinds = _written(
        firsts.groupBy(*_LINE).agg(
            F.min("leaf").alias("leaf"), F.count(F.lit(1)).alias("texts"), F.min(F.struct("_row", "total")).alias("least")
        ).withColumn("least", F.when(F.col("texts") > 1, F.col("least")))
    )
    several = kinds.where(F.col("texts") > 1).select(*_LINE, "least")
    met = _written(firsts.join(several, _LINE))
    roots = _origins(met, copy_share)

    def by_origin(rows: DataFrame) -> DataFrame:
        joined = rows.join(roots, "_row", "left")
        return joined.withColumn("_origin", F.coalesce("_origin", "_row"))

    # A line of one text weighs one: only the others are looked up.
    weights = by_origin(met.select("_row", *_LINE, "leaf")).select("_origin", *_LINE, "leaf").distinct()
    weights = cut(weights.groupBy("leaf", *_LINE).agg(F.count(F.lit(1)).alias("weight")))
    added = weights.select("leaf", (F.col("weight") - 1).alias("weight"), F.lit(0).alias("kinds"))
    leaves = kinds.select("leaf", F.lit(1).alias("weight"), F.lit(1).alias("kinds")).unionByName(added)
    leaves = leaves.groupBy("leaf").agg(F.sum("weight").alias("total"), F.sum("kinds").alias("kinds"))
    leaves = cut(leaves.where((F.col("total") >= min_documents) & (F.col("kinds") > 1)).select("leaf", "total"))
    if leaves.count() <= _COPIED_LEAVES:
        leaves = F.broadcast(leaves)
    texts = lines.select("leaf", *_LINE, "folded").join(leaves, "leaf").groupBy("leaf", "total", *_LINE).agg(F.min("folded").alias("folded"))
    weighed = texts.join(weights.drop("leaf"), _LINE, "left")
    mixed = _written(weighed.withColumn("weight", F.coalesce("weight", F.lit(1))))
    fitting = cut(_fitting(mixed, min_documents, similarity))
    spread = by_origin(firsts.select("_row", *_LINE).join(fitting, _LINE)).select("_origin", "template").distinct()
    spread = spread.groupBy("template").agg(F.count(F.lit(1)).alias("texts"))
    by_template = fitting.join(spread.where(F.col("texts") >= min_documents), "template").select(*_LINE)
    recurring = cut(weights.where(F.col("weight") >= min_equal).select(*_LINE).unionByName(by_template).distinct())
    found = lines.select("_row", "_twin", "place", *_LINE).join(recurring, _LINE)
    return found.groupBy("_row", "_twin").agg(F.collect_set("place").alias("dropped"))


def drop_recurring_lines(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, all columns, with ``text`` less its recurring lines, and n_lines, n_dropped.

    Kept lines stay as they are and in order. NULL texts stay NULL and have no line, an empty
    text has one empty line. Rows with equal texts count as one document and are all treated
    alike, so copies alone lose nothing. Every column but ``text`` is untouched, but columns that
    are already called n_lines or n_dropped are replaced; helper columns take free names.
    """
    taken = {c.lower() for c in documents.columns}
    free = "_"
    while any(c.startswith(free) for c in taken):
        free += "_"
    row, twin, dropped = (f"{free}{name}" for name in ("row", "twin", "dropped"))
    lost = recurring_lines(documents, text, **options).toDF(row, twin, dropped)
    columns = [c for c in documents.columns if c.lower() not in ("n_lines", "n_dropped")]
    numbers = [c.alias(name) for c, name in zip(_row_numbers(text), (row, twin))]
    marked = documents.select(*[F.col(f"`{c}`") for c in columns], *numbers)
    lines = F.split(F.col(text), "\n")
    # A text is split once and its lines pass once: a 1 stands for each line that goes.
    places = F.array_sort(dropped)
    before = F.concat(F.array(F.lit(-1)), places)
    marks = F.zip_with(places, before, lambda at, last: F.concat(F.repeat(F.lit("0"), at - last - 1), F.lit("1")))
    marks = F.split(F.array_join(marks, ""), "")
    kept = F.zip_with(lines, marks, lambda line, mark: F.when(mark == "1", F.lit(None)).otherwise(line))
    cleaned = F.array_join(kept, "\n")
    changed = F.col(dropped).isNotNull()
    return marked.join(lost, [row, twin], "left").select(
        *[
            F.when(changed, cleaned).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`")
            for c in columns
        ],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(changed, F.size(dropped)).otherwise(0).alias("n_dropped"),
    )
