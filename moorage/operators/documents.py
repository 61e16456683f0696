"""INI documents, layered overlays and compact JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import unset_if_zero
from .groups import GROUP_ROWS, heavy_groups, numbered

_BLOCK_SPAN = 1 << 32

# The end of a line that goes on: from the start of a line that is neither comment nor
# section, or from the previous such end, up to a backslash before the line break.
_CONTINUED = r"(?m)(?:^(?![ \t]*[#;\[])|(?!\A)\G)(.*?)\\\n[ \t]*"


# Stand-ins for the line breaks that do not end an entry: after a comment, and in a value
# between triple quotes. Control characters that no INI text holds.
_AFTER_COMMENT, _IN_VALUE = "\x02", "\x04"
_COMMENTS = f"(?:[ \\t]*[#;][^{_AFTER_COMMENT}\n]*{_AFTER_COMMENT})"


def _where(test: Column, cheap: Column, costly: Column) -> Column:
    """``costly`` only where it can differ: patterns are matched one character at a time."""
    return F.when(test, costly).otherwise(cheap)


def _comment(prefix: Column) -> Column:
    """Comment lines, joined by line feeds, from the stretch before an entry."""
    lines = F.split(F.rtrim(prefix, F.lit(_AFTER_COMMENT)), _AFTER_COMMENT)
    text = F.array_join(F.transform(lines, lambda line: F.btrim(line, F.lit(" \t"))), "\n")
    return F.when(prefix != "", text)


def ini_rows(docs: DataFrame, *, doc_id: str = "doc_id", doc: str = "doc") -> DataFrame:
    """(doc_id, ord, section, key, value, valueless, comment, section_comment): keys of INI texts.

    A key ends at the first ``=`` or ``:``; a line without either is a key with the value
    ``true``. Quotes around a value are dropped: single, double, backticks, and triple double
    quotes, between which a value may go over lines. A line ending in a backslash goes on in
    the next. Keys before any section have a NULL section. ``ord`` rises with the line: the
    section block times 2**32 plus the line in it. A document is parsed inside its row, so
    nothing shuffles.

    Comments start with ``#`` or ``;``. Lines of comment above a key are its ``comment``, those
    above a section header the ``section_comment`` of its keys; one behind a value, or with
    nothing below it in its section, is dropped.
    """
    text = F.replace(F.col(doc), F.lit("\r\n"), F.lit("\n"))
    quotes = F.lit('"""')
    inside = F.transform(
        F.split(text, '"""', -1),
        lambda piece, at: F.when(at % 2 == 1, F.replace(piece, F.lit("\n"), F.lit(_IN_VALUE)))
        .otherwise(piece),
    )
    text = F.when(F.contains(text, quotes), F.array_join(inside, '"""')).otherwise(text)
    text = F.when(
        F.contains(text, F.lit("\\\n")), F.regexp_replace(text, _CONTINUED, "$1")
    ).otherwise(text)
    marked = F.contains(text, F.lit("#")) | F.contains(text, F.lit(";"))
    joined = F.regexp_replace(text, r"(?m)^([ \t]*[#;][^\n]*)\n(?:[ \t]*\n)*", f"$1{_AFTER_COMMENT}")
    text = _where(marked, text, joined)
    blocks = docs.select(
        doc_id,
        F.posexplode(F.split(text, rf"\n(?={_COMMENTS}*[ \t]*\[)", -1)).alias("_block", "_text"),
    )
    noted = F.contains("_text", F.lit(_AFTER_COMMENT))
    start = rf"^({_COMMENTS}*)[ \t]*\[([^\n]*)\]"
    # A header is what stands between the first and the last bracket of the line it begins.
    first = F.ltrim(F.substring_index("_text", "\n", 1), F.lit(" \t"))
    last = F.length(first) - F.length(F.substring_index(first, "]", -1))
    plain_header = F.when(
        F.startswith(first, F.lit("[")) & F.contains(first, F.lit("]")), F.substring(first, F.lit(2), last - 2)
    ).otherwise("")
    header = F.nullif(_where(noted, plain_header, F.regexp_extract("_text", start, 2)), F.lit(""))
    lines = blocks.select(
        doc_id,
        "_block",
        F.trim(header).alias("section"),
        F.when(noted, _comment(F.regexp_extract("_text", start, 1))).alias("section_comment"),
        F.posexplode(F.split("_text", "\n", -1)).alias("_line", "_entry"),
    )
    entry = rf"(?s)^({_COMMENTS}*)(.*)$"
    noted = F.contains("_entry", F.lit(_AFTER_COMMENT))
    lines = lines.withColumns(
        {
            "comment": F.when(noted, _comment(F.regexp_extract("_entry", entry, 1))),
            "_raw": F.btrim(_where(noted, F.col("_entry"), F.regexp_extract("_entry", entry, 2)), F.lit(" \t")),
        }
    )
    raw = F.col("_raw")
    # The first of both separators ends the key.
    before = F.length(F.substring_index(F.translate(raw, ":", "="), "=", 1))
    lines = lines.withColumn("_key_length", before)
    before = F.col("_key_length")
    key = F.btrim(F.substring(raw, F.lit(1), before), F.lit(" \t"))
    value = F.btrim(F.substring(raw, before + 2, F.length(raw)), F.lit(" \t"))

    def uncommented(text: Column) -> Column:
        marked = F.contains(text, F.lit("#")) | F.contains(text, F.lit(";"))
        return _where(marked, text, F.btrim(F.regexp_replace(text, r"(?s)[#;].*$", ""), F.lit(" \t")))

    plain = uncommented(value)
    quoted_once = F.startswith(plain, F.lit("'")) | F.startswith(plain, F.lit('"'))
    plain = _where(quoted_once, plain, F.regexp_replace(plain, r"(?s)^(['\"])(.*)\1$", "$2"))
    value = (
        F.when(
            F.startswith(value, quotes) & value.rlike(r'(?s)^"""(.*)"""'),
            F.replace(
                F.regexp_extract(value, r'(?s)^"""(.*)"""', 1), F.lit(_IN_VALUE), F.lit("\n")
            ),
        )
        .when(
            F.startswith(value, F.lit("`")) & value.rlike(r"(?s)^`[^`]*`"),
            F.regexp_extract(value, r"(?s)^`([^`]*)`", 1),
        )
        .otherwise(plain)
    )
    valueless = before == F.length(raw)
    bare = uncommented(raw)
    kept = (raw != "") & ~F.substring(raw, 1, 1).isin("#", ";", "[")
    return lines.where(kept).select(
        doc_id,
        (F.col("_block").cast("bigint") * F.lit(_BLOCK_SPAN) + F.col("_line")).alias("ord"),
        "section",
        F.when(valueless, bare).otherwise(key).alias("key"),
        F.when(valueless, F.lit("true")).otherwise(value).alias("value"),
        valueless.alias("valueless"),
        "comment",
        "section_comment",
    )


def _or_null(rows: DataFrame, column: str) -> Column:
    known = column in rows.columns
    return (F.col(column) if known else F.lit(None).cast("string")).alias(column)


def overlay_config(
    layers: Sequence[tuple[str, DataFrame]], *, doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, section, key, value, source, valueless, comment, section_comment, layer, ord).

    ``layers`` are (name, rows) from the base up; the last layer wins per key. A key keeps the
    place where it first appeared, (layer, ord), and the comments it has there. Rows without
    ``ord``, ``valueless`` or comments may leave them out.
    Within one layer the later row wins. One shuffle, on the key, before anything is sorted: few
    bytes of stored texts make very many rows, and a task that reads them should not hold them.
    """
    every: DataFrame | None = None
    for number, (name, rows) in enumerate(layers):
        ordinal = F.col("ord").cast("bigint") if "ord" in rows.columns else F.lit(0).cast("bigint")
        valueless = F.col("valueless") if "valueless" in rows.columns else F.lit(False)
        layer = rows.select(
            doc_id,
            "section",
            "key",
            F.col("value").cast("string").alias("value"),
            F.lit(name).alias("source"),
            valueless.alias("valueless"),
            F.lit(number).alias("layer"),
            ordinal.alias("ord"),
            *[_or_null(rows, column) for column in ("comment", "section_comment")],
        )
        every = layer if every is None else every.unionByName(layer)
    if every is None:
        raise ValueError("at least one layer is needed")
    place = F.struct("layer", "ord", "value", "comment", "section_comment")
    return (
        every.repartition(doc_id, "section", "key")
        .groupBy(doc_id, "section", "key")
        .agg(
            F.max_by(
                F.struct("value", "source", "valueless"), F.struct("layer", "ord", "value")
            ).alias("_last"),
            F.min(place).alias("_place"),
        )
        .select(
            doc_id, "section", "key", "_last.*",
            *[f"_place.{c}" for c in ("comment", "section_comment", "layer", "ord")],
        )
    )


def quoted(value: Column) -> Column:
    """A value as INI text that ``ini_rows`` reads back, whatever it holds.

    Only a value with both triple quotes and a line break or backtick has no such text.
    """
    marked = F.contains(value, F.lit('"""')) | value.rlike(r"[#;]|\\$") | value.rlike(
        r"(?s)^(['\"]).*\1$"
    )
    return (
        F.when(value.rlike(r"[\n`]"), F.concat(F.lit('"""'), value, F.lit('"""')))
        .when(marked, F.concat(F.lit("`"), value, F.lit("`")))
        .when(F.btrim(value, F.lit(" \t")) != value, F.concat(F.lit('"'), value, F.lit('"')))
        .otherwise(value)
    )


def ini_documents(
    rows: DataFrame, *, doc_id: str = "doc_id", part_keys: int = GROUP_ROWS
) -> DataFrame:
    """(doc_id, part, text): sections and keys written back as INI text.

    Rows are (doc_id, section, key, value) with optional ``layer``, ``ord``, ``valueless``,
    ``comment`` and ``section_comment``, as from ``ini_rows`` or ``overlay_config``. Sections and
    keys come in the order of first appearance, the keys without section first. A key that
    occurs twice in a section keeps its first place and its last value.

    A text has up to ``part_keys`` keys; a document with more comes in parts 0, 1, 2, ... in
    order. A part begins with the header of the section it goes on with, so each is a text
    of its own and their keys one after the other are the whole document.
    """
    zero = F.lit(0).cast("bigint")
    valueless = F.col("valueless") if "valueless" in rows.columns else F.lit(False)
    layer = F.col("layer") if "layer" in rows.columns else F.lit(0)
    order = F.col("ord").cast("bigint") if "ord" in rows.columns else zero
    line = F.when(valueless, F.col("key")).otherwise(
        F.concat(F.col("key"), F.lit(" = "), quoted(F.coalesce("value", F.lit(""))))
    )
    place = F.struct(layer.alias("layer"), order.alias("ord"), F.col("key").alias("key"))
    lines = rows.select(
        doc_id,
        "section",
        "key",
        place.alias("place"),
        line.alias("line"),
        *[_or_null(rows, column) for column in ("comment", "section_comment")],
    )
    first = F.struct("place", "comment", "section_comment")

    def once(dealt: DataFrame) -> DataFrame:
        """A row per key, of rows dealt so that a key is in one task: nothing is sorted before that."""
        return (
            dealt.groupBy(doc_id, "section", "key")
            .agg(F.min(first).alias("first"), F.max_by("line", "place").alias("line"))
            .select(doc_id, "section", "first.*", "line")
        )

    head = F.min(F.struct("place", "section_comment")).alias("head")
    named = F.struct(F.col("section").isNotNull().alias("named"), F.col("head.place").alias("at"))
    entry = F.concat(F.coalesce(F.concat("comment", F.lit("\n")), F.lit("")), "line")
    entries = F.sort_array(F.collect_list(F.struct("place", entry.alias("line")))).alias("lines")
    # No document has more keys than rows.
    if heavy_groups(rows.select(doc_id), [doc_id], part_keys).isEmpty():
        bodies = (
            # All aggregations are clustered by this one shuffle.
            once(lines.repartition(doc_id))
            .withColumn("part", zero)
            .groupBy(doc_id, "part", "section")
            .agg(entries, head)
        )
    else:
        keys = once(lines.repartition(doc_id, "section", "key"))
        sections = keys.groupBy(
            F.col(doc_id).alias("_doc"), F.col("section").alias("_section")
        ).agg(head)
        same = F.col(doc_id).eqNullSafe(F.col("_doc")) & F.col("section").eqNullSafe(F.col("_section"))
        placed = keys.join(sections, same).withColumn("_head", named).drop("_doc", "_section")
        parts = numbered(placed, [doc_id], ["_head", "place"], part_keys).withColumn(
            "part", F.expr(f"(pos - 1) div {part_keys}")
        )
        bodies = (
            parts.repartition(doc_id, "part")
            .groupBy(doc_id, "part", "section")
            .agg(entries, F.any_value("head").alias("head"))
        )
    bodies = bodies.withColumns(
        {"_head": named, "section_comment": F.col("head.section_comment")}
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    note = F.coalesce(F.concat("section_comment", F.lit("\n")), F.lit(""))
    title = F.when(
        F.col("section").isNotNull(),
        # The comment stands where the section begins, not where a part goes on with it.
        F.concat(
            F.when(F.col("lines")[0]["place"] == F.col("_head.at"), note).otherwise(""),
            F.lit("["), "section", F.lit("]\n"),
        ),
    ).otherwise("")
    entries = F.sort_array(F.collect_list(F.struct("_head", F.concat(title, body).alias("text"))))
    text = F.array_join(F.transform(entries, lambda x: x["text"]), "\n\n")
    return bodies.groupBy(doc_id, "part").agg(F.concat(text, F.lit("\n")).alias("text"))


def _compacted(col: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StructType):
        return F.struct(
            *[_compacted(col[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        )
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StructType):
        inner = F.transform(col, lambda item: _compacted(item, data_type.elementType))
        return F.when(F.size(col) > 0, inner)
    return unset_if_zero(col, data_type)


def compact_json_column(df: DataFrame, columns: Sequence[str]) -> Column:
    """JSON text of ``columns`` in which every zero-valued field is left out.

    A sub-object is never left out, even when nothing is left in it.
    """
    fields = [_compacted(F.col(c), df.schema[c].dataType).alias(c) for c in columns]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def compact_json(
    df: DataFrame, columns: Sequence[str], *, keep: Sequence[str] = ()
) -> DataFrame:
    """(keep..., json): see :func:`compact_json_column`."""
    return df.select(*keep, compact_json_column(df, columns).alias("json"))
