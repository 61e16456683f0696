"""Links between the tokens of two tokenizers, by products of sparse incidence matrices."""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .batches import map_rows, slices, texts_of

SPACE = "▁"
# Distinct stretches of text a worker remembers before it starts anew: bounds its memory.
REMEMBERED = 250_000
# Stretches that are encoded as one text.
_JOINED = 200
# Entries that a product expands at once.
_AT_ONCE = 1 << 22
# Pairs of ids whose counts are copied to executors, at most; the others are joined.
HOT_PAIRS = 500_000
# Pair counts that a worker sums up before it passes them on.
_HELD = 1 << 21


class Sparse:
    """A sparse matrix by compressed rows: row r has ``columns`` and ``values`` [starts[r], starts[r + 1])."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.starts, self.columns, self.values, self.width = starts, columns, values, width

    def __len__(self) -> int:
        return len(self.starts) - 1

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> Sparse:
        """From entries in any order; those of one place are added up."""
        places, values = summed(rows * shape[1] + columns, values)
        rows = places // max(shape[1], 1)
        starts = np.append(0, np.cumsum(np.bincount(rows, minlength=shape[0])))
        return cls(starts, places - rows * shape[1], values, shape[1])

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def turned(self) -> Sparse:
        return Sparse.of(self.columns, self.rows(), self.values, (self.width, len(self)))

    def times(self, other: Sparse) -> Sparse:
        """Gustavson's product: every row is the sum of the rows of ``other`` that it points to.

        Rows are expanded a strip at a time, each entry to a whole row of ``other``; entries
        of one place are then added up.
        """
        spread = np.diff(other.starts)
        per_row = np.add.reduceat(np.append(spread[self.columns], 0), self.starts[:-1]) if len(self) else spread[:0]
        per_row[np.diff(self.starts) == 0] = 0
        strip = np.cumsum(per_row) // _AT_ONCE
        cuts = np.append(np.flatnonzero(np.append(True, strip[1:] != strip[:-1])), len(self))
        starts, columns, values = [np.zeros(1, np.int64)], [], []
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = slice(self.starts[begin], self.starts[end])
            sizes = spread[self.columns[part]]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            entry = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(total) - (ends - sizes)[entry] + other.starts[self.columns[part]][entry]
            rows = np.repeat(np.arange(end - begin), np.diff(self.starts[begin : end + 1]))[entry]
            places, sums = summed(rows * other.width + other.columns[at], self.values[part][entry] * other.values[at])
            rows = places // max(other.width, 1)
            starts.append(starts[-1][-1] + np.cumsum(np.bincount(rows, minlength=end - begin)))
            columns.append(places - rows * other.width)
            values.append(sums)
        none = np.zeros(0, np.int64)
        return Sparse(np.concatenate(starts), np.concatenate([none, *columns]), np.concatenate([none, *values]), other.width)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first)


def token_bytes(ends: np.ndarray) -> Sparse:
    """Incidence of tokens and bytes: token t holds the bytes from the end of the one before."""
    starts = np.append(0, ends)
    total = int(starts[-1])
    return Sparse(starts, np.arange(total), np.ones(total, np.int64), total)


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of both sides over the same bytes, counted from 0.

    The product of token-byte incidences, A times B turned, links tokens that overlap. Where
    both sides end a token, no link spans: a token that overlaps none of what the one before
    it overlaps begins a group, and the other side's tokens are in the group of what they overlap.
    """
    overlaps = token_bytes(ends_a).times(token_bytes(ends_b).turned())
    first, last = overlaps.columns[overlaps.starts[:-1]], overlaps.columns[overlaps.starts[1:] - 1]
    group_a = np.cumsum(np.append(True, first[1:] > last[:-1])) - 1 if len(first) else first
    group_b = np.empty(len(ends_b), np.int64)
    group_b[overlaps.columns] = group_a[overlaps.rows()]
    return group_a, group_b


def shared_group_links(
    unit_a: np.ndarray, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, n_units: int, n_groups: int,
    ids: tuple[int, int],
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit, a, b, links): how often a token id of one side shares a group with one of the other.

    A row for every (unit, id) of A, a column for every group, times groups by ids of B:
    equal ids are one row or column with their number, so a long group costs its distinct ids.
    """
    keys = unit_a * ids[0] + a
    rows, row = np.unique(keys, return_inverse=True)
    left = Sparse.of(row, group_a, np.ones(len(a), np.int64), (len(rows), n_groups))
    right = Sparse.of(group_b, b, np.ones(len(b), np.int64), (n_groups, ids[1]))
    product = left.times(right)
    key = rows[product.rows()]
    return key // ids[0], key % ids[0], product.columns, product.values


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


def _plain(character: str) -> bool:
    """Neither white space nor a control, format or unassigned character by any reading."""
    return unicodedata.category(character)[0] not in "ZC" and not character.isspace()


class _Tidy(dict):
    """Whether a stretch or a part of one begins and ends with a plain character."""

    def __missing__(self, part: str) -> bool:
        if len(self) > 2 * REMEMBERED:
            self.clear()
        # Of what is printable, every character but the space is plain.
        ends = part[:1], part[-1:]
        self[part] = found = "" not in ends and " " not in ends and (part.isprintable() or all(map(_plain, ends)))
        return found


class Aligner:
    """Tokens, groups and links of stretches of text, remembered.

    Both tokenizers treat the two sides of a single space between two plain characters apart:
    the pattern of the byte-level one begins a match there, and no piece of the other holds
    the space mark after another character. A text falls into such stretches, the groups of a
    text are those of its stretches, and each distinct stretch is encoded and aligned once.
    """

    def __init__(self, byte_bpe: str, piece_model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        with open(byte_bpe, encoding="utf-8") as file:
            described = json.load(file)
        entries = described["model"]["vocab"] | {t["content"]: t["id"] for t in described["added_tokens"]}
        special = {t["id"] for t in described["added_tokens"]}
        characters = _byte_characters()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            self.bytes_a[number] = entry.encode() if number in special else bytes(characters[c] for c in entry)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        if any(SPACE in p.lstrip(SPACE) for i, p in enumerate(pieces) if not self.b.is_control(i)):
            raise ValueError("a piece holds the space mark after another character")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        self.ids = len(self.bytes_a), size
        self.sizes = tuple(np.array(list(map(len, side)), np.int64) for side in (self.bytes_a, self.bytes_b))
        # An id with what may follow it in the text of the groups.
        self.texts = [[f"{i}{mark}" for i in range(n)] for n, marks in zip(self.ids, (",|", ",;")) for mark in marks]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tidy = _Tidy()
        self.numbers = np.zeros((0, 5), np.int64)
        self.starts, self.pairs, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rendered: list[str] = []

    def split(self, text: str) -> list[str]:
        """The stretches of a text, without the spaces between them."""
        parts = text.split(" ")
        if all(map(self.tidy.__getitem__, parts)):
            return parts
        out, held = [], parts[0]
        for before, part in zip(parts, parts[1:]):
            if before and part and _plain(before[-1]) and _plain(part[0]):
                out.append(held)
                held = part
            else:
                held = f"{held} {part}"
        return [*out, held]

    def learn(self, stretches: set[str]) -> None:
        """Encode and align stretches not met before."""
        new = [s for s in stretches if s not in self.known]
        if len(new) + len(self.known) > REMEMBERED:
            self.forget()
            new = list(stretches)
        if not new:
            return
        # Stretches that have nothing but a space between them can be encoded in one text.
        new.sort(key=self.tidy.__getitem__, reverse=True)
        own = [f" {s}" for s in new]
        blobs = [text.encode() for text in own]
        spans = np.fromiter(map(len, blobs), np.int64, len(blobs))
        tidy = sum(map(self.tidy.__getitem__, new))
        a, n_a = self._encoded_a(own, spans, tidy)
        ids_b = self.b.encode(new, num_threads=1)
        n_b = np.fromiter(map(len, ids_b), np.int64, len(new))
        b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        whole = self._whole(a, n_a, 0, blobs, spans) & self._whole(b, n_b, 1, blobs, spans)
        if not whole.all():
            a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        fits = np.flatnonzero(whole)
        n_a, n_b = n_a[fits], n_b[fits]
        unit_a = np.repeat(np.arange(len(fits)), n_a)
        group_a, group_b = groups_of(np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]))
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        unit, left, right, links = shared_group_links(unit_a, a, group_a, b, group_b, len(fits), n_groups, self.ids)
        pair = left * self.ids[1] + right
        order = np.lexsort((pair, unit))
        unit, pair, links = unit[order], pair[order], links[order]
        # Groups of a stretch are those from its first token's to its last one's.
        last = np.cumsum(n_a)
        groups = group_a[last - 1] - group_a[last - n_a] + 1 if len(fits) else last
        numbers = np.zeros((len(new), 5), np.int64)
        numbers[:, 0] = whole
        numbers[fits, 1], numbers[fits, 2], numbers[fits, 3] = n_a, n_b, groups
        numbers[fits, 4] = np.bincount(unit, weights=links, minlength=len(fits)).astype(np.int64)
        counts = np.zeros(len(new), np.int64)
        counts[fits] = np.bincount(unit, minlength=len(fits))
        rendered = [""] * len(new)
        for row, text in zip(fits.tolist(), self._rendered(a, b, group_a, group_b, n_a, n_b)):
            rendered[row] = text
        for place, stretch in enumerate(new, len(self.known)):
            self.known[stretch] = place
        self.numbers = np.concatenate([self.numbers, numbers])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.pairs, self.links = np.concatenate([self.pairs, pair]), np.concatenate([self.links, links])
        self.rendered += rendered

    def _encoded_a(self, own: list[str], spans: np.ndarray, tidy: int) -> tuple[np.ndarray, np.ndarray]:
        """The A ids of all texts one after the other, and how many each has; the first ``tidy`` are joined."""
        joined = ["".join(own[i : min(i + _JOINED, tidy)]) for i in range(0, tidy, _JOINED)]
        found = self.a.encode_batch_fast([*joined, *own[tidy:]], add_special_tokens=False)
        ids = [e.ids for e in found]
        a = np.fromiter(chain.from_iterable(ids), np.int64)
        # A token belongs to the text that its last byte is in.
        text = np.searchsorted(np.cumsum(spans), np.cumsum(self.sizes[0][a]))
        if len(a) and text[-1] >= len(own):
            raise ValueError("the byte-level vocabulary gave other bytes than it was given")
        return a, np.bincount(text, minlength=len(own))

    def _whole(self, ids: np.ndarray, counts: np.ndarray, side: int, blobs: list[bytes], spans: np.ndarray) -> np.ndarray:
        """Whether the token bytes of each text are its own."""
        table = (self.bytes_a, self.bytes_b)[side]
        ends = np.cumsum(counts)
        reach = np.append(0, np.cumsum(self.sizes[side][ids]))
        sizes = reach[ends] - reach[ends - counts]
        got = b"".join([table[i] for i in ids.tolist()])
        if (sizes == spans).all() and got == b"".join(blobs):
            return np.ones(len(blobs), bool)
        places = zip(reach[ends - counts].tolist(), reach[ends].tolist())
        return np.array([got[start:stop] == blob for (start, stop), blob in zip(places, blobs)], bool)

    def _rendered(self, a, b, group_a, group_b, n_a, n_b) -> list[str]:
        """The groups of each stretch as text, every group with its end mark."""
        if not len(a):
            return []
        ends = [np.append(group[1:] != group[:-1], True) for group in (group_a, group_b)]
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(np.concatenate([group_a, group_b]) * 2 + side, kind="stable")
        tables = np.concatenate([ends[0], ends[1] + 2])[order].tolist()
        ids = np.concatenate([a, b])[order].tolist()
        texts = self.texts
        words = [texts[t][i] for t, i in zip(tables, ids)]
        stops = np.cumsum(n_a + n_b).tolist()
        return ["".join(words[start:stop]) for start, stop in zip([0, *stops], stops)]


@lru_cache(maxsize=1)
def _aligner(byte_bpe: str, piece_model: str) -> Aligner:
    return Aligner(byte_bpe, piece_model)


_ALIGNED = (
    "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, links binary"
)


def aligned(documents: DataFrame, byte_bpe: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links), one row per document.

    ``pairs`` are the document's different linked id pairs as 64-bit numbers, the A id times
    the size of B's vocabulary plus the B id, in order; ``links`` how often each is linked. See
    ``token_links`` for the rest. ``row`` numbers the rows, whatever their keys.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.monotonically_increasing_id().alias("row"), key, text)

    def run(batch):
        gc.disable()  # nothing here refers in circles, and a large dict is slow to walk
        aligner = _aligner(byte_bpe, piece_model)
        texts = texts_of(batch.column(2))
        split = [aligner.split(t) if t else [] for t in texts]
        aligner.learn({s for parts in split for s in parts})
        known, rendered = aligner.known, aligner.rendered
        # A stretch whose bytes differ: the whole text decides, as one stretch.
        odd = {i for i, w in enumerate(aligner.numbers[:, 0].tolist()) if not w}
        if odd:
            whole = [i for i, parts in enumerate(split) if len(parts) > 1 and any(known[s] in odd for s in parts)]
            for i in whole:
                split[i] = [texts[i]]
            aligner.learn({s for parts in split for s in parts})
            known, rendered = aligner.known, aligner.rendered
        units = np.fromiter((known[s] for parts in split for s in parts), np.int64)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        document = np.repeat(np.arange(len(split)), sizes)
        found = aligner.numbers[units]
        fits = np.ones(len(split), bool)
        fits[document[found[:, 0] == 0]] = False
        sums = [np.bincount(document, weights=found[:, c], minlength=len(split)).astype(np.int64) * fits for c in (1, 2, 3, 4)]
        digests = [
            hashlib.sha256("".join([rendered[known[s]] for s in parts]).rstrip(";").encode()).hexdigest() if parts and good else ""
            for parts, good in zip(split, fits.tolist())
        ]
        # Stretches that a document has several times are expanded once.
        place, times = summed(document * len(known) + units, np.ones(len(units), np.int64))
        document, units = place // max(len(known), 1), place % max(len(known), 1)
        kept = fits[document]
        document, units, times = document[kept], units[kept], times[kept]
        width = np.diff(aligner.starts)[units]
        entry = np.repeat(np.arange(len(units)), width)
        at = np.arange(len(entry)) - (np.cumsum(width) - width)[entry] + aligner.starts[units][entry]
        cells = aligner.ids[0] * aligner.ids[1]
        cell, links = summed(document[entry] * cells + aligner.pairs[at], times[entry] * aligner.links[at])
        ends = np.cumsum(np.bincount(cell // cells, minlength=len(split))).tolist()
        pairs, links = (cell % cells).astype("<i8").tobytes(), links.astype("<i8").tobytes()
        cuts = [(8 * a, 8 * b) for a, b in zip([0, *ends], ends)]
        return {
            "row": batch.column(0),
            key: batch.column(1),
            "n_a": pa.array(sums[0]), "n_b": pa.array(sums[1]), "n_groups": pa.array(sums[2]), "n_links": pa.array(sums[3]),
            "groups_sha256": pa.array(digests, pa.string()),
            "pairs": pa.array([pairs[a:b] for a, b in cuts], pa.binary()),
            "links": pa.array([links[a:b] for a, b in cuts], pa.binary()),
        }

    return map_rows(rows, run, f"row bigint, {key} {kind}, {_ALIGNED}", text)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and if that is most for its A id."""

    def run(batches):
        keys, counts, size = [], [], 0
        for batch in (part for whole in batches for part in slices(whole, "pairs")):
            blob = b"".join(batch.column(0).to_pylist())
            pair = np.sort(np.frombuffer(blob, "<i8"))
            pair, n = summed(pair, np.ones(len(pair), np.int64))
            keys.append(pair)
            counts.append(n)
            size += len(pair)
            if size > _HELD:
                pair, n = summed(np.concatenate(keys), np.concatenate(counts))
                if len(pair) > _HELD // 2:
                    yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(n)})
                    pair, n = pair[:0], n[:0]
                keys, counts, size = [pair], [n], len(pair)
        if size:
            pair, n = summed(np.concatenate(keys), np.concatenate(counts))
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(n)})

    summed_up = found.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    # An A id has at most as many pairs as the other vocabulary has ids.
    same = Window.partitionBy(F.expr(f"pair div {size_b}"))
    return summed_up.withColumn("best", F.col("n") == F.max("n").over(same))


def token_links(
    documents: DataFrame,
    byte_bpe: str,
    piece_model: str,
    key: str = "doc_id",
    text: str = "text",
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per document.

    A is a byte-level BPE over a space and the text, B a piece model over the text, to which it
    adds that space; strings of special tokens are plain text. Bytes where both sides end a
    token cut a text into groups, and every two token occurrences of the two sides in one
    group are a link. A pair of ids counts in how many documents of the table it is linked:
    ``count_sum`` adds that up over the links, ``n_best`` counts the links whose count is the
    highest of their A id. ``groups_sha256`` is of the ids as ``a1,a2|b1;a3|b2,b3``.

    NULL and empty texts, and those whose token bytes are not a space and the text, have no
    tokens: zeros, and '' as digest. Repeated rows are documents of their own; further columns
    are left out; an empty table gives no rows. Paths must be readable by every executor.

    The pairs of every document are written once. Counts of at most ``hot_pairs`` pairs, all
    that stand in more documents than the bound allows others, are copied to the executors;
    the rest, none of them frequent, are joined.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()
    found = written(aligned(documents, byte_bpe, piece_model, key, text), "aligned")
    counts = written(pair_counts(found, size_b), "pair-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # At most total / n pairs stand in n documents or more.
    least = -(-total // hot_pairs) if hot_pairs else total + 1
    hot = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    pairs, n, best = (hot.column(c).to_numpy().astype(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", bool)))
    copied = documents.sparkSession.sparkContext.broadcast((pairs, n, best))

    def looked_up(batch):
        """The pairs of a batch: row, pair, links, place among the hot ones, whether it is there."""
        pairs, _, _ = copied.value
        blobs = batch.column("pairs").to_pylist()
        row = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
        pair = np.frombuffer(b"".join(blobs), "<i8")
        links = np.frombuffer(b"".join(batch.column("links").to_pylist()), "<i8")
        if not len(pairs):
            return row, pair, links, np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
        at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        return row, pair, links, at, pairs[at] == pair

    def frequent(batch):
        _, n, best = copied.value
        row, _, links, at, there = looked_up(batch)
        row, links, at = row[there], links[there], at[there]
        out = {"best": np.zeros(batch.num_rows, np.int64), "sum": np.zeros(batch.num_rows, np.int64)}
        np.add.at(out["best"], row, links * best[at])
        np.add.at(out["sum"], row, links * n[at])
        names = ["row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        return {c: batch.column(c) for c in names} | {c: pa.array(v) for c, v in out.items()}

    def rare(batch):
        row, pair, links, _, there = looked_up(batch)
        numbers = batch.column("row").to_numpy()
        return {"row": pa.array(numbers[row[~there]]), "pair": pa.array(pair[~there]), "links": pa.array(links[~there])}

    kind = documents.schema[key].dataType.simpleString()
    first = map_rows(
        found, frequent,
        f"row bigint, {key} {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "best bigint, sum bigint", "pairs",
    )
    others = (
        map_rows(found.select("row", "pairs", "links"), rare, "row bigint, pair bigint, links bigint", "pairs")
        .join(counts.where(F.col("n") < least), "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"),
            F.sum(F.col("links") * F.col("n")).alias("more_sum"),
        )
    )
    return first.join(others, "row", "left").select(
        key, "n_a", "n_b", "n_groups", "n_links",
        (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
