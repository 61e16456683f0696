"""Merge-type subword encoding and decoding by a score-ordered agenda of symbol pairs."""

from __future__ import annotations

import gc
import hashlib
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .batches import map_rows, texts_of

SPACE = "▁"
# Distinct words a worker remembers before it starts anew: bounds its memory.
REMEMBERED = 300_000
# Symbols from which a word has an agenda of its own: scanning a row grows with its square.
LONG_WORD = 256
_WORDS = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCodec:
    """Encode and decode with a merge vocabulary read from a sentencepiece model file.

    Characters start as symbols. The agenda of a word is the row of its adjacent pairs that
    join to a piece; the best score, leftmost at ties, is merged first and its two
    neighbours are scored anew, until no pair is left. Words of one length run in step as
    one array; a long word keeps its agenda in a heap and its symbols in a linked row.
    Characters that are no piece become their UTF-8 bytes. No piece of such a
    vocabulary holds the space mark after another character, so a text falls into words
    that never merge with each other, and equal words are encoded once.
    """

    def __init__(self, model: str, check: bool = True):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.check, self.size = check, lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(self.size)]
        silent = {i for i in range(self.size) if lib.is_control(i)}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        apart = silent | set(self.byte_of) | {lib.unk_id()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in apart}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("a piece holds the space mark after another character")
        self.texts = ["" if i in silent else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.numbers = [str(i) for i in range(self.size)]
        pairs = {
            self.ids[p[:cut]] * self.size + self.ids[p[cut:]]: i
            for p, i in self.ids.items()
            for cut in range(1, len(p))
            if p[:cut] in self.ids and p[cut:] in self.ids
        }
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        # An agenda holds the ranks of falling scores: equal scores share a rank.
        scores = np.array([lib.get_score(i) for i in range(self.size)])
        self.pair_ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)[self.pair_ids]
        self.none = np.int32(self.size)
        self.known: dict[str, tuple[int, str, str]] = {}
        self.unequal = 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair of symbols joins to, or ``none``."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_ranks[at], self.none)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each of these pairs, all of them in the vocabulary, joins to."""
        return self.pair_ids[np.searchsorted(self.pair_keys, left.astype(np.int64) * self.size + right)]

    def _merge_in_step(self, symbols: np.ndarray, rows: np.ndarray, out: list) -> None:
        """Run the agendas of words of one length; a finished row goes to ``out``."""
        agenda = self._ranks(symbols[:, :-1], symbols[:, 1:])
        while True:
            count, width = symbols.shape
            if width == 1:
                best, going = None, np.zeros(count, bool)
            else:
                best = agenda.argmin(axis=1)
                going = agenda[np.arange(count), best] < self.none
            if not going.all():
                done = ~going
                for row, ids in zip(rows[done].tolist(), symbols[done].tolist()):
                    out[row] = ids
                if not going.any():
                    return
                symbols, agenda, rows, best = symbols[going], agenda[going], rows[going], best[going]
                count = len(rows)
            each = np.arange(count)
            symbols[each, best] = self._joined(symbols[each, best], symbols[each, best + 1])
            keep = np.ones((count, width), bool)
            keep[each, best + 1] = False
            symbols = symbols[keep].reshape(count, width - 1)
            keep = np.ones((count, width - 1), bool)
            keep[each, best] = False
            agenda = agenda[keep].reshape(count, width - 2)
            if width == 2:
                continue
            left = np.flatnonzero(best > 0)
            at = best[left]
            agenda[left, at - 1] = self._ranks(symbols[left, at - 1], symbols[left, at])
            right = np.flatnonzero(best < width - 2)
            at = best[right]
            agenda[right, at] = self._ranks(symbols[right, at], symbols[right, at + 1])

    @cached_property
    def _pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and joined piece of every pair."""
        return dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_ids.tolist())))

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The agenda of one word as a heap of (rank, place), packed into a number each."""
        pairs, size, count = self._pairs, self.size, len(symbols)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))

        def pair(at: int):
            right = after[at]
            # Symbols below 0 are characters that join with nothing.
            if right == count or symbols[at] < 0 or symbols[right] < 0:
                return None
            return pairs.get(symbols[at] * size + symbols[right])

        agenda = [found[0] << 40 | at for at in range(count) if (found := pair(at))]
        heapify(agenda)
        gone = bytearray(count)
        while agenda:
            entry = heappop(agenda)
            rank, at = entry >> 40, entry & (1 << 40) - 1
            found = None if gone[at] else pair(at)
            if found is None or found[0] != rank:
                continue  # one of its symbols has been merged since
            right = after[at]
            symbols[at], gone[right], after[at] = found[1], 1, after[right]
            if after[right] < count:
                before[after[right]] = at
            for place in (before[at], at):
                if place >= 0 and (found := pair(place)):
                    heappush(agenda, found[0] << 40 | place)
        return [symbol for symbol, merged in zip(symbols, gone) if not merged]

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        out: list = [[] for _ in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        distinct, inverse = np.unique(codes, return_inverse=True)
        first = np.array([self.ids.get(chr(c), -1 - int(c)) for c in distinct.tolist()], np.int32)
        symbols = first[inverse] if len(codes) else np.zeros(0, np.int32)
        order = np.argsort(lengths, kind="stable")
        sizes, begins = np.unique(lengths[order], return_index=True)
        ends = np.append(begins[1:], len(order))
        for size, begin, end in zip(sizes.tolist(), begins.tolist(), ends.tolist()):
            rows = order[begin:end]
            if size >= LONG_WORD:
                for row in rows.tolist():
                    out[row] = self._merge_long(symbols[starts[row] : starts[row] + size].tolist())
            elif size:
                self._merge_in_step(symbols[starts[rows][:, None] + np.arange(size)], rows, out)
        odd = np.searchsorted(starts, np.flatnonzero(symbols < 0), side="right") - 1
        for row in np.unique(odd).tolist():
            out[row] = list(
                chain.from_iterable(
                    [i] if i >= 0 else [self.bytes[b] for b in chr(-1 - i).encode()] for i in out[row]
                )
            )
        return out

    def text_of(self, ids: list[int]) -> str:
        """Pieces joined, byte runs decoded, space marks as spaces."""
        if not self.byte_of.keys() & ids:
            return "".join([self.texts[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(self.texts[i])
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out)

    def split(self, text: str) -> list[str]:
        """Words without the space mark each begins with."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def learn(self, words: set[str]) -> None:
        """Encode words not met before, and compare them with the library."""
        new = [w for w in words if w not in self.known]
        if len(new) + len(self.known) > REMEMBERED:
            self.known.clear()
            new = list(words)
        found = self.merge([SPACE + w for w in new])
        texts = [self.text_of(ids) for ids in found]
        if self.check and new:
            theirs = self.library.encode([w.replace(SPACE, " ") for w in new], num_threads=1)
            for row, word in enumerate(new):
                # The library has no piece at all for the empty text.
                if word and theirs[row] != found[row]:
                    self.unequal += 1
                    found[row], texts[row] = theirs[row], self.text_of(theirs[row])
        numbers = self.numbers
        for word, ids, text in zip(new, found, texts):
            self.known[word] = (len(ids), ",".join([numbers[i] for i in ids]), text)

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        return list(chain.from_iterable(self.merge([SPACE + w for w in words])))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts in front is taken off."""
        return self.text_of(ids).removeprefix(" ")


@lru_cache(maxsize=2)
def _codec(model: str, check: bool) -> PieceCodec:
    return PieceCodec(model, check)


def encode_decode(
    documents: DataFrame, model: str, key: str = "doc_id", text: str = "text", check: bool = True
) -> DataFrame:
    """Per document: ``key``, text (decoded), n_tokens, ids_sha256, decoded_sha256, unequal.

    The ids are those of the sentencepiece library without begin or end marks. With
    ``check`` the library encodes the new words of every Arrow batch as well:
    ``unequal`` counts the words so far in the task that differed (0 is the rule), and
    such a word takes the library's ids.

    NULL and empty texts have no tokens. Repeated rows give repeated rows; further columns
    are left out, so their names do not matter. ``model`` is a path that each executor
    can read.
    """
    kind = documents.schema[key].dataType.simpleString()

    def sha(value: str) -> str:
        return hashlib.sha256(value.encode()).hexdigest()

    def run(batch):
        gc.disable()  # nothing here refers in circles, and a large dict is slow to walk
        codec = _codec(model, check)
        split = [codec.split(value) for value in texts_of(batch.column(1))]
        codec.learn(set(chain.from_iterable(split)))
        known = codec.known
        decoded, joined, counts = [], [], []
        for words in split:
            found = [known[w] for w in words]
            counts.append(sum([f[0] for f in found]))
            joined.append(sha(",".join([f[1] for f in found])))
            decoded.append("".join([f[2] for f in found]).removeprefix(" "))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(decoded, pa.string()),
                pa.array(counts, pa.int64()),
                pa.array(joined, pa.string()),
                pa.array([sha(v) for v in decoded], pa.string()),
                pa.array([codec.unequal] * len(split), pa.int64()),
            ],
            names=[key, "text", "n_tokens", "ids_sha256", "decoded_sha256", "unequal"],
        )

    return map_rows(
        documents.select(key, text),
        run,
        f"{key} {kind}, text string, n_tokens bigint, ids_sha256 string, decoded_sha256 string, unequal bigint",
        text=text,
    )
