"""SentencePiece encoding and decoding by suffix-array matching.

Texts of a batch are cut where no piece can reach across, and their distinct units are concatenated. The
suffixes of that text, as far as the longest piece reaches, are sorted; a binary search for every piece of the
vocabulary gives the range of its occurrences. Sorted by position, these occurrences are the edges of a graph,
which is relaxed from left to right: among the pieces that end at a position, the one that byte-pair merging
would leave there is the one that stands next to its predecessor unmerged.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters of distinct units that are indexed together.
INDEXED = 1 << 19
#: Pairs of pieces that a task remembers.
PAIRS = 1 << 21
#: New pairs that are gathered before they are put among the others.
RECENT = 1 << 13
#: Units that it remembers, before those of one more batch.
UNITS = 800_000


class Pieces:
    """A byte-pair vocabulary of the sentencepiece library with byte fallback."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers as files
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or files.path("piece_bpe_32k.model"))
        names = [model.id_to_piece(i) for i in range(len(model))]
        self.text = ["" if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) else n for i, n in enumerate(names)]
        self.ids = {n: i for i, n in enumerate(self.text) if n}
        self.byte_id = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.unknown = model.unk_id()
        # what each id reads as, one after another
        read = [bytes([self.id_byte[i]]) if i in self.id_byte else b"" if model.is_control(i) else " ⁇ ".encode() if i == self.unknown else n.encode() for i, n in enumerate(self.text)]
        self.raw, self.raw_sizes = np.frombuffer(b"".join(read), np.uint8), np.array([len(x) for x in read], np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.rank = {n: i for i, n in enumerate(sorted(self.ids, key=lambda n: -model.get_score(self.ids[n])))}
        self.prefix = model.encode_as_pieces("a")[0].startswith(SPACE)  # whether a space is put before a text
        self.longest = max(map(len, self.ids))
        if strange := {c for n in self.ids for c in n} - set(self.ids):
            raise ValueError(f"characters of pieces that are no pieces: {sorted(strange)[:5]}")
        # a unit ends before a space that follows something else, unless a piece reaches across such a place
        across = any(SPACE in n.lstrip(SPACE) for n in self.ids)
        self.unit = re.compile(".+" if across else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.S)
        words = list(self.ids)
        self.piece_ids = np.array([self.ids[n] for n in words], np.int64)
        self.piece_lengths = np.array([len(n) for n in words], np.int64)
        self.depths = [4]  # characters by which suffixes are in order after each round of sorting
        while self.depths[-1] < self.longest:
            self.depths.append(2 * self.depths[-1])
        letters = sorted({c for n in words for c in n})
        self.code = np.full(0x110000, len(letters) + 1, np.uint64)  # all other characters alike
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.top = len(letters) + 2
        if self.top >> 16:
            raise ValueError("more characters than 16 bits tell apart")
        self.piece_codes = np.zeros((len(words), self.depths[-1]), np.uint64)
        for i, n in enumerate(words):
            self.piece_codes[i, : len(n)] = self.code[[ord(c) for c in n]]
        self.pairs, self.pairs_apart = np.array([-1], np.int64), np.array([False])
        self.recent, self.recent_apart = np.array([-1], np.int64), np.array([False])
        self.seen: dict[str, int] = {}  # units of earlier batches, with their ids
        self.flat, self.sizes = np.array([], np.int32), np.array([], np.int64)
        self.alone = np.zeros(len(names), bool)
        self.alone[[i for n, i in self.ids.items() if self.merged(n) == [n]]] = True

    def merged(self, text: str) -> list[str]:
        """Symbols that byte-pair merging leaves: of adjacent symbols, the best-scored merge first, leftmost of equals."""
        s = list(text)
        while len(s) > 1:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in zip(s, s[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def stays(self, left: int, right: int) -> bool:
        """Whether two pieces that stand side by side are left as they are by merging."""
        a, b = self.text[left], self.text[right]
        return a + b not in self.ids and self.merged(a + b) == [a, b]

    def suffix_array(self, text: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Suffixes in order of as many characters as the longest piece has, by doubling.

        Also, for each rank, where its first suffix stands in that order; and the sorted keys of each depth, a key's place being its rank.
        """
        codes = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = len(codes)
        some = np.concatenate([codes, np.zeros(4, np.uint64)])
        keys = some[:n] << np.uint64(48) | some[1 : n + 1] << np.uint64(32) | some[2 : n + 2] << np.uint64(16) | some[3 : n + 3]
        tables = []
        for depth in self.depths:
            order = np.argsort(keys)
            ordered = keys[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            tables.append(ordered[new])
            if depth < self.depths[-1]:
                rank = np.zeros(n + depth, np.uint64)
                rank[order] = np.cumsum(new)  # from 1; 0 is beyond the end
                keys = rank[:n] << np.uint64(32) | rank[depth : n + depth]
        return order, np.append(np.flatnonzero(new), n), tables

    def ranks(self, tables: list[np.ndarray], level: int, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For strings of up to depths[level] characters: the range of ranks of suffixes that begin with them."""
        table, depth = tables[level], self.depths[level]
        if level == 0:
            shift = np.arange(48, -1, -16).astype(np.uint64)
            low = (codes[:, :4] << shift).sum(axis=1, dtype=np.uint64)
            fill = np.where(np.arange(4) >= lengths[:, None], np.uint64(0xFFFF), np.uint64(0))
            high = low + (fill << shift).sum(axis=1, dtype=np.uint64)
            return np.searchsorted(table, low, "left"), np.searchsorted(table, high, "right")
        half = depth // 2
        lo, hi = self.ranks(tables, level - 1, codes[:, :half], np.minimum(lengths, half))
        low, high = (lo + 1).astype(np.uint64) << np.uint64(32), (hi + 1).astype(np.uint64) << np.uint64(32)
        long = np.flatnonzero(lengths > half)
        if len(long):
            lo2, hi2 = self.ranks(tables, level - 1, codes[long, half:depth], lengths[long] - half)
            low[long], high[long] = low[long] + (lo2 + 1).astype(np.uint64), low[long] + (hi2 + 1).astype(np.uint64)
        found = hi > lo
        low, high = np.searchsorted(table, low, "left"), np.searchsorted(table, high, "left")
        return low, np.where(found, high, low)

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of pieces in a text: end, start, piece."""
        suffixes, first, tables = self.suffix_array(text)
        lo, hi = self.ranks(tables, len(tables) - 1, self.piece_codes, self.piece_lengths)
        lo, hi = first[lo], first[hi]
        many = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(many)), many)
        start = suffixes[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        return start + self.piece_lengths[which], start, self.piece_ids[which]

    def side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """stays() of many pairs; what is known of pairs is kept in order of their keys, new ones apart until they are RECENT."""
        keys = left << 32 | right
        if len(self.pairs) > PAIRS:
            self.pairs, self.pairs_apart = np.array([-1], np.int64), np.array([False])
        out, known = looked_up(self.pairs, self.pairs_apart, keys)
        rest = np.flatnonzero(~known)
        if len(rest):
            out[rest], known = looked_up(self.recent, self.recent_apart, keys[rest])
            new = np.unique(keys[rest][~known])
            if len(new):
                apart = np.array([self.stays(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()])
                place = np.searchsorted(self.recent, new)
                self.recent, self.recent_apart = np.insert(self.recent, place, new), np.insert(self.recent_apart, place, apart)
                out[rest], _ = looked_up(self.recent, self.recent_apart, keys[rest])
            if len(self.recent) > RECENT:
                place = np.searchsorted(self.pairs, self.recent[1:])
                self.pairs, self.pairs_apart = np.insert(self.pairs, place, self.recent[1:]), np.insert(self.pairs_apart, place, self.recent_apart[1:])
                self.recent, self.recent_apart = np.array([-1], np.int64), np.array([False])
        return out

    def units(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and how many each has."""
        got = [self.relaxed(some) for some in chunks(names)]
        return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.array([], np.int32), np.array([], np.int64))

    def relaxed(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for units that are indexed together: all units go from left to right at once, a character a step.

        Characters that are no piece become their bytes; merging stops at them.
        """
        text = "".join(some)
        ends, starts, ids = self.edges(text)
        lengths = np.array([len(x) for x in some], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        fresh = np.zeros(len(text) + 1, bool)  # where nothing stands before
        fresh[bounds] = True
        known = {c: c in self.ids for c in set(text)}
        if not all(known.values()):
            fresh[[i + 1 for i, c in enumerate(text) if not known[c]]] = True
        passed = np.cumsum(fresh)
        inside = passed[ends - 1] == passed[starts]
        ends, starts, ids = ends[inside], starts[inside], ids[inside]
        step = ends - np.repeat(bounds[:-1], lengths)[ends - 1]
        order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
        ends, starts, ids, step = ends[order], starts[order], ids[order], step[order]
        last, back = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [len(step)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e, s, i = ends[a:b], starts[a:b], ids[a:b]
            begins, before = fresh[s], last[s]
            good = begins & self.alone[i]
            pair = np.flatnonzero(~begins & (before >= 0))
            good[pair] = self.side_by_side(before[pair], i[pair])
            last[e[good]], back[e[good]] = i[good], s[good]
        unit, at, out = np.flatnonzero(lengths), bounds[1:][lengths > 0], []
        while len(unit):
            piece = last[at]
            out.append((unit, at, piece))
            at = np.where(piece >= 0, back[at], at - 1)
            more = at > bounds[unit]
            unit, at = unit[more], at[more]
        unit, at, piece = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.array([], np.int64),) * 3
        order = np.argsort(at, kind="stable")
        unit, at, piece = unit[order], at[order], piece[order]
        if (piece < 0).any():
            raw = [[self.byte_id.get(b, self.unknown) for b in text[p - 1].encode("utf-8", "surrogatepass")] if i < 0 else [i] for p, i in zip(at.tolist(), piece.tolist(), strict=True)]
            unit, piece = np.repeat(unit, [len(x) for x in raw]), np.array([i for x in raw for i in x], np.int64)
        return piece.astype(np.int32), np.bincount(unit, minlength=len(some)).astype(np.int64)

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return self.unit.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.seen) > UNITS:
            self.seen, self.flat, self.sizes = {}, self.flat[:0], self.sizes[:0]
        seen, before = self.seen, len(self.seen)
        places = []
        for t in texts:
            units = self.cut(t)
            at = list(map(seen.get, units))
            if None in at:
                for u in itertools.compress(units, map(operator.is_, at, itertools.repeat(None))):
                    seen.setdefault(u, len(seen))
                at = list(map(seen.get, units))
            places.append(at)
        if len(seen) > before:
            new, n = self.units(list(itertools.islice(seen, before, None)))
            self.flat, self.sizes = np.concatenate([self.flat, new]), np.concatenate([self.sizes, n])
        flat, sizes = self.flat, self.sizes
        starts = np.cumsum(sizes) - sizes
        out = []
        for p in places:
            at = np.array(p, np.int64)
            n = sizes[at]
            out.append(flat[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(at) else flat[:0])
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: pieces joined, runs of byte pieces read as UTF-8, spaces back, the added one gone."""
        at = np.asarray(ids, np.int64)
        n = self.raw_sizes[at]
        raw = self.raw[np.repeat(self.raw_starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        text = raw.tobytes().decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of wanted keys in a sorted table, and which are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], keys[at] == wanted


@functools.lru_cache(maxsize=2)
def loaded(path: str | None) -> Pieces:
    """One vocabulary for all tasks of a Python worker, with the units and pairs that it remembers."""
    return Pieces(path)


def chunks(names: list[str]) -> Iterator[list[str]]:
    """Runs of units of about INDEXED characters; a longer unit is a run of its own."""
    at, size = 0, 0
    for i, x in enumerate(names):
        if size and size + len(x) > INDEXED:
            yield names[at:i]
            at, size = i, 0
        size += len(x)
    if names:
        yield names[at:]


def encoded(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each whole text; a null or empty text has none. Repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for batch in batches:
            for part in parts(batch):
                got = own.encode([x or "" for x in part.column(1).to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else [], pa.int32()))], ["doc_id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def parts(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text, so that units and ids of a batch stay small."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(1).cast(pa.binary())).to_numpy(zero_copy_only=False).astype(float))
    slot = (np.cumsum(sizes) // most).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit), decoded_crc32 (UTF-8 of the decoded ids), exact: it is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for batch in batches:
            for part in parts(batch):
                texts = [x or "" for x in part.column(1).to_pylist()]
                got = own.encode(texts)
                back = [own.decode(x) for x in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64()), pa.array([zlib.crc32(x.encode("utf-8", "replace")) for x in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)])],
                    ["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "exact"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_crc32 long, exact boolean")
