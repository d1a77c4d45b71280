"""SentencePiece encoding and decoding by vectorised merge rounds.

A batch of texts is one flat array of symbols. It is cut into words wherever no piece of the model
could ever hold the two characters on either side, so every word can be merged by itself, and equal
words are merged once. In a round each word finds the least rank among its pairs of neighbours and
merges that pair everywhere it stands, leftmost first and without overlap; the array is compacted,
words without a pair leave it, and rounds go on until no word is left.

Merging one pair at a time, as the model is defined, gives the same pieces as long as a merge does
not bring up a pair that would go before the next one. Where it does, the word's round ends at that
merge. Pieces of the very last rank may share it (runs of blanks do, in some models): words that
have only such pairs are finished by one pass from left to right.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from boardwalk.llm.common import mix, narrow

BLOCK = 1 << 19  # characters merged together, and the length from which a text is cut
_SPACE = "▁"
_NONE = np.iinfo(np.int32).max
_SHORT = 48  # words up to this length are compared by hash, then character by character
_ODD = np.uint64(0x9E3779B97F4A7C55)
_PROBE = "  two  blanks ﬁ ① é é end "


class _Pairs:
    """(left, right) -> (piece, rank), an open table of numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, piece: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(left) * 6).bit_length())
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.piece = np.full(size, -1, np.int32)
        self.rank = np.full(size, _NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.steps = 0
        while len(todo):
            self.steps += 1
            free = todo[self.key[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            at = slot[put]
            self.key[at], self.piece[at], self.rank[at] = keys[put], piece[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair; -1 and the greatest number where there is none."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        at = self._slot(keys)
        held = self.key[at]
        for _ in range(self.steps):
            wrong = np.flatnonzero((held != keys) & (held >= 0))
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & (len(self.key) - 1)
            held[wrong] = self.key[at[wrong]]
        hit = held == keys
        return np.where(hit, self.piece[at], -1), np.where(hit, self.rank[at], _NONE)


class Model:
    """Tables of one model file of kind BPE with byte fallback and no normalisation of its own.

    A file of another kind is refused, as it would be encoded otherwise than its library does.
    """

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = len(library)
        names = [library.id_to_piece(i) for i in range(size)]
        self.special = np.array([library.is_control(i) or library.is_unknown(i) for i in range(size)])
        self.is_byte = np.array([library.is_byte(i) for i in range(size)])
        normal = np.flatnonzero(~(self.special | self.is_byte))
        self._refuse_other_kinds(library)
        score = np.array([library.get_score(int(i)) for i in normal])
        # rank 0 is the best score; equal scores share a rank and go by place
        rank = np.unique(-score, return_inverse=True)[1]
        ids = {names[i]: int(i) for i in normal}
        self.content = [b"" if self.special[i] else bytes([int(n[3:5], 16)]) if self.is_byte[i]
                        else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)]
        self.starts_blank = np.array([n.startswith(_SPACE) for n in names])
        self.unknown = library.unk_id()
        self.content[self.unknown] = " ⁇ ".encode()
        self.decimal = np.array([str(i) for i in range(size)], object)
        self.byte_id = np.zeros(256, np.int64)
        self.byte_id[[self.content[i][0] for i in np.flatnonzero(self.is_byte)]] = np.flatnonzero(self.is_byte)
        # symbols: a piece's id, or minus one minus the code point of a character without a piece
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        rows, joints = [], set()
        for i, place in zip(normal, range(len(normal))):
            name = names[i]
            if len(name) == 1:
                self.symbol[ord(name)] = i
            joints.update(zip(name, name[1:]))
            rows += [(ids[name[:k]], ids[name[k:]], i, rank[place]) for k in range(1, len(name))
                     if name[:k] in ids and name[k:] in ids]
        self.symbol[ord(" ")] = self.symbol[ord(_SPACE)]
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.pairs = _Pairs(*table.T)
        self.last_rank = int(rank.max())
        # characters that stand inside pieces get small numbers; a bit says which two stand together
        inner = sorted({c for pair in joints for c in pair})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.letter[ord(" ")] = self.letter[ord(_SPACE)]
        self.width = len(inner) + 1
        numbers = {c: k for k, c in enumerate(inner, 1)}
        held = np.zeros(self.width * self.width, bool)
        held[[numbers[a] * self.width + numbers[b] for a, b in joints]] = True
        self.joint = np.packbits(held, bitorder="little")
        self._tied = {(int(a), int(b)): int(p) for a, b, p, r in table if r == self.last_rank}
        # one pass from the left is right only if these pieces are parts of none that goes before
        last = np.isin(table[:, :2], list(self._tied.values())).any(axis=1)
        self.finish_from_left = bool((table[last, 3] == self.last_rank).all())

    @staticmethod
    def _refuse_other_kinds(library) -> None:
        first = library.encode(_PROBE, out_type=str)[:1]
        if library.decode(library.encode(_PROBE)) != _PROBE or not first or not first[0].startswith(_SPACE * 2):
            raise ValueError("only models that keep texts as they are and put a blank before them are supported")

    # --- encoding -----------------------------------------------------------------------------

    def _joined(self, points: np.ndarray) -> np.ndarray:
        """For each character but the first: may a piece hold it together with the one before?"""
        letter = self.letter[points].astype(np.int64)
        at = letter[:-1] * self.width + letter[1:]
        return ((self.joint[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    def cut(self, text: str, size: int = BLOCK) -> list[str]:
        """The text in parts of about ``size`` characters, cut only between words."""
        parts, start = [], 0
        while len(text) - start > size:
            end = start + size
            while end < len(text):
                points = np.frombuffer(text[end - 1:end + 4096].encode("utf-32-le"), "<u4")
                free = np.flatnonzero(~self._joined(points))
                if len(free):
                    end += int(free[0])
                    break
                end += len(points) - 1
            parts.append(text[start:end])
            start = end
        return [*parts, text[start:]]

    def encode(self, texts: list[str], begins: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins in it (one more at the end).

        ``begins`` says which of them begin a text and so get the blank in front; default all.
        """
        whole = [_SPACE + t if t and (begins is None or begins[k]) else t for k, t in enumerate(texts)]
        points = np.frombuffer("".join(whole).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) for t in whole], dtype=np.int64)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        starts = np.ones(len(points), bool)
        starts[1:] = ~self._joined(points)
        starts[ends[ends < len(points)]] = True
        word = np.flatnonzero(starts)
        symbols = self.symbol[points]
        of, first = self._distinct(symbols, word)
        length = np.diff(np.append(word, len(points)))
        ids, counts = self._merge(*_gathered(symbols, word[first], length[first]))
        offset = np.cumsum(counts) - counts
        flat, _ = _gathered(ids, offset[of], counts[of])
        total = np.concatenate([[0], np.cumsum(counts[of])])
        border = np.searchsorted(word, np.concatenate([[0], ends]))
        return flat, total[border]

    @staticmethod
    def _distinct(symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word among the different ones, and a place of each of those in ``word``."""
        length = np.diff(np.append(word, len(symbols)))
        number = np.empty(len(symbols), np.uint64)
        place = np.arange(len(symbols)) - np.repeat(word, length)
        number[:] = mix(symbols.astype(np.int64).view(np.uint64) * _ODD + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        key = mix(np.add.reduceat(number, word) + length.astype(np.uint64))
        long = np.flatnonzero(length > _SHORT)
        key[long] = long.astype(np.uint64)  # long words stand for themselves
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        same, _ = _gathered(symbols, word[first[of]], np.minimum(length, length[first[of]]))
        if (length[first[of]] != length).any() or (same != symbols).any():
            return np.arange(len(word)), np.arange(len(word))  # two words share a hash: merge them all
        return of, first

    def _merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words laid one after another, and how many each of them has."""
        symbols = symbols.astype(np.int32)
        owner = np.repeat(np.arange(len(counts)), counts)
        done_symbols, done_owner = [], []
        piece, rank = self._ranks(symbols, owner)
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(begin, len(symbols)))
            least = np.minimum.reduceat(rank, begin)
            tied = np.flatnonzero((least == self.last_rank) & (sizes > 2) & self.finish_from_left)
            for k in tied.tolist():
                low, high = begin[k], begin[k] + sizes[k]
                kept = self._from_left(symbols[low:high].tolist())
                done_symbols.append(np.array(kept, np.int32))
                done_owner.append(np.full(len(kept), owner[low]))
            finished = least == _NONE
            still = ~finished
            still[tied] = False
            if finished.any():
                out = np.repeat(finished, sizes)
                done_symbols.append(symbols[out])
                done_owner.append(owner[out])
            if not still.all():
                inside = np.repeat(still, sizes)
                symbols, owner, piece, rank = symbols[inside], owner[inside], piece[inside], rank[inside]
                begin = np.cumsum(sizes[still]) - sizes[still]
                least, sizes = least[still], sizes[still]
            if len(symbols):
                symbols, owner, piece, rank = self._round(symbols, owner, piece, rank, np.repeat(least, sizes))
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return self._bytes(symbols[order], owner[order], len(counts))

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each symbol with the next one of its word."""
        piece, rank = np.full(len(symbols), -1, np.int32), np.full(len(symbols), _NONE, np.int32)
        self._look_up(np.arange(len(symbols)), symbols, owner, piece, rank)
        return piece, rank

    def _look_up(self, places, symbols, owner, piece, rank) -> None:
        """Fill in piece and rank at the given places."""
        piece[places], rank[places] = -1, _NONE
        last = len(symbols) - 1
        places = places[places < last]
        places = places[(owner[places] == owner[places + 1]) & (symbols[places] >= 0) & (symbols[places + 1] >= 0)]
        piece[places], rank[places] = self.pairs.find(symbols[places], symbols[places + 1])

    def _round(self, symbols, owner, piece, rank, least):
        """One round: the least pair of each word merged wherever it stands, as far as that is what
        merging one at a time would do."""
        hit = np.flatnonzero(rank == least)
        # of pairs that overlap in a row, every other one counts
        row = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
        within = np.arange(len(hit)) - np.repeat(row, np.diff(np.append(row, len(hit))))
        hit = hit[within % 2 == 0]
        table, at = self._merged(symbols, owner, piece, rank, hit)
        new_owner, new_rank = table[1], table[3]
        # does a merge bring up a pair that goes before the next merge of its word?
        limit = least[hit]
        sooner = new_rank[at] <= limit
        before = np.maximum(at - 1, 0)
        sooner |= (new_rank[before] <= limit) & (new_owner[before] == new_owner[at]) & (at > 0)
        if not sooner.any():
            return table
        # keep, in each such word, the merges up to the first of that sort, and do the rest later
        word = new_owner[at]
        firsts = np.full(int(word.max()) + 1, len(hit))
        np.minimum.at(firsts, word[sooner], np.flatnonzero(sooner))
        return self._merged(symbols, owner, piece, rank, hit[np.arange(len(hit)) <= firsts[word]])[0]

    def _merged(self, symbols, owner, piece, rank, hit):
        """The four arrays after the pairs at ``hit`` have become one symbol each, and where those are."""
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols = symbols.copy()
        symbols[hit] = piece[hit]
        at = hit - np.arange(len(hit))
        symbols, owner, piece, rank = symbols[keep], owner[keep], piece[keep], rank[keep]
        touched = np.zeros(len(symbols), bool)
        touched[at] = True
        touched[np.maximum(at - 1, 0)] = True
        self._look_up(np.flatnonzero(touched), symbols, owner, piece, rank)
        return (symbols, owner, piece, rank), at

    def _from_left(self, symbols: list[int]) -> list[int]:
        """A word all of whose pairs have the last rank: always the leftmost pair merges, so what is
        behind has none, and one pass will do."""
        kept: list[int] = []
        for symbol in symbols:
            kept.append(symbol)
            while len(kept) > 1:
                joined = self._tied.get((kept[-2], kept[-1]))
                if joined is None:
                    break
                kept[-2:] = [joined]
        return kept

    def _bytes(self, symbols, owner, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become one id for each byte of their UTF-8 form."""
        own = symbols >= 0
        points = np.where(own, 0, -1 - symbols.astype(np.int64))
        extra = (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        count = extra + 1
        at = np.repeat(np.arange(len(symbols)), count)
        k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        point, more = points[at], extra[at]
        lead = np.array([0, 0xC0, 0xE0, 0xF0])[more]
        byte = np.where(k == 0, lead | (point >> (6 * more)), 0x80 | ((point >> (6 * (more - k))) & 0x3F))
        ids = np.where(own[at], symbols[at], self.byte_id[byte & 0xFF])
        return ids, np.bincount(owner, count, words).astype(np.int64)

    # --- decoding -----------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: one blank in front goes; control ids are nothing; bytes that make
        no character give one replacement character each."""
        return b"".join(self.decode_parts([ids]))

    def decode_parts(self, parts: Iterator[np.ndarray]) -> Iterator[bytes]:
        """The same for ids that come in parts."""
        front, rest = True, b""
        for ids in parts:
            if not len(ids):
                continue
            ids = np.asarray(ids, np.int64)
            made = list(map(self.content.__getitem__, ids.tolist()))
            if front:
                # control ids say nothing, so they do not end the front
                shown = np.flatnonzero(~self.special[ids] | (ids == self.unknown))
                if len(shown):
                    front = False
                    if self.starts_blank[ids[shown[0]]]:
                        made[shown[0]] = made[shown[0]][1:]
            in_bytes = self.is_byte[ids]
            # byte ids at the end may go on in the next part
            tail = len(ids) - int(np.argmin(in_bytes[::-1])) if not in_bytes.all() else 0
            head = rest + b"".join(made[:tail]) if tail else b""
            rest = b"".join(made[tail:]) if tail else rest + b"".join(made)
            if head:
                yield _valid(head)
        if rest:
            yield _valid(rest)


def _valid(content: bytes) -> bytes:
    try:
        content.decode()
        return content
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(content):
        size = next((k for k in range(1, 5) if _is_character(content[at:at + k])), 0)
        out.append(content[at:at + size] if size else "�".encode())
        at += size or 1
    return b"".join(out)


def _is_character(content: bytes) -> bool:
    try:
        return len(content.decode()) == 1
    except UnicodeDecodeError:
        return False


def _gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``values`` one after another, and their lengths."""
    shift = starts - (np.cumsum(counts) - counts)
    return values[np.arange(int(counts.sum())) + np.repeat(shift, counts)], counts


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def _encoded(model: Model, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of all texts in order, several parts of a row where its text is long. No more than
    about two blocks of characters are merged at a time."""
    rows, parts, begins, waiting = [], [], [], 0
    for row, text in enumerate(texts):
        for k, part in enumerate(model.cut(text)):
            rows.append(row)
            parts.append(part)
            begins.append(k == 0)
            waiting += len(part)
            if waiting >= BLOCK:
                yield from _together(model, rows, parts, begins)
                rows, parts, begins, waiting = [], [], [], 0
    yield from _together(model, rows, parts, begins)


def _together(model: Model, rows: list[int], parts: list[str], begins: list[bool]) -> Iterator[tuple[int, np.ndarray]]:
    ids, border = model.encode(parts, begins)
    for k, row in enumerate(rows):
        yield row, ids[border[k]:border[k + 1]]


def _by_row(pairs: Iterator[tuple[int, np.ndarray]], count: int) -> Iterator[list[np.ndarray]]:
    parts: list[np.ndarray] = []
    now = 0
    for row, ids in pairs:
        while now < row:
            yield parts
            parts, now = [], now + 1
        parts.append(ids)
    while now < count:
        yield parts
        parts, now = [], now + 1


def _digest(model: Model, parts: list[np.ndarray]) -> tuple[int, str, str]:
    ids, decoded = hashlib.sha256(), hashlib.sha256()
    total = 0
    for part in parts:
        if len(part):
            ids.update((("," if total else "") + ",".join(model.decimal[part].tolist())).encode())
        total += len(part)
    for content in model.decode_parts(parts):
        decoded.update(content)
    return total, ids.hexdigest(), decoded.hexdigest()


def encode(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id`` with ``ids`` (array of int), one row for each row of ``documents``.

    The model is a BPE model with byte fallback and no normalisation; ids of its begin and end are
    never added. Null texts count as empty, and empty ones have no ids. A text of any length is cut
    into blocks between words, so memory follows the longest text and not its pairs. Repeated rows and
    null ids stay; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            made = [np.concatenate([np.zeros(0, np.int32), *[p.astype(np.int32) for p in parts]])
                    for parts in _by_row(_encoded(model, texts), len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = narrow(documents, "doc_id").schema[0].dataType.simpleString()
    return narrow(documents, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` to ``doc_id, text``; null ids count as none, an id outside the model is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            made = [model.decode(np.array(ids or [], np.int64)).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "text"])

    kind = narrow(encoded, "doc_id").schema[0].dataType.simpleString()
    return narrow(encoded, "doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the round trip of every row in one pass.

    ``ids_sha256`` is over decimal ids joined by commas, ``decoded_sha256`` over the decoded text in
    UTF-8. Rows are treated as ``encode`` treats them.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [_digest(model, parts) for parts in _by_row(_encoded(model, texts), len(texts))]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names)

    kind = narrow(documents, "doc_id").schema[0].dataType.simpleString()
    return narrow(documents, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
