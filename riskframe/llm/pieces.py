"""SentencePiece encoding and decoding by suffix-array matching.

The distinct white-space segments of a batch are concatenated and their suffixes sorted (as far as the longest piece
reaches). Every piece of the vocabulary is found by binary search as a range of that order; its occurrences are edges
from start to end. The edges, sorted by the position of their end, are relaxed: a prefix is reached by the one edge
whose piece may follow the piece that reaches its start.

For a merge vocabulary (type BPE) "may follow" is exact: two neighbouring pieces stand in the result of the greedy
merges if and only if merging their joined text gives the two pieces back, so exactly one edge reaches a prefix and
the path is the sequence of the model's own merges. Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskframe.llm.common import strings

BLANK = "▁"
NORMAL, BYTE = 1, 6  # kinds of pieces in the model file
CACHE = 200_000  # distinct segments a task remembers before it starts anew
INDEXED = 1 << 18  # characters in one suffix array; a longer segment is one by itself
JUDGED = 2_097_143  # places for judged pairs, a prime; a pair whose place another has taken is judged anew
START, NONE = -2, -3


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str | None = None) -> bytes:
    """The model file, read once on the driver; its size does not depend on the data."""
    with open(path or default_model(), "rb") as f:
        return f.read()


class Vocabulary:
    """Pieces of a merge model without text normalisation."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or proto.normalizer_spec.name != "identity":
            raise ValueError("a BPE model without normalisation is needed")
        self.prefix = BLANK if proto.normalizer_spec.add_dummy_prefix else ""
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        pieces = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL]
        self.size = len(proto.pieces)
        self.id_of = {p: i for i, p, _ in pieces}
        order = {s: r for r, s in enumerate(sorted({s for _, _, s in pieces}, reverse=True))}
        self.rank = {p: order[s] for _, p, s in pieces}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.bytes_of = [b""] * self.size
        for i, p in enumerate(proto.pieces):
            self.bytes_of[i] = p.piece.replace(BLANK, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b""
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        if any(BLANK in p.lstrip(BLANK) for p in self.id_of):
            raise ValueError("a piece spans two words")
        line = "" if any("\n" in p for p in self.id_of) else "\\n"
        self.cut = re.compile(f"{BLANK}+[^{BLANK}{line}]*|{line or BLANK}|[^{BLANK}{line}]+")
        # pieces the greedy merges can make at all, with their last merge
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: list[tuple[str, int]] = []
        for piece, i in self.id_of.items():
            parts, last = self.merged(piece)
            if len(parts) == 1 and not (BLANK * 2 in piece):
                self.made.append((piece, i))
                if last:
                    self.halves[i] = (self.id_of[last[0]], self.id_of[last[1]])
        self.rank_of = {i: self.rank[p] for p, i in self.id_of.items()}
        self.text_of = {i: p for p, i in self.id_of.items()}
        self.follows = np.full(JUDGED, -1, np.int64)  # twice the pair, plus its verdict
        self._lay_out()

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The greedy merges themselves, best rank and then leftmost first, and the last pair merged."""
        symbols: list[str | None] = list(text)
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap = []

        def offer(a: int, b: int) -> None:
            rank = self.rank.get(symbols[a] + symbols[b])
            if rank is not None:
                heapq.heappush(heap, (rank, a, b, symbols[a], symbols[b]))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        last = None
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if symbols[a] != x or symbols[b] != y or after[a] != b:
                continue
            last = (x, y)
            symbols[a], symbols[b] = x + y, None
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return [s for s in symbols if s is not None], last

    def may_follow(self, x: int, y: int) -> bool:
        """Whether the merges of the joined text of two pieces end in the two pieces.

        The merges along the border are undone from the last; before each the pair across the border must not have
        been the better choice (the leftmost, if equal).
        """
        limit, left_first = None, False
        while True:
            across = self.rank.get(self.text_of[x] + self.text_of[y])
            if across is not None and (limit is None or across < limit or across == limit and left_first):
                return False
            a, b = self.halves.get(x), self.halves.get(y)
            if a is None and b is None:
                return True
            if b is None or a is not None and self.rank_of[x] > self.rank_of[y]:
                limit, left_first, x = self.rank_of[x], False, a[1]
            else:
                limit, left_first, y = self.rank_of[y], True, b[0]

    def _lay_out(self) -> None:
        """Characters as small codes, pieces as rows of packed codes: four to a 64-bit word."""
        self.made.sort()
        characters = sorted({c for p, _ in self.made for c in p})
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in characters]] = np.arange(2, len(characters) + 2)  # 0 ends a segment, 1 is unknown
        self.longest = max(len(p) for p, _ in self.made)
        self.words = -(-self.longest // 4)
        width = 4 * self.words
        low, high = np.zeros((len(self.made), width), np.uint64), np.full((len(self.made), width), 0xFFFF, np.uint64)
        for r, (p, _) in enumerate(self.made):
            low[r, :len(p)] = high[r, :len(p)] = self.code[[ord(c) for c in p]]
        self.low, self.high = _packed(low.reshape(-1, self.words, 4)), _packed(high.reshape(-1, self.words, 4))
        self.lengths = np.array([len(p) for p, _ in self.made], np.int64)
        self.ids = np.array([i for _, i in self.made], np.int64)

    def encode_segments(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of each segment."""
        ids, begins, counts = self.encode_in_a_row(segments)
        return [ids[a:b] for a, b in zip(begins.tolist(), (begins + counts).tolist())]

    def encode_in_a_row(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where those of each segment begin and how many they are.

        A run of several blanks ties merges of equal rank; such segments are merged directly.
        """
        begins, counts = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        plain, parts, total, blanks = [], [], 0, BLANK * 2
        for k, s in enumerate(segments):
            if blanks in s:
                ids = [i for p in self.merged(s)[0] for i in self._ids(p)]
                parts.append(np.array(ids, np.int32))
                begins[k], counts[k], total = total, len(ids), total + len(ids)
            else:
                plain.append(k)
        begin = 0
        sizes = np.cumsum([0, *(len(segments[k]) for k in plain)])
        while begin < len(plain):  # a bounded number of characters at once: the edges take far more memory than the text
            end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + INDEXED, "right")) - 1)
            chunk = plain[begin:end]
            ids, lengths = self._relaxed([segments[k] for k in chunk])
            parts.append(ids)
            begins[chunk], counts[chunk], total = total + np.cumsum(lengths) - lengths, lengths, total + len(ids)
            begin = end
        return np.concatenate([np.zeros(0, np.int32), *parts]), begins, counts

    def _ids(self, piece: str) -> list[int]:
        found = self.id_of.get(piece)
        if found is not None:
            return [found]
        return [self.byte_id.get(b, self.unknown) for b in piece.encode()] if self.byte_id else [self.unknown]

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece row) of every occurrence of every piece in the coded text.

        Suffixes are sorted by four characters, then those in the ranges of longer pieces by the next four, and so on.
        """
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(3, np.uint16)]).astype(np.uint64)
        quads = _packed(np.lib.stride_tricks.sliding_window_view(padded, 4))
        suffixes = np.argsort(quads)
        keys = quads[suffixes]
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank = np.empty(n, np.int64)
        rank[suffixes] = np.cumsum(fresh) - 1
        first, last = np.searchsorted(keys, self.low[:, 0]), np.searchsorted(keys, self.high[:, 0], "right")
        values = keys[fresh]
        for w in range(1, self.words):
            longer = np.flatnonzero((self.lengths > 4 * w) & (first < last))
            # pieces that begin alike have one range, and no suffix of it ends its segment there
            begins, one, which = np.unique(first[longer], return_index=True, return_inverse=True)
            counts = (last - first)[longer[one]]
            places = _ranges(begins, counts)
            among = suffixes[places]
            keys = np.repeat(np.arange(len(begins)) << 32, counts) | rank[among + 4 * w]
            order = np.argsort(keys)
            keys, suffixes[places] = keys[order], among[order]
            shift = (begins - (np.cumsum(counts) - counts))[which]
            first[longer] = shift + np.searchsorted(keys, which << 32 | np.searchsorted(values, self.low[longer, w]))
            last[longer] = shift + np.searchsorted(keys, which << 32 | np.searchsorted(values, self.high[longer, w], "right"))
        counts = last - first
        rows = np.repeat(np.arange(len(counts)), counts)
        return suffixes[_ranges(first, counts)], self.lengths[rows], rows

    def _relaxed(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments without several blanks in a row, one after another, and how many each has."""
        sizes = np.array([len(s) for s in segments], np.int64)
        text = "\0".join(segments) + "\0"
        raw = np.frombuffer(text.encode("utf-32-le"), "<u4")
        ends = np.cumsum(sizes + 1) - 1
        begin = ends - sizes
        codes = self.code[raw]
        codes[codes == 0] = 1
        codes[ends] = 0
        start, length, row = self._edges(codes)
        piece = self.ids[row]
        strange = np.flatnonzero(codes == 1)  # characters without a piece stand alone
        start, length = np.concatenate([start, strange]), np.concatenate([length, np.ones(len(strange), np.int64)])
        piece = np.concatenate([piece, np.full(len(strange), -1)])
        owner = np.repeat(begin, sizes + 1)
        end = start + length
        offset = end - owner[start]  # how far into its segment the edge ends
        longest = int(sizes.max())
        order = np.argsort(offset.astype(np.uint16) if longest < 1 << 16 else offset, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        borders = np.concatenate([[0], np.cumsum(np.bincount(offset, minlength=longest + 1))])
        reached, came = np.full(len(codes) + 1, NONE, np.int64), np.zeros(len(codes) + 1, np.int64)
        reached[begin] = START
        for k in range(1, longest + 1):
            a, b = borders[k], borders[k + 1]
            if a == b:
                continue
            s, p = start[a:b], piece[a:b]
            good = self._fits(reached[s], p)
            to = end[a:b][good]
            reached[to], came[to] = p[good], s[good]
        # walk back from the ends, all segments together
        on_path = np.zeros(len(codes), bool)
        here = ends[sizes > 0]
        while len(here):
            on_path[here] = True
            here = came[here]
            here = here[here > owner[here]]
        where = np.flatnonzero(on_path)
        ids, counts = reached[where], np.diff(np.searchsorted(where, ends, "right"), prepend=0)
        if (ids < 0).any():
            ids, counts = self._with_bytes(ids, counts, raw[where - 1])
        return ids.astype(np.int32), counts

    def _with_bytes(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with the byte pieces of each character that has none of its own."""
        characters, which = np.unique(raw[ids < 0], return_inverse=True)
        spelled = [self._ids(chr(c)) for c in characters.tolist()]
        sizes = np.array([len(x) for x in spelled])
        times = np.ones(len(ids), np.int64)
        times[ids < 0] = sizes[which]
        out = np.repeat(ids, times)
        out[out < 0] = np.concatenate(spelled)[_ranges((np.cumsum(sizes) - sizes)[which], sizes[which])]
        to = np.concatenate([[0], np.cumsum(times)])[np.cumsum(counts)]
        return out, np.diff(to, prepend=0)

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which edges may follow what reached their start. Pairs are judged once and remembered."""
        good = (before == START) | (before == -1) | ((piece == -1) & (before != NONE))
        ask = np.flatnonzero(~good & (before >= 0))
        if len(ask):
            pairs = before[ask] * self.size + piece[ask]
            held = self.follows[pairs % JUDGED]
            verdicts = (held & 1).astype(bool)
            unknown = np.flatnonzero(held >> 1 != pairs)
            if len(unknown):
                new, back = np.unique(pairs[unknown], return_inverse=True)
                judged = np.array([self.may_follow(*divmod(key, self.size)) for key in new.tolist()])
                self.follows[new % JUDGED] = 2 * new + judged
                verdicts[unknown] = judged[back]
            good[ask] = verdicts
        return good

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(self.prefix + text.replace(" ", BLANK)) if text else []

    def decode(self, ids) -> str:
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _packed(quads: np.ndarray) -> np.ndarray:
    q = quads.astype(np.uint64, copy=False)
    return (q[..., 0] << np.uint64(48)) | (q[..., 1] << np.uint64(32)) | (q[..., 2] << np.uint64(16)) | q[..., 3]


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The tables of a model, laid out once per process."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Vocabulary(model)
    return _LOADED[model]


class _Numbers(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes batches, remembering the ids of the segments seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.index = _Numbers()
        self.ids, self.counts, self.begins = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids end."""
        if len(self.index) > CACHE:
            self._forget()
        cut = [self.v.segments(t) for t in texts]
        index, known = self.index, len(self.index)
        which = np.fromiter(map(index.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        if len(index) > known:
            ids, begins, counts = self.v.encode_in_a_row(list(islice(index, known, None)))
            self.begins = np.concatenate([self.begins, begins + len(self.ids)])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        counts = self.counts[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        per_text = np.cumsum([len(c) for c in cut]) if cut else np.zeros(0, np.int64)
        return self.ids[_ranges(self.begins[which], counts)], ends[per_text]


ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("n_pieces", T.LongType()),
    T.StructField("round_trip", T.BooleanType()),
])


def encoded(model: bytes, text: str | Column) -> Column:
    """A struct per text: its ids, their number, and whether decoding them gives the text back.

    A null or empty text has no ids and a true round trip. The model writes a blank as U+2581, so a text that holds
    this character itself decodes to a blank there: its round trip is false. Texts of any length are encoded whole
    and alone: repeated rows give equal results and other columns play no part.
    """
    @F.arrow_udf(ENCODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(model)
        encoder = Encoder(v)
        for batch in batches:
            texts = strings(batch)
            ids, ends = encoder.batch(texts)
            begins = [0, *ends.tolist()]
            same = [v.decode(ids[a:b].tolist()) == t for t, a, b in zip(texts, begins, begins[1:])]
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.StructArray.from_arrays([lists, pa.array(np.diff(begins), pa.int64()), pa.array(same, pa.bool_())], names=ENCODED.names)

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def decoded(model: bytes, ids: str | Column) -> Column:
    """The text of an array of ids; null gives null."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(model)
        for batch in batches:
            yield pa.array([None if x is None else v.decode(x) for x in batch.to_pylist()], pa.string())

    return run(F.col(ids) if isinstance(ids, str) else ids)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: bytes | None = None) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip) of every row; see ``encoded``."""
    return docs.select(F.col(doc_id), encoded(model or read_model(), text).alias("x")).select(doc_id, "x.*")
