"""SentencePiece encoding and decoding for merge-type vocabularies.

A text starts as single characters. An agenda holds the adjacent pairs of
symbols that the vocabulary can merge, ordered by score and then from the left;
the best pair is merged, its neighbours form new pairs, and so on until no pair
is left. No piece has a blank after another character, so merges never cross the
place before a blank, and a text is the chain of its blank-led segments. Short
segments of an Arrow batch run their agendas side by side in numpy, one merge
each and round; long ones run on a heap.

Every segment that a worker meets for the first time is also encoded and decoded
by the sentencepiece library, batch by batch, and must agree.

Null and empty texts have the end id only and decode to an empty text. Repeated
rows and texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import Memo, chunks, ranges, worker_memo

BLANK = "▁"
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_NONE = np.int64(1) << 60
_LONG = 64


class PieceModel:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        spec, types = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("needs a merge-type vocabulary with bytes for unknown characters")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("needs a vocabulary that leaves texts as they are but for a leading blank")
        if {t for _, _, t in pieces} - {types.NORMAL, types.UNKNOWN, types.CONTROL, types.BYTE} or any(BLANK in p.lstrip(BLANK) for p, _, _ in pieces):
            raise ValueError("needs a vocabulary of plain pieces with blanks at their start only")
        self.end_id = self.library.eos_id()
        normal = {p: i for i, (p, _, t) in enumerate(pieces) if t == types.NORMAL}
        # Characters of pieces that aren't pieces themselves get numbers above the ids.
        symbols = dict(normal)
        for piece in normal:
            for char in piece:
                symbols.setdefault(char, len(pieces) + len(symbols))
        self.of_char = np.full(0x110000, -1, np.int64)
        for symbol, number in symbols.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = number
        order = {s: k for k, s in enumerate(sorted({-s for _, s, _ in pieces}))}
        self.rank = np.array([order[-s] for _, s, _ in pieces], np.int64)
        self.merges: dict[int, int] = {}
        for piece, number in normal.items():
            for k in range(1, len(piece)):
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left is not None and right is not None:
                    self.merges[left << 20 | right] = number
        self._keys = np.array(sorted(self.merges), np.int64)
        self._values = np.array([self.merges[k] for k in self._keys.tolist()], np.int64)
        # Open hash table of the merges, for lookups of whole arrays.
        size = 1 << 19
        self._slots, self._found, self._mask = np.full(size, -1, np.int64), np.zeros(size, np.int64), size - 1
        self._probes = self._fill()
        self.n_ids = len(pieces)
        self.byte_id = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        surface = []
        for piece, _, t in pieces:
            if t == types.NORMAL:
                surface.append(piece.replace(BLANK, " ").encode())
            elif t == types.BYTE:
                surface.append(bytes([int(piece[3:5], 16)]))
            else:
                surface.append(" ⁇ ".encode() if t == types.UNKNOWN else b"")
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.is_byte = np.array([t == types.BYTE for _, _, t in pieces])
        self.is_control = np.array([t == types.CONTROL for _, _, t in pieces])
        self.has_blank = np.array([p.startswith(BLANK) and t == types.NORMAL for p, _, t in pieces])
        self.flat, self.size = np.zeros(1 << 16, np.int32), 0
        self.memo = Memo(self._segments)

    # Merges -----------------------------------------------------------------

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def _fill(self) -> int:
        """Put every merge in the first free slot from its own on; the longest way taken."""
        longest, left, at = 1, np.arange(len(self._keys)), self._slot(self._keys)
        while len(left):
            free = self._slots[at] < 0
            take, first = np.unique(at[free], return_index=True)
            winners = np.flatnonzero(free)[first]
            self._slots[take] = self._keys[left[winners]]
            self._found[take] = self._values[left[winners]]
            stay = np.ones(len(left), bool)
            stay[winners] = False
            left, at = left[stay], (at[stay] + 1) & self._mask
            longest += 1
        return longest

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols merges into, or -1."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left << 20 | right)
        out, todo, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        for _ in range(self._probes):
            slot = self._slots[at]
            hit = slot == keys[todo]
            out[todo[hit]] = self._found[at[hit]]
            go = ~hit & (slot >= 0)
            if not go.any():
                break
            todo, at = todo[go], (at[go] + 1) & self._mask
        return out

    def agenda(self, symbols: list[int]) -> list[int]:
        """Positions of the symbols left and what they became, by a heap of pairs.

        Returns a list as long as the input: the final symbol at each position,
        -2 where a position was merged into one on its left.
        """
        symbols, n = list(symbols), len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []
        rank = self.rank

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and symbols[left] >= 0 and symbols[right] >= 0:
                piece = self.merges.get(symbols[left] << 20 | symbols[right])
                if piece is not None:
                    heapq.heappush(heap, (int(rank[piece]), left, symbols[left], symbols[right], piece))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, left, a, b, piece = heapq.heappop(heap)
            right = after[left]
            if symbols[left] != a or right < 0 or symbols[right] != b:
                continue
            symbols[left], symbols[right] = piece, -2
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return symbols

    def _side_by_side(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``agenda`` of many segments at once: each round merges the best pair of each."""
        final = np.full(len(symbols), -2, np.int64)
        place, now = np.arange(len(symbols)), symbols.copy()
        segment = np.repeat(np.arange(len(lengths)), lengths)
        into = np.full(len(now), -1, np.int64)
        joined = np.flatnonzero(segment[1:] == segment[:-1])
        into[joined] = self.merged(now[joined], now[joined + 1])
        while len(now):
            start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            key = np.where(into >= 0, self.rank[into] << 32 | np.arange(len(now)), _NONE)
            best = np.minimum.reduceat(key, start)
            done = best == _NONE
            if done.any():
                over = np.repeat(done, np.diff(np.append(start, len(now))))
                final[place[over]] = now[over]
                live = ~over
                now, place, segment, into, key = now[live], place[live], segment[live], into[live], key[live]
                if not len(now):
                    break
                moved = np.cumsum(live) - 1
                at = moved[best[~done] & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            now[at] = into[at]
            stay = np.ones(len(now), bool)
            stay[at + 1] = False
            to = np.cumsum(stay) - 1
            now, place, segment, into = now[stay], place[stay], segment[stay], into[stay]
            at = to[at]
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(now) - 1)
                same = (right > left) & (segment[left] == segment[right])
                into[left] = np.where(same, self.merged(now[left], now[right]), -1)
        return final

    # Segments ---------------------------------------------------------------

    def segment_ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments on end, and the number of each one's ids."""
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        symbols = self.of_char[points]
        of = np.repeat(np.arange(len(lengths)), lengths)
        long = lengths > _LONG
        final = np.empty(len(symbols), np.int64)
        short = ~long[of]
        final[short] = self._side_by_side(symbols[short], lengths[~long])
        ends = np.cumsum(lengths)
        for k in np.flatnonzero(long).tolist():
            final[ends[k] - lengths[k] : ends[k]] = self.agenda(symbols[ends[k] - lengths[k] : ends[k]].tolist())
        kept = final != -2
        final, points, of = final[kept], points[kept], of[kept]
        # Characters that are no piece become the ids of their bytes.
        unknown = (final < 0) | (final >= self.n_ids)
        if unknown.any():
            size = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
            counts = np.where(unknown, size, 1)
            data = "".join(map(chr, points[unknown].tolist())).encode("utf-8", "surrogatepass")
            out = np.repeat(final, counts)
            out[np.repeat(unknown, counts)] = self.byte_id[np.frombuffer(data, np.uint8)]
            final, of = out, np.repeat(of, counts)
        return final, np.bincount(of, minlength=len(segments))

    def _segments(self, segments: list[str]) -> list[np.ndarray]:
        ids, counts = self.segment_ids(segments)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        own = ids.tolist()
        lists = [own[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        texts = [s[1:].replace(BLANK, " ") for s in segments]
        # A blank alone can't be put to the library: it would be the blank that leads every text.
        agrees = np.array([a == b or s == BLANK for s, a, b in zip(segments, lists, self.library.encode(texts, num_threads=1), strict=True)], bool)
        if self.library.decode(own) != self.decode(ids, np.array([0, len(ids)])).to_pylist()[0]:
            decoded = self.decode(ids, offsets).to_pylist()
            agrees &= np.array([a == b for a, b in zip(decoded, self.library.decode(lists, num_threads=1), strict=True)], bool)
        start, need = self.size, self.size + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(need, np.int32)])
        self.flat[start:need], self.size = ids, need
        return [start + offsets[:-1], counts.astype(np.int64), agrees]

    # Texts ------------------------------------------------------------------

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts on end, the n + 1 places of texts, and which texts agree with the library."""
        if self.memo.trim():
            kept = self.memo.columns or [np.zeros(0, np.int64)] * 3
            found = self.flat[ranges(kept[0], kept[1])]
            self.flat[: len(found)], self.size = found, len(found)
            kept[0][:] = np.cumsum(kept[1]) - kept[1]
        segments, counts = [], []
        for text in texts.to_pylist():
            if not text:
                counts.append(0)
                continue
            marked = BLANK + text.replace(" ", BLANK)
            if BLANK + BLANK in marked or marked[-1] == BLANK:
                own = _SEGMENT.findall(marked)
            else:
                own = marked[1:].split(BLANK)
                own = [BLANK + s for s in own]
            segments += own
            counts.append(len(own))
        rows = self.memo.rows(segments)
        starts, sizes, agrees = (x[rows] for x in self.memo.columns) if len(rows) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        wrong = np.concatenate([[0], np.cumsum(~agrees)])
        places = np.concatenate([[0], np.cumsum(sizes)])[first]
        return self.flat[ranges(starts, sizes)], places, wrong[first[1:]] == wrong[first[:-1]]

    def decode(self, ids: np.ndarray, places: np.ndarray) -> pa.StringArray:
        """Texts of the id lists; a leading blank goes, bytes that are no UTF-8 become U+FFFD."""
        counts, n = np.diff(places), len(places) - 1
        data = self.surface[ranges(self.surface_at[ids], self.surface_size[ids])]
        ends = np.concatenate([[0], np.cumsum(self.surface_size[ids])])
        offsets = ends[places]
        first = places[:-1].copy()
        while True:  # the first piece that isn't a control id
            skip = (first < places[1:]) & self.is_control[ids[np.minimum(first, max(len(ids) - 1, 0))]] if len(ids) else np.zeros(n, bool)
            if not skip.any():
                break
            first[skip] += 1
        leads = (counts > 0) & (first < places[1:])
        if leads.any():
            leads[leads] = self.has_blank[ids[first[leads]]]
            keep = np.ones(len(data), bool)
            keep[offsets[:-1][leads]] = False
            data, offsets = data[keep], offsets - np.concatenate([[0], np.cumsum(leads)])
        try:
            data.tobytes().decode("utf-8")
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            # Bytes on both sides of a control id don't join to a character.
            apart = (self.is_control[ids[:-1]] & self.is_byte[ids[1:]]).any()
            whole = not ((data[inner] & 0xC0) == 0x80).any() and not apart
        except UnicodeDecodeError:
            whole = False
        if whole and len(data) < 1 << 31:
            return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
        return pa.array([self._decode_one(ids[a:b].tolist()) for a, b in zip(places[:-1], places[1:], strict=True)], pa.string())

    def _decode_one(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:size]).decode("utf-8"))
                        del run[:size]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    del run[:1]

        lead = True
        for number in ids:
            if self.is_byte[number]:
                run += bytes(self.surface[self.surface_at[number] : self.surface_at[number] + 1])
                continue
            flush()
            at = self.surface_at[number]
            text = bytes(self.surface[at : at + self.surface_size[number]]).decode()
            lead = lead and not any(out)
            if lead and self.has_blank[number]:
                text, lead = text[1:], False
            out.append(text)
        flush()
        return "".join(out)


def encode_decode(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True) -> DataFrame:
    """Ids of every text, the text decoded from them, and whether the library agrees."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_memo(("pieces", model), lambda: PieceModel(model))
        for batch, texts in chunks(batches, "text"):
            ids, places, agrees = pieces.encode(texts)
            if add_end:
                ids = np.insert(ids, places[1:], pieces.end_id)
                places = places + np.arange(len(places))
            decoded = pieces.decode(ids, places)
            listed = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), listed, decoded, pa.array(agrees)], names=["id", "ids", "decoded", "agrees"])

    narrow = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, ids array<int>, decoded string, agrees boolean").withColumnRenamed("id", id_col)
