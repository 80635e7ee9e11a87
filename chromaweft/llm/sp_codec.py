"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding repeats, for each part of the text, the merge whose piece scores highest (leftmost on ties). A candidate that is
taken from the agenda is skipped if its keyed hash falls below `dropout`; it returns only if a neighbour's merge makes a new
candidate. The hash is that of the candidate's start, middle and end in the text under a key made of the seed and the text's id: every
candidate of every occurrence has a draw of its own, and the same seed and id always give the same pieces. With dropout 0 the result
is that of the SentencePiece library.

A part is a maximal run of characters each two neighbours of which stand side by side in some piece; no piece reaches over its end.
All parts of a block of text are merged at once, one merge of each part at a time, in numpy arrays; parts of more than LONG
characters are merged one after the other with a heap. Nothing is remembered from text to text. Texts of more than BLOCK characters are
cut between parts. Characters without a piece, and U+2581, which stands for the blank, become byte pieces.

Defined results: null and empty texts have no pieces and decode to the empty text; null ids share the key of the seed alone; repeated
rows get the same pieces; columns of the names added here are replaced. Decoding any encoded text gives back the text.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chromaweft.llm import textvec

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20240229
BLANK = "▁"
#: Parts of more characters are merged with a heap.
LONG = 48
#: Characters that are merged at once.
BLOCK = 1 << 17
_START, _MIDDLE, _END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_M64 = (1 << 64) - 1
_LITERAL = 1 << 21  # a U+2581 of the text itself


def load_vocabulary(path: str = MODEL) -> dict:
    """Plain data, of the vocabulary's fixed size, to be sent to the workers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, raw = {}, {}, []
    byte = [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            raw.append(piece.replace(BLANK, " ").encode())
    if len(raw) > 1 << 16:
        raise ValueError("this vocabulary has too many pieces")
    return {"ids": ids, "scores": scores, "raw": raw, "byte": byte}


class Pairs:
    """A hash table from pairs of numbers below 2 ** 22 to numbers, in arrays; -1 for pairs it does not have."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(10, int(len(left)).bit_length() + 3)
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        key, open_ = left.astype(np.int64) << 22 | right, np.arange(len(left))
        at = self._place(key)
        while len(open_):  # whoever is written last has the slot; the others go on to the next
            free = self.key[at[open_]] < 0
            self.key[at[open_[free]]] = key[open_[free]]
            won = self.key[at[open_]] == key[open_]
            self.value[at[open_[won]]] = value[open_[won]]
            open_ = open_[~won]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(_START) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 22 | right
        at = self._place(key)
        there = self.key[at]
        out = np.where(there == key, self.value[at], np.int32(-1))
        open_ = np.flatnonzero((there != key) & (there >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.key[at]
            hit = there == key[open_]
            out[open_[hit]] = self.value[at[hit]]
            more = ~hit & (there >= 0)
            open_, at = open_[more], at[more]
        return out


class Codec:
    def __init__(self, vocabulary: dict, dropout: float = DROPOUT, seed: int = SEED):
        self.raw, self.seed = vocabulary["raw"], seed
        self.byte = np.array(vocabulary["byte"], np.uint16)
        self.least = min(_M64, int(dropout * 2.0**64))
        # symbols: pieces by their id, then characters that only occur inside pieces
        pieces = vocabulary["ids"]
        symbol = dict(pieces)
        for c in sorted({c for p in pieces for c in p}):
            symbol.setdefault(c, len(self.raw) + len(symbol))
        self.n_pieces = len(self.raw)
        order = {s: k for k, s in enumerate(sorted(set(vocabulary["scores"].values())))}
        self.rank = np.full(self.n_pieces, -1, np.int64)
        for p, i in pieces.items():
            self.rank[i] = order[vocabulary["scores"][p]]
        self.of_char = np.full(1 << 16, -1, np.int32)
        self.of_far_char = {}
        for c, i in symbol.items():
            if len(c) == 1:
                if ord(c) < 1 << 16:
                    self.of_char[ord(c)] = i
                else:
                    self.of_far_char[ord(c)] = i
        split = [(symbol[p[:k]], symbol[p[k:]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.pairs = Pairs(*np.array(split, np.int64).reshape(-1, 3).T)
        beside = sorted({(ord(p[k]), ord(p[k + 1])) for p in pieces for k in range(len(p) - 1)})
        self.beside = Pairs(*np.array([(a, b, 1) for a, b in beside], np.int64).reshape(-1, 3).T)

    def key(self, name) -> int:
        """What the hashes of a text's candidates are keyed by."""
        text = f"{self.seed}" if name is None else f"{self.seed}:{name}"
        return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")

    def draws(self, key, start, middle, end) -> np.ndarray:
        """Hashes of candidates; positions are characters of the text, the blank before it included."""
        x = start.astype(np.uint64) * np.uint64(_START) + middle.astype(np.uint64) * np.uint64(_MIDDLE) + end.astype(np.uint64) * np.uint64(_END)
        return textvec.mix(x + key)

    def _draw(self, key: int, start: int, middle: int, end: int) -> int:
        x = (start * _START + middle * _MIDDLE + end * _END + key) & _M64
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M64
        return x ^ (x >> 31)

    def _merge_long(self, symbols: list[int], at: int, key: int) -> list[tuple[int, int]]:
        """(symbol, place) of a part that starts at the text's character `at`, with a heap."""
        n = len(symbols)
        symbols, ends, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda, known = [], {}

        def offer(a: int) -> None:
            b = ends[a]
            if b < n:
                pair = symbols[a], symbols[b]
                if pair not in known:
                    known[pair] = int(self.pairs(np.array([pair[0]]), np.array([pair[1]]))[0])
                if known[pair] >= 0:
                    heapq.heappush(agenda, (-int(self.rank[known[pair]]), a, b, ends[b], known[pair]))

        for a in range(n - 1):
            offer(a)
        while agenda:
            _, a, b, c, merged = heapq.heappop(agenda)
            if ends[a] != b or ends[b] != c or (self.least and self._draw(key, at + a, at + b, at + c) < self.least):
                continue
            symbols[a], ends[a], ends[b] = merged, c, 0
            if c < n:
                before[c] = a
                offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            out.append((symbols[a], a))
            a = ends[a]
        return out

    def _merge(self, symbol: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Merges all parts [first, last) of symbol in place and returns which symbols are left.

        place: of each character in its text; key: of each part's text.
        """
        alive = np.ones(len(symbol), bool)
        size = last - first
        few = size > 1
        first, last, key, size = first[few], last[few], key[few], size[few]
        for p in np.flatnonzero(size > LONG).tolist():
            a, b = int(first[p]), int(last[p])
            left = self._merge_long(symbol[a:b].tolist(), int(place[a]), int(key[p]))
            alive[a:b] = False
            for s, k in left:
                symbol[a + k], alive[a + k] = s, True
        few = size <= LONG
        first, key, size = first[few], key[few], size[few]
        if not len(first):
            return alive
        # the parts' characters, close together
        start = np.cumsum(size) - size
        of = np.repeat(first - start, size) + np.arange(size.sum())
        s, n = symbol[of], len(of)
        behind = np.arange(1, n + 1)  # the next symbol of the part, n if none
        behind[start + size - 1] = n
        before = np.arange(-1, n - 1)
        before[start] = -1
        end = place[of] + 1
        begin = place[of]
        index = np.int64(n) - np.arange(n)  # larger to the left
        made = np.full(n, -1, np.int32)
        inner = behind < n
        made[inner] = self.pairs(s[inner], s[np.flatnonzero(inner) + 1])
        order = np.where(made >= 0, self.rank[made] << 32 | index, np.int64(-1))
        dead = np.zeros(n, bool)
        while len(start):
            best = np.maximum.reduceat(order, start)  # of finished parts nothing is left to win
            go = best >= 0
            start, key, best = start[go], key[go], best[go]
            if not len(start):
                break
            i = n - (best & 0xFFFFFFFF)
            j = behind[i]
            if self.least:
                skip = self.draws(key, begin[i], begin[j], end[j]) < np.uint64(self.least)
                order[i[skip]] = -1
                i, j = i[~skip], j[~skip]
            merged, k, h = made[i], behind[j], before[i]
            s[i], end[i], behind[i] = merged, end[j], k
            dead[j] = True
            order[j] = -1
            more, back = k < n, h >= 0
            before[k[more]] = i[more]
            a, b = np.concatenate([h[back], i[more]]), np.concatenate([i[back], k[more]])
            order[i] = -1
            x = self.pairs(s[a], s[b])
            made[a] = x
            order[a] = np.where(x >= 0, self.rank[x] << 32 | index[a], np.int64(-1))
        symbol[of] = s
        alive[of] = ~dead
        return alive

    def _block(self, cp: np.ndarray, cut: np.ndarray, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a block of characters and each one's character; cut: where a text begins."""
        symbol = textvec.look_up(self.of_char, cp, np.int32(-1)).astype(np.int32)
        if self.of_far_char and len(cp) and cp.max() >= 1 << 16:
            for i in np.flatnonzero(cp >= 1 << 16).tolist():
                symbol[i] = self.of_far_char.get(int(cp[i]), -1)
        joined = np.zeros(len(cp), bool)
        joined[1:] = self.beside(cp[:-1], cp[1:]) > 0
        joined[cut] = False
        first = np.flatnonzero(~joined)
        alive = self._merge(symbol, first, np.append(first[1:], len(cp)), place, key[first])
        at = np.flatnonzero(alive)
        out = symbol[at]
        spelled = np.flatnonzero((out < 0) | (out >= self.n_pieces))
        if not len(spelled):
            return out.astype(np.uint16), at
        c = cp[at[spelled]]
        c = np.where(c == _LITERAL, np.uint32(ord(BLANK)), c)
        width = np.ones(len(out), np.int64)
        width[spelled] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        offset = np.cumsum(width) - width
        ids = np.repeat(out, width).astype(np.uint16)
        w, to = width[spelled], offset[spelled]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for k in range(4):
            has = np.flatnonzero(w > k)
            bits = c[has] >> (6 * (w[has] - 1 - k)).astype(np.uint32)
            value = np.where(w[has] == 1, bits, (bits & 0x3F) | 0x80) if k else np.where(w[has] == 1, bits, bits | lead[w[has]])
            ids[to[has] + k] = self.byte[value.astype(np.int64)]
        return ids, np.repeat(at, width)

    def encode_all(self, texts: list[str], names: list) -> list[bytes]:
        """Of each text its piece ids as little-endian 16-bit numbers; names: what the draws are keyed by besides the seed."""
        out = [[] for _ in texts]
        waiting, size = [], 0
        for t, text in enumerate(texts):
            at = 0
            while at < len(text):
                to = min(len(text), at + BLOCK)
                if to < len(text):
                    to = self._end_of_part(text, to)
                waiting.append((t, at, to))
                size += to - at
                at = to
                if size >= BLOCK:
                    self._flush(waiting, texts, names, out)
                    waiting, size = [], 0
        self._flush(waiting, texts, names, out)
        return [b"".join(x) for x in out]

    def _end_of_part(self, text: str, at: int) -> int:
        """The first place at or behind `at` between two characters that no piece has side by side."""
        while at < len(text):
            cp = self._characters(textvec.points([text[at - 1 : at + 4096]])[0])
            cut = np.flatnonzero(self.beside(cp[:-1], cp[1:]) < 0)
            if len(cut):
                return at + int(cut[0])
            at += 4096
        return len(text)

    def _characters(self, cp: np.ndarray) -> np.ndarray:
        out = np.where(cp == ord(BLANK), np.uint32(_LITERAL), cp)
        out[cp == 32] = ord(BLANK)
        return out

    def _flush(self, waiting: list[tuple[int, int, int]], texts: list[str], names: list, out: list[list[bytes]]) -> None:
        if not waiting:
            return
        cp, bounds = textvec.points([texts[t][a:b] if a else " " + texts[t][:b] for t, a, b in waiting])
        cut = bounds[:-1]
        offset = np.array([a + 1 if a else 0 for _, a, _ in waiting], np.int64) - cut
        key = np.array([self.key(names[t]) if self.least else 0 for t, _, _ in waiting], np.uint64)
        length = np.diff(bounds)
        ids, at = self._block(self._characters(cp), cut, np.arange(len(cp)) + np.repeat(offset, length), np.repeat(key, length))
        ends = np.searchsorted(at, bounds)
        for (t, _, _), a, b in zip(waiting, ends, ends[1:]):
            out[t].append(ids[a:b].tobytes())

    def encode(self, text: str | None, key=None) -> bytes:
        return self.encode_all([text or ""], [key])[0]

    def decode(self, packed: bytes) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(packed, "<u2").tolist()])[1:].decode()


def encode_documents(docs: DataFrame, keep: list[str] | None = None, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, pieces: bool = True) -> DataFrame:
    """The columns in keep (all, if None), n_pieces, pieces_sha256, lossless and, if wanted, pieces (packed ids)."""
    vocabulary = load_vocabulary(path)  # of fixed size, sent with the task
    extra = ["n_pieces", "pieces_sha256", "lossless"] + ["pieces"] * pieces
    names = [c for c in (docs.columns if keep is None else keep) if c not in extra]

    def run(batches):
        codec = Codec(vocabulary, dropout, seed)
        for batch in batches:
            for piece in textvec.pieces(batch, limit=1 << 20):
                texts = textvec.strings(piece.column("text"))
                packed = codec.encode_all(texts, piece.column("doc_id").to_pylist())
                columns = [
                    pa.array([len(x) // 2 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                    pa.array([codec.decode(x) == t for x, t in zip(packed, texts)]),
                    pa.array(packed, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], *columns[: len(extra)]], names=names + extra)

    schema = docs.select(*names).schema.add("n_pieces", "long").add("pieces_sha256", "string").add("lossless", "boolean")
    return docs.mapInArrow(run, schema.add("pieces", "binary") if pieces else schema)


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """Adds text, decoded from pieces."""
    vocabulary = load_vocabulary(path)
    names = [c for c in encoded.columns if c != "text"]

    def run(batches):
        codec = Codec(vocabulary, 0.0, 0)
        for batch in batches:
            for piece in textvec.pieces(batch, "pieces", limit=1 << 20):
                texts = [codec.decode(x or b"") for x in piece.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.mapInArrow(run, encoded.select(*names).schema.add("text", "string"))
