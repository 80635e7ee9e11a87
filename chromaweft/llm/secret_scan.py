"""Secret scan: fixed patterns, widened by a linear-chain conditional random field.

Patterns give the base spans (kinds assign, access, hex). The field tags tokens as begin, inside or outside of a
secret from their shape, how often they switch between small letters, capitals and digits, their neighbours' shapes, nearby cue words and
assignment signs, and features of the whole text; its decoded spans that touch no base span are added with kind `crf`. Positions are
code points, ends exclusive.

The field is trained on a bounded sample: the texts of about `SAMPLE` documents chosen by a hash of the id, tagged by the base patterns,
and `MADE_UP` made-up lines with labels of their own: secrets of families that the patterns do not know (bearer and prefixed tokens, signed
tokens, passwords in addresses, random keys behind words or arrows), and look-alikes that are none (UUIDs, short revisions, dates,
numbers, addresses, paths, identifiers, ordinary words behind cue words). Decoding is exact Viterbi.
A token whose outside score leads by more than twice the range of the transitions is outside on the best path,
whatever its neighbours; the chain is cut there, and only the rest is decoded step by step. Of equal scores the tag that comes first
(outside, begin, inside) is taken.

Defined results: null and empty texts have no spans (the digest is that of the empty string); repeated rows give
repeated results; ids may be null; texts of any length are read whole; a column named spans is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaweft.llm import textvec
from chromaweft.llm.common import hash_fraction, materialize

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that the field looks for; the patterns' are among them.
CUE = re.compile("pass(?:word|wd|phrase)|pwd|secret|token|api_?key|bearer|credential|private_?key|access_?key", re.IGNORECASE | re.ASCII)
#: Bound on the training sample: documents, and windows around tagged tokens of each (and two windows elsewhere); made-up lines.
SAMPLE = 1000
TAGGED = 4
MADE_UP = 2400
LENGTH = 32
OUT, BEGIN, INSIDE = 0, 1, 2

_SPACE, _WORD, _SYMBOL = 0, 1, 2
_DIGIT, _LOWER, _UPPER, _BEYOND_HEX, _FOREIGN = 1, 2, 4, 8, 16
_N_LENGTHS = 7
_QUOTE, _ASSIGN, _OTHER, _EDGE = (_N_LENGTHS * 32 + i for i in range(4))
N_SHAPES = _EDGE + 1
N_CUES = 6  # distance to the last cue word, 5 for none near
N_FILE = 6
N_SWITCHES = _N_LENGTHS * 6
_OFFSETS = np.cumsum([0, N_SHAPES, N_SHAPES, N_SHAPES, N_CUES, 2, N_FILE, N_SHAPES * 2, N_SWITCHES, N_SWITCHES * 4, N_SHAPES])
N_FEATURES = int(_OFFSETS[-1])


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, flag = np.full(1 << 16, _SYMBOL, np.uint8), np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            kind[i] = _SPACE
        elif c.isalnum() or c in "+/_-":
            kind[i] = _WORD
            flag[i] = _FOREIGN if i > 127 else _DIGIT if c.isdigit() else (_LOWER if c.islower() else _UPPER if c.isupper() else 0) | (0 if c in "abcdef" else _BEYOND_HEX)
    is_hex = np.zeros(1 << 16, bool)
    is_hex[[ord(c) for c in "0123456789abcdef"]] = True
    return kind, flag, is_hex


def base_spans(text: str, hex_runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, sorted."""
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(a, 2, b) for a, b in (_hex_runs(text) if hex_runs is None else hex_runs)]
    return sorted(out)


def _hex_runs(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]


class Tokens:
    """Tokens of several texts and the indices of their features, one column per template."""

    def __init__(self, texts: list[str]):
        kinds, flags, is_hex = _tables()
        joined = [x + "\n" for x in texts]
        cp, bounds = textvec.points(joined)
        self.bounds = bounds
        kind = textvec.look_up(kinds, cp, np.uint8(_WORD))
        flag = textvec.look_up(flags, cp, np.uint8(_FOREIGN))
        change = np.flatnonzero(np.diff(kind, prepend=255))
        self.end = np.append(change[1:], len(cp))
        solid = kind[change] != _SPACE
        both = np.bitwise_or.reduceat(flag, change) if len(change) else np.zeros(0, np.uint8)
        case = flag & (_DIGIT | _LOWER | _UPPER)
        switch = np.concatenate([[0], np.cumsum((case[1:] != case[:-1]) & (case[1:] > 0) & (case[:-1] > 0), dtype=np.int64)]) if len(cp) else np.zeros(1, np.int64)
        digits = np.concatenate([[0], np.cumsum((flag & _DIGIT) != 0, dtype=np.int64)])
        self.start, self.end, both = change[solid], self.end[solid], both[solid].astype(np.int64)
        n = len(self.start)
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1
        length = np.searchsorted(np.array([4, 8, 12, 16, 24, 32]), self.end - self.start, side="right")
        shape = length * 32 + both
        turns = np.searchsorted(np.array([1, 2, 4, 7, 11]), switch[self.end - 1] - switch[self.start], side="right") + 6 * length if n else np.zeros(0, np.int64)
        symbol = kind[self.start] == _SYMBOL
        first = cp[self.start[symbol]]
        shape[symbol] = np.where((first == 34) | (first == 39), _QUOTE, np.where((first == 58) | (first == 61), _ASSIGN, _OTHER))
        begins = np.ones(n, bool)
        begins[1:] = self.doc[1:] != self.doc[:-1]
        self.begins = begins
        before = np.where(begins, _EDGE, np.roll(shape, 1))
        after = np.where(np.roll(begins, -1), _EDGE, np.roll(shape, -1))
        second = np.where(begins | np.roll(begins, 1), _EDGE, np.roll(shape, 2))
        cue_at = [bounds[t] + m.start() for t, text in enumerate(texts) for m in CUE.finditer(text)]
        cue = np.zeros(n, bool)
        if cue_at:
            cue[np.searchsorted(self.start, cue_at, side="right") - 1] = True
        last = np.maximum.accumulate(np.where(cue, np.arange(n), -(1 << 40)))
        first_of_doc = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        near = np.where(last >= first_of_doc, np.minimum(np.arange(n) - last, N_CUES - 1), N_CUES - 1)
        sign = shape == _ASSIGN
        sign1, sign2 = np.roll(sign, 1), np.roll(sign, 2)
        index = np.arange(n) - first_of_doc
        assigned = (sign1 & (index >= 1)) | (sign2 & (index >= 2))
        share = (digits[bounds[1:]] - digits[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
        has_cue = np.zeros(len(texts), bool)
        has_cue[self.doc[cue]] = True
        file = np.searchsorted(np.array([0.01, 0.1]), share) + 3 * has_cue
        columns = [shape, before, after, near, assigned, file[self.doc], shape * 2 + ((near > 0) & (near < N_CUES - 1)), turns, turns * 4 + 2 * ((near > 0) & (near < N_CUES - 1)) + assigned, second]
        self.columns = [c + o for c, o in zip(columns, _OFFSETS)]
        inside = textvec.look_up(is_hex, cp, False)
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        runs = edge.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= 24]
        self.hex_runs: dict[int, list] = {}
        for d, (a, b) in zip((np.searchsorted(bounds, runs[:, 0], side="right") - 1).tolist(), runs.tolist()):
            self.hex_runs.setdefault(d, []).append((a - int(bounds[d]), b - int(bounds[d])))


def _scores(columns: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(columns[0]), 3))
    for y in range(3):
        w = np.ascontiguousarray(weights[:, y])
        for c in columns:
            out[:, y] += w[c]
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(features: np.ndarray, tags: np.ndarray, steps: int = 70, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by maximum likelihood. features: sequences x LENGTH x templates; tags -1 beyond the end."""
    n, length, _ = features.shape
    real = tags >= 0
    gold = np.where(real, tags, 0)
    weights, moves = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    moment = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    one = np.eye(3)[gold] * real[..., None]
    pair_gold = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:] * real[:, 1:, None])
    flat = features.reshape(-1, features.shape[2])
    for t in range(1, steps + 1):
        emit = weights[features].sum(axis=2)
        alpha, beta = np.empty((n, length, 3)), np.zeros((n, length, 3))
        alpha[:, 0] = emit[:, 0]
        for k in range(1, length):
            step = _logsum(alpha[:, k - 1, :, None] + moves, 1) + emit[:, k]
            alpha[:, k] = np.where(real[:, k, None], step, alpha[:, k - 1])
        for k in range(length - 2, -1, -1):
            step = _logsum(moves + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(real[:, k + 1, None], step, 0.0)
        total = _logsum(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - total[:, None, None]) * real[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + moves + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        error = (marginal - one).reshape(-1, 3)
        grad = np.stack([sum(np.bincount(flat[:, f], error[:, y], N_FEATURES) for f in range(flat.shape[1])) for y in range(3)], axis=1) / n + l2 * weights
        grad_moves = (pair.sum(axis=(0, 1)) - pair_gold) / n + l2 * moves
        for at, (x, g) in enumerate(((weights, grad), (moves, grad_moves))):
            moment[2 * at] = 0.9 * moment[2 * at] + 0.1 * g
            moment[2 * at + 1] = 0.99 * moment[2 * at + 1] + 0.01 * g * g
            x -= 0.15 / (1 + t / 60) * (moment[2 * at] / (1 - 0.9**t)) / (np.sqrt(moment[2 * at + 1] / (1 - 0.99**t)) + 1e-8)
    return weights, moves


def viterbi(emit: np.ndarray, begins: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of all chains (a chain starts where begins is true), exact."""
    tags = np.zeros(len(emit), np.int8)
    spread = 2 * (moves.max() - moves.min())
    active = emit[:, OUT] - np.maximum(emit[:, BEGIN], emit[:, INSIDE]) <= spread
    if not active.any():
        return tags
    inner = active & ~begins
    run_start = np.flatnonzero(active & ~(np.append(False, active[:-1]) & inner))
    where = np.flatnonzero(active)
    size = np.diff(np.append(np.searchsorted(where, run_start), len(where)))
    order = np.argsort(-size, kind="stable")
    run_start, size = run_start[order], size[order]
    headless = begins[run_start]
    tail = run_start + size
    tailless = (tail >= len(emit)) | begins[np.minimum(tail, len(emit) - 1)]
    score = emit[run_start] + np.where(headless[:, None], 0.0, moves[OUT][None, :])
    back = []
    final = np.empty((len(size), 3))
    for k in range(1, int(size[0]) + 1):
        alive = int(np.searchsorted(-size, -k, side="right"))  # runs of k tokens or more
        more = int(np.searchsorted(-size, -(k + 1), side="right"))
        final[more:alive] = score[more:alive]
        score = score[:more]
        if not more:
            break
        options = score[:, :, None] + moves
        back.append(options.argmax(axis=1))
        score = options.max(axis=1) + emit[run_start[:more] + k]
    tag = (final + np.where(tailless[:, None], 0.0, moves[:, OUT][None, :])).argmax(axis=1)
    for k in range(int(size[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-size, -(k + 1), side="right"))
        tags[run_start[:alive] + k] = tag[:alive]
        if k:
            tag[:alive] = back[k - 1][np.arange(alive), tag[:alive]]
    return tags


def scan(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of each text, sorted."""
    tokens = Tokens(texts)
    out = [base_spans(text, tokens.hex_runs.get(i, [])) for i, text in enumerate(texts)]
    weights, moves = model
    tags = viterbi(_scores(tokens.columns, weights), tokens.begins, moves)
    hit = np.flatnonzero(tags)
    if len(hit):
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (hit[1:] != hit[:-1] + 1) | (tags[hit[1:]] == BEGIN) | tokens.begins[hit[1:]]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(hit)) - 1
        reach: dict[int, tuple[list, list]] = {}  # starts of a text's base spans, and how far those up to each one go
        for a, b in zip(hit[first].tolist(), hit[last].tolist()):
            d = int(tokens.doc[a])
            start, end = int(tokens.start[a] - tokens.bounds[d]), int(tokens.end[b] - tokens.bounds[d])
            if d not in reach:
                reach[d] = [x for x, _, _ in out[d]], list(accumulate((e for _, _, e in out[d]), max))
            starts, ends = reach[d]
            before = bisect_left(starts, end)
            if not before or ends[before - 1] <= start:
                out[d].append((start, 3, end))
    return [sorted(x) for x in out]


def _made_up(rng: np.random.Generator) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Lines, and the spans of the secrets in them. About half of the lines hold look-alikes only."""
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper, both = lower.upper(), lower + lower.upper() + digits

    def pick(alphabet: str, low: int, high: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(low, high + 1))))

    def one(*options):
        return options[int(rng.integers(0, len(options)))]

    def word() -> str:
        return "".join(one("b", "st", "n", "r", "l", "m", "th", "k", "d", "w", "") + one("a", "e", "i", "o", "u", "en", "er", "an") for _ in range(int(rng.integers(1, 5))))

    def random() -> str:  # what a generator of keys makes
        return one(pick(both, 16, 64), pick(both, 20, 44), pick(lower + digits, 16, 48), pick(both + "+/", 20, 64), pick(both + "-_", 20, 64), pick(upper + digits, 16, 32), pick(digits + "abcdef", 16, 64))

    def cue() -> str:
        name = one("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "private_key", "access_key", "credential", "client_secret")
        return one(name, name, name.upper(), name.title(), f"{word()}_{name}")

    def quoted(x: str) -> str:
        return one(x, x, f'"{x}"', f"'{x}'")

    secrets = [
        lambda: (lambda v: (f"{cue()}{one(' = ', '=', ': ', ':', ' -> ', ' => ', ' is ', ' ')}{quoted(v)}", v))(random()),
        lambda: (lambda v: (f"{one('', 'Authorization: ', 'authorization=')}{one('Bearer', 'bearer')} {v}", v))(one(pick(both, 20, 120), pick(both + "-_", 24, 120))),
        lambda: (lambda v: (quoted(v), v))(pick(lower, 2, 5) + one("_", "-", "_live_", "_test_") + pick(both, 20, 48)),
        lambda: (lambda v: (quoted(v), v))("eyJ" + pick(both + "-_", 15, 40) + "." + pick(both + "-_", 30, 90) + "." + pick(both + "-_", 30, 60)),
        lambda: (lambda v: (f"{one('postgres', 'mysql', 'https', 'redis', 'ftp')}://{word()}:{v}@{word()}.{one('com', 'org', 'local')}", v))(pick(both, 10, 24)),
        lambda: (lambda v: (f"{word()}{one(' = ', '=', ': ')}{quoted(v)}", v))(random() + random()[:12]),
        lambda: (lambda v: (quoted(v), v))(one(pick(both, 32, 64), pick(both + "+/", 40, 88) + one("", "=", "=="))),
        lambda: (lambda v: (v, v))(one("AKIA" + pick(upper + digits, 16, 16), pick(digits + "abcdef", 24, 64))),
    ]
    hexa = digits + "abcdef"
    harmless = [
        lambda: "-".join(pick(one(hexa, hexa.upper()), n, n) for n in (8, 4, 4, 4, 12)) if rng.random() < 0.7 else pick(hexa, 7, 12),
        lambda: one(f"20{pick(digits, 2, 2)}-{pick(digits, 2, 2)}-{pick(digits, 2, 2)}", f"{pick(digits, 1, 2)}.{pick(digits, 1, 2)}.{pick(digits, 1, 4)}", f"{pick(digits, 1, 3)}.{pick(digits, 1, 3)}.{pick(digits, 1, 3)}.{pick(digits, 1, 3)}"),
        lambda: one(pick(digits, 3, 20), f"+{pick(digits, 2, 2)} {pick(digits, 3, 4)} {pick(digits, 6, 8)}", f"{pick(digits, 3, 4)}-{pick(digits, 4, 6)}", pick(upper, 2, 2) + pick(digits, 14, 20), f"{pick(digits, 4, 4)} {pick(digits, 4, 4)} {pick(digits, 4, 4)} {pick(digits, 4, 4)}"),
        lambda: one(f"{word()}.{word()}@{word()}.com", f"{word()}{pick(digits, 1, 4)}@{word()}{pick(digits, 0, 3)}.{word()}.org"),
        lambda: f"{one('https', 'http')}://{word()}.{one('com', 'org')}/" + "/".join(one(word(), f"{word()}-{word()}-{word()}", pick(digits, 2, 8), f"{word()}.html", f"{word()}{pick(digits, 1, 3)}") for _ in range(int(rng.integers(1, 6)))),
        lambda: "/" + "/".join(word() for _ in range(int(rng.integers(2, 7)))) + one("", ".py", ".txt"),
        lambda: one("_".join(word() for _ in range(int(rng.integers(2, 6)))), "_".join(word().upper() for _ in range(int(rng.integers(2, 6)))), "".join(word().title() for _ in range(int(rng.integers(2, 6)))), word() + "".join(word().title() for _ in range(int(rng.integers(1, 5)))), "-".join(word() for _ in range(int(rng.integers(3, 8))))),
        lambda: "".join(word() for _ in range(int(rng.integers(3, 9)))),
        lambda: f"{cue()}{one(' = ', ': ', ' is ', ' ', ', ', '. ')}{one(word(), 'required', 'string', 'None', 'null', 'true', word() + ' ' + word(), 'os.environ', '<' + word() + '>', '***')}",
        lambda: f"{one('the', 'a', 'my')} {cue()} {one('of', 'for', 'ring', 'reset', 'was')} {word()}",
        lambda: f"{word()}{one('=', ': ', ' = ')}{one(word(), pick(digits, 1, 10), quoted(word()), 'true')}",
        lambda: one(f"{pick(digits, 1, 4)}{one('px', 'kg', 'ms', 'GB', 'th')}", f"{pick(upper, 2, 4)}-{pick(digits, 2, 6)}", f"{pick(upper, 1, 3)}{pick(digits, 2, 5)}{pick(upper, 0, 2)}", f"v{pick(digits, 1, 2)}.{pick(digits, 1, 2)}", "#" + pick(hexa, 6, 6)),
    ]
    texts, spans = [], []
    for i in range(MADE_UP):
        words = [one(word(), word(), word(), word() + one(",", ".", ":"), word().title()) for _ in range(int(rng.integers(4, 24)))]
        at = int(rng.integers(0, len(words) + 1))
        head = " ".join(words[:at]) + one(" ", " ", "\n") if at else ""
        tail = one(" ", " ", "\n", ". ", ", ") + " ".join(words[at:])
        if i % 2:
            texts.append(head + harmless[i // 2 % len(harmless)]() + tail)
            spans.append([])
        else:
            shown, value = secrets[i // 2 % len(secrets)]()
            start = len(head) + shown.rindex(value)
            texts.append(head + shown + tail)
            spans.append([(start, start + len(value))])
    return texts, spans


def _base_values(text: str, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the field is to learn of the base spans: of assignments the value only."""
    return [(ASSIGN.match(text, a).start(2) if k == 0 else a, b) for a, k, b in base_spans(text, hex_runs)]


def _sequences(texts: list[str], spans: list[list[tuple[int, int]]] | None, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows of LENGTH tokens around tagged tokens, and some elsewhere; a bounded number of each text. Without spans, those of the patterns."""
    feats, tags = [], []
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        tokens = Tokens(part)
        n = len(tokens.start)
        if not n:
            continue
        tag = np.zeros(n, np.int8)
        for d, text in enumerate(part):
            for start, end in _base_values(text, tokens.hex_runs.get(d, [])) if spans is None else spans[i + d]:
                a, b = np.searchsorted(tokens.end, start + tokens.bounds[d], side="right"), np.searchsorted(tokens.start, end + tokens.bounds[d])
                if b > a:
                    tag[a:b] = INSIDE
                    tag[a] = BEGIN
        columns = np.stack(tokens.columns, axis=1)
        # of each text: its first tagged tokens, one token with digits, one of any kind
        order = rng.permutation(n)
        odd = order[(tag[order] == 0) & (((tokens.columns[0][order] & 31) & _DIGIT) != 0)]
        begin = np.flatnonzero(tag == BEGIN)
        nth = np.arange(len(begin)) - np.searchsorted(tokens.doc[begin], tokens.doc[begin])
        middles = np.concatenate([begin[nth < TAGGED], odd[np.unique(tokens.doc[odd], return_index=True)[1]], order[np.unique(tokens.doc[order], return_index=True)[1]]])
        if spans is not None:  # short lines: one window of each
            middles = middles[np.unique(tokens.doc[middles], return_index=True)[1]]
        for m in middles.tolist():
            low, high = np.searchsorted(tokens.doc, [tokens.doc[m], tokens.doc[m] + 1])
            a = max(int(low), m - int(rng.integers(4, LENGTH - 4)))
            b = min(int(high), a + LENGTH)
            f, t = np.zeros((LENGTH, columns.shape[1]), np.int64), np.full(LENGTH, -1, np.int8)
            f[: b - a], t[: b - a] = columns[a:b], tag[a:b]
            feats.append(f)
            tags.append(t)
    return np.array(feats), np.array(tags)


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Train on about `sample` documents; what the driver gets are windows of feature indices."""
    n = max(1, docs.count())
    chosen = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(hash_fraction(F.col("doc_id").cast("string"), F.lit(seed)) < sample / n)

    def windows(batches):
        for batch in batches:
            for piece in textvec.pieces(batch):
                f, t = _sequences(textvec.strings(piece.column("text")), None, np.random.default_rng(seed))
                if len(f):
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int16).tobytes() for x in f], pa.binary()), pa.array([x.tobytes() for x in t], pa.binary())], names=["features", "tags"])

    got = materialize(chosen.mapInArrow(windows, "features binary, tags binary"), "secret-windows").orderBy("features", "tags").toArrow()
    f, t = _sequences(*_made_up(np.random.default_rng(seed)), np.random.default_rng(seed))
    if got.num_rows:
        f2 = np.frombuffer(b"".join(got.column("features").to_pylist()), np.int16).reshape(got.num_rows, LENGTH, -1)
        t2 = np.frombuffer(b"".join(got.column("tags").to_pylist()), np.int8).reshape(got.num_rows, LENGTH)
        f, t = np.concatenate([f, f2]), np.concatenate([t, t2])
    return train(f.astype(np.int32), t)


def find_secrets(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all, if None), base_spans and spans (arrays of kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    names = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for piece in textvec.pieces(batch):
                found = scan(textvec.strings(piece.column("text")), shared.value)
                spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in found], kind)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], spans], names=[*names, "spans"])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    types = docs.select(*names).schema.add("spans", T.ArrayType(span))
    return docs.mapInArrow(run, types)


def redact(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret's characters replaced by the mark (of assignments the value only); n_chars follows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        cuts = []
        for a, k, b in spans:
            a = ASSIGN.match(text, a).start(2) if k == 0 else a
            if cuts and a < cuts[-1][1]:
                cuts[-1][1] = max(b, cuts[-1][1])
            else:
                cuts.append([a, b])
        kept = [text[a:b] for a, b in zip([0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(text)])]
        return mark.join(kept)

    def run(batches):
        for batch in batches:
            for piece in textvec.pieces(batch):
                texts = piece.column("text").to_pylist()
                found = scan([x or "" for x in texts], shared.value)
                new = [clean(x, sorted(s, key=lambda y: ASSIGN.match(x, y[0]).start(2) if y[1] == 0 else y[0])) if s else x for x, s in zip(texts, found)]
                columns = {c: piece.column(c) for c in names}
                columns["text"] = pa.array(new, pa.string())
                if "n_chars" in columns:
                    old = piece.column("n_chars").to_pylist()
                    columns["n_chars"] = pa.array([len(y) if s else n for y, s, n in zip(new, found, old)], piece.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)


def digest_rows(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row, from the found spans."""
    found = find_secrets(docs, model, ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "crf")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
