"""Secret scans: base patterns, and a linear-chain conditional random field that adds to them.

Every piece of a whole text is tagged begin, inside or outside of a secret. A piece is one run of characters that a
secret can have, with what stands next to it up to the neighbouring runs of its whitespace-separated word; a word
without such a run is one piece. So minified JSON, query strings and header dumps can hold any number of secrets in one
word. Words are also cut where a base span begins or ends, so what stands beside it is judged by itself. A piece's score comes
from its own shape (lengths, character classes and their changes, alphabets, entropy, the segments between its punctuation,
and the looks of dates, hyphenated hex groups, dotted numbers, identifiers with a slash and well-known token beginnings), from the
classes of the two pieces before it and the one after (keyword, assignment sign, quote, number, name of something else, other)
and from features of the file; label pairs add a transition score; Viterbi finds the best tags. The weights are fitted by
maximum likelihood here, on windows around base matches and elsewhere in at most about SAMPLE documents (the bound on
labelled rows) chosen by a hash of their id, on made-up secrets put in their places, so that other alphabets and
keywords are learnt too, and on as many made-up strings of PLAIN_KINDS, which look like secrets and are none: times,
identifiers, versions, file names, numbers, encoded pictures. A long run is a secret by what stands before it or by how it
begins; bare runs of hex digits, which are base spans anyway, are not learnt from.
Windows are turned into feature numbers on the executors, and each counts with its own length and the labels beside its
ends.

Decoding is exact but mostly free: where a piece's score for outside leads by more than any transitions could make up,
outside is on every best path, so Viterbi runs only over the pieces between such places.

Base spans always stay; tagged runs (kind `crf`) that overlap none of them are added.

Defined results: a null text is empty and has no spans; repeated rows get equal results; other columns are not read; a
table without any secret is scanned with weights learnt from made-up ones; no rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from operator import ne
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cached, held, map_arrow, split_words

SAMPLE, NEAR, STEPS = 1_500, 4, 120
KINDS = ("assign", "access", "hex", "crf")
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_crf bigint, base_sha256 string, spans string"
#: The base patterns and the lengths that a match must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
HINT_BYTES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CORE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]*")
KEYWORD = re.compile(r"passw|pwd|secret|token|api_?key|auth|bearer|credential|private|^\W*key\W*$", re.I | re.A)
JOINED = re.compile(r"(?:passw\w*|pwd|secret|token|api_?key|auth|bearer|credential|key|sig|signature|session)=+[^=]{12}", re.I | re.A)
#: What is named here is followed by something that is no secret.
NAMED = re.compile(r"base64|doi|isbn|issn|uu?id|guid|version|release|commit|digest|sha\d|md5|checksum|etag|date|time|stamp|file|image|phone|iban|order|serial|model|build|version|path|url", re.I | re.A)
#: How well-known kinds of tokens begin.
STARTS = re.compile(r"gh[pousr]_|github_pat_|glpat-|sk[-_]|pk_|rk_|xox[abprs]-|eyJ[A-Za-z0-9]|AIza|ya29\.|npm_|SG\.|shpat_|dop_v1_|hf_")
SEGMENT, DATE, UUID, DOTTED, NAMESPACE = re.compile(r"[A-Za-z0-9]+"), re.compile(r"(?:19|20)\d\d[-_/.]?[01]\d[-_/.]?[0-3]\d"), re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"), re.compile(r"\d\.\d|\.[A-Za-z]{1,4}\d?(?:\.[a-z]{2})?$"), re.compile(r"10\.\d{4,}/|[A-Za-z]{2,}/[A-Za-z]")
PLAIN, NONE, KEY, SIGN, QUOTE, NUMBER, NAME = range(7)
N_CONTEXT, N_FILE = 7, 3
_SEGMENTS = (5, 9, 13, 17, 21, 33)
_LENGTHS = (6, 10, 14, 18, 24, 36, 48, 80)


def base_spans(text: str, low: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) by start, then kind; code points, end exclusive. low: the text as bytes, A-Z in lower case."""
    out = []
    if any(h in low for h in HINT_BYTES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def core(word: str) -> tuple[int, int]:
    """The longest part of a word that a secret could be, by place."""
    return max(((m.start(), m.end()) for m in CORE.finditer(word)), key=lambda x: x[1] - x[0], default=(0, 0))


def pieces(word: str) -> list[tuple[int, int, int, int]]:
    """(start, end, start of its run, end of its run) of every piece of a word; the separators between two runs are in both pieces."""
    if word.isascii() and word.isalpha():
        return [(0, len(word), 0, len(word))]
    runs = [m.span() for m in CORE.finditer(word)]
    if len(runs) < 2:
        return [(0, len(word), *(runs[0] if runs else (0, 0)))]
    return [(lo, hi, a, b) for (a, b), lo, hi in zip(runs, [0, *(b for _, b in runs[:-1])], [*(a for a, _ in runs[1:]), len(word)], strict=True)]


def context(word: str) -> int:
    if KEYWORD.search(word):
        return KEY
    if NAMED.search(word):
        return NAME
    if word in ("=", ":", ":=", "=>") or word.rstrip("\"'`")[-1:] in ("=", ":"):
        return SIGN
    if word[0] in "\"'`":
        return QUOTE
    return NUMBER if word[0].isdigit() else PLAIN


_FEATURES = 49
_SHORT = [(bisect_right(_LENGTHS, n), 33) for n in range(10)]
_KINDS = bytes(ord("d") if chr(x).isdigit() else ord("u") if chr(x).isupper() else ord("l") if chr(x).islower() else ord("o") for x in range(128)) + b"o" * 128


def shape(word: str) -> list[int]:
    """Indices of the binary features of a word by itself, below _FEATURES."""
    a, b = core(word)
    return list(run_shape(word, word[a:b]))


def run_shape(word: str, c: str) -> tuple[int, ...]:
    """The features of a word whose longest run is c."""
    n = len(c)
    if n < 10:
        return _SHORT[n]
    kinds = c.encode().translate(_KINDS)  # a run is ASCII
    digits, upper, other, lower = (kinds.count(k) for k in b"duol")
    if n < 100:
        changes = sum(map(ne, kinds, kinds[1:]))
    else:
        k = np.frombuffer(kinds, np.uint8)
        changes = int((k[1:] != k[:-1]).sum())
    out = [bisect_right(_LENGTHS, n), 9 + min(4, 10 * digits // n), 14 + min(4, 10 * changes // n), 19 + min(3, 8 * len(set(c)) // n // 2)]  # up to 8, 13, 18 and 22
    out += [k for k, x in ((23, digits == n), (24, lower == n), (25, upper == n), (26, digits and upper and lower), (27, not c.strip("0123456789abcdefABCDEF")), (28, "@" in word), (29, "://" in word or "www." in word), (30, n < len(word) - 6), (31, other > 2), (32, digits and (lower or upper))) if x]
    parts = SEGMENT.findall(c)
    out.append(34 + bisect_right(_SEGMENTS, max(map(len, parts), default=0)))  # up to 40
    out += [k for k, x in ((41, all(p.isdigit() or p.isalpha() for p in parts)), (42, DATE.search(c)), (43, UUID.fullmatch(c)), (44, DOTTED.search(c)), (45, NAMESPACE.search(c)), (46, STARTS.match(c)), (47, len(parts) > 3), (48, JOINED.search(c))) if x]
    return tuple(out)


def file_features(raw: bytes, low: bytes) -> list[int]:
    n = len(raw) or 1
    return [int(any(h in low for h in HINT_BYTES)), int(len(raw.translate(None, b"0123456789")) < 0.95 * n), int(len(raw.translate(None, b"#*$%&|<>")) < 0.95 * n)]


class Field:
    """Weights of the field: by own features, contexts at three places, the file, and transitions; labels 0 outside, 1 begin, 2 inside."""

    SIZES = (_FEATURES, N_CONTEXT, N_CONTEXT, N_CONTEXT, N_FILE)

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        cuts = np.cumsum((0, *self.SIZES))
        self.own, self.before, self.before2, self.after, self.file = (weights[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        swap = [moves[p, y] + moves[y, q] - moves[p, 0] - moves[0, q] for p in range(3) for q in range(3) for y in (1, 2)]
        self.lead = max(swap)

    @classmethod
    def fit(cls, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = STEPS, decay: float = 1e-3) -> Field:
        """Groups of windows of one length: x (windows, places, numbers of features), y (windows, places), edges (windows, 2).

        Adam on the mean negative log-likelihood of the labels of each window, given the labels (edges) next to its ends,
        as decoding has outside on both sides of what it decodes. Windows are whole: no place is padding.
        """
        n = sum(len(x) for x, _, _ in groups)
        w = np.zeros((sum(cls.SIZES) + 1, 3))  # the last row is of no feature and stays 0
        t = np.array([[0.0, 0.0, -3.0], [0.0, -1.0, 0.0], [0.0, -1.0, 0.0]])
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        for step in range(1, steps + 1):
            gw, gt = decay * w, decay * t
            for x, y, edges in groups:
                dw, dt = cls.slopes(x, y, edges, w, t)
                gw += dw / n
                gt += dt / n
            gw[-1] = 0
            for k, (value, g) in enumerate(((w, gw), (t, gt))):
                m, q = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (g - m)
                q += 0.01 * (g * g - q)
                value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
        return cls(w[:-1], t)

    @staticmethod
    def slopes(x: np.ndarray, y: np.ndarray, edges: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slope of the negative log-likelihood of windows of one length: expected less seen features and moves."""
        places = x.shape[1]
        s, e, hot = w[x].sum(axis=2), np.exp(t), np.eye(3)[y]
        u = np.exp(s - s.max(axis=2, keepdims=True))
        ahead, back = np.empty_like(s), np.empty_like(s)
        v = e[edges[:, 0]] * u[:, 0]
        ahead[:, 0] = v / v.sum(axis=1, keepdims=True)
        for i in range(1, places):
            v = (ahead[:, i - 1] @ e) * u[:, i]
            ahead[:, i] = v / v.sum(axis=1, keepdims=True)
        back[:, -1] = e.T[edges[:, 1]]
        for i in range(places - 2, -1, -1):
            v = (back[:, i + 1] * u[:, i + 1]) @ e.T
            back[:, i] = v / v.sum(axis=1, keepdims=True)
        p = ahead * back
        p /= p.sum(axis=2, keepdims=True)
        pair = ahead[:, :-1, :, None] * e * (u * back)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        off = p - hot
        moves = pair.sum(axis=(0, 1)) - np.einsum("nia,nib->ab", hot[:, :-1], hot[:, 1:])
        np.add.at(moves, edges[:, 0], off[:, 0])
        np.add.at(moves.T, edges[:, 1], off[:, -1])
        at = x.ravel()
        return np.stack([np.bincount(at, np.repeat(off[:, :, k].ravel(), x.shape[2]), len(w)) for k in range(3)], axis=1), moves

    def viterbi(self, s: np.ndarray) -> list[int]:
        """The best tags between two outside words."""
        best, back = s[0] + self.moves[0], []
        for row in s[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        tag = int((best + self.moves[:, 0]).argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]


class Scores(dict):
    """Own scores and context class of the pieces of words: the index of a word's first piece in growing tables, and their number."""

    def __init__(self, field: Field, bound: int = 400_000):
        super().__init__()
        self.field, self.bound = field, bound
        self.by_shape = Cached(lambda features: field.own[list(features)].sum(axis=0), 50_000)
        self.used = 0
        self.own, self.context, self.count = np.zeros((1 << 16, 3), np.float32), np.zeros(1 << 16, np.int8), np.ones(1 << 16, np.int32)

    def __missing__(self, raw: bytes) -> int:
        k, word = self.used, raw.decode()
        found = pieces(word)
        self[raw], self.used = k, k + len(found)
        while self.used > len(self.own):
            self.own, self.context, self.count = (np.concatenate([t, np.zeros_like(t)]) for t in (self.own, self.context, self.count))
        self.count[k] = len(found)
        for j, (lo, hi, a, b) in enumerate(found, k):
            piece = word[lo:hi] if len(found) > 1 else word
            self.own[j], self.context[j] = self.by_shape[run_shape(piece, word[a:b])], context(piece)
        return k

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray | None]:
        """Table indices of all pieces; the place of each word's first piece among them, or None if every word is one piece."""
        if self.used > self.bound:
            self.clear()
            self.used = 0
        index = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        count = self.count[index]
        total = int(count.sum())
        if total == len(words):
            return index, None
        first = np.cumsum(count) - count
        return np.repeat(index - first, count) + np.arange(total), first


def shifted(classes: np.ndarray, by: int) -> np.ndarray:
    """The context class `by` words before each word (after it, if negative); NONE outside the text."""
    out = np.full(len(classes), NONE, classes.dtype)
    if by > 0:
        out[by:] = classes[:-by]
    else:
        out[:by] = classes[-by:]
    return out


def cut_places(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Places of the words of a text, cut where base spans begin and end."""
    places = [m.span() for m in WORD.finditer(text)]
    borders = sorted({x for s, _, e, _ in base for x in (s, e)})
    if not borders:
        return places
    out = []
    for a, b in places:
        inner = borders[bisect_right(borders, a) : bisect_left(borders, b)]
        out += zip((a, *inner), (*inner, b), strict=True)
    return out


def tagged(text: str, raw: bytes, low: bytes, scores: Scores, base: list[tuple[int, int, int, int]] = ()) -> list[tuple[int, int]]:
    """Spans that the field tags in a whole text, given as bytes too, outside of base spans."""
    places = cut_places(text, base) if base else None
    words = [text[a:b].encode() for a, b in places] if base else split_words(raw)
    if not words:
        return []
    f, (index, first) = scores.field, scores.of(words)
    c = scores.context[index]
    s = scores.own[index].astype(np.float64) + f.before[shifted(c, 1)] + f.after[shifted(c, -1)]
    if len(c) > 2:
        s += f.before2[shifted(c, 2)]
    else:
        s += f.before2[NONE]
    s += np.array(file_features(raw, low)) @ f.file
    open_at = np.flatnonzero(s[:, 0] - s[:, 1:].max(axis=1) < f.lead)
    if not len(open_at):
        return []
    tags: dict[int, int] = {}
    for run in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1):
        tags |= {k: y for k, y in zip(run.tolist(), f.viterbi(s[run]), strict=True) if y}
    if not tags:
        return []
    places = places or cut_places(text, [])
    ends = np.maximum.accumulate([e for _, _, e, _ in base])
    out: list[tuple[int, int]] = []
    at, runs, last = -1, [], -2
    for k in sorted(tags):
        w = k if first is None else int(np.searchsorted(first, k, side="right")) - 1
        if w != at:
            at, runs = w, pieces(words[w].decode())
        _, _, a, b = runs[k - (w if first is None else int(first[w]))]
        a, b = places[w][0] + a, places[w][0] + b
        before = bisect_left(base, (b,))
        if before and ends[before - 1] > a:
            continue
        joined = tags[k] == 2 and last == k - 1
        if joined and b > a:
            out[-1] = (out[-1][0], b)
        elif b > a:
            out.append((a, b))
        if joined or b > a:
            last = k
    return out


def all_spans(text: str, scores: Scores) -> list[tuple[int, int, int, int]]:
    raw = text.encode()
    low = raw.lower()
    base = base_spans(text, low)
    return sorted(base + [(a, 3, b, a) for a, b in tagged(text, raw, low, scores, base)])


def written_spans(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


# fitting

#: A window as its pieces' shapes and context classes, their labels, the file's features and the labels beside its ends.
Window = tuple[list[list[int]], list[int], list[int], list[int], list[int]]
WINDOWS = "shapes array<array<int>>, classes array<int>, labels array<int>, about array<int>, edges array<int>"


def windows(text: str, random: Random, quiet: int = 1) -> list[Window]:
    """Windows around each base match, and around a few other pieces."""
    found = [(m.start(), p) for m in WORD.finditer(text) for p in pieces(m.group())]
    if not found:
        return []
    places = [(at + lo, at + hi) for at, (lo, hi, _, _) in found]
    raw = text.encode()
    base = base_spans(text, raw.lower())
    label = [0] * len(places)
    starts = np.array([at + a for at, (_, _, a, _) in found])
    bare = []
    for _, kind, end, value in base:
        k = int(np.searchsorted(starts, value, side="right")) - 1
        first = True
        while k < len(places) and starts[k] < end:
            if kind == 2:
                bare.append(k)
            label[k], first, k = label[k] or (1 if first else 2), False, k + 1
    away = {j for k in bare if not any(s <= places[k][0] < e for s, kind, e, _ in base if kind < 2) for j in range(k - NEAR, k + NEAR + 1)}
    spots = [k for k, y in enumerate(label) if y == 1][:20]
    spots += [random.randrange(len(places)) for _ in range(quiet)]
    odd = [k for k, (a, b) in enumerate(places) if b - a > 13 and not label[k]]
    spots += random.sample(odd, min(1, len(odd)))
    spots = [k for k in spots if k not in away]
    about, out = file_features(raw, raw.lower()), []
    beside = [0, *label, 0]
    for k in spots:
        lo, hi = max(0, k - NEAR), min(len(places), k + NEAR + 1)
        words = [text[a:b] for a, b in places[lo:hi]]
        out.append(([shape(x) for x in words], [context(x) for x in words], label[lo:hi], about, [beside[lo], beside[hi + 1]]))
    return out


ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def made_up(random: Random) -> list[tuple[str, int]]:
    """A few words with a random secret among them: behind a keyword, or with a well-known beginning."""
    alphabet = random.choice(ALPHABETS)
    secret = "".join(random.choice(alphabet) for _ in range(random.choice((20, 24, 32, 40, 44, 64))))
    key, sign, quote = random.choice(("token", "password", "secret", "api_key", "auth", "credential", "bearer", "private_key")), random.choice(("=", ":", "")), random.choice(('"', "'", ""))
    kind = random.random()
    if kind < 0.15:
        half = len(secret) // 2
        return [(key, 0), (sign or "=", 0), (quote + secret[:half], 1), (secret[half:] + quote, 2)]
    if kind < 0.3:
        start = random.choice(("ghp_", "sk_live_", "xoxb-", "eyJhbGciOi", "glpat-", "AIzaSy", "npm_", "hf_"))
        return [(w, 0) for w in (key, sign) if w] * (random.random() < 0.5) + [(quote + start + secret + quote, 1)]
    if kind < 0.4:
        return [(key + (sign or "="), 0), (quote + secret + quote, 1)] if random.random() < 0.5 else [(random.choice(("", "?", "&")) + key + "=" + secret, 1)]
    return [(w, 0) for w in (key, sign) if w] + [(quote + secret + quote, 1)]


def _drawn(random: Random, alphabet: str, least: int, most: int) -> str:
    return "".join(random.choice(alphabet) for _ in range(random.randint(least, most)))


_DIGITS, _HEX, _UPPER_LETTERS, _LETTERS, _ALNUM, _BASE64 = "0123456789", ALPHABETS[0], ALPHABETS[2][:26], ALPHABETS[2][26:52], ALPHABETS[2], ALPHABETS[3]


def _named(random: Random) -> str:
    return "".join(random.choice("bcdfghlmnprst") + random.choice("aeiou") for _ in range(random.randint(2, 4)))


#: Strings that are no secrets, of each kind one for a random source.
PLAIN_KINDS = {
    "time": lambda r: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}{r.choice('T_')}{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}{r.choice(('Z', '', '.' + _drawn(r, _DIGITS, 3, 6), '+02:00'))}",
    "stamp": lambda r: f"{_named(r)}{r.choice('-_')}{r.randint(1990, 2040)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}{r.choice('-_T')}{_drawn(r, _DIGITS, 4, 6)}{r.choice(('', '.log', '.txt', '.tar.gz'))}",
    "doi": lambda r: f"10.{_drawn(r, _DIGITS, 4, 5)}/{r.choice((_named(r), _named(r).upper(), 's' + _drawn(r, _DIGITS, 5, 5)))}{r.choice('.-')}{_drawn(r, _DIGITS, 4, 7)}{r.choice(('', '.' + _drawn(r, _DIGITS, 2, 4), '-' + _drawn(r, _DIGITS, 3, 4)))}",
    "number": lambda r: _drawn(r, _DIGITS, 9, 24),
    "groups": lambda r: "-".join(_drawn(r, _DIGITS, 2, 5) for _ in range(r.randint(3, 5))),
    "camera": lambda r: f"{r.choice(('IMG', 'DSC', 'PXL', 'VID', 'DJI', 'MVI', _named(r)))}{r.choice('_-')}{_drawn(r, _DIGITS, 4, 8)}{r.choice('_-')}{_drawn(r, _DIGITS, 4, 9)}.{r.choice(('jpg', 'JPG', 'png', 'mp4', 'jpeg', 'MOV'))}",
    "uuid": lambda r: (lambda x: r.choice((x, x.upper())))("-".join(_drawn(r, _HEX, n, n) for n in (8, 4, 4, 4, 12))),
    "version": lambda r: f"{r.choice(('lib', '', 'py'))}{_named(r)}-{r.randint(0, 30)}.{r.randint(0, 40)}.{r.randint(0, 99)}{r.choice(('-x86_64', '_amd64.deb', '-py3-none-any.whl', '.tar.gz', '-1.el8', '-beta2', ''))}",
    "picture": lambda r: f"data:image/{r.choice(('png', 'jpeg', 'gif'))};base64,{_drawn(r, _BASE64, 40, 200)}{r.choice(('', '=', '=='))}",
    "path": lambda r: "/" + "/".join(_named(r) + r.choice(("", str(r.randint(1, 99)))) for _ in range(r.randint(2, 5))) + r.choice(("", ".html", ".py", ".h5")),
    "link": lambda r: f"https://{_named(r)}.{_named(r)}.org/{_named(r)}/{r.choice((_named(r), _drawn(r, _DIGITS, 5, 10), _drawn(r, _ALNUM, 8, 12)))}{r.choice(('', '?id=' + _drawn(r, _DIGITS, 3, 9), '.html'))}",
    "camel": lambda r: r.choice((str, str.capitalize))(_named(r)) + "".join(_named(r).capitalize() for _ in range(r.randint(2, 4))) + r.choice(("", str(r.randint(1, 99)))),
    "snake": lambda r: r.choice("_-").join(_named(r) for _ in range(r.randint(3, 5))) + r.choice(("", "_" + str(r.randint(1, 99)))),
    "order": lambda r: f"{_drawn(r, _UPPER_LETTERS, 2, 5)}{r.choice('-/_')}{r.randint(1990, 2040)}{r.choice('-/_')}{_drawn(r, _DIGITS, 4, 9)}",
    "serial": lambda r: "-".join(_drawn(r, _UPPER_LETTERS + _DIGITS, 4, 6) for _ in range(r.randint(3, 5))),
    "model": lambda r: f"{_drawn(r, _UPPER_LETTERS, 1, 4)}{r.choice(('', '-'))}{_drawn(r, _DIGITS, 3, 5)}{_drawn(r, _UPPER_LETTERS, 1, 3)}{r.choice('-/')}{_drawn(r, _DIGITS, 1, 4)}{_drawn(r, _UPPER_LETTERS, 0, 2)}",
    "gene": lambda r: _drawn(r, r.choice(("ACGT", "acgt", "ACDEFGHIKLMNPQRSTVWY")), 12, 80),
    "account": lambda r: _drawn(r, _UPPER_LETTERS, 2, 2) + _drawn(r, _DIGITS, 14, 24),
    "address": lambda r: r.choice((":", "-")).join(_drawn(r, _HEX, 2, 2) for _ in range(6)),
    "hash": lambda r: r.choice(("sha256:", "sha512-", "md5:", "W/", "")) + _drawn(r, r.choice((_BASE64, _HEX.upper(), _ALNUM)), 20, 88) + r.choice(("", "=", "==")),
    "mail": lambda r: f"{_named(r)}.{_named(r)}{r.randint(1, 9999)}@{_named(r)}.{r.choice(('com', 'org', 'net'))}",
}


def made_up_plain(random: Random) -> list[tuple[str, int]]:
    """A few words with something among them that looks like a secret and is none, sometimes named, quoted or behind a sign."""
    text, kind = PLAIN_KINDS[random.choice(list(PLAIN_KINDS))](random), random.random()
    text = random.choice(("", "", "", "(", '"', "'")) + text
    text += {"(": ")", '"': '"', "'": "'"}.get(text[0], random.choice(("", "", ",", ".", ";")))
    name = random.choice(("id", "file", "version", "doi", "at", "see", "on", "of", "ref", "no", "date", "uuid", "image", "sha256", "from", "model", "sequence", "time", "hash", "value", "name", "key"))
    sign = random.choice(("=", ":"))
    words = [name + sign, text] if kind < 0.2 else [name, sign, text] if kind < 0.3 else [name, text] if kind < 0.4 else [name + sign + text] if kind < 0.45 else [text]
    return [(w[lo:hi], 0) for w in words for lo, hi, _, _ in pieces(w)]


def training_arrays(found: list[Window], seed: int = 7) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of features, labels, edges) of the windows of each length, and of quiet ones with made-up secrets, and twice as many other strings, put into them."""
    random = Random(seed)
    quiet = [f for f in found if not any(f[2])] or [([shape("the")] * (2 * NEAR + 1), [PLAIN] * (2 * NEAR + 1), [0] * (2 * NEAR + 1), [0] * N_FILE, [0, 0])]
    rows = list(found)
    n = max(300, len(found) // 4)
    for made in [made_up] * n + [made_up_plain] * 2 * n:
        shapes, classes, labels, about, edges = random.choice(quiet)
        k, new = random.randrange(len(labels) + 1), made(random)
        put = lambda old, of, k=k, new=new: [*old[:k], *map(of, new), *old[k:]]
        rows.append((put(shapes, lambda x: shape(x[0])), put(classes, lambda x: context(x[0])), put(labels, lambda x: x[1]), [int(random.random() < 0.8), *about[1:]], edges))
    a, out = np.cumsum((0, *Field.SIZES)).tolist(), []
    for places in sorted({len(r[2]) for r in rows}):
        group, lists = [r for r in rows if len(r[2]) == places], []
        for shapes, classes, _, about, _ in group:
            c = np.array(classes, np.int8)
            before, before2, after = (v.tolist() for v in (shifted(c, 1), shifted(c, 2) if len(c) > 2 else np.full(len(c), NONE), shifted(c, -1)))
            file = [a[4] + k for k, x in enumerate(about) if x]
            lists += [[*own, a[1] + before[k], a[2] + before2[k], a[3] + after[k], *file] for k, own in enumerate(shapes)]
        x = np.full((len(lists), max(map(len, lists))), a[-1])
        for row, numbers in zip(x, lists, strict=True):
            row[: len(numbers)] = numbers
        out.append((x.reshape(len(group), places, -1), np.array([r[2] for r in group]), np.array([r[4] for r in group])))
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Windows of documents as numbers: no word leaves the executors, however long."""
    some = pa.list_(pa.int32())
    for batch in batches:
        found = [f for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in windows(t or "", Random(k or 0))]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.list_(some) if k == 0 else some) for k in range(5)], names=[c.split()[0] for c in WINDOWS.split(", ")])


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fit_field(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field fitted on about `sample` documents at most."""
    t = _slim(docs, id_col, text_col)
    share = min(1.0, sample / max(1, t.count()))
    chosen = t.filter(F.pmod(F.xxhash64("doc_id", F.lit(sample)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = map_arrow(chosen, _sampled, WINDOWS).collect()  # at most about 22 windows of 9 pieces a document
    return Field.fit(training_arrays(sorted(tuple(r) for r in rows)))


def _scores(weights: np.ndarray, moves: np.ndarray) -> Scores:
    key = hashlib.sha256(weights.tobytes() + moves.tobytes()).digest()
    return held(("secret scores", key), lambda: Scores(Field(weights, moves)))


def _scan(weights: np.ndarray, moves: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        scores = _scores(weights, moves)
        for batch in batches:
            spans = [all_spans(t, scores) if t else [] for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(x[1] == k for x in s) for s in spans], pa.int64()) for k in range(4)]
            base = [hashlib.sha256(written_spans([x for x in s if x[1] < 3]).encode()).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array([written_spans(s) for s in spans], pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def scan_secrets(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base matches by kind and of added spans, the base spans' hash, all spans."""
    field = field or fit_field(docs, id_col=id_col, text_col=text_col)
    return map_arrow(_slim(docs, id_col, text_col), _scan(field.weights, field.moves), SCHEMA)


def redacted(text: str, scores: Scores, mark: str = "[SECRET]") -> str:
    """The text with the value of every secret replaced."""
    out, at = [], 0
    for a, b in sorted((value, end) for _, _, end, value in all_spans(text, scores)):
        if b > at:
            out += [text[at : max(a, at)]] + [mark] * (a >= at)
            at = b
    return "".join(out) + text[at:]


def _redact(weights: np.ndarray, moves: np.ndarray, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        scores = _scores(weights, moves)
        for batch in batches:
            texts = [redacted(t, scores) if t else t for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place).name, pa.array(texts, pa.string()))

    return run


def redact_secrets(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with secrets in its texts replaced; its columns and rows stay."""
    field = field or fit_field(docs, id_col=id_col, text_col=text_col)
    return map_arrow(docs, _redact(field.weights, field.moves, docs.columns.index(text_col)), docs.schema)
