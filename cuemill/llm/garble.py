"""Text that was decoded with the wrong character encoding: finding it, and the original where it can be had back.

A noisy channel: some true text was written in one encoding and read in another, perhaps more than once, and bytes
without a character in the wrong table were lost. For every pair of encodings a field is laid out as a lattice of
the bytes it was read from, in which a lost byte is a wildcard: the set of bytes that the wrong table lacks. What is
valid in the true encoding makes a lattice of characters; a place that several characters fit is kept as their set,
and the next reading goes on from there. A Viterbi search through the lattice under the word frequencies of the whole
corpus finds its cheapest path. The cheapest reading wins if it beats the text as it stands by a margin.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.session import materialize

#: Encodings that UTF-8 bytes may have been read in.
UTF8_READ_AS = ["cp1252", "latin-1", "cp437", "cp850", "cp866", "cp1251", "mac_roman", "cp1250", "koi8_r", "iso8859_15", "mac_cyrillic"]
#: Single-byte pairs (true, read as).
SINGLE = [("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8_r", "cp1252"), ("koi8_r", "cp1251"), ("cp866", "cp1252"), ("cp866", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250")]
#: Multi-byte pairs (true, read as).
MULTI = [(t, e) for t in ("cp932", "euc_jp") for e in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp866")]
#: Words are told apart down to this share of the corpus (so there are 1 / MODEL_SHARE at most); rarer ones cost as unknown ones.
MODEL_SHARE = 2e-6
#: A reading must be this much cheaper (natural logarithm) than the text as it stands.
MARGIN = 4.0
LOST = "�"
#: What a mark costs in a place that is not usual for it.
ODD_PLACE = 10.0
#: More lost characters in a row than this are left as they are: nothing is known of any of them.
RUN = 8
#: Marks that are ordinary in text of any language (fixed values).
MARKS = set("“”„‚‘’…—–«»¿¡♪、。？！「」『』・ー·  　​﻿")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
_PLAIN = re.compile(r"[\x00-\x7f]|[^\W\d_]")
_ALONE = re.compile("[ '’]� ")
_C1 = re.compile(r"[\x80-\x9f]")


@lru_cache(None)
def byte_of(encoding: str) -> dict[str, int]:
    """Byte of each character of a single-byte encoding; bytes it lacks stand for the control characters of their number."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


@lru_cache(None)
def lacking(encoding: str) -> list[int]:
    """Bytes without a character: what a lost one may have been."""
    out = []
    for b in range(128, 256):
        try:
            bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out.append(b)
    return out


def _class(encoding: str, low: int, high: int, more: str = "") -> str:
    return "[" + "".join(re.escape(c) for c, b in byte_of(encoding).items() if low <= b <= high and ord(c) > 127) + more + "]"


@lru_cache(None)
def sequence_pattern(encoding: str) -> re.Pattern:
    """What two to four bytes of UTF-8 look like when read in an encoding; a lost byte may stand for the second and later ones."""
    cont, two, three, four = _class(encoding, 0x80, 0xBF, LOST + "\U00100000-\U0010FFFD"), _class(encoding, 0xC2, 0xDF), _class(encoding, 0xE0, 0xEF), _class(encoding, 0xF0, 0xF4)
    return re.compile(f"{three}{cont}{{2}}|{two}{cont}|{four}{cont}{{3}}|{_class(encoding, 0xC3, 0xC3)} (?=[\\w])")


@lru_cache(None)
def trigger() -> re.Pattern:
    parts = [sequence_pattern(e).pattern for e in UTF8_READ_AS]
    return re.compile("|".join([*parts, r"[\x80-\x9f�]", r"[À-ÿ]{2}", r"[А-ЯЁ]{2}", r"[¤¥][¡-ÿ]", "[─-╿]", "[√∂∑∏π∫Ωª◊]"]))


def _one_script(word: str) -> bool:
    """Whether a word is all Latin or all Cyrillic: what is mixed is garbled itself and no model of anything."""
    return all(ord(c) < 0x180 for c in word) or all(0x400 <= ord(c) < 0x500 for c in word)


#: What no text holds that isn't garbled or unusual: letters of other alphabets, signs, lost bytes; or two accented
#: letters side by side, or one beside a sign. Most texts end here.
_ODD = re.compile(r"[^\x00-\x7f“”„‚‘’…—–«»¿¡♪、。？！「」\xa0\u202f\u3000А-Яа-яЁё぀-ヿ一-鿿À-ÖØ-öø-ÿŒœŽžĆć]|[À-ÿŒœŽž‚][À-ÿŒœŽž“”„‚‘’…—–«»¿¡\xa0 ]|[А-Яа-яЁё][\xa0-\xff“”„‚‘’…—–]|[а-яё][А-ЯЁ]|[А-ЯЁ][а-яё]?[А-ЯЁ]|[À-ÿ]$")


#: Places of a lattice that several characters fit: each set of characters has one character of the last plane to stand for it.
_SETS: dict[tuple[str, ...], str] = {}
_MEMBERS: dict[str, tuple[str, ...]] = {}
_FIRST, _LAST = 0x100000, 0x10FFFD
_OPEN = re.compile("[�\U00100000-\U0010FFFD]")
_SET = re.compile("[\U00100000-\U0010FFFD]")


def place(chars: tuple[str, ...]) -> str:
    """The character that stands for a set of several; the only one of a set of one; LOST where all signs for sets are taken."""
    if len(chars) == 1:
        return chars[0]
    if (c := _SETS.get(chars)) is None:
        if _FIRST + len(_SETS) > _LAST:
            return LOST
        c = _SETS[chars] = chr(_FIRST + len(_SETS))
        _MEMBERS[c] = chars
    return c


@lru_cache(100_000)
def bytes_of(c: str, encoding: str) -> tuple[int, ...]:
    """Bytes that a place of a lattice may have been read from: none for a character the encoding lacks."""
    if c == LOST:
        return tuple(lacking(encoding)) or tuple(range(0x80, 0xA0))
    if c in _MEMBERS:
        return tuple(sorted({b for x in _MEMBERS[c] for b in bytes_of(x, encoding)}))
    b = byte_of(encoding).get(c)
    return () if b is None else (b,)


class Model:
    """Costs of words (negative natural logarithms of their share of the corpus), and the search under them.

    words: counts; titles: of words that begin with a letter beyond ASCII, how often they do with a capital; pairs:
    how often a single character beyond ASCII stands behind a word.
    """

    def __init__(self, words: dict[str, int], total: int, titles: dict[str, int] | None = None, pairs: dict[str, int] | None = None):
        words = {w: c for w, c in words.items() if _one_script(w)}
        self.pairs = pairs or {}
        self.log = {w: -math.log(c / max(1, total)) for w, c in words.items()}
        self.title = {w: min(0.98, max(0.02, c / max(1, words.get(w, 0)))) for w, c in (titles or {}).items()}
        #: Words in which a place may have been lost, in order: what begins like a prefix stands together.
        self.spelled = sorted(w for w in words if not w.isascii())
        letters = sorted({c for w in self.spelled for c in w if not c.isascii()})
        #: What a place may have held of which nothing is known.
        self.lost = [*letters, *[c.upper() for c in letters if len(c.upper()) == 1 and c.upper() != c], "“", "”", "’", "…", "—", "¿", "¡"]
        self.known = lru_cache(200_000)(self._word)

    def _word(self, word: str) -> float:
        if _CJK.search(word):
            kana = sum(1 for c in word if "぀" <= c <= "ヿ")
            other = sum(1 for c in word if not _CJK.match(c))
            return 2.5 * kana + 5.0 * (len(word) - kana) + 8.0 * other
        low = word.casefold()
        if (cost := self.log.get(low)) is not None:
            ragged = not (word.islower() or word.isupper() or word.istitle())
            return cost + 3.0 * ragged
        cost = 12.0 + 1.2 * len(word)
        latin, greek_etc = 0, 0
        for c in low:
            o = ord(c)
            if o < 128 or 0xDF <= o <= 0x17F:
                latin += 1
            elif not 0x400 <= o <= 0x4FF:
                greek_etc += 1
        mixed = 0 < latin < len(low)
        return cost + 8.0 * mixed + 6.0 * greek_etc

    def cost(self, text: str) -> float:
        """Cost of a text; of a lattice, that of its cheapest path, places lost for good at the price of such."""
        if _SET.search(text):
            return self.search(text, fill=False)[1]
        return sum(map(self.known, _WORD.findall(text))) + sum(map(self.sign, _PLAIN.sub("", text)))

    def sign(self, c: str) -> float:
        """Cost of a character that is no letter."""
        return 0.0 if _PLAIN.match(c) else 3.0 if c in MARKS else 14.0 if c == LOST or "\x80" <= c <= "\x9f" else 9.0

    def begins(self, prefix: str) -> bool:
        """Whether any word with a letter beyond ASCII begins so."""
        low = prefix.casefold()
        i = bisect_left(self.spelled, low)
        return i < len(self.spelled) and self.spelled[i].startswith(low)

    def search(self, text: str, fill: bool = True) -> tuple[str, float]:
        """The cheapest path through a lattice (Viterbi) and its cost; what was lost for good is filled or stays. A state is the word begun and whether a quotation is open.

        Beginnings that no word has are one state: they cost as unknown words whatever their letters are.
        """
        # state: (beginning, known, open) -> (cost, (path before, piece))
        states: dict[tuple[str, bool, bool], tuple[float, tuple | None]] = {("", True, False): (0.0, None)}

        def put(into: dict, begun: str, known: bool, opened: bool, cost: float, path: tuple | None) -> None:
            key = (begun, True, opened) if known else ("", False, opened)
            old = into.get(key)
            if old is None or cost < old[0]:
                into[key] = (cost, path) if known else (cost, (path, begun))

        def close(into: dict, key: tuple, value: tuple, piece: str, price: float, opened: bool | None = None) -> None:
            begun, known, was = key
            cost, path = value
            if begun and known:
                cost += self.known(begun) + self._case(begun)
                path = (path, begun)
            elif not known:
                cost += 26.0
            put(into, "", True, was if opened is None else opened, cost + price, (path, piece))

        for m in re.finditer(rf"[^\W\d_]+|{LOST}{{{RUN + 1},}}|.", text, re.S):
            piece, new = m[0], {}
            here = _MEMBERS.get(piece) or (self.lost if piece == LOST and fill else None)
            if here is None:
                letters = piece[0].isalpha()
                for key, value in states.items():
                    if letters:
                        if key[1]:
                            put(new, key[0] + piece, True, key[2], *value)
                        else:
                            put(new, piece, False, key[2], *value)
                    else:
                        close(new, key, value, piece, sum(map(self.sign, piece)), True if piece in "“„«" else False if piece in "”»" else None)
            else:
                before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
                for key, value in states.items():
                    for c in here:
                        if c.isalpha() and not _CJK.match(c):
                            begun = key[0] + c
                            known = key[1] and self.begins(begun)
                            late = 3.0 if before == LOST and key[0] == "" and key[1] else 0.0  # a word right behind a mark
                            put(new, begun if key[1] else c, known, key[2], value[0] + late, value[1])
                        elif _CJK.match(c):
                            close(new, key, value, c, self.known(c))
                        else:
                            price, opened = self._mark(c, key, before, after)
                            close(new, key, value, c, price, opened)
            states = new
        ends: dict = {}
        for key, value in states.items():
            close(ends, key, value, "", 0.0)
        cost, path = min(ends.values(), key=lambda v: v[0])
        out = []
        while path is not None:
            path, piece = path
            out.append(piece)
        found = "".join(reversed(out))
        return self._alone(text, found) if fill else found, cost

    def _alone(self, text: str, found: str) -> str:
        """Single lost characters between words are what most often stood behind the word before them."""
        if not _ALONE.search(text):
            return found
        was, now = text.split(" "), found.split(" ")
        for i, w in enumerate(was[:-1]):
            lone = w == LOST and i > 0
            if len(was) == len(now) and (lone or (w[-2:-1] in ("'", "’") and w[-1] == LOST)):
                before = f"{now[i - 1]} " if lone else now[i][:-1]
                fits = [(n, c) for c in self.lost if (n := self.pairs.get((before + c).casefold()))]
                if fits:
                    now[i] = now[i][:-1] + max(fits)[1].lower()
        return " ".join(now)

    def _case(self, word: str) -> float:
        """What a first letter beyond ASCII costs as it is written: names have a capital, most words don't."""
        if word[0].isascii() or word.isupper() and len(word) > 1:
            return 0.0
        share = self.title.get(word.casefold(), 0.5)
        return -math.log(share if word[0].isupper() else 1 - share)

    def _mark(self, c: str, key: tuple, before: str, after: str) -> tuple[float, bool | None]:
        """Cost of a mark behind a state, between two characters, and whether a quotation is open then."""
        inside, opened = key[0] != "" or not key[1], key[2]
        apart, letter = not before or before.isspace(), after.isalpha()
        follows = letter or after == LOST or after in _MEMBERS
        if c in "“„«":
            return 3.0 + ODD_PLACE * (inside or opened or not follows or not (apart or before in "¿¡(—" or before == LOST)), True
        if c in "”»":
            return 3.0 + ODD_PLACE * (not opened or letter or apart), False
        if c in "’‘":
            return 5.5 + ODD_PLACE * (not inside or not follows), None
        if c == "…":
            return 5.0 + ODD_PLACE * (letter or apart), None
        if c in "—–":
            return 6.0 + ODD_PLACE * (not apart or letter or not before), None
        if c in "¿¡":
            return 4.0 + ODD_PLACE * (inside or not follows), None
        return self.cost(c) + 4.0, None


def _utf8(chars: str, encoding: str) -> str | None:
    """The place for the characters whose UTF-8 bytes may have been read as these; None where there are none."""
    sets = [(0xA0,) if c == " " else bytes_of(c, encoding) for c in chars]
    if all(len(x) == 1 for x in sets):
        try:
            return bytes(x[0] for x in sets).decode("utf-8")
        except UnicodeDecodeError:
            return None
    found = set()
    for raw in product(*[[b for b in x if 0x80 <= b <= 0xBF] if i else x for i, x in enumerate(sets)]):  # 32³ at most
        try:
            c = bytes(raw).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(c) == 1 and _likely(c):
            found.add(c)
    return place(tuple(sorted(found))) if found else None


def _likely(c: str) -> bool:
    """Whether a character is of a script or a kind of mark that texts here are written in, or of a second garbling."""
    o = ord(c)
    return o >= _FIRST or o < 0x180 or o in (0x192, 0x2C6, 0x2DC) or 0x370 <= o < 0x500 or 0x2000 <= o < 0x2800 or 0x3000 <= o < 0x3100 or 0x4E00 <= o < 0xA000 or o >= 0xFB00


def _read_utf8(text: str, encoding: str) -> str:
    return sequence_pattern(encoding).sub(lambda m: m[0] if (c := _utf8(m[0], encoding)) is None or not _likely(c) else c, text)


@lru_cache(None)
def _single_table(true: str, read: str) -> dict[int, str]:
    out = {}
    for c, b in byte_of(read).items():
        if b >= 128:
            try:
                out[ord(c)] = bytes([b]).decode(true)
            except UnicodeDecodeError:
                pass
    return out


def _read_single(text: str, true: str, read: str, model: Model) -> str:
    """Word by word, each taken over where its other reading is cheaper."""
    table, out = _single_table(true, read), []
    for piece in re.split(r"(\s+)", text):
        if not piece.isascii():
            other = piece.translate(table)
            fewer = sum(map(str.isalpha, other)) < sum(map(str.isalpha, piece))  # marks for letters are cheap, but no reading
            if other != piece and not fewer and model.cost(other) < model.cost(piece) - 1.0:
                piece = other
        out.append(piece)
    return "".join(out)


@lru_cache(100_000)
def _cell(sets: tuple[tuple[int, ...], ...], true: str) -> tuple[float, str]:
    """Cost and place of the characters that one or two sets of bytes may be; an infinite cost where they are none."""
    found = set()
    for raw in product(*sets):
        try:
            c = bytes(raw).decode(true)
        except UnicodeDecodeError:
            continue
        if len(c) == 1:
            found.add(c)
    if not found:
        return math.inf, LOST
    return min(2.5 if "぀" <= c <= "ヿ" else 3.0 if c in MARKS or c.isascii() else 5.0 if _CJK.match(c) else 9.0 for c in found), place(tuple(sorted(found)))


def _pairs(sets: list[tuple[int, ...]], true: str) -> str:
    """The cheapest cut of a lattice of bytes into characters of one or two bytes; places that several fit stay open."""
    n = len(sets)
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    for i in range(n):
        at = best[i][0]
        for k in (1, 2):
            if i + k > n:
                break
            price, piece = _cell(tuple(sets[i : i + k]), true)
            if k == 1 and math.isinf(price):
                price = 14.0
            if at + price < best[i + k][0]:
                best[i + k] = (at + price, i, piece)
    out, i = [], n
    while i:
        _, before, piece = best[i]
        out.append(piece)
        i = before
    return "".join(reversed(out))


def _japanese(c: str) -> bool:
    return _CJK.match(c) is not None or c in MARKS or (c in _MEMBERS and any(map(_japanese, _MEMBERS[c])))


def _read_multi(text: str, true: str, read: str) -> str:
    """Runs of characters that may be read from bytes, taken over where they are Japanese in the true encoding."""
    table, out, at = byte_of(read), [], 0
    while at < len(text):
        end = at
        while end < len(text) and (text[end] in table or text[end] == LOST or text[end] in _MEMBERS):
            end += 1
        run = text[at:end]
        if sum(1 for c in run if ord(c) > 127) >= 4:
            if (lost := len(_OPEN.findall(run))) * 3 > len(run):
                got = run  # too little is left of it to tell Japanese
            elif lost:
                sets = [bytes_of(c, read) for c in run]
                got = _pairs(sets, true) if all(sets) else run
            else:
                got = bytes(table[c] for c in run).decode(true, "replace")
            kana, lost = sum(1 for c in got if "぀" <= c <= "ヿ"), got.count(LOST)
            if kana >= 2 and lost <= len(got) // 5 and sum(map(_japanese, got)) * 2 >= len(got.strip()):
                run = got
        out.append(run)
        if end == at:
            out.append(text[at])
            end = at + 1
        at = end
    return "".join(out)


def _step(now: str, cost: float, ways: list, read, model: Model, gain: float) -> tuple[str, float]:
    """The cheapest of a text's readings, or the text itself where none is cheaper by `gain`."""
    best, price, tried = now, cost - gain, {now}
    for way in ways:
        other = read(now, way)
        if other not in tried:
            tried.add(other)
            if (c := model.cost(other)) < price:
                best, price = other, c
    return (now, cost) if best == now else (best, price)


def _chain(now: str, cost: float, model: Model) -> tuple[str, float]:
    """Readings of several bytes a character, as often as one makes the text cheaper: it may have been misread twice."""
    while True:  # ends: each reading is cheaper than the one before
        before = now
        ways = [e for e in UTF8_READ_AS if sequence_pattern(e).search(now)]
        if sum(1 for c in now if ord(c) > 127) >= 4:
            ways += MULTI
        if not ways:
            break
        now, cost = _step(now, cost, ways, lambda t, w: _read_utf8(t, w) if isinstance(w, str) else _read_multi(t, *w), model, 0.5)
        if now == before:
            break
    return now, cost


def restore(text: str | None, model: Model) -> tuple[bool, str | None, bool]:
    """Whether a text was garbled, the text as far as it can be restored, and whether nothing is left lost."""
    if not text or text.isascii() or not _ODD.search(text) or not trigger().search(text):
        return False, text, True
    if max(text) >= "\U00100000":  # private characters are no text; here they stand for open places
        text = "".join(c for c in text if c < "\U00100000")
    start = model.cost(text)
    paths = [_chain(text, start, model)]
    # Frequent words don't speak for a text: the corpus that counts them is garbled too.
    one = _step(text, start, SINGLE, lambda t, pair: _read_single(t, *pair, model), model, 2.0)
    paths.append(_step(*paths[0], SINGLE, lambda t, pair: _read_single(t, *pair, model), model, 2.0))
    if one[0] != text:
        paths.append(_chain(*one, model))
    now, cost = min(paths, key=lambda p: p[1])
    open_ = _OPEN.search(now) is not None
    broken = open_ or bool(_C1.search(now))
    if open_:
        now, cost = model.search(now)
    whole = LOST not in now and not _C1.search(now)
    garbled = broken or (now != text and start - cost >= MARGIN)
    return (True, now, whole) if garbled else (False, text, True)


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """word, n, titles: counts of the alphabetic words of all texts in lower case, and of those with a capital among them; also of words with a single character beyond ASCII behind them."""
    words = F.regexp_extract_all(column, F.lit(r"([\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+)"), F.lit(1))
    pairs = F.transform(F.regexp_extract_all(column, F.lit(r"(\p{L}+['’ ][^\x00-\x7f�])(?= )"), F.lit(1)), F.lower)
    each = texts.where(F.col(column).isNotNull()).select(F.explode(F.concat(words, pairs)).alias("w"))
    spelled = each.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return spelled.groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("w").rlike(r"^\p{Lu}"), F.col("n")).otherwise(0)).alias("titles"))


Trained = tuple[dict[str, int], int, dict[str, int], dict[str, int]]


def train(texts: DataFrame, column: str, share: float = MODEL_SHARE) -> Trained:
    """Word counts of the whole corpus: those seen twice or more that make up a share of it, the total, and capitals of those that begin beyond ASCII."""
    counts = materialize(word_counts(texts, column), "words")
    pair = F.col("word").rlike("['’ ].$")
    total = counts.where(~pair).agg(F.sum("n")).first()[0] or 0
    kept = counts.where(F.col("n") >= max(2.0, share * total)).select("*", pair.alias("pair")).collect()  # at most 2 / share rows
    words = [r for r in kept if not r.pair]
    return {r.word: r.n for r in words}, total, {r.word: r.titles for r in words if not r.word[0].isascii()}, {r.word: r.n for r in kept if r.pair}


_MODELS: dict[str, Model] = {}


def new_key() -> str:
    """Names a broadcast value for good: a Python worker that lives on must not take another's model for it."""
    return uuid.uuid4().hex


def model_of(key: str, value: Trained) -> Model:
    """One model a worker; key: new_key() of the broadcast it comes in."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*value)
    return _MODELS[key]


def find_garbled(fields: DataFrame, keep: list[str], text: str, trained: Trained) -> DataFrame:
    """keep columns, restored STRING, whole BOOLEAN: the rows whose text was garbled.

    Null and empty texts and texts of ASCII alone are never garbled. Repeated rows are each judged. whole tells
    whether nothing is left lost in the restored text. An empty table gives no rows.
    """
    shared = fields.sparkSession.sparkContext.broadcast(trained)  # at most 1 / MODEL_SHARE words
    key = new_key()
    slim = fields.select(*keep, F.col(text).alias("_text")).where(F.col("_text").rlike(r"[^\x00-\x7f]"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", restored string, whole boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(key, shared.value)
        again = lru_cache(100_000)(lambda x: restore(x, model))  # lines recur
        for b in batches:
            got = [again(x) if len(x) < 400 else restore(x, model) for x in b.column(b.num_columns - 1).to_pylist()]
            at = pa.array([i for i, g in enumerate(got) if g[0]], pa.int64())
            cols = [c.take(at) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([g[1] for g in got if g[0]], pa.string()), pa.array([g[2] for g in got if g[0]], pa.bool_())], names=[*b.schema.names[:-1], "restored", "whole"]
            )

    return slim.mapInArrow(work, schema)
