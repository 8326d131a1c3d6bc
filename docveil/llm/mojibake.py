"""Garbled text from a wrong character encoding (problem 7).

Adjacent characters are scored by corpus mutual information. The marginals are floored: a character met only in
damaged text would otherwise look strongly tied to its equally damaged neighbours. Where the score stays low over a
stretch (a maximum-scoring segment of improbability, sought over whole texts, many at a time), the words it touches are
put through the inverse of each plausible wrong decoding, and a reading that raises the score is taken as the original.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.llm.inputs import rows_of, union
from docveil.llm.lookalikes import LOOKALIKE

#: Symbols of the pair statistics: code points below LATIN stand for themselves, all others share one symbol per
#: 64 code points, folded into the remaining symbols. The pair table has SYMBOLS ** 2 cells at most, at any scale.
SYMBOLS, LATIN = 1024, 0x250
#: Least share of a character in the expected frequency of a pair.
FLOOR = 0.01
#: A pair is improbable when its score is below this (nats).
IMPROBABLE = 0.0
#: Gain in score each changed character must bring.
GAIN = 2.0
#: Decodings that damage text, and what the text was before.
WRONG = ("cp1252", "latin-1", "cp1254", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp857")
RIGHT = ("cp1254", "cp857", "mac_turkish")
#: Letters of the five languages; they are not taken for a wrongly read byte on their own.
NATURAL = "ÄÖÜäöüßÀÂÆÇÉÈÊËÎÏÔŒÙÛàâæçéèêëîïôœùûÌÍÒÓìíòóÚúĞİŞğışÁá"
#: Bins of the word sketch, in each of its two rows.
BINS = 1 << 19
#: A word is sound as it stands when it occurs KNOWN times and this often for each time its best reading does.
KNOWN, OFTENER = 6, 5
#: Damage that left only letters of the five languages is believed when its reading occurs this many times as often.
CERTAIN = 20
#: Characters gone over at a time.
CHUNK = 1 << 19
#: Joined letters that printed text holds.
JOINED = "ﬁﬂ"
#: Signs that stand in sound text, after a unit or alone.
SIGNS = "²³½¼¾№™®©§€£°ªº…„“”–—•«»‰†‡·±×÷¹µ"


def _symbols(cps: np.ndarray) -> np.ndarray:
    return np.where(cps < LATIN, cps, LATIN + (cps >> 6) % (SYMBOLS - LATIN))


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _word_bins(cps: np.ndarray, row: int) -> np.ndarray:
    """A bin for each word that holds a character beyond ASCII; words end at blanks, their edges lose punctuation."""
    letter = (cps > 0x7F) | ((cps >= 97) & (cps <= 122)) | ((cps >= 65) & (cps <= 90))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.int64)
    beyond = np.concatenate(([0], np.cumsum(cps > 0x7F)))
    keep = beyond[ends] > beyond[starts]
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.zeros(0, np.int64)
    x = (cps.astype(np.uint64) + np.uint64(1)) * _MIX[row]
    x ^= x >> np.uint64(29)
    # Position in the word enters as a multiplier, so that a word's hash is one sum over its letters.
    n = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    place = (at - np.repeat(starts, n)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.add.reduceat(x[at] * (place * _MIX[1 - row] | np.uint64(1)), np.concatenate(([0], np.cumsum(n)[:-1])))
    return ((h ^ (h >> np.uint64(31))) * _MIX[row] >> np.uint64(64 - 19)).astype(np.int64)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = SYMBOLS * SYMBOLS
    total = np.zeros(cells + 2 * BINS, np.int64)
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        if texts:
            cps = codepoints("\n".join(texts))
            s = _symbols(cps)
            total[:cells] += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=cells)
            for row in range(2):
                total[cells + row * BINS :][:BINS] += np.bincount(_word_bins(cps, row), minlength=BINS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


class Statistics:
    """Pair scores and the word sketch of a corpus; both of fixed size."""

    def __init__(self, pair: np.ndarray, n: np.ndarray):
        cells = SYMBOLS * SYMBOLS
        total = np.zeros(cells + 2 * BINS)
        total[pair] = n
        c = total[:cells].reshape(SYMBOLS, SYMBOLS)
        all_ = max(c.sum(), 1.0)
        one = np.maximum(c.sum(0) / all_, FLOOR)
        self.w = np.log(((c + 0.05) / all_) / np.outer(one, one)).astype(np.float32)
        self.words = total[cells:].reshape(2, BINS).astype(np.float32)
        self.noise = float(self.words[0].sum() / BINS)

    def count(self, word: str) -> float:
        """Occurrences of the words in ``word`` that hold a character beyond ASCII: of the rarest of them."""
        cps = codepoints(word)
        rows = [self.words[r][_word_bins(cps, r)] for r in range(2)]
        return float(np.minimum(*rows).min()) if len(rows[0]) else 0.0

    def score(self, word: str) -> float:
        """Sum over the pairs of a word; numpy is slower on so few."""
        s = [c if c < LATIN else LATIN + (c >> 6) % (SYMBOLS - LATIN) for c in map(ord, word)]
        pair = self.w.item
        return sum(pair(a, b) for a, b in zip(s, s[1:], strict=False))

    def sound(self, word: str, reading: str) -> bool:
        n = self.count(word)
        return n >= KNOWN and n > OFTENER * (self.count(reading) + self.noise)


def statistics(texts: DataFrame) -> Statistics:
    """Floored pointwise mutual information of adjacent characters, and word counts, over all ``texts.text``.

    Each task adds up what it reads and sends one row per cell that occurs, so the result is bounded by the number
    of cells, whatever the size of the corpus.
    """
    counts = texts.select("text").mapInArrow(_pairs, "pair long, n long").groupBy("pair").sum("n").toPandas()
    return Statistics(counts["pair"].to_numpy(np.int64), counts["sum(n)"].to_numpy(np.float64))


@cache
def _encoder(wrong: str) -> dict[str, int]:
    """Character to byte; bytes the code page leaves open stand for the control of the same number."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(wrong)
        except UnicodeDecodeError:
            ch = chr(b)
        table.setdefault(ch, b)
    return table


@cache
def _single(wrong: str, right: str) -> dict[int, str]:
    out = {}
    for ch, b in _encoder(wrong).items():
        try:
            new = bytes([b]).decode(right)
        except UnicodeDecodeError:
            continue
        if new != ch and unicodedata.category(new)[0] == "L":
            out[ord(ch)] = new
    return out


def _length(lead: int) -> int:
    return 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0


def _from_utf8(word: str, wrong: str) -> str:
    enc, out, i = _encoder(wrong), [], 0
    while i < len(word):
        n = _length(enc.get(word[i], 0))
        if n and i + n <= len(word):
            raw = bytes(enc.get(c, 0) for c in word[i : i + n])
            try:
                out.append(raw.decode("utf-8"))
                i += n
                continue
            except UnicodeDecodeError:
                pass
        out.append(word[i])
        i += 1
    return "".join(out)


#: A character that no sound text of the five languages needs, or a question mark before a letter: without one, no
#: inverse mapping can be tried. Signs and foreign letters are among them; the test of the word decides.
STRANGE = re.compile(f"[^\\x00-\\x7f{NATURAL}]|[?][A-Za-z]")
Path = tuple[str, ...]


def reading(word: str, path: Path) -> str:
    """The word with one chain of inverse mappings applied: code pages read as UTF-8, or a pair of code pages."""
    if path[0] == "bytes":
        return word.translate(_single(path[1], path[2]))
    for wrong in path:
        word = _from_utf8(word, wrong)
    return word


def readings(word: str) -> Iterator[tuple[str, Path]]:
    """What the word may have been before: each inverse mapping, those of byte sequences up to three times over."""
    found, todo = {word}, {word: ()}
    for _ in range(3):
        nxt = {}
        for x, path in todo.items():
            for wrong in WRONG:
                if (r := _from_utf8(x, wrong)) not in found:
                    found.add(r)
                    nxt[r] = (*path, wrong)
                    yield r, nxt[r]
        todo = nxt
    for wrong in WRONG:
        for right in RIGHT:
            if wrong != right and (r := word.translate(_single(wrong, right))) != word:
                yield r, ("bytes", wrong, right)


def segments(x: np.ndarray) -> np.ndarray:
    """Marks what the maximum-scoring segments of ``x`` cover: the running sum is kept at zero or above, each stretch of
    it above zero is one segment, which ends where the sum is largest; what rises again after that is one too.

    A very low score parts texts that are laid end to end."""
    total = np.cumsum(x, dtype=np.float64)
    run = total - np.minimum(np.minimum.accumulate(total), 0.0)
    up = run > 0
    edge = np.flatnonzero(np.diff(up, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return up
    best = np.repeat(np.maximum.reduceat(run, starts), ends - starts)
    inside = np.flatnonzero(up)
    tops = run[inside] == best
    last = np.zeros(len(starts), np.int64)
    last[np.repeat(np.arange(len(starts)), ends - starts)[tops]] = inside[tops]
    cover = np.zeros(len(x) + 1, np.int8)
    cover[starts] += 1
    cover[last + 1] -= 1
    return (np.cumsum(cover[:-1]) > 0) | (x > 0)


#: The sign for what could not be decoded, and a question mark in its place within a word.
LOST = "�"
ASKED = re.compile(r"[^\W\d_]\?+[^\W\d_]|(?<![^\s(\"'])\?[^\W\d_]")
_APART = -1e6


def suspects(stats: Statistics, texts: list[str]) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
    """Number, text and places of the words to be read anew, of each text that has any: those an improbable segment
    touches at a character that a wrong decoding can have left (any beyond ASCII, or a question mark before a letter)."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end]) + 1
            end += 1
        joined = "\n".join(texts[at:end])
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[at:end])])
        if len(joined) > 1 and not joined.isascii() or "?" in joined:
            yield from ((at + i, texts[at + i], [(a - int(begins[i]), b - int(begins[i])) for a, b in words]) for i, words in _touched(stats, joined, begins))
        at = end


def _touched(stats: Statistics, joined: str, begins: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    cps = codepoints(joined)
    if len(cps) < 2:
        return
    s = _symbols(cps)
    x = IMPROBABLE - stats.w[s[:-1], s[1:]]
    border = begins[1:-1] - 1
    x[border[border < len(x)]] = _APART
    x[border[border > 0] - 1] = _APART
    low = segments(x)
    # A character is touched by the pair on either side.
    touched = np.concatenate((low, [False])) | np.concatenate(([False], low))
    asked = (cps == 63) & (np.concatenate((cps[1:], [0])) >= 63)
    spots = np.flatnonzero(touched & ((cps > 0x7F) | asked))
    blanks = np.flatnonzero((cps == 32) | (cps == 10) | (cps == 9))
    k = np.unique(np.searchsorted(blanks, spots))
    edges = np.concatenate(([-1], blanks, [len(cps)]))
    starts, ends = edges[k] + 1, edges[k + 1]
    owner = np.searchsorted(begins, starts, "right") - 1
    for i in np.unique(owner).tolist():
        own = owner == i
        yield i, list(zip(starts[own].tolist(), ends[own].tolist(), strict=True))


class Reader:
    """Reads words anew; what it finds for a word is kept, as words recur. ``KEPT`` words at most are kept."""

    KEPT = 200_000

    def __init__(self, stats: Statistics):
        self.stats, self._kept = stats, {}

    def options(self, word: str) -> list[tuple[str, Path]]:
        """Readings more probable than the word itself, the best one first; none if the word is sound."""
        if (found := self._kept.get(word)) is None:
            if len(self._kept) >= self.KEPT:
                self._kept.clear()
            found = self._kept[word] = self._natural(word) if not STRANGE.search(word) else self._read(word)
        return found

    def _read(self, word: str) -> list[tuple[str, Path]]:
        if word.isascii():
            return []
        base = self.stats.score(f" {word} ")
        rated = [(path[0] == "bytes", -gain, n, r, path) for n, (r, path) in enumerate(readings(word)) if (gain := _gain(self.stats, word, base, r, path)) > 0]
        rated.sort(key=lambda x: x[:3])
        if not rated or self.stats.sound(word, rated[0][3]):
            return []
        return [(r, path) for *_, r, path in rated]

    def _natural(self, word: str) -> list[tuple[str, Path]]:
        """All its letters are those of the five languages: the corpus must know the reading much better than the word."""
        if not any(c in _CONFUSED for c in word):
            return []
        base, out, seen = self.stats.score(f" {word} "), [], set()
        for wrong, right in _PAIRS:
            r = word.translate(_single(wrong, right))
            if r == word or r in seen or r.isascii() or STRANGE.search(r):
                continue
            seen.add(r)
            gone = sum(a != b for a, b in zip(word, r, strict=True))
            if self.stats.score(f" {r} ") - base > GAIN * gone and (n := self.stats.count(r)) >= KNOWN and n > CERTAIN * (self.stats.count(word) + self.stats.noise):
                out.append((-n, r, ("bytes", wrong, right)))
        return [(r, path) for _, r, path in sorted(out)]


def repair(reader: Reader, text: str, words: list[tuple[int, int]], first: bool = False) -> tuple[str, int, int]:
    """The text with the damaged ones of ``words`` restored; the number restored, and of those damaged past knowing.

    Of a word's readings, one by a mapping that restored a word before goes first. With ``first``, the first finding
    ends it."""
    out, at, fixed, lost, known = [], 0, 0, 0, []
    for a, b in words:
        word = text[a:b]
        options = reader.options(word)
        new, path = next(((r, p) for r, p in options if p in known and not STRANGE.search(r)), options[0] if options else (word, None))
        if path and word[-1] in "-¬" and (rest := re.match(r"[ \t]*\n\s*([^\W\d_]+)", text[b:])) and reader.stats.sound(word[:-1] + rest[1], new[:-1] + rest[1]):
            new, path = word, None
        if path:
            fixed += 1
            known += [path] if path not in known else []
        elif LOST in word or ASKED.search(word) or any("\x80" <= c <= "\x9f" for c in word):
            lost += 1
        out += [text[at:a], new]
        at = b
        if first and fixed + lost:
            return text, fixed, lost
    return "".join([*out, text[at:]]), fixed, lost


def repaired(reader: Reader, texts: list[str], first: bool = False) -> dict[int, tuple[str, int, int]]:
    """``repair`` of the texts that are damaged, by their number."""
    out = {}
    for i, text, words in suspects(reader.stats, texts):
        new, fixed, lost = repair(reader, text, words, first)
        if fixed + lost:
            out[i] = (new, fixed, lost)
    for i, t in enumerate(texts):
        if i not in out and LOST in t:
            out[i] = (t, 0, 1)
    return out


def _gain(stats: Statistics, word: str, base: float, r: str, path: Path) -> float:
    """How much more probable the reading is; 0 if it isn't taken."""
    gone = [i for i, c in enumerate(word) if c > "\x7f" and c not in r]
    gain = stats.score(f" {r} ") - base
    if path[0] != "bytes":
        # Byte sequences that are valid are rarely so by chance; single bytes need the gain.
        return max(gain, 0.0) + 2.0 * (len(word) - len(r)) if all(c < "\x7f" or c in NATURAL for c in r) else gain
    inside = [0 < i < len(word) - 1 and word[i - 1].isalpha() and word[i + 1].isalpha() for i in gone]
    # Natural letters, look-alikes and invisible characters are no evidence, nor are signs set apart; joined letters, which
    # are what a Turkish page of the other make leaves for two letters, are none for that page.
    weak = JOINED if path[2] == "mac_turkish" else ""
    if not any((c := word[i]) not in NATURAL and c not in weak and ord(c) not in LOOKALIKE and unicodedata.category(c) != "Cf" and (c not in SIGNS or mid) for i, mid in zip(gone, inside, strict=True)):
        return 0.0
    return gain if gain > GAIN * max(1, len(gone)) else 0.0


#: Pairs of code pages by which a letter of the five languages may have come from another; these letters.
_PAIRS = [(wrong, right) for wrong in WRONG for right in RIGHT if wrong != right and any(chr(c) in NATURAL and to in NATURAL for c, to in _single(wrong, right).items())]
_CONFUSED = frozenset(chr(c) for wrong, right in _PAIRS for c, to in _single(wrong, right).items() if chr(c) in NATURAL and to in NATURAL)


def _repairer(stats: Statistics, only_found: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stats)
        for batch in batches:
            src, keys, texts = (batch.column(i) for i in range(3))
            found = repaired(reader, [t or "" for t in texts.to_pylist()], only_found)
            out = [(src[i].as_py(), keys[i].as_py(), None if only_found else new, fixed, lost) for i, (new, fixed, lost) in found.items()]
            cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["src", "row_key", "restored", "fixed", "lost"])

    return run


def restore(texts: DataFrame, stats_of: DataFrame | None = None, only_found: bool = False) -> DataFrame:
    """Damaged records of ``src, row_key, text`` with the restored text.

    Columns out: ``src, row_key, restored, fixed INT`` (words restored), ``lost INT`` (words damaged but unknown).
    Null and empty texts are sound. Repeated rows come out once. The pair statistics cover all rows of
    ``stats_of`` (by default the texts themselves).
    """
    stats = statistics(texts if stats_of is None else stats_of)
    # A text of ASCII without a question mark is no wrongly read text: bytes below 128 are read alike everywhere.
    damaged = texts.where(F.col("text").rlike(r"[^\x00-\x3e@-\x7f]")).select("src", "row_key", "text")
    return damaged.mapInArrow(_repairer(stats, only_found), "src string, row_key string, restored string, fixed int, lost int").dropDuplicates(["src", "row_key"])


def sound_rows(texts: DataFrame, stats_of: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of the rows whose ``text`` is not damaged; null texts are sound."""
    stats = statistics(stats_of)
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stats)
        for batch in batches:
            texts_ = [t or "" for t in batch.column(len(keep)).to_pylist()]
            bad = repaired(reader, texts_, True)
            yield batch.select(list(keep)).filter(pa.array([i not in bad for i in range(len(texts_))], pa.bool_()))

    return texts.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union(rows_of(spark, sf_dir, "ocr_pages", "ocr_pages", "id", "text"), rows_of(spark, sf_dir, "privacy_findings", "privacy_findings", "id", "sample"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore(inputs(spark, sf_dir), only_found=True).select("src", "row_key")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore(inputs(spark, sf_dir))


def queries():
    return {"p7_found": p7_found, "p7_restored": p7_restored}


def oracle_sql():
    return {}
