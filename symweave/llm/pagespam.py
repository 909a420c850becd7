"""Keyword-stuffed and link-list pages, found by the mutual information of neighbouring words."""

from __future__ import annotations

import hashlib
import re
import tempfile
from array import array
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.session import ship, spread, stage

#: The table of counts that executors hold has at most so many words and pairs, the most frequent ones by whole levels of count. It saves a shuffle and decides nothing: what it lacks is looked up by a join.
TABLE_WORDS = 300_000
TABLE_PAIRS = 1_000_000
#: A window of a text has about this many words.
WINDOW = 150
#: Neighbouring words with less mean mutual information (natural logarithm) than this are a word salad.
SALAD = 1.5
#: A window repeats its collocations too much if pairs that came before hold more than this share of its (positive) mutual information.
REPEATED = 0.35
#: A window of which more than the share LINKED of the characters is links is a link list, if repeated pairs, links being words of their own, hold more than this.
LINK_REPEATED = 0.05
LINKED = 0.4
#: More than this share of a page's characters must be spam.
PAGE = 0.5
#: Pieces of a batch with about this many characters are scored at once.
CHARACTERS = 1_000_000
#: A worker keeps about so many runs of letters, with so many words in them, from one piece of a batch to the next.
KEPT_RUNS, KEPT_WORDS = 250_000, 2_000_000

#: Stands for a link among words; a code point that is no character.
LINK = "\ufdd0"
_WORD = re.compile(r"[A-Z]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])|[぀-ヿ㐀-鿿豈-﫿]|[^\W\d_A-Za-zÀ-ÖØ-öø-ÿ぀-ヿ㐀-鿿豈-﫿]+|[A-ZÀ-ÖØ-Þ]|\ufdd0")
#: Markdown links, addresses, and names of hosts with a path.
_LINK = re.compile(r"\[!\[[^\]\n]*\]\([^)\n]*\)\]\([^)\n]*\)|!?\[[^\]\n]*\]\([^)\n]*\)|<?(?:https?|hxxps?|ftp)://[^\s)>]+>?|\bwww\s?\.\s?[\w-]+(?:\s?\.\s?[\w-]+)+(?:/\S*)?|(?<![\w./@-])[a-z0-9-]+(?:\.[a-z0-9-]+)+/[^\s)>]*")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_PATH = re.compile(r"\.[a-z0-9-]+/")
#: Letters and bytes beyond ASCII as they are, others as blanks: no word holds or looks past one of those.
_RUNS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
#: Stands between texts.
_BETWEEN = b"\0"
_STRUCTURE = re.compile(
    r"\s*(?:\[?\d{4}-\d\d-\d\d|\[?\d{1,2}:\d\d\b|\|.*\|\s*$|[{}\]]|\[\s*$|\"[^\"]*\"\s*(?:[:,]|$)|-?[\d.]+,?\s*$|@@|(?:diff --|index [0-9a-f]{6,}\.\.)|(?:[+]{3}|-{3}) |(?:INFO|WARN|ERROR|DEBUG|TRACE)\b)"
)
_LEAD = re.compile(r"\s*(?:>\s*)*(?:[-*+•]\s+|\d+[.)]\s+|#{1,6}\s+)?")
#: What structure and the lead of a line begin with, apart from digits.
_STRUCTURE_BEGINS, _LEAD_BEGINS = frozenset("[]{}|\"-.@+diIWEDT"), frozenset(">-*+•#")
_TAGS = re.compile(r"</?[a-zA-Z][^<>\n]{0,300}>")
_SENTENCE = re.compile(r"[.!?…:;](?=[\s\"')\]*_]|$)|[。！？؟]|\n")
_ARABIC = re.compile("[\u0620-\u064a]{3}")
_CJK = re.compile("[\u3040-\u30ff\u4e00-\u9fff]")

#: Function words of the corpus's languages; a sentence has at least two of them.
FUNCTION_WORDS = frozenset(
    """a an the and or but nor so if of to in on at by for from with without into over after before since until during when while where which who whose what why how that this these those it its they them their
    we us our you your he she his her i is are was were be been being has have had do does did can could may might must should would will not no nor only than then there here all any each every both one two as because
    although never nobody somebody nothing once twice out up about between more most many some such under unless per
    der die das des dem den ein eine einer eines und oder aber nicht nur ist sind wird werden wurde von vom zu zum zur mit ohne in im auf aus bei für wenn weil bevor nachdem seit dass als auch es er sie wir jede jeder jedes alle kein keine
    le la les l un une des du de d et ou mais ne pas que qui quand si dans sur avec sans pour par avant après depuis est sont sera nous vous il elle ils chaque tout toute ce cette ces se s n jusqu au aux
    el los las una unos unas y o pero no que cuando si en con sin para por antes después desde es son fue ha han se lo su sus cada todo toda este esta esto mientras hasta porque al del
    и или но не ни на в во с со к ко о об от до из за по при для без если когда пока что чтобы как так это этот эта его её их мы вы он она они нет только один после перед потому каждую каждом
    في من على إلى عن مع كل إذا لم لا ما هذا هذه التي الذي أن قبل بعد عند حتى مرة فقط أي بين لأن""".split()
)
#: Signs of grammar in Japanese and Chinese sentences.
FUNCTION_SIGNS = frozenset("のはをにがでともへやよりてすまし的了不在是和之每将把被从对因为再也就才并")


_HREF = 'href="'


class _Ids(dict):
    """Words by 64-bit hash of their folded form."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word.lower())
        return out


class _Runs(dict):
    """Numbers of runs of letters, in UTF-8, with the words of each: a run is taken apart once, and found again by its bytes wherever it occurs. Number 0 is the mark between texts, without words."""

    def __init__(self):
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.ids = _Ids()
        self.words, self.ends = array("Q", [0]), array("q", [1, 1])
        self[_BETWEEN] = 0

    def __missing__(self, run: bytes) -> int:
        self.words.extend(map(self.ids.__getitem__, _WORD.findall(run.decode())))
        out = self[run] = len(self.ends) - 1
        self.ends.append(len(self.words))
        return out

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, text of each word)."""
        if len(self) > KEPT_RUNS or len(self.words) > KEPT_WORDS:
            self._empty()
        runs = (b" " + _BETWEEN + b" ").join([t.encode().translate(_RUNS) for t in texts]).split()
        numbers = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
        ends = np.frombuffer(self.ends, np.int64)
        first, sizes = ends[numbers], ends[numbers + 1] - ends[numbers]
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.frombuffer(self.words, np.uint64)[at], np.repeat(np.cumsum(numbers == 0), sizes)


class _Sorted:
    """Different hashes in ascending order, with the place where each range of the leading bits begins, so that one is found in a few steps."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, int(len(keys)).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.begins = np.zeros((1 << bits) + 1, np.int32 if len(keys) < 1 << 31 else np.int64)
        np.cumsum(np.bincount((keys >> self.shift).view(np.int64), minlength=1 << bits), out=self.begins[1:])

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each hash that is asked for; there must be keys."""
        last = len(self.keys) - 1
        at = np.minimum(self.begins[(asked >> self.shift).view(np.int64)], last)
        for _ in range(2):
            at += (self.keys[at] < asked) & (at < last)
        rest = np.flatnonzero(self.keys[at] < asked)
        at[rest] = np.minimum(np.searchsorted(self.keys, asked[rest]), last)
        return at, self.keys[at] == asked


def pair_ids(words: np.ndarray) -> np.ndarray:
    """The hash of each word and the next."""
    with np.errstate(over="ignore"):
        return words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (words[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


def repaired(text: str) -> str:
    """A text that was decoded as Latin-1 instead of UTF-8, decoded well; others as they are."""
    if "Ø" in text or "Ð" in text or "Ã" in text or "ã" in text or "å" in text:
        for code in ("latin-1", "cp1252"):
            try:
                text = text.encode(code).decode()
                break
            except UnicodeError:
                continue
    return text.replace(LINK, " ") if LINK in text else text


def _some_link(text: str) -> bool:
    """Whether a text has what every link has one of, which is cheap to look for."""
    return "](" in text or "://" in text or "www" in text or ("/" in text and _PATH.search(text) is not None)


def _marked(text: str) -> str:
    """A repaired text with LINK in place of links."""
    return _LINK.sub(f" {LINK} ", text) if _some_link(text) else text


def words_of(text: str) -> list[str]:
    """The words of a repaired text that the counts of the corpus are made of; a link is a word."""
    return _WORD.findall(_marked(text))


def _joined(texts: list[str], runs: _Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, text of each word, pairs of neighbours of one text, place of each pair's first word) of texts with LINK in place of links."""
    words, owner = runs.read(texts)
    at = np.flatnonzero(owner[:-1] == owner[1:])
    return words, owner, pair_ids(words)[at] if len(words) else words, at


def neighbour_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(kind, id, n)``: how often each word (kind 0) and each pair of neighbours (kind 1) occurs in all different texts; summed per task before the shuffle.

    Copies of a text count once, so that a page isn't borne out by its copies; they are taken together per task before their shuffle.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs()
        parts: tuple[list, list] = ([], [])
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if parts[kind]:
                    values, counts = np.unique(np.concatenate(parts[kind]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), kind, np.int32)), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "id", "n"])
                parts[kind].clear()

        for batch in batches:
            for texts in _pieces(batch.column(0)):
                words, _, pairs, _ = _joined([_marked(repaired(t)) for _, t in texts], runs)
                parts[0].append(words)
                parts[1].append(pairs)
                size += len(words)
                if size > 4_000_000:
                    yield from out()
                    size = 0
        yield from out()

    different = documents.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256)).agg(F.first(text).alias(text)).select(text)
    return different.mapInArrow(run, "kind int, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n"))


def _pieces(texts: pa.Array) -> Iterator[list[tuple[int, str]]]:
    """(row, text) of the texts that are not empty, about CHARACTERS at once, or one longer text."""
    out, size = [], 0
    for i, t in enumerate(texts):
        t = t.as_py()
        if t:
            out.append((i, t))
            size += len(t)
            if size > CHARACTERS:
                yield out
                out, size = [], 0
    if out:
        yield out


_sent: set[tuple[str, str]] = set()


def count_table(counts: DataFrame, words: int = TABLE_WORDS, pairs: int = TABLE_PAIRS) -> str:
    """Send the most frequent words and pairs of :func:`neighbour_counts` to the executors; returns the name of their file.

    The file holds the sums of all counts, and for words and for pairs the greatest count that it may lack. It is bounded by ``words`` and ``pairs`` whatever the corpus.
    """
    spark = counts.sparkSession
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy("kind", level.alias("level")).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    arrays = []
    for kind, room in ((0, words), (1, pairs)):
        own = [r for r in levels if r["kind"] == kind]
        least = None
        for r in own:
            room -= r["rows"]
            if room < 0:
                break
            least = r["level"]
        top = counts.where((F.col("kind") == kind) & (level >= least)).select("id", "n").toArrow() if least is not None else pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        key = top["id"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(key)
        absent = [r["level"] for r in own if least is None or r["level"] < least]
        most_absent = int(2 ** ((max(absent) + 1) / 8)) + 1 if absent else 0
        arrays += [np.array([sum(r["n"] for r in own), most_absent, len(key)], np.int64), key[order].view(np.int64), top["n"].to_numpy().astype(np.int64)[order]]
    flat = np.concatenate(arrays)
    name = f"neighbours-{hashlib.sha256(flat.tobytes()).hexdigest()[:24]}.npy"
    if (spark.sparkContext.applicationId, name) not in _sent:
        target = Path(tempfile.mkdtemp(prefix="spark-neighbours-")) / name
        np.save(target, flat)
        spark.sparkContext.addFile(str(target))
        _sent.add((spark.sparkContext.applicationId, name))
    return name


class Table:
    """The counts of the most frequent words and pairs in one worker, mapped into memory."""

    def __init__(self, file: str):
        flat = np.load(SparkFiles.get(file), mmap_mode="r")
        self.tables, at = [], 0
        for _ in range(2):
            total, absent, size = (int(x) for x in flat[at : at + 3])
            self.tables.append((total, absent, _Sorted(flat[at + 3 : at + 3 + size].view(np.uint64)), flat[at + 3 + size : at + 3 + 2 * size]))
            at += 3 + 2 * size
        self.words, self.pairs = self.tables[0][0], self.tables[1][0]

    def bounds(self, kind: int, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least, greatest possible count, whether known) of words or pairs; what the table lacks occurs as often as on the page itself or more, but no more often than it may lack."""
        _, absent, keys, values = self.tables[kind]
        if not len(values):
            return own, np.maximum(own, absent), np.full(len(ids), absent == 0)
        at, hit = keys.find(ids)
        return np.where(hit, values[at], own), np.where(hit, values[at], np.maximum(own, absent)), hit | (absent == 0)


@cache
def _table(file: str) -> Table:
    return Table(file)


def windows(text: str) -> Iterator[tuple[str, int, int, int]]:
    """``(text with LINK in place of links, characters, characters of links, links)`` of pieces of running text and lists; blanks are no characters.

    Program text in fences, logs, tables and JSON are left out. A piece ends at such lines, at a blank line once it has twelve words, and at
    WINDOW words; a longer line is cut.
    """
    plain: list[str] = []
    chars = linked = links = words = 0
    fence = False

    def piece() -> tuple[str, int, int, int]:
        return "\n".join(plain), chars, linked, links

    fences, any_link = "```" in text or "~~~" in text, _some_link(text)
    for line in text.splitlines():
        if fences and _FENCE.match(line):
            fence = not fence
            continue
        bare = line.strip()
        if fence or (bare and (bare[-1] in ";{}" or "\t" in bare or ((bare[0] in _STRUCTURE_BEGINS or bare[0].isdecimal()) and _STRUCTURE.match(line)))):
            if chars:
                yield piece()
                plain, chars, linked, links, words = [], 0, 0, 0, 0
            continue
        if not bare:
            if words >= 12 or linked > 60:
                yield piece()
                plain, chars, linked, links, words = [], 0, 0, 0, 0
            continue
        body = line[_LEAD.match(line).end() :] if bare[0] in _LEAD_BEGINS or bare[0].isdecimal() else line.lstrip()
        if "<" in body:
            body = _TAGS.sub(lambda m: f" {m[0][m[0].find(_HREF) + len(_HREF) :].split(_HREF[-1])[0]} " if _HREF in m[0] else " ", body)
        for start in range(0, len(body), 20 * WINDOW):
            part = body[start : start + 20 * WINDOW]
            blanks = part.count(" ")
            chars += len(part) - blanks
            if any_link and _some_link(part):
                between = _LINK.split(part)
                rest = f" {LINK} ".join(between)
                here = len(between) - 1
                linked += len(part) - blanks - sum(len(x) - x.count(" ") for x in between)
                links += here
                words += rest.count(" ") + 1 - 2 * here if rest.strip() else 0
            else:
                rest = part
                words += blanks + 1 if rest.strip() else 0
            plain.append(rest)
            if words >= WINDOW or chars > 8 * WINDOW:
                yield piece()
                plain, chars, linked, links, words = [], 0, 0, 0, 0
    if chars:
        yield piece()


def sentence_share(plain: str) -> float:
    """The share of a piece's characters that stand in sentences: seven to sixty words between stops, two different function words, no pair of words twice.

    Arabic, which joins function words to others, needs five words and one of them. In Japanese and Chinese a sentence has ten signs or more, one of grammar, and ends with a full stop.
    """
    held = start = 0
    for m in _SENTENCE.finditer(plain + "\n"):
        unit = plain[start : m.start()]
        start = m.end()
        if len(unit) < 10:
            continue
        if _CJK.search(unit):
            if m[0] in "。！？.!?" and any(c in FUNCTION_SIGNS for c in unit):
                held += len(unit) - unit.count(" ")
            continue
        words = unit.lower().replace("'", " ").replace("’", " ").split()
        arabic = _ARABIC.search(unit) is not None
        if (5 if arabic else 7) <= len(words) <= 60 and len(FUNCTION_WORDS.intersection(words)) >= (1 if arabic else 2):
            pairs = list(zip(words, words[1:]))
            if len(set(pairs)) > 0.9 * len(pairs):
                held += len(unit) - unit.count(" ")
    return held / max(1, len(plain) - plain.count(" ") - plain.count("\n"))


def _of_page(ids: np.ndarray, page: np.ndarray) -> np.ndarray:
    """A hash of an id and the page or window that it stands in."""
    with np.errstate(over="ignore"):
        mixed = (ids ^ (page.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xA0761D6478BD642F)
        return mixed ^ (mixed >> np.uint64(32))


def _tally(stream: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How often each of ``asked`` is in ``stream``."""
    if not len(stream):
        return np.zeros(len(asked), np.int64)
    keys, counts = np.unique(stream, return_counts=True)
    at, hit = _Sorted(keys).find(asked)
    return np.where(hit, counts[at], 0)


def _first_places(keys: np.ndarray) -> np.ndarray:
    """Where each different key comes first."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys)
    sorted_keys = keys[order]
    return np.minimum.reduceat(order, np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])))


def _information(seen: np.ndarray, left: np.ndarray, right: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Pointwise mutual information of neighbours, seen ``seen`` times among ``pairs``, of words with counts ``left`` and ``right`` among ``words``."""
    return np.log(np.maximum(seen, 0.5) * words * words / pairs / (np.maximum(left, 1.0) * np.maximum(right, 1.0)))


def window_scores(counts: tuple, own_words: np.ndarray, own_pairs: np.ndarray, sizes: np.ndarray, at: np.ndarray, pairs: np.ndarray, owner: np.ndarray, n: int, total: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest mean mutual information of ``n`` windows, and least and greatest share of repeated pairs in it.

    ``counts`` are least and greatest counts of words and of pairs; own occurrences of the page (``own_*``, ``sizes`` words in all, per pair) are taken out. ``at`` is the place of a pair's first word, ``owner`` its window.
    """
    low_word, high_word, low_pair, high_pair = counts
    words, all_pairs = np.maximum(1, total[0] - sizes).astype(float), np.maximum(1, total[1] - np.maximum(0, sizes - 1)).astype(float)
    low_word, high_word = low_word - own_words, high_word - own_words
    low = _information((low_pair - own_pairs).astype(float), high_word[at], high_word[at + 1], words, all_pairs)
    high = _information((high_pair - own_pairs).astype(float), low_word[at], low_word[at + 1], words, all_pairs)
    size = np.maximum(1, np.bincount(owner, minlength=n))
    again = np.ones(len(pairs), bool)
    again[_first_places(_of_page(pairs, owner))] = False
    held = lambda x, which: np.bincount(owner, np.maximum(x, 0) * which, n)
    share = lambda more, less: more / np.maximum(more + less, 1e-9)
    mean = lambda x: np.bincount(owner, x, n) / size
    return mean(low), mean(high), share(held(low, again), held(high, ~again)), share(held(high, again), held(low, ~again))


def _verdicts(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, listed: np.ndarray, big: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(salad, repeated, open) of windows: whether the bounds decide both; ``big`` windows have enough words."""
    limit = np.where(listed, LINK_REPEATED, REPEATED)
    salad, no_salad = high < SALAD, low >= SALAD
    repeated, not_repeated = least > limit, most <= limit
    return salad & big, repeated & big, big & ~((salad | no_salad) & (repeated | not_repeated))


#: What is left open by the table: a window's characters, whether it is a link list, its words with their own counts on the page, and the ids to look up.
_OPEN = "array<struct<win:int,chars:long,listed:boolean,words:array<long>,own_words:array<long>,own_pairs:array<long>,size:long,missing:array<long>>>"
_OPEN_TYPE = pa.list_(pa.struct([("win", pa.int32()), ("chars", pa.int64()), ("listed", pa.bool_()), ("words", pa.list_(pa.int64())), ("own_words", pa.list_(pa.int64())), ("own_pairs", pa.list_(pa.int64())), ("size", pa.int64()), ("missing", pa.list_(pa.int64()))]))
KINDS = ["salad", "stuffed", "linked", "spam"]
#: A window with fewer words is not judged.
FEW = 4


def score_texts(texts: list[str], table: Table, runs: _Runs) -> list[tuple[int, list[int], list[dict]]]:
    """(characters, characters of spam by KINDS, open windows) of each text; all windows of all texts are scored at once, and only those that mutual information flags, or may flag, are checked for sentences."""
    texts = [repaired(t) for t in texts]
    out = [(len(t) - t.count(" ") - t.count("\n") - t.count("\t") - t.count("\r"), [0, 0, 0, 0], []) for t in texts]
    found = [(page, w) for page, t in enumerate(texts) for w in windows(t)]
    if not found:
        return out
    page = np.array([p for p, _ in found])
    words, owner, pairs, at = _joined([w[0] for _, w in found], runs)
    stream, of, stream_pairs, of_pair = _joined([_marked(t) for t in texts], runs)
    own_words = _tally(_of_page(stream, of), _of_page(words, page[owner]))
    own_pairs = _tally(_of_page(stream_pairs, of[of_pair]), _of_page(pairs, page[owner[at]]))
    sizes = np.bincount(of, minlength=len(texts))
    low_word, high_word, known_word = table.bounds(0, words, own_words)
    low_pair, high_pair, known_pair = table.bounds(1, pairs, own_pairs)
    listed = np.array([w[2] > LINKED * w[1] for _, w in found])
    big = np.bincount(owner, minlength=len(found)) >= FEW
    scores = window_scores((low_word, high_word, low_pair, high_pair), own_words, own_pairs, sizes[page[owner[at]]], at, pairs, owner[at], len(found), (table.words, table.pairs))
    salad, repeated, doubt = _verdicts(*scores, listed, big)
    starts, pair_starts = np.searchsorted(owner, np.arange(len(found) + 1)), np.searchsorted(owner[at], np.arange(len(found) + 1))
    number = np.arange(len(found)) - np.searchsorted(page, page)
    for i in np.flatnonzero(salad | repeated | doubt).tolist():
        p, (plain, chars, _, _) = found[i]
        if sentence_share(plain.replace(LINK, " ")) >= 0.5:
            continue
        if doubt[i]:
            a, b = slice(starts[i], starts[i + 1]), slice(pair_starts[i], pair_starts[i + 1])
            missing = np.unique(np.concatenate([words[a][~known_word[a]], pairs[b][~known_pair[b]]]))
            out[p][2].append({"win": int(number[i]), "chars": chars, "listed": bool(listed[i]), "words": words[a].view(np.int64), "own_words": own_words[a], "own_pairs": own_pairs[b], "size": int(sizes[p]), "missing": missing.view(np.int64)})
        else:
            _add(out[p][1], chars, bool(listed[i]), bool(salad[i]), bool(repeated[i]))
    return out


def _add(shares: list[int], chars: int, listed: bool, salad: bool, repeated: bool) -> None:
    shares[0] += chars * (salad and not listed)
    shares[1] += chars * (repeated and not listed)
    shares[2] += chars * (listed and (salad or repeated))
    shares[3] += chars * (salad or repeated)


def _settled(rows: DataFrame, counts: DataFrame, file: str) -> DataFrame:
    """``(digest, salad, stuffed, linked, spam)``: characters of spam in the windows that the table left open, by the exact counts of what it lacks.

    ``rows`` has a digest of the text and its open windows; copies of a text are taken together. An id that is looked up is rarer than those in the table, so no key of the join is hot.
    """
    todo = stage(rows.select("digest", F.inline("open")).dropDuplicates(["digest", "win"]), "open")
    asked = todo.select("digest", "win", F.explode("missing").alias("id")).join(counts.select("id", "n"), "id")
    got = asked.groupBy("digest", "win").agg(F.collect_list("id").alias("ids"), F.collect_list("n").alias("ns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(file)
        for batch in batches:
            digests, shares = [], []
            for r in batch.to_pylist():
                extra = dict(zip(np.array(r["ids"] or [], np.int64).view(np.uint64).tolist(), r["ns"] or []))
                words, own_words, own_pairs = np.array(r["words"], np.int64).view(np.uint64), np.array(r["own_words"], np.int64), np.array(r["own_pairs"], np.int64)
                pairs = pair_ids(words)
                exact = []
                for kind, x, own in ((0, words, own_words), (1, pairs, own_pairs)):
                    low, _, known = table.bounds(kind, x, own)
                    exact.append(np.where(known, low, np.array([extra.get(i, 0) for i in x.tolist()])))
                at, owner = np.arange(len(pairs)), np.zeros(len(pairs), np.int64)
                scores = window_scores((exact[0], exact[0], exact[1], exact[1]), own_words, own_pairs, np.full(len(pairs), r["size"]), at, pairs, owner, 1, (table.words, table.pairs))
                salad, repeated, _ = _verdicts(*scores, np.array([r["listed"]]), np.array([True]))
                digests.append(r["digest"])
                shares.append([0, 0, 0, 0])
                _add(shares[-1], r["chars"], r["listed"], bool(salad[0]), bool(repeated[0]))
            values = np.array(shares, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *[pa.array(values[:, i]) for i in range(4)]], names=["digest", *KINDS])

    met = todo.join(got, ["digest", "win"], "left").select("digest", "chars", "listed", "words", "own_words", "own_pairs", "size", "ids", "ns")
    judged = met.mapInArrow(run, "digest binary, salad long, stuffed long, linked long, spam long")
    return judged.groupBy("digest").agg(*[F.sum(k).alias(f"more_{k}") for k in KINDS])


def page_spam(documents: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = TABLE_WORDS, pairs: int = TABLE_PAIRS) -> DataFrame:
    """``(key, salad, stuffed, linked, spam)``: the shares of each page's characters that are spam, by kind and together.

    The counts of words and of neighbouring words of the whole corpus give the pointwise mutual information of each pair of neighbours in each
    window of a text, without what the page and its copies add to them; a link is a word. A window with a low mean is a word salad; one whose mutual information lies in pairs that came before in it
    is stuffed with its collocations, or a link list if most of it is links. A window that holds sentences for half of its characters is none of these. Program text, logs, tables and JSON are never spam.

    Executors hold the counts of the most frequent ``words`` and ``pairs``; for windows that the bounds of the others leave open, these are looked up exactly by a shuffled join. So the result does not depend on the table's size.

    Null, empty and blank texts have shares of 0. Long texts are read whole, window by window. Repeated rows stay repeated; an
    empty table gives no rows. Extra columns are ignored; a null key is kept.

    When the query is built, the counts and the first scores are written to the shared folder and the table comes to the driver.
    """
    ship(documents.sparkSession)
    counts = stage(neighbour_counts(documents, text), "neighbours")
    file = count_table(counts, words, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, runs = _table(file), _Runs()
        for batch in batches:
            size = batch.num_rows
            total, shares, opens, digests = np.zeros(size, np.int64), np.zeros((size, 4), np.int64), [[] for _ in range(size)], [None] * size
            for piece in _pieces(batch.column(1)):
                for (i, t), (chars, spam, open_windows) in zip(piece, score_texts([t for _, t in piece], table, runs)):
                    total[i], shares[i], opens[i] = chars, spam, open_windows
                    if open_windows:
                        digests[i] = hashlib.sha256(t.encode()).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), *[pa.array(shares[:, i]) for i in range(4)], pa.array(digests, pa.binary()), pa.array(opens, _OPEN_TYPE)], names=[key, "_total", *KINDS, "digest", "open"])

    kind = documents.schema[key].dataType.simpleString()
    scored = stage(spread(documents.select(key, text)).mapInArrow(run, f"`{key}` {kind}, _total long, salad long, stuffed long, linked long, spam long, digest binary, open {_OPEN}"), "pages")
    left = scored.where("digest is not null")
    chars = {k: F.col(k) for k in KINDS}
    if not left.isEmpty():
        scored = scored.join(_settled(left, counts, file), "digest", "left")
        chars = {k: F.col(k) + F.coalesce(f"more_{k}", F.lit(0)) for k in KINDS}
    return scored.select(key, *[F.coalesce(F.try_divide(c.cast("double"), "_total"), F.lit(0.0)).alias(k) for k, c in chars.items()])


def spam_pages(documents: DataFrame, **kw) -> DataFrame:
    """``(key)`` of the pages of which more than PAGE of the characters are spam."""
    return page_spam(documents, **kw).where(F.col("spam") > PAGE).select(kw.get("key", "doc_id"))
