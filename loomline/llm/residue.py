"""Template residue and error-page text in commit histories.

Three character n-gram models (orders 1 to 5, each backing off to the one below) are fit on the seed texts:
stand-ins (placeholders, forms, filler), notices (errors, demands for scripts) and natural prose. A text is taken
apart into units: lines of messages, their sentences and clauses, authors, and lines of a diff that belong to no hunk. Source lines in hunks,
binary data and the fixed lines of a layout are no units. For each character of a unit the log ratio of a residue
model to prose is looked up; windows whose mean is above a threshold localise residue, and a unit is residue if
windows cover enough of it. A document is excluded if one of its units is.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.batches import slices
from loomline.llm.residue_seeds import notices, prose, stand_ins
from loomline.session import spread

#: n-gram orders, strength of the backing-off, bits of the table, window, least mean ratio, least coverage.
ORDER, STRENGTH, BITS, WINDOW, RATIO, COVERAGE = 5, 1.0, 22, 20, 0.45, 0.82
#: Greatest log ratio that one character counts with.
CLIP = 5.0
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

_DIGITS = re.compile(r"[0-9]")
_HEX = re.compile(r"\b(?=[a-z]*[0-9])[0-9a-f]{6,}\b")


def plain(text: str) -> str:
    """Lower case; numbers as zeros, hexadecimal names as one sign."""
    return _DIGITS.sub("0", _HEX.sub("0a0b0c0d", text.lower()))


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the n-gram that ends at each character."""
    out, h = [], np.zeros(len(codes), np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            before = np.zeros(len(codes), np.uint64)
            before[k:] = c[: len(c) - k]
            h = h + before * _MIX[k] * (np.uint64(2 * k + 1) | np.uint64(1))
            x = (h ^ (h >> np.uint64(29))) * _M
            out.append(x ^ (x >> np.uint64(32)))
    return out


class Models:
    """Log ratios of both residue models to prose, in one table addressed by the hash of an n-gram."""

    def __init__(self, mark: np.ndarray, ratio: np.ndarray, bits: int = BITS):
        """mark, ratio: hashes of n-grams, each at a place of its own, and their log ratios."""
        self.mark, self.ratio, self.bits = mark, ratio, bits
        self.slot = np.full(1 << bits, -1, np.int32)
        self.slot[(mark >> np.uint64(64 - bits)).astype(np.int64)] = np.arange(len(mark), dtype=np.int32)

    @classmethod
    def fit(cls, classes: list[Iterable[str]], bits: int = BITS) -> Models:
        """classes: texts of stand-ins, notices, prose."""
        counts = [cls._count(texts) for texts in classes]
        alphabet = {g[-1] for by in counts for g in by[1]}
        base = 1.0 / (len(alphabet) + 200)
        probability: list[dict[str, float]] = []
        seen = set().union(*(by[k] for by in counts for k in range(1, ORDER + 1)))
        for by in counts:
            total = sum(by[1].values())
            context: list[Counter] = [Counter() for _ in range(ORDER + 1)]
            for k in range(2, ORDER + 1):
                for g, n in by[k].items():
                    context[k][g[:-1]] += n
            p: dict[str, float] = {}
            for g in sorted(seen, key=len):
                k = len(g)
                if k == 1:
                    p[g] = (by[1][g] + 50 * base) / (total + 50)
                else:
                    p[g] = (by[k][g] + STRENGTH * p[g[1:]]) / (context[k][g[:-1]] + STRENGTH)
            probability.append(p)
        taken: set[int] = set()
        marks, ratios = [], []
        by_length = defaultdict(list)
        for g in sorted(seen):
            by_length[len(g)].append(g)
        for k in range(1, ORDER + 1):
            grams = by_length[k]
            codes = np.array([[ord(c) for c in g] for g in grams], np.uint32).reshape(len(grams), k)
            flat = codes.reshape(-1)
            hs = _hashes(flat)[k - 1].reshape(len(grams), k)[:, -1]
            for g, h in zip(grams, hs):
                at = int(h) >> (64 - bits)
                if at not in taken:  # of two n-grams at one place the later falls back on a shorter one
                    taken.add(at)
                    marks.append(h)
                    nat = probability[2][g]
                    ratios.append((math.log(probability[0][g] / nat), math.log(probability[1][g] / nat)))
        return cls(np.array(marks, np.uint64), np.array(ratios, np.float32), bits)

    @staticmethod
    def _count(texts: Iterable[str]) -> list[Counter]:
        by = [Counter() for _ in range(ORDER + 1)]
        for t in texts:
            s = "\n" + plain(t)
            for k in range(1, ORDER + 1):
                by[k].update([s[i : i + k] for i in range(k == 1, len(s) - k + 1)])
        return by

    def score(self, codes: np.ndarray) -> np.ndarray:
        """(n, 2): ratios of the longest n-gram that the table knows at each character; 0 where none is."""
        out = np.zeros((len(codes), 2), np.float32)
        open_ = np.arange(len(codes))
        for h in reversed(_hashes(codes)):
            if not len(open_):
                break
            mine = h[open_]
            at = self.slot[(mine >> np.uint64(64 - self.bits)).astype(np.int64)]
            hit = (at >= 0) & (self.mark[at] == mine)
            out[open_[hit]] = self.ratio[at[hit]]
            open_ = open_[~hit]
        return out


def coverage(models: Models, units: list[str], window: int = WINDOW, ratio: float = RATIO) -> np.ndarray:
    """(n, 2): the share of each unit's characters that windows of stand-ins and of notices cover.

    A window has `window` characters, or all of a shorter unit.
    """
    if not units:
        return np.zeros((0, 2))
    texts = ["\n" + plain(u) for u in units]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes + 1  # without the mark of the beginning
    score = np.clip(models.score(codes), -CLIP, CLIP)  # so that a few telling signs can't carry the prose around them
    score[starts - 1] = 0
    sums = np.zeros((len(codes) + 1, 2))
    np.cumsum(score, axis=0, out=sums[1:])
    place = np.arange(len(codes))
    unit = np.repeat(np.arange(len(units)), sizes)
    begin = place - window + 1
    first = np.maximum(begin, starts[unit])
    full = (begin >= starts[unit]) | (place == ends[unit] - 1)
    length = np.maximum(place - first + 1, 1)
    out = np.zeros((len(units), 2))
    for k in range(2):
        good = full & (place >= starts[unit]) & ((sums[place + 1, k] - sums[first, k]) / length > ratio)
        edge = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edge, first[good], 1)
        np.add.at(edge, place[good] + 1, -1)
        covered = (np.cumsum(edge[:-1]) > 0).astype(np.int64)
        covered[starts - 1] = 0
        out[:, k] = np.add.reduceat(covered, ends - sizes) / np.maximum(sizes - 1, 1)
    return out


# Layouts

_LINE_END = re.compile(r"\r+\n?")
_HUNK = re.compile(r"^@@ -[^\n]*\n(?:[ +\-\\][^\n]*\n?)*", re.M)
_BINARY = re.compile(r"^GIT binary patch\n(?:[^\n]+\n?)*(?:\n(?:literal|delta) \d+\n(?:[^\n]+\n?)*)*", re.M)
_FIXED = re.compile(
    r"(?:commit [0-9a-f]{7,64}|Date: .*[0-9].*|date: .*[0-9].*|From [0-9a-f]{7,64} .*|description:|-{2,}|={3,}|--\s*|diff --git .*|index [0-9a-f]+\.\..*"
    r"|(?:---|\+\+\+) (?:[ab]/.*|/dev/null.*)|Binary files .* differ|(?:literal|delta) \d+|(?:new|deleted) file mode \d+|(?:old|new) mode \d+|(?:dis)?similarity index .*|(?:rename|copy) (?:from|to) .*|\{\{\{|\}\}\})\s*"
)
#: A header of change, which names the change first, and ends before its description; the line of a file before its diff.
_HEADER = re.compile(r"^changeset: +\d*:?[0-9a-f]{6,64}[ \t]*\n(?:(?:changeset|parent|branch|tag|bookmark|phase|files|user|date): [^\n]*\n)*", re.M)
_NO_AUTHOR = re.compile(r"^(?!user: )[^\n]*\n", re.M)
_FILE = re.compile(r"^Index: [^\n]*\n(?=(?:={10,}|index [0-9a-f]+\.\.|--- ))", re.M)
_LEAD = re.compile(r"(?:Author|From|user|Commit|Committer):\s+(?P<author>.*)|r\d+ \| (?P<svn>.*) \| \d{4}-.*|\* \d{4}-\d\d-\d\d [\d:]+ [+-]\d{4} (?P<who>[^:]*): (?P<what>.*)|(?P<wrote>.*) wrote on \d{4}-.*:|Subject: (?:\[PATCH[^\]]*\] )?(?P<subject>.*)")

_TRAILER = re.compile(r"[A-Z][a-z]+(?:[ -][a-z]+)*: (\S.*)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
_CLAUSE = re.compile(r"(?<=[.!?,;:])\s+|(?<=[。！？、；：])\s*|\s+[-–—]+\s+")


@dataclass(frozen=True, slots=True)
class Unit:
    part: str  # "author" or "text"
    text: str


def _pieces(line: str, out: list[Unit]) -> None:
    """A line, its sentences and clauses of at least a window, and the value of a trailer: residue in one of them isn't diluted
    by the others."""
    out.append(Unit("text", line))
    trailer = _TRAILER.fullmatch(line)
    if trailer:
        out.append(Unit("text", trailer[1]))
    if len(line) <= WINDOW:
        return
    for end in (_SENTENCE, _CLAUSE):
        parts = end.split(line)
        if len(parts) > 1:
            out.extend(Unit("text", p) for p in map(str.strip, parts) if len(p) >= WINDOW)


def _lines(text: str, out: list[Unit]) -> None:
    text = _BINARY.sub("", _HUNK.sub("", text))
    text = _FILE.sub("", _HEADER.sub(lambda m: _NO_AUTHOR.sub("", m[0]), text))
    for line in text.split("\n"):
        s = line.strip()
        if not s or _FIXED.fullmatch(s):
            continue
        m = _LEAD.fullmatch(s)
        if not m:
            _pieces(s, out)
            continue
        author, said = m["author"] or m["svn"] or m["who"] or m["wrote"], m["what"] or m["subject"]
        if author and author.strip():
            out.append(Unit("author", author.strip()))
        if said and said.strip():
            _pieces(said.strip(), out)


def _commit(record: dict, out: list[Unit]) -> None:
    for key, value in record.items():
        if isinstance(value, dict):
            name = value.get("name"), value.get("email")
            out.extend(Unit("author", v.strip()) for v in name if isinstance(v, str) and v.strip())
        elif isinstance(value, str) and key not in ("sha", "id", "parent", "date"):
            _lines(value, out)


def units(text: str | None) -> list[Unit]:
    """The units of a document; null, empty and blank texts have none. Layouts may be mixed in one text."""
    out: list[Unit] = []
    if not text or not text.strip():
        return out
    text = _LINE_END.sub("\n", text) if "\r" in text else text
    if '{"' in text:
        rest = []
        for line in text.split("\n"):
            record = None
            if line.startswith('{"'):
                try:
                    record = json.loads(line)
                except ValueError:
                    record = None
            if isinstance(record, dict) and ("sha" in record or "patch" in record):
                _commit(record, out)
            else:
                rest.append(line)
        text = "\n".join(rest)
    _lines(text, out)
    return out


@functools.cache
def fit() -> Models:
    """Once in a process: the models of the seed texts: the same on every machine."""
    return Models.fit([stand_ins(), notices(), prose()])


_fitted: list[Models] = []


def find_residue(docs: DataFrame, key: str, text: str, least: float = COVERAGE) -> DataFrame:
    """(key, part, kind, coverage, excerpt): the unit of each document with the most residue, for documents that
    have one with a coverage of at least `least`; kind is "stand-in" or "notice".

    Null, empty and blank texts have no units. Very long texts are read whole. Each row of docs is judged alone, so
    repeated rows come out repeatedly.
    """

    models_here = fit()
    # a few MB whatever the data: the n-grams of the seed texts
    tables = docs.sparkSession.sparkContext.broadcast((models_here.mark, models_here.ratio))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _fitted:
            _fitted.append(Models(*tables.value))
        models = _fitted[0]
        for b in slices(batches, 1):
            rows = [units(t) for t in b.column(1).to_pylist()]
            flat = [u for us in rows for u in us]
            share = coverage(models, [u.text for u in flat])
            most = share.max(axis=1) if len(flat) else np.zeros(0)
            keep, found, at = [], [], 0
            for i, us in enumerate(rows):
                if us:
                    k = at + int(np.argmax(most[at : at + len(us)]))
                    if most[k] >= least:
                        keep.append(i)
                        found.append((flat[k].part, "stand-in" if share[k, 0] >= share[k, 1] else "notice", float(most[k]), flat[k].text))
                at += len(us)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), *(pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.string())))], [key, "part", "kind", "coverage", "excerpt"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, F.col(text).alias("__text"))).mapInArrow(run, f"`{key}` {kind}, part string, kind string, coverage double, excerpt string")
